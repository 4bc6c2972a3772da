"""URL templates, tokenizer alignment and the Merkle manifest on small tables, against brute force."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PAGES = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing extra columns."""
    rows = [
        (1, "Hello  WORLD <|endoftext|> don't", "en", "a", 5), (2, None, None, None, None), (3, "", "en", "a", 0), (4, " \t\n ", "en", "b", 4),
        (5, "word " * 5000, "en", "a", 25000), (5, "word " * 5000, "en", "a", 25000), (None, "no id here", "en", "b", 10), (None, None, None, None, None),
        (6, "ÀB Σς ① ﬁ it's 123 45,6!!  __a \x1c\x85 x", "fr", "c", 9), (7, "a ▁ sign", "fr", "a", 1), (8, "ends in spaces   ", "", "a", 1),
        (9, "  two  \n\n three </s> <0x0A> 日本語 🙂", "fr", "a", 1),
    ]
    df = spark.createDataFrame(rows, DOCS)
    for c in ("pair", "block", "planes", "tree", "h", "pos", "n", "load", "path", "top", "at", "id"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree_paths(nodes):
    """Root and, per leaf, its siblings (left?, digest or None), level by level."""
    paths, where, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for leaf, i in enumerate(where):
            j = i ^ 1
            paths[leaf].append((i % 2 == 1, level[j] if j < len(level) else None))
        level = [H(*level[i : i + 2]) for i in range(0, len(level), 2)]
        where = [i // 2 for i in where]
    return level[0], paths


def fold(node, path):
    for left, h in path:
        node = H(h, node) if left else H(node, h or "")
    return node


def brute_manifest(rows):
    """rows of (doc_id, source, lang, n_chars, text) to a counter of results."""
    null_first = lambda v: (v is not None, v if v is None else v.encode() if isinstance(v, str) else v)
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append((H(*map(framed, r)), r))
    langs = sorted(by, key=null_first)
    trees = {}
    for lang in langs:
        by[lang].sort(key=lambda x: ((x[1][0] is not None, x[1][0] or 0), x[0]))
        trees[lang] = tree_paths([h for h, _ in by[lang]])
    root, upper = tree_paths([trees[x][0] for x in langs])
    out = Counter()
    for k, lang in enumerate(langs):
        for (leaf, r), own in zip(by[lang], trees[lang][1]):
            path = own + upper[k]
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            forged = H(*map(framed, (*r[:3], None if r[3] is None else r[3] + 1, r[4]))) if bad else leaf
            end = fold(forged, path)
            out[r[0], leaf, trees[lang][0], root, H(*[h for _, h in path if h]), end, end == root] += 1
    return out


def manifest_rows(docs, **kw):
    from hypnolake.llm import manifest as mf

    fields = [F.col(c) for c in mf.FIELDS]
    changed = mf.leaf([F.col(c) + 1 if c == "n_chars" else F.col(c) for c in mf.FIELDS])
    out = mf.proofs(docs, forged=F.when(mf.tampered(F.col("doc_id")), changed).otherwise(mf.leaf(fields)), **kw)
    end = mf.fold(F.col("forged"), F.col("path"))
    got = out.select("doc_id", "leaf", "subroot", "root", mf.siblings_digest(F.col("path")), end, end == F.col("root")).collect()
    return Counter(tuple(r) for r in got)


def plain(docs):
    return [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]


@pytest.mark.parametrize("band", [1, 3, 8])
def test_manifest_equals_brute_force(spark, odd, band):
    if band == 3:
        docs = spark.read.parquet(f"{SF}/documents.parquet")
        assert manifest_rows(docs, band=band) == brute_manifest(plain(docs))
    assert manifest_rows(odd, band=band) == brute_manifest(plain(odd))


def test_manifest_of_one_row_and_of_none(spark, odd, empty):
    assert manifest_rows(empty) == Counter()
    one = odd.filter("doc_id = 1")
    ((row, n),) = manifest_rows(one).items()
    assert n == 1 and row[1] == row[2] == row[3] and row[4] == H() and row[5] == row[3]


def test_manifest_query_finds_what_was_tampered_with(spark):
    from hypnolake.llm.registry import QUERIES

    rows = QUERIES["op13_merkle_manifest"](spark, SF).collect()
    assert len({r.root for r in rows}) == 1
    for r in rows:
        assert r.verified == (zlib.crc32(str(r.doc_id).encode()) % 7 != 0)


# alignment


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    from hypnolake.llm.alignment import left_tokenizer, right_tokenizer, vocabulary

    paths = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
    a = Tokenizer.from_file(paths[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=paths[1])
    bytes_a, bytes_b = left_tokenizer(paths[0])[1], right_tokenizer(paths[1])[1]
    return paths, (lambda t: a.encode(" " + t, add_special_tokens=False).ids, bytes_a), (b.encode, bytes_b)


def brute_alignment(texts, a, b):
    """Per text: the query's columns but the id."""
    made = []
    for t in texts:
        x, y = (a[0](t), b[0](t)) if t else ([], [])
        if not t or any(b"".join(s[i] for i in ids) != (" " + t).encode() for s, ids in ((a[1], x), (b[1], y))):
            made.append(None)
            continue
        spans = []
        for s, ids in ((a[1], x), (b[1], y)):
            ends = np.cumsum([len(s[i]) for i in ids]).tolist()
            spans.append([(i, e - len(s[i]), e) for i, e in zip(ids, ends)])
        cuts = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups, start = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(i) for i, s, e in side if s >= start and e <= c) for side in spans))
            start = c
        links, j = [], 0
        for i, s, e in spans[0]:
            while j and spans[1][j - 1][2] > s:
                j -= 1
            while spans[1][j][2] <= s:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][1] < e:
                links.append((i, spans[1][k][0]))
                k += 1
        made.append((len(x), len(y), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    count = Counter(p for m in made if m for p in set(m[3]))
    top = defaultdict(int)
    for (i, _), n in count.items():
        top[i] = max(top[i], n)
    out = []
    for m in made:
        if m is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            best = sum(count[p] == top[p[0]] for p in m[3])
            out.append((m[0], m[1], m[2], len(m[3]), best, sum(count[p] for p in m[3]), m[4]))
    return out, count, Counter(p for m in made if m for p in m[3])


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_alignment_equals_brute_force(spark, odd, tokenizers):
    from hypnolake.llm import alignment as al

    paths, a, b = tokenizers
    for docs in (spark.read.parquet(f"{SF}/documents.parquet"), odd):
        rows = docs.select("doc_id", "text").collect()
        want, count, links = brute_alignment([r.text for r in rows], a, b)
        got = al.align(docs, *paths).collect()
        assert Counter((r.doc_id, *[r[c] for c in COLUMNS]) for r in got) == Counter((r.doc_id, *w) for r, w in zip(rows, want))
        pairs = al.pair_counts(al.postings(docs, *paths)).collect()
        assert {(r.left_id, r.right_id): (r.n_docs, r.n_links) for r in pairs} == {p: (count[p], links[p]) for p in count}


def test_alignment_over_many_small_blocks(spark, odd, tokenizers, monkeypatch):
    """Blocks that close early and a memory that is emptied give the same rows (run in this process, block by block)."""
    import pyarrow as pa

    from hypnolake.llm import alignment as al

    paths, a, b = tokenizers
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60).collect() + odd.select("doc_id", "text").collect()

    class Context:
        partitionId = staticmethod(lambda: 3)

    monkeypatch.setattr(al.TaskContext, "get", lambda: Context)
    monkeypatch.setattr(al, "BLOCK_DOCS", 7)
    monkeypatch.setattr(al, "MEMO_PIECES", 500)
    batch = pa.RecordBatch.from_arrays([pa.array([r.doc_id for r in rows], pa.int64()), pa.array([r.text or "" for r in rows])], names=["doc_id", "text"])
    monkeypatch.setattr(al, "_spans", lambda texts: ((i, min(i + 3, len(texts))) for i in range(0, len(texts), 3)))
    stored = pa.Table.from_batches(list(al._blocks(*paths)([batch])))
    posts = stored.filter(pa.compute.is_valid(stored["pair"]))
    counted = pa.Table.from_batches(list(al._popcounts(posts.select(["pair", "planes"]).combine_chunks().to_batches())))
    want, count, _ = brute_alignment([r.text for r in rows], a, b)
    got = Counter()
    for p, n in zip(counted["pair"].to_pylist(), counted["n_docs"].to_pylist()):
        got[p >> al.RIGHT_BITS, p & ((1 << al.RIGHT_BITS) - 1)] += n
    assert got == count and len(set(stored["block"].to_pylist())) >= 10


def test_bitmaps_come_back():
    from hypnolake.llm.alignment import pack, unpack

    rng = np.random.default_rng(1)
    sets = [np.flatnonzero(rng.random(5000) < p) for p in (0, 0.001, 0.02, 0.5, 1, 0)] + [np.array([4999])]
    maps = pack(np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets), len(sets), 5000)
    assert max(len(m) for m in maps.to_pylist()) <= 628
    rows, numbers = unpack(maps)
    for i, s in enumerate(sets):
        assert sorted(numbers[rows == i].tolist()) == s.tolist()


def test_alignment_of_an_empty_table(empty, tokenizers):
    from hypnolake.llm.alignment import align

    assert align(empty, *tokenizers[0]).count() == 0


# addresses


def test_rules_and_parts(spark):
    from hypnolake.llm import urls

    cases = [
        ("https://EXAMPLE.org/es/1?x#y", "example.org", "/es/1", "example.org/es/", "block"),
        ("http://a.example.org/en/12", "a.example.org", "/en/12", "example.org/en/1", "block"),
        ("http://a.example.org/en/2", "a.example.org", "/en/2", "org/", "allow"),
        ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
        ("http://example.org", "example.org", "", None, "allow"),
        ("http://x.com?a=/de/", "x.com", "", None, "allow"),
        ("x://a.com/de/", "a.com", "/de/", "com/de/", "block"),
        ("ftp://com/fr/://b.org/", "com", "/fr/://b.org/", "com/fr/", "allow"),
        ("http://a.com:80/de/", "a.com:80", "/de/", None, "allow"),
        ("no address", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"),
        ("http://É.ORG/a", "É.org", "/a", "org/", "allow"), ("://", "", "", None, "allow"),
    ]
    rows = spark.createDataFrame([(i, c[0], None) for i, c in enumerate(cases)] * 2, "page_id long, url string, bad int").withColumn("host", F.lit("clash"))
    got = urls.judge(rows).collect()
    assert len(got) == 2 * len(cases)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == cases[r.page_id][1:], cases[r.page_id]


def test_templates_tell_bad_branches(spark):
    """Ids become wildcards, like sections merge, a section of bad pages is rejected with its unlabelled pages, and only on its host."""
    from hypnolake.llm import urls

    rows = []
    for i in range(400):
        section = ("news", "blog", "deals", "about")[i % 4]
        tail = f"{i}.html" if section != "about" else "team/" + ("x" * 40)
        bad = None if i % 8 >= 4 else int(section == "deals")
        rows.append((i, f"http://shop.net/{section}/{tail}", bad))
        rows.append((1000 + i, f"http://other.net/{section}/{tail}", None if bad is None else 0))
    pages = spark.createDataFrame(rows, "page_id long, url string, bad int")
    got = {r.page_id: r for r in urls.judge(pages).collect()}
    assert {r.template for r in got.values() if r.host == "shop.net"} == {"/?(blog|news)/?n.html", "/deals/?n.html", "/about/team/" + "x" * 40}
    assert {i for i, r in got.items() if r.verdict == "block"} == {i for i in range(400) if i % 4 == 2}
    assert {r.template for r in got.values() if r.host == "other.net"} == {"/?(blog|deals|news)/?n.html", "/about/team/" + "x" * 40}


def test_deep_and_odd_paths(spark):
    from hypnolake.llm import urls

    paths = ["/" + "/".join(["a"] * 3000), "//x//", "/?q", "/a/b/c/d/e/f/g.html", "/1/deadbeef99/a1.tar/..", "/" + "é" * 5000]
    rows = spark.createDataFrame([(i, "http://h" + p, None) for i, p in enumerate(paths)], "page_id long, url string, bad int")
    got = {r.page_id: r.template for r in urls.judge(rows).collect()}
    assert got == {0: "/?w/?w/?w/?w/?w/?t", 1: "//?w//", 2: "/", 3: "/?w/?w/?w/?w/?w/?t.html", 4: "/?n/?h/?a.tar/?w", 5: "/?w"}
    assert urls.judge(rows.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op11_url_templates", "op13_merkle_manifest"])
def test_equals_sql(spark, name):
    import oracle_check

    msg, _, ok = oracle_check.compare(spark, oracle_check.duck(SF), name, SF)
    assert ok, msg


def test_url_sql_on_busy_hosts(spark, tmp_path):
    """Kept and merged segments: a table of few hosts, so that the SQL meets them too."""
    import duckdb

    from hypnolake.llm import urls

    pages, labels = [], []
    for i in range(1500):
        host = "www.Hot.example.net" if i % 3 else f"h{i % 5}.com"
        section = ["en", "fr", "de", "shop", "2019", "v2"][i * 7 % 6]
        pages.append((i, f"https://{host}/{section}/{['a', 'b'][i % 2]}/{i}{['', '/', '.html', '?p=1'][i % 4]}", "x"))
        if i % 3 != 1:
            labels.append((i, int(section != "shop" and i % 5 > 0), int(section == "shop" and i % 4 == 0)))
    pages += [(5000, None, None), (5001, "x", None), (5002, "http://h/" + "s/" * 50, None), (5002, "http://h/" + "s/" * 50, None)]
    p = spark.createDataFrame(pages, PAGES)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = urls.judge(urls.labelled_pages(p, lab)).withColumn("bad_rate", F.round("bad_rate", 6))
    p.toPandas().to_parquet(tmp_path / "pages.parquet")
    lab.toPandas().to_parquet(tmp_path / "labels.parquet")
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    want = con.execute(urls.SQL)
    names = [d[0] for d in want.description]
    want = want.fetchall()
    assert Counter(tuple(r[c] for c in names) for r in got.collect()) == Counter(want)
    templates = {r[names.index("template")] for r in want}
    assert any("?(" in t for t in templates) and any(t.startswith("/shop/") for t in templates) and {r[names.index("verdict")] for r in want} == {"allow", "block"}
