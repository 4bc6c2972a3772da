"""Toxicity, mixing, sampling, pages and the pipeline on small tables, against brute force and held-out accuracy."""

import hashlib
import html
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

SF, SF2 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (1, "Hello  WORLD again", "en", "a", 5), (2, None, None, None, None), (3, "", "en", "a", 0), (4, " \t\n ", "en", "b", 4),
        (5, "word " * 5000, "en", "a", 25000), (5, "word " * 5000, "en", "a", 25000), (None, "no id here", "en", "b", 10), (None, None, None, None, None),
        (6, "ÀB Σς ① ﬁ it's 123", "fr", "c", 9), (7, "x y z", "en", "a", 1), (7, "other text of the same id", "en", "a", 1),
    ]
    df = spark.createDataFrame(rows, DOCS)
    for c in ("severity", "toxic", "fp", "key", "side", "word", "row", "c", "score", "logs", "host"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# toxicity


def test_cumulative_link_recovers_a_known_model():
    from hypnolake.llm.toxicity import Sparse, fit_cumulative_link

    rng = np.random.default_rng(0)
    w, theta = np.array([1.5, -1.0, 0.0]), np.array([-0.5, 1.0, 2.0])
    x = rng.normal(size=(20_000, 3))
    y = ((x @ w + rng.logistic(size=20_000))[:, None] > theta[None, :]).sum(axis=1)
    got_w, got_theta = fit_cumulative_link(Sparse(*np.nonzero(x), x[np.nonzero(x)], x.shape), y)
    assert np.abs(got_w - w).max() < 0.08 and np.abs(got_theta - theta).max() < 0.08 and (np.diff(got_theta) > 0).all()


def test_best_cut():
    from hypnolake.llm.toxicity import best_cut

    p, toxic = np.array([0.9, 0.4, 0.3, 0.3, 0.1, 0.05]), np.array([True, True, False, True, False, False])
    assert 0.3 < best_cut(p, toxic) < 0.4


def test_toxicity_held_out(spark):
    from hypnolake.llm.toxicity import fit, keep_clean, score

    docs, labels = spark.read.parquet(f"{SF2}/documents.parquet"), spark.read.parquet(f"{SF2}/labels.parquet")
    model = fit(docs, labels.filter("doc_id % 2 = 0"))
    truth = {r.doc_id: r.toxic for r in labels.filter("doc_id % 2 = 1").collect()}
    got = score(docs, model).collect()
    said = {r.doc_id: r.toxic for r in got}
    assert np.mean([said[d] for d, t in truth.items() if not t]) < 0.02 and np.mean([said[d] for d, t in truth.items() if t]) > 0.55
    assert all(0 <= r.severity <= 3 for r in got) and list(model.thresholds) == sorted(model.thresholds)
    kept = keep_clean(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, t in said.items() if not t}


def test_toxicity_odd_rows(spark, odd, empty):
    from hypnolake.llm.toxicity import SeverityModel, fit, keep_clean, score

    labels = "doc_id long, quality int, toxic int"
    assert fit(odd, spark.createDataFrame([], labels)) == SeverityModel() == fit(empty, spark.createDataFrame([(1, 1, 1), (None, 1, 0), (2, 0, None)], labels))
    model = SeverityModel({"word": 5.0}, (2.0, 3.0, 4.0))
    got = score(odd, model).collect()
    assert len(got) == odd.count() and {r.doc_id for r in got if r.toxic} == {5}
    rows = keep_clean(odd, model)
    assert rows.columns == odd.columns and rows.count() == odd.count() - 2
    assert score(empty, model).collect() == [] and keep_clean(empty, model).collect() == []


# mixing


def test_mixing_base_and_model(spark):
    from hypnolake.llm.mixing import score

    docs = spark.read.parquet(f"{SF2}/documents.parquet")
    texts = {r.doc_id: r.text.encode().lower().split() + [b""] for r in docs.collect()}
    c = Counter(w for d, t in texts.items() if zlib.crc32(str(d).encode()) % 5 != 1 for w in t)
    n, v = sum(c.values()), len(c)
    got = score(docs, most_frequent=5000, coded=1000).collect()
    for r in got:
        t = texts[r.doc_id]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), rel=1e-9)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # better than counts on texts it has not seen
    assert all(r.score <= 0 and r.bits_per_byte >= 0 for r in got)


def test_mixer_is_a_distribution():
    """Over all symbols the probabilities after any context sum to one."""
    from hypnolake.llm.mixing import CONFIDENCE, CONTEXTS, GATES, Speller, inputs, log_odds, mix

    rng = np.random.default_rng(5)
    speller = Speller([(b"a", 9), (b"b", 4), (b"c", 1)], 2, 3, 8)
    odds = log_odds(rng.integers(0, 9, speller.size).astype(float), rng.integers(0, 9, speller.size).astype(float), 3.0)
    total = 0.0
    for symbol in range(5):
        slots, bit, gate = speller.spell(np.array([symbol]), (0, speller.start))
        total += math.exp(-mix(inputs(odds, slots, bit), gate, np.ones((CONTEXTS, GATES)), np.ones(CONFIDENCE)))
    assert total == pytest.approx(1.0, abs=1e-6)


def test_mixer_learns_in_small_blocks():
    """The bounds of a mixer that is updated every 1,024 bits."""
    from hypnolake.llm.mixing import CONFIDENCE, CONTEXTS, GATES, mix

    x = np.tile(np.array([[0.5], [0.0], [0.0]], np.float32), (1, 20_000))
    late = mix(x, np.zeros(x.shape[1], np.int64), w := np.ones((CONTEXTS, GATES)), s := np.ones(CONFIDENCE)) / x.shape[1]
    assert late < math.log1p(math.exp(-0.5)) * 0.85 and w[0, 0] > 1.5 and s[0] > 1


def test_mixing_spells_words_beyond_the_first_thousands(spark):
    """Of 6,000 words each foretells the next, so no word may be a mere share of the rare ones."""
    from hypnolake.llm.mixing import score

    ring = " ".join(f"w{k}" for k in np.random.default_rng(3).permutation(6000))
    docs = spark.createDataFrame([(k, ring) for k in range(40)], "doc_id long, text string")
    held = [r for r in score(docs).collect() if r.held_out]
    assert held and all(r.score / r.n_tokens > -0.6 for r in held)


def test_mixing_segments_do_not_matter(spark, odd, empty, monkeypatch):
    from hypnolake.llm import mixing

    got = mixing.score(odd, table_bits=12).collect()
    assert len(got) == odd.count() and all(r.n_tokens >= 1 for r in got)
    same = [r for r in got if r.n_tokens == 5001]
    assert len(same) == 2 and same[0] == same[1]
    none = mixing.score(odd.filter("doc_id IS NULL"), table_bits=12).collect()
    assert sorted(r.n_tokens for r in none) == [1, 4]
    assert mixing.score(empty, table_bits=12).collect() == []


def test_mixer_takes_texts_side_by_side():
    """Texts of a group get what each gets alone, block by block."""
    from hypnolake.llm.mixing import BLOCK, CONFIDENCE, CONTEXTS, GATES, mix, mix_texts

    rng = np.random.default_rng(4)
    sizes = np.array([5, 3 * BLOCK, 1, BLOCK + 7, *rng.integers(1, 4000, 40)])
    x = rng.normal(0.5, 2, (CONTEXTS, sizes.sum())).astype(np.float32)
    gate = rng.integers(0, GATES, sizes.sum())
    weights, scale = np.ones((len(sizes), CONTEXTS, GATES)), np.ones((len(sizes), CONFIDENCE))
    got = mix_texts(x, gate, sizes, weights, scale)
    for i, (end, n) in enumerate(zip(np.cumsum(sizes), sizes)):
        part = slice(end - n, end)
        w, s = np.ones((CONTEXTS, GATES)), np.ones(CONFIDENCE)
        assert got[i] == pytest.approx(mix(x[:, part], gate[part], w, s), rel=1e-9)
        assert weights[i] == pytest.approx(w) and scale[i] == pytest.approx(s)


def test_mixing_splits_texts_as_tokens_does():
    import pyarrow as pa

    from hypnolake.llm.mixing import split, tokens

    texts = ["", " ", "  A\x0bb\x1cC c\x85d\xa0E\u0130 ", "x", "\n", "\r\ny\tZ\x0c", "a  b"]
    words, n = split(pa.array(texts))
    assert words.to_pylist() == [w for t in texts for w in tokens(t)] and n.tolist() == [len(tokens(t)) for t in texts]


def test_mixing_groups_and_segments(monkeypatch):
    """A text longer than a segment stays alone; every text lies in one group."""
    from hypnolake.llm import mixing

    monkeypatch.setattr(mixing, "SEGMENT", 10)
    monkeypatch.setattr(mixing, "GROUP", 15)
    got = list(mixing._groups(np.array([3, 4, 12, 5, 10, 30, 1, 1, 1])))
    assert got == [(0, 2), (2, 3), (3, 5), (5, 6), (6, 9)]


def test_huffman_is_prefix_free():
    from hypnolake.llm.mixing import huffman

    first, length, node, bit = huffman([5, 0, 1, 100, 7, 7])
    codes = ["".join(map(str, bit[f : f + n])) for f, n in zip(first, length)]
    assert len(set(codes)) == 6 and sum(2.0 ** -len(c) for c in codes) == 1.0 and all(node[f] == 0 for f in first)


# consistent weighted sampling


def jaccard(a, b):
    x, y = (Counter(w for w in re.split(r"[\x20\x09-\x0D]+", t.lower()) if w) for t in (a, b))
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def test_cws_edits_and_likeness(spark):
    from hypnolake.llm.cws import compare_edits

    rows = spark.read.parquet(f"{SF2}/documents.parquet").orderBy(F.desc("doc_id")).collect()
    got = {r.doc_id: r for r in compare_edits(spark.read.parquet(f"{SF2}/documents.parquet")).collect()}
    off, near, by_text = [], [], {}
    for k, r in enumerate(rows):
        following = rows[(k + 1) % len(rows)].text
        cut = len(r.text) // 3
        edited = r.text[: len(r.text) - cut] + following[:cut]
        g = got[r.doc_id]
        assert g.n_chars == len(r.text) and g.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(r.text, g.fingerprint) == g.fingerprint
        off.append(g.near_edited - jaccard(r.text, edited))
        near.append(g.near_next - jaccard(r.text, following))
    assert abs(np.mean(off)) < 0.01 and abs(np.mean(near)) < 0.01 and np.std(off) < 0.1  # sqrt(.25 / 32) at most, and chance


def test_cws_weights(spark):
    """Collision rates equal the generalised Jaccard similarity of given weights."""
    from hypnolake.llm.cws import sample_key

    a, b = {1: 1.0, 2: 5.0, 3: 20.0, 4: 3.0}, {1: 4.0, 2: 5.0, 3: 7.0, 5: 2.0}
    rows = [(n, s, w, h) for n in range(400) for s, v in (("a", a), ("b", b)) for h, w in ((1000 * n + k, w) for k, w in v.items())]
    df = spark.createDataFrame(rows, "n long, side string, w double, h long").withColumn("h", F.xxhash64("h"))
    least = df.groupBy("n", "side").agg(*(F.min(sample_key(F.col("h"), F.ln("w"), k)).alias(f"s{k}") for k in range(16)))
    sides = {s: {r.n: r for r in least.filter(F.col("side") == s).collect()} for s in "ab"}
    rate = np.mean([sides["a"][n][f"s{k}"] == sides["b"][n][f"s{k}"] for n in range(400) for k in range(16)])
    want = sum(min(a.get(k, 0), b.get(k, 0)) for k in range(6)) / sum(max(a.get(k, 0), b.get(k, 0)) for k in range(6))
    assert rate == pytest.approx(want, abs=0.03)


def test_cws_odd_rows(spark, odd, empty):
    from hypnolake.llm.cws import compare_edits

    got = compare_edits(odd).collect()
    assert len(got) == odd.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[5][0] == by[5][1] and {r.fingerprint for r in by[3] + by[4]} == {""} and by[3][0].near_edited in (0.0, 1.0)
    one = compare_edits(odd.filter("doc_id = 1")).collect()[0]
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(("Hello  WORLD again"[:12] + "Hello ").encode()).hexdigest()
    assert compare_edits(empty).collect() == []


def test_next_in_order(spark):
    from hypnolake.llm.cws import next_in_order

    ids = spark.createDataFrame([(k * 7 % 101 if k else None, k) for k in range(101)], "doc_id long, key long").repartition(5)
    order = sorted(ids.collect(), key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.key))
    want = {a.key: b.key for a, b in zip(order, order[1:] + order[:1])}
    assert {r.key: r.next_key for r in next_in_order(ids).collect()} == want


# pages


def test_pages_table(spark):
    from hypnolake.llm.pages import extract

    got = {r.page_id: r for r in extract(spark.read.parquet(f"{SF2}/pages.parquet")).collect()}
    rows = spark.read.parquet(f"{SF2}/pages.parquet").collect()
    assert len(rows) == len(got)
    for r in rows:
        inner = re.sub(r"</?b>|<br>", " ", re.search(r"<article>(.*)</article>", r.html, re.S)[1])
        want = "\n".join(x for x in (" ".join(html.unescape(y).split()) for y in re.split(r"</?(?:p|h1)>", inner)) if x)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want) and got[r.page_id].url == r.url


FURNITURE = """<header><h1>Site</h1></header><nav>menu<ul><li>a<li>b</ul></nav><div class="cookie-notice">we use</div><aside>side</aside>
<form>f<input></form><script>if (a < b) "<p>no</p>"</script><style>p{}</style><!-- <p>no</p> --><div role="complementary">x</div><p hidden>h</p>"""


@pytest.mark.parametrize("holder", ["article", 'div class="content"', "main"])
def test_pages_furniture(holder):
    from hypnolake.llm.pages import Template, main_text, parse

    body = """<h1>Title &amp; more</h1><p>one<br>two <b>bold</b> <span class="ad">buy</span> end<p>three&nbsp;
      <i>x</i> &#228;&lt;p&gt;<ul><li>x<li>y</ul><table><tr><td>c1<td>c2</table>tail<section id="comments"><p>nice!</section>"""
    page = f'<html><body class="has-sidebar">{FURNITURE}<{holder}>{body}</{holder.split()[0]}><footer>&copy; foot</footer></body></html>'
    assert main_text(parse(page), Template()) == "Title & more\none two bold end\nthree x ä<p>\nx\ny\nc1\nc2\ntail"


def test_pages_odd_rows(spark):
    from hypnolake.llm.pages import extract

    long = "<article>" + "<p>w &amp; x</p>" * 20_000 + "</article>"
    rows = [(1, None, None, "c"), (2, "http://h.x/1", "", "c"), (3, "not a url", "<p>plain", "c"), (3, "not a url", "<p>plain", "c"), (None, "http://h.x/2", "a < b <", "c"), (4, "http://h.x", long, "c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = sorted(extract(df).collect(), key=str)
    assert [(r.page_id, r.text[:9], r.n_chars) for r in got if r.page_id != 4] == sorted(
        [(1, "", 0), (2, "", 0), (3, "plain", 5), (3, "plain", 5), (None, "a < b <", 7)], key=lambda x: str(next(r for r in got if (r.page_id, r.text[:9]) == x[:2]))
    )
    assert next(r for r in got if r.page_id == 4).text == "\n".join(["w & x"] * 20_000)
    assert extract(df.limit(0)).collect() == []


def test_pages_template_finds_the_slot(spark):
    """Without article or main, the host's template gives the element that holds the text, and its own texts are left out."""
    from hypnolake.llm.pages import extract

    page = "<html><body><div id=top>Welcome to our site</div><div class=x><h2>Head {k}</h2><p>{t}</p><p>Read more stories</p></div><div class=z>bottom {k}</div></body></html>"
    rows = [(k, "http://one.example/p", page.format(k=k, t=f"text {k} " * 40)) for k in range(6)] + [(9, "http://one.example/p", page.format(k=0, t="text 0 " * 40))]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Head 3\n" + ("text 3 " * 40).strip() and got[9] == got[0]


# pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline as pipe
    from hypnolake.llm.hosts import judge
    from hypnolake.llm.toxicity import fit, score
    from hypnolake.session import cut_lineage

    def least_of_copies(rows):
        """Least id of every group of texts linked by a five-word Jaccard of 0.8 or more, all pairs compared."""
        sets, owner = {}, {}
        for r in rows:
            words = r.text.encode().lower().split()
            sets[r.doc_id] = {b" ".join(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()
            owner[r.doc_id] = r.doc_id
        find = lambda i: i if owner[i] == i else find(owner[i])
        for i in sets:
            for j in sets:
                a, b = sets[i], sets[j]
                if i < j and (a == b or 5 * len(a & b) >= 4 * len(a | b)):
                    x, y = find(i), find(j)
                    owner[max(x, y)] = min(x, y)
        return sorted(i for i in sets if find(i) == i)

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in pipe.STAGES] == ["quality rules", "toxicity", "near-duplicates", "packing"]
    after = [docs]
    for _, stage in pipe.STAGES:
        after.append(cut_lineage(stage(spark, after[-1], SF)))
    ids = [sorted(r.doc_id for r in d.select("doc_id").distinct().collect()) for d in after]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert ids[1] == sorted(r.doc_id for r in judge(docs).filter("kept").collect())
    assert ids[2] == sorted(r.doc_id for r in score(after[1], fit(after[1], labels)).filter("NOT toxic").collect())
    assert ids[3] == least_of_copies(after[2].collect()) == ids[4]
    assert all(d.columns == docs.columns for d in after[:-1])
    key = lambda r: (r.doc_id, r.start)
    assert sorted((key(r), r.length) for r in pipe.run(spark, SF).collect()) == sorted((key(r), r.length) for r in after[4].collect())


def test_pipeline_odd_rows(spark, odd, empty):
    import corpus_pipeline as pipe

    many = odd.unionByName(odd.withColumn("text", F.lit(" ".join(f"v{k}" for k in range(30)))))
    for docs in (many, empty):
        for _, stage in pipe.STAGES:
            columns, docs = docs.columns, stage(spark, docs, SF)
            assert stage is pipe.packed or docs.columns == columns
        docs.collect()
