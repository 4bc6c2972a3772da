"""Packing, BPE, chat, SimHash, licences and quality rules on small tables, against brute force."""

import hashlib
import re
import struct
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import Row
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank and long texts, ties, repeated rows, clashing extra columns."""
    rows = [
        (1, "Hello  WORLD <|endoftext|> don't", "en", "a", 5), (2, None, None, None, None), (3, "", "en", "a", 0), (4, " \t\n ", "en", "b", 4),
        (5, "word " * 5000, "en", "a", 25000), (5, "word " * 5000, "en", "a", 25000), (None, "no id here", "en", "b", 10), (None, None, None, None, None),
        (6, "ÀB Σς ① ﬁ it's 123 45,6!!  __a \x1c\x85 x", "fr", "c", 9), (7, "Released under the MIT License.\nmore text", "en", "a", 1),
    ]
    df = spark.createDataFrame(rows, DOCS)
    for c in ("kept", "fp", "component_id", "start", "length", "host", "words", "row", "key", "label"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def path():
    from hypnolake.llm.packing import tokenizer_path

    return tokenizer_path()


@pytest.fixture(scope="module")
def library(path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


# packing


def test_encoder_learns_words_together(path, library, monkeypatch):
    """New words are encoded many at a time: letters that lower case makes two, marks, digits and a full memory change no id."""
    from hypnolake.llm import packing

    texts = ["Hello  WORLD <|endoftext|> don't", "", "İstanbul İİ ŉ ǰ ẞ ΐ straße ΣΑΣ e\u0301t\u00e9", "日本語 テスト 🙂 naïve", "a1 1a -- x", "word " * 50]
    texts += [" ".join(f"{a}{b}{c}" for a in "abcdefgh" for b in "éßxyz" for c in "qrst")]
    monkeypatch.setattr(packing, "WORDS_AT_ONCE", 7)
    monkeypatch.setattr(packing, "MEMO_WORDS", 20)
    packing._encoder.cache_clear()
    encode = packing._encoder(path)
    for _ in range(2):
        for text, ids in zip(texts, encode(texts), strict=True):
            assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == ids_of(library, text)
        for text in texts:
            assert next(iter(encode([text]))) == struct.pack(f"<{len(ids_of(library, text))}I", *ids_of(library, text))
    packing._encoder.cache_clear()


def check_pieces(pieces, texts, library, window=2048):
    """Every id in one piece, sequences gapless, full or a power of two."""
    docs, seqs = {}, {}
    for p in pieces:
        docs.setdefault((p.doc_id, p.doc_tokens), []).append(p)
        seqs.setdefault(p.sequence_id, []).append(p)
    want = {}
    for doc, text in texts:
        ids = [*ids_of(library, text), 1]
        want.setdefault((doc, len(ids)), []).append(ids)
    assert docs.keys() == want.keys()
    for key, found in docs.items():
        found.sort(key=lambda p: p.start)
        joined = b"".join(bytes(p.ids) for p in found)
        assert sorted(p.length for p in found) and sum(p.length for p in found) == key[1] * len(want[key])
        if len(want[key]) == 1:
            assert joined == struct.pack(f"<{key[1]}I", *want[key][0])
            assert [p.start for p in found] == list(np.cumsum([0, *(p.length for p in found[:-1])]))
    for found in seqs.values():
        found.sort(key=lambda p: p.offset)
        size = sum(p.length for p in found)
        assert [p.offset for p in found] == list(np.cumsum([0, *(p.length for p in found[:-1])]))
        assert size == window or size & (size - 1) == 0 and size < window


def test_packing_odd_rows(odd, path, library):
    from hypnolake.llm.packing import pack

    pieces = pack(odd.coalesce(2), path).collect()
    check_pieces(pieces, [(r.doc_id, r.text) for r in odd.collect()], library)


def test_packing_whole_table(spark, library, path):
    from hypnolake.llm.packing import pack

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check_pieces(pack(docs, path, pool=16).collect(), [(r.doc_id, r.text) for r in docs.collect()], library)


def test_packing_holds_as_many_words_as_asked(spark, library, path):
    """Fewer words held, the same pieces."""
    from hypnolake.llm.packing import _encoder, pack

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check_pieces(pack(docs.coalesce(1), path, memo_words=50).collect(), rows, library)
    encode, most = _encoder(path, 50), 0
    for _, text in rows:
        words = set(text.split())
        list(encode([text]))
        held = [c.cell_contents for c in encode.__closure__ if isinstance(c.cell_contents, dict)]
        most = max(most, max(map(len, held)) - 50 - sum(map(len, words)))
    assert most <= 0 and len(set(" ".join(t for _, t in rows).split())) > 500


def test_packing_empty(empty, path):
    from hypnolake.llm.packing import pack

    assert pack(empty, path).collect() == []


def test_closest_fill_is_best_subset():
    from itertools import combinations

    from hypnolake.llm.packing import closest_fill

    rng = np.random.default_rng(1)
    for _ in range(200):
        sizes = rng.integers(1, 30, rng.integers(1, 9)).tolist()
        room = int(rng.integers(0, 60))
        counts = {s: sizes.count(s) for s in sizes}
        best = max(sum(c) for n in range(len(sizes) + 1) for c in combinations(sizes, n) if sum(c) <= room)
        got = closest_fill(sorted(counts), counts, room)
        assert all(n <= counts[s] for s, n in got.items()) and sum(s * n for s, n in got.items()) == best


def test_op1_digests(spark, library):
    from hypnolake.llm.packing import op1_packing

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for p in op1_packing(spark, SF).collect()[:200]:
        ids = [*ids_of(library, texts[p.doc_id]), 1][p.start : p.start + p.length]
        assert p.ids_crc32 == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


# BPE


def test_bpe_equals_library(spark, odd, path, library):
    from hypnolake.llm.bpe import encode_decode

    rng = np.random.default_rng(2)
    letters = list("aaabbcceétß'sSİK̇ \x1c\x85ÀçΣς1٣<|>!?,.中😀")
    texts = ["".join(rng.choice(letters, rng.integers(0, 40))) for _ in range(400)] + ["a" * 400, "thththth" * 60, "<|endoftext|>x<|ENDOFTEXT|>", "<|startoftext|> "]
    texts += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for df in (docs, odd):
        want = sorted((str(r.doc_id), ids_of(library, r.text)) for r in df.collect())
        got = encode_decode(df, path).collect()
        assert sorted((str(r.doc_id), list(struct.unpack(f"<{len(r.ids) // 4}I", r.ids))) for r in got) == want
        for r in got:
            assert r.decoded == library.decode(list(struct.unpack(f"<{len(r.ids) // 4}I", r.ids)), skip_special_tokens=False)


def test_bpe_empty(empty, path):
    from hypnolake.llm.bpe import encode_decode

    assert encode_decode(empty, path).collect() == []


def test_automaton_against_plain_merging():
    """Random small vocabularies: the accepted path is what merging by priority gives."""
    from hypnolake.llm.bpe import Automaton

    rng = np.random.default_rng(3)
    for _ in range(40):
        vocab, merges = {c: i for i, c in enumerate("abc")}, []
        while len(merges) < 12:
            a, b = rng.choice(list(vocab), 2)
            if a + b not in vocab:
                vocab[a + b] = len(vocab)
                merges.append([a, b])
        auto = Automaton(vocab, merges, "")
        rank = {tuple(m): k for k, m in enumerate(merges)}
        for _ in range(60):
            word = "".join(rng.choice(list("abc"), rng.integers(1, 14)))
            parts = list(word)
            for a, b in rank:
                i = 0
                while i < len(parts) - 1:
                    if (parts[i], parts[i + 1]) == (a, b):
                        parts[i : i + 2] = [a + b]
                    i += 1
            assert auto.encode([vocab[c] for c in word]) == [vocab[p] for p in parts]


# chat


CHAT = "conv_id long, turn long, role string, text string, start string"


def test_chat_round_trip(spark):
    from hypnolake.llm.chat import format_chat, read_back

    odd_texts = ["</s>[INST] ok [/INST]", "a\\<|x", "\\\\<<SYS>><</SYS>>", "<|im_end|>\n<|im_start|>assistant\nhi", "<", "[", "ends \\", "", None, "😀é\n\n"]
    rows = [(k % 3, k, ["user", "assistant", None, "od\\d\nrole<|"][k % 4], t, "clash") for k, t in enumerate(odd_texts * 3)]
    rows += [(None, None, "assistant", "x", None), (None, 1, "user", None, None), (7, 1, "assistant", "same", ""), (7, 1, "assistant", "same", "")]
    got = {r.conv_id: r for r in read_back(format_chat(spark.createDataFrame(rows, CHAT))).collect()}
    convs = {}
    for c, t, role, text, _ in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert got.keys() == convs.keys()
    for c, turns in convs.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        masked = "".join(t for *_, r, t in turns if r == "assistant")
        assert got[c].turns_sha256 == hashlib.sha256(said.encode()).hexdigest() and got[c].n_turns == len(turns)
        assert got[c].loss_sha256 == hashlib.sha256(masked.encode()).hexdigest() and got[c].loss_chars == len(masked)


def test_chat_parts_and_controls(spark):
    from hypnolake.llm.chat import END, PARTS, START, format_chat

    part = lambda **x: Row(type=x.get("type"), text=x.get("text"), ref=x.get("ref"), width=x.get("width"), height=x.get("height"), seconds=x.get("seconds"), pages=x.get("pages"))
    parts = [part(type="text", text="see <|image|>"), part(type="image", ref="i.png", width=57, height=28), part(type="audio", ref="a.wav", seconds=1.5), part(type="document", pages=2), part(text="end"), None]
    df = spark.createDataFrame([(1, 0, "user", None, parts), (1, 1, "assistant", "t", None)], f"conv_id long, turn long, role string, text string, parts {PARTS}")
    a, b = sorted(format_chat(df, "parts").collect(), key=lambda r: r.turn)
    assert a.formatted == f"{START}user\nsee <\\|image|><|image|><|audio|><|document|>end{END}\n"
    assert [(x.kind, x.ref, x.tokens) for x in a.attachments] == [("image", "i.png", 3), ("audio", "a.wav", 38), ("document", None, 512)]
    whole = a.formatted + b.formatted
    assert [whole[x.position :].startswith(f"<|{x.kind}|>") for x in a.attachments] == [True] * 3
    assert whole[b.loss_start : b.loss_start + b.loss_chars] == "t"
    assert format_chat(df.limit(0), "parts").collect() == []


# SimHash


def brute_fingerprint(text):
    words = WORD.findall(ascii_lower(text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, ids, radius=3):
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    label = np.array(ids)
    while True:
        low = np.where(near, label[None, :], 1 << 60).min(axis=1)
        if (low == label).all():
            return label.tolist()
        label = low


def test_simhash_table_and_odd_rows(spark, odd):
    from hypnolake.llm.simhash import near_duplicates

    base = " ".join(f"w{k}" for k in range(400))
    near = [(100 + k, base + " x" * (k % 4), None, None, None) for k in range(12)]
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(spark.createDataFrame(near, DOCS).withColumn("doc_id", F.col("doc_id") + 10_000))
    for df in (docs, odd):
        got = near_duplicates(df).collect()
        known = [r for r in df.collect() if r.doc_id is not None]
        fps = np.array([brute_fingerprint(r.text) for r in known], np.uint64)
        want = sorted(zip((r.doc_id for r in known), fps.tolist(), brute_components(fps, [r.doc_id for r in known])))
        assert sorted((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in got if r.doc_id is not None) == want
        assert len(got) == df.count()


@pytest.mark.parametrize("bucket", [512, 3])
def test_covering_links_dense(spark, bucket):
    """Dense clouds of fingerprints, with buckets that must be split as well."""
    from hypnolake.llm.graph import components
    from hypnolake.llm.simhash import near_links

    rng = np.random.default_rng(4)
    fps = set()
    for centre in rng.integers(0, 2**63, 3).tolist():
        for _ in range(60):
            flipped = centre
            for k in rng.choice(64, rng.integers(0, 7), replace=False).tolist():
                flipped ^= 1 << k
            fps.add(flipped)
    fps = np.array(sorted(fps), np.uint64)
    rows = [(int(f.astype(np.int64)), k) for k, f in enumerate(fps)]
    label = {r.node: r.component for r in components(near_links(spark.createDataFrame(rows, "fp long, u long"), bucket=bucket)).collect()}
    assert [label.get(k, k) for k in range(len(fps))] == brute_components(fps, list(range(len(fps))))


def test_covering_masks_cover():
    from itertools import combinations

    from hypnolake.llm.simhash import covering_masks

    for free in (2**64 - 1, 0b1011011110001111010):
        places = [i for i in range(64) if free >> i & 1]
        masks = [m & (2**64 - 1) for m in covering_masks(free)]
        for three in combinations(places[::2] if len(places) > 40 else places, 3):
            assert any(not m & sum(1 << i for i in three) for m in masks)


def test_simhash_keep_one(odd, empty):
    from hypnolake.llm.simhash import keep_one, near_duplicates

    kept = keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({r.component_id for r in near_duplicates(odd).collect() if r.doc_id is not None})
    assert ids.count(None) == 2
    assert keep_one(empty).collect() == [] and near_duplicates(empty).collect() == []


def test_near_copies_by_likeness(spark, odd, empty, monkeypatch):
    """All pairs of five-word Jaccard 0.8 and more are linked, by brute force; 3 bits of SimHash miss most of these."""
    import corpus_pipeline as pipe
    from hypnolake.llm import copies

    rng = np.random.default_rng(8)
    rows = []
    for g in range(12):
        base = [f"g{g}w{k}" for k in rng.integers(0, 400, 300)]
        for c in range(8):
            edited = list(base)
            for at in rng.choice(300, c, replace=False):
                edited[at] = f"e{g}x{c}x{at}"
            rows.append((len(rows), " ".join(edited), "en", "a", 0))
    sets = [{tuple(r[1].split()[i : i + 5]) for i in range(296)} for r in rows]
    label = list(range(len(rows)))
    while True:
        low = [min(label[j] for j in range(len(rows)) if len(s & sets[j]) >= 0.8 * len(s | sets[j])) for s in sets]
        if low == label:
            break
        label = low
    docs = spark.createDataFrame(rows, DOCS)
    for bucket in (64, 2):
        monkeypatch.setattr(copies, "BUCKET", bucket)
        got = {r.doc_id: r.component_id for r in copies.near_copies(docs).collect()}
        assert [got[k] for k in range(len(rows))] == label
    assert sorted(r.doc_id for r in pipe.distinct(spark, docs, SF).collect()) == sorted(set(label))
    ids = [r.doc_id for r in copies.keep_one(odd).collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 5, 6, 7] and ids.count(None) == 2 and copies.keep_one(empty).collect() == []


def test_pair_rows_stay_in_proportion(spark, monkeypatch):
    """Texts that share buckets and lie under 0.8 of each other: as many pairs as members times bands at most, and brute force's components."""
    from hypnolake.llm import copies

    rng = np.random.default_rng(9)
    base = [f"w{k}" for k in range(400)]
    rows = []
    for c in range(150):
        edited = list(base)
        for at in rng.choice(400, 10, replace=False):
            edited[at] = f"x{c}y{at}"
        rows.append((c, " ".join(edited), "en", "a", 0))
    rows += [(200, rows[7][1] + " more", "en", "a", 0), (201, rows[7][1] + " more words", "en", "a", 0)]
    sets = {r[0]: copies.shingles(r[1]) for r in rows}
    label = {k: min(j for j in sets if copies.likeness(sets[k], sets[j]) >= 0.8) for k in sets}
    while label != (low := {k: min(label[j] for j in sets if copies.likeness(sets[k], sets[j]) >= 0.8) for k in sets}):
        label = low
    assert len(set(label.values())) > 100
    seen, checked = [], copies._checked
    monkeypatch.setattr(copies, "_checked", lambda pairs, docs: (seen.append(pairs.count()), checked(pairs, docs))[1])
    docs = spark.createDataFrame(rows, DOCS)
    for bucket in (64, 512):
        monkeypatch.setattr(copies, "BUCKET", bucket)
        seen.clear()
        assert {r.doc_id: r.component_id for r in copies.near_copies(docs).collect()} == label
        assert sum(seen) <= len(rows) * copies.BANDS


def test_near_duplicates_stage_runs_simhash(spark, monkeypatch):
    """The stage asks the SimHash operator; of its classes those stay whose texts are alike."""
    import corpus_pipeline as pipe
    from hypnolake.llm import copies, simhash

    rows = [(1, "a b c d e f g h i j k l", "en", "a", 0), (2, "a b c d e f g h i j k l m", "en", "a", 0), (3, "n o p q r s t u", "en", "a", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    asked = []
    found = spark.createDataFrame([(1, 0, 1), (2, 0, 1), (3, 0, 1)], "doc_id long, fp long, component_id long")
    monkeypatch.setattr(simhash, "near_duplicates", lambda d: asked.append(1) or found)
    monkeypatch.setattr(copies, "_proposed", lambda rows: rows.select("u", rows.u.alias("v")).limit(0))
    monkeypatch.setattr(copies, "_open", lambda rows, label: rows.selectExpr("key", "band", "u", "u AS comp").limit(0))
    assert sorted(r.doc_id for r in pipe.distinct(spark, docs, SF).collect()) == [1, 3] and asked


@pytest.mark.parametrize("forests", [True, False])
@pytest.mark.parametrize("bucket", [512, 2])
def test_all_members_of_a_class_meet(spark, monkeypatch, forests, bucket):
    """Two members of a class are alike, share no band of minima, and are both unlike the class's least one."""
    from hypnolake.llm import copies

    words = [f"k23681w{i}" for i in range(9)]
    rows = [(1, "p q r s t u v w"), (2, " ".join(words)), (4, " ".join(words[:8])), (3, " ".join(words[:8])), (5, "n o p q r s t")]
    two = [copies.shingles(t) for t in (rows[1][1], rows[2][1])]
    assert copies.likeness(*two) == 0.8 and not set(copies.keys(two[0])) & set(copies.keys(two[1]))
    monkeypatch.setattr(copies, "BUCKET", bucket)
    if not forests:
        monkeypatch.setattr(copies, "_proposed", lambda rows: rows.select("u", rows.u.alias("v")).limit(0))
    found = spark.createDataFrame([(1, 1), (2, 1), (4, 1), (3, 3), (5, 1)], "doc_id long, component_id long")
    got = {r.doc_id: r.component_id for r in copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), found).collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: 2, 5: 5}


def test_a_pair_is_met_in_a_band_it_shares():
    """The minima of band 0 differ in one number, whose last byte is the same: the pair has no bucket there and is met in band 1."""
    from hypnolake.llm import copies

    a = np.random.default_rng(4).integers(1, 2**63, copies.BANDS * copies.ROWS, dtype=np.uint64)
    b = a.copy()
    b[2] += np.uint64(256 * 77)
    assert [x == y for x, y in zip(copies._band_keys(a), copies._band_keys(b))][:2] == [False, True]
    sketch = np.array([copies._sketch(a), copies._sketch(b)])
    assert [copies._alike(0, np.array([1]), sketch, band).tolist() for band in (0, 1, 2)] == [[], [1], []]


# licences


def brute_scan(text):
    from hypnolake.llm.licences import PHRASES, TEMPLATES, THRESHOLD, template_words

    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    text = ascii_lower(text or "")
    words = word.findall(text)
    places = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    labels, share = {x for _, x in places}, 0.0
    for line in text.split("\n"):
        held = set(word.findall(line))
        met = [(label, set(tokens)) for _, label, tokens, need in template_words(TEMPLATES, THRESHOLD) if len(held & set(tokens)) >= need]
        for label, tokens in met:
            # of two nested notices the longer counts if a word that it adds stands there, else the shorter
            if not any(tokens < o and held & (o - tokens) or o < tokens and not held & (tokens - o) for _, o in met):
                labels.add(label)
                share = max(share, len(held & set(tokens)) / len(tokens))
    starts = [i for i, _ in places]
    return (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})), ",".join(sorted(labels)), 1.0 if places else share)


def test_licences(spark, odd, empty):
    from hypnolake.llm.licences import TEMPLATES, scan

    texts = [t for _, t in TEMPLATES] + ["MIT LICENSE, mit-license Apache License\nthe general public license", "mit\nlicense", "license", "Licensed under CC BY-NC 4.0 today", "İMIT license"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    for df in (docs, odd):
        want = sorted(((str(r.doc_id), *brute_scan(r.text)) for r in df.collect()), key=str)
        assert sorted(((str(r.doc_id), *r[1:]) for r in scan(df).collect()), key=str) == want
    got = {r.doc_id: r.labels for r in scan(docs).collect()}
    assert {got[k] for k, t in enumerate(texts) if "BY-NC" in t} == {"cc-by-nc"} and [got[k] for k, t in enumerate(texts) if "BY-SA" in t] == ["cc-by-sa"]
    assert [got[k] for k, (_, t) in enumerate(TEMPLATES) if "CC BY 4" in t or "Attribution 4" in t] == ["cc-by", "cc-by"]
    assert scan(empty).collect() == []


# quality rules


def brute_measures(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    spans = {}
    for i in range(len(words) - 7):
        spans.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + j for at in spans.values() if len(at) > 1 for i in at for j in range(8)}
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


def test_hosts(spark, odd, empty):
    from hypnolake.llm.hosts import judge, keep_good

    good = " ".join(f"w{k}" for k in range(40))
    extra = [(200 + k, f"{good} {k}" if k % 10 else "short", "en", "good" if k < 60 else "bad", 1) for k in range(80)]
    extra += [(300 + k, "too short", "en", "bad", 1) for k in range(100)] + [(400, "a b\na b\n\na b " + "r s t u v w x y " * 3, None, None, 0)]
    df = odd.select(*empty.columns).unionByName(spark.createDataFrame(extra, DOCS))
    got = judge(df).collect()
    measured = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted((str(r.doc_id), *(r[c] for c in measured)) for r in got) == sorted((str(r.doc_id), *brute_measures(r.text)) for r in df.collect())
    kept = {r.doc_id for r in got if r.kept}
    assert all(not r.kept for r in got if r.base_failed) and kept >= {201, 203} and not kept & {261, 263}  # the bad host takes its good rows along
    rows = keep_good(df)
    assert rows.columns == df.columns and {r.doc_id for r in rows.collect()} == kept
    assert judge(empty).collect() == [] and keep_good(odd).columns == odd.columns


def test_host_prior(spark):
    from hypnolake.llm.hosts import host_verdicts

    counts = {"a": (100, 10), "b": (50, 25), "c": (4, 4), None: (10, 0)}
    rows = [(h, k < bad) for h, (n, bad) in counts.items() for k in range(n)]
    got = {r.host: r for r in host_verdicts(spark.createDataFrame(rows, "host string, base_failed boolean")).collect()}
    raw = np.array([bad / n for n, bad in counts.values()])
    m, v = raw.mean(), raw.var(ddof=1)
    s = max(m * (1 - m) / (v - m * (1 - m) * np.mean([1 / n for n, _ in counts.values()])) - 1, 0)
    for h, (n, bad) in counts.items():
        assert got[h].rate == pytest.approx((bad + m * s) / (n + s))
