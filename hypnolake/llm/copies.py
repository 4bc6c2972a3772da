"""Near copies: texts whose sets of five-word shingles have a Jaccard likeness of ``LIKENESS`` or more.

Candidates come from the caller (the SimHash operator's classes) and from MinHash bands: ``BANDS`` keys of ``ROWS`` minima each, so a pair of likeness
0.8 shares no key with a chance of (1 - 0.8**4)**20, about 3 in 100,000. A class is a bucket like that of a band: all its members meet, not each with the
least one alone. Every link is checked on the texts themselves. Rows with the same shingles are
merged first. No pairs are listed: a bucket proposes the edges of a spanning forest, by the minima that its members share (a byte of each, the sketch);
then members that still lie in different components, and may be alike by their sketches, meet with their texts, and a bucket gives at most one edge a
member. A pair of likeness 0.8 shares fewer than ``SHARED`` of 80 minima with a chance of about 4 in a million. Pairs of a bucket of more than ``BUCKET``
members are dealt over pairs of its parts; nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hypnolake.session import cut_lineage

from .graph import components

LIKENESS = 0.8
SHINGLE = 5
BANDS, ROWS = 20, 4
BUCKET = 512
SHARED = 46
BROADCAST_IDS = 1_000_000
SEED = 42
_FACTORS = np.random.default_rng(SEED).integers(1, 2**63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str) -> np.ndarray:
    """Sorted distinct XXH64 of the shingles; a shorter text is one shingle, none without words."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: len(words) - SHINGLE] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[SHINGLE - 1 :].tolist())], np.uint64))


def minima(found: np.ndarray) -> np.ndarray:
    """The least value of every hash over the shingles."""
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for s in range(0, len(found), 8192):
        mixed = found[None, s : s + 8192] * _FACTORS
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0x9FB21C651E98DF25)
        np.minimum(least, mixed.min(axis=1), out=least)
    return least


def keys(found: np.ndarray) -> list[int]:
    """One signed key per band; none without shingles."""
    return _band_keys(minima(found)) if len(found) else []


def _band_keys(least: np.ndarray) -> list[int]:
    return [xxhash.xxh64_intdigest(b.tobytes(), k) - (1 << 63) for k, b in enumerate(least.reshape(BANDS, ROWS))]


def _sketch(least: np.ndarray) -> np.ndarray:
    """A byte of every minimum, then two of every band: bytes of different minima may be equal, and then the band is not shared."""
    tags = (least.reshape(BANDS, ROWS) * _FACTORS[:ROWS].T).sum(axis=1) >> np.uint64(48)
    return np.concatenate([least.astype("u1"), tags.astype("<u2").view("u1")])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _signed(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, keys, sketch) per row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py()) for t in batch.column(1)]
            digests = [xxhash.xxh128_digest(s.tobytes()) for s in sets]
            least = [minima(s) for s in sets]
            found = [_band_keys(m) if len(s) else [] for s, m in zip(sets, least)]
            columns = [pa.array(digests, pa.binary()), pa.array(found, pa.list_(pa.int64())), pa.array([_sketch(m).tobytes() for m in least], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "digest", "keys", "sketch"])

    return docs.mapInArrow(run, "doc_id long, digest binary, keys array<long>, sketch binary")


def _checked(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The ``pairs`` (u, v) whose texts are alike."""
    ids = cut_lineage(pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct())
    small = ids.count() <= BROADCAST_IDS
    texts = cut_lineage(docs.join(F.broadcast(ids) if small else ids, F.col("doc_id") == F.col("id"), "left_semi"))
    a, b = texts.select(F.col("doc_id").alias("u"), F.col("text").alias("a")), texts.select(F.col("doc_id").alias("v"), F.col("text").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v, left, right = batch.columns
            near = [likeness(shingles(x.as_py()), shingles(y.as_py())) >= LIKENESS for x, y in zip(left, right)]
            yield pa.RecordBatch.from_arrays([u, v], names=["u", "v"]).filter(pa.array(near, pa.bool_()))

    return pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b").mapInArrow(run, "u long, v long").distinct()


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The columns of one key (the first column) after the other, from rows sorted by it: numbers and sketches as arrays, texts as they are."""

    def plain(c: pa.ChunkedArray):
        if pa.types.is_binary(c.type):
            return np.frombuffer(b"".join(c.to_pylist()), "u1").reshape(len(c), -1)
        return c if pa.types.is_string(c.type) else c.to_numpy()

    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        held = rows if held is None else pa.concat_tables([held, rows])
        key = held.column(0).to_numpy()
        cuts = (np.flatnonzero(key[1:] != key[:-1]) + 1).tolist()
        if cuts:
            columns = [plain(c) for c in held.slice(0, cuts[-1]).columns]
            for s, e in zip([0, *cuts], cuts):
                yield tuple(c[s:e] for c in columns)
            held = held.slice(cuts[-1])
    if held is not None and held.num_rows:
        yield tuple(plain(c) for c in held.columns)
    held = None
    pa.default_memory_pool().release_unused()  # the worker goes on to other stages


def _forest(u: np.ndarray, sketch: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest over pairs that share ``SHARED`` minima or more, those that share most first (Prim)."""
    sketch = np.ascontiguousarray(sketch[:, : BANDS * ROWS])
    best, near, open_ = np.full(len(u), SHARED - 1), np.zeros(len(u), "int64"), np.ones(len(u), bool)
    at, out = 0, []
    for _ in range(len(u) - 1):
        open_[at] = False
        shared = np.count_nonzero(sketch == sketch[at], axis=1)
        better = open_ & (shared > best)
        best[better], near[better] = shared[better], at
        at = int(np.argmax(np.where(open_, best, -1)))
        if best[at] >= SHARED and u[near[at]] != u[at]:
            out.append((int(u[near[at]]), int(u[at])))
    return out


def _alike(i: int, among: np.ndarray, sketch: np.ndarray, band: int) -> np.ndarray:
    """Those of ``among`` that share ``SHARED`` minima with ``i``, and this band before any other: a pair is met in one of its buckets.

    Band ``BANDS`` is a class: pairs that share no band are met there.
    """
    same = sketch[among] == sketch[i]
    hit = np.count_nonzero(same[:, : BANDS * ROWS], axis=1) >= SHARED
    among, same = among[hit], same[hit]
    shared = same[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS).all(axis=2) & same[:, BANDS * ROWS :].reshape(-1, BANDS, 2).all(axis=2)
    return among[np.where(shared.any(axis=1), shared.argmax(axis=1), BANDS) == band]


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    u, v = zip(*found)
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _by_key(rows: DataFrame) -> DataFrame:
    return rows.repartition("key").sortWithinPartitions("key")


def _proposed(rows: DataFrame) -> DataFrame:
    """Pairs (u, v) of the forests of all buckets; ``rows``: key, band, u, sketch, n. A part of a wide bucket has a forest of its own."""
    part = F.pmod(F.xxhash64("u"), F.ceil(F.col("n") / BUCKET))
    dealt = _by_key(rows.select(F.when(F.col("n") <= BUCKET, F.col("key")).otherwise(F.xxhash64("key", part)).alias("key"), "u", "sketch"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, u, sketch in _buckets(batches):
            if found := _forest(u, sketch):
                yield _pairs(found)

    return dealt.mapInArrow(run, "u long, v long").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


_ASKED = "key long, band int, u long, comp long"


def _open(rows: DataFrame, label: DataFrame) -> DataFrame:
    """(key, band, u, comp) of the members that may be alike to one of the same bucket and another component."""
    placed = rows.join(label, F.col("u") == F.col("node"), "left").select("key", "band", "u", "sketch", F.coalesce("component", "u").alias("comp"))
    sizes = placed.groupBy("key").agg(F.count("*").alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high")
    parts = F.ceil(F.col("n") / BUCKET)
    mine = F.pmod(F.xxhash64("u"), parts)
    others = F.filter(F.sequence(F.lit(0).cast("long"), parts - 1), lambda q: q != mine)
    twos = F.transform(others, lambda q: F.xxhash64("key", F.least(q, mine), F.greatest(q, mine)))
    groups = F.explode(F.when(F.col("n") <= BUCKET, F.array("key")).otherwise(twos)).alias("key")
    dealt = _by_key(placed.join(sizes.select("key", "n"), "key").select(groups, "band", "u", "comp", "sketch"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, band, u, comp, sketch in _buckets(batches):
            names, at, sizes = np.unique(comp, return_inverse=True, return_counts=True)
            asked = np.zeros(len(u), bool)
            for i in np.flatnonzero(at != sizes.argmax()):  # each pair of two components has a member outside the largest
                got = _alike(i, np.flatnonzero(at != at[i]), sketch, int(band[0]))
                asked[got] = True
                asked[i] |= len(got) > 0
            if asked.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[asked]) for c in (key, band, u, comp)], names=["key", "band", "u", "comp"])

    return dealt.mapInArrow(run, _ASKED).distinct()


def _joined(asked: DataFrame, docs: DataFrame) -> DataFrame:
    """Edges (u, v) between components of the ``asked`` members that have texts alike in one bucket: a forest of each."""
    dealt = _by_key(asked.join(docs.withColumnRenamed("doc_id", "u"), "u").select("key", "band", "u", "comp", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, band, u, comp, texts in _buckets(batches):
            sets = [shingles(t.as_py()) for t in texts]
            sketch = np.array([_sketch(minima(s)) for s in sets])
            comp, found = comp.copy(), []
            for i in range(len(u)):
                for j in _alike(i, i + 1 + np.flatnonzero(comp[i + 1 :] != comp[i]), sketch, int(band[0])):
                    if comp[j] != comp[i] and likeness(sets[i], sets[j]) >= LIKENESS:
                        found.append((int(u[i]), int(u[j])))
                        comp[comp == comp[j]] = comp[i]
            if found:
                yield _pairs(found)

    return dealt.mapInArrow(run, "u long, v long").distinct()


def near_copies(docs: DataFrame, proposed: DataFrame | None = None) -> DataFrame:
    """(doc_id, component_id) of every doc_id; the component is the least doc_id reachable over near copies. Null text is empty, null ids are left out.

    ``proposed`` (doc_id, component_id) names classes found by another method: all members of one meet as those of a band do, and are joined where alike.
    """
    texts = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    signed = cut_lineage(_signed(texts))
    reps = cut_lineage(signed.groupBy("digest").agg(F.min("doc_id").alias("u"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch")))
    same = signed.join(reps.select("digest", "u"), "digest").select("u", F.col("doc_id").alias("v")).filter("u <> v").distinct()
    members = reps.select("u", "sketch", F.posexplode("keys").alias("band", "key"))
    if proposed is not None:
        named = proposed.select("doc_id", "component_id").join(signed.select("doc_id", "digest"), "doc_id").select("component_id", "digest").distinct()
        classes = cut_lineage(named.join(reps, "digest").select("component_id", "u", "sketch", F.lit(BANDS).alias("band"), F.xxhash64("component_id", F.lit(BANDS)).alias("key")))
        members = members.unionByName(classes.drop("component_id"))
    sizes = members.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    rows = cut_lineage(members.join(sizes, "key").select("key", "band", "u", "sketch", "n"))
    pairs = _proposed(rows)
    if proposed is not None:
        stars = classes.filter("component_id <> u").select(F.least("component_id", "u").alias("u"), F.greatest("component_id", "u").alias("v"))
        pairs = pairs.unionByName(stars).distinct()  # the same shingles are linked already
    links = cut_lineage(same.unionByName(_checked(cut_lineage(pairs), texts)))
    asked = _open(rows, components(links))
    label = components(links.unionByName(_joined(asked, texts)))
    ids = signed.select("doc_id").distinct()
    return ids.join(label, F.col("doc_id") == F.col("node"), "left").select("doc_id", F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, proposed: DataFrame | None = None) -> DataFrame:
    """``docs`` with one row per component: that of its least doc_id. Rows without a doc_id cannot be told apart and stay."""
    first = near_copies(docs, proposed).filter("doc_id = component_id").select("doc_id")
    kept = docs.filter("doc_id IS NOT NULL").join(first, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(docs.columns)
    return kept.unionByName(docs.filter("doc_id IS NULL"))
