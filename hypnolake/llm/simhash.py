"""SimHash near-duplicates by covering locality-sensitive hashing.

Each of the 64 bits carries a non-zero vector of GF(2)^(r+1); table v, a non-zero vector too, keeps the bits whose vector has an odd
inner product with v. Up to r differing bits span at most r dimensions, so some v is orthogonal to all of them and that table
keeps none of them: every pair within radius r meets in one of the 2^(r+1)-1 tables, no pair is missed.

Equal fingerprints are merged first. Buckets are read from sorted partitions. A bucket of up to ``BUCKET`` distinct fingerprints
is linked on the spot and gives one edge per member, not its pairs. A larger one is not linked: its members go
to the next level, where the same construction over the bits not kept so far splits it. Three levels leave 7 free bits, so
the largest bucket is bounded and nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hypnolake.session import cut_lineage

from .common import id_text, query, table
from .graph import components

RADIUS = 3
SHINGLE = 3
BUCKET = 512
SEED = 42


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Majority of the bits of the shingles' XXH64, as a signed 64-bit integer; zero without words."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = [0, *(ends[: len(words) - shingle] + 1).tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :].tolist())]
    ones, n = np.zeros(64, np.int64), len(hashes)
    every = np.array(hashes, np.uint64)
    for k in range(0, n, 65536):
        part = every[k : k + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > n, bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) per row of ``docs``; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    return id_text(docs).mapInArrow(run, "doc_id long, fp long")


@lru_cache(maxsize=4096)
def covering_masks(free: int, radius: int = RADIUS) -> tuple[int, ...]:
    """Signed masks over the bits of ``free`` (unsigned): any ``radius`` of them are left out by at least one mask."""
    dims = radius + 1
    places = [i for i in range(64) if free >> i & 1]
    vector = {place: 1 + k % ((1 << dims) - 1) for k, place in enumerate(places)}
    masks = []
    for v in range(1, 1 << dims):
        mask = sum(1 << i for i in places if (vector[i] & v).bit_count() % 2)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return tuple(masks)


def _stars(fp: np.ndarray, rep: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each member to the least one reachable inside the bucket."""
    order = np.argsort(rep, kind="stable")
    fp, rep = fp[order], rep[order]
    near = np.bitwise_count((fp[:, None] ^ fp[None, :]).view(np.uint64)) <= radius
    label = np.arange(len(fp))
    while True:
        least = np.where(near, label[None, :], len(fp)).min(axis=1)
        if (least == label).all():
            break
        label = least
    moved = label != np.arange(len(fp))
    return rep[moved], rep[label[moved]]


LINKED = "kept long, fp long, u long, v long"
_LINKED = pa.schema([("kept", pa.int64()), ("fp", pa.int64()), ("u", pa.int64()), ("v", pa.int64())])


def _link(rows: DataFrame, radius: int, bucket: int) -> DataFrame:
    """Edges (u, v) of small buckets; members of larger ones as (kept, fp, u) for the next level. ``rows``: kept, fp, u."""
    keyed = rows.withColumn("key", F.col("fp").bitwiseAND(F.col("kept")))
    dealt = keyed.select("kept", "key", "fp", "u").repartition("kept", "key").sortWithinPartitions("kept", "key", "fp")

    def deeper(kept: int, fp: np.ndarray, u: np.ndarray) -> pa.RecordBatch:
        masks = covering_masks(~kept & (2**64 - 1), radius)
        wider = np.repeat(np.array([kept | m for m in masks], np.int64), len(fp))
        return pa.RecordBatch.from_arrays(
            [pa.array(wider), pa.array(np.tile(fp, len(masks))), pa.array(np.tile(u, len(masks))), pa.nulls(len(wider), pa.int64())], schema=_LINKED
        )

    def edges(us: list, vs: list) -> pa.RecordBatch:
        u, v = np.concatenate(us), np.concatenate(vs)
        return pa.RecordBatch.from_arrays([pa.nulls(len(u), pa.int64()), pa.nulls(len(u), pa.int64()), pa.array(u), pa.array(v)], schema=_LINKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((4, 0), np.int64)  # the last, perhaps unfinished bucket
        passed = None  # a bucket already known to be too large
        done = False
        while not done:
            batch = next(batches, None)
            done = batch is None
            if not done:
                held = np.concatenate([held, np.array([c.to_numpy(zero_copy_only=False) for c in batch.columns], np.int64)], axis=1)
            n = held.shape[1]
            if not n:
                continue
            cuts = np.flatnonzero((held[0, 1:] != held[0, :-1]) | (held[1, 1:] != held[1, :-1])) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [n]])
            us, vs = [], []
            last = len(starts) - 1
            for k in np.flatnonzero((ends - starts > 1) | (np.arange(len(starts)) == last) | (np.arange(len(starts)) == 0)):
                s, e = starts[k], ends[k]
                key = (held[0, s], held[1, s])
                wide = (~int(key[0]) & (2**64 - 1)).bit_count() > 9  # else at most 512 fingerprints differ
                if wide and (key == passed or e - s > bucket):
                    passed = key
                    for p in range(s, e, 4096):
                        yield deeper(int(key[0]), held[2, p : min(e, p + 4096)], held[3, p : min(e, p + 4096)])
                elif e - s > 1 and (done or k != last):
                    u, v = _stars(held[2, s:e], held[3, s:e], radius)
                    us.append(u)
                    vs.append(v)
            if us and sum(map(len, us)):
                yield edges(us, vs)
            s = starts[last]
            held = held[:, n if done or (held[0, s], held[1, s]) == passed else s :]

    return dealt.mapInArrow(run, LINKED)


def near_links(reps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Edges (u, v) that connect all pairs of ``reps`` (fp distinct, u) at ``radius`` or fewer differing bits."""
    masks = F.array(*[F.lit(m).cast("long") for m in covering_masks(2**64 - 1, radius)])
    rows, found = reps.select(F.explode(masks).alias("kept"), "fp", "u"), None
    while True:
        step = cut_lineage(_link(rows, radius, bucket))
        links = step.filter("kept IS NULL").select("u", "v")
        found = links if found is None else found.unionByName(links)
        rows = step.filter("kept IS NOT NULL").select("kept", "fp", "u")
        if rows.isEmpty():
            return found


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fp and component_id (least doc_id reachable over links of ``radius`` or fewer bits) per row of ``docs``.

    Null text is empty; texts without words share fingerprint zero and are linked like any other; equal rows stay, each with its
    result; a null doc_id links nothing and gets the component of its fingerprint (null if no row with an id has it or is near);
    an empty table gives none; other columns are not read.
    """
    fps = cut_lineage(fingerprints(docs, shingle))
    reps = cut_lineage(fps.groupBy("fp").agg(F.min("doc_id").alias("u")))
    label = components(near_links(reps.filter("u IS NOT NULL"), radius, bucket))
    classes = reps.join(label, F.col("u") == F.col("node"), "left").select(F.col("fp").alias("fp_"), F.coalesce("component", "u").alias("component_id"))
    return fps.join(classes, F.col("fp") == F.col("fp_")).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row per component: that of its least doc_id. Rows without a doc_id cannot be told apart and stay."""
    found = near_duplicates(docs, radius)
    first = found.filter("doc_id = component_id").select("doc_id").distinct()
    kept = docs.filter("doc_id IS NOT NULL").join(first, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(docs.columns)
    return kept.unionByName(docs.filter("doc_id IS NULL"))


@query("op4_simhash")
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and component."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
