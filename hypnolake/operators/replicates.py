"""Resampling by replicate vectors: a row carries no copy per replicate; its weights in all of them are drawn where the row is read.

A weight is a function of (seed, replicate, key), so the shuffle moves rows once whatever the number of replicates. Sums over rows are
vectors with a place per replicate: each range of the sorted scores gives its class weights and its wins, and ranges are put together
from their sums alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import POISSON1_CDF
from ..session import cut_lineage

ROWS_AT_ONCE = 4096  # times the replicates: what a task holds of weights
CANDIDATES = 512  # hashes per replicate among which the last step of a selection sorts
_DIGIT_BITS = 12


# ------------------------------------------------------------------ draws
def digests(seed: int, replicates: int, keys: Sequence[str]) -> np.ndarray:
    """MD5 of "seed:replicate-key" as two 64-bit numbers: (rows, replicates, 2)."""
    heads = [hashlib.md5(f"{seed}:{r}-".encode()) for r in range(replicates)]
    out = bytearray()
    for key in keys:
        tail = key.encode()
        for head in heads:
            h = head.copy()
            h.update(tail)
            out += h.digest()
    return np.frombuffer(bytes(out), ">u8").astype("u8").reshape(len(keys), replicates, 2)


def poisson_weights(seed: int, replicates: int, keys: Sequence[str]) -> np.ndarray:
    """(rows, replicates) Poisson(1) multiplicities by inversion of the digest's first 32 bits."""
    u = (digests(seed, replicates, keys)[..., 0] >> np.uint64(32)).astype("f8") / 2.0**32
    return np.searchsorted(np.array(POISSON1_CDF), u, "right").astype("f8")


def _slices(batch: pa.RecordBatch, replicates: int) -> Iterator[pa.RecordBatch]:
    step = max(1, ROWS_AT_ONCE * 64 // max(replicates, 1))
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)


# ------------------------------------------------------------------ means
def weighted_sums(df: DataFrame, key: str, values: dict[str, Column], replicates: int, seed: int) -> DataFrame:
    """(rep, name, total, weight): per replicate the weighted sum of every expression and the weight of the rows where it is known."""
    names = list(values)
    rows = df.select(F.col(key).cast("string").alias("_k"), *[v.cast("double").alias(f"_v{i}") for i, v in enumerate(values.values())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weight = np.zeros((len(names), replicates)), np.zeros((len(names), replicates))
        for batch in batches:
            for b in _slices(batch, replicates):
                w = poisson_weights(seed, replicates, b.column(0).to_pylist())
                for i in range(len(names)):
                    v = b.column(i + 1).to_numpy(zero_copy_only=False).astype("f8")
                    known = ~np.isnan(v)
                    total[i] += v[known] @ w[known]
                    weight[i] += w[known].sum(axis=0)
        yield pa.RecordBatch.from_pydict({
            "rep": np.tile(np.arange(replicates, dtype="i4"), len(names)), "name": np.repeat(names, replicates).tolist(), "total": total.ravel(), "weight": weight.ravel(),
        })

    parts = rows.where("_k IS NOT NULL").mapInArrow(run, "rep int, name string, total double, weight double")
    return parts.groupBy("rep", "name").agg(F.sum("total").alias("total"), F.sum("weight").alias("weight"))


# ------------------------------------------------------------------ wins
_PART = "arm string, low double, high double, pos array<double>, neg array<double>, wins array<double>"


def _wins_of(batches: Iterator[pa.RecordBatch], replicates: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (arm, v): per arm one row for the first value, one for what lies between and one for the last.

    A row has the class weights as vectors; ``wins`` are those inside the middle, where every tie is whole.
    """
    cells: list[list] = []  # of the open arm: first value, between, last value
    arm = None

    def rows() -> Iterator[pa.RecordBatch]:
        if cells:
            yield pa.RecordBatch.from_arrays(
                [pa.array([c[i] for c in cells], t) for i, t in enumerate((pa.string(), pa.float64(), pa.float64(), *[pa.list_(pa.float64())] * 3))],
                names=["arm", "low", "high", "pos", "neg", "wins"],
            )

    def absorb(v: float, p: np.ndarray, n: np.ndarray) -> None:
        """The value ``v`` comes after all before it."""
        if cells and cells[-1][1] == v == cells[-1][2] and len(cells) != 2:
            cells[-1][3] += p
            cells[-1][4] += n
        elif len(cells) < 1:
            cells.append([arm, v, v, p, n, np.zeros(replicates)])
        elif len(cells) == 1:
            cells.append([arm, v, v, np.zeros(replicates), np.zeros(replicates), np.zeros(replicates)])
            cells.append([arm, v, v, p, n, np.zeros(replicates)])
        else:  # the last value is whole now: it moves into the middle
            mid, last = cells[1], cells[2]
            mid[5] += last[3] * (mid[4] + last[4] / 2)
            mid[3] += last[3]
            mid[4] += last[4]
            mid[2] = last[2]
            cells[2] = [arm, v, v, p, n, np.zeros(replicates)]

    for batch in batches:
        for b in _slices(batch, replicates):
            arms = b.column(0).to_pylist()
            v, y = b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
            w = poisson_weights(seed, replicates, b.column(3).to_pylist())
            new = np.flatnonzero(np.r_[True, (v[1:] != v[:-1]) | np.array([a != c for a, c in zip(arms[1:], arms[:-1])], bool)])
            pos, neg = np.add.reduceat(w * (y == 1)[:, None], new), np.add.reduceat(w * (y == 0)[:, None], new)
            for k, i in enumerate(new.tolist()):
                if arms[i] != arm:
                    yield from rows()
                    cells, arm = [], arms[i]
                absorb(float(v[i]), pos[k].copy(), neg[k].copy())
    yield from rows()


def _put_together(parts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Wins and class weights of one arm from its ranges' rows (a pandas frame): cells of one value meet, the others follow each other."""
    p = parts.sort_values(["low", "high"], kind="stable")
    low, high = p["low"].to_numpy(), p["high"].to_numpy()
    pos, neg, own = (np.array(p[c].tolist(), "f8").reshape(len(p), -1) for c in ("pos", "neg", "wins"))
    wins, before = np.zeros(pos.shape[1]), np.zeros(pos.shape[1])
    i = 0
    while i < len(p):
        j = i + 1
        if low[i] == high[i]:
            while j < len(p) and low[j] == high[j] == low[i]:
                j += 1
        a, b = pos[i:j].sum(axis=0), neg[i:j].sum(axis=0)
        wins += a * before + (a * b / 2 if low[i] == high[i] else own[i])
        before += b
        i = j
    return wins, pos.sum(axis=0), before


def auroc_vectors(df: DataFrame, key: str, scores: Sequence[str], label: str, replicates: int, seed: int) -> DataFrame:
    """(rep, score, auroc): tie-aware weighted AUROC of every score in every replicate, on the same draws.

    Rows of one value may lie in several ranges; their class weights meet when the ranges are put together (three rows a range and score).
    """
    import pandas as pd

    cell = F.explode(F.array(*[F.struct(F.lit(s).alias("arm"), F.col(s).cast("double").alias("v")) for s in scores])).alias("_c")
    rows = df.where(F.col(label).isin(0, 1)).select(F.col(label).cast("int").alias("y"), F.col(key).cast("string").alias("k"), cell)
    rows = rows.select("_c.arm", "_c.v", "y", "k").where("v IS NOT NULL AND NOT isnan(v) AND k IS NOT NULL")
    order = ("arm", "v", "k")
    dealt = rows.repartitionByRange(*order).sortWithinPartitions("arm", "v")
    parts = dealt.mapInArrow(lambda it: _wins_of(it, replicates, seed), _PART)

    def final(p: pd.DataFrame) -> pd.DataFrame:
        wins, a, b = _put_together(p)
        ok = (a > 0) & (b > 0)
        value = np.full(len(wins), None, object)
        value[ok] = wins[ok] / (a * b)[ok]
        return pd.DataFrame({"rep": np.arange(replicates, dtype="i4"), "score": p["arm"].iloc[0], "auroc": value})

    return parts.groupBy("arm").applyInPandas(final, "rep int, score string, auroc double")


# ------------------------------------------------------------------ permutations
def _digit_counts(seed: int, replicates: int, prefix: np.ndarray, done: int):
    """Rows by (replicate, next digit) among those whose first ``done`` bits are the replicate's prefix."""
    shift = np.uint64(64 - done - _DIGIT_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((replicates, 1 << _DIGIT_BITS), "i8")
        for batch in batches:
            for b in _slices(batch, replicates):
                top = digests(seed, replicates, b.column(0).to_pylist())[..., 0] >> shift
                row, rep = np.nonzero((top >> np.uint64(_DIGIT_BITS)) == prefix) if done else np.nonzero(np.ones(top.shape, bool))
                np.add.at(counts, (rep, (top[row, rep] & np.uint64((1 << _DIGIT_BITS) - 1)).astype("i8")), 1)
        rep, digit = np.nonzero(counts)
        yield pa.RecordBatch.from_pydict({"rep": rep.astype("i4"), "digit": digit.astype("i4"), "n": counts[rep, digit]})

    return run


def nth_smallest(keys: DataFrame, n: int, replicates: int, seed: int) -> np.ndarray:
    """Per replicate the ``n``-th smallest digest of the keys (one column of strings), as two 64-bit numbers.

    Twelve bits at a time: counts by digit tell the digit of the wanted one, until few digests share what is known of it.
    """
    from pyspark.sql import Window

    prefix, rest, done = np.zeros(replicates, "u8"), np.full(replicates, n, "i8"), 0
    size = keys.count()
    while size > CANDIDATES and done + _DIGIT_BITS <= 60:
        counts = keys.mapInArrow(_digit_counts(seed, replicates, prefix, done), "rep int, digit int, n long").groupBy("rep", "digit").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("rep").orderBy("digit"))  # a replicate has at most 4096 digits
        wanted = F.element_at(F.array(*[F.lit(int(x)) for x in rest]), F.col("rep") + 1)
        hit = counts.withColumn("_u", upto).where((F.col("_u") >= wanted) & (F.col("_u") - F.col("n") < wanted))
        found = hit.collect()  # one row per replicate
        for r in found:
            rest[r.rep] -= r["_u"] - r.n
            prefix[r.rep] = (prefix[r.rep] << np.uint64(_DIGIT_BITS)) | np.uint64(r.digit)
        size, done = max(r.n for r in found), done + _DIGIT_BITS

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in _slices(batch, replicates):
                d = digests(seed, replicates, b.column(0).to_pylist())
                row, rep = np.nonzero((d[..., 0] >> np.uint64(64 - done)) == prefix) if done else np.nonzero(np.ones(d.shape[:2], bool))
                found = pa.array([x.tobytes() for x in d[row, rep].astype(">u8")], pa.binary())  # a slice may hold none: the type is not inferred
                yield pa.RecordBatch.from_pydict({"rep": rep.astype("i4"), "d": found})

    few = keys.mapInArrow(candidates, "rep int, d binary").groupBy("rep").agg(F.sort_array(F.collect_list("d")).alias("ds"))
    wanted = F.element_at(F.array(*[F.lit(int(x)) for x in rest]), F.col("rep") + 1)
    out = np.zeros((replicates, 2), "u8")
    for r in few.select("rep", F.element_at("ds", wanted.cast("int")).alias("d")).collect():  # one row per replicate
        out[r.rep] = np.frombuffer(bytes(r.d), ">u8")
    return out


def rank_sums(ranked: DataFrame, key: str, rank: str, last: np.ndarray, replicates: int, seed: int) -> DataFrame:
    """(rep, rank_sum, n) over the rows whose digest is at most the replicate's ``last``."""
    rows = ranked.select(F.col(key).cast("string").alias("k"), F.col(rank).cast("double").alias("r"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(replicates), np.zeros(replicates, "i8")
        for batch in batches:
            for b in _slices(batch, replicates):
                d = digests(seed, replicates, b.column(0).to_pylist())
                inside = (d[..., 0] < last[:, 0]) | ((d[..., 0] == last[:, 0]) & (d[..., 1] <= last[:, 1]))
                total += b.column(1).to_numpy(zero_copy_only=False) @ inside
                count += inside.sum(axis=0)
        yield pa.RecordBatch.from_pydict({"rep": np.arange(replicates, dtype="i4"), "total": total, "n": count})

    parts = rows.mapInArrow(run, "rep int, total double, n long")
    return parts.groupBy("rep").agg(F.sum("total").alias("rank_sum"), F.sum("n").alias("n"))


def stored_keys(df: DataFrame, key: str) -> DataFrame:
    """The keys alone, written once: a selection reads them several times."""
    return cut_lineage(df.select(F.col(key).cast("string").alias("k")))
