"""Exact k-nearest-neighbour join and its uses, without a cross join.

Train rows go to their nearest pivot; pivots grow with the square root of the rows. A query first searches its own cell, which gives it a true k-th
distance, and then only the cells that can hold a nearer row (triangle inequality with the cells' radii). Cells and query sets above
``block_rows`` are salted, so no task holds more than one block of each; distances are matrix products over sub-blocks, and those near the
k-th are computed again exactly.
"""

from __future__ import annotations

import logging
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_fraction, hash_key
from ..session import cut_lineage

SUB_BLOCK = 256  # queries whose distances to a block are held at once
log = logging.getLogger(__name__)


def _matrix(s: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, float) for v in s]) if len(s) else np.zeros((0, 1))


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances by one matrix product; good to about 1e-13 of the squared lengths."""
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T), 0)


def nearest_rows(q: np.ndarray, t: np.ndarray, want: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of the ``want`` nearest rows of ``t`` per query, at most ``bound`` away, ties in the order of ``t``."""
    d2 = _squares(q, t)
    slack = 1e-11 * ((q * q).sum(axis=1).max(initial=0) + (t * t).sum(axis=1).max(initial=0)) + 1e-300
    m = min(want, len(t))
    kth = np.partition(d2, m - 1, axis=1)[:, m - 1]
    row, col = np.nonzero(d2 <= (np.minimum(kth, bound * bound) + slack)[:, None])
    exact = np.sqrt(((q[row] - t[col]) ** 2).sum(axis=1))
    order = np.lexsort((col, exact, row))
    row, col, exact = row[order], col[order], exact[order]
    place = np.arange(len(row)) - np.searchsorted(row, row, "left")
    keep = (place < m) & (exact <= bound[row] * (1 + 1e-9) + 1e-12)
    return row[keep], col[keep], exact[keep]


def _search(ask: DataFrame, cells: Column, placed: DataFrame, salts: dict[int, int], want: int, names: list[str], out_schema: str, block_rows: int) -> DataFrame:
    """Nearest rows of every query (_qk, _qv, _bound) in the cells it visits: up to ``want`` rows per visited block."""
    key, payload = names[0], names[3:]
    n_salts = F.element_at(F.create_map(*[F.lit(x) for kv in salts.items() for x in kv]), F.col("cell"))
    left = ask.withColumn("cell", F.explode(cells)).withColumn("salt", F.explode(F.sequence(F.lit(0), n_salts - 1)))
    per = left.groupBy("cell").agg(F.count(F.lit(1)).alias("_q")).withColumn("_qs", F.greatest(F.ceil(F.col("_q") / (F.lit(block_rows) * n_salts)), F.lit(1)).cast("int")).select("cell", "_qs")
    left = left.join(F.broadcast(per), "cell").withColumn("part", F.pmod(F.xxhash64("_qk"), F.col("_qs"))).drop("_qs")  # one row per pivot
    right = placed.withColumn("salt", F.pmod(F.xxhash64(key), n_salts).cast("int")).join(F.broadcast(per), "cell")
    right = right.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_qs").cast("long") - 1))).drop("_qs")
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    vector = next(c for c in placed.columns if c not in (key, "cell", *payload))

    def block(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if q.empty or t.empty:
            return pd.DataFrame({n: [] for n in names})
        t = t.sort_values(key)
        tm, tk, rows = _matrix(t[vector]), t[key].to_numpy(), []
        for a in range(0, len(q), SUB_BLOCK):
            part = q.iloc[a : a + SUB_BLOCK]
            row, col, d = nearest_rows(_matrix(part["_qv"]), tm, want, part["_bound"].to_numpy())
            rows.append(pd.DataFrame({key: part["_qk"].to_numpy()[row], "neighbour": tk[col], "distance": d, **{p: t[p].to_numpy()[col] for p in payload}}))
        return pd.concat(rows)[names]

    g = ["cell", "salt", "part"]
    return left.groupBy(*g).cogroup(right.groupBy(*g)).applyInPandas(block, out_schema)


def knn_join(queries: DataFrame, train: DataFrame, k: int, key: str, vector: str, payload: str | None = None, block_rows: int = 20_000, exclude_self: bool = False, n_pivots: int | None = None) -> DataFrame:
    """(query key, rank, neighbour key, distance[, payload]); ties break by neighbour key."""
    cols = [key, vector] + ([payload] if payload else [])
    bank, want = cut_lineage(train.select(*cols)), k + int(exclude_self)
    n_pivots = n_pivots or max(16, math.isqrt(bank.count()))
    # seeded rows; they only steer pruning, never the result
    pivots = _matrix(pd.Series([r[0] for r in bank.orderBy(hash_key("pivot", F.col(key))).select(vector).limit(n_pivots).collect()]))

    @F.pandas_udf("cell int, radius double")
    def nearest(v: pd.Series) -> pd.DataFrame:
        x = _matrix(v)
        cell = _squares(x, pivots).argmin(axis=1)
        return pd.DataFrame({"cell": cell.astype("int32"), "radius": np.sqrt(((x - pivots[cell]) ** 2).sum(axis=1))})

    placed = bank.withColumn("_c", nearest(vector)).select(*cols, F.col("_c.cell").alias("cell"), F.col("_c.radius").alias("radius"))
    placed = cut_lineage(placed)
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("radius").alias("r")).orderBy("cell").collect()  # one row per pivot
    ids = np.array([c.cell for c in cells], "int32")
    count, radius = np.array([c.n for c in cells]), np.array([c.r for c in cells])
    centre = pivots[ids] if len(ids) else pivots
    salts = {int(i): int(-(-n // block_rows)) for i, n in zip(ids, count)} or {0: 1}
    placed = placed.drop("radius")

    def homes(d: np.ndarray) -> list[np.ndarray]:
        """Per query the nearest cells that hold enough rows together."""
        near = np.argsort(d, axis=1, kind="stable")
        enough = (np.cumsum(count[near], axis=1) < want).sum(axis=1)
        return [near[i, : e + 1] for i, e in enumerate(enough)]

    @F.pandas_udf("array<int>")
    def home(v: pd.Series) -> pd.Series:
        return pd.Series([ids[h] for h in homes(_squares(_matrix(v), centre))])

    @F.pandas_udf("array<int>")
    def others(v: pd.Series, bound: pd.Series) -> pd.Series:
        x = _matrix(v)
        d2 = _squares(x, centre)
        slack = np.sqrt(1e-11 * ((x * x).sum(axis=1).max(initial=0) + (centre * centre).sum(axis=1).max(initial=0)))
        out = []
        for h, row, b in zip(homes(d2), np.sqrt(d2), bound):
            may = row - radius <= b * (1 + 1e-9) + slack + 1e-12
            may[h] = False
            out.append(ids[may])
        return pd.Series(out)

    key_t = train.schema[key].dataType.simpleString()
    out_schema = f"{key} {key_t}, neighbour {key_t}, distance double" + (f", {payload} {train.schema[payload].dataType.simpleString()}" if payload else "")
    names = [key, "neighbour", "distance"] + ([payload] if payload else [])
    ask = cut_lineage(queries.select(F.col(key).alias("_qk"), F.col(vector).alias("_qv")))
    first = cut_lineage(_search(ask.withColumn("_bound", F.lit(float("inf"))), home("_qv"), placed, salts, want, names, out_schema, block_rows))
    kth = first.groupBy(key).agg(F.sort_array(F.collect_list("distance")).alias("_d"))  # k rows per home cell
    kth = kth.select(F.col(key).alias("_k"), F.when(F.size("_d") >= want, F.get("_d", F.lit(want - 1))).otherwise(F.lit(float("inf"))).alias("_bound"))
    asked = cut_lineage(ask.join(kth, F.col("_qk") == F.col("_k")).drop("_k"))
    if log.isEnabledFor(logging.DEBUG):
        log.debug("cells visited per query: %s of %s", asked.agg(F.avg(F.size(others("_qv", "_bound")) + 1)).first()[0], len(ids))
    second = _search(asked, others("_qv", "_bound"), placed, salts, want, names, out_schema, block_rows)
    local = first.unionByName(second)
    if exclude_self:
        local = local.where(F.col(key) != F.col("neighbour"))
    item = F.struct("distance", "neighbour", *([payload] if payload else []))
    best = local.groupBy(key).agg(F.slice(F.array_sort(F.collect_list(item)), 1, k).alias("_b"))  # k rows per visited block
    return best.select(key, F.posexplode("_b").alias("rank", "_n")).select(key, "rank", "_n.neighbour", "_n.distance", *([f"_n.{payload}"] if payload else []))


def local_rate(knn: DataFrame, key: str, label: str) -> DataFrame:
    """Share of positive labels among the neighbours."""
    return knn.groupBy(key).agg(F.avg(F.col(label).cast("double")).alias("local_rate"), F.count(F.lit(1)).alias("k"))


def blend(rates: DataFrame, probs: DataFrame, key: str, weight: float) -> DataFrame:
    """weight * local rate + (1 - weight) * global model probability."""
    return probs.join(rates.select(key, "local_rate"), key, "left").withColumn(
        "prob", F.when(F.col("local_rate").isNotNull(), weight * F.col("local_rate") + (1 - weight) * F.col("prob")).otherwise(F.col("prob"))
    )


def interpolated_positives(df: DataFrame, key: str, vector: str, label: str, k: int, copies: int, seed: int) -> DataFrame:
    """Oversampling inside a training fold: points between a positive and one of its k nearest positives."""
    pos = cut_lineage(df.where(F.col(label) == 1).select(key, vector))
    nn = knn_join(pos, pos, k, key, vector, exclude_self=True).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "neighbour"))).alias("_n"))
    c = nn.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    pick = F.floor(hash_fraction(F.concat_ws(":", F.lit(f"{seed}p"), F.col("copy")), F.col(key)) * F.size("_n")).cast("int")
    c = c.select(key, "copy", F.get("_n", pick).getField("neighbour").alias("other"))
    far = pos.select(F.col(key).alias("other"), F.col(vector).alias("_y"))
    u = hash_fraction(F.concat_ws(":", F.lit(f"{seed}u"), F.col("copy")), F.col(key))
    j = c.join(pos, key).join(far, "other").withColumn("_u", u)
    mix = F.zip_with(vector, "_y", lambda a, b: a.cast("double") + F.col("_u") * (b.cast("double") - a.cast("double")))
    return j.select(key, "copy", mix.alias(vector), F.lit(1).alias(label))
