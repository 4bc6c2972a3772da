"""Directed coupling of several nodes over pooled runs of sleep, at several time scales.

A run is an unbroken stretch of seconds in one group of stages. Its regressions need no series in one place: every second gives a row of lagged
values, stretches of a run add up the products of these rows, and the sums of a run are one small matrix from which all restricted and
full regressions, and the stationarity tests, are solved.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .network import ADF_CRITICAL
from .ordered import Axis, running_sum, shift, with_axis

STRETCH = 4096  # values of a run whose products one task adds up
# Pools of stages, shortest run and lags of the regressions.
POOLS = {"nrem": (1, 2, 3), "rem": (4,)}
MIN_RUN, MAX_LAG, MIN_LAG = 5, 5, 3


def pooled_runs(seconds: DataFrame, keys: Sequence[str], nodes: Sequence[str], pools: dict[str, Sequence[int]] = POOLS, within: Axis | None = None) -> DataFrame:
    """(keys, pool, run, at, dur, values): the nodes' values of every second in a pool, with its place in its run and the run's length.

    ``seconds``: keys, sec, node, value, stage. A node without a value in a second is null there.
    """
    pool = None
    for name, stages in pools.items():
        inside = F.col("stage").isin(*stages)
        pool = F.when(inside, F.lit(name)) if pool is None else pool.when(inside, F.lit(name))
    each = [F.max(F.when(F.col("node") == n, F.col("value").cast("double"))) for n in nodes]
    per = seconds.groupBy(*keys, "sec").agg(F.max("stage").alias("stage"), F.array(*each).alias("values")).withColumn("pool", pool)
    rows, ax = with_axis(per, keys, ("sec",), within=within)
    s = shift(rows, ax, ["pool", "sec"], "_p_")
    same = F.coalesce((F.col("pool") == F.col("_p_pool")) & (F.col("sec") == F.col("_p_sec") + 1), F.lit(False))
    runs = running_sum(s.withColumn("_new", (~same).cast("long")), ax, {"run": F.col("_new")}).where("pool IS NOT NULL")
    runs = cut_lineage(runs.select(*keys, "pool", "run", "sec", "values"))
    size = runs.groupBy(*keys, "pool", "run").agg(F.min("sec").alias("_first"), F.count(F.lit(1)).alias("dur"))
    return runs.join(size, [*keys, "pool", "run"]).select(*keys, "pool", "run", (F.col("sec") - F.col("_first")).cast("long").alias("at"), "dur", "values")


def lagged_rows(z: np.ndarray, at: np.ndarray, n: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows [1, trend, values at lag 0, 1, ... depth] and their places, of consecutive values; lags before the run's begin are 0."""
    out = np.zeros((len(z), 2 + (depth + 1) * z.shape[1]))
    out[:, 0], out[:, 1] = 1, at / n - 0.5
    for k in range(min(depth + 1, len(z))):
        out[k:, 2 + k * z.shape[1] : 2 + (k + 1) * z.shape[1]] = z[: len(z) - k]
    return out, at


def products(rows: np.ndarray, at: np.ndarray, first: int, last: int) -> np.ndarray:
    """Sums of the rows' outer products over places from ``first`` on, from ``first + 1`` on, ... up to ``last``."""
    return np.stack([rows[at >= k].T @ rows[at >= k] for k in range(first, last + 1)])


def _solve(xx: np.ndarray, xy: np.ndarray, yy: float, n: int) -> tuple[np.ndarray, float, np.ndarray]:
    """Coefficients, residual variance and inverse of a regression given by its products."""
    inv = np.linalg.pinv(xx, hermitian=True)
    beta = inv @ xy
    return beta, max(yy - xy @ beta, 0.0) / max(n - len(xx), 1), inv


def _level_t(p: np.ndarray, node: int, order: int, n_nodes: int) -> float:
    """t of the lagged level in the augmented regression with constant and trend, from products over places past ``order``."""
    size = p.shape[0]
    lag = lambda k: np.eye(size)[2 + k * n_nodes + node]
    n = int(round(p[0, 0]))
    if n <= order + 4:
        return 0.0
    step = lambda k: lag(k) - lag(k + 1)
    x = np.stack([np.eye(size)[0], np.eye(size)[1], lag(1), *[step(k) for k in range(1, order + 1)]])
    y = step(0)
    beta, s2, inv = _solve(x @ p @ x.T, x @ p @ y, float(y @ p @ y), n)
    return float(beta[2] / np.sqrt(max(s2 * inv[2, 2], 1e-300)))


def gains(p: np.ndarray, n: int, n_nodes: int, max_lag: int = MAX_LAG, min_lag: int = MIN_LAG) -> np.ndarray | None:
    """(caused, causing) log ratios of residual variances without and with the causing node, at the highest order where all nodes are stationary.

    ``p[k]`` are the products over places from ``min_lag + k`` on.
    """
    for order in range(max_lag, min_lag - 1, -1):
        if n < order + 5 or n - order <= 3 + order * n_nodes:
            continue
        if any(_level_t(p[order + 1 - min_lag], c, order, n_nodes) > ADF_CRITICAL for c in range(n_nodes)):
            continue
        m = p[order - min_lag]
        rows = int(round(m[0, 0]))
        out = np.full((n_nodes, n_nodes), np.nan)

        def variance(c: int, used: list[int]) -> float:
            cols = [0, 1, *[2 + k * n_nodes + u for k in range(1, order + 1) for u in used]]
            y = 2 + c
            return _solve(m[np.ix_(cols, cols)], m[cols, y], float(m[y, y]), rows)[1]

        everyone = list(range(n_nodes))
        for c in everyone:
            full = variance(c, everyone)
            for drop in everyone:
                part = variance(c, [u for u in everyone if u != drop]) if drop != c else 0.0
                if drop != c and part > 0 and full > 0:
                    out[c, drop] = np.log(part / full)
        return out
    return None


def pooled_coupling(
    seconds: DataFrame, keys: Sequence[str], nodes: Sequence[str], pools: dict[str, Sequence[int]] = POOLS, timescales: Sequence[int] = (1,), within: Axis | None = None, stretch: int = STRETCH
) -> DataFrame:
    """(keys, pool, timescale, caused, causing, g, stationary_frac): duration-weighted coupling over a pool's runs.

    Values are averaged over blocks of ``timescale`` seconds and standardised by run; runs of at most ``MIN_RUN`` blocks are left out, runs
    with a missing or constant node give no coupling but count in the time of which the stationary share is taken.
    """
    keys, nodes, k = list(keys), list(nodes), len(nodes)
    run = [*keys, "pool", "run", "timescale"]
    rows = pooled_runs(seconds, keys, nodes, pools, within)
    scale = F.explode(F.array(*[F.lit(int(t)) for t in timescales])).alias("timescale")
    rows = rows.select("*", scale).where(F.col("dur") > MIN_RUN * F.col("timescale"))
    rows = rows.withColumn("b", F.floor(F.col("at") / F.col("timescale"))).withColumn("n", F.floor(F.col("dur") / F.col("timescale"))).where("b < n")
    value = lambda i: F.get("values", F.lit(i))
    whole = [F.when(F.count(value(i)) == F.first("timescale"), F.avg(value(i))) for i in range(k)]
    blocks = cut_lineage(rows.groupBy(*run, "b").agg(F.first("n").alias("n"), F.first("dur").alias("dur"), F.array(*whole).alias("v")))
    v = lambda i: F.get("v", F.lit(i))
    facts = blocks.groupBy(*run).agg(
        F.first("dur").alias("dur"), F.array(*[F.avg(v(i)) for i in range(k)]).alias("mean"), F.array(*[F.stddev_pop(v(i)) for i in range(k)]).alias("sd"),
        F.min(F.least(*[F.when(v(i).isNotNull() & ~F.isnan(v(i)), 1).otherwise(0) for i in range(k)])).alias("_whole"),
    )
    facts = cut_lineage(facts.withColumn("usable", (F.col("_whole") == 1) & F.forall("sd", lambda s: s > 0)).drop("_whole"))
    good = facts.where("usable").select(*[F.col(c).alias(f"_r_{c}") for c in run], "mean", "sd")
    z = blocks.join(good, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in run])
    z = z.withColumn("z", F.transform("v", lambda x, i: (x - F.get("mean", i)) / F.get("sd", i)))
    depth = MAX_LAG + 1
    own = F.floor(F.col("b") / stretch)
    # the last values of a stretch are the first lags of the next
    both = F.when((F.col("b") % stretch >= stretch - depth) & (F.col("b") + depth >= (own + 1) * stretch), F.array(own, own + 1)).otherwise(F.array(own))
    z = z.select(*run, "n", "b", "z", F.explode(both).alias("_s"))
    types = {f.name: f for f in blocks.schema}
    out = T.StructType([*[types[c] for c in run], T.StructField("n", T.LongType()), T.StructField("sums", T.ArrayType(T.DoubleType()))])

    def add_up(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("b")
        at, n, s = p["b"].to_numpy(), int(p["n"].iloc[0]), int(p["_s"].iloc[0])
        x, at = lagged_rows(np.array(p["z"].tolist(), "f8"), at, n, depth)
        mine = at >= s * stretch
        one = p[run].iloc[:1].copy()
        one["n"], one["sums"] = n, [products(x[mine], at[mine], MIN_LAG, MAX_LAG + 1).ravel()]
        return one

    sums = z.groupBy(*run, "_s").applyInPandas(add_up, out)
    found = T.StructType([*[types[c] for c in run], T.StructField("g", T.ArrayType(T.DoubleType()))])

    def solve(p: pd.DataFrame) -> pd.DataFrame:
        width = 2 + (depth + 1) * k
        g = gains(np.sum([np.asarray(a) for a in p["sums"]], axis=0).reshape(-1, width, width), int(p["n"].iloc[0]), k)
        one = p[run].iloc[:1].copy()
        one["g"] = [None if g is None else g.ravel()]
        return one

    solved = sums.groupBy(*run).applyInPandas(solve, found).where("g IS NOT NULL")  # one row a stretch meets here
    solved = solved.select(*[F.col(c).alias(f"_r_{c}") for c in run], "g")
    all_ = facts.select(*run, "dur").join(solved, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in run], "left")
    pairs = F.array(*[F.struct(F.lit(a).alias("caused"), F.lit(b).alias("causing"), F.get("g", F.lit(i * k + j)).alias("g")) for i, a in enumerate(nodes) for j, b in enumerate(nodes) if i != j])
    each = all_.select(*keys, "pool", "timescale", "dur", F.col("g").isNotNull().alias("_used"), F.explode(pairs).alias("_p")).select(*keys, "pool", "timescale", "dur", "_used", "_p.*")
    known = F.col("g").isNotNull() & ~F.isnan("g")
    return each.groupBy(*keys, "pool", "timescale", "caused", "causing").agg(
        (F.sum(F.when(known, F.col("g") * F.col("dur"))) / F.sum(F.when(known, F.col("dur")))).alias("g"),
        (F.sum(F.when(F.col("_used"), F.col("dur")).otherwise(0)) / F.sum("dur")).alias("stationary_frac"),
    )
