"""Pooled directed coupling against least squares on whole runs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hypnolake.operators import coupling, network

NODES = ["breath", "eeg", "heart"]


def series(n, seed):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, 3))
    for i in range(2, n):
        m[i, 2] += 0.8 * m[i - 1, 0]
        m[i, 1] += 0.3 * m[i - 2, 2]
    return m * [3, 0.5, 8] + [60, -2, 900]


@pytest.fixture(scope="module")
def night():
    """Stages by second: nrem runs of several lengths, rem, an unknown gap, a second without data, a run with a missing value, a flat run."""
    stages = [2] * 150 + [1] * 60 + [9] * 3 + [4] * 90 + [3] * 4 + [5] * 10 + [2] * 100 + [4] * 40 + [9] * 2 + [1] * 50
    m = series(len(stages), 1)
    m[330, 1] = np.nan  # in the second long nrem run
    m[-50:, 0] = 7.0
    secs = list(range(len(stages)))
    return [(s, st, m[s]) for s, st in zip(secs, stages) if s != 250]  # 250 splits the rem run


def runs(night, pool):
    out, last = [], None
    for s, st, v in night:
        inside = st in coupling.POOLS[pool]
        if inside and last is not None and s == last + 1:
            out[-1].append(v)
        elif inside:
            out.append([v])
        last = s if inside else None
    return [np.array(r) for r in out]


def expected(night, pool, ts):
    acc, used, total = {}, 0, 0
    for r in runs(night, pool):
        if len(r) <= coupling.MIN_RUN * ts:
            continue
        total += len(r)
        c = r[: len(r) // ts * ts].reshape(-1, ts, 3).mean(axis=1)
        got = network.directed_gain(c, NODES) if np.isfinite(c).all() else []
        used += len(r) * bool(got)
        for g in got:
            acc.setdefault((g["caused"], g["causing"]), []).append((g["g"], len(r)))
    return {p: sum(g * w for g, w in v) / sum(w for _, w in v) for p, v in acc.items()}, used / total if total else None


@pytest.mark.parametrize("stretch", [4096, 32, 8])
def test_equals_least_squares_on_whole_runs(spark, night, stretch):
    rows = [("r", s, st, n, float(v[k])) for s, st, v in night for k, n in enumerate(NODES) if np.isfinite(v[k])]
    df = spark.createDataFrame(rows, "rec string, sec long, stage int, node string, value double").repartition(4)
    got = coupling.pooled_coupling(df, ["rec"], NODES, timescales=(1, 2), stretch=stretch).collect()
    assert len(got) == 2 * 2 * 6
    for pool in ("nrem", "rem"):
        for ts in (1, 2):
            want, share = expected(night, pool, ts)
            mine = {(r.caused, r.causing): r for r in got if r.pool == pool and r.timescale == ts}
            for p, r in mine.items():
                assert r.stationary_frac == pytest.approx(share)
                assert (r.g is None) == (p not in want) and (r.g is None or r.g == pytest.approx(want[p], abs=1e-6))
    assert expected(night, "nrem", 1)[0][("heart", "breath")] > 0.3


def test_no_runs(spark):
    df = spark.createDataFrame([("r", 1, 9, "heart", 1.0)], "rec string, sec long, stage int, node string, value double")
    assert coupling.pooled_coupling(df, ["rec"], NODES).count() == 0
    short = spark.createDataFrame([("r", s, 2, n, float(s)) for s in range(5) for n in NODES], df.schema)
    assert coupling.pooled_coupling(short, ["rec"], NODES).count() == 0
