import numpy as np
import pytest

from hypnolake.operators import ranks
from hypnolake.operators.describe import describe, kurtosis, sd_pop, sd_samp, skewness


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(2)
    rows = [(g, float(v), int(y)) for g, n in (("x", 400), ("y", 9), ("z", 1)) for v, y in zip(rng.integers(0, 60, n) / 7, rng.integers(0, 2, n))]
    return rows, spark.createDataFrame(rows, "g string, v double, y int")


def test_average_ranks(mode, table):
    rows, df = table
    got = {(r.g, r.v): r["rank"] for r in ranks.average_ranks(df, ["g"], "v").collect()}
    for g in "xyz":
        v = np.array([r[1] for r in rows if r[0] == g])
        for u in np.unique(v):
            assert got[(g, u)] == pytest.approx((v < u).sum() + ((v == u).sum() + 1) / 2)


def test_quantiles_and_moments(mode, table):
    rows, df = table
    d = describe(df, ["g"], "v", {"q1": 0.01, "q50": 0.5, "q87": 0.87}).withColumns({"sp": sd_pop(), "ss": sd_samp(), "sk": skewness(), "ku": kurtosis()})
    for r in d.collect():
        v = np.array([x[1] for x in rows if x[0] == r.g])
        assert (r.q1, r.q50, r.q87) == pytest.approx(tuple(np.percentile(v, [1, 50, 87])))
        assert r["mean"] == pytest.approx(v.mean()) and r.sp == pytest.approx(v.std())
        assert (r.ss is None) == (len(v) < 2) and (r.sk is None) == (len(v) < 3)


def test_auroc_and_reflection(mode, table, spark):
    rows, df = table
    got = {r.g: r.auroc for r in ranks.auroc(df, ["g"], "v", "y").collect()}
    back = {r.g: r.auroc for r in ranks.auroc(df.selectExpr("g", "-v AS v", "y"), ["g"], "v", "y").collect()}
    for g in "xy":
        p = np.array([r[1] for r in rows if r[0] == g and r[2] == 1])[:, None]
        q = np.array([r[1] for r in rows if r[0] == g and r[2] == 0])[None, :]
        assert got[g] == pytest.approx(((p > q) + 0.5 * (p == q)).mean())
        assert back[g] == pytest.approx(1 - got[g])
    assert got["z"] is None


def test_ungrouped_cumulate(mode, spark):
    df = spark.range(100).selectExpr("CAST(id % 17 AS DOUBLE) AS v")
    cum = ranks.cumulate(ranks.histogram(df, [], "v"), [], "v").orderBy("v").collect()
    assert [r.cum_n for r in cum] == np.cumsum(np.bincount(np.arange(100) % 17)).tolist() and {r.tot_n for r in cum} == {100}
