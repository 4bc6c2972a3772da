import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hypnolake.operators.ordered import forward_fill, merge_gaps, ordinal, rising_edges, running_sum, runs, shift, with_axis


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(1)
    rows = []
    for rec, n in (("a", 60), ("b", 7), ("c", 1)):
        t = np.cumsum(rng.integers(1, 4, n))
        rows += [(rec, int(x), int(s), None if v < 0.3 else float(round(v, 3))) for x, s, v in zip(t, rng.integers(0, 3, n), rng.random(n))]
    return pd.DataFrame(rows, columns=["rec", "t", "s", "v"])


def _frame(spark, pdf):
    rows = pdf.astype(object).where(pdf.notna(), None).values.tolist()
    return spark.createDataFrame(rows, "rec string, t long, s int, v double")


def test_shift_and_sums(spark, mode, series):
    df, ax = with_axis(_frame(spark, series), ["rec"], ("t",))
    assert ax.chunked == (mode == "hot")
    out = shift(shift(df, ax, ["s"], "p_"), ax, ["s"], "n_", back=False)
    out = ordinal(running_sum(out, ax, {"cum": F.col("s")}), ax, "i").orderBy("rec", "t").toPandas()
    g = series.groupby("rec")
    assert out["p_s"].fillna(-1).tolist() == g["s"].shift(1).fillna(-1).tolist()
    assert out["n_s"].fillna(-1).tolist() == g["s"].shift(-1).fillna(-1).tolist()
    assert out["cum"].tolist() == g["s"].cumsum().tolist()
    assert out["i"].tolist() == g.cumcount().tolist()


def test_runs(spark, mode, series):
    df, ax = with_axis(_frame(spark, series), ["rec"], ("t",))
    got = runs(df, ax, "s", {"top": ("max", F.col("t"))}).orderBy("rec", "run").toPandas()
    want = []
    for rec, g in series.groupby("rec"):
        ids = (g["s"] != g["s"].shift()).cumsum() - 1
        for run, part in g.groupby(ids):
            want.append((rec, run, part["s"].iloc[0], len(part), part["t"].min(), part["t"].max(), part["t"].max()))
    assert list(got[["rec", "run", "s", "n", "first_t", "last_t", "top"]].itertuples(index=False, name=None)) == want


def test_forward_fill_with_head(spark, mode, series):
    df, ax = with_axis(_frame(spark, series), ["rec"], ("t",))
    got = forward_fill(df, ax, "v", "f").orderBy("rec", "t").toPandas()["f"].tolist()
    want = series.groupby("rec")["v"].transform(lambda x: x.ffill().bfill()).tolist()
    assert [None if pd.isna(x) else x for x in got] == [None if pd.isna(x) else x for x in want]


def test_rising_edges_count_an_active_start(spark, mode, series):
    df, ax = with_axis(_frame(spark, series), ["rec"], ("t",))
    got = {r.rec: r.n_events for r in rising_edges(df, ax, F.col("s") > 0).collect()}
    for rec, g in series.groupby("rec"):
        b = (g["s"] > 0).astype(int).to_numpy()
        assert got[rec] == int((np.diff(np.r_[0, b]) == 1).sum())


def test_merge_gaps(spark, mode):
    iv = [(0.0, 1.0), (1.2, 2.0), (5.0, 5.1), (9.0, 12.9), (13.0, 20.0), (30, 31), (31, 32), (40.0, 41.0)]
    df = spark.createDataFrame([("r", float(a), float(b)) for a, b in iv], "rec string, a double, b double")
    got = sorted((r.a, r.b, r.n_merged) for r in merge_gaps(df, ["rec"], "a", "b", 0.3, 0.5, 5).collect())
    assert got == [(0.0, 2.0, 2), (30.0, 32.0, 2), (40.0, 41.0, 1)]
