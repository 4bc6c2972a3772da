import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from hypnolake.functions import tails
from hypnolake.operators import clean, cohort, harmonize, models, neighbours, stats


def test_tail_functions():
    assert tails.beta_inc(0.5, 0.5, 0.25) == pytest.approx(2 / math.pi * math.asin(0.5))
    assert tails.beta_inc(2, 3, 0.4) == pytest.approx(0.5248)
    assert tails.gamma_upper(1, 2.5) == pytest.approx(math.exp(-2.5)) and tails.gamma_upper(0.5, 1.920729) == pytest.approx(0.05, abs=1e-5)
    # t with 1 degree of freedom is Cauchy
    assert tails.beta_inc(0.5, 0.5, 1 / (1 + 3.0**2)) == pytest.approx(1 - 2 / math.pi * math.atan(3.0))


def test_p_values_and_fdr(spark):
    df = spark.createDataFrame([("a", 1.96, 0.01), ("b", 0.0, 0.02), ("c", 3.0, 0.03), ("d", None, None)], "feature string, z double, p0 double")
    p = {r.feature: r.p for r in stats.with_p(df, "mann_whitney").collect()}
    assert p["a"] == pytest.approx(0.05, abs=1e-4) and p["b"] == 1 and p["d"] is None
    q = {r.feature: r.q for r in stats.benjamini_hochberg(df, "p0").collect()}
    assert q == {"a": pytest.approx(0.03), "b": pytest.approx(0.03), "c": pytest.approx(0.03), "d": None}


def test_inverse_normal_is_label_free_and_matches_stdlib(spark, mode):
    v = [3.0, 1.0, 1.0, 8.0, 5.0]
    df = spark.createDataFrame([("s", "f", x, i) for i, x in enumerate(v)] + [("one", "f", 2.0, 9)], "site string, feature string, value double, rec int")
    got = {r.rec: r.harmonised for r in harmonize.site_inverse_normal(df).collect()}
    rank = {3.0: 3, 1.0: 1.5, 8.0: 5, 5.0: 4}
    for i, x in enumerate(v):
        assert got[i] == pytest.approx(NormalDist().inv_cdf((rank[x] - 0.375) / 5.25))
    assert got[9] == 0.0
    assert {r.rec: r.harmonised for r in harmonize.site_rank(df).collect()}[9] == 0.5


def test_collinear_pruning_is_greedy(spark):
    pairs = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.1), ("b", "c", -0.95)], "feature_i string, feature_j string, rho double")
    assert harmonize.prune_collinear(pairs, ["a", "b", "c"]) == ["a", "c"]
    assert harmonize.prune_collinear(pairs, ["b", "a", "c"]) == ["b"]


def test_matched_controls_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.choice(["x", "y"]), float(rng.integers(60, 72)), int(i % 4 == 0)) for i in range(120)]
    df = spark.createDataFrame([(i, str(b), a, y) for i, b, a, y in rows], "rec long, block string, age double, label int")
    got = {}
    for r in cohort.matched_controls(df, "rec", ["block"], k=2, caliper=3).orderBy("case", "choice").collect():
        got.setdefault(r.case, []).append(r.control)
    free, want = sorted(r for r in rows if r[3] == 0), {}
    for i, b, a, y in sorted(r for r in rows if r[3] == 1):
        near = sorted((c for c in free if c[1] == b and abs(c[2] - a) <= 3), key=lambda c: (abs(c[2] - a), c[2], c[0]))[:2]
        if near:
            want[i] = [c[0] for c in near]
            free = [c for c in free if c not in near]
    assert got == want


def test_splits_cover_once(spark, mode):
    df = spark.createDataFrame([(i, "abc"[i % 3], i % 2) for i in range(120)], "rec long, site string, label int")
    s = cohort.split_train_val_test(df, "rec").groupBy("split").count().collect()
    assert {r.split: r["count"] for r in s} == {"train": 84, "val": 18, "test": 18}
    f = cohort.stratified_folds(df, "rec", ["site", "label"], 4, 2).groupBy("repeat", "fold").count().collect()
    assert {r["count"] for r in f} == {30}
    few = cohort.subsample_positives(df, "rec", 0.01, 1)
    assert few.where("label = 1").count() == 1 and few.where("label = 0").count() == 60


@pytest.mark.parametrize("block_rows", [20_000, 40])
def test_knn_is_exact(spark, block_rows):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(0, 0.05, (150, 4)), rng.normal(3, 1, (150, 4))])  # half of the rows in one tight cell
    df = spark.createDataFrame([(i, [float(v) for v in r], int(i % 2)) for i, r in enumerate(x)], "id long, v array<double>, y int")
    q, t = df.where("id % 5 = 0"), df.where("id % 5 <> 0")
    got = {}
    for r in neighbours.knn_join(q, t, 7, "id", "v", "y", block_rows=block_rows, n_pivots=8).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.neighbour)
    ids = np.array([i for i in range(300) if i % 5])
    for i in range(0, 300, 5):
        d = np.sqrt(((x[ids] - x[i]) ** 2).sum(axis=1))
        assert got[i] == ids[np.lexsort((ids, d))][:7].tolist()


def test_channels(spark):
    table = spark.createDataFrame([(0, "c3-m2;C3_PDS;c3", "eeg"), (1, "hr", "x"), (2, "ecg;ekg", "ecg")], "rule int, Channel_Names string, Category string")
    al = clean.alias_table(table)
    ch = spark.createDataFrame([("r", "C3"), ("r", "c3-M2"), ("r", "EKG"), ("r", "Pulse"), ("r", "Foo:Bar")], "rec string, channel string")
    got = {r.channel: r.std_channel for r in clean.standardise_channels(ch, al, ["rec"]).collect()}
    assert got == {"c3-M2": "c3-m2", "EKG": "ecg", "Pulse": "hr", "Foo:Bar": "foo-bar"}
    roles = {r.channel: r.role for r in ch.select("channel", clean.channel_role(F.col("channel")).alias("role")).collect()}
    assert roles["EKG"] == "ecg" and roles["C3"] == "eeg" and roles["Foo:Bar"] == "other"


def test_demographic_rules(spark):
    df = spark.createDataFrame([("F", "Pacific", "Hispanic"), ("unknown", "", None), ("Male", "Black or African American", "non-hispanic")], "s string, r string, e string")
    got = [tuple(x) for x in df.select(clean.sex(df.s), clean.race(df.r), clean.ethnicity(df.e)).collect()]
    assert got == [("Female", "Others", "Hispanic"), ("Unknown", "Unavailable", "Unavailable"), ("Male", "Black", "Not Hispanic")]


def test_presets_and_leakage(spark):
    cols = ["age", "sex_f", "bmi", "hrv_sdnn", "ahi"]
    assert clean.preset_columns(cols, "submit") == ["sex_f", "bmi", "hrv_sdnn", "ahi"]
    assert clean.preset_columns(cols, "autonomic_only") == ["hrv_sdnn"] and clean.preset_columns(cols, "extract_all") == cols
    with pytest.raises(ValueError):
        clean.drop_leaky(spark.createDataFrame([(1, 2)], "age int, label int"))


def _training(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(240):
        y = int(rng.random() < 0.5)
        rows.append((i, "abc"[i % 3], float(55 + i % 12), y, float(rng.normal(2 * y)), None if i % 7 == 0 else float(rng.normal())))
    return spark.createDataFrame(rows, "rec long, site string, age double, label int, f double, g double")


def test_models_learn_and_route(spark):
    df = _training(spark)
    fast = {"kind": "logit", "calibrate": False}
    oof = models.loso(df, ["f", "g"], **fast)
    scores = {r.site: r.auroc for r in models.fold_metrics(oof, oof).collect()}
    assert set(scores) == {"a", "b", "c", "all"} and scores["all"] > 0.85
    m = models.fit_site_models(df, ["f", "g"], min_n=40, **fast)
    assert set(m.experts) == {"a", "b", "c"}
    unseen = df.withColumn("site", F.lit("new"))
    a, b = m.transform(unseen), m.overall.transform(unseen)
    assert {r.rec: r.prob for r in a.collect()} == {r.rec: r.prob for r in b.collect()}


def test_calibrated_probability_is_bounded_and_ranker_orders(spark):
    df = _training(spark)
    c = models.fit_classifier(df, ["f", "g"], kind="logit")
    assert len(c.parts) == 3
    lo, hi = c.transform(df).agg(F.min("prob"), F.max("prob")).head()
    assert 0 <= lo < hi <= 1
    r = models.fit_pairwise(df, ["f", "g"], per_positive=10)
    from hypnolake.operators.ranks import auroc

    assert auroc(r.transform(df), [], "prob", "label").head().auroc > 0.85
    pairs = models.age_matched_pairs(df.select("rec", "age", "label", F.array("f").alias("v")), "v", per_positive=10)
    gaps = pairs.join(df.select("rec", F.col("age").alias("a")), "rec").join(df.select(F.col("rec").alias("other"), F.col("age").alias("b")), "other")
    assert gaps.where("abs(a - b) > 2").count() == 0
    n = pairs.groupBy("rec").count().agg(F.max("count")).head()[0]
    assert n <= 10 and pairs.count() == pairs.select("rec", "other").distinct().count()


@pytest.mark.parametrize("text,want", [("Not Latino", "Not Hispanic"), ("non-latino", "Not Hispanic"), ("Not Hispanic or Latino", "Not Hispanic"), ("Hispanic", "Hispanic"),
                                       ("Latino", "Hispanic"), ("Declined", "Unavailable"), (None, "Unavailable"), ("other", "Unavailable")])
def test_ethnicity(spark, text, want):
    df = spark.createDataFrame([(text,)], "e string")
    assert df.select(clean.ethnicity(F.col("e")).alias("x")).first().x == want


def test_anova_f_is_the_textbook_value(spark):
    from hypnolake.operators.models import anova_f

    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 200)
    v = rng.normal(size=200) + 0.5 * y
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, v)], "label int, x double")
    groups = [v[y == k] for k in (0, 1)]
    between = sum(len(g) * (g.mean() - v.mean()) ** 2 for g in groups)
    within = sum(((g - g.mean()) ** 2).sum() for g in groups)
    assert anova_f(df, ["x"]).first().f == pytest.approx(between / (within / 198))


def test_probes_are_out_of_fold(spark):
    """Noise features tell nothing about rows that were not fitted."""
    from hypnolake.operators.models import age_probe, site_probe

    rng = np.random.default_rng(4)
    rows = [(k, f"s{k % 2}", float(50 + rng.integers(0, 30)), *map(float, rng.normal(size=12))) for k in range(120)]
    names = [f"f{i}" for i in range(12)]
    df = spark.createDataFrame(rows, "rec long, site string, age double, " + ", ".join(f"{n} double" for n in names))
    assert age_probe(df, names).first().r2 < 0.15
    got = site_probe(df, names, maxIter=30, regParam=0.01).first()
    assert got.accuracy < 0.68 and abs(got.accuracy - got.balanced_accuracy) < 0.05
