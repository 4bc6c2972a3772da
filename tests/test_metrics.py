import numpy as np
import pandas as pd
import pytest

from hypnolake.operators import metrics as m


@pytest.fixture(scope="module")
def people(spark):
    rng = np.random.default_rng(3)
    n = 160
    pdf = pd.DataFrame({
        "rec": np.arange(n), "site": rng.choice(["a", "b", "c"], n, p=[0.7, 0.2, 0.1]), "age": rng.integers(55, 75, n).astype(float),
        "label": rng.integers(0, 2, n), "prob": rng.integers(0, 20, n) / 20, "t": rng.integers(1, 12, n).astype(float),
    })
    pdf["pred"] = (pdf.prob > 0.5).astype(int)
    return pdf, spark.createDataFrame(pdf)


def prev_of(pdf, ages, gap=2):
    return {a: max(pdf.label[abs(pdf.age - a) <= gap].sum(), 0.5) / (abs(pdf.age - a) <= gap).sum() for a in ages}


def reward_of(pdf, pred, prev):
    n = len(pdf)
    s = 0.0
    for y, p, a in zip(pdf.label, pred, pdf.age):
        q = min(max(prev[a], 0.5 / n), 1 - 0.5 / n)
        s += (1 / q - 1) if y == p == 1 else (1 / (1 - q) - 1) if y == p == 0 else -1
    return s / n


def test_reward_and_prevalence(people, mode):
    pdf, df = people
    want = prev_of(pdf, pdf.age.unique())
    got = {r.age: r.prevalence for r in m.prevalence(df, df).collect()}
    assert got == pytest.approx(want)
    assert m.reward(df, m.prevalence(df, df)).collect()[0].reward == pytest.approx(reward_of(pdf, pdf.pred, want))


def test_single_class_prevalence_is_clipped(spark):
    df = spark.createDataFrame([(60.0, 0, 0, 0.1), (60.0, 0, 1, 0.9), (None, 1, 1, 0.9)], "age double, label int, pred int, prob double")
    r = m.reward(df, m.prevalence(df, df)).collect()[0]
    p = 0.5 / 2
    assert r.n_scored == 2 and r.reward == pytest.approx(((1 / (1 - p) - 1) - 1) / 2)


def test_age_conditioned_auroc(people, mode):
    pdf, df = people
    p, n = pdf[pdf.label == 1], pdf[pdf.label == 0]
    near = abs(p.age.to_numpy()[:, None] - n.age.to_numpy()[None]) <= 2
    win = (p.prob.to_numpy()[:, None] > n.prob.to_numpy()[None]) + 0.5 * (p.prob.to_numpy()[:, None] == n.prob.to_numpy()[None])
    r = m.auroc_age(df).collect()[0]
    assert r.pairs == near.sum() and r.auroc_age == pytest.approx(win[near].mean())


def test_pair_gate_and_empty(spark):
    rows = [(60.0, 1, 0.5), (70.0, 1, 0.2), (61.0, 0, 0.5), (75.0, 0, 0.9), (None, 0, 0.1)]
    df = spark.createDataFrame(rows, "age double, label int, prob double")
    r = m.auroc_age(df).collect()[0]
    assert (r.pairs, r.auroc_age) == (1, 0.5)
    assert m.auroc_age(df.where("age > 65")).collect()[0].auroc_age is None


def test_weighted_auroc(people, mode):
    pdf, df = people
    num = den = 0.0
    for k in np.arange(pdf.age.min() - 2, pdf.age.max() + 3):
        w = pdf[abs(pdf.age - k) <= 2]
        p, n = w[w.label == 1].prob.to_numpy()[:, None], w[w.label == 0].prob.to_numpy()[None]
        if p.size and n.size:
            num += len(w) * ((p > n) + 0.5 * (p == n)).mean()
            den += len(w)
    assert m.auroc_age_weighted(df).collect()[0].auroc_weighted == pytest.approx(num / den)


def test_c_index(people, mode):
    pdf, df = people
    conc = comp = 0.0
    t, e, r = pdf.t.to_numpy(), pdf.label.to_numpy(), pdf.prob.to_numpy()
    for i in np.flatnonzero(e == 1):
        later = t > t[i]
        comp += later.sum()
        conc += (r[i] > r[later]).sum() + 0.5 * (r[i] == r[later]).sum()
        same = (t == t[i]) & (e == 1) & (np.arange(len(t)) > i)
        comp += same.sum()
        conc += 0.5 * (r[i] == r[same]).sum()
    got = m.c_index(df, "t", "label", "prob").collect()[0]
    assert got.comparable == comp and got.c_index == pytest.approx(conc / comp)


def test_reward_thresholds(people, mode):
    pdf, df = people
    prev = prev_of(pdf, pdf.age.unique())
    grid = np.linspace(0.01, 0.5, 80)

    def best(part):
        scores = [round(reward_of(part, (part.prob > t).astype(int), prev), 12) for t in grid]
        return grid[int(np.argmax(scores))]

    got = {(r.level, r.site, r.decade): r.threshold for r in m.fit_reward_thresholds(df).collect()}
    want = {("global", "", -1): best(pdf)}
    pdf = pdf.assign(dec=(pdf.age // 10 * 10).astype(int))
    for d, part in pdf.groupby("dec"):
        if len(part) >= 25 and part.label.nunique() == 2:
            want[("decade", "", d)] = best(part)
        for s, sub in part.groupby("site"):
            if len(sub) >= 25 and sub.label.nunique() == 2:
                want[("site_decade", s, d)] = best(sub)
    assert got == pytest.approx(want)


def test_thresholds_resolve_in_order(spark):
    thr = spark.createDataFrame([("global", "", -1, 0.5), ("decade", "", 60, 0.3), ("site_decade", "a", 60, 0.2)], "level string, site string, decade int, threshold double")
    df = spark.createDataFrame([(1, "a", 61.0, 0.25), (2, "b", 65.0, 0.25), (3, "a", 71.0, 0.6), (4, "a", None, None)], "rec int, site string, age double, prob double")
    got = {r.rec: (r.threshold, r.pred) for r in m.apply_thresholds(df, thr).collect()}
    assert got == {1: (0.2, 1), 2: (0.3, 0), 3: (0.5, 1), 4: (0.5, 0)}


def test_age_rule_is_bayes_optimal(spark):
    """Predicting where the true risk exceeds the age prevalence maximises expected reward."""
    q, p = 0.3, 0.25
    gain_yes = q * (1 / p - 1) - (1 - q)
    gain_no = (1 - q) * (1 / (1 - p) - 1) - q
    assert (gain_yes > gain_no) == (q > p)


def test_grid_bucket_edges(spark):
    probs = [0.0, 0.01, 0.0100001, 0.25, 0.5, 0.50001, 1.0, *np.linspace(0.01, 0.5, 80)]
    df = spark.createDataFrame([(float(x),) for x in probs], "p double")
    got = [r.b for r in df.select(m.grid_bucket(df.p).alias("b")).collect()]
    assert got == [int((x > np.array(m.GRID)).sum()) for x in probs]


def test_missing_predictions_count_as_zero(spark):
    lab = spark.createDataFrame([(1, 1), (2, 0), (3, None)], "rec int, label int")
    pred = spark.createDataFrame([(1, 7, float("nan"))], "rec int, pred int, prob double")
    got = {r.rec: (r.pred, r.prob) for r in m.align_predictions(lab, pred, ["rec"]).collect()}
    assert got == {1: (0, 0.0), 2: (0, 0.0)}
