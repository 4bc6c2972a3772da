"""Histogram boosting against a naive version, and the drivers built on it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hypnolake.functions.hashing import hash_fraction
from hypnolake.operators import boosting, models
from hypnolake.operators.ranks import auroc

UNIT = 2.0**26


def rows_of(n=400, seed=5):
    """Two informative features, one of them missing where that tells, one of few values, one of noise."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        y = int(rng.random() < 0.4)
        f = float(np.round(rng.normal(1.2 * y), 2))
        g = None if rng.random() < (0.5 if y else 0.1) else float(rng.normal())
        out.append((i, "abc"[i % 3], float(50 + i % 30), y, f, g, float(rng.integers(0, 4)), float(rng.normal()), float(1 + i % 2)))
    return out


SCHEMA = "rec long, site string, age double, label int, f double, g double, h double, k double, w double"
FEATURES = ["f", "g", "h", "k"]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(rows_of(), SCHEMA)


def naive_fit(bins, y, w, role, base, s):
    """One model by the definition: every leaf, feature, cut and direction tried in turn. Trees as nested tuples."""
    raw = np.full(len(y), base)
    fit = role == 1
    trees, scores = [], []

    def sums(rows):
        p = 1 / (1 + np.exp(-raw[rows]))
        return np.rint(w[rows] * (p - y[rows]) * UNIT).sum() / UNIT, np.rint(w[rows] * p * (1 - p) * UNIT).sum() / UNIT, len(rows)

    def gain(a, b):
        both = [x + z for x, z in zip(a, b)]
        return sum(g * g / (h + s.l2) for g, h in ((a[0], a[1]), (b[0], b[1]))) - both[0] ** 2 / (both[1] + s.l2)

    def best(rows):
        top = None
        for f in range(len(bins)):
            v = bins[f, rows]
            for to_left in (False, True):
                if to_left and not (v == boosting.MISSING).any():
                    continue
                for cut in np.unique(v[v != boosting.MISSING]):
                    left = np.where(v == boosting.MISSING, to_left, v <= cut)
                    a, b = sums(rows[left]), sums(rows[~left])
                    if min(a[2], b[2]) < s.min_rows or min(a[1], b[1]) < s.min_curvature:
                        continue
                    x = gain(a, b)
                    if top is None or x > top[0] + 1e-12:
                        top = (x, f, int(cut), to_left, left)
        return top

    for _ in range(s.rounds):
        held = role == (2 if (role == 2).any() else 1)
        z = raw[held]
        scores.append(-(w[held] * (np.logaddexp(0, z) - y[held] * z)).sum() / w[held].sum())
        if len(scores) > s.patience and max(scores[-s.patience :]) <= scores[-s.patience - 1] + s.tol:
            break
        leaves = [(np.flatnonzero(fit), np.flatnonzero(role > 0), best(np.flatnonzero(fit)))]
        n_splits = 0
        while len(leaves) < s.leaves:
            open_ = [i for i, x in enumerate(leaves) if x[2] is not None and x[2][0] > 0]
            if not open_:
                break
            i = max(open_, key=lambda i: leaves[i][2][0])
            rows, reach, (_, f, cut, to_left, left) = leaves.pop(i)
            if not (bins[f, rows] == boosting.MISSING).any():
                to_left = 2 * left.sum() > len(rows)
            go = np.where(bins[f, reach] == boosting.MISSING, to_left, bins[f, reach] <= cut)
            for part, all_ in ((rows[left], reach[go]), (rows[~left], reach[~go])):
                leaves.append((part, all_, best(part) if len(part) >= 2 * s.min_rows else None))
            n_splits += 1
        if not n_splits:
            break
        step = np.zeros(len(y))
        for part, reach, _ in leaves:
            g, h, _ = sums(part)
            step[reach] = -s.rate * g / (h + s.l2)
        raw = raw + step
        trees.append(sorted(len(part) for part, _, _ in leaves))
    return raw, trees


@pytest.mark.parametrize("settings", [{"rounds": 6, "rate": 0.3, "leaves": 7}, {"rounds": 60, "rate": 0.5, "min_rows": 5, "patience": 3}])
def test_equals_a_naive_version(spark, table, settings):
    s = boosting.Settings(**settings)
    model = boosting.fit(table, FEATURES, [F.lit(True), F.col("site") != "a"], weight="w", settings=s)
    scored = table.select("*", hash_fraction(s.seed, F.col("rec")).alias("u"), boosting.raw_score(model, F.lit(0)).alias("r0"), boosting.raw_score(model, F.lit(1)).alias("r1")).orderBy("rec").collect()
    y, w = np.array([r.label for r in scored], float), np.array([r.w for r in scored])
    values = np.array([[np.nan if r[f] is None else r[f] for f in FEATURES] for r in scored])
    bins = model.bins(values)
    for m, inside in enumerate([np.ones(len(y), bool), np.array([r.site != "a" for r in scored])]):
        role = np.where(inside, np.where(np.array([r.u for r in scored]) < s.validation, 2, 1), 0)
        raw, trees = naive_fit(bins, y, w, role, model.base[m], s)
        assert len(trees) == len(model.trees[m]) and len(trees) >= 3
        got = np.array([r[f"r{m}"] for r in scored])
        assert np.allclose(got[role > 0], raw[role > 0], atol=1e-6)
        assert all(len(t.feature) == 2 * len(n) - 1 for t, n in zip(model.trees[m], trees))
    assert any(t.missing_left.any() for t in model.trees[0])


@pytest.fixture()
def many_blocks(spark):
    """Blocks of 50 rows: a pass is a job over them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_blocks_over_the_cluster_give_the_same_trees(spark, table, monkeypatch, request):
    """One block in tasks; many blocks in jobs, in small passes, with checkpoints."""
    s = boosting.Settings(rounds=4, rate=0.3, min_rows=5)
    members = [F.lit(True), F.col("site") == "a", F.col("site") != "b"]
    a = boosting.fit(table, FEATURES, members, settings=s)
    request.getfixturevalue("many_blocks")
    monkeypatch.setattr(boosting, "SUMS_MB", 0.1)
    monkeypatch.setattr(boosting, "CHECKPOINT_EVERY", 2)
    monkeypatch.setattr(boosting, "_fit_here", None)
    b = boosting.fit(table.repartition(7), FEATURES, members, settings=s)
    assert a.base == b.base and [len(t) for t in a.trees] == [len(t) for t in b.trees]
    assert all((np.sort(x.value) == np.sort(z.value)).all() and sorted(x.feature) == sorted(z.feature) for p, q in zip(a.trees, b.trees, strict=True) for x, z in zip(p, q, strict=True))


def test_isotonic_pools_meet(spark):
    rng = np.random.default_rng(2)
    rows = [(m, float(np.round(x, 2)), float(rng.random() < x), float(1 + i % 2)) for m in (0, 3) for i, x in enumerate(rng.random(300))]
    df = spark.createDataFrame(rows, "model int, score double, label double, weight double")
    maps = boosting.isotonic(df.repartition(5))
    assert set(maps) == {0, 3}
    for m, (x, v) in maps.items():
        mine = sorted({r[1] for r in rows if r[0] == m})
        tot = np.array([sum(r[2] * r[3] for r in rows if r[:2] == (m, z)) for z in mine])
        wt = np.array([sum(r[3] for r in rows if r[:2] == (m, z)) for z in mine])
        # the minimum over later ends of the maximum over earlier starts of block means
        ct, cw = np.r_[0, tot.cumsum()], np.r_[0, wt.cumsum()]
        mean = lambda i, j: (ct[j + 1] - ct[i]) / (cw[j + 1] - cw[i])
        want = [max(min(mean(i, j) for j in range(k, len(mine))) for i in range(k + 1)) for k in range(len(mine))]
        assert np.allclose(np.interp(mine, x, v), want) and (np.diff(v) >= 0).all()


def test_sets_calibrate_and_learn(spark, table):
    sets = models.fit_sets(table, FEATURES, {"all": F.lit(True), "few": F.col("rec") < 12, "one class": F.col("label") == 0}, rounds=30)
    assert [len(sets.parts[n]) for n in ("all", "few", "one class")] == [3, 1, 1] and len(sets.maps) == 3
    got = table.withColumn("prob", sets.prob(F.lit("all")))
    lo, hi = got.agg(F.min("prob"), F.max("prob")).first()
    assert 0 <= lo < hi <= 1 and auroc(got, [], "prob", "label").first().auroc > 0.8
    one = table.select(sets.prob(F.lit("one class")).alias("p"), sets.prob(F.lit("none")).alias("q"), sets.probs(["all", "few"]).alias("r")).first()
    assert one.p < 1e-6 and one.q == 0 and len(one.r) == 2


def test_drivers_share_one_fit(spark, table):
    """Every row of a driver is scored by models that have not seen it."""
    kw = {"rounds": 20, "min_rows": 10}
    oof = models.loso(table, FEATURES, **kw)
    assert oof.count() == 400 and {r.site for r in models.fold_metrics(oof, oof).collect()} == {"a", "b", "c", "all"}
    alone = models.fit_classifier(table.where("site <> 'b'"), FEATURES, **kw).transform(table.where("site = 'b'"))
    assert auroc(alone, [], "prob", "label").first().auroc > 0.65 and auroc(oof, [], "prob", "label").first().auroc > 0.65
    noise = table.withColumn("label", (F.hash("rec") % 2 == 0).cast("int"))
    rep = models.repeated_oof(noise, FEATURES, k=3, repeats=2, strata=["site", "label"], **kw)
    assert rep.count() == 400 and rep.agg(F.min("n_oof"), F.max("n_oof")).first()[:] == (2, 2)
    assert abs(auroc(rep, [], "prob", "label").first().auroc - 0.5) < 0.12
    curve = {r.fraction: r for r in models.learning_curve(table, FEATURES, [0.3, 1.0], [1, 2], **kw).collect()}
    assert set(curve) == {0.3, 1.0} and all(r.n_seeds == 2 for r in curve.values()) and curve[1.0]["mean"] > 0.65


def test_site_models_route_in_one_pass(spark, table):
    m = models.fit_site_models(table, FEATURES, min_n=40, override=["a"], rounds=15)
    assert set(m.experts) == {"a", "b", "c"} and set(m.overrides) == {"a"}
    unseen = table.withColumn("site", F.lit("new"))
    pick = lambda df: {r.rec: r.prob for r in df.collect()}
    assert pick(m.transform(unseen)) == pick(m.overall.transform(unseen))
    assert pick(m.transform(table.where("site = 'b'"))) == pick(m.experts["b"].transform(table.where("site = 'b'")))
    router = models.fit_router(table, FEATURES, maxIter=30, regParam=0.01)
    lo, hi = models.routed_prediction(table, router, m, FEATURES).agg(F.min("prob"), F.max("prob")).first()
    assert 0 <= lo < hi <= 1


def test_missing_everything_and_empty(spark, table):
    none = table.withColumn("f", F.lit(None).cast("double"))
    s = models.fit_sets(none, ["f", "h"], {"all": F.lit(True)}, rounds=3)
    assert none.select(s.prob(F.lit("all")).alias("p")).agg(F.count("p")).first()[0] == 400
    empty = boosting.fit(table.limit(0), FEATURES, [F.lit(True)])
    assert empty.trees == [[]] and empty.base[0] == 0


def test_risk_trend(spark):
    """Rank correlation, its p and the tertile means, against their definitions."""
    import math

    from hypnolake.functions.tails import beta_inc

    rng = np.random.default_rng(9)
    rows = [(g, float(rng.integers(0, 40)), None) for g in "ab" for _ in range(90)]
    rows = [(g, t, float(np.round(rng.random() - (0.01 * t if g == "a" else 0), 2))) for g, t, _ in rows] + [("a", None, 0.5), ("a", 3.0, None), (None, 1.0, 1.0)]
    got = {r.g: r for r in models.risk_trend(spark.createDataFrame(rows, "g string, t double, prob double"), "g", "t").collect()}
    assert set(got) == {"a", "b"} and got["a"].rho < -0.2
    rank = lambda v: np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
    for g in "ab":
        t, p = (np.array([r[i] for r in rows if r[0] == g and r[1] is not None and r[2] is not None]) for i in (1, 2))
        rho = np.corrcoef(rank(t), rank(p))[0, 1]
        z = rho * math.sqrt((len(t) - 2) / (1 - rho * rho))
        assert got[g].n == len(t) and got[g].rho == pytest.approx(rho) and got[g].p == pytest.approx(beta_inc((len(t) - 2) / 2, 0.5, (len(t) - 2) / (len(t) - 2 + z * z)))
        a, b = np.quantile(t, [1 / 3, 2 / 3])
        assert got[g].mean_risk_third_1 == pytest.approx(p[t <= a].mean()) and got[g].mean_risk_third_3 == pytest.approx(p[t > b].mean())


def test_models_of_many_blocks_grow_in_tasks(spark, table, monkeypatch, request):
    """Up to ``TASK_MB`` no pass is a job, however many blocks there are; the trees are those of the passes."""
    s = boosting.Settings(rounds=4, rate=0.3, min_rows=5)
    members = [F.lit(True), F.col("site") == "a", F.lit(False)]
    request.getfixturevalue("many_blocks")
    with monkeypatch.context() as m:
        m.setattr(boosting, "TASK_MB", 0)
        m.setattr(boosting, "_fit_here", None)
        a = boosting.fit(table.repartition(7), FEATURES, members, settings=s)
    monkeypatch.setattr(boosting, "_Spread", None)
    b = boosting.fit(table.repartition(7), FEATURES, members, settings=s)
    assert a.base == b.base and [len(t) for t in a.trees] == [len(t) for t in b.trees] == [4, 4, 0]
    assert all((np.sort(x.value) == np.sort(z.value)).all() for p, q in zip(a.trees, b.trees) for x, z in zip(p, q))


def test_leaf_masks_equal_routes():
    """A tree of 32 leaves and smaller ones, packed and read again."""
    rng = np.random.default_rng(4)
    for leaves in (1, 2, 9, 32):
        size = 2 * leaves - 1
        t = boosting.Tree(np.full(size, -1, "int32"), rng.integers(0, 255, size).astype("u1"), rng.random(size) < 0.5, np.zeros(size, "int32"), np.zeros(size, "int32"), rng.normal(size=size))
        ends = [0]
        for k in range(1, size, 2):
            at = ends.pop(int(rng.integers(len(ends))))
            t.feature[at], t.left[at], t.right[at] = rng.integers(0, 3), k, k + 1
            ends += [k, k + 1]
        x = rng.integers(0, 256, (3, 3000)).astype("u1")
        want = t.value[t.route(x)]
        u, v = boosting.unpack(boosting.pack([t, t]))
        assert (boosting._leaf_values(t, x.astype("int64")) == want).all() and (u.value[v.route(x)] == want).all()


def test_rows_follow_splits_alone(monkeypatch):
    """A task's model never sends all rows through a tree again: a split reads its own node's rows. Sums and scores are those of routed rows."""
    rng = np.random.default_rng(8)
    x, y = np.asfortranarray(rng.integers(0, 256, (4, 3000)).astype("u1")), rng.integers(0, 2, 3000).astype("f8")
    w, s = rng.random(3000) + 0.5, boosting.Settings(rounds=3, rate=0.3, min_rows=5)
    held = tuple(a[..., 2500:] for a in (x, y, w))
    route, routed = boosting.Tree.route, []
    monkeypatch.setattr(boosting.Tree, "route", lambda t, v, start=None: routed.append(v.shape[1]) or route(t, v, start))
    here = boosting._Here(tuple(a[..., :2500] for a in (x, y, w)), held)
    base, tot = here.begin()
    trees = boosting._boost(here, tot, 4, s)[0]
    assert len(trees) == 3 and max(len(t.feature) for t in trees) == 61 and sum(routed) == 0
    for role, at in ((1, slice(2500)), (2, slice(2500, None))):
        assert np.allclose(here.raw[role], base[0] + sum(t.value[route(t, x[:, at])] for t in trees), atol=1e-12)
    last = boosting._gradients(base[0] + sum(t.value[route(t, x[:, :2500])] for t in trees[:2]), y[:2500], w[:2500])
    end = route(trees[2], x[:, :2500])
    for k in np.unique(end):
        g, h = (v[end == k].sum() / 2.0**26 for v in last)
        assert trees[2].value[k] == pytest.approx(-s.rate * g / (h + s.l2), abs=1e-6)


def test_rows_are_dealt_by_ranges_of_models(spark):
    """Few parts read a model, a single model's rows still go to all parts, and rows without a model or twice the same stay."""
    n = 2 * spark.sparkContext.defaultParallelism
    each = spark.range(12_000).select((F.col("id") % 60).alias("v"), F.when(F.col("id") % 41 > 0, F.col("id") % 40).alias("m"))
    for df, most in ((each, 41 + n), (each.withColumn("m", F.lit("all")), n)):
        got = boosting.dealt(df, F.col("m"))
        assert got.columns == ["v", "m"] and not got.exceptAll(df).count() and not df.exceptAll(got).count()
        part = got.select("m", F.spark_partition_id().alias("p"))
        assert part.distinct().count() <= most and n / 2 <= part.select("p").distinct().count() <= n
