"""Classifiers, calibration, site experts and evaluation drivers: boosting of our own, the rest on MLlib.

A feature table is wide: key, site, age, label and numeric feature columns. The boosted models of all sites, folds, repeats and
calibration parts of a driver are fitted in one run (``fit_sets``) and each row is scored once per model it needs.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import PCA, Imputer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_fraction, hash_key
from ..session import cut_lineage
from . import boosting, metrics as m
from .cohort import permuted, stratified_folds
from .ranks import auroc

LOGIT = {"maxIter": 100, "regParam": 0.0}


def training_table(df: DataFrame) -> DataFrame:
    """Written once, in evenly sized files: iterative fits scan it many times."""
    return cut_lineage(df.hint("rebalance"))


def with_flags(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """NaN to NULL, and one missing-indicator per feature (MLlib has no missing branch)."""
    clean = {f: F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")) for f in features}
    return df.withColumns(clean).withColumns({f"{f}__na": F.col(f).isNull().cast("double") for f in features})


def preparation(features: Sequence[str], scale: bool) -> list:
    filled = [f"{f}__f" for f in features]
    stages = [
        Imputer(strategy="median", inputCols=list(features), outputCols=filled),
        VectorAssembler(inputCols=[*filled, *[f"{f}__na" for f in features]], outputCol="_x"),
    ]
    return stages + [StandardScaler(inputCol="_x", outputCol="_z", withMean=True)] if scale else stages


def class_weight(df: DataFrame, label: str = "label") -> Column:
    """Balanced weights n / (2 n_class) from one two-row aggregate."""
    n = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    total = sum(n.values())
    return F.when(F.col(label) == 1, total / (2.0 * max(n.get(1, 0), 1))).otherwise(total / (2.0 * max(n.get(0, 0), 1)))


def base_pipeline(kind: str, features: Sequence[str], weight: str | None, **params) -> Pipeline:
    extra = {"weightCol": weight} if weight else {}
    if kind == "logit":
        clf, scale = LogisticRegression(featuresCol="_z", labelCol="label", **{**LOGIT, **params}, **extra), True
    elif kind == "forest":
        clf, scale = RandomForestClassifier(featuresCol="_x", labelCol="label", **{"seed": 42, **params}, **extra), False
    else:
        raise ValueError(f"unknown model kind {kind!r}")
    return Pipeline(stages=[*preparation(features, scale), clf])


@dataclass
class Classifier:
    """Base models, each with an optional isotonic map; the probability is their mean."""

    features: list[str]
    parts: list = field(default_factory=list)  # (PipelineModel, isotonic model or None)

    def transform(self, df: DataFrame, out: str = "prob") -> DataFrame:
        kept = list(df.columns)
        cur = with_flags(df, self.features)
        names = []
        for i, (base, iso) in enumerate(self.parts):
            p = f"_p{i}"
            scored = base.transform(cur)
            scored = scored.withColumn(p, vector_to_array("probability")[1])
            cur = scored.select(*cur.columns, p)
            if iso is not None:
                cal = iso.setFeaturesCol(p).setPredictionCol(f"_c{i}").transform(cur)
                cur = cal.withColumn(p, F.col(f"_c{i}")).drop(f"_c{i}")
            names.append(p)
        mean = reduce(lambda a, b: a + b, [F.col(n) for n in names]) / len(names)
        return cur.withColumn(out, F.coalesce(F.when(~F.isnan(mean), mean), F.lit(0.0))).select(*[c for c in kept if c != out], out)

    def save(self, path: str) -> None:
        for i, (base, iso) in enumerate(self.parts):
            base.write().overwrite().save(f"{path}/part{i}/base")
            if iso is not None:
                iso.write().overwrite().save(f"{path}/part{i}/isotonic")


# ------------------------------------------------------------------ boosted sets (M1, M2)
@dataclass
class BoostedSets:
    """Boosted models of several training sets, fitted together: a set's probability is the mean over its parts' (calibrated) ones."""

    model: boosting.Boosted
    parts: dict[str, list[int]]  # model numbers by set
    maps: dict[int, tuple[np.ndarray, np.ndarray]]  # isotonic maps by model number

    def _prob(self, bins: np.ndarray, name: str) -> np.ndarray:
        each = []
        for k in self.parts[name]:
            raw = self.model.raw(bins, k)
            each.append(np.interp(raw, *self.maps[k]) if k in self.maps else 1 / (1 + np.exp(-raw)))
        return np.mean(each, axis=0)

    def prob(self, name: Column) -> Column:
        """Probability by the set each row names; 0 where it names none."""

        @F.pandas_udf("double")
        def score(x: pd.Series, names: pd.Series) -> pd.Series:
            bins, out = self.model.bins(boosting.matrix(x, len(self.model.features))), np.zeros(len(x))
            for n in names.dropna().unique():
                if n in self.parts:
                    rows = np.flatnonzero((names == n).to_numpy())
                    out[rows] = self._prob(bins[:, rows], n)
            return pd.Series(out)

        return score(boosting.vector(self.model.features), name)

    def scored(self, df: DataFrame, name: Column, out: str = "prob") -> DataFrame:
        """``df`` with ``prob`` in column ``out``."""
        named = boosting.dealt(df.withColumn("_set", name), F.col("_set"))
        return named.withColumn(out, self.prob(F.col("_set"))).drop("_set")

    def probs(self, names: Sequence[str]) -> Column:
        """Array of every named set's probability."""

        @F.pandas_udf("array<double>")
        def score(x: pd.Series) -> pd.Series:
            bins = self.model.bins(boosting.matrix(x, len(self.model.features)))
            return pd.Series(list(np.array([self._prob(bins, n) for n in names]).T))

        return score(boosting.vector(self.model.features))


@dataclass
class BoostedSet:
    """One of the sets, used like any classifier."""

    sets: BoostedSets
    name: str

    def transform(self, df: DataFrame, out: str = "prob") -> DataFrame:
        return self.sets.scored(df, F.lit(self.name), out)


def fit_sets(train: DataFrame, features: Sequence[str], sets: dict[str, Column], weight: str | None = None, calibrate: bool = True, key: str = "rec", folds: int = 3, **settings) -> BoostedSets:
    """A boosted model per set of rows, all in one run.

    Sets with 3 rows of the rarer class and 30 rows get a part per fold, fitted without it, and the fold's rows an isotonic map of the part's scores.
    """
    features, names = list(features), list(sets)
    data = train.where(F.col("label").isin(0, 1))
    fold = F.lit(-1)
    if calibrate:
        data = data.join(stratified_folds(data, key, ["label"], folds).select(key, F.col("fold").alias("_fold")), key)
        fold = F.col("_fold")
    data = training_table(data.withColumn("_sets", F.array(*[F.coalesce(sets[n], F.lit(False)) for n in names])))
    inside = [F.get("_sets", F.lit(i)) for i in range(len(names))]
    each = data.select(F.col("label").cast("int").alias("y"), F.posexplode("_sets").alias("i", "inside")).where("inside")
    n = {(r.i, r.y): r["count"] for r in each.groupBy("i", "y").count().collect()}  # two rows a set
    parts: dict[str, list[int]] = {}
    members: list[Column] = []
    held: list[Column] = []  # the rows a calibrated part has not seen
    for i, name in enumerate(names):
        neg, pos = n.get((i, 0), 0), n.get((i, 1), 0)
        split = calibrate and min(neg, pos) >= 3 and neg + pos >= 30
        parts[name] = list(range(len(members), len(members) + (folds if split else 1)))
        for f in range(folds) if split else [None]:
            members.append(inside[i] if f is None else inside[i] & (fold != f))
            held.append(F.lit(False) if f is None else inside[i] & (fold == f))
    model = boosting.fit(data, features, members, weight=weight, key=key, settings=boosting.Settings(**settings))
    if not any(len(p) > 1 for p in parts.values()):
        return BoostedSets(model, parts, {})
    numbers = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in enumerate(held)]), lambda k: k.isNotNull())
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    each = data.select("label", w.alias("weight"), *features, F.explode(numbers).alias("model"))
    each = boosting.dealt(each, F.col("model"))
    scored = each.select("model", "label", "weight", boosting.raw_score(model, F.col("model")).alias("score"))
    return BoostedSets(model, parts, boosting.isotonic(scored))


def fit_classifier(train: DataFrame, features: Sequence[str], kind: str = "boost", weight: str | None = None, calibrate: bool = True, key: str = "rec", folds: int = 3, **params) -> Classifier | BoostedSet:
    """Base model; with 3 rows of the rarer class and 30 rows, isotonic maps from held-out folds instead."""
    features = list(features)
    if kind == "boost":
        return BoostedSet(fit_sets(train, features, {"all": F.lit(True)}, weight, calibrate, key, folds, **params), "all")
    n = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    rare = min(n.get(0, 0), n.get(1, 0))
    data = with_flags(train, features)
    pipe = base_pipeline(kind, features, weight, **params)
    if not calibrate or rare < 3 or sum(n.values()) < 30:
        return Classifier(features, [(pipe.fit(data), None)])
    k = min(folds, rare)
    fold = stratified_folds(train, key, ["label"], k)
    data = training_table(data.join(fold.select(key, "fold"), key))
    parts = []
    for f in range(k):
        base = pipe.fit(data.where(F.col("fold") != f))
        held = base.transform(data.where(F.col("fold") == f)).select("label", vector_to_array("probability")[1].alias("_p"))
        iso = IsotonicRegression(featuresCol="_p", labelCol="label").fit(held.withColumn("label", F.col("label").cast("double")))
        parts.append((base, iso))
    return Classifier(features, parts)


# ------------------------------------------------------------------ site experts (M3, M4)
@dataclass
class SiteModels:
    """Global model, one expert per large enough site, optional override heads."""

    overall: Classifier | BoostedSet
    experts: dict[str, Classifier | BoostedSet]
    overrides: dict[str, Classifier | BoostedSet] = field(default_factory=dict)

    def transform(self, df: DataFrame, site: str = "site", out: str = "prob") -> DataFrame:
        chosen = {**self.experts, **self.overrides}
        if isinstance(self.overall, BoostedSet):
            name = F.lit(self.overall.name)
            for s, c in chosen.items():
                name = F.when(F.col(site) == s, F.lit(c.name)).otherwise(name)
            return self.overall.sets.scored(df, name, out)
        rest = df.where(~F.col(site).isin(*chosen)) if chosen else df
        parts = [self.overall.transform(rest, out)] + [c.transform(df.where(F.col(site) == s), out) for s, c in chosen.items()]
        return reduce(DataFrame.unionByName, parts)


def site_sizes(df: DataFrame, site: str = "site") -> dict[str, tuple[int, int]]:
    """n and positives per site (one row per hospital)."""
    rows = df.groupBy(site).agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("p")).collect()
    return {r[site]: (r["n"], r["p"]) for r in rows}


def fit_site_models(train: DataFrame, features: Sequence[str], site: str = "site", min_n: int = 40, override: Sequence[str] = (), **kw) -> SiteModels:
    train = training_table(train)
    big = [s for s, (n, p) in sorted(site_sizes(train, site).items()) if n >= min_n and 0 < p < n]
    if kw.get("kind", "boost") == "boost":
        kw.pop("kind", None)
        fitted = fit_sets(train, features, {"all": F.lit(True), **{f"site {s}": F.col(site) == s for s in big}}, **kw)
        experts = {s: BoostedSet(fitted, f"site {s}") for s in big}
        return SiteModels(BoostedSet(fitted, "all"), experts, {s: experts[s] for s in override if s in experts})
    overall = fit_classifier(train, features, **kw)
    experts = {s: fit_classifier(train.where(F.col(site) == s), features, **kw) for s in big}
    return SiteModels(overall, experts, {s: experts[s] for s in override if s in experts})  # the head is the site's own expert


def fit_router(train: DataFrame, features: Sequence[str], site: str = "site", **params) -> tuple[PipelineModel, list[str]]:
    """Multiclass site classifier whose probabilities weigh the experts."""
    idx = StringIndexer(inputCol=site, outputCol="_site")
    clf = LogisticRegression(featuresCol="_z", labelCol="_site", probabilityCol="_ps", rawPredictionCol="_rs", predictionCol="_s", **{**LOGIT, **params})
    model = Pipeline(stages=[idx, *preparation(features, True), clf]).fit(with_flags(train, features))
    return model, list(model.stages[0].labels)


def routed_prediction(df: DataFrame, router: tuple[PipelineModel, list[str]], models: SiteModels, features: Sequence[str], soft: bool = True, site: str = "site") -> DataFrame:
    """Blend expert probabilities by site probability, or take the likeliest site's expert.

    The indexer's site column is bypassed, so unseen sites can be scored.
    """
    model, labels = router
    cur = with_flags(df, features)
    for stage in model.stages[1:]:
        cur = stage.transform(cur)
    cur = cur.select(*df.columns, vector_to_array("_ps").alias("_w"))
    used = [models.experts.get(s, models.overall) for s in labels]
    if isinstance(models.overall, BoostedSet):
        cur = boosting.dealt(cur).withColumn("_each", models.overall.sets.probs([c.name for c in used]))
    else:
        for i, c in enumerate(used):
            cur = c.transform(cur, f"_e{i}")
        cur = cur.withColumn("_each", F.array(*[F.col(f"_e{i}") for i in range(len(labels))])).drop(*[f"_e{i}" for i in range(len(labels))])
    each = F.col("_each")
    if soft:
        prob = F.aggregate(F.zip_with("_w", each, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    else:
        prob = F.get(each, F.array_position("_w", F.array_max("_w")).cast("int") - 1)
    return cur.withColumn("prob", prob).drop("_w", "_each")


# ------------------------------------------------------------------ pairwise ranker (M6)
def age_matched_pairs(df: DataFrame, vector: str, key: str = "rec", gap: float = 2, per_positive: int = 40, seed: int = 42) -> DataFrame:
    """Feature differences of positives against up to ``per_positive`` negatives within ``gap`` years.

    Negatives sorted by (age, hash) get places; a positive's eligible negatives are one run of
    places, read off the same cumulated axis. A seeded systematic sample of that run is fetched by
    an equi-join on place, so pairs are never listed and ages may be continuous.
    """
    from .ranks import cumulate

    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    mark = lambda x, tie, h: F.struct(x.cast("double").alias("x"), F.lit(tie).alias("tie"), h.alias("h")).alias("_pos")
    pos = df.where("label = 1").select(key, F.col("age").cast("double").alias("age"), F.col(vector).alias("_x"))
    neg = df.where("label = 0 AND age IS NOT NULL").select(F.col(key).alias("other"), "age", F.col(vector).alias("_y"))
    none_q, none_k = F.lit(None).cast("double").alias("_q"), F.lit(None).cast(df.schema[key].dataType).alias("other")
    axis = neg.select(mark(F.col("age"), 0, hash_key(seed, F.col("other"))), none_q, "other", one.alias("n"))
    ages = pos.where("age IS NOT NULL").select("age").distinct()
    for tie, x in ((-1, F.col("age") - gap), (1, F.col("age") + gap)):
        axis = axis.unionByName(ages.select(mark(x, tie, F.lit("")), F.col("age").alias("_q"), none_k, zero.alias("n")))
    cum = training_table(cumulate(axis, [], "_pos").select("_pos", "_q", "other", "cum_n"))
    places = cum.where("other IS NOT NULL").select("other", F.col("cum_n").alias("place"))
    tie = F.col("_pos.tie")
    run = cum.where("_q IS NOT NULL").groupBy(F.col("_q").alias("age")).agg(
        F.max(F.when(tie == -1, F.col("cum_n"))).alias("_lo"), F.max(F.when(tie == 1, F.col("cum_n"))).alias("_hi")
    ).withColumn("_n", F.col("_hi") - F.col("_lo")).where("_n > 0")
    k = F.least(F.col("_n"), F.lit(per_positive).cast("long"))
    start = F.floor(hash_fraction(f"{seed}s", F.col(key)) * F.col("_n"))
    want = pos.join(run, "age").withColumn("_s", start).withColumn("_k", k).withColumn("_j", F.explode(F.sequence(zero, k - 1)))
    place = F.col("_lo") + 1 + (F.col("_s") + F.floor(F.col("_j") * F.col("_n") / F.col("_k"))) % F.col("_n")
    j = want.withColumn("place", place).join(places, "place").join(neg.select("other", "_y"), "other")
    return j.select(key, "other", F.zip_with("_x", "_y", lambda a, b: a - b).alias("diff"))


@dataclass
class PairwiseRanker:
    prep: PipelineModel
    features: list[str]
    weights: list[float]
    slope: float
    intercept: float

    def transform(self, df: DataFrame, out: str = "prob") -> DataFrame:
        z = self.prep.transform(with_flags(df, self.features)).withColumn("_v", vector_to_array("_z"))
        w = F.array(*[F.lit(float(x)) for x in self.weights])
        s = F.aggregate(F.zip_with("_v", w, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        return z.withColumn(out, 1 / (1 + F.exp(-(self.slope * s + self.intercept)))).select(*[c for c in df.columns if c != out], out)


def fit_pairwise(train: DataFrame, features: Sequence[str], gap: float = 2, per_positive: int = 40, key: str = "rec", reg: float = 0.01) -> PairwiseRanker:
    """Logistic on +-differences without intercept, then a logistic scale of the training scores."""
    features = list(features)
    prep = Pipeline(stages=preparation(features, True)).fit(with_flags(train, features))
    z = training_table(prep.transform(with_flags(train, features)).select(key, "age", "label", vector_to_array("_z").alias("v")))
    d = age_matched_pairs(z, "v", key, gap, per_positive)
    both = d.select("diff", F.lit(1.0).alias("label")).unionByName(d.select(F.transform("diff", lambda x: -x).alias("diff"), F.lit(0.0).alias("label")))
    rk = LogisticRegression(featuresCol="_d", labelCol="label", fitIntercept=False, maxIter=200, regParam=reg).fit(both.select(array_to_vector("diff").alias("_d"), "label"))
    w = rk.coefficients.toArray().tolist()
    s = F.aggregate(F.zip_with("v", F.array(*[F.lit(x) for x in w]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    platt = LogisticRegression(featuresCol="_s", labelCol="label", maxIter=200).fit(z.select(array_to_vector(F.array(s)).alias("_s"), F.col("label").cast("double").alias("label")))
    return PairwiseRanker(prep, features, w, float(platt.coefficients[0]), float(platt.intercept))


# ------------------------------------------------------------------ jobs and drivers
@dataclass
class Trained:
    models: SiteModels
    imputer: DataFrame | None
    thresholds: DataFrame
    features: list[str]


def train_job(table: DataFrame, features: Sequence[str], bmi: str | None = None, **kw) -> Trained:
    """Impute BMI, fit site models, fit reward thresholds on in-sample probabilities."""
    from .harmonize import impute, site_median_imputer

    rows = m.labelled(table)
    imp = training_table(site_median_imputer(rows, bmi)) if bmi else None
    filled = impute(rows, imp, bmi) if bmi else rows
    models = fit_site_models(filled, features, **kw)
    return Trained(models, imp, m.fit_reward_thresholds(models.transform(filled)), list(features))


def score_job(table: DataFrame, trained: Trained, bmi: str | None = None) -> DataFrame:
    """Probabilities (0 where a model gives none) and thresholded predictions."""
    from .harmonize import impute

    filled = impute(table, trained.imputer, bmi) if bmi and trained.imputer is not None else table
    return m.apply_thresholds(trained.models.transform(filled), trained.thresholds)


def loso(table: DataFrame, features: Sequence[str], site: str = "site", kind: str = "boost", key: str = "rec", **kw) -> DataFrame:
    """Out-of-fold rows: every site scored by a model of the other sites (single-class train folds are skipped).

    Boosted models of all folds are fitted in one run and the rows scored in one pass.
    """
    rows = training_table(m.labelled(table))
    sizes = site_sizes(rows, site)
    n_all, p_all = sum(n for n, _ in sizes.values()), sum(p for _, p in sizes.values())
    usable = {s: (p_all - p) / (n_all - n) for s, (n, p) in sorted(sizes.items()) if 0 < p_all - p < n_all - n}
    if kind == "boost":
        fitted = fit_sets(rows, features, {s: F.col(site) != s for s in usable}, key=key, **kw)
        scored = fitted.scored(rows.where(F.col(site).isin(*usable)), F.col(site))
    else:
        parts = [fit_classifier(rows.where(F.col(site) != s), features, kind=kind, key=key, **kw).transform(rows.where(F.col(site) == s)) for s in usable]
        scored = reduce(DataFrame.unionByName, parts)
    rate = F.coalesce(*[F.when(F.col(site) == s, F.lit(r)) for s, r in usable.items()])
    return training_table(scored.withColumn("pred", (F.col("prob") > rate).cast("int")))


def fold_metrics(oof: DataFrame, reference: DataFrame, site: str = "site") -> DataFrame:
    """Per-fold and pooled (site = "all") reward and AUROC."""
    both = oof.select(site, "age", "label", "prob", "pred").unionByName(oof.select(F.lit("all").alias(site), "age", "label", "prob", "pred"))
    prev = m.prevalence(oof, reference)
    return auroc(both, [site], "prob", "label").join(m.reward(both, prev, [site]), site, "left")


def train_val_test(table: DataFrame, features: Sequence[str], key: str = "rec", seed: int = 42, **kw) -> DataFrame:
    """Fit on train, thresholds on validation, metrics on test with prevalence from train."""
    from .cohort import split_train_val_test

    rows = training_table(split_train_val_test(m.labelled(table), key, seed=seed))
    part = lambda s: rows.where(F.col("split") == s)
    model = fit_classifier(part("train"), features, key=key, **kw)
    thr = m.fit_reward_thresholds(model.transform(part("val")))
    return m.evaluate(m.apply_thresholds(model.transform(part("test")), thr), part("train"))


def repeated_oof(table: DataFrame, features: Sequence[str], key: str = "rec", k: int = 5, repeats: int = 10, seed: int = 0, strata: Sequence[str] = ("label",), **kw) -> DataFrame:
    """Mean out-of-fold probability per recording over repeated k-fold, stratified by ``strata``: one run for the models of all folds and repeats."""
    rows = m.labelled(table)
    folds = stratified_folds(rows, key, list(strata), k, repeats, seed).groupBy(key)
    folds = folds.agg(F.transform(F.sort_array(F.collect_list(F.struct("repeat", "fold"))), lambda x: x.fold).alias("_folds"))  # one entry per repeat
    data = training_table(rows.join(folds, key))
    sets = {f"{r}/{f}": F.get("_folds", F.lit(r)) != f for r in range(repeats) for f in range(k)}
    fitted = fit_sets(data, features, sets, key=key, **kw)
    each = data.select(key, "label", *features, F.posexplode("_folds").alias("_r", "_f"))
    scored = fitted.scored(each, F.concat_ws("/", F.col("_r"), F.col("_f")))
    return scored.groupBy(key, "label").agg(F.avg("prob").alias("prob"), F.count(F.lit(1)).alias("n_oof"))


def compare_arms(table: DataFrame, arms: dict[str, Sequence[str]], key: str = "rec", replicates: int = 200, seed: int = 7, **kw) -> DataFrame:
    """Two feature sets on the same leave-one-site-out folds: paired bootstrap of the AUROC difference."""
    from .stats import bootstrap_auroc, paired_delta

    (a, fa), (b, fb) = arms.items()
    left = loso(table, fa, key=key, **kw).select(key, "label", F.col("prob").alias(a))
    both = training_table(left.join(loso(table, fb, key=key, **kw).select(key, F.col("prob").alias(b)), key))
    boot = bootstrap_auroc(both, key, [a, b], "label", replicates, seed)
    wide = boot.groupBy("rep").agg(*[F.max(F.when(F.col("score") == s, F.col("auroc"))).alias(s) for s in (a, b)])
    return paired_delta(wide, a, b).select(F.lit(a).alias("base"), F.lit(b).alias("arm"), "*")


def score_excluded(table: DataFrame, trained, group: str) -> tuple[DataFrame, DataFrame]:
    """Risk of rows kept out of training: mean per group, and AUROC between each two groups."""
    scored = training_table(trained.transform(table).select(group, "prob"))
    means = scored.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg("prob").alias("mean_risk"))
    names = sorted(r[group] for r in means.select(group).collect())  # one row per group
    pairs = F.array(*[F.struct(F.lit(f"{a}|{b}").alias("pair"), F.lit(a).alias("lo"), F.lit(b).alias("hi")) for i, a in enumerate(names) for b in names[i + 1 :]])
    tall = scored.withColumn("_p", F.explode(pairs)).select(group, "prob", "_p.*").where((F.col(group) == F.col("lo")) | (F.col(group) == F.col("hi")))
    tall = tall.withColumn("label", (F.col(group) == F.col("hi")).cast("int"))
    return means, auroc(tall, ["pair"], "prob", "label")


def risk_trend(scored: DataFrame, group: str, time: str, score: str = "prob") -> DataFrame:
    """Does risk fall as the event lies further off? Per group: rank correlation of risk and time, its two-sided p, mean risk by tertile of time."""
    from ..functions.tails import student_two_sided
    from .ranks import average_ranks, quantiles

    known = training_table(scored.where(F.col(group).isNotNull() & F.col(time).isNotNull() & F.col(score).isNotNull()).select(group, F.col(time).alias("_t"), F.col(score).alias("_p")))
    ranks = known
    for c in ("_t", "_p"):
        r = average_ranks(known, [group], c).select(F.col(group).alias("_g"), F.col(c).alias("_v"), F.col("rank").alias(f"{c}r"))
        ranks = ranks.join(r, (F.col(group) == F.col("_g")) & (F.col(c) == F.col("_v"))).drop("_g", "_v")
    ranks = ranks.join(quantiles(known, [group], "_t", {"_q1": 1 / 3, "_q2": 2 / 3}), group)
    third = F.when(F.col("_t") <= F.col("_q1"), 1).when(F.col("_t") <= F.col("_q2"), 2).otherwise(3)
    out = ranks.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.corr("_tr", "_pr").alias("rho"), *[F.avg(F.when(third == k, F.col("_p"))).alias(f"mean_risk_third_{k}") for k in (1, 2, 3)])
    room = 1 - F.col("rho") * F.col("rho")
    t = F.when((F.col("n") > 2) & (room > 0), F.col("rho") * F.sqrt((F.col("n") - 2) / room))
    return out.withColumn("_d", (F.col("n") - 2).cast("double")).withColumn("_t", t).withColumn("p", student_two_sided("_t", "_d")).drop("_t", "_d")


def calibration_line(df: DataFrame, score: str = "prob", label: str = "label") -> DataFrame:
    """Slope and intercept of a logistic fit on the logit of the clipped probability."""
    p = F.least(F.greatest(F.col(score), F.lit(1e-6)), F.lit(1 - 1e-6))
    x = m.labelled(df, label).select(array_to_vector(F.array(F.log(p / (1 - p)))).alias("_x"), F.col(label).cast("double").alias("label"))
    lr = LogisticRegression(featuresCol="_x", labelCol="label", regParam=0.0, maxIter=200).fit(x)
    return df.sparkSession.createDataFrame([(float(lr.coefficients[0]), float(lr.intercept))], "slope DOUBLE, intercept DOUBLE")


def learning_curve(table: DataFrame, features: Sequence[str], fractions: Sequence[float], seeds: Sequence[int], site: str = "site", key: str = "rec", **kw) -> DataFrame:
    """Leave-one-site-out AUROC by share of positives kept, mean and SD over seeds: one run for all shares, seeds and sites."""
    rows = m.labelled(table)
    for sd in seeds:  # place of each positive in every seed's permutation
        place = permuted(rows.where("label = 1"), [], key, sd).select(key, F.col("pos").alias(f"_pos{sd}"), F.col("n_stratum").alias(f"_n{sd}"))
        rows = rows.join(place, key, "left")
    rows = training_table(rows)
    kept = {(fr, sd): F.coalesce(F.col(f"_pos{sd}") <= F.greatest(F.round(F.col(f"_n{sd}") * fr), F.lit(1)), F.lit(True)) for fr in fractions for sd in seeds}
    sites = sorted(site_sizes(rows, site))
    sets = {f"{fr}/{sd}/{s}": c & (F.col(site) != s) for (fr, sd), c in kept.items() for s in sites}
    fitted = fit_sets(rows, features, sets, key=key, **kw)
    runs = F.filter(F.array(*[F.when(c, F.struct(F.lit(float(fr)).alias("fraction"), F.lit(int(sd)).alias("seed"), F.lit(f"{fr}/{sd}/").alias("head"))) for (fr, sd), c in kept.items()]), lambda x: x.isNotNull())
    each = rows.select("label", site, *features, F.explode(runs).alias("_run")).select("label", site, *features, "_run.*")
    each = fitted.scored(each, F.concat("head", F.col(site))).select("fraction", "seed", "label", "prob")
    per = auroc(training_table(each), ["fraction", "seed"], "prob", "label")
    return per.groupBy("fraction").agg(F.count("auroc").alias("n_seeds"), F.avg("auroc").alias("mean"), F.stddev_samp("auroc").alias("sd"))


# ------------------------------------------------------------------ reduction, importances, probes
def pca_block(df: DataFrame, vector: str, k: int, train: Column | None = None) -> DataFrame:
    """PCA of an embedding block fitted on training rows that have one; others get zeros and has = 0."""
    has = F.col(vector).isNotNull()
    v = df.withColumn("_v", F.when(has, array_to_vector(F.transform(vector, lambda x: x.cast("double")))))
    fit_on = v.where(has & (F.lit(True) if train is None else train))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(fit_on)
    known = model.transform(v.where(has)).withColumn("components", vector_to_array("_p")).withColumn("has", F.lit(1))
    none = v.where(~has).withColumn("components", F.array_repeat(F.lit(0.0), k)).withColumn("has", F.lit(0))
    return known.select(*df.columns, "components", "has").unionByName(none.select(*df.columns, "components", "has"))


def anova_f(rows: DataFrame, features: Sequence[str], label: str = "label") -> DataFrame:
    """(feature, f): one-way ANOVA F of every feature over the label, from one pass of n, sum and sum of squares; nulls left out."""
    cell = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])).alias("_c")
    tall = rows.select(label, cell).select(label, "_c.*").where(F.col("v").isNotNull())
    per = tall.groupBy("feature", label).agg(F.count("v").alias("n"), F.avg("v").alias("m"), (F.var_pop("v") * F.count("v")).alias("ss"))
    all_ = per.groupBy("feature").agg(F.sum("n").alias("_n"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("_m"), F.sum("ss").alias("_w"), F.count(F.lit(1)).alias("_k"))
    gap = F.col("n") * (F.col("m") - F.col("_m")) * (F.col("m") - F.col("_m"))
    between = per.join(all_, "feature").groupBy("feature", "_n", "_w", "_k").agg(F.sum(gap).alias("_b"))
    ok = (F.col("_k") > 1) & (F.col("_n") > F.col("_k")) & (F.col("_w") > 0)
    return between.select("feature", F.when(ok, (F.col("_b") / (F.col("_k") - 1)) / (F.col("_w") / (F.col("_n") - F.col("_k")))).alias("f"))


def importances(table: DataFrame, features: Sequence[str], seed: int = 42, key: str = "rec", **params) -> DataFrame:
    """(method, feature, importance): forest impurity, permutation drop of held-out AUROC, ANOVA F.

    The forest is fitted on four folds of five; the fifth is scored as it is and with each feature permuted, in one tall pass.
    """
    features = list(features)
    folds = stratified_folds(m.labelled(table), key, ["label"], 5, 1, seed).select(key, "fold")
    rows = training_table(with_flags(m.labelled(table), features).join(folds, key))
    pipe = base_pipeline("forest", features, None, **{"numTrees": 20, **params}).fit(rows.where("fold <> 0"))
    raw = pipe.stages[-1].featureImportances.toArray()
    out = [("forest", f, float(raw[i])) for i, f in enumerate(features)]
    held = rows.where("fold = 0")
    tall = held.withColumn("_what", F.lit(""))
    for f in features:
        tall = tall.unionByName(_shuffled(held, f, seed).withColumn(f"{f}__na", F.col(f).isNull().cast("double")).withColumn("_what", F.lit(f)))
    scored = pipe.transform(tall).withColumn("_s", vector_to_array("probability")[1])
    got = {r["_what"]: r["auroc"] for r in auroc(scored, ["_what"], "_s", "label").collect()}  # one row per feature
    base = got.get("")
    out += [("permutation", f, base - got[f] if base is not None and got.get(f) is not None else None) for f in features]
    fixed = table.sparkSession.createDataFrame(out, "method STRING, feature STRING, importance DOUBLE")
    return fixed.unionByName(anova_f(rows, features).select(F.lit("anova").alias("method"), "feature", F.col("f").alias("importance")))


def _shuffled(df: DataFrame, col: str, seed: int, key: str = "rec") -> DataFrame:
    """Permute one column: value order by one hash, row order by another, joined on place."""
    from .ranks import cumulate

    one = F.lit(1).cast("long")
    rows = cumulate(df.select(key, hash_key(f"{seed}a", F.col(key)).alias("_h"), one.alias("n")), [], "_h").select(key, F.col("cum_n").alias("_i"))
    vals = cumulate(df.select(F.col(col).alias("_v"), hash_key(f"{seed}b", F.col(key)).alias("_h"), one.alias("n")), [], "_h").select("_v", F.col("cum_n").alias("_i"))
    moved = rows.join(vals, "_i").select(key, F.col("_v").alias(col))
    return df.drop(col, f"{col}__f").join(moved, key)


def _held_out(rows: DataFrame, key: str, strata: Sequence[str], k: int, seed: int, fit_predict) -> DataFrame:
    """Union over folds of ``fit_predict(train, test)``."""
    folds = stratified_folds(rows, key, strata, k, 1, seed).select(key, "fold")
    data = training_table(rows.join(folds, key))
    return reduce(DataFrame.unionByName, [fit_predict(data.where(F.col("fold") != f), data.where(F.col("fold") == f)) for f in range(k)])


def age_probe(table: DataFrame, features: Sequence[str], reg: float = 1.0, key: str = "rec", k: int = 5, seed: int = 0) -> DataFrame:
    """Ridge reconstruction of age from features: R2 and MAE of the held-out predictions of ``k`` folds."""
    features = list(features)

    def fit_predict(train: DataFrame, test: DataFrame) -> DataFrame:
        lr = LinearRegression(featuresCol="_z", labelCol="age", elasticNetParam=0.0, regParam=reg)
        return Pipeline(stages=[*preparation(features, True), lr]).fit(train).transform(test).select("age", "prediction")

    pred = _held_out(with_flags(table.where(F.col("age").isNotNull()), features), key, [], k, seed, fit_predict)
    off = F.col("age") - F.col("prediction")
    return pred.agg((1 - F.sum(off * off) / (F.var_pop("age") * F.count("age"))).alias("r2"), F.avg(F.abs(off)).alias("mae"))


def site_probe(table: DataFrame, features: Sequence[str], site: str = "site", key: str = "rec", k: int = 5, seed: int = 0, **params) -> DataFrame:
    """Held-out accuracy and balanced accuracy of telling the site from the features, beside the largest site's share."""
    features = list(features)

    def fit_predict(train: DataFrame, test: DataFrame) -> DataFrame:
        model, labels = fit_router(train, features, site, **params)
        cur = with_flags(test, features)
        for stage in model.stages[1:]:
            cur = stage.transform(cur)
        said = F.get(F.array(*[F.lit(x) for x in labels]), F.col("_s").cast("int"))
        return cur.select(site, (said == F.col(site)).cast("double").alias("right"))

    pred = _held_out(table, key, [site], k, seed, fit_predict)
    per = pred.groupBy(site).agg(F.count(F.lit(1)).alias("n"), F.sum("right").alias("r"))
    return per.agg((F.sum("r") / F.sum("n")).alias("accuracy"), F.avg(F.col("r") / F.col("n")).alias("balanced_accuracy"), (F.max("n") / F.sum("n")).alias("majority_share"))


