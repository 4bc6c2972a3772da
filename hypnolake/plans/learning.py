"""Model, calibration and evaluation queries. Fits are iterative, so most have no SQL form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import models as md
from ..operators import neighbours as nb
from ..sources.tables import epoch_sequences
from .registry import query
from .tables import STREAM_SQL, USER, features_wide, read, streams

FEATURES = ["chars", "words", "lines", "digits", "commas", "mean_word"]


def _table(spark, sf):
    return features_wide(spark, sf).drop("prob", "pred")


def _out(df, *extra):
    return df.select("rec", "site", "label", *extra, "prob")


# ------------------------------------------------------------------ nearest neighbours
def _emb(spark, sf):
    return read(spark, sf, "embeddings").select("vec_id", "embedding", (F.col("label") % 2).alias("y"), F.col("label").alias("cls"))


@query(
    "knn_join",
    """WITH q AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE label < 3), t AS (SELECT vec_id AS neighbour, embedding::DOUBLE[] AS f, label % 2 AS y FROM embeddings WHERE label >= 3)
SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY list_distance(e, f), neighbour) - 1 AS INT) AS rank, neighbour, list_distance(e, f) AS distance, y FROM q CROSS JOIN t
QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY list_distance(e, f), neighbour) <= 5""",
    dbl="distance",
)
def knn_join(spark, sf):
    v = _emb(spark, sf)
    return nb.knn_join(v.where("cls < 3"), v.where("cls >= 3"), 5, "vec_id", "embedding", "y")


@query(
    "knn_local_rate",
    """WITH q AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE label < 3), t AS (SELECT vec_id AS neighbour, embedding::DOUBLE[] AS f, label % 2 AS y FROM embeddings WHERE label >= 3),
n AS (SELECT vec_id, y FROM q CROSS JOIN t QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY list_distance(e, f), neighbour) <= 15)
SELECT vec_id, avg(y) AS local_rate, count(*) AS k FROM n GROUP BY vec_id""",
    dbl="local_rate",
)
def knn_local_rate(spark, sf):
    v = _emb(spark, sf)
    return nb.local_rate(nb.knn_join(v.where("cls < 3"), v.where("cls >= 3"), 15, "vec_id", "embedding", "y"), "vec_id", "y")


@query(
    "knn_global_blend",
    """WITH q AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE label < 3), t AS (SELECT vec_id AS neighbour, embedding::DOUBLE[] AS f, label % 2 AS y FROM embeddings WHERE label >= 3),
n AS (SELECT vec_id, y FROM q CROSS JOIN t QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY list_distance(e, f), neighbour) <= 15)
SELECT vec_id, 0.7 * avg(y) + (1 - 0.7) * 0.5 AS prob, avg(y) AS local_rate FROM n GROUP BY vec_id""",
    dbl="prob local_rate",
)
def knn_global_blend(spark, sf):
    v = _emb(spark, sf)
    rate = nb.local_rate(nb.knn_join(v.where("cls < 3"), v.where("cls >= 3"), 15, "vec_id", "embedding", "y"), "vec_id", "y")
    return nb.blend(rate, v.where("cls < 3").select("vec_id", F.lit(0.5).alias("prob")), "vec_id", 0.7)


@query("interpolated_oversample", dbl="norm")
def interpolated_oversample(spark, sf):
    o = nb.interpolated_positives(_emb(spark, sf), "vec_id", "embedding", "y", 5, 2, 3)
    return o.select("vec_id", "copy", F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)).alias("norm"))


# ------------------------------------------------------------------ models (M1-M6, M8, M9)
@query("boosted_trees", dbl="prob", nd=6)
def boosted_trees(spark, sf):
    t = _table(spark, sf)
    lab = t.where("label IN (0, 1)").withColumn("w", md.class_weight(t.where("label IN (0, 1)")))
    return _out(md.fit_classifier(lab, FEATURES, weight="w", calibrate=False).transform(t))


@query("isotonic_calibrated", dbl="prob", nd=6)
def isotonic_calibrated(spark, sf):
    t = _table(spark, sf)
    return _out(md.fit_classifier(t.where("label IN (0, 1)"), FEATURES).transform(t))


@query("site_experts", dbl="prob", nd=6)
def site_experts(spark, sf):
    t = _table(spark, sf)
    return _out(md.fit_site_models(t.where("label IN (0, 1)"), FEATURES, min_n=30, override=["en"]).transform(t))


@query("site_router_blend", dbl="prob", nd=6)
def site_router_blend(spark, sf):
    t = _table(spark, sf)
    lab = t.where("label IN (0, 1)")
    models = md.fit_site_models(lab, FEATURES, min_n=30)
    return _out(md.routed_prediction(t, md.fit_router(lab, FEATURES, maxIter=50, regParam=0.01), models, FEATURES))


@query("logistic_balanced", dbl="prob", nd=6)
def logistic_balanced(spark, sf):
    t = _table(spark, sf)
    lab = t.where("label IN (0, 1)")
    lab = lab.withColumn("w", md.class_weight(lab))
    return _out(md.fit_classifier(lab, FEATURES, kind="logit", weight="w", calibrate=False).transform(t))


@query("pairwise_ranker", dbl="prob", nd=6)
def pairwise_ranker(spark, sf):
    t = _table(spark, sf)
    return _out(md.fit_pairwise(t.where("label IN (0, 1)"), FEATURES).transform(t))


@query("train_and_score", dbl="prob threshold", nd=6)
def train_and_score(spark, sf):
    t = _table(spark, sf).withColumn("bmi", F.when(F.col("digits") > 0, F.col("mean_word")))
    trained = md.train_job(t, [*FEATURES, "bmi"], bmi="bmi", min_n=30)
    return _out(md.score_job(t, trained, bmi="bmi"), "threshold", "pred")


# ------------------------------------------------------------------ drivers
@query("loso_metrics", dbl="auroc reward", nd=6)
def loso_metrics(spark, sf):
    oof = md.loso(_table(spark, sf), FEATURES)
    return md.fold_metrics(oof, oof)


@query("train_val_test_metrics", dbl="value", nd=6)
def train_val_test_metrics(spark, sf):
    return md.train_val_test(_table(spark, sf), FEATURES)


@query("repeated_oof_mean", dbl="prob", nd=6)
def repeated_oof_mean(spark, sf):
    return md.repeated_oof(_table(spark, sf), FEATURES)


@query("feature_family_ab", dbl="delta_mean lo hi p_gt_0", nd=6)
def feature_family_ab(spark, sf):
    return md.compare_arms(_table(spark, sf), {"base": FEATURES[:3], "more": FEATURES})


@query("excluded_group_risk", dbl="mean_risk", nd=6)
def excluded_group_risk(spark, sf):
    t = _table(spark, sf)
    model = md.fit_classifier(t.where("label IN (0, 1)"), FEATURES)
    return md.score_excluded(t.where("label IS NULL"), model, "site")[0]


@query("excluded_group_auroc", dbl="auroc", nd=6)
def excluded_group_auroc(spark, sf):
    t = _table(spark, sf)
    model = md.fit_classifier(t.where("label IN (0, 1)"), FEATURES)
    return md.score_excluded(t.where("label IS NULL"), model, "site")[1]


@query("excluded_group_trend", dbl="rho p mean_risk_third_1 mean_risk_third_2 mean_risk_third_3", nd=6)
def excluded_group_trend(spark, sf):
    """Documents without a label stand for the excluded; months to the event are derived from their number."""
    t = _table(spark, sf)
    model = md.fit_classifier(t.where("label IN (0, 1)"), FEATURES)
    scored = model.transform(t.where("label IS NULL")).withColumn("months", F.col("rec") % 84)
    return md.risk_trend(scored, "site", "months")


@query("calibration_line", dbl="slope intercept", nd=5)
def calibration_line(spark, sf):
    return md.calibration_line(features_wide(spark, sf))


@query("learning_curve", dbl="fraction mean sd", nd=6)
def learning_curve(spark, sf):
    return md.learning_curve(_table(spark, sf), FEATURES, [0.3, 1.0], [1, 2, 3])


# ------------------------------------------------------------------ reduction and probes (H14, H16, H17), sequences
@query("embedding_pca", dbl="norm", nd=6)
def embedding_pca(spark, sf):
    """Component signs are free, so the row norm is reported."""
    v = read(spark, sf, "embeddings").select("vec_id", F.when(F.col("label") != 9, F.col("embedding")).alias("embedding"))
    p = md.pca_block(v, "embedding", 5)
    return p.select("vec_id", "has", F.sqrt(F.aggregate("components", F.lit(0.0), lambda a, x: a + x * x)).alias("norm"))


@query("feature_importances", dbl="importance", nd=6)
def feature_importances(spark, sf):
    return md.importances(_table(spark, sf), FEATURES)


@query("age_probe", dbl="r2 mae", nd=5)
def age_probe(spark, sf):
    return md.age_probe(_table(spark, sf), FEATURES)


@query("site_probe", dbl="accuracy balanced_accuracy majority_share", nd=6)
def site_probe(spark, sf):
    return md.site_probe(_table(spark, sf), FEATURES, maxIter=50, regParam=0.01)


@query(
    "epoch_sequences",
    f"""WITH {STREAM_SQL}, l AS (SELECT user_id, epoch, sign(value) * ln(1 + abs(value)) AS v FROM streams), s AS (SELECT avg(v) AS m, stddev_pop(v) AS sd FROM l)
SELECT user_id, CAST(count(*) AS INT) AS n, min_by(coalesce((v - m) / CASE WHEN sd > 0 THEN sd END, 0), epoch) AS first_x FROM l, s GROUP BY user_id""",
    dbl="first_x",
)
def epoch_sequence_rows(spark, sf):
    df, _ = streams(spark, sf)
    s = epoch_sequences(df.select("user_id", "epoch", "stage", "value"), USER, ["value"])
    return s.select("user_id", F.size("sequence").alias("n"), F.get(F.get("sequence", F.lit(0)).getField("x"), F.lit(0)).alias("first_x"))
