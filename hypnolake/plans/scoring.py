"""Scoring queries on the document cohort (label = quality, prob from n_chars)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as m
from ..operators.ranks import auroc
from .registry import query
from .tables import COHORT_SQL, FEATURES_SQL, cohort, features_long

COH = f"WITH {COHORT_SQL}, lab AS (SELECT * FROM cohort WHERE label IN (0, 1))"
PREV = COH + """, ages AS (SELECT DISTINCT age FROM lab),
prev AS (SELECT a.age, count(*) AS n_window, CAST(sum(label) AS BIGINT) AS n_pos, greatest(sum(label), 0.5) / count(*) AS prevalence
  FROM ages a JOIN lab l ON abs(a.age - l.age) <= 2 GROUP BY a.age)"""


@query("age_window_prevalence", PREV + " SELECT * FROM prev", dbl="prevalence")
def age_window_prevalence(spark, sf):
    df = m.labelled(cohort(spark, sf))
    return m.prevalence(df, df)


_REW = """CASE WHEN label = 1 AND pred = 1 THEN 1 / p - 1 WHEN label = 0 AND pred = 0 THEN 1 / (1 - p) - 1 ELSE -1 END"""


def _reward_sql(rows: str, group: str = "") -> str:
    g = f"{group}," if group else ""
    over = f"OVER (PARTITION BY {group})" if group else "OVER ()"
    by = f"GROUP BY {group}" if group else ""
    return f"""SELECT {g} count(*) AS n_scored, avg({_REW}) AS reward FROM (SELECT *, least(greatest(prevalence, 0.5 / m), 1 - 0.5 / m) AS p
  FROM (SELECT *, count(*) {over} AS m FROM {rows}) JOIN prev USING (age)) {by}"""


@query("prevalence_reward", PREV + _reward_sql("lab"), dbl="reward")
def prevalence_reward(spark, sf):
    df = m.labelled(cohort(spark, sf))
    return m.reward(df, m.prevalence(df, df))


@query("prevalence_reward_by_site", PREV + _reward_sql("lab", "site"), dbl="reward")
def prevalence_reward_by_site(spark, sf):
    df = m.labelled(cohort(spark, sf))
    return m.reward(df, m.prevalence(df, df), ["site"])


AGE_PAIRS = COH + """, pr AS (SELECT CASE WHEN p.prob > n.prob THEN 1.0 WHEN p.prob = n.prob THEN 0.5 ELSE 0 END AS w
  FROM (SELECT * FROM lab WHERE label = 1) p JOIN (SELECT * FROM lab WHERE label = 0) n ON abs(p.age - n.age) <= 2)
SELECT sum(w) AS wins, count(*) AS pairs, avg(w) AS auroc_age FROM pr"""


@query("auroc_age_conditioned", AGE_PAIRS, dbl="wins auroc_age")
def auroc_age_conditioned(spark, sf):
    return m.auroc_age(cohort(spark, sf))


@query("auroc_age_conditioned_many_ages", AGE_PAIRS, dbl="wins auroc_age")
def auroc_age_conditioned_many_ages(spark, sf):
    """Same metric in units of days: as many distinct positions, on no year grid."""
    c = cohort(spark, sf)
    return m.auroc_age(c.withColumn("age", F.col("age") * 365.25), gap=2 * 365.25)


AUW = COH + """, g AS (SELECT unnest(generate_series(CAST((SELECT min(age) FROM lab) - 2 AS BIGINT), CAST((SELECT max(age) FROM lab) + 3 AS BIGINT))) AS k),
w AS (SELECT k, count(*) AS people FROM g JOIN lab ON abs(age - k) <= 2 GROUP BY k),
pr AS (SELECT k, avg(CASE WHEN p.prob > n.prob THEN 1.0 WHEN p.prob = n.prob THEN 0.5 ELSE 0 END) AS a
  FROM g JOIN lab p ON p.label = 1 AND abs(p.age - k) <= 2 JOIN lab n ON n.label = 0 AND abs(n.age - k) <= 2 GROUP BY k)
SELECT sum(people * a) / sum(people) AS auroc_weighted FROM pr JOIN w USING (k)"""


@query("auroc_age_weighted", AUW, dbl="auroc_weighted")
def auroc_age_weighted(spark, sf):
    return m.auroc_age_weighted(cohort(spark, sf))


ROC = COH + """, rk AS (SELECT site, label, rank() OVER (PARTITION BY site ORDER BY prob) + (count(*) OVER (PARTITION BY site, prob) - 1) / 2.0 AS r FROM lab)
SELECT site, CAST(sum(label) AS BIGINT) AS n_pos, CAST(count(*) - sum(label) AS BIGINT) AS n_neg,
  (sum(r) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label))) AS auroc FROM rk GROUP BY site"""


@query("auroc_by_site", ROC, dbl="auroc")
def auroc_by_site(spark, sf):
    return auroc(m.labelled(cohort(spark, sf)), ["site"], "prob", "label")


AP = COH + """, h AS (SELECT site, prob, sum(label) AS pos, count(*) AS n FROM lab GROUP BY ALL),
c AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS k, sum(pos) OVER (PARTITION BY site) AS tot FROM h WINDOW w AS (PARTITION BY site ORDER BY prob DESC))
SELECT site, sum(pos / tot * tp / k) AS auprc FROM c GROUP BY site"""


@query("average_precision_by_site", AP, dbl="auprc")
def average_precision_by_site(spark, sf):
    return m.average_precision(m.labelled(cohort(spark, sf)), ["site"], "prob", "label")


# ------------------------------------------------------------------ thresholds
_GRID_SQL = "[" + ", ".join(repr(t) for t in m.GRID) + "]"
THR = PREV + f""", grid AS (SELECT unnest({_GRID_SQL}) AS t),
lv AS (SELECT 'global' AS level, '' AS site, -1 AS decade, age, label, prob FROM lab
  UNION ALL SELECT 'decade', '', CAST(floor(age / 10) * 10 AS INT), age, label, prob FROM lab
  UNION ALL SELECT 'site_decade', site, CAST(floor(age / 10) * 10 AS INT), age, label, prob FROM lab),
sz AS (SELECT level, site, decade, count(*) AS m FROM lv GROUP BY ALL
  HAVING level = 'global' OR (count(*) >= 25 AND sum(label) > 0 AND sum(label) < count(*))),
sc AS (SELECT level, site, decade, t, round(avg({_REW}), 12) AS r FROM (
  SELECT level, site, decade, t, label, CASE WHEN prob > t THEN 1 ELSE 0 END AS pred, least(greatest(prevalence, 0.5 / m), 1 - 0.5 / m) AS p
  FROM lv JOIN sz USING (level, site, decade) JOIN prev USING (age) CROSS JOIN grid) GROUP BY ALL),
thr AS (SELECT level, site, decade, t AS threshold, r AS train_reward FROM sc
  QUALIFY row_number() OVER (PARTITION BY level, site, decade ORDER BY r DESC, t) = 1)"""


@query("reward_thresholds", THR + " SELECT * FROM thr", dbl="threshold train_reward")
def reward_thresholds(spark, sf):
    return m.fit_reward_thresholds(cohort(spark, sf))


@query(
    "apply_reward_thresholds",
    THR + """ SELECT c.rec, coalesce(sd.threshold, d.threshold, g.threshold) AS threshold,
  CASE WHEN prob > coalesce(sd.threshold, d.threshold, g.threshold) THEN 1 ELSE 0 END AS pred
FROM cohort c LEFT JOIN thr sd ON sd.level = 'site_decade' AND sd.site = c.site AND sd.decade = floor(age / 10) * 10
  LEFT JOIN thr d ON d.level = 'decade' AND d.decade = floor(age / 10) * 10 LEFT JOIN thr g ON g.level = 'global'""",
    dbl="threshold",
)
def apply_reward_thresholds(spark, sf):
    df = cohort(spark, sf)
    return m.apply_thresholds(df, m.fit_reward_thresholds(df)).select("rec", "threshold", "pred")


RULES = PREV + f""", grid AS (SELECT unnest({_GRID_SQL}) AS t),
n AS (SELECT count(*) AS m, avg(label) AS pi FROM lab),
pi AS (SELECT *, CASE WHEN prob > pi THEN 1 ELSE 0 END AS pr FROM lab, n),
tr AS (SELECT s.held, t, round(avg({_REW}), 12) AS r FROM (
   SELECT h.held, t, label, CASE WHEN prob > t THEN 1 ELSE 0 END AS pred, least(greatest(prevalence, 0.5 / mm), 1 - 0.5 / mm) AS p
   FROM (SELECT DISTINCT site AS held FROM lab) h JOIN (SELECT * EXCLUDE (pred) FROM lab) l ON l.site <> h.held
   JOIN (SELECT a.site AS held, (SELECT count(*) FROM lab) - count(*) AS mm FROM lab a GROUP BY a.site) z ON z.held = h.held
   JOIN prev USING (age) CROSS JOIN grid) s GROUP BY ALL),
best AS (SELECT held AS site, t FROM tr QUALIFY row_number() OVER (PARTITION BY held ORDER BY r DESC, t) = 1),
pa AS (SELECT q.site, q.age, CASE WHEN count(l.label) > 0 THEN greatest(sum(l.label), 0.5) / count(l.label) ELSE 1.0 END AS pa
   FROM (SELECT DISTINCT site, age FROM lab) q LEFT JOIN lab l ON l.site <> q.site AND abs(l.age - q.age) <= 2 GROUP BY ALL),
rows AS (SELECT 'pi' AS rule, 0.0 AS t, label, age, pr AS pred FROM pi
  UNION ALL SELECT 'oracle', t, label, age, CASE WHEN prob > t THEN 1 ELSE 0 END FROM lab CROSS JOIN grid
  UNION ALL SELECT 'transfer', 0.0, label, age, CASE WHEN prob > t THEN 1 ELSE 0 END FROM lab JOIN best USING (site)
  UNION ALL SELECT 'q_gt_pa', 0.0, label, age, CASE WHEN prob > pa THEN 1 ELSE 0 END FROM lab JOIN pa USING (site, age)),
rw AS (SELECT rule, t, avg({_REW}) AS r FROM (SELECT rows.*, least(greatest(prevalence, 0.5 / m), 1 - 0.5 / m) AS p FROM rows JOIN prev USING (age), n) GROUP BY ALL)
SELECT rule, max(r) AS reward FROM rw GROUP BY rule"""


@query("decision_rules", RULES, dbl="reward")
def decision_rules(spark, sf):
    return m.decision_rules(cohort(spark, sf))


# ------------------------------------------------------------------ confusion and evaluation
_CONF = """count(*) FILTER (label = 1 AND pred = 1) AS tp, count(*) FILTER (label = 0 AND pred = 1) AS fp,
 count(*) FILTER (label = 1 AND pred = 0) AS fn, count(*) FILTER (label = 0 AND pred = 0) AS tn"""
_RATES = """(tp + tn) / (tp + fp + fn + tn) AS accuracy, 2 * tp / (2 * tp + fp + fn) AS f_measure, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS recall,
 CASE WHEN tn + fp > 0 THEN tn / (tn + fp) END AS specificity, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS precision"""


@query("confusion_by_site", COH + f", c AS (SELECT site, {_CONF} FROM lab GROUP BY site) SELECT *, {_RATES} FROM c", dbl="accuracy f_measure recall specificity precision")
def confusion_by_site(spark, sf):
    return m.confusion(cohort(spark, sf), ["site"])


EVAL = PREV + f""", rk AS (SELECT label, rank() OVER (ORDER BY prob) + (count(*) OVER (PARTITION BY prob) - 1) / 2.0 AS r FROM lab),
h AS (SELECT prob, sum(label) AS pos, count(*) AS n FROM lab GROUP BY ALL),
ap AS (SELECT pos, sum(pos) OVER w AS tp, sum(n) OVER w AS k, sum(pos) OVER () AS tot FROM h WINDOW w AS (ORDER BY prob DESC)),
c AS (SELECT {_CONF} FROM lab)
SELECT 'reward' AS metric, reward AS value FROM ({_reward_sql('lab')})
UNION ALL SELECT 'auroc_age', auroc_age FROM ({AGE_PAIRS.replace('WITH', 'WITH', 1)})
UNION ALL SELECT 'auroc_weighted', auroc_weighted FROM ({AUW})
UNION ALL SELECT 'auroc', (sum(r) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label))) FROM rk
UNION ALL SELECT 'auprc', sum(pos / tot * tp / k) FROM ap
UNION ALL SELECT 'accuracy', (tp + tn) / (tp + fp + fn + tn) FROM c UNION ALL SELECT 'f_measure', 2 * tp / (2 * tp + fp + fn) FROM c"""


@query("full_evaluation", EVAL, dbl="value")
def full_evaluation(spark, sf):
    labels = cohort(spark, sf).drop("pred", "prob")
    scored = m.align_predictions(labels, cohort(spark, sf).select("rec", "pred", "prob"), ["rec"])
    return m.evaluate(scored, scored)


@query(
    "evaluation_by_age",
    PREV + f""" SELECT l.age, any_value(prevalence) AS prevalence, count(*) FILTER (label = 1) AS ref_pos, count(*) FILTER (label = 0) AS ref_neg,
  count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg, count(*) FILTER (pred = 1) AS pred_pos, count(*) FILTER (pred = 0) AS pred_neg,
  {_CONF} FROM lab l LEFT JOIN prev USING (age) GROUP BY l.age""",
    dbl="prevalence",
)
def evaluation_by_age(spark, sf):
    df = cohort(spark, sf)
    return m.by_age_table(df, df)


SUB = PREV + f""", ax AS (SELECT 'site' AS axis, site AS level, * EXCLUDE (site) FROM lab
  UNION ALL SELECT 'age', CASE WHEN age < 50 THEN '<50' WHEN age < 60 THEN '50-59' WHEN age < 70 THEN '60-69' WHEN age < 80 THEN '70-79' ELSE '80+' END, * EXCLUDE (site) FROM lab
  UNION ALL SELECT 'source', source, * EXCLUDE (site) FROM lab),
c AS (SELECT axis, level, {_CONF} FROM ax GROUP BY ALL HAVING count(*) >= 15),
rk AS (SELECT axis, level, label, rank() OVER (PARTITION BY axis, level ORDER BY prob) + (count(*) OVER (PARTITION BY axis, level, prob) - 1) / 2.0 AS r FROM ax),
roc AS (SELECT axis, level, CASE WHEN sum(label) > 0 AND sum(label) < count(*) THEN (sum(r) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label))) END AS auroc FROM rk GROUP BY ALL),
rw AS ({_reward_sql('ax', 'axis, level')})
SELECT c.*, tp + fp + fn + tn AS n, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS recall, CASE WHEN tn + fp > 0 THEN tn / (tn + fp) END AS specificity,
  CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS precision, auroc, reward FROM c LEFT JOIN roc USING (axis, level) LEFT JOIN rw USING (axis, level)"""


@query("subgroup_metrics", SUB, dbl="recall specificity precision auroc reward")
def subgroup_metrics(spark, sf):
    from ..operators.clean import age_band

    df = cohort(spark, sf)
    axes = {"site": F.col("site"), "age": age_band(F.col("age")), "source": F.col("source")}
    return m.subgroups(df, axes, df)


Z = f"WITH {COHORT_SQL}, {FEATURES_SQL}" + """, st AS (SELECT feature, avg(value) AS mu, stddev_pop(value) AS sd FROM flong WHERE label = 0 GROUP BY feature),
z AS (SELECT f.rec, f.feature, (value - mu) / sd AS z, label, pred FROM flong f JOIN st USING (feature) WHERE sd > 0)"""


@query(
    "case_cards",
    Z + """ SELECT rec, CASE WHEN label = 1 THEN 'FN' ELSE 'FP' END AS outcome, rank, feature, z FROM (
  SELECT *, row_number() OVER (PARTITION BY rec ORDER BY round(abs(z), 9) DESC, feature) AS rank FROM z WHERE label IN (0, 1) AND label <> pred) WHERE rank <= 3""",
    dbl="z",
)
def case_cards(spark, sf):
    return m.case_cards(features_long(spark, sf), cohort(spark, sf), "rec", 3)


@query(
    "missed_case_contrast",
    Z + """, g AS (SELECT feature, avg(z) FILTER (label = 1 AND pred = 1) AS z_tp, avg(z) FILTER (label = 1 AND pred = 0) AS z_fn,
  avg(z) FILTER (label = 0 AND pred = 1) AS z_fp, avg(z) FILTER (label = 0 AND pred = 0) AS z_tn FROM z WHERE label IN (0, 1) GROUP BY feature)
SELECT *, z_fn - z_tp AS fn_minus_tp, z_fp - z_tn AS fp_minus_tn FROM g""",
    dbl="z_tp z_fn z_fp z_tn fn_minus_tp fp_minus_tn",
)
def missed_case_contrast(spark, sf):
    return m.missed_contrast(features_long(spark, sf), cohort(spark, sf), "rec")


@query("reliability_bins", COH + " SELECT least(CAST(floor(prob * 10) AS INT), 9) AS bin, count(*) AS n, avg(prob) AS mean_pred, avg(label) AS obs_freq FROM lab GROUP BY 1", dbl="mean_pred obs_freq")
def reliability_bins(spark, sf):
    return m.reliability_bins(cohort(spark, sf))


@query(
    "calibration_by_site",
    COH + """, b AS (SELECT site, least(floor(prob * 10), 9) AS bin, count(*) AS n, abs(avg(label) - avg(prob)) AS gap, sum((prob - label) * (prob - label)) AS sq FROM lab GROUP BY ALL)
SELECT site, CAST(sum(n) AS BIGINT) AS n, sum(sq) / sum(n) AS brier, sum(n * gap) / sum(n) AS ece, max(gap) AS mce FROM b GROUP BY site""",
    dbl="brier ece mce",
)
def calibration_by_site(spark, sf):
    return m.calibration(cohort(spark, sf), ["site"])


SURV = COH + ", sv AS (SELECT *, 1 + n_chars % 50 AS t FROM lab)"


@query(
    "harrell_c_index",
    SURV + """, pr AS (SELECT CASE WHEN a.prob > b.prob THEN 1.0 WHEN a.prob = b.prob THEN 0.5 ELSE 0 END AS w FROM sv a JOIN sv b ON b.t > a.t WHERE a.label = 1
  UNION ALL SELECT CASE WHEN a.prob = b.prob THEN 0.5 ELSE 0 END FROM sv a JOIN sv b ON b.t = a.t AND b.rec > a.rec WHERE a.label = 1 AND b.label = 1)
SELECT sum(w) AS concordant, count(*) AS comparable, avg(w) AS c_index FROM pr""",
    dbl="concordant c_index",
)
def harrell_c_index(spark, sf):
    df = m.labelled(cohort(spark, sf)).withColumn("t", 1 + F.col("n_chars") % 50)
    return m.c_index(df, "t", "label", "prob")


@query(
    "youden_threshold",
    COH + """, h AS (SELECT site, prob, sum(label) AS pos, count(*) - sum(label) AS neg FROM lab GROUP BY ALL),
c AS (SELECT site, prob, sum(pos) OVER w / nullif(sum(pos) OVER (PARTITION BY site), 0) AS tpr, sum(neg) OVER w / nullif(sum(neg) OVER (PARTITION BY site), 0) AS fpr FROM h
  WINDOW w AS (PARTITION BY site ORDER BY prob DESC))
SELECT site, prob AS threshold, tpr, fpr, tpr - fpr AS youden FROM c WHERE tpr IS NOT NULL AND fpr IS NOT NULL QUALIFY row_number() OVER (PARTITION BY site ORDER BY round(tpr - fpr, 12) DESC, prob DESC) = 1""",
    dbl="threshold tpr fpr youden",
)
def youden_threshold(spark, sf):
    return m.youden(cohort(spark, sf), ["site"])


@query(
    "operating_sweep",
    COH + """, t AS (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[]) AS threshold),
c AS (SELECT threshold, count(*) FILTER (label = 1 AND prob >= threshold) AS tp, count(*) FILTER (label = 0 AND prob >= threshold) AS fp,
  count(*) FILTER (label = 1 AND prob < threshold) AS fn, count(*) FILTER (label = 0 AND prob < threshold) AS tn FROM lab CROSS JOIN t GROUP BY threshold)
SELECT *, tp / (tp + fn) AS sensitivity, tn / (tn + fp) AS specificity FROM c""",
    dbl="threshold sensitivity specificity",
)
def operating_sweep(spark, sf):
    return m.operating_sweep(cohort(spark, sf), [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])
