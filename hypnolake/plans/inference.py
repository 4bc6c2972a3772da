"""Univariate tests, resampling, harmonisation and selection queries on text features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import harmonize as hz
from ..operators import stats as st
from ..operators.ranks import auroc
from .registry import query
from .tables import COHORT_SQL, FEATURES_SQL, TEXT_FEATURES, cohort, features_long, features_wide

FEA = f"WITH {COHORT_SQL}, {FEATURES_SQL}, lab AS (SELECT * FROM flong WHERE label IN (0, 1))"


# ------------------------------------------------------------------ tests
MW = FEA + """, rk AS (SELECT feature, label, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS r FROM lab),
ti AS (SELECT feature, sum(CAST(c AS DOUBLE) ** 3 - c) AS ties FROM (SELECT feature, value, count(*) AS c FROM lab GROUP BY ALL) GROUP BY feature),
u AS (SELECT feature, count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg, sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0 AS u FROM rk GROUP BY feature)
SELECT feature, n_pos, n_neg, u, u / (n_pos * n_neg) AS auroc,
  greatest((abs(u - n_pos * n_neg / 2.0) - 0.5) / sqrt(n_pos * n_neg / 12.0 * ((n_pos + n_neg + 1) - ties / ((n_pos + n_neg) * CAST(n_pos + n_neg - 1 AS DOUBLE)))), 0) AS z
FROM u JOIN ti USING (feature)"""


@query("mann_whitney", MW, dbl="u auroc z")
def mann_whitney(spark, sf):
    return st.mann_whitney(features_long(spark, sf), ["feature"])


WE = FEA + """, a AS (SELECT feature, count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg, avg(value) FILTER (label = 1) AS mean_pos, avg(value) FILTER (label = 0) AS mean_neg,
  var_samp(value) FILTER (label = 1) AS v1, var_samp(value) FILTER (label = 0) AS v0 FROM lab GROUP BY feature)
SELECT feature, n_pos, n_neg, mean_pos, mean_neg, (mean_pos - mean_neg) / sqrt(v1 / n_pos + v0 / n_neg) AS t,
  (v1 / n_pos + v0 / n_neg) ** 2 / ((v1 / n_pos) ** 2 / (n_pos - 1) + (v0 / n_neg) ** 2 / (n_neg - 1)) AS dof,
  (mean_pos - mean_neg) / sqrt(((n_pos - 1) * v1 + (n_neg - 1) * v0) / (n_pos + n_neg - 2)) AS cohen_d FROM a"""


@query("welch_t", WE, dbl="mean_pos mean_neg t dof cohen_d", nd=7)
def welch_t(spark, sf):
    return st.welch(features_long(spark, sf), ["feature"])


CHI = """, c AS (SELECT source AS level, count(*) FILTER (label = 1) AS a, count(*) FILTER (label = 0) AS b FROM cohort WHERE label IN (0, 1) GROUP BY 1),
t AS (SELECT CAST(sum(a) AS DOUBLE) AS ta, CAST(sum(b) AS DOUBLE) AS tb, count(*) AS k FROM c)
SELECT sum((a - (a + b) * ta / (ta + tb)) ** 2 / ((a + b) * ta / (ta + tb)) + (b - (a + b) * tb / (ta + tb)) ** 2 / ((a + b) * tb / (ta + tb))) AS chi2, any_value(k) - 1 AS dof,
  sqrt(sum((a - (a + b) * ta / (ta + tb)) ** 2 / ((a + b) * ta / (ta + tb)) + (b - (a + b) * tb / (ta + tb)) ** 2 / ((a + b) * tb / (ta + tb))) / any_value(ta + tb)) AS cramer_v FROM c, t"""


@query("chi_square_cramer_v", f"WITH {COHORT_SQL}{CHI}", dbl="chi2 cramer_v")
def chi_square_cramer_v(spark, sf):
    return st.chi_square(cohort(spark, sf), [], "source")


@query(
    "benjamini_hochberg",
    FEA + """, w AS (SELECT site, feature, row_number() OVER (ORDER BY site, feature) AS i FROM (SELECT DISTINCT site, feature FROM flong)),
p AS (SELECT f.site, f.feature, avg(value) / (1 + max(value)) AS p FROM flong f GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY p) AS k, count(*) OVER (PARTITION BY site) AS m FROM p)
SELECT site, feature, p, least(min(p * m / k) OVER (PARTITION BY site ORDER BY k DESC), 1) AS q FROM r""",
    dbl="p q",
)
def benjamini_hochberg(spark, sf):
    p = features_long(spark, sf).groupBy("site", "feature").agg((F.avg("value") / (1 + F.max("value"))).alias("p"))
    return st.benjamini_hochberg(p, family=["site"])


@query("significance_table", dbl="stat p effect q")
def significance_table(spark, sf):
    """Adds t and chi-square tails, which SQL lacks; the statistics behind them have their own oracles."""
    cat = cohort(spark, sf).select("label", F.explode(F.array(
        F.struct(F.lit("site").alias("feature"), F.col("site").alias("level")), F.struct(F.lit("source").alias("feature"), F.col("source").alias("level"))
    )).alias("_c")).select("label", "_c.*")
    return st.significance_table(features_long(spark, sf), cat)


# ------------------------------------------------------------------ resampling
_CDF = ["0.36787944117144233", "0.7357588823428847", "0.9196986029286058", "0.9810118431238462", "0.9963401531726563",
        "0.9994058151824183", "0.9999167588507119", "0.9999897508033253", "0.999998874797402", "0.9999998885745217"]
BOOT = f"""WITH {COHORT_SQL}, lab AS (SELECT * FROM cohort WHERE label IN (0, 1)), rp AS (SELECT unnest(range(40)) AS rep),
bu AS (SELECT rec, label, prob, pred, age, rep, CAST('0x' || substr(md5('11:' || rep || '-' || rec), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM lab CROSS JOIN rp),
bw AS (SELECT *, {' + '.join(f'CAST(u >= {c} AS INT)' for c in _CDF)} AS w FROM bu)"""


@query(
    "bootstrap_ci_mean",
    BOOT + ", r AS (SELECT rep, sum(w * prob) / sum(w) AS v FROM bw GROUP BY rep) SELECT count(*) AS n_rep, avg(v) AS mean, quantile_cont(v, 0.025) AS lo, quantile_cont(v, 0.975) AS hi FROM r",
    dbl="mean lo hi",
)
def bootstrap_ci_mean(spark, sf):
    df = cohort(spark, sf).where("label IN (0, 1)")
    return st.interval(st.bootstrap_mean(df, "rec", {"v": F.col("prob")}, 40, 11), "v")


@query(
    "paired_bootstrap_delta",
    BOOT + """, r AS (SELECT rep, sum(w * abs(label - prob)) / sum(w) AS a, sum(w * abs(label - pred)) / sum(w) AS b FROM bw GROUP BY rep)
SELECT avg(b - a) AS delta_mean, quantile_cont(b - a, 0.025) AS lo, quantile_cont(b - a, 0.975) AS hi, avg(CASE WHEN b - a > 0 THEN 1.0 ELSE 0 END) AS p_gt_0 FROM r""",
    dbl="delta_mean lo hi p_gt_0",
)
def paired_bootstrap_delta(spark, sf):
    df = cohort(spark, sf).where("label IN (0, 1)")
    arms = {"a": F.abs(F.col("label") - F.col("prob")), "b": F.abs(F.col("label") - F.col("pred"))}
    return st.paired_delta(st.bootstrap_mean(df, "rec", arms, 40, 11), "a", "b")


@query(
    "bootstrap_auroc",
    BOOT + """, s AS (SELECT rep, 'prob' AS score, prob AS v, label, w FROM bw WHERE w > 0 UNION ALL SELECT rep, 'age', age, label, w FROM bw WHERE w > 0),
h AS (SELECT rep, score, v, sum(CASE WHEN label = 1 THEN w ELSE 0 END) AS p, sum(CASE WHEN label = 0 THEN w ELSE 0 END) AS n FROM s GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY rep, score ORDER BY v) AS cn FROM h)
SELECT CAST(rep AS INT) AS rep, score, sum(p * (cn - n / 2.0)) / (sum(p) * sum(n)) AS auroc FROM c GROUP BY rep, score""",
    dbl="auroc",
)
def bootstrap_auroc(spark, sf):
    return st.bootstrap_auroc(cohort(spark, sf).where("label IN (0, 1)"), "rec", ["prob", "age"], "label", 40, 11)


PERM = f"""WITH {COHORT_SQL}, lab AS (SELECT * FROM cohort WHERE label IN (0, 1)), rk AS (SELECT rec, label, rank() OVER (ORDER BY prob) + (count(*) OVER (PARTITION BY prob) - 1) / 2.0 AS r FROM lab),
t AS (SELECT sum(label) AS p, count(*) - sum(label) AS q FROM lab),
o AS (SELECT rep, r, row_number() OVER (PARTITION BY rep ORDER BY md5('5:' || rep || '-' || rec)) AS k FROM rk CROSS JOIN (SELECT unnest(range(30)) AS rep)),
nl AS (SELECT rep, (sum(r) - any_value(p) * (any_value(p) + 1) / 2.0) / (any_value(p) * any_value(q)) AS a FROM o, t WHERE k <= p GROUP BY rep),
ob AS (SELECT (sum(r) FILTER (label = 1) - any_value(p) * (any_value(p) + 1) / 2.0) / (any_value(p) * any_value(q)) AS auroc FROM rk, t)
SELECT auroc, count(*) AS n_perm, (1 + count(*) FILTER (a >= auroc)) / (1 + count(*)) AS p_value FROM nl, ob GROUP BY auroc"""


@query("permutation_test", PERM, dbl="auroc p_value")
def permutation_test(spark, sf):
    df = cohort(spark, sf).where("label IN (0, 1)")
    return st.permutation_p(st.permutation_auroc(df, "rec", "prob", "label", 30, 5), auroc(df, [], "prob", "label"))


@query(
    "multi_seed_split",
    f"""WITH {COHORT_SQL}, lab AS (SELECT * FROM cohort WHERE label IN (0, 1)), r AS (SELECT rec, site, label, prob, unnest(range(8)) AS repeat FROM lab),
f AS (SELECT *, (row_number() OVER (PARTITION BY site, label, repeat ORDER BY md5('9:' || repeat || '-' || rec)) - 1) % 4 AS fold FROM r),
k AS (SELECT repeat, label, rank() OVER (PARTITION BY repeat ORDER BY prob) + (count(*) OVER (PARTITION BY repeat, prob) - 1) / 2.0 AS r FROM f WHERE fold = 0),
a AS (SELECT repeat, (sum(r) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label))) AS auroc FROM k GROUP BY repeat)
SELECT count(*) AS n_seeds, avg(auroc) AS mean, stddev_samp(auroc) AS sd FROM a""",
    dbl="mean sd",
)
def multi_seed_split(spark, sf):
    from ..operators.cohort import stratified_folds

    df = cohort(spark, sf).where("label IN (0, 1)")
    test = stratified_folds(df, "rec", ["site", "label"], 4, 8, 9).where("fold = 0").join(df.select("rec", "prob", "label"), "rec")
    return st.over_seeds(auroc(test, ["repeat"], "prob", "label"), "auroc")


# ------------------------------------------------------------------ harmonisation (H1-H9)
TRAIN = "(rec % 5 <> 0)"


def _train():
    return F.col("rec") % 5 != 0


@query(
    "site_median_impute",
    f"WITH {COHORT_SQL}, {FEATURES_SQL}" + """, v AS (SELECT rec, site, CASE WHEN digits > 0 THEN mean_word END AS bmi FROM wide),
s AS (SELECT site, CASE WHEN count(bmi) >= 15 THEN median(bmi) END AS m FROM v GROUP BY site)
SELECT rec, v.site, coalesce(bmi, m, (SELECT median(bmi) FROM v)) AS bmi FROM v JOIN s USING (site)""",
    dbl="bmi",
)
def site_median_impute(spark, sf):
    df = features_wide(spark, sf).select("rec", "site", F.when(F.col("digits") > 0, F.col("mean_word")).alias("bmi"))
    return hz.impute(df, hz.site_median_imputer(df, "bmi"), "bmi")


@query(
    "impute_standardise",
    FEA + f""", v AS (SELECT rec, feature, CASE WHEN value > 0 THEN value END AS value FROM flong), md AS (SELECT feature, median(value) AS m FROM v WHERE {TRAIN} GROUP BY feature),
f AS (SELECT rec, feature, coalesce(value, m) AS value FROM v JOIN md USING (feature)), s AS (SELECT feature, avg(value) AS mu, stddev_pop(value) AS sd FROM f WHERE {TRAIN} GROUP BY feature)
SELECT rec, feature, value, (value - mu) / sd AS z FROM f JOIN s USING (feature)""",
    dbl="value z",
)
def impute_standardise(spark, sf):
    df = features_long(spark, sf).select("rec", "feature", F.when(F.col("value") > 0, F.col("value")).alias("value"))
    return hz.impute_standardise(df, _train())


def _harmonised(df):
    return df.select("rec", "feature", "harmonised")


@query(
    "site_zscore",
    FEA + f""", s AS (SELECT site, feature, CASE WHEN count(*) FILTER {TRAIN.replace('(', '(WHERE ', 1)} >= 10 THEN avg(value) FILTER {TRAIN.replace('(', '(WHERE ', 1)} ELSE avg(value) END AS mu,
  CASE WHEN count(*) FILTER {TRAIN.replace('(', '(WHERE ', 1)} >= 10 THEN stddev_pop(value) FILTER {TRAIN.replace('(', '(WHERE ', 1)} ELSE stddev_pop(value) END AS sd FROM flong GROUP BY ALL)
SELECT rec, feature, CASE WHEN feature = 'lines' THEN value ELSE (value - mu) / CASE WHEN sd < 1e-8 THEN 1 ELSE sd END END AS harmonised FROM flong JOIN s USING (site, feature)""",
    dbl="harmonised",
)
def site_zscore(spark, sf):
    return _harmonised(hz.site_zscore(features_long(spark, sf), _train(), protect=["lines"]))


_IQR = "CASE WHEN quantile_cont(value, 0.75) - quantile_cont(value, 0.25) > 1e-9 THEN quantile_cont(value, 0.75) - quantile_cont(value, 0.25) ELSE 1 END"


@query(
    "site_robust_adaptive",
    FEA + f""", s AS (SELECT site, feature, {TRAIN} AS tr, median(value) AS md, {_IQR} AS sc FROM flong GROUP BY ALL)
SELECT f.rec, f.feature, (value - md) / sc AS harmonised FROM flong f JOIN s ON s.site = f.site AND s.feature = f.feature AND s.tr = (f.rec % 5 <> 0)""",
    dbl="harmonised",
)
def site_robust_adaptive(spark, sf):
    return _harmonised(hz.site_robust(features_long(spark, sf), _train(), "adaptive"))


@query(
    "site_robust_deployable",
    FEA + f""", tr AS (SELECT * FROM flong WHERE site <> 'es'), s AS (SELECT site, feature, median(value) AS md, {_IQR} AS sc FROM tr GROUP BY ALL), g AS (SELECT feature, median(value) AS gm, {_IQR} AS gs FROM tr GROUP BY ALL)
SELECT f.rec, f.feature, (value - coalesce(md, gm)) / coalesce(sc, gs) AS harmonised FROM flong f JOIN g USING (feature) LEFT JOIN s USING (site, feature)""",
    dbl="harmonised",
)
def site_robust_deployable(spark, sf):
    return _harmonised(hz.site_robust(features_long(spark, sf), F.col("site") != "es", "deployable"))


_SR = FEA + """, r AS (SELECT rec, site, feature, value, rank() OVER (PARTITION BY site, feature ORDER BY value) + (count(*) OVER (PARTITION BY site, feature, value) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY site, feature) AS n FROM flong)"""


@query("site_rank", _SR + " SELECT rec, feature, CASE WHEN n = 1 THEN 0.5 ELSE round_even((r - 1) / (n - 1) * 255, 0) / 255 END AS harmonised FROM r", dbl="harmonised")
def site_rank(spark, sf):
    return _harmonised(hz.site_rank(features_long(spark, sf)))


@query("site_inverse_normal", dbl="harmonised")
def site_inverse_normal(spark, sf):
    """The normal quantile has no SQL form; tests compare it with the standard library."""
    return _harmonised(hz.site_inverse_normal(features_long(spark, sf)))


@query(
    "combat",
    FEA + """, tr AS (SELECT * FROM flong WHERE site <> 'es'), g AS (SELECT feature, avg(value) AS gm, CASE WHEN stddev_pop(value) < 1e-8 THEN 1 ELSE stddev_pop(value) END AS gs FROM tr GROUP BY feature),
s AS (SELECT site, feature, count(*) AS n, (avg(value) - any_value(gm)) / any_value(gs) AS gh, CASE WHEN var_pop(value) / any_value(gs) ** 2 < 1e-8 THEN 1 ELSE var_pop(value) / any_value(gs) ** 2 END AS d FROM tr JOIN g USING (feature) GROUP BY site, feature HAVING count(*) >= 10),
p AS (SELECT feature, avg(gh) AS gb, greatest(var_pop(gh), 1e-8) AS t2 FROM s GROUP BY feature),
e AS (SELECT site, feature, (n * gh / d + gb / t2) / (n / d + 1 / t2) AS gst, sqrt(d) AS ds FROM s JOIN p USING (feature))
SELECT f.rec, f.feature, ((value - gm) / gs - coalesce(gst, gb)) / coalesce(ds, 1) * gs + gm AS harmonised FROM flong f JOIN g USING (feature) JOIN p USING (feature) LEFT JOIN e USING (site, feature)""",
    dbl="harmonised",
    nd=6,
)
def combat(spark, sf):
    return _harmonised(hz.combat(features_long(spark, sf), F.col("site") != "es"))


WN = FEA + """, w AS (SELECT rec, CASE feature WHEN 'mean_word' THEN 'width' ELSE 'power' END AS metric,
  CASE feature WHEN 'chars' THEN 'n1' WHEN 'words' THEN 'n2' WHEN 'lines' THEN 'rem' WHEN 'commas' THEN 'wake' WHEN 'digits' THEN 'n3' ELSE 'n2' END AS stage, value FROM flong)"""


def _by_stage(spark, sf):
    names = F.create_map(*[F.lit(x) for kv in {"chars": "n1_power", "words": "n2_power", "lines": "rem_power", "commas": "wake_power", "digits": "n3_power", "mean_word": "n2_width"}.items() for x in kv])
    df = features_long(spark, sf)
    df = df.withColumn("feature", F.concat(F.lit("spec_"), names[F.col("feature")]))
    return hz.split_stage(df, "spec_").select("rec", "metric", "stage", "value")


@query("within_night_ratio", WN + " SELECT a.rec, a.metric, a.stage, CASE WHEN abs(b.value) >= 1e-12 THEN a.value / b.value END AS ratio FROM w a JOIN w b ON a.rec = b.rec AND a.metric = b.metric AND b.stage = 'n2' WHERE a.stage <> 'n2'", dbl="ratio")
def within_night_ratio(spark, sf):
    return hz.within_night_ratio(_by_stage(spark, sf), ["rec"])


@query(
    "within_night_z",
    WN + " SELECT rec, metric, stage, CASE WHEN stddev_pop(value) OVER (PARTITION BY rec, metric) >= 1e-12 THEN (value - avg(value) OVER (PARTITION BY rec, metric)) / stddev_pop(value) OVER (PARTITION BY rec, metric) END AS z FROM w",
    dbl="z",
)
def within_night_z(spark, sf):
    return hz.within_night_z(_by_stage(spark, sf), ["rec"])


DISC = FEA + """, m AS (SELECT site, feature, count(*) AS n, avg(value) AS m, var_pop(value) * count(*) AS ss FROM flong GROUP BY ALL HAVING count(*) >= 10), g AS (SELECT feature, avg(value) AS g FROM flong GROUP BY feature),
d AS (SELECT feature, (sum(n * (m - g) ** 2) / greatest(count(*) - 1, 1)) / (greatest(sum(ss), 1e-8) / greatest(sum(n) - count(*), 1)) AS ratio FROM m JOIN g USING (feature) GROUP BY feature)"""


@query("site_discriminability", DISC + " SELECT feature, ratio FROM d", dbl="ratio")
def site_discriminability(spark, sf):
    return hz.site_discriminability(features_long(spark, sf))


@query("drop_site_discriminative", DISC + " SELECT feature, ratio FROM d QUALIFY row_number() OVER (ORDER BY ratio DESC, feature) > round_even(count(*) OVER () * 0.3, 0)", dbl="ratio")
def drop_site_discriminative(spark, sf):
    return hz.drop_top_fraction(hz.site_discriminability(features_long(spark, sf)), "ratio", 0.3)


# ------------------------------------------------------------------ selection
@query("near_constant_filter", FEA + " SELECT feature, max(n) / sum(n) AS share, max(n) / sum(n) >= 0.99 AS near_constant FROM (SELECT feature, value, count(*) AS n FROM flong GROUP BY ALL) GROUP BY feature", dbl="share")
def near_constant_filter(spark, sf):
    return hz.modal_share(features_long(spark, sf))


@query(
    "spearman_with_label",
    FEA + """, r AS (SELECT feature, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS a,
  rank() OVER (PARTITION BY feature ORDER BY label) + (count(*) OVER (PARTITION BY feature, label) - 1) / 2.0 AS b FROM lab)
SELECT feature, count(*) AS n, corr(a, b) AS rho FROM r GROUP BY feature""",
    dbl="rho",
)
def spearman_with_label(spark, sf):
    return hz.spearman_with_label(features_long(spark, sf))


SPP = FEA + """, r AS (SELECT rec, feature, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS a FROM flong),
nm AS (SELECT unnest(['chars', 'words', 'lines', 'digits', 'commas', 'mean_word']) AS f, unnest(range(6)) AS i)
SELECT x.feature AS feature_i, y.feature AS feature_j, corr(x.a, y.a) AS rho FROM r x JOIN r y USING (rec) JOIN nm p ON p.f = x.feature JOIN nm q ON q.f = y.feature WHERE p.i < q.i GROUP BY ALL"""


@query("spearman_matrix", SPP, dbl="rho")
def spearman_matrix(spark, sf):
    return hz.spearman_pairs(features_long(spark, sf), "rec", list(TEXT_FEATURES))


@query("collinearity_pruning")
def collinearity_pruning(spark, sf):
    """Greedy, order-dependent survivors in label order (the matrix has its own oracle)."""
    long = features_long(spark, sf)
    order = [r.feature for r in hz.spearman_with_label(long).orderBy(F.abs("rho").desc(), "feature").select("feature").collect()]
    kept = hz.prune_collinear(hz.spearman_pairs(long, "rec", list(TEXT_FEATURES)), order)
    return spark.createDataFrame([(f, i) for i, f in enumerate(kept)], "feature STRING, position INT")


@query("auroc_feature_filter", f"SELECT feature, auroc, greatest(auroc, 1 - auroc) AS folded FROM ({MW}) WHERE greatest(auroc, 1 - auroc) >= 0.52", dbl="auroc folded")
def auroc_feature_filter(spark, sf):
    return hz.auroc_filter(features_long(spark, sf), 0.52)


@query(
    "selector_consensus",
    FEA + """, s AS (SELECT 'mean' AS method, feature, avg(value) AS v FROM flong GROUP BY feature UNION ALL SELECT 'sd', feature, stddev_pop(value) FROM flong GROUP BY feature UNION ALL SELECT 'cv', feature, stddev_pop(value) / avg(value) FROM flong GROUP BY feature),
r AS (SELECT feature, row_number() OVER (PARTITION BY method ORDER BY v DESC, feature) AS k FROM s)
SELECT feature, avg(k) AS mean_rank, median(k) AS median_rank, count(*) FILTER (k <= 10) AS top10, count(*) FILTER (k <= 20) AS top20 FROM r GROUP BY feature""",
    dbl="mean_rank median_rank",
)
def selector_consensus(spark, sf):
    agg = features_long(spark, sf).groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    cells = F.array(*[F.struct(F.lit(m).alias("method"), c.alias("importance")) for m, c in {"mean": F.col("mean"), "sd": F.col("sd"), "cv": F.col("sd") / F.col("mean")}.items()])
    return hz.selector_consensus(agg.select("feature", F.explode(cells).alias("_c")).select("feature", "_c.*"))
