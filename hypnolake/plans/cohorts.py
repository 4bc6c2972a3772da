"""Cohort, profiling, cleaning and join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.clock import days_between
from ..operators import clean, profile
from ..operators import cohort as co
from ..operators import joins as jn
from ..operators.metrics import quadrant
from ..sources.files import parse_ids
from ..sources.tables import merge_shards as merge
from ..sources.tables import pending
from .registry import query
from .tables import COHORT_SQL, FEATURES_SQL, STREAM_SQL, USER, cohort, features_long, features_wide, read, streams

COH = f"WITH {COHORT_SQL}, lab AS (SELECT * FROM cohort WHERE label IN (0, 1))"
FEA = f"WITH {COHORT_SQL}, {FEATURES_SQL}"


# ------------------------------------------------------------------ labels and weights
def _people(spark, sf):
    c = read(spark, sf, "customer").select(F.col("c_mktsegment").alias("site"), F.col("c_custkey").alias("patient"), "c_acctbal")
    start = F.lit("1994-01-01 06:00:00").cast("timestamp_ntz")
    created = start + F.make_dt_interval((F.col("patient") % 1000).cast("int"))
    return c.withColumn("created", created)


def _codes(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_custkey").alias("patient"), F.col("o_orderdate").alias("code_date"), F.col("o_orderpriority").alias("icd10"))
    return o.join(_people(spark, sf).select("patient", "site"), "patient")


ICD = """WITH people AS (SELECT c_mktsegment AS site, c_custkey AS patient, c_acctbal,
  TIMESTAMP '1994-01-01 06:00:00' + to_days(CAST(c_custkey % 1000 AS INT)) AS created FROM customer),
icd AS (SELECT o_custkey AS patient, site, o_orderdate AS code_date, o_orderpriority AS icd10 FROM orders JOIN people ON o_custkey = patient),
ag AS (SELECT site, patient, min(code_date) AS f, max(code_date) AS l, count(*) AS n_codes FROM icd GROUP BY ALL)"""


@query(
    "incident_labels",
    ICD + """ SELECT p.site, p.patient, n_codes,
  CASE WHEN epoch(l - f) / 86400.0 >= 7 AND epoch(f - created) / 86400.0 BETWEEN 365.25 AND 6 * 365.25 THEN 1 ELSE 0 END AS label,
  floor(epoch(f - created) / 86400.0) AS time_to_event FROM people p LEFT JOIN ag USING (site, patient)""",
    dbl="time_to_event",
)
def incident_labels(spark, sf):
    out = co.incident_labels(_people(spark, sf), _codes(spark, sf), ["site", "patient"], "created", "code_date")
    return out.drop("created", "c_acctbal")


SURV = COH + ", sv AS (SELECT *, CAST(n_chars % 3000 AS DOUBLE) AS surv FROM cohort WHERE label IN (0, 1))"


def _survival(spark, sf):
    return cohort(spark, sf).where("label IN (0, 1)").withColumn("surv", (F.col("n_chars") % 3000).cast("double"))


@query("extreme_cohort", SURV + " SELECT rec, label, surv FROM sv WHERE (label = 1 AND surv <= 730.5) OR (label = 0 AND surv > 2556.75)")
def extreme_cohort(spark, sf):
    return co.extreme_cohort(_survival(spark, sf)).select("rec", "label", "surv")


@query(
    "survival_time_selection",
    ICD + """ SELECT p.patient, CASE WHEN n_codes > 10 THEN 1 ELSE 0 END AS label,
  CASE WHEN n_codes > 10 THEN floor(epoch(f - created) / 86400.0) ELSE floor(epoch(l - created) / 86400.0) END AS surv FROM people p JOIN ag USING (patient)""",
    dbl="surv",
)
def survival_time_selection(spark, sf):
    agg = _codes(spark, sf).groupBy("patient").agg(F.min("code_date").alias("f"), F.max("code_date").alias("l"), F.count(F.lit(1)).alias("n"))
    j = _people(spark, sf).join(agg, "patient").withColumn("label", (F.col("n") > 10).cast("int"))
    surv = co.survival_time(F.col("label"), F.floor(days_between("f", "created")), F.floor(days_between("l", "created")))
    return j.select("patient", "label", surv.alias("surv"))


@query(
    "confidence_weights",
    SURV + """ SELECT rec, 1 - 0.7 * least(greatest(CASE WHEN label = 1 THEN (surv - 730.5) ELSE 2556.75 - surv END / 1826.25, 0), 1) AS weight FROM sv""",
    dbl="weight",
)
def confidence_weights(spark, sf):
    return _survival(spark, sf).select("rec", co.confidence_weight(F.col("label"), F.col("surv"), 0.3).alias("weight"))


# ------------------------------------------------------------------ samples, splits, folds
@query(
    "stratified_sample",
    COH + " SELECT rec, site, label FROM lab QUALIFY row_number() OVER (PARTITION BY site, label ORDER BY md5('7-' || rec), rec) <= 20",
)
def stratified_sample(spark, sf):
    return co.stratified_sample(cohort(spark, sf).where("label IN (0, 1)"), ["site", "label"], "rec", 20, 7).select("rec", "site", "label")


@query(
    "split_train_val_test",
    COH + """, mn AS (SELECT min(c) AS mc FROM (SELECT count(*) AS c FROM lab GROUP BY site, label)),
st AS (SELECT rec, CASE WHEN mc < 2 THEN CAST(label AS VARCHAR) ELSE site || '_' || label END AS stratum FROM lab, mn),
p AS (SELECT rec, row_number() OVER (PARTITION BY stratum ORDER BY md5('42-' || rec)) AS pos, count(*) OVER (PARTITION BY stratum) AS n FROM st)
SELECT rec, CASE WHEN pos <= round(n * 0.15) THEN 'test' WHEN pos <= round(n * 0.15) + round(n * 0.15) THEN 'val' ELSE 'train' END AS split FROM p""",
)
def split_train_val_test(spark, sf):
    return co.split_train_val_test(cohort(spark, sf).where("label IN (0, 1)"), "rec").select("rec", "split")


@query(
    "repeated_stratified_folds",
    COH + """, r AS (SELECT rec, site, label, unnest([0, 1, 2]) AS repeat FROM lab)
SELECT rec, repeat, CAST((row_number() OVER (PARTITION BY site, label, repeat ORDER BY md5('0:' || repeat || '-' || rec)) - 1) % 5 AS INT) AS fold FROM r""",
)
def repeated_stratified_folds(spark, sf):
    return co.stratified_folds(cohort(spark, sf).where("label IN (0, 1)"), "rec", ["site", "label"], 5, 3)


@query(
    "loso_folds",
    COH + """, p AS (SELECT site, count(*) AS n, CAST(sum(label) AS BIGINT) AS k FROM lab GROUP BY site), t AS (SELECT CAST(sum(n) AS BIGINT) AS n, CAST(sum(k) AS BIGINT) AS k FROM p)
SELECT site AS held_out, p.n AS n_test, p.k AS pos_test, t.n - p.n AS n_train, t.k - p.k AS pos_train, (t.k - p.k > 0 AND t.k - p.k < t.n - p.n) AS usable FROM p, t""",
)
def loso_folds(spark, sf):
    return co.loso_folds(cohort(spark, sf).where("label IN (0, 1)"))


@query(
    "positive_subsample",
    COH + """, p AS (SELECT rec, row_number() OVER (ORDER BY md5('3-' || rec)) AS pos, count(*) OVER () AS n FROM lab WHERE label = 1)
SELECT rec, label FROM lab WHERE label = 0 UNION ALL SELECT rec, 1 FROM p WHERE pos <= greatest(round(n * 0.25), 1)""",
)
def positive_subsample(spark, sf):
    return co.subsample_positives(cohort(spark, sf).where("label IN (0, 1)"), "rec", 0.25, 3).select("rec", "label")


@query("matched_controls")
def matched_controls(spark, sf):
    """Greedy allocation depends on order: no SQL form; invariants and a brute-force check are in the tests."""
    return co.matched_controls(cohort(spark, sf).where("label IN (0, 1)"), "rec", ["site"])


@query(
    "even_epoch_subsample",
    f"""WITH {STREAM_SQL}, i AS (SELECT user_id, stage, epoch, row_number() OVER (PARTITION BY user_id, stage ORDER BY epoch) - 1 AS i,
  count(*) OVER (PARTITION BY user_id, stage) AS n FROM streams)
SELECT user_id, stage, epoch FROM i WHERE n <= 6 OR list_contains(list_transform([0,1,2,3,4,5], lambda j: CAST(floor(j * (n - 1) / 5) AS BIGINT)), i)""",
)
def even_epoch_subsample(spark, sf):
    df, ax = streams(spark, sf)
    return co.even_subsample(df.select("user_id", "stage", "epoch"), ["user_id", "stage"], "epoch", 6, within=ax)


# ------------------------------------------------------------------ profiling
_Q = ", ".join(f"quantile_cont(value, {p}) AS {n}" for n, p in profile.PERCENTILES.items())


@query(
    "numeric_summary",
    FEA + f""", v AS (SELECT site, feature, CASE WHEN value > 0 THEN value END AS value FROM flong)
SELECT site, feature, count(*) AS n_total, count(value) AS n_valid, 100.0 * (count(*) - count(value)) / count(*) AS missing_pct, avg(value) AS mean,
  stddev_pop(value) AS std, min(value) AS min, {_Q}, max(value) AS max FROM v GROUP BY ALL""",
    dbl="missing_pct mean std min max " + " ".join(profile.PERCENTILES),
    nd=6,
)
def numeric_summary(spark, sf):
    df = features_long(spark, sf).withColumn("value", F.when(F.col("value") > 0, F.col("value")))
    return profile.numeric_summary(df, ["site", "feature"])


@query(
    "numeric_summary_lineitem",
    f"""WITH v AS (SELECT l_returnflag AS grp, l_extendedprice / 1000 AS value FROM lineitem)
SELECT grp, count(*) AS n_total, count(value) AS n_valid, 0.0 AS missing_pct, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min, {_Q}, max(value) AS max FROM v GROUP BY grp""",
    dbl="missing_pct mean std min max " + " ".join(profile.PERCENTILES),
    nd=6,
)
def numeric_summary_lineitem(spark, sf):
    df = read(spark, sf, "lineitem").select(F.col("l_returnflag").alias("grp"), (F.col("l_extendedprice") / 1000).alias("value"))
    return profile.numeric_summary(df, ["grp"])


@query(
    "histogram_by_edges",
    """WITH e AS (SELECT unnest([0,1,2,3,4]) AS bin), v AS (SELECT l_quantity AS x, l_returnflag AS grp FROM lineitem),
b AS (SELECT grp, bin, [0.0, 10.0, 20.0, 30.0, 40.0, 50.0][bin + 1] AS lo, [0.0, 10.0, 20.0, 30.0, 40.0, 50.0][bin + 2] AS hi FROM (SELECT DISTINCT grp FROM v), e)
SELECT b.grp, CAST(b.bin AS INT) AS bin, CAST(lo AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS hi, count(x) AS n FROM b LEFT JOIN v ON v.grp = b.grp AND x >= lo AND (x < hi OR (bin = 4 AND x = hi)) GROUP BY ALL""",
)
def histogram_by_edges(spark, sf):
    df = read(spark, sf, "lineitem").select(F.col("l_returnflag").alias("grp"), "l_quantity")
    return profile.histogram_by_edges(df, "l_quantity", [0, 10, 20, 30, 40, 50], ["grp"])


_W = f"""(k / n + {profile.Z95**2!r} / (2 * n) {{s}} {profile.Z95!r} * sqrt(k / n * (1 - k / n) / n + {profile.Z95**2!r} / (4 * n * n))) / (1 + {profile.Z95**2!r} / n)"""


@query(
    "prevalence_by_level",
    COH + f""", a AS (SELECT 'site' AS axis, site AS level, label FROM lab UNION ALL SELECT 'source', source, label FROM lab
  UNION ALL SELECT 'decade', CAST(CAST(floor(age / 10) * 10 AS INT) AS VARCHAR), label FROM lab),
c AS (SELECT axis, level, count(*) AS n, CAST(sum(label) AS BIGINT) AS k FROM a GROUP BY ALL)
SELECT axis, level, n, k AS positives, n - k AS negatives, k / n AS rate, {_W.format(s='-')} AS ci_lo, {_W.format(s='+')} AS ci_hi FROM c""",
    dbl="rate ci_lo ci_hi",
)
def prevalence_by_level(spark, sf):
    axes = {"site": F.col("site"), "source": F.col("source"), "decade": clean.age_decade(F.col("age"))}
    return profile.prevalence_by_level(cohort(spark, sf), axes)


@query(
    "site_overview",
    COH + f""", pt AS (SELECT site, source, count(*) AS r, count(label) AS kn, count(*) FILTER (label = 1) AS p, count(*) FILTER (toxic = 1) AS f FROM cohort GROUP BY ALL),
s AS (SELECT site, CAST(sum(r) AS BIGINT) AS n_rows, count(*) AS n_patients, max(r) AS max_rows_per_patient, CAST(sum(kn) AS BIGINT) AS n, CAST(sum(p) AS BIGINT) AS k,
  CAST(sum(f) AS BIGINT) AS with_follow_up FROM pt GROUP BY site)
SELECT site, n_rows, n_patients, max_rows_per_patient, n AS label_known, k AS positives, with_follow_up, n_rows - n AS label_missing, k / n AS prevalence,
  {_W.format(s='-')} AS ci_lo, {_W.format(s='+')} AS ci_hi FROM s""",
    dbl="prevalence ci_lo ci_hi",
)
def site_overview(spark, sf):
    df = cohort(spark, sf).withColumn("follow_up", F.when(F.col("toxic") == 1, 1))
    return profile.site_overview(df, "site", "source", "label", "follow_up")


@query(
    "missingness",
    COH + """, m AS (SELECT count(*) AS n, count(*) FILTER (label IS NULL) AS a, count(*) FILTER (toxic IS NULL) AS b, count(*) FILTER (site IS NULL OR trim(site) = '') AS c FROM cohort)
SELECT unnest(['label', 'toxic', 'site']) AS "column", unnest([a, b, c]) AS n_missing, n AS n_rows, 100.0 * unnest([a, b, c]) / n AS missing_pct FROM m""",
    dbl="missing_pct",
)
def missingness(spark, sf):
    return profile.missingness(cohort(spark, sf), ["label", "toxic", "site"])


@query("cross_tab", COH + " SELECT site, label, count(*) AS n, 100.0 * count(*) / sum(count(*)) OVER (PARTITION BY site) AS row_pct FROM lab GROUP BY site, label", dbl="row_pct")
def cross_tab(spark, sf):
    return profile.cross_tab(cohort(spark, sf).where("label IN (0, 1)"), "site", "label")


@query(
    "column_profile",
    """WITH h AS (SELECT 'o_orderkey' AS "column", CAST(o_orderkey AS VARCHAR) AS v FROM orders UNION ALL SELECT 'o_orderstatus', o_orderstatus FROM orders
  UNION ALL SELECT 'o_totalprice', CAST(o_totalprice AS VARCHAR) FROM orders UNION ALL SELECT 'o_orderdate', CAST(o_orderdate AS VARCHAR) FROM orders
  UNION ALL SELECT 'day_of_week', CAST(dayofweek(o_orderdate) AS VARCHAR) FROM orders)
SELECT "column", CASE WHEN bool_and(regexp_matches(v, '^\\d{4}-\\d{2}-\\d{2}')) THEN 'datetime' WHEN bool_and(regexp_matches(v, '^[+-]?\\d+$')) AND regexp_matches("column", '(id|key)$') THEN 'int (identifier)'
  WHEN bool_and(regexp_matches(v, '^[+-]?\\d+$')) AND count(DISTINCT v) <= 12 THEN 'categorical (int)' WHEN bool_and(regexp_matches(v, '^[+-]?\\d+$')) THEN 'int'
  WHEN bool_and(TRY_CAST(v AS DOUBLE) IS NOT NULL) THEN 'float' ELSE 'categorical (string)' END AS inferred,
  count(*) AS n_rows, count(*) - count(v) AS n_missing, 0.0 AS missing_pct, count(DISTINCT v) AS n_distinct,
  CASE WHEN bool_and(TRY_CAST(v AS DOUBLE) IS NOT NULL) THEN min(TRY_CAST(v AS DOUBLE)) END AS min, CASE WHEN bool_and(TRY_CAST(v AS DOUBLE) IS NOT NULL) THEN max(TRY_CAST(v AS DOUBLE)) END AS max
FROM h GROUP BY "column" """,
    dbl="missing_pct min max",
)
def column_profile(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", (F.dayofweek("o_orderdate") - 1).alias("day_of_week"))
    return profile.profile_columns(o)


@query(
    "codes_per_patient",
    ICD + f""", v AS (SELECT site, patient, count(*) AS value FROM icd GROUP BY ALL)
SELECT site, count(*) AS n_total, count(*) AS n_valid, 0.0 AS missing_pct, avg(value) AS mean, stddev_pop(value) AS std, CAST(min(value) AS DOUBLE) AS min, {_Q}, CAST(max(value) AS DOUBLE) AS max FROM v GROUP BY site""",
    dbl="missing_pct mean std min max " + " ".join(profile.PERCENTILES),
)
def codes_per_patient(spark, sf):
    return profile.codes_per_patient(_codes(spark, sf), "site", "patient")


@query(
    "top_codes_by_site",
    ICD + " SELECT site, icd10, count(*) AS n FROM icd GROUP BY site, icd10 QUALIFY row_number() OVER (PARTITION BY site ORDER BY count(*) DESC, icd10) <= 3",
)
def top_codes_by_site(spark, sf):
    return profile.top_values(_codes(spark, sf), "icd10", 3, ["site"])


@query("top_value_counts", "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 10")
def top_value_counts(spark, sf):
    return profile.top_values(read(spark, sf, "part"), "p_brand", 10)


@query("distinct_counts", "SELECT p_type, count(DISTINCT p_brand) AS n_brands, count(DISTINCT p_name) AS n_names FROM part GROUP BY p_type")
def distinct_counts(spark, sf):
    return read(spark, sf, "part").groupBy("p_type").agg(F.countDistinct("p_brand").alias("n_brands"), F.countDistinct("p_name").alias("n_names"))


@query(
    "montage_signatures",
    """WITH p AS (SELECT user_id, string_agg(DISTINCT event_type, '|' ORDER BY event_type) AS signature, count(DISTINCT event_type) AS c FROM events GROUP BY user_id)
SELECT signature, CAST(c AS INT) AS n_channels, count(*) AS n_recordings FROM p GROUP BY ALL""",
)
def montage_signatures(spark, sf):
    ch = read(spark, sf, "events").select("user_id", F.col("event_type").alias("channel"))
    return profile.montage_signatures(ch, USER)


@query(
    "channel_inventory",
    """WITH c AS (SELECT user_id, event_type AS channel, CAST(128 + (CAST(regexp_extract(props, '(\\d+)', 1) AS INT) % 3) * 64 AS DOUBLE) AS fs FROM events),
f AS (SELECT channel, fs, count(*) AS k FROM c GROUP BY ALL)
SELECT channel, count(DISTINCT user_id) AS n_recordings, 100.0 * count(DISTINCT user_id) / (SELECT count(DISTINCT user_id) FROM c) AS presence_pct,
  (SELECT count(*) FROM f WHERE f.channel = c.channel) AS n_fs, (SELECT fs FROM f WHERE f.channel = c.channel ORDER BY k DESC, fs LIMIT 1) AS fs_mode FROM c GROUP BY channel""",
    dbl="presence_pct",
)
def channel_inventory(spark, sf):
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    ch = read(spark, sf, "events").select("user_id", F.col("event_type").alias("channel"), (128 + (k % 3) * 64).cast("double").alias("fs"))
    return profile.channel_inventory(ch, USER)


@query(
    "coverage_report",
    """WITH d AS (SELECT doc_id AS k, lang AS site FROM documents), l AS (SELECT doc_id AS k FROM labels), e AS (SELECT vec_id AS k FROM embeddings)
SELECT site, count(*) AS n_docs, count(l.k) AS n_labels, count(e.k) AS n_vectors, count(*) FILTER (l.k IS NULL) AS docs_without_labels, count(*) FILTER (e.k IS NULL) AS docs_without_vectors,
  0 AS labels_without_docs, count(*) FILTER (l.k IS NOT NULL AND e.k IS NULL) AS labels_without_vectors, 0 AS vectors_without_docs, count(*) FILTER (e.k IS NOT NULL AND l.k IS NULL) AS vectors_without_labels
FROM d LEFT JOIN l USING (k) LEFT JOIN e USING (k) GROUP BY site""",
)
def coverage_report(spark, sf):
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("k"), F.col("lang").alias("site"))
    on = lambda t, c: read(spark, sf, t).select(F.col(c).alias("k")).join(d, "k")
    return jn.coverage({"docs": d, "labels": on("labels", "doc_id"), "vectors": on("embeddings", "vec_id")}, ["k"], "site")


@query("short_recordings", COH + " SELECT site, count(*) AS n, count(*) FILTER (n_chars / 1000.0 < 1) AS under_1h, count(*) FILTER (n_chars / 1000.0 >= 1 AND n_chars / 1000.0 < 4) AS from_1h_to_4h FROM cohort GROUP BY site")
def short_recordings(spark, sf):
    return profile.short_recordings(cohort(spark, sf).withColumn("hours", F.col("n_chars") / 1000), "site", "hours")


@query(
    "unit_flags",
    """WITH u AS (SELECT CASE WHEN event_type = 'view' THEN 'eeg' WHEN event_type = 'click' THEN 'ecg' ELSE 'spo2' END AS role, CASE WHEN value < 20 THEN 'uv' WHEN value < 40 THEN 'mv' ELSE '%' END AS unit FROM events)
SELECT role, unit, count(*) AS n FROM u WHERE (role = 'eeg' AND unit <> 'uv') OR (role = 'ecg' AND unit = '%') OR (role = 'spo2' AND unit <> '%') GROUP BY ALL""",
)
def unit_flags(spark, sf):
    role = F.when(F.col("event_type") == "view", "eeg").when(F.col("event_type") == "click", "ecg").otherwise("spo2")
    unit = F.when(F.col("value") < 20, "UV ").when(F.col("value") < 40, "mV").otherwise("%")
    return profile.unit_flags(read(spark, sf, "events").select(role.alias("role"), unit.alias("unit")))


@query(
    "missing_feature_causes",
    f"""WITH {STREAM_SQL}, f AS (SELECT c_custkey AS k FROM customer),
fl AS (SELECT o_custkey AS k, max(CASE WHEN o_orderstatus = 'P' AND o_totalprice > 490000 THEN 'bad' END) AS err FROM orders GROUP BY 1),
st AS (SELECT user_id AS k, count(*) AS n, count(*) FILTER (stage < 9) AS s FROM streams GROUP BY 1)
SELECT CASE WHEN fl.k IS NULL THEN 'no_file' WHEN err IS NOT NULL THEN 'load_error' WHEN coalesce(n, 0) = 0 THEN 'empty_stage' WHEN s = 0 THEN 'all_unscored' ELSE 'stale' END AS cause, count(*) AS n
FROM f LEFT JOIN fl USING (k) LEFT JOIN st USING (k) GROUP BY 1""",
)
def missing_feature_causes(spark, sf):
    feats = read(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.lit(None).cast("double").alias("value"))
    err = F.when((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 490000), "bad")
    files = read(spark, sf, "orders").select(F.col("o_custkey").alias("key"), err.alias("error"))
    st, _ = streams(spark, sf)
    return profile.missing_feature_causes(feats, files, st.select(F.col("user_id").alias("key"), "stage"), "key", "value")


@query(
    "spread_statistics",
    f"""WITH {STREAM_SQL} SELECT user_id, stage, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS sd, CASE WHEN count(*) >= 2 THEN stddev_samp(value) / abs(avg(value)) END AS cv,
  CASE WHEN count(*) >= 2 THEN quantile_cont(value, 0.1) END AS p10, CASE WHEN count(*) >= 2 THEN quantile_cont(value, 0.5) END AS p50, CASE WHEN count(*) >= 2 THEN quantile_cont(value, 0.9) END AS p90,
  CASE WHEN count(*) >= 2 THEN quantile_cont(value, 0.75) - quantile_cont(value, 0.25) END AS iqr FROM streams GROUP BY ALL""",
    dbl="mean sd cv p10 p50 p90 iqr",
)
def spread_statistics(spark, sf):
    df, ax = streams(spark, sf)
    return profile.spread(df, ["user_id", "stage"], "value", bounded=not ax.chunked)


@query(
    "survival_describe",
    SURV + " SELECT label, count(*) AS n, avg(surv) AS mean, stddev_samp(surv) AS sd, min(surv) AS min, quantile_cont(surv, 0.25) AS p25, quantile_cont(surv, 0.5) AS p50, quantile_cont(surv, 0.75) AS p75, max(surv) AS max FROM sv GROUP BY label",
    dbl="mean sd min p25 p50 p75 max",
)
def survival_describe(spark, sf):
    return profile.describe_by(_survival(spark, sf), ["label"], "surv")


@query(
    "risk_by_time_tertile",
    SURV + """, q AS (SELECT quantile_cont(surv, 1/3) AS a, quantile_cont(surv, 2/3) AS b FROM sv)
SELECT CASE WHEN surv <= a THEN 1 WHEN surv <= b THEN 2 ELSE 3 END AS tertile, count(*) AS n, avg(prob) AS mean_value FROM sv, q GROUP BY 1""",
    dbl="mean_value",
)
def risk_by_time_tertile(spark, sf):
    return profile.tertile_means(_survival(spark, sf), "surv", "prob")


@query(
    "event_time_by_quadrant",
    SURV + """, q AS (SELECT CASE WHEN label = 1 AND pred = 1 THEN 'TP' WHEN label = 1 THEN 'FN' WHEN pred = 1 THEN 'FP' ELSE 'TN' END AS quadrant, surv FROM sv)
SELECT quadrant, count(*) AS n, avg(surv) AS mean, stddev_samp(surv) AS sd, min(surv) AS min, quantile_cont(surv, 0.25) AS p25, quantile_cont(surv, 0.5) AS p50, quantile_cont(surv, 0.75) AS p75, max(surv) AS max FROM q GROUP BY 1""",
    dbl="mean sd min p25 p50 p75 max",
)
def event_time_by_quadrant(spark, sf):
    return profile.event_time_by_quadrant(_survival(spark, sf), quadrant(), "surv")


@query(
    "recall_by_event_time",
    SURV + " SELECT CASE WHEN surv / 365.25 >= 5 THEN 4 WHEN surv / 365.25 >= 4 THEN 3 WHEN surv / 365.25 >= 3 THEN 2 WHEN surv / 365.25 >= 2 THEN 1 ELSE 0 END AS bin, count(*) AS n_pos, count(*) FILTER (pred = 1) AS tp, avg(CAST(pred AS DOUBLE)) AS recall FROM sv WHERE label = 1 GROUP BY 1",
    dbl="recall",
)
def recall_by_event_time(spark, sf):
    return profile.recall_by_time(_survival(spark, sf), "surv", [1, 2, 3, 4, 5, 6])


# ------------------------------------------------------------------ cleaning
CHANNELS = """WITH t AS (SELECT p_partkey AS rule, CASE WHEN contains(p_name, 'small') THEN p_name || '_PDS' ELSE p_name END || ';' || replace(p_name, ' ', ':') || ';' || p_brand AS names, p_type AS cat FROM part),
al AS (SELECT rule, lower(trim(split_part(names, ';', 1))) AS std_channel, trim(replace(regexp_replace(lower(trim(x)), '(_pds|_eg)', '', 'g'), ':', '-')) AS alias, i - 1 AS position
  FROM (SELECT rule, names, unnest(string_split(names, ';')) AS x, generate_subscripts(string_split(names, ';'), 1) AS i FROM t))"""


def _alias(spark, sf):
    p = read(spark, sf, "part")
    first = F.when(F.col("p_name").contains("small"), F.concat("p_name", F.lit("_PDS"))).otherwise(F.col("p_name"))
    names = F.concat_ws(";", first, F.replace(F.col("p_name"), F.lit(" "), F.lit(":")), F.col("p_brand"))
    return clean.alias_table(p.select(F.col("p_partkey").alias("rule"), names.alias("Channel_Names"), F.col("p_type").alias("Category")))


@query("channel_alias_table", CHANNELS + " SELECT rule, std_channel, alias, CAST(position AS INT) AS position FROM al")
def channel_alias_table(spark, sf):
    return _alias(spark, sf).select("rule", "std_channel", "alias", "position")


@query(
    "standardise_channels",
    CHANNELS + """, fr AS (SELECT alias, min_by(std_channel, rule * 100 + position) AS std_channel, min_by(position, rule * 100 + position) AS position FROM al GROUP BY alias),
ch AS (SELECT l_orderkey AS rec, lower(trim(replace(p_name, ' ', ':'))) AS channel, trim(replace(replace(lower(p_name), ' ', ':'), ':', '-')) AS alias FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL),
j AS (SELECT rec, channel, coalesce(fr.std_channel, ch.alias) AS std_channel, coalesce(position, -1) AS position FROM ch LEFT JOIN fr USING (alias))
SELECT rec, channel, std_channel FROM j QUALIFY row_number() OVER (PARTITION BY rec, std_channel ORDER BY position, channel) = 1""",
)
def standardise_channels(spark, sf):
    part = read(spark, sf, "part").select("p_partkey", F.replace(F.col("p_name"), F.lit(" "), F.lit(":")).alias("channel"))
    li = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("rec"), F.col("l_partkey").alias("p_partkey"))
    ch = li.join(part, "p_partkey").select("rec", "channel").distinct()
    return clean.standardise_channels(ch, _alias(spark, sf), ["rec"]).select("rec", "channel", "std_channel")


@query(
    "channel_roles",
    """WITH c AS (SELECT DISTINCT user_id, event_type, CASE WHEN value < 10 THEN 'ECG-II' WHEN value < 20 THEN 'SpO2' WHEN value < 30 THEN 'Chin EMG' WHEN value < 40 THEN 'R LEG'
  WHEN value < 60 THEN 'E1-M2' WHEN value < 80 THEN 'Nasal Flow' WHEN value < 100 THEN 'ABD' WHEN value < 140 THEN 'C3-M2' ELSE 'Snore' END AS channel FROM events)
SELECT channel, CASE channel WHEN 'ECG-II' THEN 'ecg' WHEN 'SpO2' THEN 'spo2' WHEN 'Chin EMG' THEN 'chin_emg' WHEN 'R LEG' THEN 'limb_emg' WHEN 'E1-M2' THEN 'eog' WHEN 'Nasal Flow' THEN 'airflow'
  WHEN 'ABD' THEN 'effort' WHEN 'C3-M2' THEN 'eeg' ELSE 'other' END AS role, count(*) AS n FROM c GROUP BY ALL""",
)
def channel_roles(spark, sf):
    c = _labelled_channels(spark, sf)
    return c.withColumn("role", clean.channel_role(F.col("channel"))).groupBy("channel", "role").agg(F.count(F.lit(1)).alias("n"))


def _labelled_channels(spark, sf):
    v = F.col("value")
    name = (
        F.when(v < 10, "ECG-II").when(v < 20, "SpO2").when(v < 30, "Chin EMG").when(v < 40, "R LEG").when(v < 60, "E1-M2")
        .when(v < 80, "Nasal Flow").when(v < 100, "ABD").when(v < 140, "C3-M2").otherwise("Snore")
    )
    return read(spark, sf, "events").select("user_id", "event_type", name.alias("channel")).distinct()


@query(
    "channel_pick",
    """WITH c AS (SELECT DISTINCT user_id, CASE WHEN value < 30 THEN 'C3-M2' WHEN value < 60 THEN 'F3-M2' WHEN value < 90 THEN 'O1-M2' ELSE 'Cz' END AS channel FROM events)
SELECT user_id, channel FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY CASE channel WHEN 'O1-M2' THEN 0 WHEN 'F3-M2' THEN 1 ELSE 2 END, channel) = 1""",
)
def channel_pick(spark, sf):
    v = F.col("value")
    name = F.when(v < 30, "C3-M2").when(v < 60, "F3-M2").when(v < 90, "O1-M2").otherwise("Cz")
    ch = read(spark, sf, "events").select("user_id", name.alias("channel")).distinct()
    ch = ch.withColumn("role", clean.channel_role(F.col("channel")))
    return clean.pick_channel(ch, USER, "eeg", ["o1", "f3"])


@query(
    "sanitise_scalars",
    """WITH r AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN '"' || value || '"' WHEN 1 THEN '[' || CAST(event_id AS VARCHAR) || ']' WHEN 2 THEN ' True ' WHEN 3 THEN 'No' WHEN 4 THEN 'n/a' ELSE '''1''' END AS raw FROM events),
s AS (SELECT event_id, regexp_replace(raw, '["''\\[\\]()\\s]', '', 'g') AS w FROM r)
SELECT event_id, TRY_CAST(w AS DOUBLE) AS num, CASE WHEN TRY_CAST(w AS DOUBLE) = floor(TRY_CAST(w AS DOUBLE)) THEN CAST(TRY_CAST(w AS DOUBLE) AS BIGINT) END AS whole,
  CASE WHEN lower(w) IN ('true', 't', 'yes', 'y', '1', '1.0') THEN 1 WHEN lower(w) IN ('false', 'f', 'no', 'n', '0', '0.0') THEN 0 END AS flag FROM s""",
    dbl="num",
)
def sanitise_scalars(spark, sf):
    e = F.col("event_id")
    raw = (
        F.when(e % 6 == 0, F.concat(F.lit('"'), F.col("value").cast("string"), F.lit('"')))
        .when(e % 6 == 1, F.concat(F.lit("["), e.cast("string"), F.lit("]")))
        .when(e % 6 == 2, " True ").when(e % 6 == 3, "No").when(e % 6 == 4, "n/a").otherwise("'1'")
    )
    ev = read(spark, sf, "events").select("event_id", raw.alias("raw"))
    return ev.select("event_id", clean.to_number(F.col("raw")).alias("num"), clean.to_int(F.col("raw")).alias("whole"), clean.to_bool(F.col("raw")).alias("flag"))


_DEMO = """WITH d AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'female' WHEN 1 THEN ' Male' ELSE 'x' END AS sex,
  ['White', 'Black or African American', 'Asian', 'Pacific', '', 'Declined'][doc_id % 6 + 1] AS race, ['Hispanic or Latino', 'Not Hispanic', 'unknown', 'Not Latino', 'Non-Latino'][doc_id % 5 + 1] AS eth FROM documents)"""


@query(
    "demographic_one_hot",
    _DEMO + """ SELECT doc_id, CAST(sex = 'female' AS INT) AS sex_f, CAST(sex = ' Male' AS INT) AS sex_m, CAST(sex = 'x' AS INT) AS sex_o,
  CAST(race = 'Asian' AS INT) AS race_asian, CAST(race LIKE 'Black%' AS INT) AS race_black, CAST(race = 'Pacific' AS INT) AS race_other, CAST(race IN ('', 'Declined') AS INT) AS race_unavail, CAST(race = 'White' AS INT) AS race_white,
  CAST(eth LIKE 'Hispanic%' AS INT) AS eth_hispanic, CAST(eth IN ('Not Hispanic', 'Not Latino', 'Non-Latino') AS INT) AS eth_not_hispanic, CAST(eth = 'unknown' AS INT) AS eth_unavail FROM d""",
)
def demographic_one_hot(spark, sf):
    i = F.col("doc_id")
    pick = lambda vals: F.get(F.array(*[F.lit(v) for v in vals]), (i % len(vals)).cast("int"))
    d = read(spark, sf, "documents").select(
        "doc_id", pick(["female", " Male", "x"]).alias("sex"),
        pick(["White", "Black or African American", "Asian", "Pacific", "", "Declined"]).alias("race"),
        pick(["Hispanic or Latino", "Not Hispanic", "unknown", "Not Latino", "Non-Latino"]).alias("ethnicity"),
    )
    return clean.demographic_one_hot(d).drop("sex", "race", "ethnicity")


@query(
    "clinical_bands",
    COH + """ SELECT rec, CAST(floor(age / 10) * 10 AS INT) AS decade, CASE WHEN age < 50 THEN '<50' WHEN age < 60 THEN '50-59' WHEN age < 70 THEN '60-69' WHEN age < 80 THEN '70-79' ELSE '80+' END AS age_band,
  CASE WHEN n_chars % 45 < 18.5 THEN 'under' WHEN n_chars % 45 < 25 THEN 'normal' WHEN n_chars % 45 < 30 THEN 'over' ELSE 'obese' END AS bmi_class,
  CASE WHEN n_chars % 60 < 5 THEN 'none' WHEN n_chars % 60 < 15 THEN 'mild' WHEN n_chars % 60 < 30 THEN 'moderate' ELSE 'severe' END AS ahi_severity FROM cohort""",
)
def clinical_bands(spark, sf):
    return cohort(spark, sf).select(
        "rec", clean.age_decade(F.col("age")).alias("decade"), clean.age_band(F.col("age")).alias("age_band"),
        clean.bmi_class(F.col("n_chars") % 45).alias("bmi_class"), clean.ahi_severity(F.col("n_chars") % 60).alias("ahi_severity"),
    )


@query(
    "signal_envelope",
    f"""WITH {STREAM_SQL}, b AS (SELECT user_id, epoch, value, CAST(floor(epoch * 8 / count(*) OVER (PARTITION BY user_id)) AS INT) AS bucket FROM streams),
p AS (SELECT *, row_number() OVER (PARTITION BY user_id, bucket ORDER BY value, epoch) AS lo, row_number() OVER (PARTITION BY user_id, bucket ORDER BY value DESC, epoch) AS hi FROM b)
SELECT user_id, bucket, epoch AS idx, value FROM p WHERE lo = 1 OR hi = 1""",
)
def signal_envelope(spark, sf):
    df, _ = streams(spark, sf)
    return clean.envelope(df, USER, "idx", "value", 8)


@query(
    "feature_presets",
    COH + " SELECT rec, n_chars AS n_epochs FROM cohort",
)
def feature_presets(spark, sf):
    df = cohort(spark, sf).select("rec", "age", F.col("prob").alias("hrv_sdnn"), F.col("pred").alias("sex_f"), F.col("n_chars").alias("n_epochs"))
    return clean.select_preset(df, ["rec"], "caisr_only")


@query(
    "column_mask_ablation",
    FEA + " SELECT rec, CAST(NULL AS DOUBLE) AS chars, CAST(NULL AS DOUBLE) AS words, lines FROM wide",
    dbl="lines",
)
def column_mask_ablation(spark, sf):
    df = features_wide(spark, sf).select("rec", "chars", "words", "lines")
    return clean.mask_columns(df, "^(chars|words)$", ["rec"])


@query("leakage_exclusion", COH + " SELECT rec, site, source, toxic, prob, pred, n_chars FROM cohort", dbl="prob")
def leakage_exclusion(spark, sf):
    return clean.drop_leaky(cohort(spark, sf).drop("age"))


# ------------------------------------------------------------------ joins and sets
@query(
    "join_feature_families",
    FEA + """, a AS (SELECT CAST(rec AS VARCHAR) AS rec, words AS nk__words, lines AS nk__lines FROM wide WHERE words > 50),
b AS (SELECT CAST(rec AS VARCHAR) AS rec, digits AS rep__digits FROM wide WHERE digits > 0)
SELECT trim(CAST(c.rec AS VARCHAR)) AS rec, site, nk__words, nk__lines, CASE WHEN a.rec IS NULL THEN 0 ELSE 1 END AS nk__matched, rep__digits, CASE WHEN b.rec IS NULL THEN 0 ELSE 1 END AS rep__matched
FROM cohort c LEFT JOIN a ON a.rec = CAST(c.rec AS VARCHAR) LEFT JOIN b ON b.rec = CAST(c.rec AS VARCHAR)""",
    dbl="nk__words nk__lines rep__digits",
)
def join_feature_families(spark, sf):
    w = features_wide(spark, sf)
    fams = {"nk": w.where("words > 50").select("rec", "words", "lines"), "rep": w.where("digits > 0").select("rec", "digits")}
    return jn.join_families(cohort(spark, sf).select("rec", "site"), fams, ["rec"])


@query("lookup_join_labels", "SELECT d.doc_id, lang, quality, toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def lookup_join_labels(spark, sf):
    return read(spark, sf, "documents").select("doc_id", "lang").join(read(spark, sf, "labels"), "doc_id", "left")


@query("age_band_range_join", "SELECT p.p_partkey, s.s_suppkey FROM part p JOIN supplier s ON abs(p.p_size * 100.0 - s.s_acctbal) <= 25")
def age_band_range_join(spark, sf):
    p = read(spark, sf, "part").select("p_partkey", (F.col("p_size") * 100.0).alias("a"))
    s = read(spark, sf, "supplier").select("s_suppkey", F.col("s_acctbal").alias("b"))
    return jn.range_join(p, s, "a", "b", 25.0).select("p_partkey", "s_suppkey")


@query("anti_join_gaps", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join_gaps(spark, sf):
    return jn.anti_gaps(read(spark, sf, "documents").select("doc_id", "lang"), read(spark, sf, "labels"), ["doc_id"])


@query("semi_join_with_code", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def semi_join_with_code(spark, sf):
    o = read(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return jn.with_any(read(spark, sf, "customer").select("c_custkey", "c_mktsegment"), o, ["c_custkey"])


@query(
    "scorer_agreement",
    f"""WITH {STREAM_SQL}, b AS (SELECT user_id, epoch, CASE WHEN value > 60 THEN 2 ELSE stage END AS st FROM streams)
SELECT user_id, count(*) AS n_epochs, avg(CASE WHEN a.stage = b.st THEN 1.0 ELSE 0.0 END) AS agreement FROM streams a JOIN b USING (user_id, epoch) WHERE a.stage <> 9 AND b.st <> 9 GROUP BY user_id""",
    dbl="agreement",
)
def scorer_agreement(spark, sf):
    df, _ = streams(spark, sf)
    second = df.select("user_id", "epoch", F.when(F.col("value") > 60, 2).otherwise(F.col("stage")).alias("stage"))
    return jn.scorer_agreement(df.select("user_id", "epoch", "stage"), second, USER)


@query(
    "first_code_per_patient",
    """SELECT c_custkey, c_mktsegment, o_orderkey, o_orderdate FROM customer JOIN
(SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1) ON o_custkey = c_custkey""",
)
def first_code_per_patient(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate")
    first = jn.first_per_key(o, ["c_custkey"], ["o_orderdate", "o_orderkey"])
    return read(spark, sf, "customer").select("c_custkey", "c_mktsegment").join(first, "c_custkey")


@query(
    "pairwise_self_join",
    f"""WITH n AS (SELECT user_id, event_type AS node, avg(value) AS v FROM events GROUP BY ALL)
SELECT a.user_id, a.node AS node_i, b.node AS node_j, a.v - b.v AS delta FROM n a JOIN n b ON a.user_id = b.user_id AND a.node < b.node""",
    dbl="delta",
)
def pairwise_self_join(spark, sf):
    n = read(spark, sf, "events").groupBy("user_id", F.col("event_type").alias("node")).agg(F.avg("value").alias("v"))
    return jn.pairs(n, USER, "node", ["v"]).select("user_id", "node_i", "node_j", (F.col("v_i") - F.col("v_j")).alias("delta"))


@query("union_distinct", "SELECT s_nationkey AS nation FROM supplier UNION SELECT c_nationkey FROM customer")
def union_distinct(spark, sf):
    a = read(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"))
    return a.unionByName(read(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"))).distinct()


@query("key_set_difference", "SELECT doc_id FROM documents EXCEPT SELECT vec_id FROM embeddings")
def key_set_difference(spark, sf):
    return read(spark, sf, "documents").select("doc_id").subtract(read(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id")))


@query("key_set_intersection", "SELECT doc_id FROM labels INTERSECT SELECT vec_id FROM embeddings")
def key_set_intersection(spark, sf):
    return read(spark, sf, "labels").select("doc_id").intersect(read(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id")))


@query("common_feature_alignment", "SELECT doc_id, n FROM (SELECT doc_id, n_chars AS n FROM documents UNION ALL SELECT doc_id, toxic FROM labels)")
def common_feature_alignment(spark, sf):
    a = read(spark, sf, "documents").select("doc_id", "lang", F.col("n_chars").alias("n"))
    b = read(spark, sf, "labels").select("quality", F.col("toxic").cast("long").alias("n"), "doc_id")
    x, y = clean.common_features(a, b)
    return x.unionByName(y)


@query(
    "merge_shards",
    "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey",
)
def merge_shards(spark, sf):
    return merge(_by_status(spark, sf), ["o_custkey"], ["o_orderkey"])


def _by_status(spark, sf):
    o = read(spark, sf, "orders")
    return [o.where(F.col("o_orderstatus") == s).select("o_custkey", "o_orderkey") for s in ("F", "O", "P")]


@query(
    "incremental_keys",
    "SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def incremental_keys(spark, sf):
    return pending(read(spark, sf, "documents").select("doc_id", "n_chars"), read(spark, sf, "labels"), ["doc_id"])


@query(
    "record_id_parse",
    "SELECT page_id, regexp_extract(url, '([a-z]+)/(\\d+)', 1) AS patient, CAST(nullif(regexp_extract(url, '([a-z]+)/(\\d+)', 2), '') AS INT) AS session FROM pages",
)
def record_id_parse(spark, sf):
    return parse_ids(read(spark, sf, "pages").select("page_id", "url"), "url", r"([a-z]+)/(\d+)").select("page_id", "patient", "session")


@query(
    "session_tolerant_match",
    """WITH w AS (SELECT c_custkey AS pid, CAST(c_custkey % 4 AS VARCHAR) AS session FROM customer),
f AS (SELECT o_custkey AS pid, CASE WHEN o_orderkey % 2 = 0 THEN '0' ELSE '' END || CAST(o_orderkey % 7 AS VARCHAR) AS file_session, 'f' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS file_name FROM orders)
SELECT w.pid, w.session, f.file_name, f.file_session, CASE WHEN session = file_session THEN 0 WHEN ltrim(session, '0') = ltrim(file_session, '0') THEN 1 ELSE 2 END AS match_rank FROM w JOIN f USING (pid)
QUALIFY row_number() OVER (PARTITION BY w.pid, w.session ORDER BY CASE WHEN session = file_session THEN 0 WHEN ltrim(session, '0') = ltrim(file_session, '0') THEN 1 ELSE 2 END, file_name) = 1""",
)
def session_tolerant_match(spark, sf):
    w = read(spark, sf, "customer").select(F.col("c_custkey").alias("pid"), (F.col("c_custkey") % 4).cast("string").alias("session"))
    k = F.col("o_orderkey")
    f = read(spark, sf, "orders").select(
        F.col("o_custkey").alias("pid"),
        F.concat(F.when(k % 2 == 0, "0").otherwise(""), (k % 7).cast("string")).alias("file_session"),
        F.concat(F.lit("f"), F.lpad(k.cast("string"), 9, "0")).alias("file_name"),
    )
    return jn.session_match(w, f, "pid", "session", "file_session", "file_name").select("pid", "session", "file_name", "file_session", "match_rank")
