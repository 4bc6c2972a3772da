"""Views over the supplied tables in the shapes of an overnight-recording cohort.

events -> per-user ordered streams (stage epochs, coded 1 Hz samples, SpO2);
documents + labels -> one recording per document (site, age, label, probability, features).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clock import clock_seconds
from ..operators.ordered import Axis, ordinal, with_axis
from ..session import cut_lineage

USER = ["user_id"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# Fixed mapping of event types to stage codes and to respiratory codes.
STAGE_OF = {"purchase": 1, "view": 2, "click": 3, "signup": 4, "error": 5}
RESP_OF = {"view": 0, "click": 1, "purchase": 2, "signup": 4, "error": 5}


def _mapped(values: dict[str, int]) -> Column:
    first, *rest = values.items()
    col = F.when(F.col("event_type") == first[0], first[1])
    return reduce(lambda c, kv: c.when(F.col("event_type") == kv[0], kv[1]), rest, col)


def props_k() -> Column:
    return F.regexp_extract("props", r"(\d+)", 1).cast("int")


def streams(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Axis]:
    """One row per sample: user_id, epoch (= idx), stage, code, limb, value, spo2_raw, k, ts."""
    ev = read(spark, sf_dir, "events").select(
        "user_id",
        "ts",
        "event_id",
        "value",
        props_k().alias("k"),
        F.when(props_k() < 5, 9).otherwise(_mapped(STAGE_OF)).alias("stage"),
        _mapped(RESP_OF).alias("code"),
        (100.0 - F.col("value") / 4).alias("spo2_raw"),
    )
    ev, ax = with_axis(ev, USER, ("ts", "event_id"), clock_seconds("ts"))
    out = ordinal(ev, ax, "epoch").withColumn("idx", F.col("epoch"))
    return out, Axis(ax.keys, ("epoch",), ax.chunked)


STREAM_SQL = """
streams AS (
  SELECT user_id, ts, event_id, value,
    CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) AS k,
    CASE WHEN CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) < 5 THEN 9
         ELSE CASE event_type WHEN 'purchase' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3
                              WHEN 'signup' THEN 4 WHEN 'error' THEN 5 END END AS stage,
    CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2
                    WHEN 'signup' THEN 4 WHEN 'error' THEN 5 END AS code,
    100.0 - value / 4 AS spo2_raw,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS epoch
  FROM events)"""


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec, site, source, age, label (NULL where unlabelled), toxic, prob, pred, n_chars."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = read(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("rec"),
        F.col("lang").alias("site"),
        "source",
        (50 + F.col("doc_id") % 40).cast("double").alias("age"),
        F.col("quality").alias("label"),
        "toxic",
        ((F.col("n_chars") % 200) / 200.0).alias("prob"),
        "n_chars",
    ).withColumn("pred", (F.col("prob") > 0.5).cast("int"))


COHORT_SQL = """
cohort AS (
  SELECT d.doc_id AS rec, d.lang AS site, d.source, CAST(50 + d.doc_id % 40 AS DOUBLE) AS age,
    l.quality AS label, l.toxic, (d.n_chars % 200) / 200.0 AS prob, d.n_chars,
    CASE WHEN (d.n_chars % 200) / 200.0 > 0.5 THEN 1 ELSE 0 END AS pred
  FROM documents d LEFT JOIN labels l USING (doc_id))"""

TEXT_FEATURES = ("chars", "words", "lines", "digits", "commas", "mean_word")


def features_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six whole-text counts per document beside the cohort columns."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    n = F.length("text")
    count = lambda c: n - F.length(F.replace("text", F.lit(c), F.lit("")))
    words = (count(" ") + 1).cast("double")
    feats = docs.select(
        F.col("doc_id").alias("rec"),
        n.cast("double").alias("chars"),
        words.alias("words"),
        (count("\n") + 1).cast("double").alias("lines"),
        F.length(F.regexp_replace("text", "[^0-9]+", "")).cast("double").alias("digits"),
        count(",").cast("double").alias("commas"),
        (n / words).alias("mean_word"),
    )
    # whole texts are read once; every later pass works on the narrow feature table
    return cut_lineage(cohort(spark, sf_dir).join(feats, "rec"))


FEATURES_SQL = """
feats AS (
  SELECT doc_id AS rec, CAST(length(text) AS DOUBLE) AS chars,
    CAST(len(string_split(text, ' ')) AS DOUBLE) AS words,
    CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS DOUBLE) AS lines,
    CAST(length(text) - length(regexp_replace(text, '[0-9]', '', 'g')) AS DOUBLE) AS digits,
    CAST(length(text) - length(replace(text, ',', '')) AS DOUBLE) AS commas,
    length(text) / CAST(len(string_split(text, ' ')) AS DOUBLE) AS mean_word
  FROM documents),
wide AS (SELECT c.*, f.* EXCLUDE (rec) FROM cohort c JOIN feats f USING (rec)),
flong AS (UNPIVOT wide ON chars, words, lines, digits, commas, mean_word INTO NAME feature VALUE value)"""


def features_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.explode(
        F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in TEXT_FEATURES])
    )
    return features_wide(spark, sf_dir).select("rec", "site", "age", "label", cells.alias("_c")).select(
        "rec", "site", "age", "label", "_c.feature", "_c.value"
    )
