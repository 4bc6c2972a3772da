"""Table sources and sinks: CSV reads, cohort registry, shard merge, incremental export, score files."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clock import mixed_timestamp
from ..operators import clean
from ..operators.joins import first_per_key
from ..schemas import DEMOGRAPHICS, ICD_CODES


def read_demographics(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Header-mapped read, cleaned to the recordings schema."""
    raw = spark.read.csv(paths, header=True, schema=DEMOGRAPHICS)
    number = lambda c: clean.to_number(F.col(c))
    return raw.select(
        F.col("SiteID").alias("site"), F.col("BDSPPatientID").alias("patient_id"), F.col("BidsFolder").alias("bids_folder"),
        F.trim("SessionID").alias("session"), mixed_timestamp(F.col("CreationTime")).alias("creation_time"),
        number("Age").alias("age"), clean.sex(F.col("Sex")).alias("sex"), clean.race(F.col("Race")).alias("race"),
        clean.ethnicity(F.col("Ethnicity")).alias("ethnicity"), number("BMI").alias("bmi"),
        clean.to_bool(F.col("Cognitive_Impairment")).alias("label"), number("Time_to_Event").alias("time_to_event"),
        F.to_date(mixed_timestamp(F.col("Last_Known_Visit_Date"))).alias("last_visit"), number("Time_to_Last_Visit").alias("time_to_last_visit"),
    )


def list_recordings(demographics: DataFrame) -> DataFrame:
    return demographics.select("bids_folder", "site", "session").distinct()


def read_icd_codes(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    raw = spark.read.csv(paths, header=True, schema=ICD_CODES)
    return raw.select(
        F.col("SiteID").alias("site"), F.col("BDSPPatientID").alias("patient_id"), mixed_timestamp(F.col("ICDDate")).alias("icd_date"),
        F.col("ICD9").alias("icd9"), F.col("ICD10").alias("icd10"),
    )


def read_distinct_csv(spark: SparkSession, paths: Sequence[str], schema: str) -> DataFrame:
    """Several label or prediction files as one table without exact duplicates."""
    return spark.read.csv(list(paths), header=True, schema=schema).distinct()


class CohortRegistry:
    """Named cohorts on any Spark filesystem: name -> base folder."""

    def __init__(self, cohorts: dict[str, str]):
        self.cohorts = dict(cohorts)

    def path(self, name: str, *parts: str) -> str:
        if name not in self.cohorts:
            raise KeyError(f"unknown cohort {name!r}; known: {sorted(self.cohorts)}")
        return "/".join([self.cohorts[name].rstrip("/"), *parts])

    def demographics(self, spark: SparkSession, name: str) -> DataFrame:
        return read_demographics(spark, self.path(name, "demographics.csv"))

    def codes(self, spark: SparkSession, name: str) -> DataFrame:
        return read_icd_codes(spark, self.path(name, "icd_codes_CI.csv"))


def merge_shards(shards: Sequence[DataFrame], keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Union shards with identical headers; the first row per key wins."""
    header = shards[0].columns
    for i, s in enumerate(shards):
        if s.columns != header:
            raise ValueError(f"shard {i}: header differs: {s.columns} != {header}")
    return first_per_key(reduce(DataFrame.unionByName, shards), keys, order)


def pending(source: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not in the output yet (resume)."""
    return source.join(done.select(*keys).distinct(), list(keys), "left_anti")


def export_features(df: DataFrame, path: str, columns: Sequence[str] | None = None, fmt: str = "parquet", partition: str | None = "site", mode: str = "append") -> None:
    """Feature table sink with a fixed column order. Parquet is clustered by site; CSV keeps the header."""
    out = df.select(*columns) if columns else df
    writer = out.write.mode(mode)
    if fmt == "csv":
        writer.option("header", "true").csv(path)
    else:
        (writer.partitionBy(partition) if partition else writer).parquet(path)


def export_incremental(df: DataFrame, path: str, keys: Sequence[str], **kw) -> None:
    """Append only the recordings missing from an earlier run."""
    spark = df.sparkSession
    try:
        done = spark.read.parquet(path)
    except Exception as e:  # no earlier run
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
            raise
        done = None
    export_features(df if done is None else pending(df, done, keys), path, **kw)


def with_predictions(demographics: DataFrame, preds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Demographics plus the two prediction columns; recordings without a prediction keep what they had."""
    p = preds.select(*keys, F.col("pred").alias("_pred"), F.col("prob").alias("_prob"))
    j = demographics.join(p, list(keys), "left")
    old = lambda c, t: F.col(c) if c in demographics.columns else F.lit(None).cast(t)
    return j.withColumn("Cognitive_Impairment", F.coalesce((F.col("_pred") == 1), old("Cognitive_Impairment", "boolean"))).withColumn(
        "Cognitive_Impairment_Probability", F.coalesce("_prob", old("Cognitive_Impairment_Probability", "double"))
    ).drop("_pred", "_prob")


def write_scores(scores: DataFrame, by_age: DataFrame, folder: str) -> None:
    """Headline scores as ``name: value`` lines and the age table tab-separated (both are small by construction)."""
    line = F.concat_ws(": ", "metric", F.format_number("value", 3))
    scores.orderBy("metric").select(line.alias("value")).coalesce(1).write.mode("overwrite").text(f"{folder}/scores")
    by_age.orderBy("age").coalesce(1).write.mode("overwrite").option("sep", "\t").option("header", "true").csv(f"{folder}/by_age")


def epoch_sequences(epochs: DataFrame, keys: Sequence[str], fields: Sequence[str], max_len: int | None = None) -> DataFrame:
    """Per-epoch rows to one ordered sequence per night (about a thousand epochs): log1p, cohort z-norm; thinned evenly to ``max_len`` where given."""
    from ..operators.cohort import even_subsample

    logged = epochs.select(*keys, "epoch", "stage", *[F.signum(F.col(f)) * F.log1p(F.abs(F.col(f))) for f in fields]).toDF(*keys, "epoch", "stage", *fields)
    stats = logged.agg(*[F.avg(f).alias(f"_m_{f}") for f in fields], *[F.stddev_pop(f).alias(f"_s_{f}") for f in fields])
    z = lambda f: F.coalesce((F.col(f) - F.col(f"_m_{f}")) / F.when(F.col(f"_s_{f}") > 0, F.col(f"_s_{f}")), F.lit(0.0))
    normed = logged.join(F.broadcast(stats)).select(*keys, "epoch", "stage", F.array(*[z(f) for f in fields]).alias("x"))  # one row
    short = normed if max_len is None else even_subsample(normed, keys, "epoch", max_len)
    return short.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("epoch", "stage", "x"))).alias("sequence"))
