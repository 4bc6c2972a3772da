"""Data profiling: summaries, prevalence with intervals, missingness, coverage, montage, root causes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .describe import describe, sd_pop, sd_samp

Z95 = 1.959963984540054
PERCENTILES = {"p1": 0.01, "p5": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}


def numeric_summary(df: DataFrame, group: Sequence[str], value: str = "value") -> DataFrame:
    """n_total, n_valid, missing %, mean, population SD, extremes and seven percentiles."""
    group = list(group)
    total = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n_total"))
    d = describe(df, group, value, PERCENTILES).withColumn("std", sd_pop())
    out = total.join(d, group, "left") if group else total.join(F.broadcast(d))  # one row each
    valid = F.coalesce("n", F.lit(0))
    return out.select(
        *group, "n_total", valid.alias("n_valid"), (100.0 * (F.col("n_total") - valid) / F.nullifzero("n_total")).alias("missing_pct"),
        "mean", "std", "min", *PERCENTILES, "max",
    )


def spread(df: DataFrame, group: Sequence[str], value: str, **kw) -> DataFrame:
    """n, mean, SD (ddof 1), CV, p10/p50/p90, IQR; spread is NULL below two values."""
    d = describe(df, group, value, {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}, **kw)
    two = lambda c: F.when(F.col("n") >= 2, c)
    return d.select(
        *group, "n", "mean", sd_samp().alias("sd"),
        two(F.when(F.col("mean") != 0, sd_samp() / F.abs("mean"))).alias("cv"),
        *[two(F.col(p)).alias(p) for p in ("p10", "p50", "p90")],
        two(F.col("p75") - F.col("p25")).alias("iqr"),
    )


def histogram_by_edges(df: DataFrame, value: str, edges: Sequence[float], group: Sequence[str] = ()) -> DataFrame:
    """Left-closed bins, the last closed on both sides; empty bins are kept."""
    v = F.col(value)
    bins = list(zip(edges[:-1], edges[1:]))
    counts = []
    for i, (lo, hi) in enumerate(bins):
        inside = (v >= lo) & ((v <= hi) if i == len(bins) - 1 else (v < hi))
        counts.append(F.coalesce(F.sum(inside.cast("long")), F.lit(0)).alias(f"_b{i}"))
    agg = df.groupBy(*group).agg(*counts)
    cells = F.array(*[
        F.struct(F.lit(i).alias("bin"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi"), F.col(f"_b{i}").alias("n"))
        for i, (lo, hi) in enumerate(bins)
    ])
    return agg.select(*group, F.explode(cells).alias("_c")).select(*group, "_c.*")


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """95 % Wilson limits of a rate."""
    p = k / n
    mid = p + Z95**2 / (2 * n)
    half = Z95 * F.sqrt(p * (1 - p) / n + Z95**2 / (4 * n * n))
    den = 1 + Z95**2 / n
    return F.when(n > 0, (mid - half) / den), F.when(n > 0, (mid + half) / den)


def prevalence_by_level(df: DataFrame, axes: dict[str, Column], label: str = "label") -> DataFrame:
    """n, positives, negatives, rate and interval per axis level; NULL is a level. One pass for all axes."""
    cells = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), c.cast("string").alias("level")) for a, c in axes.items()]))
    at = df.where(F.col(label).isin(0, 1)).select(label, cells.alias("_a")).select(label, "_a.*")
    agg = at.groupBy("axis", "level").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("positives"))
    lo, hi = wilson(F.col("positives"), F.col("n"))
    return agg.select(
        "axis", "level", "n", "positives", (F.col("n") - F.col("positives")).alias("negatives"),
        (F.col("positives") / F.col("n")).alias("rate"), lo.alias("ci_lo"), hi.alias("ci_hi"),
    )


def site_overview(df: DataFrame, site: str, patient: str, label: str, follow_up: str | None = None) -> DataFrame:
    """Rows, patients, rows per patient, label availability and prevalence; patients pre-aggregate first."""
    y = F.col(label)
    has = (F.col(follow_up).isNotNull() if follow_up else F.lit(False)).cast("long")
    per = df.groupBy(site, patient).agg(
        F.count(F.lit(1)).alias("_r"), F.count(y).alias("_k"), F.sum((y == 1).cast("long")).alias("_p"), F.sum(has).alias("_f")
    )
    agg = per.groupBy(site).agg(
        F.sum("_r").alias("n_rows"), F.count(F.lit(1)).alias("n_patients"), F.max("_r").alias("max_rows_per_patient"),
        F.sum("_k").alias("label_known"), F.coalesce(F.sum("_p"), F.lit(0)).alias("positives"), F.sum("_f").alias("with_follow_up"),
    )
    lo, hi = wilson(F.col("positives"), F.col("label_known"))
    rate = F.when(F.col("label_known") > 0, F.col("positives") / F.col("label_known"))
    return agg.select("*", (F.col("n_rows") - F.col("label_known")).alias("label_missing"), rate.alias("prevalence"), lo.alias("ci_lo"), hi.alias("ci_hi"))


def missingness(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """NULL or blank cells per column in one pass."""
    columns = list(columns or df.columns)
    blank = lambda c: (F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")).cast("long")
    agg = df.agg(F.count(F.lit(1)).alias("_n"), *[F.sum(blank(c)).alias(f"_m_{c}") for c in columns])
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_m_{c}").alias("n_missing")) for c in columns]))
    return agg.select("_n", cells.alias("_c")).select(
        "_c.column", "_c.n_missing", F.col("_n").alias("n_rows"), (100.0 * F.col("_c.n_missing") / F.nullifzero("_n")).alias("missing_pct")
    )


def cross_tab(df: DataFrame, row: str, col: str) -> DataFrame:
    """Counts and row shares in long form."""
    cells = df.groupBy(row, col).agg(F.count(F.lit(1)).alias("n"))
    return cells.withColumn("row_pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(row)))


def profile_columns(df: DataFrame, max_levels: int = 12) -> DataFrame:
    """Inferred type, missing share, distinct count and numeric range per column.

    Cells shrink to distinct (column, value) before any type test runs.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.trim(F.col(c).cast("string")).alias("v")) for c in df.columns]))
    vals = df.select(cells.alias("_c")).select("_c.*").withColumn("v", F.when(F.col("v") != "", F.col("v")))
    hist = vals.groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))
    v, known = F.col("v"), F.col("v").isNotNull()
    num = v.try_cast("double")
    every = lambda c: F.coalesce(F.bool_and(F.when(known, F.coalesce(c, F.lit(False)))), F.lit(False))
    agg = hist.groupBy("column").agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.when(known, 0).otherwise(F.col("n"))).alias("n_missing"),
        F.count("v").alias("n_distinct"),
        every(F.lower(v).isin("true", "false")).alias("_bool"),
        every(v.rlike(r"^\d{4}-\d{2}-\d{2}")).alias("_date"),
        every(v.rlike(r"^[+-]?\d+$")).alias("_int"),
        every(num.isNotNull()).alias("_float"),
        F.min(num).alias("min"),
        F.max(num).alias("max"),
    )
    kind = (
        F.when(F.col("n_distinct") == 0, "empty")
        .when(F.col("_bool"), "categorical (bool)")
        .when(F.col("_date"), "datetime")
        .when(F.col("_int") & F.lower("column").rlike("(id|key)$"), "int (identifier)")
        .when(F.col("_int") & (F.col("n_distinct") <= max_levels), "categorical (int)")
        .when(F.col("_int"), "int")
        .when(F.col("_float"), "float")
        .otherwise("categorical (string)")
    )
    numeric = F.col("_int") | F.col("_float")
    return agg.select(
        "column", kind.alias("inferred"), "n_rows", "n_missing", (100.0 * F.col("n_missing") / F.col("n_rows")).alias("missing_pct"),
        "n_distinct", F.when(numeric, F.col("min")).alias("min"), F.when(numeric, F.col("max")).alias("max"),
    )


def codes_per_patient(codes: DataFrame, site: str, patient: str) -> DataFrame:
    """Summary of codes per patient, by site."""
    per = codes.groupBy(site, patient).agg(F.count(F.lit(1)).alias("value"))
    return numeric_summary(per, [site], "value")


def top_values(df: DataFrame, col: str, k: int, group: Sequence[str] = ()) -> DataFrame:
    """Most frequent values (count descending, then value)."""
    counts = df.where(F.col(col).isNotNull()).groupBy(*group, col).agg(F.count(F.lit(1)).alias("n"))
    if not group:
        return counts.orderBy(F.col("n").desc(), col).limit(k)
    w = Window.partitionBy(*group).orderBy(F.col("n").desc(), col)
    return counts.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


# ------------------------------------------------------------------ recordings and channels
def montage_signatures(channels: DataFrame, keys: Sequence[str], channel: str = "channel") -> DataFrame:
    """Order-independent channel-set signatures and how many recordings share them."""
    per = channels.groupBy(*keys).agg(F.array_sort(F.collect_set(channel)).alias("_s"))  # one montage
    return per.groupBy(F.array_join("_s", "|").alias("signature"), F.size("_s").alias("n_channels")).agg(F.count(F.lit(1)).alias("n_recordings"))


def channel_inventory(channels: DataFrame, keys: Sequence[str], channel: str = "channel", fs: str = "fs") -> DataFrame:
    """Per channel: recordings, presence %, distinct rates and the commonest rate (lowest on ties)."""
    per_fs = channels.groupBy(channel, fs).agg(F.count(F.lit(1)).alias("_c"))
    rates = per_fs.groupBy(channel).agg(
        F.count(fs).alias("n_fs"), F.max_by(fs, F.struct(F.col("_c"), (-F.col(fs)).alias("_neg"))).alias("fs_mode")
    )
    present = channels.select(channel, *keys).distinct().groupBy(channel).agg(F.count(F.lit(1)).alias("n_recordings"))
    total = channels.select(*keys).distinct().agg(F.count(F.lit(1)).alias("_n"))
    return present.join(rates, channel).join(F.broadcast(total)).select(  # one row
        channel, "n_recordings", (100.0 * F.col("n_recordings") / F.col("_n")).alias("presence_pct"), "n_fs", "fs_mode"
    )


# Fixed unit sets per channel role.
MICROVOLT = ("uv", "µv", "μv")
ROLE_UNITS = {"spo2": ("%",), "ecg": ("mv", *MICROVOLT), "eeg": MICROVOLT, "eog": MICROVOLT}


def unit_flags(headers: DataFrame, role: str = "role", unit: str = "unit") -> DataFrame:
    """Channels whose unit is not in the allowed set of their role."""
    u = F.lower(F.trim(unit))
    bad = None
    for r, allowed in ROLE_UNITS.items():
        cond = (F.col(role) == r) & ~u.isin(*allowed)
        bad = cond if bad is None else bad | cond
    return headers.where(bad).groupBy(role, u.alias(unit)).agg(F.count(F.lit(1)).alias("n"))


def short_recordings(recordings: DataFrame, site: str, hours: str) -> DataFrame:
    """Recordings under one hour and between one and four hours, per site."""
    h = F.col(hours)
    return recordings.groupBy(site).agg(
        F.count(F.lit(1)).alias("n"), F.sum((h < 1).cast("long")).alias("under_1h"), F.sum(((h >= 1) & (h < 4)).cast("long")).alias("from_1h_to_4h")
    )


def missing_feature_causes(features: DataFrame, files: DataFrame, stages: DataFrame, key: str, value: str) -> DataFrame:
    """Why a feature is missing: no file, load error, empty stream, all unscored, or stale.

    ``files`` holds (key, error) rows; ``stages`` holds (key, stage) epochs and is reduced to counts first.
    """
    st = stages.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"), F.sum((F.col("stage") < 9).cast("long")).alias("_scored")
    )
    fl = files.groupBy(key).agg(F.max("error").alias("_error"), F.lit(1).alias("_file")) if "error" in files.columns else None
    j = features.where(F.col(value).isNull()).select(key).join(fl, key, "left").join(st, key, "left")
    cause = (
        F.when(F.col("_file").isNull(), "no_file")
        .when(F.col("_error").isNotNull(), "load_error")
        .when(F.coalesce("_n", F.lit(0)) == 0, "empty_stage")
        .when(F.col("_scored") == 0, "all_unscored")
        .otherwise("stale")
    )
    return j.groupBy(cause.alias("cause")).agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ survival tables
def describe_by(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """count, mean, SD (ddof 1), min, quartiles, max."""
    d = describe(df, group, value, {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return d.select(*group, "n", "mean", sd_samp().alias("sd"), "min", "p25", "p50", "p75", "max")


def tertile_means(df: DataFrame, by: str, value: str) -> DataFrame:
    """Mean of ``value`` in the thirds of ``by`` (right-closed quantile bins)."""
    cuts = describe(df, [], by, {"_q1": 1 / 3, "_q2": 2 / 3}).select("_q1", "_q2")
    t = F.when(F.col(by) <= F.col("_q1"), 1).when(F.col(by) <= F.col("_q2"), 2).otherwise(3)
    return df.where(F.col(by).isNotNull()).join(F.broadcast(cuts)).groupBy(t.alias("tertile")).agg(  # one row
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_value")
    )


def event_time_by_quadrant(df: DataFrame, quadrant: Column, days: str) -> DataFrame:
    rows = df.withColumn("quadrant", quadrant).where("quadrant IS NOT NULL")
    return describe_by(rows, ["quadrant"], days)


def recall_by_time(df: DataFrame, days: str, edges_years: Sequence[float], label: str = "label", pred: str = "pred") -> DataFrame:
    """Recall of positives by event-time bin; values outside the edges go to the first or last bin."""
    years = F.col(days) / 365.25
    inner = list(edges_years)[1:-1]
    b = sum((years >= e).cast("int") for e in inner)
    return df.where((F.col(label) == 1) & F.col(days).isNotNull()).groupBy(b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n_pos"), F.sum((F.col(pred) == 1).cast("long")).alias("tp"),
        F.avg((F.col(pred) == 1).cast("double")).alias("recall"),
    )
