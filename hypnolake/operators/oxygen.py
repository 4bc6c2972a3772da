"""Oxygen saturation: scale detection, summary, moving baseline, desaturation events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .describe import describe
from .ordered import Axis, calm, forward_fill, shared, shift
from .ranks import quantiles


def normalise(df: DataFrame, keys: Sequence[str], value: str = "value", out: str = "spo2", within: Axis | None = None) -> DataFrame:
    """Percent scale (a median in (0, 1.5] marks a 0-1 stream); values outside (40, 100] become NULL."""
    med = quantiles(df.where(F.col(value) > 0), keys, value, {"_med": 0.5}, bounded=calm(within))
    pct = F.when(F.col("_med") <= 1.5, F.col(value) * 100.0).otherwise(F.col(value).cast("double"))
    joined = df.join(med, list(keys), "left").withColumn("_pct", pct)
    return joined.withColumn(out, F.when((F.col("_pct") > 40) & (F.col("_pct") <= 100), F.col("_pct"))).drop("_med", "_pct")


def summary(df: DataFrame, keys: Sequence[str], value: str = "spo2", fs: float = 1.0, within: Axis | None = None) -> DataFrame:
    """Mean, minimum, 1st percentile, share and minutes under 90 %, duration in hours."""
    keys = list(keys)
    stats = describe(df, keys, value, {"spo2_p1": 0.01}, bounded=calm(within)).select(
        *keys, F.col("mean").alias("spo2_mean"), F.col("min").alias("spo2_min"), "spo2_p1"
    )
    below = F.when(F.col(value) < 90, 1.0).when(F.col(value).isNotNull(), 0.0)
    t90 = df.groupBy(*keys).agg(
        (100.0 * F.avg(below)).alias("t90_pct"),
        (F.sum(below) / fs / 60.0).alias("t90_min"),
        (F.count(F.lit(1)) / fs / 3600.0).alias("duration_hours"),
    )
    return t90.join(stats, keys, "left")


def block_baseline(df: DataFrame, ax: Axis, idx: str, value: str, out: str, window: int) -> DataFrame:
    """Medians of equal blocks of about ``window`` samples, linear between block centres."""
    keys = list(ax.keys)
    df = shared(df, ax)
    size = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_nb", F.greatest(F.floor(F.col("_n") / window), F.lit(1)).cast("long")
    )
    rows = df.join(size, keys).withColumn("_blk", F.floor(((F.col(idx) + 1) * F.col("_nb") - 1) / F.col("_n")))
    edge = lambda k: F.floor(k * F.col("_n") / F.col("_nb"))
    blocks = rows.groupBy(*keys, "_blk", "_n", "_nb").agg(F.median(value).alias("_m"))  # at most 2*window samples
    blocks = blocks.withColumn("_c", (edge(F.col("_blk")) + edge(F.col("_blk") + 1)) / 2.0)
    w = Window.partitionBy(*keys).orderBy("_blk")
    blocks = blocks.select(
        *keys, "_blk", "_m", "_c",
        *[f(c).over(w).alias(f"{p}{c}") for f, p in ((F.lag, "_p"), (F.lead, "_q")) for c in ("_m", "_c")],
    )
    x = F.col(idx)

    def line(c0, m0, c1, m1):
        return F.col(m0) + (F.col(m1) - F.col(m0)) * (x - F.col(c0)) / (F.col(c1) - F.col(c0))

    base = F.when(
        x < F.col("_c"), F.coalesce(line("_p_c", "_p_m", "_c", "_m"), F.col("_m"))
    ).otherwise(F.coalesce(line("_c", "_m", "_q_c", "_q_m"), F.col("_m")))
    joined = rows.join(blocks, [*keys, "_blk"])
    return joined.withColumn(out, base).select(*df.columns, out)


def desaturations(
    df: DataFrame, ax: Axis, idx: str = "idx", value: str = "spo2", fs: float = 1.0,
    baseline_s: float = 120.0, drop: float = 3.0, min_s: float = 5.0, max_s: float = 120.0,
) -> DataFrame:
    """One row per desaturation: start_s, dur_s, depth, burden (percent-minutes, first ``max_s`` only)."""
    keys = list(ax.keys)
    filled = forward_fill(df, ax, value, "_fill").where(F.col("_fill").isNotNull())
    based = block_baseline(filled, ax, idx, "_fill", "_base", max(1, int(baseline_s * fs)))
    d = based.withColumn("_drop", F.col("_base") - F.col("_fill")).withColumn(
        "_in", (F.col(value).isNotNull() & (F.col("_base") - F.col("_fill") >= drop)).cast("int")
    )
    d = shift(d.select(*ax.part, idx, "_drop", "_in"), ax, ["_in"], "_p")
    opened = F.col("_p_in").isNull() | (F.col("_p_in") != F.col("_in"))
    d = forward_fill(d.withColumn("_open", F.when(opened, F.col(idx))), ax, "_open", "_start").where("_in = 1")
    at = F.col(idx) - F.col("_start")
    head = at < int(max_s * fs)
    curve = F.when(head, F.col("_drop"))
    ends = (F.max_by(curve, F.when(head, at)) + F.min_by(curve, F.when(head, at))) / 2
    return (
        d.groupBy(*keys, "_start")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.max(curve).alias("depth"),
            ((F.sum(curve) - ends) / fs / 60.0).alias("burden_pctmin"),
        )
        .where(F.col("_n") >= int(min_s * fs))
        .select(*keys, (F.col("_start") / fs).alias("start_s"), (F.col("_n") / fs).alias("dur_s"), "depth", "burden_pctmin")
    )


def oxygenation(df: DataFrame, desats: DataFrame, keys: Sequence[str], value: str = "spo2", fs: float = 1.0, within: Axis | None = None) -> DataFrame:
    """Summary with ODI, depth and hypoxic burden per hour."""
    keys = list(keys)
    ev = desats.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_desat"),
        F.avg("depth").alias("desat_depth_mean"),
        F.max("depth").alias("desat_depth_max"),
        F.sum("burden_pctmin").alias("hb_pctmin_total"),
    )
    out = summary(df, keys, value, fs, within).join(ev, keys, "left").fillna(0, subset=["n_desat", "hb_pctmin_total"])
    return out.withColumn("odi", F.col("n_desat") / F.col("duration_hours")).withColumn(
        "hypoxic_burden", F.col("hb_pctmin_total") / F.col("duration_hours")
    )


def simple_desaturation_index(df: DataFrame, ax: Axis, value: str = "spo2", fs: float = 1.0) -> DataFrame:
    """Submission variant: drops invalid samples first, counts falls below 90 % per valid hour."""
    valid = df.where(F.col(value).isNotNull()).withColumn("_lt", (F.col(value) < 90).cast("int"))
    s = shift(valid, ax, ["_lt"], "_p")
    onset = (F.col("_lt") == 1) & (F.coalesce("_p_lt", F.lit(0)) == 0)
    return s.groupBy(*ax.keys).agg(
        F.avg(value).alias("spo2_mean"),
        F.stddev_pop(value).alias("spo2_std"),
        F.avg(F.col("_lt").cast("double")).alias("spo2_frac_lt90"),
        (F.sum(onset.cast("long")) * 3600.0 * fs / F.count(F.lit(1))).alias("spo2_desat_idx"),
    )
