"""Group summaries: exact quantiles and central moments from one cumulated histogram."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import cumulate, histogram, pick_quantiles


def describe(df: DataFrame, group: Sequence[str], value: str, probs: dict[str, float] | None = None, **kw) -> DataFrame:
    """n, mean, min, max, total, central sums m2/m3/m4 and quantiles per group (NULL/NaN left out)."""
    probs = {"median": 0.5} if probs is None else probs
    v = F.col(value).cast("double")
    hist = histogram(df, group, value).withColumn("s", F.col("n") * v)
    cum = cumulate(hist, group, value, ("n", "s"), **kw)
    dev = v - F.col("tot_s") / F.col("tot_n")
    extra = [
        F.max("tot_n").alias("n"),
        F.max("tot_s").alias("total"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        *[F.sum(F.col("n") * F.pow(dev, k)).alias(f"m{k}") for k in (2, 3, 4)],
    ]
    out = pick_quantiles(cum, group, value, probs, extra)
    return out.withColumn("mean", F.col("total") / F.col("n"))


def sd_pop() -> Column:
    return F.sqrt(F.col("m2") / F.col("n"))


def sd_samp() -> Column:
    return F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1)))


def cv_pop() -> Column:
    return F.when(F.col("mean") > 0, sd_pop() / F.col("mean"))


def fano() -> Column:
    return F.when((F.col("n") >= 3) & (F.col("mean") > 0), F.col("m2") / F.col("n") / F.col("mean"))


def skewness() -> Column:
    """Bias-corrected sample skewness (3 points at least)."""
    n, m2 = F.col("n"), F.col("m2") / F.col("n")
    g1 = (F.col("m3") / n) / F.pow(m2, 1.5)
    return F.when((n >= 3) & (F.col("m2") > 0), F.sqrt(n * (n - 1)) / (n - 2) * g1)


def kurtosis() -> Column:
    """Bias-corrected excess kurtosis (4 points at least)."""
    n, m2 = F.col("n"), F.col("m2") / F.col("n")
    g2 = (F.col("m4") / n) / (m2 * m2) - 3
    return F.when((n >= 4) & (F.col("m2") > 0), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))
