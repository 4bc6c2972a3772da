"""Exact ranks, cumulative counts and quantiles without a single-task sort.

Rows collapse to one row per distinct (group, value) first. These are dealt by one range exchange on (group, value), so a large group
lies in several ranges and small ones share one; each range is cumulated as it is sorted, and shifted by the totals of the group's ranges below it.
The ranges only decide parallelism; results are exact.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage


def histogram(df: DataFrame, group: Sequence[str], value: str, counts: dict[str, Column] | None = None) -> DataFrame:
    """Distinct (group, value) with additive counts; NULL and NaN values are left out."""
    counts = counts or {"n": F.lit(1)}
    known = F.col(value).isNotNull()
    if df.schema[value].dataType.typeName() in ("double", "float"):
        known &= ~F.isnan(value)
    return (
        df.where(known)
        .groupBy(*group, value)
        .agg(*[F.sum(e).cast("long").alias(n) for n, e in counts.items()])
    )


def _running(counts: Sequence[str]):
    """Adds the running sums of ``counts`` to sorted batches; they start anew where ``_g`` changes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, carry = None, [0] * len(counts)
        for b in batches:
            if not b.num_rows:
                continue
            g = b.column("_g").to_numpy()
            start = np.flatnonzero(np.r_[group is None or g[0] != group, g[1:] != g[:-1]])
            last = np.searchsorted(start, np.arange(len(g)), "right") - 1  # the start a row belongs to; -1: before this batch
            added = []
            for i, c in enumerate(counts):
                v = b.column(c).fill_null(0).to_numpy(zero_copy_only=False)
                v = v.astype("i8" if v.dtype.kind in "iu" else "f8")
                up = np.cumsum(v)
                out = up + carry[i] if not len(start) else np.where(last >= 0, up - (up - v)[start[np.maximum(last, 0)]], up + carry[i])
                carry[i] = out[-1]
                added.append(pa.array(out))
            group = g[-1]
            names = [n for n in b.schema.names if n != "_g"]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], *added], names=[*names, *[f"_w_{c}" for c in counts]])

    return run


def cumulate(hist: DataFrame, group: Sequence[str], value: str, counts: Sequence[str] = ("n",), bounded: bool = False) -> DataFrame:
    """Add ``cum_<c>`` (inclusive, ascending value) and ``tot_<c>`` per group.

    ``bounded=True`` is for groups whose distinct values are few by construction (ages, grids).
    """
    counts = list(counts)
    keys = list(group)
    if bounded:
        run = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
        whole = Window.partitionBy(*keys)
        return hist.select(
            "*",
            *[F.sum(c).over(run).alias(f"cum_{c}") for c in counts],
            *[F.sum(c).over(whole).alias(f"tot_{c}") for c in counts],
        )
    order = [*keys, value]
    dealt = hist.withColumn("_g", F.xxhash64(*keys) if keys else F.lit(0).cast("long")).repartitionByRange(*order).sortWithinPartitions(*order)
    kinds = {f.name: f for f in hist.schema}
    whole_number = lambda c: isinstance(kinds[c].dataType, T.IntegralType)
    schema = T.StructType([*hist.schema, *[T.StructField(f"_w_{c}", T.LongType() if whole_number(c) else T.DoubleType()) for c in counts]])
    inner = cut_lineage(dealt.mapInArrow(_running(counts), schema).withColumn("_part", F.spark_partition_id()))
    sums = inner.groupBy(*keys, "_part").agg(*[F.sum(c).alias(f"_o_{c}") for c in counts])
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut_lineage(sums.select(  # one row per group and range
        *keys, "_part",
        *[F.coalesce(F.sum(f"_o_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in counts],
        *[F.sum(f"_o_{c}").over(whole).alias(f"tot_{c}") for c in counts],
    ))
    out = inner.join(offsets, [*keys, "_part"])
    return out.select(
        *hist.columns,
        *[(F.col(f"_w_{c}") + F.col(f"_o_{c}")).alias(f"cum_{c}") for c in counts],
        *[f"tot_{c}" for c in counts],
    )


def average_ranks(df: DataFrame, group: Sequence[str], value: str, **kw) -> DataFrame:
    """One row per distinct value: n ties, average rank (1-based), group size."""
    cum = cumulate(histogram(df, group, value), group, value, **kw)
    return cum.select(
        *group,
        value,
        "n",
        (F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2).alias("rank"),
        F.col("tot_n").alias("n_group"),
    )


def quantiles(
    df: DataFrame, group: Sequence[str], value: str, probs: dict[str, float], weight: Column | None = None, **kw
) -> DataFrame:
    """Exact linearly interpolated quantiles, one row per group: ``{output name: probability}``."""
    cum = cumulate(histogram(df, group, value, {"n": weight if weight is not None else F.lit(1)}), group, value, **kw)
    return pick_quantiles(cum, group, value, probs)


def pick_quantiles(cum: DataFrame, group: Sequence[str], value: str, probs: dict[str, float], extra=()) -> DataFrame:
    """Read quantiles (and any ``extra`` aggregates) off a cumulated histogram."""
    picks = []
    for name, p in probs.items():
        pos = (F.col("tot_n") - 1) * F.lit(float(p))
        for side, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            hit = (F.col("cum_n") > at) & (F.col("cum_n") - F.col("n") <= at)
            picks.append(F.max(F.when(hit, F.col(value).cast("double"))).alias(f"_{side}_{name}"))
    agg = cum.groupBy(*group).agg(F.max("tot_n").alias("_tot"), *picks, *extra)
    final = []
    for name, p in probs.items():
        pos = (F.col("_tot") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        final.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    kept = [c for c in agg.columns if not c.startswith(("_lo_", "_hi_", "_tot"))]
    return agg.select(*kept, *final)


def auroc(df: DataFrame, group: Sequence[str], score: str, label: str, **kw) -> DataFrame:
    """Tie-aware AUROC per group from cumulative class counts; NULL when a class is missing."""
    hist = histogram(df, group, score, {"pos": (F.col(label) == 1).cast("int"), "neg": (F.col(label) == 0).cast("int")})
    cum = cumulate(hist, group, score, ("pos", "neg"), **kw)
    wins = F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2))
    out = cum.groupBy(*group).agg(
        F.max("tot_pos").alias("n_pos"), F.max("tot_neg").alias("n_neg"), wins.alias("_wins")
    )
    pairs = F.col("n_pos") * F.col("n_neg")
    return out.withColumn("auroc", F.when(pairs > 0, F.col("_wins") / pairs)).drop("_wins")
