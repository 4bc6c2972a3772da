"""Cohort construction: outcome labels, weights, seeded samples and splits, matched controls."""

from __future__ import annotations

import bisect
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.clock import days_between
from ..functions.hashing import hash_key
from ..session import cut_lineage
from .ordered import Axis, ordinal, with_axis
from .ranks import cumulate

YEAR_D = 365.25


def incident_labels(recordings: DataFrame, codes: DataFrame, keys: Sequence[str], created: str, code_date: str, lo: float = 1, hi: float = 6, min_days: float = 7) -> DataFrame:
    """Label 1 when first and last code are 7 days apart and the first falls 1-6 years after the recording.

    Codes shrink to one row per patient (map-side combine) before they meet the recordings.
    """
    agg = codes.groupBy(*keys).agg(
        F.min(code_date).alias("first_code"), F.max(code_date).alias("last_code"), F.count(code_date).alias("n_codes")
    )
    j = recordings.join(agg, list(keys), "left")
    wait = days_between("first_code", created)
    hit = (days_between("last_code", "first_code") >= min_days) & wait.between(YEAR_D * lo, YEAR_D * hi)
    return j.select(
        *recordings.columns, "n_codes",
        F.coalesce(hit.cast("int"), F.lit(0)).alias("label"),
        F.floor(wait).cast("double").alias("time_to_event"),
    )


def survival_time(label: Column, event: Column, last_visit: Column) -> Column:
    return F.when(label == 1, event).when(label == 0, last_visit)


def extreme_cohort(df: DataFrame, label: str = "label", surv: str = "surv", fast: float = 2 * YEAR_D, long: float = 7 * YEAR_D) -> DataFrame:
    y, s = F.col(label), F.col(surv)
    return df.where(((y == 1) & (s <= fast)) | ((y == 0) & (s > long)))


def confidence_weight(label: Column, surv: Column, floor: float, fast: float = 2 * YEAR_D, long: float = 7 * YEAR_D) -> Column:
    """1 in the clear zone, linear to ``floor`` across the ambiguous years; unknown survival keeps 1."""
    share = F.least(F.greatest(F.when(label == 1, (surv - fast) / (long - fast)).otherwise((long - surv) / (long - fast)), F.lit(0.0)), F.lit(1.0))
    return F.when(surv.isNull(), 1.0).otherwise(1.0 - (1.0 - floor) * share)


# ------------------------------------------------------------------ seeded samples and splits
def stratified_sample(df: DataFrame, strata: Sequence[str], key: str, k: int, seed: int) -> DataFrame:
    """First k of a seeded permutation per stratum (Spark limits each group before the shuffle)."""
    w = Window.partitionBy(*strata).orderBy("_h", key)
    return df.withColumn("_h", hash_key(seed, F.col(key))).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_h", "_rn")


def permuted(df: DataFrame, strata: Sequence[str], key: str, seed) -> DataFrame:
    """Position (1..n) of each row in its stratum's seeded permutation, with n; no single-task sort."""
    h = df.select(*strata, key).withColumn("_h", hash_key(seed, F.col(key))).withColumn("n", F.lit(1).cast("long"))
    cum = cumulate(h, strata, "_h")
    return cum.select(*strata, key, F.col("cum_n").alias("pos"), F.col("tot_n").alias("n_stratum"))


def _with_strata(df: DataFrame, site: str, label: str) -> DataFrame:
    """site_label strata, or label alone when any of them has fewer than two rows."""
    sizes = df.groupBy(site, label).agg(F.count(F.lit(1)).alias("_c")).agg(F.min("_c").alias("_min"))
    both = F.concat_ws("_", F.col(site), F.col(label).cast("string"))
    return df.join(F.broadcast(sizes)).withColumn(  # one row
        "stratum", F.when(F.col("_min") < 2, F.col(label).cast("string")).otherwise(both)
    ).drop("_min")


def split_train_val_test(df: DataFrame, key: str, site: str = "site", label: str = "label", test: float = 0.15, val: float = 0.15, seed=42) -> DataFrame:
    """Adds ``split``: exact shares inside each stratum of a seeded permutation."""
    st = _with_strata(df.select(key, site, label), site, label)
    p = permuted(st, ["stratum"], key, seed)
    n_test = F.round(F.col("n_stratum") * test)
    n_val = F.round(F.col("n_stratum") * val)
    split = F.when(F.col("pos") <= n_test, "test").when(F.col("pos") <= n_test + n_val, "val").otherwise("train")
    return df.join(p.select(key, split.alias("split")), key)


def stratified_folds(df: DataFrame, key: str, strata: Sequence[str], k: int, repeats: int = 1, seed: int = 0) -> DataFrame:
    """Repeated stratified k-fold ids: (rows x repeats), fold = permutation position modulo k."""
    reps = df.select(key, *strata, F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat"))
    h = reps.withColumn("_h", hash_key(F.concat_ws(":", F.lit(str(seed)), F.col("repeat")), F.col(key))).withColumn("n", F.lit(1).cast("long"))
    cum = cumulate(h, [*strata, "repeat"], "_h")
    return cum.select(key, "repeat", ((F.col("cum_n") - 1) % k).cast("int").alias("fold"))


def loso_folds(df: DataFrame, site: str = "site", label: str = "label") -> DataFrame:
    """Leave-one-site-out folds with train counts; ``usable`` needs both classes in train."""
    per = df.groupBy(site).agg(F.count(F.lit(1)).alias("n_test"), F.sum(label).alias("pos_test"))
    tot = per.agg(F.sum("n_test").alias("_n"), F.sum("pos_test").alias("_p"))
    j = per.join(F.broadcast(tot))  # one row
    n_train, p_train = F.col("_n") - F.col("n_test"), F.col("_p") - F.col("pos_test")
    return j.select(
        F.col(site).alias("held_out"), "n_test", "pos_test", n_train.alias("n_train"), p_train.alias("pos_train"),
        ((p_train > 0) & (p_train < n_train)).alias("usable"),
    )


def subsample_positives(df: DataFrame, key: str, fraction: float, seed: int, label: str = "label") -> DataFrame:
    """All negatives and a seeded share of the positives (one at least)."""
    pos = permuted(df.where(F.col(label) == 1), [], key, seed)
    kept = pos.where(F.col("pos") <= F.greatest(F.round(F.col("n_stratum") * fraction), F.lit(1))).select(key)
    return df.where(F.col(label) == 0).unionByName(df.where(F.col(label) == 1).join(kept, key, "left_semi"))


def even_subsample(df: DataFrame, keys: Sequence[str], order: str, k: int, within: Axis | None = None) -> DataFrame:
    """Rows hit by k evenly spaced positions of each group (all rows when the group is smaller)."""
    rows, ax = with_axis(df, keys, (order,), within=within)
    pos = ordinal(rows, ax, "_i")
    size = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    j = pos.join(size, list(keys))
    i, n = F.col("_i"), F.col("_n")
    step = F.ceil(i * (k - 1) / F.greatest(n - 1, F.lit(1)))
    hit = (n <= k) | (F.floor(step * (n - 1) / max(k - 1, 1)) == i)
    return j.where(hit).select(*df.columns)


# ------------------------------------------------------------------ matched controls
def matched_controls(df: DataFrame, key: str, block: Sequence[str], age: str = "age", label: str = "label", k: int = 3, caliper: float = 5) -> DataFrame:
    """Greedy 1:k controls: exact block, nearest age within the caliper, each control used once.

    Controls of one (block, age) are interchangeable, so only their counts travel with the
    positives. Where two successive ages of a block lie further apart than the caliper, nothing below can meet
    anything above: each such slice is matched on its own. Positives stream through one sorted partition per slice (constant
    memory: free counts per age); concrete controls are then attached by position with an equi-join.
    """
    wanted = list(block)
    known = df.where(F.col(label).isin(0, 1) & F.col(age).isNotNull())
    ages = known.select(*wanted, age).distinct()  # one row per age of a block
    gap = F.col(age) - F.lag(age).over(Window.partitionBy(*wanted).orderBy(age)) > caliper
    ages = ages.withColumn("_gap", F.coalesce(gap.cast("int"), F.lit(0)))
    ages = ages.withColumn("_slice", F.sum("_gap").over(Window.partitionBy(*wanted).orderBy(age))).drop("_gap")
    df = cut_lineage(known.select(*wanted, age, key, label).join(ages, [*wanted, age]))
    block = [*wanted, "_slice"]
    controls = df.where(F.col(label) == 0).select(*block, age, key)
    free = controls.groupBy(*block, age).agg(F.count(F.lit(1)).alias("_c"))
    cases = df.where(F.col(label) == 1).select(*block, age, key)
    feed = cases.select(*block, F.lit(1).alias("_kind"), F.col(age).alias("_age"), key, F.lit(0).cast("long").alias("_c")).unionByName(
        free.select(*block, F.lit(0).alias("_kind"), F.col(age).alias("_age"), F.lit(None).cast(df.schema[key].dataType).alias(key), "_c")
    )
    sorted_feed = feed.repartition(*block).sortWithinPartitions(*block, "_kind", key, "_age")
    out_schema = T.StructType(
        [f for f in df.select(*block).schema]
        + [T.StructField("case", df.schema[key].dataType), T.StructField("_age", df.schema[age].dataType),
           T.StructField("_pos", T.LongType()), T.StructField("choice", T.IntegerType())]
    )

    def allocate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, ages, left, used = None, [], {}, {}
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                here = tuple(row[: len(block)])
                if here != current:
                    current, ages, left, used = here, [], {}, {}
                kind, a, case, c = row[len(block):]
                if kind == 0:
                    bisect.insort(ages, a)
                    left[a], used[a] = c, 0
                    continue
                lo, hi = bisect.bisect_left(ages, a - caliper), bisect.bisect_right(ages, a + caliper)
                want = k
                for near in sorted(ages[lo:hi], key=lambda x: (abs(x - a), x)):
                    take = min(want, left[near])
                    for _ in range(take):
                        out.append((*here, case, near, used[near], k - want))
                        used[near] += 1
                        left[near] -= 1
                        want -= 1
                    if not want:
                        break
            yield pd.DataFrame(out, columns=out_schema.names)

    chosen = sorted_feed.mapInPandas(allocate, out_schema)
    numbered, ax = with_axis(controls, [*block, age], (key,))
    numbered = ordinal(numbered, ax, "_pos").select(*block, F.col(age).alias("_age"), "_pos", F.col(key).alias("control"))
    return chosen.join(numbered, [*block, "_age", "_pos"]).select(*wanted, "case", "choice", "control", F.col("_age").alias("control_age"))
