"""Event operators on coded streams: intervals, indices, recovery, clustering, periodicity."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..vocab import AHI_CODES, EPOCH_S, RDI_CODES, RESP, STAGES
from .describe import cv_pop, describe, fano, kurtosis, sd_pop, skewness
from .joins import containment_join, interval_join
from .ordered import Axis, calm, runs, shift, with_axis


def intervals(df: DataFrame, ax: Axis, code: str = "code", codes: Sequence[int] | None = None, fs: float = 1.0, **kw) -> DataFrame:
    """Code runs as half-open second intervals: keys, code, start_s, end_s, dur_s."""
    out = runs(df, ax, code, **kw)
    if codes is not None:
        out = out.where(F.col(code).isin(*codes))
    idx = ax.order[0]
    start, end = F.col(f"first_{idx}") / fs, (F.col(f"last_{idx}") + 1) / fs
    return out.select(*ax.keys, code, start.alias("start_s"), end.alias("end_s"), (end - start).alias("dur_s"))


def gaps_between(events: DataFrame, keys: Sequence[str], onset: str = "start_s", within: Axis | None = None) -> DataFrame:
    """Inter-event interval before each event but the first."""
    ev, ax = with_axis(events.select(*keys, onset), keys, (onset,), within=within)
    return shift(ev, ax, [onset], "_p_").withColumn("gap_s", F.col(onset) - F.col(f"_p_{onset}")).where("gap_s > 0")


def event_index(events: DataFrame, hours: DataFrame, keys: Sequence[str], code_sets: dict[str, Sequence[int]], code: str = "code", per: str = "hours") -> DataFrame:
    """Events per hour for several code sets at once; zero where a recording has none."""
    n = events.groupBy(*keys).agg(
        *[F.sum(F.col(code).isin(*codes).cast("long")).alias(f"_n_{name}") for name, codes in code_sets.items()]
    )
    return hours.join(n, list(keys), "left").select(
        *keys, *[F.when(F.col(per) > 0, F.coalesce(f"_n_{c}", F.lit(0)) / F.col(per)).alias(c) for c in code_sets]
    )


def arousal_distribution(events: DataFrame, stages: DataFrame, keys: Sequence[str], within: Axis | None = None) -> DataFrame:
    """Count, duration and inter-onset statistics (intervals need 3 events), index per stage hour."""
    keys = list(keys)
    dur = describe(events, keys, "dur_s", bounded=calm(within)).select(
        *keys,
        F.col("n").alias("n_arousals"),
        F.col("mean").alias("arousal_dur_mean_s"),
        F.col("median").alias("arousal_dur_median_s"),
        F.when(F.col("n") > 1, sd_pop()).alias("arousal_dur_sd_s"),
        F.col("max").alias("arousal_dur_max_s"),
    )
    iai = describe(gaps_between(events, keys, within=within), keys, "gap_s", bounded=calm(within)).where("n >= 2").select(
        *keys,
        F.col("mean").alias("arousal_iai_mean_s"),
        F.col("median").alias("arousal_iai_median_s"),
        cv_pop().alias("arousal_iai_cv"),
    )
    at = containment_join(events, stages, keys, "start_s").groupBy(*keys).agg(
        *[F.sum((F.col("stage") == c).cast("long")).alias(f"_n_{t}") for c, t in STAGES.items()]
    )
    hours = stages.groupBy(*keys).agg(
        *[F.sum((F.col("stage") == c).cast("long") * (EPOCH_S / 3600)).alias(f"_h_{t}") for c, t in STAGES.items()]
    )
    out = dur.join(iai, keys, "left").join(at, keys, "left").join(hours, keys, "left")
    idx = [
        F.when(F.col(f"_h_{t}") > 0, F.coalesce(f"_n_{t}", F.lit(0)) / F.col(f"_h_{t}")).alias(f"arousal_idx_{t}")
        for t in STAGES.values()
    ]
    return out.select(*dur.columns, *iai.columns[len(keys):], *idx)


def respiratory_summary(events: DataFrame, hours: DataFrame, keys: Sequence[str], code: str = "code", within: Axis | None = None) -> DataFrame:
    """Per-type counts and durations, pooled apnea+hypopnea durations, AHI and RDI."""
    keys = list(keys)
    per_type = []
    for c, name in RESP.items():
        d = F.when(F.col(code) == c, F.col("dur_s"))
        per_type += [F.count(d).alias(f"n_{name}"), F.avg(d).alias(f"{name}_dur_mean_s"), F.max(d).alias(f"{name}_dur_max_s")]
    is_ah, is_rdi = F.col(code).isin(*AHI_CODES), F.col(code).isin(*RDI_CODES)
    ah = F.when(is_ah, F.col("dur_s"))
    agg = events.groupBy(*keys).agg(
        *per_type,
        F.count(ah).alias("n_apnea_hypopnea"),
        F.sum(is_rdi.cast("long")).alias("_rdi"),
        F.avg(ah).alias("event_dur_mean_s"),
        F.max(ah).alias("event_dur_max_s"),
    )
    med = describe(events.where(is_ah), keys, "dur_s", bounded=calm(within)).select(*keys, F.col("median").alias("event_dur_median_s"))
    out = hours.join(agg, keys, "left").join(med, keys, "left")
    counts = [f"n_{n}" for n in RESP.values()] + ["n_apnea_hypopnea", "_rdi"]
    out = out.fillna(0, subset=counts)
    rate = lambda c: F.when(F.col("hours") > 0, F.col(c) / F.col("hours"))
    return out.withColumn("ahi", rate("n_apnea_hypopnea")).withColumn("rdi", rate("_rdi")).drop("_rdi", "hours")


def post_event_recovery(
    events: DataFrame, spo2: DataFrame, keys: Sequence[str], baseline_s: int = 30, recovery_s: int = 45, tol: float = 1.0
) -> DataFrame:
    """Per event: pre-event median, overshoot above it, seconds from nadir to baseline - tol.

    ``spo2`` is 1 Hz (keys, sec, value). Samples meet in arrays by spans of ``2 * width`` seconds that overlap by half, so an event whose window is no longer
    than ``width`` finds it in one span and its samples are never shuffled again. Longer events are joined sample by sample.
    """
    keys, width = list(keys), 2 * (baseline_s + recovery_s)
    one = [*keys, "start_s"]
    known = spo2.where(F.col("value").isNotNull())
    ev = events.groupBy(*one).agg(F.collect_list(F.col("end_s") + recovery_s).alias("_tos")).withColumn("_from", F.col("start_s") - baseline_s)
    ev = cut_lineage(ev.withColumn("_long", F.array_max("_tos") - F.col("_from") > width))
    spans = F.explode(F.array(*[F.floor(F.col("sec") / width) + d for d in (-1, 0)]))
    cell = F.struct(F.col("value").alias("v"), F.col("sec").alias("s"))
    samples = known.withColumn("_b", spans).groupBy(*keys, "_b").agg(F.collect_list(cell).alias("_w"))  # two widths of samples
    near = ev.where("NOT _long").withColumn("_b", F.floor(F.col("_from") / width)).join(samples, [*keys, "_b"])
    inside = F.flatten(F.transform("_tos", lambda t: F.filter("_w", lambda x: (x.s >= F.col("_from")) & (x.s < t))))
    near = near.select(*one, inside.alias("_in")).select(
        *one, F.filter("_in", lambda x: x.s >= F.col("start_s")).alias("_post"),
        F.array_sort(F.transform(F.filter("_in", lambda x: x.s < F.col("start_s")), lambda x: x.v.cast("double"))).alias("_pre"),
    )
    n = F.size("_pre")
    low, high = F.get("_pre", F.floor((n - 1) / 2).cast("int")), F.get("_pre", F.floor(n / 2).cast("int"))
    stats = near.select(*one, F.when(low == high, low).otherwise(0.5 * low + 0.5 * high).alias("baseline"), "_post")
    far = ev.where("_long")
    if not far.isEmpty():
        rows = interval_join(known, far.select(*one, "_from", F.explode("_tos").alias("_to")), keys, "sec", "_from", "_to", 60.0)
        pre, post = F.col("sec") < F.col("start_s"), F.col("sec") >= F.col("start_s")
        after = F.collect_list(F.when(post, cell))  # one event's window
        stats = stats.unionByName(rows.groupBy(*one).agg(F.median(F.when(pre, F.col("value"))).alias("baseline"), after.alias("_post")))
    stats = stats.where(F.col("baseline").isNotNull() & (F.size("_post") > 0)).withColumn("_nadir", F.array_min("_post").getField("s"))
    back = F.filter("_post", lambda x: (x.s >= F.col("_nadir")) & (x.v >= F.col("baseline") - tol))
    return stats.select(
        *one,
        "baseline",
        (F.array_max("_post").getField("v") - F.col("baseline")).alias("overshoot"),
        (F.array_min(F.transform(back, lambda x: x.s)) - F.col("_nadir")).cast("double").alias("recovery_s"),
    )


def clustering(events: DataFrame, hours: DataFrame, keys: Sequence[str], gap_s: float = 40.0, within: Axis | None = None) -> DataFrame:
    """Inter-event spread, chains of events at most ``gap_s`` apart, burstiness (needs 3 events)."""
    keys = list(keys)
    gaps = gaps_between(events, keys, within=within).withColumn("_near", (F.col("gap_s") <= gap_s).cast("int"))
    shape = describe(gaps, keys, "gap_s", bounded=calm(within)).where("n >= 2").select(
        *keys, F.col("n").alias("_n_gaps"), F.col("median").alias("idi_median_s"), cv_pop().alias("idi_cv"), fano().alias("fano")
    )
    seq, ax = with_axis(gaps.select(*keys, "start_s", "_near"), keys, ("start_s",), within=within)
    chained = shift(seq, ax, ["_near"], "_p").groupBy(*keys).agg(
        F.sum("_near").alias("_near_gaps"),
        F.sum(F.when((F.col("_near") == 1) & (F.coalesce("_p_near", F.lit(0)) == 0), 1).otherwise(0)).alias("n_clusters"),
    )
    n = F.col("_n_gaps") + 1
    linked = F.least(F.col("_near_gaps") + F.col("n_clusters"), n)
    return (
        shape.join(chained, keys)
        .join(hours, keys)
        .select(
            *keys,
            "idi_median_s",
            "idi_cv",
            "fano",
            (linked / n).alias("cluster_frac"),
            "n_clusters",
            (1.0 - linked / n).alias("isolated_frac"),
            F.when(F.col("hours") > 0, n / F.col("hours")).alias("rate_per_h"),
            ((F.col("idi_cv") - 1) / (F.col("idi_cv") + 1)).alias("burstiness"),
        )
    )


def interval_shape(gaps: DataFrame, keys: Sequence[str], gap: str = "gap_s", lo: float = 1.0, hi: float = 15.0, min_n: int = 29, within: Axis | None = None) -> DataFrame:
    """Median, CV, bias-corrected skewness and kurtosis, mean rate of physiologic intervals."""
    kept = gaps.where((F.col(gap) > lo) & (F.col(gap) < hi))
    return describe(kept, keys, gap, bounded=calm(within)).where(F.col("n") >= min_n).select(
        *keys,
        (F.col("n") + 1).alias("n_events"),
        F.col("median").alias("median_s"),
        cv_pop().alias("cv"),
        skewness().alias("skew"),
        kurtosis().alias("kurtosis"),
        (60.0 / F.col("mean")).alias("rate_per_min"),
    )


def periodicity(events: DataFrame, duration: DataFrame, keys: Sequence[str], lo: float = 5.0, hi: float = 90.0, within: Axis | None = None) -> DataFrame:
    """Inter-movement intervals, share in the periodic band, movement rate (needs 4 events)."""
    keys = list(keys)
    gaps = gaps_between(events, keys, within=within)
    shape = describe(gaps, keys, "gap_s", bounded=calm(within)).where("n >= 3").select(
        *keys,
        (F.col("n") + 1).alias("n_movements"),
        F.col("median").alias("imi_median_s"),
        cv_pop().alias("imi_cv"),
        fano().alias("fano"),
    )
    share = gaps.groupBy(*keys).agg(F.avg(F.col("gap_s").between(lo, hi).cast("double")).alias("periodic_frac"))
    out = shape.join(share, keys).join(duration, keys)
    return out.withColumn(
        "movements_per_h", F.when(F.col("duration_s") > 0, F.col("n_movements") * 3600.0 / F.col("duration_s"))
    ).drop("duration_s")


def onset_spectrum(events: DataFrame, duration: DataFrame, keys: Sequence[str], lo: float = 5.0, hi: float = 90.0) -> DataFrame:
    """Peak of the 1 Hz onset-train spectrum between 1/hi and 1/lo Hz and its share of total power.

    Groups hold event onsets of one recording, never samples.
    """
    keys = list(keys)
    joined = events.select(*keys, "start_s").join(duration, keys)

    def peak(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(np.ceil(pdf["duration_s"].iloc[0]))
        row = pdf[keys].head(1).assign(spec_peak_hz=np.nan, spec_peak_frac=np.nan)
        if n < 32 or len(pdf) < 4:
            return row
        train = np.zeros(n)
        train[np.clip(pdf["start_s"].to_numpy().astype(int), 0, n - 1)] = 1.0
        power = np.abs(np.fft.rfft(train - train.mean())) ** 2
        freq = np.fft.rfftfreq(n, 1.0)
        band = (freq >= 1 / hi) & (freq <= 1 / lo)
        total = power[1:].sum()
        if band.any() and total > 0:
            k = np.argmax(np.where(band, power, -1))
            row["spec_peak_hz"], row["spec_peak_frac"] = freq[k], power[k] / total
        return row

    schema = joined.select(*keys).schema.add("spec_peak_hz", "double").add("spec_peak_frac", "double")
    out = joined.groupBy(*keys).applyInPandas(peak, schema)
    return out.replace(float("nan"), None)


def probability_mean(df: DataFrame, keys: Sequence[str], value: Column, name: str = "prob_mean") -> DataFrame:
    """Mean of stream values that are valid probabilities."""
    return df.groupBy(*keys).agg(F.avg(F.when((value >= 0) & (value <= 1), value)).alias(name))


def longest_bout(bouts: DataFrame, keys: Sequence[str], state: str, first: str) -> DataFrame:
    """Longest run per recording and state; the earliest wins a tie."""
    best = F.max_by(F.struct(first, "n"), F.struct(F.col("n"), (-F.col(first)).alias("_neg")))
    return bouts.groupBy(*keys, state).agg(best.alias("_b")).select(*keys, state, f"_b.{first}", "_b.n")


def even_windows(spans: DataFrame, n_windows: int, width: int, start: str = "first_epoch", n: str = "n") -> DataFrame:
    """Evenly spaced windows of ``width`` inside each span (one centred window when it is short)."""
    room = F.greatest(F.col(n) - width, F.lit(0))
    step = F.transform(
        F.sequence(F.lit(0), F.lit(n_windows - 1)),
        lambda j: (F.col(start) + F.floor(j * room / max(n_windows - 1, 1))).cast("long"),
    )
    return spans.withColumn("window_start", F.explode(F.array_distinct(step)))
