"""Microstructure: cyclic alternating pattern, REM atonia, REM density, complexity, respiration."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..vocab import EPOCH_S
from .cohort import even_subsample
from .describe import cv_pop, describe, sd_pop
from .ordered import Axis, calm, running_sum, runs, shift, with_axis
from .ranks import quantiles
from .signals import BAND_NAMES, BANDS, TOTAL, amplitude_quantile, band_peaks, permutation_entropy, sample_entropy, stacks, thinned, with_context

NREM = (1, 2, 3)


# ------------------------------------------------------------------ CAP
def window_powers(epochs: DataFrame, keys: Sequence[str], win_s: float = 2.0, epoch_s: float = EPOCH_S) -> DataFrame:
    """Band sums of plain rFFT power per non-overlapping window: keys, stage, win, bands, total."""
    names = [*BAND_NAMES, "total"]
    row = "struct<" + ",".join(f"{n}:double" for n in names) + ">"

    @F.pandas_udf(f"array<{row}>")
    def power(samples: pd.Series, fs: pd.Series) -> pd.Series:
        out = [[] for _ in range(len(samples))]
        for idx, x, (rate,) in stacks(samples, fs):
            w = max(1, int(round(win_s * rate)))
            k = x.shape[1] // w
            seg = x[:, : k * w].reshape(len(x), k, w)
            p = np.abs(np.fft.rfft(seg - seg.mean(axis=2, keepdims=True), axis=2)) ** 2
            f = np.fft.rfftfreq(w, 1 / rate)
            cols = [p[:, :, (f >= lo) & (f < hi)].sum(axis=2) for _, lo, hi in (*BANDS, ("total", *TOTAL))]
            for i, r in zip(idx, np.stack(cols, axis=2)):
                out[i] = [dict(zip(names, map(float, v))) for v in r]
        return pd.Series(out)

    per = int(round(epoch_s / win_s))
    ex = epochs.select(*keys, "epoch", "stage", F.posexplode(power("samples", "fs")).alias("_i", "_p"))
    return ex.select(*keys, "stage", (F.col("epoch") * per + F.col("_i")).cast("long").alias("win"), "_p.*")


def moving_median(df: DataFrame, keys: Sequence[str], at: str, value: str, out: str, half: int, block: int = 4096) -> DataFrame:
    """Median of values within +-``half`` grid positions. Blocks carry a halo from their neighbours, so
    a long recording splits into independent blocks."""
    own = F.floor(F.col(at) / block)
    near = F.array_distinct(F.array(own, F.floor((F.col(at) - half) / block), F.floor((F.col(at) + half) / block)))
    rows = df.withColumn("_own", own).withColumn("_blk", F.explode(near))
    w = Window.partitionBy(*keys, "_blk").orderBy(at).rangeBetween(-half, half)
    return rows.withColumn(out, F.percentile(value, F.lit(0.5)).over(w)).where(F.col("_own") == F.col("_blk")).drop("_own", "_blk")


def cap_phases(windows: DataFrame, ax: Axis, act: float = 0.75, base_windows: int = 51, max_windows: int = 30) -> DataFrame:
    """A-phases: NREM windows whose amplitude exceeds the moving background by ``act``; subtype by fast share."""
    keys = list(ax.keys)
    amp = F.sqrt(F.greatest("total", F.lit(0.0)))
    w = windows.withColumn("_nrem", F.col("stage").isin(*NREM)).withColumn("_amp", amp)
    fill = quantiles(w.where("_nrem"), keys, "_amp", {"_fill": 0.5}, bounded=calm(ax))
    w = w.join(fill, keys).withColumn("_f", F.when(F.col("_nrem"), F.col("_amp")).otherwise(F.col("_fill")))
    w = moving_median(w, keys, "win", "_f", "_bg", base_windows // 2)
    w = w.withColumn("_bg", F.when(F.col("_bg") > 0, F.col("_bg")).otherwise(F.greatest("_fill", F.lit(1e-12))))
    w = w.withColumn("_a", (F.col("_nrem") & (F.col("_amp") / F.col("_bg") > 1 + act)).cast("int"))
    slow, fast = F.col("delta") + F.col("theta"), F.col("alpha") + F.col("sigma") + F.col("beta")
    found = runs(w.select(*ax.part, "win", "_a", slow.alias("_s"), fast.alias("_q")), ax, "_a", {"slow": ("sum", F.col("_s")), "fast": ("sum", F.col("_q"))})
    share = F.when(F.col("slow") + F.col("fast") > 0, F.col("fast") / (F.col("slow") + F.col("fast"))).otherwise(0.5)
    kept = found.where((F.col("_a") == 1) & (F.col("n") <= max_windows))
    return kept.select(
        *keys, F.col("first_win").alias("start_win"), (F.col("last_win") + 1).alias("end_win"),
        F.when(share < 0.30, 1).when(share > 0.50, 3).otherwise(2).alias("subtype"),
    )


def arousal_overlap(phases: DataFrame, arousals: DataFrame, keys: Sequence[str], win_s: float = 2.0) -> DataFrame:
    """A-phases that overlap an arousal interval (start_s, end_s) become subtype 3."""
    from .joins import interval_join

    secs = phases.withColumn("sec", F.explode(F.sequence(F.floor(F.col("start_win") * win_s), F.ceil(F.col("end_win") * win_s) - 1)))
    hit = interval_join(secs, arousals, keys, "sec", "start_s", "end_s", 60.0).select(*keys, "start_win").distinct()
    j = phases.join(hit.withColumn("_hit", F.lit(1)), [*keys, "start_win"], "left")
    return j.withColumn("subtype", F.when(F.col("_hit") == 1, 3).otherwise(F.col("subtype"))).drop("_hit")


def cap_summary(phases: DataFrame, nrem_minutes: DataFrame, ax: Axis, win_s: float = 2.0, b_max: int = 30) -> DataFrame:
    """CAP rate, A-phase indices, subtype shares, mean A and B durations, sequences of two A-phases or more."""
    keys = list(ax.keys)
    seq, px = with_axis(phases, keys, ("start_win",), within=ax)
    gap = F.col("start_win") - F.col("_p_end_win")
    s = shift(seq, px, ["end_win"], "_p_").withColumn("_gap", gap)
    linked = F.coalesce(F.col("_gap").between(1, b_max), F.lit(False))
    s = running_sum(s.withColumn("_open", (~linked).cast("long")).withColumn("_link", linked.cast("int")), px, {"_seq": F.col("_open")})
    per_seq = s.groupBy(*keys, "_seq").agg(F.count(F.lit(1)).alias("_n"), F.min("start_win").alias("_a"), F.max("end_win").alias("_b"))
    per_seq = per_seq.where("_n >= 2").groupBy(*keys).agg(F.count(F.lit(1)).alias("cap_n_sequences"), (F.sum(F.col("_b") - F.col("_a")) * win_s / 60).alias("cap_time_min"))
    n_sub = lambda k: F.sum((F.col("subtype") == k).cast("long")).alias(f"_n{k}")
    a = s.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_na"), n_sub(1), n_sub(2), n_sub(3),
        (F.avg(F.col("end_win") - F.col("start_win")) * win_s).alias("cap_mean_a_dur_s"),
        (F.avg(F.when(F.col("_link") == 1, F.col("_gap"))) * win_s).alias("cap_mean_b_dur_s"),
    )
    out = nrem_minutes.join(a, keys, "left").join(per_seq, keys, "left").fillna(0, subset=["_na", "_n1", "_n2", "_n3", "cap_n_sequences", "cap_time_min"])
    m = F.col("nrem_min")
    return out.select(
        *keys, "nrem_min", (F.col("cap_time_min") / m).alias("cap_rate"), "cap_time_min", (F.col("_na") / m).alias("cap_a_index"),
        *[F.when(F.col("_na") > 0, 100.0 * F.col(f"_n{k}") / F.col("_na")).alias(f"cap_a{k}_pct") for k in (1, 2, 3)],
        (F.col("_n1") / m).alias("cap_a1_index"), (F.col("_n3") / m).alias("cap_a3_index"), "cap_mean_a_dur_s", "cap_mean_b_dur_s", "cap_n_sequences",
    )


def nrem_minutes(stages: DataFrame, keys: Sequence[str], epoch_s: float = EPOCH_S, at_least: float = 10.0) -> DataFrame:
    m = stages.groupBy(*keys).agg((F.sum(F.col("stage").isin(*NREM).cast("int")) * epoch_s / 60).alias("nrem_min"))
    return m.where(F.col("nrem_min") >= at_least)


# ------------------------------------------------------------------ REM atonia
def rms_windows(epochs: DataFrame, keys: Sequence[str], win_s: float = 0.5, epoch_s: float = EPOCH_S) -> DataFrame:
    """RMS per mini-epoch about the recording mean: mean square about mu is m2 - 2 mu m1 + mu^2."""

    @F.pandas_udf("array<struct<m1:double,m2:double>>")
    def moments(samples: pd.Series, fs: pd.Series) -> pd.Series:
        out = [[] for _ in range(len(samples))]
        for idx, x, (rate,) in stacks(samples, fs):
            w = max(1, int(round(win_s * rate)))
            k = x.shape[1] // w
            seg = x[:, : k * w].reshape(len(x), k, w)
            for i, a, b in zip(idx, seg.mean(axis=2), (seg**2).mean(axis=2)):
                out[i] = [{"m1": float(u), "m2": float(v)} for u, v in zip(a, b)]
        return pd.Series(out)

    per = int(round(epoch_s / win_s))
    ex = epochs.select(*keys, "epoch", "stage", F.posexplode(moments("samples", "fs")).alias("_i", "_m"))
    ex = ex.select(*keys, "stage", (F.col("epoch") * per + F.col("_i")).cast("long").alias("win"), "_m.*")
    mu = ex.groupBy(*keys).agg(F.avg("m1").alias("_mu"))
    rms = F.sqrt(F.greatest(F.col("m2") - 2 * F.col("_mu") * F.col("m1") + F.col("_mu") * F.col("_mu"), F.lit(0.0)))
    return ex.join(mu, list(keys)).select(*keys, "stage", "win", rms.alias("rms"))


def rem_atonia(windows: DataFrame, ax: Axis, win_s: float = 0.5, min_rem_min: float = 5.0, tonic: float = 2.0, phasic: float = 4.0) -> DataFrame:
    """Tone against the quietest fifth of REM: tonic ratio and share, phasic bursts per minute, REM/NREM ratio."""
    keys, ok = list(ax.keys), calm(ax)
    rem = F.col("stage") == 4
    q = quantiles(windows.where(rem), keys, "rms", {"floor": 0.2, "_rem": 0.5}, bounded=ok).where(F.col("floor") > 0)
    nr = quantiles(windows.where(F.col("stage").isin(*NREM)), keys, "rms", {"_nrem": 0.5}, bounded=ok)
    w = windows.join(q, keys)
    tone = w.where(rem).groupBy(*keys).agg(
        (F.count(F.lit(1)) * win_s / 60).alias("rem_min"), F.avg((F.col("rms") > tonic * F.col("floor")).cast("double")).alias("rswa_tonic_fraction"),
        F.stddev_pop("rms").alias("_sd"), F.max("floor").alias("atonia_floor"), F.max("_rem").alias("_rem"),
    ).where(F.col("rem_min") >= min_rem_min)
    burst = w.withColumn("_b", (rem & (F.col("rms") > phasic * F.col("floor"))).cast("int")).select(*ax.part, "win", "_b")
    found = runs(burst, ax, "_b").where((F.col("_b") == 1) & (F.col("n") <= round(5.0 / win_s)))
    n = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    j = tone.join(nr, keys, "left").join(n, keys, "left")
    return j.select(
        *keys, "rem_min", "atonia_floor", (F.col("_rem") / F.col("atonia_floor")).alias("rswa_tonic_tone_ratio"),
        F.when(F.col("_nrem") > 0, F.col("_rem") / F.col("_nrem")).alias("rswa_rem_nrem_ratio"), "rswa_tonic_fraction",
        (F.coalesce("_n", F.lit(0)) / F.col("rem_min")).alias("rswa_phasic_per_min"), (F.col("_sd") / F.col("_rem")).alias("rswa_rem_rms_cv"),
    )


# ------------------------------------------------------------------ REM density
def rem_density(epochs: DataFrame, ax: Axis, epoch_s: float = EPOCH_S, band: tuple[float, float] = (0.5, 5.0), min_rem_min: float = 2.0) -> DataFrame:
    """Eye-movement deflections above 3 robust SD of band-passed EOG, per REM minute.

    A band-passed signal is centred, so its MAD is the median of |x|.
    """
    keys = list(ax.keys)
    ctx = with_context(epochs, ax, min(2.0, epoch_s)).where("stage = 4")
    thr = amplitude_quantile(ctx, keys, band, 0.5, "_mad").select(*keys, (3 * 1.4826 * F.col("_mad")).alias("threshold_uv"))
    hits = ctx.join(thr, keys).withColumn("_k", F.size(band_peaks(band, 0.15)("fs", "padded", "pad", F.size("samples"), "threshold_uv")))
    out = hits.groupBy(*keys).agg((F.count(F.lit(1)) * epoch_s / 60).alias("rem_min"), F.sum("_k").alias("n_movements"), F.max("threshold_uv").alias("threshold_uv"))
    return out.where(F.col("rem_min") >= min_rem_min).withColumn("rem_density_index", F.col("n_movements") / F.col("rem_min"))


# ------------------------------------------------------------------ complexity
def epoch_complexity(epochs: DataFrame, ax: Axis, per_stage: int | None = None, max_samples: int | None = None) -> DataFrame:
    """Sample and permutation entropy of every epoch; only where asked of ``per_stage`` even ones and thinned to ``max_samples``."""
    chosen = epochs if per_stage is None else even_subsample(epochs, [*ax.keys, "stage"], "epoch", per_stage, within=ax)

    @F.pandas_udf("sampen double, permen double")
    def entropy(samples: pd.Series) -> pd.DataFrame:
        rows = []
        for s in samples:
            x = np.asarray(s, float) if max_samples is None else thinned(np.asarray(s, float), max_samples)
            x = x[np.isfinite(x)] - np.nanmean(x)
            rows.append((sample_entropy(x), permutation_entropy(x)))
        return pd.DataFrame(rows, columns=["sampen", "permen"], dtype="float64")

    keep = [c for c in epochs.columns if c != "samples"]
    return chosen.withColumn("_e", entropy("samples")).select(*keep, "_e.*")


def stage_complexity(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    return table.where(F.col("stage") != 9).groupBy(*keys, "stage").agg(
        F.count(F.lit(1)).alias("n_epochs"), F.avg("sampen").alias("sampen_mean"), F.stddev_pop("sampen").alias("sampen_sd"),
        F.avg("permen").alias("permen_mean"), F.stddev_pop("permen").alias("permen_sd"),
    )


# ------------------------------------------------------------------ respiration
def breath_times(epochs: DataFrame, ax: Axis, epoch_s: float = EPOCH_S, band: tuple[float, float] = (0.1, 0.6), min_gap_s: float = 1.0) -> DataFrame:
    """Breaths: positive peaks of the band-passed signal above the recording's median amplitude, at least ``min_gap_s`` apart."""
    keys = list(ax.keys)
    ctx = with_context(epochs, ax, min(10.0, epoch_s))
    thr = amplitude_quantile(ctx, keys, band, 0.5, "_h")
    p = band_peaks(band, min_gap_s, signed=True)("fs", "padded", "pad", F.size("samples"), "_h")
    at = ctx.join(thr, keys).select(*ax.part, "epoch", "stage", F.explode(p).alias("_t"))
    return at.select(*ax.part, "stage", (F.col("epoch") * epoch_s + F.col("_t")).alias("t"))


def breath_intervals(breaths: DataFrame, ax: Axis) -> DataFrame:
    """Interval before each breath; both ends in the same stage."""
    tx = Axis(ax.keys, ("t",), ax.chunked)
    s = shift(breaths, tx, ["t", "stage"], "_p_")
    return s.where(F.col("_p_stage") == F.col("stage")).withColumn("gap_s", F.col("t") - F.col("_p_t")).select(*ax.part, "stage", "t", "gap_s")


def respiratory_rate(intervals: DataFrame, keys: Sequence[str], **kw) -> DataFrame:
    """Mean, SD and CV of the breath rate per stage (rates of 4 to 40 per minute)."""
    r = intervals.withColumn("rate", 60.0 / F.col("gap_s")).where((F.col("rate") > 4) & (F.col("rate") < 40) & (F.col("stage") != 9))
    d = describe(r, [*keys, "stage"], "rate", {}, **kw)
    return d.select(*keys, "stage", "n", F.col("mean").alias("rate_mean"), sd_pop().alias("rate_sd"), cv_pop().alias("rrv_cv"))


def interval_entropy(intervals: DataFrame, keys: Sequence[str], order: str, gap: str, min_n: int = 50) -> DataFrame:
    """Sample entropy of a whole interval series: one night's intervals, a few ten thousand numbers, are one array."""
    arr = intervals.select(*keys, order, gap).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, gap))).alias("_a"))

    @F.pandas_udf("double")
    def entropy(a: pd.Series) -> pd.Series:
        return pd.Series([sample_entropy(np.asarray(v, float)) if len(v) >= min_n else None for v in a], dtype="float64")

    return arr.select(*keys, F.size("_a").alias("n"), entropy(F.col(f"_a.{gap}")).alias("sampen"))
