"""EEG epoch spectra, spectral shape, spindles and slow-oscillation coupling."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..vocab import EPOCH_S, STAGES
from .describe import describe, sd_samp
from .ordered import Axis, merge_gaps
from .signals import BAND_NAMES, BANDS, TOTAL, envelopes, stacks, trapezoid, welch_psd, with_context

SIGMA, SO = (11.0, 16.0), (0.5, 1.25)
SPINDLE_K, SMOOTH_S, MERGE_S, MIN_S, MAX_S = 2.5, 0.1, 0.3, 0.5, 3.0
RATIOS = ("theta_alpha", "delta_sigma", "rem_slowing")


def _rows(n: int, cols: Sequence[str]) -> pd.DataFrame:
    return pd.DataFrame(np.nan, index=range(n), columns=list(cols))


def band_powers(epochs: DataFrame, min_s: float = 2.0) -> DataFrame:
    """Absolute and relative band power per epoch with slowing ratios; short or slow epochs give NULL."""
    names = [*BAND_NAMES, "total"]

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def power(samples: pd.Series, fs: pd.Series) -> pd.DataFrame:
        out = _rows(len(samples), names)
        for idx, x, (rate,) in stacks(samples, fs):
            if x.shape[1] < int(rate * min_s) or rate < 2 * TOTAL[1]:
                continue
            freq, psd = welch_psd(x - x.mean(axis=1, keepdims=True), rate)
            for name, lo, hi in BANDS:
                out.loc[idx, name] = trapezoid(psd, freq, lo, hi)
            out.loc[idx, "total"] = trapezoid(psd, freq, *TOTAL)
        return out

    keep = [c for c in epochs.columns if c != "samples"]
    p = epochs.withColumn("_p", power("samples", "fs")).select(*keep, "_p.*")
    num = {n: F.when(F.col("total") > 0, F.col(n)) for n in BAND_NAMES}
    return p.select(
        *keep, *[num[n].alias(f"abs_{n}") for n in BAND_NAMES],
        *[(num[n] / F.col("total")).alias(f"rel_{n}") for n in BAND_NAMES], *slowing({n: num[n] for n in BAND_NAMES}),
    )


def slowing(b: dict) -> list:
    """theta/alpha, delta/sigma and (delta+theta)/(alpha+sigma+beta)."""
    r = lambda a, c: F.when(c > 0, a / c)
    return [
        r(b["theta"], b["alpha"]).alias("theta_alpha"), r(b["delta"], b["sigma"]).alias("delta_sigma"),
        r(b["delta"] + b["theta"], b["alpha"] + b["sigma"] + b["beta"]).alias("rem_slowing"),
    ]


def stage_means(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean band powers per stage; ratios are ratios of the means."""
    ok = table.where(F.col("abs_delta").isNotNull() & (F.col("stage") != 9))
    m = ok.groupBy(*keys, "stage").agg(
        F.count(F.lit(1)).alias("n_epochs"),
        *[F.avg(f"{k}_{n}").alias(f"{k}_{n}") for k in ("abs", "rel") for n in BAND_NAMES],
    )
    return m.select("*", *slowing({n: F.col(f"abs_{n}") for n in BAND_NAMES}))


def stage_contrasts(means: DataFrame, keys: Sequence[str]) -> DataFrame:
    """REM slowing, N3 delta, and the REM/N3 slowing ratio per recording."""
    at = lambda s, c: F.max(F.when(F.col("stage") == s, F.col(c)))
    c = means.groupBy(*keys).agg(
        at(4, "rem_slowing").alias("rem_slowing"), at(1, "rel_delta").alias("n3_delta_rel"),
        at(1, "abs_delta").alias("n3_delta_abs"), at(1, "rem_slowing").alias("_n3"),
    )
    return c.withColumn("rem_n3_slowing_ratio", F.when(F.col("_n3") > 0, F.col("rem_slowing") / F.col("_n3"))).drop("_n3")


def spectral_shape(epochs: DataFrame, fit: tuple[float, float] = (2.0, 30.0), min_s: float = 2.0) -> DataFrame:
    """Aperiodic exponent and offset (log-log fit), spectral entropy, SEF95 and median frequency per epoch."""
    names = ["aper_exp", "aper_off", "spec_ent", "sef95", "med_freq"]

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def shape(samples: pd.Series, fs: pd.Series) -> pd.DataFrame:
        out = _rows(len(samples), names)
        for idx, x, (rate,) in stacks(samples, fs):
            if x.shape[1] < int(rate * min_s) or rate < 2 * TOTAL[1]:
                continue
            freq, psd = welch_psd(x - x.mean(axis=1, keepdims=True), rate)
            band = (freq >= TOTAL[0]) & (freq < TOTAL[1])
            f, p = freq[band], psd[:, band]
            good = (p > 0).all(axis=1)
            if len(f) < 8 or not good.any():
                continue
            idx, p = idx[good], p[good]
            share = p / p.sum(axis=1, keepdims=True)
            out.loc[idx, "spec_ent"] = -(share * np.log(share)).sum(axis=1) / np.log(len(f))
            steps = (p[:, 1:] + p[:, :-1]) / 2 * np.diff(f)
            cum = np.hstack([np.zeros((len(p), 1)), np.cumsum(steps, axis=1)])
            cum /= cum[:, -1:]
            for name, level in (("sef95", 0.95), ("med_freq", 0.5)):
                out.loc[idx, name] = [np.interp(level, c, f) for c in cum]
            use = (f >= fit[0]) & (f <= fit[1])
            if use.sum() >= 5:
                lx, ly = np.log10(f[use]), np.log10(p[:, use])
                cx = lx - lx.mean()
                slope = ly @ cx / (cx @ cx)
                out.loc[idx, "aper_exp"] = -slope
                out.loc[idx, "aper_off"] = ly.mean(axis=1) - slope * lx.mean()
        return out

    keep = [c for c in epochs.columns if c != "samples"]
    return epochs.withColumn("_s", shape("samples", "fs")).select(*keep, "_s.*")


def shape_summary(shapes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stage means, N2 spread (3 epochs) and sleep spread (5 epochs) of each shape metric, long form."""
    metrics = ["aper_exp", "aper_off", "spec_ent", "sef95", "med_freq"]
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in metrics]))
    tall = shapes.select(*keys, "stage", cells.alias("_c")).select(*keys, "stage", "_c.*").where("v IS NOT NULL AND NOT isnan(v)")
    at = lambda *s: F.when(F.col("stage").isin(*s), F.col("v"))
    agg = [F.avg(at(c)).alias(f"mean_{t}") for c, t in STAGES.items() if t != "n1"]
    spread = lambda c, k: F.when(F.count(c) >= k, F.stddev_pop(c))
    return tall.groupBy(*keys, "metric").agg(*agg, spread(at(2), 3).alias("n2std"), spread(at(1, 2, 3, 4), 5).alias("sleepstd"))


def stage_dispersion(table: DataFrame, keys: Sequence[str], metric: str, **kw) -> DataFrame:
    """Per-stage spread of one epoch metric."""
    d = describe(table.where(F.col("stage") != 9), [*keys, "stage"], metric, {"p10": 0.1, "p50": 0.5, "p90": 0.9}, **kw)
    return d.select(*keys, "stage", "n", "mean", sd_samp().alias("sd"), (sd_samp() / F.nullifzero(F.abs("mean"))).alias("cv"), "p10", "p50", "p90")


# ------------------------------------------------------------------ spindles
def spindle_threshold(context: DataFrame, keys: Sequence[str], k: float = SPINDLE_K, min_s: float = 60.0) -> DataFrame:
    """mean + k SD of the sigma envelope over N2+N3, from per-epoch sums."""

    @F.pandas_udf("n double, s double, q double")
    def sums(fs: pd.Series, padded: pd.Series, pad: pd.Series, n: pd.Series) -> pd.DataFrame:
        out = _rows(len(fs), ["n", "s", "q"])
        for i, e, _ in envelopes(fs, padded, pad, n, SIGMA, SMOOTH_S):
            out.loc[i] = len(e), e.sum(), (e * e).sum()
        return out

    nrem = context.where(F.col("stage").isin(1, 2))
    per = nrem.withColumn("_e", sums("fs", "padded", "pad", F.size("samples"))).groupBy(*keys).agg(
        F.sum("_e.n").alias("_n"), F.sum("_e.s").alias("_s"), F.sum("_e.q").alias("_q"), F.max("fs").alias("_fs")
    ).where(F.col("_n") >= F.col("_fs") * min_s)
    mean = F.col("_s") / F.col("_n")
    return per.select(*keys, (mean + k * F.sqrt(F.greatest(F.col("_q") / F.col("_n") - mean * mean, F.lit(0.0)))).alias("threshold"))


def spindle_events(epochs: DataFrame, ax: Axis, epoch_s: float = EPOCH_S, k: float = SPINDLE_K, min_calibration_s: float = 60.0, min_stage_min: float = 2.0) -> DataFrame:
    """One row per spindle: stage, start_s, duration_s, amplitude and the slow-oscillation phase at its peak.

    Two passes over epochs: envelope sums give the recording threshold, then each epoch emits its
    crossings. Crossings that touch or nearly touch across seams merge as rows.
    """
    keys = list(ax.keys)
    ctx = with_context(epochs.where(F.col("fs") >= 2 * SIGMA[1]), ax, min(5.0, epoch_s))
    thr = spindle_threshold(ctx, keys, k, min_calibration_s)
    minutes = epochs.groupBy(*keys, "stage").agg((F.count(F.lit(1)) * epoch_s / 60).alias("_min")).where(F.col("_min") >= min_stage_min)

    @F.pandas_udf("array<struct<a:int,b:int,amp:double,phase:double>>")
    def crossings(fs: pd.Series, padded: pd.Series, pad: pd.Series, n: pd.Series, t: pd.Series) -> pd.Series:
        out = [[] for _ in range(len(fs))]
        slow = {i: np.angle(z) for i, _, z in envelopes(fs, padded, pad, n, SO, 0.0)}
        for i, e, _ in envelopes(fs, padded, pad, n, SIGMA, SMOOTH_S):
            flips = np.flatnonzero(np.diff(np.r_[0, (e > t.iloc[i]).astype(int), 0]))
            for a, b in zip(flips[::2], flips[1::2]):
                top = a + int(np.argmax(e[a:b]))
                out[i].append({"a": int(a), "b": int(b), "amp": float(e[top]), "phase": float(slow[i][top])})
        return pd.Series(out)

    hit = ctx.where(F.col("stage").isin(1, 2)).join(thr, keys).join(minutes, [*keys, "stage"])
    hit = hit.withColumn("_x", F.explode(crossings("fs", "padded", "pad", F.size("samples"), "threshold")))
    base = F.col("epoch") * epoch_s
    rows = hit.select(
        *keys, "stage", (base + F.col("_x.a") / F.col("fs")).alias("start_s"), (base + F.col("_x.b") / F.col("fs")).alias("end_s"),
        F.struct(F.col("_x.amp").alias("amp"), F.col("_x.phase").alias("phase")).alias("_peak"),
    )
    merged = merge_gaps(rows, [*keys, "stage"], "start_s", "end_s", MERGE_S, MIN_S, MAX_S, within=ax, aggs={"_peak": ("max", F.col("_peak"))})
    return merged.select(*keys, "stage", "start_s", (F.col("end_s") - F.col("start_s")).alias("duration_s"), F.col("_peak.amp").alias("amp_uv"), F.col("_peak.phase").alias("so_phase"))


def spindle_summary(events: DataFrame, stages: DataFrame, keys: Sequence[str], epoch_s: float = EPOCH_S) -> DataFrame:
    """Density per minute of stage, mean and spread of amplitude and duration."""
    one = [*keys, "stage"]
    minutes = stages.where(F.col("stage").isin(1, 2)).groupBy(*one).agg((F.count(F.lit(1)) * epoch_s / 60).alias("minutes"))
    ev = events.groupBy(*one).agg(
        F.count(F.lit(1)).alias("n_spindles"), F.avg("amp_uv").alias("amp_mean"), F.stddev_samp("amp_uv").alias("amp_sd"),
        F.avg("duration_s").alias("dur_mean"), F.stddev_samp("duration_s").alias("dur_sd"),
    )
    out = minutes.join(ev, one, "left").fillna(0, subset=["n_spindles"])
    return out.withColumn("density_per_min", F.col("n_spindles") / F.col("minutes"))


def circular_summary(events: DataFrame, keys: Sequence[str], phase: str, min_n: int = 8) -> DataFrame:
    """Resultant length, preferred phase (cos, sin) and Rayleigh z of event phases."""
    a = events.groupBy(*keys).agg(F.count(phase).alias("n"), F.avg(F.cos(phase)).alias("_c"), F.avg(F.sin(phase)).alias("_s")).where(F.col("n") >= min_n)
    r = F.sqrt(F.col("_c") * F.col("_c") + F.col("_s") * F.col("_s"))
    return a.select(
        *keys, F.col("n").alias("n_spindles"), r.alias("coupling_strength"),
        F.when(r > 0, F.col("_c") / r).alias("preferred_phase_cos"), F.when(r > 0, F.col("_s") / r).alias("preferred_phase_sin"),
        (F.col("n") * r * r).alias("modulation"),
    )
