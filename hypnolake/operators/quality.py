"""Signal quality, stage profiles of a channel, the raw-epoch bank and night embeddings."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..vocab import EPOCH_S, STAGES
from .cohort import even_subsample
from .network import referenced
from .ordered import Axis, runs
from .ranks import quantiles
from .signals import stacks, strongest_peaks, analytic

GOOD_Q, BAD_Q = 0.8, 0.5


def channel_quality(epochs: DataFrame, keys: Sequence[str], flat_s: float = 1.0, flat_share: float = 0.02, **kw) -> DataFrame:
    """NaN share, share at the extreme rails, share of flat windows against the 90th percentile window SD."""
    keys = list(keys)
    x = F.transform("samples", lambda v: v.cast("double"))
    ok = F.filter(x, lambda v: v.isNotNull() & ~F.isnan(v))
    e = epochs.select(*keys, "fs", F.size("samples").alias("_n"), ok.alias("_ok"))
    base = e.groupBy(*keys).agg(
        F.sum("_n").alias("_n"), F.sum(F.size("_ok")).alias("_k"), F.min(F.array_min("_ok")).alias("_lo"), F.max(F.array_max("_ok")).alias("_hi")
    )
    near = lambda v, r: F.abs(v - r) <= 1e-8 + 1e-5 * F.abs(r)
    rail = F.size(F.filter("_ok", lambda v: near(v, F.col("_lo")) | near(v, F.col("_hi"))))
    clip = e.join(base.select(*keys, "_lo", "_hi"), keys).groupBy(*keys).agg(F.sum(rail).alias("_rail"))

    @F.pandas_udf("array<double>")
    def window_sd(samples: pd.Series, fs: pd.Series) -> pd.Series:
        out = [[] for _ in range(len(samples))]
        for idx, m, (rate,) in stacks(samples, fs):
            w = max(int(round(flat_s * rate)), 2)
            k = m.shape[1] // w
            sd = m[:, : k * w].reshape(len(m), k, w).std(axis=2)
            for i, row in zip(idx, sd):
                out[i] = row.tolist()
        return pd.Series(out)

    sds = e.select(*keys, F.explode(window_sd("_ok", "fs")).alias("sd"))
    active = quantiles(sds, keys, "sd", {"_active": 0.9}, **kw)
    flat = F.when(F.col("_active") > 0, F.col("sd") < flat_share * F.col("_active")).otherwise(F.col("sd") <= 0)
    fl = sds.join(active, keys).groupBy(*keys).agg(F.avg(flat.cast("double")).alias("flat_frac"))
    return base.join(clip, keys).join(fl, keys, "left").select(
        *keys, (1 - F.col("_k") / F.col("_n")).alias("nan_frac"), F.when(F.col("_k") >= 2, F.col("_rail") / F.col("_k")).alias("clip_frac"), "flat_frac"
    )


def beat_quality(epochs: DataFrame, ax: Axis, windows: int | None = None, by_stage: bool = False) -> DataFrame:
    """Correlation of each beat with its window's mean beat; every epoch is a window, or ``windows`` even ones where given.

    Output beats as rows: keys, stage, epoch, q in [0, 1].
    """
    group = [*ax.keys, "stage"] if by_stage else list(ax.keys)
    chosen = epochs if windows is None else even_subsample(epochs, group, "epoch", windows, within=ax)

    @F.pandas_udf("array<double>")
    def quality(samples: pd.Series, fs: pd.Series) -> pd.Series:
        out = [[] for _ in range(len(samples))]
        for idx, m, (rate,) in stacks(samples, fs):
            band = np.abs(analytic(m, rate, 5.0, min(15.0, rate / 2)).real)
            half = max(2, int(0.25 * rate))
            for i, raw, b in zip(idx, m, band):
                at = strongest_peaks(b, np.percentile(b, 90), int(0.4 * rate))
                at = at[(at >= half) & (at < len(raw) - half)]
                if len(at) < 3:
                    continue
                beats = np.stack([raw[k - half : k + half] for k in at])
                beats = beats - beats.mean(axis=1, keepdims=True)
                mean = beats.mean(axis=0)
                norm = np.linalg.norm(beats, axis=1) * np.linalg.norm(mean)
                out[i] = np.clip(np.where(norm > 0, beats @ mean / np.where(norm > 0, norm, 1), 0), 0, 1).tolist()
        return pd.Series(out)

    return chosen.select(*ax.keys, "stage", "epoch", F.explode(quality("samples", "fs")).alias("q"))


def quality_summary(beats: DataFrame, keys: Sequence[str], **kw) -> DataFrame:
    q = beats.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_beats"), F.avg("q").alias("q_mean"),
        (100.0 * F.avg((F.col("q") >= GOOD_Q).cast("double"))).alias("pct_good"), (100.0 * F.avg((F.col("q") < BAD_Q).cast("double"))).alias("pct_bad"),
    )
    return q.join(quantiles(beats, list(keys), "q", {"q_median": 0.5}, **kw), list(keys))


# ------------------------------------------------------------------ stage profile of one channel
def stage_profile(epochs: DataFrame, ax: Axis, **kw) -> DataFrame:
    """Amplitude statistics per stage and the representative epoch (middle of the longest bout)."""
    from .events import longest_bout

    keys = list(ax.keys)
    one = [*keys, "stage"]
    known = epochs.where(F.col("stage").isin(*STAGES))
    v = known.select(*one, F.explode("samples").alias("v")).withColumn("v", F.col("v").cast("double"))
    stats = v.groupBy(*one).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
    tails = quantiles(v, one, "v", {"p5": 0.05, "p95": 0.95}, **kw)
    size = known.groupBy(*one).agg(F.count(F.lit(1)).alias("n_epochs"))
    bouts = runs(epochs.select(*ax.part, "epoch", "stage"), ax, "stage")
    mid = longest_bout(bouts, keys, "stage", "first_epoch").select(*one, F.floor((2 * F.col("first_epoch") + F.col("n") - 1) / 2).cast("long").alias("example_epoch"))
    return size.join(stats, one).join(tails, one).join(mid, one)


def stage_concatenation(epochs: DataFrame, ax: Axis, stage: int, t0: float, t1: float, epoch_s: float = EPOCH_S) -> DataFrame:
    """Samples of one stage joined end to end, cut to [t0, t1): second on the joined axis, value, seam flag."""
    from .ordered import ordinal, shift

    mine = epochs.where(F.col("stage") == stage)
    o = ordinal(shift(mine, ax, ["epoch"], "_p_"), ax, "_k")
    seam = F.coalesce(F.col("epoch") != F.col("_p_epoch") + 1, F.lit(False))
    near = o.where((F.col("_k") * epoch_s < t1) & ((F.col("_k") + 1) * epoch_s > t0))
    x = near.select(*ax.keys, "_k", "fs", seam.alias("_seam"), F.posexplode("samples").alias("_i", "value"))
    t = F.col("_k") * epoch_s + F.col("_i") / F.col("fs")
    return x.select(*ax.keys, t.alias("t"), "value", (F.col("_seam") & (F.col("_i") == 0)).alias("seam")).where((F.col("t") >= t0) & (F.col("t") < t1))


# ------------------------------------------------------------------ raw-epoch bank and embeddings
# Fixed canonical derivations, in slot order.
SLOTS = ("f3", "f4", "c3", "c4", "o1", "o2")


def epoch_bank(montages: DataFrame, keys: Sequence[str], min_channels: int = 5, clip: float = 8.0) -> DataFrame:
    """Canonical six-slot epochs, average-referenced, z-scored per channel over the night, clipped.

    Night statistics come from per-epoch sums; rows keep one epoch each. Missing slots hold zeros.
    """
    keys = list(keys)

    @F.pandas_udf("array<struct<slot:int,n:int,s:double,q:double,x:array<float>>>")
    def slots(channels: pd.Series, x: pd.Series) -> pd.Series:
        out = []
        for names, data in zip(channels, x):
            at = [next((i for i, c in enumerate(names) if cue in c.lower()), None) for cue in SLOTS]
            have = [i for i in at if i is not None]
            rows = []
            if len(have) >= min_channels:
                m = dict(zip(have, referenced([data[i] for i in have])))
                rows = [{"slot": k, "n": len(m[i]), "s": float(m[i].sum()), "q": float((m[i] ** 2).sum()), "x": m[i].astype("float32")} for k, i in enumerate(at) if i is not None]
            out.append(rows)
        return pd.Series(out)

    s = montages.select(*keys, "epoch", "stage", F.explode(slots("channels", "x")).alias("_s")).select(*keys, "epoch", "stage", "_s.*")
    st = s.groupBy(*keys, "slot").agg(F.sum("n").alias("_n"), F.sum("s").alias("_s"), F.sum("q").alias("_q"))
    mu = F.col("_s") / F.col("_n")
    sd = F.sqrt(F.greatest(F.col("_q") / F.col("_n") - mu * mu, F.lit(0.0)))
    st = st.select(*keys, "slot", mu.alias("_mu"), F.when(sd < 1e-8, 1.0).otherwise(sd).alias("_sd"))
    z = F.transform("x", lambda v: F.greatest(F.least((v - F.col("_mu")) / F.col("_sd"), F.lit(clip)), F.lit(-clip)).cast("float"))
    j = s.join(st, [*keys, "slot"]).withColumn("x", z)
    return j.groupBy(*keys, "epoch", "stage").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("slot", "x")))).alias("slots"))


def night_embedding(vectors: DataFrame, keys: Sequence[str], vector: str = "embedding") -> DataFrame:
    """Mean vector over the night and per stage: one row per (keys, pool)."""
    pool = F.explode(F.array(F.lit("all"), F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in STAGES.items() for x in kv]), F.col("stage")), F.lit("unknown"))))
    v = vectors.select(*keys, pool.alias("pool"), array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("_v"))
    return v.groupBy(*keys, "pool").agg(F.count(F.lit(1)).alias("n"), Summarizer.mean(F.col("_v")).alias("_m")).select(
        *keys, "pool", "n", vector_to_array("_m").alias("mean_vector")
    )
