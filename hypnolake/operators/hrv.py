"""Heart-rate variability on RR rows (keys, t, rr_ms, stage): pools by explode, statistics by aggregation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from ..vocab import EPOCH_S, POOLS, STAGES
from .micro import interval_entropy
from .ordered import Axis, ordinal, running_sum, shift
from .ranks import quantiles
from .signals import amplitude_quantile, band_peaks, with_context

RR_MIN, RR_MAX = 300.0, 2000.0
QRS = (5.0, 15.0)
# Fixed box sizes (beats) of the two scaling ranges, 4-16 and 16-64 on a log grid.
DFA_SHORT = (4, 5, 7, 8, 10, 13, 16)
DFA_LONG = (16, 19, 23, 28, 35, 43, 52, 63)


def r_peaks(epochs: DataFrame, ax: Axis, epoch_s: float = EPOCH_S) -> DataFrame:
    """Beat times: |5-15 Hz| maxima above the recording's 90th percentile, 0.4 s apart."""
    keys = list(ax.keys)
    ctx = with_context(epochs, ax, min(2.0, epoch_s))
    thr = amplitude_quantile(ctx, keys, QRS, 0.9, "_h")
    at = ctx.join(thr, keys).select(
        *ax.part, "epoch", "stage", F.explode(band_peaks(QRS, 0.4)("fs", "padded", "pad", F.size("samples"), "_h")).alias("_t")
    )
    return at.select(*ax.part, "stage", (F.col("epoch") * epoch_s + F.col("_t")).alias("t"))


def rr_intervals(beats: DataFrame, ax: Axis, lo: float = RR_MIN, hi: float = RR_MAX) -> DataFrame:
    """Physiologic intervals whose two beats share a scored stage; t is the first beat."""
    tx = Axis(ax.keys, ("t",), ax.chunked)
    nx = shift(beats, tx, ["t", "stage"], "_n_", back=False)
    rr = (F.col("_n_t") - F.col("t")) * 1000.0
    return nx.withColumn("rr_ms", rr).where((F.col("rr_ms") >= lo) & (F.col("rr_ms") <= hi) & (F.col("stage") == F.col("_n_stage")) & (F.col("stage") != 9)).select(*ax.part, "stage", "t", "rr_ms")


def pooled(rr: DataFrame, pools: Sequence[str] = ("wake", "n1", "n2", "n3", "rem", "nrem", "sleep")) -> DataFrame:
    """Each interval joins every pool that holds its stage (at most three)."""
    member = F.filter(F.array(*[F.when(F.col("stage").isin(*POOLS[p]), F.lit(p)) for p in pools]), lambda x: x.isNotNull())
    return rr.withColumn("pool", F.explode(member))


def pool_axis(ax: Axis) -> Axis:
    return Axis((*ax.keys, "pool"), ("t",), ax.chunked)


def time_domain(pools: DataFrame, ax: Axis, min_beats: int = 30, **kw) -> DataFrame:
    """HR, mean and median NN, SDNN, RMSSD, SDSD, pNN50, CVNN, SD1, SD2 and their ratio per pool."""
    px = pool_axis(ax)
    keys = list(px.keys)
    d = shift(pools, px, ["rr_ms"], "_p_").withColumn("_d", F.col("rr_ms") - F.col("_p_rr_ms"))
    a = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_beats"), F.avg("rr_ms").alias("mean_nn"), F.stddev_samp("rr_ms").alias("sdnn"),
        F.sqrt(F.avg(F.col("_d") * F.col("_d"))).alias("rmssd"), F.stddev_samp("_d").alias("sdsd"),
        (100.0 * F.sum((F.abs("_d") > 50).cast("int")) / F.count("_d")).alias("pnn50"),
    ).where(F.col("n_beats") >= min_beats)
    med = quantiles(pools, keys, "rr_ms", {"median_nn": 0.5}, **kw)
    j = a.join(med, keys)
    sd1 = F.sqrt(0.5 * F.col("sdsd") * F.col("sdsd"))
    q2 = 2 * F.col("sdnn") * F.col("sdnn") - 0.5 * F.col("sdsd") * F.col("sdsd")
    sd2 = F.when(q2 > 0, F.sqrt(q2))
    return j.select(
        "*", (60000.0 / F.col("mean_nn")).alias("hr_mean"), (F.col("sdnn") / F.col("mean_nn")).alias("cvnn"),
        sd1.alias("sd1"), sd2.alias("sd2"), F.when(sd2 > 0, sd1 / sd2).alias("sd1sd2"),
    )


def frequency_domain(pools: DataFrame, keys: Sequence[str], window_s: float = 300.0, min_beats: int = 50, rate: float = 4.0, min_piece_s: float = 20.0, min_piece_beats: int = 8) -> DataFrame:
    """LF, HF, LF/HF, normalised and total power: periodograms of 5-minute pieces, averaged by their length.

    Averaging pieces is Welch's estimate, so no task sees more than one piece of a night. Pieces below ``min_piece_s`` or
    ``min_piece_beats`` hold no low frequencies; they are left out, and ``n_beats`` counts the beats that were used.
    """
    one = [*keys, "pool"]
    piece = pools.withColumn("_w", F.floor(F.col("t") / window_s))
    arr = piece.groupBy(*one, "_w").agg(F.array_sort(F.collect_list(F.struct("t", "rr_ms"))).alias("_a"), F.count(F.lit(1)).alias("_n"))

    @F.pandas_udf("s double, lf double, hf double, tp double")
    def power(a: pd.Series) -> pd.DataFrame:
        rows = []
        for beats in a:
            t = np.cumsum([b["rr_ms"] for b in beats]) / 1000.0
            x = np.array([b["rr_ms"] for b in beats], float)
            if len(x) < min_piece_beats or t[-1] - t[0] < min_piece_s:
                rows.append((0.0, 0.0, 0.0, 0.0))
                continue
            grid = np.arange(t[0], t[-1], 1 / rate)
            y = np.interp(grid, t, x)
            win = np.hanning(len(y))
            p = 2 * np.abs(np.fft.rfft((y - y.mean()) * win)) ** 2 / (rate * (win**2).sum())
            f = np.fft.rfftfreq(len(y), 1 / rate)
            area = lambda lo, hi: float(p[(f >= lo) & (f < hi)].sum() * (f[1] - f[0]))
            rows.append((t[-1] - t[0], area(0.04, 0.15), area(0.15, 0.4), area(0.0033, 0.4)))
        return pd.DataFrame(rows, columns=["s", "lf", "hf", "tp"], dtype="float64")

    length = F.col("_p.s")
    per = arr.withColumn("_p", power("_a")).where(length > 0).groupBy(*one).agg(
        F.sum("_n").alias("n_beats"), *[(F.sum(length * F.col(f"_p.{c}")) / F.sum(length)).alias(c) for c in ("lf", "hf", "tp")]
    ).where(F.col("n_beats") >= min_beats)
    both = F.col("lf") + F.col("hf")
    return per.select(*one, "n_beats", "lf", "hf", F.when(F.col("hf") > 0, F.col("lf") / F.col("hf")).alias("lfhf"), F.when(both > 0, F.col("lf") / both).alias("lfn"), F.when(both > 0, F.col("hf") / both).alias("hfn"), "tp")


def dfa(pools: DataFrame, ax: Axis, scales: Sequence[int], name: str, min_beats: int, min_points: int = 4) -> DataFrame:
    """Detrended-fluctuation exponent without Python: boxes of the integrated series are groups.

    A box's residual about its line needs only sums of y, y^2 and t*y, and ignores the offset of y,
    so the running profile can be cut anywhere.
    """
    px = pool_axis(ax)
    keys = list(px.keys)
    mean = pools.groupBy(*keys).agg(F.avg("rr_ms").alias("_mu"), F.count(F.lit(1)).alias("_total")).where(F.col("_total") >= min_beats)
    x = pools.join(mean, keys).withColumn("_x", F.col("rr_ms") - F.col("_mu"))
    y = ordinal(running_sum(x, px, {"_y": F.col("_x")}), px, "_i").select(*keys, "_y", "_i", "_total")
    b = y.withColumn("_n", F.explode(F.array(*[F.lit(int(s)) for s in scales])))
    b = b.withColumn("_box", F.floor(F.col("_i") / F.col("_n"))).withColumn("_t", (F.col("_i") % F.col("_n")) - (F.col("_n") - 1) / 2.0)
    b = b.where(F.col("_box") < F.floor(F.col("_total") / F.col("_n")))
    box = b.groupBy(*keys, "_n", "_box").agg(F.var_pop("_y").alias("_v"), F.sum(F.col("_t") * F.col("_y")).alias("_ty"))
    stt = F.col("_n") * (F.col("_n") * F.col("_n") - 1) / 12.0
    resid = F.greatest(F.col("_v") * F.col("_n") - F.col("_ty") * F.col("_ty") / stt, F.lit(0.0))
    per = box.groupBy(*keys, "_n").agg(F.sqrt(F.sum(resid) / (F.count(F.lit(1)) * F.max("_n"))).alias("_F")).where("_F > 0")
    return per.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k"), F.regr_slope(F.log("_F"), F.log(F.col("_n").cast("double"))).alias(name)).where(F.col("_k") >= min_points).drop("_k")


def nonlinear(pools: DataFrame, ax: Axis) -> DataFrame:
    """DFA alpha1, alpha2 and sample entropy of all beats per pool."""
    px = pool_axis(ax)
    keys = list(px.keys)
    ent = interval_entropy(pools, keys, "t", "rr_ms").select(*keys, "sampen")
    return ent.join(dfa(pools, ax, DFA_SHORT, "dfa_a1", 32), keys, "left").join(dfa(pools, ax, DFA_LONG, "dfa_a2", 128), keys, "left")


def contrasts(stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ratios and deltas between pools, HR range and RMSSD spread across the five stages."""
    at = lambda pool, c: F.max(F.when(F.col("pool") == pool, F.col(c)))
    r = lambda a, b: F.when(b != 0, a / b)
    five = F.col("pool").isin(*STAGES.values())
    hr, rm = F.when(five, F.col("hr_mean")), F.when(five, F.col("rmssd"))
    return stats.groupBy(*keys).agg(
        r(at("rem", "rmssd"), at("nrem", "rmssd")).alias("rem_nrem_rmssd_ratio"),
        (at("rem", "hr_mean") - at("nrem", "hr_mean")).alias("rem_nrem_hr_delta"),
        (at("wake", "hr_mean") - at("sleep", "hr_mean")).alias("wake_sleep_hr_delta"),
        r(at("n3", "rmssd"), at("wake", "rmssd")).alias("n3_wake_rmssd_ratio"),
        F.when(F.count(hr) >= 2, F.max(hr) - F.min(hr)).alias("stage_hr_range"),
        F.when((F.count(rm) >= 2) & (F.avg(rm) > 0), F.stddev_pop(rm) / F.avg(rm)).alias("stage_rmssd_cv"),
    )


_PASSED = "_from ARRAY<BIGINT>, _cuts ARRAY<INT>, _rest ARRAY<BIGINT>, _total BIGINT"


def _passes(us: np.ndarray, win: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """What a stretch of beats does to the time that is open when it begins.

    ``upto[e]`` is the time to the end of beat e; the first cut falls on the first beat where it reaches what is missing. For every beat on which that
    can be: the cuts after it and the time open at the end.
    """
    upto = np.cumsum(us)
    n = len(us)
    start = np.r_[0, upto]  # time before beat s
    ends = np.searchsorted(upto, start + win, "left")  # the beat that closes a window begun at s; n: none does
    cuts, rest = np.zeros(n + 1, "int32"), np.zeros(n + 1, "int64")
    for s in range(n - 1, -1, -1):
        if ends[s] < n:
            cuts[s], rest[s] = cuts[ends[s] + 1] + 1, rest[ends[s] + 1]
        else:
            rest[s] = upto[-1] - start[s]
    last = min(int(np.searchsorted(upto, win, "left")) + 1, n)
    return upto[:last], cuts[1 : last + 1], rest[1 : last + 1], int(upto[-1]) if n else 0


def _follow(win: int, n_keys: int):
    """Stretches of a stage in order, one row each: the time open and the windows closed before each of them."""

    def run(batches):
        key, open_, done = None, 0, 0
        for pdf in batches:
            before = []
            for row in pdf.itertuples(index=False):
                here = row[:n_keys]
                if here != key:
                    key, open_, done = here, 0, 0
                before.append((open_, done))
                upto, cuts, rest, total = row[-4:]
                e = int(np.searchsorted(upto, win - open_, "left"))
                open_, done = (int(rest[e]), done + 1 + int(cuts[e])) if e < len(upto) else (open_ + int(total), done)
            out = pdf.iloc[:, : n_keys + 1].copy()
            out["_open"], out["_done"] = [b[0] for b in before], [b[1] for b in before]
            yield out

    return run


def windows(rr: DataFrame, keys: Sequence[str], win_s: float = 120.0, min_beats: int = 30, stretch_s: float = 3600.0) -> DataFrame:
    """Consecutive windows of about ``win_s`` of RR time inside each stage (the sum restarts after each window).

    Beats are cut in stretches of ``stretch_s``, each of which tells what it does to any time that is open when it begins. Only these rows, one a
    stretch, are followed in order; then every stretch numbers its own beats. Times are whole microseconds, so the cut does not depend on the stretches.
    """
    one = [*keys, "stage"]
    at = [*one, "_s"]
    win = int(round(win_s * 1e6))
    us = F.round(F.col("rr_ms") * 1000).cast("long")
    beats = rr.withColumn("_s", F.floor(F.col("t") / stretch_s)).groupBy(*at).agg(F.array_sort(F.collect_list(F.struct("t", "rr_ms", us.alias("us")))).alias("_a"))
    beats = cut_lineage(beats)

    @F.pandas_udf(_PASSED)
    def passes(a: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_passes(np.asarray(x, "int64"), win) for x in a], columns=["_from", "_cuts", "_rest", "_total"])

    told = beats.select(*at, passes(F.col("_a.us")).alias("_p")).select(*at, "_p.*")
    schema = T.StructType([*told.select(*at).schema, T.StructField("_open", T.LongType()), T.StructField("_done", T.LongType())])
    ordered = told.repartition(*one).sortWithinPartitions(*at)
    before = ordered.mapInPandas(_follow(win, len(one)), schema)
    before = before.select(*[F.col(c).alias(f"_b_{c}") for c in at], "_open", "_done")

    @F.pandas_udf("array<int>")
    def cut(a: pd.Series, open_: pd.Series, done: pd.Series) -> pd.Series:
        out = []
        for us_, total, k in zip(a, open_, done):
            ids = []
            for v in us_:
                ids.append(k)
                total += v
                if total >= win:
                    k, total = k + 1, 0
            out.append(ids)
        return pd.Series(out)

    same = [F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in at]
    z = beats.join(before, same).withColumn("_w", cut(F.col("_a.us"), "_open", "_done")).select(*one, F.explode(F.arrays_zip("_a", "_w")).alias("_z"))
    beats = z.select(*one, F.col("_z._w").alias("window_index"), "_z._a.t", "_z._a.rr_ms")
    w = Window.partitionBy(*one, "window_index").orderBy("t")
    d = beats.withColumn("_d", F.col("rr_ms") - F.lag("rr_ms").over(w))
    agg = d.groupBy(*one, "window_index").agg(
        F.min("t").alias("start_s"), (F.sum("rr_ms") / 1000).alias("dur_s"), F.count(F.lit(1)).alias("n_beats"), F.avg("rr_ms").alias("mean_nn"),
        F.stddev_samp("rr_ms").alias("sdnn"), F.sqrt(F.avg(F.col("_d") * F.col("_d"))).alias("rmssd"), F.stddev_samp("_d").alias("sdsd"),
        (100.0 * F.sum((F.abs("_d") > 50).cast("int")) / F.count("_d")).alias("pnn50"),
    ).where(F.col("n_beats") >= min_beats)
    return agg.withColumn("hr_mean", 60000.0 / F.col("mean_nn")).withColumn("cvnn", F.col("sdnn") / F.col("mean_nn"))
