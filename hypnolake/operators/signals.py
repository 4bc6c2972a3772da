"""Per-epoch sample kernels: batches of epochs become 2-D arrays, one FFT per batch.

A job's unit of work is one epoch row (samples ARRAY<FLOAT>), never a recording. Filters see a
little of the neighbouring epochs through ``with_context``, so epoch seams do not ring.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import Axis, shift
from .ranks import cumulate, pick_quantiles

# Fixed EEG bands (name, low, high) in Hz and the total band.
BANDS = (("delta", 0.5, 4.0), ("theta", 4.0, 8.0), ("alpha", 8.0, 12.0), ("sigma", 12.0, 16.0), ("beta", 16.0, 30.0))
TOTAL = (0.5, 30.0)
BAND_NAMES = [b[0] for b in BANDS]


SAMPLES_AT_ONCE = 1 << 18  # of one stack: what a task holds of spectra and the like, whatever the batch


def stacks(samples: pd.Series, *extra: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray, tuple]]:
    """Rows of equal length and equal extra values as (positions, 2-D float array, extras), at most ``SAMPLES_AT_ONCE`` a stack."""
    keys = pd.DataFrame({"n": [0 if s is None else len(s) for s in samples], **{i: e.to_numpy() for i, e in enumerate(extra)}})
    for key, idx in keys.groupby(list(keys.columns), dropna=False).indices.items():
        step = max(1, SAMPLES_AT_ONCE // max(int(key[0]), 1))
        for at in range(0, len(idx) if key[0] else 0, step):
            part = idx[at : at + step]
            rows = np.stack([np.asarray(samples.iloc[i], dtype=float) for i in part])
            yield part, np.where(np.isfinite(rows), rows, 0.0), key[1:]


def analytic(x: np.ndarray, fs: float, lo: float, hi: float) -> np.ndarray:
    """Zero-phase band-passed analytic signal of each row, by masking one-sided FFT bins."""
    n = x.shape[1]
    spec = np.fft.fft(x - x.mean(axis=1, keepdims=True), axis=1)
    freq = np.fft.fftfreq(n, 1 / fs)
    return np.fft.ifft(spec * (2.0 * ((freq >= lo) & (freq <= hi))), axis=1)


def smoothed(x: np.ndarray, width: int) -> np.ndarray:
    """Centred moving average of each row."""
    if width <= 1:
        return x
    kernel = np.ones(width) / width
    return np.apply_along_axis(lambda r: np.convolve(r, kernel, mode="same"), 1, x)


def welch_psd(x: np.ndarray, fs: float) -> tuple[np.ndarray, np.ndarray]:
    """Welch density of each row: periodic Hann, half overlap, constant detrend, segments of max(2 s, 256)."""
    n = x.shape[1]
    seg = int(min(n, max(fs * 2, 256)))
    starts = range(0, n - seg + 1, max(seg - seg // 2, 1))
    win = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(seg) / seg)
    acc = 0.0
    for a in starts:
        part = x[:, a : a + seg]
        acc = acc + np.abs(np.fft.rfft((part - part.mean(axis=1, keepdims=True)) * win, axis=1)) ** 2
    psd = acc / len(starts) / (fs * (win**2).sum())
    psd[:, 1 : (-1 if seg % 2 == 0 else None)] *= 2
    return np.fft.rfftfreq(seg, 1 / fs), psd


def trapezoid(psd: np.ndarray, freq: np.ndarray, lo: float, hi: float) -> np.ndarray:
    m = (freq >= lo) & (freq < hi)
    return np.trapezoid(psd[:, m], freq[m], axis=1) if m.any() else np.zeros(len(psd))


def with_context(epochs: DataFrame, ax: Axis, pad_s: float) -> DataFrame:
    """``padded`` samples with the tail of the previous and the head of the next epoch, and ``pad`` = its left length."""
    n = F.greatest((F.col("fs") * pad_s).cast("int"), F.lit(1))
    tail = F.when(F.size("samples") > n, F.slice("samples", -n, n)).otherwise(F.col("samples"))
    e = epochs.withColumn("_tail", tail).withColumn("_head", F.slice("samples", 1, n))
    e = shift(e, ax, ["_tail"], "_p")
    e = shift(e, ax, ["_head"], "_n", back=False)
    none = F.array().cast("array<float>")
    left, right = F.coalesce("_p_tail", none), F.coalesce("_n_head", none)
    return e.withColumn("pad", F.size(left)).withColumn("padded", F.concat(left, "samples", right)).drop("_tail", "_head", "_p_tail", "_n_head")


def core(row: np.ndarray, pad: int, n: int) -> np.ndarray:
    return row[pad : pad + n]


def envelopes(fs: pd.Series, padded: pd.Series, pad: pd.Series, n: pd.Series, band: tuple[float, float], smooth_s: float):
    """(position, envelope of the core samples, analytic core) per row."""
    for idx, x, (rate, left, size) in stacks(padded, fs, pad, n):
        z = analytic(x, rate, *band)
        env = smoothed(np.abs(z), max(1, int(round(smooth_s * rate))))
        for i, e, c in zip(idx, env, z):
            yield i, core(e, int(left), int(size)), core(c, int(left), int(size))


def log_histogram(band: tuple[float, float], resolution: int = 1000):
    """pandas UDF: |band-passed samples| of one epoch as cell numbers rint(ln|x| * resolution), one a sample."""

    @F.pandas_udf("array<int>")
    def hist(fs: pd.Series, padded: pd.Series, pad: pd.Series, n: pd.Series) -> pd.Series:
        out = [np.zeros(0, "int32")] * len(fs)
        for i, _, z in envelopes(fs, padded, pad, n, band, 0.0):
            v = np.abs(z.real)
            out[i] = np.rint(np.log(v[v > 0]) * resolution).astype("int32")
        return pd.Series(out)

    return hist


def amplitude_quantile(context: DataFrame, keys: Sequence[str], band: tuple[float, float], p: float, out: str, resolution: int = 1000) -> DataFrame:
    """Quantile of |band-passed signal| per recording from per-epoch log histograms.

    Relative precision 1/resolution; only histogram cells are shuffled, never samples.
    """
    h = context.select(*keys, F.explode(log_histogram(band, resolution)("fs", "padded", "pad", F.size("samples"))).alias("key"))
    cells = h.groupBy(*keys, "key").agg(F.count(F.lit(1)).alias("n"))  # counted before the exchange
    q = pick_quantiles(cumulate(cells, keys, "key", ("n",), bounded=True), keys, "key", {"_k": p})  # cells bounded by the log range
    return q.select(*keys, F.exp(F.col("_k") / resolution).alias(out))


def band_peaks(band: tuple[float, float], distance_s: float, signed: bool = False):
    """pandas UDF: local maxima of |band-passed| above ``height``, strongest first, ``distance_s`` apart.

    ``signed`` looks at the band-passed signal itself, so that a wave counts once and not once per half. Times are seconds inside the epoch; suppression sees the padding, so seams count once.
    """

    @F.pandas_udf("array<double>")
    def peaks(fs: pd.Series, padded: pd.Series, pad: pd.Series, n: pd.Series, height: pd.Series) -> pd.Series:
        out = [[] for _ in range(len(fs))]
        for idx, x, (rate, left, size) in stacks(padded, fs, pad, n):
            wave = analytic(x, rate, *band).real
            for i, row in zip(idx, wave if signed else np.abs(wave)):
                at = strongest_peaks(row, height.iloc[i], int(distance_s * rate))
                out[i] = [float(k - left) / rate for k in at if left <= k < left + size]
        return pd.Series(out)

    return peaks


def strongest_peaks(x: np.ndarray, height: float, distance: int) -> np.ndarray:
    """Indices of local maxima at or above ``height``, keeping the higher of two closer than ``distance``."""
    inner = (x[1:-1] > x[:-2]) & (x[1:-1] >= x[2:]) & (x[1:-1] >= height)
    cand = np.flatnonzero(inner) + 1
    free = np.ones(len(x), bool)
    kept = []
    for k in cand[np.argsort(-x[cand], kind="stable")]:
        if free[k]:
            kept.append(k)
            free[max(0, k - distance + 1) : k + distance] = False
    return np.sort(np.array(kept, dtype=int))


def sample_entropy(x: np.ndarray, m: int = 2, r: float = 0.2, block: int = 512) -> float | None:
    """Richman-Moorman: both template lengths share the same starting points. Compared in blocks of rows, so memory is linear."""
    x = np.asarray(x, float)
    n, sd = len(x) - m, np.std(x)
    if n < 2 or sd <= 0:
        return None
    tol = r * sd
    a = b = 0
    for s in range(0, n, block):
        e = min(s + block, n)
        hits = np.abs(x[s:e, None] - x[None, :n]) <= tol
        for k in range(1, m):
            hits &= np.abs(x[s + k : e + k, None] - x[None, k : k + n]) <= tol
        b += int(hits.sum()) - (e - s)
        a += int((hits & (np.abs(x[s + m : e + m, None] - x[None, m : m + n]) <= tol)).sum()) - (e - s)
    return float(-np.log(a / b)) if a > 0 and b > 0 else None


def permutation_entropy(x: np.ndarray, order: int = 3) -> float | None:
    """Shannon entropy of ordinal patterns, scaled by log2(order!)."""
    n = len(x) - order + 1
    if n < 2:
        return None
    ranks = np.argsort(np.stack([x[i : i + n] for i in range(order)], axis=1), axis=1, kind="stable")
    codes = ranks @ (order ** np.arange(order))
    p = np.unique(codes, return_counts=True)[1] / n
    return float(-(p * np.log2(p)).sum() / np.log2(np.prod(np.arange(1, order + 1))))


def thinned(x: np.ndarray, limit: int) -> np.ndarray:
    """Every k-th sample so that at most ``limit`` remain."""
    return x[:: -(-len(x) // limit)] if len(x) > limit else x


def resample_epochs(epochs: DataFrame, target_fs: float, roles: Sequence[str] | None = None, min_fs: float = 0.0) -> DataFrame:
    """FFT resampling of epoch samples to a common rate; other roles and slow channels stay untouched."""

    @F.pandas_udf("array<float>")
    def change(samples: pd.Series, fs: pd.Series) -> pd.Series:
        out = [None] * len(samples)
        for idx, x, (rate,) in stacks(samples, fs):
            n = x.shape[1]
            m = int(round(n * target_fs / rate))
            spec = np.fft.rfft(x, axis=1)[:, : m // 2 + 1]
            y = np.fft.irfft(spec, m, axis=1) * (m / n)
            for i, row in zip(idx, y):
                out[i] = row.astype("float32")
        return pd.Series(out)

    todo: Column = (F.col("fs") != target_fs) & (F.col("fs") >= min_fs)
    if roles is not None:
        todo &= F.col("role").isin(*roles)
    return epochs.withColumn("samples", F.when(todo, change("samples", "fs")).otherwise(F.col("samples"))).withColumn(
        "fs", F.when(todo, F.lit(float(target_fs))).otherwise(F.col("fs"))
    )
