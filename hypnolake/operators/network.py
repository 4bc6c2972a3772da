"""Multi-channel operators: connectivity, microstates, time-delay stability, directed coupling."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..vocab import EPOCH_S
from ..session import cut_lineage
from .ordered import Axis, forward_fill, running_sum, shift, with_axis
from .signals import BANDS, analytic, core, envelopes, stacks

EPOCHS_AT_ONCE = 64  # montages whose cross-spectra a task holds
STAGE_POOLS = {"nrem": (1, 2, 3), "rem": (4,)}
REGION_PAIRS = {"interhemi": (("f3", "f4"), ("c3", "c4"), ("o1", "o2")), "antpost": (("f3", "o1"), ("f4", "o2"))}


def montage(epochs: DataFrame, keys: Sequence[str], samples: str = "samples") -> DataFrame:
    """One row per epoch with its channels in name order (a montage is a handful of channels)."""
    ch = F.array_sort(F.collect_list(F.struct("channel", F.col(samples).alias("x"))))
    return epochs.groupBy(*keys, "epoch", "stage", "fs").agg(ch.alias("_c")).select(
        *keys, "epoch", "stage", "fs", F.col("_c.channel").alias("channels"), F.col("_c.x").alias("x")
    )


def referenced(x) -> np.ndarray:
    """Channels x samples, common-average referenced, shortest channel bounds the length."""
    n = min(len(c) for c in x)
    m = np.stack([np.asarray(c[:n], float) for c in x])
    m = np.where(np.isfinite(m), m, 0.0)
    return m - m.mean(axis=0)


# ------------------------------------------------------------------ connectivity
def cross_spectra(montages: DataFrame, keys: Sequence[str], seg_s: float = 2.0, overlap: float = 0.5) -> DataFrame:
    """Per epoch, pair and band bin: summed cross-spectrum terms over Hann segments inside the epoch.

    Epochs are read ``EPOCHS_AT_ONCE`` at a time, so a task holds no more terms than theirs.
    """
    own = [*keys, "stage"]
    terms = ("n", "re", "im", "aim", "xx", "yy")
    fields = [T.StructField(c, T.StringType()) for c in "ij"] + [T.StructField("hz", T.DoubleType()), T.StructField("n", T.IntegerType())]
    fields += [T.StructField(c, T.DoubleType()) for c in terms[1:]]

    def of_epoch(data, rate: float) -> tuple | None:
        """Pairs (a, b), bins of the bands and the terms by (pair, bin)."""
        m = referenced(data)
        seg = int(round(seg_s * rate))
        if len(m) < 2 or seg < 8 or m.shape[1] < seg or rate < 2 * BANDS[-1][2]:
            return None
        hop = max(1, int(round(seg * (1 - overlap))))
        starts = np.arange(0, m.shape[1] - seg + 1, hop)
        cut = m[:, starts[:, None] + np.arange(seg)]
        spec = np.fft.rfft((cut - cut.mean(axis=2, keepdims=True)) * np.hanning(seg), axis=2)
        freq = np.fft.rfftfreq(seg, 1 / rate)
        use = np.flatnonzero((freq >= BANDS[0][1]) & (freq < BANDS[-1][2]))
        power = (np.abs(spec) ** 2).sum(axis=1)
        a, b = np.triu_indices(len(m), 1)
        out = np.empty((5, len(a), len(use)))
        for k, (p, q) in enumerate(zip(a, b)):
            c = spec[p] * np.conj(spec[q])
            out[:, k] = [x[use] for x in (c.real.sum(axis=0), c.imag.sum(axis=0), np.abs(c.imag).sum(axis=0), power[p], power[q])]
        return a, b, freq[use], len(starts), out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, EPOCHS_AT_ONCE):
                part = batch.slice(at, EPOCHS_AT_ONCE)
                names, data, rates = (part.column(c).to_pandas() for c in ("channels", "x", "fs"))
                rows, i, j, columns = [], [], [], [[] for _ in range(7)]
                for k in range(part.num_rows):
                    found = of_epoch(data[k], rates[k])
                    if found is None:
                        continue
                    a, b, hz, n, out = found
                    size = len(a) * len(hz)
                    rows.append(np.full(size, k))
                    i.append(np.repeat(np.asarray(names[k], object)[a], len(hz)))
                    j.append(np.repeat(np.asarray(names[k], object)[b], len(hz)))
                    for column, x in zip(columns, (np.tile(hz, len(a)), np.full(size, n, "int32"), *out.reshape(5, size))):
                        column.append(x)
                if rows:
                    mine = part.select(own).take(pa.array(np.concatenate(rows)))
                    pairs = [pa.array(np.concatenate(c), pa.string()) for c in (i, j)]
                    yield pa.RecordBatch.from_arrays([*mine.columns, *pairs, *[pa.array(np.concatenate(c)) for c in columns]], names=[*own, "i", "j", "hz", *terms])

    table = montages.select(*own, "channels", "x", "fs")
    return table.mapInArrow(run, T.StructType([*table.select(*own).schema, *fields]))


def connectivity(spectra: DataFrame, keys: Sequence[str], min_segments: int = 20) -> DataFrame:
    """Magnitude-squared coherence and wPLI per pool, pair and band."""
    pool = F.when(F.col("stage").isin(*STAGE_POOLS["nrem"]), "nrem").when(F.col("stage").isin(*STAGE_POOLS["rem"]), "rem")
    s = spectra.withColumn("pool", pool).where("pool IS NOT NULL").groupBy(*keys, "pool", "i", "j", "hz").agg(
        *[F.sum(c).alias(c) for c in ("n", "re", "im", "aim", "xx", "yy")]
    ).where(F.col("n") >= min_segments)
    band = F.when(F.col("hz") < BANDS[0][2], BANDS[0][0])
    for name, _, hi in BANDS[1:]:
        band = band.when(F.col("hz") < hi, name)
    msc = F.when(F.col("xx") * F.col("yy") > 0, (F.col("re") ** 2 + F.col("im") ** 2) / (F.col("xx") * F.col("yy")))
    wpli = F.when(F.col("aim") > 0, F.abs("im") / F.col("aim"))
    return s.groupBy(*keys, "pool", "i", "j", band.alias("band")).agg(F.avg(msc).alias("coh"), F.avg(wpli).alias("wpli"))


def connectivity_summary(conn: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Means over pairs per band, inter-hemispheric alpha and antero-posterior theta coherence."""
    def among(pairs, band, c):
        hit = None
        for a, b in pairs:
            p = (F.lower("i").contains(a) & F.lower("j").contains(b)) | (F.lower("i").contains(b) & F.lower("j").contains(a))
            hit = p if hit is None else hit | p
        return F.avg(F.when((F.col("band") == band) & hit, F.col(c)))

    cols = [F.avg(F.when(F.col("band") == n, F.col(c))).alias(f"{c}_{n}") for n, _, _ in BANDS for c in ("coh", "wpli")]
    return conn.groupBy(*keys, "pool").agg(
        *cols, among(REGION_PAIRS["interhemi"], "alpha", "coh").alias("coh_interhemi_alpha"), among(REGION_PAIRS["antpost"], "theta", "coh").alias("coh_antpost_theta")
    )


# ------------------------------------------------------------------ microstates
def _cubes(x: pd.Series, fs: pd.Series, band: tuple[float, float]):
    """Montages of one shape and rate at a time: (positions, rate, band-passed average-referenced samples [rows, channels, n])."""
    shape = pd.DataFrame({"c": [len(m) for m in x], "n": [min(map(len, m), default=0) for m in x], "fs": fs.to_numpy()})
    for (c, n, rate), at in shape.groupby(["c", "n", "fs"]).indices.items():
        if c and n > 2:
            cube = np.array([[lead[:n] for lead in x.iloc[i]] for i in at], float)
            cube[~np.isfinite(cube)] = 0.0
            cube -= cube.mean(axis=1, keepdims=True)
            yield at, rate, analytic(cube.reshape(-1, n), rate, *band).real.reshape(cube.shape)


def _topographies(cube: np.ndarray) -> np.ndarray:
    """Each sample's channel values, centred and of unit length."""
    v = cube - cube.mean(axis=1, keepdims=True)
    return v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-12)


def common_leads(montages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Montages with the channels that every epoch of the recording has."""
    keys = list(keys)
    held = montages.select(*keys, F.explode("channels").alias("_c")).groupBy(*keys, "_c").agg(F.count(F.lit(1)).alias("_k"))
    size = montages.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    common = held.join(size, keys).where("_k = _n").groupBy(*keys).agg(F.collect_list("_c").alias("_common"))  # a montage's names
    lead = F.filter(F.arrays_zip("channels", "x"), lambda z: F.array_contains("_common", z.channels))
    return montages.join(common, keys).withColumn("_l", lead).select(
        *[c for c in montages.columns if c not in ("channels", "x")], F.col("_l.channels").alias("channels"), F.col("_l.x").alias("x")
    )


def gfp_peaks(montages: DataFrame, keys: Sequence[str], band: tuple[float, float] = (2.0, 20.0)) -> DataFrame:
    """Unit-length topographies where the global field power stops rising: keys, epoch, pos, gfp, map."""

    @F.pandas_udf("pos array<int>, gfp array<double>, flat array<double>")
    def tops(x: pd.Series, fs: pd.Series) -> pd.DataFrame:
        found = {c: [[] for _ in range(len(x))] for c in ("pos", "gfp", "flat")}
        for at, _, cube in _cubes(x, fs, band):
            power = cube.std(axis=1)
            rising = np.diff(power, axis=1) > 0
            row, k = np.nonzero(rising[:, :-1] & ~rising[:, 1:])
            k += 1
            maps = _topographies(cube[row, :, k][:, :, None])[:, :, 0]
            cuts = np.searchsorted(row, np.arange(1, len(at)))
            for i, pos, g, m in zip(at, np.split(k, cuts), np.split(power[row, k], cuts), np.split(maps, cuts)):
                found["pos"][i], found["gfp"][i], found["flat"][i] = pos, g, m.ravel()
        return pd.DataFrame(found)

    got = montages.select(*keys, "epoch", F.size("x").alias("_w"), tops("x", "fs").alias("_t"))
    rows = got.select(*keys, "epoch", "_w", "_t.flat", F.posexplode(F.arrays_zip("_t.pos", "_t.gfp")).alias("_i", "_p"))
    return rows.select(*keys, "epoch", "_p.pos", "_p.gfp", F.slice("flat", F.col("_i") * F.col("_w") + 1, F.col("_w")).alias("map"))


def _dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def fit_microstates(peaks: DataFrame, keys: Sequence[str], k: int = 4, min_peaks: int = 100, rounds: int = 12) -> DataFrame:
    """State maps per recording from all peaks: maps, gev.

    A state's map is the main axis of its members, whatever their polarity. Seeds are the peaks of least hash. A
    round sums outer products by (recording, state), so only channels x channels numbers per state leave the map side.
    """
    keys = list(keys)
    enough = peaks.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_peaks)
    rows = cut_lineage(peaks.join(enough.drop("_n"), keys, "left_semi"))
    width = rows.agg(F.max(F.size("map"))).first()[0] or 0
    maps = rows.groupBy(*keys).agg(F.array(*[F.min_by("map", F.xxhash64(F.lit(s), "epoch", "pos")) for s in range(k)]).alias("maps"))
    maps = cut_lineage(maps)

    @F.pandas_udf("array<double>")
    def main_axis(products: pd.Series) -> pd.Series:
        out = []
        for v in products:
            full = np.array([[np.nan if b is None else b for b in row] for row in v], float)
            n = int(np.isfinite(np.diag(full)).sum())
            out.append(np.linalg.eigh(full[:n, :n])[1][:, -1])
        return pd.Series(out)

    def nearest(maps: DataFrame) -> DataFrame:
        fit = F.transform("maps", lambda m: F.abs(_dot("map", m)))
        return rows.join(maps, keys).withColumn("_f", fit).withColumn("_best", F.array_max("_f")).withColumn("state", F.array_position("_f", F.col("_best")).cast("int") - 1)

    square = F.array(*[F.array(*[F.sum(F.get("map", F.lit(i)) * F.get("map", F.lit(j))) for j in range(width)]) for i in range(width)])
    for _ in range(rounds if width else 0):
        axes = nearest(maps).groupBy(*keys, "state").agg(square.alias("_q")).select(*keys, "state", main_axis("_q").alias("_a"))
        listed = axes.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("state", "_a"))).alias("_m"))  # k states
        moved = maps.join(listed, keys).select(*keys, "maps", F.transform("maps", lambda m, s: F.coalesce(F.element_at("_m", s.cast("int")), m)).alias("_new"))
        moved = cut_lineage(moved)
        same = F.array_min(F.zip_with("maps", "_new", lambda a, b: F.abs(_dot(a, b))))
        settled = moved.agg(F.coalesce(F.min(same), F.lit(1.0))).first()[0] > 1 - 1e-9
        maps = moved.select(*keys, F.col("_new").alias("maps"))
        if settled:
            break
    power = F.col("gfp") * F.col("gfp")
    gev = nearest(maps).groupBy(*keys).agg((F.sum(power * F.col("_best") * F.col("_best")) / F.when(F.sum(power) > 0, F.sum(power))).alias("gev"))
    return maps.join(gev, keys)


def state_runs(montages: DataFrame, maps: DataFrame, keys: Sequence[str], band: tuple[float, float], min_dur_ms: float, within: Axis | None = None) -> DataFrame:
    """Runs of one microstate: keys, state, n (samples), fresh (no neighbour before), fs. Runs go on across adjacent epochs.

    Runs shorter than ``min_dur_ms`` count for the state before them.
    """

    @F.pandas_udf("state array<int>, n array<int>")
    def label(x: pd.Series, fs: pd.Series, m: pd.Series) -> pd.DataFrame:
        found = {"state": [[] for _ in range(len(x))], "n": [[] for _ in range(len(x))]}
        for at, _, cube in _cubes(x, fs, band):
            states = np.array([[list(v) for v in m.iloc[i]] for i in at], float)
            own = np.abs(states @ _topographies(cube)).argmax(axis=1)
            for i, row in zip(at, own):
                ends = np.append(np.flatnonzero(np.diff(row)) + 1, len(row))
                found["state"][i], found["n"][i] = row[ends - 1], np.diff(ends, prepend=0)
        return pd.DataFrame(found)

    keys = list(keys)
    got = montages.join(maps, keys).select(*keys, "epoch", "fs", label("x", "fs", "maps").alias("_l"))
    pieces = got.select(*keys, "epoch", "fs", F.posexplode(F.arrays_zip("_l.state", "_l.n")).alias("piece", "_p")).select(*keys, "epoch", "fs", "piece", "_p.*")
    rows, ax = with_axis(pieces, keys, ("epoch", "piece"), within=within)
    s = shift(rows, ax, ["state", "epoch"], "_p_")
    fresh = F.col("_p_epoch").isNull() | (F.col("epoch") > F.col("_p_epoch") + 1)
    s = s.withColumn("_fresh", fresh.cast("long")).withColumn("_cut", (fresh | (F.col("state") != F.col("_p_state"))).cast("long"))
    whole = running_sum(s, ax, {"run": F.col("_cut")}).groupBy(*keys, "run").agg(
        F.max("state").alias("state"), F.sum("n").alias("n"), F.max("_fresh").alias("fresh"), F.max("fs").alias("fs")
    )
    keep = (F.col("fresh") == 1) | (F.col("n") >= F.round(F.col("fs") * min_dur_ms / 1000))
    rows, ax = with_axis(whole.withColumn("_own", F.when(keep, F.col("state"))), keys, ("run",), within=within)
    return forward_fill(rows, ax, "_own", "_state").drop("state").withColumnRenamed("_state", "state")


def microstates(montages: DataFrame, keys: Sequence[str], band: tuple[float, float] = (2.0, 20.0), min_dur_ms: float = 30.0, within: Axis | None = None, **fit_kw) -> DataFrame:
    """GEV, GFP peak rate and mean, mean duration, transition rate, coverage entropy over NREM epochs."""
    keys = list(keys)
    nrem = common_leads(montages.where(F.col("stage").isin(1, 2, 3)), keys)
    peaks = gfp_peaks(nrem, keys, band)
    maps = fit_microstates(peaks, keys, **fit_kw)

    @F.pandas_udf("gfp double, corr double")
    def sums(x: pd.Series, fs: pd.Series, m: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(x), 2))
        for at, _, cube in _cubes(x, fs, band):
            states = np.array([[list(v) for v in m.iloc[i]] for i in at], float)
            out[at, 0] = cube.std(axis=1).sum(axis=1)
            out[at, 1] = np.abs(states @ _topographies(cube)).max(axis=1).sum(axis=1)
        return pd.DataFrame(out, columns=["gfp", "corr"])

    field = nrem.join(maps, keys).withColumn("_s", sums("x", "fs", "maps")).groupBy(*keys).agg(
        F.sum("_s.gfp").alias("_g"), F.sum("_s.corr").alias("_c"), F.max("gev").alias("ms_gev")
    )
    runs_, ax = with_axis(state_runs(nrem, maps, keys, band, min_dur_ms, within), keys, ("run",), within=within)
    s = shift(runs_, ax, ["state"], "_p_")
    turned = ((F.col("fresh") == 0) & (F.col("state") != F.col("_p_state"))).cast("long")
    agg = s.groupBy(*keys).agg(
        F.sum("n").alias("_n"), F.max("fs").alias("_fs"), F.sum(turned).alias("_t"), F.sum("fresh").alias("_b"),
        *[F.sum(F.when(F.col("state") == i, F.col("n")).otherwise(0)).alias(f"_k{i}") for i in range(4)],
    )
    rate = peaks.groupBy(*keys).agg(F.count(F.lit(1)).alias("_peaks"))
    dur = F.col("_n") / F.col("_fs")
    p = [F.col(f"_k{i}") / F.col("_n") for i in range(4)]
    ent = sum(F.when(q > 0, -q * F.log(q)).otherwise(0.0) for q in p)
    return agg.join(field, keys).join(rate, keys).select(
        *keys, "ms_gev", (F.col("_peaks") / dur).alias("ms_gfp_peak_rate"), (F.col("_g") / F.col("_n")).alias("ms_gfp_mean"),
        (1000.0 * dur / (F.col("_t") + F.col("_b"))).alias("ms_mean_dur_ms"), (F.col("_t") / dur).alias("ms_trans_rate"),
        ent.alias("ms_coverage_entropy"), F.exp(ent).alias("ms_n_eff"), (F.col("_c") / F.col("_n")).alias("ms_mean_corr"),
    )


# ------------------------------------------------------------------ 1 Hz node signals
def node_seconds(context: DataFrame, keys: Sequence[str], epoch_s: int = int(EPOCH_S)) -> DataFrame:
    """1 Hz node values per epoch: band envelopes of EEG rows, rectified EMG/EOG, level of SpO2.

    Each input row is one channel epoch with context and a ``role``; output: keys, sec, node, value.
    """
    seconds = lambda v, rate: [float(s.mean()) for s in np.array_split(v[: int(rate * epoch_s)], max(1, int(len(v) / rate)))]

    @F.pandas_udf("array<struct<node:string,v:array<double>>>")
    def nodes(channel: pd.Series, role: pd.Series, fs: pd.Series, padded: pd.Series, pad: pd.Series, n: pd.Series) -> pd.Series:
        out = [[] for _ in range(len(fs))]
        for name, lo, hi in BANDS:
            for i, e, _ in envelopes(fs, padded, pad, n, (lo, hi), 0.0):
                if role.iloc[i] == "eeg" and fs.iloc[i] >= 2 * hi:
                    out[i].append({"node": f"{channel.iloc[i]}.{name}", "v": seconds(e, fs.iloc[i])})
        for idx, x, (rate, left, size) in stacks(padded, fs, pad, n):
            for i, row in zip(idx, x):
                kind, own = role.iloc[i], core(row, int(left), int(size))
                if kind in ("chin_emg", "limb_emg", "eog"):
                    own = np.abs(own - own.mean())
                elif kind not in ("spo2",):
                    continue
                out[i].append({"node": kind, "v": seconds(own, rate)})
        return pd.Series(out)

    n = F.explode(nodes("channel", "role", "fs", "padded", "pad", F.size("samples"))).alias("_n")
    rows = context.select(*keys, "epoch", "stage", n).select(*keys, "epoch", "stage", "_n.node", F.posexplode("_n.v").alias("_i", "value"))
    return rows.select(*keys, (F.col("epoch") * epoch_s + F.col("_i")).cast("long").alias("sec"), "stage", "node", "value")


def event_seconds(times: DataFrame, ax: Axis, node: str, per_minute: bool = True) -> DataFrame:
    """Beats or breaths to a 1 Hz rate: each second holds the rate of the interval that covers it."""
    tx = Axis(ax.keys, ("t",), ax.chunked)
    s = shift(times, tx, ["t"], "_n_", back=False).where(F.col("_n_t").isNotNull())
    gap = F.col("_n_t") - F.col("t")
    rate = 60.0 / gap if per_minute else gap
    secs = F.explode(F.sequence(F.ceil("t").cast("long"), (F.ceil("_n_t") - 1).cast("long")))
    ok = s.where((gap > 0) & (gap < 15) & (F.ceil("t") <= F.ceil("_n_t") - 1))
    return ok.select(*ax.keys, secs.alias("sec"), "stage", F.lit(node).alias("node"), rate.alias("value"))


# ------------------------------------------------------------------ time-delay stability
def window_lags(windows: DataFrame, keys: Sequence[str], tau_max: int = 10) -> DataFrame:
    """Lag of the largest |cross-correlation| for each node pair of a window.

    Input rows: keys, win, stage, node, values (one array per node and window). NULL lag for flat nodes.
    """
    @F.pandas_udf("array<int>")
    def lags(x: pd.Series) -> pd.Series:
        out = []
        for data in x:
            n = min(map(len, data))
            m = np.array([d[:n] for d in data], float)
            m -= m.mean(axis=1, keepdims=True)
            sd = m.std(axis=1, keepdims=True)
            flat = ~(sd[:, 0] >= 1e-9)
            spec = np.fft.rfft(np.where(sd >= 1e-9, m / np.maximum(sd, 1e-9), 0.0), 2 * n, axis=1)
            a, b = np.triu_indices(len(m), 1)
            circle = np.fft.irfft(spec[a].conj() * spec[b], 2 * n, axis=1)  # at t: sum over s of a[s] b[s + t]
            steps = np.arange(-tau_max, tau_max + 1)
            best = steps[np.round(np.abs(circle[:, steps] / (n - np.abs(steps))), 12).argmax(axis=1)]
            out.append([None if gone else int(t) for t, gone in zip(best, flat[a] | flat[b])])
        return pd.Series(out)

    grouped = windows.groupBy(*keys, "win", "stage").agg(F.array_sort(F.collect_list(F.struct("node", "values"))).alias("_a"))
    name, place = F.col("_a.node"), F.sequence(F.lit(0), F.size("_a") - 1)
    pairs = F.flatten(F.transform(place, lambda a: F.transform(F.filter(place, lambda b: b > a), lambda b: F.struct(F.get(name, a).alias("i"), F.get(name, b).alias("j")))))
    tied = F.explode(F.arrays_zip(pairs.alias("p"), lags(F.col("_a.values")).alias("tau"))).alias("_p")
    rows = grouped.where(F.size("_a") > 1).select(*keys, "win", "stage", tied)
    return rows.select(*keys, "win", "stage", "_p.p.i", "_p.p.j", "_p.tau")


def sliding_windows(seconds: DataFrame, keys: Sequence[str], length: int = 60, step: int = 30) -> DataFrame:
    """Overlapping windows of 1 Hz rows: every second visits length/step windows; the centre gives the stage."""
    k = length // step
    win = F.explode(F.array(*[(F.floor(F.col("sec") / step) - d).cast("long") for d in range(k)]))
    w = seconds.withColumn("win", win).where("win >= 0")
    centre = F.max(F.when(F.col("sec") == F.col("win") * step + length // 2, F.col("stage")))
    agg = w.groupBy(*keys, "node", "win").agg(F.array_sort(F.collect_list(F.struct("sec", "value"))).alias("_a"), centre.alias("stage"))
    return agg.where(F.size("_a") == length).select(*keys, "node", "win", "stage", F.col("_a.value").alias("values"))


def tds_links(lags: DataFrame, keys: Sequence[str], tol: int = 1, min_run: int = 4, within: Axis | None = None) -> DataFrame:
    """Link strength per stage: share of windows inside runs of ``min_run`` windows whose lag moves by ``tol`` at most."""
    one = [*keys, "i", "j"]
    rows, ax = with_axis(lags, one, ("win",), within=within)
    s = shift(rows, ax, ["tau", "win"], "_p_")
    linked = F.coalesce(F.abs(F.col("tau") - F.col("_p_tau")) <= tol, F.lit(False)) & (F.col("win") == F.col("_p_win") + 1)
    r = running_sum(s.withColumn("_cut", (~linked).cast("long")), ax, {"_run": F.col("_cut")})
    size = r.groupBy(*one, "_run").agg(F.count(F.lit(1)).alias("_len"))
    stable = (F.col("_len") >= min_run).cast("double")
    return r.join(size, [*one, "_run"]).groupBy(*one, "stage").agg(F.avg(stable).alias("strength"), F.count(F.lit(1)).alias("n_windows"))


def network_cohort(links: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean link strength over recordings per stage and node pair, with how many recordings hold it."""
    return links.groupBy(*by, "stage", "i", "j").agg(F.avg("strength").alias("mean_strength"), F.count(F.lit(1)).alias("n_recordings"))


def network_contrast(links: DataFrame, label: str = "label") -> DataFrame:
    """Positive minus negative mean strength per stage and pair."""
    at = lambda v: F.avg(F.when(F.col(label) == v, F.col("strength")))
    return links.where(F.col(label).isin(0, 1)).groupBy("stage", "i", "j").agg(at(1).alias("mean_pos"), at(0).alias("mean_neg"), (at(1) - at(0)).alias("delta"))


# ------------------------------------------------------------------ directed coupling
# Fixed value: 5 % Dickey-Fuller critical value for constant plus trend (large samples).
ADF_CRITICAL = -3.41


def _lagged(m: np.ndarray, p: int) -> np.ndarray:
    """Regressors of an order-p autoregression: constant, trend and p lags of every column."""
    t = np.arange(p, len(m))
    lags = np.hstack([m[p - k : len(m) - k] for k in range(1, p + 1)])
    return np.column_stack([np.ones(len(t)), t, lags])


def _residual_variance(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    e = y - x @ beta
    return (e**2).sum(axis=0) / max(len(y) - x.shape[1], 1)


def _adf_t(v: np.ndarray, p: int) -> float:
    """t statistic of the lagged level in the augmented regression with constant and trend."""
    d = np.diff(v)
    n = len(d) - p
    if n <= p + 4:
        return 0.0
    cols = [np.ones(n), np.arange(n), v[p:-1]] + [d[p - k : len(d) - k] for k in range(1, p + 1)]
    x, y = np.column_stack(cols), d[p:]
    inv = np.linalg.pinv(x.T @ x)
    beta = inv @ x.T @ y
    s2 = ((y - x @ beta) ** 2).sum() / (n - x.shape[1])
    se = np.sqrt(max(s2 * inv[2, 2], 1e-300))
    return float(beta[2] / se)


def directed_gain(m: np.ndarray, names: Sequence[str], max_lag: int = 5, min_lag: int = 3) -> list[dict]:
    """log(restricted / full residual variance) for each ordered pair; highest order at which all columns are stationary."""
    sd = m.std(axis=0)
    if not (sd > 0).all():
        return []
    m = (m - m.mean(axis=0)) / sd
    for p in range(max_lag, min_lag - 1, -1):
        if len(m) < p + 5 or any(_adf_t(m[:, c], p) > ADF_CRITICAL for c in range(m.shape[1])):
            continue
        if len(m) - p <= 2 + p * m.shape[1] + 1:
            continue
        full = _residual_variance(m[p:], _lagged(m, p))
        out = []
        for drop in range(m.shape[1]):
            keep = [c for c in range(m.shape[1]) if c != drop]
            part = _residual_variance(m[p:][:, keep], _lagged(m[:, keep], p))
            out += [{"caused": names[c], "causing": names[drop], "g": float(np.log(v / full[c]))} for c, v in zip(keep, part) if v > 0 and full[c] > 0]
        return out
    return []


def directed_coupling(patches: DataFrame, keys: Sequence[str], **kw) -> DataFrame:
    """Duration-weighted G per recording, stage and ordered pair, with the stationary share of time.

    ``patches``: keys, stage, patch, node, values - one array per node and stage run.
    """
    @F.pandas_udf("array<struct<caused:string,causing:string,g:double>>")
    def gain(names: pd.Series, x: pd.Series) -> pd.Series:
        out = []
        for nodes, data in zip(names, x):
            n = min(len(d) for d in data)
            m = np.stack([np.asarray(d[:n], float) for d in data], axis=1)
            out.append(directed_gain(m, list(nodes), **kw) if np.isfinite(m).all() else [])
        return pd.Series(out)

    one = [*keys, "stage"]
    p = patches.groupBy(*one, "patch").agg(F.array_sort(F.collect_list(F.struct("node", "values"))).alias("_a"), F.min(F.size("values")).alias("dur"))
    g = p.withColumn("_g", gain(F.col("_a.node"), F.col("_a.values")))
    total = g.groupBy(*one).agg(F.sum("dur").alias("_total"), F.sum(F.when(F.size("_g") > 0, F.col("dur")).otherwise(0)).alias("_used"))
    pairs = g.select(*one, "dur", F.explode("_g").alias("_g")).select(*one, "dur", "_g.*")
    mean = pairs.groupBy(*one, "caused", "causing").agg((F.sum(F.col("g") * F.col("dur")) / F.sum("dur")).alias("g"))
    return mean.join(total, one).withColumn("stationary_frac", F.col("_used") / F.col("_total")).drop("_total", "_used")


def stage_patches(seconds: DataFrame, keys: Sequence[str], block_s: int = 1, min_len: int = 5, within: Axis | None = None) -> DataFrame:
    """1 Hz node rows to one array per (stage run, node), block-averaged to ``block_s`` seconds."""
    per = seconds.groupBy(*keys, "sec").agg(F.max("stage").alias("stage"))
    st, ax = with_axis(per, keys, ("sec",), within=within)
    s = shift(st, ax, ["stage", "sec"], "_p_")
    same = F.coalesce((F.col("stage") == F.col("_p_stage")) & (F.col("sec") == F.col("_p_sec") + 1), F.lit(False))
    run = running_sum(s.withColumn("_new", (~same).cast("long")), ax, {"patch": F.col("_new")}).select(*keys, "sec", "patch")
    block = F.floor(F.col("sec") / block_s).alias("_b")
    b = seconds.join(run, [*keys, "sec"]).groupBy(*keys, "stage", "patch", "node", block).agg(F.avg("value").alias("v"))
    arr = b.groupBy(*keys, "stage", "patch", "node").agg(F.array_sort(F.collect_list(F.struct("_b", "v"))).alias("_a"))
    return arr.where(F.size("_a") > min_len).select(*keys, "stage", "patch", "node", F.col("_a.v").alias("values"))
