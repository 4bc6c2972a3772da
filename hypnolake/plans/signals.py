"""Signal queries: embeddings stand for 64 Hz one-second epochs, event values for beat and window series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean, events, hrv, micro, network, quality, report, spectral, staging
from ..operators.ordered import Axis, with_axis
from ..operators.signals import resample_epochs
from .registry import UNROUNDED, query
from .sequences import MACRO_DBL, MACRO_SQL
from .tables import STREAM_SQL, USER, read, streams

REC = ["rec"]
STAGE_OF_LABEL = (5, 3, 2, 1, 4)  # fixed mapping: label modulo 5 -> stage code
CHANNELS = ("F3-M2", "F4-M1", "C3-M2", "C4-M1", "O1-M2", "O2-M1")


def _stage_of(c):
    return F.get(F.array(*[F.lit(s) for s in STAGE_OF_LABEL]), (c % 5).cast("int"))


def epochs(spark, sf):
    """rec, epoch, stage, fs, samples: fifty consecutive vectors form one recording."""
    e = read(spark, sf, "embeddings").select(
        F.floor(F.col("vec_id") / 50).cast("long").alias("rec"), (F.col("vec_id") % 50).cast("int").alias("epoch"),
        _stage_of(F.col("label")).alias("stage"), F.lit(64.0).alias("fs"), F.col("embedding").alias("samples"),
    )
    return with_axis(e, REC, ("epoch",))


def long_epochs(spark, sf):
    """Ten vectors joined to one ten-second epoch, for kernels that need several beats per window."""
    e, _ = epochs(spark, sf)
    part = F.array_sort(F.collect_list(F.struct("epoch", "samples")))  # ten vectors
    long = e.groupBy("rec", F.floor(F.col("epoch") / 10).cast("int").alias("e10"), "fs").agg(part.alias("_p"), F.min_by("stage", "epoch").alias("stage"))
    long = long.select("rec", F.col("e10").alias("epoch"), "stage", "fs", F.flatten("_p.samples").alias("samples"))
    return with_axis(long, REC, ("epoch",))


def channels(spark, sf):
    """Six channels per epoch: rec, epoch, stage, channel, role, fs, samples."""
    v = F.col("vec_id")
    e = read(spark, sf, "embeddings").select(
        F.floor(v / 120).cast("long").alias("rec"), (F.floor(v / 6) % 20).cast("int").alias("epoch"),
        F.when(F.floor(v / 6) % 20 < 14, 2).otherwise(4).alias("stage"),
        F.get(F.array(*[F.lit(c) for c in CHANNELS]), (v % 6).cast("int")).alias("channel"),
        F.lit("eeg").alias("role"), F.lit(64.0).alias("fs"), F.col("embedding").alias("samples"),
    )
    return e


EPO = """WITH epo AS (SELECT CAST(vec_id // 50 AS BIGINT) AS rec, CAST(vec_id % 50 AS INT) AS epoch, [5, 3, 2, 1, 4][label % 5 + 1] AS stage, embedding::DOUBLE[] AS x FROM embeddings)"""
PSD = EPO + """, smp AS (SELECT rec, epoch, stage, unnest(range(64)) AS n, unnest(x) AS v FROM epo),
ctr AS (SELECT rec, epoch, stage, n, (v - avg(v) OVER (PARTITION BY rec, epoch)) * (0.5 - 0.5 * cos(2 * pi() * n / 64)) AS y FROM smp),
psd AS (SELECT rec, epoch, stage, k, (sum(y * cos(2 * pi() * k * n / 64)) ** 2 + sum(y * sin(2 * pi() * k * n / 64)) ** 2) / 768 AS p FROM ctr CROSS JOIN (SELECT unnest(range(1, 30)) AS k) GROUP BY ALL)"""
_BANDS = {"delta": (1, 3), "theta": (4, 7), "alpha": (8, 11), "sigma": (12, 15), "beta": (16, 29)}


def _area(lo, hi):
    return f"(sum(p) FILTER (k BETWEEN {lo} AND {hi}) - (sum(p) FILTER (k = {lo}) + sum(p) FILTER (k = {hi})) / 2)"


_SLOW = "theta / alpha AS theta_alpha, delta / sigma AS delta_sigma, (delta + theta) / (alpha + sigma + beta) AS rem_slowing"
BAND = PSD + ", bp AS (SELECT rec, epoch, stage, " + ", ".join(f"{_area(*b)} AS {n}" for n, b in _BANDS.items()) + f", {_area(1, 29)} AS tot FROM psd GROUP BY ALL)"
_ABS = ", ".join(f"{n} AS abs_{n}" for n in _BANDS) + ", " + ", ".join(f"{n} / tot AS rel_{n}" for n in _BANDS)
_COLS = " ".join([f"{k}_{n}" for k in ("abs", "rel") for n in _BANDS] + list(spectral.RATIOS))


@query("epoch_band_powers", BAND + f" SELECT rec, epoch, stage, 64.0::DOUBLE AS fs, {_ABS}, {_SLOW} FROM bp", dbl=_COLS)
def epoch_band_powers(spark, sf):
    e, _ = epochs(spark, sf)
    return spectral.band_powers(e, min_s=1.0)


MEANS = BAND + ", mn AS (SELECT rec, stage, count(*) AS n_epochs, " + ", ".join(f"avg({n}) AS {n}, avg({n} / tot) AS rel_{n}" for n in _BANDS) + " FROM bp GROUP BY ALL)"


@query("stage_spectral_means", MEANS + " SELECT rec, stage, n_epochs, " + ", ".join(f"{n} AS abs_{n}, rel_{n}" for n in _BANDS) + f", {_SLOW} FROM mn", dbl=_COLS)
def stage_spectral_means(spark, sf):
    e, _ = epochs(spark, sf)
    return spectral.stage_means(spectral.band_powers(e, min_s=1.0), REC)


@query(
    "stage_spectral_contrasts",
    MEANS + """ SELECT rec, max((delta + theta) / (alpha + sigma + beta)) FILTER (stage = 4) AS rem_slowing, max(rel_delta) FILTER (stage = 1) AS n3_delta_rel, max(delta) FILTER (stage = 1) AS n3_delta_abs,
  max((delta + theta) / (alpha + sigma + beta)) FILTER (stage = 4) / max((delta + theta) / (alpha + sigma + beta)) FILTER (stage = 1) AS rem_n3_slowing_ratio FROM mn GROUP BY rec""",
    dbl="rem_slowing n3_delta_rel n3_delta_abs rem_n3_slowing_ratio",
)
def stage_spectral_contrasts(spark, sf):
    e, _ = epochs(spark, sf)
    return spectral.stage_contrasts(spectral.stage_means(spectral.band_powers(e, min_s=1.0), REC), REC)


@query(
    "stage_spectral_dispersion",
    BAND + """ SELECT rec, stage, count(*) AS n, avg(v) AS mean, CASE WHEN count(*) > 1 THEN stddev_samp(v) END AS sd, CASE WHEN count(*) > 1 THEN stddev_samp(v) / abs(avg(v)) END AS cv,
  quantile_cont(v, 0.1) AS p10, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.9) AS p90 FROM (SELECT rec, stage, theta / alpha AS v FROM bp) GROUP BY ALL""",
    dbl="mean sd cv p10 p50 p90",
    nd=7,
)
def stage_spectral_dispersion(spark, sf):
    e, ax = epochs(spark, sf)
    return spectral.stage_dispersion(spectral.band_powers(e, min_s=1.0), REC, "theta_alpha", bounded=not ax.chunked)


SHAPE = PSD + """, cm AS (SELECT *, coalesce(sum((p + pp) / 2) OVER (PARTITION BY rec, epoch ORDER BY k), 0) AS c FROM (SELECT *, lag(p) OVER (PARTITION BY rec, epoch ORDER BY k) AS pp FROM psd)),
cn AS (SELECT *, c / max(c) OVER (PARTITION BY rec, epoch) AS q FROM cm), cl AS (SELECT *, lag(q) OVER (PARTITION BY rec, epoch ORDER BY k) AS pq FROM cn),
sh AS (SELECT rec, epoch, stage, -regr_slope(log10(p), log10(k)) FILTER (k >= 2) AS aper_exp, regr_intercept(log10(p), log10(k)) FILTER (k >= 2) AS aper_off,
  (ln(sum(p)) - sum(p * ln(p)) / sum(p)) / ln(29) AS spec_ent, max(k - 1 + (0.95 - pq) / (q - pq)) FILTER (pq < 0.95 AND q >= 0.95) AS sef95, max(k - 1 + (0.5 - pq) / (q - pq)) FILTER (pq < 0.5 AND q >= 0.5) AS med_freq
  FROM cl GROUP BY ALL)"""
_SH = ("aper_exp", "aper_off", "spec_ent", "sef95", "med_freq")


@query("spectral_shape", SHAPE + " SELECT rec, epoch, stage, 64.0::DOUBLE AS fs, aper_exp, aper_off, spec_ent, sef95, med_freq FROM sh", dbl=" ".join(_SH), nd=8)
def spectral_shape(spark, sf):
    e, _ = epochs(spark, sf)
    return spectral.spectral_shape(e, min_s=1.0)


@query(
    "spectral_shape_summary",
    SHAPE + f""", t AS (UNPIVOT sh ON {', '.join(_SH)} INTO NAME metric VALUE v)
SELECT rec, metric, avg(v) FILTER (stage = 5) AS mean_wake, avg(v) FILTER (stage = 2) AS mean_n2, avg(v) FILTER (stage = 1) AS mean_n3, avg(v) FILTER (stage = 4) AS mean_rem,
  CASE WHEN count(v) FILTER (stage = 2) >= 3 THEN stddev_pop(v) FILTER (stage = 2) END AS n2std, CASE WHEN count(v) FILTER (stage <> 5) >= 5 THEN stddev_pop(v) FILTER (stage <> 5) END AS sleepstd FROM t GROUP BY ALL""",
    dbl="mean_wake mean_n2 mean_n3 mean_rem n2std sleepstd",
    nd=8,
)
def spectral_shape_summary(spark, sf):
    e, _ = epochs(spark, sf)
    return spectral.shape_summary(spectral.spectral_shape(e, min_s=1.0), REC)


# ------------------------------------------------------------------ kernels without a SQL form (numpy references in the tests)
@query("spindle_events", dbl="start_s duration_s amp_uv so_phase")
def spindle_events(spark, sf):
    e, ax = epochs(spark, sf)
    return spectral.spindle_events(e, ax, epoch_s=1.0, k=1.0, min_calibration_s=5, min_stage_min=0.05)


@query("spindle_summary", dbl="minutes amp_mean amp_sd dur_mean dur_sd density_per_min")
def spindle_summary(spark, sf):
    e, ax = epochs(spark, sf)
    ev = spectral.spindle_events(e, ax, epoch_s=1.0, k=1.0, min_calibration_s=5, min_stage_min=0.05)
    return spectral.spindle_summary(ev, e.select("rec", "stage"), REC, 1.0)


@query("rem_density", dbl="rem_min threshold_uv rem_density_index")
def rem_density(spark, sf):
    e, ax = epochs(spark, sf)
    return micro.rem_density(e, ax, epoch_s=1.0, min_rem_min=0.05)


COMPLEX = EPO + """, sm AS (SELECT rec, epoch, stage, unnest(range(64)) AS n, unnest(x) AS v FROM epo),
tr AS (SELECT rec, epoch, stage, n, v AS a, lead(v) OVER w AS b, lead(v, 2) OVER w AS c, 0.2 * stddev_pop(v) OVER (PARTITION BY rec, epoch) AS tol FROM sm WINDOW w AS (PARTITION BY rec, epoch ORDER BY n)),
ok AS (SELECT * FROM tr WHERE c IS NOT NULL),
se AS (SELECT p.rec, p.epoch, p.stage, count(*) AS b, count(*) FILTER (abs(p.c - q.c) <= p.tol) AS a FROM ok p JOIN ok q ON p.rec = q.rec AND p.epoch = q.epoch AND p.n <> q.n
  WHERE abs(p.a - q.a) <= p.tol AND abs(p.b - q.b) <= p.tol GROUP BY ALL),
pc AS (SELECT rec, epoch, a <= b AS ab, a <= c AS ac, b <= c AS bc, count(*) AS n FROM ok GROUP BY ALL),
pe AS (SELECT rec, epoch, -sum(n / 62 * log2(n / 62)) / log2(6) AS permen FROM pc GROUP BY ALL),
cx AS (SELECT e.rec, e.epoch, e.stage, 64.0::DOUBLE AS fs, CASE WHEN a > 0 AND b > 0 THEN -ln(a / b) END AS sampen, permen FROM epo e LEFT JOIN se USING (rec, epoch) JOIN pe USING (rec, epoch))"""


@query("eeg_complexity", COMPLEX + " SELECT * FROM cx", dbl="sampen permen")
def eeg_complexity(spark, sf):
    e, ax = epochs(spark, sf)
    return micro.epoch_complexity(e, ax)


@query(
    "eeg_complexity_by_stage",
    COMPLEX + """ SELECT rec, stage, count(*) AS n_epochs, avg(sampen) AS sampen_mean, stddev_pop(sampen) AS sampen_sd, avg(permen) AS permen_mean, stddev_pop(permen) AS permen_sd
FROM cx WHERE stage <> 9 GROUP BY ALL""",
    dbl="sampen_mean sampen_sd permen_mean permen_sd",
)
def eeg_complexity_by_stage(spark, sf):
    e, ax = epochs(spark, sf)
    return micro.stage_complexity(micro.epoch_complexity(e, ax), REC)


@query("respiratory_rate", dbl="rate_mean rate_sd rrv_cv")
def respiratory_rate(spark, sf):
    e, ax = epochs(spark, sf)
    br = micro.breath_times(e, ax, epoch_s=1.0, band=(0.3, 1.5), min_gap_s=0.5)
    return micro.respiratory_rate(micro.breath_intervals(br, ax), REC, bounded=not ax.chunked)


@query("breath_interval_entropy", dbl="sampen")
def breath_interval_entropy(spark, sf):
    e, ax = epochs(spark, sf)
    iv = micro.breath_intervals(micro.breath_times(e, ax, epoch_s=1.0, band=(1.0, 6.0), min_gap_s=0.1), ax)
    return micro.interval_entropy(iv, REC, "t", "gap_s", min_n=10)


@query("r_peak_rr_series", dbl="t rr_ms")
def r_peak_rr_series(spark, sf):
    e, ax = long_epochs(spark, sf)
    return hrv.rr_intervals(hrv.r_peaks(e, ax, epoch_s=10.0), ax)


@query("connectivity", dbl="coh wpli")
def connectivity(spark, sf):
    sp = network.cross_spectra(network.montage(channels(spark, sf), REC), REC, seg_s=0.5)
    return network.connectivity(sp, REC)


@query("connectivity_summary", dbl=" ".join(f"{c}_{n}" for n in _BANDS for c in ("coh", "wpli")) + " coh_interhemi_alpha coh_antpost_theta")
def connectivity_summary(spark, sf):
    sp = network.cross_spectra(network.montage(channels(spark, sf), REC), REC, seg_s=0.5)
    return network.connectivity_summary(network.connectivity(sp, REC), REC)


@query("microstates", dbl="ms_gev ms_gfp_peak_rate ms_gfp_mean ms_mean_dur_ms ms_trans_rate ms_coverage_entropy ms_n_eff ms_mean_corr")
def microstates(spark, sf):
    return network.microstates(network.montage(channels(spark, sf), REC), REC, min_peaks=20)


def _node_windows(spark, sf):
    return channels(spark, sf).select("rec", F.col("epoch").cast("long").alias("win"), "stage", F.col("channel").alias("node"), F.col("samples").alias("values"))


LAGS = f"""WITH nd AS (SELECT vec_id // 120 AS rec, (vec_id // 6) % 20 AS win, CASE WHEN (vec_id // 6) % 20 < 14 THEN 2 ELSE 4 END AS stage, {list(CHANNELS)}[vec_id % 6 + 1] AS node, embedding::DOUBLE[] AS x FROM embeddings),
sm AS (SELECT rec, win, stage, node, unnest(range(64)) AS n, unnest(x) AS v FROM nd),
z AS (SELECT rec, win, stage, node, n, (v - avg(v) OVER w) / stddev_pop(v) OVER w AS z FROM sm WINDOW w AS (PARTITION BY rec, win, node)),
d AS (SELECT a.rec, a.win, a.stage, a.node AS i, b.node AS j, b.n - a.n AS tau, a.z * b.z AS p FROM z a JOIN z b ON a.rec = b.rec AND a.win = b.win AND a.node < b.node WHERE abs(b.n - a.n) <= 10),
r AS (SELECT rec, win, stage, i, j, tau, round(abs(sum(p)) / (64 - abs(tau)), 12) AS r FROM d GROUP BY rec, win, stage, i, j, tau),
lags AS (SELECT rec, CAST(win AS BIGINT) AS win, stage, i, j, CAST(tau AS INT) AS tau FROM r QUALIFY row_number() OVER (PARTITION BY rec, win, i, j ORDER BY r DESC, tau) = 1),
cuts AS (SELECT *, CASE WHEN abs(tau - lag(tau) OVER p) <= 2 AND win = lag(win) OVER p + 1 THEN 0 ELSE 1 END AS cut FROM lags WINDOW p AS (PARTITION BY rec, i, j ORDER BY win)),
runs AS (SELECT *, sum(cut) OVER (PARTITION BY rec, i, j ORDER BY win) AS run FROM cuts), sized AS (SELECT *, count(*) OVER (PARTITION BY rec, i, j, run) AS len FROM runs),
links AS (SELECT rec, i, j, stage, avg(CASE WHEN len >= 2 THEN 1.0 ELSE 0.0 END) AS strength, count(*) AS n_windows FROM sized GROUP BY ALL)"""


@query("time_delay_lags", LAGS + " SELECT * FROM lags")
def time_delay_lags(spark, sf):
    return network.window_lags(_node_windows(spark, sf), REC)


@query("time_delay_stability", LAGS + " SELECT * FROM links", dbl="strength")
def time_delay_stability(spark, sf):
    return network.tds_links(network.window_lags(_node_windows(spark, sf), REC), REC, tol=2, min_run=2)


@query("network_cohort_mean", LAGS + " SELECT stage, i, j, avg(strength) AS mean_strength, count(*) AS n_recordings FROM links GROUP BY ALL", dbl="mean_strength")
def network_cohort_mean(spark, sf):
    links = network.tds_links(network.window_lags(_node_windows(spark, sf), REC), REC, tol=2, min_run=2)
    return network.network_cohort(links)


@query(
    "network_label_contrast",
    LAGS + """ SELECT stage, i, j, avg(strength) FILTER (rec % 2 = 1) AS mean_pos, avg(strength) FILTER (rec % 2 = 0) AS mean_neg,
  avg(strength) FILTER (rec % 2 = 1) - avg(strength) FILTER (rec % 2 = 0) AS delta FROM links GROUP BY ALL""",
    dbl="mean_pos mean_neg delta",
)
def network_label_contrast(spark, sf):
    links = network.tds_links(network.window_lags(_node_windows(spark, sf), REC), REC, tol=2, min_run=2)
    return network.network_contrast(links.withColumn("label", F.col("rec") % 2))


@query("directed_coupling", dbl="g stationary_frac")
def directed_coupling(spark, sf):
    """Two triples of channels per recording: the operator conditions each pair on the third node."""
    triple = F.when(F.col("channel").isin(*CHANNELS[:3]), 0).otherwise(1).alias("triple")
    p = channels(spark, sf).select("rec", triple, "stage", F.col("epoch").alias("patch"), F.col("channel").alias("node"), F.col("samples").alias("values"))
    return network.directed_coupling(p, [*REC, "triple"])


@query("pooled_coupling", dbl="g stationary_frac", nd=6)
def pooled_coupling(spark, sf):
    """Samples stand for seconds: the stages of successive epochs form the runs; the first three channels are the nodes."""
    from ..operators.coupling import pooled_coupling as pooled

    c = channels(spark, sf).where(F.col("channel").isin(*CHANNELS[:3]))
    sec = c.select("rec", "stage", "epoch", F.col("channel").alias("node"), F.posexplode("samples").alias("_i", "value"))
    return pooled(sec.select("rec", "stage", "node", "value", (F.col("epoch").cast("long") * 64 + F.col("_i")).alias("sec")), REC, CHANNELS[:3], timescales=(1, 2, 4))


@query("node_seconds", dbl="value")
def node_seconds(spark, sf):
    from ..operators.signals import with_context

    e, ax = with_axis(channels(spark, sf), ["rec", "channel"], ("epoch",))
    return network.node_seconds(with_context(e, ax, 1.0), REC, epoch_s=1)


@query("beat_template_quality", dbl="q_mean pct_good pct_bad q_median")
def beat_template_quality(spark, sf):
    e, ax = long_epochs(spark, sf)
    return quality.quality_summary(quality.beat_quality(e, ax), REC, bounded=not ax.chunked)


@query("resampled_epochs", dbl="energy")
def resampled_epochs(spark, sf):
    e, _ = epochs(spark, sf)
    r = resample_epochs(e, 32.0)
    energy = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return r.select("rec", "epoch", "fs", F.size("samples").alias("n"), energy.alias("energy"))


@query("raw_epoch_bank", dbl="peak")
def raw_epoch_bank(spark, sf):
    b = quality.epoch_bank(network.montage(channels(spark, sf), REC), REC)
    ex = b.select("rec", "epoch", "stage", F.explode("slots").alias("slot", "x"))
    return ex.select("rec", "epoch", "stage", "slot", F.size("x").alias("n"), F.array_max(F.transform("x", lambda v: F.abs(v))).alias("peak"))


# ------------------------------------------------------------------ array operators with oracles
SMP = EPO + ", smp AS (SELECT rec, epoch, stage, unnest(range(64)) AS i, unnest(x) AS v FROM epo)"


@query(
    "bipolar_derivation",
    EPO + """, p AS (SELECT a.rec, a.epoch, unnest(range(64)) AS i, unnest(a.x) AS u, unnest(b.x) AS v, unnest(c.x) AS w FROM epo a JOIN epo b ON b.rec = a.rec AND b.epoch = a.epoch + 1 JOIN epo c ON c.rec = a.rec AND c.epoch = a.epoch + 2)
SELECT rec, epoch, CAST(i AS INT) AS i, u - v AS ab, u - (v + w) / 2 AS abc FROM p""",
    dbl="ab abc",
)
def bipolar_derivation(spark, sf):
    e, _ = epochs(spark, sf)
    x = F.transform("samples", lambda v: v.cast("double"))
    a = e.select("rec", "epoch", x.alias("a"))
    b = e.select("rec", (F.col("epoch") - 1).alias("epoch"), x.alias("b"))
    c = e.select("rec", (F.col("epoch") - 2).alias("epoch"), x.alias("c"))
    j = a.join(b, ["rec", "epoch"]).join(c, ["rec", "epoch"])
    z = F.arrays_zip(clean.bipolar(F.col("a"), F.col("b")).alias("ab"), clean.bipolar(F.col("a"), F.col("b"), F.col("c")).alias("abc"))
    return j.select("rec", "epoch", F.posexplode(z).alias("i", "_z")).select("rec", "epoch", "i", "_z.ab", "_z.abc")


@query(
    "channel_zscore",
    SMP + " SELECT rec, epoch, CAST(i AS INT) AS i, (v - avg(v) OVER (PARTITION BY rec, stage)) / stddev_pop(v) OVER (PARTITION BY rec, stage) AS z FROM smp",
    dbl="z",
)
def channel_zscore(spark, sf):
    e, _ = epochs(spark, sf)
    e = e.withColumn("std_channel", F.col("stage").cast("string")).withColumn("samples", F.transform("samples", lambda v: v.cast("double")))
    z = clean.zscore_channels(e, REC)
    return z.select("rec", "epoch", F.posexplode("samples").alias("i", "z"))


@query(
    "stage_signal_profile",
    SMP + """, st AS (SELECT rec, stage, count(DISTINCT epoch) AS n_epochs, avg(v) AS mean, stddev_pop(v) AS std, min(v) AS min, max(v) AS max, quantile_cont(v, 0.05) AS p5, quantile_cont(v, 0.95) AS p95 FROM smp GROUP BY ALL),
r AS (SELECT rec, stage, g, min(epoch) AS f, count(*) AS n FROM (SELECT *, sum(c) OVER (PARTITION BY rec ORDER BY epoch) AS g FROM (SELECT rec, epoch, stage, CASE WHEN lag(stage) OVER (PARTITION BY rec ORDER BY epoch) IS DISTINCT FROM stage THEN 1 ELSE 0 END AS c FROM epo)) GROUP BY rec, stage, g),
b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY rec, stage ORDER BY n DESC, f) = 1)
SELECT st.*, CAST((2 * f + n - 1) // 2 AS BIGINT) AS example_epoch FROM st JOIN b USING (rec, stage)""",
    dbl="mean std min max p5 p95",
)
def stage_signal_profile(spark, sf):
    e, ax = epochs(spark, sf)
    return quality.stage_profile(e, ax, bounded=not ax.chunked)


@query(
    "stage_concatenated_signal",
    SMP + """, o AS (SELECT rec, epoch, row_number() OVER (PARTITION BY rec ORDER BY epoch) - 1 AS k, epoch <> lag(epoch) OVER (PARTITION BY rec ORDER BY epoch) + 1 AS sm FROM epo WHERE stage = 2)
SELECT o.rec, k + i / 64.0 AS t, v AS value, coalesce(sm, FALSE) AND i = 0 AS seam FROM o JOIN smp USING (rec, epoch) WHERE k + i / 64.0 >= 1 AND k + i / 64.0 < 4""",
    dbl="t value",
)
def stage_concatenated_signal(spark, sf):
    e, ax = epochs(spark, sf)
    return quality.stage_concatenation(e, ax, 2, 1.0, 4.0, epoch_s=1.0)


@query(
    "channel_quality",
    SMP + """, lim AS (SELECT rec, min(v) AS lo, max(v) AS hi FROM smp GROUP BY rec),
rl AS (SELECT rec, avg(CASE WHEN abs(v - lo) <= 1e-8 + 1e-5 * abs(lo) OR abs(v - hi) <= 1e-8 + 1e-5 * abs(hi) THEN 1.0 ELSE 0 END) AS clip_frac FROM smp JOIN lim USING (rec) GROUP BY rec),
sd AS (SELECT rec, stddev_pop(v) AS s FROM smp GROUP BY rec, epoch, i // 16), ac AS (SELECT rec, quantile_cont(s, 0.9) AS a FROM sd GROUP BY rec)
SELECT rec, 0.0 AS nan_frac, any_value(clip_frac) AS clip_frac, avg(CASE WHEN s < 0.6 * a THEN 1.0 ELSE 0 END) AS flat_frac FROM sd JOIN ac USING (rec) JOIN rl USING (rec) GROUP BY rec""",
    dbl="nan_frac clip_frac flat_frac",
)
def channel_quality(spark, sf):
    e, ax = epochs(spark, sf)
    return quality.channel_quality(e, REC, flat_s=0.25, flat_share=0.6, bounded=not ax.chunked)


@query(
    "night_embedding_pooling",
    SMP + """, tg AS (SELECT rec, CASE stage WHEN 5 THEN 'wake' WHEN 3 THEN 'n1' WHEN 2 THEN 'n2' WHEN 1 THEN 'n3' ELSE 'rem' END AS pool, i, v FROM smp UNION ALL SELECT rec, 'all', i, v FROM smp)
SELECT rec, pool, count(*) AS n, CAST(i AS INT) AS dim, avg(v) AS value FROM tg GROUP BY ALL""",
    dbl="value",
)
def night_embedding_pooling(spark, sf):
    e, _ = epochs(spark, sf)
    m = quality.night_embedding(e.withColumnRenamed("samples", "embedding"), REC)
    return m.select("rec", "pool", "n", F.posexplode("mean_vector").alias("dim", "value"))


# ------------------------------------------------------------------ beat and window series from event values
RR = f"""WITH {STREAM_SQL}, rr AS (SELECT user_id, epoch AS t, stage, 600 + value AS rr_ms FROM streams WHERE stage <> 9),
pl AS (SELECT *, unnest(CASE stage WHEN 5 THEN ['wake'] WHEN 4 THEN ['rem', 'sleep'] WHEN 3 THEN ['n1', 'nrem', 'sleep'] WHEN 2 THEN ['n2', 'nrem', 'sleep'] ELSE ['n3', 'nrem', 'sleep'] END) AS pool FROM rr),
df AS (SELECT *, rr_ms - lag(rr_ms) OVER (PARTITION BY user_id, pool ORDER BY t) AS d FROM pl),
td AS (SELECT user_id, pool, count(*) AS n_beats, avg(rr_ms) AS mean_nn, stddev_samp(rr_ms) AS sdnn, sqrt(avg(d * d)) AS rmssd, stddev_samp(d) AS sdsd, 100.0 * count(*) FILTER (abs(d) > 50) / count(d) AS pnn50, median(rr_ms) AS median_nn
  FROM df GROUP BY ALL HAVING count(*) >= 8),
ht AS (SELECT *, 60000 / mean_nn AS hr_mean, sdnn / mean_nn AS cvnn, sqrt(0.5 * sdsd * sdsd) AS sd1, CASE WHEN 2 * sdnn * sdnn - 0.5 * sdsd * sdsd > 0 THEN sqrt(2 * sdnn * sdnn - 0.5 * sdsd * sdsd) END AS sd2 FROM td)"""


def _rr(spark, sf):
    df, ax = streams(spark, sf)
    rr = df.where("stage <> 9").select(*ax.part, F.col("epoch").alias("t"), "stage", (600.0 + F.col("value")).alias("rr_ms"))
    return rr, Axis(ax.keys, ("t",), ax.chunked)


_TD = "mean_nn sdnn rmssd sdsd pnn50 median_nn hr_mean cvnn sd1 sd2 sd1sd2"


@query("hrv_time_domain", RR + " SELECT *, CASE WHEN sd2 > 0 THEN sd1 / sd2 END AS sd1sd2 FROM ht", dbl=_TD, nd=8)
def hrv_time_domain(spark, sf):
    rr, ax = _rr(spark, sf)
    return hrv.time_domain(hrv.pooled(rr), ax, min_beats=8, bounded=not ax.chunked)


@query(
    "hrv_contrasts",
    RR + """ SELECT user_id, max(rmssd) FILTER (pool = 'rem') / max(rmssd) FILTER (pool = 'nrem') AS rem_nrem_rmssd_ratio, max(hr_mean) FILTER (pool = 'rem') - max(hr_mean) FILTER (pool = 'nrem') AS rem_nrem_hr_delta,
  max(hr_mean) FILTER (pool = 'wake') - max(hr_mean) FILTER (pool = 'sleep') AS wake_sleep_hr_delta, max(rmssd) FILTER (pool = 'n3') / max(rmssd) FILTER (pool = 'wake') AS n3_wake_rmssd_ratio,
  CASE WHEN count(*) FILTER (pool IN ('wake','n1','n2','n3','rem')) >= 2 THEN max(hr_mean) FILTER (pool IN ('wake','n1','n2','n3','rem')) - min(hr_mean) FILTER (pool IN ('wake','n1','n2','n3','rem')) END AS stage_hr_range,
  CASE WHEN count(*) FILTER (pool IN ('wake','n1','n2','n3','rem')) >= 2 THEN stddev_pop(rmssd) FILTER (pool IN ('wake','n1','n2','n3','rem')) / avg(rmssd) FILTER (pool IN ('wake','n1','n2','n3','rem')) END AS stage_rmssd_cv FROM ht GROUP BY user_id""",
    dbl="rem_nrem_rmssd_ratio rem_nrem_hr_delta wake_sleep_hr_delta n3_wake_rmssd_ratio stage_hr_range stage_rmssd_cv",
    nd=8,
)
def hrv_contrasts(spark, sf):
    rr, ax = _rr(spark, sf)
    return hrv.contrasts(hrv.time_domain(hrv.pooled(rr), ax, min_beats=8, bounded=not ax.chunked), USER)


@query(
    "hrv_dfa_alpha1",
    RR + """, m AS (SELECT user_id, pool, avg(rr_ms) AS mu, count(*) AS n FROM pl GROUP BY ALL HAVING count(*) >= 32),
y AS (SELECT user_id, pool, n, sum(rr_ms - mu) OVER (PARTITION BY user_id, pool ORDER BY t) AS y, row_number() OVER (PARTITION BY user_id, pool ORDER BY t) - 1 AS i FROM pl JOIN m USING (user_id, pool)),
b AS (SELECT user_id, pool, s, i // s AS box, i % s AS u, y FROM y CROSS JOIN (SELECT unnest([4, 5, 7, 8, 10, 13, 16]) AS s) WHERE i // s < n // s),
r AS (SELECT user_id, pool, s, box, (regr_syy(y, u) - CASE WHEN regr_sxx(y, u) > 0 THEN regr_sxy(y, u) ** 2 / regr_sxx(y, u) ELSE 0 END) AS ss FROM b GROUP BY user_id, pool, s, box),
f AS (SELECT user_id, pool, s, sqrt(sum(ss) / (count(*) * s)) AS f FROM r GROUP BY user_id, pool, s)
SELECT user_id, pool, regr_slope(ln(f), ln(s)) AS dfa_a1 FROM f GROUP BY user_id, pool""",
    dbl="dfa_a1",
    nd=7,
)
def hrv_dfa_alpha1(spark, sf):
    rr, ax = _rr(spark, sf)
    return hrv.dfa(hrv.pooled(rr), ax, hrv.DFA_SHORT, "dfa_a1", 32)


@query("hrv_nonlinear", dbl="sampen dfa_a1 dfa_a2")
def hrv_nonlinear(spark, sf):
    rr, ax = _rr(spark, sf)
    return hrv.nonlinear(hrv.pooled(rr), ax)


@query("hrv_frequency_domain", dbl="lf hf lfhf lfn hfn tp")
def hrv_frequency_domain(spark, sf):
    rr, ax = _rr(spark, sf)
    return hrv.frequency_domain(hrv.pooled(rr), USER, min_beats=20)


# windows of 5 s: a window begun at a beat closes on the first beat that reaches 5 s; the true ones follow from the first beat
HRV_WIN = f"""WITH RECURSIVE {STREAM_SQL}, rr AS (SELECT user_id, stage, epoch AS t, 600 + value AS rr_ms, CAST(round((600 + value) * 1000) AS BIGINT) AS us FROM streams WHERE stage <> 9),
c AS (SELECT *, row_number() OVER w AS i, sum(us) OVER w AS s FROM rr WINDOW w AS (PARTITION BY user_id, stage ORDER BY t)),
p AS (SELECT user_id, stage, i, s AS ends, 1 AS beat FROM c UNION ALL SELECT user_id, stage, i, s - us + 5000000, 0 FROM c),
e AS (SELECT user_id, stage, i, beat, sum(beat) OVER (PARTITION BY user_id, stage ORDER BY ends, beat ROWS UNBOUNDED PRECEDING) + 1 AS j FROM p),
n AS (SELECT user_id, stage, count(*) AS n FROM c GROUP BY ALL),
k AS (SELECT user_id, stage, 0 AS window_index, CAST(1 AS BIGINT) AS a FROM n
  UNION ALL SELECT k.user_id, k.stage, k.window_index + 1, CAST(e.j + 1 AS BIGINT) FROM k JOIN e ON e.user_id = k.user_id AND e.stage = k.stage AND e.i = k.a AND e.beat = 0
  JOIN n ON n.user_id = k.user_id AND n.stage = k.stage AND e.j < n.n),
z AS (SELECT *, lead(a) OVER (PARTITION BY user_id, stage ORDER BY window_index) AS b FROM k),
b AS (SELECT c.*, z.window_index FROM c JOIN z ON z.user_id = c.user_id AND z.stage = c.stage AND c.i >= z.a AND (z.b IS NULL OR c.i < z.b)),
d AS (SELECT *, rr_ms - lag(rr_ms) OVER (PARTITION BY user_id, stage, window_index ORDER BY t) AS d FROM b),
hw AS (SELECT user_id, stage, window_index, min(t) AS start_s, sum(rr_ms) / 1000 AS dur_s, count(*) AS n_beats, avg(rr_ms) AS mean_nn, stddev_samp(rr_ms) AS sdnn, sqrt(avg(d * d)) AS rmssd,
  stddev_samp(d) AS sdsd, 100.0 * count(*) FILTER (abs(d) > 50) / count(d) AS pnn50, 60000.0 / avg(rr_ms) AS hr_mean, stddev_samp(rr_ms) / avg(rr_ms) AS cvnn FROM d GROUP BY ALL HAVING count(*) >= 3)"""


@query("hrv_windows", HRV_WIN + " SELECT * FROM hw", dbl="start_s dur_s mean_nn sdnn rmssd sdsd pnn50 hr_mean cvnn", nd=7)
def hrv_windows(spark, sf):
    rr, ax = _rr(spark, sf)
    return hrv.windows(rr, USER, win_s=5.0, min_beats=3, stretch_s=30.0)


@query(
    "hrv_window_spread",
    HRV_WIN + """, m AS (UNPIVOT (SELECT user_id, stage, mean_nn, sdnn, rmssd, sdsd, pnn50, hr_mean, cvnn FROM hw) ON mean_nn, sdnn, rmssd, sdsd, pnn50, hr_mean, cvnn INTO NAME metric VALUE v)
SELECT user_id, stage, metric, count(*) AS n, avg(v) AS mean, stddev_samp(v) AS sd, CASE WHEN count(*) >= 2 AND avg(v) <> 0 THEN stddev_samp(v) / abs(avg(v)) END AS cv,
  CASE WHEN count(*) >= 2 THEN quantile_cont(v, 0.1) END AS p10, CASE WHEN count(*) >= 2 THEN quantile_cont(v, 0.5) END AS p50, CASE WHEN count(*) >= 2 THEN quantile_cont(v, 0.9) END AS p90,
  CASE WHEN count(*) >= 2 THEN quantile_cont(v, 0.75) - quantile_cont(v, 0.25) END AS iqr FROM m GROUP BY ALL""",
    dbl="mean sd cv p10 p50 p90 iqr",
    nd=7,
)
def hrv_window_spread(spark, sf):
    from ..operators.profile import spread

    rr, ax = _rr(spark, sf)
    w = hrv.windows(rr, USER, win_s=5.0, min_beats=3, stretch_s=30.0)
    names = ("mean_nn", "sdnn", "rmssd", "sdsd", "pnn50", "hr_mean", "cvnn")
    tall = w.select("user_id", "stage", F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in names])).alias("_m"))
    return spread(tall.select("user_id", "stage", "_m.*"), ["user_id", "stage", "metric"], "v", bounded=not ax.chunked)


WIN = f"""WITH {STREAM_SQL}, w AS (SELECT user_id, epoch AS win, stage, value AS total, value * 0.4 AS s, value * (k % 10) / 10.0 AS q, sqrt(value) AS amp, stage IN (1, 2, 3) AS nrem FROM streams),
fl AS (SELECT user_id, median(amp) AS fill FROM w WHERE nrem GROUP BY user_id), f AS (SELECT w.*, fill, CASE WHEN nrem THEN amp ELSE fill END AS f FROM w JOIN fl USING (user_id)),
g AS (SELECT *, median(f) OVER (PARTITION BY user_id ORDER BY win ROWS BETWEEN 25 PRECEDING AND 25 FOLLOWING) AS bg FROM f),
a AS (SELECT *, CASE WHEN nrem AND amp / CASE WHEN bg > 0 THEN bg ELSE greatest(fill, 1e-12) END > 1.3 THEN 1 ELSE 0 END AS a FROM g),
rn AS (SELECT user_id, a, min(win) AS start_win, max(win) + 1 AS end_win, count(*) AS n, sum(s) AS s, sum(q) AS q FROM (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY win) AS g2 FROM (SELECT *, CASE WHEN lag(a) OVER (PARTITION BY user_id ORDER BY win) IS DISTINCT FROM a THEN 1 ELSE 0 END AS c FROM a)) GROUP BY user_id, a, g2),
ph AS (SELECT user_id, start_win, end_win, CASE WHEN s + q > 0 THEN CASE WHEN q / (s + q) < 0.3 THEN 1 WHEN q / (s + q) > 0.5 THEN 3 ELSE 2 END ELSE 2 END AS subtype FROM rn WHERE a = 1 AND n <= 30)"""


def _cap(spark, sf):
    df, ax = streams(spark, sf)
    v = F.col("value")
    w = df.select(
        *ax.part, "stage", F.col("epoch").alias("win"), v.alias("total"), (v * 0.4).alias("delta"), F.lit(0.0).alias("theta"),
        (v * (F.col("k") % 10) / 10.0).alias("alpha"), F.lit(0.0).alias("sigma"), F.lit(0.0).alias("beta"),
    )
    wx = Axis(ax.keys, ("win",), ax.chunked)
    return df, wx, micro.cap_phases(w, wx, act=0.3)


@query("cap_phases", WIN + " SELECT * FROM ph")
def cap_phases(spark, sf):
    return _cap(spark, sf)[2]


@query(
    "cap_summary",
    WIN + """, pg AS (SELECT *, start_win - lag(end_win) OVER (PARTITION BY user_id ORDER BY start_win) AS gap FROM ph), pl AS (SELECT *, CASE WHEN gap BETWEEN 1 AND 30 THEN 1 ELSE 0 END AS lk FROM pg),
ps AS (SELECT *, sum(1 - lk) OVER (PARTITION BY user_id ORDER BY start_win) AS sq FROM pl), sq AS (SELECT user_id, count(*) AS ns, sum(d) * 2 / 60.0 AS tm FROM (SELECT user_id, sq, max(end_win) - min(start_win) AS d, count(*) AS n FROM ps GROUP BY ALL) WHERE n >= 2 GROUP BY user_id),
ag AS (SELECT user_id, count(*) AS na, count(*) FILTER (subtype = 1) AS n1, count(*) FILTER (subtype = 2) AS n2, count(*) FILTER (subtype = 3) AS n3, avg(end_win - start_win) * 2 AS ad, avg(gap) FILTER (lk = 1) * 2 AS bd FROM ps GROUP BY user_id),
mi AS (SELECT user_id, count(*) FILTER (stage IN (1, 2, 3)) * 30 / 60.0 AS nrem_min FROM streams GROUP BY user_id HAVING count(*) FILTER (stage IN (1, 2, 3)) * 30 / 60.0 >= 10)
SELECT user_id, nrem_min, coalesce(tm, 0) / nrem_min AS cap_rate, coalesce(tm, 0) AS cap_time_min, coalesce(na, 0) / nrem_min AS cap_a_index, 100.0 * n1 / na AS cap_a1_pct, 100.0 * n2 / na AS cap_a2_pct, 100.0 * n3 / na AS cap_a3_pct,
  coalesce(n1, 0) / nrem_min AS cap_a1_index, coalesce(n3, 0) / nrem_min AS cap_a3_index, ad AS cap_mean_a_dur_s, bd AS cap_mean_b_dur_s, coalesce(ns, 0) AS cap_n_sequences FROM mi LEFT JOIN ag USING (user_id) LEFT JOIN sq USING (user_id)""",
    dbl="nrem_min cap_rate cap_time_min cap_a_index cap_a1_pct cap_a2_pct cap_a3_pct cap_a1_index cap_a3_index cap_mean_a_dur_s cap_mean_b_dur_s",
)
def cap_summary(spark, sf):
    df, wx, ph = _cap(spark, sf)
    return micro.cap_summary(ph, micro.nrem_minutes(df, USER), wx)


_SPLIT = """WITH epo AS (SELECT vec_id // 50 AS rec, CAST(vec_id % 50 AS INT) AS epoch, [5, 3, 2, 1, 4][label % 5 + 1] AS stage, embedding::DOUBLE[] AS x FROM embeddings),
smp AS (SELECT rec, epoch, stage, unnest(range(64)) AS n, unnest(x) AS v FROM epo)"""


@query(
    "cap_window_powers",
    _SPLIT + """, c AS (SELECT rec, stage, epoch * 2 + n // 32 AS win, n % 32 AS i, v - avg(v) OVER (PARTITION BY rec, epoch, n // 32) AS y FROM smp),
p AS (SELECT rec, stage, win, 2 * k AS hz, sum(y * cos(2 * pi() * k * i / 32)) ** 2 + sum(y * sin(2 * pi() * k * i / 32)) ** 2 AS p FROM c CROSS JOIN (SELECT unnest(range(1, 15)) AS k) GROUP BY ALL)
SELECT rec, stage, CAST(win AS BIGINT) AS win, sum(p) FILTER (hz < 4) AS delta, sum(p) FILTER (hz >= 4 AND hz < 8) AS theta, sum(p) FILTER (hz >= 8 AND hz < 12) AS alpha,
  sum(p) FILTER (hz >= 12 AND hz < 16) AS sigma, sum(p) FILTER (hz >= 16) AS beta, sum(p) AS total FROM p GROUP BY ALL""",
    dbl="delta theta alpha sigma beta total",
    nd=7,
)
def cap_window_powers(spark, sf):
    e, _ = epochs(spark, sf)
    return micro.window_powers(e, REC, win_s=0.5, epoch_s=1.0)


@query(
    "rem_atonia",
    f"""WITH {STREAM_SQL}, w AS (SELECT user_id, stage, epoch AS win, 1 + value AS rms FROM streams), q AS (SELECT user_id, quantile_cont(rms, 0.2) AS floor, median(rms) AS md FROM w WHERE stage = 4 GROUP BY user_id),
n AS (SELECT user_id, median(rms) AS nm FROM w WHERE stage IN (1, 2, 3) GROUP BY user_id),
t AS (SELECT user_id, count(*) * 0.5 / 60 AS rem_min, avg(CASE WHEN rms > 2 * floor THEN 1.0 ELSE 0 END) AS tf, stddev_pop(rms) AS sd, any_value(floor) AS floor, any_value(md) AS md FROM w JOIN q USING (user_id) WHERE stage = 4 GROUP BY user_id HAVING count(*) * 0.5 / 60 >= 0.05),
b AS (SELECT *, CASE WHEN stage = 4 AND rms > 4 * floor THEN 1 ELSE 0 END AS b FROM w JOIN q USING (user_id)),
r AS (SELECT user_id, b, count(*) AS n FROM (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY win) AS g FROM (SELECT *, CASE WHEN lag(b) OVER (PARTITION BY user_id ORDER BY win) IS DISTINCT FROM b THEN 1 ELSE 0 END AS c FROM b)) GROUP BY user_id, b, g),
p AS (SELECT user_id, count(*) AS k FROM r WHERE b = 1 AND n <= 10 GROUP BY user_id)
SELECT user_id, rem_min, floor AS atonia_floor, md / floor AS rswa_tonic_tone_ratio, md / nm AS rswa_rem_nrem_ratio, tf AS rswa_tonic_fraction, coalesce(k, 0) / rem_min AS rswa_phasic_per_min, sd / md AS rswa_rem_rms_cv
FROM t LEFT JOIN n USING (user_id) LEFT JOIN p USING (user_id)""",
    dbl="rem_min atonia_floor rswa_tonic_tone_ratio rswa_rem_nrem_ratio rswa_tonic_fraction rswa_phasic_per_min rswa_rem_rms_cv",
)
def rem_atonia(spark, sf):
    df, ax = streams(spark, sf)
    w = df.select(*ax.part, "stage", F.col("epoch").alias("win"), (1.0 + F.col("value")).alias("rms"))
    return micro.rem_atonia(w, Axis(ax.keys, ("win",), ax.chunked), min_rem_min=0.05)


@query(
    "rms_windows",
    _SPLIT + """, m AS (SELECT rec, stage, CAST(epoch * 4 + n // 16 AS BIGINT) AS win, avg(v) AS m1, avg(v * v) AS m2 FROM smp GROUP BY ALL), u AS (SELECT rec, avg(m1) AS mu FROM m GROUP BY rec)
SELECT rec, stage, win, sqrt(greatest(m2 - 2 * mu * m1 + mu * mu, 0)) AS rms FROM m JOIN u USING (rec)""",
    dbl="rms",
    nd=8,
)
def rms_windows(spark, sf):
    e, _ = epochs(spark, sf)
    return micro.rms_windows(e, REC, win_s=0.25, epoch_s=1.0)


@query(
    "phase_coupling_circular",
    """WITH e AS (SELECT user_id, event_type, value / 20.0 AS ph FROM events), a AS (SELECT user_id, event_type, count(*) AS n, avg(cos(ph)) AS c, avg(sin(ph)) AS s FROM e GROUP BY ALL HAVING count(*) >= 8)
SELECT user_id, event_type, n AS n_spindles, sqrt(c * c + s * s) AS coupling_strength, c / sqrt(c * c + s * s) AS preferred_phase_cos, s / sqrt(c * c + s * s) AS preferred_phase_sin, n * (c * c + s * s) AS modulation FROM a""",
    dbl="coupling_strength preferred_phase_cos preferred_phase_sin modulation",
)
def phase_coupling_circular(spark, sf):
    e = read(spark, sf, "events").select("user_id", "event_type", (F.col("value") / 20.0).alias("ph"))
    return spectral.circular_summary(e, ["user_id", "event_type"], "ph")


@query(
    "stability_links",
    f"""WITH {STREAM_SQL}, l AS (SELECT user_id, epoch AS win, stage, k % 4 AS tau FROM streams), p AS (SELECT *, CASE WHEN abs(tau - lag(tau) OVER w) <= 1 THEN 0 ELSE 1 END AS cut FROM l WINDOW w AS (PARTITION BY user_id ORDER BY win)),
r AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY win) AS run FROM p), z AS (SELECT *, count(*) OVER (PARTITION BY user_id, run) AS len FROM r)
SELECT user_id, 'HR' AS i, 'RESP' AS j, stage, avg(CASE WHEN len >= 4 THEN 1.0 ELSE 0 END) AS strength, count(*) AS n_windows FROM z GROUP BY user_id, stage""",
    dbl="strength",
)
def stability_links(spark, sf):
    df, ax = streams(spark, sf)
    l = df.select("user_id", F.col("epoch").alias("win"), "stage", (F.col("k") % 4).alias("tau"), F.lit("HR").alias("i"), F.lit("RESP").alias("j"))
    return network.tds_links(l, USER, within=ax)


_MACRO = MACRO_DBL.split()
RESP_ORACLE, HRV_CONTRAST_SQL = UNROUNDED["respiratory_summary"], UNROUNDED["hrv_contrasts"]
_HC = ["rem_nrem_rmssd_ratio", "rem_nrem_hr_delta", "wake_sleep_hr_delta", "n3_wake_rmssd_ratio", "stage_hr_range", "stage_rmssd_cv"]
_RS = ["ahi", "rdi", "event_dur_mean_s", "event_dur_max_s"]


@query(
    "clinical_report",
    "SELECT m.user_id, n_epochs AS staging__n_epochs, " + ", ".join(f"m.{c} AS staging__{c}" for c in _MACRO) + ", " + ", ".join(f"r.{c} AS respiratory__{c}" for c in _RS)
    + ", " + ", ".join(f"h.{c} AS hrv__{c}" for c in _HC) + f" FROM ({MACRO_SQL}) m LEFT JOIN ({RESP_ORACLE}) r USING (user_id) LEFT JOIN ({HRV_CONTRAST_SQL}) h USING (user_id)",
    dbl=" ".join([f"staging__{c}" for c in _MACRO] + [f"respiratory__{c}" for c in _RS] + [f"hrv__{c}" for c in _HC]),
    nd=8,
)
def clinical_report(spark, sf):
    df, ax = streams(spark, sf)
    rr, rx = _rr(spark, sf)
    hours = df.groupBy("user_id").agg((F.count(F.lit(1)) / 3600.0).alias("hours"))
    resp = events.respiratory_summary(events.intervals(df, ax, "code", [1, 2, 4, 5]), hours, USER, within=ax).select("user_id", *_RS)
    heart = hrv.contrasts(hrv.time_domain(hrv.pooled(rr), rx, min_beats=8, bounded=not ax.chunked), USER)
    sections = {"staging": staging.macro_architecture(df, ax), "respiratory": resp, "hrv": heart}
    return report.assemble(hours, sections, USER)


@query(
    "stage_patches",
    f"""WITH {STREAM_SQL}, r AS (SELECT user_id, stage, epoch, value, sum(c) OVER (PARTITION BY user_id ORDER BY epoch) AS patch FROM
  (SELECT *, CASE WHEN lag(stage) OVER (PARTITION BY user_id ORDER BY epoch) = stage THEN 0 ELSE 1 END AS c FROM streams))
SELECT user_id, stage, CAST(patch AS BIGINT) AS patch, CAST(count(*) AS INT) AS n, sum(value) AS total FROM r GROUP BY ALL HAVING count(*) > 1""",
    dbl="total",
)
def stage_patches(spark, sf):
    df, ax = streams(spark, sf)
    sec = df.select("user_id", F.col("epoch").alias("sec"), "stage", F.lit("HR").alias("node"), "value")
    p = network.stage_patches(sec, USER, min_len=1, within=ax)
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x)
    return p.select("user_id", "stage", "patch", F.size("values").alias("n"), total.alias("total"))
