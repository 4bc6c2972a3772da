import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hypnolake.operators import hrv, micro, network, quality, spectral
from hypnolake.operators import signals as sg
from hypnolake.operators.ordered import with_axis

FS = 128.0


def epoch_frame(spark, data, fs=FS, stages=None, extra=None):
    """{rec: 1-D signal} cut into 30 s epochs."""
    rows = []
    for rec, x in data.items():
        step = int(fs * 30)
        for e in range(len(x) // step):
            rows.append((rec, e, stages[rec][e] if stages else 2, fs, [float(v) for v in x[e * step : (e + 1) * step]]))
    df = spark.createDataFrame(rows, "rec string, epoch int, stage int, fs double, samples array<float>")
    return with_axis(df, ["rec"], ("epoch",))


def test_each_sine_lands_in_its_band(spark):
    t = np.arange(int(30 * FS)) / FS
    tones = {"delta": 2, "theta": 6, "alpha": 10, "sigma": 14, "beta": 20}
    df, _ = epoch_frame(spark, {b: 10 * np.sin(2 * np.pi * f * t) for b, f in tones.items()})
    for r in spectral.band_powers(df).collect():
        assert r[f"rel_{r.rec}"] > 0.95
        assert r[f"abs_{r.rec}"] == pytest.approx(50, rel=0.05)  # amplitude 10 -> mean square 50


def test_short_and_slow_epochs_give_null(spark):
    df = spark.createDataFrame([("a", 0, 2, 128.0, [0.1] * 64), ("b", 0, 2, 40.0, [0.1] * 1200), ("c", 0, 2, 128.0, None)], "rec string, epoch int, stage int, fs double, samples array<float>")
    assert [r.abs_delta for r in spectral.band_powers(df).collect()] == [None] * 3


def test_aperiodic_exponent(spark):
    rng = np.random.default_rng(0)
    n = int(30 * FS)
    f = np.fft.rfftfreq(n, 1 / FS)
    spec = np.where(f > 0, np.maximum(f, 1e-9) ** -1.0, 0) * np.exp(2j * np.pi * rng.random(len(f)))
    df, _ = epoch_frame(spark, {"pink": np.fft.irfft(spec, n) * 1e4})
    assert spectral.spectral_shape(df).collect()[0].aper_exp == pytest.approx(2.0, abs=0.15)


def test_spindles_found_once_across_a_seam(spark, mode):
    rng = np.random.default_rng(1)
    n = int(300 * FS)
    t = np.arange(n) / FS
    x = rng.normal(0, 1, n)
    for at in (20.0, 59.5, 100.0, 200.0):  # the second one straddles the 60 s seam
        x += np.where((t >= at) & (t < at + 1), 40 * np.sin(2 * np.pi * 13 * t), 0)
    df, ax = epoch_frame(spark, {"r": x}, stages={"r": [2] * 10})
    ev = spectral.spindle_events(df, ax).orderBy("start_s").collect()
    assert [round(e.start_s) for e in ev] == [20, 60, 100, 200] or [round(e.start_s, 0) for e in ev] == [20, 59, 100, 200]
    assert all(0.8 < e.duration_s < 1.4 for e in ev)
    s = spectral.spindle_summary(spectral.spindle_events(df, ax), df.select("rec", "stage"), ["rec"]).collect()[0]
    assert s.n_spindles == 4 and s.density_per_min == pytest.approx(0.8)


def test_r_peaks_and_hrv(spark, mode):
    rng = np.random.default_rng(2)
    beats = np.cumsum(rng.uniform(0.8, 1.0, 130))
    t = np.arange(int(120 * FS)) / FS
    x = sum(np.exp(-0.5 * ((t - b) / 0.01) ** 2) for b in beats if b < 120) + rng.normal(0, 0.01, len(t))
    df, ax = epoch_frame(spark, {"r": x}, stages={"r": [2] * 4})
    got = np.sort([r.t for r in hrv.r_peaks(df, ax).collect()])
    inside = beats[(beats > 0.3) & (beats < 119.7)]
    assert all(np.abs(got - b).min() < 0.03 for b in inside) and len(got) <= len(inside) + 2
    rr = hrv.rr_intervals(hrv.r_peaks(df, ax), ax)
    h = {r.pool: r for r in hrv.time_domain(hrv.pooled(rr), ax).collect()}
    assert set(h) == {"n2", "nrem", "sleep"} and h["n2"].hr_mean == pytest.approx(60 / 0.9, rel=0.03)


def test_entropies_match_double_loop():
    x = np.random.default_rng(3).normal(size=120)

    def brute(x, m=2):
        n, tol = len(x) - m, 0.2 * x.std()
        count = lambda k: sum(max(abs(x[i : i + k] - x[j : j + k])) <= tol for i in range(n) for j in range(n) if i != j)
        return -np.log(count(m + 1) / count(m))

    assert sg.sample_entropy(x) == pytest.approx(brute(x))
    assert sg.permutation_entropy(np.arange(50.0)) == pytest.approx(0)
    assert sg.permutation_entropy(x) > 0.95 and sg.sample_entropy(np.ones(50)) is None


def test_dfa_matches_polyfit(spark, mode):
    x = np.cumsum(np.random.default_rng(4).normal(size=200)) * 10 + 900
    df = spark.createDataFrame([("r", i, 2, float(v)) for i, v in enumerate(x)], "rec string, t long, stage int, rr_ms double")
    df, ax = with_axis(df, ["rec"], ("t",))
    got = hrv.dfa(hrv.pooled(df, ("n2",)), ax, hrv.DFA_LONG, "a", 128).collect()[0].a
    y, ln, lf = np.cumsum(x - x.mean()), [], []
    for n in hrv.DFA_LONG:
        seg = y[: len(y) // n * n].reshape(-1, n)
        res = [s - np.polyval(np.polyfit(np.arange(n), s, 1), np.arange(n)) for s in seg]
        ln.append(np.log(n))
        lf.append(0.5 * np.log(np.mean(np.square(res))))
    assert got == pytest.approx(np.polyfit(ln, lf, 1)[0], abs=1e-6)


def test_hrv_windows_restart_after_each_window(spark):
    rr = [1000.0] * 10 + [500.0] * 4
    df = spark.createDataFrame([("r", float(i), 2, v) for i, v in enumerate(rr)], "rec string, t double, stage int, rr_ms double")
    got = hrv.windows(df, ["rec"], win_s=3.5, min_beats=2).orderBy("window_index").collect()
    assert [w.n_beats for w in got] == [4, 4, 5] and got[0].rmssd == 0.0  # the last beat alone is dropped


@pytest.mark.parametrize("stretch", [3600.0, 60.0, 7.0, 1.0])
def test_hrv_windows_do_not_depend_on_the_stretches(spark, stretch):
    """Against a plain loop over each stage's beats: windows longer and shorter than a stretch."""
    rng = np.random.default_rng(8)
    rows, t = [], {"a": 0.0, "b": 0.0}
    for i in range(600):
        rec, rr = "ab"[i % 2], float(np.round(rng.uniform(300, 2000), 3))
        t[rec] += rr / 1000
        rows.append((rec, t[rec], int(1 + (i // 90) % 3), rr))
    want = {}
    for rec in "ab":
        for stage in (1, 2, 3):
            k = total = 0
            for _, _, _, rr in [r for r in rows if r[0] == rec and r[2] == stage]:
                want.setdefault((rec, stage, k), []).append(rr)
                total += round(rr * 1000)
                if total >= 20_000_000:
                    k, total = k + 1, 0
    df = spark.createDataFrame(rows, "rec string, t double, stage int, rr_ms double").repartition(5)
    got = {(r.rec, r.stage, r.window_index): (r.n_beats, r.mean_nn) for r in hrv.windows(df, ["rec"], 20.0, 2, stretch).collect()}
    assert got == {k: (len(v), pytest.approx(np.mean(v))) for k, v in want.items() if len(v) >= 2}


def test_time_delay_stability_finds_the_coupled_stage(spark, mode):
    rng = np.random.default_rng(6)
    n = 1800
    a, b = rng.normal(size=n), rng.normal(size=n)
    half = n // 2
    b[half + 3 :] = a[half:-3] + 0.3 * b[half + 3 :]
    rows = [("r", i, 2 if i < half else 4, node, float(v[i])) for node, v in (("A", a), ("B", b)) for i in range(n)]
    sec = spark.createDataFrame(rows, "rec string, sec long, stage int, node string, value double")
    lags = network.window_lags(network.sliding_windows(sec, ["rec"]), ["rec"])
    links = {r.stage: r.strength for r in network.tds_links(lags, ["rec"]).collect()}
    assert links[4] > 0.9 and links[2] < 0.4


def test_directed_coupling_recovers_direction(spark):
    rng = np.random.default_rng(7)
    n = 600
    m = rng.normal(size=(n, 3))
    for i in range(2, n):
        m[i, 1] += 0.8 * m[i - 1, 0]
    rows = [("r", 2, 1, node, [float(v) for v in m[:, k]]) for k, node in enumerate(("breath", "heart", "eeg"))]
    p = spark.createDataFrame(rows, "rec string, stage int, patch long, node string, values array<double>")
    # columns are taken in node-name order
    g = {(r.caused, r.causing): r.g for r in network.directed_coupling(p, ["rec"]).collect()}
    assert g[("heart", "breath")] > 0.3 and abs(g[("breath", "heart")]) < 0.05 and abs(g[("eeg", "breath")]) < 0.05


def test_connectivity_of_identical_and_independent_channels(spark):
    rng = np.random.default_rng(8)
    n = int(30 * FS)
    rows = []
    for e in range(4):
        x = rng.normal(size=(4, n))
        x[1] = x[0] + 0.05 * x[1]
        rows += [("r", e, 2, FS, c, [float(v) for v in x[k]]) for k, c in enumerate(("a", "b", "c", "d"))]
    df = spark.createDataFrame(rows, "rec string, epoch int, stage int, fs double, channel string, samples array<float>")
    conn = network.connectivity(network.cross_spectra(network.montage(df, ["rec"]), ["rec"]), ["rec"]).where("band = 'beta'").collect()
    coh = {(r.i, r.j): r.coh for r in conn}
    assert coh[("a", "b")] > 0.9 and coh[("c", "d")] < coh[("a", "b")] - 0.2


def test_resampling_changes_only_wanted_roles(spark):
    t = np.arange(500 * 2) / 500
    rows = [("eeg", 500.0, [float(v) for v in np.sin(2 * np.pi * 5 * t)]), ("spo2", 500.0, [97.0] * 1000), ("eeg", 200.0, [1.0] * 400)]
    df = spark.createDataFrame(rows, "role string, fs double, samples array<float>")
    got = sg.resample_epochs(df, 200.0, roles=["eeg"]).collect()
    assert [(r.fs, len(r.samples)) for r in got] == [(200.0, 400), (500.0, 1000), (200.0, 400)]
    assert np.allclose(got[0].samples, np.sin(2 * np.pi * 5 * np.arange(400) / 200), atol=1e-4)


def test_quality_flags_a_dead_channel(spark):
    rng = np.random.default_rng(9)
    live = rng.normal(size=int(120 * FS))
    dead = live.copy()
    dead[: int(80 * FS)] = 0.0
    df, ax = epoch_frame(spark, {"live": live, "dead": dead})
    q = {r.rec: r for r in quality.channel_quality(df, ["rec"]).collect()}
    assert q["live"].flat_frac == 0 and q["dead"].flat_frac == pytest.approx(80 / 120, abs=0.02) and q["live"].nan_frac == 0


def test_moving_median_is_block_free(spark):
    x = np.random.default_rng(10).random(200)
    df = spark.createDataFrame([("r", i, float(v)) for i, v in enumerate(x)], "rec string, win long, v double")
    got = [r.m for r in micro.moving_median(df, ["rec"], "win", "v", "m", 5, block=16).orderBy("win").collect()]
    assert got == pytest.approx([np.median(x[max(0, i - 5) : i + 6]) for i in range(200)])


def test_rms_is_about_the_recording_mean(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(3, 2, int(60 * FS))
    df, _ = epoch_frame(spark, {"r": x})
    got = np.array([r.rms for r in micro.rms_windows(df, ["rec"]).orderBy("win").collect()])
    y = x.astype("float32").astype(float)
    assert got == pytest.approx(np.sqrt(((y - y.mean()) ** 2).reshape(-1, 64).mean(axis=1)), rel=1e-6)


def test_event_rates_and_arousal_overlap(spark, mode):
    beats = spark.createDataFrame([("r", 0.4 + 1.2 * i, 2) for i in range(10)], "rec string, t double, stage int")
    df, ax = with_axis(beats, ["rec"], ("t",))
    rate = network.event_seconds(df, ax, "HR").collect()
    assert {round(r.value, 6) for r in rate} == {50.0} and sorted(r.sec for r in rate) == list(range(1, 12))
    ph = spark.createDataFrame([("r", 2, 5, 1), ("r", 20, 22, 2)], "rec string, start_win int, end_win int, subtype int")
    ar = spark.createDataFrame([("r", 9.5, 11.0)], "rec string, start_s double, end_s double")
    got = {r.start_win: r.subtype for r in micro.arousal_overlap(ph, ar, ["rec"]).collect()}
    assert got == {2: 1, 20: 2}
    hit = micro.arousal_overlap(ph, ar.selectExpr("rec", "start_s - 3 AS start_s", "end_s"), ["rec"])
    assert {r.start_win: r.subtype for r in hit.collect()} == {2: 3, 20: 2}


def test_report_rejects_duplicate_keys(spark):
    from hypnolake.operators.joins import DuplicateKeys
    from hypnolake.operators.report import assemble

    base = spark.createDataFrame([("a",)], "rec string")
    with pytest.raises(DuplicateKeys):
        assemble(base, {"hrv": spark.createDataFrame([("a", 1.0), ("a", 2.0)], "rec string, v double")}, ["rec"])


@pytest.mark.parametrize("rate", [6, 8, 10, 12, 16, 20, 24, 30])
def test_breath_rate_of_sines(spark, rate):
    fs, n = 16.0, 12
    t = np.arange(int(30 * fs) * n) / fs
    x = np.sin(2 * np.pi * rate / 60 * t + 0.3).reshape(n, -1)
    e = spark.createDataFrame([("r", k, 2, fs, [float(v) for v in x[k]]) for k in range(n)], "rec string, epoch int, stage int, fs double, samples array<float>")
    e, ax = with_axis(e, ["rec"], ("epoch",))
    got = micro.respiratory_rate(micro.breath_intervals(micro.breath_times(e, ax), ax), ["rec"]).collect()[0]
    assert got.rate_mean == pytest.approx(rate, rel=0.02) and abs(got.n - rate * n / 2) <= 3


def test_microstates_go_on_across_epochs(spark):
    """One fixed topography through all epochs: one state, no transition, whatever the epoch length."""
    fs, n = 64.0, 6
    t = np.arange(int(2 * fs) * n) / fs
    wave = np.sin(2 * np.pi * 10 * t)
    leads = np.outer([1.0, -1.0, 0.5, -0.5], wave)
    rows = [("r", k, 2, fs, ["a", "b", "c", "d"] + (["e"] if k else []), [[float(v) for v in m[k * 128 : (k + 1) * 128]] for m in leads] + ([[0.0] * 128] if k else [])) for k in range(n)]
    m = spark.createDataFrame(rows, "rec string, epoch int, stage int, fs double, channels array<string>, x array<array<double>>")
    got = network.microstates(m, ["rec"], min_peaks=10, k=1).collect()[0]
    assert got.ms_trans_rate == 0.0 and got.ms_mean_dur_ms == pytest.approx(12_000) and got.ms_gev == pytest.approx(1.0, abs=1e-6)
    assert got.ms_coverage_entropy == 0.0 and got.ms_n_eff == 1.0  # the lead that one epoch lacks is left out, not the epoch


def test_microstates_switch(spark):
    """Two topographies that alternate every half second are told apart and counted."""
    fs, n = 64.0, 4
    t = np.arange(int(2 * fs) * n) / fs
    a, b = np.array([1.0, -1.0, 0.2, -0.2]), np.array([0.2, 0.2, 1.0, -1.4])
    slot = (t // 0.5).astype(int) % 2
    x = np.where(slot == 0, a[:, None], b[:, None]) * np.sin(2 * np.pi * 10 * t)
    rows = [("r", k, 2, fs, ["a", "b", "c", "d"], [[float(v) for v in m[k * 128 : (k + 1) * 128]] for m in x]) for k in range(n)]
    m = spark.createDataFrame(rows, "rec string, epoch int, stage int, fs double, channels array<string>, x array<array<double>>")
    got = network.microstates(m, ["rec"], min_peaks=10, k=2, band=(2.0, 25.0)).collect()[0]
    assert 1.5 <= got.ms_trans_rate <= 6.0 and 0.5 < got.ms_n_eff <= 4.0


def test_hrv_pieces_weigh_by_length(spark):
    """A short piece of another rhythm moves the power by its share of the time; too short a piece is not counted."""
    def beats(start, seconds, hz):
        out, t = [], 0.0
        while t < seconds:
            rr = 1000.0 + 50.0 * np.sin(2 * np.pi * hz * t)
            out.append(("r", "all", float(start + t), 2, float(rr)))
            t += rr / 1000.0
        return out

    whole, short, stub = beats(0.0, 295.0, 0.1), beats(300.0, 30.0, 0.25), beats(600.0, 10.0, 0.1)
    lf = {}
    for name, rows in {"a": whole, "b": short, "ab": whole + short, "abs": whole + short + stub}.items():
        df = spark.createDataFrame(rows, "rec string, pool string, t double, stage int, rr_ms double")
        got = hrv.frequency_domain(df, ["rec"], min_beats=20).collect()[0]
        lf[name] = got.lf
        assert got.n_beats == len(rows) - (len(stub) if name == "abs" else 0)
    assert lf["ab"] == pytest.approx((lf["a"] * 294 + lf["b"] * 29) / 323, rel=0.01) and lf["abs"] == lf["ab"]


def test_kernels_hold_few_epochs_at_once(spark, monkeypatch):
    """Stacks are bounded whatever the batch, and cross-spectra leave a task in pieces."""
    from hypnolake.operators import signals

    monkeypatch.setattr(signals, "SAMPLES_AT_ONCE", 20)
    x = pd.Series([np.arange(8.0) + k for k in range(7)] + [None, np.arange(30.0)])
    got = list(signals.stacks(x, pd.Series([1.0] * 9)))
    assert [len(i) for i, r, _ in got if r.shape[1] == 8] == [2, 2, 2, 1] and all(r.shape[0] == 1 or r.size <= 20 for _, r, _ in got)
    assert sorted(int(i) for idx, _, _ in got for i in idx) == [0, 1, 2, 3, 4, 5, 6, 8]
    rng = np.random.default_rng(3)
    rows = [(k, k, 2, 64.0, c, [float(v) for v in rng.normal(size=64)]) for k in range(200) for c in "abc"]
    df = spark.createDataFrame(rows, "rec int, epoch int, stage int, fs double, channel string, samples array<float>").coalesce(1)
    found = network.cross_spectra(network.montage(df, ["rec"]).coalesce(1), ["rec"], seg_s=0.5)
    bins = found.select("hz").distinct().count()
    assert found.count() == 200 * 3 * bins and found.groupBy("rec", "i", "j", "hz").count().where("count > 1").isEmpty()


def test_recovery_of_short_long_and_repeated_events(spark):
    """Windows inside one span, beyond one, and two events of one start, against the definition."""
    from hypnolake.operators import events

    rng = np.random.default_rng(8)
    value = {(u, s): float(np.round(90 + 8 * rng.random(), 1)) for u in "ab" for s in range(900) if rng.random() < 0.9}
    spo2 = spark.createDataFrame([(u, s, v) for (u, s), v in value.items()] + [("a", 900, None)], "u string, sec long, value double")
    ev = [("a", 40, 55), ("a", 149, 151), ("a", 200, 700), ("b", 10, 20), ("b", 10, 30), ("b", 300, 420), ("b", 880, 890), ("b", 0, 5)]
    got = {(r.u, r.start_s): r for r in events.post_event_recovery(spark.createDataFrame(ev, "u string, start_s long, end_s long"), spo2, ["u"]).collect()}
    want = {}
    for u, a in {(u, a) for u, a, _ in ev}:
        inside = [(value[u, s], s) for w, x, e in ev if (w, x) == (u, a) for s in range(a - 30, e + 45) if (u, s) in value]
        pre, post = [v for v, s in inside if s < a], [c for c in inside if c[1] >= a]
        if pre and post:
            base, nadir = float(np.median(pre)), min(post)[1]
            back = [s for v, s in post if s >= nadir and v >= base - 1]
            want[u, a] = (base, max(post)[0] - base, float(min(back) - nadir) if back else None)
    assert set(got) == set(want) and len(want) == 6
    for k, (base, over, rec) in want.items():
        assert got[k].baseline == pytest.approx(base) and got[k].overshoot == pytest.approx(over) and got[k].recovery_s == rec
