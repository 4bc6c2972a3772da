import numpy as np
import pytest

from hypnolake.operators import events, oxygen, staging
from hypnolake.operators.ordered import with_axis


def stream(spark, codes, name="stage", key="epoch"):
    rows = [(rec, i, float(c)) for rec, seq in codes.items() for i, c in enumerate(seq)]
    return with_axis(spark.createDataFrame(rows, f"rec string, {key} long, {name} double"), ["rec"], (key,))


BASIC = {"basic": [5, 5, 3, 2, 2, 1, 1, 4, 5, 2, 9, 2], "spike": [2, 2, 5, 2, 2], "unscored": [9, 9, 9], "one": [2], "wake": [5, 5, 5]}


def test_macro_architecture(spark, mode):
    df, ax = stream(spark, BASIC)
    r = {x.rec: x for x in staging.macro_architecture(df, ax).collect()}
    b = r["basic"]
    assert b.sleep_latency_min == 1.0 and b.waso_min == 0.5 and b.rem_latency_min == 2.5 and b.n3_latency_min == 1.5
    assert b.sleep_efficiency_pct == pytest.approx(100 * 8 / 12) and b.pct_unknown_epochs == pytest.approx(100 / 12)
    assert r["unscored"].pct_wake is None and r["unscored"].sleep_latency_min is None
    assert r["wake"].tst_min == 0 and r["wake"].waso_min is None and r["wake"].stage_entropy == 0
    whole = {x.rec: x.waso_min for x in staging.macro_architecture(df, ax, waso_end="recording").collect()}
    assert whole["basic"] == 0.5


def test_transitions_drop_unknown_and_rows_sum_to_one(spark, mode):
    df, ax = stream(spark, BASIC)
    edges = staging.transition_edges(df, ax)
    got = {(e["from"], e["to"]): e.n for e in edges.where("rec = 'basic'").collect()}
    assert got[(2, 2)] == 2 and sum(got.values()) == 10
    p = staging.transition_probabilities(edges, ["rec"]).groupBy("rec", "from").sum("p").collect()
    assert all(x[2] == pytest.approx(1) for x in p)
    prof = {x.rec: x for x in staging.transition_profile(edges, ["rec"]).collect()}
    assert prof["wake"].trans_p_wake_wake == 1 and prof["wake"].trans_entropy_wake == pytest.approx(0)
    assert prof["basic"].trans_stability_index == pytest.approx(4 / 10)


def test_fragmentation(spark, mode):
    df, ax = stream(spark, BASIC)
    r = {x.rec: x for x in staging.fragmentation(df, ax).collect()}
    assert r["basic"].n_awakenings == 1 and r["basic"].brief_wake_intrusions == 1 and r["basic"].n_rem_periods == 1
    assert r["spike"].single_epoch_spikes == 1 and r["spike"].n_sleep_bouts == 2
    assert "one" not in r and "unscored" not in r


def naive_smooth(codes, min_bout):
    """Plain restatement of the rule, one merge per scan."""
    out = list(codes)
    while True:
        cuts = [0] + [i for i in range(1, len(out)) if out[i] != out[i - 1]] + [len(out)]
        seg = list(zip(cuts[:-1], cuts[1:]))
        best = None
        for k in range(1, len(seg) - 1):
            a, b = seg[k]
            around = [out[seg[k - 1][0]], out[seg[k + 1][0]]]
            if out[a] != 9 and b - a < min_bout and around != [9, 9] and (best is None or b - a < best[0]):
                best = (b - a, k)
        if best is None:
            return out
        a, b = seg[best[1]]
        (la, lb), (ra, rb) = seg[best[1] - 1], seg[best[1] + 1]
        left, right = out[la], out[ra]
        pick = left if right == 9 or (left != 9 and lb - la >= rb - ra) else right
        out[a:b] = [pick] * (b - a)


@pytest.mark.parametrize("min_bout", [2, 4])
def test_smoothing_matches_naive(spark, mode, min_bout):
    rng = np.random.default_rng(5)
    codes = {f"r{i}": rng.choice([1, 2, 3, 4, 5, 9], n, p=[0.2, 0.3, 0.1, 0.1, 0.2, 0.1]).tolist() for i, n in enumerate((40, 25, 3, 1, 60))}
    codes["spike"] = BASIC["spike"]
    df, ax = stream(spark, codes)
    bouts = staging.smooth_bouts(df, ax, min_bout=min_bout).toPandas()
    for rec, seq in codes.items():
        b = bouts[bouts.rec == rec].sort_values("run")
        assert np.repeat(b.clean_stage.to_numpy(), b.n.to_numpy()).tolist() == naive_smooth(seq, min_bout)
    rep = {x.rec: x for x in staging.staging_report(staging.smooth_bouts(df, ax, min_bout=min_bout), ["rec"], within=ax).collect()}
    assert rep["spike"].n_changed == 1 and rep["spike"].transitions_removed == 2


def test_respiratory_events(spark, mode):
    df, ax = stream(spark, {"r": [0, 1, 1, 1, 0, 0, 4, 4, 5]}, "code", "idx")
    iv = events.intervals(df, ax, "code", [1, 2, 4, 5])
    hours = spark.createDataFrame([("r", 1.0)], "rec string, hours double")
    r = events.respiratory_summary(iv, hours, ["rec"], within=ax).collect()[0]
    assert (r.n_apnea_hypopnea, r.ahi, r.rdi, r.n_rera) == (2, 2.0, 3.0, 1)
    assert sorted(x.dur_s for x in iv.collect()) == [1.0, 2.0, 3.0] and r.event_dur_median_s == 2.5


def test_spo2_scale_and_dips(spark, mode):
    pct = [96.0] * 600
    pct[100:110] = [91.0] * 10
    pct[300:303] = [91.0] * 3
    pct[50], pct[51] = 0.0, 255.0
    rows = [("pct", i, v) for i, v in enumerate(pct)] + [("frac", i, v / 100) for i, v in enumerate(pct)]
    df, ax = with_axis(spark.createDataFrame(rows, "rec string, idx long, value double"), ["rec"], ("idx",))
    norm = oxygen.normalise(df, ["rec"], within=ax)
    out = {r.rec: r for r in oxygen.oxygenation(norm, oxygen.desaturations(norm, ax), ["rec"], within=ax).collect()}
    for rec in ("pct", "frac"):
        assert out[rec].n_desat == 1 and out[rec].desat_depth_max == pytest.approx(5.0)
        assert out[rec].hb_pctmin_total == pytest.approx((5 * 10 - 5) / 60)
        assert out[rec].spo2_mean == pytest.approx(out["pct"].spo2_mean)
