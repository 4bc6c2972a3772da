"""Stage, event and oxygen stream queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events as ev
from ..operators import oxygen, staging
from ..operators.joins import align_rates, nearest_resample
from ..operators.ordered import Axis, forward_fill, merge_gaps, rising_edges, runs, shift
from ..vocab import STAGES
from .registry import query
from .tables import STREAM_SQL, USER, streams

SCORED = f"""WITH {STREAM_SQL},
scored AS (SELECT * FROM streams WHERE stage <> 9),
nb AS (SELECT *, lag(stage) OVER w AS prv, lead(stage) OVER w AS nxt FROM scored
       WINDOW w AS (PARTITION BY user_id ORDER BY epoch)),
edges AS (SELECT user_id, stage AS src, nxt AS dst, count(*) AS n FROM nb WHERE nxt IS NOT NULL GROUP BY ALL),
rowsum AS (SELECT user_id, src, sum(n) AS row_n FROM edges GROUP BY ALL)"""
TAGS = list(STAGES.items())


def _runs_sql(src: str, state: str, where: str = "TRUE") -> str:
    """Island text shared by the oracles: one row per run with first/last epoch and n."""
    return f"""
    SELECT user_id, {state}, run, count(*) AS n, min(epoch) AS first_epoch, max(epoch) AS last_epoch FROM (
      SELECT *, sum(chg) OVER (PARTITION BY user_id ORDER BY epoch) - 1 AS run FROM (
        SELECT *, CASE WHEN lag({state}) OVER (PARTITION BY user_id ORDER BY epoch) IS DISTINCT FROM {state}
                       THEN 1 ELSE 0 END AS chg FROM {src} WHERE {where}))
    GROUP BY user_id, {state}, run"""


# ------------------------------------------------------------------ transitions
@query(
    "transition_edges",
    SCORED + "\nSELECT user_id, src AS \"from\", dst AS \"to\", n, CAST(row_n AS BIGINT) AS row_n, n / row_n AS p FROM edges JOIN rowsum USING (user_id, src)",
    dbl="p",
)
def transition_edges(spark, sf):
    df, ax = streams(spark, sf)
    return staging.transition_probabilities(staging.transition_edges(df, ax), USER)


_P = ",\n".join(
    f"sum(CASE WHEN src = {a} AND dst = {b} THEN n ELSE 0 END) / CAST(max(CASE WHEN src = {a} THEN row_n END) AS DOUBLE) AS trans_p_{s}_{t}"
    for a, s in TAGS
    for b, t in TAGS
)
_H = ",\n".join(f"max(CASE WHEN src = {a} THEN h END) AS trans_entropy_{s}" for a, s in TAGS)


@query(
    "transition_profile",
    f"""{SCORED},
ent AS (SELECT e.user_id, e.src, any_value(row_n) AS row_n, -sum(n / row_n * ln(n / row_n)) / ln(5) AS h,
               sum(CASE WHEN e.src = dst THEN n ELSE 0 END) AS diag
        FROM edges e JOIN rowsum r USING (user_id, src) GROUP BY ALL),
pp AS (SELECT user_id, {_P} FROM edges JOIN rowsum USING (user_id, src) GROUP BY user_id),
hh AS (SELECT user_id, {_H}, sum(row_n * h) / sum(row_n) AS trans_entropy_rate, sum(diag) / sum(row_n) AS trans_stability_index
       FROM ent GROUP BY user_id)
SELECT * FROM pp JOIN hh USING (user_id)""",
    dbl=" ".join(
        [f"trans_p_{s}_{t}" for _, s in TAGS for _, t in TAGS]
        + [f"trans_entropy_{s}" for _, s in TAGS]
        + ["trans_entropy_rate", "trans_stability_index"]
    ),
)
def transition_profile(spark, sf):
    df, ax = streams(spark, sf)
    return staging.transition_profile(staging.transition_edges(df, ax), USER)


@query(
    "transition_matrix_pivot",
    SCORED + "\nSELECT user_id, src AS \"from\", "
    + ", ".join(f"CAST(sum(CASE WHEN dst = {c} THEN n ELSE 0 END) AS BIGINT) AS to_{t}" for c, t in TAGS)
    + " FROM edges GROUP BY user_id, src",
)
def transition_matrix_pivot(spark, sf):
    df, ax = streams(spark, sf)
    return staging.pivot_matrix(staging.transition_edges(df, ax), USER)


@query(
    "cohort_transition_matrix",
    SCORED + """,
cells AS (SELECT r.user_id, r.src, s.dst, row_n, coalesce(e.n, 0) AS n FROM rowsum r
          CROSS JOIN (SELECT unnest([1,2,3,4,5]) AS dst) s LEFT JOIN edges e ON e.user_id = r.user_id AND e.src = r.src AND e.dst = s.dst)
SELECT user_id % 2 AS arm, src AS "from", dst AS "to", count(*) AS n_recordings, avg(n / row_n) AS mean_p,
       CAST(sum(n) AS BIGINT) AS n, sum(n) / sum(row_n) AS pooled_p FROM cells GROUP BY ALL""",
    dbl="mean_p pooled_p",
)
def cohort_transition_matrix(spark, sf):
    df, ax = streams(spark, sf)
    edges = staging.transition_edges(df, ax).withColumn("arm", F.col("user_id") % 2)
    return staging.cohort_matrix(edges, USER, ["arm"])


# ------------------------------------------------------------------ runs, bouts, rates
@query("runs_gaps_and_islands", f"WITH {STREAM_SQL} SELECT user_id, stage, CAST(run AS BIGINT) AS run, n, first_epoch, last_epoch FROM ({_runs_sql('streams', 'stage')})")
def runs_gaps_and_islands(spark, sf):
    df, ax = streams(spark, sf)
    return runs(df, ax, "stage")


@query(
    "rising_edge_rate",
    f"""WITH {STREAM_SQL}, m AS (SELECT user_id, epoch, CASE WHEN code > 0 THEN 1 ELSE 0 END AS b FROM streams)
SELECT user_id, CAST(sum(CASE WHEN b = 1 AND p = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_events, count(*) AS n_samples,
       sum(CASE WHEN b = 1 AND p = 0 THEN 1 ELSE 0 END) * 3600.0 / count(*) AS rate_per_hour
FROM (SELECT *, coalesce(lag(b) OVER (PARTITION BY user_id ORDER BY epoch), 0) AS p FROM m) GROUP BY user_id""",
    dbl="rate_per_hour",
)
def rising_edge_rate(spark, sf):
    df, ax = streams(spark, sf)
    return rising_edges(df, ax, F.col("code") > 0).withColumn("rate_per_hour", F.col("n_events") * 3600.0 / F.col("n_samples"))


@query(
    "bout_statistics",
    SCORED + f""", b AS ({_runs_sql('scored', 'stage')}),
a AS (SELECT user_id, stage, count(*) AS n_bouts, avg(n) * 0.5 AS mean_bout_min, max(n) * 0.5 AS max_bout_min,
             CAST(sum(n) AS BIGINT) AS n_stage_epochs FROM b GROUP BY ALL)
SELECT *, n_stage_epochs / sum(n_stage_epochs) OVER (PARTITION BY user_id) AS fraction, n_bouts / n_stage_epochs AS fragmentation FROM a""",
    dbl="mean_bout_min max_bout_min fraction fragmentation",
)
def bout_statistics(spark, sf):
    df, ax = streams(spark, sf)
    return staging.bout_statistics(df, ax)


@query(
    "longest_bout_windows",
    f"""WITH {STREAM_SQL}, b AS ({_runs_sql('streams', 'stage')}),
best AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY user_id, stage ORDER BY n DESC, first_epoch) = 1)
SELECT DISTINCT user_id, stage, first_epoch, n, CAST(first_epoch + floor(j * greatest(n - 2, 0) / 2) AS BIGINT) AS window_start
FROM best CROSS JOIN (SELECT unnest([0, 1, 2]) AS j)""",
)
def longest_bout_windows(spark, sf):
    df, ax = streams(spark, sf)
    best = ev.longest_bout(runs(df, ax, "stage"), USER, "stage", "first_epoch")
    return ev.even_windows(best, 3, 2)


# ------------------------------------------------------------------ macro, fragmentation
_CNT = ", ".join(f"count(*) FILTER (stage = {c}) AS n_{t}" for c, t in TAGS)
_PCT = ", ".join(f"CASE WHEN ns > 0 THEN 100.0 * n_{t} / ns END AS pct_{t}" for _, t in TAGS)
_ENT = " + ".join(f"CASE WHEN n_{t} > 0 THEN -(n_{t} / ns) * ln(n_{t} / ns) ELSE 0 END" for _, t in TAGS)
_PRES = " + ".join(f"CAST(n_{t} > 0 AS INT)" for _, t in TAGS)
MACRO_SQL = SCORED + f""",
base AS (SELECT user_id, count(*) AS n_epochs, count(*) FILTER (stage = 9) AS n_unknown, count(*) FILTER (stage <> 9) AS ns,
  count(*) FILTER (stage IN (1,2,3,4)) AS n_asleep, {_CNT}, min(epoch) FILTER (stage IN (1,2,3,4)) AS onset,
  max(epoch) FILTER (stage IN (1,2,3,4)) AS offs, min(epoch) FILTER (stage = 4) AS rem, min(epoch) FILTER (stage = 1) AS n3
  FROM streams GROUP BY user_id),
mv AS (SELECT user_id, count(*) FILTER (stage <> nxt) AS tr FROM nb GROUP BY user_id),
ws AS (SELECT s.user_id, count(*) AS waso FROM streams s JOIN base b USING (user_id)
       WHERE s.stage = 5 AND s.epoch BETWEEN b.onset AND b.offs GROUP BY ALL)
SELECT user_id, n_epochs, n_epochs * 30 / 3600.0 AS duration_hours, 100.0 * n_unknown / n_epochs AS pct_unknown_epochs, {_PCT},
  n_asleep * 0.5 AS tst_min, 100.0 * n_asleep / n_epochs AS sleep_efficiency_pct, onset * 0.5 AS sleep_latency_min,
  CASE WHEN onset IS NOT NULL THEN coalesce(waso, 0) * 0.5 END AS waso_min, (rem - onset) * 0.5 AS rem_latency_min,
  (n3 - onset) * 0.5 AS n3_latency_min, coalesce(tr, 0) / (n_epochs * 30 / 3600.0) AS transitions_per_hr,
  CASE WHEN {_PRES} > 1 THEN ({_ENT}) / ln({_PRES}) ELSE 0.0 END AS stage_entropy
FROM base LEFT JOIN mv USING (user_id) LEFT JOIN ws USING (user_id)"""
MACRO_DBL = (
    "duration_hours pct_unknown_epochs " + " ".join(f"pct_{t}" for _, t in TAGS)
    + " tst_min sleep_efficiency_pct sleep_latency_min waso_min rem_latency_min n3_latency_min transitions_per_hr stage_entropy"
)


@query("stage_macro_architecture", MACRO_SQL, dbl=MACRO_DBL)
def stage_macro_architecture(spark, sf):
    df, ax = streams(spark, sf)
    return staging.macro_architecture(df, ax)


NAMED = ((5, 3), (3, 2), (2, 1), (2, 4), (4, 5), (2, 5))
_NAMED = ", ".join(
    f"count(*) FILTER (stage = {a} AND nxt = {b}) / tst AS trans_{STAGES[a]}_to_{STAGES[b]}_per_hr" for a, b in NAMED
)
FRAG_SQL = SCORED + f""",
c AS (SELECT *, CASE WHEN stage = 5 THEN 0 ELSE 1 END AS coarse FROM scored),
cb AS ({_runs_sql('c', 'coarse')}),
bt AS (SELECT user_id, count(*) FILTER (coarse = 0) AS n_wake_bouts, count(*) FILTER (coarse = 1) AS n_sleep_bouts,
   avg(n) FILTER (coarse = 1) * 0.5 AS mean_sleep_bout_min, avg(n) FILTER (coarse = 0) * 0.5 AS mean_wake_bout_min FROM cb GROUP BY user_id),
t AS (SELECT user_id, nullif(count(*) FILTER (stage <> 5), 0) * 30 / 3600.0 AS tst FROM scored GROUP BY user_id HAVING count(*) >= 2)
SELECT user_id, count(*) FILTER (stage <> 5 AND nxt = 5) AS n_awakenings,
  count(*) FILTER (stage <> 5 AND nxt = 5) / tst AS awakenings_per_hr_sleep,
  count(*) FILTER (stage = 5 AND prv <> 5 AND nxt <> 5) AS brief_wake_intrusions,
  count(*) FILTER (stage <> nxt) / tst AS stage_shift_index,
  count(*) FILTER (stage <> prv AND stage <> nxt AND prv = nxt) AS single_epoch_spikes,
  count(*) FILTER (stage <> prv AND stage <> nxt AND prv = nxt) / tst AS spikes_per_hr_sleep,
  any_value(n_wake_bouts) AS n_wake_bouts, any_value(n_sleep_bouts) AS n_sleep_bouts,
  any_value(mean_sleep_bout_min) AS mean_sleep_bout_min, any_value(mean_wake_bout_min) AS mean_wake_bout_min,
  count(*) FILTER (stage = 4 AND prv IS DISTINCT FROM 4) AS n_rem_periods, {_NAMED}
FROM nb JOIN t USING (user_id) JOIN bt USING (user_id) GROUP BY user_id, tst"""
FRAG_FIELDS = ["n_awakenings", "awakenings_per_hr_sleep", "brief_wake_intrusions", "stage_shift_index", "single_epoch_spikes",
               "spikes_per_hr_sleep", "n_wake_bouts", "n_sleep_bouts", "mean_sleep_bout_min", "mean_wake_bout_min", "n_rem_periods"]
FRAG_DBL = "awakenings_per_hr_sleep stage_shift_index spikes_per_hr_sleep mean_sleep_bout_min mean_wake_bout_min " + " ".join(
    f"trans_{STAGES[a]}_to_{STAGES[b]}_per_hr" for a, b in NAMED
)


@query("fragmentation", FRAG_SQL, dbl=FRAG_DBL)
def fragmentation(spark, sf):
    df, ax = streams(spark, sf)
    return staging.fragmentation(df, ax, named=NAMED)


@query(
    "dynamics_vs_cohort",
    f"""SELECT user_id, metric, value, avg(value) OVER (PARTITION BY metric) AS cohort_mean,
  stddev_pop(value) OVER (PARTITION BY metric) AS cohort_sd, value - avg(value) OVER (PARTITION BY metric) AS delta
FROM (UNPIVOT (SELECT user_id, {', '.join(f'CAST({f} AS DOUBLE) AS {f}' for f in FRAG_FIELDS)} FROM ({FRAG_SQL}))
      ON {', '.join(FRAG_FIELDS)} INTO NAME metric VALUE value)""",
    dbl="value cohort_mean cohort_sd delta",
)
def dynamics_vs_cohort(spark, sf):
    df, ax = streams(spark, sf)
    return staging.against_cohort(staging.fragmentation(df, ax), USER, FRAG_FIELDS).where("value is not null")


# ------------------------------------------------------------------ smoothing (W10, W11): order-dependent, no SQL form
@query("smoothed_bouts")
def smoothed_bouts(spark, sf):
    df, ax = streams(spark, sf)
    return staging.smooth_bouts(df.select(*ax.part, "epoch", "stage"), ax)


@query("staging_report", dbl="pct_changed")
def staging_report(spark, sf):
    df, ax = streams(spark, sf)
    return staging.staging_report(staging.smooth_bouts(df.select(*ax.part, "epoch", "stage"), ax), USER, within=ax)


# ------------------------------------------------------------------ coded events
EVENTS_SQL = f"""WITH {STREAM_SQL}, iv AS (SELECT user_id, code, CAST(first_epoch AS DOUBLE) AS start_s,
  CAST(last_epoch + 1 AS DOUBLE) AS end_s, CAST(n AS DOUBLE) AS dur_s FROM ({_runs_sql('streams', 'code')}))"""


def _events(spark, sf, codes):
    df, ax = streams(spark, sf)
    return df, ax, ev.intervals(df, ax, "code", codes)


@query(
    "event_indices",
    EVENTS_SQL + """, h AS (SELECT user_id, count(*) FILTER (stage IN (1,2,3,4)) * 30 / 3600.0 AS hours FROM streams GROUP BY user_id)
SELECT user_id, CASE WHEN hours > 0 THEN count(*) FILTER (code IN (1,2,4)) / hours END AS ahi,
  CASE WHEN hours > 0 THEN count(*) FILTER (code IN (1,2,4,5)) / hours END AS rdi,
  CASE WHEN hours > 0 THEN count(*) FILTER (code = 1) / hours END AS obstructive_idx,
  CASE WHEN hours > 0 THEN count(*) FILTER (code = 2) / hours END AS central_idx
FROM h JOIN iv USING (user_id) GROUP BY user_id, hours""",
    dbl="ahi rdi obstructive_idx central_idx",
)
def event_indices(spark, sf):
    df, ax, iv = _events(spark, sf, None)
    hours = df.groupBy("user_id").agg((F.sum(F.col("stage").isin(1, 2, 3, 4).cast("long")) * 30 / 3600.0).alias("hours"))
    sets = {"ahi": (1, 2, 4), "rdi": (1, 2, 4, 5), "obstructive_idx": (1,), "central_idx": (2,)}
    return ev.event_index(iv, hours, USER, sets)


_AIDX = ", ".join(
    f"CASE WHEN count(*) FILTER (stage = {c}) > 0 THEN coalesce(any_value(n_{t}), 0) / (count(*) FILTER (stage = {c}) / 120.0) END AS arousal_idx_{t}"
    for c, t in TAGS
)


@query(
    "arousal_distribution",
    EVENTS_SQL + f""", ar AS (SELECT *, CAST(floor(start_s / 30) AS BIGINT) AS ep FROM iv WHERE code = 1),
d AS (SELECT user_id, count(*) AS n_arousals, avg(dur_s) AS arousal_dur_mean_s, median(dur_s) AS arousal_dur_median_s,
  CASE WHEN count(*) > 1 THEN stddev_pop(dur_s) END AS arousal_dur_sd_s, max(dur_s) AS arousal_dur_max_s FROM ar GROUP BY user_id),
g AS (SELECT user_id, avg(gap) AS arousal_iai_mean_s, median(gap) AS arousal_iai_median_s, stddev_pop(gap) / avg(gap) AS arousal_iai_cv
  FROM (SELECT user_id, start_s - lag(start_s) OVER (PARTITION BY user_id ORDER BY start_s) AS gap FROM ar) WHERE gap IS NOT NULL
  GROUP BY user_id HAVING count(*) >= 2),
ons AS (SELECT a.user_id, {', '.join(f'count(*) FILTER (s.stage = {c}) AS n_{t}' for c, t in TAGS)}
  FROM ar a JOIN streams s ON a.user_id = s.user_id AND a.ep = s.epoch GROUP BY a.user_id),
ix AS (SELECT s.user_id, {_AIDX} FROM streams s LEFT JOIN ons USING (user_id) GROUP BY s.user_id)
SELECT * FROM d LEFT JOIN g USING (user_id) LEFT JOIN ix USING (user_id)""",
    dbl="arousal_dur_mean_s arousal_dur_median_s arousal_dur_sd_s arousal_dur_max_s arousal_iai_mean_s arousal_iai_median_s arousal_iai_cv "
    + " ".join(f"arousal_idx_{t}" for _, t in TAGS),
)
def arousal_distribution(spark, sf):
    df, ax, iv = _events(spark, sf, [1])
    return ev.arousal_distribution(iv, df.select("user_id", "epoch", "stage"), USER, within=ax)


@query(
    "respiratory_summary",
    EVENTS_SQL + """, h AS (SELECT user_id, count(*) / 3600.0 AS hours FROM streams GROUP BY user_id),
ev AS (SELECT user_id, """
    + ", ".join(
        f"count(*) FILTER (code = {c}) AS n_{n}, avg(dur_s) FILTER (code = {c}) AS {n}_dur_mean_s, max(dur_s) FILTER (code = {c}) AS {n}_dur_max_s"
        for c, n in ((1, "obstructive_apnea"), (2, "central_apnea"), (4, "hypopnea"), (5, "rera"))
    )
    + """, count(*) FILTER (code IN (1,2,4)) AS n_apnea_hypopnea, avg(dur_s) FILTER (code IN (1,2,4)) AS event_dur_mean_s,
  max(dur_s) FILTER (code IN (1,2,4)) AS event_dur_max_s, median(dur_s) FILTER (code IN (1,2,4)) AS event_dur_median_s,
  count(*) FILTER (code IN (1,2,4,5)) AS nr FROM iv GROUP BY user_id)
SELECT ev.* EXCLUDE (nr), n_apnea_hypopnea / hours AS ahi, nr / hours AS rdi FROM h JOIN ev USING (user_id)""",
    dbl="obstructive_apnea_dur_mean_s obstructive_apnea_dur_max_s central_apnea_dur_mean_s central_apnea_dur_max_s hypopnea_dur_mean_s "
    "hypopnea_dur_max_s rera_dur_mean_s rera_dur_max_s event_dur_mean_s event_dur_max_s event_dur_median_s ahi rdi",
)
def respiratory_summary(spark, sf):
    df, ax, iv = _events(spark, sf, [1, 2, 4, 5])
    hours = df.groupBy("user_id").agg((F.count(F.lit(1)) / 3600.0).alias("hours"))
    return ev.respiratory_summary(iv, hours, USER, within=ax)


@query(
    "event_clustering",
    EVENTS_SQL + """, e AS (SELECT *, start_s - lag(start_s) OVER (PARTITION BY user_id ORDER BY start_s) AS gap FROM iv WHERE code = 2),
g AS (SELECT *, CASE WHEN gap <= 6 THEN 1 ELSE 0 END AS near FROM e WHERE gap IS NOT NULL),
g2 AS (SELECT *, CASE WHEN near = 1 AND coalesce(lag(near) OVER (PARTITION BY user_id ORDER BY start_s), 0) = 0 THEN 1 ELSE 0 END AS op FROM g),
a AS (SELECT user_id, count(*) AS ng, median(gap) AS idi_median_s, stddev_pop(gap) / avg(gap) AS idi_cv,
   CASE WHEN count(*) >= 3 THEN var_pop(gap) / avg(gap) END AS fano, sum(near) AS sn, sum(op) AS n_clusters FROM g2 GROUP BY user_id HAVING count(*) >= 2),
h AS (SELECT user_id, count(*) / 3600.0 AS hours FROM streams GROUP BY user_id)
SELECT user_id, idi_median_s, idi_cv, fano, least(sn + n_clusters, ng + 1) / (ng + 1) AS cluster_frac, CAST(n_clusters AS BIGINT) AS n_clusters,
  1 - least(sn + n_clusters, ng + 1) / (ng + 1) AS isolated_frac, (ng + 1) / hours AS rate_per_h, (idi_cv - 1) / (idi_cv + 1) AS burstiness
FROM a JOIN h USING (user_id)""",
    dbl="idi_median_s idi_cv fano cluster_frac isolated_frac rate_per_h burstiness",
)
def event_clustering(spark, sf):
    df, ax, iv = _events(spark, sf, [2])
    hours = df.groupBy("user_id").agg((F.count(F.lit(1)) / 3600.0).alias("hours"))
    return ev.clustering(iv, hours, USER, gap_s=6.0, within=ax)


@query(
    "interval_shape",
    EVENTS_SQL + """, g AS (SELECT * FROM (SELECT *, start_s - lag(start_s) OVER (PARTITION BY user_id ORDER BY start_s) AS gap FROM iv WHERE code IN (1,2))
  WHERE gap > 1 AND gap < 15)
SELECT user_id, count(*) + 1 AS n_events, median(gap) AS median_s, stddev_pop(gap) / avg(gap) AS cv, skewness(gap) AS skew,
  kurtosis(gap) AS kurtosis, 60 / avg(gap) AS rate_per_min FROM g GROUP BY user_id HAVING count(*) >= 5""",
    dbl="median_s cv skew kurtosis rate_per_min",
)
def interval_shape(spark, sf):
    df, ax, iv = _events(spark, sf, [1, 2])
    return ev.interval_shape(ev.gaps_between(iv, USER, within=ax), USER, min_n=5, within=ax)


@query(
    "limb_periodicity",
    EVENTS_SQL + """, g AS (SELECT user_id, start_s - lag(start_s) OVER (PARTITION BY user_id ORDER BY start_s) AS gap FROM iv WHERE code = 4),
h AS (SELECT user_id, count(*) AS dur FROM streams GROUP BY user_id)
SELECT user_id, count(*) + 1 AS n_movements, median(gap) AS imi_median_s, stddev_pop(gap) / avg(gap) AS imi_cv, var_pop(gap) / avg(gap) AS fano,
  avg(CASE WHEN gap BETWEEN 5 AND 90 THEN 1.0 ELSE 0.0 END) AS periodic_frac, (count(*) + 1) * 3600.0 / any_value(dur) AS movements_per_h
FROM g JOIN h USING (user_id) WHERE gap IS NOT NULL GROUP BY user_id HAVING count(*) >= 3""",
    dbl="imi_median_s imi_cv fano periodic_frac movements_per_h",
)
def limb_periodicity(spark, sf):
    df, ax, iv = _events(spark, sf, [4])
    return ev.periodicity(iv, df.groupBy("user_id").agg(F.count(F.lit(1)).alias("duration_s")), USER, within=ax)


@query("limb_onset_spectrum", dbl="spec_peak_hz spec_peak_frac")
def limb_onset_spectrum(spark, sf):
    df, ax, iv = _events(spark, sf, [4])
    return ev.onset_spectrum(iv, df.groupBy("user_id").agg(F.count(F.lit(1)).alias("duration_s")), USER)


@query(
    "probability_stream_mean",
    f"WITH {STREAM_SQL} SELECT user_id, avg(CASE WHEN value / 100 BETWEEN 0 AND 1 THEN value / 100 END) AS prob_mean FROM streams GROUP BY user_id",
    dbl="prob_mean",
)
def probability_stream_mean(spark, sf):
    df, _ = streams(spark, sf)
    return ev.probability_mean(df, USER, F.col("value") / 100)


@query(
    "merge_gap_bursts",
    EVENTS_SQL + """, a AS (SELECT *, CASE WHEN start_s - lag(end_s) OVER (PARTITION BY user_id ORDER BY start_s) < 3 THEN 0 ELSE 1 END AS op
  FROM iv WHERE code IN (1, 2)),
b AS (SELECT *, sum(op) OVER (PARTITION BY user_id ORDER BY start_s) AS burst FROM a)
SELECT user_id, min(start_s) AS start_s, max(end_s) AS end_s, count(*) AS n_merged FROM b GROUP BY user_id, burst
HAVING max(end_s) - min(start_s) BETWEEN 2 AND 10""",
)
def merge_gap_bursts(spark, sf):
    df, ax, iv = _events(spark, sf, [1, 2])
    return merge_gaps(iv.select("user_id", "start_s", "end_s"), USER, "start_s", "end_s", 3, 2, 10, within=ax)


@query(
    "post_event_recovery",
    EVENTS_SQL + """, e AS (SELECT * FROM iv WHERE code IN (1, 2, 4)),
u AS (SELECT user_id, start_s, unnest(range(CAST(start_s AS BIGINT) - 30, CAST(end_s AS BIGINT) + 45)) AS epoch FROM e),
x AS (SELECT u.user_id, u.start_s, s.epoch AS sec, s.spo2_raw AS v, s.epoch < u.start_s AS pre FROM u JOIN streams s ON s.user_id = u.user_id AND s.epoch = u.epoch),
st AS (SELECT user_id, start_s, median(v) FILTER (pre) AS baseline, max(v) FILTER (NOT pre) AS peak FROM x GROUP BY ALL HAVING count(*) FILTER (pre) > 0),
nd AS (SELECT user_id, start_s, sec AS nadir FROM x WHERE NOT pre QUALIFY row_number() OVER (PARTITION BY user_id, start_s ORDER BY v, sec) = 1),
bk AS (SELECT x.user_id, x.start_s, min(sec) AS back FROM x JOIN st USING (user_id, start_s) JOIN nd USING (user_id, start_s)
  WHERE NOT pre AND sec >= nadir AND v >= baseline - 1 GROUP BY ALL)
SELECT st.user_id, st.start_s, baseline, peak - baseline AS overshoot, CAST(back - nadir AS DOUBLE) AS recovery_s
FROM st JOIN nd USING (user_id, start_s) LEFT JOIN bk USING (user_id, start_s)""",
    dbl="baseline overshoot",
)
def post_event_recovery(spark, sf):
    df, ax, iv = _events(spark, sf, [1, 2, 4])
    spo2 = df.select("user_id", F.col("epoch").alias("sec"), F.col("spo2_raw").alias("value"))
    return ev.post_event_recovery(iv, spo2, USER)


# ------------------------------------------------------------------ oxygen
SPO2_SQL = f"""WITH {STREAM_SQL},
raw AS (SELECT user_id, epoch, CASE WHEN user_id % 3 = 0 THEN spo2_raw / 100 ELSE spo2_raw END AS v FROM streams),
med AS (SELECT user_id, median(v) AS m FROM raw WHERE v > 0 GROUP BY user_id),
nrm AS (SELECT user_id, epoch, CASE WHEN p > 40 AND p <= 100 THEN p END AS spo2 FROM
  (SELECT r.user_id, epoch, CASE WHEN m <= 1.5 THEN v * 100.0 ELSE v END AS p FROM raw r LEFT JOIN med USING (user_id)))"""


def _spo2(spark, sf):
    """A third of the users keep a 0-1 scale, so scale detection has work to do."""
    df, ax = streams(spark, sf)
    scaled = F.when(F.col("user_id") % 3 == 0, F.col("spo2_raw") / 100).otherwise(F.col("spo2_raw"))
    raw = df.select(*ax.part, "idx", scaled.alias("value"))
    ax = Axis(ax.keys, ("idx",), ax.chunked)
    return oxygen.normalise(raw, USER, within=ax), ax


@query(
    "spo2_summary",
    SPO2_SQL + """ SELECT user_id, avg(spo2) AS spo2_mean, min(spo2) AS spo2_min, quantile_cont(spo2, 0.01) AS spo2_p1,
  100 * avg(CASE WHEN spo2 < 90 THEN 1.0 WHEN spo2 IS NOT NULL THEN 0.0 END) AS t90_pct,
  count(*) FILTER (spo2 < 90) / 60.0 AS t90_min, count(*) / 3600.0 AS duration_hours FROM nrm GROUP BY user_id""",
    dbl="spo2_mean spo2_min spo2_p1 t90_pct t90_min duration_hours",
)
def spo2_summary(spark, sf):
    df, ax = _spo2(spark, sf)
    return oxygen.summary(df, USER, within=ax)


@query(
    "spo2_forward_fill",
    SPO2_SQL + """ SELECT user_id, epoch AS idx, coalesce(last_value(spo2 IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY epoch),
  first_value(spo2 IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY epoch ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS filled FROM nrm""",
    dbl="filled",
)
def spo2_forward_fill(spark, sf):
    df, ax = _spo2(spark, sf)
    return forward_fill(df, ax, "spo2", "filled").select("user_id", "idx", "filled")


BASE_SQL = SPO2_SQL + """,
ff AS (SELECT user_id, epoch, spo2, coalesce(last_value(spo2 IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY epoch),
  first_value(spo2 IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY epoch ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS f FROM nrm),
bn AS (SELECT *, greatest(n // 16, 1) AS nb FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM ff WHERE f IS NOT NULL)),
bk AS (SELECT *, ((epoch + 1) * nb - 1) // n AS b FROM bn),
bl AS (SELECT user_id, b, median(f) AS m, ((b * any_value(n)) // any_value(nb) + ((b + 1) * any_value(n)) // any_value(nb)) / 2.0 AS c FROM bk GROUP BY user_id, b),
bx AS (SELECT *, lag(m) OVER w AS pm, lag(c) OVER w AS pc, lead(m) OVER w AS qm, lead(c) OVER w AS qc FROM bl WINDOW w AS (PARTITION BY user_id ORDER BY b)),
based AS (SELECT k.user_id, k.epoch, k.spo2, k.f, CASE WHEN epoch < c THEN coalesce(pm + (m - pm) * (epoch - pc) / (c - pc), m)
   ELSE coalesce(m + (qm - m) * (epoch - c) / (qc - c), m) END AS base FROM bk k JOIN bx USING (user_id, b))"""


@query("spo2_moving_baseline", BASE_SQL + " SELECT user_id, epoch AS idx, base AS baseline FROM based", dbl="baseline")
def spo2_moving_baseline(spark, sf):
    df, ax = _spo2(spark, sf)
    filled = forward_fill(df, ax, "spo2", "fill").where("fill is not null")
    return oxygen.block_baseline(filled, ax, "idx", "fill", "baseline", 16).select("user_id", "idx", "baseline")


DESAT_SQL = BASE_SQL + """,
dm AS (SELECT user_id, epoch, base - f AS dr, CASE WHEN spo2 IS NOT NULL AND base - f >= 3 THEN 1 ELSE 0 END AS m FROM based),
di AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY epoch) AS g FROM
  (SELECT *, CASE WHEN lag(m) OVER (PARTITION BY user_id ORDER BY epoch) IS DISTINCT FROM m THEN 1 ELSE 0 END AS ch FROM dm)),
dp AS (SELECT *, row_number() OVER (PARTITION BY user_id, g ORDER BY epoch) - 1 AS pos FROM di WHERE m = 1),
ds AS (SELECT user_id, CAST(min(epoch) AS DOUBLE) AS start_s, CAST(count(*) AS DOUBLE) AS dur_s, max(dr) FILTER (pos < 120) AS depth,
  (sum(dr) FILTER (pos < 120) - (max_by(dr, pos) FILTER (pos < 120) + min_by(dr, pos) FILTER (pos < 120)) / 2) / 60.0 AS burden_pctmin
  FROM dp GROUP BY user_id, g HAVING count(*) >= 2)"""


@query("desaturation_events", DESAT_SQL + " SELECT * FROM ds", dbl="depth burden_pctmin")
def desaturation_events(spark, sf):
    df, ax = _spo2(spark, sf)
    return oxygen.desaturations(df, ax, baseline_s=16, min_s=2)


@query(
    "oxygenation_odi_burden",
    DESAT_SQL + """, ev AS (SELECT user_id, count(*) AS n_desat, avg(depth) AS desat_depth_mean, max(depth) AS desat_depth_max, sum(burden_pctmin) AS hb_pctmin_total
  FROM ds GROUP BY user_id),
sm AS (SELECT user_id, avg(spo2) AS spo2_mean, min(spo2) AS spo2_min, quantile_cont(spo2, 0.01) AS spo2_p1,
  100 * avg(CASE WHEN spo2 < 90 THEN 1.0 WHEN spo2 IS NOT NULL THEN 0.0 END) AS t90_pct,
  count(*) FILTER (spo2 < 90) / 60.0 AS t90_min, count(*) / 3600.0 AS duration_hours FROM nrm GROUP BY user_id)
SELECT sm.*, coalesce(n_desat, 0) AS n_desat, desat_depth_mean, desat_depth_max, coalesce(hb_pctmin_total, 0) AS hb_pctmin_total,
  coalesce(n_desat, 0) / duration_hours AS odi, coalesce(hb_pctmin_total, 0) / duration_hours AS hypoxic_burden FROM sm LEFT JOIN ev USING (user_id)""",
    dbl="spo2_mean spo2_min spo2_p1 t90_pct t90_min duration_hours desat_depth_mean desat_depth_max hb_pctmin_total odi hypoxic_burden",
)
def oxygenation_odi_burden(spark, sf):
    df, ax = _spo2(spark, sf)
    return oxygen.oxygenation(df, oxygen.desaturations(df, ax, baseline_s=16, min_s=2), USER, within=ax)


@query(
    "spo2_simple_desaturation",
    SPO2_SQL + """, v AS (SELECT *, CASE WHEN spo2 < 90 THEN 1 ELSE 0 END AS lt FROM nrm WHERE spo2 IS NOT NULL),
p AS (SELECT *, coalesce(lag(lt) OVER (PARTITION BY user_id ORDER BY epoch), 0) AS pl FROM v)
SELECT user_id, avg(spo2) AS spo2_mean, stddev_pop(spo2) AS spo2_std, avg(CAST(lt AS DOUBLE)) AS spo2_frac_lt90,
  count(*) FILTER (lt = 1 AND pl = 0) * 3600.0 / count(*) AS spo2_desat_idx FROM p GROUP BY user_id""",
    dbl="spo2_mean spo2_std spo2_frac_lt90 spo2_desat_idx",
)
def spo2_simple_desaturation(spark, sf):
    df, ax = _spo2(spark, sf)
    return oxygen.simple_desaturation_index(df, ax)


# ------------------------------------------------------------------ stream joins
@query(
    "event_epoch_containment",
    EVENTS_SQL + " SELECT iv.user_id, iv.start_s, CAST(floor(start_s / 4) AS BIGINT) AS epoch, s.stage FROM iv LEFT JOIN streams s ON s.user_id = iv.user_id AND s.epoch = floor(start_s / 4) WHERE iv.code > 0",
)
def event_epoch_containment(spark, sf):
    df, ax, iv = _events(spark, sf, [1, 2, 4, 5])
    from ..operators.joins import containment_join

    return containment_join(iv.select("user_id", "start_s"), df.select("user_id", "epoch", "stage"), USER, "start_s", 4.0)


@query(
    "multirate_alignment",
    f"""WITH {STREAM_SQL} SELECT s.user_id, s.stage, count(*) AS n_seconds, avg(b.value) AS mean_value FROM streams s
JOIN streams b ON b.user_id = s.user_id AND b.epoch // 3 = s.epoch GROUP BY ALL""",
    dbl="mean_value",
)
def multirate_alignment(spark, sf):
    df, _ = streams(spark, sf)
    secs = df.select("user_id", F.col("idx").alias("sec"), "value")
    epochs = df.select("user_id", "epoch", "stage")
    joined = align_rates(epochs, secs, USER, epoch_s=3)
    return joined.groupBy("user_id", "stage").agg(F.count(F.lit(1)).alias("n_seconds"), F.avg("value").alias("mean_value"))


@query(
    "nearest_index_resample",
    f"""WITH {STREAM_SQL}, n AS (SELECT user_id, max(epoch) AS li FROM streams GROUP BY user_id),
a AS (SELECT s.user_id, s.epoch AS sec, least(round_even(s.epoch * 0.5, 0), li) AS idx FROM streams s JOIN n USING (user_id))
SELECT a.user_id, a.sec, CAST(a.idx AS BIGINT) AS idx, b.code FROM a JOIN streams b ON b.user_id = a.user_id AND b.epoch = a.idx""",
)
def nearest_index_resample(spark, sf):
    df, _ = streams(spark, sf)
    last = df.groupBy("user_id").agg(F.max("idx").alias("last_idx"))
    axis = df.select("user_id", F.col("idx").alias("sec"), F.lit(0.5).alias("fs")).join(last, "user_id")
    stream = df.select("user_id", "idx", "code")
    return nearest_resample(axis, stream, USER).select("user_id", "sec", "idx", "code")
