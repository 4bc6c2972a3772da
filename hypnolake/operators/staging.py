"""Stage-stream operators: macro-architecture, transitions, fragmentation, smoothing."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..vocab import ASLEEP, EPOCH_S, REM, STAGES, UNKNOWN, WAKE, N3
from .ordered import Axis, rising_edges, running_sum, runs, shift, with_axis


def _n(cond: Column) -> Column:
    return F.sum(cond.cast("long"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def scored(df: DataFrame, stage: str = "stage") -> DataFrame:
    """Round codes, then drop Unknown (rounding first: stored codes are floats)."""
    return df.withColumn(stage, F.rint(stage).cast("int")).where(F.col(stage) != UNKNOWN)


# ------------------------------------------------------------------ transitions
def transition_edges(df: DataFrame, ax: Axis, stage: str = "stage") -> DataFrame:
    """Edge list (keys, from, to, n) over consecutive scored epochs."""
    nxt = shift(scored(df, stage), ax, [stage], "_next_", back=False)
    pairs = nxt.where(F.col(f"_next_{stage}").isNotNull())
    return pairs.groupBy(*ax.keys, F.col(stage).alias("from"), F.col(f"_next_{stage}").alias("to")).agg(
        F.count(F.lit(1)).alias("n")
    )


def transition_probabilities(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Row-normalise the edge list: p = n / transitions leaving the state."""
    rows = edges.groupBy(*keys, "from").agg(F.sum("n").alias("row_n"))
    return edges.join(rows, [*keys, "from"]).withColumn("p", F.col("n") / F.col("row_n"))


def transition_profile(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One wide row per recording: 25 probabilities, row entropies, entropy rate, stability.

    Two aggregations on the edge list (at most 25 edges per recording), no self-join.
    """
    per_row = edges.groupBy(*keys, "from").agg(
        F.sum("n").alias("row_n"),
        F.sum(F.col("n") * F.log("n")).alias("_nlogn"),
        F.max(F.when(F.col("from") == F.col("to"), F.col("n")).otherwise(0)).alias("_diag"),
        *[F.sum(F.when(F.col("to") == c, F.col("n")).otherwise(0)).alias(f"_to_{t}") for c, t in STAGES.items()],
    )
    # entropy of n_i/N equals log N - sum(n_i log n_i)/N; scaled by log(5)
    per_row = per_row.withColumn(
        "_h", (F.log("row_n") - F.col("_nlogn") / F.col("row_n")) / F.log(F.lit(float(len(STAGES))))
    )
    cols = []
    for c, t in STAGES.items():
        at = F.col("from") == c
        cols += [F.max(F.when(at, F.col(f"_to_{u}") / F.col("row_n"))).alias(f"trans_p_{t}_{u}") for u in STAGES.values()]
    for c, t in STAGES.items():
        cols.append(F.max(F.when(F.col("from") == c, F.col("_h"))).alias(f"trans_entropy_{t}"))
    total = F.sum("row_n")
    cols.append((F.sum(F.col("row_n") * F.col("_h")) / total).alias("trans_entropy_rate"))
    cols.append((F.sum("_diag") / total).alias("trans_stability_index"))
    return per_row.groupBy(*keys).agg(*cols)


def cohort_matrix(edges: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean of per-recording row-normalised matrices (empty rows ignored) and the pooled matrix."""
    by = list(by)
    per_row = edges.groupBy(*keys, *by, "from").agg(
        F.sum("n").alias("row_n"),
        *[F.sum(F.when(F.col("to") == c, F.col("n")).otherwise(0)).alias(f"n_{c}") for c in STAGES],
    )
    agg = per_row.groupBy(*by, "from").agg(
        F.count(F.lit(1)).alias("n_recordings"),
        F.sum("row_n").alias("_tot"),
        *[F.avg(F.col(f"n_{c}") / F.col("row_n")).alias(f"_m_{c}") for c in STAGES],
        *[F.sum(f"n_{c}").alias(f"_s_{c}") for c in STAGES],
    )
    cells = F.explode(
        F.array(*[F.struct(F.lit(c).alias("to"), F.col(f"_m_{c}").alias("mean_p"), F.col(f"_s_{c}").alias("n")) for c in STAGES])
    )
    return agg.select(*by, "from", "n_recordings", "_tot", cells.alias("_c")).select(
        *by, "from", "_c.to", "n_recordings", "_c.mean_p", "_c.n", (F.col("_c.n") / F.col("_tot")).alias("pooled_p")
    )


def pivot_matrix(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Dense 5x5 form: one row per from-stage, one column per to-stage."""
    return edges.groupBy(*keys, "from").agg(
        *[F.sum(F.when(F.col("to") == c, F.col("n")).otherwise(0)).alias(f"to_{t}") for c, t in STAGES.items()]
    )


# ------------------------------------------------------------------ macro-architecture
def macro_architecture(
    df: DataFrame,
    ax: Axis,
    stage: str = "stage",
    epoch: str = "epoch",
    waso_end: str = "last_sleep",
) -> DataFrame:
    """Stage percentages, efficiency, latencies, WASO, transition rate and entropy per recording.

    ``waso_end``: "last_sleep" (clinical) or "recording" counts wake up to the end of the night.
    WASO comes from wake-count prefix sums, so no row is joined back to its onset.
    """
    st = df.withColumn(stage, F.rint(stage).cast("int"))
    asleep = F.col(stage).isin(*ASLEEP)
    # wake epochs before a sleep epoch = epoch rank minus sleep/unknown before it; use counts per recording
    base = st.groupBy(*ax.keys).agg(
        F.count(F.lit(1)).alias("n_epochs"),
        _n(F.col(stage) == UNKNOWN).alias("n_unknown"),
        _n(asleep).alias("n_asleep"),
        *[_n(F.col(stage) == c).alias(f"n_{t}") for c, t in STAGES.items()],
        F.min(epoch).alias("_e0"),
        F.min(F.when(asleep, F.col(epoch))).alias("_onset"),
        F.max(F.when(asleep, F.col(epoch))).alias("_offset"),
        F.min(F.when(F.col(stage) == REM, F.col(epoch))).alias("_rem"),
        F.min(F.when(F.col(stage) == N3, F.col(epoch))).alias("_n3"),
    )
    moves = runs(scored(df, stage), ax, stage).groupBy(*ax.keys).agg((F.count(F.lit(1)) - 1).alias("n_transitions"))
    bounds = base.select(*ax.keys, "_onset", "_offset")
    inside = F.col(epoch) >= F.col("_onset")
    if waso_end == "last_sleep":
        inside &= F.col(epoch) <= F.col("_offset")
    waso = (
        st.where(F.col(stage) == WAKE).select(*ax.keys, epoch).join(bounds, list(ax.keys))
        .where(inside).groupBy(*ax.keys).agg(F.count(F.lit(1)).alias("_waso"))
    )
    j = base.join(moves, list(ax.keys), "left").join(waso, list(ax.keys), "left")
    n_scored = F.col("n_epochs") - F.col("n_unknown")
    hours = F.col("n_epochs") * EPOCH_S / 3600
    mins = EPOCH_S / 60
    present = sum((F.col(f"n_{t}") > 0).cast("int") for t in STAGES.values())
    h = sum(
        F.when(F.col(f"n_{t}") > 0, -F.col(f"n_{t}") / n_scored * F.log(F.col(f"n_{t}") / n_scored)).otherwise(0.0)
        for t in STAGES.values()
    )
    return j.select(
        *ax.keys,
        "n_epochs",
        hours.alias("duration_hours"),
        (100.0 * F.col("n_unknown") / F.col("n_epochs")).alias("pct_unknown_epochs"),
        *[_ratio(100.0 * F.col(f"n_{t}"), n_scored).alias(f"pct_{t}") for t in STAGES.values()],
        (F.col("n_asleep") * mins).alias("tst_min"),
        (100.0 * F.col("n_asleep") / F.col("n_epochs")).alias("sleep_efficiency_pct"),
        ((F.col("_onset") - F.col("_e0")) * mins).alias("sleep_latency_min"),
        F.when(F.col("_onset").isNotNull(), F.coalesce("_waso", F.lit(0)) * mins).alias("waso_min"),
        ((F.col("_rem") - F.col("_onset")) * mins).alias("rem_latency_min"),
        ((F.col("_n3") - F.col("_onset")) * mins).alias("n3_latency_min"),
        (F.coalesce("n_transitions", F.lit(0)) / hours).alias("transitions_per_hr"),
        F.when(present > 1, h / F.log(present.cast("double"))).otherwise(0.0).alias("stage_entropy"),
    )


def bout_statistics(df: DataFrame, ax: Axis, stage: str = "stage") -> DataFrame:
    """Bouts per recording and stage: count, mean and longest duration, share of scored epochs."""
    bouts = runs(scored(df, stage), ax, stage)
    agg = bouts.groupBy(*ax.keys, stage).agg(
        F.count(F.lit(1)).alias("n_bouts"),
        (F.avg("n") * EPOCH_S / 60).alias("mean_bout_min"),
        (F.max("n") * EPOCH_S / 60).alias("max_bout_min"),
        F.sum("n").alias("n_stage_epochs"),
    )
    total = agg.groupBy(*ax.keys).agg(F.sum("n_stage_epochs").alias("_all"))
    out = agg.join(total, list(ax.keys)).withColumn("fraction", F.col("n_stage_epochs") / F.col("_all")).drop("_all")
    # for REM: bouts per REM epoch; for N3 the fraction is the slow-wave density
    return out.withColumn("fragmentation", F.col("n_bouts") / F.col("n_stage_epochs"))


def fragmentation(df: DataFrame, ax: Axis, stage: str = "stage", named: Sequence[tuple[int, int]] = ()) -> DataFrame:
    """Awakenings, brief wake, shift index, single-epoch spikes, bout structure, named transitions."""
    seq = scored(df, stage)
    order = list(ax.order)
    both = shift(shift(seq, ax, [stage], "_p_"), ax, [stage], "_n_", back=False)
    cur, prv, nxt = F.col(stage), F.col(f"_p_{stage}"), F.col(f"_n_{stage}")
    asleep = lambda c: c.isin(*ASLEEP)
    counts = both.groupBy(*ax.keys).agg(
        F.count(F.lit(1)).alias("n_scored"),
        _n(asleep(cur)).alias("n_asleep"),
        # asleep before the move implies the move is after sleep onset
        F.coalesce(_n(asleep(cur) & (nxt == WAKE)), F.lit(0)).alias("n_awakenings"),
        F.coalesce(_n((cur == WAKE) & asleep(prv) & asleep(nxt)), F.lit(0)).alias("brief_wake_intrusions"),
        F.coalesce(_n(cur != nxt), F.lit(0)).alias("n_transitions"),
        F.coalesce(_n((cur != prv) & (cur != nxt) & (prv == nxt)), F.lit(0)).alias("single_epoch_spikes"),
        *[F.coalesce(_n((cur == a) & (nxt == b)), F.lit(0)).alias(f"_t_{a}_{b}") for a, b in named],
    )
    coarse = seq.withColumn("_coarse", F.when(asleep(cur), 1).when(cur == WAKE, 0))
    bouts = runs(coarse.select(*ax.part, *order, "_coarse"), ax, "_coarse").groupBy(*ax.keys).agg(
        _n(F.col("_coarse") == 0).alias("n_wake_bouts"),
        _n(F.col("_coarse") == 1).alias("n_sleep_bouts"),
        (F.avg(F.when(F.col("_coarse") == 1, F.col("n"))) * EPOCH_S / 60).alias("mean_sleep_bout_min"),
        (F.avg(F.when(F.col("_coarse") == 0, F.col("n"))) * EPOCH_S / 60).alias("mean_wake_bout_min"),
    )
    rem = rising_edges(seq, ax, cur == REM, "n_rem_periods").select(*ax.keys, "n_rem_periods")
    tst = F.col("n_asleep") * EPOCH_S / 3600
    return (
        counts.where(F.col("n_scored") >= 2)
        .join(bouts, list(ax.keys))
        .join(rem, list(ax.keys))
        .select(
            *ax.keys,
            "n_awakenings",
            _ratio(F.col("n_awakenings"), tst).alias("awakenings_per_hr_sleep"),
            "brief_wake_intrusions",
            _ratio(F.col("n_transitions"), tst).alias("stage_shift_index"),
            "single_epoch_spikes",
            _ratio(F.col("single_epoch_spikes"), tst).alias("spikes_per_hr_sleep"),
            "n_wake_bouts",
            "n_sleep_bouts",
            "mean_sleep_bout_min",
            "mean_wake_bout_min",
            "n_rem_periods",
            *[_ratio(F.col(f"_t_{a}_{b}"), tst).alias(f"trans_{STAGES[a]}_to_{STAGES[b]}_per_hr") for a, b in named],
        )
    )


def against_cohort(metrics: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Each recording's metric next to the cohort mean and SD (long form)."""
    long = melt(metrics, keys, fields)
    cohort = long.groupBy("metric").agg(F.avg("value").alias("cohort_mean"), F.stddev_pop("value").alias("cohort_sd"))
    return long.join(F.broadcast(cohort), "metric").withColumn(  # one row per metric name
        "delta", F.col("value") - F.col("cohort_mean")
    )


def melt(df: DataFrame, keys: Sequence[str], fields: Sequence[str], name: str = "metric", value: str = "value") -> DataFrame:
    """Wide to long; the field list is part of the call, so this is one projection and an explode."""
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias(name), F.col(f).cast("double").alias(value)) for f in fields]))
    return df.select(*keys, cells.alias("_c")).select(*keys, f"_c.{name}", f"_c.{value}")


# ------------------------------------------------------------------ smoothing
def _merge_short_bouts(codes: list[int], lengths: list[int], closed_left: bool, closed_right: bool, min_len: int):
    """Absorb short bouts of one Unknown-free stretch, shortest first, into the longer neighbour."""
    import heapq

    n = len(codes)
    size, code = list(lengths), list(codes)
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    owner = list(range(n))
    alive = [True] * n

    def eligible(i):
        has_l, has_r = left[i] >= 0, right[i] >= 0
        interior = (has_l or closed_left) and (has_r or closed_right)
        return interior and (has_l or has_r) and size[i] < min_len

    heap = [(size[i], i) for i in range(n) if eligible(i)]
    heapq.heapify(heap)
    while heap:
        length, i = heapq.heappop(heap)
        if not alive[i] or size[i] != length or not eligible(i):
            continue
        li, ri = left[i], right[i]
        into = li if ri < 0 or (li >= 0 and size[li] >= size[ri]) else ri
        group = [i, into]
        other = ri if into == li else li
        if other >= 0 and code[other] == code[into]:
            group.append(other)
        keep = min(group)  # leftmost bout keeps the position, hence the scan order
        target = code[into]
        for g in sorted(group):
            if g == keep:
                continue
            size[keep] += size[g]
            alive[g] = False
            owner[g] = keep
        code[keep] = target
        right_end = right[max(group)]
        right[keep] = right_end
        if right_end >= 0:
            left[right_end] = keep
        if eligible(keep):
            heapq.heappush(heap, (size[keep], keep))

    def find(i):
        while owner[i] != i:
            i = owner[i]
        return i

    return [code[find(i)] for i in range(n)]


def smooth_bouts(df: DataFrame, ax: Axis, stage: str = "stage", min_bout: int = 2) -> DataFrame:
    """Minimum-bout smoothing; one row per raw bout with its cleaned stage.

    Unknown bouts never change and nothing merges into them, so stretches between Unknown
    bouts are independent: Spark forms bouts, splits the night at Unknown, and only the
    shortest-first merge of one stretch's bouts runs in Python.
    """
    rounded = df.withColumn(stage, F.rint(stage).cast("int"))
    bouts = runs(rounded, ax, stage)
    order = ax.order[0]
    bouts, bx = with_axis(bouts, ax.keys, ("run",), within=ax)
    bouts = bouts.withColumn("_unk", (F.col(stage) == UNKNOWN).cast("int"))
    stretches = runs(bouts.select(*bx.part, "run", "_unk"), bx, "_unk").select(
        *ax.keys, F.col("run").alias("stretch"), F.col("first_run").alias("_a"), F.col("last_run").alias("_b"), "_unk"
    )
    last = bouts.groupBy(*ax.keys).agg(F.max("run").alias("_last"))
    # locate each bout's stretch by running count of Unknown changes (same order as the runs)
    marked = shift(bouts, bx, ["_unk"], "_prev")
    opened = (F.col("_prev_unk").isNotNull() & (F.col("_prev_unk") != F.col("_unk"))).cast("long")
    tagged = running_sum(marked, bx, {"stretch": opened})
    joined = tagged.join(stretches.select(*ax.keys, "stretch", "_a", "_b"), [*ax.keys, "stretch"]).join(last, list(ax.keys))
    bout = F.struct("run", stage, "n", f"first_{order}")
    grouped = joined.groupBy(*ax.keys, "stretch").agg(
        F.array_sort(F.collect_list(bout)).alias("_b"),
        F.max("_unk").alias("_unk"),
        F.max(F.col("_a") > 0).alias("_closed_l"),
        F.max(F.col("_b") < F.col("_last")).alias("_closed_r"),
    )

    @F.pandas_udf("array<int>")
    def cleaned(codes: pd.Series, sizes: pd.Series, unknown: pd.Series, closed_l: pd.Series, closed_r: pd.Series) -> pd.Series:
        rows = zip(codes, sizes, unknown, closed_l, closed_r)
        return pd.Series([list(c) if u else _merge_short_bouts(list(c), list(n), l, r, min_bout) for c, n, u, l, r in rows])

    fixed = cleaned(F.col(f"_b.{stage}"), F.col("_b.n"), "_unk", "_closed_l", "_closed_r")
    return (
        grouped.withColumn("_f", fixed)
        .select(*ax.keys, F.explode(F.arrays_zip("_b", "_f")).alias("_z"))
        .select(*ax.keys, "_z._b.*", F.col("_z._f").alias("clean_stage"))
    )


def staging_report(bouts: DataFrame, keys: Sequence[str], stage: str = "stage", within: Axis | None = None) -> DataFrame:
    """Raw against cleaned staging: epochs changed, transitions removed, stage percentages."""
    weight = F.col("n")
    known = F.sum(F.when(F.col(stage) != UNKNOWN, weight).otherwise(0))
    agg = bouts.groupBy(*keys).agg(
        F.sum("n").alias("n_epochs"),
        F.sum(F.when(F.col(stage) != F.col("clean_stage"), weight).otherwise(0)).alias("n_changed"),
        (F.count(F.lit(1)) - 1).alias("transitions_raw"),
        *[_ratio(100.0 * F.sum(F.when(F.col(stage) == c, weight).otherwise(0)), known).alias(f"raw_pct_{t}") for c, t in STAGES.items()],
        *[_ratio(100.0 * F.sum(F.when(F.col("clean_stage") == c, weight).otherwise(0)), known).alias(f"clean_pct_{t}") for c, t in STAGES.items()],
    )
    seq, ax = with_axis(bouts, keys, ("run",), within=within)
    moves = shift(seq, ax, ["clean_stage"], "_p_").groupBy(*keys).agg(
        F.coalesce(_n(F.col("clean_stage") != F.col("_p_clean_stage")), F.lit(0)).alias("transitions_clean")
    )
    out = agg.join(moves, list(keys))
    return out.withColumn("pct_changed", 100.0 * F.col("n_changed") / F.col("n_epochs")).withColumn(
        "transitions_removed", F.col("transitions_raw") - F.col("transitions_clean")
    )
