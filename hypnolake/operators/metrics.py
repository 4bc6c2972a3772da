"""Scoring: prevalence reward, age-conditioned ranking, thresholds, calibration, survival concordance.

Pair metrics never build pairs: counts collapse to distinct values, then ranks, windows over
positions, or a bitwise block decomposition give the exact totals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ranks import auroc, cumulate, histogram

# Fixed threshold grid of the reward search: 80 points from 0.01 to 0.50.
GRID_N, GRID_LO, GRID_HI = 80, 0.01, 0.50
GRID = [GRID_LO + k * ((GRID_HI - GRID_LO) / (GRID_N - 1)) for k in range(GRID_N - 1)] + [GRID_HI]


def labelled(df: DataFrame, label: str = "label") -> DataFrame:
    return df.where(F.col(label).isin(0, 1))


# ------------------------------------------------------------------ prevalence and reward
def window_counts(queries: DataFrame, data: DataFrame, at: str, gap: float, counts: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """For each distinct query position: sums of ``counts`` over data with |position - at| <= gap.

    Data and window edges are merged on one axis and cumulated; equal positions order as
    lower edge, data, upper edge.
    """
    group = list(group)
    zero = [F.lit(0).cast("long").alias(c) for c in counts]
    mark = lambda x, tie: F.struct(x.cast("double").alias("x"), F.lit(tie).alias("tie")).alias("_pos")
    q = queries.where(F.col(at).isNotNull()).select(*group, at).distinct()
    none = F.lit(None).cast("double").alias("_q")
    rows = data.where(F.col(at).isNotNull()).groupBy(*group, at).agg(*[F.sum(c).cast("long").alias(c) for c in counts])
    merged = rows.select(*group, mark(F.col(at), 0), none, *counts)
    for tie, x in ((-1, F.col(at) - gap), (1, F.col(at) + gap)):
        merged = merged.unionByName(q.select(*group, mark(x, tie), F.col(at).cast("double").alias("_q"), *zero))
    cum = cumulate(merged, group, "_pos", counts)
    tie = F.col("_pos.tie")
    return (
        cum.where(F.col("_q").isNotNull())
        .groupBy(*group, F.col("_q").alias(at))
        .agg(*[F.sum(F.when(tie == 1, F.col(f"cum_{c}")).otherwise(-F.col(f"cum_{c}"))).alias(c) for c in counts])
    )


def prevalence(queries: DataFrame, reference: DataFrame, gap: float = 2, age: str = "age", label: str = "label") -> DataFrame:
    """max(positives, 0.5) / n over reference rows within ``gap`` years; ages without rows are absent."""
    ref = labelled(reference, label).select(age, F.col(label).alias("pos"), F.lit(1).alias("n"))
    win = window_counts(queries, ref, age, gap, ("pos", "n")).where("n > 0")
    return win.select(
        age, F.col("n").alias("n_window"), F.col("pos").alias("n_pos"),
        (F.greatest(F.col("pos").cast("double"), F.lit(0.5)) / F.col("n")).alias("prevalence"),
    )


def clipped(p: Column, m: Column) -> Column:
    return F.least(F.greatest(p, 0.5 / m), 1 - 0.5 / m)


def row_reward(label: Column, pred: Column, p: Column) -> Column:
    return (
        F.when((label == 1) & (pred == 1), 1 / p - 1)
        .when((label == 0) & (pred == 0), 1 / (1 - p) - 1)
        .when(label.isin(0, 1) & pred.isin(0, 1), -1.0)
    )


def reward(df: DataFrame, prev: DataFrame, group: Sequence[str] = (), age: str = "age", label: str = "label", pred: str = "pred") -> DataFrame:
    """Mean prevalence reward. Clipping uses the group size; rows without age or prevalence do not count."""
    group = list(group)
    cells = labelled(df, label).groupBy(*group, age, label, pred).agg(F.count(F.lit(1)).alias("_c"))
    sizes = cells.groupBy(*group).agg(F.sum("_c").alias("_m"))
    cells = cells.join(sizes, group) if group else cells.join(F.broadcast(sizes))  # one row
    j = cells.join(prev.select(age, "prevalence"), age)
    r = row_reward(F.col(label), F.col(pred), clipped(F.col("prevalence"), F.col("_m")))
    return j.groupBy(*group).agg(
        F.sum("_c").alias("n_scored"), (F.sum(r * F.col("_c")) / F.sum("_c")).alias("reward")
    )


# ------------------------------------------------------------------ ranking
def average_precision(df: DataFrame, group: Sequence[str], score: str, label: str, **kw) -> DataFrame:
    """Step-wise average precision from cumulative counts at distinct scores."""
    hist = histogram(df, group, score, {"pos": (F.col(label) == 1).cast("int"), "neg": (F.col(label) == 0).cast("int")})
    cum = cumulate(hist, group, score, ("pos", "neg"), **kw)
    tp = F.col("tot_pos") - F.col("cum_pos") + F.col("pos")
    fp = F.col("tot_neg") - F.col("cum_neg") + F.col("neg")
    return cum.groupBy(*group).agg((F.sum(F.col("pos") * tp / (tp + fp)) / F.nullifzero(F.max("tot_pos"))).alias("auprc"))


def _wins(cum: DataFrame, group: Sequence[str], q: str, d: str) -> DataFrame:
    half_ties = F.col(q) * (F.col(f"cum_{d}") - F.col(d) / 2)
    return cum.groupBy(*group).agg(F.sum(half_ties).alias("wins"), F.sum(F.col(q) * F.col(f"tot_{d}")).alias("pairs"))


def auroc_age(df: DataFrame, gap: float = 2, age: str = "age", score: str = "prob", label: str = "label") -> DataFrame:
    """AUROC over positive-negative pairs at most ``gap`` years apart: one row (wins, pairs, auroc_age).

    Exact dominance counts, whatever the ages: cost grows with the rows times the bits of a rank, never with the pairs.
    """
    cells = labelled(df, label).where(F.col(age).isNotNull() & F.col(score).isNotNull())
    cells = cells.groupBy(age, score).agg(
        F.sum((F.col(label) == 1).cast("long")).alias("pos"), F.sum((F.col(label) == 0).cast("long")).alias("neg")
    )
    out = _auroc_age_dominance(cut_lineage(cells), gap, age, score)  # read by three branches, each more than once
    return out.withColumn("auroc_age", F.when(F.col("pairs") > 0, F.col("wins") / F.col("pairs")))


def _auroc_age_dominance(cells: DataFrame, gap: float, age: str, score: str) -> DataFrame:
    """All pairs minus those with the negative too old or too young."""
    q = cells.where("pos > 0").select(F.col(age).alias("x"), F.col(score).alias("y"), F.col("pos").alias("w"))
    d = cells.where("neg > 0").select(F.col(age).alias("x"), F.col(score).alias("y"), F.col("neg").alias("w"))
    flat = cells.groupBy(score).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    every = _wins(cumulate(flat, [], score, ("pos", "neg")), [], "pos", "neg")
    x = F.col("x")
    two = lambda f, old, young: f.select("y", "w", F.inline(F.array(*[F.struct(F.lit(k).alias("side"), v.alias("x")) for k, v in enumerate((old, young))])))
    far = dominance(two(q, x + gap, gap - x), two(d, x, -x), ["side"])  # too old and too young, counted in one pass
    signed = every.unionByName(_negated(far))
    return signed.groupBy().agg(F.sum("wins").alias("wins"), F.sum("pairs").alias("pairs"))


def _negated(df: DataFrame) -> DataFrame:
    return df.select((-F.col("wins")).alias("wins"), (-F.col("pairs")).alias("pairs"))


def dominance(queries: DataFrame, data: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Over query/data pairs (of one group) with data.x > query.x: total pairs, and wins = data.y < query.y plus half ties.

    Inputs (x, y, w) and the group. Positions get dense ranks; two ranks split at exactly one bit, so each
    pair is counted once in the block above that bit. Rows grow by log2(distinct x), not by pairs.
    """
    g = list(group)
    both = queries.select(*g, "x", "y", F.col("w").alias("q"), F.lit(0).cast("long").alias("d")).unionByName(
        data.select(*g, "x", "y", F.lit(0).cast("long").alias("q"), F.col("w").alias("d"))
    )
    pts = both.groupBy(*g, "x", "y").agg(F.sum("q").alias("q"), F.sum("d").alias("d"))
    xs = pts.select(*g, "x").distinct().withColumn("n", F.lit(1).cast("long"))
    bits = max(int(xs.count() - 1), 1).bit_length()  # xs: distinct positions
    ranked = cumulate(xs, g, "x").select(*g, "x", (F.col("cum_n") - 1).alias("r"))
    lv = pts.join(ranked, [*g, "x"]).withColumn("lvl", F.explode(F.array(*[F.lit(b) for b in range(bits)])))
    side = F.expr("shiftright(r, lvl) & 1")
    lv = lv.select(
        *g, "lvl", F.expr("shiftright(r, lvl + 1)").alias("block"), "y",
        F.when(side == 0, F.col("q")).otherwise(0).alias("q"), F.when(side == 1, F.col("d")).otherwise(0).alias("d"),
    ).where("q > 0 OR d > 0")
    hist = lv.groupBy(*g, "lvl", "block", "y").agg(F.sum("q").alias("q"), F.sum("d").alias("d"))
    out = _wins(cumulate(hist, [*g, "lvl", "block"], "y", ("q", "d")), [], "q", "d")
    return out.select(F.coalesce("wins", F.lit(0.0)).alias("wins"), F.coalesce("pairs", F.lit(0)).alias("pairs"))


def auroc_age_weighted(df: DataFrame, gap: float = 2, age: str = "age", score: str = "prob", label: str = "label") -> DataFrame:
    """AUROC inside the +-gap window of each unit age step, weighted by people in the window."""
    rows = labelled(df, label).where(F.col(age).isNotNull())
    cells = rows.groupBy(age, score).agg(
        F.sum((F.col(label) == 1).cast("long")).alias("pos"), F.sum((F.col(label) == 0).cast("long")).alias("neg"),
        F.count(F.lit(1)).alias("people"),
    )
    start = rows.agg((F.min(age) - gap).alias("_k0"))
    j = cells.join(F.broadcast(start))  # one row
    first = F.ceil(F.col(age) - gap - F.col("_k0"))
    last = F.floor(F.col(age) + gap - F.col("_k0"))
    at = j.withColumn("_k", F.explode(F.sequence(first, last)))
    hist = at.groupBy("_k", score).agg(*[F.sum(c).alias(c) for c in ("pos", "neg", "people")])
    cum = cumulate(hist, ["_k"], score, ("pos", "neg", "people"))
    per = cum.groupBy("_k").agg(
        F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2)).alias("_w"),
        F.max(F.col("tot_pos") * F.col("tot_neg")).alias("_p"),
        F.max("tot_people").alias("_people"),
    ).where("_p > 0")
    return per.agg((F.sum(F.col("_people") * F.col("_w") / F.col("_p")) / F.sum("_people")).alias("auroc_weighted"))


def c_index(df: DataFrame, time: str, event: str, risk: str) -> DataFrame:
    """Harrell's C with right censoring. Simultaneous events are comparable and half-concordant on a risk tie."""
    ok = df.where(F.col(time).isNotNull() & F.col(risk).isNotNull())
    x, y = F.col(time).cast("double").alias("x"), F.col(risk).cast("double").alias("y")
    cases = ok.where(F.col(event) == 1).groupBy(x, y).agg(F.count(F.lit(1)).alias("w"))
    everyone = ok.groupBy(x, y).agg(F.count(F.lit(1)).alias("w"))
    later = dominance(cases, everyone)
    choose2 = lambda n: n * (n - 1) / 2
    tied = cases.groupBy("x").agg(F.sum("w").alias("n"), F.sum(choose2(F.col("w"))).alias("t")).agg(
        F.coalesce(F.sum("t") * 0.5, F.lit(0.0)).alias("wins"),
        F.coalesce(F.sum(choose2(F.col("n"))), F.lit(0.0)).cast("long").alias("pairs"),
    )
    total = later.unionByName(tied).agg(F.sum("wins").alias("concordant"), F.sum("pairs").alias("comparable"))
    return total.withColumn("c_index", F.when(F.col("comparable") > 0, F.col("concordant") / F.col("comparable")))


# ------------------------------------------------------------------ reward thresholds
def grid_bucket(prob: Column) -> Column:
    """How many grid thresholds lie strictly below ``prob``: arithmetic guess, corrected by one step."""
    step = (GRID_HI - GRID_LO) / (GRID_N - 1)
    k = F.least(F.greatest(F.ceil((prob - GRID_LO) / step), F.lit(0)), F.lit(GRID_N)).cast("int")
    grid = F.array(*[F.lit(t) for t in GRID])
    up = (k < GRID_N) & (prob > F.get(grid, k))
    down = (k > 0) & ~(prob > F.get(grid, k - 1))
    return F.when(up, k + 1).when(down, k - 1).otherwise(k)


def decade(age: Column) -> Column:
    return (F.floor(age / 10) * 10).cast("int")


def _best_threshold(cells: DataFrame, group: Sequence[str], min_n: int = 1, always: Column | None = None) -> DataFrame:
    """Best grid threshold per group from cells (group, age, label, bucket, prevalence, c).

    Only thresholds at populated buckets (and the first) can start a new reward level, so they
    are the only candidates; the lowest wins a tie. With ``always``, other groups need ``min_n``
    rows and both classes.
    """
    group = list(group)
    sizes = cells.groupBy(*group).agg(F.sum("c").alias("_m"), F.sum(F.col("c") * F.col("label")).alias("_pos"))
    if always is not None:
        both = (F.col("_pos") > 0) & (F.col("_pos") < F.col("_m"))
        sizes = sizes.where(always | ((F.col("_m") >= min_n) & both))
    j = cells.join(sizes, group)
    p = clipped(F.col("prevalence"), F.col("_m"))
    yes = F.coalesce(row_reward(F.col("label"), F.lit(1), p), F.lit(0.0)) * F.col("c")
    no = F.coalesce(row_reward(F.col("label"), F.lit(0), p), F.lit(0.0)) * F.col("c")
    counted = F.when(F.col("prevalence").isNotNull(), F.col("c")).otherwise(0)
    per = j.groupBy(*group, "b").agg(F.sum(yes).alias("yes"), F.sum(no).alias("no"), F.sum(counted).alias("n"))
    floor = sizes.select(*group, F.lit(0).alias("b"), F.lit(0.0).alias("yes"), F.lit(0.0).alias("no"), F.lit(0).cast("long").alias("n"))
    per = per.unionByName(floor).groupBy(*group, "b").agg(*[F.sum(c).alias(c) for c in ("yes", "no", "n")])
    w = Window.partitionBy(*group).orderBy("b")  # at most 81 rows per group
    upto, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(1, Window.unboundedFollowing)
    whole = Window.partitionBy(*group)
    r = (F.sum("no").over(upto) + F.coalesce(F.sum("yes").over(after), F.lit(0.0))) / F.sum("n").over(whole)
    t = F.get(F.array(*[F.lit(x) for x in GRID]), F.col("b"))
    cand = per.withColumn("_r", F.round(r, 12)).withColumn("threshold", t).where(F.col("b") < GRID_N)
    best = F.max_by(F.struct("threshold", "_r"), F.struct("_r", (-F.col("threshold")).alias("_neg")))
    return cand.groupBy(*group).agg(best.alias("_b")).select(*group, "_b.threshold", F.col("_b._r").alias("train_reward"))


def _threshold_cells(df: DataFrame, prev: DataFrame, extra: Sequence[str]) -> DataFrame:
    rows = labelled(df).withColumn("b", grid_bucket(F.coalesce("prob", F.lit(0.0))))
    cells = rows.groupBy(*extra, "age", "label", "b").agg(F.count(F.lit(1)).alias("c"))
    return cells.join(prev.select("age", "prevalence"), "age", "left")


def fit_reward_thresholds(df: DataFrame, gap: float = 2, min_bin_n: int = 25) -> DataFrame:
    """Reward-best thresholds: level (global | decade | site_decade), site, decade, threshold.

    Rows collapse to (site, age, label, bucket) cells once; the three levels reuse the cells.
    """
    prev = prevalence(df, df, gap)
    cells = cut_lineage(_threshold_cells(df, prev, ["site"]).withColumn("decade", decade(F.col("age"))))
    none_s, none_d = F.lit(None).cast("string"), F.lit(None).cast("int")
    levels = F.array(
        F.struct(F.lit("global").alias("level"), none_s.alias("s"), none_d.alias("d")),
        F.struct(F.lit("decade").alias("level"), none_s.alias("s"), F.col("decade").alias("d")),
        F.struct(F.lit("site_decade").alias("level"), F.col("site").alias("s"), F.col("decade").alias("d")),
    )
    at = cells.withColumn("_l", F.explode(levels)).where((F.col("_l.level") == "global") | F.col("_l.d").isNotNull())
    at = at.select(
        F.col("_l.level").alias("level"), F.coalesce("_l.s", F.lit("")).alias("site"),
        F.coalesce("_l.d", F.lit(-1)).alias("decade"), "age", "label", "b", "prevalence", "c",
    )
    return cut_lineage(_best_threshold(at, ["level", "site", "decade"], min_bin_n, F.col("level") == "global"))


def apply_thresholds(df: DataFrame, thresholds: DataFrame) -> DataFrame:
    """site-decade, else decade, else global; a missing age takes the global threshold."""
    at = lambda lv: thresholds.where(F.col("level") == lv)
    sd = at("site_decade").select("site", F.col("decade").alias("_dec"), F.col("threshold").alias("_t_sd"))
    d = at("decade").select(F.col("decade").alias("_dec"), F.col("threshold").alias("_t_d"))
    g = at("global").select(F.lit(1).alias("_one"), F.col("threshold").alias("_t_g"))
    j = df.withColumn("_dec", decade(F.col("age"))).withColumn("_one", F.lit(1))
    j = j.join(sd, ["site", "_dec"], "left").join(d, "_dec", "left").join(F.broadcast(g), "_one", "left")
    out = j.withColumn("threshold", F.coalesce("_t_sd", "_t_d", "_t_g", F.lit(0.5)))
    out = out.withColumn("pred", (F.coalesce("prob", F.lit(0.0)) > F.col("threshold")).cast("int"))
    return out.drop("_dec", "_one", "_t_sd", "_t_d", "_t_g")


def decision_rules(df: DataFrame, gap: float = 2) -> DataFrame:
    """Reward of four rules on the same scores: pi, oracle, transfer, q_gt_pa."""
    rows = cut_lineage(labelled(df).select("site", "age", "label", "prob"))
    prev = cut_lineage(prevalence(rows, rows, gap))
    pi = rows.agg(F.avg(F.col("label").cast("double")).alias("_pi"))
    by_pi = rows.join(F.broadcast(pi)).withColumn("pred", (F.col("prob") > F.col("_pi")).cast("int"))  # one row
    cells = cut_lineage(_threshold_cells(rows, prev, ["site"]))
    oracle = _best_threshold(cells.withColumn("g", F.lit("all")), ["g"]).select(
        F.lit("oracle").alias("rule"), F.col("train_reward").alias("reward")
    )
    # other-site cells = the totals over all sites less the held-out site's own, matched on the cell
    cell = ["age", "label", "b"]
    listed = F.broadcast(cells.agg(F.collect_set("site").alias("_sites")))  # one row
    every = cells.groupBy(*cell, "prevalence").agg(F.sum("c").alias("_all")).join(listed).withColumn("held_out", F.explode("_sites")).drop("_sites")
    mine = cells.select(F.col("site").alias("_site"), *[F.col(x).alias(f"_{x}") for x in cell], F.col("c").alias("_own"))
    match = [F.col("held_out") == F.col("_site"), *[F.col(x).eqNullSafe(F.col(f"_{x}")) for x in cell]]
    others = every.join(mine, match, "left").withColumn("c", F.col("_all") - F.coalesce("_own", F.lit(0))).where("c > 0")
    others = others.select("held_out", *cell, "prevalence", "c")
    fitted = _best_threshold(others, ["held_out"]).select(F.col("held_out").alias("site"), "threshold")
    by_transfer = rows.join(fitted, "site").withColumn("pred", (F.col("prob") > F.col("threshold")).cast("int"))
    q = rows.select("age").distinct()
    counted = rows.select("age", "site", F.col("label").alias("pos"), F.lit(1).alias("n"))
    total = window_counts(q, counted, "age", gap, ("pos", "n"))
    own = window_counts(rows.select("site", "age").distinct(), counted, "age", gap, ("pos", "n"), ["site"])
    own = own.select("site", "age", F.col("pos").alias("_op"), F.col("n").alias("_on"))
    pa = own.join(total, "age").withColumn("_n", F.col("n") - F.col("_on")).withColumn("_p", F.col("pos") - F.col("_op"))
    pa = pa.select("site", "age", F.when(F.col("_n") > 0, F.greatest(F.col("_p").cast("double"), F.lit(0.5)) / F.col("_n")).otherwise(1.0).alias("_pa"))
    by_age = rows.join(pa, ["site", "age"], "left").withColumn("pred", (F.col("prob") > F.coalesce("_pa", F.lit(1.0))).cast("int"))
    named = {"pi": by_pi, "transfer": by_transfer, "q_gt_pa": by_age}
    out = oracle
    for rule, d in named.items():
        out = out.unionByName(reward(d, prev).select(F.lit(rule).alias("rule"), "reward"))
    return out


# ------------------------------------------------------------------ confusion, evaluation
def confusion(df: DataFrame, group: Sequence[str] = (), label: str = "label", pred: str = "pred") -> DataFrame:
    y, p = F.col(label), F.col(pred)
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    out = labelled(df, label).groupBy(*group).agg(
        n((y == 1) & (p == 1)).alias("tp"), n((y == 0) & (p == 1)).alias("fp"),
        n((y == 1) & (p == 0)).alias("fn"), n((y == 0) & (p == 0)).alias("tn"),
    )
    total = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    r = lambda a, b: F.when(b > 0, a / b)
    return out.select(
        "*",
        r(F.col("tp") + F.col("tn"), total).alias("accuracy"),
        r(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f_measure"),
        r(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
        r(F.col("tn"), F.col("tn") + F.col("fp")).alias("specificity"),
        r(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
    )


def align_predictions(labels: DataFrame, preds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Labelled rows with their prediction; missing or invalid predictions become 0."""
    p = preds.select(*keys, F.col("pred").alias("_pred"), F.col("prob").alias("_prob"))
    j = labelled(labels).join(p, list(keys), "left")
    prob = F.col("_prob").cast("double")
    valid = prob.isNotNull() & ~F.isnan(prob) & (F.abs(prob) < float("inf"))
    return j.withColumn("pred", F.when(F.col("_pred").isin(0, 1), F.col("_pred")).otherwise(0).cast("int")).withColumn(
        "prob", F.when(valid, prob).otherwise(0.0)
    ).drop("_pred", "_prob")


def evaluate(df: DataFrame, reference: DataFrame, gap: float = 2) -> DataFrame:
    """The seven headline scores as (metric, value) rows."""
    one = lambda d, c, name: d.select(F.lit(name).alias("metric"), F.col(c).cast("double").alias("value"))
    cols = ["age", "label", "pred", "prob"]
    same = reference is df
    df = cut_lineage(df.select(*cols))  # seven passes over four narrow columns
    prev = cut_lineage(prevalence(df, df if same else reference, gap))
    conf = confusion(df)
    parts = [
        one(reward(df, prev), "reward", "reward"),
        one(auroc_age(df, gap), "auroc_age", "auroc_age"),
        one(auroc_age_weighted(df, gap), "auroc_weighted", "auroc_weighted"),
        one(auroc(df, [], "prob", "label"), "auroc", "auroc"),
        one(average_precision(df, [], "prob", "label"), "auprc", "auprc"),
        one(conf, "accuracy", "accuracy"),
        one(conf, "f_measure", "f_measure"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def by_age_table(df: DataFrame, reference: DataFrame, gap: float = 2) -> DataFrame:
    """Twelve-column breakdown by age over scored and reference rows."""
    prev = prevalence(df, reference, gap).select("age", "prevalence")
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    y, p = F.col("label"), F.col("pred")
    tagged = labelled(df).select("age", "label", "pred", F.lit(0).alias("_ref")).unionByName(
        labelled(reference).select("age", "label", F.lit(None).cast("int").alias("pred"), F.lit(1).alias("_ref"))
    )
    ref, own = F.col("_ref") == 1, F.col("_ref") == 0
    agg = tagged.groupBy("age").agg(
        n(ref & (y == 1)).alias("ref_pos"), n(ref & (y == 0)).alias("ref_neg"),
        n(own & (y == 1)).alias("n_pos"), n(own & (y == 0)).alias("n_neg"),
        n(own & (p == 1)).alias("pred_pos"), n(own & (p == 0)).alias("pred_neg"),
        n(own & (y == 1) & (p == 1)).alias("tp"), n(own & (y == 0) & (p == 1)).alias("fp"),
        n(own & (y == 1) & (p == 0)).alias("fn"), n(own & (y == 0) & (p == 0)).alias("tn"),
        F.max(own).alias("_own"),
    )
    return agg.where("_own").drop("_own").join(prev, "age", "left")


def subgroups(df: DataFrame, axes: dict[str, Column], reference: DataFrame, gap: float = 2, min_n: int = 15) -> DataFrame:
    """Metrics per axis level; every row visits each axis once (explode factor = number of axes)."""
    cells = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), c.cast("string").alias("level")) for a, c in axes.items()]))
    at = labelled(df).withColumn("_a", cells).select("*", "_a.axis", F.coalesce("_a.level", F.lit("unknown")).alias("level")).drop("_a")
    keys = ["axis", "level"]
    conf = confusion(at, keys).withColumn("n", F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).where(F.col("n") >= min_n)
    prev = prevalence(df, reference, gap)
    roc = auroc(at, keys, "prob", "label").select(*keys, "auroc")
    rew = reward(at, prev, keys).select(*keys, "reward")
    return conf.join(roc, keys, "left").join(rew, keys, "left").drop("accuracy", "f_measure")


def quadrant(label: str = "label", pred: str = "pred") -> Column:
    y, p = F.col(label), F.col(pred)
    return F.when((y == 1) & (p == 1), "TP").when((y == 1) & (p == 0), "FN").when((y == 0) & (p == 1), "FP").when((y == 0) & (p == 0), "TN")


def case_cards(features: DataFrame, cases: DataFrame, key: str, topk: int) -> DataFrame:
    """Top deviating features of each misclassified case: z against the negatives, by |z| then name."""
    neg = features.where("label = 0").groupBy("feature").agg(F.avg("value").alias("_mu"), F.stddev_pop("value").alias("_sd"))
    z = features.join(F.broadcast(neg), "feature").where("_sd > 0")  # one row per feature name
    z = z.withColumn("z", (F.col("value") - F.col("_mu")) / F.col("_sd"))
    wrong = cases.withColumn("outcome", quadrant()).where(F.col("outcome").isin("FN", "FP")).select(key, "outcome")
    j = z.where("z IS NOT NULL").join(wrong, key)
    w = Window.partitionBy(key).orderBy(F.abs(F.col("z")).desc(), "feature")  # one row per feature of one case
    return j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= topk).select(key, "outcome", "rank", "feature", "z")


def missed_contrast(features: DataFrame, cases: DataFrame, key: str) -> DataFrame:
    """Mean signed z per feature and outcome quadrant, with the FN-TP and FP-TN differences."""
    neg = features.where("label = 0").groupBy("feature").agg(F.avg("value").alias("_mu"), F.stddev_pop("value").alias("_sd"))
    q = cases.withColumn("outcome", quadrant()).where("outcome IS NOT NULL").select(key, "outcome")
    z = features.join(F.broadcast(neg), "feature").where("_sd > 0").withColumn("z", (F.col("value") - F.col("_mu")) / F.col("_sd"))
    m = lambda o: F.avg(F.when(F.col("outcome") == o, F.col("z"))).alias(f"z_{o.lower()}")
    out = z.join(q, key).groupBy("feature").agg(*[m(o) for o in ("TP", "FN", "FP", "TN")])
    return out.withColumn("fn_minus_tp", F.col("z_fn") - F.col("z_tp")).withColumn("fp_minus_tn", F.col("z_fp") - F.col("z_tn"))


# ------------------------------------------------------------------ calibration and operating points (C14, C17)
def reliability_bins(df: DataFrame, group: Sequence[str] = (), score: str = "prob", label: str = "label", bins: int = 10) -> DataFrame:
    b = F.least(F.greatest(F.floor(F.col(score) * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    return labelled(df, label).where(F.col(score).isNotNull()).groupBy(*group, b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_pred"), F.avg(F.col(label).cast("double")).alias("obs_freq")
    )


def calibration(df: DataFrame, group: Sequence[str] = (), score: str = "prob", label: str = "label", bins: int = 10) -> DataFrame:
    """Brier score, expected and maximum calibration error."""
    group = list(group)
    b = F.least(F.greatest(F.floor(F.col(score) * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    per = labelled(df, label).where(F.col(score).isNotNull()).groupBy(*group, b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(score).alias("mp"), F.avg(F.col(label).cast("double")).alias("of"),
        F.sum(F.pow(F.col(score) - F.col(label), 2)).alias("sq"),
    )
    gap = F.abs(F.col("of") - F.col("mp"))
    return per.groupBy(*group).agg(
        F.sum("n").alias("n"), (F.sum("sq") / F.sum("n")).alias("brier"),
        (F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"),
    )


def youden(df: DataFrame, group: Sequence[str] = (), score: str = "prob", label: str = "label") -> DataFrame:
    """Threshold (predict when score >= t) with the largest sensitivity + specificity - 1; highest t on ties."""
    group = list(group)
    hist = histogram(labelled(df, label), group, score, {"pos": (F.col(label) == 1).cast("int"), "neg": (F.col(label) == 0).cast("int")})
    cum = cumulate(hist, group, score, ("pos", "neg"))
    tpr = (F.col("tot_pos") - F.col("cum_pos") + F.col("pos")) / F.nullifzero("tot_pos")
    fpr = (F.col("tot_neg") - F.col("cum_neg") + F.col("neg")) / F.nullifzero("tot_neg")
    j = cum.withColumn("_j", F.round(tpr - fpr, 12)).withColumn("tpr", tpr).withColumn("fpr", fpr)
    best = F.max_by(F.struct(score, "tpr", "fpr", "_j"), F.when(F.col("_j").isNotNull(), F.struct("_j", score)))
    return j.groupBy(*group).agg(best.alias("_b")).where("_b IS NOT NULL").select(*group, F.col(f"_b.{score}").alias("threshold"), "_b.tpr", "_b.fpr", F.col("_b._j").alias("youden"))


def operating_sweep(df: DataFrame, thresholds: Sequence[float], score: str = "prob", label: str = "label") -> DataFrame:
    """Confusion counts at fixed thresholds (score >= t): bucket once, then suffix sums over the grid."""
    ts = sorted(thresholds)
    b = sum((F.col(score) >= t).cast("int") for t in ts)
    y = F.col(label)
    per = labelled(df, label).where(F.col(score).isNotNull()).groupBy(b.alias("b")).agg(
        F.sum((y == 1).cast("long")).alias("pos"), F.sum((y == 0).cast("long")).alias("neg")
    )
    # one sweep row per threshold the bucket reaches, plus totals
    cell = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(t)).alias("threshold")) for i, t in enumerate(ts)])
    rows = per.withColumn("_t", F.explode(cell)).select("_t.*", (F.col("b") > F.col("_t.i")).alias("hit"), "pos", "neg")
    s = lambda c, hit: F.coalesce(F.sum(F.when(F.col("hit") == hit, F.col(c))), F.lit(0))
    return rows.groupBy("threshold").agg(
        s("pos", True).alias("tp"), s("neg", True).alias("fp"), s("pos", False).alias("fn"), s("neg", False).alias("tn")
    ).withColumn("sensitivity", F.col("tp") / F.nullifzero(F.col("tp") + F.col("fn"))).withColumn(
        "specificity", F.col("tn") / F.nullifzero(F.col("tn") + F.col("fp"))
    )
