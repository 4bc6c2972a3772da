"""Univariate tests, false-discovery control, bootstrap and permutation inference on tall tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tails import chi_square_tail, normal_two_sided, student_two_sided
from ..session import cut_lineage
from . import replicates as replicates_
from .ranks import average_ranks, cumulate, histogram


def mann_whitney(df: DataFrame, group: Sequence[str], value: str = "value", label: str = "label", min_class: int = 5) -> DataFrame:
    """U, AUROC, tie-corrected continuity-corrected z per group; classes need ``min_class`` rows."""
    group = list(group)
    y = F.col(label)
    hist = histogram(df.where(y.isin(0, 1)), group, value, {"pos": (y == 1).cast("int"), "neg": (y == 0).cast("int")})
    cum = cumulate(hist, group, value, ("pos", "neg"))
    t = (F.col("pos") + F.col("neg")).cast("double")
    agg = cum.groupBy(*group).agg(
        F.max("tot_pos").alias("n_pos"), F.max("tot_neg").alias("n_neg"),
        F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2)).alias("u"),
        F.sum(t * t * t - t).alias("_ties"),
    ).where((F.col("n_pos") >= min_class) & (F.col("n_neg") >= min_class))
    prod = F.col("n_pos").cast("double") * F.col("n_neg")
    n = (F.col("n_pos") + F.col("n_neg")).cast("double")
    var = prod / 12 * ((n + 1) - F.col("_ties") / (n * (n - 1)))
    z = F.when(var > 0, F.greatest((F.abs(F.col("u") - prod / 2) - 0.5) / F.sqrt(var), F.lit(0.0))).otherwise(0.0)
    return agg.select(*group, "n_pos", "n_neg", "u", (F.col("u") / prod).alias("auroc"), z.alias("z"))


def welch(df: DataFrame, group: Sequence[str], value: str = "value", label: str = "label", min_class: int = 3) -> DataFrame:
    """Welch t, Welch-Satterthwaite df and Cohen d (pooled SD), from one aggregation."""
    y, v = F.col(label), F.col(value)
    ok = df.where(y.isin(0, 1) & v.isNotNull() & ~F.isnan(v.cast("double")))
    part = lambda f, c: f(F.when(y == c, v))
    a = ok.groupBy(*group).agg(
        part(F.count, 1).alias("n_pos"), part(F.count, 0).alias("n_neg"),
        part(F.avg, 1).alias("mean_pos"), part(F.avg, 0).alias("mean_neg"),
        part(F.var_samp, 1).alias("_v1"), part(F.var_samp, 0).alias("_v0"),
    ).where((F.col("n_pos") >= min_class) & (F.col("n_neg") >= min_class))
    n1, n0 = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    e1, e0 = F.col("_v1") / n1, F.col("_v0") / n0
    diff = F.col("mean_pos") - F.col("mean_neg")
    se2 = e1 + e0
    pooled = F.sqrt(((n1 - 1) * F.col("_v1") + (n0 - 1) * F.col("_v0")) / (n1 + n0 - 2))
    return a.select(
        *group, "n_pos", "n_neg", "mean_pos", "mean_neg",
        F.when(se2 > 0, diff / F.sqrt(se2)).alias("t"),
        F.when(se2 > 0, se2 * se2 / (e1 * e1 / (n1 - 1) + e0 * e0 / (n0 - 1))).alias("dof"),
        F.when(pooled > 0, diff / pooled).otherwise(0.0).alias("cohen_d"),
    )


def chi_square(df: DataFrame, group: Sequence[str], level: str, label: str = "label", min_n: int = 10) -> DataFrame:
    """Chi-square of level x binary label with Cramer V; needs two levels and ``min_n`` rows."""
    group = list(group)
    y = F.col(label)
    cells = df.where(y.isin(0, 1) & F.col(level).isNotNull()).groupBy(*group, level).agg(
        F.sum((y == 1).cast("double")).alias("a"), F.sum((y == 0).cast("double")).alias("b")
    )
    tot = cells.groupBy(*group).agg(F.sum("a").alias("_A"), F.sum("b").alias("_B"), F.count(F.lit(1)).alias("n_levels"))
    tot = tot.where((F.col("n_levels") >= 2) & (F.col("_A") + F.col("_B") >= min_n) & (F.col("_A") > 0) & (F.col("_B") > 0))
    j = cells.join(tot, group) if group else cells.join(F.broadcast(tot))  # one row
    n = F.col("_A") + F.col("_B")
    row = F.col("a") + F.col("b")
    term = lambda o, col: F.pow(F.col(o) - row * F.col(col) / n, 2) / (row * F.col(col) / n)
    out = j.groupBy(*group).agg(
        F.sum(term("a", "_A") + term("b", "_B")).alias("chi2"), F.max("n_levels").alias("n_levels"), F.max(n).alias("_n")
    )
    return out.select(*group, "chi2", (F.col("n_levels") - 1).alias("dof"), F.sqrt(F.col("chi2") / F.col("_n")).alias("cramer_v"))


def with_p(tests: DataFrame, kind: str) -> DataFrame:
    """Two-sided p of finished test rows (one row per feature)."""
    p = {
        "mann_whitney": lambda: normal_two_sided("z"),
        "welch": lambda: student_two_sided("t", "dof"),
        "chi_square": lambda: chi_square_tail("chi2", F.col("dof").cast("double")),
    }[kind]()
    return tests.withColumn("p", p)


def benjamini_hochberg(df: DataFrame, p: str = "p", family: Sequence[str] = (), out: str = "q") -> DataFrame:
    """q = running minimum of p * m / rank from the largest p down. Rows are tests, hence few per family."""
    fam = [F.col(c) for c in family] or [F.lit(0)]
    up = Window.partitionBy(*fam).orderBy(F.col(p).asc_nulls_last())
    m = F.count(p).over(Window.partitionBy(*fam))
    ranked = df.withColumn("_k", F.when(F.col(p).isNotNull(), F.row_number().over(up))).withColumn("_q", F.col(p) * m / F.col("_k"))
    down = Window.partitionBy(*fam).orderBy(F.col("_k").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.min("_q").over(down), F.lit(1.0)))).drop("_k", "_q")


def significance_table(numeric: DataFrame, categorical: DataFrame | None, alpha: float = 0.05) -> DataFrame:
    """Welch rows (with Mann-Whitney z) and chi-square rows in one table: p, q, significance, effect.

    Sorted by significance, then effect size, then p.
    """
    w = with_p(welch(numeric, ["feature"]), "welch").select(
        "feature", F.lit("numeric").alias("kind"), F.lit("Welch t").alias("test"), F.col("t").alias("stat"), "p", F.col("cohen_d").alias("effect")
    )
    out = w
    if categorical is not None:
        c = with_p(chi_square(categorical, ["feature"], "level"), "chi_square").select(
            "feature", F.lit("categorical").alias("kind"), F.lit("chi-square").alias("test"), F.col("chi2").alias("stat"), "p", F.col("cramer_v").alias("effect")
        )
        out = w.unionByName(c)
    out = benjamini_hochberg(out).withColumn("significant", F.col("q") < alpha)
    return out.orderBy(F.col("significant").desc(), F.abs("effect").desc(), "p")


# ------------------------------------------------------------------ resampling
def bootstrap_mean(df: DataFrame, key: str, arms: dict[str, Column], replicates: int, seed: int) -> DataFrame:
    """Weighted mean of each arm per replicate: one row per replicate, arm and task is shuffled."""
    sums = replicates_.weighted_sums(df, key, arms, replicates, seed)
    mean = F.when(F.col("weight") > 0, F.col("total") / F.col("weight"))
    return sums.groupBy("rep").agg(*[F.max(F.when(F.col("name") == a, mean)).alias(a) for a in arms])


def bootstrap_auroc(df: DataFrame, key: str, scores: Sequence[str], label: str, replicates: int, seed: int) -> DataFrame:
    """Weighted AUROC of several scores per replicate, on the same draws: (rep, score, auroc). Rows are shuffled once, without replicates."""
    return replicates_.auroc_vectors(df, key, scores, label, replicates, seed)


def interval(reps: DataFrame, value: str, group: Sequence[str] = ()) -> DataFrame:
    """Mean and 95 % percentile interval over replicates (the replicate count is a parameter)."""
    return reps.groupBy(*group).agg(
        F.count(value).alias("n_rep"), F.avg(value).alias("mean"),
        F.percentile(value, F.lit(0.025)).alias("lo"), F.percentile(value, F.lit(0.975)).alias("hi"),
    )


def paired_delta(reps: DataFrame, a: str, b: str) -> DataFrame:
    """b - a on shared draws: mean, interval and P(delta > 0)."""
    d = reps.withColumn("delta", F.col(b) - F.col(a))
    return d.groupBy().agg(
        F.avg("delta").alias("delta_mean"), F.percentile("delta", F.lit(0.025)).alias("lo"),
        F.percentile("delta", F.lit(0.975)).alias("hi"), F.avg((F.col("delta") > 0).cast("double")).alias("p_gt_0"),
    )


def permutation_auroc(df: DataFrame, key: str, score: str, label: str, replicates: int, seed: int) -> DataFrame:
    """AUROC under permuted labels: per replicate the n_pos smallest hashes become the positives.

    Average ranks of the score are computed once; a replicate needs their sum over its positives, which lie below one hash.
    """
    rows = df.where(F.col(label).isin(0, 1) & F.col(score).isNotNull()).select(key, score, label)
    n, p = rows.agg(F.count(F.lit(1)), F.sum(label)).first()
    if not p or p == n:
        return rows.sparkSession.createDataFrame([], "rep int, auroc double")
    ranks = average_ranks(rows, [], score).select(F.col(score).alias("_s"), "rank")
    ranked = cut_lineage(rows.join(ranks, F.col(score) == F.col("_s")).select(F.col(key).alias("k"), "rank"))
    last = replicates_.nth_smallest(replicates_.stored_keys(ranked, "k"), int(p), replicates, seed)
    sums = replicates_.rank_sums(ranked, "k", "rank", last, replicates, seed)
    return sums.select("rep", ((F.col("rank_sum") - p * (p + 1) / 2) / (p * (n - p))).alias("auroc"))


def permutation_p(null: DataFrame, observed: DataFrame, value: str = "auroc") -> DataFrame:
    """(1 + permutations at least as large) / (1 + permutations)."""
    j = null.select(F.col(value).alias("_n")).join(F.broadcast(observed.select(value)))  # one row
    return j.groupBy(value).agg(
        F.count(F.lit(1)).alias("n_perm"), ((1 + F.sum((F.col("_n") >= F.col(value)).cast("long"))) / (1 + F.count(F.lit(1)))).alias("p_value")
    )


def over_seeds(per_seed: DataFrame, value: str, group: Sequence[str] = ()) -> DataFrame:
    return per_seed.groupBy(*group).agg(F.count(value).alias("n_seeds"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
