"""Cross-site harmonisation and feature selection on the tall table (rec, site, label, feature, value).

Feature x site statistics are aggregated once and joined back on (feature, site). Rows are never
partitioned by site alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tails import normal_quantile
from .describe import describe, sd_pop
from .ranks import average_ranks, cumulate, histogram, quantiles

FS = ["feature", "site"]


def site_median_imputer(df: DataFrame, value: str, min_n: int = 15, site: str = "site") -> DataFrame:
    """Site medians (``min_n`` values at least) and the global median on every row: site, median."""
    by_site = describe(df, [site], value).where(F.col("n") >= min_n).select(site, F.col("median").alias("_m"))
    overall = quantiles(df, [], value, {"_g": 0.5})
    sites = df.select(site).distinct()
    return sites.join(by_site, site, "left").join(F.broadcast(overall)).select(site, F.coalesce("_m", "_g").alias("median"))  # one row


def impute(df: DataFrame, imputer: DataFrame, value: str, site: str = "site") -> DataFrame:
    v = F.when(~F.isnan(F.col(value).cast("double")), F.col(value))
    return df.join(imputer, site, "left").withColumn(value, F.coalesce(v, "median")).drop("median")


def impute_standardise(long: DataFrame, train: Column | None = None) -> DataFrame:
    """Median fill, then (x - mean) / SD of the filled training column."""
    train = F.lit(True) if train is None else train
    med = quantiles(long.where(train), ["feature"], "value", {"_med": 0.5})
    filled = long.join(med, "feature").withColumn("value", F.coalesce("value", "_med")).drop("_med")
    st = filled.where(train).groupBy("feature").agg(F.avg("value").alias("_mu"), F.stddev_pop("value").alias("_sd"))
    return filled.join(st, "feature").withColumn("z", (F.col("value") - F.col("_mu")) / F.when(F.col("_sd") > 0, F.col("_sd")).otherwise(1.0)).drop("_mu", "_sd")


def _keep_protected(new: Column, protect: Sequence[str]) -> Column:
    return F.when(F.col("feature").isin(*protect), F.col("value")).otherwise(new) if protect else new


def site_zscore(long: DataFrame, train: Column | None = None, protect: Sequence[str] = (), min_train: int = 10) -> DataFrame:
    """Training-site statistics where the site has ``min_train`` training rows, else its own rows."""
    train = F.lit(True) if train is None else train
    t = train & F.col("value").isNotNull()
    v = F.when(train, F.col("value"))
    st = long.groupBy(*FS).agg(
        F.sum(train.cast("int")).alias("_n"), F.avg(v).alias("_tm"), F.stddev_pop(v).alias("_ts"),
        F.avg("value").alias("_am"), F.stddev_pop("value").alias("_as"),
    )
    use = F.col("_n") >= min_train
    mu, sd = F.when(use, F.col("_tm")).otherwise(F.col("_am")), F.when(use, F.col("_ts")).otherwise(F.col("_as"))
    st = st.select(*FS, mu.alias("_mu"), F.when(sd < 1e-8, 1.0).otherwise(sd).alias("_sd"))
    z = (F.col("value") - F.col("_mu")) / F.col("_sd")
    return long.join(st, FS).withColumn("harmonised", _keep_protected(z, protect)).drop("_mu", "_sd")


def site_robust(long: DataFrame, train: Column | None = None, mode: str = "adaptive") -> DataFrame:
    """(x - median) / IQR. Training rows use their site; others their own site ("adaptive") or the
    training statistics with a pooled fallback ("deployable")."""
    train = F.lit(True) if train is None else train
    qs = {"_q1": 0.25, "_md": 0.5, "_q3": 0.75}
    scale = F.col("_q3") - F.col("_q1")
    tidy = lambda d, keys, tag: d.select(*keys, F.col("_md").alias(f"_m{tag}"), F.when(scale > 1e-9, scale).otherwise(1.0).alias(f"_s{tag}"))
    tr = tidy(quantiles(long.where(train), FS, "value", qs), FS, "t")
    out = long.withColumn("_train", train).join(tr, FS, "left")
    if mode == "adaptive":
        own = tidy(quantiles(long.where(~train), FS, "value", qs), FS, "o")
        out = out.join(own, FS, "left")
    else:
        pooled = tidy(quantiles(long.where(train), ["feature"], "value", qs), ["feature"], "o")
        out = out.join(pooled, "feature", "left")
        out = out.withColumn("_mo", F.coalesce("_mt", "_mo")).withColumn("_so", F.coalesce("_st", "_so"))
    m = F.when(F.col("_train"), F.col("_mt")).otherwise(F.col("_mo"))
    s = F.when(F.col("_train"), F.col("_st")).otherwise(F.col("_so"))
    return out.withColumn("harmonised", (F.col("value") - m) / s).drop("_train", "_mt", "_st", "_mo", "_so")


def _joined_ranks(long: DataFrame) -> DataFrame:
    return long.join(average_ranks(long, FS, "value"), [*FS, "value"], "left")


def site_rank(long: DataFrame, levels: int = 256, protect: Sequence[str] = ()) -> DataFrame:
    """Average-tie rank inside the site on a fixed grid of levels; a single value maps to 0.5."""
    pr = (F.col("rank") - 1) / (F.col("n_group") - 1)
    grid = F.rint(pr * (levels - 1)) / (levels - 1)
    new = F.when(F.col("n_group") == 1, 0.5).otherwise(grid)
    return _joined_ranks(long).withColumn("harmonised", _keep_protected(new, protect)).drop("n", "rank", "n_group")


def site_inverse_normal(long: DataFrame, blom: float = 0.375, protect: Sequence[str] = ()) -> DataFrame:
    """Blom rankits inside the site. The quantile function runs on distinct ranks, before the join."""
    r = average_ranks(long, FS, "value")
    p = (F.col("rank") - blom) / (F.col("n_group") - 2 * blom + 1)
    r = r.select(*FS, "value", F.when(F.col("n_group") == 1, 0.0).otherwise(normal_quantile(p)).alias("_z"))
    return long.join(r, [*FS, "value"], "left").withColumn("harmonised", _keep_protected(F.col("_z"), protect)).drop("_z")


def combat(long: DataFrame, train: Column | None = None, protect: Sequence[str] = (), min_train: int = 10) -> DataFrame:
    """Grand mean and SD from training rows; EB-shrunk site shift and site scale; unseen sites get the prior mean."""
    train = F.lit(True) if train is None else train
    v = F.when(train, F.col("value"))
    grand = long.groupBy("feature").agg(F.avg(v).alias("_gm"), F.stddev_pop(v).alias("_gs0"))
    grand = grand.select("feature", "_gm", F.when(F.col("_gs0") < 1e-8, 1.0).otherwise(F.col("_gs0")).alias("_gs"))
    site = long.groupBy(*FS).agg(
        F.sum(train.cast("int")).alias("_n"), F.avg(v).alias("_m"), F.var_pop(v).alias("_v")
    ).where(F.col("_n") >= min_train).join(grand, "feature")
    d = F.col("_v") / (F.col("_gs") * F.col("_gs"))
    site = site.select(
        *FS, "_n", ((F.col("_m") - F.col("_gm")) / F.col("_gs")).alias("_g"), F.when(d < 1e-8, 1.0).otherwise(d).alias("_d")
    )
    prior = site.groupBy("feature").agg(F.avg("_g").alias("_gbar"), F.greatest(F.var_pop("_g"), F.lit(1e-8)).alias("_tau2"))
    shrunk = (F.col("_n") * F.col("_g") / F.col("_d") + F.col("_gbar") / F.col("_tau2")) / (F.col("_n") / F.col("_d") + 1 / F.col("_tau2"))
    eff = site.join(prior, "feature").select(*FS, shrunk.alias("_gstar"), F.sqrt("_d").alias("_dstar"))
    j = long.join(grand, "feature").join(prior, "feature").join(eff, FS, "left")
    z = (F.col("value") - F.col("_gm")) / F.col("_gs")
    adj = (z - F.coalesce("_gstar", "_gbar")) / F.coalesce("_dstar", F.lit(1.0))
    new = _keep_protected(adj * F.col("_gs") + F.col("_gm"), protect)
    return j.withColumn("harmonised", new).select(*long.columns, "harmonised")


# ------------------------------------------------------------------ within-night contrasts
STAGE_TOKENS = ("sleep", "nrem", "wake", "rem", "n1", "n2", "n3")


def split_stage(long: DataFrame, prefix: str) -> DataFrame:
    """Feature names ``<prefix><stage>_<metric>`` into stage and metric; other names are dropped."""
    pat = f"^{prefix}({'|'.join(STAGE_TOKENS)})_(.+)$"
    out = long.withColumn("stage", F.regexp_extract("feature", pat, 1)).withColumn("metric", F.regexp_extract("feature", pat, 2))
    return out.where("stage <> ''")


def within_night_ratio(long: DataFrame, keys: Sequence[str], ref: str = "n2", tiny: float = 1e-12) -> DataFrame:
    """f_stage / f_ref for each metric of a recording that has the reference stage."""
    one = [*keys, "metric"]
    base = long.where(F.col("stage") == ref).select(*one, F.col("value").alias("_r"))
    ratio = F.when(F.abs("_r") >= tiny, F.col("value") / F.col("_r"))
    return long.where(F.col("stage") != ref).join(base, one).select(*one, "stage", ratio.alias("ratio"))


def within_night_z(long: DataFrame, keys: Sequence[str], tiny: float = 1e-12) -> DataFrame:
    """(f - mean) / SD across the stages of one metric (two finite stages at least)."""
    one = [*keys, "metric"]
    st = long.groupBy(*one).agg(F.count("value").alias("_n"), F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    ok = (F.col("_n") >= 2) & (F.col("_s") >= tiny)
    return long.join(st, one).select(*one, "stage", F.when(ok, (F.col("value") - F.col("_m")) / F.col("_s")).alias("z"))


# ------------------------------------------------------------------ selection
def site_discriminability(long: DataFrame, train: Column | None = None, min_train: int = 10) -> DataFrame:
    """Between-site over within-site variance per feature, training rows only."""
    train = F.lit(True) if train is None else train
    per = long.where(train).groupBy(*FS).agg(
        F.count(F.lit(1)).alias("_n"), F.avg("value").alias("_m"), (F.var_pop("value") * F.count("value")).alias("_ss"),
        F.sum("value").alias("_t"), F.count("value").alias("_k"),
    )
    grand = per.groupBy("feature").agg((F.sum("_t") / F.sum("_k")).alias("_g"))
    j = per.where(F.col("_n") >= min_train).join(grand, "feature")
    agg = j.groupBy("feature").agg(
        F.sum(F.col("_n") * F.pow(F.col("_m") - F.col("_g"), 2)).alias("_b"), F.greatest(F.sum("_ss"), F.lit(1e-8)).alias("_w"),
        F.count(F.lit(1)).alias("_sites"), F.sum("_n").alias("_tot"),
    )
    between = F.col("_b") / F.greatest(F.col("_sites") - 1, F.lit(1))
    within = F.col("_w") / F.greatest(F.col("_tot") - F.col("_sites"), F.lit(1))
    return agg.select("feature", (between / within).alias("ratio"))


def drop_top_fraction(scores: DataFrame, score: str, fraction: float, protect: Sequence[str] = ()) -> DataFrame:
    """Features that survive dropping the highest-scoring share (one row per feature, a small window)."""
    w = Window.partitionBy(F.lit(0)).orderBy(F.col(score).desc(), "feature")
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    ranked = scores.withColumn("_rn", F.row_number().over(w)).withColumn("_k", F.rint(n * fraction))
    keep = (F.col("_rn") > F.col("_k")) | (F.col("feature").isin(*protect) if protect else F.lit(False))
    return ranked.where(keep).drop("_rn", "_k")


def modal_share(long: DataFrame) -> DataFrame:
    """Share of the commonest value per feature; 0.99 and above counts as near-constant."""
    hist = long.where(F.col("value").isNotNull()).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    out = hist.groupBy("feature").agg((F.max("n") / F.sum("n")).alias("share"))
    return out.withColumn("near_constant", F.col("share") >= 0.99)


def spearman_with_label(long: DataFrame, label: str = "label") -> DataFrame:
    """Spearman correlation of each feature with a binary label, from cumulated class counts."""
    y = F.col(label)
    hist = histogram(long.where(y.isin(0, 1)), ["feature"], "value", {"pos": (y == 1).cast("int"), "neg": (y == 0).cast("int")})
    hist = hist.withColumn("n", F.col("pos") + F.col("neg"))
    cum = cumulate(hist, ["feature"], "value", ("n", "pos"))
    r = F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2
    dev = r - (F.col("tot_n") + 1) / 2
    agg = cum.groupBy("feature").agg(
        F.max("tot_n").alias("n"), F.max("tot_pos").alias("_p"), F.sum(F.col("pos") * dev).alias("_cov"), F.sum(F.col("n") * dev * dev).alias("_ss")
    )
    # label ranks are two values n/2 apart, so cov(rank, label rank) reduces to the positives' rank sum
    n, p = F.col("n"), F.col("_p")
    rho = F.col("_cov") * n / 2 / F.sqrt(F.col("_ss") * p * (n - p) * n / 4)
    return agg.select("feature", "n", F.when((F.col("_ss") > 0) & (p > 0) & (p < n), rho).alias("rho"))


def rank_matrix(long: DataFrame, key: str, features: Sequence[str]) -> DataFrame:
    """Wide table of average ranks, one row per recording with all features present."""
    r = average_ranks(long, ["feature"], "value").select("feature", "value", "rank")
    tall = long.where(F.col("value").isNotNull()).join(r, ["feature", "value"])
    wide = tall.groupBy(key).agg(*[F.max(F.when(F.col("feature") == f, F.col("rank"))).alias(f) for f in features])
    return wide.dropna(subset=list(features))


def spearman_pairs(long: DataFrame, key: str, features: Sequence[str]) -> DataFrame:
    """Feature-by-feature Spearman matrix as rows i<j (the d x d Gram matrix is what reaches the driver)."""
    wide = rank_matrix(long, key, features)
    vec = VectorAssembler(inputCols=list(features), outputCol="v").transform(wide).select("v")
    m = Correlation.corr(vec, "v", "pearson").head()[0].toArray()
    rows = [(features[i], features[j], float(m[i, j])) for i in range(len(features)) for j in range(i + 1, len(features))]
    return long.sparkSession.createDataFrame(rows, "feature_i STRING, feature_j STRING, rho DOUBLE")


def prune_collinear(pairs: DataFrame, order: Sequence[str], threshold: float = 0.6) -> list[str]:
    """Greedy pass in label order over the small d x d matrix: a kept feature removes later correlated ones."""
    rho = {(r.feature_i, r.feature_j): round(abs(r.rho), 6) for r in pairs.collect()}
    kept: list[str] = []
    for f in order:
        if all(rho.get((f, k), rho.get((k, f), 0.0)) <= threshold for k in kept):
            kept.append(f)
    return kept


def auroc_filter(long: DataFrame, minimum: float = 0.6, train: Column | None = None, label: str = "label") -> DataFrame:
    """Features whose training AUROC, folded to at least 0.5, reaches the minimum."""
    train = F.lit(True) if train is None else train
    from .ranks import auroc

    a = auroc(long.where(train & F.col(label).isin(0, 1)), ["feature"], "value", label)
    folded = F.greatest(F.col("auroc"), 1 - F.col("auroc"))
    return a.select("feature", "auroc", folded.alias("folded")).where(F.col("folded") >= minimum)


def selector_consensus(scores: DataFrame) -> DataFrame:
    """(method, feature, importance) -> mean and median rank, top-10 and top-20 counts across methods."""
    w = Window.partitionBy("method").orderBy(F.col("importance").desc(), "feature")  # one row per feature
    ranked = scores.withColumn("rank", F.row_number().over(w))
    return ranked.groupBy("feature").agg(
        F.avg("rank").alias("mean_rank"), F.median("rank").alias("median_rank"),
        F.sum((F.col("rank") <= 10).cast("long")).alias("top10"), F.sum((F.col("rank") <= 20).cast("long")).alias("top20"),
    )


def feature_sd(long: DataFrame) -> DataFrame:
    return describe(long, ["feature"], "value").select("feature", "mean", sd_pop().alias("sd"))
