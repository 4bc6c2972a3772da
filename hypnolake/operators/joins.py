"""Joins on ranges and on tolerant keys, rewritten as bucketed equi-joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


class DuplicateKeys(ValueError):
    """A table that must hold one row per key does not."""


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    at: str,
    start: str,
    end: str,
    width: float,
) -> DataFrame:
    """Points with start <= at < end. Each interval is copied to the ``width`` buckets it covers."""
    b = F.floor(F.col(at) / width)
    spans = F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))
    left = points.withColumn("_b", b)
    right = intervals.where(F.col(start) < F.col(end)).withColumn("_b", F.explode(spans))
    hit = (F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))
    return left.join(right, [*keys, "_b"]).where(hit).drop("_b")


PAIRS_A_KEY = 1_000_000  # candidate pairs of a bucket beyond which its left rows are dealt over several keys
PAIRS_A_TASK = 10_000_000


def _dealt(l: DataFrame, r: DataFrame, on: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Both sides with a part number, so that no part of a bucket has many more than ``PAIRS_A_KEY`` candidate pairs, and the left side over enough tasks.

    A few close values make few buckets, however many rows there are; their left rows are dealt, their right rows copied to every part.
    """
    n_l = l.groupBy(*[F.col(a) for a in on]).agg(F.count(F.lit(1)).alias("_nl"))
    n_r = r.groupBy(*[F.col(b).alias(a) for a, b in on.items()]).agg(F.count(F.lit(1)).alias("_nr"))
    pairs = F.col("_nl").cast("double") * F.col("_nr")
    sizes = n_l.join(n_r, list(on)).select(*on, pairs.alias("_n"), F.least(F.ceil(pairs / PAIRS_A_KEY), F.col("_nl")).cast("int").alias("_parts"))
    sizes = cut_lineage(sizes)
    total = sizes.agg(F.sum("_n")).first()[0] or 0.0
    if total <= PAIRS_A_TASK:
        return l.withColumn("_s", F.lit(0)), r.withColumn("_rs", F.lit(0))
    wide = sizes.where("_parts > 1").select(*on, "_parts")
    mine = wide.select(*[F.col(a).alias(b) for a, b in on.items()], F.col("_parts").alias("_rparts"))
    columns = l.columns
    l = l.join(wide, list(on), "left").select(*columns, F.pmod(F.monotonically_increasing_id(), F.coalesce("_parts", F.lit(1))).cast("int").alias("_s"))
    columns = r.columns
    r = r.join(mine, list(on.values()), "left").select(*columns, F.explode(F.sequence(F.lit(0), F.coalesce("_rparts", F.lit(1)) - 1)).alias("_rs"))
    return l.repartition(int(total // PAIRS_A_TASK) + 1, *on, "_s"), r


def range_join(left: DataFrame, right: DataFrame, l_col: str, r_col: str, gap: float, keys: Sequence[str] = (), how="inner") -> DataFrame:
    """|left - right| <= gap. ``gap`` 0 is an equi-join; else the right side visits three buckets."""
    if gap == 0:
        l, r = left.withColumn("_b", F.col(l_col).cast("double")), right.withColumn("_b", F.col(r_col).cast("double"))
        return l.join(r, [*keys, "_b"], how).drop("_b")
    l = left.withColumn("_b", F.floor(F.col(l_col) / gap))
    near = F.array(*[F.floor(F.col(r_col) / gap) + d for d in (-1, 0, 1)])
    r = right.withColumn("_rb", F.explode(near))
    on = {"_b": "_rb", **{k: f"_r_{k}" for k in keys}}
    cond = (F.col("_s") == F.col("_rs")) & (F.col("_b") == F.col("_rb")) & (F.abs(F.col(l_col) - F.col(r_col)) <= gap)
    if keys:
        r = r.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in r.columns])
        for k in keys:
            cond &= F.col(k) == F.col(f"_r_{k}")
    l, r = _dealt(l, r, on)
    out = l.join(r, cond, how)
    return out.drop("_b", "_rb", "_s", "_rs", *[f"_r_{k}" for k in keys])


def assert_unique(df: DataFrame, keys: Sequence[str], name: str = "table") -> DataFrame:
    """Fail on the first duplicated key."""
    dup = df.groupBy(*keys).count().where("count > 1").take(1)
    if dup:
        raise DuplicateKeys(f"{name}: duplicate key {dup[0].asDict()}")
    return df


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key by mergeable aggregation (no per-key sort, so hot keys combine map-side)."""
    rest = [c for c in df.columns if c not in keys]
    row = F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return df.groupBy(*keys).agg(row).select(*keys, "_r.*").select(*df.columns)


def join_families(base: DataFrame, families: dict[str, DataFrame], keys: Sequence[str], on_duplicate: str = "error") -> DataFrame:
    """One-to-one left joins; every non-key column gets its family prefix. Keys are trimmed strings."""
    out = _clean_keys(base, keys)
    for name, fam in families.items():
        fam = _clean_keys(fam, keys)
        if on_duplicate == "error":
            assert_unique(fam, keys, name)
        else:
            fam = first_per_key(fam, keys, [c for c in fam.columns if c not in keys])
        fam = prefixed(fam, name, keys).withColumn(f"{name}__matched", F.lit(1))
        out = out.join(fam, list(keys), "left").withColumn(
            f"{name}__matched", F.coalesce(f"{name}__matched", F.lit(0))
        )
    return out


def _clean_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.withColumns({k: F.trim(F.col(k).cast("string")) for k in keys})


def prefixed(df: DataFrame, family: str, keys: Sequence[str]) -> DataFrame:
    return df.withColumnsRenamed({c: f"{family}__{c}" for c in df.columns if c not in keys})


def epoch_of(second: Column, epoch_s: float = 30.0) -> Column:
    """Epoch that contains a second; join key for event-to-epoch containment."""
    return F.floor(second / epoch_s).cast("long")


def containment_join(events: DataFrame, epochs: DataFrame, keys: Sequence[str], second: str, epoch_s: float = 30.0) -> DataFrame:
    """Attach the stage of the epoch an event starts in."""
    return events.withColumn("epoch", epoch_of(F.col(second), epoch_s)).join(epochs, [*keys, "epoch"], "left")


def align_rates(epochs: DataFrame, seconds: DataFrame, keys: Sequence[str], epoch_s: int = 30) -> DataFrame:
    """Repeat per-epoch rows onto the 1 Hz axis; the shorter stream bounds the result."""
    per_s = F.explode(F.sequence(F.col("epoch") * epoch_s, F.col("epoch") * epoch_s + epoch_s - 1))
    return epochs.withColumn("sec", per_s).join(seconds, [*keys, "sec"])


def nearest_resample(axis: DataFrame, stream: DataFrame, keys: Sequence[str], fs: str = "fs") -> DataFrame:
    """Value of the sample nearest each whole second (index arithmetic, then an equi-join).

    ``axis`` carries the stream's rate and last index so that the tail clamps to it.
    """
    idx = F.least(F.bround(F.col("sec") * F.col(fs)).cast("long"), F.col("last_idx"))
    return axis.withColumn("idx", idx).join(stream, [*keys, "idx"])


def pairs(df: DataFrame, keys: Sequence[str], node: str, cols: Sequence[str]) -> DataFrame:
    """Unordered pairs i<j of a bounded node set (channels of one montage) at the same key."""
    a = df.select(*keys, *[F.col(c).alias(f"{c}_i") for c in (node, *cols)])
    b = df.select(*keys, *[F.col(c).alias(f"{c}_j") for c in (node, *cols)])
    return a.join(b, list(keys)).where(F.col(f"{node}_i") < F.col(f"{node}_j"))


def coverage(tables: dict[str, DataFrame], keys: Sequence[str], site: str) -> DataFrame:
    """Per-site presence counts and gaps of several modalities, from one tagged union (no full outer joins)."""
    tagged = None
    for name, df in tables.items():
        part = df.select(*keys, site, F.lit(name).alias("_m"))
        tagged = part if tagged is None else tagged.unionByName(part)
    per_key = tagged.groupBy(*keys, site).agg(*[F.max((F.col("_m") == m).cast("int")).alias(m) for m in tables])
    names = list(tables)
    gaps = [
        F.sum(((F.col(a) == 1) & (F.col(b) == 0)).cast("long")).alias(f"{a}_without_{b}")
        for a in names for b in names if a != b
    ]
    return per_key.groupBy(site).agg(*[F.sum(F.col(m).cast("long")).alias(f"n_{m}") for m in names], *gaps)


def session_match(wanted: DataFrame, files: DataFrame, pid: str, session: str, file_session: str, file_name: str) -> DataFrame:
    """Best file per wanted (pid, session): exact session, zero-padded session, else first by name.

    Files shrink to one candidate per session, per unpadded session and per patient first, so a
    patient with very many files and sessions never forms a product.
    """
    bare = lambda c: F.ltrim(F.col(c), F.lit("0"))
    first = F.min(F.struct(F.col(file_name), F.col(file_session)))
    exact = files.groupBy(pid, F.col(file_session).alias(session)).agg(first.alias("_f0"))
    padded = files.groupBy(pid, bare(file_session).alias("_bare")).agg(first.alias("_f1"))
    any_file = files.groupBy(pid).agg(first.alias("_f2"))
    j = wanted.withColumn("_bare", bare(session)).join(any_file, pid).join(exact, [pid, session], "left").join(padded, [pid, "_bare"], "left")
    best = F.coalesce("_f0", "_f1", "_f2")
    rank = F.when(F.col("_f0").isNotNull(), 0).when(F.col("_f1").isNotNull(), 1).otherwise(2)
    return j.withColumn("_f", best).withColumn("match_rank", rank).select(
        *wanted.columns, F.col(f"_f.{file_name}").alias(file_name), F.col(f"_f.{file_session}").alias(file_session), "match_rank"
    )


def anti_gaps(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right.select(*keys).distinct(), list(keys), "left_anti")


def with_any(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right.select(*keys), list(keys), "left_semi")


def scorer_agreement(a: DataFrame, b: DataFrame, keys: Sequence[str], stage: str = "stage", unknown: int = 9) -> DataFrame:
    """Epoch-aligned agreement of two scorers over epochs both scored."""
    l = a.select(*keys, "epoch", F.col(stage).alias("_a")).where(F.col("_a") != unknown)
    r = b.select(*keys, "epoch", F.col(stage).alias("_b")).where(F.col("_b") != unknown)
    return l.join(r, [*keys, "epoch"]).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_epochs"), F.avg((F.col("_a") == F.col("_b")).cast("double")).alias("agreement")
    )
