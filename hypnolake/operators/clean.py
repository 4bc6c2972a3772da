"""Projections that clean keys, demographics, labels, channels and feature sets."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ------------------------------------------------------------------ scalars
TRUE_WORDS = ("true", "t", "yes", "y", "1", "1.0")
FALSE_WORDS = ("false", "f", "no", "n", "0", "0.0")


def stripped(c: Column) -> Column:
    """Drop quotes, brackets and spaces around scalar text."""
    return F.regexp_replace(c.cast("string"), r"""["'\[\]()\s]""", "")


def to_number(c: Column) -> Column:
    return finite(stripped(c).try_cast("double"))


def to_int(c: Column) -> Column:
    """Whole numbers only: 3.0 is an integer, 3.5 is not."""
    v = to_number(c)
    return F.when(v == F.floor(v), v.cast("long"))


def to_bool(c: Column) -> Column:
    w = F.lower(stripped(c))
    return F.when(w.isin(*TRUE_WORDS), 1).when(w.isin(*FALSE_WORDS), 0)


label01 = to_bool


def finite(c: Column) -> Column:
    """NULL for NaN and infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def rounded(c: Column, digits: int) -> Column:
    return F.bround(finite(c.cast("double")), digits)


# ------------------------------------------------------------------ demographics
def has_any(c: Column, words: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def sex(c: Column) -> Column:
    v = F.lower(F.trim(c))
    return F.when(v.startswith("f"), "Female").when(v.startswith("m"), "Male").otherwise("Unknown")


# Fixed keyword lists of the demographic rules.
UNAVAILABLE = ("unknown", "unavailable", "declined", "unreported", "nan", "none", "not specified", "prefer not to say")


def race(c: Column) -> Column:
    v = F.coalesce(F.lower(F.trim(c)), F.lit(""))
    return (
        F.when(has_any(v, ("white", "caucasian")), "White")
        .when(has_any(v, ("black", "african american")), "Black")
        .when(v.contains("asian"), "Asian")
        .when((v == "") | has_any(v, UNAVAILABLE), "Unavailable")
        .otherwise("Others")
    )


def ethnicity(c: Column) -> Column:
    v = F.coalesce(F.lower(F.trim(c)), F.lit(""))
    return (
        F.when(v.rlike(r"\b(not|non)[ -]*(hispanic|latin)"), "Not Hispanic")
        .when((v == "") | has_any(v, UNAVAILABLE), "Unavailable")
        .when(has_any(v, ("hispanic", "latino")), "Hispanic")
        .otherwise("Unavailable")
    )


def demographic_one_hot(df: DataFrame, sex_c: str = "sex", race_c: str = "race", eth_c: str = "ethnicity") -> DataFrame:
    s, r, e = sex(F.col(sex_c)), race(F.col(race_c)), ethnicity(F.col(eth_c))
    flags = {
        "sex_f": s == "Female", "sex_m": s == "Male", "sex_o": ~s.isin("Female", "Male"),
        **{f"race_{k}": r == v for k, v in
           {"asian": "Asian", "black": "Black", "other": "Others", "unavail": "Unavailable", "white": "White"}.items()},
        "eth_hispanic": e == "Hispanic", "eth_not_hispanic": e == "Not Hispanic", "eth_unavail": e == "Unavailable",
    }
    return df.withColumns({k: v.cast("int") for k, v in flags.items()})


def banded(c: Column, edges: Sequence[float], names: Sequence[str]) -> Column:
    """Left-closed bands; NULL becomes "unknown"."""
    out = F.when(c.isNull() | F.isnan(c.cast("double")), "unknown")
    for e, n in zip(edges, names):
        out = out.when(c < e, n)
    return out.otherwise(names[-1])


def age_band(c: Column) -> Column:
    return banded(c, (50, 60, 70, 80), ("<50", "50-59", "60-69", "70-79", "80+"))


def bmi_class(c: Column) -> Column:
    return banded(c, (18.5, 25, 30), ("under", "normal", "over", "obese"))


def ahi_severity(c: Column) -> Column:
    return banded(c, (5, 15, 30), ("none", "mild", "moderate", "severe"))


def age_decade(c: Column) -> Column:
    return (F.floor(c / 10) * 10).cast("int")


# ------------------------------------------------------------------ channels
def alias_table(table: DataFrame, names: str = "Channel_Names", category: str = "Category") -> DataFrame:
    """One row per alias: rule order, standard name (first alias), alias, position."""
    ruled = table.withColumn("_parts", F.split(F.regexp_replace(names, '"', ""), ";"))
    ex = ruled.select("rule", category, "_parts", F.posexplode("_parts").alias("position", "_a"))
    alias = clean_channel(F.col("_a"))
    std = F.lower(F.trim(F.element_at("_parts", 1)))
    return ex.select("rule", std.alias("std_channel"), alias.alias("alias"), "position", category).where("alias <> ''")


def clean_channel(c: Column) -> Column:
    v = F.regexp_replace(F.lower(F.trim(c)), "(_pds|_eg)", "")
    return F.trim(F.replace(v, F.lit(":"), F.lit("-")))


def standardise_channels(channels: DataFrame, aliases: DataFrame, keys: Sequence[str], channel: str = "channel") -> DataFrame:
    """Keep the first alias (rule order, then position) of each standard name; other aliases are dropped.

    Unknown labels keep their cleaned name. ``pulse``/``pr`` become ``hr`` when no hr exists.
    """
    keys = list(keys)
    named = channels.withColumn("alias", clean_channel(F.col(channel)))
    first_rule = aliases.groupBy("alias").agg(F.min_by(F.struct("std_channel", "position"), F.struct("rule", "position")).alias("_r"))
    j = named.join(first_rule.select("alias", "_r.*"), "alias", "left").withColumn(
        "std_channel", F.coalesce("std_channel", "alias")
    )
    w = Window.partitionBy(*keys, "std_channel").orderBy(F.coalesce("position", F.lit(-1)), channel)  # one montage
    kept = j.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "alias", "position")
    per = Window.partitionBy(*keys)
    has_hr = F.max((F.col("std_channel") == "hr").cast("int")).over(per) == 1
    pulse = F.row_number().over(Window.partitionBy(*keys).orderBy(~F.col("std_channel").isin("pulse", "pr"), "std_channel"))
    promoted = F.col("std_channel").isin("pulse", "pr") & ~has_hr & (pulse == 1)
    return kept.withColumn("std_channel", F.when(promoted, "hr").otherwise(F.col("std_channel")))


# Fixed role cues: role -> (whole tokens, substrings); first match wins.
ROLE_CUES = (
    ("ecg", ("ecg", "ekg"), ("ecg", "ekg")),
    ("spo2", ("spo2", "sao2"), ("spo2", "sao2")),
    ("chin_emg", ("chin",), ("chin",)),
    ("limb_emg", ("lat", "rat", "leg"), ("leg",)),
    ("eog", ("e1", "e2", "loc", "roc"), ("eog",)),
    ("airflow", ("airflow", "flow", "ptaf", "nasal"), ("flow",)),
    ("effort", ("chest", "abd", "abdomen", "thor", "thorax"), ("effort",)),
    ("eeg", ("f3", "f4", "c3", "c4", "o1", "o2", "fz", "cz", "m1", "m2"), ("eeg",)),
)


def channel_role(c: Column) -> Column:
    low = F.lower(c)
    tokens = F.split(low, "[^a-z0-9]+")
    out = None
    for role, words, subs in ROLE_CUES:
        hit = F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in words])) | has_any(low, subs)
        out = F.when(hit, role) if out is None else out.when(hit, role)
    return out.otherwise("other")


def pick_channel(channels: DataFrame, keys: Sequence[str], role: str, prefer: Sequence[str], channel: str = "channel") -> DataFrame:
    """One channel per recording with the wanted role: earliest preference substring, then name."""
    low = F.lower(F.col(channel))
    rank = F.lit(len(prefer))
    for i, sub in reversed(list(enumerate(prefer))):
        rank = F.when(low.contains(sub), i).otherwise(rank)
    cand = channels.where(F.col("role") == role)
    best = F.min_by(channel, F.struct(rank.alias("_p"), F.col(channel)))
    return cand.groupBy(*keys).agg(best.alias(channel))


def bipolar(a: Column, b: Column, c: Column | None = None) -> Column:
    """A-B, or A-(B+C)/2, sample by sample."""
    if c is None:
        return F.zip_with(a, b, lambda x, y: x - y)
    ref = F.zip_with(b, c, lambda x, y: (x + y) / 2)
    return F.zip_with(a, ref, lambda x, y: x - y)


def zscore_channels(chunks: DataFrame, keys: Sequence[str], samples: str = "samples", channel: str = "std_channel") -> DataFrame:
    """(x - mean) / population SD per recording and channel; SpO2 passes through, positions are kept.

    Chunk-level sums merge map-side, so samples are never exploded across the shuffle.
    """
    ok = F.filter(F.transform(samples, lambda x: x.cast("double")), lambda x: x.isNotNull() & ~F.isnan(x))
    part = chunks.withColumn("_ok", ok)
    add = lambda arr, f: F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + f(x))
    one = [*keys, channel]
    mean = part.groupBy(*one).agg(F.sum(F.size("_ok")).alias("_n"), (F.sum(add("_ok", lambda x: x)) / F.sum(F.size("_ok"))).alias("_mu"))
    j = part.join(mean, one)
    dev = F.aggregate("_ok", F.lit(0.0), lambda acc, x: acc + (x - F.col("_mu")) * (x - F.col("_mu")))
    var = j.withColumn("_q", dev).groupBy(*one).agg((F.sum("_q") / F.max("_n")).alias("_var"))
    z = j.join(var, one)
    scale = F.when(F.col("_var") > 0, F.sqrt("_var")).otherwise(1.0)
    exempt = F.col(channel).contains("spo2") | F.col(channel).contains("sao2") | (F.col("_n") < 2)
    out = F.transform(samples, lambda x: F.when(exempt, x.cast("double")).otherwise((x - F.col("_mu")) / scale))
    return z.withColumn(samples, out).select(*chunks.columns)


# ------------------------------------------------------------------ feature sets
# Fixed rules: the names of each block; what no rule names is of the annotation block.
BLOCK_RULES = {"age": r"age$", "body": r"sex_|race_|eth_|bmi", "autonomic": r"hr_mean|hrv_|spo2_|auto_"}
# Fixed presets: the blocks each one keeps, and those whose extraction adds the transition and arousal columns.
PRESETS = {
    "submit": {"body", "autonomic", "annotation"},
    "caisr_autonomic": {"autonomic", "annotation"},
    "caisr_only": {"annotation"},
    "autonomic_only": {"autonomic"},
    "legacy_no_eeg": {"age", "body", "autonomic", "annotation"},
    "extract_all": {"age", "body", "autonomic", "annotation"},
}

WITH_ARCHITECTURE = {"submit"}


def preset_columns(columns: Sequence[str], preset: str) -> list[str]:
    kept = PRESETS[preset]
    unwanted = "|".join(rule for block, rule in BLOCK_RULES.items() if block not in kept)
    named = "|".join(BLOCK_RULES.values())
    out = [c for c in columns if not (unwanted and re.match(unwanted, c))]
    return out if "annotation" in kept else [c for c in out if re.match(named, c)]


def select_preset(df: DataFrame, keys: Sequence[str], preset: str) -> DataFrame:
    return df.select(*keys, *preset_columns([c for c in df.columns if c not in keys], preset))


def mask_columns(df: DataFrame, pattern: str, keys: Sequence[str], drop: bool = False) -> DataFrame:
    """Ablation: NULL out (or drop) every feature column whose name matches."""
    hit = [c for c in df.columns if c not in keys and re.search(pattern, c)]
    if drop:
        return df.drop(*hit)
    return df.withColumns({c: F.lit(None).cast(df.schema[c].dataType) for c in hit})


# Fixed list of identifiers, outcome times and provenance columns that must not reach a test or model.
LEAKY = ("bids_folder", "session", "dataset", "site_name", "label", "time_to_event", "time_to_last_visit", "last_visit", "creation_time")


def drop_leaky(df: DataFrame, keep: Sequence[str] = (), guard: Sequence[str] = ("age",)) -> DataFrame:
    out = df.drop(*[c for c in LEAKY if c not in keep])
    left = [c for c in out.columns if c.lower() in guard and c not in keep]
    if left:
        raise ValueError(f"leakage guard: {left}")
    return out


def common_features(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Align two tables on their shared columns, in the first table's order."""
    shared = [c for c in a.columns if c in set(b.columns)]
    return a.select(*shared), b.select(*shared)


# ------------------------------------------------------------------ envelopes
def envelope(df: DataFrame, keys: Sequence[str], idx: str, value: str, buckets: int) -> DataFrame:
    """Min/max down-sampling: per bucket the minimum and the maximum sample, in time order."""
    keys = list(keys)
    size = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    b = F.floor(F.col(idx) * buckets / F.col("_n")).cast("int")
    per = df.join(size, keys).groupBy(*keys, b.alias("bucket")).agg(
        F.min(F.struct(F.col(value), F.col(idx))).alias("_lo"),
        F.max(F.struct(F.col(value), -F.col(idx))).alias("_hi"),
    )
    lo_i, hi_i = F.col(f"_lo.{idx}"), -F.col("_hi").getField("col2")
    points = F.array_sort(F.array(
        F.struct(lo_i.alias(idx), F.col(f"_lo.{value}").alias(value)), F.struct(hi_i.alias(idx), F.col(f"_hi.{value}").alias(value))
    ))
    return per.withColumn("_p", F.explode(F.array_distinct(points))).select(*keys, "bucket", f"_p.{idx}", f"_p.{value}")
