"""Quality rules with host-level verdicts, in DataFrame functions only.

Rules are measured per document. Their failures are counted by host, a beta prior is fitted to the hosts' failure rates by the method
of moments, and each rate is shrunk towards it: a host with few documents is judged by the corpus, a large one by itself.
A document is kept if it passes the base rule and its host's shrunk failure rate stays under the limit.

Repeated 8-word windows are found inside the row: window hashes are compared by a distinct count first, and only texts that
repeat one sort them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hypnolake.session import cut_lineage

from .common import query, table

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT = 30
MAX_HOST_RATE = 0.5
BROADCAST_HOSTS = 100_000
_SPACE = r"[\x20\x09-\x0D]+"
_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _not_empty(parts: Column) -> Column:
    return F.filter(parts, lambda w: w != "")


def _covered(positions: Column, window: int) -> Column:
    """Number of words under windows of ``window`` words at the ascending ``positions``."""
    n = F.size(positions)
    steps = F.zip_with(F.slice(positions, 2, F.greatest(n - 1, F.lit(0))), F.slice(positions, 1, F.greatest(n - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(window)))
    return F.when(n == 0, F.lit(0)).otherwise(F.aggregate(steps, F.lit(0), lambda s, x: s + x) + window)


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", window: int = WINDOW) -> DataFrame:
    """The row as ``doc``, doc_id, host and the five measures per row of ``docs``. Null text has no words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), text.alias("text"), _not_empty(F.split(text, _SPACE)).alias("words"))
    n = F.size("words")
    rows = rows.select(
        "doc", "doc_id", "host", "words", n.alias("n_words"),
        F.char_length(F.array_join("words", "")).alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    rows = rows.select(
        "doc", "doc_id", "host", "words", "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.when(F.col("n_words") > window, F.transform(F.sequence(F.lit(1), F.col("n_words") - (window - 1)), lambda i: F.xxhash64(F.slice("words", i, window)))).alias("hashes"),
    )
    rows = rows.withColumn(
        "ordered",
        F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    )
    m = F.size("ordered")
    twins = F.zip_with(F.slice("ordered", 1, m - 1), F.slice("ordered", 2, m - 1), lambda a, b: F.when(a.h == b.h, F.array(a.i, b.i)))
    rows = rows.withColumn("at", F.when(F.col("ordered").isNotNull(), F.sort_array(F.array_distinct(F.flatten(F.filter(twins, lambda x: x.isNotNull()))))))
    repeat = F.when(F.col("at").isNull(), F.lit(0)).otherwise(_covered(F.col("at"), window))
    return rows.select("doc", "doc_id", "host", *(F.col(c).cast("long").alias(c) for c in _MEASURES[:-1]), repeat.cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


def host_verdicts(measured: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """host, n_docs, n_failed, rate (shrunk) and host_kept, one row per host; null is a host like any other.

    The prior beta(m s, (1 - m) s) has the mean m of the hosts' rates; its strength s comes from their spread, with the sampling noise
    taken off. Hosts that do not differ beyond noise get the strength 1e6, one host alone 0. Only m and s reach the driver.
    """
    hosts = measured.groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    raw = F.col("n_failed") / F.col("n_docs")
    k, m, v, inv = hosts.agg(F.count("*"), F.avg(raw), F.var_samp(raw), F.avg(1 / F.col("n_docs"))).first()
    m = m or 0.0
    if k < 2:
        strength = 0.0
    else:
        spread = m * (1 - m)
        between = v - spread * inv
        strength = 1e6 if between <= 0 or spread <= 0 else min(max(spread / between - 1, 0.0), 1e6)
    rate = (F.col("n_failed") + m * strength) / (F.col("n_docs") + strength)
    return hosts.select("host", "n_docs", "n_failed", rate.alias("rate"), (rate <= max_rate).alias("host_kept"))


def _sized(hosts: DataFrame) -> DataFrame:
    """``hosts`` written once, and broadcast while their number allows it: else the join is by host, and Spark splits a frequent one."""
    hosts = cut_lineage(hosts)
    return F.broadcast(hosts) if hosts.count() <= BROADCAST_HOSTS else hosts


def _measured(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """The measures and base_failed, with the whole row as ``doc``, written once: host counts and verdicts both read them."""
    return measures(docs, id_col, text_col, host_col).withColumn("base_failed", base_failed())


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Measures, base_failed, host_rate and kept per row of ``docs``.

    The measures are written once to the shared folder and read for the host counts and for the join. Counting combines before
    its shuffle; the hosts are broadcast while at most ``BROADCAST_HOSTS``, else joined by host. Null text has
    no words and fails; a null host is one host; equal rows are judged alike and all stay; an empty table gives none; other columns
    are not read.
    """
    measured = cut_lineage(_measured(docs, id_col, text_col, host_col).drop("doc"))
    hosts = _sized(host_verdicts(measured, max_rate).select(F.col("host").alias("host_"), "rate", "host_kept"))
    joined = measured.join(hosts, F.col("host").eqNullSafe(F.col("host_")))
    kept = ~F.col("base_failed") & F.col("host_kept")
    return joined.select("doc_id", *_MEASURES, "base_failed", F.col("rate").alias("host_rate"), kept.alias("kept"))


def keep_good(docs: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns."""
    measured = cut_lineage(_measured(docs, "doc_id", "text", "source").select("doc", "host", "base_failed"))
    bad = _sized(host_verdicts(measured, max_rate).filter("NOT host_kept").select(F.col("host").alias("host_")))
    good = measured.filter("NOT base_failed").join(bad, F.col("host").eqNullSafe(F.col("host_")), "left_anti")
    return good.select(*(F.col("doc").getField(c).alias(c) for c in docs.columns))


_WORDS = r"[w FOR w IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF w <> '']"
_LINES = r"[s FOR s IN string_split(text, chr(10)) IF regexp_matches(s, '[^\x20\x09-\x0D]')]"
SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS} AS words FROM documents),
windows AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS span FROM d, LATERAL (SELECT unnest(range(1, len(words) - 6)) AS i) WHERE len(words) >= 8),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, span) AS c FROM windows) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, (SELECT unnest(range(8)) AS j) GROUP BY doc_id),
m AS (
  SELECT doc_id, source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len({_LINES}) - len(list_distinct({_LINES})) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN covered USING (doc_id)
),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed FROM m),
hosts AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS bad FROM b GROUP BY source),
p AS (SELECT count(*) AS k, avg(bad / n) AS m, var_samp(bad / n) - avg(bad / n) * (1 - avg(bad / n)) * avg(1 / n) AS between_hosts FROM hosts),
s AS (SELECT m, CASE WHEN k < 2 THEN 0.0 WHEN between_hosts <= 0 OR m * (1 - m) <= 0 THEN 1e6
  ELSE least(greatest(m * (1 - m) / between_hosts - 1, 0.0), 1e6) END AS strength FROM p),
v AS (SELECT source, (bad + m * strength) / (n + strength) AS rate FROM hosts, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(rate, 6) AS host_rate,
  NOT base_failed AND rate <= {MAX_HOST_RATE} AS kept
FROM b JOIN v ON b.source IS NOT DISTINCT FROM v.source
"""


@query("op9_quality_hosts", SQL)
def op9_quality_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document judged by its own and its host's failures."""
    return judge(table(spark, sf_dir, "documents")).withColumn("host_rate", F.round("host_rate", 6))
