"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A text is the weighted set of its words, weighted by how often they stand in it. For sample k a word draws r, c ~ Gamma(2, 1) and
b ~ U(0, 1) from its hash and k alone; with t = floor(ln w / r + b) the word's value is ln c - r (t - b + 1), and the word of least value is the
text's sample, named by (word, t). Two texts have the same sample with a probability equal to their generalised Jaccard
similarity, so the share of equal samples estimates it.

One shuffle of the texts, by document: the explode into words, the count per word and the least value per sample all keep that
partitioning. Each sample is one aggregate of a 64-bit key: value first, then the hash of (word, t), which also settles ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hypnolake.session import cut_lineage

from .common import id_text, query, table

SAMPLES = 32
_GOLDEN = 0x9E3779B1


def _uniform(hashed: Column, shift: int, bits: int) -> Column:
    """In (0, 1): ``bits`` bits of a hash, from bit ``shift``."""
    return (F.shiftrightunsigned(hashed, shift).bitwiseAND(F.lit((1 << bits) - 1)) + 0.5) * 2.0**-bits


def sample_key(word_hash: Column, log_weight: Column, k: int) -> Column:
    """Sample k's 64-bit key of a word: ascending in its value; the low half names (word, t)."""
    one, two = F.xxhash64(word_hash, F.lit(2 * k)), F.xxhash64(word_hash, F.lit(2 * k + 1))
    r = -F.ln(_uniform(one, 0, 32) * _uniform(one, 32, 32))
    log_c = F.ln(-F.ln(_uniform(two, 0, 21) * _uniform(two, 21, 21)))
    b = _uniform(two, 42, 22)
    t = F.floor(log_weight / r + b)
    value = log_c - r * (t - b + 1)  # between -100 and 4 for any weight a text can hold
    rank = F.floor((value + 128.0) * float(1 << 23)).cast("long")
    return F.shiftleft(rank, 32).bitwiseOR((word_hash + t * _GOLDEN).bitwiseAND(F.lit((1 << 32) - 1)))


def signatures(texts: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """``keys`` and the fingerprint of ``text``: 4 hex digits a sample, the empty string for a text without words.

    Rows of equal keys must be equal. If ``texts`` is partitioned by some of the keys, nothing is shuffled.
    """
    words = texts.select(*keys, F.explode(F.split(F.lower("text"), r"[\x20\x09-\x0D]+")).alias("word"))
    weighted = words.groupBy(*keys, "word").agg(F.count("*").alias("w"))
    # The one empty word that a leading or trailing space leaves is not sampled, but keeps texts without words among the groups.
    real = weighted.select(*keys, F.when(F.col("word") != "", F.xxhash64("word")).alias("h"), F.ln("w").alias("lw"))
    least = real.groupBy(*keys).agg(*(F.min(sample_key(F.col("h"), F.col("lw"), k)).alias(f"s{k}") for k in range(samples)))
    digits = [F.lpad(F.lower(F.hex(F.col(f"s{k}").bitwiseAND(F.lit(0xFFFF)))), 4, "0") for k in range(samples)]
    return least.select(*keys, F.when(F.col("s0").isNull(), F.lit("")).otherwise(F.concat(*digits)).alias("fingerprint"))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of equal samples of two fingerprints; 1 for two texts without words, 0 for one."""
    same = sum((F.when(F.substring(a, 4 * k + 1, 4) == F.substring(b, 4 * k + 1, 4), 1).otherwise(0) for k in range(samples)), F.lit(0))
    return F.when((a == "") | (b == ""), F.when(a == b, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(same / samples)


def next_in_order(ids: DataFrame) -> DataFrame:
    """(key, next_key) over ``ids`` (doc_id, key): the next row by descending doc_id, then key; after the last the first.

    Rows are dealt by range and followed up inside each range; only the ranges' first rows, one a range, are put in one order.
    """
    order = [F.col("doc_id").desc_nulls_last(), F.col("key").asc()]
    dealt = cut_lineage(ids.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("part").orderBy(*order)
    rows = dealt.select("part", "key", F.lead("key").over(inside).alias("next_key"), F.row_number().over(inside).alias("n"))
    heads = rows.filter("n = 1").select("part", F.col("key").alias("head"))
    line = Window.orderBy("part")
    wrapped = F.coalesce(F.lead("head").over(line), F.min_by("head", "part").over(Window.partitionBy()))
    after = heads.select(F.col("part").alias("part_"), wrapped.alias("after"))
    return rows.join(after, rows.part == after.part_).select("key", F.coalesce("next_key", "after").alias("next_key"))


def compare_edits(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): fingerprints of the text and of its edited text, and how like they are, and the next one's.

    The edited text has its last third replaced by the beginning of the next document's text, by descending doc_id. Null text is
    empty; null ids come last; rows of equal id and text count as one document in that order and get equal results; rows of equal id and other text are
    ordered by a hash of the text; one document alone is its own next; an empty table gives none; other columns are not read.
    """
    texts = id_text(docs).select("doc_id", F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.col("doc_id").isNull(), "text").alias("key"), "text")
    rows = cut_lineage(texts.select("doc_id", "key", F.char_length("text").cast("long").alias("n_chars")))
    ids = rows.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.min("n_chars").alias("n_chars"))
    pairs = cut_lineage(next_in_order(ids.select("doc_id", "key")).join(ids.select("key", F.floor(F.col("n_chars") / 3).cast("int").alias("cut")), "key"))
    single = texts.select("key", "text").dropDuplicates(["key"])
    heads = single.join(pairs.withColumnRenamed("key", "before"), F.col("key") == F.col("next_key")).select(
        F.col("before").alias("before"), "cut", F.left("text", F.col("cut")).alias("head")
    )
    both = single.join(heads, F.col("key") == F.col("before")).select(
        "key", "text", F.concat(F.left("text", F.char_length("text") - F.col("cut")), "head").alias("edited")
    )
    sides = both.select("key", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("text")), F.struct(F.lit(1).alias("side"), F.col("edited").alias("text")))).alias("x"))
    signed = signatures(sides.select("key", "x.side", "x.text"), ["key", "side"], samples)
    wide = signed.groupBy("key").agg(
        F.max(F.when(F.col("side") == 0, F.col("fingerprint"))).alias("fingerprint"), F.max(F.when(F.col("side") == 1, F.col("fingerprint"))).alias("edited_fingerprint")
    )
    digests = both.select(F.col("key").alias("key_"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    found = cut_lineage(wide.join(digests, F.col("key") == F.col("key_")).drop("key_"))
    following = found.select(F.col("key").alias("key_"), F.col("fingerprint").alias("next_fingerprint"))
    linked = found.join(pairs.select("key", "next_key"), "key").join(following, F.col("next_key") == F.col("key_"))
    result = linked.select(
        F.col("key").alias("found_key"), "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), samples).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint"), samples).alias("near_next"),
    )
    return rows.join(result, F.col("key") == F.col("found_key")).drop("key", "found_key")


@query("op6_cws_fingerprints")
def op6_cws_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and its edited text by weighted samples of their words."""
    return compare_edits(table(spark, sf_dir, "documents"))
