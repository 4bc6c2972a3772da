"""Merkle manifest of a table: a hash tree per group, a tree over the groups' roots, and an inclusion proof per row.

Checkpoint and recompute: of the levels of a tree only every ``BAND``-th is stored. An aligned subtree of 2**BAND stored nodes is one
row of a grouped table; its missing interior nodes are hashed again inside that row when proofs are made, the siblings are read off, and
the interior is dropped. A proof is the row's siblings in its subtree, then those of the stored node above it, up to the root.

Rows get their place in their group by one range exchange on (group, id, digest), so a group may hold any share of the rows; a subtree holds
at most 2**BAND of them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hypnolake.session import cut_lineage

from .common import query, table

BAND = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_ROW_BITS = 33  # of monotonically_increasing_id: the rest is the partition


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def framed(value: Column) -> Column:
    """`-` for null, else the byte count, a colon and the value: no two rows have the same bytes."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(fields: Sequence[Column]) -> Column:
    return digest(*[framed(c) for c in fields])


def _placed(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` (tree, ...) with ``pos``, the place from 0 inside the tree by ``order``, and ``n``, the tree's size."""
    by = [F.col(c).asc_nulls_first() for c in ("tree", *order)]
    dealt = cut_lineage(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_row", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("_part", F.shiftright("_row", _ROW_BITS))
    runs = dealt.groupBy("_part", "tree").agg(F.min("_row").alias("_first"), F.count("*").alias("_m"))  # a partition holds few trees, or whole ones
    before = Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        F.col("_part").alias("_p"), F.col("tree").alias("_t"), "_first", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_before"),
        F.sum("_m").over(Window.partitionBy("tree")).alias("n"),
    )
    joined = dealt.join(cut_lineage(runs), (F.col("_part") == F.col("_p")) & F.col("tree").eqNullSafe(F.col("_t")))
    return joined.select(*rows.columns, (F.col("_row") - F.col("_first") + F.col("_before")).alias("pos"), "n")


def _steps(level: int, band: int) -> Column:
    """Levels hashed above ``level`` in one subtree: ``band``, or as many as are left to the root of a tree of n leaves."""
    height = F.when(F.col("n") <= 1, F.lit(0)).otherwise(F.length(F.bin(F.col("n") - 1)))
    return F.greatest(F.least(height - level, F.lit(band)), F.lit(0))


def _pair_up(nodes: Column) -> Column:
    """The level above: every two consecutive nodes hashed together, a last one alone."""
    return F.transform(
        F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / 2).cast("int")),
        lambda i: digest(F.get(nodes, 2 * i), F.coalesce(F.get(nodes, 2 * i + 1), F.lit(""))),
    )


def _first(count: Column, numbers: range) -> Column:
    return F.slice(F.array(*[F.lit(i) for i in numbers]), F.lit(1), count)


def _blocks(nodes: DataFrame, level: int, band: int) -> DataFrame:
    """One row per aligned subtree: tree, n, block and the stored nodes in order as ``items``."""
    return (
        nodes.groupBy("tree", "n", F.shiftright("pos", band).alias("block"))
        .agg(F.sort_array(F.collect_list(F.struct("pos", "h", "load"))).alias("items"))
        .withColumn("steps", _steps(level, band))
    )


def _tops(nodes: DataFrame, level: int, band: int) -> DataFrame:
    """The nodes ``band`` levels up, which are stored."""
    rows = nodes.withColumn("load", F.lit(None).cast("int"))
    top = F.aggregate(_first(F.col("steps"), range(band)), F.transform("items", lambda x: x.h), lambda below, _: _pair_up(below), lambda last: F.get(last, F.lit(0)))
    return _blocks(rows, level, band).select("tree", "n", F.col("block").alias("pos"), top.alias("h"))


def _paths(nodes: DataFrame, level: int, band: int) -> DataFrame:
    """Every stored node with its siblings inside its subtree: tree, block, pos, h, load, path. The interior is regenerated and dropped here."""

    def siblings(levels: Column) -> Column:
        other = lambda i, j: F.get(F.get(levels, j), _halved(i, j).bitwiseXOR(F.lit(1)))
        return F.transform("items", lambda x, i: F.struct(
            x.pos.alias("pos"), x.h.alias("h"), x.load.alias("load"),
            F.transform(_first(F.col("steps"), range(band)), lambda j: F.struct((_halved(i, j) % 2 == 1).alias("left"), other(i, j).alias("h"))).alias("path"),
        ))

    grown = F.aggregate(
        _first(F.col("steps"), range(band)), F.array(F.transform("items", lambda x: x.h)),
        lambda levels, _: F.concat(levels, F.array(_pair_up(F.element_at(levels, -1)))), siblings,
    )
    return _blocks(nodes, level, band).select("tree", "block", F.explode(grown).alias("_x")).select("tree", "block", "_x.*")


def _halved(i: Column, j: Column) -> Column:
    return F.call_function("shiftright", i, j)


@dataclass
class Forest:
    """The stored levels of a group of trees, lowest first; ``bands[0]`` holds the leaves (tree, n, pos, h, load)."""

    bands: list[DataFrame]
    roots: DataFrame  # tree, h
    band: int

    def proofs(self, above: DataFrame | None = None) -> DataFrame:
        """tree, pos, h, load, path, top: the path runs to the tree's root, or on through ``above`` (tree, path, top) where given."""
        ends = self.roots.select(F.col("tree").alias("_t"), F.col("h").alias("root"))
        if above is not None:
            ends = ends.join(above.select(F.col("tree").alias("_a"), F.col("path").alias("_more"), F.col("top").alias("_top")), F.col("_t").eqNullSafe(F.col("_a"))).drop("_a")
        else:
            ends = ends.withColumns({"_more": F.array().cast("array<struct<left:boolean,h:string>>"), "_top": F.col("root")})
        upper = ends.withColumn("_pos", F.lit(0).cast("long"))
        for k in range(len(self.bands) - 1, -1, -1):
            nodes = self.bands[k] if k == 0 else self.bands[k].withColumn("load", F.lit(None).cast("int"))
            own = _paths(nodes, k * self.band, self.band)
            own = own.join(upper, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("block") == F.col("_pos")))
            own = own.select("tree", "pos", "h", "load", F.concat("path", "_more").alias("path"), "root", F.col("_top").alias("top"))
            if k:
                upper = cut_lineage(own.select(F.col("tree").alias("_t"), F.col("pos").alias("_pos"), F.col("path").alias("_more"), "root", F.col("top").alias("_top")))
        return own


def forest(rows: DataFrame, order: Sequence[str], band: int = BAND) -> Forest:
    """Hash trees over ``rows`` (tree, h, load and the ``order`` columns): every ``band``-th level is written to the shared folder."""
    bands = [cut_lineage(_placed(rows, order).select("tree", "n", "pos", "h", "load"))]
    left = bands[0].agg(F.max("n")).first()[0] or 0
    while True:
        up = cut_lineage(_tops(bands[-1], (len(bands) - 1) * band, band))
        left = -(-left >> band)
        if left <= 1:
            return Forest(bands, up.select("tree", "h"), band)
        bands.append(up)


def proofs(docs: DataFrame, id_col: str = "doc_id", tree_col: str = "lang", fields: Sequence[str] = FIELDS, forged: Column | None = None, band: int = BAND) -> DataFrame:
    """doc_id, leaf, forged, subroot, root and path (left, h; lowest first) per row of ``docs``.

    A row's leaf is the digest of its framed ``fields``. The leaves of a group (``tree_col``; null is a group, and the first) ascend by id, null
    ids first, rows of one id by their digest. ``forged`` is a digest to carry along, for instance of changed fields; the leaf where none
    is given. Equal rows have a leaf and a proof each; texts of any length are hashed whole; an empty table gives none; other columns are not read.
    """
    own = leaf([F.col(c) for c in fields])
    rows = docs.select(F.col(tree_col).alias("tree"), F.col(id_col).alias("id"), own.alias("h"), (own if forged is None else forged).alias("forged"))
    rows = cut_lineage(rows.withColumn("at", F.monotonically_increasing_id()))  # texts are read once; ``at`` spreads rows that are equal
    groups = forest(rows.select("tree", "h", F.struct("id", "forged").alias("load"), "id", "at"), ("id", "h", "at"), band)
    tops = groups.roots.select(F.lit(0).alias("tree"), F.col("tree").alias("name"), "h", F.struct(F.col("tree").alias("name")).alias("load"))
    corpus = forest(tops, ("name",), band)
    upper = cut_lineage(corpus.proofs().select(F.col("load.name").alias("tree"), "path", "top"))
    out = groups.proofs(upper)
    return out.select(F.col("load.id").alias("doc_id"), F.col("h").alias("leaf"), F.col("load.forged").alias("forged"), F.col("root").alias("subroot"), F.col("top").alias("root"), "path")


def fold(node: Column, path: Column) -> Column:
    """The root that ``node`` and its siblings give."""
    return F.aggregate(path, node, lambda h, s: F.when(s.left, digest(s.h, h)).otherwise(digest(h, F.coalesce(s.h, F.lit("")))))


def siblings_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.filter(F.transform(path, lambda s: s.h), lambda h: h.isNotNull()), ""), 256)


def tampered(doc_id: Column) -> Column:
    """Where 7 divides the CRC-32 of the decimal id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 0, F.lit(False))


_FRAMED = " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in FIELDS)
_FORGED = _FRAMED.replace("n_chars", "(n_chars + 1)")
# CRC-32 bit by bit: a byte is mixed in, then eight shifts (-1) follow
_CRC = """xor(list_reduce(flatten([[ascii(c), -1, -1, -1, -1, -1, -1, -1, -1] FOR c IN string_split(CAST(doc_id AS VARCHAR), '')]),
  lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) ELSE xor(s >> 1, (s % 2) * 3988292384) END, 4294967295), 4294967295)"""
_FOLD = "list_reduce(path, lambda h, s: sha256(CASE WHEN s[1] = 'L' THEN s[2:] || h ELSE h || s[2:] END), {})"


def _tree(name: str, leaves: str) -> str:
    """DuckDB text: all nodes of the trees over ``leaves`` (tree, pos, h), and the siblings of every leaf, marked L or R, lowest first."""
    return f"""
{name}(tree, level, pos, h, n) AS (
  SELECT tree, 0, pos, h, count(*) OVER (PARTITION BY tree) FROM {leaves}
  UNION ALL
  SELECT tree, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM {name} WHERE n > 1 GROUP BY tree, level, pos // 2
),
{name}_path AS (
  SELECT l.tree, l.pos, list(CASE WHEN (l.pos >> o.level) % 2 = 1 THEN 'L' ELSE 'R' END || coalesce(s.h, '') ORDER BY o.level) AS path
  FROM {leaves} l JOIN {name} o ON o.n > 1 AND l.tree IS NOT DISTINCT FROM o.tree AND o.pos = l.pos >> o.level
  LEFT JOIN {name} s ON s.tree IS NOT DISTINCT FROM o.tree AND s.level = o.level AND s.pos = xor(o.pos, 1::BIGINT)
  GROUP BY l.tree, l.pos
)"""


SQL = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, lang AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, sha256({_FRAMED})) - 1 AS pos,
    sha256({_FRAMED}) AS h, CASE WHEN {_CRC} % 7 = 0 THEN sha256({_FORGED}) ELSE sha256({_FRAMED}) END AS forged FROM documents
),{_tree("nodes", "docs")},
tops AS (SELECT 0 AS tree, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS pos, h, tree AS name FROM nodes WHERE n = 1),{_tree("upper", "tops")},
whole AS (
  SELECT doc_id, d.h AS leaf, t.h AS subroot, r.h AS root, coalesce(p.path, []) || coalesce(u.path, []) AS path, forged
  FROM docs d JOIN tops t ON d.tree IS NOT DISTINCT FROM t.name JOIN upper r ON r.n = 1
  LEFT JOIN nodes_path p ON p.tree IS NOT DISTINCT FROM d.tree AND p.pos = d.pos LEFT JOIN upper_path u ON u.pos = t.pos
)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string([s[2:] FOR s IN path], '')) AS proof_sha256, {_FOLD.format("forged")} AS folded_root,
  {_FOLD.format("forged")} = root AS verified
FROM whole
"""


@query("op13_merkle_manifest", SQL)
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, proof and roots, and whether the proof holds after some documents were tampered with."""
    docs = table(spark, sf_dir, "documents")
    changed = leaf([F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS])
    own = leaf([F.col(c) for c in FIELDS])
    out = proofs(docs, forged=F.when(tampered(F.col("doc_id")), changed).otherwise(own))
    folded = out.select("doc_id", "leaf", "subroot", "root", siblings_digest(F.col("path")).alias("proof_sha256"), fold(F.col("forged"), F.col("path")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))
