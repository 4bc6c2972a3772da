"""URL verdicts: host rules first, then a tree of path templates per host, in DataFrame functions only.

The paths of a host form a tree. Level by level, a segment that many of its node's pages share stays as it is; all others become a wildcard of
their shape (``?n`` a number, ``?h`` a long hexadecimal name, ``?a`` letters with digits, ``?w`` letters, each with its file extension). Kept siblings whose
labelled share of bad pages and whose shapes of the next segment do not differ are merged into one branch, ``?(en|fr)``. What a page's
path has become is its template; a template is rejected if its share of bad pages among the labelled ones, shrunk to its host's
share, which is shrunk to the corpus's, reaches the limit. A ``?`` never occurs in a path, so wildcards do not clash with segments.

Kept segments are few (each has ``MIN_SUPPORT`` pages and ``1 / KEEP_SHARE`` of its node's), so a node's branches are compared in one window of bounded size; a
host may hold any share of the pages, for pages are only joined to the kept segments and counted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hypnolake.session import cut_lineage

from .common import query, table

#: (verdict, host, path): a rule fits its host and all subdomains where the path starts with its own; the longest wins.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
MAX_DEPTH = 6  # levels of the tree; what lies deeper is part of the last level's segment
MIN_SUPPORT = 20
KEEP_SHARE = 50
SIMILAR_Z = 1.96
SHAPE_SHARE = 20
STRENGTH = 10.0
MAX_BAD = 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NAME = r"(?s)^(.*?)(\.[A-Za-z][A-Za-z0-9]{0,4})?$"
#: (wildcard, pattern of the name without its extension), the first that fits
_SHAPES = (("?t", r"/"), ("?n", r"^[0-9]+$"), ("?h", r"^[0-9A-Fa-f-]{8,}$"), ("?a", r"[0-9]"))


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of an address; both empty where there is none."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _segments(path: Column, depth: int) -> Column:
    """The path's segments, the last of them with all that lies deeper."""
    all_ = F.split(path, "/")
    inner = F.slice(all_, F.lit(2), F.greatest(F.size(all_) - 1, F.lit(0)))
    tail = F.array_join(F.slice(inner, F.lit(depth), F.greatest(F.size(inner), F.lit(1))), "/")
    return F.when(F.size(inner) > depth, F.concat(F.slice(inner, 1, depth - 1), F.array(tail))).otherwise(inner)


def _shape(segment: Column) -> Column:
    """The wildcard of a segment without extension; an empty one stands for itself."""
    stem = F.regexp_extract(segment, _NAME, 1)
    out = F.lit("?w")
    for name, pattern in reversed(_SHAPES):
        out = F.when(stem.rlike(pattern), F.lit(name)).otherwise(out)
    return F.when(stem == "", F.lit("")).otherwise(out)


def _wildcard(segment: Column) -> Column:
    return F.concat(_shape(segment), F.regexp_extract(segment, _NAME, 2))


def _branches(kids: DataFrame, nodes: DataFrame) -> DataFrame:
    """host, template, segment, token: the kept segments of a level, similar ones under one name."""
    keys = ["host", "template"]
    kept = kids.filter((F.col("n") >= MIN_SUPPORT) & (F.col("segment") != "")).join(nodes, keys).filter(F.col("n") * KEEP_SHARE >= F.col("n_node"))
    kept = kept.withColumn("rate", (F.col("bad") + 1) / (F.col("labelled") + 2))
    row = Window.partitionBy(*keys, "next").orderBy("rate", "segment")
    l1, b1, l2, b2 = F.col("labelled"), F.col("bad"), F.lag("labelled").over(row), F.lag("bad").over(row)
    pooled = (b1 + b2 + 2) / (l1 + l2 + 4)
    z = F.abs(F.col("rate") - F.lag("rate").over(row)) / F.sqrt(pooled * (1 - pooled) * (1 / (l1 + 2) + 1 / (l2 + 2)))
    kept = kept.withColumn("apart", F.when(z < SIMILAR_Z, F.lit(0)).otherwise(F.lit(1)))
    kept = kept.withColumn("branch", F.sum("apart").over(row))
    names = F.sort_array(F.collect_list("segment").over(Window.partitionBy(*keys, "next", "branch")))
    token = F.when(F.size(names) > 1, F.concat(F.lit("?("), F.array_join(names, "|"), F.lit(")"))).otherwise(F.col("segment"))
    return kept.select(*keys, "segment", token.alias("token"))


def templates(pages: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """``pages`` (host, path, bad: 1, 0 or null, others) with ``template``. Written once; a level adds its kept segments."""
    rows = cut_lineage(pages.withColumn("segments", _segments(F.col("path"), depth)))
    deepest = rows.agg(F.max(F.size("segments"))).first()[0] or 0
    rows = rows.withColumn("template", F.lit(""))
    for level in range(deepest):
        segment = F.get("segments", F.lit(level))
        rows = rows.withColumn("segment", segment)
        after = F.coalesce(_shape(F.get("segments", F.lit(level + 1))), F.lit("end"))
        shapes = [name for name, _ in _SHAPES] + ["?w", "", "end"]
        below = rows.filter("segment IS NOT NULL").withColumn("after", after)
        kids = below.groupBy("host", "template", "segment").agg(
            F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"),
            *[F.sum((F.col("after") == s).cast("long")).alias(f"_{i}") for i, s in enumerate(shapes)],
        )
        common = F.concat(*[F.when(F.col(f"_{i}") * SHAPE_SHARE >= F.col("n"), F.lit("1")).otherwise(F.lit("0")) for i in range(len(shapes))])
        kids = kids.withColumn("next", common).drop(*[f"_{i}" for i in range(len(shapes))])
        nodes = below.groupBy("host", "template").agg(F.count("*").alias("n_node"))
        kept = cut_lineage(_branches(kids, nodes)).select(F.col("host").alias("_h"), F.col("template").alias("_t"), F.col("segment").alias("_s"), "token")
        rows = rows.join(kept, (F.col("host") == F.col("_h")) & (F.col("template") == F.col("_t")) & (F.col("segment") == F.col("_s")), "left")
        longer = F.concat("template", F.lit("/"), F.coalesce("token", _wildcard(F.col("segment"))))
        rows = rows.withColumn("template", F.when(F.col("segment").isNull(), F.col("template")).otherwise(longer)).drop("_h", "_t", "_s", "token", "segment")
    return rows.drop("segments")


def purity(rows: DataFrame, strength: float = STRENGTH) -> DataFrame:
    """host, template, n, labelled, bad and bad_rate, shrunk to the host's, itself shrunk to the corpus's (0 where nothing is labelled)."""
    per = cut_lineage(rows.groupBy("host", "template").agg(F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")))
    labelled, bad = per.agg(F.sum("labelled"), F.sum("bad")).first()
    base = bad / labelled if labelled else 0.0
    hosts = per.groupBy(F.col("host").alias("_h")).agg(((F.sum("bad") + base * strength) / (F.sum("labelled") + strength)).alias("_rate"))
    rate = (F.col("bad") + F.col("_rate") * strength) / (F.col("labelled") + strength)
    return per.join(hosts, F.col("host") == F.col("_h")).select("host", "template", "n", "labelled", "bad", rate.alias("bad_rate"))


def judge(pages: DataFrame, url: str = "url", bad: str = "bad", keep: Sequence[str] = ("page_id",), rules: Sequence[tuple[str, str, str]] = RULES, max_bad: float = MAX_BAD) -> DataFrame:
    """The ``keep`` columns, host, path, rule, verdict, template and bad_rate per row of ``pages``.

    ``bad`` is 1 or 0 where a page is labelled, else null. A null address, or one without ``://``, has an empty host and path and is judged by
    the template of these; a path of any length is read whole; equal rows are judged alike and all stay; an empty table gives none; other columns are not read.
    """
    host, path = parts(F.col(url))
    rows = pages.select(F.struct(*keep).alias("kept"), host.alias("host"), path.alias("path"), F.col(bad).cast("long").alias("bad"))
    rows = templates(rows)
    rates = cut_lineage(purity(rows)).select(F.col("host").alias("_h"), F.col("template").alias("_t"), "bad_rate")
    rows = rows.join(rates, (F.col("host") == F.col("_h")) & (F.col("template") == F.col("_t")))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(said, F.when(F.col("bad_rate") >= max_bad, F.lit("block")).otherwise(F.lit("allow")))
    return rows.select(*[F.col("kept").getField(c).alias(c) for c in keep], "host", "path", rule.alias("rule"), verdict.alias("verdict"), "template", "bad_rate")


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, url, bad: a page shows the document whose number is the last in its path; bad is low quality or toxic, null without a label."""
    number = F.regexp_extract(parts(F.col("url"))[1], r"([0-9]+)[^0-9]*$", 1)
    known = labels.filter("quality IS NOT NULL OR toxic IS NOT NULL").groupBy("doc_id")
    known = known.agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad"))
    rows = pages.select("page_id", "url", number.try_cast("long").alias("number"))
    return rows.join(known, F.col("number") == F.col("doc_id"), "left").select("page_id", "url", "bad")


def _level_sql(level: int) -> str:
    """DuckDB text of one level: kids, kept segments, merged branches, longer templates."""
    shape = lambda s: f"CASE WHEN {s} IS NULL THEN 'end' WHEN {_stem(s)} = '' THEN '' {_cases(s)} ELSE '?w' END"
    shapes = [name for name, _ in _SHAPES] + ["?w", "", "end"]
    common = " || ".join(f"CASE WHEN count(*) FILTER (after = '{s}') * {SHAPE_SHARE} >= count(*) THEN '1' ELSE '0' END" for s in shapes)
    return f"""
below{level} AS (SELECT *, segments[{level + 1}] AS segment, {shape(f"segments[{level + 2}]")} AS after FROM rows{level} WHERE segments[{level + 1}] IS NOT NULL),
kids{level} AS (SELECT host, template, segment, count(*) AS n, count(bad) AS labelled, coalesce(sum(bad), 0) AS bad, {common} AS next FROM below{level} GROUP BY ALL),
kept{level} AS (
  SELECT k.*, (k.bad + 1) / (labelled + 2) AS rate FROM kids{level} k
  JOIN (SELECT host, template, count(*) AS n_node FROM below{level} GROUP BY ALL) USING (host, template)
  WHERE n >= {MIN_SUPPORT} AND segment <> '' AND n * {KEEP_SHARE} >= n_node
),
pairs{level} AS (
  SELECT *, lag(labelled) OVER w AS l2, lag(bad) OVER w AS b2, lag(rate) OVER w AS r2 FROM kept{level} WINDOW w AS (PARTITION BY host, template, next ORDER BY rate, segment)
),
apart{level} AS (
  SELECT *, CASE WHEN abs(rate - r2) / sqrt((bad + b2 + 2) / (labelled + l2 + 4) * (1 - (bad + b2 + 2) / (labelled + l2 + 4)) * (1 / (labelled + 2) + 1 / (l2 + 2))) < {SIMILAR_Z}
    THEN 0 ELSE 1 END AS apart FROM pairs{level}
),
branch{level} AS (SELECT *, sum(apart) OVER (PARTITION BY host, template, next ORDER BY rate, segment ROWS UNBOUNDED PRECEDING) AS branch FROM apart{level}),
names{level} AS (SELECT host, template, segment, list_sort(list(segment) OVER (PARTITION BY host, template, next, branch)) AS names FROM branch{level}),
rows{level + 1} AS (
  SELECT r.* REPLACE (CASE WHEN segments[{level + 1}] IS NULL THEN r.template ELSE r.template || '/' || CASE
    WHEN len(names) > 1 THEN '?(' || array_to_string(names, '|') || ')' WHEN len(names) = 1 THEN k.segment
    ELSE {shape(f"segments[{level + 1}]")} || regexp_extract(segments[{level + 1}], '{_NAME}', 2) END END AS template)
  FROM rows{level} r LEFT JOIN names{level} k ON k.host = r.host AND k.template = r.template AND k.segment = segments[{level + 1}]
),"""


def _stem(segment: str) -> str:
    return f"regexp_extract({segment}, '{_NAME}', 1)"


def _cases(segment: str) -> str:
    return " ".join(f"WHEN regexp_matches({_stem(segment)}, '{pattern}') THEN '{name}'" for name, pattern in _SHAPES)


_FITS = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, said) for said, h, p in sorted(RULES, key=lambda r: -len(r[1]) - len(r[2]))]
SQL = f"""
WITH known AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY doc_id),
rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
split AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM rest
),
inner_ AS (SELECT *, string_split(path, '/')[2:] AS s, TRY_CAST(regexp_extract(path, '([0-9]+)[^0-9]*$', 1) AS BIGINT) AS number FROM split),
rows0 AS (
  SELECT page_id, host, path, bad, '' AS template, CASE WHEN len(s) > {MAX_DEPTH} THEN s[1:{MAX_DEPTH - 1}] || [array_to_string(s[{MAX_DEPTH}:], '/')] ELSE s END AS segments
  FROM inner_ LEFT JOIN known ON number = doc_id
),{"".join(_level_sql(k) for k in range(MAX_DEPTH))}
per AS (SELECT host, template, count(bad) AS labelled, coalesce(sum(bad), 0) AS bad FROM rows{MAX_DEPTH} GROUP BY ALL),
base AS (SELECT coalesce(sum(bad) / nullif(sum(labelled), 0), 0.0) AS base FROM per),
hosts AS (SELECT host, (sum(bad) + any_value(base) * {STRENGTH}) / (sum(labelled) + {STRENGTH}) AS rate FROM per, base GROUP BY host),
rates AS (SELECT host, template, (bad + rate * {STRENGTH}) / (labelled + {STRENGTH}) AS bad_rate FROM per JOIN hosts USING (host))
SELECT page_id, host, path, CASE {" ".join(f"WHEN {f} THEN '{r}'" for f, r, _ in _FITS)} END AS rule,
  CASE {" ".join(f"WHEN {f} THEN '{v}'" for f, _, v in _FITS)} WHEN bad_rate >= {MAX_BAD} THEN 'block' ELSE 'allow' END AS verdict, template, round(bad_rate, 6) AS bad_rate
FROM rows{MAX_DEPTH} JOIN rates USING (host, template)
"""


@query("op11_url_templates", SQL)
def op11_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's address judged by the rules, else by its template."""
    pages = labelled_pages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
    return judge(pages).withColumn("bad_rate", F.round("bad_rate", 6))
