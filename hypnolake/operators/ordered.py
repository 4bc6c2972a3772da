"""Order-dependent operators that stay parallel when one recording dominates.

A recording is normally one window partition. When a profile pass finds recordings above
``hot_rows`` rows, these get a monotone ``_chunk`` (equal slices of their own time span).
Windows then run per (recording, chunk) and the chunks are stitched through one summary row
per chunk, so no task ever holds more than one slice of a hot recording.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

HOT_ROWS = 2_000_000
CHUNK = "_chunk"
# A hot-key list longer than this is joined instead of broadcast.
HOT_KEY_BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class Axis:
    """Total order inside a recording: key columns, order columns, and whether rows carry chunks."""

    keys: tuple[str, ...]
    order: tuple[str, ...]
    chunked: bool = False

    @property
    def part(self) -> list[str]:
        return [*self.keys, CHUNK] if self.chunked else list(self.keys)

    def window(self):
        return Window.partitionBy(*self.part).orderBy(*self.order)

    def chunk_window(self):
        return Window.partitionBy(*self.keys).orderBy(CHUNK)


def calm(within: Axis | None) -> bool:
    """True where a profile pass has shown that no recording is hot."""
    return within is not None and not within.chunked


def with_axis(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    position: Column | None = None,
    hot_rows: int | None = None,
    within: Axis | None = None,
) -> tuple[DataFrame, Axis]:
    """Attach an axis. ``position`` is a numeric, order-preserving column (default: first order column).

    ``within`` is the axis of the stream these rows were derived from: rows derived from
    recordings already known to be small need no second profile pass.
    The profile pass reads only the key and position columns. At most rows/hot_rows keys can
    exceed the limit, which bounds the list that comes back.
    """
    keys, order = tuple(keys), tuple(order)
    if calm(within):
        return df, Axis(keys, order)
    hot_rows = HOT_ROWS if hot_rows is None else hot_rows
    pos = position if position is not None else F.col(order[0]).cast("double")
    hot = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"), F.min(pos).alias("_p0"), F.max(pos).alias("_p1"))
        .where(F.col("_n") > hot_rows)
        .withColumn("_width", F.greatest((F.col("_p1") - F.col("_p0")) * hot_rows / F.col("_n"), F.lit(1e-9)))
        .select(*keys, F.col("_p0"), F.col("_width"))
    )
    rows = hot.take(HOT_KEY_BROADCAST_ROWS + 1)
    if not rows:
        return df, Axis(keys, order)
    if len(rows) <= HOT_KEY_BROADCAST_ROWS:
        hot = F.broadcast(df.sparkSession.createDataFrame(rows, hot.schema))
    chunk = F.coalesce(F.floor((pos - F.col("_p0")) / F.col("_width")), F.lit(0)).cast("long")
    out = df.join(hot, list(keys), "left").withColumn(CHUNK, chunk).drop("_p0", "_width")
    return out, Axis(keys, order, True)


def shared(df: DataFrame, ax: Axis) -> DataFrame:
    """Input that several branches read (rows, and one summary per chunk).

    With hot recordings it is written once: chained operators would otherwise recompute their
    inputs once per branch, and branches multiply. Without hot recordings there is one branch.
    """
    return cut_lineage(df) if ax.chunked else df


def shift(df: DataFrame, ax: Axis, cols: Sequence[str], prefix: str, back: bool = True) -> DataFrame:
    """``lag`` (or ``lead``) of columns by one row, across chunk borders."""
    step = F.lag if back else F.lead
    packed = F.struct(*cols)
    if not ax.chunked:
        out = df.withColumn("_sh", step(packed).over(ax.window()))
    else:
        base = shared(df, ax)
        edge = F.max_by if back else F.min_by
        borders = base.groupBy(*ax.part).agg(edge(F.struct(*df.columns), F.struct(*ax.order)).alias("_sh_row"))
        border = F.struct(*[F.col(f"_sh_row.{c}").alias(c) for c in cols])
        borders = borders.select(*ax.part, step(border).over(ax.chunk_window()).alias("_sh_edge"))
        out = (
            base.withColumn("_sh_in", step(packed).over(ax.window()))
            .join(borders, ax.part, "left")
            .withColumn("_sh", F.coalesce("_sh_in", "_sh_edge"))
            .drop("_sh_in", "_sh_edge")
        )
    return out.select("*", *[F.col(f"_sh.{c}").alias(f"{prefix}{c}") for c in cols]).drop("_sh")


def running_sum(df: DataFrame, ax: Axis, cols: dict[str, Column]) -> DataFrame:
    """Inclusive running sums in axis order: ``{output name: numeric expression}``."""
    w = ax.window().rowsBetween(Window.unboundedPreceding, 0)
    if not ax.chunked:
        return df.select("*", *[F.sum(e).over(w).alias(n) for n, e in cols.items()])
    base = shared(df, ax)
    before = ax.chunk_window().rowsBetween(Window.unboundedPreceding, -1)
    offsets = base.groupBy(*ax.part).agg(*[F.sum(e).alias(f"_o_{n}") for n, e in cols.items()])
    offsets = offsets.select(
        *ax.part, *[F.coalesce(F.sum(f"_o_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in cols]
    )
    out = base.select("*", *[F.sum(e).over(w).alias(f"_w_{n}") for n, e in cols.items()])
    out = out.join(offsets, ax.part)
    return out.select(*df.columns, *[(F.col(f"_w_{n}") + F.col(f"_o_{n}")).alias(n) for n in cols])


def ordinal(df: DataFrame, ax: Axis, name: str = "epoch") -> DataFrame:
    """Dense 0-based position in the recording."""
    if not ax.chunked:
        return df.withColumn(name, (F.row_number().over(ax.window()) - 1).cast("long"))
    return running_sum(df, ax, {name: F.lit(1)}).withColumn(name, (F.col(name) - 1).cast("long"))


_MERGE = {"sum": F.sum, "min": F.min, "max": F.max}


def runs(
    df: DataFrame,
    ax: Axis,
    state: str,
    aggs: dict[str, tuple[str, Column]] | None = None,
) -> DataFrame:
    """Maximal runs of equal ``state`` (gaps and islands): one row per run.

    Output: keys, run (0-based), state, n, first_<order>, last_<order>, and the requested
    mergeable aggregates ``{name: ("sum"|"min"|"max", expression)}``.
    """
    aggs = aggs or {}
    w = ax.window()
    base = shared(df, ax)
    prev = F.lag(state).over(w)
    opened = (prev.isNull() | (prev != F.col(state))).cast("long")
    marked = base.withColumn("_rn_new", opened).withColumn(
        "_rn_run", F.sum("_rn_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    names = {"n": "sum", **{f"first_{c}": "min" for c in ax.order}, **{f"last_{c}": "max" for c in ax.order}}
    names |= {n: fn for n, (fn, _) in aggs.items()}
    parts = marked.groupBy(*ax.part, "_rn_run", state).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.min(c).alias(f"first_{c}") for c in ax.order],
        *[F.max(c).alias(f"last_{c}") for c in ax.order],
        *[_MERGE[fn](e).alias(n) for n, (fn, e) in aggs.items()],
    )
    if not ax.chunked:
        return parts.select(*ax.keys, (F.col("_rn_run") - 1).alias("run"), state, *names)
    cw = ax.chunk_window()
    chunks = parts.groupBy(*ax.part).agg(
        F.min_by(F.struct(*parts.columns), "_rn_run").getField(state).alias("_rn_first"),
        F.max_by(state, "_rn_run").alias("_rn_last"),
        F.max("_rn_run").alias("_rn_k"),
    )
    glued = F.coalesce((F.col("_rn_first") == F.lag("_rn_last").over(cw)).cast("long"), F.lit(0))
    chunks = chunks.withColumn("_rn_glued", glued).select(
        *ax.part,
        (
            F.coalesce(F.sum(F.col("_rn_k") - F.col("_rn_glued")).over(cw.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            - F.col("_rn_glued")
        ).alias("_rn_off"),
    )
    return (
        parts.join(chunks, ax.part)
        .withColumn("run", F.col("_rn_run") + F.col("_rn_off") - 1)
        .groupBy(*ax.keys, "run", state)
        .agg(*[_MERGE[fn](n).alias(n) for n, fn in names.items()])
    )


def forward_fill(df: DataFrame, ax: Axis, col: str, out: str) -> DataFrame:
    """Last non-null value so far; a leading gap takes the first valid value."""
    w = ax.window().rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(col, ignorenulls=True)
    first = df.where(F.col(col).isNotNull()).groupBy(*ax.keys).agg(
        F.min_by(col, F.struct(*ax.order)).alias("_ff_head")
    )
    if not ax.chunked:
        # reversed frame gives the head without a second pass
        rest = ax.window().rowsBetween(0, Window.unboundedFollowing)
        return df.withColumn(out, F.coalesce(seen.over(w), F.first(col, ignorenulls=True).over(rest)))
    base = shared(df, ax)
    order_if_valid = F.when(F.col(col).isNotNull(), F.struct(*ax.order))
    tails = base.groupBy(*ax.part).agg(F.max_by(col, order_if_valid).alias("_ff_tail"))
    before = ax.chunk_window().rowsBetween(Window.unboundedPreceding, -1)
    tails = tails.select(*ax.part, F.last("_ff_tail", ignorenulls=True).over(before).alias("_ff_tail"))
    filled = base.withColumn("_ff_in", seen.over(w)).join(tails, ax.part, "left").join(first, list(ax.keys), "left")
    return filled.withColumn(out, F.coalesce("_ff_in", "_ff_tail", "_ff_head")).drop("_ff_in", "_ff_tail", "_ff_head")


def rising_edges(df: DataFrame, ax: Axis, on: Column, name: str = "n_events") -> DataFrame:
    """Count of 0->1 onsets per recording (a stream that starts active counts once)."""
    marked = df.withColumn("_on", F.coalesce(on.cast("int"), F.lit(0)))
    stepped = shift(marked, ax, ["_on"], "_was")
    onset = (F.col("_on") == 1) & (F.coalesce("_was_on", F.lit(0)) == 0)
    return stepped.groupBy(*ax.keys).agg(F.sum(onset.cast("long")).alias(name), F.count(F.lit(1)).alias("n_samples"))


def merge_gaps(run_rows: DataFrame, keys: Sequence[str], start: str, end: str, gap, min_len, max_len, within: Axis | None = None, aggs: dict[str, tuple[str, Column]] | None = None) -> DataFrame:
    """Join active intervals whose gap is below ``gap``; keep lengths in [min_len, max_len].

    ``run_rows`` holds intervals [start, end) of one recording in time order.
    """
    ivals, ax = with_axis(run_rows, keys, (start,), within=within)
    stepped = shift(ivals, ax, [end], "prev_")
    opened = F.col(f"prev_{end}").isNull() | (F.col(start) - F.col(f"prev_{end}") >= gap)
    grouped = running_sum(stepped.withColumn("_open", opened.cast("long")), ax, {"_burst": F.col("_open")})
    merged = grouped.groupBy(*keys, "_burst").agg(
        F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n_merged"),
        *[_MERGE[fn](e).alias(n) for n, (fn, e) in (aggs or {}).items()],
    )
    length = F.col(end) - F.col(start)
    return merged.where((length >= min_len) & (length <= max_len)).drop("_burst")


def same(left: Sequence[str], a: str, b: str) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in left])
