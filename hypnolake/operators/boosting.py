"""Histogram boosting of a binary label: leaf-wise trees, learned directions for missing values, many models in one fit.

Features become bins once and rows become blocks of bins. A model is a membership of rows (a site, the rows outside a fold), so folds, sites and
repeats are fitted together. While all rows take at most ``TASK_MB`` and a tree's sums ``SUMS_MB``, every model is grown in a task of its own, which holds
that model's bins and no more; the tasks share no passes and need no jobs between them. Beyond it all models share passes over the blocks: gradients,
curvatures and rows are added up by (model, node, feature, bin) in one exchange, at most ``SUMS_MB`` a task, and the best split of each
node is found where its sums meet, so that only splits reach the driver.

Gradients are added as whole numbers of 2**-26, so the sums, and with them the trees, do not depend on how the rows are dealt.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_fraction
from ..session import checkpoint_dir, cut_lineage

MISSING = 255  # bin of missing values; the others are 0 to 254
TASK_MB = 96  # bins, labels, weights, scores and gradients of one task's model
SUMS_MB = 32  # histograms of one pass
CHECKPOINT_EVERY = 20  # rounds
SKETCH = 10_000  # accuracy of the percentiles that cut the bins
_UNIT = float(2**26)


@dataclass(frozen=True)
class Settings:
    """Fixed values of the boosted model: rounds, step, leaves, rows and curvature per leaf, shrinkage, early stopping."""

    rounds: int = 400
    rate: float = 0.05
    leaves: int = 31
    min_rows: int = 20
    min_curvature: float = 1e-3
    l2: float = 1.0
    validation: float = 0.15
    patience: int = 10
    tol: float = 1e-7
    seed: int = 42


# ------------------------------------------------------------------ bins and blocks
def bin_edges(df: DataFrame, features: Sequence[str]) -> list[np.ndarray]:
    """Cut points between the distinct ones of 256 percentiles per feature, from one mergeable sketch each."""
    probs = F.array(*[F.lit(i / 255) for i in range(256)])
    row = df.agg(*[F.percentile_approx(F.col(f).cast("double"), probs, SKETCH).alias(f"_{i}") for i, f in enumerate(features)]).first()
    values = [np.unique(np.array(row[i] or [], "float64")) for i in range(len(features))]
    return [(v[1:] + v[:-1]) / 2 for v in values]


def to_bins(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    out = np.searchsorted(edges, values, "left").astype("u1")
    out[np.isnan(values)] = MISSING
    return out


@dataclass
class Block:
    """Some rows: bins by feature, label, weight, role by model (0 not in it, 1 to fit, 2 to stop early), raw score by model."""

    x: np.ndarray
    y: np.ndarray
    w: np.ndarray
    role: np.ndarray
    raw: np.ndarray

    def at(self, base: np.ndarray) -> Block:
        """All raw scores at the models' base."""
        return Block(self.x, self.y, self.w, self.role, np.repeat(base[:, None], len(self.y), axis=1))

    def part(self, m: int, role: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bins, labels and weights of the rows that have ``role`` in a model."""
        rows = np.flatnonzero(self.role[m] == role)
        return self.x[:, rows], self.y[rows], self.w[rows]

    def advanced(self, trees: dict[int, Tree]) -> Block:
        raw = self.raw.copy()
        for m, tree in trees.items():
            rows = np.flatnonzero(self.role[m])
            raw[m, rows] += tree.value[tree.route(self.x[:, rows])]
        return Block(self.x, self.y, self.w, self.role, raw)


def _block_writer(edges: list[np.ndarray]):
    n_f = len(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [to_bins(b.column(i).to_numpy(zero_copy_only=False).astype("float64"), e) for i, e in enumerate(edges)]
            y, w = b.column(n_f).to_numpy(zero_copy_only=False), b.column(n_f + 1).to_numpy(zero_copy_only=False)
            role = b.column(n_f + 2).flatten().to_numpy(zero_copy_only=False).astype("u1").reshape(b.num_rows, -1).T
            parts = (np.array(x, "u1"), y.astype("f8"), w.astype("f8"), role)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), *[pa.array([p.tobytes()], pa.binary()) for p in parts]], names=["n", "x", "y", "w", "role"])

    return run


def _read_block(n_models: int, n_features: int):
    def read(r) -> Block:
        return Block(
            np.frombuffer(r.x, "u1").reshape(n_features, r.n), np.frombuffer(r.y, "f8"), np.frombuffer(r.w, "f8"),
            np.frombuffer(r.role, "u1").reshape(n_models, r.n), np.zeros((n_models, r.n)),
        )

    return read


# ------------------------------------------------------------------ trees
@dataclass
class Tree:
    """Nodes as arrays; ``feature`` is -1 in a leaf."""

    feature: np.ndarray
    bin: np.ndarray
    missing_left: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def route(self, x: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
        """The last node each row (column of ``x``) reaches, from the root or on from its node in ``start``."""
        node = np.zeros(x.shape[1], "int32") if start is None else start.copy()
        live = np.flatnonzero(self.feature[node] >= 0)
        while live.size:
            k = node[live]
            b = x[self.feature[k], live]
            node[live] = np.where(np.where(b == MISSING, self.missing_left[k], b <= self.bin[k]), self.left[k], self.right[k])
            live = live[self.feature[node[live]] >= 0]
        return node


_FIELDS = [("feature", "i4"), ("bin", "u1"), ("missing_left", "?"), ("left", "i4"), ("right", "i4"), ("value", "f8")]


def pack(trees: list[Tree]) -> bytes:
    """A model's trees as one compressed table; what the inner nodes are worth is left out."""
    out = np.zeros(sum(len(t.feature) for t in trees), _FIELDS)
    at = 0
    for t in trees:
        part = out[at : at + len(t.feature)]
        for name, _ in _FIELDS:
            part[name] = getattr(t, name)
        part["value"][t.feature >= 0] = 0
        at += len(part)
    sizes = np.array([len(trees), *[len(t.feature) for t in trees]], "i8")
    return zlib.compress(sizes.tobytes() + out.tobytes(), 1)


def unpack(packed: bytes) -> list[Tree]:
    raw = zlib.decompress(packed)
    n = int(np.frombuffer(raw, "i8", 1)[0])
    ends = np.cumsum(np.frombuffer(raw, "i8", n, 8))
    rows = np.frombuffer(raw, _FIELDS, offset=8 * (n + 1))
    columns = [np.ascontiguousarray(rows[name]) for name, _ in _FIELDS]
    return [Tree(*[c[a:b] for c in columns]) for a, b in zip([0, *ends], ends)]


_DE_BRUIJN = np.uint32(0x077CB531)
_PLACE = np.zeros(32, "int64")
for _i in range(32):
    _PLACE[(0x077CB531 << _i & 0xFFFFFFFF) >> 27] = _i


def _leaf_values(t: Tree, x: np.ndarray) -> np.ndarray:
    """The value of each row's leaf, for trees of at most 32 leaves.

    Leaves are bits from left to right. A test that sends a row right clears the leaves below its left side, so the lowest bit left is the row's leaf;
    the tests of one feature are one table of masks by bin.
    """
    feature, left, right = t.feature.tolist(), t.left.tolist(), t.right.tolist()
    order: list[int] = []  # leaves from left to right
    below: dict[int, tuple[int, int]] = {}  # of inner nodes the leaves of the left side
    stack = [(0, False)]
    while stack:
        k, left_done = stack.pop()
        if feature[k] < 0:
            order.append(k)
        elif left_done:
            below[k] = (below[k][0], len(order))
            stack.append((right[k], False))
        else:
            below[k] = (len(order), 0)
            stack += [(k, True), (left[k], False)]
    tables: dict[int, np.ndarray] = {}
    for k, (a, b) in below.items():
        table = tables.setdefault(feature[k], np.full(256, 2 ** len(order) - 1, "u4"))
        keep = np.uint32((2**32 - 1) ^ ((1 << b) - (1 << a)))
        table[int(t.bin[k]) + 1 : MISSING] &= keep
        if not t.missing_left[k]:
            table[MISSING] &= keep
    masks = None
    for f, table in tables.items():
        got = table[x[f]]
        masks = got if masks is None else np.bitwise_and(masks, got, out=masks)
    if masks is None:
        return np.full(x.shape[1], t.value[0])
    masks &= ~masks + np.uint32(1)
    values = np.zeros(32)
    values[: len(order)] = t.value[order]
    return values[_PLACE][(masks * _DE_BRUIJN) >> np.uint32(27)]


def _widened(x: np.ndarray) -> np.ndarray | None:
    """Bins as places in tables of masks, which pay for many rows."""
    return x.astype("int64") if x.shape[1] >= 256 else None


def _values(t: Tree, x: np.ndarray, wide: np.ndarray | None) -> np.ndarray:
    return t.value[t.route(x)] if wide is None or len(t.feature) > 63 else _leaf_values(t, wide)


@dataclass
class Node:
    """A node's sums and its best split: (gain, feature, bin, missing left, left sums), or None."""

    sums: tuple[float, float, int]
    split: tuple | None
    left: int = -1
    right: int = -1
    parent: int = -1


class Growing:
    """A tree being grown: the leaf of the largest gain is split next. Splits may be tried ahead of their turn; only those whose turn comes stay."""

    def __init__(self, root: Node, settings: Settings):
        self.s, self.nodes, self.chosen, self.leaves = settings, [root], set(), 1
        self.heap: list[tuple[float, int]] = []
        self._offer(0)

    def _offer(self, k: int) -> None:
        if self.nodes[k].split is not None and self.nodes[k].split[0] > 0:
            heapq.heappush(self.heap, (-self.nodes[k].split[0], k))

    def settle(self) -> None:
        """Split for good as far as the children are known."""
        while self.heap and self.leaves < self.s.leaves and self.nodes[self.heap[0][1]].left >= 0:
            _, k = heapq.heappop(self.heap)
            self.chosen.add(k)
            self.leaves += 1
            self._offer(self.nodes[k].left)
            self._offer(self.nodes[k].right)

    @property
    def done(self) -> bool:
        return not self.heap or self.leaves >= self.s.leaves

    def ahead(self, quota: int) -> list[int]:
        """Try the next splits: their children that are large enough to be split again, at most ``quota`` (two at least), to be summed."""
        out: list[int] = []
        for _, k in heapq.nsmallest(self.s.leaves - self.leaves, self.heap):
            if self.nodes[k].left >= 0:
                continue
            if out and len(out) + 2 > quota:
                break
            _, _, _, _, part = self.nodes[k].split
            rest = tuple(a - b for a, b in zip(self.nodes[k].sums, part))
            self.nodes[k].left, self.nodes[k].right = len(self.nodes), len(self.nodes) + 1
            self.nodes += [Node(part, None, parent=k), Node(rest, None, parent=k)]
            out += [c for c in (self.nodes[k].left, self.nodes[k].right) if self.nodes[c].sums[2] >= 2 * self.s.min_rows]
        return out

    def tree(self, only_chosen: bool = True) -> Tree:
        """The chosen splits, or all tried ones, as arrays (the same node numbers in the latter case)."""
        split = [k for k, n in enumerate(self.nodes) if n.left >= 0 and (not only_chosen or k in self.chosen)]
        keep = [0, *[c for k in split for c in (self.nodes[k].left, self.nodes[k].right)]] if only_chosen else list(range(len(self.nodes)))
        number = {k: i for i, k in enumerate(keep)}
        size = len(keep)
        t = Tree(np.full(size, -1, "int32"), np.zeros(size, "u1"), np.zeros(size, bool), np.zeros(size, "int32"), np.zeros(size, "int32"), np.zeros(size))
        for k in keep:
            g, h, _ = self.nodes[k].sums
            t.value[number[k]] = -self.s.rate * g / (h + self.s.l2)
        for k in split:
            _, t.feature[number[k]], t.bin[number[k]], t.missing_left[number[k]], _ = self.nodes[k].split
            t.left[number[k]], t.right[number[k]] = number[self.nodes[k].left], number[self.nodes[k].right]
        return t

    def values(self) -> np.ndarray:
        """Of every tried node the value of the chosen tree's leaf that it is or lies in."""
        out = np.zeros(len(self.nodes))
        for k, node in enumerate(self.nodes):  # parents come first
            if k == 0 or node.parent in self.chosen:
                g, h, _ = node.sums
                out[k] = -self.s.rate * g / (h + self.s.l2)
            else:
                out[k] = out[node.parent]
        return out


def best_splits(sums: np.ndarray, s: Settings) -> list[Node]:
    """Of every node its sums and best split, from whole-number sums (node, feature, bin, [gradient, curvature, rows])."""
    all_ = np.multiply(np.moveaxis(sums, -1, 0), np.array([1 / _UNIT, 1 / _UNIT, 1])[:, None, None, None], order="C")
    total = all_[:, :, 0].sum(axis=2)
    upto, missing = np.cumsum(all_[..., :MISSING], axis=3), all_[..., MISSING:]
    none = (total[0] ** 2 / (total[1] + s.l2))[:, None, None]
    sides = (False, True) if missing[2].any() else (False,)  # without missing values both directions are the same
    gains, lefts = [], []
    for missing_left in sides:
        left = upto + missing if missing_left else upto
        right = total[:, :, None, None] - left
        ok = np.minimum(left[2], right[2]) >= s.min_rows
        ok &= np.minimum(left[1], right[1]) >= s.min_curvature
        if missing_left:
            ok &= missing[2] > 0
        gain = left[0] * left[0]
        gain /= left[1] + s.l2
        right[0] *= right[0]
        right[1] += s.l2
        right[0] /= right[1]
        gain += right[0]
        gain -= none
        gains.append(np.where(ok, gain, -np.inf))
        lefts.append(left)
    both = np.stack(gains, axis=2) if len(gains) > 1 else gains[0]  # node, feature, direction, bin
    rows = both.reshape(len(both), int(np.prod(both.shape[1:])))
    out = []
    for k, at in enumerate(rows.argmax(axis=1).tolist()):
        f, side, b = at // (len(sides) * MISSING), at // MISSING % len(sides), at % MISSING
        node = (float(total[0, k]), float(total[1, k]), int(total[2, k]))
        if not np.isfinite(rows[k, at]):
            out.append(Node(node, None))
            continue
        part = lefts[side][:, k, f, b].tolist()
        to_left = bool(side) if missing[2, k, f, 0] else 2 * part[2] > node[2]  # unseen missing values go with most rows
        out.append(Node(node, (float(rows[k, at]), f, b, to_left, (part[0], part[1], int(part[2])))))
    return out


# ------------------------------------------------------------------ passes
def _gradients(raw: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of each row, as whole numbers."""
    p = 1 / (1 + np.exp(-raw))
    return np.rint(w * (p - y) * _UNIT), np.rint(w * p * (1 - p) * _UNIT)


def _loss(raw: np.ndarray, y: np.ndarray, w: np.ndarray) -> int:
    return int(np.rint(w * (np.logaddexp(0, raw) - y * raw) * _UNIT).sum())


def _sums(x: np.ndarray, at: np.ndarray, g: np.ndarray, h: np.ndarray, n_slots: int) -> np.ndarray:
    """Sums of rows (columns of ``x``) by (slot, feature, bin, [gradient, curvature, rows])."""
    n_f, n = x.shape
    out = np.empty((n_slots, n_f, 256, 3), "int64")
    step = max(1, (1 << 17) // max(n, 1))
    for f in range(0, n_f, step):
        k = min(step, n_f - f)
        cell = ((at * k + np.arange(k)[:, None]) * 256 + x[f : f + k]).ravel()
        for i, v in enumerate((g, h, None)):  # sums of whole numbers below 2**53 are exact
            v = v if v is None or k == 1 else np.tile(v, k)
            out[:, f : f + k, :, i] = np.bincount(cell, v, n_slots * k * 256).reshape(n_slots, k, 256)
    return out


def _taken(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Some columns of ``x``; a feature at a time is a third of the time of all at once."""
    out = np.empty((len(x), len(rows)), x.dtype)
    for f in range(len(x)):
        x[f].take(rows, out=out[f], mode="clip")
    return out


def _block_sums(b: Block, m: int, tree: Tree | None, slot: np.ndarray, n_slots: int) -> np.ndarray:
    rows = np.flatnonzero(b.role[m] == 1)
    x = b.x[:, rows]
    at = slot[tree.route(x)] if tree is not None else np.zeros(len(rows), "int64")
    rows, x, at = rows[at >= 0], x[:, at >= 0], at[at >= 0]
    return _sums(x, at, *_gradients(b.raw[m, rows], b.y[rows], b.w[rows]), n_slots)


def _pass(blocks: Iterable[Block], plan: dict, watch: dict[int, int] | None) -> dict:
    """Sums by model for the nodes of ``plan`` {model: (tree, slot by node, slots)}; losses of the watched rows by model."""
    out: dict = {}
    for b in blocks:
        for m, (tree, slot, n_slots) in plan.items():
            got = _block_sums(b, m, tree, slot, n_slots)
            out[m] = out[m] + got if m in out else got
        for m, role in (watch or {}).items():
            rows = np.flatnonzero(b.role[m] == role)
            out[f"loss{m}"] = out.get(f"loss{m}", 0) + _loss(b.raw[m, rows], b.y[rows], b.w[rows])
    return out


def _cells(got: dict) -> Iterator[tuple]:
    """What a pass found, by (model, slot); the loss under slot -1."""
    for k, v in got.items():
        if isinstance(k, str):
            yield (int(k[4:]), -1), v
        else:
            yield from (((k, i), v[i]) for i in range(len(v)))


def _weights(blocks: Iterable[Block], n_models: int) -> np.ndarray:
    """(model, role 1 or 2, [weight, weight of label 1, rows])."""
    out = np.zeros((n_models, 2, 3))
    for b in blocks:
        for m in range(n_models):
            for role in (1, 2):
                rows = b.role[m] == role
                out[m, role - 1] += (b.w[rows].sum(), (b.w * b.y)[rows].sum(), rows.sum())
    return out


# ------------------------------------------------------------------ fit and score
@dataclass
class Boosted:
    """Fitted models over the same features: base score and packed trees by model."""

    features: list[str]
    edges: list[np.ndarray]
    base: list[float]
    packed: list[bytes] = field(default_factory=list)

    @property
    def trees(self) -> list[list[Tree]]:
        return [unpack(p) for p in self.packed]

    def raw(self, x: np.ndarray, m: int) -> np.ndarray:
        """Log odds of rows given as bins by feature."""
        out, wide = np.full(x.shape[1], self.base[m]), _widened(x)
        for t in unpack(self.packed[m]):
            out += _values(t, x, wide)
        return out

    def bins(self, values: np.ndarray) -> np.ndarray:
        """(rows, features) to bins by feature."""
        return np.array([to_bins(values[:, i], e) for i, e in enumerate(self.edges)], "u1").reshape(len(self.edges), len(values))


def vector(features: Sequence[str]) -> Column:
    return F.array(*[F.col(f).cast("double") for f in features])


def matrix(column: pd.Series, width: int) -> np.ndarray:
    return np.array(column.tolist(), "float64").reshape(len(column), width)


def dealt(df: DataFrame, by: Column | None = None) -> DataFrame:
    """``df`` over all cores, whatever the files it is read from. Parts are ranges of the models, so that few tasks read a model; one of many rows has several."""
    n = 2 * df.sparkSession.sparkContext.defaultParallelism
    if by is None:
        return df.repartition(n)
    placed = df.withColumn("_place", F.rand(42))
    return placed.repartitionByRange(n, by, F.col("_place")).sortWithinPartitions(by).drop("_place")


def raw_score(model: Boosted, which: Column) -> Column:
    """Log odds by the model whose number each row names."""

    @F.pandas_udf("double")
    def score(x: pd.Series, m: pd.Series) -> pd.Series:
        bins, out = model.bins(matrix(x, len(model.features))), np.full(len(x), np.nan)
        for k in m.dropna().unique():
            rows = np.flatnonzero((m == k).to_numpy())
            out[rows] = model.raw(bins[:, rows], int(k))
        return pd.Series(out)

    return score(vector(model.features), which.cast("int"))


def _may_checkpoint(df: DataFrame) -> None:
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(checkpoint_dir(df.sparkSession))


def fit(rows: DataFrame, features: Sequence[str], members: Sequence[Column], label: str = "label", weight: str | None = None, key: str = "rec", settings: Settings | None = None) -> Boosted:
    """One model per membership in ``members``, each with its own validation rows (by a hash of ``key``), early stopping and trees."""
    s = settings or Settings()
    features, n_models = list(features), len(members)
    known = rows.where(F.col(label).isin(0, 1))
    edges = bin_edges(known, features)
    inside = F.when(hash_fraction(s.seed, F.col(key)) < s.validation, F.lit(2)).otherwise(F.lit(1))
    role = F.array(*[F.when(c, inside).otherwise(F.lit(0)).cast("tinyint") for c in members])
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    table = known.select(*[F.col(f).cast("double").alias(f"_f{i}") for i, f in enumerate(features)], F.col(label).cast("double").alias("_y"), w.alias("_w"), role.alias("_r"))
    stored = cut_lineage(table.hint("rebalance").mapInArrow(_block_writer(edges), "n long, x binary, y binary, w binary, role binary"))
    blocks = stored.rdd.map(_read_block(n_models, len(features)))
    n_blocks, n = stored.agg(F.count("n"), F.sum("n")).first()
    if n_blocks <= 1 or n * (len(features) + 48) <= TASK_MB * 1e6 and _cell_bytes(len(features)) * s.leaves <= SUMS_MB * 1e6:
        packed, base = _fit_here(blocks, n_models, s)
    else:
        _may_checkpoint(rows)
        spread = _Spread(blocks, n_models, len(features))
        base, tot = spread.begin()
        packed = [pack(t) for t in _boost(spread, tot, len(features), s)]
        spread.end()
    return Boosted(features, edges, base.tolist(), packed)


def _cell_bytes(n_features: int) -> int:
    """Sums of one node."""
    return n_features * 256 * 24


def _begin(tot: np.ndarray) -> np.ndarray:
    """Log odds of each model's fitted rows."""
    share = np.divide(tot[:, 0, 1], tot[:, 0, 0], out=np.full(len(tot), 0.5), where=tot[:, 0, 0] > 0)
    share = np.clip(share, 1e-9, 1 - 1e-9)
    return np.log(share / (1 - share))


class _Spread:
    """Blocks over the cluster: a pass is a job, the raw scores are kept with the blocks and checkpointed every few rounds."""

    def __init__(self, blocks: RDD, n_models: int, n_features: int):
        self.blocks, self.n_models, self.n_features, self.old, self.round = blocks, n_models, n_features, None, 0

    def begin(self) -> tuple[np.ndarray, np.ndarray]:
        n = self.n_models
        tot = self.blocks.mapPartitions(lambda it: [_weights(it, n)]).treeReduce(lambda a, b: a + b)
        base = _begin(tot)
        self.state = self.blocks.map(lambda b: b.at(base)).persist(StorageLevel.MEMORY_AND_DISK)
        return base, tot

    def splits(self, plan: dict[int, tuple[Growing | None, list[int]]], s: Settings, watch: dict[int, int] | None = None) -> tuple[dict[int, list[Node]], dict[int, int]]:
        """By model the asked nodes with their best splits, and losses. Sums meet by node; only splits are collected."""
        asked = {m: (g and g.tree(False), _slots(nodes, len(g.nodes)) if g else None, len(nodes)) for m, (g, nodes) in plan.items()}
        tasks = max(1, min(sum(a[2] for a in asked.values()), self.state.context.defaultParallelism))
        sums = self.state.mapPartitions(lambda it: _cells(_pass(it, asked, watch))).reduceByKey(lambda a, b: a + b, tasks)
        got = sums.map(lambda kv: (kv[0], kv[1] if kv[0][1] < 0 else best_splits(kv[1][None], s)[0])).collectAsMap()
        if self.old is not None:
            self.old.unpersist()
            self.old = None
        empty = np.zeros((1, self.n_features, 256, 3), "int64")
        nodes = {m: [got.get((m, i)) or best_splits(empty, s)[0] for i in range(a[2])] for m, a in asked.items()}
        return nodes, {m: got.get((m, -1), 0) for m in watch or {}}

    def advance(self, grown: dict[int, Growing]) -> None:
        trees = {m: t.tree() for m, t in grown.items()}
        self.old, self.state = self.state, self.state.map(lambda b: b.advanced(trees)).persist(StorageLevel.MEMORY_AND_DISK)
        self.round += 1
        if self.round % CHECKPOINT_EVERY == 0:
            self.state.checkpoint()

    def end(self) -> None:
        for x in (self.old, self.state):
            if x is not None:
                x.unpersist()


class _Here:
    """The same over the rows of one model, inside a task. A node knows its rows and a split reads these alone; of two children the smaller is summed, the other is what is left."""

    def __init__(self, fitted: tuple[np.ndarray, ...], held: tuple[np.ndarray, ...]):
        self.parts = {role: (np.ascontiguousarray(x), y, w) for role, (x, y, w) in ((1, fitted), (2, held))}
        self.wide = _widened(held[0])

    def begin(self) -> tuple[np.ndarray, np.ndarray]:
        tot = np.array([[[w.sum(), (w * y).sum(), len(y)] for _, y, w in self.parts.values()]])
        base = _begin(tot)
        self.raw = {role: np.full(len(y), base[0]) for role, (_, y, _) in self.parts.items()}
        return base, tot

    def splits(self, plan: dict[int, tuple[Growing | None, list[int]]], s: Settings, watch: dict[int, int] | None = None) -> tuple[dict[int, list[Node]], dict[int, int]]:
        grown, nodes = plan[0]
        x, y, w = self.parts[1]
        if grown is None:
            self.g, self.h = _gradients(self.raw[1], y, w)
            self.rows = {0: np.arange(len(y))}
            self.sums = {0: _sums(x, np.zeros(len(y), "int64"), self.g, self.h, 1)[0]}
        else:
            self._follow(grown)
            parents = sorted({grown.nodes[k].parent for k in nodes})
            small = [min(grown.nodes[p].left, grown.nodes[p].right, key=lambda c: len(self.rows[c])) for p in parents]
            rows, at = np.concatenate([self.rows[c] for c in small]), np.repeat(np.arange(len(small)), [len(self.rows[c]) for c in small])
            for p, c, got in zip(parents, small, _sums(_taken(x, rows), at, self.g.take(rows), self.h.take(rows), len(small))):
                other = grown.nodes[p].left + grown.nodes[p].right - c
                self.sums[c], self.sums[other] = got, self.sums.pop(p) - got
        loss = {m: _loss(self.raw[role], *self.parts[role][1:]) for m, role in (watch or {}).items()}
        return {0: best_splits(np.array([self.sums[k] for k in nodes]), s)}, loss

    def _follow(self, grown: Growing) -> None:
        """The rows of nodes tried since go on to their children."""
        x = self.parts[1][0]
        for k in [k for k in self.rows if grown.nodes[k].left >= 0]:
            _, f, b, missing_left, _ = grown.nodes[k].split
            rows = self.rows.pop(k)
            bins = x[f].take(rows)
            left = bins <= b  # a missing value's bin is above all others
            if missing_left:
                left |= bins == MISSING
            self.rows[grown.nodes[k].left], self.rows[grown.nodes[k].right] = rows.compress(left), rows.compress(~left)

    def advance(self, grown: dict[int, Growing]) -> None:
        for t in grown.values():
            self._follow(t)
            for value, rows in zip(t.values()[list(self.rows)], self.rows.values()):
                self.raw[1][rows] += value
            self.raw[2] += _values(t.tree(), self.parts[2][0], self.wide)


def _fit_here(blocks: RDD, n_models: int, s: Settings) -> tuple[list[bytes], np.ndarray]:
    """A model a task, each with its own rows alone."""

    def one(items: Iterator[tuple[int, tuple]]) -> Iterator[tuple[int, float, bytes]]:
        parts: dict[int, list] = {}
        for m, part in items:
            parts.setdefault(m, []).append(part)
        for m in sorted(parts):
            found = parts.pop(m)
            fitted, held = ([np.concatenate(c, axis=-1) for c in zip(*(p[i] for p in found))] for i in (0, 1))
            here = _Here(tuple(fitted), tuple(held))
            del found
            base, tot = here.begin()
            yield m, float(base[0]), pack(_boost(here, tot, len(fitted[0]), s)[0])

    items = blocks.flatMap(lambda b: [(m, (b.part(m, 1), b.part(m, 2))) for m in range(n_models)]).partitionBy(max(n_models, 1), lambda m: m)
    packed = [pack([])] * n_models
    base = np.zeros(n_models)
    for m, x, t in items.mapPartitions(one).collect():  # trees, not rows
        base[m], packed[m] = x, t
    return packed, base


def _boost(where: _Spread | _Here, tot: np.ndarray, n_features: int, s: Settings) -> list[list[Tree]]:
    """Trees by model. A round: sums of the roots and losses, then passes over the nodes tried next until every tree is grown."""
    n_models = len(tot)
    out: list[list[Tree]] = [[] for _ in range(n_models)]
    active = [m for m in range(n_models) if 0 < tot[m, 0, 1] < tot[m, 0, 0]]
    watch = {m: 2 if tot[m, 1, 2] else 1 for m in active}  # without validation rows the fitted ones tell when to stop
    scores: dict[int, list[float]] = {m: [] for m in active}
    limit = max(2, int(SUMS_MB * 1e6 / _cell_bytes(n_features)))
    for _ in range(s.rounds):
        if not active:
            break
        grown: dict[int, Growing] = {}
        for some in _runs(active, limit):
            got, loss = where.splits({m: (None, [0]) for m in some}, s, {m: watch[m] for m in some})
            for m in some:
                scores[m].append(-loss[m] / _UNIT / max(tot[m, watch[m] - 1, 0], 1e-300))
                if not _stalled(scores[m], s):
                    grown[m] = Growing(got[m][0], s)
        while wanted := {m: t for m, t in grown.items() if not t.done}:
            for some in _runs(list(wanted), limit // 2):
                ask = {m: wanted[m].ahead(max(2, limit // len(some))) for m in some}
                plan = {m: (wanted[m], nodes) for m, nodes in ask.items() if nodes}
                got = where.splits(plan, s)[0] if plan else {}
                for m, nodes in ask.items():
                    for k, node in zip(nodes, got.get(m, [])):
                        wanted[m].nodes[k].split = node.split
                    wanted[m].settle()
        grown = {m: t for m, t in grown.items() if t.chosen}
        for m, t in grown.items():
            out[m].append(t.tree())
        active = list(grown)
        where.advance(grown)
    return out


def _runs(models: list[int], size: int) -> Iterator[list[int]]:
    """Models that share a pass."""
    for i in range(0, len(models), max(size, 1)):
        yield models[i : i + max(size, 1)]


def _slots(nodes: list[int], size: int) -> np.ndarray:
    out = np.full(size, -1)
    out[nodes] = np.arange(len(nodes))
    return out


def _stalled(scores: list[float], s: Settings) -> bool:
    """None of the last scores is better than the one before them."""
    return len(scores) > s.patience and max(scores[-s.patience :]) <= scores[-s.patience - 1] + s.tol


# ------------------------------------------------------------------ isotonic maps
def pool(x: np.ndarray, total: np.ndarray, weight: np.ndarray, high: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Adjacent violators pooled: (low, high, total, weight) per pool, of ascending cells ``x`` with label and weight sums."""
    out: list[list[float]] = []
    for a, b, t, w in zip(x.tolist(), (x if high is None else high).tolist(), total.tolist(), weight.tolist()):
        out.append([a, b, t, w])
        while len(out) > 1 and out[-2][2] * out[-1][3] >= out[-1][2] * out[-2][3]:
            _, b2, t2, w2 = out.pop()
            out[-1][1] = b2
            out[-1][2] += t2
            out[-1][3] += w2
    return tuple(np.array(c) for c in zip(*out)) if out else (np.zeros(0),) * 4


_POOLS = "model int, low double, high double, total double, weight double"


def isotonic(scored: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Isotonic maps by model from (model, score, label, weight): knots and values, to be joined by straight lines.

    Ranges of the score are pooled on their own first, which leaves the result as it is; only their pools meet per model.
    """
    cells = scored.groupBy("model", "score").agg(F.sum(F.col("weight") * F.col("label")).alias("total"), F.sum("weight").alias("weight"))
    ranges = cells.repartitionByRange("model", "score").sortWithinPartitions("model", "score")

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for m, run in batch.groupby("model", sort=True):
                low, high, total, weight = pool(run["score"].to_numpy(), run["total"].to_numpy(), run["weight"].to_numpy())
                yield pd.DataFrame({"model": int(m), "low": low, "high": high, "total": total, "weight": weight})

    def final(pools: pd.DataFrame) -> pd.DataFrame:
        p = pools.sort_values("low")
        low, high, total, weight = pool(p["low"].to_numpy(), p["total"].to_numpy(), p["weight"].to_numpy(), p["high"].to_numpy())
        return pd.DataFrame({"model": int(p["model"].iloc[0]), "low": low, "high": high, "total": total, "weight": weight})

    out: dict[int, list] = {}
    for r in ranges.mapInPandas(partial, _POOLS).groupBy("model").applyInPandas(final, _POOLS).collect():  # pools, not rows
        out.setdefault(r.model, []).append((r.low, r.high, r.total / r.weight))
    return {m: _knots(sorted(pools)) for m, pools in out.items()}


def _knots(pools: list[tuple[float, float, float]]) -> tuple[np.ndarray, np.ndarray]:
    points = [(x, v) for low, high, v in pools for x in ((low, high) if high > low else (low,))]
    return np.array([x for x, _ in points]), np.array([v for _, v in points])
