"""Toxicity severity by cumulative-link ordinal regression.

Labels say only whether a text is toxic. Toxic texts are graded 1, 2, 3 by how much of the text the words that set toxic texts apart make
up (thirds of the training texts); other texts are grade 0. The model P(grade > k) = sigmoid(w x - theta_k) shares the weights w over the
ordered thresholds theta; its expected severity is the sum of these probabilities. A text is toxic if P(grade > 0) exceeds a cut that
the training texts set: the share of toxic texts above it less ten times that of clean ones is largest there.

The fit uses at most ``SAMPLE`` labelled texts, chosen by the hash of their id, and at most ``FEATURES`` words, chosen by a z-test of
their document frequencies. Both bounds hold for any input, so what reaches the driver is bounded. Scoring is one pass over all rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, query, table

SAMPLE = 20_000
FEATURES = 512
MIN_Z = 5.0
GRADES = 4
RIDGE = 1.0
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class SeverityModel:
    """Weights by word and ascending thresholds. Without training texts there is none, and nothing is toxic."""

    weights: dict[str, float] = field(default_factory=dict)
    thresholds: tuple[float, ...] = ()
    cut: float = 0.5

    def exceed(self, text: str) -> list[float]:
        """P(grade > k) for each threshold k."""
        if not self.thresholds:
            return [0.0] * (GRADES - 1)
        known = self.weights
        found = Counter([w for w in _WORD.findall(text.lower()) if w in known])
        eta = sum(known[w] * float(np.log1p(n)) for w, n in found.items())
        return [1.0 / (1.0 + float(np.exp(np.clip(t - eta, -500, 500)))) for t in self.thresholds]


def _minimise(fun, x: np.ndarray, rounds: int = 400, tol: float = 1e-6) -> np.ndarray:
    """Gradient steps of Barzilai-Borwein length, halved until the value falls."""
    value, grad = fun(x)
    step = 1.0 / max(1.0, float(np.linalg.norm(grad)))
    for _ in range(rounds):
        size = float(grad @ grad)
        if size < tol * tol:
            break
        while True:
            new = x - step * grad
            new_value, new_grad = fun(new)
            if np.isfinite(new_value) and new_value <= value - 1e-4 * step * size:
                break
            step /= 2
            if step < 1e-12:
                return x
        moved, turned = new - x, new_grad - grad
        curve = float(moved @ turned)
        step = float(moved @ moved) / curve if curve > 1e-12 else step * 2
        x, value, grad = new, new_value, new_grad
    return x


@dataclass
class Sparse:
    """Rows, columns and values of a matrix of few values."""

    rows: np.ndarray
    cols: np.ndarray
    values: np.ndarray
    shape: tuple[int, int]

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, weights=self.values * w[self.cols], minlength=self.shape[0])

    def turned_times(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.cols, weights=self.values * g[self.rows], minlength=self.shape[1])


def fit_cumulative_link(x: Sparse, y: np.ndarray, grades: int = GRADES, ridge: float = RIDGE) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds that maximise the cumulative-link likelihood less a ridge penalty on the weights."""
    n, d = x.shape
    above = np.array([np.clip((y > k).mean(), 1e-3, 1 - 1e-3) for k in range(grades - 1)])
    start = np.concatenate([np.zeros(d), np.maximum.accumulate(-np.log(above / (1 - above)) + 1e-3 * np.arange(grades - 1))])
    rows = np.arange(n)

    def fun(p):
        eta, theta = x.times(p[:d]), p[d:]
        if (np.diff(theta) <= 0).any():
            return np.inf, p
        cum = np.ones((n, grades + 1))
        cum[:, 0] = 0.0
        cum[:, 1:grades] = 1 / (1 + np.exp(np.clip(eta[:, None] - theta[None, :], -500, 500)))
        upper, lower = cum[rows, y + 1], cum[rows, y]
        mass = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / mass, lower * (1 - lower) / mass
        grad_theta = np.array([dl[y == k + 1].sum() - du[y == k].sum() for k in range(grades - 1)])
        grad = np.concatenate([x.turned_times(du - dl) + ridge * p[:d], grad_theta])
        return (-np.log(mass).sum() + 0.5 * ridge * float(p[:d] @ p[:d])) / n, grad / n

    best = _minimise(fun, start)
    return best[:d], best[d:]


def best_cut(p: np.ndarray, toxic: np.ndarray, cost: float = 10.0) -> float:
    """The cut on ``p`` with the largest share of toxic texts above it less ``cost`` times that of clean ones; midway between texts."""
    order = np.argsort(-p, kind="stable")
    gain = np.cumsum(np.where(toxic[order], 1 / toxic.sum(), -cost / (~toxic).sum()))
    ends = np.append(np.diff(p[order]) != 0, True)  # equal probabilities stand on one side
    k = int(np.argmax(np.where(ends, gain, -np.inf)))
    return float(p[order][k] + p[order][min(k + 1, len(p) - 1)]) / 2


def _training_texts(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(doc_id, toxic, text) of at most ``sample`` labelled ids; equal texts once."""
    known = labels.select(F.col("doc_id").alias("id_"), F.col("toxic").cast("int").alias("toxic")).dropna()
    known = known.groupBy("id_").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id_"), "id_").limit(sample)
    texts = id_text(docs).join(F.broadcast(known), F.col("doc_id") == F.col("id_"))  # at most ``sample`` rows of two numbers
    return texts.select("doc_id", "toxic", "text").dropDuplicates(["doc_id"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES, grades: int = GRADES) -> SeverityModel:
    """The severity model of ``docs`` (doc_id, text) with ``labels`` (doc_id, toxic)."""
    texts = _training_texts(docs, labels, sample)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: tuple[Counter, Counter] = (Counter(), Counter())
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                n[toxic > 0].update(set(_WORD.findall(text.as_py().lower())))
            words = [*(n[0] | n[1])]
            yield pa.RecordBatch.from_pydict({"word": words, "clean": [n[0][w] for w in words], "toxic": [n[1][w] for w in words]})

    counts = texts.select("toxic", "text").mapInArrow(frequencies, "word string, clean long, toxic long")
    sizes = texts.agg(F.count("*"), F.sum(F.col("toxic").cast("boolean").cast("long"))).first()
    total, toxic_total = sizes[0], sizes[1] or 0
    if not 0 < toxic_total < total:
        return SeverityModel()
    clean_total = total - toxic_total
    share = (F.col("clean") + F.col("toxic") + 1.0) / (total + 2.0)
    gap = F.col("toxic") / toxic_total - F.col("clean") / clean_total
    z = gap / F.sqrt(share * (1 - share) * (1 / toxic_total + 1 / clean_total))
    table_ = counts.groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    chosen = table_.withColumn("z", z).filter(F.abs("z") >= MIN_Z).orderBy(F.abs("z").desc(), "word").limit(features).collect()
    if not chosen:
        return SeverityModel()
    place = {r.word: i for i, r in enumerate(chosen)}
    odds = np.array([np.log((r.toxic + 0.5) / (toxic_total + 1)) - np.log((r.clean + 0.5) / (clean_total + 1)) for r in chosen])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n, size = [], [], []
            for text in batch.column(1):
                words = _WORD.findall(text.as_py().lower())
                found = Counter([place[w] for w in words if w in place])
                at.append([*found])
                n.append([*found.values()])
                size.append(len(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(at, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.int32())), pa.array(size, pa.int64())],
                names=["toxic", "at", "n", "size"],
            )

    rows = texts.select("toxic", "text").mapInArrow(vectors, "toxic int, at array<int>, n array<int>, size long").collect()
    rows.sort(key=lambda r: (r.toxic, r.size, r.at, r.n))
    found = [len(r.at) for r in rows]
    x = Sparse(
        np.repeat(np.arange(len(rows)), found), np.array([c for r in rows for c in r.at], np.int64),
        np.log1p(np.array([n for r in rows for n in r.n], float)), (len(rows), len(chosen)),
    )
    toxic = np.array([r.toxic > 0 for r in rows])
    strength = x.times(np.maximum(odds, 0)) / np.sqrt(np.array([max(r.size, 1) for r in rows]))
    cuts = np.quantile(strength[toxic], np.arange(1, grades - 1) / (grades - 1))
    y = np.where(toxic, 1 + np.searchsorted(cuts, strength, side="left"), 0).astype(int)
    w, theta = fit_cumulative_link(x, y, grades)
    p = 1 / (1 + np.exp(np.clip(theta[0] - x.times(w), -500, 500)))
    return SeverityModel({word: float(w[i]) for word, i in place.items()}, tuple(map(float, theta)), best_cut(p, toxic))


def score(docs: DataFrame, model: SeverityModel) -> DataFrame:
    """doc_id, severity (0 to grades - 1), p_toxic and toxic per row of ``docs``.

    Null or empty text has the severity of no known word; a null doc_id stays; equal rows get equal results; texts of any length are
    read whole; an empty table gives none; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.array([model.exceed(t.as_py()) for t in batch.column(1)]).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(p.sum(axis=1)), pa.array(p[:, 0]), pa.array(p[:, 0] > model.cut)],
                names=["doc_id", "severity", "p_toxic", "toxic"],
            )

    return id_text(docs).mapInArrow(run, "doc_id long, severity double, p_toxic double, toxic boolean")


def keep_clean(docs: DataFrame, model: SeverityModel) -> DataFrame:
    """The rows of ``docs`` that are not toxic, with all their columns."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([model.exceed(t.as_py() or "")[0] <= model.cut for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's severity by a model of the labelled ones."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
