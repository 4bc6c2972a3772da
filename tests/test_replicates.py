"""Replicate vectors against plain loops."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hypnolake.functions.hashing import POISSON1_CDF
from hypnolake.operators import replicates as rp
from hypnolake.operators import stats

R, SEED = 7, 11


def md5(rep, key):
    return hashlib.md5(f"{SEED}:{rep}-{key}".encode()).hexdigest()


def weight(rep, key):
    u = int(md5(rep, key)[:8], 16) / 2**32
    return sum(u >= c for c in POISSON1_CDF)


def auroc(rows, w):
    """Every pair of a positive and a negative."""
    pos = [(v, x) for (v, y), x in zip(rows, w) if y == 1]
    neg = [(v, x) for (v, y), x in zip(rows, w) if y == 0]
    total = sum(a * b for _, a in pos for _, b in neg)
    return sum(a * b * ((v > u) + (v == u) / 2) for v, a in pos for u, b in neg) / total if total else None


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(0)
    out = [(f"k{i}", int(rng.random() < 0.4), float(rng.integers(0, 12)), None if i % 9 == 0 else float(rng.normal())) for i in range(300)]
    return out + [(f"h{i}", i % 2, 5.0, 5.0) for i in range(200)]  # one value holds many rows


@pytest.mark.parametrize("parts", [1, 9])
def test_auroc_vectors(spark, rows, parts):
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "k string, y int, a double, b double").repartition(3)
        got = {(r.rep, r.score): r.auroc for r in stats.bootstrap_auroc(df, "k", ["a", "b"], "y", R, SEED).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(got) == 2 * R
    for j, name in ((2, "a"), (3, "b")):
        known = [r for r in rows if r[j] is not None]
        for rep in range(R):
            assert got[rep, name] == pytest.approx(auroc([(r[j], r[1]) for r in known], [weight(rep, r[0]) for r in known]))


def test_one_class_gives_null(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("b", 1, 0.7)], "k string, y int, v double")
    assert [r.auroc for r in stats.bootstrap_auroc(df, "k", ["v"], "y", 2, SEED).collect()] == [None, None]
    assert stats.bootstrap_auroc(df.limit(0), "k", ["v"], "y", 2, SEED).count() == 0


def test_weighted_means(spark, rows):
    df = spark.createDataFrame(rows, "k string, y int, a double, b double").repartition(4)
    got = {r.rep: r for r in stats.bootstrap_mean(df, "k", {"x": F.col("a"), "z": F.col("b")}, R, SEED).collect()}
    for rep in range(R):
        for name, j in (("x", 2), ("z", 3)):
            known = [(weight(rep, r[0]), r[j]) for r in rows if r[j] is not None]
            assert got[rep][name] == pytest.approx(sum(w * v for w, v in known) / sum(w for w, _ in known))


@pytest.mark.parametrize("few", [512, 20, 2])
def test_nth_smallest_by_digits(spark, rows, monkeypatch, few):
    monkeypatch.setattr(rp, "CANDIDATES", few)
    keys = spark.createDataFrame([(r[0],) for r in rows], "k string").repartition(3)
    for n in (1, 137, 500):
        got = rp.nth_smallest(keys, n, R, SEED)
        for rep in range(R):
            assert f"{got[rep, 0]:016x}{got[rep, 1]:016x}" == sorted(md5(rep, r[0]) for r in rows)[n - 1]


def test_nth_smallest_where_batches_hold_no_candidate(spark, rows, monkeypatch):
    """One task writes batches with candidates and batches without."""
    monkeypatch.setattr(rp, "CANDIDATES", 2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        got = rp.nth_smallest(spark.createDataFrame([(r[0],) for r in rows], "k string").coalesce(1), 137, R, SEED)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for rep in range(R):
        assert f"{got[rep, 0]:016x}{got[rep, 1]:016x}" == sorted(md5(rep, r[0]) for r in rows)[136]


def test_permutation_auroc(spark, rows):
    df = spark.createDataFrame(rows, "k string, y int, a double, b double")
    got = {r.rep: r.auroc for r in stats.permutation_auroc(df, "k", "a", "y", R, SEED).collect()}
    p = sum(r[1] for r in rows)
    for rep in range(R):
        first = set(sorted((md5(rep, r[0]) for r in rows))[:p])
        assert got[rep] == pytest.approx(auroc([(r[2], int(md5(rep, r[0]) in first)) for r in rows], [1] * len(rows)))


def test_rows_are_shuffled_without_replicates(spark, rows):
    df = spark.createDataFrame(rows, "k string, y int, a double, b double")
    plan = stats.bootstrap_auroc(df, "k", ["a"], "y", 1000, SEED)._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode(sequence" not in plan and plan.count("Exchange rangepartitioning") == 1
