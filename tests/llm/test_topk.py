import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import topk


def brute(rows, k=5):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in kept:
        if q % 50 == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in kept if i != q and len(a) == len(b))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:k])]
    return sorted(out)


def search(spark, rows, k=5):
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int").repartition(4)
    return sorted(map(tuple, topk.top_k(topk.integer_vectors(frame), F.col("vec_id") % 50 == 0, k).collect()))


@pytest.mark.parametrize(("dims", "block"), [(2, 4096), (3, 64), (16, 100), (64, 4096)])
def test_equals_brute_force(spark, monkeypatch, dims, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    r = np.random.default_rng(dims)
    vectors = np.float32(r.normal(size=(700, dims)))
    vectors[100:140] = vectors[100]  # ties
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    assert search(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (50, None), (100, [1.0, None]), (1, [float("nan"), 1.0]), (2, [float("inf"), 1.0]), (3, [0.5, 0.25]), (150, []), (200, [1.0]), (None, [1.0, 1.0]), (4, [0.5, 0.25]), (250, [0.0, 0.0])]
    assert search(spark, rows) == brute(rows)
    assert search(spark, []) == [] and search(spark, [(1, [1.0])]) == [] and search(spark, [(0, [1.0])]) == []


def test_the_bound_stops_early():
    r = np.random.default_rng(1)
    ids, vectors = np.arange(20_000), np.floor(r.normal(size=(20_000, 2)) * 256).astype(np.int64)
    best = topk.Best(1, 5)
    computed = topk.threshold_search(topk.Block(ids, vectors), np.array([-1]), np.array([[300, 200]]), best)
    scores = vectors @ [300, 200]
    assert computed < 5000 and best.ids[0].tolist() == np.lexsort((ids, -scores))[:5].tolist()


def test_no_candidate_is_scored_twice():
    r = np.random.default_rng(2)
    ids, vectors = np.arange(3000), np.floor(r.normal(size=(3000, 64)) * 256).astype(np.int64)
    assert topk.threshold_search(topk.Block(ids, vectors), ids[:20], vectors[:20], topk.Best(20, 5)) <= 20 * 3000


def test_exact_beyond_doubles(spark):
    """Scores that differ by less than a double can tell at their size."""
    rows = [(0, [4194304.0, 1.0]), *[(k, [4194304.0, float(k)]) for k in range(1, 9)]]
    assert search(spark, rows) == brute(rows) and brute(rows)[0][3] > 1 << 53


def test_scores_that_fit_no_long(spark):
    with pytest.raises(Exception, match="64-bit"):
        search(spark, [(0, [1e30, 1.0]), (1, [2.0, 1e30])])


def test_queries_are_not_sent_through_the_driver(spark):
    """However small the queries' table looks, no copy of it for each group of blocks is broadcast."""
    frame = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(300)], "vec_id long, embedding array<float>").repartition(4)
    plan = topk.top_k(topk.integer_vectors(frame), F.col("vec_id") % 50 == 0)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Generate" not in plan


def test_more_queries_than_one_wave(spark, monkeypatch):
    for name, size in (("BLOCK", 16), ("QUERIES", 2), ("WAVE", 3), ("GROUP", 4)):
        monkeypatch.setattr(topk, name, size)
    r = np.random.default_rng(4)
    rows = [(int(i) * 10, [float(x) for x in r.choice([1, 300, 1e5], 1) * r.normal(size=2 + i % 3)]) for i in range(400)]
    assert search(spark, rows) == brute([(i, np.float32(v).tolist()) for i, v in rows])
