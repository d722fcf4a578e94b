import numpy as np
import pytest
from conftest import SF_DIR
from harness import difference
from pyspark.sql import functions as F

import __spark_entry__ as driver
from rasterlake.llm import queries, topk


@pytest.mark.parametrize("name", sorted(queries.CHECKS))
def test_queries_with_sql(spark, name):
    problem = difference(driver.queries()[name](spark, SF_DIR), SF_DIR, driver.oracle_sql()[name])
    assert problem is None, problem


@pytest.mark.parametrize("few", [0, 3, 256])
def test_block_against_brute_force(monkeypatch, few):
    monkeypatch.setattr(topk, "FEW", few)
    rng = np.random.default_rng(few)
    for _ in range(200):
        n, size = int(rng.integers(1, 60)), int(rng.integers(1, 6))
        x, ids = rng.integers(-3, 4, (n, size)), np.arange(n) * int(rng.integers(1, 4))
        q, own = rng.integers(-3, 4, (6, size)), rng.integers(0, 3 * n, 6)
        at, found, scores = topk.search_block(ids, x, own, q, 5)
        for k in range(6):
            want = sorted((-int(s), int(i)) for s, i in zip(x @ q[k], ids) if i != own[k])[:5]
            assert sorted((-int(s), int(i)) for s, i in zip(scores[at == k], found[at == k])) == want


def test_large_values_stay_exact():
    x = np.array([[2**30, 1], [2**30, 0]])
    at, found, scores = topk.search_block(np.array([1, 2]), x, np.array([9]), np.array([[2**30, 1]]), 1)
    assert (found.tolist(), scores.tolist()) == ([1], [2**60 + 1])


def test_odd_rows(spark):
    rows = [
        (0, [1.0, 2.0]), (50, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [9.0, 9.0]), (2, None), (3, [1.0, None]), (4, [1.0, float("nan")]),
        (5, [float("inf"), 1.0]), (6, []), (7, [1.0]), (None, [5.0, 5.0]), (8, [-1.0, 0.0]),
    ]
    table = spark.createDataFrame([r + (1, "x") for r in rows], "vec_id long, embedding array<float>, rank int, SCORE string")
    usable = table.filter(topk.usable(F.col("embedding")))
    scaled = usable.select("vec_id", topk.scaled(F.col("embedding")).alias("embedding"), "rank", "SCORE")
    for sizes in ((8192, 512), (2, 1)):
        got = topk.search(scaled, F.col("vec_id") % 50 == 0, 2, candidates=sizes[0], queries=sizes[1])
        want = [(0, 1, 1, 27 * 65536), (0, 2, 1, 5 * 65536), (50, 1, 1, 27 * 65536), (50, 2, 0, 5 * 65536)]
        assert sorted(map(tuple, got.collect())) == sorted(want)
    assert topk.search(scaled.limit(0), F.col("vec_id") % 50 == 0, 2).count() == 0


def test_repeated_ids_are_rows_of_their_own(spark):
    rows = [(50, [1.0]), (50, [3.0]), (1, [2.0]), (1, [2.0]), (2, [0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for sizes in ((8192, 512), (1, 1)):
        got = topk.search(table, F.col("vec_id") % 50 == 0, 3, candidates=sizes[0], queries=sizes[1])
        want = [(50, 1, 50, 3), (50, 2, 1, 2), (50, 3, 1, 2), (50, 1, 1, 6), (50, 2, 1, 6), (50, 3, 50, 3)]
        assert sorted(map(tuple, got.collect())) == sorted(want)
