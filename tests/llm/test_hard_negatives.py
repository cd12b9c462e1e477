import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymix.llm import hard_negatives as hn


def brute(rows, anchor, positives=5, negatives=5, low=80, high=100):
    """Every score of every anchor, by plain loops."""
    sound = [(i, k, [math.floor(256 * x) for x in v]) for i, k, v in rows if k is not None and v is not None
             and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (a, label, q) in enumerate(sound):
        if a is None or a % anchor:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v)), hn.NO_ID if i is None else i, m, k, i)
                        for m, (i, k, v) in enumerate(sound) if m != n)
        for s, _, _, _, p in [x for x in scored if x[3] == label][:positives]:
            fits = [x for x in scored if x[3] != label and low * -s <= 100 * -x[0] <= high * -s][:negatives]
            out += [(a, p, r, x[4], -s, -x[0]) for r, x in enumerate(fits, 1)]
    return sorted(map(str, out))


def mined(df, **how):
    return sorted(str(tuple(r)) for r in hn.mine(df, F.col("label"), F.col("vec_id") % 10 == 0, **how).collect())


def frame(spark, rows):
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>")
    return df.withColumn("row", F.lit("x")).withColumn("cell", F.lit(2.5)).withColumn("vector", F.lit(1))


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 9))
    at = rng.integers(12, size=900)
    x = centres[at] + 0.05 * rng.normal(size=(900, 9))
    return [(int(i), int(rng.integers(3)), v.tolist()) for i, v in enumerate(x)]


@pytest.mark.parametrize("shard_rows", [50, 300, 8192])
def test_equals_all_scores(spark, clustered, shard_rows):
    df = frame(spark, clustered)
    assert mined(df, shard_rows=shard_rows) == brute(clustered, 10)
    assert mined(df, shard_rows=shard_rows, positives=2, negatives=9, low=-50, high=90) == brute(
        clustered, 10, 2, 9, -50, 90)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(2)
    rows = [(int(i), int(i) % 2, np.round(rng.normal(size=5), 1).tolist()) for i in range(60)]
    rows += rows[:12] + [(100 + i, i % 2, [1.0, 1.0, 0.0, 0.0, 0.0]) for i in range(30)]  # repeated rows, then ties
    rows += [(200, None, [1.0] * 5), (210, 1, None), (220, 1, [None] * 5), (230, 1, [nan, 1.0]), (240, 0, [inf] * 5),
             (None, 1, [1.0] * 5), (None, 0, [2.0] * 5), (None, None, None), (250, 1, [0.5]), (260, 0, []), (270, 1, [0.0] * 5),
             (-10, 1, [-1.0, 0.5, 2.0, 0.0, 1.0])]
    assert mined(frame(spark, rows)) == brute(rows, 10)
    assert mined(frame(spark, rows), shard_rows=16) == brute(rows, 10)


def test_components_too_large_for_floating_point(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), int(i) % 2, (rng.integers(-2**33, 2**33, 6) / 2**17 + 30_000).tolist()) for i in range(80)]
    assert mined(frame(spark, rows)) == brute(rows, 10)
    assert len(mined(frame(spark, [(i, i % 2, [1e300, -1e300]) for i in range(0, 40)])))


def test_tables_without_a_result(spark):
    for rows in ([], [(10, 1, [1.0])], [(1, 1, [1.0]), (2, 0, [1.0])], [(10, 1, [0.0]), (20, 1, [0.0])], [(0, 1, []), (1, 1, [])]):
        df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>")
        assert mined(df) == []


def test_cells_come_in_order_of_their_bounds(clustered):
    x = np.floor(256 * np.array([v for _, _, v in clustered])).astype(np.int64)
    books = hn.fit_codebook(x[:, :4].astype(float)), hn.fit_codebook(x[:, 4:].astype(float))
    cells = hn.nearest(x[:, :4].astype(float), books[0]) * len(books[1]) + hn.nearest(x[:, 4:].astype(float), books[1])
    shard = hn.Shard(x, cells, books)
    for q in x[:20]:
        seen, last = [], math.inf
        for at, rest in shard.visit(q):
            assert rest <= last
            seen += shard.order[at].tolist()
            left = np.setdiff1d(np.arange(len(x)), seen)
            assert not len(left) or (x[left] @ q).max() <= rest
            last = rest
        assert sorted(seen) == list(range(len(x)))


def test_clustered_vectors_are_left_early(clustered):
    x = np.floor(256 * np.array([v for _, _, v in clustered])).astype(np.int64)
    books = hn.fit_codebook(x[:, :4].astype(float)), hn.fit_codebook(x[:, 4:].astype(float))
    cells = hn.nearest(x[:, :4].astype(float), books[0]) * len(books[1]) + hn.nearest(x[:, 4:].astype(float), books[1])
    shard, read = hn.Shard(x, cells, books), 0
    labels = np.array([k for _, k, _ in clustered])

    class Counted(hn.Shard):
        def visit(self, anchor, most=math.inf):
            nonlocal read
            for at, rest in super().visit(anchor, most):
                read += len(at)
                yield at, rest

    shard.__class__ = Counted
    ids = rows = np.arange(len(x))
    for i in range(0, 900, 10):
        hn.Search(i, int(labels[i]), x[i], None, 5, 80, 100).take(shard, ids, labels, rows)
    assert read < 0.4 * 90 * 900
