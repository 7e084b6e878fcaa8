import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import hard_negatives as hn

SCHEMA = "vec_id bigint, embedding array<float>, label int, row string, block string, score string, rank string"


def brute(rows, positives=5, negatives=5):
    """``rows`` of ``vec_id, embedding, label``; a sorted list of the result's rows."""
    part = []
    for at, (vec_id, vector, label) in enumerate(rows):
        if vector is None or label is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = int(math.fmod(label + 1, 10))
        part.append((at, vec_id, label, [math.floor(256 * float(np.float32(x))) for x in vector]))

    def order(found):
        return sorted(found, key=lambda f: (-f[0], f[1] is None, f[1] or 0, f[2]))

    out = []
    for at, anchor_id, label, vector in part:
        if anchor_id is None or anchor_id % 100:
            continue
        scored = [
            (sum(x * y for x, y in zip(vector, other)), vec_id, i, own)
            for i, vec_id, own, other in part
            if i != at
        ]
        for high, positive_id, _, _ in order(s for s in scored if s[3] == label)[:positives]:
            fits = [s for s in scored if s[3] != label and 80 * high <= 100 * s[0] <= 100 * high]
            for rank, (score, vec_id, _, _) in enumerate(order(fits)[:negatives], 1):
                out.append((anchor_id, positive_id, rank, vec_id, high, score))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, None, None, None, None) for r in rows], SCHEMA).repartition(3)


def random_rows(rng, n, dims, spread=1.0, ids=None):
    return [
        (rng.choice(ids) if ids else i, [rng.gauss(0, spread) for _ in range(dims)], rng.randint(0, 2))
        for i in range(n)
    ]


@pytest.fixture
def small_blocks(monkeypatch):
    # Tasks see the module anew, so only what the driver decides is changed.
    monkeypatch.setattr(hn, "ROWS_IN_BLOCK", 60)
    monkeypatch.setattr(hn, "ANCHORS_IN_BLOCK", 3)


def got(spark, rows):
    return sorted(map(tuple, hn.hard_negatives(frame(spark, rows)).collect()), key=repr)


@pytest.mark.parametrize("spread, dims", [(1.0, 3), (0.01, 4), (300.0, 5)])
def test_mined_are_those_of_brute_force(spark, small_blocks, spread, dims):
    # A small spread gives many equal scores.
    rows = random_rows(random.Random(dims), 900, dims, spread)
    expected = brute(rows)
    assert expected and got(spark, rows) == expected


def test_awkward_rows(spark, small_blocks):
    rng = random.Random(4)
    rows = random_rows(rng, 300, 3, 0.05)
    rows += [(None, [0.1, 0.2, 0.1], 1), (300, None, 1), (400, [1.0, None, 0.1], 1), (500, [1.0, 1.0, 1.0], None)]
    rows += [(600, [float("nan"), 1.0, 1.0], 1), (700, [float("inf"), 1.0, 1.0], 1), (800, [0.1, 0.1], 1)]
    rows += [(900, [], 2), (1000, [0.0, 0.0, 0.0], 1), (1100, [-0.1] * 3, 0)]
    rows += rows[:5]
    assert got(spark, rows) == brute(rows)


def test_a_repeated_id_is_many_rows(spark, small_blocks):
    rows = random_rows(random.Random(6), 120, 3, 0.1, ids=[100, 7, 9])
    assert got(spark, rows) == brute(rows)


def test_empty_table_and_tables_without_anchors_or_negatives(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []
    assert got(spark, [(100, [1.0], 1), (1, [1.0], 1)]) == []


def test_general_parameters(spark):
    rows = [(i, [float(i), 1.0], i % 2) for i in range(1, 9)]
    whole = hn.whole_rows(frame(spark, rows), scale=1)
    mined = hn.mine(whole, F.col("vec_id") == 8, positives=1, negatives=2, least_percent=50).collect()
    # 8 . 6 gives 49; odd rows below it from 24.5 on are 5 (41) and 3 (25).
    assert sorted(map(tuple, mined)) == [(8, 6, 1, 5, 49, 41), (8, 6, 2, 3, 49, 25)]


def test_reading_stops_early_where_the_threshold_lets_it():
    rng = np.random.default_rng(2)
    vectors = rng.integers(-900, 900, (4000, 8)).astype(float)
    vectors[:50, 0] = 1000 + rng.permutation(50)
    lists = hn.SortedLists(vectors, np.arange(4000))
    anchor = np.zeros(8)
    anchor[0] = 1.0
    read = []

    class Counted(hn.Best):
        def offer(self, rows, scores, ids):
            read.append(len(rows))
            super().offer(rows, scores, ids)

    best = Counted(-np.inf, np.inf, 5)
    lists.search(anchor, np.ones(4000, dtype=bool), [best])
    assert sum(read) == hn.FIRST_DEPTH
    assert set(best.rows) == set(np.argsort(-vectors[:, 0])[:5])


def test_a_tie_at_the_last_place_goes_to_the_smaller_id():
    vectors = np.ones((300, 2))
    lists = hn.SortedLists(vectors, np.arange(300)[::-1].copy())
    best = hn.Best(2, 2, 5)
    lists.search(np.ones(2), np.ones(300, dtype=bool), [best])
    assert best.rows.tolist() == [299, 298, 297, 296, 295]


def test_number_types():
    assert hn.exact_type(100) is np.float32 and hn.exact_type(2.0**30) is np.float64
    assert hn.exact_type(2.0**60) is np.int64
    with pytest.raises(ValueError, match="bigint"):
        hn.exact_type(2.0**70)
