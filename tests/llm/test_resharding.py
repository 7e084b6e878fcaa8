import itertools
import time
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import llm_data
from tallyforge.llm import resharding

BY_SOURCE = "pmod(crc32(cast(coalesce(source, '') as binary)), 16)"


def check(rows, n_expected):
    assert len(rows) == n_expected
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    for members in slots.values():
        assert sorted(members) == list(range(len(members)))


@pytest.mark.parametrize("block_rows", [7, 100_000])
def test_shards_are_equal_in_bytes(spark, block_rows):
    docs = spark.read.parquet(f"{llm_data.SMALL}/documents.parquet")
    rows = resharding.reshard(docs, F.expr(BY_SOURCE), block_rows=block_rows).collect()
    check(rows, docs.count())
    sizes = Counter()
    for r in rows:
        sizes[r.shard] += r.size
    assert set(sizes) == set(range(16))
    assert max(sizes.values()) - min(sizes.values()) <= max(r.size for r in rows)


def test_sizes_and_checksums(spark):
    rows = resharding.digest(resharding.reshard(llm_data.documents(spark), F.expr(BY_SOURCE))).collect()
    check(rows, len(llm_data.awkward_rows()))
    expected = Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
        for i, t, *_ in llm_data.awkward_rows()
    )
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == expected
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}


def test_no_more_bytes_move_than_must(spark):
    docs = spark.createDataFrame(
        [(i, "x" * 99, None, "s") for i in range(160)], "doc_id long, text string, lang string, source string"
    )
    old = F.when(F.col("doc_id") < 100, 0).when(F.col("doc_id") < 150, 1).otherwise(2)
    rows = resharding.reshard(docs, old, shards=4, block_rows=10).collect()
    assert sum(r.shard != r.old_shard for r in rows) == 60 + 10
    assert Counter(r.shard for r in rows) == {0: 40, 1: 40, 2: 40, 3: 40}


def fewest_moved(rows, capacities):
    """Bytes that must move: what each old shard has beyond its room as a new one."""
    held = Counter()
    for r in rows:
        held[r.old_shard] += r.size
    return sum(max(0, n - (capacities[s] if s < len(capacities) else 0)) for s, n in held.items())


def test_large_documents_do_not_push_small_ones_out(spark):
    rows = [(i, "x" * 9_999, 0) for i in range(20)] + [(100 + i, "x" * 99, 1) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, old int")
    got = resharding.reshard(docs, F.col("old"), shards=3).collect()
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r.size
    assert sizes == {0: 100_000, 1: 100_000, 2: 100_000}
    assert sum(r.size for r in got if r.shard != r.old_shard) == 100_000


@pytest.mark.parametrize("seed", range(8))
def test_fewest_bytes_move_whatever_the_sizes(spark, seed):
    import random

    rng = random.Random(seed)
    n_old, shards = rng.randint(1, 9), rng.randint(1, 6)
    # Old shards have documents of different sizes, some of one size alone.
    kinds = [[rng.choice([1, 9, 50, 400, 3000]) for _ in range(rng.randint(1, 3))] for _ in range(n_old)]
    rows = []
    for old in range(n_old):
        for _ in range(rng.randint(0, 120)):
            rows.append((len(rows), "x" * rng.randint(1, rng.choice(kinds[old])), old))
    docs = spark.createDataFrame(rows, "doc_id long, text string, old int")
    got = resharding.reshard(docs, F.col("old"), shards=shards, block_rows=20).collect()
    check(got, len(rows))
    total, sizes = sum(r.size for r in got), Counter()
    for r in got:
        sizes[r.shard] += r.size
    capacities = [total // shards + (s < total % shards) for s in range(shards)]
    moved = sum(r.size for r in got if r.shard != r.old_shard)
    largest = max(r.size for r in got)
    assert max(abs(sizes[s] - capacities[s]) for s in range(shards)) <= largest
    # Each of at most n_old + shards - 1 flows has a cut, which a document may cross.
    assert moved <= fewest_moved(got, capacities) + (n_old + shards) * largest


def test_any_number_of_old_shards(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "repeat('x', 9) AS text", "id % 10000 AS old")
    start = time.perf_counter()
    got = resharding.reshard(docs, F.col("old"), shards=16).collect()
    assert time.perf_counter() - start < 60
    assert len(got) == 20_000 and {r.old_shard for r in got} == set(range(10_000))
    assert sum(r.shard == r.old_shard for r in got) == 16 * 2
    assert max(Counter(r.shard for r in got).values()) == 1250


def test_documents_of_no_old_shard(spark):
    docs = spark.createDataFrame([(i, "x" * i, (None, -3, 0, 7)[i % 4]) for i in range(80)], "doc_id long, text string, old int")
    got = resharding.reshard(docs, F.col("old"), shards=2).collect()
    check(got, 80)
    assert Counter(r.old_shard for r in got) == {None: 20, -3: 20, 0: 20, 7: 20}
    assert all(r.shard == 0 for r in got if r.old_shard == 0)


def test_many_sources_take_little_time():
    supply = [(7 * s) % 1000 + 1 for s in range(4096)]
    room = [-(-sum(supply) // 16)] * 16
    start = time.process_time()
    flow = resharding.min_cost_flow(supply, room)
    assert time.process_time() - start < 20
    assert sum(flow.values()) == sum(supply)
    assert all(flow.get((s, s)) == supply[s] for s in range(16))


def test_old_shards_that_differ_in_cost_are_bounded(spark):
    with pytest.raises(ValueError, match="4096"):
        resharding.reshard(llm_data.empty(spark), F.lit(0), alike_from=4096)


def brute_cost(supply, room, cost):
    """Least cost over all ways to send whole units."""
    units = [s for s, n in enumerate(supply) for _ in range(n)]
    return min(
        sum(cost(s, t) for s, t in zip(units, way))
        for way in itertools.product(range(len(room)), repeat=len(units))
        if all(way.count(t) <= n for t, n in enumerate(room))
    )


@pytest.mark.parametrize("seed", range(60))
def test_flow_is_the_cheapest(seed):
    import random

    rng = random.Random(seed)
    supply = [rng.randint(0, 2) for _ in range(3)]
    room = [rng.randint(0, 3) for _ in range(3)]
    room[0] += max(0, sum(supply) - sum(room))
    costs = [[rng.randint(0, 5) for _ in room] for _ in supply]
    flow = resharding.min_cost_flow(supply, room, lambda s, t: costs[s][t])
    for s, n in enumerate(supply):
        assert sum(v for (a, _), v in flow.items() if a == s) == n
    for t, n in enumerate(room):
        assert sum(v for (_, b), v in flow.items() if b == t) <= n
    total = sum(costs[s][t] * v for (s, t), v in flow.items())
    assert total == brute_cost(supply, room, lambda s, t: costs[s][t])


def test_affected_shards_are_rewritten(spark, tmp_path):
    docs = spark.createDataFrame([(i, "x" * 9) for i in range(40)], "doc_id long, text string")
    old = F.when(F.col("doc_id") < 20, 0).when(F.col("doc_id") < 30, 1).otherwise(2)
    placement = resharding.reshard(docs, old, shards=3, capacities=[100, 200, 100])
    resharding.rewrite(docs, placement, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter(r.shard for r in back.collect()) == {0: 10, 1: 20}
    assert {p.name for p in (tmp_path / "out").iterdir() if p.is_dir()} == {"shard=0", "shard=1"}


def test_empty_table(spark):
    assert resharding.reshard(llm_data.empty(spark), F.expr(BY_SOURCE)).count() == 0
