"""Resharding with the fewest bytes moved, as a minimum-cost flow.

Documents lie in old shards of uneven sizes and are to fill new shards of given
capacities. A byte that stays where it is costs nothing, a byte that moves costs
what its way costs. The flow from old sizes to new capacities is solved on a graph
of shards, which is small whatever the data; Spark then turns the flow into moves
of blocks of documents.

Documents are placed by size class, the largest first. For each class the flow of all
that is not placed yet is solved anew, so it is the cheapest that is still possible, and
an old shard's flows share its documents of the class. What a cut between two flows
leaves uneven is thus evened out by smaller documents. The bytes moved are the fewest
for documents that could be split, but for one document a cut. Within an old shard and
class documents lie in blocks of bounded size, one after the other, and a flow is an
interval of that line. The document that a cut runs through, one for each cut, goes
where most room is left. Positions on the line come from sums of blocks and running
sums inside blocks, so no task orders a whole shard.

There may be any number of old shards. Those that cost alike wherever they go, as all
whose number is none of the new ones, are one source of the flow.

``size`` is the text's UTF-8 bytes and 1 more, so a null text and an empty one have
size 1. Ids may be null or repeat: rows are placed one by one. An empty table
gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.llm.common import text_or_empty, written

SHARDS = 16
# Average rows of a block.
BLOCK_ROWS = 5_000
# Sizes of a class lie within a factor of 2 ** CLASS_BITS.
CLASS_BITS = 3
# The graph is solved on the driver, so old shards that differ in cost are bounded.
MAX_SOURCES = 4096

MAX_CLASSES = 63 // CLASS_BITS + 1


def move_cost(old: int, new: int) -> int:
    """Cost of a byte's way: only shards that keep their number keep their place."""
    return 0 if old == new else 1


def min_cost_flow(supply: list[int], room: list[int], cost=move_cost) -> dict[tuple[int, int], int]:
    """Cheapest flow of all supplies into the rooms, as ``{(source, sink): amount}``.

    Successive shortest augmenting paths over the residual graph, with potentials
    so that Dijkstra's search sees no negative arc. Whenever these change, all arcs
    that now are shortest paths are filled at once. The rooms together must hold the
    supplies; costs must not be negative.
    """
    if sum(supply) > sum(room):
        raise ValueError("supplies exceed the capacities")
    n_sources, n_sinks = len(supply), len(room)
    left, free = list(supply), list(room)
    flow: dict[tuple[int, int], int] = {}
    potential = [0] * (n_sources + n_sinks)

    def fill_direct_arcs() -> None:
        """Fill shortest arcs from sources with supply to the nearest sinks with room."""
        nearest = min((potential[n_sources + t] for t in range(n_sinks) if free[t]), default=0)
        sinks = [t for t in range(n_sinks) if free[t] and potential[n_sources + t] == nearest]
        for s in range(n_sources):
            for t in sinks if left[s] else ():
                if free[t] and cost(s, t) + potential[s] == nearest:
                    amount = min(left[s], free[t])
                    flow[s, t] = flow.get((s, t), 0) + amount
                    left[s] -= amount
                    free[t] -= amount
                    if not left[s]:
                        break

    fill_direct_arcs()
    while any(left):
        # Paths start at any source with supply left and end at any sink with room.
        distance = [None] * (n_sources + n_sinks)
        before = [-1] * (n_sources + n_sinks)
        heap = [(0 - potential[s], s) for s in range(n_sources) if left[s]]
        lowest = min(heap)[0]
        heap = [(d - lowest, s) for d, s in heap]
        heapq.heapify(heap)
        for d, s in heap:
            distance[s] = d
        done = [False] * len(distance)
        while heap:
            d, v = heapq.heappop(heap)
            if done[v]:
                continue
            done[v] = True
            if v < n_sources:
                arcs = [(n_sources + t, cost(v, t)) for t in range(n_sinks)]
            else:
                t = v - n_sources
                arcs = [(s, -cost(s, t)) for s in range(n_sources) if flow.get((s, t))]
            for w, c in arcs:
                reach = d + c + potential[v] - potential[w]
                if distance[w] is None or reach < distance[w]:
                    distance[w], before[w] = reach, v
                    heapq.heappush(heap, (reach, w))
        ends = [n_sources + t for t in range(n_sinks) if free[t] and done[n_sources + t]]
        end = min(ends, key=lambda v: distance[v] + potential[v])
        path = [end]
        while before[path[-1]] >= 0:
            path.append(before[path[-1]])
        path.reverse()
        amount = min(left[path[0]], free[end - n_sources])
        for v, w in zip(path, path[1:]):
            if v >= n_sources:
                amount = min(amount, flow[w, v - n_sources])
        for v, w in zip(path, path[1:]):
            if v < n_sources:
                flow[v, w - n_sources] = flow.get((v, w - n_sources), 0) + amount
            else:
                flow[w, v - n_sources] -= amount
        left[path[0]] -= amount
        free[end - n_sources] -= amount
        farthest = max(d for d, ok in zip(distance, done) if ok)
        for v, d in enumerate(distance):
            potential[v] += d if done[v] else farthest
        fill_direct_arcs()
    return {arc: amount for arc, amount in flow.items() if amount}


@dataclass(frozen=True)
class Cut:
    """An interval of a source's line of one class, and the shard it goes to."""

    source: int
    size_class: int
    low: int
    high: int
    shard: int


def _line(documents: DataFrame, old_shard: Column, alike_from: int, block_rows: int) -> DataFrame:
    """``doc_id, size, text_crc32, old, source, size_class, block, position``, written."""
    text = text_or_empty()
    size = F.octet_length(text).cast("bigint") + 1
    thin = written(
        documents.select(
            "doc_id",
            size.alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            old_shard.cast("int").alias("old"),
            F.floor(F.log2(size) / CLASS_BITS).cast("int").alias("size_class"),
            F.xxhash64(F.monotonically_increasing_id()).alias("scatter"),
        ).withColumn(
            "source",
            F.when(F.col("old").between(0, alike_from - 1), F.col("old")).otherwise(F.lit(alike_from)),
        ),
        "reshard_sizes",
    )
    n_blocks = max(1, -(-thin.count() // block_rows))
    placed = thin.withColumn("block", F.pmod("scatter", F.lit(n_blocks)).cast("int"))
    line = Window.partitionBy("source", "size_class").orderBy("block")
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        placed.groupBy("source", "size_class", "block")
        .agg(F.sum("size").alias("bytes"))
        .withColumn("block_start", F.coalesce(F.sum("bytes").over(before), F.lit(0)))
        .drop("bytes")
    )
    inside = (
        Window.partitionBy("source", "size_class", "block")
        .orderBy("scatter")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return written(
        placed.withColumn("in_block", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(blocks, ["source", "size_class", "block"])
        .select(
            "doc_id", "size", "text_crc32", "old", "source", "size_class", "block",
            (F.col("block_start") + F.col("in_block")).alias("position"),
        ),
        "reshard_line",
    )


def _share(flow: dict[tuple[int, int], int], bytes_of: dict[int, int], size_class: int) -> list[Cut]:
    """Intervals of one class, of so many bytes from each source, along the flow of all.

    The largest flows take their part first, so that few cuts run through large documents.
    """
    cuts, at = [], {}
    for source, shard in sorted(flow, key=lambda arc: (-flow[arc], arc)):
        low = at.get(source, 0)
        high = min(low + flow[source, shard], bytes_of.get(source, 0))
        if high > low:
            cuts.append(Cut(source, size_class, low, high, shard))
            at[source] = high
    return cuts


def plan(line: DataFrame, capacities: list[int], cost=move_cost) -> tuple[list[Cut], dict]:
    """Intervals that go to each shard, and the shard of each document that a cut splits.

    The second is keyed by ``(source, size_class, position)``. Both are bounded by the
    number of sources, shards and classes.
    """
    sums = line.groupBy("source", "size_class").agg(F.sum("size").alias("bytes")).collect()
    left = [0] * (1 + max((row["source"] for row in sums), default=-1))
    for row in sums:
        left[row["source"]] += row["bytes"]
    need = list(capacities)
    cuts: list[Cut] = []
    split: dict[tuple[int, int, int], int] = {}
    for size_class in sorted({row["size_class"] for row in sums}, reverse=True):
        supply = {row["source"]: row["bytes"] for row in sums if row["size_class"] == size_class}
        flow = min_cost_flow(left, [max(0, n) for n in need], cost)
        own = _share(flow, supply, size_class)
        cuts += own
        for source, n_bytes in supply.items():
            left[source] -= n_bytes
        for cut in own:
            need[cut.shard] -= cut.high - cut.low
        inner = [(c.source, c.high) for c in own if c.high < supply[c.source]]
        if not inner:
            continue
        ends = line.sparkSession.createDataFrame(inner, "source int, cut bigint")
        crossing = (
            line.filter(F.col("size_class") == size_class)
            .join(F.broadcast(ends), "source")
            .filter((F.col("position") < F.col("cut")) & (F.col("cut") < F.col("position") + F.col("size")))
            .select("source", "position", "size")
            .distinct()
            .orderBy(F.desc("size"), "source", "position")
            .collect()
        )
        for row in crossing:
            low, high = row["position"], row["position"] + row["size"]
            for cut in own:
                if cut.source == row["source"]:
                    need[cut.shard] += max(0, min(high, cut.high) - max(low, cut.low))
        for row in crossing:
            shard = max(range(len(need)), key=lambda s: (need[s], -s))
            split[row["source"], size_class, row["position"]] = shard
            need[shard] -= row["size"]
    return cuts, split


def reshard(
    documents: DataFrame,
    old_shard: Column,
    shards: int = SHARDS,
    capacities: list[int] | None = None,
    block_rows: int = BLOCK_ROWS,
    cost=move_cost,
    alike_from: int | None = None,
) -> DataFrame:
    """Place every document in a new shard, moving as few bytes as may be.

    ``old_shard`` gives the present shard, from 0; null or a negative number is one that
    no new shard continues. Without ``capacities`` the new
    shards are to be equal in bytes. Old shards from ``alike_from`` on have the same
    ``cost`` to each new shard; by default, those beyond the number of new ones. Returns
    ``doc_id, size, text_crc32, old_shard, shard, slot``; slots of a shard run from 0
    without gaps.
    """
    spark = documents.sparkSession
    shards = len(capacities) if capacities else shards
    alike_from = shards if alike_from is None else alike_from
    if alike_from >= MAX_SOURCES:
        raise ValueError(f"{MAX_SOURCES} old shards or more that differ in cost")
    line = _line(documents, old_shard, alike_from, block_rows)
    if capacities is None:
        total = line.agg(F.sum("size")).first()[0] or 0
        capacities = [total // shards + (s < total % shards) for s in range(shards)]
    cuts, split = plan(line, capacities, cost)

    cut_rows = [(c.source, c.size_class, c.low, c.high, c.shard) for c in cuts]
    intervals = spark.createDataFrame(
        cut_rows, "_source int, _class int, low bigint, high bigint, to_shard int"
    )
    split_rows = [(*key, shard) for key, shard in split.items()]
    splits = spark.createDataFrame(
        split_rows, "source int, size_class int, position bigint, split_shard int"
    )
    placed = (
        line.join(F.broadcast(splits), ["source", "size_class", "position"], "left")
        .join(
            F.broadcast(intervals),
            (F.col("source") == F.col("_source"))
            & (F.col("size_class") == F.col("_class"))
            & (F.col("position") >= F.col("low"))
            & (F.col("position") < F.col("high")),
        )
        .withColumn("shard", F.coalesce("split_shard", "to_shard"))
        .select(
            "doc_id", "size", "text_crc32", "old", "source", "size_class", "block", "position", "shard"
        )
    )
    part = ["shard", "source", "size_class", "block"]
    first = (
        placed.groupBy(*part)
        .agg(F.count("*").alias("n"))
        .withColumn(
            "first_slot",
            F.coalesce(
                F.sum("n").over(
                    Window.partitionBy("shard")
                    .orderBy("source", "size_class", "block")
                    .rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        )
        .drop("n")
    )
    rank = F.row_number().over(Window.partitionBy(*part).orderBy("position"))
    return (
        placed.withColumn("rank", rank)
        .join(first, part)
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.col("old").alias("old_shard"),
            "shard",
            (F.col("first_slot") + F.col("rank") - 1).alias("slot"),
        )
    )


def rewrite(documents: DataFrame, placement: DataFrame, path: str) -> None:
    """Write the shards that gain or lose documents, one folder each, under ``path``.

    ``doc_id`` must be unique here. A shard whose documents all stay and to which
    none comes is left alone. A large shard is written by many tasks.
    """
    moved = placement.filter("shard != old_shard")
    affected = (
        moved.select(F.col("shard").alias("affected"))
        .union(moved.select("old_shard"))
        .distinct()
    )
    chosen = placement.join(
        F.broadcast(affected), placement["shard"] == F.col("affected"), "left_semi"
    ).select(F.col("doc_id").alias("_placed_id"), "shard", "slot")
    (
        documents.drop("shard", "slot")
        .join(chosen, documents["doc_id"] == F.col("_placed_id"))
        .drop("_placed_id")
        .write.partitionBy("shard")
        .mode("overwrite")
        .parquet(path)
    )


def digest(placement: DataFrame) -> DataFrame:
    """The placement with the law it keeps."""
    return placement.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
