"""Near duplicates by word shingles: an exact Jaccard join on parity sketches.

A document is the set of its distinct five-word shingles. Sets that differ in few
shingles are found through parity sketches: shingles are dealt into blocks by hash,
and a block's sketch is the XOR of the 64-bit hashes of its shingles. A shingle that
only one of two sets has spoils one block at most, so the number of blocks in which
their sketches differ is a lower bound of the sets' difference.

**Pigeonhole.** Two sets of sizes n <= m with a similarity of 0.75 or more differ in
D = (n + m) / 7 shingles at most. Put all sketches of all blocks in one order. At
most D sketches of a set are not in the other, so the first one that both have is
among the first D + 1 of each. A set therefore goes to the join with its first D + 1
sketches and no link is lost. The number of blocks belongs to a band of sizes; a set
near a band's end joins in the next band too.

**Order.** Blocks with more shingles come first: two sets agree in such a block by
sharing all of them. Sketches that very many sets have come last, so that sets which
share only a common passage do not meet. Which sketches these are is counted
beforehand; any choice is right, so the list of them may be bounded.

**Verification.** Sets with equal shingles are one node. In every group of nodes that
share a sketch all are compared with one, the least. Where this leaves a group in
several components, the pairs across components are compared: directly in small groups and in
those of up to 2048; the sets of larger ones, which share a template, meet again by the
shingles that few of them have, and sets with few such by the template's part they have. So a group of
copies costs its size, as does one of a template, and no group lists all its pairs. Pairs are first held against bit sketches, the parities of
shingles in a number of bits, whose Hamming distance is a lower bound of the sets'
difference as well; for the few that pass, the shingles' hashes are compared.

A-Z are lower-cased; words are split at ASCII white space. A text of fewer than five
words has one shingle, all of it; one without words, or null, has none, and is linked
with nothing. Repeated rows are copies; ids may be null and are then left out of the
least id of a component, which is null if no member has one. Extra columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.llm.common import written
from tallyforge.llm.components import components

SHINGLE_WORDS = 5
# Sizes of a band lie within this factor.
BAND_FACTOR = 4
# A block for so many shingles of the largest set of its band. It must leave sets more
# filled blocks than shingles that may differ, 2 / 7 of a set; 2.4 leaves 0.38.
BLOCK_SHINGLES = 2.4
LEAST_BLOCKS = 128
# Sketches that come last in the order: at most so many, each of so many sets.
COMMON_SKETCHES = 1 << 18
COMMON_FROM = 32
# A task counts so many sketches at once, and reports those it saw so often.
COUNT_AT_ONCE = 1 << 22
REPORT_FROM = 3
# Bits of the maps of keys by which tasks leave out what cannot be wanted.
MAP_BITS = 1 << 26
# Groups up to the first size are compared pair by pair, up to the second in a tile.
SMALL_GROUP = 32
TILE = 2048
# Of its groups in tiles each node knows so many, to leave a pair to the first they share.
KNOWN_GROUPS = 8
LEAST_BITS = 256

_M1, _M2, _M3 = (np.uint64(m) for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9E3779B97F4A7C15))


def _mixed(h: np.ndarray) -> np.ndarray:
    """64-bit values spread evenly, one to one."""
    h = (h ^ (h >> np.uint64(33))) * _M1
    h = (h ^ (h >> np.uint64(33))) * _M2
    return h ^ (h >> np.uint64(33))


_SPACES = np.zeros(256, dtype=bool)
_SPACES[list(b" \t\n\v\f\r")] = True


def _byte_values() -> np.ndarray:
    """A random odd value for each byte, the same for both cases of A-Z."""
    values = np.random.default_rng(11).integers(0, 1 << 63, 256).astype(np.uint64)
    values = values * np.uint64(2) + np.uint64(1)
    values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    return values


_BYTE_VALUES = _byte_values()


class _Powers:
    """Powers of an odd number modulo 2 ** 64, and those of its inverse, as far as needed."""

    def __init__(self, base: int):
        self._bases = np.array([base, pow(base, -1, 1 << 64)], dtype=np.uint64)
        self._table = np.ones((2, 1), dtype=np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if self._table.shape[1] < n:
            table = np.repeat(self._bases[:, None], 2 * n, axis=1)
            table[:, 0] = 1
            self._table = np.multiply.accumulate(table, axis=1)
        return self._table


_POWERS = _Powers(0xD6E8FEB86659FD93)
# Bytes that are hashed at once; the powers take 32 times as many.
HASHED_AT_ONCE = 1 << 20


def _piece_hashes(data: np.ndarray) -> np.ndarray:
    space = _SPACES[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    powers, inverses = _POWERS.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUES[data] * powers[: len(data)], out=sums[1:])
    return _mixed((sums[ends] - sums[starts]) * inverses[starts])


def word_hashes(text: str) -> np.ndarray:
    """A hash of each word, A-Z lower-cased: a polynomial in its bytes, mixed."""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    if len(data) <= HASHED_AT_ONCE:
        return _piece_hashes(data)
    # Long texts are cut at white space.
    parts, low = [], 0
    gaps = np.flatnonzero(_SPACES[data])
    while low < len(data):
        at = np.searchsorted(gaps, low + HASHED_AT_ONCE)
        high = int(gaps[at]) + 1 if at < len(gaps) else len(data)
        parts.append(_piece_hashes(data[low:high]))
        low = high
    return np.concatenate(parts)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted hashes of a text's distinct shingles."""
    h = word_hashes(text or "")
    if not len(h):
        return np.zeros(0, dtype=np.uint64)
    if len(h) < SHINGLE_WORDS:
        whole = xxhash.xxh3_64_intdigest(h.tobytes(), seed=len(h))
        return _mixed(np.array([whole], dtype=np.uint64))
    n = len(h) - SHINGLE_WORDS + 1
    rolled = h[:n].copy()
    for offset in range(1, SHINGLE_WORDS):
        rolled = rolled * _M3 + h[offset : offset + n]
    # Much faster than np.unique on short arrays.
    rolled = _mixed(rolled)
    rolled.sort()
    return rolled[np.concatenate(([True], rolled[1:] != rolled[:-1]))]


def set_id(shingles: np.ndarray) -> int:
    """A signed 64-bit digest of a set."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def overlap(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sizes of the intersection and the union of two sets."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common, len(a) + len(b) - common


def _blocks(end: int) -> int:
    return max(LEAST_BLOCKS, int(end / BLOCK_SHINGLES))


def _bands(n: int) -> list[tuple[int, int, int]]:
    """Bands in which a set of size ``n`` joins: ``(number, blocks, largest difference)``."""
    band, end = 0, BAND_FACTOR
    while n >= end:
        band, end = band + 1, end * BAND_FACTOR
    largest = 4 * n // 3
    bands = [(band, _blocks(end), (n + min(largest, end - 1)) // 7)]
    if largest >= end:
        bands.append((band + 1, _blocks(end * BAND_FACTOR), (n + largest) // 7))
    return bands


def _sketches(shingles: np.ndarray, band: int, blocks: int) -> np.ndarray:
    """Sketches of the filled blocks, those of more shingles first, then by block.

    They are marked by block and band.
    """
    # The leading bits choose the block, so sorted shingles are sorted by block.
    block = ((shingles >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
    parity = np.bitwise_xor.reduceat(shingles, first)
    of_band = np.uint64((band + 1) * int(_M2) % (1 << 64))
    sketches = _mixed(parity + block[first] * _M3 + of_band)
    filled = np.diff(np.append(first, len(shingles)))
    return sketches[np.argsort(-filled, kind="stable")]


def bit_sketch(shingles: np.ndarray) -> bytes:
    """Parities of the shingles in eight times as many bits or more, a power of two."""
    bits = max(LEAST_BITS, 1 << (8 * len(shingles) - 1).bit_length())
    counts = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """A bit sketch brought to a smaller size; so is every row of a table of them."""
    while bits.shape[-1] > size:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def bit_distance(a: bytes, b: bytes) -> int:
    """Hamming distance of two bit sketches, a lower bound of the sets' difference."""
    left, right = np.frombuffer(a, dtype=np.uint8), np.frombuffer(b, dtype=np.uint8)
    size = min(len(left), len(right))
    return int(np.bitwise_count(folded(left, size) ^ folded(right, size)).sum())


@dataclass
class Order:
    """Common sketches, sorted, with their places among each other."""

    sketches: np.ndarray
    places: np.ndarray

    def first(self, sketches: np.ndarray, count: int) -> np.ndarray:
        """The first sketches in the order; common ones come last, the rarest before."""
        if not len(self.sketches):
            return sketches[:count]
        at = np.minimum(np.searchsorted(self.sketches, sketches), len(self.sketches) - 1)
        common = self.sketches[at] == sketches
        if not common.any():
            return sketches[:count]
        last = sketches[common][np.argsort(self.places[at[common]], kind="stable")]
        return np.concatenate((sketches[~common], last))[:count]


def join_keys(shingles: np.ndarray, order: Order) -> np.ndarray:
    """The sketches with which a set goes to the join."""
    parts = [
        order.first(_sketches(shingles, band, blocks), difference + 1)
        for band, blocks, difference in _bands(len(shingles))
    ]
    return np.concatenate(parts)


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")


def survey(documents: DataFrame) -> DataFrame:
    """A shared table: sizes and digests of all sets, and sketches that tasks saw often.

    ``doc_id, text_hash, n_shingles, set_id, bits`` of every document in rows whose
    ``sketch`` is null; ``sketch, n_sets`` in the others.
    """
    narrow = documents.select("doc_id", _text_hash(), "text")
    schema = T.StructType([narrow.schema["doc_id"]])
    for name in ("text_hash", "n_shingles", "set_id", "sketch", "n_sets"):
        schema = schema.add(name, "long")
    schema = schema.add("bits", "binary")

    def survey_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []
        n_waiting = 0
        id_type = pa.null()

        def often() -> pa.RecordBatch:
            seen, n = np.unique(np.concatenate(waiting), return_counts=True)
            seen, n = seen[n >= REPORT_FROM], n[n >= REPORT_FROM]
            waiting.clear()
            none = pa.nulls(len(seen), pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.nulls(len(seen), id_type), none, none, none, _signed(seen), pa.array(n)]
                + [pa.nulls(len(seen), pa.binary())],
                schema.names,
            )

        for batch in batches:
            id_type = batch.column("doc_id").type
            sizes, digests, bits = [], [], []
            for text in batch.column("text"):
                shingles = shingle_set(text.as_py())
                sizes.append(len(shingles))
                digests.append(set_id(shingles) if len(shingles) else None)
                bits.append(bit_sketch(shingles) if len(shingles) else None)
                if len(shingles):
                    for band, blocks, _ in _bands(len(shingles)):
                        waiting.append(_sketches(shingles, band, blocks))
                        n_waiting += len(waiting[-1])
                if n_waiting >= COUNT_AT_ONCE:
                    yield often()
                    n_waiting = 0
            none = pa.nulls(len(sizes), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes, pa.int64())]
                + [pa.array(digests, pa.int64()), none, none, pa.array(bits, pa.binary())],
                schema.names,
            )
        if waiting:
            yield often()

    return written(narrow.mapInArrow(survey_task, schema), "shingle_survey")


def common_order(surveyed: DataFrame) -> Order:
    """The most common sketches, bounded in number, for all tasks to put last."""
    rows = (
        surveyed.filter("sketch is not null")
        .groupBy("sketch")
        .agg(F.sum("n_sets").alias("n_sets"))
        .filter(F.col("n_sets") >= COMMON_FROM)
        .orderBy(F.desc("n_sets"), "sketch")
        .limit(COMMON_SKETCHES)
        .toArrow()
    )
    sketches = rows["sketch"].to_numpy().astype(np.int64).view(np.uint64)
    places = np.arange(len(sketches))[::-1]
    by_value = np.argsort(sketches)
    return Order(sketches[by_value], places[by_value])


def bit_map(values: DataFrame, hashed: Column) -> np.ndarray:
    """Bits of hashed values, of a fixed size: what is not set is surely not among them.

    With very many values all bits are set and nothing is left out, which costs time
    and changes no result.
    """
    place = F.pmod(hashed, F.lit(MAP_BITS)) + 1
    rows = (
        values.select(place.alias("place"))
        .groupBy(F.expr("bitmap_bucket_number(place)").alias("bucket"))
        .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(place))").alias("bits"))
        .collect()
    )
    bits = np.zeros(MAP_BITS // 8, dtype=np.uint8)
    for row in rows:
        part = np.frombuffer(row["bits"], dtype=np.uint8)
        at = (row["bucket"] - 1) * len(part)
        bits[at : at + len(part)] = part[: len(bits) - at]
    return bits


def in_bit_map(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes, as signed 64-bit values, may be among the map's values."""
    places = hashes & np.int64(MAP_BITS - 1)
    return (bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1


def _key_rows(documents: DataFrame, order: Order, wanted: np.ndarray | None = None) -> DataFrame:
    """``key, set_id, n`` of every set's sketches in the join, once per task and set.

    ``wanted`` is a map of keys; others are left out.
    """
    shared = documents.sparkSession.sparkContext.broadcast((order, wanted))

    def key_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, wanted = shared.value
        seen: set[int] = set()
        for batch in batches:
            keys, ids, sizes = [], [], []
            for text in batch.column("text"):
                shingles = shingle_set(text.as_py())
                if not len(shingles) or (digest := set_id(shingles)) in seen:
                    continue
                seen.add(digest)
                own = join_keys(shingles, order)
                if wanted is not None:
                    own = own[in_bit_map(wanted, own.view(np.int64))]
                keys.append(own)
                ids.append(np.full(len(own), digest))
                sizes.append(np.full(len(own), len(shingles)))
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [
                        _signed(np.concatenate(keys)),
                        pa.array(np.concatenate(ids), pa.int64()),
                        pa.array(np.concatenate(sizes), pa.int64()),
                    ],
                    ["key", "set_id", "n"],
                )

    return documents.select("text").mapInArrow(key_task, "key bigint, set_id bigint, n bigint")


def shared_keys(documents: DataFrame, order: Order) -> DataFrame:
    """``key, set_id, n`` where at least two different sets have the key, as a shared table."""
    found = (
        _key_rows(documents, order)
        .groupBy("key")
        .agg(F.min("set_id").alias("low"), F.max("set_id").alias("high"))
        .filter("low != high")
        .select("key")
    )
    shared = written(found, "shared_keys")
    # Keys are even hashes themselves.
    wanted = bit_map(shared, F.col("key"))
    # The map lets some other keys pass; the join drops them.
    rows = _key_rows(documents, order, wanted).distinct()
    return written(rows.join(shared, "key", "left_semi"), "key_members")


def node_bits(surveyed: DataFrame, nodes: DataFrame) -> DataFrame:
    """``set_id, bits`` of the nodes, as a shared table."""
    found = surveyed.filter("set_id is not null").select("set_id", "bits")
    wanted = nodes.select("set_id").distinct()
    return written(
        found.join(wanted, "set_id", "left_semi").groupBy("set_id").agg(F.min("bits").alias("bits")),
        "node_bits",
    )


def possible(pairs: DataFrame, bits: DataFrame) -> DataFrame:
    """Those of the pairs ``a, n_a, b, n_b`` that bit sketches allow to be alike.

    Returns ``a, b`` as a shared table.
    """
    both = pairs.join(bits.select(F.col("set_id").alias("a"), F.col("bits").alias("bits_a")), "a")
    both = both.join(bits.select(F.col("set_id").alias("b"), F.col("bits").alias("bits_b")), "b")

    def distance_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b, bits_a, bits_b = (batch.column(c).to_pylist() for c in range(2, 6))
            near = [
                7 * bit_distance(x, y) <= n + m for n, m, x, y in zip(n_a, n_b, bits_a, bits_b)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    columns = both.select("a", "b", "n_a", "n_b", "bits_a", "bits_b")
    return written(columns.mapInArrow(distance_task, "a bigint, b bigint"), "possible_pairs")


def node_sets(documents: DataFrame, surveyed: DataFrame, nodes: DataFrame) -> DataFrame:
    """``set_id, shingles`` of the nodes, the hashes as bytes, as a shared table.

    Every node is read from one of its texts, which a task finds by its hash.
    """
    texts = (
        surveyed.filter("set_id is not null")
        .groupBy("set_id")
        .agg(F.min("text_hash").alias("text_hash"))
        .join(nodes.select("set_id").distinct(), "set_id", "left_semi")
    )
    texts = written(texts, "node_texts")
    wanted = documents.sparkSession.sparkContext.broadcast(bit_map(texts, F.col("text_hash")))

    def set_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            rows = []
            hashes = batch.column("text_hash").to_numpy()
            for i in np.flatnonzero(in_bit_map(wanted.value, hashes)):
                if (text_hash := int(hashes[i])) not in seen:
                    seen.add(text_hash)
                    shingles = shingle_set(batch.column("text")[i].as_py())
                    if len(shingles):
                        rows.append((text_hash, set_id(shingles), shingles.tobytes()))
            if rows:
                types = (pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), types)],
                    ["text_hash", "set_id", "shingles"],
                )

    found = documents.select(_text_hash(), "text").mapInArrow(
        set_task, "text_hash bigint, set_id bigint, shingles binary"
    )
    exact = found.join(texts, ["text_hash", "set_id"], "left_semi")
    return written(exact.groupBy("set_id").agg(F.min("shingles").alias("shingles")), "node_sets")


def verified(documents: DataFrame, surveyed: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs ``a, b`` that are alike, with ``jaccard``, as a shared table."""
    nodes = pairs.select(F.col("a").alias("set_id")).union(pairs.select("b"))
    sets = node_sets(documents, surveyed, nodes)
    both = pairs.join(
        sets.select(F.col("set_id").alias("a"), F.col("shingles").alias("set_a")), "a"
    ).join(sets.select(F.col("set_id").alias("b"), F.col("shingles").alias("set_b")), "b")

    def verify_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a, b, set_a, set_b in zip(*(batch.column(c) for c in ("a", "b", "set_a", "set_b"))):
                left = np.frombuffer(set_a.as_py(), dtype=np.uint64)
                right = np.frombuffer(set_b.as_py(), dtype=np.uint64)
                common, union = overlap(left, right)
                if 100 * common >= 75 * union:
                    rows.append((a, b, common / union))
            if rows:
                a, b, jaccard = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a), pa.array(b), pa.array(jaccard)], ["a", "b", "jaccard"]
                )

    return written(both.mapInArrow(verify_task, "a bigint, b bigint, jaccard double"), "links")


def _tile_pairs(tile: pd.DataFrame) -> pd.DataFrame:
    """Pairs of a tile across components whose bit sketches allow them to be alike.

    ``bits`` are of ``c`` of a set's ``n`` shingles, and all that two sets have in common
    is among these. Rows of side 0 are compared with those of side 1, or with each other
    where the tile is on the diagonal and has side 0 alone. A pair that is seen to share
    an earlier group is left to that group.
    """
    key = tile["key"].iloc[0]
    earlier = np.full((len(tile), KNOWN_GROUPS), key)
    for i, known in enumerate(tile["known"]):
        earlier[i, : len(known)] = known
    tile = tile.assign(at=np.arange(len(tile)))
    left = tile[tile["side"] == 0]
    right = tile[tile["side"] == 1]
    right = left if right.empty else right
    size = min(map(len, tile["bits"]))
    bits = np.stack([folded(np.frombuffer(b, dtype=np.uint8), size) for b in right["bits"]])
    n_right, c_right = right["n"].to_numpy(), right["c"].to_numpy()
    ids, places, roots = right["set_id"].to_numpy(), right["at"].to_numpy(), right["root"].to_numpy()
    found = []
    for row in left.itertuples(index=False):
        most = 7 * (c_right + row.c) - 6 * (n_right + row.n)
        possible = (roots != row.root) & (4 * n_right >= 3 * row.n) & (3 * n_right <= 4 * row.n)
        at = np.flatnonzero(possible & (most >= 0))
        if len(at):
            own = folded(np.frombuffer(row.bits, dtype=np.uint8), size)
            distance = np.bitwise_count(bits[at] ^ own).sum(axis=1)
            at = at[7 * distance <= most[at]]
            before = earlier[row.at][earlier[row.at] < key]
            at = at[~np.isin(earlier[places[at]], before).any(axis=1)]
            for other, n in zip(ids[at].tolist(), n_right[at].tolist()):
                found.append(min((row.set_id, row.n, other, n), (other, n, row.set_id, row.n)))
    return pd.DataFrame(sorted(set(found)), columns=["a", "n_a", "b", "n_b"]).astype("int64")


def _groups(rows: DataFrame) -> DataFrame:
    """``key, members, least`` of the groups that have several components."""
    return (
        rows.groupBy("key")
        .agg(
            F.min("root").alias("low"),
            F.max("root").alias("high"),
            F.min("set_id").alias("least"),
            F.count("*").alias("members"),
        )
        .filter("low != high")
        .drop("low", "high")
    )


def _direct_pairs(rows: DataFrame) -> DataFrame:
    """Pairs ``a, n_a, b, n_b`` across components in small groups."""
    columns = ("set_id", "n", "root")
    small = rows.select("key", *columns)
    other = small.select("key", *(F.col(c).alias(f"{c}_2") for c in columns))
    return (
        small.join(other, "key")
        .filter("set_id < set_id_2 and root != root_2 and 4 * n >= 3 * n_2 and 4 * n_2 >= 3 * n")
        .select(
            F.col("set_id").alias("a"), F.col("n").alias("n_a"),
            F.col("set_id_2").alias("b"), F.col("n_2").alias("n_b"),
        )
    )


def _tiled_pairs(rows: DataFrame, bits: DataFrame) -> DataFrame:
    """Pairs as of ``_tile_pairs`` in groups ``key, set_id, n, c, root, members``.

    ``bits`` has a row ``set_id, bits`` for each set. Every member goes to the tiles of
    its row and column.
    """
    # No more than a set's own keys are gathered here, so that bit sketches are joined
    # once a set.
    sets = (
        rows.groupBy("set_id", "n", "c", "root")
        .agg(F.sort_array(F.collect_set(F.struct("key", "members"))).alias("groups"))
        .join(bits, "set_id")
        .withColumn("known", F.slice("groups.key", 1, KNOWN_GROUPS))
    )
    tiles = F.ceil(F.col("members") / TILE).cast("int")
    return (
        sets.select("set_id", "n", "c", "root", "bits", "known", F.inline("groups"))
        .withColumn("own", F.pmod(F.xxhash64("set_id"), tiles).cast("int"))
        .withColumn("with", F.explode(F.sequence(F.lit(0), tiles - 1)))
        .select(
            "key", "set_id", "n", "c", "root", "bits", "known",
            F.least("own", "with").alias("row"),
            F.greatest("own", "with").alias("column"),
            F.when(F.col("own") <= F.col("with"), 0).otherwise(1).alias("side"),
        )
        .groupBy("key", "row", "column")
        .applyInPandas(_tile_pairs, "a bigint, n_a bigint, b bigint, n_b bigint")
    )


def common_shingles(sets: DataFrame) -> np.ndarray:
    """Sorted shingles that very many of the sets have, bounded in number.

    Any choice is right; the more of a template are among them, the less is compared.
    """

    def count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []
        n_waiting = 0

        def often() -> pa.RecordBatch:
            seen, n = np.unique(np.concatenate(waiting), return_counts=True)
            waiting.clear()
            seen, n = seen[n >= REPORT_FROM], n[n >= REPORT_FROM]
            return pa.RecordBatch.from_arrays([_signed(seen), pa.array(n)], ["shingle", "n"])

        for batch in batches:
            for shingles in batch.column("shingles"):
                waiting.append(np.frombuffer(shingles.as_py(), dtype=np.uint64))
                n_waiting += len(waiting[-1])
                if n_waiting >= COUNT_AT_ONCE:
                    yield often()
                    n_waiting = 0
        if waiting:
            yield often()

    rows = (
        sets.select("shingles")
        .mapInArrow(count_task, "shingle bigint, n bigint")
        .groupBy("shingle")
        .agg(F.sum("n").alias("n"))
        .filter(F.col("n") >= COMMON_FROM)
        .orderBy(F.desc("n"), "shingle")
        .limit(COMMON_SKETCHES)
        .toArrow()
    )
    return np.sort(rows["shingle"].to_numpy().astype(np.int64).view(np.uint64))


def split_sets(sets: DataFrame, common: np.ndarray) -> DataFrame:
    """Sets by their own shingles and, if these are few, by their common ones.

    Rows with ``set_id, n, key``, a set's first own shingles, by value, up to one more
    than a quarter of the set. A set with fewer than these has a row without ``key``, and
    with ``c, part, bits``: number, digest and bit sketch of its common shingles.
    """
    shared = sets.sparkSession.sparkContext.broadcast(common)
    schema = "set_id bigint, n bigint, key bigint, c bigint, part bigint, bits binary"
    kinds = [pa.int64()] * 5 + [pa.binary()]

    def split_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, ids, sizes, heavy = [], [], [], []
            for digest, packed in zip(batch.column("set_id").to_pylist(), batch.column("shingles")):
                shingles = np.frombuffer(packed.as_py(), dtype=np.uint64)
                is_common = np.isin(shingles, common, assume_unique=True)
                n, needed = len(shingles), len(shingles) // 4 + 1
                own = shingles[~is_common][:needed]
                keys.append(own)
                ids.append(np.full(len(own), digest))
                sizes.append(np.full(len(own), n))
                if len(own) < needed:
                    part = shingles[is_common]
                    heavy.append((digest, n, None, len(part), set_id(part), bit_sketch(part)))
            columns = [np.concatenate(c) for c in (ids, sizes, [k.view(np.int64) for k in keys])]
            none = [pa.nulls(len(columns[0]), kind) for kind in kinds[3:]]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *none], NAMES)
            if heavy:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, kind) for c, kind in zip(zip(*heavy), kinds)], NAMES
                )

    return written(sets.select("set_id", "shingles").mapInArrow(split_task, schema), "split_sets")


NAMES = ["set_id", "n", "key", "c", "part", "bits"]


def _heavy_pairs(split: DataFrame, large: DataFrame) -> DataFrame:
    """Pairs of large groups that have nothing but common shingles in common.

    Sets of equal common parts are compared with the smallest of them: two of them that
    are alike by this part alone are alike to that one. The smallest of each part, and
    those that are not alike to it, are left to be compared across parts, as far as their
    part is large enough for any set of their group.
    """
    heavy = split.filter("key is null").drop("key")
    # Written, so that the join shuffles both sides and splits a large part.
    least = written(
        heavy.groupBy("part").agg(F.min(F.struct("n", "set_id")).alias("least")), "part_least"
    )
    held = heavy.join(least, "part").withColumns(
        {"is_least": F.col("set_id") == F.col("least.set_id"), "n_least": F.col("least.n")}
    )
    alike = F.expr("7 * c >= 3 * (n + n_least)")
    stars = held.filter(alike & ~F.col("is_least")).select(
        F.col("least.set_id").alias("a"), F.col("n_least").alias("n_a"),
        F.col("set_id").alias("b"), F.col("n").alias("n_b"),
    )
    # The smallest set of a part stands for it in all groups of the part's sets.
    columns = ("set_id", "n", "c", "root")
    of_part = large.select("key", "set_id", "root").join(held, "set_id")
    smallest_sets = held.filter("is_least").join(large.select("set_id", "root").distinct(), "set_id")
    parts = of_part.select("key", "part").distinct()
    rows = (
        of_part.filter(~alike & ~F.col("is_least"))
        .select("key", *columns)
        .union(parts.join(smallest_sets.select("part", *columns), "part").select("key", *columns))
    )
    smallest = rows.groupBy("key").agg(F.min("n").alias("smallest"))
    rows = written(rows.join(smallest, "key").filter("7 * c >= 3 * (n + smallest)"), "heavy_rows")
    bits = heavy.select("set_id", "bits")
    return stars.union(_tiled_pairs(rows.join(_groups(rows), "key"), bits))


def remaining_pairs(
    documents: DataFrame, surveyed: DataFrame, members: DataFrame, roots: DataFrame, bits: DataFrame
) -> DataFrame:
    """Pairs that share a key, are in different components and were not compared yet.

    Returns ``a, n_a, b, n_b``. ``members`` are ``key, set_id, n``; a key's least node was
    compared with all. Small groups are compared pair by pair, those of up to a tile as
    one. The sets of large groups meet again by single shingles, the rarer ones first: two
    that are alike share one of the first n / 4 + 1 of each. That is a shingle few sets
    have, or else they have only common shingles in common.
    """

    def with_roots(rows: DataFrame) -> DataFrame:
        return (
            rows.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left")
            .withColumn("root", F.coalesce("root", "set_id"))
            .select("key", "set_id", "n", "root")
        )

    placed = with_roots(members)
    groups = _groups(placed).filter("members > 2")
    open_rows = written(placed.join(groups, "key").filter("set_id != least"), "open_members")
    is_small, is_large = F.col("members") <= SMALL_GROUP, F.col("members") > TILE

    def tiled(rows: DataFrame) -> DataFrame:
        return _tiled_pairs(rows.withColumn("c", F.col("n")), bits)

    pairs = _direct_pairs(open_rows.filter(is_small)).union(tiled(open_rows.filter(~is_small & ~is_large)))
    large = open_rows.filter(is_large)
    if large.isEmpty():
        return pairs.distinct()
    sets = node_sets(documents, surveyed, large.select("set_id"))
    split = split_sets(sets, common_shingles(sets))
    own = with_roots(split.filter("key is not null").select("key", "set_id", "n"))
    own = written(own.join(_groups(own), "key"), "own_shingles")
    # Shingles of very many sets that are not among the common ones are left to tiles.
    pairs = pairs.union(_direct_pairs(own.filter(is_small))).union(tiled(own.filter(~is_small)))
    return pairs.union(_heavy_pairs(split, large)).distinct()


@dataclass
class NearDuplicates:
    """``members``: ``doc_id, text_hash, n_shingles, set_id, component`` of every document;
    documents of equal shingles have one ``set_id``; ``links``: ``a, b, jaccard`` between
    set ids, enough of them to connect every component."""

    members: DataFrame
    links: DataFrame


def near_duplicates(documents: DataFrame) -> NearDuplicates:
    surveyed = survey(documents)
    order = common_order(surveyed)
    members = shared_keys(documents, order)
    bits = node_bits(surveyed, members)

    least = members.groupBy("key").agg(F.min(F.struct("set_id", "n")).alias("least"))
    stars = (
        members.join(least, "key")
        .select(
            F.col("least.set_id").alias("a"), F.col("least.n").alias("n_a"),
            F.col("set_id").alias("b"), F.col("n").alias("n_b"),
        )
        .filter("a != b and 4 * n_a >= 3 * n_b and 4 * n_b >= 3 * n_a")
        .distinct()
    )
    star_links = verified(documents, surveyed, possible(stars, bits))
    rest = remaining_pairs(documents, surveyed, members, components(star_links), bits)
    links = star_links.union(verified(documents, surveyed, possible(rest, bits)))
    roots = components(links)
    documents_of = (
        surveyed.filter("sketch is null")
        .select("doc_id", "text_hash", "n_shingles", "set_id")
        .join(roots.withColumnRenamed("node", "set_id"), "set_id", "left")
        .select(
            "doc_id", "text_hash", "n_shingles", "set_id",
            F.coalesce("root", "set_id").alias("component"),
        )
    )
    return NearDuplicates(written(documents_of, "near_members"), links)


def _with_least_ids(found: NearDuplicates) -> DataFrame:
    """The members with ``component_id``, the least document id of their component."""
    members = found.members
    # Written, so that the join shuffles both sides and splits a large component.
    least = written(
        members.filter("component is not null")
        .groupBy("component")
        .agg(F.min("doc_id").alias("least_id")),
        "least_ids",
    )
    alone = F.col("component").isNull()
    return members.join(least, "component", "left").withColumn(
        "component_id", F.when(alone, F.col("doc_id")).otherwise(F.col("least_id"))
    )


def component_ids(found: NearDuplicates) -> DataFrame:
    """``doc_id, n_shingles, component_id``: the least document id of each component."""
    return _with_least_ids(found).select("doc_id", "n_shingles", "component_id")


def drop_near_copies(documents: DataFrame) -> DataFrame:
    """``documents`` with one of each component, the one with the least id.

    Documents without shingles stay, and so do all of a component without any id.
    Rows that repeat the id that stays with another text of its component stay too.
    """
    gone = (
        _with_least_ids(near_duplicates(documents))
        .filter("component_id is not null and not doc_id <=> component_id")
        .select(F.col("doc_id").alias("_gone_id"), F.col("text_hash").alias("_gone_text"))
        .distinct()
    )
    same = documents["doc_id"].eqNullSafe(F.col("_gone_id")) & (
        F.xxhash64(F.coalesce(documents["text"], F.lit(""))) == F.col("_gone_text")
    )
    return documents.join(gone, same, "left_anti")


ORACLE_SQL = """
    WITH RECURSIVE words AS MATERIALIZED (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
        FROM documents
    ), shingles AS MATERIALIZED (
        SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 5 THEN [w]
                   ELSE [w[i:i + 4] for i in range(1, len(w) - 3)] END) AS s
        FROM words WHERE len(w) > 0
    ), sizes AS MATERIALIZED (
        SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
    ), common AS (
        SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
        FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL
    ), links AS MATERIALIZED (
        SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
        WHERE 100 * c >= 75 * (x.n + y.n - c)
    ), reached AS (
        SELECT doc_id, doc_id AS other FROM sizes
        UNION
        SELECT doc_id, b FROM reached JOIN links ON a = other
    ), least AS (
        SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id
    )
    SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id
    FROM words LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)
"""
