"""Repeated passages across documents, by content-defined chunks.

A gear hash rolls over the bytes of a text: each byte shifts the hash by one bit and
adds a random number of its own, so it depends on the last 16 bytes. A chunk ends after
white space where the hash is low, so chunks have about as many words whether these are
long or short; in writing without white space it ends where the leading bits are zero.
Cuts thus follow the content: a passage is cut in the
same way wherever it stands, but for a few bytes at its ends, and what is inserted
before it moves nothing. Chunks are short against the passages looked for; they are
counted in pairs of neighbours, told apart by a 64-bit digest, so that chunks which
repeat each in another place make no passage. A chunk that has a passage's words alone
counts by itself as well. A passage is a run of overlapping units, pairs or such
chunks, which each occur twice or more in all documents, and has a number of words that
no chance agreement of digests reaches.

1. Every task counts its units' digests; counts are added up by digest. A hot unit
   costs a row per task.
2. A bit map of fixed size marks the digests seen twice. A second scan keeps the runs
   of marked units that are long enough. The map may mark a unit wrongly, never miss
   one.
3. Units are joined with the digests seen twice, and runs formed again of those that
   are among them. The map thus saves work and decides nothing.
4. Units in runs learn where such units occur first, in the order of document ids.

Offsets are in bytes of UTF-8 and lie between characters. Null and empty texts have no
chunk. Repeated rows are documents of their own, so they repeat each other; a null id
comes after all others. Extra columns are ignored. An empty table gives no runs.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tallyforge.llm.common import written
from tallyforge.llm.jaccard_join import bit_map, in_bit_map

# After white space a cut where the hash is below this, one in 3 places.
CUT_BELOW = (1 << 16) // 3
# So many bytes without white space are cut where so many leading bits are zero, one in
# 16 places.
BARE_BYTES = 16
CUT_BITS = 4
# Of the 16 values of these bits so many make a lesser cut.
LESSER = 4
LEAST_BYTES = 6
MOST_BYTES = 64
# Longer stretches without white space count as more than one word.
WORD_BYTES = 12
# Words in a run that make it a passage, and words in it and so many bytes before and
# after. A passage of 51 words keeps 26 or more of them between its first and its last
# cut, 15 or more if they have a letter each.
LEAST_WORDS = 15
LEAST_NEAR = 45
NEAR_BYTES = 48
COUNT_AT_ONCE = 1 << 22
TASK_BITS = 33

_GEAR = np.random.default_rng(20240229).integers(0, 1 << 16, 256).astype(np.uint16)
_SPACES = np.zeros(256, dtype=bool)
_SPACES[list(b" \t\n\r\v\f")] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xC4CEB9FE1A85EC53)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The rolling hash at every byte, over the last 16 bytes.

    Sums over 1, 2, 4 and 8 bytes are put together to sums over twice as many.
    """
    h = _GEAR[data]
    width = 1
    while width < 16 and width < len(data):
        longer = h.copy()
        longer[width:] += h[:-width] << np.uint16(width)
        h, width = longer, 2 * width
    return h


def chunk_ends(data: np.ndarray) -> np.ndarray:
    """Ends of the chunks of a text, ascending; the last is its length."""
    n = len(data)
    if not n:
        return np.zeros(0, dtype=np.int64)
    hashes = gear_hashes(data)
    spaces = np.flatnonzero(_SPACES[data])
    leading = hashes >> np.uint16(16 - CUT_BITS)
    places = spaces[hashes[spaces] < CUT_BELOW] + 1
    starts, lengths = _stretches(spaces, n)
    bare = lengths >= BARE_BYTES
    if bare.any():
        zeros = np.flatnonzero(leading == 0)
        at = np.searchsorted(starts[bare], zeros, side="right") - 1
        within = zeros - starts[bare][at]
        zeros = zeros[(at >= 0) & (within >= BARE_BYTES - 1) & (within < lengths[bare][at])]
        places = np.sort(np.concatenate((places, zeros + 1)))
    # A chunk ends before the first byte of a character.
    starts_character = np.append((data & 0xC0) != 0x80, True)
    cuts = places[starts_character[places]].tolist()

    # Where no cut comes in time, the last of the lesser ones before is taken, so that
    # long chunks follow the content as well.
    lesser = None
    ends, last = [], 0
    for cut in [*cuts, n]:
        while cut - last > MOST_BYTES:
            if lesser is None:
                lesser = np.flatnonzero(leading < LESSER) + 1
                lesser = lesser[starts_character[lesser]].tolist()
            at = bisect_right(lesser, last + MOST_BYTES) - 1
            forced = lesser[at] if at >= 0 else 0
            if forced - last < LEAST_BYTES:
                forced = last + MOST_BYTES
                while not starts_character[forced]:
                    forced += 1
            if forced >= cut:
                break
            ends.append(forced)
            last = forced
        if cut - last >= LEAST_BYTES or cut == n > last:
            ends.append(cut)
            last = cut
    return np.array(ends, dtype=np.int64)


def digests(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A signed 64-bit digest of each chunk.

    Bytes are spread to 64 bits by their value and their place in the chunk, and added.
    """
    starts = np.concatenate(([0], ends[:-1]))
    place = np.arange(len(data)) - np.repeat(starts, ends - starts)
    spread = (data.astype(np.uint64) + np.uint64(1)) * _POWERS[place]
    spread = (spread ^ (spread >> np.uint64(29))) * _MIX
    sums = np.add.reduceat(spread ^ (spread >> np.uint64(32)), starts)
    return ((sums ^ (sums >> np.uint64(31))) * _BASE).view(np.int64)


# An odd multiplier for each place in a chunk; a chunk may end 3 bytes late.
_POWERS = np.random.default_rng(7).integers(0, 1 << 63, MOST_BYTES + 4).astype(
    np.uint64
) * np.uint64(2) + np.uint64(1)


def _stretches(spaces: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the stretches of ``n`` bytes without white space."""
    edges = np.concatenate(([-1], spaces, [n]))
    lengths = np.diff(edges) - 1
    filled = lengths > 0
    return edges[:-1][filled] + 1, lengths[filled]


def word_starts(data: np.ndarray) -> np.ndarray:
    """Where words begin, ascending; a word begins anew every ``WORD_BYTES`` bytes."""
    starts, lengths = _stretches(np.flatnonzero(_SPACES[data]), len(data))
    more = (lengths - 1) // WORD_BYTES
    long = np.flatnonzero(more)
    if not len(long):
        return starts
    more = more[long]
    first = np.repeat(np.cumsum(more) - more, more)
    within = np.arange(len(first)) - first + 1
    return np.sort(np.concatenate((starts, np.repeat(starts[long], more) + WORD_BYTES * within)))


def _bytes_of(text) -> np.ndarray:
    return np.frombuffer((text.as_py() or "").encode(), dtype=np.uint8)


def repeated_digests(documents: DataFrame) -> DataFrame:
    """``digest`` of units that occur twice or more in all documents."""

    def count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []
        n_waiting = 0

        def counted() -> pa.RecordBatch:
            seen, n = np.unique(np.concatenate(waiting), return_counts=True)
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array(seen), pa.array(n)], ["digest", "n"])

        for batch in batches:
            for text in batch.column("text"):
                data = _bytes_of(text)
                if len(data):
                    waiting.append(units(data, chunk_ends(data), word_starts(data))[0])
                    n_waiting += len(waiting[-1])
                if n_waiting >= COUNT_AT_ONCE:
                    yield counted()
                    n_waiting = 0
        if waiting:
            yield counted()

    return (
        documents.select("text")
        .mapInArrow(count_task, "digest bigint, n bigint")
        .groupBy("digest")
        .agg(F.sum("n").alias("n"))
        .filter("n > 1")
        .select("digest")
    )


def units(data: np.ndarray, ends: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, ...]:
    """What is counted of a text: ``digest, first, last``, by first and last chunk.

    These are the pairs of neighbouring chunks, and chunks that have words enough alone.
    ``words`` is where these begin.
    """
    own, n = digests(data, ends).view(np.uint64), len(ends)
    pairs = (own[:-1] * _MIX) ^ (own[1:] + _BASE)
    pairs = (pairs ^ (pairs >> np.uint64(32))) * _BASE
    alone = np.flatnonzero(np.diff(np.searchsorted(words, ends), prepend=0) >= LEAST_WORDS)
    first = np.concatenate((np.arange(n - 1), alone))
    last = np.concatenate((np.arange(1, n), alone))
    digest = np.concatenate((pairs, own[alone])).view(np.int64)
    order = np.lexsort((last, first))
    return digest[order], first[order], last[order]


def _long_runs(
    first: np.ndarray, last: np.ndarray, inside: np.ndarray, near: np.ndarray, least_near: int
) -> np.ndarray:
    """Which units, in order, lie in runs of overlapping units with enough words.

    ``inside`` has how many words begin before each chunk, in two rows for the chunk as
    a unit's first and last, ``near`` the same with the bytes near it.
    """
    if not len(first):
        return np.zeros(0, dtype=bool)
    reach = np.maximum.accumulate(last)
    begins = np.flatnonzero(np.concatenate(([True], first[1:] > reach[:-1])))
    stops = np.append(begins[1:], len(first))
    low, high = first[begins], reach[stops - 1]
    enough = inside[1, high] - inside[0, low] >= LEAST_WORDS
    enough &= near[1, high] - near[0, low] >= least_near
    return np.repeat(enough, stops - begins)


def candidates(
    documents: DataFrame, repeated: DataFrame, least_near: int = LEAST_NEAR
) -> DataFrame:
    """Units in runs that may repeat, with their chunks, bytes and words before them.

    ``row_id, doc_id, digest, first, last, start, end, words_before, words_to,
    near_before, near_to``; the last two count words up to the bytes near the unit.
    ``row_id`` tells documents apart whose ids are equal or null. ``repeated`` has the
    digests that repeat; the map of them lets others through, which are to be left out.
    """
    wanted = documents.sparkSession.sparkContext.broadcast(bit_map(repeated, F.col("digest")))
    narrow = documents.select("doc_id", "text")
    schema = T.StructType().add("row_id", "long").add(narrow.schema["doc_id"]).add("digest", "long")
    for name in UNIT_COLUMNS:
        schema = schema.add(name, "long")

    def candidate_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row_id = TaskContext.get().partitionId() << TASK_BITS
        for batch in batches:
            parts, ordinals = [], []
            for ordinal, text in enumerate(batch.column("text")):
                data = _bytes_of(text)
                if not len(data):
                    continue
                ends, words = chunk_ends(data), word_starts(data)
                own, first, last = units(data, ends, words)
                at = np.flatnonzero(in_bit_map(wanted.value, own))
                if not len(at):
                    continue
                starts = np.concatenate(([0], ends[:-1]))
                inside = np.searchsorted(words, np.stack((starts, ends)))
                near = np.searchsorted(words, np.stack((starts - NEAR_BYTES, ends + NEAR_BYTES)))
                at = at[_long_runs(first[at], last[at], inside, near, least_near)]
                if len(at):
                    first, last = first[at], last[at]
                    parts.append(
                        (
                            own[at], first, last, starts[first], ends[last],
                            inside[0, first], inside[1, last], near[0, first], near[1, last],
                        )
                    )
                    ordinals.append(np.full(len(at), ordinal))
            if parts:
                ordinal = np.concatenate(ordinals)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ordinal + row_id, pa.int64()),
                        batch.column("doc_id").take(pa.array(ordinal)),
                        *(pa.array(np.concatenate(c), pa.int64()) for c in zip(*parts)),
                    ],
                    schema.names,
                )
            row_id += batch.num_rows

    return narrow.mapInArrow(candidate_task, schema)


UNIT_COLUMNS = (
    "first", "last", "start", "end", "words_before", "words_to", "near_before", "near_to"
)


def _place() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id", "first", "last")


def repeated_units(documents: DataFrame, least_near: int = LEAST_NEAR) -> DataFrame:
    """Units in repeated passages, with their run and where they occur first.

    The columns of ``candidates`` without ``digest`` and those on what is near, and
    ``run, first_doc_id, is_first``; ``run`` is the first chunk of the unit's run.
    """
    # Written, so that the joins shuffle both sides and split a hot digest.
    repeated = written(repeated_digests(documents), "repeated_digests")
    exact = candidates(documents, repeated, least_near).join(repeated, "digest", "left_semi")
    # One document's units, which are no more than its text has.
    in_order = Window.partitionBy("row_id").orderBy("first", "last")
    reach = F.max("last").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.coalesce(F.col("first") > reach, F.lit(True))
    runs = exact.withColumn("begin", F.when(begins, F.col("first"))).withColumn(
        "run", F.last("begin", ignorenulls=True).over(in_order)
    )
    in_run = Window.partitionBy("row_id", "run")

    def words_of(to: str, before: str) -> Column:
        return F.max(to).over(in_run) - F.min(before).over(in_run)

    runs = runs.withColumns(
        {
            "run_words": words_of("words_to", "words_before"),
            "run_near": words_of("near_to", "near_before"),
        }
    ).filter((F.col("run_words") >= LEAST_WORDS) & (F.col("run_near") >= least_near))
    unused = ("begin", "run_words", "run_near", "near_to", "near_before")
    runs = written(runs.drop(*unused), "repeated_units")
    firsts = written(runs.groupBy("digest").agg(F.min(_place()).alias("least")), "unit_firsts")
    is_first = (F.col("least.row_id") == F.col("row_id")) & (F.col("least.first") == F.col("first"))
    return (
        runs.join(firsts, "digest")
        .withColumn("first_doc_id", F.col("least.doc_id"))
        .withColumn("is_first", is_first & (F.col("least.last") == F.col("last")))
        .drop("digest", "least")
    )


def passages(documents: DataFrame, least_near: int = LEAST_NEAR) -> DataFrame:
    """Repeated passages: ``doc_id, start, end, n_words, n_chunks, n_later, first_doc_id, kept``.

    A row for each run of overlapping repeated units in a document that has
    ``least_near`` words with those near it, so documents without one have no row. ``n_later`` counts chunks in units that occurred in a passage
    before; ``kept`` is whether none did; ``first_doc_id`` is the first document that
    any of the units is in.
    """
    in_order = Window.partitionBy("row_id", "run").orderBy("first", "last")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    later = ~F.col("is_first")
    # Chunks that the later units before do not have.
    reach = F.coalesce(F.max(F.when(later, F.col("last"))).over(before), F.lit(-1))
    more = F.greatest(F.col("last") - F.greatest(F.col("first") - 1, reach), F.lit(0))
    return (
        repeated_units(documents, least_near)
        .withColumn("more", F.when(later, more).otherwise(F.lit(0)))
        .groupBy("row_id", "doc_id", "run")
        .agg(
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            (F.max("words_to") - F.min("words_before")).alias("n_words"),
            (F.max("last") - F.col("run") + 1).alias("n_chunks"),
            F.sum("more").alias("n_later"),
            F.min("first_doc_id").alias("first_doc_id"),
        )
        .select(
            "doc_id", "start", "end", "n_words", "n_chunks", "n_later", "first_doc_id",
            (F.col("n_later") == 0).alias("kept"),
        )
    )


def drop_repeats(documents: DataFrame, least_near: int = LEAST_NEAR) -> DataFrame:
    """``documents`` with each repeated passage left where it occurs first.

    ``doc_id`` must be unique and not null.
    """
    later = (
        repeated_units(documents, least_near)
        .filter("not is_first")
        .groupBy("doc_id")
        .agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_gone"))
    )
    schema = documents.schema
    later = later.withColumnRenamed("doc_id", "_gone_id")
    # Rows go through the join as one column, so that no name can clash.
    rows = documents.select(F.struct(*schema.names).alias("_row"))
    wide = rows.join(later, F.col("_row.doc_id") == F.col("_gone_id"), "left")
    wide = wide.select("_gone", "_row")
    text_at = schema.names.index("text")

    def cut_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, columns = [], batch.column(1).flatten()
            for text, gone in zip(columns[text_at], batch.column(0)):
                if gone.is_valid:
                    data, kept, at = text.as_py().encode(), [], 0
                    for span in gone.as_py():
                        kept.append(data[at : span["start"]])
                        at = max(at, span["end"])
                    kept.append(data[at:])
                    texts.append(b"".join(kept).decode())
                else:
                    texts.append(text.as_py())
            columns[text_at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return wide.mapInArrow(cut_task, schema)
