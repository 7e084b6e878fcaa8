"""Benchmark passages in documents, by a distributed positional inverted index.

The index is split by documents. A task reads documents into segments of a bounded
number of words; each segment is one row with, for every term, the sorted list of
the places at which the term stands in the segment's documents. Segments need no
shuffle to build or to search, and no term, however common, gathers anywhere.

A phrase is found by intersecting its terms' lists, each moved back by the term's
offset in the phrase, from the term that is rarest in the whole corpus on; most
phrases end at the first list or two. A proximity match needs the rarest terms of
a window near each other, in any order.

The index stores all terms, whatever the benchmark, and serves any number of searches.
A benchmark is searched in blocks of a bounded number of words, so what is sent to the
tasks has a bound; each block reads the index once.

A-Z are lower-cased; a word is a run of other characters than the ASCII ones that
are neither letters nor digits. A null or empty text has no words. Documents are
told apart by their place in the index, so ids may be null or repeat. Items that
share an id count as one, and an item without id counts hits but is not listed.
Extra columns are ignored. An empty table gives no rows; without benchmark items
no document is hit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.llm.common import written

WINDOW_WORDS = 10
SEGMENT_WORDS = 1_000_000
# Words of benchmark items that are searched at once.
BLOCK_WORDS = 400_000
# Proximity: so many of a window's rarest terms, within so many words of the rarest.
NEAR_TERMS = 4
NEAR_WORDS = 16

# Empty places between documents, so that no match reaches from one to the next.
GAP = 64
SEGMENT_BITS = 32


def _word_bytes() -> bytes:
    """Table that lower-cases A-Z and turns every byte outside words into a space."""
    table = bytearray(b" " * 128 + bytes(range(128, 256)))
    for byte in b"0123456789abcdefghijklmnopqrstuvwxyz":
        table[byte] = byte
    for byte in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
        table[byte] = byte + 32
    return bytes(table)


WORD_BYTES = _word_bytes()


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_BYTES).split()


class _Segment:
    """Documents of one segment on their way into the index."""

    def __init__(self):
        self._terms: dict[bytes, int] = {}
        self._parts: list[np.ndarray] = []
        self.doc_ids: list = []
        self.starts: list[int] = []
        self.lengths: list[int] = []
        self.end = 0

    def add(self, doc_id, text: str | None) -> None:
        words = words_of(text)
        terms = self._terms
        numbers = [terms.setdefault(w, len(terms)) for w in words]
        self._parts.append(np.array(numbers, dtype=np.int32))
        self.doc_ids.append(doc_id)
        self.starts.append(self.end)
        self.lengths.append(len(words))
        self.end += len(words) + GAP

    def row(self) -> tuple:
        """``doc_ids, starts, lengths, terms, counts, places``."""
        starts = np.array(self.starts, dtype=np.int64)
        lengths = np.array(self.lengths, dtype=np.int64)
        ids = np.concatenate(self._parts)
        first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        places = (np.arange(len(ids)) + np.repeat(starts - first, lengths)).astype("<i4")
        order = np.argsort(ids, kind="stable")
        return (
            self.doc_ids,
            starts.astype("<i4").tobytes(),
            lengths.astype("<i4").tobytes(),
            list(self._terms),
            np.bincount(ids).astype("<i4").tobytes(),
            places[order].tobytes(),
        )


def build_index(documents: DataFrame, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """The index as a shared table with a row per segment.

    A document longer than a segment makes a segment of its own.
    """
    narrow = documents.select("doc_id", "text")
    id_type = narrow.schema["doc_id"].dataType.simpleString()
    schema = (
        f"segment bigint, doc_ids array<{id_type}>, starts binary, lengths binary, "
        "terms array<binary>, counts binary, places binary"
    )

    def index_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << SEGMENT_BITS
        segment = _Segment()
        id_arrow = pa.null()

        def to_batch() -> pa.RecordBatch:
            columns = [number, *segment.row()]
            types = [pa.int64(), pa.list_(id_arrow), pa.binary(), pa.binary()]
            types += [pa.list_(pa.binary()), pa.binary(), pa.binary()]
            names = ["segment", "doc_ids", "starts", "lengths", "terms", "counts", "places"]
            arrays = [pa.array([c], t) for c, t in zip(columns, types)]
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            id_arrow = batch.schema.field("doc_id").type
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                segment.add(doc_id.as_py(), text.as_py())
                if segment.end >= segment_words:
                    yield to_batch()
                    number += 1
                    segment = _Segment()
        if segment.doc_ids:
            yield to_batch()

    return written(narrow.mapInArrow(index_task, schema), "positional_index")


def indexed_documents(index: DataFrame) -> DataFrame:
    """``segment, ordinal, doc_id, n_words`` of every document in the index."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for segment, doc_ids, lengths in zip(*(batch.column(c) for c in range(3))):
                n = np.frombuffer(lengths.as_py(), dtype="<i4").astype(np.int64)
                ordinals = np.arange(len(n), dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(n), segment.as_py(), dtype=np.int64)),
                        pa.array(ordinals),
                        doc_ids.values,
                        pa.array(n),
                    ],
                    ["segment", "ordinal", "doc_id", "n_words"],
                )

    id_type = index.schema["doc_ids"].dataType.elementType.simpleString()
    return index.select("segment", "doc_ids", "lengths").mapInArrow(
        unpack, f"segment bigint, ordinal int, doc_id {id_type}, n_words bigint"
    )


@dataclass
class Block:
    """Benchmark items that are searched together: their distinct windows."""

    items: list = field(default_factory=list)
    n_words: int = 0

    def add(self, item_id, words: list[bytes]) -> None:
        self.items.append((item_id, words))
        self.n_words += len(words)

    def terms(self) -> set[bytes]:
        return {word for _, words in self.items for word in words}

    def windows(self, size: int) -> dict[tuple[bytes, ...], list[int]]:
        """Window -> positions in ``items`` of the items that hold it."""
        found: dict[tuple[bytes, ...], list[int]] = {}
        for number, (_, words) in enumerate(self.items):
            for at in range(max(1, len(words) - size + 1)) if words else ():
                holders = found.setdefault(tuple(words[at : at + size]), [])
                if not holders or holders[-1] != number:
                    holders.append(number)
        return found


def blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[Block]:
    """The benchmark in blocks, read one partition at a time; at least one block."""
    block, any_yet = Block(), False
    for row in benchmark.select("item_id", "text").toLocalIterator():
        block.add(row["item_id"], words_of(row["text"]))
        if block.n_words >= block_words:
            yield block
            block, any_yet = Block(), True
    if block.items or not any_yet:
        yield block


def term_counts(index: DataFrame, terms: set[bytes]) -> dict[bytes, int]:
    """How often each of the terms stands in the corpus, if it does."""
    shared = index.sparkSession.sparkContext.broadcast(terms)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[bytes, int] = {}
        for batch in batches:
            for names, each in zip(batch.column(0), batch.column(1)):
                for term, n in zip(names.as_py(), np.frombuffer(each.as_py(), dtype="<i4")):
                    if term in shared.value:
                        totals[term] = totals.get(term, 0) + int(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(totals.keys(), pa.binary()), pa.array(totals.values(), pa.int64())],
            ["term", "n"],
        )

    rows = (
        index.select("terms", "counts")
        .mapInArrow(counts, "term binary, n bigint")
        .groupBy("term")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    return {bytes(row["term"]): row["n"] for row in rows}


@dataclass
class Query:
    """Windows of a block as rows of term numbers, each with its order of search."""

    terms: dict[bytes, int]
    windows: np.ndarray  # term numbers by offset, -1 behind a short window's end
    order: np.ndarray  # offsets, those of the rarest terms first
    lengths: np.ndarray
    holders: list[list[int]]
    item_ids: list

    @staticmethod
    def of(block: Block, counts: dict[bytes, int], size: int) -> Query:
        found = block.windows(size)
        terms = {t: i for i, t in enumerate(sorted(block.terms()))}
        rarity = np.array([counts.get(t, 0) for t in terms] + [1 << 62], dtype=np.int64)
        windows = np.full((len(found), size), -1, dtype=np.int64)
        for row, words in enumerate(found):
            windows[row, : len(words)] = [terms[w] for w in words]
        return Query(
            terms,
            windows,
            np.argsort(rarity[windows], axis=1, kind="stable"),
            (windows >= 0).sum(axis=1),
            list(found.values()),
            [item_id for item_id, _ in block.items],
        )

    def lists(self, names: list[bytes], counts: np.ndarray, places: np.ndarray) -> list:
        """Places of each query term in a segment, None if it is not there."""
        ends = np.cumsum(counts)
        lists: list = [None] * (len(self.terms) + 1)
        for name, low, high in zip(names, ends - counts, ends):
            if (t := self.terms.get(name)) is not None:
                lists[t] = places[low:high]
        return lists

    def possible(self, lists: list, terms: np.ndarray) -> np.ndarray:
        """Windows all of whose ``terms`` are in the segment."""
        present = np.array([x is not None for x in lists[:-1]] + [True])
        return np.flatnonzero(present[terms].all(axis=1))

    def rarest(self, n_terms: int) -> np.ndarray:
        """The distinct rarest terms of each window, -1 where there are fewer."""
        chosen = np.full((len(self.windows), n_terms), -1, dtype=np.int64)
        for row in range(len(chosen)):
            terms = self.windows[row, self.order[row, : self.lengths[row]]].tolist()
            own = list(dict.fromkeys(terms))[:n_terms]
            chosen[row, : len(own)] = own
        return chosen

    def phrase(self, window: int, lists: list) -> np.ndarray:
        """Places at which a window's words stand in a row."""
        terms, order = self.windows[window], self.order[window, : self.lengths[window]]
        starts = lists[terms[order[0]]] - order[0]
        for offset in order[1:]:
            if not len(starts):
                break
            places = lists[terms[offset]]
            wanted = starts + offset
            at = np.minimum(np.searchsorted(places, wanted), len(places) - 1)
            starts = starts[places[at] == wanted]
        return starts

    def near(self, window: int, lists: list, chosen: np.ndarray, n_words: int) -> tuple:
        """First and last place of groups of chosen terms near the first of them.

        Where the window itself stands as a phrase is left out.
        """
        anchors = lists[chosen[0]]
        whole = all(lists[t] is not None for t in self.windows[window, : self.lengths[window]])
        starts = self.phrase(window, lists) if whole else anchors[:0]
        if len(starts):
            at = np.maximum(np.searchsorted(starts, anchors, side="right") - 1, 0)
            apart = (anchors < starts[at]) | (anchors >= starts[at] + self.lengths[window])
            anchors = anchors[apart]
        first, last = anchors.copy(), anchors.copy()
        for term in chosen[1:][chosen[1:] >= 0]:
            places = lists[term]
            at = np.searchsorted(places, anchors)
            after = places[np.minimum(at, len(places) - 1)]
            before = places[np.maximum(at - 1, 0)]
            nearest = np.where(np.abs(after - anchors) < np.abs(before - anchors), after, before)
            ok = np.abs(nearest - anchors) <= n_words
            anchors, nearest = anchors[ok], nearest[ok]
            first = np.minimum(first[ok], nearest)
            last = np.maximum(last[ok], nearest)
        return first, last


def _runs(items: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple:
    """Spans of each item that overlap or touch, joined."""
    order = np.lexsort((high, low, items))
    items, low, high = items[order], low[order], high[order]
    # Ends so far, item by item: an offset keeps the items apart.
    shift = items * (1 << 33)
    reach = np.maximum.accumulate(high + shift)
    new = np.ones(len(items), dtype=bool)
    new[1:] = low[1:] + shift[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(items)])) - 1
    return items[first], low[first], reach[last] - shift[last]


def search(
    index: DataFrame,
    block: Block,
    item_type: str,
    window_words: int = WINDOW_WORDS,
    near_terms: int = 0,
    near_words: int = NEAR_WORDS,
) -> DataFrame:
    """Matches of a block: ``segment, ordinal, item_id, kind, start, end``.

    ``start`` and ``end`` are word numbers in the document. Windows of an item that
    match one after the other are one row of kind ``phrase``. With ``near_terms``,
    places where so many of a window's rarest terms are near each other, but not the
    window itself, add rows of kind ``proximity``.
    """
    query = Query.of(block, term_counts(index, block.terms()), window_words)
    shared = index.sparkSession.sparkContext.broadcast(query)

    def spans(rarest, names, counts, places) -> Iterator[tuple]:
        query = shared.value
        lists = query.lists(names, counts, places)
        for window in query.possible(lists, query.windows):
            starts = query.phrase(window, lists).astype(np.int64)
            for item in query.holders[window] if len(starts) else ():
                yield "phrase", item, starts, starts + query.lengths[window]
        for window in query.possible(lists, rarest) if near_terms else ():
            first, last = query.near(window, lists, rarest[window], near_words)
            for item in query.holders[window] if len(first) else ():
                yield "proximity", item, first.astype(np.int64), last.astype(np.int64) + 1

    def search_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item_ids = pa.array(shared.value.item_ids)
        rarest = shared.value.rarest(near_terms) if near_terms else None
        for batch in batches:
            for segment, starts, names, counts, places in zip(*(batch.column(c) for c in range(5))):
                starts = np.frombuffer(starts.as_py(), dtype="<i4").astype(np.int64)
                by_kind: dict[str, list] = {}
                found = spans(
                    rarest,
                    names.as_py(),
                    np.frombuffer(counts.as_py(), dtype="<i4"),
                    np.frombuffer(places.as_py(), dtype="<i4"),
                )
                for kind, item, low, high in found:
                    by_kind.setdefault(kind, []).append((np.full(len(low), item), low, high))
                for kind, parts in by_kind.items():
                    item, low, high = _runs(*(np.concatenate(p) for p in zip(*parts)))
                    ordinal = np.searchsorted(starts, low, side="right") - 1
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(item), segment.as_py(), dtype=np.int64)),
                            pa.array(ordinal.astype(np.int32)),
                            item_ids.take(pa.array(item)),
                            pa.array([kind] * len(item)),
                            pa.array((low - starts[ordinal]).astype(np.int32)),
                            pa.array((high - starts[ordinal]).astype(np.int32)),
                        ],
                        ["segment", "ordinal", "item_id", "kind", "start", "end"],
                    )

    return index.select("segment", "starts", "terms", "counts", "places").mapInArrow(
        search_task,
        f"segment bigint, ordinal int, item_id {item_type}, kind string, start int, end int",
    )


def find(
    documents: DataFrame,
    benchmark: DataFrame,
    window_words: int = WINDOW_WORDS,
    near_terms: int = 0,
    near_words: int = NEAR_WORDS,
    block_words: int = BLOCK_WORDS,
    segment_words: int = SEGMENT_WORDS,
) -> tuple[DataFrame, DataFrame]:
    """All indexed documents, and all matches with the benchmark.

    The first is ``segment, ordinal, doc_id, n_words``, the second as of
    :func:`search`; a document has the same segment and ordinal in both.
    """
    item_type = benchmark.schema["item_id"].dataType.simpleString()
    index = build_index(documents, segment_words)
    matches = None
    for block in blocks(benchmark, block_words):
        found = search(index, block, item_type, window_words, near_terms, near_words)
        matches = matches.unionByName(found) if matches else found
    return indexed_documents(index), matches


def contamination(documents: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """Per document how much of it lies in benchmark windows that it repeats exactly.

    Returns ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``.
    """
    indexed, matches = find(documents, benchmark, **settings)
    phrases = matches.filter(F.col("kind") == "phrase").drop("kind")
    by_start = Window.partitionBy("segment", "ordinal").orderBy("start", "end")
    reach = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    covered = F.greatest(F.col("end") - F.greatest("start", F.coalesce(reach, F.lit(0))), F.lit(0))
    hits = (
        phrases.withColumn("covered", covered)
        .groupBy("segment", "ordinal")
        .agg(
            F.sum("covered").cast("bigint").alias("n_hit"),
            F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"),
        )
    )
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return indexed.join(hits, ["segment", "ordinal"], "left").select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
        F.sha2(F.coalesce(F.concat_ws(",", "items"), F.lit("")).cast("binary"), 256).alias(
            "items_sha256"
        ),
        (n_hit > 0).alias("contaminated"),
    )


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """``documents`` without those that repeat a benchmark window."""
    # Texts tell documents apart whose ids are equal or null.
    text_hash = F.xxhash64(F.coalesce(documents["text"], F.lit("")))
    keyed = documents.select(
        F.struct("doc_id", text_hash.alias("text_hash")).alias("doc_id"), "text"
    )
    gone = (
        contamination(keyed, benchmark, **settings)
        .filter("contaminated")
        .select(
            F.col("doc_id.doc_id").alias("_gone_id"), F.col("doc_id.text_hash").alias("_gone_text")
        )
        .distinct()
    )
    same = documents["doc_id"].eqNullSafe(F.col("_gone_id")) & (text_hash == F.col("_gone_text"))
    return documents.join(gone, same, "left_anti")


ORACLE_SQL = """
    WITH item_words AS (
        SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
        FROM benchmark WHERE text IS NOT NULL
    ), windows AS (
        SELECT DISTINCT item_id, unnest(CASE WHEN len(w) <= 10 THEN [w]
                   ELSE [w[i:i + 9] for i in range(1, len(w) - 8)] END) AS win
        FROM item_words WHERE len(w) > 0
    ), doc_words AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
        FROM documents
    ), sizes AS (
        SELECT DISTINCT len(win) AS k FROM windows
    ), places AS (
        SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p
        FROM doc_words, sizes WHERE len(w) >= k
    ), hits AS (
        SELECT doc_id, item_id, p, k FROM places JOIN windows ON win = w[p:p + k - 1]
    ), hit_words AS (
        SELECT doc_id, count(DISTINCT q) AS n_hit
        FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hits) GROUP BY doc_id
    ), hit_items AS (
        SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
    )
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
           coalesce(n_hit, 0) AS n_hit,
           coalesce(n_items, 0) AS n_items,
           sha256(coalesce(items, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AS contaminated
    FROM doc_words LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""
