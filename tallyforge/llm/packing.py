"""Hierarchical packing of documents into sequences of several lengths.

A document's tokens are cut into full windows of the longest tier; what remains is
routed to the shortest tier that holds it. Tiers are packed from long to short:
every piece opens a window of its tier, and the gap behind it is filled with the
longest pieces of shorter tiers that fit. The last bit of a gap is filled by
cutting a shorter piece, whose rest is routed anew. So every window is full and
nothing is padded: all tiers are powers of two, and the few tokens that a task has
over in the end go to windows of smaller powers of two.

Each task packs the documents it reads, in flushes of a bounded number of tokens;
no token crosses the network. The windows of a flush are dealt into step groups of
equal token counts, the largest windows first, each to the group that has least.

A null or empty text has no ids of its own and takes one place for the id that
ends a document. Repeated rows are packed as often as they occur. An empty table
gives no pieces. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tallyforge.llm.tokens import ID_BYTES, TextIds

TIERS = (512, 1024, 2048, 4096)
END_ID = 2
FLUSH_TOKENS = 1 << 20
STEP_TOKENS = 8 * 4096
# Sequences and steps that one task may number.
TASK_BITS = 36

PIECE_COLUMNS = (
    "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
    "offset bigint, window int, step_id bigint"
)


class Pool:
    """Pieces that wait for a window, by length: ``(length, number, start, document)``."""

    def __init__(self, tiers: tuple[int, ...]):
        self._tiers = tiers
        self._waiting: list[list[tuple]] = [[] for _ in tiers]
        self._number = 0
        self.tokens = 0

    def add(self, document: tuple, start: int, length: int) -> None:
        self._number += 1
        tier = bisect_left(self._tiers, length)
        insort(self._waiting[tier], (length, self._number, start, document))
        self.tokens += length

    def _take(self, tier: int, at: int) -> tuple:
        piece = self._waiting[tier].pop(at)
        self.tokens -= piece[0]
        return piece

    def longest_of(self, tier: int) -> tuple | None:
        return self._take(tier, -1) if self._waiting[tier] else None

    def longest_within(self, tier: int, length: int) -> tuple | None:
        """The longest piece of this tier or a shorter one that is no longer than ``length``."""
        for t in range(tier, -1, -1):
            at = bisect_right(self._waiting[t], (length, self._number + 1))
            if at:
                return self._take(t, at - 1)
        return None

    def cut(self, tier: int, length: int) -> tuple | None:
        """The first ``length`` tokens of the shortest longer piece, up to this tier."""
        for t in range(tier + 1):
            at = bisect_right(self._waiting[t], (length, self._number + 1))
            if at < len(self._waiting[t]):
                size, number, start, document = self._take(t, at)
                self.add(document, start + length, size - length)
                return length, number, start, document
        return None


def _fill(pool: Pool, tier: int, window: int, pieces: list[tuple]) -> list[tuple]:
    gap = window - sum(p[0] for p in pieces)
    while gap:
        below = max(tier - 1, 0)
        piece = pool.longest_within(below, gap) or pool.cut(below, gap)
        piece = piece or pool.longest_within(tier, gap) or pool.cut(tier, gap)
        if piece is None:
            # Only longer tiers are left to take from.
            piece = pool.cut(len(TIERS) - 1, gap)
        pieces.append(piece)
        gap -= piece[0]
    return pieces


def pack_pool(pool: Pool, tiers: tuple[int, ...], last: bool) -> list[tuple[int, list[tuple]]]:
    """Full windows ``(size, pieces)`` from the pool; less than the shortest tier stays.

    The last call leaves nothing: the rest goes to windows of smaller powers of two.
    """
    windows = []
    for tier in range(len(tiers) - 1, -1, -1):
        while pool.tokens >= tiers[tier] and (piece := pool.longest_of(tier)):
            windows.append((tiers[tier], _fill(pool, tier, tiers[tier], [piece])))
    # Pieces of long tiers may be left where the pool ran below their window.
    for tier in range(len(tiers) - 1, -1, -1):
        while pool.tokens >= tiers[tier]:
            windows.append((tiers[tier], _fill(pool, len(tiers) - 1, tiers[tier], [])))
    while last and pool.tokens:
        size = 1 << (pool.tokens.bit_length() - 1)
        windows.append((size, _fill(pool, len(tiers) - 1, size, [])))
    return windows


def step_groups(sizes: list[int], step_tokens: int) -> list[int]:
    """Group of each window, so that groups have about equal tokens."""
    n_groups = max(1, -(-sum(sizes) // step_tokens))
    heap = [(0, g) for g in range(n_groups)]
    groups = [0] * len(sizes)
    for w in sorted(range(len(sizes)), key=lambda w: -sizes[w]):
        filled, g = heapq.heappop(heap)
        groups[w] = g
        heapq.heappush(heap, (filled + sizes[w], g))
    return groups


class _Writer:
    """Numbers windows and steps of one task and lays out their pieces as rows."""

    def __init__(self, task: int, step_tokens: int):
        self._first = task << TASK_BITS
        self._sequence = self._step = self._first
        self._step_tokens = step_tokens

    def rows(self, windows: list[tuple[int, list[tuple]]]) -> list[tuple]:
        groups = step_groups([size for size, _ in windows], self._step_tokens)
        rows = []
        for (size, pieces), group in zip(windows, groups):
            offset = 0
            for length, _, start, (doc_id, ids) in pieces:
                part = memoryview(ids)[start * ID_BYTES : (start + length) * ID_BYTES]
                rows.append(
                    (doc_id, start, length, zlib.crc32(part), len(ids) // ID_BYTES)
                    + (self._sequence, offset, size, self._step + group)
                )
                offset += length
            self._sequence += 1
        self._step += max(groups, default=-1) + 1
        return rows


def pack(
    documents: DataFrame,
    tokenizer_path: str,
    tiers: tuple[int, ...] = TIERS,
    end_id: int = END_ID,
    flush_tokens: int = FLUSH_TOKENS,
    step_tokens: int = STEP_TOKENS,
) -> DataFrame:
    """Pieces of documents, placed in sequences of the tiers' lengths.

    ``tiers`` are powers of two, ascending. Returns a row per piece: ``doc_id, start,
    length, ids_crc32, doc_tokens, sequence_id, offset, window, step_id``, where
    ``window`` is the length of the sequence and ``step_id`` its step group.
    """
    narrow = documents.select("doc_id", "text")
    schema = f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, {PIECE_COLUMNS}"
    longest = tiers[-1]
    ending = end_id.to_bytes(ID_BYTES, "little")

    def pack_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = TextIds(tokenizer_path)
        pool = Pool(tiers)
        writer = _Writer(TaskContext.get().partitionId(), step_tokens)
        full: list[tuple[int, list[tuple]]] = []

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            rows = writer.rows(full + pack_pool(pool, tiers, last))
            full.clear()
            if rows:
                yield to_batch(rows)

        waiting = 0
        arrow_schema = None
        for batch in batches:
            if arrow_schema is None:
                arrow_schema = pa.schema(
                    [("doc_id", batch.schema.field("doc_id").type)]
                    + [(c.split()[0], pa.int32() if c.endswith(" int") else pa.int64())
                       for c in PIECE_COLUMNS.split(", ")]
                )

                def to_batch(rows, schema=arrow_schema):
                    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)]
                    return pa.RecordBatch.from_arrays(columns, schema=schema)

            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                ids = tokenizer.of_text(text.as_py()) + ending
                document = (doc_id.as_py(), ids)
                n = len(ids) // ID_BYTES
                whole = n - n % longest
                for start in range(0, whole, longest):
                    full.append((longest, [(longest, 0, start, document)]))
                if n > whole:
                    pool.add(document, whole, n - whole)
                waiting += n
                if waiting >= flush_tokens:
                    yield from flush(last=False)
                    waiting = pool.tokens
        if arrow_schema is not None:
            yield from flush(last=True)

    return narrow.mapInArrow(pack_task, schema)
