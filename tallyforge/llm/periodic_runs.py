"""Runs of words that repeat periodically, and texts without the repetitions.

A run is a stretch of words that equal those ``q`` before, for the smallest such ``q``,
that has ``max(6, 4 * q)`` words or more and cannot be made longer. It is found by a
sparse dynamic program over diagonals. A diagonal is a lag; it is active at a word that
has an earlier occurrence so far back, its match length grows by one with each such
word in a row, and where it ends a match of sufficient length is a run.

All earlier occurrences of a word are too many: a text of one word has them in square
number. So a diagonal is told by windows of as many words as its lag has, rounded up to
a power of two, and of a window only the latest earlier occurrence counts. Nothing is
lost by that. A run's match is at least 3 q words, so windows of less than 2 q fit in;
inside the run a window of q words or more occurs at multiples of q alone, as q is the
smallest period; so its latest occurrence is q back, from the first word of the match
to the last. This gives every word one active diagonal for each power of two, and no
run is found twice. Windows are compared exactly: those of twice the length are named by
pairs of names. Only words whose shorter windows repeat are looked at again, so most
texts are done after windows of two or four words.

The program is run for many texts at once, level by level, in arrays.

Words are runs of bytes other than ASCII white space. A null or empty text has none,
hence no run, and collapses to an empty text; very long texts are read whole. Ids may
be null or repeat: rows are read one by one. Extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

LEAST_WORDS = 6
LEAST_PERIODS = 4
# Words of texts that are worked on at once; a longer text is worked on alone.
WORDS_AT_ONCE = 1 << 18

SPLIT_WORDS = 32


def _named(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


def runs_of(
    words: np.ndarray,
    lengths: np.ndarray,
    least_words: int = LEAST_WORDS,
    least_periods: int = LEAST_PERIODS,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``text, start, length, period`` of all runs, by text, start and period.

    ``words`` has the words of all texts, one text after the other, as numbers, and
    ``lengths`` how many each text has. ``least_periods`` must be 3 or more.
    """
    text = np.repeat(np.arange(len(lengths)), lengths)
    begins = np.cumsum(lengths) - lengths
    ends = (begins + lengths)[text]
    found: list[tuple[np.ndarray, ...]] = []
    # Names of the windows that begin at each place. A text's own, so that no window is
    # like one of another text.
    names = _named(text << SPLIT_WORDS | words)
    place = np.arange(len(words))
    width = 1
    while len(place):
        # ``place`` are those whose windows of this width lie in the text; all others,
        # and windows that do not repeat, are no part of any match.
        lag = np.zeros(len(words), dtype=np.int64)
        order = np.argsort(names[place], kind="stable")
        at = place[order]
        same = names[at[1:]] == names[at[:-1]]
        lag[at[1:][same]] = (at[1:] - at[:-1])[same]
        # Diagonals of this level, as stretches of one lag.
        active = np.flatnonzero((lag > width // 2) & (lag <= width))
        if len(active):
            step = (active[1:] != active[:-1] + 1) | (lag[active[1:]] != lag[active[:-1]])
            first = active[np.concatenate(([True], step))]
            last = active[np.concatenate((step, [True]))]
            period = lag[first]
            match = last - first + width
            enough = match + period >= np.maximum(least_words, least_periods * period)
            start = first[enough] - period[enough]
            own = text[start]
            found.append((own, start - begins[own], (match + period)[enough], period[enough]))
        # A window of twice the width repeats only if both of its halves do.
        repeats = np.zeros(len(words) + 1, dtype=bool)
        repeats[at[1:][same]] = repeats[at[:-1][same]] = True
        place = place[repeats[place]]
        place = place[place + 2 * width <= ends[place]]
        place = place[repeats[place + width]]
        # Nor is it of use in a text too short for a run of its lags.
        place = place[(width + 1) * least_periods <= lengths[text[place]]]
        pairs = names[place] * (len(words) + 1) + names[place + width]
        names = np.zeros(len(words), dtype=np.int64)
        names[place] = _named(pairs)
        width *= 2
    if not found:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none
    own, start, length, period = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((period, start, own))
    return own[order], start[order], length[order], period[order]


def stays(n_words: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay: those in no run after its first period."""
    gone = np.zeros(n_words + 1, dtype=np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return np.cumsum(gone[:-1]) == 0


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The query's words: of a tenth of all documents, by id, a tail is made periodic.

    A null id has no decimal form; its words stay as they are.
    """
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def _texts(
    batches: Iterator[pa.RecordBatch], prepare=None
) -> Iterator[tuple[pa.RecordBatch, list[int], list[list[bytes]]]]:
    """Rows of a batch and their words, as many at once as have few words enough."""
    for batch in batches:
        rows, texts, n_words = [], [], 0
        for row, text in enumerate(batch.column("text")):
            words = (text.as_py() or "").encode().split()
            if prepare:
                words = prepare(batch.column("doc_id")[row].as_py(), words)
            rows.append(row)
            texts.append(words)
            n_words += len(words)
            if n_words >= WORDS_AT_ONCE:
                yield batch, rows, texts
                rows, texts, n_words = [], [], 0
        if rows:
            yield batch, rows, texts


def _runs_of_texts(
    texts: list[list[bytes]], least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS
) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, as ``(start, length, period)`` by start and period."""
    numbers: dict[bytes, int] = {}
    words = [numbers.setdefault(w, len(numbers)) for text in texts for w in text]
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    found = runs_of(np.array(words, dtype=np.int64), lengths, least_words, least_periods)
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for text, *run in zip(*(column.tolist() for column in found)):
        runs[text].append(tuple(run))
    return runs


RUN_DIGEST = (
    T.StructType()
    .add("n_runs", "long")
    .add("start", "long")
    .add("length", "long")
    .add("period", "long")
    .add("exponent_milli", "long")
    .add("runs_sha256", "string")
    .add("collapsed_sha256", "string")
)


def digest(documents: DataFrame, prepare=planted) -> DataFrame:
    """``doc_id``, the longest run of every document, and checksums of all its runs.

    ``prepare`` takes a document's id and words and returns the words to be looked at.
    Of runs of one length the first counts, then the one with the smaller period.
    ``runs_sha256`` is over lines ``start,length,period`` by start and period,
    ``collapsed_sha256`` over the words that stay, joined by one space.
    """
    narrow = documents.select("doc_id", "text")
    schema = T.StructType([narrow.schema["doc_id"], *RUN_DIGEST.fields])
    kinds = [pa.int64()] * 5 + [pa.string()] * 2

    def digest_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows, texts in _texts(batches, prepare):
            out = []
            for words, runs in zip(texts, _runs_of_texts(texts)):
                best = (None,) * 4
                if runs:
                    start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2]))
                    best = start, length, period, 1000 * length // period
                    words = [words[i] for i in np.flatnonzero(stays(len(words), runs))]
                lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
                checksums = sha256(lines.encode()).hexdigest(), sha256(b" ".join(words)).hexdigest()
                out.append((len(runs), *best, *checksums))
            columns = [batch.column("doc_id").take(pa.array(rows))]
            columns += [pa.array(c, kind) for c, kind in zip(zip(*out), kinds)]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return narrow.mapInArrow(digest_task, schema)


def runs(
    documents: DataFrame, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS
) -> DataFrame:
    """``doc_id, start, length, period`` of all runs; a document may have none or many."""
    narrow = documents.select("doc_id", "text")
    schema = T.StructType([narrow.schema["doc_id"]])
    for name in ("start", "length", "period"):
        schema = schema.add(name, "long")

    def runs_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows, texts in _texts(batches):
            found = _runs_of_texts(texts, least_words, least_periods)
            at = [row for row, own in zip(rows, found) for _ in own]
            if at:
                columns = [batch.column("doc_id").take(pa.array(at))]
                columns += [pa.array(c, pa.int64()) for c in zip(*(r for own in found for r in own))]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return narrow.mapInArrow(runs_task, schema)


def collapse(
    documents: DataFrame, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS
) -> DataFrame:
    """``documents`` with one period left of each run.

    A text with a run becomes its words that stay, joined by one space; others are left
    as they are.
    """
    schema = documents.schema
    text_at = schema.names.index("text")

    def collapse_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows, texts in _texts(batches):
            part = batch.take(pa.array(rows))
            new = part.column(text_at).to_pylist()
            for i, own in enumerate(_runs_of_texts(texts, least_words, least_periods)):
                if own:
                    kept = np.flatnonzero(stays(len(texts[i]), own))
                    new[i] = b" ".join(texts[i][k] for k in kept).decode()
            columns = part.columns
            columns[text_at] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return documents.mapInArrow(collapse_task, schema)


# The checksum of the ids is worked out byte by byte. Places of equal five words are
# joined; a run's match has five words at least.
ORACLE_SQL = f"""
    WITH bits AS (
        SELECT list_reduce(list_prepend(b::BIGINT, range(8)),
                           lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
        FROM range(256) AS t(b) ORDER BY b
    ),
    crc AS (SELECT list(c) AS crc FROM bits),
    docs AS MATERIALIZED (
        SELECT row_number() OVER () AS r, doc_id,
               regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
               xor(list_reduce(
                   list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
                   lambda c, ch: xor(c >> 8, crc[(xor(c, ch) & 255) + 1])
               ), 4294967295) AS h
        FROM documents, crc
    ),
    tails AS (
        SELECT *, (h // 10) % len(words) AS a,
               1 + (len(words) - (h // 10) % len(words)) // (3 + (h // 10) % 8) AS p
        FROM docs WHERE len(words) > 0
    ),
    words AS MATERIALIZED (
        SELECT r, unnest(range(len(words))) AS i,
               unnest(CASE WHEN h % 10 = 0
                      THEN list_transform(range(len(words)), lambda i: words[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END])
                      ELSE words END) AS w
        FROM tails
    ),
    fives AS MATERIALIZED (
        SELECT r, i, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' '
                  || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o AS f
        FROM words WINDOW o AS (PARTITION BY r ORDER BY i)
    ),
    matches AS (
        SELECT x.r, x.i, x.i - y.i AS d, x.i - row_number() OVER (PARTITION BY x.r, x.i - y.i ORDER BY x.i) AS island
        FROM fives x JOIN fives y ON x.r = y.r AND x.f = y.f AND y.i < x.i
    ),
    stretches AS (
        SELECT r, d, min(i) - d AS start, count(*) + {LEAST_WORDS - 2} + d AS length
        FROM matches GROUP BY r, d, island
    ),
    runs AS MATERIALIZED (
        SELECT r, start, length, min(d) AS period
        FROM stretches WHERE length >= greatest({LEAST_WORDS}, {LEAST_PERIODS} * d)
        GROUP BY r, start, length
    ),
    per_document AS (
        SELECT r, count(*) AS n_runs,
               min({{'less': -length, 'start': start, 'period': period}}) AS best,
               string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
        FROM runs GROUP BY r
    ),
    gone AS (
        SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs
    ),
    kept AS (
        SELECT r, string_agg(w, ' ' ORDER BY i) AS text
        FROM words ANTI JOIN gone USING (r, i) GROUP BY r
    )
    SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, -best.less AS length,
           best.period AS period, 1000 * -best.less // best.period AS exponent_milli,
           sha256(coalesce(lines, '')) AS runs_sha256,
           sha256(coalesce(kept.text, '')) AS collapsed_sha256
    FROM docs LEFT JOIN per_document USING (r) LEFT JOIN kept USING (r)
"""
