"""Hard negatives by Fagin's threshold algorithm.

For an anchor and each of its positives, rows of another label are wanted whose score
lies in a window just below the positive's. Scores are inner products of whole numbers,
so they are exact and ties are real ties, which go to the smaller id.

Rows lie in blocks of bounded size. A block keeps, for each dimension, its rows sorted
by their component. Of these lists an anchor reads from the top where its own component
is positive and from the bottom where it is negative: what it reads next in a dimension
adds less and less to the score. Each row that turns up in any list is scored at once by
random access to its vector. The sum over all dimensions of what the places read last
would add is the threshold: no row that has not turned up scores more. Reading stops once
the threshold falls strictly below the least score that could still matter to every
window, its kth best so far or its lower end; a tie at the kth place may still go to a
smaller id, hence strictly.

1. Vectors become whole numbers, rows get blocks, and anchors blocks of their own.
2. Each block of anchors meets each block of rows of its label: the best of each are the
   anchor's positives.
3. Each block of anchors, now with its windows, meets each block of rows. The best in
   each window of all blocks are the negatives.

Blocks are dealt by a hash of the row, not by label or id, so a hot label or a repeated
id makes no block larger. What meets in a task is one block of rows and one of anchors.
The work is anchors times rows by nature, where the threshold does not stop early, as
with vectors that point in all directions.

A row with a null label, a null vector, or a null or non-finite component takes no part.
A row with a null id is never an anchor and comes after all others in ties. Rows that
repeat an id are rows of their own: each is an anchor, and positive or negative to the
others. A shorter vector counts as if it went on with zeros. Components whose products
might leave a bigint raise an error. A positive with a negative score has an empty
window. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.llm.common import written

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
# A negative's score is at least so many hundredths of the positive's, and at most it.
LEAST_PERCENT = 80

ROWS_IN_BLOCK = 4096
ANCHORS_IN_BLOCK = 8192
# How deep the lists are read at first, and by how much deeper each further time.
FIRST_DEPTH = 64
DEEPER = 4

LAST_ID = np.iinfo(np.int64).max


def exact_type(bound: float) -> type:
    """The fastest number type in which sums up to a bound are exact."""
    if bound < 2.0**24:
        return np.float32
    if bound < 2.0**53:
        return np.float64
    if bound < 2.0**63:
        return np.int64
    raise ValueError("the inner products of these vectors may leave a bigint")


@dataclass
class Best:
    """The best rows in a window of scores: higher first, then smaller ids."""

    low: float
    high: float
    most: int
    rows: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    scores: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))

    @property
    def bar(self) -> float:
        """Rows with less than this no longer matter."""
        return self.scores[-1] if len(self.rows) == self.most else self.low

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        fits = np.flatnonzero((scores >= self.bar) & (scores <= self.high))
        if len(fits):
            rows = np.concatenate((self.rows, rows[fits]))
            scores = np.concatenate((self.scores, scores[fits].astype(np.int64)))
            best = np.lexsort((ids[rows], -scores))[: self.most]
            self.rows, self.scores = rows[best], scores[best]


class SortedLists:
    """The rows of a block by each dimension's component, and for random access."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        self.vectors, self.ids = vectors, ids
        self.order = np.ascontiguousarray(np.argsort(vectors, axis=0, kind="stable").T)
        self.values = np.take_along_axis(np.ascontiguousarray(vectors.T), self.order, axis=1)

    def search(self, anchor: np.ndarray, matters: np.ndarray, windows: list[Best]) -> None:
        """Offer every window the rows that matter, by the threshold algorithm."""
        n = len(self.ids)
        up, down = np.flatnonzero(anchor < 0), np.flatnonzero(anchor > 0)
        if not len(up) and not len(down):  # all scores are 0; any list has all rows
            up = np.zeros(1, dtype=np.int64)
        turned_up = np.zeros(n, dtype=bool)
        depth, step = 0, FIRST_DEPTH
        while depth < n and windows:
            to = min(n, depth + step)
            read = np.zeros(n, dtype=bool)
            read[self.order[up, depth:to]] = True
            read[self.order[down, n - to : n - depth]] = True
            new = np.flatnonzero(read & ~turned_up)
            turned_up |= read
            scores = self.vectors[new] @ anchor
            fit = matters[new]
            for window in windows:
                window.offer(new[fit], scores[fit], self.ids)
            threshold = self.values[up, to - 1] @ anchor[up] + self.values[down, n - to] @ anchor[down]
            if all(threshold < window.bar for window in windows) or turned_up.all():
                return
            depth, step = to, step * DEEPER


def whole_rows(embeddings: DataFrame, label: Column | None = None, scale: int = SCALE) -> DataFrame:
    """``row, vec_id, label, vector, block`` of the rows that take part, as a shared table.

    Components are multiplied and rounded down. ``label`` replaces the column.
    """
    number = F.col("label") if label is None else label
    finite = F.forall(
        "embedding",
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))),
    )
    rows = embeddings.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(finite)
    vector = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    numbered = written(
        rows.select(
            F.monotonically_increasing_id().alias("row"),
            F.col("vec_id").cast("bigint").alias("vec_id"),
            number.cast("bigint").alias("label"),
            vector.alias("vector"),
        ),
        "hard_negative_rows",
    )
    n_blocks = -(-numbered.count() // ROWS_IN_BLOCK)
    return numbered.withColumn("block", _block(n_blocks))


def _block(n_blocks: int) -> Column:
    return F.pmod(F.xxhash64("row"), F.lit(max(1, n_blocks))).cast("int")


def _vectors(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows of a matrix, zeros after the shorter ones."""
    lists = column.combine_chunks()
    lengths = np.diff(lists.offsets.to_numpy())
    values = lists.flatten().to_numpy()
    if (lengths == width).all():
        return values.reshape(len(lists), width)
    out = np.zeros((len(lists), width), dtype=np.int64)
    out[np.repeat(np.arange(len(lists)), lengths), np.concatenate([np.arange(n) for n in lengths])] = values
    return out


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    return column.fill_null(LAST_ID).to_numpy()


def _met(
    rows: DataFrame,
    anchors: DataFrame,
    keys: list[str],
    same_label: bool,
    windows_of: Callable[[pa.Table], list[list[Best]]],
) -> DataFrame:
    """``anchor_row, window, row, vec_id, score``: what each block offers each window.

    Every block of anchors meets every block of rows. A window is told by its upper end.
    """
    n_blocks, n_anchor_blocks = (
        1 + (df.agg(F.max(name)).first()[0] or 0) for df, name in ((rows, "block"), (anchors, "anchor_block"))
    )
    each_anchor = anchors.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    each_row = rows.withColumn(
        "anchor_block", F.explode(F.sequence(F.lit(0), F.lit(n_anchor_blocks - 1)))
    )
    schema = "anchor_row bigint, window bigint, row bigint, vec_id bigint, score bigint"
    names = ["anchor_row", "window", "row", "vec_id", "score"]

    def search_task(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        found = [], [], [], []
        if rows.num_rows and anchors.num_rows:
            width = max(1, *(pc.max(pc.list_value_length(t["vector"])).as_py() for t in (rows, anchors)))
            vectors, wanted = _vectors(rows["vector"], width), _vectors(anchors["vector"], width)
            # No score or threshold, nor a part of one, is larger.
            greatest = [np.abs(m.astype(float)).max(axis=0) for m in (vectors, wanted)]
            exact = exact_type(float(greatest[0] @ greatest[1]) * 1.001)
            lists = SortedLists(vectors.astype(exact), _numbers(rows["vec_id"]))
            labels, row = rows["label"].to_numpy(), rows["row"].to_numpy()
            for own, label, anchor, windows in zip(
                anchors["row"].to_pylist(), anchors["label"].to_pylist(), wanted.astype(exact), windows_of(anchors)
            ):
                matters = (labels == label) & (row != own) if same_label else labels != label
                lists.search(anchor, matters, windows)
                for window in windows:
                    n = len(window.rows)
                    found[0].append(np.full(n, own))
                    found[1].append(np.full(n, window.high if np.isfinite(window.high) else 0, dtype=np.int64))
                    found[2].append(window.rows)
                    found[3].append(window.scores)
        own, high, at, scores = (
            np.concatenate(c) if c else np.zeros(0, dtype=np.int64) for c in found
        )
        at = pa.array(at)
        columns = [pa.array(own), pa.array(high), rows["row"].take(at), rows["vec_id"].take(at)]
        return pa.Table.from_arrays([*columns, pa.array(scores, pa.int64())], names=names)

    return (
        each_row.groupBy(*keys).cogroup(each_anchor.groupBy(*keys)).applyInArrow(search_task, schema)
    )


def _ranked(found: DataFrame, most: int) -> DataFrame:
    """The best of what the blocks offered, with ``rank`` from 1."""
    best_first = Window.partitionBy("anchor_row", "window").orderBy(
        F.desc("score"), F.asc_nulls_last("vec_id"), "row"
    )
    return found.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= most)


def _unbounded(anchors: pa.Table, most: int) -> list[list[Best]]:
    return [[Best(-np.inf, np.inf, most)] for _ in range(anchors.num_rows)]


def _below(anchors: pa.Table, most: int, least_percent: int) -> list[list[Best]]:
    return [
        [Best(-(-least_percent * score // 100), score, most) for score in scores if score >= 0]
        for scores in anchors["windows"].to_pylist()
    ]


def mine(
    rows: DataFrame,
    is_anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    least_percent: int = LEAST_PERCENT,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``rows`` are those of ``whole_rows``. An anchor's positives are its best rows of the
    same label, its negatives the best of other labels from ``least_percent`` hundredths
    of the positive's score up to that score.
    """
    chosen = rows.filter(is_anchor)
    n_blocks = -(-chosen.count() // ANCHORS_IN_BLOCK)
    anchors = chosen.drop("block").withColumn("anchor_block", _block(n_blocks))

    found = _met(
        rows, anchors, ["label", "anchor_block", "block"], True, lambda t: _unbounded(t, positives)
    )
    best = written(
        _ranked(found, positives).select(
            "anchor_row", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
        ),
        "hard_negative_positives",
    )
    windows = best.groupBy("anchor_row").agg(F.collect_set("positive_score").alias("windows"))
    with_windows = anchors.join(
        windows.withColumnRenamed("anchor_row", "_anchor_row"), F.col("row") == F.col("_anchor_row")
    ).drop("_anchor_row")
    found = _met(
        rows,
        written(with_windows, "hard_negative_anchors"),
        ["anchor_block", "block"],
        False,
        lambda t: _below(t, negatives, least_percent),
    )
    mined = _ranked(found, negatives).select(
        F.col("anchor_row").alias("_anchor_row"),
        "window",
        "rank",
        F.col("vec_id").alias("negative_id"),
        F.col("score").alias("negative_score"),
    )
    ids = chosen.select(F.col("row").alias("anchor_row"), F.col("vec_id").alias("anchor_id"))
    return (
        best.join(ids, "anchor_row")
        .join(
            mined,
            (F.col("anchor_row") == F.col("_anchor_row")) & (F.col("positive_score") == F.col("window")),
        )
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )


def noisy_label() -> Column:
    """The query's label: that of every seventh row, by id, is the next of ten."""
    label = F.col("label").cast("bigint")
    return F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)


def hard_negatives(embeddings: DataFrame) -> DataFrame:
    """The query: anchors are the rows whose id is divisible by 100."""
    return mine(whole_rows(embeddings, noisy_label()), F.col("vec_id") % 100 == 0)


ORACLE_SQL = f"""
    WITH part AS (
        SELECT vec_id,
               CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
               list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v
        FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ),
    scored AS (
        SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
               list_inner_product(a.v, b.v)::BIGINT AS score
        FROM part a JOIN part b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
    ),
    positive AS (
        SELECT anchor_id, other_id AS positive_id, score AS positive_score
        FROM scored WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= {POSITIVES}
    )
    SELECT p.anchor_id, p.positive_id,
           (row_number() OVER best)::INTEGER AS rank,
           s.other_id AS negative_id, p.positive_score, s.score AS negative_score
    FROM positive p
    JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
     AND {LEAST_PERCENT} * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
    WINDOW best AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id)
    QUALIFY row_number() OVER best <= {NEGATIVES}
"""
