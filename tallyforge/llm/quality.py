"""Quality of documents from overlapping heuristics, by a weak-label model.

Labellers look at one property of a text each and vote good, bad or not at all. How
far each can be trusted is not known beforehand: expectation-maximisation estimates
the odds of its votes in good and in bad documents from how the labellers agree,
over the vote patterns of all documents. The posterior of a pattern is the weak
label of its documents. A linear scorer on hashed features learns from these
labels and judges every document, also those on which no labeller votes.

The scorer is fitted on a bounded sample, ``SAMPLE_TEXTS`` distinct texts, half of
them taken for bad as far as there are, weighted back to their true shares. Votes
and their counts cover all documents.

A null text, or one without a word, scores 0 and is rejected. Repeated rows are
scored alike; ids may be null; extra columns are ignored. An empty table gives an
empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.llm.common import text_or_empty, written

SAMPLE_TEXTS = 4096
FEATURE_BITS = 11
FEATURES = 1 << FEATURE_BITS
EM_ROUNDS = 100
# Only documents that are clearly bad are rejected.
KEEP_FROM = 0.3

GOOD, BAD, NONE = 0, 1, 2

# Classes of bytes that the properties count.
_LOWER, _UPPER, _DIGIT, _SPACE, _STOP, _SYMBOL, _OTHER = range(7)


def _byte_classes() -> np.ndarray:
    classes = np.full(256, _OTHER, dtype=np.uint8)
    classes[128:] = _LOWER
    for name, characters in (
        (_LOWER, b"abcdefghijklmnopqrstuvwxyz"),
        (_UPPER, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        (_DIGIT, b"0123456789"),
        (_SPACE, b" \t\n\r\v\f"),
        (_STOP, b".,;:?'\"()-"),
        (_SYMBOL, b"#*$%&|~^=+<>@\\_{}[]`!/"),
    ):
        classes[list(characters)] = name
    return classes


_CLASSES = _byte_classes()


def properties(text: str) -> dict[str, float]:
    """Shares that the labellers and the scorer look at, over the whole text."""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    counts = np.bincount(_CLASSES[data], minlength=7)
    words = text.split()
    lines = [line.strip() for line in text.split("\n")]
    lines = [line for line in lines if line]
    n = len(words)
    letters = max(1, counts[_LOWER] + counts[_UPPER])
    # A word equal to the one before it; a line equal to an earlier one.
    stuttered = sum(map(str.__eq__, words, words[1:]))
    line_chars = sum(map(len, lines))
    repeated = line_chars - sum(map(len, set(lines)))
    return {
        "words": float(n),
        "lines": float(len(lines)),
        "symbols": counts[_SYMBOL] / n,
        "capitals": counts[_UPPER] / letters,
        "digits": counts[_DIGIT] / len(data),
        "stutter": stuttered / n,
        # Of the words' number and of their distinct number the logarithms' ratio.
        "variety": math.log(1 + len(set(words))) / math.log(1 + n),
        "packed": len(zlib.compress(data.tobytes(), 1)) / len(data),
        "repeated_lines": repeated / max(1, line_chars),
        "word_length": line_chars / n,
        "stops": counts[_STOP] / n,
        "ended_lines": sum(line[-1] in ".!?\"'):;" for line in lines) / max(1, len(lines)),
        "shouting": text.count("!!") / n,
        "bars": text.count("|") / n,
        "letters": letters / max(1, len(data) - counts[_SPACE]),
    }


def _above(name: str, bad: float, good: float, least_words: int = 1):
    """Labeller: bad above one value, good below another."""

    def vote(p: dict[str, float]) -> int:
        if p["words"] < least_words:
            return NONE
        return BAD if p[name] > bad else GOOD if p[name] < good else NONE

    return vote


def _below(name: str, bad: float, good: float, least_words: int = 1):
    above = _above("_", -bad, -good, least_words)
    return lambda p: above({"words": p["words"], "_": -p[name]})


# Ratios of very short texts say little, so most labellers want some words. Every
# kind of junk should catch the eye of several labellers: that is what tells the
# model that they are right.
LABELLERS = {
    "symbols": _above("symbols", 0.25, 0.05, 16),
    "letters": _below("letters", 0.75, 0.9, 16),
    "bars": _above("bars", 0.2, 0.01, 4),
    "capitals": _above("capitals", 0.4, 0.15, 8),
    "shouting": _above("shouting", 0.2, 0.01, 4),
    "stutter": _above("stutter", 0.2, 0.05, 8),
    "variety": _below("variety", 0.75, 0.85, 16),
    "packed": _below("packed", 0.25, 0.35, 40),
    "repeated_lines": _above("repeated_lines", 0.45, 0.05, 40),
    "ended_lines": _below("ended_lines", 0.2, 0.8, 40),
}


def votes(p: dict[str, float]) -> int:
    """The labellers' votes as one number, a digit of base 3 for each."""
    pattern = 0
    for vote in LABELLERS.values():
        pattern = pattern * 3 + vote(p)
    return pattern


def _digits(pattern: int) -> list[int]:
    digits = []
    for _ in LABELLERS:
        pattern, digit = divmod(pattern, 3)
        digits.append(digit)
    return digits[::-1]


@dataclass
class LabelModel:
    """What the labellers' votes are worth.

    ``odds[c, j, v]`` is the chance that labeller ``j``, if it votes on a document of
    class ``c`` (0 bad, 1 good), votes ``v``; ``posterior`` gives each pattern's
    chance of good. That a labeller does not vote says nothing of the class.
    """

    share_good: float
    odds: np.ndarray
    posterior: dict[int, float]

    def accuracy(self) -> dict[str, float]:
        """How often each labeller's vote is right."""
        right = (1 - self.share_good) * self.odds[0, :, BAD] + self.share_good * self.odds[1, :, GOOD]
        return dict(zip(LABELLERS, right.tolist()))


def estimate(patterns: dict[int, int]) -> LabelModel:
    """Expectation-maximisation over counted vote patterns.

    It starts from the cautious guess that any bad vote makes a document bad.
    """
    if not patterns:
        return LabelModel(1.0, np.full((2, len(LABELLERS), 2), 0.5), {})
    keys = sorted(patterns)
    n = np.array([patterns[k] for k in keys], dtype=float)
    cast = np.array([_digits(k) for k in keys])
    one_hot = np.eye(3)[cast][:, :, :2]
    good = np.where((cast == BAD).any(axis=1), 0.1, 0.9)
    for _ in range(EM_ROUNDS):
        weight = np.stack([n * (1 - good), n * good])
        share = (weight[1].sum() + 1) / (n.sum() + 2)
        odds = np.einsum("cp,pjv->cjv", weight, one_hot) + 0.1
        odds /= odds.sum(axis=2, keepdims=True)
        log = np.einsum("pjv,cjv->cp", one_hot, np.log(odds))
        log += np.log([[1 - share], [share]])
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        change = np.abs(new - good).max()
        good = new
        if change < 1e-6:
            break
    return LabelModel(float(share), odds, dict(zip(keys, good.tolist())))


def hashed_features(text: str, p: dict[str, float]) -> np.ndarray:
    """Byte trigrams and bands of the properties, in hashed places, of unit length."""
    data = np.frombuffer(f" {text} ".encode(), dtype=np.uint8).astype(np.uint32)
    codes = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
    buckets = (codes * np.uint32(0x9E3779B1)) >> np.uint32(32 - FEATURE_BITS)
    trigrams = np.sqrt(np.bincount(buckets, minlength=FEATURES))
    trigrams /= math.sqrt(float(trigrams @ trigrams))
    for number, (name, value) in enumerate(p.items()):
        # Bands of doubling width; long texts share the last band of words.
        band = min(int(math.log2(1 + 64 * value)), 12)
        code = (number * 16 + band) * 0x9E3779B1 & 0xFFFFFFFF
        trigrams[code >> (32 - FEATURE_BITS)] += 0.5
    return trigrams.astype(np.float32)


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float

    def score(self, features: np.ndarray) -> float:
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, float(features @ self.weights) + self.bias))))


def fit_scorer(x: np.ndarray, target: np.ndarray, weight: np.ndarray, rounds: int = 400) -> Scorer:
    """Logistic regression towards soft labels, by gradient steps with momentum."""
    w, b = np.zeros(x.shape[1], dtype=np.float32), 0.0
    if not len(x):
        return Scorer(w, 1.0)
    weight = weight / weight.sum()
    speed_w, speed_b, rate = np.zeros_like(w), 0.0, 4.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -50, 50)))
        slope = (weight * (p - target)).astype(np.float32)
        speed_w = 0.9 * speed_w - rate * (slope @ x + 1e-6 * w)
        speed_b = 0.9 * speed_b - rate * float(slope.sum())
        w, b = w + speed_w, b + speed_b
    return Scorer(w, float(b))


def _text_hash() -> Column:
    return F.xxhash64(text_or_empty())


def vote_table(documents: DataFrame) -> DataFrame:
    """``text_hash, pattern`` of every document with a word, as a shared table."""

    def vote_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, patterns = [], []
            for text_hash, text in zip(batch.column("text_hash"), batch.column("text")):
                text = text.as_py()
                if text and not text.isspace():
                    hashes.append(text_hash.as_py())
                    patterns.append(votes(properties(text)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes, pa.int64()), pa.array(patterns, pa.int64())],
                ["text_hash", "pattern"],
            )

    hashed = documents.select(_text_hash().alias("text_hash"), "text")
    return written(hashed.mapInArrow(vote_task, "text_hash bigint, pattern bigint"), "votes")


def _sample(documents: DataFrame, cast: DataFrame, labels: LabelModel, texts: int) -> tuple:
    """Features, weak labels and weights of the sample's texts."""
    bad = [k for k, good in labels.posterior.items() if good < 0.5]
    distinct = cast.groupBy("text_hash").agg(F.first("pattern").alias("pattern"))
    is_bad = F.col("pattern").isin(bad) if bad else F.lit(False)
    chosen, share = [], {}
    for side in (True, False):
        own = distinct.filter(is_bad if side else ~is_bad)
        share[side] = own.count()
        chosen.append(own.orderBy("text_hash").limit(texts // 2))
    sample = written(chosen[0].union(chosen[1]), "quality_sample")
    taken = sample.groupBy(is_bad.alias("bad")).count().collect()
    weight = {row["bad"]: share[row["bad"]] / row["count"] for row in taken}

    def feature_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [hashed_features(t, properties(t)).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(rows, pa.binary())],
                ["text_hash", "pattern", "features"],
            )

    # The sample is bounded by a parameter, so it can go to every task.
    texts_of = documents.select(_text_hash().alias("text_hash"), "text").join(
        F.broadcast(sample), "text_hash"
    )
    rows = (
        texts_of.select("text_hash", "pattern", "text")
        .mapInArrow(feature_task, "text_hash bigint, pattern bigint, features binary")
        .groupBy("text_hash")
        .agg(F.min(F.struct("pattern", "features")).alias("row"))
        .orderBy("text_hash")
        .collect()
    )
    x = np.stack([np.frombuffer(r["row"]["features"], dtype=np.float32) for r in rows]) if rows else (
        np.zeros((0, FEATURES), dtype=np.float32)
    )
    target = np.array([labels.posterior[r["row"]["pattern"]] for r in rows])
    each = np.array([weight[r["row"]["pattern"] in set(bad)] for r in rows])
    return x, target, each


def fit(documents: DataFrame, sample_texts: int = SAMPLE_TEXTS) -> tuple[LabelModel, Scorer]:
    cast = vote_table(documents)
    counted = cast.groupBy("pattern").count().collect()
    labels = estimate({row["pattern"]: row["count"] for row in counted})
    return labels, fit_scorer(*_sample(documents, cast, labels, sample_texts))


def score(documents: DataFrame, labels: LabelModel, scorer: Scorer, *keep: str) -> DataFrame:
    """The kept columns with ``quality, weak_label, kept``.

    ``quality`` is the scorer's, ``weak_label`` the posterior of the labellers' votes.
    """
    narrow = documents.select(*keep, F.col("text").alias("_text"))
    schema = T.StructType(narrow.schema.fields[:-1])
    schema = schema.add("quality", "double").add("weak_label", "double")
    shared = narrow.sparkSession.sparkContext.broadcast((labels.posterior, scorer))

    def score_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        posterior, scorer = shared.value
        for batch in batches:
            quality, weak = [], []
            for text in batch.column(len(keep)):
                text = text.as_py()
                if not text or text.isspace():
                    quality.append(0.0)
                    weak.append(0.0)
                    continue
                p = properties(text)
                quality.append(scorer.score(hashed_features(text, p)))
                weak.append(posterior.get(votes(p), 0.5))
            columns = [batch.column(i) for i in range(len(keep))]
            columns += [pa.array(quality, pa.float64()), pa.array(weak, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    scored = narrow.mapInArrow(score_task, schema)
    return scored.withColumn("kept", F.col("quality") >= KEEP_FROM)


def classify(documents: DataFrame) -> DataFrame:
    """``doc_id, quality, weak_label, kept`` of every document."""
    return score(documents, *fit(documents), "doc_id")


def drop_rejected(documents: DataFrame) -> DataFrame:
    """``documents`` without those that the classifier rejects."""
    columns = documents.columns
    wide = documents.select(F.struct(*documents.columns).alias("_document"), "text")
    labels, scorer = fit(documents)
    kept = score(wide, labels, scorer, "_document").filter("kept")
    return kept.select(*(F.col("_document").getField(c).alias(c) for c in columns))
