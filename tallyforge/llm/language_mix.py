"""Languages of whole texts, as mixtures inferred from n-gram likelihoods.

Every language is a distribution over hashed byte trigrams of lower-cased letters,
counted over all learning documents. A document is taken as a mixture of
languages: expectation-maximisation finds the shares that make its trigrams most
likely. Sets of languages are then compared, from the largest share on: a language
is added as long as the gain in log-likelihood exceeds a penalty that grows with
the logarithm of the text's length.

The language of a document is the one with the largest share, and its score that
share. A text that is null or has no letter is ``und`` with score 0, and so is
every text if nothing was learnt. A null ``lang`` is not learnt from; more than 256
different ones raise an error. Repeated
rows count as often as they occur; extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.llm.common import written

BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
# Added to every count; unseen trigrams keep a small likelihood.
SMOOTHING = 0.5
# A language more must raise the log-likelihood by this, times log(trigrams).
PENALTY = 4.0
# The model has a likelihood for each trigram bucket and language, so these are bounded.
MAX_LANGUAGES = 256
# A task counts so many trigrams of languages at once.
COUNT_AT_ONCE = 1 << 22
ROUNDS = 60
TOLERANCE = 1e-4

UNDETERMINED = "und"

# ASCII other than letters becomes a space.
_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
# Not numbers, as in the sign for one half or a Roman numeral of one character.
_ANY_LETTER = regex.compile(r"\p{L}")
_MULTIPLIER = np.uint32(0x9E3779B1)


def trigrams(text: str) -> np.ndarray:
    """Buckets of the byte trigrams of a text that has a letter."""
    letters = b" ".join(text.lower().encode().translate(_LETTERS).split())
    b = np.frombuffer(b" " + letters + b" ", dtype=np.uint8).astype(np.uint32)
    codes = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    return (codes * _MULTIPLIER) >> np.uint32(32 - BUCKET_BITS)


@dataclass
class LanguageModel:
    """Likelihoods of trigram buckets (rows) under languages (columns)."""

    languages: list[str]
    likelihoods: np.ndarray


def fit(documents: DataFrame) -> LanguageModel:
    """Learn from ``text`` and ``lang`` of all given documents.

    Counts are added up in each task before they are shuffled. The model has a
    column per label, so its size follows the number of labels alone.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[str, int] = {}
        waiting: list[np.ndarray] = []
        n_waiting = 0

        def counted() -> pa.RecordBatch:
            seen, n = np.unique(np.concatenate(waiting), return_counts=True)
            waiting.clear()
            names = pa.array(list(numbers), pa.string())
            return pa.RecordBatch.from_arrays(
                [
                    names.take(pa.array(seen >> BUCKET_BITS)),
                    pa.array((seen & (BUCKETS - 1)).astype(np.int32)),
                    pa.array(n),
                ],
                ["lang", "bucket", "n"],
            )

        for batch in batches:
            for text, lang in zip(batch.column("text"), batch.column("lang")):
                text = text.as_py()
                if _ANY_LETTER.search(text):
                    number = numbers.setdefault(lang.as_py(), len(numbers))
                    waiting.append(trigrams(text).astype(np.int64) | (number << BUCKET_BITS))
                    n_waiting += len(waiting[-1])
                if n_waiting >= COUNT_AT_ONCE:
                    yield counted()
                    n_waiting = 0
        if waiting:
            yield counted()

    totals = written(
        documents.select("text", F.col("lang").cast("string").alias("lang"))
        .filter("text is not null and lang is not null")
        .mapInArrow(count, "lang string, bucket int, n bigint")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n")),
        "language_counts",
    )
    n_languages = totals.select("lang").distinct().count()
    if n_languages > MAX_LANGUAGES:
        raise ValueError(f"{n_languages} values of lang, more than {MAX_LANGUAGES}")
    counts = totals.toArrow().to_pandas()
    languages = sorted(counts["lang"].unique())
    table = np.zeros((BUCKETS, len(languages)))
    column = counts["lang"].map({lang: i for i, lang in enumerate(languages)})
    table[counts["bucket"].to_numpy(dtype=int), column.to_numpy(dtype=int)] = counts["n"]
    table += SMOOTHING
    return LanguageModel(languages, table / table.sum(axis=0))


def shares(likelihoods: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, float]:
    """Shares of the columns that make the counted rows most likely, and that log-likelihood."""
    n, k = counts.sum(), likelihoods.shape[1]
    pi = np.full(k, 1 / k)
    mixed = likelihoods @ pi
    if k > 1:
        for _ in range(ROUNDS):
            # Expected share of each language in every trigram, summed over the text.
            new = pi * (likelihoods.T @ (counts / mixed)) / n
            change = np.abs(new - pi).max()
            pi = new
            mixed = likelihoods @ pi
            if change < TOLERANCE:
                break
    return pi, float(counts @ np.log(mixed))


def mixture(model: LanguageModel, text: str | None) -> list[tuple[str, float]]:
    """Chosen languages of a text with their shares, the largest first."""
    if not text or not model.languages or not _ANY_LETTER.search(text):
        return []
    buckets, counts = np.unique(trigrams(text), return_counts=True)
    table = model.likelihoods[buckets]
    counts = counts.astype(float)
    everything, _ = shares(table, counts)
    ranked = np.argsort(-everything, kind="stable")
    # One language: the likeliest alone, which need not have the largest share.
    alone = counts @ np.log(table)
    best_set, best_pi, best = [int(np.argmax(alone))], np.ones(1), float(alone.max())
    penalty = PENALTY * np.log(counts.sum() + 1)
    for size in range(2, len(ranked) + 1):
        chosen = ranked[:size]
        pi, likelihood = shares(table[:, chosen], counts)
        if likelihood - penalty * (size - 1) <= best:
            break
        best_set, best_pi, best = list(chosen), pi, likelihood - penalty * (size - 1)
    order = np.argsort(-best_pi, kind="stable")
    return [(model.languages[best_set[i]], float(best_pi[i])) for i in order]


def identify(documents: DataFrame, model: LanguageModel, *keep: str | Column) -> DataFrame:
    """The kept columns with ``lang_pred, score, languages, proportions``.

    ``languages`` are those chosen for the text and ``proportions`` their shares.
    """
    narrow = documents.select(*keep, F.col("text").alias("_text"))
    kept = narrow.columns[:-1]
    schema = narrow.drop("_text").schema.add("lang_pred", "string").add("score", "double")
    schema = schema.add("languages", T.ArrayType(T.StringType()))
    schema = schema.add("proportions", T.ArrayType(T.DoubleType()))
    shared = narrow.sparkSession.sparkContext.broadcast(model)

    def identify_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mixes = [mixture(shared.value, text.as_py()) for text in batch.column("_text")]
            tops = [mix[0] if mix else (UNDETERMINED, 0.0) for mix in mixes]
            columns = [batch.column(i) for i in range(len(kept))]
            columns += [
                pa.array([lang for lang, _ in tops], pa.string()),
                pa.array([min(1.0, share) for _, share in tops], pa.float64()),
                pa.array([[lang for lang, _ in mix] for mix in mixes], pa.list_(pa.string())),
                pa.array([[share for _, share in mix] for mix in mixes], pa.list_(pa.float64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return narrow.mapInArrow(identify_task, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept out of learning: a quarter, by its id."""
    as_text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.crc32(as_text.cast("binary")) % 4 == 2


def predict(documents: DataFrame) -> DataFrame:
    """Learn from three quarters of the documents and predict all."""
    model = fit(documents.filter(~held_out()))
    return identify(documents, model, "doc_id", held_out().alias("held_out"))
