import math
import zlib

import numpy as np
import pytest

import llm_data
from tallyforge.llm import quality


def test_labels_are_met(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.classify(docs).join(labels.withColumnRenamed("quality", "label"), "doc_id").collect()
    good = [r for r in rows if r.label == 1]
    bad = [r for r in rows if r.label == 0]
    assert sum(r.kept for r in good) / len(good) > 0.99
    assert sum(not r.kept for r in bad) / len(bad) > 0.95


def test_accuracies_are_estimated_from_agreement():
    rng = np.random.default_rng(0)
    n, names = 20000, list(quality.LABELLERS)
    right = np.linspace(0.65, 0.95, len(names))
    good = rng.random(n) < 0.7
    patterns = {}
    for g in good:
        pattern = 0
        for p in right:
            if rng.random() < 0.2:
                vote = quality.NONE
            else:
                vote = quality.GOOD if (rng.random() < p) == g else quality.BAD
            pattern = pattern * 3 + vote
        patterns[pattern] = patterns.get(pattern, 0) + 1
    model = quality.estimate(patterns)
    assert abs(model.share_good - 0.7) < 0.02
    assert np.allclose(list(model.accuracy().values()), right, atol=0.03)


def test_scorer_learns_soft_labels():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 8)).astype(np.float32)
    target = (x[:, 0] > 0).astype(float)
    scorer = quality.fit_scorer(x, target, np.ones(400))
    assert np.mean([(scorer.score(r) > 0.5) == t for r, t in zip(x, target)]) > 0.97


def test_awkward_documents(spark):
    docs = llm_data.documents(spark)
    rows = quality.score(docs, *quality.fit(docs), "doc_id", "text").collect()
    assert len(rows) == len(llm_data.awkward_rows())
    for r in rows:
        assert 0 <= r.quality <= 1
        if not (r.text or "").strip():
            assert (r.quality, r.kept) == (0.0, False)
    same = {}
    for r in rows:
        assert same.setdefault(r.text, r.quality) == r.quality


def test_stage_keeps_columns(spark):
    docs = llm_data.documents(spark)
    kept = quality.drop_rejected(docs)
    assert kept.dtypes == docs.dtypes
    assert kept.filter("text is null").count() == 0


def test_empty_table(spark):
    assert quality.classify(llm_data.empty(spark)).count() == 0
    assert quality.drop_rejected(llm_data.empty(spark)).count() == 0
    assert quality.classify(llm_data.documents(spark, [(1, None, None, None)])).count() == 1


def brute_properties(text):
    """The properties by loops over bytes, words and lines."""
    data, words = text.encode(), text.split()

    def share(of, total):
        return sum(map(of, data)) / total

    def lower(b):
        return 97 <= b <= 122 or b >= 128

    def upper(b):
        return 65 <= b <= 90

    lines = [line.strip() for line in text.split("\n") if line.strip()]
    letters = max(1, sum(lower(b) or upper(b) for b in data))
    chars = sum(len(line) for line in lines)
    seen, repeated = set(), 0
    for line in lines:
        repeated += len(line) if line in seen else 0
        seen.add(line)
    n = len(words)
    return {
        "words": n,
        "lines": len(lines),
        "symbols": share(lambda b: chr(b) in "#*$%&|~^=+<>@\\_{}[]`!/", n),
        "capitals": share(upper, letters),
        "digits": share(lambda b: 48 <= b <= 57, len(data)),
        "stutter": sum(words[i] == words[i - 1] for i in range(1, n)) / n,
        "variety": math.log(1 + len(set(words))) / math.log(1 + n),
        "packed": len(zlib.compress(data, 1)) / len(data),
        "repeated_lines": repeated / max(1, chars),
        "word_length": chars / n,
        "stops": share(lambda b: chr(b) in ".,;:?'\"()-", n),
        "ended_lines": sum(line[-1] in ".!?\"'):;" for line in lines) / max(1, len(lines)),
        "shouting": text.count("!!") / n,
        "bars": text.count("|") / n,
        "letters": letters / max(1, sum(chr(b) not in " \t\n\r\v\f" for b in data)),
    }


def brute_labels(casts):
    """Posterior of each document by expectation-maximisation, document by document."""
    good = [0.1 if quality.BAD in votes else 0.9 for votes in casts]
    for _ in range(quality.EM_ROUNDS):
        share = (sum(good) + 1) / (len(good) + 2)
        odds = {}
        for j in range(len(quality.LABELLERS)):
            for c in (0, 1):
                weights = [0.1, 0.1]
                for votes, g in zip(casts, good):
                    if votes[j] != quality.NONE:
                        weights[votes[j]] += g if c else 1 - g
                for v in (0, 1):
                    odds[c, j, v] = weights[v] / sum(weights)
        new = []
        for votes in casts:
            chance = [1 - share, share]
            for j, v in enumerate(votes):
                if v != quality.NONE:
                    chance = [chance[c] * odds[c, j, v] for c in (0, 1)]
            new.append(chance[1] / sum(chance))
        change = max(abs(a - b) for a, b in zip(new, good))
        good = new
        if change < 1e-6:
            break
    return good


def test_weak_labels_are_those_of_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(llm_data.documents(spark).select("doc_id", "text"))
    rows = [r for r in docs.collect() if (r.text or "").strip()]
    expected, casts = {}, []
    for r in rows:
        p = brute_properties(r.text)
        assert quality.properties(r.text) == pytest.approx(p)
        casts.append([vote(p) for vote in quality.LABELLERS.values()])
    for r, good in zip(rows, brute_labels(casts)):
        expected[r.text] = good
    labels, scorer = quality.fit(docs)
    got = quality.score(docs, labels, scorer, "text").collect()
    assert len(got) == docs.count()
    for r in got:
        if r.text in expected:
            assert r.weak_label == pytest.approx(expected[r.text], abs=1e-4)
            features = quality.hashed_features(r.text, quality.properties(r.text))
            z = sum(float(a) * float(b) for a, b in zip(features, scorer.weights)) + scorer.bias
            assert r.quality == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-4)
            assert r.kept == (r.quality >= quality.KEEP_FROM)
        else:
            assert (r.quality, r.kept) == (0.0, False)
