from collections import Counter

import numpy as np
import pytest

import llm_data
from tallyforge.llm import language_mix as lm


def test_held_out_documents_are_told(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = lm.predict(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and 0.2 < len(held) / len(rows) < 0.3
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.98


def test_held_out_is_by_the_ids_checksum(spark):
    import zlib

    rows = spark.range(200).select("id", lm.held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in rows)


@pytest.fixture(scope="module")
def model():
    languages = ["aa", "bb", "cc"]
    rng = np.random.default_rng(0)
    table = rng.gamma(0.3, size=(lm.BUCKETS, 3)) + 1e-4
    return lm.LanguageModel(languages, table / table.sum(axis=0))


def test_shares_are_the_likeliest(model):
    rng = np.random.default_rng(1)
    true = np.array([0.6, 0.4, 0.0])
    counts = rng.multinomial(4000, model.likelihoods @ true).astype(float)
    seen = np.flatnonzero(counts)
    pi, best = lm.shares(model.likelihoods[seen], counts[seen])
    assert np.allclose(pi, true, atol=0.05)
    for _ in range(50):
        other = rng.dirichlet([1, 1, 1])
        assert counts[seen] @ np.log(model.likelihoods[seen] @ other) <= best + 1e-3


def test_mixed_texts_have_two_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = lm.fit(docs)
    clean = docs.filter("doc_id < 400 and n_chars between 800 and 4000").collect()
    by_lang = {}
    for r in clean:
        by_lang.setdefault(r.lang, []).append(r.text)
    mixed = by_lang["de"][3] + "\n" + by_lang["fr"][3]
    found = dict(lm.mixture(model, mixed))
    assert set(found) == {"de", "fr"}
    share = len(by_lang["de"][3]) / len(mixed)
    assert abs(found["de"] - share) < 0.15
    assert sum(found.values()) == pytest.approx(1, abs=1e-6)


def brute_trigrams(text):
    """Counts of hashed byte trigrams, byte by byte."""
    data = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in text.lower().encode())
    data = b" " + b" ".join(data.split()) + b" "
    codes = (int.from_bytes(data[i : i + 3]) for i in range(len(data) - 2))
    return Counter(((c * 0x9E3779B1) % 2**32) >> (32 - lm.BUCKET_BITS) for c in codes)


def test_model_is_that_of_brute_force(spark):
    rows = [r for r in llm_data.awkward_rows() if r[1] is None or len(r[1]) < 3000]
    expected = {}
    for _, text, lang, _ in rows:
        if text is not None and lang is not None and any(c.isalpha() for c in text):
            expected.setdefault(lang, Counter()).update(brute_trigrams(text))
    model = lm.fit(llm_data.documents(spark, rows))
    assert model.languages == sorted(expected)
    for i, lang in enumerate(model.languages):
        own = np.full(lm.BUCKETS, lm.SMOOTHING)
        for bucket, n in expected[lang].items():
            own[bucket] += n
        assert np.allclose(model.likelihoods[:, i], own / own.sum(), rtol=1e-12, atol=0)


def brute_mixture(model, text):
    """Languages by plain expectation-maximisation, trigram by trigram, set by set."""
    counts = brute_trigrams(text)

    def fitted(chosen):
        pi = {k: 1 / len(chosen) for k in chosen}
        for _ in range(400 if len(chosen) > 1 else 1):
            new = dict.fromkeys(chosen, 0.0)
            for bucket, n in counts.items():
                likely = {k: pi[k] * model.likelihoods[bucket, k] for k in chosen}
                for k in chosen:
                    new[k] += n * likely[k] / sum(likely.values())
            pi = {k: v / counts.total() for k, v in new.items()}
        return pi, sum(
            n * np.log(sum(pi[k] * model.likelihoods[b, k] for k in chosen)) for b, n in counts.items()
        )

    everything, _ = fitted(range(len(model.languages)))
    ranked = sorted(everything, key=lambda k: -everything[k])
    best = max((fitted([k]) for k in ranked), key=lambda f: f[1])
    for size in range(2, len(ranked) + 1):
        pi, likelihood = fitted(ranked[:size])
        if likelihood - lm.PENALTY * np.log(counts.total() + 1) <= best[1]:
            break
        best = pi, likelihood - lm.PENALTY * np.log(counts.total() + 1)
    return {model.languages[k]: v for k, v in best[0].items()}


def test_mixtures_are_those_of_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = lm.fit(docs)
    texts = [r.text[:300] for r in docs.orderBy("doc_id").limit(24).collect()]
    texts += [a + " " + b for a, b in zip(texts[:6], texts[6:12])]
    for text in texts:
        got, expected = dict(lm.mixture(model, text)), brute_mixture(model, text)
        assert set(got) == set(expected)
        assert all(abs(got[k] - expected[k]) < 0.02 for k in got)


@pytest.mark.parametrize("text", ["½", "² ³", "Ⅷ", "①②", "12 _ 3", "", " ", "٣", "🙂", None])
def test_texts_without_a_letter_are_undetermined(model, text):
    assert lm.mixture(model, text) == []


@pytest.mark.parametrize("text", ["a", "½a", "日", "ª", "ʰ", "Ñ"])
def test_a_letter_is_enough(model, text):
    assert lm.mixture(model, text)


def test_languages_are_bounded(spark):
    rows = [(i, "some text", f"l{i}", None) for i in range(lm.MAX_LANGUAGES + 1)]
    with pytest.raises(ValueError, match="257 values of lang"):
        lm.fit(llm_data.documents(spark, rows))
    assert len(lm.fit(llm_data.documents(spark, rows[:-1])).languages) == lm.MAX_LANGUAGES


def test_awkward_documents(spark):
    rows = lm.predict(llm_data.documents(spark)).collect()
    assert len(rows) == len(llm_data.awkward_rows())
    texts = {i: t for i, t, *_ in llm_data.awkward_rows() if i is not None and i != 7}
    for r in rows:
        assert 0 <= r.score <= 1
        if r.doc_id in texts:
            letters = any(c.isalpha() for c in texts[r.doc_id] or "")
            assert (r.lang_pred == "und") == (not letters)
            assert letters or r.score == 0


def test_nothing_to_learn_from(spark):
    rows = lm.predict(llm_data.documents(spark, [(1, "some text", None, None)])).collect()
    assert [(r.lang_pred, r.score) for r in rows] == [("und", 0.0)]
    assert lm.predict(llm_data.empty(spark)).count() == 0
