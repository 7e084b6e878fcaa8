import random
import zlib
from hashlib import sha256

import pytest

import llm_data
from tallyforge.llm import periodic_runs as pr


def brute(words, least=6, periods=4):
    found = {}
    for q in range(1, len(words) // periods + 1):
        i = q
        while i < len(words):
            j = i
            while j < len(words) and words[j] == words[j - q]:
                j += 1
            if j - i + q >= max(least, periods * q):
                found.setdefault((i - q, j - i + q), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def brute_row(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    best = (None,) * 4
    if runs:
        s, n, q = sorted(runs, key=lambda r: (-r[1], r[0], r[2]))[0]
        best = s, n, q, 1000 * n // q
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (doc_id, len(runs), *best, sha256(lines.encode()).hexdigest(), sha256(kept).hexdigest())


def random_words(rng, n):
    words = []
    while len(words) < n:
        if rng.random() < 0.5:
            period = [rng.choice("abc") for _ in range(rng.randint(1, 12))]
            words += (period * 9)[: rng.randint(1, 70)]
        else:
            words.append(rng.choice("abcd"))
    return words


@pytest.mark.parametrize("least, periods", [(6, 4), (9, 3), (1, 5)])
def test_runs_are_those_of_brute_force(least, periods):
    rng = random.Random(least)
    n_found = 0
    for _ in range(400):
        texts = [random_words(rng, rng.randint(0, 130)) for _ in range(rng.randint(1, 5))]
        got = pr._runs_of_texts([[w.encode() for w in t] for t in texts], least, periods)
        assert got == [brute(t, least, periods) for t in texts]
        n_found += sum(map(len, got))
    assert n_found > 300


def test_nested_and_adjacent_runs():
    words = (["a"] * 7 + ["b"]) * 4 + ["c", "d"] * 5
    (got,) = pr._runs_of_texts([[w.encode() for w in words]])
    assert got == brute(words)
    assert (0, 32, 8) in got and (0, 7, 1) in got and (32, 10, 2) in got


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_given_documents(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    expected = {r.doc_id: brute_row(r.doc_id, r.text) for r in docs.collect()}
    rows = pr.digest(docs).collect()
    assert {r.doc_id: tuple(r) for r in rows} == expected
    assert sum(r.n_runs > 0 for r in rows) > 10


def test_awkward_documents(spark, monkeypatch):
    rows = llm_data.awkward_rows()
    rows += [(2000 + i, " ".join(random_words(random.Random(i), 90)), None, None) for i in range(60)]
    got = pr.digest(llm_data.documents(spark, rows)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((brute_row(r[0], r[1]) for r in rows), key=repr)
    assert pr.digest(llm_data.empty(spark)).count() == 0


def test_texts_in_small_lots_are_the_same():
    import pyarrow as pa

    texts = ["a b " * 9, None, "", "c " * 7, "x y z"]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(5)), "text": texts})
    before = pr.WORDS_AT_ONCE
    try:
        pr.WORDS_AT_ONCE = 3
        lots = [(rows, words) for _, rows, words in pr._texts(iter([batch]))]
    finally:
        pr.WORDS_AT_ONCE = before
    assert [r for rows, _ in lots for r in rows] == list(range(5)) and len(lots) > 2
    assert [w for _, words in lots for w in words] == [(t or "").encode().split() for t in texts]


def test_runs_and_collapse(spark):
    rows = [(1, "go " * 8 + "on", "en", "s"), (2, "plain  text", "en", "s"), (3, None, None, None), (None, "a b " * 5, None, None)]
    docs = llm_data.documents(spark, rows)
    found = sorted((tuple(r) for r in pr.runs(docs).collect()), key=repr)
    assert found == [(1, 0, 8, 1), (None, 0, 10, 2)]
    out = pr.collapse(docs)
    assert out.columns == docs.columns
    assert {(r.doc_id, r.text) for r in out.collect()} == {(1, "go on"), (2, "plain  text"), (3, None), (None, "a b")}
    assert pr.runs(llm_data.empty(spark)).count() == pr.collapse(llm_data.empty(spark)).count() == 0


def test_one_word_very_often_is_fast():
    (got,) = pr._runs_of_texts([[b"x"] * 300_000])
    assert got == [(0, 300_000, 1)]
    period = [str(i).encode() for i in range(1000)]
    (got,) = pr._runs_of_texts([period * 200])
    assert got == [(0, 200_000, 1000)]
