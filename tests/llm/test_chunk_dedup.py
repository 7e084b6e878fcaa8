import random

import numpy as np
import pytest

import llm_data
from tallyforge.llm import chunk_dedup as cd


def as_bytes(text):
    return np.frombuffer(text.encode(), dtype=np.uint8)


def test_hash_is_the_rolling_one():
    data = as_bytes(llm_data.words(random.Random(1), 50))
    h, rolled = 0, []
    for byte in data:
        h = ((h << 1) + int(cd._GEAR[byte])) & 0xFFFF
        rolled.append(h)
    assert cd.gear_hashes(data).tolist() == rolled
    for n in (1, 2, 3, 9):
        assert cd.gear_hashes(data[:n]).tolist() == rolled[:n]


def test_chunks_cover_texts_and_resist_shifts():
    rng = random.Random(2)
    text = llm_data.words(rng, 400)
    for t in (text, "é" * 300, "x" * 500, "日本語" * 90, "a"):
        ends = cd.chunk_ends(as_bytes(t))
        assert ends[-1] == len(t.encode()) and (np.diff(ends) > 0).all()
        assert np.diff(np.append(0, ends)).max() <= cd.MOST_BYTES + 3
        for low, high in zip(np.append(0, ends), ends):
            t.encode()[low:high].decode()
    shifted = "An insertion. " + text

    def own(t):
        data = as_bytes(t)
        return set(cd.digests(data, cd.chunk_ends(data)).tolist())

    assert len(own(text) - own(shifted)) <= 3


def planted(seed):
    rng = random.Random(seed)
    passages = [llm_data.words(rng, n) for n in (51, 60, 90)]
    rows, holders = [], {i: [] for i in range(3)}
    for k in range(60):
        parts = [llm_data.words(rng, rng.randint(20, 120)) for _ in range(3)]
        if k % 3 == 0:
            p = rng.randrange(3)
            parts.insert(rng.randint(0, 3), passages[p])
            holders[p].append(k)
        rows.append((k, " ".join(parts), None, None))
    return rows, passages, holders


def test_planted_passages_are_found_and_nothing_else(spark):
    rows, _, holders = planted(3)
    got = cd.passages(llm_data.documents(spark, rows)).collect()
    expected = {k for ids in holders.values() if len(ids) > 1 for k in ids}
    assert {r.doc_id for r in got} == expected
    firsts = {min(ids) for ids in holders.values() if len(ids) > 1}
    assert {r.doc_id for r in got if r.kept} == firsts
    for r in got:
        assert r.first_doc_id in firsts
        assert 20 <= r.n_words <= 92


def test_later_copies_are_cut_out(spark):
    rows, passages, holders = planted(4)
    docs = llm_data.documents(spark, rows)
    left = {r.doc_id: r.text for r in cd.drop_repeats(docs).collect()}
    assert len(left) == len(rows)
    for p, ids in holders.items():
        for k in ids:
            if k == min(ids):
                assert passages[p] in left[k]
            else:
                assert len(rows[k][1]) - len(left[k]) > 0.4 * len(passages[p])
    for k, text, *_ in rows:
        if not any(k in ids for ids in holders.values()):
            assert left[k] == text


def test_awkward_documents(spark):
    docs = llm_data.documents(spark)
    rows = cd.passages(docs).collect()
    assert {r.doc_id for r in rows} >= {14, 15, 17, 18, 100, None}
    assert all(r.n_words >= cd.LEAST_WORDS for r in rows)


def letters(rng, n):
    return " ".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))


def numbers(rng, n):
    return " ".join(str(rng.randint(10, 99)) for _ in range(n))


def han(rng, n):
    return "".join(chr(rng.randint(0x4E00, 0x7000)) for _ in range(n))


@pytest.mark.parametrize(
    "write, n, around, between",
    [
        (llm_data.words, 51, 80, " "), (numbers, 51, 80, " "), (numbers, 60, 80, " "),
        (letters, 51, 80, " "), (letters, 60, 80, " "), (han, 400, 300, ""), (han, 3000, 300, ""),
    ],
)
def test_passages_of_over_50_words_are_found(spark, write, n, around, between):
    rng = random.Random(n)
    rows = []
    for _ in range(300):
        passage = write(rng, n)
        for _ in range(2):
            parts = [write(rng, around), passage, write(rng, around)]
            rows.append((len(rows), between.join(parts), None, None))
    rows += [(1000 + i, write(rng, 2 * around), None, None) for i in range(300)]
    found = {r.doc_id for r in cd.passages(llm_data.documents(spark, rows)).collect()}
    assert sum(i in found for i in range(600)) >= 0.99 * 600
    assert not any(i >= 1000 for i in found)


def brute(rows, least_near):
    """``passages`` by counting all units in one dict and walking over each text."""
    texts = [(doc_id, at, (text or "").encode()) for at, (doc_id, text, *_) in enumerate(rows)]
    where, own = {}, {}
    for doc_id, at, data in texts:
        if data:
            array = np.frombuffer(data, dtype=np.uint8)
            ends, words = cd.chunk_ends(array), cd.word_starts(array)
            own[at] = list(zip(*(c.tolist() for c in cd.units(array, ends, words)))), ends.tolist(), words
            for digest, *_ in own[at][0]:
                where.setdefault(digest, []).append(at)
    runs = []
    for doc_id, at, data in texts:
        if not data:
            continue
        found, ends, words = own[at]
        starts = [0, *ends[:-1]]
        run = []
        for digest, first, last in [*found, (None, len(data), None)]:
            if digest is not None and len(where[digest]) < 2:
                continue
            if run and first > max(n for *_, n in run):
                low, high = starts[run[0][1]], ends[max(n for *_, n in run)]
                n_words = sum(low <= w < high for w in words)
                near = sum(low - cd.NEAR_BYTES <= w < high + cd.NEAR_BYTES for w in words)
                if n_words >= cd.LEAST_WORDS and near >= least_near:
                    runs.append((doc_id, low, high, int(n_words)))
                run = []
            run.append((digest, first, last))
    return sorted(runs, key=repr)


@pytest.mark.parametrize("least_near", [cd.LEAST_NEAR, 60])
def test_passages_are_those_of_brute_force(spark, least_near):
    rows = llm_data.awkward_rows() + planted(8)[0]
    rng = random.Random(1)
    passage = letters(rng, 70)
    rows += [(300 + i, f"{numbers(rng, 40)} {passage[i * 20 :]} {llm_data.words(rng, 40)}", None, None) for i in range(5)]
    got = cd.passages(llm_data.documents(spark, rows), least_near).collect()
    assert sorted(((r.doc_id, r.start, r.end, r.n_words) for r in got), key=repr) == brute(rows, least_near)


def test_words_of_stretches_without_white_space():
    assert cd.word_starts(as_bytes("ab " + "x" * 30 + "  c")).tolist() == [0, 3, 15, 27, 35]
    assert cd.word_starts(as_bytes("ab cd")).tolist() == [0, 3]
    assert cd.word_starts(as_bytes("x" * 12)).tolist() == [0]
    assert cd.word_starts(as_bytes("x" * 13)).tolist() == [0, 12]
    assert cd.word_starts(as_bytes(" ")).tolist() == cd.word_starts(as_bytes("")).tolist() == []


def test_empty_table(spark):
    assert cd.passages(llm_data.empty(spark)).count() == 0
    assert cd.passages(llm_data.documents(spark, [(1, None, None, None), (2, "", None, None)])).count() == 0


def full_map(*args):
    return np.full(cd_bit_map(*args).shape, 255, dtype=np.uint8)


cd_bit_map = cd.bit_map


def test_chunks_that_repeat_apart_make_no_passage(spark, monkeypatch):
    monkeypatch.setattr(cd, "bit_map", full_map)
    rng = random.Random(5)
    text = llm_data.words(rng, 60)
    ends = cd.chunk_ends(as_bytes(text)).tolist()
    rows = [(0, text, None, None)]
    # Every chunk occurs in another document, with the bytes before that its cut needs.
    for k, (low, high) in enumerate(zip([0, *ends], ends)):
        before, after = llm_data.words(rng, 30), llm_data.words(rng, 30)
        rows.append((k + 1, before + text[max(low - 30, 0) : high] + " " + after, None, None))
    assert cd.passages(llm_data.documents(spark, rows)).collect() == []


def test_a_full_map_changes_nothing(spark, monkeypatch):
    # All of a long passage repeats, but each part in a document with a short run only.
    rows, *_ = planted(6)
    passage = llm_data.words(random.Random(7), 60)
    rows += [(100 + k, passage[at : at + 130], None, None) for k, at in enumerate(range(0, 400, 30))]
    docs = llm_data.documents(spark, [*rows, (200, passage, None, None)])
    expected = sorted(map(str, cd.passages(docs).collect()))
    monkeypatch.setattr(cd, "bit_map", full_map)
    assert sorted(map(str, cd.passages(docs).collect())) == expected
