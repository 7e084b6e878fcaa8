import hashlib
import random
import re

import numpy as np
import pytest

import llm_data
from tallyforge.llm import decontamination as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items):
    windows = []
    for item_id, text in items:
        w = words_of(text)
        for i in range(max(1, len(w) - 9)) if w else ():
            windows.append((item_id, w[i : i + 10]))
    out = []
    for doc_id, text in docs:
        w, hit, found = words_of(text), set(), set()
        for item_id, window in windows:
            for p in range(len(w) - len(window) + 1):
                if w[p : p + len(window)] == window:
                    hit.update(range(p, p + len(window)))
                    found.add(str(item_id))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=repr)


def cases():
    rng = random.Random(3)
    items = [(i, llm_data.words(rng, n)) for i, n in enumerate([37, 10, 9, 3, 1, 12])]
    items += [(20, items[0][1].upper()), (3, "--- !!"), (30, None), (31, ""), (5, items[1][1])]
    docs = [(i, t) for i, (_, t, *_) in enumerate(llm_data.awkward_rows())]
    for k in range(30):
        text = llm_data.words(rng, 30)
        item = items[k % 7][1]
        if k % 4 == 1:
            text += " " + item + ", " + item
        if k % 4 == 2:
            part = item.split()
            text = " ".join(part[: max(1, len(part) - 4)]) + " " + text
        docs.append((1000 + k, text))
    return docs, items


@pytest.mark.parametrize("settings", [{}, {"segment_words": 50}, {"block_words": 15}])
def test_hits_are_those_of_brute_force(spark, settings):
    docs, items = cases()
    table = llm_data.documents(spark, [(*d, None, None) for d in docs])
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = dc.contamination(table, benchmark, **settings)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, items)


def test_repeated_and_null_ids(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(1, item), (1, "other"), (None, item), (None, "more"), (1, item)]
    table = llm_data.documents(spark, [(*r, None, None) for r in rows])
    benchmark = spark.createDataFrame([(9, item)], "item_id long, text string")
    got = dc.contamination(table, benchmark)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, [(9, item)])
    left = dc.drop_contaminated(table, benchmark)
    assert left.columns == table.columns
    assert sorted(r.text for r in left.collect()) == ["more", "other"]


def test_one_index_serves_any_benchmark(spark):
    docs, items = cases()
    index = dc.build_index(llm_data.documents(spark, [(*d, None, None) for d in docs]), 500)

    def found(items, block_words):
        benchmark = spark.createDataFrame(items, "item_id long, text string")
        rows = set()
        for block in dc.blocks(benchmark, block_words):
            rows |= {tuple(r) for r in dc.search(index, block, "bigint").collect()}
        return rows

    every = found(items, 10**6)
    assert every and found(items, 20) == every
    assert found(items[:1], 10**6) == {r for r in every if r[2] == items[0][0]}


def test_index_holds_all_words(spark):
    docs, _ = cases()
    index = dc.build_index(llm_data.documents(spark, [(*d, None, None) for d in docs]), 300)
    words = sorted(w for _, t in docs for w in words_of(t))
    got = []
    for r in index.collect():
        counts = np.frombuffer(r.counts, dtype="<i4")
        assert len(r.places) == 4 * counts.sum()
        got += [t.decode() for t, n in zip(map(bytes, r.terms), counts) for _ in range(n)]
    assert sorted(got) == words


def test_proximity(spark):
    item = "red orange yellow green blue indigo violet black white grey"
    near = "filler grey then white then black and violet end"
    far = "grey " + "filler " * 40 + "white " + "filler " * 40 + "black " + "filler " * 40 + "violet"
    # The other words of the item are common, so the four are the rarest.
    rest = " ".join(w + " filler" * 20 for w in item.split()[:6] * 5)
    rows = [(1, near), (2, far), (3, rest), (4, item + " and so on")]
    table = llm_data.documents(spark, [(*r, None, None) for r in rows]).coalesce(1)
    benchmark = spark.createDataFrame([(9, item)], "item_id long, text string")

    def found(**settings):
        indexed, matches = dc.find(table, benchmark, **settings)
        rows = matches.join(indexed, ["segment", "ordinal"]).collect()
        return {(r.doc_id, r.kind, r.start, r.end) for r in rows}

    assert found() == {(4, "phrase", 0, 10)}
    both = {(4, "phrase", 0, 10), (1, "proximity", 1, 8)}
    assert found(near_terms=4, near_words=16) == both
    assert found(near_terms=4, near_words=16, segment_words=1) == both
    table = table.filter("doc_id != 4")
    assert found(near_terms=4, near_words=16) == {(1, "proximity", 1, 8)}
    assert found(near_terms=4, near_words=3) == set()


def test_empty_tables(spark):
    benchmark = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert dc.contamination(llm_data.empty(spark), benchmark).count() == 0
    none = dc.contamination(llm_data.documents(spark), benchmark.filter("false"))
    assert {r.contaminated for r in none.collect()} == {False}
    assert none.count() == len(llm_data.awkward_rows())
