import random

import numpy as np
import pytest

import llm_data
from tallyforge.llm import jaccard_join as jj
from tallyforge.llm.components import components


def shingles(text):
    w = (text or "").encode().lower().split()
    if len(w) < 5:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def brute(rows):
    """``row number -> (n_shingles, component)`` with the least row number of each component."""
    sets = [shingles(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sets, [find(i) for i in range(len(rows))]


def expected(rows):
    sets, component = brute(rows)
    least = {}
    for (doc_id, *_), c in zip(rows, component):
        if doc_id is not None:
            least[c] = min(least.get(c, doc_id), doc_id)
    return sorted(
        ((r[0], len(s), least.get(c) if s else r[0]) for r, s, c in zip(rows, sets, component)), key=repr
    )


def got(spark, rows):
    found = jj.near_duplicates(llm_data.documents(spark, rows))
    return sorted(map(tuple, jj.component_ids(found).collect()), key=repr)


def varied(seed, n=160):
    """Texts at all distances of each other, of many sizes, sharing passages."""
    rng = random.Random(seed)
    passage = llm_data.words(rng, 40)
    rows = []
    for k in range(n):
        if k % 4 == 0 or not rows:
            size = rng.choice([1, 3, 5, 6, 8, 12, 20, 60, 200, 700])
            text = llm_data.words(rng, size)
            if k % 8 == 0:
                text += " " + passage
        else:
            w = rng.choice(rows[-12:])[1].split()
            for _ in range(rng.choice([0, 1, 1, 2, 3, max(1, len(w) // 40), max(1, len(w) // 25)])):
                at = rng.randrange(len(w)) if w else 0
                w[at : at + rng.choice([0, 1, 1, 2])] = llm_data.words(rng, rng.choice([0, 1, 2])).split()
            text = " ".join(w) or "x"
        rows.append((k, text, None, None))
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_components_are_those_of_brute_force(spark, seed):
    rows = varied(seed)
    assert got(spark, rows) == expected(rows)


def templated(rng, n, share, edits=0, size=80, spread=0):
    """Texts of which a share is one template; some are near copies of others."""
    template = llm_data.words(rng, int(size * share)).split()
    rows = []
    for k in range(n):
        words = list(template)
        for _ in range(edits):
            words[rng.randrange(len(words))] = llm_data.words(rng, 1)
        words += llm_data.words(rng, round(size * (1 - share)) + rng.randint(-spread, spread)).split()
        rows.append((k, " ".join(words), None, None))
    for k in range(0, n, 3):
        words = rows[rng.randrange(n)][1].split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = llm_data.words(rng, 1)
        rows.append((n + k, " ".join(words), None, None))
    return rows


@pytest.mark.parametrize(
    "share, edits, spread",
    [(0.6, 0, 0), (0.7, 1, 0), (0.85, 0, 0), (0.85, 0, 9), (0.88, 1, 0), (0.95, 1, 9)],
)
def test_groups_of_a_template_are_those_of_brute_force(spark, monkeypatch, share, edits, spread):
    monkeypatch.setattr(jj, "SMALL_GROUP", 3)
    monkeypatch.setattr(jj, "COMMON_FROM", 12)
    monkeypatch.setattr(jj, "TILE", 8)
    rows = templated(random.Random(int(100 * share) + edits), 60, share, edits, spread=spread)
    assert got(spark, rows) == expected(rows)


@pytest.mark.parametrize("common", ["none", "half"])
def test_any_choice_of_common_shingles_is_right(spark, monkeypatch, common):
    monkeypatch.setattr(jj, "SMALL_GROUP", 3)
    monkeypatch.setattr(jj, "TILE", 8)
    choose = jj.common_shingles
    monkeypatch.setattr(jj, "common_shingles", lambda sets: choose(sets)[:: {"none": 10**9, "half": 2}[common]])
    rows = templated(random.Random(3), 60, 0.85)
    assert got(spark, rows) == expected(rows)


def compared(spark, monkeypatch, n, share):
    """How many pairs are left to be compared in groups of a template."""
    counts = []
    inner = jj.remaining_pairs

    def counted(*args):
        pairs = inner(*args)
        counts.append(pairs.count())
        return pairs

    monkeypatch.setattr(jj, "remaining_pairs", counted)
    monkeypatch.setattr(jj, "TILE", 64)
    rng = random.Random(1)
    rows = templated(rng, n, share, size=200)
    found = jj.near_duplicates(llm_data.documents(spark, rows, clashing=False))
    monkeypatch.setattr(jj, "remaining_pairs", inner)
    return found.members.count(), counts[0]


def test_pairs_compared_grow_with_the_group(spark, monkeypatch):
    for n in (250, 1000):
        documents, pairs = compared(spark, monkeypatch, n, 0.85)
        assert pairs <= 5 * documents


def test_awkward_documents(spark):
    rows = llm_data.awkward_rows()
    assert got(spark, rows) == expected(rows)


def test_copies_share_a_node_and_links_are_alike(spark):
    rows = varied(9)
    found = jj.near_duplicates(llm_data.documents(spark, rows))
    texts = {}
    for r in found.members.collect():
        texts.setdefault(r.set_id, shingles(rows[r.doc_id][1]))
    for a, b, jaccard in found.links.collect():
        inter, union = len(texts[a] & texts[b]), len(texts[a] | texts[b])
        assert jaccard == pytest.approx(inter / union) and 100 * inter >= 75 * union


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    rng = random.Random(4)
    texts = [llm_data.words(rng, 300), "x" * 500 + " y " + "z" * 200, " a\tb\x0bc ", "É é A a"]
    whole = [jj.word_hashes(t).tolist() for t in texts]
    for size in (1, 7, 64):
        monkeypatch.setattr(jj, "HASHED_AT_ONCE", size)
        assert [jj.word_hashes(t).tolist() for t in texts] == whole
    for t, hashes in zip(texts, whole):
        words = t.encode().lower().split()
        assert len(hashes) == len(words)
        assert len(set(hashes)) == len(set(words))


def test_differing_blocks_bound_the_difference():
    rng = np.random.default_rng(0)
    for n in (3, 40, 500, 3000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate((a[: n - n // 5], rng.integers(0, 1 << 63, n // 6).astype(np.uint64))))
        difference = len(np.setxor1d(a, b))
        assert jj.bit_distance(jj.bit_sketch(a), jj.bit_sketch(b)) <= difference
        band, blocks, _ = jj._bands(n)[0]
        x, y = jj._sketches(a, band, blocks), jj._sketches(b, band, blocks)
        assert len(np.setdiff1d(x, y)) <= difference


@pytest.mark.parametrize("n", [1, 2, 3, 4, 15, 16, 63, 64, 100, 255, 256, 900, 5000])
def test_sets_fill_more_blocks_than_may_differ(n):
    rng = np.random.default_rng(n)
    for _ in range(20):
        s = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        for band, blocks, _ in jj._bands(n):
            assert len(jj._sketches(s, band, blocks)) > 2 * n // 7


@pytest.mark.parametrize("n", [4, 7, 15, 16, 31, 63, 64, 65, 130, 255, 256, 500, 1100, 3000])
def test_pairs_at_the_threshold_share_a_key(n):
    rng = np.random.default_rng(n)
    nothing = jj.Order(np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
    for _ in range(20):
        s = rng.permutation(np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2)))
        common = -(-3 * len(s) // 4)
        own = common + rng.integers(0, len(s) - common + 1)
        a, b = np.sort(s[:own]), np.sort(np.concatenate((s[:common], s[own:])))
        # Any list of common sketches in any order will do.
        some = np.concatenate([jj._sketches(a, band, blocks) for band, blocks, _ in jj._bands(len(a))])
        some = np.sort(rng.permutation(some)[: len(some) // 2])
        for order in (nothing, jj.Order(some, rng.permutation(len(some)))):
            assert len(np.intersect1d(jj.join_keys(a, order), jj.join_keys(b, order)))


def test_bit_map_misses_nothing(spark):
    from pyspark.sql import functions as F

    values = spark.range(3000).select(F.xxhash64("id").alias("h"))
    bits = jj.bit_map(values, F.col("h"))
    hashes = np.array([r.h for r in values.collect()])
    assert jj.in_bit_map(bits, hashes).all()
    assert jj.in_bit_map(bits, hashes ^ np.int64(0x155555)).mean() < 0.01


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(300, 299), (7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {k: 100 for k in range(100, 160)} | {299: 299, 300: 299}


def test_one_of_each_component_stays(spark):
    rows = [r for r in varied(2) if r[0] is not None]
    docs = llm_data.documents(spark, rows)
    kept = jj.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in expected(rows)})


def test_empty_table(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, None, None, None)]) == [(1, 0, 1)]
