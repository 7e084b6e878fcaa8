import random
import re

import pytest

import llm_data
from tallyforge.llm import license_scan as ls

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_base(text):
    words = words_of(text)
    found = [
        (i, label)
        for i in range(len(words))
        for phrase, label in ls.BASE_PHRASES.items()
        if words[i : i + len(phrase.split())] == phrase.split()
    ]
    places = [i for i, _ in found]
    labels = ",".join(sorted({label for _, label in found}))
    return len(words), len(found), min(places, default=None), max(places, default=None), labels


def brute_labels(text):
    words, labels = words_of(text), set()
    for table in (ls.BASE_PHRASES, ls.NOTICES):
        for phrase, label in table.items():
            n = len(phrase.split())
            if any(words[i : i + n] == phrase.split() for i in range(len(words))):
                labels.add(label)
    return labels


PHRASES = [*ls.BASE_PHRASES, *ls.NOTICES]


def random_text(rng):
    parts = []
    for _ in range(rng.randint(0, 12)):
        if rng.random() < 0.5:
            words = rng.choice(PHRASES).split()
            cut = rng.randint(0, 1) if rng.random() < 0.3 else 0
            words = words[cut:]
        else:
            words = [rng.choice(["cc", "by", "all", "öffentlich", "license", "rights", "x1", "license's"])]
        parts += [w.upper() if rng.random() < 0.3 else w for w in words]
    return "".join(p + rng.choice([" ", "-", "\n", ", ", " \x00 ", "\x7f", "__"]) for p in parts)


def row_of(text):
    return ls.Scanner(ls.BASE_PHRASES, ls.NOTICES, ls.TAGS).scan(text)


def test_places_and_labels_are_those_of_brute_force():
    rng = random.Random(3)
    for text in [random_text(rng) for _ in range(1500)]:
        got = row_of(text)
        names = ("n_words", "n_base", "first_word", "last_word", "base_labels")
        assert tuple(got[n] for n in names) == brute_base(text), text
        assert set(got["labels"].split(",")) - {""} == brute_labels(text), text


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = ls.scan(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        expected = brute_base(texts[r.doc_id])
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == expected
        assert set(r.labels.split(",")) - {""} == brute_labels(texts[r.doc_id])
        assert 0 <= r.score < 1 and (r.score > 0) == (r.labels != "")
    assert {"apache", "mit", "gpl", "cc-by", "cc-by-nc", "reserved"} <= {
        label for r in rows for label in r.labels.split(",")
    }


@pytest.mark.parametrize(
    "text, labels, terms, expressions",
    [
        ("# SPDX-License-Identifier: MIT", "mit", "permissive", ["mit"]),
        ("// SPDX-License-Identifier: GPL-2.0-only OR MIT */", "gpl,mit", "permissive", ["gpl-2.0-only or mit"]),
        ("license: MIT AND GPL-3.0-or-later", "gpl,mit", "copyleft", ["mit and gpl-3.0-or-later"]),
        # and binds closer than or, with closer than and
        ("License: AGPL-3.0 AND GPL-2.0 OR MIT", "agpl,gpl,mit", "permissive", ["agpl-3.0 and gpl-2.0 or mit"]),
        ("License: AGPL-3.0 AND (GPL-2.0 OR MIT)", "agpl,gpl,mit", "network copyleft", ["agpl-3.0 and ( gpl-2.0 or mit )"]),
        ("License: MIT AND GPL-2.0+ WITH Classpath-exception-2.0", "gpl,mit", "weak copyleft", ["mit and gpl-2.0+ with classpath-exception-2.0"]),
        ('{"license": "MIT OR Apache-2.0"}', "apache,mit", "permissive", ["mit or apache-2.0"]),
        ("Licensed under MIT. Or not", "mit", "permissive", ["mit"]),
        ("License: MIT OR", "mit", "permissive", ["mit"]),
        ("License: (MIT OR Apache-2.0", "", None, []),
        ("License: MIT) OR Apache-2.0", "mit", "permissive", ["mit"]),
        ("License: MIT WITH nothing", "mit", "permissive", ["mit"]),
        ("License: (MIT) WITH x-exception", "mit", "permissive", ["( mit )"]),
        ("License: the usual", "", None, []),
        ("sublicense: MIT", "", None, []),
        ("SPDX-License-Identifier: LicenseRef-Mine", "licenseref", "restricted", ["licenseref-mine"]),
        ("License: MIT\nOR Apache-2.0", "mit", "permissive", ["mit"]),
        ("GNU Lesser General Public License", "gpl,lgpl", "weak copyleft", []),
        ("CC BY-NC 4.0", "cc-by,cc-by-nc", "restricted", []),
    ],
)
def test_expressions(text, labels, terms, expressions):
    got = row_of(text)
    assert (got["labels"], got["terms"], got["expressions"]) == (labels, terms, expressions)


def brute_level(tree):
    if isinstance(tree, str):
        return ls.LEVELS[ls.family(tree)]
    op, left, right = tree
    if op == "with":
        return min(brute_level(left), ls.WEAK)
    return (min if op == "or" else max)(brute_level(left), brute_level(right))


def random_tree(rng, depth):
    if depth == 0 or rng.random() < 0.3:
        name = rng.choice(["MIT", "GPL-3.0-only", "LGPL-2.1+", "AGPL-3.0", "CC-BY-NC-4.0", "CC0-1.0"])
        return ("with", name.lower(), "some-exception-1.0") if rng.random() < 0.2 else name.lower()
    return rng.choice(["or", "and"]), random_tree(rng, depth - 1), random_tree(rng, depth - 1)


def text_of(tree, outer=0):
    if isinstance(tree, str):
        return tree
    own = ls.BINDING[tree[0]]
    # The left side of equal binding needs no parentheses.
    inside = f"{text_of(tree[1], own)} {tree[0]} {text_of(tree[2], own + 1)}"
    return f"({inside})" if own < outer else inside


def test_random_expressions_are_those_of_their_trees():
    rng = random.Random(9)
    for _ in range(500):
        tree = random_tree(rng, 5)
        (found,) = row_of(f"SPDX-License-Identifier: {text_of(tree).upper()}\n x")["expressions"]
        assert found.replace(" ", "") == text_of(tree).replace(" ", "")
        assert ls.TERMS.index(row_of(f"license: {text_of(tree)}")["terms"]) == brute_level(tree)


def test_awkward_documents(spark):
    rows = ls.scan(llm_data.documents(spark)).collect()
    assert len(rows) == len(llm_data.awkward_rows())
    empty = [r for r in rows if not r.n_words]
    assert len(empty) >= 5
    for r in empty:
        assert tuple(r)[1:] == (0, 0, None, None, "", "", 0.0, None, [])
    assert ls.scan(llm_data.empty(spark)).count() == 0


def test_long_texts_take_time_in_proportion():
    got = row_of("License: (MIT or cc by " * 50_000 + "(" * 100_000)
    assert got["n_base"] == 50_000 and got["last_word"] == 49_999 * 5 + 3
    assert row_of("license: " * 100_000)["n_words"] == 100_000
    assert row_of("license: " + "mit or " * 100_000)["expressions"]
