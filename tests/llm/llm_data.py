"""Small documents with every awkward case, and the given small tables."""

import random

SMALL = "/root/testdata/sf0.001"

# Columns whose names the operators use themselves.
CLASHING = (
    "key string, text_hash string, n_bytes int, bucket string, slot string, size string, shard "
    "string, segment string, ordinal string, start string, _text string, _gone string, set_id "
    "string, run string, window string, label string, kept string"
)
N_CLASHING = len(CLASHING.split(","))


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(n))


def awkward_rows(seed=1):
    """``doc_id, text, lang, source`` with nulls, ties, copies and long texts."""
    rng = random.Random(seed)
    base = words(rng, 120)
    near = base.split()
    near[60] = "changed"
    texts = [
        None, None, "", "   ", "\n", "one", "One", "one two", "a b c d", "a b c d e",
        "tab\tand\x0bvt", "naïve Ünïcode ß 日本語 ", "é́ combining", "\x00 control \x1f",
        base, base, base.upper(), " ".join(near), base + " tail of some words here",
        words(rng, 40), words(rng, 5000), "x" * 20000, "word " * 3000, "<|endoftext|> raw",
    ]
    rows = [(i, t, ("en", "de", None)[i % 3], ("s0", None)[i % 2]) for i, t in enumerate(texts)]
    rows += [(100, base, "en", "s0"), (100, base, "en", "s0"), (None, base, "en", None)]
    rows += [(None, "no id", None, None), (None, None, None, None), (7, "id used twice", "en", "s1")]
    return rows


def documents(spark, rows=None, clashing=True):
    rows = awkward_rows() if rows is None else rows
    schema = "doc_id bigint, text string, lang string, source string"
    if clashing:
        rows = [(*r, *[None] * N_CLASHING) for r in rows]
        schema += ", " + CLASHING
    return spark.createDataFrame(rows, schema).repartition(3)


def empty(spark):
    return documents(spark, [])
