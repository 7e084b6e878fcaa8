"""Exact de-duplication with an extendible-hash index on shared files.

A text's key is a 64-bit hash. The index is a directory of buckets, each of which
owns a range of keys: a bucket stands for the keys that share its leading bits,
and a bucket with more keys than it may hold is split in two by one more bit,
which doubles the directory where its depth was already the greatest. Texts
whose keys collide are chained in their bucket and told apart byte by byte.

Everything here is built of DataFrame functions:

1. One scan writes a thin entry per document (key, digest, size) to the shared
   folder; no text is kept.
2. The directory is worked out from counts of keys under every prefix. A bucket
   is the shortest prefix that fits, which is where repeated splitting stops.
3. A second scan deals texts to owner tasks by the directory's slots, which are ranges
   of keys. An owner brings the texts of a key together, compares them byte by byte,
   numbers the chain of different ones, and decides which document of each stays.
4. Keys of very many documents, a bounded number, are dealt after their copies were
   combined in the scan's tasks: a text that a third of all documents repeat costs its
   owner a row.
5. The owners' rows are written with their buckets, and every entry finds its text's row
   by key and digest.

Nulls count as empty texts. Documents that repeat a ``doc_id`` with the same text
are one document to the rule, so all of them are kept or none; a null ``doc_id``
stays only where its text has no other id. An empty table gives an empty index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.llm.common import text_or_empty, written

# Distinct keys that a bucket may hold before it is split.
BUCKET_KEYS = 4096
# Bits by which a directory may be deeper than evenly spread keys would need.
SPARE_BITS = 4
# At most so many keys are those of very many documents: each has one in so many of all.
MAX_HOT_KEYS = 4096

KEY_BITS = 64


def _key(text: Column) -> Column:
    return F.xxhash64(text)


def _prefix(key: Column, bits: int | Column) -> Column:
    """The leading bits of a key, 0 for none."""
    if isinstance(bits, int):
        return F.shiftrightunsigned(key, KEY_BITS - bits) if bits else F.lit(0).cast("bigint")
    return F.call_function("shiftrightunsigned", key, bits)


def entries(documents: DataFrame) -> DataFrame:
    """``doc_id, key, n_bytes, text_sha256`` of every document."""
    text = text_or_empty()
    return documents.select(
        "doc_id",
        _key(text).alias("key"),
        F.octet_length(text).cast("bigint").alias("n_bytes"),
        F.sha2(text.cast("binary"), 256).alias("text_sha256"),
    )


def directory(keys: DataFrame, bucket_keys: int = BUCKET_KEYS) -> tuple[DataFrame, int]:
    """``slot, local_depth, bucket`` for each filled slot, and the directory's depth.

    ``keys`` has a column ``key``. A slot is a prefix of as many bits as the
    deepest bucket may have. The depth is set by the number of distinct keys; a
    bucket that is overfull even there keeps a longer chain.
    """
    distinct = keys.select("key").distinct()
    n_keys = distinct.count()
    depth = max(0, (n_keys // bucket_keys).bit_length()) + SPARE_BITS
    slots = distinct.groupBy(_prefix(F.col("key"), depth).alias("slot")).agg(
        F.count("*").alias("n")
    )
    nodes = (
        slots.select("slot", "n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("bits"))
        .withColumn("node", F.call_function("shiftright", "slot", F.lit(depth) - F.col("bits")))
    )
    fitting = (
        nodes.groupBy("bits", "node")
        .agg(F.sum("n").alias("n"))
        .filter((F.col("n") <= bucket_keys) | (F.col("bits") == depth))
        .select("bits", "node")
    )
    buckets = (
        nodes.join(fitting, ["bits", "node"])
        .groupBy("slot")
        .agg(F.min(F.struct("bits", "node")).alias("at"))
        .select("slot", F.col("at.bits").alias("local_depth"), F.col("at.node").alias("bucket"))
    )
    return buckets, depth


def hot_keys(keys: DataFrame, least: int) -> DataFrame:
    """``key`` of those that very many entries have, ``MAX_HOT_KEYS`` at most, written."""
    least = max(least, keys.count() // MAX_HOT_KEYS)
    counts = keys.groupBy("key").agg(F.count("*").alias("n"))
    return written(counts.filter(F.col("n") > least).select("key"), "exact_hot_keys")


def owned_texts(documents: DataFrame, hot: DataFrame, depth: int) -> DataFrame:
    """What the owners of a directory's slots make of their texts.

    ``slot, key, n_bytes, text_sha256, keep_id, group_size, chain`` of every distinct
    text; ``chain`` numbers the texts that share a key, from 0.
    """
    text = text_or_empty()
    rows = documents.select("doc_id", _key(text).alias("key"), text.alias("text"))
    few = F.broadcast(hot)
    dealt = rows.join(few, "key", "left_anti").select(
        "key", "text", "doc_id", F.lit(1).cast("bigint").alias("n")
    )
    if not hot.isEmpty():
        combined = rows.join(few, "key", "left_semi").groupBy("key", "text")
        dealt = dealt.unionByName(
            combined.agg(F.max("doc_id").alias("doc_id"), F.count("*").alias("n"))
        )
    # Dealt by slot once; nothing after it moves a row.
    return (
        dealt.withColumn("slot", _prefix(F.col("key"), depth))
        .repartition("slot")
        .groupBy("slot", "key", "text")
        .agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size"))
        .select(
            "slot",
            "key",
            F.octet_length("text").cast("bigint").alias("n_bytes"),
            F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
            "keep_id",
            "group_size",
        )
        .withColumn(
            "chain",
            F.row_number().over(Window.partitionBy("slot", "key").orderBy("text_sha256")) - 1,
        )
    )


def build_index(documents: DataFrame, keys: DataFrame, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """The index as a shared table: a row for each distinct text, in its bucket."""
    slots, depth = directory(keys, bucket_keys)
    texts = written(owned_texts(documents, hot_keys(keys, bucket_keys), depth), "exact_texts")
    return written(texts.join(slots, "slot").drop("slot"), "exact_index")


def exact_groups(documents: DataFrame, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """For every document the one that stays of those with its text.

    Returns ``doc_id, keep_id, group_size, kept, text_sha256, bucket, local_depth,
    chain``, a row for each row of ``documents``.
    """
    thin = written(entries(documents), "exact_entries")
    index = build_index(documents, thin, bucket_keys)
    return thin.join(index.drop("n_bytes"), ["key", "text_sha256"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
        "bucket",
        "local_depth",
        F.col("chain").cast("int").alias("chain"),
    )


def drop_copies(documents: DataFrame) -> DataFrame:
    """``documents`` with one document of each text, the one with the largest id.

    Of rows that repeat id and text one stays, any of them.
    """
    ids = exact_groups(documents).filter("kept")
    # Texts tell documents apart whose ids are equal or null.
    kept = written(
        ids.groupBy("doc_id", "text_sha256").agg(F.count("*").alias("_rows")), "exact_kept"
    ).select(F.col("doc_id").alias("_kept_id"), F.col("text_sha256").alias("_kept_text"), "_rows")

    def rows_of(kept: DataFrame) -> DataFrame:
        same = documents["doc_id"].eqNullSafe(F.col("_kept_id")) & (
            F.sha2(text_or_empty().cast("binary"), 256) == F.col("_kept_text")
        )
        return documents.join(kept, same, "left_semi")

    once, repeated = kept.filter("_rows = 1"), kept.filter("_rows > 1")
    if repeated.isEmpty():
        return rows_of(kept)
    return rows_of(once).unionByName(rows_of(repeated).dropDuplicates(["doc_id", "text"]))


QUERY_COLUMNS = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]

ORACLE_SQL = """
    SELECT doc_id,
           max(doc_id) OVER same AS keep_id,
           count(*) OVER same AS group_size,
           doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept,
           sha256(coalesce(text, '')) AS text_sha256
    FROM documents
    WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
