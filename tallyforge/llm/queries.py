"""The operators applied to their tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import (
    chunk_dedup,
    decontamination,
    exact_dedup,
    hard_negatives,
    html_text,
    jaccard_join,
    language_mix,
    license_scan,
    packing,
    periodic_runs,
    quality,
    resharding,
    url_filter,
)
from tallyforge.llm.common import table

TOKENIZER = "word_bpe_49k.json"


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return packing.pack(documents, public_tokenizers.path(TOKENIZER))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))
    return jaccard_join.component_ids(found)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


def op6_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.passages(table(spark, sf_dir, "documents"))


def op7_language_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_mix.predict(table(spark, sf_dir, "documents"))


def op8_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Documents lie by source, which leaves one shard with a third of them.
    documents = table(spark, sf_dir, "documents")
    by_source = F.pmod(F.crc32(F.coalesce("source", F.lit("")).cast("binary")), F.lit(16))
    return resharding.digest(resharding.reshard(documents, by_source))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.exact_groups(table(spark, sf_dir, "documents"))
    return groups.select(*exact_dedup.QUERY_COLUMNS)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.fit(url_filter.word_labels(pages)))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_html_text": op1_html_text,
    "op2_packing": op2_packing,
    "op3_quality": op3_quality,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_decontamination": op5_decontamination,
    "op6_chunk_dedup": op6_chunk_dedup,
    "op7_language_mix": op7_language_mix,
    "op8_resharding": op8_resharding,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_url_filter": op10_url_filter,
    "op11_license_scan": op11_license_scan,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLES = {
    "op4_jaccard_join": jaccard_join.ORACLE_SQL,
    "op5_decontamination": decontamination.ORACLE_SQL,
    "op9_exact_dedup": exact_dedup.ORACLE_SQL,
    "op12_periodic_runs": periodic_runs.ORACLE_SQL,
    "op13_hard_negatives": hard_negatives.ORACLE_SQL,
}
