"""The registered queries on the given tables, and the pipeline."""

import importlib.util
import sys

import pytest

import corpus_pipeline
import llm_data
import test_decontamination
import test_jaccard_join
import test_packing
from tallyforge.llm import quality
from tallyforge.llm.common import shared_folder, written
from tallyforge.llm.queries import ORACLES, QUERIES

SPARK_TYPE = {"VARCHAR": "string", "INTEGER": "int"}
ROWS_OF = {name: "pages" if name in ("op1_html_text", "op10_url_filter") else "documents" for name in QUERIES}


def test_every_operator_has_a_query():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name, sf):
    root = f"/root/testdata/{sf}"
    df = QUERIES[name](spark, root)
    expected = duck(root, ORACLES[name])
    types = [SPARK_TYPE.get(str(t), str(t).lower()) for t in expected.types]
    assert dict(df.dtypes) == dict(zip(expected.columns, types))
    rows = df.select(*expected.columns).collect()
    assert sorted(map(tuple, rows)) == sorted(expected.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"op2_packing", "op6_chunk_dedup", "op13_hard_negatives"}))
def test_query_has_a_row_for_each_row(spark, name):
    table = spark.read.parquet(f"{llm_data.SMALL}/{ROWS_OF[name]}.parquet")
    assert QUERIES[name](spark, llm_data.SMALL).count() == table.count()


def test_shared_folder_is_the_sessions(spark, tmp_path, monkeypatch):
    class Conf:
        def get(self, key, default):
            return str(tmp_path)

    class Session:
        conf = Conf()

    assert shared_folder(Session()) == str(tmp_path)
    assert shared_folder(spark) == shared_folder(spark)
    assert written(spark.range(3), "x").count() == 3


def test_pipeline_by_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = {
        r.doc_id: r.quality
        for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    }
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = written(stage(spark, before, "/root/testdata/sf0.01"), name)
        assert after.columns == columns
        kept = {r.doc_id for r in after.select("doc_id").collect()}
        assert kept < {r.doc_id for r in before.select("doc_id").collect()}
        if name == "quality_classifier":
            good = [i for i, q in labels.items() if q == 1]
            assert sum(i in kept for i in good) / len(good) > 0.99
        if name == "exact_dedup":
            assert after.select("text").distinct().count() == after.count()
        before = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, before, "/root/testdata/sf0.01").collect()
    assert {r.doc_id for r in pieces} == kept


def test_pipeline_is_that_of_brute_force(spark):
    root = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{root}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{root}/benchmark.parquet").select("item_id", "text").collect()]
    # What the fitted scorer rejects is taken from it; the rest is worked out here.
    good = {r.doc_id for r in quality.classify(docs).filter("kept").collect()}
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect() if r.doc_id in good]
    last = {}
    for doc_id, text in sorted(rows):
        last[text or ""] = (doc_id, text)
    rows = sorted(last.values())
    _, component = test_jaccard_join.brute(rows)
    rows = [r for i, r in enumerate(rows) if component[i] == i]
    hits = test_decontamination.brute(rows, items)
    clean = {doc_id for doc_id, *_, hit in hits if not hit}
    expected = {doc_id: text for doc_id, text in rows if doc_id in clean}
    assert 0 < len(expected) < len(component) < docs.count()
    test_packing.check(corpus_pipeline.run(spark, root).collect(), expected)


def test_near_duplicates_of_the_given_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{llm_data.SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op4_jaccard_join"](spark, llm_data.SMALL).collect()
    assert sorted(map(tuple, got), key=repr) == test_jaccard_join.expected(rows)


def test_pipeline_on_awkward_and_empty_tables(spark, tmp_path):
    root = str(tmp_path)
    benchmark = spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")
    benchmark.write.parquet(f"{root}/benchmark.parquet")
    for docs in (llm_data.documents(spark), llm_data.empty(spark)):
        for name, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, root), name)
        docs.count()


def test_library_does_not_import_the_package():
    assert importlib.util.find_spec("tallyforge.llm")
    import pathlib

    root = pathlib.Path(sys.modules["tallyforge"].__file__).parent
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "llm" not in path.read_text()
