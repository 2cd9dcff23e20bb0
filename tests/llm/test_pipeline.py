"""The pipeline stage by stage, its end to end form, and the registered queries."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as contract
import corpus_pipeline
from reviewlake.llm import queries
from reviewlake.sources.folders import stored


def test_names_are_registered():
    names = set(contract.queries())
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(queries.QUERIES) | {"pipeline"} <= names and set(contract.oracle_sql()) <= names


@pytest.fixture(scope="module")
def outputs(spark, sf_dir):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"test-{name}")
        out.append(docs)
    return out


def test_stages(spark, sf_dir, outputs):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert all(o.schema == docs.schema for o in outputs[:-1])
    ids = [[r.doc_id for r in o.select("doc_id").collect()] for o in [docs, *outputs]]
    for before, after in zip(ids[:4], ids[1:5]):
        assert not Counter(after) - Counter(before)
    assert len(ids[2]) == len(ids[1]) < len(ids[0]) and len(ids[3]) < len(ids[2])
    assert set(ids[5]) == set(ids[4])
    texts = {r.doc_id: r.text for r in docs.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    gone = set(ids[0]) - set(ids[1])
    good = [d for d in labels if labels[d] == 1]
    short = {d for d in good if len((texts[d] or "").split()) < 10}  # the base rule takes these whatever their label
    assert sum(d in gone for d in good if d not in short) <= 0.02 * len(good)
    assert sum(labels[d] == 0 and d not in gone for d in labels) <= 0.1 * sum(v == 0 for v in labels.values()) + 1


def test_run_equals_its_stages(spark, sf_dir, outputs):
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    whole = corpus_pipeline.run(spark, sf_dir).select(*columns).collect()
    assert Counter(map(tuple, whole)) == Counter(map(tuple, outputs[-1].select(*columns).collect()))


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_odd_tables(spark, sf_dir, docs, empty, name, stage):
    """Null texts and ids, repeated rows and columns called like the operators' own; then no rows at all."""
    found = stage(spark, docs, sf_dir)
    if name != "packing":
        assert found.schema == docs.schema
        kept, before = Counter(r.doc_id for r in found.collect()), Counter(r.doc_id for r in docs.collect())
        assert not kept - before
        if name == "line_dedup":
            assert kept == before
        if name in ("near_dedup", "decontamination"):
            assert kept[None] >= 1  # the row without a text is in no group and holds no window
    else:
        assert {r.doc_id for r in found.collect()} == {r.doc_id for r in docs.collect()}
    nothing = stage(spark, empty, sf_dir)
    assert nothing.count() == 0 and (name == "packing" or nothing.schema == empty.schema)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, name):
    folder = "/root/testdata/sf0.01"
    connection = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "labels", "conversations"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    relation = connection.sql(queries.ORACLE_SQL[name])
    columns = sorted(relation.columns)
    found = queries.QUERIES[name](spark, folder)
    assert sorted(found.columns) == columns
    assert Counter(map(tuple, found.select(*columns).collect())) == Counter(relation.select(*columns).fetchall())


@pytest.mark.parametrize("name", ["op3_line_dedup", "op9_packing"])
def test_no_all_pairs(spark, sf_dir, name):
    plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
