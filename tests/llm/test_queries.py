"""The registered queries: SQL twins in DuckDB, brute force where there is none, and the pipeline's stages."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from hazardloom.llm.queries import QUERIES, SQL

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(frame):
    cells = frame[sorted(frame.columns)].astype(object).where(frame[sorted(frame.columns)].notna(), None)
    return sorted(tuple("-" if v is None else repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in cells.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "conversations", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert sorted({int(q[2:].split("_")[0]) for q in QUERIES}) == list(range(1, 14))


@pytest.mark.parametrize("name", ["op4_toxicity_grammar", "op5_quotation_linking", "op7_source_mixing", "op9_simhash_near_dedup", "op12_attention_quality"])
def test_one_row_for_each_input_row(spark, name):
    table = "conversations" if name.startswith("op5") else "documents"
    assert QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, ids = docs, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert after.columns == docs.columns and after.dtypes == docs.dtypes
        kept = {r.doc_id for r in after.select("doc_id").collect()}
        assert kept <= ids and kept
        before, ids = after, kept
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "source_mixing", "shortest_pack_first"]
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()} == ids
