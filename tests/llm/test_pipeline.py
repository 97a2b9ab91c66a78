"""The pipeline's stages on a small corpus, each against what it must do, and queries with SQL against DuckDB."""

import os

import pytest

import corpus_pipeline
from attestra.llm import queries
from attestra.session import materialize
from tests.llm.test_pairs import slow_leaks
from tests.llm.test_tokens import check_packing
from tests.test_entry import FOLDER, TABLES, rows_of


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact_dedup", "simhash_near_dedup", "decontaminate", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r for r in docs.collect()}
        out = materialize(stage(spark, docs, FOLDER), name)
        assert out.columns == docs.columns
        after = {r["doc_id"]: r for r in out.collect()}
        assert all(before[i] == r for i, r in after.items())
        if name == "exact_dedup":
            last = {}
            for i, r in before.items():
                last[r["text"]] = max(i, last.get(r["text"], i))
            assert set(after) == set(last.values())
        if name == "decontaminate":
            assert set(after) == {i for i, x in slow_leaks([(i, r["text"]) for i, r in before.items()], items).items() if not x[-1]}
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    check_packing([(r["doc_id"], r["text"]) for r in docs.collect()], packed)
    assert sorted(map(tuple, corpus_pipeline.run(spark, FOLDER).collect())) == sorted(map(tuple, packed))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = queries.QUERIES[name](spark, FOLDER)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = db.execute(queries.ORACLE_SQL[name])
    assert got == rows_of([d[0] for d in cursor.description], cursor.fetchall())


def test_all_operators_are_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 14))
    assert os.path.exists(corpus_pipeline.__file__)
