"""The registered queries against DuckDB on the smallest tables, and the guard around the optional subpackage."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

from attestra.plans import registry

FOLDER = os.environ.get("ATTESTRA_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROOT = Path(__file__).resolve().parent.parent


def rows_of(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    key = lambda v: "" if v is None or v != v else f"{v + 0.0:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(key(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, FOLDER)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows_of(names, cursor.fetchall())


@pytest.mark.parametrize("name", ["definition_drift", "drift_overall", "drift_pairs", "finding_text"])
def test_query_equals_sql_beyond_six_digits(spark, tmp_path, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for t in TABLES:
        (tmp_path / f"{t}.parquet").symlink_to(f"{FOLDER}/{t}.parquet")
    (tmp_path / "part.parquet").unlink()
    db.execute(f"COPY (SELECT * REPLACE (CAST(p_partkey + 999900 AS BIGINT) AS p_partkey) FROM '{FOLDER}/part.parquet') TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    df = registry.QUERIES[name](spark, str(tmp_path))
    cursor = db.execute(registry.ORACLE_SQL[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in cursor.description], cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_runs(spark, name):
    assert registry.QUERIES[name](spark, FOLDER).count() > 0


def test_entry_without_the_optional_subpackage(tmp_path):
    (tmp_path / "attestra").mkdir()
    for p in (ROOT / "attestra").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "attestra" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").symlink_to(ROOT / "__spark_entry__.py")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'anomaly_zscore' in q and 'pipeline' not in q and not any(k[:2] == 'op' and k[2].isdigit() for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)


def test_entry_without_a_library_of_the_optional_subpackage(tmp_path):
    (tmp_path / "public_tokenizers.py").write_text("raise ModuleNotFoundError(\"No module named 'public_tokenizers'\", name='public_tokenizers')")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'anomaly_zscore' in q and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": f"{tmp_path}{os.pathsep}{ROOT}"}, check=True)


def test_session_names_the_missing_folder(spark, monkeypatch):
    from attestra import session

    class Lone:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(Lone())
    with session.scratch_scope(spark):
        inner, outer = session.materialize(spark.range(3), "a"), session.materialize(spark.range(4), "b", outside=True)
        assert inner.count() == 3
    assert outer.count() == 4
    with pytest.raises(Exception, match="not exist|PATH_NOT_FOUND|FILE_NOT_EXIST"):
        inner.count()
