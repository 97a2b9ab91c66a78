"""Readers, snapshots and streams on small files."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from attestra.sources import quoted, tables
from attestra.streaming import ingest


def test_csv_encodings_and_types(spark, tmp_path):
    (tmp_path / "bom.csv").write_bytes("﻿name,n,day\r\nÄ,1,2024-01-01\r\n".encode())
    (tmp_path / "latin.csv").write_bytes("name,n\nÄ,2\n".encode("latin-1"))
    df = tables.read_table(spark, str(tmp_path / "bom.csv"))
    assert df.columns == ["name", "n", "day"] and df.first().asDict() == {"name": "Ä", "n": 1, "day": "2024-01-01"}
    assert tables.read_table(spark, str(tmp_path / "latin.csv")).first()["name"] == "Ä"


def test_tsv_and_json(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("x\ty\n1\t2\n")
    (tmp_path / "l.jsonl").write_text('{"x": 1}\n{"x": 2}\n')
    (tmp_path / "array.json").write_text('[\n{"x": 1},\n{"x": 2}\n]')
    assert tables.read_table(spark, str(tmp_path / "a.tsv")).columns == ["x", "y"]
    assert tables.read_table(spark, str(tmp_path / "l.jsonl")).count() == 2
    assert {r["x"] for r in tables.read_table(spark, str(tmp_path / "array.json")).collect()} == {1, 2}


def test_unknown_suffix(spark):
    with pytest.raises(ValueError, match="unsupported"):
        tables.read_table(spark, "a.xlsx")


def test_manifest(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"x\n1\n")
    r = tables.manifest(spark, str(tmp_path), {"header": True}).first()
    assert r["byte_size"] == 4 and r["media_type"] == "text/csv" and len(r["sha256"]) == 64 and r["parser_version"] == spark.version
    assert r["config_hash"] == tables.config_hash("spark", {"header": True}) != tables.config_hash("spark", {"header": False})


def test_csv_files_of_two_encodings(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_bytes("name,n\nÄ,1\n".encode())
    (tmp_path / "in" / "b.csv").write_bytes("name,n\nÖ,2\n".encode("latin-1"))
    assert {(r["name"], r["n"]) for r in tables.read_table(spark, str(tmp_path / "in"), ".csv").collect()} == {("Ä", 1), ("Ö", 2)}
    (tmp_path / "none.csv").write_text("")
    assert tables.read_table(spark, str(tmp_path / "none.csv"), schema="a int").count() == 0


def test_json_keeps_every_line(spark, tmp_path):
    lines = [f'{{"x": {i}}}' for i in range(20)]
    (tmp_path / "broken.jsonl").write_text("\n".join([*lines[:7], "not json {", *lines[7:]]) + "\n")
    out = tables.read_table(spark, str(tmp_path / "broken.jsonl"))
    rows = out.collect()
    assert len(rows) == 21 and {r["x"] for r in rows} == {*range(20), None} and [r["_corrupt_record"] for r in rows if r["x"] is None] == ["not json {"]
    kept = tables.read_json(spark, str(tmp_path / "broken.jsonl"), "x int", corrupt="bad").collect()
    assert len(kept) == 21 and [r["bad"] for r in kept if r["bad"]] == ["not json {"]
    with pytest.raises(Exception, match="MALFORMED|Malformed|malformed"):
        tables.read_table(spark, str(tmp_path / "broken.jsonl"), schema="x int").collect()
    (tmp_path / "array.json").write_text('[\n{"x": 1},\n{"x": 2}\n]')
    assert sorted(r["x"] for r in tables.read_table(spark, str(tmp_path / "array.json"), schema="x int").collect()) == [1, 2]
    (tmp_path / "object.json").write_text('{\n "x": [1, 2],\n "y": 3\n}')
    assert tables.read_table(spark, str(tmp_path / "object.json")).first().asDict() == {"x": [1, 2], "y": 3}


def test_rows_are_numbered_as_stored(spark, tmp_path):
    spark.range(0, 100, 1, 4).write.parquet(str(tmp_path / "t"))
    rows = tables.numbered(spark.read.parquet(str(tmp_path / "t"))).collect()
    assert sorted(r["row_number"] for r in rows) == list(range(1, 101)) and all(r["row_number"] == r["id"] + 1 for r in rows)
    cells = tables.cells(spark.createDataFrame([(1, "a", None), (2, None, 2.5)], "row_number long, s string, v double"))
    assert {tuple(r) for r in cells.collect()} == {(1, "s", "a"), (2, "v", "2.5")}


def test_register_without_columns(spark):
    rows = spark.createDataFrame([("s1", "u", " tbd", "unverified_candidate"), ("s2", " ", "TBD", "open")], "source_id string, source_url string, sha256 string, access_status string")
    got = {tuple(r) for r in tables.register_problems(rows).collect()}
    assert got == {("s1", "access_status", "unverified_candidate"), ("s2", "source_url", "missing"), ("s2", "sha256", "missing"), (None, "retrieved_at", "missing_column")} | {(s, "retrieved_at", "missing") for s in ("s1", "s2")}


def test_freeze_reuses_equal_content(spark, tmp_path):
    df = spark.range(10).withColumn("x", F.col("id") * 2)
    a, b = tables.freeze(df, str(tmp_path), "t"), tables.freeze(df.orderBy(F.desc("id")), str(tmp_path), "t")
    c = tables.freeze(df.filter("id > 0"), str(tmp_path), "t")
    assert a == b != c and spark.read.parquet(a).count() == 10


def test_ingest_twice_adds_nothing(spark, tmp_path):
    spark.createDataFrame([(i, 100.0 + i % 5) for i in range(50)] + [(99, 9999.0)], "id long, v double").write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    counts = []
    for k in range(2):  # a new checkpoint: every file comes again
        ingest.start_ingest(spark, str(tmp_path / "in"), schema, str(tmp_path / "ledger"), str(tmp_path / f"checkpoint{k}"), ["v"], "id").awaitTermination()
        counts.append(spark.read.parquet(str(tmp_path / "ledger")).count())
    assert counts == [2, 2]


def test_files_are_judged_by_themselves_and_profiled(spark, tmp_path):
    for k in range(3):
        rows = [(100 * k + i, 10.0**k * (100.0 + i % 5)) for i in range(50)]
        spark.createDataFrame(rows, "id long, v double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    ingest.start_ingest(spark, str(tmp_path / "in"), schema, str(tmp_path / "ledger"), str(tmp_path / "checkpoint"), ["v"], "id", profiles=str(tmp_path / "profiles"), files=2).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "ledger")).count() == 0
    fitness = spark.read.parquet(str(tmp_path / "profiles" / "fitness")).filter("component = 'overall'").collect()
    assert len({r["artifact"] for r in fitness}) == 3 and all(r["grade"] == "A" for r in fitness)


def test_files_of_one_name_in_two_folders_are_two_artifacts(spark, tmp_path):
    rows = lambda k: spark.createDataFrame([(i, 10.0**k * (100.0 + i % 5)) for i in range(40)] + [(99, 10.0**k * 900.0)], "id long, v double")
    for k in range(2):
        rows(k).coalesce(1).write.parquet(str(tmp_path / f"one{k}"))
        (tmp_path / "in" / f"d={k}").mkdir(parents=True)
        next((tmp_path / f"one{k}").glob("*.parquet")).rename(tmp_path / "in" / f"d={k}" / "a.parquet")
    ingest.start_ingest(spark, str(tmp_path / "in"), rows(0).schema, str(tmp_path / "ledger"), str(tmp_path / "checkpoint"), ["v"], "id", profiles=str(tmp_path / "profiles")).awaitTermination()
    assert {(r["artifact"], r["method"]) for r in spark.read.parquet(str(tmp_path / "ledger")).collect()} == {(f"d={k}/a.parquet", m) for k in range(2) for m in ("zscore", "iqr")}
    assert {r["artifact"] for r in spark.read.parquet(str(tmp_path / "profiles" / "fitness")).collect()} == {"d=0/a.parquet", "d=1/a.parquet"}


def test_windowed_counts(spark, tmp_path):
    rows = [("2024-01-01 00:01:00", "a", 1.0), ("2024-01-01 00:02:00", "a", 2.0), ("2024-01-01 00:12:00", "a", 4.0)]
    spark.createDataFrame(rows, "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "in"))
    q = ingest.windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("windowed").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["n"], r["total"]) for r in spark.table("windowed").collect()} == {(2, 3.0), (1, 4.0)}


def odd_cells(rng, n):
    bits = ["a", "b", '"', '""', ",", "\n", "\r\n", " ", "é", "5\" pipe", "'", "\t", ";"]
    return [[str(i), "".join(rng.choice(bits) for _ in range(rng.randrange(12))), rng.choice(["x", "y,z", 'q"q', "long\nline " * 40])] for i in range(n)]


@pytest.mark.parametrize("sep", [",", "\t"])
@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "latin-1"])
def test_quoted_records_equal_a_row_by_row_parser(spark, tmp_path, sep, encoding):
    rows = odd_cells(random.Random(1), 300)
    for k in range(2):
        out = io.StringIO(newline="")
        writer = csv.writer(out, delimiter=sep, lineterminator="\n")
        writer.writerow(["id", "a.b", "line\n`end`"])
        writer.writerows(rows[k::2])
        (tmp_path / f"{k}.csv").write_bytes(out.getvalue().encode(encoding))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        df = tables.read_table(spark, str(tmp_path), ".csv" if sep == "," else ".tsv")
        assert df.columns == ["id", "a.b", "line\n`end`"] and dict(df.dtypes)["id"] == "int"
        got = sorted((str(r[0]), r[1] or "", r[2]) for r in df.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == sorted(map(tuple, rows))


def test_fields_equal_a_parser(tmp_path):
    rng = random.Random(2)
    for _ in range(2000):
        line = "".join(rng.choice('ab,"" \n') for _ in range(rng.randrange(14)))
        want = next(csv.reader(io.StringIO(line, newline=""), strict=False), [])
        lines = line.split("\n")
        inside, n = False, 0
        for n, part in enumerate(lines):
            inside = quoted.open_after(part.encode(), inside, b",")
            if not inside:
                break
        record = "\n".join(lines[: n + 1])
        assert [(x or b"").decode() for x in quoted.fields_of(record.encode(), b",")] == (want or [""]), line


def test_doubled_quotes_ragged_rows_and_empty_fields(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,say,n\n1,"say ""hi"", ok",2\n2,"",\n3\n\n4,x,5,6\n')
    rows = [tuple(r) for r in tables.read_table(spark, str(tmp_path / "a.csv")).orderBy("id").collect()]
    assert rows[0] == (1, 'say "hi", ok', 2) and rows[2] == (3, None, None) and rows[3] == (4, "x", 5)
    (tmp_path / "b.csv").write_text('id,say,n\n1,"say ""hi"",\nok",2\n2,"",\n3\n\n4,x,5,6\n5,bad,x\n')
    rows = [tuple(r) for r in tables.read_table(spark, str(tmp_path / "b.csv"), schema="id int, say string, n int").orderBy("id").collect()]
    assert rows == [(1, 'say "hi",\nok', 2), (2, "", None), (3, None, None), (4, "x", 5), (5, "bad", None)]
    (tmp_path / "two").mkdir()
    (tmp_path / "two" / "a.csv").write_text('a,b\n1,"x\ny"\n')
    (tmp_path / "two" / "b.csv").write_text('a,c\n1,"x\ny"\n')
    with pytest.raises(ValueError, match="different"):
        tables.read_table(spark, str(tmp_path / "two"), ".csv")


def test_writers_at_once_lose_and_double_nothing(spark, tmp_path):
    import threading

    from attestra.sources.append_log import AppendLog

    path, counts = str(tmp_path / "log"), []

    def write(k):
        log = AppendLog(spark, path, "id", "id string, v int", buckets=4)
        counts.append(sum(log.append(spark.createDataFrame([(f"{i}", k) for i in range(5 * j, 5 * j + 12)] + [(None, 1)], "id string, v int")) for j in range(2)))

    threads = [threading.Thread(target=write, args=(k,)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    log = AppendLog(spark, path, "id", "id string, v int", buckets=4)
    rows = log.read().collect()
    assert sorted(int(r["id"]) for r in rows) == list(range(17)) and sum(counts) == 17 and len(counts) == 3
    assert log.append(spark.createDataFrame([("3", 9), ("99", 9)], "id string, v int")) == 1 and log.read().count() == 18
    (tmp_path / "log" / "data" / "left-over").mkdir()
    assert log.read().count() == 18 and AppendLog(spark, str(tmp_path / "none"), "id", "id string").read().count() == 0


def test_adjudication_appends_what_stands(spark, tmp_path):
    from attestra.operators import evaluation
    from attestra.sources.append_log import AppendLog

    schema = "decision_id string, case_id string, decision string, finding_ids array<string>"
    decisions = spark.createDataFrame([("d1", "c", "detected", ["f"]), ("d2", "c", "guessed", ["f"]), ("d3", "x", "missed", []), ("d4", "c", "detected", ["g"])], schema)
    known = spark.createDataFrame([("c", "f")], "case_id string, finding_id string")
    log = AppendLog(spark, str(tmp_path), "decision_id", schema)
    n, refused = evaluation.adjudicate(log, decisions, known)
    assert n == 1 and {("d2", "unknown_decision"), ("d3", "foreign_case"), ("d4", "foreign_finding")} <= {(r["decision_id"], r["reason"]) for r in refused.collect()}
    assert evaluation.adjudicate(log, decisions, known)[0] == 0 and [r["decision_id"] for r in log.read().collect()] == ["d1"]


def test_quoted_query_writes_a_file_for_each_part(spark, tmp_path, monkeypatch):
    from attestra.plans import sources

    rows = spark.range(60).selectExpr("id AS doc_id", "CONCAT('a, \"', id, '\"') AS text", "'en' AS lang", "'web' AS source", "5L AS n_chars")
    rows.repartition(6).write.parquet(f"{tmp_path}/documents.parquet")
    paths, plain = [], sources.tables.read_table
    monkeypatch.setattr(sources.tables, "read_table", lambda spark, path, **options: paths.append(path) or plain(spark, path, **options))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # a part for each file
    try:
        out = sources.src_csv_quoted(spark, str(tmp_path))
        assert {(r["doc_id"], r["body"]) for r in out.collect()} == {(i, f'a, "{i}"\nsaid "en"') for i in range(60)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert spark.read.format("binaryFile").load(paths[0]).count() == 6
