"""Whole runs on small files."""

import pytest
from pyspark.sql import functions as F

from attestra.operators import compare, profile, runs


def test_ingest(spark, tmp_path):
    (tmp_path / "my_file.csv").write_text("district,year,amount\n" + "\n".join(f"d{i},{2000 + i},{100 + i}" for i in range(20)) + "\n")
    out = runs.ingest(spark, str(tmp_path / "my_file.csv"), str(tmp_path / "store"), "t")
    assert out["artifact_id"].startswith("art-my-file-") and {r["column"] for r in out["columns"].collect()} == {"district", "year", "amount"}
    assert {r["component"]: r["grade"] for r in out["fitness"].collect()}["overall"] == "A"


def test_analyze_finds_names_and_the_spike(spark):
    rows = [(i, f"d{i % 3}", 2000 + i, 100.0 + i % 7) for i in range(40)] + [(99, "d0", 2050, 9999.0)]
    df = spark.createDataFrame(rows, "row_id long, district string, year int, amount double").drop("none")
    found, digits = runs.analyze(df, F.col("row_id"), metrics=["amount"])
    assert {(r["method"], r["row_id"]) for r in found.collect()} == {("zscore", "99"), ("iqr", "99"), ("yoy", "99")}
    assert digits.count() == 0


def test_compare_pair(spark):
    a = spark.createDataFrame([("Adabari", 100), (" Sonitpur", 200)], "district string, total_inr long")
    b = spark.createDataFrame([("Adabari T.E.", 105), ("Sonitpur", 210), (" ", 0)], "district string, total_inr long")
    r = runs.compare_pair(a, b, "total_inr", "total_inr", "district", "district").first()
    assert (r["geography"], r["unit"], r["period"], r["definition"], r["overall"], r["status"], r["delta"]) == ("comparable", "comparable", "unknown", "comparable", "comparable", "conflict", round(15 / 315, 4))
    r = runs.compare_pair(a, b.withColumnRenamed("total_inr", "total_lakh"), "total_inr", "total_lakh", "district", "district", fuzzy=False).first()
    assert (r["unit"], r["overall"], r["status"]) == ("not_comparable", "not_comparable", "not_comparable")
    r = runs.compare_pair(a, b, "total_inr", "total_inr", "district", "district", periods=(None, "2024-25")).first()
    assert (r["period"], r["overall"], r["status"]) == ("partial", "partial", "not_comparable")
    with pytest.raises(ValueError, match="no values"):
        runs.compare_pair(a, b.withColumn("total_inr", F.lit(None).cast("long")), "total_inr", "total_inr", "district", "district")


def test_compared_pairs_and_drift_go_to_the_ledger_once(spark, tmp_path):
    pairs = spark.createDataFrame([(1, "x", "area_lakh", "y", "area_crore"), (2, "x", "area_lakh", "y", "gone")], "pair_id int, artifact_a string, column_a string, artifact_b string, column_b string")
    totals = spark.createDataFrame([("x", "area_lakh", 2, 10.0), ("y", "area_crore", 2, 30.0)], "artifact_id string, column string, n long, total double")
    keys = spark.createDataFrame([("x", "a"), ("y", "a")], "artifact_id string, key string")
    releases = spark.createDataFrame([("x", "2024-25"), ("y", "")], "artifact_id string, fiscal_year string")
    compared = compare.compare_pairs(pairs, totals, keys, releases)
    got = {r["pair_id"]: r for r in compared.collect()}
    assert (got[1]["period"], got[1]["unit"], got[1]["definition"], got[1]["status"], got[1]["error"]) == ("partial", "not_comparable", "comparable", "not_comparable", None)
    assert got[2]["error"] == "column_not_found:gone" and got[2]["status"] is None
    columns = spark.createDataFrame([("x", "area_lakh", True, 0.0), ("y", "area_crore", True, 0.0)], "artifact_id string, column string, is_metric boolean, null_ratio double")
    cards = compare.infer_cards(columns)
    side = lambda x: pairs.filter("pair_id = 1").select("pair_id", F.col(f"artifact_{x}").alias("artifact_id")).join(cards, "artifact_id")
    drifts = compare.definition_drift(side("a"), side("b"), ["pair_id"])
    assert {r["drift_type"] for r in drifts.collect()} == {"unit", "definition", "scope"}
    found = runs.comparison_findings(compared.join(pairs, "pair_id"), drifts)
    path = str(tmp_path / "ledger")
    assert (runs.record(spark, found, path), runs.record(spark, found, path)) == (4, 0)
    assert {r["title"] for r in spark.read.parquet(path).collect()} == {"Can't compare these two sources yet", "The units used for 'area' changed", "The definition of 'area' changed", "What's included in 'area' changed"}


def test_blind_runs_are_written_once_and_never_with_labels(spark, tmp_path):
    (tmp_path / "cases.csv").write_text("benchmark_case_id,label,linked_source_ids\nc1,a label that must not leak, s1 ;; s2\nc2,y,\n")
    cases = runs.read_cases(spark, str(tmp_path / "cases.csv"))
    assert {r["case_id"]: r["linked_source_ids"] for r in cases.collect()} == {"c1": ["s1", "s2"], "c2": []}
    artifacts = spark.createDataFrame([("a1", "s1")], "artifact_id string, source_id string")
    schema = "finding_id string, artifact_ids array<string>, title string, summary string, evidence_query string"
    findings = spark.createDataFrame([("f1", ["a1"], "t", "s", "q"), ("f2", ["a1"], "t", "s", "")], schema)
    path = runs.blind_run(cases, artifacts, findings, "abc", str(tmp_path), ["label"])
    assert {(r["case_id"], r["status"], r["n_findings"], r["n_complete"]) for r in spark.read.json(f"{path}/cases").collect()} == {("c1", "mapped", 2, 1), ("c2", "unmapped_access_gap", 0, 0)}
    assert {r["finding_id"] for r in spark.read.json(f"{path}/findings").collect()} == {"f1", "f2"}
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        runs.blind_run(cases, artifacts, findings, "abc", str(tmp_path))
    leaky = spark.createDataFrame([("f1", ["a1"], "t", "it is a label that must not leak, s", "q")], schema)
    with pytest.raises(ValueError, match="label text"):
        runs.blind_run(cases, artifacts, leaky, "def", str(tmp_path), ["label"])


def test_finding_ids_leave_volatile_fields_out(spark):
    df = spark.createDataFrame([(1, "x", 10), (1, "x", 20)], "a int, b string, seen_at int")
    nested = df.select("a", F.struct("b", F.array(F.struct("b", "seen_at")).alias("deep")).alias("s"))
    for rows in (df, nested):
        assert rows.select(runs.finding_id(rows, "s", rows.columns, ["seen_at"]).alias("i")).distinct().count() == 1
        assert rows.select(runs.finding_id(rows, "s", rows.columns).alias("i")).distinct().count() == 2


def test_nearest_quantiles(spark):
    df = spark.createDataFrame([(float(i * i),) for i in range(11)] + [(None,)], "v double")
    for at_once in (100, 0):
        r = profile.nearest_quantiles(df, ["v"], at_once).first()
        assert (r["p5"], r["p25"], r["p50"], r["p95"]) == (1.0, 9.0, 25.0, 100.0)
