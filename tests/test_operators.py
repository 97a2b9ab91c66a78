"""Operators on small hand-made inputs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from attestra.functions import exprs as X, names
from attestra.operators import anomaly, benford, compare, evaluation, ledger, lineage, profile, retrieval
from attestra.sources import tables


def longs(spark, values, entity=None, metric="m"):
    rows = [(i, entity, f"{i:06d}", metric, None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "row_id long, entity string, period string, metric string, value double")


def test_zscore_flags_the_one_outlier(spark):
    values = [98 + i % 6 for i in range(30)] + [5000]
    found = anomaly.detect_zscore(longs(spark, values)).collect()
    assert [(r["row_id"], r["severity"]) for r in found] == [(30, "high")]


@pytest.mark.parametrize("values", [[1, 5000], [7] * 20, [], [None] * 5])
def test_zscore_is_silent_without_spread_or_rows(spark, values):
    assert anomaly.detect_zscore(longs(spark, values)).count() == 0


def test_zscore_skips_nulls(spark):
    values = [10, 11, 12, 9, 10, None, 11, 10, 12, 9, 11, 10, 11, 5000]
    assert [r["row_id"] for r in anomaly.detect_zscore(longs(spark, values)).collect()] == [13]


def test_iqr_with_and_without_range(spark):
    assert [r["row_id"] for r in anomaly.detect_iqr(longs(spark, [10, 12, 11, 13, 999])).collect()] == [4]
    flat = anomaly.detect_iqr(longs(spark, [10, 10, 10, 10, 999])).collect()
    assert [(r["row_id"], r["score"], r["severity"]) for r in flat] == [(4, None, "medium")]
    assert anomaly.detect_iqr(longs(spark, [1, 2, 99])).count() == 0


def test_change_by_period(spark):
    assert [(r["row_id"], r["severity"]) for r in anomaly.detect_change(longs(spark, [10, 11, 12, 13, 14, 400], "A")).collect()] == [(5, "high")]
    assert anomaly.detect_change(longs(spark, [100, 105, 102], "A")).count() == 0
    zero = anomaly.detect_change(longs(spark, [0, 0, 5000], "A")).collect()
    assert [(r["row_id"], r["score"], r["severity"]) for r in zero] == [(2, None, "high")]


def test_rolling_baseline(spark):
    assert [r["row_id"] for r in anomaly.detect_rolling(longs(spark, [10, 11, 9, 10, 200], "A")).collect()] == [4]
    assert anomaly.detect_rolling(longs(spark, [5] * 6, "A")).count() == 0
    assert anomaly.detect_rolling(longs(spark, [1, 2], "A")).count() == 0


def test_spread_windows_equal_whole_ones(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, "A"]), f"{rng.randrange(40):03d}", "m", rng.choice([None, 0.0, 1.0, 2.0, 3.0, 500.0])) for i in range(300)]
    frame = spark.createDataFrame(rows, "row_id long, entity string, period string, metric string, value double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for detect in (anomaly.detect_change, anomaly.detect_rolling):
            whole, parts = (sorted(map(str, detect(frame, spread=s).collect())) for s in (False, True))
            assert whole == parts and whole
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_strongest_puts_unscored_first(spark):
    found = anomaly.detect_iqr(longs(spark, [10] * 8 + [50, 999])).withColumn("g", F.lit(1))
    top = anomaly.strongest(found, ["g"], most=1).collect()
    assert [(r["row_id"], r["finding_id"]) for r in top] == [(8, "iqr-m-000")]


def test_metric_columns(spark):
    df = spark.createDataFrame([(1, 2, 3, 4.0, "x", 5)], "call_id long, day int, year int, amount double, name string, zipcode int")
    assert anomaly.metric_columns(df) == ["amount"]
    assert anomaly.metric_columns(df, include=["call_id"]) == ["call_id", "amount"]
    assert anomaly.find_column(["District_Name", "fy"], ["state", "district"]) == "District_Name"


def test_first_digits(spark):
    values = [123.0, 456.0, 789.0, 0.52, 0.0, -9.99, float("nan"), float("inf"), None, 1000.0, 0.001]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(X.first_digit(F.col("v")).alias("d")).collect()
    assert [r["d"] for r in got] == [1, 4, 7, 5, None, 9, None, None, None, 1, 1]


def test_benford_verdicts(spark):
    like = [10 ** (4 * i / 400) for i in range(400)]
    flat = [(1 + i % 9) * 10 ** (i % 3) * 1.01 for i in range(300)]
    rows = [("like", x) for x in like] + [("flat", x) for x in flat] + [("narrow", 90.0 + i % 80) for i in range(200)] + [("few", float(10**i)) for i in range(30)]
    table = benford.conformity_table(benford.digit_table(spark.createDataFrame(rows, "column string, value double")))
    got = {r["column"]: (r["conformity"], r["severity"]) for r in table.collect()}
    assert got == {"like": ("close", None), "flat": ("nonconformity", "high")}


def test_profile_of_a_mixed_table(spark):
    df = spark.createDataFrame([("A", 2020, 10), ("A", 2020, 10), ("B", 2021, 12), (None, 2021, 11), ("C", 2022, 9), ("D", 2022, 9999)], "district string, year int, beneficiaries long")
    stats = {r["column"]: r for r in profile.column_stats(df).collect()}
    assert stats["district"]["null_count"] == 1 and stats["district"]["null_ratio"] == round(1 / 6, 4) and stats["beneficiaries"]["max"] == 9999
    assert profile.duplicate_rows(df).first().asDict() == {"row_count": 6, "duplicate_rows": 1}
    distinct = profile.distinct_counts(profile.value_counts(df))
    codes = {(r["code"], r["column"]) for r in profile.quality_observations(profile.column_stats(df), distinct, profile.duplicate_rows(df)).collect()}
    assert codes == {("DUPLICATE_ROWS", None)}


def test_profile_of_an_empty_table(spark):
    df = spark.createDataFrame([], "a string, b double")
    assert {r["null_ratio"] for r in profile.column_stats(df).collect()} == {0.0}
    assert profile.duplicate_rows(df).first().asDict() == {"row_count": 0, "duplicate_rows": 0}
    assert profile.value_counts(df).count() == 0


def test_observations_of_nulls_constants_and_zeros(spark):
    rows = [(None, None, 7, "x", 0, 0), (None, None, 7, None, 0, 3), (None, 1, 7, "x", 0, None)]
    df = spark.createDataFrame(rows, "a string, b int, c int, d string, e int, f int")
    got = {(r["code"], r["column"], r["severity"]) for r in profile.Profile(df).observations.collect()}
    assert got == {("COLUMN_ALL_NULL", "a", "high"), ("COLUMN_HIGH_NULL_RATIO", "b", "medium"), ("COLUMN_CONSTANT", "c", "low"), ("COLUMN_CONSTANT", "e", "low"), ("ZERO_MIN_NUMERIC", "f", "info")}


def test_fitness_components(spark):
    flat = [(i, 5.0, 1.0 if i < 199 else 1e9, i * 1.0) for i in range(200)]
    df = spark.createDataFrame(flat, "row_id long, same double, skewed double, fine double")
    got = {r["component"]: r["score"] for r in profile.fitness(df).collect()}
    assert got["distribution_health"] == 86.67 and got["consistency"] == 96.0 and got["validity"] == 100.0  # two of three metric columns are flagged
    half = spark.createDataFrame([(i, None if i % 3 else i) for i in range(30)], "k_id long, v long")
    got = {r["component"]: r["score"] for r in profile.fitness(half).collect()}
    assert (got["validity"], got["consistency"], got["completeness"]) == (100.0, 88.0, 66.66)
    words = spark.createDataFrame([("a",), ("b",)], "name string")
    assert {r["component"]: r["score"] for r in profile.fitness(words).collect()}["distribution_health"] == 80.0


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_quantiles_in_buckets_equal_those_at_once(spark, n):
    rng = random.Random(n)
    rows = [(rng.choice([1.0, 2.0, rng.random() * 100]), None if i % 3 == 0 else i) for i in range(n)] + [(None, None)]
    df = spark.createDataFrame(rows, "a double, b long")
    one, other = ({r["column"]: [r[f"p{p}"] for p in (5, 25, 50, 75, 95)] for r in profile.column_stats(df, at).collect()} for at in (10**9, 0))
    assert one == other
    long = longs(spark, [a for a, _ in rows])
    x, y = (anomaly.quartiles(long, at).first() for at in (10**9, 0))
    assert (x["n"], x["q1"], x["q3"]) == (y["n"], y["q1"], y["q3"])


def test_values_that_are_not_finite_are_left_out(spark):
    rows = [(float(i), "k") for i in range(50)] + [(float("nan"), "k"), (float("inf"), "k"), (None, "k"), (900.0, "k")]
    df = spark.createDataFrame(rows, "v double, k string")
    r = profile.column_stats(df.select("v")).first()
    assert (r["min"], r["max"], r["nonfinite_count"], r["null_count"]) == (0.0, 900.0, 2, 1) and r["mean"] == pytest.approx((sum(range(50)) + 900) / 51)
    long = anomaly.long_frame(df, ["v"], F.monotonically_increasing_id())
    assert [x["observed"] for x in anomaly.detect_zscore(long).collect()] == [900.0]


def test_dotted_and_clashing_names(spark):
    df = spark.createDataFrame([(1, 2.0, "x"), (1, 2.0, "x"), (3, None, None)], "`a.b` int, n double, n_ string").withColumnRenamed("n_", "c`d")
    assert profile.duplicate_rows(df).first().asDict() == {"row_count": 3, "duplicate_rows": 1}
    known = profile.Profile(df)
    assert {r["column"]: r["unique_count"] for r in known.distinct.collect()} == {"a.b": 2, "n": 1, "c`d": 1}
    assert {r["component"] for r in profile.fitness_of(known).collect()} == {*profile.WEIGHTS, "overall"}
    assert profile.exact_quantiles(df, ["a.b"])["a.b"][2] == 1.0 and profile.nearest_quantiles(df, ["a.b"]).first()["p50"] == 1.0
    assert anomaly.long_frame(df, ["a.b"], F.lit(1)).count() == 3


def test_profiles_of_many_tables_equal_one_by_one(spark):
    rng = random.Random(6)
    rows = [(t, rng.choice([None, 1.0, 2.0, 0.0]), rng.choice(["a@b.org", None, "x"])) for t in "pqr" for _ in range(20)] + [("empty", None, None)] * 2
    df = spark.createDataFrame(rows, "artifact string, v double, email string")
    many = profile.Profile(df, by=("artifact",))
    for t in ("p", "q", "r", "empty"):
        one = profile.Profile(df.filter(F.col("artifact") == t).drop("artifact"))
        of = lambda rows, t=t: sorted(map(str, rows.filter(F.col("artifact") == t).drop("artifact").collect()))
        for name in ("columns", "distinct", "duplicates", "observations", "pii"):
            assert of(getattr(many, name)) == sorted(map(str, getattr(one, name).collect())), name
        assert of(profile.fitness_of(many)) == sorted(map(str, profile.fitness_of(one).collect()))


def test_nearly_empty_columns_are_not_all_null(spark):
    df = spark.range(30_000).select(F.when(F.col("id") == 7, 1).alias("one"), F.lit(None).cast("int").alias("no"), F.when(F.col("id") % 2 == 0, 1).alias("half"))
    got = {(r["code"], r["column"]) for r in profile.Profile(df).observations.collect()}
    assert ("COLUMN_ALL_NULL", "no") in got and ("COLUMN_HIGH_NULL_RATIO", "one") in got and not any(c == "half" and "NULL" in k for k, c in got)


def test_artifacts_are_judged_by_themselves(spark):
    rows = [("a", i, 10.0 + i % 3) for i in range(30)] + [("b", 100 + i, 5000.0 + i % 3) for i in range(30)] + [("a", 99, 900.0)]
    df = spark.createDataFrame(rows, "artifact string, k long, v double")
    long = anomaly.long_frame(df, ["v"], F.col("k"), artifact=F.col("artifact"))
    for at in (10**9, 0):
        assert {(r["artifact"], r["row_id"]) for r in anomaly.detect_iqr(long, at_once=at).collect()} == {("a", 99)}
    assert {(r["artifact"], r["row_id"]) for r in anomaly.detect_zscore(long).collect()} == {("a", 99)}


def test_candidate_keys_follow_the_columns(spark):
    df = spark.createDataFrame([(i, *[i] * 11) for i in range(3)], "z int, " + ", ".join(f"{c} int" for c in "abcdefghijk"))
    known = profile.Profile(df)
    assert [r["column"] for r in profile.candidate_keys(known.columns, known.distinct).collect()] == list("zabcdefghi")


def test_candidate_keys_need_all_values(spark):
    df = spark.createDataFrame([(1, 1), (2, None), (3, 3)], "id int, v int")
    keys = profile.candidate_keys(profile.column_stats(df), profile.distinct_counts(profile.value_counts(df)))
    assert [r["column"] for r in keys.collect()] == ["id"]


def test_pii_needs_name_and_values(spark):
    df = spark.createDataFrame([("a@b.org", "9876543210", "x@y.de"), ("none", "12", "z@y.de")], "email string, mobile string, remark string")
    got = {(r["column"], r["hint_type"], r["matched_values"]) for r in profile.pii_hints(df).collect()}
    assert got == {("email", "email", 1), ("mobile", "mobile_phone", 1)}


def test_fitness_orders_clean_before_messy(spark):
    clean = spark.createDataFrame([(f"d{i}", 10.0 + i) for i in range(40)], "district string, value double")
    messy = spark.createDataFrame([(None, 1.0)] * 30 + [("x", None)] * 10, "district string, value double")
    score = lambda df: {r["component"]: r["score"] for r in profile.fitness(df).collect()}["overall"]
    assert score(clean) >= 85 > score(messy)


NAMES = ["Adabari", "Adabari T.E.", "Chhota Udaipur", "Chhotaudepur", "Kamrup District", "kamrup", "New Delhi", "Delhi New", "Sonitpur", "T", "", "East Godavari", "West Godavari", "Godavari"]


def common(a, b):
    row = [0] * (len(a) + 1)
    for y in b:
        new = [0]
        for i, x in enumerate(a):
            new.append(row[i] + 1 if x == y else max(new[-1], row[i + 1]))
        row = new
    return row[-1]


def alike(a, b):
    ratio = lambda p, q: 200.0 * common(p, q) / (len(p) + len(q)) if p or q else 100.0
    scores = [ratio(a, b), ratio(a.replace(" ", ""), b.replace(" ", ""))]
    x, y = set(a.split()), set(b.split())
    if x and y:
        both, da, db = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
        if both and (not da or not db):
            return 100.0
        sa, sb = (len(both) + bool(both) + len(d) for d in (da, db))
        scores.append(100.0 * (1 - (len(da) + len(db) - 2 * common(da, db)) / (sa + sb)))
        scores += [200.0 * len(both) / (len(both) + s) for s in (sa, sb)] if both else []
    return max(scores)


def test_name_similarity_equals_a_plain_one(spark):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcé 01") for _ in range(n))
    pairs = [(word(rng.randrange(12)), word(rng.randrange(12))) for _ in range(150)] + [(x, x[: len(x) // 2] + x) for x in (word(60), word(61), word(80), word(130))]
    pairs += [("", ""), ("a", ""), (" ", "a"), ("a b", "b a"), ("a" * 60, "a" * 59), ("ab" * 40, "ba" * 45)]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select("a", "b", names.name_similarity("a", "b").alias("s"), names.common_subsequence("a", "b").alias("n"))
    assert "Python" not in got._jdf.queryExecution().toString()
    for r in got.collect():
        assert r["n"] == common(r["a"], r["b"]) and r["s"] == pytest.approx(alike(r["a"], r["b"]), abs=1e-9), (r["a"], r["b"])


def test_gates_of_many_pairs(spark):
    left = spark.createDataFrame([(1, "Adabari"), (1, "Sonitpur"), (2, "xyz"), (3, " ")], "pair int, left_name string")
    right = spark.createDataFrame([(1, "Adabari T.E."), (1, "Sonitpur"), (2, "Adabari"), (3, "q"), (4, "w")], "pair int, right_name string")
    got = {r["pair"]: (r["state"], r["matched"], r["left_only"], r["right_only"], r["variants"]) for r in compare.fuzzy_gates(left, right).collect()}
    assert got == {1: ("comparable", 2, 0, 0, "Adabari ~ Adabari T.E."), 2: ("not_comparable", 0, 1, 1, ""), 3: ("unknown", 0, 0, 1, ""), 4: ("unknown", 0, 0, 1, "")}


def test_fuzzy_geography_of_many_pairs(spark):
    pairs = spark.createDataFrame([("p", "a", "yield_inr", "b", "yield_inr"), ("q", "a", "yield_inr", "c", "yield_inr")], "pair_id string, artifact_a string, column_a string, artifact_b string, column_b string")
    totals = spark.createDataFrame([(x, "yield_inr", 2, 10.0) for x in "abc"], "artifact_id string, column string, n long, total double")
    keys = spark.createDataFrame([("a", "Adabari"), ("b", "Adabari T.E."), ("c", "Kamrup")], "artifact_id string, key string")
    years = spark.createDataFrame([(x, "2023-24") for x in "abc"], "artifact_id string, fiscal_year string")
    state = lambda fuzzy: {r["pair_id"]: r["geography"] for r in compare.compare_pairs(pairs, totals, keys, years, fuzzy=fuzzy).collect()}
    assert state(True) == {"p": "comparable", "q": "not_comparable"} and state(False) == {"p": "not_comparable", "q": "not_comparable"}


def test_pruned_matching_equals_the_full_join(spark):
    rng = random.Random(4)
    more = ["".join(rng.choice("abcd ") for _ in range(rng.randrange(1, 14))) for _ in range(60)]
    left, right = NAMES[::2] + more[:30], NAMES[1::2] + more[30:]
    a, b = (spark.createDataFrame([(x,) for x in names], "n string") for names in (left, right))
    got = {(r["left_name"], r["right_name"], round(r["score"], 6)) for r in compare.match_entities(a, b, "n", "n").collect()}
    norm = {r["n"]: r["x"] for df in (a, b) for r in df.select("n", X.entity_name(F.col("n")).alias("x")).collect()}
    want = set()
    for x in set(left):
        scored = [(alike(norm[x], norm[y]), y) for y in sorted(set(right))]
        best = max((s for s, _ in scored), default=0)
        if best >= 88.0 - 1e-9:
            want.add((x, next(y for s, y in scored if s == best), round(best, 6)))
    assert got == want
    assert ("Chhota Udaipur", "Chhotaudepur", 88.0) in got and any(x == "Adabari" and s == 100.0 for x, _, s in got)


def test_key_overlap(spark):
    df = lambda xs: spark.createDataFrame([(x,) for x in xs], "k string")
    state = lambda a, b: compare.key_overlap(df(a), df(b), "k", "k").first()
    assert state(["a", "b", None], ["b", "a"])["state"] == "comparable"
    assert state(["a", "b"], ["b", "c"]).asDict() == {"shared": 1, "left_only": 1, "right_only": 1, "total": 3, "state": "partial"}
    assert state(["a"], ["b"])["state"] == "not_comparable" and state([], [])["state"] == "unknown"


def test_gates(spark):
    rows = [(None, None), ("a", None), ("a", "A"), ("a", "b"), ("one two three four five", "five four three two one six"), ("a", "a ")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select(compare.period_gate(df.a, df.b), compare.unit_gate(df.a, df.b), compare.definition_gate(df.a, df.b), compare.unit_gate(df.a, df.b, F.lit(1.0), F.lit(1e5))).collect()
    assert [r[0] for r in got] == ["unknown", "partial", "not_comparable", "not_comparable", "not_comparable", "not_comparable"]
    assert [r[1] for r in got] == ["unknown", "unknown", "comparable", "not_comparable", "not_comparable", "not_comparable"]
    assert [r[2] for r in got] == ["unknown", "unknown", "comparable", "not_comparable", "partial", "partial"]
    assert [r[3] for r in got][2] == "partial"


def test_a_side_without_names_is_unknown(spark):
    df = lambda xs: spark.createDataFrame([(x,) for x in xs], "k string")
    assert compare.fuzzy_gate(df(["a b"]), df([" ", None]), "k", "k").first()["state"] == "unknown"
    r = compare.fuzzy_gate(df([" Adabari ", "Sonitpur"]), df(["Adabari T.E.", "Sonitpur"]), "k", "k").first()
    assert (r["state"], r["matched"], r["variants"]) == ("comparable", 2, "Adabari ~ Adabari T.E.")
    assert compare.fuzzy_gate(df(["xyz"]), df(["Adabari"]), "k", "k").first()["state"] == "not_comparable"


def test_reconcile_and_delta_sign(spark):
    rows = spark.createDataFrame([(100.0, 100.5, "comparable"), (100.0, 50.0, "comparable"), (1.0, 9.0, "partial"), (0.0, 0.0, "comparable")], "a double, b double, o string")
    got = [(r["status"], r["delta"]) for r in compare.reconcile(rows, "a", "b", "o").collect()]
    assert got == [("explainable", 0.5), ("conflict", -0.5), ("not_comparable", None), ("explainable", 0.0)]


def test_definition_drift_dimensions(spark):
    schema = "card_id string, concept_id string, definition string, scope string, denominator string, unit string"
    old = spark.createDataFrame([("a1", "c", "people served in a year", "rural", None, "lakh")], schema)
    new = spark.createDataFrame([("a2", "c", "people served in a year", "urban", "household", "crore")], schema)
    got = {r["drift_type"]: (r["decision"], r["impact"]) for r in compare.definition_drift(old, new).collect()}
    assert got == {"scope": ("partial", 0.4), "denominator": ("partial", 0.3), "unit": ("partial", 0.55)}
    assert compare.definition_drift(old, old).count() == 0


def test_definition_drift_in_case_units_and_bases(spark):
    schema = "card_id string, concept_id string, definition string, scope string, denominator string, unit string"
    card = lambda i, concept, *rest: (f"{i}-{concept}", concept, *rest)
    plain = ("people served", "All", "household", "lakh")
    cases = {
        "case": (("People Served ", "all", "Household", " LAKH"), set()),
        "alias": (("people served", "All", "household", "lac"), set()),
        "unknown base": (("people served", "All", "household", "acres"), {("unit", "partial", 0.5)}),
        "two bases": (("people served", "All", "household", "inr crore"), {("unit", "not_comparable", 0.9)}),
        "no unit": (("people served", "All", "household", None), {("unit", "partial", 0.2)}),
        "denominator": (("people served", "All", "person", "lakh"), {("denominator", "not_comparable", 0.9)}),
        "other": (("something else entirely", "All", "household", "lakh"), {("definition", "not_comparable", 0.7)}),
    }
    old = spark.createDataFrame([card(1, c, *plain) for c in cases], schema)
    new = spark.createDataFrame([card(2, c, *after) for c, (after, _) in cases.items()], schema)
    got = compare.definition_drift(old, new).collect()
    for c, (_, want) in cases.items():
        assert {(r["drift_type"], r["decision"], r["impact"]) for r in got if r["concept_id"] == c} == want, c


def test_cards_are_read_out_of_names(spark):
    rows = [("a", "amount_inr_lakh", True, 0.0), ("a", "births_per_thousand_women", True, 0.6), ("a", "call_id", False, 0.0), ("a", "Approx_Count", True, 0.5)]
    got = {r["column"]: r for r in compare.infer_cards(spark.createDataFrame(rows, "artifact_id string, column string, is_metric boolean, null_ratio double")).collect()}
    assert set(got) == {"amount_inr_lakh", "births_per_thousand_women", "Approx_Count"}
    assert (got["amount_inr_lakh"]["concept_id"], got["amount_inr_lakh"]["unit"], got["amount_inr_lakh"]["denominator"]) == ("amount_inr", "lakh", None)
    r = got["births_per_thousand_women"]
    assert (r["concept_id"], r["unit"], r["denominator"], r["flags"], r["card_id"], r["status"]) == ("births", "count", "thousand women", "majority_null", "dc:a:births_per_thousand_women", "proposed")
    assert r["definition"].endswith("inferred unit 'count'; rate per thousand women") and got["Approx_Count"]["flags"] == "name_contains_approx"


def test_false_consensus(spark):
    rows = [("m", str(i), f"art{i}", "press" if i < 3 else None) for i in range(4)] + [("n", "9", "a", None)]
    got = compare.false_consensus(spark.createDataFrame(rows, "metric string, claim_id string, artifact_id string, derived_from string")).collect()
    assert [(r["metric"], r["apparent_sources"], r["distinct_origins"], r["severity"]) for r in got] == [("m", 4, 2, "high")]
    blank = spark.createDataFrame([("m", "1", "a", ""), ("m", "2", "b", "")], "metric string, claim_id string, artifact_id string, derived_from string")
    assert [(r["distinct_origins"], r["verdict"], r["confidence"]) for r in compare.false_consensus(blank).collect()] == [(2, "independent_corroboration", "high")]


@pytest.mark.parametrize("label, year, flags", [("FY 2024-25", "2024-25", ["fiscal_year"]), ("f.y. 2024-2025 (CE)", "2024-25", ["fiscal_year"]), ("2024/25", "2024-25", ["fiscal_year"]), ("2024–27", "2024-25", ["fiscal_year", "fiscal_year_label_inconsistent"]), ("1999-00", "1999-00", ["fiscal_year"]), ("someday", None, ["not_a_fiscal_year_label"]), (None, None, ["not_a_fiscal_year_label"])])
def test_fiscal_years(spark, label, year, flags):
    r = spark.createDataFrame([(label,)], "l string").select(X.fiscal_year(F.col("l")).alias("f")).first()["f"]
    assert (r["fiscal_year"], r["flags"]) == (year, flags)


def test_units(spark):
    rows = spark.createDataFrame([("lakh",), (" Crore ",), ("nos",), ("furlong",), (None,)], "u string").select(X.unit_scale(F.col("u")).alias("s")).collect()
    assert [r["s"] for r in rows] == [1e5, 1e7, 1.0, None, None]


def test_text_functions(spark):
    r = spark.createDataFrame([(" SYSTEM : What is\n Fraud in lakh_units, जिले?",)], "t string").select(X.question_tokens(F.col("t")).alias("k"), X.redact(F.col("t")).alias("r"), X.sanitize(F.col("t")).alias("s"), X.has_devanagari(F.lit("कुल")).alias("d")).first()
    assert r["k"] == ["system", "fraud", "lakh_units", "district"] and r["d"]
    assert "[redacted judgment word] in" in r["r"] and r["s"] == "[blocked]: What is Fraud in lakh_units, जिले?"


def finding_rows(spark, ids):
    return spark.createDataFrame([(i, "z", "high", "open", i) for i in ids], "finding_id string, kind string, severity string, status string, created_at string").withColumns({"note": F.lit(None).cast("string"), "title": F.lit("t"), "summary": F.lit("s")})


def test_ledger_appends_once_and_reviews(spark):
    old, new = finding_rows(spark, ["a"]), finding_rows(spark, ["a", "b", "b"])
    assert [r["finding_id"] for r in ledger.new_findings(old, new).collect()] == ["b"]
    reviews = spark.createDataFrame([("a", "not_detectable", "early", 1), ("a", "resolved", "ok", 2), ("b", "unheard", None, 1), ("b", "confirmed", None, 2), ("c", "open", None, 1)], "finding_id string, status string, note string, at int")
    after, bad = ledger.apply_reviews(finding_rows(spark, ["a", "b"]), reviews, "at")
    assert sorted((r["finding_id"], r["status"], r["note"]) for r in after.collect()) == [("a", "resolved", "ok"), ("b", "open", None)]
    assert [r["finding_id"] for r in bad.collect()] == ["b", "b"]
    page = ledger.queue(finding_rows(spark, "abc"), severity="high", limit=2).collect()
    assert [(r["finding_id"], r["total"]) for r in page] == [("c", 3), ("b", 3)]
    assert ledger.queue(finding_rows(spark, "abc"), text="t s").count() == 0


def test_upserts_take_the_last_of_repeated_keys(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k int, v string, at int")
    new = spark.createDataFrame([(2, "z", 1), (2, "c", 2), (3, "d", 1), (3, "d", 1)], "k int, v string, at int")
    assert sorted((r["k"], r["v"]) for r in ledger.upsert(old, new, "k", "at").collect()) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted((r["k"], r["v"]) for r in ledger.upsert(old, new.drop("at").withColumn("at", F.lit(5)), "k").collect()) == [(1, "a"), (2, "z"), (3, "d")]


def test_evidence_counts_and_truncates(spark):
    want = spark.createDataFrame([("f", "t", {"v": "5000"}), ("g", "t", {"v": "5000.0", "d": "E"}), ("h", "t", {"v": "x"}), ("i", "t", {"v": "-0.5"})], "finding_id string, artifact_id string, slice map<string,string>")
    stored = spark.createDataFrame([(i, 5000.0 if i % 2 else 5000.0 + i, "E" if i % 10 == 1 else "F") for i in range(60)] + [(60, -0.5000001, "E"), (61, 0.5, "E")], "row_number long, v double, d string")
    rows = ledger.evidence(want, tables.cells(stored).withColumn("artifact_id", F.lit("t")), most=25).collect()
    got = {f: [r for r in rows if r["finding_id"] == f] for f in "fghi"}
    assert len(got["f"]) == 25 and {r["matched"] for r in got["f"]} == {31} and all(r["truncated"] for r in got["f"])
    assert sorted(r["row_number"] for r in got["g"]) == [1, 11, 21, 31, 41, 51] and not got["h"] and [r["row_number"] for r in got["i"]] == [60]


def test_evidence_looks_equal_slices_up_once(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr(ledger, "materialize", lambda df, name="table": sizes.append((name, df.count())) or df)
    want = spark.createDataFrame([(f"f{i}", "t", {"v": "5.5"}) for i in range(40)] + [("g", "t", {"v": "5.5", "d": "E"})], "finding_id string, artifact_id string, slice map<string,string>")
    stored = spark.createDataFrame([(i, 5.5, "E" if i % 2 else "F") for i in range(40)], "row_number long, v double, d string")
    rows = ledger.evidence(want, tables.cells(stored).withColumn("artifact_id", F.lit("t")), most=25).collect()
    assert sorted((r["finding_id"], r["row_number"]) for r in rows if r["finding_id"] != "g") == sorted((f"f{i}", k) for i in range(40) for k in range(25))
    assert sorted(r["row_number"] for r in rows if r["finding_id"] == "g") == list(range(1, 40, 2)) and {r["matched"] for r in rows} == {40, 20}
    assert dict(sizes)["entries"] < 12  # three cells for an entry, not for a finding


def test_value_cells_are_neighbours(spark):
    rng = random.Random(9)
    near = []
    for _ in range(400):
        v = rng.choice([0.0, 1.0, -1.0, rng.uniform(-2, 2), rng.uniform(-1e9, 1e9), rng.uniform(-1e-6, 1e-6)])
        near.append((v, v + rng.uniform(-1, 1) * 1e-6 * max(abs(v), 1.0)))
    df = spark.createDataFrame(near, "a double, b double").select(F.abs(ledger.value_cell(F.col("a")) - ledger.value_cell(F.col("b"))).alias("d"), "a", "b")
    assert df.filter("d > 1").collect() == []
    assert spark.range(2000).select(ledger.value_cell(F.col("id") / 1000 - 1).alias("c")).distinct().count() == 2000


def test_titles_and_summaries(spark):
    rows = spark.createDataFrame([("anomaly", "ben", "district: E", 5000.0, 100.0), ("anomaly", "ben", None, 0.5, 0.0), ("anomaly", "m", "", 1234567.0, 12.5)], "kind string, metric string, slice string, observed double, expected double")
    got = [r["summary"] for r in ledger.titles_and_summaries(rows).collect()]
    assert got == ["We found 5000, but expected around 100 (4900% off) for district: E.", "We found 0.5, but expected close to 0 for overall.", "We found 1.23457e+06, but expected around 12.5 (9876436% off) for overall."]
    r = ledger.titles_and_summaries(spark.createDataFrame([("benford", "amt", 300, "marginal")], "kind string, column string, n_values int, conformity string")).first()
    assert r["title"] == "Unusual number pattern in 'amt'" and "somewhat unusual" in r["summary"]
    r = ledger.titles_and_summaries(spark.createDataFrame([("drift", "new", "area", "partial", 0.4)], "kind string, drift_type string, concept_id string, decision string, impact double")).first()
    assert (r["title"], r["summary"]) == ("How 'area' is measured changed", "Only partly comparable now, check before comparing directly. How big a change: 40%.")


def test_numbers_as_people_write_them(spark):
    values = [0.0, 1.0, -2.5, 100.0, 123456.0, 999999.5, 1234567.0, 1e-5, 0.000123456, 0.1 + 0.2, 5e20]
    got = [r["g"] for r in spark.createDataFrame([(v,) for v in values], "v double").select(X.general(F.col("v")).alias("g")).collect()]
    assert got == [f"{v:g}" for v in values]


def test_lineage_problems_and_paths(spark):
    chain = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(100)], "source string, target string")
    deep = {r["id"]: (r["depth"], r["path"][-4:]) for r in lineage.paths_to_raw(chain).collect()}
    assert deep["n100"] == (101, "n000") and deep["n041"] == (42, "n000") and len(deep) == 100
    with pytest.raises(ValueError, match="cycle"):
        lineage.paths_to_raw(spark.createDataFrame([("x", "y"), ("y", "x")], "source string, target string"))
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("c",), ("x",), ("y",)], "id string").withColumns({"kind": F.lit("k"), "label": F.lit("l")})
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("c", "lost")], "source string, target string").withColumn("relation", F.lit("r"))
    got = {(r["problem"], r["id"]) for r in lineage.validate(nodes, edges).collect()}
    assert got == {("duplicate_node", "c"), ("dangling_edge", "lost"), ("cycle", "x"), ("cycle", "y")}
    paths = {r["id"]: r["path"] for r in lineage.paths_to_raw(edges.filter("source IN ('a', 'b', 'c')")).collect()}
    assert paths == {"b": "b < a", "c": "c < b < a", "lost": "lost < c < b < a"}


def peeled(edges):
    left = set(edges)
    while True:
        targets = {t for _, t in left}
        rest = {(s, t) for s, t in left if s in targets}
        if rest == left:
            return {t for _, t in left}
        left = rest


def test_cycles_equal_peeling(spark, monkeypatch):
    rng = random.Random(5)
    for n, m in ((6, 6), (12, 14), (20, 19)):
        edges = [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)] + [(f"c{i}", f"c{i + 1}") for i in range(7)]
        got = lineage.on_or_below_cycles(spark.createDataFrame(edges, "source string, target string"))
        assert {r["id"] for r in got.collect()} == peeled(edges)
    rounds = []
    plain = lineage.materialize
    monkeypatch.setattr(lineage, "materialize", lambda df, name="t": rounds.append(name) or plain(df, name))
    chain = spark.range(10_000).select(F.col("id").cast("string").alias("source"), (F.col("id") + 1).cast("string").alias("target"))
    assert lineage.on_or_below_cycles(chain).isEmpty() and rounds.count("chains") < 20 and len(rounds) < 30


def test_lineage_of_repeated_findings(spark):
    artifacts = spark.createDataFrame([("a", True, "sha256:ab"), ("b", False, None)], "artifact_id string, has_profile boolean, detail string")
    found = spark.createDataFrame([("f", "a", "iqr", "high"), ("f", "a", "zscore", "low"), ("g", "b", "iqr", "low")], "finding_id string, artifact_id string, rule string, severity string")
    nodes, edges = lineage.build(artifacts, found)
    ids = {r["id"]: r["kind"] for r in nodes.collect()}
    assert {i for i, k in ids.items() if k == "finding"} == {"finding:a:f", "finding:a:f#1"} and ids["raw:a"] == "raw_artifact" and "profile:b" not in ids
    assert {r["relation"] for r in edges.collect()} == {"parsed_by", "profiled_by", "executed_over", "produced"} and lineage.validate(nodes, edges).count() == 0


def held_cards(spark):
    artifacts = spark.createDataFrame([("wheat-data", "Wheat by district", "agri", "text/csv", 10, "ab" * 32)], "artifact_id string, title string, source_id string, media_type string, byte_size long, sha256 string")
    columns = spark.createDataFrame([("wheat-data", "yield_per_acre", "double", 0.25, 9)], "artifact_id string, column string, dtype string, null_ratio double, unique_count long")
    observed = spark.createDataFrame([("wheat-data", "DUPLICATE_ROWS", "low", None)], "artifact_id string, code string, severity string, column string")
    found = spark.createDataFrame([("f1", ["wheat-data"], "anomaly", "high", "Unusual yield", "fraud in wheat"), ("f2", ["wheat-data"], "drift", "low", "Wheat", "changed")], "finding_id string, artifact_ids array<string>, kind string, severity string, title string, summary string")
    return retrieval.evidence_cards(artifacts, columns, observed, found)


def test_retrieval_weighs_fields_and_refuses(spark):
    asked = spark.createDataFrame([("q1", "wheat yield"), ("q2", "zzz"), ("q3", "गड़बड़ी yield"), ("q4", "duplicate rows")], "question_id string, text string")
    cards = held_cards(spark)
    found = retrieval.retrieve(asked, cards)
    got = {(r["question_id"], r["evidence_id"]): r["score"] for r in found.collect()}
    assert got[("q1", "finding:f1")] == 6.5 and got[("q1", "finding:f2")] == 3.0 and got[("q1", "artifact:wheat-data")] == 2.0 and got[("q1", "wheat-data#column=yield_per_acre")] == 3.0
    assert got[("q4", "wheat-data#DUPLICATE_ROWS")] == 5.0
    titles = spark.createDataFrame([("wheat-data", "Wheat by district")], "artifact_id string, title string")
    out = {r["question_id"]: r for r in retrieval.answers(asked, found, cards, titles).collect()}
    assert out["q2"]["answer"] == retrieval.REFUSAL and not out["q2"]["cited"] and out["q2"]["confidence"] == "low"
    lines = out["q1"]["answer"].split("\n")
    assert lines[0] == 'Yes - 2 flagged problem(s) (changed definition, unusual number) across 1 file(s) relevant to "wheat yield".'
    assert "  [E1] Unusual yield - [redacted judgment word] in wheat (in Wheat by district, high severity)" in lines and out["q1"]["confidence"] == "moderate" and out["q1"]["cited"]
    assert out["q3"]["answer"].startswith(retrieval.HINDI_LEAD) and out["q4"]["answer"].startswith("No flagged problems match")


def test_rates_without_denominator_are_null(spark):
    cases = spark.createDataFrame([], "case_id string, n_artifacts long, n_findings long, n_complete long")
    decisions = spark.createDataFrame([], "decision_id long, case_id string, decision string, decided_at long")
    r = evaluation.report(cases, decisions).first()
    assert r["coverage"] is None and r["detectability"] is None and r["evidence_completeness"] is None and r["n_cases"] == 0


def test_findings_of_one_artifact_are_numbered_in_many_tasks(spark, monkeypatch):
    artifacts = spark.range(3).selectExpr("CONCAT('a', id) AS artifact_id", "id < 2 AS has_profile")
    found = spark.range(4000).selectExpr("CONCAT('f', id % 3000) AS finding_id", "IF(id < 3900, 'a0', 'a2') AS artifact_id", "CONCAT('r', id % 2) AS rule")
    plans, plain = {}, lineage.materialize
    monkeypatch.setattr(lineage, "materialize", lambda df, name: plans.setdefault(name, df) is None or plain(df, name))
    nodes, _ = lineage.build(artifacts, found)
    assert nodes.filter("kind = 'finding'").count() == 3900 and nodes.filter("id LIKE '%#1'").count() == 900
    assert re.search(r"hashpartitioning\(artifact_id#\d+, finding_id#\d+", plans["found"]._jdf.queryExecution().executedPlan().toString())


def test_results_of_cases_make_no_pairs_of_cases_and_findings(spark, monkeypatch):
    cases = spark.range(2000).selectExpr("id AS case_id", "IF(id % 4 = 0, array(), IF(id % 4 = 1, array('a', 'b', 'a'), IF(id % 4 = 2, array('b', NULL), NULL))) AS linked_source_ids")
    artifacts = spark.createDataFrame([("A", "a"), ("B", "b"), ("B2", "b"), ("C", "c")], "artifact_id string, source_id string")
    rows = spark.range(1000).selectExpr("id AS finding_id", "IF(id % 2 = 0, array('A', 'B', 'B'), array('B2', 'C')) AS artifact_ids", "IF(id % 5 = 0, '', 'q') AS evidence_query")
    rows = rows.unionByName(rows.filter("finding_id < 10").withColumn("artifact_ids", F.array(F.lit("A"))))  # comes again, on another artifact
    made, plain = [], evaluation.materialize
    monkeypatch.setattr(evaluation, "materialize", lambda df, name: made.append(plain(df, name)) or made[-1])
    got = {r["case_id"]: (r["n_artifacts"], r["n_findings"], r["n_complete"]) for r in evaluation.case_results(cases, artifacts, rows).collect()}
    assert got == {i: [(0, 0, 0), (3, 1000, 800), (2, 1000, 800), (0, 0, 0)][i % 4] for i in range(2000)}
    assert made[1].count() == 3  # sets of artifacts, not findings
    found = evaluation.case_findings(cases, artifacts, rows)
    named = spark.createDataFrame([(1, 3), (1, 3), (2, 0), (0, 1), (1, 5000), (None, 1)], "case_id long, finding_id long")
    asked = evaluation.case_findings(cases, artifacts, rows, named)
    assert sorted(map(tuple, asked.collect())) == sorted(tuple(r) for r in found.join(named, ["case_id", "finding_id"], "left_semi").collect()) == [(1, 3, True), (2, 0, False)]
    assert found.count() == 1_000_000


def test_decisions_that_are_refused(spark):
    run = spark.createDataFrame([("c1", "f1"), ("c2", "f2"), ("c3", None)], "case_id string, finding_id string")
    rows = [(1, "c1", "detected", ["f1"]), (2, "c1", "detected", ["f2"]), (3, "c2", "partially_detected", []), (4, "c9", "not_detected", []), (5, "c3", "not_detectable", []), (6, "c1", "missed", []), (7, "c1", None, None)]
    got = {(r["decision_id"], r["reason"]) for r in evaluation.rejects(spark.createDataFrame(rows, "decision_id int, case_id string, decision string, finding_ids array<string>"), run).collect()}
    assert got == {(2, "foreign_finding"), (3, "no_findings"), (4, "foreign_case"), (6, "unknown_decision"), (7, "unknown_decision")}


def test_leaks_of_labels_and_ids(spark):
    labels = spark.createDataFrame([(1, "secret words of the case, never shown anywhere"), (2, "a b c d e f"), (3, None)], "item long, text string")
    texts = spark.createDataFrame([(10, "x SECRET words, of the case y"), (11, "words of that case never seen"), (12, "a b c d e f"), (13, None)], "doc long, text string")
    assert {tuple(r) for r in evaluation.label_leaks(texts, labels, "doc", "item").collect()} == {(10, 1, 1)}
    ids = spark.createDataFrame([("CASE-7",), ("9",)], "case_id string")
    named = spark.createDataFrame([(1, "see CASE-7."), (2, "case-7"), (3, "CASE-77 and 99"), (4, "item 9!"), (5, None)], "doc long, text string")
    assert {tuple(r) for r in evaluation.id_leaks(named, ids, "doc", "case_id").collect()} == {(1, "CASE-7"), (4, "9")}


def test_prefix_guard_finds_every_position(spark):
    label = "hidden label text, which must not leak out anywhere"
    texts = [(i, "x" * i + label[:40] + "tail") for i in range(14)] + [(90, "x" + label[:39]), (91, None), (92, label[1:])]
    got = evaluation.prefix_guard(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(label,), ("short",), (None,)], "text string"), "id")
    assert {r["text_id"] for r in got.collect()} == set(range(14))


def test_retrieval_finds_words_within_words_and_keeps_the_best(spark, monkeypatch):
    import random

    rng = random.Random(4)
    bits = ["pay", "ment", "pays", "ledger", "wheat", "_", " ", "rice", "Crop", "é"]
    text = lambda n: "".join(rng.choice(bits) for _ in range(n))
    asked = [(f"q{i}", text(8)) for i in range(60)] + [("p", "payment")]
    found = [(f"f{i}", [f"a{i % 7}"], "drift", rng.choice(["high", "low", "critical"]), text(3), text(rng.choice([0, 5, 300]))) for i in range(90)] + [("x", [], "drift", "low", "Payments ledger", None)]
    findings = spark.createDataFrame(found, "finding_id string, artifact_ids array<string>, kind string, severity string, title string, summary string").repartition(3)
    none = spark.createDataFrame([], "artifact_id string, title string, source_id string, media_type string, byte_size long, sha256 string")
    columns = spark.createDataFrame([], "artifact_id string, column string, dtype string, null_ratio double, unique_count long")
    observed = spark.createDataFrame([], "artifact_id string, code string, severity string, column string")
    cards = retrieval.evidence_cards(none, columns, observed, findings)
    questions = spark.createDataFrame(asked, "question_id string, text string")
    words = {r[0]: r[1] for r in questions.select("question_id", X.question_tokens(F.col("text"))).collect()}
    want = {}
    for q, _ in asked:
        scores = []
        for i, _, kind, severity, title, summary in found:
            blob = " ".join(x for x in (title, summary, kind) if x is not None).lower()
            n = sum(w in blob for w in words[q])
            scores += [(-3.0 * n - 0.5 * (severity != "low"), f"finding:{i}")] if n else []
        want |= {(q, rank + 1): (e, -s) for rank, (s, e) in enumerate(sorted(scores)[: retrieval.MOST])}
    for name, size in (("PASS", 32_768), ("BLOCK", 16), ("CARDS", 7), ("PASS", 20)):
        monkeypatch.setattr(retrieval, name, size)
        assert {(r["question_id"], r["rank"]): (r["evidence_id"], r["score"]) for r in retrieval.retrieve(questions, cards).collect()} == want
    ledger = retrieval.evidence_cards(none, columns, observed, findings.filter("finding_id = 'x'"))
    assert {r["question_id"] for r in retrieval.retrieve(questions.filter("question_id = 'p'"), ledger).collect()} == {"p"}
    kept = retrieval.newest(findings.withColumn("created", F.length("finding_id")), "created", 3).select("finding_id").collect()
    assert sorted(r[0] for r in kept) == ["f10", "f11", "f12"]


def test_questions_of_rare_words_are_joined(spark, monkeypatch):
    scanned, scan = [], retrieval.scan
    monkeypatch.setattr(retrieval, "PASS", 20)
    monkeypatch.setattr(retrieval, "scan", lambda asked, n, *rest: scanned.append(n) or scan(asked, n, *rest))
    found = [(f"f{i}", ["a"], "drift", "low", f"column_{i}x", "wheat" if i % 10 == 0 else None) for i in range(200)]
    findings = spark.createDataFrame(found, "finding_id string, artifact_ids array<string>, kind string, severity string, title string, summary string")
    none = lambda schema: spark.createDataFrame([], schema)
    cards = retrieval.evidence_cards(
        none("artifact_id string, title string, source_id string, media_type string, byte_size long, sha256 string"), none("artifact_id string, column string, dtype string, null_ratio double, unique_count long"),
        none("artifact_id string, code string, severity string, column string"), findings)
    questions = spark.createDataFrame([(f"q{i}", f"Wheat column_{i}x") for i in range(200)], "question_id string, text string")
    got = {(r["question_id"], r["rank"]): (r["evidence_id"], r["score"]) for r in retrieval.retrieve(questions, cards).collect()}
    wheat = sorted(f"finding:f{i}" for i in range(0, 200, 10))
    for i in range(200):
        best = sorted([(-3.0 * (1 + (i % 10 == 0)), f"finding:f{i}")] + [(-3.0, e) for e in wheat if e != f"finding:f{i}"])[:6]
        assert [got[f"q{i}", k + 1] for k in range(6)] == [(e, -s) for s, e in best]
    assert scanned == [1]


def test_cards_tell_hints_and_descriptions(spark):
    artifacts = spark.createDataFrame([("a", "T", "s", "text/csv", 10, "ab" * 32)], "artifact_id string, title string, source_id string, media_type string, byte_size long, sha256 string")
    columns = spark.createDataFrame([("a", "mail", "string", 0.25, 9, "email"), ("b", "n", "int", 0.0, 1, None)], "artifact_id string, column string, dtype string, null_ratio double, unique_count long, hints string")
    observed = spark.createDataFrame([("a", "DUPLICATE_ROWS", "low", None, "3 rows repeat")], "artifact_id string, code string, severity string, column string, description string")
    found = spark.createDataFrame([], "finding_id string, artifact_ids array<string>, kind string, severity string, title string, summary string")
    cards = retrieval.evidence_cards(artifacts, columns, observed, found)
    said = {r["evidence_id"]: r["snippet"] for r in cards.collect()}
    assert said["a#column=mail"].endswith("9 unique; PII hints: email") and said["b#column=n"].endswith("1 unique") and said["a#DUPLICATE_ROWS"] == "LOW DUPLICATE_ROWS: 3 rows repeat"
    asked = spark.createDataFrame([("q", "rows that repeat")], "question_id string, text string")
    assert retrieval.retrieve(asked, cards).first()["score"] == 5.0


def test_findings_have_caveats(spark):
    found = spark.createDataFrame([("zscore", 4.0), ("yoy", None), ("yoy", 300.0), ("rolling", None)], "method string, score double")
    got = [(r["confidence"], r["caveats"]) for r in anomaly.with_caveats(found).collect()]
    assert got == [("high", [anomaly.CAVEATS["zscore"]]), ("moderate", [anomaly.ZERO_BASELINE]), ("moderate", [anomaly.CAVEATS["yoy"]]), ("moderate", [anomaly.CAVEATS["rolling"]])]


def test_cards_and_questions_of_one_file_are_dealt_out(spark, monkeypatch):
    parts, plain = {}, retrieval.materialize
    monkeypatch.setattr(retrieval, "PASS", 20)
    monkeypatch.setattr(retrieval, "materialize", lambda df, name: (parts.setdefault(name, df.rdd.getNumPartitions()), plain(df, name))[1])
    fields = "array<struct<field:string,text:string>>"
    cards = spark.createDataFrame([(f"e{i}", "a", "drift", "low", "", [("finding", f"Wheat w{i}x"), ("title", None)]) for i in range(100)], f"evidence_id string, artifact_id string, kind string, severity string, snippet string, fields {fields}")
    asked = spark.createDataFrame([(f"q{i}", f"w{i}x of the") for i in range(100)], "question_id string, text string")
    got = {(r["question_id"], r["evidence_id"], r["score"]) for r in retrieval.retrieve(asked.coalesce(1), cards.coalesce(1)).collect()}
    assert got == {(f"q{i}", f"e{i}", 3.0) for i in range(100)}
    assert parts["asked"] > 1 and parts["cards"] > 1
