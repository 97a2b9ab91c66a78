"""Profile queries over orders, customers, events and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from attestra.operators import profile
from attestra.plans.base import query, table

NUMERIC = ["o_orderkey", "o_custkey", "o_totalprice"]
COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
TEXTUAL = ["o_custkey", "o_orderstatus", "o_orderpriority"]


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders")


def _skew(c: str) -> str:
    x = f"CAST({c} AS DOUBLE)"
    return f"(SELECT round(avg(pow({x} - m, 3)) / pow(avg(pow({x} - m, 2)), 1.5), 4) FROM orders, (SELECT avg({x}) AS m FROM orders))"


def _stats(c: str) -> str:
    x = f"CAST({c} AS DOUBLE)"
    numbers = f"round(min({x}), 4), round(max({x}), 4), round(avg({x}), 2), round(stddev_samp({x}), 2), {_skew(c)}" if c in NUMERIC else "NULL, NULL, NULL, NULL, NULL"
    return f"SELECT '{c}', {'true' if c in NUMERIC else 'false'}, count(*), count(*) - count({c}), round((count(*) - count({c})) / greatest(count(*), 1), 4), {numbers} FROM orders"


@query("SELECT * FROM (" + " UNION ALL ".join(map(_stats, COLUMNS)) + ') t("column", is_numeric, row_count, null_count, null_ratio, min, max, mean, stddev, skewness)')
def profile_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = profile.column_stats(orders(spark, sf_dir))
    return out.select("column", "is_numeric", "row_count", "null_count", "null_ratio", F.round("min", 4).alias("min"), F.round("max", 4).alias("max"), F.round("mean", 2).alias("mean"), F.round("stddev", 2).alias("stddev"), F.round("skewness", 4).alias("skewness"))


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}', " + ", ".join(f"round(quantile_cont(CAST({c} AS DOUBLE), {q}), 2)" for q in profile.QUANTILES) + " FROM orders" for c in NUMERIC) + ') t("column", p5, p25, p50, p75, p95)')
def profile_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.column_stats(orders(spark, sf_dir).select(*NUMERIC)).select("column", *[F.round(f"p{p}", 2).alias(f"p{p}") for p in (5, 25, 50, 75, 95)])


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}', " + ", ".join(f"xs[CAST(floor((len(xs) - 1) * {q} + 0.5) AS BIGINT) + 1]" for q in profile.QUANTILES) + f" FROM (SELECT list_sort(list(CAST({c} AS DOUBLE))) AS xs FROM orders)" for c in NUMERIC) + ') t("column", p5, p25, p50, p75, p95)')
def profile_quantiles_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = profile.nearest_quantiles(orders(spark, sf_dir), NUMERIC)
    return rows.select("column", *[F.round(f"p{p}", 2).alias(f"p{p}") for p in (5, 25, 50, 75, 95)])


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS unique_count FROM orders" for c in COLUMNS))
def profile_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.distinct_counts(profile.value_counts(orders(spark, sf_dir)))


VALUES = "(" + " UNION ALL ".join(f"SELECT '{c}' AS col, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM orders WHERE {c} IS NOT NULL GROUP BY ALL" for c in TEXTUAL) + ")"


@query(f"SELECT col AS \"column\", value, n, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY col ORDER BY n DESC, value) AS INT) AS rank FROM {VALUES}) WHERE rank <= 5")
def profile_top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.top_values(profile.value_counts(orders(spark, sf_dir), TEXTUAL))


@query(f"SELECT col AS \"column\", value, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY col ORDER BY value) AS INT) AS rank FROM {VALUES}) WHERE rank <= 5")
def profile_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.sample_values(profile.value_counts(orders(spark, sf_dir), TEXTUAL))


@query("SELECT CAST(sum(n) AS BIGINT) AS row_count, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_returnflag, l_linestatus)")
def profile_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.duplicate_rows(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS row_count FROM orders HAVING count({c}) = count(*) AND count(DISTINCT {c}) = count(*) AND count(*) > 1" for c in COLUMNS))
def candidate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = orders(spark, sf_dir)
    return profile.candidate_keys(profile.column_stats(df), profile.distinct_counts(profile.value_counts(df)))


def flawed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem columns with derived flaws: an all-null and a mostly null column, constant ones with and without nulls, zeros as the least value with
    and without values above, repeated rows."""
    line = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_discount", F.lit(None).cast("int").alias("no_value"), F.when(line == 1, F.col("l_quantity")).alias("first_quantity"), F.lit("x").alias("same"),
        F.when(line > 1, "y").alias("partly"), (F.col("l_quantity") * 0).alias("nothing"))


FLAWED = """f AS (SELECT l_orderkey, l_discount, CAST(NULL AS INT) AS no_value, CASE WHEN l_linenumber = 1 THEN l_quantity END AS first_quantity, 'x' AS same,
    CASE WHEN l_linenumber > 1 THEN 'y' END AS partly, l_quantity * 0 AS nothing FROM lineitem),
  d AS (SELECT CAST(sum(n) AS DOUBLE) AS total, CAST(sum(n - 1) AS DOUBLE) AS dup FROM (SELECT count(*) AS n FROM f GROUP BY l_orderkey, l_discount, no_value, first_quantity, same, partly, nothing)),
  c AS (""" + " UNION ALL ".join(f"""SELECT '{c}' AS col, {m} AS metric, count(*) - count({c}) AS nulls, count(*) AS n, round((count(*) - count({c})) / count(*), 4) AS share, count(DISTINCT {c}) AS different, {f"CAST(min({c}) AS DOUBLE)" if n else "NULL"} AS low, {f"CAST(max({c}) AS DOUBLE)" if n else "NULL"} AS high FROM f"""
    for c, n, m in (("l_orderkey", True, "true"), ("l_discount", True, "true"), ("no_value", True, "true"), ("first_quantity", True, "true"), ("same", False, "false"), ("partly", False, "false"), ("nothing", True, "true"))) + """),
  o AS (
    SELECT 'COLUMN_ALL_NULL' AS code, 'high' AS severity, col FROM c WHERE nulls = n UNION ALL SELECT 'COLUMN_HIGH_NULL_RATIO', 'medium', col FROM c WHERE 2 * nulls > n AND nulls < n
    UNION ALL SELECT 'COLUMN_CONSTANT', 'low', col FROM c WHERE different = 1 AND nulls = 0 UNION ALL SELECT 'ZERO_MIN_NUMERIC', 'info', col FROM c WHERE low = 0 AND high > 0
    UNION ALL SELECT 'DUPLICATE_ROWS', CASE WHEN dup > 0.01 * total THEN 'medium' ELSE 'low' END, NULL FROM d WHERE dup > 0)"""


@query(f'WITH {FLAWED} SELECT code, severity, col AS "column" FROM o')
def quality_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.Profile(flawed(spark, sf_dir)).observations


@query("""
  WITH e AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9._-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+')) AS email FROM documents),
  v AS (SELECT email, count(*) AS n FROM e GROUP BY email)
  SELECT 'email' AS "column", 'email' AS hint_type, CAST(sum(n) AS BIGINT) AS matched_values, array_to_string(list(email ORDER BY email)[1:3], ',') AS samples
  FROM v WHERE regexp_matches(email, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') HAVING count(*) > 0""")
def pii_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every address in every text is a value of a column named email."""
    found = F.regexp_extract_all("text", F.lit(r"([A-Za-z0-9._-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"), F.lit(1))
    return profile.pii_hints(table(spark, sf_dir, "documents").select(F.explode(found).alias("email")))


SKEW = "(SELECT abs(avg(pow(x - m, 3)) / nullif(pow(avg(pow(x - m, 2)), 1.5), 0)) FROM (SELECT CAST({c} AS DOUBLE) AS x, avg(CAST({c} AS DOUBLE)) OVER () AS m FROM f) WHERE x IS NOT NULL)"


def _flag(c: str) -> str:
    return f"CASE WHEN (SELECT stddev_samp(CAST({c} AS DOUBLE)) FROM f) = 0 OR coalesce({SKEW.format(c=c)} > 5, false) THEN 1 ELSE 0 END"


FITNESS_SQL = f"""
  WITH {FLAWED},
  cost AS (SELECT coalesce(sum(CASE WHEN severity = 'high' THEN 30 END), 0) AS high, coalesce(sum(CASE severity WHEN 'medium' THEN 12 WHEN 'low' THEN 4 END), 0) AS other FROM o),
  p AS (
    SELECT 'completeness' AS component, round(greatest(0.0, 100 * (1 - (SELECT avg(share) FROM c))), 2) AS score, 0.30 AS weight
    UNION ALL SELECT 'duplication', round(100 * (1 - least(5 * dup / total, 1.0)), 2), 0.15 FROM d
    UNION ALL SELECT 'validity', greatest(0.0, 100.0 - high), 0.20 FROM cost
    UNION ALL SELECT 'consistency', greatest(0.0, 100.0 - other), 0.15 FROM cost
    UNION ALL SELECT 'identifier_exposure', 100.0, 0.10
    UNION ALL SELECT 'distribution_health', round(100.0 - 20.0 * ({" + ".join(map(_flag, ("l_orderkey", "l_discount", "no_value", "first_quantity", "nothing")))}) / 5, 2), 0.10),
  w AS (SELECT *, false AS whole FROM p UNION ALL SELECT 'overall', sum(score * weight) / sum(weight), 1.0, true FROM p)
  SELECT component, round(CAST(score AS DOUBLE), 2) AS score, CAST(weight AS DOUBLE) AS weight,
    CASE WHEN whole THEN CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END END AS grade FROM w"""


@query(FITNESS_SQL)
def fitness_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.fitness(flawed(spark, sf_dir))
