"""Anomaly and first-digit queries over events and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from attestra.functions import exprs as X
from attestra.operators import anomaly, benford
from attestra.plans.base import query, table

OUT = ["metric", "row_id", "method", "observed", "expected", "score", "severity"]


def rounded(df: DataFrame, columns: list[str] = OUT) -> DataFrame:
    return df.select(*[F.round(c, 4).alias(c) if c in ("observed", "expected", "score") else F.col(c) for c in columns])


def event_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events.value by event, entity its type, period its time."""
    return anomaly.long_frame(table(spark, sf_dir, "events"), ["value"], F.col("event_id"), F.col("event_type"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def yearly_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals by customer and year."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("sales"))
    return anomaly.long_frame(orders, ["sales"], F.col("o_custkey") * 10000 + F.col("y"), F.col("o_custkey").cast("string"), F.col("y").cast("string"))


SEVERITY = "CASE WHEN abs({z}) >= 4 THEN 'high' WHEN abs({z}) >= 3 THEN 'medium' ELSE 'low' END"
ZSCORE = f"""
  SELECT 'value' AS metric, event_id AS row_id, event_type AS entity, 'zscore' AS method, value AS observed, mean AS expected, (value - mean) / sd AS score,
    {SEVERITY.format(z='((value - mean) / sd)')} AS severity
  FROM events, (SELECT avg(value) AS mean, stddev_samp(value) AS sd, count(value) AS n FROM events) WHERE n >= 3 AND sd > 0 AND abs((value - mean) / sd) > 3"""
IQR = f"""
  SELECT 'value' AS metric, event_id AS row_id, event_type AS entity, 'iqr' AS method, value AS observed, q3 AS expected,
    CASE WHEN q3 > q1 THEN (value - q3) / (q3 - q1) END AS score,
    CASE WHEN q3 > q1 THEN {SEVERITY.format(z='((value - q3) / (q3 - q1))')} ELSE 'medium' END AS severity
  FROM events, (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, count(value) AS n FROM events)
  WHERE n >= 4 AND (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1))"""
SALES = "(SELECT o_custkey, year(o_orderdate) AS y, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS v FROM orders GROUP BY ALL)"
CHANGE = f"""
  SELECT 'sales' AS metric, o_custkey * 10000 + y AS row_id, CAST(o_custkey AS VARCHAR) AS entity, 'yoy' AS method, v AS observed, p AS expected,
    CASE WHEN p <> 0 THEN (v - p) / abs(p) * 100 END AS score,
    CASE WHEN p = 0 OR abs((v - p) / abs(p) * 100) > 500 THEN 'high' ELSE 'medium' END AS severity
  FROM (SELECT *, lag(v) OVER (PARTITION BY o_custkey ORDER BY y) AS p FROM {SALES})
  WHERE (p <> 0 AND abs((v - p) / abs(p) * 100) > 200) OR (p = 0 AND v <> 0)"""


def sql_rounded(sql: str) -> str:
    return f"SELECT metric, row_id, method, round(observed, 4) AS observed, round(expected, 4) AS expected, round(score, 4) AS score, severity FROM ({sql})"


@query(sql_rounded(ZSCORE))
def anomaly_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(anomaly.detect_zscore(event_values(spark, sf_dir)))


@query(sql_rounded(IQR))
def anomaly_iqr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(anomaly.detect_iqr(event_values(spark, sf_dir)))


@query(sql_rounded(CHANGE))
def anomaly_yoy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(anomaly.detect_change(yearly_sales(spark, sf_dir)))


@query(f"""
  WITH w AS (
    SELECT event_id, value, list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS past FROM events),
  m AS (SELECT event_id, value, past, list_sort(past)[2] AS median FROM w WHERE len(list_filter(past, lambda x: x IS NOT NULL)) = 3 AND value IS NOT NULL),
  d AS (SELECT *, list_sort(list_transform(past, lambda x: abs(x - median)))[2] * 1.4826 AS mad FROM m)
  SELECT 'value' AS metric, event_id AS row_id, 'rolling' AS method, round(value, 4) AS observed, round(median, 4) AS expected,
    round(CASE WHEN mad > 0 THEN (value - median) / mad END, 4) AS score,
    CASE WHEN mad > 0 THEN {SEVERITY.format(z='((value - median) / mad)')} ELSE 'medium' END AS severity
  FROM d WHERE (mad > 0 AND abs((value - median) / mad) > 3) OR (mad = 0 AND value <> median)""")
def anomaly_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = anomaly.long_frame(table(spark, sf_dir, "events"), ["value"], F.col("event_id"), F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return rounded(anomaly.detect_rolling(rows))


def all_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of the detectors: z-score and IQR of events.value, change of yearly sales."""
    events = event_values(spark, sf_dir)
    return anomaly.detect_zscore(events).unionByName(anomaly.detect_iqr(events)).unionByName(anomaly.detect_change(yearly_sales(spark, sf_dir)))


ALL = f"({ZSCORE} UNION ALL {IQR} UNION ALL {CHANGE})"


@query(f"SELECT method, metric, severity, count(*) AS n, count(DISTINCT entity) AS entities FROM {ALL} GROUP BY ALL")
def anomaly_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_findings(spark, sf_dir).groupBy("method", "metric", "severity").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("entity").alias("entities"))


@query(f"""
  SELECT method, CASE method WHEN 'yoy' THEN 'moderate' ELSE 'high' END AS confidence, CASE method WHEN 'zscore' THEN '{anomaly.CAVEATS["zscore"]}' WHEN 'iqr' THEN '{anomaly.CAVEATS["iqr"]}'
    ELSE CASE WHEN score IS NULL THEN '{anomaly.ZERO_BASELINE}' ELSE '{anomaly.CAVEATS["yoy"]}' END END AS caveats, count(*) AS n FROM {ALL} GROUP BY ALL""")
def anomaly_caveats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How sure findings are, and what is said of them."""
    found = anomaly.with_caveats(all_findings(spark, sf_dir))
    return found.groupBy("method", "confidence", F.array_join("caveats", "; ").alias("caveats")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""
  SELECT entity, row_id, round(score, 4) AS score, severity, rank, format('{{}}-{{}}-{{:03d}}', method, metric, rank - 1) AS finding_id FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY entity ORDER BY round(coalesce(abs(score), CAST('inf' AS DOUBLE)), 9) DESC, metric, method, row_id) AS INT) AS rank
    FROM ({ZSCORE} UNION ALL {IQR})) WHERE rank <= {anomaly.MOST}""")
def anomaly_top12(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = event_values(spark, sf_dir)
    found = anomaly.detect_zscore(events).unionByName(anomaly.detect_iqr(events)).withColumn("score", F.round("score", 9))
    return anomaly.strongest(found, ["entity"]).select("entity", "row_id", F.round("score", 4).alias("score"), "severity", "rank", "finding_id")


def screened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(column, row_id, value) of the numeric columns that first-digit screening looks at."""
    parts = [
        table(spark, sf_dir, t).select(F.lit(c).alias("column"), F.col(key).cast("long").alias("row_id"), F.col(c).cast("double").alias("value"))
        for t, key, c in (("orders", "o_orderkey", "o_totalprice"), ("customer", "c_custkey", "c_acctbal"), ("lineitem", "l_orderkey", "l_extendedprice"), ("events", "event_id", "value"), ("part", "p_partkey", "p_retailprice"))
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sql_digit(x: str) -> str:
    power = f"floor(log10(abs({x})))"
    at = lambda p: f"CAST(floor(abs({x}) / pow(10.0, {p})) AS INT)"
    return f"CASE WHEN {x} IS NOT NULL AND {x} <> 0 AND NOT isnan({x}) AND NOT isinf({x}) THEN least(CASE WHEN {at(power)} < 1 THEN {at(power + ' - 1')} ELSE {at(power)} END, 9) END"


SCREENED = """(SELECT 'o_totalprice' AS col, o_orderkey AS row_id, o_totalprice AS v FROM orders UNION ALL SELECT 'c_acctbal', c_custkey, c_acctbal FROM customer
  UNION ALL SELECT 'l_extendedprice', l_orderkey, l_extendedprice FROM lineitem UNION ALL SELECT 'value', event_id, value FROM events
  UNION ALL SELECT 'p_retailprice', p_partkey, p_retailprice FROM part)"""
DIGITS = f"""(
  WITH u AS (SELECT col, v, {sql_digit('v')} AS digit FROM {SCREENED}),
  s AS (SELECT col, count(*) AS n, max(log10(abs(v))) - min(log10(abs(v))) AS span FROM u WHERE digit IS NOT NULL GROUP BY col),
  c AS (SELECT col, digit, count(*) AS k FROM u WHERE digit IS NOT NULL GROUP BY ALL)
  SELECT s.col AS "column", n, CAST(d.digit AS INT) AS digit, coalesce(k, 0) AS "count", coalesce(k, 0) / n AS observed_share, log10(1 + 1 / d.digit) AS expected_share,
    coalesce(k, 0) / n - log10(1 + 1 / d.digit) AS excess
  FROM s CROSS JOIN (SELECT unnest(range(1, 10)) AS digit) d LEFT JOIN c ON c.col = s.col AND c.digit = d.digit WHERE n >= {benford.LEAST_VALUES} AND span >= {benford.LEAST_MAGNITUDES})"""


@query(f"SELECT col AS \"column\", {sql_digit('v')} AS digit, count(*) AS n FROM {SCREENED} GROUP BY ALL")
def first_digit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screened(spark, sf_dir).groupBy("column", X.first_digit(F.col("value")).alias("digit")).agg(F.count(F.lit(1)).alias("n"))


@query(f'SELECT "column", n, digit, "count", round(observed_share, 4) AS observed_share, round(expected_share, 4) AS expected_share, round(excess, 4) AS excess FROM {DIGITS}')
def benford_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = benford.digit_table(screened(spark, sf_dir))
    return out.select("column", "n", "digit", "count", *[F.round(c, 4).alias(c) for c in ("observed_share", "expected_share", "excess")])


@query(f"""
  SELECT "column", n_values, mad, conformity, CASE conformity WHEN 'marginal' THEN 'medium' WHEN 'nonconformity' THEN 'high' END AS severity, top_digits FROM (
    SELECT *, CASE WHEN mad < 0.006 THEN 'close' WHEN mad < 0.012 THEN 'acceptable' WHEN mad < 0.015 THEN 'marginal' ELSE 'nonconformity' END AS conformity FROM (
      SELECT "column", n AS n_values, round(avg(abs(excess)), 5) AS mad, array_to_string(list(CAST(digit AS VARCHAR) ORDER BY -abs(excess), digit)[1:3], ',') AS top_digits
      FROM {DIGITS} GROUP BY ALL))""")
def benford_mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benford.conformity_table(benford.digit_table(screened(spark, sf_dir)))


@query(f"""
  WITH w AS (SELECT "column" AS col, arg_max(digit, excess) AS worst FROM {DIGITS} GROUP BY 1)
  SELECT col AS "column", worst, count(*) AS n, sum(row_id)::BIGINT AS id_sum FROM {SCREENED} JOIN w USING (col) WHERE {sql_digit('v')} = worst GROUP BY ALL""")
def benford_evidence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = screened(spark, sf_dir)
    rows = benford.evidence_rows(values, benford.digit_table(values))
    return rows.groupBy("column", "worst").agg(F.count(F.lit(1)).alias("n"), F.sum("row_id").alias("id_sum"))


@query(f"""
  SELECT row_id, method, entity AS slice, method || ' over value slice=' || entity AS evidence_query FROM ({ZSCORE} UNION ALL {IQR})""")
def anomaly_query_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = event_values(spark, sf_dir)
    found = anomaly.query_text(anomaly.detect_zscore(events).unionByName(anomaly.detect_iqr(events)))
    return found.select("row_id", "method", "slice", "evidence_query")
