"""Ledger, lineage and evaluation queries over the findings on events.value."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from attestra.functions import exprs as X
from attestra.operators import anomaly, evaluation, ledger, lineage, runs
from attestra.plans import comparisons
from attestra.plans.anomalies import IQR, ZSCORE, event_values
from attestra.plans.base import query, table
from attestra.plans.comparisons import CONSENSUS, DRIFT
from attestra.sources import tables

STATUS = ["open", "needs_source_clarification", "open", "not_detectable", "false_positive_after_review"]


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """z-score and IQR findings on events.value as ledger rows; artifacts are the event table and the event's type, status goes by the id."""
    events = event_values(spark, sf_dir)
    rows = anomaly.detect_zscore(events).unionByName(anomaly.detect_iqr(events))
    status = F.element_at(F.array(*map(F.lit, STATUS)), (F.col("row_id") % len(STATUS) + 1).cast("int"))
    return rows.select(
        F.concat_ws("-", "method", F.col("row_id").cast("string")).alias("finding_id"), F.col("method").alias("kind"), "severity", status.alias("status"),
        F.concat(F.lit("Value of "), F.col("entity")).alias("title"), F.concat(F.lit("Found by "), F.col("method")).alias("summary"), F.col("row_id").alias("created_at"),
        F.array(F.lit("events"), F.concat(F.lit("type-"), F.col("entity"))).alias("artifact_ids"), F.lit(None).cast("string").alias("note"), "row_id", "observed",
        F.when(F.col("row_id") % 7 != 0, F.concat_ws(" ", "method", F.lit("over value"))).alias("evidence_query"), F.when(F.col("row_id") % 14 == 0, F.array(F.col("row_id"))).alias("evidence_spans"))


FINDINGS = f"""(SELECT method || '-' || row_id AS finding_id, method AS kind, severity, ['open', 'needs_source_clarification', 'open', 'not_detectable', 'false_positive_after_review'][row_id % 5 + 1] AS status, 'Value of ' || entity AS title,
  'Found by ' || method AS summary, row_id AS created_at, ['events', 'type-' || entity] AS artifact_ids, row_id, entity, observed, row_id % 7 <> 0 OR row_id % 14 = 0 AS complete FROM ({ZSCORE} UNION ALL {IQR}))"""


@query(f"SELECT finding_id FROM (SELECT DISTINCT 'value-' || row_id AS finding_id FROM {FINDINGS} WHERE kind = 'iqr') WHERE finding_id NOT IN (SELECT 'value-' || row_id FROM {FINDINGS} WHERE kind = 'zscore')")
def ledger_new_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger of the rows found by z-score takes all findings twice: only the rows that IQR alone found are new."""
    found = findings(spark, sf_dir).withColumn("finding_id", F.concat(F.lit("value-"), F.col("row_id").cast("string")))
    return ledger.new_findings(found.filter("kind = 'zscore'"), found.unionByName(found)).select("finding_id")


@query("""
  WITH n AS (SELECT o_custkey, round(arg_max(o_totalprice, (o_orderdate, o_totalprice)), 2) AS total FROM orders GROUP BY 1)
  SELECT c_custkey, round(c_acctbal, 2) AS c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM n) UNION ALL SELECT o_custkey, total FROM n""")
def artifact_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' balances, replaced by the total of the last order of those who ordered; every order comes in."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.round("c_acctbal", 2).alias("c_acctbal"), F.lit(None).cast("timestamp").alias("at"))
    incoming = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.round("o_totalprice", 2).alias("c_acctbal"), F.col("o_orderdate").alias("at"))
    return ledger.upsert(rows, incoming, "c_custkey", "at").drop("at")


@query("""WITH i AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
  SELECT l_orderkey, 'exists' AS reason FROM i WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') UNION ALL SELECT l_orderkey, 'repeated' FROM i WHERE n > 1""")
def ingest_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line items' order keys come in as ids; those of finished orders are taken."""
    existing = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return ledger.ingest_conflicts(existing, table(spark, sf_dir, "lineitem").select("l_orderkey"), "l_orderkey")


REGISTER = """(SELECT CAST(c_custkey AS VARCHAR) AS source_id, 'https://example.org/' || c_custkey AS source_url, CASE WHEN c_custkey % 7 = 0 THEN ' TBD ' ELSE c_name END AS retrieved_at,
    CASE WHEN c_custkey % 11 = 0 THEN ' ' WHEN c_custkey % 17 <> 0 THEN md5(c_name) END AS sha256, CASE WHEN c_custkey % 13 = 0 THEN 'unverified_candidate' ELSE 'verified' END AS access_status FROM customer)"""


def register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A register of sources out of customers, with fields that are blank, missing or still to be done."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.cast("string").alias("source_id"), F.concat(F.lit("https://example.org/"), k.cast("string")).alias("source_url"), F.when(k % 7 == 0, " TBD ").otherwise(F.col("c_name")).alias("retrieved_at"),
        F.when(k % 11 == 0, " ").when(k % 17 != 0, F.md5("c_name")).alias("sha256"), F.when(k % 13 == 0, "unverified_candidate").otherwise("verified").alias("access_status"))


@query(" UNION ALL ".join(f"SELECT source_id, '{c}' AS field, 'missing' AS problem FROM {REGISTER} WHERE coalesce(trim({c}), '') IN ('', 'TBD')" for c in tables.REGISTER_FIELDS) + f" UNION ALL SELECT source_id, 'access_status', 'unverified_candidate' FROM {REGISTER} WHERE access_status = 'unverified_candidate'")
def source_register_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.register_problems(register(spark, sf_dir))


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One artifact for each type of event, with its rows; only types with any value have a profile."""
    rows = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n_rows"), F.count("value").alias("n_values"), F.count_distinct("user_id").alias("n_users"))
    return rows.select(F.concat(F.lit("type-"), F.col("event_type")).alias("artifact_id"), F.col("event_type").alias("source_id"), "n_rows", "n_values", "n_users", (F.col("n_values") > 0).alias("has_profile"))


ARTIFACTS = "(SELECT 'type-' || event_type AS artifact_id, event_type AS source_id, count(*) AS n_rows, count(value) AS n_values, count(DISTINCT user_id) AS n_users FROM events GROUP BY event_type)"
BRIDGE = f"(SELECT *, unnest(artifact_ids) AS artifact_id FROM {FINDINGS})"


@query(f"SELECT a.artifact_id, n_rows, count(f.finding_id) AS n_findings, count(*) FILTER (WHERE f.severity = 'high') AS n_high FROM {ARTIFACTS} a LEFT JOIN {BRIDGE} f ON a.artifact_id = f.artifact_id GROUP BY ALL")
def case_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ledger.case_export(artifacts(spark, sf_dir), findings(spark, sf_dir))
    return out.groupBy("artifact_id", "n_rows").agg(F.count("finding_id").alias("n_findings"), F.count_if(F.col("severity") == "high").alias("n_high"))


@query(f"SELECT finding_id, severity, created_at, count(*) OVER () AS total FROM {FINDINGS} WHERE severity = 'high' AND (contains(lower(title), 'value') OR contains(lower(summary), 'value')) ORDER BY created_at DESC, finding_id LIMIT 25 OFFSET 5")
def findings_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.queue(findings(spark, sf_dir), severity="high", text="Value", limit=25, offset=5).select("finding_id", "severity", "created_at", "total")


@query(f"""
  SELECT artifact_id, source_id, n_rows AS row_count, CAST(1 AS BIGINT) AS column_count, CAST(n_values % 2 AS BIGINT) AS n_observations, round(100.0 * n_users / n_rows, 2)::DOUBLE AS score,
    CASE WHEN 100.0 * n_users / n_rows >= 90 THEN 'A' WHEN 100.0 * n_users / n_rows >= 75 THEN 'B' WHEN 100.0 * n_users / n_rows >= 60 THEN 'C' WHEN 100.0 * n_users / n_rows >= 40 THEN 'D' ELSE 'F' END AS grade,
    coalesce(n, 0) AS n_findings FROM {ARTIFACTS} LEFT JOIN (SELECT artifact_id, count(*) AS n FROM {BRIDGE} GROUP BY 1) USING (artifact_id)""")
def artifact_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of events with what their profile says: an observation where the number of values is odd, a score by the share of users."""
    held = artifacts(spark, sf_dir)
    columns = held.select("artifact_id", F.lit("value").alias("column"), F.col("n_rows").alias("row_count"))
    share = 100.0 * F.col("n_users") / F.col("n_rows")
    fitness = held.select("artifact_id", F.lit("overall").alias("component"), F.round(share, 2).alias("score"), X.grade(share).alias("grade"))
    return ledger.listing(held.select("artifact_id", "source_id"), columns, held.filter("n_values % 2 = 1"), fitness, findings(spark, sf_dir))


@query(f"SELECT artifact_id, finding_id FROM {BRIDGE} WHERE artifact_id <> 'events'")
def findings_by_artifact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.by_artifact(findings(spark, sf_dir)).filter("artifact_id <> 'events'").select("artifact_id", "finding_id")


@query(f"""
  WITH s AS (SELECT row_number() OVER (ORDER BY event_id) AS row_number, event_type, value FROM events),
  m AS (SELECT f.finding_id, row_number, row_number() OVER (PARTITION BY f.finding_id ORDER BY row_number) AS k, count(*) OVER (PARTITION BY f.finding_id) AS matched
    FROM {FINDINGS} f JOIN s ON abs(s.value - f.observed) <= 1e-6 * greatest(abs(f.observed), 1.0) AND (f.kind <> 'zscore' OR s.event_type = f.entity))
  SELECT finding_id, row_number, matched, matched > 25 AS truncated FROM m WHERE k <= 25""")
def evidence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored rows of each finding: of IQR findings by the value alone, of z-score findings by value and type of event."""
    rows = findings(spark, sf_dir)
    value = F.col("observed").cast("string")
    by = F.when(F.col("kind") == "zscore", F.create_map(F.lit("value"), value, F.lit("event_type"), F.expr("substr(artifact_ids[1], 6)"))).otherwise(F.create_map(F.lit("value"), value))
    want = rows.select("finding_id", F.lit("events").alias("artifact_id"), by.alias("slice"))
    stored = tables.numbered(table(spark, sf_dir, "events")).select("row_number", "event_type", "value")
    cells = tables.cells(stored).withColumn("artifact_id", F.lit("events"))
    return ledger.evidence(want, cells).select("finding_id", "row_number", "matched", "truncated")


@query(f"SELECT finding_id, 'Rows where event_type = ' || entity || ', value = ' || row_id AS label FROM {FINDINGS}")
def evidence_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = F.create_map(F.lit("value"), F.col("row_id").cast("string"), F.lit("event_type"), F.expr("substr(artifact_ids[1], 6)"))
    rows = findings(spark, sf_dir).select("finding_id", F.lit("anomaly").alias("kind"), F.lit("value").alias("metric"), by.alias("slice"), F.lit(None).cast("int").alias("digit"))
    return ledger.evidence_label(rows)


@query(f"SELECT finding_id, CASE WHEN severity = 'high' THEN 'resolved' WHEN severity = 'medium' THEN 'not_detectable' ELSE status END AS status, CASE WHEN severity = 'high' AND kind = 'zscore' THEN 'checked' WHEN severity = 'medium' THEN 'early' END AS note FROM {FINDINGS}")
def apply_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two reviews of every finding: of high ones the later resolves, of medium ones the later has no status that exists, of low ones neither has."""
    rows = findings(spark, sf_dir)
    early = F.when(F.col("severity").isin("high", "medium"), "not_detectable").otherwise("nonsense")
    first = rows.select("finding_id", early.alias("status"), F.lit("early").alias("note"), F.lit(1).alias("at"))
    late = F.when(F.col("severity") == "high", "resolved").otherwise("nonsense")
    second = rows.select("finding_id", late.alias("status"), F.when(F.col("kind") == "zscore", "checked").alias("note"), F.lit(2).alias("at"))
    return ledger.apply_reviews(rows, first.unionByName(second), "at")[0].select("finding_id", "status", "note")


@query(f"SELECT finding_id, severity, status FROM {FINDINGS} ORDER BY CASE WHEN status = 'open' THEN CASE severity WHEN 'low' THEN 2 WHEN 'medium' THEN 3 WHEN 'high' THEN 4 ELSE 0 END ELSE 0 END DESC, created_at DESC, finding_id LIMIT 1")
def featured_finding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.featured(findings(spark, sf_dir)).select("finding_id", "severity", "status")


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name || ' ' || p_brand), 'red')")
def artifact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").filter(F.lower(F.concat_ws(" ", "p_name", "p_brand")).contains("red")).select("p_partkey")


@query(f"SELECT severity, kind, count(*) AS n, count(*) FILTER (WHERE status = 'open') AS n_open FROM {FINDINGS} GROUP BY GROUPING SETS ((severity), (kind), ())")
def dashboard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.dashboard(findings(spark, sf_dir))


@query(f"""
  WITH s AS (SELECT event_type, count(*) AS n, sum(octet_length(encode(coalesce(props, '')))) AS bytes, 100.0 * count(value) / count(*) AS fitness FROM events GROUP BY 1)
  SELECT count(*) AS artifacts, CAST(sum(n) AS BIGINT) AS rows_total, CAST(sum(bytes) AS BIGINT) AS bytes_total, round(avg(fitness), 1) AS avg_fitness,
    (SELECT count(*) FROM {FINDINGS}) AS findings_total, (SELECT count(*) FROM {FINDINGS} WHERE status = 'open') AS open_reviews FROM s""")
def dashboard_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.octet_length(F.coalesce("props", F.lit("")))
    held = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("row_count"), F.sum(size).alias("byte_size"), (100.0 * F.count("value") / F.count(F.lit(1))).alias("fitness"))
    return ledger.dashboard_totals(held, findings(spark, sf_dir))


@query(f"SELECT finding_id, created_at FROM {FINDINGS} ORDER BY created_at DESC, finding_id LIMIT 6")
def recent_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.recent(findings(spark, sf_dir), "finding_id", 6).select("finding_id", "created_at")


@query(f"""
  SELECT artifact_id, 'manifest' AS section, artifact_id AS key, json_object('n_rows', n_rows, 'source_id', source_id)::VARCHAR AS body FROM {ARTIFACTS}
  UNION ALL SELECT 'type-' || event_type, 'profile', 'value', json_object('column', 'value', 'null_count', count(*) - count(value))::VARCHAR FROM events GROUP BY event_type
  UNION ALL SELECT 'type-' || event_type, 'fitness', 'completeness', json_object('component', 'completeness', 'score', CAST(floor(100.0 * count(value) / count(*)) AS INT))::VARCHAR FROM events GROUP BY event_type
  UNION ALL SELECT artifact_id, 'finding', finding_id, json_object('finding_id', finding_id, 'severity', severity, 'status', status)::VARCHAR FROM {BRIDGE}""")
def case_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that is known of each type of event, and of the findings on it."""
    held = artifacts(spark, sf_dir)
    by_type = table(spark, sf_dir, "events").groupBy(F.concat(F.lit("type-"), F.col("event_type")).alias("artifact_id"))
    columns = by_type.agg(F.lit("value").alias("column"), (F.count(F.lit(1)) - F.count("value")).alias("null_count"))
    fitness = by_type.agg(F.lit("completeness").alias("component"), F.floor(100.0 * F.count("value") / F.count(F.lit(1))).cast("int").alias("score"))
    found = findings(spark, sf_dir).select("finding_id", "severity", "status", "artifact_ids")
    return ledger.case_bundle(held.select("artifact_id", "n_rows", "source_id"), columns, fitness, found)


@query(f"""
  SELECT 'severity' AS facet, severity AS value, count(*) AS n FROM {FINDINGS} GROUP BY ALL UNION ALL SELECT 'kind', kind, count(*) FROM {FINDINGS} GROUP BY ALL
  UNION ALL SELECT * FROM (SELECT 'artifact', artifact_id, count(*) AS n FROM {BRIDGE} GROUP BY ALL ORDER BY n DESC, artifact_id LIMIT 6)""")
def finding_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.facets(findings(spark, sf_dir))


@query(f"SELECT artifact_id, coalesce(n, 0) AS n_open FROM {ARTIFACTS} LEFT JOIN (SELECT artifact_id, count(*) AS n FROM {BRIDGE} WHERE status = 'open' GROUP BY 1) USING (artifact_id)")
def open_findings_per_artifact(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = ledger.by_artifact(findings(spark, sf_dir).filter("status = 'open'")).groupBy("artifact_id").agg(F.count(F.lit(1)).alias("n"))
    return artifacts(spark, sf_dir).join(n, "artifact_id", "left").select("artifact_id", F.coalesce("n", F.lit(0)).alias("n_open"))


@query(f"""
  WITH a AS (SELECT 'anomaly-' || method || row_id AS id, 'Unusual number for value' AS title, CASE WHEN abs(expected) < 1e-9 THEN 'We found ' || format('{{:g}}', observed) || ', but expected close to 0 for event_type: ' || entity || '.'
      ELSE 'We found ' || format('{{:g}}', observed) || ', but expected around ' || format('{{:g}}', expected) || ' (' || printf('%.0f', abs(observed - expected) / abs(expected) * 100) || '% off) for event_type: ' || entity || '.' END AS summary FROM ({ZSCORE} UNION ALL {IQR})),
  d AS (SELECT 'drift-' || after_card || drift_type AS id, CASE drift_type WHEN 'unit' THEN 'The units used for ''' || concept_id || ''' changed' WHEN 'definition' THEN 'The definition of ''' || concept_id || ''' changed'
      WHEN 'denominator' THEN 'What ''' || concept_id || ''' is measured against changed' ELSE 'What''s included in ''' || concept_id || ''' changed' END AS title,
      CASE decision WHEN 'partial' THEN 'Only partly comparable now, check before comparing directly.' ELSE 'No longer safe to compare directly.' END || ' How big a change: ' || printf('%.0f', impact * 100) || '%.' AS summary FROM {DRIFT}),
  n AS (SELECT 'consensus-' || metric AS id, CASE verdict WHEN 'independent_corroboration' THEN 'Confirmed by independent sources: ' ELSE 'Looks like copies of one source: ' END || metric AS title,
      apparent_sources || ' source(s) reported this, ' || CASE verdict WHEN 'independent_corroboration' THEN 'and they really are independent of each other.' ELSE 'but they all trace back to just ' || distinct_origins || ' original source. More reports doesn''t mean more confirmation here.' END AS summary FROM {CONSENSUS})
  SELECT id, title, summary FROM a UNION ALL SELECT * FROM d UNION ALL SELECT * FROM n""")
def finding_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and summaries of anomalies, of drifted definitions and of claims with a shared origin."""
    events = event_values(spark, sf_dir)
    found = anomaly.detect_zscore(events).unionByName(anomaly.detect_iqr(events))
    rows = found.select(F.lit("anomaly").alias("kind"), F.concat(F.lit("anomaly-"), "method", F.col("row_id").cast("string")).alias("id"), "metric", F.concat(F.lit("event_type: "), "entity").alias("slice"), "observed", "expected")
    drift = comparisons.definition_drift(spark, sf_dir)
    rows = rows.unionByName(drift.select(F.lit("drift").alias("kind"), F.concat(F.lit("drift-"), "after_card", "drift_type").alias("id"), "drift_type", "concept_id", "decision", "impact"), allowMissingColumns=True)
    shared = comparisons.false_consensus(spark, sf_dir)
    rows = rows.unionByName(shared.select(F.lit("consensus").alias("kind"), F.concat(F.lit("consensus-"), "metric").alias("id"), "metric", "verdict", "apparent_sources", "distinct_origins"), allowMissingColumns=True)
    return ledger.titles_and_summaries(rows).select("id", "title", "summary")


@query(f"""
  SELECT finding_id AS known_as, 'anomaly-' || substr(sha256('events|' || entity || '|' || json_object('kind', kind, 'row_id', row_id, 'severity', severity)::VARCHAR), 1, 12) AS finding_id FROM {FINDINGS}""")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of findings by what was found where; a time of detection is left out."""
    rows = findings(spark, sf_dir).withColumn("seen_at", F.rand())
    scope = F.concat(F.lit("events|"), F.expr("substr(artifact_ids[1], 6)"))
    return rows.select(F.col("finding_id").alias("known_as"), runs.finding_id_of(F.lit("anomaly"), scope, ["kind", "severity", "row_id", "seen_at"], ["seen_at"]).alias("finding_id"))


@query("""
  WITH c AS (SELECT source, sha256(coalesce(text, '')) AS sha, count(*) AS k FROM documents GROUP BY ALL),
  b AS (SELECT source, substr(sha, 1, 4) AS bucket, sha256(string_agg(sha || ':' || k, '|' ORDER BY sha)) AS h, sum(k) AS k FROM c GROUP BY ALL)
  SELECT source, substr(sha256(string_agg(h, '|' ORDER BY bucket)), 1, 16) AS input_hash, CAST(sum(k) AS BIGINT) AS n FROM b GROUP BY source""")
def corpus_input_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash of each source's content that doesn't depend on order: digests with their numbers of copies, hashed in 65,536 buckets, then one hash
    over the buckets'. Copies are counted before they meet, so a group of copies is one entry."""
    counted = table(spark, sf_dir, "documents").groupBy("source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha")).agg(F.count(F.lit(1)).alias("k"))
    entries = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "sha", F.col("k").cast("string")))), "|")
    buckets = counted.groupBy("source", F.substring("sha", 1, 4).alias("bucket")).agg(F.sha2(entries, 256).alias("h"), F.sum("k").alias("k"))
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "h"))), lambda b: b["h"]), "|")
    return buckets.groupBy("source").agg(F.substring(F.sha2(ordered, 256), 1, 16).alias("input_hash"), F.sum("k").alias("n"))


@query(f"SELECT url || '.json' AS name, sha256(html) AS sha256, CAST(octet_length(encode(html)) AS BIGINT) AS byte_size, 'application/json' AS media_type, 'spark' AS parser, sha256('{{\"header\":true,\"parser\":\"spark\"}}') AS config_hash FROM pages")
def manifest_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as captures of files, each with what would read it."""
    rows = tables.capture(table(spark, sf_dir, "pages"), F.concat("url", F.lit(".json")), F.col("html"), config={"header": True})
    return rows.select("name", "sha256", "byte_size", "media_type", "parser", "config_hash")


EDGES = f"""(
  WITH a AS (SELECT artifact_id, n_values > 0 AS has_profile FROM {ARTIFACTS}),
  f AS (SELECT DISTINCT b.finding_id, b.artifact_id, b.kind AS rule FROM {BRIDGE} b JOIN a ON b.artifact_id = a.artifact_id WHERE has_profile)
  SELECT 'raw:' || artifact_id AS source, 'parser:' || artifact_id AS target, 'parsed_by' AS relation FROM a UNION ALL SELECT 'parser:' || artifact_id, 'profile:' || artifact_id, 'profiled_by' FROM a WHERE has_profile
  UNION ALL SELECT DISTINCT 'profile:' || artifact_id, 'rule:' || artifact_id || ':' || rule, 'executed_over' FROM f
  UNION ALL SELECT 'rule:' || artifact_id || ':' || rule, 'finding:' || artifact_id || ':' || finding_id, 'produced' FROM f)"""


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = ledger.by_artifact(findings(spark, sf_dir)).select("finding_id", "artifact_id", F.col("kind").alias("rule"))
    return lineage.build(artifacts(spark, sf_dir), rows)


@query(f"SELECT source, target, relation FROM {EDGES}")
def lineage_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir)[1]


@query(f"""SELECT CASE kind WHEN 'raw' THEN 'raw_artifact' ELSE kind END AS kind, count(*) AS n FROM (SELECT DISTINCT split_part(id, ':', 1) AS kind, id FROM (SELECT source AS id FROM {EDGES} UNION ALL SELECT target FROM {EDGES})) GROUP BY kind""")
def lineage_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir)[0].groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
  WITH RECURSIVE e AS (SELECT source, target FROM {EDGES} UNION ALL SELECT DISTINCT source, 'profile:' || split_part(source, ':', 2) FROM {EDGES} WHERE relation = 'produced'),
  n AS (SELECT DISTINCT id FROM (SELECT source AS id FROM e UNION ALL SELECT target FROM e)),
  r AS (SELECT source AS a, target AS b FROM e UNION SELECT a, target FROM r JOIN e ON source = b),
  c AS (SELECT a AS id FROM r WHERE a = b)
  SELECT 'duplicate_node' AS problem, id FROM n WHERE id LIKE 'raw:%' UNION ALL SELECT 'dangling_edge', id FROM n WHERE id = 'parser:type-click'
  UNION ALL SELECT 'cycle', id FROM (SELECT id FROM c UNION SELECT b FROM r WHERE a IN (SELECT id FROM c))""")
def lineage_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings' graph with flaws derived from its ids: a repeated node, a lost node, and an edge back."""
    nodes, edges = graph(spark, sf_dir)
    worst = nodes.filter("kind = 'rule'").select("id")
    flawed = nodes.filter("kind <> 'parser' OR id <> 'parser:type-click'").unionByName(nodes.filter("kind = 'raw_artifact'"))
    back = worst.select(F.col("id").alias("source"), F.concat(F.lit("profile:"), F.split_part("id", F.lit(":"), F.lit(2))).alias("target"), F.lit("back").alias("relation"))
    return lineage.validate(flawed, edges.unionByName(back))


@query(f"""
  WITH RECURSIVE e AS (SELECT target, min(source) AS source FROM {EDGES} GROUP BY 1),
  p AS (SELECT target AS id, source AS top, target || ' < ' || source AS path, 2 AS depth FROM e UNION ALL SELECT id, e.source, path || ' < ' || e.source, depth + 1 FROM p JOIN e ON e.target = p.top)
  SELECT id, path, CAST(depth AS INT) AS depth FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY depth DESC) AS k FROM p) WHERE k = 1""")
def lineage_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.paths_to_raw(graph(spark, sf_dir)[1])


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case for each user of events: the types of its events of value over 10, and a label that blind runs don't see."""
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("case_id")).agg(F.array_sort(F.collect_set(F.when(F.col("value") > 10, F.col("event_type")))).alias("linked_source_ids"))
    return rows.withColumn("label", F.concat(F.lit("case "), F.col("case_id").cast("string")))


CASES = "(SELECT user_id AS case_id, list_sort(list_distinct(coalesce(list(event_type) FILTER (WHERE value > 10), []))) AS linked FROM events GROUP BY 1)"


@query(f"SELECT case_id, array_to_string(linked, ';') AS linked FROM {CASES}")
def blind_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.blind(cases(spark, sf_dir)).select("case_id", F.array_join("linked_source_ids", ";").alias("linked"))


@query(f"SELECT case_id, CAST(len(linked) AS BIGINT) AS n_artifacts, CASE WHEN len(linked) = 0 THEN 'unmapped_access_gap' ELSE 'mapped' END AS status FROM {CASES}")
def case_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.coverage(cases(spark, sf_dir), artifacts(spark, sf_dir).select("artifact_id", "source_id"))


FOUND = f"(SELECT DISTINCT case_id, finding_id, complete FROM (SELECT case_id, 'type-' || unnest(linked) AS artifact_id FROM {CASES}) JOIN {BRIDGE} USING (artifact_id))"


@query(f"SELECT c.case_id, CAST(len(linked) AS BIGINT) AS n_artifacts, CASE WHEN len(linked) = 0 THEN 'unmapped_access_gap' ELSE 'mapped' END AS status, count(finding_id) AS n_findings, count(*) FILTER (WHERE complete) AS n_complete FROM {CASES} c LEFT JOIN {FOUND} f ON c.case_id = f.case_id GROUP BY ALL")
def case_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.case_results(cases(spark, sf_dir), artifacts(spark, sf_dir).select("artifact_id", "source_id"), findings(spark, sf_dir))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decision for every event: its case is the user (for some none of the run), its findings by the id, most of them unknown to the case."""
    k = F.col("event_id")
    what = F.element_at(F.array(*map(F.lit, [*evaluation.DECISIONS, "maybe"])), (k % 5 + 1).cast("int"))
    ids = F.when(k % 2 == 0, F.array(F.concat(F.lit("iqr-"), k.cast("string")))).otherwise(F.array().cast("array<string>"))
    case = F.when(k % 19 == 0, -F.col("user_id")).otherwise(F.col("user_id"))
    return table(spark, sf_dir, "events").select(k.alias("decision_id"), case.alias("case_id"), what.alias("decision"), ids.alias("finding_ids"), F.col("ts").alias("decided_at"))


@query(f"""
  WITH d AS (SELECT event_id AS decision_id, event_id % 5 AS w, CASE WHEN event_id % 19 = 0 THEN -user_id ELSE user_id END AS case_id FROM events)
  SELECT decision_id, 'unknown_decision' AS reason FROM d WHERE w = 4 UNION ALL SELECT decision_id, 'no_findings' FROM d WHERE w IN (0, 1) AND decision_id % 2 = 1
  UNION ALL SELECT decision_id, 'foreign_case' FROM d WHERE case_id NOT IN (SELECT case_id FROM {CASES})
  UNION ALL SELECT decision_id, 'foreign_finding' FROM d WHERE decision_id % 2 = 0 AND (case_id, 'iqr-' || decision_id) NOT IN (SELECT (case_id, finding_id) FROM {FOUND})""")
def adjudication_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    run, made = cases(spark, sf_dir), decisions(spark, sf_dir)
    named = made.select("case_id", F.explode("finding_ids").alias("finding_id"))
    found = evaluation.case_findings(run, artifacts(spark, sf_dir).select("artifact_id", "source_id"), findings(spark, sf_dir), named)
    return evaluation.rejects(made, run.select("case_id").join(found, "case_id", "left").select("case_id", "finding_id"))


@query(f"""
  WITH c AS (SELECT case_id, len(linked) AS n FROM {CASES}),
  d AS (SELECT case_id, w, row_number() OVER (PARTITION BY case_id ORDER BY ts DESC, event_id DESC) AS k FROM (SELECT *, event_id % 5 AS w, CASE WHEN event_id % 19 = 0 THEN -user_id ELSE user_id END AS case_id FROM events)),
  f AS (SELECT case_id, count(*) AS found, count(*) FILTER (WHERE complete) AS whole FROM {FOUND} GROUP BY 1),
  r AS (SELECT c.*, d.w, found, whole FROM c LEFT JOIN d ON c.case_id = d.case_id AND k = 1 LEFT JOIN f ON c.case_id = f.case_id)
  SELECT count(*) AS n_cases, count(w) AS n_adjudicated, count(*) - count(w) AS n_pending, count(*) FILTER (WHERE n > 0) AS n_mapped, count(*) FILTER (WHERE n = 0) AS n_unmapped,
    count(*) FILTER (WHERE w = 0) AS n_detected, count(*) FILTER (WHERE w = 1) AS n_partially_detected, count(*) FILTER (WHERE w = 2) AS n_not_detected, count(*) FILTER (WHERE w = 3) AS n_not_detectable,
    round(count(*) FILTER (WHERE n > 0) / nullif(count(*), 0), 4) AS coverage, round(count(*) FILTER (WHERE w IN (0, 1)) / nullif(count(w), 0), 4) AS detectability, round(sum(whole) / nullif(sum(found), 0), 4) AS evidence_completeness FROM r""")
def adjudication_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = evaluation.case_results(cases(spark, sf_dir), artifacts(spark, sf_dir).select("artifact_id", "source_id"), findings(spark, sf_dir))
    return evaluation.report(run, decisions(spark, sf_dir))


GRAMS = """(SELECT DISTINCT id, gram FROM (SELECT id, array_to_string(w[i:i + 4], ' ') AS gram FROM (SELECT id, w, unnest(range(1, len(w) - 3)) AS i FROM (
  SELECT {id} AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM {t}) WHERE len(w) >= 5)) WHERE length(gram) >= 20)"""


@query(f"SELECT a.id AS text_id, b.id AS label_id, count(*) AS n_grams FROM {GRAMS.format(id='doc_id', t='documents')} a JOIN {GRAMS.format(id='item_id', t='benchmark')} b USING (gram) GROUP BY ALL")
def label_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.label_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "item_id")


@query("SELECT DISTINCT doc_id AS text_id FROM documents, benchmark b WHERE length(substr(b.text, 1, 40)) >= 12 AND contains(documents.text, substr(b.text, 1, 40))")
def label_prefix_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.prefix_guard(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id")


@query("""
  WITH t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{N}_-]+')) AS word FROM documents)
  SELECT doc_id AS text_id, word AS case_id FROM t WHERE word IN (SELECT CAST(conv_id AS VARCHAR) FROM conversations)""")
def label_id_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that hold a conversation's number as a word of its own; conversations stand for cases here."""
    return evaluation.id_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "conversations"), "doc_id", "conv_id")
