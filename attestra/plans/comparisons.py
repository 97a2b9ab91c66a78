"""Queries that compare tables: keys, names, totals, gates, definitions, origins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from attestra.functions import exprs as X
from attestra.functions.names import name_similarity
from attestra.operators import compare, profile
from attestra.plans.base import query, table

OVERLAP = """
  WITH a AS (SELECT DISTINCT c_nationkey AS k FROM customer), b AS (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE {where}),
  j AS (SELECT a.k AS l, b.k AS r FROM a FULL JOIN b ON a.k = b.k)
  SELECT count(*) FILTER (WHERE l IS NOT NULL AND r IS NOT NULL) AS shared, count(*) FILTER (WHERE r IS NULL) AS left_only, count(*) FILTER (WHERE l IS NULL) AS right_only,
    count(*) AS total, CASE WHEN count(*) = 0 THEN 'unknown' WHEN count(l + r) = count(*) THEN 'comparable' WHEN count(l + r) > 0 THEN 'partial' ELSE 'not_comparable' END AS state FROM j"""


@query(OVERLAP.format(where="true"))
def geo_overlap_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.key_overlap(table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier"), "c_nationkey", "s_nationkey")


@query("""
  WITH a AS (SELECT DISTINCT c_nationkey AS k FROM customer), b AS (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal > 7000)
  SELECT 'intersect' AS op, CAST(k AS INT) AS k FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'except', k FROM (SELECT k FROM a EXCEPT SELECT k FROM b)
  UNION ALL SELECT 'union', k FROM (SELECT k FROM a UNION SELECT k FROM b)""")
def geo_set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).distinct()
    b = table(spark, sf_dir, "supplier").filter("s_acctbal > 7000").select(F.col("s_nationkey").alias("k")).distinct()
    named = lambda df, op: df.select(F.lit(op).alias("op"), F.col("k").cast("int").alias("k"))
    return named(a.intersect(b), "intersect").unionByName(named(a.subtract(b), "except")).unionByName(named(a.union(b).distinct(), "union"))


def spelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Different names of parts with their type and brand, and of customers, and a spelling of each: a word more, no space, or a letter less."""
    parts = table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("p_name"))
    names = parts.unionByName(table(spark, sf_dir, "customer").select(F.col("c_name").alias("p_name"))).distinct()
    return names, names.select(variant().alias("v_name"))


def variant():
    k = F.length("p_name") % 3
    return F.when(k == 0, F.concat(F.upper("p_name"), F.lit(" District"))).when(k == 1, F.replace("p_name", F.lit(" "), F.lit(""))).otherwise(F.expr("substr(p_name, 1, length(p_name) - 1)"))


@query()
def entity_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = spelled(spark, sf_dir)
    return compare.match_entities(a, b, "p_name", "v_name")


@query()
def geo_gate_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = spelled(spark, sf_dir)
    return compare.fuzzy_gate(a, b, "p_name", "v_name")


SQL_COMMON = """CASE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0 ELSE length({a}) - bit_count(list_reduce(
  list_transform(string_split({b}, ''), lambda y: list_sum(list_transform(range(length({a})), lambda i: CASE WHEN substr({a}, CAST(i AS INT) + 1, 1) = y THEN CAST(1 AS HUGEINT) << CAST(i AS INT) ELSE 0 END))::HUGEINT),
  lambda v, m: (((v + (v & m)) | (v - (v & m))) & ((CAST(1 AS HUGEINT) << CAST(length({a}) AS INT)) - 1)), (CAST(1 AS HUGEINT) << CAST(length({a}) AS INT)) - 1)) END"""


def sql_common(a: str, b: str) -> str:
    return SQL_COMMON.format(a=a, b=b)


def sql_ratio(a: str, b: str) -> str:
    return f"CASE WHEN length({a}) + length({b}) = 0 THEN 100.0 ELSE 200.0 * ({sql_common(a, b)}) / (length({a}) + length({b})) END"


@query(f"""
  WITH n AS (SELECT DISTINCT lower(concat_ws(' ', p_name, p_type)) AS a, lower(concat_ws(' ', p_type, p_name, p_brand)) AS b, p_partkey % 7 AS k FROM part),
  p AS (SELECT a, CASE WHEN k < 3 THEN b WHEN k < 5 THEN substr(a, 3) || reverse(substr(b, 1, 4)) ELSE replace(reverse(b), ' ', '') END AS b FROM n),
  w AS (SELECT DISTINCT a, b, list_distinct(list_filter(string_split(a, ' '), lambda x: x <> '')) AS x, list_distinct(list_filter(string_split(b, ' '), lambda x: x <> '')) AS y, replace(a, ' ', '') AS pa, replace(b, ' ', '') AS pb FROM p),
  s AS (SELECT *, array_to_string(list_sort(list_filter(x, lambda v: list_contains(y, v))), ' ') AS c, array_to_string(list_sort(list_filter(x, lambda v: NOT list_contains(y, v))), ' ') AS da,
    array_to_string(list_sort(list_filter(y, lambda v: NOT list_contains(x, v))), ' ') AS db FROM w),
  t AS (SELECT *, length(c) + CASE WHEN c = '' THEN 0 ELSE 1 END + length(da) AS sa, length(c) + CASE WHEN c = '' THEN 0 ELSE 1 END + length(db) AS sb FROM s)
  SELECT a AS left_name, b AS right_name, round(CASE WHEN c <> '' AND (da = '' OR db = '') THEN 100.0 ELSE greatest({sql_ratio("a", "b")}, {sql_ratio("pa", "pb")},
    100.0 * (1.0 - CAST(length(da) + length(db) - 2 * ({sql_common("da", "db")}) AS DOUBLE) / (sa + sb)),
    CASE WHEN c = '' THEN 0.0 ELSE greatest(200.0 * length(c) / (length(c) + sa), 200.0 * length(c) / (length(c) + sb)) END) END, 6) AS score FROM t""")
def name_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How alike each part's names are to what is made of them: words in another order, letters lost, written backwards."""
    k = F.col("p_partkey") % 7
    names = table(spark, sf_dir, "part").select(F.lower(F.concat_ws(" ", "p_name", "p_type")).alias("a"), F.lower(F.concat_ws(" ", "p_type", "p_name", "p_brand")).alias("b"), k.alias("k"))
    other = F.when(F.col("k") < 3, F.col("b")).when(F.col("k") < 5, F.concat(F.expr("substr(a, 3)"), F.reverse(F.expr("substr(b, 1, 4)")))).otherwise(F.replace(F.reverse("b"), F.lit(" "), F.lit("")))
    rows = names.select(F.col("a").alias("left_name"), other.alias("right_name")).distinct()
    return rows.withColumn("score", F.round(name_similarity("left_name", "right_name"), 6))


def nation_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per nation of the customer: order totals from orders, and from lineitem, with labels of period, unit and definition by nation."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    money = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")
    a = orders.groupBy("c_nationkey").agg(money("o_totalprice").alias("total_a"), F.count_distinct("o_custkey").alias("keys_a"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("line_total"))
    b = lines.join(orders.select("o_orderkey", "c_nationkey", "o_custkey"), "o_orderkey").groupBy("c_nationkey").agg(money("line_total").alias("total_b"), F.count_distinct("o_custkey").alias("keys_b"))
    return a.join(b, "c_nationkey")


TOTALS = """
  o AS (SELECT c_nationkey, o_orderkey, o_custkey, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey),
  a AS (SELECT c_nationkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_a, count(DISTINCT o_custkey) AS keys_a FROM o GROUP BY 1),
  b AS (SELECT c_nationkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total_b, count(DISTINCT o_custkey) AS keys_b FROM o JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1),
  t AS (SELECT * FROM a JOIN b USING (c_nationkey))"""


@query(f"WITH {TOTALS} SELECT c_nationkey, round(total_a, 2) AS total_a, round(total_b, 2) AS total_b, keys_a, keys_b FROM t")
def compare_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nation_totals(spark, sf_dir).select("c_nationkey", F.round("total_a", 2).alias("total_a"), F.round("total_b", 2).alias("total_b"), "keys_a", "keys_b")


def gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The totals with the four gates; years, units with their scales and definitions differ by nation, in case, in scale or in words."""
    k = F.col("c_nationkey")
    rows = nation_totals(spark, sf_dir)
    geography = F.when(F.col("keys_a") == F.col("keys_b"), "comparable").otherwise("partial")
    words = "order total of all customers in the nation before tax"
    gates = {
        "geography": F.when(k % 2 == 0, "comparable").otherwise(geography),
        "period": compare.period_gate(F.when(k % 7 != 2, "2024-25"), F.when(k % 7 == 0, "2023-24").when(k % 7 > 2, "2024-25")),
        "unit": compare.unit_gate(F.lit("inr"), F.when(k % 11 == 0, "lakh").when(k % 11 != 1, "INR"), F.lit(1.0), F.when(k % 11 == 2, 1e5).otherwise(1.0)),
        "definition": compare.definition_gate(F.lit(words), F.when(k % 5 == 1, words.title()).when(k % 5 == 2, words + " or duty").when(k % 5 == 3, "line total").when(k % 5 == 4, words)),
    }
    rows = rows.withColumns(gates)
    return rows.withColumn("overall", compare.overall_gate(*map(F.col, gates)))


GATES = f"""
  WITH {TOTALS},
  g AS (SELECT *, CASE WHEN c_nationkey % 2 = 0 OR keys_a = keys_b THEN 'comparable' ELSE 'partial' END AS geography,
      CASE c_nationkey % 7 WHEN 0 THEN 'not_comparable' WHEN 1 THEN 'partial' WHEN 2 THEN 'unknown' ELSE 'comparable' END AS period,
      CASE c_nationkey % 11 WHEN 0 THEN 'not_comparable' WHEN 1 THEN 'unknown' WHEN 2 THEN 'partial' ELSE 'comparable' END AS unit,
      CASE c_nationkey % 5 WHEN 0 THEN 'unknown' WHEN 2 THEN 'partial' WHEN 3 THEN 'not_comparable' ELSE 'comparable' END AS definition FROM t),
  v AS (SELECT *, CASE WHEN 'not_comparable' IN (geography, period, unit, definition) THEN 'not_comparable' WHEN 'partial' IN (geography, period, unit, definition) THEN 'partial' ELSE 'comparable' END AS overall FROM g)"""


@query(GATES + " SELECT c_nationkey, geography, period, unit, definition, overall FROM v")
def comparability_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gated(spark, sf_dir).select("c_nationkey", "geography", "period", "unit", "definition", "overall")


@query(GATES + """, s AS (SELECT *, CASE WHEN overall <> 'comparable' THEN 'not_comparable' WHEN greatest(abs(total_a), abs(total_b)) = 0 OR abs(total_a - total_b) <= 0.01 * greatest(abs(total_a), abs(total_b)) THEN 'explainable' ELSE 'conflict' END AS status FROM v)
  SELECT c_nationkey, overall, status, round(CASE status WHEN 'conflict' THEN (total_b - total_a) / greatest(abs(total_a), abs(total_b)) WHEN 'explainable' THEN abs(total_a - total_b) END, 4) AS delta,
    round(CASE WHEN least(total_a, total_b) > 0 THEN (greatest(total_a, total_b) - least(total_a, total_b)) / least(total_a, total_b) * 100 END, 4) AS percent_gap FROM s""")
def contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.reconcile(gated(spark, sf_dir), "total_a", "total_b", "overall").select("c_nationkey", "overall", "status", "delta", "percent_gap")


UNITS = ["lakh", "crore", "INR lakh", None, "acres", " Lakh ", "lac", "hectares", "number"]


def cards(spark: SparkSession, sf_dir: str, release: int) -> DataFrame:
    """Definition cards of parts: one a part, of release 0 or 1 by its key; the concept joins neighbouring parts. Texts differ in case, too."""
    k = F.col("p_partkey")
    part = table(spark, sf_dir, "part").filter(k % 2 == release)
    unit = F.element_at(F.array(*[F.lit(u).cast("string") for u in UNITS]), ((k % len(UNITS)).cast("int") + 1))
    base = F.expr("p_partkey div 2").cast("string")
    same = F.expr("p_partkey div 2") % 4 == 0
    text = F.when(same, F.concat(F.lit("Parts of kind "), base, F.lit(" in stock at the end of the year"))).otherwise(F.concat_ws(" ", "p_name", "p_type"))
    loud = lambda c: F.when(k % 2 == 1, F.upper(c)).otherwise(c)
    return part.select(
        F.format_string("card-%06d", k).alias("card_id"), base.alias("concept_id"), loud(F.when(k % 16 == 1, F.concat(text, F.lit(" or sold"))).otherwise(text)).alias("definition"),
        F.when(k % 3 != 0, F.when(same, F.concat(F.lit("household "), (k % 2).cast("string"))).otherwise("Household")).alias("scope"), F.when(k % 4 != 0, F.concat((F.col("p_size") % 2).cast("string"), F.lit(" "))).alias("denominator"), unit.alias("unit"))


def sql_cards(release: int) -> str:
    unit = "[" + ", ".join("NULL" if u is None else f"'{u}'" for u in UNITS) + f"][p_partkey % {len(UNITS)} + 1]"
    return f"""(SELECT card_id, concept_id, CASE WHEN {release} = 1 THEN upper(d) ELSE d END AS definition, scope, denominator, unit FROM (
      SELECT printf('card-%06d', p_partkey) AS card_id, CAST(p_partkey // 2 AS VARCHAR) AS concept_id,
      CASE WHEN (p_partkey // 2) % 4 = 0 THEN 'Parts of kind ' || (p_partkey // 2) || ' in stock at the end of the year' ELSE p_name || ' ' || p_type END || CASE WHEN p_partkey % 16 = 1 THEN ' or sold' ELSE '' END AS d,
      CASE WHEN p_partkey % 3 <> 0 THEN CASE WHEN (p_partkey // 2) % 4 = 0 THEN 'household ' || (p_partkey % 2) ELSE 'Household' END END AS scope, CASE WHEN p_partkey % 4 <> 0 THEN (p_size % 2) || ' ' END AS denominator,
      {unit} AS unit FROM part WHERE p_partkey % 2 = {release}))"""


METRICS = {
    "orders": {"o_totalprice": "o_totalprice_inr_lakh", "o_orderkey": "o_orderkey_id"}, "lineitem": {"l_quantity": "l_quantity_per_order_line", "l_tax": "l_tax_pct"},
    "customer": {"c_acctbal": "Estimated_balance_rs"}, "part": {"p_retailprice": "approx_price", "p_size": "crore"}, "events": {"value": "value"},
}


def profiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(artifact_id, column, is_metric, null_ratio) of columns of five tables under names that say units and denominators; half of the values of
    value are left out."""
    out = None
    for t, names in METRICS.items():
        columns = [(F.when(F.col(c) > 100, F.col(c)) if t == "events" else F.col(c)).alias(n) for c, n in names.items()]
        rows = profile.column_stats(table(spark, sf_dir, t).select(*columns)).select(F.lit(t).alias("artifact_id"), "column", "is_metric", "null_ratio")
        out = rows if out is None else out.unionByName(rows)
    return out


def sql_card(t: str, c: str, name: str, concept: str, unit: str, denominator: str | None, flags: str) -> str:
    rate = f"; rate per {denominator}" if denominator else ""
    more = f"array_to_string(list_filter(['{flags}', CASE WHEN 2 * (count(*) - count({c})) > count(*) THEN 'majority_null' END], lambda x: x <> ''), ',')"
    source = f"(SELECT CASE WHEN {c} > 100 THEN {c} END AS {c} FROM {t})" if t == "events" else t
    return f"""SELECT '{t}' AS artifact_id, '{name}' AS "column", 'dc:{t}:{name}' AS card_id, '{concept}' AS concept_id, '{name} as reported in this artifact; inferred unit ''{unit}''{rate}' AS definition,
      'column ''{name}''' AS scope, {f"'{denominator}'" if denominator else "NULL"} AS denominator, '{unit}' AS unit, '{t}#column={name}' AS span, {more} AS flags, 'proposed' AS status FROM {source}"""


@query(" UNION ALL ".join(sql_card(*c) for c in (
    ("orders", "o_totalprice", "o_totalprice_inr_lakh", "o_totalprice_inr", "lakh", None, ""), ("lineitem", "l_quantity", "l_quantity_per_order_line", "l_quantity", "count", "order line", ""),
    ("lineitem", "l_tax", "l_tax_pct", "l_tax", "pct", None, ""), ("customer", "c_acctbal", "Estimated_balance_rs", "estimated_balance", "rs", None, "name_contains_estimated"),
    ("part", "p_retailprice", "approx_price", "approx_price", "count", None, "name_contains_approx"), ("part", "p_size", "crore", "crore", "count", None, ""), ("events", "value", "value", "value", "count", None, ""))))
def definition_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards read out of the names of profiled metric columns; ids are no metrics and get none."""
    return compare.infer_cards(profiled(spark, sf_dir))


@query(f"SELECT a.concept_id, b.card_id AS before_card, a.card_id AS after_card FROM {sql_cards(1)} a JOIN (SELECT concept_id, max(card_id) AS card_id FROM {sql_cards(0)} GROUP BY 1) b USING (concept_id) WHERE a.card_id <> b.card_id")
def drift_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = cards(spark, sf_dir, 0).groupBy("concept_id").agg(F.max("card_id").alias("before_card"))
    return cards(spark, sf_dir, 1).join(old, "concept_id").filter("card_id <> before_card").select("concept_id", "before_card", F.col("card_id").alias("after_card"))


WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9]+'), lambda w: w <> ''))"
SCALES = " ".join(f"WHEN '{u}' THEN {k}" for u, k in X.UNIT_SCALES.items())
DRIFT = f"""(
  WITH p AS (SELECT a.concept_id, b.card_id AS before_card, a.card_id AS after_card, lower(trim(a.definition)) AS d2, lower(trim(b.definition)) AS d1, lower(trim(a.scope)) AS s2, lower(trim(b.scope)) AS s1,
      lower(trim(a.denominator)) AS n2, lower(trim(b.denominator)) AS n1, lower(trim(a.unit)) AS u2, lower(trim(b.unit)) AS u1,
      {WORDS.format(x='a.definition')} AS w2, {WORDS.format(x='b.definition')} AS w1 FROM {sql_cards(1)} a JOIN {sql_cards(0)} b USING (concept_id) WHERE a.card_id <> b.card_id),
  k AS (SELECT *, CASE u1 {SCALES} END AS k1, CASE u2 {SCALES} END AS k2, len(list_intersect(w1, w2)) / len(list_distinct(list_concat(w1, w2))) AS j FROM p),
  x AS (SELECT *, CASE WHEN u1 LIKE '%inr%' OR u1 LIKE '%rs%' OR u1 LIKE '%rupee%' THEN 'INR' WHEN k1 IS NOT NULL THEN 'count' END AS base1,
      CASE WHEN u2 LIKE '%inr%' OR u2 LIKE '%rs%' OR u2 LIKE '%rupee%' THEN 'INR' WHEN k2 IS NOT NULL THEN 'count' END AS base2 FROM k),
  d AS (
    SELECT concept_id, before_card, after_card, 'denominator' AS drift_type, CASE WHEN n1 IS NULL OR n2 IS NULL THEN 'partial' ELSE 'not_comparable' END AS decision, CASE WHEN n1 IS NULL OR n2 IS NULL THEN 0.3 ELSE 0.9 END AS impact
      FROM x WHERE n1 IS DISTINCT FROM n2
    UNION ALL SELECT concept_id, before_card, after_card, 'unit', CASE WHEN u1 IS NOT NULL AND u2 IS NOT NULL AND (k1 IS NULL OR k2 IS NULL) AND base1 <> base2 THEN 'not_comparable' ELSE 'partial' END,
      CASE WHEN u1 IS NULL OR u2 IS NULL THEN 0.2 WHEN k1 <> k2 THEN 0.55 WHEN base1 <> base2 THEN 0.9 ELSE 0.5 END FROM x WHERE u1 IS DISTINCT FROM u2 AND NOT coalesce(k1 = k2, false)
    UNION ALL SELECT concept_id, before_card, after_card, 'definition', CASE WHEN j >= 0.8 THEN 'partial' ELSE 'not_comparable' END, CASE WHEN j >= 0.8 THEN 0.3 ELSE 0.7 END FROM x WHERE d1 <> d2
    UNION ALL SELECT concept_id, before_card, after_card, 'scope', 'partial', CASE WHEN s1 IS NULL OR s2 IS NULL THEN 0.2 ELSE 0.4 END FROM x WHERE s1 IS DISTINCT FROM s2)
  SELECT concept_id, before_card, after_card, drift_type, decision, CAST(impact AS DOUBLE) AS impact, CASE WHEN decision = 'not_comparable' THEN 'high' WHEN impact >= 0.5 THEN 'medium' ELSE 'low' END AS severity FROM d)"""


@query(f"SELECT * FROM {DRIFT}")
def definition_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.definition_drift(cards(spark, sf_dir, 0), cards(spark, sf_dir, 1))


@query(f"SELECT concept_id, CASE max(CASE decision WHEN 'not_comparable' THEN 2 ELSE 1 END) WHEN 2 THEN 'not_comparable' ELSE 'partial' END AS decision FROM {DRIFT} GROUP BY 1")
def drift_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.overall_decision(definition_drift(spark, sf_dir))


CONSENSUS = """(
  WITH o AS (SELECT lang, CASE WHEN doc_id % 3 = 0 THEN 'doc-' || doc_id ELSE md5(coalesce(text, '')) END AS origin, count(*) AS members FROM documents GROUP BY ALL),
  m AS (SELECT lang AS metric, CAST(sum(members) AS BIGINT) AS apparent_sources, count(*) AS distinct_origins, max(members) AS largest_group FROM o GROUP BY 1 HAVING sum(members) >= 2)
  SELECT metric, apparent_sources, distinct_origins, largest_group, round(distinct_origins / apparent_sources, 4) AS diversity_ratio,
    CASE WHEN distinct_origins / apparent_sources >= 0.999 THEN 'independent_corroboration' ELSE 'shared_origin_suspected' END AS verdict,
    CASE WHEN distinct_origins / apparent_sources >= 0.999 THEN 'info' WHEN distinct_origins / apparent_sources <= 0.6 THEN CASE WHEN apparent_sources <= 3 THEN 'medium' ELSE 'high' END ELSE 'low' END AS severity,
    CASE WHEN distinct_origins / apparent_sources >= 0.999 THEN 'high' ELSE 'moderate' END AS confidence FROM m)"""


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document claims something of its language; what it was copied from is its text, and unknown (blank) for every third."""
    origin = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.md5(F.coalesce("text", F.lit(""))))
    return table(spark, sf_dir, "documents").select(F.col("lang").alias("metric"), F.col("doc_id").alias("claim_id"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("artifact_id"), origin.alias("derived_from"))


@query(f"SELECT * FROM {CONSENSUS}")
def false_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.false_consensus(claims(spark, sf_dir))


@query("SELECT lang AS metric, CASE WHEN doc_id % 3 = 0 THEN 'doc-' || doc_id ELSE md5(coalesce(text, '')) END AS origin, doc_id AS claim_id FROM documents")
def origin_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.origin_groups(claims(spark, sf_dir))


@query("""
  WITH c AS (SELECT lang, CAST(doc_id AS VARCHAR) AS claim, count(*) AS n FROM documents GROUP BY ALL),
  b AS (SELECT lang, substr(md5(claim), 1, 3) AS bucket, sha256(string_agg(claim || ':' || n, '|' ORDER BY claim || ':' || n)) AS h FROM c GROUP BY ALL)
  SELECT lang AS metric, 'cons-' || substr(sha256(string_agg(h, '|' ORDER BY h)), 1, 12) AS consensus_id FROM b GROUP BY 1""")
def consensus_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.consensus_ids(claims(spark, sf_dir))


def yearly_values(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Orders as an artifact for each year: pairs of neighbouring years (one with a column that is not there), totals, nations, fiscal years (one unknown)."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    year = F.year("o_orderdate")
    rows = orders.select(F.concat(F.lit("orders-"), year.cast("string")).alias("artifact_id"), year.alias("year"), "c_nationkey", F.col("o_totalprice").cast("decimal(18,2)").alias("total"))
    name = F.when(F.col("year") % 3 == 0, "total_inr_lakh").otherwise("total_inr")
    totals = compare.column_totals(rows.select("artifact_id", name.alias("column"), F.col("total").alias("value"))).withColumn("total", F.round("total", 2))
    keys = rows.filter((F.col("year") % 4 != 0) | (F.col("c_nationkey") > 3)).select("artifact_id", F.col("c_nationkey").cast("string").alias("key")).distinct()
    years = rows.select("year").distinct()
    artifact = lambda y: F.concat(F.lit("orders-"), y.cast("string"))
    column = lambda y: F.when(y % 3 == 0, "total_inr_lakh").otherwise("total_inr")
    after = F.col("year") + 1
    pairs = years.select(F.col("year").alias("pair_id"), artifact(F.col("year")).alias("artifact_a"), column(F.col("year")).alias("column_a"), artifact(after).alias("artifact_b"), F.when(after % 5 == 0, "lost").otherwise(column(after)).alias("column_b"))
    releases = years.select(artifact(F.col("year")).alias("artifact_id"), F.when(F.col("year") % 2 == 0, " ").otherwise("2024-25").alias("fiscal_year"))
    return pairs, totals, keys, releases


@query("""
  WITH r AS (SELECT year(o_orderdate) AS y, c_nationkey, CAST(o_totalprice AS DECIMAL(18,2)) AS v FROM orders JOIN customer ON o_custkey = c_custkey),
  t AS (SELECT y, count(*) AS n, round(sum(CAST(v AS DOUBLE)), 2) AS total, CASE WHEN y % 3 = 0 THEN 'total_inr_lakh' ELSE 'total_inr' END AS col, CASE WHEN y % 2 = 1 THEN '2024-25' END AS fy FROM r GROUP BY y),
  k AS (SELECT DISTINCT y, c_nationkey FROM r WHERE y % 4 <> 0 OR c_nationkey > 3),
  j AS (SELECT a.y, a.n AS na, a.total AS ta, b.n AS nb, b.total AS tb, a.fy AS fa, b.fy AS fb, a.col AS ca, CASE WHEN (a.y + 1) % 5 = 0 THEN 'lost' WHEN (a.y + 1) % 3 = 0 THEN 'total_inr_lakh' ELSE 'total_inr' END AS cb,
      (SELECT count(*) FROM k WHERE k.y = a.y) AS ka, (SELECT count(*) FROM k WHERE k.y = a.y + 1) AS kb, (SELECT count(*) FROM k x JOIN k z USING (c_nationkey) WHERE x.y = a.y AND z.y = a.y + 1) AS kk
    FROM t a LEFT JOIN t b ON b.y = a.y + 1 AND (a.y + 1) % 5 <> 0),
  g AS (SELECT *, CASE WHEN ka = 0 OR kb = 0 THEN 'unknown' WHEN kk = 0 THEN 'not_comparable' WHEN kk = ka AND kk = kb THEN 'comparable' ELSE 'partial' END AS geography,
      CASE WHEN y % 2 = 1 AND EXISTS (SELECT 1 FROM t z WHERE z.y = j.y + 1 AND z.fy IS NOT NULL) THEN 'comparable' WHEN y % 2 = 1 OR EXISTS (SELECT 1 FROM t z WHERE z.y = j.y + 1 AND z.fy IS NOT NULL) THEN 'partial' ELSE 'unknown' END AS period,
      CASE cb WHEN 'lost' THEN 'count' WHEN 'total_inr' THEN 'inr' ELSE 'lakh' END AS ub, CASE ca WHEN 'total_inr' THEN 'inr' ELSE 'lakh' END AS ua FROM j),
  h AS (SELECT *, CASE WHEN ua = ub THEN 'comparable' ELSE 'not_comparable' END AS unit, CASE WHEN cb = 'lost' THEN 'not_comparable' ELSE 'comparable' END AS definition FROM g),
  v AS (SELECT *, CASE WHEN 'not_comparable' IN (geography, period, unit, definition) THEN 'not_comparable' WHEN 'partial' IN (geography, period, unit, definition) THEN 'partial' ELSE 'comparable' END AS overall FROM h),
  s AS (SELECT *, CASE WHEN nb IS NULL THEN NULL WHEN overall <> 'comparable' THEN 'not_comparable' WHEN abs(ta - tb) <= 0.01 * greatest(abs(ta), abs(tb)) THEN 'explainable' ELSE 'conflict' END AS status FROM v)
  SELECT y AS pair_id, ta AS total_a, tb AS total_b, geography, period, unit, definition, overall, status, round(CASE status WHEN 'conflict' THEN (tb - ta) / greatest(abs(ta), abs(tb)) WHEN 'explainable' THEN abs(ta - tb) END, 4) AS delta,
    CASE WHEN nb IS NULL THEN NULL WHEN status = 'conflict' THEN 'medium' ELSE 'info' END AS severity, CASE WHEN nb IS NULL THEN 'column_not_found:' || cb END AS error FROM s""")
def compare_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals of each year held against the next year's, all pairs in one job."""
    return compare.compare_pairs(*yearly_values(spark, sf_dir))
