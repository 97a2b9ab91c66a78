"""Whole runs: ingest a file, analyze a table, compare two tables, and a blind pass over cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from attestra.functions import exprs as X
from attestra.operators import anomaly, benford, compare, evaluation, ledger, profile
from attestra.session import materialize
from attestra.sources import tables

# What names of entity, period and geography columns hold, in order.
ENTITY_TOKENS = ["district", "block", "village", "school", "state", "entity", "name"]
PERIOD_TOKENS = ["year", "fy", "period", "date", "month"]


def artifact_id(name: str, sha256: str) -> str:
    """A default id from a file's name and content."""
    stem = name.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    return f"art-{stem.lower().replace('_', '-')}-{sha256[:8]}"


def finding_id_of(kind: Column, scope: Column, payload: list[str], volatile: list[str] | None = None) -> Column:
    """A stable id of a finding, kind and hash: scope and payload columns in the order of their names, volatile ones left out."""
    fields = sorted(set(payload) - set(volatile or []))
    return F.concat_ws("-", kind, X.short_hash(scope, F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})))


def without(column: Column, kind: T.DataType, names: set[str]) -> Column:
    """A column without the struct fields of these names, at any depth of structs and arrays."""
    if isinstance(kind, T.StructType):
        kept = [f for f in kind if f.name not in names]
        return F.when(column.isNotNull(), F.struct(*[without(column.getField(f.name), f.dataType, names).alias(f.name) for f in kept])) if kept else F.lit(None).cast("string")
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.ArrayType)):
        return F.transform(column, lambda x: without(x, kind.elementType, names))
    return column


def finding_id(df: DataFrame, scope: str, payload: list[str], volatile: list[str] | None = None) -> Column:
    """A stable id of a finding of df: scope and payload columns in the order of their names, volatile fields left out at any depth."""
    names = set(volatile or [])
    fields = [without(F.col(c), df.schema[c].dataType, names).alias(c) for c in sorted(set(payload) - names)]
    return X.short_hash(F.lit(scope), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}))


def ingest(spark: SparkSession, path: str, store: str, name: str, catalog: str | None = None) -> dict[str, DataFrame | str]:
    """Read, freeze, profile and score a table; everything after the freeze reads the snapshot.

    catalog: a folder in which the profile's tables are kept, each by artifact; a file that comes in again replaces its own.
    """
    frozen = tables.freeze(tables.read_table(spark, path), store, name)
    df = spark.read.parquet(frozen)
    known = profile.Profile(df)
    artifact = artifact_id(path, frozen.rsplit("=", 1)[-1])
    out = {
        "columns": known.columns.join(known.distinct, "column", "left"),
        "top_values": profile.top_values(known.values),
        "candidate_keys": profile.candidate_keys(known.columns, known.distinct),
        "observations": known.observations,
        "pii": known.pii,
        "fitness": profile.fitness_of(known),
        "cards": compare.infer_cards(known.columns.withColumn("artifact_id", F.lit(artifact))),
    }
    for table, rows in out.items() if catalog else ():
        rows.drop("artifact_id").write.mode("overwrite").parquet(f"{catalog.rstrip('/')}/{table}/artifact_id={artifact}")
    return {"artifact_id": artifact, "snapshot": frozen, **out}


def record(spark: SparkSession, found: DataFrame, path: str) -> int:
    """Append findings to the ledger at ``path``, each id once, and say how many were new. One writer at a time is assumed."""
    spark.createDataFrame([], found.schema).write.mode("append").parquet(path)
    new = materialize(ledger.new_findings(spark.read.schema(found.schema).parquet(path), found), "findings")
    new.write.mode("append").parquet(path)
    return new.count()


def comparison_findings(compared: DataFrame, drifts: DataFrame) -> DataFrame:
    """Ledger rows of compared pairs (``compare.compare_pairs``, with the pairs' columns) and of the drift of their cards (with pair_id): stable ids
    over what was found, titles, summaries, both artifacts of the pair."""
    both = F.array_sort(F.array("artifact_a", "artifact_b"))
    verdicts = compared.filter("error IS NULL").select(
        F.lit("contradiction").alias("kind"), "severity", both.alias("artifact_ids"), "pair_id", "status", F.col("total_a").alias("value_a"), F.col("total_b").alias("value_b"),
        *[F.lit(None).cast("string").alias(c) for c in ("concept_id", "drift_type", "decision")], F.lit(None).cast("double").alias("impact"))
    changed = drifts.join(compared.select("pair_id", both.alias("artifact_ids")), "pair_id").select(
        F.lit("drift").alias("kind"), "severity", "artifact_ids", "pair_id", F.lit(None).cast("string").alias("status"), *[F.lit(None).cast("double").alias(c) for c in ("value_a", "value_b")],
        "concept_id", "drift_type", "decision", "impact")
    rows = ledger.titles_and_summaries(verdicts.unionByName(changed))
    ids = finding_id_of(F.col("kind"), F.array_join("artifact_ids", "|"), ["kind", "severity", "status", "value_a", "value_b", "concept_id", "drift_type", "decision", "impact"])
    return rows.select(ids.alias("finding_id"), "kind", "severity", F.lit("open").alias("status"), "title", "summary", "artifact_ids")


def analyze(df: DataFrame, row_id: Column, metrics: list[str] | None = None, entity: str | None = None, period: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The strongest findings of all detectors over all metric columns, and the first-digit verdicts.

    Entity and period are found by their names if not given; change by period needs both.
    """
    metrics = metrics if metrics is not None else anomaly.metric_columns(df)
    rest = [c for c in df.columns if c not in metrics]
    entity, period = entity or anomaly.find_column(rest, ENTITY_TOKENS), period or anomaly.find_column(rest, PERIOD_TOKENS)
    as_text = lambda c: F.col(c).cast("string") if c else None
    rows = anomaly.long_frame(df, metrics, row_id.cast("string"), as_text(entity), as_text(period))
    found = anomaly.detect_zscore(rows).unionByName(anomaly.detect_iqr(rows))
    if entity and period:
        found = found.unionByName(anomaly.detect_change(rows))
    digits = benford.digit_table(rows.select(F.col("metric").alias("column"), "value"))
    return anomaly.strongest(found.withColumn("artifact", F.lit(1)), ["artifact"]).drop("artifact"), benford.conformity_table(digits)


def compare_pair(a: DataFrame, b: DataFrame, column_a: str, column_b: str, key_a: str, key_b: str, periods: tuple[str | None, str | None] = (None, None), fuzzy: bool = True) -> DataFrame:
    """One row: totals of two columns, the gates on places, periods, units and definitions, and the verdict.

    Units and definitions are read out of the columns' names. A column without any value is an error.
    """
    total = lambda df, c, x: df.agg(F.count(c).alias(f"n_{x}"), F.sum(F.col(c).try_cast("double")).alias(f"total_{x}"))
    gate = compare.fuzzy_gate(a, b, key_a, key_b) if fuzzy else compare.key_overlap(a, b, key_a, key_b)
    one = lambda df: df.withColumn("_one", F.lit(1))
    rows = one(total(a, column_a, "a")).join(one(total(b, column_b, "b")), "_one").join(one(gate.select(F.col("state").alias("geography"))), "_one").drop("_one")
    found = rows.select("n_a", "n_b").first()
    for name, n in ((column_a, found["n_a"]), (column_b, found["n_b"])):
        if not n:
            raise ValueError(f"column '{name}' has no values")
    concepts = [X.column_concept(F.lit(c)) for c in (column_a, column_b)]
    units = [c["unit"] for c in concepts]
    rows = rows.withColumns({
        "period": compare.period_gate(*[F.lit(p).cast("string") for p in periods]),
        "unit": compare.unit_gate(*units, *map(X.unit_scale, units)),
        "definition": compare.definition_gate(*[X.definition_key(c["base"]) for c in concepts]),
    })
    rows = rows.withColumn("overall", compare.overall_gate(*map(F.col, ("geography", "period", "unit", "definition"))))
    return compare.reconcile(rows.drop("n_a", "n_b"), "total_a", "total_b", "overall")


def blind_run(cases: DataFrame, artifacts: DataFrame, findings: DataFrame, input_hash: str, folder: str, labels: list[str] | None = None) -> str:
    """Write results and findings of every case, without labels, to a folder named by the input's hash; a run is never overwritten.

    labels: columns of cases that the run must not show. If a finding's title or summary holds the first 40 characters of one (of 12 at least),
    nothing is written and an error is raised.
    """
    path = f"{folder.rstrip('/')}/blind-{input_hash}"
    texts = findings.select("finding_id", F.concat_ws("\n", *[c for c in ("title", "summary") if c in findings.columns]).alias("text"))
    for label in labels or []:
        leaked = evaluation.prefix_guard(texts, cases.select(F.col(label).cast("string").alias("text")), "finding_id")
        if not leaked.isEmpty():
            raise ValueError(f"label text of column '{label}' is in the findings; the run is not written")
    evaluation.case_results(cases, artifacts, findings).write.mode("errorifexists").json(f"{path}/cases")
    seen = [c for c in ("kind", "severity", "confidence", "status", "title") if c in findings.columns]
    summary = [F.substring("summary", 1, 300).alias("summary")] if "summary" in findings.columns else []
    rows = evaluation.case_findings(cases, artifacts, findings).join(findings.select("finding_id", *seen, *summary), "finding_id")
    rows.write.mode("errorifexists").json(f"{path}/findings")
    return path


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """A case registry from CSV: linked_source_ids split on semicolons and trimmed, blanks dropped, and rows without a case id."""
    rows = tables.read_table(spark, path).withColumnRenamed("benchmark_case_id", "case_id")
    ids = F.transform(F.split(F.coalesce(F.col("linked_source_ids").cast("string"), F.lit("")), ";"), lambda x: F.trim(x))
    return rows.withColumn("linked_source_ids", F.filter(ids, lambda x: x != "")).filter("trim(CAST(case_id AS string)) <> ''")
