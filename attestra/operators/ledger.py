"""The findings ledger: idempotent appends, upserts, reviews, queues, facets, evidence and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from attestra.functions import exprs as X
from attestra.session import materialize

# What a review can set, titles of drift findings, what a decision means, and what a verdict on two totals is called.
STATUSES = ["open", "needs_source_clarification", "resolved", "not_detectable", "false_positive_after_review"]
DRIFT_TITLES = {
    "unit": "The units used for '{}' changed",
    "definition": "The definition of '{}' changed",
    "denominator": "What '{}' is measured against changed",
    "scope": "What's included in '{}' changed",
}
DECISION_TEXTS = {
    "comparable": "Still safe to compare directly.",
    "partial": "Only partly comparable now, check before comparing directly.",
    "not_comparable": "No longer safe to compare directly.",
}
VERDICT_TITLES = {
    "conflict": "These two sources disagree",
    "explainable": "Small difference between sources, likely explainable",
    "not_comparable": "Can't compare these two sources yet",
}


def new_findings(ledger: DataFrame, incoming: DataFrame, key: str = "finding_id") -> DataFrame:
    """Incoming rows whose id the ledger doesn't have, each id once."""
    return incoming.dropDuplicates([key]).join(ledger.select(key), key, "left_anti")


def latest(rows: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """One row for each key: the last by ``order``, of equals (or without an order) the largest by all columns."""
    by = [F.desc(order)] if order else []
    window = Window.partitionBy(key).orderBy(*by, *[F.desc(c) for c in rows.columns if c != key])
    return rows.withColumn("_last", F.row_number().over(window)).filter("_last = 1").drop("_last")


def upsert(existing: DataFrame, incoming: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """existing with incoming rows in place of those of the same key, and the new ones added. Of a key that comes in repeatedly, the last counts."""
    incoming = latest(incoming, key, order)
    return existing.join(incoming.select(key), key, "left_anti").unionByName(incoming)


def ingest_conflicts(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """(key, reason): incoming ids that exist already or come more than once."""
    counts = incoming.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    known = counts.join(existing.select(key).distinct(), key, "left_semi").select(key, F.lit("exists").alias("reason"))
    return known.unionByName(counts.filter("n > 1").select(key, F.lit("repeated").alias("reason")))


def matching(ledger: DataFrame, severity: str | None = None, kind: str | None = None, status: str | None = None, text: str | None = None) -> DataFrame:
    """The findings of this severity, kind and status whose title or summary holds the text, case aside."""
    for column, value in (("severity", severity), ("kind", kind), ("status", status)):
        if value is not None:
            ledger = ledger.filter(F.col(column) == value)
    if text:
        ledger = ledger.filter(F.lower("title").contains(text.lower()) | F.lower("summary").contains(text.lower()))
    return ledger


def queue(ledger: DataFrame, severity: str | None = None, kind: str | None = None, status: str | None = None, text: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of the findings that match, newest first, each with the ``total`` of all that match."""
    rows = matching(ledger, severity, kind, status, text)
    total = rows.agg(F.count(F.lit(1)).alias("total")).scalar()
    return rows.orderBy(F.desc("created_at"), "finding_id").offset(offset).limit(limit).withColumn("total", total)


def apply_reviews(ledger: DataFrame, reviews: DataFrame, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The ledger after a batch of reviews (finding_id, status, note), and the reviews with a status that doesn't exist.

    Of several reviews of a finding the last counts (by ``order``, such as the time of the review). A review without a note leaves the note.
    """
    known = F.coalesce(F.col("status").isin(STATUSES), F.lit(False))
    good = latest(reviews.filter(known), "finding_id", order).select("finding_id", F.col("status").alias("new_status"), F.col("note").alias("new_note"))
    out = ledger.join(good, "finding_id", "left").withColumn("status", F.coalesce("new_status", "status")).withColumn("note", F.coalesce("new_note", "note"))
    return out.drop("new_status", "new_note"), reviews.filter(~known)


def severity_rank(severity: Column) -> Column:
    out = F.lit(0)
    for k, s in enumerate(("info", "low", "medium", "high", "critical"), 1):
        out = F.when(severity == s, k).otherwise(out)
    return out


def featured(ledger: DataFrame) -> DataFrame:
    """The most severe open finding, the newest of equals; the newest of all if none is open."""
    rank = F.when(F.col("status") == "open", severity_rank(F.col("severity"))).otherwise(0)
    return ledger.orderBy(F.desc(rank), F.desc("created_at"), "finding_id").limit(1)


def by_artifact(ledger: DataFrame) -> DataFrame:
    """The bridge (finding_id, artifact_id) with the finding's columns: lists are exploded once, and joins are on equality."""
    return ledger.withColumn("artifact_id", F.explode("artifact_ids"))


def facets(ledger: DataFrame, most_files: int = 6) -> DataFrame:
    """(facet, value, n): counts by severity and kind, and the artifacts with most findings."""
    counts = ledger.select(F.inline(F.array(F.struct(F.lit("severity").alias("facet"), F.col("severity").alias("value")), F.struct(F.lit("kind").alias("facet"), F.col("kind").alias("value"))))).groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))
    files = by_artifact(ledger).groupBy(F.col("artifact_id").alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(most_files)
    return counts.unionByName(files.select(F.lit("artifact").alias("facet"), "value", "n"))


def dashboard(ledger: DataFrame) -> DataFrame:
    """Counts by severity, by kind and in all, with the open ones, in one pass by grouping sets."""
    severity, kind = F.col("severity"), F.col("kind")
    return ledger.groupingSets([[severity], [kind], []], severity, kind).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "open").alias("n_open"))


def dashboard_totals(artifacts: DataFrame, ledger: DataFrame) -> DataFrame:
    """One row: artifacts (artifact_id, row_count, byte_size, fitness) with all their rows and bytes and the average fitness of those that have
    one, and the ledger's findings and open reviews."""
    held = artifacts.agg(
        F.count(F.lit(1)).alias("artifacts"), F.coalesce(F.sum("row_count"), F.lit(0)).cast("long").alias("rows_total"), F.coalesce(F.sum("byte_size"), F.lit(0)).cast("long").alias("bytes_total"),
        F.round(F.avg("fitness"), 1).alias("avg_fitness"))
    found = ledger.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "open").alias("o"))
    return held.withColumn("findings_total", found.select("n").scalar()).withColumn("open_reviews", found.select("o").scalar())


def recent(rows: DataFrame, key: str, most: int) -> DataFrame:
    """The ``most`` newest rows; of equally new ones the smallest keys first."""
    return rows.orderBy(F.desc("created_at"), key).limit(most)


def titles_and_summaries(findings: DataFrame) -> DataFrame:
    """findings with a plain title and summary by their kind. Read are, for anomalies: metric, slice (text, null for the whole), observed, expected;
    benford: column, n_values, conformity; drift: drift_type, concept_id, decision, impact; contradiction: status, value_a, value_b; consensus:
    metric, verdict, apparent_sources, distinct_origins. Columns that a table doesn't have count as null."""
    has = lambda c, kind="string": F.col(c).cast(kind) if c in findings.columns else F.lit(None).cast(kind)
    say = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    number = lambda c: X.general(has(c, "double"))
    look = lambda table, c: F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), has(c))
    observed, expected = has("observed", "double"), has("expected", "double")
    where = F.coalesce(F.nullif(has("slice"), F.lit("")), F.lit("overall"))
    off = F.format_string("%.0f", F.bround(F.abs(observed - expected) / F.abs(expected) * 100, 0))
    anomaly = F.when(F.abs(expected) < 1e-9, say("We found ", number("observed"), ", but expected close to 0 for ", where, ".")).otherwise(say("We found ", number("observed"), ", but expected around ", number("expected"), " (", off, "% off) for ", where, "."))
    unusual = F.when(has("conformity") == "nonconformity", "very unusual").otherwise("somewhat unusual")
    benford = say("We checked ", has("n_values"), " numbers in this column. Their pattern looks ", unusual, " compared to what real, unmanipulated numbers usually look like. This is a signal worth checking, not proof of a problem.")
    drift_title = F.replace(F.coalesce(look(DRIFT_TITLES, "drift_type"), F.lit("How '{}' is measured changed")), F.lit("{}"), has("concept_id"))
    drift = say(F.coalesce(look(DECISION_TEXTS, "decision"), F.lit("")), " How big a change: ", F.format_string("%.0f", F.bround(has("impact", "double") * 100, 0)), "%.")
    alone = has("verdict") == "independent_corroboration"
    reported = say(has("apparent_sources"), " source(s) reported this, ")
    consensus = F.when(alone, say(reported, "and they really are independent of each other.")).otherwise(say(reported, "but they all trace back to just ", has("distinct_origins"), " original source. More reports doesn't mean more confirmation here."))
    kind = F.col("kind")
    title = F.when(kind == "anomaly", say("Unusual number for ", has("metric"))).when(kind == "benford", say("Unusual number pattern in '", has("column"), "'")).when(kind == "drift", drift_title)
    title = title.when(kind == "contradiction", look(VERDICT_TITLES, "status")).when(kind == "consensus", F.when(alone, say("Confirmed by independent sources: ", has("metric"))).otherwise(say("Looks like copies of one source: ", has("metric")))).otherwise("finding")
    summary = F.when(kind == "anomaly", anomaly).when(kind == "benford", benford).when(kind == "drift", drift).when(kind == "contradiction", say("One reports ", number("value_a"), ", the other reports ", number("value_b"), ".")).when(kind == "consensus", consensus)
    return findings.withColumns({"title": title, "summary": summary})


def value_cell(value: Column) -> Column:
    """Cells in which two values a millionth apart (of the larger, or of 1) are neighbours at most: of equal width up to 1, of equal share beyond."""
    size = F.abs(value)
    cell = F.when(size < 1, F.floor(size / 2e-6)).otherwise(500_000 + F.floor(F.log(F.greatest(size, F.lit(1.0))) * 1e5))
    return F.when(value < 0, -cell - 1).otherwise(cell)


def evidence(findings: DataFrame, cells: DataFrame, most: int = 25) -> DataFrame:
    """findings (finding_id, artifact_id, slice: a map of columns to wanted values, as text) with the stored rows that match every entry.

    cells: (artifact_id, row_number, column, value as text), one row for each stored value. A wanted number matches numbers within a millionth,
    any other text the equal text. Only the entry of a slice that the fewest stored values may meet is looked up, by an equality join on cells
    of values; the rows that it finds are held against the other entries, so an entry that a third of all rows meet costs nothing beside a
    rarer one. Findings that want the same are looked up once. Returned are the first ``most`` rows of a finding by row number, with how many match; a
    finding without a match has no rows.
    """
    alike = F.to_json(F.struct("artifact_id", F.array_sort(F.map_entries("slice")).alias("slice")))
    findings = materialize(findings.withColumn("alike", alike).dropDuplicates(["finding_id", "alike"]), "findings")
    want = findings.groupBy("alike").agg(F.first("artifact_id").alias("artifact_id"), F.first("slice").alias("slice")).withColumnRenamed("alike", "finding_id")
    want = want.select("finding_id", "artifact_id", F.explode("slice").alias("column", "want")).withColumn("number", F.col("want").try_cast("double"))
    cell = lambda number: F.concat(F.lit("#"), value_cell(number).cast("string"))
    near = F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda k: F.concat(F.lit("#"), (value_cell(F.col("number")) + k).cast("string")))
    text = F.concat(F.lit("="), F.col("want"))
    want = materialize(want.withColumn("key", F.explode(F.when(F.col("number").isNull(), F.array(text)).otherwise(near))), "want")
    at = ["artifact_id", "column", "key"]
    have = F.col("value").try_cast("double")
    held = cells.select("artifact_id", "row_number", "column", "value", F.inline(F.filter(F.array(
        F.struct(F.concat(F.lit("="), F.col("value")).alias("key")), F.when(have.isNotNull(), F.struct(cell(have).alias("key")))), lambda x: x.isNotNull())))
    held = materialize(held.join(want.select(*at).distinct(), at, "left_semi"), "held")
    counts = held.groupBy(*at).agg(F.count(F.lit(1)).alias("n"))
    sizes = want.join(counts, at, "left").groupBy("finding_id", "column").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    rarest = sizes.groupBy("finding_id").agg(F.min(F.struct("n", "column"))["column"].alias("rarest"), F.count(F.lit(1)).alias("entries"))
    want = materialize(want.join(rarest, "finding_id"), "entries")
    number = F.col("value").try_cast("double")
    meets = F.when(F.col("number").isNull(), F.col("value") == F.col("want")).otherwise(F.abs(number - F.col("number")) <= 1e-6 * F.greatest(F.abs("number"), F.lit(1.0)))
    hits = held.join(want.filter("column = rarest"), at).filter(meets).select("finding_id", "artifact_id", "row_number", "entries").distinct()
    rest = want.filter("column <> rarest").select("finding_id", "column", "want", "number").distinct()
    others = hits.filter("entries > 1").join(rest, "finding_id").join(cells, ["artifact_id", "row_number", "column"]).filter(meets)
    others = others.groupBy("finding_id", "artifact_id", "row_number", "entries").agg(F.count(F.lit(1)).alias("met")).filter("met = entries - 1").drop("met")
    rows = hits.filter("entries = 1").unionByName(others)
    matched = rows.groupBy("finding_id").agg(F.count(F.lit(1)).alias("matched"))
    first = rows.withColumn("k", F.row_number().over(Window.partitionBy("finding_id").orderBy("row_number"))).filter(F.col("k") <= most)
    found = first.join(matched, "finding_id").select(F.col("finding_id").alias("alike"), "row_number", "matched", (F.col("matched") > most).alias("truncated"))
    return findings.select("finding_id", "artifact_id", "alike").join(found, "alike").select("finding_id", "artifact_id", "row_number", "matched", "truncated")


def evidence_label(findings: DataFrame) -> DataFrame:
    """(finding_id, label): what the rows behind a finding are. findings: finding_id, kind, metric, slice (map), digit (of first-digit findings)."""
    entries = F.array_join(F.transform(F.array_sort(F.map_entries("slice")), lambda e: F.concat_ws(" = ", e["key"], e["value"])), ", ")
    whole = F.when(F.col("metric").isNotNull(), F.concat(F.lit("Sample rows of '"), F.col("metric"), F.lit("'"))).otherwise("Stored rows")
    rows = F.when(F.coalesce(F.size("slice"), F.lit(0)) > 0, F.concat(F.lit("Rows where "), entries)).otherwise(whole)
    digit = F.concat(F.lit("Rows whose leading digit is "), F.col("digit").cast("string"), F.lit(" in '"), F.col("metric"), F.lit("'"))
    label = F.when(F.col("kind").isin("drift", "contradiction", "consensus"), "This flag compares files or definitions, it points at no single row.").when(F.col("kind") == "benford", digit).otherwise(rows)
    return findings.select("finding_id", label.alias("label"))


def listing(artifacts: DataFrame, columns: DataFrame, observations: DataFrame, fitness: DataFrame, ledger: DataFrame) -> DataFrame:
    """artifacts (artifact_id and what else they have) with row_count and column_count of their profile, n_observations, score and grade of their fitness, and
    n_findings; what an artifact lacks is null, counts are zero. columns: artifact_id, column, row_count; fitness: artifact_id, component, score, grade."""
    count = lambda df, name: df.groupBy("artifact_id").agg(F.count(F.lit(1)).alias(name))
    held = columns.groupBy("artifact_id").agg(F.max("row_count").alias("row_count"), F.count(F.lit(1)).alias("column_count"))
    whole = fitness.filter("component = 'overall'").select("artifact_id", "score", "grade")
    out = artifacts.join(held, "artifact_id", "left").join(whole, "artifact_id", "left")
    for df, name in ((observations, "n_observations"), (by_artifact(ledger).select("artifact_id"), "n_findings")):
        out = out.join(count(df, name), "artifact_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def case_bundle(manifests: DataFrame, columns: DataFrame, fitness: DataFrame, ledger: DataFrame) -> DataFrame:
    """(artifact_id, section, key, body): all that is known of each artifact, a row for its manifest, each profiled column, each component of its
    fitness and each finding, the body as JSON. Rows of an artifact are never gathered; ``export_cases`` writes them by artifact."""
    body = lambda df: F.to_json(F.struct(*[c for c in df.columns if c not in ("artifact_id", "artifact_ids")]))
    part = lambda df, section, key: df.select("artifact_id", F.lit(section).alias("section"), F.col(key).cast("string").alias("key"), body(df).alias("body"))
    parts = [part(manifests, "manifest", "artifact_id"), part(columns, "profile", "column"), part(fitness, "fitness", "component"), part(by_artifact(ledger), "finding", "finding_id")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def case_export(artifacts: DataFrame, ledger: DataFrame) -> DataFrame:
    """Each artifact with its findings, a row a finding (one without, if it has none), to be written partitioned by artifact."""
    found = by_artifact(ledger).select("artifact_id", "finding_id", "kind", "severity", "status")
    return artifacts.join(found, "artifact_id", "left")


def export_cases(cases: DataFrame, path: str) -> None:
    """Write a case export as JSON, a folder for each artifact."""
    cases.write.mode("errorifexists").partitionBy("artifact_id").json(path)
