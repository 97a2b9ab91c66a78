"""Blind evaluation: coverage of cases, their findings, decisions and rates with explicit denominators, and label-leak scans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from attestra.operators.bit_filter import BitFilter, passing
from attestra.session import materialize
from attestra.sources.append_log import AppendLog

# The decisions on a case.
DECISIONS = ["detected", "partially_detected", "not_detected", "not_detectable"]


def blind(cases: DataFrame) -> DataFrame:
    """Cases without their labels."""
    return cases.select("case_id", "linked_source_ids")


def coverage(cases: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(case_id, n_artifacts, status): artifacts (artifact_id, source_id) by the case's source ids; a case with none is an access gap."""
    links = blind(cases).select("case_id", F.explode_outer("linked_source_ids").alias("source_id")).distinct()
    out = links.join(artifacts, "source_id", "left").groupBy("case_id").agg(F.count_distinct("artifact_id").alias("n_artifacts"))
    return out.withColumn("status", F.when(F.col("n_artifacts") == 0, "unmapped_access_gap").otherwise("mapped"))


def completed(findings: DataFrame) -> DataFrame:
    """findings with ``complete``: whether one has an evidence query, spans or evidence (``evidence_query`` text, ``evidence_spans`` and ``evidence``
    lists, as far as the table has them)."""
    held = [F.col(c) != "" for c in ("evidence_query",) if c in findings.columns] + [F.size(c) > 0 for c in ("evidence_spans", "evidence") if c in findings.columns]
    complete = F.lit(False)
    for one in held:
        complete = complete | F.coalesce(one, F.lit(False))
    return findings.select("finding_id", complete.alias("complete"), "artifact_ids")


def case_findings(cases: DataFrame, artifacts: DataFrame, findings: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """(case_id, finding_id, complete): findings on any of the case's artifacts, each once (complete: see ``completed``).

    That is a row for each case and finding that meet, so their number is a product where cases share artifacts. ``named`` (case_id, finding_id) asks
    for some pairs only; a pair costs a row for each artifact of the finding then. For numbers by case see ``case_results``."""
    links = blind(cases).select("case_id", F.explode("linked_source_ids").alias("source_id")).join(artifacts, "source_id").select("case_id", "artifact_id").distinct()
    rows = completed(findings).select("finding_id", "complete", F.explode("artifact_ids").alias("artifact_id"))
    if named is None:
        met = links.join(rows, "artifact_id")
    else:
        met = rows.join(named.select("case_id", "finding_id").distinct(), "finding_id").join(links, ["case_id", "artifact_id"], "left_semi")
    return met.select("case_id", "finding_id", "complete").distinct()


def sets_of(rows: DataFrame, keys: list[str], ids: str, name: str) -> DataFrame:
    """keys and, as a sorted list ``name``, the different ids in the lists of a key's rows."""
    return rows.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.array_compact(F.flatten(F.collect_list(ids))))).alias(name))


def case_results(cases: DataFrame, artifacts: DataFrame, findings: DataFrame) -> DataFrame:
    """coverage of every case, with n_findings and n_complete (see ``case_findings``).

    Cases of the same sources have the same findings, and findings on the same artifacts have the same cases. So these sets meet, each once, and
    a finding counts where it stands; pairs of cases and findings are never made.
    """
    by_case = materialize(sets_of(blind(cases), ["case_id"], "linked_source_ids", "sources"), "case_sets")
    by_set = sets_of(completed(findings), ["finding_id", "complete"], "artifact_ids", "on").groupBy("on").agg(F.count(F.lit(1)).alias("n"), F.count_if("complete").alias("whole"))
    by_set = materialize(by_set, "finding_sets")
    links = by_case.select("sources").distinct().select("sources", F.explode("sources").alias("source_id")).join(artifacts, "source_id").select("sources", "artifact_id").distinct()
    met = links.join(by_set.select("on", F.explode("on").alias("artifact_id")), "artifact_id").select("sources", "on").distinct()
    counts = met.join(by_set, "on").groupBy("sources").agg(F.sum("n").alias("n_findings"), F.sum("whole").alias("n_complete"))
    counts = by_case.join(counts, "sources").select("case_id", "n_findings", "n_complete")
    return coverage(cases, artifacts).join(counts, "case_id", "left").fillna(0, ["n_findings", "n_complete"])


def rejects(decisions: DataFrame, run_findings: DataFrame) -> DataFrame:
    """(decision_id, reason): unknown decisions, cases that aren't in the run, detections without findings, and findings that aren't among the run's
    findings of that case. run_findings: (case_id, finding_id) of every case of the run, finding_id null for a case without any."""
    told = lambda df, reason: df.select("decision_id", F.lit(reason).alias("reason"))
    unknown = told(decisions.filter(~F.coalesce(F.col("decision").isin(DECISIONS), F.lit(False))), "unknown_decision")
    lost = told(decisions.join(run_findings.select("case_id").distinct(), "case_id", "left_anti"), "foreign_case")
    none = told(decisions.filter(F.col("decision").isin("detected", "partially_detected") & (F.coalesce(F.size("finding_ids"), F.lit(0)) == 0)), "no_findings")
    ids = decisions.select("decision_id", "case_id", F.explode("finding_ids").alias("finding_id"))
    foreign = told(ids.join(run_findings.select("case_id", "finding_id"), ["case_id", "finding_id"], "left_anti"), "foreign_finding").distinct()
    return unknown.unionByName(lost).unionByName(none).unionByName(foreign)


def adjudicate(log: AppendLog, decisions: DataFrame, run_findings: DataFrame) -> tuple[int, DataFrame]:
    """Append the decisions that stand (see ``rejects``) to a log of decisions, each id once, and say how many were new; and the reasons for which
    the others don't. Several judges may append at once."""
    refused = materialize(rejects(decisions, run_findings), "refused")
    return log.append(decisions.join(refused.select("decision_id").distinct(), "decision_id", "left_anti")), refused


def report(run_cases: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row of counts and rates over the latest decision of each case; a rate without a denominator is null.

    run_cases: ``case_results``. Detectability is over the adjudicated cases, evidence completeness over the findings of all cases.
    """
    newest = Window.partitionBy("case_id").orderBy(F.desc("decided_at"), F.desc("decision_id"))
    last = decisions.withColumn("k", F.row_number().over(newest)).filter("k = 1").select("case_id", "decision")
    rows = run_cases.join(last, "case_id", "left")
    out = rows.agg(
        F.count(F.lit(1)).alias("n_cases"), F.count("decision").alias("n_adjudicated"), *[F.count_if(F.col("decision") == d).alias(f"n_{d}") for d in DECISIONS],
        F.count_if(F.col("n_artifacts") > 0).alias("n_mapped"), F.sum("n_findings").alias("n_findings"), F.sum("n_complete").alias("n_complete"))
    rate = lambda a, b, name: F.round(F.try_divide(a, b), 4).alias(name)
    return out.select(
        "n_cases", "n_adjudicated", (F.col("n_cases") - F.col("n_adjudicated")).alias("n_pending"), "n_mapped", (F.col("n_cases") - F.col("n_mapped")).alias("n_unmapped"), *[f"n_{d}" for d in DECISIONS],
        rate(F.col("n_mapped"), F.col("n_cases"), "coverage"), rate(F.col("n_detected") + F.col("n_partially_detected"), F.col("n_adjudicated"), "detectability"), rate(F.col("n_complete"), F.col("n_findings"), "evidence_completeness"))


def words_of(text_col: str) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")


def runs_of(words: str, size: int, of: Callable[[Column], Column]) -> Column:
    """``of`` each run of ``size`` words, each result once."""
    none = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(1)), lambda i: of(F.slice(words, i, size))))
    runs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(words) - size + 1), lambda i: of(F.slice(words, i, size))))
    return F.when(F.size(words) >= size, runs).otherwise(F.slice(none, 1, 0))


def grams(df: DataFrame, id_col: str, text_col: str, size: int = 5, least_chars: int = 20) -> DataFrame:
    """(id, gram): distinct runs of ``size`` lower-case words of at least ``least_chars`` characters."""
    rows = df.select(F.col(id_col).alias("id"), words_of(text_col).alias("w"))
    return rows.select("id", F.explode(runs_of("w", size, lambda r: F.array_join(r, " "))).alias("gram")).filter(F.length("gram") >= least_chars)


def label_leaks(texts: DataFrame, labels: DataFrame, text_id: str, label_id: str, text_col: str = "text", size: int = 5) -> DataFrame:
    """(text_id, label_id, n_grams): texts that share word runs with restricted labels.

    Runs of the texts are hashed in place and held against a filter of the labels' hashes, which has a bounded size however many labels there are, so
    only what it lets through leaves a task. These few meet the labels' hashes, and runs are compared as text only for the texts that any hits.
    """
    b = materialize(grams(labels, label_id, text_col, size).withColumnRenamed("id", "label_id"), "grams")
    hashes = materialize(b.select(F.xxhash64(F.split("gram", " ")).alias("h")).distinct(), "hashes")
    rows = texts.select(F.col(text_id).alias("text_id"), words_of(text_col).alias("w")).select("text_id", runs_of("w", size, F.xxhash64).alias("h"))
    hit = materialize(passing(rows, BitFilter(hashes)).join(hashes, "h", "left_semi").select("text_id").distinct(), "hits")
    a = grams(texts.join(hit, texts[text_id].eqNullSafe(hit["text_id"]), "left_semi"), text_id, text_col, size).withColumnRenamed("id", "text_id")
    return a.join(b, "gram").groupBy("text_id", "label_id").agg(F.count(F.lit(1)).alias("n_grams"))


def id_leaks(texts: DataFrame, ids: DataFrame, text_id: str, id_col: str, text_col: str = "text") -> DataFrame:
    """(text_id, case_id): texts that name a case by its id, as a whole run of letters, digits, hyphens and underscores; case counts."""
    tokens = F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"([\p{L}\p{N}_-]+)"), F.lit(1)))
    named = texts.select(F.col(text_id).alias("text_id"), F.explode(tokens).alias("case_id"))
    return named.join(ids.select(F.col(id_col).cast("string").alias("case_id")).distinct(), "case_id", "left_semi").select("text_id", "case_id")


def prefix_guard(texts: DataFrame, labels: DataFrame, text_id: str, text_col: str = "text", prefix: int = 40, least: int = 12) -> DataFrame:
    """Ids of texts that contain the first ``prefix`` characters of a label (of ``least`` at least).

    A text is cut into blocks of half of ``least`` characters. Whatever position a label starts at, it covers whole blocks, so the label's
    blocks at every shift up to a block's size are keys of an equality join. Of the blocks that a shift covers the one that is rarest in the
    texts is the key, so a block that many texts share is one only for labels that have no other; the whole prefix is checked at the position
    that follows.
    """
    size = least // 2
    heads = labels.select(F.substring(text_col, 1, prefix).alias("head")).filter(F.length("head") >= least).distinct()
    starts = heads.select("head", F.explode(F.sequence(F.lit(1), F.length("head") - size + 1)).alias("at"))
    keys = materialize(starts.select("head", ((F.col("at") - 1) % size).alias("shift"), "at", F.substr("head", F.col("at"), F.lit(size)).alias("key")), "keys")
    rows = texts.select(F.col(text_id).alias("text_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    blocks = F.regexp_extract_all("t", F.lit("(?s)(.{%d})" % size), F.lit(1))
    hits = materialize(rows.select("text_id", F.posexplode(blocks).alias("block", "key")).join(keys.select("key").distinct(), "key", "left_semi"), "blocks")
    counts = hits.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    rarest = keys.join(counts, "key", "left").groupBy("head", "shift").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "at", "key")).alias("k")).filter("k.n > 0")
    found = hits.join(rarest.select("head", F.col("k.at").alias("at"), F.col("k.key").alias("key")), "key")
    found = found.select("text_id", "head", (F.col("block") * size - F.col("at") + 2).alias("start")).filter("start >= 1").distinct()
    checked = rows.join(found, "text_id").filter(F.substr("t", F.col("start").cast("int"), F.length("head")) == F.col("head"))
    return checked.select("text_id").distinct()
