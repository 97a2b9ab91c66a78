"""Lineage graphs as two tables: nodes (id, kind, label, detail) and edges (source, target, relation)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from attestra.session import materialize


def build(artifacts: DataFrame, findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """artifacts (artifact_id, has_profile; of them detail, parser and profile_detail, where the table has them), findings (finding_id, artifact_id,
    rule, severity if known): raw, parser, profile, rule and finding nodes of all artifacts at once, each with a label and a detail.

    A finding id that comes again in an artifact gets #1, #2 and so on in order of the rule; rules and findings exist only below a profile.
    Ids hold the artifact, so graphs of many artifacts stand side by side.
    """
    text = lambda df, c, other: F.coalesce(F.col(c).cast("string"), F.lit(other)) if c in df.columns else F.lit(other)
    artifacts = materialize(artifacts, "artifacts")
    profiled = artifacts.filter("has_profile")
    # Numbered before they meet the artifacts: rows that a join has put together by artifact would be sorted so, however many one artifact has.
    again = F.row_number().over(Window.partitionBy("artifact_id", "finding_id").orderBy("rule")) - 1
    found = materialize(findings.withColumn("again", again), "found").join(profiled.select("artifact_id"), "artifact_id", "left_semi")
    found = found.withColumn("node", F.when(F.col("again") > 0, F.concat_ws("#", "finding_id", "again")).otherwise(F.col("finding_id")))
    rules = found.select("artifact_id", "rule").distinct()
    name = lambda kind: F.concat(F.lit(kind + ":"), F.col("artifact_id"))
    rule = F.concat(F.lit("rule:"), F.col("artifact_id"), F.lit(":"), F.col("rule"))
    finding = F.concat(F.lit("finding:"), F.col("artifact_id"), F.lit(":"), F.col("node"))
    node = lambda df, i, kind, label, detail: df.select(i.alias("id"), F.lit(kind).alias("kind"), label.alias("label"), detail.alias("detail"))
    nodes = node(artifacts, name("raw"), "raw_artifact", F.col("artifact_id"), text(artifacts, "detail", ""))
    nodes = nodes.unionByName(node(artifacts, name("parser"), "parser", text(artifacts, "parser", "parser"), F.lit("")))
    nodes = nodes.unionByName(node(profiled, name("profile"), "profile", F.lit("profile"), text(profiled, "profile_detail", "")))
    nodes = nodes.unionByName(node(rules, rule, "rule", F.col("rule"), F.lit("deterministic engine; rerun reproducible from pinned inputs")))
    nodes = nodes.unionByName(node(found, finding, "finding", F.col("finding_id"), F.concat(F.lit("severity="), text(found, "severity", "n/a"))))
    edge = lambda df, a, b, relation: df.select(a.alias("source"), b.alias("target"), F.lit(relation).alias("relation"))
    edges = edge(artifacts, name("raw"), name("parser"), "parsed_by").unionByName(edge(profiled, name("parser"), name("profile"), "profiled_by"))
    return nodes, edges.unionByName(edge(rules, name("profile"), rule, "executed_over")).unionByName(edge(found, rule, finding, "produced"))


def tops(single: DataFrame) -> DataFrame:
    """single: id and its only predecessor ``top``. (id, top, looped): the first of each node's predecessors that is not in ``single`` itself, or whether
    there is none, as the chain goes round. Each round doubles the reach of all chains."""
    at, nodes, reach = materialize(single, "chains"), single.count(), 1
    while True:
        ahead = at.select(F.col("id").alias("top"), F.col("top").alias("next"))
        grown = materialize(at.join(ahead, "top", "left").select("id", F.coalesce("next", "top").alias("top"), F.col("next").isNotNull().alias("looped")), "chains")
        reach *= 2
        if reach > 2 * nodes or grown.filter("looped").isEmpty():
            return grown
        at = grown.select("id", "top")


def on_or_below_cycles(edges: DataFrame) -> DataFrame:
    """ids of nodes that are on a cycle or can be reached from one.

    Chains of nodes with one predecessor are contracted to the node that they hang on, by doubling, and edges from nodes without a predecessor are
    peeled off, in turns until nothing changes. So a chain takes as many rounds as its length has bits; only layers of nodes with several
    predecessors take a turn each.
    """
    left, hung, found = materialize(edges.select("source", "target").distinct(), "edges"), [], None
    size = left.count()
    while size:
        degree = left.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.min("source").alias("top"))
        single = materialize(degree.filter("n = 1").select(F.col("target").alias("id"), "top"), "single")
        chains = tops(single)
        hung.append(chains.filter("NOT looped").select("id", "top"))
        round_ = chains.filter("looped").select("id")
        found = round_ if found is None else found.unionByName(round_)
        rest = left.join(single.select(F.col("id").alias("target")), "target", "left_anti")
        lead = chains.select(F.col("id").alias("source"), "top", "looped")
        rest = rest.join(lead, "source", "left").select(F.when(F.coalesce("looped", F.lit(False)), F.col("source")).otherwise(F.coalesce("top", "source")).alias("source"), "target", F.coalesce("looped", F.lit(False)).alias("below")).distinct()
        rest = materialize(rest, "edges")
        found = found.unionByName(rest.filter("below").select(F.col("target").alias("id")))
        below = rest.filter("below").select("target").distinct()
        open_edges = rest.join(below, "target", "left_anti")  # what is known to be below a cycle needs no more
        targets = open_edges.select(F.col("target").alias("source")).distinct().unionByName(below.select(F.col("target").alias("source")))
        left = materialize(open_edges.join(targets, "source", "left_semi").select("source", "target"), "edges")
        marked = left.join(below.select(F.col("target").alias("source")), "source", "left_semi").select("target").distinct()
        while not marked.isEmpty():  # below a node that is below
            found = found.unionByName(marked.select(F.col("target").alias("id")))
            left = materialize(left.join(marked, "target", "left_anti"), "edges")
            marked = left.join(marked.select(F.col("target").alias("source")), "source", "left_semi").select("target").distinct()
        n = left.count()
        if n == size:
            found = found.unionByName(left.select(F.col("target").alias("id")))
            break
        size = n
    if found is None:
        return edges.select(F.col("target").alias("id")).filter(F.lit(False))
    found = materialize(found.distinct(), "cyclic")
    for chains in reversed(hung):
        found = materialize(found.unionByName(chains.join(found.select(F.col("id").alias("top")), "top", "left_semi").select("id")).distinct(), "cyclic")
    return found


def validate(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(problem, id): repeated node ids, edges to or from nodes that don't exist, and nodes on or below a cycle (``on_or_below_cycles``)."""
    repeated = nodes.groupBy("id").count().filter("count > 1").select(F.lit("duplicate_node").alias("problem"), "id")
    ids = nodes.select("id").distinct()
    ends = edges.select(F.col("source").alias("id")).union(edges.select(F.col("target").alias("id"))).distinct()
    dangling = ends.join(ids, "id", "left_anti").select(F.lit("dangling_edge").alias("problem"), "id")
    return repeated.unionByName(dangling).unionByName(on_or_below_cycles(edges).select(F.lit("cycle").alias("problem"), "id"))


def paths_to_raw(edges: DataFrame) -> DataFrame:
    """(id, path, depth): the chain from each node up to its root, by the smallest predecessor at each step, however long it is.

    Each round doubles what every chain knows: it appends the chain of its last node. A cycle, which has no root, is an error.
    """
    up = edges.groupBy(F.col("target").alias("id")).agg(F.min("source").alias("top"))
    at = materialize(up.select("id", "top", F.array("id", "top").alias("path")), "paths")
    nodes = at.count()
    reach = 1
    while True:
        ahead = at.select(F.col("id").alias("top"), F.col("top").alias("next"), F.slice("path", F.lit(2), F.size("path")).alias("rest"))
        grown = at.join(ahead, "top", "left").select("id", F.coalesce("next", "top").alias("top"), F.when(F.col("rest").isNull(), F.col("path")).otherwise(F.concat("path", "rest")).alias("path"), F.col("next").isNotNull().alias("moved"))
        at, reach = materialize(grown, "paths"), 2 * reach
        if at.filter("moved").isEmpty():
            return at.select("id", F.array_join("path", " < ").alias("path"), F.size("path").alias("depth"))
        if reach > 2 * nodes:
            raise ValueError("the graph has a cycle; validate() names its nodes")
        at = at.select("id", "top", "path")
