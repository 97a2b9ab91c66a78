"""Anomaly detectors over a long frame (row_id, entity, period, metric, value): z-score, IQR, change from period to period, rolling baseline.

Statistics are aggregates per metric (and per artifact, where the frame has that column) that are joined back to the rows; nothing is
computed over an unpartitioned window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from attestra.functions import exprs as X
from attestra.session import materialize

CALENDAR = {"day", "month", "year", "fy"}
# How sure a method's findings are, and what is to be kept in mind of each.
CONFIDENCE = {"zscore": "high", "iqr": "high", "yoy": "moderate", "rolling": "moderate"}
CAVEATS = {
    "zscore": "value deviates from cohort distribution",
    "iqr": "value outside robust IQR fence",
    "yoy": "may be a definition, boundary or reporting-period change",
    "rolling": "value deviates from trailing rolling-median baseline",
}
ZERO_BASELINE = "prior period baseline was zero, percentage change is undefined - flagged on new nonzero activity"
MOST = 12


def metric_columns(df: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> list[str]:
    """Numeric columns whose names aren't calendar parts and don't end in id or code."""
    def is_metric(f: T.StructField) -> bool:
        name = f.name.lower()
        return isinstance(f.dataType, T.NumericType) and name not in CALENDAR and not name.endswith(("id", "code"))

    return [f.name for f in df.schema if f.name not in (exclude or []) and (f.name in (include or []) or is_metric(f))]


def find_column(columns: list[str], tokens: list[str]) -> str | None:
    """The first column, by order of tokens, whose lower-case name holds a token."""
    return next((c for t in tokens for c in columns if t in c.lower()), None)


def long_frame(df: DataFrame, metrics: list[str], row_id: Column, entity: Column | None = None, period: Column | None = None, artifact: Column | None = None) -> DataFrame:
    """One row for each row and metric; values that aren't finite numbers become null, so that none of them spoils the statistics of the others. With
    ``artifact`` each artifact's values are judged by themselves."""
    none = F.lit(None).cast("string")
    number = lambda m: X.named(m).try_cast("double")
    values = F.array(*[F.struct(F.lit(m).alias("metric"), F.when(~F.isnan(number(m)) & (F.abs(number(m)) < F.lit(float("inf"))), number(m)).alias("value")) for m in metrics])
    own = [] if artifact is None else [artifact.alias("artifact")]
    return df.select(*own, row_id.alias("row_id"), (entity if entity is not None else none).alias("entity"), (period if period is not None else none).alias("period"), F.inline(values))


def keys_of(rows: DataFrame) -> list[str]:
    return [c for c in ("artifact", "metric") if c in rows.columns]


def findings(rows: DataFrame, method: str, expected: Column, score: Column, severity: Column) -> DataFrame:
    return rows.select(*keys_of(rows), "row_id", "entity", "period", F.lit(method).alias("method"), F.col("value").alias("observed"), expected.alias("expected"), score.alias("score"), severity.alias("severity"))


def with_caveats(found: DataFrame) -> DataFrame:
    """Findings of any method with ``confidence`` and ``caveats`` (a list). A change without a percentage rose from zero."""
    table = lambda values: F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col("method"))
    said = F.when((F.col("method") == "yoy") & F.col("score").isNull(), ZERO_BASELINE).otherwise(table(CAVEATS))
    return found.withColumns({"confidence": table(CONFIDENCE), "caveats": F.filter(F.array(said), lambda c: c.isNotNull())})


def detect_zscore(rows: DataFrame, threshold: float = 3.0) -> DataFrame:
    """Values more than threshold standard deviations from the mean; silent below three values or without spread."""
    keys = keys_of(rows)
    stats = rows.groupBy(*keys).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd")).filter("n >= 3 AND sd > 0")
    z = (F.col("value") - F.col("mean")) / F.col("sd")
    out = rows.join(stats, keys).withColumn("z", z).filter(F.abs("z") > threshold)
    return findings(out, "zscore", F.col("mean"), F.col("z"), X.z_severity(F.col("z")))


#: Rows up to which quartiles come from one aggregate, which holds a metric's different values in a task.
AT_ONCE = 2_000_000


def quartiles(rows: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """(keys, n, q1, q3) of each metric, exactly. Frames of more than ``at_once`` rows rank their values in buckets between approximate quantiles,
    so that no task holds a metric; the bounds of the buckets are a small table."""
    keys = keys_of(rows)
    ends = F.array(F.lit(0.25), F.lit(0.75))
    if rows.count() <= at_once:
        return rows.groupBy(*keys).agg(F.count("value").alias("n"), F.percentile("value", ends).alias("q")).select(*keys, "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"))
    known = rows.filter("value IS NOT NULL").groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("k"))
    cuts = rows.groupBy(*keys).agg(F.percentile_approx("value", [i / 256 for i in range(1, 256)], 4096).alias("cuts"))
    bucket = F.size(F.filter("cuts", lambda c: c <= F.col("value")))
    known = materialize(known.join(cuts, keys).select(*keys, "value", "k", bucket.alias("bucket")), "ranked")
    sums = known.groupBy(*keys, "bucket").agg(F.sum("k").alias("s"))
    before = F.coalesce(F.sum("s").over(Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*keys, "bucket", "s", before.alias("before"), F.sum("s").over(Window.partitionBy(*keys)).alias("n"))
    places = F.transform(ends, lambda q: (F.col("n") - 1) * q)
    ranks = F.array_distinct(F.flatten(F.transform(places, lambda x: F.array(F.floor(x), F.ceil(x)))))
    sums = sums.withColumn("ranks", F.filter(ranks, lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("s")))).filter(F.size("ranks") > 0)
    inside = known.join(sums, [*keys, "bucket"])
    past = F.col("before") + F.sum("k").over(Window.partitionBy(*keys, "bucket").orderBy("value"))
    inside = inside.withColumn("past", past).select(*keys, "n", "value", "past", "k", F.explode("ranks").alias("rank")).filter((F.col("rank") < F.col("past")) & (F.col("rank") >= F.col("past") - F.col("k")))
    at = lambda r: F.max(F.when(F.col("rank") == r, F.col("value")))

    def quartile(q: float) -> Column:
        """Between two neighbours by the sum that ``percentile`` takes, so that both ways give the same bits."""
        place = F.max((F.col("n") - 1) * q)
        a, b = at(F.floor((F.col("n") - 1) * q)), at(F.ceil((F.col("n") - 1) * q))
        return F.when(a == b, a).otherwise((F.ceil(place) - place) * a + (place - F.floor(place)) * b)

    return inside.groupBy(*keys).agg(F.max("n").alias("n"), quartile(0.25).alias("q1"), quartile(0.75).alias("q3"))


def detect_iqr(rows: DataFrame, factor: float = 1.5, at_once: int = AT_ONCE) -> DataFrame:
    """Values beyond factor interquartile ranges; silent below four values. The upper quartile is what is expected; the score counts ranges from
    it on both sides."""
    keys = keys_of(rows)
    stats = quartiles(rows, at_once).filter("n >= 4").select(*keys, "q1", "q3")
    out = rows.join(stats, keys).withColumn("iqr", F.col("q3") - F.col("q1"))
    out = out.filter((F.col("value") < F.col("q1") - factor * F.col("iqr")) | (F.col("value") > F.col("q3") + factor * F.col("iqr")))
    score = F.when(F.col("iqr") > 0, (F.col("value") - F.col("q3")) / F.col("iqr"))
    return findings(out, "iqr", F.col("q3"), score, F.when(score.isNull(), "medium").otherwise(X.z_severity(score)))


def with_past(rows: DataFrame, width: int, spread: bool) -> DataFrame:
    """rows with ``past``: the values (as structs, so that nulls keep their places) of up to ``width`` rows before, of the same metric and entity.

    ``spread`` is for entities (or frames without any) that are too large for one task: rows are dealt by ranges of their order, each range has
    its own window, and the first rows of a range take what they lack from the last ``width`` rows of the ranges before.
    """
    keys, order, value = [*keys_of(rows), "entity"], ["period", "row_id"], F.struct("value")
    if not spread:
        return rows.withColumn("past", F.collect_list(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(-width, -1)))
    dealt = materialize(rows.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    window = Window.partitionBy(*keys, "_range").orderBy(*order)
    dealt = dealt.withColumn("past", F.collect_list(value).over(window.rowsBetween(-width, -1)))
    last = Window.partitionBy(*keys, "_range").orderBy(*[F.desc(c) for c in order])
    tails = dealt.withColumn("_back", F.row_number().over(last)).filter(F.col("_back") <= width)
    tails = tails.groupBy(*keys, "_range").agg(F.sort_array(F.collect_list(F.struct((-F.col("_back")).alias("at"), "value"))).alias("tail"))
    tails = tails.withColumn("tail", F.transform("tail", lambda x: F.struct(x["value"].alias("value"))))
    earlier = F.flatten(F.collect_list("tail").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(-width, -1)))  # of each range ``width`` rows at most
    tails = tails.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_range").alias("_r"), earlier.alias("_earlier"))
    same = dealt["_range"] == tails["_r"]
    for k in keys:
        same = same & dealt[k].eqNullSafe(tails[f"_{k}"])
    whole = F.concat("_earlier", "past")
    most = F.least(F.size(whole), F.lit(width))
    return dealt.join(tails, same).withColumn("past", F.when(most > 0, F.slice(whole, F.size(whole) - most + 1, most)).otherwise(whole)).select(*rows.columns, "past")


def detect_change(rows: DataFrame, most_percent: float = 200.0, high_percent: float = 500.0, spread: bool = False) -> DataFrame:
    """Changes of more than most_percent from the entity's previous period; a rise from zero has no percentage and is high. spread: as in ``with_past``."""
    if spread:
        out = with_past(rows, 1, spread).withColumn("before", F.get("past", F.lit(0))["value"])
    else:
        out = rows.withColumn("before", F.lag("value").over(Window.partitionBy(*keys_of(rows), "entity").orderBy("period", "row_id")))
    percent = F.when(F.col("before") != 0, (F.col("value") - F.col("before")) / F.abs("before") * 100)
    out = out.withColumn("percent", percent).filter((F.abs("percent") > most_percent) | ((F.col("before") == 0) & (F.col("value") != 0)))
    return findings(out, "yoy", F.col("before"), F.col("percent"), F.when(F.col("percent").isNull() | (F.abs("percent") > high_percent), "high").otherwise("medium"))


def middle(values: Column) -> Column:
    """Median of a non-empty array."""
    s, n = F.array_sort(values), F.size(values)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2


def detect_rolling(rows: DataFrame, width: int = 3, threshold: float = 3.0, spread: bool = False) -> DataFrame:
    """Values far from the median of the ``width`` rows before, in units of 1.4826 median absolute deviations; without deviation any
    departure counts, unscored. Rows with a null among those before are skipped. spread: as in ``with_past``."""
    out = with_past(rows, width, spread).withColumn("past", F.transform(F.filter("past", lambda x: x["value"].isNotNull()), lambda x: x["value"]))
    out = out.filter((F.size("past") == width) & F.col("value").isNotNull())
    out = out.withColumn("median", middle(F.col("past")))
    out = out.withColumn("mad", middle(F.transform("past", lambda x: F.abs(x - F.col("median")))) * 1.4826)
    z = F.when(F.col("mad") > 0, (F.col("value") - F.col("median")) / F.col("mad"))
    out = out.withColumn("z", z).filter((F.abs("z") > threshold) | ((F.col("mad") == 0) & (F.col("value") != F.col("median"))))
    return findings(out, "rolling", F.col("median"), F.col("z"), F.when(F.col("z").isNull(), "medium").otherwise(X.z_severity(F.col("z"))))


def strongest(found: DataFrame, by: list[str], most: int = MOST) -> DataFrame:
    """The strongest findings of each group, unscored ones first, with ids method-metric-rank."""
    window = Window.partitionBy(*by).orderBy(F.coalesce(F.abs("score"), F.lit(float("inf"))).desc(), "metric", "method", "row_id")
    ranked = found.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= most)
    return ranked.withColumn("finding_id", F.format_string("%s-%s-%03d", "method", "metric", F.col("rank") - 1))


def query_text(found: DataFrame) -> DataFrame:
    """found with ``slice`` (the entity, or *) and ``evidence_query``, which says what was asked of which rows."""
    key = F.coalesce(F.nullif(F.col("entity"), F.lit("")), F.lit("*"))
    method = F.when(F.col("method") == "yoy", "yoy_change").when(F.col("method") == "rolling", "rolling_baseline").otherwise(F.col("method"))
    place = F.when(F.col("method") == "rolling", F.concat(F.lit("index="), F.col("row_id").cast("string"))).otherwise(key)
    return found.withColumn("slice", key).withColumn("evidence_query", F.concat(method, F.lit(" over "), F.col("metric"), F.lit(" slice="), place))
