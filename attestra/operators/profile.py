"""Profiles of tables: statistics by column, value frequencies, candidate keys, quality observations, personal-data hints, fitness scores."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from attestra.functions import exprs as X
from attestra.operators.anomaly import metric_columns
from attestra.session import materialize

# Shapes of personal data, and column names that speak for each.
PII_SHAPES = {
    "aadhaar": r"^[2-9]\d{3}[ -]\d{4}[ -]\d{4}$",
    "pan": r"^[A-Z]{5}\d{4}[A-Z]$",
    "mobile_phone": r"^(?:\+91[ -]?)?[6-9]\d{9}$",
    "email": r"^[^@\s]+@[^@\s]+\.[^@\s]+$",
    "bank_account": r"^\d{9,18}$",
    "passport": r"^[A-Z]\d{7}$",
    "voter_id": r"^[A-Z]{3}\d{7}$",
}
PII_NAMES = {
    "aadhaar": "aadhaar", "aadhar": "aadhaar", "uid": "aadhaar",
    "pan": "pan", "pan_no": "pan", "pan_number": "pan",
    "mobile": "mobile_phone", "phone": "mobile_phone", "phone_no": "mobile_phone", "mobile_no": "mobile_phone",
    "email": "email", "e_mail": "email", "mail": "email",
    "account_no": "bank_account", "bank_account": "bank_account", "bank_ac": "bank_account",
    "passport": "passport",
    "epic": "voter_id", "voter": "voter_id",
}
QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)
#: Rows up to which quantiles come from one aggregate, which holds a column's different values in a task; more rows go through buckets.
AT_ONCE = 2_000_000
# Weights of the fitness components, and what an observation costs.
WEIGHTS = {"completeness": 0.30, "duplication": 0.15, "validity": 0.20, "consistency": 0.15, "identifier_exposure": 0.10, "distribution_health": 0.10}
PENALTY = {"high": 30.0, "medium": 12.0, "low": 4.0}


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def finite(column: str) -> Column:
    """A numeric column's values as doubles, null where they are no finite numbers."""
    x = X.named(column).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(math.inf)), x)


def value_counts(df: DataFrame, columns: list[str] | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(column, value, n) of all non-null values as strings: one unpivot and one aggregate for all columns.

    Here and below, ``by`` are columns that say which of many tables a row belongs to, such as an artifact: all of them are profiled in the same jobs.
    """
    columns = columns or [c for c in df.columns if c not in by]
    pairs = [F.struct(F.lit(c).alias("column"), X.named(c).cast("string").alias("value")) for c in columns]
    return df.select(*by, F.inline(F.array(*pairs))).filter("value IS NOT NULL").groupBy(*by, "column", "value").agg(F.count(F.lit(1)).alias("n"))


def distinct_counts(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return counts.groupBy(*by, "column").agg(F.count(F.lit(1)).alias("unique_count"))


def top_values(counts: DataFrame, most: int = 5) -> DataFrame:
    window = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return counts.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= most)


def sample_values(counts: DataFrame, most: int = 5) -> DataFrame:
    """The smallest distinct values of each column, for a result that doesn't depend on the order of rows."""
    window = Window.partitionBy("column").orderBy("value")
    return counts.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= most).select("column", "value", "rank")


def values_at(df: DataFrame, wanted: list[tuple[str, int]], buckets: int = 1024) -> dict[tuple[str, int], float]:
    """The value of each wanted rank (column, rank from 0) among the column's non-null numbers, exactly.

    Approximate quantiles cut each column into buckets; the buckets' counts, a bounded table, say which bucket holds a rank. Only the
    different values of those buckets are ranked, each bucket in a task of its own, so no task holds a column.
    """
    columns = sorted({c for c, _ in wanted})
    edges = df.agg(*[F.percentile_approx(finite(c), [k / buckets for k in range(1, buckets)], 8 * buckets).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    cuts = df.sparkSession.createDataFrame([(c, sorted(set(e))) for c, e in zip(columns, edges) if e], "column string, edges array<double>")
    pairs = [F.struct(F.lit(c).alias("column"), finite(c).alias("value")) for c in columns]
    values = df.select(F.inline(F.array(*pairs))).filter("value IS NOT NULL").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    # How many edges a value has passed, by halving.
    middle = "CAST((s.lo + s.hi) div 2 AS int)"
    halves = f"IF(edges[{middle}] <= value, struct({middle} + 1 AS lo, s.hi AS hi), struct(s.lo AS lo, {middle} AS hi))"
    low = F.expr(f"aggregate(sequence(1, {buckets.bit_length()}), struct(0 AS lo, size(edges) AS hi), (s, i) -> IF(s.lo < s.hi, {halves}, s), s -> s.lo)")
    values = materialize(values.join(F.broadcast(cuts), "column").select("column", "value", "n", low.cast("int").alias("bucket")), "values")
    counts: dict[str, list[tuple[int, int]]] = {c: [] for c in columns}
    for r in values.groupBy("column", "bucket").agg(F.sum("n").alias("n")).orderBy("column", "bucket").collect():  # at most ``buckets`` rows a column
        counts[r["column"]].append((r["bucket"], r["n"]))
    inside = []
    for c, rank in wanted:
        before = 0
        for bucket, n in counts[c]:
            if rank < before + n:
                inside.append((c, bucket, rank, rank - before))
                break
            before += n
    places = df.sparkSession.createDataFrame(inside, "column string, bucket int, rank long, place long")
    order = Window.partitionBy("column", "bucket").orderBy("value")
    here = values.join(F.broadcast(places.select("column", "bucket").distinct()), ["column", "bucket"])
    here = here.withColumn("past", F.sum("n").over(order))
    rows = here.join(F.broadcast(places), ["column", "bucket"]).filter((F.col("place") < F.col("past")) & (F.col("place") >= F.col("past") - F.col("n")))
    return {(r["column"], r["rank"]): r["value"] for r in rows.select("column", "rank", "value").collect()}  # one row a wanted rank


def exact_quantiles(df: DataFrame, columns: list[str], quantiles: tuple[float, ...] = QUANTILES, nearest: bool = False) -> dict[str, list[float | None]]:
    """The quantiles of each column's finite numbers: between two neighbouring values in proportion, by the sum that Spark's ``percentile`` takes, or the value
    of the nearest rank, upper at a tie. For tables of any size: see ``values_at``."""
    counts = dict(zip(columns, df.agg(*[F.count(finite(c)).alias(f"c{i}") for i, c in enumerate(columns)]).first()))
    at = {c: [(counts[c] - 1) * q for q in quantiles] for c in columns if counts[c]}
    if nearest:
        at = {c: [float(math.floor(x + 0.5)) for x in xs] for c, xs in at.items()}
    found = values_at(df, sorted({(c, k) for c, xs in at.items() for x in xs for k in (math.floor(x), math.ceil(x))})) if at else {}

    def between(c: str, x: float) -> float:
        a, b = found[c, math.floor(x)], found[c, math.ceil(x)]
        return a if a == b else (math.ceil(x) - x) * a + (x - math.floor(x)) * b

    return {c: [between(c, x) for x in at[c]] if c in at else [None] * len(quantiles) for c in columns}


def column_stats(df: DataFrame, at_once: int = AT_ONCE, by: tuple[str, ...] = ()) -> DataFrame:
    """One row per column: nulls, and for numbers min, max, mean, stddev, skewness (population) and five quantiles of the finite ones, and how many are not
    finite. One pass over the rows; beyond ``at_once`` of them the quantiles take passes of their own (``exact_quantiles``) with the same results, bit by bit. Tables of ``by`` are such as one task can take the different values of a column of."""
    fields = [f for f in df.schema if f.name not in by]
    numbers = [f.name for f in fields if is_numeric(f.dataType)]
    apart = exact_quantiles(df, numbers) if numbers and not by and df.count() > at_once else None
    aggregates: list[Column] = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(fields):
        aggregates.append(F.count(X.named(f.name)).alias(f"n{i}"))
        if is_numeric(f.dataType):
            x = finite(f.name)
            q = F.percentile(x, F.array(*map(F.lit, QUANTILES))) if apart is None else F.array(*[F.lit(v).cast("double") for v in apart[f.name]])
            aggregates += [F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"), F.avg(x).alias(f"mean{i}"), F.stddev_samp(x).alias(f"sd{i}"), F.skewness(x).alias(f"sk{i}"), F.count(x).alias(f"fin{i}"), q.alias(f"q{i}")]
    one = df.groupBy(*by).agg(*aggregates)
    none = F.lit(None).cast("double")
    metrics = metric_columns(df)
    rows = []
    for i, f in enumerate(fields):
        numeric = is_numeric(f.dataType)
        get = lambda name, i=i, numeric=numeric: F.col(f"{name}{i}") if numeric else none
        quantiles = [(F.col(f"q{i}")[k] if numeric else none).alias(f"p{round(100 * p)}") for k, p in enumerate(QUANTILES)]
        nulls = F.col("rows") - F.col(f"n{i}")
        rows.append(F.struct(
            F.lit(f.name).alias("column"), F.lit(i).alias("position"), F.lit(f.dataType.simpleString()).alias("dtype"), F.lit(numeric).alias("is_numeric"), F.lit(f.name in metrics).alias("is_metric"),
            F.col("rows").alias("row_count"), nulls.alias("null_count"), F.round(nulls / F.greatest("rows", F.lit(1)), 4).alias("null_ratio"),
            get("lo").alias("min"), get("hi").alias("max"), get("mean").alias("mean"), get("sd").alias("stddev"), get("sk").alias("skewness"), *quantiles,
            (F.col(f"n{i}") - F.col(f"fin{i}") if numeric else F.lit(0)).cast("long").alias("nonfinite_count"),
        ))
    return one.select(*by, F.inline(F.array(*rows)))


def nearest_quantiles(df: DataFrame, columns: list[str], at_once: int = AT_ONCE) -> DataFrame:
    """Quantiles that are values of the column: the one at the nearest rank to (n - 1) q, upper at a tie."""
    names = [f"p{round(100 * q)}" for q in QUANTILES]
    schema = "column string, " + ", ".join(f"{n} double" for n in names)
    if not columns:
        return df.sparkSession.createDataFrame([], schema)
    if df.count() > at_once:
        return df.sparkSession.createDataFrame([(c, *q) for c, q in exact_quantiles(df, columns, nearest=True).items()], schema)
    n = dict(zip(columns, df.agg(*[F.count(finite(c)).alias(f"c{i}") for i, c in enumerate(columns)]).first()))
    at = lambda c, q: math.floor((n[c] - 1) * q + 0.5) / (n[c] - 1) if n[c] > 1 else 0.0
    one = df.agg(*[F.percentile(finite(c), F.array(*[F.lit(at(c, q)) for q in QUANTILES])).alias(f"c{i}") for i, c in enumerate(columns)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"c{i}")[k].alias(name) for k, name in enumerate(names)]) for i, c in enumerate(columns)])))


def duplicate_rows(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row (or one for each table): row_count, duplicate_rows (rows less distinct rows; nulls are equal)."""
    inner = [f"c{i}" for i in range(len(df.columns))]
    groups = df.toDF(*inner).groupBy(*inner).agg(F.count(F.lit(1)).alias("n"))
    keys = [F.col(f"c{df.columns.index(c)}").alias(c) for c in by]
    return groups.groupBy(*keys).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))


def candidate_keys(stats: DataFrame, distinct: DataFrame, most: int = 10) -> DataFrame:
    """Columns without nulls whose values are all different, of tables of more than one row: the first ``most`` in the order of the columns."""
    keys = stats.join(distinct, "column").filter("null_count = 0 AND unique_count = row_count AND row_count > 1")
    return keys.orderBy("position").limit(most).select("column", "row_count")


def quality_observations(stats: DataFrame, distinct: DataFrame, duplicates: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(code, severity, column): duplicate rows, all-null, mostly null and constant columns (without any null), zeros as the least of values that
    go above it. Nulls are judged by their exact counts."""
    full = stats.join(distinct, [*by, "column"], "left").withColumn("unique_count", F.coalesce("unique_count", F.lit(0)))
    told = lambda code, severity: F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))
    rules = F.array(
        F.when((F.col("null_count") == F.col("row_count")) & (F.col("row_count") > 0), told("COLUMN_ALL_NULL", "high")).when(F.col("null_count") * 2 > F.col("row_count"), told("COLUMN_HIGH_NULL_RATIO", "medium")),
        F.when((F.col("unique_count") == 1) & (F.col("null_count") == 0), told("COLUMN_CONSTANT", "low")),
        F.when(F.col("is_numeric") & (F.col("min") == 0) & (F.col("max") > 0), told("ZERO_MIN_NUMERIC", "info")),
    )
    by_column = full.select(*by, "column", F.inline(F.filter(rules, lambda r: r.isNotNull()))).select(*by, "code", "severity", "column")
    severity = F.when(F.col("duplicate_rows") * 100 > F.col("row_count"), "medium").otherwise("low")
    whole = duplicates.filter("duplicate_rows > 0").select(*by, F.lit("DUPLICATE_ROWS").alias("code"), severity.alias("severity"), F.lit(None).cast("string").alias("column"))
    return by_column.unionByName(whole)


def pii_hints(df: DataFrame, counts: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(column, hint_type, matched_values, samples): columns whose name and values both speak for a kind of personal data."""
    signals = [(c, kind, PII_SHAPES[kind]) for c in df.columns if (kind := PII_NAMES.get(c.strip().lower().replace(" ", "_")))]
    if not signals:
        none = F.lit(None).cast("string")
        return df.filter(F.lit(False)).select(*by, none.alias("column"), none.alias("hint_type"), F.lit(0).cast("long").alias("matched_values"), none.alias("samples"))
    counts = counts if counts is not None else value_counts(df, sorted({c for c, _, _ in signals}), by)
    hit = F.array(*[F.when((F.col("column") == c) & F.col("value").rlike(shape), F.lit(kind)) for c, kind, shape in signals])
    rows = counts.select(*by, "column", "value", "n", F.explode(F.filter(hit, lambda k: k.isNotNull())).alias("hint_type"))
    keys = [*by, "column", "hint_type"]
    totals = rows.groupBy(*keys).agg(F.sum("n").alias("matched_values"))
    first = Window.partitionBy(*keys).orderBy("value")
    few = rows.withColumn("rank", F.row_number().over(first)).filter("rank <= 3")  # each task ranks its own rows first
    samples = few.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("value")), ",").alias("samples"))
    return totals.join(samples, keys)


class Profile:
    """The narrow tables of a table's profile, or of the profiles of many tables (``by``), each computed once and written to the shared folder."""

    def __init__(self, df: DataFrame, by: tuple[str, ...] = ()):
        self.by = by
        self.columns = materialize(column_stats(df, by=by), "stats")
        self.values = materialize(value_counts(df, by=by), "values")
        self.distinct = materialize(distinct_counts(self.values, by), "distinct")
        self.duplicates = materialize(duplicate_rows(df, by), "duplicates")
        self.observations = quality_observations(self.columns, self.distinct, self.duplicates, by)
        self.pii = pii_hints(df, self.values, by)


def fitness(df: DataFrame) -> DataFrame:
    """Components (component, score, weight) of a table's fitness, and the weighted whole as component ``overall`` with its grade.

    Validity pays for observations of high severity, consistency for medium and low ones; distribution health pays 20 for a whole table of
    metric columns without spread or with a skewness beyond 5, in proportion.
    """
    return fitness_of(Profile(df))


def fitness_of(profile: Profile) -> DataFrame:
    by, each = profile.by, profile.duplicates.select(*profile.by)  # a row for each table, also for those without observations or hints
    none = F.lit(None).cast("string")
    paid = lambda severities: F.greatest(F.lit(0.0), 100.0 - sum((F.count_if(F.col("severity") == s) * PENALTY[s] for s in severities), F.lit(0.0)))
    observed = profile.observations.select(*by, "severity").unionByName(each.select(*by, none.alias("severity")))
    rules = observed.groupBy(*by).agg(paid(["high"]).alias("validity"), paid(["medium", "low"]).alias("consistency"))
    flagged = F.count_if(F.col("is_metric") & ((F.col("stddev") == 0) | (F.abs("skewness") > 5)))
    columns = profile.columns.groupBy(*by).agg(
        F.greatest(F.lit(0.0), 100 * (1 - F.avg("null_ratio"))).alias("completeness"),
        F.when(F.count_if("is_metric") == 0, 80.0).otherwise(100.0 - 20.0 * F.try_divide(flagged, F.count_if("is_metric"))).alias("distribution_health"),
    )
    hinted = profile.pii.select(*by, "column").unionByName(each.select(*by, none.alias("column"))).groupBy(*by).agg(F.count_distinct("column").alias("k"))
    exposed = hinted.select(*by, F.when(F.col("k") == 0, 100.0).otherwise(F.greatest(F.lit(40.0), 100.0 - 15.0 * F.col("k"))).alias("identifier_exposure"))
    repeated = profile.duplicates.select(*by, (100 * (1 - F.least(5 * F.col("duplicate_rows") / F.greatest("row_count", F.lit(1)), F.lit(1.0)))).alias("duplication"))
    parts = None
    for one in (columns, rules, exposed, repeated):
        scores = [F.struct(F.lit(c).alias("component"), F.round(F.col(c).cast("double"), 2).alias("score"), F.lit(WEIGHTS[c]).alias("weight")) for c in one.columns if c not in by]
        rows = one.select(*by, F.inline(F.array(*scores)))
        parts = rows if parts is None else parts.unionByName(rows)
    overall = F.round(F.sum(F.col("score") * F.col("weight")) / F.sum("weight"), 10)
    whole, keys, own = F.col("component").isNull(), [F.col(c) for c in by], [F.col(c) for c in ("component", "score", "weight")]
    out = parts.groupingSets([[*keys, *own], keys], *keys, *own).agg(overall.alias("overall"))
    return out.select(
        *by, F.coalesce("component", F.lit("overall")).alias("component"), F.round(F.when(whole, F.col("overall")).otherwise(F.col("score")), 2).alias("score"),
        F.coalesce("weight", F.lit(1.0)).alias("weight"), F.when(whole, X.grade(F.col("overall"))).alias("grade"))
