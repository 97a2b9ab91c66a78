"""First-digit screening: shares of leading digits against Benford's law."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from attestra.functions import exprs as X

LEAST_VALUES, LEAST_MAGNITUDES = 50, 2.0


def digit_table(values: DataFrame) -> DataFrame:
    """values: (column, value). For each column and digit 1..9: count, observed and expected share, excess. Columns out of scope are left out:
    fewer than LEAST_VALUES usable values, or less than LEAST_MAGNITUDES orders of magnitude."""
    usable = values.select("column", F.col("value").cast("double").alias("value"), X.first_digit(F.col("value")).alias("digit")).filter("digit IS NOT NULL")
    counts = usable.groupBy("column").agg(
        F.count(F.lit(1)).alias("n"),
        (F.max(F.log10(F.abs("value"))) - F.min(F.log10(F.abs("value")))).alias("span"),
        *[F.count_if(F.col("digit") == d).alias(f"d{d}") for d in range(1, 10)],
    ).filter((F.col("n") >= LEAST_VALUES) & (F.col("span") >= LEAST_MAGNITUDES))
    rows = counts.select("column", "n", F.inline(F.array(*[F.struct(F.lit(d).alias("digit"), F.col(f"d{d}").alias("count")) for d in range(1, 10)])))
    observed, expected = F.col("count") / F.col("n"), F.log10(1 + 1 / F.col("digit"))
    return rows.select("column", "n", "digit", "count", observed.alias("observed_share"), expected.alias("expected_share"), (observed - expected).alias("excess"))


def conformity_table(digits: DataFrame) -> DataFrame:
    """Per column: mean absolute deviation, verdict, severity (null if nothing to report), and the three most deviating digits."""
    out = digits.groupBy("column", "n").agg(
        F.round(F.avg(F.abs("excess")), 5).alias("mad"),
        F.slice(F.array_sort(F.collect_list(F.struct((-F.abs("excess")).alias("k"), "digit"))), 1, 3).alias("top"),
    )
    verdict = X.conformity(F.col("mad"))
    severity = F.when(verdict == "marginal", "medium").when(verdict == "nonconformity", "high")
    return out.select("column", F.col("n").alias("n_values"), "mad", verdict.alias("conformity"), severity.alias("severity"), F.array_join(F.transform("top", lambda t: t["digit"].cast("string")), ",").alias("top_digits"))


def evidence_rows(values: DataFrame, digits: DataFrame) -> DataFrame:
    """Rows of values whose first digit is the one with the largest signed excess in its column."""
    worst = digits.groupBy("column").agg(F.max_by("digit", F.struct("excess", -F.col("digit"))).alias("worst"))
    return values.join(F.broadcast(worst), "column").filter(X.first_digit(F.col("value")) == F.col("worst"))
