"""Comparing tables: key overlap, fuzzy entity matching, comparability gates, contradictions, definition drift, shared origins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from attestra.functions import exprs as X
from attestra.functions.names import name_similarity
from attestra.session import materialize

THRESHOLD = 88.0
#: The score down to which names look for a partner by longer grams before all others, and grams' lengths there and below.
NEAR, LONG, SHORT = 98.0, 3, 2
#: From this share of common words on, two definitions say the same in other words.
REWORDED = 0.8


def key_overlap(left: DataFrame, right: DataFrame, left_col: str, right_col: str) -> DataFrame:
    """One row: how many distinct non-null keys two columns share, have alone, and have together; comparable, partial or not_comparable."""
    a = left.select(F.col(left_col).cast("string").alias("k")).filter("k IS NOT NULL").distinct().withColumn("l", F.lit(1))
    b = right.select(F.col(right_col).cast("string").alias("k")).filter("k IS NOT NULL").distinct().withColumn("r", F.lit(1))
    counts = a.join(b, "k", "full").agg(
        F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("shared"),
        F.count_if(F.col("r").isNull()).alias("left_only"),
        F.count_if(F.col("l").isNull()).alias("right_only"),
        F.count(F.lit(1)).alias("total"),
    )
    return counts.withColumn("state", F.when(F.col("total") == 0, "unknown").when(F.col("shared") == F.col("total"), "comparable").when(F.col("shared") > 0, "partial").otherwise("not_comparable"))


def grams_of(names: DataFrame, size: int) -> DataFrame:
    """names: pair, norm. (pair, norm, family, gram) of the strings of ``size`` letters, word ends included, of the words, of the different words if any
    repeats, and of the name without spaces as one word."""
    words = F.split("norm", " ")
    forms = F.array(
        F.struct(F.lit("words").alias("family"), words.alias("w"), F.lit(0).alias("form")),
        F.when(F.size(F.array_distinct(words)) < F.size(words), F.struct(F.lit("words").alias("family"), F.array_distinct(words).alias("w"), F.lit(1).alias("form"))),
        F.struct(F.lit("whole").alias("family"), F.array(F.replace("norm", F.lit(" "), F.lit(""))).alias("w"), F.lit(2).alias("form")),
    )
    grams = F.flatten(F.transform("w", lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + size - 1), lambda i: F.substr(F.concat(F.lit("^" * (size - 1)), w, F.lit("$" * (size - 1))), i, F.lit(size)))))
    return names.select("pair", "norm", F.inline(F.filter(forms, lambda f: f.isNotNull()))).select("pair", "norm", "family", "form", F.explode(grams).alias("gram"))


def rarest_grams(grams: DataFrame, counts: DataFrame, share: float, size: int) -> DataFrame:
    """(pair, norm, key): of each name as many of its rarest grams as two names within the allowed edits can't all differ in.

    An edit (a letter in or out) changes ``size`` grams at most, so names that are ``share`` of their joint length apart agree in one of these.
    """
    edits = F.floor(share * (1 + (1 + share) / (1 - share)) * F.length("norm")).cast("int")
    order = Window.partitionBy("pair", "norm", "form").orderBy("n", "gram")
    rows = grams.join(counts, ["pair", "family", "gram"]).withColumn("k", F.row_number().over(order)).filter(F.col("k") <= size * edits + 1)
    return rows.select("pair", "norm", F.concat_ws(":", "family", "gram").alias("key")).distinct()


def covering_words(words: DataFrame, share: float) -> DataFrame:
    """words: (pair, norm, word, n), n names having it. (pair, norm, word): the rarest words of a name, until the rest is too short to be what it
    shares with a name that scores by common words."""
    order = Window.partitionBy("pair", "norm").orderBy("n", "word")
    left_out = F.coalesce(F.sum(F.length("word") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return words.withColumn("left_out", left_out).filter(F.col("left_out") <= share * (F.length("norm") + 1)).select("pair", "norm", "word")


def equal_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(pair, la, rb) of names that score 100: equal without spaces, or all words of one in the other, which then has its rarest word."""
    sides = [df.select("pair", F.col("norm").alias(name), F.replace("norm", F.lit(" "), F.lit("")).alias("whole")) for df, name in ((a, "la"), (b, "rb"))]
    whole = sides[0].join(sides[1], ["pair", "whole"]).select("pair", "la", "rb")
    words = [df.select("pair", "norm", F.explode(F.array_distinct(F.split("norm", " "))).alias("word")) for df in (a, b)]
    common = words[0].unionByName(words[1]).groupBy("pair", "word").agg(F.count(F.lit(1)).alias("n"))
    words = [w.filter("word <> ''").join(common, ["pair", "word"]) for w in words]
    named = lambda df, name: df.select("pair", "word", F.col("norm").alias(name))
    rare = [w.groupBy("pair", "norm").agg(F.min(F.struct("n", "word"))["word"].alias("word")) for w in words]
    both = named(rare[0], "la").join(named(words[1], "rb"), ["pair", "word"]).unionByName(named(words[0], "la").join(named(rare[1], "rb"), ["pair", "word"]))
    less = lambda x, y: F.size(F.array_except(F.split(x, " "), F.split(y, " "))) == 0
    return whole.unionByName(both.filter(less("la", "rb") | less("rb", "la")).select("pair", "la", "rb")).distinct()


def candidate_pairs(a: DataFrame, b: DataFrame, threshold: float, size: int = SHORT) -> DataFrame:
    """a, b: pair, norm, each different. (pair, la, rb) that can score ``threshold`` or more; all others of a pair score less.

    Letters in order: names agree in one of their rarest grams. Common words: the name that they make up has one of its rarest words
    in common with the other, whose words all count. Frequent words and grams are keys only for names that have no rarer ones.
    """
    share = 1 - threshold / 100
    sides = [(a, "la"), (b, "rb")]
    grams = [grams_of(df, size) for df, _ in sides]
    counts = grams[0].unionByName(grams[1]).groupBy("pair", "family", "gram").agg(F.count(F.lit(1)).alias("n"))
    keys = [rarest_grams(g, counts, share, size).withColumnRenamed("norm", name) for (_, name), g in zip(sides, grams)]
    lengths = [lambda c: F.length(c), lambda c: F.length(F.replace(c, F.lit(" "), F.lit(""))), lambda c: F.length(F.array_join(F.array_distinct(F.split(c, " ")), " "))]
    near = F.lit(False)
    for n in lengths:
        x, y = n(F.col("la")), n(F.col("rb"))
        near = near | (F.least(x, y) >= F.greatest(x, y) * (1 - share) / (1 + share) - 1e-9)
    by_letters = keys[0].join(keys[1], ["pair", "key"]).filter(near).select("pair", "la", "rb").distinct()
    # What passes is held against all grams: of a name's different ones ``size`` for each edit at most can be missing in the other.
    for (df, name), g in zip(sides, grams):
        sets = g.groupBy("pair", "norm").agg(*[F.collect_set(F.when(F.col("family") == f, F.col("gram"))).alias(f"{name}_{f}") for f in ("words", "whole")])
        by_letters = by_letters.join(sets.withColumnRenamed("norm", name), ["pair", name])
    edits = F.floor(share * (F.length("la") + F.length("rb")))
    missing = lambda f: F.greatest(*[F.size(F.array_except(f"{x}_{f}", f"{y}_{f}")) for x, y in (("la", "rb"), ("rb", "la"))])
    by_letters = by_letters.filter((missing("words") <= size * edits) | (missing("whole") <= size * edits)).select("pair", "la", "rb")
    words = [df.select("pair", "norm", F.explode(F.array_distinct(F.split("norm", " "))).alias("word")) for df, _ in sides]
    common = words[0].unionByName(words[1]).groupBy("pair", "word").agg(F.count(F.lit(1)).alias("n"))
    words = [w.join(common, ["pair", "word"]) for w in words]
    uncovered = 2 * share / (1 + share)  # what a name may have beside the common words
    rare = [covering_words(w, uncovered) for w in words]
    named = lambda df, name: df.select("pair", "word", F.col("norm").alias(name))
    by_words = named(rare[0], "la").join(named(words[1], "rb"), ["pair", "word"]).unionByName(named(words[0], "la").join(named(rare[1], "rb"), ["pair", "word"]))
    return by_letters.unionByName(by_words.select("pair", "la", "rb")).distinct()


def match_names(left: DataFrame, right: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """left: pair, left_name; right: pair, right_name. Within each pair, for each distinct left name the right name of the highest score at or above
    the threshold, the smallest of equals.

    Names that normalize alike are matched once. Names look for partners of the highest scores first, and only those that have found none go on to the
    next step: equal names by joins on what is equal, near ones by grams of three letters, the rest by letter pairs. So few candidates are scored where most names have a close partner. Whatever can reach a
    step's score is scored in that step (``candidate_pairs``), so the best is never missed.
    """
    norm = lambda df, c: df.filter(F.col(c).isNotNull()).distinct().withColumn("norm", X.entity_name(F.col(c)))
    a, b = materialize(norm(left, "left_name"), "left"), materialize(norm(right, "right_name"), "right")
    firsts = b.groupBy("pair", F.col("norm").alias("rb")).agg(F.min("right_name").alias("right_name"))
    open_names, others, found = a.select("pair", "norm").distinct(), b.select("pair", "norm").distinct(), None
    for step, size in ((100.0, 0), (NEAR, LONG), (threshold, SHORT)):
        if step < threshold:
            continue
        pairs = candidate_pairs(open_names, others, step, size) if size else equal_pairs(open_names, others)
        pairs = pairs.withColumn("score", name_similarity("la", "rb")).filter(F.col("score") >= step - 1e-9)
        best = pairs.join(firsts, ["pair", "rb"]).groupBy("pair", F.col("la").alias("norm")).agg(F.min(F.struct((-F.col("score")).alias("s"), "right_name")).alias("best"))
        best = materialize(best, "matched")
        found = best if found is None else found.unionByName(best)
        open_names = materialize(open_names.join(best, ["pair", "norm"], "left_anti"), "open")
        if open_names.isEmpty():
            break
    return a.join(found, ["pair", "norm"]).select("pair", "left_name", F.col("best.right_name").alias("right_name"), (-F.col("best.s")).alias("score"))


def match_entities(left: DataFrame, right: DataFrame, left_col: str, right_col: str, threshold: float = THRESHOLD) -> DataFrame:
    """``match_names`` of two columns: left_name, right_name, score."""
    side = lambda df, c, out: df.select(F.lit(0).alias("pair"), X.named(c).cast("string").alias(out))
    return match_names(side(left, left_col, "left_name"), side(right, right_col, "right_name"), threshold).drop("pair")


def fuzzy_gates(left: DataFrame, right: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """left: pair, left_name; right: pair, right_name. One row for each pair: matched pairs of names, names left without a match on either side,
    the gate's state and the spelling variants among the first three matches.

    Names are trimmed and blank ones left out; a side without names gives the state unknown. All pairs are matched in the same jobs.
    """
    names = lambda df, c: df.select("pair", F.trim(F.col(c).cast("string")).alias(c)).filter(F.col(c) != "").distinct()
    l, r = names(left, "left_name"), names(right, "right_name")  # noqa: E741
    matches = materialize(match_names(l, r, threshold), "matches")
    side = lambda df, s: df.select("pair", F.lit(s).alias("side"))
    lost = [x.join(matches.select("pair", c), ["pair", c], "left_anti") for x, c in ((l, "left_name"), (r, "right_name"))]
    every = left.select("pair").unionByName(right.select("pair")).distinct()
    rows = side(matches, "m").unionByName(side(l, "a")).unionByName(side(r, "b")).unionByName(side(lost[0], "l")).unionByName(side(lost[1], "r")).unionByName(side(every, "p"))
    count = lambda s, out: F.count_if(F.col("side") == s).alias(out)
    out = rows.groupBy("pair").agg(count("m", "matched"), count("l", "left_only"), count("r", "right_only"), count("a", "n_left"), count("b", "n_right"))
    first = Window.partitionBy("pair").orderBy("left_name", "right_name")
    few = matches.withColumn("rank", F.row_number().over(first)).filter("rank <= 3")
    variant = F.when(F.col("left_name") != F.col("right_name"), F.concat_ws(" ~ ", "left_name", "right_name"))
    variants = few.groupBy("pair").agg(F.array_join(F.array_sort(F.collect_list(variant)), "; ").alias("variants"))
    state = F.when((F.col("n_left") == 0) | (F.col("n_right") == 0), "unknown").when(F.col("matched") == 0, "not_comparable").when((F.col("left_only") == 0) & (F.col("right_only") == 0), "comparable").otherwise("partial")
    return out.join(variants, "pair", "left").select("pair", "matched", "left_only", "right_only", F.coalesce("variants", F.lit("")).alias("variants"), state.alias("state"))


def fuzzy_gate(left: DataFrame, right: DataFrame, left_col: str, right_col: str, threshold: float = THRESHOLD) -> DataFrame:
    """``fuzzy_gates`` of two columns: one row, also where both are empty."""
    side = lambda df, c, out: df.select(F.lit(0).alias("pair"), X.named(c).cast("string").alias(out))
    l, r = side(left, left_col, "left_name"), side(right, right_col, "right_name")  # noqa: E741
    nobody = left.sparkSession.createDataFrame([(0, None)], "pair int, left_name string")
    return fuzzy_gates(l.unionByName(nobody), r, threshold).drop("pair")


def period_gate(a: Column, b: Column) -> Column:
    """Fiscal years: equal ones are comparable, different ones not; one missing is partial, both are unknown."""
    return F.when(a.isNull() & b.isNull(), "unknown").when(a.isNull() | b.isNull(), "partial").when(a == b, "comparable").otherwise("not_comparable")


def unit_gate(a: Column, b: Column, scale_a: Column | None = None, scale_b: Column | None = None) -> Column:
    """Units, case aside: equal ones of equal scale are comparable, of different scale partial; different ones not; a missing one is unknown."""
    x, y = (F.lit(1.0) if s is None else F.coalesce(s, F.lit(1.0)) for s in (scale_a, scale_b))
    same = F.lower(a) == F.lower(b)
    return F.when(a.isNull() | b.isNull(), "unknown").when(same & (x == y), "comparable").when(same, "partial").otherwise("not_comparable")


def definition_gate(a: Column, b: Column) -> Column:
    """Definitions, case aside: equal ones are comparable, reworded ones partial, others not; a missing one is unknown."""
    return F.when(a.isNull() | b.isNull(), "unknown").when(F.lower(a) == F.lower(b), "comparable").when(X.jaccard(a, b) >= REWORDED, "partial").otherwise("not_comparable")


def overall_gate(*gates: Column) -> Column:
    """The worst gate; unknown does not block."""
    worst = lambda s: F.array_contains(F.array(*gates), s)
    return F.when(worst("not_comparable"), "not_comparable").when(worst("partial"), "partial").otherwise("comparable")


def reconcile(pairs: DataFrame, a: str, b: str, overall: str) -> DataFrame:
    """pairs with the verdict on two totals: only comparable ones are held against each other; within a percent is explainable."""
    x, y = F.col(a), F.col(b)
    comparable = F.col(overall) == "comparable"
    status = F.when(~comparable, "not_comparable").when(X.about_equal(x, y), "explainable").otherwise("conflict")
    delta = F.when(F.col("status") == "conflict", F.round((y - x) / F.greatest(F.abs(x), F.abs(y)), 4)).when(F.col("status") == "explainable", F.round(F.abs(x - y), 4))
    return pairs.withColumn("status", status).withColumn("delta", delta).withColumn("percent_gap", F.round(X.percent_gap(x, y), 4))


def unit_base(unit: Column) -> Column:
    """INR or count by a unit's label; null if it says neither."""
    low = X.plain(unit)
    money = low.contains("inr") | low.contains("rupee") | low.contains("rs") | low.contains("₹")
    return F.when(money, "INR").when(X.unit_scale(unit).isNotNull(), "count")


def definition_drift(before: DataFrame, after: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Cards (card_id, concept_id, definition, scope, denominator, unit) of two releases paired by concept: one row for each dimension that
    changed, with decision, impact and severity. Of several cards of a concept before, the last by card_id counts; equal cards are skipped.

    Texts are compared without case and the spaces around them. Units of known scales are compared by scale; only two known bases can make
    units not comparable. by: further columns that both tables pair by, such as an id of the pair of tables.
    """
    keys = [*(by or []), "concept_id"]
    last = Window.partitionBy(*keys).orderBy(F.desc("card_id"))
    old = before.withColumn("k", F.row_number().over(last)).filter("k = 1")
    old = old.select(*keys, *[F.col(c).alias(f"b_{c}") for c in ("card_id", "definition", "scope", "denominator", "unit")])
    pairs = after.join(old, keys).filter("card_id <> b_card_id")
    verdict = lambda kind, decision, impact: F.struct(F.lit(kind).alias("drift_type"), F.lit(decision).alias("decision"), F.lit(impact).alias("impact"))

    def change(kind: str, one_sided: float, changed: Column) -> Column:
        b, a = F.col(f"b_{kind}"), F.col(kind)
        side = F.when(b.isNotNull() | a.isNotNull(), verdict(kind, "partial", one_sided))
        return F.when(b.isNull() | a.isNull(), side).when(X.plain(b) != X.plain(a), changed)

    b_scale, a_scale = X.unit_scale(F.col("b_unit")), X.unit_scale(F.col("unit"))
    unit = F.when(b_scale != a_scale, verdict("unit", "partial", 0.55)).when(b_scale == a_scale, None)
    unit = unit.when(unit_base(F.col("b_unit")) != unit_base(F.col("unit")), verdict("unit", "not_comparable", 0.9)).otherwise(verdict("unit", "partial", 0.5))
    text = F.when(X.jaccard(F.col("b_definition"), F.col("definition")) >= REWORDED, verdict("definition", "partial", 0.3)).otherwise(verdict("definition", "not_comparable", 0.7))
    drifts = F.array(
        change("denominator", 0.3, verdict("denominator", "not_comparable", 0.9)),
        change("unit", 0.2, unit),
        F.when(X.plain(F.coalesce("b_definition", F.lit(""))) != X.plain(F.coalesce("definition", F.lit(""))), text),
        change("scope", 0.2, verdict("scope", "partial", 0.4)),
    )
    rows = pairs.select(*keys, F.col("b_card_id").alias("before_card"), F.col("card_id").alias("after_card"), F.inline(F.filter(drifts, lambda d: d.isNotNull())))
    return rows.withColumn("severity", F.when(F.col("decision") == "not_comparable", "high").when(F.col("impact") >= 0.5, "medium").otherwise("low"))


def infer_cards(columns: DataFrame) -> DataFrame:
    """columns: (artifact_id, column, is_metric, null_ratio) of profiles. A definition card for each metric column, read out of its name:
    concept, unit, denominator and what is ambiguous; all of them are proposals."""
    low = F.lower(F.col("column"))
    rows = columns.filter("is_metric").dropDuplicates(["artifact_id", "column"]).withColumn("x", X.column_concept(F.col("column")))
    denominator = F.regexp_extract(low, X.DENOMINATOR, 1)
    denominator = F.when(denominator != "", F.replace(denominator, F.lit("_"), F.lit(" ")))
    flags = F.array(*[F.when(low.contains(t), f"name_contains_{t}") for t in X.AMBIGUOUS], F.when(F.col("null_ratio") > 0.5, "majority_null"))
    place = F.concat_ws(":", "artifact_id", "column")
    said = F.concat(F.col("column"), F.lit(" as reported in this artifact; inferred unit '"), F.col("x.unit"), F.lit("'"), F.coalesce(F.concat(F.lit("; rate per "), denominator), F.lit("")))
    return rows.select(
        "artifact_id", "column", F.concat(F.lit("dc:"), place).alias("card_id"), F.col("x.base").alias("concept_id"), said.alias("definition"),
        F.concat(F.lit("column '"), F.col("column"), F.lit("'")).alias("scope"), denominator.alias("denominator"), F.col("x.unit").alias("unit"),
        F.concat_ws("#column=", "artifact_id", "column").alias("span"), F.array_join(F.filter(flags, lambda f: f.isNotNull()), ",").alias("flags"), F.lit("proposed").alias("status"))


def compare_pairs(pairs: DataFrame, totals: DataFrame, keys: DataFrame, releases: DataFrame, fuzzy: bool = False) -> DataFrame:
    """pairs (pair_id, artifact_a, column_a, artifact_b, column_b), each with totals, the four gates, the verdict and its severity, in one job.

    totals: (artifact_id, column, n, total); a column that is not there, or has no value, is an error and named in ``error``. keys: (artifact_id,
    key), the names of each artifact's places; they are counted, never gathered. releases: (artifact_id, fiscal_year). fuzzy: places are
    held against each other by ``fuzzy_gates``, all pairs at once, in place of equal keys.
    """
    rows = pairs
    for x in "ab":
        own = totals.select(F.col("artifact_id").alias(f"artifact_{x}"), F.col("column").alias(f"column_{x}"), F.col("n").alias(f"n_{x}"), F.col("total").alias(f"total_{x}"))
        year = releases.select(F.col("artifact_id").alias(f"artifact_{x}"), F.nullif(F.trim("fiscal_year"), F.lit("")).alias(f"year_{x}"))
        rows = rows.join(own, [f"artifact_{x}", f"column_{x}"], "left").join(year, f"artifact_{x}", "left")
    held = None
    for x in "ab":
        own = keys.distinct().withColumnRenamed("artifact_id", f"artifact_{x}")
        side = pairs.select("pair_id", f"artifact_{x}").join(own, f"artifact_{x}").select("pair_id", "key", F.lit(x == "a").alias("a"), F.lit(x == "b").alias("b"))
        held = side if held is None else held.unionByName(side)
    held = held.groupBy("pair_id", "key").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    held = held.groupBy("pair_id").agg(F.count_if("a").alias("keys_a"), F.count_if("b").alias("keys_b"), F.count_if(F.col("a") & F.col("b")).alias("keys_both"))
    rows = rows.join(held, "pair_id", "left").fillna(0, ["keys_a", "keys_b", "keys_both"])
    both = F.col("keys_both")
    geography = F.when((F.col("keys_a") == 0) | (F.col("keys_b") == 0), "unknown").when(both == 0, "not_comparable").when((both == F.col("keys_a")) & (both == F.col("keys_b")), "comparable").otherwise("partial")
    if fuzzy:
        places = [pairs.select(F.col("pair_id").alias("pair"), F.col(f"artifact_{x}").alias("artifact_id")).join(keys, "artifact_id").select("pair", F.col("key").alias(name)) for x, name in (("a", "left_name"), ("b", "right_name"))]
        gates_of = fuzzy_gates(*places).select(F.col("pair").alias("pair_id"), F.col("state").alias("_geography"))
        rows = rows.join(gates_of, "pair_id", "left")
        geography = F.coalesce("_geography", F.lit("unknown"))
    concept = [X.column_concept(F.col(f"column_{x}")) for x in "ab"]
    unit, base = [c["unit"] for c in concept], [X.definition_key(c["base"]) for c in concept]
    gates = {"geography": geography, "period": period_gate(F.col("year_a"), F.col("year_b")), "unit": unit_gate(*unit, *map(X.unit_scale, unit)), "definition": definition_gate(*base)}
    rows = rows.withColumns(gates)
    rows = reconcile(rows.withColumn("overall", overall_gate(*map(F.col, gates))), "total_a", "total_b", "overall")
    wrong = lambda x: F.when(F.col(f"n_{x}").isNull(), F.concat(F.lit("column_not_found:"), F.col(f"column_{x}"))).when(F.col(f"n_{x}") == 0, F.concat(F.lit("empty_column:"), F.col(f"column_{x}")))
    rows = rows.withColumn("error", F.coalesce(wrong("a"), wrong("b"))).withColumn("severity", F.when(F.col("status") == "conflict", "medium").otherwise("info"))
    for c in ("status", "delta", "percent_gap", "severity"):
        rows = rows.withColumn(c, F.when(F.col("error").isNull(), F.col(c)))
    return rows.select("pair_id", "total_a", "total_b", *gates, "overall", "status", "delta", "severity", "error")


def column_totals(values: DataFrame) -> DataFrame:
    """values: (artifact_id, column, value as text or number). (artifact_id, column, n, total): numbers are summed, what is no number is left out."""
    number = F.col("value").try_cast("double")
    return values.groupBy("artifact_id", "column").agg(F.count("value").alias("n"), F.sum(number).alias("total"))


def overall_decision(drifts: DataFrame) -> DataFrame:
    """The worst decision of each concept."""
    rank = F.when(F.col("decision") == "not_comparable", 2).when(F.col("decision") == "partial", 1).otherwise(0)
    return drifts.groupBy("concept_id").agg(F.max(rank).alias("r")).select("concept_id", F.when(F.col("r") == 2, "not_comparable").when(F.col("r") == 1, "partial").otherwise("comparable").alias("decision"))


def origin_of(derived: str = "derived_from", artifact: str = "artifact_id") -> Column:
    """What a claim was copied from, if that is known and not blank, else the artifact it was read in."""
    return F.coalesce(F.nullif(F.col(derived), F.lit("")), F.col(artifact))


def origin_groups(claims: DataFrame) -> DataFrame:
    """(metric, origin, claim_id): which claims stand on which origin, a row a claim; a group is never gathered."""
    return claims.select("metric", origin_of().alias("origin"), "claim_id")


def false_consensus(claims: DataFrame) -> DataFrame:
    """claims (metric, claim_id, artifact_id, derived_from): how many origins stand behind the apparent sources of each metric.

    Origins are counted from groups (metric, origin), so a metric with very many claims is pre-aggregated before it meets in one row. Metrics
    of a single claim have nothing to compare and no row.
    """
    origins = claims.groupBy("metric", origin_of().alias("origin")).agg(F.count(F.lit(1)).alias("members"))
    out = origins.groupBy("metric").agg(F.sum("members").alias("apparent_sources"), F.count(F.lit(1)).alias("distinct_origins"), F.max("members").alias("largest_group")).filter("apparent_sources >= 2")
    r = F.col("distinct_origins") / F.col("apparent_sources")
    alone = r >= 0.999
    severity = F.when(alone, "info").when(r <= 0.6, F.when(F.col("apparent_sources") <= 3, "medium").otherwise("high")).otherwise("low")
    verdict, confidence = F.when(alone, "independent_corroboration").otherwise("shared_origin_suspected"), F.when(alone, "high").otherwise("moderate")
    return out.select("metric", "apparent_sources", "distinct_origins", "largest_group", F.round(r, 4).alias("diversity_ratio"), verdict.alias("verdict"), severity.alias("severity"), confidence.alias("confidence"))


def consensus_ids(claims: DataFrame) -> DataFrame:
    """(metric, consensus_id): an id over a metric's claims that does not depend on their order: hashes of the sorted claim ids in 4,096 buckets,
    then one over the buckets, so that no metric's claims meet in one row. A claim that is there twice counts twice."""
    joined = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), "|"), 256)
    counted = claims.groupBy("metric", F.col("claim_id").cast("string").alias("claim_id")).agg(F.count(F.lit(1)).alias("n"))
    parts = counted.groupBy("metric", F.substring(F.md5("claim_id"), 1, 3).alias("bucket")).agg(joined(F.concat_ws(":", "claim_id", F.col("n").cast("string"))).alias("h"))
    return parts.groupBy("metric").agg(F.concat(F.lit("cons-"), F.substring(joined("h"), 1, 12)).alias("consensus_id"))
