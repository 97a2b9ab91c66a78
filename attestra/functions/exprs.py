"""Column expressions shared by the operators; all of them built from Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Unit scales, words without identity in names of places, stop words, judgement words (as patterns), Hindi words and their
# English keywords, unit suffixes of column names, words that make a column's name ambiguous, and the patterns of fiscal-year labels,
# denominators in column names and role markers.
UNIT_SCALES = {"unit": 1.0, "nos": 1.0, "number": 1.0, "count": 1.0, "thousand": 1e3, "lakh": 1e5, "lac": 1e5, "crore": 1e7}
ADMIN_TOKENS = "te town tehsil taluk taluka block district dist dt village gram nagar new old east west north south upper lower".split()
STOPWORDS = "the a an is are was were of in on for to and or what which who whom how why when where does do did any show tell me about give list with by at as be been".split()
JUDGEMENT_WORDS = ["fraud", "fraudulent", "corrupt", "corruption", "guilty", "culprit", "scam", "cheat", "cheated", "cheating", r"embezzl\w*", "fake", "faked", "forgery", r"falsif\w*", r"misappropriat\w+", "is wrong", "are wrong", "committed a crime", "criminal"]
JUDGEMENT_HINDI = ["भ्रष्टाचार", "घोटाला", "धोखाधड़ी", "जालसाज़ी", "दोषी", "अपराधी", "फ़र्ज़ी"]
HINDI_KEYWORDS = {
    "लाभार्थी": "beneficiaries", "लाभार्थियों": "beneficiaries", "जिला": "district", "जिले": "district", "गांव": "village", "गाँव": "village", "राशि": "amount",
    "भुगतान": "payment", "गुणवत्ता": "quality", "समस्या": "issue", "आंकड़े": "data", "आंकड़ों": "data", "तुलना": "compare", "असामान्य": "unusual", "गड़बड़ी": "anomaly",
    "किसान": "farmer", "फसल": "crop", "स्कूल": "school", "विद्यालय": "school", "नामांकन": "enrollment", "पानी": "water", "सिंचाई": "irrigation", "योजना": "scheme",
    "रिपोर्ट": "report", "खोज": "finding", "खोजें": "finding", "विसंगति": "anomaly", "बकाया": "dues", "सब्सिडी": "subsidy", "अनुदान": "subsidy",
}
AMBIGUOUS = ["approx", "estimated", "unaudited", "provisional"]
FISCAL_YEAR = r"(?i)^\s*(?:FY|F\.Y\.?)?\s*(\d{4})\s*[-–—/]\s*(\d{2,4})\s*(?:\(?(?:CA|CE|TE)\)?)?\s*$"
DENOMINATOR, ROLE_MARKER = "_per_([a-z_]+)$", r"(?i)^(system|assistant|user)\s*:"
UNIT_SUFFIXES = {"crore": 1e7, "lakh": 1e5, "lac": 1e5, "thousand": 1e3, "inr": 1.0, "rs": 1.0, "percent": 1.0, "pct": 1.0, "count": 1.0}


def named(column: str) -> Column:
    """A top-level column by its name, whatever dots, spaces or backticks it has."""
    return F.col("`" + column.replace("`", "``") + "`")


def unit_scale(unit: Column) -> Column:
    """Multiplier of a unit name; null for unknown units."""
    table = F.create_map(*[F.lit(x) for kv in UNIT_SCALES.items() for x in kv])
    return F.element_at(table, F.lower(F.trim(unit)))


def to_base(value: Column, unit: Column, strict: bool = False) -> Column:
    """A value in base units; null for an unknown unit, with ``strict`` an error."""
    scale = unit_scale(unit)
    if strict:
        scale = F.coalesce(scale, F.raise_error(F.concat(F.lit("unknown unit: "), F.coalesce(unit, F.lit("null")))).cast("double"))
    return value * scale


def plain(text: Column) -> Column:
    """A label without case and the spaces around it."""
    return F.lower(F.trim(text))


def first_digit(value: Column) -> Column:
    """First significant digit (1..9) of a finite non-zero number, else null."""
    x = F.abs(value.cast("double"))
    ok = value.isNotNull() & ~F.isnan(x) & (x > 0) & (x < F.lit(float("inf")))
    power = F.floor(F.log10(x))
    at = lambda p: F.floor(x / F.pow(F.lit(10.0), p)).cast("int")
    return F.when(ok, F.least(F.when(at(power) < 1, at(power - 1)).otherwise(at(power)), F.lit(9)))


def z_severity(z: Column) -> Column:
    return F.when(F.abs(z) >= 4, "high").when(F.abs(z) >= 3, "medium").otherwise("low")


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 75, "B").when(score >= 60, "C").when(score >= 40, "D").otherwise("F")


def conformity(mad: Column) -> Column:
    return F.when(mad < 0.006, "close").when(mad < 0.012, "acceptable").when(mad < 0.015, "marginal").otherwise("nonconformity")


def entity_name(name: Column) -> Column:
    """A place or entity name without case, punctuation, single letters and administrative words; all its words if none is left."""
    words = F.filter(F.split(F.regexp_replace(F.lower(name), r"[^a-z0-9\s]", " "), r"\s+"), lambda w: w != "")
    kept = F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(ADMIN_TOKENS))
    return F.array_join(F.when(F.size(kept) > 0, kept).otherwise(words), " ")


def word_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Shared words over all words of two texts; 1 when neither has words."""
    x, y = word_set(a), word_set(b)
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def question_tokens(text: Column) -> Column:
    """Distinct words of three letters or more that are not stop words; Hindi keywords in English, whatever their length."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9_]+|[\\u0900-\\u097F]+)"), 1)
    keywords = F.create_map(*[F.lit(x) for kv in HINDI_KEYWORDS.items() for x in kv])
    kept = F.filter(words, lambda w: F.map_contains_key(keywords, w) | ((F.length(w) > 2) & ~w.isin(STOPWORDS)))
    return F.array_distinct(F.transform(kept, lambda w: F.coalesce(F.element_at(keywords, w), w)))


def has_devanagari(text: Column) -> Column:
    return text.rlike("[\\u0900-\\u097F]")


def redact(text: Column, words: list[str] | None = None) -> Column:
    """Judgement words, English and Hindi, replaced by a note. words: other patterns instead."""
    pattern = "\\b(" + "|".join(words or JUDGEMENT_WORDS) + ")\\b" + ("" if words else "|(" + "|".join(JUDGEMENT_HINDI) + ")")
    return F.regexp_replace(text, "(?iu)" + pattern, "[redacted judgment word]")


def sanitize(text: Column) -> Column:
    """White space flattened to single spaces, then a role marker at the start defused."""
    return F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), ROLE_MARKER, "[blocked]:")


def humanize(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=[A-Za-z0-9])_(?=[A-Za-z0-9])", " ")


def fiscal_year(label: Column) -> Column:
    """A fiscal-year label (FY 2024-25, 2024/2025, F.Y. 2024–25 (CE) ...) as struct of resolution_id, start, end, fiscal_year and flags.

    A fiscal year runs from 1 April to 31 March of the next year, whatever end the label states; another end is flagged. Labels of other
    forms, and null, have only the flag not_a_fiscal_year_label.
    """
    first, last = F.regexp_extract(label, FISCAL_YEAR, 1), F.regexp_extract(label, FISCAL_YEAR, 2)
    ok = F.coalesce(first != "", F.lit(False))
    year = F.when(ok, first.try_cast("int"))
    short = F.lpad(((year + 1) % 100).cast("string"), 2, "0")
    flags = F.when(~ok, F.array(F.lit("not_a_fiscal_year_label"))).when(F.right(last, F.lit(2)) != short, F.array(F.lit("fiscal_year"), F.lit("fiscal_year_label_inconsistent"))).otherwise(F.array(F.lit("fiscal_year")))
    unread = F.substring(F.sha1(F.coalesce(label, F.lit(""))), 1, 8)
    return F.struct(
        F.concat(F.lit("tr-fy-"), F.when(ok, year.cast("string")).otherwise(unread)).alias("resolution_id"),
        F.when(ok, F.make_date(year, F.lit(4), F.lit(1))).alias("start"),
        F.when(ok, F.make_date(year + 1, F.lit(3), F.lit(31))).alias("end"),
        F.when(ok, F.concat(year.cast("string"), F.lit("-"), short)).alias("fiscal_year"),
        flags.alias("flags"),
    )


def column_concept(name: Column) -> Column:
    """A column name as struct of base, unit, multiplier and denominator: the part after _per_ and a unit suffix are taken off."""
    low = F.lower(F.trim(name))
    denominator = F.regexp_extract(low, DENOMINATOR, 1)
    base = F.regexp_replace(low, DENOMINATOR, "")
    unit = F.regexp_extract(base, "_(" + "|".join(UNIT_SUFFIXES) + ")$", 1)
    scales = F.create_map(*[F.lit(x) for kv in UNIT_SUFFIXES.items() for x in kv])
    stem = F.regexp_replace(F.when(unit != "", F.substr(base, F.lit(1), F.length(base) - F.length(unit) - 1)).otherwise(base), "_+$", "")
    return F.struct(
        F.when(stem != "", stem).otherwise(low).alias("base"),
        F.when(unit != "", unit).otherwise("count").alias("unit"),
        F.coalesce(F.element_at(scales, unit), F.lit(1.0)).alias("multiplier"),
        F.when(denominator != "", denominator).alias("denominator"),
    )


def definition_key(concept: Column) -> Column:
    """What of a concept its definition goes by: the text before _per_, then its first part."""
    return F.split_part(F.split_part(concept, F.lit("_per_"), F.lit(1)), F.lit("_"), F.lit(1))


def about_equal(a: Column, b: Column, share: float = 0.01) -> Column:
    most = F.greatest(F.abs(a), F.abs(b))
    return (most == 0) | (F.abs(a - b) <= share * most)


def percent_gap(a: Column, b: Column) -> Column:
    """How much larger the larger of two positive totals is, in percent; null if the smaller isn't positive."""
    low, high = F.least(a, b), F.greatest(a, b)
    return F.when(low > 0, (high - low) / low * 100)


def general(value: Column) -> Column:
    """A number with six significant digits and no idle zeros; in powers of ten below a ten-thousandth and from a million on."""
    x = value.cast("double")
    first = F.floor(F.log10(F.abs(x))).cast("int")
    power = F.when(F.round(F.abs(x) / F.pow(F.lit(10.0), first), 5) >= 10, first + 1).otherwise(first)
    strip = lambda text: F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    digits = F.format_string("%.5f", x / F.pow(F.lit(10.0), power))
    scientific = F.concat(strip(digits), F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
    plain = F.lit(None).cast("string")
    for p in range(-4, 6):
        plain = F.when(power == p, F.format_string(f"%.{5 - p}f", x)).otherwise(plain)
    return F.when(x == 0, "0").when(power.between(-4, 5), strip(plain)).otherwise(scientific)


def cited(answer: Column) -> Column:
    """Whether an answer cites any evidence."""
    return F.coalesce(answer.rlike(r"\[E[0-9]+\]"), F.lit(False))


def short_hash(*parts: Column, size: int = 12) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, size)
