"""How alike two normalized names are, as expressions of Spark SQL (as text, which is built and parsed at once whatever its size)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Letters whose places fit one number of 64 bits, sums included.
BITS = 60


def bound(values: dict[str, str], use: str, name: str) -> str:
    """``use``, an expression of the fields of ``name``, with each value computed once however often it is used."""
    fields = ", ".join(f"'{k}', {v}" for k, v in values.items())
    return f"transform(array(named_struct({fields})), {name} -> {use})[0]"


def letters(text: str) -> str:
    return f"filter(split({text}, ''), c -> c <> '')"


def in_bits(a: str, b: str) -> str:
    """The common subsequence's length, ``a`` of at most BITS letters: a bit for each letter of a, and all of them move on at once for each letter of b."""
    mask = "aggregate(l.own, named_struct('mask', 0L, 'bit', 1L), (s, x) -> named_struct('mask', if(x = k, s.mask | s.bit, s.mask), 'bit', s.bit * 2L), s -> s.mask)"
    table = bound({"own": letters(a)}, f"map_from_entries(transform(array_distinct(l.own), k -> struct(k, {mask})))", "l")
    move = "coalesce(((s + (s & try_element_at(m.places, y))) | (s - (s & try_element_at(m.places, y)))) & m.whole, s)"
    return bound({"places": table, "whole": f"CAST(pow(2.0D, length({a})) AS bigint) - 1L", "b": letters(b)}, f"length({a}) - bit_count(aggregate(m.b, m.whole, (s, y) -> {move}))", "m")


def in_rows(a: str, b: str) -> str:
    """The same for names of any length, row by row of the table of both."""
    cell = "if(element_at(l.own, i) = y, element_at(before, i) + 1, greatest(element_at(r, -1), element_at(before, i + 1)))"
    row = f"aggregate(sequence(1, size(l.own)), array(0), (r, i) -> concat(r, array({cell})))"
    return bound({"own": letters(a)}, f"element_at(aggregate({letters(b)}, array_repeat(0, size(l.own) + 1), (before, y) -> {row}), -1)", "l")


def common(a: str, b: str) -> str:
    return bound({"a": a, "b": b}, f"""CASE WHEN p.a = '' OR p.b = '' THEN 0 WHEN p.a = p.b THEN length(p.a) WHEN length(p.a) <= {BITS} THEN {in_bits("p.a", "p.b")}
      WHEN length(p.b) <= {BITS} THEN {in_bits("p.b", "p.a")} ELSE {in_rows("p.a", "p.b")} END""", "p")


def ratio(a: str, b: str) -> str:
    return f"if(length({a}) + length({b}) = 0, 100.0D, 200.0D * {common(a, b)} / greatest(length({a}) + length({b}), 1))"


def by_words(both: str, only_a: str, only_b: str) -> str:
    """The score of two sets of words, each joined in order: what they share and what either has alone. All of one in the other is the whole score."""
    n = f"length({both}) + if({both} = '', 0, 1)"
    sizes = {"a": f"{n} + length({only_a})", "b": f"{n} + length({only_b})"}
    apart = f"100.0D * (1.0D - (length({only_a}) + length({only_b}) - 2 * {common(only_a, only_b)}) / greatest(z.a + z.b, 1))"
    shared = f"if({both} = '', 0.0D, greatest(200.0D * length({both}) / (length({both}) + z.a), 200.0D * length({both}) / (length({both}) + z.b)))"
    return bound(sizes, f"CASE WHEN z.a * z.b = 0 THEN 0.0D WHEN {both} <> '' AND ({only_a} = '' OR {only_b} = '') THEN 100.0D ELSE greatest({apart}, {shared}) END", "z")


def common_subsequence(a: str, b: str) -> Column:
    """Length of the longest common subsequence of two columns."""
    return F.expr(common(a, b))


def name_similarity(a: str, b: str) -> Column:
    """The largest of three scores of two columns of normalized names: letters in order, words as sets, letters without spaces."""
    words = lambda c: f"array_distinct(filter(split({c}, ' '), w -> w <> ''))"
    joined = lambda f, x, y: f"array_join(array_sort({f}(v.{x}, v.{y})), ' ')"
    parts = {"both": joined("array_intersect", "x", "y"), "a": joined("array_except", "x", "y"), "b": joined("array_except", "y", "x")}
    sets = bound({"x": words(a), "y": words(b)}, bound(parts, by_words("q.both", "q.a", "q.b"), "q"), "v")
    names = {"a": a, "b": b, "wa": f"replace({a}, ' ', '')", "wb": f"replace({b}, ' ', '')", "sets": sets}
    return F.expr(bound(names, f"if(n.sets = 100, 100.0D, greatest({ratio('n.a', 'n.b')}, {ratio('n.wa', 'n.wb')}, n.sets))", "n"))
