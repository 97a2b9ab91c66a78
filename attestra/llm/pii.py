"""Personal data by weak supervision: regex, gazetteer and context labelers vote on candidate spans, expectation-maximisation estimates how
reliable each is, and the posterior labels train a final span classifier.

Spans of the base patterns always stand. The method adds spans that the patterns miss: numbers written like phone or card numbers without
passing the base rules, spelled-out addresses ("name [at] host [dot] org"), names after a title, and secrets (keys and tokens: long mixed
strings, or what is assigned to a name such as password). No labeler knows whether a span is a base span. A candidate is added only
if a list or the context speaks for it, and votes and classifier are sure (``ADD_FROM``); estimation cannot turn the sign of a labeler's votes. Votes are counted over all documents; the counts by kind and pattern of votes are a bounded table.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from attestra.llm.batches import bounded
from attestra.llm.weak_labels import LabelModel, Rows, fit_linear, hashed_sample, sigmoid
from attestra.session import materialize

KINDS = ("email", "ip", "card", "phone")
ADDED = ("name", "secret")
SIZE, SAMPLE, ADD_FROM = 1024, 20_000, 0.9

LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

NUMBER = re.compile(r"(?<![\w+.-])\(?[0-9][\x20().0-9-]{5,}[0-9](?![\w])")
SPELLED = re.compile(r"(?<!\S)([A-Za-z0-9._%+-]+) ?[\[(]at[\])] ?([A-Za-z0-9-]+) ?[\[(]dot[\])] ?([A-Za-z]{2,})\b", re.I)
LONG = re.compile(r"(?<![\w+/=-])[A-Za-z0-9_+/-]{20,}=*(?![\w+/=-])")
ASSIGNED = re.compile(r"(?<![^\W_])(?:password|passwd|pwd|secret|token|api[_-]?key)[\"']?[ \t]*[=:][ \t]*[\"']?([^\s\"']{3,}[^\s\"',.;:!?)])", re.I)
WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")
#: Titles before a name, frequent given names, and words that speak for or against a kind when they stand before a span.
TITLES = "Mr Mrs Ms Dr Prof Herr Frau Monsieur Madame Señor Señora"
TITLED = re.compile(rf"\b(?:{TITLES.replace(' ', '|')})\.? ([A-ZÀ-Þ][\w'-]+(?: [A-ZÀ-Þ][\w'-]+)?)")
GIVEN = frozenset("james mary john patricia robert jennifer michael linda william elizabeth david barbara richard susan joseph jessica thomas sarah anna maria jean pierre marie hans peter klaus sabine jose juan carmen ana luis laura paul emma".split())
CALLING_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 61 62 63 64 65 66 81 82 86 90 91 92 351 352 353 358 380 420".split())
WORDS_FOR = {"phone": "call phone tel telephone mobile fax cell téléphone telefon teléfono".split(), "card": "card visa mastercard credit karte carte tarjeta".split(), "email": "mail email e-mail contact write correo".split(), "name": "dear contact ask meet from by".split(), "secret": "token secret password passwd pwd key apikey auth bearer credential credentials".split()}
WORDS_AGAINST = {"secret": "commit hash sha md5 digest checksum revision etag".split()} | dict.fromkeys(("email", "ip", "card", "phone", "name"), "version isbn order invoice token id page chapter figure volume no nr".split())


def passes_luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses: from each @ to the left as far as local parts go, to the right a domain with a dot."""
    past, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > past and text[start - 1] in LOCAL_CHARS:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            past = domain.end()
            yield start, past
        at = text.find("@", max(at + 1, past))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base patterns' spans, by kind, then start."""
    out = [("email", b, e) for b, e in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if 16 <= len(d := digits_of(m.group())) <= 19 and passes_luhn(d):
            out.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 8 <= len(digits_of(m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


def words_before(words: list[tuple[int, str]], start: int) -> list[str]:
    """The last three words that end before a span, lower-case. words: (end, word) in order."""
    k = bisect_right(words, (start, chr(0x10FFFF)))
    return [w.lower() for _, w in words[max(0, k - 3) : k]]


def regex_vote(kind: str, span: str) -> str:
    """By the form of the span alone."""
    n = len(digits_of(span))
    if kind == "phone":
        return "+" if re.fullmatch(r"\+[0-9][\x20().0-9-]+[0-9]|\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}", span) and 8 <= n <= 15 else "-" if not 7 <= n <= 15 else "0"
    if kind == "card":
        return "+" if re.fullmatch(r"[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4,7}", span) else "-"
    if kind == "secret":
        return "+" if re.fullmatch(r"[0-9a-f]{32,}|[0-9A-F]{32,}", span) else "-" if span.isalpha() else "0"
    if kind == "email":
        return "+" if re.search(r"[.\s)\]][A-Za-z]{2,}$", span) else "-"
    return "+" if kind == "name" and " " in span else "0"


def gazetteer_vote(kind: str, span: str, before: list[str]) -> str:
    """By lists of what is given out: calling codes, first digits of cards, given names, top-level domains, names of secrets."""
    d = digits_of(span)
    if kind == "phone":
        return "+" if span.startswith("+") and any(d[:k] in CALLING_CODES for k in (1, 2, 3)) else "-" if span.startswith("+") else "0"
    if kind == "card":
        return "+" if d[:1] in "3456" and passes_luhn(d) else "-"
    if kind == "name":
        return "+" if span.split(" ")[0].lower() in GIVEN else "0"
    if kind == "email":
        return "+" if re.split(r"[.\s)\]]", span.lower())[-1] in ("com", "org", "net", "edu", "de", "fr", "es", "eu", "info") else "0"
    if kind == "secret":
        return "+" if before and before[-1] in WORDS_FOR["secret"] else "0"
    return "+" if not span.startswith("0.") else "-"


def context_vote(kind: str, before: list[str], left: str) -> str:
    """By the words before; of secrets by a sign of assignment, too."""
    if kind == "secret" and re.search("[=:] *[\"']?$", left):
        return "+"
    if any(w in WORDS_FOR.get(kind, ()) for w in before):
        return "+"
    return "-" if any(w in WORDS_AGAINST[kind] for w in before) else "0"


def shape_vote(kind: str, span: str) -> str:
    """Even groups of digits speak for a number that people read, a bare run of digits against it; letters and digits at random for a secret; an
    all-capital word or a digit against a name."""
    if kind == "secret":
        n = len(digits_of(span))
        return "+" if n and 0.1 <= n / len(span) <= 0.95 and len(set(span)) >= 8 else "-"
    if kind == "name":
        return "-" if span.isupper() or any(c.isdigit() for c in span) else "0"
    if kind not in ("phone", "card"):
        return "0"
    groups = re.findall("[0-9]+", span)
    return "-" if len(groups) == 1 and kind == "phone" and span[0] != "+" else "+" if len(groups) > 1 and max(map(len, groups)) <= 4 else "0"


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans that may be personal data and overlap no base span and no other candidate; of those that start together the longest."""
    taken = sorted((b, e) for _, b, e in base)
    found = []
    for m in NUMBER.finditer(text):
        n = len(digits_of(m.group()))
        if 7 <= n <= 19:
            found.append(("card" if n >= 14 else "phone", *m.span()))
    low = text.lower()
    if "[at]" in low or "(at)" in low:
        found += [("email", *m.span()) for m in SPELLED.finditer(text)]
    found += [("name", *m.span(1)) for m in TITLED.finditer(text)]
    found += [("secret", *m.span()) for m in LONG.finditer(text)]
    found += [("secret", *m.span(1)) for m in ASSIGNED.finditer(text)]
    out, k, past = [], 0, 0
    for kind, b, e in sorted(found, key=lambda s: (s[1], -s[2])):
        while k < len(taken) and taken[k][1] <= b:
            k += 1
        if b >= past and (k == len(taken) or taken[k][0] >= e):
            out.append((kind, b, e))
            past = e
    return out


def span_features(text: str, kind: str, b: int, e: int, before: list[str]) -> list[int]:
    """Hashed features of a span: its shape, size, neighbours and the words before it, each with the kind."""
    shape = re.sub(r"(.)\1+", r"\1", "".join("0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in text[b:e]))
    if kind == "secret":  # mixed at random; what is mixed says more than how
        shape = "".join(sorted(set(shape)))
    known = WORDS_FOR.get(kind, ()), WORDS_AGAINST[kind]
    named = [f"shape {shape}", f"digits {len(digits_of(text[b:e]))}", f"groups {len(re.findall('[0-9]+', text[b:e]))}", f"left {text[b - 1 : b]}", f"right {text[e : e + 1]}", f"size {(e - b).bit_length()}"]
    named += [f"word {w}" for w in before if any(w in x for x in known)]
    return sorted({zlib.crc32(f"{kind} {x}".encode("utf-8", "surrogatepass")) % SIZE for x in named})


def examine(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, and spans: kind, start, end, base, votes and features of every base span and candidate of every whole text."""
    fields = [("kind", pa.string()), ("b", pa.int32()), ("e", pa.int32()), ("base", pa.bool_()), ("votes", pa.string()), ("x", pa.list_(pa.int32()))]

    def of(text: str) -> list[dict]:
        base = base_spans(text)
        more, out = candidates(text, base), []
        words = [(m.end(), m.group()) for m in WORD.finditer(text)] if base or more else []
        for known, spans in ((True, base), (False, more)):
            for kind, b, e in spans:
                before, span = words_before(words, b), text[b:e]
                cast = regex_vote(kind, span) + gazetteer_vote(kind, span, before) + context_vote(kind, before, text[max(0, b - 4) : b]) + shape_vote(kind, span)
                out.append({"kind": kind, "b": b, "e": e, "base": known, "votes": cast, "x": span_features(text, kind, b, e, before)})
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = pa.array([of(t or "") for t in batch.column(1).to_pylist()], pa.list_(pa.struct(fields)))
            yield pa.RecordBatch.from_arrays([batch.column(0), spans], ["id", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, spans array<struct<kind: string, b: int, e: int, base: boolean, votes: string, x: array<int>>>"
    return bounded(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).mapInArrow(run, schema)


class SpanModel:
    """Label models by kind, and the span classifier that their posteriors train."""

    def __init__(self, examined: DataFrame, sample: int):
        spans = examined.select("id", F.explode("spans").alias("s")).select("id", "s.*")
        counted = spans.groupBy("kind", "votes").count().collect()  # at most kinds * 3 ** 4 rows
        self.labels = {}
        for kind in {r["kind"] for r in counted}:
            own = sorted((r["votes"], r["count"]) for r in counted if r["kind"] == kind)
            self.labels[kind] = LabelModel([v for v, _ in own], [n for _, n in own], prior=0.3, anchored=True)
        chosen = hashed_sample(spans, ["id", "kind", "b"], sum(r["count"] for r in counted), sample)
        rows = sorted(chosen.select("kind", "votes", "x").collect())
        target = np.array([float(self.labels[r["kind"]].posterior([r["votes"]])[0]) for r in rows])
        self.weights, self.bias = fit_linear(Rows([r["x"] for r in rows]), target, SIZE, l2=1e-3, rounds=300)

    def sure(self, spans: list[dict], add_from: float) -> list[bool]:
        """Which spans stand: base ones, and those that a list or the context speaks for (form and shape alone make no personal data of a number in
        running text) and that both the votes' posterior and the classifier put at ``add_from`` or more."""
        if not spans:
            return []
        score = sigmoid(Rows([s["x"] for s in spans]).dot(self.weights) + self.bias)
        return [s["base"] or ("+" in s["votes"][1:3] and p >= add_from and self.labels[s["kind"]].posterior([s["votes"]])[0] >= add_from) for s, p in zip(spans, score)]


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, add_from: float = ADD_FROM) -> DataFrame:
    """One row per input row: id and ``found``, an array of (kind, b, e, base): all spans by kind as in KINDS, then ADDED, then start.

    Positions count code points, ends are exclusive. Null texts count as empty and have no spans. Texts of any length are searched whole.
    The span classifier learns from about ``sample`` spans. Other columns of docs are not read. An empty table gives no rows.
    """
    examined = materialize(examine(docs, id_col, text_col), "pii")
    model = docs.sparkSession.sparkContext.broadcast(SpanModel(examined, sample))
    order = {k: i for i, k in enumerate((*KINDS, *ADDED))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = model.value
        kind = pa.list_(pa.struct([("kind", pa.string()), ("b", pa.int32()), ("e", pa.int32()), ("base", pa.bool_())]))
        for batch in batches:
            found = []
            for spans in batch.column(1).to_pylist():
                stands = [s for s, ok in zip(spans, fitted.sure(spans, add_from)) if ok]
                stands.sort(key=lambda s: (order.get(s["kind"], len(order)), s["kind"], s["b"]))
                found.append([{k: s[k] for k in ("kind", "b", "e", "base")} for s in stands])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["id", "found"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = examined.mapInArrow(run, f"id {kind}, found array<struct<kind: string, b: int, e: int, base: boolean>>")
    return out.withColumnRenamed("id", id_col)


def pii_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per input row: id, n_email, n_ip, n_card, n_phone (base spans), base_sha256 and spans, written kind:start:end."""
    out = find_pii(docs, id_col, text_col, **options)
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["b"].cast("string"), s["e"].cast("string"))), ",")
    base = F.filter("found", lambda s: s["base"])
    counts = [F.expr(f"CAST(size(filter(found, s -> s.base AND s.kind = '{k}')) AS long)").alias(f"n_{k}") for k in KINDS]
    return out.select(id_col, *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("found")).alias("spans"))
