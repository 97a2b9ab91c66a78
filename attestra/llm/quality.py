"""Quality by weak labels: heuristic labellers vote, expectation-maximisation estimates how far each can be trusted, and the posterior
labels train a linear scorer over hashed word shapes.

Votes of all documents are counted by pattern (3 to the number of labellers at most), so only a bounded table reaches the driver. The
scorer learns from about ``sample`` documents; a document's features are the shares of its words' shapes ("Aa", "a", "a*", "A!" ...)
and steps of a few ratios, hashed to ``SIZE`` places.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from attestra.llm.batches import bounded, slices
from attestra.llm.weak_labels import LabelModel, Rows, fit_linear, hashed_sample, sigmoid
from attestra.session import materialize, scratch_scope

SIZE, SAMPLE = 1024, 20_000
#: The labellers of frequent words and sentence ends have nothing to say about texts of fewer words; the others judge every text that has any.
PROSE_WORDS = 24
#: Bytes as shapes: letters (and all bytes of letters beyond ASCII) as a or A, digits as 0, white space as one space.
SHAPES = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else 32 if b in b" \t\n\r\v\f" else b for b in range(256))
#: Frequent short words of the corpus languages.
COMMON = frozenset(b"the of and to in a is that it for as was on with by this from der die und in den von zu das mit sich des auf ist le la de et les des en un une du que est pour dans qui par el los del las y con se su para al es".split())


def ratios(text: str) -> dict[str, float] | None:
    """What the labellers look at, each a share between 0 and 1; None for texts without words."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.lower().split()
    if not words:
        return None
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower = int(counts[65:91].sum()), int(counts[97:123].sum())
    letters = upper + lower + int(counts[128:].sum())
    digits, spaces = int(counts[48:58].sum()), int(counts[[9, 10, 11, 12, 13, 32]].sum())
    usual = int(counts[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]].sum())
    black = max(1, len(raw) - spaces)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n = len(words)
    return {
        "symbols": max(0, black - letters - digits - usual) / black,
        "capitals": upper / max(1, upper + lower),
        "digits": digits / black,
        "cells": words.count(b"|") / n,
        "marks": int(counts[[33, 63]].sum()) / n,
        "stutter": sum(map(bytes.__eq__, words[1:], words)) / n,
        "fresh": sum(len(set(words[i : i + 32])) for i in range(0, n, 32)) / n,
        "lines": 1 - len(set(lines)) / len(lines),
        "common": sum(map(COMMON.__contains__, words)) / n if n >= PROSE_WORDS else 1.0,
        "length": letters / n / 20,
        "stops": int(counts[[33, 46, 63]].sum()) / n if n >= PROSE_WORDS else 1.0,
    }


#: Labellers: a ratio, where it speaks against good quality (at or above the bar, or at or below it), and where for it, if ever.
LABELLERS = (
    ("symbols", ">=", 0.06, None),
    ("cells", ">=", 0.15, None),
    ("capitals", ">=", 0.40, None),
    ("digits", ">=", 0.30, None),
    ("marks", ">=", 0.40, None),
    ("stutter", ">=", 0.30, None),
    ("lines", ">=", 0.40, None),
    ("fresh", "<=", 0.55, 0.90),
    ("common", "<=", 0.02, None),
    ("stops", "<=", 0.005, None),
    ("length", "<=", 0.08, None),
)


def votes(values: dict[str, float] | None) -> str:
    """One vote for each labeller: + good, - bad, 0 none. Texts without words get no votes."""
    if values is None:
        return "0" * len(LABELLERS)
    out = []
    for name, side, bar, good in LABELLERS:
        x = values[name]
        out.append("-" if (x >= bar if side == ">=" else x <= bar) else "+" if good is not None and x >= good else "0")
    return "".join(out)


def features(text: str, values: dict[str, float] | None) -> dict[int, float]:
    """Hashed features of a text."""
    flat = np.frombuffer(b" " + text.encode("utf-8", "surrogatepass").translate(SHAPES), np.uint8)
    shapes = Counter(flat[np.concatenate(([True], flat[1:] != flat[:-1]))].tobytes().split())
    total, out = max(1, shapes.total()), Counter()
    for shape, n in shapes.items():
        out[zlib.crc32(shape) % SIZE] += n / total
    if values is not None:
        for name, x in values.items():
            out[zlib.crc32(f"{name} {int(x * 20)}".encode()) % SIZE] += 1.0
    return out


def measure(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, votes, features, values of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = []
            for text in batch.column(1).to_pylist():
                values = ratios(text or "")
                x = features(text or "", values)
                found.append((votes(values), list(x), list(x.values())))
            v, f, x = (list(c) for c in zip(*found)) if found else ([], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(v, pa.string()), pa.array(f, pa.list_(pa.int32())), pa.array(x, pa.list_(pa.float32()))], ["id", "votes", "features", "values"])

    kind = docs.schema[id_col].dataType.simpleString()
    return bounded(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).mapInArrow(run, f"id {kind}, votes string, features array<int>, values array<float>")


class Quality:
    """The fitted label model and scorer."""

    def __init__(self, measured: DataFrame, sample: int = SAMPLE):
        patterns = [(r["votes"], r["count"]) for r in measured.groupBy("votes").count().collect()]  # at most 3 ** len(LABELLERS) rows
        self.labels = LabelModel([p for p, _ in patterns], [n for _, n in patterns], prior=0.8)
        chosen = hashed_sample(measured, ["id", "votes"], sum(n for _, n in patterns), sample)
        rows = sorted(chosen.select("votes", "features", "values").collect())
        target = self.labels.posterior([r["votes"] for r in rows])
        spoken = np.array([any(v != "0" for v in r["votes"]) for r in rows], float)
        self.weights, self.bias = fit_linear(Rows([r["features"] for r in rows], [r["values"] for r in rows]), target, SIZE, weight=spoken + 1e-3)

    def score(self, rows: Rows) -> np.ndarray:
        return sigmoid(rows.dot(self.weights) + self.bias)


def quality_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, keep_from: float = 0.5) -> DataFrame:
    """One row per input row: id, votes, weak_label (posterior of good), quality (the scorer's probability of good) and keep.

    Null texts count as empty. Texts on which no labeller has a say are kept unless the scorer is sure (below ``keep_from`` / 2). Other columns of docs are not read. An empty table gives no rows.
    """
    measured = materialize(measure(docs, id_col, text_col), "quality")
    model = docs.sparkSession.sparkContext.broadcast(Quality(measured, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = model.value
        for batch in batches:
            v = batch.column(1).to_pylist()
            score = fitted.score(Rows(batch.column(2).to_pylist(), batch.column(3).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fitted.labels.posterior(v)), pa.array(score)], ["id", "votes", "weak_label", "quality"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = measured.mapInArrow(run, f"id {kind}, votes string, weak_label double, quality double")
    return out.select(F.col("id").alias(id_col), "votes", "weak_label", "quality", keeps(keep_from).alias("keep"))


def keeps(keep_from: float):
    silent = F.col("votes") == "0" * len(LABELLERS)
    return F.col("quality") >= F.when(silent, keep_from / 2).otherwise(keep_from)


def drop_low_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, keep_from: float = 0.5) -> DataFrame:
    """docs without the rows that the scorer rejects, all columns as they were. Rows are scored in place, without a join."""
    with scratch_scope(docs.sparkSession):  # what was measured goes when the model is there
        model = docs.sparkSession.sparkContext.broadcast(Quality(materialize(measure(docs, id_col, text_col), "quality"), sample))
    at, low = docs.columns.index(text_col), keep_from

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = model.value
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(at).to_pylist()]
            values = [ratios(t) for t in texts]
            found = [features(t, v) for t, v in zip(texts, values)]
            score = fitted.score(Rows([list(x) for x in found], [np.float32(list(x.values())) for x in found]))
            bar = np.array([low if any(c != "0" for c in votes(v)) else low / 2 for v in values])
            yield batch.filter(pa.array(score >= bar))

    names = [f"_c{i}" for i in range(len(docs.columns))]
    out = docs.toDF(*names)
    out = bounded(out).mapInArrow(run, out.schema)
    return out.toDF(*docs.columns)
