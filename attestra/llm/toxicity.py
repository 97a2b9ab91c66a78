"""Toxicity by a counterfactual-regularised classifier.

A logistic model over the words of a text and their beginnings learns from about ``sample`` labelled documents. Counterfactuals of each of them have
an identity term swapped, for another of the same kind and for a word without weight, or, where it names no group, a term put in; the squared
change of the score is penalised. So a mention of a group moves the score little by itself, and neutral mentions are not taken for toxic ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from attestra.llm.batches import bounded
from attestra.llm.decontaminate import words_of
from attestra.llm.weak_labels import Rows, fit_linear, hashed_sample, sigmoid

#: Labelled rows to learn from, features that the model knows, and documents that a feature is in at least.
SAMPLE, VOCABULARY, LEAST_DOCS = 20_000, 1024, 2
#: Letters of a word's beginnings that are features of their own.
BEGINNINGS = (4, 6)
#: Words whose features a task remembers, and how long they are at most.
REMEMBERED, SHORT = 300_000, 64
#: Prices: of a weight's square, for all rows together, and of a counterfactual's squared change of the score.
L2, TIE = 0.3, 5.0
#: Identity terms, by kind; terms of a line are swapped for one another.
IDENTITY = [line.split() for line in """
muslim christian jewish hindu buddhist atheist catholic sikh
muslims christians jews hindus buddhists atheists catholics sikhs
black white asian african latino arab indian european
gay lesbian straight bisexual transgender queer
woman man girl boy
women men girls boys
immigrant refugee foreigner migrant
immigrants refugees foreigners migrants
disabled blind deaf autistic
old young elderly
musulman chrétien juif bouddhiste
femme homme fille garçon
femmes hommes filles garçons
muslimisch christlich jüdisch
frau mann mädchen junge
frauen männer
musulmán cristiano judío budista
mujer hombre niña niño
mujeres hombres niñas niños
""".split("\n") if line]


TERMS = [t.encode() for kind in IDENTITY for t in kind]


def features_of(words: set[bytes]) -> set[bytes]:
    """Words, and their beginnings with a hyphen; identity terms have no beginnings, so that a swap changes all that a term says."""
    out = set(words)
    for w in words.difference(TERMS):
        out.update(w[:n] + b"-" for n in BEGINNINGS if len(w) > n)
    return out


def counterfactuals(words: set[bytes], number: int) -> list[set[bytes]]:
    """The words with every identity term swapped, once for the next of its kind, once for a word that the model doesn't know. Words without a term
    get one, the ``number``-th in turn, so that there are counterfactuals of texts that name no group."""
    swaps = {}
    for kind in IDENTITY:
        for a, b in zip(kind, kind[1:] + kind[:1]):
            if a.encode() in words:
                swaps[a.encode()] = b.encode()
    rest = words - set(swaps)
    return [rest | set(swaps.values()), rest] if swaps else [words | {TERMS[number % len(TERMS)]}]


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, train: Column, sample: int) -> DataFrame:
    """features (distinct) and toxic of the sampled labelled documents. The sample is bounded, so it is broadcast to the documents."""
    chosen = labels.filter("toxic IS NOT NULL").filter(train).select(F.col(id_col).alias("_id"), F.col("toxic").cast("int").alias("toxic"))
    chosen = hashed_sample(chosen, ["_id"], chosen.count(), sample).groupBy("_id").agg(F.max("toxic").alias("toxic"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([sorted(features_of(set(words_of(t)))) for t in batch.column(0).to_pylist()], pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([found, batch.column(1)], ["features", "toxic"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "_id")
    return bounded(rows.select("text", "toxic")).mapInArrow(run, "features array<binary>, toxic int")


class Toxicity:
    """The fitted model: a weight for each feature of its vocabulary."""

    def __init__(self, rows: DataFrame, vocabulary: int, tie: float, l2: float = L2):
        rows = rows.persist()
        total = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("p")).first()
        share = F.lit(total["p"] / max(1, total["n"]))
        counts = rows.select(F.explode("features").alias("feature"), "toxic").groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("p"))
        score = (F.col("p") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share) + 1)
        best = counts.filter(F.col("n") >= LEAST_DOCS).orderBy(F.desc(F.abs(score)), "feature").limit(vocabulary)
        known = [bytes(r["feature"]) for r in best.select("feature").collect()]
        known += sorted(set(TERMS) - set(known))
        place = {w: i for i, w in enumerate(known)}
        named = F.broadcast(rows.sparkSession.createDataFrame([(bytearray(w), i) for w, i in place.items()], "feature binary, i int"))
        sparse = rows.withColumn("_r", F.monotonically_increasing_id()).select("_r", "toxic", F.explode_outer("features").alias("feature")).join(named, "feature", "left")
        found = sparse.groupBy("_r").agg(F.max("toxic").alias("toxic"), F.collect_list("i").alias("x")).select("toxic", "x").collect()  # about ``sample`` rows
        rows.unpersist()
        found.sort(key=lambda r: (r["toxic"], sorted(r["x"])))
        x = [sorted(r["x"]) for r in found]
        pairs = [(a, sorted(place[w] for w in b if w in place)) for k, a in enumerate(x) for b in counterfactuals({known[i] for i in a}, k)] if tie else []
        y = np.array([r["toxic"] for r in found], float)
        both = (Rows([a for a, _ in pairs]), Rows([b for _, b in pairs])) if pairs else None
        rare = np.where(y == 1, np.sqrt(max(1.0, (len(y) - y.sum()) / max(1.0, y.sum()))), 1.0)  # toxic texts are few
        weights, self.bias = fit_linear(Rows(x), y, len(known), weight=rare, l2=l2 / max(1, len(x)), rounds=500, rate=0.05, pairs=both, tie=tie)
        self.weights = {w: float(weights[i]) for w, i in place.items() if weights[i]}

        #: Which features of the vocabulary a word has, for as many words as a task may remember.
        self.hits: dict[bytes, tuple[bytes, ...]] = {}

    def features_met(self, word: bytes) -> tuple[bytes, ...]:
        found = self.hits.get(word)
        if found is None:
            found = tuple(f for f in features_of({word}) if f in self.weights)
            if len(self.hits) >= REMEMBERED:
                self.hits.clear()
            if len(word) <= SHORT:
                self.hits[word] = found
        return found

    def score(self, text: str | None) -> float:
        met: set[bytes] = set()
        for word in set(words_of(text)):
            if found := self.features_met(word):
                met.update(found)
        return float(sigmoid(np.array(self.bias + sum(map(self.weights.__getitem__, sorted(met))))))


def toxicity_scores(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, vocabulary: int = VOCABULARY, tie: float = TIE) -> DataFrame:
    """One row per input row: id, score (0 to 1; higher: more likely toxic) and predicted (1 from 0.5 on).

    labels: id, toxic; learned from where ``train`` holds, about ``sample`` rows (documents labelled twice count once, toxic if either
    is). A score depends on the text alone: null and empty texts have the score of a text without known words. Without labels all score 0.5.
    """
    model = docs.sparkSession.sparkContext.broadcast(Toxicity(training_rows(docs, labels, id_col, text_col, train, sample), vocabulary, tie))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = model.value
        for batch in batches:
            scores = pa.array([fitted.score(t) for t in batch.column(1).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), scores], ["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = bounded(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).mapInArrow(run, f"id {kind}, score double")
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
