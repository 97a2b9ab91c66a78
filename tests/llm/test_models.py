"""Weak labels, classifiers, personal data and line dedup."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestra.llm import line_dedup, pii, quality, queries, toxicity
from attestra.llm.weak_labels import LabelModel, Rows, fit_linear, sigmoid
from tests.llm.conftest import ODD

GOOD = "the town of the north was built by the river and it is known for its old bridge. people from the valley come to the market on sunday. "
BAD = "Th*** an$$$ re### of%%% to&&& in*** it$$$ "


def test_label_model_recovers_accuracies():
    rng = random.Random(1)
    truth = [rng.random() < 0.7 for _ in range(4000)]
    accuracy = [0.95, 0.8, 0.7, 0.6]
    rows = ["".join("0" if rng.random() < 0.2 else "+" if (rng.random() < a) == t else "-" for a in accuracy) for t in truth]
    counts = Counter(rows)
    model = LabelModel(list(counts), list(counts.values()))
    assert all(abs(a - b) < 0.08 for a, b in zip(model.accuracy(), accuracy))
    right = np.mean([(p > 0.5) == t for p, t in zip(model.posterior(rows), truth)])
    assert right > 0.9
    assert LabelModel([], []).posterior([]).shape == (0,)


def test_tied_pairs_score_alike():
    x = [[0, 1], [0, 1], [0, 2], [2], [1]] * 10
    y = np.array([1, 1, 1, 0, 0] * 10, float)
    swapped = Rows([[0, 1], [1]]), Rows([[0, 2], [2]])
    gap = {}
    for tie in (0.0, 50.0):
        w, b = fit_linear(Rows(x), y, 3, pairs=swapped, tie=tie)
        gap[tie] = abs(sigmoid(np.array([w[0] + w[1] + b])) - sigmoid(np.array([w[0] + w[2] + b])))[0]
    assert gap[50.0] <= gap[0.0] + 1e-6


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(400):
        words = [rng.choice("river bridge market town valley street garden house".split()) for _ in range(20)]
        toxic = i % 4 == 0
        if toxic:
            words.insert(5, rng.choice(["idiot", "scum"]))
        if toxic or i % 10 == 1:
            words.insert(9, rng.choice(["women", "muslims", "immigrants"]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs += [(1000, "women river bridge market town valley street garden house men"), (1001, "women river bridge market town")]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_spares_neutral_mentions(labelled):
    docs, labels = labelled
    scores = {tie: {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(docs, labels, F.col("doc_id") % 5 != 0, tie=tie).collect()} for tie in (0.0, 5.0)}
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = [i for i in truth if i % 5 == 0]
    assert np.mean([(scores[5.0][i] >= 0.5) == truth[i] for i in held]) > 0.95
    assert scores[5.0][1000] < 0.5 and scores[5.0][1001] < 0.5 * scores[0.0][1001]


def test_counterfactuals_hold_for_terms_that_were_put_in(labelled, spark):
    """Clean documents with a neutral mention put in: with the price on counterfactuals none is taken for toxic, and scores move less."""
    docs, labels = labelled
    clean = [(2000 + k, f"river {t.decode()} bridge market town {t.decode()} valley street garden") for k, t in enumerate(toxicity.TERMS)] + [(1999, "river bridge market town valley street garden")]
    both = docs.unionByName(spark.createDataFrame(clean, docs.schema))
    moved, wrong = {}, {}
    for tie in (0.0, 5.0):
        out = {r["doc_id"]: r for r in toxicity.toxicity_scores(both, labels, F.col("doc_id") % 5 != 0, tie=tie).collect()}
        moved[tie] = max(abs(out[i]["score"] - out[1999]["score"]) for i, _ in clean)
        wrong[tie] = sum(out[i]["predicted"] for i, _ in clean)
    assert wrong[5.0] == 0 and moved[5.0] <= 0.5 * moved[0.0] and moved[5.0] < 0.2


def test_swaps_and_terms_put_in():
    assert toxicity.counterfactuals({b"women", b"river"}, 0) == [{b"men", b"river"}, {b"river"}]
    assert toxicity.counterfactuals({b"river"}, 3) == [{b"river", toxicity.TERMS[3]}]
    assert toxicity.features_of({b"bridges", b"muslims", b"sea"}) == {b"bridges", b"brid-", b"bridge-", b"muslims", b"sea"}


@pytest.mark.parametrize("folder, least", [("sf0.01", 0.5), ("sf0.1", 0.85)])
def test_toxicity_on_held_out_labels(spark, folder, least):
    path = f"/root/testdata/{folder}"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{path}/labels.parquet").filter("toxic IS NOT NULL").collect()}
    rows = [r for r in queries.op3_toxicity(spark, path).collect() if r["held_out"] and r["doc_id"] in labels]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows) and rows
    found = [labels[r["doc_id"]] for r in rows if r["predicted"]]
    assert sum(found) >= least * sum(labels[r["doc_id"]] for r in rows) and len(found) - sum(found) <= 0.01 * len(rows)


def test_quality_on_labels(spark):
    """No label is read by the operator; its decisions are held against all of them."""
    path = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{path}/labels.parquet").filter("quality IS NOT NULL").collect()}
    rows = [r for r in queries.op6_quality(spark, path).collect() if r["doc_id"] in labels]
    assert np.mean([r["keep"] == bool(labels[r["doc_id"]]) for r in rows]) > 0.99


def slow_scores(docs):
    """The quality scorer without Spark: the same labellers, posterior and linear model over every row."""
    values = [quality.ratios(t or "") for _, t in docs]
    cast = [quality.votes(v) for v in values]
    counts = Counter(cast)
    labels = LabelModel(list(counts), list(counts.values()), prior=0.8)
    found = [quality.features(t or "", v) for (_, t), v in zip(docs, values)]
    order = sorted(range(len(docs)), key=lambda i: (cast[i], list(found[i]), np.float32(list(found[i].values())).tolist()))
    rows = Rows([list(found[i]) for i in order], [np.float32(list(found[i].values())) for i in order])
    spoken = np.array([any(c != "0" for c in cast[i]) for i in order], float)
    w, b = fit_linear(rows, labels.posterior([cast[i] for i in order]), quality.SIZE, weight=spoken + 1e-3)
    score = sigmoid(rows.dot(w) + b)
    return {docs[i][0]: (cast[i], s) for i, s in zip(order, score)}


def test_quality_equals_brute_force(spark):
    rng = random.Random(9)
    docs = [(i, " ".join(rng.choice([*(GOOD + BAD).split(), "!!", "|", "42"]) for _ in range(rng.choice([0, 1, 3, 7, 30, 90])))) for i in range(120)]
    out = quality.quality_scores(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    want = slow_scores(docs)
    assert {r["doc_id"]: r["votes"] for r in out} == {i: v for i, (v, _) in want.items()}
    assert all(abs(r["quality"] - want[r["doc_id"]][1]) < 1e-3 for r in out)


def test_short_texts_are_judged(spark):
    assert quality.votes(quality.ratios("$$$ ### %%% &&& *** @@@ ~~~")).startswith("-")
    assert quality.votes(quality.ratios("a short line of words")).count("-") == 0 and quality.ratios(" \n") is None


def test_toxicity_of_odd_rows(labelled, odd, empty):
    _, labels = labelled
    out = toxicity.toxicity_scores(odd, labels, F.lit(True)).collect()
    assert len(out) == len(ODD) and all(0 <= r["score"] <= 1 for r in out)
    blank = {r["score"] for r in out if r["doc_id"] in (2, 3, 6)}
    assert len(blank) == 1
    assert toxicity.toxicity_scores(empty, labels, F.lit(True)).count() == 0
    none = toxicity.toxicity_scores(odd, labels.limit(0), F.lit(True)).collect()
    assert {r["score"] for r in none} == {0.5}


def test_quality_keeps_good_and_rejects_bad(spark):
    rng = random.Random(6)
    docs = []
    for i in range(300):
        words = (GOOD * 3).split()
        rng.shuffle(words)
        text = " ".join(words)
        docs.append((i, text if i % 5 else BAD * 12 if i % 2 else text.upper().replace(" ", "!! ")))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    out = {r["doc_id"]: r for r in quality.quality_scores(frame).collect()}
    assert all(out[i]["keep"] == bool(i % 5) for i, _ in docs)
    left = quality.drop_low_quality(frame)
    assert {r["doc_id"] for r in left.collect()} == {i for i, r in out.items() if r["keep"]} and left.columns == frame.columns


def test_quality_of_odd_rows(odd, empty):
    out = quality.quality_scores(odd).collect()
    assert len(out) == len(ODD) and all(0 <= r["quality"] <= 1 and len(r["votes"]) == len(quality.LABELLERS) for r in out)
    left = quality.drop_low_quality(odd)
    assert left.columns == odd.columns and left.count() == sum(r["keep"] for r in out)
    assert quality.quality_scores(empty).count() == 0 and quality.drop_low_quality(empty).count() == 0


EMAIL, IP, CARD, PHONE = (re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"))


def slow_spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    luhn = lambda d: sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(d[::-1])) % 10 == 0
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 8 <= len(digits(m)) <= 15]


@pytest.mark.parametrize("pieces", [["a", "b.", "@", "x", "-", ".", " ", "c@d.e", "@f.g", "%", "é"], ["1", "25", "255", "256", ".", "..", "1.2.3.4", " ", "00"], ["4", "4111111111111111", "1", " ", "-", "  ", "+1", " 42", "+", "(", ")", ".", "5"]])
def test_base_spans(pieces):
    rng = random.Random(2)
    for _ in range(4000):
        t = "".join(rng.choice(pieces) for _ in range(rng.randrange(16)))
        assert pii.base_spans(t) == slow_spans(t), repr(t)


def test_long_runs_are_fast():
    assert pii.base_spans("9" * 200000 + "a@" * 50000 + "1." * 50000 + "+1" * 50000) is not None
    assert pii.base_spans("0" * 6000 + ".0.0.0") == [("ip", 0, 6006)]


def test_report_and_added_spans(spark):
    rng = random.Random(8)
    docs = []
    for i in range(300):
        mail, phone = f"user{i}@mail.example.com", f"+1 ({200 + i}) 555-{1000 + i}"
        docs.append((i, rng.choice([f"write to {mail} today", f"call {phone} now", f"please call ({300 + i}) 555-{2000 + i} today", f"order {10**9 + i} was sent", "nothing"])))
    out = pii.pii_report(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    for r in out:
        base = ",".join("%s:%d:%d" % s for s in slow_spans(dict(docs)[r["doc_id"]]))
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(r["spans"].split(","))
        if "order" in dict(docs)[r["doc_id"]] or dict(docs)[r["doc_id"]] == "nothing":
            assert r["spans"] == ""


SECRET = re.compile(r'token = "([0-9a-fA-F]{32,})"', re.I)


@pytest.mark.parametrize("size, least", [("sf0.001", 0), ("sf0.01", 5), ("sf0.1", 50)])
def test_added_spans_on_the_corpus(spark, size, least):
    """Secrets are what the base patterns have no kind for: how many of those that stand in the corpus are added, and what else is."""
    path = f"/root/testdata/{size}"
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()}
    truth, added, base = set(), set(), 0
    for i, t in docs.items():
        truth |= {(i, *m.span(1)) for m in SECRET.finditer(t)}
    for r in queries.op5_pii(spark, path).collect():
        own = {("%s:%d:%d" % s) for s in slow_spans(docs[r["doc_id"]])}
        spans = set(filter(None, r["spans"].split(",")))
        assert own <= spans
        base += len(own)
        added |= {(r["doc_id"], *map(int, s.split(":")[1:])) for s in spans - own}
    assert len(truth) >= least and len(added & truth) >= 0.95 * len(truth) and len(added & truth) >= 0.95 * len(added)


def test_decoys_are_no_personal_data(spark):
    """Digits that fail Luhn in running text, numbers of orders and hashes, however many there are next to true cards."""
    rng = random.Random(11)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    fails = lambda: next(d for d in iter(lambda: number(16), None) if not pii.passes_luhn(d))
    for n_true, n_false in ((5, 60), (60, 5), (0, 40)):
        docs = [f"the ble {fails()} th of it" for _ in range(n_false)] + [f"order no {number(14)} and {number(9)} left" for _ in range(n_false)]
        docs += [f"commit {zlib.crc32(number(9).encode()):08x}{number(12)}{number(20)}abcdef" for _ in range(n_false)]
        docs += ["pay by card 4111 1111 1111 1111 now"] * n_true + [f'token = "{zlib.crc32(number(9).encode()):08x}{number(20)}abcd9f"' for _ in range(n_true)]
        out = pii.pii_report(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()
        for r in out:
            kinds = [s.split(":")[0] for s in r["spans"].split(",") if s]
            assert kinds == (["card"] if "pay by" in docs[r["doc_id"]] else ["secret"] if "token" in docs[r["doc_id"]] else []), docs[r["doc_id"]]


def test_votes_keep_their_sign():
    patterns, counts = ["+-", "++", "0+", "00"], [50, 3, 1, 5]
    model = LabelModel(patterns, counts, prior=0.3, anchored=True)
    assert (model.likely[0][:, 0] >= model.likely[1][:, 0] - 1e-12).all() and (model.likely[1][:, 1] >= model.likely[0][:, 1] - 1e-12).all()
    sure = model.posterior(["++", "+-"])
    assert sure[0] >= sure[1]


def test_labelers_do_not_know_the_base_patterns():
    hexed = "4d44c79e8bf7c55759c4958dd60ed83d2ef8cd4e"
    text = f'the token = "{hexed}" and password: hunter2x, commit {hexed} of bletitionthtionbletionth'
    spans = {text[b:e]: (kind, b) for kind, b, e in pii.candidates(text, [])}
    assert spans[hexed][0] == "secret" and "hunter2x" in spans and "bletitionthtionbletionth" in spans
    assert pii.regex_vote("secret", hexed) == "+" and pii.regex_vote("secret", "bletitionthtionbletionth") == "-"
    assert pii.shape_vote("secret", hexed) == "+" and pii.shape_vote("secret", "bletitionthtionbletionth") == "-"
    assert pii.gazetteer_vote("secret", hexed, ["my", "token"]) == "+" and pii.context_vote("secret", ["commit"], "mit ") == "-"
    words = [(m.end(), m.group()) for m in pii.WORD.finditer("one two " + "x" * 500 + " three +1 234")]
    assert pii.words_before(words, 519) == ["two", "x" * 500, "three"]


def test_long_spans_are_found_whole():
    name = "Dr. " + "A" + "b" * 80 + " C" + "d" * 40
    mail = "n" * 100 + " [at] " + "h" * 90 + " [dot] museumsverein"
    found = {(kind, text[b:e]) for text in (name, mail) for kind, b, e in pii.candidates(text, [])}
    assert ("name", name[4:]) in found and ("email", mail) in found
    assert pii.candidates("a" * 300000 + " [a" * 1000, []) is not None


def test_pii_of_odd_rows(odd, empty):
    out = pii.pii_report(odd).collect()
    assert len(out) == len(ODD) and all(r["spans"] == "" and r["n_email"] == 0 for r in out)
    assert pii.pii_report(empty).count() == 0


def test_boilerplate_lines(spark):
    rng = random.Random(3)
    docs = [(i, rng.choice(["h1", "h1", "h2", None]), "\n".join(rng.choice(["menu", " menu ", "foot", "", f"own {i}", f"own {i}"]) for _ in range(rng.randrange(5)))) for i in range(120)] + [(500, "h2", None)]
    out = line_dedup.line_report(spark.createDataFrame(docs, "doc_id long, source string, text string"), F.col("source"), ratio=0.3, least=3).collect()
    pages, counts = Counter(), defaultdict(Counter)
    for _, h, t in docs:
        pages[h] += 1
        counts[h].update({x.strip(" ") for x in (t or "").split("\n")} - {""})
    for r in out:
        _, h, t = next(d for d in docs if d[0] == r["doc_id"])
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (x.strip(" ") and counts[h][x.strip(" ")] >= 3 and counts[h][x.strip(" ")] > 0.3 * pages[h])]
        text = "\n".join(kept)
        assert (r["n_lines"], r["n_dropped"], r["kept_sha256"]) == (len(lines), len(lines) - len(kept), hashlib.sha256(text.encode()).hexdigest())


def test_lines_of_odd_rows(odd, empty):
    left = line_dedup.drop_boilerplate(odd, F.col("fp"), ratio=0.1, least=2)
    assert left.columns == [*odd.columns, "__lines"] and left.count() == len(ODD)
    assert {r["text"] for r in left.filter("doc_id IN (1, 4)").collect()} == {""}
    assert [r["text"] for r in left.filter("doc_id = 2").collect()] == [None]
    assert line_dedup.line_report(empty, F.lit("h")).count() == 0
    assert line_dedup.host_of(F.lit("x")) is not None
