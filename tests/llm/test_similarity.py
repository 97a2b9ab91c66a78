"""Near dedup by similarity against brute force over all pairs."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from attestra.llm import similarity, simhash
from attestra.llm.rows import first_row
from tests.llm.test_pairs import union


def slow_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def slow_components(docs):
    sets = {i: slow_set(t) for i, t in docs}
    alike = [(a, b) for a in sets for b in sets if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8)]
    return union(alike, sets)


def edited(rng, vocabulary, base, edits):
    words = list(base)
    for at in rng.sample(range(0, len(words), 5), edits):
        words[at] = rng.choice(vocabulary)
    return words


def test_stage_drops_what_is_similar(spark):
    rng = random.Random(11)
    vocabulary = ["w%d" % i for i in range(500)]
    docs = []
    for g in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([30, 100, 200]))]
        docs.append((10 * g, " ".join(base)))
        for k in range(1, 6):  # from far above the similarity to below it
            docs.append((10 * g + k, " ".join(edited(rng, vocabulary, base, max(1, k * len(base) // 200)))))
    docs += [(900, "a b c d e f g h i"), (901, "A b c d e f g h"), (902, "a b c d e f g"), (903, "a b c"), (904, "a b  C"), (905, ""), (906, None)]
    want = slow_components(docs)
    assert want[901] == 900 and len(set(want.values())) > 60  # exactly 0.8; some stay apart
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.near_stage(spark, frame, "").collect()} == set(want.values())
    assert {r["doc_id"]: r["component_id"] for r in similarity.similar(frame).collect()} == want


def test_stage_links_by_fingerprints_and_checks_them(spark, monkeypatch):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    alone = [(10 + i, " ".join(word() for _ in range(80))) for i in range(5)]
    text = [word() for _ in range(2000)]
    docs = spark.createDataFrame([(1, " ".join(text)), (2, " ".join([*text[:-1], word()])), *alone, (20, None), (21, "")], "doc_id long, text string")
    pairs, plain = [], similarity.Similar.stars
    monkeypatch.setattr(similarity.Similar, "stars", lambda self, linked: pairs.append(plain(self, linked)) or pairs[-1])
    left = {r["doc_id"] for r in corpus_pipeline.near_stage(spark, docs, "").collect()}
    assert left == {1, *range(10, 15), 20} and len(pairs) == 1  # fingerprints were asked


def test_stage_checks_all_that_fingerprints_link(spark, monkeypatch):
    """Sets that share no band with another, and two of a fingerprint's sets that are unlike its smallest."""
    keys = lambda hashes: np.arange(similarity.BANDS, dtype=np.int64) * 977 + similarity.name_of(hashes) % 2**61
    monkeypatch.setattr(similarity, "band_keys", keys)
    rng = random.Random(15)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    text = [word() for _ in range(2000)]
    docs = [(1, " ".join(text)), (2, " ".join([*text[:-1], word()])), (3, " ".join(word() for _ in range(80)))]
    assert {r["doc_id"] for r in corpus_pipeline.near_stage(spark, spark.createDataFrame(docs, "doc_id long, text string"), "").collect()} == {1, 3}
    monkeypatch.setattr(simhash, "fingerprint", lambda text, size: 7)
    vocabulary = ["w%d" % i for i in range(500)]
    bases = [[rng.choice(vocabulary) for _ in range(60)] for _ in range(6)]
    docs = [(10 * g + k, " ".join(edited(rng, vocabulary, base, k))) for g, base in enumerate(bases) for k in (0, 1)]
    want = set(slow_components(docs).values())
    assert len(want) == 6
    assert {r["doc_id"] for r in corpus_pipeline.near_stage(spark, spark.createDataFrame(docs, "doc_id long, text string"), "").collect()} == want


def test_a_large_group_and_a_common_passage(spark):
    rng = random.Random(12)
    vocabulary = ["w%d" % i for i in range(500)]
    base, passage = [rng.choice(vocabulary) for _ in range(100)], ["p%d" % i for i in range(30)]
    docs = [(i, " ".join(edited(rng, vocabulary, base, rng.randrange(1, 8)))) for i in range(150)]
    docs += [(500 + i, " ".join([rng.choice(vocabulary) for _ in range(40)] + passage)) for i in range(100)]
    out = similarity.similar(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == slow_components(docs)


def test_keys_of_many_sets_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK_SETS", 8)
    monkeypatch.setattr(similarity, "SORTED_SETS", 16)
    rng = random.Random(13)
    vocabulary = ["w%d" % i for i in range(500)]
    base = [rng.choice(vocabulary) for _ in range(100)]
    docs = [(i, " ".join(edited(rng, vocabulary, base, rng.randrange(1, 6)))) for i in range(120)]
    out = similarity.similar(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == slow_components(docs)


def test_sketches_never_exceed_the_difference():
    rng = random.Random(14)
    for size in (1, 30, 2000, 9000):
        a, b = (np.unique(np.array([rng.randrange(2 * size) for _ in range(size)], np.uint64)) * np.uint64(0x9E3779B97F4A7C15) for _ in range(2))
        bits = [np.frombuffer(similarity.sketch(x), np.uint64) for x in (a, b)]
        assert int(np.bitwise_count(bits[0] ^ bits[1]).sum()) <= len(set(a.tolist()) ^ set(b.tolist()))


def test_similar_of_odd_rows(odd, empty):
    out = {(r["doc_id"], r["component_id"]) for r in similarity.similar(odd).collect()}
    assert out == {(1, 1), (4, 1), (2, 2), (3, 2), (6, 2), (5, 5), (None, None)}
    left = simhash.drop_near_duplicates(odd, similarity=0.8, size=5)
    assert left.columns == odd.columns and sorted(str(r["doc_id"]) for r in left.collect()) == ["1", "2", "5", "None"]
    assert similarity.similar(empty).count() == 0 and simhash.drop_near_duplicates(empty, similarity=0.8).columns == empty.columns


def test_texts_are_read_again_where_they_are(spark, capsys):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "h i j k l m n"), (None, None), (4, "a b c d e f g")], "doc_id long, text string")
    nodes = similarity.summaries(docs, "doc_id", "text", 5).groupBy("fp").agg(F.min(first_row()).alias("least")).filter("least.id = 1 OR least.id IS NULL")
    sets = similarity.whole_sets(docs, nodes, "doc_id", "text", 5)
    sets.explain()
    assert "Join" not in capsys.readouterr().out
    found = {r["fp"]: r["shingles"] for r in sets.collect()}
    texts = {similarity.name_of(s): s.view(np.int64).tolist() for s in map(similarity.shingles, ("a b c d e f g", "h i j k l m n", None))}
    assert {r["fp"] for r in nodes.collect()} <= set(found) and all(texts[fp] == s for fp, s in found.items())
