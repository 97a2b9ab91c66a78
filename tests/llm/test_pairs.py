"""Exact and near dedup, components and decontamination against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from attestra.llm import decontaminate, exact_dedup, simhash
from attestra.llm.components import connected_components
from attestra.llm.fm_index import FMIndex, suffix_array
from attestra.llm.xxh64 import hash_ranges
from attestra.session import materialize
from tests.llm.conftest import ODD

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ascii_lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("runs, fanin", [(1, 2), (8, 2), (32, 4)])
def test_exact_duplicates(spark, keep, runs, fanin):
    rng = random.Random(1)
    docs = [(i, rng.choice(["", None, "a", "b", "B", "a "])) for i in range(80)]
    out = exact_dedup.exact_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), keep=keep, runs=runs, fanin=fanin).collect()
    groups = defaultdict(list)
    for i, t in docs:
        groups[t or ""].append(i)
    best = min if keep == "smallest" else max
    want = {(i, best(groups[t or ""]), len(groups[t or ""]), i == best(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in docs}
    assert {tuple(r) for r in out} == want and len(out) == len(docs)


def test_runs_merge_in_sorted_order_and_stay_native(spark):
    docs = spark.createDataFrame([(i, f"t{i % 7}") for i in range(50)], "doc_id long, text string").repartition(5)
    tree = exact_dedup.Tree(docs, "doc_id", "text", "smallest", 8, 2)
    plan = tree.merged(tree.rows.withColumn("row", exact_dedup.first_row()).withColumn("rows", exact_dedup.F.lit(1)))._jdf.queryExecution().toString()
    assert "SortAggregate" in plan and "Python" not in plan and "Arrow" not in plan
    assert [level.count() for level in tree.levels] == sorted((level.count() for level in tree.levels), reverse=True) and tree.levels[-1].count() == 7
    assert exact_dedup.rounds(64, 4) == [range(0, 2), range(2, 4), range(4, 6)]


def test_a_digest_of_two_texts_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "digest_columns", lambda text: [exact_dedup.F.lit(b"x").alias("digest"), exact_dedup.F.lit(1).cast("long").alias("h"), exact_dedup.F.lit(1).alias("size")])
    with pytest.raises(Exception, match="two texts have one digest"):
        exact_dedup.exact_duplicates(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string"))


def test_exact_duplicates_of_odd_rows(odd, empty):
    out = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_duplicates(odd, keep="largest").collect()}
    assert {(1, 4, 3, False), (4, 4, 3, True), (2, 3, 2, False), (3, 3, 2, True), (None, None, 1, True)} <= out
    left = exact_dedup.drop_exact_duplicates(odd, keep="largest")
    assert left.columns == odd.columns and sorted(str(r["doc_id"]) for r in left.collect()) == ["3", "4", "5", "6", "None"]
    assert exact_dedup.exact_duplicates(empty).count() == 0 and exact_dedup.drop_exact_duplicates(empty).columns == empty.columns


def test_hashes_equal_the_library():
    rng = random.Random(2)
    data = bytes(rng.randrange(256) for _ in range(3000))
    start = np.array([rng.randrange(2000) for _ in range(800)])
    size = np.array([rng.choice([0, 1, 3, 4, 7, 8, 9, 31, 32, 33, 64, 100, 511, 512, 513, 900]) for _ in range(800)])
    got = hash_ranges(data + bytes(8), start, size, 42)
    assert [int(h) for h in got] == [xxhash.xxh64_intdigest(data[s : s + n], 42) for s, n in zip(start, size)]


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text))
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << k for k in range(64) if sum(h >> k & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


@pytest.mark.parametrize("text", [None, "", " \n", "one", "A b", "a b c d", "a b c d e f\x1cg", "x " * 70000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) % 2**64 == slow_fingerprint(text)


def union(pairs, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("most, blocks", [(0, None), (1, None), (4, None), (4, 7), (4, 8), (5, None)])
def test_links_lose_nothing(spark, most, blocks):
    rng = random.Random(most)
    fps = set()
    for _ in range(25):
        base = rng.getrandbits(64)
        for _ in range(8):
            fps.add(base)
            for _ in range(rng.randrange(1, 4)):
                base ^= 1 << rng.randrange(64)
    fps |= {0, 2**64 - 1, 2**63}
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    nodes = spark.createDataFrame([(f, f) for f in signed], "fp long, grp long")
    got = {(min(r["a"], r["b"]), max(r["a"], r["b"])) for r in simhash.links(nodes, most, blocks).collect()}
    want = {(min(a, b), max(a, b)) for a in signed for b in signed if a != b and ((a ^ b) % 2**64).bit_count() <= most}
    assert got == want


def test_cells_are_not_broadcast(spark, capsys):
    """A table of a few MB has hundreds of MB of cells, which Spark sizes like the table."""
    simhash.links(materialize(spark.createDataFrame([(1, 1), (3, 3)], "fp long, grp long"), "nodes")).explain()
    plan = capsys.readouterr().out
    assert "posexplode" in plan and "Broadcast" not in plan


def test_components(spark):
    rng = random.Random(7)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(40)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + [(5, 5)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    linked = {n for a, b in pairs if a != b for n in (a, b)}
    assert got == union(pairs, linked)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(spark):
    rng = random.Random(3)
    vocabulary = ["w%d" % i for i in range(400)]
    docs = []
    for g in range(12):
        base = [rng.choice(vocabulary) for _ in range(300)]
        for k in range(5):
            copy = list(base)
            for _ in range(k):
                copy[rng.randrange(300)] = rng.choice(vocabulary)
            docs.append((g * 10 + k, " ".join(copy)))
    docs += [(500, None), (501, ""), (502, "short")]
    out = simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    fps = {i: slow_fingerprint(t) for i, t in docs}
    want = union([(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 4], fps)
    assert {r["doc_id"]: r["component_id"] for r in out} == want
    assert all(r["fingerprint"] == f"{fps[r['doc_id']]:016x}" for r in out)


def test_near_duplicates_of_odd_rows(odd, empty):
    out = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(odd).collect()}
    assert {(1, 1), (4, 1), (2, 2), (3, 2), (6, 2), (5, 5), (None, None)} == out
    left = simhash.drop_near_duplicates(odd)
    assert left.columns == odd.columns and sorted(str(r["doc_id"]) for r in left.collect()) == ["1", "2", "5", "None"]
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("options", [{}, {"similarity": 0.8, "size": 5}])
def test_rows_of_equal_ids_are_told_apart(spark, options):
    text = lambda seed: " ".join(random.Random(seed).choices("abcdefghijklmnop", k=60))
    docs = [(None, text(1)), (None, text(2)), (7, text(3)), (7, text(4)), (7, text(4)), (8, text(4)), (None, text(4))]
    left = simhash.drop_near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), **options)
    assert sorted(map(str, left.collect())) == sorted(map(str, left.sparkSession.createDataFrame(docs[:4], left.schema).collect()))


def test_more_fingerprints_get_more_blocks():
    assert [simhash.blocks_for(n, 4) for n in (0, 10**5, 10**6, 10**8)] == sorted(simhash.blocks_for(n, 4) for n in (0, 10**5, 10**6, 10**8))
    assert simhash.blocks_for(10, 4) == 5 and simhash.blocks_for(10**9, 4) > 8


def test_fm_index_finds_all_occurrences():
    rng = np.random.default_rng(5)
    text = np.concatenate(([0], rng.integers(0, 5, 400), [0], rng.integers(1, 3, 300)))
    order = suffix_array(text)
    assert sorted(order) == list(range(len(text)))
    index = FMIndex(text, 6, sample=7)
    patterns = [np.array(p) for p in ([1], [2, 1], [1, 2, 2, 1], [4, 4], [3, 1, 2], [5], [2] * 5)]
    low, high = index.search(patterns)
    for p, a, b in zip(patterns, low, high):
        want = [i for i in range(len(text) - len(p) + 1) if (text[i : i + len(p)] == p).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def slow_leaks(docs, items):
    windows = defaultdict(set)
    for i, t in items:
        w = WORDS.findall(ascii_lower(t))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(str(i))
    out = {}
    for d, t in docs:
        w, hit, found = WORDS.findall(ascii_lower(t)), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if ids := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= ids
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("options", [{}, {"block_chars": 60, "shard_words": 100}])
@pytest.mark.parametrize("least", [0, 4])
def test_leaks(spark, options, least):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice("aB c é 9 d, E!".split()) for _ in range(rng.randrange(60)))) for i in range(120)] + [(900, None), (901, ""), (902, "a b " * 9000)]
    items = [(i, " ".join(rng.choice("a b c é 9 d e".split()) for _ in range(rng.choice([1, 2, 3, 4, 6, 12])))) for i in range(20)] + [(77, docs[3][1]), (78, docs[3][1]), (79, None)]
    items = [(i, t) for i, t in items if least == 0 or len((t or "").split()) >= least]
    frame = lambda rows, key: spark.createDataFrame(rows, f"{key} long, text string")
    out = decontaminate.leak_report(frame(docs, "doc_id"), frame(items, "item_id"), **options).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in out} == slow_leaks(docs, items)


def test_leaks_of_odd_rows(spark, odd, empty):
    bench = spark.createDataFrame([(7, "C D", "x"), (None, "e", "y")], "item_id long, text string, doc_id string")
    out = decontaminate.leak_report(odd, bench).collect()
    assert len(out) == len(ODD) and {r["doc_id"] for r in out if r["contaminated"]} == {1, 4}
    left = decontaminate.drop_leaks(odd, bench)
    assert left.columns == odd.columns and left.count() == len(ODD) - 3
    assert decontaminate.leak_report(empty, bench).count() == 0
    assert decontaminate.leak_report(odd, bench.limit(0)).filter("contaminated").count() == 0
    cut = {r["doc_id"]: r["text"] for r in decontaminate.cut_leaks(odd, bench).collect()}
    assert cut[1] == "a b  e" and cut[2] is None
    assert decontaminate.find_leaks(odd, bench).columns == [*odd.columns, "__leaks"]
