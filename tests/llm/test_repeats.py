"""Repeated strings against brute force, and induced sorting against plain sorting."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from attestra.llm import induced_sort, repeats
from tests.llm.conftest import ODD


def brute(rows, width):
    texts = [(t or "").encode() for _, t in rows]
    counts = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for (i, _), t in zip(rows, texts):
        gone = bytearray(len(t) + 1)
        for a in range(len(t) - width + 1):
            if counts[t[a : a + width]] > 1:
                gone[a : a + width] = b"\1" * width
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(t)))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(df, **options):
    return sorted((tuple(r) for r in repeats.repeat_report(df, **options).collect()), key=str)


def corpus(rng, n, width):
    passage = "".join(rng.choice("abcdé ") for _ in range(3 * width))
    rows = []
    for i in range(n):
        text = "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(4 * width)))
        kind = rng.randrange(5)
        if kind == 0:
            text += passage[: rng.randrange(3 * width)] + text[: width // 2]
        if kind == 1 and rows:
            other = rng.choice(rows)[1] or ""
            at = rng.randrange(len(other) + 1)
            text = other[:at] + rng.choice(["", "x", "yz"]) + other[at:]
        if kind == 2:
            text += rng.choice(["a", "ab", "=- "]) * width
        rows.append((i, rng.choice([text, text, text, None, ""])))
    return rows


@pytest.mark.parametrize("seed, width", [(0, 12), (1, 30), (2, 64), (3, 400)])
def test_equals_brute_force(spark, seed, width, monkeypatch):
    rng = random.Random(seed)
    rows = corpus(rng, 80, width)
    rows += [(100 + k, rows[3][1]) for k in range(9)] + [(200, rows[5][1])] * 3 + [(300, "q" * 9 * width), (301, "r" * (width + 1)), (302, "s" * width)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows, width)
    assert found(df, width=width) == want and any(w[2] for w in want) and any(w[1] > w[2] > 0 for w in want)
    if width == 30:
        assert found(df, width=width, shard=500) == want


def test_common_passages_long_texts_and_bytes_beyond_utf8(spark, monkeypatch):
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdefghij") for _ in range(50))
    word = lambda n: "".join(rng.choice("klmnopqrst") for _ in range(n))
    rows = [(i, word(rng.randrange(30, 60)) + passage + word(rng.randrange(30, 60))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df, width=24) == brute(rows, 24)
    texts = df.selectExpr("doc_id AS id", "0L AS h", "CAST(text AS binary) AS text")
    common = repeats.common_bins(texts, 24)
    assert 0 < len(common) <= repeats.BINS // repeats.COMMON
    monkeypatch.setattr(repeats, "STRETCH", 100)  # texts in parts that overlap
    assert found(df, width=24) == brute(rows, 24)


def test_odd_rows(spark, odd, empty):
    assert found(odd, width=5) == brute(ODD, 5) and found(odd) == brute(ODD, 400)
    out = repeats.cut_repeats(odd.withColumnRenamed("host", "a.b"), width=5)
    assert out.columns == [*odd.withColumnRenamed("host", "a.b").columns, "_repeats"] and out.count() == len(ODD)
    assert found(empty) == []


@pytest.mark.parametrize("memory, block", [(1 << 26, 1 << 16), (64, 3)])
def test_suffixes_and_common_prefixes(memory, block, monkeypatch):
    monkeypatch.setattr(induced_sort, "MEMORY", memory)
    monkeypatch.setattr(induced_sort, "BLOCK", block)
    rng = np.random.default_rng(block)
    for trial in range(400):
        n, kinds, bound = int(rng.integers(0, 60)), int(rng.integers(1, 6)), int(rng.integers(1, 12))
        text = rng.integers(1, kinds + 1, n)
        if trial % 3 == 0 and n > 4:
            text = np.tile(text[: max(1, n // 4)], 5)
        text = np.append(text, 0).astype([np.uint8, np.uint16, np.int64][trial % 3])
        plain = text.tolist()
        order = sorted(range(len(plain)), key=lambda i: plain[i:])
        same = lambda a, b: next(k for k in range(bound + 1) if k == bound or plain[a + k : a + k + 1] != plain[b + k : b + k + 1])
        got, shared = induced_sort.sorted_suffixes(text, bound)
        assert got.tolist() == order and shared.tolist() == [0] + [same(a, b) for a, b in zip(order, order[1:])]
        assert induced_sort.sorted_suffixes(text)[0].tolist() == order


@pytest.mark.parametrize("top, ramp", [(200, [10, 20, 30, 40, 30, 20, 10]), (100, [10, 20, 30, 40, 50, 40, 30, 20, 10]), (1 << 20, [10, 20, 10])])
def test_seed_substrings_that_begin_longer_ones_and_end_with_a_word(top, ramp):
    assert len(ramp) % (63 // (top + 1).bit_length()) == 0
    rng = np.random.default_rng(top)
    for _ in range(50):
        text = [top]
        for _ in range(12):
            text += ramp + [[15], [4, 8], [5, 8]][int(rng.integers(3))]
        plain = [*text, 0]
        order = sorted(range(len(plain)), key=lambda i: plain[i:])
        got, shared = induced_sort.sorted_suffixes(np.array(plain, np.int64), 30)
        same = lambda a, b: next(k for k in range(31) if k == 30 or plain[a + k : a + k + 1] != plain[b + k : b + k + 1])
        assert got.tolist() == order and shared.tolist() == [0] + [same(a, b) for a, b in zip(order, order[1:])]
