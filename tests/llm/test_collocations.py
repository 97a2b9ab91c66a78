"""Phrase collocations against brute force, and the trie's runs."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from attestra.llm import bit_filter, collocations, hat_trie
from tests.llm.conftest import ODD


def brute(rows, least, longest=5, top=2000, share=100):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")):
            ws = tuple(re.findall(r"[^ \t]+", piece))
            totals[lang] += len(ws)
            counts.update((lang, ws[i : i + k]) for k in range(1, longest + 1) for i in range(len(ws) - k + 1))
    cands = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in cands.items():
        score, _, l, r = min((1000 * a * totals[lang] // (l * r), k, l, r) for k in range(1, len(p)) for l, r in [(counts[lang, p[:k]], counts[lang, p[k:]])])
        if not any(x == lang and len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (x, q), b in cands.items()):
            out.append((lang, -score, -a, " ".join(p).encode(), l, r, totals[lang]))
    seen, ranked = Counter(), []
    for lang, s, a, p, l, r, n in sorted(out):
        seen[lang] += 1
        if seen[lang] <= top:
            ranked.append((lang, seen[lang], p.decode(), -a, l, r, n, -s))
    return ranked


def mined(spark, rows, **options):
    df = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 AS key", "2 AS n", "'x' AS `a.b`")
    return sorted(tuple(r) for r in collocations.collocations(df.repartition(3), **options).collect())


def corpus(rng, n):
    words = ["Red", "green", "blue", "é", "x\x1cy", "sea", " ", "of", "the", "long" * 30]
    gaps = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r", "\x0b"]
    return [(rng.choice(["en", "de", None, "und"]), "".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randrange(40)))) for _ in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed, monkeypatch):
    rows = corpus(random.Random(seed), 150) + [("en", "sea of the " * 200), ("en", None), ("en", ""), (None, "one")] + [("de", "Exact copy of red, green copy of red")] * 12
    want = brute(rows, 8)
    assert mined(spark, rows, least=8) == want and len(want) > 20
    if seed == 0:
        assert mined(spark, rows, least=8, top=3, share=60) == brute(rows, 8, top=3, share=60)
        assert mined(spark, rows, least=2, longest=2) == brute(rows, 2, longest=2)
        for name in ("WORDS", "REMEMBERED", "ENTRIES", "PART"):
            monkeypatch.setattr(collocations, name, 12)
        monkeypatch.setattr(bit_filter, "FILTER_BITS", 1 << 10)
        assert mined(spark, rows, least=8) == want


def test_only_sequences_that_may_be_frequent_reach_the_tries(spark):
    """Every pair of neighbours is frequent, of longer sequences only one."""
    rng = random.Random(5)
    rows = [(i, [rng.randrange(1, 9) for _ in range(60)] + [0] + [9, 10, 11, 12, 13] * 2 + [0]) for i in range(40)]
    df = spark.createDataFrame([("en", ids) for _, ids in rows], "lang string, ids array<long>").coalesce(1)
    hints = collocations.likely_sequences(df, 3000, 20, 5)
    ids = np.concatenate([np.array(ids) for _, ids in rows])
    sizes = {k: {tuple(key) for key in keys.tolist()} for k, (keys, _) in zip(range(2, 6), collocations.sequences(ids, range(2, 6), hints))}
    counts = {k: Counter(tuple(ids[i : i + k].tolist()) for i in range(len(ids) - k + 1) if (ids[i : i + k] != 0).all()) for k in range(2, 6)}
    for k in range(2, 6):
        frequent = {key for key, n in counts[k].items() if n >= 20}
        assert frequent <= sizes[k] and len(sizes[k]) <= len(frequent) + 3


def test_odd_rows(spark, odd, empty):
    out = collocations.collocations(odd, "fp", least=2)
    assert [tuple(r)[1:4] for r in out.collect()] == [r[1:4] for r in brute([("x", t) for _, t in ODD], 2)]
    assert collocations.collocations(empty, "extra").count() == 0


def test_ids_that_clash_get_another_salt(spark, monkeypatch):
    plain = collocations.word_id
    monkeypatch.setattr(collocations, "word_id", lambda salt: plain(salt) if salt else collocations.F.lit(7).cast("long"))
    words = spark.createDataFrame([("en", "a", 5), ("en", "b", 1)], "lang string, word string, n long")
    assert collocations.salt_of(words, 5) == "#" and collocations.salt_of(words, 6) == ""


def test_trie_bursts_and_spills_sorted_runs():
    rng = np.random.default_rng(0)
    trie, want, got = hat_trie.HatTrie(burst=20), Counter(), Counter()
    for k in (2, 3, 2, 5):
        keys = rng.integers(1, 9, (400, k))
        keys = keys[np.argsort(keys[:, 0], kind="stable")]
        counts = rng.integers(1, 5, 400)
        trie.add(keys, counts)
        for row, n in zip(keys, counts.tolist()):
            want[row.astype(">i8").tobytes()] += n
    assert trie.inner and trie.entries == len(want)
    for most in (300, 0):
        for keys, counts in trie.spill(most):
            assert keys == sorted(keys) and len({k[:8] for k in keys}) == 1
            got.update(dict(zip(keys, counts)))
        assert trie.entries <= most
    assert got == want
