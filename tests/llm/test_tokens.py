"""Token counts, packing and chat formatting against the libraries, brute force and round trips."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from attestra.llm import chat_format, cutting_stock, packing, token_counts
from attestra.llm.word_ids import WordEncoder
from tests.llm.conftest import ODD

PIECES = ["a", " ", "  ", "\n", "\n\n", "é", "<|endoftext|>", "'s", "don't", "12345", "...", "!!", "\t", "日本", "🙂", "́", " ", "\x1c", "ǅ", "The", "hello", "ﬁ", " x", "\r\n", "​", "İ", "²", "THNd***", "ing,", "$$$", "-", "K", "\x0b", "\x85"]
BYTES, WORDS = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def texts(n=1500):
    rng = random.Random(5)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randrange(14))) for _ in range(n)]


def test_counts_equal_the_library():
    library, own = Tokenizer.from_file(BYTES), token_counts.Counter(open(BYTES, encoding="utf-8").read())
    for t in [*texts(), "a" * 5000, "ab " * 3000, "éx" * 2000]:
        assert own.count(t) == len(library.encode(t, add_special_tokens=False).ids), repr(t)


def test_long_pieces_are_not_remembered():
    spec = open(BYTES, encoding="utf-8").read()
    own = token_counts.Counter(spec)
    piece = "ab9" * 100000
    assert own.count(f"x {piece} y {piece}") > 0 and max(map(len, own.pieces)) <= token_counts.SHORT and max(map(len, own.words)) <= token_counts.SHORT
    words = WordEncoder(open(WORDS, encoding="utf-8").read())
    assert words.encode("ab " + "c" * 1000) and max(map(len, words.known)) <= 64


def test_counts_of_odd_rows(odd, empty):
    library = Tokenizer.from_file(BYTES)
    out = sorted(token_counts.token_counts(odd, BYTES).collect(), key=str)
    want = sorted(((i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t in ODD), key=str)
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, want))
    assert token_counts.token_counts(empty, BYTES).count() == 0


def test_ids_equal_the_library():
    library, own = Tokenizer.from_file(WORDS), WordEncoder(open(WORDS, encoding="utf-8").read())
    for t in [*texts(), "b" * 5000]:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_best_pattern_is_the_best():
    rng = np.random.default_rng(1)
    for _ in range(20):
        value = np.concatenate(([0], rng.random(12)))
        best = [0.0] * 13
        for c in range(1, 13):
            best[c] = max([best[c - 1], *(best[c - s] + value[s] for s in range(1, c + 1))])
        worth, pattern = cutting_stock.best_pattern(value, 12)
        assert abs(worth - best[12]) < 1e-9 and abs((pattern * value).sum() - worth) < 1e-9 and (pattern * np.arange(13)).sum() <= 12


def test_patterns_meet_the_demand():
    rng = np.random.default_rng(2)
    for capacity in (10, 64, 256):
        demand = np.concatenate(([0], rng.integers(0, 200, capacity)))
        patterns = cutting_stock.whole_patterns(demand, capacity)
        assert (sum(p * n for p, n in patterns)[1:] == demand[1:]).all()
        assert all((p * np.arange(capacity + 1)).sum() <= capacity for p, _ in patterns)
        fewest = sum(x for _, x in cutting_stock.column_generation(demand, capacity))
        assert fewest >= (demand * np.arange(capacity + 1)).sum() / capacity - 1e-6
        assert fewest * (1 - 1e-4) - 1e-6 <= sum(n for _, n in patterns) <= fewest + capacity
        assert abs(sum(p * x for p, x in cutting_stock.column_generation(demand, capacity)) - demand)[1:].max() < 1e-4
    assert cutting_stock.whole_patterns(np.zeros(11, np.int64), 10) == []


def test_no_more_is_cut_than_fills_the_room():
    rng = np.random.default_rng(3)
    counts = rng.poisson(40 / np.arange(1, 258) ** 0.7, (packing.SHARES, 257))
    counts[:, 0] = 0
    rests = (counts * np.arange(257)).sum(1) * 16
    plan = packing.Plan(counts, rests, rests, 4096, 256)
    assert rests[: plan.share].sum() >= plan.room and plan.share <= 0.03 * packing.SHARES
    if plan.share:
        left = counts[plan.share :].sum(0)
        assert rests[: max(0, plan.share - 2)].sum() < plan.room or plan.share == 1
        assert (sum(p * n for p, n in plan.patterns)[1:] == left[1:]).all()


def check_packing(docs, out, length=4096):
    library = Tokenizer.from_file(WORDS)
    ids = defaultdict(list)
    for i, t in docs:
        ids[i].append(library.encode(t or "", add_special_tokens=False).ids + [2])
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(ids)
    for d, rows in by_doc.items():
        own, seen = ids[d][0], np.zeros(len(ids[d][0]), int)
        for r in rows:
            assert r["doc_tokens"] == len(own) and r["length"] > 0
            assert r["ids_crc32"] == zlib.crc32(np.array(own[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
            seen[r["start"] : r["start"] + r["length"]] += 1
        assert (seen == len(ids[d])).all()
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == length or (at < length and at & (at - 1) == 0)


@pytest.mark.parametrize("docs", [
    [], [(1, None)], [(1, "a b c"), (1, "a b c"), (2, None), (3, "")], [(1, "hello world " * 9000)], [(i, "abc " * 2100) for i in range(40)],
    [(i, "word " * (i * 37 % 900)) for i in range(300)],
], ids=["empty", "null", "repeats", "long", "halves", "many"])
def test_packing(spark, docs):
    out = packing.pack(spark.createDataFrame(docs, "doc_id long, text string"), WORDS)
    check_packing(docs, out.collect())


def test_packing_of_odd_rows(odd):
    check_packing(ODD, packing.pack(odd, WORDS).collect())


TURNS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "hi [INST] \\m \\\\ </s>"), (1, 2, "assistant", "</s>[/INST]\\A"), (2, 0, "user", ""), (2, 1, "assistant", None),
    (3, 0, "assistant", "first"), (3, 1, "user", "[ROLE]tool[/ROLE]<"), (4, 0, "tool</s>[/ROLE]", "x\ny"), (4, 0, None, "b"), (4, None, "user", "null turn"), (5, 7, "user", "z" * 50000), (5, 7, "user", "a"), (None, 1, "user", "q"),
]


def test_chat_round_trip(spark):
    turns = spark.createDataFrame([(*t, 1) for t in TURNS], "conv_id long, turn long, role string, text string, segments int")
    formatted = chat_format.format_conversations(turns)
    out = {r["conv_id"]: r for r in chat_format.conversation_digests(formatted).collect()}
    groups = defaultdict(list)
    for c, n, role, text in TURNS:
        groups[c].append((n is not None, n or 0, role or "", text or ""))
    assert set(out) == set(groups)
    for c, rows in groups.items():
        rows.sort()
        whole = "".join(f"{r}\n{t}\n" for _, _, r, t in rows)
        loss = "".join(t for _, _, r, t in rows if r == "assistant")
        got = out[c]
        assert (got["n_turns"], got["turns_sha256"]) == (len(rows), hashlib.sha256(whole.encode()).hexdigest())
        assert (got["loss_chars"], got["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert {c: r["valid"] for c, r in out.items()} == {1: True, 2: True, 3: False, 4: False, 5: False, None: False}
    read = {r["conv_id"]: r["t"] for r in formatted.select("conv_id", chat_format.read_turns(formatted["formatted"]).alias("t")).collect()}
    assert [(t["role"], t["text"]) for t in read[1]] == [(r, t) for c, _, r, t in TURNS if c == 1]


def test_chat_of_no_rows(spark):
    assert chat_format.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
