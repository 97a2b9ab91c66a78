"""Hard negatives against brute force: ties, odd rows, numbers beyond what doubles hold, many blocks and lowered thresholds."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestra.llm import hard_negatives, threshold_join


def brute(rows, positives=5, negatives=5, low=80, high=100, every=10):
    ok = [(i, l, v) for i, l, v in rows if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    best = {}
    for i, l, v in ok:
        best[i] = min(best.get(i, (l, v)), (l, v))
    whole = {i: (l, [math.floor(256.0 * x) for x in v]) for i, (l, v) in best.items()}
    out = []
    for a, (la, va) in whole.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, v)), i) for i, (l, v) in whole.items() if i != a and l == la)[:positives]
        others = sorted((-sum(x * y for x, y in zip(va, v)), i) for i, (l, v) in whole.items() if l != la)
        for p, pid in scored:
            window = [(n, nid) for n, nid in others if low * -p <= 100 * -n <= high * -p][:negatives]
            out += [(a, pid, k + 1, nid, -p, -n) for k, (n, nid) in enumerate(window)]
    return sorted(out)


def mined(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("slot", F.lit("x")).withColumn("a.b", F.lit(1))
    return sorted(tuple(r) for r in hard_negatives.hard_negatives(df.repartition(3), F.col("vec_id") % 10 == 0, F.col("label"), **options).collect())


@pytest.mark.parametrize("size, scale, coarse", [(8, 1.0, True), (40, 1.0, False), (20, 1e3, False), (3, 1e6, False)])
def test_equals_brute_force(spark, size, scale, coarse):
    rng = np.random.default_rng(size)
    shift = rng.normal(0, 0.3, size)
    vec = lambda: [float(x) for x in (np.round(v * 2) / 256 if coarse else v * scale)] if (v := rng.normal(0, 1, size) + shift) is not None else None
    rows = [(i, int(rng.integers(0, 3)), vec()) for i in range(150)]
    want = brute(rows)
    assert mined(spark, rows) == want and want
    if scale == 1.0:
        assert mined(spark, rows, block_numbers=size * 4, sample=16) == want
        assert mined(spark, rows, positives=2, negatives=30, low=10, high=90, sample=8) == brute(rows, 2, 30, 10, 90)


def test_odd_rows(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(2), [rng.gauss(0, 1) for _ in range(4)]) for i in range(40)]
    rows += rows[:12]  # repeats
    rows += [(0, 1, [0.5, 0.5, 0.5, 0.5]), (None, 1, [1.0] * 4), (70, None, [1.0] * 4), (80, 0, None), (81, 0, [1.0, None, 1.0, 1.0]), (90, 1, [math.nan] * 4), (91, 1, [1.0, math.inf, 1.0, 1.0])]
    rows += [(100, 0, []), (101, 0, [0.0] * 4), (102, 1, [1.0, 1.0]), (110, 1, [2.0])]
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, [(10, 0, [1.0])]) == [] and mined(spark, [(10, 0, [1.0]), (11, 0, [1.0])]) == []
    nobody = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert hard_negatives.hard_negatives(nobody, F.col("vec_id") % 10 == 0, F.col("label")).count() == 0


def test_the_index_leaves_out_what_norms_cover_and_loses_nothing():
    rng = np.random.default_rng(0)
    rows = np.floor(256 * rng.normal(0, 0.1, (300, 64)) * np.linspace(3, 0.05, 64))
    kind = threshold_join.number_type(np.abs(rows).max(), 64)
    anchors = threshold_join.Anchors(rows[:20], kind)
    scores = rows[:20] @ rows.T
    for share in (0.5, 0.9, 0.99, 0.9999):
        least = np.quantile(scores, share, axis=1)
        least[3] = np.inf
        a, r, s = anchors.join(rows, least)
        assert {(i, j) for i, j in zip(a.tolist(), r.tolist())} == {(i, j) for i, j in np.argwhere(scores >= least[:, None]).tolist()}
        assert (s == scores[a, r]).all()
    assert threshold_join.number_type(256.0, 64) is np.float32 and threshold_join.number_type(1e6, 64) is np.float64 and threshold_join.number_type(1e9, 64) is object
