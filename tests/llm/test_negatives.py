import random

import numpy as np
from pyspark.sql import functions as F

from loamwork.llm.hard_negatives import best_of, mine, quantised

SCHEMA = "vec_id long, embedding array<float>, label int, norm string, q string"


def plain(rows, scale=256):
    kept = {}
    for i, vector, label, *_ in rows:
        if i is None or label is None or vector is None or any(x is None or not np.isfinite(x) for x in vector):
            continue
        q = [int(np.floor(np.float64(np.float32(x)) * scale)) for x in vector]
        label = int(np.fmod(label + 1, 10)) if i % 7 == 0 else label
        kept[i] = min(kept.get(i, (label, q)), (label, q))
    out = []
    for a in (i for i in kept if i % 50 == 0):
        score = lambda b: sum(x * y for x, y in zip(kept[a][1], kept[b][1], strict=False))  # noqa: E731, B023
        others = sorted((-score(b), b) for b in kept if b != a)
        for s, p in [(s, b) for s, b in others if kept[b][0] == kept[a][0]][:5]:
            fit = [(t, b) for t, b in others if kept[b][0] != kept[a][0] and -50 * s <= -100 * t <= -95 * s][:3]
            out += [(a, p, rank, b, -s, -t) for rank, (t, b) in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows, **how):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = quantised(spark.createDataFrame(rows, SCHEMA).repartition(3), "vec_id", "embedding", label)
    found = mine(vectors, F.col("vec_id") % 50 == 0, **how)
    return sorted(map(tuple, found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


def test_as_by_brute_force_over_many_waves_of_small_buckets(spark):
    r = random.Random(5)
    rows = [(i, [r.gauss(0, 1) * r.choice([0.01, 0.1, 1, 3]) for _ in range(6)], r.randrange(3), "x", "x") for i in range(700)]
    want = plain(rows)
    assert len(want) > 50
    assert mined(spark, rows, bucket_rows=50, block_rows=5, first_wave=2) == want
    assert mined(spark, rows) == want


def test_odd_rows(spark):
    one = [0.5, -0.25, 1.0]
    rows = [(i, one, i % 2, "x", "x") for i in range(1, 120)]  # one vector a third of the time and more
    rows += [(i, [0.1 * (i % 7), 0.3, -0.2], i % 3, "x", "x") for i in range(120, 260)]
    rows += [(50, one, 1, "x", "x"), (50, one, 0, "x", "x"), (None, one, 1, "x", "x"), (300, None, 1, "x", "x"), (301, one, None, "x", "x"), (302, [1.0, None], 1, "x", "x")]
    rows += [(303, [float("nan"), 1.0], 1, "x", "x"), (304, [float("inf")], 1, "x", "x"), (350, [], 1, "x", "x"), (351, [2.0], 0, "x", "x"), (400, [0.5] * 9, 9, "x", "x")]
    assert mined(spark, rows, bucket_rows=32, block_rows=2, first_wave=1) == plain(rows)


def test_empty_table_and_an_anchor_alone(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, [1.0], 1, "x", "x"), (3, [1.0], 4, "x", "x")]) == []


def test_best_of_breaks_ties_by_id():
    scores = np.array([[5, 7, 7, 7, 1]])
    row, col = best_of(scores, np.array([[True, True, True, True, True]]), np.array([4, 9, 3, 5, 0]), 2)
    assert row.tolist() == [0, 0] and col.tolist() == [2, 3]
