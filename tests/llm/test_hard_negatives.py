import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from monthmatch.llm.hard_negatives import inner_products, mine_hard_negatives


def by_hand(vectors, least=80):
    rows = []
    for vec_id, embedding, label in vectors:
        if label is None or embedding is None or not all(x is not None and math.isfinite(x) for x in embedding):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = int(math.fmod(label + 1, 10))
        rows.append((vec_id, label, [math.floor(256 * float(np.float32(x))) for x in embedding]))
    out = []
    for a in rows:
        if a[0] is None or a[0] % 100:
            continue
        scored = sorted(
            (-sum(x * y for x, y in zip(a[2], b[2])), b[0] is None, b[0] or 0, b[1]) for b in rows if b is not a
        )
        for p in [s for s in scored if s[3] == a[1]][:5]:
            fit = [s for s in scored if s[3] != a[1] and least * -p[0] <= 100 * -s[0] <= 100 * -p[0]][:5]
            for rank, s in enumerate(fit, 1):
                out.append((a[0], None if p[1] else p[2], rank, None if s[1] else s[2], -p[0], -s[0]))
    return sorted(out, key=repr)


def mined(spark, vectors, **more):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int")
    df = df.withColumns({c: F.lit("x") for c in ("row", "q", "anchor", "score", "slot")})
    return sorted((tuple(r) for r in mine_hard_negatives(df, **more).collect()), key=repr)


@pytest.mark.parametrize(("labels", "spread"), [(2, 0.3), (5, 1.0), (10, 0.02)])
def test_against_brute_force(spark, labels, spread):
    rng = np.random.default_rng(labels)
    middle = rng.normal(size=8)
    vectors = [
        (i, (middle + spread * rng.normal(size=8)).round(2).tolist(), int(rng.integers(0, labels))) for i in range(450)
    ]
    want = by_hand(vectors)
    assert want and mined(spark, vectors) == want
    # One block for each anchor or so.
    assert mined(spark, vectors, anchor_bytes=100) == want


def test_rows_of_all_kinds(spark):
    one = [1.0, 0.5]
    vectors = [
        (0, one, 9), (0, one, 9), (100, one, 9), (200, [0.0, 0.0], 1), (300, None, 1), (400, one, None),
        (500, [1.0, float("nan")], 1), (600, [1.0, None], 1), (700, [float("inf"), 1.0], 1), (None, one, 1),
        (None, one, 9), (None, None, None), (1, [-1.0, -0.5], 9), (2, [1.0], 9), (3, one, 0), (3, one, 0), (4, one, 2),
        (5, [], 3), (6, [1.0, 0.5, 0.25], 4), (8, [0.9, 0.5], -1), (9, [0.9, 0.5], 9), (800, [], 3), (900, [-1.0, 0.1], 2),
    ]
    assert mined(spark, vectors) == by_hand(vectors)


def test_ties_and_equal_positives(spark):
    vectors = [(100, [1.0, 0.0], 1)]
    vectors += [(i, [1.0, 0.0], 1) for i in range(1, 5)] + [(6, [0.5, 0.0], 1)]
    vectors += [(i, [x, 1.0], 2) for i in range(10, 60, 3) for x in (1.0, 0.9, 0.5, 0.4)]
    assert mined(spark, vectors) == by_hand(vectors)


def test_empty_tables_and_no_anchors(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []
    assert mined(spark, [(100, [1.0], 1)]) == []


def test_large_components_are_exact():
    left = np.asarray([[2**40, 3], [-(2**62), 2**62]])
    right = np.asarray([[2**20 + 1, 7], [2, 0]])
    got = inner_products(left, right)
    assert got[0].tolist() == [2**60 + 2**40 + 21, 2**41]
    assert got[1].tolist() == [-(2**63), -(2**63)]
