"""Hard negatives against brute force: ties, copies, nulls, hot labels, many blocks."""

from math import floor, inf, nan

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelume.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, score long, rank int, a int, k int"


def sound(r):
    return None not in r[:3] and not any(x is None or x != x or abs(x) == inf for x in r[1])


def brute(rows, positives=5, negatives=5, low=80, high=100):
    known = [(r[0], [floor(256 * x) for x in r[1]], r[2]) for r in rows if sound(r)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for k, (i, v, label) in enumerate(known):
        if i % 10:
            continue
        others = sorted(((-dot(v, w), j, x) for m, (j, w, x) in enumerate(known) if m != k))
        for p, j, _ in [o for o in others if o[2] == label][:positives]:
            ok = [(s, m) for s, m, x in others if x != label and low * -p <= 100 * -s <= high * -p]
            out += [(i, j, n + 1, m, -p, -s) for n, (s, m) in enumerate(ok[:negatives])]
    return sorted(out)


def vectors():
    g = np.random.default_rng(3)
    centres = g.normal(size=(4, 7))
    rows = []
    for k in range(300):
        label = int(g.choice([0, 0, 1, 2, 3]))
        rows.append((k, (centres[label] + 0.8 * g.normal(size=7)).astype(np.float32).tolist(), label))
    rows += [(k, rows[k - 300][1], rows[k - 300][2]) for k in range(300, 330)]  # equal vectors, ties
    rows += [(10, rows[11][1], 0), (10, rows[10][1], rows[10][2]), (41, rows[41][1], 2)]
    rows += [(None, rows[0][1], 0), (340, None, 0), (350, rows[1][1], None), (360, [1.0, nan], 1), (370, [inf] * 7, 1), (380, [None, 1.0], 2)]
    rows += [(390, [], 0), (400, [1.0, 1.0], 0), (401, [2.0], 1), (410, rows[5][1], 99)]
    return [(*r, 9, 9, 9, 9) for r in rows]


@pytest.mark.parametrize("settings", [{}, {"block": 40, "chunk": 3}, {"block": 500, "chunk": 7, "negatives": 50, "low": 10}, {"block": 17, "chunk": 2, "positives": 2}])
def test_negatives(spark, settings):
    rows = spark.createDataFrame(vectors(), SCHEMA).repartition(3)
    got = hard_negatives.hard_negatives(rows, F.col("vec_id") % 10 == 0, **settings)
    want = brute(vectors(), **{k: v for k, v in settings.items() if k not in ("block", "chunk")})
    assert len(want) > 50 and sorted(map(tuple, got.collect())) == want


def test_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert hard_negatives.hard_negatives(none, F.col("vec_id") % 10 == 0).collect() == []
    one = spark.createDataFrame([(1, [1.0], 1, 0, 0, 0, 0)], SCHEMA)
    assert hard_negatives.hard_negatives(one, F.col("vec_id") % 10 == 0).collect() == []
    assert hard_negatives.hard_negatives(one, F.col("vec_id") == 1).collect() == []


def test_products_beyond_doubles_are_exact():
    a = np.array([[1 << 29, 3], [-(1 << 29), 1 << 29]], np.int64)
    want = [[sum(x * y for x, y in zip(p, q)) for q in a.tolist()] for p in a.tolist()]
    assert hard_negatives.product(a, a).tolist() == want
    assert hard_negatives.product(a >> 20, a >> 20).tolist() == [[sum(x * y for x, y in zip(p, q)) for q in (a >> 20).tolist()] for p in (a >> 20).tolist()]
