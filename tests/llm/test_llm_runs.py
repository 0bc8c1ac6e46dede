"""Runs of words against brute force, the tables they come from, and the query."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tracelume.llm import queries, runs

RND = random.Random(7)


def brute(w):
    """Every maximal repetition, with its least period."""
    least = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            if w[i] == w[i + p]:
                j = i
                while j + p < len(w) and w[j] == w[j + p]:
                    j += 1
                if j - i >= p:
                    least.setdefault((i, j + p), p)
                i = j
            i += 1
    return sorted((a, b, p) for (a, b), p in least.items())


def texts():
    out = [[], [1], [1, 1], [1] * 50, [1, 2] * 30, [1, 2, 3] * 9 + [1, 2], list(range(30)), [1, 1, 2] * 7 + [5] + [1, 1, 2] * 7]
    x, y = [0], [0, 1]
    for _ in range(8):
        x, y = y, y + x
    out += [y, [3] + y + y]
    for k in range(400):
        w = [RND.randrange(RND.choice([1, 2, 2, 3, 4, 9])) for _ in range(RND.randrange(45))]
        if w and k % 3 == 0:
            a = RND.randrange(len(w))
            p = 1 + (len(w) - a) // RND.randrange(2, 9)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        out.append(w)
    return out


@pytest.mark.parametrize("together", [1, 7, 1000])
def test_all_maximal_repetitions(together):
    every = texts()
    for g in range(0, len(every), together):
        group, at, want = every[g : g + together], 0, []
        for w in group:
            want += [(a + at, b + at, p) for a, b, p in brute(w)]
            at += len(w)
        flat = np.array([x for w in group for x in w], np.int64)
        assert sorted(runs.all_runs(flat, np.array([len(w) for w in group]))) == want


def test_tables():
    for w in texts()[:120]:
        if not w:
            continue
        s = runs.Suffixes(np.array(w), np.array([len(w)]))
        assert s.order.tolist() == sorted(range(len(w)), key=lambda i: w[i:])
        length, source = s.previous_factors()
        common = lambda i, j: next((k for k in range(len(w) - j) if w[i + k] != w[j + k]), len(w) - j)
        for i in range(len(w)):
            want = max((common(j, i) for j in range(i)), default=0)
            assert length[i] == want and (not want or (source[i] < i and common(source[i], i) >= want))
        starts = runs.blocks_of(length).tolist()
        assert starts[0] == 0 and all(b - a == max(1, length[a]) for a, b in zip(starts, [*starts[1:], len(w)]))


def expected(i, words):
    n, h = len(words), zlib.crc32(str(i).encode()) if i is not None else None
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[j] if j < a else words[a + (j - a) % p] for j in range(n)]
    found = sorted(((a, b - a, p) for a, b, p in brute(words) if b - a >= max(6, 4 * p)), key=lambda r: (r[0], r[2]))
    gone = {k for a, n_, p in found for k in range(a + p, a + n_)}
    top = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    kept = " ".join(w for k, w in enumerate(words) if k not in gone)
    return (i, len(found), *(top or (None,) * 3), top and 1000 * top[1] // top[2], sha("".join(f"{a},{b},{p}\n" for a, b, p in found)), sha(kept))


def test_query(spark, tmp_path):
    rows = [(k, " \t".join(f"é{x}" for x in w) + "\n") for k, w in enumerate(texts()[:200])]
    rows += [(300, None), (301, ""), (302, " \n "), (303, "a " * 3000), (304, "x y z  q " * 500), (5, "b b b b b b"), (5, "b b b b b b"), (None, "c c c c c c c"), (305, "a b a b a b a b a b a b a b")]
    spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, h long, runs int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_runs(spark, str(tmp_path)).collect()
    want = [expected(i, [w.decode() for w in (t or "").encode().split()]) for i, t in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert sum(w[1] > 0 for w in want) > 40 and any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows)


def test_general(spark):
    docs = spark.createDataFrame([(1, "a b a b a", 5, "x")], "id long, body string, runs int, in_0 string")
    row = runs.with_runs(docs, "body", least=2, power=2).first()
    assert row.asDict()["runs"] == [(0, 5, 2)] and (row.n_words, row.collapsed, row.in_0, row.id) == (5, "a b", "x", 1)
    assert runs.with_runs(docs.limit(0), "body").collect() == []
    with pytest.raises(ValueError):
        runs.with_runs(docs, "body", power=1)
