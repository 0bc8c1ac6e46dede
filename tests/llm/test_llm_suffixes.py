"""Repeated strings against brute force, and the levels of the index."""

import hashlib

import numpy as np
import pytest

from tracelume.llm import suffixes

RNG = np.random.default_rng(11)


def brute(rows, width):
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - width + 1):
            s = b[k : k + width]
            if i is not None and i < least.get(s, i + 1):
                least[s] = i
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if i is not None and least[b[k : k + width]] < i:
                gone[k : k + width] = b"\1" * width
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=str)


def noise(n):
    return "".join(RNG.choice(list("abcdé \n\x00"), n))


def corpus():
    shared = [noise(n) for n in (49, 50, 51, 90, 400)]
    rows = [(k, noise(40 + k)) for k in range(40)]
    rows += [(100 + k, noise(k % 7) + shared[k % 5] + noise(k % 11) + shared[(k * 3) % 5]) for k in range(60)]
    rows += [(3, shared[4]), (3, shared[4]), (None, shared[4]), (None, None), (200, None), (201, ""), (202, "x" * 49), (203, "x" * 50), (204, "x" * 3000), (205, "ab" * 900 + "x" * 60)]
    rows += [(300 + k, shared[3] + str(k) * 60) for k in range(30)] + [(400 + k, "é" * 40 + noise(30)) for k in range(5)] + [(7, shared[2]), (-5, shared[2] + "end")]
    return rows


@pytest.mark.parametrize("settings", [{}, {"block": 500, "shard": 900}, {"block": 2000, "shard": 700, "hot": 1}, {"width": 30, "block": 700, "hot": 8}, {"width": 200, "block": 900}])
def test_bytes_removed(spark, settings):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1, "x", b"y") for r in rows], "doc_id long, text string, block long, said string, data binary").repartition(3)
    want = brute(rows, settings.get("width", 50))
    got = suffixes.without_repeats(docs, digests=True, **settings)
    assert sorted(map(tuple, got.collect()), key=str) == sorted((w[:5] for w in want), key=str)
    kept = suffixes.without_repeats(docs, **settings).collect()
    assert sorted(((r.doc_id, bytes(r.kept)) for r in kept), key=str) == sorted(((w[0], w[5]) for w in want), key=str)


def test_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.without_repeats(none).collect() == []
    one = spark.createDataFrame([(None, "a" * 80), (None, "a" * 80)], "doc_id long, text string")
    assert [bytes(r.kept) for r in suffixes.without_repeats(one).collect()] == [b"a" * 80] * 2
    with pytest.raises(ValueError):
        suffixes.without_repeats(none, width=24)


def test_levels_are_few_and_find_all():
    index, seen, merged = suffixes.Levels(), {}, 0
    for n in [5, 300, 1, 40, 40, 40, 700, 3, 64, 64, 900]:
        keys = np.unique(RNG.integers(0, 6, (n, 3)).astype(np.uint64) << np.uint64(60), axis=0)
        for k, s in zip(map(tuple, keys.tolist()), index.add(keys).tolist()):
            assert seen.setdefault(k, s) == s
        sizes = [len(k) for k, _ in index.levels]
        assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:])) and sum(sizes) == len(seen) == index.slots
        for keys, slots in index.levels:
            rows = list(map(tuple, keys.tolist()))
            assert rows == sorted(set(rows)) and [seen[r] for r in rows] == slots.tolist()
        merged += len(index.levels) == 1
    assert merged


def test_equal_strings_sample_equal_suffixes():
    text = RNG.integers(97, 101, 5000).astype(np.uint8).tobytes()
    data = b"".join([text, b"?" * 37, text[1000:1300]])
    ends = np.array([len(text), len(data)])
    at, first, many, doc = suffixes.sampled(suffixes._padded(data), ends)
    owner = {}
    for a, f, m in zip(at, first, many):
        assert 0 <= a - f - m + 1 and a + suffixes.DEPTH <= f + 50
        owner |= {f + j: a - f - j for j in range(m)}
    assert sorted(owner) == [*range(len(text) - 49), *range(len(text), len(data) - 49)]
    assert all(owner[1000 + j] == owner[len(text) + 37 + j] for j in range(250))
    array, n, which = suffixes.suffix_array(suffixes._padded(data), at, doc)
    pieces = [data[a : a + suffixes.DEPTH] for a in at]
    assert [bytes(k.astype(">u8").tobytes()) for k in array] == sorted(set(pieces))
    assert all(sorted(set(pieces))[w] == p for w, p in zip(which, pieces))
    assert n.tolist() == [len({d for p, d in zip(pieces, doc) if p == k}) for k in sorted(set(pieces))]
