"""Scores of the class model against plain Python on classes as found, and its perplexity on held-out text."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tracelume.llm import brown, scratch

HEAD, CORE, CLASSES, SLOTS = 40, 30, 6, 64


def corpus():
    """Texts of a small grammar, so that classes tell what comes next, and some words seen once."""
    r = np.random.default_rng(4)
    kinds = [[f"{k}{j}" for j in range(12)] for k in "abcd"]
    rows = []
    for k in range(150):
        x = [kinds[j % 4][r.integers(12)] for j in range(int(r.integers(1, 60)))]
        rows.append((k, " ".join([*x, f"Once{k}" + "x" * (k % 9)])))
    return rows + [(500, ""), (501, None), (None, "a0 b0 c0")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), "doc_id long, text string").repartition(3)


def test_scores_by_plain_python(spark, docs):
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    tokens = lambda t: [*(t or "").lower().split(), None]
    rows = docs.select("doc_id", docs.text.cast("binary").alias("b"), brown.held_out("doc_id").alias("held_out"))
    model, _, _ = brown.fit(scratch.Scratch(spark), rows, HEAD, CORE, CLASSES, SLOTS)
    count = Counter(t for d, x in corpus() if not held(d) for t in tokens(x))

    def cls(t):
        return int(model.classes[model.end if t is None else model.unit(np.array([brown.word_key(t.encode())]))[0]])

    n, moves = len(model.transition), Counter()
    for d, x in corpus():
        if not held(d):
            k = [cls(t) for t in tokens(x)]
            moves.update(zip([cls(None), *k[:-1]], k))
    g = np.array([[moves[i, j] for j in range(n)] for i in range(n)], float)
    prior = (g.sum(0) + 1) / (g.sum() + n)
    p_class = (g + brown.PRIOR * prior) / (g.sum(1, keepdims=True) + brown.PRIOR)
    assert np.allclose(p_class.sum(1), 1)
    size, kinds = Counter(), Counter()
    for t, c in count.items():
        size[cls(t)] += c
        kinds[cls(t)] += 1
    # room for one unseen word in every class
    emit = lambda t: (count[t] + 0.5) / (size[cls(t)] + 0.5 * (kinds[cls(t)] + 1))
    for k in range(n):
        assert sum(emit(t) for t in count if cls(t) == k) + 0.5 / (size[k] + 0.5 * (kinds[k] + 1)) == pytest.approx(1)
    got = {r.doc_id: r for r in brown.scored(docs, head=HEAD, clustered=CORE, classes=CLASSES, slots=SLOTS).collect()}
    for d, x in corpus():
        k = [cls(None), *map(cls, tokens(x))]
        want = sum(math.log10(p_class[a, b]) + math.log10(emit(t)) for a, b, t in zip(k, k[1:], tokens(x)))
        assert got[d].score == pytest.approx(want, abs=1e-8)
        assert got[d].perplexity == pytest.approx(10 ** (-want / len(tokens(x))), rel=1e-8)


def test_classes_lower_perplexity_on_held_out_text(docs):
    found = {r.held_out: r for r in brown.perplexity(brown.scored(docs, head=HEAD, clustered=CORE, classes=CLASSES, slots=SLOTS)).collect()}
    assert found[True].n_tokens > 500 and found[True].perplexity < 0.6 * found[True].base_perplexity
    assert found[False].perplexity <= found[True].perplexity


def test_every_word_joins_its_kind(spark):
    """Of four kinds of words that follow each other, those outside the exchange, in the head or hashed, join the class of their kind."""
    r = np.random.default_rng(7)
    kinds = [[f"{k}{j}" for j in range(40)] for k in "abcd"]
    weights = 1 / (1 + np.arange(40))
    rows = [(k, " ".join(kinds[j % 4][r.choice(40, p=weights / weights.sum())] for j in range(120))) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    some = docs.select("doc_id", docs.text.cast("binary").alias("b"), brown.held_out("doc_id").alias("held_out"))
    model, _, _ = brown.fit(scratch.Scratch(spark), some, 100, 40, 4, 1 << 16)
    of = {w: int(model.classes[model.unit(np.array([brown.word_key(w.encode())]))[0]]) for k in kinds for w in k}
    most = [Counter(of[w] for w in k).most_common(1)[0] for k in kinds]
    assert len({c for c, _ in most}) == 4 and all(n >= 38 for _, n in most)
