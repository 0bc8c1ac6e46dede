"""The robust estimate and its verdicts against numpy, on groups of all sizes, copies, and degenerate groups."""

import math

import numpy as np
import pytest

from tracelume.llm import quality_rules as q
from tracelume.llm import scratch

D = len(q.VECTOR)
#: Vectors here are no counts, so their axes have no units.
NONE = (0.0,) * D
ROWS = "g long, " + ", ".join(f"{v} double" for v in q.VECTOR)


def mcd(x, alpha=q.ALPHA, starts=60, seed=1):
    """Textbook search: random starts, whole concentration, least determinant, consistency, reweighting."""
    r, best, h = np.random.default_rng(seed), None, math.ceil(alpha * len(x))
    dist = lambda m, c, of: np.einsum("ij,jk,ik->i", of - m, np.linalg.inv(c), of - m)
    for _ in range(starts):
        some = x[r.choice(len(x), 4 * D, replace=False)]
        m, c, last = some.mean(0), np.cov(some.T, bias=True), math.inf
        while True:
            near = x[np.argsort(dist(m, c, x), kind="stable")[:h]]
            m, c = near.mean(0), np.cov(near.T, bias=True)
            ld = np.linalg.slogdet(c)[1]
            if ld >= last - 1e-12:
                break
            last = ld
        if best is None or ld < best[0]:
            best = ld, m, c
    ld, m, c = best
    c = c * q.consistency(alpha)
    near = x[dist(m, c, x) <= q.chi2_quantile(0.975, D)]
    m, c = near.mean(0), np.cov(near.T, bias=True) * q.consistency(0.975)
    return ld, m, c, dist(m, c, x)


def groups():
    r = np.random.default_rng(8)
    out = {}
    for g, (n, bad) in enumerate([(800, 0.0), (600, 0.2), (150, 0.1)]):
        mix = np.eye(D) + 0.5 * r.standard_normal((D, D))
        x = r.standard_normal((n, D)) @ mix + np.arange(D)
        k = int(bad * n)
        x[:k] = np.arange(D) + 14 * mix[0] + 0.3 * r.standard_normal((k, D))  # a cluster of its own, which draws mean and covariance
        out[g] = x
    return out


def test_chi_squared():
    assert q.chi2_quantile(0.95, 1) == pytest.approx(3.841459, abs=1e-5) and q.chi2_quantile(0.975, 5) == pytest.approx(12.832502, abs=1e-5)
    assert q.chi2_cdf(4.351460, 5) == pytest.approx(0.5, abs=1e-6) and q.chi2_cdf(0, 3) == 0.0


def test_estimates_match_a_search_with_many_starts(spark):
    s, of = scratch.Scratch(spark), groups()
    rows = s.table(spark.createDataFrame([(g, *map(float, v)) for g, x in of.items() for v in x], ROWS).repartition(5), "rows")
    raw = {r.g: r for r in q.concentrated(s, rows, units=NONE).collect()}
    found = {r.g: r for r in q.estimates(s, rows, units=NONE).collect()}
    for g, x in of.items():
        ld, m, c, d2 = mcd(x)
        e = found[g]
        assert e.own and e.n == len(x)
        assert raw[g].ld <= ld + 0.12  # the last step of the grain may hold a few rows more
        sd = np.sqrt(np.diag(c))
        assert np.allclose([e[f"m_{i}"] for i in range(D)], m, atol=0.06 * sd.max())
        mine = np.zeros((D, D))
        for i, j in q._CELLS:
            mine[i, j] = mine[j, i] = e[f"c_{i}{j}"]
        assert np.allclose(mine / np.outer(sd, sd), c / np.outer(sd, sd), atol=0.08)
        own = np.einsum("ij,jk,ik->i", x - [e[f"m_{i}"] for i in range(D)], np.linalg.inv(mine), x - [e[f"m_{i}"] for i in range(D)])
        cut = q.chi2_quantile(q.CUT, D)
        assert ((own <= cut) == (d2 <= cut)).mean() > 0.995
        # no factor is a constant of the code
        assert len({round(e[f"c_{i}{i}"], 9) for i in range(D)}) == D


def test_degenerate_groups_follow_their_parents(spark):
    r, s = np.random.default_rng(2), scratch.Scratch(spark)
    rows = [(1, 10, 100, *v) for v in r.standard_normal((400, D)).tolist()]
    rows += [(1, 10, 101, *v) for v in r.standard_normal((3, D)).tolist()]  # fewer than dimensions
    rows += [(1, 11, 102, 0.5, 0.5, *v) for v in r.standard_normal((50, D - 2)).tolist()]  # on a line
    rows += [(1, 12, 103, *[2.0] * D)]
    df = spark.createDataFrame([tuple(float(x) if k > 2 else x for k, x in enumerate(v)) for v in rows], "g0 long, g1 long, g2 long, " + ROWS.split(", ", 1)[1])
    got = {x.g: x for x in q.fitted(s, df).collect()}
    assert set(got) == {100, 101, 102, 103} and [got[k].n_group for k in (100, 101, 102, 103)] == [400, 3, 50, 1]
    assert all(got[103][m] == pytest.approx(got[102][m]) for m in q._LOW)  # both stand on the whole corpus alone
    assert all(0.5 < got[k].l_00 < 1.5 for k in got)
    # three texts of a language have 3 / 103 of a say, as those on its estimate have the rest
    assert abs(got[101].m_0 - got[100].m_0) < 0.2
    assert q.fitted(s, df.limit(0)).collect() == [] and q.fitted(s, df.where("g2 = 103")).collect() == []


def test_no_switch_at_a_size(spark):
    """One text more in a group moves the estimate a little, whatever the size."""
    r, s = np.random.default_rng(4), scratch.Scratch(spark)
    big, small = r.standard_normal((300, D)), r.standard_normal((230, D)) * 1.5 + 1
    schema = "g0 long, g1 long, g2 long, " + ROWS.split(", ", 1)[1]
    at = []
    for n in (199, 200):
        rows = [(1, 10, 100, *map(float, v)) for v in big] + [(1, 10, 101, *map(float, v)) for v in small[:n]]
        at.append({x.g: x for x in q.fitted(s, spark.createDataFrame(rows, schema)).collect()}[101])
    assert all(abs(a[c] - b[c]) < 0.1 for a, b in zip(at, at[1:]) for c in (*q._MEAN, *q._LOW))


def test_copies_count_once_and_fare_alike(spark):
    r = np.random.default_rng(6)
    words = ["".join(r.choice(list("abcdefghAB,;"), r.integers(2, 9))) for _ in range(400)]
    texts = [" ".join(r.choice(words, 60 + k % 50)) + ".\n" + " ".join(r.choice(words, 20)) for k in range(300)]
    rows = [(k, t, "en", "s") for k, t in enumerate(texts)]
    some = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    many = spark.createDataFrame(rows + [(1000 + k, texts[0], "en", "s") for k in range(900)], "doc_id long, text string, lang string, source string")
    a = {x.doc_id: x.q_distance for x in q.judged(some).collect()}
    b = {x.doc_id: x.q_distance for x in q.judged(many).collect()}
    assert all(a[k] == pytest.approx(b[k], rel=1e-9) for k in a) and {b[1000 + k] for k in range(900)} == {b[0]}
    assert np.mean([x <= q.chi2_quantile(q.CUT, D) for x in a.values()]) > 0.99
