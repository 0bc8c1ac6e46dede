"""Each operator against brute force, with nulls, empty and long texts, repeats, empty tables, clashing columns."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from tracelume.llm import brown, components, decontaminate, factorization, line_dedup, mixing, quality_rules, scratch, simhash, text, tool_calls, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# names that operators use inside
CLASH = ", fp long, label long, id string, b string, c long, n long, row long, key long, d2 double, _counts long, mix_rate double, g_lang string"
RNG = np.random.default_rng(5)
WORDS = [f"w{k}" for k in range(300)]


def prose(n, seed):
    r = np.random.default_rng(seed)
    return " ".join(r.choice(WORDS, n))


def corpus():
    rows = [(k, prose(60 + k % 40, k), ("en", "de")[k % 2], f"s{k % 3}", 100 + k) for k in range(60)]
    rows += [(100, rows[3][1], "en", "s0", 5), (101, rows[3][1] + "\n", "en", "s0", 5), (102, rows[4][1], None, None, None)]
    rows += [(103, None, "en", "s0", None), (104, "", None, "s1", 0), (105, " \t\n ", "de", None, 3), (106, "One", "en", "s2", 3), (None, prose(50, 99), "en", "s0", 1)]
    rows += [(107, "a b c d " * 4000, "en", "s0", 1), (8, rows[8][1], "en", "s2", 108)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, 1, 2, "x", "y", 3, 4, 5, 6, 0.5, 7, 0.25, "zz") for r in corpus()]
    return spark.createDataFrame(rows, SCHEMA + CLASH).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def key(r):
    return (r[0] is None, r[0] or 0, *map(str, r[1:]))


def test_fingerprint_is_a_majority_of_shingles():
    def slow(s):
        w = (s or "").encode().lower().split()
        sh = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) > 3 else [b" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in sh]
        return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))

    for r in corpus()[-15:]:
        assert simhash.simhash(None if r[1] is None else r[1].encode()) == slow(r[1])
    assert simhash.simhash(b"A b C") == xxhash.xxh64_intdigest(b"a b c", 42)


def test_near_duplicates_match_brute_force(docs, none):
    rows = corpus()
    fps = [simhash.simhash(None if r[1] is None else r[1].encode()) for r in rows]
    near = [[(a ^ b).bit_count() <= 4 for b in fps] for a in fps]
    comp = list(range(len(rows)))
    for _ in rows:
        comp = [min(comp[j] for j in range(len(rows)) if near[i][j]) for i in range(len(rows))]
    ids = {c: min((rows[i][0] for i in range(len(rows)) if comp[i] == c and rows[i][0] is not None), default=None) for c in comp}
    want = sorted(((r[0], np.uint64(f).astype(np.int64).item(), ids[c]) for r, f, c in zip(rows, fps, comp)), key=key)
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=key) == want
    assert simhash.near_duplicates(none).collect() == []
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(set(comp))


def test_forest_has_the_components_of_all_links():
    base = RNG.integers(0, 2**63, 30, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, base ^ np.uint64(1), base ^ np.uint64(6), *(base[:1] ^ np.uint64((1 << k) | 1) for k in range(2, 60))]))
    a, b = simhash.forest(fps, fps, 4)

    def groups(pairs):
        top = {int(x): int(x) for x in fps}
        for _ in range(len(fps)):
            for x, y in pairs:
                top[x] = top[y] = min(top[x], top[y])
        return top

    full = [(int(x), int(y)) for x in fps for y in fps if (int(x) ^ int(y)).bit_count() <= 4]
    assert groups(list(zip(a.tolist(), b.tolist()))) == groups(full)
    keep = components.spanning(a, b)
    assert groups([(int(a[k]), int(b[k])) for k in keep]) == groups(full) and len(keep) < len(fps)


def test_components_of_a_long_chain(spark):
    s = scratch.Scratch(spark)
    order = RNG.permutation(200).tolist()
    edges = s.table(spark.createDataFrame([(order[k], order[k + 1]) for k in range(199)] + [(1000, 1001)], "a long, b long"), "e")
    found = {r.node: r.label for r in components.connected_components(spark, s, edges).collect()}
    assert found == {k: 0 for k in range(200)} | {1000: 1000, 1001: 1000}
    assert components.connected_components(spark, s, s.table(spark.createDataFrame([], "a long, b long"), "z")).collect() == []


def test_contamination_matches_brute_force(spark, docs, none):
    rows = corpus()
    long = rows[0][1].split()
    items = [(1, " ".join(long[5:30])), (2, " ".join(long[5:28]) + " zz yy"), (3, "one"), (4, None), (5, ""), (6, "nope nope nope nope nope nope"), (1, " ".join(long[5:30])), (None, " ".join(rows[1][1].split()[:20]))]
    table = spark.createDataFrame(items, "item_id long, text string")

    def grams(t, w):
        x = decontaminate.tokens(t)
        return {tuple(x[i : i + w]) for i in range(len(x) - w + 1)}

    want = []
    for d, t, *_ in rows:
        for i, x in set(items):
            w = min(5, len(decontaminate.tokens(x)))
            if w and len(grams(x, w) & grams(t, w)) >= 0.8 * len(grams(x, w)):
                want.append((d, i, len(grams(x, w)), len(grams(x, w) & grams(t, w))))
    assert {(0, 1), (0, 2), (106, 3), (1, None)} <= {w[:2] for w in want}
    for size in (1 << 20, 100):  # sent to the executors, joined
        assert sorted(map(str, map(tuple, decontaminate.contaminated(docs, table, broadcast_bytes=size).collect()))) == sorted(map(str, want))
    bad = {w[0] for w in want}
    for size in (1 << 20, 100):
        out = decontaminate.decontaminate(docs, table, broadcast_bytes=size)
        assert out.columns == docs.columns and sorted(map(key, out.select("doc_id").collect())) == sorted(key((r[0],)) for r in rows if r[0] not in bad)
    assert decontaminate.contaminated(none, table).collect() == [] and decontaminate.contaminated(docs, table.limit(0)).collect() == []


def test_base_scores_and_a_better_model(docs, none):
    found = brown.scored(docs, head=60, clustered=30, classes=5, slots=256).collect()
    rows = corpus()
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    tokens_of = lambda x: [*(x or "").encode().lower().split(), None]
    c = Counter(t for r in rows if not held(r[0]) for t in tokens_of(r[1]))
    n, v = sum(c.values()), len(c)
    want = sorted((r[0] is None, r[0] or 0, held(r[0]), len(tokens_of(r[1])), sum(c[t] > 0 for t in tokens_of(r[1])), n, sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens_of(r[1]))) for r in rows)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in found)
    for g, w in zip(got, want, strict=True):
        assert g[:-1] == w[:-1] and g[-1] == pytest.approx(w[-1], abs=1e-8)
    assert all(r.score < 0 and math.isfinite(r.score) for r in found)
    assert brown.scored(none).collect() == []


def test_exchange_raises_the_likelihood():
    truth = np.arange(40) % 4
    b = RNG.poisson(np.where((truth[:, None] + 1) % 4 == truth[None, :], 40, 2)).astype(float)

    def likelihood(of):
        g = np.zeros((4, 4))
        np.add.at(g, (of[:, None], of[None, :]), b)
        return brown._xlogx(g).sum() - brown._xlogx(g.sum(0)).sum() - brown._xlogx(g.sum(1)).sum()

    mixed = RNG.permutation(40)
    b = b[np.ix_(mixed, mixed)]
    found = brown.exchange(b, 40, 4, 20)
    moves = (likelihood(np.where(np.arange(40) == w, c, found)) for w in range(40) for c in range(4))
    assert likelihood(found) >= max(moves) - 1e-6 and likelihood(found) > likelihood(np.arange(40) % 4)


def test_quality_counts_match_brute_force(docs, none):
    import re

    found = quality_rules.judged(docs).collect()
    by = {}
    for r in found:
        by.setdefault((r.doc_id, r.text), r)
    assert len(found) == len(corpus())
    for d, x, *_ in corpus():
        x = x or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", x)
        seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        hit = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [y for y in x.split("\n") if re.search(r"[^\x20\x09-\x0D]", y)]
        r = by[d, next(c[1] for c in corpus() if c[0] == d and (c[1] or "") == x)]
        assert (r.q_n_words, r.q_word_chars, r.q_n_symbols, r.q_n_dup_lines, r.q_n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), len(lines) - len(set(lines)), len(hit))
        assert r.q_base_failed == (len(w) < 20 or 100 * len(hit) > 30 * len(w)) and not (r.q_base_failed and r.q_kept)
    assert {"fp", "d2", "g_lang", "label"} <= set(found[0].asDict())
    assert quality_rules.judged(none).collect() == []


def test_overlapping_repeats(spark):
    t = ["a b c d e f g h i", "x y z " * 8, "a b c d e f g h " * 2, "p " * 7, "q " * 9]
    got = [r.q_n_repeat_words for r in quality_rules.with_statistics(spark.createDataFrame([(x,) for x in t], "text string")).collect()]
    assert got == [0, 24, 16, 0, 9]


def test_outliers_go_and_others_stay(spark):
    rows = [(k, prose(80, 1000 + k), "en", "s", 1) for k in range(300)] + [(900 + k, "|## " * 40 + prose(40, k), "en", "s", 1) for k in range(20)]
    kept = {r.doc_id for r in quality_rules.judged(spark.createDataFrame(rows, SCHEMA)).where("q_kept").collect()}
    assert kept == set(range(300))


def test_archives_round_trip(spark):
    big, magic = "<p>" + "x" * 1200, "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(1, "http://a/b c", big), (2, None, big), (3, "http://é/", big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (None, "u", big), (7, "u", ""), (8, "u", magic * 200), (9, "u", magic + "é" * 3000)]
    rows += [(k, "http://h/", prose(400, k)) for k in range(10, 60)]
    pages = spark.createDataFrame([(*r, 1, "f") for r in rows], "page_id long, url string, html string, digest long, file string").repartition(3)
    last = {}
    for p, _, h in rows:
        last[h or ""] = max(last.get(h or "", -1), -1 if p is None else p)
    want = []
    for p, _, h in rows:
        b = (h or "").encode()
        again = len(b) >= 1000 and p != last[h or ""]
        want.append((p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", last[h] if again else None))
    for gzip in (True, False):
        path = scratch.new_path(spark, "warc")
        manifest = warc.write_archives(pages, path, gzip=gzip, file_bytes=40_000)
        got = warc.read_archives(spark, path, manifest, gzip=gzip, range_bytes=3000).collect()
        assert sorted(map(str, want)) == sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got)
        assert {r.page_id: r.payload.decode() for r in got if r.record_type == "response"}[8] == magic * 200
    path = scratch.new_path(spark, "warc")
    assert warc.read_archives(spark, path, warc.write_archives(pages.limit(0), path)).collect() == []


def test_classifier_learns_on_held_out_rows(spark, none):
    r = np.random.default_rng(3)
    rows, labels = [], []
    for k in range(600):
        good = k % 3 != 0
        x = prose(80, k) if good else " ".join(np.repeat(r.choice(WORDS, 20), 4))
        rows.append((k, x, "en", "s", len(x) if k % 7 else None))
        labels.append((k, int(good)))
    rows += [(None, None, None, None, None), (601, "", "en", "s", 0)]
    labels += [(None, 1), (5, None), (7, 1)]
    l = spark.createDataFrame(labels, "doc_id long, quality int")
    found = factorization.scored(spark.createDataFrame(rows, SCHEMA), l).collect()
    assert len(found) == len(rows) and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.7) for x in found)
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in found if x.doc_id is not None)
    test = [x for x in found if x.held_out and x.doc_id is not None and x.doc_id < 600]
    assert np.mean([x.predicted == (x.doc_id % 3 != 0) for x in test]) > 0.95
    assert factorization.scored(none, l).collect() == []
    assert all(abs(x.score - 0.5) < 0.2 for x in factorization.scored(spark.createDataFrame(rows[:5], SCHEMA), l.limit(0)).collect())


def test_squares_identity_is_the_sum_over_pairs():
    m = factorization.Machine()
    m.w[:] = RNG.standard_normal(factorization.SIZE)
    at, x = np.array([3, 9, 40]), np.array([0.5, 1.0, 2.0])
    z, _ = m.margins(at, x, np.array([0]))
    pairs = sum(m.v[at[i]] @ m.v[at[j]] * x[i] * x[j] for i in range(3) for j in range(i + 1, 3))
    assert z[0] == pytest.approx(m.b + (m.w[at] * x).sum() + pairs, rel=1e-5)


def test_site_lines(spark):
    bar = "<nav><a href='/'>Home</a></nav>"
    rows = [(k, f"http://h.org/{k}", f"{bar}<p>text {k}</p><script>var t='</p>'</script>") for k in range(10)]
    rows += [(40, "http://one.org", f"{bar}<p>alone</p>")]
    rows += [(20 + k, f"https://me@few.org:80/{k}", f"{bar}<p>t {k}</p>") for k in range(3)] + [(30, None, None), (31, "no url", ""), (32, "http://H.org", f"{bar}{bar}<p>b</p>"), (32, "http://H.org", f"{bar}<p>< a</p>")]
    got = line_dedup.dedup_pages(spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, _host long, _key string"))
    text_of = sorted((r.page_id, r.host, r.n_lines, r.n_kept, r.text) for r in got.collect())
    want = [(k, "h.org", 2, 1, f"text {k}") for k in range(10)] + [(20 + k, "few.org", 2, 1, f"t {k}") for k in range(3)]
    want += [(40, "one.org", 2, 2, "Home\nalone"), (30, "", 0, 0, ""), (31, "", 0, 0, ""), (32, "h.org", 2, 1, "< a"), (32, "h.org", 3, 1, "b")]
    assert text_of == sorted(want)
    assert line_dedup.dedup_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_rates_meet_targets(spark, none):
    r = np.random.default_rng(2)
    rows, labels = [], []
    for k in range(400):
        bad = k % 4 == 0
        x = prose(60, k) + (" trash scum" if bad else "") + f" {r.integers(9)}"
        rows.append((k, x, "en", "s", 1, 0.5))
        if k % 2 == 0:
            labels.append((k, "bad" if bad else "good"))
    rows += [(None, None, None, None, None, 0.5), (500, "", None, None, 0, 0.5), (3, rows[3][1], "en", "s", 1, 0.5)]
    d = spark.createDataFrame(rows, SCHEMA + ", mix_rate double")
    labelled = spark.createDataFrame(labels + [(None, "good"), (7, None)], "doc_id long, domain string")
    out, model = mixing.mixed(d, labelled, {"good": 0.9, "bad": 0.1})
    got = out.collect()
    assert len(got) == len(rows) and {"trash", "scum"} <= set(model.markers) and all(x.mix_rate >= 0 for x in got)
    total = sum(x.mix_tokens for x in got)
    for k, dom in enumerate(model.domains):
        assert sum(x.mix_rate * x.mix_tokens * x.mix_posteriors[k] for x in got) == pytest.approx({"good": 0.9, "bad": 0.1}[dom] * total, rel=2e-3)
    assert {x.doc_id: x.mix_tokens for x in got}[500] == 0
    # posteriors by hand
    for x in got[:20]:
        has = [m in (x.text or "").lower().split() for m in model.markers]
        z = [math.log(p) + sum(math.log(q if h else 1 - q) for h, q in zip(has, s)) for p, s in zip(model.priors, model.shares)]
        e = np.exp(np.array(z) - max(z))
        assert np.allclose(e / e.sum(), x.mix_posteriors)
    assert mixing.mixed(none, labelled, {"good": 1.0})[0].collect() == []
    near, _ = mixing.mixed(d, labelled, {"good": 1.0, "bad": 0.0}, anchor="good", rounding="nearest")
    copies = {x.doc_id: x.mix_copies for x in near.where("doc_id < 400").collect()}
    assert all(copies[k] == (k % 4 != 0) for k in range(400))


def test_tool_calls(spark):
    calls = [
        ("c", "a", 1, "add", '{"y": 2, "x": 1}'),
        ("c", "b", 2, "add", '{"x": "1"}'),
        ("c", "d", 3, "add", "nope"),
        ("c", "e", 4, "what", '{"é": [1, {"b": null, "a": 1.50}]}'),
        ("c", "f", 5, "bare", "{}"),
        ("c", "f", 6, "bare", "{}"),
        ("c", "g", 7, "bare", '{"z": 1}'),
        (None, None, 8, None, None),
    ]
    results = [("c", "a", 2, "3"), ("c", "a", 9, "4"), ("c", "zz", 3, None), (None, None, 9, "r")]
    schemas = [("add", "x", "integer", True), ("add", "y", "number", True), ("bare", None, None, None)]
    after = [("c", "b", "a"), ("c", "d", "b"), ("c", "d", "a"), ("c", "e", "missing"), ("c", "f", "g"), ("c", "g", "f")]
    got = {
        (r.conv_id, r.call_id): r
        for r in tool_calls.link(
            spark.createDataFrame(calls, "conv_id string, call_id string, turn long, tool string, arguments string"),
            spark.createDataFrame(results, "conv_id string, call_id string, turn long, content string"),
            spark.createDataFrame(schemas, "tool string, name string, type string, required boolean"),
            spark.createDataFrame(after, "conv_id string, call_id string, dep string"),
        ).collect()
    }
    a = got["c", "a"]
    assert (a.status, a.result_turn, a.n_results, a.errors, a.level) == ("linked", 2, 2, [], 0)
    assert a.json == '{"arguments":{"x":1,"y":2},"content":"3","id":"a","name":"add"}'
    assert got["c", "b"].errors == ["missing:y", "type:x"] and got["c", "b"].level == 1
    assert got["c", "d"].errors == ["malformed"] and got["c", "d"].level == 2 and got["c", "d"].json == '{"arguments":"nope","id":"d","name":"add"}'
    assert got["c", "e"].errors == ["unknown_tool"] and got["c", "e"].json == '{"arguments":{"é":[1,{"a":1.5,"b":null}]},"id":"e","name":"what"}'
    assert got["c", "f"].n_calls == 2 and got["c", "f"].level is None and got["c", "g"].level is None and got["c", "g"].errors == ["unknown:z"]
    assert got["c", "zz"].status == "orphan_result" and got["c", "zz"].json is None
    assert got[None, None].status == "linked"
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert tool_calls.link_turns(empty).collect() == []


def test_words(spark):
    row = spark.createDataFrame([("Ä a\x0bB\x1c C\r\n",), (None,)], "t string").select(text.words(text.ascii_lower(text.F.col("t")))).collect()
    assert [r[0] for r in row] == [["Ä", "a", "b\x1c c"], []]


def test_every_partition_finds_all_that_exact_containment_does(spark):
    """Items of 1 to 700 words, some words exchanged, inside documents of any length."""
    r = np.random.default_rng(12)
    vocabulary = [f"v{k}" for k in range(3000)]
    items, docs = [], []
    for k, n in enumerate([1, 2, 3, 4, 5, 6, 8, 9, 12, 20, 33, 64, 130, 260, 700] * 3):
        w = list(r.choice(vocabulary, n))
        items.append((k, " ".join(w)))
        for share in (0.0, 0.01, 0.03, 0.2):
            x = [v if r.random() >= share else "zz" for v in w]
            docs.append((len(docs), " ".join([*r.choice(vocabulary, r.integers(0, 900)), *x, *r.choice(vocabulary, 40)])))
    sets = [(k, w := min(5, len(x := decontaminate.tokens(t))), decontaminate.shingles(x, w)) for k, t in items]
    want = set()
    for d, t in docs:
        own = {w: decontaminate.shingles(decontaminate.tokens(t), w) for w in range(1, 6)}
        want |= {(d, k, len(s), len(s & own[w])) for k, w, s in sets if len(s & own[w]) >= 0.8 * len(s)}
    assert len(want) > 100
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for size in (1 << 20, 100):
        got = decontaminate.contaminated(a, b, broadcast_bytes=size).collect()
        assert len(got) == len(want) and {tuple(x) for x in got} == want
    assert len(decontaminate.Items(items).parts) > 10
