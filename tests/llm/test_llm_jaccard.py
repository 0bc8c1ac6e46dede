"""Near copies by exact similarity, against all pairs."""

import numpy as np
import xxhash

import corpus_pipeline
from tracelume.llm import jaccard, simhash

SCHEMA = "doc_id long, text string, key long, in_0 string"


def rows():
    r = np.random.default_rng(3)
    line = [f"common{k}" for k in range(30)]
    out = []
    for k in range(40):
        words = [f"w{x}" for x in r.integers(0, 500, 120 + 5 * k)]
        words[20:20] = line  # a passage that all hold
        out.append(words)
        for changes in (1, 3, 9):  # near copies, and what is none
            copy = list(words)
            for at in r.integers(0, len(copy), changes):
                copy[at] = "changed"
            out.append(copy)
    data = [(k, " ".join(w), 1, "x") for k, w in enumerate(out)]
    data += [(900, None, 1, "x"), (901, "", 1, "x"), (902, "One  two", 1, "x"), (903, "one two", 1, "x"), (None, data[0][1], 1, "x"), (904, "one two three", 1, "x"), (7, data[7][1], 2, "y")]
    return data


def test_one_of_each_similar_group(spark, tmp_path):
    data = rows()
    sets = [jaccard.shingles(t) for _, t, *_ in data]
    top = list(range(len(data)))
    root = lambda i: i if top[i] == i else root(top[i])
    share = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    pairs = [(i, j) for i in range(len(data)) for j in range(i) if share(sets[i], sets[j]) >= 0.8]
    for i, j in pairs:
        top[root(i)] = root(j)
    groups = {}
    for i, row in enumerate(data):
        groups.setdefault(root(i), []).append((row[0] is None, row[0]))
    want = sorted(min(g)[1] for g in groups.values())
    spark.createDataFrame(data, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/docs")
    got = jaccard.keep_one(spark.read.parquet(f"{tmp_path}/docs"))
    assert got.columns == ["doc_id", "text", "key", "in_0"]
    assert sorted(r.doc_id for r in got.collect()) == want
    # the fingerprints' radius alone leaves some of them
    prints = [simhash.simhash((t or "").encode()) for _, t, *_ in data]
    assert any((prints[i] ^ prints[j]).bit_count() > simhash.RADIUS for i, j in pairs)


def test_no_documents(spark):
    assert jaccard.keep_one(spark.createDataFrame([], SCHEMA)).count() == 0


def test_pipeline_leaves_no_similar_pair(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id in (1, 177)")
    assert [r.doc_id for r in simhash.keep_one(docs).select("doc_id").orderBy("doc_id").collect()] == [1, 177]
    assert [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf).select("doc_id").collect()] == [1]


def test_large_group_of_near_copies_without_all_pairs(spark, tmp_path):
    """600 copies, each with words of its own exchanged: one class, from a number of pairs that is linear in the group."""
    r = np.random.default_rng(5)
    base = [f"w{x}" for x in r.integers(0, 900, 200)]
    data = []
    for k in range(600):
        copy = list(base)
        for at in r.integers(0, 200, 2):
            copy[at] = f"own{k}"
        data.append((k, " ".join(copy), 1, "x"))
    data += [(1000 + k, " ".join(f"v{x}" for x in r.integers(0, 900, 150)), 1, "x") for k in range(50)]
    spark.createDataFrame(data, SCHEMA).write.parquet(f"{tmp_path}/docs")
    kept = sorted(x.doc_id for x in jaccard.keep_one(spark.read.parquet(f"{tmp_path}/docs")).collect())
    assert kept == [0, *range(1000, 1050)]


def test_frequent_shingles_are_counted_over_all_documents(spark):
    """45,000 documents, of which some shingles stand in nine, the least that is frequent there, and others in eight."""
    docs = spark.range(45_000).selectExpr("concat('a b c d e', id, case when id < 450 then concat(' q w r t y', id % 50, ' x', id) when id < 850 then concat(' q w r t z', id % 50, ' x', id) else '' end) as text")
    got = jaccard._frequent(docs, "text", 5)
    nine = {xxhash.xxh64_intdigest(f"q w r t y{k}".encode()) >> 2 for k in range(50)}
    eight = {xxhash.xxh64_intdigest(f"q w r t z{k}".encode()) >> 2 for k in range(50)}
    assert nine <= set(got.tolist()) and not eight & set(got.tolist())


def test_bitmaps_pass_over_no_similar_pair_and_nearly_all_others():
    """Every pair under a shingle had both texts shuffled, in every round again."""
    r = np.random.default_rng(5)
    passed = 0
    for n in (1, 2, 9, 50, 500, 1500, 20_000):
        for share in (0.0, 0.05, 0.3):
            a = np.unique(r.integers(0, 1 << 62, n, dtype=np.uint64))
            b = np.unique(np.concatenate([a[int(share * len(a)) :], r.integers(0, 1 << 62, int(share * len(a)), dtype=np.uint64)]))
            c = r.integers(0, 1 << 62, n, dtype=np.uint64)
            both = len(np.intersect1d(a, b))
            open_ = jaccard.may_be_similar([jaccard.bitmap(a)] * 2, [jaccard.bitmap(b), jaccard.bitmap(c)], np.array([len(a) + len(b), len(a) + len(c)]))
            assert open_[0] or 5 * both < 4 * (len(a) + len(b) - both)
            passed += not open_[1]
    assert passed == 18  # all but those of 20,000 shingles, which are compared by their texts
