"""The pipeline's stages against what each must keep."""

import os
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tokenizers

import corpus_pipeline
from tracelume.llm import decontaminate, jaccard, scratch, simhash
from tracelume.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        df = f(spark, docs, SF)
        df.write.parquet(f"{top}/{k}")
        out.append((docs.columns, docs.toPandas(), spark.read.parquet(f"{top}/{k}").toPandas()))
        docs = spark.read.parquet(f"{top}/{k}")
    return out


def test_columns_and_chaining(stages):
    for columns, _, after in stages[:-1]:
        assert list(after.columns) == columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert len(stages[-1][2]) == len(stages[-1][1]) > 0
    assert list(stages[-1][2].columns) == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_clean_documents_stay(stages):
    labels = pq.read_table(f"{SF}/labels.parquet").to_pandas()
    clean = set(labels[(labels.quality == 1) & (labels.toxic == 0)].doc_id)
    _, before, after = stages[0]
    fit = {d for d, t in zip(before.doc_id, before.text) if d in clean and len(t.split()) >= 20}
    assert len(fit & set(after.doc_id)) >= 0.99 * len(fit)
    _, before, after = stages[3]
    assert len(clean & set(after.doc_id)) >= 0.98 * len(clean & set(before.doc_id))


def classes(ids, near):
    """The smallest id of each id's class, by whole passes until nothing moves."""
    top = {d: d for d in ids}
    moved = True
    while moved:
        moved = False
        for a, b in near:
            least = min(top[a], top[b])
            moved |= top[a] != least or top[b] != least
            top[a] = top[b] = least
    return set(top.values())


def one_of_each(texts):
    """Ids that stay of ``texts``: one of each class within four bits, of these one of each class of similarity 0.8."""
    for link in ("bits", "shingles"):
        what = {d: simhash.simhash(t.encode()) if link == "bits" else jaccard.shingles(t) for d, t in texts.items()}
        near = lambda x, y: (x ^ y).bit_count() <= 4 if link == "bits" else jaccard.similar(x, y)  # noqa: B023, E731
        ids = sorted(texts)
        stay = classes(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if near(what[a], what[b])])
        texts = {d: texts[d] for d in stay}
    return set(texts)


def test_one_of_each_group(stages):
    _, before, after = stages[1]
    assert sorted(after.doc_id) == sorted(one_of_each(dict(zip(before.doc_id, before.text))))


def test_no_item_is_left(stages):
    items = pq.read_table(f"{SF}/benchmark.parquet").to_pandas()
    block = decontaminate.Items(list(zip(items.item_id.tolist(), items.text)), 5, 0.8)
    _, before, after = stages[2]
    assert set(after.doc_id) == {d for d, t in zip(before.doc_id, before.text) if not block.found(t)}


def test_run_matches_plain_python(spark, tmp_path):
    """All five stages by hand on planted documents: base rules and junk, copies near and far, items, and, as there are no labels, rates of one."""
    r = np.random.default_rng(9)
    words = ["".join(r.choice(list("abcdefghij"), r.integers(2, 9))) for _ in range(900)]
    prose = lambda n: " ".join(r.choice(words, n))
    texts = {k: prose(60 + k % 90) for k in range(260)}
    texts |= {300 + k: texts[k] for k in range(8)} | {310 + k: texts[k] + " and more" for k in range(5)}
    for k in range(6):  # similar, and beyond four bits
        w = texts[20 + k].split()
        w[len(w) // 2] = "zz"
        texts[330 + k] = " ".join(w)
    items = [(k, " ".join(texts[200 + k].split()[10:30])) for k in range(4)] + [(9, "neverseen")]
    junk = {400 + k: " ".join(w + "#$%" for w in prose(50).split()) for k in range(4)}
    failing = {410: "too few", 411: prose(12) + " " + "one two three four five six seven eight " * 9, 412: "", 413: None}
    rows = [(d, t) for d, t in {**texts, **junk, **failing}.items()]
    docs = {"doc_id": [d for d, _ in rows], "text": [t for _, t in rows], "lang": ["en"] * len(rows), "source": [f"s{d % 2}" for d, _ in rows], "n_chars": [len(t or "") for _, t in rows]}
    pq.write_table(pa.table(docs), f"{tmp_path}/documents.parquet")
    pq.write_table(pa.table({"item_id": [k for k, _ in items], "text": [t for _, t in items]}), f"{tmp_path}/benchmark.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([], pa.int64()), "quality": pa.array([], pa.int64()), "toxic": pa.array([], pa.int64())}), f"{tmp_path}/labels.parquet")

    def base_fails(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        hit = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        return len(w) < 20 or 100 * len(hit) > 30 * len(w)

    assert all(base_fails(t) for t in failing.values()) and not any(base_fails(t) for t in [*texts.values(), *junk.values()])
    stay = one_of_each(texts)
    assert len(stay) < len(texts) - 15
    grams = lambda t: {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
    sets = [grams(t.split()) for _, t in items[:4]]
    stay = [d for d in sorted(stay) if not any(len(s & grams(texts[d].split())) >= 0.8 * len(s) for s in sets)]
    tokenizer, at, want = tokenizers.Tokenizer.from_file(tokenizer_path()), 0, []
    for d in stay:
        ids = np.array([*tokenizer.encode(texts[d], add_special_tokens=False).ids, 2], "<u4")
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    with scratch.recorded() as made:
        got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == want
    # what stages wrote on their way is gone, but for the last stage's input and output
    assert sum(os.path.exists(p) for p in made) <= 2
