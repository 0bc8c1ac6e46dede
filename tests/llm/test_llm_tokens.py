"""Token files: exact round trips, encodings and indexes as written, selective reads."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tokenizers

from tracelume.llm import scratch, tokens
from tracelume.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, n_tokens long, ids string, part int, h long, file string"
ODD = ["Don't <|endoftext|> naïve ÉCOLE x\u0301 ΣΑΣ 12 a.b İ  ﬁ\x0bz", "<|startoftext|>", "ab cd " + "x" * 5000, None, "", " \t\n ", "a\x1cb\x85c\xa0d e's 5'S", "the " * 30_000]


def rows():
    r = random.Random(3)
    words = ["".join(r.choice("abcdeéß") for _ in range(r.randint(1, 9))) for _ in range(500)]
    out = [(k, " ".join(r.choice(words) for _ in range(r.randint(1, 80)))) for k in range(120)] + [(200 + k, x) for k, x in enumerate(ODD)]
    return out + [(None, "no id"), (None, "no id"), (None, "another")] + [(7, f"same id {k}") for k in range(5)]


def written(spark, name, data, partitions=None):
    path = scratch.new_path(spark, "tokens")
    df = spark.createDataFrame([(*r, 1, "x", 2, 3, "f") for r in data], SCHEMA).repartition(3)
    return path, tokens.write_tokens(df, path, tokenizer_path(name), partitions=partitions)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_round_trip(spark, name):
    t, data = tokenizers.Tokenizer.from_file(tokenizer_path(name)), rows()
    path, manifest = written(spark, name, data, 4)
    found = sorted(tokens.digests(spark, path).collect(), key=lambda r: r.start)
    ids = lambda x: np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")
    assert sorted(str((r.doc_id, r.n_tokens, r.ids_crc32)) for r in found) == sorted(str((d, len(ids(x)), zlib.crc32(ids(x).tobytes()))) for d, x in data)
    assert [r.doc_id for r in found] == sorted((d for d, _ in data), key=lambda d: (d is not None, d or 0))
    assert [r.start for r in found] == np.cumsum([0] + [r.n_tokens for r in found])[:-1].tolist()
    assert manifest.groupBy().sum("docs", "tokens").first() == (len(data), sum(r.n_tokens for r in found))
    read = {(r.doc_id, r.start): (r.n_tokens, r.ids) for r in tokens.read_tokens(spark, path).collect()}
    assert {(r.doc_id, r.start): (r.n_tokens, r.ids_crc32) for r in found} == {k: (n, zlib.crc32(np.array(i, "<u4").tobytes())) for k, (n, i) in read.items()}


def test_texts_like_whole_encoding():
    r = random.Random(5)
    alphabet = "aBzÉéß'ſKİıΣςσ <|>0١½\t\ń \u200b中"
    texts = ["".join(r.choice(alphabet) for _ in range(40)) for _ in range(2000)] + ODD
    e = tokens.Encoder(tokenizer_path())
    for some in (texts, texts[::-1]):  # unknown, then known
        ids, n = e.encode(pa.array(some, pa.string()))
        got = np.split(ids, np.cumsum(n)[:-1])
        assert all(g.tolist() == [*e.tokenizer.encode(x or "", add_special_tokens=False).ids, 2] for g, x in zip(got, some, strict=True))


def test_memory_begins_anew(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO", 50)
    monkeypatch.setattr(tokens, "KEEP", 7)
    e = tokens.Encoder(tokenizer_path())
    for k in range(5):
        some = [f"word{k}x{j} of text" for j in range(40)]
        ids, n = e.encode(pa.array(some))
        assert ids.tolist() == [i for x in some for i in [*e.tokenizer.encode(x, add_special_tokens=False).ids, 2]]


def test_empty_table(spark):
    path, manifest = written(spark, "word_bpe_49k.json", [])
    assert manifest.count() == 0 and tokens.digests(spark, path).collect() == [] and tokens.read_tokens(spark, path).collect() == []


def test_files_of_lost_attempts_do_not_count(spark):
    path, manifest = written(spark, "word_bpe_49k.json", rows(), 2)
    name = manifest.first().file
    with open(f"{path}/data/{name}", "rb") as f, open(f"{path}/data/part-000000-99999.parquet", "wb") as g:
        g.write(f.read())
    assert tokens.read_tokens(spark, path).count() == tokens.digests(spark, path).count() == len(rows())


def test_encodings_and_page_indexes(spark):
    path, manifest = written(spark, "word_bpe_49k.json", rows(), 2)
    for r in manifest.collect():
        meta = pq.ParquetFile(f"{path}/data/{r.file}").metadata
        for g in range(meta.num_row_groups):
            columns = {meta.row_group(g).column(k).path_in_schema: meta.row_group(g).column(k) for k in range(meta.num_columns)}
            assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings and "DELTA_BINARY_PACKED" in columns["start_in_part"].encodings
            assert "RLE_DICTIONARY" in columns["ids.list.element"].encodings
            assert all(c.has_offset_index and c.has_column_index for c in columns.values())


def test_selective_reads(spark):
    path, _ = written(spark, "word_bpe_49k.json", [(k, f"text {k} " * 50) for k in range(6000)], 1)
    whole = tokens.read_tokens(spark, path)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan(whole.select("doc_id", "start", "n_tokens")).split("ReadSchema")[1]
    some = whole.where("doc_id between 4100 and 4102")
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,4100)" in plan(some)
    assert sorted(r.doc_id for r in some.select("doc_id", "ids").collect()) == [4100, 4101, 4102]
