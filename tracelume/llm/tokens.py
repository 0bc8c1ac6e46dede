"""Token ids in Parquet list columns.

One file per range of document ids, rows ascending, ids in a list column. Ids are
dictionary-encoded and bit-packed, document ids and offsets delta-encoded, row groups
and pages have set sizes, and page indexes are written, so a reader of some documents or
of the metadata columns alone fetches only those.

A task writes its own file through ``pyarrow.fs`` (any store it knows) under a name with
its attempt, and a file counts once the manifest, itself a Spark table, names it: what a
lost attempt left behind is never read. Ids do not pass through the JVM.
"""

from __future__ import annotations

import gc
import json
import re
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

END_ID = 2
#: Ids of a row group at least, rows and bytes of a page at most.
GROUP_IDS, PAGE_ROWS, PAGE_BYTES = 4 << 20, 2_000, 256 << 10
FORMAT = {
    "version": "2.6",
    "data_page_version": "2.0",
    "compression": "zstd",
    "use_dictionary": ["ids.list.element"],
    "column_encoding": dict.fromkeys(("doc_id", "part", "start_in_part", "n_tokens"), "DELTA_BINARY_PACKED"),
    "dictionary_pagesize_limit": 1 << 20,
    "data_page_size": PAGE_BYTES,
    "max_rows_per_page": PAGE_ROWS,
    "write_page_index": True,
}
ROWS = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("start_in_part", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])
#: Distinct chunks, and pieces of them, after which a worker forgets all but those it met first; how many those are; bytes of text encoded at once.
MEMO, KEEP, STEP_BYTES = 300_000, 60_000, 8 << 20
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Chunks whose pieces are plain: no apostrophe, no composing or uncommon character.
_PLAIN = re.compile(rf"[!-&(-~{_LETTER}]{{1,64}}")
_PIECE = re.compile(rf"[{_LETTER}]+|[0-9]|\n|[^{_LETTER}0-9\n]+")
#: Byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 in order.
_OWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE = {b: chr(b) for b in _OWN} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(_OWN)))}
_SPELLED = {c: "".join(_BYTE[b] for b in chr(c).encode()) for c in range(192, 256)}


@cache
def _tokenizer(path: str):
    import tokenizers

    t = tokenizers.Tokenizer.from_file(path)
    t.encode_special_tokens = False
    return t


def _stages(path: str) -> bool:
    """Whether the file's stages are those that chunks and plain pieces stand for: NFC, white space to one space, lower case;
    runs of letters, single digits and runs of others with white space dropped, byte level; no word of one piece whole."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    norm = (spec["normalizer"] or {}).get("normalizers", [])
    pre = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    split = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
    return (
        norm == [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
        and len(pre) == 2
        and pre[0] == split
        and pre[1]["type"] == "ByteLevel"
        and not pre[1]["add_prefix_space"]
        and not pre[1]["use_regex"]
        and all("<|" in a["content"] and not re.search(r"\s", a["content"]) for a in spec["added_tokens"])
    )


class _Ids:
    """Runs of ids by name. Place 0 is the empty run."""

    def __init__(self) -> None:
        self.places: dict[str, int] = {"": 0}
        self.starts, self.lengths = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        self.ids, self.n_ids = np.zeros(1 << 18, np.uint32), 0

    def add(self, names: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        at, n, end = len(self.places), len(names), self.n_ids + len(ids)
        while at + n > len(self.starts):
            self.starts, self.lengths = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.lengths, 2 * len(self.lengths))
        while end > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.ids[self.n_ids : end] = ids
        self.lengths[at : at + n] = lengths
        self.starts[at : at + n] = self.n_ids + np.cumsum(lengths) - lengths
        self.n_ids = end
        self.places.update(zip(names, range(at, at + n)))

    def forget(self, keep: int) -> None:
        """Only the first ``keep`` stay: what is frequent is met early."""
        if len(self.places) > keep:
            self.places = dict(islice(self.places.items(), keep))
            end = int(self.starts[keep - 1] + self.lengths[keep - 1])
            self.ids, self.n_ids = self.ids[: max(end, 1)].copy(), end
            self.starts, self.lengths = self.starts[:keep].copy(), self.lengths[:keep].copy()

    def find(self, names: list[str]) -> np.ndarray:
        """Places; -1 of what is not known."""
        return np.fromiter(map(self.places.get, names, repeat(-1)), np.int32, len(names))

    def gather(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs one after the other, and their lengths. Each place below zero is room for one id, left to the caller."""
        size = self.lengths[places]
        size[places < 0] = 1
        stop = np.cumsum(size, dtype=np.int32)
        shift = self.starts[places] - stop + size
        shift[places < 0] = 0
        at = np.repeat(shift, size)
        at += np.arange(len(at), dtype=np.int32)
        return self.ids.take(at, mode="clip"), size


class Encoder:
    """Ids of texts.

    A tokenizer of the known stages drops white space and no piece of it reaches across,
    so a text's ids are those of its chunks between ASCII white space, in order, and each
    distinct chunk is encoded once. The pieces of a plain chunk go to the tokenizer's
    model directly, which skips the alignment that a whole encoding keeps; any other chunk
    is encoded whole. A tokenizer of other stages gets whole texts.
    """

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self.model = self.tokenizer.model
        self.known_stages = _stages(path)
        self.chunks, self.pieces = _Ids(), _Ids()

    def forget(self) -> None:
        for held in (self.chunks, self.pieces):
            held.forget(KEEP)

    def _learn(self, fresh: list[str]) -> None:
        whole = _PLAIN.fullmatch
        plain = [c for c in fresh if whole(c) and "<|" not in c]
        if plain:
            found = _PIECE.findall("\n".join(plain).lower() + "\n")
            names = list(set(found) - self.pieces.places.keys() - {"\n"})
            tokenize = self.model.tokenize
            runs = [tokenize(p if p.isascii() else p.translate(_SPELLED)) for p in names]
            lengths = np.fromiter(map(len, runs), np.int32, len(runs))
            self.pieces.add(names, np.array([t.id for r in runs for t in r], np.uint32), lengths)
            at = self.pieces.find(found)  # what is not known parts two chunks
            ids, size = self.pieces.gather(at)
            ends = np.cumsum(size)[at < 0]
            keep = np.ones(len(ids), bool)
            keep[ends - 1] = False
            self.chunks.add(plain, ids[keep], np.diff(ends, prepend=0) - 1)
        if len(plain) < len(fresh):
            other = list(set(fresh).difference(plain))
            each = [x.ids for x in self.tokenizer.encode_batch_fast(other, add_special_tokens=False)]
            self.chunks.add(other, np.array([i for x in each for i in x], np.uint32), np.fromiter(map(len, each), np.int32, len(each)))

    def encode(self, texts: pa.Array, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, each ended by ``end_id``, and how many each has; a null text has the end alone."""
        if not self.known_stages:
            each = [[*x.ids, end_id] for x in self.tokenizer.encode_batch_fast([x or "" for x in texts.to_pylist()], add_special_tokens=False)]
            return np.array([i for x in each for i in x], np.uint32), np.fromiter(map(len, each), np.int64, len(each))
        if len(self.chunks.places) > MEMO or len(self.pieces.places) > MEMO:
            self.forget()
        parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        words = parts.flatten().dictionary_encode()
        named = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        place = self.chunks.find(named)
        if len(fresh := np.flatnonzero(place < 0)):
            new = [named[k] for k in fresh]
            self._learn(new)
            place[fresh] = self.chunks.find(new)
        at = parts.offsets.to_numpy() - parts.offsets[0].as_py()
        # one more word, the end, behind each text's own
        ids, size = self.chunks.gather(np.insert(place[words.indices.to_numpy()], at[1:], np.int32(-1)))
        stop = np.cumsum(size)[at[1:] + np.arange(len(texts))]
        ids[stop - 1] = end_id
        return ids, np.diff(stop, prepend=0)


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _slices(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of at most ``most`` bytes, or of one text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
    at = 0
    while at < len(ends):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, stop
        at = stop


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, partitions: int | None = None
) -> DataFrame:
    """Write ``doc_id, part, start_in_part, n_tokens, ids`` to files under ``path``; the manifest ``file, part, docs, tokens``, written there, too.

    Every row of ``docs`` is written once, its ids ended by ``end_id``, ascending by
    document id over the parts in their order. A null or empty text has the end id only.
    Null ids come first. Rows of one id are ordered by a hash of their text, and their range
    is cut by it, too, so an id of many rows is spread; equal rows may stand in any order. A
    text of any length is one row. An empty table writes no file. Other columns are not
    read, whatever their names. ``partitions`` sets the number of ranges.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(text_col)).alias("h"))
    ranged = (rows.repartitionByRange(partitions, "doc_id", "h") if partitions else rows.repartitionByRange("doc_id", "h")).sortWithinPartitions("doc_id", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(f"{path}/data")
        task, part, at, docs_n = TaskContext.get(), TaskContext.get().partitionId(), 0, 0
        name, out, held, n_held = f"part-{part:06d}-{task.taskAttemptId()}.parquet", None, [], 0
        collects = gc.isenabled()
        gc.disable()  # nothing here makes cycles, and a collection would walk all that is remembered
        try:
            for b in batches:
                for lo, hi in _slices(b.column(1), STEP_BYTES):
                    ids, n = encoder(tokenizer).encode(b.column(1).slice(lo, hi - lo), end_id)
                    ends = np.cumsum(n)
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.view(np.int32)))
                    columns = [b.column(0).slice(lo, hi - lo), pa.array(np.full(len(n), part, np.int32)), pa.array(at + ends - n), pa.array(n), lists]
                    held.append(pa.RecordBatch.from_arrays(columns, schema=ROWS))
                    at, docs_n, n_held = at + len(ids), docs_n + len(n), n_held + len(ids)
                    if out is None:
                        fs.create_dir(root, recursive=True)
                        out = pq.ParquetWriter(f"{root}/{name}", ROWS, filesystem=fs, **FORMAT)
                    if n_held >= GROUP_IDS:
                        out.write_table(pa.Table.from_batches(held))
                        held, n_held = [], 0
            if held:
                out.write_table(pa.Table.from_batches(held))
            if out is not None:
                out.close()
        finally:
            encoder(tokenizer).forget()  # the worker may wait for long
            if collects:
                gc.enable()
        if docs_n:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([part], pa.int32()), pa.array([docs_n]), pa.array([at])], names=["file", "part", "docs", "tokens"])

    ranged.select("doc_id", "text").mapInArrow(run, _MANIFEST).write.parquet(f"{path}/manifest")
    return spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")


_MANIFEST = "file string, part int, docs long, tokens long"


def _offsets(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """``file, before``, the ids of all files before a file, and the number of files: one row per file, which the writer's partitions bound."""
    files = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest").orderBy("part").collect()
    before = np.cumsum([0] + [r.tokens for r in files]).tolist()
    return spark.createDataFrame([(r.file, b) for r, b in zip(files, before)], "file string, before long"), len(files)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of files from :func:`write_tokens`.

    ``start`` counts the ids of all documents before. Columns that are not selected are
    not read, and a filter on ``doc_id`` skips row groups and pages by their indexes.
    """
    offsets, n = _offsets(spark, path)
    if not n:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids array<int>")
    rows = spark.read.schema("doc_id long, start_in_part long, n_tokens long, ids array<int>").parquet(f"{path}/data")
    found = rows.withColumn("file", F.col("_metadata.file_name")).join(offsets, "file")
    return found.select("doc_id", (F.col("before") + F.col("start_in_part")).alias("start"), "n_tokens", "ids")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of files from :func:`write_tokens`, from the ids as read: counts and starts are taken from them, too."""
    offsets, n = _offsets(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(f"{path}/data")
        for files in batches:
            for name, start in zip(files.column(0).to_pylist(), files.column(1).to_pylist()):
                with pq.ParquetFile(f"{root}/{name}", filesystem=fs, buffer_size=1 << 20, pre_buffer=False) as f:
                    for b in f.iter_batches(1024, columns=["doc_id", "ids"]):
                        lists = b.column(1)
                        flat = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
                        at = lists.offsets.to_numpy()
                        crc = [zlib.crc32(flat[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
                        count = np.diff(at).astype(np.int64)
                        ends = start + np.cumsum(count)
                        start = int(ends[-1]) if len(ends) else start
                        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ends - count), pa.array(count), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # a file is a task's work
    return offsets.repartitionByRange(max(1, n), "before").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
