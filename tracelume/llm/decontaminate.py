"""Benchmark decontamination: size-partitioned MinHash containment search.

Items are partitioned by the width of their shingles and by size, their number ``n`` of
distinct shingles, in bands that double. An item's sketch is its bottom-k MinHash values
with ``k = n - ceil(t * n) + 1``: a document that holds a share ``t`` of the item's
shingles misses at most ``k - 1`` of them, so it holds at least one of any k. A
partition's threshold is the largest value in its sketches: a document's sketch for that
partition is its MinHash values up to there, about a quarter of them for long items, and a
document with fewer shingles than the partition's least item needs has none. So sketches
follow the size of a document, and a short item in a long one is not lost. Candidates
are then verified by exact containment over the shingles' text.

Items whose text, as counted, is within ``BROADCAST_BYTES`` go to the executors, and
documents are read once and never shuffled. Beyond that, sketches of items and documents
are tables that are hash-joined by width and value, and candidates are joined to their
texts; nothing of either side comes to the driver but the thresholds.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelume.llm.names import Held
from tracelume.llm.scratch import Scratch

WIDTH, THRESHOLD = 5, 0.8
#: Bytes of items' text that may be sent to the executors.
BROADCAST_BYTES = 32 << 20
_WORD = regex.compile(r"[\p{L}\p{N}]+")
_FOUND = "doc_id long, item_id long, n_shingles long, n_shared long"


def tokens(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def shingles(words: list[str], width: int) -> set[str]:
    return {" ".join(words[i : i + width]) for i in range(len(words) - width + 1)}


def hashes(words: list[str], width: int) -> np.ndarray:
    """MinHash values of all runs of ``width`` words, repeats included."""
    n = max(0, len(words) - width + 1)
    return np.fromiter(map(xxhash.xxh64_intdigest, map(" ".join, zip(*(words[i:] for i in range(width))))), np.uint64, n)


def need(n: int, threshold: float) -> int:
    """Shingles of ``n`` that reach the threshold."""
    return max(1, int(np.ceil(threshold * n - 1e-9)))


def sketch(text: str | None, width: int, threshold: float) -> tuple[int, int, np.ndarray] | None:
    """Width, size band and bottom-k MinHash values of an item; none without words."""
    words = tokens(text)
    if not words:
        return None
    w = min(width, len(words))
    h = np.unique(hashes(words, w))
    n = len(h)
    return w, n.bit_length(), h[: n - need(n, threshold) + 1]


def least(band: int, threshold: float) -> int:
    """What the smallest item of a size band needs."""
    return need(1 << (band - 1), threshold)


def contained(item: set[str], words: list[str], width: int, threshold: float) -> int:
    """Shingles of ``item`` in a document's words, or zero if they are too few."""
    shared = len(item & shingles(words, width))
    return shared if shared >= need(len(item), threshold) else 0


class Items:
    """Items by partition, as held by each executor: sketches, and texts for verification."""

    def __init__(self, rows: list[tuple[int | None, str | None]], width: int = WIDTH, threshold: float = THRESHOLD):
        self.width, self.threshold, self.rows = width, threshold, []
        by: dict[tuple[int, int], dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for item, text in rows:
            if found := sketch(text, width, threshold):
                w, band, values = found
                for h in values.tolist():
                    by[w, band][h].append(len(self.rows))
                self.rows.append((item, text))
        self.parts = [(w, least(band, threshold), np.array(sorted(m), np.uint64), m) for (w, band), m in sorted(by.items())]
        self._sets = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_sets": None, "parts": [(w, n, keys, dict(m)) for w, n, keys, m in self.parts]}

    def item(self, k: int) -> tuple[int, set[str]]:
        """Width and shingles of an item; what is asked for often stays at hand."""
        if self._sets is None:
            self._sets = lru_cache(4096)(lambda k: (w := min(self.width, len(x := tokens(self.rows[k][1]))), shingles(x, w)))
        return self._sets(k)

    def found(self, text: str | None) -> list[tuple[int | None, int, int]]:
        """``item, n_shingles, n_shared`` of the items that ``text`` contains."""
        words, own, some = tokens(text), {}, set()
        for w, n, keys, members in self.parts:
            if len(words) - w + 1 < n:
                continue
            if w not in own:
                own[w] = hashes(words, w)
            h = own[w][own[w] <= keys[-1]]
            at = np.searchsorted(keys, h)
            for x in np.unique(h[keys[at] == h]).tolist():
                some.update(members[x])
        out = []
        for k in sorted(some):
            w, s = self.item(k)
            if shared := contained(s, words, w, self.threshold):
                out.append((self.rows[k][0], len(s), shared))
        return out


def _held(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    return items.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text")).distinct()


def _bounded(items: DataFrame, most: int) -> list[tuple[int | None, str | None]] | None:
    """All items, if their text is within ``most`` bytes, each row counted as 64 more."""
    size = items.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64).alias("n")).first().n or 0
    return [(r.item, r.text) for r in items.collect()] if size <= most else None


def _key(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def _joined(docs: DataFrame, items: DataFrame, width: int, threshold: float) -> DataFrame:
    """``key, item, n_shingles, n_shared`` of distinct texts ``docs(text)`` by :func:`_key` and ``items(item, text)``, by hash joins."""
    scratch = Scratch(docs.sparkSession)

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1)):
                if found := sketch(text.as_py(), width, threshold):
                    w, band, h = found
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key] * len(h), pa.string()), pa.array([w] * len(h), pa.int32()), pa.array([band] * len(h), pa.int32()), pa.array(h.view(np.int64))], names=["i_key", "w", "band", "h"]
                    )

    texts = items.select(_key(F.col("text")).alias("i_key"), "text").distinct()
    held = scratch.table(texts.mapInArrow(sketches, "i_key string, w int, band int, h long"), "sketches")
    # a row for each width and band: at most a few hundred
    top = held.groupBy("w", "band").agg(F.max(F.struct((F.col("h") < 0).alias("high"), "h")).alias("m")).collect()
    parts: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for r in top:
        parts[r.w].append((least(r.band, threshold), r.m.h % (1 << 64)))

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1)):
                words = tokens(text.as_py())
                for w, of in parts.items():
                    most = [t for n, t in of if len(words) - w + 1 >= n]
                    if most:
                        h = np.unique(hashes(words, w))
                        h = h[h <= np.uint64(max(most))]
                        yield pa.RecordBatch.from_arrays([pa.array([key] * len(h), pa.string()), pa.array([w] * len(h), pa.int32()), pa.array(h.view(np.int64))], names=["key", "w", "h"])

    own = docs.select(_key(F.col("text")).alias("key"), "text").dropDuplicates(["key"])
    own = scratch.table(own, "texts")
    pairs = own.mapInArrow(probes, "key string, w int, h long").join(held, ["w", "h"]).select("key", "i_key").distinct()
    both = scratch.table(pairs, "pairs").join(own, "key").join(texts.withColumnRenamed("text", "item_text"), "i_key")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for key, i_key, text, item in zip(*(b.column(k).to_pylist() for k in range(4))):
                w = min(width, len(x := tokens(item)))
                s = shingles(x, w)
                if shared := contained(s, tokens(text), w, threshold):
                    out.append((key, i_key, len(s), shared))
            cols = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["key", "i_key", "n_shingles", "n_shared"])

    sure = scratch.table(both.select("key", "i_key", "text", "item_text").mapInArrow(verify, "key string, i_key string, n_shingles long, n_shared long"), "sure")
    named = items.select("item", _key(F.col("text")).alias("i_key"))
    scratch.drop("sketches", "pairs", "texts")
    return sure.join(named, "i_key").select("key", "item", "n_shingles", "n_shared")


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = WIDTH,
    threshold: float = THRESHOLD,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``doc_id, item_id, n_shingles, n_shared``: each document row and item it contains.

    Words are runs of letters and digits, lower-cased; an item of fewer words than
    ``width`` is one shingle of its own length; an item without words is in no document.
    Null texts have no words. Null ids stay in their rows. Repeated document rows
    give repeated results, repeated items give one, and items of one id with different
    texts one each. A share of exactly the threshold counts. Texts of any length are read
    whole. Empty tables give an empty result. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    named = _held(items, item_col, item_text_col)
    found = _bounded(named, broadcast_bytes)
    if found is None:
        sure = _joined(rows.select("text"), named, width, threshold)
        return rows.select("doc_id", _key(F.col("text")).alias("key")).join(sure, "key").select("doc_id", F.col("item").alias("item_id"), "n_shingles", "n_shared")
    held = docs.sparkSession.sparkContext.broadcast(Items(found, width, threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(i, *x) for i, t in zip(b.column(0).to_pylist(), b.column(1)) for x in held.value.found(t.as_py())]
            cols = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "item_id", "n_shingles", "n_shared"])

    return rows.mapInArrow(run, _FOUND)


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = WIDTH,
    threshold: float = THRESHOLD,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``docs`` without the rows that contain an item, all columns and other rows as they are, whatever the columns' names.

    The rules of :func:`contaminated` hold.
    """
    named = _held(items, item_col, item_text_col)
    found, own = _bounded(named, broadcast_bytes), Held(docs)
    text = own.at(text_col)
    if found is None:
        bad = _joined(own.df.select(F.col(text).cast("string").alias("text")), named, width, threshold).select("key").distinct()
        return own.back(own.df.withColumn("key", _key(F.col(text).cast("string"))).join(bad, "key", "left_anti"))
    held = docs.sparkSession.sparkContext.broadcast(Items(found, width, threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            clean = pa.array([not held.value.found(t.as_py()) for t in b.column(0)], pa.bool_())
            yield pa.RecordBatch.from_arrays([c.filter(clean) for c in b.columns[1:]], names=b.schema.names[1:])

    fields = [T.StructField(f"in_{k}", f.dataType) for k, f in enumerate(own.df.schema.fields)]
    sent = own.df.select(F.col(text).cast("string").alias("t"), *own.columns())
    return own.back(sent.mapInArrow(run, T.StructType(fields)))
