"""Near-duplicates by exact Jaccard similarity of word shingles.

Shingles have one global order, and a text's sketch is its first ``SKETCH`` in it: a bottom-k
MinHash. Of two sets of similarity 0.8 each of the first of both is in both with 0.8, so none of
sixteen is shared once in 10^11; what is similar stands together under some shingle. What
stands under a shingle is not paired with each other, which would be quadratic in a group of
copies: a pivot, drawn by hash for each shingle, is compared with the others, over the
texts themselves. Near copies share many shingles, each with a pivot of its own, so their
class is soon connected. Shingles under which two classes still stand are drawn for
again, between classes only, until a round links nothing. Two texts alone under a shingle
are always compared, and nothing is linked by chance; what could be missed is a link of
three or more that every pivot passed by. Before texts move, pairs are compared by bitmaps of
their shingles: of each bit that one has alone the text has a shingle that the other has
not, so what is passed over is not similar for certain. No pair's texts are compared twice.

The order puts shingles that stand often among all documents' ``LOOK`` of least hash behind all others, by
hash within. It decides only how many pairs are looked at: any order gives the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelume.llm.components import connected_components
from tracelume.llm.names import Held
from tracelume.llm.scratch import Scratch
from tracelume.llm.simhash import classes, simhash

WIDTH = 5
#: Least documents that hold a frequent shingle, or one document in so many if those are more.
OFTEN, SHARE = 4, 5_000
#: Shingles of a text's sketch, and those that are counted: behind as many frequent ones a sketch has others.
SKETCH, LOOK = 16, 64
#: Bits of a text's bitmap.
BITS = 2048
_LATE = 1 << 62


def shingles(text: str | None, width: int = WIDTH) -> set[bytes]:
    """Words in a row, as :func:`simhash.simhash` takes them; all words of a shorter text, none of an empty one."""
    words = (text or "").encode().lower().split()
    if len(words) < width:
        return {b" ".join(words)} if words else set()
    return set(map(b" ".join, zip(*(words[i:] for i in range(width)))))


def similar(a: set[bytes], b: set[bytes]) -> bool:
    """Whether the Jaccard similarity is 0.8 or more."""
    both = len(a & b)
    return 5 * both >= 4 * (len(a) + len(b) - both)


def _hashes(text: str | None, width: int) -> np.ndarray:
    found = shingles(text, width)
    return np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found)) >> np.uint64(2)


def _frequent(docs: DataFrame, text_col: str, width: int) -> np.ndarray:
    """Sorted hashes of shingles that many documents hold, of each document's first ``LOOK``: at most ``LOOK * SHARE``, as a document counts for so many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [h if len(h) <= LOOK else np.partition(h, LOOK)[:LOOK] for h in (_hashes(x.as_py(), width) for x in b.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))], names=["h"])

    least = max(OFTEN, -(-docs.count() // SHARE))
    counts = docs.select(text_col).mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return np.sort(counts.select("h").toArrow()["h"].to_numpy().view(np.uint64))  # in columns: rows of Python take thirty times that


def _drawn(shared: DataFrame, salt: int) -> DataFrame:
    """``shared(h, key, n, label)`` where several classes stand under a shingle, with its pivot ``p_key, p_n, p_label``."""
    draw = F.xxhash64("key", "h", F.lit(salt))
    # of single numbers, so that the sums are hashed and not sorted
    pivot = [F.min_by(c, draw).alias(f"p_{c}") for c in ("key", "n", "label")]
    several = shared.groupBy("h").agg(*pivot, F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").drop("lo", "hi")
    return shared.join(several, "h")


def _pairs(drawn: DataFrame) -> DataFrame:
    """``a, b``: pivots and others of another class, of sizes that may be similar; as many as rows of ``drawn`` at most."""
    near = (F.col("label") != F.col("p_label")) & (5 * F.col("n") >= 4 * F.col("p_n")) & (5 * F.col("p_n") >= 4 * F.col("n"))
    return drawn.where(near).select(F.least("key", "p_key").alias("a"), F.greatest("key", "p_key").alias("b")).distinct()


def bitmap(h: np.ndarray) -> bytes:
    """The bits that hashes set."""
    bits = np.zeros(BITS, np.uint8)
    bits[(h % np.uint64(BITS)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def may_be_similar(x: list[bytes], y: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """Whether what bitmaps tell leaves a similarity of 0.8 open: that needs at most a ninth of the summed ``sizes`` of two sets in one of them only."""
    a, b = (np.frombuffer(b"".join(z), np.uint64).reshape(-1, BITS // 64) for z in (x, y))
    return 9 * np.bitwise_count(a ^ b).sum(1, dtype=np.int64) <= sizes


def _with_bitmaps(texts: DataFrame, width: int) -> DataFrame:
    """``texts(key, t)`` with ``n``, its shingles, and ``bits``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_hashes(x.as_py(), width) for x in b.column(1)]
            more = [pa.array(map(len, found), pa.int64()), pa.array(map(bitmap, found), pa.binary())]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=["key", "t", "n", "bits"])

    return texts.select("key", "t").mapInArrow(run, T.StructType([*texts.select("key", "t").schema.fields, T.StructField("n", T.LongType()), T.StructField("bits", T.BinaryType())]))


def _left_open(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of the keys ``a, b`` those that the bitmaps of ``texts`` leave open; no text is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = may_be_similar(b.column(3).to_pylist(), b.column(4).to_pylist(), b.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok)) for c in b.columns[:2]], names=["a", "b"])

    of = lambda key, n, bits: texts.select(F.col("key").alias(key), F.col("n").alias(n), F.col("bits").alias(bits))
    both = pairs.join(of("a", "n_a", "bits_a"), "a").join(of("b", "n_b", "bits_b"), "b")
    return both.select("a", "b", F.col("n_a") + F.col("n_b"), "bits_a", "bits_b").mapInArrow(run, "a long, b long")


def _similar_pairs(scratch: Scratch, pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """Of the keys ``a, b`` of a written table those whose texts ``texts(key, t)`` are similar; no other texts are shuffled where the keys are few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [similar(shingles(x.as_py(), width), shingles(y.as_py(), width)) for x, y in zip(b.column(2), b.column(3))]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in b.columns[:2]], names=["a", "b"])

    named = scratch.table(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "named")
    some = texts.select("key", "t").join(named, "key", "left_semi")
    both = pairs.join(some.select(F.col("key").alias("a"), F.col("t").alias("x")), "a").join(some.select(F.col("key").alias("b"), F.col("t").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def linked(scratch: Scratch, sets: DataFrame, texts_of: DataFrame, width: int = WIDTH) -> DataFrame:
    """``key, label`` of the keys of the written table ``sets(key, n, sketch)`` that are linked to another; ``texts_of(key, t)`` has their texts."""
    spark = sets.sparkSession
    # most shingles stand in one text only, and are gone
    posts = sets.select("key", "n", F.explode("sketch").alias("h"))
    several = posts.groupBy("h").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi").select("h")
    shared = scratch.table(posts.join(several, "h", "left_semi").distinct().withColumn("label", F.col("key")), "shared")
    named = shared.select("key").distinct()
    texts = scratch.table(_with_bitmaps(texts_of.join(named, "key", "left_semi").dropDuplicates(["key"]), width), "texts")
    compared = edges = None
    labels, salt = spark.createDataFrame([], "node long, label long"), 0
    while True:
        drawn = scratch.table(_drawn(shared, salt), "drawn")
        pairs = _left_open(_pairs(drawn), texts)
        pairs = scratch.table(pairs if compared is None else pairs.join(compared, ["a", "b"], "left_anti"), "pairs")
        fresh = scratch.table(_similar_pairs(scratch, pairs, texts, width), "fresh")
        if fresh.isEmpty():
            break
        compared = scratch.table(pairs if compared is None else compared.union(pairs), "compared")
        edges = scratch.table(fresh if edges is None else edges.union(fresh), "edges")
        labels = connected_components(spark, scratch, edges)
        # what one class has to itself has gone
        moved = drawn.select("key", "n", "h").join(labels.withColumnRenamed("node", "key"), "key", "left")
        shared = scratch.table(moved.select("key", "n", "h", F.coalesce("label", "key").alias("label")), "shared")
        salt += 1
    scratch.drop("shared", "texts", "drawn", "pairs", "named", "fresh", "compared", "edges")
    return labels.withColumnRenamed("node", "key")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, radius: int | None = None) -> DataFrame:
    """``docs`` with one row of each class of texts linked by similarity 0.8 or more: that of its smallest id, null ids last.

    With ``radius``, of each class of SimHash fingerprints (:func:`simhash.near_duplicates`) one
    is taken first, and similarity is looked for among those; texts are read and written once for both.
    Texts of equal shingles are one class, so null and empty texts are. Of rows that share
    id and shingles one stays. The text is a string column, of any length, read whole. An empty table
    gives an empty result. All columns are kept, whatever their names. ``docs`` is a
    written table: it is read twice.
    """
    scratch, held = Scratch(docs.sparkSession), Held(docs)
    at, id_ = held.columns().index(held.at(text_col)), held.at(id_col)
    frequent = _frequent(docs, text_col, width)
    added = [T.StructField("fp", T.LongType()), T.StructField("key", T.LongType()), T.StructField("n", T.LongType()), T.StructField("sketch", T.ArrayType(T.LongType()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints, keys, sizes, sketches = [], [], [], []
            for x in b.column(at):
                text = x.as_py()
                prints.append(0 if radius is None else simhash(None if text is None else text.encode()))
                h = _hashes(text, width)
                if len(frequent):
                    place = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
                    h = h | np.where(frequent[place] == h, np.uint64(_LATE), np.uint64(0))
                h.sort()
                keys.append(xxhash.xxh64_intdigest(h.tobytes()))
                sizes.append(len(h))
                sketches.append(h[:SKETCH].view(np.int64))
            more = [pa.array(np.array(v, np.uint64).view(np.int64)) for v in (prints, keys)] + [pa.array(sizes, pa.int64()), pa.array(sketches, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, "fp", "key", "n", "sketch"])

    marked = scratch.table(held.df.mapInArrow(run, T.StructType([*held.df.schema.fields, *added])), "marked")
    least = lambda *c: F.min(F.struct(F.col("id").isNull().alias("last"), "id", *c)).alias("one")
    sets = marked.select(F.col(id_).alias("id"), "fp", "key", "n", "sketch")
    if radius is not None:
        prints = sets.select("id", "fp")
        first = prints.join(classes(scratch, prints, radius), "fp").groupBy("label").agg(least("fp")).select(F.col("one.id").alias("k_id"), F.col("one.fp").alias("k_fp"))
        first = scratch.table(first, "first")
        sets = sets.join(first, (F.col("fp") == F.col("k_fp")) & F.col("id").eqNullSafe(F.col("k_id")), "left_semi")
    sets = scratch.table(sets, "sets")
    scratch.drop("classes", "first")
    labels = linked(scratch, sets, marked.select("key", F.col(f"in_{at}").alias("t")), width)
    groups = sets.select("id", "key", "fp").join(labels, "key", "left").groupBy(F.coalesce("label", "key").alias("label"))
    kept = scratch.table(groups.agg(least("key", "fp")).select(F.col("one.id").alias("k_id"), F.col("one.key").alias("k_key"), F.col("one.fp").alias("k_fp")), "kept")
    same = (F.col("key") == F.col("k_key")) & (F.col("fp") == F.col("k_fp"))
    again = marked.select(F.col(id_).alias("id"), "key", "fp").join(kept, same & F.col("id").eqNullSafe(F.col("k_id")), "left_semi").groupBy("id", "key", "fp").agg(F.count("*").alias("c")).where("c > 1")
    out = marked.drop("sketch", "n").join(kept, same & F.col(id_).eqNullSafe(F.col("k_id")), "left_semi")
    if not again.isEmpty():
        out = out.dropDuplicates([id_, "key", "fp"])
    return held.back(out)
