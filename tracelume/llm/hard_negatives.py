"""Hard negatives of anchors by a two-dimensional block matrix product.

Rows are sharded into blocks, and their vectors into chunks of dimensions. A block of
anchors meets every block of rows chunk by chunk; each meeting gives a partial tile of
int64 scores, and partial tiles of the same two blocks are shuffled together and added.
What leaves a tile is its best few per anchor, or per anchor and positive, and the best of
all tiles are the result. No task holds more than a pair of blocks.

The first product takes only pairs of blocks that may share a label, for the positives; the
second takes all others' labels, with the positives' score windows beside the partial tiles.
"""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelume.llm.scratch import Scratch

#: Rows in a block, anchors in a block, dimensions in a chunk.
ROWS, ANCHORS, CHUNK = 1024, 512, 32
_BLOCK = "uids array<long>, ids array<long>, labels array<long>, parts array<long>"
_BEST = "a_uid long, a_id long, p_uid long, p_id long, p_score long, uid long, id long, score long"


def _blocks(rows: DataFrame, many: int, buckets: int, chunks: int, chunk: int) -> DataFrame:
    """``block, bucket, k`` and the block's rows by id: buckets of labels, split by hash into blocks of about ``many`` rows."""
    sized = rows.withColumn("bucket", F.pmod(F.xxhash64("label"), F.lit(buckets)).cast("int"))
    counts = sized.groupBy("bucket").agg(F.ceil(F.count("*") / many).alias("n"))
    upto = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # at most as many rows as buckets
    counts = counts.withColumn("base", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    placed = sized.join(F.broadcast(counts), "bucket").withColumn("block", (F.col("base") + F.pmod(F.xxhash64("uid"), F.col("n"))).cast("int"))
    at = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("k")
    cut = placed.select("block", "bucket", "uid", "id", "label", "v", at).withColumn("part", F.slice("v", F.col("k") * chunk + 1, F.lit(chunk)))
    zero = F.array_repeat(F.lit(0).cast("long"), chunk)
    part = F.slice(F.concat("part", zero), 1, chunk)
    got = cut.groupBy("block", "bucket", "k").agg(F.sort_array(F.collect_list(F.struct("id", "uid", "label", part.alias("part")))).alias("r"))
    pick = lambda c: F.transform("r", lambda x: x[c])
    return got.select("block", "bucket", "k", pick("uid").alias("uids"), pick("id").alias("ids"), pick("label").alias("labels"), F.flatten(pick("part")).alias("parts"))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact int64 scores of the rows of ``a`` with those of ``b``: in doubles where they hold every sum."""
    most = lambda x: int(np.abs(x).max(initial=0))
    if most(a) * most(b) * max(1, a.shape[1]) < 1 << 53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


def _pack(tile: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(tile.reshape(-1).view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpack(data: bytes, shape: tuple[int, int]) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.int64).reshape(shape)


_PARTIAL = "a int, b int, k int, a_uids array<long>, a_ids array<long>, a_labels array<long>, uids array<long>, ids array<long>, labels array<long>, tile binary, w_uid array<long>, w_p_uid array<long>, w_p_id array<long>, w_score array<long>"


def _array(x) -> np.ndarray:
    return np.array(x.as_py() if isinstance(x, pa.Scalar) else x, np.int64)


def _partials(anchors: DataFrame, rows: DataFrame, n_anchors: int, chunk: int, same: bool) -> DataFrame:
    """Partial tiles of each pair of blocks and chunk; with ``same`` only of pairs that may share a label."""
    left = anchors.select(F.col("block").alias("a"), F.col("bucket").alias("a_bucket"), "k", *[F.col(c).alias(f"a_{c}") for c in ("uids", "ids", "labels", "parts")])
    right = rows.withColumnRenamed("block", "b")
    if same:
        pairs = left.join(right, (F.col("a_bucket") == F.col("bucket")) & (left.k == right.k)).drop(right.k)
    else:
        pairs = right.withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(n_anchors - 1)))).join(left, ["a", "k"])

    def run(batches):
        for batch in batches:
            for j in range(batch.num_rows):
                a, b, k, a_uids, a_ids, a_labels, a_parts, uids, ids, labels, parts = (c[j] for c in batch.columns)
                tile = product(_array(a_parts.values.to_numpy()).reshape(-1, chunk), _array(parts.values.to_numpy()).reshape(-1, chunk))
                # who the rows are goes along once
                who = [x.as_py() if k.as_py() == 0 else None for x in (a_uids, a_ids, a_labels, uids, ids, labels)]
                row = [a.as_py(), b.as_py(), k.as_py(), *who, _pack(tile), None, None, None, None]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _TYPES)], names=_NAMES)

    cols = ["a", "b", "k", "a_uids", "a_ids", "a_labels", "a_parts", "uids", "ids", "labels", "parts"]
    return pairs.select(*cols).mapInArrow(run, _PARTIAL)


_LONGS = pa.list_(pa.int64())
_TYPES = [pa.int32()] * 3 + [_LONGS] * 6 + [pa.binary()] + [_LONGS] * 4
_NAMES = [c.strip().split()[0] for c in _PARTIAL.split(",")]


def _best(partials: DataFrame, positives: int, negatives: int, low: int, high: int, of: int) -> DataFrame:
    """Added tiles' best rows: of an anchor's label, or, where windows came along, of other labels for each positive."""

    def run(table: pa.Table) -> pa.Table:
        out, tile, who, window = [], None, None, None
        parts = table.to_pylist()
        who = next((p for p in parts if p["k"] == 0), None)
        if who is None:  # windows of blocks that have no tile
            return _rows([])
        shape = (len(who["a_uids"]), len(who["uids"]))
        for p in parts:
            if p["k"] < 0:
                window = p
            else:
                part = _unpack(p["tile"], shape)
                tile = part if tile is None else tile + part
        a_uids, a_ids, a_labels, uids, ids, labels = (_array(who[c]) for c in ("a_uids", "a_ids", "a_labels", "uids", "ids", "labels"))
        order = np.argsort(-tile, axis=1, kind="stable")  # rows of a block are in order of id
        same = a_labels[:, None] == labels[None, :]
        if window is None:
            for i in range(shape[0]):
                o = order[i][(same[i] & (uids != a_uids[i]))[order[i]]][:positives]
                out += [(a_uids[i], a_ids[i], None, None, None, u, d, s) for u, d, s in zip(uids[o], ids[o], tile[i, o])]
            return _rows(out)
        at = {u: i for i, u in enumerate(a_uids.tolist())}
        lists = {}
        for u, p_uid, p_id, score in zip(window["w_uid"], window["w_p_uid"], window["w_p_id"], window["w_score"]):
            i = at[u]
            if i not in lists:
                o = order[i][~same[i][order[i]]]
                lists[i] = o, -tile[i, o]
            o, falling = lists[i]
            top, least = high * score // of, -(-low * score // of)
            o = o[np.searchsorted(falling, -top, "left") : np.searchsorted(falling, -least, "right")][:negatives]
            out += [(u, a_ids[i], p_uid, p_id, score, x, d, s) for x, d, s in zip(uids[o], ids[o], tile[i, o])]
        return _rows(out)

    return partials.groupBy("a", "b").applyInArrow(run, _BEST)


def _rows(rows: list[tuple]) -> pa.Table:
    names = [c.strip().split()[0] for c in _BEST.split(",")]
    columns = zip(*rows) if rows else [[]] * len(names)
    return pa.table({c: pa.array([None if x is None else int(x) for x in v], pa.int64()) for c, v in zip(names, columns)})


def _first(best: DataFrame, by: list[str], n: int) -> DataFrame:
    place = Window.partitionBy(*by).orderBy(F.desc("score"), "id", "uid")
    return best.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= n)


def hard_negatives(rows: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256,
                   positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, of: int = 100, block: int = ROWS, chunk: int = CHUNK) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    A component x counts as floor(``scale`` * x); the score of two rows is their integer inner product, exact, and higher
    comes first, ties by smaller id. Each row of ``anchors`` has the first ``positives`` other rows of its label; for each of
    them come the first ``negatives`` rows of other labels with low * positive <= of * negative <= high * positive.

    Labels are integers. Rows with a null id, label or vector, or a null or non-finite component, take no part; a shorter
    vector counts as ending in zeros, an empty one as zeros. Components beyond what int64 scores can hold are cut to that
    (for 64 dimensions 2^28). Rows that share an id are rows of their own: each such anchor has results, and a copy of an anchor may be
    its positive. An empty table, or one without anchors, gives no rows. Other columns are not read.
    """
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession)
    named = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"), anchors.alias("anchor"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    known = named.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(sound, F.lit(False)))
    known = scratch.table(known.withColumn("uid", F.monotonically_increasing_id()), "vectors")
    dims, n, n_anchors = known.agg(F.max(F.size("v")), F.count("*"), F.count_if("anchor")).first()
    dims = max(1, dims or 1)
    most = isqrt((1 << 62) // dims)
    # floor of a double beyond a long is the largest long
    known = known.withColumn("v", F.transform("v", lambda x: F.greatest(F.lit(-most), F.least(F.lit(most), F.floor(F.lit(float(scale)) * x)))))
    chunks = -(-dims // chunk)
    buckets = max(1, min(1024, n // block))
    a = scratch.table(_blocks(known.where("anchor"), ANCHORS, buckets, chunks, chunk), "anchor_blocks")
    b = scratch.table(_blocks(known, block, buckets, chunks, chunk), "row_blocks")
    scratch.drop("vectors")
    first = _best(_partials(a, b, 0, chunk, True), positives, negatives, low, high, of)
    near = scratch.table(_first(first, ["a_uid"], positives).select("a_uid", F.col("uid").alias("p_uid"), F.col("id").alias("p_id"), F.col("score").alias("p_score")), "positives")
    last = lambda t: (t.agg(F.max("block")).first()[0] or 0)
    n_a, n_b = last(a) + 1, last(b) + 1
    owner = a.where("k = 0").select(F.col("block").alias("a"), F.explode("uids").alias("a_uid"))
    window = near.join(owner, "a_uid").groupBy("a").agg(*[F.collect_list(c).alias(w) for c, w in (("a_uid", "w_uid"), ("p_uid", "w_p_uid"), ("p_id", "w_p_id"), ("p_score", "w_score"))])
    window = window.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_b - 1))))
    none = {c: F.lit(None).cast("array<long>").alias(c) for c in _NAMES[3:9]}
    window = window.select("a", "b", F.lit(-1).alias("k"), *none.values(), F.lit(None).cast("binary").alias("tile"), "w_uid", "w_p_uid", "w_p_id", "w_score")
    # without windows a block of anchors has no positives, so its tiles are not needed
    tiles = _partials(a, b, n_a, chunk, False).join(F.broadcast(window.select("a").distinct()) if n_a <= 1 << 16 else window.select("a").distinct(), "a", "left_semi")
    best = _best(tiles.select(*_NAMES).union(window.select(*_NAMES)), positives, negatives, low, high, of)
    out = _first(best.where("p_uid is not null"), ["a_uid", "p_uid"], negatives)
    return out.select(F.col("a_id").alias("anchor_id"), F.col("p_id").alias("positive_id"), "rank", F.col("id").alias("negative_id"), F.col("p_score").alias("positive_score"), F.col("score").alias("negative_score"))
