"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are compared exactly, with numpy exclusive-or and bit counts, tile
against tile. A tile holds fingerprints whose four 16-bit segments have the same
population counts; the summed difference of two tiles' counts is a lower bound on
the Hamming distance of anything in them, so a pair of tiles beyond the radius is
never formed. Equal fingerprints are one entry, and a tile pair gives a spanning
forest rather than its pairs, so a large group of copies stays linear.

Work: tile pairs within the radius hold about a twentieth of all pairs of distinct
fingerprints, so the comparison is quadratic in *distinct* fingerprints, with that
constant; every other step is linear.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelume.llm.components import connected_components, spanning
from tracelume.llm.names import Held
from tracelume.llm.scratch import Scratch

RADIUS, WIDTH, SEED = 4, 4, 42
#: Fingerprints in a tile; a batch of tile pairs then stays under about 80 MB.
TILE = 512
_SEGMENTS, _BITS = 4, 16
_BLOCK = 1 << 16


def simhash(data: bytes | None, width: int = WIDTH) -> int:
    """Fingerprint of a text's UTF-8 bytes: zero for null or no words."""
    words = (data or b"").lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _BLOCK):
        bits = np.unpackbits(hashes[at : at + _BLOCK].view(np.uint8), bitorder="little")
        ones += bits.reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """``id, fp``: one row per row of ``docs``; the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([simhash(x.as_py(), width) for x in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("b"))
    return rows.mapInArrow(run, "id long, fp long")


def _counts(fp: Column) -> list[Column]:
    return [F.bit_count(F.shiftrightunsigned(fp, _BITS * i).bitwiseAND(F.lit((1 << _BITS) - 1))) for i in range(_SEGMENTS)]


def _cell(counts: list[Column]) -> Column:
    cell = F.lit(0)
    for c in counts:
        cell = cell * (_BITS + 1) + c
    return cell


def _offsets(radius: int) -> list[tuple[int, ...]]:
    """Steps between count vectors within the radius, each unordered pair once."""
    steps = product(range(-radius, radius + 1), repeat=_SEGMENTS)
    zero = (0,) * _SEGMENTS
    return [s for s in steps if sum(map(abs, s)) <= radius and s >= zero]


def forest(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the links between two tiles, edges with the same connected components."""
    near = np.bitwise_count(np.bitwise_xor.outer(a, b)) <= radius
    i, j = np.nonzero(near)
    if len(i) <= len(a) + len(b):
        return a[i], b[j]
    left, right = [], []
    todo = near.any(1)
    while todo.any():
        root = int(np.argmax(todo))
        rows = np.zeros(len(a), bool)
        rows[root] = True
        cols, fresh = np.zeros(len(b), bool), rows
        while fresh.any():
            seen = near[fresh].any(0) & ~cols
            cols |= seen
            fresh = near[:, seen].any(1) & ~rows
            rows |= fresh
        # a path, not a star: no node gathers the links of a whole group
        x, y = np.flatnonzero(rows), np.flatnonzero(cols)
        chain = np.concatenate([a[x], b[y]])
        left.append(chain[:-1])
        right.append(chain[1:])
        todo &= ~rows
    return np.concatenate(left), np.concatenate(right)


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """``a, b``: edges whose components are those of all links between values of ``distinct.fp``."""
    fps = distinct.select("fp", _cell(_counts(F.col("fp"))).alias("cell"))
    # at most 17^4 rows, whatever the corpus: a bounded side
    cells = fps.groupBy("cell").agg(F.ceil(F.count("*") * 1.25 / tile).alias("n_tiles"))
    tiles = (
        fps.join(F.broadcast(cells), "cell")
        .groupBy("cell", F.pmod(F.xxhash64("fp"), F.col("n_tiles")).alias("tile"))
        .agg(F.collect_list("fp").alias("fps"))
    )
    base = _BITS + 1
    step = F.explode(F.array(*[F.struct(*[F.lit(x).alias(f"d{k}") for k, x in enumerate(o)]) for o in _offsets(radius)]))
    at = [(F.floor(F.col("cell") / base ** (_SEGMENTS - 1 - k)) % base).cast("int") + F.col(f"step.d{k}") for k in range(_SEGMENTS)]
    inside = [c.between(0, _BITS) for c in at]
    ok = inside[0]
    for c in inside[1:]:
        ok = ok & c
    guests = (
        tiles.select("*", step.alias("step"))
        .where(ok)
        .select(_cell(at).alias("to"), F.col("cell").alias("g_cell"), F.col("tile").alias("g_tile"), F.col("fps").alias("g_fps"))
        .join(F.broadcast(cells.select(F.col("cell").alias("to"))), "to", "left_semi")
    )
    pairs = tiles.join(guests, (F.col("cell") == F.col("to")) & ((F.col("cell") != F.col("g_cell")) | (F.col("tile") <= F.col("g_tile"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[np.ndarray, np.ndarray]] = []
            left, right = batch.column(0), batch.column(1)
            lv, rv = (c.values.to_numpy(zero_copy_only=False).view(np.uint64) for c in (left, right))
            lo, ro = (c.offsets.to_numpy() for c in (left, right))
            for k in range(batch.num_rows):
                a, b = forest(lv[lo[k] : lo[k + 1]], rv[ro[k] : ro[k + 1]], radius)
                if len(a):
                    out.append((a, b))
            if out:
                a, b = (np.concatenate(x).view(np.int64) for x in zip(*out))
                keep = spanning(a, b)
                yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

    return pairs.select("fps", "g_fps").mapInArrow(run, "a long, b long").distinct()


def classes(scratch: Scratch, prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``fp, label, component_id`` of each distinct fingerprint of the written table ``prints(id, fp)``.

    ``label`` names the class by its smallest fingerprint, ``component_id`` is its smallest id.
    """
    distinct = scratch.table(prints.groupBy("fp").agg(F.min("id").alias("rep")), "distinct")
    edges = scratch.table(links(distinct, radius), "edges")
    labels = connected_components(distinct.sparkSession, scratch, edges)
    linked = distinct.join(labels, distinct.fp == labels.node).select("fp", "rep", "label")
    least = linked.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = linked.join(least, "label").select("fp", "label", "component_id")
    out = distinct.join(named, "fp", "left").select("fp", F.coalesce("label", "fp").alias("label"), F.coalesce("component_id", "rep").alias("component_id"))
    out = scratch.table(out, "classes")
    scratch.drop("distinct", "edges", "labels")
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, width: int = WIDTH) -> DataFrame:
    """``id, fp, component_id``: a row per row of ``docs``, in the class of what it links to.

    ``component_id`` is the smallest id reachable over links of at most ``radius``
    differing bits. Nulls: a null text has no words and fingerprint zero, which links
    like any other; a null id keeps its row and is a ``component_id`` only if all ids of
    its class are null. Repeated rows are repeated in the result. A text of any length is
    read whole, in blocks. An empty table gives an empty result. Other columns are not read,
    whatever their names.
    """
    scratch = Scratch(docs.sparkSession)
    prints = scratch.table(fingerprints(docs, id_col, text_col, width), "prints")
    return prints.join(classes(scratch, prints, radius), "fp").select("id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, width: int = WIDTH) -> DataFrame:
    """``docs`` with one row of each class of near-duplicates: that of its smallest id, null ids last.

    Of rows of one class that share that id, the smallest fingerprint stays, and of rows that
    share both, one. The text is a string column. All columns are kept, whatever their names;
    the rules of :func:`near_duplicates` hold.
    """
    scratch, held = Scratch(docs.sparkSession), Held(docs)
    at, id_ = held.columns().index(held.at(text_col)), held.at(id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.array([simhash(x.as_py().encode() if x.is_valid else None, width) for x in b.column(at)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got)], names=[*b.schema.names, "fp"])

    marked = held.df.mapInArrow(run, T.StructType([*held.df.schema.fields, T.StructField("fp", T.LongType())]))
    marked = scratch.table(marked, "marked")
    prints = marked.select(F.col(id_).alias("id"), "fp")
    least = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "fp")).alias("one")
    kept = prints.join(classes(scratch, prints, radius), "fp").groupBy("label").agg(least).select(F.col("one.id").alias("k_id"), F.col("one.fp").alias("k_fp"))
    kept = scratch.table(kept, "kept")
    out = marked.join(kept, (F.col("fp") == F.col("k_fp")) & F.col(id_).eqNullSafe(F.col("k_id")), "left_semi")
    again = prints.join(kept, (F.col("fp") == F.col("k_fp")) & F.col("id").eqNullSafe(F.col("k_id")), "left_semi").groupBy("id", "fp").agg(F.count("*").alias("n")).where("n > 1")
    if not again.isEmpty():
        out = out.dropDuplicates([id_, "fp"])
    return held.back(out)
