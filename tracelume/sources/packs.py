"""Packs of objects as tables: an index over their blocks, reads of single blocks, packs written by tasks, packs rewritten without what is dead.

A store is a folder of packs with an index beside them: Parquet sorted by hash, with Bloom filters, in a folder for each
commit. A pack counts if a committed index names it, so what a lost task left is never read, and
a pack is retired by a commit that names it. Objects are verified by their hash wherever they are read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelume.operators import maintain, tree
from tracelume.sources import log

#: Raw bytes at which a block ends, and raw bytes of a pack.
BLOCK_BYTES, PACK_BYTES = 1 << 20, 64 << 20
VERSION = 1
INDEX = "hash string, pack string, at long, size long, raw_at long, raw_size long"
#: Hashes looked up by name, so that only row groups that may have them are read.
FEW = 256


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """``path, length`` of files; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "length")


def scan_index(spark: SparkSession, path: str) -> DataFrame:
    """The index of the packs under ``path`` from the packs themselves: entry tables are read and payloads passed over.

    A walk ends at the first block that is cut off or malformed, as what follows cannot be found.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for uri, length in ((u.as_py(), n.as_py()) for b in batches for u, n in zip(*b.columns)):
            fs, name = pafs.FileSystem.from_uri(uri)
            rows, at = [], log.HEADER
            with fs.open_input_file(name) as f:
                head = f.read(log.HEADER)
                sound = head[:4] == log.PACK and head[4:5] == bytes([VERSION])
                while sound and at + log.PREAMBLE <= length:
                    f.seek(at)
                    pre = f.read(log.PREAMBLE)
                    payload, codec, n = int.from_bytes(pre[:4], "big"), pre[4], int.from_bytes(pre[5:], "big")
                    size = log.PREAMBLE + n * log.ENTRY + payload
                    if codec not in (1, 2) or not 0 < n <= log.MOST or at + size > length:
                        break
                    table = f.read(n * log.ENTRY)
                    for k in range(0, len(table), log.ENTRY):
                        rows.append({"hash": table[k : k + 32].hex(), "pack": uri, "at": at, "size": size, "raw_at": int.from_bytes(table[k + 32 : k + 36], "big"), "raw_size": int.from_bytes(table[k + 36 : k + 40], "big")})
                    at += size
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _INDEX)

    return _files(spark, path, "*.pack").mapInArrow(run, INDEX)


_INDEX = pa.schema([("hash", pa.string()), ("pack", pa.string()), *[(c, pa.int64()) for c in ("at", "size", "raw_at", "raw_size")]])


def _commit(rows: DataFrame, path: str, kind: str, by: str) -> None:
    """``rows`` as one more part of the store's index, visible as a whole once Spark has marked it done."""
    sorted_ = tree.checkpointed(rows).repartitionByRange(by).sortWithinPartitions(by)
    sorted_.write.option("compression", "zstd").option(f"parquet.bloom.filter.enabled#{by}", "true").parquet(f"{path.rstrip('/')}/_{kind}/{uuid.uuid4().hex}")


def _committed(spark: SparkSession, path: str, kind: str, schema: str) -> DataFrame:
    fs, at = _fs(spark, f"{path.rstrip('/')}/_{kind}")
    parts = [s.getPath().toString() for s in fs.listStatus(at)] if fs.exists(at) else []
    done = [p for p in parts if fs.exists(_fs(spark, f"{p}/_SUCCESS")[1])]
    return spark.read.schema(schema).parquet(*done) if done else spark.createDataFrame([], schema)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The committed index of the store at ``path``, without retired packs."""
    return _committed(spark, path, "index", INDEX).join(_committed(spark, path, "retired", "pack string"), "pack", "left_anti").select(*_INDEX.names)


def adopt(spark: SparkSession, path: str) -> DataFrame:
    """Commit an index over packs under ``path`` that another writer left, and return it."""
    _commit(scan_index(spark, path), path, "index", "hash")
    return read_index(spark, path)


def _loose(wanted: DataFrame, folder: str) -> DataFrame:
    """``hash, body, source, bytes_read`` of those that lie loose and are sound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h, uri in zip(*(c.to_pylist() for c in b.columns)):
                fs, name = pafs.FileSystem.from_uri(uri)
                try:
                    with fs.open_input_file(name) as f:
                        data = f.read()
                except OSError:
                    continue  # unreadable now: a pack may have it
                body = log.frame(data)
                if body is not None and hashlib.sha256(body).hexdigest() == h:
                    yield pa.RecordBatch.from_arrays([pa.array([h]), pa.array([body], pa.binary()), pa.array(["loose"]), pa.array([len(data)], pa.int64())], names=_FOUND_NAMES)

    files = _files(wanted.sparkSession, folder, "*").select(F.regexp_extract("path", r"([0-9a-f]{64})$", 1).alias("hash"), "path")
    return files.join(wanted, "hash").select("hash", "path").mapInArrow(run, _FOUND)


_FOUND, _FOUND_NAMES = "hash string, body binary, source string, bytes_read long", ["hash", "body", "source", "bytes_read"]


def read_blocks(entries: DataFrame) -> DataFrame:
    """``hash, body, source, bytes_read, pack, at, raw_at`` of index entries: each block is read once, alone, and inflated to its entries' size at most.

    What does not hash to its name is left out; so are blocks of packs that are gone or cut off.
    ``bytes_read`` of a block is charged to the first of its entries.
    """
    by_block = entries.groupBy("pack", "at", "size").agg(F.sort_array(F.collect_set(F.struct("raw_at", "raw_size", "hash"))).alias("e"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                fs, name = pafs.FileSystem.from_uri(row["pack"])
                try:
                    with fs.open_input_file(name) as f:
                        f.seek(row["at"])
                        data = f.read(row["size"])
                except OSError:
                    continue
                named = {(h, o): raw for h, o, raw in log.block_entries(data)} if len(data) == row["size"] else {}
                rows, cost = [], len(data)
                for e in row["e"]:
                    raw = named.get((e["hash"], e["raw_at"]))
                    if raw is not None and hashlib.sha256(raw).hexdigest() == e["hash"]:
                        rows.append({"hash": e["hash"], "body": raw, "source": "pack", "bytes_read": cost, "pack": row["pack"], "at": row["at"], "raw_at": e["raw_at"]})
                        cost = 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _READ)

    return by_block.mapInArrow(run, _FOUND + ", pack string, at long, raw_at long")


_READ = pa.schema([("hash", pa.string()), ("body", pa.binary()), ("source", pa.string()), ("bytes_read", pa.int64()), ("pack", pa.string()), ("at", pa.int64()), ("raw_at", pa.int64())])


def lookup(wanted: DataFrame, index: DataFrame, loose: str | None = None) -> DataFrame:
    """``hash, body, source, bytes_read`` of the objects ``wanted(hash)``, each once; those that no store has sound give no row.

    Loose files come first; what is not among them, or does not hash to its name, is read from packs.
    Nulls and repeats in ``wanted`` are one or none. Up to ``FEW`` hashes are looked for by name.
    """
    asked = wanted.select("hash").where("hash is not null").distinct()
    names = [r.hash for r in asked.limit(FEW + 1).collect()]
    found = tree.checkpointed(_loose(asked, loose)) if loose else None
    left = asked.join(found, "hash", "left_anti") if loose else asked
    entries = index.where(F.col("hash").isin(names)) if len(names) <= FEW else index
    packed = read_blocks(entries.join(left, "hash", "left_semi"))
    # the same object may lie in several packs
    packed = packed.groupBy("hash").agg(F.min_by("body", F.struct("pack", "at", "raw_at")).alias("body"), F.lit("pack").alias("source"), F.sum("bytes_read").alias("bytes_read"))
    return found.union(packed) if loose else packed


def cut(objects: DataFrame, block_bytes: int = BLOCK_BYTES, most: int = log.MOST, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """``objects(hash, rank, body)``, each hash once, with ``pack`` and ``block`` numbers in order of rank.

    A block ends with the object that brings it to ``block_bytes`` raw bytes, counted from the even
    multiples of that, or with ``most`` entries; packs likewise. Sums run within ranges of ranks, and the
    driver adds one number a range.
    """
    spark = objects.sparkSession
    once = objects.groupBy("hash").agg(F.min("rank").alias("rank"), F.first("body").alias("body"))
    ranged = once.repartitionByRange("rank", "hash").withColumns({"_range": F.spark_partition_id(), "_bytes": F.octet_length("body").cast("long")})
    ranged = tree.checkpointed(ranged)
    rows, bytes_, count = [], 0, 0
    for r in sorted(ranged.groupBy("_range").agg(F.sum("_bytes").alias("b"), F.count("*").alias("n")).collect()):
        rows.append((r._range, bytes_, count))
        bytes_, count = bytes_ + r.b, count + r.n
    before = spark.createDataFrame(rows, "_range int, _upto long, _nth long")
    order = Window.partitionBy("_range").orderBy("rank", "hash")
    so_far = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.join(F.broadcast(before), "_range").withColumns({"_at": F.col("_upto") + F.coalesce(F.sum("_bytes").over(so_far), F.lit(0)), "_n": F.col("_nth") + F.row_number().over(order) - 1})
    numbers = {"pack": F.floor(F.col("_at") / pack_bytes), "block": F.struct(F.floor(F.col("_at") / block_bytes).alias("bytes"), F.floor(F.col("_n") / most).alias("entries"))}
    return placed.withColumns(numbers).select("hash", "rank", "body", "pack", "block")


def write(objects: DataFrame, path: str, block_bytes: int = BLOCK_BYTES, most: int = log.MOST, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """Write ``objects(hash, rank, body)`` as packs in order of rank and commit their index, which is returned.

    A task writes whole packs under names of its own attempt, and the index is of the attempts that
    succeeded: packs of others are named by nothing. Objects that do not hash to their name are refused.
    """
    spark = objects.sparkSession
    sound = objects.withColumn("body", F.col("body").cast("binary")).where(F.sha2("body", 256) == F.col("hash"))
    placed = cut(sound, block_bytes, most, pack_bytes)
    uri = _fs(spark, path)[0].makeQualified(_fs(spark, path)[1]).toString()
    uri = uri if ":/" in uri else f"file://{uri}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for k in range(b.num_rows) for r in b.slice(k, 1).to_pylist())
        for pack, mine in groupby(rows, key=lambda r: r["pack"]):
            target = f"{uri}/pack-{pack:08d}-{uuid.uuid4().hex}.pack"
            fs, name = pafs.FileSystem.from_uri(target)
            fs.create_dir(name.rpartition("/")[0], recursive=True)
            index, at = [], log.HEADER
            with fs.open_output_stream(name) as f:
                f.write(log.PACK + bytes([VERSION]) + bytes(log.HEADER - len(log.PACK) - 1))
                for _, group in groupby(mine, key=lambda r: tuple(r["block"].values())):
                    held = [(r["hash"], r["body"]) for r in group]
                    data, raw_at = log.block(held), 0
                    f.write(data)
                    for h, raw in held:
                        index.append({"hash": h, "pack": target, "at": at, "size": len(data), "raw_at": raw_at, "raw_size": len(raw)})
                        raw_at += len(raw)
                    at += len(data)
            yield pa.RecordBatch.from_pylist(index, _INDEX)

    index = placed.repartition("pack").sortWithinPartitions("pack", "rank", "hash").mapInArrow(run, INDEX)
    _commit(index, path, "index", "hash")
    return read_index(spark, path)


def retire(packs: DataFrame, path: str) -> None:
    """Commit that the index no longer counts ``packs(pack)``; their files can go once no reader has them open."""
    _commit(packs.select("pack").distinct(), path, "retired", "pack")


def repack(spark: SparkSession, path: str, live: DataFrame, least_bytes: int = maintain.LEAST_BYTES, ratio: float = maintain.LIVE_RATIO, loose: str | None = None, **limits: int) -> DataFrame:
    """Rewrite packs that are mostly dead: ``pack, entries, live, bytes, rewritten``.

    Which is :func:`maintain.repack_candidates`, by bytes on disk. Live objects are copied in stored order. A pack is left as it is if one
    of its live objects is nowhere, neither in a pack whose file reaches as far nor loose, which the
    index and the listings tell before any byte moves; and if one then cannot be read. The new packs are
    committed before the old ones are retired, so a crash leaves copies and never a hole.
    """
    index = tree.checkpointed(read_index(spark, path))
    files = _files(spark, path, "*.pack").select(_local(F.col("path")).alias("file"), "length")
    entries = index.withColumn("file", _local(F.col("pack"))).join(files, "file", "left")
    there = entries.where(F.col("at") + F.col("size") <= F.col("length")).select("hash").distinct()
    if loose:
        there = there.union(_files(spark, loose, "*").select(F.regexp_extract("path", r"([0-9a-f]{64})$", 1).alias("hash"))).distinct()
    # an entry's share of its block is nothing a pack is weighed by: its length is
    sizes = entries.groupBy("pack").agg(F.coalesce(F.max("length"), F.lit(0)).alias("length"), F.min("hash").alias("one"))
    weighed = entries.join(sizes.select("pack", F.col("one"), F.col("length").alias("whole")), "pack").withColumn("bytes", F.when(F.col("hash") == F.col("one"), F.col("whole")).otherwise(0))
    worth = maintain.repack_candidates(weighed.select("pack", "hash", "bytes"), live, least_bytes, ratio)
    kept = entries.join(worth.select("pack"), "pack", "left_semi").join(live.select("hash").distinct(), "hash", "left_semi")
    lost = kept.join(there, "hash", "left_anti").select("pack").distinct()
    moved = kept.join(lost, "pack", "left_anti").select("hash", "pack", "at", "raw_at")
    moved = tree.checkpointed(moved)
    bodies = tree.checkpointed(lookup(moved.select("hash"), index, loose).select("hash", "body"))
    unread = moved.join(bodies, "hash", "left_anti").select("pack").distinct()
    chosen = worth.join(lost, "pack", "left_anti").join(unread, "pack", "left_anti")
    chosen = tree.checkpointed(chosen)
    going = moved.join(chosen.select("pack"), "pack", "left_semi").join(bodies, "hash")
    write(going.select("hash", F.struct("pack", "at", "raw_at").alias("rank"), "body"), path, **limits)
    retire(chosen, path)
    done = worth.join(chosen.select("pack", F.lit(True).alias("rewritten")), "pack", "left")
    return done.select("pack", "entries", "live", "bytes", F.coalesce("rewritten", F.lit(False)).alias("rewritten"))


def _local(path):
    """A file's place without its scheme: listings and writers spell it differently."""
    return F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "/")


def _drop(files: DataFrame) -> DataFrame:
    """Delete ``files(hash, path)`` where they stand; ``hash`` of those that went."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gone = []
            for h, uri in zip(*(c.to_pylist() for c in b.columns)):
                fs, name = pafs.FileSystem.from_uri(uri)
                try:
                    fs.delete_file(name)
                except FileNotFoundError:
                    pass  # an attempt before this one had it
                gone.append(h)
            yield pa.RecordBatch.from_arrays([pa.array(gone, pa.string())], names=["hash"])

    return files.select("hash", "path").mapInArrow(run, "hash string")


def carry_out(spark: SparkSession, path: str, loose: str, roots: DataFrame, nodes: DataFrame, ranks: DataFrame, now_ms: int, budget: int = maintain.PACK_BUDGET, grace_ms: int = maintain.GRACE_MS, **limits: int) -> dict[str, int]:
    """One sweep of loose files and packs, done: numbers of objects collected and packed, and of packs rewritten.

    ``roots(hash)`` are what lines name, trees and pieces; ``nodes(hash, parent, entries)`` with entries ``k:hash``; ``ranks(hash, rank)``.
    Live is what roots reach, and the pieces of every node reached. While a reached node is missing, nothing is collected and no pack rewritten. A loose
    file goes only when a committed index names its object, so a crash leaves copies.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(loose)
    files = files.select(F.regexp_extract("path", r"([0-9a-f]{64})$", 1).alias("hash"), "path", F.col("length").alias("bytes"), F.unix_millis("modificationTime").alias("mtime_ms"))
    files = tree.checkpointed(files.where("hash <> ''"))
    marked = tree.reachable(roots, nodes)
    pieces = nodes.join(marked, "hash", "left_semi").select(F.explode("entries").alias("x")).select(F.substring("x", 3, 64).alias("hash"))
    live = tree.checkpointed(marked.union(pieces).distinct())
    # a root may be a piece, which has no node; a parent must be one
    parents = nodes.join(marked, "hash", "left_semi").where("parent is not null").select(F.col("parent").alias("hash")).distinct()
    complete = tree.missing(parents, nodes).isEmpty()
    collected = _drop(maintain.garbage(files, live, now_ms, grace_ms, complete)).count()
    cold = tree.checkpointed(maintain.pack_candidates(files, live, ranks, now_ms - grace_ms, budget).select("hash", "path", "rank"))
    bodies = tree.checkpointed(_loose(cold.select("hash"), loose).select("hash", "body"))
    last = F.coalesce("rank", F.lit((1 << 62)))
    index = write(bodies.join(cold, "hash").select("hash", F.struct(last.alias("rank"), "hash").alias("rank"), "body"), path, **limits)
    packed = _drop(cold.join(index.select("hash"), "hash", "left_semi").join(bodies.select("hash"), "hash", "left_semi")).count()
    rewritten = repack(spark, path, live, loose=loose, **limits).where("rewritten").count() if complete else 0
    return {"collected": collected, "packed": packed, "rewritten": rewritten}
