"""WARC archives: writing with revisit records, and reading by boundary-chain verification.

Files are read in ranges. A task finds every place in its range where a record may
begin and the place where that record would end, its successor; the magic may also
stand inside payloads. Within the range the task follows successors to the first
beyond it. Pointer jumping from each file's start over these (candidate, exit) pairs
then marks the one true entry of each range, in a number of rounds that is the
logarithm of a file's ranges, and records are parsed from true entries only.

Files are written beside each other under a name with the task attempt, and count
once the manifest, itself a Spark table, names them: what a lost attempt left behind is
never read. Paths are opened by ``pyarrow.fs``, so any store it knows will do.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelume.llm.scratch import Scratch

#: Least payload for a revisit; bytes of a file, after which a task begins another; bytes of a range.
REVISIT_BYTES, FILE_BYTES, RANGE_BYTES = 1000, 256 << 20, 4 << 20
DATE = "2024-01-01T00:00:00Z"
_GZ, _PLAIN = re.compile(rb"\x1f\x8b\x08"), re.compile(rb"WARC/1\.[01]\r\n")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_STEP = 1 << 16


def _id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A response record, or a revisit whose block is the HTTP header alone."""
    digest = hashlib.sha1(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_id(page_id, digest.hexdigest())}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~-._' + chr(39)) if url else f'urn:page:{page_id}'}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest.digest()).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_id(refers_to, digest.hexdigest())}", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", gzip: bool = True, file_bytes: int = FILE_BYTES, least: int = REVISIT_BYTES) -> DataFrame:
    """Write a record per row of ``pages`` under ``path``; the manifest ``file, bytes, records``.

    Of rows with equal payloads of at least ``least`` bytes, those with the largest id are
    responses, others are revisits of it; rows that repeat that id are responses, too. A
    null payload is empty. A null id is smaller than any; if all ids of a payload are null,
    its rows are responses. A null url becomes a urn. An empty table writes no file.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark)
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload")
    ).withColumn("digest", F.sha1("payload"))
    firsts = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = scratch.table(firsts.select("digest", "first"), "firsts")
    told = rows.join(firsts, "digest", "left").select("page_id", "url", "payload", "first")
    base = path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(base)
        fs.create_dir(root, recursive=True)
        task = TaskContext.get()
        out, done, at, n = None, [], 0, 0

        def close() -> None:
            nonlocal out, at, n
            if out is not None:
                out.close()
                done.append((name, at, n))
            out, at, n = None, 0, 0

        for b in batches:
            for k in range(b.num_rows):
                page, url, payload, first = (c[k].as_py() for c in b.columns)
                if out is None:
                    name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{len(done)}.warc" + ".gz" * gzip
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                data = record(page, url, payload, first, first is not None and page != first)
                data = _member(data) if gzip else data
                out.write(data)
                at, n = at + len(data), n + 1
                if at >= file_bytes:
                    close()
        close()
        if done:
            names, sizes, counts = zip(*done)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], names=["file", "bytes", "records"])

    return scratch.table(told.mapInArrow(run, "file string, bytes long, records long"), "manifest")


class _File:
    """A file's bytes by offset, read forward in steps."""

    def __init__(self, fs, path: str, size: int):
        self.f, self.size, self.at, self.held = fs.open_input_file(path), size, 0, b""

    def read(self, at: int, n: int) -> bytes:
        n = max(0, min(n, self.size - at))
        if not (self.at <= at and at + n <= self.at + len(self.held)):
            self.f.seek(at)
            self.held, self.at = self.f.read(min(self.size - at, max(n, 1 << 20))), at
        return self.held[at - self.at : at - self.at + n]


def _unpacked(src: _File, at: int, gzip: bool, most: int | None = None) -> tuple[bytes, int] | None:
    """Bytes of the record at ``at`` (the first ``most``), and where it ends; none if it is no whole record."""
    if gzip:
        z, parts, k = zlib.decompressobj(31), [], at
        try:
            while not z.eof:
                piece = src.read(k, _STEP)
                if not piece:
                    return None
                parts.append(z.decompress(piece))
                k += len(piece)
                if len(parts) == 1 and not _PLAIN.match(parts[0][:16]):
                    return None
        except zlib.error:
            return None
        return b"".join(parts), k - len(z.unused_data)
    n = 1 << 12
    while True:
        head = src.read(at, n)
        if not _PLAIN.match(head[:16]):
            return None
        end = head.find(b"\r\n\r\n")
        if end >= 0:
            break
        if len(head) < n or n > 1 << 20:
            return None
        n *= 4
    length = re.search(rb"\r\ncontent-length:[ \t]*(\d{1,18})\r\n", head[: end + 2], re.I)
    if not length:
        return None
    stop = end + 4 + int(length[1]) + 4
    if at + stop > src.size or src.read(at + stop - 4, 4) != b"\r\n\r\n":
        return None
    return (head if most is not None else src.read(at, stop)), at + stop


def _candidates(src: _File, lo: int, hi: int, gzip: bool) -> Iterator[tuple[int, int]]:
    """``offset, successor`` of each place from ``lo`` before ``hi`` where a record may begin."""
    magic, width = (_GZ, 3) if gzip else (_PLAIN, 10)
    data = src.read(lo, hi - lo + width - 1)
    for m in magic.finditer(data):
        if lo + m.start() < hi and (found := _unpacked(src, lo + m.start(), gzip, 0)):
            yield lo + m.start(), found[1]


def _ranges(manifest: DataFrame, range_bytes: int) -> DataFrame:
    k = F.explode(F.sequence(F.lit(0), F.floor((F.col("bytes") - 1) / range_bytes).cast("long")))
    return manifest.where("bytes > 0").select("file", "bytes", k.alias("range"))


def reachable_entries(spark: SparkSession, scratch: Scratch, candidates: DataFrame) -> DataFrame:
    """``file, off`` of the candidates ``file, off, exit`` that pointer jumping from offset 0 reaches."""
    nodes = candidates.select("file", "off", F.col("exit").alias("jump"), (F.col("off") == 0).alias("seen"))
    nodes = scratch.table(nodes, "nodes")
    while True:
        ahead = nodes.select("file", F.col("off").alias("jump"), F.col("jump").alias("next"))
        told = nodes.where("seen").select("file", F.col("jump").alias("off")).distinct().withColumn("told", F.lit(True))
        out = nodes.join(ahead, ["file", "jump"], "left").join(told, ["file", "off"], "left")
        out = out.select("file", "off", F.col("next").alias("jump"), (F.col("seen") | F.coalesce("told", F.lit(False))).alias("seen"), F.col("seen").alias("was"))
        nodes = scratch.table(out, "nodes")
        if nodes.where("seen and not was").isEmpty():
            return nodes.where("seen").select("file", "off")


def read_archives(spark: SparkSession, path: str, manifest: DataFrame, gzip: bool = True, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """A row per record of the manifest's files: file, off, record_type, page_id, url, payload_digest, payload_bytes, refers_to, payload.

    ``payload_bytes`` is the full payload's length and ``payload_digest`` its lower-case hex
    SHA-1; for responses both are taken from the payload as read, for revisits from the
    record. Bytes after the last whole record of a file are not records. Other record types
    are kept with the fields they have.
    """
    scratch = Scratch(spark)
    ranges = _ranges(manifest, range_bytes)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(path)
        for b in batches:
            for name, size, k in zip(*(c.to_pylist() for c in b.columns)):
                hi = min(size, (k + 1) * range_bytes)
                found = list(_candidates(_File(fs, f"{root}/{name}", size), k * range_bytes, hi, gzip))
                leave: dict[int, int] = {}
                for off, after in reversed(found):
                    leave[off] = leave.get(after, after)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(leave), pa.string()), pa.array(list(leave), pa.int64()), pa.array(list(leave.values()), pa.int64())], names=["file", "off", "exit"])

    # a range is little work, so tasks follow the number of ranges
    tasks = max(1, min(100_000, ranges.count() // 2))
    candidates = ranges.repartition(tasks, "file", "range").mapInArrow(scan, "file string, off long, exit long")
    entries = reachable_entries(spark, scratch, candidates)
    sized = entries.join(manifest.select("file", "bytes"), "file").select("file", "bytes", "off")
    # with local jumps, the first reachable place of a range is where its records begin
    starts = sized.groupBy("file", "bytes", F.floor(F.col("off") / range_bytes).alias("range")).agg(F.min("off").alias("off"))
    starts = scratch.table(starts, "starts")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(path)
        for b in batches:
            for name, size, k, off in zip(*(c.to_pylist() for c in b.columns)):
                src, hi, rows, held = _File(fs, f"{root}/{name}", size), (k + 1) * range_bytes, [], 0
                while off < min(hi, size) and (found := _unpacked(src, off, gzip)):
                    rows.append((name, off, *_parsed(found[0])))
                    held += len(found[0])
                    off = found[1]
                    if held > 8 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return starts.select("file", "bytes", "range", "off").repartition(tasks, "file", "range").mapInArrow(parse, _SCHEMA)


_SCHEMA = "file string, off long, record_type string, page_id long, url string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[x.split()[0] for x in _SCHEMA.split(", ")])


def _parsed(data: bytes) -> tuple:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    number = lambda k: int(fields[k]) if re.fullmatch(r"-?\d+", fields.get(k, "")) else None
    block = rest[: number("content-length") or 0]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = fields.get("warc-type")
    if kind == "response":
        digest, size = hashlib.sha1(payload).hexdigest(), len(payload)
    else:
        b32 = re.fullmatch(r"sha1:([A-Z2-7]{32})", fields.get("warc-payload-digest", ""))
        length = re.search(rb"\r\ncontent-length:[ \t]*(\d+)", http, re.I)
        digest, size, payload = base64.b32decode(b32[1]).hex() if b32 else None, int(length[1]) if length else None, None
    return kind, number("x-page-id"), fields.get("warc-target-uri"), digest, size, number("x-refers-to-page-id"), payload
