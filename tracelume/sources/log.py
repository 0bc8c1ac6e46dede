"""Readers of the call log and its object files.

Logs are JSON lines of three versions in one folder, a file per session. Lines that
are no JSON or of another kind are skipped; a last line without its newline is torn.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelume import schema
from tracelume.functions import expr

_COLUMNS = [c.split()[0] for c in schema.CALLS.replace(schema.TOOL_COUNT, "array").split(", ")]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``session_id, pos, line`` of the complete lines of each file; ``pos`` counts from zero."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", "true").load(path)
    return complete_lines(files.select(F.regexp_extract("path", r"([^/]*)\.jsonl$", 1).alias("session_id"), F.decode("content", "UTF-8").alias("text")))


def complete_lines(files: DataFrame) -> DataFrame:
    """Lines of ``files(session_id, text)`` that end in a newline: the piece after the last one is torn, or empty."""
    lines = F.split("text", "\n", -1)
    whole = F.slice(lines, 1, F.size(lines) - 1)
    return files.select("session_id", F.posexplode(whole).alias("pos", "line")).select("session_id", F.col("pos").cast("long").alias("pos"), "line")


def tail(lines: DataFrame, seen: DataFrame) -> DataFrame:
    """Lines beyond those already read: ``seen(session_id, next_pos)``; a session not seen is read whole."""
    found = lines.join(seen, "session_id", "left")
    return found.where(F.col("pos") >= F.coalesce("next_pos", F.lit(0))).drop("next_pos")


def _usage(u: Column) -> dict[str, Column]:
    names = {"input_tokens": "inputTokens", "output_tokens": "outputTokens", "cache_read": "cacheReadTokens", "cache_write": "cacheWriteTokens", "reasoning_tokens": "reasoningTokens"}
    return {k: u[v] for k, v in names.items()} | {"has_usage": u.isNotNull()}


def _common(r: Column) -> dict[str, Column]:
    t = r["timing"]
    return {
        "id": r["id"],
        "purpose": r["purpose"],
        "provider": r["provider"],
        "model": r["model"],
        "request_hash": r["requestHash"],
        "attempt": r["attempt"],
        "started_at": t["startedAt"],
        "duration_ms": t["endedAt"] - t["startedAt"],
        "ttfb_ms": t["firstChunkAt"] - t["startedAt"],
        "status": r["status"],
    }


def is_first(r: Column) -> Column:
    """Whether a sound record is of the first version: the later ones are told by ``v``."""
    return ~F.coalesce(r["v"].isin(2, 3), F.lit(False))


def records(lines: DataFrame, fields: str = schema.RECORD) -> DataFrame:
    """``session_id, pos, line, r`` of the sound lines of all versions, each parsed once; of no two versions, as ``v`` goes first.

    ``fields`` may leave out or read otherwise what does not tell whether a line is sound.

    The parsed line comes out of a generator, as a filter on it would be pushed below a projection and parse again.
    """
    rows = lines.select("session_id", "pos", "line", F.explode(F.array(F.from_json("line", fields))).alias("r"))
    r = F.col("r")
    later = r["id"].isNotNull() & r["sum"].isNotNull() & F.when(r["v"] == 3, r["tree"].isNotNull()).otherwise(r["refs"].isNotNull())
    return rows.where(F.when(is_first(r), r["schema"] == 1).otherwise(later))


def projected(rows: DataFrame, *also: Column | str) -> DataFrame:
    """The list projection of :func:`records`, and other columns of theirs."""
    r = F.col("r")
    first, q, p, s = is_first(r), r["request"], r["response"], r["sum"]
    kind = lambda b: F.try_variant_get(b, "$.type", "string")
    arguments = lambda b: F.coalesce(F.try_variant_get(b, "$.arguments", "string"), F.to_json(F.try_variant_get(b, "$.arguments", "variant")))
    used = F.filter(p["blocks"], lambda b: kind(b) == "tool-call")
    called = F.flatten(F.transform(used, lambda b: expr.dispatch_names(F.try_variant_get(b, "$.name", "string"), arguments(b))))
    # a column of its own, as it is read several times
    rows = rows.withColumn("_names", F.when(first, called))
    names = F.col("_names")
    count = F.transform(F.array_distinct(names), lambda n: F.struct(n.alias("name"), F.size(F.filter(names, lambda x: x == n)).cast("long").alias("count")))
    objects = F.when(r["v"] == 3, r["zn"]).otherwise(F.aggregate(r["refs"], F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x["z"], F.lit(0))))
    either = lambda a, b: F.when(first, a).otherwise(b)
    columns = {"session_id": F.col("session_id"), "pos": F.col("pos"), "version": either(F.lit(1), r["v"])} | _common(r) | _usage(either(p["usage"], s["usage"]))
    columns |= {
        "finish_kind": either(p["finish"]["kind"], s["finishKind"]),
        "finish_message": either(p["finish"]["failure"]["message"], s["finishMessage"]),
        "message_count": either(F.size(q["messages"]).cast("long"), s["messageCount"]),
        "request_chars": either(expr.request_chars(q["system"], q["messages"]), s["requestChars"]),
        "tool_calls": either(F.size(names).cast("long"), s["toolCalls"]),
        "called_tools": either(count, s["calledTools"]),
        "tool_names": either(F.transform(q["tools"], lambda t: t["name"]), s["toolNames"]),
        "line_bytes": F.octet_length("line").cast("long"),
        "object_bytes": either(F.lit(0).cast("long"), objects),
    }
    return rows.select(*[columns[c].alias(c) for c in _COLUMNS], *also)


def calls(lines: DataFrame) -> DataFrame:
    """The list projection of lines; what is no valid line of a known version gives no row."""
    return projected(records(lines))


def legacy(lines: DataFrame) -> DataFrame:
    """Lines that are not of the latest version."""
    return lines.where(~F.col("line").startswith('{"v":3'))


def referenced(lines: DataFrame) -> DataFrame:
    """``hash, is_tree`` of every hash a line names: broad on purpose, as what is named stays."""
    hashes = lines.select(F.explode(F.regexp_extract_all("line", F.lit("[0-9a-f]{64}"), 0)).alias("hash"), F.regexp_extract("line", r'"tree":"([0-9a-f]{64})"', 1).alias("_tree"))
    return hashes.groupBy("hash").agg(F.max(F.col("hash") == F.col("_tree")).alias("is_tree"))


# Object files. A frame is a magic, a codec byte and a payload; a pack is a header and blocks.
MAGIC, PACK, HEADER, ENTRY, PREAMBLE, MOST = b"DRL1", b"DRP1", 16, 40, 7, 4096
CEILING = 32 << 20


def inflate(data: bytes, most: int = CEILING) -> bytes | None:
    """Raw deflate of at most ``most`` bytes; None if it is broken or larger."""
    z = zlib.decompressobj(-15)
    try:
        out = z.decompress(data, most)
    except zlib.error:
        return None
    return out if z.eof else None


def frame(data: bytes) -> bytes | None:
    """Content of a loose object."""
    if data[:4] != MAGIC or len(data) < 5:
        return None
    return data[5:] if data[4] == 0 else inflate(data[5:]) if data[4] == 1 else None


def put_frame(body: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    packed = z.compress(body) + z.flush()
    return MAGIC + (b"\x01" + packed if len(packed) < len(body) else b"\x00" + body)


def _unpack(codec: int, payload: bytes, size: int) -> bytes | None:
    if codec == 1:
        return inflate(payload, size)
    import zstandard

    try:
        return zstandard.ZstdDecompressor().decompress(payload, max_output_size=size)
    except zstandard.ZstdError:
        return None


def blocks(data: bytes, at: int = HEADER) -> Iterator[tuple[str, bytes]]:
    """Entries of a pack's blocks, up to the first block that cannot be decoded."""
    while at + PREAMBLE <= len(data):
        length, codec, n = int.from_bytes(data[at : at + 4], "big"), data[at + 4], int.from_bytes(data[at + 5 : at + 7], "big")
        body = at + PREAMBLE + n * ENTRY
        if codec not in (1, 2) or not 0 < n <= MOST or body + length > len(data):
            return
        table = [data[k : k + ENTRY] for k in range(at + PREAMBLE, body, ENTRY)]
        spans = [(t[:32].hex(), int.from_bytes(t[32:36], "big"), int.from_bytes(t[36:], "big")) for t in table]
        raw = _unpack(codec, data[body : body + length], sum(n for _, _, n in spans))
        if raw is None:
            return
        yield from ((h, raw[o : o + n]) for h, o, n in spans)
        at = body + length


def block_entries(data: bytes) -> Iterator[tuple[str, int, bytes]]:
    """``hash, offset, content`` of one block; nothing if it cannot be decoded."""
    n = int.from_bytes(data[5:7], "big")
    offsets = [int.from_bytes(data[k + 32 : k + 36], "big") for k in range(PREAMBLE, PREAMBLE + n * ENTRY, ENTRY)]
    for (h, raw), offset in zip(blocks(data, 0), offsets):
        yield h, offset, raw


def block(objects: list[tuple[str, bytes]]) -> bytes:
    """A block of (hash, content), deflated."""
    if not 0 < len(objects) <= MOST:
        raise ValueError(f"a block has 1 to {MOST} entries, not {len(objects)}")
    table, at = b"", 0
    for h, raw in objects:
        table += bytes.fromhex(h).ljust(32, b"\0") + at.to_bytes(4, "big") + len(raw).to_bytes(4, "big")
        at += len(raw)
    z = zlib.compressobj(9, zlib.DEFLATED, -15)
    payload = z.compress(b"".join(raw for _, raw in objects)) + z.flush()
    return len(payload).to_bytes(4, "big") + b"\x01" + len(objects).to_bytes(2, "big") + table + payload


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """``hash, body`` of loose objects: files named by their hash; what does not hash to its name is left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)

    @F.pandas_udf("binary")
    def content(s: pd.Series) -> pd.Series:
        return s.map(frame)

    found = files.select(F.regexp_extract("path", r"([0-9a-f]{64})[^/]*$", 1).alias("hash"), content("content").alias("body"))
    return found.where(F.sha2("body", 256) == F.col("hash"))


def read_packs(spark: SparkSession, path: str) -> DataFrame:
    """``pack, hash, body`` of pack files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pack").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, data in zip(b.path, b.content):
                if data[:4] == PACK:
                    for h, raw in blocks(data):
                        yield pd.DataFrame({"pack": [p], "hash": [h], "body": [raw]})

    found = files.mapInPandas(run, "pack string, hash string, body binary")
    return found.where(F.sha2("body", 256) == F.col("hash"))


def envelopes(lines: DataFrame) -> DataFrame:
    """``session_id, pos, id, version, refs, tree, resp, opts`` of valid envelope lines: what a record is put together from."""
    e = F.col("e")
    rows = lines.select("session_id", "pos", F.from_json("line", schema.ENVELOPE).alias("e"))
    sound = e["id"].isNotNull() & e["sum"].isNotNull() & F.when(e["v"] == 3, e["tree"].isNotNull()).when(e["v"] == 2, e["refs"].isNotNull()).otherwise(False)
    resp = F.when(e["v"] == 3, e["resp"]).otherwise(F.get(F.filter(e["refs"], lambda x: x["k"] == "r"), F.lit(0))["h"])
    return rows.where(sound).select("session_id", "pos", e["id"].alias("id"), e["v"].alias("version"), F.when(e["v"] == 2, e["refs"]).alias("refs"), F.when(e["v"] == 3, e["tree"]).alias("tree"), resp.alias("resp"), e["opts"].alias("opts"))


_LINES = "pos bigint, line string, session_id string"


def append(lines: DataFrame, path: str) -> None:
    """Append ``lines(session_id, pos, line)``; Spark's commit makes a file whole or absent, so nothing is ever torn.

    The session is a column and not a folder: files are as many as tasks, however many sessions there are.
    """
    lines.select("session_id", "pos", "line").write.mode("append").json(path)


def tail_bytes(spark: SparkSession, path: str, seen: DataFrame | None = None) -> DataFrame:
    """``session_id, at, end, line`` of complete lines beyond what was read; ``at`` and ``end`` are byte offsets, and the largest end is the next ``seen``.

    ``seen(session_id, bytes)`` has one row per session at most. Only the bytes beyond it are read; a file that is now shorter
    was rewritten and is read whole. A torn last line waits for its end.
    """
    import pyarrow as pa
    import pyarrow.fs as pafs

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", "true").load(path)
    files = files.select("path", "length", F.regexp_extract("path", r"([^/]*)\.jsonl$", 1).alias("session_id"))
    if seen is None:
        files = files.withColumn("from", F.lit(0).cast("long"))
    else:
        at = F.coalesce("bytes", F.lit(0)).cast("long")
        files = files.join(seen.select("session_id", "bytes"), "session_id", "left").withColumn("from", F.when(at > F.col("length"), F.lit(0)).otherwise(at))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, session, start in zip(*(c.to_pylist() for c in b.columns)):
                fs, name = pafs.FileSystem.from_uri(uri)
                with fs.open_input_file(name) as f:
                    f.seek(start)
                    data = f.read()
                lines = data.split(b"\n")[:-1]
                ends, at = [], start
                for x in lines:
                    at += len(x) + 1
                    ends.append(at)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([session] * len(lines), pa.string()),
                        pa.array([e - len(x) - 1 for e, x in zip(ends, lines)], pa.int64()),
                        pa.array(ends, pa.int64()),
                        pa.array([x.decode("utf-8", "replace") for x in lines], pa.string()),
                    ],
                    names=["session_id", "at", "end", "line"],
                )

    return files.where(F.col("length") > F.col("from")).select("path", "session_id", "from").mapInArrow(run, "session_id string, at long, end long, line string")
