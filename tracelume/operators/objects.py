"""Content-addressed pieces: extraction, deduplicated storage, reassembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelume.functions import expr
from tracelume.operators import tree


def parts(system: Column, tools: Column, messages: Column) -> Column:
    """array<struct<k,body>>: system, tools, then each message; absent parts give none."""
    piece = lambda k, b: F.struct(F.lit(k).alias("k"), b.alias("body"))
    whole = F.concat(F.array(piece("s", system), piece("t", tools)), F.transform(messages, lambda m: piece("m", m)))
    return F.filter(whole, lambda p: p["body"].isNotNull())


def request_pieces(calls: DataFrame) -> DataFrame:
    """``call, at, pos, k, hash, body, z``: system, tools, then each message, in that order.

    ``calls(call, at, system, tools, messages array<string>)`` with bodies as exact text;
    absent parts give no piece. ``z`` is the body's bytes.
    """
    rows = calls.select("call", "at", F.posexplode(parts(F.col("system"), F.col("tools"), F.col("messages"))).alias("pos", "p"))
    return rows.select("call", "at", F.col("pos").cast("long").alias("pos"), "p.k", expr.content_hash(F.col("p.body")).alias("hash"), "p.body", F.octet_length("p.body").cast("long").alias("z"))


def put(pieces: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Pieces to append: one of each hash that ``stored`` lacks; what does not hash to its key is refused."""
    sound = pieces.where(expr.content_hash(F.col("body")) == F.col("hash"))
    fresh = sound.groupBy("hash").agg(F.min("k").alias("k"), F.first("body").alias("body"), F.first("z").alias("z"))
    return fresh if stored is None else fresh.join(stored.select("hash"), "hash", "left_anti")


def first_bytes(pieces: DataFrame) -> DataFrame:
    """``call, bytes``: of pieces whose first appearance, by (at, call, pos), is in the call; no row for calls that add none."""
    firsts = pieces.groupBy("hash").agg(F.min(F.struct("at", "call", "pos")).alias("f"), F.first("z").alias("z"))
    return firsts.groupBy(F.col("f.call").alias("call")).agg(F.sum("z").alias("bytes"))


def marginal_bytes(pieces: DataFrame) -> DataFrame:
    """:func:`first_bytes`, and zero for calls that add none."""
    return pieces.select("call").distinct().join(first_bytes(pieces), "call", "left").select("call", F.coalesce("bytes", F.lit(0).cast("long")).alias("bytes"))


def unavailable(h: Column) -> Column:
    return F.concat(F.lit('{"$unavailable":"'), h, F.lit('"}'))


def reassemble(entries: DataFrame, stored: DataFrame) -> DataFrame:
    """``call, bodies``: each call's pieces in order; a piece that is not stored is a placeholder.

    ``entries(call, pos, hash)``. Hashes are looked up once each; the lookup is a hash join,
    as neither side is bounded.
    """
    found = entries.join(stored.select("hash", "body"), "hash", "left")
    body = F.coalesce("body", unavailable(F.col("hash")))
    ordered = F.array_sort(F.collect_list(F.struct("pos", body.alias("body"))))
    return found.groupBy("call").agg(ordered.alias("o")).select("call", F.transform("o", lambda x: x["body"]).alias("bodies"))


def with_response(calls: DataFrame, stored: DataFrame) -> DataFrame:
    """``calls(call, resp)`` with ``response``: the piece, its placeholder, or null where there was none."""
    found = calls.join(stored.select(F.col("hash").alias("resp"), "body"), "resp", "left")
    return found.withColumn("response", F.when(F.col("resp").isNotNull(), F.coalesce("body", unavailable(F.col("resp"))))).drop("body")


def verified(stored: DataFrame) -> DataFrame:
    """Stored pieces that hash to their key."""
    return stored.where(expr.content_hash(F.col("body")) == F.col("hash"))


def packing_order(lists: DataFrame) -> DataFrame:
    """``hash, rank``: order of first appearance over ``lists(at, seq, hashes)`` sorted by time, then place.

    A global order needs one sort; it runs over distinct hashes, by range, and ranks come
    from the sorted partitions' sizes rather than from one task.
    """
    spark = lists.sparkSession
    firsts = lists.select("at", "seq", F.posexplode("hashes").alias("pos", "hash")).groupBy("hash").agg(F.min(F.struct("at", "seq", "pos")).alias("f"))
    ordered = firsts.select("hash", "f.*").orderBy("at", "seq", "pos").withColumn("_part", F.spark_partition_id()).withColumn("_mono", F.monotonically_increasing_id())
    ordered = ordered.select("hash", "_part", F.col("_mono").bitwiseAND(F.lit((1 << 33) - 1)).alias("_row"))
    ordered = tree.checkpointed(ordered)
    sizes = sorted((r._part, r.n) for r in ordered.groupBy("_part").agg(F.count("*").alias("n")).collect())
    before, rows = 0, []
    for part, n in sizes:
        rows.append((part, before))
        before += n
    offsets = spark.createDataFrame(rows, "_part int, _before long")
    return ordered.join(F.broadcast(offsets), "_part").select("hash", (F.col("_before") + F.col("_row") + 1).alias("rank"))


def census(files: DataFrame) -> DataFrame:
    """Number and bytes of objects, from a ``binaryFile`` listing."""
    return files.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0).cast("long")).alias("bytes"))




def detail(envelopes: DataFrame, nodes: DataFrame, stored: DataFrame) -> DataFrame:
    """``session_id, pos, id, version, system, tools, messages, response, complete, opts``: whole records from envelopes, by their place in the log.

    Ids may repeat. A ``system`` that is stored as a JSON string is its text. ``envelopes`` as from :func:`tracelume.sources.log.envelopes`; ``nodes(hash, parent, entries)``
    with entries of ``k:hash``; ``stored(hash, body)``. Pieces of both versions are looked up in
    one hash join. A piece that is not stored is its placeholder; a tree that cannot be
    resolved gives no pieces, and either makes ``complete`` false.
    """
    key = F.struct("session_id", "pos")
    trees = tree.resolve(envelopes.where("tree is not null").select(key.alias("call"), F.col("tree").alias("hash")), nodes)
    third = trees.select(F.col("call.session_id").alias("session_id"), F.col("call.pos").alias("pos"), F.transform("entries", lambda x: F.struct(F.substring(x, 1, 1).alias("k"), F.substring(x, 3, 64).alias("h"))).alias("e"))
    second = envelopes.where("tree is null").select("session_id", "pos", F.transform(F.filter("refs", lambda x: x["k"] != "r"), lambda x: F.struct(x["k"].alias("k"), x["h"].alias("h"))).alias("e"))
    lists = second.union(third)
    rows = lists.select("session_id", "pos", F.posexplode_outer("e").alias("n", "x")).select("session_id", "pos", "n", "x.k", F.col("x.h").alias("hash"))
    found = rows.join(stored.select("hash", "body"), "hash", "left")
    body = F.when(F.col("hash").isNotNull(), F.coalesce(F.col("body").cast("string"), unavailable(F.col("hash"))))
    whole = found.withColumns({"lost": F.col("hash").isNotNull() & F.col("body").isNull(), "body": body})
    parts = whole.groupBy("session_id", "pos").agg(F.array_sort(F.collect_list(F.when(F.col("hash").isNotNull(), F.struct("n", "k", "body")))).alias("p"), F.max("lost").alias("lost"))
    of = lambda k: F.transform(F.filter("p", lambda x: x["k"] == k), lambda x: x["body"])
    text = lambda b: F.coalesce(F.when(b.startswith('"'), F.try_variant_get(F.try_parse_json(b), "$", "string")), b)
    parts = parts.select("session_id", "pos", text(F.get(of("s"), F.lit(0))).alias("system"), F.get(of("t"), F.lit(0)).alias("tools"), of("m").alias("messages"), "lost")
    resolved = lists.select("session_id", "pos", F.col("e").isNotNull().alias("resolved"))
    out = envelopes.select("session_id", "pos", "id", "version", "resp", "opts").join(parts, ["session_id", "pos"]).join(resolved, ["session_id", "pos"])
    out = with_response(out, stored)
    gone = F.col("resp").isNotNull() & (F.col("response") == unavailable(F.col("resp")))
    return out.select("session_id", "pos", "id", "version", "system", "tools", "messages", "response", (F.col("resolved") & ~F.col("lost") & ~F.coalesce(gone, F.lit(False))).alias("complete"), "opts")
