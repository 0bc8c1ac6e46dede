"""Bringing lines of older versions to the latest: an envelope, a tree of pieces, and the pieces themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelume import schema
from tracelume.functions import expr
from tracelume.operators import objects, tree
from tracelume.sources import log

#: Bytes of lines that one cycle converts.
BUDGET = 64 << 20


def batch(sessions: DataFrame, budget: int = BUDGET) -> DataFrame:
    """``sessions(session_id, failures, mtime_ms, bytes)`` that a cycle converts: fewest failures first, then newest, until their bytes reach the budget; one at least.

    Sums run in two levels, over hours and then within the hour that the budget ends in, so no task orders all sessions.
    """
    hour = F.floor(-F.col("mtime_ms") / 3_600_000)
    rows = sessions.withColumn("_hour", hour)
    hours = rows.groupBy("failures", "_hour").agg(F.sum("bytes").alias("_bytes"))
    # a row per hour and number of failures
    before = Window.orderBy("failures", "_hour").rowsBetween(Window.unboundedPreceding, -1)
    hours = hours.withColumn("_before", F.coalesce(F.sum("_bytes").over(before), F.lit(0))).where(F.col("_before") < budget).drop("_bytes")
    within = Window.partitionBy("failures", "_hour").orderBy(F.desc("mtime_ms"), "session_id").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(hours, ["failures", "_hour"]).withColumn("_spent", F.col("_before") + F.coalesce(F.sum("bytes").over(within), F.lit(0)))
    first = (F.col("_spent") == 0) if budget <= 0 else F.lit(False)
    return out.where((F.col("_spent") < budget) | first).drop("_hour", "_before", "_spent")


_PIECES = "array<struct<k:string,hash:string,body:string,z:bigint>>"


def _quoted(text: Column) -> Column:
    """A JSON string of ``text``."""
    whole = F.to_json(F.struct(text.alias("x")))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


#: Escapes that the parser makes of a character beyond the first 65,536; an even number of backslashes stands before, which is looked at only where an escape follows.
_PAIR = r"(?=\\uD)(?<=(?:^|[^\\])(?:\\\\){0,64})\\u(D[89AB][0-9A-F]{2})\\u(D[C-F][0-9A-F]{2})"


def _plain(text: Column) -> Column:
    """JSON with such characters themselves, as writers leave them."""
    pairs = F.transform(F.regexp_extract_all(text, F.lit(_PAIR), F.lit(0)), lambda x: F.decode(F.unhex(F.regexp_replace(x, r"\\u", "")), "UTF-16BE"))
    parts = F.split(text, _PAIR, -1)
    joined = F.concat(F.get(parts, F.lit(0)), F.array_join(F.zip_with(pairs, F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda a, b: F.concat(a, b)), ""))
    return F.when(text.contains("\\uD"), joined).otherwise(text)


def _options(r: Column) -> Column:
    """The request options, or null if there are none: they stay in the line."""
    some = r["temperature"].isNotNull() | r["maxTokens"].isNotNull() | r["stop"].isNotNull()
    return F.when(some, F.struct(r["temperature"].alias("temperature"), r["maxTokens"].alias("maxTokens"), r["stop"].alias("stop")))


def migrate(lines: DataFrame, interval: int = tree.INTERVAL) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines of the first two versions as ``session_id, pos, line`` of the third, the pieces to store (hash, k, body, z), nodes among them, and nodes (hash, parent, entries).

    A record of the first version is taken apart; of the second the pieces are stored already,
    and only its references become a tree. Pieces are the line's own text, so they hash as they would have when
    they were written, and options of a request stay in its line. What is no valid line stays out, as it does when read.
    """
    r, x = F.col("r"), F.col("x")
    first = log.is_first(r)
    older = lambda rows: rows.where(first | (r["v"] == 2))
    hashed = lambda k, body: F.struct(k.alias("k"), expr.content_hash(body).alias("hash"), body.alias("body"), F.octet_length(body).cast("long").alias("z"))

    def taken(request: Column) -> Column:
        system = F.when(request["system"].isNotNull(), _quoted(request["system"]))
        messages = F.transform(F.coalesce(request["messages"], F.array().cast("array<string>")), _plain)
        return F.when(first, F.transform(objects.parts(system, _plain(request["tools"]), messages), lambda p: hashed(p["k"], p["body"])))

    # what a line refers to, and of the first version its text, in the line's own row
    named = F.transform(F.filter(r["refs"], lambda p: p["k"] != "r"), lambda p: F.struct(p["k"].alias("k"), p["h"].alias("hash"), p["z"].alias("z")))
    held = F.when(first, F.transform("taken", lambda p: F.struct(p["k"].alias("k"), p["hash"].alias("hash"), p["z"].alias("z")))).otherwise(named)
    pieces = older(log.records(lines, schema.PIECES)).withColumn("taken", taken(r["request"]))
    pieces = pieces.select(F.struct("session_id", "pos").alias("call"), F.posexplode(held).alias("pos", "p"))
    firsts = objects.first_bytes(pieces.select("call", F.col("call.pos").alias("at"), "pos", "p.hash", "p.z")).select("call.*", F.col("bytes").alias("zn"))
    rows = older(log.records(lines)).withColumn("x", F.when(first, F.from_json("line", schema.EXACT)))
    answer = F.transform(F.array(_plain(x["response"])), lambda body: hashed(F.lit("r"), body))
    rows = rows.withColumns({"taken": taken(x["request"]), "answer": F.when(first & r["response"].isNotNull(), answer)})
    entries = F.transform(held, lambda p: F.concat(p["k"], F.lit(":"), p["hash"]))
    resp = F.when(first, F.get("answer", F.lit(0))["hash"]).otherwise(F.get(F.filter(r["refs"], lambda p: p["k"] == "r"), F.lit(0))["h"])
    options = F.when(first, _options(r["request"])).otherwise(_options(r["opts"]))
    known = log.projected(rows, F.struct(r["reasoningEffort"], r["timing"], options.alias("opts")).alias("h"), entries.alias("entries"), resp.alias("resp"))
    built = tree.build_nodes(known, interval)
    nodes = built.where("kind <> 'reuse'").select("hash", "parent", F.col("own").alias("entries"), "body")
    # the head and the summary as they were, or as they are computed from a record
    usage = F.when(F.col("has_usage"), F.struct(F.col("input_tokens").alias("inputTokens"), F.col("output_tokens").alias("outputTokens"), F.col("cache_read").alias("cacheReadTokens"), F.col("cache_write").alias("cacheWriteTokens"), F.col("reasoning_tokens").alias("reasoningTokens")))
    names = {"message_count": "messageCount", "request_chars": "requestChars", "tool_calls": "toolCalls", "called_tools": "calledTools", "tool_names": "toolNames"}
    sums = F.struct(*[F.col(c).alias(n) for c, n in names.items()], usage.alias("usage"), F.col("finish_kind").alias("finishKind"), F.col("finish_message").alias("finishMessage"))
    whole = built.join(firsts, ["session_id", "pos"], "left")
    fields = [F.lit(3).alias("v"), "id", F.col("session_id").cast("string").alias("sessionId"), "purpose", "provider", "model", F.col("h.reasoningEffort").alias("reasoningEffort"), F.col("request_hash").alias("requestHash"), "attempt"]
    fields += [F.col("h.timing").alias("timing"), "status", F.col("h.opts").alias("opts"), F.col("hash").alias("tree"), "resp", F.coalesce("zn", F.lit(0)).alias("zn"), sums.alias("sum")]
    out = whole.select("session_id", "pos", F.to_json(F.struct(*fields)).alias("line"))
    trees = nodes.select("hash", F.lit("n").alias("k"), "body", F.octet_length("body").cast("long").alias("z"))
    texts = rows.select(F.explode(F.concat("taken", F.coalesce("answer", F.array().cast(_PIECES)))).alias("p")).select("p.hash", "p.k", "p.body", "p.z")
    stored = objects.put(texts.union(trees))
    nodes = nodes.drop("body")
    return out, stored, nodes
