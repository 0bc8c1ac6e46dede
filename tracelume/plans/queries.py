"""Queries over the driver's tables, one per operator or group of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelume.functions import expr, text
from tracelume.operators import chart, decimate, ledger, maintain, objects, paging, rollup, steps, tree, wire
from tracelume.plans import log_queries, store_queries, stream_queries, wire_queries
from tracelume.sources.driver import calls_from_events, read, turns_as_lists
from tracelume.streaming import stream

#: Events of a user are about eleven hours apart, so the retry window is scaled for them.
RETRY_WINDOW = 12 * 3_600_000


def calls(spark: SparkSession, d: str) -> DataFrame:
    return calls_from_events(read(spark, d, "events"))


def attempts(spark: SparkSession, d: str) -> DataFrame:
    return steps.with_attempts(calls(spark, d).drop("attempt"), RETRY_WINDOW)


def stepped(spark: SparkSession, d: str) -> DataFrame:
    return steps.with_steps(attempts(spark, d))


def session_summary(spark, d):
    return rollup.session_summary(attempts(spark, d))


def model_tally(spark, d):
    return rollup.model_tally(calls(spark, d))


def ledger_page(spark, d):
    return paging.page(calls(spark, d), 100, 50).select("id", "session_id", "model", "started_at", "status")


def ledger_page_model(spark, d):
    return paging.page(calls(spark, d), 100, 10, "m1").select("id", "session_id", "model", "started_at", "status")


def retry_attempts(spark, d):
    return attempts(spark, d).select("session_id", "id", "attempt")


def step_numbers(spark, d):
    return stepped(spark, d).select("session_id", "id", "step")


def predecessor_call(spark, d):
    return steps.with_predecessor(calls(spark, d)).select("session_id", "id", "prev_id")


def call_metrics(spark, d):
    return chart.with_metrics(calls(spark, d)).select("id", "billed", "hit_rate", "tps", "tps_approx", "stream_ms")


def chart_step_series(spark, d):
    return chart.step_series(stepped(spark, d)).select("session_id", "x", "series", "y", "approx")


def chart_time_series(spark, d):
    return chart.time_series(calls(spark, d)).select("session_id", "pos", "x", "series", "y", "approx")


def chart_excluded(spark, d):
    return chart.excluded(stepped(spark, d))


def token_buckets_5m(spark, d):
    return rollup.token_buckets(calls(spark, d), 5)


def token_buckets_60m(spark, d):
    return rollup.token_buckets(calls(spark, d), 60)


def token_stack(spark, d):
    return chart.stacked(chart.time_series(calls(spark, d))).select("session_id", "pos", "series", "y", "top")


def gap_runs(spark, d):
    return chart.runs(chart.time_series(calls(spark, d))).select("session_id", "series", "pos", "y", F.col("run").cast("long").alias("run"))


def metric_extent(spark, d):
    return chart.extent(chart.time_series(calls(spark, d)), "series")


def bar_columns(spark, d):
    return chart.bar_columns(chart.time_series(calls(spark, d), aux=True).where("series in ('in', 'out')"), 40)


def lttb_series(spark, d):
    return decimate.decimate(chart.time_series(calls(spark, d)).where("series = 'duration'"), 32, over=40)


def _lines(spark, d):
    c = read(spark, d, "conversations")
    return c.select("conv_id", F.col("turn").alias("pos"), F.octet_length("text").cast("long").alias("bytes"))


def trim_by_bytes(spark, d):
    return maintain.trim_bytes(_lines(spark, d), 2000, "conv_id")


def trim_by_count(spark, d):
    return maintain.trim_count(_lines(spark, d), 3, "conv_id")


def storage_footprint(spark, d):
    rows = _lines(spark, d).select(F.col("conv_id").alias("session_id"), F.col("bytes").alias("line_bytes"), F.when(F.col("pos") % 2 == 0, F.col("bytes") * 2).alias("object_bytes"))
    return rollup.footprint(rows)


def _lists(spark, d):
    return turns_as_lists(read(spark, d, "conversations"))


def _pieces(spark, d):
    c = _lists(spark, d).withColumns({"at": F.col("pos"), "tools": F.lit(None).cast("string")})
    return objects.request_pieces(c.select("call", "at", "system", "tools", "messages"))


def piece_dedup(spark, d):
    body = read(spark, d, "documents").select(F.col("text").alias("body"), F.lit("m").alias("k"))
    rows = body.select(expr.content_hash(F.col("body")).alias("hash"), "k", "body", F.octet_length("body").cast("long").alias("z"))
    return objects.put(rows).select("hash", "z")


def marginal_bytes(spark, d):
    return objects.marginal_bytes(_pieces(spark, d))


def message_reassembly(spark, d):
    p = _pieces(spark, d)
    found = objects.reassemble(p.select("call", "pos", "hash"), objects.put(p))
    return found.select("call", F.md5(F.array_join("bodies", "\n").cast("binary")).alias("digest"), F.size("bodies").cast("long").alias("n"))


def packing_order(spark, d):
    p = _pieces(spark, d)
    lists = p.groupBy("call", "at").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "hash"))), lambda x: x["hash"]).alias("hashes"))
    return objects.packing_order(lists.select("at", F.col("call").alias("seq"), "hashes"))


def _chains(spark, d):
    c = _lists(spark, d)
    return c.select("session_id", "pos", "call", F.transform("messages", lambda m: F.concat(F.lit("m:"), expr.content_hash(m))).alias("entries"))


def tree_nodes(spark, d):
    return tree.choose_nodes(_chains(spark, d), 2).select("session_id", "pos", "kind", F.col("depth").cast("long").alias("depth"))


def tree_hashes(spark, d):
    """The node that each list resolves from: the hash of its JSON, which holds its parent's hash."""
    return tree.build_nodes(_chains(spark, d), 2).select("session_id", "pos", "hash", "parent")


def tree_resolve(spark, d):
    """Lists read back from the nodes' JSON."""
    built = tree.build_nodes(_chains(spark, d))
    built = tree.checkpointed(built.select("call", "kind", "hash", "body"))
    found = tree.resolve(built.select("call", "hash"), tree.read_nodes(tree.stored_nodes(built)))
    found = found.withColumn("entries", F.transform("entries", lambda x: F.substring(x, 3, 64)))
    return found.select("call", F.sha2(F.array_join("entries", ",").cast("binary"), 256).alias("digest"), F.size("entries").cast("long").alias("n"))


def _nodes(spark, d):
    c = read(spark, d, "conversations")
    return c.select(F.concat_ws("/", "conv_id", "turn").alias("hash"), F.when(F.col("turn") > 0, F.concat_ws("/", F.col("conv_id"), F.col("turn") - 1)).alias("parent"), "conv_id", "turn", F.octet_length("text").cast("long").alias("bytes"))


def roots(spark, d):
    """The last answer of every conversation: what was said after it is reached by nothing."""
    c = read(spark, d, "conversations").where("role = 'assistant'").groupBy("conv_id").agg(F.max("turn").alias("turn"))
    return c.select(F.concat_ws("/", "conv_id", "turn").alias("hash"))


def _marks(spark, d):
    n = _nodes(spark, d)
    return n, tree.reachable(roots(spark, d), n)


def mark_reachable(spark, d):
    return _marks(spark, d)[1]


def gc_candidates(spark, d):
    n, live = _marks(spark, d)
    aged = n.withColumn("mtime_ms", F.col("turn") * 1_800_000)
    return maintain.garbage(aged, live, 9_000_000).select("hash", "bytes")


def pack_candidates(spark, d):
    n, live = _marks(spark, d)
    aged = n.withColumns({"mtime_ms": F.col("turn") * 1_800_000})
    ranks = n.select("hash", (F.col("conv_id") * 100 + F.col("turn") + 1).alias("rank"))
    return maintain.pack_candidates(aged, live, ranks, 4_000_000, 20_000).select("hash", "bytes", "rank")


def repack_candidates(spark, d):
    n, live = _marks(spark, d)
    entries = n.select(F.col("turn").alias("pack"), "hash", "bytes")
    return maintain.repack_candidates(entries, live, 20_000)


def redact_text(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(expr.redact_secrets(F.col("text")).cast("binary")).alias("digest"))


def redact_capped(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(expr.redact(F.col("text")).cast("binary")).alias("digest"))


def tool_dispatches(spark, d):
    """Call sites of programs that differ by row: names after a dot, in quotes of either kind, and in quotes that do not match."""
    k = F.get_json_object("props", "$.k")
    quote = F.when(k.cast("int") % 2 == 0, "'").otherwise('"')
    code = F.concat(F.lit("tools.read(1); tools[ "), quote, F.col("event_type"), quote, F.lit(" ] (2); tools.k"), k, F.lit("(3); tools['x\"](4); mytools.no(5); tools.read(6)"))
    name = F.when(F.col("event_type") == "click", F.lit("run_code")).when(F.col("event_type") == "view", F.lit("")).otherwise(F.col("event_type"))
    e = read(spark, d, "events").select(F.col("event_id").alias("call"), expr.dispatch_names(name, F.to_json(F.struct(code.alias("code")))).alias("names"))
    out = rollup.dispatch_counts(e)
    return out.select("call", expr.x_label(F.col("dispatches")).alias("label"), "total")


def protocol_detect(spark, d):
    e = calls(spark, d)
    provider = F.concat(F.element_at(F.array(*map(F.lit, ("Anthropic", "openai", "azure-responses", "my-codex", "claude-x"))), (F.col("id") % 5 + 1).cast("int")), F.col("provider"))
    model = F.concat(F.element_at(F.array(*map(F.lit, ("gpt-4", "Claude-3", "gpt-5-codex"))), (F.col("id") % 3 + 1).cast("int")), F.col("model"))
    return e.select("id", expr.protocol(provider, model).alias("protocol"))


def wire_usage_totals(spark, d):
    e = calls(spark, d)
    b = expr.billed_input(F.col("input_tokens"), F.col("cache_read"), F.col("cache_write"))
    out = F.coalesce("output_tokens", F.lit(0).cast("long"))
    return e.select("id", b.alias("prompt_tokens"), out.alias("completion_tokens"), (b + out).alias("total_tokens"), F.col("cache_read").alias("cached_tokens"))


def _records(spark, d):
    c = _lists(spark, d)
    message = lambda m, i: F.struct(i.cast("string").alias("id"), F.when(i % 2 == 0, "user").otherwise("assistant").alias("role"), F.array(F.struct(F.lit("text").alias("type"), m.alias("text"))).alias("content"))
    record = F.struct(
        F.col("call").cast("string").alias("id"),
        F.col("session_id").cast("string").alias("sessionId"),
        F.lit("openai").alias("provider"),
        F.lit("gpt-4").alias("model"),
        F.concat_ws("-", "session_id", "pos").alias("requestHash"),
        F.lit(1).alias("attempt"),
        F.struct((F.col("pos") * 1000).alias("startedAt")).alias("timing"),
        F.struct("system", F.transform("messages", message).alias("messages")).alias("request"),
        F.struct(F.array(F.struct(F.lit("text").alias("type"), F.lit("ok").alias("text"))).alias("blocks"), F.struct(F.lit("stop").alias("kind")).alias("finish")).alias("response"),
        F.lit("ok").alias("status"),
    )
    prev = F.lag("call").over(Window.partitionBy("session_id").orderBy("pos"))
    return c.select("session_id", F.col("call").alias("id"), prev.alias("prev_id"), F.to_json(record).alias("record"))


def wire_chain(spark, d):
    r = wire.with_previous(_records(spark, d))
    out = r.select("id", wire.wire_json(F.col("record"), F.lit("openai-responses"), "request", F.col("previous")).alias("j"))
    at = lambda k: F.get_json_object("j", f"$.body._chain.{k}")
    return out.select("id", at("chained").alias("chained"), at("sent_items").cast("long").alias("sent"), at("skipped_items").cast("long").alias("skipped"))


def chain_prefix(spark, d):
    c = _lists(spark, d)
    prev = F.lag("messages").over(Window.partitionBy("session_id").orderBy("pos"))
    return c.select("call", F.coalesce(expr.common_prefix(prev, F.col("messages")), F.lit(0)).cast("long").alias("prefix"))


def session_files(spark, d):
    return read(spark, d, "customer").select("c_custkey", expr.session_file(F.concat(F.col("c_name"), F.lit("/x:"), F.col("c_custkey").cast("string"), F.lit(".."))).alias("file"))


def formats(spark, d):
    c = calls(spark, d)
    return c.select("id", text.duration_text(F.col("duration_ms").cast("double")).alias("duration"), text.tokens_text(F.col("input_tokens").cast("double")).alias("tokens"), text.size_text((F.col("duration_ms") * 999).cast("double")).alias("size"), text.full_time(F.col("started_at")).alias("time"))


def ledger_rows(spark, d):
    return ledger.ledger_rows(stepped(spark, d))


def spans_days(spark, d):
    return ledger.spans_days(calls(spark, d))


def stream_attempts(spark, d):
    """The retry numbering as a stream over the whole table, written and read back."""
    source = read(spark, d, "events")
    events = spark.readStream.schema(source.schema).parquet(f"{d}/events.parquet*")
    path = log_queries.scratch_path(spark, "stream")
    out = stream.stream_attempts(calls_from_events(events).drop("attempt"), RETRY_WINDOW)
    out.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/out").awaitTermination()
    return spark.read.parquet(f"{path}/out").select("session_id", "id", "attempt")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [session_summary, model_tally, ledger_page, ledger_page_model, retry_attempts, step_numbers, predecessor_call, call_metrics, chart_step_series, chart_time_series, chart_excluded]
    found += [token_buckets_5m, token_buckets_60m, token_stack, gap_runs, metric_extent, bar_columns, lttb_series, trim_by_bytes, trim_by_count, storage_footprint, piece_dedup, marginal_bytes]
    found += [message_reassembly, packing_order, tree_nodes, tree_hashes, tree_resolve, mark_reachable, gc_candidates, pack_candidates, repack_candidates, redact_text, redact_capped, tool_dispatches]
    found += [protocol_detect, wire_usage_totals, wire_chain, chain_prefix, session_files, formats, ledger_rows, spans_days, stream_attempts]
    return {f.__name__: f for f in found} | wire_queries.queries() | log_queries.queries() | store_queries.queries() | stream_queries.queries()
