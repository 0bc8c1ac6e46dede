"""Queries over a call log made from the driver's tables: all record versions, torn and foreign lines, whole records, sweeps."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelume import service
from tracelume.functions import expr
from tracelume.operators import chart, ledger, maintain, objects, paging, tree
from tracelume.sources import log, migrate, snapshots
from tracelume.sources.driver import calls_from_events, read, turns_as_lists

#: A tool call's program, as its arguments have it.
PROGRAM = '{"code":"tools.read(1); tools.read(2); tools[\'list\'](3)"}'


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which all executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(root or '/tmp/checkpoints').rstrip('/')}/{name}-{uuid.uuid4().hex}"


def log_text(events: DataFrame) -> DataFrame:
    """``session_id, text`` of a log with a line per event, of the three versions in turn.

    Behind a sign-up stands a line of a foreign kind, behind an error one that is no JSON,
    and every session ends with a torn line. Events are dealt by session before they become lines, which are
    some ten times as long, and into parts that are many enough for those.
    """
    text = lambda x: x.cast("string")
    spark = events.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    c = calls_from_events(events.withColumn("user_id", text(F.col("user_id"))).repartition(parts, "user_id"))
    timing = F.struct(F.col("started_at").alias("startedAt"), (F.col("started_at") + F.col("ttfb_ms")).alias("firstChunkAt"), (F.col("started_at") + F.col("duration_ms")).alias("endedAt"))
    usage = F.when(F.col("status") == "ok", F.struct(F.col("input_tokens").alias("inputTokens"), F.col("output_tokens").alias("outputTokens"), F.col("cache_read").alias("cacheReadTokens"), F.col("cache_write").alias("cacheWriteTokens")))
    head = [text(F.col("id")).alias("id"), text(F.col("session_id")).alias("sessionId"), "purpose", "provider", "model", F.col("request_hash").alias("requestHash"), F.lit(1).alias("attempt"), timing.alias("timing"), "status"]
    failed = F.when(F.col("status") == "error", F.struct(F.concat(F.lit("bad "), F.col("model")).alias("message"), F.lit("E1").alias("code")))
    kind = F.when(F.col("status") == "error", "error").otherwise("stop")
    block = lambda kind, **extra: F.struct(F.lit(kind).alias("type"), *[v.alias(k) for k, v in extra.items()])
    message = F.struct(F.lit("user").alias("role"), F.array(block("text", text=F.concat(F.col("model"), F.lit(" é😀")))).alias("content"))
    picture = F.struct(F.lit("user").alias("role"), F.array(block("image", text=F.lit("not counted"))).alias("content"))
    options = [F.when(F.col("id") % 2 == 0, F.col("id") % 4 / 4).alias("temperature"), F.when(F.col("id") % 5 == 0, F.col("id")).alias("maxTokens"), F.when(F.col("id") % 7 == 0, F.array(F.lit("END"), F.col("model"))).alias("stop")]
    opts = F.when((F.col("id") % 2 == 0) | (F.col("id") % 5 == 0) | (F.col("id") % 7 == 0), F.struct(*options)).alias("opts")
    request = F.struct(F.lit("sys").alias("system"), F.array(message, picture).alias("messages"), F.array(F.struct(F.lit("run_code").alias("name")), F.struct(F.lit("read").alias("name"))).alias("tools"), *options)
    blocks = F.array(block("tool-call", id=F.lit("t1"), name=F.lit("run_code"), arguments=F.lit(PROGRAM)), block("tool-call", id=F.lit("t2"), name=F.col("provider"), arguments=F.lit("{}")))
    response = F.struct(blocks.alias("blocks"), usage.alias("usage"), F.struct(kind.alias("kind"), failed.alias("failure")).alias("finish"))
    named = F.array(F.struct(F.lit("read").alias("name"), F.lit(2).alias("count")))
    sums = F.struct((F.col("id") % 9).alias("messageCount"), (F.col("id") % 1000).alias("requestChars"), F.lit(2).alias("toolCalls"), named.alias("calledTools"), F.array(F.lit("read")).alias("toolNames"), usage.alias("usage"), kind.alias("finishKind"), failed["message"].alias("finishMessage"))
    ref = lambda kind, z: F.struct(F.lit(kind).alias("k"), F.sha2(F.concat(F.lit(kind), text(F.col("id"))), 256).alias("h"), z.alias("z"))
    first = F.to_json(F.struct(F.lit(1).alias("schema"), *head, request.alias("request"), response.alias("response")))
    second = F.to_json(F.struct(F.lit(2).alias("v"), *head, F.array(ref("s", F.lit(7)), ref("m", F.col("id") % 100)).alias("refs"), sums.alias("sum"), opts))
    third = F.to_json(F.struct(F.lit(3).alias("v"), *head, F.sha2(text(F.col("id")), 256).alias("tree"), (F.col("id") % 50).alias("zn"), sums.alias("sum"), opts))
    line = F.when(F.col("id") % 3 == 0, first).when(F.col("id") % 3 == 1, second).otherwise(third)
    extra = F.when(F.col("purpose").isNotNull(), F.lit('\n{"schema":9,"id":"foreign"}')).when(F.col("status") == "error", F.lit("\n{broken")).otherwise("")
    # lines come out of a generator, which is compiled: an aggregate would take them in and interpret them
    c = c.select("session_id", "pos", F.explode(F.array(F.concat(line, extra))).alias("line"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "line")))
    whole = F.concat(F.array_join(F.transform("x", lambda x: x["line"]), "\n"), F.lit('\n{"schema":1,"id":"torn"'))
    return c.groupBy("session_id").agg(ordered.alias("x")).select("session_id", whole.alias("text"))


def log_lines(spark, d):
    return log.complete_lines(log_text(read(spark, d, "events")))


def log_calls(spark, d):
    """The list projection of all versions, as read from the log's lines."""
    c = log.calls(log_lines(spark, d))
    return c.drop("line_bytes", "reasoning_tokens").withColumns({"called_tools": expr.x_label(F.col("called_tools")), "tool_names": F.array_join("tool_names", ",")})


def log_migrated(spark, d):
    """The list projection of the same log once all lines are of the latest version, and the request options that they keep."""
    lines = log_lines(spark, d)
    moved, _, _ = migrate.migrate(lines)
    whole = moved.union(lines.where(F.get_json_object("line", "$.v") == "3").select("session_id", "pos", "line"))
    c = log.projected(log.records(whole), "r.opts.temperature", F.col("r.opts.maxTokens").alias("max_tokens"), F.array_join("r.opts.stop", "|").alias("stop"))
    return c.drop("line_bytes", "reasoning_tokens", "object_bytes").withColumns({"called_tools": expr.x_label(F.col("called_tools")), "tool_names": F.array_join("tool_names", ",")})


def migrated_pieces(spark, d):
    """What migration stores of the records of the first version: hashes of their own text."""
    lines = log_lines(spark, d)
    _, stored, _ = migrate.migrate(lines.where(F.get_json_object("line", "$.schema") == "1"))
    return stored.where("k <> 'n'").select("k", "hash", "z")


def migration_batch(spark, d):
    """Sessions that one cycle brings to the latest version."""
    c = calls_from_events(read(spark, d, "events"))
    s = c.groupBy("session_id").agg((F.count_if(F.col("status") == "error") % 3).alias("failures"), F.max("started_at").alias("mtime_ms"), (F.count("*") * 100).alias("bytes"))
    return migrate.batch(s, 30_000)


def log_legacy(spark, d):
    """Lines that are yet to be brought to the latest version."""
    return log.legacy(log_lines(spark, d)).groupBy("session_id").agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"))


def log_referenced(spark, d):
    return log.referenced(log_lines(spark, d))


def log_tail(spark, d):
    """Lines beyond those read: each session's second half."""
    lines = log_lines(spark, d)
    seen = lines.groupBy("session_id").agg(F.floor(F.count("*") / 2).alias("next_pos"))
    return log.tail(lines, seen).select("session_id", "pos", F.get_json_object("line", "$.id").alias("id"))


def log_append(spark, d):
    """The ids of a log's lines, appended in two commits that hold each session to 100 bytes, trimmed to the newest 20 lines by a rewrite, and read back."""
    path, lines = scratch_path(spark, "log"), log_lines(spark, d)
    lines = lines.withColumn("line", F.coalesce(F.get_json_object("line", "$.id"), F.lit("none")))
    early = F.col("pos") < 30
    snapshots.append(lines.where(early), path, 100)
    number = snapshots.append(lines.where(~early), path, 100)
    snapshots.rewrite(maintain.trim_count(snapshots.read(spark, path, number), 20), path, number)
    return snapshots.read(spark, path).select("session_id", "pos", F.col("line").alias("id"))


def ledger_sums(spark, d):
    """The precomputed summary of a record, as JSON."""
    c = log.calls(log_lines(spark, d)).where("version = 1")
    return ledger.with_sums(c).select("id", F.to_json("sum").alias("sum"))


def failures_first(spark, d):
    """Sessions in the order of migration."""
    c = calls_from_events(read(spark, d, "events"))
    s = c.groupBy("session_id").agg(F.count_if(F.col("status") == "error").alias("failures"), F.max("started_at").alias("mtime_ms"))
    return maintain.migration_order(s)


def reconcile_pages(spark, d):
    """A loaded window and the page beneath it that was read later, united by id."""
    c = calls_from_events(read(spark, d, "events")).select("id", "session_id", "pos", "status")
    loaded = c.withColumn("status", F.lit("open"))
    fresh = c.where("status = 'ok'").withColumn("pos", F.col("pos") + F.when(F.col("id") % 2 == 0, 0).otherwise(-1))
    return paging.reconcile(loaded, fresh)


def request_hashes(spark, d):
    body = F.to_json(F.struct("doc_id", "text"))
    return read(spark, d, "documents").select("doc_id", expr.request_hash(F.lit("salt"), body).alias("hash"))


def home_paths(spark, d):
    path = F.concat(F.element_at(F.array(F.lit("/home/me"), F.lit("/home/me2"), F.lit("/HOME/me")), (F.col("o_orderkey") % 3 + 1).cast("int")), F.when(F.col("o_orderkey") % 5 > 0, F.concat(F.lit("/"), F.col("o_orderpriority"))).otherwise(""))
    return read(spark, d, "orders").select("o_orderkey", expr.display_path(path, "/home/me").alias("plain"), expr.display_path(path, "/home/me", fold=True).alias("folded"))


def utf16_lengths(spark, d):
    return read(spark, d, "documents").select("doc_id", expr.utf16_length(F.col("text")).alias("n"))


def visible_stack(spark, d):
    """Stacked tokens without the series that are hidden."""
    from tracelume.plans import queries

    return chart.stacked(chart.time_series(queries.calls(spark, d)), hidden=("cacheRead",)).select("session_id", "pos", "series", "y", "top")


def call_lookup(spark, d):
    """The read interface's lookup of every session's last call, in a log that has each call twice: the first of its id."""
    c = calls_from_events(read(spark, d, "events"))
    last = c.groupBy("session_id").agg(F.max("id").alias("id"))
    twice = c.union(c.withColumn("pos", F.col("pos") + 1_000_000))
    return service.get_calls(twice, last).select("session_id", "id", "pos", "status", "model")


def session_page(spark, d):
    """The read interface's newest page of the busiest session."""
    from tracelume.plans import queries

    c = queries.attempts(spark, d)
    top = c.groupBy("session_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "session_id").first().session_id
    return service.list_calls(c, top, limit=25, offset="5")["calls"].select("session_id", "id", "step", "status")


def _envelopes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Envelopes, nodes and stored pieces of the conversations: odd sessions in the second version, others in the third; ids repeat."""
    c = turns_as_lists(read(spark, d, "conversations")).withColumns({"at": F.col("pos"), "tools": F.lit(None).cast("string")})
    answers = read(spark, d, "conversations").where("role = 'assistant'").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("pos"), F.col("text").alias("answer"))
    c = c.join(answers, ["session_id", "pos"])
    pieces = objects.request_pieces(c.select("call", "at", "system", "tools", "messages"))
    body = lambda b: F.struct(F.lit("r").alias("k"), expr.content_hash(b).alias("hash"), b.alias("body"), F.octet_length(b).cast("long").alias("z"))
    stored = objects.put(pieces.select("k", "hash", "body", "z").union(c.where("answer is not null").select(body(F.col("answer")).alias("r")).select("r.*")))
    entries = pieces.groupBy("call").agg(F.array_sort(F.collect_list(F.struct("pos", "k", "hash", "z"))).alias("p"))
    lists = c.select("session_id", "pos", "call", expr.content_hash(F.col("answer")).alias("resp")).join(entries, "call", "left")
    lists = lists.withColumn("entries", F.transform(F.coalesce("p", F.array()), lambda x: F.concat(x["k"], F.lit(":"), x["hash"])))
    built = tree.build_nodes(lists.where("session_id % 2 = 0"), 2)
    nodes = built.where("kind <> 'reuse'").select("hash", "parent", F.col("own").alias("entries"))
    named = lambda kind: F.struct(F.lit(kind).alias("k"), F.col("resp").alias("h"), F.lit(0).cast("long").alias("z"))
    refs = F.concat(F.transform("p", lambda x: F.struct(x["k"].alias("k"), x["hash"].alias("h"), x["z"].alias("z"))), F.when(F.col("resp").isNotNull(), F.array(named("r"))).otherwise(F.array()))
    sums = F.struct(F.lit(1).alias("messageCount"))
    opts = F.when(F.col("pos") % 3 == 0, F.struct((F.col("pos") / 4).alias("temperature"), F.col("pos").cast("long").alias("maxTokens"), F.array(F.lit("END")).alias("stop")))
    common = [(F.col("call") % 3).cast("string").alias("id"), sums.alias("sum"), opts.alias("opts")]
    second = lists.where("session_id % 2 = 1").select("session_id", "pos", F.to_json(F.struct(F.lit(2).alias("v"), *common, refs.alias("refs"))).alias("line"))
    third = built.select("session_id", "pos", F.to_json(F.struct(F.lit(3).alias("v"), *common, F.col("hash").alias("tree"), "resp")).alias("line"))
    return log.envelopes(second.union(third)), nodes, stored


def call_detail(spark, d):
    """Whole records put together from envelopes of two versions, trees, pieces and responses; some pieces are lost, and ids repeat."""
    envelopes, nodes, stored = _envelopes(spark, d)
    found = objects.detail(envelopes, nodes, stored.where("hash not like '0%'"))
    digest = lambda x: F.md5(F.coalesce(x, F.lit("-")).cast("binary"))
    return found.select("session_id", "pos", "id", "version", F.col("opts.temperature").alias("temperature"), F.col("opts.maxTokens").alias("max_tokens"), F.array_join("opts.stop", "|").alias("stop"), digest(F.col("system")).alias("system"), F.size("messages").cast("long").alias("n_messages"), digest(F.array_join("messages", "\n")).alias("messages"), digest(F.col("response")).alias("response"), "complete")


def object_census(spark, d):
    stored = _envelopes(spark, d)[2]
    return objects.census(stored.select(F.col("z").alias("length")))


def sweep_status(spark, d):
    """One whole sweep: marks, collection, packing, repacking, and what each step comes to."""
    from tracelume.plans import queries

    n = queries._nodes(spark, d)
    aged = n.select("hash", "bytes", (F.col("turn") * 1_800_000).alias("mtime_ms"))
    ranks = n.select("hash", (F.col("conv_id") * 100 + F.col("turn") + 1).alias("rank"))
    packed = n.select(F.col("turn").alias("pack"), "hash", "bytes")
    return maintain.sweep(aged, queries.roots(spark, d), n.select("hash", "parent"), ranks, packed, 9_000_000, 4_000_000, 20_000, least_bytes=20_000)["status"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [log_calls, log_migrated, migrated_pieces, migration_batch, log_legacy, log_referenced, log_tail, log_append, ledger_sums, failures_first, reconcile_pages, request_hashes, home_paths, utf16_lengths, visible_stack, call_lookup, session_page, call_detail, object_census, sweep_status]
    return {f.__name__: f for f in found}


_EVENTS = """
e as (select *, cast(json_extract_string(props, '$.k') as bigint) as k, event_type <> 'error' as ok, cast(floor(value * 100) as bigint) + 1 as d from events),
lines as (select *, cast(user_id as varchar) as session_id, epoch_us(ts) // 1000 as began, row_number() over w - 1 + coalesce(sum(case when event_type in ('signup', 'error') then 1 else 0 end) over (w rows between unbounded preceding and 1 preceding), 0) as pos
  from e window w as (partition by user_id order by event_id)),
every as (select session_id, cast(pos as bigint) as pos, cast(event_id as varchar) as id, event_id % 3 as v, event_id from lines union all
  select session_id, cast(pos + 1 as bigint), case when event_type = 'signup' then 'foreign' end, 9, event_id from lines where event_type in ('signup', 'error'))"""

_SQL_NODES = """
nodes as (select conv_id || '/' || turn as hash, case when turn > 0 then conv_id || '/' || (turn - 1) end as parent, conv_id, turn, strlen(text) as bytes from conversations),
live as (select n.hash, n.parent from nodes n join (select conv_id, max(turn) as turn from conversations where role = 'assistant' group by conv_id) r on n.conv_id = r.conv_id and n.turn = r.turn
  union select n.hash, n.parent from live l join nodes n on n.hash = l.parent)"""


def oracle_sql(time_series: str, lists: str, steps: str, calls: str) -> dict[str, str]:
    """The same queries in SQL; the arguments are the common parts of the other queries' SQL."""
    v = lambda a, b, c: f"case when event_id % 3 = 0 then {a} when event_id % 3 = 1 then {b} else {c} end"
    u = lambda x: f"case when ok then {x} end"
    lost = lambda x: f"case when sha256({x}) like '0%' then '{{\"$unavailable\":\"' || sha256({x}) || '\"}}' else {x} end"
    found = {
        "log_calls": f"""with {_EVENTS} select session_id, cast(pos as bigint) as pos, cast(event_id as varchar) as id, {v(1, 2, 3)} as version,
  case when event_type = 'signup' then 'session-title' end as purpose, 'p' || (k % 2) as provider, 'm' || (k % 3) as model, user_id || '-' || (k % 7) as request_hash, 1 as attempt, began as started_at, d as duration_ms,
  cast(floor(d * (k % 10) / 10) as bigint) as ttfb_ms, case when ok then 'ok' else 'error' end as status, {u('k * 10')} as input_tokens, {u('k + 1')} as output_tokens, case when ok and k % 5 <> 0 then k * 90 end as cache_read,
  case when ok and k % 4 = 0 then k * 3 end as cache_write, ok as has_usage, case when ok then 'stop' else 'error' end as finish_kind, case when not ok then 'bad m' || (k % 3) end as finish_message,
  {v('2', 'event_id % 9', 'event_id % 9')} as message_count, {v('3 + 2 + 4', 'event_id % 1000', 'event_id % 1000')} as request_chars, {v('4', '2', '2')}::bigint as tool_calls,
  {v("'read ×2 · list · p' || (k % 2)", "'read ×2'", "'read ×2'")} as called_tools, {v("'run_code,read'", "'read'", "'read'")} as tool_names, {v('0', '7 + event_id % 100', 'event_id % 50')}::bigint as object_bytes from lines""",
        "migration_batch": f"""with {calls}, s as (select session_id, count(*) filter (where status = 'error') % 3 as failures, max(started_at) as mtime_ms, count(*) * 100 as bytes from calls group by 1)
select session_id, failures, mtime_ms, bytes from s qualify coalesce(sum(bytes) over (order by failures, mtime_ms desc, session_id rows between unbounded preceding and 1 preceding), 0) < 30000""",
        "log_legacy": f"with {_EVENTS} select session_id, count(*) as n, min(pos) as first, max(pos) as last from every where v <> 2 group by 1",
        "log_referenced": f"""with {_EVENTS}, h as (select sha256('s' || event_id) as hash, false as is_tree from lines where event_id % 3 = 1 union all select sha256('m' || event_id), false from lines where event_id % 3 = 1
  union all select sha256(cast(event_id as varchar)), true from lines where event_id % 3 = 2) select hash, bool_or(is_tree) as is_tree from h group by 1""",
        "log_tail": f"with {_EVENTS}, n as (select session_id, count(*) // 2 as half from every group by 1) select session_id, pos, id from every join n using (session_id) where pos >= half",
        "log_append": f"""with {_EVENTS}, l as (select session_id, pos, coalesce(id, 'none') as id from every)
select session_id, pos, id from l qualify row_number() over (partition by session_id order by pos desc) <= 20 and sum(strlen(id) + 1) over (partition by session_id order by pos desc) <= 100""",
        "ledger_sums": f"""with {_EVENTS} select cast(event_id as varchar) as id, '{{"message_count":2,"request_chars":9,"tool_calls":4,"called_tools":[{{"name":"read","count":2}},{{"name":"list","count":1}},{{"name":"p' || (k % 2) || '","count":1}}],"tool_names":["run_code","read"]'
  || case when ok then ',"input_tokens":' || (k * 10) || ',"output_tokens":' || (k + 1) else '' end || case when ok and k % 5 <> 0 then ',"cache_read":' || (k * 90) else '' end || case when ok and k % 4 = 0 then ',"cache_write":' || (k * 3) else '' end
  || ',"finish_kind":"' || case when ok then 'stop"' else 'error","finish_message":"bad m' || (k % 3) || '"' end || '}}' as sum from lines where event_id % 3 = 0""",
        "failures_first": f"with {calls} select session_id, count(*) filter (where status = 'error') as failures, max(started_at) as mtime_ms from calls group by 1",
        "reconcile_pages": f"with {calls} select id, session_id, pos, case when status = 'ok' and id % 2 = 0 then 'ok' else 'open' end as status from calls",
        "request_hashes": """select doc_id, substr(sha1('salt|{"doc_id":' || doc_id || case when text is null then '' else ',"text":' || to_json(text)::varchar end || '}'), 1, 12) as hash from documents""",
        "home_paths": """with p as (select o_orderkey, ['/home/me', '/home/me2', '/HOME/me'][o_orderkey % 3 + 1] || case when o_orderkey % 5 > 0 then '/' || o_orderpriority else '' end as path from orders)
  select o_orderkey, case when path = '/home/me' or path like '/home/me/%' then '~' || substr(path, 9) else path end as plain, case when lower(path) = '/home/me' or lower(path) like '/home/me/%' then '~' || substr(path, 9) else path end as folded from p""",
        "utf16_lengths": "select doc_id, cast(length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) as bigint) as n from documents",
        "visible_stack": f"""{time_series}, o as (select *, list_position(['in', 'cacheWrite', 'out'], series) as r from series where series in ('in', 'cacheWrite', 'out'))
select session_id, pos, series, y, case when y is not null then sum(y) over (partition by session_id, pos order by r) end as top from o""",
        "call_lookup": f"with {calls} select session_id, id, pos, status, model from calls qualify id = max(id) over (partition by session_id)",
        "session_page": f"with {steps}, top as (select session_id from calls group by 1 order by count(*) desc, session_id limit 1) select session_id, id, step, status from stepped where session_id = (select session_id from top) order by pos desc limit 25 offset 5",
        "call_detail": f"""with {lists}, f as (select l.*, c.text, {lost('c.text')} as answer, {lost('l.system')} as first, [{lost('x')} for x in l.messages] as found from lists l join conversations c on c.conv_id = l.session_id and c.turn = l.pos)
select session_id, pos, cast(call % 3 as varchar) as id, case when session_id % 2 = 1 then 2 else 3 end as version, case when pos % 3 = 0 then pos / 4 end as temperature, case when pos % 3 = 0 then pos::bigint end as max_tokens, case when pos % 3 = 0 then 'END' end as stop,
  md5(coalesce(first, '-')) as system, len(messages)::bigint as n_messages, md5(coalesce(array_to_string(found, chr(10)), '')) as messages, md5(coalesce(answer, '-')) as response,
  found = messages and answer is not distinct from text and first is not distinct from system as complete from f""",
        "object_census": f"""with {lists}, b as (select system as body from lists union select unnest(messages) from lists union select text from conversations where role = 'assistant') select count(*) as n, cast(sum(strlen(body)) as bigint) as bytes from b where body is not null""",
        "sweep_status": f"""with recursive {_SQL_NODES},
o as (select hash, bytes, turn * 1800000 as mtime, conv_id * 100 + turn + 1 as rank, turn, hash in (select hash from live) as alive from nodes),
g as (select bytes from o where not alive and mtime < 9000000 - 3600000),
p as (select bytes, sum(bytes) over (order by rank) - bytes as spent from o where alive and mtime < 4000000), pk as (select bytes from p where not (spent > 0 and spent >= 20000)),
r0 as (select turn as pack, count(*) as entries, count(*) filter (where alive) as alive, sum(bytes) as bytes from o group by 1),
r as (select bytes from r0 where not case when bytes < 20000 then alive * 2 >= entries else alive / entries >= 0.5 end)
select 'live' as step, count(*) as rows, cast(coalesce(sum(bytes), 0) as bigint) as bytes from o where alive union all select 'missing', 0, 0 union all select 'collect', count(*), coalesce(sum(bytes), 0)::bigint from g
union all select 'pack', count(*), coalesce(sum(bytes), 0)::bigint from pk union all select 'repack', count(*), coalesce(sum(bytes), 0)::bigint from r""",
    }
    found["log_migrated"] = f"""select * exclude (object_bytes) replace (3 as version), case when id::bigint % 2 = 0 then id::bigint % 4 / 4 end as temperature, case when id::bigint % 5 = 0 then id::bigint end as max_tokens,
  case when id::bigint % 7 = 0 then 'END|' || model end as stop from ({found['log_calls']})"""
    program = PROGRAM.replace('"', '\\"').replace("'", "''")
    found["migrated_pieces"] = f"""with {_EVENTS}, r as (select *, 'm' || (k % 3) as model from lines where event_id % 3 = 0),
b as (select 's' as k, '"sys"' as body from r union select 't', '[{{"name":"run_code"}},{{"name":"read"}}]' from r union select 'm', '{{"role":"user","content":[{{"type":"image","text":"not counted"}}]}}' from r
 union select 'm', '{{"role":"user","content":[{{"type":"text","text":"' || model || ' é😀"}}]}}' from r
 union select 'r', '{{"blocks":[{{"type":"tool-call","id":"t1","name":"run_code","arguments":"{program}"}},{{"type":"tool-call","id":"t2","name":"p' || (k % 2) || '","arguments":"{{}}"}}]'
  || case when ok then ',"usage":{{"inputTokens":' || (k * 10) || ',"outputTokens":' || (k + 1) || case when k % 5 <> 0 then ',"cacheReadTokens":' || (k * 90) else '' end || case when k % 4 = 0 then ',"cacheWriteTokens":' || (k * 3) else '' end || '}}' else '' end
  || ',"finish":{{"kind":"' || case when ok then 'stop"' else 'error","failure":{{"message":"bad ' || model || '","code":"E1"}}' end || '}}}}' from r)
select k, sha256(body) as hash, strlen(body)::bigint as z from b"""
    return found
