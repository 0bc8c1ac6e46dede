"""Streams over the driver's tables in several micro-batches, and axes of many charts, with their SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelume.functions import axes
from tracelume.operators import paging
from tracelume.plans.log_queries import log_text, scratch_path
from tracelume.sources.driver import calls_from_events, read
from tracelume.streaming import splice, stream, tail

ZONE, SHIFT = "Asia/Kolkata", 19_800_000


def _files(df: DataFrame, path: str, part: str, parts: int) -> None:
    """A file for each of ``parts`` slices by ``part``: each is a micro-batch."""
    for k in range(parts):
        df.where(F.col(part) == k).drop(part).coalesce(1).write.mode("append").parquet(path)


def stream_fold(spark, d):
    """Answers as chunk streams, folded into records over three micro-batches; failures are redacted."""
    path = scratch_path(spark, "fold")
    c = read(spark, d, "conversations").where("role = 'assistant'").select(F.concat_ws("/", "conv_id", "turn").alias("call"), "turn", "text")
    failed = F.col("turn") % 4 == 3
    none = F.lit(None).cast("string")
    failure = F.when(failed, F.concat(F.lit('{"message":"refused: Bearer abcdefgh'), F.col("turn").cast("string"), F.lit('","code":"E1","status":401}')))
    chunk = lambda seq, kind, block=none, usage=none, finish=none, fail=none: F.struct(F.lit(seq).cast("long").alias("seq"), F.lit(100 + seq).cast("long").alias("at"), F.lit(kind).alias("kind"), block.alias("block"), usage.alias("usage"), finish.alias("finish_kind"), fail.alias("failure"))
    finish = F.when(failed, "error").otherwise("stop")
    made = F.array(chunk(0, "text-delta"), chunk(1, "block-end", F.coalesce("text", F.lit(""))), chunk(2, "usage", usage=F.concat(F.lit('{"outputTokens":'), F.col("turn").cast("string"), F.lit("}"))), chunk(3, "block-end", F.lit("last")), chunk(4, "finish", finish=finish, fail=failure), chunk(5, "end"))
    chunks = c.select("call", F.explode(made).alias("c")).select("call", "c.*").withColumn("part", F.floor(F.col("seq") / 2))
    _files(chunks, f"{path}/in", "part", 3)
    source = spark.readStream.schema(stream.CHUNKS).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    out = stream.stream_records(source, None)
    out.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/out").awaitTermination()
    got = spark.read.schema(stream.RECORD).parquet(f"{path}/out")
    return got.select("call", "first_at", "ended_at", "chunk_count", F.md5(F.array_join("blocks", "|").cast("binary")).alias("blocks"), "usage", "finish_kind", "failure", "status")


def _write_logs(texts: DataFrame, path: str) -> None:
    """Each session's text as a file of its own."""
    uri = path if ":/" in path else f"file://{path}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(uri)
        fs.create_dir(root, recursive=True)
        for b in batches:
            for session, text in zip(*(c.to_pylist() for c in b.columns)):
                with fs.open_output_stream(f"{root}/{session}.jsonl") as f:
                    f.write(text.encode())
            yield b.slice(0, 0)

    texts.select("session_id", "text").mapInArrow(run, "session_id string, text string").write.format("noop").mode("overwrite").save()


def stream_tail(spark, d):
    """Log files read by byte as they grow: their first halves, cut anywhere, and then the rest."""
    spark.dataSource.register(tail.LogTail)
    path, texts = scratch_path(spark, "tail"), log_text(read(spark, d, "events"))
    lines = spark.readStream.format("log_tail").load(f"{path}/logs")
    for share in (2, 1):
        _write_logs(texts.withColumn("text", F.substring("text", F.lit(1), (F.length("text") / share).cast("int"))), f"{path}/logs")
        lines.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/out").awaitTermination()
    got = spark.read.schema(tail.SCHEMA).parquet(f"{path}/out")
    pos = F.row_number().over(Window.partitionBy("session_id").orderBy("at")) - 1
    return got.select("session_id", pos.cast("long").alias("pos"), F.get_json_object("line", "$.id").alias("id"))


def stream_page(spark, d):
    """The newest page of the busiest session, out of a table that a stream of three micro-batches keeps up to date; calls come again as they settle."""
    path = scratch_path(spark, "page")
    c = calls_from_events(read(spark, d, "events")).select("session_id", "id", "pos", "status")
    opened = c.withColumns({"status": F.lit("open"), "part": (F.col("id") % 2).cast("int")})
    settled = c.withColumn("part", F.when(F.col("id") % 2 == 0, 1).otherwise(2))
    _files(opened.union(settled.select(*opened.columns)), f"{path}/in", "part", 3)
    source = spark.readStream.schema(c.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    stream.refresh(source, f"{path}/table", f"{path}/state", None).awaitTermination()
    table = splice.read(spark, f"{path}/table", c.schema)
    top = table.groupBy("session_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "session_id").limit(1)
    own = table.join(top.select("session_id"), "session_id", "left_semi")
    return paging.page(own, 100, 0).select("session_id", "id", "pos", "status")


def nearest_points(spark, d):
    """The value of a user's events nearest to each order's price in thousands."""
    points = read(spark, d, "events").select("user_id", F.col("value").alias("x"))
    probes = read(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 50).cast("long").alias("user_id"), (F.col("o_totalprice").cast("double") / 1000).alias("v"))
    probes = probes.withColumn("user_id", F.col("user_id").cast(points.schema["user_id"].dataType))
    return axes.nearest(probes, points, ["user_id"]).select("o_orderkey", "nearest")


def axis_ticks(spark, d):
    """Time ticks of every session's chart, in a zone half an hour off."""
    c = calls_from_events(read(spark, d, "events"))
    spans = c.groupBy("session_id").agg(F.min("started_at").alias("lo"), F.max("started_at").alias("hi"))
    # sessions' own spans, and the first hours of them
    some = spans.withColumn("hi", F.when(F.col("session_id") % 3 == 0, F.col("lo") + (F.col("session_id") % 97) * 1_000_000).otherwise(F.col("hi")))
    return some.select("session_id", F.posexplode(axes.time_ticks(F.col("lo"), F.col("hi"), ZONE)).alias("n", "tick"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (stream_fold, stream_tail, stream_page, nearest_points, axis_ticks)}


def oracle_sql(events: str, calls: str) -> dict[str, str]:
    cadences = ", ".join(str(c * 1000) for c in axes.CADENCES)
    return {
        "stream_fold": """select conv_id || '/' || turn as call, 100::bigint as first_at, 105::bigint as ended_at, 5::bigint as chunk_count, md5(coalesce(text, '') || '|last') as blocks, '{"outputTokens":' || turn || '}' as usage,
  case when turn % 4 = 3 then 'error' else 'stop' end as finish_kind, case when turn % 4 = 3 then '{"message":"refused: <redacted>","code":"E1","status":401}' end as failure, case when turn % 4 = 3 then 'error' else 'ok' end as status from conversations where role = 'assistant'""",
        "stream_tail": f"with {events} select session_id, pos, id from every",
        "stream_page": f"with {calls}, top as (select session_id from calls group by 1 order by count(*) desc, session_id limit 1) select session_id, id, pos, status from calls where session_id = (select session_id from top) order by pos desc limit 100",
        "nearest_points": "select o_orderkey, (select value from events e where e.user_id = o_custkey % 50 and value is not null and isfinite(value) order by abs(value - o_totalprice::double / 1000), value limit 1) as nearest from orders",
        "axis_ticks": f"""with {calls}, s as (select session_id, min(started_at) as lo, case when session_id % 3 = 0 then min(started_at) + (session_id % 97) * 1000000 else max(started_at) end as hi from calls group by 1),
c as (select *, coalesce(list_filter([{cadences}], lambda x: (hi - lo) / x <= 7)[1], 86400000) as w from s),
f as (select *, case when w < 86400000 then range((ceil((lo + {SHIFT}) / w) * w - {SHIFT})::bigint, hi + 1, w)
  else list_filter(list_transform(range(((lo + {SHIFT}) // 86400000)::bigint, ((hi + {SHIFT}) // 86400000 + 1)::bigint), lambda x: x * 86400000 - {SHIFT}), lambda t: t between lo and hi) end as t from c),
t as (select session_id, case when hi <= lo or len(t) = 0 then [lo] else t end as t from f)
select session_id, (generate_subscripts(t, 1) - 1)::int as n, unnest(t)::bigint as tick from t""",
    }
