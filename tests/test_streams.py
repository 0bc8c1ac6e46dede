"""Streams in several micro-batches: byte tails, folded chunks, bounded keys, a table kept up to date; axes and nearest points."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tracelume.functions import axes, ticks
from tracelume.operators import paging
from tracelume.sources import snapshots
from tracelume.streaming import splice, stream, tail


def once(df, tmp_path, name="out"):
    df.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/{name}-c").trigger(availableNow=True).start(f"{tmp_path}/{name}").awaitTermination()
    return df.sparkSession.read.parquet(f"{tmp_path}/{name}")


def test_tail_as_a_stream(spark, tmp_path, monkeypatch):
    spark.dataSource.register(tail.LogTail)
    logs = tmp_path / "logs"
    (logs / "sub").mkdir(parents=True)
    lines = spark.readStream.format("log_tail").load(str(logs))
    rows = lambda: sorted((r.session_id, r.at, r.end, r.line) for r in once(lines, tmp_path).collect())
    a, b = logs / "a.jsonl", logs / "sub" / "b.jsonl"
    a.write_bytes('{"x":1}\n{"é":2}\n{"torn'.encode())
    b.write_bytes(b"one\n")
    want = [("a", 0, 8, '{"x":1}'), ("a", 8, 17, '{"é":2}'), ("b", 0, 4, "one")]
    assert rows() == want
    assert rows() == want  # a restart without news
    with a.open("ab") as f:
        f.write(b'"}\nmore\nto')
    b.write_bytes(b"x\n")  # rewritten, and shorter
    want = sorted([*want, ("a", 17, 26, '{"torn"}'), ("a", 26, 31, "more"), ("b", 0, 2, "x")])
    assert rows() == want
    b.write_bytes(b"now a longer line\n")  # its offset is within a line
    (logs / "c.jsonl").write_bytes(b"no end")
    assert rows() == sorted([*want, ("b", 0, 18, "now a longer line")])


@pytest.mark.parametrize("part", [7, 50, 333, 10_000])
def test_parts_of_a_range_share_lines(tmp_path, monkeypatch, part):
    r = random.Random(part)
    lines = ["x" * r.choice((0, 1, 5, 90, 300)) + str(k) for k in range(80)]
    text = "".join(x + "\n" for x in lines) + "torn"
    (tmp_path / "s.jsonl").write_text(text)
    monkeypatch.setattr(tail, "PART", part)
    monkeypatch.setattr(tail, "CHUNK", 64)
    reader = tail.LogTailReader(str(tmp_path))
    end = reader.latestOffset()
    assert end == {"s.jsonl": len(text) - 4}
    got = [row for p in reader.partitions({}, end) for batch in reader.read(p) for row in batch.to_pylist()]
    assert [x["line"] for x in got] == lines and all(text[x["at"] : x["end"]] == x["line"] + "\n" for x in got)


def test_small_files_share_parts(tmp_path, monkeypatch):
    monkeypatch.setattr(tail, "ROWS", 7)
    for k in range(600):
        (tmp_path / f"s{k}.jsonl").write_text(f"a{k}\nb{k}\ntorn")
    reader = tail.LogTailReader(str(tmp_path))
    end = reader.latestOffset()
    half = {name: e // 2 for name, e in end.items()}
    lines = lambda start: [(x["session_id"], x["line"]) for p in reader.partitions(start, end) for b in reader.read(p) for x in b.to_pylist()]
    assert len(end) == 600 and len(reader.partitions({}, end)) == len(reader.partitions(half, end)) == 3 and reader.partitions(end, end) == []
    assert sorted(lines({})) == sorted((f"s{k}", f"{x}{k}") for k in range(600) for x in "ab")
    assert sorted(lines(half)) == sorted((f"s{k}", f"b{k}") for k in range(600))
    assert len(lines({name: 1 for name in end})) == 1200  # no offset stands within a line: all were rewritten


def chunk(call, seq, kind, **x):
    return (call, seq, 100 + seq, kind, x.get("block"), x.get("usage"), x.get("finish"), x.get("failure"))


def test_chunks_fold_over_batches(spark, tmp_path):
    key = '{"message":"Incorrect API key provided: sk-abcdefgh12345678","code":"401"}'
    data = [chunk("a", 0, "block-start"), chunk("a", 2, "block-end", block="B1"), chunk("a", 3, "usage", usage="U"), chunk("a", 4, "block-end", block="B2"), chunk("a", 5, "finish", finish="tool-calls"), chunk("a", 6, "end")]
    data += [chunk("b", 0, "text-delta"), chunk("b", 1, "end"), chunk("c", 0, "text-delta"), chunk("c", 4, "block-end", block="C"), chunk("d", 0, "finish", finish="error", failure=key), chunk("d", 1, "end"), chunk("e", 0, "end")]
    df = spark.createDataFrame(data, stream.CHUNKS)
    want = {r.call: tuple(r) for r in stream.fold_chunks(df).collect()}
    for low, high in ((0, 3), (3, 5), (5, 9)):  # a file is a micro-batch
        df.where((F.col("seq") >= low) & (F.col("seq") < high)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = stream.stream_records(source, 20_000).writeStream.format("memory").queryName("folded").option("checkpointLocation", f"{tmp_path}/state").start()
    try:
        ends = time.time() + 90
        while spark.table("folded").count() < 5 and time.time() < ends:
            time.sleep(0.5)
    finally:
        q.stop()
    assert {r.call: tuple(r) for r in spark.table("folded").collect()} == want
    assert want["c"][-1] == "aborted" and "sk-" not in want["d"][-2]


def test_the_oldest_of_too_many_keys_begins_again(spark, tmp_path):
    schema = "session_id bigint, provider string, id bigint, pos bigint, request_hash string, status string, started_at bigint"
    n = 1025
    first = [(k, "p", k, k, "h", "error", 1000 + k) for k in range(n)]
    again = [(n - 1, "p", 2000, 2000, "h", "error", 3000), (0, "p", 2001, 2001, "h", "error", 3001), (5, "p", 2002, 2002, "h", "ok", 3002), (5, "p", 2003, 2003, "h", "ok", 3003)]
    for rows in (first, again):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        got = {r.id: r.attempt for r in once(stream.stream_attempts_bounded(spark.readStream.schema(schema).json(f"{tmp_path}/in")), tmp_path).collect()}
    assert all(got[k] == 1 for k in range(n))
    assert (got[2000], got[2001], got[2002], got[2003]) == (2, 1, 2, 1)  # 0 was forgotten, and a success ends a count


def test_a_batch_is_merged_once(spark, tmp_path):
    schema = "session_id bigint, id bigint, pos bigint, status string"
    rows = lambda *x: spark.createDataFrame(list(x), schema)
    path = f"{tmp_path}/table"
    merge = splice.sink(path, buckets=4)
    got = lambda: sorted(map(tuple, splice.read(spark, path, schema).collect()))
    assert got() == []
    merge(rows((1, 1, 1, "open"), (2, 2, 2, "ok"), (1, 1, 3, "late")), 0)
    assert got() == [(1, 1, 3, "late"), (2, 2, 2, "ok")]
    merge(rows((1, 1, 4, "ok"), (3, 3, 5, "ok")), 1)
    want = [(1, 1, 4, "ok"), (2, 2, 2, "ok"), (3, 3, 5, "ok")]
    assert got() == want
    merge(rows((1, 1, 9, "again")), 1)  # a replay
    merge(rows((1, 1, 9, "again")), 0)
    assert got() == want and snapshots.latest(spark, path) == 2
    held = snapshots._content(spark, path, 2)["buckets"]
    assert len({p.rpartition("/")[0] for p in held.values()}) == 2  # untouched buckets stay where they were


def test_pages_after_each_trigger(spark, tmp_path):
    schema = "session_id bigint, id bigint, pos bigint, status string"
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(schema).json(f"{tmp_path}/in")
    for k in range(3):
        spark.createDataFrame([(s, 1000 * s + i, 100 * k + i, f"{k}") for s in range(3) for i in range(60 * k, 60 * k + 90)], schema).write.mode("append").json(f"{tmp_path}/in")
        stream.refresh(source, f"{tmp_path}/t", f"{tmp_path}/c", None).awaitTermination()
        page = paging.page(splice.read(spark, f"{tmp_path}/t", schema).where("session_id = 1"), 100, 0)
        assert [r.id for r in page.collect()] == [1000 + i for i in range(60 * k + 89, max(-1, 60 * k - 11), -1)]


ZONES = ["UTC", "Asia/Kolkata", "Europe/Berlin", "America/New_York", "Australia/Lord_Howe"]


def test_ticks_of_many_axes(spark):
    r = random.Random(8)
    starts = [1_711_846_800_000, 1_729_990_800_000, 1_700_000_000_000, 0, 1_710_050_000_123]
    rows = [(r.choice(starts) + r.randrange(-(10**9), 10**9), r.choice((0, 1, 999, 5_000, 61_000, 3_600_000, 86_400_000, 7 * 86_400_000, 9 * 86_400_000, 40 * 86_400_000)) + r.randrange(2000), z) for _ in range(60) for z in ZONES]
    rows = [(lo, lo + span, z) for lo, span, z in rows] + [(5, 5, "UTC"), (9, 3, "UTC"), (None, 3, "UTC"), (3, None, "UTC")]
    got = spark.createDataFrame(rows, "lo long, hi long, zone string").select("lo", "hi", "zone", axes.time_ticks(F.col("lo"), F.col("hi"), F.col("zone")).alias("t")).collect()
    for x in got:
        assert x.t == (None if x.lo is None or x.hi is None else ticks.time_ticks(x.lo, x.hi, x.zone)), x


def test_nearest_points(spark):
    r = random.Random(9)
    points = [(g, float(r.randrange(40))) for g in "ab" for _ in range(25)] + [("a", None), ("a", float("nan")), ("a", float("inf"))]
    probes = [(g, k, r.choice((r.randrange(-5, 50), r.randrange(80) / 2))) for g in "abc" for k in range(40)] + [("a", 99, None)]
    probes = [(g, k, None if v is None else float(v)) for g, k, v in probes]
    got = axes.nearest(spark.createDataFrame(probes, "g string, k long, v double"), spark.createDataFrame(points, "g string, x double"), ["g"]).collect()
    assert len(got) == len(probes)
    for x in got:
        xs = sorted(p for g, p in points if g == x.g and p is not None and abs(p) < 1e9)
        want = None if x.v is None or not xs else xs[ticks.nearest_index(xs, x.v)]
        assert x.nearest == want, x


def test_nearest_points_of_one_large_group(spark):
    """Frames that begin at the start grow with their rows; one up to the end is walked anew for each."""
    n = 20_000
    points = spark.range(n).select(F.lit("g").alias("g"), (F.col("id") * 3).cast("double").alias("x"))
    probes = spark.range(n).select(F.lit("g").alias("g"), F.col("id").alias("k"), (F.col("id") * 3 + 2).cast("double").alias("v"))
    found = axes.nearest(probes, points, ["g"])
    assert "unboundedfollowing" not in found._jdf.queryExecution().toString().lower()
    assert found.where(F.col("nearest") != F.least(F.col("v") + 1, F.lit(3.0 * (n - 1)))).count() == 0 and found.count() == n


def test_attempts_are_handed_what_they_read(spark, tmp_path):
    """Other columns of a call are not handed over key by key; calls are taken in order of their place."""
    rows = [(1, "p", 7, 2, "h", "ok", 3_000, "wide"), (1, "p", 5, 1, "h", "error", 1_000, "wide"), (1, "p", 9, 3, "h", "ok", 5_000, "wide")]
    df = spark.createDataFrame(rows, "session_id long, provider string, id long, pos long, request_hash string, status string, started_at long, other string")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    # what Arrow has no type for
    out = stream.stream_attempts(source.withColumn("other", F.expr("make_interval(0, 1)")), 120_000)
    out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    assert sorted((r.id, r.attempt) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(5, 1), (7, 2), (9, 1)]
