"""A log that is replaced as a whole: numbered snapshots, each naming the folders it is made of.

``path/_snapshots/000000012.json`` lists folders of lines and, for trimmed sessions, the first place that is still kept. A snapshot is
written beside its name and moved to it only if nothing is there, so of two writers one wins and the other
takes up what that one left. Readers take the newest snapshot, or the number they hold, and never see half a change:
whatever a writer was doing when it stopped, the log is the old one or the new one.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelume.sources import log

#: Bytes of lines that a session keeps, and writers that may come first before an append gives up.
CAP, TRIES = 64 << 20, 20
_FLOORS = "session_id string, floor bigint"


class Conflict(RuntimeError):
    """The snapshot that a rewrite read is no longer the newest."""


def _at(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def latest(spark: SparkSession, path: str) -> int:
    """Number of the newest snapshot; 0 if there is none."""
    p, fs = _at(spark, f"{path.rstrip('/')}/_snapshots")
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)


def _content(spark: SparkSession, path: str, number: int) -> dict:
    if not number:
        return {"parts": [], "floors": None}
    p, fs = _at(spark, f"{path.rstrip('/')}/_snapshots/{number:09d}.json")
    stream = fs.open(p)
    try:
        return json.loads(bytes(stream.readAllBytes()))
    finally:
        stream.close()


def publish(spark: SparkSession, path: str, number: int, content: dict) -> bool:
    """Put a snapshot in place if its number is free; False if another writer has it."""
    root = f"{path.rstrip('/')}/_snapshots"
    jvm = spark.sparkContext._jvm
    staged, fs = _at(spark, f"{root}/{uuid.uuid4().hex}.staged")
    target, _ = _at(spark, f"{root}/{number:09d}.json")
    stream = fs.create(staged, False)
    try:
        stream.write(bytearray(json.dumps(content).encode()))
    finally:
        stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
    try:
        context.rename(staged, target, none)  # refuses to replace
        return True
    except Exception as error:
        if fs.exists(target):
            fs.delete(staged, False)
            return False
        raise error


def read(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """``session_id, pos, line`` of the newest snapshot, or of the one that a reader has pinned."""
    return _lines(spark, _content(spark, path, latest(spark, path) if number is None else number))


def _lines(spark: SparkSession, content: dict) -> DataFrame:
    out = spark.createDataFrame([], "session_id string, pos long, line string")
    # a part is a folder of Spark's own making, of lines of many sessions
    for part in content["parts"]:
        out = out.union(spark.read.schema(log._LINES).json(part).select("session_id", "pos", "line"))
    if content["floors"]:
        floors = spark.read.schema(_FLOORS).parquet(content["floors"])
        out = out.join(floors, "session_id", "left").where(F.col("floor").isNull() | (F.col("pos") >= F.col("floor"))).drop("floor")
    return out


def _floors(lines: DataFrame, cap: int) -> DataFrame:
    """``session_id, floor`` of sessions over the cap: the first place of the newest lines whose bytes, newline included, stay within it."""
    sized = lines.select("session_id", "pos", (F.octet_length("line") + 1).cast("long").alias("bytes"))
    newest = Window.partitionBy("session_id").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    summed = sized.withColumn("sum", F.sum("bytes").over(newest))
    whole = summed.groupBy("session_id").agg(F.max("sum").alias("whole"), F.min(F.when(F.col("sum") <= cap, F.col("pos"))).alias("first"), F.max("pos").alias("last"))
    # a newest line beyond the cap leaves none
    return whole.where(F.col("whole") > cap).select("session_id", F.coalesce("first", F.col("last") + 1).alias("floor"))


def append(lines: DataFrame, path: str, cap: int = CAP) -> int:
    """Append ``lines(session_id, pos, line)`` and return the snapshot's number; the oldest lines of a session that is then over ``cap`` bytes go.

    Places grow within a session. The lines are written once; if another writer comes
    first, only the snapshot is made anew, on what that one left.
    """
    spark = lines.sparkSession
    part = f"{path.rstrip('/')}/part-{uuid.uuid4().hex}"
    log.append(lines, part)
    touched = spark.read.schema(log._LINES).json(part).select("session_id").distinct()
    for _ in range(TRIES):
        number = latest(spark, path)
        found = _content(spark, path, number)
        content = found | {"parts": [*found["parts"], part]}
        # only sessions that grew can pass the cap
        mine = _lines(spark, content).join(touched, "session_id", "left_semi")
        over = _floors(mine, cap)
        if found["floors"]:
            old = spark.read.schema(_FLOORS).parquet(found["floors"])
            over = over.union(old).groupBy("session_id").agg(F.max("floor").alias("floor"))
        floors = f"{path.rstrip('/')}/floors-{uuid.uuid4().hex}"
        over.write.parquet(floors)
        if publish(spark, path, number + 1, content | {"floors": floors}):
            return number + 1
    raise Conflict(f"{TRIES} other writers came first")


def rewrite(lines: DataFrame, path: str, number: int) -> int:
    """Replace the log by ``lines``, made from snapshot ``number``: one part, no floors. Fails if the log has changed since."""
    spark = lines.sparkSession
    part = f"{path.rstrip('/')}/part-{uuid.uuid4().hex}"
    log.append(lines, part)
    if not publish(spark, path, number + 1, {"parts": [part], "floors": None}):
        raise Conflict(f"snapshot {number} of {path} is not the newest")
    return number + 1


def expire(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete snapshots but the newest ``keep``, and the folders that none of those names; the number of folders deleted.

    Folders of a writer that is at work are not named yet, so this runs when none is.
    """
    newest = latest(spark, path)
    held = [_content(spark, path, n) for n in range(max(1, newest - keep + 1), newest + 1)]
    named = {p.rstrip("/").rpartition("/")[2] for c in held for p in [*c["parts"], c["floors"] or ""]}
    p, fs = _at(spark, path.rstrip("/"))
    gone = 0
    for s in fs.listStatus(p):
        name = s.getPath().getName()
        if name.startswith(("part-", "floors-")) and name not in named:
            fs.delete(s.getPath(), True)
            gone += 1
    snapshots, _ = _at(spark, f"{path.rstrip('/')}/_snapshots")
    for s in fs.listStatus(snapshots):
        name = s.getPath().getName()
        if name.endswith(".staged") or (name[:-5].isdigit() and int(name[:-5]) <= newest - keep):
            fs.delete(s.getPath(), False)
    return gone
