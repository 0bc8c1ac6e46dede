"""Tables written to the folder that all executors share.

Every multi-pass operator cuts its lineage with a written Parquet table, so that a
lost executor costs only the tasks it held and nothing is kept on one machine.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Where tables go if nothing is set and all executors are in this process.
_OWN = "/tmp/checkpoints"
_RECORDS: ContextVar[tuple[list[str], ...]] = ContextVar("records", default=())


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application under ``spark.checkpoint.dir``; on one machine without executors of its own that may be unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = _OWN
    return f"{root.rstrip('/')}/tracelume-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    for made in _RECORDS.get():
        made.append(path)
    return path


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths made inside, so that their maker can delete what its result no longer reads."""
    made: list[str] = []
    token = _RECORDS.set((*_RECORDS.get(), made))
    try:
        yield made
    finally:
        _RECORDS.reset(token)


def clear(spark: SparkSession) -> None:
    """Delete all that this application has written: for when no result is read any more."""
    delete(spark, shared_dir(spark))


def delete(spark: SparkSession, *paths: str) -> None:
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def short_plans(spark: SparkSession, length: int = 1 << 12) -> Iterator[None]:
    """Inside, descriptions of plans are cut: the driver keeps one of every query, and one with a model's constants has megabytes."""
    name = "spark.sql.maxPlanStringLength"
    before = spark.conf.get(name)
    spark.conf.set(name, str(length))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def release(spark: SparkSession) -> None:
    """Let go of what finished queries held: Spark deletes shuffle files, broadcasts and generated classes when the driver's collector finds them unused, which frames that Python has not collected keep it from."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Scratch:
    """The written tables of one operator call."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._paths: dict[str, str] = {}

    def table(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        """Write ``df`` and return what is read back; an older table of that name goes."""
        path = new_path(self.spark, name)
        df.write.options(compression="zstd", **options).parquet(path)
        self.drop(name)
        self._paths[name] = path
        self.last = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if path := self._paths.pop(name, None):
                delete(self.spark, path)
