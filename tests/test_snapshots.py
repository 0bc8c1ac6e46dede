"""Snapshots of a log: appends within a cap, rewrites, writers that stop at any step, two writers at once."""

import pytest
from pyspark.sql import functions as F

from tracelume.sources import log, snapshots


def lines(spark, *rows):
    return spark.createDataFrame(list(rows), "session_id string, pos long, line string")


def read(spark, path, number=None):
    return sorted(map(tuple, snapshots.read(spark, path, number).collect()))


OLD = [("s", 0, "s0"), ("s", 1, "s1"), ("t", 0, "t0")]


def test_append_holds_the_cap(spark, tmp_path):
    path = str(tmp_path / "log")
    assert read(spark, path) == [] and snapshots.latest(spark, path) == 0
    assert snapshots.append(lines(spark, *OLD), path, cap=9) == 1
    assert read(spark, path) == OLD
    assert snapshots.append(lines(spark, ("s", 2, "s2"), ("s", 3, "é"), ("u", 0, "x" * 20)), path, cap=9) == 2
    want = [("s", 1, "s1"), ("s", 2, "s2"), ("s", 3, "é"), ("t", 0, "t0")]  # 3 + 3 + 3 bytes; u's line alone is over
    assert read(spark, path) == want
    assert read(spark, path, 1) == OLD  # a reader that pinned the first
    snapshots.append(lines(spark, ("t", 1, "t1"), ("u", 1, "u1")), path, cap=9)
    assert read(spark, path) == [*want, ("t", 1, "t1"), ("u", 1, "u1")]


def test_rewrite_replaces_and_expire_clears(spark, tmp_path):
    path = str(tmp_path / "log")
    n = snapshots.append(lines(spark, *OLD), path)
    assert snapshots.rewrite(snapshots.read(spark, path, n).where("pos = 0"), path, n) == 2
    assert read(spark, path) == [("s", 0, "s0"), ("t", 0, "t0")]
    with pytest.raises(snapshots.Conflict):
        snapshots.rewrite(lines(spark, ("s", 9, "late")), path, n)  # made from what is no longer the newest
    assert read(spark, path) == [("s", 0, "s0"), ("t", 0, "t0")]
    assert snapshots.expire(spark, path, keep=1) == 3 and read(spark, path) == [("s", 0, "s0"), ("t", 0, "t0")]
    assert snapshots.append(lines(spark, ("s", 5, "s5")), path) == 3 and read(spark, path)[1] == ("s", 5, "s5")


@pytest.mark.parametrize("step", ["lines", "create", "stage", "rename"])
@pytest.mark.parametrize("change", ["append", "rewrite"])
def test_a_writer_that_stops_leaves_the_old_log(spark, tmp_path, monkeypatch, step, change):
    path = str(tmp_path / "log")
    snapshots.append(lines(spark, *OLD), path)

    class Stop(Exception):
        pass

    def stop(*_, **__):
        raise Stop

    with monkeypatch.context() as m:
        if step == "lines":
            m.setattr(log, "append", stop)
        elif step == "create":
            m.setattr(snapshots, "publish", stop)
        elif step == "stage":
            m.setattr(snapshots.json, "dumps", stop)
        else:

            def publish(spark_, path_, number, content):
                # all but the rename: staged beside its name
                (tmp_path / "log/_snapshots" / "dead.staged").write_text(str(content))
                raise Stop

            m.setattr(snapshots, "publish", publish)
        with pytest.raises(Stop):
            if change == "append":
                snapshots.append(lines(spark, ("s", 2, "s2")), path)
            else:
                snapshots.rewrite(snapshots.read(spark, path).where("pos = 0"), path, 1)
    assert read(spark, path) == OLD and snapshots.latest(spark, path) == 1
    assert snapshots.append(lines(spark, ("s", 2, "s2")), path) == 2
    assert read(spark, path) == sorted([*OLD, ("s", 2, "s2")])
    snapshots.expire(spark, path)
    assert read(spark, path) == sorted([*OLD, ("s", 2, "s2")])


def test_of_two_writers_both_appends_stay(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    snapshots.append(lines(spark, *OLD), path)
    real, raced = snapshots.publish, []

    def publish(spark_, path_, number, content):
        if not raced:
            raced.append(number)
            monkeypatch.setattr(snapshots, "publish", real)
            snapshots.append(lines(spark, ("t", 1, "t1")), path)  # another writer comes first
        return real(spark_, path_, number, content)

    monkeypatch.setattr(snapshots, "publish", publish)
    assert snapshots.append(lines(spark, ("s", 2, "s2")), path) == 3 and raced == [2]
    assert read(spark, path) == sorted([*OLD, ("s", 2, "s2"), ("t", 1, "t1")])
    assert not real(spark, path, 3, {"parts": [], "floors": None})
    assert snapshots.read(spark, path).where(F.col("session_id") == "t").count() == 2


def test_files_do_not_grow_with_sessions(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.range(0, 600, 1, 3).select(F.concat(F.lit("s/=é "), "id").alias("session_id"), F.col("id").alias("pos"), F.concat(F.lit("line\t"), "id").alias("line"))
    snapshots.append(rows, path)
    assert len(list((tmp_path / "log").rglob("part-*.json"))) <= 3
    assert read(spark, path) == sorted(map(tuple, rows.collect()))
