"""Display formats, ticks, and expressions, by literal facts."""

import json
import math

import pytest
from pyspark.sql import functions as F

from tracelume.functions import expr, text, ticks
from tracelume.operators import decimate, paging


@pytest.mark.parametrize("x,want", [(1.005, "1.00"), (0.125, "0.13"), (12.35, "12.3"), (99.95, "100.0"), (100.5, "101")])
def test_sig3_rounds_the_binary_value(x, want):
    assert text.sig3(x) == want


def test_formats():
    assert [text.duration(x) for x in (None, 999.4, 1000, 9999, 16_300, 65_000, 3_599_000, 3_599_999 + 1, 5_000_000)] == ["–", "999ms", "1.00s", "10.00s", "16.3s", "1m5s", "59m59s", "1h00m", "1h23m"]
    assert [text.tokens(x) for x in (None, 0, 9999, 10_000, 311_900, 999_999, 2_860_000)] == ["–", "0", "9999", "10.0k", "312k", "1.00M", "2.86M"]
    assert [text.size(x) for x in (None, 1023, 1024, 1048575, 5 << 30)] == ["–", "1023 B", "1.00 KB", "1.00 MB", "5.00 GB"]
    assert text.rate(math.inf) == "–" and text.rate(103) == "103 t/s"
    assert [text.percent(*x) for x in ((1, 1), (1, 3), (1, 0), (None, 2))] == ["100%", "33.3%", "–", "–"]
    assert text.measure("2.86 MB") == ("2.86", "MB") and text.measure("312k") == ("312k", None)


def test_ticks():
    assert ticks.nice_ceil(0) == 1 and ticks.nice_ceil(21) == 50 and ticks.nice_ceil(0.3) == pytest.approx(0.5)
    assert ticks.nice_ticks(0, 0.9, 3) == [0, 0.5, 1] and ticks.nice_ticks(5, 5) == [5] and ticks.nice_ticks(math.nan, 1) == []
    assert ticks.int_ticks(1, 5) == [1, 2, 3, 4, 5] and ticks.int_ticks(1, 48) == [0, 10, 20, 30, 40, 50] and ticks.int_ticks(3, 3) == [3]
    hour = 3_600_000
    assert ticks.time_ticks(0, 6 * hour) == [k * hour for k in range(7)]
    assert ticks.time_ticks(1, 20 * hour) == [k * 3 * hour for k in range(1, 7)]
    assert [t % hour for t in ticks.time_ticks(hour, 7 * hour, "Asia/Kolkata")] == [hour // 2] * 6
    assert ticks.time_ticks(5, 30 * 24 * hour)[0] == 24 * hour and ticks.time_ticks(7, 7) == [7]
    assert [ticks.nearest_index([0, 10, 20], v) for v in (-5, 5, 6, 15, 99)] == [0, 0, 1, 1, 2] and ticks.nearest_index([], 1) == -1 and ticks.nearest_index([4], 9) == 0
    assert ticks.pad_domain(1, 2) == (1, 2) and ticks.pad_domain(2, 2) == (1.5, 2.5) and ticks.pad_domain(3, 3, True) == (0, 6) and ticks.pad_domain() == (-1, 1)
    assert ticks.linear((0, 10), (0, 100))(5) == 50 and ticks.linear((1, 1), (0, 4))(1) == 2


def test_limits():
    assert [paging.limits(x)[0] for x in (None, 0, -5, "abc", 99999, "", 7.9)] == [50, 1, 1, 50, 20000, 1, 7]
    assert [paging.limits(1, x)[1] for x in (None, -1, "x", "12")] == [0, 0, 0, 12]


def test_decimation_keeps_spikes_and_ends():
    import numpy as np

    x, y = np.arange(400.0), np.sin(np.arange(400) / 9)
    y[77], y[300], y[10:14] = 50, -50, np.nan
    kept = decimate.keep(x, y, 60)
    assert len(kept) <= 62 and {0, 77, 300, 399} <= set(kept) and list(kept) == sorted(set(kept))
    assert len(decimate.keep(x[:10], y[:10], 60)) == 10


def test_expressions(spark):
    row = spark.range(1).select(
        expr.utf16_length(F.lit("a😀é")).alias("n"),
        expr.redact(F.concat(F.lit("sk-ant-abcdefgh12 Bearer abcdefgh1 token: 'abcdef' "), F.repeat(F.lit("x"), 600))).alias("r"),
        expr.error_text(F.lit("Error"), F.lit("ENOENT"), F.lit("open '/home/me/x.json' and C:\\Users\\me\\y; a/b")).alias("e"),
        F.array(*[expr.session_file(F.lit(s)) for s in ("a b/c", "...", "NUL", "com1.x", "ok.")]).alias("f"),
        F.array(*[expr.display_path(F.lit(p), "/home/ada") for p in ("/home/ada", "/home/ada/x", "/home/adam/x")]).alias("p"),
        expr.dispatch_names(F.lit("run_code"), F.lit('{"code":"tools.a(1); tools[\'b\'] (2); tools[\\"c\\"](3); tools[k](4)"}')).alias("d"),
        expr.dispatch_names(F.lit("run_code"), F.lit("not json")).alias("d2"),
        expr.dispatch_names(F.lit(None).cast("string"), F.lit("{}")).alias("d3"),
        expr.hit_rate(F.lit(10), F.lit(0), F.lit(None).cast("int")).alias("h0"),
        expr.hit_rate(F.lit(10), F.lit(None).cast("int"), F.lit(1)).alias("h1"),
        expr.hit_rate(F.lit(50), F.lit(100), F.lit(50)).alias("h2"),
        expr.speed(F.lit(100), F.lit(1200), F.lit(200)).alias("s0"),
        expr.speed(F.lit(100), F.lit(1200), F.lit(1100)).alias("s1"),
        expr.speed(F.lit(9000), F.lit(2000), F.lit(1000)).alias("s2"),
        expr.speed(F.lit(1), F.lit(0), F.lit(0)).alias("s3"),
        expr.bucket_start(F.lit(-1).cast("long"), 60_000, 0).alias("b"),
        expr.common_prefix(F.array(*map(F.lit, "abc")), F.array(*map(F.lit, "abd"))).alias("c"),
    ).first()
    assert row.n == 4 and row.r.startswith("<redacted> <redacted> <redacted>") and row.r.endswith(" chars)") and len(row.r) < 530
    assert row.e == "Error (ENOENT): open '<path>' and <path>; a/b"
    assert row.f == ["a_b_c.jsonl", "_.jsonl", "_NUL.jsonl", "_com1.x.jsonl", "ok.jsonl"] and row.p == ["~", "~/x", "/home/adam/x"]
    assert row.d == ["a", "b", "c"] and row.d2 == ["run_code"] and row.d3 == ["tool"]
    assert (row.h0, row.h1, row.h2) == (0, None, 50)
    assert (row.s0.tps, row.s0.approx) == (100, False) and (round(row.s1.tps, 3), row.s1.approx) == (83.333, True) and (row.s2.tps, row.s2.approx) == (4500, True) and row.s3 is None
    assert row.b == -60_000 and row.c == 2


def test_wire_json_renders_a_batch_in_parts(spark, monkeypatch):
    """Records beyond a part, and nulls, in their places: only one part is held as objects."""
    from tracelume.operators import wire

    monkeypatch.setattr(wire, "AT_ONCE", 7)
    record = lambda k: json.dumps({"id": str(k), "model": "gpt-4", "request": {"messages": [{"role": "user", "content": [{"type": "text", "text": f"é{k}"}]}]}, "response": {"blocks": []}})
    rows = [(k, None if k % 10 == 3 else record(k)) for k in range(40)]
    df = spark.createDataFrame(rows, "k int, record string").coalesce(1)
    got = df.select("k", wire.wire_json(F.col("record"), F.lit("openai-responses"), "request").alias("j")).collect()
    assert {r.k: r.j for r in got} == {k: wire._line(r, "openai-responses", "request", None) for k, r in rows}
