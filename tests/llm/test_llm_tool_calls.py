"""Tool calls: nulls, canonical numbers, nested schemas, and the order they are serialised in."""

import json
from decimal import Decimal

from tracelume.llm import tool_calls

CALLS, RESULTS = "conv_id long, call_id string, turn long, tool string, arguments string", "conv_id long, call_id string, turn long, content string"


def linked(spark, calls, schemas=(), after=(), results=()):
    types = "tool string, name string, type string, required boolean, choices array<string>"
    deps = spark.createDataFrame(list(after), "conv_id long, call_id string, dep string")
    return tool_calls.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame(list(results), RESULTS), spark.createDataFrame(list(schemas), types), deps)


def test_null_identifiers_have_levels(spark):
    calls = [(None, "a", 1, "t", "{}"), (None, "b", 2, "t", "{}"), (1, None, 1, "t", "{}"), (1, "c", 2, "t", "{}"), (None, None, 5, "t", "{}"), (1, "null", 3, "t", "{}")]
    after = [(None, "b", "a"), (1, "c", None), (None, None, "b")]
    got = {(r.conv_id, r.call_id): (r.level, r.status) for r in linked(spark, calls, after=after, results=[(1, None, 9, "x")]).collect()}
    assert {k: v[0] for k, v in got.items()} == {(None, "a"): 0, (None, "b"): 1, (1, None): 0, (1, "c"): 1, (None, None): 2, (1, "null"): 0}
    assert got[1, None][1] == "linked" and got[1, "null"][1] == "missing_result"


def test_numbers_have_one_spelling(spark):
    texts = ["1", "1.0", "100", "1e2", "1E+2", "10.0e1", "-0", "-0.0", "0.00", "1.50", "15e-1", "12345678901234567890123", "1e22", "10000000000000000000000", "0.00000015", "1.5e-7", "-2.50e3", "1e300", "0.1", "123456.789e3"]
    rows = [(k, json.dumps("1e2 \\ \" 1.0")[:-1] + '"', x) for k, x in enumerate(texts)]
    df = spark.createDataFrame([(k, f'{{"n": {x}, "b": [{x}, {s}], "a": "1e2"}}') for k, s, x in rows], "k long, j string")
    got = {r.k: r.c for r in df.select("k", tool_calls.canonical(tool_calls.F.col("j")).alias("c")).collect()}
    spelled = {}
    for k, s, x in rows:
        n = json.loads(got[k].replace('"n":', '"n":"').replace("}", '"}'), parse_float=str, parse_int=str)["n"]
        assert got[k] == f'{{"a":"1e2","b":[{n},{s}],"n":{n}}}'
        assert Decimal(n) == Decimal(x) and "e" not in n.lower()
        assert spelled.setdefault(Decimal(x), n) == n
    assert spelled[Decimal(100)] == "100" and spelled[Decimal(0)] == "0" and spelled[Decimal("1.5")] == "1.5"


def test_long_strings_do_not_nest(spark):
    long = json.dumps({"a": 'x\\"\n' * 200_000 + "1.0", "n": 1.0})
    got = spark.createDataFrame([(long,)], "j string").select(tool_calls.canonical(tool_calls.F.col("j")).alias("c")).first().c
    assert json.loads(got) == json.loads(long) and got.endswith('"n":1}')


def test_integers_by_value(spark):
    values = ["1", "1.0", "1e2", "12345678901234567890123", "1.5", "15e-1", '"1"', "true", "null"]
    rows = linked(spark, [(k, "x", 1, "t", f'{{"n": {v}}}') for k, v in enumerate(values)], [("t", "n", "integer", True, None)]).collect()
    assert [r.errors for r in sorted(rows)] == [[], [], [], [], *[["type:n"]] * 5]


def test_nested_schemas(spark):
    schemas = [
        ("book", "to", "array", True, None),
        ("book", "to/*", "object", False, None),
        ("book", "to/*/city", "string", True, None),
        ("book", "to/*/nights", "integer", False, None),
        ("book", "who", "object", True, None),
        ("book", "who/name", "string", True, None),
        ("book", "who/**", None, False, None),
        ("book", "class", "string", False, ['"first"', ' "second"']),
        ("book", "level", None, False, ["1.0", "null"]),
        ("book", "a~1b", "number", False, None),
    ]
    good = {"to": [{"city": "x"}, {"city": "y", "nights": 2.0}], "who": {"name": "n", "age": 3}, "class": "first", "level": 1, "a/b": 0.5}
    cases = [
        (good, []),
        ({**good, "to": [{"nights": 1.5}, {"city": 3, "more": 1}, "z"]}, ["missing:to/*/city", "type:to/*", "type:to/*/city", "type:to/*/nights", "unknown:to/*/more"]),
        ({**good, "to": "x", "who": {}}, ["missing:who/name", "type:to"]),
        ({**good, "class": "third", "level": 2, "x": 1}, ["enum:class", "enum:level", "unknown:x"]),
        ({"to": [], "level": None}, ["missing:who"]),
        ({**good, "a/b": "s"}, ["type:a~1b"]),
    ]
    rows = linked(spark, [(k, "x", 1, "book", json.dumps(v)) for k, (v, _) in enumerate(cases)], schemas).collect()
    assert [r.errors for r in sorted(rows)] == [want for _, want in cases]


def test_serialised_in_topological_order(spark):
    calls = [(c, f"k{k}", 50 - k, "t", f'{{"k":{k}}}') for c in range(3) for k in range(20)]
    after = [(c, f"k{k}", f"k{k // 2}") for c in range(3) for k in range(1, 20)] + [(0, f"k{k}", f"k{k - 1}") for k in range(2, 20, 3)] + [(2, "k0", "k19")]
    found = tool_calls.serialised(linked(spark, calls, after=after).repartition(7))
    rows = found.collect()
    assert len(rows) == 60 and [r.conv_id for r in rows] == sorted(r.conv_id for r in rows)
    place = {(r.conv_id, r.call_id): k for k, r in enumerate(rows)}
    assert all(place[c, x] > place[c, y] for c, x, y in after if c < 2)
    assert all(r.level is None for r in rows if r.conv_id == 2)  # all of it leads to a cycle
    assert json.loads(rows[0].json)["arguments"] == {"k": 0}
