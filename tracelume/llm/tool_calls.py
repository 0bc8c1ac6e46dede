"""Tool-call linking, ordering, validation and canonical JSON, JVM-side throughout.

Calls and results are reduced to one row per conversation and identifier, combining
before the shuffle, and hash-joined by both. Dependencies between calls give levels:
chains are jumped in a logarithmic number of rounds, and calls with several
dependencies are peeled, a round taking those whose dependencies all have levels. A
conversation is never gathered in one row or task. Arguments are parsed to variants and
held against schemas of any depth. Canonical JSON has an object's keys in order, no white
space, and numbers by their value: no exponent, no zeros that do not count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelume.llm.scratch import Scratch
from tracelume.llm.text import let

#: JSON schema type -> pattern of a variant's type: fixed values. An integer is a number whose canonical text has no point.
TYPES = {
    "string": "STRING",
    "integer": "BIGINT|DOUBLE|FLOAT|DECIMAL.*",
    "number": "BIGINT|DOUBLE|FLOAT|DECIMAL.*",
    "boolean": "BOOLEAN",
    "object": "OBJECT.*",
    "array": "ARRAY.*",
    "null": "VOID",
}
#: Strings, numbers, and what stands between; possessive, so that no length of string nests.
_TOKEN = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|-?[0-9][0-9.eE+-]*+|[^"0-9-]++|.'
_NUMBER = r"^(-?)([0-9]+)(?:\.([0-9]+))?(?:[eE]([+-]?[0-9]+))?$"


def canonical_number(token: Column) -> Column:
    """A JSON number in plain decimals: leading zeros, closing zeros of a fraction and the sign of zero go."""
    part = lambda k: F.regexp_extract(token, _NUMBER, k)
    digits = F.concat(part(2), part(3))
    point = F.length(part(2)) + F.coalesce(F.nullif(part(4), F.lit("")).cast("int"), F.lit(0))
    whole = F.when(point <= 0, F.lit("0")).otherwise(F.rpad(F.substring(digits, F.lit(1), point), point, F.lit("0")))
    rest = F.when(point < 0, F.concat(F.repeat(F.lit("0"), -point), digits)).otherwise(F.substring(digits, F.greatest(point, F.lit(0)) + 1, F.length(digits)))
    whole, rest = F.regexp_replace(whole, "^0+(?=[0-9])", ""), F.regexp_replace(rest, "0+$", "")
    plain = F.when(rest == "", whole).otherwise(F.concat(whole, F.lit("."), rest))
    return F.when(plain == "0", plain).otherwise(F.concat(part(1), plain))


def _plain_numbers(json: Column) -> Column:
    token = lambda t: F.when(t.rlike(r"^-?[0-9]") & t.rlike("[.eE]|^-0"), canonical_number(t)).otherwise(t)
    whole = F.array_join(F.transform(F.regexp_extract_all(json, F.lit(f"(?s){_TOKEN}"), F.lit(0)), token), "")
    return F.when(json.rlike(r"[0-9][.eE]|-0"), whole).otherwise(json)


def _variant_text(v: Column) -> Column:
    return let(F.to_json(v), _plain_numbers)


def canonical(json: Column) -> Column:
    """Canonical text of a JSON value; null if it is none or repeats a key. Integers and decimals of up to 38 digits keep all of them, other numbers are doubles."""
    return _variant_text(F.try_parse_json(json))


def _keys(v: Column) -> Column:
    """Keys of a variant; none if it is no object."""
    return F.coalesce(F.json_object_keys(F.to_json(v)), F.array().cast("array<string>"))


def _segments(path: Column) -> Column:
    return F.when(path == "", F.array().cast("array<string>")).otherwise(F.split(path, "/", -1))


def _key(segment: Column) -> Column:
    return F.replace(F.replace(F.replace(segment, F.lit("~2"), F.lit("*")), F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))


def _nodes(root: Column, path: Column) -> Column:
    """Variants at a path: what stands under its keys, and for * all items of an array."""

    def under(v: Column, segment: Column) -> Column:
        quote = F.when(F.contains(segment, F.lit('"')), F.lit("'")).otherwise(F.lit('"'))
        one = F.try_variant_get(v, F.concat(F.lit("$["), quote, _key(segment), quote, F.lit("]")), "variant")
        each = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))
        return F.when(segment == "*", each).otherwise(F.filter(F.array(one), lambda x: x.isNotNull()))

    return F.aggregate(_segments(path), F.array(root), lambda vs, s: F.flatten(F.transform(vs, lambda v: under(v, s))))


def _parent(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def _errors(arguments: Column, spec: Column) -> Column:
    """Sorted distinct faults of ``arguments`` against ``spec``, an array of (name, type, required, choices)."""
    pattern = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])
    last = lambda path: F.element_at(_segments(path), -1)

    def wrong(v: Column, kind: Column) -> Column:
        fits = F.rlike(F.schema_of_variant(v), F.concat(F.lit("^("), F.try_element_at(pattern, kind), F.lit(")$")))
        return ~fits | ((kind == "integer") & F.contains(_variant_text(v), F.lit(".")))

    def faults(root: Column, s: Column) -> Column:
        name = s["name"]
        lacks = F.exists(_nodes(root, _parent(name)), lambda p: F.schema_of_variant(p).startswith("OBJECT") & ~F.array_contains(_keys(p), _key(last(name))))
        missing = F.when(s["required"] & (last(name) != "*") & lacks, F.concat(F.lit("missing:"), name))
        of = _nodes(root, name)
        kind = F.when(F.exists(of, lambda v: wrong(v, s["type"])), F.concat(F.lit("type:"), name))
        choice = F.when(s["choices"].isNotNull() & F.exists(of, lambda v: ~F.array_contains(s["choices"], _variant_text(v))), F.concat(F.lit("enum:"), name))
        return F.filter(F.array(missing, kind, choice), lambda x: x.isNotNull())

    def unknown(root: Column, parent: Column) -> Column:
        known = F.transform(F.filter(spec, lambda s: _parent(s["name"]) == parent), lambda s: last(s["name"]))
        keys = F.array_distinct(F.flatten(F.transform(_nodes(root, parent), _keys)))
        more = F.array_except(keys, F.transform(known, _key))
        under = F.when(parent == "", F.lit("")).otherwise(F.concat(parent, F.lit("/")))
        return F.when(F.array_contains(known, "**"), F.array().cast("array<string>")).otherwise(F.transform(more, lambda k: F.concat(F.lit("unknown:"), under, k)))

    real = F.filter(spec, lambda s: last(s["name"]) != "**")
    parents = F.array_distinct(F.concat(F.array(F.lit("")), F.transform(spec, lambda s: _parent(s["name"]))))
    found = lambda root: F.array_sort(F.array_distinct(F.concat(F.flatten(F.transform(real, lambda s: faults(root, s))), F.flatten(F.transform(parents, lambda p: unknown(root, p))))))
    root = F.try_parse_json(arguments)
    whole = F.coalesce(F.schema_of_variant(root).startswith("OBJECT"), F.lit(False))
    return F.when(~whole, F.array(F.lit("malformed"))).when(spec.isNull(), F.array(F.lit("unknown_tool"))).otherwise(let(root, found))


def _anchors(scratch: Scratch, calls: DataFrame, deps: DataFrame) -> DataFrame:
    """``conv_id, call_id, anchor, dist, done``: where a call's chain of single dependencies ends, and how far that is.

    A chain ends at a call without dependencies or with several. Pointers double each
    round; when a round finishes no call, those left are on a cycle or lead to one.
    """
    key = ["conv_id", "call_id"]
    each = deps.groupBy(*key).agg(F.count("*").alias("k"), F.min("dep").alias("dep"))
    at = calls.select(*key).join(each, key, "left")
    single = F.coalesce(F.col("k") == 1, F.lit(False))
    at = at.select(*key, F.when(single, F.col("dep")).otherwise(F.col("call_id")).alias("anchor"), single.cast("long").alias("dist"), (~single).alias("done"))
    at = scratch.table(at, "anchors")
    while True:
        ahead = at.select("conv_id", F.col("call_id").alias("anchor"), F.col("anchor").alias("to"), F.col("dist").alias("more"), F.col("done").alias("end"))
        out = at.join(ahead, ["conv_id", "anchor"], "left")
        out = out.select(*key, F.coalesce("to", "anchor").alias("anchor"), (F.col("dist") + F.coalesce("more", F.lit(0))).alias("dist"), F.coalesce("end", F.col("done")).alias("done"), F.col("done").alias("was"))
        at = scratch.table(out, "anchors")
        if at.where("done and not was").isEmpty():
            return at.drop("was")


def levels(scratch: Scratch, calls: DataFrame, after: DataFrame) -> DataFrame:
    """``conv_id, call_id, level`` of ``calls``: 0 without dependencies, else one beyond the highest; calls on a cycle or behind one have no row.

    ``after(conv_id, call_id, dep)`` are dependencies; those on calls that do not exist
    have no effect. All three columns are without nulls here: see :func:`_code`. Chains of single dependencies are jumped; what remains is peeled, so
    rounds follow the nesting of calls with several dependencies.
    """
    key = ["conv_id", "call_id"]
    there = calls.select("conv_id", F.col("call_id").alias("dep"))
    deps = scratch.table(after.select(*key, "dep").distinct().join(there, ["conv_id", "dep"], "left_semi"), "deps")
    at = _anchors(scratch, calls, deps).where("done")
    known = scratch.table(at.where("dist = 0").join(deps, key, "left_anti").select(*key, F.lit(0).cast("long").alias("level")), "level0")
    several = deps.groupBy(*key).agg(F.count("*").alias("k")).where("k > 1").select(*key)
    left = deps.join(several, key, "left_semi").join(at.select("conv_id", F.col("call_id").alias("dep"), "anchor", "dist"), ["conv_id", "dep"], "left")
    left = scratch.table(left.select(*key, "anchor", (F.col("dist") + 1).alias("dist")), "several")
    k = 0
    while not left.isEmpty():
        k += 1
        told = left.join(known.select("conv_id", F.col("call_id").alias("anchor"), "level"), ["conv_id", "anchor"], "left")
        whole = told.groupBy(*key).agg(F.max(F.col("level") + F.col("dist")).alias("level"), F.max(F.col("level").isNull()).alias("waits"))
        fresh = scratch.table(whole.where("not waits").select(*key, "level"), f"fresh{k % 2}")
        if fresh.isEmpty():
            break
        known = scratch.table(known.union(fresh), "known")
        left = scratch.table(left.join(fresh, key, "left_anti"), "several")
    found = known.select("conv_id", F.col("call_id").alias("anchor"), "level")
    return at.join(found, ["conv_id", "anchor"]).select(*key, (F.col("level") + F.col("dist")).cast("int").alias("level"))


def _code(value: Column) -> Column:
    """A text for an identifier of any type, another for null, so that nulls meet by plain equality."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit("null"))


def _coded(df: DataFrame, **extra: str) -> list[Column]:
    """Keys of a table's rows by code, and more of its columns so."""
    return [_code(F.col(c)).alias(name) for name, c in {"k_conv": "conv_id", "k_call": "call_id", **extra}.items()]


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame, after: DataFrame | None = None) -> DataFrame:
    """One row per conversation and identifier that a call or a result has.

    ``calls(conv_id, call_id, turn, tool, arguments)``, ``results(conv_id, call_id, turn,
    content)``, ``schemas(tool, name, type, required)`` and, if there, ``choices``, an array of
    JSON values that an argument must be one of.

    ``name`` is a path of keys parted by slashes (``~1`` is a slash in a key, ``~0`` a tilde),
    with ``*`` for the items of an array (``~2`` is the key ``*``): ``to/*/city``. ``required`` holds
    wherever the parent is an object. A field that is not named is a fault, unless its
    parent also has the name ``**``. A row of ``schemas`` with a null name declares a tool
    without fields; a null type allows any.

    Of several calls or results with one identifier the first by turn, then by content,
    counts, and ``n_calls``, ``n_results`` tell the number. ``status`` is linked,
    missing_result or orphan_result. ``level`` orders calls topologically and is null for
    those on a cycle or behind one. ``errors`` and ``json`` are null for orphans; in ``json``,
    arguments that are no JSON stand as text and absent values are left out. Null
    conversations and identifiers link, and depend on each other, like equal values. Repeated
    rows add to the numbers only. Empty tables give an empty result; other columns are not
    read, whatever their names. Arguments of any length are parsed whole, up to the 16 MB of
    a variant: beyond that they count as malformed.
    """
    scratch = Scratch(calls.sparkSession)
    first = lambda *c: F.min(F.struct(*c))
    c = calls.select(*_coded(calls), F.struct("conv_id", "call_id").alias("key"), "turn", "tool", "arguments")
    c = scratch.table(c.groupBy("k_conv", "k_call").agg(F.any_value("key").alias("c_key"), first("turn", "tool", "arguments").alias("c"), F.count("*").alias("n_calls")), "calls")
    r = results.select(*_coded(results), F.struct("conv_id", "call_id").alias("key"), "turn", "content")
    r = scratch.table(r.groupBy("k_conv", "k_call").agg(F.any_value("key").alias("r_key"), first("turn", "content").alias("r"), F.count("*").alias("n_results")), "results")
    choices = F.transform("choices", canonical) if "choices" in schemas.columns else F.lit(None).cast("array<string>")
    field = F.when(F.col("name").isNotNull(), F.struct("name", "type", F.coalesce("required", F.lit(False)).alias("required"), choices.alias("choices")))
    specs = scratch.table(schemas.groupBy(_code(F.col("tool")).alias("k_tool")).agg(F.collect_set(field).alias("spec")), "specs")
    ids = c.select(F.col("k_conv").alias("conv_id"), F.col("k_call").alias("call_id"))
    level = levels(scratch, ids, after.select(*_coded(after, dep="dep")).toDF("conv_id", "call_id", "dep")) if after is not None else ids.withColumn("level", F.lit(0))
    out = c.join(r, ["k_conv", "k_call"], "full").join(level.toDF("k_conv", "k_call", "level"), ["k_conv", "k_call"], "left")
    out = out.withColumn("k_tool", _code(F.col("c.tool"))).join(specs, "k_tool", "left")
    is_call, is_result = F.col("n_calls").isNotNull(), F.col("n_results").isNotNull()
    arguments, key = F.col("c.arguments"), F.coalesce("c_key", "r_key")
    quoted = lambda x: F.regexp_extract(F.to_json(F.array(x)), r"(?s)^\[(.*)\]$", 1)
    part = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f'"{name}":'), value))
    # keys in order; a null field is left out
    fields = [part("arguments", F.coalesce(canonical(arguments), F.when(arguments.isNotNull(), quoted(arguments))))]
    fields += [part(name, F.when(x.isNotNull(), quoted(x))) for name, x in (("content", F.col("r.content")), ("id", key["call_id"].cast("string")), ("name", F.col("c.tool")))]
    json = F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))
    return out.select(
        key["conv_id"].alias("conv_id"),
        key["call_id"].alias("call_id"),
        F.col("c.turn").alias("turn"),
        F.col("r.turn").alias("result_turn"),
        F.coalesce("n_calls", F.lit(0)).alias("n_calls"),
        F.coalesce("n_results", F.lit(0)).alias("n_results"),
        F.when(is_call & is_result, "linked").when(is_call, "missing_result").otherwise("orphan_result").alias("status"),
        F.when(is_call, F.col("level")).alias("level"),
        F.when(is_call, _errors(arguments, F.col("spec"))).alias("errors"),
        F.when(is_call, json).alias("json"),
    )


def serialised(linked: DataFrame) -> DataFrame:
    """``conv_id, call_id, level, turn, json`` of the calls of :func:`link` in topological order: by conversation, level, turn and identifier.

    Calls on a cycle or behind one come last. Rows are dealt by ranges of that whole order,
    so a long conversation is spread, and written as text they are its JSON Lines.
    """
    order = ["conv_id", F.col("level").isNull(), "level", "turn", "call_id"]
    return linked.where("json is not null").select("conv_id", "call_id", "level", "turn", "json").repartitionByRange(*order).sortWithinPartitions(*order)


def from_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and dependencies of a table ``conv_id, turn, role, text``.

    A user turn calls the tool ``reply`` with its text and turn; the assistant's next turn
    is its result; a call depends on the call two turns before. A system turn calls
    ``configure``. Arguments are written with their keys out of order.
    """
    at = lambda t: F.concat_ws("-", F.lit("call"), F.col("conv_id"), t)
    quoted = F.to_json(F.struct(F.col("turn").alias("turn"), F.coalesce("text", F.lit("")).alias("text")))
    tool = F.when(F.col("role") == "system", "configure").otherwise("reply")
    calls = conversations.where(F.col("role").isin("user", "system")).select("conv_id", at(F.col("turn")).alias("call_id"), "turn", tool.alias("tool"), quoted.alias("arguments"))
    results = conversations.where("role = 'assistant'").select("conv_id", at(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    after = conversations.where("role = 'user'").select("conv_id", at(F.col("turn")).alias("call_id"), at(F.col("turn") - 2).alias("dep"))
    return calls, results, after


#: What the two tools of :func:`from_turns` take.
SCHEMAS = [("reply", "text", "string", True), ("reply", "turn", "integer", True), ("configure", "text", "string", True)]


def link_turns(conversations: DataFrame) -> DataFrame:
    spark = conversations.sparkSession
    schemas = spark.createDataFrame(SCHEMAS, "tool string, name string, type string, required boolean")
    calls, results, after = from_turns(conversations)
    return link(calls, results, schemas, after)
