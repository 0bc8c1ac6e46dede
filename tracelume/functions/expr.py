"""Column expressions of the call model: all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of credentials and paths, and what replaces them.
SECRETS = (
    r"\bsk-ant-[A-Za-z0-9_-]{8,}\b",
    r"\bsk-[A-Za-z0-9][A-Za-z0-9_-]{7,}\b",
    r"(?i)\b(?:api[-_]?key|token|secret|password|authorization)\s*[:=]\s*[\"']?[^\s\"'`,;]{4,}",
    r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]{8,}",
)
PATHS = (r"[A-Za-z]:\\[^\s'\"`,;)]*", r"(?<![\w.])/(?:[\w.-]+/)+[\w.-]*")
DISPATCH = r"""\btools(?:\.([A-Za-z_$][\w$]*)|\[\s*(['"])([^'"\]]+)\2\s*\])\s*\("""
RESERVED = r"(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\.|$)"
FAILURE_CAP, STREAM_FLOOR_MS, SPEED_CEILING = 500, 200, 500


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def billed_input(inp: Column, read: Column, write: Column) -> Column:
    return F.coalesce(inp, F.lit(0)) + F.coalesce(read, F.lit(0)) + F.coalesce(write, F.lit(0))


def hit_rate(inp: Column, read: Column, write: Column) -> Column:
    """Percent of billed input read from cache; null if unreported or nothing was billed."""
    billed = billed_input(inp, read, write)
    return F.when(read.isNotNull() & (billed > 0), read / billed * 100)


def speed(output: Column, duration: Column, ttfb: Column) -> Column:
    """struct(tps, approx): output per second of the stream, or of the whole call where that cannot be measured."""
    stream = duration - ttfb
    exact = output / (stream / 1000)
    whole = F.when(duration > 0, output / (duration / 1000))
    measured = F.coalesce((stream >= STREAM_FLOOR_MS) & (exact <= SPEED_CEILING), F.lit(False))
    return F.when(
        output.isNotNull() & (duration > 0),
        F.struct(F.when(F.coalesce(stream >= STREAM_FLOOR_MS, F.lit(False)) & measured, exact).otherwise(whole).alias("tps"), (~measured).alias("approx")),
    )


def phases(duration: Column, ttfb: Column) -> Column:
    """struct(wait, stream, total) in milliseconds."""
    return F.struct(ttfb.alias("wait"), (duration - ttfb).alias("stream"), duration.alias("total"))


def bucket_start(ms: Column, width: Column | int, anchor: Column | int) -> Column:
    """Start of the ``width`` bucket that holds ``ms``, counted from ``anchor``; both directions floor."""
    width, anchor = (F.lit(x) if isinstance(x, int) else x for x in (width, anchor))
    off = ms - anchor
    return (ms - F.pmod(off, width)).cast("long")


def local_midnight(ms: Column) -> Column:
    """Midnight in the session's zone, in milliseconds."""
    return F.unix_millis(F.date_trunc("DAY", F.timestamp_millis(ms)))


def redact(text: Column, cap: int = FAILURE_CAP) -> Column:
    """Credentials replaced in pattern order; a longer text is cut and says by how much (UTF-16 units)."""
    for p in SECRETS:
        text = F.regexp_replace(text, p, "<redacted>")
    cut = F.decode(F.substring(F.encode(text, "UTF-16BE"), 1, 2 * cap), "UTF-16BE")
    return F.when(utf16_length(text) > cap, F.concat(cut, F.lit("… (+"), (utf16_length(text) - cap).cast("string"), F.lit(" chars)"))).otherwise(text)


def redact_secrets(text: Column) -> Column:
    for p in SECRETS:
        text = F.regexp_replace(text, p, "<redacted>")
    return text


def redact_paths(text: Column) -> Column:
    for p in PATHS:
        text = F.regexp_replace(text, p, "<path>")
    return text


def error_text(name: Column, code: Column, message: Column) -> Column:
    head = F.concat(name, F.coalesce(F.concat(F.lit(" ("), code, F.lit(")")), F.lit("")))
    return redact_paths(F.concat(head, F.lit(": "), message))


def display_path(path: Column, home: str | None, fold: bool = False, sep: str = "/") -> Column:
    """``path`` with the home prefix as ``~``; the prefix must end at a separator."""
    if not home:
        return path
    base = home.removesuffix(sep)
    p, b = (F.lower(path), base.lower()) if fold else (path, base)
    return F.when(p == b, "~").when(p.startswith(b + sep), F.concat(F.lit("~"), F.substring(path, len(base) + 1, 1 << 30))).otherwise(path)


def session_file(session_id: Column) -> Column:
    safe = F.regexp_replace(F.regexp_replace(session_id, "[^a-zA-Z0-9._-]", "_"), r"\.+$", "")
    safe = F.when(safe == "", "_").otherwise(safe)
    return F.concat(F.when(F.rlike(safe, F.lit(RESERVED)), F.concat(F.lit("_"), safe)).otherwise(safe), F.lit(".jsonl"))


def request_hash(salt: Column, json: Column) -> Column:
    return F.substring(F.sha1(F.concat(salt, F.lit("|"), json).cast("binary")), 1, 12)


def content_hash(body: Column) -> Column:
    return F.sha2(body.cast("binary"), 256)


def request_chars(system: Column, messages: Column) -> Column:
    """UTF-16 units of the system prompt and of all text blocks; blocks are variants."""
    blocks = F.flatten(F.transform(F.coalesce(messages, F.array()), lambda m: F.coalesce(m["content"], F.array())))
    one = lambda b: F.when(F.try_variant_get(b, "$.type", "string") == "text", F.coalesce(utf16_length(F.try_variant_get(b, "$.text", "string")), F.lit(0))).otherwise(F.lit(0))
    return F.coalesce(utf16_length(system), F.lit(0)) + F.aggregate(blocks, F.lit(0).cast("long"), lambda a, b: a + one(b))


def dispatch_names(name: Column, arguments: Column) -> Column:
    """Names a tool-call stands for: the call sites of a ``run_code`` program, else its own."""
    own = F.when((name == "") | name.isNull(), "tool").otherwise(name)
    code = F.try_variant_get(F.try_parse_json(arguments), "$.code", "string")
    sites = F.regexp_extract_all(code, F.lit(DISPATCH), 0)
    pick = lambda s: F.coalesce(*[F.nullif(F.regexp_extract(s, DISPATCH, k), F.lit("")) for k in (1, 3)], F.lit("tool"))
    inner = F.transform(sites, pick)
    return F.when((own == "run_code") & (F.size(inner) > 0), inner).otherwise(F.array(own))


def protocol(provider: Column, model: Column) -> Column:
    p, m = F.lower(provider), F.lower(model)
    first = p.contains("anthropic") | p.contains("claude") | m.startswith("claude")
    second = p.contains("codex") | p.contains("responses") | m.contains("gpt-5-codex")
    return F.when(first, "anthropic-messages").when(second, "openai-responses").otherwise("openai-completions")


def is_prefix(short: Column, long: Column) -> Column:
    return F.slice(long, 1, F.size(short)) == short


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix of two arrays of ids; a null id ends it."""
    n = F.least(F.size(a), F.size(b))
    off = F.filter(F.sequence(F.lit(0), n), lambda i: (i == n) | ~F.coalesce(F.get(a, i) == F.get(b, i), F.lit(False)))
    return F.element_at(off, 1)


def x_label(dispatches: Column) -> Column:
    """``a ×2 · b`` of array<struct<name,count>>."""
    one = lambda d: F.when(d["count"] > 1, F.concat(d["name"], F.lit(" ×"), d["count"].cast("string"))).otherwise(d["name"])
    return F.array_join(F.transform(dispatches, one), " · ")
