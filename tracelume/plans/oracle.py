"""The same queries in DuckDB's SQL."""

from __future__ import annotations

from tracelume.plans import log_queries, store_queries, stream_queries, wire_queries

_CALLS = """
e as (select *, cast(json_extract_string(props, '$.k') as bigint) as k, cast(floor(value * 100) as bigint) + 1 as d from events),
calls as (select user_id as session_id, event_id as id, event_id as pos, case when event_type = 'signup' then 'session-title' end as purpose,
  'p' || (k % 2) as provider, 'm' || (k % 3) as model, user_id || '-' || (k % 7) as request_hash, case when event_type = 'error' then 'error' else 'ok' end as status, 1 as attempt,
  epoch_us(ts) // 1000 as started_at, d as duration_ms, cast(floor(d * (k % 10) / 10) as bigint) as ttfb_ms,
  case when event_type <> 'error' then k * 10 end as input_tokens, case when event_type <> 'error' and k % 5 <> 0 then k * 90 end as cache_read,
  case when event_type <> 'error' and k % 4 = 0 then k * 3 end as cache_write, case when event_type <> 'error' then k + 1 end as output_tokens from e)"""

_ATTEMPTS = (
    _CALLS
    + """,
lagged as (select *, lag(request_hash) over w as p_hash, lag(status) over w as p_status, lag(started_at) over w as p_at from calls window w as (partition by session_id, provider order by pos)),
grouped as (select *, sum(case when p_hash = request_hash and p_status = 'error' and started_at - p_at <= 43200000 then 0 else 1 end) over (partition by session_id, provider order by pos) as run from lagged),
attempts as (select * exclude (attempt, p_hash, p_status, p_at, run), cast(row_number() over (partition by session_id, provider, run order by pos) as int) as attempt from grouped)"""
)
_STEPS = (
    _ATTEMPTS
    + """,
ranked as (select *, count(*) filter (where purpose is null) over (partition by session_id order by pos) as ordinary from attempts),
stepped as (select * exclude (ordinary), case when purpose is null then cast(count(*) filter (where purpose is null and (attempt = 1 or ordinary = 1)) over (partition by session_id order by pos) as bigint) end as step from ranked)"""
)


def _metrics(source: str) -> str:
    return f"""
m0 as (select *, input_tokens + coalesce(cache_read, 0) + coalesce(cache_write, 0) as billed, duration_ms - ttfb_ms as stream_ms, output_tokens / ((duration_ms - ttfb_ms) / 1000) as exact, output_tokens / (duration_ms / 1000) as whole from {source}),
metrics as (select *, case when cache_read is not null and billed > 0 then cache_read / billed * 100 end as hit_rate,
  case when output_tokens is null or duration_ms <= 0 then null when stream_ms >= 200 and exact <= 500 then exact else whole end as tps,
  case when output_tokens is null or duration_ms <= 0 then null else not coalesce(stream_ms >= 200 and exact <= 500, false) end as tps_approx from m0)"""


def _series(x: str) -> str:
    u = lambda c: f"case when output_tokens is not null then cast(coalesce({c}, 0) as double) end"
    values = {"hitRate": "hit_rate", "in": u("input_tokens"), "cacheRead": u("cache_read"), "cacheWrite": u("cache_write"), "out": u("output_tokens"), "duration": "cast(duration_ms as double)", "ttfb": "cast(ttfb_ms as double)", "tps": "tps"}
    arms = [f"select session_id, pos, cast({x} as bigint) as x, '{k}' as series, {v} as y, {'coalesce(tps_approx, false) and tps is not null' if k == 'tps' else 'false'} as approx from metrics" for k, v in values.items()]
    return "series as (" + " union all ".join(arms) + ")"


_TIME = f"with {_CALLS}, t as (select * from calls where purpose is null), {_metrics('t')}, {_series('started_at')}"

_LISTS = """
lists as (select a.conv_id as session_id, a.turn as pos, a.conv_id * 1000 + a.turn as call, (select max(text) from conversations s where s.conv_id = a.conv_id and s.role = 'system') as system,
  coalesce((select list(m.text order by m.turn) from conversations m where m.conv_id = a.conv_id and m.role <> 'system' and m.turn < a.turn), []) as messages from conversations a where a.role = 'assistant')"""
_PIECES = (
    _LISTS
    + """,
bodies as (select call, pos as "at", case when system is null then messages else list_prepend(system, messages) end as b from lists),
pieces as (select call, "at", generate_subscripts(b, 1) - 1 as pos, unnest(b) as body from bodies),
hashed as (select *, sha256(body) as hash, strlen(body) as z from pieces)"""
)
_NODES = """
nodes as (select conv_id || '/' || turn as hash, case when turn > 0 then conv_id || '/' || (turn - 1) end as parent, conv_id, turn, strlen(text) as bytes from conversations),
live as (select n.hash, n.parent from nodes n join (select conv_id, max(turn) as turn from conversations where role = 'assistant' group by conv_id) r on n.conv_id = r.conv_id and n.turn = r.turn
  union select n.hash, n.parent from live l join nodes n on n.hash = l.parent)"""


def _buckets(minutes: int) -> str:
    w = minutes * 60_000
    return f"""with {_CALLS}, ends as (select session_id, min(started_at) as lo, max(started_at) as hi from calls group by 1),
a as (select session_id, lo - lo % 86400000 as anchor, lo, hi from ends),
f as (select session_id, anchor, anchor + (lo - anchor) // {w} * {w} as first, anchor + (hi - anchor) // {w} * {w} as last from a),
grid as (select session_id, anchor, unnest(generate_series(first, last, {w})) as bucket from f)
select g.session_id, g.bucket, cast(coalesce(sum(cache_read), 0) as bigint) as cache_read, cast(coalesce(sum(input_tokens), 0) as bigint) as input_tokens,
  cast(coalesce(sum(cache_write), 0) as bigint) as cache_write, cast(coalesce(sum(output_tokens), 0) as bigint) as output_tokens, coalesce(cast(min(c.id) as varchar), '') as call_id
from grid g left join calls c on c.session_id = g.session_id and c.started_at >= g.bucket and c.started_at < g.bucket + {w} group by 1, 2"""


_REDACT = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\bsk-ant-[A-Za-z0-9_-]{8,}\b', '<redacted>', 'g'), '\bsk-[A-Za-z0-9][A-Za-z0-9_-]{7,}\b', '<redacted>', 'g'),
 '(?i)\b(?:api[-_]?key|token|secret|password|authorization)\s*[:=]\s*["'']?[^\s"''`,;]{4,}', '<redacted>', 'g'), '(?i)\bBearer\s+[A-Za-z0-9._~+/=-]{8,}', '<redacted>', 'g')"""


def _fixed(x: str, digits: int) -> str:
    """Decimals of a double, halves up: printf rounds the exact value, halves to even, and only multiples of a power of two can be halves."""
    return f"printf('%.{digits}f', case when ({x}) * 1048576 = floor(({x}) * 1048576) then ({x}) + 1e-7 else ({x}) end)"


def _sig3(x: str) -> str:
    return f"case when ({x}) >= 100 then {_fixed(x, 0)} when ({x}) >= 10 then {_fixed(x, 1)} else {_fixed(x, 2)} end"


def _or_dash(known: str, text: str) -> str:
    return f"case when {known} then {text} else '–' end"


def _ladder(n: str, below: int, plain: str, units: list[tuple[int, str]]) -> str:
    arms = "".join(f" when cast({_sig3(f'{n} / {float(size)!r}')} as double) < {1000 if below == 10_000 else 1024} then {_sig3(f'{n} / {float(size)!r}')} || '{unit}'" for size, unit in units[:-1])
    size, unit = units[-1]
    return _or_dash(f"{n} is not null", f"case when {n} < {below} then {plain}{arms} else {_sig3(f'{n} / {float(size)!r}')} || '{unit}' end")


def _tokens(n: str) -> str:
    return _ladder(n, 10_000, f"cast({n} as varchar)", [(1000, "k"), (10**6, "M")])


def _size(n: str) -> str:
    return _ladder(n, 1024, f"{n} || ' B'", [(1 << 10, " KB"), (1 << 20, " MB"), (1 << 30, " GB")])


def _duration(ms: str) -> str:
    x, minutes = f"({ms} / 1000.0::double)", f"cast(floor({ms} / 60000.0::double + 0.5) as bigint)"
    return _or_dash(
        f"{ms} is not null",
        f"case when {ms} < 1000 then {ms} || 'ms' when {ms} < 10000 then {_fixed(x, 2)} || 's' when {ms} < 60000 then {_fixed(x, 1)} || 's'"
        f" when {ms} < 3600000 then {ms} // 60000 || 'm' || cast(floor(({ms} % 60000) / 1000.0::double + 0.5) as bigint) || 's' else {minutes} // 60 || 'h' || lpad(cast({minutes} % 60 as varchar), 2, '0') || 'm' end",
    )


def _node(parent: str, entries: str) -> str:
    """A node's JSON."""
    listed = f"array_to_string([format('{{{{\"k\":\"m\",\"h\":\"{{}}\"}}}}', x) for x in {entries}], ',')"
    return f"""'{{"t":3' || coalesce(',"p":"' || {parent} || '"', '') || ',"e":[' || {listed} || ']}}'"""


def oracle_sql() -> dict[str, str]:
    page = "select id, session_id, model, started_at, status from calls"
    found = {
        "session_summary": f"""with {_ATTEMPTS} select session_id, count(*) as n_calls, count(*) filter (where status = 'error') as errors, count(*) filter (where status = 'aborted') as aborts,
 count(*) filter (where attempt > 1) as retried, cast(sum(coalesce(input_tokens, 0) + coalesce(cache_read, 0) + coalesce(cache_write, 0)) as bigint) as billed, cast(sum(coalesce(input_tokens, 0)) as bigint) as input,
 cast(sum(coalesce(cache_read, 0)) as bigint) as cache_read, cast(sum(coalesce(cache_write, 0)) as bigint) as cache_write, cast(sum(coalesce(output_tokens, 0)) as bigint) as output from attempts group by 1""",
        "model_tally": f"with {_CALLS} select session_id, provider, model, count(*) as n_calls, min(pos) as first_pos from calls group by all",
        "ledger_page": f"with {_CALLS} {page} order by pos desc limit 100 offset 50",
        "ledger_page_model": f"with {_CALLS} {page} where model = 'm1' order by pos desc limit 100 offset 10",
        "retry_attempts": f"with {_ATTEMPTS} select session_id, id, attempt from attempts",
        "stream_attempts": f"with {_ATTEMPTS} select session_id, provider, id, attempt from attempts".replace("provider, id", "id"),
        "step_numbers": f"with {_STEPS} select session_id, id, step from stepped",
        "predecessor_call": f"""with {_CALLS} select session_id, id, (select max(p.id) from calls p where p.session_id = c.session_id and p.purpose is not distinct from c.purpose and p.pos < c.pos and p.status = 'ok'
 and p.request_hash <> c.request_hash) as prev_id from calls c""",
        "call_metrics": f"with {_CALLS}, {_metrics('calls')} select id, billed, hit_rate, tps, tps_approx, stream_ms from metrics",
        "chart_step_series": f"""with recursive {_STEPS}, o as (select *, row_number() over (partition by session_id, step order by started_at, pos) as n from stepped where purpose is null and step is not null),
fold as (select session_id, step, n, pos, attempt, output_tokens is not null as used from o where n = 1 union all
  select o.session_id, o.step, o.n, case when o.attempt > f.attempt or (o.output_tokens is not null and not f.used) then o.pos else f.pos end, case when o.attempt > f.attempt or (o.output_tokens is not null and not f.used) then o.attempt else f.attempt end,
   case when o.attempt > f.attempt or (o.output_tokens is not null and not f.used) then o.output_tokens is not null else f.used end from fold f join o on o.session_id = f.session_id and o.step = f.step and o.n = f.n + 1),
best as (select session_id, step, max_by(pos, n) as pos from fold group by 1, 2), kept as (select s.* from stepped s join best b on b.session_id = s.session_id and b.pos = s.pos),
{_metrics('kept')}, {_series('step')} select session_id, x, series, y, approx from series""",
        "chart_time_series": f"{_TIME} select session_id, pos, x, series, y, approx from series",
        "chart_excluded": f"with {_STEPS} select session_id, count(*) filter (where purpose is not null or step is null) as excluded from stepped group by 1",
        "token_buckets_5m": _buckets(5),
        "token_buckets_60m": _buckets(60),
        "token_stack": f"""{_TIME}, o as (select *, list_position(['cacheRead', 'in', 'cacheWrite', 'out'], series) as r from series where series in ('cacheRead', 'in', 'cacheWrite', 'out'))
select session_id, pos, series, y, case when y is not null then sum(y) over (partition by session_id, pos order by r) end as top from o""",
        "gap_runs": f"""{_TIME}, g as (select *, sum(case when y is null then 1 else 0 end) over (partition by session_id, series order by x, pos) as gaps from series)
select session_id, series, pos, y, dense_rank() over (partition by session_id, series order by gaps) as run from g where y is not null""",
        "metric_extent": f"{_TIME} select series, min(y) as min_y, max(y) as max_y from series group by 1",
        "bar_columns": f"""with {_CALLS}, s as (select session_id, started_at as x, pos, output_tokens is not null as drawn, row_number() over (partition by session_id order by started_at, pos) - 1 as idx, count(*) over (partition by session_id) as n from calls),
t as (select *, greatest(1, cast(ceil(n / 40) as bigint)) as stride from s) select session_id, idx // stride as bar, max(idx) as idx, max_by(x, idx) as x from t where drawn group by 1, 2""",
        "trim_by_bytes": "with s as (select conv_id, turn as pos, strlen(text) as bytes, sum(strlen(text)) over (partition by conv_id order by turn desc) as t from conversations) select conv_id, pos, bytes from s where t <= 2000",
        "trim_by_count": "select conv_id, turn as pos, strlen(text) as bytes from conversations qualify row_number() over (partition by conv_id order by turn desc) <= 3",
        "storage_footprint": "select conv_id as session_id, cast(sum(strlen(text) + 1) as bigint) as envelope_bytes, cast(sum(case when turn % 2 = 0 then strlen(text) * 2 else 0 end) as bigint) as object_bytes from conversations group by 1",
        "piece_dedup": "select distinct sha256(text) as hash, strlen(text) as z from documents where text is not null",
        "marginal_bytes": f"""with {_PIECES}, f as (select hash, min(row("at", call, pos)) as f, min(z) as z from hashed group by 1), s as (select f[2] as call, sum(z) as b from f group by 1)
select distinct h.call, cast(coalesce(b, 0) as bigint) as bytes from hashed h left join s on s.call = h.call""",
        "message_reassembly": f"with {_PIECES} select call, md5(string_agg(body, chr(10) order by pos)) as digest, count(*) as n from hashed group by 1",
        "packing_order": f"with {_PIECES}, f as (select hash, min(row(\"at\", call, pos)) as f from hashed group by 1) select hash, row_number() over (order by f) as rank from f",
        "tree_nodes": f"""with recursive {_LISTS}, o as (select session_id, pos, [sha256(x) for x in messages] as e, row_number() over (partition by session_id order by pos) as r from lists),
w as (select session_id, pos, r, e, 'keyframe' as kind, 0 as depth from o where r = 1 union all
 select o.session_id, o.pos, o.r, o.e, case when o.e = w.e then 'reuse' when o.e[1:len(w.e)] = w.e and w.depth < 2 then 'delta' else 'keyframe' end,
  case when o.e = w.e then w.depth when o.e[1:len(w.e)] = w.e and w.depth < 2 then w.depth + 1 else 0 end from w join o on o.session_id = w.session_id and o.r = w.r + 1)
select session_id, pos, kind, cast(depth as bigint) as depth from w""",
        "tree_hashes": f"""with recursive {_LISTS}, o as (select session_id, pos, [sha256(x) for x in messages] as e, row_number() over (partition by session_id order by pos) as r from lists),
w as (select session_id, pos, r, e, 0 as depth, null::varchar as parent, sha256({_node("null", "e")}) as hash from o where r = 1 union all
 select session_id, pos, r, e, depth, parent, case when same then old else sha256(case when grows then {_node("old", "e[n+1:]")} else {_node("null", "e")} end) end from (
  select o.session_id, o.pos, o.r, o.e, w.hash as old, len(w.e) as n, o.e = w.e as same, o.e[1:len(w.e)] = w.e and w.depth < 2 as grows,
   case when o.e = w.e then w.depth when o.e[1:len(w.e)] = w.e and w.depth < 2 then w.depth + 1 else 0 end as depth,
   case when o.e = w.e then w.parent when o.e[1:len(w.e)] = w.e and w.depth < 2 then w.hash end as parent from w join o on o.session_id = w.session_id and o.r = w.r + 1) x)
select session_id, pos, hash, parent from w""",
        "tree_resolve": f"with {_LISTS} select call, sha256(array_to_string([sha256(x) for x in messages], ',')) as digest, len(messages) as n from lists",
        "mark_reachable": f"with recursive {_NODES} select distinct hash from live",
        "gc_candidates": f"with recursive {_NODES} select hash, bytes from nodes n where turn * 1800000 < 5400000 and not exists (select 1 from live l where l.hash = n.hash)",
        "pack_candidates": f"""with recursive {_NODES}, c as (select distinct n.hash, n.bytes, conv_id * 100 + turn + 1 as rank from nodes n join live l on l.hash = n.hash where turn * 1800000 < 4000000),
s as (select *, sum(bytes) over (order by rank) - bytes as spent from c) select hash, bytes, rank from s where not (spent > 0 and spent >= 20000)""",
        "repack_candidates": f"""with recursive {_NODES}, p as (select turn as pack, count(*) as entries, count(l.hash) as live, cast(sum(bytes) as bigint) as bytes, count(l.hash) / count(*) as live_ratio from nodes n left join (select distinct hash from live) l on l.hash = n.hash group by 1)
select pack, entries, live, bytes, live_ratio from p where not case when bytes < 20000 then live * 2 >= entries else live_ratio >= 0.5 end""",
        "redact_text": f"select doc_id, md5({_REDACT}) as digest from documents",
        "redact_capped": f"""with r as (select doc_id, {_REDACT} as t from documents)
select doc_id, md5(case when length(t) > 500 then left(t, 500) || '… (+' || (length(t) - 500) || ' chars)' else t end) as digest from r""",
        "tool_dispatches": r"""with e as (select event_id as call, event_type, json_extract_string(props, '$.k') as k, case when cast(json_extract_string(props, '$.k') as int) % 2 = 0 then chr(39) else chr(34) end as q from events),
p as (select call, event_type, 'tools.read(1); tools[ ' || q || event_type || q || ' ] (2); tools.k' || k || '(3); tools[' || chr(39) || 'x' || chr(34) || '](4); mytools.no(5); tools.read(6)' as code from e),
s as (select call, event_type, regexp_extract_all(code, '\btools(?:\.[A-Za-z_$][\w$]*|\[\s*(?:\x27[^\x27\x22\]]+\x27|\x22[^\x27\x22\]]+\x22)\s*\])\s*\(') as sites from p),
n as (select call, case when event_type = 'click' and len(sites) > 0 then [regexp_extract(x, '^tools(?:\.|\[\s*[\x27\x22])([^\x27\x22\](\s]+)', 1) for x in sites] when event_type in ('click', 'view') then [case event_type when 'click' then 'run_code' else 'tool' end] else [event_type] end as names from s),
u as (select call, unnest(names) as name, generate_subscripts(names, 1) as i from n),
c as (select call, name, count(*) as n, min(i) as i from u group by 1, 2)
select call, string_agg(name || case when n > 1 then ' ×' || n else '' end, ' · ' order by i) as label, cast(sum(n) as bigint) as total from c group by 1""",
        "protocol_detect": f"""with {_CALLS}, n as (select id, lower((['Anthropic', 'openai', 'azure-responses', 'my-codex', 'claude-x'])[id % 5 + 1] || provider) as p, lower((['gpt-4', 'Claude-3', 'gpt-5-codex'])[id % 3 + 1] || model) as m from calls)
select id, case when p like '%anthropic%' or p like '%claude%' or m like 'claude%' then 'anthropic-messages' when p like '%codex%' or p like '%responses%' or m like '%gpt-5-codex%' then 'openai-responses' else 'openai-completions' end as protocol from n""",
        "wire_usage_totals": f"""with {_CALLS}, t as (select id, coalesce(input_tokens, 0) + coalesce(cache_read, 0) + coalesce(cache_write, 0) as prompt_tokens, coalesce(output_tokens, 0) as completion_tokens, cache_read as cached_tokens from calls)
select *, prompt_tokens + completion_tokens as total_tokens from t""",
        "wire_chain": f"""with {_LISTS}, p as (select *, lag(len(messages)) over (partition by session_id order by pos) as prior from lists),
q as (select *, (select count(*) from range(prior, len(messages)) r(i) where i % 2 = 0) as fresh from p)
select call as id, case when prior is null then null when prior > 0 and fresh > 0 then 'true' else 'false' end as chained,
 case when prior is null then null when prior > 0 and fresh > 0 then fresh else len(messages) end as sent, case when prior is null then null when prior > 0 and fresh > 0 then len(messages) - fresh else 0 end as skipped from q""",
        "chain_prefix": f"""with {_LISTS}, p as (select *, lag(messages) over (partition by session_id order by pos) as prior from lists)
select call, case when prior is null then 0 else (select count(*) from range(1, least(len(prior), len(messages)) + 1) r(i) where prior[1:i] = messages[1:i]) end as prefix from p""",
        "spans_days": f"with {_CALLS} select session_id, min(started_at // 86400000) <> max(started_at // 86400000) as spans_days from calls group by 1",
        "session_files": r"select c_custkey, regexp_replace(regexp_replace(c_name || '/x:' || c_custkey || '..', '[^a-zA-Z0-9._-]', '_', 'g'), '\.+$', '') || '.jsonl' as file from customer",
        "lttb_series": f"""with recursive {_TIME.removeprefix('with ')}, s as (select *, row_number() over w - 1 as i, count(*) over (partition by session_id) as n from series where series = 'duration' window w as (partition by session_id order by x, pos)),
g as (select distinct session_id, n from s where n > 40), edges as (select session_id, k, least(cast(floor(k * ((n - 2) / 30)) as bigint) + 1, n - 1) as lo from g, range(32) r(k)),
b as (select e.session_id, e.k, e.lo, f.lo as hi, coalesce(avg(s.x), 0) as mx, coalesce(avg(s.y), 0) as my from edges e join edges f on f.session_id = e.session_id and f.k = e.k + 1 join edges h on h.session_id = e.session_id and h.k = e.k + 2
  left join s on s.session_id = e.session_id and s.i >= f.lo and s.i < h.lo group by all),
r as (select session_id, -1::bigint as k, 0::bigint as i from g union all
  select c.session_id, c.k + 1, -max(row(abs((l.x - b.mx) * (p.y - l.y) - (l.x - p.x) * (b.my - l.y)), -p.i))[2]
  from r c join b on b.session_id = c.session_id and b.k = c.k + 1 join s l on l.session_id = c.session_id and l.i = c.i join s p on p.session_id = c.session_id and p.i >= b.lo and p.i < b.hi group by c.session_id, c.k),
kept as (select session_id, i from r union select session_id, n - 1 from g union select session_id, arg_min(i, row(y, i)) from s group by 1 union select session_id, arg_min(i, row(-y, i)) from s group by 1)
select session_id, pos, x, series, y from s where n <= 40 or exists (select 1 from kept k where k.session_id = s.session_id and k.i = s.i)""",
        "formats": f"""with {_CALLS} select id, {_duration('duration_ms')} as duration, {_tokens('input_tokens')} as tokens, {_size('(duration_ms * 999)')} as size,
 strftime(make_timestamp(started_at * 1000), '%Y-%m-%d %H:%M:%S') || ' +00:00' as time from calls""",
        "ledger_rows": f"""with {_STEPS}, {_metrics('stepped')} select id, strftime(make_timestamp(started_at * 1000), '%H:%M:%S') as time,
 concat_ws(chr(0), model, '#' || step, purpose, case when attempt > 1 then '×' || attempt end) as model, {_duration('ttfb_ms')} as ttft, {_duration('duration_ms')} as total,
 case when tps_approx then '≈ ' else '' end || {_or_dash("tps is not null", f"{_sig3('tps')} || ' t/s'")} as speed, {_tokens('billed')} as billed, {_tokens('input_tokens')} as input, {_tokens('cache_read')} as hit,
 {_or_dash("cache_read is not null and billed > 0", f"{_sig3('(cast(cache_read as double) / billed * 100)')} || '%'")} as hit_pct, {_tokens('cache_write')} as "write", {_tokens('output_tokens')} as output, '–/–' as messages from metrics""",
    }
    return found | log_queries.oracle_sql(_TIME, _LISTS, _STEPS, _CALLS) | wire_queries.oracle_sql(_LISTS) | store_queries.oracle_sql() | stream_queries.oracle_sql(log_queries._EVENTS, _CALLS)
