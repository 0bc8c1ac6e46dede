"""Queries and oracle SQL of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelume.llm import brown, decontaminate, factorization, hard_negatives, line_dedup, mixing, quality_rules, runs, scratch, simhash, suffixes, text, tokens, tool_calls, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return out.select(F.col("id").alias("doc_id"), hexed.alias("fingerprint"), "component_id")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.new_path(spark, "tokens")
    tokens.write_tokens(_read(spark, sf_dir, "documents"), path, tokenizer_path())
    return tokens.digests(spark, path)


def op4_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.scored(_read(spark, sf_dir, "documents"))


def op5_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tool_calls.link_turns(_read(spark, sf_dir, "conversations"))
    return out.withColumn("errors", F.array_join("errors", ","))


def op6_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_pages(_read(spark, sf_dir, "pages"))
    return out.select("page_id", "host", "n_lines", "n_kept", F.md5(F.col("text").cast("binary")).alias("kept_md5"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judged(_read(spark, sf_dir, "documents"), carry=["doc_id"])
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
    return out.select("doc_id", *[F.col(f"q_{c}").alias(c) for c in names])


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.new_path(spark, "warc")
    manifest = warc.write_archives(_read(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_factorization(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factorization.scored(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


#: Target shares of tokens by the domains that ``labels`` names.
WEIGHTS = {"clean": 0.97, "low": 0.02, "toxic": 0.01}


def label_domains(labels: DataFrame) -> DataFrame:
    """``doc_id, domain``: toxic, clean or low; none where the labels that decide are null."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean").when(F.col("quality") == 0, "low")
    return labels.select("doc_id", domain.alias("domain"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, model = mixing.mixed(_read(spark, sf_dir, "documents"), label_domains(_read(spark, sf_dir, "labels")), WEIGHTS, carry=["doc_id"])
    posteriors = [F.element_at("mix_posteriors", k + 1).alias(f"p_{d}") for k, d in enumerate(model.domains)]
    return out.select("doc_id", F.col("mix_tokens").alias("n_tokens"), *posteriors, F.col("mix_rate").alias("rate"), F.col("mix_copies").alias("copies"), F.lit(model.fit.met).alias("met"))


def op11_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.without_repeats(_read(spark, sf_dir, "documents"), digests=True)


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = text.crc32_text(F.col("doc_id"))
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"))

    def repeated(w):
        n = F.size(w).cast("long")
        a = F.col("g") % n
        p = 1 + F.floor((n - a) / (3 + F.col("g") % 8))
        from_ = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))
        return F.when(n > 0, F.array_join(F.transform(from_, lambda i: F.get(w, i)), " "))

    whole = F.when((F.col("h") % 10 == 0) & F.col("text").isNotNull(), text.let(text.words(F.col("text")), repeated)).otherwise(F.col("text"))
    found = runs.with_runs(docs.select("doc_id", whole.alias("text")))
    better = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    # runs are in order of start, then period, so a later one must be better
    top = F.aggregate("runs", none, lambda x, y: F.when(x.isNull() | better(y, x), y).otherwise(x))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), top.alias("top"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    milli = F.floor(F.lit(1000) * F.col("top.length") / F.col("top.period"))
    return out.select("doc_id", "n_runs", "top.start", "top.length", "top.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": op1_simhash,
        "op2_decontaminate": op2_decontaminate,
        "op3_tokens": op3_tokens,
        "op4_brown": op4_brown,
        "op5_tool_calls": op5_tool_calls,
        "op6_site_lines": op6_site_lines,
        "op7_quality_rules": op7_quality_rules,
        "op8_warc": op8_warc,
        "op9_factorization": op9_factorization,
        "op10_mixing": op10_mixing,
        "op11_suffixes": op11_suffixes,
        "op12_runs": op12_runs,
        "op13_hard_negatives": op13_hard_negatives,
    }


_OP2 = r"""
with d as (select doc_id, row_number() over () as r, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents),
b as (select item_id, row_number() over () as k, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from (select distinct item_id, text from benchmark)),
bw as (select *, least(5, len(w)) as v from b where len(w) > 0),
bs as (select item_id, k, v, list_distinct(list_transform(range(1, (len(w) - v + 2)::bigint), lambda i: array_to_string(w[i:i+v-1], ' '))) as s from bw),
be as (select item_id, k, v, len(s) as n, unnest(s) as x from bs),
dw as (select doc_id, r, w, v from d, (select distinct v from bw) where len(w) >= v),
ds as (select doc_id, r, v, unnest(list_distinct(list_transform(range(1, (len(w) - v + 2)::bigint), lambda i: array_to_string(w[i:i+v-1], ' ')))) as x from dw)
select doc_id, item_id, n as n_shingles, count(*) as n_shared
from ds join be on ds.v = be.v and ds.x = be.x group by doc_id, r, item_id, k, n having count(*) >= 0.8 * n
"""


_OP8 = """
with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as payload_digest, max(page_id) over (partition by coalesce(html, '')) as m from pages)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 1000 and page_id <> m then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and page_id <> m then m end as refers_to
from p
"""


_OP5 = """
with recursive t as (select conv_id, turn, role, text, concat_ws('-', 'call', conv_id, case when role = 'assistant' then turn - 1 else turn end) as call_id from conversations),
c as (select conv_id, call_id, min(row(turn, case when role = 'system' then 'configure' else 'reply' end, coalesce(text, ''))) as c, count(*) as n_calls from t where role in ('user', 'system') group by conv_id, call_id),
r as (select conv_id, call_id, min(row(turn, text)) as r, count(*) as n_results from t where role = 'assistant' group by conv_id, call_id),
d as (select distinct t.conv_id, t.call_id, concat_ws('-', 'call', t.conv_id, t.turn - 2) as dep from t where role = 'user'),
e as (select d.* from d join c on c.conv_id = d.conv_id and c.call_id = d.dep),
l as (select conv_id, call_id, 0 as level from c where not exists (select 1 from e where e.conv_id = c.conv_id and e.call_id = c.call_id)
  union all select e.conv_id, e.call_id, level + 1 from l join e on e.conv_id = l.conv_id and e.dep = l.call_id)
select coalesce(c.conv_id, r.conv_id) as conv_id, coalesce(c.call_id, r.call_id) as call_id, c.c[1] as turn, r.r[1] as result_turn,
  coalesce(n_calls, 0) as n_calls, coalesce(n_results, 0) as n_results,
  case when n_calls > 0 and n_results > 0 then 'linked' when n_calls > 0 then 'missing_result' else 'orphan_result' end as status,
  l.level, case when n_calls > 0 then case when c.c[2] = 'configure' then 'unknown:turn' else '' end end as errors,
  case when n_calls > 0 then '{"arguments":{"text":' || to_json(c.c[3])::varchar || ',"turn":' || c.c[1] || '}' ||
    case when r.r[2] is not null then ',"content":' || to_json(r.r[2])::varchar else '' end || ',"id":"' || c.call_id || '","name":"' || c.c[2] || '"}' end as json
from c full join r on c.conv_id = r.conv_id and c.call_id = r.call_id left join l on l.conv_id = c.conv_id and l.call_id = c.call_id
"""

_OP6 = r"""
with h as (select row_number() over () as r, page_id, regexp_extract(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1) as host,
  list_filter(list_transform(string_split_regex(regexp_replace(coalesce(html, ''),
    '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|</?(?:a|b|i|em|strong|span|u|small|sup|sub|code)(?:\s[^<>]*)?>', '', 'g'), '<[^<>]*>|\n'),
    lambda x: trim(x)), lambda x: x <> '') as lines from pages),
l as (select r, page_id, host, unnest(lines) as line, generate_subscripts(lines, 1) as pos from h),
c as (select host, line, count(distinct r) as n from l group by all),
p as (select host, count(*) as pages from h group by host),
bars as (select c.host, line from c join p on c.host = p.host where n >= 2 and n > 0.3 * pages),
k as (select r, count(*) as n_kept, string_agg(line, chr(10) order by pos) as text from l where not exists (select 1 from bars b where b.host = l.host and b.line = l.line) group by r)
select page_id, host, len(lines)::bigint as n_lines, coalesce(n_kept, 0)::bigint as n_kept, md5(coalesce(text, '')) as kept_md5 from h left join k using (r)
"""


_OP13 = """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as e
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, b.vec_id as other, a.label = b.label as same, list_inner_product(a.e, b.e)::bigint as score from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (select * from s where same qualify row_number() over (partition by anchor_id order by score desc, other) <= 5),
n as (select p.anchor_id, p.other as positive_id, s.other as negative_id, p.score as positive_score, s.score as negative_score,
  row_number() over (partition by p.anchor_id, p.other order by s.score desc, s.other)::int as rank
  from p join s on s.anchor_id = p.anchor_id and not s.same and 80 * p.score <= 100 * s.score and s.score <= p.score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_decontaminate": _OP2, "op5_tool_calls": _OP5, "op6_site_lines": _OP6, "op8_warc": _OP8, "op13_hard_negatives": _OP13}
