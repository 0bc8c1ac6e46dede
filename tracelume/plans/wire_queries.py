"""Records with all kinds of blocks in the provider formats, and the same in SQL."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelume.operators import wire
from tracelume.sources.driver import read, turns_as_lists

SHAPES = {"anthropic": "anthropic-messages", "chat": "openai-completions", "responses": "openai-responses"}


def records(spark: SparkSession, d: str) -> DataFrame:
    """``id, record``: every assistant turn as a call with text, images, reasoning, tool calls, a result, tools, limits and usage.

    Calls of odd turns failed; odd conversations think.
    """
    c = turns_as_lists(read(spark, d, "conversations"))
    text, n = (lambda x: x.cast("string")), F.lit
    block = lambda kind, **f: F.to_json(F.struct(n(kind).alias("type"), *[v.alias(k) for k, v in f.items()]))
    listed = lambda *b: F.concat(n("["), F.concat_ws(",", *b), n("]"))
    image = lambda i, **f: block("image", attachment=F.struct(i.alias("attachmentId"), *[v.alias(k) for k, v in f.items()]))
    call = lambda i, raw: block("tool-call", id=i, name=n("run"), arguments=raw)
    said = lambda role, content: F.concat(n(f'{{"role":"{role}","content":'), content, n("}"))
    user = lambda m, i: said("user", listed(block("text", text=m), image(F.concat(n("a"), text(i)), mediaType=n("image/png"))))
    answer = lambda m, i: said("assistant", listed(block("reasoning", text=n("think")), block("text", text=m), call(F.concat(n("t"), text(i)), F.concat(n('{"n":'), text(i), n("}")))))
    inner = listed(block("text", text=n("res")), image(n("b")))
    last = said("user", listed(F.concat(n('{"type":"tool-result","toolCallId":"t1","content":'), inner, n(',"isError":true}')), block("text", text=n("next"))))
    messages = F.concat(F.transform("messages", lambda m, i: F.when(i % 2 == 0, user(m, i)).otherwise(answer(m, i))), F.array(last))
    failed = F.col("pos") % 2 == 1
    finish = F.when(failed, n('{"kind":"error","failure":{"message":"m","code":"c","status":500}}')).otherwise(n('{"kind":"tool-calls"}'))
    usage = F.to_json(F.struct(F.col("pos").alias("inputTokens"), n(3).alias("outputTokens"), (F.col("pos") * 2).alias("cacheReadTokens"), n(1).alias("reasoningTokens")))
    system = F.coalesce(F.concat(n('"system":'), F.regexp_extract(F.to_json(F.array("system")), r"(?s)^\[(.*)\]$", 1), n(",")), n(""))
    head = F.to_json(
        F.struct(
            text(F.col("call")).alias("id"),
            text(F.col("session_id")).alias("sessionId"),
            n("gpt-4").alias("model"),
            F.when(F.col("session_id") % 2 == 1, "high").alias("reasoningEffort"),
            F.concat_ws("-", "session_id", "pos").alias("requestHash"),
            n(1).alias("attempt"),
            F.struct((F.col("pos") * 1000 + 999).alias("startedAt")).alias("timing"),
        )
    )
    rest = n('"tools":[{"name":"run","description":"d","parameters":{"type":"object"}}],"temperature":0.5,"maxTokens":100,"stop":["x"]')
    request = F.concat(n("{"), system, n('"messages":['), F.array_join(messages, ","), n("],"), rest, n("}"))
    blocks = listed(block("reasoning", text=n("r")), block("text", text=n("ok")), call(n("z"), n("not json")))
    response = F.concat(n('{"blocks":'), blocks, n(',"usage":'), usage, n(',"finish":'), finish, n("}"))
    whole = F.concat(F.regexp_replace(head, r"\}$", ""), n(',"request":'), request, n(',"response":'), response, n("}"))
    return c.select(F.col("call").alias("id"), whole.alias("record"))


def _wire(protocol: str, side: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: records(spark, d).select("id", wire.wire_json(F.col("record"), F.lit(protocol), side).alias("json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f"wire_{name}_{side}": _wire(p, side) for name, p in SHAPES.items() for side in ("request", "response")}


def _note(name: str) -> str:
    return json.dumps(wire.NOTES[name], ensure_ascii=False).replace("'", "''")


def oracle_sql(lists: str) -> dict[str, str]:
    """JSON put together as text, key by key."""
    t = lambda x: f"to_json({x})::varchar"
    thinks, failed = "session_id % 2 = 1", "pos % 2 = 1"
    tool = '"name":"run","description":"d"'
    schema = '{"type":"object"}'
    name = "session_id || '-' || pos || '_1'"

    def rows(user: str, answer: str) -> str:
        """The messages' JSON, comma by comma; ``m`` is a text, ``k`` its place."""
        return f"array_to_string(list_transform(messages, lambda x, i: case when i % 2 = 1 then {user} else {answer} end), ',')"

    m, k = t("coalesce(x, '')"), "(i - 1)"
    arguments = t(f"'{{\"n\":' || {k} || '}}'")
    system = lambda before, after: f"coalesce('{before}' || {t('system')} || '{after}', '')"
    comma = lambda x: f"case when len(messages) > 0 then {x} || ',' else '' end"
    source = f'{{"type":"reference","_note":{_note("attachment")},"attachmentId":"'
    a_user = f"""'{{"role":"user","content":[{{"type":"text","text":' || {m} || '}},{{"type":"image","source":{source}a' || {k} || '","media_type":"image/png"}}}}]}}'"""
    a_answer = f"""'{{"role":"assistant","content":[{{"type":"thinking","thinking":"think","_note":{_note("signature")}}},{{"type":"text","text":' || {m} || '}},{{"type":"tool_use","id":"t' || {k} || '","name":"run","input":{{"n":' || {k} || '}}}}]}}'"""
    a_last = f'{{"role":"user","content":[{{"type":"tool_result","tool_use_id":"t1","content":[{{"type":"text","text":"res"}},{{"type":"image","source":{source}b"}}}}]}},{{"type":"text","text":"next"}}]}}'
    c_user = f"""'{{"role":"user","content":[{{"type":"text","text":' || {m} || '}},{{"type":"image_url","image_url":{{"url":"attachment:a' || {k} || '","_note":{_note("image_url")}}}}}]}}'"""
    c_call = f"""'{{"id":"t' || {k} || '","type":"function","function":{{"name":"run","arguments":' || {arguments} || '}}}}'"""
    c_answer = f"""'{{"role":"assistant","content":' || case when coalesce(x, '') = '' then 'null' else {m} end || ',"reasoning_content":"think","tool_calls":[' || {c_call} || ']}}'"""
    c_last = '{"role":"user","content":[{"type":"text","text":"next"}]},{"role":"tool","tool_call_id":"t1","content":"res[image b]","_isError":true}'
    r_user = f"""'{{"type":"message","role":"user","content":[{{"type":"input_text","text":' || {m} || '}},{{"type":"input_image","image_url":"attachment:a' || {k} || '","_note":{_note("image_url")}}}]}}'"""
    r_answer = (
        f"""'{{"type":"reasoning","summary":[{{"type":"summary_text","text":"think"}}]}},{{"type":"message","role":"assistant","content":[{{"type":"output_text","text":' || {m} || '}}]}}"""
        f""",{{"type":"function_call","call_id":"t' || {k} || '","name":"run","arguments":' || {arguments} || '}}'"""
    )
    r_last = '{"type":"function_call_output","call_id":"t1","output":"res[image b]"},{"type":"message","role":"user","content":[{"type":"input_text","text":"next"}]}'
    error = """case when pos % 2 = 1 then ',"{}":{{"message":"m","code":"c"{}}}' else '' end"""
    totals = lambda a, b: f"""'"usage":{{"{a}_tokens":' || pos * 3 || ',"{b}_tokens":3,"total_tokens":' || pos * 3 + 3 || ',"{a}_tokens_details":{{"cached_tokens":' || pos * 2 || '}},"{b}_tokens_details":{{"reasoning_tokens":1}}}}'"""
    sql = {
        "anthropic_request": f"""'{{"method":"POST","path":"/v1/messages","body":{{"model":"gpt-4","stream":true,' || {system('"system":[{"type":"text","text":', '}],')} || '"messages":[' || {comma(rows(a_user, a_answer))} || '{a_last}],"tools":[{{{tool},"input_schema":{schema}}}],'
  || case when {thinks} then '' else '"temperature":0.5,' end || '"max_tokens":100,"stop_sequences":["x"]' || case when {thinks} then ',"thinking":{{"type":"adaptive","display":"summarized"}},"output_config":{{"effort":"high"}},"_note":[{_note("temperature")},{_note("thinking")}]' else '' end || '}}}}'""",
        "anthropic_response": f"""'{{"id":"msg_reqlog_' || {name} || '","type":"message","role":"assistant","model":"gpt-4","content":[{{"type":"thinking","thinking":"r","_note":{_note("signature")}}},{{"type":"text","text":"ok"}},{{"type":"tool_use","id":"z","name":"run","input":{{"_note":{_note("not_parsed")},"raw":"not json"}}}}],"stop_reason":'
  || case when {failed} then 'null' else '"tool_use"' end || {error.format('_error', ',"status":500')} || ',"usage":{{"input_tokens":' || pos || ',"output_tokens":3,"cache_read_input_tokens":' || pos * 2 || '}}}}'""",
        "chat_request": f"""'{{"method":"POST","path":"/v1/chat/completions","body":{{"model":"gpt-4","messages":[' || {system('{"role":"system","content":', '},')} || {comma(rows(c_user, c_answer))} || '{c_last}],"stream":true,"stream_options":{{"include_usage":true}},"tools":[{{"type":"function","function":{{{tool},"parameters":{schema}}}}}],"temperature":0.5,"max_tokens":100,"stop":["x"]'
  || case when {thinks} then ',"reasoning_effort":"high"' else '' end || '}}}}'""",
        "chat_response": f"""'{{"id":"chatcmpl-reqlog_' || {name} || '","object":"chat.completion","created":' || pos || ',"model":"gpt-4","choices":[{{"index":0,"message":{{"role":"assistant","content":"ok","reasoning_content":"r","tool_calls":[{{"id":"z","type":"function","function":{{"name":"run","arguments":"not json"}},"index":0}}]}},"finish_reason":'
  || case when {failed} then 'null' else '"tool_calls"' end || '}}]' || {error.format('_error', ',"status":500')} || ',' || {totals('prompt', 'completion')} || '}}'""",
        "responses_request": f"""'{{"method":"POST","path":"/v1/responses","body":{{"model":"gpt-4","input":[' || coalesce('{{"type":"message","role":"' || case when {thinks} then 'developer' else 'system' end || '","content":[{{"type":"input_text","text":' || {t('system')} || '}}]}},', '') || {comma(rows(r_user, r_answer))} || '{r_last}],"stream":true,"store":false,"prompt_cache_key":"' || session_id || '"'
  || case when {thinks} then ',"reasoning":{{"effort":"high","summary":"auto"}},"include":["reasoning.encrypted_content"]' else '' end || ',"tools":[{{"type":"function",{tool},"parameters":{schema}}}],"temperature":0.5,"max_output_tokens":100}}}}'""",
        "responses_response": f"""'{{"id":"resp_reqlog_' || {name} || '","object":"response","created_at":' || pos || ',"model":"gpt-4","status":' || case when {failed} then '"failed"' else '"completed"' end || ',"output":[{{"type":"reasoning","summary":[{{"type":"summary_text","text":"r"}}]}},{{"type":"message","role":"assistant","content":[{{"type":"output_text","text":"ok"}}]}},{{"type":"function_call","call_id":"z","name":"run","arguments":"not json"}}]'
  || {error.format('error', '')} || ',' || {totals('input', 'output')} || '}}'""",
    }
    return {f"wire_{k}": f"with {lists} select call as id, {v} as json from lists" for k, v in sql.items()}
