"""Schemas of the call log. Open content blocks stay JSON text, so unknown keys survive."""

from __future__ import annotations

USAGE = "struct<inputTokens:bigint,outputTokens:bigint,cacheReadTokens:bigint,cacheWriteTokens:bigint,reasoningTokens:bigint>"
TOOL_COUNT = "array<struct<name:string,count:bigint>>"
FAILURE = "struct<message:string,code:string,status:bigint,requestId:string>"
TIMING = "struct<startedAt:bigint,firstChunkAt:bigint,endedAt:bigint>"

#: One provider attempt, first version: the whole record in a line.
RECORD_V1 = (
    "schema int, id string, sessionId string, purpose string, provider string, model string, reasoningEffort string, requestHash string, attempt int, "
    f"timing {TIMING}, "
    "request struct<system:string,messages:array<struct<id:string,role:string,content:array<variant>,sourceKind:string>>,tools:array<struct<name:string,description:string,parameters:variant>>,temperature:double,maxTokens:bigint,stop:array<string>>, "
    f"response struct<blocks:array<variant>,usage:{USAGE},finish:struct<kind:string,failure:{FAILURE}>,chunkCount:bigint>, "
    "status string"
)
OPTIONS = "struct<temperature:double,maxTokens:bigint,stop:array<string>>"
SUM = f"struct<messageCount:bigint,requestChars:bigint,toolCalls:bigint,calledTools:{TOOL_COUNT},toolNames:array<string>,usage:{USAGE},finishKind:string,finishMessage:string>"
#: Later versions: a head, a precomputed summary, and references to pieces by hash.
ENVELOPE = f"v int, sum {SUM}, refs array<struct<k:string,h:string,z:bigint>>, tree string, resp string, zn bigint, id string, sessionId string, purpose string, provider string, model string, reasoningEffort string, requestHash string, attempt int, timing {TIMING}, status string, opts {OPTIONS}"

#: A line of any version.
RECORD = f"{RECORD_V1}, v int, sum {SUM}, refs array<struct<k:string,h:string,z:bigint>>, tree string, resp string, zn bigint, opts {OPTIONS}"
#: What is stored of a line of the first version, as strings: keys keep their order.
EXACT = "request struct<system:string,tools:string,messages:array<string>>, response string"
#: A line of any version as far as its pieces go.
PIECES = f"schema int, v int, id string, sum {SUM}, refs array<struct<k:string,h:string,z:bigint>>, tree string, {EXACT}"

#: The list projection that analytics run on.
CALLS = (
    "session_id string, id string, pos bigint, purpose string, provider string, model string, request_hash string, attempt int, started_at bigint, duration_ms bigint, ttfb_ms bigint, status string, "
    "input_tokens bigint, output_tokens bigint, cache_read bigint, cache_write bigint, reasoning_tokens bigint, has_usage boolean, finish_kind string, finish_message string, message_count bigint, request_chars bigint, "
    f"tool_calls bigint, called_tools {TOOL_COUNT}, tool_names array<string>, line_bytes bigint, object_bytes bigint, version int"
)
