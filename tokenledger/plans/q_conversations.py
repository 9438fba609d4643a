"""Conversation analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.enrich import context_usage
from ..functions.text import display_error
from ..operators import conversations as C
from . import inputs as I
from .registry import query

_WITH = f"WITH {I.CONVERSATIONS_SQL}"
_TURNS = f"WITH {I.TURNS_SQL}"
_HISTORY = "conversation_id, id, role, content, status, request_id, prompt_tokens, completion_tokens, created_at"


def _both(spark, sf):
    return I.conversations(spark, sf), I.messages(spark, sf)


def _failed(messages):
    """Conversations in which a turn failed."""
    return messages.filter(F.col("status") == "error").select("conversation_id").distinct()


@query("i1_list", f"""{_WITH} SELECT id, title, provider, model, created_at, updated_at,
  (SELECT count(*) FROM msg m WHERE m.conversation_id = c.id) AS message_count,
  (SELECT arg_max(content, (m.created_at, m.id)) FROM msg m WHERE m.conversation_id = c.id) AS last_message FROM conv c""")
def _(spark, sf):
    return C.list_conversations(*_both(spark, sf))


@query("i1_list_without_messages", f"""{_WITH} SELECT id, 0::BIGINT AS message_count, NULL::VARCHAR AS last_message FROM conv""")
def _(spark, sf):
    conversations, messages = _both(spark, sf)
    listed = C.list_conversations(conversations, messages.filter(F.col("role") == "nobody"))
    return listed.select("id", "message_count", "last_message")


@query("i2_lookup", f"{_WITH} SELECT * FROM conv WHERE id IN (SELECT conversation_id FROM msg WHERE status = 'error')")
def _(spark, sf):
    conversations, messages = _both(spark, sf)
    return C.get_conversations(conversations, _failed(messages))


@query("i3_history", f"{_WITH} SELECT {_HISTORY} FROM msg")
def _(spark, sf):
    return C.history(I.messages(spark, sf))


@query("i4_detail", f"""{_WITH} SELECT id, title, provider, model, system_prompt, created_at, updated_at, 0::BIGINT AS page,
  (SELECT string_agg(m.role || '|' || m.status || '|' || m.content, chr(10) ORDER BY m.created_at, m.id) FROM msg m WHERE m.conversation_id = c.id) AS messages FROM conv c""")
def _(spark, sf):
    detail = C.conversation_detail(*_both(spark, sf))
    lines = F.transform("messages", lambda m: F.concat_ws("|", m["role"], m["status"], m["content"]))
    return detail.withColumn("messages", F.array_join(lines, "\n"))


@query("i5_recent_messages", f"""{_WITH} SELECT conversation_id, role, content, created_at, id FROM
  (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY created_at DESC, id DESC) AS r FROM msg WHERE status <> 'error') WHERE r <= 3""")
def _(spark, sf):
    return C.recent_messages(I.messages(spark, sf), 3)


def _context_sql(limit, names=_WITH, rows="msg"):
    return f"""{names}, win AS (SELECT *, row_number() OVER w - 1 AS position,
  string_agg(role || ': ' || content, chr(10)) OVER (PARTITION BY conversation_id ORDER BY created_at, id ROWS BETWEEN {limit - 1} PRECEDING AND CURRENT ROW) AS turns
  FROM {rows} WHERE status <> 'error' WINDOW w AS (PARTITION BY conversation_id ORDER BY created_at, id))
SELECT win.conversation_id, win.id AS message_id, position, 'system: ' || coalesce(nullif(system_prompt, ''), '{C.SYSTEM_PROMPT}') || chr(10) || turns AS context
FROM win JOIN conv ON conv.id = win.conversation_id WHERE role = 'user'"""


def _contexts(conversations, messages, limit):
    contexts = C.turn_contexts(conversations, messages, limit=limit)
    lines = F.transform("context", lambda m: F.concat_ws(": ", m["role"], m["content"]))
    return contexts.withColumn("context", F.array_join(lines, "\n"))


# A third of all messages moved to one conversation, all at one time.
_HOT = f"""{_WITH}, hot AS (SELECT * REPLACE (
  CASE WHEN md5(id) < '5555' THEN (SELECT min(id) FROM conv) ELSE conversation_id END AS conversation_id,
  CASE WHEN md5(id) < '5555' THEN TIMESTAMP '2024-01-15 00:00:00' ELSE created_at END AS created_at) FROM msg)"""


def _hot(spark, sf):
    conversations, messages = _both(spark, sf)
    first = conversations.agg(F.min("id").alias("_first"))
    moved = F.md5("id") < "5555"
    return conversations, messages.join(F.broadcast(first)).withColumns({
        "conversation_id": F.when(moved, F.col("_first")).otherwise(F.col("conversation_id")),
        "created_at": F.when(moved, F.lit("2024-01-15 00:00:00").cast("timestamp")).otherwise(F.col("created_at")),
    }).drop("_first")


@query("i6_turn_contexts", _context_sql(12))
def _(spark, sf):
    return _contexts(*_both(spark, sf), 12)


@query("i6_short_contexts", _context_sql(3))
def _(spark, sf):
    return _contexts(*_both(spark, sf), 3)


@query("i6_hot_conversation", _context_sql(12, _HOT, "hot"))
def _(spark, sf):
    return _contexts(*_hot(spark, sf), 12)


@query("i4_hot_pages", f"""{_HOT}, placed AS (SELECT *, (row_number() OVER (PARTITION BY conversation_id ORDER BY created_at, id) - 1) // 20 AS page FROM hot)
SELECT conversation_id AS id, page::BIGINT AS page, string_agg(id, ',' ORDER BY created_at, id) AS messages FROM placed GROUP BY ALL
UNION ALL SELECT id, 0, '' FROM conv WHERE id NOT IN (SELECT conversation_id FROM hot)""")
def _(spark, sf):
    detail = C.conversation_detail(*_hot(spark, sf), page_rows=20)
    return detail.select("id", "page", F.array_join(F.transform("messages", lambda m: m["id"]), ",").alias("messages"))


@query("i6_context_usage", rf"""{_WITH}, sized AS (SELECT *, greatest(len(regexp_extract_all(content, '\S+')), 1) AS words FROM msg WHERE status <> 'error'),
win AS (SELECT *, sum(words) OVER (PARTITION BY conversation_id ORDER BY created_at, id ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS total FROM sized)
SELECT win.id AS message_id, (total + len(regexp_extract_all(coalesce(nullif(system_prompt, ''), '{C.SYSTEM_PROMPT}'), '\S+')))::BIGINT AS prompt_tokens
FROM win JOIN conv ON conv.id = win.conversation_id WHERE role = 'user'""")
def _(spark, sf):
    contexts = C.turn_contexts(*_both(spark, sf))
    usage = context_usage(F.col("context"), F.lit("ok"))
    return contexts.select("message_id", usage["prompt_tokens"].alias("prompt_tokens"))


@query("i7_titles", f"""{_WITH} SELECT id, coalesce(title, (SELECT substr(arg_min(content, (m.created_at, m.id)), 1, 60) FROM msg m WHERE m.conversation_id = c.id AND role = 'user')) AS title FROM conv c""")
def _(spark, sf):
    return C.with_titles(*_both(spark, sf)).select("id", "title")


@query("i8_touch", f"""{_TURNS} SELECT id, greatest(updated_at, (SELECT max(ended_at) FROM turn t WHERE t.conversation_id = c.id)) AS updated_at FROM conv c""")
def _(spark, sf):
    _, ends = I.turns(spark, sf)
    return C.touch(I.conversations(spark, sf), ends).select("id", "updated_at")


@query("i9_stored_turns", f"""{_TURNS} SELECT conversation_id, 'assistant' AS role, text AS content, outcome AS status, request_id, prompt_tokens, completion_tokens,
  ended_at AS created_at FROM turn WHERE text <> '' OR outcome = 'complete'""")
def _(spark, sf):
    return C.assistant_messages(C.fold_turns(*I.turns(spark, sf)))


@query("i10_turn_outcomes", f"{_TURNS} SELECT request_id, text, outcome, prompt_tokens, completion_tokens FROM turn")
def _(spark, sf):
    folded = C.fold_turns(*I.turns(spark, sf))
    return folded.select("request_id", "text", "outcome", "prompt_tokens", "completion_tokens")


@query("i11_delete", f"""{_WITH}, gone AS (SELECT DISTINCT conversation_id AS id FROM msg WHERE status = 'error')
SELECT 'conversation' AS kind, id FROM conv WHERE id NOT IN (FROM gone)
UNION ALL SELECT 'message', id FROM msg WHERE conversation_id NOT IN (FROM gone)
UNION ALL SELECT 'log', printf('00000000-0000-4000-8000-%012x', event_id) FROM events""")
def _(spark, sf):
    conversations, messages = _both(spark, sf)
    left, kept = C.delete_conversations(conversations, messages, _failed(messages))
    logs = I.raw_logs(spark, sf)
    return (
        left.select(F.lit("conversation").alias("kind"), "id")
        .unionByName(kept.select(F.lit("message").alias("kind"), "id"))
        .unionByName(logs.select(F.lit("log").alias("kind"), F.col("request_id").alias("id")))
    )


@query("i12_error_display", r"""SELECT doc_id, coalesce(nullif(substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 240), ''), 'unknown error') AS reason FROM documents""")
def _(spark, sf):
    return I.table(spark, sf, "documents").select("doc_id", display_error(F.col("text")).alias("reason"))
