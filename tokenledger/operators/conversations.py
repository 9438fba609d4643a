"""Conversation reads and the states a chat turn goes through."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.enrich import context_usage
from .ordering import over_last_rows, with_position
from .streams import whole_text

# Context length in messages and title length.
CONTEXT_MESSAGES = 12
TITLE_CHARS = 60

#: The instruction a context begins with unless the caller gives one.
SYSTEM_PROMPT = "Answer helpfully and keep it short."

_EARLY_LIMIT = 1000  # limits that Spark applies before a shuffle by default
_PARTS = 64  # parts of a conversation that are sorted on their own

MESSAGE_COLUMNS = (
    "id", "role", "content", "status", "request_id", "prompt_tokens",
    "completion_tokens", "created_at",
)


def _latest() -> Column:
    return F.struct("created_at", "id")


def list_conversations(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Conversations with message count and latest message, last updated first.

    Messages are reduced to one row per conversation before the join.
    """
    per_conversation = messages.groupBy("conversation_id").agg(
        F.count(F.lit(1)).alias("_count"),
        F.max_by("content", _latest()).alias("last_message"),
    )
    return (
        conversations.join(
            per_conversation, F.col("id") == F.col("conversation_id"), "left"
        )
        .select(
            "id", "title", "provider", "model", "created_at", "updated_at",
            F.coalesce("_count", F.lit(0)).alias("message_count"), "last_message",
        )
        .orderBy(F.desc("updated_at"), "id")
    )


def get_conversation(conversations: DataFrame, conversation_id: str) -> DataFrame:
    return conversations.filter(F.col("id") == conversation_id)


def get_conversations(conversations: DataFrame, ids: DataFrame) -> DataFrame:
    """Many lookups at once; ``ids`` has a ``conversation_id`` column."""
    return conversations.join(
        ids, F.col("id") == F.col("conversation_id"), "left_semi"
    )


def history(messages: DataFrame, conversation_id: str | None = None) -> DataFrame:
    """Messages in order, of one conversation or of all of them."""
    if conversation_id is not None:
        messages = messages.filter(F.col("conversation_id") == conversation_id)
    return messages.select("conversation_id", *MESSAGE_COLUMNS).orderBy(
        "conversation_id", "created_at", "id"
    )


def conversation_detail(
    conversations: DataFrame, messages: DataFrame, page_rows: int = 1000
) -> DataFrame:
    """Conversations with their ordered messages as a nested array.

    Longer conversations continue on further pages of ``page_rows`` messages, so
    no array grows without bound; ``page`` counts from 0. A conversation without
    messages has one page with an empty array.
    """
    placed = with_position(messages, ["conversation_id"], "created_at", ["id"])
    item = F.struct("position", *MESSAGE_COLUMNS)
    pages = placed.groupBy(
        "conversation_id", F.floor(F.col("position") / page_rows).alias("page")
    ).agg(F.array_sort(F.collect_list(item)).alias("_items"))
    bare = F.transform(
        "_items", lambda m: F.struct(*[m[c].alias(c) for c in MESSAGE_COLUMNS])
    )
    joined = conversations.join(
        pages, F.col("id") == F.col("conversation_id"), "left"
    ).drop("conversation_id")
    empty = F.filter(bare, lambda m: F.lit(False))
    return joined.withColumns(
        {
            "page": F.coalesce("page", F.lit(0)),
            "messages": F.coalesce(bare, empty, F.from_json(F.lit("[]"), _MESSAGES_DDL)),
        }
    ).drop("_items")


_MESSAGES_DDL = (
    "array<struct<id:string,role:string,content:string,status:string,"
    "request_id:string,prompt_tokens:int,completion_tokens:int,created_at:timestamp>>"
)


def recent_messages(messages: DataFrame, limit: int = CONTEXT_MESSAGES) -> DataFrame:
    """The last messages of every conversation that are not errors, in order.

    Up to ``_EARLY_LIMIT`` the row-number limit also runs before the shuffle, so a
    conversation sends at most ``limit`` rows per input partition. Above it the
    limit is applied within parts of a conversation first, so a long one is sorted
    in many tasks and the last step sees at most ``limit`` rows per part.
    """
    newest = (F.desc("created_at"), F.desc("id"))
    latest = Window.partitionBy("conversation_id").orderBy(*newest)
    usable = messages.filter(F.col("status") != "error")
    if limit > _EARLY_LIMIT:
        part = Window.partitionBy("conversation_id", F.pmod(F.hash("id"), F.lit(_PARTS))).orderBy(*newest)
        usable = usable.withColumn("_rank", F.row_number().over(part)).filter(F.col("_rank") <= limit)
    return (
        usable
        .withColumn("_rank", F.row_number().over(latest))
        .filter(F.col("_rank") <= limit)
        .select("conversation_id", "role", "content", "created_at", "id")
        .orderBy("conversation_id", "created_at", "id")
    )


def turn_contexts(
    conversations: DataFrame,
    messages: DataFrame,
    limit: int = CONTEXT_MESSAGES,
    default_prompt: str = SYSTEM_PROMPT,
) -> DataFrame:
    """What the model is given at every user turn: the system prompt, then the
    last ``limit`` messages that are not errors, the current one included."""
    usable = messages.filter(F.col("status") != "error").select(
        "id", "conversation_id", "role", "content", "created_at"
    )
    placed = with_position(usable, ["conversation_id"], "created_at", ["id"])
    windows = over_last_rows(
        placed,
        ["conversation_id"],
        "position",
        limit,
        {"_window": lambda: F.collect_list(F.struct("role", "content"))},
    ).filter(F.col("role") == "user")
    prompts = conversations.select(
        F.col("id").alias("conversation_id"),
        # An empty prompt falls back to the default as well.
        F.coalesce(F.nullif("system_prompt", F.lit("")), F.lit(default_prompt)).alias("_prompt"),
    )
    system = F.array(F.struct(F.lit("system").alias("role"), F.col("_prompt").alias("content")))
    return windows.join(prompts, "conversation_id").select(
        "conversation_id",
        F.col("id").alias("message_id"),
        "position",
        F.concat(system, "_window").alias("context"),
    )


def with_usage(turns: DataFrame, context: str = "context", reply: str = "reply") -> DataFrame:
    """Add the word-based token estimate of a context and its reply."""
    return turns.withColumn("_u", context_usage(F.col(context), F.col(reply))).select(
        *turns.columns, "_u.prompt_tokens", "_u.completion_tokens", "_u.total_tokens"
    )


def with_titles(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Missing titles become the first 60 characters of the first user message."""
    first = (
        messages.filter(F.col("role") == "user")
        .groupBy("conversation_id")
        .agg(F.min_by("content", _latest()).alias("_first"))
    )
    return (
        conversations.join(first, F.col("id") == F.col("conversation_id"), "left")
        .withColumn("title", F.coalesce("title", F.substring("_first", 1, TITLE_CHARS)))
        .drop("conversation_id", "_first")
    )


def fold_turns(chunks: DataFrame, turns: DataFrame) -> DataFrame:
    """Outcome of every assistant turn from the pieces that were streamed.

    ``turns`` has ``request_id``, ``conversation_id``, ``ended`` (the stream ran
    to its end), ``exception_message`` and ``ended_at``; ``chunks`` has
    ``request_id``, ``seq``, ``text`` and a nullable ``usage`` struct, of which
    the last one counts. An unfinished turn keeps the text it got so far.
    """
    usage = chunks.groupBy("request_id").agg(F.max_by("usage", F.when(F.col("usage").isNotNull(), F.col("seq"))).alias("usage"))
    pieces = usage.join(whole_text(chunks.select("request_id", "seq", F.lit(0).alias("index"), "text"), ["request_id"]), "request_id", "left")
    outcome = (
        F.when(F.col("exception_message").isNotNull(), F.lit("error"))
        .when(F.col("ended"), F.lit("complete"))
        .otherwise(F.lit("cancelled"))
    )
    return turns.join(pieces, "request_id", "left").select(
        *turns.columns,
        F.coalesce("whole", F.lit("")).alias("text"),
        F.col("usage.prompt_tokens").alias("prompt_tokens"),
        F.col("usage.completion_tokens").alias("completion_tokens"),
        outcome.alias("outcome"),
    )


def assistant_messages(folded: DataFrame) -> DataFrame:
    """Message rows of the turns worth storing: text, or a complete turn."""
    return folded.filter((F.col("text") != "") | (F.col("outcome") == "complete")).select(
        "conversation_id",
        F.lit("assistant").alias("role"),
        F.col("text").alias("content"),
        F.col("outcome").alias("status"),
        "request_id",
        "prompt_tokens",
        "completion_tokens",
        F.col("ended_at").alias("created_at"),
    )


def touch(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """Advance ``updated_at`` to the end of the last turn, stored or not."""
    last = turns.groupBy("conversation_id").agg(F.max("ended_at").alias("_last"))
    return (
        conversations.join(last, F.col("id") == F.col("conversation_id"), "left")
        .withColumn("updated_at", F.greatest("updated_at", "_last"))
        .drop("conversation_id", "_last")
    )


def delete_conversations(
    conversations: DataFrame, messages: DataFrame, ids: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Both tables without the conversations in ``ids`` (``conversation_id``).

    Messages go with their conversation; logs are a separate record and stay.
    """
    return (
        conversations.join(ids, F.col("id") == ids["conversation_id"], "left_anti"),
        messages.join(ids, "conversation_id", "left_anti"),
    )
