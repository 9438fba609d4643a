"""Streamed replies: chunks of any number and size, cut into lines and folded.

A reply is dealt out in blocks of consecutive chunks, bounded by count and bytes, and
a block is cut at its newlines. Lines that cross blocks leave one piece in each; these
few are numbered and put together in a second step. Lines are then ordinary rows, and what a reply says
is an aggregate over them, so no task holds a reply.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.settle import settle
from ..functions.text import lstrip, rstrip

#: Consecutive chunks whose texts one row holds on the way to a whole reply.
BLOCK_CHUNKS = 4096

#: Bytes of chunks after which a block that is cut into lines goes on in another row.
BLOCK_BYTES = 1 << 20


def _tasks(frame: DataFrame) -> int:
    return max(1, int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def chunk_blocks(chunks: DataFrame, keys: Sequence[str] = ("request_id",)) -> DataFrame:
    """Consecutive chunks of a reply as one text: keys, ``_block``, ``_part``, ``_text``, ``_ends``.

    A row holds at most ``BLOCK_CHUNKS`` chunks and, but for its last one, fewer than
    ``BLOCK_BYTES`` bytes. ``_text`` has one character per byte, since chunk borders fall
    inside characters; ``_ends`` has ``seq`` and ``at`` of the chunk of each newline.
    Blocks are dealt out over as many tasks as ``spark.sql.shuffle.partitions`` says:
    merged to a size in compressed bytes, a task would sort many times that.
    """
    block = F.floor(F.col("seq") / BLOCK_CHUNKS).alias("_block")
    dealt = chunks.select(*keys, block, "seq", "at", F.coalesce("bytes", F.lit(b"")).alias("bytes")).repartition(_tasks(chunks), *keys, "_block")
    before = Window.partitionBy(*keys, "_block").orderBy("seq", "at", "bytes").rowsBetween(Window.unboundedPreceding, -1)
    sized = dealt.withColumn("_part", F.floor(F.coalesce(F.sum(F.octet_length("bytes")).over(before), F.lit(0)) / BLOCK_BYTES))
    text = F.decode("bytes", "ISO-8859-1")
    newlines = F.octet_length("bytes") - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    # Made before they are collected, or an aggregate would interpret them.
    items = sized.select(*keys, "_block", "_part", F.struct("seq", "at", text.alias("text"), newlines.alias("n")).alias("_chunk"))
    rows = items.groupBy(*keys, "_block", "_part").agg(F.sort_array(F.collect_list("_chunk")).alias("_chunks"))
    ending = F.filter("_chunks", lambda c: c["n"] > 0)
    return rows.select(
        *keys, "_block", "_part", F.array_join(F.transform("_chunks", lambda c: c["text"]), "").alias("_text"),
        F.flatten(F.transform(ending, lambda c: F.array_repeat(F.struct(c["seq"].alias("seq"), c["at"].alias("at")), c["n"]))).alias("_ends"),
    )


def cut_blocks(blocks: DataFrame) -> DataFrame:
    """Lines and pieces of lines of :func:`chunk_blocks`: its keys, ``index``, ``line``, ``_end``.

    ``_end`` is null for what follows a block's last newline.
    """
    keys = [c for c in blocks.columns if c not in ("_text", "_ends")]
    lines = F.arrays_zip(F.split("_text", "\n", -1).alias("line"), F.col("_ends").alias("_end"))
    cut = blocks.select(*keys, F.posexplode(lines).alias("index", "_cut"))
    return cut.select(*keys, F.col("index").cast("long").alias("index"), "_cut.line", "_cut._end")


def is_whole() -> Column:
    """Of :func:`cut_blocks`, the lines that cannot cross blocks: the first may have
    begun and the last may end in another one."""
    return F.col("_end").isNotNull() & (F.col("index") > 0)


def crossing_lines(borders: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The complete lines among pieces of :func:`cut_blocks` that are not whole: keys,
    ``seq``, ``at``, ``index``, ``line``. A reply's first complete line is one of them.
    """
    ended = F.col("_end").isNotNull()
    earlier = Window.partitionBy(*keys).orderBy("_block", "_part", "index").rowsBetween(Window.unboundedPreceding, -1)
    numbered = borders.withColumn("_line", F.coalesce(F.sum(ended.cast("int")).over(earlier), F.lit(0)))
    # As many pieces in a row as one line has.
    item = F.when(F.col("line") != "", F.struct("_block", "_part", "line"))
    joined = numbered.groupBy(*keys, "_line").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda p: p["line"]), "").alias("line"), F.max("_end").alias("_end")
    )
    return joined.filter(ended).select(*keys, "_end.seq", "_end.at", F.lit(0).cast("long").alias("index"), "line")


def stream_lines(chunks: DataFrame, keys: Sequence[str] = ("request_id",)) -> DataFrame:
    """The complete lines of every reply: keys, ``seq``, ``at``, ``index``, ``line``.

    ``seq`` and ``at`` are those of the chunk that ended the line, ``index`` orders
    the lines of a chunk, and ``line`` has one character per byte. What follows the
    last newline is no line.
    """
    cut = cut_blocks(chunk_blocks(chunks, keys))
    whole = cut.filter(is_whole()).select(*keys, "_end.seq", "_end.at", "index", "line")
    return whole.unionByName(crossing_lines(cut.filter(~is_whole()), keys))


def _blocks(texts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Texts (``seq, index, text``) joined in order, one row per block of chunks."""
    item = F.struct("seq", "index", "text")
    rows = texts.filter(F.col("text") != "").groupBy(*keys, F.floor(F.col("seq") / BLOCK_CHUNKS).alias("_block"))
    joined = rows.agg(F.sort_array(F.collect_list(item)).alias("_items"))
    return joined.select(*keys, "_block", F.array_join(F.transform("_items", lambda i: i["text"]), "").alias("_text"))


def whole_text(texts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys and ``whole``: all texts of a key in order, as one value.

    Joined block by block, so a row holds text and not a list of its pieces.
    """
    blocks = _blocks(texts, keys).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_block", "_text"))).alias("_all"))
    return blocks.select(*keys, F.array_join(F.transform("_all", lambda b: b["_text"]), "").alias("whole"))


def text_preview(texts: DataFrame, keys: Sequence[str], limit: int = 280) -> DataFrame:
    """Keys and ``preview``: the stripped text of a key cut to ``limit`` characters.

    Equal to ``preview`` of the whole text, without it: of every block only its
    first characters and where its visible text begins and ends are kept.
    """
    led = settle(_blocks(texts, keys).withColumns({"_led": lstrip(F.col("_text")), "_ended": rstrip(F.col("_text"))}), ["_led", "_ended"])
    block = F.struct(
        "_block", F.length("_text").alias("size"), (F.length("_text") - F.length("_led")).alias("lead"), F.length("_ended").alias("end"),
        F.substring("_text", 1, limit).alias("head"), F.substring("_led", 1, limit).alias("led"),
    )
    all_ = led.groupBy(*keys).agg(F.sort_array(F.collect_list(block)).alias("_all"))

    def step(now: Column, b: Column) -> Column:
        seen, blank = now["size"].isNotNull(), b["end"] == 0
        # ``stop`` is where the last visible character of what was seen ends.
        begun = F.struct(b["led"].alias("text"), (b["size"] - b["lead"]).cast("long").alias("size"), (b["end"] - b["lead"]).cast("long").alias("stop"))
        longer = F.struct(
            F.substring(F.concat(now["text"], b["head"]), 1, limit).alias("text"), (now["size"] + b["size"]).alias("size"),
            F.when(blank, now["stop"]).otherwise(now["size"] + b["end"]).alias("stop"),
        )
        return F.when(seen, longer).when(blank, now).otherwise(begun)

    none = F.struct(F.lit("").alias("text"), F.lit(None).cast("long").alias("size"), F.lit(None).cast("long").alias("stop"))
    folded = F.aggregate("_all", none, step, lambda s: F.substring(s["text"], F.lit(1), F.least(s["stop"], F.lit(limit)).cast("int")))
    return all_.select(*keys, F.nullif(folded, F.lit("")).alias("preview"))


def fold_lines(said: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counters, end marker and first text of every reply, from what its lines say.

    ``said`` has ``seq, index, at, text, usage, prompt, completion, closes, done`` per
    line. A ``usage`` stands for all counters, and the last one counts. Otherwise
    the last prompt and completion counters count, and their total is taken at the
    last line that ``closes``.
    """
    place = F.struct("seq", "index")

    def last(name: str) -> Column:
        return F.max_by(name, F.when(F.col(name).isNotNull(), place)).alias(name)

    main = said.groupBy(*keys).agg(
        last("usage"), last("prompt"), last("completion"), F.bool_or("done").alias("completed"),
        F.min_by("at", F.when(F.col("text") != "", place)).alias("first_text_at"),
    )
    # Lines with counters only, of which a reply has few.
    counted = said.filter(F.col("prompt").isNotNull() | F.col("completion").isNotNull() | F.col("closes"))
    running = Window.partitionBy(*keys).orderBy("seq", "index")
    sums = counted.withColumn("_sum", F.last("prompt", True).over(running) + F.last("completion", True).over(running))
    totals = sums.groupBy(*keys).agg(F.max_by("_sum", F.when(F.col("closes") & F.col("_sum").isNotNull(), place)).alias("_total"))
    given = F.col("usage").isNotNull()
    return main.join(totals, list(keys), "left").select(
        *keys,
        F.when(given, F.col("usage.prompt")).otherwise(F.col("prompt")).alias("prompt_tokens"),
        F.when(given, F.col("usage.completion")).otherwise(F.col("completion")).alias("completion_tokens"),
        F.when(given, F.col("usage.total")).otherwise(F.col("_total")).alias("total_tokens"),
        "completed", "first_text_at",
    )
