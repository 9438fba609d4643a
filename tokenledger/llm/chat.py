"""Reply trees as chat conversations.

Messages point to the message they answer. Iterative self-joins double the
distance each message looks up its tree, in a logarithmic number of rounds; a
message that has no ancestor that far leaves. Leaves climb these jumps to their
roots, which gives depths and path scores. The best leaves of a tree are chosen by
score, their paths are listed with the same jumps, and each path becomes one
conversation in a template whose control strings are escaped in texts.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import released, settled

START, END = "<|im_start|>", "<|im_end|>"


def escaped(text: Column) -> Column:
    """Text without control strings: ``\\`` becomes ``\\\\`` and ``<|`` becomes ``<\\|``."""
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: str) -> str:
    """The inverse of ``escaped``, also where a new line was written as ``\\n``."""
    if "\\" not in text:
        return text
    return "\\".join(part.replace("\\|", "|").replace("\\n", "\n") for part in text.split("\\\\"))


def numbered(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Linear conversations as reply trees: every turn answers the one before it.

    Returns ``tree, node, parent, role, text``. Rows are ordered by turn, ties by
    role and text; a null conversation is one of its own. A row's number is its
    place in a global sort, so a conversation of any length spreads over tasks.
    """
    rows = messages.select(
        F.col(f"`{conversation}`").alias("tree"), F.col(f"`{turn}`").alias("turn"), F.col(f"`{role}`").alias("role"), F.col(f"`{text}`").alias("text")
    )
    # The number holds the partition in its high bits and grows along the sort; it is written once, then fixed.
    sorted_ = settled(rows.orderBy("tree", "turn", "role", "text").withColumn("_at", F.monotonically_increasing_id()), "turns")
    place = F.shiftright("_at", 33).alias("_part")
    counts = sorted_.groupBy(place).agg(F.count("*").alias("n")).collect()  # one row per partition
    starts, total = {}, 0
    for r in sorted(counts, key=lambda r: r["_part"]):
        starts[r["_part"]], total = total, total + r["n"]
    base = F.create_map(*[F.lit(x) for pair in starts.items() for x in pair])[F.shiftright("_at", 33)] if starts else F.lit(0).cast("long")
    nodes = sorted_.withColumn("node", base + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    before = nodes.select((F.col("node") + 1).alias("node"), F.col("tree").alias("_tree"), F.col("node").alias("_before"))
    return nodes.join(before, "node", "left").select(
        "tree", "node", F.when(F.col("tree").eqNullSafe(F.col("_tree")), F.col("_before")).alias("parent"), "role", "text"
    )


def paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """Messages of the best ``branches`` root-to-leaf paths of every tree.

    ``nodes`` has ``tree, node, parent`` and may have ``score`` (null: 0). Returns
    ``tree, rank, leaf, place, node`` with places from 0 at the root. Leaves rank
    by the sum of scores on their path, then by depth, then by smallest id. A
    missing parent makes a root; messages on a cycle or behind one have no root
    and no path. Node ids must be unique.
    """
    score = F.coalesce(F.col("score").cast("double"), F.lit(0.0)) if "score" in nodes.columns else F.lit(0.0)
    own = nodes.select("tree", "node", "parent", score.alias("score"))
    known = own.select(F.col("node").alias("parent"), F.lit(True).alias("_known"))
    linked = settled(own.join(known, "parent", "left").select("tree", "node", F.when(F.col("_known"), F.col("parent")).alias("up"), "score"), "nodes")
    # Level k ties a message to the one 2**k above it; messages less deep have left.
    levels, n = [settled(linked.filter("up is not null").select("node", "up", F.col("score").alias("part")), "jump")], linked.count()
    while (1 << len(levels)) < n:  # more steps than messages: what is left is tied to a cycle
        last = levels[-1]
        above = last.select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("part").alias("_part"))
        far = settled(last.join(above, "up").select("node", F.col("_up").alias("up"), (F.col("part") + F.col("_part")).alias("part")), "jump")
        if far.isEmpty():
            released(far)
            break
        levels.append(far)
    # Leaves climb to their roots by the longest jumps first.
    parents = levels[0].select(F.col("up").alias("node")).distinct()
    leaf = linked.join(parents, "node", "left_anti").select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("place"), F.lit(0.0).alias("total"))
    for k, level in reversed(list(enumerate(levels))):
        jumped = F.col("up").isNotNull()
        leaf = leaf.join(level, "node", "left").select(
            "tree", "leaf", F.coalesce("up", "node").alias("node"), (F.col("place") + F.when(jumped, F.lit(1 << k)).otherwise(0)).alias("place"), (F.col("total") + F.coalesce("part", F.lit(0.0))).alias("total")
        )
    roots = linked.filter("up is null").select("node", "score")
    w = Window.partitionBy("tree").orderBy(F.desc("total"), F.desc("place"), "leaf")
    ranked = leaf.join(roots, "node").withColumn("total", F.col("total") + F.col("score")).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= branches)
    chosen = settled(ranked.select("tree", "rank", "leaf", "place", F.col("leaf").alias("node")), "paths")
    for k, level in enumerate(levels):  # a path's rows are written once, and only those deep enough are looked at again
        above = chosen.filter(F.col("place") >= (1 << k)).join(level.select("node", "up"), "node").select(
            "tree", "rank", "leaf", (F.col("place") - F.lit(1 << k)).alias("place"), F.col("up").alias("node")
        )
        chosen = chosen.unionByName(settled(above, "paths"))
    released(linked, *levels)
    return chosen


def formatted(path: DataFrame, nodes: DataFrame, learn: str = "assistant") -> DataFrame:
    """One row per path: ``tree, rank, text, loss``.

    ``text`` is the whole conversation, each turn as ``<|im_start|>role``, a new
    line, the escaped text, ``<|im_end|>`` and a new line. ``loss`` lists the spans
    (start, end in code points) of the texts of role ``learn``. A null role or text
    is empty. New lines in roles are escaped as ``\\n``.
    """
    role = F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("\\n"))
    said = nodes.select("node", role.alias("_role"), escaped(F.col("text")).alias("_text"), F.coalesce(F.col("role") == learn, F.lit(False)).alias("_learn"))
    turns = path.join(said, "node").select(
        "tree", "rank", "leaf", "place", F.concat(F.lit(START), "_role", F.lit("\n")).alias("head"), F.col("_text").alias("body"), F.col("_learn").alias("learn")
    )
    kind = turns.schema["tree"].dataType.simpleString()
    # Sorted within tasks, so a task holds one conversation at a time however many it gets.
    dealt = turns.repartition("leaf").sortWithinPartitions("leaf", "place")

    def work(batches):
        leaf = tree = rank = None
        pieces: list[str] = []
        spans: list[dict] = []
        length = 0

        def row():
            return pa.RecordBatch.from_pydict(
                {"tree": pa.array([tree], kind_pa), "rank": pa.array([rank], pa.int32()), "text": pa.array(["".join(pieces)], pa.string()), "loss": pa.array([spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))}
            )

        kind_pa = None
        for batch in batches:
            kind_pa = batch.schema.field("tree").type
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for t, r, lf, _, head, body, learned in zip(*columns):
                if lf != leaf:
                    if leaf is not None:
                        yield row()
                    leaf, tree, rank, pieces, spans, length = lf, t, r, [], [], 0
                if learned:
                    spans.append({"start": length + len(head), "end": length + len(head) + len(body)})
                pieces += (head, body, END, "\n")
                length += len(head) + len(body) + len(END) + 1
        if leaf is not None:
            yield row()

    return dealt.mapInArrow(work, f"tree {kind}, rank int, text string, loss array<struct<start:long,end:long>>")


def read_back(text: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    turns = []
    for block in text.split(START)[1:]:
        head, _, body = block.partition("\n")
        turns.append((unescape(head), unescape(body[: -len(END) - 1])))
    return turns


def digests(conversations: DataFrame) -> DataFrame:
    """What a formatted conversation holds, read from its text and loss spans."""
    kind = conversations.schema["tree"].dataType.simpleString()

    def work(batches):
        for batch in batches:
            out = {"conv_id": [], "n_turns": [], "turns_sha256": [], "loss_chars": [], "loss_sha256": [], "formatted_chars": []}
            for tree, text, loss in zip(batch.column("tree").to_pylist(), batch.column("text").to_pylist(), batch.column("loss").to_pylist()):
                turns, said, learned, chars = hashlib.sha256(), read_back(text), hashlib.sha256(), 0
                for role, body in said:
                    turns.update(f"{role}\n{body}\n".encode())
                for span in loss:
                    part = unescape(text[span["start"] : span["end"]])
                    chars += len(part)
                    learned.update(part.encode())
                for name, value in zip(out, (tree, len(said), turns.hexdigest(), chars, learned.hexdigest(), len(text))):
                    out[name].append(value)
            types = [batch.schema.field("tree").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], names=list(out))

    return conversations.mapInArrow(
        work, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|im_start|>') + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n')) + 1
    + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
FROM said GROUP BY conv_id
"""
