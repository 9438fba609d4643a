"""A corpus through five stages: toxicity, near-duplicates, repeated strings,
benchmark items, and mixing.

Each stage is ``function(spark, docs, sf_dir) -> DataFrame``; ``docs`` is what the
stage before kept, written and read again. All but the last return the columns
of ``documents``; the last adds ``copy`` and ``order_key``. Near-duplicates and
benchmark items go by five-word shingles and a share of 0.8.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenledger.llm import decontamination, mixing, neardup, suffixes, toxicity
from tokenledger.llm.queries import labelled, table
from tokenledger.llm.scratch import prepare, settled, unused

_BROADCAST_ROWS = 1_000_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below one half.

    Learned from all labelled documents of the input table, whatever ``docs`` holds.
    """
    model = toxicity.train(labelled(spark, sf_dir, "toxic"))
    mark = unused(docs.columns, "toxicity")
    return toxicity.score(docs, model, keep=docs.columns, into=mark).filter(F.col(mark) < 0.5).drop(mark)


def _small(rows: DataFrame) -> DataFrame:
    """``rows``, broadcast if a count allows it."""
    return F.broadcast(rows) if rows.count() <= _BROADCAST_ROWS else rows


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id.

    Rows are told by id and text, so rows that share an id, or have none, are
    judged each by its own text. Of rows that repeat an id within a group, one
    stays: the one whose text has the smallest hash. Rows without words stay all.
    """
    placed = settled(neardup.groups(docs), "groups")
    tag = F.xxhash64(docs["text"])
    own = lambda rows: docs["doc_id"].eqNullSafe(rows["id"]) & (tag == rows["tag"])
    gone = settled(placed.filter(~F.col("kept")).select("id", "tag").distinct(), "dropped")
    out = docs.join(_small(gone), own(gone), "left_anti")
    # Ids that several kept rows of a group bear.
    kept = placed.filter("kept and n_shingles > 0")
    twice = settled(kept.groupBy("component", "id").count().filter("count > 1").select("component", F.col("id").alias("_id")), "repeated-ids")
    if not twice.limit(1).count():
        return out
    repeats = (kept["component"] == twice["component"]) & kept["id"].eqNullSafe(twice["_id"])
    again = settled(kept.join(_small(twice), repeats, "left_semi").select("id", "tag", "component").distinct(), "repeated-rows")
    names = [unused(docs.columns, f"_{n}") for n in ("component", "tag", "rest", "rank")]
    component, text, rest, rank = names
    marks = [F.col("component").alias(component), F.col("tag").alias(text), F.xxhash64(F.to_json(F.struct(*[docs[c] for c in docs.columns]))).alias(rest)]
    rows = docs.join(_small(again), own(again)).select(*[docs[c] for c in docs.columns], *marks)
    first = Window.partitionBy(component, "doc_id").orderBy(text, rest)
    once = rows.withColumn(rank, F.row_number().over(first)).filter(F.col(rank) == 1).drop(*names)
    return out.join(_small(again), own(again), "left_anti").unionByName(once)


def drop_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated strings of 200 bytes; no character is cut in two.

    ``n_chars`` is that of the text that stays. A null text stays null.
    """
    text = F.when(F.col("text").isNotNull(), F.decode("kept", "UTF-8"))
    cut = suffixes.dedup(docs.select(*[F.col(f"`{c}`").alias(f"d{i}") for i, c in enumerate(docs.columns)], "text"), characters=True).withColumn("text", text)
    chars = F.length("text").cast(docs.schema["n_chars"].dataType)
    made = {"text": F.col("text"), "n_chars": F.coalesce(chars, f"d{docs.columns.index('n_chars')}")}
    return cut.select(*[made.get(c, F.col(f"d{i}")).alias(c) for i, c in enumerate(docs.columns)])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    out, mark = docs, unused(docs.columns, "found")
    for ix in decontamination.blocks(table(spark, sf_dir, "benchmark")):
        out = decontamination.matches(out, ix, docs.columns, into=mark).filter(F.size(mark) == 0).drop(mark)
    return out.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents replicated to square-root source weights and shuffled."""
    return mixing.mix(docs, mixing.rates(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_strings", drop_repeated_strings),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: SQL has no equivalent of the learned toxicity model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``, each written before the next reads it."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
