"""Mix sources to target weights by Poisson replication.

Every source has a target repetition rate. A document's number of copies is the
inverse of the Poisson distribution of that rate at a number hashed from its id
and a seed, so a lost task that runs again decides alike. Copies are then dealt
out and ordered by a hash of their own, which is a uniform global shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import settled

_PART = 256.0  # a larger rate is a sum of independent counts of at most this rate
_BROADCAST_ROWS = 10_000  # of about 5 kB each


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the MD5 of the parts joined by ``|``."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def rates(docs: DataFrame, source: str = "source", text: str = "text", weights: DataFrame | None = None, alpha: float = 0.5, epochs: float = 1.0) -> DataFrame:
    """One row per source: ``source, size, rate``.

    A document's size is its UTF-8 bytes plus one; a null source is a source of
    its own. ``weights`` (source, weight) gives the targets; a source that it does
    not name gets none. Without it a source weighs its size to the power
    ``alpha``. The mix is ``epochs`` times as large as the input.
    """
    sizes = docs.groupBy(F.col(f"`{source}`").alias("source")).agg(
        F.sum(F.octet_length(F.coalesce(F.col(f"`{text}`"), F.lit(""))) + F.lit(1)).cast("double").alias("size")
    )
    if weights is None:
        weighed = sizes.withColumn("weight", F.pow("size", F.lit(alpha)))
    else:
        given = weights.groupBy(F.col("source").alias("_of")).agg(F.sum("weight").alias("weight"))
        weighed = sizes.join(given, sizes["source"].eqNullSafe(given["_of"]), "left").drop("_of").fillna(0.0, ["weight"])
    weighed = settled(weighed, "source-weights")
    total = weighed.agg(F.sum("size").alias("size"), F.sum("weight").alias("weight")).first()
    share = F.col("weight") / F.lit(total["weight"]) if total["weight"] else F.lit(0.0)
    return weighed.select("source", "size", (share * F.lit((total["size"] or 0.0) * epochs) / F.col("size")).alias("rate"))


def _with_cdf(rated: DataFrame) -> DataFrame:
    """Adds the number of parts and the distribution function of one part."""
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / _PART)).cast("int")
    frame = rated.withColumn("parts", parts).withColumn("_rate", F.col("rate") / F.col("parts"))
    last = F.ceil(F.col("_rate") + 12 * F.sqrt("_rate") + 40).cast("int")
    start = F.struct(F.exp(-F.col("_rate")).alias("p"), F.exp(-F.col("_rate")).alias("sum"), F.array(F.exp(-F.col("_rate"))).alias("cdf"))

    def add(state, j):
        p = state["p"] * F.col("_rate") / j
        return F.struct(p.alias("p"), (state["sum"] + p).alias("sum"), F.concat(state["cdf"], F.array(state["sum"] + p)).alias("cdf"))

    return frame.withColumn("cdf", F.aggregate(F.sequence(F.lit(1), last), start, add, lambda s: s["cdf"])).drop("_rate")


def mix(docs: DataFrame, rated: DataFrame, seed: int = 17, id: str = "doc_id", source: str = "source") -> DataFrame:
    """Every document as often as its source's rate asks, globally shuffled.

    Adds ``copy`` (from 1) and ``order_key`` to the columns of ``docs``, in place of
    columns of these names; the rows
    of each partition are in the order of ``order_key`` and a row's partition is
    a hash of it. Rows with one id draw the same count; a null id counts as
    empty text. Empty input gives an empty result.
    """
    # Written first, so that its size is known before anything depends on it. Sources have no bound: beyond it both sides are shuffled, and a hot source is split by the adaptive skew join.
    table = settled(_with_cdf(rated).select(F.col("source").alias("_of"), F.col("parts").alias("_parts"), F.col("cdf").alias("_cdf")), "rates")
    if table.count() <= _BROADCAST_ROWS:
        table = F.broadcast(table)
    copies = F.aggregate(
        F.sequence(F.lit(1), F.col("_parts")), F.lit(0),
        lambda n, part: n + F.size(F.filter("_cdf", lambda c: c <= uniform(F.lit(seed), F.col(f"`{id}`"), part))),
    )
    drawn = docs.join(table, docs[f"`{source}`"].eqNullSafe(table["_of"])).withColumn("_n", copies).filter("_n > 0")
    spread = drawn.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_of", "_parts", "_cdf", "_n")
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(f"`{id}`").cast("string"), F.lit("")), F.col("copy").cast("string"), F.lit("order")))
    return spread.withColumn("order_key", key).repartition("order_key").sortWithinPartitions("order_key")


SQL = """
WITH size AS (
  SELECT source, sum(strlen(coalesce(text, '')) + 1)::DOUBLE AS size FROM documents GROUP BY source
), rate AS (
  SELECT source, sqrt(size) / sum(sqrt(size)) OVER () * sum(size) OVER () / size AS rate FROM size
), part AS (
  SELECT source, greatest(1, ceil(rate / 256))::INT AS parts, rate / greatest(1, ceil(rate / 256)) AS r FROM rate
), term AS (
  SELECT source, parts, j, exp(j * ln(r) - r - lgamma(j + 1)) AS p
  FROM part, unnest(range(0, (ceil(r + 12 * sqrt(r) + 40))::INT + 1)) AS t(j)
), cdf AS (
  SELECT source, parts, j, sum(p) OVER (PARTITION BY source ORDER BY j) AS c FROM term
), drawn AS (
  SELECT d.doc_id, d.source, i, ('0x' || substr(md5('17|' || coalesce(d.doc_id::VARCHAR, '') || '|' || i), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
  FROM documents d JOIN part ON d.source IS NOT DISTINCT FROM part.source, unnest(range(1, part.parts + 1)) AS t(i)
), counted AS (
  SELECT doc_id, drawn.source, count(*) FILTER (WHERE c <= u) AS n
  FROM drawn JOIN cdf ON drawn.source IS NOT DISTINCT FROM cdf.source GROUP BY doc_id, drawn.source
)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, k::INT AS copy,
  md5('17|' || coalesce(d.doc_id::VARCHAR, '') || '|' || k || '|order') AS order_key
FROM documents d JOIN counted c ON d.doc_id = c.doc_id AND d.source IS NOT DISTINCT FROM c.source, unnest(range(1, c.n + 1)) AS t(k)
"""
