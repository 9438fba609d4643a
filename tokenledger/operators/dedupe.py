"""Keep the first event of every request."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_wins(
    events: DataFrame, order: Sequence[str], key: str = "request_id"
) -> DataFrame:
    """One row per ``key``: the first in ``order``, on ties the one whose row hashes lowest.

    ``row_number() = 1`` becomes a group limit that also runs before the
    shuffle, so a key with very many copies sends one row per input partition.
    """
    plain = [c for c, kind in events.dtypes if "map<" not in kind and "variant" not in kind]
    w = Window.partitionBy(key).orderBy(*order, F.xxhash64(*plain))
    return (
        events.withColumn("_rank", F.row_number().over(w))
        .filter(F.col("_rank") == 1)
        .drop("_rank")
    )


# A set of keys of at most this many rows may be broadcast (36-character ids:
# well below 100 MB).
BROADCAST_KEYS = 1_000_000


def unseen(
    events: DataFrame, stored: DataFrame, key: str = "request_id", known_rows: int | None = None
) -> DataFrame:
    """Events whose key is not stored yet.

    ``known_rows`` is the checked size of ``events``. When it is small, its keys
    are broadcast against the stored keys, so the stored table is read once and
    never shuffled; otherwise both sides are shuffled on the key.
    """
    keys = stored.select(key)
    if known_rows is not None and known_rows <= BROADCAST_KEYS:
        keys = keys.join(F.broadcast(events.select(key)), key, "left_semi")
    return events.join(keys, key, "left_anti")


def counted(keys: DataFrame, few: bool) -> DataFrame:
    """The right side of a join: broadcast where its rows are known to be few, else shuffled.

    Left to itself Spark goes by the bytes it expects. Behind maps, variants and
    generators it expects far too few, and so would broadcast any number of keys.
    """
    return F.broadcast(keys) if few else keys.hint("merge")


def hashed_keys(rows: DataFrame, key: str = "request_id") -> DataFrame:
    """``key_hash`` and ``key``: what a key table holds."""
    return rows.select(F.xxhash64(key).alias("key_hash"), key)


def unseen_keys(events: DataFrame, keys: DataFrame, key: str = "request_id", known_rows: int | None = None) -> DataFrame:
    """Events whose key is not in a key table (:func:`hashed_keys`).

    Looks at the hashes alone first, 8 bytes a stored key; only if some are met are
    the keys behind them read, which tells a stored key from a new one with the same
    hash. ``known_rows`` decides as in :func:`unseen` whether hashes are broadcast;
    those met are counted. Runs a job to see whether there are keys at all, and if so
    one that counts the hashes met.
    """
    if not keys.limit(1).count():
        return events
    few = known_rows is not None and known_rows <= BROADCAST_KEYS
    asked = events.select(F.xxhash64(key).alias("key_hash"))
    met = keys.select("key_hash").join(counted(asked, few), "key_hash", "left_semi").distinct().persist()
    found = met.count()
    if not found:
        met.unpersist()
        return events
    stored = keys.join(counted(met, found <= BROADCAST_KEYS), "key_hash", "left_semi").select(key)
    return events.join(counted(stored, found <= BROADCAST_KEYS), key, "left_anti")
