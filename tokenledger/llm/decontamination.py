"""Test items inside documents: size-partitioned MinHash containment search.

Items are partitioned by their number of shingles. For a partition of sizes up to
B, documents are read as overlapping windows of 5/4 B shingles, so that a short
item is compared with passages of its own size and its containment shows as
resemblance. A window whose minimum under any permutation is an item's minimum
makes the item a candidate for the documents the window touches; the candidate
is then decided by exact containment of its shingles in the whole document.
"""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import texts as T
from .scratch import shipped, unused

_GOLD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Index:
    """``sets`` holds each item's distinct shingles; ``parts`` has, for each size
    partition, B, and per permutation the items' sorted minima and their items.
    ``short`` has, for each number of words below ``size``, the sorted shingles of
    the items of so many words and these items: a partition whose window is one
    shingle of its own length."""

    items: list
    sets: list[np.ndarray]
    parts: list[tuple[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]]
    multipliers: np.ndarray
    threshold: float
    size: int
    short: list[tuple[int, np.ndarray, np.ndarray]]


def permutations_for(threshold: float, miss: float) -> int:
    """Permutations needed so that an item that just reaches the threshold in a
    window is missed with at most the chance ``miss``.

    The smallest item of a partition has B / 2 shingles; a window has 5/4 B.
    """
    shared = threshold * 0.5
    return math.ceil(math.log(miss) / math.log(1 - shared / (1.25 + 0.5 - shared)))


def index(items: list, texts: list[str | None], threshold: float = 0.8, size: int = 5, miss: float = 1e-6, short: bool = False) -> Index:
    """Index a block of items; items without words are left out. With ``short``, items of
    fewer than ``size`` words are one shingle of their own length, found anywhere."""
    names, sets = [], []
    by_length: dict[int, list[tuple[np.uint64, int]]] = {}
    for name, text in zip(items, texts):
        data, offsets = T.raw(pa.array([text or ""], pa.large_string()))
        words, _, _, row = T.word_hashes(data, offsets)
        found = np.unique(T.shingles(words, row, 1, size)[0])
        if short and 0 < words.size < size:
            found = T.shingles(words, row, 1, words.size)[0]
            by_length.setdefault(words.size, []).append((found[0], len(names)))
        if found.size:
            names.append(name)
            sets.append(found)
    m = permutations_for(threshold, miss)
    multipliers = T.mix(np.arange(1, m + 1, dtype=np.uint64) * _GOLD) | np.uint64(1)
    classes: dict[int, list[int]] = {}
    own_length = {i for held in by_length.values() for _, i in held}
    for i, s in enumerate(sets):
        if i not in own_length:
            classes.setdefault(1 << (int(s.size).bit_length()), []).append(i)
    parts = []
    for bound, members in sorted(classes.items()):
        tables = []
        for a in multipliers:
            least = np.array([(sets[i] * a).min() for i in members], np.uint64)
            order = np.argsort(least, kind="stable")
            bits = np.zeros(1 << 16, bool)
            bits[_low(least)] = True
            tables.append((least[order], np.array(members)[order], bits))
        parts.append((bound, tables))
    shorter = []
    for length, held in sorted(by_length.items()):
        held.sort()
        shorter.append((length, np.array([h for h, _ in held], np.uint64), np.array([i for _, i in held])))
    return Index(names, sets, parts, multipliers, threshold, size, shorter)


def _low(values: np.ndarray) -> np.ndarray:
    return ((values * _GOLD) >> np.uint64(48)).astype(np.int64)


def _candidates(shingle: np.ndarray, row: np.ndarray, ix: Index) -> set[tuple[int, int]]:
    """Pairs (row, item) of which some window shares a minimum."""
    n = shingle.size
    found: set[tuple[int, int]] = set()
    blocks = sorted({max(1, bound // 4) for bound, _ in ix.parts})
    for p, a in enumerate(ix.multipliers):
        value = shingle * a
        least, width = value, 1
        minima = {}
        for b in blocks:
            step = b // width
            if step > 1:
                pad = -least.size % step
                if pad:
                    least = np.concatenate([least, np.full(pad, np.iinfo(np.uint64).max, np.uint64)])
                least = least.reshape(-1, step).min(1)
                width = b
            minima[b] = least
        for bound, tables in ix.parts:
            b = max(1, bound // 4)
            span = -(-5 * bound // (4 * b))
            low = minima[b]
            window = low.copy()
            for i in range(1, min(span, low.size)):
                np.minimum(window[: low.size - i], low[i:], out=window[: low.size - i])
            values, members, bits = tables[p]
            hit = np.flatnonzero(bits[_low(window)])
            if not hit.size:
                continue
            left, right = np.searchsorted(values, window[hit], "left"), np.searchsorted(values, window[hit], "right")
            for w, lo, hi in zip(hit[left < right].tolist(), left[left < right].tolist(), right[left < right].tolist()):
                first, last = row[w * b], row[min(n, (w + span) * b) - 1]
                for item in members[lo:hi].tolist():
                    for r in range(int(first), int(last) + 1):
                        found.add((r, item))
    return found


def _short(words: np.ndarray, row: np.ndarray, rows: int, ix: Index) -> set[tuple[int, int]]:
    """Pairs (row, item) of short items whose words stand in a row somewhere."""
    found: set[tuple[int, int]] = set()
    for length, held, items in ix.short:
        shingle, where, _ = T.shingles(words, row, rows, length)
        left, right = np.searchsorted(held, shingle, "left"), np.searchsorted(held, shingle, "right")
        for k in np.flatnonzero(left < right):
            found.update((int(where[k]), int(i)) for i in items[left[k] : right[k]])
    return found


def matches(docs: DataFrame, ix: Index, keep: list[str], text: str = "text", into: str = "found") -> DataFrame:
    """The columns ``keep`` of every row and, as ``into``, the items it contains:
    an array of ``item, shared, size`` in the order of the index, short items first."""
    spark = docs.sparkSession
    shared = shipped(spark, ix)
    kind = pa.array(ix.items).type if ix.items else pa.int64()
    searched = unused(keep, "_searched")
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias(searched))
    name = {pa.int64(): "long", pa.string(): "string"}.get(kind, "string")

    def work(batches):
        own = pickle.loads(shared.value)
        item_type = pa.int64() if name == "long" else pa.string()
        struct = pa.list_(pa.struct([("item", item_type), ("shared", pa.int64()), ("size", pa.int64())]))
        for batch in batches:
            for part in T.slices(batch, searched):
                data, offsets = T.raw(part.column(searched))
                count = len(offsets) - 1
                words, _, _, row = T.word_hashes(data, offsets)
                shingle, where, _ = T.shingles(words, row, count, own.size)
                out: list[list[dict]] = [[] for _ in range(count)]
                for r, i in sorted(_short(words, row, count, own)):
                    out[r].append({"item": own.items[i], "shared": 1, "size": 1})
                if shingle.size and own.parts:
                    begin = np.searchsorted(where, np.arange(count + 1))
                    held: tuple[int, np.ndarray | None] = (-1, None)
                    for r, i in sorted(_candidates(shingle, where, own)):
                        if held[0] != r:
                            held = (r, np.unique(shingle[begin[r] : begin[r + 1]]))
                        has = held[1]
                        if not has.size:
                            continue
                        at = np.minimum(np.searchsorted(has, own.sets[i]), has.size - 1)
                        both = int((has[at] == own.sets[i]).sum())
                        if both >= own.threshold * own.sets[i].size - 1e-9:
                            out[r].append({"item": own.items[i], "shared": both, "size": int(own.sets[i].size)})
                yield pa.RecordBatch.from_arrays([part.column(c) for c in range(part.num_columns - 1)] + [pa.array(out, struct)], names=[*keep, into])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(work, f"{fields}, `{into}` array<struct<item:{name},shared:long,size:long>>")


def blocks(items: DataFrame, item: str = "item_id", text: str = "text", block: int = 20_000, threshold: float = 0.8, size: int = 5, short: bool = False):
    """Indexes of all items, ``block`` at a time; together they hold every item.

    An index is broadcast, so its size is bounded by the block; more items mean
    more passes over the documents.
    """
    rows = items.select(F.col(f"`{item}`").alias("item"), F.col(f"`{text}`").alias("text")).filter("text is not null")
    kind = rows.schema["item"].dataType.simpleString()
    rows = rows.withColumn("item", F.col("item").cast("long" if kind in ("bigint", "int", "smallint", "tinyint") else "string"))
    held: list = []
    for r in rows.toLocalIterator():
        held.append(r)
        if len(held) == block:
            yield index([x["item"] for x in held], [x["text"] for x in held], threshold, size, short=short)
            held = []
    if held:
        yield index([x["item"] for x in held], [x["text"] for x in held], threshold, size, short=short)


def find(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", threshold: float = 0.8, size: int = 5, block: int = 20_000) -> DataFrame:
    """Pairs ``id, item, shared, size, containment`` of a document and an item of
    whose distinct shingles it holds at least the share ``threshold``.

    Shingles are runs of ``size`` words, words runs of non-space characters with A
    to Z in lower case. An item with fewer words is one shingle of all its words,
    looked for as a run of so many words anywhere. Null or empty
    texts hold and match nothing. Repeated documents or items give repeated pairs.
    """
    out = None
    for ix in blocks(items, item, item_text, block, threshold, size, short=True):
        found = matches(docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text")), ix, ["id"]).select("id", F.explode("found").alias("f"))
        pairs = found.select("id", "f.item", "f.shared", "f.size", (F.col("f.shared") / F.col("f.size")).alias("containment"))
        out = pairs if out is None else out.unionByName(pairs)
    if out is None:
        out = docs.select(F.col(f"`{id}`").alias("id")).limit(0).select(
            "id", F.lit(None).cast("long").alias("item"), F.lit(None).cast("long").alias("shared"), F.lit(None).cast("long").alias("size"), F.lit(None).cast("double").alias("containment")
        )
    return out


SQL = r"""
WITH words AS (
  SELECT 'd' AS side, doc_id AS id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
  UNION ALL
  SELECT 'i', item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') FROM benchmark
), size AS (SELECT DISTINCT least(len(w), 5) AS k FROM words WHERE side = 'i' AND len(w) > 0
), shingle AS (
  SELECT DISTINCT side, id, s FROM (
    SELECT side, id, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s
    FROM words JOIN size ON len(w) >= k AND (side = 'd' OR k = least(len(w), 5)))
), sized AS (SELECT id, count(*) AS n FROM shingle WHERE side = 'i' GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, count(*) AS shared, n AS item_shingles, count(*) / n AS containment
FROM shingle i JOIN shingle d ON d.s = i.s AND d.side = 'd' JOIN sized ON sized.id = i.id
WHERE i.side = 'i' GROUP BY d.id, i.id, n HAVING count(*) >= 0.8 * n
"""
