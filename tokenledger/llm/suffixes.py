"""Exact removal of long repeated strings, by Burrows-Wheeler transforms.

Two equal strings of ``length`` bytes choose the same anchor: the 32 bytes whose
hash is least among all in the string. A stretch of text whose strings share an
anchor is a segment; equal strings lie in segments of one anchor, at one distance
from it. So anchors divide the search into independent collections: anchors that
occur once need no search, equal segments are compared once, and every task
searches collections of bounded size.

A collection's segments are joined into one text with separators. Its suffix
array gives the Burrows-Wheeler transform, on which intervals are extended
backwards breadth first, from the empty string on: the interval of ``w`` splits
into those of ``cw``, and the right end of each gets its common prefix the first
time it is met, in increasing order. The expansion stops at ``length``: suffixes
between which no end was met have that many bytes in common.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import texts as T
from .scratch import released, settled

GRAM = 32
_PIECE = 1 << 19  # window starts handled at a time
_LOW = np.uint64((1 << 20) - 1)  # holds a place in a piece
_IDS = 21  # bits of a place in a collection's text
_COLLECTION = 1_200_000  # bytes joined into one text
_HOT = 2048  # segments of an anchor beyond which they are dealt out by more context
_TURN = 8  # windows that share such a context
_BROADCAST_WINDOWS = 50_000  # keys of ``length`` bytes
_BROADCAST_ROWS = 1_000_000  # keys of 8 bytes
_SEED = np.random.Generator(np.random.PCG64(77)).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_MASK = 2**64 - 1


def _grams(data: np.ndarray) -> np.ndarray:
    """A hash of every run of ``GRAM`` bytes."""
    h, width, power = _SEED[data], 1, _BASE
    while width < GRAM:
        h = h[:-width] * np.uint64(power) + h[width:]
        power, width = power * power & _MASK, width * 2
    return T.mix(h)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    done = 1
    while done * 2 <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    rest = width - done
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


_HELD: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _prefix(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums from which any run's hash follows, and the inverse powers."""
    n = data.size
    if not _HELD or next(iter(_HELD)) < n:
        _HELD.clear()
        size = max(n, 1 << 16)
        _HELD[size] = (_powers(_BASE, size), _powers(_INVERSE, size))
    up, down = next(iter(_HELD.values()))
    return np.concatenate([[np.uint64(0)], np.cumsum(_SEED[data] * up[:n], dtype=np.uint64)]), down


def segments(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments of a text: anchor, hash of the segment, first window, windows."""
    out = []
    n = data.size - length + 1
    for begin in range(0, n, _PIECE):
        piece = data[begin : min(n, begin + _PIECE) + length - 1]
        grams = _grams(piece)
        # The low bits hold the place, so of equal hashes the leftmost counts and an anchor is one place.
        least = _least((grams & ~_LOW) | np.arange(grams.size, dtype=np.uint64), length - GRAM + 1)
        at = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        count = np.diff(np.append(at, least.size))
        sums, down = _prefix(piece)
        name = T.mix((sums[at + count + length - 1] - sums[at]) * down[at] + count.astype(np.uint64))
        out.append((grams[(least[at] & _LOW).astype(np.int64)], name, at + begin, count))
    if not out:
        zero = np.zeros(0, np.int64)
        return zero.astype(np.uint64), zero.astype(np.uint64), zero, zero
    return tuple(np.concatenate(x) for x in zip(*out))


def suffix_array(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` symbols at least; ties by place.

    Prefix doubling; a place, its rank and the rank further on fit one 64-bit
    word, which sorts without indirection. Symbols must be dense.
    """
    n = symbols.size
    if n >= 1 << _IDS:
        raise ValueError(f"a collection of {n} bytes; places have {_IDS} bits")
    bits = max(1, int(symbols.max()).bit_length())
    width = (63 - _IDS) // bits
    key = np.zeros(n, np.uint64)
    for i in range(width):
        key <<= np.uint64(bits)
        key[: n - i] |= symbols[i:].astype(np.uint64)
    low = np.uint64((1 << _IDS) - 1)
    packed = np.sort((key << np.uint64(_IDS)) | np.arange(n, dtype=np.uint64))
    order = (packed & low).astype(np.int32)
    head = np.concatenate([[True], (packed[1:] >> np.uint64(_IDS)) != (packed[:-1] >> np.uint64(_IDS))])
    rank = np.empty(n + 1, np.uint64)
    starts = np.flatnonzero(head)
    rank[order] = np.repeat(starts, np.diff(np.append(starts, n)))
    rank[n] = 0
    done = width
    while done < depth:
        tied = ~head
        tied[:-1] |= ~head[1:]
        where = np.flatnonzero(tied)
        if not where.size:
            break
        place = order[where].astype(np.int64)
        further = np.minimum(place + done, n)
        packed = np.sort((rank[place] << np.uint64(2 * _IDS)) | ((rank[further] + np.where(further < n, np.uint64(1), np.uint64(0))) << np.uint64(_IDS)) | place.astype(np.uint64))
        order[where] = (packed & low).astype(np.int32)
        fresh = np.concatenate([[True], (packed[1:] >> np.uint64(_IDS)) != (packed[:-1] >> np.uint64(_IDS))])
        head[where] = fresh
        at = np.flatnonzero(fresh)
        rank[order[where]] = np.repeat(where[at], np.diff(np.append(at, where.size)))
        done *= 2
    return order


def expanded(symbols: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For every place of the suffix array, whether its common prefix with the one
    before is shorter than ``length``: the ends met by the expansion."""
    n = symbols.size
    transform = symbols[order - 1]
    turn = np.argsort(transform, kind="stable").astype(np.int32)
    back = np.empty(n, np.int32)
    back[turn] = np.arange(n, dtype=np.int32)  # where the suffix one symbol longer stands
    same = transform[turn[1:]] == transform[turn[:-1]]
    following = np.full(n, n, np.int32)
    following[turn[:-1][same]] = turn[1:][same]
    preceding = np.full(n, -1, np.int32)
    preceding[turn[1:][same]] = turn[:-1][same]
    met = np.zeros(n + 1, bool)
    met[[0, n]] = True
    low, high = np.zeros(1, np.int64), np.full(1, n, np.int64)
    for _ in range(length):
        size = high - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
        last = following[at] >= np.repeat(high, size)
        first = preceding[at] < np.repeat(low, size)
        ends = np.sort(back[at[last]]).astype(np.int64) + 1
        begins = np.sort(back[at[first]]).astype(np.int64)
        fresh = ~met[ends]
        low, high = begins[fresh], ends[fresh]
        if not high.size:
            break
        met[high] = True
    return met[:n]


def repeated(parts: list[bytes], many: np.ndarray, length: int) -> np.ndarray:
    """Which strings of ``length`` bytes of the joined parts occur more than once.

    ``parts`` are distinct; a part that is ``many`` counts twice. Returns a flag
    for each place of the parts joined with one separator after each.
    """
    sizes = np.array([len(p) for p in parts], np.int64)
    raw = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8).astype(np.uint16) + 1
    ends = np.cumsum(sizes + 1) - 1
    raw[ends] = 0
    used = np.zeros(258, bool)
    used[raw] = True
    symbols = (np.cumsum(used) - 1)[raw].astype(np.uint16 if used.sum() > 255 else np.uint8)
    order = suffix_array(symbols, length)
    group = np.cumsum(expanded(symbols, order, length)) - 1
    owner = np.repeat(np.arange(len(parts)), sizes + 1)
    whole = np.arange(raw.size) + length <= ends[owner]
    count = np.where(many[owner], 2, 1) * whole
    total = np.bincount(group, count[order])
    flags = np.zeros(raw.size, bool)
    flags[order] = total[group] > 1
    return flags & whole


def _spread(flags: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of bytes covered by flagged windows."""
    step = np.zeros(flags.size + length + 1, np.int64)
    at = np.flatnonzero(flags)
    np.add.at(step, at, 1)
    np.add.at(step, at + length, -1)
    on = np.cumsum(step) > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], on, [False]]).astype(np.int8)))
    return edge[::2], edge[1::2]


def _anchors(docs: DataFrame, length: int) -> DataFrame:
    """``fp, sh, key, at`` of every segment: anchor, hash, text, and first window x 8192 + windows."""

    def work(batches):
        seen: set[int] = set()  # texts of this task
        for batch in batches:
            for part in T.slices(batch):
                data, offsets = T.raw(part.column(1))
                out = []
                for i, key in enumerate(part.column(0).to_pylist()):
                    if offsets[i + 1] - offsets[i] >= length and key not in seen:
                        seen.add(key)
                        fp, sh, at, count = segments(data[offsets[i] : offsets[i + 1]], length)
                        out.append((fp, sh, np.full(fp.size, key, np.int64), at * 8192 + count))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in zip(*out)], names=["fp", "sh", "key", "at"])

    return docs.select("key", "text").mapInArrow(work, "fp long, sh long, key long, at long")


def _narrowed(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Rows whose key is (left_semi) or isn't (left_anti) in ``keys``."""
    return docs.join(F.broadcast(keys) if keys.count() <= _BROADCAST_ROWS else keys, "key", how)


def _wanted(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """Texts and what is wanted of them, joined by key."""
    return _narrowed(docs.select("key", "text"), lists.select("key"), "left_semi").join(lists, "key")


def _parts(wanted: DataFrame, length: int) -> DataFrame:
    """The segments to search: ``route, fp, sh, skip, many, part``.

    Segments of one anchor share a route. Those of a hot anchor are cut into
    ``_TURN`` windows at fixed distances from it and routed by the bytes that these
    have in common, so that only like contexts come together.
    """

    def work(batches):
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for text, wants in zip(batch.column("text"), batch.column("wants")):
                data = np.frombuffer(memoryview(text.as_buffer()), np.uint8)
                sums = None
                for want in wants.as_py():
                    first, count = divmod(want["at"], 8192)
                    own = data[first : first + count + length - 1]
                    if own.size != count + length - 1:
                        continue
                    sums, down = _prefix(own)
                    # Texts are found by a 64-bit key; a text that isn't meant has another hash here.
                    if int(T.mix(sums[-1:] + np.uint64(count))[0]) != want["sh"] & _MASK:
                        continue
                    if not want["hot"]:
                        rows.append((want["fp"], want["fp"], want["sh"], 0, want["many"], own.tobytes()))
                        size += own.size
                    else:
                        grams = np.flatnonzero(_grams(own) == np.uint64(want["fp"] & _MASK))
                        lead = int(grams[0])  # the leftmost is the anchor of all windows
                        turn = (lead - np.arange(count)) // _TURN
                        cut = np.flatnonzero(np.concatenate([[True], turn[1:] != turn[:-1]]))
                        for a, b in zip(cut.tolist(), np.append(cut[1:], count).tolist()):
                            core = int(lead - turn[a] * _TURN)
                            route = hashlib.blake2b(own[core : core + length - _TURN + 1].tobytes(), digest_size=8, key=(want["fp"] & _MASK).to_bytes(8, "little") + int(turn[a]).to_bytes(2, "little")).digest()
                            rows.append((int.from_bytes(route, "little", signed=True), want["fp"], want["sh"], a, want["many"], own[a : b + length - 1].tobytes()))
                            size += b - a + length - 1
                    if size > 1 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
            if rows:
                yield _batch(rows)

    def _batch(rows):
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=["route", "fp", "sh", "skip", "many", "part"])

    return wanted.select("text", "wants").mapInArrow(work, "route long, fp long, sh long, skip long, many boolean, part binary")


def _room() -> int:
    """Bytes that one route may add to a collection that is about to be searched."""
    return (1 << _IDS) - 1 - _COLLECTION


def _full(parts: DataFrame) -> DataFrame:
    """``route`` of the routes whose distinct parts don't fit a collection."""
    sizes = parts.groupBy("route", F.xxhash64("part").alias("_part")).agg((F.max(F.octet_length("part")) + 1).alias("_size"))
    return sizes.groupBy("route").agg(F.sum("_size").alias("_size")).filter(F.col("_size") > _room()).select("route")


def _by_window(parts: DataFrame, length: int) -> DataFrame:
    """What ``_search`` finds, by counting every string of ``length`` bytes on its
    own: ``fp, sh, low, high``, a row per string that occurs more than once.

    For routes of any size; a segment's parts hold each of its strings once.
    """
    at = F.explode(F.sequence(F.lit(0), F.octet_length("part") - length)).alias("w")
    each = parts.select("fp", "sh", "skip", "many", "part", at)
    each = each.select("fp", "sh", (F.col("skip") + F.col("w")).alias("low"), "many", F.expr(f"substring(part, w + 1, {length})").alias("string"))
    often = settled(each.groupBy("string").agg(((F.count("*") > 1) | F.max("many")).alias("often")).filter("often").select("string"), "windows")
    found = each.join(F.broadcast(often) if often.count() <= _BROADCAST_WINDOWS else often, "string", "left_semi")
    return found.select("fp", "sh", "low", (F.col("low") + length).alias("high"))


def _search(parts: DataFrame, length: int) -> DataFrame:
    """Covered bytes of every segment: ``fp, sh, low, high`` from its first byte."""
    ordered = parts.repartition("route").sortWithinPartitions("route")

    def work(batches):
        texts: list[bytes] = []  # of the routes gathered so far
        owners: list[dict] = []
        total = 0
        route, index = None, {}

        def flush():
            nonlocal texts, owners, total
            if not texts:
                return None
            many = np.array([len(o) > 1 or any(o.values()) for o in owners])
            flags = repeated(texts, many, length)
            fp, sh, low, high = [], [], [], []
            begin = 0
            for text, own in zip(texts, owners):
                mine = flags[begin : begin + len(text)]
                begin += len(text) + 1
                if mine.any():
                    a, b = _spread(mine, length)
                    for f, s, skip in own:
                        fp += [f] * len(a)
                        sh += [s] * len(a)
                        low += (a + skip).tolist()
                        high += (b + skip).tolist()
            texts, owners, total = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (fp, sh, low, high)], names=["fp", "sh", "low", "high"])

        for batch in batches:
            for r, f, s, skip, many, part in zip(*[batch.column(i).to_pylist() for i in range(6)]):
                if r != route:
                    if total > _COLLECTION:
                        out = flush()
                        if out is not None:
                            yield out
                    route, index = r, {}
                at = index.get(part)
                if at is None:
                    at = index[part] = len(texts)
                    texts.append(part)
                    owners.append({})
                    total += len(part) + 1
                owners[at][f, s, skip] = many
        out = flush()
        if out is not None:
            yield out

    return ordered.mapInArrow(work, "fp long, sh long, low long, high long")


def _kept(text: np.ndarray, low: np.ndarray, high: np.ndarray, characters: bool) -> tuple[np.ndarray, int, int]:
    """Bytes that stay, number of bytes that go, and number of runs that go."""
    n = text.size
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, low, 1)
    np.add.at(step, high, -1)
    gone = np.cumsum(step)[:n] > 0
    if characters:  # a character goes only if all of its bytes do
        heads = np.flatnonzero((text & 0xC0) != 0x80)
        gone = np.repeat(np.logical_and.reduceat(gone, heads), np.diff(np.append(heads, n)))
    runs = int(np.count_nonzero(gone & ~np.concatenate([[False], gone[:-1]])))
    return text[~gone], int(gone.sum()), runs


def dedup(docs: DataFrame, text: str = "text", length: int = 200, characters: bool = False) -> DataFrame:
    """The columns of ``docs`` and ``n_bytes, n_removed, n_spans, kept`` (binary),
    which replace columns of the same names.

    Removes each byte of a text that a string of ``length`` bytes covers which also
    starts anywhere else in the input, in the same text too. Overlaps count, and
    strings are judged on the input. A null text is empty; shorter texts stay
    whole; a longer text that occurs in several rows goes whole. With
    ``characters``, a character stays unless all its bytes are covered. ``length``
    is at least 64 and at most 4096.
    """
    names = [c for c in docs.columns if c not in ("n_bytes", "n_removed", "n_spans", "kept")]
    own = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], own.alias("text"), F.xxhash64(own).alias("key"))
    told = rows.select("key", F.octet_length("text").alias("size"), F.crc32("text").alias("crc")).filter(F.col("size") >= length)
    copies = settled(told.groupBy("key", "size", "crc").count().filter("count > 1").select("key", "size", "crc"), "copies")
    anchors = settled(_anchors(rows.filter(F.octet_length("text") >= length), length), "anchors")
    place = F.xxhash64("key", "at")
    # Written first: a join that follows an aggregate on its own key cannot be split where a key is hot.
    often = settled(anchors.groupBy("fp").agg(F.min(place).alias("a"), F.max(place).alias("b")).filter("a <> b").select("fp"), "often")
    members = settled(anchors.join(often, "fp", "left_semi"), "members")
    distinct = settled(
        members.groupBy("fp", "sh").agg(F.min(F.struct("key", "at")).alias("rep"), (F.min(place) != F.max(place)).alias("many")), "segments"
    )
    released(anchors, often)
    size = F.sum(F.col("rep.at") % 8192 + length)
    hot = distinct.groupBy("fp").agg(F.count("*").alias("n"), size.alias("size")).filter((F.col("n") > _HOT) | (F.col("size") > _room())).select("fp", F.lit(True).alias("hot"))
    wants = distinct.join(hot, "fp", "left").groupBy(F.col("rep.key").alias("key")).agg(
        F.collect_list(F.struct("fp", "sh", F.col("rep.at").alias("at"), "many", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("wants")
    )
    lists = settled(wants, "wants")
    parts = _parts(_wanted(rows, lists), length)
    # Strings of a hot anchor that come in very many contexts are counted one by one.
    dealt = lists.select("key", F.filter("wants", lambda x: x["hot"]).alias("wants")).filter(F.size("wants") > 0)
    found = parts
    if dealt.limit(1).count():
        again = _parts(_wanted(rows, dealt), length)
        full = settled(_full(again), "full-routes")
        if full.limit(1).count():
            routes = F.broadcast(full) if full.count() <= _BROADCAST_ROWS else full
            found = _search(parts.join(routes, "route", "left_anti"), length).unionByName(_by_window(again.join(routes, "route", "left_semi"), length))
    cover = settled(_search(parts, length) if found is parts else found, "cover")
    marks = settled(
        members.join(cover, ["fp", "sh"]).groupBy("key").agg(F.collect_set(F.struct("at", "sh", "low", "high")).alias("marks")), "marks"
    )
    released(members, distinct, lists, cover)
    plain = _narrowed(rows, marks.select("key"), "left_anti").withColumn("marks", F.lit(None).cast(marks.schema["marks"].dataType))
    marked = _narrowed(rows, marks.select("key"), "left_semi").join(marks, "key")
    twice = copies.withColumn("_twice", F.lit(True))
    found = plain.select(*rows.columns, "marks").unionByName(marked.select(*rows.columns, "marks")).withColumn("size", F.octet_length("text")).withColumn("crc", F.crc32("text"))
    found = found.join(F.broadcast(twice) if copies.count() <= _BROADCAST_ROWS else twice, ["key", "size", "crc"], "left")
    columns = [f"c{i}" for i in range(len(names))]

    def work(batches):
        for batch in batches:
            for part in T.slices(batch):
                data, offsets = T.raw(part.column(part.schema.get_field_index("text")))
                out: list[list] = [[], [], [], []]
                marks = part.column(part.schema.get_field_index("marks"))
                for i, twice in enumerate(part.column(part.schema.get_field_index("_twice")).to_pylist()):
                    own = data[offsets[i] : offsets[i + 1]]
                    stay, gone, runs = own, 0, 0
                    if twice:
                        stay, gone, runs = own[:0], own.size, 1
                    elif marks[i].is_valid:
                        m = marks[i].values
                        at, sh, low, high = (m.field(k).to_numpy(zero_copy_only=False) for k in range(4))
                        first, count = at // 8192, at % 8192
                        fits = first + count + length - 1 <= own.size
                        at, sh, low, high, first, count = (x[fits] for x in (at, sh, low, high, first, count))
                        right = _names(own, first, count, length) == sh.view(np.uint64)
                        stay, gone, runs = _kept(own, (first + low)[right], (first + high)[right], characters)
                    for x, v in zip(out, (own.size, gone, runs, stay.tobytes())):
                        x.append(v)
                types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(columns))] + [pa.array(x, t) for x, t in zip(out, types)], names=[*columns, "n_bytes", "n_removed", "n_spans", "kept"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns)
    made = found.select(*columns, "text", "marks", "_twice").mapInArrow(work, f"{kinds}, n_bytes long, n_removed long, n_spans long, kept binary")
    return made.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "n_bytes", "n_removed", "n_spans", "kept")


def _names(data: np.ndarray, first: np.ndarray, count: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the segments of a text, piece by piece as they were made."""
    out = np.zeros(first.size, np.uint64)
    piece = first // _PIECE
    for p in np.unique(piece).tolist():
        own = np.flatnonzero(piece == p)
        begin = p * _PIECE
        sums, down = _prefix(data[begin : begin + _PIECE + length - 1])
        at = first[own] - begin
        out[own] = T.mix((sums[at + count[own] + length - 1] - sums[at]) * down[at] + count[own].astype(np.uint64))
    return out
