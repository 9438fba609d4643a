"""Near-duplicate groups: SuperMinHash signatures, banding, exact links, components.

Equal shingle sets are one class from the start, so a group of copies is one row
in all later steps. In each bucket of a band, classes whose sizes and signatures
allow a link are joined by a spanning forest; its components are clusters, and
inside a cluster every two classes are compared on their full sets, block by
block. Neither step makes a row per pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import texts as T
from .components import components
from .scratch import released, settled

M = 128  # components of a signature
ROWS = 4  # components of 16 bits in a band, one 64-bit word
BANDS = M // ROWS
_LEAST_SAME = 75  # of 128 components: six standard deviations below a resemblance of 0.8
_BUCKET = 4096  # rows of a bucket that one task compares
_CLUSTER = 512  # texts of a cluster that one task compares with as many others
_COLUMNS = 4096  # shingles compared at a time
_BROADCAST_ROWS = 1_000_000  # keys of about 40 bytes
_STEP = np.uint64(0x9E3779B97F4A7C15)


def superminhash(shingle: np.ndarray, row: np.ndarray, rows: int, m: int = M) -> np.ndarray:
    """Signatures of all rows: rows x m; infinite for a row without shingles.

    Element by element, SuperMinHash draws a permutation of the m components and
    gives the component at rank j the value ``r_j + j`` with r_j in [0, 1); a
    component keeps its least value. All elements take rank j together here, and a
    row stops when its largest component is below j, since rank j cannot lower it.
    """
    out = np.full(rows * m, np.inf)
    element, of = shingle, row
    order: np.ndarray | None = None
    for j in range(m):
        if not element.size:
            break
        draw = T.mix(element + np.uint64((2 * j + 1) * int(_STEP) % 2**64))
        r = (draw >> np.uint64(11)).astype(np.float64) * 2.0**-53
        k = j + ((T.mix(draw ^ _STEP) >> np.uint64(32)) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64)
        if j == 0:
            place, swapped = k, k
        else:
            if order is None:  # only rows that need a second rank keep their permutation
                order = np.broadcast_to(np.arange(m, dtype=np.uint8), (element.size, m)).copy()
                at = np.arange(element.size)
                order[at, swapped], order[:, 0] = order[:, 0].copy(), order[at, swapped].copy()
            at = np.arange(element.size)
            place = order[at, k].astype(np.int64)
            order[at, k] = order[:, j]
            order[:, j] = place
        np.minimum.at(out, of * m + place, r + j)
        done = out.reshape(rows, m).max(1) < j + 1
        stay = ~done[of]
        element, of = element[stay], of[stay]
        if j == 0:
            swapped = swapped[stay]
        elif order is not None:
            order = order[stay]
    return out.reshape(rows, m)


def _distinct(shingle: np.ndarray, row: np.ndarray, rows: int) -> list[np.ndarray]:
    begin = np.searchsorted(row, np.arange(rows + 1))
    out = []
    for i in range(rows):
        s = np.sort(shingle[begin[i] : begin[i + 1]])
        out.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if s.size else s)
    return out


def _key(s: np.ndarray) -> bytes:
    """128 bits that name a set."""
    return np.array([T.mix(s).sum(), T.mix(s ^ _STEP).sum()], np.uint64).tobytes()


def _shingled(column: pa.Array, size: int):
    data, offsets = T.raw(column)
    words, _, _, row = T.word_hashes(data, offsets)
    shingle, where, _ = T.shingles(words, row, len(offsets) - 1, size)
    return shingle, where, len(offsets) - 1


def signatures(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 5) -> DataFrame:
    """``id, tag, key, n, bands`` of every row: a hash of the text, the set's name
    and size, and its bands (null without shingles)."""
    rows = docs.select(F.col(f"`{id}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("tag"), F.col(f"`{text}`").alias("text"))

    def work(batches):
        for batch in batches:
            for part in T.slices(batch):
                shingle, where, count = _shingled(part.column(2), size)
                sets = _distinct(shingle, where, count)
                sig = superminhash(shingle, where, count)
                bits = (T.mix(sig.view(np.uint64)) & np.uint64(0xFFFF)).reshape(count, BANDS, ROWS)
                bands = bits[:, :, 0] | (bits[:, :, 1] << np.uint64(16)) | (bits[:, :, 2] << np.uint64(32)) | (bits[:, :, 3] << np.uint64(48))
                n = np.array([s.size for s in sets], np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(count + 1) * BANDS, pa.int32()), pa.array(bands.reshape(-1).view(np.int64)))
                empty = pa.array(n == 0)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([_key(s) for s in sets], pa.binary()), pa.array(n), pc.if_else(empty, pa.nulls(count, lists.type), lists)],
                    names=["id", "tag", "key", "n", "bands"],
                )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(work, f"id {kind}, tag long, key binary, n long, bands array<long>")


def _dealt(rows: DataFrame, group: list[str], block: int) -> DataFrame:
    """Rows of each group by blocks: a task gets a pair of blocks ``i, j`` of a group.

    A group of up to ``block`` rows is one task's; a larger one is cut by a hash of
    the key, and every block meets every other once.
    """
    sizes = rows.groupBy(*group).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > block)
    hot = settled(sizes.select(*group, F.ceil(F.col("_rows") / block).cast("int").alias("parts")), "hot-groups")
    joined = rows.join(F.broadcast(hot) if hot.count() <= _BROADCAST_ROWS else hot, group, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    cut = joined.withColumn("own", F.pmod(F.hash("key"), "parts")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    names = [*group, "i", "j"]
    dealt = cut.withColumn("i", F.least("own", "with")).withColumn("j", F.greatest("own", "with")).drop("parts", "own", "with")
    return dealt.repartition(*names).sortWithinPartitions(*names).select(*names, *[c for c in rows.columns if c not in group])


def _forest(near, n: int) -> list[tuple[int, int]]:
    """Spanning forest of a graph; ``near(i, rest)`` flags which of ``rest`` are next to ``i``."""
    rest = np.arange(1, n)
    todo, out = [0], []
    while rest.size or todo:
        if not todo:
            todo, rest = [int(rest[0])], rest[1:]
        i = todo.pop()
        if not rest.size:
            break
        found = near(i, rest)
        out += [(i, int(k)) for k in rest[found]]
        todo += rest[found].tolist()
        rest = rest[~found]
    return out


def _edges(pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.binary())], names=["a", "b"])


def _candidates(buckets: DataFrame, percent: int) -> DataFrame:
    """Edges ``a, b`` that span the classes of a bucket whose sizes and signatures
    allow the resemblance: at most one edge less than the bucket has rows."""

    def work(batches):
        name, keys, sizes, bits = None, [], [], []
        out: list[tuple[bytes, bytes]] = []

        def close():
            if len(keys) < 2:
                return
            n, sig = np.array(sizes), np.stack(bits)

            def near(i, rest):
                fits = 100 * np.minimum(n[rest], n[i]) >= percent * np.maximum(n[rest], n[i])
                fits[fits] = (sig[rest[fits]] == sig[i]).sum(1) >= _LEAST_SAME
                return fits

            out.extend((keys[i], keys[k]) for i, k in _forest(near, len(keys)))

        for batch in batches:
            every = np.ascontiguousarray(batch.column("bands").flatten().to_numpy(zero_copy_only=False)).view(np.uint16).reshape(-1, M)
            heads = zip(*[batch.column(c).to_pylist() for c in ("band", "value", "i", "j")])
            for at, (head, key, n) in enumerate(zip(heads, batch.column("key").to_pylist(), batch.column("n").to_pylist())):
                if head != name:
                    close()
                    name, keys, sizes, bits = head, [], [], []
                keys.append(key)
                sizes.append(n)
                bits.append(every[at])
            if len(out) > 20_000:
                yield _edges(out)
                out.clear()
        close()
        yield _edges(out)

    return _dealt(buckets, ["band", "value"], _BUCKET).mapInArrow(work, "a binary, b binary")


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of the sets."""
    owner = np.repeat(np.arange(len(sets)), [x.size for x in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = count > 1  # what one set alone has meets nothing
    number = np.cumsum(often) - 1
    keep = often[column]
    owner, column = owner[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(sets), len(sets)), np.int64)  # 32-bit floats hold a block's counts exactly, not 100 times a long text's
    for begin in range(0, int(often.sum()), _COLUMNS):
        a, b = np.searchsorted(column, [begin, begin + _COLUMNS])
        part = np.zeros((len(sets), _COLUMNS), np.float32)
        part[owner[a:b], column[a:b] - begin] = 1
        total += (part @ part.T).astype(np.int64)
    return total


def _links(clustered: DataFrame, size: int, percent: int) -> DataFrame:
    """Edges ``a, b`` that span the linked classes of a cluster (cluster, key, text),
    decided by the full sets of every two of its classes."""

    def work(batches):
        name, keys, sets, seen = None, [], [], set()
        out: list[tuple[bytes, bytes]] = []

        def close():
            if len(keys) < 2:
                return
            n = np.array([x.size for x in sets])
            both = _shared(sets)
            linked = 100 * both >= percent * (n[:, None] + n[None, :] - both)
            out.extend((keys[i], keys[k]) for i, k in _forest(lambda i, rest: linked[i, rest], len(keys)))

        for batch in batches:
            for part in T.slices(batch):
                shingle, where, count = _shingled(part.column("text"), size)
                heads = zip(*[part.column(c).to_pylist() for c in ("cluster", "i", "j")])
                for own, head, key in zip(_distinct(shingle, where, count), heads, part.column("key").to_pylist()):
                    if head != name:
                        close()
                        name, keys, sets, seen = head, [], [], set()
                    # Texts are found by id and a hash; one that isn't meant has another key.
                    if key not in seen and _key(own) == key:
                        seen.add(key)
                        keys.append(key)
                        sets.append(own)
                if len(out) > 20_000:
                    yield _edges(out)
                    out.clear()
        close()
        yield _edges(out)

    return _dealt(clustered, ["cluster"], _CLUSTER).mapInArrow(work, "a binary, b binary")


def _texts(docs: DataFrame, needed: DataFrame, id: str, text: str) -> DataFrame:
    """``cluster, key, text``: a text of each class ``needed`` (key, cluster, id, tag)."""
    want = needed.select("key", "cluster", F.col("id").alias("_id"), F.col("tag").alias("_tag"))
    if needed.count() <= _BROADCAST_ROWS:
        want = F.broadcast(want)  # a counted number of short rows; beyond it both sides are shuffled
    rows = docs.select(F.col(f"`{id}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("tag"), F.col(f"`{text}`").alias("text"))
    return rows.join(want, rows["id"].eqNullSafe(want["_id"]) & (rows["tag"] == want["_tag"])).select("cluster", "key", "text")


def groups(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: ``id, n_shingles, component_id, kept, tag, component``.

    Documents link if the Jaccard resemblance of their sets of ``size``-word
    shingles is at least ``percent`` / 100, confirmed on the full sets. A text with
    fewer words is one shingle of all its words; a null text or one without words
    links with nothing. ``component_id`` is the smallest id reachable by links,
    and ``kept`` tells the rows that bear it. Rows that repeat an id stay; null
    ids count only where a component has no other. ``tag`` is a hash of the text,
    and ``component`` names the component also where ids repeat or are null (null
    without words).
    """
    sets = settled(signatures(docs, id, text, size), "sets")
    classes = settled(
        sets.filter("n > 0").groupBy("key").agg(F.first("n").alias("n"), F.first("bands").alias("bands"), F.min("id").alias("least"), F.min(F.struct("id", "tag")).alias("rep")), "classes"
    )
    bands = classes.select("key", F.posexplode("bands").alias("band", "value"))
    # Written first: a join that follows an aggregate on its own key cannot be split where a key is hot.
    full = settled(bands.groupBy("band", "value").agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n"), "full")
    buckets = settled(bands.join(full, ["band", "value"]).join(classes.select("key", "n", "bands"), "key"), "buckets")
    clusters = settled(components(_candidates(buckets, percent)).select(F.col("node").alias("key"), F.col("component").alias("cluster")), "clusters")
    needed = clusters.join(classes, "key").select("key", "cluster", F.col("rep.id").alias("id"), F.col("rep.tag").alias("tag"))
    wanted = settled(needed, "wanted")
    texts = settled(_texts(docs, wanted, id, text), "texts")
    labels = settled(components(_links(texts, size, percent)), "labels")
    released(full, buckets, clusters, wanted, texts)
    member = labels.select(F.col("node").alias("key"), "component")
    placed = classes.join(member, "key", "left").select("key", "least", F.coalesce("component", "key").alias("component"))
    lowest = settled(placed.groupBy("component").agg(F.min("least").alias("component_id")), "lowest")
    by_class = placed.join(lowest, "component").select("key", "component_id", "component")
    out = sets.select("id", "tag", "n", F.when(F.col("n") > 0, F.col("key")).alias("key")).join(by_class, "key", "left")
    found = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select("id", F.col("n").alias("n_shingles"), found.alias("component_id"), F.col("id").eqNullSafe(found).alias("kept"), "tag", "component")
