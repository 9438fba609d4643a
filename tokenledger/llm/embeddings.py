"""Embedding near-duplicates by lattice hashing.

In each of several tables a vector is projected at random to two blocks of eight
dimensions, each decoded to its nearest point of the E8 lattice; the two points
are its cell. It also visits the cells in which one block moves to the next
nearest lattice point. Vectors that meet in a cell, at least one of them at home,
are compared by cosine in double precision.

Equal vectors are one row from the start. A pair counts where it meets first, so
links are counted without a table of pairs, and each cell reports a spanning
forest of its links instead of all of them.
"""

from __future__ import annotations

import hashlib
import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import texts as T
from .components import components
from .scratch import settled

_BLOCK = 2048  # rows of a cell that one task compares with as many others
_BROADCAST_ROWS = 100_000


@dataclass(frozen=True)
class Lattice:
    """``tables`` hash tables of ``blocks`` E8 points each; ``width`` is the size of a
    cell against the spread of a projection, ``probes`` the visited neighbours per block."""

    tables: int = 10
    blocks: int = 2
    width: float = 2.25
    probes: int = 1
    seed: int = 8


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    whole = np.zeros((112, 8))
    for row, ((i, j), (s, t)) in enumerate(itertools.product(itertools.combinations(range(8), 2), itertools.product((1, -1), repeat=2))):
        whole[row, i], whole[row, j] = s, t
    half = np.array([s for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0])
    return np.concatenate([whole, half])


def _even(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum."""
    near = np.rint(x)
    gap = x - near
    worst = np.abs(gap).argmax(1)
    at = np.arange(len(x))
    near[at, worst] += np.where(near.sum(1) % 2 != 0, np.where(gap[at, worst] >= 0, 1, -1), 0)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest E8 lattice point of every row."""
    a, b = _even(x), _even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def _name(points: np.ndarray) -> np.ndarray:
    """A 64-bit hash of lattice points; twice a coordinate is a whole number."""
    out = np.zeros(points.shape[0], np.uint64)
    for c in np.rint(points * 2).astype(np.int64).view(np.uint64).T:
        out = T.mix(out ^ c) * np.uint64(0x9E3779B97F4A7C15)
    return T.mix(out)


def cells(unit: np.ndarray, lattice: Lattice) -> tuple[np.ndarray, np.ndarray]:
    """Home cell of every vector in each table, and the cells it visits."""
    n, dim = unit.shape
    roots = _roots()
    home = np.zeros((n, lattice.tables), np.uint64)
    visits = np.zeros((n, lattice.tables, lattice.blocks * lattice.probes), np.uint64)
    for t in range(lattice.tables):
        g = np.random.Generator(np.random.PCG64([lattice.seed, t, dim])).normal(size=(dim, 8 * lattice.blocks))
        y = (unit @ g / lattice.width).reshape(n, lattice.blocks, 8)
        points = [decode(y[:, b]) for b in range(lattice.blocks)]
        names = [_name(p) for p in points]

        def cell(parts, t=t):
            out = np.full(n, (t + 1) * 1_000_003 + dim, np.uint64)
            for part in parts:
                out = T.mix(out ^ part)
            return out

        home[:, t] = cell(names)
        for b in range(lattice.blocks):
            gain = (y[:, b] - points[b]) @ roots.T
            best = np.argpartition(-gain, lattice.probes - 1, axis=1)[:, : lattice.probes]
            for k in range(lattice.probes):
                moved = _name(points[b] + roots[best[:, k]])
                visits[:, t, b * lattice.probes + k] = cell([moved if i == b else names[i] for i in range(lattice.blocks)])
    return home, visits


def _unit(vectors: list[bytes]) -> np.ndarray:
    x = np.stack([np.frombuffer(v, np.float64) for v in vectors])
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _classes(df: DataFrame, id: str, vector: str) -> DataFrame:
    """``id, key, vec``: key and vec are null for a vector that links with nothing."""
    rows = df.select(F.col(f"`{id}`").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("vec"))

    def work(batches):
        for batch in batches:
            lists = batch.column(1)
            values = lists.flatten()
            valid = np.asarray(values.is_valid().to_numpy(zero_copy_only=False), bool)
            flat = values.fill_null(0.0).to_numpy(zero_copy_only=False) + 0.0  # minus zero becomes zero
            fine = valid & np.isfinite(flat)
            sizes = np.array(lists.value_lengths().fill_null(0).to_pylist(), np.int64)
            ends = np.cumsum(sizes)
            keys, vecs = [], []
            for end, size in zip(ends.tolist(), sizes.tolist()):
                own = flat[end - size : end]
                good = size > 0 and fine[end - size : end].all() and own.any()
                raw = own.tobytes() if good else None
                vecs.append(raw)
                keys.append(hashlib.blake2b(raw, digest_size=16).digest() if good else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(vecs, pa.binary())], names=["id", "key", "vec"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(work, f"id {kind}, key binary, vec binary")


def _entries(classes: DataFrame, lattice: Lattice) -> DataFrame:
    """A row per class and cell: ``cell, home, key, n, vec``."""

    def work(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 128):
                part = batch.slice(begin, 128)
                vecs = part.column("vec").to_pylist()
                by_dim: dict[int, list[int]] = {}
                for i, v in enumerate(vecs):
                    by_dim.setdefault(len(v), []).append(i)
                for members in by_dim.values():
                    home, visits = cells(_unit([vecs[i] for i in members]), lattice)
                    every = np.concatenate([home, visits.reshape(len(members), -1)], 1)
                    index = pa.array(np.repeat(members, every.shape[1]))
                    own = np.zeros(every.shape, bool)
                    own[:, : lattice.tables] = True
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(every.view(np.int64).ravel()), pa.array(own.ravel()), part.column("key").take(index), part.column("n").take(index), part.column("vec").take(index)],
                        names=["cell", "home", "key", "n", "vec"],
                    )

    return classes.select("key", "n", "vec").mapInArrow(work, "cell long, home boolean, key binary, n long, vec binary")


def _meet(cell: int, home: np.ndarray, side: np.ndarray, vecs: list[bytes], lattice: Lattice, least: float):
    """Links of a cell that count here: a boolean matrix over its rows, or None."""
    unit = _unit(vecs)
    close = (unit @ unit.T >= least) & (home[:, None] | home[None, :])
    if side.any() and not side.all():
        close &= side[:, None] != side[None, :]
    np.fill_diagonal(close, False)
    who = np.flatnonzero(close.any(1))
    if not who.size:
        return None
    own, visits = cells(unit[who], lattice)
    sub = close[np.ix_(who, who)]
    mine = np.uint64(cell & 0xFFFFFFFFFFFFFFFF)
    at = np.flatnonzero((own == mine).any(0) | (visits == mine).any((0, 2)))
    here = int(at[0])

    def together(t):
        same = own[:, t][:, None] == own[:, t][None, :]
        goes = (visits[:, t, :][:, None, :] == own[:, t][None, :, None]).any(2)  # row visits column's home
        return same, goes

    for t in range(here):
        same, goes = together(t)
        sub &= ~(same | goes | goes.T)
    # Both may visit each other; then the cell with the smaller name counts.
    same, goes = together(here)
    names = own[:, here]
    twice = goes & goes.T & ~same
    low = np.minimum(names[:, None], names[None, :])
    sub &= ~(twice & (low != mine))
    close[:] = False
    close[np.ix_(who, who)] = sub
    return close


def _forest(close: np.ndarray) -> list[tuple[int, int]]:
    seen = np.zeros(len(close), bool)
    out = []
    for root in np.flatnonzero(close.any(1)):
        if seen[root]:
            continue
        seen[root] = True
        todo = [root]
        while todo:
            i = todo.pop()
            fresh = np.flatnonzero(close[i] & ~seen)
            seen[fresh] = True
            out += [(i, int(j)) for j in fresh]
            todo += fresh.tolist()
    return out


def _compare(entries: DataFrame, lattice: Lattice, least: float) -> DataFrame:
    """``key, other, n``: links counted for a class (other null), and forest edges (n null).

    A cell with more than ``_BLOCK`` rows is cut into blocks and compared block by
    block, so no task gets a whole hot cell.
    """
    sizes = entries.groupBy("cell").agg(F.count("*").alias("rows"), F.max("home").alias("any")).filter("rows > 1 and any")
    hot = settled(sizes.filter(F.col("rows") > _BLOCK).select("cell", F.ceil(F.col("rows") / _BLOCK).cast("int").alias("parts")), "hot-cells")
    joined = entries.join(F.broadcast(hot) if hot.count() <= _BROADCAST_ROWS else hot, "cell", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.hash("key"), "parts").alias("own")
    dealt = joined.select("cell", "home", "key", "n", "vec", own, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("with")).select(
        "cell", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), (F.col("own") > F.least("own", "with")).alias("side"), "home", "key", "n", "vec"
    )
    ordered = dealt.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")

    def work(batches):
        held: list[tuple] = []
        name = None

        def close():
            # Vectors of other lengths share a cell only where hashes collide.
            for length in {len(h[7]) for h in held}:
                meet([h for h in held if len(h[7]) == length])

        def meet(held):
            if len(held) < 2 or not any(h[4] for h in held):
                return
            home, side = np.array([h[4] for h in held]), np.array([h[3] for h in held])
            links = _meet(name[0], home, side, [h[7] for h in held], lattice, least)
            if links is None or not links.any():
                return
            counts = links @ np.array([h[6] for h in held])
            who = np.flatnonzero(counts)
            edges = _forest(links)
            out[0].extend([held[i][5] for i in who] + [held[i][5] for i, _ in edges])
            out[1].extend([None] * len(who) + [held[j][5] for _, j in edges])
            out[2].extend(counts[who].tolist() + [None] * len(edges))

        out: list[list] = [[], [], []]
        for batch in batches:
            for row in zip(*[batch.column(i).to_pylist() for i in range(batch.num_columns)]):
                if row[:3] != name:
                    close()
                    held, name = [], row[:3]
                held.append(row)
            if len(out[0]) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int64())], names=["key", "other", "n"])
                out[0].clear(), out[1].clear(), out[2].clear()
        close()
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int64())], names=["key", "other", "n"])

    return ordered.mapInArrow(work, "key binary, other binary, n long")


def near(df: DataFrame, id: str = "vec_id", vector: str = "embedding", least: float = 0.95, lattice: Lattice = Lattice()) -> DataFrame:
    """One row per vector: ``id, n_links, component_id, kept``.

    Vectors link if they meet in a cell and their cosine is at least ``least``; equal
    vectors always do. Null and zero vectors and those with null or non-finite
    components link with nothing, as do vectors of different lengths with each
    other. ``component_id`` is the smallest id reachable by links, ``kept`` tells the
    rows that bear it. Repeated ids stay; null ids count only where a component has no other.
    """
    rows = settled(_classes(df, id, vector), "vectors")
    classes = settled(rows.filter("key is not null").groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("least"), F.first("vec").alias("vec")), "vector-classes")
    found = settled(_compare(_entries(classes, lattice), lattice, least), "vector-links")
    counted = found.filter("other is null").groupBy("key").agg(F.sum("n").alias("others"))
    labels = components(found.filter("other is not null"), "key", "other").select(F.col("node").alias("key"), "component")
    placed = classes.select("key", "n", "least").join(labels, "key", "left").withColumn("component", F.coalesce("component", "key"))
    # Written first, so that the join can split a component of very many classes.
    lowest = settled(placed.groupBy("component").agg(F.min("least").alias("component_id")), "lowest")
    by_class = placed.join(counted, "key", "left").join(lowest, "component").select(
        "key", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"
    )
    out = rows.select("id", "key").join(by_class, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
