"""Two tokenizers' tokens of the same text, aligned by the bytes they cover.

Works on Arrow arrays: token lists are flattened and keep the index of their
document as parent, token ends are cumulative sums that restart with every
document, and a hash join of both sides on (document, end) finds where the two
agree. These ends cut the tokens into groups. Between two neighbouring ends of
either side lies one token of each, so the ends of both sides together are the
overlapping pairs. Pairs are counted per document in the same pass, and Spark adds
the counts up over the corpus.
"""

from __future__ import annotations

import hashlib
import json
import pickle
import sys
from dataclasses import dataclass
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import texts as T
from .scratch import settled, shipped, unused

BYTE_BPE, PIECE_BPE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
_UNITS = 1 << 17  # units whose tokens a worker remembers
_BROADCAST_ROWS = 1_000_000  # pairs of about 32 bytes

#: Fixed value: how byte-level BPE cuts a text before it merges.
_CUT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable Latin-1
    stands for itself, the other bytes for U+0100 and up in their order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """The byte-level tokenizer of a JSON file. Ids follow the order of merges, so
    they serve as ranks; special tokens' strings are plain text."""

    def __init__(self, file: bytes):
        import tiktoken

        model, letters = json.loads(file)["model"], _byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if all(c in letters for c in token)}
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.tokens[i] = token
        self._engine = tiktoken.Encoding(hashlib.sha256(file).hexdigest(), pat_str=_CUT, mergeable_ranks=ranks, special_tokens={})

    def ids(self, units: list[str]) -> list[list[int]]:
        return [self._engine.encode_ordinary(u) for u in units]


class PieceBpe:
    """The piece tokenizer of a model file, which puts a space before a text itself."""

    def __init__(self, file: bytes):
        import sentencepiece

        self._engine = sentencepiece.SentencePieceProcessor(model_proto=file)
        pieces = [self._engine.id_to_piece(i) for i in range(self._engine.get_piece_size())]
        self.tokens = [bytes([int(p[1:-1], 16)]) if self._engine.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        #: Whether no piece reaches over a space, so that texts may be cut before one.
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)

    def ids(self, units: list[str]) -> list[list[int]]:
        return self._engine.encode([u[1:] for u in units], num_threads=1)


@dataclass(frozen=True)
class Tokenizers:
    """Contents of the two files; ``name`` tells them apart from others."""

    a: bytes
    b: bytes

    @property
    def name(self) -> str:
        return hashlib.sha256(self.a + b"|" + self.b).hexdigest()


def read(a: str = BYTE_BPE, b: str = PIECE_BPE) -> Tokenizers:
    """The tokenizers at two paths, read by the driver and sent along with the work."""
    with open(a, "rb") as first, open(b, "rb") as second:
        return Tokenizers(first.read(), second.read())


class _Engine:
    """Both tokenizers and the tokens of units met so far, once per worker."""

    def __init__(self, files: Tokenizers):
        self.a, self.b = ByteBpe(files.a), PieceBpe(files.b)
        self.size = [np.array([len(t) for t in x.tokens], np.int64) for x in (self.a, self.b)]
        self.digits = [pa.array([str(i) for i in range(len(x.tokens))]) for x in (self.a, self.b)]
        self.seen: dict[str, tuple[list[int], list[int], bool]] = {}

    def tokens(self, units: list[str]) -> list[tuple[list[int], list[int], bool]]:
        """Ids of both sides of every unit, and whether both give its bytes back."""
        if len(self.seen) > _UNITS:
            self.seen.clear()
        new = [u for u in units if u not in self.seen]
        for u, x, y in zip(new, self.a.ids(new), self.b.ids(new)):
            whole = u.encode()
            self.seen[u] = (x, y, b"".join([self.a.tokens[i] for i in x]) == whole == b"".join([self.b.tokens[i] for i in y]))
        return [self.seen[u] for u in units]


def _engine(files, name: str) -> _Engine:
    held = f"tokenledger_tokenizers_{name}"
    if held not in sys.modules:
        module = ModuleType(held)
        module.engine = _Engine(pickle.loads(files.value))
        sys.modules[held] = module
    return sys.modules[held].engine


def _led(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a space before each, and their offsets."""
    rows = len(offsets) - 1
    out = np.full(data.size + rows, 0x20, np.uint8)
    place = np.ones(out.size, bool)
    place[offsets[:-1] + np.arange(rows)] = False
    out[place] = data
    return out, offsets + np.arange(rows + 1)


def _units(data: np.ndarray, offsets: np.ndarray, cut: bool) -> np.ndarray:
    """Where texts may be cut without a change of tokens, ends included.

    Before a space that has another character than a space before it and stands
    beside visible ASCII: no token of either side then reaches over its start, and
    what either side takes before it does not depend on what follows.
    """
    if not cut:
        return offsets
    space = data == 0x20
    seen = (data > 0x20) & (data < 0x7F)
    inner = np.zeros(data.size + 1, bool)
    inner[1 : data.size - 1] = space[1:-1] & ~space[:-2] & (seen[2:] | seen[:-2])
    inner[offsets[1:] - 1] = False  # a last space alone would be no text for side B
    inner[offsets] = True
    return np.flatnonzero(inner)


def _lists(values: list[list[int]], chosen: np.ndarray) -> pa.ListArray:
    size = np.array([len(v) for v in values], np.int32)
    flat = np.fromiter((i for v in values for i in v), np.int32, int(size.sum()))
    lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(size, dtype=np.int32)]).astype(np.int32), pa.array(flat))
    return lists.take(pa.array(chosen))


def _ends(tokens: pa.ListArray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all tokens, their documents, and their ends in bytes from their document's start."""
    ids, parent = tokens.flatten().to_numpy(zero_copy_only=False), pc.list_parent_indices(tokens).to_numpy(zero_copy_only=False)
    total = np.cumsum(size[ids])
    first = tokens.offsets.to_numpy()[:-1] - tokens.offsets[0].as_py()
    before = np.concatenate([[0], total])[first]
    return ids, parent, total - before[parent]


def _joined(strings: pa.Array, offsets: np.ndarray, by: str) -> pa.Array:
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), strings), by)


def _aligned(engine: _Engine, column: pa.Array, whole: bool) -> dict[str, pa.Array]:
    """The alignment of a slice of texts, one entry per row."""
    rows = len(column)
    zero = np.zeros(rows, np.int64)
    data, offsets = T.raw(column)
    given = np.flatnonzero(np.diff(offsets))  # rows with a text
    data, at = _led(data, np.concatenate([[0], np.cumsum(np.diff(offsets)[given])]))
    cuts = _units(data, at, engine.b.cuts)
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
    found = engine.tokens([u.decode() for u in coded.dictionary.to_pylist()])
    which = coded.indices.to_numpy()
    first = np.searchsorted(cuts, at)  # a document's first unit
    sound = np.ones(len(given), bool)
    doubt = ~np.array([f[2] for f in found], bool)[which] if len(which) else np.zeros(0, bool)
    for d in np.unique(np.searchsorted(first, np.flatnonzero(doubt), "right") - 1):
        mine = [found[i] for i in which[first[d] : first[d + 1]]]
        text = data[at[d] : at[d + 1]].tobytes()
        sound[d] = all(b"".join([side.tokens[i] for f in mine for i in f[k]]) == text for k, side in enumerate((engine.a, engine.b)))
    keep = np.repeat(sound, np.diff(first))
    docs, size = given[sound], np.diff(first)[sound]
    start = np.concatenate([[0], np.cumsum(size)])
    sides = []
    for k in (0, 1):
        per_unit = _lists([f[k] for f in found], which[keep])
        per_doc = pa.ListArray.from_arrays(pa.array(per_unit.offsets.to_numpy()[start] - per_unit.offsets[0].as_py(), pa.int32()), per_unit.flatten())
        sides.append(_ends(per_doc, engine.size[k]))
    (a, in_a, end_a), (b, in_b, end_b) = sides
    ends = [pa.table({"doc": d, "end": e, f"at_{n}": np.arange(len(d))}) for n, d, e in (("a", in_a, end_a), ("b", in_b, end_b))]
    both = ends[0].join(ends[1], keys=["doc", "end"], join_type="inner", use_threads=False).sort_by("at_a")
    cut_a, cut_b, cut_in = (both.column(c).combine_chunks().to_numpy() for c in ("at_a", "at_b", "doc"))
    # One axis for all documents: a document's bytes follow those of the one before.
    base = np.concatenate([[0], np.cumsum(np.diff(at)[sound])])[:-1]
    axis_a, axis_b = end_a + base[in_a], end_b + base[in_b]
    every = np.sort(np.concatenate([axis_a, np.delete(axis_b, cut_b)]), kind="stable")
    of_a, of_b = np.searchsorted(axis_a, every), np.searchsorted(axis_b, every)
    pairs = pa.table({"doc": in_a[of_a], "a": a[of_a], "b": b[of_b]}).group_by(["doc", "a", "b"], use_threads=False).aggregate([([], "count_all")]).sort_by("doc")
    out = {}
    n = len(docs)
    for name, of in (("n_a", in_a), ("n_b", in_b), ("n_groups", cut_in), ("n_links", in_a[of_a])):
        value = zero.copy()
        value[docs] = np.bincount(of, minlength=n)
        out[name] = pa.array(value)
    group_a, group_b = np.concatenate([[0], cut_a + 1]), np.concatenate([[0], cut_b + 1])
    per_group = pc.binary_join_element_wise(
        _joined(engine.digits[0].take(pa.array(a)), group_a, ","), _joined(engine.digits[1].take(pa.array(b)), group_b, ","), "|"
    )
    groups = np.concatenate([[0], np.cumsum(np.bincount(cut_in, minlength=n))])
    said = _joined(per_group, groups, ";").to_pylist()
    hashes = [""] * rows
    for d, text in zip(docs.tolist(), said):
        hashes[d] = hashlib.sha256(text.encode()).hexdigest()
    out["groups_sha256"] = pa.array(hashes)
    count = zero.copy()
    count[docs] = np.bincount(pairs.column("doc").combine_chunks().to_numpy(), minlength=n)
    lists = pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32))
    for name, column_ in (("pair_a", "a"), ("pair_b", "b"), ("pair_n", "count_all")):
        out[name] = pa.ListArray.from_arrays(lists, pairs.column(column_).combine_chunks().cast(pa.int32()))
    if whole:
        texts = [None] * rows
        for d, text in zip(docs.tolist(), said):
            texts[d] = text
        out["groups"] = pa.array(texts, pa.string())
    return out


_COLUMNS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pair_a array<int>, pair_b array<int>, pair_n array<int>"


def align(docs: DataFrame, files: Tokenizers | None = None, id: str = "doc_id", text: str = "text", whole: bool = False) -> DataFrame:
    """Every row's alignment: its ``id``, a number ``_row`` that tells rows apart, counts of tokens, groups and
    links, the digest of its groups, and how often each pair of ids is linked.

    With ``whole`` the groups themselves follow in ``groups``, written
    ``a1,a2|b1;a3|b2``. Side A takes a space and the text; side B adds the space
    itself. A null or empty text, or one that a side does not give back byte by
    byte, has no tokens: zeros, an empty digest, empty lists and null groups.

    Texts are cut before spaces where that changes no token, and a cut piece is
    tokenized once per worker. A slice of about 1 MB is held at a time, or one longer
    text with about 100 bytes a byte of it; only a text without spaces is tokenized
    in one go. Repeated rows and ids are rows of their own; other columns are not read.
    """
    files = files or read()
    handle, name = shipped(docs.sparkSession, files), files.name

    def run(batches):
        engine = _engine(handle, name)
        for batch in batches:
            for part in T.slices(batch):
                found = _aligned(engine, part.column(1), whole)
                yield pa.RecordBatch.from_arrays([part.column(0), *found.values()], ["id", *found])

    rows = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, {_COLUMNS}" + (", groups string" if whole else ""))
    return settled(out.withColumn("_row", F.monotonically_increasing_id()), "aligned")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``a, b, links, best``: how many links of the corpus hold the pair, and whether
    no pair of its B id has more. Ties are all best."""
    each = aligned.select(F.explode(F.arrays_zip("pair_a", "pair_b", "pair_n")).alias("p")).select("p.*")
    counts = each.groupBy(F.col("pair_a").alias("a"), F.col("pair_b").alias("b")).agg(F.sum("pair_n").alias("links"))
    counts = settled(counts, "pair-counts")
    most = counts.groupBy(F.col("b").alias("_b")).agg(F.max("links").alias("_most"))
    return settled(counts.join(most, F.col("b") == F.col("_b")).select("a", "b", "links", (F.col("links") == F.col("_most")).alias("best")), "pair-counts")


def scored(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """The rows of ``aligned`` without their pairs, with ``n_best`` and ``count_sum``.

    Counts are broadcast below a counted size. Beyond it both sides are shuffled on
    the pair; both are read as written, so a pair that very many documents hold is
    split by the adaptive skew join.
    """
    each = aligned.select("_row", F.explode(F.arrays_zip("pair_a", "pair_b", "pair_n")).alias("p")).select("_row", F.col("p.pair_a").alias("a"), F.col("p.pair_b").alias("b"), F.col("p.pair_n").alias("n"))
    if counts.count() <= _BROADCAST_ROWS:
        counts = F.broadcast(counts)
    sums = each.join(counts, ["a", "b"]).groupBy("_row").agg(
        F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("links")).alias("count_sum")
    )
    out = aligned.drop("pair_a", "pair_b", "pair_n").join(sums, "_row", "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast("long")) for c in ("n_best", "count_sum")})
