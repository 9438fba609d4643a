"""Language spans of mixed texts: script ranges, word scores, Viterbi.

A word is a maximal run of letters. Its script narrows the languages that may
claim it; each of those scores the word's letter trigrams; and the best labelling
of a whole text pays a penalty for every switch between neighbouring words.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import texts as T
from .scratch import shipped

# First code points of script blocks, and the script that begins there.
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Indic"), (0x0E00, "Thai"), (0x0E80, "Lao"),
    (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x1780, "Khmer"), (0x1E00, "Latin"),
    (0x1F00, "Greek"), (0x2E80, "Han"), (0x3040, "Kana"), (0x3100, "Han"), (0xAC00, "Hangul"),
    (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB50, "Arabic"), (0xFF00, "Kana"), (0x10000, "Other"),
)
_NAMES = tuple(dict.fromkeys(name for _, name in SCRIPTS))
_STARTS = np.array([start for start, _ in SCRIPTS], np.uint32)
_SCRIPT = np.array([_NAMES.index(name) for _, name in SCRIPTS], np.int16)
_CHUNK = 64  # words per block of the lockstep Viterbi


@dataclass(frozen=True)
class Model:
    """``scores`` has a row per trigram bucket and a column per language: log
    probabilities. ``allowed`` tells which languages use a script."""

    langs: tuple[str, ...]
    scores: np.ndarray
    allowed: np.ndarray


def _words(column: pa.Array, buckets: int):
    points, offsets = T.codepoints(column)
    table = T.tables()
    letter = T.look(table["letter"], points)
    starts, ends, row = T.runs(letter, offsets)
    n_rows = len(offsets) - 1
    if not starts.size:
        return points, starts, ends, row, np.zeros(0, np.int64), np.zeros(0, np.int64), n_rows
    size = ends - starts
    at = np.repeat(starts - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    chars = T.look(table["lower"], points[at]).astype(np.uint64)
    heads = np.concatenate([[0], np.cumsum(size)[:-1]])
    one = np.concatenate([[np.uint64(0)], chars[:-1]])
    one[heads] = 0
    two = np.concatenate([[np.uint64(0)], one[:-1]])
    two[heads] = 0
    gram = T.mix((chars << np.uint64(42)) | (one << np.uint64(21)) | two) % np.uint64(buckets)
    return points, starts, ends, row, gram.astype(np.int64), heads, n_rows


def _script_of(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return _SCRIPT[np.searchsorted(_STARTS, points[starts], "right") - 1]


def train(df: DataFrame, text: str = "text", lang: str = "lang", buckets: int = 1 << 15) -> Model:
    """Count trigrams and scripts over all rows with a language.

    The counts are added up per task before the shuffle; what reaches the driver
    is at most ``buckets`` numbers per language. Rows with a null text or
    language teach nothing; if no row teaches anything, every text is ``und``.
    """
    rows = df.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang")).filter("text is not null and lang is not null")

    def count(batches):
        grams: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in T.slices(batch):
                names = np.array(part.column(1).to_pylist(), object)
                for name in np.unique(names):
                    own = part.filter(pa.array(names == name))
                    points, starts, _, _, gram, _, _ = _words(own.column(0), buckets)
                    held = grams.setdefault(name, np.zeros(buckets + len(_NAMES), np.int64))
                    held[:buckets] += np.bincount(gram, minlength=buckets)
                    if starts.size:
                        held[buckets:] += np.bincount(_script_of(points, starts), minlength=len(_NAMES))
        for name, held in grams.items():
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array([name] * at.size, pa.string()), pa.array(at, pa.int32()), pa.array(held[at])], names=["lang", "bucket", "n"])

    counted = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counted.toPandas()
    if found.empty:
        return Model((), np.zeros((buckets, 0), np.float32), np.zeros((len(_NAMES), 0), bool))
    langs = tuple(sorted(found["lang"].unique()))
    table = np.zeros((buckets + len(_NAMES), len(langs)))
    table[found["bucket"].to_numpy(), [langs.index(x) for x in found["lang"]]] = found["n"].to_numpy()
    grams, scripts = table[:buckets] + 0.5, table[buckets:]
    scores = np.log(grams / grams.sum(0)).astype(np.float32)
    share = scripts / np.maximum(scripts.sum(0), 1)
    allowed = share >= 0.001
    allowed[~allowed.any(1)] = True  # a script nobody uses narrows nothing
    return Model(langs, scores, allowed)


def _viterbi(score: np.ndarray, row: np.ndarray, rows: int, penalty: float) -> np.ndarray:
    """Best label of every word, all rows in lockstep.

    Texts are cut into blocks of words; a block is first summed up as a
    max-plus matrix from the label before it to its last label, the matrices are
    chained per text, and then each block is solved between known ends. The
    result is that of one long pass.
    """
    n, k = score.shape
    count = np.bincount(row, minlength=rows)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    blocks = -(-count // _CHUNK)
    block_row = np.repeat(np.arange(rows), blocks)
    block_no = np.arange(block_row.size) - np.concatenate([[0], np.cumsum(blocks)[:-1]])[block_row]
    place = np.arange(n) - first[row]
    of = np.concatenate([[0], np.cumsum(blocks)[:-1]])[row] + place // _CHUNK
    grid = np.zeros((_CHUNK, block_row.size, k), np.float32)
    grid[place % _CHUNK, of] = score
    same = np.where(np.eye(k, dtype=bool), 0, -penalty).astype(np.float32)
    through = np.broadcast_to(same, (block_row.size, k, k)) + grid[0][:, None, :]
    for t in range(1, _CHUNK):
        through = np.maximum(through, through.max(2, keepdims=True) - penalty) + grid[t][:, None, :]
    # Chain the blocks of each text; texts with more blocks come first.
    order = np.argsort(-blocks, kind="stable")
    start_of = np.concatenate([[0], np.cumsum(blocks)[:-1]])
    most = int(blocks.max()) if rows else 0
    value = np.zeros((rows, k), np.float32)
    came = np.zeros((block_row.size, k), np.int16)
    alive = [order[: int(np.searchsorted(-blocks[order], -j, "left"))] for j in range(most)]
    for j in range(most):
        who = alive[j]
        both = value[who][:, :, None] + through[start_of[who] + j]
        came[start_of[who] + j] = both.argmax(1)
        value[who] = both.max(1)
    end = value.argmax(1)
    ends, begins = np.zeros(block_row.size, np.int16), np.zeros(block_row.size, np.int16)
    for j in range(most - 1, -1, -1):
        who = alive[j]
        at = start_of[who] + j
        ends[at] = end[who]
        begins[at] = came[at, end[who]]
        end[who] = begins[at]
    # Solve every block between its ends.
    state = same[begins] + grid[0]
    backs = np.zeros((_CHUNK, block_row.size, k), np.int16)
    for t in range(1, _CHUNK):
        best = state.argmax(1)
        top = np.take_along_axis(state, best[:, None], 1) - penalty
        stay = state >= top
        backs[t] = np.where(stay, np.arange(k), best[:, None])
        state = np.where(stay, state, top) + grid[t]
    labels = np.zeros((_CHUNK, block_row.size), np.int16)
    now = ends
    for t in range(_CHUNK - 1, -1, -1):
        labels[t] = now
        now = np.take_along_axis(backs[t], now[:, None].astype(np.int64), 1)[:, 0] if t else now
    return labels[place % _CHUNK, of]


def label(df: DataFrame, model: Model, id: str = "doc_id", text: str = "text", penalty: float = 12.0) -> DataFrame:
    """Language of every row and its spans.

    Returns ``id, lang_pred, score, spans``: the language with the most letters
    in the best labelling, its share of all letters, and the maximal runs of words
    of one language as ``start, end, lang`` in code points. A null text or one
    without letters gets ``und``, 0 and no spans; languages that tie are taken
    in alphabetical order. Rows are independent: repeated ids stay repeated.
    """
    spark = df.sparkSession
    shared = shipped(spark, model)  # langs x buckets numbers

    def work(batches):
        own = pickle.loads(shared.value)
        k, buckets = len(own.langs), own.scores.shape[0]
        names = pa.array([*own.langs, "und"], pa.string())
        for batch in batches:
            for part in T.slices(batch):
                points, starts, ends, row, gram, heads, rows = _words(part.column(1), buckets)
                pred, share = np.full(rows, k), np.zeros(rows)
                spans = (np.zeros(0, np.int64),) * 3
                span_row = np.zeros(0, np.int64)
                if starts.size and k:
                    score = np.add.reduceat(own.scores[gram], heads, axis=0)
                    score = np.where(own.allowed[_script_of(points, starts)], score, score.min() - 1e4).astype(np.float32)
                    labels = _viterbi(score - score.max(1, keepdims=True), row, rows, penalty).astype(np.int64)
                    letters = np.bincount(row * k + labels, ends - starts, rows * k).reshape(rows, k)
                    total = letters.sum(1)
                    pred = np.where(total > 0, letters.argmax(1), k)
                    share = letters.max(1) / np.maximum(total, 1)
                    turn = np.flatnonzero(np.concatenate([[True], (labels[1:] != labels[:-1]) | (row[1:] != row[:-1])]))
                    base = T.codepoints(part.column(1))[1][row[turn]]
                    stop = ends[np.append(turn[1:], starts.size) - 1]
                    spans, span_row = (starts[turn] - base, stop - base, labels[turn]), row[turn]
                offsets = np.concatenate([[0], np.cumsum(np.bincount(span_row, minlength=rows))])
                items = pa.StructArray.from_arrays(
                    [pa.array(spans[0], pa.int64()), pa.array(spans[1], pa.int64()), names.take(pa.array(spans[2], pa.int64()))],
                    names=["start", "end", "lang"],
                )
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), names.take(pa.array(pred, pa.int64())), pa.array(share, pa.float64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items)],
                    names=["id", "lang_pred", "score", "spans"],
                )

    rows = df.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(work, f"id {kind}, lang_pred string, score double, spans array<struct<start:long,end:long,lang:string>>")
