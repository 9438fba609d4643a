"""Line quality by a linear-chain conditional random field, and document quality.

Every line gets features of itself and of its neighbours, cut into bins. The
field labels the lines of a text good or bad together; the length-weighted mean
of the lines' marginals, calibrated on the training texts, is the text's quality.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import texts as T
from .scratch import settled, shipped
from .toxicity import _logistic, sample

FEATURES = ("length", "upper", "digit", "symbol", "word_length", "repeated_next", "repeated_in_line", "seen_line", "doubled_symbols", "single_letters", "end_mark")


@dataclass(frozen=True)
class Model:
    """``cuts`` bounds the bins of each feature; ``emit`` weighs feature x place
    (itself, line before, line after) x bin x label; ``step`` weighs label pairs;
    ``scale`` maps the mean marginal's logit and its square to quality."""

    cuts: np.ndarray
    emit: np.ndarray
    step: np.ndarray
    scale: np.ndarray


def _hashes(spans: T.Spans) -> np.ndarray:
    own = spans["value"]
    return T.mix(own + T.mix(spans["place"] - own * spans.bounds[0].astype(np.uint64)))


def _lines(column: pa.Array, piece: int = T.SLICE):
    """Features of all non-empty lines: matrix, row of each line, its length; number of rows.

    Characters are looked at in pieces, so beside its code points a long text holds
    arrays of its lines and words only.
    """
    points, offsets = T.codepoints(column)
    rows = len(offsets) - 1
    starts, ends, row = T.runs(points != 10, offsets)
    n = starts.size
    if not n:
        return np.zeros((0, len(FEATURES)), np.float32), row, ends - starts, rows
    table = T.tables()
    space = np.empty(points.size, bool)
    for at in range(0, points.size, piece):
        space[at : at + piece] = T.look(table["space"], points[at : at + piece])
    # Words and their hashes: a word is a run without white space.
    bounds = np.append(starts, points.size) if starts[0] == 0 else np.concatenate([[0], starts, [points.size]])
    w_start, w_end, _ = T.runs(~space, bounds)
    lines, said = T.Spans(starts, ends), T.Spans(w_start, w_end)
    heads = offsets[:-1]
    carried: dict[str, np.generic] = {}
    for at in range(0, points.size, piece):
        part = points[at : at + piece]
        letter, digit, upper = (T.look(table[x], part) for x in ("letter", "digit", "upper"))
        symbol = ~(letter | digit | space[at : at + piece])
        again = symbol.copy()
        again[1:] &= part[1:] == part[:-1]
        again[0] &= at > 0 and part[0] == points[at - 1]
        again[heads[(heads >= at) & (heads < at + part.size)] - at] = False
        value = T.mix(T.look(table["lower"], part).astype(np.uint64) + np.uint64(1))
        place = value * np.arange(at + 1, at + 1 + part.size, dtype=np.uint64)
        for name, found in (("letter", letter), ("digit", digit), ("upper", upper), ("symbol", symbol), ("again", again), ("value", value), ("place", place)):
            total = np.zeros(part.size + 1, np.int64 if found.dtype == bool else np.uint64)
            np.cumsum(found, out=total[1:])
            total += carried.get(name, total[0])
            carried[name] = total[-1]
            lines.add(name, total, at)
            if found.dtype != bool:
                said.add(name, total, at)
    size, letters = (ends - starts).astype(np.float64), lines["letter"].astype(np.float64)
    word, short = _hashes(said), w_end - w_start == 1
    line = np.searchsorted(starts, w_start, "right") - 1
    del said, w_start, w_end, space
    words = np.bincount(line, minlength=n).astype(np.float64)
    next_same = np.zeros(word.size, bool)
    next_same[1:] = (word[1:] == word[:-1]) & (line[1:] == line[:-1])
    key = T.mix(word ^ T.mix(line.astype(np.uint64) + np.uint64(7)))
    del word
    order = np.argsort(key)
    key = key[order]
    fresh = np.ones(key.size, bool)
    fresh[order[1:]] = key[1:] != key[:-1]
    del key, order
    distinct = np.bincount(line, fresh, n)
    line_hash = T.mix(_hashes(lines) ^ T.mix(row.astype(np.uint64) + np.uint64(11)))
    _, inverse, count = np.unique(line_hash, return_inverse=True, return_counts=True)
    many = np.maximum(words, 1)
    x = np.stack([
        np.log1p(size), lines["upper"] / np.maximum(letters, 1), lines["digit"] / size, lines["symbol"] / size, letters / many,
        np.bincount(line, next_same, n) / many, 1 - distinct / many, np.log(count[inverse].astype(float)), lines["again"] / size,
        np.bincount(line, short, n) / many, np.isin(points[ends - 1], np.array([ord(c) for c in ".!?:;…\"”»"], np.uint32)),
    ], 1)
    return x.astype(np.float32), row, ends - starts, rows


def _bins(x: np.ndarray, row: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Bin of each feature of a line, of the line before and of the line after; the
    last bin stands for a missing neighbour. Shape: lines x 3 x features."""
    n, f = x.shape
    missing = cuts.shape[1] + 1
    own = np.stack([np.searchsorted(cuts[i], x[:, i], "right") for i in range(f)], 1) if n else np.zeros((0, f), np.int64)
    out = np.full((n, 3, f), missing, np.int64)
    out[:, 0] = own
    same = row[1:] == row[:-1]
    out[1:, 1][same] = own[:-1][same]
    out[:-1, 2][same] = own[1:][same]
    return out


def _emissions(bins: np.ndarray, emit: np.ndarray) -> np.ndarray:
    score = np.zeros((len(bins), 2))
    for p in range(3):
        for i in range(bins.shape[2]):
            score += emit[i, p, bins[:, p, i]]
    return score


def _marginals(score: np.ndarray, row: np.ndarray, rows: int, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward over all texts in lockstep.

    Returns each line's marginals, the expected label pairs summed over all
    texts, and the log partition functions' sum.
    """
    n = len(score)
    count = np.bincount(row, minlength=rows)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    order = np.argsort(-count, kind="stable")
    most = int(count.max()) if rows else 0
    alive = [first[order[: int(np.searchsorted(-count[order], -t, "left"))]] + t for t in range(most)]
    ahead, back = np.zeros((n, 2)), np.zeros((n, 2))
    for t, at in enumerate(alive):
        if t == 0:
            ahead[at] = score[at]
        else:
            both = ahead[at - 1][:, :, None] + step
            ahead[at] = np.logaddexp(both[:, 0], both[:, 1]) + score[at]
    for t in range(most - 2, -1, -1):
        at = alive[t + 1]
        both = step + (score[at] + back[at])[:, None, :]
        back[at - 1] = np.logaddexp(both[:, :, 0], both[:, :, 1])
    total = np.zeros(rows)
    if most:
        last = order[: len(alive[0])]
        tops = ahead[first[last] + count[last] - 1]
        total[last] = np.logaddexp(tops[:, 0], tops[:, 1])
    z = total[row]
    marginal = np.exp(ahead + back - z[:, None])
    pairs = np.zeros((2, 2))
    inner = np.flatnonzero(row[1:] == row[:-1])
    if inner.size:
        joint = ahead[inner][:, :, None] + step + (score[inner + 1] + back[inner + 1])[:, None, :] - z[inner][:, None, None]
        pairs = np.exp(joint).sum(0)
    return marginal, pairs, float(total.sum())


def _mean(marginal: np.ndarray, row: np.ndarray, size: np.ndarray, rows: int) -> np.ndarray:
    """Length-weighted mean of the lines' chance of being good; 0.5 without lines."""
    weight = np.bincount(row, size, rows)
    good = np.bincount(row, size * marginal, rows)
    return np.where(weight > 0, good / np.maximum(weight, 1), 0.5)


def _inputs(mean: np.ndarray) -> np.ndarray:
    p = np.clip(mean, 1e-6, 1 - 1e-6)
    logit = np.log(p / (1 - p))
    return np.stack([np.ones_like(p), logit, mean], 1)


def fit(x: np.ndarray, row: np.ndarray, size: np.ndarray, y: np.ndarray, bins: int = 8, rounds: int = 150, ridge: float = 1e-3) -> Model:
    """Fit the field by gradient ascent on the conditional likelihood.

    A line takes its text's label. Both classes of texts weigh the same.
    """
    rows = len(y)
    cuts = np.zeros((x.shape[1], bins - 1), np.float32)
    for i in range(x.shape[1]):
        full = x[:, i]
        inside = full[(full > full.min()) & (full < full.max())]
        cuts[i] = np.quantile(inside, np.linspace(0.02, 0.98, bins - 1)) if inside.size > bins else np.linspace(full.min(), full.max(), bins + 1)[1:-1]
    found = _bins(x, row, cuts)
    label = y[row].astype(int)
    emit, step = np.zeros((x.shape[1], 3, bins + 1, 2)), np.zeros((2, 2))
    places = np.arange(3)[None, :, None]
    flat = ((np.arange(x.shape[1])[None, None, :] * 3 + places) * (bins + 1) + found).reshape(len(x), -1)
    width = emit[..., 0].size
    same = np.flatnonzero(row[1:] == row[:-1])
    seen_pairs = np.zeros((2, 2))
    np.add.at(seen_pairs, (label[same], label[same + 1]), 1)
    truth = np.eye(2)[label]
    m = [np.zeros_like(emit), np.zeros_like(step)]
    v = [np.zeros_like(emit), np.zeros_like(step)]
    for t in range(1, rounds + 1):
        marginal, pairs, _ = _marginals(_emissions(found, emit), row, rows, step)
        gap = truth - marginal
        g = np.stack([np.bincount(flat.ravel(), np.repeat(gap[:, c], flat.shape[1]), width) for c in (0, 1)], 1).reshape(emit.shape)
        grads = [g / max(len(x), 1) - ridge * emit, (seen_pairs - pairs) / max(len(x), 1) - ridge * step]
        for i, (w, d) in enumerate(zip((emit, step), grads)):
            m[i] = 0.9 * m[i] + 0.1 * d
            v[i] = 0.99 * v[i] + 0.01 * d * d
            w += 0.1 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.99**t)) + 1e-8)
    marginal, _, _ = _marginals(_emissions(found, emit), row, rows, step)
    mean = _mean(marginal[:, 1], row, size, rows)
    return Model(cuts, emit, step, _logistic(_inputs(mean), y))


def train(df: DataFrame, text: str = "text", label: str = "quality", per_class: int = 2500) -> Model:
    """Fit on at most ``per_class`` labelled texts of each class, chosen by a hash.

    Rows with a null text or label are passed over. Without both classes every
    text scores as the one class there is, or one half.
    """
    rows = settled(sample(df, text, label, per_class), "quality-sample")
    xs, lines, sizes, ys, at = [], [], [], [], 0
    for batch in rows.toArrow().to_batches(max_chunksize=256):  # bounded by per_class
        for part in T.slices(batch):
            x, row, size, n = _lines(part.column("text"))
            xs.append(x)
            lines.append(row + at)
            sizes.append(size)
            ys.append(np.array(part.column("label").to_pylist(), float))
            at += n
    y = np.concatenate(ys) if ys else np.zeros(0)
    if not y.sum() or y.sum() == len(y):
        f = len(FEATURES)
        only = 0.0 if not len(y) else 20.0 if y.sum() else -20.0
        return Model(np.zeros((f, 1), np.float32), np.zeros((f, 3, 3, 2)), np.zeros((2, 2)), np.array([only, 0.0, 0.0]))
    return fit(np.concatenate(xs), np.concatenate(lines), np.concatenate(sizes), y)


def score(df: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Quality of every row and of its lines: ``id, score, lines``.

    ``lines`` lists the chance of being good of every non-empty line in order.
    A null or empty text has no lines and the score that belongs to a mean of one
    half. Rows are independent; repeated ids stay repeated.
    """
    spark = df.sparkSession
    shared = shipped(spark, model)

    def work(batches):
        m = pickle.loads(shared.value)
        for batch in batches:
            for part in T.slices(batch):
                x, row, size, rows = _lines(part.column(1))
                marginal, _, _ = _marginals(_emissions(_bins(x, row, m.cuts), m.emit), row, rows, m.step)
                mean = _mean(marginal[:, 1], row, size, rows)
                value = 1 / (1 + np.exp(-np.clip(_inputs(mean) @ m.scale, -30, 30)))
                lists = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(value), pa.ListArray.from_arrays(lists, pa.array(marginal[:, 1]))], names=["id", "score", "lines"]
                )

    rows = df.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(work, f"id {kind}, score double, lines array<double>")
