"""Toxic terms and their misspellings, scored by what stands around them.

A lexicon is learned from labelled texts: words, and beginnings of words that
many toxic words share. Its trie is intersected with the Levenshtein automaton of
one error and made deterministic, so that every word of a text is matched against
all terms and all their misspellings in one walk. Terms, errors and quotation
have learned weights; a text's score is a logistic function of its hits.
"""

from __future__ import annotations

import math
import pickle
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import texts as T
from .scratch import settled, shipped, unused

# Characters that open or close a quotation, by kind; a pair is of one kind.
QUOTES = ('"', "“”„", "«»", "‹›", "'‘’‚")
_OPENING, _CLOSING, _EITHER = "“„«‹‘‚", "”»›’", "\"'"
_QUOTATION = r"""["“„«‹][^"“”«»‹›\n]{1,80}["“”»›]"""

# First and last code points of scripts written without spaces (Thai
# and Lao, Myanmar, Khmer, kana, Han). A word may begin at any of their letters.
_UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3347F))
_UNSPACED_CLASS = "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in _UNSPACED) + "]"
_GRAM = 4  # letters of such a script that are looked at together; a longer term begins with as telling a one


@dataclass(frozen=True)
class Model:
    """``step`` is the automaton (state x class), ``hit`` the pattern a word ends
    on (-1: none), ``terms`` the patterns as (term, kind), and ``weight`` their
    log odds plain and quoted. ``coef`` weighs a text's features."""

    alphabet: str
    step: np.ndarray
    hit: np.ndarray
    terms: tuple[tuple[str, str], ...]
    weight: np.ndarray
    coef: np.ndarray


def sample(df: DataFrame, text: str, label: str, per_class: int) -> DataFrame:
    """At most ``per_class`` labelled texts of each class, by a hash of the text."""
    rows = df.select(F.col(f"`{text}`").alias("text"), F.col(f"`{label}`").cast("int").alias("label")).filter("text is not null and label in (0, 1)")
    w = Window.partitionBy("label").orderBy(F.xxhash64("text"), "text")
    return rows.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= per_class).select("text", "label")


def _chance(bad: int, n: int, p: float) -> float:
    """Probability of ``bad`` or more toxic texts among ``n`` where the share of toxic texts is ``p``."""
    if bad <= n * p:
        return 1.0
    term = math.exp(math.lgamma(n + 1) - math.lgamma(bad + 1) - math.lgamma(n - bad + 1) + bad * math.log(p) + (n - bad) * math.log(1 - p))
    total = 0.0
    for k in range(bad, n + 1):  # terms fall from here on
        total += term
        term *= (n - k) / (k + 1) * p / (1 - p)
        if term <= total * 1e-17:
            break
    return min(total, 1.0)


def _grams(runs: DataFrame) -> DataFrame:
    """``doc, label, term``: up to ``_GRAM`` characters from every letter of an unspaced script."""
    at = runs.filter(F.col("word").rlike(_UNSPACED_CLASS)).select("doc", "label", "word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("i"))
    cut = F.expr(f"transform(sequence(1, least({_GRAM}, length(word) - i + 1)), n -> substring(word, i, n))")
    return at.filter(F.expr("substring(word, i, 1)").rlike(_UNSPACED_CLASS)).select("doc", "label", F.explode(cut).alias("term"))


def _mine(rows: DataFrame, support: int, level: float, ratio: float) -> list[tuple[str, bool]]:
    """Terms as (text, is a beginning of words): all that tell toxic texts.

    A term is in ``support`` toxic texts at least, its odds are more than ``ratio``
    times those of all texts, and they pass a binomial test by the rule of Benjamini
    and Hochberg, so about the share ``level`` of the terms taken is there by chance.
    Terms of any length count: words, beginnings that many words share, and in
    scripts without spaces any characters in a row. The sample bounds their number.
    """
    told = F.regexp_replace(F.lower("text"), _QUOTATION, " ")  # what is quoted says nothing about the text that quotes it
    words = rows.select(
        F.monotonically_increasing_id().alias("doc"), "label",
        F.explode(F.array_distinct(F.regexp_extract_all(told, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))).alias("word"),
    )
    words = settled(words, "toxic-words")
    grams = _grams(words)
    words = words.filter(~F.col("word").rlike("^" + _UNSPACED_CLASS))
    whole = words.select("label", F.col("word").alias("term"))
    starts = words.filter(F.length("word") > 4).select(
        "doc", "label", "word", F.explode(F.sequence(F.lit(4), F.least(F.lit(9), F.length("word") - 1))).alias("n")
    ).select("doc", "label", F.expr("substring(word, 1, n)").alias("term"), "word")
    met = (F.countDistinct(F.when(F.col("label") == 1, F.col("doc"))).alias("bad"), F.countDistinct("doc").alias("n"))
    both = [
        whole.groupBy("term").agg(F.sum("label").alias("bad"), F.count("*").alias("n")).withColumn("start", F.lit(False)),
        starts.groupBy("term").agg(*met, F.countDistinct("word").alias("kinds")).withColumn("start", F.lit(True)).filter("kinds >= 5"),
        grams.groupBy("term").agg(*met).withColumn("start", F.lit(True)),
    ]
    total = rows.agg(F.sum("label").alias("bad"), F.count("*").alias("n")).first()
    if not total["n"] or not total["bad"] or total["bad"] == total["n"]:
        return []
    odds = total["bad"] / (total["n"] - total["bad"])
    union = both[0].select("term", "start", "bad", "n")
    for more in both[1:]:
        union = union.unionByName(more.select("term", "start", "bad", "n"))
    union = settled(union.filter(F.col("n") >= support), "toxic-terms")
    tests = union.count()
    share, telling = odds / (1 + odds), ratio * odds / (1 + ratio * odds)
    likely = union.filter((F.col("bad") >= support) & (F.col("bad") > F.col("n") * telling)).select("term", "start", "bad", "n").collect()  # no more than the sample has words in ``support`` texts
    ranked = sorted((_chance(r["bad"], r["n"], share), r["term"], r["start"], r["bad"]) for r in likely)
    passed = max((k for k, r in enumerate(ranked, 1) if r[0] <= level * k / tests), default=0)
    found = [(term, start, bad) for _, term, start, bad in ranked[:passed]]
    # Of nested beginnings the one that catches most stays, the longest on ties; whole terms stay beside them.
    kept: list[tuple[str, bool, int]] = []
    heads: set[str] = set()
    inner: set[str] = set()  # what the kept beginnings begin with
    for term, start, bad in sorted(found, key=lambda x: (-x[2], -len(x[0]) if x[1] else 0, x[0])):
        if start and term not in inner and not any(term[:n] in heads for n in range(1, len(term) + 1)):
            kept.append((term, True, bad))
            heads.add(term)
            inner.update(term[:n] for n in range(1, len(term)))
    kept += [f for f in found if not f[1]]
    return [(t, s) for t, s, _ in sorted(kept, key=lambda x: (-x[2], x[0], x[1]))]


def compile_terms(terms: list[tuple[str, bool]], fuzzy_from: int = 5, begin_from: int | None = None):
    """The deterministic automaton of all terms within one error.

    Whole terms of ``fuzzy_from`` characters or more also match with one
    insertion, deletion or substitution, and so do beginnings of ``begin_from``
    or more, whatever follows; other beginnings, and all if it is null, match
    exactly. Returns alphabet, step table, pattern of each state, patterns.
    """
    least = {False: fuzzy_from, True: 1 << 30 if begin_from is None else begin_from}
    alphabet = "".join(sorted({c for t, _ in terms for c in t}))
    children: list[dict[str, int]] = [{}]
    whole: dict[int, str] = {}
    begin: dict[int, str] = {}
    fuzzy: set[int] = {0}
    for term, start in terms:
        at = 0
        for c in term:
            at = children[at].setdefault(c, len(children))
            if at == len(children):
                children.append({})
            if len(term) >= least[start]:
                fuzzy.add(at)
        (begin if start else whole)[at] = term
    patterns: dict[tuple[str, str], int] = {}

    def close(states) -> frozenset:
        out, todo = set(states), list(states)
        while todo:
            node, errors = todo.pop()
            if errors == 0 and node in fuzzy:
                for child in children[node].values():  # a missing character
                    if child in fuzzy and (child, 1) not in out:
                        out.add((child, 1))
                        todo.append((child, 1))
        # A beginning, once met, holds for the rest of the word; what can't tell more than it goes.
        ended = {(-n, e) for n, e in out if n in begin and (e == 0 or len(begin[n]) >= least[True])} | {x for x in out if x[0] < 0}
        if ended:
            errors, _, node = min((e, begin[-n], n) for n, e in ended)
            out = {(n, e) for n, e in out if n >= 0 and (errors or not e)} | {(node, errors)}
        return frozenset(out)

    def go(state: frozenset, c: str | None) -> frozenset:
        out = set()
        for node, errors in state:
            if node < 0:
                out.add((node, errors))
                continue
            child = children[node].get(c) if c is not None else None
            if child is not None and (errors == 0 or child in fuzzy):
                out.add((child, errors))
            if errors == 0 and node in fuzzy:
                out.add((node, 1))
                out.update((x, 1) for x in children[node].values() if x in fuzzy)
        return close(out)

    def accepts(state: frozenset) -> int:
        found = []
        for node, errors in state:
            if node < 0:
                found.append((2, begin[-node], "begin") if errors == 0 else (4, begin[-node], "near begin"))
            elif node in whole and (errors == 0 or len(whole[node]) >= fuzzy_from):
                found.append((0 if errors == 0 else 3, whole[node], "exact" if errors == 0 else "near"))
        return patterns.setdefault(min(found)[1:], len(patterns)) if found else -1

    first = close({(0, 0)})
    ids, rows, hits, queue = {first: 0, frozenset(): 1}, [], [], [first, frozenset()]
    for state in queue:
        row = []
        follow = {c for node, _ in state if node >= 0 for c in children[node]}
        other = go(state, None)  # where every character leads that continues no term
        for c in [None, *alphabet]:
            to = go(state, c) if c in follow else other
            if to not in ids:
                ids[to] = len(queue)
                queue.append(to)
            row.append(ids[to])
        rows.append(row)
        hits.append(accepts(state))
    return alphabet, np.array(rows, np.int32), np.array(hits, np.int32), tuple(patterns)


def _reach(terms) -> int:
    """Characters after which no whole term can end any more."""
    return max((len(t) for t, _ in terms), default=0) + 2


def _hits(column: pa.Array, alphabet: str, step: np.ndarray, hit: np.ndarray, reach: int):
    """Words that end in an accepting state: pattern, row, word, start, end; and word counts.

    In a script without spaces a word begins at every letter and is ``_GRAM`` long.
    """
    points, offsets = T.codepoints(column)
    rows = len(offsets) - 1
    table = T.tables()
    letters = T.look(table["letter"], points) | T.look(table["digit"], points)
    starts, ends, row = T.runs(letters, offsets)
    counts = np.bincount(row, minlength=rows)
    if not starts.size:
        zero = np.zeros(0, np.int64)
        return zero, zero, zero, zero, zero, counts, points, offsets
    unspaced = np.zeros(T._PLANE, bool)
    for low, high in _UNSPACED:
        unspaced[low : high + 1] = True
    inner = np.flatnonzero(T.look(unspaced, points) & letters)
    if inner.size:
        run = np.searchsorted(starts, inner, "right") - 1
        spaced = ~T.look(unspaced, points[starts])
        starts, ends, row = (
            np.concatenate([mine[spaced], more]) for mine, more in ((starts, inner), (ends, np.minimum(inner + _GRAM, ends[run])), (row, row[run]))
        )
        order = np.argsort(starts, kind="stable")
        starts, ends, row = starts[order], ends[order], row[order]
    classes = np.zeros(T._PLANE, np.int32)
    for i, c in enumerate(alphabet):
        classes[ord(c)] = i + 1
    kind = T.look(classes, T.look(table["lower"], points))
    state = np.zeros(starts.size, np.int32)
    live = np.arange(starts.size)
    size = ends - starts
    for t in range(int(size.max())):
        live = live[size[live] > t]
        if not live.size:
            break
        state[live] = step[state[live], kind[starts[live] + t]]
        going = state[live] != 1
        if t >= reach:  # only words that began with a term can still match
            going &= hit[state[live]] >= 0
            state[live[~going]] = 1
            break
        live = live[going]
    found = np.flatnonzero(hit[state] >= 0)
    return hit[state[found]].astype(np.int64), row[found], found, starts[found], ends[found], counts, points, offsets


def _points(characters: str) -> np.ndarray:
    return np.array([ord(c) for c in characters], np.uint32)


def _marks(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of quotation marks, and which of them can open and close.

    Marks with a direction take it, or the other where they touch a word on that
    side alone („x“, »x«); straight ones go by what they touch. A single mark
    between two letters is an apostrophe.
    """
    at = np.flatnonzero(np.isin(points, _points("".join(QUOTES))))
    mark, text = points[at], np.searchsorted(offsets, at, "right") - 1
    table = T.tables()
    sides = []
    for there, outside in ((at - 1, at == offsets[text]), (at + 1, at + 1 == offsets[text + 1])):
        beside = points[np.clip(there, 0, max(points.size - 1, 0))]
        word = (T.look(table["letter"], beside) | T.look(table["digit"], beside)).astype(bool)
        sides.append((word & ~outside, outside | T.look(table["space"], beside).astype(bool)))
    (word_before, blank_before), (word_after, blank_after) = sides
    inside = word_before & word_after
    either = np.isin(mark, _points(_EITHER))
    opens = np.where(either, inside | ~word_before & (~blank_after | blank_before), np.isin(mark, _points(_OPENING)) | np.isin(mark, _points("“”«»‹›‘’")) & ~word_before & word_after)
    closes = np.where(either, inside | ~word_after & (~blank_before | blank_after), np.isin(mark, _points(_CLOSING)) | np.isin(mark, _points("“”«»‹›‘’")) & ~word_after & word_before)
    stays = ~(inside & np.isin(mark, _points("'’")))
    return at[stays], opens[stays], closes[stays]


def _quoted(points: np.ndarray, offsets: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray, window: int) -> np.ndarray:
    """Whether a pair of quotation marks of one kind stands around, each within
    ``window`` characters and in the same text: the last before opens and the first behind closes."""
    out = np.zeros(len(row), bool)
    if not len(row):
        return out
    low, high = np.maximum(start - window, offsets[row]), np.minimum(end + window, offsets[row + 1])
    every, opening, closing = _marks(points, offsets)
    for kind in QUOTES:
        own = np.isin(points[every], _points(kind))
        at, opens, closes = every[own], opening[own], closing[own]
        if at.size > 1:
            before, behind = np.searchsorted(at, start) - 1, np.searchsorted(at, end)
            paired = (before >= 0) & (behind < at.size)
            before, behind = np.maximum(before, 0), np.minimum(behind, at.size - 1)
            out |= paired & (at[before] >= low) & (at[behind] < high) & opens[before] & closes[behind]
    return out


def _features(pattern, row, quoted, weight, counts) -> np.ndarray:
    """Per text: plain and quoted hits' weight (damped), strongest hit, hits per word."""
    rows = len(counts)
    worth = weight[pattern, quoted.astype(int)] if len(pattern) else np.zeros(0)
    plain = np.bincount(row, np.where(quoted, 0, worth), rows)
    told = np.bincount(row, np.where(quoted, worth, 0), rows)
    top = np.zeros(rows)
    np.maximum.at(top, row, worth)
    dense = np.bincount(row, worth, rows) / np.sqrt(np.maximum(counts, 1))
    damp = lambda x: np.sign(x) * np.log1p(np.abs(x))
    return np.stack([np.ones(rows), damp(plain), damp(told), top, dense], 1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton's method, both classes weighing the same."""
    w = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (w * (y - p)) - ridge * b
        h = (x * (w * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(b))
        step = np.linalg.solve(h, g)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


def train(df: DataFrame, text: str = "text", label: str = "toxic", per_class: int = 3000, support: int = 6, level: float = 0.05, ratio: float = 2.0, window: int = 40) -> Model:
    """Learn lexicon and weights from at most ``per_class`` labelled texts of each class.

    Texts are chosen by a hash, so the sample does not depend on order or
    partitioning. ``support`` is the number of toxic texts a term must occur in,
    ``ratio`` how many times the odds of all texts its own must be, and ``level`` the
    share of terms that may be there by chance; every such term, however short or
    long, is in the lexicon. Rows with a null text or label are passed over. Without both classes, or without telling terms, no text has hits and
    all score as the larger class.
    """
    rows = settled(sample(df, text, label, per_class), "toxic-sample")
    lexicon = _mine(rows, support, level, ratio)
    if not lexicon:
        mean = rows.agg(F.avg("label").alias("p")).first()["p"] or 0.0
        start = np.array([20.0 if mean > 0.5 else -20.0, 0, 0, 0, 0])
        return Model("", np.array([[0], [1]], np.int32), np.array([-1, -1], np.int32), (), np.zeros((0, 2)), start)
    alphabet, step, hit, patterns = compile_terms(lexicon, begin_from=5)
    found, sizes, labels, at = [], [], [], 0
    for part in _pieces(rows):
        pattern, row, _, start, end, counts, points, offsets = _hits(part.column("text"), alphabet, step, hit, _reach(patterns))
        found.append(np.stack([pattern, row + at, _quoted(points, offsets, row, start, end, window)]).astype(np.int64))
        sizes.append(counts)
        labels.append(np.array(part.column("label").to_pylist(), float))
        at += len(counts)
    pattern, row, quoted = np.concatenate(found, 1)
    counts, y = np.concatenate(sizes), np.concatenate(labels)
    quoted = quoted.astype(bool)
    # Log odds of a text that holds the pattern, from distinct (pattern, quoted, text).
    weight = np.zeros((len(patterns), 2))
    seen: dict[tuple[int, int], set] = defaultdict(set)
    for p, q, r in zip(pattern.tolist(), quoted.tolist(), row.tolist()):
        seen[p, int(q)].add(r)
    number = {x: p for p, x in enumerate(patterns)}
    for p, (term, kind) in enumerate(patterns):  # a word that is a term tells of its beginning too
        for n in range(1, len(term)) if kind == "exact" else ():
            begin = number.get((term[:n], "begin"))
            for q in (0, 1) if begin is not None else ():
                seen[begin, q] |= seen[p, q]
    base = math.log(y.sum() / (1 - y).sum())
    for p in range(len(patterns)):
        plain = y[list(seen[p, 0])]
        weight[p, 0] = math.log((plain.sum() + 0.5) / ((1 - plain).sum() + 0.5)) - base
        told = y[list(seen[p, 1])]
        weight[p, 1] = math.log((told.sum() + 0.5) / ((1 - told).sum() + 0.5)) - base if len(told) else min(0.0, weight[p, 0])
    # A misspelling seen in few texts takes most of its weight from the term itself.
    for p, (term, kind) in enumerate(patterns):
        right = number.get((term, {"near": "exact", "near begin": "begin"}.get(kind)))
        if right is not None:
            n, whole = len(seen[p, 0]), weight[right, 0]
            weight[p, 0] = (n * weight[p, 0] + 2 * 0.6 * whole) / (n + 2)
    coef = _logistic(_features(pattern, row, quoted, weight, counts), y)
    return Model(alphabet, step, hit, patterns, weight, coef)


def _pieces(rows: DataFrame):
    """The sample on the driver, in pieces; its size is bounded by the sample's parameters."""
    table = rows.toArrow()
    for batch in table.to_batches(max_chunksize=256):
        yield from T.slices(batch)


def score(df: DataFrame, model: Model, id: str = "doc_id", text: str = "text", window: int = 40, keep: list[str] | None = None, into: str = "toxicity") -> DataFrame:
    """Score every row: ``id, score, hits``, or the columns ``keep`` and ``into``.

    ``hits`` lists term, kind (exact, near, begin, near begin), whether it is quoted, and the
    span in code points. A null or empty text has no hits and the score of a text
    without hits. Rows are independent; repeated ids stay repeated.
    """
    spark = df.sparkSession
    scored_name = unused(keep or [id], "_scored")
    shared = shipped(spark, model)  # the training sample bounds the lexicon

    def work(batches):
        m = pickle.loads(shared.value)
        names = pa.array([t for t, _ in m.terms], pa.string())
        kinds = pa.array([k for _, k in m.terms], pa.string())
        for batch in batches:
            for part in T.slices(batch, scored_name):
                pattern, row, _, start, end, counts, points, offsets = _hits(part.column(scored_name), m.alphabet, m.step, m.hit, _reach(m.terms))
                quoted = _quoted(points, offsets, row, start, end, window)
                x = _features(pattern, row, quoted, m.weight, counts)
                value = 1 / (1 + np.exp(-np.clip(x @ m.coef, -30, 30)))
                if keep is not None:
                    yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array(value)], names=[*keep, into])
                    continue
                lists = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(counts)))]), pa.int32())
                index = pa.array(pattern, pa.int64())
                items = pa.StructArray.from_arrays(
                    [names.take(index), kinds.take(index), pa.array(quoted.astype(bool), pa.bool_()), pa.array(start - offsets[row], pa.int64()), pa.array(end - offsets[row], pa.int64())],
                    names=["term", "kind", "quoted", "start", "end"],
                )
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(value), pa.ListArray.from_arrays(lists, items)], names=["id", "score", "hits"])

    scored = F.col(f"`{text}`").alias(scored_name)
    if keep is not None:
        rows = df.select(*[F.col(f"`{c}`") for c in keep], scored)
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
        return rows.mapInArrow(work, f"{fields}, `{into}` double")
    rows = df.select(F.col(f"`{id}`").alias("id"), scored)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(work, f"id {kind}, score double, hits array<struct<term:string,kind:string,quoted:boolean,start:long,end:long>>")
