"""The alignment of two tokenizers against a token-by-token version."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest

from tokenledger.llm import alignment
from tokenledger.llm.queries import QUERIES
from tokenledger.llm.scratch import prepare

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def engines():
    sentencepiece, tokenizers = pytest.importorskip("sentencepiece"), pytest.importorskip("tokenizers")
    a = tokenizers.Tokenizer.from_file(alignment.BYTE_BPE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=alignment.PIECE_BPE)


def _tokens(engines, text):
    """Ids and bytes of both sides, from the libraries' own calls on whole texts."""
    a, b = engines
    letters = alignment._byte_letters()
    if not text:
        return None
    left = a.encode(" " + text, add_special_tokens=False).ids
    left = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in left]
    right = [(i, bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    whole = (" " + text).encode()
    return (left, right) if b"".join(x for _, x in left) == whole == b"".join(x for _, x in right) else None


def _spans(tokens):
    out, at = [], 0
    for i, token in tokens:
        out.append((i, at, at + len(token)))
        at += len(token)
    return out


def _grouped(side, ends):
    out, k = [[]], 0
    for i, _, t in side:
        out[-1].append(str(i))
        if t == ends[k]:
            out.append([])
            k += 1
    return out[:-1]


def _expected(engines, rows):
    per, counts = [], Counter()
    for _, text in rows:
        found = _tokens(engines, text)
        if not found:
            per.append((0, 0, 0, [], ""))
            continue
        x, y = _spans(found[0]), _spans(found[1])
        ends = sorted({e for *_, e in x} & {e for *_, e in y})
        groups = ["|".join(",".join(g) for g in both) for both in zip(_grouped(x, ends), _grouped(y, ends))]
        # The tokens of both sides at every byte, each pair of occurrences once.
        at = zip([(k, i) for k, (i, s, t) in enumerate(x) for _ in range(s, t)], [(k, j) for k, (j, s, t) in enumerate(y) for _ in range(s, t)])
        links = [(a[1], b[1]) for a, b in dict.fromkeys(at)]
        counts.update(links)
        per.append((len(x), len(y), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = {}
    for (_, j), n in counts.items():
        best[j] = max(best.get(j, 0), n)
    return [
        (i, na, nb, ng, len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), sha)
        for (i, _), (na, nb, ng, links, sha) in zip(rows, per)
    ]


def _scored(spark, rows):
    prepare(spark)
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], "doc_id long, text string, id string, n_a int, _row string")
    found = alignment.align(docs)
    out = alignment.scored(found, alignment.pair_counts(found))
    return [tuple(r) for r in out.select("id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()]


TEXTS = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "  two  spaces  between ", "tab\there \t and no break   x　y  z", "\0 nul \0\0", "<|endoftext|> <s> </s><unk> <0x41>",
    "▁under ▁ x", "café café ﬁne", "語言 語言模型 こんにちは", "\U0001f600 \U0001f468‍\U0001f469‍\U0001f467 ok", "don't we'll I'D 's 'S", "x" * 300 + " " + "é" * 90,
    "1234567890 3.14 1e-9 $5", "line one\r\nline two\n\n\n  indented\n\tend", "same words here", "same words here", "مرحبا नमस्ते", "\x1c \x1d x \x85 y",
]


def test_against_brute_force(spark, engines):
    rows = [*enumerate(TEXTS), (None, "no id"), (3, "repeated id")]
    assert sorted(map(repr, _scored(spark, rows))) == sorted(map(repr, _expected(engines, rows)))
    assert _scored(spark, []) == []


def test_random_texts(spark, engines, monkeypatch):
    r = random.Random(5)
    pieces = [" ", "  ", "\n", "the", "The", "été", "'s", "9", ".", " ", "　", "語", "‍", "ing", "\t", "▁", "<s>", "\x85", "q"]
    rows = [(i, "".join(r.choices(pieces, k=r.randint(1, 40)))) for i in range(600)]
    assert sorted(map(repr, _scored(spark, rows))) == sorted(map(repr, _expected(engines, rows)))


def test_long_texts_and_shuffled_counts(spark, engines, monkeypatch):
    monkeypatch.setattr(alignment, "_BROADCAST_ROWS", -1)
    r = random.Random(6)
    words = ["alpha", "beta", "gamma,", "delta.\n", "épsilon", "42"]
    long = " ".join(r.choices(words, k=700_000))  # 4 MB
    got = {r[0]: r for r in _scored(spark, [(1, long), (2, "alpha beta"), (3, "x" * 20_000)])}
    found = _tokens(engines, long)
    assert got[1][1:3] == (len(found[0]), len(found[1])) and got[1][4] == got[1][1] + got[1][2] - got[1][3] and got[2][1] > 0 and got[3][1] > 0


def test_groups_are_given_back(spark, engines):
    prepare(spark)
    docs = spark.createDataFrame([(1, "the tokenizers disagree"), (2, None)], "doc_id long, text string")
    got = {r.id: r.groups for r in alignment.align(docs, whole=True).collect()}
    assert got[2] is None
    x, y = zip(*[g.split("|") for g in got[1].split(";")])
    found = _tokens(engines, "the tokenizers disagree")
    for side, want in zip((x, y), found):
        assert [int(i) for g in side for i in g.split(",")] == [i for i, _ in want]


def test_query_against_brute_force(spark, engines):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in QUERIES["op12_alignment"](spark, SMALL).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, _expected(engines, rows)))
