"""The licence scan against word-by-word versions."""

from __future__ import annotations

import math
import random
import re

import pytest

from tokenledger.llm import licences
from tokenledger.llm.queries import QUERIES
from tokenledger.llm.scratch import prepare

SMALL = "/root/testdata/sf0.001"
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _words(text):
    raw = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    return [w.decode(errors="replace") for w in _WORD.findall(raw)]


def _starts(words, phrase):
    return [i for i in range(len(words) - len(phrase) + 1) if words[i : i + len(phrase)] == phrase]


def _notice(words, template, weight, lookups, slack):
    mine, n = licences.words(template.text), len(licences.words(template.text))
    rare = sorted(set(mine), key=lambda w: (-weight[w], w))
    asked = [w for w in rare if w in words][:lookups]
    starts = [p - q for w in asked for p, x in enumerate(words) if x == w for q, y in enumerate(mine) if y == w]
    need = sum(mine.count(w) for w in asked)
    best = None
    for d in set(starts):
        if 2 * sum(d <= s <= d + slack for s in starts) < need:
            continue
        low, high = d - slack, d + n + slack
        if all(any(low <= s <= high for s in _starts(words, licences.words(p))) for p in template.phrases):
            near = set(words[max(low, 0) : high + 1])
            best = max(best or 0.0, sum(weight[w] for w in rare if w in near) / sum(weight[w] for w in rare))
    return best


def _expected(rows, templates=licences.BASE + licences.NOTICES, lookups=licences.LOOKUPS, slack=licences.SLACK):
    said = [_words(t) for _, t in rows]
    known = {w for t in templates for p in (t.text, *t.phrases) for w in licences.words(p)}
    sets = [set(w) & known for w in said]
    weight = {w: math.log(1 + len(rows) / max(1, sum(w in s for s in sets))) for w in known}
    out = []
    for (i, _), words in zip(rows, said):
        places, base, labels, best = [], set(), set(), 0.0
        for t in templates:
            if t.exact:
                at = _starts(words, licences.words(t.text))
                places += at
                base |= {t.label} if at else set()
            else:
                score = _notice(words, t, weight, lookups, slack)
                labels |= set() if score is None else {t.label}
                best = max(best, score or 0.0)
        best = 1.0 if places else best
        out.append((i, len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), round(best, 9)))
    return out


def _scanned(spark, rows, **options):
    prepare(spark)
    docs = spark.createDataFrame([(i, t, "x", 3, "y") for i, t in rows], "doc_id long, text string, id string, n_words int, labels string")
    return [(*r[:-1], round(r[-1], 9)) for r in licences.scan(docs, **options).collect()]


def _same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


PLAIN = [
    None, "", " \n.", "mit license", "MIT-License MIT LICENSE, mit\nlicense", "mit x license", "permit license", "the mit licenses", "éMIT License", "MIT Licenseé", "cc by cc by",
    "CC BY-NC 4.0", "GNU General Public License gnu general public license version 3", "apache license apache", "Licensed under the Apache License, Version 2.0.",
    "license mit", "gnu general public", "general public license", "1mit license", "mit license2", "\0mit\0license\0", "语言 mit license 语言", "mit license mit license",
]


def test_phrases_and_places(spark):
    rows = [*enumerate(PLAIN), (None, "mit license"), (4, "again mit license")]
    _same(_scanned(spark, rows), _expected(rows))
    _same(_scanned(spark, []), [])


def test_notices_with_changes(spark):
    r = random.Random(3)
    filler = [w for t in licences.NOTICES for w in licences.words(t.text)] + ["alpha", "beta", "gamma"] * 40
    rows = []
    for i in range(160):
        words = r.choices(filler, k=r.randint(0, 60))
        notice = licences.words(r.choice(licences.NOTICES).text)
        for _ in range(r.choice([0, 0, 1, 3, 8])):
            at = r.randrange(len(notice))
            notice[at : at + r.choice([0, 1])] = r.choices(filler, k=r.choice([0, 1, 2]))
        rows.append((i, " ".join(words[:20] + notice + words[20:])))
    got = _scanned(spark, rows)
    _same(got, _expected(rows))
    assert sum(bool(g[6]) for g in got) > 60
    _same(_scanned(spark, rows, lookups=2, slack=1), _expected(rows, lookups=2, slack=1))


def test_whole_notices_are_named(spark):
    rows = [(i, "some words before. " + t.text.upper().replace(" ", " \n* ") + " and after") for i, t in enumerate(licences.NOTICES)]
    got = {r[0]: r for r in _scanned(spark, rows)}
    for i, t in enumerate(licences.NOTICES):
        assert t.label in got[i][6].split(",") and (got[i][7] == 1.0), t


def test_long_text(spark):
    r = random.Random(4)
    words = [r.choice(["the", "of", "licensed", "software", "x1", "été"]) for _ in range(1_200_000)]
    words[900_000:900_002] = ["MIT", "License"]
    words[1_100_000:1_100_003] = ["CC", "BY", "NC"]
    text = " ".join(words)  # 7 MB, cut into pieces
    got = _scanned(spark, [(1, text), (2, "y" * 5_000_000), (3, "y" * 5_000_000 + " mit license")])
    got = {g[0]: g for g in got}
    assert got[1][1:6] == (1_200_000, 2, 900_000, 1_100_000, "cc-by,mit") and got[2][1:3] == (1, 0) and got[3][1:5] == (3, 1, 1, 1)


@pytest.mark.parametrize("sf", [SMALL])
def test_query_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = [(*r[:-1], round(r[-1], 9)) for r in QUERIES["op11_licences"](spark, sf).collect()]
    _same(got, _expected(rows))
