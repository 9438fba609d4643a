"""The text operators against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tokenledger.llm import chat, components, decontamination, embeddings, language, mixing, neardup, quality, suffixes, toxicity, urls
from tokenledger.llm import texts as T
from tokenledger.llm.scratch import prepare

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, key int, kept string"


def _words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


LONG = _words(30_000, 1)  # a very long text
BASE = _words(120, 2)
NEAR = BASE.replace(BASE.split()[60], "changed", 1)
TEXTS = [
    None, "", "   \n\t ", "one two", "One TWO", "one two three four five", BASE, BASE, BASE.upper(), NEAR, LONG, LONG[:5000] + " tail " + _words(20, 3),
    "aaaa" * 200, "x " * 400, "é" * 90 + _words(60, 4) + "é" * 90, _words(60, 5) + BASE[:300], "\0" * 210 + "z", "\0" * 210 + "y", "語言" * 120, "😀" * 60 + "a",
]


def _docs(spark, rows=None):
    prepare(spark)
    rows = list(enumerate(TEXTS)) if rows is None else rows
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash", 7, "clash") for i, t in rows], DOCS)


def _repeats(texts, length):
    """What is left of each text, removed bytes and runs, the slow way."""
    raw = [(t or "").encode() for t in texts]
    count = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - length + 1):
            if count[r[i : i + length]] > 1:
                gone[i : i + length] = True
        keep = bytes(b for b, g in zip(r, gone) if not g)
        out.append((len(r), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), keep))
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_repeated_strings(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(suffixes, "_HOT", 0)
        monkeypatch.setattr(suffixes, "_COLLECTION", 3000)
    got = suffixes.dedup(_docs(spark), length=200).orderBy("doc_id").collect()
    want = _repeats(TEXTS, 200)
    assert [(r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got] == want
    assert got[0].text is None and got[0].key == 7 and got[0].id == "clash"
    assert suffixes.dedup(_docs(spark, [])).count() == 0


def test_repeated_strings_in_many_contexts(spark):
    r = random.Random(8)
    passage = _words(80, 31)[:200]
    edge = lambda: "".join(r.choice("abcdefghij") for _ in range(12))
    texts = [edge() + passage + edge() for _ in range(11_000)]  # 2.3 MB of one passage and its contexts
    got = suffixes.dedup(_docs(spark, list(enumerate(texts))), length=200).orderBy("doc_id").collect()
    assert [(x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in got] == _repeats(texts, 200)


def test_routes_fit_their_collections(spark, monkeypatch):
    sizes, search = [], suffixes._search

    def spy(parts, length):
        rows = parts.select("route", "part").distinct().groupBy("route").agg(F.sum(F.length("part") + 1).alias("n")).collect()
        sizes.extend(x.n for x in rows)
        return search(parts, length)

    for name, value in (("_IDS", 13), ("_COLLECTION", 3000), ("_search", spy)):
        monkeypatch.setattr(suffixes, name, value)
    r = random.Random(8)
    passage, rows = _words(200, 31)[:400], list(enumerate(TEXTS))
    rows += [(100 + n, _words(3, n) + passage + "".join(r.choice("ab") for _ in range(9))) for n in range(60)]
    got = suffixes.dedup(_docs(spark, rows), length=200).orderBy("doc_id").collect()
    assert [(x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in got] == _repeats([t for _, t in rows], 200)
    assert max(sizes) <= 2**13 - 1 - 3000
    with pytest.raises(ValueError):
        suffixes.repeated([b"a" * 9000], np.zeros(1, bool), 200)


def test_repeated_strings_keep_characters(spark):
    head = "ü" * 150
    rows = [(1, "a" + head + "q"), (2, "bb" + head + "w")]
    got = suffixes.dedup(_docs(spark, rows), length=200, characters=True).orderBy("doc_id").collect()
    assert [bytes(r.kept).decode() for r in got] == ["aq", "bbw"]


@pytest.mark.parametrize("seed", range(3))
def test_expansion_finds_common_prefixes(seed):
    r = random.Random(seed)
    parts = list({"".join(r.choice("ab") for _ in range(r.randint(1, 90))).encode() for _ in range(40)})
    flags = suffixes.repeated(parts, np.zeros(len(parts), bool), 8)
    count = Counter(p[i : i + 8] for p in parts for i in range(len(p) - 7))
    want = [i + 8 <= len(p) and count[p[i : i + 8]] > 1 for p in parts for i in range(len(p) + 1)]
    assert flags.tolist() == want


def _shingles(text, size):
    w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())


def _groups(rows, size):
    sets = [(i, _shingles(t, size)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets}


def test_near_duplicates(spark):
    r = random.Random(4)
    rows = list(enumerate(TEXTS))
    for n in range(60):  # a group whose members are linked through others
        w = BASE.split()
        for _ in range(n % 7):
            w[r.randrange(len(w))] = f"new{r.randrange(1000)}"
        rows.append((100 + n, " ".join(w)))
    for size in (4, 5):
        got = {x.id: (x.n_shingles, x.component_id, x.kept) for x in neardup.groups(_docs(spark, rows), size=size).collect()}
        assert got == _groups(rows, size)
    assert neardup.groups(_docs(spark, [])).count() == 0
    twice = neardup.groups(_docs(spark, [(5, BASE), (5, BASE), (None, BASE), (None, None)])).collect()
    assert sorted((str(x.id), str(x.component_id), x.kept) for x in twice) == [("5", "5", True), ("5", "5", True), ("None", "5", False), ("None", "None", True)]


def test_signatures_estimate_resemblance():
    r = np.random.Generator(np.random.PCG64(3))
    a = r.integers(0, 2**63, 900, dtype=np.uint64)
    b = np.concatenate([a[:700], r.integers(0, 2**63, 200, dtype=np.uint64)])
    sig = neardup.superminhash(np.concatenate([a, b]), np.repeat([0, 1], 900), 3)
    assert np.isinf(sig[2]).all() and (sig[:2] < neardup.M).all()
    assert abs((sig[0] == sig[1]).mean() - 700 / 1100) < 0.15
    few = neardup.superminhash(a[:2], np.zeros(2, np.int64), 1)
    assert np.isfinite(few).all()  # a set of two elements fills all components


def test_decontamination(spark):
    r = random.Random(9)
    items = [(i, _words(n, 50 + i)) for i, n in enumerate([1, 3, 5, 6, 8, 12, 20, 33, 64, 65, 130, 400])] + [(90, None), (91, ""), (92, BASE)]
    docs = list(enumerate(TEXTS))
    for i, t in items[2:12]:
        w = t.split()
        cut = w[: max(5, int(len(w) * r.choice([0.7, 0.9, 1.0])))]
        docs.append((200 + i, _words(300, 70 + i) + " " + " ".join(cut).title() + " " + _words(200, 80 + i)))
        half = len(w) // 2
        docs.append((300 + i, " ".join(w[:half]) + " " + _words(900, i) + " " + " ".join(w[half:])))
    docs += [(400, items[0][1]), (401, items[1][1] + " "), (402, f"{_words(40, 1)} {items[1][1].upper()}\n{_words(40, 2)}"), (403, items[1][1].rsplit(" ", 1)[0] + " x"), (404, f"{_words(9, 3)} {items[0][1]}")]
    found = decontamination.find(_docs(spark, docs), spark.createDataFrame(items, "item_id int, text string")).collect()
    want = set()
    for d, t in docs:
        for i, x in items:
            size = min(5, max(1, len((x or "").split())))  # a short item is one shingle of all its words
            has, own = _shingles(t, size), _shingles(x, size)
            if own and len(own & has) >= 0.8 * len(own):
                want.add((d, i, len(own & has), len(own)))
    assert {(x.id, x.item, x.shared, x.size) for x in found} == want and len(found) == len(want)
    assert {(402, 1), (404, 0)} <= {x[:2] for x in want} and (403, 1) not in {x[:2] for x in want}
    blocks = decontamination.find(_docs(spark, docs), spark.createDataFrame(items, "item_id int, text string"), block=2).collect()
    assert {(x.id, x.item) for x in blocks} == {x[:2] for x in want}
    assert decontamination.find(_docs(spark), spark.createDataFrame([], "item_id int, text string")).count() == 0
    assert decontamination.find(_docs(spark, []), spark.createDataFrame(items, "item_id int, text string")).count() == 0


def test_word_hashes_follow_the_definition():
    texts = [t for t in TEXTS if t is not None] + ["w" * 9000 + " w" * 3, "w" * 9001]
    column = pa.array(texts)
    data, offsets = T.raw(column)
    words, _, _, row = T.word_hashes(data, offsets)
    names = defaultdict(set)
    flat = [(i, w) for i, t in enumerate(texts) for w in re.findall(rb"[^\x20\x09-\x0d]+", t.encode())]
    assert [i for i, _ in flat] == row.tolist()
    for (_, w), h in zip(flat, words.tolist()):
        names[w.translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))))].add(h)
    assert all(len(x) == 1 for x in names.values())
    assert len({next(iter(x)) for x in names.values()}) == len(names)


def _path_score(v, score, penalty):
    return sum(score[t][x] for t, x in enumerate(v)) - penalty * sum(a != b for a, b in zip(v, v[1:]))


def test_viterbi_is_exact():
    g = np.random.Generator(np.random.PCG64(5))
    row = np.repeat([0, 2, 3], [1, 200, 130])
    score = g.normal(size=(row.size, 3)).astype(np.float32)
    got = language._viterbi(score, row, 4, 1.5)
    for i in (0, 2, 3):
        s = score[row == i].astype(float)
        best = s[0].copy()
        for t in range(1, len(s)):
            best = np.maximum(best, best.max() - 1.5) + s[t]
        assert abs(_path_score(got[row == i].tolist(), s, 1.5) - best.max()) < 1e-3


def test_language(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, "кот и собака", "ru"), (4, None, "en"), (5, "zz", None)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(train)
    docs = _docs(spark, [(1, "the dog and the cat"), (2, "кот the dog"), (3, None), (4, "12 !?"), (5, "и собака и кот " * 3 + "the cat and the dog")])
    got = {r.id: r for r in language.label(docs, model, penalty=2.0).collect()}
    assert (got[1].lang_pred, got[3].lang_pred, got[3].score, got[3].spans, got[4].lang_pred) == ("en", "und", 0.0, [], "und")
    assert [s.lang for s in got[2].spans] == ["ru", "en"] and [s.lang for s in got[5].spans] == ["ru", "en"]
    assert language.label(_docs(spark, []), model).count() == 0
    assert {r.lang_pred for r in language.label(docs, language.train(train.limit(0))).collect()} == {"und"}


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_matches_within_one_error():
    terms = [("stupid", False), ("stupor", False), ("bad", False), ("schlimm", True)]
    alphabet, step, hit, patterns = toxicity.compile_terms(terms)
    r = random.Random(2)
    words = ["stupid", "stupd", "stupidd", "xstupid", "stuqid", "stup", "bad", "bd", "schlimm", "schlimmer", "schlim"]
    words += ["".join(r.choice("stupidorbac") for _ in range(r.randint(2, 8))) for _ in range(2000)]
    for w in words:
        state = 0
        for c in w:
            state = step[state, alphabet.find(c) + 1]
        near = any(_distance(w, t) <= 1 for t, _ in terms[:2]) or w == "bad" or w.startswith("schlimm")
        assert (hit[state] >= 0) == near, w


def test_toxicity(spark):
    clean = [(i, _words(40, i), 0) for i in range(60)]
    rude = [(100 + i, _words(20, 300 + i) + " you blockhead " + _words(20, 500 + i), 1) for i in range(30)]
    told = [(200 + i, _words(20, 700 + i) + " he wrote \"blockhead\" once " + _words(20, 900 + i), 0) for i in range(30)]
    model = toxicity.train(spark.createDataFrame(clean + rude + told, "doc_id long, text string, toxic int"))
    docs = _docs(spark, [(1, _words(30, 9999) + " a BLOCKHEAD here"), (2, "what a blokhead now"), (3, "he said \"blockhead\" then"), (4, None), (5, "plain " * 50), (6, LONG)])
    got = {r.id: r for r in toxicity.score(docs, model).collect()}
    assert got[1].score > 0.5 and got[2].score > 0.5 and got[2].hits[0].kind == "near"
    assert got[3].score < 0.5 and got[3].hits[0].quoted and got[4].score < 0.5 and got[5].score < 0.5 and got[6].score < 0.5
    none = toxicity.train(spark.createDataFrame([], "text string, toxic int"))
    assert {r.score < 0.5 for r in toxicity.score(docs, none).collect()} == {True}
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_automaton_matches_beginnings_within_one_error():
    terms = [("idiot", False), ("stupid", True), ("idio", True), ("stupor", False)]
    alphabet, step, hit, patterns = toxicity.compile_terms(terms, begin_from=5)
    r = random.Random(3)
    words = ["stupidest", "stpidest", "xstupidest", "ztupid", "stup", "stupi", "ideot", "idiots", "iidiot", "1diot"]
    words += ["".join(r.choice("stupidorxe") for _ in range(r.randint(2, 9))) for _ in range(3000)]
    for w in words:
        state = 0
        for c in w:
            state = step[state, alphabet.find(c) + 1]
        begins = any(_distance(w[:n], "stupid") <= 1 for n in range(len(w) + 1))
        near = begins or w.startswith("idio") or any(_distance(w, t) <= 1 for t in ("idiot", "stupor"))
        assert (hit[state] >= 0) == near, w
        if w.startswith("idio") and w != "idiot" or w.startswith("stupid"):
            assert patterns[hit[state]][1] == "begin"


def test_toxicity_of_misspelt_inflections(spark):
    forms = ["idiot", "idiots", "idioot", "idiott", "idiotic", "idiocy"]
    rude = [(i, _words(20, i) + f" you {forms[i % 6]} " + _words(20, 300 + i), 1) for i in range(60)]
    clean = [(100 + i, _words(40, 700 + i) + " you and", 0) for i in range(60)]
    model = toxicity.train(spark.createDataFrame(rude + clean, "doc_id long, text string, toxic int"))
    said = ["ideot", "1diot", "iidiot", "idot", "idiotically"]
    got = {r.id: r for r in toxicity.score(_docs(spark, [(i, f"{_words(20, 50 + i)} {w} {_words(20, 60 + i)}") for i, w in enumerate(said)]), model).collect()}
    assert all(got[i].score > 0.5 for i in range(5)), got


def test_toxicity_of_rare_terms(spark):
    r = random.Random(7)
    rare = ["".join(r.choice("klmnopqr") for _ in range(9)) for _ in range(150)]  # each in 8 of 1,200 toxic texts, below 2 %
    rude = [(i, f"{_words(12, i)} {rare[i % 150]} {_words(12, 3000 + i)}", 1) for i in range(1200)]
    clean = [(5000 + i, _words(25, 7000 + i), 0) for i in range(1200)]
    model = toxicity.train(spark.createDataFrame(rude + clean, "doc_id long, text string, toxic int"))
    assert set(rare) <= {t for t, _ in model.terms}
    got = toxicity.score(_docs(spark, [(i, f"{_words(20, 50_000 + i)} {w}") for i, w in enumerate(rare)]), model).collect()
    assert all(x.score > 0.5 for x in got)
    plain = toxicity.score(_docs(spark, [(i, _words(30, 60_000 + i)) for i in range(200)]), model).collect()
    assert sum(x.score > 0.5 for x in plain) <= 4


@pytest.mark.parametrize("term,clean_too", [("zq", 0), ("verlogenheitsverdaechtigung", 0), ("笨蛋", 0), ("ばか", 0), ("blockheaded", 4), ("q", 0)])
def test_terms_of_any_length_and_script(spark, term, clean_too):
    unspaced = ord(term[0]) > 0x2FF
    around = (lambda i: "".join(random.Random(i).choice("天地玄黄宇宙洪荒日月盈昃") for _ in range(12))) if unspaced else (lambda i: _words(12, i))
    put = (lambda i, t: around(i) + t + around(9000 + i)) if unspaced else (lambda i, t: f"{around(i)} {t} {around(9000 + i)}")
    rude = [(i, put(i, term), 1) for i in range(60)] + [(1000 + i, put(1000 + i, around(50_000 + i)), 1) for i in range(240 if clean_too else 0)]
    clean = [(5000 + i, put(5000 + i, term if i < clean_too else around(70_000 + i)), 0) for i in range(300 if clean_too else 60)]
    model = toxicity.train(spark.createDataFrame(rude + clean, "doc_id long, text string, toxic int"))
    assert any(t in term or term in t for t, _ in model.terms)
    got = {r.id: r.score for r in toxicity.score(_docs(spark, [(1, put(90_001, term)), (2, put(90_002, around(90_003)))]), model).collect()}
    assert got[1] > 0.5 and (clean_too or got[2] < 0.5)


def test_quotations_are_pairs():
    cases = {
        "you're an blockhead and that's all": False, "l’air d'un blockhead qu’il a": False, "he said 'a blockhead' then": True, "he’s ‘a blockhead’ then": True,
        'he said "blockhead" then': True, 'said "yes" blockhead "no" then': False, '"What?" blockhead "Yes."': False, '("blockhead!")': True, '" blockhead "': True,
        "« un blockhead »": True, "« a » blockhead « b »": False, "„ein blockhead“ da": True, "„a“ blockhead „b“": False, "“a blockhead” x": True, "“a” blockhead “b”": False,
        "»ein blockhead« da": True, "‚ein blockhead‘ da": True, "他说“blockhead”了": True, 'blockhead "x"': False, '"x» blockhead': False, "“blockhead»": False, "the dogs' blockhead 'x": False,
    }
    points, offsets = T.codepoints(pa.array(list(cases)))
    start = np.array([offsets[i] + t.index("blockhead") for i, t in enumerate(cases)])
    got = toxicity._quoted(points, offsets, np.arange(len(cases)), start, start + 9, 40)
    assert dict(zip(cases, got.tolist())) == cases


def test_quality(spark):
    good = [(i, ". ".join(_words(12, 1000 * i + k) for k in range(3)) + ".\n" + _words(15, i) + ".", 1) for i in range(80)]
    bad = [(100 + i, "\n".join((_words(1, i) + "!! ").upper() * 12 for _ in range(3)), 0) for i in range(80)]
    model = quality.train(spark.createDataFrame(good + bad, "doc_id long, text string, quality int"))
    docs = _docs(spark, [(1, good[3][1]), (2, bad[5][1]), (3, None), (4, "\n\n"), (5, good[7][1] + "\n" + bad[7][1])])
    got = {r.id: r for r in quality.score(docs, model).collect()}
    assert got[1].score > 0.5 > got[2].score and got[3].lines == [] and got[4].lines == [] and got[3].score == got[4].score
    assert got[5].lines[0] > 0.5 > got[5].lines[-1] and len(got[5].lines) == 5
    assert {r.score for r in quality.score(docs, quality.train(spark.createDataFrame([], "text string, quality int"))).collect()} == {0.5}


def test_forward_backward_sums_over_all_labellings():
    g = np.random.Generator(np.random.PCG64(1))
    row, score, step = np.array([0, 0, 0, 2]), g.normal(size=(4, 2)), g.normal(size=(2, 2))
    marginal, pairs, total = quality._marginals(score, row, 3, step)
    z, want = 0.0, np.zeros(3)
    for v in np.ndindex(2, 2, 2):
        w = np.exp(sum(score[t, x] for t, x in enumerate(v)) + step[v[0], v[1]] + step[v[1], v[2]])
        z, want = z + w, want + w * np.array(v)
    assert np.allclose(marginal[:3, 1], want / z) and abs(pairs.sum() - 2) < 1e-9
    assert abs(total - np.log(z) - np.logaddexp(*score[3])) < 1e-9


def test_mixing(spark):
    docs = _docs(spark, [(i, "x" * 9, ) for i in range(3000)]).withColumn("source", F.when(F.col("doc_id") % 3 == 0, "a").when(F.col("doc_id") % 3 == 1, "b"))
    weights = spark.createDataFrame([("a", 3.0), (None, 1.0), ("none", 5.0)], "source string, weight double")
    rated = mixing.rates(docs, weights=weights)
    rate = {r.source: r.rate for r in rated.collect()}
    assert rate["b"] == 0 and abs(rate["a"] / rate[None] - 3) < 1e-9
    out = mixing.mix(docs, rated)
    got = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert set(got) == {"a", None} and abs(got["a"] - 1000 * rate["a"]) < 6 * (1000 * rate["a"]) ** 0.5
    assert out.select("order_key").distinct().count() == out.count() and "clash" in out.first().asDict().values()
    many = mixing.mix(docs.limit(50), rated.select("source", "size", F.lit(1000.0).alias("rate")))
    n = many.count()
    assert abs(n - 50_000) < 6 * 50_000**0.5 and many.select("doc_id").distinct().count() == 50
    assert mixing.mix(docs.limit(0), mixing.rates(docs.limit(0))).count() == 0


def test_joins_with_a_hot_centre_follow_no_aggregate(spark, monkeypatch):
    """The adaptive join splits a hot key only where its sides are as they were shuffled."""
    prepare(spark)
    plans, write = [], components.settled
    monkeypatch.setattr(components, "settled", lambda frame, name: plans.append(frame._jdf.queryExecution().optimizedPlan().toString()) or write(frame, name))
    edges = spark.range(1, 100_000).select(F.when(F.col("id") < 99_999, 0).otherwise(F.col("id") - 1).alias("b"), F.col("id").alias("a"))
    got = components.components(edges)
    assert got.count() == 100_000 and got.filter("component <> 0").count() == 0
    joins = [p[p.index("Join") :] for p in plans if "Join" in p]
    assert joins and not any("Aggregate" in p for p in joins)


def test_components(spark):
    prepare(spark)
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 400)] + [(5000 + r.randrange(300), 5000 + r.randrange(300)) for _ in range(200)] + [(7, None), (9, 9), (300, 299)]
    got = {x.node: x.component for x in components.components(spark.createDataFrame(edges, "a int, b int")).collect()}
    root: dict = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in root}
    assert components.components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_quality_lines_do_not_depend_on_pieces_or_neighbours():
    r = random.Random(5)
    texts = ["".join(r.choice(["a", "B", "é", "1", "!", "!", " ", "\n", "ab ", "漢", "\U0001f600"]) for _ in range(r.randrange(60))) for _ in range(40)] + [None, "", "\n\n", "w" * 300, "!!", "!!"]
    x, row, size, rows = quality._lines(pa.array(texts))
    for piece in (1, 2, 7, 64):
        again = quality._lines(pa.array(texts), piece)
        assert again[3] == rows and all((a == b).all() for a, b in zip(again[:3], (x, row, size)))
    for i, text in enumerate(texts):
        assert (quality._lines(pa.array([text], pa.string()))[0] == x[row == i]).all()
        lines = [t for t in (text or "").split("\n") if t]
        assert size[row == i].tolist() == list(map(len, lines))
        doubled = [sum(a == b and not (a.isalnum() or a.isspace()) for a, b in zip(t, t[1:])) / len(t) for t in lines]
        same = [sum(a.lower() == b.lower() for a, b in zip(t.split(), t.split()[1:])) / max(len(t.split()), 1) for t in lines]
        fewer = [1 - len(set(t.lower().split())) / max(len(t.split()), 1) if t.split() else 1.0 for t in lines]
        for k, want in ((8, doubled), (5, same), (6, fewer)):
            assert np.allclose(x[row == i][:, k], want, atol=1e-6), (i, k)


def test_word_hashes_do_not_depend_on_pieces():
    r = random.Random(6)
    texts = [" ".join("".join(r.choice("abC\té") for _ in range(r.randrange(9))) for _ in range(r.randrange(20))) for _ in range(30)] + ["", None, "  ", "x" * 9000, "X" * 9000 + " x", "x" * 4096]
    data, offsets = T.raw(pa.array(texts))
    want = T.word_hashes(data, offsets)
    spoken = [w.lower().encode() for t in texts for w in (t or "").split()]
    assert [data[a:b].tobytes().lower() for a, b in zip(want[1], want[2])] == spoken
    assert len(set(zip(want[0].tolist(), spoken))) == len(set(want[0].tolist())) == len(set(spoken))
    for piece in (1, 3, 100, 4096):
        assert all((a == b).all() for a, b in zip(T.word_hashes(data, offsets, piece=piece), want))


def test_urls(spark):
    prepare(spark)
    rules = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
    canon = '<head><LINK href="{}" rel=canonical></head>'
    rows = [
        (1, "http://A.example.NET/en/x?q#f", None), (2, "https://example.net", ""), (3, "http://x.net/", "<p>"), (4, "mailto:a", "x"), (5, None, "x"),
        (6, "http://safe.test/a", canon.format("https://bad.net/p")), (7, "http://safe.test/b", '<meta http-equiv="Refresh" content="0; URL=/a">'),
        (8, "http://fr.org/fr/z", canon.format("http://bad.net/p")), (9, "http://other.test/", canon.format("//safe.test/c")), (10, "http://safe.test/c", "<p>"), (11, "http://safe.test/c", "<p>"),
    ]
    got = {r.id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(spark.createDataFrame(rows, "page_id int, url string, html string"), rules).collect()}
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[2] == ("example.net", "", None, "allow")
    assert got[3][2:] == ("net/", "block") and got[4] == ("", "", None, "allow") and got[5] == ("", "", None, "allow")
    assert got[6][3] == "block" and got[7][3] == "block" and got[8][2:] == ("org/fr/", "allow")
    assert got[9][3] == got[10][3] == got[11][3] == "allow"
    assert urls.judge(spark.createDataFrame([], "page_id int, url string, html string"), rules).count() == 0


def test_urls_decode_links_and_remove_dot_segments(spark):
    prepare(spark)
    canon = '<link rel="canonical" href="{}">'
    rows = [
        (1, "http://safe.test/p?a=1&b=2", canon.format("http://bad.net/x")), (2, "http://safe.test/q", canon.format("http://safe.test/p?a=1&amp;b=2")), (3, "http://safe.test/r", canon.format("http://safe.test/p?a=1&#38;b=2")),
        (4, "http://safe.test/d/e/f", canon.format("../../d/./g")), (5, "http://safe.test/d/g", canon.format("http://bad.net/y")), (6, "http://safe.test/d/e/", canon.format("../../../d/g")),
        (7, "http://safe.test/h/i", canon.format("http://safe.test/p?a=1&amp;amp;b=2")), (8, "http://safe.test/d/../d/g", None), (9, "http://safe.test/k/l", canon.format("..")), (10, "http://safe.test/", canon.format("http://bad.net/z")),
        (11, "http://safe.test/m", '<meta http-equiv="refresh" content="0; url=/p?a=1&amp;b=2">'),
    ]
    got = {r.id: r.verdict for r in urls.judge(spark.createDataFrame(rows, "page_id int, url string, html string"), [("net/", "block")]).collect()}
    assert {i for i, v in got.items() if v == "allow"} == {7}


# Url and html of a page, and whether it is an alias of the blocked ``bad.net``.
WRITTEN = [
    ("http://b1.test/", '<link rel="alternate canonical" href="http://bad.net/p">', True),
    ("http://b2.test/", '<base href="http://bad.net/d/"><link rel=canonical href="e">', True),
    ("http://b3.test/", '<link rel=canonical href="http://bad.net:80/p">', True),
    ("http://b4.test/", '<link rel=canonical href="http://bad.net">', True),
    ("http://b5.test/", '<link title="a > b" rel=canonical href="http://bad.net/p">', True),
    ("http://b6.test/", '<!-- <link rel=canonical href="http://bad.net/p"> -->', False),
    ("http://b7.test", '<link rel=canonical href="http://bad.net/p">', True), ("http://b7.test/", "", True),
    ("http://b8.test/", "<script>'<link rel=canonical href=http://bad.net/p>'</script>", False),
    ("http://b9.test/", "<!-- x --><link rel=canonical href='http://me:pw@bad.net/p'>", True),
    ("http://b10.test/", '<a title="<link rel=canonical href=http://bad.net/p>">', False),
    ("http://b11.test/", '<link rel=canonical href="http://bad.net/p>', False),
    ("http://b12.test/", "<meta http-equiv=refresh content=\"3;URL='http://bad.net/p'\">", True),
    ("http://b13.test/", '<meta http-equiv=refresh content="3">', False),
    ("http://b14.test/", '<link rel=canonical href="mailto:a@bad.net">', False),
    ("http://b15.test/", '<link rel=canonical href=\n" http://bad.net/p\n">', True),
    ("http://b16.test/", '<link rel="noncanonical" href="http://bad.net/p"><link rel=canonical>', False),
    ("http://bad.net:80/q", '<link rel=canonical href="/q">', True), ("http://bad.net:81/q", '<link rel=canonical href="/q">', False),
    ("http://b17.test/", '<!--><link rel=canonical href="http://bad.net/p">', True),
    ("http://b18.test/", '<link rel=canonical href="http://b19.test/x"><link href=http://bad.net/ rel=canonical href=/>', True),
    ("https://b19.test:443/x", "", True), ("http://b20.test/", '<p title="' + "x > y = ' " * 100_000 + '"><link rel=canonical href=http://bad.net/>', True),
]


def test_urls_read_links_as_html_does(spark):
    prepare(spark)
    pages = spark.createDataFrame([(i, url, html) for i, (url, html, _) in enumerate(WRITTEN)], "page_id int, url string, html string")
    got = {r.id: r.verdict == "block" for r in urls.judge(pages, [("net/", "block")]).collect()}
    assert [WRITTEN[i] for i in got if got[i] != WRITTEN[i][2]] == []
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id int, url text, html text)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", [(i, url, html) for i, (url, html, _) in enumerate(WRITTEN)])
    assert {r[0]: r[4] == "block" for r in con.execute(urls.SQL).fetchall()} == got


def test_reply_trees(spark):
    prepare(spark)
    rows = [
        (1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad <|im_end|>", 1.0), (1, 3, 1, "assistant", "good \\ <|x", 2.0), (1, 4, 3, "user", None, None),
        (1, 5, 2, "user", "worse", 0.5), (2, 6, 99, "user\n", "orphan", 1.0), (3, 7, 8, "user", "loop", 1.0), (3, 8, 7, "user", "loop", 1.0), (4, 9, 9, "user", "self", 1.0),
    ]
    nodes = spark.createDataFrame(rows, "tree int, node long, parent long, role string, text string, score double")
    got = sorted((r.tree, r["rank"], r.place, r.node) for r in chat.paths(nodes, branches=2).collect())
    assert got == [(1, 1, 0, 1), (1, 1, 1, 3), (1, 1, 2, 4), (1, 2, 0, 1), (1, 2, 1, 2), (1, 2, 2, 5), (2, 1, 0, 6)]
    made = {r.tree: r for r in chat.formatted(chat.paths(nodes), nodes).collect()}
    assert chat.read_back(made[1].text) == [("user", "q"), ("assistant", "good \\ <|x"), ("user", "")] and chat.read_back(made[2].text) == [("user\n", "orphan")]
    assert [chat.unescape(made[1].text[s.start : s.end]) for s in made[1].loss] == ["good \\ <|x"]
    assert chat.paths(nodes.limit(0)).count() == 0


def test_reply_trees_of_any_depth(spark):
    prepare(spark)
    r = random.Random(8)
    parent = {i: (i - 1 if i % 70 else None) for i in range(140)}  # two chains
    parent |= {i: (r.randrange(140, i) if i > 140 and r.random() < 0.9 else None) for i in range(140, 260)}
    parent |= {i: (i + 1 if i < 269 else 260) for i in range(260, 270)} | {270: 265, 271: 270}  # a cycle and what hangs on it
    score = {i: r.choice([0.0, 1.0, 2.0]) for i in parent}

    def up(i):
        found = [i]
        while parent[found[-1]] is not None and len(found) <= len(parent):
            found.append(parent[found[-1]])
        return found if len(found) <= len(parent) else []

    line = {i: up(i) for i in parent}
    tree = {i: (x[-1] if x else -1) for i, x in line.items()}
    ends: dict = {}
    for i in set(parent) - set(parent.values()):
        if line[i]:
            ends.setdefault(tree[i], []).append((-sum(score[x] for x in line[i]), -len(line[i]), i))
    want = sorted(
        (t, k, i, place, node) for t, found in ends.items() for k, (_, _, i) in enumerate(sorted(found)[:3], 1) for place, node in enumerate(reversed(line[i]))
    )
    nodes = spark.createDataFrame([(tree[i], i, parent[i], score[i]) for i in parent], "tree int, node int, parent int, score double")
    got = sorted((x.tree, x["rank"], x.leaf, x.place, x.node) for x in chat.paths(nodes, branches=3).collect())
    assert got == want


def test_long_conversation(spark):
    prepare(spark)
    said = spark.createDataFrame([(1, i, "user", f"{i}") for i in range(3000)] + [(None, 0, None, None), (2, 0, "a", "b"), (2, 0, "a", "b")], "conv_id int, turn int, role string, text string")
    nodes = chat.numbered(said)
    got = {r.conv_id: r for r in chat.digests(chat.formatted(chat.paths(nodes), nodes)).collect()}
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"user\n{i}\n" for i in range(3000)).encode()).hexdigest()
    assert (got[1].n_turns, got[2].n_turns, got[None].n_turns, got[1].loss_chars) == (3000, 2, 1, 0)
    assert chat.numbered(said.limit(0)).count() == 0


def test_embeddings(spark):
    g = np.random.Generator(np.random.PCG64(6))
    x = g.normal(size=(300, 64))
    near = x[:100] + 0.25 * g.normal(size=(100, 64)) * np.linalg.norm(x[:100], axis=1, keepdims=True) / 8
    dense = x[5] + 0.1 * g.normal(size=(150, 64))
    vectors = np.concatenate([x, near, dense, x[:20], 3 * x[30:40]])
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(9000, None), (9001, [0.0] * 64), (9002, [float("nan")] * 64), (9003, [None] * 64), (9004, [1.0, 2.0]), (9005, [])]
    prepare(spark)
    got = {r.id: r for r in embeddings.near(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    close = (unit @ unit.T >= 0.95) & ~np.eye(len(unit), dtype=bool)
    links = np.array([got[i].n_links for i in range(len(unit))])
    assert (links <= close.sum(1)).all() and links.sum() >= 0.97 * close.sum() > 0
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(9000, 9006))
    assert all(got[550 + i].component_id <= i for i in range(20))
    assert embeddings.near(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_lattice_points_are_nearest():
    x = np.random.Generator(np.random.PCG64(2)).normal(size=(200, 8)) * 2
    p, roots = embeddings.decode(x), embeddings._roots()
    assert len(roots) == 240 and np.allclose((roots**2).sum(1), 2)
    gap = ((x - p) ** 2).sum(1)
    assert all((gap <= ((x - p - r) ** 2).sum(1) + 1e-9).all() for r in roots)
