"""The registered queries: SQL where it can say it, brute force or held-out accuracy where not."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

import corpus_pipeline
from oracle import compare
from test_text_operators import _groups, _repeats, _shingles
from tokenledger.llm import suffixes, toxicity
from tokenledger.llm.queries import ORACLES, QUERIES, labelled
from tokenledger.llm.scratch import prepare

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    result = compare(spark, SMALL, name, QUERIES[name], ORACLES[name])
    assert result.startswith("ok"), result


def _documents(spark, sf=SMALL):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]


def test_suffix_dedup_against_brute_force(spark):
    rows = _documents(spark)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op1_suffix_dedup"](spark, SMALL).collect()}
    want = _repeats([t for _, t in rows], 200)
    assert got == {i: (n, gone, runs, hashlib.sha256(keep).hexdigest()) for (i, _), (n, gone, runs, keep) in zip(rows, want)}


def test_minhash_against_brute_force(spark):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in QUERIES["op10_minhash"](spark, SMALL).collect()}
    assert got == _groups(_documents(spark), 4)


def test_embeddings_against_brute_force(spark):
    rows = spark.read.parquet(f"{MIDDLE}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = (x @ x.T >= 0.95).sum(1) - 1
    got = {r.vec_id: r.n_links for r in QUERIES["op6_embeddings"](spark, MIDDLE).collect()}
    mine = np.array([got[r.vec_id] for r in rows])
    assert (mine <= links).all() and mine.sum() >= 0.9 * links.sum()


@pytest.mark.parametrize("name,label", [("op7_toxicity", "toxic"), ("op9_quality", "quality")])
def test_labels_of_the_held_out_fold(spark, name, label):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()}
    out = QUERIES[name](spark, MIDDLE).collect()
    right = [r.predicted == labels[r.doc_id] for r in out if r.held_out and labels.get(r.doc_id) is not None]
    assert len(right) > 50 and np.mean(right) > 0.95 and all(0 <= r.score <= 1 for r in out)


def test_language_of_the_held_out_fold(spark):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").collect()}
    out = QUERIES["op3_language_id"](spark, MIDDLE).collect()
    right = [r.lang_pred == langs[r.doc_id] for r in out if r.held_out and langs[r.doc_id]]
    assert len(out) == len(langs) and np.mean(right) > 0.98


def _poisson(u, rate):
    n, p = 0, math.exp(-rate)
    total = p
    while total <= u:
        n += 1
        p *= rate / n
        total += p
    return n


def test_pipeline_against_brute_force(spark):
    prepare(spark)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    scores = {r.id: r.score for r in toxicity.score(docs, toxicity.train(labelled(spark, SMALL, "toxic"))).collect()}
    rows = [r for r in docs.orderBy("doc_id").collect() if scores[r.doc_id] < 0.5]
    groups = _groups([(r.doc_id, r.text) for r in rows], 5)
    rows = [r for r in rows if groups[r.doc_id][2]]
    items = [_shingles(r.text, 5) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    left = []
    for r, (_, gone, _, _) in zip(rows, _repeats([r.text for r in rows], 200)):
        text = r.text if not gone else None
        left.append((r, text))
    marks = {i: m for i, m in _character_marks([r.text for r in rows])}
    kept = []
    for i, (r, text) in enumerate(left):
        text = r.text if text is not None else "".join(c for c, g in zip(r.text, marks[i]) if not g)
        has = _shingles(text, 5)
        if not any(x and len(x & has) >= 0.8 * len(x) for x in items):
            kept.append((r.doc_id, text, r.source))
    sizes: dict = {}
    for _, t, s in kept:
        sizes[s] = sizes.get(s, 0) + len(t.encode()) + 1
    whole, roots = sum(sizes.values()), sum(math.sqrt(x) for x in sizes.values())
    want = []
    for i, t, s in kept:
        u = int(hashlib.md5(f"17|{i}|1".encode()).hexdigest()[:13], 16) / 2**52
        want += [(i, t, len(t), k + 1) for k in range(_poisson(u, math.sqrt(sizes[s]) / roots * whole / sizes[s]))]
    got = corpus_pipeline.run(spark, SMALL)
    assert got.columns[: len(docs.columns)] == docs.columns
    assert sorted((r.doc_id, r.text, r.n_chars, r["copy"]) for r in got.collect()) == sorted(want)


def _character_marks(texts):
    """Which characters go: those all of whose bytes lie in repeated strings."""
    raw = [t.encode() for t in texts]
    seen: dict[bytes, int] = {}
    for b in raw:
        for i in range(len(b) - 199):
            seen[b[i : i + 200]] = seen.get(b[i : i + 200], 0) + 1
    for n, (t, b) in enumerate(zip(texts, raw)):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        at = 0
        out = []
        for c in t:
            width = len(c.encode())
            out.append(bool(gone[at : at + width].all()))
            at += width
        yield n, out


def test_stages_on_empty_and_odd_rows(spark):
    prepare(spark)
    schema = spark.read.parquet(f"{SMALL}/documents.parquet").schema.add("id", "string").add("_found", "integer")
    odd = [(None, None, None, None, None, "a", 1), (1, "", "en", "s", 0, "b", 2), (1, "", "en", "s", 0, "b", 2), (2, "plain words here", None, "s", 16, None, None), (2, "plain words here", None, "s", 16, None, None)]
    for rows, counts in (([], [0] * 5), (odd, [5, 4, 4, 4, None])):
        docs = spark.createDataFrame(rows, schema)
        for (name, stage), want in zip(corpus_pipeline.STAGES, counts):
            docs = stage(spark, docs, SMALL)
            docs = spark.createDataFrame(docs.collect(), docs.schema)
            assert want is None or docs.count() == want, name
    assert suffixes.dedup(docs.limit(0)).count() == 0


def test_near_duplicates_with_null_and_repeated_ids(spark):
    prepare(spark)
    texts = [" ".join(f"{name}{i}" for i in range(40)) for name in "abcdef"]
    near = texts[0].replace("a39", "other")
    rows = [
        (1, texts[0]), (None, texts[0]), (None, texts[1]), (None, texts[2]), (None, texts[2]),  # null ids: a copy of 1, a text alone, a text twice
        (5, near), (5, texts[3]), (5, texts[4]), (5, texts[4]), (5, None), (5, ""), (None, None), (6, texts[5]), (6, texts[5].replace("f39", "other")),
    ]
    schema = spark.read.parquet(f"{SMALL}/documents.parquet").schema
    docs = spark.createDataFrame([tuple({"doc_id": i, "text": t}.get(c) for c in schema.names) for i, t in rows], schema)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, SMALL).collect()]
    sixth = [x for x in got if x[0] == 6]
    want = [(1, texts[0]), (None, texts[1]), (None, texts[2]), (5, texts[3]), (5, texts[4]), (5, None), (5, ""), (None, None)]
    assert len(sixth) == 1 and sixth[0] in rows
    assert sorted(map(repr, got)) == sorted(map(repr, want + sixth))
