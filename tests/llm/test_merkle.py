"""The Merkle manifest against plain Python."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tokenledger.llm import merkle
from tokenledger.llm.scratch import prepare

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, leaf string, tree int"


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(r, text):
    return _h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)])


def _tree(digests):
    """The root of a list of digests, and the siblings of each, level by level."""
    paths, at = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        for i, p in enumerate(paths):
            run = digests[at[i] // 8 * 8 : at[i] // 8 * 8 + 8]
            p.append(("".join(run[: at[i] % 8]), "".join(run[at[i] % 8 + 1 :])))
            at[i] //= 8
        digests = [_h(*digests[k : k + 8]) for k in range(0, len(digests), 8)]
    return digests[0], paths


def _expected(rows):
    groups: dict = {}
    for r in rows:
        lower = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None
        now = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]) if lower else r[1]
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, _leaf(r, r[1]), _leaf(r, now), r[0]))
    if not rows:
        return []
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: _tree([x[2] for x in sorted(groups[g])]) for g in langs}
    root, tops = _tree([trees[g][0] for g in langs])
    out = []
    for g, top in zip(langs, tops):
        for x, path in zip(sorted(groups[g]), trees[g][1]):
            now = x[3]
            for left, right in path + top:
                now = _h(left, now, right)
            out.append((x[4], x[2], trees[g][0], root, _h(*[a + b for a, b in path + top]), now, now == root))
    return out


def _rows(n, langs, seed):
    r = random.Random(seed)
    words = ["Über", "ABC", "abc", "", "x y", "\0", "語"]
    return [
        (r.choice([None, *range(n // 2)]) if i % 7 == 0 else 1000 + i, r.choice([None, "", *[" ".join(r.choices(words, k=4)) for _ in range(3)]]),
         r.choice(langs), r.choice([None, "", "src"]), r.choice([None, 3]), "clash", "clash", 5)
        for i in range(n)
    ]


@pytest.mark.parametrize("rows", [
    [], _rows(1, ["en"], 1), _rows(9, ["en"], 2), _rows(3, [None, "de", "en"], 3), _rows(300, [None, "", "de", "en", "é", "z", "zz", "a", "b", "c"], 4),
    [(1, "Same", "en", "s", 4, "c", "c", 1)] * 80 + _rows(90, ["en"] * 9 + ["de"], 5), [(7, "WORD " * 400_000, "en", None, None, "c", "c", 1), (None, None, None, None, None, None, None, None)],
], ids=["none", "one", "nine", "groups", "many groups", "repeated rows", "long and null"])
def test_proofs(spark, rows):
    prepare(spark)
    docs = spark.createDataFrame(rows, DOCS)
    third = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    now = F.when(third, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))
    got = [tuple(r) for r in merkle.verified(docs, tampered={"text": now}).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, _expected(rows)))


def test_requests_and_records(spark):
    prepare(spark)
    rows = _rows(200, ["de", "en"], 6)
    leaves = spark.createDataFrame(rows, DOCS).select("lang", "doc_id", merkle.leaf([F.col(c) for c in merkle.FIELDS]).alias("leaf"))
    manifest = merkle.build(leaves, "lang", "doc_id")
    asked = spark.createDataFrame([(0, 0), (0, 9), (1, 9), (1, 9), (1, 5_000), (9, 0)], "tree long, at long")
    proofs = {(r.tree, r["at"]): r for r in merkle.prove(manifest, asked).withColumn("back", merkle.folded(F.col("leaf"), F.col("path"))).collect()}
    assert sorted(proofs) == [(0, 0), (0, 9), (1, 9)] and {r.back for r in proofs.values()} == {manifest.root}
    store = {r.digest: r.children for r in manifest.stored().collect()}
    assert all(_h(*children) == digest and len(children) <= 8 for digest, children in store.items())

    def below(digest):
        return [x for child in store[digest] for x in below(child)] if digest in store else [digest]

    assert sorted(below(manifest.root)) == sorted(r.leaf for r in leaves.collect())
