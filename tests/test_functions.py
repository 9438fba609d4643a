from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tokenledger.functions import caps, classify, enrich
from tokenledger.functions import json as J
from tokenledger.functions.redact import Redactor, redact_columns
from tokenledger.functions.text import cap_text, display_error, preview, strip, word_count
from tokenledger.operators import sampling as S


def _redact(spark, texts, redactor=Redactor()):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    out = redact_columns(df, ["t"], "n", redactor).orderBy("i").collect()
    return [(r.t, r.n) for r in out]


def test_redaction(spark):
    got = _redact(
        spark,
        ["send it to kim.li@shop.test today", "paid by 5500 0055 5555 5559, number 219-09-9999, from 192.0.2.44",
         "ring (212) 555-0199 at nine", "token sk-ZZ11yy22XX33ww44VV55 in use", "nothing here, 7", None, ""],
    )
    assert got == [
        ("send it to [REDACTED_EMAIL] today", 1), ("paid by [REDACTED_CARD], number [REDACTED_SSN], from [REDACTED_IP]", 3),
        ("ring ([REDACTED_PHONE] at nine", 1), ("token [REDACTED_API_KEY] in use", 1), ("nothing here, 7", 0), (None, 0), ("", 0),
    ]


def test_redactor_options(spark):
    assert _redact(spark, ["j@x.com"], Redactor(enabled=False)) == [("j@x.com", 0)]
    extra = Redactor(extra_patterns=[("US$\\1", r"ORD_[0-9]{4}")])
    assert _redact(spark, ["order ORD_2210 sent"], extra) == [("order [REDACTED_US$\\1] sent", 1)]
    custom = Redactor(custom=lambda t: (t[:1] + "…", 2))
    assert _redact(spark, ["k@x.test", None, ""], custom) == [("k…", 2), (None, 0), ("", 0)]


def test_filter_on_redacted_text_stays_small(spark):
    df = redact_columns(spark.range(3).selectExpr("concat('a', id, '@b.com') AS t"), ["t"], "n")
    assert df.filter("n > 0 AND t LIKE '%RED%'").count() == 3


def test_enrichment(spark):
    rows = [("gpt-4.1-mini", 1_000_000, 1_000_000, None, 1000), ("future", 100, 100, 99, 1000), ("mock-1", 5, None, None, 0)]
    df = spark.createDataFrame(rows, "model string, prompt_tokens int, completion_tokens int, total_tokens int, latency_ms int")
    got = {r.model: (r.total_tokens, r.tokens_per_second, r.estimated_cost_usd) for r in enrich.enrich(df).collect()}
    assert got == {"gpt-4.1-mini": (2_000_000, 1_000_000.0, 2.0), "future": (99, 100.0, None), "mock-1": (None, None, None)}


def test_success_rate_without_requests(spark):
    row = spark.range(1).select(enrich.success_rate(F.lit(0), F.lit(0)).alias("r")).first()
    assert row.r == 100.0


TEXTS = ["", "  ", "a ", "\x1c x\ty 　", "é" * 300, "plain words here", " nbsp ", "line\nline"]


def test_text_helpers_follow_python(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    t = F.col("t")
    out = df.select(strip(t).alias("s"), word_count(t).alias("w"), preview(t).alias("p"), display_error(t).alias("d"), cap_text(t, 10).alias("c"), "i")
    for r in out.collect():
        s = TEXTS[r.i]
        assert r.s == s.strip()
        assert r.w == max(len(s.split()), 1)
        assert r.p == (s.strip()[:280] or None)
        assert r.d == (" ".join(s.split())[:240] or "unknown error")
        assert r.c == (s if len(s) <= 10 else s[:9] + "…")


def test_dumped_length_follows_python(spark):
    values = [{}, {"a": 1}, {"a:b,c": ["x", {"y": None}], "z": "q\"uo\\te, : "}, {"é": "ü😀\x7f\n"}, {"n": -1.5, "t": True}]
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i int, j string")
    out = df.select("i", J.dumped_length(F.to_json(F.parse_json("j"))).alias("n")).collect()
    assert {r.i: r.n for r in out} == {i: len(json.dumps(v)) for i, v in enumerate(values)}


def _capped(spark, tags):
    df = spark.createDataFrame([(json.dumps(tags),)], "j string")
    out = df.select(F.to_json(caps.cap_dict(F.from_json("j", "map<string,variant>"))).alias("j")).first().j
    return json.loads(out)


def test_caps(spark):
    assert _capped(spark, {}) == {}
    assert _capped(spark, {"u": "y" * 1024})["u"] == "y" * 255 + "…"
    assert list(_capped(spark, {f"k{i}": str(i) for i in range(96)})) == [f"k{i}" for i in range(32)]
    big = _capped(spark, {f"k{i}": "v" * 256 for i in range(32)})
    assert len(json.dumps(big)) <= 4096 < len(json.dumps({**big, "k99": "v" * 256}))
    assert _capped(spark, {"a": True, "b": 1.5, "c": None, "d": [1]}) == {"a": True, "b": 1.5, "c": None, "d": "[1]"}


def test_map_entries_are_measured_once(spark):
    frame = spark.range(1).select(F.create_map(F.lit("k"), F.lit("é😀").cast("variant")).alias("m"))
    plan = frame.select(caps.cap_dict(F.col("m")).alias("c"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("to_json(") == 2  # the key's and the value's


def test_escaped_length_follows_python(spark):
    texts = ["", "plain", "é", "😀😀", "a😀é\u007f\n b", "é" * 300 + "z", "\u2028"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(J.escaped_length(F.col("t"))).collect()]
    # Python leaves DEL and newline to the JSON text itself; here every one of them counts six.
    assert got == [sum(1 if " " <= c <= "~" else 12 if ord(c) > 0xFFFF else 6 for c in t) for t in texts]


def test_sampling(spark):
    df = spark.createDataFrame([(f"r{i}", s) for i, s in enumerate(["success"] * 50 + ["error", "cancelled"])], "request_id string, status string")
    assert S.sample(df, S.Probability(1.0)).count() == 52
    assert S.sample(df, S.Probability(0.0)).count() == 0
    assert S.sample(df, S.AlwaysKeepErrors(S.Probability(0.0))).count() == 2
    assert S.drop_ledger(df, S.AlwaysKeepErrors(S.Probability(0.0))).first().dropped == 50
    many = spark.range(4_000_000).selectExpr("cast(id AS string) AS request_id")
    assert 0 < S.sample(many, S.Probability(4e-6)).count() < 50
    rows = spark.createDataFrame([("a", None), ("b", 400), ("c", 2)], "request_id string, n int")
    seen = S.CustomSampler(lambda e: e["n"] > 300 and isinstance(e["n"], int))
    assert sorted(r.request_id for r in S.sample(rows, seen).collect()) == ["a", "b"]
    half = S.Probability(0.5)
    assert S.sample(df, half).collect() == S.sample(df, half).collect()
    with pytest.raises(ValueError):
        S.Probability(1.5)


def test_error_labels(spark):
    names = ["RateLimitError", "APITimeoutError", "BadRequestError", "ConnectError", None]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    out = df.select(classify.captured_error(F.col("n")).alias("a"), classify.call_error(F.col("n")).alias("b"), "i").orderBy("i").collect()
    assert [r.a for r in out] == ["rate_limit", "timeout", "provider_error", "connection", None]
    assert [r.b for r in out] == ["rate_limit", "timeout", "invalid_request", "provider_error", None]
