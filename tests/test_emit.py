"""From events to payload, envelopes and the store."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tokenledger.functions import json as J
from tokenledger.operators import emit as E
from tokenledger.operators.process import check
from tokenledger.sources import bronze
from tokenledger.sources.bronze import explode_envelopes, judge_batches
from tokenledger.sources.store import LogStore
from tokenledger.streaming.ingest import ingest_batch, ingest_envelopes


def test_envelopes_reach_the_store(spark, event, tmp_path):
    ids = [f"00000000-0000-4000-8000-{i:012x}" for i in range(7)]
    payload = spark.createDataFrame([(i, event(request_id=i)) for i in ids], "request_id string, value string").coalesce(1)
    documents = E.to_envelopes(payload, size=3)
    assert sorted(len(json.loads(r.value)["events"]) for r in documents.collect()) == [1, 3, 3]
    bad = spark.createDataFrame([(99, '{"events":[%s,{}]}' % event())], documents.schema)
    store = LogStore(spark, str(tmp_path / "store"))
    ingest_envelopes(documents.unionByName(bad), store, 0)
    assert sorted(r.request_id for r in store.logs().collect()) == ids
    row = store.series(3600).first()
    assert (row.requests, row.errors) == (7, 0)
    assert store.series(3600, F.lit("2031-01-01").cast("timestamp")).count() == 0
    with pytest.raises(ValueError):
        E.to_envelopes(payload, 501)


@pytest.mark.parametrize(("few", "more_refused"), [(100, 0), (100, 5), (0, 0)])
def test_envelopes_are_written_and_not_cached(spark, event, tmp_path, monkeypatch, few, more_refused):
    """Refused batches are few, accepted ones are, or neither."""
    ids = [f"00000000-0000-4000-8000-{i:012x}" for i in range(6)]
    sent = [event(request_id=x) for x in ids]
    envelope = lambda *events: '{"events": [' + ",".join(events) + "]}"
    rows = [("a", envelope(sent[0])), ("a", envelope(sent[1])), ("b", envelope(sent[2], event(latency_ms=1 << 31))), ("none", envelope())]
    rows += [(None, envelope(sent[3])), ("bad", envelope(sent[4], '{"status": 1}')), ("over", envelope(*[sent[5]] * 251)), ("over", envelope(*[sent[5]] * 250))]
    rows += [(f"bad-{i}", "{") for i in range(2)] + [(f"bad-{i}", envelope("1")) for i in range(2, 2 + more_refused)]
    cached = lambda: spark.sparkContext._jsc.getPersistentRDDs().size()
    before, seen, write = cached(), [], LogStore._dated
    monkeypatch.setattr(LogStore, "_dated", lambda self, rows, *to: (seen.append(cached()), write(self, rows, *to)))
    monkeypatch.setattr(bronze, "BROADCAST_BATCHES", few)
    store = LogStore(spark, str(tmp_path / "store"))
    for _ in range(2):  # the same batch once more
        ingest_envelopes(spark.createDataFrame(rows, "batch_id string, value string"), store, 0)
    assert max(seen) <= before
    assert sorted(r.request_id for r in store.logs().collect()) == ids[:3]
    assert [(r.stage, r.error, json.loads(r.data)["latency_ms"]) for r in store.dead_letters().collect()] == [
        ("processing", "processing error: latency_ms out of range", 1 << 31)
    ]
    assert [(r.received, r.stored, r.parked) for r in store.ledger().collect()] == [(4, 3, 1)]
    assert not list((tmp_path / "store").glob("arrived/*")) and not list((tmp_path / "store").glob("staging/*"))


def test_series_counts_redelivered_events_once(spark, event, tmp_path):
    store = LogStore(spark, str(tmp_path / "store"))
    frame = spark.createDataFrame([(event(),), (event(),)], "value string")
    ingest_batch(frame, store, 0)
    ingest_batch(frame, store, 1)
    ingest_batch(frame, store, 1)
    assert [r.requests for r in store.series(60).collect()] == [1]
    with pytest.raises(ValueError):
        store.series(90)


TEXTS = ['{"a":1}', ' {"a":1}\n', '{"a":1},"x":1', '1,"event":{"a":1}', '{"a":1}],[2', "{'a':1}", '{"a":NaN}', '{"a":1}{"a":2}', "", None, "null", "[1]", '"x"']


def test_exactly_one_json_value(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    out = df.select("i", F.to_json(J.strict_json(F.col("t"))).alias("v"), J.strict_fields(F.col("t"), "a: int")["a"].alias("a"))
    got = {r.i: (r.v, r.a) for r in out.collect()}
    one = ('{"a":1}', 1)
    assert [got[i] for i in range(len(TEXTS))] == [one, one, *[(None, None)] * 8, ("null", None), ("[1]", None), ('"x"', None)]


def test_size_does_not_change_what_json_means(spark, event):
    big = F.concat(F.lit('{"a":"'), F.repeat(F.lit("x"), 25_000_000), F.lit('"}'))
    assert spark.range(1).select(F.length(F.try_variant_get(J.strict_json(big), "$.a", "string")).alias("n")).first().n == 25_000_000
    filler = F.repeat(F.lit("x"), 1_000_000)
    one = F.concat(F.lit('{"pad":"'), filler, F.lit('",'), F.lit(event()[1:]))
    text = F.concat(F.lit('{"events":['), F.array_join(F.array_repeat(one, 200), ","), F.lit("]}"))
    envelope = spark.range(1).select(F.lit("b").alias("batch_id"), text.alias("value"))
    row = judge_batches(explode_envelopes(envelope)).first()
    assert (row.events, row.invalid, row.accepted) == (200, 0, True)


def test_escaped_backslash_is_no_nul(spark, event):
    texts = [event(client_metadata={"path": "C:\\u0000"}), event(client_metadata={"path": "C:\u0000"})]
    out = check(spark.createDataFrame([(t,) for t in texts], "value string")).checked
    assert sorted(str(r.error) for r in out.collect()) == ["None", "processing error: client_metadata holds NUL"]
