from __future__ import annotations

import re
import shutil

import pytest
from pyspark.sql import functions as F

from tokenledger.operators import dedupe
from tokenledger.operators.process import check, to_logs
from tokenledger.sources.store import LogStore
from tokenledger.streaming.ingest import first_in_stream, gauges, ingest_batch, start_ingest
from tokenledger.streaming.series import read_live_series, start_live_series


def _frame(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "value string")


def test_ingest_is_idempotent(spark, event, tmp_path, monkeypatch):
    store = LogStore(spark, str(tmp_path / "store"))
    a, b, c = (event(request_id=f"00000000-0000-4000-8000-00000000000{i}") for i in "abc")
    ingest_batch(_frame(spark, a, a, b, "{"), store, 0)
    ingest_batch(_frame(spark, a, a, b, "{"), store, 0)
    monkeypatch.setattr(dedupe, "BROADCAST_KEYS", 0)
    ingest_batch(_frame(spark, b, c), store, 1)
    assert store.logs().count() == 3
    assert store.dead_letters().count() == 1
    ledger = {r.batch_id: (r.received, r.stored, r.duplicates, r.parked) for r in store.ledger().collect()}
    assert ledger == {0: (4, 2, 1, 1), 1: (2, 1, 1, 0)}
    row = gauges(_frame(spark, *"abcdefg"), store).first()
    assert (row.stream_depth, row.pending, row.dlq_depth) == (7, 1, 1)


def test_stream_picks_up_where_it_stopped(spark, event, tmp_path):
    landing, store = tmp_path / "in", LogStore(spark, str(tmp_path / "store"))
    landing.mkdir()
    ids = [f"00000000-0000-4000-8000-{i:012x}" for i in range(4)]
    stream = lambda: spark.readStream.format("text").load(str(landing))
    (landing / "1.txt").write_text("\n".join(event(request_id=i) for i in ids[:2]))
    start_ingest(stream(), store, str(tmp_path / "cp")).awaitTermination()
    (landing / "2.txt").write_text("\n".join([event(request_id=i) for i in ids[1:]] + ['{"this": "is bad"}']))
    start_ingest(stream(), store, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.request_id for r in store.logs().collect()) == ids
    assert store.dead_letters().count() == 1
    assert store.ledger().count() == 2


def test_a_batch_reads_no_logs(spark, event, tmp_path, monkeypatch):
    store = LogStore(spark, str(tmp_path / "store"))
    ids = [f"00000000-0000-4000-8000-{i:012x}" for i in range(9)]
    ingest_batch(_frame(spark, *(event(request_id=i) for i in ids[:5])), store, 0)
    rows = spark.createDataFrame([(i, "2025-03-09", None, 1) for i in ids[3:]], "request_id string, received_at string, completed_at string, latency_ms int")
    for known in (6, None):
        new = store.new_rows(rows, 1, known)
        assert sorted(r.request_id for r in new.collect()) == ids[5:]
        assert not [f for f in new.inputFiles() if "/keys/" not in f]
        kept = store.new_rows(rows.filter(rows.request_id > ids[4]), 1, known)  # no hash is met: nothing stored is read
        assert kept.count() == 4 and not kept.inputFiles()
    # Another key with a stored hash is new all the same.
    clash = spark.createDataFrame([(k.key_hash, "other", 0) for k in store.keys().collect()], store.keys().schema)
    assert dedupe.unseen_keys(rows, clash).count() == 6
    # A store written before there were key tables.
    monkeypatch.setattr(LogStore, "_holds", lambda self, table: table == "logs")
    assert sorted(r.request_id for r in store.new_rows(rows, 1, 6).collect()) == ids[5:]


def test_many_keys_are_never_broadcast(spark, monkeypatch):
    monkeypatch.setattr(dedupe, "BROADCAST_KEYS", 2)
    rows = spark.range(9).select(F.format_string("r%d", "id").alias("request_id"))  # few bytes, as Spark knows
    for last, joins in ((5, "SortMergeJoin"), (1, "BroadcastHashJoin")):  # how many hashes are met is counted
        keys = dedupe.hashed_keys(rows.filter(F.col("request_id") < f"r{last}"))
        new = dedupe.unseen_keys(rows, keys, known_rows=9)
        found, _, met = new._jdf.queryExecution().executedPlan().toString().partition("InMemoryRelation")
        assert joins in found and "Broadcast" not in met
        assert sorted(r.request_id for r in new.collect()) == [f"r{i}" for i in range(last, 9)]
    # Without stored keys the new ones are not made.
    broken = rows.select(F.raise_error(F.lit("made")).cast("string").alias("request_id"))
    assert dedupe.unseen_keys(broken, keys.limit(0), known_rows=9).columns == ["request_id"]


@pytest.fixture
def stored(spark, event):
    """Writes one batch of a store: the events of some numbers, one date each for a hundred."""
    ids = [f"00000000-0000-4000-8000-{i:012x}" for i in range(300)]
    texts = [event(request_id=x, started_at=f"2025-03-0{1 + i // 100}T07:30:00Z", latency_ms=1700 + 10 * (i % 2)) for i, x in enumerate(ids)]
    rows = to_logs(check(_frame(spark, *texts)).checked, processed_at=F.current_timestamp()).persist()

    def put(store, batch_id, *numbers):
        batch = rows.filter(rows.request_id.isin([ids[i] for i in numbers]))
        store.note(batch_id, len(numbers), 0, store.append_logs(batch, batch_id, len(numbers)))

    yield put, ids
    rows.unpersist()


def test_compaction(spark, stored, tmp_path):
    store, (put, ids) = LogStore(spark, str(tmp_path / "store")), stored
    counts = lambda: [(str(r.bucket), r.requests, r.tokens, r.p95_latency_ms) for r in store.series(60).collect()]
    assert store.compact() == 0 and store.expire() == 0  # an empty store
    packed, shapes = [], []
    for n in range(5):
        put(store, n, n, max(n - 1, 0))
        before, reader = counts(), store.logs()
        packed.append(store.compact(fan=2))
        shapes.append([level for _, level in store.runs().live])
        assert counts() == before
        for frame in (reader, store.logs()):  # a reader from before and one from after
            assert sorted(r.request_id for r in frame.collect()) == ids[: n + 1]
    assert packed == [0, 1, 1, 1, 1] and shapes == [[], [0], [1], [1, 0], [2]]
    assert sorted((r.request_id, r.batch_id) for r in store.keys().collect()) == list(zip(ids, range(5)))
    older = store.logs()
    put(store, 5, 0)
    assert store.compact(fan=2) == 1 and [level for _, level in store.runs().live] == [2, 0]
    store.expire(keep=2)
    assert older.count() == 5  # made of the manifest before
    assert store.expire() > 0
    assert sorted(r.request_id for r in store.logs().collect()) == ids[:5] and len(store.logs().inputFiles()) == 2
    assert counts() == before
    put(store, 5, 0)  # a batch that is written again, and one whose rows are all known
    put(store, 6, 0, 1, 2, 3, 4)
    assert store.logs().count() == 5 and {r.batch_id: r.duplicates for r in store.ledger().collect()}[6] == 5
    with pytest.raises(ValueError):
        store.compact(fan=1)


def test_many_batches_become_a_file_a_date(spark, stored, tmp_path):
    store, (put, ids) = LogStore(spark, str(tmp_path / "store")), stored
    for n in range(10):
        put(store, n, n, 100 + n)
    put(store, 10, 200)
    assert len(store.logs().inputFiles()) >= 21
    assert store.compact() == 10
    store.expire()
    assert len(store.logs().inputFiles()) == 3 and store.logs().count() == 21
    day = store.logs().filter("started_date = '2025-03-02'")
    assert day.count() == 10
    assert len(re.findall(r"PartitionFilters: \[[^\]]*started_date", day._jdf.queryExecution().simpleString())) == 2


def test_a_failed_compaction_leaves_no_trace(spark, stored, tmp_path, monkeypatch):
    store, (put, _) = LogStore(spark, str(tmp_path / "store")), stored
    for n in range(3):
        put(store, n, 100 * n)
    with monkeypatch.context() as m:
        m.setattr(LogStore, "_holds", lambda self, table: 1 / 0)  # after logs and profile are written
        with pytest.raises(ZeroDivisionError):
            store.compact()
    assert store.runs().version == -1 and store.logs().count() == store.profile().count() == 3
    assert store.compact() == 2 and store.logs().count() == store.profile().count() == store.keys().count() == 3


def test_first_batch_after_a_store_without_keys(spark, stored, tmp_path):
    store, (put, _) = LogStore(spark, str(tmp_path / "store")), stored
    put(store, 0, 0)
    shutil.rmtree(tmp_path / "store" / "keys")
    put(store, 1, 1)
    put(store, 2, 0, 1)
    assert store.logs().count() == store.keys().count() == 2


def test_keyed_state_over_restarts(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()

    def arrives(name, *rows):
        (landing / name).write_text("\n".join(f"{k},{at}" for k, at in rows))
        stream = spark.readStream.schema("request_id string, at int").csv(str(landing))
        first_in_stream(stream, ["at"]).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
        return sorted((r.request_id, r["at"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert arrives("1", ("a", 5), ("a", 2), ("b", 7)) == [("a", 2), ("b", 7)]
    assert arrives("2", ("b", 1), ("c", 9), ("a", 0)) == [("a", 2), ("b", 7), ("c", 9)]


def test_keyed_state_is_not_asked_key_by_key(spark, tmp_path):
    rows = spark.range(60_000).selectExpr("concat('k', id % 30000) AS request_id", "IF(id % 30000 = 7 AND id > 7, NULL, CAST(100000 - id AS INT)) AS at", "CAST(id AS STRING) AS note")
    hot = spark.range(40_000).selectExpr("'hot' AS request_id", "CAST(abs(id - 25000) AS INT) AS at", "CAST(id AS STRING) AS note")
    rows.unionByName(hot).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("request_id string, at int, note string").parquet(str(tmp_path / "in"))
    found = first_in_stream(stream, ["at"])
    assert "TransformWithState" not in (plan := found._jdf.queryExecution().logical().toString()) and "Deduplicate" in plan
    found.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    got = {r.request_id: (r["at"], r.note) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {f"k{i}": (70_000 - i, str(30_000 + i)) for i in range(30_000)} | {"k7": (None, "30007"), "hot": (0, "25000")}
    assert got == want


def test_second_pass_redaction(spark, event, tmp_path):
    store = LogStore(spark, str(tmp_path / "store"))
    ingest_batch(_frame(spark, event(input_preview="ask kim.lund@paper.example today", pii_redaction_count=2)), store, 0, redact_again=True)
    row = store.logs().first()
    assert (row.input_preview, row.pii_redaction_count) == ("ask [REDACTED_EMAIL] today", 3)


def test_shared_dir_needs_a_setting_on_a_cluster(spark, monkeypatch):
    from tokenledger import session

    class Conf:
        def get(self, key, default=None):
            return default

    class Cluster:
        conf = Conf()
        sparkContext = type("C", (), {"master": "yarn"})

    with pytest.raises(ValueError):
        session.shared_dir(Cluster(), "x")


def test_live_series_writes_what_changed(spark, tmp_path):
    landing, out = tmp_path / "in", str(tmp_path / "out")
    landing.mkdir()
    schema = "started_at timestamp, latency_ms int, status string, ttft_ms int, total_tokens int, estimated_cost_usd double"

    def arrives(name, *rows, watermark=None, at=tmp_path / "cp", to=out):
        (landing / name).write_text("\n".join(f"2024-01-01T{t}Z,{ms},success,,5,0.5" for t, ms in rows))
        logs = spark.readStream.schema(schema).csv(str(landing))
        start_live_series(logs, to, str(at), 60, watermark=watermark).awaitTermination()
        return [(r.bucket.minute, r.requests, r.p95_latency_ms, r.tokens) for r in read_live_series(spark, to).collect()]

    assert arrives("1", ("10:00:01", 100), ("10:00:02", 100), ("10:05:00", 300)) == [(0, 2, 100, 10), (5, 1, 300, 5)]
    assert arrives("2", ("10:00:59", 200)) == [(0, 3, 190, 15), (5, 1, 300, 5)]  # late, and only its bucket is written
    written = spark.read.option("basePath", out).parquet(out)
    assert {(r.batch_id, r.bucket.minute, r.latency_ms) for r in written.collect()} == {(0, 0, 100), (0, 5, 300), (1, 0, 200)}

    other, cp = str(tmp_path / "bounded"), tmp_path / "cp2"
    arrives("3", ("12:00:00", 100), watermark="10 minutes", at=cp, to=other)
    before = read_live_series(spark, other).count()
    arrives("4", ("12:01:00", 100), watermark="10 minutes", at=cp, to=other)
    arrives("5", ("10:30:00", 100), watermark="10 minutes", at=cp, to=other)  # behind the watermark: dropped
    assert read_live_series(spark, other).count() == before + 1


def test_a_batch_is_staged_and_not_cached(spark, event, tmp_path, monkeypatch):
    """New rows are found by number, whichever side is few; nothing wide is kept in blocks."""
    ids = [f"00000000-0000-4000-8000-{i:012x}" for i in range(12)]
    sent = [event(request_id=x, latency_ms=1700 + n) for x in ids[:8] for n in (0, 1)] + ["{", event(latency_ms=1 << 31)]
    cached = lambda: spark.sparkContext._jsc.getPersistentRDDs().size()
    before, seen, write = cached(), [], LogStore._dated
    monkeypatch.setattr(LogStore, "_dated", lambda self, rows, *to: (seen.append(cached()), write(self, rows, *to)))
    # Batch 0 keeps and drops many, batch 1 drops few, batch 2 keeps none.
    monkeypatch.setattr(dedupe, "BROADCAST_KEYS", 2)
    store = LogStore(spark, str(tmp_path / "store"))
    ingest_batch(_frame(spark, *sent), store, 0)
    assert max(seen) <= before
    ingest_batch(_frame(spark, *(event(request_id=x) for x in ids[6:])), store, 1)
    ingest_batch(_frame(spark, *(event(request_id=x) for x in ids[:3])), store, 2)
    rows = store.logs().collect()
    assert sorted(r.request_id for r in rows) == ids and {r.latency_ms for r in rows if r.batch_id == 0} == {1700}
    assert not set(rows[0].asDict()) & {"_at", "_tie", "_dead", "pos"}
    ledger = {r.batch_id: (r.received, r.stored, r.duplicates, r.parked) for r in store.ledger().collect()}
    assert ledger == {0: (18, 8, 8, 2), 1: (6, 4, 2, 0), 2: (3, 0, 3, 0)}
    assert sorted(r.stage for r in store.dead_letters().collect()) == ["processing", "validation"]
    assert store.keys().count() == 12 and not list((tmp_path / "store").glob("staging/*"))
