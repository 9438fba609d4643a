"""The log store: Parquet tables with idempotent batch writes.

Layout: ``logs/started_date=D/batch_id=N``, ``profile/started_date=D/batch_id=N``,
``keys/batch_id=N``, ``dead_letters/batch_id=N`` and ``ledger/batch_id=N``, and for as
long as a batch is written ``staging/batch_id=N``. Keys are
the stored request ids with their hashes, in the order of the hashes; a batch is
compared with them and never reads logs. A batch replaces only its
own folders, so writing it again after a failure has no further effect. Batch ids
come from the stream's checkpoint: a store belongs to one checkpoint, and a new
checkpoint needs a new store.

Compaction writes the batches it takes to ``packed/<table>/generation=G`` and then a
manifest, one file, that names the generations in force and the last batch they
hold. Readers take the newest manifest, its generations and all later batches.
What a manifest replaced stays readable until ``expire``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..operators.metrics import bucket_start, fold_series, latency_profile
from ..operators import dedupe
from ..operators.dedupe import counted, first_wins, hashed_keys, unseen_keys

LEDGER = T.StructType(
    [
        T.StructField("received", T.LongType()),
        T.StructField("stored", T.LongType()),
        T.StructField("duplicates", T.LongType()),
        T.StructField("parked", T.LongType()),
        T.StructField("batch_id", T.LongType()),
    ]
)


KEYS = T.StructType(
    [T.StructField("key_hash", T.LongType()), T.StructField("request_id", T.StringType()), T.StructField("batch_id", T.LongType())]
)

PROFILE_SECONDS = 60
PROFILE = T.StructType(
    [T.StructField("bucket", T.TimestampType()), T.StructField("latency_ms", T.IntegerType())]
    + [
        T.StructField(name, T.LongType())
        for name in ("requests", "success", "errors", "cancelled", "ttft_sum", "ttft_count", "tokens", "cost_micros")
    ]
    + [T.StructField("started_date", T.DateType()), T.StructField("batch_id", T.LongType())]
)

RUN = T.StructType(
    [T.StructField(name, T.LongType()) for name in ("generation", "level", "through", "version")]
)


@dataclass(frozen=True)
class Runs:
    """Generations in force with their levels, and the last batch they hold."""

    version: int = -1
    live: tuple[tuple[int, int], ...] = ()
    through: int = -1


@dataclass(frozen=True)
class LogStore:
    spark: SparkSession
    root: str

    def _read(self, table: str, schema: T.StructType) -> DataFrame:
        path = f"{self.root}/{table}"
        try:
            return self.spark.read.schema(schema).option("basePath", path).parquet(path)
        except AnalysisException as exc:
            if exc.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _holds(self, table: str) -> bool:
        try:
            self.spark.read.format("binaryFile").load(f"{self.root}/{table}")
            return True
        except AnalysisException as exc:
            if exc.getCondition() != "PATH_NOT_FOUND":
                raise
            return False

    def _versions(self) -> list[Runs]:
        """All manifests, oldest first: a few numbers for each compaction since the last ``expire``."""
        found: dict[int, list] = {}
        for row in self._read("manifest", RUN).collect():
            found.setdefault(row.version, []).append(row)
        return [
            Runs(version, tuple(sorted((r.generation, r.level) for r in rows)), max(r.through for r in rows))
            for version, rows in sorted(found.items())
        ]

    def runs(self) -> Runs:
        return (self._versions() or [Runs()])[-1]

    def _current(self, table: str, schema: T.StructType, runs: Runs | None = None) -> DataFrame:
        """A table as ``runs``, by default the newest manifest, has it."""
        runs = runs or self.runs()
        fresh = self._read(table, schema)
        if runs.version >= 0:
            # Both columns are folders, so files that don't count are not opened.
            fresh = fresh.filter(F.col("batch_id") > runs.through)
        if not runs.live:
            return fresh
        inside = T.StructType(schema.fields + [T.StructField("generation", T.LongType())])
        packed = self._read(f"packed/{table}", inside).filter(F.col("generation").isin([g for g, _ in runs.live]))
        return packed.select(*schema.names).unionByName(fresh.select(*schema.names))

    def logs(self) -> DataFrame:
        return self._current("logs", schemas.STORED_LOGS)

    def dead_letters(self) -> DataFrame:
        schema = T.StructType(
            schemas.DEAD_LETTERS.fields + [T.StructField("batch_id", T.LongType())]
        )
        return self._read("dead_letters", schema)

    def ledger(self) -> DataFrame:
        return self._read("ledger", LEDGER)

    def new_rows(self, logs: DataFrame, batch_id: int, known_rows: int | None = None) -> DataFrame:
        """First event per request that no other batch has stored.

        The batch's own earlier output does not count, otherwise a repeated
        attempt would find its rows already stored and write none.
        """
        named = lambda name: [c for c in (name,) if c in logs.columns]
        order = ["received_at", *named("pos"), "completed_at", "latency_ms", *named("_tie")]
        stored = self.keys().filter(F.col("batch_id") != batch_id)
        return unseen_keys(first_wins(logs, order).drop("pos"), stored, known_rows=known_rows)

    def keys(self) -> DataFrame:
        """Request ids of all stored logs. A store without a key table gets them from its logs."""
        if self._holds("keys") or not self._holds("logs"):
            return self._current("keys", KEYS)
        return self.logs().select(F.xxhash64("request_id").alias("key_hash"), "request_id", "batch_id")

    def _dated(self, rows: DataFrame, table: str, batch_id: int) -> None:
        """Write rows to the folders of their dates and of the batch."""
        (
            rows.withColumn("batch_id", F.lit(batch_id))
            # One file per day where that is small, several where a day holds
            # most rows: the rebalance merges and splits by size. Ordering by
            # time keeps the row-group statistics of started_at selective.
            .hint("rebalance", F.col("started_date"))
            .sortWithinPartitions("started_date", "started_at" if table == "logs" else "bucket")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("started_date", "batch_id")
            .parquet(f"{self.root}/{table}")
        )

    @contextmanager
    def held(self, rows: DataFrame, batch_id: int, folder: str) -> Iterator[DataFrame]:
        """The rows of a batch written to ``folder/batch_id=N``, to be read several times.

        The folder goes in the end; what a failed attempt left is replaced.
        """
        path = f"{self.root}/{folder}/batch_id={batch_id}"
        rows.write.mode("overwrite").parquet(f"{path}/rows")
        try:
            yield self.spark.read.schema(rows.schema).parquet(f"{path}/rows")
        finally:
            _delete(self.spark, path, lambda _: False)

    @contextmanager
    def staged(self, rows: DataFrame, batch_id: int) -> Iterator[DataFrame]:
        """The rows of a batch :meth:`held` in ``staging/batch_id=N``.

        Adds ``_at``, a number per row, and ``_tie``, a hash of all columns that can be
        hashed, by which equal events are told apart.
        """
        plain = [c for c, kind in rows.dtypes if not c.startswith("_") and "map<" not in kind and "variant" not in kind]
        marked = rows.withColumns({"_tie": F.xxhash64(*plain), "_at": F.monotonically_increasing_id()})
        with self.held(marked, batch_id, "staging") as read:
            yield read

    def append_logs(self, logs: DataFrame, batch_id: int, known_rows: int | None = None) -> int:
        """Store what is new in a batch, and its latency profile; returns the number of rows."""
        with self.staged(logs, batch_id) as rows:
            return self.append_staged(rows, batch_id, known_rows)

    def append_staged(self, logs: DataFrame, batch_id: int, known_rows: int | None = None) -> int:
        """:meth:`append_logs` for logs of :meth:`staged`.

        Keys, order and numbers of the rows alone decide what is new. Whole rows are
        read once, by the writer of logs, and only shuffled before that if both
        the new rows and the others are many.
        """
        if not self._holds("keys") and self._holds("logs"):  # a store of before there were key tables
            earlier = self.logs().filter(F.col("batch_id") != batch_id)
            hashed_keys(earlier).orderBy("key_hash").write.mode("overwrite").parquet(f"{self.root}/keys/batch_id=-1")
        given = logs.count() if known_rows is None else known_rows
        order = [c for c in ("received_at", "pos", "completed_at", "latency_ms") if c in logs.columns]
        path = f"{self.root}/staging/batch_id={batch_id}/new"
        new = self.new_rows(logs.select("request_id", *order, "_tie", "_at"), batch_id, known_rows).select("_at")
        new.write.mode("overwrite").parquet(path)
        new = self.spark.read.schema(new.schema).parquet(path)
        kept = new.count()
        rows = logs
        if kept < given:
            few = dedupe.BROADCAST_KEYS
            new = counted(new, kept <= few)
            if given - kept <= few < kept:
                rows = logs.join(F.broadcast(logs.select("_at").join(new, "_at", "left_anti")), "_at", "left_anti")
            else:
                rows = logs.join(new, "_at", "left_semi")
        rows = rows.drop("pos", "_tie", "_at").withColumn("started_date", F.to_date("started_at"))
        self._dated(rows, "logs", batch_id)
        hashed_keys(rows).orderBy("key_hash").write.mode("overwrite").parquet(f"{self.root}/keys/batch_id={batch_id}")
        bucket = bucket_start(PROFILE_SECONDS).alias("bucket")
        self._dated(latency_profile(rows, ["started_date", bucket]), "profile", batch_id)
        return kept

    def profile(self) -> DataFrame:
        """Counters of all stored logs per date, minute and latency. They add up."""
        return self._current("profile", PROFILE)

    def series(self, bucket_seconds: int = 60, since: Column | None = None) -> DataFrame:
        """The time series of the stored logs, read off their profile.

        ``since`` is an instant at the start of a minute. Only its date and later
        ones are read; buckets are whole minutes.
        """
        if bucket_seconds % PROFILE_SECONDS:
            raise ValueError(f"bucket_seconds must be a multiple of {PROFILE_SECONDS}, got {bucket_seconds!r}")
        found = self.profile()
        if since is not None:
            found = found.filter((F.col("started_date") >= F.to_date(since)) & (F.col("bucket") >= since))
        wider = found.withColumn("bucket", bucket_start(bucket_seconds, "bucket"))
        return fold_series(wider).orderBy("bucket")

    def park(self, dead_letters: DataFrame, batch_id: int) -> None:
        dead_letters.write.mode("overwrite").parquet(
            f"{self.root}/dead_letters/batch_id={batch_id}"
        )

    def note(self, batch_id: int, received: int, parked: int, stored: int) -> None:
        """Record what became of a batch; call it last."""
        row = [(received, stored, received - parked - stored, parked)]
        self.spark.createDataFrame(row, LEDGER[:4]).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/ledger/batch_id={batch_id}")

    def compact(self, fan: int = 8) -> int:
        """Pack the files of batches into few; returns how many batches came in.

        Takes all batches before the newest noted one, which alone may be written
        again. They become a generation of level 0; ``fan - 1`` generations of one
        level and the new one become a generation of the next, so a row is
        rewritten a logarithmic number of times and few generations are in force.
        Logs and their profile are packed by date, keys by hash; counters of equal
        date, minute and latency are added up. Run one compaction at a time; ingest
        and readers may go on. A compaction that fails leaves no trace for readers.
        """
        if fan < 2:
            raise ValueError(f"fan must be at least 2, got {fan!r}")
        runs = self.runs()
        batches = self.ledger().select("batch_id").filter(F.col("batch_id") > runs.through)
        noted = batches.agg(F.max("batch_id").alias("last"), F.count_distinct("batch_id").alias("n")).first()
        if noted.n < 2:
            return 0
        through, level, merged = noted.last - 1, 0, []
        while len(same := [g for g, at in runs.live if at == level]) >= fan - 1:
            merged, level = merged + same, level + 1
        old = Runs(runs.version, tuple((g, at) for g, at in runs.live if g in merged), runs.through)
        version = runs.version + 1
        taken = F.col("batch_id") <= through

        def folder(table: str) -> str:
            return f"{self.root}/packed/{table}/generation={version}"

        def dated(rows: DataFrame, table: str, time: str) -> None:
            spread = rows.hint("rebalance", F.col("started_date")).sortWithinPartitions("started_date", time)
            write = spread.write.mode("overwrite").option("partitionOverwriteMode", "static")
            write.partitionBy("started_date").parquet(folder(table))

        dated(self._current("logs", schemas.STORED_LOGS, old).filter(taken), "logs", "started_at")
        counters = [f.name for f in PROFILE if f.name not in ("bucket", "latency_ms", "started_date", "batch_id")]
        profile = self._current("profile", PROFILE, old).filter(taken).groupBy("started_date", "bucket", "latency_ms")
        dated(profile.agg(*[F.sum(c).alias(c) for c in counters]).withColumn("batch_id", F.lit(through)), "profile", "bucket")
        keys = self._current("keys", KEYS, old) if self._holds("keys") else self.keys()
        keys.filter(taken).orderBy("key_hash").write.mode("overwrite").parquet(folder("keys"))
        live = [(g, at, through) for g, at in runs.live if g not in merged] + [(version, level, through)]
        # One file: readers see it whole or not at all.
        self.spark.createDataFrame(live, RUN[:3]).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/version={version}")
        return noted.n - 1

    def expire(self, keep: int = 1) -> int:
        """Delete what only manifests older than the last ``keep`` read; returns the number of folders.

        Frames made before these manifests can't be read any more. With ``keep=1``
        only the newest manifest stays, which suits a store that nobody reads just now.
        """
        if keep < 1:
            raise ValueError(f"keep must be at least 1, got {keep!r}")
        versions = self._versions()
        kept = versions[-keep:]
        if not kept:
            return 0
        live = {g for runs in kept for g, _ in runs.live}
        gone = 0
        for pattern, stays in (
            ("keys/batch_id=*", lambda n: n > kept[0].through),
            *((f"{table}/started_date=*/batch_id=*", lambda n: n > kept[0].through) for table in ("logs", "profile")),
            *((f"packed/{table}/generation=*", lambda n: n in live or n > kept[-1].version) for table in ("logs", "profile", "keys")),
            ("manifest/version=*", lambda n: n >= kept[0].version),
        ):
            gone += _delete(self.spark, f"{self.root}/{pattern}", stays)
        return gone


def _delete(spark: SparkSession, pattern: str, stays: Callable[[int], bool]) -> int:
    """Delete folders named ``key=number`` that match a pattern, but for those whose number stays."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    gone = [x.getPath() for x in files.globStatus(path) or () if not stays(int(x.getPath().getName().partition("=")[2]))]
    for folder in gone:
        files.delete(folder, True)
    return len(gone)
