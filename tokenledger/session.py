"""Spark session settings the library relies on, and shared scratch space."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

# All are runtime SQL settings, so they can also be applied to a session that
# somebody else created.
RUNTIME_CONF = {
    # Event times are UTC instants; naive input is read as UTC.
    "spark.sql.session.timeZone": "UTC",
    # Merging tags over metadata must let the later map win.
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # A repeated JSON key keeps its last value instead of failing the parse.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Generated methods the JVM would refuse to compile are slower than
    # interpreted expressions.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Streaming state lives on disk and may outgrow the memory of an executor.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session and return it."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(app: str = "tokenledger", cpus: int | str = "*") -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TOKENLEDGER_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = configure(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@cache
def _own_folder() -> str:
    path = tempfile.mkdtemp(prefix="tokenledger-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder path every executor can reach.

    It lies under ``spark.checkpoint.dir``. A local session without that setting
    gets a temporary folder of its own, removed when the process ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(
                "set spark.checkpoint.dir to a folder shared by all executors"
            )
        base = _own_folder()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` written to a new shared folder and read again.

    What a task computed once, such as numbers that depend on its partition, stays
    as it is however often later stages run again.
    """
    path = shared_dir(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
