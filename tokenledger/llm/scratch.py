"""Tables written between steps, and what every operator asks of its input."""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from ..session import configure, shared_dir


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of this subpackage: Arrow batches of few rows, since one
    row may hold a very long text."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    return spark


def settled(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` written to the shared folder and read again.

    Cuts the lineage; the files survive the loss of any executor.
    """
    spark = frame.sparkSession
    path = shared_dir(spark, f"llm-{name}")
    frame.write.parquet(path)
    out = spark.read.schema(frame.schema).parquet(path)
    out._written = path
    return out


def released(*frames: DataFrame) -> None:
    """Deletes tables of ``settled`` that nothing reads any more, since all that was
    made of them is written itself."""
    for frame in frames:
        spark = frame.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(frame._written)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def unused(columns: list[str], name: str) -> str:
    """``name`` with as many underscores behind it as make it differ from ``columns``."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def shipped(spark: SparkSession, value):
    """``value`` broadcast as bytes: its class travels along and need not be
    installed on the executors. Read it with ``pickle.loads(handle.value)``.

    For values of a size set by parameters, such as models.
    """
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))
