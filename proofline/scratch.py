"""Where intermediate tables live.

Iterative and multi-pass operators cut their lineage with a written table. It goes into the folder that the
session names in ``spark.checkpoint.dir``, which every executor of a cluster can read, so that losing an executor
loses nothing. Only where that setting is absent and the master is local is a temporary folder used.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The shared folder of this session, without a slash at its end."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = context._jsc.sc().getCheckpointDir()
        named = held.get() if held.isDefined() else None
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="proofline-")
        context.setCheckpointDir(named)
    return named.rstrip("/")


def _written(df: DataFrame, name: str, codec: str) -> str:
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    jvm = df.sparkSession.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """``df`` written to the shared folder and read again. The files are removed when the session's JVM ends."""
    path = _written(df, name, codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Removes a table that ``written`` made and that nothing reads any more."""
    spark = df.sparkSession
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for file in df.inputFiles()[:1]:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(conf).delete(path, True)


ROW_GROUP = 128 << 20  # bytes


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if its files are smaller than one row group, which one task would read; the same rows.
    Larger tables have splits enough and are not moved. For work that costs far more than moving the rows."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size < ROW_GROUP else df


def dealt(df: DataFrame, share: int = 4 << 20) -> DataFrame:
    """``df`` in parts of about ``share`` bytes, four per core at least, however its files and row groups are cut: a large
    file may be one row group, which one task would read. For work that costs far more than moving the rows."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(max(4 * df.sparkSession.sparkContext.defaultParallelism, min(size // share, 10_000)))


def once(df: DataFrame) -> DataFrame:
    """``df`` through a generator of one row, below which Spark moves no filter: a filter on a column that is the end of a
    long chain of expressions would otherwise repeat the chain for each place that names it."""
    return df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))
