"""Session helpers shared by every operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Bytes of a batch of rows that Spark hands to Python at once; whole texts differ too much in length to be counted in rows.
BATCH_BYTES = "4m"


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the memory of Python workers by bytes, whatever the length of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by any path Spark's readers open."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    A folder of our own is set only where the session names none and all its tasks run on this machine; a
    cluster without a shared folder is refused, as each executor would write to its own disk.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillmark-"))
        at = spark.sparkContext.getCheckpointDir()
    return at


def written(df: DataFrame, label: str) -> DataFrame:
    """Cuts lineage: writes ``df`` as a table in the shared folder and reads it back.

    The shuffle files of the finished job are garbage from here on. Spark drops them when the driver collects
    its own garbage, which may be long after; a collection is asked for, so that jobs in turn don't add up on disk.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(at)
    out.written_at = at
    return out


def release(*frames: DataFrame) -> None:
    """Deletes the folders of frames that ``written`` gave, once nothing reads them any more."""
    for df in frames:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.written_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of ``df`` has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def width(spark: SparkSession) -> int:
    """Partitions that a shuffle makes in this session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
