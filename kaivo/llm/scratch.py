"""Tables that cut lineage, written to the folder that all executors share; broadcasts behind a check of their size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where it is unset, a folder of our own in local mode (tests), else an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: on a cluster it must name a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='kaivo-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


#: The tables of one driver process lie in one folder.
RUN = f"kaivo-{uuid.uuid4().hex}"


def clean_up(spark: SparkSession) -> None:
    """Deletes the tables that this process has written. Results are lazy and read them, so call it when they have been stored."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{RUN}")
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Bytes of the tables that a result is made from, by the plan's own estimate, which one of its files stands for at least.
FILE_BYTES = 2 << 20
#: Files are made fewer only where they would be so many times as many.
FEWER = 4


def together(docs: DataFrame) -> DataFrame:
    """``docs`` in no more partitions than one for FILE_BYTES, by the plan's own estimate: small ones are read together, none is shuffled.

    A result made of ``docs`` without a shuffle then isn't many small files, whose processes are told of in ``gathered``.
    """
    read = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return docs.coalesce(max(1, min(1 << 20, -(-read // FILE_BYTES))))


#: Rows of a narrow table (some numbers each) that one of its files stands for at least.
FILE_ROWS = 1 << 17


def gathered(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` in fewer partitions, if those of its shuffles are many for what it reads, or for its ``rows``.

    rows: about how many rows a table of a few numbers has, if the caller has counted them. On a local file system each file written has Hadoop start processes (chmod), and until such a child runs its own program it shares
    the whole memory of the executor's JVM. The tasks that compute ``df`` stay as they are; its rows are shuffled once more.
    """
    shuffled = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if rows is not None and rows // FILE_ROWS < shuffled:
        return df.repartition(1 + rows // FILE_ROWS)
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    read = sum(int(leaves.apply(k).stats().sizeInBytes()) for k in range(leaves.size()))
    files = max(1, -(-read // FILE_BYTES))
    return df.repartition(files) if files * FEWER <= shuffled else df


#: Hadoop's options for writing our own tables: on a local file system without checksum files, for each of which it starts a process
#: (chmod) more, and without the file that marks a job's end. Other file systems aren't concerned but for the latter.
PLAIN = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true", "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}


def written(df: DataFrame, name: str, gather: bool = True, rows: int | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: survives lost executors, is computed once.

    rows: as in ``gathered``.
    gather: False for rows that come out differently if a task is repeated (ids by position), since those mustn't be shuffled on.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{RUN}/{name}-{uuid.uuid4().hex}"
    (gathered(df, rows) if gather else df).write.options(compression="zstd", **PLAIN).parquet(at)
    return spark.read.schema(df.schema).parquet(at)


#: A table is broadcast up to so many rows times its widest row's values; beyond that Spark chooses.
BROADCAST_VALUES = 2_000_000


def small(df: DataFrame, values: int) -> DataFrame:
    """``df`` with a broadcast hint if it has no more than BROADCAST_VALUES ``values`` (numbers), a count that the caller has measured."""
    return F.broadcast(df) if values <= BROADCAST_VALUES else df


#: Bytes of an Arrow batch that a Python worker gets at once.
BATCH_BYTES = 4 << 20


def bounded(df: DataFrame) -> DataFrame:
    """``df``; its session's Arrow batches from now on hold at most BATCH_BYTES, where the setting has its default of 64 MB."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(key) in ("67108864b", "64MB", "64m"):
        df.sparkSession.conf.set(key, str(BATCH_BYTES))
    return df
