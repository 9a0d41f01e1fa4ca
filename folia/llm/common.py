"""Shared helpers of the training-data operators: inputs, shared scratch tables, word rules."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"

_own_dirs: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset and
    driver and executors are one process."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="folia-")
    return _own_dirs[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/folia/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Deletes this application's tables in the shared folder. To be called when no result is needed any more: results
    are read from them lazily."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/folia/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """df written once to the shared folder and read back: later readers neither recompute it nor depend on
    executors that may be lost."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, column: str) -> DataFrame:
    """df as a table in the shared folder, bucketed by a column: grouping by it doesn't shuffle these rows again."""
    spark = df.sparkSession
    table = f"folia_{name}_{uuid.uuid4().hex}"
    df.write.option("path", new_path(spark, name)).option("compression", "zstd").bucketBy(shuffle_width(spark), column).saveAsTable(table)
    return spark.table(table)


def small_enough(df: DataFrame, most_rows: int) -> bool:
    """Whether df has at most most_rows rows; reads no more than one row beyond."""
    return df.limit(most_rows + 1).count() <= most_rows


def broadcast_if(df: DataFrame, most_rows: int) -> DataFrame:
    """A broadcast hint only for a side whose row count was checked; else Spark's own choice of join."""
    return F.broadcast(df) if small_enough(df, most_rows) else df


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
