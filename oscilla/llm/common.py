"""Reading, materialising and small helpers that the corpus operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch that is handed to Python.
BATCH_BYTES = 8 << 20
#: What may be broadcast or captured in a task closure, in bytes.
BROADCAST_BYTES = 32 << 20


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the data directory, read by Spark (the path may be in any store Spark knows)."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.  Where it is unset: in local mode one local folder, on a cluster an error."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get().rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="oscilla-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/oscilla-{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and lost executors lose nothing."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete what :func:`materialize` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    for name in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(name).getParent()
        if "/oscilla-" in path.toString():
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_BYTES for this session, unless it asks for smaller ones: long texts then do not add up."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.sub(r"\D", "", spark.conf.get(key))) > BATCH_BYTES:  # written as bytes, such as 67108864b
        spark.conf.set(key, f"{BATCH_BYTES}b")


def spread(df: DataFrame, small: int = 20 << 20) -> DataFrame:
    """A small table, by the optimizer's estimate, dealt over all cores: one row group would else be one task.  Larger ones as they are."""
    if df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() > small:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def two_columns(df: DataFrame, key: str, text: str) -> DataFrame:
    """Key (long) and text (string, null as null) alone: extra columns cannot clash with results."""
    bound_batches(df.sparkSession)
    return spread(df).select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))


def crc_mod(key: str, n: int):
    """crc32 of the key as text, modulo n (null key: null)."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % n


def record_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            yield b
