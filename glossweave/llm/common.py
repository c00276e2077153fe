"""Shared helpers: scratch tables that survive lost executors, and table access."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BATCH_BYTES = "8m"
FILTER_BITS = 1 << 25
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Where none is set, a local master gets a folder of its
    own; on a cluster that is an error, since executors would not see each other's files."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="glossweave-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed when the driver's JVM ends."""
    path = f"{scratch_root(spark)}/glossweave/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def materialize(df: DataFrame, label: str, release: bool = False) -> DataFrame:
    """Cut lineage: write `df` to the shared folder and read it again. `release` has the driver collect garbage
    then, upon which Spark deletes the shuffle files of the steps that are over; and before, since the events of the
    last step still hold its shuffle files when it ends."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    if release:
        spark.sparkContext._jvm.System.gc()
    df.write.mode("overwrite").parquet(path)
    if release:
        spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


_BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b")


_KEPT: dict[str, object] = {}


def kept(key: str, make):
    """What `make` gives, for this worker process's later tasks too, until a task asks for another key or keeps nothing."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def forget() -> None:
    """What is kept goes, and its memory goes back to the system before the task takes any of its own."""
    if _KEPT:
        _KEPT.clear()
        give_back()


def give_back() -> None:
    """Free memory goes back to the system: a worker process outlives its task and else stays as large as the task was."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # other C libraries
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def in_arrow(df: DataFrame, run, schema, keeps: bool = False) -> DataFrame:
    """`df.mapInArrow` over batches of about BATCH_BYTES at most, so that what a worker and its JVM hold of them
    does not grow with the length of texts. A session that sets a bound of its own keeps it. Worker processes serve one
    operator after another, so what is `kept` goes unless `run` keeps it, and a task's free memory goes at its end."""
    conf = df.sparkSession.conf
    if conf.get(*_BATCH) == _BATCH[1]:  # as Spark has it
        conf.set(_BATCH[0], BATCH_BYTES)

    def lean(batches):
        if not keeps:
            forget()
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(lean, schema)


def discard(*tables: DataFrame) -> None:
    """Delete written tables that no later step reads. What was made from them has to be written itself by then, so
    that a lost executor needs none of them."""
    for table in tables:
        spark = table.sparkSession
        for path in {name.rsplit("/", 1)[0] for name in table.inputFiles()}:
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def likely(rows: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose `column` (a long hash) may be among those in `keys`, null ones not: a filter before a join that
    most rows would only be shuffled for. It passes every match and about as large a share of the others as there are
    keys to FILTER_BITS; the broadcast has FILTER_BITS bits at most, whatever the number of keys."""
    place = lambda c: F.pmod(F.col(c), F.lit(FILTER_BITS))
    at, bucket, bits = (internal(rows, x) for x in ("at", "bucket", "bits"))
    maps = keys.select(place(key).alias(at)).groupBy(F.bitmap_bucket_number(at).alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias(bits))
    found = rows.withColumn(at, place(column)).withColumn(bucket, F.bitmap_bucket_number(at)).join(F.broadcast(maps), bucket)
    bit = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring(bits, (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return found.where(F.getbit(byte, (bit % 8).cast("int")) == 1).select(*rows.columns)


def internal(df: DataFrame, label: str) -> str:
    """A column name made of `label` that no column of `df` has, whatever case names are compared in."""
    taken = {c.lower() for c in df.columns}
    name = f"__{label}"
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
