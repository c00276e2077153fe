"""Text sources: files, and remote texts behind a read-through cache of landed files."""

from __future__ import annotations

import urllib.request
from collections.abc import Callable, Iterable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import universal_newlines
from ..operators.segment import strip_boilerplate

TIMEOUT = 30
#: The addresses of a text by its id, in the order in which they are tried.
TEXT_URLS = (
    "https://www.gutenberg.org/cache/epub/{0}/pg{0}.txt",
    "https://www.gutenberg.org/files/{0}/{0}-0.txt",
    "https://www.gutenberg.org/files/{0}/{0}.txt",
)


def read_texts(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """path, text of whole files: UTF-8 with bad bytes replaced, line ends made plain."""
    found = spark.read.format("binaryFile").load(paths if isinstance(paths, str) else list(paths))

    @F.pandas_udf("string")
    def decode(content: pd.Series) -> pd.Series:
        return content.map(lambda b: bytes(b).decode("utf-8", "replace"))

    return found.select("path", universal_newlines(decode("content")).alias("text"))


def fetch(url: str) -> str | None:
    """The body of an address, or None where it can't be had or is blank."""
    try:
        with urllib.request.urlopen(url, timeout=TIMEOUT) as reply:
            body = reply.read().decode("utf-8", "replace")
    except OSError:
        return None
    return body if body.strip() else None


def first_text(text_id: int, get: Callable[[str], str | None] = fetch, urls: Iterable[str] = TEXT_URLS) -> str:
    for url in urls:
        if (body := get(url.format(text_id))) is not None:
            return body
    raise RuntimeError(f"no source has text {text_id}")


LANDED = "text_id long, text string, landed timestamp"


def landed(spark: SparkSession, ids: DataFrame, landing: str, get: Callable[[str], str | None] = fetch, refresh: bool = False, strict: bool = True) -> DataFrame:
    """text_id, text without boilerplate. Texts not yet in the `landing` table (raw, Parquet) are fetched on
    the executors and added to it; boilerplate is taken off at every read. `refresh` fetches all of `ids` again and
    adds them as newer ones; the newest of each id counts, and no other text is touched. An id without
    source is an error, or with `strict` off has no row, while the others are landed."""
    wanted = ids.select(F.col("text_id").cast("long").alias("text_id")).distinct()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(landing)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    known = lambda: spark.read.schema(LANDED).parquet(landing)
    missing = wanted if refresh or not there else wanted.join(known().select("text_id"), "text_id", "left_anti")

    def one(text_id: int) -> str | None:
        try:
            return first_text(text_id, get)
        except RuntimeError:
            if strict:
                raise
            return None

    def run(frames):
        for frame in frames:
            yield pd.DataFrame({"text_id": frame["text_id"], "text": [one(int(i)) for i in frame["text_id"]]})

    fetched = missing.mapInPandas(run, "text_id long, text string").where("text is not null")
    fetched.withColumn("landed", F.current_timestamp()).write.mode("append").parquet(landing)
    newest = known().join(wanted, "text_id", "left_semi").groupBy("text_id").agg(F.max("landed").alias("newest"))  # reads no text
    raw = known().join(newest, "text_id").where(F.col("landed").eqNullSafe(F.col("newest")))
    return raw.select("text_id", strip_boilerplate(universal_newlines(F.col("text"))).alias("text"))


def load_text(jobs: DataFrame, files: DataFrame, texts: DataFrame, path: str, text_id: str) -> DataFrame:
    """`jobs` with `text`: of the file in column `path` where given, else of the id in column `text_id`."""
    f = files.select(F.col("path").alias(path), F.col("text").alias("__file"))
    t = texts.select(F.col("text_id").alias(text_id), F.col("text").alias("__text"))
    joined = jobs.join(f, path, "left").join(t, text_id, "left")
    missing = F.raise_error(F.concat(F.lit("no text for "), F.coalesce(F.col(path), F.col(text_id).cast("string"), F.lit("a job without path and id"))))
    chosen = F.when(F.col(path).isNotNull(), F.col("__file")).otherwise(F.col("__text"))
    return joined.withColumn("text", F.coalesce(chosen, missing.cast("string"))).drop("__file", "__text")
