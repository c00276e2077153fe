"""Word bags as rows, and their cosine as a join on words."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import word_tokens


def word_bags(texts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, token, cnt. Counts are combined before the shuffle."""
    return texts.select(*keys, F.explode(word_tokens(F.col("text"))).alias("token")).groupBy(*keys, "token").agg(F.count("*").alias("cnt"))


def bag_norms(bags: DataFrame, keys: Sequence[str]) -> DataFrame:
    return bags.groupBy(*keys).agg(F.sqrt(F.sum(F.col("cnt") * F.col("cnt"))).alias("norm"))


def pair_cosine(pairs: DataFrame, bags: DataFrame, key: str = "doc_id") -> DataFrame:
    """left, right, cosine of the given pairs (left, right): 0 where they share no word."""
    size = F.sqrt(F.sum(F.col("cnt") * F.col("cnt")).over(Window.partitionBy(key)))
    sized = bags.select(key, "token", "cnt", size.alias("norm"))
    side = lambda name, c: sized.select(F.col(key).alias(name), "token", F.col("cnt").alias(c), F.col("norm").alias(f"n{c}"))
    both = pairs.join(side("left", "a"), "left").join(side("right", "b"), ["right", "token"])
    shared = both.groupBy("left", "right").agg((F.sum(F.col("a") * F.col("b")) / (F.max("na") * F.max("nb"))).alias("cosine"))
    return pairs.join(shared, ["left", "right"], "left").select("left", "right", F.coalesce("cosine", F.lit(0.0)).alias("cosine"))
