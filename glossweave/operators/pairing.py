"""Pairing of the divisions of two editions, book by book, in one plan for all books."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ordered_join
from .align import DIVISION_STEPS, align_blocks

BLOCK_JOIN = "\n\n"


def division_counts(src: DataFrame, tgt: DataFrame, book: str = "book_id") -> DataFrame:
    """book, n_src, n_tgt, how: zip (equal and over one), fuzzy (different, both over one), else block."""
    a = src.groupBy(book).agg(F.count("*").alias("n_src"))
    b = tgt.groupBy(book).agg(F.count("*").alias("n_tgt"))
    both = a.join(b, book, "full").select(book, F.coalesce("n_src", F.lit(0)).alias("n_src"), F.coalesce("n_tgt", F.lit(0)).alias("n_tgt"))
    how = F.when((F.col("n_src") == F.col("n_tgt")) & (F.col("n_src") > 1), "zip").when((F.col("n_src") > 1) & (F.col("n_tgt") > 1), "fuzzy").otherwise("block")
    return both.withColumn("how", how)


def zip_pairs(src: DataFrame, tgt: DataFrame, book: str = "book_id") -> DataFrame:
    """Divisions with the same ordinal: book, ch_idx, s_title, s_body, t_title, t_body."""
    a = src.select(book, F.col("div_idx").alias("ch_idx"), F.col("title").alias("s_title"), F.col("body").alias("s_body"))
    b = tgt.select(book, F.col("div_idx").alias("ch_idx"), F.col("title").alias("t_title"), F.col("body").alias("t_body"))
    return a.join(b, [book, "ch_idx"])


def single_blocks(src: DataFrame, tgt: DataFrame, book: str = "book_id") -> DataFrame:
    """Each book as one untitled pair of all its bodies, joined in order."""
    whole = lambda d, c: d.groupBy(book).agg(ordered_join(F.col("div_idx"), F.col("body"), BLOCK_JOIN).alias(c))
    both = whole(src, "s_body").join(whole(tgt, "t_body"), book, "full")
    return both.select(book, F.lit(1).alias("ch_idx"), F.lit("").alias("s_title"), F.coalesce("s_body", F.lit("")).alias("s_body"), F.lit("").alias("t_title"), F.coalesce("t_body", F.lit("")).alias("t_body"))


def fuzzy_pairs(src: DataFrame, tgt: DataFrame, book: str = "book_id") -> DataFrame:
    """Divisions matched by meaning (`vec` column); unmatched ones stay one-sided."""
    side = lambda d: d.select(book, F.col("div_idx").alias("seg_idx"), F.to_json(F.struct("title", "body")).alias("text"), "vec")
    beads = align_blocks(side(src), side(tgt), [book], "embed", DIVISION_STEPS)
    back = lambda c, f: F.coalesce(F.get_json_object(F.try_element_at(c, F.lit(1)), f"$.{f}"), F.lit(""))
    return beads.select(book, F.col("bead_idx").alias("ch_idx"), back(F.col("src"), "title").alias("s_title"), back(F.col("src"), "body").alias("s_body"), back(F.col("tgt"), "title").alias("t_title"), back(F.col("tgt"), "body").alias("t_body"))


def pair_divisions(src: DataFrame, tgt: DataFrame, book: str = "book_id", by_meaning: bool = False) -> DataFrame:
    """book, ch_idx, title (the target's, else the source's), s_body, t_body, by each book's own way."""
    counts = division_counts(src, tgt, book)
    of = lambda d, *hows: d.join(counts.where(F.col("how").isin(*hows)).select(book), book, "left_semi")
    pairs = zip_pairs(of(src, "zip"), of(tgt, "zip"), book)
    if by_meaning:
        pairs = pairs.unionByName(fuzzy_pairs(of(src, "fuzzy"), of(tgt, "fuzzy"), book)).unionByName(single_blocks(of(src, "block"), of(tgt, "block"), book))
    else:
        pairs = pairs.unionByName(single_blocks(of(src, "block", "fuzzy"), of(tgt, "block", "fuzzy"), book))
    title = F.coalesce(F.nullif("t_title", F.lit("")), F.col("s_title"))
    return pairs.select(book, "ch_idx", title.alias("title"), "s_body", "t_body")
