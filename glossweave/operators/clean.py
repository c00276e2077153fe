"""Cleaning of segments: junk lines out, leading section markers off, empty ones out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import strip

#: Openings of transcription notes.
JUNK = ("produced by", "transcribed", "prepared by", r"end of\b", r"\*\*\*")
_JUNK = rf"(?iu)^(?U:\s*)(?:{'|'.join(JUNK)})"
_MARKER = r"(?U)^\s*(?:[IVXLCDM]{1,7}|\d{1,3})\.\s*(?:--|—|–)\s*"


def is_junk(text: Column) -> Column:
    return text.rlike(_JUNK)


def strip_marker(text: Column) -> Column:
    return strip(F.regexp_replace(text, _MARKER, ""))


def clean_segments(segments: DataFrame, keys: list[str], enabled: Column | None = None) -> DataFrame:
    """keys, seg_idx (renumbered), text. Where `enabled` is false the segments stay as they are."""
    on = F.lit(True) if enabled is None else F.coalesce(enabled, F.lit(True))
    kept = segments.where(~on | ~is_junk(F.col("text"))).withColumn("text", F.when(on, strip_marker(F.col("text"))).otherwise(F.col("text"))).where(~on | (F.length("text") > 0))
    index = F.row_number().over(Window.partitionBy(*keys).orderBy("seg_idx"))
    return kept.withColumn("seg_idx", index)
