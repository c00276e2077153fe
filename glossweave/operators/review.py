"""Review of beads in batches by an injected reviewer, and the report of its findings."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import join_segments, ordered_join, truncate

#: Fixed values.
BATCH = 12
ISSUE_TYPES = ("misalignment", "leftover_markup", "encoding_artifact", "segmentation_error", "other")
SEVERITIES = {"high": 0, "medium": 1, "low": 2}
MODEL_LIMIT, EXCERPT_LIMIT = 300, 160
NO_FINDINGS = "# Segment review\n\nNo issues flagged.\n"

FINDINGS = "book_id long, chapter_index int, chapter_title string, bead_index int, issue_type string, severity string, note string, src_excerpt string, tgt_excerpt string"


def severity_rank(severity: Column) -> Column:
    out = F.lit(9)
    for name, rank in SEVERITIES.items():
        out = F.when(severity == name, rank).otherwise(out)
    return out


def batches(beads: DataFrame, size: int = BATCH, max_beads: int | None = None, book: str = "book_id") -> DataFrame:
    """Beads in reading order with batch_no (0-based) and ref (1-based in the batch); the first `max_beads` only."""
    rn = F.row_number().over(Window.partitionBy(book).orderBy("ch_idx", "bead_idx"))
    numbered = beads.withColumn("rn", rn)
    if max_beads is not None:
        numbered = numbered.where(F.col("rn") <= max_beads)
    batch = F.floor((F.col("rn") - 1) / size).cast("int")
    return numbered.withColumn("batch_no", batch).withColumn("ref", (F.col("rn") - batch * size).cast("int")).drop("rn")


def prompt_line(ref: Column, src_lang: Column, tgt_lang: Column, src: Column, tgt: Column) -> Column:
    shown = lambda t: F.coalesce(F.nullif(truncate(t, MODEL_LIMIT), F.lit("")), F.lit("(empty)"))
    return F.concat(ref.cast("string"), F.lit(". SRC("), src_lang, F.lit("): "), shown(src), F.lit("\n   TGT("), tgt_lang, F.lit("): "), shown(tgt))


def prompts(batched: DataFrame, src_lang: Column, tgt_lang: Column, book: str = "book_id") -> DataFrame:
    """book, batch_no, n, prompt: what a reviewer is shown of each batch."""
    line = prompt_line(F.col("ref"), src_lang, tgt_lang, join_segments(F.col("src")), join_segments(F.col("tgt")))
    return batched.withColumn("line", line).groupBy(book, "batch_no").agg(F.count("*").alias("n"), ordered_join(F.col("ref"), F.col("line"), "\n").alias("prompt"))


def review(beads: DataFrame, reviewer: Callable[[str], list[dict] | str], src_lang: str, tgt_lang: str, size: int = BATCH, max_beads: int | None = None) -> DataFrame:
    """FINDINGS rows. `reviewer` gets a batch's prompt and returns issues (dicts or their JSON) with ref,
    issue_type, severity and note; refs outside the batch are ignored."""
    batched = batches(beads, size, max_beads)
    asked = prompts(batched, F.lit(src_lang), F.lit(tgt_lang))

    def ask(frames):
        for frame in frames:
            rows = []
            for book, batch, n, prompt in zip(frame["book_id"], frame["batch_no"], frame["n"], frame["prompt"], strict=True):
                found = reviewer(prompt)
                for issue in json.loads(found) if isinstance(found, str) else found:
                    ref = issue.get("ref")
                    if isinstance(ref, int) and not isinstance(ref, bool) and 1 <= ref <= n:
                        rows.append((book, batch, ref, issue.get("issue_type", "other"), issue.get("severity", "medium"), issue.get("note", "")))
            yield pd.DataFrame(rows, columns=["book_id", "batch_no", "ref", "issue_type", "severity", "note"])

    issues = asked.mapInPandas(ask, "book_id long, batch_no int, ref int, issue_type string, severity string, note string")
    return attach(issues, batched)


def attach(issues: DataFrame, batched: DataFrame) -> DataFrame:
    """Issues (book_id, batch_no, ref, ...) joined to their beads, as FINDINGS rows."""
    joined = issues.join(batched, ["book_id", "batch_no", "ref"])
    title = F.coalesce(F.nullif("title", F.lit("")), F.concat(F.lit("Chapter "), F.col("ch_idx").cast("string")))
    return joined.select(
        "book_id",
        (F.col("ch_idx") - 1).cast("int").alias("chapter_index"),
        title.alias("chapter_title"),
        (F.col("bead_idx") - 1).cast("int").alias("bead_index"),
        "issue_type",
        "severity",
        "note",
        truncate(join_segments(F.col("src")), EXCERPT_LIMIT).alias("src_excerpt"),
        truncate(join_segments(F.col("tgt")), EXCERPT_LIMIT).alias("tgt_excerpt"),
    )


def report(findings: DataFrame, books: DataFrame | None = None) -> DataFrame:
    """book_id, n, report: Markdown of each book's findings, the severest first. `books` (book_id) adds
    those without any."""
    entry = F.concat(
        F.format_string("## [%s] %s — bead %d (%s)\n", F.upper("severity"), F.col("chapter_title"), F.col("bead_index") + 1, F.col("issue_type")),
        F.format_string("- %s\n- SRC: %s\n- TGT: %s\n", F.col("note"), F.col("src_excerpt"), F.col("tgt_excerpt")),
    )
    place = F.struct(severity_rank(F.col("severity")).alias("r"), "chapter_index", "bead_index", "issue_type", "note")
    grouped = findings.groupBy("book_id").agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "high").alias("n_high"), ordered_join(place, entry, "\n").alias("body"))
    text = F.concat(F.format_string("# Segment review — %d flagged bead(s)\n\n", F.col("n")), F.col("body"))
    out = grouped.select("book_id", "n", "n_high", text.alias("report"))
    if books is None:
        return out
    zero = F.lit(0).cast("long")
    return books.select("book_id").distinct().join(out, "book_id", "left").select("book_id", F.coalesce("n", zero).alias("n"), F.coalesce("n_high", zero).alias("n_high"), F.coalesce("report", F.lit(NO_FINDINGS)).alias("report"))
