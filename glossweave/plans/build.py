"""The main plan: jobs and their texts -> divisions -> pairs -> segments -> beads, for all books at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.align import align_blocks, choose_method
from ..operators.clean import clean_segments
from ..operators.models import Model, restyle_beads, translate_segments
from ..operators.pairing import pair_divisions
from ..operators.segment import apply_range, divisions, segments
from ..scratch import materialize

BLOCK = ["book_id", "ch_idx"]


def book_divisions(jobs: DataFrame, side: str) -> DataFrame:
    """book_id, div_idx, title, body of one side, within the job's range. jobs: book_id, <side>_text, <side>_range."""
    found = divisions(jobs.select("book_id", F.col(f"{side}_text").alias("text")), ["book_id"])
    bounds = jobs.select("book_id", F.col(f"{side}_range.first").alias("__first"), F.col(f"{side}_range.last").alias("__last"))
    return apply_range(found.join(bounds, "book_id"), F.col("__first"), F.col("__last"), ["book_id"]).drop("__first", "__last")


def build(
    jobs: DataFrame,
    aligner: str = "gale-church",
    translator: Model | None = None,
    encode: Callable[[DataFrame], DataFrame] | None = None,
    restyler: Model | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(chapters: book_id, ch_idx, title; beads: book_id, ch_idx, bead_idx, src, tgt, ds, dt).

    jobs: book_id, src_lang, tgt_lang, mode, clean, src_text, tgt_text, src_range, tgt_range. `aligner` is a
    job's request (auto, embed, mt, gale-church); one call builds the jobs of one method and translator.
    Divisions and pairs are written to the shared folder when called; beads are a plan over them.
    `encode` adds `vec` to a table with `text`, and makes divisions matched by meaning where counts differ.
    """
    langs = ["*"] if translator else []
    method = choose_method(aligner, langs, "*", encode is not None)
    src, tgt = book_divisions(jobs, "src"), book_divisions(jobs, "tgt")
    if encode:
        src, tgt = (encode(d.withColumn("text", F.concat_ws("\n", "title", "body"))).drop("text") for d in (src, tgt))
    # each is read several times below; once written, a lost executor costs no new segmentation
    src, tgt = materialize(src, "divisions-src"), materialize(tgt, "divisions-tgt")
    pairs = materialize(pair_divisions(src, tgt, "book_id", by_meaning=encode is not None), "division-pairs")
    facts = jobs.select("book_id", "src_lang", "tgt_lang", "mode", "clean")

    def side(name: str) -> DataFrame:
        bodies = pairs.join(facts, "book_id").select(*BLOCK, F.col(f"{name[0]}_body").alias("text"), "mode", F.col(f"{name}_lang").alias("lang"))
        cut = segments(bodies, BLOCK)
        return clean_segments(cut.join(facts.select("book_id", "clean"), "book_id"), BLOCK, F.col("clean")).drop("clean")

    left, right = side("src"), side("tgt")
    if method == "mt":
        left = translate_segments(left, translator)
    elif method == "embed":
        left, right = encode(left), encode(right)
    # a job that asks for "auto" goes by lengths in blocks where the encoder gave no vectors
    beads = align_blocks(left, right, BLOCK, "auto" if aligner == "auto" and method == "embed" else method)
    if restyler:
        beads = restyle_beads(beads, restyler)
    return pairs.select("book_id", "ch_idx", "title"), beads


def build_each(jobs: DataFrame, translators: dict[str, Model] | None = None, restylers: dict[str, Model] | None = None, encode=None) -> tuple[DataFrame, DataFrame]:
    """As `build`, for jobs that differ in aligner and languages: one plan for each of the few combinations
    of aligner, source language with a translator and target language with a restyler, united."""
    translators, restylers = translators or {}, restylers or {}
    source = F.when(F.col("src_lang").isin(*translators), F.col("src_lang")).otherwise("") if translators else F.lit("")
    target = F.when(F.col("tgt_lang").isin(*restylers) & F.coalesce("restyle", F.lit(True)), F.col("tgt_lang")).otherwise("") if restylers else F.lit("")
    tagged = jobs.withColumns({"__a": F.col("aligner"), "__s": source, "__t": target})
    chapters = beads = None
    for r in tagged.select("__a", "__s", "__t").distinct().collect():
        part = tagged.where((F.col("__a") == r[0]) & (F.col("__s") == r[1]) & (F.col("__t") == r[2]))
        use = translators.get(r[1]) if r[0] in ("auto", "mt") else None
        c, b = build(part, r[0], use, encode if r[0] in ("auto", "embed") else None, restylers.get(r[2]))
        chapters = c if chapters is None else chapters.unionByName(c)
        beads = b if beads is None else beads.unionByName(b)
    if chapters is None:
        return build(jobs)
    return chapters, beads


def run_jobs(jobs: DataFrame, build_one: Callable[[DataFrame], object]) -> list[tuple[int, str, str]]:
    """(book_id, "done" or "error", message) of each job, built one after the other: a job that fails does
    not stop the others. For few jobs with side effects; `build_each` builds many in one plan."""
    status = []
    for (book,) in jobs.select("book_id").distinct().orderBy("book_id").collect():
        try:
            build_one(jobs.where(F.col("book_id") == book))
            status.append((book, "done", ""))
        except Exception as error:  # noqa: BLE001 - reported in the status, whatever it is
            status.append((book, "error", str(error)))
    return status


def exit_code(status: list[tuple[int, str, str]]) -> int:
    return int(any(s != "done" for _, s, _ in status))
