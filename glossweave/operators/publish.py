"""What an edition's publisher needs, as ordered rows and strings: measures, contents, markup, plan."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import cover_dimensions, estimate_pages, gutter
from ..functions.text import escape_xml, join_segments, language_name, ordered_join

#: Ornament styles in the order that seeded choices draw from, cover motifs, the last line.
CHAPTER_STYLES = ("fleuron", "rule", "medieval", "victorian", "classical", "baroque", "nouveau", "rococo", "artdeco")
MOTIFS = {"la": ("Latin", "#7c2128"), "grc": ("Greek", "#1f3d63"), "el": ("Greek", "#1f3d63"), "fr": ("French", "#27408b"), "de": ("German", "#3d5234")}
DEFAULT_MOTIF = ("", "#5a4a2c")
PRINTED = "Printed in the United States of America."


def book_measures(beads: DataFrame, book: str = "book_id", trim: tuple[float, float] = (6.0, 9.0), paper: str = "white") -> DataFrame:
    """book, n_beads, chars, pages, gutter, cover width, height and spine of each book."""
    chars = F.length(join_segments(F.col("src"))) + F.length(join_segments(F.col("tgt")))
    sums = beads.groupBy(book).agg(F.count("*").alias("n_beads"), F.sum(chars).cast("long").alias("chars"))
    sized = sums.withColumn("pages", estimate_pages(F.col("chars"))).withColumn("gutter", gutter(F.col("pages")))
    return sized.withColumn("cover", cover_dimensions(F.lit(trim[0]), F.lit(trim[1]), F.col("pages"), F.lit(paper))).select(book, "n_beads", "chars", "pages", "gutter", "cover.width", "cover.height", "cover.spine")


def contents(chapters: DataFrame, book: str = "book_id", enabled: bool = True) -> DataFrame:
    """Rows of the printed contents: titled chapters of books that have two or more of them."""
    titled = chapters.where("title <> ''").withColumn("n", F.count("*").over(Window.partitionBy(book)))
    entry = F.row_number().over(Window.partitionBy(book).orderBy("ch_idx"))
    return titled.where((F.col("n") >= 2) & F.lit(enabled)).select(book, "ch_idx", entry.alias("entry"), "title")


def chapter_title(title: Column, number: Column) -> Column:
    return F.coalesce(F.nullif(title, F.lit("")), F.concat(F.lit("Chapter "), number.cast("string")))


def bead_xhtml(src: Column, tgt: Column, first: Column, opener: Column) -> Column:
    """The two paragraphs of a bead. Which text comes first is the job's choice; the first one printed has
    the class src either way."""
    src, tgt = escape_xml(src), escape_xml(tgt)
    one, two = F.when(first == "tgt", tgt).otherwise(src), F.when(first == "tgt", src).otherwise(tgt)
    suffix = F.when(opener, " opener").otherwise("")
    mark = lambda kind, text: F.when(text != "", F.concat(F.lit(f'<p class="{kind}'), suffix, F.lit('">'), text, F.lit("</p>")))
    return F.concat_ws("\n", mark("src", one), mark("tgt", two))


def chapter_xhtml(beads: DataFrame, keys: Sequence[str] = ("book_id", "ch_idx"), first: str = "src", opener_font: bool = False) -> DataFrame:
    """keys, xhtml: the beads of each chapter in order."""
    mark = bead_xhtml(join_segments(F.col("src")), join_segments(F.col("tgt")), F.lit(first), (F.col("bead_idx") == 1) & F.lit(opener_font))
    return beads.withColumn("__x", mark).groupBy(*keys).agg(ordered_join(F.col("bead_idx"), F.col("__x"), "\n").alias("xhtml"))


def copyright_paragraphs(job: dict[str, Column]) -> Column:
    """Body paragraphs of the copyright page. job: rights, holder, publisher, year, author, src_lang,
    translator, note, as columns that are never null but rights and year."""
    blank = lambda c: F.nullif(c, F.lit(""))
    holder = F.coalesce(blank(job["holder"]), blank(job["publisher"]))
    year = F.coalesce(F.concat(F.lit(" "), job["year"].cast("string")), F.lit(""))
    claim = F.when(
        holder.isNotNull(),
        F.concat(F.lit("This parallel edition &mdash; its translation arrangement, typography, and design &mdash; copyright &copy;"), year, F.lit(" "), escape_xml(holder), F.lit(".")),
    )
    credit = F.when(blank(job["translator"]).isNotNull(), F.concat(F.lit(" The English translation by "), escape_xml(job["translator"]), F.lit(" is in the public domain."))).otherwise(
        " The English translation is in the public domain."
    )
    origin = F.concat(F.lit("The original "), language_name(job["src_lang"]), F.lit(" text by "), escape_xml(job["author"]), F.lit(" is in the public domain."), credit, F.lit(" No copyright is claimed on these public-domain texts."))
    source = F.concat(F.lit("Source texts: Project Gutenberg (www.gutenberg.org)."), F.when(job["note"] != "", F.concat(F.lit(" Translation: "), escape_xml(job["note"]))).otherwise(""))
    generated = F.filter(F.array(claim, origin, source), lambda x: x.isNotNull())
    return F.when(blank(job["rights"]).isNotNull(), F.array(job["rights"])).otherwise(generated)


def copyright_tail(publisher: Column, isbn: Column) -> Column:
    lines = F.array(F.when(publisher != "", escape_xml(publisher)), F.when(isbn != "", F.concat(F.lit("ISBN "), escape_xml(isbn))), F.lit(PRINTED))
    return F.filter(lines, lambda x: x.isNotNull())


def motif(src_lang: Column, accent: Column) -> Column:
    """(name, color) of a cover: by language, with the job's accent first."""
    name, color = F.lit(DEFAULT_MOTIF[0]), F.lit(DEFAULT_MOTIF[1])
    for code, (n, c) in MOTIFS.items():
        name, color = F.when(src_lang == code, n).otherwise(name), F.when(src_lang == code, c).otherwise(color)
    return F.struct(name.alias("name"), F.coalesce(F.nullif(accent, F.lit("")), color).alias("color"))


def random_styles(n: int) -> list[str]:
    """The seeded style of chapters 0..n-1: each index seeds its own generator."""
    return [random.Random(k).choice(CHAPTER_STYLES) for k in range(n)]


def random_style(index: Column, most: int = 200) -> Column:
    """The seeded style of a 0-based chapter index, from a table of `most` precomputed ones; null beyond."""
    return F.try_element_at(F.array(*[F.lit(x) for x in random_styles(most)]), (index + 1).cast("int"))


def edition_label(src_lang: Column, tgt_lang: Column) -> Column:
    return F.concat(language_name(src_lang), F.lit(" / "), language_name(tgt_lang))


def render_plan(chapters: DataFrame, beads: DataFrame, book: str = "book_id", first: str = "src", separator: bool = False) -> DataFrame:
    """Ordered content rows of each book: book, seq, kind (chapter, separator, src, tgt), ch_idx, bead_idx, text.

    Headings stand where a chapter has a title; separators between beads where asked for."""
    heads = chapters.where("title <> ''").select(book, "ch_idx", F.lit(0).alias("bead_idx"), F.lit(0).alias("slot"), F.lit("chapter").alias("kind"), escape_xml(F.col("title")).alias("text"))
    src, tgt = escape_xml(join_segments(F.col("src"))), escape_xml(join_segments(F.col("tgt")))
    one, two = (tgt, src) if first == "tgt" else (src, tgt)
    slots = [F.struct(F.lit(1).alias("slot"), F.lit("src").alias("kind"), one.alias("text")), F.struct(F.lit(2).alias("slot"), F.lit("tgt").alias("kind"), two.alias("text"))]
    if separator:
        slots.insert(0, F.struct(F.lit(0).alias("slot"), F.lit("separator").alias("kind"), F.when(F.col("bead_idx") > 1, "—").otherwise("").alias("text")))
    each = beads.select(book, "ch_idx", "bead_idx", F.explode(F.array(*slots)).alias("s")).select(book, "ch_idx", "bead_idx", "s.*").where("text <> ''")
    rows = heads.unionByName(each)
    seq = F.row_number().over(Window.partitionBy(book).orderBy("ch_idx", "bead_idx", "slot"))
    return rows.select(book, seq.alias("seq"), "kind", "ch_idx", "bead_idx", "text")
