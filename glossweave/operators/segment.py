"""Documents -> divisions -> paragraphs -> segments. Every table carries explicit ordinals.

Documents are rows with a key (`keys`, default doc_id) and `text`. Windows run within one document, so
what one task holds is bounded by the longest document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import collapse, ordered_join, split_lines, strip

# --- Fixed values: the heading vocabulary, sentence ends and abbreviations. ---
DIVISION_WORDS = ("book", "chapter", "chap", "part", "canto", "section", "argument", "liber", "caput", "commentarius", "chapitre", "livre", "partie", "kapitel", "buch", "teil")
LATIN_ORDINALS = ("primus", "secundus", "tertius", "quartus", "quintus", "sextus", "septimus", "octavus", "nonus", "decimus", "undecimus", "duodecimus")
FRENCH_ORDINALS = ("première", "premier", "deuxième", "troisième", "quatrième", "cinquième", "sixième", "septième", "huitième", "neuvième", "dixième", "onzième", "douzième")
ENGLISH_ORDINALS = ("first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth", "eleventh", "twelfth")
ABBREVIATIONS = ("mr", "mrs", "ms", "dr", "st", "vs", "etc", "cf", "ca", "no", "vol", "p", "pp", "fig", "e.g", "i.e", "viz", "al", "jr", "sr")
SENTENCE_ENDS = {"grc": ".;!", "el": ".;!"}
DEFAULT_ENDS = ".!?…"
HEADING_CHARS, HEADING_WORDS = 140, 20
FRONT_MATTER = "(front matter / untitled)"
MERGE_TARGET, PART_SIZE = 420, 55

_ORDINALS = "|".join(LATIN_ORDINALS + FRENCH_ORDINALS + ENGLISH_ORDINALS)
_NUMBERED = rf"(?U)\b(?iu:{'|'.join(DIVISION_WORDS)})\b\.?\s+(?:[IVXLCDM]+|\d+|(?iu:{_ORDINALS}))\b"
_ROMAN = r"^[IVXLCDM]{1,7}\.?$"
_BANNER = r"(?i:\*\*\*\s*{} OF (?:THE|THIS) PROJECT GUTENBERG)[^\n]*?\*\*\*"
_CLOSERS = ".!?”’"


def strip_boilerplate(text: Column) -> Column:
    """Text between the start banner's line and the end banner; a missing banner leaves that side alone."""
    start, end = _BANNER.format("START"), _BANNER.format("END")
    with_line = F.regexp_replace(text, rf"(?s)\A.*?{start}[^\n]*\n", "")
    # the first banner's own line may be the last one: then only the banner goes
    head = F.regexp_extract(text, rf"(?s)\A(.*?{start})", 1)
    rest = F.substring(text, F.length(head) + 1, F.length(text))
    opened = F.when(head == "", text).when(rest.contains("\n"), with_line).otherwise(rest)
    return strip(F.regexp_replace(opened, rf"(?s){end}.*\z", ""))


def is_heading(line: Column) -> Column:
    """Whether a physical line opens a division."""
    s = strip(line)
    words = F.size(F.split(s, r"(?U)\s+", -1))
    named = s.rlike(_NUMBERED) & (words <= HEADING_WORDS)
    return F.coalesce((F.length(s) > 0) & (F.length(s) <= HEADING_CHARS) & (s.rlike(_ROMAN) | named), F.lit(False))


def lines(docs: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """keys, pos (0-based), line, is_heading."""
    each = docs.select(*keys, F.posexplode(split_lines(F.coalesce("text", F.lit("")))).alias("pos", "line"))
    return each.withColumn("is_heading", is_heading(F.col("line")))


def divisions(docs: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """keys, div_idx (1-based), title, body.

    A heading opens a division; one with no line after it before the next heading is dropped; text before
    the first heading is an untitled division; a document that yields none is one untitled division.
    All of it is an expression over the document's row, so nothing is shuffled, and rows with equal or null keys
    are documents of their own.
    """
    text = F.coalesce("text", F.lit(""))
    cut = docs.select(*keys, text.alias("__text"), split_lines(text).alias("__lines"))
    headings = F.filter(F.transform("__lines", lambda x, i: F.when(is_heading(x), i)), lambda i: i.isNotNull())
    opened = cut.select("*", F.concat(F.array(F.lit(-1)), headings, F.array(F.size("__lines"))).alias("__starts"))

    def section(start, k):
        first, until = start + 2, F.element_at("__starts", k + 2)  # 1-based, past the heading
        title = F.when(start < 0, "").otherwise(strip(F.element_at("__lines", F.greatest(start, F.lit(0)) + 1)))
        lines_in = F.slice("__lines", first, until - start - 1)
        return F.when(until - start > 1, F.struct(title.alias("title"), strip(F.array_join(lines_in, "\n")).alias("body")))

    sections = F.transform(F.slice("__starts", F.lit(1), F.size("__starts") - 1), section)
    found = opened.select(*keys, "__text", F.filter(sections, lambda x: x.isNotNull()).alias("__found"))
    whole = F.array(F.struct(F.lit("").alias("title"), F.col("__text").alias("body")))
    each = found.select(*keys, F.posexplode(F.when(F.size("__found") > 0, F.col("__found")).otherwise(whole)).alias("pos", "d"))
    return each.select(*keys, (F.col("pos") + 1).alias("div_idx"), "d.title", "d.body")


def outline(docs: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """keys, index, title, chars of each division."""
    title = F.when(F.col("title") == "", FRONT_MATTER).otherwise(F.col("title"))
    return divisions(docs, keys).select(*keys, F.col("div_idx").alias("index"), title.alias("title"), F.length("body").cast("long").alias("chars"))


def apply_range(divs: DataFrame, first: Column | None, last: Column | None, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Divisions first..last, inclusive; null bounds keep all; a negative last counts from the end."""
    if first is None or last is None:
        return divs
    n = F.count("*").over(Window.partitionBy(*keys))
    until = F.when(last < 0, n + last).otherwise(F.least(last, n))
    inside = first.isNull() | last.isNull() | F.col("div_idx").between(F.greatest(first, F.lit(1)), until)
    return divs.withColumn("__in", inside).where("__in").drop("__in")


def paragraphs(texts: DataFrame, keys: Sequence[str] = ("doc_id",), carry: Sequence[str] = ()) -> DataFrame:
    """keys, para_idx (1-based), text, and the columns `carry`, which are the same in all rows of a document. A blank run of the document's usual size or more parts paragraphs:
    where most blank runs between lines hold one line, two are needed, else one."""
    rows = texts.select(*keys, *carry, F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).withColumn("line", strip(F.col("line"))).where("line <> ''")
    order = Window.partitionBy(*keys).orderBy("pos")
    rows = rows.withColumn("blank", F.coalesce(F.col("pos") - F.lag("pos").over(order) - 1, F.lit(0)))
    document = Window.partitionBy(*keys)
    runs, single = F.count_if(F.col("blank") > 0).over(document), F.count_if(F.col("blank") == 1).over(document)
    needed = F.when((runs > 0) & (2 * single > runs), 2).otherwise(1)
    rows = rows.withColumn("breaks", (F.col("blank") >= needed).cast("int"))
    rows = rows.withColumn("para_idx", (1 + F.sum("breaks").over(order)).cast("int"))
    return rows.groupBy(*keys, "para_idx").agg(ordered_join(F.col("pos"), F.col("line"), " ").alias("text"), *[F.min(c).alias(c) for c in carry])


def is_abbreviation_tail(piece: Column) -> Column:
    """Whether a piece ends in an abbreviation, so that the split after it is undone."""
    last = F.element_at(F.split(piece, r"(?U)\s+", -1), -1)
    return F.lower(F.regexp_replace(last, r"\.+$", "")).isin(*ABBREVIATIONS)


def split_sentences(text: Column, lang: Column) -> Column:
    """Pieces of a paragraph after each sentence end that white space follows."""
    flat = collapse(text)
    out = F.split(flat, rf"(?<=[{DEFAULT_ENDS}])\s+", -1)
    for code, ends in SENTENCE_ENDS.items():
        out = F.when(lang == code, F.split(flat, rf"(?<=[{ends}])\s+", -1)).otherwise(out)
    return out


def prose_segments(texts: DataFrame, keys: Sequence[str] = ("doc_id",), lang: str | None = "lang") -> DataFrame:
    """keys, seg_idx (1-based), text: sentences, those split after an abbreviation joined again."""
    code = F.col(lang) if lang else F.lit("")
    paras = paragraphs(texts, keys, [lang] if lang and lang not in keys else [])
    pieces = paras.select(*keys, "para_idx", F.posexplode(split_sentences(F.col("text"), code)).alias("pos", "piece")).where("piece <> ''")
    order = Window.partitionBy(*keys, "para_idx").orderBy("pos")
    opens = ~F.coalesce(is_abbreviation_tail(F.lag("piece").over(order)), F.lit(False))
    pieces = pieces.withColumn("sent", F.sum(opens.cast("int")).over(order))
    merged = pieces.groupBy(*keys, "para_idx", "sent").agg(ordered_join(F.col("pos"), F.col("piece"), " ").alias("text"))
    index = F.row_number().over(Window.partitionBy(*keys).orderBy("para_idx", "sent"))
    return merged.select(*keys, index.alias("seg_idx"), "text")


def verse_segments(texts: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """keys, seg_idx, text: the lines that are not blank. A row's own expression: nothing is shuffled."""
    kept = F.filter(F.transform(split_lines(F.col("text")), strip), lambda x: x != "")
    return texts.select(*keys, F.posexplode(kept).alias("pos", "text")).select(*keys, (F.col("pos") + 1).alias("seg_idx"), "text")


def segments(texts: DataFrame, keys: Sequence[str] = ("doc_id",), mode: str = "mode", lang: str = "lang") -> DataFrame:
    """Verse where the mode column says so, prose for any other mode."""
    is_verse = F.coalesce(F.col(mode) == "verse", F.lit(False))
    return verse_segments(texts.where(is_verse), keys).unionByName(prose_segments(texts.where(~is_verse), keys, lang))


def merge_blocks(blocks: DataFrame, keys: Sequence[str] = ("doc_id",), target: int = MERGE_TARGET) -> DataFrame:
    """keys, para_idx, text: short blocks (keys, pos, text) gathered up to `target` characters, ended only
    after sentence-final punctuation. The accumulator resets, so it is folded within each document."""
    gathered = blocks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("blocks"))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).alias("n"))

    def step(s, b):
        opened, n = F.array_append(s["open"], b["text"]), s["n"] + F.length(b["text"]) + 1
        full = (n >= target) & F.substring(F.regexp_replace(b["text"], r"(?U)\s+$", ""), -1, 1).isin(*_CLOSERS)
        return F.struct(
            F.when(full, F.array_append(s["done"], F.array_join(opened, " "))).otherwise(s["done"]).alias("done"),
            F.when(full, F.array().cast("array<string>")).otherwise(opened).alias("open"),
            F.when(full, 0).otherwise(n).alias("n"),
        )

    finish = lambda s: F.when(F.size(s["open"]) > 0, F.array_append(s["done"], F.array_join(s["open"], " "))).otherwise(s["done"])
    folded = gathered.select(*keys, F.posexplode(F.aggregate("blocks", start, step, finish)).alias("pos", "text"))
    return folded.select(*keys, (F.col("pos") + 1).alias("para_idx"), "text")


def part_of(position: Column, size: int = PART_SIZE) -> Column:
    """1-based number of the fixed-size part that a 1-based position falls in."""
    return (F.floor((position - 1) / size) + 1).cast("int")
