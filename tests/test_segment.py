"""Divisions, paragraphs, segments and cleaning from hand-derived cases."""

import pytest
from pyspark.sql import functions as F

from glossweave.functions import numeric as N
from glossweave.functions import text as X
from glossweave.operators import clean, segment


def docs(spark, *texts, lang="en"):
    return spark.createDataFrame([(k, t, lang) for k, t in enumerate(texts)], "doc_id long, text string, lang string")


def values(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_divisions(spark):
    texts = ["", "Chapter I\nChapter II", "Chapter I\nChapter II\nx", "Chapter I\n\nChapter II\nx", "intro\nIV.\nx", "a\r\nBOOK 2\r\nb\x0bc\n", " untouched \n"]
    got = values(segment.divisions(docs(spark, *texts)), "doc_id", "div_idx")
    assert got == [
        (0, 1, "", ""),
        (1, 1, "", "Chapter I\nChapter II"),
        (2, 1, "Chapter II", "x"),
        (3, 1, "Chapter I", ""),
        (3, 2, "Chapter II", "x"),
        (4, 1, "", "intro"),
        (4, 2, "IV.", "x"),
        (5, 1, "", "a"),
        (5, 2, "BOOK 2", "b\nc"),
        (6, 1, "", "untouched"),
    ]
    outline = values(segment.outline(docs(spark, texts[4])), "index")
    assert outline == [(0, 1, "(front matter / untitled)", 5), (0, 2, "IV.", 1)]


@pytest.mark.parametrize(
    ("line", "want"),
    [("chapter iv", False), ("Chapter IV", True), ("CHAPITRE PREMIER", True), ("LIVRE DEUXIÈME", True), ("C. IULI CAESARIS COMMENTARIUS PRIMUS", True), ("12", False), ("IV.", True), ("MIX", True), ("", False), ("  Book First ", True), ("de la part d'un domestique", False), ("BOOK I " + "w " * 25, False), ("épart I", False), ("x" * 141, False), ("Chap. 3", True)],
)
def test_headings(spark, line, want):
    assert spark.createDataFrame([(line,)], "l string").select(segment.is_heading(F.col("l"))).first()[0] is want


def test_boilerplate(spark):
    start, end = "*** START OF THE PROJECT GUTENBERG EBOOK A ***", "*** End of this Project Gutenberg EBook A ***"
    cases = {
        f"head\n{start} rest\nbody\n{end}\nlicence": "body",
        f"{start} tail": "tail",
        f" body\n{end}": "body",
        "  plain ": "plain",
        f"a\n*** START OF THE PROJECT GUTENBERG\nEBOOK ***\n{start}\nb": "b",
    }
    rows = spark.createDataFrame([(k, v) for k, v in cases.items()], "t string, want string")
    for r in rows.select("want", segment.strip_boilerplate(F.col("t")).alias("got")).collect():
        assert r.got == r.want


def test_range(spark):
    divs = segment.divisions(docs(spark, "\n".join(f"Chapter {k}\nx" for k in range(1, 7))))
    take = lambda a, b: [r.div_idx for r in segment.apply_range(divs, F.lit(a), F.lit(b)).orderBy("div_idx").collect()]
    assert take(2, 4) == [2, 3, 4] and take(0, 99) == [1, 2, 3, 4, 5, 6] and take(4, 2) == [] and take(2, -1) == [2, 3, 4, 5]
    assert segment.apply_range(divs, None, None).count() == 6


def test_paragraphs(spark):
    got = values(segment.paragraphs(docs(spark, "a\n\nb\n\nc", "a\n\n\nb", "a\nb\n\n\n\nc\n\nd", "\n\n x \n", "")), "doc_id", "para_idx")
    assert got == [(0, 1, "a b c"), (1, 1, "a"), (1, 2, "b"), (2, 1, "a b"), (2, 2, "c"), (2, 3, "d"), (3, 1, "x")]


def test_sentences(spark):
    en = values(segment.prose_segments(docs(spark, "Mr. Smith came. He left.", "He said no. She left.", "a; b.", 'He said "x." Then.', "One… two!  three?\nfour", "")), "doc_id", "seg_idx")
    assert en == [(0, 1, "Mr. Smith came."), (0, 2, "He left."), (1, 1, "He said no. She left."), (2, 1, "a; b."), (3, 1, 'He said "x." Then.'), (4, 1, "One…"), (4, 2, "two!"), (4, 3, "three?"), (4, 4, "four")]
    assert [t for *_, t in values(segment.prose_segments(docs(spark, "τί; οὐδέν.", lang="grc")), "seg_idx")] == ["τί;", "οὐδέν."]


def test_verse_and_dispatch(spark):
    rows = docs(spark, " a\n\n b. c \n", "a\nb. c").withColumn("mode", F.when(F.col("doc_id") == 0, "verse").otherwise("odd"))
    assert values(segment.segments(rows), "doc_id", "seg_idx") == [(0, 1, "a"), (0, 2, "b. c"), (1, 1, "a b."), (1, 2, "c")]


def test_merge_blocks(spark):
    blocks = spark.createDataFrame([(1, k, t) for k, t in enumerate(["aaaa.", "bb", "cc.", "d", "e"])], "doc_id long, pos int, text string")
    assert values(segment.merge_blocks(blocks, target=5), "para_idx") == [(1, 1, "aaaa."), (1, 2, "bb cc."), (1, 3, "d e")]
    assert [r[0] for r in spark.range(1, 113).select(segment.part_of(F.col("id"))).distinct().orderBy(1).collect()] == [1, 2, 3]


def test_clean(spark):
    rows = [(1, k, t) for k, t in enumerate(["XLIX.--Perceiving", "I — went", "Produced by X", "12. — a", " ", "IV. text", "End of it", "Endofit", "*** x", "II.--"], 1)]
    got = values(clean.clean_segments(spark.createDataFrame(rows, "doc_id long, seg_idx int, text string"), ["doc_id"]), "seg_idx")
    assert [(i, t) for _, i, t in got] == [(1, "Perceiving"), (2, "I — went"), (3, "a"), (4, "IV. text"), (5, "Endofit")]
    off = clean.clean_segments(spark.createDataFrame(rows, "doc_id long, seg_idx int, text string"), ["doc_id"], F.lit(False))
    assert off.count() == len(rows)


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(X.slugify(F.lit("Le Père Goriot!"))) == "le-p-re-goriot" and one(X.slugify(F.lit("…"))) == "book"
    assert one(X.escape_html(F.lit('<a href="x">&</a>'))) == "&lt;a href=&quot;x&quot;&gt;&amp;&lt;/a&gt;"
    assert one(X.strip(F.lit(" \t x \n"))) == "x"
    assert one(X.truncate(F.lit(" abcdef gh "), 7)) == "abcdef…" and one(X.truncate(F.lit("abc"), 7)) == "abc"
    assert one(X.language_name(F.lit("grc"))) == "Ancient Greek" and one(X.language_name(F.lit("nl"))) == "NL"
    assert one(X.word_tokens(F.lit("L'Été_2 x1y Ⅷ"))) == ["l", "été", "x", "y", "ⅷ"]
    assert one(X.parse_range(F.lit("2:5"))).asDict() == {"first": 2, "last": 5} and one(X.parse_range(F.lit(""))) is None


def test_numbers(spark):
    import math

    one = lambda c: spark.range(1).select(c).first()[0]
    for z in (-3.0, -0.4, 0.0, 1.0, 2.5):
        assert one(N.normal_cdf(F.lit(z))) == pytest.approx(0.5 * (1 + math.erf(z / math.sqrt(2))), abs=1e-7)
    assert one(N.estimate_pages(F.lit(37_100))) == 26 and one(N.estimate_pages(F.lit(1_000))) == 24
    cover = one(N.cover_dimensions(F.lit(6.0), F.lit(9.0), F.lit(200), F.lit("white")))
    assert (round(cover.spine, 4), round(cover.width, 4), cover.height) == (0.4504, 12.7004, 9.25)
    assert [one(N.gutter(F.lit(p))) for p in (150, 151, 501, 701)] == [0.375, 0.5, 0.75, 0.875]
    assert one(N.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0)))) == pytest.approx(2**-0.5)
