"""Registered queries of the parallel-text operators, over the driver tables.

The tables hold no headings, banners, blank lines or markers, so the fixtures below put them into every
document by an expression on its own row; the same fixture stands in the SQL of `oracles`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import numeric as N
from .functions import text as X
from .operators import align, clean, fonts, models, pairing, publish, review, segment, wordbag
from .plans import build
from .sources import catalog


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", *(columns or ("text",)))


# --- fixtures ---


def chaptered(docs: DataFrame, every: int = 3) -> DataFrame:
    """A heading before each `every`-th line, none at the very start where doc_id % 5 is 1, and one more
    heading right before it where doc_id % 7 is 0."""

    def with_heading(line, i):
        double = F.when(F.col("doc_id") % 7 == 0, "BOOK II\n").otherwise("")
        head = F.concat(double, F.lit("CHAPTER "), (F.floor(i / every) + 1).cast("string"), F.lit("\n"))
        return F.concat(F.when((i % every == 0) & ~((i == 0) & (F.col("doc_id") % 5 == 1)), head).otherwise(""), line)

    return docs.withColumn("text", F.array_join(F.transform(F.split("text", "\n", -1), with_heading), "\n"))


def bannered(docs: DataFrame) -> DataFrame:
    start = "Front.\n*** START OF THE PROJECT GUTENBERG EBOOK X *** more\n"
    end = F.when(F.col("doc_id") % 5 == 0, "").otherwise("\n*** END OF THIS PROJECT GUTENBERG EBOOK X ***\nLicence.")
    return docs.withColumn("text", F.concat(F.lit(start), F.col("text"), end))


def spaced(docs: DataFrame) -> DataFrame:
    return docs.withColumn("text", F.replace(F.col("text"), F.lit("\n"), F.when(F.col("doc_id") % 2 == 0, "\n\n").otherwise("\n\n\n")))


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, seg_idx, text: lines, some with section markers, some junk, some blank."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    k = F.pmod(F.col("doc_id") + F.col("pos"), F.lit(6))
    text = F.when(k == 0, F.concat(F.lit("XIV.--"), F.col("line"))).when(k == 1, F.concat(F.lit(" 12. — "), F.col("line"))).when(k == 2, F.concat(F.lit("Produced by "), F.col("line"))).when(k == 3, "  ").when(k == 4, F.concat(F.lit("I — "), F.col("line"))).otherwise(F.col("line"))
    return lines.select("doc_id", (F.col("pos") + 1).alias("seg_idx"), text.alias("text"))


def turns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """User turns and the assistant turns that answer them, as two editions: book_id (conversation), div_idx."""
    rows = table(spark, sf_dir, "conversations")
    user = rows.where("role = 'user'").select(F.col("conv_id").alias("book_id"), "turn", F.col("text").alias("s"))
    answer = rows.where("role = 'assistant'").select(F.col("conv_id").alias("book_id"), (F.col("turn") - 1).alias("turn"), F.col("text").alias("t"))
    return user, answer


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    user, answer = turns(spark, sf_dir)
    return user.join(answer, ["book_id", "turn"]).select("book_id", F.col("turn").cast("int").alias("ch_idx"), "s", "t")


def turn_segments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pairs = turn_pairs(spark, sf_dir)
    cut = lambda c: segment.prose_segments(pairs.select("book_id", "ch_idx", F.col(c).alias("text")), build.BLOCK, None)
    return cut("s"), cut("t")


def turn_beads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align_blocks(*turn_segments(spark, sf_dir), build.BLOCK)


def line_beads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a document as one-to-one beads with their successors: a fixture without alignment."""
    lines = documents(spark, sf_dir).select(F.col("doc_id").alias("book_id"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    after = F.lead("line", 1, "").over(Window.partitionBy("book_id").orderBy("pos"))
    return lines.select("book_id", F.lit(1).alias("ch_idx"), (F.col("pos") + 1).alias("bead_idx"), F.array("line").alias("src"), F.array(after).alias("tgt"))


# --- queries ---


def q_outline_injected(spark, sf_dir):
    return segment.outline(chaptered(documents(spark, sf_dir))).select("doc_id", F.col("index").cast("long").alias("index"), "title", "chars")


def q_divisions(spark, sf_dir):
    return segment.divisions(chaptered(documents(spark, sf_dir))).select("doc_id", F.col("div_idx").cast("long").alias("div_idx"), "title", F.md5("body").alias("body_md5"))


def q_headings(spark, sf_dir):
    lines = segment.lines(chaptered(documents(spark, sf_dir)))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if("is_heading").alias("n_headings"))


def q_boilerplate(spark, sf_dir):
    return bannered(documents(spark, sf_dir)).select("doc_id", F.md5(segment.strip_boilerplate(F.col("text"))).alias("text_md5"))


def q_range(spark, sf_dir):
    divs = segment.divisions(chaptered(documents(spark, sf_dir)))
    return segment.apply_range(divs, F.lit(2), F.lit(5)).select("doc_id", F.col("div_idx").cast("long").alias("div_idx"), "title")


def q_paragraphs(spark, sf_dir):
    return segment.paragraphs(spaced(documents(spark, sf_dir))).select("doc_id", F.col("para_idx").cast("long").alias("para_idx"), "text")


def q_sentences(spark, sf_dir):
    return segment.prose_segments(documents(spark, sf_dir, "text", "lang")).select("doc_id", F.col("seg_idx").cast("long").alias("seg_idx"), "text")


def q_sentence_stats(spark, sf_dir):
    docs = documents(spark, sf_dir, "text", "lang")
    rows = segment.prose_segments(docs, ("doc_id", "lang"), "lang")
    return rows.groupBy("lang").agg(F.count("*").alias("n_segments"), F.countDistinct("doc_id").alias("n_docs"), F.round(F.avg(F.length("text")), 4).alias("avg_chars"))


def q_verse_lines(spark, sf_dir):
    return segment.verse_segments(documents(spark, sf_dir)).select("doc_id", F.col("seg_idx").cast("long").alias("seg_idx"), "text")


def q_segment_dispatch(spark, sf_dir):
    docs = documents(spark, sf_dir, "text", "lang").withColumn("mode", F.when(F.col("doc_id") % 2 == 0, "verse").otherwise("other"))
    return segment.segments(docs).groupBy("doc_id").agg(F.count("*").alias("n_segments"), F.sum(F.length("text")).alias("chars"))


def q_merge_blocks(spark, sf_dir):
    blocks = documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "text"))
    merged = segment.merge_blocks(blocks)
    return merged.select("doc_id", F.col("para_idx").cast("long").alias("para_idx"), segment.part_of(F.col("para_idx"), 5).cast("long").alias("part"), F.length("text").cast("long").alias("chars"))


def q_clean(spark, sf_dir):
    return clean.clean_segments(marked(documents(spark, sf_dir)), ["doc_id"]).select("doc_id", F.col("seg_idx").cast("long").alias("seg_idx"), "text")


def q_word_bag(spark, sf_dir):
    bags = wordbag.word_bags(documents(spark, sf_dir), ["doc_id"])
    return bags.groupBy("doc_id").agg(F.count("*").alias("n_words"), F.sum("cnt").alias("n_tokens"), F.max("cnt").alias("most"), F.round(F.sqrt(F.sum(F.col("cnt") * F.col("cnt"))), 4).alias("norm"))


def q_cosine(spark, sf_dir):
    docs = documents(spark, sf_dir)
    pairs = docs.select(F.col("doc_id").alias("left"), (F.col("doc_id") + 1).alias("right")).join(docs.select(F.col("doc_id").alias("right")), "right", "left_semi")
    found = wordbag.pair_cosine(pairs, wordbag.word_bags(docs, ["doc_id"]))
    return found.select("left", "right", F.round("cosine", 6).alias("cosine"))


def q_length_ratio(spark, sf_dir):
    pairs = turn_pairs(spark, sf_dir)
    total = lambda c: F.coalesce(F.nullif(F.sum(F.length(c)), F.lit(0)), F.lit(1))
    return pairs.groupBy("book_id").agg(F.round(total("t") / total("s"), 6).alias("ratio"))


def q_length_cost(spark, sf_dir):
    pairs = turn_pairs(spark, sf_dir)
    s, t = F.length("s").cast("double"), F.length("t").cast("double")
    cost = N.length_cost(s, t, F.lit(2.5)) + N.prior_cost(F.lit(1), F.lit(1))
    return pairs.select("book_id", F.col("ch_idx").cast("long").alias("ch_idx"), F.round(cost, 4).alias("cost"))


def q_zip_pairs(spark, sf_dir):
    user, answer = turns(spark, sf_dir)
    place = F.row_number().over(Window.partitionBy("book_id").orderBy("turn"))
    src = user.select("book_id", place.alias("div_idx"), F.lit("").alias("title"), F.col("s").alias("body"))
    tgt = answer.select("book_id", place.alias("div_idx"), F.concat(F.lit("T"), F.col("turn").cast("string")).alias("title"), F.col("t").alias("body"))
    pairs = pairing.pair_divisions(src, tgt)
    return pairs.select("book_id", F.col("ch_idx").cast("long").alias("ch_idx"), "title", F.md5("s_body").alias("s_md5"), F.md5("t_body").alias("t_md5"))


def q_align_gc(spark, sf_dir):
    beads = turn_beads(spark, sf_dir)
    return beads.select("book_id", "ch_idx", "bead_idx", "ds", "dt", F.md5(X.join_segments(F.col("src"))).alias("src_md5"), F.md5(X.join_segments(F.col("tgt"))).alias("tgt_md5"))


def q_align_vec(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("book_id"), "vec_id", F.col("embedding").alias("vec"))
    side = lambda odd: rows.where(F.col("vec_id") % 2 == odd).select("book_id", F.lit(1).alias("ch_idx"), F.row_number().over(Window.partitionBy("book_id").orderBy("vec_id")).alias("seg_idx"), F.col("vec_id").cast("string").alias("text"), "vec")
    beads = align.align_blocks(side(0), side(1), build.BLOCK, "embed")
    return beads.select("book_id", "bead_idx", "ds", "dt", X.join_segments(F.col("src")).alias("src"), X.join_segments(F.col("tgt")).alias("tgt"))


def q_align_bag(spark, sf_dir):
    src, tgt = turn_segments(spark, sf_dir)
    pivot = models.translate_segments(src, lambda texts: texts)
    beads = align.align_blocks(pivot, tgt, build.BLOCK, "mt")
    return beads.select("book_id", "ch_idx", "bead_idx", "ds", "dt")


def q_align_coverage(spark, sf_dir):
    found = align.coverage(turn_beads(spark, sf_dir), build.BLOCK)
    return found.select("book_id", F.col("ch_idx").cast("long").alias("ch_idx"), "n_src", "n_tgt")


def q_single_block(spark, sf_dir):
    user, answer = turns(spark, sf_dir)
    src = user.select("book_id", F.col("turn").alias("div_idx"), F.lit("").alias("title"), F.col("s").alias("body"))
    tgt = answer.select("book_id", F.col("turn").alias("div_idx"), F.lit("").alias("title"), F.col("t").alias("body"))
    return pairing.single_blocks(src, tgt).select("book_id", F.md5("s_body").alias("s_md5"), F.md5("t_body").alias("t_md5"))


def q_build(spark, sf_dir):
    """The whole plan: chaptered documents of even ids as originals, of the next odd ones as translations."""
    docs = chaptered(documents(spark, sf_dir, "text", "lang"))
    src = docs.where("doc_id % 2 = 0").select(F.col("doc_id").alias("book_id"), F.col("text").alias("src_text"), F.col("lang").alias("src_lang"))
    tgt = docs.where("doc_id % 2 = 1").select((F.col("doc_id") - 1).alias("book_id"), F.col("text").alias("tgt_text"), F.col("lang").alias("tgt_lang"))
    none = F.lit(None).cast("struct<first:int,last:int>")
    jobs = src.join(tgt, "book_id").withColumns({"mode": F.lit("verse"), "clean": F.lit(True), "src_range": none, "tgt_range": none})
    chapters, beads = build.build(jobs)
    found = align.coverage(beads, build.BLOCK)
    return chapters.join(found, build.BLOCK, "left").select("book_id", F.col("ch_idx").cast("long").alias("ch_idx"), "title", F.coalesce("n_src", F.lit(0).cast("long")).alias("n_src"), F.coalesce("n_tgt", F.lit(0).cast("long")).alias("n_tgt"))


def q_pages_gutter_cover(spark, sf_dir):
    sums = documents(spark, sf_dir, "text", "source").groupBy("source").agg(F.sum(F.length("text")).cast("long").alias("chars"))
    sized = sums.withColumn("pages", N.estimate_pages(F.col("chars"))).withColumn("cover", N.cover_dimensions(F.lit(6.0), F.lit(9.0), F.col("pages"), F.lit("cream")))
    return sized.select("source", "chars", F.col("pages").cast("long").alias("pages"), N.gutter(F.col("pages")).cast("double").alias("gutter"), F.round("cover.width", 6).alias("width"), F.round("cover.height", 6).alias("height"), F.round("cover.spine", 6).alias("spine"))


def q_book_measures(spark, sf_dir):
    return publish.book_measures(line_beads(spark, sf_dir)).select("book_id", "n_beads", "chars", F.col("pages").cast("long").alias("pages"), F.round("spine", 6).alias("spine"))


def q_slug(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    return parts.select("p_partkey", X.slugify(F.col("p_name")).alias("slug"), X.normalize_key(F.col("p_name")).alias("key"))


def q_escape(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", F.md5(X.escape_html(F.col("html"))).alias("html_md5"), F.md5(X.escape_xml(F.col("html"))).alias("xml_md5"))


def q_xhtml(spark, sf_dir):
    return publish.chapter_xhtml(line_beads(spark, sf_dir), first="tgt", opener_font=True).select("book_id", F.md5("xhtml").alias("xhtml_md5"))


def _issues(spark, sf_dir, max_beads=None):
    """Batches of line beads, and the issues of a reviewer that is a rule: long or very uneven beads."""
    batched = review.batches(line_beads(spark, sf_dir).withColumn("title", F.lit("")), max_beads=max_beads)
    s, t = F.length(F.array_join("src", " ")), F.length(F.array_join("tgt", " "))
    severity = F.when(s > 3 * t, "high").when(t > 3 * s, "medium").otherwise("low")
    kind = F.when(t == 0, "misalignment").otherwise("segmentation_error")
    flagged = batched.where((s > 3 * t) | (t > 3 * s) | (s > 900))
    return batched, flagged.select("book_id", "batch_no", "ref", kind.alias("issue_type"), severity.alias("severity"), F.concat(F.lit("sizes "), s.cast("string"), F.lit(" and "), t.cast("string")).alias("note"))


def q_batches(spark, sf_dir):
    batched, _ = _issues(spark, sf_dir, 30)
    return batched.groupBy("book_id", "batch_no").agg(F.count("*").alias("n"), F.max("ref").cast("long").alias("last_ref")).withColumn("batch_no", F.col("batch_no").cast("long"))


def q_prompts(spark, sf_dir):
    batched, _ = _issues(spark, sf_dir, 30)
    return review.prompts(batched, F.lit("la"), F.lit("en")).select("book_id", F.col("batch_no").cast("long").alias("batch_no"), "n", F.md5("prompt").alias("prompt_md5"))


def q_findings_report(spark, sf_dir):
    batched, issues = _issues(spark, sf_dir)
    found = review.report(review.attach(issues, batched), batched)
    return found.select("book_id", "n", "n_high", F.md5("report").alias("report_md5"))


def q_restyle(spark, sf_dir):
    beads = models.restyle_beads(line_beads(spark, sf_dir), lambda texts: [t.replace("e", "E") for t in texts])
    return beads.select("book_id", F.col("bead_idx").cast("long").alias("bead_idx"), F.md5(F.array_join("tgt", " ")).alias("tgt_md5"))


def q_catalog_json(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    names = F.when(F.col("page_id") % 4 == 0, F.array().cast("array<struct<name:string>>")).otherwise(F.array(F.struct(F.lit("Doe, J.").alias("name")), F.struct(F.concat(F.lit("A"), F.col("page_id").cast("string")).alias("name"))))
    formats = F.create_map(F.when(F.col("page_id") % 3 == 0, "text/plain; charset=utf-8").otherwise("text/html"), F.col("url"))
    entry = F.struct(F.col("page_id").alias("id"), F.when(F.col("page_id") % 7 != 0, F.col("url")).alias("title"), names.alias("authors"), F.array(F.lit("en")).alias("languages"), F.when(F.col("page_id") % 2 == 0, F.col("page_id") * 10).alias("download_count"), formats.alias("formats"))
    reply = F.to_json(F.struct(F.lit(99).alias("count"), F.when(F.col("page_id") % 2 == 0, "more").alias("next"), F.array(entry).alias("results")))
    found = catalog.parse_results(pages.select(reply.alias("reply")))
    return found.select("count", "has_next", "id", "title", "authors", F.array_join("languages", ",").alias("languages"), "downloads", "has_text")


FONT_FILES = (
    "fonts/Cardo-Regular.ttf",
    "fonts/Cardo-Bold.ttf",
    "fonts/Cardo-Italic.ttf",
    "fonts/EBGaramond[wght].ttf",
    "fonts/EBGaramond-Italic[wght].ttf",
    "fonts/GFSDidot-Regular.otf",
    "fonts/GFSDidot-Regular.ttf",
    "fonts/My_Own-BoldItalic.otf",
    "fonts/UnifrakturCook-Bold.ttf",
    "fonts/Bold.ttf",
    "fonts/readme.txt",
)


def q_fonts_catalog(spark, sf_dir):
    files = spark.createDataFrame([(p,) for p in FONT_FILES], "path string")
    return fonts.catalog(files).withColumn("rank", F.col("rank").cast("long"))


def q_font_categories(spark, sf_dir):
    files = spark.createDataFrame([(p,) for p in FONT_FILES], "path string")
    return fonts.by_category(files).select("category", F.array_join("labels", "|").alias("labels"))


def q_toc(spark, sf_dir):
    rows = segment.divisions(chaptered(documents(spark, sf_dir))).select(F.col("doc_id").alias("book_id"), F.col("div_idx").alias("ch_idx"), "title")
    return publish.contents(rows).select("book_id", F.col("ch_idx").cast("long").alias("ch_idx"), F.col("entry").cast("long").alias("entry"), publish.chapter_title(F.col("title"), F.col("ch_idx")).alias("title"))


def q_copyright(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    third = F.col("s_suppkey") % 3
    job = {
        "rights": F.when(F.col("s_suppkey") % 10 == 0, F.col("s_name")),
        "holder": F.when(third == 0, F.col("s_name")).otherwise(""),
        "publisher": F.when(third == 1, F.concat(F.col("s_name"), F.lit(" & Sons"))).otherwise(""),
        "year": F.when(F.col("s_suppkey") % 2 == 0, 2024),
        "author": F.concat(F.lit("<"), F.col("s_name"), F.lit(">")),
        "src_lang": F.when(third == 0, "la").when(third == 1, "fr").otherwise("xx"),
        "translator": F.when(F.col("s_suppkey") % 4 == 0, "T. One").otherwise(""),
        "note": F.when(F.col("s_suppkey") % 5 == 0, "from 1900").otherwise(""),
    }
    tail = publish.copyright_tail(job["publisher"], F.when(third == 2, "978-1").otherwise(""))
    return s.select("s_suppkey", F.array_join(publish.copyright_paragraphs(job), "\n").alias("paragraphs"), F.array_join(tail, "\n").alias("tail"))


def q_render_plan(spark, sf_dir):
    chapters = documents(spark, sf_dir).select(F.col("doc_id").alias("book_id"), F.lit(1).alias("ch_idx"), F.when(F.col("doc_id") % 2 == 0, "Title <1>").otherwise("").alias("title"))
    plan = publish.render_plan(chapters, line_beads(spark, sf_dir), separator=True)
    return plan.groupBy("book_id", "kind").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.max("seq").cast("long").alias("last_seq"))


def q_parse_range(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    text = F.when(F.col("o_orderkey") % 4 == 1, F.concat((F.col("o_orderkey") % 9).cast("string"), F.lit("-"), F.col("o_orderkey").cast("string"))).otherwise(F.concat(F.col("o_orderkey").cast("string"), F.lit(":")))
    found = orders.select("o_orderkey", X.parse_range(text).alias("r"))
    return found.select("o_orderkey", F.col("r.first").cast("long").alias("first"), F.col("r.last").cast("long").alias("last"))


def q_truncate(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", X.truncate(F.col("text"), 160).alias("excerpt"))


def q_vector_pool(spark, sf_dir):
    """Cosine of each vector with the unit mean of its neighbours by id, in double precision."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    near = lambda d, name: v.select((F.col("vec_id") + d).alias("vec_id"), F.col("v").alias(name))
    both = v.join(near(1, "a"), "vec_id").join(near(-1, "b"), "vec_id")
    units = both.select("vec_id", "v", N.norm(F.col("a")).alias("na"), N.norm(F.col("b")).alias("nb"), "a", "b")
    pooled = units.select("vec_id", "v", F.zip_with("a", "b", lambda x, y: x / F.col("na") + y / F.col("nb")).alias("p"))
    return pooled.select("vec_id", F.round(N.cosine(F.col("v"), F.col("p")), 6).alias("cosine"))


QUERIES = {n: f for n, f in list(globals().items()) if n.startswith("q_")}
