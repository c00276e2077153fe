"""Sinks: reports and outlines as text, jobs as JSON, editions as EPUB bytes."""

from __future__ import annotations

import io
import uuid
import zipfile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.text import escape_html, language_name
from .operators.publish import chapter_title, chapter_xhtml

STYLE = "p.src{margin:0 0 .2em}p.tgt{margin:0 0 .8em 1.2em;font-style:italic}"
_CONTAINER = '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="EPUB/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'


def write_reports(reports: DataFrame, path: str) -> None:
    """Each book's Markdown report, one text file a partition of books."""
    reports.select("book_id", F.col("report").alias("value")).write.mode("overwrite").partitionBy("book_id").text(path)


def append_jobs(jobs: DataFrame, path: str) -> None:
    jobs.write.mode("append").json(path)


def outline_lines(outline: DataFrame) -> DataFrame:
    """doc_id, index, line: an outline as it is printed, titles cut to 60 characters."""
    return outline.select("doc_id", "index", F.format_string("  %3d. [%8s ch] %s", F.col("index"), F.format_number("chars", 0), F.substring("title", 1, 60)).alias("line"))


def _page(title: str, body: str, lang: str) -> str:
    return f'<?xml version="1.0" encoding="utf-8"?><!DOCTYPE html><html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops" lang="{lang}"><head><title>{title}</title><link rel="stylesheet" href="style.css"/></head><body>{body}</body></html>'


def epub_bytes(title: str, author: str, lang: str, chapters: list[tuple[str, str]]) -> bytes:
    """An EPUB 3 file of chapters (title, body), both already escaped. The same input gives the same bytes."""
    names = [f"chap_{k:04d}.xhtml" for k in range(1, len(chapters) + 1)]
    links = "".join(f'<li><a href="{n}">{t}</a></li>' for n, (t, _) in zip(names, chapters, strict=True))
    items = "".join(f'<item id="c{k}" href="{n}" media-type="application/xhtml+xml"/>' for k, n in enumerate(names))
    spine = "".join(f'<itemref idref="c{k}"/>' for k in range(len(names)))
    ident = uuid.uuid5(uuid.NAMESPACE_URL, "\n".join([title, author, lang, *(b for _, b in chapters)]))
    package = (
        '<?xml version="1.0" encoding="utf-8"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/">'
        f'<dc:identifier id="id">urn:uuid:{ident}</dc:identifier><dc:title>{title}</dc:title><dc:creator>{author}</dc:creator><dc:language>{lang}</dc:language><meta property="dcterms:modified">2000-01-01T00:00:00Z</meta></metadata>'
        f'<manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="css" href="style.css" media-type="text/css"/>{items}</manifest><spine><itemref idref="nav"/>{spine}</spine></package>'
    )
    files = {
        "META-INF/container.xml": _CONTAINER,
        "EPUB/content.opf": package,
        "EPUB/style.css": STYLE,
        "EPUB/nav.xhtml": _page(title, f'<nav epub:type="toc"><ol>{links}</ol></nav>', lang),
        **{f"EPUB/{n}": _page(t, f"<h2>{t}</h2>{b}", lang) for n, (t, b) in zip(names, chapters, strict=True)},
    }
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as book:
        book.writestr(zipfile.ZipInfo("mimetype", (1980, 1, 1, 0, 0, 0)), "application/epub+zip")
        for name, content in files.items():
            book.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), content, zipfile.ZIP_DEFLATED)
    return held.getvalue()


def editions(jobs: DataFrame, chapters: DataFrame, beads: DataFrame, first: str = "src") -> DataFrame:
    """book_id, epub of each job (book_id, title, author, src_lang, tgt_lang): a table of binaries, so that
    any store Spark writes can hold it. One book is one task."""
    bodies = chapter_xhtml(beads, first=first)
    titled = chapters.select("book_id", "ch_idx", escape_html(chapter_title(F.col("title"), F.col("ch_idx"))).alias("chapter"))
    label = F.concat(F.lit("Parallel edition: "), language_name(F.col("src_lang")), F.lit(" and "), language_name(F.col("tgt_lang")))
    facts = jobs.select("book_id", escape_html(F.col("title")).alias("book"), escape_html(F.col("author")).alias("author"), F.col("tgt_lang").alias("lang"), label.alias("label"))
    rows = titled.join(bodies, ["book_id", "ch_idx"]).join(facts, "book_id")

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ch_idx")
        one = frame.iloc[0]
        content = [("Edition", f"<p>{one['label']}</p>"), *zip(frame["chapter"], frame["xhtml"], strict=True)]
        return pd.DataFrame({"book_id": [one["book_id"]], "epub": [epub_bytes(one["book"], one["author"], one["lang"], content)]})

    return rows.groupBy("book_id").applyInPandas(pack, "book_id long, epub binary")
