"""Sinks, chat, librarian and job runs with stand-ins for what is remote."""

import io
import json
import urllib.error
import zipfile

import pytest
from pyspark.sql import functions as F

from glossweave import sinks
from glossweave.operators.segment import outline
from glossweave.plans import build, librarian
from glossweave.sources import catalog, chat


def test_editions_are_valid_archives(spark):
    jobs = spark.createDataFrame([(1, "A & B", "X", "la", "en")], "book_id long, title string, author string, src_lang string, tgt_lang string")
    chapters = spark.createDataFrame([(1, 2, "<Two>"), (1, 1, "")], "book_id long, ch_idx int, title string")
    beads = spark.createDataFrame([(1, 1, 1, ["a"], ["b"]), (1, 2, 1, ["c"], [])], "book_id long, ch_idx int, bead_idx int, src array<string>, tgt array<string>")
    row = sinks.editions(jobs, chapters, beads).first()
    book = zipfile.ZipFile(io.BytesIO(bytes(row.epub)))
    assert book.namelist()[0] == "mimetype" and book.read("mimetype") == b"application/epub+zip"
    assert b"A &amp; B" in book.read("EPUB/content.opf")
    assert b'<h2>Chapter 1</h2><p class="src">a</p>' in book.read("EPUB/chap_0002.xhtml") and b"&lt;Two&gt;" in book.read("EPUB/nav.xhtml")
    import xml.dom.minidom

    for name in book.namelist():
        if name.endswith(("xhtml", "opf", "xml")):
            xml.dom.minidom.parseString(book.read(name))


def test_text_sinks(spark, tmp_path):
    sinks.write_reports(spark.createDataFrame([(1, "# r\n")], "book_id long, report string"), str(tmp_path / "r"))
    assert next((tmp_path / "r" / "book_id=1").glob("part*")).read_text() == "# r\n\n"
    sinks.append_jobs(spark.range(1), str(tmp_path / "j"))
    sinks.append_jobs(spark.range(1), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    lines = sinks.outline_lines(outline(spark.createDataFrame([(1, "Chapter I\n" + "x" * 1200)], "doc_id long, text string"))).collect()
    assert lines[0].line == "    1. [   1,200 ch] Chapter I"


def test_chat_errors(monkeypatch):
    def answer(error):
        def open_(request, timeout):
            raise error

        return open_

    monkeypatch.setattr(chat.urllib.request, "urlopen", answer(urllib.error.HTTPError("u", 404, "", {}, None)))
    with pytest.raises(chat.ChatError, match="no model"):
        chat.chat("http://h/", "m", [])
    monkeypatch.setattr(chat.urllib.request, "urlopen", answer(urllib.error.HTTPError("u", 500, "", {}, None)))
    with pytest.raises(urllib.error.HTTPError):
        chat.chat("http://h/", "m", [])
    monkeypatch.setattr(chat.urllib.request, "urlopen", answer(urllib.error.URLError("down")))
    with pytest.raises(chat.ChatError, match="no answer"):
        chat.chat("http://h/", "m", [])


def test_librarian(spark):
    call = lambda name, arguments: {"function": {"name": name, "arguments": arguments}}
    final = {"title": "T", "src_lang": "la", "src_gutenberg_id": "5", "tgt_gutenberg_id": 6, "src_range": [2, 3], "tgt_range": [1], "translator": "N"}
    replies = [
        {"message": {"content": "hm"}},
        {"message": {"tool_calls": [call("search_gutenberg", json.dumps({"query": "q"})), call("inspect_edition", {"gutenberg_id": 5}), call("odd", {})]}},
        {"message": {"tool_calls": [call("propose_book_spec", final)]}},
    ]
    seen = []

    def ask(messages, tools):
        seen.append(list(messages))
        return replies[len(seen) - 1]

    reply = json.dumps({"count": 1, "next": "x", "results": [{"id": 5, "title": "B", "authors": [{"name": "A"}], "languages": ["la"], "formats": {"text/plain": "u"}}]})
    search = lambda query, language: catalog.search(spark, query, language, get=lambda url: reply)
    load = lambda i: spark.createDataFrame([("Chapter I\nx\nChapter II\ny",)], "text string")
    found = librarian.find_book("find it", ask, search, load)
    assert found.job["src_range"] == {"first": 2, "last": 3} and found.job["tgt_range"] is None and found.job["translation_pd_confirmed"] is False
    assert found.job["copyright"]["translator"] == "N" and found.translator == "N"
    told = [json.loads(m["content"]) for m in seen[2] if m.get("role") == "tool"]
    assert told[0]["results"][0]["has_text"] and told[0]["has_next"] and told[1]["division_count"] == 2 and "unknown tool" in told[2]["error"]
    with pytest.raises(librarian.LibrarianError):
        librarian.find_book("x", lambda m, t: {"message": {}}, search, load, max_turns=2)


def test_one_failing_job_does_not_stop_the_others(spark):
    jobs = spark.range(3).withColumnRenamed("id", "book_id")

    def build_one(job):
        if job.first().book_id == 1:
            raise ValueError("bad")

    status = build.run_jobs(jobs, build_one)
    assert [(b, s) for b, s, _ in status] == [(0, "done"), (1, "error"), (2, "done")] and build.exit_code(status) == 1
    assert build.exit_code([]) == 0 and jobs.where(F.col("book_id") > 5).count() == 0
