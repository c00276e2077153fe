"""Review, models, publishing, fonts, sources and streaming."""

import json

import pytest
from pyspark.sql import functions as F

from glossweave.operators import fonts, models, publish, review, wordbag
from glossweave.sources import catalog, jobs, texts
from glossweave.streaming import landing

BEADS = "book_id long, ch_idx int, bead_idx int, title string, src array<string>, tgt array<string>"


def beads(spark, n=30):
    return spark.createDataFrame([(1, 1 + k // 20, 1 + k % 20, "" if k < 20 else "Two", [f"s{k}", "more"], [f"t{k}"]) for k in range(n)], BEADS)


def test_review_batches_and_findings(spark):
    seen = []

    def reviewer(prompt):
        lines = prompt.split("\n")
        out = [{"ref": 1, "severity": "high", "issue_type": "misalignment", "note": lines[0]}, {"ref": 99}, {"ref": True}, {"ref": "1"}]
        return json.dumps(out) if len(lines) > 4 else [{"ref": 2}]

    found = review.review(beads(spark), reviewer, "la", "en", max_beads=26).orderBy("chapter_index", "bead_index").collect()
    assert [(r.chapter_index, r.chapter_title, r.bead_index, r.severity, r.issue_type) for r in found] == [(0, "Chapter 1", 0, "high", "misalignment"), (0, "Chapter 1", 12, "high", "misalignment"), (1, "Two", 5, "medium", "other")]
    assert found[0].note == "1. SRC(la): s0 more" and found[1].src_excerpt == "s12 more"
    assert not seen


def test_report_order_and_empty(spark):
    rows = [(1, 0, "A", 3, "other", "low", "n1", "s", "t"), (1, 1, "B", 0, "other", "high", "n2", "s", "t"), (1, 0, "A", 1, "other", "odd", "n3", "s", "t")]
    books = spark.createDataFrame([(1,), (2,)], "book_id long")
    got = {r.book_id: r for r in review.report(spark.createDataFrame(rows, review.FINDINGS), books).collect()}
    text = got[1].report
    assert text.startswith("# Segment review — 3 flagged bead(s)\n\n## [HIGH] B — bead 1 (other)\n- n2\n- SRC: s\n- TGT: t\n")
    assert text.index("n2") < text.index("n1") < text.index("n3") and got[1].n_high == 1
    assert got[2].report == "# Segment review\n\nNo issues flagged.\n" and got[2].n == 0


def test_registries_and_models(spark, monkeypatch):
    registry = models.Registry({"el": "grc"})
    registry.register("EL", lambda t: t)
    assert registry.get("grc") and registry.available() == ["grc"] and registry.get("la") is None
    registry.configure({"la": "http://x", "fr": {"url": "http://y", "batch_size": 2}}, models.HttpTranslator)
    assert registry.get("la").batch_size == 32 and registry.get("fr").batch_size == 2
    registry.clear()
    assert not registry.available()

    class Reply:
        def __init__(self, body):
            self.body = body

        def __enter__(self):
            return self

        def __exit__(self, *a):
            return False

        def read(self, *a):
            return self.body

    sent = []

    def open_(request, timeout):
        sent.append(json.loads(request.data))
        return Reply(json.dumps({"translations": [t.upper() for t in sent[-1]["texts"]][: 1 if "short" in sent[-1]["texts"] else None]}).encode())

    monkeypatch.setattr(models.urllib.request, "urlopen", open_)
    http = models.HttpTranslator("la", "http://x", batch_size=2)
    assert http(["a", "b", "c"]) == ["A", "B", "C"] and [len(x["texts"]) for x in sent] == [2, 1] and sent[0]["src_lang"] == "la"
    with pytest.raises(ValueError, match="returned 1 texts for 2"):
        http(["short", "x"])
    styled = models.restyle_beads(beads(spark, 2).unionByName(spark.createDataFrame([(2, 1, 1, "", ["x"], [])], BEADS)), lambda t: [x + "!" for x in t]).orderBy("book_id", "bead_idx").collect()
    assert [r.tgt for r in styled] == [["t0!"], ["t1!"], []] and styled[0].src == ["s0", "more"]
    vec = models.encode_segments(spark.createDataFrame([("ab",), ("c",)], "text string"), lambda: lambda t: [[len(x), 1] for x in t]).collect()
    assert sorted(r.vec for r in vec) == [[1.0, 1.0], [2.0, 1.0]]


def test_bead_markup(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    mark = lambda s, t, first, opener: one(publish.bead_xhtml(F.lit(s), F.lit(t), F.lit(first), F.lit(opener)))
    assert mark("a<", "b", "src", False) == '<p class="src">a&lt;</p>\n<p class="tgt">b</p>'
    assert mark("a", "b", "tgt", True) == '<p class="src opener">b</p>\n<p class="tgt opener">a</p>'
    assert mark("", "b", "src", False) == '<p class="tgt">b</p>' and mark("", "", "src", False) == ""
    assert publish.random_styles(8) == ["nouveau", "medieval", "fleuron", "victorian", "victorian", "classical", "rule", "baroque"]
    assert one(publish.random_style(F.lit(1))) == "medieval"
    assert one(publish.motif(F.lit("fr"), F.lit(None).cast("string"))).color == "#27408b" and one(publish.motif(F.lit("xx"), F.lit("#111"))).color == "#111"


def test_contents_need_two_titles(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, ""), (1, 3, "b"), (2, 1, "only"), (2, 2, "")], "book_id long, ch_idx int, title string")
    assert [tuple(r) for r in publish.contents(rows).orderBy("ch_idx").collect()] == [(1, 1, 1, "a"), (1, 3, 2, "b")]
    assert publish.contents(rows, enabled=False).count() == 0


def test_render_plan(spark):
    chapters = spark.createDataFrame([(1, 1, "T"), (1, 2, "")], "book_id long, ch_idx int, title string")
    plan = publish.render_plan(chapters, spark.createDataFrame([(1, 1, 1, "", ["a"], ["b"]), (1, 1, 2, "", ["c"], []), (1, 2, 1, "", [], ["d"])], BEADS), first="tgt", separator=True)
    assert [(r.kind, r.text) for r in plan.orderBy("seq").collect()] == [("chapter", "T"), ("src", "b"), ("tgt", "a"), ("separator", "—"), ("tgt", "c"), ("src", "d")]


def test_fonts(spark):
    names = ["x/A-Bold.otf", "x/A-Regular.ttf", "x/A_Regular.ttf", "x/Cardo[wght].ttf", "x/SemiBoldItalic.ttf", "x/Foo-ExtraBoldItalic.ttf", "x/no.pdf"]
    rows = {r.key: r for r in fonts.families(spark.createDataFrame([(n,) for n in names], "path string")).collect()}
    assert rows["a"].files == {"bold": "x/A-Bold.otf", "regular": "x/A-Regular.ttf"} and rows["a"].category == "other"
    assert rows["cardo"].display == "Cardo" and rows["cardo"].greek is True
    assert rows["foo"].italic == rows["foo"].bold == rows["foo"].regular == "x/Foo-ExtraBoldItalic.ttf"
    assert "semi" in rows
    label = spark.range(1).select(fonts.resolve(F.lit("C a r d o"), fonts.families(spark.createDataFrame([("x/Cardo.ttf",)], "path string")))).first()[0]
    assert label == "x/Cardo.ttf"


def test_word_cosine(spark):
    docs = spark.createDataFrame([(1, "a b b"), (2, "B c"), (3, "...")], "doc_id long, text string")
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "left long, right long")
    got = {r.right: r.cosine for r in wordbag.pair_cosine(pairs, wordbag.word_bags(docs, ["doc_id"])).collect()}
    assert got[2] == pytest.approx(2 / (5**0.5 * 2**0.5)) and got[3] == 0


def test_catalog(spark):
    reply = {"count": 2, "next": None, "results": [{"id": 1, "title": None, "authors": [], "languages": ["fr"], "formats": {"text/plain; charset=us-ascii": "u"}}, {"id": 2, "title": "T", "authors": [{"name": "A"}, {"name": "B"}], "languages": [], "download_count": 5, "formats": {"text/html": "u"}}]}
    rows = catalog.parse_results(spark.createDataFrame([(json.dumps(reply),)], "reply string")).orderBy("id").collect()
    assert [(r.title, r.authors, r.downloads, r.has_text, r.has_next) for r in rows] == [("(untitled)", "Unknown", 0, True, False), ("T", "A, B", 5, False, False)]


def test_jobs(spark, tmp_path):
    row = jobs.from_config(spark, {"books": [{"title": "T", "src_lang": "fr", "src_range": "2-5", "tgt_range": 3, "font": "EB Garamond", "cover": True, "copyright": False, "trim": [5, 8]}]}).first()
    assert (row.author, row.tgt_lang, tuple(row.src_range), row.tgt_range, row.font.family, row.cover.enabled, row.copyright.enabled, row.trim.w) == ("Unknown", "en", (2, 5), None, "EB Garamond", True, False, 5.0)
    with pytest.raises(KeyError):
        jobs.job_row({"title": "T"})
    with pytest.raises(ValueError, match="list of books"):
        jobs.from_config(spark, "x")
    assert jobs.parse_range("3") == {"first": 3, "last": 3} and jobs.parse_range([1, 2]) == {"first": 1, "last": 2} and jobs.parse_range("") is None
    payload = {"title": "P", "src_id": 7, "src_range": [0, 4], "tgt_range": [2, 4], "cover": {"enabled": True, "blurb": ""}, "copyright": {"publisher": "X", "isbn": ""}}
    p = jobs.from_payloads(spark.createDataFrame([(json.dumps(payload),), ("{}",)], "payload string")).orderBy("title").collect()
    assert (p[0].src_lang, p[0].src_range, tuple(p[0].tgt_range), p[0].cover.enabled, p[0].copyright.publisher) == ("la", None, (2, 4), True, "X") and p[1].title == "Untitled"
    assert p[0].__fields__ == row.__fields__
    config = jobs.payload_to_config(payload)
    assert config["cover"] == {"paper": "white"} and config["copyright"] == {"publisher": "X"} and config["src_gutenberg_id"] == 7
    a = jobs.from_arguments(spark, ["--title", "C", "--src-lang", "de", "--src-range", "3", "--no-toc", "--edition-year", "1999"]).first()
    assert (a.title, a.src_lang, tuple(a.src_range), a.toc, a.copyright.year, a.cover.enabled) == ("C", "de", (3, 3), False, 1999, False)
    assert a.book_id == jobs.from_arguments(spark, ["--title", "C", "--src-lang", "de", "--src-range", "3", "--no-toc", "--edition-year", "1999"]).first().book_id


def test_text_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"x\r\ny\rz \xff")
    files = texts.read_texts(spark, str(tmp_path / "a.txt"))
    assert files.first().text == "x\ny\nz �"
    got = texts.landed(spark, spark.createDataFrame([(1,), (2,)], "text_id long"), str(tmp_path / "landing"), get=lambda url: None if "cache" in url else "*** START OF THE PROJECT GUTENBERG EBOOK ***\nbody " + url.rsplit("/", 1)[-1])
    assert sorted(r.text for r in got.collect()) == ["body 1-0.txt", "body 2-0.txt"]
    again = texts.landed(spark, spark.createDataFrame([(2,)], "text_id long"), str(tmp_path / "landing"), get=lambda url: 1 / 0)
    assert again.count() == 1
    with pytest.raises(RuntimeError, match="no source"):
        texts.first_text(5, get=lambda url: None)
    path = files.first().path
    both = spark.createDataFrame([(path, 2), (None, 1)], "src_path string, src_id long")
    assert sorted(r.text[:4] for r in texts.load_text(both, files, got, "src_path", "src_id").collect()) == ["body", "x\ny\n"]


def test_landing_stream(spark, tmp_path):
    spark.createDataFrame([(1, "Chapter I\nx. y.", "en", "prose")], "doc_id long, text string, lang string, mode string").write.parquet(str(tmp_path / "in"))
    query = landing.segment_stream(landing.landing_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
