"""Refreshed texts, endpoint options, ranges, and alignment that falls back to lengths."""

import pytest
from pyspark.sql import functions as F

from glossweave.operators import align, models
from glossweave.sources import jobs, texts


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "text_id long")


def test_refresh_touches_its_ids_alone(spark, tmp_path):
    landing = str(tmp_path / "landing")
    texts.landed(spark, ids(spark, 1, 2), landing, get=lambda url: "old " + url.rsplit("/", 1)[-1])
    again = texts.landed(spark, ids(spark, 1), landing, get=lambda url: "new " + url.rsplit("/", 1)[-1], refresh=True)
    assert [r.text for r in again.collect()] == ["new pg1.txt"]
    both = texts.landed(spark, ids(spark, 1, 2), landing, get=lambda url: 1 / 0)
    assert sorted((r.text_id, r.text) for r in both.collect()) == [(1, "new pg1.txt"), (2, "old pg2.txt")]


def test_an_id_without_source_leaves_the_others(spark, tmp_path):
    get = lambda url: None if "7" in url.rsplit("/", 1)[-1] else "text"
    got = texts.landed(spark, ids(spark, 7, 8), str(tmp_path / "landing"), get=get, strict=False)
    assert [(r.text_id, r.text) for r in got.collect()] == [(8, "text")]


def test_endpoint_options():
    registry = models.Registry({"el": "grc"})
    registry.configure({"la": "http://a", "el": {"url": "http://b", "batch": 5, "timeout": 7, "headers": {"X-Key": 1}}, "fr": {"batch": 3}, "de": None}, models.HttpTranslator)
    assert registry.available() == ["grc", "la"]
    made = registry.get("el")
    assert (made.lang, made.url, made.batch_size, made.timeout) == ("grc", "http://b", 5, 7.0)
    assert made.headers == {"Content-Type": "application/json", "X-Key": "1"} and registry.get("la").batch_size == models.HTTP_BATCH


@pytest.mark.parametrize(("raw", "want"), [("2-5", (2, 5)), ("2:5", (2, 5)), (" 7 ", (7, 7)), ("4-", (4, 4)), ((1, 3), (1, 3)), ("", None), (3, None), ([1], None)])
def test_ranges(raw, want):
    found = jobs.parse_range(raw)
    assert (found and (found["first"], found["last"])) == want


def test_a_range_of_words_is_an_error():
    with pytest.raises(ValueError):
        jobs.parse_range("a-b")


def segments(spark, *rows):
    return spark.createDataFrame([(*r[:3], r[3] if len(r) > 3 else None) for r in rows], "block int, seg_idx int, text string, vec array<double>")


def test_auto_goes_by_vectors_where_all_are_there(spark):
    """Block 1: both as one cost 1 - 1/sqrt(2) + 0.15, one alone and one matched 0.85."""
    src = segments(spark, (1, 1, "aaaa", [1.0, 0.0]), (1, 2, "b", [0.0, 1.0]), (2, 1, "aaaa", [1.0, 0.0]), (2, 2, "b"))
    tgt = segments(spark, (1, 1, "x", [0.0, 1.0]), (2, 1, "xxxx", [0.0, 1.0]), (2, 2, "y", [1.0, 0.0]), (None, 1, "z"))
    got = {r.block: [] for r in src.unionByName(tgt).select("block").collect()}
    for r in align.align_blocks(src, tgt, ["block"], "auto").orderBy("block", "bead_idx").collect():
        got[r.block].append((tuple(r.src), tuple(r.tgt)))
    assert got == {1: [(("aaaa", "b"), ("x",))], 2: [(("aaaa",), ("xxxx",)), (("b",), ("y",))], None: [((), ("z",))]}


def test_a_failing_encoder_leaves_null_vectors(spark):
    def load():
        raise OSError("no model here")

    rows = spark.createDataFrame([("a",), ("b",)], "text string")
    assert models.encode_segments(rows, load, lenient=True).where(F.col("vec").isNull()).count() == 2
    with pytest.raises(Exception, match="no model here"):
        models.encode_segments(rows, load).collect()


def test_small_and_large_grids_give_one_path(monkeypatch):
    import random

    rng = random.Random(3)
    for _ in range(30):
        src, tgt = (["x" * rng.randint(0, 40) for _ in range(rng.randint(1, 12))] for _ in range(2))
        small = align.length_path(src, tgt), align.bag_path(src, tgt)
        with monkeypatch.context() as m:
            m.setattr(align, "SMALL_CELLS", 0)
            assert (align.length_path(src, tgt), align.bag_path(src, tgt)) == small


def test_large_blocks_are_refused_before_they_are_made():
    with pytest.raises(ValueError, match="cells"):
        align.bag_path(["a"] * 10, ["b"] * 10, max_cells=100)
