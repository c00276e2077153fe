"""Alignment: published-style examples, brute force over all paths, and invariants."""

import math
from functools import cache

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glossweave.operators import align, pairing
from glossweave.plans import build

TESTS = {
    "one": ([39, 36, 49], [37, 41, 64], [(1, 1)] * 3, 1.217491),
    "two": ([68, 55], [65, 72], [(1, 1)] * 2, 1.262241),
    "split": ([124, 32], [65, 52, 46], [(1, 2), (1, 1)], 3.873730),
    "greek": ([49, 20], [57, 21], [(1, 1)] * 2, 0.422096),
}


def length_cost(a, b, c, step):
    z = (b - a * c) / math.sqrt(max(a * 6.8, 1.0))
    p = max(2 * (1 - 0.5 * (1 + math.erf(abs(z) / math.sqrt(2)))), 1e-12)
    return (0.0 if a == b == 0 else -math.log(p)) - math.log({(1, 1): 0.89, (1, 0): 0.0099, (0, 1): 0.0099, (2, 1): 0.089, (1, 2): 0.089, (2, 2): 0.011}[step])


@pytest.mark.parametrize("name", TESTS)
def test_length_examples(name):
    src, tgt, steps, total = TESTS[name]
    path = align.length_path(["x" * n for n in src], ["x" * n for n in tgt])
    assert [(ds, dt) for _, _, ds, dt in path] == steps
    c = sum(tgt) / sum(src)
    assert sum(length_cost(sum(src[i : i + ds]), sum(tgt[j : j + dt]), c, (ds, dt)) for i, j, ds, dt in path) == pytest.approx(total, abs=1e-5)


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 5), st.integers(0, 5), st.integers(0, 2**32), st.sampled_from([align.LENGTH_STEPS, align.VECTOR_STEPS, align.DIVISION_STEPS]))
def test_path_is_cheapest_and_ties_follow_forward_relaxation(n, m, seed, steps):
    grid = {s: np.random.default_rng(seed + k).integers(0, 4, (n + 1, m + 1)).astype(float) for k, s in enumerate(align.LENGTH_STEPS)}
    path = align.shortest_path(n, m, lambda s, i, j: grid[s][i, j], steps)
    # forward relaxation in row order with strict improvement
    best, came = {(0, 0): 0.0}, {}
    for i in range(n + 1):
        for j in range(m + 1):
            if (i, j) in best:
                for ds, dt in align.LENGTH_STEPS:
                    if (ds, dt) in steps and i + ds <= n and j + dt <= m:
                        value = best[i, j] + grid[ds, dt][i, j]
                        if value < best.get((i + ds, j + dt), math.inf):
                            best[i + ds, j + dt], came[i + ds, j + dt] = value, (i, j, ds, dt)
    want, at = [], (n, m)
    while at != (0, 0):
        want.append(came[at])
        at = came[at][:2]
    assert path == want[::-1]

    @cache
    def least(i, j):
        if (i, j) == (n, m):
            return 0.0
        return min((grid[s][i, j] + least(i + s[0], j + s[1]) for s in steps if i + s[0] <= n and j + s[1] <= m), default=math.inf)

    assert sum(grid[ds, dt][i, j] for i, j, ds, dt in path) == least(0, 0)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("ab. ", max_size=9), max_size=6), st.lists(st.text("ab. ", max_size=9), max_size=6))
def test_beads_partition_both_sides(src, tgt):
    for path in (align.length_path, align.bag_path):
        p = path(src, tgt) if src and tgt else align.one_sided(len(src), len(tgt))
        beads = align.paths_to_beads(p, src, tgt)
        assert sum((s for s, _ in beads), []) == src and sum((t for _, t in beads), []) == tgt


def test_vectors_pool_and_merge():
    rng = np.random.default_rng(0)
    base = rng.normal(size=(6, 8))
    src = base.copy()
    tgt = np.vstack([base[0], base[1] / np.linalg.norm(base[1]) + base[2] / np.linalg.norm(base[2]), base[3], base[4], base[5]])
    assert [(ds, dt) for *_, ds, dt in align.vector_path(src, tgt)] == [(1, 1), (2, 1), (1, 1), (1, 1), (1, 1)]
    assert align.vector_path(np.zeros((2, 3)), np.ones((2, 3)))


def test_bags_follow_words():
    assert [(i, j) for i, j, *_ in align.bag_path(["the cat", "a dog ran"], ["The cat!", "DOG ran", "a"])] == [(0, 0), (1, 1)]


def test_blocks_in_spark(spark):
    src = spark.createDataFrame([(1, 1, 1, "a"), (1, 1, 2, "b"), (2, 1, 1, "only")], "book_id long, ch_idx int, seg_idx int, text string")
    tgt = spark.createDataFrame([(1, 1, 2, "B"), (1, 1, 1, "A"), (3, 1, 1, "x"), (3, 1, 2, "y")], "book_id long, ch_idx int, seg_idx int, text string")
    rows = align.align_blocks(src, tgt, ["book_id", "ch_idx"]).orderBy("book_id", "bead_idx").collect()
    assert [(r.book_id, r.src, r.tgt) for r in rows] == [(1, ["a"], ["A"]), (1, ["b"], ["B"]), (2, ["only"], []), (3, [], ["x"]), (3, [], ["y"])]
    with pytest.raises(ValueError, match="cells"):
        align.shortest_path(10, 10, lambda s, i, j: np.zeros(len(i)), align.LENGTH_STEPS, max_cells=50)


def test_choice_of_method():
    assert align.choose_method("auto", ["la"], "la", True) == "mt" and align.choose_method("auto", [], "la", True) == "embed"
    assert align.choose_method("auto") == align.choose_method("anything") == "gale-church"
    for name in ("mt", "embed"):
        with pytest.raises(RuntimeError):
            align.choose_method(name)


def divisions(spark, rows):
    return spark.createDataFrame(pd.DataFrame(rows, columns=["book_id", "div_idx", "title", "body", "vec"]))


def test_pairing(spark):
    src = divisions(spark, [(1, 1, "S1", "a", [1.0, 0.0]), (1, 2, "S2", "b", [0.0, 1.0]), (2, 1, "S", "a", [1.0, 0.0]), (2, 2, "", "b", [0.0, 1.0]), (3, 1, "one", "x", [1.0, 0.0])])
    tgt = divisions(spark, [(1, 1, "", "A", [1.0, 0.0]), (1, 2, "T2", "B", [0.0, 1.0]), (2, 1, "T1", "A", [1.0, 0.0]), (2, 2, "T2", "B", [0.0, 1.0]), (2, 3, "T3", "C", [-1.0, -1.0]), (3, 1, "eins", "X", [1.0, 0.0])])
    rows = lambda by: [tuple(r) for r in pairing.pair_divisions(src, tgt, by_meaning=by).orderBy("book_id", "ch_idx").collect()]
    assert rows(False) == [(1, 1, "S1", "a", "A"), (1, 2, "T2", "b", "B"), (2, 1, "", "a\n\nb", "A\n\nB\n\nC"), (3, 1, "", "x", "X")]
    assert rows(True) == [(1, 1, "S1", "a", "A"), (1, 2, "T2", "b", "B"), (2, 1, "T1", "a", "A"), (2, 2, "T2", "b", "B"), (2, 3, "T3", "", "C"), (3, 1, "", "x", "X")]


def test_build_end_to_end(spark):
    jobs = spark.createDataFrame(
        [(1, "la", "en", "prose", True, "auto", True, "Chapter I\nPrima res. Secunda res.\nChapter II\nProduced by X\nTertia.", "Chapter I\nFirst thing. Second thing.\nChapter II\nThird.", None, None), (2, "fr", "en", "verse", True, "gale-church", False, "a\nb", "A\nB", None, None)],
        "book_id long, src_lang string, tgt_lang string, mode string, clean boolean, aligner string, restyle boolean, src_text string, tgt_text string, src_range struct<first:int,last:int>, tgt_range struct<first:int,last:int>",
    )
    chapters, beads = build.build_each(jobs, {"la": lambda t: t}, {"en": lambda t: [x.upper() for x in t]})
    got = sorted((r.book_id, r.ch_idx, r.bead_idx, tuple(r.src), tuple(r.tgt)) for r in beads.collect())
    assert sorted((r.book_id, r.ch_idx, r.title) for r in chapters.collect()) == [(1, 1, "Chapter I"), (1, 2, "Chapter II"), (2, 1, "")]
    assert [t for b, c, *_, t in got if b == 1 and c == 1][-1][-1].startswith("SECOND") and [t for b, *_, t in got if b == 2] == [("A",), ("B",)]
