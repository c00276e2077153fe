"""Monotone alignment of two ordered sequences: a join that Catalyst has no operator for.

Each block (one key) is one row with both sides' segments, aligned by dynamic programming in `mapInArrow`. A small
grid is filled with plain numbers after one vectorised cost table a step; a large one is swept
by anti-diagonals with numpy, so four diagonals of costs and one byte a cell of back-pointers are held.
A block's n x m cells must fit in a task (`max_cells` refuses larger ones by name, before anything is made).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.numeric import LEAST_PROBABILITY, LENGTH_VARIANCE, STEP_PRIORS

Step = tuple[int, int]
LENGTH_STEPS: tuple[Step, ...] = ((1, 1), (1, 0), (0, 1), (2, 1), (1, 2), (2, 2))
VECTOR_STEPS: tuple[Step, ...] = ((1, 1), (1, 0), (0, 1), (2, 1), (1, 2))
DIVISION_STEPS: tuple[Step, ...] = ((1, 1), (1, 0), (0, 1))
#: The cost of leaving a segment alone, and of each segment beyond one to one.
NULL_COST, MERGE_COST = 0.85, 0.15
MAX_CELLS = 2_000_000_000
SMALL_CELLS = 4_096
#: Among equal costs the first of these stands.
_PREFERENCE: tuple[Step, ...] = ((2, 2), (2, 1), (1, 2), (1, 1), (1, 0), (0, 1))
_WORD = re.compile(r"[^\W\d_]+")

Cost = Callable[[Step, np.ndarray, np.ndarray], np.ndarray]


def refuse_large(n: int, m: int, max_cells: int = MAX_CELLS) -> None:
    """Before anything of that size is made."""
    if (n + 1) * (m + 1) > max_cells:
        raise ValueError(f"a block of {n} x {m} segments exceeds {max_cells} cells; divide it first")


def _small_path(n: int, m: int, cost: Cost, order: Sequence[Step]) -> list[tuple[int, int, int, int]]:
    """The same path over a small grid: all costs of a step at once, then plain numbers."""
    costs = []
    for ds, dt in order:
        rows, columns = n - ds + 1, m - dt + 1
        if rows > 0 and columns > 0:
            i, j = np.divmod(np.arange(rows * columns), columns)
            costs.append((ds, dt, columns, cost((ds, dt), i, j).tolist()))
    width = m + 1
    best, came = [math.inf] * ((n + 1) * width), [(0, 0)] * ((n + 1) * width)
    best[0] = 0.0
    for i in range(n + 1):
        for j in range(width):
            at = i * width + j
            for ds, dt, columns, table in costs:
                if i >= ds and j >= dt:
                    value = best[at - ds * width - dt] + table[(i - ds) * columns + j - dt]
                    if value < best[at]:
                        best[at], came[at] = value, (ds, dt)
    path, i, j = [], n, m
    while i or j:
        ds, dt = came[i * width + j]
        i, j = i - ds, j - dt
        path.append((i, j, ds, dt))
    return path[::-1]


def shortest_path(n: int, m: int, cost: Cost, steps: Sequence[Step], max_cells: int = MAX_CELLS) -> list[tuple[int, int, int, int]]:
    """(i, j, ds, dt) of the cheapest monotone path from (0, 0) to (n, m); cost(step, i, j) of steps from (i, j)."""
    refuse_large(n, m, max_cells)
    order = [s for s in _PREFERENCE if s in set(steps)]
    if (n + 1) * (m + 1) <= SMALL_CELLS:
        return _small_path(n, m, cost, order)
    back = np.full((n + 1, m + 1), -1, np.int8)
    diagonals: list[np.ndarray | None] = [None] * 5  # of the last sums i + j, by i
    diagonals[0] = np.array([0.0] + [np.inf] * n)
    for total in range(1, n + m + 1):
        low, high = max(0, total - m), min(n, total)
        i = np.arange(low, high + 1)
        best, chosen = np.full(len(i), np.inf), np.full(len(i), -1, np.int8)
        for code, (ds, dt) in enumerate(order):
            before = diagonals[ds + dt - 1]
            if before is None:
                continue
            at = (i >= ds) & (total - i >= dt)
            if not at.any():
                continue
            fi = i[at] - ds
            fj = total - i[at] - dt
            value = before[fi] + cost((ds, dt), fi, fj)
            less = value < best[at]
            spots = np.flatnonzero(at)[less]
            best[spots], chosen[spots] = value[less], code
        back[i, total - i] = chosen
        current = np.full(n + 1, np.inf)
        current[low : high + 1] = best
        diagonals = [current, *diagonals[:4]]
    path: list[tuple[int, int, int, int]] = []
    i, j = n, m
    while i or j:
        ds, dt = order[back[i, j]]
        i, j = i - ds, j - dt
        path.append((i, j, ds, dt))
    return path[::-1]


def _erf(values: np.ndarray) -> np.ndarray:
    return np.fromiter(map(math.erf, values.tolist()), float, len(values))


def length_path(src: Sequence[str], tgt: Sequence[str], max_cells: int = MAX_CELLS) -> list[tuple[int, int, int, int]]:
    """By segment lengths: the normal model of lengths, and the priors of the steps."""
    a, b = np.array([len(x) for x in src], float), np.array([len(x) for x in tgt], float)
    ratio = (b.sum() or 1) / (a.sum() or 1)
    sa, sb = np.concatenate([[0], np.cumsum(a)]), np.concatenate([[0], np.cumsum(b)])

    def cost(step: Step, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        x, y = sa[i + step[0]] - sa[i], sb[j + step[1]] - sb[j]
        z = (y - x * ratio) / np.sqrt(np.maximum(x * LENGTH_VARIANCE, 1.0))
        chance = 2 * (1 - 0.5 * (1 + _erf(np.abs(z) / math.sqrt(2))))
        out = -np.log(np.maximum(chance, LEAST_PROBABILITY))
        out[(x == 0) & (y == 0)] = 0.0
        return out - math.log(STEP_PRIORS[step])

    return shortest_path(len(src), len(tgt), cost, LENGTH_STEPS, max_cells)


def _similarity_path(dots: np.ndarray, src_norms: Sequence[np.ndarray], tgt_norms: Sequence[np.ndarray], steps: Sequence[Step], max_cells: int = MAX_CELLS) -> list[tuple[int, int, int, int]]:
    """By cosines of pooled vectors. dots: products of the single ones; norms[k]: of k + 1 pooled from each place."""
    n, m = dots.shape

    def cost(step: Step, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        ds, dt = step
        if not ds or not dt:
            return np.full(len(i), NULL_COST)
        shared = dots[i, j] if step == (1, 1) else sum(dots[i + p, j + q] for p in range(ds) for q in range(dt))
        size = src_norms[ds - 1][i] * tgt_norms[dt - 1][j]
        cosine = np.divide(shared, size, out=np.zeros(len(i)), where=size > 0)
        return 1 - cosine + MERGE_COST * (ds + dt - 2)

    return shortest_path(n, m, cost, steps, max_cells)


def _pooled_norms(singles: np.ndarray, neighbours: np.ndarray) -> list[np.ndarray]:
    """Norms of each vector and of each with its successor, from squared norms and products of neighbours."""
    pairs = singles[:-1] + singles[1:] + 2 * neighbours
    return [np.sqrt(singles), np.sqrt(np.maximum(pairs, 0))]


def vector_path(src: np.ndarray, tgt: np.ndarray, steps: Sequence[Step] = VECTOR_STEPS, max_cells: int = MAX_CELLS) -> list[tuple[int, int, int, int]]:
    """By embeddings: cosines of the mean directions of one or two segments."""

    refuse_large(len(src), len(tgt), max_cells)

    def units(x: np.ndarray) -> np.ndarray:
        size = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, size, out=np.zeros_like(x), where=size > 0)

    a, b = units(np.asarray(src, float)), units(np.asarray(tgt, float))
    norms = [_pooled_norms((x * x).sum(1), (x[:-1] * x[1:]).sum(1)) for x in (a, b)]
    return _similarity_path(a @ b.T, *norms, steps, max_cells)


def bag_path(src: Sequence[str], tgt: Sequence[str], steps: Sequence[Step] = VECTOR_STEPS, max_cells: int = MAX_CELLS) -> list[tuple[int, int, int, int]]:
    """By word bags: `src` is the source put into the target's language."""
    refuse_large(len(src), len(tgt), max_cells)
    bags = [[Counter(_WORD.findall(x.lower())) for x in side] for side in (src, tgt)]
    where: list[dict[str, list[tuple[int, int]]]] = [{}, {}]
    for held, side in zip(where, bags, strict=True):
        for k, bag in enumerate(side):
            for word, n in bag.items():
                held.setdefault(word, []).append((k, n))
    dots = np.zeros((len(src), len(tgt)))
    for word in where[0].keys() & where[1].keys():
        rows, columns = (np.array(h[word]) for h in where)
        dots[np.ix_(rows[:, 0], columns[:, 0])] += np.outer(rows[:, 1], columns[:, 1])
    norms = []
    for side in bags:
        squares = np.array([sum(n * n for n in bag.values()) for bag in side], float)
        beside = np.array([sum(n * y[w] for w, n in x.items()) for x, y in zip(side, side[1:], strict=False)], float)
        norms.append(_pooled_norms(squares, beside))
    return _similarity_path(dots, *norms, steps, max_cells)


def paths_to_beads(path, src: Sequence, tgt: Sequence) -> list[tuple[list, list]]:
    return [(list(src[i : i + ds]), list(tgt[j : j + dt])) for i, j, ds, dt in path]


def one_sided(n: int, m: int) -> list[tuple[int, int, int, int]]:
    """A bead for each segment where the other side has none."""
    return [(k, 0, 1, 0) for k in range(n)] if n else [(0, k, 0, 1) for k in range(m)]


def _block_path(method: str, src: list, tgt: list, steps: Sequence[Step] | None, max_cells: int) -> list[tuple[int, int, int, int]]:
    """The path of one block of rows (seg_idx, text, and vec or pivot)."""
    if not src or not tgt:
        return one_sided(len(src), len(tgt))
    if method in ("embed", "auto"):
        vectors = [[r.get("vec") for r in side] for side in (src, tgt)]
        if method == "embed" or not any(v is None for side in vectors for v in side):
            return vector_path(*(np.array(side, float) for side in vectors), steps or VECTOR_STEPS, max_cells)
    texts = [[r["text"] for r in side] for side in (src, tgt)]
    if method == "mt":
        return bag_path([r["pivot"] for r in src], texts[1], steps or VECTOR_STEPS, max_cells)
    return length_path(*texts, max_cells)


def align_blocks(src: DataFrame, tgt: DataFrame, keys: Sequence[str], method: str = "gale-church", steps: Sequence[Step] | None = None, max_cells: int = MAX_CELLS) -> DataFrame:
    """keys, bead_idx (1-based), src, tgt (arrays of texts), ds, dt for every block of either side.

    src, tgt: keys, seg_idx, text; with `vec` (array) for method "embed", and with `pivot` (the source's
    text in the target's language) in src for "mt". Method "auto" goes by `vec` where both sides of a block have
    all of them, else by lengths. Output texts are always the originals. Each side's segments are
    gathered into one row a block, and many blocks share an Arrow batch. Null keys make a block like any other.
    """
    keys = list(keys)
    schema = T.StructType(
        [T.StructField(k, src.schema[k].dataType) for k in keys]
        + [T.StructField("bead_idx", T.IntegerType()), T.StructField("src", T.ArrayType(T.StringType())), T.StructField("tgt", T.ArrayType(T.StringType())), T.StructField("ds", T.IntegerType()), T.StructField("dt", T.IntegerType())]
    )
    also = {"embed": ("vec", "vec"), "mt": ("pivot", None), "auto": ("vec", "vec")}.get(method, (None, None))

    def side(rows: DataFrame, more: str | None, name: str) -> DataFrame:
        fields = ["seg_idx", "text", *([more] if more and more in rows.columns else [])]
        gathered = F.sort_array(F.collect_list(F.struct(*fields))).alias(name)
        return rows.groupBy(*[F.col(k).alias(f"{name}_{n}") for n, k in enumerate(keys)]).agg(gathered)

    left, right = side(src, also[0], "left"), side(tgt, also[1], "right")
    same = [F.col(f"left_{n}").eqNullSafe(F.col(f"right_{n}")) for n in range(len(keys))]
    blocks = left.join(right, reduce(lambda a, b: a & b, same), "full")
    blocks = blocks.select(*[F.when(F.col("left").isNotNull(), F.col(f"left_{n}")).otherwise(F.col(f"right_{n}")).alias(k) for n, k in enumerate(keys)], "left", "right")
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            owner, rows = [], [[], [], [], [], []]
            for block, (a, b) in enumerate(zip(batch.column(len(keys)).to_pylist(), batch.column(len(keys) + 1).to_pylist(), strict=True)):
                a, b = a or [], b or []
                beads = paths_to_beads(_block_path(method, a, b, steps, max_cells), [r["text"] for r in a], [r["text"] for r in b])
                owner += [block] * len(beads)
                for k, (s, t) in enumerate(beads, 1):
                    for column, x in zip(rows, (k, s, t, len(s), len(t)), strict=True):
                        column.append(x)
            held = [batch.column(k).take(pa.array(owner, pa.int64())) for k in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*held, *[pa.array(x, arrow.field(len(keys) + k).type) for k, x in enumerate(rows)]], names=schema.names)

    return blocks.mapInArrow(run, schema)


def choose_method(requested: str, translators: Sequence[str] = (), src_lang: str = "", has_vectors: bool = False) -> str:
    """The aligner that a job's request comes to. auto: a registered translator, then vectors, then lengths."""
    if requested == "mt":
        if src_lang not in translators:
            raise RuntimeError(f"no translator is registered for {src_lang!r}")
        return "mt"
    if requested == "embed":
        if not has_vectors:
            raise RuntimeError("segments carry no vectors")
        return "embed"
    if requested == "auto":
        return "mt" if src_lang in translators else "embed" if has_vectors else "gale-church"
    return "gale-church"


def coverage(beads: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, n_beads, n_src, n_tgt, n_matched of each block."""
    matched = F.count_if((F.col("ds") > 0) & (F.col("dt") > 0))
    return beads.groupBy(*keys).agg(F.count("*").alias("n_beads"), F.sum("ds").cast("long").alias("n_src"), F.sum("dt").cast("long").alias("n_tgt"), matched.alias("n_matched"))
