"""Approximate nearest neighbours over balanced posting lists.

Lists: a bounded sample (`SAMPLE` vectors, the first in hash order, `SAMPLE_BYTES` at most) is halved again and
again along its main direction, which gives equally large leaves, one for every `list_size` vectors of the table
(`MOST_LISTS` at most; a larger table has larger lists). A few rounds of k-means follow in which a list pays for
being larger than the mean, so the lists stay balanced. Every vector goes to its nearest list, at that price;
boundary vectors, whose next list is within (1 + `BOUNDARY`) of the nearest one's distance, are replicated to it
(to `COPIES` lists at most; a list whose centroid is within `APART` of the vector's distance of one already chosen is passed over).

Search: a query finds its centroids by best-first search in an in-memory neighbour graph and takes the lists
whose centroid is within (1 + prune) times the nearest one's distance (or the usual one, where that is larger),
and more until they hold k + 1 vectors. The ratio is fitted: a part of the sample is held out, and its
nearest neighbours must be reached with a chance of `TARGET`. Neighbouring leaves of about `GROUP` vectors together are one group;
a query goes once to each group where it has a list, with their numbers. A task holds the vectors of one group
at a time and lets that group's queries stream past, so its memory is bounded whatever the number of queries; the
vectors are repeated only for each further `QUERIES` queries of a group.

Equal vectors are searched once: of each different vector the k + 1 least vec_ids are kept, all that any
query can return, cut within each task before the shuffle. Equal queries are searched once likewise.

Distances are Euclidean, in double precision, on the original components. Vectors that are null, zero,
of another length than most, or hold null or non-finite components take no part; null vec_ids neither.
Ties go to the smaller vec_id; repeated rows (same vec_id and vector) count once; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

K = 10
SAMPLE = 32_768
SAMPLE_BYTES = 64 << 20
LIST_SIZE = 24
MOST_LISTS = 8_192
GROUP = 2_048
QUERIES = 1 << 16
COPIES = 2
BOUNDARY = 0.05
APART = 0.3
TARGET = 0.94
HELD_OUT = 0.2
ASKED = 256
NEIGHBOURS = 16
BEAM = 64
_PRICE = 0.15


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None], 0)


def _nearest(points: np.ndarray, centres: np.ndarray, price: np.ndarray) -> np.ndarray:
    return np.concatenate([(squared(points[k : k + 2048], centres) + price).argmin(1) for k in range(0, len(points), 2048)])


def _leaves(points: np.ndarray, rows: np.ndarray, n: int) -> list[np.ndarray]:
    """`rows` cut into n leaves of equal size, neighbouring ones one after the other."""
    if n <= 1 or len(rows) < 2:
        return [rows]
    some = points[rows]
    off = some - some.mean(0)
    direction = off[int((off * off).sum(1).argmax())]
    for _ in range(4):
        direction = off.T @ (off @ direction)
        direction /= max(float(np.linalg.norm(direction)), 1e-300)
    order = rows[np.argsort(off @ direction, kind="stable")]
    cut = len(rows) * (n // 2) // n
    return _leaves(points, order[:cut], n // 2) + _leaves(points, order[cut:], n - n // 2)


def balanced_lists(sample: np.ndarray, n: int, rounds: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of n lists of about equal size, and the price in squared distance that each takes."""
    leaves = [x for x in _leaves(sample, np.arange(len(sample)), max(1, min(n, len(sample)))) if len(x)]
    centres = np.stack([sample[x].mean(0) for x in leaves])
    price, mean = np.zeros(len(centres)), len(sample) / len(centres)
    spread = float(np.mean([squared(sample[x], c[None]).mean() for x, c in zip(leaves, centres, strict=True)]))
    for _ in range(rounds):
        nearest = _nearest(sample, centres, price)
        counts = np.bincount(nearest, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        full = counts > 0
        centres[full] = sums[full] / counts[full, None]
        price = np.maximum(0.0, price + _PRICE * spread * np.clip(counts / mean - 1, -1, 1))
    return centres, price


class CentroidGraph:
    """Centroids, each linked to its nearest ones and to one before it, so that all are connected."""

    def __init__(self, centres: np.ndarray, price: np.ndarray | None = None):
        self.centres, self.price = centres, np.zeros(len(centres)) if price is None else price
        n, few = len(centres), min(NEIGHBOURS, len(centres) - 1)
        links: list[set[int]] = [{i // 2} if i else set() for i in range(n)]
        for at in range(0, n, 1024):
            d = squared(centres[at : at + 1024], centres)
            d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
            if few:
                for i, near in enumerate(np.argpartition(d, few - 1, axis=1)[:, :few].tolist(), at):
                    links[i].update(near)
        for i in range(n):
            for j in list(links[i]):
                links[j].add(i)
        self.links = [np.array(sorted(x - {i}), int) for i, x in enumerate(links)]

    def distances(self, points: np.ndarray) -> np.ndarray:
        return np.sqrt(squared(points, self.centres))

    def search(self, q: np.ndarray, prune: float, usual: float = 0.0, sizes: np.ndarray | None = None, need: int = 1, beam: int = BEAM) -> list[int]:
        """Lists within (1 + prune) times the distance of the nearest one (or `usual`), and more until `need` vectors."""
        seen = np.zeros(len(self.centres), bool)
        seen[0] = True
        front = [(float(np.sqrt(((self.centres[0] - q) ** 2).sum())), 0)]
        found: list[tuple[float, int]] = []
        best, held = np.inf, 0
        while front:
            d, i = heapq.heappop(front)
            best = min(best, d)
            if len(found) >= beam and held >= need and d > (1 + prune) * max(best, usual):
                break
            found.append((d, i))
            held += 1 if sizes is None else int(sizes[i])
            fresh = self.links[i][~seen[self.links[i]]]
            if len(fresh):
                seen[fresh] = True
                for x, j in zip(np.sqrt(((self.centres[fresh] - q) ** 2).sum(1)).tolist(), fresh.tolist(), strict=True):
                    heapq.heappush(front, (x, j))
        found.sort()
        limit, out, held = (1 + prune) * max(best, usual), [], 0
        for d, i in found:
            if d > limit and held >= need:
                break
            out.append(i)
            held += 1 if sizes is None else int(sizes[i])
        return out


def assign(vectors: np.ndarray, graph: CentroidGraph, boundary: float = BOUNDARY, copies: int = COPIES) -> list[list[int]]:
    """The lists of each vector, its own first."""
    out: list[list[int]] = []
    few = min(4 * copies, len(graph.centres))
    for at in range(0, len(vectors), 2048):
        d = np.sqrt(squared(vectors[at : at + 2048], graph.centres) + graph.price)
        near = np.argpartition(d, few - 1, axis=1)[:, :few]
        for row, ids in zip(d, near, strict=True):
            ids = ids[np.argsort(row[ids], kind="stable")]
            limit, chosen = (1 + boundary) * row[ids[0]], [int(ids[0])]
            for j in ids[1:]:
                if row[j] > limit or len(chosen) == copies:
                    break
                apart = ((graph.centres[j] - graph.centres[chosen]) ** 2).sum(1)
                if (apart >= (APART * row[j]) ** 2).all():
                    chosen.append(int(j))
            out.append(chosen)
    return out


def fitted_prune(graph: CentroidGraph, held: np.ndarray, total: int, k: int = K, target: float = TARGET) -> tuple[float, float]:
    """The ratio that reaches a neighbour with a chance of `target`, and the usual distance of the nearest list.

    `held` is a sample of the `total` vectors that had no part in the lists. Its nearest neighbours among itself
    are at the distance of the k-th among all, or farther, so the ratio is not too small for the table."""
    asked = held[:ASKED]
    if len(held) < 2:
        return 1.0, 0.0
    away = graph.distances(asked)
    nearest = away.min(1)
    usual = float(np.median(nearest))
    d = squared(asked, held)
    d[np.arange(len(asked)), np.arange(len(asked))] = np.inf
    count = max(1, min(len(held) - 1, round(k * len(held) / total)))
    near = np.argpartition(d, count - 1, axis=1)[:, :count]
    lists = assign(held, graph)
    ratios = [min(away[i, c] for c in lists[j]) / max(nearest[i], usual, 1e-300) - 1 for i in range(len(asked)) for j in near[i]]
    return max(0.0, float(np.quantile(ratios, target))), usual


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id, v (array of doubles) of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.coalesce(finite, F.lit(False))).where(F.exists("v", lambda x: x != 0))
    size = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("n")).first()
    return rows.where(F.size("v") == (size[0] if size else 0))


def _groups(graph: CentroidGraph, total: int, group: int = GROUP) -> np.ndarray:
    """The group of each list; lists are in the order of the leaves, so neighbouring ones stay together."""
    n = len(graph.centres)
    return np.arange(n) // max(1, round(n * group / max(1, total)))



def _meeting(k: int):
    """Rows in order of group, part and kind: the vectors of a group are held, its queries stream past."""

    def run(batches):
        key, held, done = None, [], None
        for batch in batches:
            columns = [batch.column(n) for n in ("g", "part", "kind", "id", "v", "ids", "lists")]
            g, part, kind, ids = (c.to_numpy() for c in columns[:4])
            width = len(columns[4][0]) if batch.num_rows else 0
            points = columns[4].flatten().to_numpy().reshape(batch.num_rows, width)
            names, lists = columns[5].to_pylist(), columns[6].to_pylist()
            found: list[tuple[int, float, int]] = []
            for row in range(batch.num_rows):
                if (g[row], part[row]) != key:
                    key, held, done = (g[row], part[row]), [], None
                if kind[row] == 0:
                    held.append((lists[row][0], points[row].copy(), names[row]))
                    continue
                if done is None:
                    held.sort(key=lambda x: x[0])
                    where = np.array([x[0] for x in held], int)
                    done = where, np.stack([x[1] for x in held]) if held else np.zeros((0, width)), [x[2] for x in held], np.array([x[2][0] for x in held], np.int64)
                where, vectors, owners, names_of = done
                chosen = np.array(lists[row])
                begin, end = np.searchsorted(where, chosen), np.searchsorted(where, chosen, "right")
                use = np.concatenate([np.arange(a, b) for a, b in zip(begin, end, strict=True)])
                if len(use):
                    use = use[np.unique(names_of[use], return_index=True)[1]]  # a vector that stands in two of the lists
                    found += [(int(ids[row]), x, i) for x, i in _top(points[row], vectors[use], [owners[j] for j in use], k)]
            if found:
                q, score, vec = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(score, pa.float64()), pa.array(vec, pa.int64())], ["q", "score", "vec_id"])

    return run


def _top(q: np.ndarray, v: np.ndarray, ids: list, k: int):
    """The k best (distance, vec_id) of one query among the vectors with their id lists."""
    d = np.sqrt(((v - q) ** 2).sum(1))
    limit = np.partition(d, k - 1)[k - 1] if len(d) > k else np.inf
    near = np.flatnonzero(d <= limit)
    return sorted((float(d[j]), int(i)) for j in near for i in ids[j])[:k]


def build(unique: DataFrame, total: int, dims: int, k: int = K, prune: float | None = None, list_size: int = LIST_SIZE) -> tuple[CentroidGraph, float, float]:
    """The lists' graph, the ratio and the usual distance, from a bounded sample of the different vectors (column v)."""
    size = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * dims)))
    sample = np.array([r[0] for r in unique.orderBy(F.xxhash64("v"), "v").limit(size).select("v").collect()])
    held = int(len(sample) * HELD_OUT)
    graph = CentroidGraph(*balanced_lists(sample[held:], max(1, min(MOST_LISTS, round(total / list_size)))))
    fitted, usual = fitted_prune(graph, sample[:held], total, k)
    return graph, fitted if prune is None else prune, usual


def search(vectors: DataFrame, is_query, k: int = K, prune: float | None = None, list_size: int = LIST_SIZE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row for which `is_query` (a column) holds. The
    ratio `prune` is fitted where none is given."""
    spark = vectors.sparkSession
    rows = materialize(usable(vectors), "ann-rows")
    by_vector = Window.partitionBy("v").orderBy("vec_id")
    least = rows.distinct().withColumn("n", F.row_number().over(by_vector)).where(F.col("n") <= k + 1)
    unique = materialize(least.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "ann-unique")
    asked = materialize(rows.where(is_query).distinct(), "ann-asked")
    queries = asked.groupBy("v").agg(F.min("vec_id").alias("q"))

    total, dims = unique.agg(F.count("*"), F.max(F.size("v"))).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], schema)
    graph, prune, usual = build(unique, total, dims, k, prune, list_size)
    groups = _groups(graph, total)
    shared = spark.sparkContext.broadcast((graph, groups))  # MOST_LISTS centroids at most

    def post(batches):
        for batch in batches:
            graph, groups = shared.value
            if not batch.num_rows:
                continue
            lists = assign(np.array(batch.column("v").to_pylist()), graph)
            which = pa.array(np.repeat(np.arange(len(lists)), [len(x) for x in lists]))
            flat = np.concatenate([np.array(x) for x in lists])
            own = pa.array(np.concatenate([np.arange(len(x)) == 0 for x in lists]))
            yield pa.RecordBatch.from_arrays([pa.array(groups[flat].astype(np.int32)), pa.array(flat.astype(np.int32)), own, batch.column("v").take(which), batch.column("ids").take(which)], ["g", "list", "own", "v", "ids"])

    postings = materialize(unique.select("v", "ids").mapInArrow(post, "g int, list int, own boolean, v array<double>, ids array<long>"), "ann-postings")
    sizes = np.zeros(len(graph.centres), np.int64)
    for i, n in postings.where("own").groupBy("list").agg(F.count("*")).collect():  # MOST_LISTS rows at most
        sizes[i] = n

    def route(batches):
        for batch in batches:
            graph, groups = shared.value
            out: list[list] = [[], [], []]
            for row, v in enumerate(batch.column("v").to_pylist()):
                lists = np.array(sorted(graph.search(np.asarray(v), prune, usual, sizes, k + 1)))
                for g in np.unique(groups[lists]).tolist():
                    for column, x in zip(out, (g, row, lists[groups[lists] == g].tolist()), strict=True):
                        column.append(x)
            which = pa.array(out[1], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), batch.column("q").take(which), batch.column("v").take(which), pa.array(out[2], pa.list_(pa.int32()))], ["g", "q", "v", "lists"])

    routed = materialize(queries.select("v", "q").mapInArrow(route, "g int, q long, v array<double>, lists array<int>"), "ann-routed")
    parts = dict(routed.groupBy("g").agg(F.ceil(F.count("*") / QUERIES).cast("int")).collect())  # a row a group
    lookup = F.element_at(F.array(*[F.lit(parts.get(g, 1)) for g in range(int(groups[-1]) + 1)]), F.col("g") + 1)
    held = postings.select("g", F.explode(F.sequence(F.lit(0), lookup - 1)).alias("part"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("id"), "v", "ids", F.array("list").alias("lists"))
    coming = routed.select("g", F.pmod(F.xxhash64("q"), lookup).cast("int").alias("part"), F.lit(1).alias("kind"), F.col("q").alias("id"), "v", F.lit(None).cast("array<long>").alias("ids"), "lists")
    met = held.unionByName(coming).repartition("g", "part").sortWithinPartitions("g", "part", "kind").mapInArrow(_meeting(k + 1), "q long, score double, vec_id long")
    once = met.groupBy("q", "vec_id").agg(F.min("score").alias("score"))
    ranked = once.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id"))).where(F.col("n") <= k + 1)
    best = materialize(ranked.join(queries, "q").select("v", "vec_id", "score"), "ann-best")
    # an equal query's own row may be absent from the k + 1 kept, so k remain for every one without itself
    mine = asked.withColumnRenamed("vec_id", "query_id").join(best, "v").where("query_id <> vec_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return mine.select("query_id", place.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
