"""Ordinal quality classifier: cumulative-link regression on graded ratings over hashed text.

Grades 0 < 1 < 2: P(grade > k) = sigmoid(score - threshold_k) with one weight vector for all grades and
ordered thresholds. Features are the hashed different words of a text and their hashed beginnings, and
buckets of its shape (share of marks, of capitals, of repeated words, of table bars, mean word length,
size). The fit uses a bounded sample of labelled rows (`SAMPLE` documents, the first in hash order of
their ids, at most); features in fewer than `MIN_DOCS` of them, or whose documents' mean grade is within
`SCREEN` standard errors of the overall mean (in a full sample), get no weight. Scoring reads every document.

`graded` makes grades of the labels: low quality 0, toxic 1, else 2. A document is selected where
P(grade > 1) is at least `KEEP`.

Defined cases: null and empty texts have shape features only; documents rated twice count with the lower
grade; labels with a null rating are left out; with no labelled documents every score is 0 and every
document is selected; an empty table gives an empty result; repeated rows score alike.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_arrow
from .decontam import words_of

SAMPLE = 10_000
MIN_DOCS = 8
HASH_BITS = 20
KEEP = 0.65
SCREEN = 7.5
STEM = 4
PENALTY = 1e-5
STEPS = 400
_UPPER = bytes(range(65, 91))
_SPACES = b" \t\n\r\x0b\x0c"
_PLAIN = bytes(c for c in range(256) if c >= 128 or chr(c).isalnum()) + _SPACES + b".,;:'\"!?()-"
_SHAPES = 1 << 10


def _bucket(share: float) -> int:
    return 0 if share <= 0 else min(11, 1 + int(share * 100) if share < 0.03 else 4 + int(share * 8))


def features(text: str | None, bits: int = HASH_BITS) -> set[int]:
    """Hash buckets of the different words, after the codes of the shape buckets below `_SHAPES`."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = words_of(text)
    different = set(words)
    n, size = max(1, len(words)), max(1, len(raw) - sum(map(raw.count, (b" ", b"\n"))))
    shares = (
        len(raw.translate(None, _PLAIN)) / size,
        raw.count(b"!") / size,
        raw.count(b"|") / n,
        (len(raw) - len(raw.translate(None, _UPPER))) / size,
        1 - len(different) / n if n >= 20 else 0.0,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
    )
    shapes = {16 * k + _bucket(x) for k, x in enumerate(shares)}
    shapes.add(16 * 6 + min(15, len(words).bit_length()))
    shapes.add(16 * 7 + min(15, size // n))
    mask = (1 << bits) - 1
    stems = {w[:STEM] for w in different}
    return shapes | {_SHAPES + (zlib.crc32(w) & mask) for w in different} | {_SHAPES + (zlib.crc32(w, 1) & mask) for w in stems}


def graded(labels: DataFrame) -> DataFrame:
    """doc_id, grade: 0 for low quality, 1 for toxic, 2 for the rest; the least of several."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade.alias("grade"))
    return rows.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))


class OrdinalModel:
    """weights: feature -> weight; thresholds in ascending order."""

    def __init__(self, weights: dict[int, float], thresholds: tuple[float, float]):
        self.weights, self.thresholds = weights, thresholds

    def score(self, found: set[int]) -> float:
        return sum(map(self.weights.__getitem__, found & self.weights.keys()))


def fit(rows: list[tuple[int, np.ndarray]], penalty: float = PENALTY, steps: int = STEPS, min_docs: int = MIN_DOCS, screen: float = SCREEN) -> OrdinalModel:
    """Full-batch Adam on the mean negative log-likelihood plus penalty * |weights|^2."""
    if not rows:
        return OrdinalModel({}, (-1.0, -1.0))
    grades = np.array([g for g, _ in rows])
    sizes = np.array([len(f) for _, f in rows])
    known, codes, counts = np.unique(np.concatenate([f for _, f in rows]), return_inverse=True, return_counts=True)
    docs = np.repeat(np.arange(len(rows)), sizes)
    mean, spread = grades.mean(), max(grades.std(), 1e-9)
    off = np.abs(np.bincount(codes, grades[docs], len(known)) / counts - mean) * np.sqrt(counts) / spread
    screen = max(4.0, screen * min(1.0, len(rows) / SAMPLE) ** 0.5)  # the same effect shows less in fewer rows
    kept = (counts >= min(min_docs, max(1, len(rows) // 20))) & (counts < len(rows)) & (off >= screen)
    known, place = known[kept], np.cumsum(kept) - 1
    use = kept[codes]
    docs, codes = docs[use], place[codes[use]]
    share = np.array([np.mean(grades > k) for k in (0, 1)])
    logits = np.log(np.clip(share, 1e-3, 1 - 1e-3) / np.clip(1 - share, 1e-3, 1))
    # parameters: weights, the first threshold, the log of the gap to the second
    at = np.concatenate([np.zeros(len(known)), [-logits[0], np.log(max(0.05, logits[0] - logits[1]))]])
    m, v = np.zeros_like(at), np.zeros_like(at)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    for step in range(1, steps + 1):
        score = np.bincount(docs, at[:-2][codes], len(rows))
        low, gap = at[-2], np.exp(at[-1])
        p0, p1 = sigmoid(score - low), sigmoid(score - low - gap)
        middle = np.maximum(p0 - p1, 1e-9)
        d0 = np.where(grades == 0, -p0, np.where(grades == 1, p0 * (1 - p0) / middle, 0.0))
        d1 = np.where(grades == 2, 1 - p1, np.where(grades == 1, -p1 * (1 - p1) / middle, 0.0))
        slope = -(d0 + d1) / len(rows)
        gradient = np.concatenate([np.bincount(codes, slope[docs], len(known)) + 2 * penalty * at[:-2], [-slope.sum(), np.mean(d1) * gap]])
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        at -= 0.08 * (1 - 0.9 * step / steps) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return OrdinalModel(dict(zip(known.tolist(), at[:-2].tolist(), strict=True)), (float(at[-2]), float(at[-2] + np.exp(at[-1]))))


def train(docs: DataFrame, grades: DataFrame, sample: int = SAMPLE, **options) -> OrdinalModel:
    """Fit on at most `sample` labelled documents, the first in hash order of their ids (then grade)."""
    chosen = grades.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches):
        for batch in batches:
            found = [np.fromiter(features(t), np.int32) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "grade", "features"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rated = texts.join(F.broadcast(chosen), "doc_id")  # `sample` pairs of numbers at most
    # repeated documents of one id: one of them, so that no more than `sample` rows reach the driver
    one = rated.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("grade").alias("grade"))
    rows = in_arrow(one, run, "doc_id long, grade int, features array<int>").toArrow().sort_by([("doc_id", "ascending")])
    return fit([(g, np.sort(f)) for g, f in zip(rows["grade"].to_pylist(), (np.array(x.as_py(), np.int64) for x in rows["features"]), strict=True)], **options)


RESULTS = ("expected_grade", "p_ge1", "p_ge2", "selected")


def _chances(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """row (all columns of `docs`), p1, p2: the chances of a grade over 0 and over 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").cast("string").alias("text"))
    schema = T.StructType([packed.schema["row"], *[T.StructField(c, T.DoubleType()) for c in ("p1", "p2")]])

    def run(batches):
        from math import exp

        model = shared.value
        low, high = model.thresholds
        for batch in batches:
            scores = [model.score(features(t)) for t in batch.column(1).to_pylist()]
            chances = [pa.array([1 / (1 + exp(-max(-40.0, min(40.0, s - t)))) for s in scores], pa.float64()) for t in (low, high)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *chances], names=schema.names)

    return in_arrow(packed, run, schema)


def score(docs: DataFrame, model: OrdinalModel, keep: float = KEEP) -> DataFrame:
    """The columns of `docs` but those named as in RESULTS, followed by RESULTS."""
    columns = [c for c in docs.columns if c not in RESULTS]
    p1, p2 = F.round("p1", 6), F.round("p2", 6)
    return _chances(docs.select(*columns), model).select("row.*", F.round(F.col("p1") + F.col("p2"), 6).alias("expected_grade"), p1.alias("p_ge1"), p2.alias("p_ge2"), (p2 >= keep).alias("selected"))


def select_quality(docs: DataFrame, labels: DataFrame, keep: float = KEEP, sample: int = SAMPLE) -> DataFrame:
    """The rows of `docs` that the classifier selects, in the columns of `docs`."""
    model = train(docs, graded(labels), sample)
    return _chances(docs, model).where(F.round("p2", 6) >= keep).select("row.*")
