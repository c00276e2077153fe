"""Line deduplication by winnowing over line hashes.

A run is a stretch of consecutive lines of one document; two runs are equal if their lines are (white
space collapsed). A line is deleted if it lies in a run of at least `min_words` words that also occurs
earlier: in a document with a smaller doc_id, or further up in the same one. The first occurrence stays.
With `inside_lines` a run may also begin and end inside a line: every word goes that lies in `min_words`
consecutive words (across line ends) that occur earlier, and a line of which all words go is deleted.

Winnowing: every minimal stretch of whole lines with at least `min_words` words is a window, and the least line
hash in it is selected as its fingerprint; one position is a fingerprint for all windows around it. Inside
lines, the units are grams of GRAM words, a window is `min_words` words, and the least gram hash in it is
selected. So any two occurrences of a run select a fingerprint in common. Only the selected positions are written,
each with the words it reaches both ways (the windows it was selected for are one stretch) and a hash of that
reach. Positions are joined by fingerprint and reach with the earliest one: all later ones are repeated over their whole
reach, and matches that follow one another make up the maximal run. Where positions of one
fingerprint reach differently, at the ends of runs, the earliest of each kind of reach gives up its single
windows, and these are joined by content. So the result is exact, no pairs are formed, and a
fingerprint that very many documents share costs one row an occurrence.

Defined cases: null texts stay null and empty ones empty; lines without words belong to no run, and are
deleted along with the line before them; rows with the same doc_id and text are one document and get the
same result, rows with the same doc_id and other text are ordered by a hash of it; documents with a null
doc_id count as earliest; an empty table gives an empty result; other columns stay as they are, whatever they are called.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, in_arrow, internal, materialize

MIN_WORDS = 50
GRAM = 8
_SLAB = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_BYTES_AT_ONCE = 1 << 16
_TEXTS_AT_ONCE = 1 << 20


def _finished(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


#: Word hashes: a random number for each byte value, summed with powers of the base.
_BYTE = np.random.default_rng(_BASE).integers(0, 1 << 64, 256, np.uint64)
_BLANK = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
_INVERSE = pow(_BASE, -1, 1 << 64)


def _power_table(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.multiply.accumulate(steps)


_POWERS = {base: _power_table(base, 1 << 18) for base in (_BASE, _INVERSE)}


def _powers(base: int, n: int) -> np.ndarray:
    """The first n powers of `base`, modulo 2^64."""
    held = _POWERS[base]
    return held[:n] if n <= len(held) else _power_table(base, n)


def _summed(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """For each stretch of `values` from first to last (exclusive) a hash of what stands in it."""
    before = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * _powers(_BASE, len(values)))])
    return (before[last] - before[first]) * _powers(_INVERSE, len(values) + 1)[first]


class Tokens:
    """The words of some texts, parted by ASCII white space, numbered through all of them: their hashes, and with
    which word each text begins (and the last one ends). Of the lines that have words: the number, the word they
    begin with (and the end), and their hashes."""

    def __init__(self, texts: list[bytes | None]):
        texts = [x or b"" for x in texts]
        data = b"\n".join(texts)
        raw = np.frombuffer(data, np.uint8)
        edges = np.diff(np.concatenate([[True], _BLANK[raw], [True]]).view(np.int8))
        start, end = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
        self.begins = np.append(np.searchsorted(start, np.cumsum([0, *(len(x) + 1 for x in texts[:-1])])), len(start))
        parts, at = [], 0
        while at < len(start):
            to = int(np.searchsorted(end, start[at] + _BYTES_AT_ONCE, "right"))
            if to <= at:  # one word longer than that
                parts.append(np.array([xxhash.xxh64_intdigest(data[start[at] : end[at]])], np.uint64))
                at += 1
                continue
            low = start[at]
            parts.append(_summed(_BYTE[raw[low : end[to - 1]]], start[at:to] - low, end[at:to] - low))
            at = to
        self.words = _finished(np.concatenate([np.zeros(0, np.uint64), *parts]))
        ends = np.concatenate([[0], np.searchsorted(start, np.flatnonzero(raw == 10)), [len(start)]])
        self.line = np.flatnonzero(np.diff(ends))
        self.begin = np.append(ends[self.line], len(start))
        counts = np.diff(self.begin).astype(np.uint64)
        self.lines = _finished(_summed(self.words, self.begin[:-1], self.begin[1:]) + counts * np.uint64(_BASE))

    def owner(self, word: np.ndarray) -> np.ndarray:
        """The text that each word stands in."""
        return np.searchsorted(self.begins, word, "right") - 1


def tokens(text: str | None) -> Tokens:
    """Of one text."""
    return Tokens([(text or "").encode("utf-8", "surrogatepass")])


def lines_of(text: str | None) -> list[tuple[int, int, int]]:
    """(line number, words, hash) of the lines that have words."""
    t = tokens(text)
    return list(zip(t.line.tolist(), np.diff(t.begin).tolist(), t.lines.tolist(), strict=True))


def _stretches(begin: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last indices of the minimal stretches of at least `min_words` words, from and back from each line,
    of lines that begin with the words `begin`."""
    n = len(begin) - 1
    ahead, back = np.flatnonzero(begin[:-1] + min_words <= begin[-1]), np.flatnonzero(begin[1:] >= min_words)
    first = np.concatenate([ahead, np.searchsorted(begin, begin[1:][back] - min_words, "right") - 1])
    last = np.concatenate([np.searchsorted(begin, begin[ahead] + min_words) - 1, back])
    return np.divmod(np.unique(first * n + last), max(n, 1))


def windows_of(lines: list[tuple[int, int, int]], min_words: int = MIN_WORDS) -> set[tuple[int, int]]:
    """(first, last) indices of the minimal stretches of at least `min_words` words, from and back from each line."""
    first, last = _stretches(np.cumsum([0, *(n for _, n, _ in lines)]), min_words)
    return set(zip(first.tolist(), last.tolist(), strict=True))


class Windows:
    """The windows of a text in word numbers: first, last (exclusive), content hash, and the fingerprint with its
    word number; in the order of the latter."""

    def __init__(self, first, last, content, fp, at):
        self.first, self.last, self.content, self.fp, self.at = first, last, content, fp, at


_PLACE = np.uint64((1 << 32) - 1)


def line_windows(t: Tokens, min_words: int = MIN_WORDS) -> Windows:
    """Windows of whole lines; the first of equal least hashes (by their upper bits) is selected."""
    a, b = _stretches(t.begin, min_words)
    inside = t.owner(t.begin[a]) == t.owner(t.begin[b + 1] - 1)
    a, b = a[inside], b[inside]
    if not len(a):
        return Windows(a, a, a.astype(np.uint64), a.astype(np.uint64), a)
    placed = np.append((t.lines & ~_PLACE) | np.arange(len(t.lines), dtype=np.uint64), ~np.uint64(0))
    k = (np.minimum.reduceat(placed, np.stack([a, b + 1], axis=1).ravel())[::2] & _PLACE).astype(np.int64)
    content = _finished(_summed(t.lines, a, b + 1) + (b - a).astype(np.uint64) * np.uint64(_BASE))
    order = np.lexsort((b, a, k))
    a, b, k = a[order], b[order], k[order]
    return Windows(t.begin[a], t.begin[b + 1], content[order], t.lines[k], t.begin[k])


def _rolled(words: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hashes of all stretches of n words, by doubling."""
    whole, done, power, size = None, 0, words, 1
    while True:
        if n & size:
            if whole is None:
                whole = power
            else:
                m = len(words) - done - size + 1
                whole = whole[:m] + np.uint64(pow(_BASE, done, 1 << 64)) * power[done : done + m]
            done += size
        size *= 2
        if size > n:
            return whole
        m = len(power) - size // 2
        power = power[:m] + np.uint64(pow(_BASE, size // 2, 1 << 64)) * power[size // 2 :]


def _minima(values: np.ndarray, width: int) -> np.ndarray:
    """For each stretch of `width` values the place of the least (by its upper bits), the first of equal ones."""
    place = np.uint64(2 * _SLAB - 1)
    least, size = (values & ~place) | np.arange(len(values), dtype=np.uint64), 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < width:
        least = np.minimum(least[: len(least) - width + size], least[width - size :])
    return (least & place).astype(np.int64)


def word_windows(t: Tokens, min_words: int = MIN_WORDS) -> Windows:
    """Windows of `min_words` words, wherever lines end; the first of equal least gram hashes is selected."""
    n, gram = len(t.words), min(GRAM, min_words)
    if n < min_words:
        none = np.zeros(0, np.int64)
        return Windows(none, none, none.astype(np.uint64), none.astype(np.uint64), none)
    grams, width = _finished(_rolled(t.words, gram)), min_words - gram + 1
    first = np.arange(n - min_words + 1)
    at = np.concatenate([k + _minima(grams[k : k + _SLAB + width - 1], width) for k in range(0, len(first), _SLAB)])
    inside = np.flatnonzero(t.owner(first) == t.owner(first + min_words - 1))
    first, at = first[inside], at[inside]
    return Windows(first, first + min_words, _finished(_rolled(t.words, min_words))[inside], grams[at], at)


_KINDS = (line_windows, word_windows)


def reaches(w: Windows, kind: int) -> tuple[np.ndarray, ...]:
    """Per selected position: word number, fingerprint, first and last of its reach, hash of the reach."""
    at, begin = np.unique(w.at, return_index=True)
    if not len(at):
        return at, w.fp, w.first, w.last, w.fp
    end = np.append(begin[1:], len(w.at)) - 1
    if kind:  # windows follow word by word and overlap, so the outer two tell them all
        return at, w.fp[begin], w.first[begin], w.last[end], _finished(w.content[begin] * np.uint64(3) + w.content[end] * np.uint64(_BASE) + (end - begin).astype(np.uint64))
    offsets = (w.first - w.at).astype(np.uint64) * np.uint64(_BASE) + (w.last - w.at).astype(np.uint64)
    whole = _finished(_summed(_finished(w.content ^ _finished(offsets)), begin, end + 1))
    return at, w.fp[begin], np.minimum.reduceat(w.first, begin), np.maximum.reduceat(w.last, begin), whole


def _parts(batch: pa.RecordBatch):
    """Slices of a batch whose texts, in column 2, come to about a megabyte; as Tokens with the slice."""
    texts = batch.column(2).cast(pa.binary()).to_pylist()
    begin = size = 0
    for k, text in enumerate(texts, 1):
        size += len(text or b"")
        if size >= _TEXTS_AT_ONCE or k == len(texts):
            yield Tokens(texts[begin:k]), batch.slice(begin, k - begin)
            begin, size = k, 0


def _table(t: Tokens, part: pa.RecordBatch, word: np.ndarray, columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    """doc_id and tie of the text that each word stands in, and `columns`."""
    owner = pa.array(t.owner(word))
    plain = [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64)) for c in columns]
    return pa.RecordBatch.from_arrays([part.column(0).take(owner), part.column(1).take(owner), *plain], names)


def _span(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Both word numbers as one long; a text has fewer than 2^31 words. Spans are ordered by `first`."""
    return (first.astype(np.int64) << 32) | last.astype(np.int64)


def _positions(texts: DataFrame, min_words: int, kinds: int) -> DataFrame:
    """doc_id, tie, at (twice the word number, plus the kind), fp, span, reach: the selected positions."""
    names = ["doc_id", "tie", "at", "fp", "span", "reach"]

    def run(batches):
        for batch in batches:
            for t, part in _parts(batch):
                for kind in range(kinds):
                    at, fp, first, last, reach = reaches(_KINDS[kind](t, min_words), kind)
                    base = t.begins[t.owner(at)]
                    yield _table(t, part, at, [2 * (at - base) + kind, fp, _span(first - base, last - base), reach], names)

    return in_arrow(texts, run, ", ".join(f"{n} long" for n in names))


def _windows(texts: DataFrame, min_words: int) -> DataFrame:
    """doc_id, tie, span, fp, content of the windows selected for the positions `chosen` of each text."""
    names = ["doc_id", "tie", "span", "fp", "content"]

    def run(batches):
        for batch in batches:
            for t, part in _parts(batch):
                chosen = part.column(3)
                base = np.repeat(t.begins[:-1], chosen.value_lengths().to_numpy())
                marks = chosen.flatten().to_numpy()
                for kind in (0, 1):
                    w = _KINDS[kind](t, min_words)
                    use = np.isin(w.at, (marks >> 1)[marks & 1 == kind] + base[marks & 1 == kind])
                    begin = t.begins[t.owner(w.at[use])]
                    yield _table(t, part, w.at[use], [_span(w.first[use] - begin, w.last[use] - begin), w.fp[use], w.content[use]], names)

    return in_arrow(texts, run, ", ".join(f"{n} long" for n in names))


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS, inside_lines: bool = False) -> DataFrame:
    """doc_id, tie (hash of the text), first, last: words of stretches that occur earlier, as numbers from 0, last exclusive."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("tie"), F.col("text").cast("string").alias("text"))
    positions = materialize(_positions(texts, min_words, 2 if inside_lines else 1), "lines-positions")
    # keys begin with the fingerprint, so that sorts compare one long
    twice = materialize(positions.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp"), "lines-twice")
    # both sides of the joins are written tables, shuffled plainly, so that a hot key can be split
    selected = materialize(positions.join(twice, "fp", "left_semi"), "lines-shared", release=True)
    discard(positions, twice)
    place = F.struct("doc_id", "tie", "at")
    found = selected.groupBy("fp", "reach").agg(F.min(place).alias("a"), F.max(place).alias("b"))
    classes = materialize(found.select("fp", "reach", "a", (F.col("a") < F.col("b")).alias("shared")), "lines-classes", release=True)
    later = selected.join(classes.where("shared").select("fp", "reach", "a"), ["fp", "reach"]).where(place > F.col("a")).select("doc_id", "tie", "span")
    later = materialize(later, "lines-later", release=True)
    discard(selected)
    several = materialize(classes.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp"), "lines-several")
    ends = classes.join(several, "fp", "left_semi").select(*_plain("a.doc_id", "a.tie"), F.col("a.at").alias("at"))
    chosen = materialize(ends.groupBy("d", "u", "t").agg(F.collect_set("at").alias("chosen")), "lines-chosen", release=True)  # a text's own positions
    discard(classes, several)
    once = texts.select("*", *_plain("doc_id", "tie")).join(chosen, ["d", "u", "t"])
    windows = materialize(_windows(once.select("doc_id", "tie", "text", "chosen"), min_words), "lines-windows", release=True)
    begin, key = F.struct("doc_id", "tie", "span"), ["fp", "content"]
    earliest = windows.groupBy(*key).agg(F.min(begin).alias("a"), F.max(begin).alias("b")).where("a <> b").select(*key, "a")
    earliest = materialize(earliest, "lines-earliest", release=True)
    again = materialize(windows.join(earliest, key).where(begin > F.col("a")).select("doc_id", "tie", "span"), "lines-again", release=True)
    discard(windows, earliest, chosen)
    return later.unionByName(again).select("doc_id", "tie", F.shiftright("span", 32).alias("first"), F.col("span").bitwiseAND(F.lit(0xFFFFFFFF)).alias("last"))


def _plain(doc_id: str, tie: str) -> list:
    """Join keys without nulls for a document: d, u (no doc_id), t."""
    return [F.coalesce(F.col(doc_id), F.lit(-1)).alias("d"), F.col(doc_id).isNull().alias("u"), F.col(tie).alias("t")]


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, inside_lines: bool = False) -> DataFrame:
    """The columns of `docs` with later repeated runs cut from text, then n_lines, n_deleted. n_chars, where
    present, follows the new text; columns named like the added ones give way."""
    docs = docs.select(*[c for c in docs.columns if c not in ("n_lines", "n_deleted")])
    k, runs, d, u, t = (internal(docs, x) for x in ("k", "runs", "d", "u", "t"))
    found = repeated_runs(docs, min_words, inside_lines).groupBy(F.coalesce("doc_id", F.lit(-1)).alias(d), F.col("doc_id").isNull().alias(u), F.col("tie").alias(t))
    found = found.agg(F.collect_set(F.array("first", "last")).alias(runs))
    keyed = docs.withColumn(t, F.xxhash64(F.col("text").cast("string"))).withColumn(u, F.col("doc_id").isNull()).withColumn(d, F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)))
    return _cut(keyed.join(found, [d, u, t], "left").select(*docs.columns, runs), docs.schema.fields)


def _cut(joined: DataFrame, fields: list) -> DataFrame:
    columns = [f.name for f in fields]
    at, size = columns.index("text"), columns.index("n_chars") if "n_chars" in columns else None
    schema = T.StructType([*fields, T.StructField("n_lines", T.LongType()), T.StructField("n_deleted", T.LongType())])

    def run(batches):
        for batch in batches:
            arrays = list(batch.columns[:-1])
            texts, counts, deleted = [], [], []
            sizes = arrays[size].to_pylist() if size is not None else None
            for k, (text, runs) in enumerate(zip(arrays[at].to_pylist(), batch.column(len(columns)).to_pylist(), strict=True)):
                kept, n, gone = without(text, runs or [])
                if sizes is not None and kept != text:
                    sizes[k] = len(kept)
                texts.append(kept)
                counts.append(n)
                deleted.append(gone)
            arrays[at] = pa.array(texts, arrays[at].type)
            if sizes is not None:
                arrays[size] = pa.array(sizes, arrays[size].type)
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(counts, pa.int64()), pa.array(deleted, pa.int64())], names=schema.names)

    return in_arrow(joined, run, schema)


def without(text: str | None, runs: list) -> tuple[str | None, int, int]:
    """The text without the words of `runs` (first, last); its lines; how many of them went whole."""
    if text is None:
        return None, 0, 0
    lines = text.split("\n")
    if not runs:
        return text, len(lines), 0
    # words are parted by ASCII white space, as the hashes have it
    raw = [line.encode("utf-8", "surrogatepass") for line in lines]
    counts = [len(x.split()) for x in raw]
    change = np.zeros(sum(counts) + 1, np.int64)
    for a, b in runs:
        change[a] += 1
        change[b] -= 1
    gone = np.cumsum(change) > 0
    kept, before, begin = [], False, 0
    for line, data, n in zip(lines, raw, counts, strict=True):
        lost = gone[begin : begin + n]
        begin += n
        if n:
            before = bool(lost.all())
        if before:
            continue
        kept.append(_shortened(data, lost) if n and lost.any() else line)
    return "\n".join(kept), len(lines), len(lines) - len(kept)


_BYTES = re.compile(rb"[^ \t\n\r\x0b\x0c]+")


def _shortened(line: bytes, lost: np.ndarray) -> str:
    """The line without its lost words and the white space behind each."""
    parts, begin = [], 0
    spans = [m.span() for m in _BYTES.finditer(line)]
    for k, (a, _) in enumerate(spans):
        if lost[k]:
            parts.append(line[begin:a])
            begin = spans[k + 1][0] if k + 1 < len(spans) else len(line)
    parts.append(line[begin:])
    return b"".join(parts).rstrip().decode("utf-8", "surrogatepass")
