"""Benchmark decontamination with a generalised suffix automaton over item words.

Items are dealt into shards of about `SHARD_WORDS` words. The driver holds one shard's items at a time, builds its
automaton, and keeps it as flat arrays of 32-bit numbers (some 60 bytes a word). `PASS_WORDS` words at most are broadcast
at once; the documents pass a larger benchmark's parts one after the other, each pass is written to the shared
folder, and its broadcast is destroyed. So the memory has a fixed bound, and a benchmark of up to `PASS_WORDS`
words costs one pass.
Document words are streamed through it and the length of the longest suffix that occurs in any item is
tracked. Where it reaches `window` words (or the whole of a shorter item) the words of that occurrence
are hit. Words that no item has reset the automaton, so only runs of benchmark words take its steps.

`contamination` gives per document the hit words and the items; `decontaminate` removes the hit spans
and drops documents of which at least `max_coverage` of the words are hit.

Defined cases: null or wordless texts have no words and no hits; items without words never occur;
repeated items count by item_id, repeated documents are each judged alone; an empty benchmark hits
nothing; clashing extra columns of either table are ignored (`contamination`) or kept (`decontaminate`).
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_arrow, internal, materialize

WINDOW = 10
MAX_COVERAGE = 0.5
SHARD_WORDS = 200_000
PASS_WORDS = 2_000_000
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
#: ASCII letters in lower case, digits and all bytes of other characters stay; every other byte parts words.
_BYTES = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in bytes(range(256)).lower())


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_BYTES).split()


class _Builder:
    """Generalised suffix automaton of word sequences while it grows."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = array("i", [-1]), array("i", [0])

    def add(self, codes: list[int]) -> None:
        last = 0
        for c in codes:
            last = self._extend(last, c)

    def _extend(self, last: int, c: int) -> int:
        if (q := self.next[last].get(c)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, c, q)
        new, p = self._new(self.length[last] + 1, {}), last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p == -1:
            self.link[new] = 0
        else:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        return new

    def _new(self, length: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(0)
        return len(self.link) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        new = self._new(self.length[p] + 1, dict(self.next[q]))
        self.link[new] = self.link[q]
        self.link[q] = new
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def holding(self, state: int, n: int) -> int:
        """The state that holds the last n words of what leads to `state`."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state


class Automaton:
    """A generalised suffix automaton in flat arrays, with what a match in each state completes.

    The edges of state s are codes[k], targets[k] for k from edges[s] to edges[s + 1], in order of the code. What
    it completes is sizes[k], items[k] for k from own[s] to own[s + 1]: a match of sizes[k] or more words that
    ends in s completes a window (or a whole short item) of that item. nearest[s] is the first state on the way
    from s along the suffix links that completes anything, or 0.
    """

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int = WINDOW):
        self.ids: dict[bytes, int] = {}
        grown = _Builder()
        for _, words in items:
            grown.add([self.ids.setdefault(w, len(self.ids)) for w in words])
        ends: set[tuple[int, int, int]] = set()
        for item, words in items:
            state, size = 0, min(window, len(words))
            for n, w in enumerate(words, 1):
                state = grown.next[state][self.ids[w]]
                if n >= size:
                    ends.add((grown.holding(state, size), size, item))
        states = len(grown.link)
        self.link, self.length = grown.link, grown.length
        self.edges, self.codes, self.targets = array("i", [0]), array("i"), array("i")
        for s in range(states):
            found = sorted(grown.next[s].items())
            self.codes.extend(c for c, _ in found)
            self.targets.extend(t for _, t in found)
            self.edges.append(len(self.codes))
            grown.next[s] = None
        done = sorted(ends)
        self.sizes, self.items = array("i", (n for _, n, _ in done)), array("q", (x for _, _, x in done))
        self.own = array("i", [0]) * (states + 1)
        for s, _, _ in done:
            self.own[s + 1] += 1
        for s in range(states):
            self.own[s + 1] += self.own[s]
        self.nearest = array("i", [0]) * states
        for s in sorted(range(1, states), key=self.length.__getitem__):
            self.nearest[s] = s if self.own[s] < self.own[s + 1] else self.nearest[self.link[s]]
        self.least = min(self.sizes, default=window)

    def bytes(self) -> int:
        """Size of the arrays."""
        return sum(len(x) * x.itemsize for x in vars(self).values() if isinstance(x, array))

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged spans [first, last) of hit words, and the items that have a hit."""
        link, length, edges, codes, targets, nearest, own = self.link, self.length, self.edges, self.codes, self.targets, self.nearest, self.own
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        state = n = 0
        for at, c in enumerate(map(self.ids.get, words)):
            if c is None:
                state = n = 0
                continue
            while True:
                last = edges[state + 1]
                k = bisect_left(codes, c, edges[state], last)
                if k < last and codes[k] == c:
                    state, n = targets[k], n + 1
                    break
                if not state:
                    break
                state = link[state]
                n = length[state]
            if n < self.least:
                continue
            most, s = 0, nearest[state]
            while s:
                for k in range(own[s], own[s + 1]):
                    if self.sizes[k] <= n:
                        most = max(most, self.sizes[k])
                        items.add(self.items[k])
                s = nearest[link[s]]
            if most:
                first = at + 1 - most
                while spans and spans[-1][1] >= first:
                    first = min(first, spans.pop()[0])
                spans.append((first, at + 1))
        return spans, items


def _passes(benchmark: DataFrame, window: int, shard_words: int, pass_words: int):
    """Lists of automata of at most about `pass_words` words; the items of one shard at a time come to the driver."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text.alias("text")).where("item_id is not null")
    spaces = F.length(F.regexp_replace("text", "[A-Za-z0-9]+", "")) + 1  # words, or more
    total = rows.agg(F.sum(spaces)).first()[0] or 0
    n = max(1, -(-total // shard_words))
    held: list[Automaton] = []
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        found = [(r.item_id, words_of(r.text)) for r in part.toLocalIterator()]
        if items := sorted((x for x in found if x[1]), key=lambda x: (x[0], x[1])):
            held.append(Automaton(items, window))
        if held and (len(held) + 1) * shard_words > pass_words:
            yield held
            held = []
    if held:
        yield held


def _scans(docs: DataFrame, benchmark: DataFrame, window: int, finish=None) -> tuple[DataFrame, str, str, str]:
    """The columns of `docs`, and under names of their own: the number of words, the hit spans, the items. `finish` turns
    such batches into rows like those of `docs` in the last pass itself, so that a task has one Python worker, not two."""
    spark = docs.sparkSession
    columns = docs.columns
    added = size, spans, items = [internal(docs, x) for x in ("words", "spans", "items")]
    pair = T.ArrayType(T.IntegerType())
    schema = T.StructType([*docs.schema.fields, T.StructField(size, T.LongType()), T.StructField(spans, T.ArrayType(pair)), T.StructField(items, T.ArrayType(T.LongType()))])
    none = lambda kind: F.lit(None).cast(kind)
    found = docs.select(*columns, F.lit(0).cast("long").alias(size), none(schema[spans].dataType).alias(spans), none(schema[items].dataType).alias(items))

    def scanner(shared, finish=None):
        at = columns.index("text")

        def run(batches):
            for batch in batches:
                automata = shared.value if shared else ()
                out: list[list] = [[], [], []]
                known = zip(*(batch.column(len(columns) + k).to_pylist() for k in (1, 2)), strict=True)
                for text, (s, f) in zip(batch.column(at).cast(pa.string()).to_pylist(), known, strict=True):
                    words = words_of(text)
                    s, f = [tuple(x) for x in s or ()], set(f or ())
                    for a in automata:
                        more, has = a.scan(words)
                        s, f = merged(s + more) if s else more, f | has
                    for column, x in zip(out, (len(words), s, sorted(f)), strict=True):
                        column.append(x)
                arrays = [pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.list_(pa.list_(pa.int32())), pa.list_(pa.int64())), strict=True)]
                scanned = pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], *arrays], names=schema.names)
                yield finish(scanned) if finish else scanned

        return run

    shared = None
    for automata in _passes(benchmark, window, SHARD_WORDS, PASS_WORDS):
        if shared:  # another pass: what the last one found is written, and its automata go
            found = materialize(in_arrow(found, scanner(shared), schema), "decontam-pass")
            shared.destroy()
        shared = spark.sparkContext.broadcast(automata)
    return in_arrow(found, scanner(shared, finish), docs.schema if finish else schema), *added


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """`text` without the words of `spans` and what stands between them; one space closes each gap."""
    at = [m.span() for m in WORD.finditer(text.translate(_LOWER))]
    parts, begin = [], 0
    for a, b in spans:
        parts.append(text[begin : at[a][0]].rstrip())
        begin = at[b - 1][1]
    parts.append(text[begin:])
    return " ".join(p for p in (x.strip(" ") for x in parts) if p)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the items themselves."""
    found, words, spans, items = _scans(docs.select("doc_id", "text"), benchmark, window)
    listed = F.array_join(F.array_sort(F.transform(items, lambda x: x.cast("string"))), ",")
    hit = _hit(spans)
    return found.select(
        "doc_id", F.col(words).alias("n_words"), hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (hit > 0).alias("contaminated"), F.col(items).alias("items")
    )


def _hit(spans: str):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, x: n + x[1] - x[0])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """The columns of `docs`: hit spans are cut from `text`, and documents with at least `max_coverage` of
    their words hit, or nothing left after the cut, are dropped. n_chars, where present, follows the new text."""
    columns = docs.columns
    at, size = columns.index("text"), columns.index("n_chars") if "n_chars" in columns else None

    def finish(batch):
        arrays = list(batch.columns[: len(columns)])
        texts = arrays[at].to_pylist()
        sizes = arrays[size].to_pylist() if size is not None else None
        keep = []
        for k, (n, s) in enumerate(zip(*(batch.column(len(columns) + j).to_pylist() for j in (0, 1)), strict=True)):
            few = sum(b - a for a, b in s) < max_coverage * n
            if s and few:
                texts[k] = cut(texts[k], s)
                if sizes:
                    sizes[k] = len(texts[k])
            keep.append(not s or (few and bool(texts[k])))
        arrays[at] = pa.array(texts, arrays[at].type)
        if sizes is not None:
            arrays[size] = pa.array(sizes, arrays[size].type)
        return pa.RecordBatch.from_arrays(arrays, names=columns).filter(pa.array(keep, pa.bool_()))

    return _scans(docs, benchmark, window, finish)[0]
