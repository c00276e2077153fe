"""SimHash near-duplicates by pigeonhole blocks.

Fingerprint: XXH64 (seed 42) of every 3-word shingle of the ASCII-lower-cased text, repeats included;
a bit is 1 if it is set in more than half the hashes. Two fingerprints link at `max_bits` (2) or fewer
differing bits. The 64 bits are split into `max_bits + 2` blocks: a close pair agrees on at least two
whole blocks, so each pair of blocks is one join key and a chance collision needs about 32 equal bits.

No group is ever expanded into all its pairs. Exact copies collapse to one fingerprint first. In a key
shared by up to `small_bucket` fingerprints the pairs are joined and verified. In a larger bucket every
fingerprint is posted under each value within one bit of its remaining bits: two fingerprints differ in
at most two bits exactly if they share such a value, one value is shared by at most 1 + remaining bits
different fingerprints, and all that share it link to each other, so linking each to the least of them
keeps the components. That is linear in the bucket's size and exact (it holds for `max_bits` = 2; for
other radii the bucket is split by further blocks, see `_refined`).

`near_copies` serves corpus stages, which ask for a similarity of 0.8 by 5-word shingles; such texts differ in
about 15 % of the bits, far beyond two of 64: no pigeonhole over blocks of bits reaches them without loss. So the
fingerprint has LANES words of 64 bits over the set of shingles, and candidates are texts that share one of the shingles
which a similar text cannot all lack: a fifth of the set and one more, the first in an order common to all sets. That loses no
pair, and strangers share none. The order puts frequent shingles last; they are found on a sample, since any
order gives the same links. Candidates are compared by fingerprint: a pair within SURE bits is a link as it stands, one
beyond FAR is none (six standard deviations over the mean distance at 0.8; sets under SHORT shingles are always compared),
and between these the Jaccard similarity of the sets decides, so no link is below `similar`.

A group of copies joins in linear time: in each bucket (texts with one such shingle) all members are held against the one
that has most shingles in common with others, the original if it is there; in buckets that still
hold over `small_bucket` pairs of different components for each member also against a few others by chance. Then every pair between different components that is left is
made, whatever the bucket's size. A place in a bucket goes beforehand if so many of the text's shingles are rarer that no other
member's set can be similar. So the work is quadratic only in texts of about one size that share their rarest shingles and yet are
no copies.

Defined cases: null and empty texts have fingerprint zero and link like any other; repeated rows share
a fingerprint, hence a component; a null doc_id never names a component unless it has no other; an empty
table gives an empty result; other columns of the input are ignored by the queries and kept by
`drop_near_duplicates`, whatever they are called.
"""

from __future__ import annotations

import math
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, in_arrow, internal, likely, materialize
from .components import connected_components

SEED = 42
SHINGLE = 3
MAX_BITS = 2
SMALL_BUCKET = 64
_SLAB = 1 << 16
LANES = 16
COPY_SHINGLE = 5
SIMILAR = 0.8
FAR, SHORT = 225, 32
SURE = 90
ORDER_SAMPLE, COMMON = 1 << 15, 1 << 18
_BEFORE, _TURNS = 8, 2
_EPSILON = 1e-9


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams, n = iter([b" ".join(words)]), 1
    else:
        n = len(words) - shingle + 1
        grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for start in range(0, n, _SLAB):
        size = min(_SLAB, n - start)
        hashes = np.fromiter((digest(g, SEED) for g in islice(grams, size)), "<u8", size)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(size, 8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""

    def run(batches):
        for batch in batches:
            values = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["doc_id", "fp"])

    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, fp long")


def _blocks(n: int) -> list[tuple[int, int]]:
    """(offset, width) of n blocks over 64 bits."""
    edges = [64 * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _mask(parts) -> int:
    return sum(((1 << w) - 1) << o for o, w in parts)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def linked_fingerprints(fps: DataFrame, max_bits: int = MAX_BITS, small_bucket: int = SMALL_BUCKET) -> DataFrame:
    """Edges a, b between different fingerprints of `fps` (distinct column fp) that keep all components."""
    chosen = list(combinations(_blocks(max_bits + 2), 2))
    masks = [_mask(c) for c in chosen]
    keys = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("k", "v"))
    counts = keys.groupBy("k", "v").agg(F.count("*").alias("n")).where("n > 1")
    counts = materialize(counts, "simhash-counts")  # so that both sides are shuffled plainly and a hot one can be split
    shared = materialize(keys.join(counts, ["k", "v"]), "simhash-shared")
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    few = shared.where(F.col("n") <= small_bucket)
    pairs = (
        few.select("k", "v", F.col("fp").alias("a")).join(few.select("k", "v", F.col("fp").alias("b")), ["k", "v"]).where((F.col("a") < F.col("b")) & close).select("a", "b")
    )
    many = shared.where(F.col("n") > small_bucket)
    return pairs.unionByName(_near_values(many, masks) if max_bits == 2 else _refined(many, max_bits, masks)).distinct()


def _near_values(many: DataFrame, masks: list[int]) -> DataFrame:
    """Large buckets at radius 2: link the fingerprints that have a value within one bit in common."""
    free = [[b for b in range(64) if not m >> b & 1] for m in masks]
    flips = F.element_at(F.array(*[F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << b)) for b in bits]) for bits in free]), F.col("k") + 1)
    posted = many.select("k", "fp", F.explode(flips).alias("flip")).select("k", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("near"))
    least = posted.groupBy("k", "near").agg(F.collect_list("fp").alias("members")).where(F.size("members") > 1)  # 1 + free bits members at most
    return least.select(F.array_min("members").alias("a"), F.explode("members").alias("b")).where("a <> b")


def _refined(many: DataFrame, max_bits: int, masks: list[int]) -> DataFrame:
    """Large buckets at other radii: the free bits are split into max_bits + 1 blocks of which one agrees."""
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    finer = []
    for m in masks:
        bits = [b for b in range(64) if not m >> b & 1]
        cut = [len(bits) * k // (max_bits + 1) for k in range(max_bits + 2)]
        finer.append([m | sum(1 << b for b in bits[i:j]) for i, j in zip(cut, cut[1:], strict=False)])
    table = F.element_at(F.array(*[F.array(*[F.lit(_signed(x)) for x in row]) for row in finer]), F.col("k") + 1)
    split = many.select("k", "fp", F.posexplode(table).alias("j", "m")).select("k", "j", "fp", F.col("fp").bitwiseAND(F.col("m")).alias("v"))
    left, right = split.withColumnRenamed("fp", "a"), split.withColumnRenamed("fp", "b")
    return left.join(right, ["k", "j", "v"]).where((F.col("a") < F.col("b")) & close).select("a", "b")


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, shingle: int = SHINGLE, small_bucket: int = SMALL_BUCKET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id that links reach."""
    prints = materialize(fingerprints(docs, shingle), "simhash-prints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    edges = linked_fingerprints(nodes.select("fp"), max_bits, small_bucket)
    roots = connected_components(edges)  # only fingerprints that have links
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    named = materialize(named, "simhash-named")
    least = materialize(named.groupBy("root").agg(F.min("rep").alias("component_id")), "simhash-least")
    classes = materialize(named.join(least, "root").select("fp", "component_id"), "simhash-classes")
    return prints.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(text: str | None, shingle: int = COPY_SHINGLE) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending; a text with fewer words is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    grams = map(b" ".join, zip(*(words[k:] for k in range(min(shingle, len(words)))), strict=False))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), "<u8"))


_STEPS = (np.arange(LANES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None]
_ROWS = 255  # sums of so many bits fit a byte


def _mixed(hashes: np.ndarray) -> np.ndarray:
    """(n, LANES): the hashes, in lane 0 as they are, in the others through a 64-bit finaliser."""
    x = hashes[:, None] + _STEPS
    y = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    y = (y ^ (y >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    y ^= y >> np.uint64(31)
    y[:, 0] = hashes
    return y


def _wide(hashes: np.ndarray) -> np.ndarray:
    """LANES words of 64 bits: a bit is 1 if it is set in more than half the hashes of its lane."""
    counts = np.zeros(64 * LANES, np.int64)
    for at in range(0, len(hashes), _ROWS):
        bits = np.unpackbits(_mixed(hashes[at : at + _ROWS]).view(np.uint8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")


def wide_fingerprint(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The wide fingerprint over all shingles of a text, repeats included; its first word is `fingerprint`."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    grams = map(b" ".join, zip(*(words[k:] for k in range(min(shingle, len(words)))), strict=False))
    return _wide(np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), "<u8"))


def _lists(sets: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, sets)])
    flat = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


_WORDS = [f"f{k}" for k in range(LANES)]


def _first(hashes: np.ndarray, similar: float, common: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The hashes of a set (ascending) of which every set that is `similar` holds one: as many as may be missing and
    one more, the first in an order that is the same for all sets. That is by hash, with those in `common` (ascending)
    behind all others by their ranks."""
    many = len(hashes) - math.ceil(similar * len(hashes) - _EPSILON) + 1
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        known = common[at] == hashes
        hashes = np.concatenate([hashes[~known], hashes[known][np.argsort(ranks[at[known]])]])
    return hashes[:many]


def _common(texts: DataFrame, shingle: int) -> np.ndarray:
    """Hashes of frequent shingles, from the rarest to the most frequent. They only set the order in `_first`, any would do
    for the result; so the COMMON most frequent among ORDER_SAMPLE texts, chosen by hash, are enough."""

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t, shingle) for t in batch.column(0).to_pylist()]
            for at in range(0, len(sets), 256):
                some = np.concatenate([np.zeros(0, np.uint64), *sets[at : at + 256]])
                yield pa.RecordBatch.from_arrays([pa.array(some.view(np.int64))], ["key"])

    rows = texts.count()
    chosen = texts if rows <= ORDER_SAMPLE else texts.where(F.pmod("tie", F.lit(rows)) < ORDER_SAMPLE)
    counts = materialize(in_arrow(chosen.select("text"), run, "key long").groupBy("key").agg(F.count("*").alias("m")).where("m > 2"), "copies-common")
    least, many = 1 << 62, 0
    for row in sorted(counts.groupBy("m").agg(F.count("*").alias("keys")).collect(), reverse=True):
        many += row[1]
        least = row[0] if many <= COMMON else least
    top = counts.where(F.col("m") >= least).toArrow()
    keys, m = (top.column(c).to_numpy() for c in ("key", "m"))
    return keys[np.lexsort((keys, m))].view(np.uint64)


def _prints(texts: DataFrame, shingle: int, similar: float, common: np.ndarray) -> DataFrame:
    """doc_id, tie, fp (hash of the shingle set), n (its size), first (see `_first`), f0 and so on (the wide fingerprint)."""
    ranks = np.argsort(common, kind="stable")
    common = common[ranks]

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t, shingle) for t in batch.column(2).to_pylist()]
            fps = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)
            wide = np.array([_wide(x) for x in sets], np.uint64).reshape(len(sets), LANES).view(np.int64)
            sizes = pa.array([len(x) for x in sets], pa.int32())
            first = _lists([_first(x, similar, common, ranks) for x in sets])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps), sizes, first, *[pa.array(np.ascontiguousarray(w)) for w in wide.T]], ["doc_id", "tie", "fp", "n", "first", *_WORDS])

    return in_arrow(texts, run, "doc_id long, tie long, fp long, n int, first array<long>, " + ", ".join(f"{w} long" for w in _WORDS))


def _meet(a: str, b: str, similar: float):
    """Whether sets whose first common shingle stands at these places of their orders can be similar."""
    return F.least(F.col(f"{a}n") - F.col(f"{a}pos"), F.col(f"{b}n") - F.col(f"{b}pos")) + _EPSILON >= similar / (1 + similar) * (F.col(f"{a}n") + F.col(f"{b}n"))


def _near(a: str, b: str):
    """Whether the nodes with column prefixes a and b can be similar by their Hamming distance."""
    return (F.least(f"{a}n", f"{b}n") < SHORT) | (_bits(a, b) <= FAR)


def _bits(a: str, b: str):
    return sum((F.bit_count(F.col(f"{a}{w}").bitwiseXOR(F.col(f"{b}{w}"))) for w in _WORDS), F.lit(0))


def _side(rows: DataFrame, c: str, *more: str) -> DataFrame:
    """`rows` with fp as `c`, and n and the fingerprint with that prefix."""
    return rows.select(*more, F.col("fp").alias(c), *[F.col(x).alias(f"{c}{x}") for x in ("n", *_WORDS)])


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, similar: float, shingle: int) -> DataFrame:
    """Of the pairs a, b those within the Hamming radius and similar: a distance of SURE bits or less is proof,
    beyond that the shingle sets are compared."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists([shingle_set(t, shingle) for t in batch.column(1).to_pylist()])], ["fp", "hashes"])

    both = pairs.distinct().join(_side(nodes, "a"), "a").join(_side(nodes, "b"), "b")
    close = materialize(both.where(_near("a", "b")).select("a", "b", _bits("a", "b").alias("bits")), "copies-close", release=True)
    unsure = close.where(F.col("bits") > SURE).select("a", "b")
    ends = unsure.select(F.col("a").alias("fp")).unionByName(unsure.select(F.col("b").alias("fp"))).distinct()
    chosen = nodes.select("fp", "rep.*").join(ends, "fp", "left_semi").select("fp", F.col("doc_id").alias("d"), F.col("tie").alias("t"))
    chosen = materialize(chosen, "copies-ends")
    # a few texts of all: the others do not go into the shuffle
    held = likely(texts, "tie", chosen, "t").join(chosen, (F.col("tie") == F.col("t")) & F.col("doc_id").eqNullSafe(F.col("d"))).groupBy("fp").agg(F.min("text").alias("text"))
    sets = materialize(in_arrow(held.select("fp", "text"), run, "fp long, hashes array<long>"), "copies-sets", release=True)
    of = lambda c: sets.select(F.col("fp").alias(c), F.col("hashes").alias(f"{c}_set"))
    shared = F.size(F.array_intersect("a_set", "b_set"))
    equal = unsure.join(of("a"), "a").join(of("b"), "b").where(shared + _EPSILON >= similar * (F.size("a_set") + F.size("b_set") - shared))
    edges = materialize(close.where(F.col("bits") <= SURE).select("a", "b").unionByName(equal.select("a", "b")), "copies-edges", release=True)
    discard(close, chosen, sets)
    return edges


def _ordered(a, b):
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def _shared_keys(nodes: DataFrame, similar: float) -> DataFrame:
    """key, fp, n, pos, m: the first shingles that m > 1 nodes have in common, without the rows that `_meet` none of their
    bucket. Of two rows that meet, the larger set's one could meet its own size, so that the least of such sizes decides."""
    able = (F.col("n") - F.col("pos") + _EPSILON) * ((1 + similar) / similar) - F.col("n") + _EPSILON  # the largest set to meet here
    keys = nodes.select("fp", "n", F.posexplode("first").alias("pos", "key"))
    counts = keys.groupBy("key").agg(F.count("*").alias("m"), F.min(F.when(able >= F.col("n"), F.col("n"))).alias("least")).where("m > 1 and least is not null")
    counts = materialize(counts, "copies-counts", release=True)
    shared = keys.join(counts, "key").where((able >= F.col("n")) | (able >= F.col("least"))).drop("least")
    shared = materialize(shared, "copies-shared", release=True)  # both sides are shuffled plainly, so that a hot one can be split
    discard(counts)
    return shared


def _copy_edges(shared: DataFrame, nodes: DataFrame, texts: DataFrame, similar: float, shingle: int, small_bucket: int) -> DataFrame:
    """Edges a, b that keep the components of the similar pairs. `shared` and every table that no later step reads are deleted."""

    def led(rows: DataFrame) -> DataFrame:
        """The members of each bucket but the one with most shared shingles, with that one as `first` and its columns. Its own
        changes, which no other text has, are the fewest, so it is nearest to the centre of its group."""
        ranked = materialize(rows.withColumn("rank", -F.count("*").over(Window.partitionBy("fp"))), "copies-ranked", release=True)
        discard(rows)
        least = ranked.groupBy("key").agg(F.min(F.struct("rank", "fp", "n", "pos")).alias("first"))
        first = least.select("key", F.col("first.fp").alias("first"), *[F.col(f"first.{c}").alias(f"first_{c}") for c in ("n", "pos")])
        first = materialize(first, "copies-leaders")
        found = materialize(ranked.drop("rank").join(first, "key").where("fp <> first"), "copies-led", release=True)
        discard(ranked, first)
        return found

    def unsettled(written: DataFrame, edges: DataFrame, chosen: str = "true") -> tuple[DataFrame, DataFrame]:
        """The rows `chosen` of a written table, which goes, whose buckets hold different components, with the number of pairs
        between these for each member (`open`); and the edges, which go too, as one star for each component."""
        roots = connected_components(edges).withColumnRenamed("node", "fp")
        rows = written.where(chosen).select("key", "fp", "n", "pos").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        parts = rows.groupBy("key", "root").agg(F.count("*").cast("double").alias("c"))
        some = parts.groupBy("key").agg(F.sum("c").alias("size"), F.sum(F.col("c") * F.col("c")).alias("within"), F.count("*").alias("roots")).where("roots > 1")
        some = materialize(some.select("key", "size", ((F.col("size") - F.col("within") / F.col("size")) / 2).alias("open")), "copies-mixed")
        found = materialize(rows.join(some, "key"), "copies-split", release=True)
        discard(written, some, edges)
        return found, roots.where("fp <> root").select(F.col("fp").alias("a"), F.col("root").alias("b"))

    def paired(rows: DataFrame, on: list[str], more) -> DataFrame:
        """The pairs between different components in the same bucket for which `more` holds."""
        rows = rows.join(nodes.select("fp", *_WORDS), "fp")
        sides = (_side(rows, c, *on, *[F.col(x).alias(f"{c}{x}") for x in ("root", "pos", "earlier")]) for c in ("a", "b"))
        other = (F.col("a") < F.col("b")) & (F.col("aroot") != F.col("broot")) & _meet("a", "b", similar)
        return next(sides).join(next(sides), on).where(other & more & _near("a", "b")).select("a", "b")

    once = led(shared)
    edges = _verified(once.where(_meet("", "first_", similar)).select(*_ordered("fp", "first")), nodes, texts, similar, shingle)
    rest, edges = unsettled(once, edges, "m > 2")
    # buckets with many such pairs are dealt into parts of a few members by chance, other ones for each shingle: as members share many
    # shingles, a group that has links enough comes together without most of its pairs
    for turn in range(_TURNS):
        large = rest.where(F.col("open") > small_bucket)
        if large.isEmpty():
            break
        part = F.pmod(F.xxhash64("fp", "key", F.lit(turn)), F.ceil(F.col("size") / max(2, small_bucket // 8)))
        dealt = large.withColumn("part", part).withColumn("earlier", F.lit(None).cast("array<long>"))
        edges = edges.unionByName(_verified(paired(dealt, ["key", "part"], F.lit(True)), nodes, texts, similar, shingle))
        rest, edges = unsettled(rest, edges)
    # then every pair that is left, in the first of its buckets: where both have come to one shortly before, it is passed over
    before = Window.partitionBy("fp").orderBy("pos").rowsBetween(-_BEFORE, -1)
    once = ~F.arrays_overlap("aearlier", "bearlier")
    edges = edges.unionByName(_verified(paired(rest.withColumn("earlier", F.collect_list("key").over(before)), ["key"], once), nodes, texts, similar, shingle))
    discard(rest)
    return edges


def near_copies(docs: DataFrame, similar: float = SIMILAR, shingle: int = COPY_SHINGLE, small_bucket: int = SMALL_BUCKET) -> DataFrame:
    """doc_id, component_id: the smallest doc_id that links of texts with that Jaccard similarity reach."""
    rows, named, first = _grouped(docs, similar, shingle, small_bucket)
    classes = materialize(named.join(first, "root").select("fp", "first"), "copies-classes")
    return rows.join(classes, "fp").select("doc_id", F.col("first.doc_id").alias("component_id"))


def _grouped(docs: DataFrame, similar: float, shingle: int, small_bucket: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """doc_id, tie (hash of the text), fp of every row; fp, rep, root of every node; root, first: the least
    (unnamed, doc_id, tie) of each component, null ids last."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("tie"), F.col("text").cast("string").alias("text"))
    prints = materialize(_prints(texts, shingle, similar, _common(texts, shingle)), "copies-prints", release=True)
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "tie")).alias("rep")
    grouped = prints.groupBy("fp").agg(rep, F.min("n").alias("n"), F.first("first").alias("first"), *[F.min(w).alias(w) for w in _WORDS])
    full = materialize(grouped, "copies-full", release=True)
    rows = materialize(prints.select("doc_id", "tie", "fp"), "copies-rows")
    discard(prints)
    nodes, shared = materialize(full.drop("first"), "copies-nodes"), _shared_keys(full, similar)
    discard(full)
    edges = _copy_edges(shared, nodes, texts, similar, shingle, small_bucket)
    roots = connected_components(edges).withColumnRenamed("node", "fp")
    named = materialize(nodes.select("fp", "rep").join(roots, "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root")), "copies-named", release=True)
    discard(nodes, edges, roots)
    return rows, named, materialize(named.groupBy("root").agg(F.min("rep").alias("first")), "copies-first", release=True)


def drop_near_duplicates(docs: DataFrame, similar: float = SIMILAR, shingle: int = COPY_SHINGLE) -> DataFrame:
    """One document of each group of near copies, in the columns of `docs`: the one with the smallest doc_id, then
    the least hash of its text. Rows that agree in both are one document and stay alike. Only where no text of a
    group has a doc_id, a row without one stays, and then a single one."""
    rows, named, first = _grouped(docs, similar, shingle, SMALL_BUCKET)
    chosen = materialize(first.select("first.*").distinct(), "copies-kept", release=True)
    discard(rows, named, first)
    tie = internal(docs, "tie")
    keyed = docs.withColumn(tie, F.xxhash64(F.col("text").cast("string")))
    name = lambda unnamed: chosen.where(F.col("unnamed") == unnamed).select(F.col("doc_id").alias(f"{tie}d"), F.col("tie").alias(f"{tie}t"))
    text = F.col(f"{tie}t") == F.col(tie)
    named = keyed.join(name(False), text & (F.col(f"{tie}d") == F.col("doc_id").cast("long")), "left_semi").select(docs.columns)
    others = keyed.where("doc_id is null").join(name(True), text, "left_semi").groupBy(tie).agg(F.first(F.struct(*docs.columns)).alias(f"{tie}r"))
    return named.unionByName(others.select(f"{tie}r.*"))
