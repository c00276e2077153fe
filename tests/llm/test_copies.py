"""SimHash, components and line dedup against brute force."""

import glob
import random
import time

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from glossweave.llm import common, line_dedup, simhash
from glossweave.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, fp long, u long"


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0d]+", low) if w]
    grams = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints, max_bits=2):
    ids = list(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if bin(prints[a] ^ prints[b]).count("1") <= max_bits:
                u, v = sorted((find(a), find(b)))
                root[v] = u
    return {i: find(i) for i in ids}


def documents(n=120, seed=3):
    rng = random.Random(seed)
    vocabulary = ["Wort", "été", "the", "of", "and", "Line", "x1", "naïve"] + [f"w{k}" for k in range(200)]
    base = " ".join(rng.choice(vocabulary) for _ in range(400))
    rows = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60))), "en", 1, 2) for k in range(n)]
    for k in range(n, n + 60):  # near copies
        words = base.split()
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = "changed"
        rows.append((k, " ".join(words), "en", 1, 2))
    rows += [(900, None, "en", 0, 0), (901, "", "en", 0, 0), (902, " \t\n", "en", 0, 0), (903, "one", "en", 0, 0), (904, "One two", "en", 0, 0), (905, rows[3][1], "en", 0, 0), (905, rows[3][1], "en", 0, 0)]
    return rows


@pytest.mark.parametrize("bucket", [64, 2])
def test_simhash_matches_brute_force(spark, bucket):
    rows = documents()
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, DOCS), small_bucket=bucket).collect()}
    prints = {i: slow_fingerprint(t) for i, t, *_ in rows}
    want = slow_components(prints)
    assert found == {i: (f"{prints[i]:016x}", want[i]) for i in prints}


@pytest.mark.parametrize("bits", [1, 2, 3])
def test_links_of_a_dense_ball(spark, bits):
    rng = random.Random(bits)
    centre = rng.getrandbits(64)
    fps = {centre}
    for _ in range(150):
        x = centre
        for _ in range(rng.randint(1, 6)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    signed = {f: f - (1 << 64) if f >> 63 else f for f in fps}
    edges = simhash.linked_fingerprints(spark.createDataFrame([(v,) for v in signed.values()], "fp long"), bits, 4)
    got = {r.node: r.root for r in connected_components(edges).collect()}
    want = slow_components({signed[f]: f for f in fps}, bits)
    groups = lambda d: sorted(sorted(k for k in d if d[k] == r) for r in set(d.values()) if sum(v == r for v in d.values()) > 1)
    assert groups(got) == groups(want)


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(200)] + [(1000, 1000 + k) for k in range(1, 300)] + [(5, 5), (7, None)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(201)}, **{k: 1000 for k in range(1000, 1300)}}


def test_empty_table(spark):
    empty = spark.createDataFrame([], DOCS)
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.drop_near_duplicates(empty).count() == 0
    assert line_dedup.dedup_lines(empty).count() == 0


def test_one_document_of_each_group_stays(spark):
    """Exact copies and copies with a few changed words go; different documents stay."""
    rng = random.Random(8)
    base = [[f"w{rng.randrange(3000)}" for _ in range(400)] for _ in range(20)]
    rows, group = [], {}
    for k in range(100):
        words = list(base[k % 20])
        for _ in range(0 if k < 40 else 3):
            words[rng.randrange(400)] = "changed"
        rows.append((k, " ".join(words), "en", 1, 2))
        group[k] = k % 20
    rows += [(200, None, "en", 1, 2), (201, "", "en", 1, 2), (202, "a single line", "en", 1, 2), (3, rows[3][1], "en", 1, 2)]
    docs = spark.createDataFrame(rows, DOCS)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 3, 3, *range(4, 20), 200, 202]


def test_first_lane_is_the_fingerprint():
    for t in (None, "a", "a b", "One two three four"):
        assert int(simhash.wide_fingerprint(t)[0]) == simhash.fingerprint(t)


def test_wide_links_match_brute_force(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    rows = []
    for k in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 12)):
            words[rng.randrange(150)] = f"new{rng.randrange(99)}"
        rows.append((k, " ".join(words), "en", 1, 2))
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(rows, DOCS)).collect()}
    prints = {k: simhash.wide_fingerprint(t) for k, t, *_ in rows}
    far = lambda a, b: int(np.unpackbits((prints[a] ^ prints[b]).view(np.uint8)).sum())
    for k, c in got.items():  # no link without a chain of close ones, and all almost equal ones linked
        assert c == k or any(far(k, x) <= 128 for x, d in got.items() if d == c and x != k)
    assert all(got[a] == got[b] for a in prints for b in prints if far(a, b) <= 31)


def slow_copies(rows, similar=0.8):
    """Components of all pairs by the Jaccard similarity of 5-word shingles."""
    def grams(text):
        words = text.lower().split()
        return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}

    sets = {k: grams(t) for k, t, *_ in rows}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= similar * len(sets[a] | sets[b]):
                u, v = sorted((find(a), find(b)))
                root[v] = u
    return {k: find(k) for k in sets}


@pytest.mark.parametrize("bucket", [64, 3])
def test_copies_among_strangers_with_a_shared_passage(spark, bucket):
    """Pairs of copies link whatever else shares their passage, in small buckets and in large ones."""
    rng = random.Random(4)
    passage = " ".join(f"p{k}" for k in range(60))
    rows = []
    for k in range(40):
        own = [f"o{rng.randrange(5000)}" for _ in range(rng.randint(20, 90))]
        rows.append((2 * k, " ".join([passage, *own]), "en", 1, 2))
        own[rng.randrange(len(own))] = "changed"
        rows.append((2 * k + 1, " ".join([passage, *own]), "en", 1, 2))
    rng.shuffle(rows)
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(rows, DOCS), small_bucket=bucket).collect()}
    assert got == slow_copies(rows)


def test_copies_match_brute_force_at_the_similarity(spark):
    """Pairs on both sides of 0.8, most of them far beyond what any block of a fingerprint shares."""
    rng = random.Random(6)
    rows = []
    for k in range(60):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.randint(100, 300))]
        rows.append((2 * k, " ".join(words), "en", 1, 2))
        for at in rng.sample(range(len(words)), round(len(words) * rng.uniform(0.012, 0.028))):
            words[at] = f"new{rng.randrange(999)}"
        rows.append((2 * k + 1, " ".join(words), "en", 1, 2))
    want = slow_copies(rows)
    assert 15 < sum(k != c for k, c in want.items()) < 55
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == want


@pytest.mark.parametrize("bucket", [64, 3])
def test_no_pair_is_lost_whatever_the_bucket(spark, bucket):
    """Pairs barely over the similarity, most beside strangers that share a passage: each is linked, in small buckets and in large."""
    rng = random.Random(12)
    passage = [f"p{k}" for k in range(30)]
    rows = []
    for k in range(700):
        words = [*(passage if k % 2 else []), *(f"w{rng.randrange(90_000)}" for _ in range(100 - 30 * (k % 2)))]
        rows.append((2 * k, " ".join(words), "en", 1, 2))
        rows.append((2 * k + 1, " ".join([*words[:40], "new", *words[41:80], "new", *words[81:]]), "en", 1, 2))
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(rows, DOCS), small_bucket=bucket).collect()}
    assert got == {k: k - k % 2 for k in range(1400)}


def test_pairs_of_a_large_group_grow_with_its_size(spark, monkeypatch):
    """Copies of one text with up to eight changed words, of which only those with few are similar: all links, but not all pairs."""
    rng = random.Random(15)
    base, n, made = [f"w{rng.randrange(4000)}" for _ in range(150)], 600, []
    rows = []
    for k in range(n):
        words = list(base)
        for at in rng.sample(range(150), k % 9):
            words[at] = f"new{rng.randrange(4000)}"
        rows.append((k, " ".join(words), "en", 1, 2))
    rng.shuffle(rows)
    verified = simhash._verified

    def counted(pairs, *more):
        made.append(pairs.distinct().count())
        return verified(pairs, *more)

    monkeypatch.setattr(simhash, "_verified", counted)
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == slow_copies(rows)
    assert sum(made) < 4 * n


def slow_line_dedup(rows, min_words):
    """Every run of every document against all that stand earlier."""
    parsed = []
    for i, t in sorted(rows, key=lambda r: r[0]):
        lines = [(k, " ".join(x.split())) for k, x in enumerate((t or "").split("\n"))]
        parsed.append((i, [(k, x) for k, x in lines if x]))
    first = {}
    for at, (_, lines) in enumerate(parsed):
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                run = tuple(x for _, x in lines[a : b + 1])
                if sum(len(x.split()) for x in run) >= min_words:
                    first.setdefault(run, (at, a))
    gone = {}
    for at, (i, lines) in enumerate(parsed):
        covered = set()
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                run = tuple(x for _, x in lines[a : b + 1])
                if sum(len(x.split()) for x in run) >= min_words and first[run] < (at, a):
                    covered.update(k for k, _ in lines[a : b + 1])
        gone[i] = covered
    return gone


def test_shuffle_of_the_step_before_is_gone_while_a_table_is_written(spark):
    folders = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    shuffles = lambda: {p for d in folders for p in glob.glob(f"{d}/*/shuffle_*.data")}

    def look(batches):
        for batch in batches:
            time.sleep(2)  # files go in the background
            yield pa.RecordBatch.from_arrays([pa.array(sorted(made & shuffles()), pa.string())], ["path"])

    before = shuffles()
    common.materialize(spark.range(10000).selectExpr("id % 7 as k").groupBy("k").count(), "first")
    made = shuffles() - before
    assert made
    time.sleep(2)  # so do the events of the step
    assert common.materialize(spark.range(1).coalesce(1).mapInArrow(look, "path string"), "second", release=True).collect() == []


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(5)
    pool = [" ".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9))) for _ in range(25)]
    rows = [(k, "\n".join(rng.choice([*pool, "", "  "]) for _ in range(rng.randint(0, 14)))) for k in range(60)]
    rows += [(70, None), (71, ""), (72, "\n\n"), (73, rows[4][1]), (74, pool[0] + "\n" + pool[0])]
    data = spark.createDataFrame([(i, t, len(t or ""), "x", 1) for i, t in rows], "doc_id long, text string, n_chars long, first string, n_lines int")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(data, 12).collect()}
    want = slow_line_dedup(rows, 12)
    for i, t in rows:
        if t is None:
            assert got[i].text is None
            continue
        lines, kept, before = t.split("\n"), [], False
        for k, line in enumerate(lines):
            before = k in want[i] if line.split() else before
            if not before:
                kept.append(line)
        assert got[i].text == "\n".join(kept), i
        assert got[i].n_deleted == len(lines) - len(kept)
        assert got[i].n_chars == len(got[i].text)


def test_repeated_passage_is_caught_once(spark):
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(k, f"own line {k}\n{passage}\nend {k}") for k in range(40)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in got if r.n_deleted == 0) == [0]
    assert all(passage not in r.text for r in got if r.doc_id)


def test_windows_are_minimal():
    lines = [(k, n, k) for k, n in enumerate([3, 9, 1, 1, 4, 20, 2])]
    words = lambda a, b: sum(n for _, n, _ in lines[a : b + 1])
    ahead = {(a, next(b for b in range(a, 7) if words(a, b) >= 10)) for a in range(7) if words(a, 6) >= 10}
    back = {(next(a for a in range(b, -1, -1) if words(a, b) >= 10), b) for b in range(7) if words(0, b) >= 10}
    assert line_dedup.windows_of(lines, 10) == ahead | back


def test_fingerprint_of_long_text():
    text = " ".join(f"t{k % 977}" for k in range(70_000))
    assert simhash.fingerprint(text) == slow_fingerprint(text)
    assert np.uint64(simhash.fingerprint("a b c")) == slow_fingerprint("A\tB\nC")


def test_rows_without_doc_id_and_texts_under_one_doc_id(spark):
    """Unique texts stay whatever their doc_id; of copies without any doc_id one row stays, with one the named row."""
    long = lambda k: " ".join(f"{k}word{j}" for j in range(30))
    rows = [(None, long(1), "en", 1, 2), (None, long(2), "en", 1, 2), (None, long(2) + " more", "en", 1, 2), (None, long(2), "en", 5, 6), (0, long(3), "en", 1, 2), (0, long(4), "en", 1, 2), (7, long(4), "en", 1, 2), (None, long(4), "en", 1, 2), (9, long(5), "en", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `__tie` string, fp long, first long")
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    got = sorted((str(r.doc_id), r.text.split()[0]) for r in kept.collect())
    assert got == [("0", "3word0"), ("0", "4word0"), ("9", "5word0"), ("None", "1word0"), ("None", "2word0")]


def test_recall_against_all_pairs_of_the_table(spark):
    """Of all pairs of different texts of a table that are similar, at least 0.9 are linked, and no others."""
    from collections import Counter, defaultdict
    from math import ceil

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()}
    sets = {}
    for r in docs.select("doc_id", "text").orderBy("doc_id").collect():
        words = (r.text or "").encode().lower().split()
        sets.setdefault(frozenset(zip(*(words[k:] for k in range(min(5, len(words)))))), r.doc_id)
    seen, shared = Counter(g for s in sets for g in s), defaultdict(list)
    for s in sets:
        for g in sorted(s, key=lambda g: (seen[g], g))[: len(s) - ceil(0.8 * len(s)) + 1]:
            shared[g].append(s)
    pairs = {(sets[a], sets[b]) for some in shared.values() for a in some for b in some if sets[a] < sets[b] and len(a & b) >= 0.8 * len(a | b)}
    linked = [got[a] == got[b] for a, b in pairs]
    assert sum(linked) >= 0.9 * len(linked)
    assert len({got[i] for i in sets.values()}) >= len(sets) - len(pairs)


def slow_words(rows, size):
    """Of each text, the words outside all stretches of `size` words that occur earlier."""
    first, out = {}, {}
    parsed = [(i, (t or "").split()) for i, t in sorted(rows, key=lambda r: r[0])]
    for at, (_, words) in enumerate(parsed):
        for k in range(len(words) - size + 1):
            first.setdefault(tuple(words[k : k + size]), (at, k))
    for at, (i, words) in enumerate(parsed):
        gone = set()
        for k in range(len(words) - size + 1):
            if first[tuple(words[k : k + size])] < (at, k):
                gone.update(range(k, k + size))
        out[i] = [w for k, w in enumerate(words) if k not in gone]
    return out


@pytest.mark.parametrize("size", [5, 12, 13])
def test_runs_inside_lines_match_brute_force(spark, size):
    """Passages that are wrapped otherwise, begin inside a line or repeat in one text."""
    rng = random.Random(size)
    passages = [[rng.choice("abcdefghij") + str(rng.randrange(9)) for _ in range(rng.randint(4, 40))] for _ in range(8)]
    rows = []
    for k in range(60):
        words = [w for _ in range(rng.randint(0, 4)) for w in [*[f"o{rng.randrange(300)}" for _ in range(rng.randint(0, 6))], *rng.choice(passages)]]
        rows.append((k, "".join(w + rng.choice([" ", " ", "  ", "\n"]) for w in words)))
    rows += [(90, "same " * 60), (91, "same " * 9), (92, None), (93, "")]
    data = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.text or "").split() for r in line_dedup.dedup_lines(data, size, inside_lines=True).collect()}
    assert got == slow_words(rows, size)


def test_only_minima_are_selected():
    text = "\n".join(" ".join(f"w{17 * k % 101}x{j}" for j in range(7)) for k in range(400))
    for windows in (line_dedup.line_windows(line_dedup.tokens(text)), line_dedup.word_windows(line_dedup.tokens(text))):
        assert len(set(windows.at.tolist())) < 0.5 * len(windows.at)
        assert all(a <= p < b for a, b, p in zip(windows.first, windows.last, windows.at, strict=True))


def test_line_dedup_of_null_ids_long_texts_and_clashing_names(spark):
    long = " ".join(f"t{k}" for k in range(120_000))
    rows = [(None, long, "a"), (3, long + " end", "b"), (3, "short", "c")]
    data = spark.createDataFrame(rows, "doc_id long, text string, __runs string")
    got = {r["__runs"]: r for r in line_dedup.dedup_lines(data, inside_lines=True).collect()}
    assert (got["a"].text, got["b"].text, got["c"].text) == (long, "end", "short")
