"""Token store, neighbours, quality classifier, mixing and the pipeline."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossweave.llm import ann, mixing, quality, token_store
from glossweave.llm.common import read_table
from glossweave.llm.queries import labelled_domains, tokenizer_path

DOCS = "doc_id long, text string, ids string, start long"
SF = "/root/testdata/sf0.001"


# --- token store ---


def slow_tokens(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    return [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]


HARD = ["don't I'll 'S it's", "<|endoftext|> <|ENDOFTEXT|>a<|endoftext|>", "J̌ x　y", "", None, "  a  ", "Σίσυφος ΟΔΥΣΣΕΥΣ", "x²½ 2023 ³—,a", "a\x1cb \x85c", "İstanbul É É", "日本語, 漢字", "a_b-c@d.e #$%", "́ a", "ſ ﬁ Å", "ONE!! two** | three"]


def test_tokens_match_the_library(spark):
    texts = HARD + [r.text for r in read_table(spark, SF, "documents").limit(60).collect()] + [HARD[0]]
    rows = [(5 * k, t, "x", 0) for k, t in enumerate(texts)]
    random.Random(1).shuffle(rows)
    stored = token_store.token_table(spark.createDataFrame(rows, DOCS).repartition(3), tokenizer_path())
    got = {r.doc_id: r for r in token_store.checksums(stored).collect()}
    start = 0
    for k, ids in enumerate(slow_tokens(texts)):
        r = got[5 * k]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), texts[k]
        start += len(ids)
    one = stored.where("doc_id = 0").select("ids").first()
    assert list(one.ids) == slow_tokens(texts[:1])[0]


def test_repeated_and_null_ids_have_disjoint_ranges(spark):
    rows = [(1, "a b", "x", 0), (1, "a b", "x", 0), (1, "c", "x", 0), (None, "d", "x", 0)]
    got = sorted((r.start, r.n_tokens) for r in token_store.checksums(token_store.token_table(spark.createDataFrame(rows, DOCS), tokenizer_path())).collect())
    assert [s for s, _ in got] == [0, *np.cumsum([n for _, n in got])[:-1].tolist()]
    assert token_store.checksums(token_store.token_table(spark.createDataFrame([], DOCS), tokenizer_path())).count() == 0


def test_other_tokenizers_encode_whole_texts():
    import pyarrow as pa

    import public_tokenizers

    encoder = token_store.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [t or "" for t in HARD]
    ids, sizes = encoder.encode(pa.array(texts))
    want = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert not encoder.by_chunk and [len(x) for x in want] == sizes.tolist() and sum(want, []) == ids.tolist()


def test_small_memo_gives_the_same_ids():
    import pyarrow as pa

    texts = pa.array([t or "" for t in HARD] * 3)
    small, large = (token_store.Encoder(tokenizer_path(), memo=m).encode(texts)[0].tolist() for m in (2, 10_000))
    assert small == large


def test_rare_words_take_no_call_each():
    import sys

    import pyarrow as pa

    rng = random.Random(3)
    words = list({"".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=12)) for _ in range(5000)})
    encoder, calls = token_store.Encoder(tokenizer_path(), memo=64), []
    sys.setprofile(lambda frame, event, arg: calls.append(1) if event == "call" else None)
    try:
        ids, _ = encoder.encode(pa.array([" ".join(words)]))
    finally:
        sys.setprofile(None)
    assert ids.tolist() == encoder.tokenizer.encode(" ".join(words), add_special_tokens=False).ids
    assert len(calls) < len(words) / 5


def test_kept_memory_goes_back_before_the_next_operator(monkeypatch):
    from glossweave.llm import common

    given = []
    monkeypatch.setattr(common, "_KEPT", {})
    monkeypatch.setattr(common, "give_back", lambda: given.append(dict(common._KEPT)))
    common.forget()
    assert given == []  # nothing was kept
    common.kept("encoder", lambda: bytes(1 << 20))
    common.forget()
    assert given == [{}]


# --- neighbours ---


def slow_neighbours(rows, k=10):
    held = {(i, tuple(v)) for i, v in rows if i is not None and v is not None and len(v) == 3 and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for i, v in held:
        if i % 100 == 0:
            near = sorted((float(np.sqrt(sum((a - b) ** 2 for a, b in zip(np.float32(v).astype(float), np.float32(w).astype(float), strict=True)))), j) for j, w in held if j != i)
            out[i] = [(j, d) for d, j in near[:k]]
    return out


def test_neighbours_with_copies_and_unusable_vectors(spark):
    rng = random.Random(1)
    rows = [(k, [round(rng.gauss(0, 1), 3) for _ in range(3)]) for k in range(300)] + [(k, [1.0, 0.0, 0.5]) for k in range(300, 700)]
    rows += [(800, None), (900, [0.0, 0.0, 0.0]), (1000, [float("nan"), 1.0, 1.0]), (1100, [None, 1.0, 2.0]), (1200, [float("inf"), 1.0, 1.0]), (1300, [1.0, 2.0]), (None, [1.0, 1.0, 1.0]), (0, rows[0][1])]
    data = spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id long, embedding array<float>, v int")
    got = {}
    for r in ann.search(data, F.col("vec_id") % 100 == 0, prune=10.0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score, r.rank))
    want = slow_neighbours(rows)
    assert set(got) == set(want)
    for q, near in want.items():
        assert [(j, pytest.approx(d, abs=1e-12), k) for k, (j, d) in enumerate(near, 1)] == got[q]


def test_few_or_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert ann.search(spark.createDataFrame([], schema), F.col("vec_id") % 100 == 0).count() == 0
    assert ann.search(spark.createDataFrame([(0, [1.0])], schema), F.col("vec_id") % 100 == 0).count() == 0
    assert ann.search(spark.createDataFrame([(0, [1.0]), (1, [2.0])], schema), F.col("vec_id") % 100 == 0).count() == 1


def test_recall_over_many_lists(spark):
    rows = read_table(spark, "/root/testdata/sf0.1", "embeddings").select("vec_id", "embedding").collect()
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows])
    data = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v, strict=True)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(data, F.col("vec_id") % 100 == 0, list_size=60).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    found = 0
    for q in got:
        d = np.sqrt(((v - v[ids == q]) ** 2).sum(1))
        d[ids == q] = np.inf
        found += len(got[q] & set(ids[np.argsort(d, kind="stable")[:10]].tolist()))
    assert found >= 0.9 * 10 * len(got)


# --- quality ---


def test_held_out_accuracy(spark):
    docs = read_table(spark, "/root/testdata/sf0.1", "documents")
    grades = quality.graded(read_table(spark, "/root/testdata/sf0.1", "labels"))
    held = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(4)) == 0
    model = quality.train(docs, grades.where(~held))
    rows = quality.score(docs.select("doc_id", "text"), model).join(grades.where(held), "doc_id").select("grade", "selected", "p_ge1", "p_ge2", "expected_grade").collect()
    share = lambda g: np.mean([r.selected for r in rows if r.grade == g])
    assert share(2) > 0.96 and share(0) < 0.05 and share(1) < 0.45
    assert all(r.p_ge1 >= r.p_ge2 and abs(r.expected_grade - r.p_ge1 - r.p_ge2) < 2e-6 for r in rows)


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (2, "", "b"), (None, "x", "c")], "doc_id long, text string, selected string")
    none = quality.graded(spark.createDataFrame([(9, None, 1)], "doc_id long, quality int, toxic int"))
    assert quality.score(docs, quality.train(docs, none)).where("selected").count() == 4
    two = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (2, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    assert sorted(tuple(r) for r in quality.graded(two).collect()) == [(1, 0), (2, 1)]
    assert quality.select_quality(docs, two).columns == docs.columns
    assert quality.score(spark.createDataFrame([], docs.schema), quality.train(docs, none)).count() == 0


# --- mixing ---

TARGETS = {"en": 0.4, "de": 0.3, "fr": 0.2, "es": 0.1}


def test_expected_totals_meet_the_targets(spark):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang")
    labelled = labelled_domains(docs, read_table(spark, "/root/testdata/sf0.01", "labels"))
    rows = mixing.rated(docs, labelled, TARGETS).select("doc_id", "lang", "__n", "__p", F.col("__rate").alias("rate"), F.col("__copies").alias("copies")).collect()
    whole = sum(r["__n"] for r in rows)
    totals = np.sum([np.array(r["__p"]) * r["__n"] * r.rate for r in rows], axis=0) / whole
    assert np.abs(totals - np.array([TARGETS[d] for d in sorted(TARGETS)])).max() < 1e-4
    assert all(r.rate >= 0 and abs(sum(r["__p"]) - 1) < 1e-9 and abs(r.copies - r.rate) < 1 for r in rows)
    assert np.mean([sorted(TARGETS)[int(np.argmax(r["__p"]))] == r.lang for r in rows if r["__n"] > 5]) > 0.97


def test_rates_are_nonnegative_and_optimal(spark):
    """Projected gradient against a plain solver where some rates must be zero."""
    rng = np.random.default_rng(0)
    p = rng.dirichlet([0.5, 0.5, 0.5], 60)
    n = rng.integers(1, 50, 60).astype(float)
    members = spark.createDataFrame([(float(a), b.tolist()) for a, b in zip(n, p, strict=True)], "__n double, __p array<double>")
    targets = np.array([0.8, 0.15, 0.05])
    steps = mixing.fit_rates(members, targets.tolist())
    rate, before = np.ones(60), np.ones(60)
    for momentum, *step in steps:
        rate, before = np.maximum(0, rate + momentum * (rate - before) - p @ np.array(step)), rate
    got = [r[0] for r in members.select(mixing.rate_of(steps)).collect()]
    assert np.allclose(got, rate)
    assert np.abs((rate * n) @ p / n.sum() - targets).max() < 5e-3 and (rate >= 0).all() and (rate == 0).any()


def test_mix_of_odd_rows(spark):
    schema = "doc_id long, text string, rate string, lang string"
    docs = spark.createDataFrame([(1, "the cat", "a", "en"), (2, "die katze", "b", "de"), (3, None, "c", None), (3, None, "c", None), (4, "", "d", "xx")], schema)
    labelled = docs.select("doc_id", F.col("lang").alias("domain"))
    assert mixing.mix(docs, labelled, {"en": 0.5, "de": 0.5}).columns == docs.columns
    assert mixing.mix(docs, labelled.where("domain = 'nothing'"), {"en": 1.0}).count() == 5
    assert mixing.mix(spark.createDataFrame([], schema), labelled, {"en": 1.0}).count() == 0


# --- pipeline ---


def test_pipeline_stages_keep_columns_and_clean_documents(spark):
    import corpus_pipeline
    from glossweave.llm.common import materialize
    from glossweave.llm.decontam import words_of

    sf = "/root/testdata/sf0.01"
    docs = read_table(spark, sf, "documents")
    passages = [w for r in read_table(spark, sf, "benchmark").collect() if len(w := words_of(r.text)) >= 10]
    grams = {tuple(w[k : k + 10]) for w in passages for k in range(len(w) - 9)}
    labels = {r.doc_id: r for r in read_table(spark, sf, "labels").collect()}
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf), name)
        sizes.append(docs.count())
        if name != "token_output":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        rows = {r.doc_id: r for r in docs.collect()}
        if name == "quality_classifier":
            clean = [i for i, r in labels.items() if r.quality == 1 and r.toxic == 0]
            assert sum(i in rows for i in clean) > 0.97 * len(clean)
            assert sum(i in rows for i, r in labels.items() if r.quality == 0) <= 0.15 * sum(r.quality == 0 for r in labels.values())
        if name == "simhash_near_dedup":
            texts = [r.text for r in rows.values()]
            assert len(set(texts)) == len(texts)
        if name == "benchmark_decontamination":
            for r in rows.values():
                w = words_of(r.text)
                assert not any(tuple(w[k : k + 10]) in grams for k in range(len(w) - 9))
            texts = {r.doc_id: r.text for r in before.collect()}
            assert sum(rows[i].text == t for i, t in texts.items() if i in rows) > 0.9 * len(texts)
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] and sizes[5] == sizes[4]


def test_balance_recall_and_work_of_the_registered_parameters():
    """50,000 vectors around 2,000 centres: lists of like size, recall of 0.9 with a quarter of the vectors at most."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(2_000, 24))[rng.integers(0, 2_000, 50_000)] + 0.45 * rng.normal(size=(50_000, 24))
    order = rng.permutation(len(v))
    sample = v[order[:20_000]]
    graph = ann.CentroidGraph(*ann.balanced_lists(sample[4_000:], round(len(v) / ann.LIST_SIZE)))
    prune, usual = ann.fitted_prune(graph, sample[:4_000], len(v))
    lists = ann.assign(v, graph)
    own = np.bincount([x[0] for x in lists], minlength=len(graph.centres))
    whole = np.bincount(np.concatenate(lists), minlength=len(graph.centres))
    assert np.percentile(own, 99) <= 4 * ann.LIST_SIZE and whole.sum() <= ann.COPIES * len(v)
    found = searched = 0
    for q in order[-200:]:
        chosen = graph.search(v[q], prune, usual, own, ann.K + 1)
        d = ((v - v[q]) ** 2).sum(1)
        d[q] = np.inf
        found += sum(not set(lists[j]).isdisjoint(chosen) for j in np.argsort(d)[:10])
        searched += whole[chosen].sum()
    assert found >= 0.9 * 2_000
    assert searched <= 0.25 * 200 * len(v)


def test_columns_named_like_internal_ones(spark):
    rows = [(k, f"word{k % 7} and text", "a", 1.5, "b", 2) for k in range(30)] + [(None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __n string, __p double, __rate string, __p1 int")
    labelled = spark.createDataFrame([(k, "x" if k % 2 else "y") for k in range(30)], "doc_id long, domain string")
    mixed = mixing.mix(docs, labelled, {"x": 0.5, "y": 0.5})
    assert mixed.columns == docs.columns and set(mixed.collect()) <= set(docs.collect())
    model = quality.train(docs, quality.graded(spark.createDataFrame([(k, k % 2, 0) for k in range(30)], "doc_id long, quality int, toxic int")))
    scored = quality.score(docs, model)
    assert scored.columns == [*docs.columns, *quality.RESULTS] and scored.count() == 31
