"""Decontamination, personal data, chat formatting and HTML against brute force and exact round trips."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from glossweave.llm import chat_format, decontam, html_extract, pii

DOCS = "doc_id long, text string, items string, n_chars long"


def rows_of(texts):
    return [(k, t, "x", len(t or "")) for k, t in enumerate(texts)]


# --- decontamination ---


def slow_contamination(text, items, window=10):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    hit, found = set(), set()
    for item, it in items:
        iw = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in it or ""))
        if not iw:
            continue
        n = min(window, len(iw))
        grams = {tuple(iw[k : k + n]) for k in range(len(iw) - n + 1)}
        for k in range(len(words) - n + 1):
            if tuple(words[k : k + n]) in grams:
                hit.update(range(k, k + n))
                found.add(item)
    return len(words), len(hit), found


@pytest.mark.parametrize("shard", [2_000_000, 20])
def test_contamination_matches_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(decontam, "SHARD_WORDS", shard)
    rng = random.Random(1)
    vocabulary = ["a", "B", "the", "é1", "word", "x"]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 25)))) for k in range(12)]
    items += [(20, None), (21, "rare phrase"), (22, "!!"), (23, items[3][1]), (20, "unique"), (None, "the")]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60))) for _ in range(50)]
    texts += [None, "", "...", "Rare, PHRASE! unique", items[5][1].upper(), texts[0], (items[2][1] + " zz ") * 30]
    docs = spark.createDataFrame(rows_of(texts), DOCS)
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = {r.doc_id: r for r in decontam.contamination(docs, bench).collect()}
    for k, text in enumerate(texts):
        n, hit, found = slow_contamination(text, [(i, t) for i, t in items if i is not None])
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        r = got[k]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, hit, len(found), digest, hit > 0), k


def test_spans_are_cut_and_clean_documents_left_alone(spark):
    passage = " ".join(f"q{k}" for k in range(14))
    texts = ["clean  text,\nas it is ", "Before it. " + passage.upper() + "! After it, more words stay here and there, so most of this document is its own and nothing else.", passage, None]
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    got = {r.doc_id: r for r in decontam.decontaminate(spark.createDataFrame(rows_of(texts), DOCS), bench).collect()}
    assert got[0].text == texts[0] and got[3].text is None and 2 not in got
    assert "q5" not in got[1].text.lower() and got[1].text.startswith("Before it. ") and got[1].text.endswith("nothing else.")
    assert got[1].n_chars == len(got[1].text) and got[1].items == "x"


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b", "x", 3)], DOCS)
    assert decontam.contamination(docs, bench).count() == 0
    assert [r.n_hit for r in decontam.contamination(one, bench).collect()] == [0]
    assert pii.find_pii(docs).count() == 0
    assert html_extract.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert chat_format.digest(chat_format.format_conversations(chat_format.as_log(spark.createDataFrame([], "conv_id long, turn long, role string, text string")))).count() == 0


# --- personal data ---


def slow_base(text):
    text, out = text or "", []

    def luhn(d):
        return sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0

    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False, "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def pii_texts():
    rng = random.Random(4)
    alphabet = ["a", "b", "@", ".", "x.y", "1", "25", "300", " ", "-", "+", "(", ")", "_", "é", "😀", "4111111111111111", "+1 (743) 555-3824", "10.0.0.1", "me@x.org"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    texts += [None, "", "a@b.c_d@e.f", "a@b.c.@d.e", "1.2.3.4.5.6.7.8", "0000255.1.1.1 256.1.1.1", "9" * 30_000, "a" * 50_000 + " x@y.z", "1." * 20_000, "b@" + "c." * 5_000 + "d", "+" + "1-" * 4_000, "call +1 (743) 555-3824.", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"']
    return texts + [texts[0], texts[0]]


def test_base_spans_match_brute_force(spark):
    texts = pii_texts()
    rows = [(None if k == 5 else k // 2, t, "x", k) for k, t in enumerate(texts)]
    got = sorted(((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.find_pii(spark.createDataFrame(rows, DOCS)).collect()), key=str)
    want = []
    for i, t, *_ in rows:
        spans = slow_base(t)
        digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        want.append((i, *[sum(k == x for k, _, _ in spans) for x in ("email", "ip", "card", "phone")], digest))
    assert got == sorted(want, key=str)


def test_added_spans_keep_base_spans_and_overlap_none(spark):
    hard = pii_texts()
    prose = [f"Some words of text number {k} and mail{k}@host.example.com or +1 (743) 555-38{k} and 19{k}.20.3.4 here" for k in range(10, 40)]
    texts = prose + [f"own number 1{k}0 7{k} 22" for k in range(10, 40)] + [f"My token = \"{k:x}4be64439e3e49cf46b2d7c90f3602a3d0b907ff\". " for k in range(16)] + [f"Call 555-{k}23-45{k}7 or Dr. Jane Miller" for k in range(9)]
    rows = pii.find_pii(spark.createDataFrame(rows_of(texts), DOCS)).collect()
    added = 0
    for r in rows:
        spans = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in r.spans.split(",") if x)]
        base = slow_base(texts[r.doc_id])
        assert set(base) <= set(spans)
        assert spans == sorted(spans, key=lambda s: (pii.KINDS.index(s[0]), s[1]))
        extra = [s for s in spans if s not in set(base)]
        added += len(extra)
        for k, a, b in extra:
            assert all(b <= x or a >= y for kind, x, y in spans if (kind, x, y) != (k, a, b))
    assert added > 5
    for r in pii.find_pii(spark.createDataFrame(rows_of(hard), DOCS)).collect():
        base = [f"{k}:{a}:{b}" for k, a, b in slow_base(hard[r.doc_id])]
        assert set(base) <= set(r.spans.split(",")) | {""}
        assert r.spans == "" or re.search("[0-9@]", hard[r.doc_id])


def test_reliabilities_follow_the_votes():
    counts = [("email", (1, 1, 1, 1, 1), 900), ("email", (-1, 0, -1, 0, 0), 700), ("phone", (1, 1, 0, 1, 1), 300), ("phone", (-1, 0, 0, -1, -1), 500)]
    w = pii.fit(counts)
    score = lambda kind, votes: w[""] + w[kind] + sum(w[f"{n}:{v}"] for n, v in zip(pii.LABELERS, votes, strict=True) if v)
    assert score("email", (1, 1, 1, 1, 1)) > 0 > score("email", (-1, 0, -1, 0, 0))
    assert score("phone", (1, 1, 0, 1, 1)) > 0 > score("phone", (-1, 0, 0, -1, -1))
    assert pii.fit([]) == {}


# --- chat formatting ---


def test_round_trip_of_hostile_texts(spark):
    rng = random.Random(2)
    parts = ["</s>", "[INST]", "[/INST]", "<|turn|>", "<|end|>", "\\", "<\\|", "<", "[", "<<SYS>>", "\n", "é😀", "ok", "<s>", "[\\/INST]", "$1", "\\n"]
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(1, 6)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "a\\b\nc", None]), None if rng.random() < 0.05 else "".join(rng.choice(parts) for _ in range(rng.randint(0, 12))), "x"))
    rows += [(99, 0, "assistant", "same", "x"), (99, 0, "assistant", "same", "x"), (98, None, "user", "", "x"), (None, 0, "user", "lost", "x")]
    data = chat_format.with_control_case(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, at string"))
    output = chat_format.format_conversations(chat_format.as_log(data))
    got = {r.conv_id: r for r in chat_format.digest(output).collect()}
    formatted = {r.conv_id: r.formatted for r in output.collect()}
    logs = {}
    for conv, turn, role, text, *_ in [*rows, (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]:
        if conv is not None:
            logs.setdefault(conv, []).append((-1 if turn is None else turn, role is not None, role or "", text is not None, text or ""))
    assert set(got) == set(logs)
    for conv, log in logs.items():
        log.sort()
        spelled = "".join(f"{role}\n{text}\n" for _, _, role, _, text in log)
        loss = "".join(text for _, _, role, _, text in log if role == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(log), hashlib.sha256(spelled.encode()).hexdigest()), conv
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest()), conv
        assert r.formatted_chars == len(formatted[conv])
        bare = formatted[conv].replace(chat_format.TURN, "").replace(chat_format.END, "")
        assert not any(c in bare for c in ("</s>", "[INST]", "[/INST]", "<|"))


def test_events_fold_into_final_messages(spark):
    log = [
        (1, 1, "message", 1, "user", "hi"), (1, 2, "delta", 2, "assistant", "he"), (1, 3, "delta", 2, "assistant", "llo"), (1, 4, "message", 3, "user", "more?"), (1, 5, "message", 4, "assistant", "no"),
        (1, 6, "regenerate", 2, "assistant", None), (1, 7, "delta", 2, "assistant", "bye"), (1, 8, "edit", 1, "user", "hey"), (1, 9, "message", 5, "user", "x"), (1, 10, "delete", 5, "user", None), (2, 1, "delta", 1, "assistant", "only"), (None, 1, "message", 1, "user", "y"),
    ]
    data = spark.createDataFrame(log, "conv_id long, seq long, kind string, message long, role string, text string")
    got = sorted((r.conv_id, r.at, r.role, r.text) for r in chat_format.final_messages(data).collect())
    assert got == [(1, 1, "user", "hey"), (1, 2, "assistant", "bye"), (2, 1, "assistant", "only")]
    masked = chat_format.render(chat_format.final_messages(data)).select(chat_format.masked_text(F.col("formatted"), F.col("loss_mask")).alias("m"), "conv_id").collect()
    assert {r.conv_id: r.m for r in masked} == {1: "bye", 2: "only"}


# --- HTML ---

ARTICLE = "<article><h1>T &amp; t</h1><p>One&nbsp; two<p>x<br>y <b>b</b><!-- c --></p><ul><li>item</ul><aside>side</aside><section class='comments'><p>me too</p></section></article>"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain  text", "plain text"),
        (f"<html><head><title>no</title></head><body><nav><a>home</a></nav><div class=ad>buy</div>{ARTICLE}<footer>f</footer>", "T & t\n\nOne two\n\nx y b\n\nitem"),
        ("<main><p>a</p><form><p>f</p></form><script>var x='<p>no</p>'</script><style>p{}</style><p>b</p></main><div>after</div>", "a\n\nb"),
        ("<div id='cookie-notice'>We use</div><p>" + "word " * 30 + "</p><p>tail</p><div class='sidebar'><p>" + "links " * 40 + "</p></div>", ("word " * 30).strip() + "\n\ntail"),
        ("<article>short</article><article>" + "longer " * 9 + "</article>", ("longer " * 9).strip()),
        ("<p>unclosed <b>bold<p>next &#233; &bogus; &lt;tag&gt;", "unclosed bold\n\nnext é &bogus; <tag>"),
    ],
)
def test_main_text(html, text):
    assert html_extract.main_text(html) == text


def test_every_page_of_the_table(spark):
    import html as entities

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r, source in zip(html_extract.extract_main_text(pages).orderBy("page_id").collect(), [x.html for x in pages.orderBy("page_id").collect()], strict=True):
        inner = re.search(r"<article>(.*)</article>", source, re.S)[1]
        blocks = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)\b[^>]*>", inner)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_hostile_html_ends_in_time():
    for source in ('<a "' * 50_000, "<p>" * 100_000, "<!--" * 100_000, '<div class="' * 50_000, "<" * 200_000):
        html_extract.main_text(source)


def test_contamination_over_several_passes(spark, monkeypatch):
    """Parts of a benchmark that are scanned one pass after the other find what one automaton finds."""
    rng = random.Random(7)
    vocabulary = ["a", "b", "the", "word"]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(8, 25)))) for k in range(12)]
    texts = [" ".join(rng.choice([*vocabulary, "other"]) for _ in range(200)) for _ in range(20)] + [None, items[0][1]]
    docs, bench = spark.createDataFrame(rows_of(texts), DOCS), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(decontam.contamination(docs, bench).drop("items").collect())
    monkeypatch.setattr(decontam, "SHARD_WORDS", 30)
    monkeypatch.setattr(decontam, "PASS_WORDS", 60)
    assert sorted(decontam.contamination(docs, bench).drop("items").collect()) == whole
    assert any(r.n_hit for r in whole)


def test_automaton_size_and_a_very_long_text():
    rng = random.Random(8)
    items = [(k, [b"w%d" % rng.randrange(5000) for _ in range(100)]) for k in range(500)]
    automaton = decontam.Automaton(items)
    assert automaton.bytes() <= 70 * 50_000
    words = [b"w%d" % rng.randrange(5000) for _ in range(200_000)]
    words[150_000:150_030] = items[7][1][40:70]
    assert automaton.scan(words) == ([(150_000, 150_030)], {7})


def test_columns_named_like_internal_ones(spark):
    passage = " ".join(f"q{k}" for k in range(14))
    text = passage + " and then so many other words that most of this document is its own and not from the passage"
    docs = spark.createDataFrame([(1, text, "a", 2, "b", 3)], "doc_id long, text string, __words string, __hit long, __kept string, __spans int")
    got = decontam.decontaminate(docs, spark.createDataFrame([(1, passage)], "item_id long, text string")).collect()
    assert [tuple(r) for r in got] == [(1, text[len(passage) + 1 :], "a", 2, "b", 3)]


def test_pages_of_the_table_without_article_tags(spark):
    """The distribution alone finds what it finds with the tags as a prior."""
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        bare = re.sub(r"</?(article|main)\b[^>]*>", "", r.html)
        assert html_extract.main_text(bare) == html_extract.main_text(r.html) == html_extract.main_text(r.html, use_articles=False)


PROSE = "A paragraph of the article that is long enough to stand out among the other lines of the page. " * 2


@pytest.mark.parametrize(
    ("html", "text"),
    [
        # class names of text inside an article drop nothing, containers of junk go
        (f"<article><p class='share price'>{PROSE}</p><p class='related'>b</p><p class=promo-code>c</p><div class='notice-board'>d</div><div class='ad'>x</div></article>", f"{PROSE.strip()}\n\nb\n\nc\n\nd"),
        # an aside without end tag ends with its parent
        (f"<article><p>{PROSE}</p><section><p>one</p><aside>side <p>more</p></section><p>two</p></article>", f"{PROSE.strip()}\n\none\n\ntwo"),
        # an unclosed advert before the article ends where that begins
        (f"<body><div class=ad>buy<article><p>{PROSE}</p></article>", PROSE.strip()),
        # wrapped paragraphs, short ones and headings among them, without an article
        (f"<div><div><h2>Head</h2></div><div><p>{PROSE}</p></div><div><div><p>short</p></div></div><div><p>{PROSE}</p></div></div>", f"Head\n\n{PROSE.strip()}\n\nshort\n\n{PROSE.strip()}"),
        # long text outside the article, lists of links inside
        (f"<div>{PROSE * 3}</div><article><h1>T</h1><p>{PROSE * 4}</p><ul><li><a>see here</a></li></ul></article><div>{PROSE}</div>", f"T\n\n{(PROSE * 4).strip()}"),
        # a very long text
        ("<p>" + "word " * 200_000 + "</p><p>end</p>", ("word " * 200_000).strip() + "\n\nend"),
    ],
)
def test_distribution_of_lines(html, text):
    assert html_extract.main_text(html) == text
