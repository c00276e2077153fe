"""SQL equivalents of the registered queries, for DuckDB over the same tables."""

from __future__ import annotations

from .operators.segment import ABBREVIATIONS, DIVISION_WORDS, ENGLISH_ORDINALS, FRENCH_ORDINALS, LATIN_ORDINALS

_ORDINALS = "|".join(LATIN_ORDINALS + FRENCH_ORDINALS + ENGLISH_ORDINALS)
_HEADING = rf"(?i:(^|[^\p{{L}}\p{{N}}_])({'|'.join(DIVISION_WORDS)}))\.?\s+([IVXLCDM]+|\d+|(?i:{_ORDINALS}))($|[^\p{{L}}\p{{N}}_])"
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def strip(x: str) -> str:
    return _STRIP.format(x)


_CHAPTERED = """
book AS (
  SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i:
    CASE WHEN (i - 1) % 3 = 0 AND NOT (i = 1 AND doc_id % 5 = 1)
      THEN CASE WHEN doc_id % 7 = 0 THEN 'BOOK II' || chr(10) ELSE '' END || 'CHAPTER ' || ((i - 1) // 3 + 1) || chr(10) ELSE '' END || x), chr(10)) AS text
  FROM documents)"""
_LINES = rf"""
raw AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM book),
each AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos FROM raw),
lines AS (
  SELECT doc_id, pos, line, coalesce(length({strip("line")}) BETWEEN 1 AND 140 AND (
    regexp_matches({strip("line")}, '^[IVXLCDM]{{1,7}}\.?$')
    OR (regexp_matches({strip("line")}, '{_HEADING}') AND len(regexp_split_to_array({strip("line")}, '\s+')) <= 20)), false) AS h
  FROM each)"""
_DIVISIONS = f"""
numbered AS (SELECT *, sum(h::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM lines),
found AS (
  SELECT doc_id, section, coalesce(max({strip("line")}) FILTER (h), '') AS title, {strip("string_agg(line, chr(10) ORDER BY pos) FILTER (NOT h)")} AS body
  FROM numbered GROUP BY doc_id, section HAVING count(*) FILTER (NOT h) > 0
  UNION ALL SELECT doc_id, 0, '', text FROM book WHERE doc_id NOT IN (SELECT doc_id FROM lines WHERE NOT h)),
divs AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY section) AS div_idx, title, body FROM found)"""
_WITH_DIVISIONS = f"WITH {_CHAPTERED},{_LINES},{_DIVISIONS}"

_ABBREV = ", ".join(f"'{a}'" for a in ABBREVIATIONS)


def _sentences(source: str, keys: str) -> str:
    """CTEs ending in `sents` (keys, seg_idx, text); `source` has keys, text."""
    return f"""
para_lines AS (SELECT {keys}, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM {source}),
para_content AS (SELECT {keys}, pos, {strip("line")} AS line FROM para_lines WHERE {strip("line")} <> ''),
para_gaps AS (SELECT *, coalesce(pos - lag(pos) OVER (PARTITION BY {keys} ORDER BY pos) - 1, 0) AS blank FROM para_content),
para_need AS (SELECT *, CASE WHEN count(*) FILTER (blank > 0) OVER (PARTITION BY {keys}) > 0 AND 2 * count(*) FILTER (blank = 1) OVER (PARTITION BY {keys}) > count(*) FILTER (blank > 0) OVER (PARTITION BY {keys}) THEN 2 ELSE 1 END AS need FROM para_gaps),
para_no AS (SELECT *, 1 + sum((blank >= need)::INT) OVER (PARTITION BY {keys} ORDER BY pos) AS para_idx FROM para_need),
paras AS (SELECT {keys}, para_idx, string_agg(line, ' ' ORDER BY pos) AS text FROM para_no GROUP BY {keys}, para_idx),
cut AS (SELECT {keys}, para_idx, string_split(regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '([.!?…])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS p FROM paras),
pieces AS (SELECT {keys}, para_idx, unnest(p) AS piece, unnest(range(len(p))) AS pos FROM cut),
tails AS (SELECT *, lag(piece) OVER (PARTITION BY {keys}, para_idx ORDER BY pos) AS prior FROM pieces WHERE piece <> ''),
joins AS (SELECT *, sum((NOT coalesce(lower(regexp_replace(regexp_extract(prior, '(\\S+)$', 1), '\\.+$', '')) IN ({_ABBREV}), false))::INT) OVER (PARTITION BY {keys}, para_idx ORDER BY pos) AS sent FROM tails),
merged AS (SELECT {keys}, para_idx, sent, string_agg(piece, ' ' ORDER BY pos) AS text FROM joins GROUP BY {keys}, para_idx, sent),
sents AS (SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY para_idx, sent) AS seg_idx, text FROM merged)"""


_LINE_BEADS = """
bead_lines AS (SELECT doc_id AS book_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
beads AS (SELECT book_id, pos + 1 AS bead_idx, line AS src, lead(line, 1, '') OVER (PARTITION BY book_id ORDER BY pos) AS tgt FROM bead_lines)"""


def _xml(x: str) -> str:
    return f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def _truncate(x: str, n: int) -> str:
    s = strip(x)
    return f"CASE WHEN length({s}) > {n} THEN regexp_replace(substring({s}, 1, {n}), '\\s+$', '') || '…' ELSE {s} END"


_ISSUES = f"""
batched AS (SELECT *, (bead_idx - 1) // 12 AS batch_no, (bead_idx - 1) % 12 + 1 AS ref FROM beads),
issues AS (
  SELECT book_id, bead_idx, batch_no, ref, CASE WHEN length(tgt) = 0 THEN 'misalignment' ELSE 'segmentation_error' END AS issue_type,
    CASE WHEN length(src) > 3 * length(tgt) THEN 'high' WHEN length(tgt) > 3 * length(src) THEN 'medium' ELSE 'low' END AS severity,
    'sizes ' || length(src) || ' and ' || length(tgt) AS note, {_truncate("src", 160)} AS src_excerpt, {_truncate("tgt", 160)} AS tgt_excerpt
  FROM batched WHERE length(src) > 3 * length(tgt) OR length(tgt) > 3 * length(src) OR length(src) > 900)"""

_TURNS = """
users AS (SELECT conv_id AS book_id, turn, text AS s FROM conversations WHERE role = 'user'),
answers AS (SELECT conv_id AS book_id, turn - 1 AS turn, text AS t FROM conversations WHERE role = 'assistant'),
pairs AS (SELECT book_id, turn AS ch_idx, s, t FROM users JOIN answers USING (book_id, turn))"""


def _poly() -> str:
    from .functions.numeric import _ERFC

    out = repr(_ERFC[-1])
    for c in reversed(_ERFC[:-1]):
        out = f"({c!r} + t * {out})"
    return out


ORACLES = {
    "q_outline_injected": f"{_WITH_DIVISIONS} SELECT doc_id, div_idx AS index, CASE WHEN title = '' THEN '(front matter / untitled)' ELSE title END AS title, length(body) AS chars FROM divs",
    "q_divisions": f"{_WITH_DIVISIONS} SELECT doc_id, div_idx, title, md5(body) AS body_md5 FROM divs",
    "q_headings": f"WITH {_CHAPTERED},{_LINES} SELECT doc_id, count(*) AS n_lines, count(*) FILTER (h) AS n_headings FROM lines GROUP BY doc_id",
    "q_boilerplate": f"SELECT doc_id, md5({strip('text')}) AS text_md5 FROM documents",
    "q_range": f"{_WITH_DIVISIONS} SELECT doc_id, div_idx, title FROM divs WHERE div_idx BETWEEN 2 AND 5",
    "q_paragraphs": "WITH spaced AS (SELECT doc_id, replace(text, chr(10), CASE WHEN doc_id % 2 = 0 THEN chr(10) || chr(10) ELSE chr(10) || chr(10) || chr(10) END) AS text FROM documents),"
    + _sentences("spaced", "doc_id").split("cut AS")[0].rstrip().rstrip(",")
    + " SELECT doc_id, para_idx::BIGINT AS para_idx, text FROM paras",
    "q_sentences": f"WITH {_sentences('documents', 'doc_id')} SELECT doc_id, seg_idx, text FROM sents",
    "q_sentence_stats": f"WITH {_sentences('documents', 'doc_id, lang')} SELECT lang, count(*) AS n_segments, count(DISTINCT doc_id) AS n_docs, round(avg(length(text)), 4) AS avg_chars FROM sents GROUP BY lang",
    "q_verse_lines": f"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {strip("x")}), lambda x: x <> '') AS v FROM documents)
SELECT doc_id, unnest(range(1, len(v) + 1)) AS seg_idx, unnest(v) AS text FROM l""",
    "q_segment_dispatch": f"""WITH prose AS (SELECT * FROM documents WHERE doc_id % 2 <> 0), {_sentences("prose", "doc_id")},
verse AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE doc_id % 2 = 0),
both_ AS (SELECT doc_id, text FROM sents UNION ALL SELECT doc_id, {strip("line")} FROM verse WHERE {strip("line")} <> '')
SELECT doc_id, count(*) AS n_segments, sum(length(text))::BIGINT AS chars FROM both_ GROUP BY doc_id""",
    "q_merge_blocks": r"""WITH RECURSIVE b AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
walk AS (
  SELECT doc_id, pos, 1::BIGINT AS para, length(t) AS chars, (length(t) + 1)::BIGINT AS n, length(t) + 1 >= 420 AND right(regexp_replace(t, '\s+$', ''), 1) IN ('.', '!', '?', '”', '’') AS full_ FROM b WHERE pos = 0
  UNION ALL
  SELECT b.doc_id, b.pos, CASE WHEN w.full_ THEN w.para + 1 ELSE w.para END, CASE WHEN w.full_ THEN length(t) ELSE w.chars + 1 + length(t) END, CASE WHEN w.full_ THEN 0 ELSE w.n END + length(t) + 1,
    CASE WHEN w.full_ THEN 0 ELSE w.n END + length(t) + 1 >= 420 AND right(regexp_replace(t, '\s+$', ''), 1) IN ('.', '!', '?', '”', '’')
  FROM walk w JOIN b ON b.doc_id = w.doc_id AND b.pos = w.pos + 1)
SELECT doc_id, para AS para_idx, (para - 1) // 5 + 1 AS part, max(chars)::BIGINT AS chars FROM walk GROUP BY doc_id, para""",
    "q_clean": rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
m AS (SELECT doc_id, pos, CASE (doc_id + pos) % 6 WHEN 0 THEN 'XIV.--' || line WHEN 1 THEN ' 12. — ' || line WHEN 2 THEN 'Produced by ' || line WHEN 3 THEN '  ' WHEN 4 THEN 'I — ' || line ELSE line END AS text FROM l),
c AS (SELECT doc_id, pos, {strip("regexp_replace(text, '^" + chr(92) + "s*([IVXLCDM]{1,7}|" + chr(92) + "d{1,3})" + chr(92) + "." + chr(92) + "s*(--|—|–)" + chr(92) + "s*', '')")} AS text FROM m
  WHERE NOT regexp_matches(text, '(?i)^\s*(produced by|transcribed|prepared by|end of\b|\*\*\*)'))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS seg_idx, text FROM c WHERE text <> ''""",
    "q_word_bag": r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{Nl}\p{No}]+')) AS token FROM documents),
b AS (SELECT doc_id, token, count(*) AS cnt FROM t GROUP BY ALL)
SELECT doc_id, count(*) AS n_words, sum(cnt)::BIGINT AS n_tokens, max(cnt) AS most, round(sqrt(sum(cnt * cnt)), 4) AS norm FROM b GROUP BY doc_id""",
    "q_cosine": r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{Nl}\p{No}]+')) AS token FROM documents),
b AS (SELECT doc_id, token, count(*) AS cnt FROM t GROUP BY ALL), n AS (SELECT doc_id, sqrt(sum(cnt * cnt)) AS norm FROM b GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS "left", c.doc_id AS "right" FROM documents a JOIN documents c ON c.doc_id = a.doc_id + 1),
d AS (SELECT p."left", p."right", sum(x.cnt * y.cnt) AS dot FROM pairs p JOIN b x ON x.doc_id = p."left" JOIN b y ON y.doc_id = p."right" AND y.token = x.token GROUP BY ALL)
SELECT p."left", p."right", round(coalesce(dot / (x.norm * y.norm), 0), 6) AS cosine FROM pairs p LEFT JOIN d USING ("left", "right") LEFT JOIN n x ON x.doc_id = p."left" LEFT JOIN n y ON y.doc_id = p."right" """,
    "q_length_ratio": f"WITH {_TURNS} SELECT book_id, round(coalesce(nullif(sum(length(t)), 0), 1) / coalesce(nullif(sum(length(s)), 0), 1), 6) AS ratio FROM pairs GROUP BY book_id",
    "q_length_cost": f"""WITH {_TURNS},
z AS (SELECT book_id, ch_idx, length(s)::DOUBLE AS a, length(t)::DOUBLE AS b, abs((b - a * 2.5) / sqrt(greatest(a * 6.8, 1.0))) / sqrt(2.0) AS x, 1.0 / (1.0 + 0.5 * x) AS t FROM pairs)
SELECT book_id, ch_idx, round(CASE WHEN a = 0 AND b = 0 THEN 0.0 ELSE -ln(greatest(t * exp(-x * x + {_poly()}), 1e-12)) END - ln(0.89), 4) AS cost FROM z""",
    "q_zip_pairs": f"""WITH {_TURNS},
u AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY turn) AS k, count(*) OVER (PARTITION BY book_id) AS n FROM users),
v AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY turn) AS k, count(*) OVER (PARTITION BY book_id) AS n FROM answers),
ids AS (SELECT book_id FROM users UNION SELECT book_id FROM answers),
c AS (SELECT book_id, coalesce((SELECT count(*) FROM users u2 WHERE u2.book_id = ids.book_id), 0) AS nu, coalesce((SELECT count(*) FROM answers a2 WHERE a2.book_id = ids.book_id), 0) AS na FROM ids),
us AS (SELECT book_id, string_agg(s, chr(10) || chr(10) ORDER BY turn) AS s FROM users GROUP BY book_id), vs AS (SELECT book_id, string_agg(t, chr(10) || chr(10) ORDER BY turn) AS t FROM answers GROUP BY book_id)
SELECT u.book_id, u.k AS ch_idx, 'T' || v.turn AS title, md5(u.s) AS s_md5, md5(v.t) AS t_md5 FROM u JOIN v ON u.book_id = v.book_id AND u.k = v.k WHERE u.n = v.n AND u.n > 1
UNION ALL SELECT c.book_id, 1, '', md5(coalesce(s, '')), md5(coalesce(t, '')) FROM c LEFT JOIN us USING (book_id) LEFT JOIN vs USING (book_id) WHERE NOT (nu = na AND nu > 1)""",
    "q_align_coverage": f"""WITH {_TURNS}, s1 AS (SELECT book_id, ch_idx, s AS text FROM pairs), t1 AS (SELECT book_id, ch_idx, t AS text FROM pairs),
a AS (WITH {_sentences("s1", "book_id, ch_idx")} SELECT book_id, ch_idx, count(*) AS n_src FROM sents GROUP BY ALL),
b AS (WITH {_sentences("t1", "book_id, ch_idx")} SELECT book_id, ch_idx, count(*) AS n_tgt FROM sents GROUP BY ALL)
SELECT book_id, ch_idx, coalesce(n_src, 0) AS n_src, coalesce(n_tgt, 0) AS n_tgt FROM a FULL JOIN b USING (book_id, ch_idx)""",
    "q_single_block": f"""WITH {_TURNS}, ids AS (SELECT book_id FROM users UNION SELECT book_id FROM answers),
us AS (SELECT book_id, string_agg(s, chr(10) || chr(10) ORDER BY turn) AS s FROM users GROUP BY book_id), vs AS (SELECT book_id, string_agg(t, chr(10) || chr(10) ORDER BY turn) AS t FROM answers GROUP BY book_id)
SELECT book_id, md5(coalesce(s, '')) AS s_md5, md5(coalesce(t, '')) AS t_md5 FROM ids LEFT JOIN us USING (book_id) LEFT JOIN vs USING (book_id)""",
    "q_build": f"""{_WITH_DIVISIONS},
src AS (SELECT doc_id AS book_id, div_idx, title, body FROM divs WHERE doc_id % 2 = 0 AND doc_id + 1 IN (SELECT doc_id FROM documents)),
tgt AS (SELECT doc_id - 1 AS book_id, div_idx, title, body FROM divs WHERE doc_id % 2 = 1 AND doc_id - 1 IN (SELECT doc_id FROM documents)),
n AS (SELECT book_id, count(*) FILTER (o = 's') AS ns, count(*) FILTER (o = 't') AS nt FROM (SELECT book_id, 's' AS o FROM src UNION ALL SELECT book_id, 't' FROM tgt) GROUP BY book_id),
zipped AS (SELECT book_id, s.div_idx AS ch_idx, CASE WHEN t.title <> '' THEN t.title ELSE s.title END AS title, s.body AS s, t.body AS t FROM src s JOIN tgt t USING (book_id, div_idx) JOIN n USING (book_id) WHERE ns = nt AND ns > 1),
whole AS (SELECT book_id, 1 AS ch_idx, '' AS title, coalesce((SELECT string_agg(body, chr(10) || chr(10) ORDER BY div_idx) FROM src x WHERE x.book_id = n.book_id), '') AS s, coalesce((SELECT string_agg(body, chr(10) || chr(10) ORDER BY div_idx) FROM tgt x WHERE x.book_id = n.book_id), '') AS t FROM n WHERE NOT (ns = nt AND ns > 1)),
pairs AS (SELECT * FROM zipped UNION ALL SELECT * FROM whole)
SELECT book_id, ch_idx, title, len(list_filter(string_split(s, chr(10)), lambda x: {strip("x")} <> '')) AS n_src, len(list_filter(string_split(t, chr(10)), lambda x: {strip("x")} <> '')) AS n_tgt FROM pairs""",
    "q_pages_gutter_cover": """WITH s AS (SELECT source, sum(length(text))::BIGINT AS chars, greatest(24, round_even(sum(length(text)) / 1400, 0))::BIGINT AS pages FROM documents GROUP BY source)
SELECT source, chars, pages, CASE WHEN pages <= 150 THEN 0.375 WHEN pages <= 300 THEN 0.5 WHEN pages <= 500 THEN 0.625 WHEN pages <= 700 THEN 0.75 ELSE 0.875 END::DOUBLE AS gutter,
  round(0.25 + 12.0 + greatest(0.06, pages * 0.0025::DOUBLE), 6) AS width, 9.25::DOUBLE AS height, round(greatest(0.06, pages * 0.0025::DOUBLE), 6) AS spine FROM s""",
    "q_book_measures": f"""WITH {_LINE_BEADS}, s AS (SELECT book_id, count(*) AS n_beads, sum(length({strip("src")}) + length({strip("tgt")}))::BIGINT AS chars FROM beads GROUP BY book_id),
p AS (SELECT *, greatest(24, round_even(chars / 1400, 0))::BIGINT AS pages FROM s) SELECT *, round(greatest(0.06, pages * 0.002252::DOUBLE), 6) AS spine FROM p""",
    "q_slug": "SELECT p_partkey, coalesce(nullif(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'book') AS slug, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS key FROM part",
    "q_escape": f"SELECT page_id, md5(replace({_xml('html')}, '\"', '&quot;')) AS html_md5, md5({_xml('html')}) AS xml_md5 FROM pages",
    "q_xhtml": f"""WITH {_LINE_BEADS},
x AS (SELECT book_id, bead_idx, {_xml(strip("src"))} AS s, {_xml(strip("tgt"))} AS t, CASE WHEN bead_idx = 1 THEN ' opener' ELSE '' END AS o FROM beads),
y AS (SELECT book_id, bead_idx, concat_ws(chr(10), CASE WHEN t <> '' THEN '<p class="src' || o || '">' || t || '</p>' END, CASE WHEN s <> '' THEN '<p class="tgt' || o || '">' || s || '</p>' END) AS m FROM x)
SELECT book_id, md5(string_agg(m, chr(10) ORDER BY bead_idx)) AS xhtml_md5 FROM y GROUP BY book_id""",
    "q_batches": f"WITH {_LINE_BEADS} SELECT book_id, (bead_idx - 1) // 12 AS batch_no, count(*) AS n, max((bead_idx - 1) % 12 + 1) AS last_ref FROM beads WHERE bead_idx <= 30 GROUP BY ALL",
    "q_prompts": f"""WITH {_LINE_BEADS}, p AS (SELECT book_id, (bead_idx - 1) // 12 AS batch_no, (bead_idx - 1) % 12 + 1 AS ref,
  coalesce(nullif({_truncate("src", 300)}, ''), '(empty)') AS s, coalesce(nullif({_truncate("tgt", 300)}, ''), '(empty)') AS t FROM beads WHERE bead_idx <= 30)
SELECT book_id, batch_no, count(*) AS n, md5(string_agg(ref || '. SRC(la): ' || s || chr(10) || '   TGT(en): ' || t, chr(10) ORDER BY ref)) AS prompt_md5 FROM p GROUP BY ALL""",
    "q_findings_report": f"""WITH {_LINE_BEADS},{_ISSUES},
e AS (SELECT book_id, count(*) AS n, count(*) FILTER (severity = 'high') AS n_high,
  '# Segment review — ' || count(*) || ' flagged bead(s)' || chr(10) || chr(10) || string_agg('## [' || upper(severity) || '] Chapter 1 — bead ' || bead_idx || ' (' || issue_type || ')' || chr(10) || '- ' || note || chr(10) || '- SRC: ' || src_excerpt || chr(10) || '- TGT: ' || tgt_excerpt || chr(10), chr(10)
    ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, bead_idx) AS report FROM issues GROUP BY book_id)
SELECT d.doc_id AS book_id, coalesce(n, 0) AS n, coalesce(n_high, 0) AS n_high, md5(coalesce(report, '# Segment review' || chr(10) || chr(10) || 'No issues flagged.' || chr(10))) AS report_md5 FROM documents d LEFT JOIN e ON e.book_id = d.doc_id""",
    "q_restyle": f"WITH {_LINE_BEADS} SELECT book_id, bead_idx, md5(replace(tgt, 'e', 'E')) AS tgt_md5 FROM beads",
    "q_catalog_json": """SELECT 99::BIGINT AS count, page_id % 2 = 0 AS has_next, page_id AS id, CASE WHEN page_id % 7 <> 0 THEN url ELSE '(untitled)' END AS title,
  CASE WHEN page_id % 4 = 0 THEN 'Unknown' ELSE 'Doe, J., A' || page_id END AS authors, 'en' AS languages, CASE WHEN page_id % 2 = 0 THEN page_id * 10 ELSE 0 END AS downloads, page_id % 3 = 0 AS has_text FROM pages""",
    "q_fonts_catalog": """SELECT * FROM (VALUES (1::BIGINT, 'cardo', 'Cardo', 'serif', true, true, true), (2, 'ebgaramond', 'EB Garamond', 'serif', true, true, false), (3, 'unifrakturcook', 'UnifrakturCook', 'medieval', false, false, true),
  (4, 'gfsdidot', 'GFS Didot', 'greek', true, false, false), (5, 'bold', 'Bold', 'other', NULL, false, true), (6, 'myown', 'My Own', 'other', NULL, true, true)) t(rank, id, label, category, greek, has_italic, has_bold)""",
    "q_font_categories": "SELECT * FROM (VALUES ('serif', 'Cardo|EB Garamond'), ('medieval', 'UnifrakturCook'), ('greek', 'GFS Didot'), ('other', 'Bold|My Own')) t(category, labels)",
    "q_toc": f"""{_WITH_DIVISIONS}, t AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM divs WHERE title <> '')
SELECT doc_id AS book_id, div_idx AS ch_idx, row_number() OVER (PARTITION BY doc_id ORDER BY div_idx) AS entry, title FROM t WHERE n >= 2""",
    "q_copyright": f"""WITH j AS (SELECT s_suppkey, s_name, s_suppkey % 3 AS k, CASE WHEN s_suppkey % 3 = 0 THEN s_name WHEN s_suppkey % 3 = 1 THEN s_name || ' & Sons' ELSE '' END AS holder FROM supplier)
SELECT s_suppkey, CASE WHEN s_suppkey % 10 = 0 THEN s_name ELSE concat_ws(chr(10),
  CASE WHEN holder <> '' THEN 'This parallel edition &mdash; its translation arrangement, typography, and design &mdash; copyright &copy;' || CASE WHEN s_suppkey % 2 = 0 THEN ' 2024' ELSE '' END || ' ' || {_xml("holder")} || '.' END,
  'The original ' || CASE k WHEN 0 THEN 'Latin' WHEN 1 THEN 'French' ELSE 'XX' END || ' text by ' || {_xml("'<' || s_name || '>'")} || ' is in the public domain.' ||
    CASE WHEN s_suppkey % 4 = 0 THEN ' The English translation by T. One is in the public domain.' ELSE ' The English translation is in the public domain.' END || ' No copyright is claimed on these public-domain texts.',
  'Source texts: Project Gutenberg (www.gutenberg.org).' || CASE WHEN s_suppkey % 5 = 0 THEN ' Translation: from 1900' ELSE '' END) END AS paragraphs,
  concat_ws(chr(10), CASE WHEN k = 1 THEN s_name || ' &amp; Sons' END, CASE WHEN k = 2 THEN 'ISBN 978-1' END, 'Printed in the United States of America.') AS tail FROM j""",
    "q_render_plan": f"""WITH {_LINE_BEADS},
r AS (SELECT doc_id AS book_id, 0 AS bead_idx, 0 AS slot, 'chapter' AS kind, 'Title &lt;1&gt;' AS text FROM documents WHERE doc_id % 2 = 0
  UNION ALL SELECT book_id, bead_idx, 0, 'separator', '—' FROM beads WHERE bead_idx > 1
  UNION ALL SELECT book_id, bead_idx, 1, 'src', {_xml(strip("src"))} FROM beads UNION ALL SELECT book_id, bead_idx, 2, 'tgt', {_xml(strip("tgt"))} FROM beads),
s AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY bead_idx, slot) AS seq FROM r WHERE text <> '')
SELECT book_id, kind, count(*) AS n, sum(length(text))::BIGINT AS chars, max(seq) AS last_seq FROM s GROUP BY book_id, kind""",
    "q_parse_range": """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 1 THEN o_orderkey % 9 ELSE o_orderkey END AS first, o_orderkey AS last FROM orders""",
    "q_truncate": f"SELECT doc_id, {_truncate('text', 160)} AS excerpt FROM documents",
    "q_vector_pool": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
u AS (SELECT vec_id, v, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS u FROM v),
p AS (SELECT m.vec_id, m.v, list_transform(list_zip(a.u, b.u), lambda z: z[1] + z[2]) AS p FROM u m JOIN u a ON m.vec_id = a.vec_id + 1 JOIN u b ON m.vec_id = b.vec_id - 1)
SELECT vec_id, round(list_dot_product(v, p) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(p, p))), 6) AS cosine FROM p""",
}
