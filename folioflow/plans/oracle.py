"""DuckDB SQL for the registered queries, written apart from the Spark code: patterns suit RE2."""

from __future__ import annotations

from ..functions import fixed as V


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _re(p: str) -> str:
    """A fixed pattern for RE2: Java's Unicode switch is dropped."""
    return _q(p.replace("(?U)", "").replace("(?iu)", "(?i)"))


def _set(chars: str) -> str:
    return "[" + "".join("\\" + c if c in r"\[]^-&" else c for c in chars) + "]"


def _strip(e: str) -> str:
    return rf"regexp_replace({e}, '^\s+|\s+$', '', 'g')"


def _squeeze(e: str) -> str:
    return rf"regexp_replace({_strip(e)}, '\s+', ' ', 'g')"


def _count(e: str, p: str) -> str:
    return f"CAST(len(regexp_extract_all({e}, {_re(p)})) AS BIGINT)"


def _has(e: str, p: str) -> str:
    return f"regexp_matches({e}, {_re(p)})"


def _translatable(e: str) -> str:
    return rf"(len({_strip(e)}) >= 3 AND {_count(e, V.WORD3)} > 0 AND (CAST(len(regexp_replace({e}, '[\p{{L}}\p{{N}}\s]', '', 'g')) AS DOUBLE) / greatest(len({e}), 1) <= 0.45 OR {_count(e, V.WORD3)} >= 4))"


def _continues(e: str) -> str:
    t = rf"regexp_replace({e}, '\s+$', '')"
    return rf"(len({t}) > 0 AND regexp_matches({t}, '(?:;|\p{{Ll}}|[,，\-–])$') AND NOT regexp_matches({t}, '[.?!。？！:：]$'))"


def _label(e: str) -> str:
    return f"lower(regexp_replace({_squeeze(e)}, '[:：]+$', ''))"


def _is_label(e: str) -> str:
    return f"({_label(e)} IN ({', '.join(map(_q, V.CONTEXT_LABELS))}))"


def _appendix(e: str) -> str:
    s = _squeeze(e)
    return f"({_has(s, V.APPENDIX)} OR (len({s}) <= 140 AND len(regexp_replace(regexp_extract({s}, {_re(V.LETTER_HEADING)}, 1), '[^A-Z0-9]', '', 'g')) >= 4))"


def _map(table: dict[str, str], key: str) -> str:
    return f"(CASE {key} " + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in table.items()) + " END)"


def _phrase(e: str) -> str:
    key, proof = f"lower({_strip(e)})", r"^proof of (proposition|theorem|lemma|corollary)\s+([\w.]+)"
    return f"coalesce({_map(V.COMMON_HEADINGS, key)}, {_map(V.HEADING_PHRASES, key)}, CASE WHEN {_has(key, proof)} THEN {_map(V.PROOF_KINDS, f'regexp_extract({key}, {_re(proof)}, 1)')} || regexp_extract({key}, {_re(proof)}, 2) || '的证明' END)"


def _fixed_heading(e: str) -> str:
    s, numbered = _squeeze(e), r"^([A-Z](?:\.\p{Nd}+)*|\p{Nd}+(?:\.\p{Nd}+)*)\s+(.+)$"
    return f"(CASE WHEN {_has(s, numbered)} THEN regexp_extract({s}, {_re(numbered)}, 1) || ' ' || {_phrase(f'regexp_extract({s}, {_re(numbered)}, 2)')} ELSE {_phrase(s)} END)"


def _fixed_short(e: str) -> str:
    s = _squeeze(e)
    return f"(CASE WHEN {_has(s, V.CONFERENCE_HEADER)} THEN {_q(V.CONFERENCE_TRANSLATION)} WHEN {_is_label(s)} THEN {_map(V.CONTEXT_TRANSLATIONS, _label(s))} END)"


def _fixed_section(e: str) -> str:
    s, form = _squeeze(e), r"^([A-Z]+)\.\s+(.+)$"
    return f"(CASE WHEN {_has(s, form)} THEN regexp_extract({s}, {_re(form)}, 1) || '. ' || {_map(V.COMMON_HEADINGS | V.SECTION_HEADINGS_EXTRA, f'lower(regexp_extract({s}, {_re(form)}, 2))')} END)"


def _offline(e: str) -> str:
    return f"translate({e}, {_q(V.LATIN)}, {_q(V.OFFLINE)})"


def _masked(e: str) -> str:
    """Non-ASCII letters as underscores, so that RE2's word boundaries fall where Unicode ones do."""
    return rf"regexp_replace({e}, '[^\x00-\x7f]', '_', 'g')"


def _terms(e: str) -> str:
    low = ", ".join(map(_q, V.COMMON_HEADINGS))
    return rf"list_distinct(list_concat(list_filter(regexp_extract_all({_masked(e)}, '\b[A-Z][A-Z0-9-]{{1,}}\b'), lambda t: t NOT IN ('PDF', 'JSON')), list_filter(regexp_extract_all({_masked(e)}, '\b[A-Z][A-Za-z0-9-]{{2,}}\b'), lambda t: lower(t) NOT IN ({low}))))"


def _keeps(a: str, b: str) -> str:
    t = f"list_filter({_terms(a)}, lambda t: len(t) <= 20)"
    return f"(len({t}) = 0 OR len(list_filter({t}, lambda t: contains({b}, t))) >= greatest(1, len({t}) // 3))"


def _untranslated(a: str, b: str) -> str:
    word = r"'\b[A-Za-z][A-Za-z-]{2,}\b'"
    n, m, cjk = f"len(regexp_extract_all({_masked(a)}, {word}))", f"len(regexp_extract_all({_masked(b)}, {word}))", rf"len(regexp_extract_all({b}, '[\x{{3400}}-\x{{9fff}}]'))"
    return f"({n} >= 6 AND {cjk} < greatest(6, {n} // 4) AND {m} >= greatest(4, {n} // 2))"


def _suspicious(a: str, b: str) -> str:
    drift = f"(regexp_matches(lower({a}), '{'|'.join(V.GRAPH_TOPICS)}') AND {_has(b, V.GRAPH_DRIFT)}) OR (regexp_matches(lower({a}), '{'|'.join(V.NEURO_TOPICS)}') AND {_has(b, V.NEURO_DRIFT)})"
    return f"(NOT {_keeps(a, b)} OR {_untranslated(a, b)} OR {drift})"


def _bad_title(a: str, b: str) -> str:
    t = _strip(b)
    return f"({t} = '' OR len(regexp_extract_all({t}, '[。！？]')) > 1 OR len({t}) > greatest(70.0, len({a}) * 1.8))"


LINES = r"""ln AS (SELECT doc_id, CAST(i AS INT) AS block_id, line FROM (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL))"""

BLOCKS = rf"""{LINES},
b0 AS (SELECT doc_id, block_id, line, CAST(block_id // 8 AS INT) AS page_index, CAST(block_id % 8 AS INT) AS slot, CAST((doc_id * 7 + block_id * 5) % 29 AS INT) AS k, (doc_id + block_id) % 3 AS third FROM ln),
b1 AS (SELECT *, 54 + 258 * (slot // 4) AS cx, 60 + 170 * (slot % 4) AS cy, (k BETWEEN 1 AND 5 OR k BETWEEN 7 AND 11 OR k = 14) AS short FROM b0),
b2 AS (SELECT *, CASE WHEN k = 4 THEN 45 WHEN k = 9 THEN 740 WHEN k = 14 THEN 40 WHEN k = 5 AND slot % 4 > 0 THEN cy - 150 ELSE cy END AS yy FROM b1),
blocks AS (SELECT doc_id, block_id, page_index, slot, k,
  CAST(CASE WHEN k = 6 THEN 10 ELSE cx END AS DOUBLE) AS x0, CAST(yy AS DOUBLE) AS y0,
  CAST(CASE WHEN k = 6 THEN 30 WHEN k IN (3, 7) THEN cx + 90 WHEN page_index = 0 AND slot = 0 THEN 558 ELSE cx + 240 END AS DOUBLE) AS x1,
  CAST(yy + CASE WHEN short THEN 14 WHEN k = 6 THEN 200 WHEN k = 0 THEN 150 WHEN third = 1 THEN 100 ELSE 150 END AS DOUBLE) AS y1,
  CASE k WHEN 0 THEN 'Figure ' || block_id || ': ' || line WHEN 1 THEN '3.2 Method Overview' WHEN 2 THEN 'References' WHEN 3 THEN 'x = y + z' WHEN 4 THEN 'IEEE JOURNAL OF SYNTHETIC DATA 7' WHEN 5 THEN 'Method Dataset AUROC'
    WHEN 6 THEN 'arXiv:' || line WHEN 7 THEN 'where' WHEN 8 THEN 'A PROOFS AND DETAILS' WHEN 9 THEN 'Preprint. Under review.' WHEN 10 THEN 'IV. EXPERIMENTS' WHEN 11 THEN 'A. Baselines' WHEN 13 THEN '0.91 0.82 0.73 model'
    WHEN 14 THEN 'Published as a conference paper at ICLR' ELSE CASE WHEN third = 0 THEN line ELSE regexp_replace(line, '[.?!:]+$', '') END END AS text,
  CAST(CASE WHEN k = 4 THEN 8.0 WHEN k = 2 THEN 12.0 ELSE 9.0 + third / 2.0 END AS DOUBLE) AS font_size, CAST(CASE WHEN short THEN 1 ELSE 3 + block_id % 4 END AS INT) AS line_count,
  k = 15 AS bold, k = 16 AS italic, k = 17 AS leading_bold, CASE WHEN k = 2 THEN 'center' ELSE 'left' END AS align FROM b2)"""

_T = _strip("text")
FEATURES = rf"""{BLOCKS},
f0 AS (SELECT *, {_T} AS t, {_squeeze("text")} AS s, x1 - x0 AS w, y1 - y0 AS h FROM blocks),
feat AS (SELECT *, {_count("t", V.NUMBER)} AS n_num, {_count("t", V.DECIMAL)} AS n_dec, {_count("t", V.WORD1)} AS n_w1, {_count("t", V.WORD2)} AS n_w2, {_count("t", V.WORD3)} AS n_w3, {_count("t", r"O\(")} AS n_big_o, {_count("t", _set(V.MATH_BLOCK))} AS n_math,
  {_has("t", V.CAPTION)} AS caption, {" + ".join(f"CAST({_has('lower(t)', p)} AS BIGINT)" for p in V.TABLE_HEADERS)} AS header_score, count(*) OVER (PARTITION BY doc_id, page_index) AS page_blocks FROM f0),
feats AS (SELECT *, NOT contains(t, '.') AND header_score >= 2 AS table_header FROM feat)"""

ORDERED = rf"""{FEATURES},
o0 AS (SELECT *, (y0 <= 55 AND font_size <= 8.5 AND (contains(upper(s), {_q(V.JOURNAL_BANNER)}) OR ({_has("s", V.RUNNING_AUTHORS)} AND regexp_matches(s, '\s\p{{Nd}}+$')))) AS journal_header FROM feats),
o1 AS (SELECT *, bool_or(journal_header) OVER (PARTITION BY doc_id, page_index) AS ieee_page FROM o0),
o2 AS (SELECT *, (y1 < 220 AND w > 250) AS topb, (ieee_page AND page_index > 0 AND x0 > 306 AND y0 < 330 AND w > 180) AS aside FROM o1),
o3 AS (SELECT *, CASE WHEN topb THEN 0 WHEN aside THEN 1 ELSE 2 END AS band, CASE WHEN topb OR aside OR w > 612 * 0.65 OR x0 < 306 THEN 0 ELSE 1 END AS col, CAST(round_even(y0 / 3, 0) * 3 AS INT) AS y_bucket, CAST(regexp_matches(t, '^[a-z]\s*[=≤<>∈(]') AS INT) AS priority FROM o2),
ordered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY band, col, y_bucket, priority, x0, block_id) - 1 AS block_seq, row_number() OVER (PARTITION BY doc_id ORDER BY page_index, band, col, y_bucket, priority, x0, block_id) - 1 AS global_seq FROM o3)"""

REFS = rf"""{ORDERED},
starts AS (SELECT doc_id, page_index AS ref_page, y0 AS ref_y, x0 AS ref_x FROM ordered WHERE {_has("text", V.REFERENCES)} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY page_index, block_seq) = 1),
ends AS (SELECT o.doc_id, o.page_index AS ep, o.y0 AS ey FROM ordered o JOIN starts r USING (doc_id) WHERE (o.page_index > r.ref_page OR (o.page_index = r.ref_page AND o.y0 > r.ref_y)) AND ({_has("o.text", V.APPENDIX_OR_CHECKLIST)} OR {_appendix("o.text")})
  QUALIFY row_number() OVER (PARTITION BY o.doc_id ORDER BY o.page_index, o.block_seq) = 1),
pages_of AS (SELECT doc_id, max(page_index) + 1 AS np FROM ordered GROUP BY 1),
rng AS (SELECT r.*, coalesce(e.ep, p.np) AS ref_end_page, coalesce(e.ey, CAST('infinity' AS DOUBLE)) AS ref_end_y FROM starts r JOIN pages_of p USING (doc_id) LEFT JOIN ends e USING (doc_id))"""

_HEADING = rf"""(CASE WHEN (font_size >= 9 AND line_count <= 2 AND {_appendix("text")}) OR (font_size >= 9.5 AND line_count <= 2 AND n_w1 BETWEEN 2 AND 5 AND len(t) > 4 AND n_num = 0 AND upper(t) = t AND n_math = 0) THEN TRUE
  WHEN regexp_matches(t, '^\p{{Nd}}+(?:\.\p{{Nd}}+)*\s+.') AND line_count <= 2 AND n_w1 BETWEEN 1 AND 12 AND len(t) <= 120 THEN
    NOT regexp_matches({_strip(r"regexp_extract(t, '^\p{Nd}+(?:\.\p{Nd}+)*\s+(.+)', 1)")}, '^\p{{Nd}}') AND NOT regexp_matches({_strip(r"regexp_extract(t, '^\p{Nd}+(?:\.\p{Nd}+)*\s+(.+)', 1)")}, '^[A-Z]$') AND regexp_matches(regexp_extract(t, {_re(V.WORD1)}), '^[A-Z]')
  ELSE font_size >= 9 AND (bold OR font_size >= 11) AND n_w1 BETWEEN 1 AND 5 AND NOT regexp_matches(t, '\p{{Nd}}') AND len(t) BETWEEN 5 AND 80 AND len(list_filter(regexp_extract_all(t, {_re(V.WORD1)}), lambda x: NOT regexp_matches(x, '^[A-Z]'))) = 0 END)"""

FLAGS = rf"""{REFS},
g0 AS (SELECT o.*, r.ref_page, r.ref_y, r.ref_x, r.ref_end_page, r.ref_end_y FROM ordered o LEFT JOIN rng r USING (doc_id)),
g1 AS (SELECT *,
  (y0 >= 727 AND NOT regexp_matches(t, '^\p{{Nd}}+$') AND {_has("t", V.VERSION_FOOTER)}) AS version_footer, (y0 <= 65 AND {_has("s", V.CONFERENCE_HEADER)}) AS conference_header,
  CASE WHEN ref_page IS NULL OR page_index < ref_page OR page_index > ref_end_page THEN FALSE WHEN page_index = ref_page AND ref_y < 160 AND ref_x > 306 THEN x0 > 306 AND y0 >= ref_y - 4 WHEN page_index = ref_page AND y0 < ref_y - 4 THEN FALSE ELSE NOT (page_index = ref_end_page AND y0 >= ref_end_y - 4) END AS reference,
  (starts_with(t, 'arXiv:') OR (x1 < 45 AND h > 120) OR (w < 40 AND h > w * 5)) AS side_note,
  (CASE WHEN {_has("t", V.DATASET_PAIR)} THEN FALSE WHEN table_header THEN TRUE WHEN n_big_o >= 2 AND n_w1 <= 60 THEN TRUE WHEN t = {_q(V.TABLE_LABEL)} THEN TRUE WHEN {_has("t", V.TABLE_ROWS)} THEN TRUE WHEN {_has("t", V.TABLE_MODULE)} AND n_big_o > 0 THEN TRUE
    WHEN {_has("t", V.TABLE_FIRST)} AND line_count > 1 THEN TRUE WHEN (contains(t, 'Base-to-Novel') AND contains(t, 'Few-shot')) OR (contains(t, 'LSCE') AND contains(t, 'Base') AND contains(t, 'Novel')) THEN TRUE WHEN n_dec >= 3 AND n_num * 3 >= n_w1 THEN TRUE
    WHEN line_count >= 2 AND n_num >= 2 AND n_w1 <= 12 THEN TRUE WHEN regexp_matches(t, '[±✓✗]') AND n_num >= 3 AND n_num * 2 >= n_w1 THEN TRUE ELSE line_count >= 3 AND n_num >= 6 AND n_num * 3 >= n_w1 END) AS "table",
  ((n_math >= 2 AND n_w3 <= 4) OR (line_count <= 2 AND n_math >= 1 AND len(t) < 35)) AS formula,
  (regexp_matches(t, '^GT\s+\([a-z]\)') OR (page_index > 0 AND y1 < 180 AND font_size <= 8.5 AND n_w2 <= 8) OR (regexp_matches(t, '\([a-z]\)') AND y1 < 540 AND n_w3 <= 20 AND (w < 240 OR font_size <= 8.5)) OR (page_blocks > 40 AND y1 < 430 AND w < 220 AND n_w2 <= 12)) AS figure_label,
  (CASE WHEN page_index <> 0 OR regexp_matches(t, '(?i)^abstract$') OR regexp_matches(t, '(?i)^abstract\s*[—-]\s*\S') THEN FALSE WHEN ieee_page AND x0 > 306 AND y0 >= 180 THEN FALSE
    WHEN ieee_page AND (starts_with(t, 'Received ') OR starts_with(t, 'Digital Object Identifier') OR starts_with(t, '©') OR {_has("t", V.MEMBERSHIP)} OR contains(t, ' with the ') OR contains(t, ' is with the ') OR contains(lower(t), 'source code can be found')) THEN TRUE
    WHEN starts_with(t, '*') OR starts_with(t, '∗') THEN TRUE WHEN y0 > 692 THEN TRUE WHEN y0 < 130 THEN FALSE ELSE y0 < 220 END) AS metadata,
  {_HEADING} AS heading, (font_size >= 9 AND line_count <= 2 AND {_appendix("text")}) AS appendix,
  (regexp_matches(t, '^[A-Z]\.\s+[A-Z]') AND font_size >= 9 AND n_w1 BETWEEN 1 AND 12 AND len(t) <= 120) AS lettered,
  (regexp_extract(s, '^[IVX]+\.\s+(.+)$', 1) <> '' AND font_size >= 9 AND {_count(r"regexp_extract(s, '^[IVX]+\.\s+(.+)$', 1)", V.WORD1)} BETWEEN 1 AND 8 AND len(s) <= 90 AND upper(regexp_extract(s, '^[IVX]+\.\s+(.+)$', 1)) = regexp_extract(s, '^[IVX]+\.\s+(.+)$', 1)) AS roman,
  (align = 'center' AND font_size >= 14 AND line_count <= 4 AND w >= 250 AND n_w3 >= 4) AS title,
  {_has("t", V.DROP_CAP)} AS dropped, regexp_extract(t, {_re(V.DROP_CAP)}, 1) AS drop_heading, regexp_extract(t, {_re(V.DROP_CAP)}, 2) AS drop_letter,
  {_translatable("text")} AS translatable, {_continues("text")} AS continues FROM g0),
g2 AS (SELECT *, CASE WHEN journal_header OR conference_header OR version_footer OR reference OR side_note THEN FALSE WHEN caption THEN translatable WHEN "table" OR formula OR figure_label OR metadata THEN FALSE WHEN page_index = 0 AND y0 < 130 AND w > 250 THEN translatable
  WHEN ieee_page AND (dropped OR roman OR lettered) THEN w >= 25 WHEN heading THEN w >= 25 WHEN w < 170 THEN {_is_label("text")} ELSE translatable END AS body, (reference OR "table" OR formula OR figure_label) AS breaks FROM g1),
flags AS (SELECT *, (body AND NOT caption AND NOT heading AND align = 'left' AND NOT bold AND NOT italic AND NOT leading_bold AND w >= 170 AND font_size BETWEEN 6 AND 12) AS layout_body,
  (body AND align = 'left' AND NOT bold AND NOT italic AND NOT leading_bold AND line_count >= 2 AND w >= 170 AND font_size BETWEEN 6 AND 12) AS regular_body,
  (align = 'left' AND NOT bold AND NOT italic AND NOT caption AND line_count >= 2 AND w >= 170 AND font_size <= 12) AS body_like FROM g2)"""

_STOP = "({p}caption OR {p}heading OR ({p}ieee_page AND ({p}roman OR {p}lettered)) OR {p}bold)"
_KEEP = "closed page_index x0 y0 caption heading ieee_page roman lettered bold continues dropped drop_heading drop_letter".split()
UNITS = rf"""{FLAGS},
u0 AS (SELECT *, sum(CASE WHEN NOT body AND breaks THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY global_seq) AS closed FROM flags),
u1 AS (SELECT *, {", ".join(f"lag({c}) OVER (PARTITION BY doc_id ORDER BY global_seq) AS p_{c}" for c in _KEEP)} FROM u0 WHERE body),
u2 AS (SELECT *, (p_closed IS NULL OR p_closed <> closed) AS hard, coalesce(p_page_index = page_index AND ieee_page AND p_dropped AND abs(p_x0 - x0) <= 24 AND y0 - p_y0 BETWEEN 0 AND 40 AND {_has("text", V.CAPITAL_WORD)}, FALSE) AS capped,
  coalesce(NOT {_STOP.format(p="p_")} AND NOT {_STOP.format(p="")} AND NOT (ieee_page AND regexp_matches(text, '^\s*•')) AND p_continues AND CASE WHEN page_index = p_page_index THEN abs(p_x0 - x0) < 25 OR (p_x0 < 306 AND x0 > 306 AND y0 < p_y0) ELSE page_index = p_page_index + 1 AND y0 < 120 END, FALSE) AS mergeable FROM u1),
u3 AS (SELECT *, sum(CASE WHEN hard OR NOT ((NOT hard AND capped) OR mergeable) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY global_seq) AS island, (NOT hard AND capped) AS cap FROM u2),
u4 AS (SELECT doc_id, island, global_seq, text, cap, p_drop_heading AS lead, p_drop_letter AS letter, row_number() OVER (PARTITION BY doc_id, island ORDER BY global_seq) AS rn FROM u3),
walk AS (
  SELECT doc_id, island, rn, 0 AS sub, [global_seq] AS idx, [text] AS texts, CAST(len(text) AS BIGINT) AS total FROM u4 WHERE rn = 1
  UNION ALL
  SELECT u.doc_id, u.island, u.rn, CASE WHEN u.cap OR w.total + len(u.text) + len(w.texts) <= {V.MAX_UNIT_CHARS} THEN w.sub ELSE w.sub + 1 END,
    CASE WHEN u.cap OR w.total + len(u.text) + len(w.texts) <= {V.MAX_UNIT_CHARS} THEN list_append(w.idx, u.global_seq) ELSE [u.global_seq] END,
    CASE WHEN u.cap THEN list_concat(w.texts[1:len(w.texts) - 1], [u.lead, u.letter || u.text]) WHEN w.total + len(u.text) + len(w.texts) <= {V.MAX_UNIT_CHARS} THEN list_append(w.texts, u.text) ELSE [u.text] END,
    CASE WHEN u.cap THEN w.total - len(w.texts[len(w.texts)]) + len(u.lead) + len(u.letter) + len(u.text) WHEN w.total + len(u.text) + len(w.texts) <= {V.MAX_UNIT_CHARS} THEN w.total + len(u.text) ELSE len(u.text) END
  FROM walk w JOIN u4 u ON u.doc_id = w.doc_id AND u.island = w.island AND u.rn = w.rn + 1),
unit0 AS (SELECT doc_id, idx, array_to_string(texts, ' ') AS text FROM walk QUALIFY row_number() OVER (PARTITION BY doc_id, island, sub ORDER BY rn DESC) = 1),
units AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY idx[1]) - 1 AS unit_index, array_to_string(idx, ',') AS indexes, text FROM unit0)"""


def _batches(items: int, chars: int) -> str:
    return f"""bw AS (
  SELECT doc_id, unit_index, CAST(0 AS BIGINT) AS batch_id, 1 AS k, CAST(len(text) AS BIGINT) AS c FROM units WHERE unit_index = 0
  UNION ALL
  SELECT u.doc_id, u.unit_index, CASE WHEN b.k < {items} AND b.c + len(u.text) <= {chars} THEN b.batch_id ELSE b.batch_id + 1 END, CASE WHEN b.k < {items} AND b.c + len(u.text) <= {chars} THEN b.k + 1 ELSE 1 END, CASE WHEN b.k < {items} AND b.c + len(u.text) <= {chars} THEN b.c + len(u.text) ELSE len(u.text) END
  FROM bw b JOIN units u ON u.doc_id = b.doc_id AND u.unit_index = b.unit_index + 1)"""


_LAG = "block_seq layout_body version_footer x0 y0 x1 y1 w font_size continues".split()
GROUPS = rf"""{FLAGS},
tr AS (SELECT *, CASE WHEN body THEN {_offline("text")} ELSE text END AS translated FROM flags),
ch AS (SELECT *, {", ".join(f"lag({c}) OVER (PARTITION BY doc_id, page_index ORDER BY block_seq) AS p_{c}" for c in _LAG)} FROM tr WHERE translated <> text OR version_footer),
jn AS (SELECT *, coalesce(layout_body AND NOT version_footer AND p_layout_body AND NOT p_version_footer AND p_block_seq + 1 = block_seq AND y0 - p_y1 BETWEEN -2 AND greatest(28.0, p_font_size * 3.0) AND y0 >= p_y0 - 2 AND abs(p_x0 - x0) <= 24 AND abs(p_w - w) <= 36 AND abs(p_font_size - font_size) <= 1.5 AND (p_x0 < 306) = (x0 < 306), FALSE)
  AND NOT EXISTS (SELECT 1 FROM flags g WHERE g.doc_id = ch.doc_id AND g.page_index = ch.page_index AND g.heading AND abs(ch.p_x0 - ch.x0) <= 24 AND least(ch.p_x1, ch.x1, g.x1) - greatest(ch.p_x0, ch.x0, g.x0) > 20 AND g.y0 > least(ch.p_y1, ch.y1) AND g.y0 < greatest(ch.p_y0, ch.y0)) AS joins FROM ch),
gi AS (SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page_index ORDER BY block_seq) - 1 AS group_id FROM jn),
gp AS (SELECT *, sum(CASE WHEN joins AND NOT p_continues THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_index, group_id ORDER BY block_seq) AS par FROM gi),
par AS (SELECT doc_id, page_index, group_id, par, {_strip("string_agg(translated, '' ORDER BY block_seq)")} AS ptext FROM gp GROUP BY ALL),
ptx AS (SELECT doc_id, page_index, group_id, coalesce(string_agg(ptext, chr(10) || chr(10) ORDER BY par) FILTER (WHERE ptext <> ''), '') AS gtext FROM par GROUP BY ALL),
grp AS (SELECT doc_id, page_index, group_id, string_agg(CAST(block_seq AS VARCHAR), ',' ORDER BY block_seq) AS block_seqs, arg_min(version_footer, block_seq) AS vf, arg_min(layout_body, block_seq) AS lb, arg_min(translated, block_seq) AS t1, arg_min(font_size, block_seq) AS fs, arg_min(bold OR heading, block_seq) AS gbold, arg_min(italic, block_seq) AS gitalic, arg_min(leading_bold, block_seq) AS glead, arg_min(align, block_seq) AS galign, arg_min(heading, block_seq) AS ghead, arg_min(text, block_seq) AS gsource, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, CAST(sum(line_count) AS BIGINT) AS line_count FROM gp GROUP BY ALL)"""

_BOX = "struct_pack(x0 := {}, y0 := {}, x1 := {}, y1 := {})"
PLACED = rf"""{GROUPS},
gg AS (SELECT *, CASE WHEN vf THEN '' WHEN lb THEN gtext ELSE t1 END AS text, (vf OR (NOT lb AND t1 = '')) AS hidden, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY group_id) AS k FROM grp JOIN ptx USING (doc_id, page_index, group_id)),
placed AS (
  SELECT doc_id, page_index, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE)[]) AS used, CAST(NULL AS STRUCT(x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE)) AS box FROM gg GROUP BY ALL
  UNION ALL
  SELECT doc_id, page_index, k, CASE WHEN hidden THEN used ELSE list_append(used, box) END, CASE WHEN hidden THEN NULL ELSE box END FROM (
    SELECT doc_id, page_index, k, used, hidden, CASE WHEN ghead THEN {_BOX.format("x0 - 2", "y - 2", "x1 + 2", "y1 + greatest(3.0, fs * 0.35)")} ELSE {_BOX.format("x0", "y", "x1", "y1")} END AS box FROM (
      SELECT *, CASE WHEN moved.y0 >= y1 - 2 THEN y0 ELSE moved.y0 END AS y FROM (
        SELECT g.*, p.used, list_reduce(p.used, lambda a, u: CASE WHEN least(a.x1, u.x1) - greatest(a.x0, u.x0) > 20 AND least(a.y1, u.y1) - greatest(a.y0, u.y0) > 1 THEN {_BOX.format("a.x0", "greatest(a.y0, u.y1 + 1)", "a.x1", "a.y1")} ELSE a END, {_BOX.format("g.x0", "g.y0", "g.x1", "g.y1")}) AS moved
        FROM placed p JOIN gg g ON g.doc_id = p.doc_id AND g.page_index = p.page_index AND g.k = p.k + 1)))),
pg AS (SELECT g.*, p.box, NOT (gitalic OR glead OR contains(text, '**') OR regexp_matches(text, {_re(_set(V.CJK_CLOSING))})) AS fast FROM gg g JOIN placed p USING (doc_id, page_index, k))"""

_JOBS = """log AS (SELECT CAST(user_id AS VARCHAR) AS job_id, event_id AS seq, CASE event_id % 7 WHEN 0 THEN 'start' WHEN 1 THEN 'pages' WHEN 2 THEN 'blocks' WHEN 3 THEN 'log' WHEN 6 THEN CASE WHEN event_id % 5 = 0 THEN 'failed' ELSE 'done' END ELSE 'batch' END AS kind, event_type AS payload, event_id % 50 AS n FROM events),
st AS (SELECT *, CASE kind WHEN 'start' THEN 'running' WHEN 'done' THEN 'done' WHEN 'failed' THEN 'failed' END AS sts FROM log)"""
_STATE = f"""{_JOBS}, state AS (SELECT job_id, coalesce(arg_max(sts, seq) FILTER (WHERE sts IS NOT NULL), 'queued') AS status, coalesce(arg_max(n, seq) FILTER (WHERE kind = 'pages'), 0) AS pages, coalesce(arg_max(n, seq) FILTER (WHERE kind = 'blocks'), 0) AS blocks, coalesce(arg_max(n, seq) FILTER (WHERE kind = 'batch'), 0) AS batches_completed,
  CAST(count(*) FILTER (WHERE kind = 'log') AS BIGINT) AS n_logs, arg_max(payload, seq) FILTER (WHERE kind = 'failed') AS error, max(seq) AS last_seq FROM st GROUP BY job_id)"""

_MIXED = f"({_offline('substr(line, 1, len(line) // 2)')} || chr(10) || '<b>&' || substr(line, len(line) // 2 + 1))"
_CJK = r"\x{3400}-\x{9fff}\x{f900}-\x{faff}" + V.CJK_MARKS


def _escaped(e: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        e = f"replace({e}, {_q(a)}, {_q(b)})"
    return e


def _lead(e: str) -> str:
    return f"(CASE {' '.join(f'WHEN strpos({e}, {_q(m)}) - 1 > 0 AND strpos({e}, {_q(m)}) - 1 <= {n} THEN strpos({e}, {_q(m)})' for m, n in ((' ', 24), ('：', 28), (':', 28), ('。', 28), ('.', 28), ('，', 12)))} ELSE 0 END)"


_FLAG_NAMES = "caption table_header journal_header version_footer conference_header reference side_note table formula figure_label metadata heading appendix lettered roman title body breaks layout_body regular_body body_like continues translatable".split()
_CHECK = f"(CASE WHEN block_id % 3 = 0 THEN line ELSE {_offline('line')} END)"
_FIRST = f"(CASE WHEN block_id % 2 = 0 THEN line ELSE {_offline('line')} END)"
_SIZE = "round_even(greatest(4.5, {}) * 2, 0) / 2"


def _lines(runs: str, room: str) -> str:
    """Lines of runs (k: kind, n: glyphs), counted as (k: lines, n: half ems used)."""
    per, rest = f"greatest(1, {room} // 2)", f"greatest(0, r.n - greatest(0, ({room} - s.n) // 2))"
    at = lambda lines, used: f"struct_pack(k := CAST({lines} AS BIGINT), n := CAST({used} AS BIGINT))"  # noqa: E731
    more, cut = f"(({rest} + {per} - 1) // {per})", f"((r.n + {room} - 1) // {room} - 1)"
    word = f"CASE WHEN s.n + r.n <= {room} THEN {at('s.k', 's.n + r.n')} ELSE {at(f's.k + CASE WHEN s.n > 0 THEN 1 ELSE 0 END + {cut}', f'r.n - {cut} * {room}')} END"
    wide = f"CASE WHEN {rest} = 0 THEN {at('s.k', 's.n + 2 * r.n')} ELSE {at(f's.k + {more}', f'2 * ({rest} - ({more} - 1) * {per})')} END"
    blank = at("s.k", f"CASE WHEN s.n = 0 THEN 0 ELSE least({room}, s.n + r.n) END")
    return f"CASE WHEN len({runs}) = 0 THEN 0 ELSE list_reduce({runs}, lambda s, r: CASE r.k WHEN 3 THEN {word} WHEN 2 THEN {wide} WHEN 1 THEN {blank} ELSE {at('s.k + 1', '0')} END, {at('1', '0')}).k END"


_RUNS = rf"regexp_extract_all(replace(text, '**', ''), '\n|[ \t\x0b\f\r]+|[{_CJK}]+|[^ \t\n\x0b\f\r{_CJK}]+')"
_HEIGHTS = ", ".join(str(h) for h in [V.DEFAULT_LINE_HEIGHT] + [x for x in (1.1, 1.0) if x < V.DEFAULT_LINE_HEIGHT])
_UPPER = f"so AS (SELECT doc_id, font_size, row_number() OVER (PARTITION BY doc_id ORDER BY font_size) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM flags WHERE regular_body), bs AS (SELECT doc_id, {_SIZE.format('font_size')} AS body_size FROM so WHERE i = n // 2)"
FITS = rf"""{PLACED}, {_UPPER},
fz AS (SELECT p.*, galign = 'left' AND NOT gbold AND NOT gitalic AND NOT {_has("gsource", V.CAPTION)} AND line_count >= 2 AND box.x1 - box.x0 >= 170 AND fs <= 12 AS like_body, coalesce(body_size, fs) AS bsize, least(fs, CASE WHEN galign = 'center' OR gbold OR line_count <= 2 THEN 18.0 ELSE 10.0 END) AS other,
  list_transform({_RUNS}, lambda r: struct_pack(k := CAST(CASE WHEN r = chr(10) THEN 0 WHEN regexp_matches(r, '^[ 	
]') THEN 1 WHEN regexp_matches(r, '^[{_CJK}]') THEN 2 ELSE 3 END AS BIGINT), n := CAST(len(r) AS BIGINT))) AS runs FROM pg p LEFT JOIN bs USING (doc_id) WHERE NOT hidden),
fb AS (SELECT *, {_SIZE.format("CASE WHEN like_body THEN least(CASE WHEN bsize >= 9.5 THEN bsize - 1.0 WHEN bsize >= 8.5 THEN bsize - 0.5 ELSE bsize END, 9.5) ELSE other END")} AS base FROM fz),
fc AS (SELECT *, unnest(range(5)) AS i, {_SIZE.format("base - 0.5 * unnest(range(5))")} AS size FROM fb),
fd AS (SELECT *, unnest(CASE WHEN like_body THEN CAST([{_HEIGHTS}] AS DOUBLE[]) ELSE CAST([{V.DEFAULT_LINE_HEIGHT}] AS DOUBLE[]) END) AS lh FROM fc QUALIFY row_number() OVER (PARTITION BY doc_id, page_index, group_id, size ORDER BY i) = 1),
fe AS (SELECT *, i * 10 + row_number() OVER (PARTITION BY doc_id, page_index, group_id, i ORDER BY lh DESC) AS nth FROM fd),
ways AS (
  SELECT *, nth AS ord, 1.0::DOUBLE AS scale, 'fast' AS way, x1 - x0 AS bw, y1 - y0 AS bh FROM fe WHERE fast
  UNION ALL SELECT *, 1000 + nth, 1.0, 'html', box.x1 - box.x0, box.y1 - box.y0 FROM fe
  UNION ALL SELECT * EXCLUDE (last), 2000 + last.j, last.s, 'html', box.x1 - box.x0, box.y1 - box.y0 FROM (SELECT *, unnest([{", ".join(f"struct_pack(j := {j}, s := CAST({x} AS DOUBLE))" for j, x in enumerate(V.FIT_SCALES))}]) AS last FROM fe QUALIFY nth = max(nth) OVER (PARTITION BY doc_id, page_index, group_id))),
roomy AS (SELECT *, greatest(2, CAST(floor(2 * bw / (size * scale)) AS BIGINT)) AS room FROM ways),
counted AS (SELECT *, {_lines("runs", "room")} AS lines FROM roomy),
tried AS (SELECT *, round(bh - lines * (size * scale) * lh, 6) AS spare FROM counted),
fitted AS (SELECT * FROM tried WHERE spare >= 0 OR ord = {1999 + len(V.FIT_SCALES)} QUALIFY row_number() OVER (PARTITION BY doc_id, page_index, group_id ORDER BY ord) = 1)"""


def _fragments(e: str) -> str:
    return f"""array_to_string(list_transform(regexp_extract_all({e}, '\\n|[{_CJK}]+|[^\\n{_CJK}]+'), lambda r: CASE WHEN r = chr(10) THEN '<br>' ELSE '<span class="' || CASE WHEN regexp_matches(r, '^[{_CJK}]') THEN 'cjk' ELSE 'latin' END || '">' || {_escaped("r")} || '</span>' END), '')"""


def _styled(e: str, style: str) -> str:
    """Pieces between ** in turn plain and bold, each in a span of its style."""
    bold = f"CASE {style} WHEN 'italic' THEN 'bolditalic' WHEN 'bolditalic' THEN 'bolditalic' ELSE 'bold' END"
    return f"""array_to_string(list_transform(list_filter(list_transform(string_split({e}, '**'), lambda s, i: {{'s': s, 'b': i % 2 = 0}}), lambda p: p.s <> ''), lambda p: '<span class="' || CASE WHEN p.b THEN {bold} ELSE {style} END || '">' || {_fragments("p.s")} || '</span>'), '')"""


ORACLE_SQL = {
    "clean_text": rf"SELECT doc_id, {_strip(r"regexp_replace(regexp_replace(regexp_replace(replace(text, ' of ', '-' || chr(10) || 'of '), '([\p{L}\p{N}_])-\s*\n\s*([\p{L}\p{N}_])', '\1\2', 'g'), '\s*\n\s*', ' ', 'g'), '[ \t]+', ' ', 'g')")} AS cleaned FROM documents",
    "text_measures": rf"WITH {LINES} SELECT doc_id, block_id AS line_no, {_count('line', V.WORD3)} AS words, {_translatable('line')} AS translatable, {_continues('line')} AS continues, CAST(regexp_matches({_strip('line')}, '^[a-z]\s*[=≤<>∈(]') AS INT) AS priority, {_is_label('line')} AS label FROM ln",
    "source_terms": f"SELECT doc_id, array_to_string(list_sort({_terms('text')}), ' ') AS terms FROM documents",
    "html_fragments": f"WITH {LINES} SELECT doc_id, block_id AS line_no, {_fragments(_MIXED)} AS fragments FROM ln",
    "styled_html": f"""WITH {BLOCKS}, c AS (SELECT *, replace(text, ' of ', ' **of** ') AS t FROM blocks), e AS (SELECT *, CASE WHEN {_lead('t')} > 0 THEN {_lead('t')} ELSE strpos(t, '。') END AS cut FROM c)
        SELECT doc_id, block_id, CASE WHEN leading_bold AND cut > 0 THEN {_styled("substr(t, 1, cut)", "'bold'")} || {_styled("substr(t, cut + 1)", "'regular'")} ELSE {_styled("t", "CASE WHEN bold AND italic THEN 'bolditalic' WHEN bold THEN 'bold' WHEN italic THEN 'italic' ELSE 'regular' END")} END AS html FROM e""",
    "bold_segments": f"WITH {LINES}, sp AS (SELECT doc_id, block_id, line, string_split(replace(line, ' of ', ' **of** '), '**') AS p FROM ln), ex AS (SELECT doc_id, block_id, line, unnest(p) AS segment, unnest(range(len(p))) AS i FROM sp) SELECT doc_id, block_id AS line_no, CAST({_lead('line')} AS INT) AS lead, CAST(row_number() OVER (PARTITION BY doc_id, block_id ORDER BY i) - 1 AS INT) AS pos, segment, i % 2 = 1 AS bold FROM ex WHERE segment <> ''",
    "upload_names": r"WITH u AS (SELECT page_id, replace(url || CASE page_id % 3 WHEN 0 THEN '.PDF' WHEN 1 THEN '.pdf' ELSE '' END, '\', '/') AS c FROM pages), n AS (SELECT page_id, CASE WHEN ends_with(lower(string_split(c, '/')[-1]), '.pdf') THEN string_split(c, '/')[-1] END AS filename FROM u) SELECT page_id, filename, CASE WHEN len(filename) > 4 THEN filename[1:len(filename) - 4] ELSE filename END || '_zh-CN.pdf' AS output FROM n",
    "log_kinds": r"WITH c AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'Job ' WHEN 1 THEN 'ERROR ' WHEN 2 THEN 'saved: ' ELSE '' END || text AS c FROM conversations) SELECT conv_id, turn, CASE WHEN regexp_matches(c, 'ERROR|FAILED|CRITICAL') THEN 'error' WHEN regexp_matches(c, 'saved:|Done\.') THEN 'success' WHEN regexp_matches(c, '^Job|PDF:|OUT:') THEN 'system' ELSE 'plain' END AS kind FROM c",
    "doc_blocks": f"WITH {BLOCKS} SELECT * FROM blocks",
    "block_features": f"WITH {FEATURES} SELECT doc_id, block_id, n_num, n_dec, n_w1, n_w2, n_w3, n_big_o, n_math, page_blocks, header_score FROM feats",
    "block_flags": f"WITH {FLAGS} SELECT doc_id, block_id, " + ", ".join(f'"{c}"' for c in _FLAG_NAMES) + " FROM flags",
    "reading_order": f"WITH {ORDERED} SELECT doc_id, block_id, page_index, band, col, y_bucket, priority, ieee_page, block_seq, global_seq FROM ordered",
    "references_range": f"WITH {REFS} SELECT doc_id, ref_page, ref_y, ref_end_page FROM rng",
    "body_font_size": f"WITH {FLAGS}, so AS (SELECT doc_id, font_size, row_number() OVER (PARTITION BY doc_id ORDER BY font_size) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM flags WHERE regular_body) SELECT doc_id, round_even(font_size * 2, 0) / 2 AS body_size FROM so WHERE i = n // 2",
    "caption_trim": f"WITH {FEATURES}, hd AS (SELECT c.doc_id, c.block_id, min(o.y0) AS hy FROM feats c JOIN feats o ON c.doc_id = o.doc_id AND c.page_index = o.page_index AND c.block_id <> o.block_id WHERE c.caption AND o.table_header AND o.y0 > c.y0 AND o.y0 - c.y0 <= 25 AND least(c.x1, o.x1) - greatest(c.x0, o.x0) > 20 GROUP BY ALL) SELECT f.doc_id, f.block_id, f.y0, CASE WHEN hy IS NULL THEN f.y1 ELSE greatest(f.y0 + 6, least(f.y1, hy - 1)) END AS y1 FROM feats f LEFT JOIN hd USING (doc_id, block_id)",
    "font_candidates": f"""WITH {FLAGS}, so AS (SELECT doc_id, font_size, row_number() OVER (PARTITION BY doc_id ORDER BY font_size) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM flags WHERE regular_body), bs AS (SELECT doc_id, {_SIZE.format("font_size")} AS body_size FROM so WHERE i = n // 2),
        z AS (SELECT f.doc_id, block_id, body_like, coalesce(body_size, font_size) AS s, least(font_size, CASE WHEN align = 'center' OR bold OR line_count <= 2 THEN 18.0 ELSE 10.0 END) AS other FROM flags f LEFT JOIN bs ON bs.doc_id = f.doc_id),
        b AS (SELECT doc_id, block_id, body_like, {_SIZE.format("CASE WHEN body_like THEN least(CASE WHEN s >= 9.5 THEN s - 1.0 WHEN s >= 8.5 THEN s - 0.5 ELSE s END, 9.5) ELSE other END")} AS base FROM z),
        e AS (SELECT doc_id, block_id, base, body_like, min(i) AS i, size FROM (SELECT *, unnest(range(5)) AS i, {_SIZE.format("base - 0.5 * unnest(range(5))")} AS size FROM b) GROUP BY ALL)
        SELECT doc_id, block_id, base, string_agg(CASE WHEN body_like THEN {" || ' ' || ".join(f"size || '/{h}'" for h in [V.DEFAULT_LINE_HEIGHT] + [x for x in (1.1, 1.0) if x < V.DEFAULT_LINE_HEIGHT])} ELSE size || '/{V.DEFAULT_LINE_HEIGHT}' END, ' ' ORDER BY i) AS candidates FROM e GROUP BY doc_id, block_id, base""",
    "translation_units": f"WITH RECURSIVE {UNITS} SELECT * FROM units",
    "translation_batches": f"WITH RECURSIVE {UNITS}, {_batches(4, 3000)} SELECT doc_id, unit_index, batch_id FROM bw",
    "layout_groups": f"WITH {GROUPS} SELECT doc_id, page_index, CAST(group_id AS BIGINT) AS group_id, block_seqs, CASE WHEN vf THEN '' WHEN lb THEN gtext ELSE t1 END AS text, (vf OR (NOT lb AND t1 = '')) AS hidden, x0, y0, x1, y1, line_count FROM grp JOIN ptx USING (doc_id, page_index, group_id)",
    "rect_pushdown": f"WITH RECURSIVE {PLACED} SELECT doc_id, page_index, CAST(group_id AS BIGINT) AS group_id, CASE WHEN hidden THEN 'hidden' WHEN fast THEN 'fast' ELSE 'html' END AS mode, box.x0 AS x0, box.y0 AS y0, box.x1 AS x1, box.y1 AS y1 FROM pg",
    "text_fit": f"""WITH RECURSIVE {FITS} SELECT p.doc_id, p.page_index, CAST(p.group_id AS BIGINT) AS group_id, coalesce(way, 'hidden') AS mode, size, lh AS line_height, scale, CAST(lines AS BIGINT) AS lines, spare, spare >= 0 AS fits,
        CASE WHEN way = 'html' THEN 'body {{ margin: 0; font-size: ' || size || 'pt; line-height: ' || lh || '; text-align: ' || p.galign || '; }}' END AS css FROM pg p LEFT JOIN fitted f USING (doc_id, page_index, group_id)""",
    "cover_boxes": f"WITH {GROUPS} SELECT doc_id, page_index, block_seq, round(x0 - 0.8, 6) AS x0, round(y0 - 0.8, 6) AS y0, round(x1 + 0.8, 6) AS x1, round(y1 + 0.8, 6) AS y1 FROM tr WHERE translated <> text OR version_footer",
    "heading_glossary": f"WITH {BLOCKS}, x AS (SELECT doc_id, block_id, coalesce({_fixed_section('text')}, {_fixed_heading('text')}, {_fixed_short('text')}) AS fixed FROM blocks) SELECT * FROM x WHERE fixed IS NOT NULL",
    "heading_glossary_join": f"WITH {BLOCKS}, g(key, value) AS (VALUES {', '.join(f'({_q(k)}, {_q(v)})' for k, v in (V.HEADING_PHRASES | V.COMMON_HEADINGS).items())}) SELECT doc_id, block_id, value FROM blocks JOIN g ON g.key = lower({_squeeze('text')})",
    "translation_checks": f"WITH {LINES}, x AS (SELECT *, {_CHECK} AS o FROM ln) SELECT doc_id, block_id AS line_no, {_keeps('line', 'o')} AS keeps_terms, {_untranslated('line', 'o')} AS untranslated, {_suspicious('line', 'o')} AS suspicious, {_bad_title('line', 'o')} AS bad_title FROM x",
    "retry_merge": rf"WITH {LINES}, x AS (SELECT *, {_FIRST} AS a, {_offline('line')} AS b FROM ln) SELECT doc_id, block_id AS line_no, CASE WHEN {_suspicious('line', 'a')} AND (NOT {_suspicious('line', 'b')} OR (regexp_matches(b, '[\x{{3400}}-\x{{9fff}}]') AND NOT regexp_matches(a, '[\x{{3400}}-\x{{9fff}}]'))) THEN b ELSE a END AS kept FROM x",
    "sanitized": f"WITH {FLAGS}, x AS (SELECT *, {_offline('text')} AS o FROM flags WHERE body) SELECT doc_id, block_id, CASE WHEN NOT heading THEN o ELSE coalesce({_fixed_heading('text')}, CASE WHEN {_suspicious('text', _strip('o'))} OR {_bad_title('text', _strip('o'))} OR len({_strip('o')}) > greatest(28, len(text) * 3) OR contains({_strip('o')}, chr(10)) OR len(regexp_extract_all({_strip('o')}, '[。.]')) > 1 THEN text ELSE {_strip('o')} END) END AS kept FROM x",
    "missing_units": f"WITH RECURSIVE {UNITS} SELECT doc_id, unit_index FROM units WHERE (doc_id + unit_index) % 7 = 0",
    "provider_answers": f"WITH RECURSIVE {UNITS} SELECT doc_id, unit_index, {_offline('text')} AS translated, CAST(NULL AS VARCHAR) AS error FROM units",
    "prompt_json": f"""WITH {LINES} SELECT doc_id, '[' || string_agg('{{"id":' || block_id || ',"text":' || CAST(to_json(line) AS VARCHAR) || '}}', ',' ORDER BY block_id) || ']' AS prompt FROM ln GROUP BY doc_id""",
    "document_ledger": f"""WITH RECURSIVE {UNITS}, tx AS (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY 1), ds AS (SELECT doc_id, count(*) AS blocks FROM blocks GROUP BY 1),
        er AS (SELECT doc_id, min('ValueError: ' || len(text) || ' characters are over the limit of 600') AS e FROM units WHERE len(text) > 600 GROUP BY 1),
        j AS (SELECT doc_id, blocks, CASE WHEN toxic = 1 THEN 'invalid block: font size' ELSE e END AS error FROM ds LEFT JOIN tx USING (doc_id) LEFT JOIN er USING (doc_id)) SELECT doc_id, CASE WHEN error IS NULL THEN 'done' ELSE 'failed' END AS status, error, blocks FROM j""",
    "document_summary": f"""WITH RECURSIVE {UNITS}, {_batches(4, 4000)}, us AS (SELECT u.doc_id, count(*) AS units, max(b.batch_id) + 1 AS batches, CAST(sum(len(u.text)) AS BIGINT) AS chars, CAST(sum(CASE WHEN {_suspicious('u.text', _offline('u.text'))} THEN 1 ELSE 0 END) AS BIGINT) AS suspicious FROM units u JOIN bw b USING (doc_id, unit_index) GROUP BY 1),
        ds AS (SELECT doc_id, count(*) AS blocks, CAST(sum(CASE WHEN body THEN 1 ELSE 0 END) AS BIGINT) AS body_blocks FROM flags GROUP BY 1) SELECT doc_id, blocks, body_blocks, coalesce(units, 0) AS units, coalesce(batches, 0) AS batches, coalesce(chars, 0) AS chars, coalesce(suspicious, 0) AS suspicious FROM ds LEFT JOIN us USING (doc_id)""",
    "dedupe_digest": "SELECT doc_id, sha256(text) AS digest, min(doc_id) OVER (PARTITION BY sha256(text)) AS \"first\" FROM documents",
    "job_state": f"WITH {_STATE} SELECT * FROM state",
    "job_records": """WITH l AS (SELECT CAST(user_id AS VARCHAR) AS job_id, event_id AS seq, event_type AS payload, event_id % 50 AS n, epoch_us(ts) AS us, CASE event_id % 11 WHEN 0 THEN 'create' WHEN 1 THEN 'start' WHEN 2 THEN 'pages' WHEN 3 THEN 'blocks' WHEN 5 THEN 'log' WHEN 6 THEN 'log' WHEN 8 THEN 'done' WHEN 9 THEN 'failed' WHEN 10 THEN CASE WHEN event_id % 3 = 0 THEN 'requeue' ELSE 'batch' END ELSE 'batch' END AS kind FROM events),
        s AS (SELECT job_id, max(seq) AS reset, arg_max(payload, seq) FILTER (WHERE kind = 'create') AS filename, arg_max(kind, seq) AS started, arg_max(us, seq) AS created_us FROM l WHERE kind IN ('create', 'requeue') GROUP BY 1 HAVING bool_or(kind = 'create')),
        r AS (SELECT l.*, l.seq > s.reset AS later, s.filename, s.started, s.created_us FROM l JOIN s ON s.job_id = l.job_id AND l.seq >= s.reset)
        SELECT job_id, filename, coalesce(arg_max(CASE kind WHEN 'start' THEN 'running' ELSE kind END, seq) FILTER (WHERE later AND kind IN ('start', 'done', 'failed')), 'queued') AS status, coalesce(arg_max(n, seq) FILTER (WHERE later AND kind = 'pages'), 0) AS pages, coalesce(arg_max(n, seq) FILTER (WHERE later AND kind = 'blocks'), 0) AS blocks,
          coalesce(arg_max(n // 2, seq) FILTER (WHERE later AND kind = 'blocks'), 0) AS units, coalesce(arg_max(n // 2 + 1, seq) FILTER (WHERE later AND kind = 'blocks'), 0) AS batches_total, coalesce(arg_max(n, seq) FILTER (WHERE later AND kind = 'batch'), 0) AS batches_completed, count(*) FILTER (WHERE later AND kind = 'log') + 1 AS n_logs, max(seq) AS last_seq,
          coalesce(arg_max(payload, seq) FILTER (WHERE later AND kind = 'log'), CASE started WHEN 'create' THEN 'Job initialized: ' ELSE 'Retranslation queued for: ' END || filename) AS last_log, arg_max(payload, seq) FILTER (WHERE later AND kind = 'failed') AS error, arg_max(payload, seq) FILTER (WHERE later AND kind = 'done') || '_zh-CN.pdf' AS translated_path, created_us
        FROM r GROUP BY job_id, filename, started, created_us""",
    "job_changes": f"""WITH {_JOBS}, r AS (SELECT *, coalesce(last_value(sts IGNORE NULLS) OVER w, 'queued') AS status, coalesce(last_value(CASE WHEN kind = 'batch' THEN n END IGNORE NULLS) OVER w, 0) AS batches, CAST(sum(CASE WHEN kind = 'log' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS logs FROM st WINDOW w AS (PARTITION BY job_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
        l AS (SELECT *, lag(status) OVER w AS ps, lag(batches) OVER w AS pb, lag(logs) OVER w AS pl, coalesce(max(CASE WHEN kind IN ('done', 'failed') THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM r WINDOW w AS (PARTITION BY job_id ORDER BY seq))
        SELECT job_id, seq, status, batches AS batches_completed, logs AS n_logs FROM l WHERE ended = 0 AND (ps IS NULL OR ps <> status OR pb <> batches OR pl <> logs)""",
    "merge_jobs": f"WITH {_STATE} SELECT job_id, CASE WHEN status IN ('done', 'failed') THEN status ELSE 'queued' END AS status, last_seq FROM state",
    "restore_jobs": """WITH f AS (SELECT 'd' || doc_id AS n, CAST(doc_id AS DOUBLE) AS created_at FROM documents JOIN labels USING (doc_id) WHERE quality <> 0),
        h AS (SELECT n, created_at, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(n || '.pdf:' || n || '_zh-CN.pdf')) AS h FROM f)
        SELECT h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || translate(h[17], '0123456789abcdef', '89ab89ab89ab89ab') || h[18:20] || '-' || h[21:32] AS job_id, n || '.pdf' AS filename, n || '_zh-CN.pdf' AS translated_path, created_at FROM h""",
    "upload_actions": """WITH g AS (SELECT d.doc_id, 'd' || d.doc_id || '.pdf' AS name, sha256(text) AS digest, quality, toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id), k AS (SELECT digest, min(name) AS source FROM g WHERE quality IS NOT NULL GROUP BY 1)
        SELECT u.name, k.source, CASE WHEN s.quality = 1 THEN CAST(s.doc_id AS VARCHAR) END AS job_id, CASE WHEN k.source IS NULL THEN 'save' WHEN s.quality = 1 THEN 'existing' WHEN s.toxic = 1 THEN 'done' ELSE 'queued' END AS action FROM g u LEFT JOIN k USING (digest) LEFT JOIN g s ON s.name = k.source""",
    "safe_names": """WITH n AS (SELECT DISTINCT source, 2 * quality + 3 * toxic AS n FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL), t AS (SELECT source, max(CASE WHEN n = 0 THEN 1 ELSE 0 END) AS own FROM n GROUP BY 1),
        r AS (SELECT doc_id AS seq, d.source, row_number() OVER (PARTITION BY d.source ORDER BY doc_id) - 1 + coalesce(own, 0) AS r FROM documents d LEFT JOIN t ON t.source = d.source),
        k AS (SELECT g.s AS source, g.k, row_number() OVER (PARTITION BY g.s ORDER BY g.k) AS r FROM (SELECT source AS s, unnest(range(1, count(*) + 10)) AS k FROM documents GROUP BY 1) g LEFT JOIN n ON n.source = g.s AND n.n = g.k WHERE n.n IS NULL)
        SELECT seq, r.source || '.pdf' AS name, r.source || CASE WHEN r.r = 0 THEN '' ELSE '_' || k.k END || '.pdf' AS free_name FROM r LEFT JOIN k ON k.source = r.source AND k.r = r.r""",
    "safe_paths": r"SELECT page_id, CASE WHEN NOT regexp_matches(u, '[/\\]') AND u NOT IN ('', '.', '..') THEN u END AS name FROM (SELECT page_id, url_decode(replace(string_split(url, '/')[-1], '+', ' ')) AS u FROM pages)",
    "job_frames": f"WITH c AS (@) SELECT job_id, seq, 'data: {{\"job_id\":\"' || job_id || '\",\"seq\":' || seq || ',\"status\":\"' || status || '\"}}' || chr(10) || chr(10) AS frame FROM c",
    "shown_requests": "WITH e AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'GET' ELSE 'POST' END AS method, CASE WHEN event_id % 3 = 0 THEN '/api/files/original/' ELSE '/api/jobs/' END || user_id AS path, CAST(CASE WHEN event_id % 5 < 3 THEN 206 ELSE 200 END AS INT) AS status FROM events) SELECT * FROM e WHERE NOT (method = 'GET' AND status = 206 AND starts_with(path, '/api/files/original/'))",
    "job_listing": f"WITH {_STATE} SELECT job_id, CASE status WHEN 'queued' THEN '排队中' WHEN 'running' THEN '翻译中' WHEN 'done' THEN '已完成' ELSE '失败' END AS label, CAST(CASE WHEN status IN ('done', 'failed') THEN 100 ELSE floor(100.0 * batches_completed / 50 + 0.5) END AS INT) AS percent, strftime(make_timestamp(last_seq * 1000000), '%m/%d %H:%M') AS created FROM state",
    "line_heights": "SELECT p_partkey, CASE WHEN p_size / 20.0 BETWEEN 0.7 AND 2.0 THEN p_size / 20.0 END AS line_height FROM part",
}  # fmt: skip
ORACLE_SQL["job_frames"] = ORACLE_SQL["job_frames"].replace("@", ORACLE_SQL["job_changes"])
