"""DuckDB SQL of the text queries that SQL can express."""

from __future__ import annotations

# What print and keyboards write in place of plain characters, by block: spaces and invisible characters, hyphens and dots,
# letters of look-alike alphabets, presentation and width forms, mathematical letters.
_ODD = (
    r"[\x{a0}\x{ad}\x{34f}\x{61c}\x{115f}\x{1160}\x{1680}\x{17b4}\x{17b5}\x{180e}\x{2000}-\x{200c}\x{200e}-\x{2011}\x{2024}-\x{2026}\x{202a}-\x{202f}\x{205f}-\x{206f}\x{3000}\x{3164}\x{fe00}-\x{fe0f}\x{feff}"
    r"\x{131}\x{251}\x{261}\x{1c0}\x{fb00}-\x{fb4f}\x{ff01}-\x{ffe6}\x{1d400}-\x{1d7ff}\p{Cyrillic}\p{Greek}\p{Armenian}\p{Cherokee}\p{Lisu}]"
)
# Indic vowel sequences that imitate one letter.
_IMITATIONS = "අා|අැ|අෑ|උෟ|ඍෘ|එ්|එෙ|ඔෟ|ෙෙ|அூ"


def _unplain(column: str) -> str:
    joined = f"regexp_replace({column}, '\\x{{dca}}\\x{{200d}}([\\x{{d80}}-\\x{{dff}}])|\\x{{200d}}\\x{{dca}}', '\\1', 'g')"
    return f"(nfc_normalize({column}) <> {column} OR regexp_matches({column}, '{_ODD}') OR regexp_matches({column}, '{_IMITATIONS}') OR contains({joined}, chr(8205)))"


P7 = f"""
SELECT DISTINCT 'candidates' AS tbl, id AS rec_id FROM candidates WHERE {_unplain('title')}
UNION SELECT DISTINCT 'ocr_pages', id FROM ocr_pages WHERE {_unplain('text')}
"""

# Word by word with window functions, prefixes by comparison: another road to the same shares than the operator's.
P10 = r"""
WITH norm AS (
  SELECT doc_id, text, regexp_extract_all(regexp_replace(regexp_replace(text, '[0-9]', '9', 'g'), '\n\s*\n', ' ' || chr(1) || ' ', 'g'), '[^ \n\r\t]+') AS ws
  FROM documents WHERE text IS NOT NULL AND NOT regexp_full_match(text, '\s*')),
trimmed AS (SELECT doc_id, text, list_filter(ws, lambda w, i: NOT (w = chr(1) AND (i = 1 OR i = len(ws)))) AS ws FROM norm),
word AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM trimmed),
seen AS (
  SELECT w, lead(w) OVER p AS nx, CASE WHEN lag(w) OVER p = chr(1) OR regexp_matches(lag(w) OVER p, '[.!?।]+["'')\]”’]*$') THEN NULL ELSE lag(w) OVER p END AS b,
    CASE WHEN lag(w, 2) OVER p = chr(1) OR regexp_matches(lag(w, 2) OVER p, '[.!?।]+["'')\]”’]*$') THEN NULL ELSE lag(w, 2) OVER p END AS a,
    regexp_matches(w, '[.!?।]+["'')\]”’]*$') AS stops
  FROM word WINDOW p AS (PARTITION BY doc_id ORDER BY pos)),
use AS (
  SELECT CASE WHEN b IS NULL THEN '^' ELSE coalesce(a, '^') END AS a, coalesce(b, '^') AS b, regexp_replace(w, '[.!?।]+["'')\]”’]*$', '') AS c,
    CASE WHEN nx = chr(1) OR stops AND (nx IS NULL OR NOT regexp_matches(nx, '^[a-z9]')) THEN 'stop' WHEN stops THEN 'inner' WHEN nx IS NOT NULL THEN 'on' END AS kind
  FROM seen WHERE w <> chr(1)),
tally AS (SELECT a, b, c, count(*) FILTER (kind = 'on') AS o, count(*) FILTER (kind = 'inner') AS i, count(*) FILTER (kind = 'stop') AS s FROM use GROUP BY ALL),
whole AS (SELECT doc_id, text, array_to_string(ws, ' ') AS t FROM trimmed),
cutoff AS (SELECT *, regexp_replace(t, '\s*(\[[\p{L} .]{1,14}\]|\([\p{L} .]{1,14}\)|>>+|»|→|-->)$', '') AS r FROM whole),
plain AS (SELECT doc_id, text, r <> t AS marked, r, regexp_replace(r, '\s*(\.{2,}|…)$', '') AS body FROM cutoff),
three AS (
  SELECT doc_id, text, CASE WHEN marked THEN 'mark' WHEN body <> r THEN 'dots' ELSE 'other' END AS ending, body = r AND regexp_matches(body, '[.!?।]+["'')\]”’]*$') AS stopped,
    string_split(body, ' ') AS ws FROM plain WHERE body <> ''),
fin AS (
  SELECT doc_id, text, ending, stopped, CASE WHEN q IS NULL OR q = chr(1) OR regexp_matches(q, '[.!?।]+["'')\]”’]*$') THEN '^' ELSE q END AS b,
    CASE WHEN q IS NULL OR q = chr(1) OR regexp_matches(q, '[.!?।]+["'')\]”’]*$') OR p IS NULL OR p = chr(1) OR regexp_matches(p, '[.!?।]+["'')\]”’]*$') THEN '^' ELSE p END AS a,
    regexp_replace(ws[-1], '[.!?।]+["'')\]”’]*$', '') AS c
  FROM (SELECT *, ws[-2] AS q, ws[-3] AS p FROM three)),
bare AS (SELECT DISTINCT text, a, b, c FROM fin WHERE NOT stopped),
key3 AS (SELECT DISTINCT a, b, c FROM fin),
level AS (
  SELECT k.a, k.b, k.c, 3 AS n, coalesce(sum(o) FILTER (t.c = k.c), 0) AS o, coalesce(sum(i) FILTER (t.c = k.c), 0) AS i, coalesce(sum(s) FILTER (t.c = k.c), 0) AS s,
    coalesce(sum(o + i + s) FILTER (t.c <> k.c), 0) AS l, (SELECT count(*) FROM bare x WHERE x.a = k.a AND x.b = k.b AND x.c = k.c) AS e
  FROM key3 k LEFT JOIN tally t ON t.a = k.a AND t.b = k.b AND starts_with(t.c, k.c) AND k.c <> '' GROUP BY ALL
  UNION ALL
  SELECT NULL, k.b, k.c, 2, coalesce(sum(o) FILTER (t.c = k.c), 0), coalesce(sum(i) FILTER (t.c = k.c), 0), coalesce(sum(s) FILTER (t.c = k.c), 0),
    coalesce(sum(o + i + s) FILTER (t.c <> k.c), 0), (SELECT count(*) FROM bare x WHERE x.b = k.b AND x.c = k.c)
  FROM (SELECT DISTINCT b, c FROM key3) k LEFT JOIN tally t ON t.b = k.b AND starts_with(t.c, k.c) AND k.c <> '' GROUP BY ALL
  UNION ALL
  SELECT NULL, NULL, k.c, 1, coalesce(sum(o) FILTER (t.c = k.c), 0), coalesce(sum(i) FILTER (t.c = k.c), 0), coalesce(sum(s) FILTER (t.c = k.c), 0),
    coalesce(sum(o + i + s) FILTER (t.c <> k.c), 0), (SELECT count(*) FROM bare x WHERE x.c = k.c)
  FROM (SELECT DISTINCT c FROM key3) k LEFT JOIN (SELECT c, sum(o) AS o, sum(i) AS i, sum(s) AS s FROM tally GROUP BY c) t ON starts_with(t.c, k.c) AND k.c <> '' GROUP BY ALL
  UNION ALL
  SELECT NULL, NULL, NULL, 0, (SELECT sum(o) FROM tally), (SELECT sum(i) FROM tally), (SELECT sum(s) FROM tally), 0, (SELECT count(*) FROM bare)),
told AS (
  SELECT f.doc_id, f.ending, f.stopped, v.n, CASE WHEN stopped THEN s WHEN ending = 'dots' THEN s + e - 1 ELSE e - 1 END AS yes,
    CASE WHEN stopped THEN i WHEN ending = 'dots' THEN o + i + l ELSE o + i + s + l END AS no
  FROM fin f JOIN level v ON v.a IS NOT DISTINCT FROM CASE WHEN v.n = 3 THEN f.a END AND v.b IS NOT DISTINCT FROM CASE WHEN v.n >= 2 THEN f.b END AND v.c IS NOT DISTINCT FROM CASE WHEN v.n >= 1 THEN f.c END),
wide AS (
  SELECT doc_id, any_value(ending) AS ending, bool_or(stopped) AS stopped, max(yes) FILTER (n = 3) AS y3, max(no) FILTER (n = 3) AS n3, max(yes) FILTER (n = 2) AS y2, max(no) FILTER (n = 2) AS n2,
    max(yes) FILTER (n = 1) AS y1, max(no) FILTER (n = 1) AS n1, max(yes) FILTER (n = 0) AS y0, max(no) FILTER (n = 0) AS n0
  FROM told GROUP BY doc_id),
rated AS (
  SELECT doc_id, ending, stopped, (y3 + 0.5 * (y2 + 0.5 * (y1 + 0.5 * CASE WHEN y0 + n0 <> 0 THEN y0::DOUBLE / (y0 + n0) WHEN stopped THEN 1 ELSE 0 END) / (y1 + n1 + 0.5)) / (y2 + n2 + 0.5)) / (y3 + n3 + 0.5) AS terminal FROM wide)
SELECT doc_id FROM rated WHERE terminal < CASE WHEN stopped THEN 0.15 WHEN ending = 'dots' THEN 0.27 ELSE 0.5 END
"""

P10_SOURCES = f"""
WITH cut AS ({P10})
SELECT source, count(doc_id) AS n_docs, count(doc_id) FILTER (doc_id IN (SELECT doc_id FROM cut)) AS n_cut,
 round(count(doc_id) FILTER (doc_id IN (SELECT doc_id FROM cut)) / count(doc_id), 6) AS cut_share FROM documents GROUP BY source
"""

SQL = {"p7_found": P7, "p10_found": P10, "p10_sources": P10_SOURCES}
