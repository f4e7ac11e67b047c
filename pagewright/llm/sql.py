"""SQL (DuckDB) for the queries that it can express; the rest is tested against brute force."""

from __future__ import annotations

from pagewright.llm import p2_lookalikes as p2
from pagewright.llm.p8_residue import PHRASES, SLOT
from pagewright.plans import sqltext as S

_KEY = f"regexp_replace(regexp_replace(line, '[{S.SPACE}]+', '', 'g'), '[0-9]+', '#', 'g')"
_LINES = f"""WITH page AS (SELECT doc_id, page_index, max(raw_text) AS raw_text FROM native_pages WHERE doc_id IS NOT NULL AND page_index IS NOT NULL AND {S.not_blank('raw_text')} GROUP BY ALL),
line AS (SELECT doc_id, page_index, CAST(i AS INTEGER) AS line_no, parts[i + 1] AS line FROM (SELECT *, unnest(range(len(parts))) AS i FROM (SELECT doc_id, page_index, string_split(lower({S.nfkc('raw_text')}), chr(10)) AS parts FROM page))),
keyed AS (SELECT doc_id, page_index, line_no, {_KEY} AS k FROM line),
support AS (SELECT doc_id, k, count(DISTINCT page_index) AS n FROM keyed WHERE k <> '' GROUP BY ALL),
total AS (SELECT doc_id, count(*) AS pages FROM page GROUP BY ALL),
kept AS (SELECT doc_id, k FROM support JOIN total USING (doc_id) WHERE n >= 4 AND n * 100 >= 15 * pages)
"""

# The graph of consecutive lines: a key may be followed by another, by the page's end, or stand at its start ('').
_GRAPH = """, filled AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY line_no) AS i, count(*) OVER (PARTITION BY doc_id, page_index) AS n FROM keyed WHERE k <> ''),
step AS (SELECT f.doc_id, f.page_index, f.k AS a, g.k AS b FROM filled f JOIN filled g ON g.doc_id = f.doc_id AND g.page_index = f.page_index AND g.i = f.i + 1
  UNION ALL SELECT doc_id, page_index, '', k FROM filled WHERE i = 1 UNION ALL SELECT doc_id, page_index, k, '' FROM filled WHERE i = n),
edge AS (SELECT s.doc_id, a, b FROM step s JOIN total t USING (doc_id) WHERE a <> b AND (a = '' OR (s.doc_id, a) IN (SELECT (doc_id, k) FROM kept)) AND (b = '' OR (s.doc_id, b) IN (SELECT (doc_id, k) FROM kept))
  GROUP BY s.doc_id, a, b HAVING count(DISTINCT page_index) >= 4 AND count(DISTINCT page_index) * 100 >= 15 * any_value(pages)),
reach AS (SELECT doc_id, k, k AS r FROM kept UNION SELECT h.doc_id, h.k, CASE WHEN e.a = h.r THEN e.b ELSE e.a END FROM reach h JOIN edge e ON e.doc_id = h.doc_id AND (e.a = h.r OR e.b = h.r) WHERE e.a <> '' AND e.b <> ''),
node AS (SELECT doc_id, k, count(DISTINCT r) AS block_lines, count(DISTINCT r) > 1 OR (doc_id, k) IN (SELECT (doc_id, a) FROM edge WHERE b = '' UNION SELECT (doc_id, b) FROM edge WHERE a = '') AS in_block FROM reach GROUP BY doc_id, k),
share AS (SELECT doc_id, k, n * 100.0 / pages AS share FROM support JOIN total USING (doc_id)),
removed AS (SELECT x.doc_id, x.page_index, x.line_no, in_block, block_lines FROM keyed x JOIN node USING (doc_id, k) JOIN share USING (doc_id, k) WHERE in_block OR share >= 50)
"""

_WINDOW = """WITH newest AS (SELECT doc_id, page_count FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY registered_at DESC NULLS LAST, page_count DESC NULLS LAST) AS n FROM doc_records) WHERE n = 1 AND page_count > 0),
w AS (SELECT DISTINCT window_id, doc_id, model_id, strategy, start_page, end_page FROM page_windows WHERE start_page IS NOT NULL),
pages AS (SELECT w.*, least(coalesce(end_page, page_count), page_count) - greatest(start_page, 0) AS n FROM w JOIN newest USING (doc_id))
"""

# Pieces one after the other: the rest if it fits, else up to the last strong, middling or any section start in reach, else as much as fits.
_PIECES = (
    _WINDOW.rstrip().replace("WITH newest", "WITH RECURSIVE newest", 1)
    + """, sized AS (SELECT window_id, doc_id, model_id, strategy, start_page, end_page, greatest(start_page, 0) AS first, least(coalesce(end_page, page_count), page_count) AS last, CASE WHEN max_pages > 0 THEN max_pages ELSE n END AS most, greatest(coalesce(overlap_pages, 0), 0) AS lap
  FROM pages JOIN newest USING (doc_id) LEFT JOIN model_limits USING (model_id) WHERE n > 0),
piece AS (SELECT *, least(lap, most - 1) AS overlap FROM sized),
start AS (SELECT doc_id, page, min(s) AS s FROM (SELECT doc_id, coalesce(source_page_index, page_index) AS page, CASE WHEN kind IN ('item', 'statement') THEN 'A' WHEN kind IN ('risk_group', 'note') THEN 'B' ELSE 'C' END AS s FROM page_headings WHERE included AND doc_id IS NOT NULL) WHERE page IS NOT NULL GROUP BY ALL),
cuts AS (SELECT *, 0 AS piece_no, first AS piece_start, first AS pos, CAST(NULL AS INTEGER) AS piece_end, most AS cap, least(overlap + 1, most) AS least_new FROM piece
  UNION ALL SELECT window_id, doc_id, model_id, strategy, start_page, end_page, first, last, most, lap, overlap, piece_no + 1, CASE WHEN piece_no = 0 THEN first ELSE pos - overlap END, e, e, most - overlap, 1
    FROM (SELECT *, CASE WHEN last - pos <= cap THEN last ELSE coalesce(strong, middling, weak, pos + cap) END AS e
      FROM (SELECT c.*, max(h.page) FILTER (h.s = 'A') AS strong, max(h.page) FILTER (h.s <= 'B') AS middling, max(h.page) AS weak
        FROM cuts c LEFT JOIN start h ON h.doc_id = c.doc_id AND h.page BETWEEN c.pos + c.least_new AND c.pos + c.cap WHERE c.pos < c.last GROUP BY ALL)))
SELECT window_id, CAST(piece_no - 1 AS INTEGER) AS piece_no, piece_start, piece_end FROM cuts WHERE piece_end IS NOT NULL"""
)

_SIZED = f"sized AS (SELECT doc_id, source, coalesce(n_tokens, len({S.tokens('text')}), 0) AS size FROM documents)"
_RESIDUE = " OR ".join([f"regexp_matches(text, {S.quote(SLOT)})", *(f"regexp_matches(text, {S.quote(p)})" for _, p in PHRASES)])



def _mapped(c: str) -> str:
    """The look-alike map of p2 in this dialect."""
    v = f"translate(regexp_replace({c}, {S.quote(p2.INVISIBLE_CLASS)}, '', 'g'), {S.quote(p2._PLAIN_FROM)}, {S.quote(p2._PLAIN_TO)})"
    for a, b in p2.LIGATURES.items():
        v = f"replace({v}, {S.quote(a)}, {S.quote(b)})"
    look, zeros = S.quote(p2.LOOK_CLASS), "ОоΟοՕօ"
    word = (
        f"CASE WHEN NOT regexp_matches(w, {look}) THEN w WHEN regexp_matches(w, '\\p{{Latin}}') THEN translate(w, {S.quote(p2.LOOK_FROM)}, {S.quote(p2.LOOK_TO)}) "
        f"WHEN regexp_matches(w, '[0-9]') AND regexp_full_match(w, '[0-9{zeros}]+') THEN translate(w, '{zeros}', '000000') ELSE w END"
    )
    return f"nfc_normalize(array_to_string(list_transform(regexp_extract_all({v}, '[\\p{{L}}\\p{{Nd}}][\\p{{L}}\\p{{M}}\\p{{Nd}}]*|[^\\p{{L}}\\p{{Nd}}]+'), lambda w: {word}), ''))"


_TRIMMED = "trim(regexp_replace(question, '[ \\t\\r\\n]+', ' ', 'g'))"
_CLEAN = "CASE WHEN g.gone IS NULL THEN r.raw_text ELSE array_to_string(list_transform(list_filter(range(len(string_split(r.raw_text, chr(10)))), lambda i: NOT list_contains(g.gone, i)), lambda i: string_split(r.raw_text, chr(10))[i + 1]), chr(10)) END"

_RECURSIVE = _LINES.rstrip().replace("WITH page", "WITH RECURSIVE page", 1) + _GRAPH

ORACLE: dict[str, str] = {
    "p1_blocks": _RECURSIVE + "SELECT doc_id, page_index, line_no, in_block, CAST(block_lines AS INTEGER) AS block_lines FROM removed",
    "p1_clean": _RECURSIVE + f", gone AS (SELECT doc_id, page_index, list(line_no) AS gone FROM removed GROUP BY ALL) SELECT r.doc_id, r.page_index, {_CLEAN} AS clean_text FROM page r LEFT JOIN gone g USING (doc_id, page_index)",
    "p2_questions": f"SELECT DISTINCT task_id, doc_id, question, {_mapped(_TRIMMED)} AS canonical FROM retrieval_queries WHERE {S.not_blank('question')}",
    "p2_question_classes": f"WITH q AS (SELECT DISTINCT task_id, doc_id, question, {_mapped(_TRIMMED)} AS canonical FROM retrieval_queries WHERE {S.not_blank('question')}), c AS (SELECT doc_id, canonical, count(DISTINCT task_id) AS alike, count(DISTINCT question) AS spellings FROM q GROUP BY ALL) SELECT DISTINCT task_id, doc_id, canonical, alike, spellings FROM q JOIN c USING (doc_id, canonical)",
    "p2_pages": f"WITH t AS (SELECT DISTINCT doc_id, page_index, field, text FROM (SELECT doc_id, page_index, 'raw_text' AS field, raw_text AS text FROM native_pages UNION ALL SELECT doc_id, page_index, 'search_text', search_text FROM native_pages) WHERE doc_id IS NOT NULL AND page_index IS NOT NULL AND text IS NOT NULL), p AS (SELECT *, regexp_extract_all(text, '[ \\t\\r\\n]+|[^ \\t\\r\\n]+') AS parts FROM t), w AS (SELECT value, {_mapped('value')} AS canonical FROM (SELECT DISTINCT unnest(parts) AS value FROM p) WHERE regexp_matches(value, '[^\\x00-\\x7f]')), u AS (SELECT doc_id, page_index, field, text, unnest(parts) AS x, generate_subscripts(parts, 1) AS i FROM p), j AS (SELECT doc_id, page_index, field, text, string_agg(coalesce(w.canonical, x), '' ORDER BY i) AS canonical FROM u LEFT JOIN w ON u.x = w.value GROUP BY ALL) SELECT doc_id, page_index, field, coalesce(j.canonical, '') AS canonical FROM t LEFT JOIN j USING (doc_id, page_index, field, text)",
    "p1_found": _LINES + "SELECT doc_id, page_index, line_no FROM keyed SEMI JOIN kept USING (doc_id, k)",
    "p3_found": _WINDOW + "SELECT DISTINCT window_id FROM pages JOIN model_limits USING (model_id) WHERE n > max_pages",
    "p3_pieces": _PIECES,
    "p6_found": f"WITH {_SIZED} SELECT capacity_tokens, doc_id FROM sized, (SELECT DISTINCT capacity_tokens FROM pack_specs) WHERE size > capacity_tokens",
    "p7_found": f"WITH {_SIZED} SELECT t.source FROM mix_targets t LEFT JOIN (SELECT source, sum(size) AS size FROM sized GROUP BY source) s USING (source), (SELECT sum(size) AS total FROM sized) WHERE coalesce(s.size, 0) * t.max_repeats < t.target_share * total",
    "p8_found": f"SELECT doc_id FROM documents WHERE coalesce({_RESIDUE}, false)",
    "p8_kept": f"SELECT doc_id FROM documents WHERE NOT coalesce({_RESIDUE}, false)",
}
