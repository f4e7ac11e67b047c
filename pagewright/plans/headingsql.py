"""SQL (DuckDB dialect) of headings, scopes, inheritance and numbered notes, written from their
definition: lines with offsets, ordered rules, running bounds, and recursion for the note numbers."""

from __future__ import annotations

import re

from pagewright.plans import sqltext as S

_SP = f"[{S.SPACE}]"
_BLANKS = S.quote("".join(c for c in map(chr, range(0x3001)) if c.isspace()))
_ENDS = "\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029"
_ITEM = rf"(?i)Item{_SP}+\p{{Nd}}{{1,2}}[A-C]?\.?{_SP}+[^{S.SPACE}].+"
_STATEMENT = rf"(?i)(?:Consolidated (?:Statements? of .+|Balance Sheets?)|Notes to Consolidated Financial Statements)(?:{_SP}*\(continued\))?"
_NOTE = rf"(?i)Note{_SP}+\p{{Nd}}{{1,2}}{_SP}*[:.—-]{_SP}*[^{S.SPACE}].+"
_RISK_GROUP = rf"(?i)Risks Related to{_SP}+[^{S.SPACE}].+"
_RISK = r"^(?:We (?:depend|conduct|derive)|Changes in levels of)(?:[^\p{L}\p{N}_]|$)"
_EXHIBIT = rf"(?i)Exhibit{_SP}+\p{{Nd}}+(?:\.\p{{Nd}}+)?[A-Z]?"
_REFERENCE = rf"(?i)(?:(?:Item|Article|Section|Note){_SP}+[\p{{Nd}}IVX]+[A-C]?\.?{_SP}+)?[^\p{{Nd}}$%]{{3,140}}{_SP}+\p{{Nd}}{{1,3}}(?:[–-]\p{{Nd}}{{1,3}})?"
_EN_DASH = rf"(?i)Note{_SP}+\p{{Nd}}{{1,2}}{_SP}*–{_SP}*[^{S.SPACE}].+"
_PARENT = rf"(?i)Notes to Consolidated Financial Statements(?:{_SP}*\(continued\))?"
_BARE = rf"^([1-9]\p{{Nd}}?)\.{_SP}+(.+)$"
_SMALL = "['a','an','and','at','by','for','from','in','of','on','or','the','to','with']"


def _full(c: str, pattern: str) -> str:
    return f"regexp_full_match({c}, {S.quote(pattern)})"


def _title(c: str, least: int) -> str:
    words = f"len(list_filter(string_split({c}, ' '), lambda w: w <> ''))"
    parts = f"list_filter(regexp_split_to_array({c}, '[ -]+'), lambda p: p <> '' AND p <> '&')"
    wrong = f"len(list_filter({parts}, lambda p: NOT (regexp_matches(p, '^\\p{{Lu}}') OR list_contains({_SMALL}, p))))"
    letters = _full(c, "[A-Za-zÀ-ɏ’'& -]+")
    return f"({letters} AND length({c}) <= 120 AND {words} BETWEEN {least} AND 12 AND coalesce(regexp_matches({parts}[1], '^\\p{{Lu}}'), false) AND {wrong} = 0)"


def _norm(c: str) -> str:
    return f"trim(regexp_replace({S.nfkc(c)}, '{_SP}+', ' ', 'g'))"


def _fits(c: str) -> str:
    return f"(length({_norm(c)}) <= 240 AND len({S.content(S.tokens(c))}) <= 32)"


_LINES = f"""cutp AS (SELECT doc_id, page_index, raw_text, length(raw_text) AS len, string_split(translate(raw_text, {S.quote(_ENDS)}, repeat(chr(10), {len(_ENDS)})), chr(10)) AS parts FROM pages),
piece AS (SELECT doc_id, page_index, raw_text, len, unnest(parts) AS piece, generate_subscripts(parts, 1) AS n FROM cutp),
placed AS (SELECT *, trim(piece, {_BLANKS}) AS text, sum(length(piece) + 1) OVER (PARTITION BY doc_id, page_index ORDER BY n) - 1 - length(ltrim(piece, {_BLANKS})) AS start FROM piece),
lin AS MATERIALIZED (SELECT doc_id, page_index, raw_text, len, text, lower(text) AS key, CAST(start AS INTEGER) AS start, CAST(start + length(text) AS INTEGER) AS stop,
  row_number() OVER (PARTITION BY doc_id, page_index ORDER BY n) AS k FROM placed WHERE text <> ''),
mean AS (SELECT *, row_number() OVER p - 1 AS i, lead(text) OVER p AS text1, lead(text, 2) OVER p AS text2, lead(k) OVER p AS k1, lead(start) OVER p AS start1, lead(stop) OVER p AS stop1, {_full('text', _REFERENCE)} AS refers
  FROM lin WHERE key NOT IN ('table of contents', 'contents') AND NOT regexp_full_match(text, '[\\p{{Nd}}²³¹⁰⁴-⁹₀-₉①-⑨]+') WINDOW p AS (PARTITION BY doc_id, page_index ORDER BY k)),
page0 AS (SELECT p.doc_id, p.page_index, length(p.raw_text) AS len, coalesce(m.first, 0) AS first, m.doc_id IS NULL AS blank, coalesce(m.refs >= 6, false) AS contents
  FROM pages p LEFT JOIN (SELECT doc_id, page_index, min(start) AS first, count(*) FILTER (refers) AS refs FROM mean GROUP BY ALL) m USING (doc_id, page_index)),
l1 AS (SELECT m.*, substring(raw_text, stop + 1, start1 - stop) AS gap, g.contents,
  CASE WHEN key IN ('signatures', 'index to exhibits', 'exhibit index') THEN replace(key, ' ', '_') WHEN i < 3 AND {_full('text', _EXHIBIT)} THEN 'exhibit_start'
    WHEN i < 3 AND key = 'united states' AND (contains(coalesce(text1, ''), 'SECURITIES AND EXCHANGE COMMISSION') OR contains(coalesce(text2, ''), 'SECURITIES AND EXCHANGE COMMISSION')) THEN 'filing_cover' END AS reason
  FROM mean m JOIN page0 g USING (doc_id, page_index)),
l2 AS (SELECT *, CASE WHEN {_full('text', _ITEM)} THEN 'item' WHEN {_full('text', _STATEMENT)} THEN 'statement' WHEN {_full('text', _NOTE)} THEN 'note' WHEN {_full('text', _RISK_GROUP)} THEN 'risk_group' END AS rule,
  reason IS NULL AND key NOT IN ('part i', 'part ii', 'part iii', 'part iv') AND NOT refers AND NOT contents AS usable FROM l1),
l3 AS (SELECT *, coalesce(usable AND rule IS NULL AND regexp_matches(text, {S.quote(_RISK)}) AND NOT ends_with(text, '.') AND k1 = k + 1 AND regexp_matches(text1, '^\\p{{Ll}}') AND length(gap) - length(replace(gap, chr(10), '')) <= 1, false) AS joins FROM l2),
l4 AS (SELECT *, coalesce(lag(joins) OVER (PARTITION BY doc_id, page_index ORDER BY k), false) AS taken, CASE WHEN joins THEN text || ' ' || text1 ELSE text END AS whole, CASE WHEN joins THEN stop1 ELSE stop END AS last FROM l3),
l5 AS (SELECT *, CASE WHEN taken THEN NULL WHEN NOT usable THEN NULL WHEN rule IS NOT NULL THEN rule WHEN regexp_matches(text, {S.quote(_RISK)}) AND ends_with(whole, '.') THEN 'risk_sentence' WHEN {_title('whole', 2)} THEN 'title' END AS kind0 FROM l4),
heads AS MATERIALIZED (SELECT doc_id, page_index, kind0 AS kind, substring(raw_text, start + 1, last - start) AS heading_text, start, last AS stop FROM l5 WHERE kind0 IS NOT NULL AND {_fits('whole')}),
resets AS MATERIALIZED (SELECT doc_id, page_index, start AS ofs, reason FROM l4 WHERE reason IS NOT NULL AND NOT taken AND NOT contents
  UNION ALL SELECT doc_id, page_index, 0, 'contents_listing' FROM page0 WHERE contents UNION ALL SELECT doc_id, page_index, 0, 'blank_or_navigation_only' FROM page0 WHERE blank),
ev AS (SELECT doc_id, page_index, CASE WHEN reason IN ('contents_listing', 'blank_or_navigation_only') THEN -1 ELSE ofs END AS start, CAST(NULL AS INTEGER) AS stop, 'clear' AS event, CAST(NULL AS INTEGER) AS number, CAST(NULL AS VARCHAR) AS text, false AS ok_title, false AS ok_size FROM resets
  UNION ALL SELECT doc_id, page_index, start, NULL, 'clear', NULL, NULL, false, false FROM heads WHERE kind = 'item'
  UNION ALL SELECT doc_id, page_index, start, NULL, 'parent', NULL, NULL, false, false FROM l1 WHERE NOT contents AND {_full('text', _PARENT)}
  UNION ALL SELECT doc_id, page_index, start, stop, 'en_dash', NULL, text, true, true FROM l1 WHERE NOT contents AND NOT refers AND {_full('text', _EN_DASH)} AND {_fits('text')}
  UNION ALL SELECT doc_id, page_index, start, stop, CASE WHEN contents THEN 'listed' ELSE 'bare' END, CAST(number AS INTEGER), text, {_title('title', 1)} AND regexp_matches(title, '^\\p{{Lu}}') AND NOT refers, {_fits('text')}
    FROM (SELECT *, regexp_extract(text, {S.quote(_BARE)}, 1) AS number, regexp_extract(text, {S.quote(_BARE)}, 2) AS title FROM l1 WHERE regexp_matches(text, {S.quote(_BARE)}))),
ev1 AS (SELECT *, count(*) FILTER (event = 'clear') OVER (PARTITION BY doc_id ORDER BY page_index, start ROWS UNBOUNDED PRECEDING) AS region FROM ev),
ev2 AS MATERIALIZED (SELECT *, min(page_index) FILTER (event = 'parent') OVER (PARTITION BY doc_id, region ORDER BY page_index, start ROWS UNBOUNDED PRECEDING) AS parent, CAST(page_index AS BIGINT) * 1000000000 + start AS ofs FROM ev1),
cand AS (SELECT doc_id, region, number, ofs, parent = page_index AS home FROM ev2 WHERE event = 'bare' AND parent IS NOT NULL AND ok_title AND ok_size),
run AS (SELECT doc_id, region, 1 AS number, min(ofs) AS ofs FROM cand WHERE number = 1 AND home GROUP BY ALL
  UNION ALL SELECT r.doc_id, r.region, r.number + 1, min(c.ofs) FROM run r JOIN cand c ON c.doc_id = r.doc_id AND c.region = r.region AND c.number = r.number + 1 AND c.ofs > r.ofs GROUP BY r.doc_id, r.region, r.number),
began AS (SELECT doc_id, region, min(ofs) AS ofs FROM run GROUP BY ALL),
notes AS MATERIALIZED (SELECT e.doc_id, e.page_index, CASE WHEN event = 'en_dash' THEN 'note_en_dash' ELSE 'note_bare_number' END AS kind, e.number, e.text AS heading_text, e.start AS source_start, e.stop AS source_end,
  CASE WHEN event = 'en_dash' OR r.ofs IS NOT NULL THEN NULL WHEN event = 'listed' THEN 'contents_listing' WHEN e.parent IS NULL THEN 'outside_notes_region' WHEN NOT ok_title THEN 'unsupported_title_syntax' WHEN NOT ok_size THEN 'candidate_limits'
    WHEN b.ofs IS NULL OR b.ofs > e.ofs THEN 'first_note_requires_local_parent_and_one' ELSE 'nonsequential_note_number' END AS rejection_reason
  FROM ev2 e LEFT JOIN run r ON r.doc_id = e.doc_id AND r.region = e.region AND r.ofs = e.ofs AND e.event = 'bare' LEFT JOIN began b ON b.doc_id = e.doc_id AND b.region = e.region WHERE event IN ('en_dash', 'bare', 'listed'))"""


def _entries(observed: str, mark: str = "") -> str:
    """CTEs up to ``held``; ``mark`` is appended to their names, so that two sets can stand in one statement."""
    names = r"\b(obsd|bounds|act|opening|every|seqd|held)\b"
    return re.sub(names, rf"\g<1>{mark}", _entries_sql(observed))


def _entries_sql(observed: str) -> str:
    tokens = S.content(S.tokens("heading_text"))
    return f"""obsd AS MATERIALIZED (SELECT *, {S.fold(_norm('heading_text'))} AS key, {tokens} AS toks FROM ({observed})),
bounds AS (SELECT doc_id, page_index, start AS ofs FROM obsd UNION ALL SELECT doc_id, page_index, ofs FROM resets),
act AS (SELECT doc_id, page_index, arg_max({{'kind': kind, 'heading_text': heading_text, 'start': start, 'stop': stop, 'key': key, 'toks': toks}}, start) AS a
  FROM obsd o WHERE start > coalesce((SELECT max(ofs) FROM resets r WHERE r.doc_id = o.doc_id AND r.page_index = o.page_index), -1) GROUP BY ALL),
opening AS (SELECT g.*, coalesce((SELECT min(ofs) FROM bounds b WHERE b.doc_id = g.doc_id AND b.page_index = g.page_index), g.len) AS upto FROM page0 g),
every AS (SELECT g.doc_id, g.page_index, -1 AS ord, 'inherited' AS mode, a.a.kind AS kind, a.a.heading_text AS heading_text, g.page_index - 1 AS source_page_index, a.a.start AS source_start, a.a.stop AS source_end, g.first AS scope_start, CAST(g.upto AS INTEGER) AS scope_end, a.a.key AS key, a.a.toks AS toks
  FROM opening g JOIN act a ON a.doc_id = g.doc_id AND a.page_index = g.page_index - 1 WHERE NOT g.blank AND g.upto > g.first
  UNION ALL SELECT o.doc_id, o.page_index, o.start, 'observed', kind, heading_text, o.page_index, o.start, o.stop, o.start, CAST(coalesce((SELECT min(ofs) FROM bounds b WHERE b.doc_id = o.doc_id AND b.page_index = o.page_index AND b.ofs > o.start), g.len) AS INTEGER), key, toks FROM obsd o JOIN page0 g USING (doc_id, page_index)),
seqd AS MATERIALIZED (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, page_index ORDER BY ord, source_end, kind) - 1 AS INTEGER) AS seq, len(toks) AS nt FROM every),
held AS (SELECT *, false AS dup, nt AS used, CASE WHEN nt > 64 THEN 'heading_token_cap' END AS why, [key] AS seen FROM (SELECT *, CASE WHEN nt > 64 THEN 0 ELSE nt END AS unused FROM seqd) WHERE seq = 0
  UNION ALL SELECT s.*, 0, list_contains(h.seen, s.key), CASE WHEN list_contains(h.seen, s.key) OR h.used + s.nt > 64 THEN h.used ELSE h.used + s.nt END, CASE WHEN list_contains(h.seen, s.key) THEN 'duplicate_heading' WHEN h.used + s.nt > 64 THEN 'heading_token_cap' END, list_append(h.seen, s.key)
  FROM held h JOIN seqd s ON s.doc_id = h.doc_id AND s.page_index = h.page_index AND s.seq = h.seq + 1)"""


_PLAIN = "SELECT doc_id, page_index, kind, heading_text, start, stop FROM heads"
_WITH_NOTES = _PLAIN + " UNION ALL SELECT doc_id, page_index, kind, heading_text, source_start, source_end FROM notes WHERE rejection_reason IS NULL"


def plain(*before: str) -> str:
    """CTEs up to ``held``: the headings of every page, without the note formats."""
    return "WITH RECURSIVE " + ",\n".join([*before, S.PAGES, _LINES, _entries(_PLAIN)]) + "\n"


def section_tokens(name: str, notes: bool = True, mark: str = "", lines: bool = True) -> str:
    """CTEs of the heading field, with or without note formats, as tokens in order; every page stays."""
    field = f"{name} AS MATERIALIZED (SELECT p.doc_id, p.page_index, coalesce(t.toks, []) AS toks FROM pages p LEFT JOIN (SELECT doc_id, page_index, flatten(list(toks ORDER BY seq)) AS toks FROM held{mark} WHERE why IS NULL GROUP BY ALL) t USING (doc_id, page_index))"
    return ",\n".join([*([_LINES] if lines else []), _entries(_WITH_NOTES if notes else _PLAIN, mark), field])


OBSERVATION = plain() + "SELECT doc_id, page_index, seq, mode, kind, heading_text, source_page_index, source_start, source_end, scope_start, scope_end, why IS NULL AS included, why AS rejection_reason FROM held"
NOTES = "WITH RECURSIVE " + S.PAGES + ",\n" + _LINES + "\nSELECT doc_id, page_index, kind, number, heading_text, source_start, source_end, rejection_reason IS NULL AS accepted, rejection_reason FROM notes"
SUMMARY = plain() + "SELECT measure, value, count(*) AS count FROM (SELECT 'kind' AS measure, kind AS value FROM held UNION ALL SELECT 'mode', mode FROM held UNION ALL SELECT 'rejection', why FROM held UNION ALL SELECT 'reset', reason FROM resets) WHERE value IS NOT NULL GROUP BY ALL"
SCOPES = (
    plain()
    + "SELECT h.doc_id, h.page_index, h.seq, h.scope_start, h.scope_end, a.heading_text AS inherited FROM held h LEFT JOIN (SELECT doc_id, page_index, heading_text FROM held WHERE mode = 'inherited') a USING (doc_id, page_index) WHERE h.mode = 'observed'"
)
