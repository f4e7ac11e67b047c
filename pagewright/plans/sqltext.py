"""Pieces of the SQL that the queries are compared with (DuckDB dialect)."""

from __future__ import annotations

import unicodedata

from pagewright.functions.text import PY_SPACE, STOPWORDS, TOKEN_PATTERN

SPACE = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _compatibility() -> tuple[str, str, dict[str, str]]:
    """NFKC as a character translation, and the few longer expansions that Latin text has."""
    a, b, longer = [], [], {}
    for c in range(0xA0, 0x10000):
        ch = chr(c)
        tag = unicodedata.decomposition(ch)
        if not tag.startswith("<"):
            continue
        to = unicodedata.normalize("NFKC", ch)
        if len(to) == 1:
            a.append(ch)
            b.append(to)
        elif c in (0xA8, 0xAF, 0xB4, 0xB8, 0xBC, 0xBD, 0xBE, 0x2026, 0x2033, 0x2122, *range(0xFB00, 0xFB07)):
            longer[ch] = to
    return "".join(a), "".join(b), longer


_FROM, _TO, _LONGER = _compatibility()


def nfkc(c: str) -> str:
    out = f"translate({c}, {quote(_FROM)}, {quote(_TO)})"
    for x, y in _LONGER.items():
        out = f"replace({out}, {quote(x)}, {quote(y)})"
    return f"nfc_normalize({out})"


def fold(c: str) -> str:
    return f"replace(replace(lower(replace({nfkc(c)}, {quote(chr(0x2212))}, '-')), 'ß', 'ss'), 'ς', 'σ')"


def tokens(c: str) -> str:
    return f"regexp_extract_all({fold(c)}, {quote(TOKEN_PATTERN)})"


def content(t: str) -> str:
    return f"list_filter({t}, lambda w: NOT list_contains([{', '.join(map(quote, STOPWORDS))}], w))"


def not_blank(c: str) -> str:
    return f"({c} IS NOT NULL AND regexp_matches({c}, '[^{SPACE}]'))"


PAGES = f"""pages AS (
  SELECT doc_id, page_index, coalesce(max(CASE WHEN {not_blank('raw_text')} THEN raw_text END), '') AS raw_text,
    CASE WHEN max(CASE WHEN {not_blank('raw_text')} THEN 1 END) = 1 THEN 'ok' ELSE last(status ORDER BY extracted_at NULLS FIRST, status NULLS FIRST) END AS status
  FROM native_pages WHERE doc_id IS NOT NULL AND page_index IS NOT NULL GROUP BY doc_id, page_index)"""
QUERIES = f"""qs AS (SELECT DISTINCT task_id, doc_id, question FROM retrieval_queries
  WHERE {not_blank('task_id')} AND {not_blank('doc_id')} AND {not_blank('question')})"""
DOCS = """docs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY registered_at DESC NULLS LAST, page_count DESC NULLS LAST) AS rn
  FROM doc_records WHERE doc_id IS NOT NULL) WHERE rn = 1)"""
LABELS = """labels AS (SELECT DISTINCT task_id, doc_id, list_sort(list_distinct(evidence_pages)) AS evidence_pages FROM evidence_labels
  WHERE evidence_pages IS NOT NULL AND len(evidence_pages) > 0)"""


def page_tokens(name: str, analyze=tokens, source: str = "pages", column: str = "raw_text") -> str:
    return f"{name} AS MATERIALIZED (SELECT doc_id, page_index, {analyze(column)} AS toks FROM {source})"


def query_terms(name: str, analyze=tokens, source: str = "qs", column: str = "question") -> str:
    return f"{name} AS MATERIALIZED (SELECT DISTINCT task_id, doc_id, unnest({analyze(column)}) AS term FROM {source})"


def bm25(p: str, toks: str, terms: str, queries: str = "qs", k1: float = 1.2, b: float = 0.75) -> str:
    """CTEs {p}_trace and {p}_scores over page tokens and query terms."""
    return f"""{p}_tf AS (SELECT doc_id, page_index, term, count(*) AS tf FROM (SELECT doc_id, page_index, unnest(toks) AS term FROM {toks}) GROUP BY ALL),
{p}_st AS (SELECT doc_id, count(*) AS n, sum(len(toks)) / count(*) AS avgdl FROM {toks} GROUP BY doc_id),
{p}_df AS (SELECT doc_id, term, count(*) AS df FROM {p}_tf GROUP BY ALL),
{p}_trace AS (SELECT q.task_id, q.doc_id, t.page_index, q.term, t.tf, d.df, ln(1 + (s.n - d.df + 0.5) / (d.df + 0.5)) AS idf,
  ln(1 + (s.n - d.df + 0.5) / (d.df + 0.5)) * t.tf * ({k1} + 1) / (t.tf + {k1} * (1 - {b} + {b} * len(k.toks) / s.avgdl)) AS contribution
  FROM {terms} q JOIN {p}_tf t ON t.doc_id = q.doc_id AND t.term = q.term JOIN {p}_df d ON d.doc_id = q.doc_id AND d.term = q.term
  JOIN {p}_st s ON s.doc_id = q.doc_id JOIN {toks} k ON k.doc_id = t.doc_id AND k.page_index = t.page_index),
{p}_scores AS (SELECT q.task_id, q.doc_id, g.page_index, round(coalesce(x.s, 0.0), 6) AS score FROM (SELECT DISTINCT task_id, doc_id FROM {queries}) q
  JOIN pages g ON g.doc_id = q.doc_id
  LEFT JOIN (SELECT task_id, doc_id, page_index, sum(contribution) AS s FROM {p}_trace GROUP BY ALL) x
    ON x.task_id = q.task_id AND x.doc_id = q.doc_id AND x.page_index = g.page_index)"""


def rank(scores: str) -> str:
    return f"SELECT task_id, doc_id, page_index, score, CAST(row_number() OVER (PARTITION BY task_id, doc_id ORDER BY score DESC, page_index) AS INTEGER) AS rank FROM {scores}"
