"""Queries of the ranking and evaluation operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.functions.text import drop_stopwords, tokenize, tokenize_content
from pagewright.operators import bm25, evaluation, expansion, headings, pages
from pagewright.plans import headingsql as H
from pagewright.plans import sqltext as S
from pagewright.session import cut
from pagewright.sources.tables import table

QUERIES, ORACLE = {}, {}
DIGITS = 6


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


def _pages(spark, d):
    return pages.page_relation(table(spark, d, "native_pages", "doc_id", "page_index", "raw_text", "status", "extracted_at"))


def _queries(spark, d):
    return pages.allowed_queries(table(spark, d, "retrieval_queries"))


def _labels(spark, d):
    return pages.label_projection(table(spark, d, "evidence_labels"))


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


_JOINED = "md5(array_to_string(toks, ' '))"


@query(_with(S.PAGES, S.page_tokens("t")) + f"SELECT doc_id, page_index, CAST(len(toks) AS INTEGER) AS n_terms, CAST(len(list_distinct(toks)) AS INTEGER) AS n_distinct, {_JOINED} AS tokens_md5 FROM t")
def tokenize_terms(spark, d):
    t = bm25.page_tokens(_pages(spark, d))
    return t.select("doc_id", "page_index", F.size("tokens").alias("n_terms"), F.size(F.array_distinct("tokens")).alias("n_distinct"), F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))


@query(_with(S.PAGES, S.page_tokens("t", lambda c: S.content(S.tokens(c)))) + f"SELECT doc_id, page_index, CAST(len(toks) AS INTEGER) AS n_terms, {_JOINED} AS tokens_md5 FROM t")
def stopword_terms(spark, d):
    t = bm25.page_tokens(_pages(spark, d), tokenize_content)
    return t.select("doc_id", "page_index", F.size("tokens").alias("n_terms"), F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))


@query(f"SELECT task_id, doc_id, md5(trim(regexp_replace(replace({S.nfkc('question')}, '−', '-'), '[{S.SPACE}]+', ' ', 'g'))) AS normal_md5 FROM (SELECT DISTINCT task_id, doc_id, question FROM retrieval_queries WHERE question IS NOT NULL)")
def normalized_questions(spark, d):
    from pagewright.functions.text import normalize_search_text

    q = table(spark, d, "retrieval_queries", "task_id", "doc_id", "question").distinct().where("question is not null")
    return q.select("task_id", "doc_id", F.md5(normalize_search_text(F.col("question"))).alias("normal_md5"))


@query(_with(S.PAGES, S.page_tokens("t")) + "SELECT doc_id, page_index, CAST(len(toks) AS INTEGER) AS n_terms FROM t")
def page_lengths(spark, d):
    return bm25.page_tokens(_pages(spark, d)).select("doc_id", "page_index", F.size("tokens").alias("n_terms"))


@query(_with(S.PAGES, S.page_tokens("t")) + "SELECT doc_id, count(*) AS n_pages, CAST(sum(len(toks)) AS BIGINT) AS n_terms, round(sum(len(toks)) / count(*), 6) AS avgdl FROM t GROUP BY doc_id")
def report_stats(spark, d):
    return bm25.report_stats(bm25.page_tokens(_pages(spark, d))).withColumn("avgdl", F.round("avgdl", DIGITS))


@query(_with(S.PAGES, S.page_tokens("t")) + "SELECT doc_id, page_index, term, count(*) AS tf FROM (SELECT doc_id, page_index, unnest(toks) AS term FROM t) GROUP BY ALL")
def term_frequency(spark, d):
    return bm25.term_frequency(bm25.page_tokens(_pages(spark, d)))


@query(
    _with(S.PAGES, S.page_tokens("t"), "s AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id)")
    + "SELECT doc_id, term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM (SELECT doc_id, term, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct(toks)) AS term FROM t) GROUP BY ALL) JOIN s USING (doc_id)"
)
def document_frequency(spark, d):
    t = bm25.page_tokens(_pages(spark, d))
    n = bm25.report_stats(t).select("doc_id", "n_pages")
    return bm25.document_frequency(t).join(n, "doc_id").select("doc_id", "term", "df", F.round(bm25.idf(F.col("n_pages"), F.col("df")), DIGITS).alias("idf"))


_BODY = _with(S.PAGES, S.QUERIES, S.page_tokens("t"), S.query_terms("qt"), S.bm25("o", "t", "qt"))
_STOP = lambda c: S.content(S.tokens(c))
_BODY_STOP = _with(S.PAGES, S.QUERIES, S.page_tokens("t", _STOP), S.query_terms("qt", _STOP), S.bm25("o", "t", "qt"))


def _scores(spark, d, analyzer=tokenize, queries=None, tokens=None):
    q = _queries(spark, d) if queries is None else queries
    return bm25.scores(q, bm25.asked_tokens(q, _pages(spark, d), analyzer) if tokens is None else tokens, analyzer)


def _ranked(spark, d, analyzer=tokenize, queries=None, tokens=None):
    return bm25.ranked(_scores(spark, d, analyzer, queries, tokens), DIGITS)


@query(_BODY + S.rank("o_scores"))
def bm25_full_ranking(spark, d):
    return _ranked(spark, d)


@query(_BODY + f"SELECT * FROM ({S.rank('o_scores')}) WHERE rank <= 5")
def bm25_top5(spark, d):
    return _ranked(spark, d).where("rank <= 5")


@query(_BODY_STOP + S.rank("o_scores"))
def bm25_stopwords_ranking(spark, d):
    return _ranked(spark, d, tokenize_content)


@query(_BODY + "SELECT task_id, doc_id, page_index, term, tf, df, round(idf, 6) AS idf, round(contribution, 6) AS contribution FROM o_trace")
def bm25_term_attribution(spark, d):
    q = _queries(spark, d)
    t = bm25.contributions(q, bm25.asked_tokens(q, _pages(spark, d)))
    return t.withColumn("idf", F.round("idf", DIGITS)).withColumn("contribution", F.round("contribution", DIGITS))


@query(_BODY + "SELECT task_id, doc_id, count(*) FILTER (score > 0) AS positive_pages, max(score) = 0 AS no_match FROM o_scores GROUP BY ALL")
def no_match_flags(spark, d):
    s = _scores(spark, d).withColumn("score", F.round("score", DIGITS))
    return bm25.match_flags(s)


@query(
    _with("p AS (SELECT 'passages' AS doc_id, doc_id AS page_index FROM documents)")
    + "SELECT * FROM (SELECT source, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY n DESC, doc_id) AS INTEGER) AS rank, n FROM (SELECT source, doc_id, CAST(len("
    + S.content(S.tokens("text"))
    + ") AS INTEGER) AS n FROM documents)) WHERE rank <= 10"
)
def longest_passages(spark, d):
    from pyspark.sql import Window

    t = table(spark, d, "documents", "source", "doc_id", "text").select("source", "doc_id", F.size(tokenize_content(F.col("text"))).alias("n"))
    return t.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "doc_id"))).where("rank <= 10").select("source", "doc_id", "rank", "n")


# Query expansion. -------------------------------------------------------------------------
_RULES = "rules(rule_id, pos, phrase, terms) AS (VALUES " + ", ".join(f"({S.quote(n)}, {i}, {S.quote(p)}, {S.quote(t)})" for i, (n, ps, t) in enumerate(expansion.RULES) for p in ps) + ")"
_SAMPLE = (
    ("s1", "What is the quick ratio and the net margin?"),
    ("s2", "Compute the acid-test ratio."),
    ("s3", "D&A margin"),
    ("s4", "EBITDAish and quickness ratio"),
    ("s5", "quick ratio current ratio gross margin operating margin net margin ebitda ebit capex d&a return on assets return on equity debt to equity"),
)
_ASKED = _with(
    S.QUERIES,
    "asked AS (SELECT * FROM qs UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({S.quote(a)}, 'none', {S.quote(b)})" for a, b in _SAMPLE) + ") v(task_id, doc_id, question))",
    f"tk AS (SELECT *, {S.tokens('question')} AS toks FROM asked)",
    _RULES,
    "hit AS (SELECT DISTINCT task_id, doc_id, question, rule_id, pos, terms FROM tk, rules WHERE contains(' ' || array_to_string(toks, ' ') || ' ', ' ' || phrase || ' '))",
    f"new AS (SELECT DISTINCT h.task_id, h.doc_id, h.question, x.term FROM hit h, (SELECT rule_id, unnest(string_split(terms, ' ')) AS term FROM rules) x WHERE x.rule_id = h.rule_id)",
    f"fresh AS (SELECT n.* FROM new n JOIN tk USING (task_id, doc_id, question) WHERE NOT list_contains({S.content('toks')}, term))",
    "kept AS (SELECT *, row_number() OVER (PARTITION BY task_id, doc_id, question ORDER BY term) AS rn FROM fresh)",
    "added AS (SELECT task_id, doc_id, question, string_agg(term, ' ' ORDER BY term) FILTER (rn <= 32) AS terms, count(*) FILTER (rn > 32) AS discarded FROM kept GROUP BY ALL)",
    "fired AS (SELECT task_id, doc_id, question, string_agg(rule_id, ' ' ORDER BY pos) AS rules FROM (SELECT DISTINCT task_id, doc_id, question, rule_id, pos FROM hit) GROUP BY ALL)",
)


@query(
    _ASKED
    + "SELECT a.task_id, a.doc_id, coalesce(f.rules, '') AS matched_rules, coalesce(d.terms, '') AS added_terms, CAST(coalesce(d.discarded, 0) AS INTEGER) AS discarded FROM asked a LEFT JOIN fired f USING (task_id, doc_id, question) LEFT JOIN added d USING (task_id, doc_id, question)"
)
def query_expansion_terms(spark, d):
    sample = spark.createDataFrame([(a, "none", b) for a, b in _SAMPLE], "task_id string, doc_id string, question string")
    e = expansion.expand(_queries(spark, d).unionByName(sample))
    return e.select("task_id", "doc_id", F.array_join("matched_rules", " ").alias("matched_rules"), F.array_join("added_terms", " ").alias("added_terms"), "discarded")


_BODY_EXPANDED = (
    _ASKED.rstrip()
    + ",\n"
    + ",\n".join(
        [
            S.PAGES,
            "longer AS (SELECT a.task_id, a.doc_id, a.question || coalesce(' ' || d.terms, '') AS question FROM qs a LEFT JOIN added d USING (task_id, doc_id, question))",
            S.page_tokens("t", _STOP),
            S.query_terms("qt", _STOP, "longer"),
            S.bm25("e", "t", "qt", "longer"),
        ]
    )
    + "\n"
)


def _expanded(spark, d):
    e = expansion.expand(_queries(spark, d))
    return e.select("task_id", "doc_id", F.col("question_expanded").alias("question"))


@query(_BODY_EXPANDED + S.rank("e_scores"))
def query_expansion_ranking(spark, d):
    return _ranked(spark, d, tokenize_content, _expanded(spark, d))


# Heading field. ---------------------------------------------------------------------------
def _heading_pages(spark, d):
    """Stored headings as a text field: the included ones of a page, in order of place."""
    h = table(spark, d, "page_headings").where("included").select("doc_id", "page_index", "source_start", "heading_text").distinct()
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source_start", "heading_text"))), lambda x: x["heading_text"]), "\n")
    t = h.groupBy("doc_id", "page_index").agg(text.alias("heading"))
    return _pages(spark, d).select("doc_id", "page_index").join(t, ["doc_id", "page_index"], "left").select("doc_id", "page_index", F.coalesce("heading", F.lit("")).alias("raw_text"))


_FUSED = (
    _BODY_EXPANDED.rstrip()
    + ",\n"
    + ",\n".join(
        [
            "ht AS (SELECT doc_id, page_index, string_agg(heading_text, chr(10) ORDER BY source_start, heading_text) AS heading FROM (SELECT DISTINCT doc_id, page_index, source_start, heading_text FROM page_headings WHERE included) GROUP BY ALL)",
            "hp AS (SELECT p.doc_id, p.page_index, coalesce(h.heading, '') AS raw_text FROM pages p LEFT JOIN ht h USING (doc_id, page_index))",
            S.page_tokens("hk", _STOP, "hp"),
            S.bm25("h", "hk", "qt", "longer"),
            "fused AS (SELECT e.task_id, e.doc_id, e.page_index, round(e.score + 0.25 * h.score, 8) AS score FROM e_scores e JOIN h_scores h USING (task_id, doc_id, page_index))",
        ]
    )
    + "\n"
)


@query(_FUSED + S.rank("fused"))
def field_fusion_ranking(spark, d):
    """Scores are rounded to 8 digits, after rounding both fields to 6."""
    q, six = _expanded(spark, d), lambda s: s.withColumn("score", F.round("score", DIGITS))
    body = six(_scores(spark, d, tokenize_content, q))
    head = six(bm25.scores(q, bm25.asked_tokens(q, _heading_pages(spark, d), tokenize_content), tokenize_content))
    return bm25.ranked(bm25.fuse(body, head).select("task_id", "doc_id", "page_index", "score"), 8)


# Evaluation. ------------------------------------------------------------------------------
def _gold_sql(name: str, scores: str) -> str:
    return f"""{name}_rank AS (SELECT *, row_number() OVER (PARTITION BY task_id, doc_id ORDER BY score DESC, page_index) AS rank FROM {scores}),
{name}_gold AS (SELECT l.task_id, l.doc_id, l.page_index, r.rank FROM (SELECT DISTINCT task_id, doc_id, unnest(evidence_pages) AS page_index FROM labels) l LEFT JOIN {name}_rank r USING (task_id, doc_id, page_index)),
{name}_q AS (SELECT task_id, doc_id, k, count(*) AS gold_pages, count(*) FILTER (rank <= k) AS hits, count(*) FILTER (rank <= k) / count(*) AS recall, CAST(count(*) FILTER (rank <= k) > 0 AS INTEGER) AS any_hit,
  CAST(count(*) FILTER (rank <= k) = count(*) AS INTEGER) AS all_hit, coalesce(1.0 / min(rank), 0.0) AS reciprocal_rank FROM {name}_gold, (VALUES (1), (3), (5)) v(k) GROUP BY task_id, doc_id, k)"""


_ONE = _BODY.rstrip() + ",\n" + S.LABELS + ",\n" + _gold_sql("o", "o_scores") + "\n"
_TWO = (
    _with(S.PAGES, S.QUERIES, S.LABELS, S.page_tokens("t"), S.query_terms("qt"), S.bm25("o", "t", "qt"), S.page_tokens("t2", _STOP), S.query_terms("qt2", _STOP), S.bm25("s", "t2", "qt2"), _gold_sql("o", "o_scores"), _gold_sql("s", "s_scores"))
)


def _gold(spark, d, analyzer=tokenize, tokens=None):
    return evaluation.gold_ranks(_ranked(spark, d, analyzer, tokens=tokens), _labels(spark, d))


def _two_conditions(spark, d):
    """Gold ranks with and without function words. The tokens are cut once; the second condition drops some of them."""
    tokens = bm25.asked_tokens(_queries(spark, d), _pages(spark, d))
    return _gold(spark, d, tokens=tokens), _gold(spark, d, tokenize_content, tokens.withColumn("tokens", drop_stopwords(F.col("tokens"))))


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, DIGITS) for c in columns})


@query(_ONE + "SELECT task_id, doc_id, k, gold_pages, hits, round(recall, 6) AS recall, any_hit, all_hit, round(reciprocal_rank, 6) AS reciprocal_rank FROM o_q")
def retrieval_eval_per_question(spark, d):
    return _rounded(evaluation.per_question(_gold(spark, d)), "recall", "reciprocal_rank")


@query(_ONE + "SELECT k, count(*) AS questions, round(avg(recall), 6) AS recall, round(avg(any_hit), 6) AS any_hit_rate, round(avg(all_hit), 6) AS all_hit_rate, round(avg(reciprocal_rank), 6) AS mrr FROM o_q GROUP BY k")
def retrieval_eval_macro(spark, d):
    return _rounded(evaluation.macro(evaluation.per_question(_gold(spark, d))), "recall", "any_hit_rate", "all_hit_rate", "mrr")


@query(_ONE + "SELECT count(*) AS questions, round(avg(reciprocal_rank), 6) AS mrr, count(*) FILTER (reciprocal_rank = 0) AS without_rank FROM o_q WHERE k = 1")
def retrieval_mrr(spark, d):
    q = evaluation.per_question(_gold(spark, d), (1,))
    return _rounded(q.agg(F.count("*").alias("questions"), F.avg("reciprocal_rank").alias("mrr"), F.count_if(F.col("reciprocal_rank") == 0).alias("without_rank")), "mrr")


_DELTA = "SELECT s.task_id, s.doc_id, s.k, s.gold_pages > 1 AS multi_page, s.recall - o.recall AS d_recall, s.any_hit - o.any_hit AS d_any, s.all_hit - o.all_hit AS d_all, s.reciprocal_rank - o.reciprocal_rank AS d_rr FROM s_q s JOIN o_q o USING (task_id, doc_id, k)"


def _pairs(spark, d):
    return evaluation.paired(*map(evaluation.per_question, _two_conditions(spark, d)))


@query(
    _TWO
    + "SELECT k, metric, count(*) FILTER (d > 0) AS gains, count(*) FILTER (d < 0) AS regressions, count(*) FILTER (d = 0) AS unchanged FROM (SELECT k, unnest([{'metric': 'recall', 'd': CAST(d_recall AS DOUBLE)}, {'metric': 'any_hit', 'd': CAST(d_any AS DOUBLE)}, {'metric': 'all_hit', 'd': CAST(d_all AS DOUBLE)}], recursive := true) FROM ("
    + _DELTA
    + ")) GROUP BY k, metric"
)
def paired_condition_counts(spark, d):
    return evaluation.paired_counts(_pairs(spark, d))


@query(_TWO + f"SELECT k, count(*) AS questions, round(avg(d_recall), 6) AS d_recall, round(avg(d_rr), 6) AS d_rr FROM ({_DELTA}) WHERE multi_page GROUP BY k")
def multi_page_subgroup(spark, d):
    p = _pairs(spark, d).where("multi_page")
    return _rounded(p.groupBy("k").agg(F.count("*").alias("questions"), F.avg("d_recall").alias("d_recall"), F.avg("d_rr").alias("d_rr")), "d_recall", "d_rr")


@query(_TWO + "SELECT o.task_id, o.doc_id, o.page_index, CAST(o.rank AS INTEGER) AS control_rank, CAST(s.rank AS INTEGER) AS treatment_rank, CAST(s.rank - o.rank AS INTEGER) AS change FROM o_gold o JOIN s_gold s USING (task_id, doc_id, page_index)")
def gold_rank_change(spark, d):
    return evaluation.rank_change(*_two_conditions(spark, d))


@query(
    _BODY.rstrip()
    + ",\nsaved AS ("
    + S.rank("o_scores")
    + "),\nagain AS (SELECT * REPLACE (CASE WHEN rank = 2 THEN score + 0.5 ELSE score END AS score) FROM saved WHERE rank > 1 OR task_id NOT LIKE '%7')\n"
    + "SELECT s.task_id, s.rank FROM saved s LEFT JOIN again a USING (task_id, doc_id, rank) WHERE a.page_index IS NULL OR a.page_index <> s.page_index OR abs(a.score - s.score) > 1e-12"
)
def control_reproduction_check(spark, d):
    """A saved ranking against one with other scores at rank 2 and without the first page of some tasks:
    these places, and only these, differ."""
    saved = _ranked(spark, d)
    again = saved.withColumn("score", F.when(F.col("rank") == 2, F.col("score") + 0.5).otherwise(F.col("score"))).where("rank > 1 or task_id not like '%7'")
    return evaluation.reproduction_issues(saved, again)


@query(
    _ONE.rstrip()
    + ",\n"
    + S.DOCS
    + """
, tasks AS (SELECT task_id, doc_id, count(*) AS n, max(page_index) AS most FROM o_scores GROUP BY ALL)
SELECT DISTINCT 'duplicate_label' AS code, task_id FROM (SELECT task_id FROM labels GROUP BY task_id HAVING count(*) > 1)
UNION ALL SELECT DISTINCT 'missing_prediction', task_id FROM labels l WHERE NOT EXISTS (SELECT 1 FROM tasks t WHERE t.task_id = l.task_id AND t.doc_id = l.doc_id)
UNION ALL SELECT DISTINCT 'prediction_without_label', task_id FROM tasks t WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE t.task_id = l.task_id AND t.doc_id = l.doc_id)
UNION ALL SELECT DISTINCT 'evidence_out_of_range', task_id FROM labels l JOIN docs USING (doc_id) WHERE len(list_filter(l.evidence_pages, lambda p: p < 0 OR p >= docs.page_count)) > 0
UNION ALL SELECT DISTINCT 'ranked_page_out_of_range', task_id FROM tasks JOIN docs USING (doc_id) WHERE most >= page_count
UNION ALL SELECT DISTINCT 'incomplete_ranking', task_id FROM tasks JOIN docs USING (doc_id) WHERE n <> page_count"""
)
def evaluation_input_issues(spark, d):
    docs = pages.newest_documents(table(spark, d, "doc_records"))
    return evaluation.input_issues(_ranked(spark, d), _labels(spark, d), docs)


@query(_ONE + "SELECT g.task_id, g.doc_id, round(2.0 * count(*) FILTER (g.rank <= 3) / (count(*) + any_value(r.n)), 6) AS f1 FROM o_gold g JOIN (SELECT task_id, doc_id, least(count(*), 3) AS n FROM o_scores GROUP BY ALL) r USING (task_id, doc_id) GROUP BY g.task_id, g.doc_id")
def page_evidence_f1(spark, d):
    from pagewright.functions.metrics import page_f1

    top, gold = _top_lists(spark, d, 3)
    return top.join(gold, ["task_id", "doc_id"]).select("task_id", "doc_id", F.round(page_f1(F.col("evidence_pages"), F.col("ranking")), DIGITS).alias("f1"))


def _top_lists(spark, d, k):
    r = _ranked(spark, d).where(F.col("rank") <= k)
    top = r.groupBy("task_id", "doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "page_index"))), lambda x: x["page_index"]).alias("ranking"))
    return top, _labels(spark, d)


def _top5(columns: str) -> str:
    asked = "(task_id, doc_id) IN (SELECT (q.task_id, q.doc_id) FROM qs q WHERE q.doc_id IN (SELECT doc_id FROM pages))"
    return _ONE + f"SELECT task_id, doc_id, {columns} FROM o_gold WHERE {asked} GROUP BY ALL"



@query(_top5("round(count(*) FILTER (rank <= 5) / count(*), 6) AS recall_at_5"))
def recall_at_k(spark, d):
    from pagewright.functions.metrics import recall_at_k as f

    top, gold = _top_lists(spark, d, 5)
    return top.join(gold, ["task_id", "doc_id"]).select("task_id", "doc_id", F.round(f(F.col("evidence_pages"), F.col("ranking"), 5), DIGITS).alias("recall_at_5"))


@query(_top5("round(coalesce(1.0 / min(rank) FILTER (rank <= 5), 0.0), 6) AS rr_at_5"))
def reciprocal_rank(spark, d):
    from pagewright.functions.metrics import reciprocal_rank as f

    top, gold = _top_lists(spark, d, 5)
    return top.join(gold, ["task_id", "doc_id"]).select("task_id", "doc_id", F.round(f(F.col("evidence_pages"), F.col("ranking")), DIGITS).alias("rr_at_5"))


# Headings read from the pages. -------------------------------------------------------------
def _held(spark, d, notes=False):
    obs = headings.observed(_pages(spark, d))
    return obs, headings.entries(obs, headings.accepted_notes(headings.note_headings(obs)) if notes else None)


@query(H.OBSERVATION)
def heading_observation(spark, d):
    return _held(spark, d)[1].drop("tokens")


@query(H.NOTES)
def note_sequence(spark, d):
    return headings.note_headings(headings.observed(_pages(spark, d)))


@query(H.SUMMARY)
def context_summary(spark, d):
    return headings.context_summary(*_held(spark, d))


_SECTIONS = (
    "WITH RECURSIVE "
    + _BODY_EXPANDED.rstrip().removeprefix("WITH ")
    + ",\n"
    + ",\n".join(
        [
            H.section_tokens("hk"),
            S.bm25("h", "hk", "qt", "longer"),
            "fused AS (SELECT e.task_id, e.doc_id, e.page_index, e.score AS body_score, h.score AS heading_score, round(e.score + 0.25 * h.score, 8) AS score FROM e_scores e JOIN h_scores h USING (task_id, doc_id, page_index))",
        ]
    )
    + "\n"
)


@query(_SECTIONS + "SELECT *, CAST(row_number() OVER (PARTITION BY task_id, doc_id ORDER BY score DESC, page_index) AS INTEGER) AS rank FROM fused")
def section_context_ranking(spark, d):
    """Body and observed headings (with note formats) fused, for the expanded questions; rounded as in ``field_fusion_ranking``."""
    q, p, six = _expanded(spark, d), _pages(spark, d), lambda s: s.withColumn("score", F.round("score", DIGITS))
    field = headings.heading_tokens(p, _held(spark, d, notes=True)[1]).join(q.select("doc_id").distinct(), "doc_id", "left_semi")
    return bm25.ranked(bm25.fuse(six(_scores(spark, d, tokenize_content, q)), six(bm25.scores(q, cut(field), tokenize_content))), 8)


@query(H.SCOPES)
def scope_and_inheritance(spark, d):
    """The scope of every heading that a page shows, and the heading handed down to that page."""
    held = cut(_held(spark, d)[1].drop("tokens"))
    above = held.where("mode = 'inherited'").select("doc_id", "page_index", F.col("heading_text").alias("inherited"))
    return held.where("mode = 'observed'").join(above, ["doc_id", "page_index"], "left").select("doc_id", "page_index", "seq", "scope_start", "scope_end", "inherited")


# Comparisons of conditions, each with the one before it. -----------------------------------------
def _comparison_sql(ctes: str, control: str, treatment: str) -> str:
    """``control`` and ``treatment``: names of CTEs of scores."""
    metrics = ", ".join(f"{{'metric': '{m}', 'a': CAST(c.{m} AS DOUBLE), 'b': CAST(t.{m} AS DOUBLE)}}" for m in ("recall", "any_hit", "all_hit", "reciprocal_rank"))
    return (
        ",\n".join([ctes.rstrip(), S.LABELS, _gold_sql("cc", control), _gold_sql("tt", treatment)])
        + f"\nSELECT k, metric, count(*) AS questions, round(avg(a), 6) AS control, round(avg(b), 6) AS treatment, round(avg(b - a), 6) AS delta, count(*) FILTER (b > a) AS gains, count(*) FILTER (b < a) AS regressions, count(*) FILTER (b = a) AS unchanged "
        f"FROM (SELECT c.k, unnest([{metrics}], recursive := true) FROM cc_q c JOIN tt_q t USING (task_id, doc_id, k)) GROUP BY k, metric"
    )


def _fused_sql(name: str, heading: str) -> str:
    return f"{name} AS (SELECT e.task_id, e.doc_id, e.page_index, round(e.score + 0.25 * h.score, 8) AS score FROM e_scores e JOIN {heading}_scores h USING (task_id, doc_id, page_index))"


_STOP_SCORES = ",\n".join([S.query_terms("qt0", _STOP), S.bm25("s", "t", "qt0")])
_SECTION_SCORES = "WITH RECURSIVE " + ",\n".join([_BODY_EXPANDED.rstrip().removeprefix("WITH "), H.section_tokens("hk", notes=False), S.bm25("h", "hk", "qt", "longer"), _fused_sql("sections", "h")])
_NOTE_SCORES = ",\n".join([_SECTION_SCORES, H.section_tokens("nk", notes=True, mark="2", lines=False), S.bm25("nh", "nk", "qt", "longer"), _fused_sql("formats", "nh")])


def _conditions(spark, d):
    """Scores by condition, made when asked for; the body's tokens are cut once, and the pages read for headings once."""
    q, longer = _queries(spark, d), _expanded(spark, d)
    p, six = _pages(spark, d), lambda s: s.withColumn("score", F.round("score", DIGITS))
    plain = bm25.asked_tokens(q, p)
    content = plain.withColumn("tokens", drop_stopwords(F.col("tokens")))
    observed = []

    def fused(notes: bool):
        if not observed:
            observed.append(headings.observed(p))
        obs = observed[0]
        held = headings.entries(obs, headings.accepted_notes(headings.note_headings(obs)) if notes else None)
        field = headings.heading_tokens(p, held).join(q.select("doc_id").distinct(), "doc_id", "left_semi")
        return bm25.fuse(six(bm25.scores(longer, content, tokenize_content)), six(bm25.scores(longer, cut(field), tokenize_content))).withColumn("score", F.round("score", 8))

    return {
        "original": lambda: six(bm25.scores(q, plain)),
        "stopwords": lambda: six(bm25.scores(q, content, tokenize_content)),
        "question_expansion": lambda: six(bm25.scores(longer, content, tokenize_content)),
        "section_context": lambda: fused(False),
        "note_formats": lambda: fused(True),
    }


def _compare(spark, d, control, treatment):
    scored, labels = _conditions(spark, d), _labels(spark, d)
    q = [evaluation.per_question(evaluation.gold_ranks(bm25.ranked(scored[c]().select("task_id", "doc_id", "page_index", "score")), labels)) for c in (control, treatment)]
    return _rounded(evaluation.comparison(*q), "control", "treatment", "delta")


@query(_comparison_sql(",\n".join([_BODY.rstrip(), S.page_tokens("t2", _STOP), S.query_terms("qt2", _STOP), S.bm25("s", "t2", "qt2")]), "o_scores", "s_scores"))
def compare_stopwords(spark, d):
    return _compare(spark, d, "original", "stopwords")


@query(_comparison_sql(_BODY_EXPANDED.rstrip() + ",\n" + _STOP_SCORES, "s_scores", "e_scores"))
def compare_expansion(spark, d):
    return _compare(spark, d, "stopwords", "question_expansion")


@query(_comparison_sql(_SECTION_SCORES, "e_scores", "sections"))
def compare_section_context(spark, d):
    return _compare(spark, d, "question_expansion", "section_context")


@query(_comparison_sql(_NOTE_SCORES, "sections", "formats"))
def compare_note_formats(spark, d):
    return _compare(spark, d, "section_context", "note_formats")


@query(
    _BODY_EXPANDED.rstrip()
    + ",\n"
    + S.query_terms("qt0", _STOP)
    + "\nSELECT x.task_id, x.doc_id, x.page_index, x.term, x.tf, round(x.contribution, 6) AS contribution, b.term IS NULL AS added FROM e_trace x LEFT JOIN qt0 b USING (task_id, doc_id, term)"
)
def expansion_term_attribution(spark, d):
    """The trace of the expanded questions; ``added``: the term is not of the question itself."""
    q, longer = _queries(spark, d), _expanded(spark, d)
    trace = bm25.contributions(longer, bm25.asked_tokens(q, _pages(spark, d), tokenize_content), tokenize_content)
    own = bm25.query_terms(q, tokenize_content).withColumn("own", F.lit(True))
    return trace.join(own, ["task_id", "doc_id", "term"], "left").select("task_id", "doc_id", "page_index", "term", "tf", F.round("contribution", DIGITS).alias("contribution"), F.col("own").isNull().alias("added"))


@query(
    _BODY.rstrip()
    + """, st AS (SELECT doc_id, CASE WHEN count(*) = count(*) FILTER (status = 'document_failed') THEN 'document_failed' WHEN count(*) FILTER (status IN ('page_failed', 'document_failed')) > 0 THEN 'partial_extraction' ELSE 'ok' END AS status FROM pages GROUP BY doc_id),
m AS (SELECT task_id, doc_id, max(score) = 0 AS no_match FROM o_scores GROUP BY ALL)
SELECT coalesce(st.status, 'document_failed') AS status, count(*) AS questions, count(*) FILTER (coalesce(m.no_match, true)) AS without_match FROM (SELECT DISTINCT task_id, doc_id FROM qs) q LEFT JOIN st USING (doc_id) LEFT JOIN m USING (task_id, doc_id) GROUP BY ALL"""
)
def prediction_summary(spark, d):
    """Questions by how far their report was extracted, and those that no page matches."""
    q = _queries(spark, d)
    flags = bm25.match_flags(_scores(spark, d, queries=q).withColumn("score", F.round("score", DIGITS)))
    return evaluation.prediction_summary(q, _pages(spark, d), flags)
