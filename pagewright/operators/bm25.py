"""Per-report term statistics and the deterministic BM25 ranking of every page.

All candidates stay: blank and failed pages have length 0 and count in N and in the
average length; pages without a query term score 0 and tie by page index.

Scale. Statistics for scoring are only made for terms that some query of the report
asks for (a semi-join before the aggregation); reports without a query are never
tokenized. Joins run on (report, term), which spreads a large report over its
vocabulary; the candidate join is salted by page. Tokens are cut once (``asked_tokens``),
since the statistics, the frequencies and the scores of all conditions read them. A rank is
made in strips of scores, never in one window over all pages of a report.

Edge cases. A page's null text has no tokens and its length is not counted, but the page
is; questions without tokens score 0 on every page; a report without pages gives no
row; extra columns of the inputs are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.text import tokenize
from pagewright.session import cut

Analyzer = Callable[[Column], Column]
SALTS = 16
EXACT = "decimal(28,20)"
STRIPS = 64  # strips to a unit of score
STRIP_PAGES = 65_536  # pages without a score to a strip


def guard(k1: float, b: float) -> None:
    if not math.isfinite(k1) or k1 <= 0 or not math.isfinite(b) or not 0 <= b <= 1:
        raise ValueError("BM25 needs finite k1 > 0 and 0 <= b <= 1")


def page_tokens(pages: DataFrame, analyzer: Analyzer = tokenize) -> DataFrame:
    """(doc_id, page_index, tokens)."""
    return pages.select("doc_id", "page_index", analyzer(F.col("raw_text")).alias("tokens"))


def term_frequency(tokens: DataFrame) -> DataFrame:
    """(doc_id, page_index, term, tf)."""
    return tokens.select("doc_id", "page_index", F.explode("tokens").alias("term")).groupBy("doc_id", "page_index", "term").agg(F.count("*").alias("tf"))


def report_stats(tokens: DataFrame) -> DataFrame:
    """(doc_id, n_pages, n_terms, avgdl) from pages, so that blank ones count."""
    return tokens.groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.sum(F.size("tokens")).alias("n_terms")).withColumn("avgdl", F.col("n_terms") / F.col("n_pages"))


def document_frequency(tokens: DataFrame) -> DataFrame:
    """(doc_id, term, df): pages of the report that hold the term."""
    return tokens.select("doc_id", F.explode(F.array_distinct("tokens")).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("df"))


def idf(n: Column, df: Column) -> Column:
    return F.log1p((n - df + 0.5) / (df + 0.5))


def query_terms(queries: DataFrame, analyzer: Analyzer = tokenize) -> DataFrame:
    """(task_id, doc_id, term): a query's terms are a set."""
    return queries.select("task_id", "doc_id", F.explode(F.array_distinct(analyzer(F.col("question")))).alias("term"))


def asked_tokens(queries: DataFrame, pages: DataFrame, analyzer: Analyzer = tokenize) -> DataFrame:
    """``page_tokens`` of the reports that some query asks, cut: conditions that rank the same pages share it."""
    return cut(page_tokens(pages.join(queries.select("doc_id").distinct(), "doc_id", "left_semi"), analyzer))


def contributions(queries: DataFrame, tokens: DataFrame, analyzer: Analyzer = tokenize, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(task_id, doc_id, page_index, term, tf, df, idf, contribution): the trace of every score.

    tokens: (doc_id, page_index, tokens) of every page of the reports in question.
    """
    guard(k1, b)
    wanted = cut(query_terms(queries, analyzer))
    stats = report_stats(tokens)
    hits = cut(  # read for df and for the scores
        tokens.select("doc_id", "page_index", F.size("tokens").alias("length"), F.explode("tokens").alias("term"))
        .join(wanted.select("doc_id", "term").distinct(), ["doc_id", "term"], "left_semi")
        .groupBy("doc_id", "page_index", "term", "length")
        .agg(F.count("*").alias("tf"))
    )
    weights = hits.groupBy("doc_id", "term").agg(F.count("*").alias("df")).join(stats, "doc_id").withColumn("idf", idf(F.col("n_pages"), F.col("df"))).select("doc_id", "term", "df", "idf", "avgdl")
    norm = 1 - b + b * F.col("length") / F.col("avgdl")
    value = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * norm)
    scored = hits.join(weights, ["doc_id", "term"]).withColumn("contribution", value)
    return wanted.join(scored, ["doc_id", "term"]).select("task_id", "doc_id", "page_index", "term", "tf", "df", "idf", "contribution")


def candidates(queries: DataFrame, pages: DataFrame, salts: int = SALTS) -> DataFrame:
    """(task_id, doc_id, page_index): each query with every page of its report."""
    q = queries.select("task_id", "doc_id").distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    p = pages.select("doc_id", "page_index", F.pmod("page_index", F.lit(salts)).alias("salt"))
    return q.join(p, ["doc_id", "salt"]).select("task_id", "doc_id", "page_index")


def scores(queries: DataFrame, tokens: DataFrame, analyzer: Analyzer = tokenize, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(task_id, doc_id, page_index, score) of every candidate. Contributions are added as decimals of 20 places,
    whose sum has no order, so that equal pages get equal bits. Pages without a term come from the candidates,
    in the same exchange."""
    trace = contributions(queries, tokens, analyzer, k1, b).select("task_id", "doc_id", "page_index", F.col("contribution").cast(EXACT).alias("part"))
    bare = candidates(queries, tokens).withColumn("part", F.lit(0).cast(EXACT))
    return trace.unionByName(bare).groupBy("task_id", "doc_id", "page_index").agg(F.sum("part").cast("double").alias("score"))


def ranked(scored: DataFrame, digits: int | None = None) -> DataFrame:
    """``scored`` with ``rank`` by (-score, page_index); ``digits`` rounds scores first.

    A query's pages are split by score into strips, and pages without a score by page number; a page's rank is
    its place in its strip, after the pages of all strips before. So a report with very many pages is ranked
    by many tasks. Strips are counted on the map side; pages and counts meet by (query, strip), on which the
    places are numbered too.
    """
    if digits is not None:
        scored = scored.withColumn("score", F.round("score", digits))
    strip = F.when(F.col("score") > 0, F.floor(F.col("score") * STRIPS) + 1).otherwise(-F.floor(F.greatest("page_index", F.lit(0)) / STRIP_PAGES))
    scored = cut(scored.withColumn("_strip", strip))
    key = ["task_id", "doc_id", "_strip"]
    above = Window.partitionBy("task_id", "doc_id").orderBy(F.desc("_strip")).rowsBetween(Window.unboundedPreceding, -1)
    sizes = scored.groupBy(*key).agg(F.count("*").alias("_n")).select(*key, F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_above"))
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), "page_index"))
    return scored.join(sizes, key).withColumn("rank", (F.col("_above") + place).cast("int")).drop("_strip", "_above")


def fuse(body: DataFrame, heading: DataFrame, weight: float = 0.25) -> DataFrame:
    """Body and heading scores of the same candidates as one score; a page that only one side has is an error."""
    h = heading.select("task_id", "doc_id", "page_index", F.col("score").alias("heading_score"))
    both = body.withColumnRenamed("score", "body_score").join(h, ["task_id", "doc_id", "page_index"], "full")
    score = F.coalesce(F.col("body_score") + weight * F.col("heading_score"), F.raise_error(F.concat(F.lit("body and heading do not cover the same pages: "), "doc_id", F.lit(" "), "page_index")).cast("double"))
    return both.withColumn("score", score)


def match_flags(scored: DataFrame) -> DataFrame:
    """(task_id, doc_id, positive_pages, no_match)."""
    return scored.groupBy("task_id", "doc_id").agg(F.count_if(F.col("score") > 0).alias("positive_pages"), (F.coalesce(F.max("score"), F.lit(0.0)) == 0).alias("no_match"))
