"""Queries of the llm subpackage, by name."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.llm import p1_boilerplate as p1
from pagewright.llm import p2_lookalikes as p2
from pagewright.llm import p3_split as p3
from pagewright.llm import p4_repair as p4
from pagewright.llm import p5_quality as p5
from pagewright.llm import p6_pack as p6
from pagewright.llm import p7_mix as p7
from pagewright.llm import p8_residue as p8
from pagewright.llm.pages import with_text
from pagewright.llm.sql import ORACLE  # noqa: F401
from pagewright.sources.tables import table


def p1_found(spark, d):
    return p1.find(table(spark, d, "native_pages", "doc_id", "page_index", "raw_text")).select("doc_id", "page_index", "line_no")


def p1_blocks(spark, d):
    """The lines that are taken out, with the size of their block."""
    found = p1.find(table(spark, d, "native_pages", "doc_id", "page_index", "raw_text"))
    return p1.removable(found).select("doc_id", "page_index", "line_no", (F.col("block_id").isNotNull()).alias("in_block"), "block_lines")


def p1_clean(spark, d):
    """One row for each page with text; all rows of a page carry the same text."""
    pages = table(spark, d, "native_pages", "doc_id", "page_index", "raw_text")
    texts = with_text(pages).groupBy("doc_id", "page_index").agg(F.max("raw_text").alias("raw_text"))
    return p1.remove_lines(texts, p1.removable(p1.find(pages))).select("doc_id", "page_index", "clean_text")


def p2_found(spark, d):
    pages = table(spark, d, "native_pages", "doc_id", "page_index", "raw_text", "representation")
    return p2.found(pages, table(spark, d, "page_headings"), table(spark, d, "common_words"), table(spark, d, "retrieval_queries"))


def p2_pages(spark, d):
    pages = table(spark, d, "native_pages", "doc_id", "page_index", "raw_text", "search_text").where("doc_id is not null and page_index is not null")
    texts = pages.select("doc_id", "page_index", F.explode(F.array(F.struct(F.lit("raw_text").alias("field"), F.col("raw_text").alias("text")), F.struct(F.lit("search_text").alias("field"), F.col("search_text").alias("text")))).alias("t"))
    texts = texts.select("doc_id", "page_index", "t.*").where("text is not null").distinct()
    return p2.canonical_texts(texts, "doc_id", "page_index", "field").select("doc_id", "page_index", "field", "canonical")


def p2_questions(spark, d):
    return p2.canonical_questions(table(spark, d, "retrieval_queries")).select("task_id", "doc_id", "question", "canonical")


def p2_question_classes(spark, d):
    return p2.question_classes(table(spark, d, "retrieval_queries"))


def _pieces(spark, d):
    t = lambda name: table(spark, d, name)
    return p3.split(t("page_windows"), t("doc_records"), t("page_headings"), t("model_limits"))


def p3_found(spark, d):
    return _pieces(spark, d).where("pieces > 1").select("window_id").distinct()


def p3_pieces(spark, d):
    return _pieces(spark, d).select("window_id", "piece_no", "piece_start", "piece_end")


def _scans(spark, d):
    return (
        table(spark, d, "ocr_lines", "doc_id", "page_index", "line_order", "text", "confidence"),
        table(spark, d, "native_pages", "doc_id", "page_index", "raw_text"),
        table(spark, d, "page_headings", "doc_id", "page_index", "heading_text"),
    )


def p4_found(spark, d):
    return p4.found(*_scans(spark, d))


def p4_pages(spark, d):
    return p4.repaired(*_scans(spark, d))


def _kinds(spark, d):
    return p5.kinds(table(spark, d, "native_pages", "doc_id", "page_index", "raw_text"), table(spark, d, "page_headings"), table(spark, d, "common_words"))


def p5_found(spark, d):
    return _kinds(spark, d).where("kind in ('list', 'table', 'junk')").select("doc_id", "page_index", "kind")


def p5_pages(spark, d):
    return p5.page_stats(table(spark, d, "native_pages"), table(spark, d, "page_headings"), table(spark, d, "common_words"))


def p5_reports(spark, d):
    return p5.report_stats(p5_pages(spark, d))


def _packed(spark, d):
    return p6.pack(table(spark, d, "documents", "doc_id", "n_tokens", "text"), table(spark, d, "pack_specs"))


def p6_found(spark, d):
    return p6.oversize(_packed(spark, d))


def p6_certificates(spark, d):
    return p6.certificates(_packed(spark, d))


def _mix(spark, d):
    return p7.mix(table(spark, d, "documents", "doc_id", "source", "n_tokens", "text"), table(spark, d, "mix_targets"))


def p7_found(spark, d):
    return _mix(spark, d)[1].where("exhausted and not reachable").select("source")


def p7_mixture(spark, d):
    return _mix(spark, d)[0]


def p7_shares(spark, d):
    return _mix(spark, d)[1]


def p8_found(spark, d):
    return p8.find(table(spark, d, "documents", "doc_id", "text")).select("doc_id")


def p8_kept(spark, d):
    return p8.keep_clean(table(spark, d, "documents", "doc_id", "text")).select("doc_id")


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_blocks, p1_clean, p2_found, p2_pages, p2_questions, p2_question_classes, p3_found, p3_pieces, p4_found, p4_pages, p5_found, p5_pages, p5_reports, p6_found, p6_certificates, p7_found, p7_mixture, p7_shares, p8_found, p8_kept)
}
