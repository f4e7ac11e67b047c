"""Problem 3: page windows larger than a model takes, cut at section starts.

A report is one string with one character per page: the strength of the section
that starts there. A window is a substring of it, and a regular expression with
bounded quantifiers eats that substring piece by piece: alternatives ordered by
boundary strength take as many pages as the limit allows, and the last falls back to
single characters. The first piece may take ``max_pages``; each later one takes up to
``max_pages - overlap_pages`` new pages and looks back over the overlap.

Scale. Reports are one row each and are replicated over ``SALTS`` keys, so that a
report with a third of all windows is spread over that many tasks.

Edge cases. Duplicate windows come out once. A report's newest record
(registered_at, then page_count; null registered_at is oldest) gives its pages; no
record, or a null or non-positive page_count, means no pages. Start null, bounds
swapped, or nothing inside the report: no pages and no piece. Null end: end of the
report. Unknown model, or a null or non-positive max_pages: no limit, one piece.
Overlap null or negative counts as 0; overlap not below max_pages as max_pages - 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A section's kind and how good a place to cut its start is, best first.
STRENGTH = {"item": "A", "statement": "A", "risk_group": "B", "note": "B"}
OTHER_KIND, NO_START = "C", "."
SALTS = 8


def report_strings(doc_records: DataFrame, page_headings: DataFrame) -> DataFrame:
    """(doc_id, page_count, starts): starts has one character per page of the newest record."""
    newest = (
        doc_records.where("doc_id is not null")
        .groupBy("doc_id")
        .agg(F.max(F.struct("registered_at", "page_count")).alias("r"))
        .select("doc_id", F.col("r.page_count").alias("page_count"))
        .where("page_count > 0")
    )
    strength = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in STRENGTH.items() for x in kv)), F.coalesce("kind", F.lit(""))), F.lit(OTHER_KIND))
    starts = (
        page_headings.where("included and doc_id is not null")
        .select("doc_id", F.coalesce("source_page_index", "page_index").alias("page"), strength.alias("s"))
        .where("page is not null")
        .groupBy("doc_id", "page")
        .agg(F.min("s").alias("s"))
        .groupBy("doc_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("page", "s"))).alias("at"))
    )
    pages = F.sequence(F.lit(0), F.col("page_count") - 1)
    text = F.array_join(F.transform(pages, lambda i: F.coalesce(F.element_at("at", i), F.lit(NO_START))), "")
    return newest.join(starts, "doc_id", "left").select(
        "doc_id", "page_count", F.when(F.col("at").isNull(), F.repeat(F.lit(NO_START), F.col("page_count"))).otherwise(text).alias("starts")
    )


def piece_pattern(most, least):
    """One piece of ``least``..``most`` pages: the rest of the window if it fits, else up to
    the last strong, middling or any section start in reach, else as much as fits."""
    reach = F.concat(F.lit(".{"), least.cast("string"), F.lit(","), most.cast("string"), F.lit("}"))
    rest = F.concat(F.lit(".{1,"), most.cast("string"), F.lit("}"))
    return F.concat(F.lit("(?:"), rest, F.lit("$|"), reach, F.lit("(?=A)|"), reach, F.lit("(?=[AB])|"), reach, F.lit("(?=[ABC])|"), rest, F.lit(")"))


def split(windows: DataFrame, doc_records: DataFrame, page_headings: DataFrame, model_limits: DataFrame, salts: int = SALTS) -> DataFrame:
    """(window_id, doc_id, model_id, strategy, page_total, piece_no, piece_start, piece_end, pieces), half-open."""
    reports = report_strings(doc_records, page_headings).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge")
    w = windows.select("window_id", "doc_id", "model_id", "strategy", "start_page", "end_page").distinct()
    w = w.withColumn("salt", F.pmod(F.xxhash64("window_id", "start_page", "end_page"), F.lit(salts)).cast("int"))
    w = w.join(reports, ["doc_id", "salt"]).join(model_limits.select("model_id", "max_pages", "overlap_pages"), "model_id", "left")
    w = (
        w.withColumn("first", F.greatest(F.col("start_page"), F.lit(0)))
        .withColumn("last", F.least(F.coalesce("end_page", "page_count"), "page_count"))
        .where("start_page is not null and first < last")
        .withColumn("page_total", F.col("last") - F.col("first"))
        .withColumn("most", F.when(F.col("max_pages") > 0, F.col("max_pages")).otherwise(F.col("page_total")))
        .withColumn("overlap", F.least(F.greatest(F.coalesce("overlap_pages", F.lit(0)), F.lit(0)), F.col("most") - 1))
        .withColumn("fresh", F.col("most") - F.col("overlap"))
    )
    pattern = F.concat(F.lit("^"), piece_pattern(F.col("most"), F.least(F.col("overlap") + 1, F.col("most"))), F.lit("|"), piece_pattern(F.col("fresh"), F.lit(1)))
    w = w.withColumn("eaten", F.transform(F.regexp_extract_all(F.substring("starts", F.col("first") + 1, F.col("page_total")), pattern, F.lit(0)), F.length))
    ends = F.expr("transform(eaten, (n, k) -> first + aggregate(slice(eaten, 1, k + 1), 0, (a, x) -> a + x))")
    return (
        w.withColumn("ends", ends)
        .select("window_id", "doc_id", "model_id", "strategy", "page_total", "first", "overlap", "ends", F.size("ends").alias("pieces"), F.posexplode("ends").alias("piece_no", "piece_end"))
        .select(
            "window_id",
            "doc_id",
            "model_id",
            "strategy",
            "page_total",
            "piece_no",
            F.when(F.col("piece_no") == 0, F.col("first")).otherwise(F.expr("ends[piece_no - 1] - overlap")).alias("piece_start"),
            "piece_end",
            "pieces",
        )
    )
