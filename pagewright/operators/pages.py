"""The page relation: one row per physical page, whatever rows were stored for it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions.text import is_blank


def page_relation(native_pages: DataFrame) -> DataFrame:
    """(doc_id, page_index, raw_text, status): every page stays, blank and failed ones with ''.

    Rows of one page with text carry the same text. Null keys are dropped. ``status`` is
    'ok' if any row has text, else that of the latest row.
    """
    text = F.when(~is_blank(F.col("raw_text")), F.col("raw_text"))
    return (
        native_pages.where("doc_id is not null and page_index is not null")
        .groupBy("doc_id", "page_index")
        .agg(F.max(text).alias("t"), F.max(F.struct("extracted_at", "status")).alias("last"))
        .select("doc_id", "page_index", F.coalesce("t", F.lit("")).alias("raw_text"), F.when(F.col("t").isNotNull(), F.lit("ok")).otherwise(F.col("last.status")).alias("status"))
    )


def newest_documents(doc_records: DataFrame) -> DataFrame:
    """One row per doc_id: the newest registration (ties: most pages); nulls count as oldest."""
    rest = [c for c in doc_records.columns if c not in ("doc_id", "registered_at", "page_count", "metadata")]
    row = F.struct("registered_at", "page_count", *rest, F.to_json("metadata").alias("metadata_json"))
    return doc_records.where("doc_id is not null").groupBy("doc_id").agg(F.max(row).alias("r")).select("doc_id", "r.*")


def allowed_queries(retrieval_queries: DataFrame) -> DataFrame:
    """The three fields a ranking may see, each non-blank, copies dropped."""
    q = retrieval_queries.select("task_id", "doc_id", "question").distinct()
    return q.where(~is_blank(F.col("task_id")) & ~is_blank(F.col("doc_id")) & ~is_blank(F.col("question")))


def label_projection(evidence_labels: DataFrame) -> DataFrame:
    """(task_id, doc_id, evidence_pages); only the evaluator may open it. Repeats collapse, null arrays go."""
    e = evidence_labels.select("task_id", "doc_id", F.array_sort(F.array_distinct("evidence_pages")).alias("evidence_pages"))
    return e.where("evidence_pages is not null and size(evidence_pages) > 0").distinct()
