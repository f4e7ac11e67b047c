"""Queries of the readers and writers: what is written to the shared folder comes back as it was."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pagewright.plans import auditing
from pagewright.plans import sqltext as S
from pagewright.plans.ranking import _with
from pagewright.session import checkpoint_dir
from pagewright.sources import readers, writers
from pagewright.sources.tables import table

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return register


def _folder(spark, name):
    """A new place beside the session's checkpoints, which all executors share."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    """SELECT doc_id, dataset, coalesce(split, 'unspecified') AS split, page_count, coalesce(source_path, pdf_path) AS path, source_format, CAST(coalesce(len(page_paths), 0) AS INTEGER) AS paths, metadata['company'] AS company, sha256, count(*) AS rows
FROM doc_records GROUP BY ALL"""
)
def jsonl_documents(spark, d):
    """All records through JSON lines and the document reader with its defaults."""
    out = _folder(spark, "documents")
    writers.write_jsonl(table(spark, d, "doc_records"), out)
    back = readers.load_documents(spark, out)
    columns = ["doc_id", "dataset", "split", "page_count", F.col("source_path").alias("path"), "source_format", F.size("page_paths").alias("paths"), F.col("metadata")["company"].alias("company"), "sha256"]
    df = back.select(*columns)
    return df.groupBy(*df.columns).agg(F.count("*").alias("rows"))


@query(
    """SELECT q.task_id, q.doc_id, md5(q.question) AS question_md5, CAST(coalesce(len(e.evidence_pages), 0) AS INTEGER) AS evidence, count(*) AS rows
FROM (SELECT DISTINCT task_id, doc_id, question FROM retrieval_queries) q LEFT JOIN (SELECT DISTINCT task_id, doc_id, evidence_pages FROM evidence_labels) e USING (task_id, doc_id) GROUP BY ALL"""
)
def jsonl_tasks(spark, d):
    """All tasks through JSON lines and the task reader; null evidence comes back as none."""
    out = _folder(spark, "tasks")
    writers.write_jsonl(auditing._tasks(spark, d), out)
    df = readers.load_tasks(spark, out).select("task_id", "doc_id", F.md5("question").alias("question_md5"), F.size("evidence_pages").alias("evidence"))
    return df.groupBy(*df.columns).agg(F.count("*").alias("rows"))


@query(_with(S.DOCS, auditing._INVENTORY) + "SELECT doc_name, nullif(company, '') AS company, sector, fiscal_year, doc_type, CAST(qa_cases AS INTEGER) AS qa_cases, pdf_valid FROM inv")
def csv_inventory(spark, d):
    """The inventory through CSV with a header; empty text is null there."""
    out = _folder(spark, "inventory")
    writers.write_inventory(auditing._inventory(spark, d).drop("position"), out)
    return spark.read.csv(out, header=True, schema="doc_name string, company string, sector string, fiscal_year int, doc_type string, qa_cases int, pdf_valid boolean")


@query(_with(S.PAGES) + "SELECT split_part(doc_id, ':', 2) AS company, split_part(doc_id, ':', 3) AS year, count(*) AS pages, CAST(sum(length(raw_text)) AS BIGINT) AS characters FROM pages GROUP BY ALL")
def stored_reports(spark, d):
    """Page texts stored by company and year, and read back by that key."""
    out = _folder(spark, "reports")
    p = auditing._pages(spark, d).select(F.split_part("doc_id", F.lit(":"), F.lit(2)).alias("company"), F.split_part("doc_id", F.lit(":"), F.lit(3)).alias("year"), "page_index", "raw_text")
    writers.write_reports(p, out)
    back = spark.read.schema("page_index int, raw_text string, company string, year string").parquet(out)
    return back.groupBy("company", "year").agg(F.count("*").alias("pages"), F.sum(F.length("raw_text")).alias("characters"))
