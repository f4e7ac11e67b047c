"""Annotated datasets: conversion to unified documents and tasks, release audit, readiness before recognition.

Everything is a frame. An issue is a row; a conversion rejects with issues, never by leaving rows
out silently. Keys are (company, year); annotations count pages from one, tasks from zero.

Edge cases. Null keys match nothing and are reported as missing. Repeated annotations count once
each, as stored. Empty tables give zero counts and no issue beyond those of emptiness.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from pagewright.operators import audit

DATASET = "longdoc"
TYPES = ("mixed", "table", "text")


@F.pandas_udf(StringType())
def _json_number(x: pd.Series) -> pd.Series:
    """JSON of a number; NaN and infinities are no JSON and end the job."""
    return pd.Series([None if pd.isna(v) else json.dumps(v, allow_nan=False) for v in x.tolist()], dtype=object)


def answer_text(answer: Column) -> Column:
    """An answer as JSON text: whole numbers of an integral column without a point, doubles in shortest form."""
    return F.when(F.isnan(answer), F.raise_error(F.lit("an answer is not finite")).cast("string")).otherwise(_json_number(answer))


def key_set_issues(records: DataFrame, key: str, text: str, expected: list[str]) -> DataFrame:
    """(key, missing, extra) of the JSON records in column ``text`` whose keys are not exactly ``expected``, sorted and joined by ','."""
    have = F.coalesce(F.json_object_keys(text), F.array().cast("array<string>"))
    want = F.array(*map(F.lit, expected))
    out = records.select(key, F.array_join(F.array_sort(F.array_except(want, have)), ",").alias("missing"), F.array_join(F.array_sort(F.array_except(have, want)), ",").alias("extra"))
    return out.where("missing <> '' or extra <> ''")


def release_audit(annotations: DataFrame, reports: DataFrame) -> DataFrame:
    """(measure, value, count) of a release.

    annotations: id, company, year, type, page_numbers (from one), answer; reports: company, year, page_count.
    """
    key = ["company", "year"]
    total = lambda name, c: F.struct(F.lit(name).alias("measure"), F.lit("").alias("value"), c.cast("long").alias("count"))
    kind = F.when(F.col("answer").isNull(), "none").when(F.col("answer") == F.floor("answer"), "whole").otherwise("fraction")
    value = lambda name, c: F.struct(F.lit(name).alias("measure"), F.coalesce(c.cast("string"), F.lit("unspecified")).alias("value"))
    each = F.array(value("question_type", F.col("type")), value("year", F.col("year")), value("answer_type", kind), value("evidence_pages", F.size("page_numbers")))
    shares = annotations.select(F.explode(each).alias("m")).select("m.*").groupBy("measure", "value").agg(F.count("*").alias("count"))
    cited = annotations.agg(F.count("*").alias("n"), F.min(F.array_min("page_numbers")).alias("lo"), F.max(F.array_max("page_numbers")).alias("hi"))
    kept = reports.agg(F.count("*").alias("n"), F.countDistinct("company").alias("companies"), F.min("page_count").alias("lo"), F.max("page_count").alias("hi"))
    wanted, there = annotations.select(*key).distinct(), reports.select(*key, "page_count")
    missing = wanted.join(there, key, "left_anti")
    bad = annotations.join(there, key).select("id", F.size(F.filter("page_numbers", lambda p: p > F.col("page_count"))).alias("n")).where("n > 0")
    counted = lambda df, name: df.agg(F.count("*").alias("n")).select(F.explode(F.array(total(name, F.col("n")))).alias("m")).select("m.*")
    row = lambda df, *cells: df.select(F.explode(F.array(*cells)).alias("m")).select("m.*")
    broken = missing.select(F.lit(1).alias("x")).unionByName(bad.select(F.lit(1).alias("x")))
    quantiles = audit.index_quantiles(there.join(wanted, key, "left_semi"), "page_count")
    return audit.union(
        [
            shares,
            row(cited, total("annotations", F.col("n")), total("evidence_page_min", F.col("lo")), total("evidence_page_max", F.col("hi"))),
            row(kept, total("reports", F.col("n")), total("companies", F.col("companies")), total("report_pages_min", F.col("lo")), total("report_pages_max", F.col("hi"))),
            counted(wanted, "task_documents"),
            counted(there.join(wanted, key, "left_anti"), "reports_without_tasks"),
            missing.select(F.lit("missing_report").alias("measure"), F.concat_ws("/", *key).alias("value"), F.lit(1).cast("long").alias("count")),
            bad.select(F.lit("invalid_evidence").alias("measure"), F.col("id").alias("value"), F.col("n").cast("long").alias("count")),
            quantiles.select(F.concat(F.lit("task_document_pages_"), "quantile").alias("measure"), F.lit("").alias("value"), F.col("value").cast("long").alias("count")),
            broken.agg((F.count("*") == 0).alias("ok")).select(F.lit("structurally_valid").alias("measure"), F.lit("").alias("value"), F.col("ok").cast("long").alias("count")),
        ]
    )


def convert_annotations(annotations: DataFrame, reports: DataFrame, selected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tasks, issues) of the annotations on the selected reports.

    annotations as in ``release_audit`` with question; reports: company, year, doc_id, page_count;
    selected: company, year. Tasks have zero-based evidence and the answer as JSON text.
    issues: (code, id) for a selected report without annotations or without text, and evidence beyond its pages.
    """
    key = ["company", "year"]
    chosen = selected.select(*key).distinct()
    mine = annotations.join(chosen, key, "left_semi").join(reports.select(*key, "doc_id", "page_count"), key)
    tasks = mine.select(
        F.concat(F.lit(f"{DATASET}:"), "id").alias("task_id"),
        "doc_id",
        F.lit("question_answering").alias("task_type"),
        "question",
        F.when(F.col("answer").isNotNull(), F.array(answer_text(F.col("answer")))).otherwise(F.array().cast("array<string>")).alias("answers"),
        F.transform("page_numbers", lambda p: p - 1).alias("evidence_pages"),
        F.col("type").alias("question_type"),
    )
    label = F.concat_ws("/", *key)
    issue = lambda df, code, c: df.select(F.lit(code).alias("code"), c.alias("id"))
    beyond = mine.where(F.exists("page_numbers", lambda p: p > F.col("page_count")))
    return tasks, audit.union(
        [
            issue(chosen.join(annotations, key, "left_anti"), "report_without_annotations", label),
            issue(chosen.join(reports, key, "left_anti"), "report_missing", label),
            issue(beyond, "evidence_beyond_report", F.col("id")),
        ]
    )


def unknown_checks(checks: DataFrame, tasks: DataFrame) -> DataFrame:
    """(task_id) of manual checks on tasks that are not there."""
    return audit.without_match(checks, tasks, "task_id")


def readiness(manifest_issues: DataFrame, documents: DataFrame, tasks: DataFrame, checks: DataFrame, released_pdfs: int, warnings: tuple[str, ...] = audit.WARNINGS) -> DataFrame:
    """(measure, value, count): the state before recognition, with one row for each blocker.

    checks: task_id, status, human_signoff, finding_codes. A check on an unknown task is a blocker of its own.
    """
    docs = documents.agg(F.count("*").alias("n"), F.count_if(F.col("source_format") == "pdf").alias("ready"), F.min("page_count").alias("lo"), F.max("page_count").alias("hi"))
    seen = checks.agg(F.count("*").alias("checks"), F.count_if(F.col("status") == "fail").alias("fails"), F.count_if(~F.coalesce("human_signoff", F.lit(False))).alias("pending"))
    broken = manifest_issues.agg(F.count_if(~F.col("code").isin(*warnings)).alias("errors"))
    stray = unknown_checks(checks, tasks).agg(F.count("*").alias("stray"))
    # Four frames of one row each, brought into one row by name.
    long = audit.union([df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("long").alias("v")) for c in df.columns))).alias("m")).select("m.*") for df in (docs, seen, broken, stray)])
    one = long.agg(*(F.max(F.when(F.col("name") == c, F.col("v"))).alias(c) for c in ("n", "ready", "lo", "hi", "checks", "fails", "pending", "errors", "stray")))
    when = lambda code, condition, n: F.when(condition, F.struct(F.lit("blocker").alias("measure"), F.lit(code).alias("value"), n.cast("long").alias("count")))
    blockers = F.array_compact(
        F.array(
            when("unknown_task", F.col("stray") > 0, F.col("stray")),
            when("manifest_validation_failed", F.col("errors") > 0, F.col("errors")),
            when("source_pdfs_unavailable", F.lit(released_pdfs == 0), F.lit(0)),
            when("pilot_not_ocr_ready", F.col("ready") < F.col("n"), F.col("n") - F.col("ready")),
            when("manual_ground_truth_failures", F.col("fails") > 0, F.col("fails")),
            when("researcher_signoff_pending", F.col("pending") > 0, F.col("pending")),
        )
    )
    fact = lambda name, c: F.struct(F.lit(name).alias("measure"), F.lit("").alias("value"), c.cast("long").alias("count"))
    facts = [fact("documents", F.col("n")), fact("page_count_min", F.col("lo")), fact("page_count_max", F.col("hi")), fact("checks", F.col("checks"))]
    state = F.struct(F.lit("status").alias("measure"), F.when(F.size(blockers) > 0, "blocked_before_ocr").otherwise("ready_for_ocr_dry_run").alias("value"), F.size(blockers).cast("long").alias("count"))
    parts = [
        one.select(F.explode(F.concat(blockers, F.array(*facts, state))).alias("m")).select("m.*"),
        checks.groupBy(F.lit("check_status").alias("measure"), F.coalesce("status", F.lit("unspecified")).alias("value")).agg(F.count("*").alias("count")),
        checks.select(F.explode("finding_codes").alias("value")).groupBy(F.lit("finding").alias("measure"), "value").agg(F.count("*").alias("count")),
        documents.groupBy(F.lit("source_format").alias("measure"), F.coalesce("source_format", F.lit("unspecified")).alias("value")).agg(F.count("*").alias("count")),
    ]
    return audit.union([p.select("measure", "value", "count") for p in parts])
