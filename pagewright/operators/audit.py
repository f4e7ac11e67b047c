"""Integrity audits: every check is a frame of issues, and no issue is a passed check."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.text import is_blank
from pagewright.session import cut

ISSUES = ("code", "entity", "id")


def issue(df: DataFrame, code: str, entity: str, key: Column) -> DataFrame:
    return df.select(F.lit(code).alias("code"), F.lit(entity).alias("entity"), key.cast("string").alias("id"))


def union(frames) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, count) of keys that stand on more than one row."""
    return df.groupBy(*keys).agg(F.count("*").alias("count")).where("count > 1")


def without_match(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Distinct keys of ``left`` that ``right`` has not."""
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), list(keys), "left_anti")


def distribution(df: DataFrame, column: str | Column, name: str) -> DataFrame:
    """(field, value, count); null is 'unspecified'."""
    c = F.col(column) if isinstance(column, str) else column
    return df.select(F.lit(name).alias("field"), F.coalesce(c.cast("string"), F.lit("unspecified")).alias("value")).groupBy("field", "value").agg(F.count("*").alias("count"))


WARNINGS = ("pdf_without_metadata", "not_ocr_input_ready", "limited_sector_coverage", "pilot_reports_without_questions")


def coded(df: DataFrame, entity: str, key: Column, rules: dict[str, Column]) -> DataFrame:
    """One pass over ``df``: an issue for each rule that a row breaks."""
    codes = F.array_compact(F.array(*(F.when(broken, F.lit(code)) for code, broken in rules.items())))
    return df.select(F.explode(codes).alias("code"), F.lit(entity).alias("entity"), key.cast("string").alias("id"))


def manifest_issues(documents: DataFrame, tasks: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(code, entity, id) for the two manifests.

    documents: doc_id, page_count, pdf_path, source_path, source_format, one row per record, registered_at telling
    which record of a doc_id is the last; tasks: task_id, doc_id, question, evidence_pages, and optionally task_type and
    answers, one row per record. Rules on questions and answers hold for question answering, which a task is without a type.
    files: (path) of what exists; with it, a document must point to one.
    """
    doc, task, ev = F.col("doc_id"), F.col("task_id"), F.col("evidence_pages")
    path = F.coalesce("source_path", "pdf_path")
    stamp = F.struct("registered_at", "page_count") if "registered_at" in documents.columns else F.struct("page_count")
    last = documents.where("doc_id is not null").groupBy("doc_id").agg(F.max(stamp).alias("r")).select("doc_id", F.col("r.page_count").alias("page_count"), F.lit(True).alias("known"))
    on_docs = {
        "empty_doc_id": is_blank(doc),
        "invalid_page_count": F.col("page_count").isNull() | (F.col("page_count") <= 0),
        "missing_source_path": path.isNull() | (path == ""),
        "not_ocr_input_ready": F.col("source_format").isNull() | (F.col("source_format") != "pdf"),
    }
    docs = documents
    if files is not None:
        docs = documents.withColumn("_path", path).join(files.select(F.col("path").alias("_path"), F.lit(True).alias("_there")).distinct(), "_path", "left")
        on_docs["missing_source_file"] = (path != "") & F.col("_there").isNull()
    known = F.coalesce("known", F.lit(False))
    asks = known & (F.coalesce("task_type", F.lit("question_answering")) == "question_answering" if "task_type" in tasks.columns else F.lit(True))
    on_tasks = {
        "orphan_task": ~known,
        "empty_question": asks & is_blank(F.col("question")),
        "empty_evidence_pages": asks & (ev.isNull() | (F.size(ev) == 0)),
        "duplicate_evidence_page": known & (F.size(ev) != F.size(F.array_distinct(ev))),
        "invalid_evidence_page": known & F.exists(ev, lambda p: p.isNull() | (p < 0) | (p >= F.col("page_count"))),
    }
    if "answers" in tasks.columns:
        on_tasks["empty_answers"] = asks & ~F.coalesce(F.exists("answers", lambda a: ~is_blank(a)), F.lit(False))
    return union(
        [
            issue(duplicates(documents, "doc_id"), "duplicate_doc_id", "document", doc),
            issue(duplicates(tasks, "task_id"), "duplicate_task_id", "task", task),
            coded(docs, "document", doc, on_docs),
            coded(tasks.join(last, "doc_id", "left"), "task", task, on_tasks),
        ]
    )


def histogram(issues: DataFrame) -> DataFrame:
    """(code, count)."""
    return issues.groupBy("code").agg(F.count("*").alias("count"))


def index_quantiles(df: DataFrame, column: str) -> DataFrame:
    """(quantile, value): the values at positions 0, n/4, n/2, 3n/4, n-1 of the sorted column, nulls left out.

    Positions come from a global rank over per-value counts, so that no array of all values is made.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("c"))
    # Ranges of values, each summed first: no task sees more than one range.
    ranged = cut(counts.repartitionByRange("value").withColumn("part", F.spark_partition_id()))
    offsets = ranged.groupBy("part").agg(F.sum("c").alias("s")).withColumn("before", F.coalesce(F.expr("sum(s) over (order by part rows between unbounded preceding and 1 preceding)"), F.lit(0)))
    within = F.coalesce(F.sum("c").over(Window.partitionBy("part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ranged.withColumn("within", within).join(offsets.select("part", "before"), "part").select("value", "c", (F.col("before") + F.col("within")).alias("at"))
    n = counts.agg(F.sum("c").alias("n"))
    wanted = n.where("n > 0").select(F.explode(F.array(*(F.struct(F.lit(q).alias("quantile"), p.alias("pos")) for q, p in (("min", F.lit(0).cast("long")), ("p25", F.expr("n div 4")), ("median", F.expr("n div 2")), ("p75", F.expr("3 * n div 4")), ("max", F.expr("n - 1")))))).alias("w")).select("w.*")
    return placed.join(F.broadcast(wanted), (F.col("pos") >= F.col("at")) & (F.col("pos") < F.col("at") + F.col("c"))).select("quantile", "value")


def contiguity(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, expected, present, contiguous): whether a report's pages are exactly 0..page_count-1."""
    p = pages.groupBy("doc_id").agg(F.countDistinct("page_index").alias("present"), F.min("page_index").alias("least"), F.max("page_index").alias("most"))
    ok = (F.col("least") == 0) & (F.col("most") == F.col("present") - 1) & (F.col("present") == F.col("expected"))
    return documents.select("doc_id", F.col("page_count").alias("expected")).join(p, "doc_id", "left").select("doc_id", "expected", F.coalesce("present", F.lit(0)).alias("present"), F.coalesce(ok, F.lit(False)).alias("contiguous"))


def extraction_summary(pages: DataFrame) -> DataFrame:
    """Per report: pages by status, characters, and the sorted lists of blank and failed pages."""
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, F.col("page_index")))), lambda x: x.cast("string")), ",")
    return pages.groupBy("doc_id").agg(
        F.count("*").alias("pages"),
        F.count_if(F.col("status") == "ok").alias("ok_pages"),
        F.count_if(F.col("status") == "blank_native_text").alias("blank_pages"),
        F.count_if(F.col("status").isin("page_failed", "document_failed")).alias("failed_pages"),
        F.sum(F.length("raw_text")).alias("characters"),
        listed(F.col("status") == "blank_native_text").alias("blank_page_list"),
        listed(F.col("status").isin("page_failed", "document_failed")).alias("failed_page_list"),
    )


def cached_page_issues(native_pages: DataFrame) -> DataFrame:
    """(code, doc_id, page_index) of stored page rows that a comparison must not read."""
    blank = is_blank(F.col("raw_text"))
    rules = {
        "negative_page": F.col("page_index") < 0,
        "not_zero_based": F.col("page_index_base") != 0,
        "checksum_mismatch": F.col("document_sha256") != F.col("expected_document_sha256"),
        "ok_without_text": blank & (F.col("status") == "ok"),
        "text_without_ok": ~blank & (F.col("status") != "ok"),
        "wrong_character_count": F.col("raw_text").isNotNull() & (F.coalesce("raw_character_count", F.lit(-1)) != F.length("raw_text")),
    }
    codes = F.array_compact(F.array(*(F.when(broken, F.lit(code)) for code, broken in rules.items())))
    return native_pages.select(F.explode(codes).alias("code"), "doc_id", "page_index").distinct()


def cached_report_issues(pages: DataFrame, summary: DataFrame) -> DataFrame:
    """(code, doc_id): where the pages of a report and its extraction summary disagree.

    pages: the page relation; summary: doc_id, expected_pages, failed_pages, characters.
    """
    made = pages.groupBy("doc_id").agg(F.countDistinct("page_index").alias("n"), F.min("page_index").alias("lo"), F.max("page_index").alias("hi"), F.count_if(F.col("status").isin("page_failed", "document_failed")).alias("failed"), F.sum(F.length("raw_text")).alias("made"))
    both = summary.join(made, "doc_id", "full")
    rules = {
        "report_without_pages": F.col("n").isNull(),
        "pages_without_report": F.col("expected_pages").isNull(),
        "incomplete_pages": (F.col("n") != F.col("expected_pages")) | (F.col("lo") != 0) | (F.col("hi") != F.col("expected_pages") - 1),
        "failed_count_differs": F.col("failed") != F.col("failed_pages"),
        "character_count_differs": F.col("made") != F.col("characters"),
    }
    codes = F.array_compact(F.array(*(F.when(broken, F.lit(code)) for code, broken in rules.items())))
    return both.select(F.explode(codes).alias("code"), "doc_id")


def annotation_issues(rows: DataFrame) -> DataFrame:
    """(id, code): the first rule that an annotation row breaks.

    rows: id, question, type, page_numbers (one-based), answer double, all nullable; company and year are checked where they are there.
    """
    pn = F.col("page_numbers")
    company = is_blank(F.col("company")) if "company" in rows.columns else F.lit(False)
    year = ~F.coalesce(F.col("year").cast("string").rlike(r"^[0-9]{4}$"), F.lit(False)) if "year" in rows.columns else F.lit(False)
    code = (
        F.when(is_blank(F.col("id")), "empty_id")
        .when(company, "empty_company")
        .when(year, "year_not_four_digits")
        .when(is_blank(F.col("question")), "empty_question")
        .when(~F.coalesce(F.col("type").isin("mixed", "table", "text"), F.lit(False)), "unsupported_type")
        .when(pn.isNull() | (F.size(pn) == 0), "empty_page_numbers")
        .when(F.exists(pn, lambda p: p.isNull()), "page_number_not_integer")
        .when(F.exists(pn, lambda p: p < 1), "page_below_one")
        .when(F.size(pn) != F.size(F.array_distinct(pn)), "repeated_page")
        .when(F.col("answer").isNull(), "answer_not_numeric")
        .when(F.isnan("answer") | F.col("answer").isin(float("inf"), float("-inf")), "answer_not_finite")
    )
    return rows.select("id", code.alias("code")).where("code is not null")


def question_schema_issues(questions: DataFrame) -> DataFrame:
    """Rows of the first dataset's questions without an id, a question, a document or evidence."""
    bad = is_blank(F.col("source_id")) | is_blank(F.col("doc_name")) | is_blank(F.col("question")) | F.col("evidence").isNull() | (F.size("evidence") == 0)
    bad = bad | F.exists("evidence", lambda e: e["evidence_page_num"].isNull() | (e["evidence_page_num"] < 0))
    return questions.where(bad).select(F.lit("invalid_question_schema").alias("code"), "source_id")


def dataset_issues(metadata: DataFrame, questions: DataFrame, files: DataFrame) -> DataFrame:
    """(code, entity, id) of a raw dataset, an empty table of metadata or questions included: metadata (doc_name, company, fiscal_year), questions
    (source_id, doc_name, question, evidence), files (stem, path, valid)."""
    stem = F.lower("stem")
    name = F.lower("doc_name")
    indexed = files.withColumn("n", F.row_number().over(Window.partitionBy(stem).orderBy("path")))
    first = indexed.where("n = 1")
    meta = metadata.withColumn("k", name)
    joined = meta.join(first.select(stem.alias("k"), "valid"), "k", "left")
    names = metadata.select("doc_name").distinct()
    foreign = questions.select("source_id", "doc_name", F.explode("evidence").alias("e")).where("e.evidence_doc_name is not null and e.evidence_doc_name <> doc_name").select("source_id").distinct()
    return union(
        [
            issue(metadata.agg(F.count("*").alias("n")).where("n = 0"), "empty_metadata", "dataset", F.lit("metadata")),
            issue(questions.agg(F.count("*").alias("n")).where("n = 0"), "empty_questions", "dataset", F.lit("questions")),
            issue(indexed.where("n > 1"), "duplicate_pdf_stem", "file", F.col("path")),
            issue(duplicates(metadata, "doc_name"), "duplicate_metadata_doc_name", "metadata", F.col("doc_name")),
            issue(metadata.where(is_blank(F.col("doc_name"))), "empty_doc_name", "metadata", F.col("doc_name")),
            issue(metadata.where(is_blank(F.col("company")) | F.col("fiscal_year").isNull()), "invalid_document_metadata", "metadata", F.col("doc_name")),
            issue(joined.where("valid is null"), "missing_pdf", "metadata", F.col("doc_name")),
            issue(joined.where("not valid"), "invalid_pdf", "metadata", F.col("doc_name")),
            issue(questions.where(F.col("source_id").isNotNull()).groupBy("source_id").count().where("count > 1"), "duplicate_source_question_id", "question", F.col("source_id")),
            issue(questions.join(names, "doc_name", "left_anti"), "question_unknown_document", "question", F.col("source_id")),
            issue(foreign, "cross_document_evidence", "question", F.col("source_id")),
            issue(question_schema_issues(questions), "invalid_question_schema", "question", F.col("source_id")),
            issue(first.join(meta.select(F.col("k")), stem == F.col("k"), "left_anti"), "pdf_without_metadata", "file", F.col("stem")),
        ]
    )


def gate(issues: DataFrame, warnings: tuple[str, ...] = WARNINGS) -> DataFrame:
    """(blocking, warnings, ready): one row; ready without a blocking issue."""
    soft = F.col("code").isin(*warnings)
    return issues.agg(F.count_if(~soft).alias("blocking"), F.count_if(soft).alias("warnings")).withColumn("ready", F.col("blocking") == 0)


def pilot_issues(selected: DataFrame, inventory: DataFrame, companies: int) -> DataFrame:
    """(code, entity, id): what speaks against a pilot of so many companies.

    selected: company, doc_name; inventory: doc_name, sector, qa_cases.
    """
    rows = selected.select("doc_name", "company").join(inventory.select("doc_name", "sector", "qa_cases"), "doc_name")
    total = rows.agg(F.count("*").alias("n"), F.countDistinct("company").alias("c"), F.sum("qa_cases").alias("q"), F.countDistinct(F.coalesce("sector", F.lit("Unknown"))).alias("s"), F.count_if(F.coalesce("sector", F.lit("Unknown")) == "Unknown").alias("u"))
    rules = {
        "pilot_selection_failed": F.col("c") < companies,
        "pilot_has_no_questions": (F.col("n") > 0) & (F.col("q") == 0),
        "limited_sector_coverage": (F.col("n") > 0) & ((F.col("u") > 0) | (F.col("s") < companies)),
    }
    return coded(total, "pilot", F.lit("pilot"), rules).unionByName(issue(rows.where("qa_cases = 0"), "pilot_reports_without_questions", "document", F.col("doc_name")))


def render_plan(tasks: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, pages, n_pages, blocker): the evidence pages to render of each report, and what stands in the way."""
    pages = tasks.select("doc_id", F.explode("evidence_pages").alias("p")).groupBy("doc_id").agg(F.array_sort(F.collect_set("p")).alias("pages"))
    docs = documents.select("doc_id", "page_count", F.coalesce("source_path", "pdf_path").alias("path"))
    blocker = (
        F.when(F.col("page_count").isNull(), "unknown_document")
        .when(F.col("path").isNull(), "missing_source")
        .when(~F.lower("path").endswith(".pdf"), "not_a_pdf")
        .when(F.exists("pages", lambda p: (p < 0) | (p >= F.col("page_count"))), "page_out_of_range")
    )
    return pages.join(docs, "doc_id", "left").select("doc_id", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"), F.size("pages").alias("n_pages"), blocker.alias("blocker"))
