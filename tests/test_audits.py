import pytest
from pyspark.sql import functions as F

from pagewright.operators import audit, planning


def test_dataset_issues(spark):
    meta = spark.createDataFrame([("A", "Acme", 2020), ("A", "Acme", 2020), ("", "X", 2020), ("B", None, None), ("C", "Cee", 2019)], "doc_name string, company string, fiscal_year int")
    ev = "array<struct<evidence_page_num:int,evidence_doc_name:string>>"
    qs = spark.createDataFrame([("q1", "A", "why?", [(1, "A")]), ("q1", "A", "why?", [(1, "Z")]), ("q2", "Nope", "x", [(0, None)]), ("q3", "A", " ", [])], f"source_id string, doc_name string, question string, evidence {ev}")
    files = spark.createDataFrame([("a", "1/a.pdf", True), ("A", "2/A.pdf", True), ("b", "b.pdf", False), ("z", "z.pdf", True)], "stem string, path string, valid boolean")
    codes = {r.code for r in audit.dataset_issues(meta, qs, files).collect()}
    assert codes == {
        "duplicate_pdf_stem", "duplicate_metadata_doc_name", "empty_doc_name", "invalid_document_metadata", "missing_pdf", "invalid_pdf",
        "duplicate_source_question_id", "question_unknown_document", "cross_document_evidence", "invalid_question_schema", "pdf_without_metadata",
    }
    assert audit.gate(audit.dataset_issues(meta, qs, files)).first().ready is False


def test_annotation_issues(spark):
    rows = [("1", "q", "text", [1], 1.0), (" ", "q", "text", [1], 1.0), ("2", "", "text", [1], 1.0), ("3", "q", "odd", [1], 1.0), ("4", "q", "text", [], 1.0), ("5", "q", "text", [0], 1.0), ("6", "q", "text", [2, 2], 1.0), ("7", "q", "text", [1], None), ("8", "q", "text", [1], float("inf"))]
    df = spark.createDataFrame(rows, "id string, question string, type string, page_numbers array<int>, answer double")
    got = {r.id.strip(): r.code for r in audit.annotation_issues(df).collect()}
    assert got == {"": "empty_id", "2": "empty_question", "3": "unsupported_type", "4": "empty_page_numbers", "5": "page_below_one", "6": "repeated_page", "7": "answer_not_numeric", "8": "answer_not_finite"}


def test_quantiles(spark):
    for values in ([], [5], [3, 1, 2], list(range(100)), [7] * 9 + [None]):
        df = spark.createDataFrame([(v,) for v in values], "v int")
        s = sorted(v for v in values if v is not None)
        n = len(s)
        want = {"min": s[0], "p25": s[n // 4], "median": s[n // 2], "p75": s[3 * n // 4], "max": s[-1]} if n else {}
        assert {r.quantile: r.value for r in audit.index_quantiles(df, "v").collect()} == want


def inventory(spark):
    rows = [(f"{c}{y}", c, s, y, "10k", q if y == 2022 else 0, True) for c, s, q in (("A", "Tech", 9), ("B", "Tech", 8), ("C", "Health", 7), ("D", "Ind", 6)) for y in range(2015, 2023)]
    return spark.createDataFrame(rows, "doc_name string, company string, sector string, fiscal_year int, doc_type string, qa_cases int, pdf_valid boolean").withColumn("position", F.col("doc_name"))


def test_pilot(spark):
    got = planning.pilot_selection(inventory(spark), companies=3).collect()
    assert {r.company for r in got} == {"A", "C", "D"} and {r.fiscal_year for r in got} == {2015, 2019, 2022}
    five = planning.pilot_selection(inventory(spark), companies=1, per_company=5).collect()
    assert sorted(r.fiscal_year for r in five) == sorted({2015 + round(i * 7 / 4) for i in range(5)})
    with pytest.raises(ValueError):
        planning.pilot_selection(inventory(spark), companies=0)


def test_windows(spark):
    docs = spark.createDataFrame([("d", 12), ("e", 0)], "doc_id string, page_count int")
    rows = {(r.start_page, r.end_page) for r in planning.page_windows(docs, (1, 5, 20)).collect()}
    assert rows == {(0, 1), (5, 6), (11, 12), (0, 5), (3, 8), (7, 12), (0, 12)}
    many = [tuple(r) for r in planning.page_windows(docs, (1, 5), per_size=5, seed=9).collect()]
    assert sorted(many) == sorted(tuple(r) for r in planning.page_windows(docs, (1, 5), per_size=5, seed=9).collect()) and len(many) == 10


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id string, page_count int, pdf_path string, source_path string, source_format string")
    tasks = spark.createDataFrame([], "task_id string, doc_id string, question string, evidence_pages array<int>")
    assert audit.manifest_issues(docs, tasks).count() == 0 and audit.render_plan(tasks, docs).count() == 0
