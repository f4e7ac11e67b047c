import struct
import zlib

import pytest
from pyspark.sql import functions as F

from pagewright.operators import audit, datasets, planning
from pagewright.sources import readers

ANN = "id string, company string, year string, question string, type string, page_numbers array<int>, answer double"
REP = "company string, year string, doc_id string, page_count int"


def release(spark, ann, rep):
    return spark.createDataFrame(ann, ANN), spark.createDataFrame(rep, REP)


def test_release_audit(spark):
    a, r = release(spark, [("1", "A", "2020", "q", "text", [1, 3], 5.0), ("2", "A", "2020", "q", "table", [9], 0.5), ("3", "B", "2020", "q", "text", [2], None)], [("A", "2020", "a", 4), ("C", "2021", "c", 7)])
    got = {(x["measure"], x["value"]): x["count"] for x in datasets.release_audit(a, r).collect()}
    assert got["annotations", ""] == 3 and got["task_documents", ""] == 2 and got["reports_without_tasks", ""] == 1 and got["missing_report", "B/2020"] == 1
    assert got["invalid_evidence", "2"] == 1 and got["structurally_valid", ""] == 0 and got["evidence_page_max", ""] == 9 and got["companies", ""] == 2
    assert got["answer_type", "whole"] == got["answer_type", "fraction"] == got["answer_type", "none"] == 1 and got["task_document_pages_max", ""] == 4
    empty = {(x["measure"], x["value"]): x["count"] for x in datasets.release_audit(a.limit(0), r.limit(0)).collect()}
    assert empty["annotations", ""] == 0 and empty["structurally_valid", ""] == 1


def test_conversion(spark):
    a, r = release(spark, [("1", "A", "2020", "q", "text", [1, 3], 5.0), ("2", "A", "2020", "q", "table", [9], 0.25)], [("A", "2020", "a", 4)])
    chosen = spark.createDataFrame([("A", "2020"), ("B", "2021"), ("A", "2020")], "company string, year string")
    tasks, issues = datasets.convert_annotations(a, r, chosen)
    assert {(t.task_id, t.doc_id, tuple(t.evidence_pages), t.answers[0]) for t in tasks.collect()} == {("longdoc:1", "a", (0, 2), "5.0"), ("longdoc:2", "a", (8,), "0.25")}
    assert {tuple(i) for i in issues.collect()} == {("report_without_annotations", "B/2021"), ("report_missing", "B/2021"), ("evidence_beyond_report", "2")}


def test_answers_and_key_sets(spark):
    df = spark.createDataFrame([(1.5,), (None,), (1e16,)], "x double")
    assert [r.a for r in df.select(datasets.answer_text(F.col("x")).alias("a")).collect()] == ["1.5", None, "1e+16"]
    with pytest.raises(Exception, match="not finite"):
        spark.createDataFrame([(float("nan"),)], "x double").select(datasets.answer_text(F.col("x"))).collect()
    rows = spark.createDataFrame([("a", '{"x": 1, "y": 2}'), ("b", '{"x": 1, "z": 2}'), ("c", "no json"), ("d", None)], "id string, t string")
    assert {tuple(r) for r in datasets.key_set_issues(rows, "id", "t", ["x", "y"]).collect()} == {("b", "y", "z"), ("c", "x,y", ""), ("d", "x,y", "")}


def test_readiness(spark):
    issues = spark.createDataFrame([], "code string, entity string, id string")
    docs = spark.createDataFrame([("a", "pdf", 3)], "doc_id string, source_format string, page_count int")
    tasks = spark.createDataFrame([("t1",)], "task_id string")
    checks = lambda *rows: spark.createDataFrame(list(rows), "task_id string, status string, human_signoff boolean, finding_codes array<string>")
    state = lambda c, n: {(r["measure"], r["value"]): r["count"] for r in datasets.readiness(issues, docs, tasks, c, n).collect()}
    assert state(checks(("t1", "pass", True, [])), 1)["status", "ready_for_ocr_dry_run"] == 0
    got = state(checks(("t1", "fail", None, ["bad_page"]), ("t9", "pass", True, [])), 0)
    assert got["status", "blocked_before_ocr"] == 4 and got["blocker", "unknown_task"] == 1 and got["finding", "bad_page"] == 1 and ("blocker", "source_pdfs_unavailable") in got


def test_manifest_rules(spark):
    docs = spark.createDataFrame([("d", 5, "a.pdf", None, "pdf", 1), ("d", 9, "b.pdf", None, "pdf", 2), ("e", 1, None, None, None, 1)], "doc_id string, page_count int, pdf_path string, source_path string, source_format string, registered_at int")
    tasks = spark.createDataFrame([("t1", "d", "q", [7], None, ["x"]), ("t2", "d", None, None, "extraction", None), ("t3", "d", "q", [9], "question_answering", [" "]), ("t4", "gone", "q", [0], None, ["x"])], "task_id string, doc_id string, question string, evidence_pages array<int>, task_type string, answers array<string>")
    files = spark.createDataFrame([("a.pdf",)], "path string")
    got = {(r.code, r.id) for r in audit.manifest_issues(docs, tasks, files).collect()}
    assert got == {("duplicate_doc_id", "d"), ("missing_source_file", "d"), ("missing_source_path", "e"), ("not_ocr_input_ready", "e"), ("empty_answers", "t3"), ("invalid_evidence_page", "t3"), ("orphan_task", "t4")}


def test_annotation_keys(spark):
    df = spark.createDataFrame([("1", "A", "2020"), ("2", " ", "2020"), ("3", "A", "20x0")], "id string, company string, year string").selectExpr("*", "'q' as question", "'text' as type", "array(1) as page_numbers", "1.0D as answer")
    assert {tuple(r) for r in audit.annotation_issues(df).collect()} == {("2", "empty_company"), ("3", "year_not_four_digits")}


def test_too_few_companies(spark):
    inv = spark.createDataFrame([(f"d{y}", "A", "Tech", y, "10k", 1, True, f"d{y}") for y in range(8)], "doc_name string, company string, sector string, fiscal_year int, doc_type string, qa_cases int, pdf_valid boolean, position string")
    with pytest.raises(ValueError, match="fewer than 2"):
        planning.pilot_selection(inv, companies=2)
    few = planning.pilot_selection(inv, companies=2, strict=False)
    assert {r.code for r in audit.pilot_issues(few, inv, 2).collect()} == {"pilot_selection_failed", "limited_sector_coverage"}


def test_no_enabled_model(spark):
    docs = spark.createDataFrame([("d", 12)], "doc_id string, page_count int")
    models = spark.createDataFrame([("off", False, ["x"])], "id string, enabled boolean, strategies array<string>")
    assert planning.job_matrix(docs, models, planning.page_windows(docs)).count() == 0


def png(*chunks, size=(2, 3)):
    body = lambda kind, data: struct.pack(">I4s", len(data), kind) + data + struct.pack(">I", zlib.crc32(kind + data))
    head = body(b"IHDR", struct.pack(">IIBBBBB", *size, 8, 2, 0, 0, 0))
    return b"\x89PNG\r\n\x1a\n" + head + b"".join(body(*c) for c in chunks)


def test_png():
    sound = [(b"IDAT", b"x"), (b"IEND", b"")]
    assert readers.png_problem(png(*sound)) is None
    assert readers.png_problem(png(*sound, size=(0, 3))) == "header"
    assert readers.png_problem(png((b"IHDR", b"x" * 13), *sound)) == "second_header"
    assert readers.png_problem(png((b"IDAT", b"x"), (b"IEND", b"x"))) == "structure"


def test_safe_names(spark):
    df = spark.createDataFrame([("a.b//c d" + "x" * 120,)], "i string").select(readers.safe_name(F.col("i")).alias("n"))
    name = df.first().n
    assert name.startswith("a_b__c_dxx") and len(name) == 113


def opener():
    """Pages divided by '|'; nested, so that workers get it by value."""

    class Sheet:
        def __init__(self, text):
            self.text = text

        def extract_text(self):
            if self.text == "!":
                raise ValueError("bad page")
            return self.text

    def sheets(content):
        if content.startswith(b"no pdf"):
            raise OSError("cannot open")
        return [Sheet(t) for t in content.decode().split("|")]

    return sheets


def test_pdf_rows(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one| |!|four")
    (tmp_path / "b.pdf").write_bytes(b"no pdf")
    paths = {r.path.rsplit("/", 1)[-1]: r.path for r in spark.read.format("binaryFile").load(str(tmp_path)).collect()}
    expected = spark.createDataFrame([(paths["a.pdf"], 9), (paths["b.pdf"], 3)], "path string, page_count int")
    rows = readers.pdf_pages(spark, str(tmp_path), expected, opener()).collect()
    assert [(r.page_index, r.status) for r in sorted(rows, key=lambda r: r.page_index) if r.path == paths["a.pdf"]] == [(0, "ok"), (1, "blank_native_text"), (2, "page_failed"), (3, "ok")]
    assert [(r.page_index, r.status) for r in sorted(rows, key=lambda r: r.page_index) if r.path == paths["b.pdf"]] == [(i, "document_failed") for i in range(3)]
    (tmp_path / "a.pdf").write_bytes(b"one| |three|four")
    seen = {r.path: (r.page_count, r.sample_pages, r.readable_pages, r.valid) for r in readers.pdf_inspection(spark, str(tmp_path), opener()).collect()}
    assert seen == {paths["a.pdf"]: (4, [0, 2, 3], 3, True), paths["b.pdf"]: (0, [], 0, False)}


def test_configuration_on_any_storage(spark, tmp_path):
    (tmp_path / "m.json").write_text("\ufeff{\"a\": 1}", encoding="utf-8")
    assert readers.read_json(str(tmp_path / "m.json")) == readers.read_json(f"file://{tmp_path}/m.json", spark) == {"a": 1}
    docs = spark.createDataFrame([("d", "x/y.pdf", None, "0" * 63)], "doc_id string, source_path string, pdf_path string, sha256 string")
    assert not readers.rebased(docs, "/r").first().checksum_valid
    with pytest.raises(Exception, match="frozen manifest"):
        readers.rebased(docs, "/r", strict=True).collect()


def test_audit_report(spark):
    from pagewright.sources import writers

    issues = spark.createDataFrame([("x", "task", str(i)) for i in range(30)] + [("not_ocr_input_ready", "document", "d")], "code string, entity string, id string")
    text = writers.audit_report("Audit", audit.gate(issues), audit.histogram(issues), issues, each=2)
    assert "Blocked: 30 blocking, 1 warnings" in text and "| x | 30 | 0, 1 |" in text
