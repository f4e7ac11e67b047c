import json

import pytest
from pyspark.sql import functions as F

from pagewright.operators import evaluation
from pagewright.plans import experiments as x


def inputs(spark):
    pages = spark.createDataFrame(
        [("d", 0, "Notes to Consolidated Financial Statements\n1. Revenue Policies\ncash", "ok", 1), ("d", 1, "revenue of the year", "ok", 1), ("d", 2, None, "blank_native_text", 1)],
        "doc_id string, page_index int, raw_text string, status string, extracted_at int",
    )
    queries = spark.createDataFrame([("a", "d", "what is the revenue"), ("a", "d", "what is the revenue"), ("b", "gone", "x"), ("c", "d", " ")], "task_id string, doc_id string, question string")
    labels = spark.createDataFrame([("a", "d", [1]), ("b", "gone", [0])], "task_id string, doc_id string, evidence_pages array<int>")
    return pages, queries, labels


@pytest.mark.parametrize("condition", x.CONDITIONS)
def test_run(spark, tmp_path, condition):
    pages, queries, labels = inputs(spark)
    out, opened = str(tmp_path / "run"), []

    def open_labels():
        opened.append((tmp_path / "run" / "predictions" / "_SUCCESS").exists())
        return labels

    m = {r.k: r for r in x.run(pages, queries, open_labels, out, condition).collect()}
    assert opened == [True] and m[1].questions == 2 and m[5].recall == 0.5
    saved = {r.task_id: r for r in spark.read.parquet(f"{out}/predictions").collect()}
    assert saved["b"].status == "document_failed" and saved["b"].no_match and len(saved["a"].ranked_pages) == 3
    manifest = json.loads((tmp_path / "run" / "manifest.json").read_text())
    assert manifest["status"] == "complete" and len(manifest["artifacts"]) >= 3
    with pytest.raises(Exception):
        x.run(pages, queries, open_labels, out, condition)


def test_changed_labels_never_change_a_ranking(spark, tmp_path):
    pages, queries, labels = inputs(spark)
    x.run(pages, queries, lambda: labels, str(tmp_path / "1"))
    x.run(pages, queries, lambda: labels.withColumn("evidence_pages", F.array(F.lit(2))), str(tmp_path / "2"))
    a, b = (x.unpack(spark.read.parquet(str(tmp_path / n / "predictions"))) for n in "12")
    assert evaluation.reproduction_issues(a, b).count() == 0 and a.count() == 3


def test_guards(spark, tmp_path):
    pages, queries, labels = inputs(spark)
    with pytest.raises(ValueError):
        x.rank("nonsense", pages, queries)
    with pytest.raises(ValueError):
        x.run(pages, queries, lambda: labels, str(tmp_path / "r"), ks=(0,))
    assert x.policy("original", 1.2, 0.75) != x.policy("stopwords", 1.2, 0.75)


def test_remaining(spark):
    plan = spark.createDataFrame([("d", 0), ("d", 1)], "doc_id string, page_index int")
    done = spark.createDataFrame([("d", 0, "ok"), ("d", 1, "failed")], "doc_id string, page_index int, status string")
    assert [tuple(r) for r in x.remaining(plan, done, "doc_id", "page_index").collect()] == [("d", 1)]


def test_compare(spark, tmp_path):
    pages, queries, labels = inputs(spark)
    x.run(pages, queries, lambda: labels, str(tmp_path / "saved"))
    opened = []

    def open_labels():
        opened.append([(tmp_path / "out" / c / "predictions" / "_SUCCESS").exists() for c in x.CONDITIONS[:3]])
        return labels

    got = x.compare(pages, queries, open_labels, str(tmp_path / "out"), x.CONDITIONS[:3], saved_control=str(tmp_path / "saved")).collect()
    assert opened == [[True] * 3] and len(got) == 2 * 3 * 4
    assert {(r.control_condition, r.treatment_condition) for r in got} == {("original", "stopwords"), ("stopwords", "question_expansion")}
    assert all(r.questions == r.gains + r.regressions + r.unchanged == 2 for r in got)
    other = pages.withColumn("raw_text", F.concat("raw_text", F.lit(" revenue")))
    with pytest.raises(ValueError, match="as it was saved"):
        x.compare(other, queries, open_labels, str(tmp_path / "again"), saved_control=str(tmp_path / "saved"))
    assert len(opened) == 1
    with pytest.raises(ValueError, match="two conditions"):
        x.compare(pages, queries, open_labels, str(tmp_path / "one"), ("original",))
