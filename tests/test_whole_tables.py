"""Operators once run on literal rows only, over whole tables and on the shapes the tables lack."""

import random

from pyspark.sql import functions as F

from pagewright.operators import planning
from pagewright.plans import auditing, ranking


def test_order_is_global_over_ranges(spark):
    ids = [str(i) for i in range(3000)] + [f"q{i}" for i in range(2000)] + ["7", "q7", "007"]
    random.Random(1).shuffle(ids)
    df = planning.numeric_aware_order(spark.createDataFrame([(i,) for i in ids], "id string").repartition(7), "id")
    want = sorted(ids, key=lambda i: (0, int(i), i) if i.isdigit() else (1, 0, i))
    rows = df.collect()
    assert [r.id for r in sorted(rows, key=lambda r: r.position)] == want
    assert sorted(r.position for r in rows) == list(range(1, len(ids) + 1))


def test_order_has_no_global_window(spark):
    df = planning.numeric_aware_order(spark.range(1000).select(F.col("id").cast("string").alias("id")), "id")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number() windowspecdefinition(_range" in plan


def test_orders_and_reports_cover_the_tables(spark, folder):
    tasks = spark.read.parquet(f"{folder}/retrieval_queries.parquet").where("task_id is not null").select("task_id").distinct().count()
    assert auditing.numeric_aware_order(spark, folder).count() == tasks
    p = ranking._pages(spark, folder).select("doc_id").distinct()
    d = auditing._docs(spark, folder).select("doc_id")
    split, issues = auditing.split_marked_pages(spark, folder).select("doc_id").distinct(), auditing.split_marked_issues(spark, folder).select("doc_id")
    assert split.unionAll(issues).count() == p.union(d).distinct().count()


def write(spark, path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")


def test_marked_reports(spark, tmp_path):
    rows = [("ok", 1, " b \n"), ("ok", 0, "a\n---"), ("gap", 0, "a"), ("gap", 2, "c"), ("late", 1, "b"), ("below", -4, "x"), ("below", 0, "a")]
    write(spark, tmp_path, "native_pages", [(*r, "ok", None) for r in rows], "doc_id string, page_index int, raw_text string, status string, extracted_at timestamp")
    write(spark, tmp_path, "doc_records", [(d, None, 1) for d in ("ok", "empty")], "doc_id string, registered_at timestamp, page_count int")
    pages, issues = auditing.split_marked_pages(spark, str(tmp_path)).collect(), auditing.split_marked_issues(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.page_index) for r in pages) == [("ok", 0), ("ok", 1)]
    assert {r.doc_id: r.code for r in issues} == {"gap": "not_contiguous", "late": "not_contiguous", "below": "not_contiguous", "empty": "no_markers"}


def test_scopes_cover_the_headings(spark, folder):
    own = ranking.heading_observation(spark, folder).where("mode = 'observed'").count()
    assert ranking.scope_and_inheritance(spark, folder).count() == own > 0


def test_number_pairs(spark):
    from pagewright.functions import metrics

    pairs = [("$1,000.00", "1005", 0.01, True), ("(125)", "-125", 0.0, True), ("1000", "1200", 0.01, False), ("no number", "1", 0.5, False), ("about $ 12.5 million", "12.50", 0.001, True), ("-3", "3", 0.1, False)]
    df = spark.createDataFrame(pairs, "a string, b string, t double, want boolean")
    assert [r.got for r in df.select(metrics.numeric_match(F.col("a"), F.col("b"), F.col("t")).alias("got")).collect()] == [p[3] for p in pairs]


def test_order_of_worked_ids(spark):
    df = planning.numeric_aware_order(spark.createDataFrame([(i,) for i in ("10", "9", "q2", "q10", "007", "a")], "id string"), "id")
    assert [r.id for r in df.orderBy("position").collect()] == ["007", "9", "10", "a", "q10", "q2"]
