import math
import random

import pytest
from pyspark.sql import functions as F

from pagewright.functions.text import tokenize_content
from pagewright.operators import bm25, evaluation, expansion, pages


def page_df(spark, rows, doc="d"):
    return spark.createDataFrame([(doc, p, t) for p, t in rows], "doc_id string, page_index int, raw_text string")


def query_df(spark, question, doc="d", task="q"):
    return spark.createDataFrame([(task, doc, question)], "task_id string, doc_id string, question string")


def scores(q, p, **k):
    return bm25.scores(q, bm25.asked_tokens(q, p), **k)


def ranked(spark, rows, question, **k):
    return [(r.page_index, r.score) for r in bm25.ranked(scores(query_df(spark, question), page_df(spark, rows), **k)).orderBy("rank").collect()]


def test_hand_computed_scores(spark):
    got = ranked(spark, [(0, "revenue revenue cost"), (1, "revenue"), (2, "")], "revenue revenue")
    assert [p for p, _ in got] == [1, 0, 2]
    idf, avg = math.log1p(1.5 / 2.5), 4 / 3
    assert got[0][1] == pytest.approx(idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 / avg)), abs=1e-12)
    assert got[2][1] == 0


def test_saturation_and_length(spark):
    s = dict(ranked(spark, [(0, "profit x x x x x"), (1, "profit"), (2, "profit profit")], "profit"))
    assert s[1] > s[0] and s[1] < s[2] < 2 * s[1]


def test_ties_by_page_and_unseen_terms(spark):
    rows = [(3, "cost"), (0, ""), (2, "cost"), (1, "")]
    assert [p for p, _ in ranked(spark, rows, "cost")] == [2, 3, 0, 1]
    assert ranked(spark, rows, "unseen") == [(0, 0.0), (1, 0.0), (2, 0.0), (3, 0.0)]


def test_attribution_sums_to_score(spark):
    rows = [(0, "profit profit cash"), (1, "cash"), (2, "")]
    q, p = query_df(spark, "cash profit"), page_df(spark, rows)
    total = {r.page_index: r.s for r in bm25.contributions(q, bm25.asked_tokens(q, p)).groupBy("page_index").agg(F.sum("contribution").alias("s")).collect()}
    for r in scores(q, p).collect():
        assert r.score == pytest.approx(total.get(r.page_index, 0.0), abs=1e-12)


def test_labels_do_not_matter_and_scope_is_the_report(spark):
    p = page_df(spark, [(0, "cash")]).unionByName(page_df(spark, [(0, "cash cash")], "other"))
    assert scores(query_df(spark, "cash"), p).count() == 1


def test_guards():
    for k1, b in ((0, 0.5), (float("nan"), 0.5), (1.2, -0.1), (1.2, 1.1)):
        with pytest.raises(ValueError):
            bm25.guard(k1, b)
    with pytest.raises(ValueError):
        evaluation.check_ks((1, 1))


def test_expansion_fixtures(spark):
    rows = [("1", "acid-test ratio"), ("2", "D&A margin"), ("3", "EBITDAish and quickness ratio")]
    df = spark.createDataFrame([(a, "d", b) for a, b in rows], "task_id string, doc_id string, question string")
    got = {r.task_id: r.matched_rules for r in expansion.expand(df).collect()}
    assert got == {"1": ["quick_ratio"], "2": ["depreciation_amortization"], "3": []}
    every = " ".join(phrases[0] for _, phrases, _ in expansion.RULES)
    r = expansion.expand(query_df(spark, every)).first()
    assert len(r.matched_rules) == 12 and len(r.added_terms) == 32 and r.discarded > 0 and r.added_terms == sorted(r.added_terms)


def ranking_df(spark, rankings):
    return spark.createDataFrame([(t, "d", p, i) for t, ps in rankings.items() for i, p in enumerate(ps, 1)], "task_id string, doc_id string, page_index int, rank int")


def label_df(spark, labels):
    return spark.createDataFrame([(t, "d", p) for t, p in labels.items()], "task_id string, doc_id string, evidence_pages array<int>")


def test_metrics_keep_failures(spark):
    gold = evaluation.gold_ranks(ranking_df(spark, {"a": [1, 0, 3, 2]}), label_df(spark, {"a": [1, 3, 3], "b": [2]}))
    m = {r.k: r for r in evaluation.macro(evaluation.per_question(gold)).collect()}
    assert (m[1].recall, m[1].any_hit_rate, m[1].all_hit_rate) == (0.25, 0.5, 0.0)
    assert (m[3].recall, m[3].any_hit_rate, m[3].all_hit_rate) == (0.5, 0.5, 0.5) and m[1].mrr == 0.5


def test_input_issues(spark):
    docs = spark.createDataFrame([("d", 3)], "doc_id string, page_count int")
    ok = evaluation.input_issues(ranking_df(spark, {"a": [0, 1, 2]}), label_df(spark, {"a": [2]}), docs)
    assert ok.count() == 0
    bad = evaluation.input_issues(ranking_df(spark, {"a": [0, 0, 5], "c": [0]}), label_df(spark, {"a": [9], "b": []}), docs)
    assert {r.code for r in bad.collect()} == {"missing_prediction", "prediction_without_label", "empty_evidence", "evidence_out_of_range", "duplicate_ranked_page", "ranked_page_out_of_range", "incomplete_ranking"}


def test_paired(spark):
    labels = label_df(spark, {"a": [0, 3]})
    c = evaluation.gold_ranks(ranking_df(spark, {"a": [1, 2, 0, 3]}), labels)
    t = evaluation.gold_ranks(ranking_df(spark, {"a": [0, 1, 3, 2]}), labels)
    pairs = evaluation.paired(evaluation.per_question(c), evaluation.per_question(t))
    r = {x.k: x for x in pairs.collect()}
    assert r[3].d_recall == 0.5 and r[1].d_rr == pytest.approx(2 / 3)
    assert {(x.k, x.metric): x.gains for x in evaluation.paired_counts(pairs).collect()}[(3, "recall")] == 1
    assert {x.page_index: x.change for x in evaluation.rank_change(c, t).collect()} == {0: -2, 3: -1}


def test_reproduction(spark):
    s = ranking_df(spark, {"a": [1, 0]}).withColumn("score", F.lit(1.0))
    assert evaluation.reproduction_issues(s, s).count() == 0
    assert evaluation.reproduction_issues(s, s.withColumn("score", F.col("score") + 1e-9)).count() == 2


def test_page_relation(spark):
    rows = [("d", 0, None, "page_failed", 1), ("d", 0, "text", "ok", 2), ("d", 1, " ", "ok", 1), ("d", 1, None, "blank_native_text", 3), (None, 0, "x", "ok", 1)]
    df = spark.createDataFrame(rows, "doc_id string, page_index int, raw_text string, status string, extracted_at int")
    assert {(r.page_index, r.raw_text, r.status) for r in pages.page_relation(df).collect()} == {(0, "text", "ok"), (1, "", "blank_native_text")}


def test_hot_report_plan_reads_few_columns(spark, folder):
    from pagewright.sources.tables import table

    df = pages.page_relation(table(spark, folder, "native_pages", "doc_id", "page_index", "raw_text", "status", "extracted_at"))
    plan = bm25.scores(query_df(spark, "cash"), bm25.page_tokens(df, tokenize_content), tokenize_content)._jdf.queryExecution().executedPlan().toString()
    assert "elapsed_seconds" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_rank_in_strips_is_the_plain_rank(spark, monkeypatch):
    monkeypatch.setattr(bm25, "STRIP_PAGES", 7)
    rng = random.Random(3)
    rows = [(t, "d", p, rng.choice([0.0, 0.0, 0.5, 0.5, rng.random() * 4])) for t in ("a", "b") for p in rng.sample(range(-5, 300), 200)]
    df = spark.createDataFrame(rows, "task_id string, doc_id string, page_index int, score double")
    got = {(r.task_id, r.page_index): r["rank"] for r in bm25.ranked(df).collect()}
    for t in "ab":
        order = sorted((r for r in rows if r[0] == t), key=lambda r: (-r[3], r[2]))
        assert [got[t, r[2]] for r in order] == list(range(1, 201))


def test_fields_must_cover_the_same_pages(spark):
    schema = "task_id string, doc_id string, page_index int, score double"
    body, head = spark.createDataFrame([("q", "d", 0, 1.0), ("q", "d", 1, 0.0)], schema), spark.createDataFrame([("q", "d", 0, 2.0)], schema)
    assert bm25.fuse(head, head).first().score == 2.5
    with pytest.raises(Exception, match="same pages"):
        bm25.fuse(body, head).collect()
