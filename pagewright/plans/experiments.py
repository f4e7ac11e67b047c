"""End-to-end runs: rank, save, and only then open the labels.

A run is a new folder: ``queries``, ``predictions``, ``metrics`` as Parquet, and
``manifest.json`` with the policy fingerprints and the checksum of every artifact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions.text import STOPWORDS, tokenize, tokenize_content
from pagewright.operators import audit, bm25, evaluation, expansion, headings, pages
from pagewright.session import cut
from pagewright.sources import readers, writers

CONDITIONS = ("original", "stopwords", "question_expansion", "section_context", "note_formats")


def policy(condition: str, k1: float, b: float) -> dict:
    """What decides a condition's ranking, in a form that can be fingerprinted."""
    p = {"condition": condition, "k1": k1, "b": b, "full_ranking": True, "order": "-score, page_index"}
    if condition != "original":
        p["stopwords"] = sorted(STOPWORDS)
    if condition in CONDITIONS[2:]:
        p["rules"] = [list(map(str, (n, ps, t))) for n, ps, t in expansion.RULES]
    if condition in CONDITIONS[3:]:
        p |= {"heading_weight": headings.HEADING_WEIGHT, "heading_tokens": headings.MAX_TOKENS}
    return p


def rank(condition: str, page_relation: DataFrame, queries: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The full ranking of one condition: (task_id, doc_id, page_index, score, rank)."""
    bm25.guard(k1, b)
    if condition not in CONDITIONS:
        raise ValueError(f"unknown condition {condition}")
    analyzer = tokenize if condition == "original" else tokenize_content
    if condition in CONDITIONS[2:]:
        queries = expansion.expand(queries).select("task_id", "doc_id", F.col("question_expanded").alias("question"))
    scored = bm25.scores(queries, bm25.asked_tokens(queries, page_relation, analyzer), analyzer, k1, b)
    if condition in CONDITIONS[3:]:
        obs = headings.observed(page_relation)
        notes = headings.accepted_notes(headings.note_headings(obs)) if condition == "note_formats" else None
        field = headings.heading_tokens(page_relation, headings.entries(obs, notes)).join(queries.select("doc_id").distinct(), "doc_id", "left_semi")
        scored = bm25.fuse(scored, bm25.scores(queries, cut(field), analyzer, k1, b), headings.HEADING_WEIGHT)
    return bm25.ranked(scored.select("task_id", "doc_id", "page_index", "score"))


def predictions(ranking: DataFrame, queries: DataFrame, condition: str) -> DataFrame:
    """One record per task: ranked pages in order, the positive ones counted. A query whose report
    has no page keeps a record with status 'document_failed' and an empty ranking."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "page_index", "score"))), lambda x: F.struct(x["page_index"].alias("page_index"), x["score"].alias("score")))
    record = ranking.groupBy("task_id", "doc_id").agg(ordered.alias("ranked_pages"), F.count_if(F.col("score") > 0).alias("positive_score_page_count"))
    none = F.array().cast("array<struct<page_index:int,score:double>>")
    return queries.select("task_id", "doc_id").join(record, ["task_id", "doc_id"], "left").select(
        "task_id",
        "doc_id",
        F.lit(condition).alias("condition"),
        F.lit(0).alias("page_index_base"),
        F.when(F.col("ranked_pages").isNull(), "document_failed").otherwise("ok").alias("status"),
        F.coalesce("positive_score_page_count", F.lit(0)).alias("positive_score_page_count"),
        (F.coalesce("positive_score_page_count", F.lit(0)) == 0).alias("no_match"),
        F.coalesce("ranked_pages", none).alias("ranked_pages"),
    )


def unpack(saved: DataFrame) -> DataFrame:
    """Saved records as a long ranking again."""
    return saved.select("task_id", "doc_id", F.posexplode("ranked_pages").alias("i", "p")).select("task_id", "doc_id", F.col("p.page_index").alias("page_index"), F.col("p.score").alias("score"), (F.col("i") + 1).alias("rank"))


def _predict(native_pages: DataFrame, retrieval_queries: DataFrame, out: str, condition: str, k1: float, b: float) -> None:
    """Queries and predictions of one condition, on disk; no label is read."""
    spark = native_pages.sparkSession
    pages.allowed_queries(retrieval_queries).write.mode("errorifexists").parquet(f"{out}/queries")
    saved_queries = spark.read.parquet(f"{out}/queries")
    ranking = rank(condition, pages.page_relation(native_pages), saved_queries, k1, b)
    predictions(ranking, saved_queries, condition).write.mode("errorifexists").parquet(f"{out}/predictions")


def _evaluate(spark: SparkSession, labels: DataFrame, out: str, condition: str, ks, k1: float, b: float) -> DataFrame:
    """``per_question`` of the saved predictions; metrics and manifest go beside them."""
    gold = evaluation.gold_ranks(unpack(spark.read.parquet(f"{out}/predictions")), pages.label_projection(labels))
    questions = evaluation.per_question(gold, ks)
    evaluation.macro(questions).write.mode("errorifexists").parquet(f"{out}/metrics")
    sums = {r.path.partition(out.partition("://")[2] or out)[2].lstrip("/"): {"sha256": r.sha256, "size": r.size} for part in ("queries", "predictions", "metrics") for r in readers.checksums(spark, f"{out}/{part}").collect()}
    p = policy(condition, k1, b)
    writers.write_json({"status": "complete", "policy": p, "policy_sha256": writers.fingerprint(p), "artifacts": sums}, f"{out}/manifest.json", spark)
    return questions


def run(native_pages: DataFrame, retrieval_queries: DataFrame, labels: Callable[[], DataFrame], out: str, condition: str = "original", ks=evaluation.KS, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """One condition from stored pages to macro metrics. ``labels`` is called after the predictions are on disk."""
    evaluation.check_ks(ks)
    bm25.guard(k1, b)
    _predict(native_pages, retrieval_queries, out, condition, k1, b)
    _evaluate(native_pages.sparkSession, labels(), out, condition, ks, k1, b)
    return native_pages.sparkSession.read.parquet(f"{out}/metrics")


def compare(native_pages: DataFrame, retrieval_queries: DataFrame, labels: Callable[[], DataFrame], out: str, conditions=("original", "stopwords"), saved_control: str | None = None, ks=evaluation.KS, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Several conditions and their comparison, each with the one before it: (control_condition,
    treatment_condition, k, metric, ...) as in ``evaluation.comparison``.

    saved_control: the folder of an earlier run of the first condition, which must come out again, place by place.
    ``labels`` is called once, after the predictions of all conditions are on disk.
    """
    if len(conditions) < 2:
        raise ValueError("a comparison needs two conditions")
    evaluation.check_ks(ks)
    bm25.guard(k1, b)
    spark = native_pages.sparkSession
    for condition in conditions:
        _predict(native_pages, retrieval_queries, f"{out}/{condition}", condition, k1, b)
    if saved_control is not None:
        saved, again = (unpack(spark.read.parquet(f"{f}/predictions")) for f in (saved_control, f"{out}/{conditions[0]}"))
        if not evaluation.reproduction_issues(saved, again).isEmpty():
            raise ValueError("the control does not come out as it was saved")
    gold = labels()
    questions = [_evaluate(spark, gold, f"{out}/{c}", c, ks, k1, b) for c in conditions]
    pairs = [evaluation.comparison(*questions[i - 1 : i + 1]).withColumns({"control_condition": F.lit(conditions[i - 1]), "treatment_condition": F.lit(conditions[i])}) for i in range(1, len(conditions))]
    audit.union(pairs).write.mode("errorifexists").parquet(f"{out}/comparison")
    return spark.read.parquet(f"{out}/comparison")


def remaining(plan: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """The part of a plan that has no completed record, for runs that go on where they stopped."""
    return plan.join(done.where("status = 'ok'").select(*keys).distinct(), list(keys), "left_anti")
