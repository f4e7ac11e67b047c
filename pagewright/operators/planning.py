"""Experiment planning and deterministic selection."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.session import cut

PAGE_SIZES = (1, 2, 5, 10, 20, 40)
ANNUAL_TYPES = ("10k", "10k_annualreport")


def page_windows(documents: DataFrame, sizes=PAGE_SIZES, per_size: int = 3, seed: int = 2026) -> DataFrame:
    """(doc_id, start_page, end_page): beginning, middle and end windows of every size, distinct.

    A size above the report's length is the whole report. Up to three windows per size are
    the anchors; more are drawn by a generator seeded with the report's id.
    """
    docs = documents.where("page_count > 0").select("doc_id", "page_count")
    sized = docs.withColumn("requested", F.explode(F.array(*map(F.lit, sizes)))).withColumn("size", F.least("requested", "page_count")).withColumn("last", F.col("page_count") - F.col("size"))
    if per_size <= 3:
        anchors = F.slice(F.array_sort(F.array_distinct(F.array(F.lit(0), "last", F.expr("last div 2")))), 1, per_size)
        rows = sized.withColumn("start_page", F.explode(anchors))
    else:
        anchors = F.array_sort(F.array_distinct(F.array(F.lit(0), "last", F.expr("last div 2"))))
        # A report's sizes in their order, since they share one generator; only the further starts are drawn in Python.
        lasts = F.transform(F.array(*map(F.lit, sizes)), lambda s: F.greatest(F.col("page_count") - s, F.lit(0)))
        extra = docs.select("doc_id", F.posexplode(_further_starts(per_size, seed)("doc_id", lasts)).alias("i", "drawn"))
        order = F.array_position(F.array(*map(F.lit, sizes)), F.col("requested")).cast("int") - 1
        joined = sized.withColumn("i", order).join(extra, ["doc_id", "i"])
        rows = joined.withColumn("start_page", F.explode(F.slice(F.array_sort(F.array_distinct(F.concat(anchors, "drawn"))), 1, per_size)))
    return rows.select("doc_id", "start_page", (F.col("start_page") + F.col("size")).alias("end_page")).distinct()


def _further_starts(per_size: int, seed: int):
    """For each size, what the report's generator adds to the anchors until there are ``per_size`` starts, or all."""

    def of_report(doc_id: str, lasts) -> list[list[int]]:
        generator = random.Random(f"{seed}:{doc_id}")

        def more(last: int) -> list[int]:
            fixed, wanted = {0, last // 2, last}, min(per_size, last + 1)
            stream = iter(lambda: generator.randint(0, last), None)
            new: dict[int, None] = {}
            while len(fixed) + len(new) < wanted:
                new |= dict.fromkeys({next(stream)} - fixed)
            return list(new)

        return [more(int(last)) for last in lasts]

    @F.pandas_udf("array<array<int>>")
    def draw(doc_id: pd.Series, lasts: pd.Series) -> pd.Series:
        return pd.Series(list(map(of_report, doc_id, lasts)))

    return draw


def job_matrix(documents: DataFrame, models: DataFrame, windows: DataFrame) -> DataFrame:
    """(doc_id, model_id, strategy, start_page, end_page, page_count): every enabled model and strategy on every window.

    models: id, enabled, strategies; a handful of rows from a configuration file, hence a
    nested-loop join with them is a projection that repeats each window.
    """
    m = models.where(F.coalesce("enabled", F.lit(True))).select(F.col("id").alias("model_id"), F.explode("strategies").alias("strategy"))
    w = windows.join(documents.select("doc_id"), "doc_id", "left_semi")
    pairs = [(r.model_id, r.strategy) for r in m.collect()]
    none = F.array().cast("array<struct<model_id:string,strategy:string>>")
    each = F.explode(F.concat(none, *(F.array(F.struct(F.lit(a).alias("model_id"), F.lit(b).alias("strategy"))) for a, b in pairs))).alias("m")
    return w.select("doc_id", "start_page", "end_page", each).select("doc_id", "m.model_id", "m.strategy", "start_page", "end_page", (F.col("end_page") - F.col("start_page")).alias("page_count"))


def sample_pages(documents: DataFrame) -> DataFrame:
    """(doc_id, page_index): first, middle and last page, distinct."""
    return documents.where("page_count > 0").select("doc_id", F.explode(F.array_distinct(F.array(F.lit(0), F.expr("page_count div 2"), F.col("page_count") - 1))).alias("page_index"))


def company_rollup(inventory: DataFrame) -> DataFrame:
    """(company, sector, years, qa_cases, annotated_documents, documents); first non-empty sector by position, else 'Unknown'.

    inventory: company, sector, fiscal_year, qa_cases, position.
    """
    return inventory.groupBy("company").agg(
        F.coalesce(F.min_by("sector", F.when(F.coalesce("sector", F.lit("")) != "", F.col("position"))), F.lit("Unknown")).alias("sector"),
        F.countDistinct("fiscal_year").alias("years"),
        F.sum("qa_cases").alias("qa_cases"),
        F.count_if(F.col("qa_cases") > 0).alias("annotated_documents"),
        F.count("*").alias("documents"),
    )


def choose_companies(companies: DataFrame, count: int, least_years: int) -> DataFrame:
    """The ``count`` companies of a pilot: the best of each sector first, then the best of the rest.

    Only as many rows as are asked for pass the global order.
    """
    order = [F.desc("qa_cases"), F.desc("annotated_documents"), F.desc("years"), F.asc("company")]
    ranked = companies.where(F.col("years") >= least_years).withColumn("in_sector", F.row_number().over(Window.partitionBy("sector").orderBy(*order)))
    return ranked.withColumn("first_of_sector", F.col("in_sector") == 1).orderBy(F.desc("first_of_sector"), *order).limit(count).drop("in_sector")


def spaced(n: Column, wanted: int) -> Column:
    """Distinct indices into 0..n-1: the middle for 1, first/middle/last for 3, else evenly spaced, halves to even."""
    if wanted == 1:
        picks = [F.floor(n / 2)]
    elif wanted == 3:
        picks = [F.lit(0), F.floor(n / 2), n - 1]
    else:
        picks = [F.bround(F.lit(float(i)) * (n - 1) / (wanted - 1), 0) for i in range(wanted)]
    return F.array_distinct(F.array(*(p.cast("int") for p in picks)))


def pilot_selection(inventory: DataFrame, companies: int = 4, per_company: int = 3, least_years: int = 8, strict: bool = True) -> DataFrame:
    """(company, fiscal_year, doc_name): the reports of a pilot.

    inventory: doc_name, company, sector, fiscal_year, doc_type, qa_cases, pdf_valid, position.
    strict: fewer companies than asked for are an error; otherwise ``audit.pilot_issues`` reports them.
    """
    if min(companies, per_company, least_years) < 1:
        raise ValueError("counts and years must be positive")
    annual = inventory.where(F.col("doc_type").isin(*ANNUAL_TYPES) & F.col("pdf_valid"))
    chosen = choose_companies(company_rollup(annual), companies, max(least_years, per_company))
    if strict and chosen.count() < companies:
        raise ValueError(f"fewer than {companies} companies have {max(least_years, per_company)} years of annual reports")
    rows = annual.join(chosen.select("company", F.col("years").alias("n_years")), "company")
    by_year = Window.partitionBy("company").orderBy("fiscal_year")
    rows = rows.withColumn("year_index", F.dense_rank().over(by_year) - 1).where(F.array_contains(spaced(F.col("n_years"), per_company), F.col("year_index")))
    best = Window.partitionBy("company", "fiscal_year").orderBy(F.desc("qa_cases"), F.col("doc_type") != "10k", "doc_name")
    return rows.withColumn("n", F.row_number().over(best)).where("n = 1").select("company", "fiscal_year", "doc_name")


def numeric_aware_order(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``position``: ids of digits first, by number, then the rest as strings.

    Rows are split into ranges and numbered in each; a range starts after the rows of those
    before it. Only the ranges' sizes, one row each, pass a global order.
    """
    c = F.col(column)
    digits = c.rlike(r"^\p{Nd}+$")
    keys = df.select("*", (~digits).alias("_rest"), F.when(digits, c.try_cast("decimal(38,0)")).alias("_number"))
    order = ["_rest", "_number", column]
    ranged = cut(keys.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_range").agg(F.count("*").alias("n")).select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_inside", inside).join(starts, "_range").select(*df.columns, (F.col("_start") + F.col("_inside")).cast("int").alias("position"))
