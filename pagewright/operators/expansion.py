"""Fixed query-term expansion: a rule fires when one of its phrases stands in the question."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions.text import drop_stopwords, tokenize

MAX_ADDED = 32
# Rule, its phrases, the search terms it adds.
RULES = (
    ("quick_ratio", ("quick ratio", "quick ratios", "acid test ratio"), "cash equivalents short term investments marketable securities accounts receivable current liabilities"),
    ("current_ratio", ("current ratio", "current ratios"), "current assets liabilities"),
    ("gross_margin", ("gross margin", "gross margins", "gross profit margin", "gross profit margins"), "gross profit revenue revenues net sales cost goods sold"),
    ("operating_margin", ("operating margin", "operating margins", "operating profit margin"), "operating income profit revenue revenues net sales"),
    ("net_margin", ("net margin", "net margins", "net profit margin", "net income margin"), "net income earnings revenue revenues sales"),
    ("ebitda", ("ebitda",), "operating income profit depreciation amortization"),
    ("ebit", ("ebit",), "operating income profit"),
    ("capital_expenditure", ("capex", "capital expenditure", "capital expenditures", "capital spending"), "capital expenditures spending purchases property plant equipment"),
    ("depreciation_amortization", ("d a", "depreciation and amortization", "depreciation amortization"), "depreciation amortization cash flows"),
    ("return_on_assets", ("return on assets", "roa"), "net income total assets"),
    ("return_on_equity", ("return on equity", "roe"), "net income shareholders stockholders equity"),
    ("debt_to_equity", ("debt to equity", "debt equity"), "debt borrowings shareholders stockholders equity"),
)


def expand(queries: DataFrame) -> DataFrame:
    """(task_id, doc_id, question, matched_rules, added_terms, discarded, question_expanded).

    Phrases are sought in all tokens of the question; terms that its content tokens have are
    not added; the first 32 of the rest, in code point order, are. Expansion is not repeated.
    """
    spoken = F.concat(F.lit(" "), F.array_join("_tokens", " "), F.lit(" "))
    fires = lambda phrases: F.exists(F.array(*(F.lit(f" {p} ") for p in phrases)), lambda p: F.contains(F.col("_spoken"), p))
    q = queries.withColumn("_tokens", tokenize(F.col("question"))).withColumn("_spoken", spoken)
    q = q.withColumn("matched_rules", F.array_compact(F.array(*(F.when(fires(phrases), F.lit(name)) for name, phrases, _ in RULES))))
    offered = F.flatten(F.array(*(F.when(F.array_contains("matched_rules", name), F.array(*map(F.lit, terms.split()))).otherwise(F.array().cast("array<string>")) for name, _, terms in RULES)))
    q = q.withColumn("_new", F.array_sort(F.array_except(offered, drop_stopwords(F.col("_tokens")))))
    q = q.withColumn("added_terms", F.slice("_new", 1, MAX_ADDED)).withColumn("discarded", F.size("_new") - F.size("added_terms"))
    longer = F.when(F.size("added_terms") > 0, F.concat_ws(" ", "question", F.array_join("added_terms", " "))).otherwise(F.col("question"))
    return q.withColumn("question_expanded", longer).drop("_tokens", "_spoken", "_new")
