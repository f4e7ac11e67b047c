import re
import unicodedata

from hypothesis import HealthCheck, assume, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagewright.functions import metrics, text

TOKEN = re.compile(r"[+\-]?\d+(?:[.,]\d+)*%?|[^\W\d_]+")


def plain_tokens(t):
    return TOKEN.findall(" ".join(unicodedata.normalize("NFKC", t).replace("−", "-").split()).casefold())


def run(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.select("i", fn(F.col("t")).alias("x")).orderBy("i").select("x").collect()]


def test_tokens_of_fixtures(spark):
    got = run(spark, ["ﬁnancial loss\n−12.50% ($1,234.00) 2022 Café", None, "", "Straße ½ ΑΣ"], text.tokenize)
    assert got == [["financial", "loss", "-12.50%", "1,234.00", "2022", "café"], None, [], ["strasse", "1", "2", "ασ"]]


def test_content_tokens(spark):
    (got,) = run(spark, ["What is revenue not -12.5% in FY22 and USD millions?"], text.tokenize_content)
    assert got == ["revenue", "not", "-12.5%", "fy", "22", "usd", "millions"]


DEFINED = {}


def defined(spark, c):
    return DEFINED.get(c) or DEFINED.setdefault(c, spark._jvm.java.lang.Character.isDefined(ord(c)))


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(codec="utf-8", max_codepoint=0x24FF, exclude_characters="\x00"), max_size=40), min_size=1, max_size=20))
def test_tokens_equal_plain_python(spark, values):
    # Characters newer than the JVM's Unicode tables may differ.
    assume(all(defined(spark, c) for v in values for c in v))
    assert run(spark, values, text.tokenize) == [plain_tokens(v) for v in values]
    assert run(spark, values, text.token_count) == [len(plain_tokens(v)) for v in values]


def test_search_text_and_blank(spark):
    assert run(spark, ["  Ａ  b\n−1 ", None], text.normalize_search_text) == ["A b -1", None]
    assert run(spark, [None, "", " \t\n ", "x"], text.is_blank) == [True, True, True, False]


def test_numbers(spark):
    df = spark.createDataFrame([("$1,000.00", "1005", 0.01), ("(125)", "-125", 0.0), ("1000", "1200", 0.01), ("none", "1", 1.0)], "a string, b string, t double")
    assert [r[0] for r in df.select(metrics.numeric_match(F.col("a"), F.col("b"), F.col("t"))).collect()] == [True, True, False, False]


def test_page_sets(spark):
    df = spark.createDataFrame([([2, 7], [7, 1, 2]), ([], [1]), ([], [])], "g array<int>, r array<int>")
    rows = df.select(metrics.recall_at_k(F.col("g"), F.col("r"), 1), metrics.reciprocal_rank(F.col("g"), F.col("r")), metrics.page_f1(F.col("g"), F.col("r"))).collect()
    assert [tuple(r) for r in rows] == [(0.5, 1.0, 0.8), (1.0, 0.0, 0.0), (1.0, 0.0, 1.0)]


def test_edit_similarity_and_risk(spark):
    df = spark.createDataFrame([("Net  Sales", "net sales"), ("", ""), ("abc", "abd")], "a string, b string")
    assert [round(r[0], 6) for r in df.select(metrics.edit_similarity(F.col("a"), F.col("b"))).collect()] == [1.0, 1.0, 0.666667]
    r = spark.range(1).select(metrics.page_risk(F.lit(2.0), F.lit(True), F.lit(-1.0), F.lit(0.5))).first()[0]
    assert abs(r - 0.7) < 1e-12
