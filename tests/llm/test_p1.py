import re
import unicodedata
from collections import Counter, defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pagewright.llm import p1_boilerplate as p1

SCHEMA = "doc_id string, page_index int, raw_text string"


def key(line):
    return re.sub("[0-9]+", "#", re.sub(r"\s+", "", unicodedata.normalize("NFKC", line).lower()))


def brute(rows):
    pages = {(d, p): t for d, p, t in rows if d is not None and p is not None and t and t.strip()}
    n, on, lines = Counter(d for d, _ in pages), defaultdict(set), []
    for (d, p), t in pages.items():
        for i, line in enumerate(t.split("\n")):
            if key(line):
                on[d, key(line)].add(p)
                lines.append((d, p, i, key(line)))
    return {(d, p, i) for d, p, i, k in lines if len(on[d, k]) >= 4 and 100 * len(on[d, k]) >= 15 * n[d]}


def found(spark, rows):
    return {(r.doc_id, r.page_index, r.line_no) for r in p1.find(spark.createDataFrame(rows, SCHEMA)).collect()}


LINES = ["Page 1", "page  22", "ＰＡＧＥ 3", "", " \t", "Legal notice", "legal notice\r", "own text", "1 2", "12", "​Legal notice"]


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(0, 30), st.lists(st.sampled_from(LINES), max_size=6)), max_size=60))
def test_equal_to_brute_force(spark, drawn):
    text = {}  # all rows of one page carry the same text
    rows = [(d, p, text.setdefault((d, p), "\n".join(t))) for d, p, t in drawn]
    rows += [("a", 0, None), (None, 1, "x")]
    assert found(spark, rows) == brute(rows)


def test_blocks_and_removal(spark):
    rows = [("d", p, f"Head line\nSecond {p}\nbody {'x' * (p + 1)}\nFoot") for p in range(6)] + [("d", 6, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    hits = p1.find(df)
    blocks = {(r.page_index, r.line_no): r.block_id for r in hits.collect()}
    assert blocks[0, 0] == blocks[0, 1] == blocks[5, 0] and blocks[0, 3] != blocks[0, 0]
    clean = {r.page_index: r.clean_text for r in p1.remove_lines(df, p1.removable(hits)).collect()}
    assert clean[2] == "body xxx" and clean[6] is None and len(clean) == 7


def test_empty_and_clashing_columns(spark):
    assert p1.find(spark.createDataFrame([], SCHEMA)).count() == 0
    wide = spark.createDataFrame([("d", p, "a\nb", 1, 2) for p in range(5)], SCHEMA + ", line_keys int, salt int")
    assert p1.find(wide).count() == 10


def test_hot_report_is_spread(spark):
    rows = [("hot", p, f"Notice\nbody {p} {'y' * (p % 50)}z") for p in range(400)]
    keys = p1.page_keys(spark.createDataFrame(rows, SCHEMA))
    assert found(spark, rows) == brute(rows)
    plan = p1.find(spark.createDataFrame(rows, SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "salt" in plan


def test_edges_decide_what_is_removed(spark):
    """A caption on a fifth of the pages, among changing lines: repeated, but no boilerplate."""
    rows = [("d", p, f"Head\nown {'a' * p}x\n{'(in millions)' if p % 5 == 0 else 'z' * (p + 1)}\nalso {'b' * p}y\nFoot") for p in range(40)]
    hits = p1.find(spark.createDataFrame(rows, SCHEMA))
    captions = [r for r in hits.collect() if r.line_no == 2]
    assert len(captions) == 8 and all(r.block_id is None for r in captions)
    kept = {r.page_index: r.clean_text.split("\n") for r in p1.remove_lines(spark.createDataFrame(rows, SCHEMA), p1.removable(hits)).collect()}
    assert all(t[1] == "(in millions)" for p, t in kept.items() if p % 5 == 0) and all(len(t) == 3 for t in kept.values())
    # Without its edges the same caption would go too.
    assert p1.removable(hits.withColumn("block_id", p1.F.lit(1))).count() == hits.count() > p1.removable(hits).count()


def test_reports_are_flushed_one_by_one():
    import pandas as pd

    frames = [pd.DataFrame({"doc_id": ["a", "a"], "a": [1, 2], "b": [1, 2]}), pd.DataFrame({"doc_id": ["a", "b", "b"], "a": [1, 1, 1], "b": [2, 1, p1.PAGE_END]})]
    out = pd.concat(p1._components(iter(frames)))
    assert out[["doc_id", "line_key", "block_id", "block_lines"]].values.tolist() == [["a", 1, 1, 2], ["a", 2, 1, 2], ["b", 1, 1, 1]]
