from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pagewright.llm import p3_split as p3

DOCS = "doc_id string, page_count int, registered_at int"
HEADS = "doc_id string, page_index int, kind string, source_page_index int, included boolean"
LIMITS = [("m", 8, 1), ("n", 5, 4), ("odd", 3, 9), ("zero", 0, 0), ("none", None, None)]


def split(spark, windows, docs, heads):
    return p3.split(
        spark.createDataFrame(windows, "window_id long, doc_id string, model_id string, strategy string, start_page int, end_page int"),
        spark.createDataFrame(docs, DOCS),
        spark.createDataFrame(heads, HEADS),
        spark.createDataFrame(LIMITS, "model_id string, max_pages int, overlap_pages int"),
    )


def check(rows, first, last, most, overlap, starts):
    """Pieces cover the window in order, share exactly the overlap, keep the limit, and end at the best place in reach."""
    assert rows[0][0] == first and rows[-1][1] == last
    overlap, at = min(overlap, most - 1), first
    for i, (a, b) in enumerate(rows):
        assert 0 < b - a <= most
        if i:
            assert a == rows[i - 1][1] - overlap
        reach = at + (most if i == 0 else most - overlap)
        low = at + (min(overlap + 1, most) if i == 0 else 1)
        if reach >= last:
            assert b == last
        else:
            best = next((max(p for p in range(low, reach + 1) if starts.get(p) in kinds) for kinds in (("item", "statement"), ("item", "statement", "note", "risk_group"), ("item", "statement", "note", "risk_group", "x")) if any(starts.get(p) in kinds for p in range(low, reach + 1))), reach)
            assert b == best
        at = b


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(1, 60), st.dictionaries(st.integers(0, 60), st.sampled_from(["item", "note", "x"]), max_size=12), st.lists(st.tuples(st.integers(-3, 60), st.one_of(st.none(), st.integers(-3, 70)), st.sampled_from(["m", "n", "odd"])), min_size=1, max_size=12))
def test_pieces(spark, count, starts, drawn):
    windows = [(i, "d", m, "s", a, b) for i, (a, b, m) in enumerate(drawn)]
    heads = [("d", p, k, p, True) for p, k in starts.items()] + [("d", 2, "item", None, False)]
    got = {}
    for r in split(spark, windows, [("d", 1, 1), ("d", count, 2)], heads).orderBy("window_id", "piece_no").collect():
        got.setdefault(r.window_id, []).append((r.piece_start, r.piece_end))
    for i, _, m, _, a, b in windows:
        first, last = max(a, 0), min(count if b is None else b, count)
        if first < last:
            most, overlap = {k: (x, y) for k, x, y in LIMITS}[m]
            check(got.pop(i), first, last, most, overlap, starts)
    assert not got


def test_edges(spark):
    windows = [(1, "d", "m", "s", 0, None), (1, "d", "m", "s", 0, None), (2, "d", "unknown", "s", 0, 40), (3, "d", "zero", "s", 0, 40), (4, "d", "m", "s", None, 9), (5, "d", "m", "s", 9, 3), (6, "gone", "m", "s", 0, 9), (7, None, "m", "s", 0, 9), (8, "void", "m", "s", 0, 9)]
    docs = [("d", 20, 5), ("d", 3, None), ("void", None, 9), ("void", 7, 1)]
    pieces = {}
    for r in split(spark, windows, docs, []).collect():
        pieces[r.window_id] = pieces.get(r.window_id, 0) + 1
    assert pieces == {1: 3, 2: 1, 3: 1}
    assert split(spark, [], [], []).count() == 0
