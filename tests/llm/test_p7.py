import pytest

from pagewright.llm import p7_mix as p7

DOCS = "doc_id long, source string, n_tokens int, text string"
TARGETS = "source string, target_share double, max_repeats int"


def mixed(spark, docs, targets, **k):
    rows, shares = p7.mix(spark.createDataFrame(docs, DOCS), spark.createDataFrame(targets, TARGETS), **k)
    return rows.collect(), {r.source: r for r in shares.collect()}


def test_tree_is_exact():
    counts = [7, 0, 12, 100]
    walks = [p7.leaf(i, counts, 5, 3) for i in range(5)]
    rows = [sum(n for _, n in w) for w in walks]
    assert max(rows) - min(rows) <= 2
    for k, c in enumerate(counts):  # each source's positions are cut without gap or overlap
        assert sorted(x for w in walks for x in range(w[k][0], sum(w[k]))) == list(range(c))


def test_driver_sees_sources_only(spark, monkeypatch):
    """10,000 blocks of two sources: what is collected has a row for each source."""
    from pyspark.sql.classic.dataframe import DataFrame

    seen, collect = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda df: seen.append(collect(df)) or seen[-1])
    docs = spark.range(10_000).selectExpr("id as doc_id", "if(id % 3 = 0, 'a', 'b') as source", "1 as n_tokens", "'' as text")
    rows, shares = p7.mix(docs, spark.createDataFrame([("a", 0.3, 1), ("b", 0.7, 2)], TARGETS), rows_per_block=1, shards=7)
    assert max(map(len, seen)) == 2
    assert rows.select("doc_id", "copy").distinct().count() == rows.count() and rows.select("shard").distinct().count() == 7
    assert {r.source: abs(r.share_of_total - r.target_share) < 0.001 for r in shares.collect()} == {"a": True, "b": True}


def test_largest_total_meets_all_targets(spark):
    docs = [(i, "a", 10, "") for i in range(50)] + [(100 + i, "b", 10, "") for i in range(500)]
    _, shares = mixed(spark, docs, [("a", 0.2, 1), ("b", 0.8, 1)])
    assert not shares["a"].reachable and shares["a"].largest_total == 2500
    _, shares = mixed(spark, docs, [("a", 0.2, 1), ("b", 0.8, 1)], total=2500)
    assert all(s.reachable and abs(s.actual_share - s.target_share) < 0.01 for s in shares.values())


def test_shares_repeats_and_shards(spark):
    docs = [(i, "big", 10, "") for i in range(600)] + [(1000 + i, "small", 10, "") for i in range(40)] + [(2000 + i, None, 10, "") for i in range(30)] + [(3000, "no target", None, "three small words")]
    targets = [("big", 0.5, 1), ("small", 0.25, 2), ("none", 0.25, 3), ("big", 0.5, 1)]
    rows, shares = mixed(spark, docs, targets, shards=4)
    total = 6703
    assert shares["small"].reached == 800 and shares["small"].exhausted and not shares["small"].reachable
    assert abs(shares["big"].reached - 0.5 * total) <= 10 and shares["big"].reachable and not shares["big"].exhausted
    assert shares["none"].size == 0 and not shares["none"].reachable
    uses = {}
    for r in rows:
        uses[r.doc_id] = uses.get(r.doc_id, 0) + 1
        assert r.source in ("big", "small")
    assert max(uses[i] for i in uses if i < 1000) == 1 and all(uses[1000 + i] == 2 for i in range(40))
    assert len({(r.doc_id, r.copy) for r in rows}) == len(rows) and {r.shard for r in rows} <= set(range(4))
    for shard in range(4):
        assert sorted(r.position for r in rows if r.shard == shard) == list(range(1, 1 + sum(r.shard == shard for r in rows)))


def test_deterministic_and_total(spark):
    docs = [(i, "ab"[i % 2], 5, "") for i in range(100)]
    targets = [("a", 0.75, 1), ("b", 0.25, 1)]
    one, shares = mixed(spark, docs, targets, total=200)
    two, _ = mixed(spark, docs, targets, total=200)
    assert sorted(one) == sorted(two) and abs(shares["a"].reached - 150) <= 5 and abs(shares["a"].actual_share - 0.75) < 0.03


def test_zero_share_and_nulls(spark):
    _, shares = mixed(spark, [(1, "a", 5, ""), (2, "b", 0, ""), (3, "c", 5, None)], [("a", 0.0, 0), ("gone", 0.0, 2), ("c", None, None), (None, 0.5, 1)])
    assert {s: (r.reachable, r.reached) for s, r in shares.items()} == {"a": (True, 0), "gone": (True, 0), "c": (True, 0)}


@pytest.mark.parametrize("docs", [[], [(1, None, 4, "x")]])
def test_empty(spark, docs):
    rows, shares = mixed(spark, docs, [("a", 1.0, 1)])
    assert rows == [] and shares["a"].reached == 0 and shares["a"].reachable == (docs == [])
