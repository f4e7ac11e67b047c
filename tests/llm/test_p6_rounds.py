import numpy as np

from pagewright.llm import p6_pack as p6


def test_exchange_goes_on_while_it_saves(spark):
    """Here the third round still saves containers."""
    rows = [(i, int(n), "") for i, n in enumerate(np.random.default_rng(3).integers(100, 400, 3000))]
    d = spark.createDataFrame(rows, "doc_id long, n_tokens int, text string")
    s = spark.createDataFrame([("s", 1024)], "spec_name string, capacity_tokens int")
    two, whole = (p6.pack(d, s, per_part=20, **k) for k in ({"rounds": 2}, {}))
    assert p6.containers(whole).count() < p6.containers(two).count()
    assert sorted(r.doc_id for r in whole.collect()) == list(range(3000))
