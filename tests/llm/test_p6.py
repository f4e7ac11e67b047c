import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pagewright.llm import p6_pack as p6


def optimum(sizes, capacity):
    """Fewest containers, by trying."""
    sizes = sorted((s for s in sizes if s), reverse=True)

    def fits(k):
        rooms = [capacity] * k

        def put(i):
            if i == len(sizes):
                return True
            for j in {r: j for j, r in enumerate(rooms)}.values():
                if rooms[j] >= sizes[i]:
                    rooms[j] -= sizes[i]
                    if put(i + 1):
                        return True
                    rooms[j] += sizes[i]
            return False

        return put(0)

    k = 0
    while not fits(k):
        k += 1
    return max(k, 1)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 12), min_size=1, max_size=8), st.integers(12, 20))
def test_bound_and_packing(sizes, capacity):
    need = np.array(sizes, dtype=np.int64)
    bins = p6.best_fit_decreasing(need, capacity)
    assert max(np.bincount(bins, weights=need)) <= capacity
    assert p6.lower_bound(need, capacity) <= optimum(sizes, capacity) <= bins.max() + 1


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, n_tokens int, text string")


def specs(spark, values):
    return spark.createDataFrame([("s", v) for v in values], "spec_name string, capacity_tokens int")


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(0, 70)), max_size=60))
def test_every_token_is_packed_once(spark, sizes):
    rows = [(i, n, "a b c" if n is None else "wrong") for i, n in enumerate(sizes)]
    packed = p6.pack(docs(spark, rows), specs(spark, [10, 10, 25, 0, None]), per_part=9).collect()
    for c in (10, 25):
        mine = [r for r in packed if r.capacity_tokens == c]
        fill, spans = {}, {}
        for r in mine:
            fill[r.part, r.bin] = fill.get((r.part, r.bin), 0) + r.token_end - r.token_start
            spans.setdefault(r.doc_id, []).append((r.token_start, r.token_end))
        assert max(fill.values(), default=0) <= c
        for i, n in enumerate(sizes):
            n, s = 3 if n is None else n, sorted(spans[i])
            assert s[0][0] == 0 and s[-1][1] == n and all(a[1] == b[0] for a, b in zip(s, s[1:])) and len(s) == max(1, -(-n // c))
    assert {r.capacity_tokens for r in packed} <= {10, 25}


def test_found_and_certificate(spark):
    d = docs(spark, [(1, 30, ""), (2, 10, ""), (3, None, "one two three"), (4, 9, ""), (5, 1, ""), (6, None, None)])
    packed = p6.pack(d, specs(spark, [10]))
    assert [tuple(r) for r in p6.oversize(packed).collect()] == [(10, 1)]
    c = p6.certificates(packed).first()
    assert (c.containers, c.lower_bound, c.tokens) == (6, 6, 53)


def test_exchange_never_adds_containers(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(n), "") for i, n in enumerate(rng.integers(300, 700, 400))]
    apart = p6.containers(p6.pack(docs(spark, rows), specs(spark, [1024]), per_part=10, rounds=0)).count()
    mixed = p6.pack(docs(spark, rows), specs(spark, [1024]), per_part=10, rounds=2)
    assert p6.containers(mixed).count() <= apart and mixed.count() == 400


def test_empty(spark):
    assert p6.pack(docs(spark, []), specs(spark, [5])).count() == 0
    assert p6.pack(docs(spark, [(1, 5, "")]), specs(spark, [])).count() == 0
