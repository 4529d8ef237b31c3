from __future__ import annotations

import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quadlake.llm import heavy

SCHEMA = "o string, p string, field string, item string, h bigint, n bigint"


def data(n=20_000, seed=2):
    r = random.Random(seed)
    out = []
    for i in range(n):
        x = r.random()
        o = "hot" if x < 0.3 else f"h{r.randrange(20)}" if x < 0.6 else f"rare{i}"
        out.append((None if r.random() < 0.01 else o, r.choice(["p", "p", "q", ""]), "clash", "clash", 1, 1))
    return out


def test_estimates_never_fall_below_and_stay_in_bounds(spark):
    rows = data()
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = {(r.field, r.item): r for r in heavy.heavy_items(df, ["o", "p"], capacity=50, width=1 << 12, partitions=3).collect()}
    for k, field in enumerate(("o", "p")):
        count = Counter(x[k] for x in rows if x[k] is not None)
        for item, n in count.items():
            if n >= 0.01 * len(rows):
                r = got[field, item]
                assert n <= r.estimate <= n + r.max_error
        assert all(r.estimate >= count[i] for (f, i), r in got.items() if f == field)
        assert sum(f == field for f, _ in got) <= 3 * 50


def test_every_partition_gives_its_own_values(spark):
    got = heavy.heavy_items(spark.createDataFrame(data(), SCHEMA), ["o"], capacity=30, partitions=4).collect()
    assert len({r.item for r in got}) == len(got)


def test_merged_heap_is_the_top_of_all(spark):
    rows = data()
    found = heavy.heavy_items(spark.createDataFrame(rows, SCHEMA).repartition(5), ["o", "p"], capacity=60, partitions=3)
    got = heavy.top_items(found, 21).collect()
    count = Counter(x[0] for x in rows if x[0] is not None)
    assert {r.item for r in got if r.field == "o"} == {i for i, _ in count.most_common(21)}
    assert {r.item for r in got if r.field == "p"} == {"p", "q", ""}


def test_long_values_ties_and_empty_tables(spark):
    long = "x" * 200_000
    rows = [(long, "p", "", "", 0, 0)] * 3 + [("", "p", "", "", 0, 0)] * 2 + [(None, None, "", "", 0, 0)] * 9
    got = Counter({(r.field, r.item): r.estimate for r in heavy.heavy_items(spark.createDataFrame(rows, SCHEMA), ["o", "p"]).collect()})
    assert got == Counter({("o", long): 3, ("o", ""): 2, ("p", "p"): 5})
    assert heavy.heavy_items(spark.createDataFrame([], SCHEMA), ["o", "p"]).count() == 0
    ties = [(f"v{i}", "p", "", "", 0, 0) for i in range(10)]
    assert heavy.heavy_items(spark.createDataFrame(ties, SCHEMA), ["o"], capacity=3, partitions=1).count() == 3


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 9)), min_size=1, max_size=200), st.integers(1, 50))
def test_conservative_update_is_an_upper_bound(stream, block):
    sketch, truth = heavy.Sketch(width=16, depth=2), Counter()
    hashes = {k: np.uint64(random.Random(k).getrandbits(64)) for k in range(41)}
    for i in range(0, len(stream), block):
        part = Counter()
        for k, w in stream[i : i + block]:
            part[k] += w
        seen = sketch.add(np.array([hashes[k] for k in part], np.uint64), np.array(list(part.values()), np.int64))
        truth.update(part)
        assert all(e >= truth[k] for k, e in zip(part, seen))
    assert sketch.total == sum(truth.values())


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 1000)), max_size=300), st.integers(1, 10))
def test_heap_keeps_the_largest(offers, capacity):
    heap, best = heavy.Heap(capacity), {}
    for k, w in offers:
        best[k] = best.get(k, 0) + w  # estimates only grow
        heap.offer(str(k), best[k])
    assert len(heap.best) == min(capacity, len(best))
    floor = heap.floor()
    assert all(n <= floor or str(k) in heap.best for k, n in best.items()) or len(best) <= capacity
