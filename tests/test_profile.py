from __future__ import annotations

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

from quadlake.operators import profile, skew

SCHEMA = "s string, p string, o string, c string, loaded_at timestamp_ntz, field string, n bigint"
FIELDS = {"p": None, "c": "DEFAULT"}


def rows(n=3000, seed=1):
    r = random.Random(seed)
    day = datetime(2024, 1, 1)
    out = []
    for _ in range(n):
        hot = r.random() < 0.4
        out.append((None if r.random() < 0.05 else f"s{0 if r.random() < 0.3 else r.randrange(500)}", "hot" if hot else f"p{r.randrange(30)}", "o", None if r.random() < 0.4 else f"g{r.randrange(9)}", None if r.random() < 0.1 else day + timedelta(seconds=r.randrange(10**6)), "clash", 1))
    return out + out[:200]


def test_profile_against_brute_force(spark):
    data = rows()
    want = defaultdict(lambda: [0, set(), [], Counter()])
    for s, p, _, c, t, *_ in data:
        for key in (("p", p), ("c", c or "DEFAULT")):
            w = want[key]
            w[0] += 1
            if s is not None:
                w[1].add(s)
                w[3][s] += 1
            if t is not None:
                w[2].append(t)
    got = profile.key_profile(spark.createDataFrame(data, SCHEMA), FIELDS, "s", "loaded_at", mode=True).collect()
    assert len(got) == len(want)
    for r in got:
        n, distinct, times, count = want[r.field, r.key]
        assert (r.n_rows, r.n_distinct, r.first_time, r.last_time) == (n, len(distinct), min(times), max(times))
        best = min(count.items(), key=lambda x: (-x[1], x[0]))
        assert (r.mode_value, r.mode_rows) == best


def test_null_keys_and_empty_tables(spark):
    data = [("a", None, "o", None, None, "", 0)] * 2
    got = {(r.field, r.key): r for r in profile.key_profile(spark.createDataFrame(data, SCHEMA), FIELDS, "s", "loaded_at").collect()}
    assert got["p", None].n_rows == got["c", "DEFAULT"].n_rows == 2
    assert got["p", None].first_time is None
    empty = spark.createDataFrame([], SCHEMA)
    assert profile.key_profile(empty, FIELDS, "s", "loaded_at").count() == 0


def test_hot_share_counts_all_rows(spark):
    data = rows()
    got = profile.hot_share(profile.key_profile(spark.createDataFrame(data, SCHEMA), FIELDS, "s", "loaded_at"), len(data), 0.05).collect()
    count = Counter(("p", x[1]) for x in data) + Counter(("c", x[3] or "DEFAULT") for x in data)
    assert {tuple(r) for r in got} == {k for k, n in count.items() if n >= 0.05 * len(data)}


def test_percentiles(spark):
    r = random.Random(3)
    data = [("hot" if r.random() < 0.5 else f"k{r.randrange(5)}" if r.random() < 0.9 else None, None if r.random() < 0.05 else r.randrange(100)) for _ in range(4000)]
    df = spark.createDataFrame(data, "k string, v int")
    for q in (0.01, 0.5, 0.99, 1.0):
        got = {x.k: x.percentile for x in profile.weighted_percentile(df, "k", "v", q).collect()}
        by = defaultdict(list)
        for k, v in data:
            if v is not None:
                by[k].append(v)
        for k, vs in by.items():
            vs.sort()
            assert got[k] == vs[max(0, -(-int(round(len(vs) * q * 1e9)) // 10**9) - 1)], (k, q)


def test_several_percentiles_in_one_pass(spark):
    df = spark.createDataFrame([("a", i) for i in range(1, 101)] + [(None, 7), ("b", None)], "k string, v int")
    got = {r.k: (r.low, r.mid, r.high) for r in profile.weighted_percentile(df, "k", "v", {"low": 0.01, "mid": 0.5, "high": 1.0}).collect()}
    assert got == {"a": (1, 50, 100), None: (7, 7, 7)}


def test_salts_keep_every_pair(spark):
    left = spark.createDataFrame([(1, i) for i in range(400)] + [(k, k) for k in range(2, 40)] + [(None, 0)], "k int, v int")
    right = spark.createDataFrame([(k, f"x{k}") for k in range(50)] + [(None, "none")], "k int, x string")
    hot = skew.hot_keys(left, "k", left.count(), 50)
    assert [tuple(r) for r in hot.collect()] == [(1, 8)]
    a, b = skew.spread(left, hot, "k", left["v"]), skew.replicate(right, hot, "k")
    assert a.select("_salt").distinct().count() == 8
    assert a.join(b, ["k", "_salt"]).count() == 438
    assert a.count() == 439 and b.count() == 51 + 7


def test_p1_percentiles_keep_the_null_predicate(spark, tmp_path):
    import __spark_entry__ as entries

    data = [("s", None, "o" * n, None, None, "", 0) for n in range(1, 101)] + [("s", "p", "oo", None, None, "", 0), ("s", "q", None, None, None, "", 0)]
    spark.createDataFrame(data, SCHEMA).write.parquet(f"{tmp_path}/quads.parquet")
    got = {tuple(r) for r in entries.queries()["p1_percentiles"](spark, str(tmp_path)).select("p", "median", "p99").collect()}
    assert got == {(None, 50, 99), ("p", 2, 2)}
