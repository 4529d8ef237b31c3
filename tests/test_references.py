from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quadlake.operators import references, skew

START = datetime(2024, 1, 1)
TRIPLES = "stmt_id bigint, subj bigint, pred bigint, obj bigint, loaded_at timestamp_ntz, ref bigint, ts string, reason string"
TERMS = "id bigint, created_at timestamp_ntz, deleted_at timestamp_ntz, ref int"


def judge(i, t, lives):
    own = [(a or datetime.min, b or datetime.max) for k, a, b in lives if k == i]
    if not own:
        return "missing"
    if t is None or any(a <= t < b for a, b in own):
        return None
    return "deleted" if any(a <= t for a, _ in own) else "late"


def case(seed, n=1500):
    r = random.Random(seed)

    def at():
        return START + timedelta(hours=r.randrange(40))

    lives = []
    for i in range(2, 60):
        for _ in range(r.choice([0, 1, 1, 2, 3])):
            a = at()
            lives.append((i, None if r.random() < 0.05 else a, None if r.random() < 0.4 else a + timedelta(hours=r.randrange(20))))
    lives += lives[:9] + [(None, START, None)]

    def ref():
        return r.choice([None, 0, 1, 7, 7, 7, 7, r.randrange(2, 80), r.randrange(2, 80), r.randrange(2, 80)])

    rows = [(k, ref(), 5, ref(), None if r.random() < 0.03 else at(), 1, "x", "y") for k in range(n)]
    return rows + rows[:100], lives


def test_against_brute_force_with_a_hot_id(spark):
    for seed, limit in ((0, None), (1, 30), (2, 1)):
        rows, lives = case(seed)
        fixed = [70, 71]
        want = set()
        for k, s, _, o, t, *_ in rows:
            for f, i in (("subj", s), ("obj", o)):
                if i is not None and i not in (0, 1) and i not in fixed and (why := judge(i, t, lives)):
                    want.add((k, f, why))
        found = references.orphans(
            spark.createDataFrame(rows, TRIPLES), "stmt_id", ["subj", "obj"], "loaded_at",
            spark.createDataFrame([(*x, 0) for x in lives], TERMS), spark.createDataFrame([(i,) for i in fixed], "id bigint"), limit=limit,
        )
        got = [(r.row_id, r.field, r.reason) for r in found.collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_bounds_of_a_lifetime(spark):
    hour = timedelta(hours=1)
    lives = [(5, START, START + hour, 0), (5, START + 3 * hour, None, 0)]
    rows = [(n, 5, 0, None, START + n * hour / 2, 0, "", "") for n in range(-1, 8)]
    got = references.orphans(spark.createDataFrame(rows, TRIPLES), "stmt_id", ["subj", "obj"], "loaded_at", spark.createDataFrame(lives, TERMS)).collect()
    assert {r.row_id: r.reason for r in got} == {-1: "late", 2: "deleted", 3: "deleted", 4: "deleted", 5: "deleted"}


def test_empty_sides_and_counts(spark):
    rows, lives = case(9, 200)
    no_terms, no_rows = spark.createDataFrame([], TERMS), spark.createDataFrame([], TRIPLES)
    full = spark.createDataFrame(rows, TRIPLES)
    found = references.orphans(full, "stmt_id", ["subj", "obj"], "loaded_at", no_terms)
    assert {r.reason for r in found.collect()} == {"missing"}
    counts = references.orphan_counts(found)
    assert counts.groupBy().sum("n_refs").first()[0] == found.count()
    assert references.orphans(no_rows, "stmt_id", ["subj"], "loaded_at", spark.createDataFrame([(*x, 0) for x in lives], TERMS)).count() == 0


def test_no_task_gets_much_of_one_key(spark):
    """Salts follow from the rows of a key and of a task, not from the table."""
    df = spark.range(40_000).select(F.when(F.col("id") % 3 == 0, -1).when(F.col("id") % 20 == 1, -2).otherwise(F.col("id")).alias("k"), "id")
    limit = skew.task_rows(df, df.count())
    assert limit == 5000  # four tasks of 10,000 rows
    hot = skew.hot_keys(df, "k", df.count())
    assert {r.k: r.salts for r in hot.collect()} == {-1: 3}
    fine = skew.hot_keys(df, "k", df.count(), 100)
    assert {r.k: r.salts for r in fine.collect()} == {-1: 134, -2: 14}
    parts = skew.spread(df, fine, "k", F.col("id")).groupBy("k", "_salt").count()
    assert parts.agg({"count": "max"}).first()[0] < 200 and parts.agg({"count": "sum"}).first()[0] == 40_000
    assert skew.replicate(spark.createDataFrame([(-1, "a"), (5, "b"), (None, "c")], "k bigint, x string"), fine, "k").groupBy("x").count().orderBy("x").collect() == [("a", 134), ("b", 1), ("c", 1)]
