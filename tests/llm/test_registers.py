from __future__ import annotations

import random
from datetime import date

import numpy as np
import pytest

from quadlake.llm import registers as R

SCHEMA = "day date, c string, s string, reg int, level string"


def sample(n=6000, seed=4):
    r = random.Random(seed)
    return [(None if r.random() < 0.02 else date(2024, 1, 1 + r.randrange(4)), None if r.random() < 0.3 else f"g{r.randrange(3)}", None if r.random() < 0.02 else f"s{r.randrange(3000)}", 1, "clash") for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def exact(rows, keep):
    groups = {}
    for day, c, s, *_ in rows:
        if s is not None:
            groups.setdefault((day if "day" in keep else None, c if "c" in keep else None), set()).add(s)
    return {k: len(v) for k, v in groups.items()}


def test_cube_against_exact_counts(spark):
    rows = sample()
    got = R.cube(frame(spark, rows), ["day", "c"], "s").collect()
    by = {}
    for r in got:
        by.setdefault(r.level_of, {})[r.day, r.c] = r
    assert set(by) == {"day+c", "day", "c", ""}
    inside = total = 0
    for level, groups in by.items():
        want = exact(rows, level.split("+"))
        assert set(groups) == set(want)
        for k, n in want.items():
            assert abs(groups[k].estimate / n - 1) < 6 * groups[k].rel_error
            inside, total = inside + (groups[k].low <= n <= groups[k].high), total + 1
    assert inside >= 0.8 * total


def test_partial_results_merge_in_any_order(spark):
    rows = sample()
    random.Random(1).shuffle(rows)
    parts = [R.sketch(frame(spark, rows[i::3]), ["c"], "s") for i in range(3)]
    twice = parts[2].unionByName(parts[0]).unionByName(parts[1]).unionByName(parts[0])
    whole = R.sketch(frame(spark, rows), ["c"], "s")
    assert sorted(map(str, R.merge(twice, ["c"]).collect())) == sorted(map(str, whole.collect()))


def test_registers_are_bounded(spark):
    df = spark.range(100_000).selectExpr("cast(id as string) as s", "1 as g")
    regs = R.sketch(df, ["g"], "s", m=256, base=1.3)
    assert regs.count() == 256
    r = R.count_groups(regs, ["g"], 256, 1.3).first()
    assert abs(r.estimate / 100_000 - 1) < 4 * r.rel_error and r.rel_error == pytest.approx(R.standard_error(256, 1.3))


@pytest.mark.parametrize("m,base", [(2048, 1.1), (512, 2.0), (1024, 1.02)])
def test_error_is_as_stated(m, base):
    rng = np.random.default_rng(5)
    for n in (1, 20, 1000, 50_000):
        found = []
        for _ in range(40):
            regs = np.zeros(m, int)
            np.maximum.at(regs, rng.integers(0, m, n), np.floor(1 - np.log(1 - rng.random(n)) / np.log(base)).astype(int))
            used = regs > 0
            found.append(R.estimates(np.array([used.sum()]), np.array([(base ** -regs[used].astype(float)).sum()]), m, base)[0])
        assert abs(np.mean(found) / n - 1) < 4 * R.standard_error(m, base) / np.sqrt(40) + 0.003
        assert np.std(found) / n < 1.5 * R.standard_error(m, base)


@pytest.mark.parametrize("a,b,both", [(2000, 500, 800), (40, 40, 0), (0, 0, 500), (0, 900, 100), (30_000, 10_000, 5_000)])
def test_joint_estimates(a, b, both):
    rng = np.random.default_rng(a + b)
    m, base = R.M, R.BASE

    def draw(n):
        return rng.integers(0, m, n), np.floor(1 - np.log(1 - rng.random(n)) / np.log(base)).astype(int)

    errors = []
    for _ in range(8):
        x, y, z = draw(a), draw(b), draw(both)
        sets = []
        for own in (x, y):
            regs = np.zeros(m, int)
            for part in (own, z):
                np.maximum.at(regs, *part)
            sets.append(regs)
        got = R.joint_estimate(*sets)
        for name, true in (("union", a + b + both), ("intersection", both), ("jaccard", both / (a + b + both))):
            assert abs(got[name] - true) <= 4.5 * got[name + "_error"] + 0.02 * true + (0.6 if name != "jaccard" else 0.003) + (12 if name == "intersection" and both == 0 else 0), (name, got)
        errors.append(got["union"] / (a + b + both) - 1)
    assert abs(np.mean(errors)) < 0.03


def test_joint_of_empty_sets():
    assert R.joint_estimate(np.zeros(8, int), np.zeros(8, int), 8)["jaccard"] == 1.0


def test_neighbouring_days(spark):
    rows = sample()
    got = {r.day: r for r in R.neighbours(R.sketch(frame(spark, rows), ["day"], "s"), "day").collect()}
    sets = {}
    for day, _, s, *_ in rows:
        if day and s:
            sets.setdefault(day, set()).add(s)
    days = sorted(sets)
    assert sorted(got) == days[1:]
    for a, b in zip(days, days[1:]):
        r = got[b]
        assert r.previous == a
        assert abs(r.jaccard - len(sets[a] & sets[b]) / len(sets[a] | sets[b])) < 4 * r.jaccard_error
        assert abs(r.union - len(sets[a] | sets[b])) < 4 * r.union_error


def test_pairs_asked_for(spark):
    rows = sample()
    sets = {}
    for _, c, s, *_ in rows:
        if c and s:
            sets.setdefault(c, set()).add(s)
    asked = [("g0", "g1"), ("g1", "g0"), ("g2", "g2"), ("g0", "nothing"), ("no", "thing"), (None, "g0"), ("g0", "g1")]
    regs = R.sketch(frame(spark, rows), ["c"], "s")
    got = {(r["first"], r["second"]): r for r in R.joint_pairs(regs, "c", spark.createDataFrame(asked, "first string, second string")).collect()}
    assert set(got) == set(asked[:4])
    for (a, b), r in got.items():
        x, y = sets.get(a, set()), sets.get(b, set())
        assert abs(r.union - len(x | y)) < 4 * r.union_error
        assert abs(r.intersection - len(x & y)) <= 4 * r.intersection_error + 1


def test_empty_and_null_items(spark):
    assert R.cube(frame(spark, []), ["day", "c"], "s").count() == 0
    assert R.neighbours(R.sketch(frame(spark, []), ["day"], "s"), "day").count() == 0
    rows = [(date(2024, 1, 1), None, None, 0, "")] * 3 + [(date(2024, 1, 1), None, "x" * 100_000, 0, "")] * 3
    got = R.cube(frame(spark, rows), ["day", "c"], "s").collect()
    assert len(got) == 4 and all(abs(r.estimate - 1) < 0.01 for r in got)


def test_joint_estimates_need_no_products(spark):
    rows = sample()
    regs = R.sketch(frame(spark, rows), ["c"], "s")
    one = {r.c: r for r in R.joint_with(regs, "c", "g0").collect()}
    pairs = spark.createDataFrame([(k, "g0") for k in one], "first string, second string")
    two = {r["first"]: r for r in R.joint_pairs(regs, "c", pairs).collect()}
    assert one and set(one) == set(two) == {c for _, c, s, *_ in rows if c and s} - {"g0"}
    for k, r in one.items():
        assert all(r[x] == two[k][x] for x in R._JOINT)
    for df in (R.joint_with(regs, "c", "g0"), R.joint_pairs(regs, "c", pairs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert {r.intersection for r in R.joint_with(regs, "c", "no set").collect()} == {0.0}
