"""Dictionary-encoded quads, typed accessors and spread tables."""

from __future__ import annotations

import datetime
import random
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quadlake.functions import accessors
from quadlake.functions.terms import XSD
from quadlake.sources.dictionary import DictionaryQuads
from quadlake.sources.tables import table

START = datetime.datetime(2024, 1, 1)
STATEMENTS = "subj bigint, pred bigint, obj bigint, context bigint, loaded_at timestamp_ntz, id int, term string"
VALUES = "id bigint, term string, created_at timestamp_ntz, deleted_at timestamp_ntz, at string"


def hours(n):
    return START + datetime.timedelta(hours=n)


def case():
    r = random.Random(8)
    vocabulary = [(10 + i, f"<v{i}>") for i in range(5)] + [(None, "<x>")]
    values = []
    for i in range(100, 130):
        for _ in range(r.choice([0, 1, 1, 2])):
            a = r.randrange(20)
            values.append((i, f"<t{i}-{r.randrange(2)}>", hours(a), r.choice([None, hours(a + r.randrange(1, 9))])))
    values += values[:4] + [(1, "<never>", hours(0), None), (0, "<never>", hours(0), None)]
    pick = lambda: r.choice([None, 0, 1, 10, 11, *range(100, 132)])
    statements = [(pick(), r.choice([10, 11, 12, None]), pick(), r.choice([None, 0, 1, 13, 14, 101]), hours(r.randrange(24))) for _ in range(800)]
    return statements + statements[:50], values, vocabulary


def decode(statements, values, vocabulary):
    def terms_of(i, t):
        if i is None or i < 2:
            return set()
        fixed = {x for k, x in vocabulary if k == i}
        return fixed or {x for k, x, a, b in values if k == i and a <= t and (b is None or t < b)}

    out = set()
    for s, p, o, c, t in statements:
        graphs = {None} if c in (None, 0, 1) else terms_of(c, t)
        out |= {(a, b, d, g) for a in terms_of(s, t) for b in terms_of(p, t) for d in terms_of(o, t) for g in graphs}
    return out


def test_decoding_and_look_ups(spark):
    statements, values, vocabulary = case()
    src = DictionaryQuads(
        spark.createDataFrame([(*x, 7, "clash") for x in statements], STATEMENTS), spark.createDataFrame([(*x, "clash") for x in values], VALUES), spark.createDataFrame(vocabulary, "id bigint, term string")
    )
    want = decode(statements, values, vocabulary)
    assert Counter(tuple(r) for r in src.scan().collect()) == Counter(want)
    some = next(x for x in sorted(want, key=str) if x[0].startswith("<t") and x[3])
    for s, p, o, contexts in [(some[0], None, None, ()), (None, some[1], None, (some[3],)), (None, None, some[2], (None, some[3])), (*some[:3], ()), ("<nobody>", None, None, ()), (None, None, None, (None,))]:
        got = {tuple(r) for r in src.scan(s, p, o, contexts).collect()}
        assert got == {x for x in want if s in (None, x[0]) and p in (None, x[1]) and o in (None, x[2]) and (not contexts or x[3] in contexts)}
    assert src.ids_of("<v3>") == [13] and src.ids_of("<nobody>") == [] and src.term_of(13).first().term == "<v3>"
    empty = DictionaryQuads(spark.createDataFrame([], STATEMENTS), spark.createDataFrame([], VALUES), spark.createDataFrame([], "id bigint, term string"))
    assert empty.scan().count() == 0


def test_added_statements_get_ids(spark):
    statements, values, vocabulary = case()
    src = DictionaryQuads(
        spark.createDataFrame([(*x, 7, "clash") for x in statements], STATEMENTS), spark.createDataFrame([(*x, "clash") for x in values], VALUES), spark.createDataFrame(vocabulary, "id bigint, term string")
    )
    had = decode(statements, values, vocabulary)
    again = sorted(had, key=str)[:20]
    new = [("<n1>", "<v1>", '"x"', None), ("<n1>", "<v1>", '"x"', None), ("_:b", "<n2>", "<n1>", "<v2>"), ("<n1>", "<n2>", '"' + "long" * 100_000 + '"@en', "_:b")] + [("<hot>", "<v0>", f'"{i}"', "<v3>") for i in range(300)]
    quads = spark.createDataFrame([(*q, i) for i, q in enumerate(again + new)], "s string, p string, o string, c string, subj int").repartition(5)
    out = src.added(quads, hours(1000))
    want = Counter(had | set(new) | set(again))
    assert Counter(tuple(r) for r in out.scan().collect()) == want
    assert Counter(tuple(r) for r in out.added(quads, hours(1001)).scan().collect()) == want  # no new ids for known terms
    assert {tuple(r) for r in out.scan(s="<hot>").collect()} == {q for q in new if q[0] == "<hot>"}
    ids = [r.id for r in out.values.where("born = timestamp_ntz'2024-02-11 16:00:00'").collect()]
    assert len(ids) == len(set(ids)) and min(ids) > 129 and not set(ids) & {v[0] for v in values}
    assert out.ids_of("<v1>") == [11] and len(out.ids_of("<n1>")) == 1
    with pytest.raises(ValueError):
        src.added(spark.createDataFrame([('"literal"', "<p>", "<o>", None)], "s string, p string, o string, c string"), hours(0))
    empty = DictionaryQuads(spark.createDataFrame([], STATEMENTS), spark.createDataFrame([], VALUES), spark.createDataFrame([], "id bigint, term string"))
    assert {tuple(r) for r in empty.added(quads, hours(0)).scan().collect()} == set(new) | set(again)


def test_no_join_by_a_null_key_and_no_product(spark):
    statements, values, vocabulary = case()
    src = DictionaryQuads(
        spark.createDataFrame([(*x, 7, "") for x in statements], STATEMENTS), spark.createDataFrame([(*x, "") for x in values], VALUES), spark.createDataFrame(vocabulary, "id bigint, term string")
    )
    plan = src.scan()._jdf.queryExecution().optimizedPlan().toString()
    inner = [line for line in plan.split("\n") if "Join Inner" in line]
    values = [line for line in inner if "born" in line]  # the others meet the small vocabulary
    assert "Cartesian" not in plan and len(values) >= 4 and all("_salt" in line for line in values)


def test_calendar_accessor(spark):
    labels = {
        "2024-02-29T23:59:59.5Z": (2024, 2, 29, 23, 59, Decimal("59.5"), 0), "2024-02-29+02:00": (2024, 2, 29, None, None, None, 120), "2023-02-29": None,
        "12:30:00-01:30": (None, None, None, 12, 30, Decimal(0), -90), "2024": (2024, None, None, None, None, None, None), "-0044": (-44, None, None, None, None, None, None),
        "2024-05": (2024, 5, None, None, None, None, None), "--02-29": (None, 2, 29, None, None, None, None), "--02-30": None, "--12": (None, 12, None, None, None, None, None),
        "---31Z": (None, None, 31, None, None, None, 0), "---32": None, "24:61:00": None, "2024-13": None, "": None, "x" * 300_000: None, "12024-01-01": (12024, 1, 1, None, None, None, None),
    }
    rows = spark.createDataFrame([(f'"{x}"^^<{XSD}any>', x) for x in labels] + [("<iri>", "<iri>"), (None, "null")], "o string, x string")
    got = {r.x: r.c for r in rows.select("x", accessors.calendar(F.col("o")).alias("c")).collect()}
    for x, want in {**labels, "<iri>": None, "null": None}.items():
        assert (got[x] and tuple(got[x])) == want, x


def test_typed_accessors(spark):
    o = F.col("o")

    def of(name, *labels):
        rows = spark.createDataFrame([(i, f'"{x}"^^<{XSD}any>') for i, x in enumerate(labels)], "i int, o string")
        made = {"dayTime": accessors.day_time_duration, "yearMonth": accessors.year_month_duration}.get(name, lambda k: accessors.as_type(k, name))(o)
        return [r.v for r in rows.select("i", made.alias("v")).orderBy("i").collect()]

    assert of("byte", "127", "128", "-128", "1.0") == [127, None, -128, None]
    assert of("long", "9223372036854775807", "9223372036854775808", " +7\n") == [2**63 - 1, None, 7]
    assert of("integer", "9" * 38, "9" * 39) == [Decimal("9" * 38), None]
    assert of("decimal", "1.50", "1e3", ".5") == [Decimal("1.5"), None, Decimal("0.5")]
    assert of("double", "1e3", "INF", "-INF", "1.5d", "0x1", "") == [1000.0, float("inf"), float("-inf"), None, None, None]
    assert of("boolean", "1", "false", "TRUE") == [True, False, None]
    assert of("dateTime", "2024-01-01T00:00:00", "2024-01-01T01:30:00+01:30", "2024") == [START, START, None]
    assert of("dayTime", "P1DT2H3M4.5S", "-PT1S", "P1Y", "P", "PT", "PT60M") == [datetime.timedelta(1, 7384, 500000), datetime.timedelta(seconds=-1), None, None, None, datetime.timedelta(hours=1)]
    rows = spark.createDataFrame([('"P1Y2M"',), ('"-P3M"',), ('"P1D"',), ('"P"',), ("<iri>",)], "o string")
    assert [r.v for r in rows.select(accessors.year_month_duration(o).cast("string").alias("v")).collect()] == ["INTERVAL '1-2' YEAR TO MONTH", "INTERVAL '-0-3' YEAR TO MONTH", None, None, None]


def test_tables_are_read_as_they_lie(spark, tmp_path):
    for rows in (1, 50_000):
        spark.range(rows).coalesce(1).write.parquet(str(tmp_path / f"t{rows}.parquet"))
        df = table(spark, str(tmp_path), f"t{rows}")
        assert df.count() == rows and "Exchange" not in df._jdf.queryExecution().toString()
