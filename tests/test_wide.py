from __future__ import annotations

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quadlake.functions import lexical
from quadlake.functions.terms import XSD
from quadlake.operators import wide

QUADS = "s string, p string, o string, c string, grid string, pos int"
ATTRIBUTES = "p string, column_name string, value_type string, single_valued boolean"


def norm(spark, kind, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    x = F.col("_x")
    made = {"integer": lexical.norm_number(x, False), "decimal": lexical.norm_number(x, True), "boolean": lexical.norm_boolean(x), "date": lexical.norm_date(x), "timestamp": lexical.norm_timestamp(x)}[kind]
    out = df.withColumn("_x", lexical.trim(F.col("t"))).withColumn("n", made).withColumn("v", lexical.typed(kind, F.col("n"))).orderBy("i").collect()
    return [r.n for r in out], [r.v for r in out]


def test_numbers(spark):
    texts = ["7", "+007", "-0", " 12\n", " 5　", "1.0", "", "-", "1e3", "٣", "12 3", "9" * 25]
    forms, values = norm(spark, "integer", texts)
    assert forms == ["7", "7", "0", "12", "5", None, None, None, None, None, None, "9" * 25]
    assert values[:5] == [7, 7, 0, 12, 5] and values[-1] is None
    texts = ["1.50", "+01.5", ".5", "5.", "-0.0", "-.0", ".", "1.2.3", "1e3", "100", "0010.0100", "-3.25", "INF", None]
    forms, values = norm(spark, "decimal", texts)
    assert forms == ["1.5", "1.5", ".5", "5", "0", "0", None, None, None, "100", "10.01", "-3.25", None, None]
    assert values[:6] == [Decimal("1.5"), Decimal("1.5"), Decimal(".5"), Decimal(5), 0, 0]


def test_long_numbers_take_linear_time(spark):
    digits = "1" * 200_000
    forms, _ = norm(spark, "decimal", [digits + "x", "1." + "0" * 200_000 + "1", "0" * 200_000 + "7.5" + "0" * 200_000, digits + "." + digits])
    assert forms[0] is None and len(forms[1]) == 200_003 and forms[2] == "7.5" and len(forms[3]) == 400_001
    forms, _ = norm(spark, "timestamp", ["2024-01-01T00:00:00." + "0" * 200_000 + "1" + "0" * 9 + "Z", "2024-01-01T00:00:00." + "0" * 200_000])
    assert len(forms[0]) == 10 + 1 + 200_001 and len(forms[1]) == 10


def test_booleans_and_days(spark):
    forms, values = norm(spark, "boolean", ["true", "1", " false ", "0", "True", "yes", ""])
    assert values == [True, True, False, False, None, None, None]
    forms, values = norm(spark, "date", ["2024-02-29", "2023-02-29", " 2024-01-01\t", "2024-1-1", "0000-01-01", "2024-01-01T00:00:00", "9999-12-31"])
    assert values == [datetime.date(2024, 2, 29), None, datetime.date(2024, 1, 1), None, None, None, datetime.date(9999, 12, 31)]


def test_instants(spark):
    texts = [
        "2024-01-01T00:00:00", "2024-01-01T00:00:00Z", "2024-01-01T02:00:00+02:00", "2023-12-31T22:30:00.000-01:30", "2024-01-01T00:00:00.250", "2024-01-01T00:00:00.2500000Z",
        "2024-01-01T24:00:00", "2024-02-30T00:00:00", "2024-01-01 00:00:00", "2024-01-01T00:00:60", "2024-01-01T00:00", "2024-01-01T00:00:00z", "2024-01-01T00:00:00+25:00", "1969-12-31T23:59:59",
    ]
    forms, values = norm(spark, "timestamp", texts)
    assert len(set(forms[:4])) == 1 and forms[4] == forms[5] != forms[0]
    assert forms[6:13] == [None] * 7
    assert values[0] == datetime.datetime(2024, 1, 1) and values[4] == datetime.datetime(2024, 1, 1, 0, 0, 0, 250000)
    assert values[13] == datetime.datetime(1969, 12, 31, 23, 59, 59)


def lit(x, t=None):
    return f'"{x}"' + (f"^^<{XSD}{t}>" if t else "")


KNOWN = [("<n>", "n", "integer", True), ("<d>", "d", "decimal", True), ("<t>", "t", "string", False), ("<r>", "r", "iri", True), ("<w>", "w", "timestamp", True), ("<f>", "s", "string", True)]
DATA = [
    ("<a>", "<n>", lit("1"), None), ("<a>", "<n>", lit("01", "int"), "<g>"), ("<a>", "<d>", lit("2.5"), None), ("<a>", "<d>", lit("2.50", "decimal"), None), ("<a>", "<t>", lit("z"), None), ("<a>", "<t>", lit("b"), None),
    ("<b>", "<n>", lit("1"), None), ("<b>", "<n>", lit("2"), "<g>"), ("<b>", "<r>", lit("x"), None), ("<b>", "<r>", "_:x", None), ("<b>", "<w>", lit("2024-01-01T01:00:00+01:00"), None), ("<b>", "<w>", lit("2024-01-01T00:00:00Z"), None),
    ("<c>", "<unknown>", lit("1"), None), ("<d>", "<n>", None, None), (None, "<n>", lit("1"), None), ("<e>", None, lit("1"), None), ("_:x", "<n>", lit("one"), None), ("_:x", "<f>", lit("A"), None), ("_:x", "<f>", '"A"@en', None),
]


def quads(spark, data):
    return spark.createDataFrame([(*x, "clash", 9) for x in data + data[:6]], QUADS)


def test_wide_rows_and_unclean_cells(spark):
    known = spark.createDataFrame(KNOWN + KNOWN[:1], ATTRIBUTES)
    df = wide.wide_table(quads(spark, DATA), known)
    assert sorted(df.columns) == sorted(["s", "n", "d", "t", "r", "w", "s_2"]) or "s" in df.columns
    rows = {r[0]: r for r in df.collect()}
    assert set(rows) == {"<a>", "<b>", "<c>", "<d>", "<e>", "_:x"}
    assert (rows["<a>"].n, rows["<a>"].d, rows["<a>"].t) == (1, Decimal("2.5"), "b")
    assert rows["<b>"].n is None and rows["<b>"].r == "_:x" and rows["<b>"].w == datetime.datetime(2024, 1, 1)
    assert all(x is None for x in rows["<c>"][1:])
    listed = wide.attribute_list(known)
    bad = wide.unclean_cells(wide.entity_grid(quads(spark, DATA), listed), listed).collect()
    assert {(r.s, r.p, r.conflict) for r in bad} == {("<b>", "<n>", True), ("<b>", "<r>", False), ("_:x", "<n>", False)}


@pytest.mark.parametrize("row", [("<z>", "z", "unknown", True), (None, "z", "string", True), ("<z>", None, "string", True), ("<n>", "n", "string", True), ("<n>", "other", "integer", True)])
def test_attributes_that_cannot_become_columns_raise(spark, row):
    with pytest.raises(ValueError):
        wide.attribute_list(spark.createDataFrame([*KNOWN, row], ATTRIBUTES))


def test_grid_has_every_position_once(spark):
    many = [(f"<p{i:04}>", f"c{i}", "integer", True) for i in range(700)]
    data = [("<full>", p, lit(i), None) for i, (p, *_) in enumerate(many)] + [("<one>", "<p0123>", lit(5), None), ("<none>", "<else>", lit(5), None)]
    grid = {r.s: r.grid for r in wide.entity_grid(quads(spark, data), many).collect()}
    assert all([c.pos for c in g] == list(range(700)) for g in grid.values())
    assert [c.lo for c in grid["<full>"]] == [str(i) for i in range(700)]
    assert [c.pos for c in grid["<one>"] if c.lo is not None] == [123] and not any(c.lo for c in grid["<none>"])


def test_column_names_that_clash(spark):
    listed = wide.attribute_list(spark.createDataFrame(KNOWN, ATTRIBUTES))
    names = [a[1] for a in listed]
    assert len({n.lower() for n in names} | {"s"}) == len(names) + 1


def test_empty(spark):
    none, attributes = spark.createDataFrame([], QUADS), spark.createDataFrame([], ATTRIBUTES)
    assert wide.wide_table(none, spark.createDataFrame(KNOWN, ATTRIBUTES)).count() == 0
    assert wide.wide_table(quads(spark, DATA), attributes).columns == ["s"]
    assert wide.unclean_cells(wide.entity_grid(quads(spark, DATA), []), []).count() == 0


@pytest.mark.parametrize("n", [3000])
def test_a_hot_subject_gives_one_row(spark, n):
    data = [("<hot>", "<t>", lit(i), None) for i in range(n)]
    rows = wide.wide_table(quads(spark, data), spark.createDataFrame(KNOWN, ATTRIBUTES)).collect()
    assert len(rows) == 1 and rows[0].t == "0"


def test_every_value_of_a_cell_is_given(spark):
    listed = wide.attribute_list(spark.createDataFrame(KNOWN, ATTRIBUTES))
    hot = [("<hot>", "<t>", lit(i), None) for i in range(3000)]
    got = [tuple(r) for r in wide.cell_values(quads(spark, DATA + hot), listed).collect()]
    several = [a for a in listed if not a[3]]
    assert sorted(r[3] for r in got if r[0] == "<hot>") == sorted(str(i) for i in range(3000))
    assert {r for r in got if r[:2] == ("<a>", "<t>")} == {("<a>", "<t>", "t", "b"), ("<a>", "<t>", "t", "z")}
    assert {r[3] for r in got if r[:2] == ("<b>", "<n>")} == {"1", "2"} and not [r for r in got if r[:2] == ("_:x", "<n>")]
    assert len(got) == len(set(got)) and all(r[0] is not None for r in got)
    assert sorted(tuple(r) for r in wide.cell_values(quads(spark, DATA + hot), several).collect()) == sorted(r for r in got if r[1] == "<t>")
    assert wide.cell_values(quads(spark, DATA), []).count() == 0


def test_p3_values_against_its_sql(spark):
    import __spark_entry__ as entries
    from compare import connect, difference

    folder = "/root/testdata/sf0.001"
    assert difference(entries.queries()["p3_values"](spark, folder), connect(folder), entries.oracle_sql()["p3_values"]) == ""


UNHELD = [
    ("<a>", "<n>", lit("9" * 20), None), ("<b>", "<n>", lit("9223372036854775807"), None), ("<a>", "<d>", lit("-0.12345678901"), None), ("<b>", "<d>", lit("0.1234567890000"), None),
    ("<c>", "<d>", lit("1" * 29), None), ("<d>", "<d>", lit("1" * 28 + ".5"), None), ("<a>", "<w>", lit("2024-01-01T00:00:00.1234567Z"), None), ("<b>", "<w>", lit("2024-01-01T00:00:00.1234560Z"), None),
    ("<c>", "<n>", lit("x"), None), ("<d>", "<n>", lit("8" * 20), None), ("<d>", "<n>", lit("9" * 20), None), ("<a>", "<t>", lit("." + "0" * 20 + "1"), None), ("<a>", "<v>", lit("9" * 20), None), ("<a>", "<v>", lit("99"), None),
]


def test_cells_whose_column_cannot_hold_the_value_are_unclean(spark):
    known = spark.createDataFrame([*KNOWN, ("<v>", "v", "integer", False)], ATTRIBUTES)
    listed, data = wide.attribute_list(known), spark.createDataFrame([(*x, "clash", 9) for x in UNHELD], QUADS)
    bad = {(r.s, r.p): (r.n_misfit, r.conflict, r.unheld) for r in wide.unclean_cells(wide.entity_grid(data, listed), listed).collect()}
    unheld = {("<a>", "<n>"), ("<a>", "<d>"), ("<c>", "<d>"), ("<a>", "<w>")}
    assert bad == {("<c>", "<n>"): (1, False, False), ("<d>", "<n>"): (0, True, False), **{k: (0, False, True) for k in unheld}}
    rows = {r.s: r for r in wide.wide_table(data, known).collect()}
    assert rows["<b>"].n == 9223372036854775807 and rows["<b>"].d == Decimal("0.123456789") and rows["<b>"].w.microsecond == 123456
    assert rows["<d>"].d == Decimal("1" * 28 + ".5") and rows["<a>"].n is None and rows["<c>"].d is None


def test_p3_cells_lists_what_p3_found_does_not(spark, tmp_path):
    import __spark_entry__ as entries

    spark.createDataFrame([(*x, "clash", 9) for x in UNHELD], QUADS).write.parquet(f"{tmp_path}/quads.parquet")
    spark.createDataFrame(KNOWN, ATTRIBUTES).write.parquet(f"{tmp_path}/attribute_types.parquet")
    cells = {(r.s, r.p): (r.conflict, r.misfit) for r in entries.queries()["p3_cells"](spark, str(tmp_path)).collect()}
    found = {(r.s, r.p) for r in entries.queries()["p3_found"](spark, str(tmp_path)).collect()}
    assert found == {("<c>", "<n>"), ("<d>", "<n>")} == {k for k, v in cells.items() if any(v)}
    assert {k for k, v in cells.items() if not any(v)} == {("<a>", "<n>"), ("<a>", "<d>"), ("<c>", "<d>"), ("<a>", "<w>")}
