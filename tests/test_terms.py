from __future__ import annotations

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quadlake.functions import accessors
from quadlake.functions import terms as T

LABELS = st.text(st.characters(blacklist_categories=("Cs",)))


@given(LABELS)
def test_literals_decode_to_their_label(label):
    assert T.decode(T.literal(label)) == T.Term("literal", label)
    assert T.decode(T.literal(label, "en-GB")) == T.Term("literal", label, language="en-GB")
    assert T.decode(T.literal(label, "en", T.XSD + "string")) == T.Term("literal", label, datatype=T.XSD + "string")


def test_terms_that_look_alike_differ():
    keys = [T.literal("A"), T.literal("A", datatype=T.XSD + "string"), T.literal("A", "en"), T.literal("A", "EN"), T.uri("A"), T.bnode("A")]
    assert len(set(keys)) == len(keys)


@pytest.mark.parametrize("bad", [None, "", "plain", '"open', "<", '"a"x'])
def test_no_terms(bad):
    assert T.decode(bad) is None


CASES = [
    T.literal(""), T.literal('say "x"\n'), T.literal("é\U0001f600", "fr"), T.literal("1", datatype=T.XSD + "int"), T.literal("x" * 255), T.literal("x" * 256), T.literal("y" * 10_000),
    T.uri("http://e/a#x"), T.uri("http://e/a/x"), T.uri("urn:x"), T.uri("plain"), T.bnode("b1"), None, '"open',
]


def test_columns_agree_with_python(spark):
    k = F.col("k")
    df = spark.createDataFrame([(x,) for x in CASES], "k string")
    rows = df.select("k", T.string_value(k).alias("v"), T.language(k).alias("l"), T.datatype(k).alias("d"), T.kind(k).alias("kind"), T.namespace(k).alias("ns"), T.local_name(k).alias("local")).collect()
    for r in rows:
        t = T.decode(r.k)
        if t is None:
            assert r.v is None
            continue
        assert r.v == t.value
        assert r.l == ((t.language or "") if t.kind == "literal" else None)
        wanted = None if t.kind != "literal" or t.language else f"<{t.datatype or T.XSD + 'string'}>"
        assert r.d == wanted
        assert r.kind == ("long_literal" if t.kind == "literal" and len(t.value) >= 256 else t.kind)
    split = {r.k: (r.ns, r.local) for r in rows}
    assert split["<http://e/a#x>"] == ("http://e/a#", "x")
    assert split["<http://e/a/x>"] == ("http://e/a/", "x")
    assert split["<urn:x>"] == ("urn:", "x")
    assert split["<plain>"] == (None, None)


def test_builders(spark):
    row = spark.range(1).select(
        T.make_uri(F.lit("http://e/"), F.lit("a")), T.make_bnode(F.lit("b")), T.make_literal(F.lit("x"), F.lit("en")), T.make_literal(F.lit("x"), F.lit("")), T.make_literal(F.lit("1"), dtype=T.XSD + "int")
    ).first()
    assert list(row) == ["<http://e/a>", "_:b", '"x"@en', '"x"', f'"1"^^<{T.XSD}int>']


def test_new_blank_nodes_and_statements(spark):
    assert T.bnode("x") == "_:x" and T.bnode() != T.bnode() and T.decode(T.bnode()).kind == "bnode"
    made = [r.b for r in spark.range(200).select(T.make_bnode().alias("b")).collect()]
    assert len(set(made)) == 200 and all(b.startswith("_:n") for b in made)
    assert T.statement("<s>", "<p>", '"o"') == ("<s>", "<p>", '"o"', None)
    assert T.statement("_:s", "<p>", "_:o", "_:g")[3] == "_:g"
    for bad in [('"s"', "<p>", "<o>"), ("<s>", "_:p", "<o>"), ("<s>", "<p>", "o"), ("<s>", "<p>", "<o>", '"g"'), (None, "<p>", "<o>"), ("<s>", "<p>", "<o>", "g")]:
        with pytest.raises(ValueError):
            T.statement(*bad)
    df = spark.createDataFrame([("123456789",), ("",), (None,)], "x string")
    assert [r.v for r in df.select(accessors.checksum(F.col("x")).alias("v")).collect()] == [0xCBF43926, 0, None]
