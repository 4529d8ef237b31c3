from __future__ import annotations

from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quadlake.errors import QuadlakeError
from quadlake.functions.terms import XSD, decode
from quadlake.sources.quads import SCHEMA
from quadlake.sources.turtle import RDF, Document, parse_documents, read_turtle, write_trig

E = "http://e/"


def read(text, base=""):
    return list(Document(text, "doc", base).quads())


def test_prefixes_lists_and_shorthands():
    got = read('''@prefix e: <http://e/> . PREFIX : <http://d/>
# a comment
e:s a e:T ; e:p "x" , "y"@en-GB , 'z'^^e:t ;; :q 1 , -2.5 , 1e3 , true, .5 .
e:s.t :a\\,b <x y> .'''.replace("<x y>", "<http://x/y>"))
    s = f"<{E}s>"
    want = [(f"<{RDF}type>", f"<{E}T>"), (f"<{E}p>", '"x"'), (f"<{E}p>", '"y"@en-GB'), (f"<{E}p>", f'"z"^^<{E}t>')]
    want += [("<http://d/q>", f'"{v}"^^<{XSD}{t}>') for v, t in (("1", "integer"), ("-2.5", "decimal"), ("1e3", "double"), ("true", "boolean"), (".5", "decimal"))]
    assert got[:-1] == [(s, p, o, None) for p, o in want]
    assert got[-1] == (f"<{E}s.t>", "<http://d/a,b>", "<http://x/y>", None)


def test_nested_nodes_and_collections():
    got = read("@prefix e: <http://e/> . [ e:p [ e:q 1 ] ] e:r ( 2 () ) . [] e:s _:x.1 . [ e:only 3 ] .")
    assert all(decode(t) is not None for q in got for t in q[:3])
    by = {(p, o): s for s, p, o, _ in got}
    inner = by[(f"<{E}q>", f'"1"^^<{XSD}integer>')]
    outer = by[(f"<{E}p>", inner)]
    head = next(o for s, p, o, _ in got if (s, p) == (outer, f"<{E}r>"))
    assert by[(f"<{RDF}first>", f'"2"^^<{XSD}integer>')] == head
    rest = next(o for s, p, o, _ in got if (s, p) == (head, f"<{RDF}rest>"))
    assert (rest, f"<{RDF}first>", f"<{RDF}nil>", None) in got and (rest, f"<{RDF}rest>", f"<{RDF}nil>", None) in got
    assert len({inner, outer, head, rest}) == 4 and any(o == "_:x.1" for _, _, o, _ in got) and any(p == f"<{E}only>" for _, p, _, _ in got)


def test_graphs_and_bases():
    got = read("BASE <http://e/dir/> <g> { <a> <b> <c> . <a> <b> <../d> } GRAPH _:h { <a> <b> \"x\" } { <a> <b> <#f> . } <a> <b> <c> .")
    a, b = "<http://e/dir/a>", "<http://e/dir/b>"
    assert got == [(a, b, "<http://e/dir/c>", "<http://e/dir/g>"), (a, b, "<http://e/d>", "<http://e/dir/g>"), (a, b, '"x"', "_:h"), (a, b, "<http://e/dir/#f>", None), (a, b, "<http://e/dir/c>", None)]


def test_strings():
    got = read('<a:s> <a:p> """long "quoted" \n text\\t""", "short \\u00e9\\"", "" , \'\'\'it\'s\'\'\' .')
    assert [o for _, _, o, _ in got] == ['"long "quoted" \n text\t"', '"short é""', '""', '"it\'s"']
    assert read('<a:s> <a:p> "' + "x\\n" * 200_000 + '" .')[0][2] == '"' + "x\n" * 200_000 + '"'


@pytest.mark.parametrize("text", ["<a:s> <a:p>", "<a:s> <a:p> <a:o>", "e:s <a:p> <a:o> .", '"x" <a:p> <a:o> .', "<a:s> _:p <a:o> .", '<a:s> <a:p> "open .', "<a:g> { <a:s> <a:p> <a:o>", "<a:s> <a:p> ( 1 .", "@prefix e <a:> .", "<a:s> <a:p> <a o> .", "[] .", "GRAPH <a:g> <a:p> <a:o> ."])
def test_errors(text):
    with pytest.raises(QuadlakeError):
        read(text)


def test_files(spark, tmp_path):
    (tmp_path / "good.ttl").write_text("<a:s> <a:p> <a:o> .\n<a:s> <a:p> <rel> .")
    (tmp_path / "empty.ttl").write_text("")
    rows = read_turtle(spark, str(tmp_path)).collect()
    assert len(rows) == 2 and rows[1].o.endswith("/rel>") and rows[1].o.startswith("<file:")
    (tmp_path / "bad.ttl").write_text("<a:s> <a:p> <a:1> .\n<a:s> <a:p> oops .\n<a:s> <a:p> <a:2> .")
    assert {r.o for r in read_turtle(spark, str(tmp_path), strict=False).collect()} >= {"<a:o>", "<a:1>"}
    with pytest.raises(Exception, match="line 2"):
        read_turtle(spark, str(tmp_path)).collect()
    two = spark.createDataFrame([("x", bytearray(b"[] <a:p> 1 .")), ("y", bytearray(b"[] <a:p> 1 .")), (None, None)], "path string, content binary")
    assert parse_documents(two).select("s").distinct().count() == 2  # blank nodes of two documents


@settings(max_examples=5, deadline=None)
@given(labels=st.lists(st.text(st.characters(blacklist_categories=("Cs",)), max_size=30), min_size=1, max_size=40))
def test_any_label_survives_trig(spark, tmp_path_factory, labels):
    data = [("<http://e/a>", "<http://e/p>", f'"{x}"' + ("", "@en", "^^<http://e/t>")[i % 3], (None, "_:g", "<http://e/g>")[i % 3]) for i, x in enumerate(labels)]
    path = str(tmp_path_factory.mktemp("trig") / "out")
    write_trig(spark.createDataFrame(data, SCHEMA), path, 7)
    assert Counter(tuple(r) for r in read_turtle(spark, path).collect()) == Counter(data)
