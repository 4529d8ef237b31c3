"""Term keys: building and taking apart, in Python and as Columns.

A term is one string: ``<iri>``, ``_:label``, ``"lex"``, ``"lex"@lang`` or
``"lex"^^<datatype>``. The lexical part is not escaped and ends at the last
quote, which neither a language tag nor a datatype IRI may contain. Two terms
are the same if and only if their keys are equal byte for byte.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

XSD = "http://www.w3.org/2001/XMLSchema#"
#: Labels of at least so many characters are "long literals".
LONG_LABEL = 256


# ---------------------------------------------------------------- Python side
@dataclass(frozen=True)
class Term:
    """A decoded term; kind is uri, bnode or literal."""

    kind: str
    value: str
    language: str | None = None
    datatype: str | None = None


def uri(value: str, local: str | None = None) -> str:
    return f"<{value}{local or ''}>"


def bnode(label: str | None = None) -> str:
    """A blank node; without a label a new one that no other call gives."""
    return f"_:{label or 'n' + uuid.uuid4().hex}"


def literal(label: str, language: str | None = None, datatype: str | None = None) -> str:
    """A literal key. If both are given the datatype wins and the language is dropped."""
    if datatype is not None:
        return f'"{label}"^^<{datatype}>'
    return f'"{label}"@{language}' if language else f'"{label}"'


def statement(s: str, p: str, o: str, c: str | None = None) -> tuple[str, str, str, str | None]:
    """A quad, c None for the default graph. Terms that cannot stand in their
    place raise."""
    kinds = [t.kind if (t := decode(x)) else None for x in (s, p, o)]
    graph = "uri" if c is None else g.kind if (g := decode(c)) else None
    if kinds[0] not in ("uri", "bnode") or kinds[1] != "uri" or kinds[2] is None or graph not in ("uri", "bnode"):
        raise ValueError(f"not a quad: {(s, p, o, c)}")
    return s, p, o, c


def decode(key: str | None) -> Term | None:
    """The parts of a key; None for None and for a string that is no key."""
    if not key:
        return None
    if key[0] == "<" and key[-1] == ">" and len(key) > 1:
        return Term("uri", key[1:-1])
    if key.startswith("_:"):
        return Term("bnode", key[2:])
    end = key.rfind('"')
    if key[0] != '"' or end == 0:
        return None
    lex, suffix = key[1:end], key[end + 1 :]
    if suffix.startswith("^^<") and suffix.endswith(">"):
        return Term("literal", lex, datatype=suffix[3:-1])
    if suffix.startswith("@"):
        return Term("literal", lex, language=suffix[1:])
    return Term("literal", lex) if not suffix else None


# ---------------------------------------------------------------- Column side
def is_uri(key: Column) -> Column:
    return F.substring(key, 1, 1) == "<"


def is_bnode(key: Column) -> Column:
    return F.substring(key, 1, 2) == "_:"


def is_literal(key: Column) -> Column:
    return F.substring(key, 1, 1) == '"'


def is_resource(key: Column) -> Column:
    return is_uri(key) | is_bnode(key)


def legal_quad(s: str = "s", p: str = "p", o: str = "o", c: str = "c") -> Column:
    """Rows that are quads: a resource, an IRI, any term, and a resource or null."""
    graph = F.col(c)
    return is_resource(F.col(s)) & is_uri(F.col(p)) & (is_resource(F.col(o)) | is_literal(F.col(o))) & (graph.isNull() | is_resource(graph))


def suffix(key: Column) -> Column:
    """What follows the last quote of a literal; null for other terms."""
    return F.when(is_literal(key), F.substring_index(key, '"', -1))


def lex(key: Column) -> Column:
    """The label of a literal, null for other terms."""
    size = F.length(key) - F.length(F.substring_index(key, '"', -1)) - 2
    return F.when(is_literal(key) & (size >= 0), F.substring(key, F.lit(2), size))


def str_value(key: Column) -> Column:
    """STR(): the IRI or the label; an error (null) for blank nodes."""
    return F.when(is_uri(key), F.substring(key, F.lit(2), F.length(key) - 2)).otherwise(lex(key))


def string_value(key: Column) -> Column:
    """The text of any term: IRI, blank node label or literal label."""
    return F.when(is_bnode(key), F.substring(key, F.lit(3), F.length(key))).otherwise(str_value(key))


def language(key: Column) -> Column:
    """LANG(): the tag, '' for a literal without one, null for other terms."""
    end = suffix(key)
    return F.when(end.startswith("@"), F.substring(end, F.lit(2), F.length(end))).when(end.isNotNull(), F.lit(""))


def datatype(key: Column) -> Column:
    """DATATYPE() as an IRI key: xsd:string for plain literals, null if there
    is a language tag (SPARQL 1.0: an error) or the term is no literal."""
    end = suffix(key)
    return F.when(end.startswith("^^<"), F.substring(end, F.lit(3), F.length(end))).when(end == "", F.lit(f"<{XSD}string>"))


def kind(key: Column) -> Column:
    """uri, bnode, literal or long_literal (label of LONG_LABEL or more characters)."""
    return (
        F.when(is_uri(key), "uri")
        .when(is_bnode(key), "bnode")
        .when(is_literal(key), F.when(F.length(lex(key)) >= LONG_LABEL, "long_literal").otherwise("literal"))
    )


def uri_split_at(iri: Column) -> Column:
    """Length of the namespace: up to the last '#', else the last '/', else the last ':'."""
    back = F.reverse(iri)
    size = F.length(iri)

    def after(mark: str) -> Column:
        return F.when(F.locate(mark, back) > 0, size - F.locate(mark, back) + 1)

    return F.coalesce(after("#"), after("/"), after(":"))


def namespace(key: Column) -> Column:
    iri = F.when(is_uri(key), str_value(key))
    return F.substring(iri, F.lit(1), uri_split_at(iri))


def local_name(key: Column) -> Column:
    iri = F.when(is_uri(key), str_value(key))
    return F.substring(iri, uri_split_at(iri) + 1, F.length(iri))


def make_uri(value: Column, local: Column | None = None) -> Column:
    return F.concat(F.lit("<"), *([value] if local is None else [value, local]), F.lit(">"))


def make_bnode(label: Column | None = None) -> Column:
    """Without a label a new blank node for every row, and for every run: stage
    the rows before they are used twice."""
    return F.concat(F.lit("_:"), F.concat(F.lit("n"), F.replace(F.uuid(), F.lit("-"))) if label is None else label)


def make_literal(label: Column, lang: Column | None = None, dtype: str | None = None) -> Column:
    if dtype is not None:
        return F.concat(F.lit('"'), label, F.lit(f'"^^<{dtype}>'))
    if lang is not None:
        return F.concat(F.lit('"'), label, F.lit('"'), F.when(F.length(lang) > 0, F.concat(F.lit("@"), lang)).otherwise(F.lit("")))
    return F.concat(F.lit('"'), label, F.lit('"'))
