"""Turtle and TriG text: one document a file, files read in parallel.

The two languages shorten what they say by prefixes, repeated subjects and
nested blank nodes, so a document can only be read from its start. Each file is
one task's work; a large corpus is to come in many files. N-Quads and N-Triples
lines, which can be cut anywhere, are better read by ``nquads``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadlake.errors import QuadlakeError, TurtleSyntaxError
from quadlake.functions.terms import XSD, bnode, literal, uri
from quadlake.plans.sparql import unescape
from quadlake.session import ship
from quadlake.sources.nquads import format_quads
from quadlake.sources.quads import SCHEMA

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
#: Bytes of one file; a larger one is refused, since it is read as a whole.
MAX_FILE = 1 << 30
#: Quads of one file that is written.
FILE_QUADS = 500_000
#: Quads a task holds before it passes them on.
BATCH = 50_000
_CHAR = r"[\w·-]"
_LOCAL = rf"(?:{_CHAR}|:|%[0-9A-Fa-f]{{2}}|\\[_~.!$&'()*+,;=/?#@%-]|\.(?=[\w·:%\\.-]))*+"
_TOKEN = re.compile(
    rf"""(?P<space>(?:\s|\#[^\r\n]*)++)
|(?P<iri><[^<>"{{}}|^`\x00-\x20]*>)
|(?P<long>\"\"\"(?:\"{{0,2}}(?:[^"\\]|\\.))*+\"\"\"|'''(?:'{{0,2}}(?:[^'\\]|\\.))*+''')
|(?P<string>"(?:[^"\\\r\n]|\\.)*+"|'(?:[^'\\\r\n]|\\.)*+')
|(?P<word>@(?:prefix|base)\b|(?:PREFIX|BASE|GRAPH|prefix|base|graph|Prefix|Base|Graph)\b(?!:)|(?:a|true|false)(?![\w:.-]|\.\w))
|(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
|(?P<bnode>_:\w(?:[\w·.-]*[\w·-])?)
|(?P<name>(?:[^\W\d_](?:[\w·.-]*[\w·-])?)?:{_LOCAL})
|(?P<number>[+-]?(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+|[0-9]+\.(?=[eE]))(?:[eE][+-]?[0-9]+)?)
|(?P<mark>\^\^|[;,.\[\](){{}}])""",
    re.X | re.S,
)

Quad = tuple[str, str, str, str | None]


class Document:
    """Parses one document; quads() gives its statements in their order.

    name keeps the blank nodes without a label of different documents apart;
    those with one keep it. base resolves relative IRIs.
    """

    def __init__(self, text: str, name: str = "", base: str = ""):
        self.text, self.at, self.base, self.prefixes = text, 0, base, {}
        self.own, self.made = hashlib.sha256(name.encode()).hexdigest()[:12], 0
        self.kind, self.token = "", ""
        self.graph: str | None = None
        self.out: list[Quad] = []
        self.advance()

    # -------------------------------------------------------------------- tokens
    def advance(self) -> None:
        while self.at < len(self.text):
            m = _TOKEN.match(self.text, self.at)
            if m is None:
                raise self.error()
            self.at = m.end()
            if m.lastgroup != "space":
                self.kind, self.token = m.lastgroup, m[0]
                return
        self.kind, self.token = "end", ""

    def error(self) -> TurtleSyntaxError:
        line = self.text.count("\n", 0, self.at) + 1
        return TurtleSyntaxError(f"line {line}: unexpected {(self.token or self.text[self.at : self.at + 20])!r}")

    def take(self, *tokens: str) -> bool:
        if self.kind in ("mark", "word") and self.token in tokens:
            self.advance()
            return True
        return False

    def need(self, token: str) -> None:
        if not self.take(token):
            raise self.error()

    # --------------------------------------------------------------------- terms
    def fresh(self) -> str:
        self.made += 1
        return bnode(f"t{self.own}-{self.made}")

    def absolute(self, iri: str) -> str:
        return iri if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", iri) else urljoin(self.base, iri) if self.base else iri

    def iri(self) -> str:
        kind, token = self.kind, self.token
        if kind == "iri":
            self.advance()
            return uri(self.absolute(unescape(token[1:-1])))
        if kind == "name":
            prefix, _, local = token.partition(":")
            if prefix not in self.prefixes:
                raise TurtleSyntaxError(f"prefix {prefix}: is not declared")
            self.advance()
            return uri(self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local))
        raise self.error()

    def label(self) -> str:
        quotes = 3 if self.kind == "long" else 1
        text = unescape(self.token[quotes:-quotes])
        self.advance()
        if self.kind == "lang":
            tag = self.token[1:]
            self.advance()
            return literal(text, tag)
        return literal(text, datatype=self.iri()[1:-1]) if self.take("^^") else literal(text)

    def term(self) -> str:
        """A term in the place of a subject or object, with what is nested in it."""
        kind, token = self.kind, self.token
        if kind in ("iri", "name"):
            return self.iri()
        if kind == "bnode":
            self.advance()
            return token
        if kind in ("string", "long"):
            return self.label()
        if kind == "number":
            self.advance()
            return literal(token, datatype=XSD + ("double" if "e" in token.lower() else "decimal" if "." in token else "integer"))
        if self.take("["):
            node = self.fresh()
            if not self.take("]"):
                self.properties(node)
                self.need("]")
            return node
        if self.take("("):
            return self.items()
        if kind == "word" and token in ("true", "false"):
            self.advance()
            return literal(token, datatype=XSD + "boolean")
        raise self.error()

    def items(self) -> str:
        """A collection: a chain of blank nodes."""
        first = node = uri(RDF, "nil")
        before = None
        while not self.take(")"):
            item = self.term()
            node = self.fresh()
            if before is None:
                first = node
            else:
                self.add(before, uri(RDF, "rest"), node)
            self.add(node, uri(RDF, "first"), item)
            before = node
        if before is not None:
            self.add(before, uri(RDF, "rest"), uri(RDF, "nil"))
        return first

    # ---------------------------------------------------------------- statements
    def add(self, s: str, p: str, o: str) -> None:
        if s[0] == '"':
            raise self.error()
        self.out.append((s, p, o, self.graph))

    def properties(self, subject: str) -> None:
        while True:
            predicate = uri(RDF, "type") if self.take("a") else self.iri()
            self.add(subject, predicate, self.term())
            while self.take(","):
                self.add(subject, predicate, self.term())
            if not self.take(";"):
                return
            while self.take(";"):
                pass
            if self.kind not in ("iri", "name") and self.token != "a":
                return

    def block(self) -> None:
        """What stands between { and }."""
        while not self.take("}"):
            self.triples()
            if not self.take(".") and self.token != "}":
                raise self.error()

    def triples(self, subject: str | None = None) -> None:
        bracket, before = subject is None and self.kind == "mark" and self.token == "[", len(self.out)
        subject = self.term() if subject is None else subject
        # a node with properties of its own is a statement by itself
        if not (bracket and len(self.out) > before and self.kind == "mark" and self.token in (".", "}")):
            self.properties(subject)

    def quads(self) -> Iterator[Quad]:
        while self.kind != "end":
            word = self.token.lower() if self.kind == "word" else ""
            if word.lstrip("@") in ("prefix", "base"):
                self.advance()
                if word.endswith("prefix"):
                    if self.kind != "name" or not self.token.endswith(":"):
                        raise self.error()
                    prefix = self.token[:-1]
                    self.advance()
                    self.prefixes[prefix] = self.iri()[1:-1]
                else:
                    self.base = self.iri()[1:-1]
                if word[0] == "@":
                    self.need(".")
            elif self.take("{"):
                self.block()
            elif word == "graph" or self.kind in ("iri", "name", "bnode"):
                if word == "graph":
                    self.advance()
                name = self.term()
                if self.take("{"):
                    self.graph = name
                    self.block()
                    self.graph = None
                elif word:
                    raise self.error()
                else:
                    self.triples(name)
                    self.need(".")
            else:
                self.triples()
                self.need(".")
            yield from self.out
            self.out.clear()


def _batch(rows: list[Quad]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows) if rows else ([], [], [], []))], names=["s", "p", "o", "c"])


def parse_documents(files: DataFrame, strict: bool = True) -> DataFrame:
    """s, p, o, c of documents given as rows of path and content (binary)."""
    ship(files.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows: list[Quad] = []
                try:
                    for q in Document((content or b"").decode("utf-8-sig"), path or "", path or "").quads():
                        rows.append(q)
                        if len(rows) >= BATCH:
                            yield _batch(rows)
                            rows = []
                except (QuadlakeError, ValueError) as e:
                    if strict:
                        raise ValueError(f"{path}: {e}") from None
                yield _batch(rows)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def read_turtle(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """The quads of Turtle or TriG files, a folder of them or a pattern.

    strict: a syntax error raises; otherwise the statements before it are given
    and the rest of that file is passed over. Relative IRIs are resolved against
    the file's path. A file over MAX_FILE bytes raises.
    """
    files = spark.read.format("binaryFile").load(path)
    sized = F.when(F.col("length") <= MAX_FILE, F.col("content")).otherwise(F.raise_error(F.concat("path", F.lit(": too large to be read as one document"))).cast("binary"))
    return parse_documents(files.select("path", sized.alias("content")), strict)


def format_trig(quads: DataFrame) -> DataFrame:
    """One column value: a TriG statement for each quad, a line of its own, so
    that documents can be put together of any of them."""
    line = F.col("value")

    def inside(c: Column) -> Column:
        return F.when(c.isNull(), line).otherwise(F.concat(F.lit("GRAPH "), c, F.lit(" { "), line, F.lit(" }")))

    triples = format_quads(quads.withColumns({"_c": F.col("c"), "c": F.lit(None).cast("string")}), "_c")
    return triples.select(inside(F.col("_c")).alias("value"))


def write_trig(quads: DataFrame, path: str, per_file: int = FILE_QUADS) -> None:
    """Files of at most so many quads, each a document."""
    format_trig(quads).write.option("maxRecordsPerFile", per_file).text(path)
