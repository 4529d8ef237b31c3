"""Relational tables as a virtual set of quads.

Each branch maps one table and predicate. A bound predicate or graph leaves
only the matching branches, and a bound subject or object is taken apart by the
branch's template into a condition on key columns, which reaches the Parquet
scan. Variables keep their key columns as long as both sides of a join use the
same template, so graph patterns join on integers, not on term strings.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadlake.functions.terms import XSD
from quadlake.sources.quads import SCHEMA, QuadSource
from quadlake.sources.tables import table


@dataclass(frozen=True)
class Template:
    """``<prefix{a}-{b}>`` over integer columns; name keeps templates apart that
    different tables share (customer.c_custkey, orders.o_custkey)."""

    prefix: str
    columns: tuple[str, ...]

    def key(self) -> Column:
        """The key as one column: the integer, or a struct of several."""
        parts = [F.col(c).cast("bigint") for c in self.columns]
        return parts[0] if len(parts) == 1 else F.struct(*[p.alias(f"k{i}") for i, p in enumerate(parts)])

    def term(self, key: Column) -> Column:
        n = len(self.columns)
        parts = [key] if n == 1 else [key[f"k{i}"] for i in range(n)]
        text = [x for p in parts for x in (F.lit("-"), p.cast("string"))][1:]
        return F.when(key.isNotNull(), F.concat(F.lit(f"<{self.prefix}"), *text, F.lit(">")))

    def same(self, other: Template) -> bool:
        return self.prefix == other.prefix and len(self.columns) == len(other.columns)

    def match(self, term: str) -> Column | None:
        """The condition on the columns under which the term comes out; None: never."""
        if not (term.startswith(f"<{self.prefix}") and term.endswith(">")):
            return None
        parts = term[len(self.prefix) + 1 : -1].split("-")
        if len(parts) != len(self.columns) or not all(x.isdecimal() and x.isascii() and str(int(x)) == x and int(x) < 1 << 63 for x in parts):
            return None
        return reduce(Column.__and__, [F.col(c) == int(x) for c, x in zip(self.columns, parts)])


@dataclass(frozen=True)
class Literal:
    """A literal made of a column. kind: plain, string, integer, decimal,
    dateTime, boolean, or lang with the tag in another column."""

    column: str
    kind: str = "plain"
    tag: str | None = None

    def raw(self) -> Column:
        """The column, with its tag if the literal has one; a decimal is made exact
        where it is read, not again for each pair of rows it is compared in."""
        if self.kind == "decimal":
            return F.col(self.column).cast("decimal(18,2)")
        return F.col(self.column) if self.kind != "lang" else F.struct(F.col(self.column).alias("text"), F.col(self.tag).alias("tag"))

    def _lex(self, c: Column) -> Column:
        if self.kind == "decimal":
            return c.cast("decimal(18,2)").cast("string")
        if self.kind == "dateTime":
            # no fraction if it is zero
            whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
            return F.when(F.date_format(c, "SSSSSS") == "000000", whole).otherwise(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
        return c.cast("string")

    def term(self, raw: Column) -> Column:
        if self.kind == "lang":
            tag = raw["tag"]
            end = F.when(F.length(tag) > 0, F.concat(F.lit('"@'), tag)).otherwise(F.lit('"'))
            return F.concat(F.lit('"'), raw["text"], end)
        return F.concat(F.lit('"'), self._lex(raw), F.lit('"' if self.kind == "plain" else f'"^^<{XSD}{self.kind}>'))

    def match(self, term: str) -> Column | None:
        if not term.startswith('"'):
            return None
        lex, end = term[1 : term.rfind('"')], term[term.rfind('"') + 1 :]
        wanted = {"plain": ""}.get(self.kind, f"^^<{XSD}{self.kind}>")
        if self.kind != "lang" and end != wanted:
            return None
        if self.kind in ("plain", "string"):
            return F.col(self.column) == lex
        if self.kind == "integer":
            digits = lex.removeprefix("-")
            canonical = digits.isdecimal() and digits.isascii() and str(int(lex)) == lex
            return F.col(self.column) == int(lex) if canonical and abs(int(lex)) < 1 << 62 else None
        if self.kind == "lang":
            if end and not end.startswith("@"):
                return None
            tag = F.col(self.tag)
            return (F.col(self.column) == lex) & (F.coalesce(tag, F.lit("")) == end[1:])
        return self.term(self.raw()) == term


@dataclass(frozen=True)
class Branch:
    table: str
    subject: Template
    predicate: str
    object: Template | Literal
    graph: str | None
    #: the subject is a key of the table, so its rows give each quad once
    unique: bool = True

    def determined(self) -> bool:
        """The subject says what the object is, being made of its columns too."""
        return isinstance(self.object, Template) and set(self.object.columns) <= set(self.subject.columns)


@dataclass(frozen=True)
class Variable:
    """What a relation's column holds: keys of a template, raw values of a
    literal's column or of an expression, or (None) term keys."""

    made: object | None = None

    @property
    def template(self) -> Template | None:
        return self.made if isinstance(self.made, Template) else None

    def term(self, raw: Column) -> Column:
        if self.made is None:
            return raw
        return self.made.term(raw)

    def plain(self) -> bool:
        """Different values of the column are different terms."""
        return self.made is None or isinstance(self.made, Template) or isinstance(self.made, Literal) and self.made.kind in ("plain", "string", "integer", "dateTime")

    def same(self, other: Variable) -> bool:
        """The columns hold equal values exactly for equal terms."""
        x, y = self.made, other.made
        if isinstance(x, Template) and isinstance(y, Template):
            return x.same(y)
        return x is None and y is None or isinstance(x, Literal) and isinstance(y, Literal) and x.kind == y.kind and self.plain()


@dataclass
class Relation:
    """Rows with a column per variable. key: variables whose values no two rows
    share, or None if that is not known."""

    df: DataFrame
    variables: dict[str, Variable] = field(default_factory=dict)
    key: frozenset[str] | None = None

    def terms(self) -> DataFrame:
        return self.df.select(*[x.term(F.col(f"`{v}`")).alias(v) for v, x in self.variables.items()])


class MappedQuads(QuadSource):
    """The quads of a list of branches over a folder of tables."""

    def __init__(self, spark: SparkSession, folder: str, branches: list[Branch]):
        self.spark, self.folder, self.branches = spark, folder, branches

    def matching(self, s: str | None, p: str | None, o: str | None, contexts: Iterable[str | None]) -> list[tuple[Branch, list[Column]]]:
        """The branches that can give such quads, with the conditions on their columns."""
        graphs, out = list(contexts), []
        for b in self.branches:
            if (p is not None and b.predicate != p) or (graphs and b.graph not in graphs):
                continue
            found = [m for part, key in ((b.subject, s), (b.object, o)) if key is not None for m in [part.match(key)]]
            if not any(m is None for m in found):
                out.append((b, found))
        return out

    @staticmethod
    def _columns(b: Branch) -> tuple[str, ...]:
        return (*b.subject.columns, *(b.object.columns if isinstance(b.object, Template) else (b.object.column,)))

    def scan(self, s=None, p=None, o=None, contexts=()) -> DataFrame:
        return self._union(self.matching(s, p, o, contexts))

    def _union(self, options: list[tuple[Branch, list[Column]]]) -> DataFrame:
        out = None
        for b, conditions in options:
            made = b.object.term(b.object.key() if isinstance(b.object, Template) else b.object.raw())
            present = [F.col(c).isNotNull() for c in self._columns(b)]
            rows = table(self.spark, self.folder, b.table).where(reduce(Column.__and__, [*present, *conditions])).select(
                b.subject.term(b.subject.key()).alias("s"), F.lit(b.predicate).alias("p"), made.alias("o"), F.lit(b.graph).cast("string").alias("c")
            )
            rows = rows if b.unique else rows.distinct()
            out = rows if out is None else out.unionByName(rows)
        return self.spark.createDataFrame([], SCHEMA) if out is None else out

    def contexts(self) -> DataFrame:
        """A graph is there if one row of one of its branches is: no table is
        read further than that."""
        tests: dict[tuple[str, str], list[Column]] = {}
        for b in self.branches:
            if b.graph is not None:
                tests.setdefault((b.graph, b.table), []).append(reduce(Column.__and__, [F.col(c).isNotNull() for c in self._columns(b)]))
        out = None
        for (graph, name), any_of in tests.items():
            one = table(self.spark, self.folder, name).where(reduce(Column.__or__, any_of)).limit(1).select(F.lit(graph).alias("c"))
            out = one if out is None else out.unionByName(one)
        return self.spark.createDataFrame([], "c string") if out is None else out.distinct()

    def relations(self, patterns: list[tuple[str | None, str, str | None, str | None, str | None]], contexts: list[list[str | None]]) -> list[Relation]:
        """Relations whose join gives the patterns (subject term, subject
        variable, predicate, object term, object variable; one of each pair is
        None), each in its list of contexts.

        A variable can only hold terms that fit the templates of all its
        places, so branches that do not fit are dropped, again and again until
        nothing changes. Patterns left with one branch keep key columns, and
        those with the same subject over a table it is unique in become one
        scan.
        """
        found = [self.matching(s, p, o, graphs) for (s, _, p, o, _), graphs in zip(patterns, contexts)]

        def shape(x: Template | Literal) -> object:
            return (x.prefix, len(x.columns)) if isinstance(x, Template) else "literal"

        while True:
            domains: dict[str, set] = {}
            for (_, sv, _, _, ov), options in zip(patterns, found):
                for v, shapes in ((sv, {shape(b.subject) for b, _ in options}), (ov, {shape(b.object) for b, _ in options})):
                    if v is not None:
                        domains[v] = domains[v] & shapes if v in domains else shapes
            kept = [
                [(b, c) for b, c in options if (sv is None or shape(b.subject) in domains[sv]) and (ov is None or shape(b.object) in domains[ov])]
                for (_, sv, _, _, ov), options in zip(patterns, found)
            ]
            if sum(map(len, kept)) == sum(map(len, found)):
                break
            found = kept
        groups: dict[object, list[int]] = {}
        for i, ((_, sv, _, _, _), options) in enumerate(zip(patterns, found)):
            alone = len(options) != 1 or sv is None or not (options[0][0].unique or options[0][0].determined())
            groups.setdefault(i if alone else (sv, options[0][0].table, options[0][0].subject), []).append(i)
        out = []
        for group in groups.values():
            names = [patterns[group[0]][1], *(patterns[i][4] for i in group)]
            names = [n for n in names if n is not None]
            one_by_one = len(set(names)) < len(names)
            for part in [[i] for i in group] if one_by_one else [group]:
                out.append(self._relation([patterns[i] for i in part], [found[i] for i in part]))
        return out

    def _relation(self, patterns: list, found: list) -> Relation:
        (_, sv, _, _, ov), options = patterns[0], found[0]
        if len(options) != 1 or sv is not None and sv == ov:
            return self._several(sv, ov, options)
        first = options[0][0]
        conditions = [c for option in found for c in option[0][1]]
        needed = sorted({c for option in found for c in self._columns(option[0][0])})
        rows = table(self.spark, self.folder, first.table).where(reduce(Column.__and__, [*[F.col(c).isNotNull() for c in needed], *conditions]))
        variables, columns = {}, []
        if sv is not None:
            variables[sv] = Variable(first.subject)
            columns.append(first.subject.key().alias(sv))
        for (_, _, _, _, v), option in zip(patterns, found):
            if v is not None:
                o = option[0][0].object
                variables[v] = Variable(o)
                columns.append((o.key() if isinstance(o, Template) else o.raw()).alias(v))
        rows = rows.select(*columns)
        key = frozenset({sv}) if sv is not None and first.unique else None
        return Relation(rows if first.unique else rows.distinct(), variables, key)

    def _several(self, sv: str | None, ov: str | None, options: list) -> Relation:
        """One pattern over several branches. A place whose branches all make
        their terms alike keeps the stored values."""
        def alike(x: Template | Literal, y: Template | Literal) -> bool:
            decimals = isinstance(x, Literal) and isinstance(y, Literal) and x.kind == y.kind == "decimal"
            return Variable(x).same(Variable(y)) or decimals and all(b.unique for b, _ in options)

        forms = {}
        for name, made in (("s", [b.subject for b, _ in options]), ("o", [b.object for b, _ in options])):
            forms[name] = made[0] if made and sv != ov and all(alike(made[0], x) for x in made) else None
        out = None
        for b, conditions in options:
            rows = table(self.spark, self.folder, b.table).where(reduce(Column.__and__, [*[F.col(c).isNotNull() for c in self._columns(b)], *conditions]))
            columns = []
            for name, made in (("s", b.subject), ("o", b.object)):
                raw = made.key() if isinstance(made, Template) else made.raw()
                columns.append((raw if forms[name] is not None else made.term(raw)).alias(name))
            rows = rows.select(*columns) if b.unique else rows.select(*columns).distinct()
            out = rows if out is None else out.unionByName(rows)
        out = self.spark.createDataFrame([], "s string, o string") if out is None else out
        if sv is not None and sv == ov:
            out = out.where(F.col("s") == F.col("o"))
        named = {v: c for v, c in ((sv, "s"), (ov, "o")) if v is not None}
        return Relation(out.select(*[F.col(c).alias(v) for v, c in named.items()]), {v: Variable(forms[c]) for v, c in named.items()})


# --------------------------------------------------- mapping of the sample data
BASE = "http://ex.org/"


def ex(name: str) -> str:
    return f"<{BASE}{name}>"


def _branches(of: str, subject: Template, graph: str | None, unique: bool = True, /, **objects: Template | Literal) -> list[Branch]:
    return [Branch(of, subject, ex(p), o, graph, unique) for p, o in objects.items()]


def sample_mapping() -> list[Branch]:
    """Branches over the star-schema tables and the documents."""

    def at(kind: str, *columns: str) -> Template:
        return Template(f"{BASE}{kind}/", columns)

    geo, catalog, sales, text = (ex(f"g/{g}") for g in ("geo", "catalog", "sales", "text"))
    line = at("line", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return [
        *_branches("region", at("region", "r_regionkey"), geo, name=Literal("r_name")),
        *_branches("nation", at("nation", "n_nationkey"), geo, name=Literal("n_name"), region=at("region", "n_regionkey")),
        *_branches(
            "customer", at("customer", "c_custkey"), None,
            name=Literal("c_name"), nation=at("nation", "c_nationkey"), acctbal=Literal("c_acctbal", "decimal"), segment=Literal("c_mktsegment", "string"),
        ),
        *_branches("supplier", at("supplier", "s_suppkey"), catalog, name=Literal("s_name"), nation=at("nation", "s_nationkey"), acctbal=Literal("s_acctbal", "decimal")),
        *_branches(
            "part", at("part", "p_partkey"), catalog,
            name=Literal("p_name"), brand=Literal("p_brand"), type=Literal("p_type"), size=Literal("p_size", "integer"), price=Literal("p_retailprice", "decimal"),
        ),
        *_branches(
            "orders", at("order", "o_orderkey"), sales,
            customer=at("customer", "o_custkey"), status=Literal("o_orderstatus"), priority=Literal("o_orderpriority"),
            total=Literal("o_totalprice", "decimal"), date=Literal("o_orderdate", "dateTime"),
        ),
        *_branches(
            "lineitem", line, sales, False,
            order=at("order", "l_orderkey"), part=at("part", "l_partkey"), supplier=at("supplier", "l_suppkey"), quantity=Literal("l_quantity", "decimal"),
            price=Literal("l_extendedprice", "decimal"), discount=Literal("l_discount", "decimal"), tax=Literal("l_tax", "decimal"),
            returnflag=Literal("l_returnflag"), shipdate=Literal("l_shipdate", "dateTime"),
        ),
        *_branches(
            "events", at("event", "event_id"), "_:events",
            user=at("user", "user_id"), kind=Literal("event_type"), value=Literal("value", "decimal"), at=Literal("ts", "dateTime"), props=Literal("props"),
        ),
        *_branches(
            "documents", at("doc", "doc_id"), text,
            text=Literal("text", "lang", "lang"), source=Literal("source"), chars=Literal("n_chars", "integer"), repo=Literal("repo"), path=Literal("path"), licence=Literal("licence_file"),
        ),
        *_branches("embeddings", at("vec", "vec_id"), catalog, label=Literal("label", "integer")),
    ]


def sample_quads(spark: SparkSession, folder: str) -> MappedQuads:
    return MappedQuads(spark, folder, sample_mapping())
