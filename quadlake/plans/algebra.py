"""Graph-pattern algebra: what the compiler turns into DataFrame operations.

Positions of a pattern hold a ``Var`` or a term key. Expressions are the
classes of the second half.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Var:
    name: str


Position = Var | str


class Node:
    """A graph pattern or solution modifier."""


@dataclass(frozen=True)
class Dataset:
    """Graphs of FROM and FROM NAMED; empty default is the whole store."""

    default: tuple[str | None, ...] = ()
    named: tuple[str, ...] = ()


@dataclass(frozen=True)
class Pattern:
    """One quad pattern. graph: None for the dataset's default graphs, a term
    key for one named graph, a Var for all named graphs."""

    s: Position
    p: Position
    o: Position
    graph: Position | None = None


@dataclass(frozen=True)
class BGP(Node):
    patterns: tuple[Pattern, ...]


@dataclass(frozen=True)
class Join(Node):
    left: Node
    right: Node


@dataclass(frozen=True)
class LeftJoin(Node):
    left: Node
    right: Node
    condition: Expr | None = None


@dataclass(frozen=True)
class Union(Node):
    left: Node
    right: Node


@dataclass(frozen=True)
class Minus(Node):
    left: Node
    right: Node


@dataclass(frozen=True)
class SemiJoin(Node):
    """Solutions of left with (or, negated, without) a compatible one of right."""

    left: Node
    right: Node
    negated: bool = False


@dataclass(frozen=True)
class Filter(Node):
    child: Node
    condition: Expr


@dataclass(frozen=True)
class Extend(Node):
    child: Node
    var: str
    expr: Expr


@dataclass(frozen=True)
class Values(Node):
    variables: tuple[str, ...]
    rows: tuple[tuple[str | None, ...], ...]


@dataclass(frozen=True)
class Aggregate:
    """function: count, sum, avg, min, max, sample; expr None is count(*)."""

    function: str
    expr: Expr | None
    distinct: bool = False


@dataclass(frozen=True)
class Group(Node):
    child: Node
    keys: tuple[tuple[str, Expr], ...]
    aggregates: tuple[tuple[str, Aggregate], ...]


@dataclass(frozen=True)
class Project(Node):
    child: Node
    variables: tuple[str, ...]


@dataclass(frozen=True)
class Distinct(Node):
    child: Node


@dataclass(frozen=True)
class Reduced(Node):
    child: Node


@dataclass(frozen=True)
class Intersect(Node):
    """Solutions (as sets of bindings of the same variables) of both sides."""

    left: Node
    right: Node


@dataclass(frozen=True)
class OrderBy(Node):
    child: Node
    keys: tuple[tuple[Expr, bool], ...]  # expression, descending


@dataclass(frozen=True)
class Slice(Node):
    child: Node
    limit: int | None = None
    offset: int = 0


@dataclass(frozen=True)
class Ask(Node):
    child: Node


@dataclass(frozen=True)
class Construct(Node):
    child: Node
    template: tuple[tuple[Position, Position, Position], ...]


@dataclass(frozen=True)
class Query:
    node: Node
    dataset: Dataset = field(default_factory=Dataset)


# ------------------------------------------------------------------ expressions
class Expr:
    """A value expression."""


@dataclass(frozen=True)
class Ref(Expr):
    name: str


@dataclass(frozen=True)
class Const(Expr):
    """A term key."""

    key: str


@dataclass(frozen=True)
class Call(Expr):
    """An operator or function by lower-case name."""

    name: str
    args: tuple[Expr, ...]


def call(name: str, *args: Expr) -> Call:
    return Call(name, args)
