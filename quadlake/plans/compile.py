"""From algebra to DataFrames.

A solution variable is a nullable column. It holds what the value was found or
computed as (key columns, stored numbers and texts, counts) together with what
that is; columns become term keys where two sides hold different things, and at
the end. The compiler tracks which variables are certainly bound: joins on those
are plain equality joins, and only a variable that may be unbound on either side
uses the compatible-mapping condition, inside a join that hashes on the others
or, where there are no others, apart for bound and unbound rows.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadlake.operators.skew import join_pairs
from quadlake.plans import algebra as A
from quadlake.plans.expr import Value, compile_expr, mapped, order_columns
from quadlake.sources.mapping import Literal, MappedQuads, Relation, Variable
from quadlake.sources.quads import QuadSource

_fresh = count()


class _Scope(dict):
    """Values by variable, each made when it is first asked for."""

    def __init__(self, given: dict[str, Value], variables: dict[str, Variable]):
        super().__init__(given)
        self.variables = variables

    def __missing__(self, v: str) -> Value:
        self[v] = out = mapped(self.variables[v], F.col(f"`{v}`"))
        return out

    def __contains__(self, v: object) -> bool:
        return v in self.variables or super().__contains__(v)

    def get(self, v: str, default: Value | None = None) -> Value | None:
        return self[v] if v in self else default

    def names(self) -> list[str]:
        return sorted({*self.variables, *self.keys()})


@dataclass
class Solutions:
    """df has the columns of ``variables``, which say what each holds;
    ``certain`` are never null; ``key`` as in Relation."""

    df: DataFrame
    variables: dict[str, Variable]
    certain: frozenset[str]
    key: frozenset[str] | None = None

    def values(self, given: dict[str, Value] | None = None) -> _Scope:
        return _Scope({n: x for n, x in (given or {}).items() if n not in self.variables}, self.variables)

    def as_terms(self, *names: str) -> Solutions:
        """The same with these variables (or all) as term keys."""
        wanted = set(names or self.variables)
        if not any(x.made is not None for v, x in self.variables.items() if v in wanted):
            return self
        df = self.df.select(*[(x.term(F.col(f"`{v}`")) if v in wanted else F.col(f"`{v}`")).alias(v) for v, x in self.variables.items()])
        return Solutions(df, {v: Variable() if v in wanted else x for v, x in self.variables.items()}, self.certain, self.key)

    def distinct_columns(self) -> Solutions:
        """The same with columns whose different values are different terms."""
        rest = [v for v, x in self.variables.items() if not x.plain()]
        return self.as_terms(*rest) if rest else self


def _aligned(a: Solutions, b: Solutions) -> tuple[Solutions, Solutions]:
    """Both with the same kind of column for each shared variable."""
    other = [v for v, x in a.variables.items() if v in b.variables and not x.same(b.variables[v])]
    return (a.as_terms(*other), b.as_terms(*other)) if other else (a, b)


def _makes_pairs(a: Relation | Solutions, b: Relation | Solutions) -> bool:
    """Whether neither side has its key among the variables that both have."""
    shared = a.variables.keys() & b.variables.keys()
    return bool(shared) and a.key is not None and b.key is not None and not a.key <= shared and not b.key <= shared


def _inner(a: Relation | Solutions, b: Relation | Solutions, left: DataFrame, right: DataFrame, shared: list[str]) -> tuple[DataFrame, frozenset[str] | None]:
    """The equality join of both sides' rows, with the key of its rows."""
    if not shared:
        return left.crossJoin(right), None
    if _makes_pairs(a, b):
        return join_pairs(left, right, shared), a.key | b.key
    key = None if a.key is None or b.key is None else a.key if b.key <= set(shared) else b.key
    return left.join(right, shared, "inner"), key


def _mentioned(e: A.Expr) -> set[str]:
    return {e.name} if isinstance(e, A.Ref) else set().union(*map(_mentioned, e.args)) if isinstance(e, A.Call) else set()


def _rename(s: Solutions) -> tuple[DataFrame, dict[str, str]]:
    names = {v: f"_{v}_{next(_fresh)}" for v in s.variables}
    return s.df.select(*[F.col(f"`{v}`").alias(n) for v, n in names.items()]), names


class Compiler:
    """Compiles queries against one source.

    bindings replace variables by terms before evaluation and show up in the
    result as constant columns.
    """

    def __init__(self, source: QuadSource, dataset: A.Dataset | None = None, bindings: dict[str, str] | None = None):
        self.source, self.dataset, self.bindings = source, dataset or A.Dataset(), dict(bindings or {})
        #: the join whose rows are only filtered and shown, and the variables that are only shown
        self.last: tuple[A.Node | None, set[str]] = (None, set())

    def run(self, node: A.Node) -> DataFrame:
        if isinstance(node, A.Ask):
            found = self.compile(node.child).df.select(F.lit(1).alias("x")).limit(1)
            return found.agg((F.count("x") > 0).alias("answer"))
        if isinstance(node, A.Construct):
            return self._construct(node)
        if isinstance(node, A.Project):
            child, shown = node.child, set(node.variables)
            while isinstance(child, A.Filter):
                child, shown = child.child, shown - _mentioned(child.condition)
            self.last = (child, shown)
        return self.compile(node).as_terms().df

    def compile(self, node: A.Node) -> Solutions:
        return getattr(self, "_" + type(node).__name__.lower())(node)

    # ------------------------------------------------------------------ patterns
    def _place(self, x: A.Position | None) -> A.Position | None:
        return self.bindings.get(x.name, x) if isinstance(x, A.Var) else x

    def _contexts(self, graph: A.Position | None) -> list[str | None] | None:
        """Graphs to scan; None if there is none at all."""
        if graph is None:
            if not self.dataset.default and self.dataset.named:
                return None  # FROM NAMED alone leaves the default graph empty
            return list(self.dataset.default)
        named = list(self.dataset.named)
        if isinstance(graph, str):
            return [graph] if not (named or self.dataset.default) or graph in named else None
        return named if named or not self.dataset.default else None

    def pattern(self, p: A.Pattern) -> Relation:
        """The solutions of one pattern; a variable used twice must be equal."""
        s, pr, o, g = (self._place(x) for x in (p.s, p.p, p.o, p.graph))
        contexts = self._contexts(g)
        keys = [x if isinstance(x, str) else None for x in (s, pr, o)]
        legal = all(k is None or k[0] in allowed for k, allowed in zip(keys, ("<_", "<", '<_"')))
        if contexts is None or not legal:
            rows = self.source.scan("_:nothing", "_:nothing", "_:nothing")
        else:
            rows = self.source.scan(*keys, contexts)
        if isinstance(g, A.Var):
            rows = rows.where(F.col("c").isNotNull())
        places: dict[str, str] = {}
        for column, x in zip(("s", "p", "o", "c"), (s, pr, o, g)):
            if isinstance(x, A.Var):
                if x.name in places:
                    rows = rows.where(F.col(column) == F.col(places[x.name]))
                else:
                    places[x.name] = column
        given = [F.lit(v).alias(n) for n, v in self.bindings.items() if A.Var(n) in (p.s, p.p, p.o, p.graph)]
        rows = rows.select(*[F.col(c).alias(v) for v, c in places.items()], *given)
        return Relation(rows, {v: Variable() for v in rows.columns})

    def _relations(self, patterns: tuple[A.Pattern, ...]) -> list[Relation]:
        """A relation for each pattern; a mapped source plans those with a given
        predicate, and a given or no graph, together."""
        rest, mapped, graphs = list(patterns), [], []
        if isinstance(self.source, MappedQuads):
            for p in patterns:
                free = not {x.name for x in (p.s, p.o) if isinstance(x, A.Var)} & set(self.bindings)
                contexts = None if isinstance(p.graph, A.Var) else self._contexts(p.graph)
                if isinstance(p.p, str) and contexts is not None and free:
                    rest.remove(p)
                    graphs.append(contexts)
                    mapped.append((*((None, x.name) if isinstance(x, A.Var) else (x, None) for x in (p.s, p.o)), p.p))
        plain = [(s, sv, p, o, ov) for (s, sv), (o, ov), p in mapped]
        return [*(self.source.relations(plain, graphs) if plain else []), *(self.pattern(p) for p in rest)]

    def _bgp_relation(self, node: A.BGP) -> Relation:
        """Patterns are joined in an order that never leaves the connected part
        while there is a way on; without one the sides are put side by side."""
        parts = self._relations(node.patterns)
        whole = parts.pop(0)
        while parts:
            near = next((x for x in parts if set(x.variables) & set(whole.variables)), parts[0])
            parts.remove(near)
            whole = self._join_relations(whole, near)
        return whole

    def _env(self, s: Solutions) -> _Scope:
        """The values in scope: bindings given from outside, and the variables."""
        return s.values({n: Value(key=F.lit(v), const=v) for n, v in self.bindings.items()})

    def _bgp(self, node: A.BGP) -> Solutions:
        if not node.patterns:
            return Solutions(self._spark().range(1).select(), {}, frozenset())
        whole = self._bgp_relation(node)
        return Solutions(whole.df, dict(whole.variables), frozenset(whole.variables), whole.key)

    def _join_relations(self, a: Relation, b: Relation) -> Relation:
        shared = [v for v in a.variables if v in b.variables]
        left, right = a.df, b.df
        variables = dict(a.variables)
        for v in shared:
            x, y = a.variables[v], b.variables[v]
            if x.same(y):
                continue
            # different templates, decimals and tagged texts, or terms on one side only: compare the terms
            left, right, variables[v] = left.withColumn(v, x.term(F.col(f"`{v}`"))), right.withColumn(v, y.term(F.col(f"`{v}`"))), Variable()
        joined, key = _inner(a, b, left, right, shared)
        return Relation(joined, variables | {v: x for v, x in b.variables.items() if v not in variables}, key)

    def _spark(self) -> SparkSession:
        return SparkSession.getActiveSession()

    # --------------------------------------------------------------------- joins
    def _match(self, a: Solutions, b: Solutions) -> tuple[DataFrame, dict[str, str], list[Column]]:
        right, names = _rename(b)
        on = []
        for v in a.variables:
            if v in names:
                same = F.col(f"`{v}`") == F.col(f"`{names[v]}`")
                if v not in a.certain:
                    same = same | F.col(f"`{v}`").isNull()
                if v not in b.certain:
                    same = same | F.col(f"`{names[v]}`").isNull()
                on.append(same)
        return right, names, on

    def _merged(self, a: Solutions, b: Solutions, names: dict[str, str], df: DataFrame) -> Solutions:
        columns = []
        for v in a.variables:
            own = F.col(f"`{v}`")
            columns.append((F.coalesce(own, F.col(f"`{names[v]}`")) if v in names and v not in a.certain else own).alias(v))
        columns += [F.col(f"`{n}`").alias(v) for v, n in names.items() if v not in a.variables]
        return Solutions(df.select(*columns), {**b.variables, **a.variables}, a.certain)

    def _join(self, node: A.Join) -> Solutions:
        a, b = self.compile(node.left), self.compile(node.right)
        last, shown = self.last
        if node is last and _makes_pairs(a, b):  # what is only shown becomes terms once a row, not once a pair
            shown = shown - (a.variables.keys() & b.variables.keys())
            a, b = (s.as_terms(*own) if (own := shown & s.variables.keys()) else s for s in (a, b))
        return self._joined(a, b)

    def _joined(self, a: Solutions, b: Solutions) -> Solutions:
        a, b = _aligned(a, b)
        shared = [v for v in a.variables if v in b.variables]
        loose = [v for v in shared if v not in a.certain or v not in b.certain]
        certain = a.certain | b.certain
        if not loose:
            df, key = _inner(a, b, a.df, b.df, shared)
            return Solutions(df, {v: ({**b.variables, **a.variables})[v] for v in df.columns}, certain, key)
        if len(loose) < len(shared):
            right, names, on = self._match(a, b)
            out = self._merged(a, b, names, a.df.join(right, reduce(Column.__and__, on)))
            return Solutions(out.df, out.variables, certain)
        # no variable is bound on both sides for certain: rows that bind the first one meet
        # by equality, and only rows that leave it open meet all rows of the other side
        v, parts = loose[0], []
        for x_bound, y_bound in ((True, True), (False, None), (True, False)):
            x, y = self._bound_part(a, v, x_bound), self._bound_part(b, v, y_bound)
            if x is not None and y is not None:
                parts.append(self._joined(x, y))
        names = list({**a.variables, **b.variables})
        df = reduce(DataFrame.unionByName, [p.df.select(*[F.col(f"`{n}`") for n in names]) for p in parts])
        return Solutions(df, {n: parts[0].variables[n] for n in names}, certain)

    @staticmethod
    def _bound_part(s: Solutions, v: str, bound: bool | None) -> Solutions | None:
        """The rows that bind a variable, or those that do not, without it; None
        for no rows at all, and bound None for all rows."""
        if bound is None:
            return s
        if bound:
            return Solutions(s.df.where(F.col(f"`{v}`").isNotNull()), s.variables, s.certain | {v})
        if v in s.certain:
            return None
        return Solutions(s.df.where(F.col(f"`{v}`").isNull()).drop(v), {n: x for n, x in s.variables.items() if n != v}, s.certain)

    def _leftjoin(self, node: A.LeftJoin) -> Solutions:
        a, b = _aligned(self.compile(node.left), self.compile(node.right))
        right, names, on = self._match(a, b)
        if node.condition is not None:
            env = a.values()
            for v, n in names.items():
                if v not in a.certain:
                    other = F.col(f"`{n}`")
                    env[v] = mapped(b.variables[v], F.coalesce(F.col(f"`{v}`"), other) if v in env else other)
            on.append(F.coalesce(compile_expr(node.condition, env).truth(), F.lit(False)))
        df = a.df.join(right, reduce(Column.__and__, on) if on else F.lit(True), "left")
        return self._merged(a, b, names, df)

    def _semijoin(self, node: A.SemiJoin) -> Solutions:
        a, b = _aligned(self.compile(node.left), self.compile(node.right))
        right, _, on = self._match(a, b)
        df = a.df.join(right, reduce(Column.__and__, on) if on else F.lit(True), "left_anti" if node.negated else "left_semi")
        return Solutions(df, a.variables, a.certain)

    def _minus(self, node: A.Minus) -> Solutions:
        a, b = _aligned(self.compile(node.left), self.compile(node.right))
        shared = [v for v in a.variables if v in b.variables]
        if not shared:
            return a
        right, names, on = self._match(a, b)
        if not any(v in a.certain and v in b.certain for v in shared):
            both = [F.col(f"`{v}`").isNotNull() & F.col(f"`{names[v]}`").isNotNull() for v in shared]
            on.append(reduce(Column.__or__, both))  # at least one variable in common
        return Solutions(a.df.join(right, reduce(Column.__and__, on), "left_anti"), a.variables, a.certain)

    def _union(self, node: A.Union) -> Solutions:
        a, b = _aligned(self.compile(node.left), self.compile(node.right))
        return Solutions(a.df.unionByName(b.df, allowMissingColumns=True), {**a.variables, **b.variables}, a.certain & b.certain)

    def _intersect(self, node: A.Intersect) -> Solutions:
        a, b = _aligned(self.compile(node.left).distinct_columns(), self.compile(node.right).distinct_columns())
        df = a.df.intersect(b.df.select(*[F.col(f"`{v}`") for v in a.variables]))
        return Solutions(df, a.variables, a.certain | b.certain)

    # ------------------------------------------------------- filters and columns
    def _filter(self, node: A.Filter) -> Solutions:
        child = self.compile(node.child)
        return Solutions(child.df.where(compile_expr(node.condition, self._env(child)).truth()), child.variables, child.certain)

    def _extend(self, node: A.Extend) -> Solutions:
        child = self.compile(node.child)
        column, variable = compile_expr(node.expr, self._env(child)).held()
        certain = child.certain | {node.var} if isinstance(node.expr, A.Const) or isinstance(node.expr, A.Ref) and node.expr.name in child.certain else child.certain
        return Solutions(child.df.withColumn(node.var, column), {**child.variables, node.var: variable}, certain)

    def _values(self, node: A.Values) -> Solutions:
        schema = ", ".join(f"`{v}` string" for v in node.variables)
        df = self._spark().createDataFrame([tuple(r) for r in node.rows], schema)
        certain = {v for i, v in enumerate(node.variables) if all(r[i] is not None for r in node.rows)}
        return Solutions(df, {v: Variable() for v in node.variables}, frozenset(certain))

    def _project(self, node: A.Project) -> Solutions:
        child = self.compile(node.child)
        known = child.variables
        missing = {v: F.lit(self.bindings.get(v)).cast("string") for v in node.variables if v not in known}
        df = child.df.select(*[F.col(f"`{v}`") if v in known else missing[v].alias(v) for v in node.variables])
        return Solutions(df, {v: known.get(v, Variable()) for v in node.variables}, child.certain & set(node.variables))

    def _distinct(self, node: A.Distinct | A.Reduced) -> Solutions:
        child = self.compile(node.child).distinct_columns()
        return Solutions(child.df.distinct(), child.variables, child.certain)

    _reduced = _distinct

    def _orderby(self, node: A.OrderBy) -> Solutions:
        child = self.compile(node.child)
        env = self._env(child)
        keys = [c for e, down in node.keys for c in order_columns(compile_expr(e, env), down)]
        return Solutions(child.df.orderBy(*keys), child.variables, child.certain)

    def _slice(self, node: A.Slice) -> Solutions:
        child = self.compile(node.child)
        df = child.df.offset(node.offset) if node.offset else child.df
        return Solutions(df if node.limit is None else df.limit(node.limit), child.variables, child.certain)

    # --------------------------------------------------------------- aggregation
    def _group(self, node: A.Group) -> Solutions:
        child = self.compile(node.child)
        env = self._env(child)
        keys, variables = [], {}
        for v, e in node.keys:
            column, held = compile_expr(e, env).held()
            variables[v] = held if held.plain() else Variable()
            keys.append((column if held.plain() else held.term(column)).alias(v))
        made = [(v, *self._aggregate(a, env)) for v, a in node.aggregates]
        df = child.df.groupBy(*keys).agg(*[c.alias(f"{v}#{i}") for v, columns, _ in made for i, c in enumerate(columns)] or [F.lit(0).alias("_")])
        out = [F.col(f"`{v}`") for v, _ in node.keys]
        for v, columns, finish in made:
            column, variables[v] = finish(*[F.col(f"`{v}#{i}`") for i in range(len(columns))]).held()
            out.append(column.alias(v))
        certain = {v for v, e in node.keys if isinstance(e, A.Ref) and e.name in child.certain} | {v for v, a in node.aggregates if a.function == "count"}
        return Solutions(df.select(*out), variables, frozenset(certain))

    def _aggregate(self, a: A.Aggregate, env: _Scope):
        """Columns to aggregate, and what makes the value of them. A number that
        is no number makes sum and avg an error."""

        def integer(n: Column) -> Value:
            return Value(long_=n)

        if a.expr is None:
            counted = F.count_distinct(F.struct(*[env[v].term().alias(v) for v in env.names()])) if a.distinct else F.count(F.lit(1))
            return [counted], integer
        v = compile_expr(a.expr, env)
        raw, held = v.held()
        one = raw if held.plain() else v.term()
        if a.function == "count":
            return [F.count_distinct(one) if a.distinct else F.count(one)], integer
        if a.function == "sample":
            return [F.min(v.term())], lambda x: Value(key=x)
        if a.function in ("min", "max"):
            smallest = F.min if a.function == "min" else F.max
            if v.known in ("number", "moment") and isinstance(held.made, Literal):
                return [smallest(raw)], lambda x: mapped(held, x)  # ordered as stored
            t = v.term()
            kind = F.when(v.double().isNotNull(), 0).when(v.moment().isNotNull(), 1).otherwise(2)
            key = F.when(t.isNotNull(), F.struct(kind.alias("k"), v.double().alias("d"), v.moment().alias("m"), t.alias("t")))
            return [smallest(key)], lambda x: Value(key=x["t"])
        add = F.sum_distinct if a.distinct else F.sum
        n = F.count_distinct(v.double()) if a.distinct else F.count(v.double())
        none = F.lit(0).cast("bigint")
        if v.known == "number":  # nothing else can be there
            exact = v.long_.cast("decimal(20,0)") if v.long_ is not None else v.exact()
            columns = [add(exact), n]

            def finish_known(total, n):
                return self._total(a, F.coalesce(total, F.lit(0)), total.cast("double"), n, none, none, F.lit(v.long_ is not None))

            return columns, finish_known
        bad = F.count(F.when(v.bound() & v.double().isNull(), 1))
        floating = F.count(F.when(v.double().isNotNull() & v.exact().isNull(), 1))
        fractional = F.count(F.when(~v.is_integer(), 1))
        columns = [add(v.exact()), add(v.double()), n, bad, floating, fractional]
        return columns, lambda exact, double, n, bad, floating, fractional: self._total(a, exact, double, n, bad, floating, fractional == 0)

    @staticmethod
    def _total(a: A.Aggregate, exact: Column, double: Column, n: Column, bad: Column, floating: Column, whole: Column) -> Value:
        total = F.when(floating == 0, F.coalesce(exact, F.lit(0)).cast("decimal(38,10)"))
        if a.function == "avg":
            total, double, whole = F.when(n > 0, F.try_divide(total, n)).otherwise(total), F.try_divide(double, n), F.lit(False)
        total = F.when(bad == 0, total.cast("decimal(38,10)"))
        double = F.when(bad == 0, F.coalesce(F.when(floating == 0, total.cast("double")), double))
        return Value(exact_=total, double_=double, integer=whole)

    # ----------------------------------------------------------------- construct
    def _construct(self, node: A.Construct) -> DataFrame:
        """The triples of the template, as a set; incomplete or illegal ones
        are left out, blank nodes of the template are new for each
        solution and each query."""
        child = self.compile(node.child)
        df = child.df.withColumn("_row", F.monotonically_increasing_id()) if any(isinstance(x, str) and x.startswith("_:") for t in node.template for x in t) else child.df
        env, run = child.values(), uuid.uuid4().hex

        def at(x: A.Position) -> Column:
            if isinstance(x, A.Var):
                return env[x.name].term() if x.name in env else F.lit(self.bindings.get(x.name)).cast("string")
            if x.startswith("_:"):
                return F.concat(F.lit(f"{x}-{run}-"), F.col("_row").cast("string"))
            return F.lit(x)

        made = F.array(*[F.struct(*[at(x).alias(n) for n, x in zip("spo", t)]) for t in node.template])
        rows = df.select(F.explode(made).alias("_t")).select("_t.s", "_t.p", "_t.o").dropna()
        return rows.where((F.substring("s", 1, 1) != '"') & (F.substring("p", 1, 1) == "<")).distinct()


def execute(source: QuadSource, query: A.Query | A.Node, bindings: dict[str, str] | None = None) -> DataFrame:
    """The solutions of a query: a column of term keys for each variable, one
    row ``answer`` for Ask, s, p, o for Construct."""
    q = query if isinstance(query, A.Query) else A.Query(query)
    return Compiler(source, q.dataset, bindings).run(q.node)
