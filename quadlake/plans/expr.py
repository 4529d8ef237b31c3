"""Value expressions as Columns.

A value is held as a term key, a truth value or a number, whichever it was
computed as, and turned into another form only when one is asked for. An error
is null in every form, so SQL's three-valued AND, OR and NOT give the error
table of the query language.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace
from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadlake.functions import lexical, terms
from quadlake.functions.terms import XSD
from quadlake.plans import algebra as A
from quadlake.sources.mapping import Literal, Template, Variable

#: Datatypes of exact and of floating numbers.
INTEGERS = "integer nonPositiveInteger negativeInteger long int short byte nonNegativeInteger unsignedLong unsignedInt unsignedShort unsignedByte positiveInteger".split()
EXACT = ["decimal", *INTEGERS]
FLOATING = ["double", "float"]
_DECIMAL = "decimal(38,10)"
#: Lexical forms; a cast alone would also take what other notations allow.
_FORMS = {"integer": lexical.INTEGER, "decimal": lexical.DECIMAL, "double": lexical.DOUBLE}
_TRUE, _FALSE = f'"true"^^<{XSD}boolean>', f'"false"^^<{XSD}boolean>'


def _trim(x: Column) -> Column:
    """Without outer white space of XML Schema."""
    return F.btrim(x, F.lit(" \t\r\n"))


def _types(names: list[str]) -> list[str]:
    return [f"^^<{XSD}{n}>" for n in names]


@dataclass(frozen=True)
class Computed:
    """What a column made of an expression holds: a number as a struct of exact
    and floating value and whether it is an integer, or a truth value."""

    kind: str

    def term(self, raw: Column) -> Column:
        return self.value(raw).term()

    def value(self, raw: Column) -> Value:
        if self.kind == "boolean":
            return Value(bool_=raw)
        return Value(exact_=raw["exact"], double_=raw["double"], integer=raw["integer"])


@dataclass
class Value:
    """One of term, truth and number (an exact and a floating Column).

    known: the sort the value has if it is not null (number, moment, text,
    tagged, boolean, resource or other), where that is certain before it runs;
    then only the forms given exist, and nothing is decoded from the key.
    """

    key: Column | None = None
    bool_: Column | None = None
    exact_: Column | None = None
    double_: Column | None = None
    integer: Column | None = None
    #: an integer of 64 bits
    long_: Column | None = None
    #: a number that is always exact, as its column stores it
    stored: Column | None = None
    #: a dateTime as timestamp_ntz in UTC
    ntz: Column | None = None
    text_: Column | None = None
    #: the language tag of a literal whose label is text_; null or empty: none
    tag: Column | None = None
    #: of the text of a language tag: the column that stores it
    stored_tag: Column | None = None
    known: str | None = None
    #: the key, if it is constant
    const: str | None = None
    #: the column the value is held in, and what that column holds
    raw: Column | None = None
    variable: Variable | None = None

    def __post_init__(self) -> None:
        if self.long_ is not None:
            self.exact_, self.double_, self.integer, self.known = self.long_.cast(_DECIMAL), self.long_.cast("double"), F.lit(True), "number"
            self.stored = self.long_

    def _decodes(self) -> bool:
        return self.key is not None and self.known is None

    def held(self) -> tuple[Column, Variable]:
        """A column that holds the value with as little work as it needs, and
        what the column holds."""
        if self.raw is not None:
            return self.raw, self.variable
        if self.long_ is not None:
            return self.long_, Variable(Literal("", "integer"))
        if self.bool_ is not None:
            return self.bool_, Variable(Computed("boolean"))
        if self.key is None:
            number = F.struct(self.exact_.cast(_DECIMAL).alias("exact"), self.double_.cast("double").alias("double"), self.integer.alias("integer"))
            return F.when(self.double_.isNotNull(), number), Variable(Computed("number"))
        if self.known == "text":
            return self.text_, Variable(Literal("", "plain"))
        return self.key, Variable()

    def bound(self) -> Column:
        """Whether there is a value: neither unbound nor an error."""
        return self.held()[0].isNotNull()

    # --------------------------------------------------------------- as a term
    def term(self) -> Column:
        if self.key is not None:
            return self.key
        if self.variable is not None:
            return self.variable.term(self.raw)
        if self.bool_ is not None:
            return F.when(self.bool_, _TRUE).when(~self.bool_, _FALSE)
        if self.long_ is not None:
            return F.concat(F.lit('"'), self.long_.cast("string"), F.lit(f'"^^<{XSD}integer>'))
        whole = F.concat(F.lit('"'), self.exact_.cast("decimal(38,0)").cast("string"), F.lit(f'"^^<{XSD}integer>'))
        text = F.regexp_replace(self.exact_.cast("string"), r"\.?0+$", "")
        text = F.when(self.exact_.cast("string").contains("."), text).otherwise(self.exact_.cast("string"))
        exact = F.when(self.integer, whole).otherwise(F.concat(F.lit('"'), text, F.lit(f'"^^<{XSD}decimal>')))
        return F.coalesce(exact, F.concat(F.lit('"'), self.double_.cast("string"), F.lit(f'"^^<{XSD}double>')))

    # ------------------------------------------------------------- typed forms
    def exact(self) -> Column:
        if self._decodes():
            end, lex = terms.suffix(self.key), _trim(terms.lex(self.key))
            fits = end.isin(*_types(INTEGERS)) & lex.rlike(_FORMS["integer"]) | (end == _types(["decimal"])[0]) & lex.rlike(_FORMS["decimal"])
            return F.when(fits, lex.try_cast(_DECIMAL))
        return F.lit(None).cast(_DECIMAL) if self.exact_ is None else self.exact_

    def double(self) -> Column:
        if self._decodes():
            end, lex = terms.suffix(self.key), _trim(terms.lex(self.key))
            special = F.when(lex == "INF", float("inf")).when(lex == "-INF", float("-inf")).when(lex == "NaN", float("nan"))
            floating = F.coalesce(special, F.when(lex.rlike(_FORMS["double"]), lex.try_cast("double")))
            plain = F.when(lex.rlike(_FORMS["decimal"]), lex.try_cast("double"))
            return F.when(end.isin(*_types(FLOATING)), floating).when(end.isin(*_types(EXACT)), plain)
        return F.lit(None).cast("double") if self.double_ is None else self.double_

    def sort(self) -> str | None:
        if self.known is not None:
            return self.known
        if self.const is None:
            return "boolean" if self.bool_ is not None else "number" if self.double_ is not None else None
        t = terms.decode(self.const)
        if t.kind != "literal":
            return "resource"
        name = (t.datatype or XSD + "string").removeprefix(XSD)
        if t.language or name == "string":
            return None if t.language else "text"
        return "number" if name in EXACT + FLOATING else {"boolean": "boolean", "dateTime": "moment"}.get(name)

    def is_integer(self) -> Column:
        if self._decodes():
            return terms.suffix(self.key).isin(*_types(INTEGERS))
        return F.lit(False) if self.integer is None else self.integer

    def boolean(self) -> Column:
        """The value of a boolean literal; null for all else."""
        if self.bool_ is not None:
            return self.bool_
        if not self._decodes():
            return F.lit(None).cast("boolean")
        lex = _trim(terms.lex(self.key))
        return F.when(terms.suffix(self.key) == f"^^<{XSD}boolean>", F.when(lex.isin("true", "1"), True).when(lex.isin("false", "0"), False))

    def moment(self) -> Column:
        """The instant of an xsd:dateTime in microseconds; UTC if it has no zone."""
        if self.ntz is not None:
            return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), self.ntz)
        if not self._decodes():
            return F.lit(None).cast("bigint")
        lex = _trim(terms.lex(self.key))
        zoned = F.when(lex.rlike(r"(Z|[+-]\d{2}:\d{2})$"), lex).otherwise(F.concat(lex, F.lit("Z")))
        return F.when((terms.suffix(self.key) == f"^^<{XSD}dateTime>") & lex.rlike(r"^\d{4}-\d{2}-\d{2}T"), F.unix_micros(zoned.try_cast("timestamp")))

    def text(self) -> Column:
        """The label of a plain or xsd:string literal."""
        if self.tag is not None:
            return F.when(F.coalesce(F.length(self.tag), F.lit(0)) == 0, self.text_)
        if self.text_ is not None:
            return self.text_
        if not self._decodes():
            return F.lit(None).cast("string")
        return F.when(terms.suffix(self.key).isin("", f"^^<{XSD}string>"), terms.lex(self.key))

    def label(self) -> Column:
        """The label of a literal with or without language tag, for string functions."""
        return self.text_ if self.text_ is not None else terms.lex(self.term())

    def language(self) -> Column:
        """The tag of a literal, '' without one; null for other terms."""
        if self.tag is not None:
            return F.when(self.text_.isNotNull(), F.coalesce(self.tag, F.lit("")))
        if self.known in ("text", "number", "moment"):
            return F.when(self.bound(), F.lit(""))
        return terms.language(self.term())

    def truth(self) -> Column:
        """Effective boolean value; an invalid boolean or number is false."""
        if self.bool_ is not None:
            return self.bool_
        if self.text_ is not None:
            return F.length(self.text()) > 0
        if self.double_ is not None:
            d = self.double()
            return (d != 0) & ~F.isnan(d)
        end = terms.suffix(self.key)
        d = self.double()
        return (
            F.when(end == f"^^<{XSD}boolean>", F.coalesce(self.boolean(), F.lit(False)))
            .when(end.isin(*_types(EXACT + FLOATING)), F.coalesce((d != 0) & ~F.isnan(d), F.lit(False)))
            .when(end.isin("", f"^^<{XSD}string>"), F.length(terms.lex(self.key)) > 0)
        )


def _number_compare(a: Value, b: Value, test) -> Column:
    """Exact where both are, else as doubles; NaN compares to nothing."""
    if a.stored is not None and b.stored is not None:
        return test(a.stored, b.stored)
    x, y = a.double(), b.double()
    return F.coalesce(test(a.exact(), b.exact()), F.when(F.isnan(x) | F.isnan(y), F.lit(False)).otherwise(test(x, y)))


def _comparisons(a: Value, b: Value, test) -> list[Column]:
    """The tests by value that can apply: all, or only that of a side whose
    sort is known."""
    by_sort = {
        "number": lambda: _number_compare(a, b, test),
        "text": lambda: test(a.text(), b.text()),
        "tagged": lambda: test(a.text(), b.text()),
        "moment": lambda: _moment_compare(a, b, test),
        "boolean": lambda: test(a.boolean(), b.boolean()),
    }
    known = a.sort() or b.sort()
    if known:
        return [by_sort[known]()] if known in by_sort else [F.lit(None).cast("boolean")]
    return [make() for make in by_sort.values()]


def _moment_compare(a: Value, b: Value, test) -> Column:
    """A column of moments against a constant is compared as it is stored, so
    that the condition can reach the scan."""

    def utc(v: Value) -> Column | None:
        if v.ntz is not None or v.const is None:
            return v.ntz
        try:
            at = datetime.fromisoformat(terms.decode(v.const).value.strip())
        except ValueError:
            return None
        at = at.astimezone(UTC).replace(tzinfo=None) if at.tzinfo else at
        return F.expr(f"timestamp_ntz'{at.isoformat(sep=' ')}'")

    x, y = utc(a), utc(b)
    if (a.ntz is not None or b.ntz is not None) and x is not None and y is not None:
        return test(x, y)
    return test(a.moment(), b.moment())


def equal(a: Value, b: Value) -> Column:
    """``=``: equality of values where the types have one, else of terms; two
    different literals that cannot be compared as values are an error."""
    ta, tb = a.term(), b.term()
    if "resource" in (a.sort(), b.sort()):
        return ta == tb
    both_literals = terms.is_literal(ta) & terms.is_literal(tb)
    by_term = F.when(ta == tb, True).when(~both_literals, False)
    return F.coalesce(*_comparisons(a, b, lambda x, y: x == y), by_term)


def less(a: Value, b: Value, or_equal: bool = False) -> Column:
    return F.coalesce(*_comparisons(a, b, lambda x, y: x <= y if or_equal else x < y))


def _arithmetic(a: Value, b: Value, op: str) -> Value:
    def run(x: Column, y: Column) -> Column:
        if op == "/":
            return F.try_divide(x, y)
        return {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](x, y)

    exact = run(a.exact(), b.exact()).cast(_DECIMAL)
    x, y = a.double(), b.double()
    double = F.when(y == 0, F.when(x == 0, float("nan")).otherwise(F.lit(float("inf")) * F.signum(x))).otherwise(x / F.when(y != 0, y)) if op == "/" else run(x, y)
    both_exact = a.exact().isNotNull() & b.exact().isNotNull()
    integer = F.lit(False) if op == "/" else a.is_integer() & b.is_integer()
    return Value(exact_=exact, double_=F.when(both_exact, exact.cast("double")).otherwise(double), integer=integer)


def _lang_matches(a: Value, wanted: Value) -> Column:
    tag, text = F.lower(a.text()), F.lower(wanted.text())
    if wanted.const is None:
        return F.when(text == "*", tag != "").otherwise((tag == text) | tag.startswith(F.concat(text, F.lit("-"))))
    name = terms.decode(wanted.const).value.lower()
    if name == "*":
        return tag != ""
    found = (tag == name) | tag.startswith(f"{name}-")
    # a tag that is stored is there only if its column is not null, which the scan can test
    return a.stored_tag.isNotNull() & found if a.stored_tag is not None and name else found


def regex(text: Column, pattern: str, flags: str = "") -> Column:
    known = "".join(f for f in "imsx" if f in flags)
    return text.rlike(f"(?{known}){pattern}" if known else pattern)


def _cast(v: Value, kind: str) -> Value:
    lex = _trim(terms.string_value(v.term()))
    number = ("integer", "int", "long", "decimal", "double", "float")
    if kind == "string":
        return Value(key=F.when(~terms.is_bnode(v.term()), F.concat(F.lit('"'), terms.string_value(v.term()), F.lit(f'"^^<{XSD}string>'))))
    if kind == "boolean":
        from_number = F.when(v.double().isNotNull(), (v.double() != 0) & ~F.isnan(v.double()))
        return Value(bool_=F.coalesce(v.boolean(), from_number, F.when(lex.isin("true", "1"), True).when(lex.isin("false", "0"), False)))
    if kind in number:
        by_truth = F.when(v.boolean(), "1").when(~v.boolean(), "0")
        text = F.coalesce(by_truth, lex)
        form = "double" if kind in FLOATING else "decimal" if kind == "decimal" else "integer"
        own = v.double() if kind in FLOATING else v.exact()
        x = F.coalesce(own, F.when(text.rlike(_FORMS[form]), text.try_cast("double" if kind in FLOATING else _DECIMAL)))
        if kind not in FLOATING:  # a floating number loses its fraction or its excess digits
            x = F.coalesce(x, v.double().try_cast(_DECIMAL))
        if kind in FLOATING:
            return Value(exact_=F.lit(None).cast(_DECIMAL), double_=x, integer=F.lit(False))
        if kind != "decimal":
            x = F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)).cast(_DECIMAL)
        return Value(exact_=x, double_=x.cast("double"), integer=F.lit(kind != "decimal"))
    if kind == "dateTime":
        typed = F.concat(F.lit('"'), lex, F.lit(f'"^^<{XSD}dateTime>'))
        return Value(key=F.when(Value(key=typed).moment().isNotNull(), typed))
    raise ValueError(f"no cast to {kind}")


def _string(c: Column) -> Value:
    return Value(key=F.concat(F.lit('"'), c, F.lit('"')), text_=c, known="text")


def _text_call(name: str, args: list[Value], given: tuple[A.Expr, ...]) -> Value:
    """Functions of the labels of literals. What is cut out of a literal keeps
    its language tag or datatype; nothing found gives the plain empty literal."""
    label = args[0].label()
    if name == "concat":
        return _string(F.concat(*[a.label() for a in args]))
    if name == "strlang":
        return Value(key=F.concat(F.lit('"'), args[0].text(), F.lit('"@'), args[1].text()))
    if name == "strdt":
        return Value(key=F.concat(F.lit('"'), args[0].text(), F.lit('"^^'), F.when(terms.is_uri(args[1].term()), args[1].term())))
    if name == "replace":
        if not all(isinstance(a, A.Const) for a in given[1:]):
            raise ValueError("the pattern and the text of REPLACE must be constant")
        pattern, by, *flags = [terms.decode(a.key).value for a in given[1:]]
        known = "".join(f for f in "imsx" if flags and f in flags[0])
        cut = F.regexp_replace(label, f"(?{known}){pattern}" if known else pattern, by)
    elif name == "substr":
        first = args[1].double().cast("int")
        size = args[2].double().cast("int") if len(args) > 2 else F.length(label)
        # positions count from 1; what lies before the first character is cut off
        cut = F.substring(label, F.greatest(first, F.lit(1)), F.greatest(size + F.least(first - 1, F.lit(0)), F.lit(0)))
    else:
        at = F.instr(label, args[1].label())
        cut = F.when(at > 0, F.substring(label, F.lit(1), at - 1) if name == "strbefore" else F.substring(label, at + F.length(args[1].label()), F.length(label))).otherwise(F.lit(""))
    if args[0].known == "text" and (args[0].variable is None or getattr(args[0].variable.made, "kind", None) == "plain"):
        return _string(cut)
    return Value(key=F.concat(F.lit('"'), cut, F.lit('"'), terms.suffix(args[0].term())))


def _rounded(name: str, v: Value) -> Value:
    """Of the same kind of number; ROUND takes halves up."""
    if v.long_ is not None:
        return Value(long_=F.abs(v.long_)) if name == "abs" else Value(long_=v.long_)
    run = {"abs": F.abs, "ceil": F.ceil, "floor": F.floor, "round": lambda x: F.floor(x + F.lit(0.5).cast("decimal(1,1)"))}[name]
    return Value(exact_=run(v.exact()).cast(_DECIMAL), double_=run(v.double()).cast("double"), integer=v.is_integer())


#: Parts of a dateTime in UTC.
_MOMENT_PARTS = {
    "year": F.year, "month": F.month, "day": F.dayofmonth, "hours": F.hour, "minutes": F.minute,
    "seconds": lambda t: F.extract(F.lit("SECOND"), t),
}


def mapped(variable: Variable, raw: Column) -> Value:
    """The value of a column, without going through its term."""
    if isinstance(variable.made, Computed):
        out = variable.made.value(raw)
    else:
        out = _mapped(variable, raw)
    out.raw, out.variable = raw, variable
    return out


def _mapped(variable: Variable, raw: Column) -> Value:
    if isinstance(variable.made, Template):
        return Value(known="resource")
    if not isinstance(variable.made, Literal):
        return Value(key=raw)
    kind = variable.made.kind
    if kind == "integer":
        return Value(long_=raw.cast("bigint"))
    if kind == "decimal":
        exact = raw.cast("decimal(18,2)")
        return Value(exact_=exact.cast(_DECIMAL), double_=exact.cast("double"), integer=F.lit(False), stored=exact, known="number")
    if kind == "dateTime":
        return Value(ntz=raw, known="moment")
    if kind in ("plain", "string"):
        return Value(text_=raw, known="text")
    if kind == "lang":
        return Value(text_=raw["text"], tag=raw["tag"], known="tagged")
    return Value(key=variable.term(raw))


def compile_expr(e: A.Expr, env: Mapping[str, Value]) -> Value:
    """env: the value of each variable in scope; others are unbound."""
    if isinstance(e, A.Ref):
        return env.get(e.name) or Value(key=F.lit(None).cast("string"))
    if isinstance(e, A.Const):
        return Value(key=F.lit(e.key), const=e.key)
    if not isinstance(e, A.Call):
        raise TypeError(f"not an expression: {e!r}")
    name = e.name
    if name == "bound":
        return Value(bool_=env[e.args[0].name].bound() if e.args[0].name in env else F.lit(False))
    args = [compile_expr(a, env) for a in e.args]
    if name == "&&":
        return Value(bool_=args[0].truth() & args[1].truth())
    if name == "||":
        return Value(bool_=args[0].truth() | args[1].truth())
    if name == "!":
        return Value(bool_=~args[0].truth())
    if name in ("=", "!="):
        found = equal(*args)
        return Value(bool_=found if name == "=" else ~found)
    if name in ("<", "<="):
        return Value(bool_=less(args[0], args[1], name == "<="))
    if name in (">", ">="):
        return Value(bool_=less(args[1], args[0], name == ">="))
    if name in ("+", "-", "*", "/"):
        if len(args) == 1:
            zero = Value(exact_=F.lit(0).cast(_DECIMAL), double_=F.lit(0.0), integer=F.lit(True))
            return args[0] if name == "+" else _arithmetic(zero, args[0], "-")
        return _arithmetic(args[0], args[1], name)
    if name == "in":
        tests = [equal(args[0], x) for x in args[1:]]
        out = F.lit(False)
        for t in tests:
            out = out | t
        return Value(bool_=out)
    if name == "sameterm":
        return Value(bool_=args[0].term() == args[1].term())
    if name in ("isiri", "isuri"):
        return Value(bool_=terms.is_uri(args[0].term()))
    if name == "isblank":
        return Value(bool_=terms.is_bnode(args[0].term()))
    if name == "isliteral":
        return Value(bool_=terms.is_literal(args[0].term()))
    if name == "isnumeric":
        return Value(bool_=args[0].double().isNotNull() & args[0].bound())
    if name == "str":
        return _string(terms.str_value(args[0].term()))
    if name == "lang":
        tag = args[0].language()
        return replace(_string(tag), stored_tag=args[0].tag)
    if name == "datatype":
        return Value(key=terms.datatype(args[0].term()))
    if name == "langmatches":
        return Value(bool_=_lang_matches(args[0], args[1]))
    if name == "regex":
        if not all(isinstance(a, A.Const) for a in e.args[1:]):
            return Value(bool_=F.regexp_like(args[0].label(), args[1].text()))
        given = [terms.decode(a.key).value for a in e.args[1:]]
        return Value(bool_=regex(args[0].label(), *given))
    if name in ("contains", "strstarts", "strends"):
        a, b = args[0].label(), args[1].label()
        return Value(bool_={"contains": a.contains, "strstarts": a.startswith, "strends": a.endswith}[name](b))
    if name == "strlen":
        return Value(long_=F.length(args[0].label()).cast("bigint"))
    if name in ("ucase", "lcase"):
        lex = args[0].label()
        return Value(key=F.concat(F.lit('"'), F.upper(lex) if name == "ucase" else F.lower(lex), F.lit('"'), terms.suffix(args[0].term())))
    if name in ("substr", "strbefore", "strafter", "replace", "concat", "strlang", "strdt"):
        return _text_call(name, args, e.args)
    if name in ("abs", "ceil", "floor", "round"):
        return _rounded(name, args[0])
    if name in _MOMENT_PARTS:
        part = _MOMENT_PARTS[name](F.timestamp_micros(args[0].moment()))
        return Value(long_=part.cast("bigint")) if name != "seconds" else Value(exact_=part.cast(_DECIMAL), double_=part.cast("double"), integer=F.lit(False))
    if name == "if":
        return Value(key=F.when(args[0].truth(), args[1].term()).when(~args[0].truth(), args[2].term()))
    if name == "coalesce":
        return Value(key=F.coalesce(*[a.term() for a in args]))
    if name in ("iri", "uri"):
        return Value(key=F.when(terms.is_uri(args[0].term()), args[0].term()).otherwise(terms.make_uri(args[0].text())))
    if name.startswith("xsd:"):
        return _cast(args[0], name[4:])
    raise ValueError(f"unknown function {name}")


def order_columns(v: Value, descending: bool = False) -> list[Column]:
    """Sort keys: unbound, blank nodes, IRIs, literals; among literals numbers
    by value come first, then instants, then the rest by label and full key."""
    t = v.term()
    if v.known == "number":
        keys = [F.when(t.isNotNull(), 3).otherwise(0), v.double(), v.exact(), t]
    elif v.known == "moment":
        keys = [F.when(t.isNotNull(), 3).otherwise(0), v.ntz, t]
    elif v.known in ("text", "tagged", "resource"):
        keys = [F.when(t.isNull(), 0).when(terms.is_bnode(t), 1).when(terms.is_uri(t), 2).otherwise(3), terms.string_value(t), t]
    else:
        rank = F.when(t.isNull(), 0).when(terms.is_bnode(t), 1).when(terms.is_uri(t), 2).otherwise(3)
        kind = F.when(v.double().isNotNull(), 0).when(v.moment().isNotNull(), 1).otherwise(2)
        keys = [rank, kind, v.double(), v.exact(), v.moment(), terms.string_value(t), t]
    return [k.desc_nulls_last() if descending else k.asc_nulls_first() for k in keys]
