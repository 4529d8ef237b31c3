"""N-Quads text: one quad a line, read and written in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadlake.functions import terms

#: A line cannot hold line breaks, so two of them stand for the escapes that
#: hide a quote: with those gone, every part is a plain run of characters and no
#: group has to be repeated, which would take stack for each of its rounds.
_BACKSLASH, _QUOTE = "\r", "\n"
_IRI = r"<[^<>\"{}|^`\x00-\x20]*>"
_RES = rf"{_IRI}|_:[\w\p{{L}}][\w\p{{L}}.-]*"
_LITERAL = rf'"[^"]*"(?:@[A-Za-z][A-Za-z0-9-]*|\^\^{_IRI})?'
_LINE = rf"^\s*({_RES})\s*({_IRI})\s*({_RES}|{_LITERAL})\s*({_RES})?\s*\.\s*(?:#.*)?$"
#: One-character escapes.
_SHORT = [("\\t", "\t"), ("\\b", "\b"), ("\\n", "\n"), ("\\r", "\r"), ("\\f", "\f"), ("\\'", "'")]


def _unescape(text: Column) -> Column:
    """Escapes undone piece by piece, so that what one gives is not read as the
    start of another."""
    pieces = F.regexp_extract_all(text, F.lit(r"(\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\.|[\r\n]|[^\\\r\n]+)"), 1)

    def one(x: Column) -> Column:
        out = F.when(x == _BACKSLASH, "\\").when(x == _QUOTE, '"')
        for short, char in _SHORT:
            out = out.when(x == short, char)
        code = F.conv(F.substring(x, F.lit(3), F.length(x)), 16, 10).cast("int")
        # UTF-16 for the code point, two units beyond the basic plane
        high, low = 0xD800 + F.shiftright(code - 0x10000, 10), 0xDC00 + (code - 0x10000).bitwiseAND(0x3FF)

        def unit(n: Column) -> Column:
            return F.lpad(F.hex(n), 4, "0")

        units = F.when(code > 0xFFFF, F.concat(unit(high), unit(low))).otherwise(unit(code))
        return out.when(x.rlike(r"^\\[uU]"), F.decode(F.unhex(units), "UTF-16BE")).otherwise(x)

    return F.when(text.rlike(r"[\\\r\n]"), F.array_join(F.transform(pieces, one), "")).otherwise(text)


def _escape(text: Column) -> Column:
    for char, short in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        text = F.replace(text, F.lit(char), F.lit(short))
    return text


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """s, p, o, c and ok of every line that is neither empty nor a comment; a
    line that is no quad has ok false and nulls."""
    hidden = F.replace(F.replace(F.col(column), F.lit("\\\\"), F.lit(_BACKSLASH)), F.lit('\\"'), F.lit(_QUOTE))
    rows = lines.where(~F.col(column).rlike(r"^\s*(#.*)?$")).select(hidden.alias("_line"))
    # only the object may hold blanks, so it comes last
    parts = F.split(F.regexp_replace("_line", _LINE, "$1 $2 $4 $3"), " ", 4)
    rows = rows.select(F.when(F.col("_line").rlike(_LINE), parts).alias("_parts"))
    rows = rows.select(*[F.col("_parts")[i].alias(f"_{n}") for i, n in enumerate("spco")])

    def key(x: Column) -> Column:
        body = F.concat(F.lit('"'), _unescape(terms.lex(x)), F.lit('"'), terms.suffix(x))
        return F.when(terms.is_literal(x), body).when(terms.is_uri(x), _unescape(x)).otherwise(x)

    return rows.select(
        *[key(F.col(f"_{n}")).alias(n) for n in "spo"], F.when(F.col("_c") != "", key(F.col("_c"))).alias("c"), F.col("_s").isNotNull().alias("ok")
    )


def read_nquads(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """The quads of text files (N-Triples lines are quads of the default graph).

    strict: a line that is no quad raises when it is read; otherwise it is
    passed over.
    """
    rows = parse_lines(spark.read.text(path))
    if strict:
        checked = F.when(F.col("ok"), F.col("s")).otherwise(F.raise_error(F.lit("a line is not a quad")).cast("string"))
        return rows.select(checked.alias("s"), "p", "o", "c")
    return rows.where("ok").select("s", "p", "o", "c")


def format_quads(quads: DataFrame, *keep: str) -> DataFrame:
    """One column value: the line of each quad; and the columns to keep."""

    def part(x: Column) -> Column:
        return F.when(terms.is_literal(x), F.concat(F.lit('"'), _escape(terms.lex(x)), F.lit('"'), terms.suffix(x))).otherwise(x)

    graph = F.when(F.col("c").isNull(), F.lit("")).otherwise(F.concat(F.lit(" "), F.col("c")))
    return quads.select(F.concat(part(F.col("s")), F.lit(" "), F.col("p"), F.lit(" "), part(F.col("o")), graph, F.lit(" .")).alias("value"), *keep)


def write_nquads(quads: DataFrame, path: str) -> None:
    format_quads(quads).write.text(path)
