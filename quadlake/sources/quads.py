"""Quad sources: everything a quad pattern can be matched against.

A source answers ``scan(s, p, o, contexts)`` with a DataFrame of s, p, o, c.
``None`` for s, p or o is a wildcard. ``contexts`` lists graphs: none at all is
the whole store, default graph included; None in the list is the default graph.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ("s", "p", "o", "c")
SCHEMA = "s string, p string, o string, c string"


def context_filter(contexts: Iterable[str | None]) -> Column | None:
    """Rows of the listed graphs; a graph listed twice counts once."""
    wanted = list(dict.fromkeys(contexts))
    if not wanted:
        return None
    named = [c for c in wanted if c is not None]
    out = F.col("c").isin(named) if named else None
    if None in wanted:
        default = F.col("c").isNull()
        out = default if out is None else out | default
    return out


class QuadSource:
    """Base class; subclasses give scan."""

    def scan(self, s: str | None = None, p: str | None = None, o: str | None = None, contexts: Iterable[str | None] = ()) -> DataFrame:
        raise NotImplementedError

    def size(self, s: str | None = None, p: str | None = None, o: str | None = None, contexts: Iterable[str | None] = ()) -> DataFrame:
        """One row n: the number of quads that match."""
        return self.scan(s, p, o, contexts).agg(F.count(F.lit(1)).alias("n"))

    def contexts(self) -> DataFrame:
        """The named graphs, each once; the default graph is none of them."""
        return self.scan().where("c is not null").select("c").distinct()


class FrameQuads(QuadSource):
    """Quads held in a DataFrame with columns s, p, o, c.

    Quads are a set: with ``is_set`` false rows that repeat in s, p, o and c
    are merged on every scan, after the filters. Rows with a null s, p or o are
    no quads. Other columns are not read.
    """

    def __init__(self, df: DataFrame, is_set: bool = False):
        self.df, self.is_set = df.select(*COLUMNS), is_set

    def scan(self, s=None, p=None, o=None, contexts=()) -> DataFrame:
        rows = self.df.where(F.col("s").isNotNull() & F.col("p").isNotNull() & F.col("o").isNotNull())
        for name, key in (("s", s), ("p", p), ("o", o)):
            if key is not None:
                rows = rows.where(F.col(name) == key)
        graphs = context_filter(contexts)
        if graphs is not None:
            rows = rows.where(graphs)
        return rows if self.is_set else rows.distinct()
