"""Attribute-value rows to one typed row per entity.

Method: the values of every (entity, attribute) cell are reduced to a fixed
size state, the grid of an entity is completed and its cells laid into an array
sorted by attribute position, and every column is projected from its fixed index
through the cast of its type.

The grid is completed inside the entity's own row: empty cells are added for the
positions it lacks and all are sorted, once. The result is that of a grid of
entities times attributes left-joined with the values, without shuffling a row
for every empty cell. A cell's state (smallest and largest normal form, number
of misfits) is algebraic, so a subject that holds a third of all rows is reduced
by every map task before the shuffle and never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadlake.functions import lexical, terms

#: predicate, column name, value type, single-valued
Attribute = tuple[str, str, str, bool]
#: An attribute list is a column list; more than this is refused.
MAX_ATTRIBUTES = 5000


def attribute_list(attributes: DataFrame) -> list[Attribute]:
    """(predicate, column, type, single_valued) in order of predicate.

    An attribute that cannot become a column raises: one with a null part or an
    unknown type, and a predicate with two different descriptions. Repeated rows
    count once; a column name used twice gets its position as a suffix.
    """
    rows = attributes.select("p", "column_name", "value_type", F.coalesce("single_valued", F.lit(False)).alias("single_valued")).distinct().limit(MAX_ATTRIBUTES + 1).collect()
    if len(rows) > MAX_ATTRIBUTES:
        raise ValueError(f"more than {MAX_ATTRIBUTES} attributes cannot become columns")
    bad = [tuple(r) for r in rows if r.p is None or r.column_name is None or r.value_type not in lexical.COLUMN_TYPES]
    if bad:
        raise ValueError(f"no column can be made of {bad[:5]}")
    out: dict[str, Attribute] = {}
    used = {"s"}
    for r in sorted(rows):
        if r.p in out:
            raise ValueError(f"{r.p} is described twice")
        name = r.column_name if r.column_name.lower() not in used else f"{r.column_name}_{len(out)}"
        used.add(name.lower())
        out[r.p] = (r.p, name, r.value_type, bool(r.single_valued))
    return list(out.values())


def fitted(quads: DataFrame, attributes: list[Attribute]) -> DataFrame:
    """s, pos and _v for every row with a subject: the position of its
    attribute and the normal form of its value, null if it does not fit.

    Rows of unlisted predicates, and with a null predicate or object, have the
    null position.
    """
    places = quads.sparkSession.createDataFrame([(p, i, t) for i, (p, _, t, _) in enumerate(attributes)], "p string, _at int, _kind string")
    # at most MAX_ATTRIBUTES rows, so the list goes to every task and is looked up by hash
    rows = quads.where(F.col("s").isNotNull()).select("s", "p", "o").join(F.broadcast(places), "p", "left")
    # One projection a step: what several branches of the next one use is computed once.
    rows = rows.select("s", "o", *[F.when(F.col("o").isNotNull(), F.col(c)).alias(n) for c, n in (("_at", "pos"), ("_kind", "_t"))])
    rows = rows.withColumn("_lex", F.when(F.col("_t").isNotNull(), terms.lex(F.col("o"))))
    rows = rows.withColumn("_x", F.when(~F.col("_t").isin("iri", "string"), lexical.trim(F.col("_lex"))))
    norm = lexical.normal_form(F.col("_t"), F.col("o"), F.col("_lex"), F.col("_x"))
    return rows.select("s", "pos", norm.alias("_v"))


def cells(quads: DataFrame, attributes: list[Attribute]) -> DataFrame:
    """One row per subject and attribute: s, pos, lo, hi, n_misfit.

    lo and hi are the smallest and largest normal form of the values that fit.
    Rows of unlisted predicates, and with a null predicate or object, keep
    their subject alive under the null position; rows with a null subject are
    left out. Repeated rows change nothing but n_misfit.
    """
    misfit = F.col("pos").isNotNull() & F.col("_v").isNull()
    return (
        fitted(quads, attributes)
        .groupBy("s", "pos")
        .agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.count(F.when(misfit, 1)).alias("n_misfit"))
    )


def cell_values(quads: DataFrame, attributes: list[Attribute]) -> DataFrame:
    """Every value of every cell: s, p, column_name, value (the normal form),
    one row for each different value that fits.

    The values stay rows and are made different by (s, attribute, value), so a
    subject with many values is spread over all tasks by them.
    """
    if not attributes:
        return quads.sparkSession.createDataFrame([], "s string, p string, column_name string, value string")
    listed = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(n).alias("column_name")) for p, n, *_ in attributes])
    found = fitted(quads, attributes).where(F.col("pos").isNotNull() & F.col("_v").isNotNull()).distinct()
    return found.select("s", F.get(listed, F.col("pos")).alias("_a"), F.col("_v").alias("value")).select("s", "_a.*", "value")


def entity_grid(quads: DataFrame, attributes: list[Attribute]) -> DataFrame:
    """s and grid: for every subject one array with a cell (pos, lo, hi,
    n_misfit) at each attribute's position; a cell without values has nulls and
    no misfits."""
    cell = F.when(F.col("pos").isNotNull(), F.struct("pos", "lo", "hi", "n_misfit"))
    rows = cells(quads, attributes).groupBy("s").agg(F.collect_list(cell).alias("_cells"))  # at most one an attribute
    every = F.sequence(F.lit(0), F.lit(len(attributes) - 1)) if attributes else F.array().cast("array<int>")
    none = F.lit(None).cast("string")
    empty = F.transform(F.array_except(every, F.col("_cells.pos")), lambda i: F.struct(i.alias("pos"), none.alias("lo"), none.alias("hi"), F.lit(0).cast("bigint").alias("n_misfit")))
    return rows.select("s", F.array_sort(F.concat("_cells", empty)).alias("grid"))


def unclean_cells(grid: DataFrame, attributes: list[Attribute]) -> DataFrame:
    """The cells of an entity_grid that cannot be filled cleanly: s, p,
    column_name, single_valued, n_misfit (rows whose value does not fit),
    conflict (different values in a single-valued attribute) and unheld (the
    value of the cell fits, but its column gives null or a rounded one)."""
    if not attributes:
        return grid.sparkSession.createDataFrame([], "s string, p string, column_name string, single_valued boolean, n_misfit bigint, conflict boolean, unheld boolean")
    listed = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(n).alias("column_name"), F.lit(one).alias("single_valued")) for p, n, _, one in attributes])
    kinds = F.array(*[F.lit(t) for _, _, t, _ in attributes])

    def conflict(c: Column) -> Column:
        return F.coalesce(F.get(listed, c["pos"])["single_valued"] & (c["lo"] != c["hi"]), F.lit(False))

    def unheld(c: Column) -> Column:
        return c["lo"].isNotNull() & ~conflict(c) & ~lexical.held(F.get(kinds, c["pos"]), c["lo"])

    bad = F.filter("grid", lambda c: (c["n_misfit"] > 0) | conflict(c) | unheld(c))
    c = F.col("_c")
    found = grid.select("s", F.explode(bad).alias("_c"))
    return found.select("s", F.get(listed, c["pos"]).alias("_a"), c["n_misfit"].alias("n_misfit"), conflict(c).alias("conflict"), unheld(c).alias("unheld")).select("s", "_a.*", "n_misfit", "conflict", "unheld")


def wide_table(quads: DataFrame, attributes: DataFrame) -> DataFrame:
    """One row per subject that has any row, one typed column per attribute.

    A single-valued attribute with two or more different values gives null (see
    unclean_cells); misfits are passed over. An attribute that may have several
    values gives the one with the smallest normal form; cell_values has them
    all. Subjects without any
    listed attribute have a row of nulls; null subjects have none. Empty input
    gives no rows, an empty attribute list a table of subjects.
    """
    known = attribute_list(attributes)
    rows = entity_grid(quads, known)
    out = []
    for i, (_, name, kind, single) in enumerate(known):
        at = F.col("grid")[i]
        clean = F.when(at["lo"] == at["hi"], at["lo"]) if single else at["lo"]
        out.append(lexical.typed(kind, clean).alias(name))
    return rows.select("s", *out)
