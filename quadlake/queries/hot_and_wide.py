"""Queries p1, p3 and p5 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadlake.operators import profile, references, wide
from quadlake.sources.tables import table

P1_FIELDS = {"p": None, "c": profile.DEFAULT_KEY}
P1_SHARE = 0.05


def p1_profile(spark: SparkSession, folder: str) -> DataFrame:
    out = profile.key_profile(table(spark, folder, "quads"), P1_FIELDS, "s", "loaded_at")
    return out.select("field", "key", "n_rows", F.col("n_distinct").alias("n_subjects"), F.col("first_time").alias("first_loaded"), F.col("last_time").alias("last_loaded"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    quads = table(spark, folder, "quads")
    return profile.hot_share(profile.key_profile(quads, P1_FIELDS, "s", "loaded_at"), quads.count(), P1_SHARE)


def p1_modes(spark: SparkSession, folder: str) -> DataFrame:
    out = profile.key_profile(table(spark, folder, "quads"), P1_FIELDS, "s", "loaded_at", mode=True)
    return out.select("field", "key", F.col("mode_value").alias("top_subject"), F.col("mode_rows").alias("top_rows"))


def p1_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Median and 99th percentile of the length of the objects of each predicate, the null one too."""
    sized = table(spark, folder, "quads").select("p", F.length("o").cast("bigint").alias("size"))
    return profile.weighted_percentile(sized, "p", "size", {"median": 0.5, "p99": 0.99})


def _values(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "quads").select("s", "p", "o")


def p3_wide(spark: SparkSession, folder: str) -> DataFrame:
    return wide.wide_table(_values(spark, folder), table(spark, folder, "attribute_types"))


def p3_cells(spark: SparkSession, folder: str) -> DataFrame:
    """The cells that cannot be filled cleanly; one with neither conflict nor
    misfit holds a value that its column cannot give whole."""
    known = wide.attribute_list(table(spark, folder, "attribute_types"))
    bad = wide.unclean_cells(wide.entity_grid(_values(spark, folder), known), known)
    return bad.select("s", "p", "column_name", "single_valued", "conflict", (F.col("n_misfit") > 0).alias("misfit"))


def p3_values(spark: SparkSession, folder: str) -> DataFrame:
    """All values of the attributes that may have several; p3_wide shows one of each cell."""
    known = [a for a in wide.attribute_list(table(spark, folder, "attribute_types")) if not a[3]]
    return wide.cell_values(_values(spark, folder), known)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    known = [a for a in wide.attribute_list(table(spark, folder, "attribute_types")) if a[3]]
    bad = wide.unclean_cells(wide.entity_grid(_values(spark, folder), known), known)
    return bad.where((F.col("n_misfit") > 0) | F.col("conflict")).select("s", "p")


def _orphans(spark: SparkSession, folder: str) -> DataFrame:
    return references.orphans(
        table(spark, folder, "triples"), "stmt_id", ["subj", "obj"], "loaded_at",
        table(spark, folder, "term_values"), table(spark, folder, "vocab_terms"),
    )


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _orphans(spark, folder).select(F.col("row_id").alias("stmt_id"), "field", "reason")


def p5_counts(spark: SparkSession, folder: str) -> DataFrame:
    return references.orphan_counts(_orphans(spark, folder))


QUERIES = {f.__name__: f for f in (p1_profile, p1_found, p1_modes, p1_percentiles, p3_wide, p3_cells, p3_values, p3_found, p5_found, p5_counts)}

_P1_KEYED = """WITH k AS (
  SELECT 'p' AS field, p AS key, s, loaded_at FROM quads
  UNION ALL SELECT 'c', coalesce(c, 'DEFAULT'), s, loaded_at FROM quads)
"""

#: lex, then the value in its type as text (different texts are different values), for every listed cell.
_P3_VALUES = r"""WITH a AS (SELECT DISTINCT p, column_name, value_type, single_valued FROM attribute_types),
lexed AS (
  SELECT q.s, q.p, q.o, a.column_name, a.value_type AS t, a.single_valued, starts_with(q.o, '"') AS lit,
    CASE WHEN starts_with(q.o, '"') THEN regexp_extract(q.o, '^"((?s:.*))"', 1) END AS lex
  FROM quads q JOIN a ON q.p = a.p WHERE q.s IS NOT NULL AND q.o IS NOT NULL),
cut AS (SELECT *, regexp_replace(lex, '^[\t-\r\x1c-\x1f\x{85}\p{Z}]+|[\t-\r\x1c-\x1f\x{85}\p{Z}]+$', '', 'g') AS x FROM lexed),
dated AS (
  SELECT *, regexp_extract(x, '([Zz]|[+-][0-9]{2}:[0-9]{2})$', 1) AS zone,
    CASE WHEN regexp_full_match(x, '[0-9]{4}-[0-9]{2}-[0-9]{2}T([01][0-9]|2[0-3])(:[0-5][0-9]){2}([.][0-9]+)?(Z|[+-]([01][0-9]|2[0-3]):[0-5][0-9])?')
      THEN try_cast(substr(x, 1, 10) || ' ' || regexp_extract(x, 'T([0-9:]+(?:[.][0-9]+)?)', 1) AS TIMESTAMP) END AS moment
  FROM cut),
vals AS (
  SELECT s, p, column_name, t, single_valued, CASE
    WHEN t = 'iri' THEN CASE WHEN NOT lit THEN o END
    WHEN NOT lit THEN NULL
    WHEN t = 'string' THEN lex
    WHEN t = 'integer' THEN CASE WHEN regexp_full_match(x, '[+-]?[0-9]+') THEN CAST(try_cast(x AS HUGEINT) AS VARCHAR) END
    WHEN t = 'decimal' THEN CASE WHEN regexp_full_match(x, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)') THEN CAST(try_cast(x AS DECIMAL(38,10)) AS VARCHAR) END
    WHEN t = 'boolean' THEN CASE WHEN x IN ('true', '1') THEN 'true' WHEN x IN ('false', '0') THEN 'false' END
    WHEN t = 'date' THEN CASE WHEN regexp_full_match(x, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN CAST(try_cast(x AS DATE) AS VARCHAR) END
    WHEN t = 'timestamp' THEN CAST(moment - CASE WHEN zone IN ('', 'Z') THEN INTERVAL 0 MINUTE ELSE
      to_minutes(CAST(zone[1] || '1' AS INT) * (CAST(zone[2:3] AS INT) * 60 + CAST(zone[5:6] AS INT))) END AS VARCHAR)
    END AS v FROM dated),
cells AS (
  SELECT s, p, column_name, t, single_valued, min(v) AS lo, max(v) AS hi,
    single_valued AND count(DISTINCT v) > 1 AS conflict, count(*) > count(v) AS misfit
  FROM vals GROUP BY s, p, column_name, t, single_valued)
"""

_P5_ORPHANS = """WITH refs AS (
  SELECT DISTINCT stmt_id, field, id, loaded_at AS t FROM (
    SELECT stmt_id, 'subj' AS field, subj AS id, loaded_at FROM triples
    UNION ALL SELECT stmt_id, 'obj', obj, loaded_at FROM triples)
  WHERE id IS NOT NULL AND id NOT IN (0, 1) AND id NOT IN (SELECT id FROM vocab_terms)),
judged AS (
  SELECT r.stmt_id, r.field, r.t, count(v.id) AS n, count(*) FILTER (WHERE v.created_at <= r.t) AS begun,
    count(*) FILTER (WHERE v.created_at <= r.t AND (v.deleted_at IS NULL OR v.deleted_at > r.t)) AS live
  FROM refs r LEFT JOIN term_values v ON r.id = v.id GROUP BY ALL),
found AS (
  SELECT stmt_id, field, t, CASE WHEN n = 0 THEN 'missing' WHEN begun > 0 THEN 'deleted' ELSE 'late' END AS reason
  FROM judged WHERE live = 0)
"""

#: The columns of the test data's attribute_types.
WIDE_COLUMNS = [
    ("type_iri", "iri"), ("member", "iri"), ("reading", "decimal"), ("reading_of", "iri"), ("label_text", "string"), ("status", "string"),
    ("installed_on", "date"), ("height_m", "decimal"), ("unit_count", "integer"), ("is_active", "boolean"), ("checked_at", "timestamp"),
    ("serial_no", "string"), ("part_of", "iri"), ("note_text", "string"), ("tag", "string"), ("x_navak", "string"), ("x_bameth", "string"),
    ("x_sonibis", "string"), ("x_benon", "string"), ("x_hetoth", "string"), ("x_lamenix", "string"), ("x_pedax", "string"), ("x_lomazath", "string"),
    ("x_tobix", "string"), ("x_tikeken", "string"), ("x_binaken", "string"), ("x_kifax", "string"), ("x_lefareth", "string"), ("x_saliter", "string"),
    ("x_gobem", "string"), ("x_pekason", "string"), ("x_bamim", "string"), ("x_wabikek", "string"), ("x_poses", "string"), ("x_madas", "string"),
]
_SQL_TYPES = {"integer": "BIGINT", "decimal": "DECIMAL(38,10)", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP"}


def _wide_sql() -> str:
    def column(name: str, kind: str) -> str:
        value = f"CAST(lo AS {_SQL_TYPES[kind]})" if kind in _SQL_TYPES else "lo"
        return f"max(CASE WHEN column_name = '{name}' AND NOT conflict THEN {value} END) AS {name}"

    columns = ", ".join(column(*c) for c in WIDE_COLUMNS)
    return _P3_VALUES + f"SELECT q.s, {columns} FROM (SELECT DISTINCT s FROM quads WHERE s IS NOT NULL) q LEFT JOIN cells ON q.s = cells.s GROUP BY q.s"


SQL = {
    "p1_profile": _P1_KEYED
    + "SELECT field, key, count(*) AS n_rows, count(DISTINCT s) AS n_subjects, min(loaded_at) AS first_loaded, max(loaded_at) AS last_loaded FROM k GROUP BY field, key",
    "p1_found": _P1_KEYED + "SELECT field, key AS hot_key FROM k GROUP BY field, key HAVING count(*) >= 0.05 * (SELECT count(*) FROM quads)",
    "p1_modes": _P1_KEYED
    + """, n AS (SELECT field, key, s, count(*) AS n FROM k GROUP BY ALL)
SELECT field, key, s AS top_subject, n AS top_rows FROM n WHERE s IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY field, key ORDER BY n DESC, s) = 1""",
    "p1_percentiles": "SELECT p, quantile_disc(length(o), 0.5) AS median, quantile_disc(length(o), 0.99) AS p99 FROM quads WHERE o IS NOT NULL GROUP BY p",
    "p3_wide": _wide_sql(),
    "p3_cells": _P3_VALUES + "SELECT s, p, column_name, single_valued, conflict, misfit FROM cells WHERE conflict OR misfit",
    "p3_values": _P3_VALUES + "SELECT DISTINCT s, p, column_name, v AS value FROM vals WHERE single_valued IS NOT TRUE AND v IS NOT NULL",
    "p3_found": _P3_VALUES + "SELECT s, p FROM cells WHERE single_valued AND (conflict OR misfit)",
    "p5_found": _P5_ORPHANS + "SELECT stmt_id, field, reason FROM found",
    "p5_counts": _P5_ORPHANS + "SELECT field, reason, CAST(date_trunc('month', t) AS DATE) AS month, count(*) AS n_refs FROM found GROUP BY ALL",
}
