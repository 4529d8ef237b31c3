"""References to records that do not exist.

Method: references and parent lifetimes are brought into one stream that is
partitioned by id and sorted by (id, time), and merged in one linear pass over
each partition: a running maximum of the lifetimes' ends tells at every
reference whether some lifetime that has begun is still open.

An id with more references than a task should get is spread over salts, and the
few lifetimes of such an id are given to every salt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadlake.operators import skew

_FOREVER = "timestamp_ntz'9999-12-31 23:59:59.999999'"
_ALWAYS = "timestamp_ntz'0001-01-01 00:00:00'"


def references(df: DataFrame, row_id: str, fields: list[str], at: str, reserved: tuple[int, ...] = (0, 1)) -> DataFrame:
    """row_id, field, ref, ts of every reference; null and reserved ids are none."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("ref")) for f in fields]))
    return (
        df.select(F.col(row_id).alias("row_id"), F.col(at).cast("timestamp_ntz").alias("ts"), each.alias("_r"))
        .select("row_id", "_r.field", "_r.ref", "ts")
        .where(F.col("ref").isNotNull() & ~F.col("ref").isin(*reserved))
    )


def orphans(
    df: DataFrame,
    row_id: str,
    fields: list[str],
    at: str,
    parents: DataFrame,
    static_parents: DataFrame | None = None,
    limit: int | None = None,
) -> DataFrame:
    """References whose id has no record, or none live at their time.

    parents: id, created_at, deleted_at, one row per lifetime, live from
    created_at (included) to deleted_at (excluded; null: not deleted).
    static_parents: id, always live. limit: references of one id that a task
    may get, by default half of a mean task. Result: row_id, field, ref, ts, reason:
    ``missing`` no lifetime has the id, ``deleted`` some lifetime began at or
    before ts but all those had ended, ``late`` every lifetime begins after ts.

    Nulls: null and reserved ids are no references; a null parent id is no
    parent; a null created_at counts as always begun; a reference without a
    time can only be missing. A row delivered twice gives one result. Ties: a
    lifetime that begins at ts counts as begun, one that ends at ts as ended.
    Empty references give no rows, empty parents make every reference missing.
    """
    refs = references(df, row_id, fields, at)
    if static_parents is not None:
        refs = refs.join(static_parents.select(F.col("id").alias("ref")), "ref", "left_anti")
    lives = parents.where(F.col("id").isNotNull()).select(
        F.col("id").alias("ref"),
        F.coalesce(F.col("created_at").cast("timestamp_ntz"), F.expr(_ALWAYS)).alias("ts"),
        F.coalesce(F.col("deleted_at").cast("timestamp_ntz"), F.expr(_FOREVER)).alias("until"),
    )
    hot = skew.hot_keys(refs, "ref", df.count() * len(fields), limit)
    spread_by = F.struct("row_id", "field", "ts")
    nothing = F.lit(None)
    stream = skew.spread(refs, hot, "ref", spread_by).select(
        "ref", "_salt", "ts", F.lit(1).alias("is_ref"), "row_id", "field", nothing.cast("timestamp_ntz").alias("until")
    ).unionByName(
        skew.replicate(lives, hot, "ref").select(
            "ref", "_salt", "ts", F.lit(0).alias("is_ref"), nothing.cast(refs.schema["row_id"].dataType).alias("row_id"), nothing.cast("string").alias("field"), "until"
        )
    )
    by_id = Window.partitionBy("ref", "_salt")
    in_time = by_id.orderBy(F.col("ts").asc_nulls_first(), "is_ref").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = stream.select("*", F.max("until").over(in_time).alias("open_until"), F.min("is_ref").over(by_id).alias("any_parent"))
    reason = (
        F.when(F.col("any_parent") == 1, "missing")
        .when(F.col("ts").isNull(), None)
        .when(F.col("open_until").isNull(), "late")
        .when(F.col("open_until") <= F.col("ts"), "deleted")
    )
    return (
        merged.where("is_ref = 1")
        .select("row_id", "field", "ref", "ts", reason.alias("reason"))
        .where("reason is not null")
        .distinct()
    )


def orphan_counts(found: DataFrame) -> DataFrame:
    """Number of orphan references per field, reason and month (first day)."""
    return found.groupBy("field", "reason", F.trunc("ts", "month").alias("month")).agg(F.count(F.lit(1)).alias("n_refs"))
