"""Per-key results when a few keys hold most rows.

Method: value-frequency compression. Rows are first grouped by (key, value),
which every map task does for its own rows before anything is shuffled and
whose groups spread a hot key over all tasks by its values; only these weighted
values are then grouped by key, again with map-side partial results. No task
ever sees a hot key's rows together.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadlake.session import stage

DEFAULT_KEY = "DEFAULT"


def weighted_values(df: DataFrame, fields: Mapping[str, str | None], value: str, time: str) -> DataFrame:
    """One row per (field, key, value) with its number of rows and time range.

    fields maps a key column to the name that stands for its null (None: the
    null key stays null). All fields come from one scan.
    """
    keyed = [
        F.struct(F.lit(c).alias("field"), (F.col(c) if null is None else F.coalesce(F.col(c), F.lit(null))).alias("key"))
        for c, null in fields.items()
    ]
    rows = df.select(F.explode(F.array(*keyed)).alias("_k"), F.col(value).alias("value"), F.col(time).alias("_t"))
    return rows.groupBy(F.col("_k.field").alias("field"), F.col("_k.key").alias("key"), "value").agg(
        F.count(F.lit(1)).alias("n"), F.min("_t").alias("first_t"), F.max("_t").alias("last_t")
    )


def key_profile(
    df: DataFrame,
    fields: Mapping[str, str | None],
    value: str,
    time: str,
    mode: bool = False,
) -> DataFrame:
    """For every key of every field: n_rows, n_distinct of value, first and
    last time, and with mode the most frequent value (smallest on ties).

    Nulls: a null value counts as a row but not as a distinct value; null
    times are ignored, all null gives null; a null key is a key of its own,
    named by fields. Repeated rows count. Empty input gives no rows. Columns
    other than those named are not read, whatever they are called.
    """
    aggs = [
        F.sum("n").alias("n_rows"),
        F.count("value").alias("n_distinct"),
        F.min("first_t").alias("first_time"),
        F.max("last_t").alias("last_time"),
    ]
    if mode:
        order = F.struct((-F.col("n")).alias("k"), F.col("value").alias("v"), F.col("n").alias("w"))
        top = F.min(F.when(F.col("value").isNotNull(), order))
        aggs += [top.getField("v").alias("mode_value"), top.getField("w").alias("mode_rows")]
    return weighted_values(df, fields, value, time).groupBy("field", "key").agg(*aggs)


def weighted_percentile(df: DataFrame, key: str, value: str, q: float | Mapping[str, float]) -> DataFrame:
    """The exact lower q-percentile (0 < q <= 1) of value for every key: key and
    percentile, or a column for each q of a mapping from name to q, all in one pass.

    The result is the smallest value whose share of the key's rows, with all
    smaller values, is at least q. Nulls in value are ignored; a key with
    nothing but nulls has no row; a null key is a key.

    The weighted values of a key are cut into blocks by range over the whole
    table, block sums tell how many rows lie before each block, and only blocks
    that hold a wanted rank are accumulated in order. A hot key is thereby
    spread over many blocks.
    """
    wanted = dict(q) if isinstance(q, Mapping) else {"percentile": q}
    blocks = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    w = (
        df.where(F.col(value).isNotNull())
        .groupBy(F.col(key).alias("_k"), F.col(value).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .repartitionByRange(blocks, "_k", "_v")
        .withColumn("_b", F.spark_partition_id())
    )
    w = stage(df.sparkSession, w, "percentile")
    sums = w.groupBy("_k", "_b").agg(F.sum("_n").alias("_s"))  # at most one row a key and block
    ordered, whole = Window.partitionBy("_k").orderBy("_b"), F.sum("_s").over(Window.partitionBy("_k"))
    ranks = F.array(*[F.struct(F.lit(name).alias("name"), F.ceil(whole * F.lit(float(share))).alias("rank")) for name, share in wanted.items()])
    sums = sums.withColumn("_before", F.sum("_s").over(ordered) - F.col("_s")).withColumn("_ranks", ranks)
    inside = F.filter("_ranks", lambda r: (F.col("_before") < r["rank"]) & (r["rank"] <= F.col("_before") + F.col("_s")))
    sums = sums.select(F.col("_k").alias("_k2"), F.col("_b").alias("_b2"), "_before", inside.alias("_ranks")).where(F.size("_ranks") > 0)
    upto = F.col("_before") + F.sum("_n").over(Window.partitionBy("_k", "_b").orderBy("_v"))
    rows = w.join(sums, F.col("_k").eqNullSafe(F.col("_k2")) & (F.col("_b") == F.col("_b2"))).withColumn("_upto", upto)

    def at(name: str) -> Column:
        rank = F.get(F.filter("_ranks", lambda r: r["name"] == name), F.lit(0))["rank"]
        return F.min(F.when(F.col("_upto") >= rank, F.col("_v"))).alias(name)

    return rows.groupBy(F.col("_k").alias(key)).agg(*[at(name) for name in wanted])


def hot_share(profile: DataFrame, n_rows: int, share: float) -> DataFrame:
    """Keys of a key_profile with at least share of all n_rows rows; at most
    1 / share per field."""
    return profile.where(F.col("n_rows") >= F.lit(n_rows * share)).select("field", F.col("key").alias("hot_key"))
