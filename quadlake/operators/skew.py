"""Hot keys: finding the keys that would fill a task by themselves, and
spreading them.

A key is hot if its rows are more than half of what a shuffle task gets on
average, n_rows / (2 * tasks), so there are at most 2 * tasks hot keys however
large the table is; that bound is what makes broadcasting the list safe. A hot
key gets as many salts as it has shares of that size, so no task gets more than
about half a mean task of one key, at any number of rows and of tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def task_rows(df: DataFrame, n_rows: int) -> int:
    """Rows of one key that a task may get: half of a mean task of n_rows."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, n_rows // (2 * max(1, tasks)))


def hot_keys(df: DataFrame, key: str, n_rows: int, limit: int | None = None) -> DataFrame:
    """The keys of df with more than limit rows (by default task_rows), and
    salts, the number of tasks each is to be spread over. Counted map-side; a
    null key is never hot."""
    limit = limit or task_rows(df, n_rows)
    return df.groupBy(key).count().where((F.col("count") > limit) & F.col(key).isNotNull()).select(key, F.ceil(F.col("count") / limit).cast("int").alias("salts"))


def _marked(df: DataFrame, hot: DataFrame, key: str | list[str]) -> DataFrame:
    return df.join(F.broadcast(hot.withColumnRenamed("salts", "_salts")), key, "left")


def spread(df: DataFrame, hot: DataFrame, key: str | list[str], by: Column, name: str = "_salt") -> DataFrame:
    """Add a salt to df: pmod(hash(by), salts) for hot keys, 0 for all others."""
    salt = F.when(F.col("_salts").isNotNull(), F.pmod(F.xxhash64(by), F.col("_salts")).cast("int")).otherwise(F.lit(0))
    return _marked(df, hot, key).withColumn(name, salt).drop("_salts")


def replicate(df: DataFrame, hot: DataFrame, key: str | list[str], name: str = "_salt") -> DataFrame:
    """Give the rows of hot keys once per salt, all others once with salt 0."""
    every = F.when(F.col("_salts").isNotNull(), F.sequence(F.lit(0), F.col("_salts") - 1)).otherwise(F.array(F.lit(0)))
    return _marked(df, hot, key).withColumn(name, F.explode(every)).drop("_salts")


def join_pairs(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The inner join on keys that neither side has once, where a task's work is
    its pairs of rows: a key with more pairs than half a mean task is spread over
    tasks, the rows of the larger side divided and those of the other one given
    to each. The tasks stay as many as there are shuffle partitions, since the
    bytes that are shuffled say little of the pairs they make."""
    spark = left.sparkSession
    counts = left.groupBy(*keys).agg(F.count("*").alias("_n")).join(right.groupBy(*keys).agg(F.count("*").alias("_m")), keys)
    counts = counts.withColumn("_pairs", F.col("_n").cast("decimal(20,0)") * F.col("_m"))
    n, m, pairs = counts.agg(F.sum("_n"), F.sum("_m"), F.sum("_pairs")).first()
    limit, tasks = task_rows(left, int(pairs or 0)), int(spark.conf.get("spark.sql.shuffle.partitions"))
    salts = F.least(F.ceil(F.col("_pairs") / limit), F.greatest("_n", "_m")).cast("int").alias("salts")
    hot = counts.where(F.col("_pairs") > limit).select(*keys, salts)
    hot = spark.createDataFrame(hot.collect(), hot.schema)  # at most two a task
    divided = (n or 0) >= (m or 0)
    sides = []
    for df, own in ((left, divided), (right, not divided)):
        salted = spread(df, hot, keys, F.struct(*df.columns)) if own else replicate(df, hot, keys)
        sides.append(salted.repartition(tasks, *keys, "_salt"))
    return sides[0].join(sides[1], [*keys, "_salt"]).drop("_salt")
