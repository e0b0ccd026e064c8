"""Joins that a hot key does not put into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot that has more rows than this part of a task's even share; so hot keys are fewer than PARTS for each shuffle partition.
PARTS = 16


def join_by_key(rows: DataFrame, per_key: DataFrame, keys: list[str], count: str, spread: Column) -> DataFrame:
    """`rows` left-joined with `per_key`, which has a row for each key and in `count` how many of `rows` have it.

    The rows of a hot key are dealt to as many parts as they fill, by the hash of `spread` (any column that tells rows apart), and the
    key's one row goes to each of its parts. Hot keys are broadcast: at most PARTS times the shuffle partitions, whatever the input
    holds. Engines split skewed joins only where both sides come from a shuffle of their own, not where one is a sum by the same key.

    Null keys meet none, as in any join, and are dealt alike. `count` stays out of the result.
    """
    parts = PARTS * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = per_key.agg(F.ceil(F.sum(count) / parts).alias("_share"))
    hot = per_key.crossJoin(F.broadcast(share)).filter(F.col(count) > F.col("_share"))
    hot = F.broadcast(hot.select(*(F.col(k).alias(f"_hot_{k}") for k in keys), F.ceil(F.col(count) / F.col("_share")).cast("int").alias("_parts")))

    def with_parts(df: DataFrame) -> DataFrame:
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_hot_{k}"))
        return df.join(hot, same, "left").drop(*(f"_hot_{k}" for k in keys))

    left = with_parts(rows).withColumn("_part", F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(spread), F.col("_parts"))).cast("int")).drop("_parts")
    right = with_parts(per_key).withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts", count)
    return left.join(right, [*keys, "_part"], "left").drop("_part")
