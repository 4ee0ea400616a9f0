"""Top-k per key and running sums that split hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int | None, rank: str | None = None) -> DataFrame:
    """First ``k`` rows per key; all rows, numbered, for ``None``.

    Spark trims every input partition to ``k`` rows per key before the shuffle, so a
    key that holds a third of all rows never lands whole in one task.  It does so up to
    ``spark.sql.optimizer.windowGroupLimitThreshold``, which the session settings raise.
    """
    if k is None and rank is None:
        return df
    name = rank or "_rank"
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(w))
    out = out if k is None else out.filter(F.col(name) <= k)
    return out if rank else out.drop(name)


def page(df: DataFrame, keys: Sequence[str], order: Sequence[Column], size: int, number: int) -> DataFrame:
    """Zero-based page ``number`` of ``size`` rows per key."""
    last = size * (number + 1)
    return top_k(df, keys, order, last, "_rank").filter(F.col("_rank") > size * number).drop("_rank")


def running_sums(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column, sums: dict[str, Column]
) -> DataFrame:
    """Running sums per key, computed in two levels.

    ``bucket`` must grow with the order.  Rows are summed inside their bucket
    and the bucket totals are accumulated separately, so the largest sort unit
    is one bucket of one key instead of the whole key.
    """
    keys = list(keys)
    rows = df.withColumn("_bucket", bucket)
    totals = rows.groupBy(*keys, "_bucket").agg(*[F.sum(v).alias(f"_t_{n}") for n, v in sums.items()])
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_bucket", *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in sums]
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.join(offsets, [*keys, "_bucket"])
        .withColumns({n: F.col(f"_o_{n}") + F.sum(v).over(inside) for n, v in sums.items()})
        .drop("_bucket", *[f"_o_{n}" for n in sums])
    )


def salted_join(many: DataFrame, few: DataFrame, keys: Sequence[str], spread_by: str, salts: int = 16) -> DataFrame:
    """Inner join whose hot keys are split.

    ``many`` may hold any share of its rows under one key; ``few`` has a bounded
    number of rows per key.  The rows of ``many`` take one of ``salts`` salts from
    ``spread_by`` and ``few`` is repeated for each, so one key spreads over up to
    ``salts`` tasks.
    """
    left = many.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    right = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right.hint("shuffle_hash"), [*keys, "_salt"]).drop("_salt")
