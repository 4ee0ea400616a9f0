"""Stretches of the order of document ids, found without putting all ids into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Stretches whose bounds the driver holds, and parts of a stretch, at most.
STRETCHES, PARTS = 4096, 4096


def _reached(at: Column, bounds: Column, n: int) -> Column:
    """How many of the up to ``n`` ascending bounds are not above ``at``, by halving."""
    steps = F.array(*[F.lit(1 << k) for k in range(n.bit_length() - 1, -1, -1)])

    def step(low: Column, width: Column) -> Column:
        high = low + width
        inside = F.coalesce(F.get(bounds, high - 1) <= at, F.lit(False))
        return F.when(inside, high).otherwise(low)

    return F.aggregate(steps, F.lit(0), step)


def _quantiles(column: str, n: int) -> Column:
    return F.percentile_approx(column, [k / n for k in range(1, n)], max(10000, 20 * n))


def with_stretch(rows: DataFrame, at: str, size: int, name: str = "stretch") -> tuple[DataFrame, int]:
    """Adds ``name``, a long that never falls as ``at`` (a long, not null) rises, with about ``size`` rows for each
    value; and about how many values there are.  Equal ``at`` have equal numbers.

    Bounds are quantiles of all rows.  Beyond ``STRETCHES`` of them, each
    stretch gets bounds of its own parts; that table has at most ``STRETCHES``
    rows of ``PARTS`` numbers, and is broadcast.
    """
    wanted = rows.count() // size
    n = min(STRETCHES, wanted)
    if n < 2:
        return rows.withColumn(name, F.col(at).bitwiseAND(F.lit(0))), 1  # a literal would change the plan
    bounds = sorted(set(rows.agg(_quantiles(at, n).alias("b")).first().b))
    # never null, or joins on it would filter their sides apart and shuffle what one exchange can serve
    first = F.coalesce(_reached(F.col(at), F.lit(bounds), len(bounds)).cast("long"), F.lit(0).cast("long"))
    parts = min(PARTS, -(-wanted // n))
    if parts < 2:
        return rows.withColumn(name, first), len(bounds) + 1
    inner = rows.select(first.alias("__first"), at).groupBy("__first").agg(F.array_sort(F.array_distinct(_quantiles(at, parts))).alias("__bounds"))
    found = rows.withColumn("__first", first).join(F.broadcast(inner), "__first")
    whole = F.col("__first") * PARTS + F.coalesce(_reached(F.col(at), F.col("__bounds"), parts), F.lit(0))
    return found.withColumn(name, whole).drop("__first", "__bounds"), (len(bounds) + 1) * parts
