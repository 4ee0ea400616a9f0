"""Result cache with a time to live."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from faultmatch import fixed_values as fv


def live(cache: DataFrame, as_of: str, hours: int = fv.CACHE_HOURS) -> DataFrame:
    return cache.filter(F.col("created_at") > F.expr(f"TIMESTAMP '{as_of}' - INTERVAL {hours} HOURS"))


def lookup(requests: DataFrame, cache: DataFrame, as_of: str, hours: int = fv.CACHE_HOURS) -> DataFrame:
    """Requests with the cached results where the entry is younger than ``hours``."""
    found = live(cache, as_of, hours).select("cache_key", "query_hash", "results")
    return requests.join(found, "cache_key", "left").withColumn("is_hit", F.col("query_hash").isNotNull())


def misses(requests: DataFrame, cache: DataFrame, as_of: str, hours: int = fv.CACHE_HOURS) -> DataFrame:
    return requests.join(live(cache, as_of, hours), "cache_key", "left_anti")


def merge(cache: DataFrame, new: DataFrame, as_of: str) -> DataFrame:
    """New results replace old ones, restart their age and count one more use; a known entry keeps its query hash."""
    now = F.expr(f"TIMESTAMP '{as_of}'")
    fresh = new.select("cache_key", F.col("query_hash").alias("new_hash"), F.col("results").alias("new_results"))
    replaced = F.col("new_hash").isNotNull()
    return cache.join(fresh, "cache_key", "full_outer").select(
        "cache_key",
        F.coalesce("query_hash", "new_hash").alias("query_hash"),
        F.when(replaced, F.col("new_results")).otherwise(F.col("results")).alias("results"),
        F.when(replaced, now).otherwise(F.col("created_at")).alias("created_at"),
        (F.coalesce("hit_count", F.lit(0)) + replaced.cast("int")).alias("hit_count"),
        F.coalesce("last_accessed", now).alias("last_accessed"),
    )


def apply_hits(cache: DataFrame, hits: DataFrame) -> DataFrame:
    """Add the hits per key and move the last access to the latest."""
    per_key = hits.groupBy("cache_key").agg(F.count("*").alias("n"), F.max("ts").alias("latest"))
    return cache.join(per_key, "cache_key", "left").select(
        "cache_key", "query_hash", "results", "created_at",
        (F.col("hit_count") + F.coalesce("n", F.lit(0))).alias("hit_count"),
        F.coalesce("latest", "last_accessed").alias("last_accessed"),
    )


def search(
    requests: DataFrame, cache: DataFrame, find: Callable[[DataFrame], DataFrame], as_of: str, hours: int = fv.CACHE_HOURS
) -> tuple[DataFrame, DataFrame]:
    """Answers of all requests, and the cache afterwards.

    Live entries answer; ``find`` searches the distinct keys that have none and
    returns ``cache_key, query_hash, results``; what it finds is stored.
    """
    asked = requests.select("cache_key").distinct()
    found = find(misses(asked, cache, as_of, hours))
    stored = merge(cache, found, as_of)
    known = live(cache, as_of, hours).select("cache_key", "results", F.lit(True).alias("is_hit"))
    known = known.unionByName(found.select("cache_key", "results", F.lit(False).alias("is_hit")))
    return requests.join(known, "cache_key", "left"), stored
