"""Vector index, bucket candidates and the exact similarity join."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from faultmatch import fixed_values as fv
from faultmatch.functions import similarity as sim
from faultmatch.operators.ranking import top_k
from faultmatch.session import cut


def check_dim(df: DataFrame, dim: int, column: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """Rows whose vector has the expected length, and the quarantined rest."""
    good = F.coalesce(F.size(column) == dim, F.lit(False))
    return df.filter(good), df.filter(~good)


def build_index(df: DataFrame, key: str = "kb_id") -> DataFrame:
    """Vector and its three buckets."""
    b = sim.lsh_buckets("embedding")
    return df.filter(F.size("embedding") > 0).withColumn("_b", b).select(
        key, "embedding", *[F.col("_b")[i].alias(f"lsh_hash_{i}") for i in range(fv.LSH_TABLES)]
    )


def index_rows(df: DataFrame, created_at: Column) -> DataFrame:
    """Rows of the vector index table from ``kb_id, error_hash, embedding``."""
    hashes = df.select("kb_id", "error_hash")
    return build_index(df).join(hashes, "kb_id").select(
        F.col("kb_id").alias("index_id"), "error_hash", F.col("embedding").alias("vector"),
        *[f"lsh_hash_{i}" for i in range(fv.LSH_TABLES)], created_at.alias("created_at"),
    )


def index_backlog(kb: DataFrame, index: DataFrame, batch: int | None = None) -> DataFrame:
    """Knowledge rows with a vector and no index row; with ``batch``, only so many of the oldest."""
    missing = (
        kb.filter(F.col("embedding").isNotNull())
        .join(index.select("kb_id"), "kb_id", "left_anti")
    )
    return missing if batch is None else missing.orderBy("created_at", "kb_id").limit(batch)


def slots(df: DataFrame, *keep: str) -> DataFrame:
    """One row per (slot, bucket) of each vector."""
    return df.select(*keep, F.posexplode(sim.lsh_buckets("embedding")).alias("slot", "bucket"))


def by_confidence() -> list[Column]:
    return [F.col("confidence_score").desc_nulls_last(), F.col("error_hash").asc(), F.col("kb_id").asc()]


def bucket_candidates(queries: DataFrame, kb: DataFrame, k: int | None = None, block_rows: int = 4096) -> DataFrame:
    """``query_id, kb_id, rank``: rows that share a bucket with the query, numbered by confidence; with ``k``, the first ones."""
    queries, kb = (df.filter(F.size("embedding") > 0) for df in (queries, kb))
    if k is None:
        return _all_candidates(queries, kb, block_rows)
    probes = slots(queries, "query_id")
    rows = slots(kb, "kb_id", "error_hash", "confidence_score")
    rows = top_k(rows, ["slot", "bucket"], by_confidence(), k)  # the best of a union are among the best of its parts
    hits = probes.join(rows, ["slot", "bucket"]).dropDuplicates(["query_id", "kb_id"])
    return top_k(hits, ["query_id"], by_confidence(), k, "rank").select("query_id", "kb_id", "rank")


def _all_candidates(queries: DataFrame, kb: DataFrame, block_rows: int) -> DataFrame:
    """All pairs that share a bucket, numbered without moving a pair between tasks.

    Rows are put in order and cut into blocks, queries into chunks.  A chunk's
    hits in a block are counted first; the counts of earlier blocks tell where a
    query's numbers go on in the next one.
    """

    def buckets(missing: int) -> Column:
        # a bucket that is not known is shared with nobody
        return F.transform(sim.lsh_buckets("embedding"), lambda b: F.coalesce(b.cast("long"), F.lit(missing))).alias("buckets")

    rows = cut(kb.select("kb_id", "error_hash", "confidence_score", buckets(-(2**40))))
    probes = cut(queries.select("query_id", buckets(2**40)))
    chunks, parts = (max(1, -(-df.count() // block_rows)) for df in (probes, rows))
    placed = cut(rows.repartitionByRange(parts, *by_confidence()).withColumn("block", F.spark_partition_id()))
    place = F.row_number().over(Window.partitionBy("block").orderBy(*by_confidence())).alias("place")
    blocks = cut(
        placed.select("block", place, "kb_id", "buckets")
        .groupBy("block").agg(F.sort_array(F.collect_list(F.struct("place", F.col("kb_id").alias("id"), "buckets"))).alias("rows"))
    )
    asking = cut(
        probes.withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.lit(chunks)).cast("int"))
        .groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct(F.col("query_id").alias("id"), "buckets"))).alias("asking"))
    )
    numbers = blocks.select("block").join(asking.select("chunk"))
    few = max(1, chunks * parts // 4)  # pairs of a chunk and a block for a task
    met = asking.join(numbers, "chunk").join(blocks, "block").repartition(few, "chunk", "block")

    def members(batch: pa.RecordBatch, name: str, at: int) -> tuple[pa.Array, np.ndarray]:
        found = batch.column(name).slice(at, 1).flatten()
        ids = found.field("id")
        return ids, np.array(found.field("buckets").flatten()).reshape(len(ids), -1)

    def hits(mine: np.ndarray, theirs: np.ndarray) -> Iterator[np.ndarray]:
        """Places of a block's rows that share a bucket, for one query after another."""
        order = np.argsort(theirs, axis=0, kind="stable")
        ordered = np.take_along_axis(theirs, order, axis=0)
        spans = [(np.searchsorted(ordered[:, s], mine[:, s]), np.searchsorted(ordered[:, s], mine[:, s], side="right")) for s in range(mine.shape[1])]
        for i in range(len(mine)):
            shared = np.zeros(len(theirs), dtype=bool)
            for s, (first, last) in enumerate(spans):
                shared[order[first[i] : last[i], s]] = True
            yield np.flatnonzero(shared)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                found = [len(h) for h in hits(members(batch, "asking", at)[1], members(batch, "rows", at)[1])]
                keys = [batch.column(c).slice(at, 1) for c in ("chunk", "block")]
                yield pa.RecordBatch.from_arrays([*keys, pa.array([found], pa.list_(pa.int32()))], ["chunk", "block", "found"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                (query_ids, mine), (kb_ids, theirs) = members(batch, "asking", at), members(batch, "rows", at)
                starts = np.array(batch.column("starts").slice(at, 1).flatten().field("start"))
                own, places, ranks, size = [], [], [], 0
                for i, h in enumerate(hits(mine, theirs)):
                    own.append(np.full(len(h), i))
                    places.append(h)
                    ranks.append(starts[i] + np.arange(1, len(h) + 1))
                    size += len(h)
                    if size > 100_000 or i + 1 == len(mine):
                        columns = [query_ids.take(pa.array(np.concatenate(own))), kb_ids.take(pa.array(np.concatenate(places)))]
                        columns.append(pa.array(np.concatenate(ranks), pa.int32()))
                        yield pa.RecordBatch.from_arrays(columns, ["query_id", "kb_id", "rank"])
                        own, places, ranks, size = [], [], [], 0

    counts = met.mapInArrow(count, "chunk int, block int, found array<int>").select("chunk", "block", F.posexplode("found").alias("at", "n"))
    earlier = Window.partitionBy("chunk", "at").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("start", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    starts = cut(starts.groupBy("chunk", "block").agg(F.sort_array(F.collect_list(F.struct("at", "start"))).alias("starts")))
    return asking.join(starts, "chunk").join(blocks, "block").repartition(few, "chunk", "block").mapInArrow(number, "query_id string, kb_id string, rank int")


def unit_rows_function() -> Callable[[pd.Series], np.ndarray]:
    """Vectors of one length as rows of length 1, by a local function, which travels to the executors by value."""

    def unit_rows(vectors: pd.Series) -> np.ndarray:
        m = np.vstack(vectors.to_numpy()).astype(np.float64)
        norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
        return np.divide(m, norm, out=m.copy(), where=norm > 1e-8)

    return unit_rows


def bucket_matches(
    queries: DataFrame, kb: DataFrame, limit: int = fv.INDEX_LIMIT, min_sim: float = fv.VECTOR_MIN_COSINE, block_rows: int = 32768
) -> DataFrame:
    """Index search: the cosine of every row that shares a bucket, then the ``limit`` best by rank score.

    Buckets are cut into blocks of bounded size on both sides and multiplied block
    by block.  A pair counts in the first bucket it shares, and a block keeps for a
    query what can be among its ``limit`` best, so pairs that do not qualify never leave it.
    """
    unit_rows = unit_rows_function()
    buckets = sim.lsh_buckets("embedding").alias("buckets")
    rows = cut(kb.filter(F.size("embedding") > 0).select("kb_id", "error_hash", F.col("confidence_score").cast("double"), F.col("embedding").alias("kb_vector"), buckets))
    probes = cut(queries.filter(F.size("embedding") > 0).select("query_id", F.col("embedding").alias("vector"), buckets))
    blocks, chunks = (max(1, -(-df.count() // block_rows)) for df in (rows, probes))
    left = (
        probes.select("*", F.posexplode("buckets").alias("slot", "bucket"))
        .withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.lit(chunks)).cast("int"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    )
    right = (
        rows.select("*", F.posexplode("buckets").alias("slot", "bucket"))
        .withColumn("block", F.pmod(F.xxhash64("kb_id"), F.lit(blocks)).cast("int"))
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    )

    def multiply(q: pd.DataFrame, k: pd.DataFrame) -> pd.DataFrame:
        types = {"query_id": object, "kb_id": object, "error_hash": object, "confidence_score": float, "similarity": float}
        out = {name: [np.empty(0, dtype=kind)] for name, kind in types.items()}
        if q.empty or k.empty:
            return pd.DataFrame({name: pd.Series([], dtype=kind) for name, kind in types.items()})
        slot = int(q["slot"].iloc[0])
        # rows without confidence come last
        trust = np.nan_to_num(0.7 + 0.3 * k["confidence_score"].to_numpy(dtype=float), nan=-np.inf)
        sizes, own = k["kb_vector"].map(len).to_numpy(), q["vector"].map(len).to_numpy()
        theirs = np.stack(k["buckets"].to_numpy())[:, :slot].astype(str)
        mine = np.stack(q["buckets"].to_numpy())[:, :slot].astype(str)
        for size in np.unique(own):
            same, at = np.flatnonzero(sizes == size), np.flatnonzero(own == size)
            b = unit_rows(k["kb_vector"].iloc[same]).T if len(same) else None
            for start in range(0, len(at), 256):
                part = at[start : start + 256]
                # vectors of another length are not alike at all
                products = np.zeros((len(part), len(k)))
                if b is not None:
                    products[:, same] = unit_rows(q["vector"].iloc[part]) @ b
                i, j = np.nonzero(products >= min_sim)
                new = ~(mine[part[i]] == theirs[j]).any(axis=1) if slot else np.ones(len(i), dtype=bool)
                i, j = i[new], j[new]
                score = products[i, j] * trust[j]
                order = np.lexsort((-score, i))
                i, j, score = i[order], j[order], score[order]
                first = np.searchsorted(i, i)
                # scores are compared when rounded, so a little less than the last place may still share it
                last = first + limit - 1
                enough = last < np.searchsorted(i, i, side="right")
                least = np.where(enough, score[np.minimum(last, max(0, len(i) - 1))] if len(i) else 0.0, -np.inf)
                stay = score >= least - 1e-8
                i, j = i[stay], j[stay]
                for name, frame, index in (("query_id", q, part[i]), ("kb_id", k, j), ("error_hash", k, j), ("confidence_score", k, j)):
                    out[name].append(frame[name].to_numpy()[index])
                out["similarity"].append(products[i, j])
        return pd.DataFrame({name: pd.Series(np.concatenate(out[name]), dtype=kind) for name, kind in types.items()})

    keys = ["slot", "bucket", "block", "chunk"]
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        multiply, "query_id string, kb_id string, error_hash string, confidence_score double, similarity double"
    )
    score = F.round(F.col("similarity") * (0.7 + F.col("confidence_score") * 0.3), 9)
    return top_k(near, ["query_id"], [score.desc(), F.col("error_hash"), F.col("kb_id")], limit, "rank")


# --- exact join -------------------------------------------------------------------


def vector_join(
    queries: DataFrame,
    kb: DataFrame,
    min_sim: float = fv.VECTOR_MIN_COSINE,
    pivots: int = 16,
    block_rows: int = 8192,
) -> DataFrame:
    """All (query_id, kb_id) with cosine >= ``min_sim``.

    The most frequent length of ``kb`` counts; vectors of another length match
    nothing.  Without a vector on one side there are no pairs.

    Knowledge vectors go to the cell of their nearest pivot.  A query visits a
    cell only if the angle to its pivot does not exceed the cell's radius plus
    the search angle, which loses no pair.  Cells are split into blocks of
    bounded size on both sides, so a crowded cell spreads over many tasks and
    only pairs that qualify leave a block.
    """

    unit_rows = unit_rows_function()
    pairs = "query_id string, kb_id string, similarity double"
    sizes = kb.filter(F.size("embedding") > 0).groupBy(F.size("embedding").alias("dim")).count()
    usual = sizes.orderBy(F.desc("count"), "dim").first()
    if usual is None:
        return kb.sparkSession.createDataFrame([], pairs)
    kb, queries = check_dim(kb, usual.dim)[0], check_dim(queries, usual.dim)[0]
    sample = kb.orderBy(F.xxhash64("kb_id")).limit(pivots)
    centres = unit_rows(sample.select("embedding").toPandas()["embedding"])
    reach = math.acos(max(-1.0, min(1.0, min_sim))) + 1e-6

    def assign(frames):
        for pdf in frames:
            angles = np.arccos(np.clip(unit_rows(pdf["embedding"]) @ centres.T, -1.0, 1.0))
            cell = angles.argmin(axis=1)
            yield pdf.assign(cell=cell.astype("int32"), angle=angles[np.arange(len(pdf)), cell])

    placed = (
        kb.filter(F.size("embedding") > 0)
        .select(F.col("kb_id").cast("string").alias("kb_id"), "embedding")
        .mapInPandas(assign, "kb_id string, embedding array<float>, cell int, angle double")
    )
    stats = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect()
    radius = np.full(len(centres), -np.inf)
    blocks = np.zeros(len(centres), dtype=int)
    for row in stats:
        radius[row["cell"]] = row["radius"]
        blocks[row["cell"]] = -(-row["n"] // block_rows)
    probes = queries.filter(F.size("embedding") > 0).select(
        F.col("query_id").cast("string").alias("query_id"), "embedding"
    )
    chunks = max(1, -(-probes.count() // block_rows))

    def visit(frames):
        for pdf in frames:
            angles = np.arccos(np.clip(unit_rows(pdf["embedding"]) @ centres.T, -1.0, 1.0))
            open_cells = angles <= radius + reach
            yield pdf.assign(cells=[np.flatnonzero(o).astype("int32") for o in open_cells])

    block_count = F.element_at(F.array(*[F.lit(int(b)) for b in blocks]), F.col("cell") + 1)
    left = (
        probes.mapInPandas(visit, "query_id string, embedding array<float>, cells array<int>")
        .withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.lit(chunks)).cast("int"))
        .withColumn("cell", F.explode("cells"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), block_count - 1)))
        .drop("cells")
    )
    right = (
        placed.drop("angle")
        .withColumn("block", F.pmod(F.xxhash64("kb_id"), block_count).cast("int"))
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    )

    def multiply(q: pd.DataFrame, k: pd.DataFrame) -> pd.DataFrame:
        if q.empty or k.empty:
            return pd.DataFrame({"query_id": [], "kb_id": [], "similarity": []})
        a, b = unit_rows(q["embedding"]), unit_rows(k["embedding"]).T
        found = []
        for start in range(0, len(a), 512):
            products = a[start : start + 512] @ b
            i, j = np.nonzero(products >= min_sim)
            found.append((i + start, j, products[i, j]))
        i, j, s = (np.concatenate(x) for x in zip(*found))
        return pd.DataFrame({"query_id": q["query_id"].to_numpy()[i], "kb_id": k["kb_id"].to_numpy()[j], "similarity": s})

    keys = ["cell", "block", "chunk"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        multiply, pairs
    )
