"""Token-id files: ORC stripes with run-length coded ids, row indexes and Bloom filters on document ids."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from faultmatch.llm.common import new_path, ready, texts_of
from faultmatch.llm.tokens import word_ids

#: Bytes of a stripe, the unit that tasks read side by side; rows of an index entry, the unit that a filter skips.
STRIPE_BYTES = 16 << 20
INDEX_ROWS = 1000
SCHEMA = "part int, doc_id long, position long, n_tokens long, ids array<int>"


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode whole texts and write them to ORC files in ascending document id order.

    Columns of the files: ``part`` (number of the file in document order),
    ``doc_id``, ``position`` (ids of this file before the document),
    ``n_tokens`` and ``ids``.  The texts are shuffled once, by ranges of the
    document id; Spark samples the ids for even ranges, and each task encodes
    and writes its range as it streams by.

    Null texts are empty, null ids come first, rows that share an id are
    ordered by their text, other columns are left out, and an empty table
    gives files without rows.
    """
    ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    parts = parts.select(F.spark_partition_id().alias("part"), "doc_id", "text")
    end = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, before = word_ids(tokenizer), 0
        for batch in batches:
            coded = [words.encode(t) + end for t in texts_of(batch.column(2))]
            n = np.array([len(x) // 4 for x in coded], dtype=np.int64)
            offsets = np.concatenate([[0], np.cumsum(n)])
            ids = pa.ListArray.from_arrays(
                pa.array(offsets.astype(np.int32)), pa.array(np.frombuffer(b"".join(coded), dtype="<i4"))
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(before + offsets[:-1]), pa.array(n), ids],
                names=["part", "doc_id", "position", "n_tokens", "ids"],
            )
            before += int(offsets[-1])

    (
        parts.mapInArrow(encode, SCHEMA)
        .write.option("compression", "zstd")
        .option("orc.stripe.size", str(STRIPE_BYTES))
        .option("orc.row.index.stride", str(INDEX_ROWS))
        .option("orc.create.index", "true")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .orc(path)
    )


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the files. A filter on ``doc_id`` skips files, stripes and index entries by their metadata."""
    return ready(spark).read.schema(SCHEMA).orc(path)


def starts(rows: DataFrame) -> DataFrame:
    """``part``, ``base``: ids of all files before each file. One row a file; only ``part`` and ``n_tokens`` are read."""
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))


def digests(rows: DataFrame) -> DataFrame:
    """Per document of the files: its first place among all ids, the number of ids and their CRC-32."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(4)
            values = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            ends = ids.offsets.to_numpy()
            codes = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(codes, type=pa.int64())],
                names=["part", "doc_id", "position", "n_tokens", "ids_crc32"],
            )

    coded = rows.mapInArrow(crc, "part int, doc_id long, position long, n_tokens long, ids_crc32 long")
    placed = coded.join(starts(rows), "part")
    return placed.select("doc_id", (F.col("base") + F.col("position")).alias("start"), "n_tokens", "ids_crc32")


def op9(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    path = new_path(spark, "token-ids")
    write_ids(docs, path, tokenizer, end_id)
    return digests(read_ids(spark, path))
