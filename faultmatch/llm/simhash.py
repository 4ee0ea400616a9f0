"""Near-duplicates by SimHash: Golay-coded keys find fingerprints a few bits apart."""

from __future__ import annotations

import functools
from collections.abc import Callable
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from faultmatch.llm.common import per_batch, ready, texts_of, written
from faultmatch.llm.components import components

SEED = 42
#: Most differing bits of a link; the keys below find all such pairs.
MOST_BITS = 2
#: Larger buckets of equal keys are not paired: their members meet in shared neighbours.
PAIRED = 48
#: Widths of the three segments of a fingerprint.
SEGMENTS = (22, 21, 21)
# the generator polynomial of the binary Golay code of length 23
_GENERATOR = 0b101011100011


# --- fingerprints


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of all shingles, repeats included; of the whole sequence if it is shorter."""
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= size:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(size))))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype=np.uint64, count=max(1, len(words) - size + 1))


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are set where over half of the hashes have them set."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)]).astype("<u8").view(np.uint8)
        ones += np.unpackbits(part.reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def signed(number: int) -> int:
    return number - (1 << 64) if number >> 63 else number


def fingerprints(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp``: 64-bit fingerprints of whole texts; 0 for null texts and those without a word."""
    ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            own = [signed(majority(shingle_hashes(words_of(t), size))) for t in texts_of(batch.column(1))]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, type=pa.int64())], names=["doc_id", "fp"])

        return step

    return per_batch(rows, make, "doc_id long, fp long")


# --- keys


@functools.cache
def _code() -> tuple[np.ndarray, np.ndarray]:
    """Check bits of the 4096 messages; for each of the 2048 syndromes, the up to six error patterns of its keys.

    The code is perfect: each 23-bit word has one codeword within 3 bits.  At
    exactly 3 bits, five more codewords are 4 bits away; their indices are keys
    too.  Then words up to 2 bits apart share a key.
    """
    checks = np.arange(4096) << 11
    for bit in range(22, 10, -1):
        checks = np.where(checks >> bit & 1, checks ^ (_GENERATOR << (bit - 11)), checks)
    words = (np.arange(4096) << 11) | checks
    sevens = words[np.bitwise_count(words) == 7]
    patterns = np.zeros((2048, 6), dtype=np.int64)
    for weight in (1, 2, 3):
        for bits in combinations(range(23), weight):
            error = sum(1 << b for b in bits)
            syndrome = int(checks[error >> 11]) ^ (error & 2047)
            patterns[syndrome] = error
            if weight == 3:
                around = sevens[sevens & error == error]
                patterns[syndrome, 1:] = error ^ around
    return checks, patterns


def codeword_keys(words: np.ndarray) -> np.ndarray:
    """Six codeword indices of each word of up to 23 bits, some repeated."""
    checks, patterns = _code()
    syndromes = checks[words >> 11] ^ (words & 2047)
    return (words[:, None] ^ patterns[syndromes]) >> 11


def golay_keys(fps: np.ndarray) -> np.ndarray:
    """18 keys of each fingerprint, some repeated; fingerprints up to 2 bits apart share one.

    Two errors leave a segment of three untouched, and of the segments behind
    and before it one has an error at most: going round, some segment is equal
    and the next one is at most one bit off.  A key is the number of a segment,
    its bits, and a codeword index of the next segment.
    """
    at, parts = 0, []
    for width in SEGMENTS:
        parts.append((fps.astype(np.uint64) >> np.uint64(at)).astype(np.int64) & ((1 << width) - 1))
        at += width
    coded = [codeword_keys(p) for p in parts]
    return np.concatenate([(k << 40 | parts[k] << 12)[:, None] | coded[(k + 1) % 3] for k in range(3)], axis=1)


def _keyed(nodes: DataFrame) -> DataFrame:
    """``key, fp`` for the keys of each fingerprint."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            fps = batch.column(0).to_numpy()
            keys = np.sort(golay_keys(fps.view(np.uint64)), axis=1)
            new = np.concatenate([np.ones((len(fps), 1), bool), keys[:, 1:] != keys[:, :-1]], axis=1)
            return pa.RecordBatch.from_arrays([pa.array(keys[new]), pa.array(np.repeat(fps, new.sum(axis=1)))], names=["key", "fp"])

        return step

    return per_batch(nodes, make, "key long, fp long")


def links(fps: DataFrame) -> DataFrame:
    """``u, v``: pairs of different fingerprints from which all links of at most 2 bits can be walked.

    ``fps`` has distinct fingerprints ``fp``.  Small buckets are paired and
    verified.  The members of a large bucket are not: each is put under itself
    and its 64 neighbours, and tied to the least fingerprint found there.  Two
    fingerprints at most 2 bits apart share a neighbour, and two that share
    one are at most 2 bits apart, so this finds the same components, with at most 65 members
    a neighbour.
    """
    keyed = written(_keyed(fps.select("fp")), "golay-keys")
    sizes = keyed.groupBy("key").count().filter("count > 1")
    shared = written(keyed.join(sizes, "key"), "golay-shared")
    few = shared.filter(F.col("count") <= PAIRED)
    pairs = few.select("key", F.col("fp").alias("u")).join(few.select("key", F.col("fp").alias("v")), "key")
    pairs = pairs.filter((F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MOST_BITS))
    many = shared.filter(F.col("count") > PAIRED).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *(F.lit(signed(1 << k)).cast("long") for k in range(64)))
    around = many.select("fp", F.explode(flips).alias("flip")).select(F.col("fp").bitwiseXOR(F.col("flip")).alias("middle"), "fp")
    least = around.groupBy("middle").agg(F.min("fp").alias("u"), F.count("*").alias("n")).filter("n > 1")
    tied = around.join(least.select("middle", "u"), "middle").filter("fp <> u").select("u", F.col("fp").alias("v"))
    return pairs.select("u", "v").unionByName(tied).distinct()


def near_groups(docs: DataFrame, size: int = 3) -> DataFrame:
    """``doc_id, fingerprint, component_id``: fingerprints link at 2 or fewer differing bits.

    Null and word-less texts have fingerprint zero and link like any other.
    Rows without an id belong to a component but do not name it; one of such
    rows alone has no name.  Repeated rows stay; other columns are left out.
    """
    own = written(fingerprints(docs, size), "fingerprints")
    nodes = own.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(nodes)).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    rooted = nodes.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = rooted.join(named, "root").select("fp", "component_id")
    return own.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5(docs: DataFrame) -> DataFrame:
    return near_groups(docs, 3)


# --- one document of each group


def one_of_each(docs: DataFrame, size: int = 3) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, of which one document of each group of ``near_groups`` stays: the least.

    Rows that share an id are one document: it stays if it is the least of the
    group of one of its rows, and then with one row.  Rows without an id cannot
    be told apart and stay.  Texts without words have fingerprint zero and are
    one group.
    """
    ready(docs.sparkSession)
    with_id = docs.filter(F.col("doc_id").isNotNull())
    kept = near_groups(with_id, size).filter("doc_id = component_id").select("doc_id")
    rows = with_id.join(kept, "doc_id", "left_semi").select(docs.columns)
    if not with_id.groupBy("doc_id").count().filter("count > 1").isEmpty():
        order = Window.partitionBy("doc_id").orderBy(*[F.col(f"`{c}`") for c in docs.columns])
        rows = rows.withColumn("__turn", F.row_number().over(order)).filter("__turn = 1").drop("__turn")
    return rows.unionByName(docs.filter(F.col("doc_id").isNull()))
