"""Language identification with hyperdimensional profiles."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from faultmatch.llm.common import per_batch, ready, texts_of

#: Components of a vector.
DIMENSIONS = 512
#: Letters that get a vector of their own; further ones share these by their code point.
OWN_LETTERS, LETTERS = 0x250, 4096
#: Labelled rows that profiles are learned from, at most. Rows are chosen by the hash of their id.
TRAINING_ROWS = 40_000
UNKNOWN = "und"
#: Unit of the whole numbers in which document vectors are added up, so that sums don't depend on their order.
UNIT = 1 << 16


@functools.cache
def _symbols() -> np.ndarray:
    """Symbol of each code point: 0 for what is not a letter, else a number from 1 to ``LETTERS``."""
    points = np.arange(0x110000)
    letter = np.fromiter((chr(p).isalpha() for p in range(0x110000)), dtype=bool, count=0x110000)
    shared = OWN_LETTERS + points % (LETTERS - OWN_LETTERS)
    return np.where(letter, np.where(points < OWN_LETTERS, points, shared) + 1, 0).astype(np.int32)


@functools.cache
def _vectors() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random vectors of +1 and -1 for the symbols, by their place in a trigram: turned by two, by one, and as they are."""
    own = np.random.default_rng(20).choice(np.array([-1, 1], dtype=np.int8), size=(LETTERS + 1, DIMENSIONS))
    return np.roll(own, 2, axis=1), np.roll(own, 1, axis=1), own


def profile(text: str) -> np.ndarray | None:
    """Unit vector of a whole text, or None if it has no letter.

    The vector of a trigram binds (multiplies) the vectors of its letters,
    each turned by its place; a text bundles (adds) its trigrams' vectors.
    Letters count in lower case, other characters part words.
    """
    symbols = _symbols()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")]
    if not symbols.any():
        return None
    s = np.concatenate([[0], symbols, [0]]).astype(np.int64)
    s = s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])]
    base = LETTERS + 1
    if len(s) < 3:
        return None
    codes, counts = np.unique((s[:-2] * base + s[1:-1]) * base + s[2:], return_counts=True)
    first, second, third = _vectors()
    grams = first[codes // (base * base)] * second[codes // base % base] * third[codes % base]
    total = counts.astype(np.float32) @ grams.astype(np.float32)
    size = float(np.sqrt(total @ total))
    return total / size if size else total


@dataclass(frozen=True)
class Profiles:
    """Languages in alphabetical order and their unit vectors."""

    languages: tuple[str, ...]
    vectors: np.ndarray

    def nearest(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The language of each text and its cosine, from 0 to 1. Of equal cosines the first language counts."""
        own = [profile(t) if t else None for t in texts]
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        rows = np.array([np.zeros(DIMENSIONS, np.float32) if v is None else v for v in own])
        cosines = rows.reshape(len(texts), DIMENSIONS) @ self.vectors.T.astype(np.float32)
        best = cosines.argmax(axis=1) if len(texts) else np.empty(0, np.int64)
        names = [UNKNOWN if v is None else self.languages[k] for v, k in zip(own, best, strict=True)]
        scores = np.where([v is None for v in own], 0.0, cosines[np.arange(len(texts)), best])
        return names, np.clip(scores.astype(np.float64), 0.0, 1.0)


def held_out(id_col: str = "doc_id") -> Column:
    """Documents that are not learned from: the CRC-32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, rows: int = TRAINING_ROWS) -> Profiles:
    """Profiles from the text and language of labelled documents outside the held-out fold.

    At most about ``rows`` documents are used, chosen by the hash of their id;
    with fewer, all are.  Each counts alike, whatever its length.  Sums are
    taken per task, then by Spark; the driver gets a vector for each language.
    """
    ready(docs.sparkSession)
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    n = labelled.count()
    if n > rows:
        labelled = labelled.filter(F.pmod(F.xxhash64("doc_id", F.lit("profiles")), F.lit(1 << 20)) < F.lit(rows * (1 << 20) // n))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                vector = profile(text)
                if vector is not None:
                    whole = np.rint(vector * UNIT).astype(np.int64)
                    sums[name] = sums[name] + whole if name in sums else whole
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), type=pa.string()), pa.array(list(sums.values()), type=pa.list_(pa.int64()))], names=["lang", "vector"]
        )

    parts = labelled.select("lang", "text").mapInArrow(add_up, "lang string, vector array<long>")
    cells = parts.select("lang", F.posexplode("vector").alias("at", "value")).groupBy("lang", "at").agg(F.sum("value").alias("value"))
    found = cells.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("cells")).orderBy("lang").collect()
    vectors = np.array([[c.value for c in r.cells] for r in found], dtype=np.float64).reshape(len(found), DIMENSIONS)
    sizes = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return Profiles(tuple(r.lang for r in found), vectors / np.where(sizes > 0, sizes, 1))


def predict(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of whole texts.

    ``und`` with score 0 for null and empty texts and those without a letter,
    and where nothing could be learned.  Null ids are not held out; repeated
    rows stay; other columns are left out.
    """
    ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            names, scores = profiles.nearest(texts_of(batch.column(2)))
            return pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names, type=pa.string()), pa.array(scores)],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

        return step

    return per_batch(rows, make, "doc_id long, held_out boolean, lang_pred string, score double")


#: A text is in none of the languages if its cosine is below this share of what texts of its length usually have.
OUTLYING = 0.3
#: Steps of a cosine in which usual scores are found.
STEPS = 1000


def _size(text: str) -> int:
    """Length class of a text, the binary logarithm of its number of letters."""
    return int(np.count_nonzero(_symbols()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")])).bit_length()


def least_scores(docs: DataFrame, profiles: Profiles) -> np.ndarray:
    """The least cosine of a text by its length class.

    It is ``OUTLYING`` times the median of all documents of that length, outside
    the held-out fold, that are nearest to the language they are labelled with.
    Cosines grow with the length, much alike in all languages, so a class asks
    for no less than a shorter one.  Classes below the shortest labelled text ask for nothing.  The driver
    sees a histogram of a bounded number of rows.
    """
    ready(docs.sparkSession)

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = texts_of(batch.column(1))
            names, scores = profiles.nearest(texts)
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, type=pa.string()), pa.array(list(map(_size, texts)), type=pa.int32()), pa.array(np.rint(scores * STEPS).astype(np.int32))],
                names=["lang", "language", "size", "step"],
            )

        return step

    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("lang", "text")
    scored = per_batch(labelled, make, "lang string, language string, size int, step int")
    found: dict[int, list[tuple[int, int]]] = {}
    for r in scored.filter(F.col("language") == F.col("lang")).groupBy("size", "step").count().collect():
        found.setdefault(r.size, []).append((r.step, r["count"]))
    usual = np.zeros(64)
    for size, rows in found.items():
        steps, n = np.array(sorted(rows)).T
        below = np.cumsum(n)
        usual[size] = steps[np.searchsorted(below, below[-1] / 2)] / STEPS
    return OUTLYING * np.maximum.accumulate(usual)


def in_known_language(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, whose text is in one of the learned languages.

    Null and empty texts and those without a letter go, and all where nothing
    could be learned.
    """
    least = least_scores(docs, profiles)
    at = docs.columns.index("text")

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = texts_of(batch.column(at))
            names, scores = profiles.nearest(texts)
            return batch.filter(pa.array((np.array(names) != UNKNOWN) & (scores >= least[list(map(_size, texts))])))

        return step

    return per_batch(docs, make, docs.schema)


def op6(docs: DataFrame) -> DataFrame:
    return predict(docs, learn(docs))
