"""Spelling variants: words one edit apart, found over a reduced alphabet, and the common form of rare ones."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from faultmatch.llm.common import ready, written

#: Symbols that letters are reduced to.
SYMBOLS = 4
#: Numbers that the keys of a block of words take in memory at a time, about.
BLOCK = 1 << 20
#: Longest words that go with each of their keys.
CARRIED = 40
#: Words that a task counts before it hands them on.
COUNTED = 200_000

_RUNS = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {k: k + 32 for k in range(ord("A"), ord("Z") + 1)}
# multipliers of the 64-bit polynomial hashes (odd) and of the mixing step
_BASE, _MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


# --- words and their counts


def word_counts(docs: DataFrame, least_length: int, least_count: int, misspelt: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n``: runs of Latin letters in whole texts, A-Z in lower case, and how often they occur.

    Only words of ``least_length`` code points and ``least_count`` occurrences
    on.  With ``misspelt``, a run whose CRC-32 with its document's id is a
    multiple of it loses one code point before it is counted.  Null texts have
    no words; a null id is the empty string; repeated rows count each.
    """
    ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[str] = Counter()

        def handed_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(words.keys(), type=pa.string()), pa.array(words.values(), type=pa.int64())], names=["word", "n"])
            words.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = Counter(m.group() for m in _RUNS.finditer(text.as_py().translate(_LOWER)))
                start = (doc_id or "") + ":"
                for run, n in own.items():
                    if misspelt:
                        code = zlib.crc32((start + run).encode())
                        if code % misspelt == 0:
                            at = code % len(run)
                            run = run[:at] + run[at + 1 :]
                    if len(run) >= least_length:
                        words[run] += n
                if len(words) > COUNTED:
                    yield handed_on()
        yield handed_on()

    counted = rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= least_count)


# --- keys over the reduced alphabet


def _powers(n: int) -> np.ndarray:
    out = np.full(n + 1, _BASE, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def reduced(points: np.ndarray, symbols: int = SYMBOLS) -> np.ndarray:
    """Code points hashed to numbers from 1 to ``symbols``."""
    return (points.astype(np.uint64) * np.uint64(_MIX) >> np.uint64(40)) % np.uint64(symbols) + np.uint64(1)


def _sums(values: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes of each row."""
    out = np.zeros((values.shape[0], values.shape[1] + 1), np.uint64)
    np.cumsum(values * powers[: values.shape[1]], axis=1, out=out[:, 1:])
    return out


def _mixed(form: np.ndarray, half: np.ndarray, side: int, length: int) -> np.ndarray:
    """A key: the reduced word, one half of it in original letters, which half, and the length."""
    x = (form ^ (half * np.uint64(_BASE)) ^ np.uint64(2 * length + side)) * np.uint64(_MIX)
    return (x ^ (x >> np.uint64(32))) * np.uint64(_MIX) | np.uint64(1)  # never zero


class Block:
    """Words of one length as rows of code points, with the hashes that keys are made of."""

    def __init__(self, points: np.ndarray, symbols: int = SYMBOLS):
        n = points.shape[1]
        self.n, self.symbols, self.powers = n, symbols, _powers(n + 1)
        self.letters = reduced(points, symbols)
        self.forms = _sums(self.letters, self.powers)
        self.starts = _sums(points.astype(np.uint64), self.powers)
        self.ends = _sums(points[:, ::-1].astype(np.uint64), self.powers)

    def half(self, side: int, length: int) -> np.ndarray:
        """The first half of a word of ``length`` code points, or the rest of it, which these words have too."""
        first = length // 2
        return self.ends[:, length - first] if side else self.starts[:, first]

    def own_keys(self) -> np.ndarray:
        """Two keys of each word, one with each half."""
        return np.stack([_mixed(self.forms[:, -1], self.half(side, self.n), side, self.n) for side in (0, 1)], axis=1)

    def near_keys(self, least_length: int, start: int, stop: int) -> Iterator[np.ndarray]:
        """Keys of the one-edit neighbourhood of the reduced words, edited at places from ``start`` to ``stop``.

        An edit leaves one half of the edited word in its original letters, and
        that half is in the key.  So a word one edit away has one of these keys
        among its own two.  The neighbourhood is symmetric, and each pair of
        reduced words is generated on one side: by the longer word, which loses a
        symbol, or by the one with the smaller symbol at the place where they differ.
        Zero is no key.
        """
        n = self.n
        at = np.arange(start, min(stop, n))
        letters, power, whole = self.letters[:, at], self.powers[at], self.forms[:, -1:]
        inverse = np.uint64(pow(_BASE, -1, 1 << 64))

        def keyed(forms: np.ndarray, length: int) -> np.ndarray:
            first = at < length // 2  # the edit is in the first half, so the rest is untouched
            out = np.empty(forms.shape, np.uint64)
            for side, chosen in ((0, ~first), (1, first)):
                if chosen.any():
                    out[:, chosen] = _mixed(forms[:, chosen], self.half(side, length)[:, None], side, length)
            return out

        if n - 1 >= least_length:
            yield keyed(self.forms[:, at] + (whole - self.forms[:, at + 1]) * inverse, n - 1)
        for step in range(1, self.symbols):
            larger = letters + np.uint64(step)
            yield np.where(larger <= self.symbols, keyed(whole + np.uint64(step) * power, n), np.uint64(0))


def _blocks(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of equal length as matrices of code points, few enough at a time, with their places in the list."""
    sizes = np.array([len(w) for w in words])
    for n in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == n)
        step = max(1, BLOCK // (n * 16))
        for k in range(0, len(rows), step):
            some = rows[k : k + step]
            coded = "".join([words[i] for i in some]).encode("utf-32-le")
            yield np.frombuffer(coded, "<u4").reshape(len(some), n), some


def _own_keys(words: DataFrame, symbols: int) -> DataFrame:
    """``key, word, n``: the two keys of each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = batch.column(0), batch.column(1)
            for points, rows in _blocks(texts.to_pylist()):
                keys = Block(points, symbols).own_keys()
                at = pa.array(np.repeat(rows, 2))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), texts.take(at), counts.take(at)], names=["key", "near", "near_n"])

    return words.select("word", "n").mapInArrow(run, "key long, near string, near_n long")


def _near_keys(words: DataFrame, names: list[str], least_length: int, symbols: int) -> DataFrame:
    """``key, same`` and the columns ``names`` for the neighbourhood of each word, each key once a word; ``same``: the word's own."""
    kinds = dict(words.dtypes)
    schema = ", ".join(["key long", "same boolean", *(f"{c} {kinds[c]}" for c in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(keys: np.ndarray, columns: list[pa.Array], rows: np.ndarray, same: bool) -> pa.RecordBatch:
            keys = np.sort(keys, axis=1)
            new = np.concatenate([np.ones((len(keys), 1), bool), keys[:, 1:] != keys[:, :-1]], axis=1) & (keys != 0)
            found, at = keys[new].view(np.int64), pa.array(np.repeat(rows, new.sum(axis=1)))
            return pa.RecordBatch.from_arrays(
                [pa.array(found), pa.array(np.full(len(found), same)), *(c.take(at) for c in columns)], names=["key", "same", *names]
            )

        for batch in batches:
            columns = batch.columns[1:]
            for points, rows in _blocks(batch.column(0).to_pylist()):
                block, n = Block(points, symbols), points.shape[1]
                yield out(block.own_keys(), columns, rows, True)
                step = max(1, BLOCK // (len(rows) * 2 * symbols))
                for start in range(0, n, step):
                    parts = list(block.near_keys(least_length, start, start + step))
                    if parts:
                        yield out(np.concatenate(parts, axis=1), columns, rows, False)

    return words.select(F.col("word").alias("letters"), *names).mapInArrow(run, schema)


def near_words(words: DataFrame, least_length: int = 1, symbols: int = SYMBOLS) -> DataFrame:
    """``word, n, near, near_n``: pairs of words exactly one inserted, deleted or replaced code point apart.

    ``words`` has distinct words of ``least_length`` code points on, with ``n``.
    Letters are reduced to a few symbols.  The one-edit neighbourhoods of the
    reduced words meet the reduced vocabulary on 64-bit keys, which also
    hold the half of the word that the edit does not touch, in its own letters:
    words that are alike only in reduced letters then rarely meet, and no pair is
    lost.  Pairs that meet are verified on the words themselves.  A pair
    comes in one direction, now and then more than once.

    Short words go with each of their keys, so that pairs are verified where they
    meet; of long ones, which have more keys, a number goes and the word joins later.
    """
    ready(words.sparkSession)
    named = written(words.select("word", "n", F.xxhash64("word").alias("id")), "spelling-words")
    own = _own_keys(named, symbols)
    short, long = (named.filter(F.length("word") <= CARRIED), named.filter(F.length("word") > CARRIED))
    met = _near_keys(short, ["word", "n"], least_length, symbols).join(own, "key")
    by_id = _near_keys(long, ["id"], least_length, symbols).join(own, "key").join(long, "id")
    columns = ["same", "word", "n", "near", "near_n"]
    both = met.select(columns).unionByName(by_id.select(columns)).filter(~F.col("same") | (F.col("word") < F.col("near")))
    return both.filter(F.levenshtein("word", "near", 1) == 1).select("word", "n", "near", "near_n")


# --- forms


def forms(words: DataFrame, least_length: int = 1, times: int = 10, symbols: int = SYMBOLS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of a vocabulary ``word, n``.

    The form of a word is its most frequent near word (the first in code-point
    order of several) if that is at least ``times`` as frequent, and the root
    is where a walk along forms ends.  Counts grow ``times`` with each step,
    so the walk has few; every round doubles the steps done.
    """
    words = written(words, "spelling-counts")
    pairs = near_words(words, least_length, symbols)
    turned = F.array(
        F.struct("word", (-F.col("near_n")).alias("less"), F.col("near").alias("form")),
        F.struct(F.col("near").alias("word"), (-F.col("n")).alias("less"), F.col("word").alias("form")),
    )
    # a word has few near words, at most some hundreds for each of its letters
    around = pairs.select(F.inline(turned)).groupBy("word").agg(F.collect_set(F.struct("less", "form")).alias("near"))
    near = around.select("word", F.size("near").alias("n_near"), F.array_min("near").alias("best"))
    rows = words.join(near, "word", "left").withColumn("form_n", -F.col("best.less"))
    strong = F.col("form_n") >= times * F.col("n")
    rows = rows.select(
        "word", F.when(strong, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(strong, F.col("form_n")).alias("form_n"),
    )
    rows = written(rows, "spelling-forms")
    steps = rows.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        moved = written(
            steps.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")), "spelling-roots"
        )
        steps = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            break
    return rows.join(steps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12(docs: DataFrame) -> DataFrame:
    return forms(word_counts(docs, 7, 2, misspelt=31), 7, 10)
