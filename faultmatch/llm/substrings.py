"""Substring dedup on a de Bruijn graph of words: repeated edges, verified on their words, compacted to spans, kept only where they come first."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from faultmatch.llm.common import ready
from faultmatch.llm.order import with_stretch

#: Words of a window, an edge of the graph; the node before it has one word less.
WINDOW = 13
#: Documents of a stretch, the part of the document order that one task holds at a time.
STRETCH = 1000
#: Edges of a bucket, and bytes of a word with its space, for the number of buckets.
BUCKET_EDGES, WORD_BYTES = 1 << 20, 6
#: Bits of the numbers that propose equal edges. Fewer only propose more; words decide.
EDGE_BITS = 64
_LEAST = -(1 << 63)
_TURN, _MIX = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9
_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


@dataclass(frozen=True)
class Words:
    """The words of some documents, one after the other."""

    data: np.ndarray  # their bytes, a space after each word
    begins: np.ndarray  # where each word begins in ``data``, and the end
    ids: np.ndarray  # equal words, and only those, have equal numbers
    hashes: np.ndarray
    sizes: np.ndarray  # words of each document

    def text(self, a: int, b: int) -> bytes:
        """The words from ``a`` to before ``b``, joined by a space."""
        return self.data[self.begins[a] : self.begins[b] - 1].tobytes() if b > a else b""


def words_of(texts: pa.Array | pa.ChunkedArray) -> Words:
    """Words of an Arrow column of texts; null texts have none."""
    whole = pa.chunked_array([texts]) if isinstance(texts, pa.Array) else texts
    whole = whole.cast(pa.large_binary()).combine_chunks()
    whole = pa.concat_arrays(whole.chunks) if isinstance(whole, pa.ChunkedArray) else whole
    whole = pc.fill_null(whole, b"")
    _, offsets, data = whole.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    blank = _BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = np.flatnonzero(~blank & (edge[:-1] | np.concatenate([[True], blank[:-1]])[: len(data)]))
    ends = np.flatnonzero(~blank & (edge[1:] | np.concatenate([blank[1:], [True]])[: len(data)])) + 1
    lengths = ends - begins
    places = np.concatenate([[0], np.cumsum(lengths)])
    letters = data[~blank]
    spaced = np.full(len(letters) + len(lengths), 0x20, dtype=np.uint8)
    spaced[np.arange(len(letters)) + np.repeat(np.arange(len(lengths)), lengths)] = letters
    each = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(letters)])
    coded = each.dictionary_encode()
    ids = coded.indices.to_numpy()
    known = coded.dictionary.to_pylist()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, known), dtype=np.uint64, count=len(known))
    sizes = np.diff(np.searchsorted(begins, offsets))
    return Words(spaced, places + np.arange(len(places)), ids, hashes[ids], sizes)


def edges(words: Words, window: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number of every window, with its document and its first word there. Only the upper ``bits`` of numbers differ."""
    sizes, n = words.sizes, len(words.ids)
    if n < window:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    total, factor = np.zeros(n - window + 1, dtype=np.uint64), 1
    for k in range(window):
        total += words.hashes[k : n - window + 1 + k] * np.uint64(factor)
        factor = factor * _TURN % (1 << 64)
    total = (total ^ (total >> np.uint64(31))) * np.uint64(_MIX)
    total ^= total >> np.uint64(29)
    total &= np.uint64(((1 << bits) - 1) << (64 - bits))
    document = np.repeat(np.arange(len(sizes)), sizes)
    first = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    inside = first + window <= np.repeat(sizes, sizes)
    inside = inside[: len(total)]
    return total[inside], document[: len(total)][inside], first[: len(total)][inside]


def first_alike(numbers: np.ndarray, at: np.ndarray, ids: np.ndarray, window: int) -> np.ndarray:
    """For each window the first one of the same words. ``at`` are the windows' first words in ``ids``.

    Numbers only bring windows together; what decides are the words.
    """
    if not len(numbers):
        return np.empty(0, np.int64)

    def differ(order: np.ndarray) -> np.ndarray:
        """Which windows of an order have other words than the one before, though the same number."""
        out = np.zeros(len(order), bool)
        met = np.flatnonzero(numbers[order][1:] == numbers[order][:-1]) + 1
        a, b = at[order[met]], at[order[met - 1]]
        for k in range(window):
            out[met] |= ids[a + k] != ids[b + k]
        return out

    order = np.argsort(numbers, kind="stable")
    other = differ(order)
    group = np.cumsum(np.concatenate([[True], numbers[order][1:] != numbers[order][:-1]])) - 1
    if other.any():  # one number, several windows: put the same words side by side
        mixed = np.flatnonzero(np.bincount(group, weights=other)[group] > 0)
        some = order[mixed]
        order[mixed] = some[np.lexsort([*(ids[at[some] + k] for k in range(window)), numbers[some]])]
        other = differ(order)
    new = other | np.concatenate([[True], group[1:] != group[:-1]])
    out = np.empty(len(order), np.int64)
    out[order] = order[new][np.cumsum(new) - 1]
    return out


def _packed(cell: np.ndarray, columns: dict[str, np.ndarray], named: dict[str, int], cells: str) -> pa.RecordBatch:
    """A row for each run of equal ``cell``, the columns' values as bytes."""
    cuts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.empty(0, np.int64)
    ends = np.append(cuts[1:], len(cell))
    packed = [pa.array([c[a:b].tobytes() for a, b in zip(cuts, ends, strict=False)], type=pa.binary()) for c in columns.values()]
    same = [pa.array(np.full(len(cuts), v, np.int64)) for v in named.values()]
    return pa.RecordBatch.from_arrays([pa.array(cell[cuts].astype(np.int64)), *same, *packed], names=[cells, *named, *columns])


def _sent(batches: Iterator[pa.RecordBatch], shift: int, window: int, bits: int) -> Iterator[pa.RecordBatch]:
    """32 bits of each of the different edges of each stretch, in rows of one bucket. Texts come sorted by stretch."""

    def rows(stretch: int, parts: list[np.ndarray]) -> pa.RecordBatch:
        own = np.unique(np.concatenate(parts))
        return _packed(own >> np.uint64(32), {"edges": own.astype(np.uint32)}, {"stretch": stretch}, "bucket")

    now, parts = None, []
    for batch in batches:
        stretches = batch.column("__stretch").to_numpy()
        begins = np.flatnonzero(np.concatenate([[True], stretches[1:] != stretches[:-1]])) if len(stretches) else []
        for a, b in zip(begins, [*begins[1:], len(stretches)], strict=True):
            if now is not None and stretches[a] != now:
                yield rows(now, parts)
                parts = []
            now = int(stretches[a])
            parts.append(np.unique(edges(words_of(batch.column("text").slice(a, b - a)), window, bits)[0] >> np.uint64(shift)))
    if now is not None:
        yield rows(now, parts)


def _by_stretch(rows: pa.Table) -> tuple[np.ndarray, list[int]]:
    stretches = rows.column("stretch").to_numpy()
    order = np.argsort(stretches, kind="stable")
    return stretches[order], order.tolist()


def _shared(rows: pa.Table) -> pa.Table:
    """Of one bucket: for each stretch, its edges that may be in another stretch too."""
    stretches, order = _by_stretch(rows)
    lists = rows.column("edges").to_pylist()
    parts = [np.frombuffer(lists[k], dtype=np.uint32) for k in order]
    every = np.concatenate(parts)
    by_edge = np.argsort(every, kind="stable")
    same = every[by_edge][1:] == every[by_edge][:-1]
    found = np.zeros(len(every), bool)
    found[by_edge[1:]] = same
    found[by_edge[:-1]] |= same
    owner = np.repeat(stretches, [len(p) for p in parts])[found]
    bucket = rows.column("bucket")[0].as_py()
    return pa.table(_packed(owner, {"edges": every[found]}, {"bucket": bucket}, "stretch").columns, ["stretch", "bucket", "edges"])


def _met_before(rows: pa.Table) -> pa.Table:
    """Of one part of the digests: for each stretch, the places of windows whose words an earlier stretch has too."""
    stretches, order = _by_stretch(rows)
    digests, places = rows.column("digests").to_pylist(), rows.column("places").to_pylist()
    words = np.concatenate([np.frombuffer(digests[k], dtype=np.uint64) for k in order]).reshape(-1, 2)
    where = [np.frombuffer(places[k], dtype=np.uint32) for k in order]
    by_words = np.lexsort([words[:, 1], words[:, 0]])  # equal ones stay in the order of their stretches
    later = np.sort(by_words[1:][(words[by_words][1:] == words[by_words][:-1]).all(axis=1)])
    owner = np.repeat(stretches, [len(p) for p in where])[later]
    return pa.table(_packed(owner, {"places": np.concatenate(where)[later]}, {}, "stretch").columns, ["stretch", "places"])


def repeated_edges(alike: np.ndarray, rank: np.ndarray, met: np.ndarray) -> np.ndarray:
    """Which windows of a stretch come again: an earlier stretch has them, or a document of lower rank in this one.

    ``alike`` is the first window of the same words, ``rank`` never falls along the windows, and ``met``
    are first windows that an earlier stretch has.
    """
    before = np.zeros(len(alike), bool)
    before[met] = True
    return before[alike] | (rank > rank[alike])


@dataclass(frozen=True)
class Document:
    """A document of a stretch: its words from ``begin`` on, and its repeated spans."""

    words: Words
    begin: int
    size: int
    spans: list[tuple[int, int]]

    def kept(self) -> list[bytes]:
        """What lies between the spans, as words joined by a space."""
        cuts = [0, *(x for span in self.spans for x in span), self.size]
        return [self.words.text(self.begin + a, self.begin + b) for a, b in zip(cuts[::2], cuts[1::2], strict=True) if b > a]


def covered(n_words: int, first: np.ndarray, window: int) -> np.ndarray:
    """The words that lie in one of the windows."""
    steps = np.zeros(n_words + 1, np.int64)
    np.add.at(steps, first, 1)
    np.add.at(steps, first + window, -1)
    return np.cumsum(steps[:-1]) > 0


def spans(marked: np.ndarray) -> list[tuple[int, int]]:
    """Compacted paths: the longest runs of marked words, as first word and the word after the last."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], marked.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def without(text: str, removed: list[tuple[int, int]]) -> str:
    """The text without some runs of words; white space around what stays is left alone."""
    if not removed:
        return text
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for a, b in removed:
        out.append(text[at : places[a][0]])
        at = places[b][0] if b < len(places) else len(text)
    return "".join([*out, text[at:]])


def _in_order(rows: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """The documents of a stretch by id, those of one id by text, and their ids: the same order wherever they are read."""
    at = rows.column("__at").to_numpy()
    order = np.argsort(at, kind="stable")
    if (at[order][1:] == at[order][:-1]).any():
        order = pc.sort_indices(rows.select(["__at", "text"]), sort_keys=[("__at", "ascending"), ("text", "ascending")]).to_numpy()
    return rows.take(pa.array(order)), at[order]


def _judged(docs: DataFrame, window: int, result: Callable[[pa.Table, list[Document]], pa.Table], schema: object, columns: list[str]) -> DataFrame:
    """All three passes. ``result`` makes the output rows of a stretch from its documents, each with its words and spans.

    The texts are shuffled by stretches once, and that exchange serves the
    pass that sends numbers of edges, the one that looks up the words of
    those that may be shared, and the one that meets the answers.
    """
    ready(docs.sparkSession)
    bits = EDGE_BITS
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    power = max(0, (max(1, total // WORD_BYTES) // BUCKET_EDGES).bit_length())
    ids = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST))
    rows, _ = with_stretch(docs.select(ids.alias("__at"), *columns), "__at", STRETCH, "__stretch")
    rows = rows.repartition("__stretch")
    # all columns go in, as leaving some out would make another exchange
    sent = rows.sortWithinPartitions("__stretch").mapInArrow(
        lambda batches: _sent(batches, 32 - power, window, bits), "bucket long, stretch long, edges binary"
    )
    shared = sent.groupBy("bucket").applyInArrow(_shared, "stretch long, bucket long, edges binary")
    whole = rows.groupBy("__stretch")

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        """Digests of the words of edges that may be shared, once for each stretch, and their places in it."""
        left, _ = _in_order(left)
        words = words_of(left.column("text"))
        numbers, document, first = edges(words, window, bits)
        lists = zip(right.column("bucket").to_pylist(), right.column("edges").to_pylist(), strict=True)
        known = [np.frombuffer(e, dtype=np.uint32).astype(np.uint64) | np.uint64(b << 32) for b, e in lists]
        known = np.sort(np.concatenate(known)) if known else np.empty(0, np.uint64)
        places = np.empty(0, np.int64)
        if len(known) and len(numbers):
            short = numbers >> np.uint64(32 - power)
            places = np.flatnonzero(known[np.minimum(np.searchsorted(known, short), len(known) - 1)] == short)
        at = (np.cumsum(words.sizes) - words.sizes)[document[places]] + first[places]
        one = first_alike(numbers[places], at, words.ids, window) == np.arange(len(places))
        places, at = places[one], at[one]
        data = memoryview(words.data)
        ends = zip(words.begins[at].tolist(), (words.begins[at + window] - 1).tolist(), strict=True)
        digests = np.frombuffer(b"".join([blake2b(data[a:b], digest_size=16).digest() for a, b in ends]), dtype=np.uint64).reshape(-1, 2)
        part = digests[:, 0] & np.uint64((1 << power) - 1)
        order = np.argsort(part, kind="stable")
        stretch = left.column("__stretch")[0].as_py() if len(left) else 0
        columns = {"digests": digests[order], "places": places[order].astype(np.uint32)}
        return pa.table(_packed(part[order], columns, {"stretch": stretch}, "part").columns, ["part", "stretch", "digests", "places"])

    verified = whole.cogroup(shared.withColumnRenamed("stretch", "__stretch").groupBy("__stretch")).applyInArrow(
        look_up, "part long, stretch long, digests binary, places binary"
    )
    met = verified.groupBy("part").applyInArrow(_met_before, "stretch long, places binary")

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        left, ids = _in_order(left)
        words = words_of(left.column("text"))
        rank = np.cumsum(np.concatenate([[0], ids[1:] != ids[:-1]])) if len(ids) else np.empty(0, np.int64)
        numbers, document, first = edges(words, window, bits)
        begins = np.cumsum(words.sizes) - words.sizes
        alike = first_alike(numbers, begins[document] + first, words.ids, window)
        lists = [np.frombuffer(b, dtype=np.uint32) for b in right.column("places").to_pylist()]
        known = np.concatenate(lists) if lists else np.empty(0, np.uint32)
        again = repeated_edges(alike, rank[document], known)
        document, first = document[again], first[again]
        cuts = np.searchsorted(document, np.arange(len(ids) + 1))
        own = []
        for k, (n, begin) in enumerate(zip(words.sizes.tolist(), begins.tolist(), strict=True)):
            places = first[cuts[k] : cuts[k + 1]]
            own.append(Document(words, begin, n, spans(covered(n, places, window)) if len(places) else []))
        return result(left, own)

    return whole.cogroup(met.withColumnRenamed("stretch", "__stretch").groupBy("__stretch")).applyInArrow(judge, schema)


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, spans, n_removed, kept`` of each document.

    Words are nodes' labels, a window of ``window`` words is an edge.  An edge
    is repeated in a document if a document with a smaller id has it too.
    Runs of repeated edges compact to ``spans`` (first word, word after the
    last); their words are removed, ``kept`` has the others joined by a space.

    Documents are dealt to stretches of the id order.  A stretch sends a number
    of each of its different edges once, by the bucket of the number, so an edge
    that is in every document comes once from each stretch.  A bucket answers
    each stretch with the edges that another stretch may have.
    Numbers only propose: the words of every edge that two stretches may share
    are looked up where they stand, and 128 bits of their cryptographic digest
    are compared, in buckets of the digest; inside a stretch the words are.

    Null texts have no words.  A null id is smaller than any other; rows with
    equal ids are one document in this respect: they take no words from each other.
    Repeated rows stay; other columns are left out.
    """

    def result(left: pa.Table, own: list[Document]) -> pa.Table:
        kept = pa.array([b" ".join(d.kept()) for d in own], type=pa.binary()).cast(pa.string())
        return pa.table({
            "doc_id": left.column("doc_id"), "n_words": pa.array([d.size for d in own], type=pa.int64()),
            "spans": pa.array([[{"begin": a, "end": b} for a, b in d.spans] for d in own], type=pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))),
            "n_removed": pa.array([sum(b - a for a, b in d.spans) for d in own], type=pa.int64()), "kept": kept,
        })

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    schema = "doc_id long, n_words long, spans array<struct<begin:int,end:int>>, n_removed long, kept string"
    return _judged(ids, window, result, schema, ["doc_id", "text"])


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` with repeated spans cut out of ``text``; ``n_chars`` follows, other columns are unchanged."""
    at, names = docs.columns.index("text"), docs.columns

    def result(left: pa.Table, own: list[Document]) -> pa.Table:
        texts = [without(t, d.spans) if t is not None else None for t, d in zip(left.column("text").to_pylist(), own, strict=True)]
        out = left.select(names).set_column(at, "text", pa.array(texts, type=pa.string()))
        if "n_chars" in names:
            k = names.index("n_chars")
            sizes = [len(t) if t is not None and d.spans else n for t, d, n in zip(texts, own, left.column("n_chars").to_pylist(), strict=True)]
            out = out.set_column(k, "n_chars", pa.array(sizes, type=left.schema.field("n_chars").type))
        return out

    return _judged(docs, window, result, docs.schema, names)


def op10(docs: DataFrame) -> DataFrame:
    return repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
