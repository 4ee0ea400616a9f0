"""Best-fit packing with certificates: lower bounds say where packing anew can still save a sequence."""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from faultmatch.llm.common import ready, texts_of, written
from faultmatch.llm.tokens import WordIds

#: Pieces that one task packs at a time.
GROUP_ROWS = 100_000
#: After the first packing, a sequence with more than this share of free places takes part in an exchange.
LOOSE = 1 / 64
PIECES = "doc_id long, piece int, start long, length long, ids binary"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of whole texts, each followed by ``end_id``; only documents over ``capacity`` ids are cut.

    Null texts are empty and give the end id alone.  Repeated rows and rows
    without an id are documents like any other; other columns are left out.
    """
    ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    end, step = np.array([end_id], dtype="<u4").tobytes(), 4 * capacity

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(tokenizer)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                ids = words.encode(text) + end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    for column, value in zip(out, (doc_id, k, at // 4, len(part) // 4, part), strict=True):
                        column.append(value)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=t) for c, t in zip(out, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids"]
            )

    return rows.mapInArrow(cut_up, PIECES)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Fewest sequences that any packing needs. ``counts[n]``: pieces of length n, for n from 0 to the capacity.

    Dual feasible functions map lengths to shares whose sum over one sequence
    never exceeds 1, so their total over all pieces bounds the number of
    sequences.  Used are the identity, the threshold functions (long pieces
    count as whole, short ones as nothing) and the rounding functions
    floor((k+1)x)/k.
    """
    n = np.arange(capacity + 1, dtype=np.int64)
    counts = counts.astype(np.int64)
    number, weight = np.cumsum(counts), np.cumsum(counts * n)
    best = -(-int(weight[-1]) // capacity)
    limits = np.flatnonzero(counts[: capacity // 2 + 1])
    if len(limits):
        long = int(number[-1]) - number[capacity - limits]
        middle = weight[capacity - limits] - np.where(limits > 0, weight[np.maximum(limits - 1, 0)], 0)
        best = max(best, int((long + -(-middle // capacity)).max()))
    for k in range(1, 64):
        scaled = (k + 1) * n
        share = np.where(scaled % capacity == 0, k * n, scaled // capacity * capacity)  # times k * capacity
        best = max(best, -(-int((share * counts).sum()) // (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: sequence and offset of each piece, and how full each sequence is.

    Sequences wait in lists by free places; a bit set of the lists that are not
    empty gives the tightest one that fits.
    """
    order = np.argsort(-lengths, kind="stable")
    place, offset, full = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    waiting: dict[int, list[int]] = defaultdict(list)
    mask = 0
    for i, length in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = mask >> length
        if fits:
            free = (fits & -fits).bit_length() - 1 + length
            number = waiting[free].pop()
            if not waiting[free]:
                mask &= ~(1 << free)
        else:
            free, number = capacity, len(full)
            full.append(0)
        place[i], offset[i] = number, full[number]
        full[number] += length
        waiting[free - length].append(number)
        mask |= 1 << (free - length)
    return place, offset, np.array(full, dtype=np.int64)


def _packed(rows: DataFrame, capacity: int, groups: int, turn: int) -> DataFrame:
    """One packing of all rows in ``groups`` independent groups."""

    def pack_group(rows: pa.Table) -> pa.Table:
        lengths = rows.column("length").to_numpy()
        place, offset, full = best_fit(lengths, capacity)
        bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        return pa.table({
            "row": rows.column("row"), "length": rows.column("length"), "spread": rows.column("spread"),
            "sequence": pa.array(place), "offset": pa.array(offset), "fill": pa.array(full[place]),
            "gap": pa.array(np.full(len(lengths), len(full) - bound)),
        })

    dealt = rows.select("row", "length", F.xxhash64("row", F.lit(turn)).alias("spread"))
    dealt = dealt.withColumn("group", F.pmod("spread", F.lit(groups)))
    one = dealt.groupBy("group").applyInArrow(
        pack_group, "row long, length long, spread long, sequence long, offset long, fill long, gap long"
    )
    group = F.pmod("spread", F.lit(groups))
    # bits of a number: 12 for the turn, 31 for the group, 20 for the sequence
    number = F.lit(turn << 51) + F.shiftleft(group, 20) + F.col("sequence")
    return one.select("row", "length", number.alias("sequence_id"), "offset", "fill", "gap")


def pack(rows: DataFrame, capacity: int, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``row, length, sequence_id, offset``: a place for each piece, in as few sequences as can be.

    ``rows`` has a unique long ``row`` and a ``length`` from 0 to ``capacity``.
    Rows are dealt to groups of about ``group_rows`` by the hash of their
    number, so no key makes a group large.  Each group packs best-fit
    decreasing and compares its count with its lower bound.  As long as all
    sequences together are more than the bound of the whole table, the groups
    exchange: those at their bound give up the pieces of loose sequences,
    those with a gap all pieces of sequences that are not full.  What they
    give up is dealt anew and packed again, and kept if it saves sequences.
    Exchanges end at the bound, in one group, or when one saves nothing.

    The driver sees counts of rows and the histogram of lengths, which has at
    most ``capacity + 1`` entries.  An empty table gives no rows.
    """
    ready(rows.sparkSession)
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in rows.groupBy("length").count().collect():
        counts[length] = n
    bound, final = lower_bound(counts, capacity), None
    pool, n_rows, before = rows, int(counts.sum()), None
    groups = max(1, -(-n_rows // group_rows))
    for turn in itertools.count():  # each exchange has fewer groups
        packed = written(_packed(pool, capacity, groups, turn), f"packing-{turn}")
        if before is not None:  # the exchange has to pay
            if packed.select("sequence_id").distinct().count() >= before.select("sequence_id").distinct().count():
                packed, last = before, True
            else:
                last = False
        else:
            last = False
        free = capacity - F.col("fill")
        loose = (free > LOOSE * capacity) | ((F.col("gap") > 0) & (free > 0))
        done = packed if last else packed.filter(~loose)
        final = done if final is None else final.unionByName(done)
        if last:
            break
        before = packed.filter(loose)
        n_rows = before.count()
        n_used = final.select("sequence_id").distinct().count()
        if n_rows == 0:
            break
        if groups == 1 or n_used + before.select("sequence_id").distinct().count() <= bound:
            final = final.unionByName(before)
            break
        groups = max(1, min(groups - 1, -(-n_rows // group_rows)))
        pool = before.select("row", "length")
    return final.select("row", "length", "sequence_id", "offset")


def placed(coded: DataFrame, capacity: int) -> DataFrame:
    """Rows of pieces with their ``sequence_id`` and ``offset``. ``coded`` is written once, so rows keep their numbers."""
    numbered = written(coded.withColumn("__row", F.monotonically_increasing_id()), "pieces")
    plan = pack(numbered.select(F.col("__row").alias("row"), "length"), capacity)
    plan = plan.select(F.col("row").alias("__row"), "sequence_id", "offset")
    return numbered.join(plan, "__row").drop("__row")


def sequences(placed_pieces: DataFrame) -> DataFrame:
    """The packed sequences themselves: their ids and the places where documents begin, one row a sequence."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    one = placed_pieces.groupBy("sequence_id").agg(parts.alias("parts"))
    empty = F.expr("cast('' as binary)")
    ids = F.aggregate("parts", empty, lambda done, part: F.concat(done, part["ids"]))
    return one.select("sequence_id", ids.alias("ids"), F.col("parts.offset").alias("begins"), F.col("parts.doc_id").alias("doc_ids"))


def op4(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    cut_up = pieces(docs, tokenizer, end_id, capacity)
    coded = cut_up.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return placed(coded, capacity)
