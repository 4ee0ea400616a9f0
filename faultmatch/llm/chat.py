"""Chat formatting: columnar byte assembly of turns, a loss mask as byte spans, and reading back."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from faultmatch.llm.common import ready, texts_of

# fixed values: the control strings of the template
REPLY, REPLY_END = "<s>", "</s>"
ASKED, ASKED_END = "[INST]", "[/INST]"
#: Role whose texts are learned.
LEARNED = "assistant"
#: A control string inside a text gets a backslash after its first character, one more than it has.
CONTROL = r"(<|\[)(\\*/?(?:s>|INST\]))"
_CONTROL = re.compile(CONTROL)
_ESCAPED = re.compile(r"(<|\[)\\(\\*/?(?:s>|INST\]))")
_TURN = re.compile(r"<s>(.*?)</s>|\[INST\](.*?)\n(.*?)\[/INST\]", re.S)

CHUNKS = "conv_id long, part long, n_turns int, formatted binary, learned array<struct<begin:int,end:int>>"


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2", text) if "s>" in text or "INST]" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text) if "\\" in text else text


def header(role: str) -> bytes:
    """What stands before a text: the reply mark, or the question mark with the role on a line of its own."""
    if role == LEARNED:
        return REPLY.encode()
    return (ASKED + escape(role.replace("%", "%25").replace("\n", "%0A")) + "\n").encode()


def trailer(role: str) -> bytes:
    return (REPLY_END if role == LEARNED else ASKED_END).encode()


def gathered(target: np.ndarray, at: np.ndarray, source: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
    """Copy segments ``source[begin:begin+size]`` to ``target[at:]``, all at once through scatter indices."""
    ends = np.cumsum(size)
    if len(ends) and ends[-1]:
        inner = np.arange(ends[-1]) - np.repeat(ends - size, size)
        target[np.repeat(at, size) + inner] = source[np.repeat(begin, size) + inner]


def assembled(roles: list[str], texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all turns, where each turn begins (and the last ends), and where each text begins and ends."""
    kinds = {role: k for k, role in enumerate(dict.fromkeys(roles))}
    kind = np.array([kinds[r] for r in roles], dtype=np.int64)
    before, after = [header(r) for r in kinds], [trailer(r) for r in kinds]
    n_before = np.array([len(x) for x in before], dtype=np.int64)[kind]
    n_after = np.array([len(x) for x in after], dtype=np.int64)[kind]
    contents = pa.array([escape(t) for t in texts], type=pa.large_string())
    offsets = np.frombuffer(contents.buffers()[1], dtype=np.int64)[: len(texts) + 1]
    data = contents.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    n_text = np.diff(offsets)
    turn = np.concatenate([[0], np.cumsum(n_before + n_text + n_after)])
    out = np.empty(turn[-1], dtype=np.uint8)
    pool = np.frombuffer(b"".join(before + after), dtype=np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(x) for x in before + after])])
    begin = turn[:-1] + n_before
    gathered(out, turn[:-1], pool, starts[kind], n_before)
    gathered(out, begin, data, offsets[:-1], n_text)
    gathered(out, begin + n_text, pool, starts[kind + len(kinds)], n_after)
    return out, turn, np.stack([begin, begin + n_text], axis=1)


def formatted(turns: DataFrame) -> DataFrame:
    """Formatted conversations: rows ``conv_id, part, n_turns, formatted, learned``.

    A row has consecutive turns of one conversation; ``part`` orders the rows
    of a conversation, nearly all of which have one.  ``learned`` has the byte
    spans of the assistant's texts in ``formatted``.

    Turns are shuffled by ranges of conversation and turn, so that a very long
    conversation is spread over tasks.  Null texts and roles are empty; turns
    with equal numbers are ordered by role and text, a null number comes
    first; null conversation ids are one conversation; repeated rows stay;
    other columns are left out.
    """
    ready(turns.sparkSession)
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    rows = rows.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")
    rows = rows.select(F.spark_partition_id().cast("long").alias("split"), "conv_id", "role", "text")

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            roles = batch.column(2).to_pylist()
            out, turn, spans = assembled(roles, texts_of(batch.column(3)))
            ids = batch.column(1).to_pylist()
            first = [i for i in range(len(ids)) if not i or ids[i] != ids[i - 1]]
            cuts = np.array([*first, len(ids)])
            split = batch.column(0)[0].as_py() << 32
            learned = []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                own = [i for i in range(a, b) if roles[i] == LEARNED]
                learned.append([{"begin": int(x), "end": int(y)} for x, y in spans[own] - turn[a]])
            binary = pa.Array.from_buffers(
                pa.binary(), len(first), [None, pa.py_buffer(turn[cuts].astype(np.int32)), pa.py_buffer(out)]
            )
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[i] for i in first], type=pa.int64()), pa.array(split + n + np.arange(len(first))),
                    pa.array(np.diff(cuts).astype(np.int32)), binary,
                    pa.array(learned, type=pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))),
                ],
                names=["conv_id", "part", "n_turns", "formatted", "learned"],
            )
            n += len(first)

    return rows.mapInArrow(assemble, CHUNKS)


def read_turns(data: bytes) -> list[tuple[str, str]]:
    """Roles and texts of formatted turns."""
    out = []
    for turn in _TURN.finditer(data.decode()):
        reply, role, text = turn.groups()
        if reply is None:
            out.append((unescape(role).replace("%0A", "\n").replace("%25", "%"), unescape(text)))
        else:
            out.append((LEARNED, unescape(reply)))
    return out


def digests(chunks: DataFrame) -> DataFrame:
    """Per conversation, read back from its formatted turns: digests of turns and of what is learned.

    A digest depends on the order of all turns.  Each task streams through the
    sorted rows of its conversations and holds the state of one.
    """
    rows = chunks.repartition("conv_id").sortWithinPartitions("conv_id", "part").select("conv_id", "n_turns", "formatted", "learned")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, done = None, []

        def close() -> None:
            if state is not None:
                conv_id, n, turns, chars, loss, length = state
                done.append((conv_id, n, turns.hexdigest(), chars, loss.hexdigest(), length))

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=t) for k, t in enumerate(types)], names=names)

        for batch in batches:
            for conv_id, n_turns, data, learned in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or state[0] != conv_id:
                    close()
                    state = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                turns = read_turns(data)
                if len(turns) != n_turns:
                    raise ValueError(f"conversation {conv_id}: {len(turns)} turns read back of {n_turns}")
                state[1] += len(turns)
                state[2].update("".join([f"{role}\n{text}\n" for role, text in turns]).encode())
                for span in learned:
                    text = unescape(data[span["begin"] : span["end"]].decode())
                    state[3] += len(text)
                    state[4].update(text.encode())
                state[5] += len(data.decode())
            if done:
                yield batch_of(done)
                done.clear()
        close()
        if done:
            yield batch_of(done)

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return rows.mapInArrow(read, schema)


def with_extra(turns: DataFrame) -> DataFrame:
    """The table with conversation -7, whose two texts are control strings."""
    spark, said = turns.sparkSession, "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, LEARNED, said)], "conv_id long, turn long, role string, text string")
    own: list[Column] = [F.col(c).cast(t).alias(c) for c, t in extra.dtypes]
    return turns.select(*own).unionByName(extra)


def op2(turns: DataFrame) -> DataFrame:
    return digests(formatted(with_extra(turns)))


SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(regexp_replace(text, '(<|\[)(\\*/?(?:s>|INST\]))', '\1\\\2', 'g'))
    + CASE WHEN role = 'assistant' THEN 7 ELSE 14 + length(role) END)::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""
