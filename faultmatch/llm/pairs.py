"""Byte-pair encoding by dynamic programming over prefixes, and decoding."""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Callable

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from faultmatch.llm.common import per_batch, ready, texts_of
from faultmatch.llm.tokens import byte_letters

#: Pieces and token pairs that a worker remembers. Beyond, it forgets all and starts anew.
KEPT = 600_000
#: Longer pieces are not remembered.
KEPT_LENGTH = 48

# the public splitting pattern of byte-level vocabularies, with the white space of Unicode spelled out
_WHITE = r"\t-\r \x85\xa0  -     　"
_SPLIT = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{_WHITE}\p{{L}}\p{{N}}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+"
)


class BytePairs(dict):
    """Encoder and decoder of a byte-level vocabulary file.

    Merging pairs in order of rank gives one token sequence per string, and
    dropping its last token gives the sequence of the shorter prefix.  So each
    prefix has one last token: among the tokens that end there (an automaton
    over the vocabulary follows its suffix links to find them), the one whose
    predecessor, the last token of the prefix before it, stands next to it in
    a merged string.  The tokens are read off backwards.  Time is linear in
    the piece, however long it is.
    """

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        vocabulary = parts["model"]["vocab"]
        self.made = dict.fromkeys(vocabulary.values(), -1)  # rank of the merge that makes a token; -1: a byte
        self.halves: dict[int, tuple[int, int]] = {}
        self.joins: dict[int, int] = {}
        for rank, merge in enumerate(parts["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            left, right, whole = vocabulary[a], vocabulary[b], vocabulary[a + b]
            self.joins[left << 20 | right] = rank
            if self.made[whole] < 0:
                self.made[whole], self.halves[whole] = rank, (left, right)
        self.letters = byte_letters()
        self.automaton = ahocorasick.Automaton()
        for token, number in vocabulary.items():
            if len(token) == 1 or number in self.halves:
                self.automaton.add_word(token, (number, len(token)))
        self.automaton.make_automaton()
        byte_of = {letter: b for b, letter in enumerate(self.letters)}
        self.bytes_of = {number: bytes(map(byte_of.__getitem__, token)) for token, number in vocabulary.items()}
        self.special = {t["content"]: t["id"] for t in parts.get("added_tokens", [])}
        self.bytes_of |= {number: content.encode() for content, number in self.special.items()}
        self.pieces = regex.compile(_SPLIT).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.beside: dict[int, bool] = {}

    def stand_together(self, left: int, right: int) -> bool:
        """Whether merging the two tokens' text leaves exactly these two.

        Merges are taken back, the younger token first, so that only the parts
        at the seam matter.  A merge across the seam that ranks before the last
        one taken back would have come first; at equal rank the left one does.
        """
        never = len(self.joins)
        limit = never + 1
        while self.joins.get(left << 20 | right, limit) >= limit:
            if self.made[left] > self.made[right]:
                limit, left = self.made[left], self.halves[left][1]
            elif self.made[right] >= 0:
                limit, right = self.made[right] + 1, self.halves[right][0]
            else:
                return True
        return False

    def tokens(self, piece: str) -> list[int]:
        """Token ids of one piece of text."""
        if piece.isascii() and piece.isprintable():
            text = piece.replace(" ", self.letters[32])
        else:
            text = "".join([self.letters[b] for b in piece.encode()])
        n = len(text)
        last, sizes, beside = [-1] * (n + 1), [0] * (n + 1), self.beside
        for end, (token, size) in self.automaton.iter(text):  # at each place, the longest token first
            end += 1
            if last[end] >= 0:
                continue  # found, and there is no other
            if size < end:
                pair = last[end - size] << 20 | token
                fits = beside.get(pair)
                if fits is None:
                    if len(beside) >= KEPT:
                        beside.clear()
                    fits = beside[pair] = pair >= 0 and self.stand_together(pair >> 20, token)
                if not fits:
                    continue
            last[end], sizes[end] = token, size
        out = []
        while n:
            out.append(last[n])
            n -= sizes[n]
        return out[::-1]

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.tokens(piece), dtype="<u4").tobytes()
        if len(piece) <= KEPT_LENGTH:
            if len(self) >= KEPT:
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        if self.cut is None or not any(s in text for s in self.special):
            return np.frombuffer(b"".join(map(self.__getitem__, self.pieces(text))), dtype="<u4")
        parts = []
        for part in self.cut(text):
            if part in self.special:
                parts.append(np.array([self.special[part]], dtype="<u4").tobytes())
            else:
                parts.extend(map(self.__getitem__, self.pieces(part)))
        return np.frombuffer(b"".join(parts), dtype="<u4")

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


@functools.cache
def byte_pairs(path: str) -> BytePairs:
    """The coder of a Python worker: its tasks share the vocabulary and the pieces met."""
    return BytePairs(path)


def _columns(docs: DataFrame, id_col: str, col: str) -> DataFrame:
    ready(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(col))


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` of whole texts, no special tokens added.

    The text of a special token is that token.  Null and empty texts have no
    ids; rows without an id and repeated rows stay; other columns are left out.
    """

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        coder = byte_pairs(vocabulary)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = [coder.encode(t).astype(np.int32) for t in texts_of(batch.column(1))]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, type=pa.list_(pa.int32()))], names=["doc_id", "ids"])

        return step

    return per_batch(_columns(docs, id_col, text_col), make, "doc_id long, ids array<int>")


def decode(coded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` of token ids; special tokens give their text, null ids the empty text."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        coder = byte_pairs(vocabulary)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [coder.decode(np.array(ids or [], dtype="<u4")) for ids in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, type=pa.string())], names=["doc_id", "text"])

        return step

    return per_batch(_columns(coded, id_col, ids_col), make, "doc_id long, text string")


def op3(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Digests of the ids and of the text decoded from them, taken where the ids are made."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        coder = byte_pairs(vocabulary)
        names = {n: str(n) for n in coder.bytes_of}

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, coded, back = [], [], []
            for text in texts_of(batch.column(1)):
                ids = coder.encode(text)
                n.append(len(ids))
                coded.append(hashlib.sha256(",".join(map(names.__getitem__, ids.tolist())).encode()).hexdigest())
                back.append(hashlib.sha256(coder.decode(ids).encode()).hexdigest())
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, type=pa.int64()), pa.array(coded, type=pa.string()), pa.array(back, type=pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

        return step

    return per_batch(_columns(docs, "doc_id", "text"), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
