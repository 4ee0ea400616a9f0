"""Token counts by a compiled tokenizer: a deterministic transducer whose transitions carry the change of the count.

The tokenizer splits a text into pieces and merges byte pairs inside each piece.
Both are compiled into one transducer that reads code points.  A transition says
by how much the number of tokens changes, so the number of tokens of a text, and
of each of its prefixes, is the sum along its path.  Transitions are compiled
when a text first takes them.

Long texts are cut into chunks that tasks read side by side.  What a chunk does
to any state is a small map; maps of neighbouring chunks compose, and composing
them in rounds gives the count of the text.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from faultmatch.llm.common import per_batch, ready, texts_of, written
from faultmatch.llm.tokens import byte_letters

#: Code points of a chunk. Longer texts are cut.
CHUNK = 1 << 16
#: Maps of neighbouring chunks that one round composes.
FAN_IN = 64
#: States that a worker keeps. Beyond, it forgets all and compiles anew.
KEPT_STATES = 300_000

# kinds of code points in the public splitting pattern of byte-level vocabularies
LETTER, DIGIT, OTHER, SPACE, BLANK = range(5)
_BLANKS = frozenset("\t\n\x0b\x0c\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
_KINDS = regex.compile(r"(\p{L})|(\p{N})")
#: After a non-blank and a blank, the state is the same whatever came before.
_SETTLES = regex.compile("[^ {0}][ {0}]".format("".join(sorted(_BLANKS))))
_SETTLES_LAST = regex.compile("(?r)" + _SETTLES.pattern)
#: Endings that the pattern parts from a word after an apostrophe: at once, and after a first letter.
_ENDINGS, _LONG_ENDINGS = frozenset("stmd"), {"r": "e", "v": "e", "l": "l"}
# what is open at the end of what was read: nothing, a piece of one kind, an apostrophe that begins a piece, or (as that letter) an apostrophe and a letter
_NOTHING, _APOSTROPHE = 5, 6


def kind_of(c: str) -> int:
    if c == " ":
        return SPACE
    if c in _BLANKS:
        return BLANK
    found = _KINDS.match(c)
    return OTHER if found is None else LETTER if found.group(1) else DIGIT


class Merges:
    """The byte-pair merges of a vocabulary file as a transducer over the bytes of one piece.

    Each prefix of a piece has one last token.  A state knows the longest end of
    the prefix that begins a token, and, at each place in it from which a longer token may yet
    run, the last token there and how many tokens fewer there are up to it.
    That decides the last token of the next prefix and the change of the count.
    """

    def __init__(self, parts: dict):
        vocabulary = parts["model"]["vocab"]
        byte_of = {letter: b for b, letter in enumerate(byte_letters())}
        self.ranks: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}  # rank, left and right half of a token
        for rank, merge in enumerate(parts["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            left, right, whole = vocabulary[a], vocabulary[b], vocabulary[a + b]
            self.ranks[left, right] = rank
            self.made.setdefault(whole, (rank, left, right))
        self._trie({bytes(map(byte_of.__getitem__, t)): n for t, n in vocabulary.items() if len(t) == 1 or n in self.made})
        #: States by what they know, and what that is; the first one has read nothing.
        self.known: dict[tuple, int] = {}
        self.facts: list[tuple] = []
        self.moves: dict[tuple[int, int], tuple[int, int]] = {}
        self.apart: dict[tuple[int, int], bool] = {}
        self.start = self._state((0, ((0, -1, 0),)))

    def _trie(self, tokens: dict[bytes, int]) -> None:
        """Nodes are the beginnings of tokens; ``behind`` is the longest proper end of a node that is one too."""
        self.next: list[dict[int, int]] = [{}]
        self.token, self.depth, self.behind = [-1], [0], [0]
        for word, number in tokens.items():
            node = 0
            for b in word:
                node = self.next[node].setdefault(b, len(self.next))
                if node == len(self.next):
                    self.next.append({})
                    self.token.append(-1)
                    self.depth.append(0)
                    self.behind.append(0)
            self.token[node] = number
        wait = deque([0])
        while wait:
            node = wait.popleft()
            for b, child in self.next[node].items():
                self.depth[child] = self.depth[node] + 1
                if node:
                    self.behind[child] = self._step(self.behind[node], b)
                wait.append(child)

    def _step(self, node: int, b: int) -> int:
        while node and b not in self.next[node]:
            node = self.behind[node]
        return self.next[node].get(b, 0)

    def _state(self, facts: tuple) -> int:
        number = self.known.get(facts)
        if number is None:
            number = self.known[facts] = len(self.facts)
            self.facts.append(facts)
        return number

    def stand(self, left: int, right: int) -> bool:
        """Whether two tokens stay apart when their text is merged: no merge across their seam comes first."""
        known = self.apart.get((left, right))
        if known is None:
            if len(self.apart) > KEPT_STATES:
                self.apart.clear()
            known = self.apart[left, right] = self._stand(left, right)
        return known

    def _stand(self, left: int, right: int) -> bool:
        after = len(self.ranks) + 1  # merges from this rank on are taken back
        while True:
            across = self.ranks.get((left, right))
            if across is not None and across < after:
                return False
            a, b = self.made.get(left, (-1, 0, 0)), self.made.get(right, (-1, 0, 0))
            if a[0] < 0 and b[0] < 0:
                return True
            # at equal rank the merge on the left was made first, so one across the seam may tie with the right one
            if a[0] > b[0]:
                after, left = a[0], a[2]
            else:
                after, right = b[0] + 1, b[1]

    def move(self, state: int, b: int) -> tuple[int, int]:
        """The state after byte ``b`` and the change of the number of tokens."""
        known = self.moves.get((state, b))
        if known is not None:
            return known
        node, places = self.facts[state]
        at = {back: (last, fewer) for back, last, fewer in places}  # by bytes from the end
        node = end = self._step(node, b)
        while True:  # tokens that end here, the longest first; a single byte always is one
            token, size = self.token[end], self.depth[end]
            if token >= 0:
                last, fewer = at[size - 1]
                if last < 0 or self.stand(last, token):
                    break
            end = self.behind[end]
        change = 1 - fewer
        seen, ahead = [(0, token, 0)], node
        while ahead:
            if self.next[ahead]:
                before, fewer = at[self.depth[ahead] - 1]
                seen.append((self.depth[ahead], before, fewer + change))
            ahead = self.behind[ahead]
        found = self.moves[state, b] = (self._state((node, tuple(seen))), change)
        return found

    def run(self, state: int, text: str) -> tuple[int, int]:
        change = 0
        for b in text.encode("utf-8", "surrogatepass"):
            state, more = self.move(state, b)
            change += more
        return state, change


class Node(dict):
    """A state entered by a transition that changes the count by ``change``; next ones by code point."""

    __slots__ = ("facts", "change", "owner")

    def __init__(self, owner: Transducer, facts: tuple, change: int):
        super().__init__()
        self.owner, self.facts, self.change = owner, facts, change

    def __missing__(self, c: str) -> Node:
        node = self[c] = self.owner.compiled(self.facts, c)
        return node


class Transducer:
    """A byte-level vocabulary file compiled, transition by transition, as texts need them.

    A state knows what is open at the end of what was read, the merge state of
    the open piece and, where that is a run of blanks, of its last blank alone;
    the change of the count if another splitting of the last code points comes
    true; and how far special strings have been read, with the change of the
    count if one is completed.  The count of a state is that of a text that ends there.
    Special strings are tokens wherever they stand; none may lie inside another.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.parts = json.load(f)
        self.special = [t["content"] for t in self.parts.get("added_tokens", [])]
        #: Whether every chunk may be entered in the middle of anything.
        self.settles = not any(_SETTLES.search("x" + s) for s in self.special)
        self._anew()

    def _anew(self) -> None:
        self.merges = Merges(self.parts)
        self.nodes: dict[tuple, Node] = {}
        self.start = self._node(((_NOTHING, 0, 0, 0), ()), 0)

    def _node(self, facts: tuple, change: int) -> Node:
        node = self.nodes.get((facts, change))
        if node is None:
            node = self.nodes[facts, change] = Node(self, facts, change)
        return node

    def _open(self, kind: int, c: str) -> tuple[tuple, int]:
        """A piece that begins with ``c``, and its tokens."""
        own, n = self.merges.run(self.merges.start, c)
        if kind == OTHER and c == "'":
            kind = _APOSTROPHE
        return (kind, own, own, 0), n

    def _next(self, piece: tuple, c: str) -> tuple[tuple, int]:
        """The splitting pattern: what is open after ``c``, and the change of the count."""
        what, own, alone, other = piece
        kind, run = kind_of(c), self.merges.run
        if what == SPACE or what == BLANK:
            if kind == SPACE or kind == BLANK:
                longer, change = run(own, c)
                last, n = run(self.merges.start, c)
                return (kind, longer, last, n - change), change
            if what == SPACE:  # it leaves its run and begins the next piece
                opened, change = run(alone, c)
                return (kind, opened, opened, 0), other + change
            opened, n = self._open(kind, c)  # the last blank leaves its run and is a piece
            return opened, other + n
        if what == _APOSTROPHE:
            if c in _ENDINGS:
                _, change = run(own, c)
                return (_NOTHING, 0, 0, 0), change
            if c in _LONG_ENDINGS:
                (_, letter, _, _), n = self._open(kind, c)
                _, whole = run(own, c + _LONG_ENDINGS[c])
                return (c, letter, letter, whole - n), n
            what = OTHER
        elif isinstance(what, str):
            if c == _LONG_ENDINGS[what]:
                return (_NOTHING, 0, 0, 0), other
            what = LETTER
        if what == kind:
            longer, change = run(own, c)
            return (kind, longer, longer, 0), change
        return self._open(kind, c)

    def compiled(self, facts: tuple, c: str) -> Node:
        piece, begun = facts
        piece, change = self._next(piece, c)
        going = [(s, n + 1, back) for s, n, back in begun if self.special[s][n] == c]
        going += [(s, 1, 0) for s, text in enumerate(self.special) if text[0] == c]
        for s, n, back in going:
            if n == len(self.special[s]):
                return self._node(((_NOTHING, 0, 0, 0), ()), back + 1)
        return self._node((piece, tuple((s, n, back - change) for s, n, back in going)), change)

    # --- texts and chunks

    def run(self, node: Node, text: str) -> tuple[Node, int]:
        """The state after ``text`` and the change of the count."""
        change = 0
        for c in text:
            node = node[c]
            change += node.change
        return node, change

    def count(self, text: str) -> int:
        if len(self.nodes) > KEPT_STATES or len(self.merges.moves) > KEPT_STATES:
            self._anew()
        return self.run(self.start, text)[1]

    def map_of(self, chunk: str) -> tuple[str, int, str | None]:
        """What a chunk does to any state: ``head, count, tail``.

        From the first place on after which the state no longer depends on the
        entry, all is known: the change of the count, and the last state as
        the shortest text (``tail``) that leads to it.  Up to there it depends
        on the entry, and the map keeps the code points (``head``), since the
        possible entries are too many to list.  A chunk without such a place is all head.
        """
        first = _SETTLES.search(chunk) if self.settles else None
        if first is None:
            return chunk, 0, None
        at = first.end()
        tail = self.tail_of(chunk)
        return chunk[:at], self.count(chunk[at - 1 :]) - self.count(chunk[at - 1]), tail

    @staticmethod
    def tail_of(text: str) -> str:
        """The end of a text that leads to the same state."""
        last = _SETTLES_LAST.search(text)
        return text if last is None else text[last.end() - 1 :]

    def compose(self, maps: list[tuple[str, int, str | None]]) -> tuple[str, int, str | None]:
        """The map of chunks in a row; composing is associative."""
        heads, change, tail = [], 0, None
        for head, more, end in maps:
            if tail is None:
                heads.append(head)
                change, tail = more, end
                continue
            here, _ = self.run(self.start, tail)
            change += self.run(here, head)[1] + more
            tail = self.tail_of(tail + head) if end is None else end
        return "".join(heads), change, tail

    def applied(self, whole: tuple[str, int, str | None]) -> int:
        """The count of a text from the map of all of it."""
        return self.count(whole[0]) + whole[1]


@functools.cache
def compiled(path: str) -> Transducer:
    """The transducer of a Python worker; its tasks share what is compiled."""
    return Transducer(path)


_MAP = "head string, count long, tail string"
_KEY = "doc_id long, digest binary, n_bytes long"


def _cut(rows: DataFrame, chunk: int) -> DataFrame:
    """Chunks of texts. Equal rows give equal chunks, which are one with their number of copies."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "digest", "n_bytes", "k", "chunk"]
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                coded = text.encode("utf-8", "surrogatepass")
                digest, n = hashlib.sha256(coded).digest(), len(coded)
                del coded
                for at in range(0, len(text), chunk * FAN_IN):
                    parts = [text[i : i + chunk] for i in range(at, min(len(text), at + chunk * FAN_IN), chunk)]
                    m, k = len(parts), at // chunk
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([doc_id] * m, type=pa.int64()), pa.array([digest] * m, type=pa.binary()),
                            pa.array([n] * m, type=pa.int64()), pa.array(range(k, k + m), type=pa.int64()), pa.array(parts, type=pa.string()),
                        ],
                        names=names,
                    )

    chunks = rows.mapInArrow(cut, _KEY + ", k long, chunk string")
    return chunks.groupBy("doc_id", "digest", "n_bytes", "k", "chunk").agg(F.count("*").alias("copies"))


def _long_counts(rows: DataFrame, vocabulary: str, chunk: int) -> DataFrame:
    """Counts of texts that are cut: chunk maps, composed round by round."""
    cols = ["doc_id", "digest", "n_bytes", "k", "copies"]
    schema = _KEY + ", k long, copies long, " + _MAP

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        coder = compiled(vocabulary)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            maps = list(zip(*map(coder.map_of, batch.column("chunk").to_pylist())))
            types = (pa.string(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in cols), *(pa.array(m, type=t) for m, t in zip(maps, types, strict=True))],
                names=[*cols, "head", "count", "tail"],
            )

        return step

    def compose(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["k"])
        one = compiled(vocabulary).compose([(r["head"], r["count"], r["tail"]) for r in rows])
        row = rows[0] | {"k": rows[0]["k"] // FAN_IN} | dict(zip(("head", "count", "tail"), one, strict=True))
        return pa.Table.from_pylist([{c: row[c] for c in group.column_names}], schema=group.schema)

    maps = written(per_batch(_cut(rows, chunk), make, schema), "chunk-maps")
    last = maps.agg(F.max("k")).first()[0]
    while last:
        group = [*(F.col(c) for c in cols if c != "k"), F.floor(F.col("k") / FAN_IN).alias("part")]
        maps, last = maps.groupBy(*group).applyInArrow(compose, schema), last // FAN_IN
        if last:
            maps = written(maps, "chunk-maps")

    def make_counts() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        coder = compiled(vocabulary)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n = [coder.applied(m) for m in zip(*(batch.column(c).to_pylist() for c in ("head", "count", "tail")))]
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, type=pa.int64()), batch.column("copies")],
                names=["doc_id", "n_bytes", "n_tokens", "copies"],
            )

        return step

    counted = per_batch(maps, make_counts, "doc_id long, n_bytes long, n_tokens long, copies long")
    # a row for each copy
    return counted.select("doc_id", "n_bytes", "n_tokens", F.explode(F.expr("sequence(1, copies)")).alias("copy")).drop("copy")


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of whole texts, no special tokens added.

    Special strings inside a text are one token each.  Null and empty texts have no
    tokens; rows without an id and repeated rows stay, each with its counts;
    other columns are left out; an empty table gives no rows.  Texts of more
    than ``chunk`` bytes are cut into chunks of as many code points.
    """
    ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = F.octet_length("text")

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        coder = compiled(vocabulary)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n = [coder.count(t) for t in texts_of(batch.column(2))]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, type=pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

        return step

    short = rows.filter(size <= chunk).select("doc_id", size.cast("long").alias("n_bytes"), "text")
    return per_batch(short, make, "doc_id long, n_bytes long, n_tokens long").unionByName(_long_counts(rows.filter(size > chunk), vocabulary, chunk))


def op13(docs: DataFrame, vocabulary: str, limit: int = 1024) -> DataFrame:
    return token_counts(docs, vocabulary).withColumn("over_limit", F.col("n_tokens") > limit)
