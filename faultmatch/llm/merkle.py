"""A Merkle manifest of a table: trees of digests a source and one over the sources, proofs, and versions by path copying.

Leaves take their places in distributed order, and aligned blocks of the tree
are worked on side by side: a round folds each block of leaves to one node, the
next round takes those nodes as its leaves.  Coming back down, each block
learns the path from its root to the root of all, so that one pass over
the leaves gives every proof, and every version in which one leaf was tampered
with.  A version shares all nodes with the manifest but those on the path of
its leaf; it copies these in its own block and goes on along the block's path.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from faultmatch.llm.common import ready, written

#: Nodes of a run, which become one node of the next level.
ARITY = 3
#: Levels of an aligned block; it has at most ``ARITY ** HEIGHT`` leaves.
HEIGHT = 6
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
PATH = "array<struct<left: string, right: string>>"


# --- leaves


def coded(value: Column) -> Column:
    """A value in a leaf: ``-`` if null, else its bytes in UTF-8, a colon and itself."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*map(coded, columns)), 256)


def leaves(docs: DataFrame, tampered_text: Column | None = None) -> DataFrame:
    """``doc_id, key, leaf, tampered``: the digest of each row, and of the row with another text.

    ``key`` names the source: it sorts as sources do, null before all.
    """
    ready(docs.sparkSession)
    own = [F.col(c) for c in COLUMNS]
    other = leaf([*own[:-1], F.col("text") if tampered_text is None else tampered_text])
    key = F.coalesce(F.concat(F.lit("1"), F.col("source")), F.lit("0"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), leaf(own).alias("leaf"), other.alias("tampered"))


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds ``pos``, a row's place among those of its ``key``, and ``n``, how many there are.

    Rows are dealt by ranges of the key and the order, ties by a number of
    their own, so neither a large key nor equal rows fill one task; places are those
    in the range behind those of earlier ranges.
    """
    marked = written(rows.withColumn("turn", F.monotonically_increasing_id()), f"{name}-rows")
    by = ["key", *order, "turn"]
    placed = marked.repartitionByRange(*by).sortWithinPartitions(*by).drop("turn").withColumn("at", F.monotonically_increasing_id())
    placed = written(placed, f"{name}-places").withColumn("part", F.shiftright("at", 33))
    parts = placed.groupBy("key", "part").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    earlier = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("base", F.coalesce(F.sum("rows").over(earlier), F.lit(0)) - F.col("first"))
    totals = parts.groupBy("key").agg(F.sum("rows").alias("n"))
    offsets = parts.select("key", "part", "base").join(totals, "key")
    return placed.join(offsets, ["key", "part"]).withColumn("pos", F.col("base") + F.col("at")).drop("part", "at", "base")


# --- blocks


def hashed(run: Iterable[str]) -> str:
    return hashlib.sha256("".join(run).encode()).hexdigest()


def levels_of(n: int, height: int) -> int:
    """Levels from ``n`` nodes to one, at most those of a block."""
    levels = 0
    while n > 1 and levels < height:
        n, levels = -(-n // ARITY), levels + 1
    return levels


class Block:
    """The nodes over some leaves of a tree, level by level; they never change."""

    def __init__(self, nodes: list[str], levels: int):
        self.levels = [nodes]
        for _ in range(levels):
            last = self.levels[-1]
            self.levels.append([hashed(last[k : k + ARITY]) for k in range(0, len(last), ARITY)])

    @property
    def root(self) -> str:
        return self.levels[-1][0]

    def path(self, at: int) -> list[tuple[str, str]]:
        """The siblings of a leaf and of its ancestors: those on the left and those on the right."""
        out = []
        for nodes in self.levels[:-1]:
            start = at - at % ARITY
            out.append(("".join(nodes[start:at]), "".join(nodes[at + 1 : start + ARITY])))
            at //= ARITY
        return out

    def version(self, at: int, node: str) -> Version:
        return Version(self, at, node)


class Version:
    """A block in which one leaf is another: its ancestors are copied, all other nodes are those of the block."""

    def __init__(self, base: Block, at: int, node: str):
        self.base, self.at, self.copies = base, at, [node]
        for left, right in base.path(at):
            self.copies.append(hashed((left, self.copies[-1], right)))

    @property
    def root(self) -> str:
        return self.copies[-1]

    def node(self, level: int, k: int) -> str:
        own = k == self.at // ARITY**level
        return self.copies[level] if own else self.base.levels[level][k]


def folded(node: str, path: Iterable[tuple[str, str]]) -> str:
    """Where a node leads along the siblings of its path."""
    for left, right in path:
        node = hashed((left, node, right))
    return node


# --- rounds over blocks


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of one block at a time from batches in the order of key, block and place."""
    block: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if block and (block[-1]["key"], block[-1]["block"]) != (row["key"], row["block"]):
                yield block
                block = []
            block.append(row)
    if block:
        yield block


def _each_block(rows: DataFrame, step: Callable[[list[dict], int], list[dict]], height: int, schema: str) -> DataFrame:
    """``step`` over the rows of each block, in their order. A block is small whatever the size of its key."""
    names = [c.split()[0] for c in schema.replace(PATH, "path").split(", ")]
    dealt = rows.repartition("key", "block").sortWithinPartitions("key", "block", "pos")
    made = dealt.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(made)
        for block in _by_block(batches):
            out = step(block, height)
            if out:
                yield pa.RecordBatch.from_pydict({c: [r[c] for r in out] for c in names}, schema=arrow)

    return dealt.mapInArrow(run, schema)


def _fold(block: list[dict], height: int) -> list[dict]:
    n, levels = block[0]["n"], levels_of(block[0]["n"], height)
    tree = Block([r["node"] for r in block], levels)
    for _ in range(levels):
        n = -(-n // ARITY)
    return [{"key": block[0]["key"], "pos": block[0]["block"], "n": n, "node": tree.root}]


def rounds(nodes: DataFrame, name: str, height: int) -> list[DataFrame]:
    """``key, pos, n, node`` of the leaves, of the roots of their blocks, of the roots of blocks of these, up to one a key.

    A key appears up to the round in which it has one node.
    """
    out = [nodes]
    while (out[-1].agg(F.max("n")).first()[0] or 0) > 1:
        many = out[-1].filter("n > 1").select("key", _block(height), "pos", "n", "node")
        out.append(written(_each_block(many, _fold, height, "key string, pos long, n long, node string"), f"{name}-{len(out)}"))
    return out


def _block(height: int) -> Column:
    return F.floor(F.col("pos") / ARITY**height).cast("long").alias("block")


def last_nodes(levels: list[DataFrame]) -> DataFrame:
    """``key, node``: the root of each key's tree."""
    found = [level.filter("n = 1").select("key", "node") for level in levels]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _with_paths(nodes: DataFrame, above: DataFrame, height: int) -> DataFrame:
    """Rows of blocks, each block led by a row (place -1) with what is known above it."""
    rows = nodes.withColumn("block", _block(height))
    lead = above.withColumnRenamed("pos", "block").withColumn("pos", F.lit(-1).cast("long"))
    return rows.unionByName(lead, allowMissingColumns=True)


def _handed_down(block: list[dict], height: int) -> list[dict]:
    """Paths of the nodes of a block: inside the block and on from its root."""
    lead, nodes = block[0], block[1:]
    if not nodes:
        return []
    tree = Block([r["node"] for r in nodes], levels_of(nodes[0]["n"], height))
    upper = [(p["left"], p["right"]) for p in lead["path"]]
    return [
        {"key": r["key"], "pos": r["pos"], "subroot": lead["subroot"], "root": lead["root"],
         "path": [{"left": a, "right": b} for a, b in tree.path(k) + upper]}
        for k, r in enumerate(nodes)
    ]


_ABOVE = f"key string, pos long, subroot string, root string, path {PATH}"


def paths_down(levels: list[DataFrame], outer: DataFrame, name: str, height: int) -> DataFrame:
    """``key, pos, subroot, root, path`` for the blocks of the lowest level, from those of whole keys (``outer``)."""
    above = None
    for k in range(len(levels) - 1, 0, -1):
        done = levels[k].filter("n = 1").select("key").join(outer, "key")
        here = done if above is None else above.unionByName(done)
        above = written(_each_block(_with_paths(levels[k], here, height), _handed_down, height, _ABOVE), f"{name}-above-{k}")
    done = levels[0].filter("n = 1").select("key").join(outer, "key")
    return done if above is None else above.unionByName(done)


# --- the manifest


@dataclass
class Manifest:
    """``leaves``: rows with their places; ``levels``: rounds of nodes of each source; ``tops``: those over the sources."""

    leaves: DataFrame
    levels: list[DataFrame]
    tops: list[DataFrame]
    height: int

    def roots(self) -> DataFrame:
        """``source, subroot, root``, one row a source."""
        root = last_nodes(self.tops).select("key", F.col("node").alias("root"))
        named = self.tops[0].select("key", _source("name").alias("source"), F.col("node").alias("subroot"))
        return named.join(root, "key").drop("key")

    def blocks(self) -> DataFrame:
        """What each block of leaves needs from above: its path to the root, the root of its source and the root of all."""
        root = last_nodes(self.tops).select("key", F.lit(0).cast("long").alias("pos"), F.lit("").alias("subroot"), F.col("node").alias("root"))
        top = paths_down(self.tops, root.withColumn("path", F.array().cast(PATH)), "merkle-top", self.height)
        each = _each_block(_with_paths(self.tops[0], top, self.height), _named, self.height, f"name string, subroot string, root string, path {PATH}")
        outer = each.select(F.col("name").alias("key"), F.lit(0).cast("long").alias("pos"), "subroot", "root", "path")
        return paths_down(self.levels, written(outer, "merkle-sources"), "merkle", self.height)

    def rows(self) -> DataFrame:
        """Leaves by block, each block led by what is known above it."""
        return _with_paths(self.leaves.select("doc_id", "key", "pos", "n", F.col("leaf").alias("node"), "tampered"), self.blocks(), self.height)

    def proofs(self) -> DataFrame:
        """``doc_id, leaf, subroot, root, path``: the siblings of each leaf, level by level, on the left and on the right."""
        return _each_block(self.rows(), _proofs, self.height, f"doc_id long, leaf string, subroot string, root string, path {PATH}")

    def versions(self) -> DataFrame:
        """``doc_id, version, copies``: the root of the version in which this leaf was tampered with, and the nodes copied on the way."""
        return _each_block(self.rows(), _versions, self.height, "doc_id long, version string, copies array<string>")

    def verified(self) -> DataFrame:
        """Digests of the proofs, and whether each leaf as it is now still leads to the root."""
        schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
        return _each_block(self.rows(), _digests, self.height, schema).withColumn("verified", F.col("folded_root") == F.col("root"))


def _source(name: str) -> Column:
    return F.when(F.col(name) != "0", F.substr(F.col(name), F.lit(2)))


def _named(block: list[dict], height: int) -> list[dict]:
    return [down | {"name": r["name"], "subroot": r["node"]} for r, down in zip(block[1:], _handed_down(block, height), strict=True)]


def _opened(block: list[dict], height: int) -> tuple[dict, list[dict], Block, list[tuple[str, str]]]:
    lead, rows = block[0], block[1:]
    tree = Block([r["node"] for r in rows], levels_of(rows[0]["n"], height))
    return lead, rows, tree, [(p["left"], p["right"]) for p in lead["path"]]


def _proofs(block: list[dict], height: int) -> list[dict]:
    lead, rows, tree, upper = _opened(block, height)
    return [
        {"doc_id": r["doc_id"], "leaf": r["node"], "subroot": lead["subroot"], "root": lead["root"],
         "path": [{"left": a, "right": b} for a, b in tree.path(k) + upper]}
        for k, r in enumerate(rows)
    ]


def _versions(block: list[dict], height: int) -> list[dict]:
    _, rows, tree, upper = _opened(block, height)
    out = []
    for k, r in enumerate(rows):
        copies = tree.version(k, r["tampered"]).copies
        for left, right in upper:
            copies.append(hashed((left, copies[-1], right)))
        out.append({"doc_id": r["doc_id"], "version": copies[-1], "copies": copies})
    return out


def _digests(block: list[dict], height: int) -> list[dict]:
    lead, rows, tree, upper = _opened(block, height)
    rest = "".join(a + b for a, b in upper)
    return [
        {"doc_id": r["doc_id"], "leaf": r["node"], "subroot": lead["subroot"], "root": lead["root"],
         "proof_sha256": hashed([*(a + b for a, b in tree.path(k)), rest]),
         "folded_root": folded(tree.version(k, r["tampered"]).root, upper)}
        for k, r in enumerate(rows)
    ]


def manifest(rows: DataFrame, height: int = HEIGHT) -> Manifest:
    """The manifest of the rows of ``leaves``.

    Sources follow one another with null first, then by their bytes; leaves of
    a source ascend by document id, null ids first, and those with equal
    ids by their digests; equal rows are leaves of their own.  An empty table
    has neither leaves nor a root.
    """
    placed = numbered(rows, ["doc_id", "leaf", "tampered"], "merkle-leaves")
    levels = rounds(placed.select("key", "pos", "n", F.col("leaf").alias("node")), "merkle", height)
    sources = last_nodes(levels).select(F.lit("").alias("key"), F.col("key").alias("name"), "node")
    tops = numbered(sources, ["name"], "merkle-sources")
    return Manifest(placed, levels, rounds(tops, "merkle-top", height), height)


def op11(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Of documents with an even CRC-32 of the id, the line ends of the text are deleted; those without an id are left alone."""
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    tampered = F.when(even, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return manifest(leaves(docs, tampered), height).verified()


#: The same for DuckDB: both trees level by level, sibling strings by place in the run, and the walk of each leaf along them.
SQL = """
WITH RECURSIVE rows_ AS (
  SELECT doc_id, source,
    CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR END
    || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
    || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END
    || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR END AS head,
    text, replace(text, chr(10), '') AS other,
    list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
    ) & 1 AS low_bit
  FROM documents
), leaves AS (
  SELECT doc_id, source,
    sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
    CASE WHEN low_bit = 1 THEN sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(other) || ':' || other END) END AS changed
  FROM rows_
), placed AS (
  SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) AS k, leaf, coalesce(changed, leaf) AS tampered,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n
  FROM leaves
), low AS (
  SELECT k, 0 AS level, pos, n, leaf AS node FROM placed
  UNION ALL
  SELECT k, level + 1, pos // 3, (max(n) + 2) // 3, sha256(string_agg(node, '' ORDER BY pos)) FROM low WHERE n > 1 GROUP BY k, level, pos // 3
), high AS (
  SELECT 0 AS level, k - 1 AS pos, count(*) OVER () AS n, node FROM low WHERE n = 1
  UNION ALL
  SELECT level + 1, pos // 3, (max(n) + 2) // 3, sha256(string_agg(node, '' ORDER BY pos)) FROM high WHERE n > 1 GROUP BY level, pos // 3
), low_runs AS (
  SELECT a.k, a.level, a.pos, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
    coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM low a JOIN low b ON a.k = b.k AND a.level = b.level AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY a.k, a.level, a.pos
), high_runs AS (
  SELECT a.level, a.pos, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
    coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM high a JOIN high b ON a.level = b.level AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY a.level, a.pos
), low_walk AS (
  SELECT row_number() OVER (ORDER BY k, pos) AS id, doc_id, k, 0 AS level, pos, leaf, tampered AS node, '' AS proof FROM placed
  UNION ALL
  SELECT w.id, w.doc_id, w.k, w.level + 1, w.pos // 3, w.leaf, sha256(s.l || w.node || s.r), w.proof || s.l || s.r
  FROM low_walk w JOIN low_runs s ON w.k = s.k AND w.level = s.level AND w.pos = s.pos
), low_end AS (
  SELECT id, doc_id, k, leaf, arg_max(node, level) AS node, arg_max(proof, level) AS proof FROM low_walk GROUP BY id, doc_id, k, leaf
), high_walk AS (
  SELECT id, doc_id, k, leaf, 0 AS level, k - 1 AS pos, node, proof FROM low_end
  UNION ALL
  SELECT w.id, w.doc_id, w.k, w.leaf, w.level + 1, w.pos // 3, sha256(s.l || w.node || s.r), w.proof || s.l || s.r
  FROM high_walk w JOIN high_runs s ON w.level = s.level AND w.pos = s.pos
), high_end AS (
  SELECT id, doc_id, k, leaf, arg_max(node, level) AS node, arg_max(proof, level) AS proof FROM high_walk GROUP BY id, doc_id, k, leaf
)
SELECT e.doc_id, e.leaf, s.node AS subroot, t.node AS root, sha256(e.proof) AS proof_sha256, e.node AS folded_root, e.node = t.node AS verified
FROM high_end e JOIN low s ON s.k = e.k AND s.n = 1, (SELECT node FROM high WHERE n = 1) t
"""
