"""Merkle manifest of a table: a tree of digests per group of rows, and a tree over the groups' roots.

Digests are lower-case hex SHA-256 texts; a parent is the digest of its up to three children put together. A parent keeps
a copy of its hash state before every child slot. Folding a changed child resumes the state of its slot with the
replacement and the siblings to the right; what stands to the left is never hashed again.

Leaves get their place by one sort over ranges. Runs of 3 ** LEVELS nodes are one block, a block is one small task's work,
and a round replaces blocks by their roots, so a group with a third of all rows is many blocks. On the way back every node
takes the siblings of its block's path from the round above. A hash state cannot leave its process, so these travel as the
texts to the left and to the right of the path, from which a block makes each state once.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelframe.session import cut_lineage

WIDTH = 3
LEVELS = 5
BLOCK = WIDTH**LEVELS


def digest(fields: list[Column]) -> Column:
    """SHA-256 of fields, each ``-`` if null, else its length in UTF-8 bytes, a colon, and the value as text."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def heights(n: int) -> int:
    """Levels above ``n`` nodes until a single one remains."""
    up = 0
    while n > 1:
        n, up = -(-n // WIDTH), up + 1
    return up


class Parent:
    """Digest of the children, with the hash state before each of them."""

    __slots__ = ("states", "rights", "siblings", "digest")

    def __init__(self, children: list[bytes]):
        state = sha256()
        self.states, self.rights, self.siblings = [], [], []
        for slot, child in enumerate(children):
            right = b"".join(children[slot + 1 :])
            self.states.append(state.copy())
            self.rights.append(right)
            self.siblings.append((b"".join(children[:slot]), right))
            state.update(child)
        self.digest = state.hexdigest().encode()

    def fold(self, slot: int, replacement: bytes) -> bytes:
        state = self.states[slot].copy()
        state.update(replacement)
        state.update(self.rights[slot])
        return state.hexdigest().encode()


class Step:
    """A level above a block: the state behind the siblings to the left, and those to the right."""

    __slots__ = ("state", "right")

    def __init__(self, left: bytes, right: bytes):
        self.state, self.right = sha256(left), right

    def fold(self, replacement: bytes) -> bytes:
        state = self.state.copy()
        state.update(replacement)
        state.update(self.right)
        return state.hexdigest().encode()


def block_tree(digests: list[bytes], n: int) -> list[list[Parent]]:
    """Parents of a block, level by level, in a group of ``n`` nodes."""
    levels: list[list[Parent]] = []
    for _ in range(min(LEVELS, heights(n))):
        levels.append([Parent(digests[i : i + WIDTH]) for i in range(0, len(digests), WIDTH)])
        digests = [p.digest for p in levels[-1]]
    return levels


def positions(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Add ``pos`` (place of the row within its key, from 0) and ``n`` (rows of the key).

    Rows are sorted by ranges of key and order; what a window sees is one row per range and key. Equal rows may change places.
    """
    placed = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("row", F.monotonically_increasing_id())
    placed = cut_lineage(placed.withColumn("part", F.shiftright("row", 33)))
    parts = placed.groupBy(key, "part").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        key, "part", (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("rows").over(Window.partitionBy(key)).alias("n"),
    )
    return placed.join(parts, [key, "part"]).withColumn("pos", F.col("row") + F.col("shift")).drop("row", "part", "shift")


def _block() -> Column:
    return F.floor(F.col("pos") / BLOCK).cast("long")


def _roots(nodes: DataFrame) -> DataFrame:
    """The table of nodes (key, pos, n, digest) one round further up."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        n = int(rows["n"].iloc[0])
        levels = block_tree([d.encode() for d in rows["digest"]], n)
        top = levels[-1][0].digest.decode() if levels else rows["digest"].iloc[0]
        for _ in levels:
            n = -(-n // WIDTH)
        return pd.DataFrame({"key": [rows["key"].iloc[0]], "pos": [rows["pos"].iloc[0] // BLOCK], "n": [n], "digest": [top]})

    grouped = nodes.select("key", "pos", "n", "digest").withColumn("block", _block()).groupBy("key", "block")
    return grouped.applyInPandas(work, "key string, pos long, n long, digest string")


def climb(nodes: DataFrame) -> list[DataFrame]:
    """Tables of nodes (key, pos, n, digest), from ``nodes`` up to one node per key. There is one round at least."""
    tables = [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 0
    while True:
        tables.append(cut_lineage(_roots(tables[-1])))
        most = -(-most // BLOCK)
        if most <= 1:
            return tables


def _own(levels: list[list[Parent]], i: int) -> list[tuple[bytes, bytes]]:
    """Siblings to the left and to the right of node ``i`` of a block, level by level."""
    out = []
    for parents in levels:
        i, slot = divmod(i, WIDTH)
        out.append(parents[i].siblings[slot])
    return out


def _with_paths(nodes: DataFrame, paths: DataFrame, work, output: str) -> DataFrame:
    """Every block of ``nodes`` with its row of ``paths`` (key, pos, lefts, rights and others), given to ``work``."""
    blocks = nodes.withColumn("block", _block()).groupBy("key", "block")
    return blocks.cogroup(paths.groupBy("key", "pos")).applyInPandas(work, output)


def descend(tables: list[DataFrame], paths: DataFrame) -> DataFrame:
    """Paths (key, pos, lefts, rights, subroot) of the nodes of ``tables[0]``, from those of the last table's nodes."""

    def work(rows: pd.DataFrame, path: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        levels = block_tree([d.encode() for d in rows["digest"]], int(rows["n"].iloc[0]))
        above = list(path["lefts"].iloc[0]), list(path["rights"].iloc[0])
        own = [_own(levels, i) for i in range(len(rows))]
        return pd.DataFrame({
            "key": rows["key"], "pos": rows["pos"], "lefts": [[a.decode() for a, _ in o] + above[0] for o in own], "rights": [[b.decode() for _, b in o] + above[1] for o in own],
            "subroot": path["subroot"].iloc[0],
        })

    for nodes in reversed(tables[:-1]):
        nodes = nodes.select("key", "pos", "n", "digest")
        paths = cut_lineage(_with_paths(nodes, paths, work, "key string, pos long, lefts array<string>, rights array<string>, subroot string"))
    return paths


def _prove(rows: pd.DataFrame, path: pd.DataFrame) -> pd.DataFrame:
    """Proof and folded root of every leaf of a block."""
    rows = rows.sort_values("pos")
    levels = block_tree([d.encode() for d in rows["digest"]], int(rows["n"].iloc[0]))
    above = [(a.encode(), b.encode()) for a, b in zip(path["lefts"].iloc[0], path["rights"].iloc[0], strict=True)]
    steps, rest = [Step(a, b) for a, b in above], b"".join(a + b for a, b in above)
    proofs, folded = [], []
    for i, new in enumerate(rows["replacement"]):
        proof = sha256(b"".join(a + b for a, b in _own(levels, i)))
        proof.update(rest)
        proofs.append(proof.hexdigest())
        value, at = new.encode(), i
        for parents in levels:
            at, slot = divmod(at, WIDTH)
            value = parents[at].fold(slot, value)
        for step in steps:
            value = step.fold(value)
        folded.append(value.decode())
    return pd.DataFrame({
        "doc_id": rows["doc_id"], "leaf": rows["digest"], "subroot": path["subroot"].iloc[0], "root": path["root"].iloc[0], "proof_sha256": proofs, "folded_root": folded,
    })


def manifest(rows: DataFrame, leaf: Column, replacement: Column, group: Column) -> DataFrame:
    """One row per row of ``rows``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``leaf`` and ``replacement`` are digests as hex text: the row's own, and that of the row as it is found now. ``group``
    is text. Within a group leaves ascend by doc_id, null first; rows with the same id, repeated ones included, by their
    leaf and replacement. Groups are ordered bytewise, null first. ``proof_sha256`` is the digest of all siblings from the
    leaf to the root, ``folded_root`` the root recomputed from the replacement with the leaf's siblings; ``verified`` tells
    whether it is the root. An empty table gives no rows; a single row is its own root. Other columns are not read.
    """
    key = F.when(group.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), group))
    leaves = cut_lineage(rows.select(key.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), leaf.alias("digest"), replacement.alias("replacement")))
    leaves = cut_lineage(positions(leaves, "key", ["doc_id", "digest", "replacement"]))
    tables = climb(leaves)
    named = tables[-1].select(F.col("key").alias("name"), "digest", F.lit("").alias("key"))
    named = cut_lineage(positions(named, "key", ["name"]))
    upper = climb(named)
    root = upper[-1].select("digest").first()
    none = F.array().cast("array<string>")
    paths = descend(upper, upper[-1].select("key", "pos", none.alias("lefts"), none.alias("rights"), F.lit(None).cast("string").alias("subroot")))
    paths = named.select("name", "pos", "digest").join(paths.select("pos", "lefts", "rights"), "pos")
    paths = cut_lineage(paths.select(F.col("name").alias("key"), F.lit(0).cast("long").alias("pos"), "lefts", "rights", F.col("digest").alias("subroot")))
    inner = descend(tables[1:], paths).withColumn("root", F.lit(root[0] if root else None).cast("string"))
    named_leaves = leaves.withColumn("doc_id", F.col("doc_id").cast("string"))  # pandas would turn ids beside a null into doubles
    found = _with_paths(named_leaves, inner, _prove, "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
    return found.withColumns({"doc_id": F.col("doc_id").cast("long"), "verified": F.col("folded_root") == F.col("root")})


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def manifest_of_documents(docs: DataFrame) -> DataFrame:
    """The manifest of documents, in groups by source. Rows whose id has an even CRC-32 are found with the line feeds of
    their text deleted; null texts and rows of null id are found as they are."""
    text = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    fields = [F.col(f) for f in FIELDS]
    return manifest(docs, digest(fields), digest([*fields[:-1], text]), F.col("source").cast("string"))
