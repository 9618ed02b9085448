"""The manifest against a plain recursive version, its folding, and its edges."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from llm.conftest import EDGES
from voxelframe.llm import merkle
from voxelframe.llm.queries import QUERIES


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, source, lang, n_chars, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def plain_tree(nodes):
    """(root, siblings of every node level by level) of a list of digests."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            run = range(p // 3 * 3, min(p // 3 * 3 + 3, len(nodes)))
            paths[i].append(([nodes[j] for j in run if j < p], [nodes[j] for j in run if j > p]))
            at[i] = p // 3
        nodes = [h(*nodes[j : j + 3]) for j in range(0, len(nodes), 3)]
    return nodes[0] if nodes else None, paths


def plain_manifest(rows):
    groups = {}
    for row in rows:
        doc_id, source, lang, n_chars, text = row
        changed = text
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 and text is not None:
            changed = text.replace("\n", "")
        groups.setdefault(source, []).append(((doc_id is not None, doc_id or 0), leaf_of(*row), leaf_of(doc_id, source, lang, n_chars, changed), doc_id))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort()
        trees[name] = plain_tree([r[1] for r in groups[name]])
    root, above = plain_tree([trees[n][0] for n in names])
    out = []
    for name, up in zip(names, above):
        subroot, paths = trees[name]
        for (_, leaf, value, doc_id), path in zip(groups[name], paths):
            for left, right in path + up:
                value = h(*left, value, *right)
            proof = h(*(d for left, right in path + up for d in left + right))
            out.append((doc_id, leaf, subroot, root, proof, value, value == root))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def found(frame):
    return sorted((tuple(r[c] for c in COLUMNS) for r in merkle.manifest_of_documents(frame).collect()), key=repr)


def test_documents(docs):
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()]
    assert found(docs) == plain_manifest(rows)


@pytest.mark.parametrize("sizes", [[1], [2], [3, 1], [243], [244, 1, 9], [730, 4, 28, 81]])
def test_trees_of_all_shapes(spark, sizes):
    """Blocks that end early, single blocks, single leaves; ids with gaps and in no order."""
    rng = random.Random(sum(sizes))
    rows = [(7 * i - 900, f"s{k}", "en", i, f"t{i}\n" * (i % 3)) for k, n in enumerate(sizes) for i in range(n)]
    rng.shuffle(rows)
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(3)) == plain_manifest(rows)


def test_many_groups(spark):
    rows = [(i, f"s{i % 260}é" if i % 260 else None, None, None, None) for i in range(600)]
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(5)) == plain_manifest(rows)


def test_edges(spark):
    """Null columns, null and empty sources, repeated rows and ids, very long texts, ids beyond the doubles."""
    rows = [(i, [None, "", "a"][k % 3], None if k % 2 else "en", None if k % 5 else k, t) for k, (i, t) in enumerate(EDGES)]
    rows += [rows[3], rows[3], (2**62 + 1, None, "x", 1, "big\n"), (-5, "", "x", 1, "minus\n")]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    extra = {n: F.lit("clash") for n in ("key", "pos", "n", "digest", "block", "row", "part", "leaf", "root", "replacement")}
    assert found(frame.withColumns(extra)) == plain_manifest(rows)


def test_empty_table(spark):
    assert merkle.manifest_of_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_folding_resumes_the_state_of_the_slot():
    children = [h("a").encode(), h("b").encode(), h("c").encode()]
    parent = merkle.Parent(children)
    assert parent.digest.decode() == h(*(c.decode() for c in children))
    for slot in range(3):
        assert parent.fold(slot, children[slot]) == parent.digest
        changed = [*children[:slot], b"0" * 64, *children[slot + 1 :]]
        assert parent.fold(slot, b"0" * 64) == merkle.Parent(changed).digest != parent.digest
        left, right = parent.siblings[slot]
        assert merkle.Step(left, right).fold(b"0" * 64) == merkle.Parent(changed).digest
    assert [merkle.heights(n) for n in (0, 1, 2, 3, 4, 9, 10, 243, 244)] == [0, 0, 1, 1, 2, 2, 3, 5, 6]


def test_registered_query_finds_what_was_changed(spark):
    rows = QUERIES["op12_merkle"](spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        touched = zlib.crc32(str(r.doc_id).encode()) % 2 == 0 and "\n" in (texts[r.doc_id] or "")
        assert r.verified != touched
