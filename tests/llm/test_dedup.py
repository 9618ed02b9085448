"""Near and exact deduplication against brute force over all pairs."""

import hashlib
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from llm.conftest import EDGES
from voxelframe.llm import exact_dedup, simhash
from voxelframe.llm.common import select_rows, text_key


def plain_fingerprint(text, width=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(nodes, linked):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    nodes = list(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                parent[find(a)] = find(b)
    return {n: find(n) for n in nodes}


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def near(a, b):
    return (a ^ b).bit_count() <= 3


def expected_groups(rows):
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    root = classes({p for _, p in prints}, near)
    first = {}
    for i, p in prints:
        if i is not None:
            first[root[p]] = min(i, first.get(root[p], i))
    return sorted((i is None, i or 0, f"{p:016x}", first.get(root[p])) for i, p in prints)


def got_groups(frame):
    return sorted((r.doc_id is None, r.doc_id or 0, f"{r.fp % (1 << 64):016x}", r.component_id) for r in simhash.groups(frame).collect())


def test_groups_of_documents(docs, pairs):
    assert got_groups(docs) == expected_groups(pairs)


def test_groups_of_edges(edges):
    assert got_groups(edges) == expected_groups(EDGES)


def test_empty_tables(empty):
    assert simhash.groups(empty).count() == 0
    assert exact_dedup.duplicates(empty).count() == 0


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_links_connect_what_brute_force_connects(spark, radius):
    """Dense balls, chains and random fingerprints: the same classes, and every link within the radius."""
    rng = random.Random(radius)
    prints = {0, (1 << 64) - 1, 1 << 63}
    for _ in range(25):
        centre = rng.getrandbits(64)
        for _ in range(12):
            v = centre
            for _ in range(rng.randint(0, 3)):
                v ^= 1 << rng.randint(0, 63)
            prints.add(v)
        step = centre
        for _ in range(6):
            for _ in range(rng.randint(1, 4)):
                step ^= 1 << rng.randint(0, 63)
            prints.add(step)
    prints |= {rng.getrandbits(64) for _ in range(100)}
    frame = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    found = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(frame, radius).collect()]
    assert all((a ^ b).bit_count() <= radius for a, b in found)
    links = {frozenset(p) for p in found}
    want = classes(prints, lambda a, b: (a ^ b).bit_count() <= radius)
    have = classes(prints, lambda a, b: frozenset((a, b)) in links)
    assert {frozenset(n for n in prints if want[n] == r) for r in set(want.values())} == {frozenset(n for n in prints if have[n] == r) for r in set(have.values())}


def test_links_of_a_dense_group_stay_linear(spark):
    """All 2,017 fingerprints one or two bits around one: links grow with members times variants, not with pairs."""
    prints = [0] + [1 << i for i in range(62)] + [1 << i | 1 << j for i in range(62) for j in range(i)]
    frame = spark.createDataFrame([(p,) for p in prints], "fp long")
    assert simhash.links(frame).count() < 70 * len(prints)


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def check_exact(rows, got):
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    want = []
    for i, t in rows:
        ids = [j for j in groups[lower(t)] if j is not None]
        keep = max(ids, default=None)
        want.append(repr((i, keep, len(groups[lower(t)]), i == keep, hashlib.sha256(lower(t).encode()).hexdigest())))
    assert sorted(want) == sorted(repr((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256)) for r in got)


def test_exact_edges(edges):
    check_exact(EDGES, exact_dedup.duplicates(edges).collect())


@pytest.mark.parametrize("capacity", [1, 3, 1000])
def test_exact_documents_at_any_capacity(docs, pairs, capacity):
    check_exact(pairs, exact_dedup.duplicates(docs, capacity=capacity).collect())


def test_chains_of_colliding_keys(docs, pairs):
    """A key of four values: chains hold many texts, and comparing bytes still tells them apart."""
    got = exact_dedup.duplicates(docs, capacity=2, key=lambda t: F.pmod(F.length(t), F.lit(4)).cast("long")).collect()
    check_exact(pairs, got)
    assert max(r.chain for r in got) > 10


def test_directory_is_a_partition_of_the_key_space(spark):
    keys = spark.range(3000).select(F.xxhash64("id").alias("key")).union(spark.range(40).select(F.col("id").alias("key")))
    buckets = exact_dedup.directory(keys, 16).collect()
    spans = sorted((r.prefix << (64 - r.depth), (r.prefix + 1) << (64 - r.depth)) for r in buckets)
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    assert sum(r.n_keys for r in buckets) == 3040 and max(r.n_keys for r in buckets) <= 16
    assert max(r.depth for r in buckets) > 48  # the keys 0 to 39 share a long prefix


def test_select_rows_folds_repeated_rows(spark, edges):
    kept = edges.groupBy("doc_id", text_key(F.col("text")).alias("text_key")).agg(F.count(F.lit(1)).alias("copies"))
    out = select_rows(edges, kept)
    assert out.columns == edges.columns
    assert sorted(map(repr, {(r.doc_id, r.text) for r in edges.collect()})) == sorted(repr((r.doc_id, r.text)) for r in out.collect())
