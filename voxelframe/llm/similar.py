"""Near copies by the similarity of word shingles: SimHash ball hashing for the first candidates, MinHash bands for what it
leaves apart, exact Jaccard similarity for links.

A text is the set of its shingles of five words. Texts of one set are one node. Every node has the SimHash fingerprint of
its set, and the ball hashing of operator 1 (``simhash.links``) gives the fingerprints within three bits of one another.
Nodes at the threshold of 0.8 differ in some ten bits, beyond any ball that can be emitted, so the nodes that the ball
hashing does not join are dealt to bands: sets with similarity s share a band of ROWS minima with probability s ** ROWS, so
at the threshold a pair is no candidate with probability (1 - 0.8 ** 6) ** 40 = 5e-6, and less above it. Every link, of
either kind, is verified on the sets themselves.

Bands whose members the ball hashing has joined are done. In the others the members outside the band's largest component
are compared with one node of that component, so the work grows with the members of a group and not with its pairs; after
the first of these rounds come PIVOTS more, with another node each. Of what that leaves in different components, nodes go that can have no link to another one, as more of
their shingles than a link allows are held by no node of another component. The rest is compared within bands, and a pair
leaves the join only if no bound excludes it: the number of shingles both can share, by sizes and by shingles that other
components hold, and the least number of shingles that differ, by the bits in which two sketches of SKETCH bits do. All
bounds are exact, so no candidate is given up; every pair that remains is verified on the sets.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelframe.llm import simhash
from voxelframe.llm.common import small_batches, text_key
from voxelframe.operators.components import components
from voxelframe.session import cut_lineage

WIDTH = 5
#: Similarity from which two texts are near copies, in percent.
PERCENT = 80
BANDS, ROWS = 40, 6
SEED = 42
#: Bits of a sketch: bit b tells whether an odd number of the hashes of a set end in b.
SKETCH = 1024
#: Rounds with a further node of the largest component of every band, after the first.
PIVOTS = 2
#: Rounds of leaving out nodes without a possible link.
PEELS = 2
CHUNK = 1 << 11
_MASKS, _FACTORS = (np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64))
_FACTORS |= np.uint64(1)
_MIX = np.random.default_rng(SEED + 1).integers(0, 1 << 64, (BANDS, ROWS), np.uint64) | np.uint64(1)


def shingle_hashes(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a UTF-8 text; a text shorter than one is a single shingle."""
    import xxhash

    words = text.lower().split()  # on bytes: A-Z only, and the six ASCII white-space characters
    if 0 < len(words) < width:
        words, width = [b" ".join(words)], 1
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64))


def bands(hashes: np.ndarray) -> np.ndarray:
    """One key per band: equal where all minima of the band are. A set without shingles has none."""
    if not len(hashes):
        return np.array([], np.uint64)
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), CHUNK):
        np.minimum(low, ((hashes[at : at + CHUNK, None] ^ _MASKS) * _FACTORS).min(axis=0), out=low)
    return ((low.reshape(BANDS, ROWS) ^ (low.reshape(BANDS, ROWS) >> np.uint64(31))) * _MIX).sum(axis=1, dtype=np.uint64)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The sketch of a set in 64-bit words. The sketches of two sets differ in no more bits than the sets have different members."""
    odd = np.bincount((hashes % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sets(docs: DataFrame, width: int, output: str, made) -> DataFrame:
    """doc_id, text_key, and the columns of ``output`` that ``made`` gives for the hashes of each row."""
    import xxhash

    small_batches(docs.sparkSession)
    kinds = [pa.int64() if kind == "long" else pa.list_(pa.int64()) for _, kind in (c.split(" ") for c in output.split(", "))]

    def work(batches):
        for batch in batches:
            rows = []
            for text in batch.column(2):
                hashes = shingle_hashes(text.as_py() or b"", width)
                rows.append(made(int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64)), hashes))
            columns = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "text_key", *(c.split(" ")[0] for c in output.split(", "))])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(work, f"doc_id long, text_key long, {output}")


def _similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets (node, hashes) have at least ``percent`` of their union in common."""
    left, right = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    sized = pairs.join(left, "a").join(right, "b").withColumn("both", F.size(F.array_intersect("x", "y")))
    return sized.where(100 * F.col("both") >= percent * (F.size("x") + F.size("y") - F.col("both"))).select("a", "b")


def _linkable(open_nodes: DataFrame, percent: int) -> DataFrame:
    """The nodes (node, root, size, hashes) that may have a link to a node of another root, with ``shared``: how many of their
    hashes a node of another root holds. A link needs at least ``percent`` of a node's hashes on the other side."""
    for _ in range(PEELS):
        each = open_nodes.select("node", "root", F.explode("hashes").alias("hash"))
        both = each.groupBy("hash").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("hash")
        counted = each.join(both, "hash", "left_semi").groupBy("node").agg(F.count(F.lit(1)).alias("shared"))
        open_nodes = open_nodes.drop("shared").join(counted, "node").where(f"100 * shared >= {percent} * size")
        open_nodes = cut_lineage(open_nodes)
    return open_nodes


def ball_pairs(nodes: DataFrame, radius: int = simhash.RADIUS) -> DataFrame:
    """Pairs (a, b) of nodes (node, fp): every node with the smallest one of its fingerprint, and these smallest ones over the
    links that ball hashing finds between fingerprints. Their number grows with the nodes, also in large groups."""
    firsts = cut_lineage(nodes.groupBy("fp").agg(F.min("node").alias("first"), F.max("node").alias("last")))
    same = nodes.join(firsts.where("first <> last"), "fp").where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    x, y = (firsts.select(F.col("fp").alias(n), F.col("first").alias(f"{n}_first")) for n in "ab")
    across = simhash.links(firsts.select("fp"), radius).join(x, "a").join(y, "b")
    return same.unionByName(across.select(F.col("a_first").alias("a"), F.col("b_first").alias("b")))


def _members(nodes: DataFrame) -> DataFrame:
    """node, band of the nodes (node, bands) that meet another one in that band."""
    members = nodes.select("node", F.explode("bands").alias("band"))
    met = members.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("band")
    return members.join(met, "band", "left_semi")


def _apart(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members (band, node, root) of the bands whose members have different roots."""
    rooted = members.select("band", "node").join(roots, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root"))
    apart = rooted.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("band")
    return cut_lineage(rooted.join(apart, "band", "left_semi"))


def _pivot_pairs(rooted: DataFrame, turn: int) -> DataFrame:
    """The members outside a band's largest component with one node of it, another one every turn."""
    parts = rooted.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n"), F.min_by("node", F.xxhash64("node", F.lit(turn))).alias("pivot"))
    largest = parts.groupBy("band").agg(F.max(F.struct("n", "root", "pivot")).alias("top")).select("band", "top.*").withColumnRenamed("root", "top_root")
    return rooted.join(largest, "band").where("root <> top_root").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()


def _unlinked_pairs(rooted: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members (band, node, root) of a band with different roots that no bound excludes."""
    nodes = rooted.select("node", "root").distinct().join(sets.withColumn("size", F.size("hashes")), "node")
    alive = _linkable(nodes, percent).select("node", "size", "shared", "sketch")
    dealt = cut_lineage(rooted.join(alive, "node"))
    a, b = (dealt.select("band", *[F.col(c).alias(f"{n}_{c}") for c in ("node", "root", "size", "shared", "sketch")]) for n in "ab")
    most = "least(a_shared, b_shared)"
    differ = " + ".join(f"bit_count(a_sketch[{i}] ^ b_sketch[{i}])" for i in range(SKETCH // 64))
    possible = f"""a_node > b_node and a_root <> b_root and 100 * {most} >= {percent} * (a_size + b_size - {most})
        and {100 + percent} * ({differ}) <= {100 - percent} * (a_size + b_size)"""
    pairs = a.join(b, (a["band"] == b["band"]) & F.expr(possible))
    return pairs.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")).distinct()


def groups(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, radius: int = simhash.RADIUS) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_key, node, root (a node that names the component), component_id.

    ``component_id`` is the smallest doc_id reachable over pairs of at least ``percent`` similarity, itself included; ids
    that are null count as larger than all others. Texts without words are one node. An empty table gives no rows.
    ``radius`` (at most 3 bits) decides which pairs the ball hashing finds and which are left to the bands, not the result.
    """
    output = "node long, fp long, bands array<long>"
    made = cut_lineage(_sets(docs, width, output, lambda node, hashes: (node, simhash.fingerprint_of(hashes), bands(hashes).view(np.int64))))
    nodes = made.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.min(F.struct("doc_id", "text_key")).alias("one"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    nodes = cut_lineage(nodes)
    near = cut_lineage(ball_pairs(nodes.select("node", "fp"), radius))
    members = cut_lineage(_members(nodes))

    # The sets of the nodes that met another one, from a single text of each.
    met = members.select("node").unionByName(near.select(F.col("a").alias("node"))).unionByName(near.select(F.col("b").alias("node")))
    wanted = met.distinct().join(nodes, "node").select("node", "one.doc_id", "one.text_key")
    wanted = wanted.withColumnsRenamed({"node": "w_node", "doc_id": "w_id", "text_key": "w_key"})
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("key", text_key(F.col("text")))
    texts = texts.join(wanted, texts["doc_id"].eqNullSafe(F.col("w_id")) & (F.col("key") == F.col("w_key"))).select("doc_id", "text")
    sets = cut_lineage(_sets(texts, width, "node long, hashes array<long>, sketch array<long>", lambda node, hashes: (node, hashes.view(np.int64), sketch(hashes))).select("node", "hashes", "sketch").dropDuplicates(["node"]))

    links = cut_lineage(_similar(near, sets, percent))
    roots = cut_lineage(components(links, []))

    rooted = _apart(members, roots)
    for turn in range(1 + PIVOTS):
        more = cut_lineage(_similar(cut_lineage(_pivot_pairs(rooted, turn)), sets, percent))
        if more.isEmpty():
            break
        links = links.unionByName(more)
        roots = cut_lineage(components(links, []))
        rooted = _apart(rooted, roots)
    more = cut_lineage(_similar(cut_lineage(_unlinked_pairs(rooted, sets, percent)), sets, percent))
    if not more.isEmpty():
        roots = components(links.unionByName(more), [])

    named = nodes.select("node", "first_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = named.join(named.groupBy("root").agg(F.min("first_id").alias("component_id")), "root").select("node", "root", "component_id")
    return made.select("doc_id", "text_key", "node").join(named, "node").select("doc_id", "text_key", "node", "root", "component_id")
