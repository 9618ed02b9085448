"""Exact deduplication over an extendible-hash index on shared files.

Keys are 64-bit hashes of the normalised text. A directory of key prefixes starts with one bucket; while a bucket holds
more distinct keys than its capacity, it splits by the next bit, and the directory doubles once a bucket is as deep as
the directory. The outcome does not depend on the order of insertions: a bucket is the shortest prefix that fits, so all
doublings of a 16-bit stride are found in one aggregation, and only prefixes that are still too full go another stride.
Entries lie in files of the shared folder, each written by an owner task with contiguous ranges of buckets. Owner tasks
chain the texts of one key and compare them byte by byte; a key of a million copies is one chain link, as equal texts meet
in the map-side aggregation before anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelframe.llm.common import ascii_lower, text_key
from voxelframe.session import cut_lineage

STRIDE = 16


def _prefix(key: Column, bits) -> Column:
    """The first ``bits`` bits of a key; no bits give 0."""
    width = F.lit(bits) if isinstance(bits, int) else bits
    return F.when(width == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", key, (F.lit(64) - width).cast("int")))


def directory(keys: DataFrame, capacity: int) -> DataFrame:
    """Buckets (prefix, depth, n_keys) of a table of distinct keys (column key).

    Every key has exactly one bucket. Buckets hold at most ``capacity`` keys; only at 64 bits, where a bucket is a single
    key, is there nothing left to split. An empty table has no bucket.
    """
    parts, base = None, 0
    rest = keys.select("key")
    while True:
        top = base + STRIDE
        leaves = rest.groupBy(_prefix(F.col("key"), top).alias("leaf")).agg(F.count(F.lit(1)).alias("n"))
        levels = leaves.select(F.explode(F.sequence(F.lit(base), F.lit(top))).alias("depth"), "leaf", "n")
        nodes = cut_lineage(
            levels.groupBy("depth", F.call_function("shiftright", F.col("leaf"), F.lit(top) - F.col("depth")).alias("prefix")).agg(F.sum("n").alias("n"))
        )
        fits = nodes.where((F.col("n") <= capacity) | (F.lit(top) == 64) & (F.col("depth") == 64))
        # A node is a bucket if it fits and the node above it does not (the root of the stride has none above).
        above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"), F.col("n").alias("n_up"))
        inner = fits.join(above, (fits["depth"] == above["depth"]) & (F.call_function("shiftright", fits["prefix"], F.lit(1)) == above["up"]))
        buckets = inner.where(F.col("n_up") > capacity).select(fits["depth"], "prefix", "n")
        if base == 0:
            buckets = buckets.unionByName(fits.where("depth = 0").select("depth", "prefix", "n"))
        parts = buckets if parts is None else parts.unionByName(buckets)
        full = nodes.where((F.col("depth") == top) & (F.col("n") > capacity)).select(F.col("prefix").alias("leaf"))
        if top == 64 or full.isEmpty():
            return parts.select("prefix", "depth", F.col("n").alias("n_keys"))
        rest = rest.join(full, _prefix(F.col("key"), top) == F.col("leaf"), "left_semi")
        base = top


def assign_buckets(entries: DataFrame, buckets: DataFrame, depths: list[int]) -> DataFrame:
    """Add the bucket (prefix, depth) to every entry: one equality join, the entry offering its prefix at each depth in use."""
    offers = F.array(*[F.struct(F.lit(d).alias("depth"), _prefix(F.col("key"), d).alias("prefix")) for d in depths])
    offered = entries.withColumn("offer", F.explode(offers)).withColumns({"depth": F.col("offer.depth"), "prefix": F.col("offer.prefix")}).drop("offer")
    return offered.join(buckets.select("depth", "prefix"), ["depth", "prefix"])


def duplicates(docs: DataFrame, capacity: int = 1024, key=F.xxhash64) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_key, copies, keep_id, group_size, kept, bucket, chain, text_sha256.

    Texts are equal if they are identical after lower-casing A-Z; a null text counts as empty. Of equal texts the largest
    doc_id stays; ids that are null lose against all others, and a group of null ids keeps null. Rows with the same id and
    the same text are marked alike; ``copies`` counts those with the same id and the same text before normalisation. An
    empty table gives an empty result; other columns of ``docs`` are not read. ``chain`` is the place of the text among
    the texts that share its key. ``key`` maps the normalised text to 64 bits and may be weak.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), ascii_lower(text).alias("norm"))
    entries = cut_lineage(rows.select("doc_id", "text_key", key("norm").alias("key"), F.sha2("norm", 256).alias("sha")))
    counted = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    buckets = cut_lineage(directory(cut_lineage(counted), capacity))
    depths = sorted(r[0] for r in buckets.select("depth").distinct().collect())  # at most 65 numbers
    if not depths:
        depths = [0]

    # The index: one entry per distinct text of a key. Texts that no other row can equal have a key of their own and need
    # no comparison; the others are chained, and grouping by the text itself compares bytes.
    shared = counted.where("n > 1").select("key")
    texts = rows.select("doc_id", "norm", key("norm").alias("key")).join(shared, "key", "left_semi")
    chained = texts.groupBy("key", "norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    links = chained.select("key", F.sha2("norm", 256).alias("sha"), "keep_id", "group_size")
    alone = entries.join(shared, "key", "left_anti").select("key", "sha", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    index = assign_buckets(links.unionByName(alone), buckets, depths)
    # An owner has whole buckets: the keys that share the first bits of the shallowest bucket.
    owned = index.withColumn("owner", _prefix(F.col("key"), depths[0])).repartition("owner")
    owned = owned.withColumn("chain", F.expr("row_number() over (partition by owner, key order by sha)") - 1)
    owned = owned.withColumn("bucket", F.concat_ws("/", F.col("depth").cast("string"), F.col("prefix").cast("string")))
    stored = cut_lineage(owned.select("owner", "bucket", "key", "chain", "sha", "keep_id", "group_size"))

    same = entries.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    found = entries.join(stored, ["key", "sha"])
    same = same.select(F.col("doc_id").alias("s_id"), F.col("text_key").alias("s_key"), "copies")
    found = found.join(same, found["doc_id"].eqNullSafe(F.col("s_id")) & (found["text_key"] == F.col("s_key")), "left")
    return found.select(
        "doc_id", "text_key", F.coalesce("copies", F.lit(1).cast("long")).alias("copies"), "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "bucket", "chain", F.col("sha").alias("text_sha256"),
    )
