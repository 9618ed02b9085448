"""Personal data: fixed patterns, and information-theoretic sanitisation of the terms around them.

What a term t reveals about a protected entity e (an address or number found by the patterns) is their pointwise mutual
information over the corpus, log2(N * n(t, e) / (n(t) * n(e))), as a share of the information content of the entity,
log2(N / n(e)): 1 means that whoever sees the term knows the entity. n(t) and n(e) are the documents that have the term or
the entity, n(t, e) the documents that have the term near the entity. Terms whose share exceeds a threshold are removed,
those that exceed a lower one are generalised. Everything is built from Spark SQL functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelframe.llm.common import find_spans, replace_spans, spans_text, text_key
from voxelframe.session import cut_lineage

# The patterns of the contract, written so that no position is tried twice. A match starts where the last
# one ended or where its first class starts; repeated groups never give back.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")

#: Code points on each side of a mention in which terms are near it.
NEAR = 80
#: A term is a run of at least so many letters, in lower case.
TERM = r"(?<!\p{L})\p{L}{3,}+"
#: Shares of the entity's information from which a term is removed or generalised.
REMOVE_FROM, GENERALISE_FROM = 0.9, 0.6
#: Documents in which a term must be near the entity before their co-occurrence counts as evidence.
SUPPORT = 2
#: Probability with which any pair of an entity and a term passes the test of ``scan_whole`` by chance.
CHANCE = 0.01
BASE = "array<struct<start:long,place:int,end:long,kind:string>>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    """16 to 19 digits whose Luhn sum is a multiple of ten: every second digit from the right is doubled, less 9 if over 9."""
    digits = F.filter(F.split(F.reverse(_digits(m)), ""), lambda c: c != "")
    values = F.transform(digits, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    total = F.aggregate(values, F.lit(0), lambda a, b: a + b)
    return F.length(_digits(m)).between(16, 19) & (total % 10 == 0)


def _octets(m: Column) -> Column:
    """Four numbers of at most 255, leading zeros or not."""
    return F.forall(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def base_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with a column __base: array<struct<start, place, end, kind>>, by kind as listed, then start."""
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast("array<string>")
    gates = {"email": F.instr(text, "@") > 0, "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike("[0-9][0-9 -]{14}"), "phone": F.instr(text, "+") > 0}
    patterns = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
    tests = {"email": lambda m: F.lit(True), "ip": _octets, "card": _luhn, "phone": lambda m: F.length(_digits(m)).between(8, 15)}
    rows = docs.withColumns({f"__{k}": F.when(gates[k], F.regexp_extract_all(text, F.lit(patterns[k]), F.lit(0))).otherwise(none) for k in KINDS})
    rows = rows.withColumns({f"__{k}": find_spans(text, F.col(f"__{k}"), patterns[k], tests[k], k, i) for i, k in enumerate(KINDS)})
    return rows.withColumn("__base", F.concat(*[f"__{k}" for k in KINDS])).drop(*[f"__{k}" for k in KINDS])


def _nearby(scanned: DataFrame) -> DataFrame:
    """Terms near mentions: doc_id, text_key, entity, term, start, end. ``scanned`` has mentions: array<struct<entity,
    before, from, after, to>>, the text on both sides with the code points at which it starts."""
    mentions = scanned.select("doc_id", "text_key", F.explode("mentions").alias("m"))
    sides = []
    for side, place in (("before", "from"), ("after", "to")):
        text = F.col(f"m.{side}")
        found = F.regexp_extract_all(text, F.lit(TERM), F.lit(0))
        terms = mentions.withColumn("found", found).withColumn("span", F.explode(find_spans(text, F.col("found"), TERM, lambda m: F.lit(True), "", 0)))
        # The outer ends of a side may cut a word; the padding there is dropped with the word that touches it.
        inner = (F.col("span.start") > 0) if side == "before" else (F.col("span.end") < F.length(text))
        term = F.lower(F.substring(text, (F.col("span.start") + 1).cast("int"), (F.col("span.end") - F.col("span.start")).cast("int")))
        at = F.col(f"m.{place}")
        sides.append(terms.where(inner).select("doc_id", "text_key", F.col("m.entity").alias("entity"), term.alias("term"), (at + F.col("span.start")).alias("start"), (at + F.col("span.end")).alias("end")))
    return sides[0].unionByName(sides[1])


def _blanked(text: Column, spans: Column) -> Column:
    """The text between two spaces, with # for every character of the spans (in order of start), so none of them is a term."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(" ").alias("out"))

    def step(state, s):
        gap = F.substring(text, (state["at"] + 1).cast("int"), F.greatest(s["start"] - state["at"], F.lit(0)).cast("int"))
        fill = F.repeat(F.lit("#"), F.greatest(s["end"] - F.greatest(s["start"], state["at"]), F.lit(0)).cast("int"))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.concat(state["out"], gap, fill).alias("out"))

    return F.aggregate(spans, start, step, lambda state: F.concat(state["out"], F.substring(text, (state["at"] + 1).cast("int"), F.length(text)), F.lit(" ")))


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_key, base, spans, all as array<struct<start, place, end, kind>>.

    ``base`` has the pattern matches by kind and start; ``spans`` also the terms around them, kinds ``reveals`` (to remove)
    and ``hints`` (to generalise). Positions count code points, the end is exclusive. A null text has no spans and counts
    as a document; repeated rows are documents of their own in all counts and get the same spans; an empty table stays
    empty; other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = base_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    rows = rows.withColumn("__padded", F.when(F.size("__base") > 0, _blanked(text, F.array_sort("__base"))))
    padded = F.col("__padded")

    def mention(s):
        left = F.greatest(s["start"] - NEAR, F.lit(0).cast("long"))
        value = F.lower(F.substring(text, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
        return F.struct(
            F.concat_ws(":", s["kind"], value).alias("entity"),
            F.substring(padded, (left + 1).cast("int"), (s["start"] - left + 1).cast("int")).alias("before"), (left - 1).alias("from"),
            F.substring(padded, (s["end"] + 2).cast("int"), F.lit(NEAR + 1)).alias("after"), s["end"].alias("to"),
        )

    rows = rows.select("doc_id", text_key(F.col("text")).alias("text_key"), F.col("__base").alias("base"), F.transform("__base", mention).alias("mentions"))
    scanned = cut_lineage(rows)
    near = cut_lineage(_nearby(scanned.where(F.size("mentions") > 0)))

    # Documents are counted as rows: the copies of a document are so many documents.
    documents = scanned.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    copies = scanned.where(F.size("mentions") > 0).groupBy("doc_id", "text_key", "mentions").agg(F.count(F.lit(1)).alias("rows"))
    per_entity = copies.select("rows", F.explode(F.array_distinct(F.transform("mentions", lambda m: m["entity"]))).alias("entity"))
    per_entity = per_entity.groupBy("entity").agg(F.sum("rows").alias("n_entity"))
    weights = copies.select("doc_id", "text_key", "rows").withColumnsRenamed({"doc_id": "w_id", "text_key": "w_key"})
    pairs = near.select("doc_id", "text_key", "entity", "term").distinct()
    pairs = pairs.join(weights, pairs["doc_id"].eqNullSafe(F.col("w_id")) & (pairs["text_key"] == F.col("w_key")))
    pairs = pairs.groupBy("entity", "term").agg(F.sum("rows").alias("n_both")).where(F.col("n_both") >= SUPPORT)
    pairs = cut_lineage(pairs.join(per_entity, "entity"))
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))).alias("term"))
    per_term = words.groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    known = pairs.join(per_term, "term")
    n = F.lit(float(max(documents, 1)))
    share = F.log2(n * F.col("n_both") / (F.col("n_term") * F.col("n_entity"))) / F.log2(n / F.col("n_entity"))
    judged = known.where(F.col("n_entity") < documents).withColumn("share", F.round(share, 9)).where(F.col("share") >= GENERALISE_FROM)
    judged = judged.select("entity", "term", (F.col("share") >= REMOVE_FROM).alias("remove"))

    hits = near.join(judged, ["entity", "term"]).groupBy("doc_id", "text_key", "start", "end").agg(F.max("remove").alias("remove"))
    place = F.when(F.col("remove"), len(KINDS)).otherwise(len(KINDS) + 1)
    kind = F.when(F.col("remove"), "reveals").otherwise("hints")
    span = F.struct("start", place.alias("place"), "end", kind.alias("kind"))
    more = hits.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(span)).alias("more")).withColumnsRenamed({"doc_id": "m_id", "text_key": "m_key"})
    joined = scanned.join(more, scanned["doc_id"].eqNullSafe(F.col("m_id")) & (scanned["text_key"] == F.col("m_key")), "left")
    every = F.concat("base", F.coalesce("more", F.array().cast("array<struct<start:long,place:int,end:long,kind:string>>")))
    by_kind = F.array_sort(F.transform(every, lambda s: F.struct(s["place"].alias("place"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return joined.select("doc_id", "text_key", "base", F.transform(by_kind, lambda s: F.struct(s["start"].alias("start"), s["place"].alias("place"), s["end"].alias("end"), s["kind"].alias("kind"))).alias("spans"))


def _distinct_words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)))


def _likelihood(observed: Column, expected: Column) -> Column:
    """observed * ln(observed / expected), 0 for nothing observed."""
    return F.when(observed > 0, observed * F.log(observed / F.greatest(expected, F.lit(1e-12)))).otherwise(0.0)


def _evidence(rows: DataFrame, docs: DataFrame, documents: int, n_rows: int) -> DataFrame:
    """Judged terms (term, remove) from ``rows`` (text_key, entities, mentions, blank, length: one row per different text
    with a mention; length is that of blank, which travels for its words alone) and ``docs`` (text: all ``n_rows`` rows, of ``documents`` different texts).

    How frequent a term is comes from all rows, brought to the number of different texts, so that no text has to be matched
    with its copies."""
    words = rows.select("text_key", F.explode(F.transform(F.regexp_extract_all("blank", F.lit(TERM), F.lit(0)), F.lower)).alias("term"))
    held = cut_lineage(words.groupBy("text_key", "term").agg(F.count(F.lit(1)).alias("k_all")))
    counted = docs.select(F.explode(F.array_distinct(F.transform(_distinct_words(F.col("text")), F.lower))).alias("term")).groupBy("term").agg((F.count(F.lit(1)) * (documents / max(n_rows, 1))).alias("n_term"), F.count(F.lit(1)).alias("n_rows"))
    per_term = cut_lineage(counted.join(held.select("term").distinct(), "term", "left_semi"))

    # Entities of the same documents share all counts over documents, so they are one class.
    each = rows.select("text_key", F.explode("entities").alias("entity"))
    per_entity = each.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"), F.struct(F.bit_xor(F.xxhash64("text_key")), F.min("text_key"), F.max("text_key")).alias("held_by"))
    per_entity = cut_lineage(per_entity.select("entity", "n_entity", F.xxhash64("n_entity", "held_by").alias("class")).where(F.col("n_entity") < documents))
    classed = each.join(per_entity, "entity")
    by_class = classed.select("text_key", "class", "n_entity").distinct()

    # Over documents: classes of two at least, and terms that are rare enough for the lower share.
    n = float(max(documents, 2))
    most = F.pow(F.col("n_entity"), F.lit(GENERALISE_FROM)) * n ** (1 - GENERALISE_FROM) * 1.001
    several = held.join(per_term.where("n_rows > 1"), "term").join(by_class.where("n_entity > 1"), "text_key").where(F.col("n_term") <= most)
    together = several.groupBy("class", "term").agg(F.count(F.lit(1)).alias("n_both")).where("n_both > 1")

    # Near the mentions: how often a term stands in their windows, against the share of the text that these are.
    near = _nearby(rows.select(F.lit(0).alias("doc_id"), "text_key", "mentions")).groupBy("text_key", "entity", "term").agg(F.count(F.lit(1)).alias("k"))
    mention = rows.select("text_key", "length", F.explode("mentions").alias("m"))
    window = mention.groupBy("text_key", F.col("m.entity").alias("entity")).agg(
        F.least(F.lit(0.5), F.sum(F.length("m.before") + F.length("m.after")) / F.max("length")).alias("w")
    )
    spots = near.join(held, ["text_key", "term"]).join(window, ["text_key", "entity"])
    spots = spots.groupBy("entity", "term").agg(
        F.count(F.lit(1)).alias("near_in"), F.sum(F.least("k", "k_all")).alias("k"), F.sum("k_all").alias("k_all"), (F.sum(F.col("k_all") * F.col("w")) / F.sum("k_all")).alias("w"),
    )
    close = spots.join(per_entity, "entity")
    known = together.join(per_entity.select("class", "entity", "n_entity"), "class").select("entity", "term", "n_entity", "n_both")
    # Without two common documents a pair is known from its windows only, and the documents these lie in are its common ones.
    pairs = known.join(close.select("entity", "term", "near_in", "k", "k_all", "w", F.col("n_entity").alias("n_close")), ["entity", "term"], "full_outer")
    pairs = pairs.select("entity", "term", F.coalesce("n_entity", "n_close").alias("n_entity"), F.coalesce("n_both", "near_in").alias("n_both"), "k", "k_all", "w").join(per_term, "term")

    e, t, both = (F.col(c).cast("double") for c in ("n_entity", "n_term", "n_both"))
    common = _likelihood(both, e * t / n) + _likelihood(e - both, e * (n - t) / n) + _likelihood(t - both, t * (n - e) / n) + _likelihood(n - e - t + both, (n - e) * (n - t) / n)
    common = F.when(both > e * t / n, common).otherwise(0.0)
    k, k_all, w = F.col("k").cast("double"), F.col("k_all").cast("double"), F.col("w")
    close_by = F.when(k > k_all * w, _likelihood(k, k_all * w) + _likelihood(k_all - k, k_all * (1 - w))).otherwise(0.0)
    tested = cut_lineage(pairs.select("term", F.round(F.log2(n * both / (t * e)) / F.log2(n / e), 9).alias("share"), (common + F.coalesce(close_by, F.lit(0.0))).alias("score")))
    tests = tested.count()
    strong = tested.where((F.col("share") >= GENERALISE_FROM) & (F.col("score") >= math.log(max(tests, 1) / CHANCE)))
    return strong.groupBy("term").agg((F.max("share") >= REMOVE_FROM).alias("remove"))


def scan_whole(docs: DataFrame) -> DataFrame:
    """As ``scan``, with evidence from whole documents, tested against chance, and spans in every text.

    Counts are of different texts: copies are no evidence, they only make their terms more frequent. A term is judged by its share of the entity's information, as in
    ``scan``, and only if the pair is unlikely by chance: its log-likelihood ratio, over documents and over places (how often
    the term stands near the mentions, against the share of the text that is near), has to exceed that of one chance pair
    among all pairs tested with probability ``CHANCE``. So a term of a single document counts only if it keeps close to the
    mention, not for being rare. Every occurrence of a judged term in any text gets a span. Nulls, repeated rows, empty tables
    and other columns are treated as in ``scan``.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key(F.col("text")).alias("text_key"))
    rows = base_spans(keyed).withColumn("__padded", F.when(F.size("__base") > 0, _blanked(text, F.array_sort("__base"))))
    value = lambda s: F.concat_ws(":", s["kind"], F.lower(F.substring(text, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))

    def mention(s):
        left = F.greatest(s["start"] - NEAR, F.lit(0).cast("long"))
        return F.struct(
            value(s).alias("entity"), F.substring("__padded", (left + 1).cast("int"), (s["start"] - left + 1).cast("int")).alias("before"), (left - 1).alias("from"),
            F.substring("__padded", (s["end"] + 2).cast("int"), F.lit(NEAR + 1)).alias("after"), s["end"].alias("to"),
        )

    scanned = cut_lineage(rows.select(
        "doc_id", "text_key", F.col("__base").alias("base"), F.array_distinct(F.transform("__base", value)).alias("entities"),
        F.transform("__base", mention).alias("mentions"), F.col("__padded").alias("blank"), F.length("__padded").alias("length"),
    ))
    n_rows, documents = scanned.agg(F.count(F.lit(1)), F.countDistinct("text_key")).first()
    marked = scanned.where(F.size("entities") > 0).select("text_key", "entities", "mentions", "blank", "length")
    judged = cut_lineage(_evidence(marked.dropDuplicates(["text_key"]), docs.select("text").where("text is not null"), documents, n_rows))

    # Words as they are written, so that a text's judged words can be found in it again; what travels are these few words.
    spelled = keyed.select("doc_id", "text_key", F.explode(_distinct_words(text)).alias("word"))
    found = spelled.join(judged, F.lower("word") == F.col("term")).groupBy("doc_id", "text_key").agg(
        F.collect_set(F.when(F.col("remove"), F.col("word"))).alias("removed"), F.collect_set(F.when(~F.col("remove"), F.col("word"))).alias("hinted")
    )
    found = cut_lineage(found.withColumnsRenamed({"doc_id": "m_id", "text_key": "m_key"}))
    held = keyed.join(found, keyed["doc_id"].eqNullSafe(F.col("m_id")) & (keyed["text_key"] == F.col("m_key")))
    spans = []
    for place, (words, kind) in enumerate((("removed", "reveals"), ("hinted", "hints")), len(KINDS)):
        pattern = F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join(words, "|"), F.lit(r")(?!\p{L})"))
        matches = F.when(F.size(words) > 0, F.regexp_extract_all(text, pattern, F.lit(0))).otherwise(F.array().cast("array<string>"))
        spans.append(find_spans(text, matches, pattern, lambda m: F.lit(True), kind, place))
    more = held.select(F.col("doc_id").alias("m_id"), F.col("text_key").alias("m_key"), F.concat(*spans).alias("more"))
    more = more.dropDuplicates(["m_id", "m_key"])  # of the spans, so that no text travels for it
    joined = scanned.select("doc_id", "text_key", "base").join(more, scanned["doc_id"].eqNullSafe(F.col("m_id")) & (scanned["text_key"] == F.col("m_key")), "left")
    # What stands inside a mention is its business.
    outside = F.filter(F.coalesce("more", F.array().cast(BASE)), lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    every = F.concat("base", outside)
    by_kind = F.array_sort(F.transform(every, lambda s: F.struct(s["place"].alias("place"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return joined.select("doc_id", "text_key", "base", F.transform(by_kind, lambda s: F.struct(s["start"].alias("start"), s["place"].alias("place"), s["end"].alias("end"), s["kind"].alias("kind"))).alias("spans"))


def sanitise(docs: DataFrame) -> DataFrame:
    """doc_id and text of every row, with mentions replaced by their kind, revealing terms removed and hints generalised."""
    found = scan_whole(docs).dropDuplicates(["doc_id", "text_key"]).select(F.col("doc_id").alias("f_id"), F.col("text_key").alias("f_key"), F.array_sort("spans").alias("spans"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("key", text_key(F.col("text")))
    joined = rows.join(found, rows["doc_id"].eqNullSafe(F.col("f_id")) & (F.col("key") == F.col("f_key")), "left")
    mark = lambda s: F.when(s["kind"] == "reveals", "").when(s["kind"] == "hints", "<term>").otherwise(F.concat(F.lit("<"), s["kind"], F.lit(">")))
    return joined.select("doc_id", replace_spans(F.col("text"), F.col("spans"), mark).alias("text"))


def report(docs: DataFrame, whole: bool = False) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row; ``whole`` takes ``scan_whole``."""
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return (scan_whole if whole else scan)(docs).select("doc_id", *[number(k) for k in KINDS], F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))
