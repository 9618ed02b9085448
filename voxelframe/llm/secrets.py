"""Secret scan: fixed patterns, and strings whose sliding-window entropy is that of random characters.

The entropy scan walks every candidate string once. Counts of the characters in the window are kept up incrementally: a
character that enters or leaves changes one count and the sum of n * log2(n), from which the Shannon entropy follows. Each
character class has its own threshold. Candidates that an allow-list pattern matches are left out.
Everything is built from Spark SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelframe.llm.common import find_spans, replace_spans, spans_text

# The patterns of the contract; letters in either case only in the words before the sign.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
VALUE = r"""^[^:=]*[:=]\x20*["']?"""

WINDOW = 20
#: Bits per character over a window. Random strings of the class reach them; words and numbers do not.
THRESHOLDS = {"hex": 3.0, "base64": 3.6}
CANDIDATE = r"[A-Za-z0-9+/=_-]{20,}+"
#: Candidates that are no secrets: letters only (words), digits only, one repeated character, placeholders, runs of the
#: alphabet, paths of words.
ALLOW = (
    r"^[A-Za-z_-]+$",
    r"^[0-9=_-]+$",
    r"^(.)\1+$",
    r"(?i)example|sample|dummy|placeholder|changeme|xxxx",
    r"(?i)0123456789|abcdefghij",
    r"^/?(?:[A-Za-z_-]+/)+[A-Za-z_-]*$",
)

#: By window: letters without a separator have a threshold of their own, as words reach that of base64.
LETTERS = 3.8
#: Words that clear a window which holds all of one.
ALLOWED_WORDS = ("example", "sample", "dummy", "placeholder", "changeme", "xxxx", "0123456789", "abcdefghij")
#: Shorter strings, judged as one window: whole runs, and pieces of a run between separators.
SHORT_RUN = r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{16,19}+(?![A-Za-z0-9+/=_-])"
SHORT_PIECE = r"(?<![A-Za-z0-9+])[A-Za-z0-9+]{16,19}+(?![A-Za-z0-9+])"
_SPANS = "array<struct<start:long,place:int,end:long,kind:string>>"


def _weight(n: Column) -> Column:
    """n * log2(n), 0 for n < 2."""
    return F.when(n < 2, F.lit(0.0)).otherwise(n * F.log2(F.greatest(n, F.lit(1)).cast("double")))


def _moved(counts: Column, letter: Column, by: int) -> Column:
    return F.map_zip_with(counts, F.create_map(letter, F.lit(by)), lambda _, a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))


def window_spans(candidate: Column, threshold: Column, window: int = WINDOW) -> Column:
    """struct<first, last>: start of the first and end of the last window whose entropy reaches the threshold; -1 if none."""
    letters = F.split(candidate, "")
    start = F.struct(
        F.create_map().cast("map<string,int>").alias("counts"), F.lit(0.0).alias("sum"), F.lit(0).alias("at"),
        F.lit(-1).alias("first"), F.lit(-1).alias("last"),
    )

    def enter(state, letter):
        n = F.coalesce(F.element_at(state["counts"], letter), F.lit(0))
        return F.struct(_moved(state["counts"], letter, 1).alias("counts"), (state["sum"] + _weight(n + 1) - _weight(n)).alias("sum"), (state["at"] + 1).alias("at"), state["first"].alias("first"), state["last"].alias("last"))

    def leave(state, letter):
        n = F.element_at(state["counts"], letter)
        return F.struct(_moved(state["counts"], letter, -1).alias("counts"), (state["sum"] + _weight(n - 1) - _weight(n)).alias("sum"), state["at"].alias("at"), state["first"].alias("first"), state["last"].alias("last"))

    def judge(state):
        entropy = F.log2(F.lit(float(window))) - state["sum"] / F.lit(float(window))
        high = (state["at"] >= window) & (entropy >= threshold)
        first = F.when(high & (state["first"] < 0), state["at"] - window).otherwise(state["first"])
        return F.struct(state["counts"].alias("counts"), state["sum"].alias("sum"), state["at"].alias("at"), first.alias("first"), F.when(high, state["at"]).otherwise(state["last"]).alias("last"))

    # Each step is its own one-element fold, so a state is computed once and then used by name.
    def step(state, x):
        moved = F.aggregate(F.array(x["in"]), state, enter)
        moved = F.when(x["out"].isNotNull(), F.aggregate(F.array(x["out"]), moved, leave)).otherwise(moved)
        return F.aggregate(F.array(F.lit(0)), moved, lambda s, _: judge(s))

    leaving = F.concat(F.array_repeat(F.lit(None).cast("string"), window), letters)
    steps = F.zip_with(letters, F.slice(leaving, 1, F.size(letters)), lambda a, b: F.struct(a.alias("in"), b.alias("out")))
    done = F.aggregate(steps, start, step)
    return F.when(F.length(candidate) >= window, F.struct(done["first"].alias("first"), done["last"].alias("last")))


def _entropy_spans(text: Column, found: Column) -> Column:
    """Spans of the candidate strings in ``found`` (all matches of CANDIDATE) that pass the entropy test."""
    places = find_spans(text, found, CANDIDATE, lambda m: ~_allowed(m), "", 9)

    def judged(place):
        candidate = F.substring(text, (place["start"] + 1).cast("int"), (place["end"] - place["start"]).cast("int"))
        hexadecimal = candidate.rlike("^[0-9a-fA-F]+$")
        span = window_spans(candidate, F.when(hexadecimal, THRESHOLDS["hex"]).otherwise(THRESHOLDS["base64"]))
        kind = F.when(hexadecimal, "entropy_hex").otherwise("entropy_base64")
        return F.transform(F.array(span), lambda s: F.struct((place["start"] + s["first"]).alias("start"), F.when(hexadecimal, 3).otherwise(4).alias("place"), (place["start"] + s["last"]).alias("end"), kind.alias("kind"), (s["first"] >= 0).alias("high")))

    kept = F.filter(F.flatten(F.transform(places, judged)), lambda s: s["high"])
    return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["place"].alias("place"), s["end"].alias("end"), s["kind"].alias("kind")))


def _marked(candidate: Column) -> Column:
    """The candidate with the last letter of every allowed word replaced by a sign that tells the word's length (but for
    11, chr(32 + length)), so one pass over the letters knows where words end and start."""
    for word in ALLOWED_WORDS:
        sign = chr(32 + (9 if len(word) == 11 else len(word)))
        candidate = F.regexp_replace(candidate, f"(?i)(?<={word[:-1]}){word[-1]}", f"\\{sign}")
    return candidate


def judged_windows(candidate: Column, window: int = WINDOW) -> Column:
    """struct<first, last, hexadecimal>: start of the first and end of the last window that is high; -1 if none.

    Class and allow-list are decided for each window: by where the last letter outside a class and the last allowed word
    were. ``hexadecimal`` says that all high windows are.
    """
    letters, marked = F.split(candidate, ""), F.split(_marked(candidate), "")
    never = F.lit(-1)
    classes = {"hex": "[^0-9a-fA-F]", "digit": "[^0-9=_-]", "word": "[^A-Za-z_/-]", "letter": "[^A-Za-z]"}
    start = F.struct(
        F.create_map().cast("map<string,int>").alias("counts"), F.lit(0.0).alias("sum"), F.lit(0).alias("at"),
        *[never.alias(c) for c in classes], never.alias("allowed"), never.alias("first"), never.alias("last"), F.lit(True).alias("pure"),
    )
    kept = lambda state, *names: [state[n].alias(n) for n in names]

    def enter(state, x):
        n = F.coalesce(F.element_at(state["counts"], x["in"]), F.lit(0))
        code = F.ascii(x["mark"]) - 32
        length = F.when(code == 9, 11).otherwise(code)
        seen = [F.when(x["in"].rlike(p), state["at"]).otherwise(state[c]).alias(c) for c, p in classes.items()]
        allowed = F.when(code.between(4, 10), F.greatest(state["allowed"], state["at"] + 1 - length)).otherwise(state["allowed"])
        total = state["sum"] + _weight(n + 1) - _weight(n)
        return F.struct(_moved(state["counts"], x["in"], 1).alias("counts"), total.alias("sum"), (state["at"] + 1).alias("at"), *seen, allowed.alias("allowed"), *kept(state, "first", "last", "pure"))

    def leave(state, letter):
        n = F.element_at(state["counts"], letter)
        total = state["sum"] + _weight(n - 1) - _weight(n)
        return F.struct(_moved(state["counts"], letter, -1).alias("counts"), total.alias("sum"), *kept(state, "at", *classes, "allowed", "first", "last", "pure"))

    def judge(state):
        low = state["at"] - window
        entropy = F.log2(F.lit(float(window))) - state["sum"] / F.lit(float(window))
        within = {c: state[c] < low for c in classes}
        threshold = F.when(within["letter"], LETTERS).when(within["hex"], THRESHOLDS["hex"]).otherwise(THRESHOLDS["base64"])
        words = within["word"] & ~within["letter"]
        high = (low >= 0) & (state["allowed"] < low) & ~within["digit"] & ~words & (entropy >= threshold)
        first = F.when(high & (state["first"] < 0), low).otherwise(state["first"])
        return F.struct(*kept(state, "counts", "sum", "at", *classes, "allowed"), first.alias("first"), F.when(high, state["at"]).otherwise(state["last"]).alias("last"), (state["pure"] & (~high | within["hex"])).alias("pure"))

    # Each step is its own one-element fold, so a state is computed once and then used by name.
    def step(state, x):
        moved = F.aggregate(F.array(x), state, enter)
        moved = F.when(x["out"].isNotNull(), F.aggregate(F.array(x["out"]), moved, leave)).otherwise(moved)
        return F.aggregate(F.array(F.lit(0)), moved, lambda s, _: judge(s))

    leaving = F.concat(F.array_repeat(F.lit(None).cast("string"), window), letters)
    steps = F.transform(F.arrays_zip(letters.alias("a"), marked.alias("b"), F.slice(leaving, 1, F.size(letters)).alias("c")), lambda x: F.struct(x["a"].alias("in"), x["b"].alias("mark"), x["c"].alias("out")))
    return F.aggregate(steps, start, step, lambda done: F.struct(done["first"].alias("first"), done["last"].alias("last"), done["pure"].alias("hexadecimal")))


def _short_is_high(m: Column) -> Column:
    """A string of under a window's length, judged as one window; thresholds follow the largest entropy of its length."""
    letters = F.split(m, "")
    total = F.aggregate(F.array_distinct(letters), F.lit(0.0), lambda a, c: a + _weight(F.size(F.filter(letters, lambda x: x == c))))
    bits = F.log2(F.length(m).cast("double"))
    threshold = F.when(m.rlike("^[A-Za-z]+$"), LETTERS).when(m.rlike("^[0-9a-fA-F]+$"), THRESHOLDS["hex"]).otherwise(THRESHOLDS["base64"])
    words = m.rlike("^[A-Za-z_/-]+$") & ~m.rlike("^[A-Za-z]+$")
    allowed = m.rlike("(?i)" + "|".join(ALLOWED_WORDS)) | m.rlike("^[0-9=_-]+$") | words
    return ~allowed & (bits - total / F.length(m) >= threshold * bits / F.log2(F.lit(float(WINDOW))))


def _spans_by_window(text: Column, found: Column) -> Column:
    """Spans of the candidate strings in ``found`` (all matches of CANDIDATE) that have a high window."""
    plain = lambda m: m.rlike("^[0-9=_-]+$") | (m.rlike("^[A-Za-z_/-]+$") & ~m.rlike("[A-Za-z]{20}"))
    places = find_spans(text, found, CANDIDATE, lambda m: ~plain(m), "", 9)

    def judged(place):
        candidate = F.substring(text, (place["start"] + 1).cast("int"), (place["end"] - place["start"]).cast("int"))
        out = lambda s: F.struct((place["start"] + s["first"]).alias("start"), F.when(s["hexadecimal"], 3).otherwise(4).alias("place"), (place["start"] + s["last"]).alias("end"), F.when(s["hexadecimal"], "entropy_hex").otherwise("entropy_base64").alias("kind"))
        return F.transform(F.filter(F.array(judged_windows(candidate)), lambda s: s["first"] >= 0), out)

    return F.flatten(F.transform(places, judged))


def _short_spans(text: Column) -> Column:
    """Spans of the strings of 16 to 19 characters that are high."""
    parts = [find_spans(text, F.regexp_extract_all(text, F.lit(p), F.lit(0)), p, _short_is_high, "", 4) for p in (SHORT_RUN, SHORT_PIECE)]

    def named(s):
        hexadecimal = F.substring(text, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")).rlike("^[0-9a-fA-F]+$")
        return F.struct(s["start"].alias("start"), F.when(hexadecimal, 3).otherwise(4).alias("place"), s["end"].alias("end"), F.when(hexadecimal, "entropy_hex").otherwise("entropy_base64").alias("kind"))

    return F.array_distinct(F.transform(F.concat(*parts), named))


def _allowed(candidate: Column) -> Column:
    condition = F.lit(False)
    for pattern in ALLOW:
        condition = condition | candidate.rlike(pattern)
    return condition


def scan(docs: DataFrame, by_window: bool = False) -> DataFrame:
    """``docs`` with two more columns, __base and __spans: array<struct<start, place, end, kind>> in order of start, then kind.

    __base has the pattern matches (assign, access, hex), __spans also those of the entropy scan (entropy_hex,
    entropy_base64). Positions count code points, the end is exclusive. A null text has no spans; repeated rows are scanned
    again; an empty table stays empty. Columns of ``docs`` that start with __ are for this scan and are replaced.

    ``by_window`` decides class and allow-list for each window instead of once for a whole run of candidate characters, and
    also judges strings of 16 to 19 characters.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.withColumns({
        "__assign": F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(0)), "__access": F.regexp_extract_all(text, F.lit(ACCESS), F.lit(0)),
        "__hex": F.regexp_extract_all(text, F.lit(HEX), F.lit(0)), "__cand": F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)),
    })
    long_value = lambda m: F.length(F.regexp_replace(m, VALUE, "")) >= 6
    everything = lambda m: F.lit(True)
    none = F.array().cast(_SPANS)
    more = F.when(F.size("__cand") > 0, (_spans_by_window if by_window else _entropy_spans)(text, F.col("__cand"))).otherwise(none)
    if by_window:
        more = F.concat(more, F.when(text.rlike("[A-Za-z0-9+/=_-]{16}"), _short_spans(text)).otherwise(none))
    rows = rows.withColumns({
        "__assign": find_spans(text, F.col("__assign"), ASSIGN, long_value, "assign", 0),
        "__access": find_spans(text, F.col("__access"), ACCESS, everything, "access", 1),
        "__hex": find_spans(text, F.col("__hex"), HEX, everything, "hex", 2),
        "__more": more,
    })
    rows = rows.withColumn("__base", F.array_sort(F.concat("__assign", "__access", "__hex")))
    rows = rows.withColumn("__spans", F.array_sort(F.concat("__base", "__more")))
    return rows.drop("__access", "__hex", "__cand", "__assign", "__more")


def redact(scanned: DataFrame, mark: str = "<secret>") -> DataFrame:
    """Replace every span of a scanned table by ``mark``. Texts without spans, null texts too, stay as they are."""
    return scanned.withColumn("text", replace_spans(F.col("text"), F.col("__spans"), lambda s: F.lit(mark)))


def report(docs: DataFrame, by_window: bool = False) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row."""
    rows = scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), by_window)
    number = lambda kind: F.size(F.filter("__base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", number("assign"), number("access"), number("hex"), F.sha2(spans_text(F.col("__base")), 256).alias("base_sha256"), spans_text(F.col("__spans")).alias("spans"))
