"""Runs (maximal periodic stretches) of the words of a text, by the branching-tandem test on an enhanced suffix array.

A boundary of the LCP table with value d parts the suffixes that share exactly their first d words into a left and a right
side. For every suffix i of the smaller side, the inverse suffix array tells whether i + d or i - d stands on the other
side; then d words occur twice in a row there, and the word behind them breaks the repetition. Such a square is rotated to
the left as long as the words allow, and squares of one stretch are merged into its run. No tree is built: a boundary
and its two neighbours of smaller value are all that an interval needs.

The texts of a batch are one sequence, in which every text has words of its own, so no match crosses texts and all steps
but the stack run as array operations. A run of 12 words or more holds some six words twice, so texts whose six-word
sequences are all different have none and get no suffix array.
"""

from __future__ import annotations

import re
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelframe.llm.common import small_batches

MIN_LENGTH = 12
#: Words that any run of MIN_LENGTH words repeats: the length less the period, which is at most half of it.
REPEATED = MIN_LENGTH // 2
CHUNK = 1 << 20
#: Words of texts that share a suffix array; a longer text has one of its own.
SHARED = 1 << 17
WORD = re.compile(r"[^\x20\x09-\x0D]+")

SCHEMA = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
)


def suffix_array(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array, its inverse, and LCP table (of each suffix with the one before it) of a sequence of numbers.

    Prefix doubling: suffixes whose first k words are unique are settled and not sorted again. The ranks of every k are
    kept, and the LCP of two neighbours adds up the largest k that still agree.
    """
    n = len(words)
    sa = np.argsort(words)
    sorted_words = words[sa]
    new = np.empty(n, bool)
    new[:1] = True
    new[1:] = sorted_words[1:] != sorted_words[:-1]
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    k, kept = 1, []
    while True:
        kept.append((k, rank.copy()))
        lonely = new.copy()
        lonely[:-1] &= new[1:]
        open_at = np.flatnonzero(~lonely)
        if not len(open_at):
            break
        a = sa[open_at]
        key = rank[a] * (n + 1) + rank[np.minimum(a + k, n)] + 1
        order = np.argsort(key)
        a, key = a[order], key[order]
        sa[open_at] = a
        first = np.empty(len(a), bool)
        first[:1] = True
        first[1:] = key[1:] != key[:-1]
        new[open_at] = first
        rank[a] = np.maximum.accumulate(np.where(first, open_at, 0))
        k *= 2
    lcp = np.zeros(n, np.int64)
    i, j = sa[:-1].copy(), sa[1:].copy()
    for size, ranks in reversed(kept):
        same = ranks[i] == ranks[j]
        same &= (i < n) & (j < n)
        step = np.where(same, size, 0)
        lcp[1:] += step
        i = np.minimum(i + step, n)
        j = np.minimum(j + step, n)
    return sa, rank[:n], lcp


def smaller_neighbours(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every boundary the nearest one to the left with a value not above its own, and to the right with one below."""
    left, right, stack, values = [0] * len(lcp), [len(lcp)] * len(lcp), [], []
    for at, value in enumerate(lcp.tolist()):
        while values and values[-1] > value:
            right[stack.pop()] = at
            values.pop()
        left[at] = stack[-1] if stack else 0
        stack.append(at)
        values.append(value)
    return np.array(left, np.int64), np.array(right, np.int64)


def branching_squares(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of every stretch of two equal halves whose next word differs from that of the first half."""
    sa, inverse, lcp = suffix_array(words)
    n = len(words)
    low, high = smaller_neighbours(lcp)
    at = np.flatnonzero(lcp > 0)
    low, high, depth = low[at], high[at], lcp[at]
    left_small = at - low <= high - at
    begin, end = np.where(left_small, low, at), np.where(left_small, at, high)
    other_begin, other_end = np.where(left_small, at, low), np.where(left_small, high, at)
    sizes = end - begin
    starts, periods = [], []
    ends = np.cumsum(sizes)
    done = 0
    while done < len(at):  # boundaries are taken in chunks of bounded size; a chunk has one at least
        base = ends[done - 1] if done else 0
        upto = max(int(np.searchsorted(ends, base + CHUNK, "right")), done + 1)
        size = sizes[done:upto]
        owner = np.repeat(np.arange(done, upto), size)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + begin[owner]
        i, d = sa[place], depth[owner]
        for shift in (d, -d):
            j = i + shift
            inside = (j >= 0) & (j < n)
            where = inverse[np.clip(j, 0, n - 1)]
            hit = inside & (where >= other_begin[owner]) & (where < other_end[owner])
            starts.append(np.minimum(i, j)[hit])
            periods.append(d[hit])
        done = upto
    if not starts:
        return np.array([], np.int64), np.array([], np.int64)
    return np.concatenate(starts), np.concatenate(periods)


def _rotated(words: np.ndarray, start: int, period: int) -> int:
    """How far a square moves to the left: the first place from which the words repeat with the period."""
    step = 64
    while start:
        size = min(step, start)
        differs = np.flatnonzero(words[start - size : start] != words[start - size + period : start + period])
        if len(differs):
            return start - size + int(differs[-1]) + 1
        start -= size
        step *= 2
    return 0


def runs(words: np.ndarray, min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence, by start and period.

    A run is a stretch of at least ``min_length`` words and two periods that no neighbouring word extends; its period is
    the smallest one.
    """
    start, period = branching_squares(words)
    end = start + 2 * period
    # A run of a short period covers the last min_length words before its end, so most short squares go here.
    short = np.flatnonzero(2 * period < min_length)
    fits = end[short] >= min_length
    for back in range(1, min_length):
        p = end[short] - back
        q = p - period[short]
        inside = period[short] + back <= min_length
        fits &= ~inside | (words[np.maximum(p, 0)] == words[np.maximum(q, 0)]) & (q >= 0)
    wanted = np.ones(len(start), bool)
    wanted[short] = fits
    start, period, end = start[wanted], period[wanted], end[wanted]
    found: list[tuple[int, int, int]] = []
    last, ending = -1, []
    for k in np.lexsort((period, end)).tolist():
        e, d = int(end[k]), int(period[k])
        if e != last:
            last, ending = e, []
        # A square of several periods of a run with the same end belongs to that run.
        if any(d % b == 0 and e - s >= 2 * d for s, b in ending):
            continue
        s = _rotated(words, e - 2 * d, d)
        ending.append((s, d))
        if e - s >= min_length:
            found.append((s, e - s, d))
    return sorted(found, key=lambda r: (r[0], r[2]))


def runs_of_texts(words: np.ndarray, lengths: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Runs of several texts that follow one another in ``words``; no two texts have a number in common."""
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    out: list[list[tuple[int, int, int]]] = [[] for _ in lengths]
    found = runs(words)
    at = np.searchsorted(bounds, [s for s, _, _ in found], "right") - 1
    for text, (s, length, d) in zip(at.tolist(), found, strict=True):
        out[text].append((s - int(bounds[text]), length, d))
    return out


def _with_repeats(words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which texts may have some REPEATED words twice: equal hashes of windows are taken as equal windows."""
    if len(words) < REPEATED:
        return np.zeros(len(lengths), bool)
    key = np.zeros(len(words) - REPEATED + 1, np.uint64)
    for i in range(REPEATED):
        key = (key ^ words[i : len(words) - REPEATED + 1 + i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    order = np.argsort(key)
    again = order[1:][key[order[1:]] == key[order[:-1]]]
    out = np.zeros(len(lengths), bool)
    out[np.searchsorted(np.cumsum(lengths), again, "right")] = True
    return out


def collapsed(words: list[str], found: list[tuple[int, int, int]]) -> list[str]:
    """The words that no run contains after its first period."""
    if not found:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for s, length, d in found:
        change[s + d] += 1
        change[s + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def _report(words: list[str], found: list[tuple[int, int, int]]) -> tuple:
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    exponent = 1000 * best[1] // best[2] if found else None
    listing = "".join(f"{s},{length},{d}\n" for s, length, d in found)
    return (len(found), *best, exponent, sha256(listing.encode()).hexdigest(), sha256(" ".join(collapsed(words, found)).encode()).hexdigest())


def as_they_are(doc_id, words: list[str]) -> list[str]:
    return words


def report(docs: DataFrame, change=as_they_are) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_runs, the longest run (start, length, period, exponent_milli; of equal ones
    the first, then that of the smaller period; null without a run), runs_sha256, collapsed_sha256.

    Words are separated by the ASCII white space; a null text has none. ``change`` maps (doc_id, words) to the words that
    are searched. A null doc_id stays null, repeated rows are reported again, an empty table gives no rows, and other
    columns are not read. A text is the work of one task, in time n log n of its words.
    """
    small_batches(docs.sparkSession)

    def work(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts, numbers, lengths = [], [], []
            total = 0
            for doc_id, text in zip(ids, batch.column(1), strict=True):
                words = change(doc_id, WORD.findall(text.as_py() or ""))
                known: dict[str, int] = {}
                numbers.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)) + total)
                total += len(known)
                texts.append(words)
                lengths.append(len(words))
            counts = np.array(lengths, np.int64)
            flat = np.concatenate(numbers) if numbers else np.array([], np.int64)
            searched = np.flatnonzero(_with_repeats(flat, counts))
            found: list[list] = [[] for _ in ids]
            slices = (np.cumsum(counts[searched]) - 1) // SHARED
            for part in np.split(searched, np.flatnonzero(np.diff(slices)) + 1) if len(searched) else []:
                some = runs_of_texts(np.concatenate([numbers[i] for i in part.tolist()]), counts[part])
                for i, r in zip(part.tolist(), some, strict=True):
                    found[i] = r
            rows = [(i, *_report(w, f)) for i, w, f in zip(ids, texts, found, strict=True)]
            kinds = [pa.int64()] * 6 + [pa.string()] * 2
            columns = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 8, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCHEMA.split(", ")])

    text: Column = F.col("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.cast("string").alias("text")).mapInArrow(work, SCHEMA)


def with_planted_tail(doc_id, words: list[str]) -> list[str]:
    """Every tenth document, by the CRC-32 of its id, gets a periodic tail; so the results have runs of known periods."""
    from zlib import crc32

    n, h = len(words), 1 if doc_id is None else crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
