"""Runs of words against brute force over all periods, and reports against a plain version."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from llm.conftest import EDGES, FOLDER
from voxelframe.llm import runs
from voxelframe.llm.queries import QUERIES


def plain_runs(words, least=12):
    found, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def plain_change(doc_id, words):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 == 0 and n > 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return list(words)


def plain_row(doc_id, text, change):
    words = re.findall(r"[^ \t\n\x0b\x0c\r]+", text or "")
    words = plain_change(doc_id, words) if change else words
    found = plain_runs(words)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    s, length, q = sorted(found, key=lambda r: (-r[1], r[0], r[2]))[0] if found else (None, None, None)
    listing = "".join(f"{a},{b},{c}\n" for a, b, c in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    digests = [hashlib.sha256(t.encode()).hexdigest() for t in (listing, kept)]
    return (doc_id, len(found), s, length, q, 1000 * length // q if found else None, *digests)


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("seed", range(30))
def test_runs_of_random_sequences(seed):
    rng = random.Random(seed)
    words = []
    while len(words) < rng.randint(0, 300):
        block = [rng.randint(0, rng.choice([1, 2, 5, 50])) for _ in range(rng.randint(1, 25))]
        words += block * rng.randint(1, 6) + block[: rng.randint(0, len(block))]
    assert runs.runs(np.array(words, np.int64)) == plain_runs(words)


@pytest.mark.parametrize("words", [[], [0], [0] * 11, [0] * 12, [0] * 200, [0, 1] * 60, fibonacci(230), [0, 0, 1] * 4 + [0, 0, 2] * 5, list(range(6)) * 2, list(range(50))])
def test_runs_of_regular_sequences(words):
    assert runs.runs(np.array(words, np.int64)) == plain_runs(words)


def test_suffix_array():
    rng = random.Random(3)
    for n in (1, 2, 50, 300):
        words = [rng.randint(0, 2) for _ in range(n)]
        sa, inverse, lcp = runs.suffix_array(np.array(words, np.int64))
        assert sa.tolist() == sorted(range(n), key=lambda i: words[i:]) and [inverse[i] for i in sa] == list(range(n))
        for t in range(1, n):
            a, b = words[sa[t - 1] :], words[sa[t] :]
            assert lcp[t] == next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))


def test_texts_of_a_batch_do_not_meet():
    """Equal texts side by side, an empty one among them: each has the runs it has alone."""
    texts = [[0, 1] * 8, [0, 1] * 8, [], [3] * 30, [1, 2, 3]]
    numbers = np.array([w + 10 * i for i, t in enumerate(texts) for w in t], np.int64)
    assert runs.runs_of_texts(numbers, np.array([len(t) for t in texts])) == [plain_runs(t) for t in texts]


@pytest.mark.parametrize("change", [False, True])
def test_reports(spark, pairs, edges, change):
    function = {"change": runs.with_planted_tail} if change else {}
    for frame, rows in ((spark.createDataFrame(pairs, "doc_id long, text string"), pairs), (edges, EDGES)):
        rows = [(i, t) for i, t in rows if not t or len(t) < 30_000]
        got = runs.report(frame.where("text is null or length(text) < 30000"), **function)
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(plain_row(i, t, change)) for i, t in rows)


def test_empty_table(empty):
    assert runs.report(empty).count() == 0


def test_very_long_texts(spark):
    """One word 200,000 times, and a period of 70,000 words: three copies and a part are one run."""
    block = [f"w{i % 69_997}" for i in range(70_000)]
    text = " ".join(block * 3 + block[:5000])
    frame = spark.createDataFrame([(1, "x " * 200_000), (2, text)], "doc_id long, text string")
    rows = {r.doc_id: r for r in runs.report(frame).collect()}
    assert (rows[1].n_runs, rows[1].start, rows[1].length, rows[1].period) == (1, 0, 200_000, 1)
    assert rows[1].collapsed_sha256 == hashlib.sha256(b"x").hexdigest()
    assert (rows[2].start, rows[2].length, rows[2].period, rows[2].exponent_milli) == (0, 215_000, 70_000, 3071)


def test_registered_query(spark, pairs):
    got = QUERIES["op11_periodic_runs"](spark, FOLDER).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(plain_row(i, t, True)) for i, t in pairs)
