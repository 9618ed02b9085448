"""Byte-level BPE by dynamic programming over prefixes.

The encoding of every prefix of a word has one last token. It is the one token that is a suffix of the prefix and whose
pair with the last token of what comes before survives merging (the pair is compatible). So one pass over the word stores
a single token per prefix: an automaton over the vocabulary lists the tokens that end at each byte, longest first, and
the first one whose pair is compatible is kept; back-pointers from the end then give the ids.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelframe.llm.common import small_batches

CACHE_WORDS = 120_000  # of each generation
CACHE_PAIRS = 300_000
# The contractions, letters, digits, other characters and white space that the vocabulary's merges never cross.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable bytes stand for
    themselves, the others take the characters from 256 on."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    letters, fresh = [""] * 256, 256
    for b in range(256):
        if b in printable:
            letters[b] = chr(b)
        else:
            letters[b], fresh = chr(fresh), fresh + 1
    return letters


class Recent:
    """A bounded dictionary of two generations: the older one goes when the newer one is full."""

    def __init__(self, limit: int):
        self.limit, self.new, self.old = limit, {}, {}

    def get(self, key):
        found = self.new.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.new) >= self.limit:
            self.old, self.new = self.new, {}
        self.new[key] = value


class PrefixEncoder:
    """Encoder and decoder of one vocabulary file (tokenizers JSON, byte-level BPE)."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        vocabulary = data["model"]["vocab"]
        self.letters = byte_letters()
        values = {c: b for b, c in enumerate(self.letters)}
        self.table = {b: self.letters[b] for b in range(256)}  # for str.translate of latin-1 decoded bytes
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, (left, right) in enumerate(data["model"]["merges"]):
            a, b = vocabulary[left], vocabulary[right]
            self.rank[a, b] = rank
            self.parts.setdefault(vocabulary[left + right], (rank, a, b))
        self.automaton = ahocorasick.Automaton()
        for token, number in vocabulary.items():
            if len(token) == 1 or number in self.parts:  # others cannot be reached by merges
                self.automaton.add_word(token, (len(token), number))
        self.automaton.make_automaton()
        self.bytes_of = {n: bytes(values[c] for c in t) for t, n in vocabulary.items()}
        self.specials = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.bytes_of.update({n: t.encode() for t, n in self.specials.items()})
        self.special_pattern = regex.compile("|".join(regex.escape(t) for t in sorted(self.specials, key=len, reverse=True))) if self.specials else None
        self.pattern = regex.compile(WORDS)
        self.right_edges: dict[int, list] = {}
        self.left_edges: dict[int, list] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words = Recent(CACHE_WORDS)
        self.chunks = Recent(CACHE_WORDS)

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """Tokens that stand at one edge while ``token`` is being merged, each with the rank of the merge that uses it up."""
        edge, until = [], float("inf")
        while True:
            edge.append((token, until))
            if token not in self.parts:
                return edge
            until, *children = self.parts[token]
            token = children[side]

    def compatible(self, a: int, b: int) -> bool:
        """Whether token a followed by token b stays as it is: no merge across the border comes before the merges that
        use up its two sides. Of two merges of one rank the left one comes first."""
        known = self.pairs.get((a, b))
        if known is not None:
            return known
        if a not in self.right_edges:
            self.right_edges[a] = self._edge(a, 1)
        if b not in self.left_edges:
            self.left_edges[b] = self._edge(b, 0)
        get, good = self.rank.get, True
        for x, x_until in self.right_edges[a]:
            for y, y_until in self.left_edges[b]:
                r = get((x, y))
                if r is not None and r < x_until and r <= y_until:
                    good = False
                    break
            if not good:
                break
        if len(self.pairs) > CACHE_PAIRS:
            self.pairs.clear()
        self.pairs[a, b] = good
        return good

    def encode_word(self, word: str) -> tuple[int, ...]:
        """Ids of one word (a piece that merges never leave)."""
        known = self.words.get(word)
        if known is not None:
            return known
        letters = word.encode("utf-8").decode("latin-1").translate(self.table)
        last: list[tuple[int, int]] = [(-1, 0)]  # per prefix: its last token and where that token starts
        done, pairs = 0, self.pairs
        for end, (size, token) in self.automaton.iter(letters):
            if end < done:
                continue  # this prefix has its token
            begin = end + 1 - size
            before = last[begin][0]
            if before < 0 and begin:
                continue
            if begin:
                good = pairs.get((before, token))
                if not (self.compatible(before, token) if good is None else good):
                    continue
            last.append((token, begin))
            done = end + 1
        ids, at = [], len(letters)
        while at:
            token, at = last[at]
            ids.append(token)
        out = tuple(reversed(ids))
        if len(word) < 200:
            self.words.put(word, out)
        return out

    def _ordinary(self, text: str) -> list[int]:
        ids: list[int] = []
        pieces = text.split(" ")
        # A single space between two other characters always starts a word, so the text can be cut there. Line ends are
        # the only other white space that prints as nothing else.
        if "" in pieces or " \n" in text or "\n " in text or not text.replace("\n", "").isprintable():
            for word in self.pattern.findall(text):
                ids += self.encode_word(word)
            return ids
        for word in self.pattern.findall(pieces[0]):
            ids += self.encode_word(word)
        chunks = self.chunks
        new = chunks.new
        for piece in pieces[1:]:
            found = new.get(piece)
            if found is None:
                found = chunks.get(piece)
                if found is None:
                    made: list[int] = []
                    for word in self.pattern.findall(" " + piece):
                        made += self.encode_word(word)
                    found = tuple(made)
                    if len(piece) < 200:
                        chunks.put(piece, found)
                new = chunks.new
            ids += found
        return ids

    def encode(self, text: str) -> list[int]:
        """Ids of a text; strings of special tokens become their ids."""
        if self.special_pattern is None or not any(s in text for s in self.specials):
            return self._ordinary(text) if text else []
        ids, at = [], 0
        for hit in self.special_pattern.finditer(text):
            if hit.start() > at:
                ids += self._ordinary(text[at : hit.start()])
            ids.append(self.specials[hit.group()])
            at = hit.end()
        if at < len(text):
            ids += self._ordinary(text[at:])
        return ids

    def decode(self, ids: list[int]) -> str:
        """Text of the ids; bytes that are no UTF-8 become replacement characters, unknown ids are left out."""
        get = self.bytes_of.get
        return b"".join([get(i, b"") for i in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def prefix_encoder(path: str) -> PrefixEncoder:
    """One encoder for all tasks a Python worker runs."""
    return PrefixEncoder(path)


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, ids array<int>, decoded.

    A null text counts as empty and has no ids; a null doc_id stays null; repeated rows are encoded again; an empty table
    gives no rows; other columns are not read.
    """
    return _run(docs, vocabulary, "doc_id long, ids array<int>, decoded string", lambda ids, text: (ids, text))


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """As ``encode``, with digests made in the task: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def short(ids, text):
        listed = ",".join(map(str, ids))
        return len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text.encode("utf-8")).hexdigest()

    return _run(docs, vocabulary, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", short)


def _run(docs: DataFrame, vocabulary: str, schema: str, form) -> DataFrame:
    small_batches(docs.sparkSession)
    kinds = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    fields = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])

    def work(batches):
        encoder = prefix_encoder(vocabulary)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encoder.encode(text.as_py() or "")
                rows.append((doc_id, *form(ids, encoder.decode(ids))))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, schema)
