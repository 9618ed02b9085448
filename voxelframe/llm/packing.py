"""Packing by power-of-two decomposition.

The length of a document in tokens is a sum of powers of two. The document is cut into pieces of these lengths, longest
first, after as many pieces of the full sequence length as fit. Every piece is a sequence of its own: none crosses
documents and none is padded. Sequences of equal length form a bucket, so batches are drawn from one bucket.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelframe.llm.common import small_batches

SEQUENCE = 2048
END_OF_DOCUMENT = 1
CACHE_WORDS = 250_000  # of each generation
TOGETHER = 1 << 20  # characters of the texts whose words are looked up at once

SCHEMA = "doc_id long, start long, length long, ids array<int>, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
BARE = SCHEMA.replace("ids array<int>, ", "")


def piece_lengths(tokens: int, sequence: int = SEQUENCE) -> list[int]:
    """Lengths of the pieces of a document: full sequences, then the binary digits of what is left, longest first."""
    whole, rest = divmod(tokens, sequence)
    return [sequence] * whole + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


class WordCache:
    """Token ids of the words of a text. The split pattern of the vocabulary drops white space and never looks across it,
    so a text's ids are those of its pieces put together. Words are kept in two generations: the older one goes when the
    newer one is full, so frequent words stay and memory is bounded."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @staticmethod
    def pieces(text: str) -> list[str]:
        """A text cut at spaces. Where it has nothing but letters, digits, spaces, line ends and single full stops and
        commas, it is also cut around these; where all characters are Latin-1, the lower case the vocabulary asks for is
        the built-in one. Both only make pieces repeat more often."""
        try:
            text.encode("latin-1")
            text = text.lower()
        except UnicodeEncodeError:
            pass
        bare = text.replace(" ", "").replace("\n", "").replace(".", "").replace(",", "")
        if bare.isalnum() and not any(p in text for p in ("..", ",,", ".,", ",.")):
            text = text.replace(".", " . ").replace(",", " , ").replace("\n", " ")
        return text.split(" ")

    def ids_of(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text; words that are in no generation go through the tokenizer together."""
        cut = [self.pieces(text) for text in texts]
        new, old = self.new, self.old
        unknown: dict[str, None] = {}
        for words in cut:
            for word in set(words).difference(new):
                known = old.get(word)
                if known is None:
                    unknown[word] = None
                else:
                    new[word] = known
        waiting = list(unknown)
        for i in range(0, len(waiting), 5000):
            part = waiting[i : i + 5000]
            for word, code in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                new[word] = array("I", code.ids).tobytes()
        out = [np.frombuffer(b"".join(map(new.__getitem__, words)), dtype="<u4") for words in cut]
        if len(new) > CACHE_WORDS:
            self.old, self.new = new, {}
        return out

    def ids(self, text: str) -> np.ndarray:
        return self.ids_of([text])[0]


def together(texts: list[str], chars: int = TOGETHER) -> Iterator[list[str]]:
    """The texts in their order, in lists of about so many characters; a longer text is a list of its own."""
    part: list[str] = []
    size = 0
    for text in texts:
        if part and size + len(text) > chars:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


@lru_cache(maxsize=2)
def word_cache(path: str) -> WordCache:
    """One cache for all tasks a Python worker runs."""
    return WordCache(path)


def pack(docs: DataFrame, vocabulary: str, sequence: int = SEQUENCE, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset.

    ``sequence`` is a power of two. A document is its token ids and one end-of-document id, so an empty or null text is a
    single piece of length 1; a null doc_id stays null and repeated rows are packed again. An empty table gives no rows;
    other columns of ``docs`` are not read. ``sequence_id`` is unique: it counts the sequences of a task and carries the
    task in its upper bits; ``length`` names the bucket. ``with_ids=False`` leaves the ids out.
    """
    if sequence < 1 or sequence & (sequence - 1):
        raise ValueError("the sequence length must be a power of two")
    small_batches(docs.sparkSession)

    def work(batches):
        cache = word_cache(vocabulary)
        task = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        made = 0
        end = np.array([END_OF_DOCUMENT], dtype="<u4")
        for batch in batches:
            rows: list[tuple] = []
            blobs: list[np.ndarray] = []
            texts = [text or "" for text in batch.column(1).to_pylist()]
            found = (ids for part in together(texts) for ids in cache.ids_of(part))
            for doc_id, words in zip(batch.column(0).to_pylist(), found, strict=True):
                ids = np.concatenate([words, end])
                at = 0
                for size in piece_lengths(len(ids), sequence):
                    part = ids[at : at + size]
                    rows.append((doc_id, at, size, zlib.crc32(part), len(ids), task + made, 0))
                    if with_ids:
                        blobs.append(part.astype(np.int32))
                    at += size
                    made += 1
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 7
            if with_ids:
                offsets = np.concatenate([[0], np.cumsum([len(b) for b in blobs])]).astype(np.int32)
                flat = np.concatenate(blobs) if blobs else np.array([], np.int32)
                columns.insert(3, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)))
            names = [c.split()[0] for c in (SCHEMA if with_ids else BARE).split(", ")]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select("doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(work, SCHEMA if with_ids else BARE)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Store packed sequences, one folder per sequence length; a batch reader takes one folder at a time."""
    pieces.write.partitionBy("length").parquet(path)
