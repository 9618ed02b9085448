"""BPE, packing and token counts against the public tokenizers."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from llm.conftest import EDGES
from voxelframe.llm import bpe, packing, token_counts

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def byte_tokenizer():
    return Tokenizer.from_file(BYTES)


@pytest.fixture(scope="module")
def word_tokenizer():
    return Tokenizer.from_file(WORDS)


def odd_texts():
    rng = random.Random(5)
    letters = ["a", "b", "th", "e", " ", "  ", "\n", "\t", "'s", "é", "日", "!", "12", "<|endoftext|>", "Σ", "İ", "\x1c", "\xa0", "́", ".", ",", "..", "ß", "🤯", "²"]
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(1500)] + ["a" * 3000, "ab" * 2000]


def test_prefix_encoder_on_odd_texts(byte_tokenizer):
    encoder = bpe.PrefixEncoder(BYTES)
    for text in odd_texts():
        ids = byte_tokenizer.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text) == ids
        assert encoder.decode(ids) == byte_tokenizer.decode(ids, skip_special_tokens=False)


def test_small_caches_change_nothing(byte_tokenizer, pairs, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 20)
    monkeypatch.setattr(bpe, "CACHE_PAIRS", 20)
    encoder = bpe.PrefixEncoder(BYTES)
    for _, text in pairs[:30]:
        assert encoder.encode(text) == byte_tokenizer.encode(text, add_special_tokens=False).ids


def test_words_of_packing_on_odd_texts(word_tokenizer):
    cache = packing.WordCache(WORDS)
    for text in odd_texts():
        assert cache.ids(text).tolist() == word_tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("table", ["docs", "edges", "empty"])
def test_encode(table, request, byte_tokenizer):
    frame = request.getfixturevalue(table)
    rows = [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]
    want, digest = [], []
    for i, t in rows:
        ids = byte_tokenizer.encode(t or "", add_special_tokens=False).ids
        text = byte_tokenizer.decode(ids, skip_special_tokens=False)
        want.append(repr((i, ids, text)))
        digest.append(repr((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())))
    assert sorted(want) == sorted(repr(tuple(r)) for r in bpe.encode(frame, BYTES).collect())
    assert sorted(digest) == sorted(repr(tuple(r)) for r in bpe.digests(frame, BYTES).collect())


@pytest.mark.parametrize("table", ["docs", "edges", "empty"])
def test_pack(table, request, word_tokenizer):
    frame = request.getfixturevalue(table)
    pieces = packing.pack(frame, WORDS).collect()
    want = sorted(repr((r.doc_id, word_tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1])) for r in frame.select("doc_id", "text").collect())
    whole, ids, start = [], [], 0
    for p in sorted(pieces, key=lambda p: p.sequence_id):
        if p.start == 0 and ids:
            whole.append(repr((start, ids)))
            ids = []
        start = p.doc_id
        assert p.start == len(ids) and p.length == len(p.ids) <= 2048 and p.length & (p.length - 1) == 0 and p.offset == 0
        assert p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
        ids = ids + p.ids
        assert len(ids) <= p.doc_tokens
    whole += [repr((start, ids))] if ids else []
    assert sorted(whole) == want
    assert len({p.sequence_id for p in pieces}) == len(pieces)
    bare = packing.pack(frame, WORDS, with_ids=False)
    assert "ids" not in bare.columns and bare.count() == len(pieces)


def test_piece_lengths():
    assert packing.piece_lengths(1) == [1] and packing.piece_lengths(4097) == [2048, 2048, 1] and packing.piece_lengths(7, 4) == [4, 2, 1]
    with pytest.raises(ValueError):
        packing.pack(None, WORDS, sequence=1000)


def test_buckets(spark, docs, tmp_path):
    packing.write_buckets(packing.pack(docs, WORDS), str(tmp_path / "b"))
    back = spark.read.parquet(str(tmp_path / "b"))
    assert back.where("size(ids) <> length").count() == 0


def spark_counts(spark, frame, block):
    path = token_counts.write_token_files(frame, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    found = token_counts.count_tokens(spark, path, block_bytes=block, head=5).collect()
    number = lambda head: sum(d << 15 * i for i, d in enumerate(head))
    return sorted((number(r.head) - (1 << 64) if number(r.head) >> 63 else number(r.head), r.n_ids - 5) for r in found)


@pytest.mark.parametrize("table", ["docs", "edges", "empty"])
@pytest.mark.parametrize("block", [1 << 18, 1000, 14])
def test_token_counts(spark, table, block, request, byte_tokenizer):
    frame = request.getfixturevalue(table)
    byte_tokenizer.encode_special_tokens = True
    frame = frame.where("length(text) < 20000 or text is null") if block == 14 else frame
    want = sorted((-1 if r.doc_id is None else r.doc_id, len(byte_tokenizer.encode(r.text or "", add_special_tokens=False).ids)) for r in frame.select("doc_id", "text").collect())
    byte_tokenizer.encode_special_tokens = False
    assert spark_counts(spark, frame, block) == want


@pytest.mark.parametrize("block", [2, 4, 6, 64])
def test_scan_of_foreign_files(spark, tmp_path, block):
    """Empty documents, a missing last separator, a file of one separator, an empty file."""
    rng = np.random.default_rng(block)
    want = []
    for name in ("a", "b", "c", "d"):
        ids = {"c": np.array([9]), "d": np.array([], int)}.get(name, rng.integers(0, 10, 200))
        (tmp_path / name).write_bytes(ids.astype("<u2").tobytes())
        start = 0
        for end in [*np.flatnonzero(ids == 9), len(ids)]:
            if end < len(ids) or end > start:
                want.append((name, start, int(end - start), ids[start : min(end, start + 3)].tolist()))
            start = int(end) + 1
    got = token_counts.count_tokens(spark, str(tmp_path), separator=9, block_bytes=block, head=3).collect()
    assert sorted((r.file[-1], r.start, r.n_ids, r.head) for r in got) == sorted(want)
