"""The table the pipeline ends with holds the packed sequences themselves."""

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as cp
from llm.conftest import FOLDER
from voxelframe.llm import packing


def test_last_stage_returns_the_ids(spark, docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    few = docs.orderBy("doc_id").limit(20)
    rows = cp.STAGES[-1][1](spark, few, FOLDER).collect()
    assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4")) == r.ids_crc32 for r in rows)
    for i, text in {(r.doc_id, r.text) for r in few.collect()}:
        ids = [x for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start) for x in r.ids]
        assert ids == [*tokenizer.encode(text, add_special_tokens=False).ids, packing.END_OF_DOCUMENT]


def test_texts_are_looked_up_in_lists_of_bounded_size():
    from voxelframe.llm.packing import together

    texts = ["a" * 5, "", "b" * 6, "c" * 30, "", "d"]
    assert list(together(texts, 10)) == [["a" * 5, ""], ["b" * 6], ["c" * 30], ["", "d"]] and list(together([], 10)) == []
