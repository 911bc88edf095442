import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from helpers import NASTY, frame
from quarrymill.llm import bpe, byte_bpe, packing
from quarrymill.llm.common import tokenizer_file

JSON, RANKS, WORDS = map(tokenizer_file, ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "word_bpe_49k.json"))
BYTES, WORD = Tokenizer.from_file(JSON), Tokenizer.from_file(WORDS)


def ids_of(text):
    return [*BYTES.encode(text or "", add_special_tokens=False).ids, 1]


def brute_cost(positions, penalties, window):
    best = [0] + [10**9] * (len(positions) - 1)
    for j in range(1, len(positions)):
        best[j] = min(best[i] + window - positions[j] + positions[i] + penalties[j] for i in range(j) if positions[j] - positions[i] <= window)
    return best[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.integers(0, 6)), min_size=1, max_size=40))
def test_cuts_cost_no_more_than_any_others(steps):
    positions, penalties = [0], [0]
    for k, p in steps:
        positions.append(positions[-1] + k)
        penalties.append(p)
    cuts = packing.choose_cuts(positions, penalties, 10)
    ends = [0, *cuts]
    cost = sum(10 - positions[b] + positions[a] + penalties[b] for a, b in zip(ends, cuts))
    assert cuts[-1] == len(positions) - 1 and cost == brute_cost(positions, penalties, 10)


def check_pieces(rows, docs, window=2048):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == {i for i, _ in docs}
    for doc_id, text in docs:
        ids, at = ids_of(text), 0
        for r in sorted(by_doc[doc_id], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window


@pytest.mark.parametrize("block", [100, 4096, 1 << 19])
def test_pack_nasty(spark, block):
    check_pieces(packing.pack(frame(spark), JSON, RANKS, block_tokens=max(block, 4096)).collect(), NASTY)
    check_pieces(packing.pack(frame(spark), JSON, RANKS, window=64, block_tokens=max(block, 128)).collect(), NASTY, 64)


def test_pack_whole_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = packing.op2(spark, sf).collect()
    check_pieces(rows, docs)
    used = defaultdict(int)
    for r in rows:
        used[r.sequence_id] += r.length
    assert sum(used.values()) / (2048 * len(used)) > 0.97


def test_empty_tables(spark):
    none = frame(spark, [])
    assert packing.pack(none, JSON, RANKS).count() == 0
    assert bpe.encode_documents(none, WORDS).count() == 0


def as_library(text):
    ids = WORD.encode(text or "", add_special_tokens=False).ids
    return np.array(ids, "<u4").tobytes(), WORD.decode(ids, skip_special_tokens=False)


def test_encode_nasty(spark):
    got = {r.doc_id: (bytes(r.ids), r.decoded) for r in bpe.encode_documents(frame(spark), WORDS).collect()}
    assert got == {i: as_library(t) for i, t in NASTY}


def test_encode_whole_table(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = bpe.op5(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        ids, text = as_library(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


ALPHABET = st.text(st.one_of(st.sampled_from(" \n\t.,'12aAzZéÉßΣñ½\xa0　\x1c\x85"), st.characters(max_codepoint=0x2FFF, exclude_categories=["Cs", "Cn"])), max_size=40)


@settings(max_examples=400, deadline=None)
@given(ALPHABET)
def test_encode_like_the_library(text):
    assert bpe.word_bpe(WORDS).encode(text) == as_library(text)


@settings(max_examples=400, deadline=None)
@given(ALPHABET)
def test_byte_ids_like_the_library(text):
    assert [*byte_bpe.encoder(JSON, RANKS)(text), 1] == ids_of(text)


def test_small_tables_of_kept_words(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 2)
    text = "one two three two one four five one"
    assert bpe.WordBpe(WORDS).encode(text) == as_library(text)
