from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from helpers import NASTY, frame
from quarrymill.llm import token_counts as tc
from quarrymill.llm.common import tokenizer_file

JSON, RANKS = map(tokenizer_file, ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken"))
BYTES = Tokenizer.from_file(JSON)


def count(text):
    return len(BYTES.encode(text, add_special_tokens=False).ids)


WORDS = st.lists(st.sampled_from(["a", " word", "  ", "\n", " x.", "'s", "12", " <|endoftext|>", "<|end", "oftext|>", "é", " the quick", "!"]), max_size=60).map("".join)


@settings(max_examples=300, deadline=None)
@given(WORDS, st.lists(st.tuples(st.integers(-2, 120), st.integers(-2, 120), WORDS.map(lambda t: t[:20])), max_size=6))
def test_edits_like_brute_force(text, edits):
    tc.LEAF_PIECES, tc.LEAF_MOST, kept = 2, 24, (tc.LEAF_PIECES, tc.LEAF_MOST)
    try:
        tree = tc.TokenTree(text, count)
        assert (tree.text(), len(tree), tree.n_tokens) == (text, len(text), count(text))
        for start, stop, new in edits:
            start = min(max(start, 0), len(text))
            stop = min(max(stop, start), len(text))
            text = text[:start] + new + text[stop:]
            tree.edit(start, stop, new)
            assert tree.text() == text and len(tree) == len(text)
            assert tree.n_tokens == count(text)
    finally:
        tc.LEAF_PIECES, tc.LEAF_MOST = kept


def brute(text, edits):
    before = text
    for start, stop, new in edits:
        start = min(max(start, 0), len(text))
        text = text[:start] + new + text[min(max(stop, start), len(text)) :]
    return len(before), count(before), len(text), count(text)


def of_query(n):
    third, half, moved = n // 3, n // 2, 21 - min(40, n - n // 3)
    return [(third, third + 40, " an edit's passage, 7"), (half + moved, half + moved + n // 50, ""), (n - 3, n - 3, "? The last sentence.")]


def test_nasty_and_joined_edits(spark):
    edits = spark.createDataFrame([(8, 2, 5, 9, "z"), (8, 1, 100, 100, "long insertion " * 900), (17, 1, None, None, None), (4, 1, 0, 0, "b"), (999, 1, 0, 1, "")], "doc_id long, seq int, start long, stop long, replacement string")
    got = {r.doc_id: r for r in tc.count_tokens(tc.with_edits(frame(spark), edits), JSON, RANKS).collect()}
    by = {8: [(100, 100, "long insertion " * 900), (5, 9, "z")], 17: [(0, 10**9, "")], 4: [(0, 0, "b")]}
    assert set(got) == {i for i, _ in NASTY}
    for i, t in NASTY:
        r = got[i]
        assert (r.n_chars, r.n_tokens, r.edited_chars, r.edited_tokens) == brute(t or "", by.get(i, []))
    assert tc.count_tokens(tc.with_edits(frame(spark, []), edits), JSON, RANKS).count() == 0


def test_whole_table(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = tc.op4(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        text = docs[r.doc_id]
        assert (r.n_chars, r.n_tokens, r.edited_chars, r.edited_tokens) == brute(text, of_query(len(text)))
        assert r.encoded_chars < 5000
