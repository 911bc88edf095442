import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helpers import LONG, NASTY, frame
from quarrymill.llm import repeats


def brute(rows, length=50):
    first = {}
    for i, t in rows:
        raw = (t or "").encode()
        for p in range(len(raw) - length + 1):
            s = raw[p : p + length]
            first[s] = min(first.get(s, i), i)
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if first[raw[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        spans = sum(g and (n == 0 or not gone[n - 1]) for n, g in enumerate(gone))
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=6).map(lambda b: bytes(c % 3 for c in b)), max_size=20).map(sorted), max_size=9))
def test_merge_with_a_loser_tree(runs):
    got = list(repeats.merge([repeats.front_decode(*repeats.front_code(r)) for r in runs]))
    keys = sorted(k for r in runs for k in r)
    assert [k for k, _, _ in got] == keys
    for before, (key, prefix, _) in zip([b"", *keys], got):
        assert prefix == repeats.shared_length(before, key)
    for n, r in enumerate(runs):
        assert [k for k, _, run in got if run == n] == r


def texts(seed, n=120):
    r = random.Random(seed)
    words = [f"{r.choice('abcdé')}{r.randrange(10**6)}" for _ in range(400)]
    passages = [" ".join(r.choice(words) for _ in range(r.randrange(3, 30))) for _ in range(12)]
    out = []
    for _ in range(n):
        parts = [r.choice(passages) if r.random() < 0.3 else " ".join(r.choice(words) for _ in range(r.randrange(1, 25))) for _ in range(r.randrange(1, 6))]
        text = " ".join(parts)
        out.append(out[r.randrange(len(out))][: r.randrange(1, 400)] + r.choice(["", "x"]) if out and r.random() < 0.3 else text)
    ids = r.sample(range(10**6), n)
    return list(zip(ids, out))


@pytest.mark.parametrize(("block", "bucket"), [(4 << 20, 16 << 20), (3000, 200), (1, 1 << 20)])
def test_like_brute_force(spark, block, bucket):
    rows = texts(block)
    assert sorted(map(tuple, repeats.remove_repeats(frame(spark, rows), 50, block, bucket).collect())) == brute(rows)


def test_several_buckets_in_a_partition(spark, monkeypatch):
    monkeypatch.setattr(repeats, "MOST_PARTS", 3)
    rows = texts(5)
    assert sorted(map(tuple, repeats.remove_repeats(frame(spark, rows), 50, 3000, 200).collect())) == brute(rows)


def test_nasty(spark):
    rows = [*NASTY, *((100 + i, "A hot passage that very many of the documents share, " * 2 + str(i)) for i in range(60)), (300, "y" * 49), (301, "y" * 49), (302, "y" * 50), (303, "y" * 51), (303, "y" * 50), (304, LONG[1000:5000])]
    assert sorted(map(tuple, repeats.remove_repeats(frame(spark, rows), block_bytes=30_000).collect())) == brute(rows)
    assert repeats.remove_repeats(frame(spark, [])).count() == 0


def test_other_lengths_and_texts(spark):
    rows = texts(9, 40)
    got = repeats.remove_repeats(frame(spark, rows), 32, keep_text=True).collect()
    assert sorted(tuple(r)[:5] for r in got) == brute(rows, 32)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)
    with pytest.raises(ValueError, match="length"):
        repeats.remove_repeats(frame(spark), 10)


def test_whole_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, repeats.op9(spark, sf).collect())) == brute(docs)
