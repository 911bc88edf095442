import hashlib
from collections import defaultdict

import pytest

from helpers import NASTY, frame
from quarrymill.llm import exact_dedup, fingerprints


def brute_groups(rows, keep):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    return sorted((i, keep(groups[t or ""]), len(groups[t or ""]), i == keep(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)


@pytest.mark.parametrize("digest_bytes", [16, 1, 0])
@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact(spark, digest_bytes, keep):
    rows = [*NASTY, *((100 + i, "hot copy") for i in range(40)), *((200 + i, f"other {i}") for i in range(60)), (300, "twice"), (300, "twice")]
    got = exact_dedup.exact_duplicates(frame(spark, rows), keep, digest_bytes)
    assert sorted(map(tuple, got.collect())) == brute_groups(rows, {"min": min, "max": max}[keep])


def test_exact_empty(spark):
    assert exact_dedup.exact_duplicates(frame(spark, [])).count() == 0
    assert fingerprints.fingerprints(frame(spark, [])).count() == 0


def test_exact_whole_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, exact_dedup.op3(spark, sf).collect())) == brute_groups(docs, max)


def brute_fingerprints(rows):
    rows = sorted((i, t or "") for i, t in rows)
    out = {}
    for n, (i, t) in enumerate(rows):
        following = rows[(n + 1) % len(rows)][1]
        k = len(t) // 4
        changed = t[: len(t) - k] + following[:k]
        form = fingerprints.canonical
        out[i] = (len(t), hashlib.sha256(changed.encode()).hexdigest(), float(form(t) == form(changed)), float(form(t) == form(following)))
    return out


@pytest.mark.parametrize(("bits", "chars"), [(128, 4_000_000), (16, 20_000), (8, 1), (0, 1000)])
def test_fingerprints(spark, bits, chars):
    rows = [*NASTY, *((100 + i, f"Copy {i // 7}") for i in range(50))]
    got = fingerprints.fingerprints(frame(spark, rows), bits, chars).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got} == brute_fingerprints(rows) and len(got) == len(rows)
    of = {r.doc_id: r.fingerprint for r in got}
    forms = {i: fingerprints.canonical(t or "") for i, t in rows}
    assert all((of[a] == of[b]) == (forms[a] == forms[b]) for a in of for b in of)
    assert of[5] == of[7]
    ordered = sorted((i, t or "") for i, t in rows)
    changed = {i: fingerprints.canonical(fingerprints.edited(t, ordered[(n + 1) % len(ordered)][1])) for n, (i, t) in enumerate(ordered)}
    both = [(r.fingerprint, forms[r.doc_id]) for r in got] + [(r.edited_fingerprint, changed[r.doc_id]) for r in got]
    assert len({f for f, _ in both}) == len({t for _, t in both}) == len(set(both))


def test_one_document_follows_itself(spark):
    (r,) = fingerprints.fingerprints(frame(spark, [(5, "abcdefgh")])).collect()
    assert r.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and r.near_next == 1.0


def test_fingerprints_whole_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in fingerprints.op1(spark, sf).collect()}
    assert got == brute_fingerprints(docs)
