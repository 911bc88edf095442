import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from helpers import LONG, NASTY, frame
from quarrymill.llm import simhash
from quarrymill.llm.components import components


def brute_fingerprint(text, k=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def brute_wide(text, k, prints):
    """The fingerprints of the set of shingles, mixed one by one."""
    words = text.encode().lower().split()
    hashes = {xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(max(1, len(words) - k + 1))} if words else set()
    whole, out = (1 << 64) - 1, []
    for r in range(prints):
        mixed = []
        for x in hashes:
            if r:
                x = (x + r * 0x9E3779B97F4A7C15) & whole
                x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & whole
                x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & whole
                x ^= x >> 31
            mixed.append(x)
        out.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in mixed) > len(mixed)))
    return out


def near(x, y, distance, n):
    parts = [64 * i // n for i in range(n + 1)]
    d = f"{x ^ y:064b}"[::-1]
    return d.count("1") <= distance and min(d[a:b].count("1") for a, b in zip(parts, parts[1:])) <= 1


def brute_components(fps, distance, segments=None):
    """fps: (id, one fingerprint or several) -> {id: component}."""
    fps = [(i, f if isinstance(f, list) else [f]) for i, f in fps]
    parent = {i: i for i, _ in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(fps):
        for j, b in fps[:n]:
            if any(near(x, y, distance, segments or distance // 2 + 1) for x, y in zip(a, b)):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i, _ in fps}


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("aAbÀ \t\n\x0b\x1c "), max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_long_fingerprint():
    assert simhash.fingerprint(LONG) == brute_fingerprint(LONG)


@pytest.mark.parametrize("distance", [1, 2, 3, 5])
def test_variants_find_all_links(distance):
    r = random.Random(distance)
    for _ in range(200):
        a = r.getrandbits(64)
        b = a ^ sum(1 << x for x in r.sample(range(64), distance))
        x, y = simhash.variants(np.array([a, b], "u8"), distance // 2 + 1)
        assert (x == y).any()
    assert len({int(v) for v in simhash.variants(np.array([0], "u8"), distance // 2 + 1)[0]}) == 64


@pytest.mark.parametrize("distance", [1, 2])
def test_large_buckets_like_small_ones(distance, monkeypatch):
    r = random.Random(3)
    fps = np.array(sorted({r.getrandbits(9) << 20 | 7 for _ in range(200)}), "u8")
    pairs = {tuple(sorted(p)) for p in zip(*map(np.ndarray.tolist, simhash.near(fps, distance)))}
    monkeypatch.setattr(simhash, "LARGE", 10)
    assert pairs == {tuple(sorted(p)) for p in zip(*map(np.ndarray.tolist, simhash.near(fps, distance)))} and pairs
    monkeypatch.setattr(simhash, "MASKS", 0)
    forests = []
    for found in (pairs, zip(*map(np.ndarray.tolist, simhash.near(fps, distance)))):
        forests.append(simhash.Forest())
        for a, b in found:
            forests[-1].link(a, b)
    assert sorted(forests[0].edges()) == sorted(forests[1].edges())


@pytest.mark.parametrize("distance", [1, 2, 3])
def test_links_like_brute_force(spark, distance):
    r = random.Random(distance)
    fps = {}
    for c in range(12):
        a = r.getrandbits(64)
        for _ in range(25):
            fps.setdefault(a, len(fps) + 1)
            a ^= 1 << r.randrange(64) | 1 << r.randrange(64)
    nodes = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for f, i in fps.items()], "id long, fp long")
    got = {i: i for i in fps.values()} | {r.node: r.component for r in components(simhash.links(nodes, distance)).collect()}
    assert got == brute_components([(i, f) for f, i in fps.items()], distance)


def test_chain_of_components(spark):
    n = 300
    order = random.Random(1).sample(range(1, n + 1), n)
    edges = spark.createDataFrame([*zip(order, order[1:]), (1000, 1001), (1001, 1002), (5, 5)], "u long, v long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {i: 1 for i in range(1, n + 1)} | {i: 1000 for i in (1000, 1001, 1002)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_several_fingerprints(spark):
    r = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    docs = []
    for c in range(12):
        text = [r.choice(words) for _ in range(r.randrange(1, 90))]
        for _ in range(8):
            docs.append((len(docs) * 7 + c % 3, " ".join(text)))
            text[r.randrange(len(text))] = r.choice(words)
    docs += [(5000, ""), (5001, None), (5002, docs[0][1]), (5002, docs[0][1])]
    want = brute_components([(i, brute_wide(t or "", 5, 4)) for i, t in docs], 7, 2)
    got = simhash.near_duplicates(frame(spark, docs), words=5, distance=7, prints=4, n_segments=2).collect()
    assert len(got) == len(docs) and {r.doc_id: r.component_id for r in got} == want
    assert len(set(want.values())) < 92
    assert {r.doc_id: r.fingerprint for r in got} == {i: "".join(f"{x:016x}" for x in brute_wide(t or "", 5, 4)) for i, t in docs}


def check(got, docs):
    fps = [(i, brute_fingerprint(t)) for i, t in docs]
    want = brute_components(fps, 2)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{f:016x}", want[i]) for i, f in fps}
    assert len(got) == len(docs)


def test_nasty(spark):
    near = [(100 + i, f"{LONG[:3000]} tail {i}") for i in range(30)] + [(200 + i, "hot copy of one text") for i in range(50)]
    check(simhash.near_duplicates(frame(spark, [*NASTY, *near])).collect(), [*NASTY, *near])
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_whole_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(simhash.op6(spark, sf).collect(), docs)


def brute_shingles(text, k=5):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute_similar(docs, similarity=0.8):
    """{doc_id: component} by the similarity of all pairs of sets of shingles."""
    sets = [(i, brute_shingles(t)) for i, t in docs]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            both = len(a & b)
            if a == b or both >= similarity * (len(a) + len(b) - both):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i, _ in sets}


def varied(r, changes, n, length=400):
    """(text, text with n changes of single words)"""
    words = [f"w{r.randrange(10**6)}" for _ in range(length)]
    other = list(words)
    for k in range(changes):
        other[k * (length // changes) + 3] = f"x{n}-{k}"
    return " ".join(words), " ".join(other)


def test_recall_and_precision_by_similarity(spark):
    r, docs, bands = random.Random(8), [], {}
    for n in range(400):
        docs += [(2 * n + x, t) for x, t in enumerate(varied(r, [2, 5, 7, 8, 10, 14, 20, 30][n % 8], n))]
        a, b = brute_shingles(docs[-2][1]), brute_shingles(docs[-1][1])
        s = len(a & b) / len(a | b)
        bands.setdefault("under" if s < 0.8 else "0.80" if s < 0.85 else "0.85" if s < 0.9 else "0.90", []).append(2 * n)
    got = {x.doc_id: x.component_id for x in simhash.similar_documents(frame(spark, docs)).collect()}
    found = {band: np.mean([got[i] == got[i + 1] for i in pairs]) for band, pairs in bands.items()}
    assert len(found) == 4 and found.pop("under") == 0 and min(found.values()) >= 0.9, found


def test_similar_groups(spark, monkeypatch):
    """A large group, a passage that unlike documents share, repeated rows, a doc_id on two texts, and texts that are one set."""
    monkeypatch.setattr(simhash, "FEW", 3)
    r = random.Random(3)
    base, passage = [f"w{i}" for i in range(300)], [f"p{i}" for i in range(60)]
    docs = [(i, " ".join([*base[:i], f"new{i}", *base[i + 1 :]])) for i in range(100)]
    docs += [(200 + i, " ".join([*passage, *(f"q{r.randrange(10**6)}" for _ in range(60 if i < 40 else 4))])) for i in range(50)]
    docs += [(500, "one two"), (501, ""), (502, None), (503, "One  TWO"), (0, docs[150 - 3][1]), (7, docs[7][1]), (7, docs[7][1])]
    got = simhash.similar_documents(frame(spark, docs)).collect()
    want = brute_similar([(n, t) for n, (_, t) in enumerate(docs)])
    groups = {}
    for n, (i, _) in enumerate(docs):
        groups.setdefault(want[n], []).append(i)
    assert sorted((x.doc_id, x.component_id) for x in got) == sorted((i, min(g)) for g in groups.values() for i in g)


def test_similar_nasty_and_empty(spark):
    got = simhash.similar_documents(frame(spark, NASTY)).collect()
    assert {x.doc_id: x.component_id for x in got} == brute_similar(NASTY) and len(got) == len(NASTY)
    assert simhash.similar_documents(frame(spark, [])).count() == 0


def test_small_buckets_propose_all_near_pairs(spark):
    """Ids of one half of the fingerprint meet in one bucket; the near pairs among 40 of them may be any places apart."""
    r = random.Random(5)
    high = r.getrandbits(32) << 32
    lows = [r.getrandbits(32) for _ in range(40)]
    fps = [high | x for x in lows] + [(high | x) ^ 1 << 3 ^ 1 << 9 for x in lows[:5]]
    rows = [(i, f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)]
    got = {tuple(x) for x in simhash.proposed(spark.createDataFrame(rows, "id long, fp long, part long"), 2).collect()}
    want = {(i, j) for j in range(len(fps)) for i in range(j) if (fps[i] ^ fps[j]).bit_count() <= 2}
    assert got == want and {(i, 40 + i) for i in range(5)} <= want


def sets_table(spark, sets):
    return spark.createDataFrame([(i, bytearray(np.array(sorted(x), "<u4").tobytes())) for i, x in sets.items()], "id long, hashes binary")


def brute_parts(sets, similarity):
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


def test_large_buckets_of_near_fingerprints_lose_no_pair(spark):
    """130 nodes whose fingerprints are all near; each is like one other, and neither samples nor the bucket's forest say which."""
    r = random.Random(4)
    base, sets, rows = r.getrandbits(63), {}, []
    for n in range(65):
        both = {r.getrandbits(32) for _ in range(300)}
        for i in (n, 65 + n):
            sets[i] = both | {r.getrandbits(32) for _ in range(5)}
            rows.append((i, (base ^ 1 << n % 63), [r.getrandbits(62) for _ in range(simhash.SAMPLES)]))
    nodes = spark.createDataFrame(rows, "id long, fp long, samples array<long>")
    got = {x.node: x.component for x in simhash._verified(nodes, sets_table(spark, sets), 2, 0.8).collect()}
    assert got == {i: i % 65 for i in range(130)} == brute_parts(sets, 0.8)


def test_boilerplate_that_all_share_hides_no_pair(spark):
    r, docs = random.Random(9), []
    passage = [f"p{i}" for i in range(880)]
    for n in range(150):
        own = [f"w{r.randrange(10**7)}" for _ in range(500)]
        other = list(own)
        other[250] = other[20] = f"x{n}"
        docs += [(2 * n, " ".join(passage + own)), (2 * n + 1, " ".join(passage + other))]
    got = {x.doc_id: x.component_id for x in simhash.similar_documents(frame(spark, docs)).collect()}
    assert got == {i: i - i % 2 for i in range(300)}


@pytest.mark.parametrize("common", [0, 20_000])
@pytest.mark.parametrize("similarity", [0.5, 0.8])
def test_join_of_sets_like_brute_force(spark, monkeypatch, common, similarity):
    """Sets of 0 to 40 elements: changed copies of a few, and unlike ones that share most of their elements."""
    monkeypatch.setattr(simhash, "COMMON", common)
    r, sets = random.Random(6), {0: set(), 1: {7}, 2: {7, 8}}
    shared = {r.getrandbits(32) for _ in range(25)}
    for c in range(12):
        first = {r.getrandbits(32) for _ in range(r.randrange(1, 40))}
        for k in range(8):
            sets[len(sets)] = {x for x in first if r.random() > 0.08} | {r.getrandbits(32) for _ in range(r.randrange(3))}
    for k in range(30):
        sets[len(sets)] = {x for x in shared if r.random() > 0.1} | {r.getrandbits(32) for _ in range(r.randrange(12))}
    table = sets_table(spark, sets)
    state = simhash._Links(table.select("id"), table, similarity, simhash.STAYS)
    simhash._join_sets(state, table.select("id"))
    got = {i: i for i in sets} | {x.node: x.component for x in state.found.collect()}
    assert got == brute_parts(sets, similarity) and len(set(got.values())) < len(sets)
    rows = {}
    for x in simhash.prefixes(table, similarity).collect():
        rows.setdefault(x.id, set()).add(x.key)
    similar = [(i, j) for i in sets for j in sets if i < j and sets[i] & sets[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])]
    assert similar and all(rows[i] & rows[j] for i, j in similar)


def test_join_of_a_group_without_a_center(spark, monkeypatch):
    """Copies with two edits each are like those with an edit at the same place only, so no node is like most others; still few are joined pair by pair."""
    r, sets = random.Random(3), {}
    base = [r.getrandbits(32) for _ in range(146)]
    for i in range(400):
        x = list(base)
        for at in (r.randrange(141), r.randrange(141)):
            x[at : at + 5] = [r.getrandbits(32) for _ in range(5)]
        sets[i] = set(x)
    table = sets_table(spark, sets)
    state = simhash._Links(table.select("id"), table, 0.8, simhash.STAYS)
    made, test = [], state.test

    def tested(pairs):
        made.append(pairs.count())
        test(pairs)

    monkeypatch.setattr(state, "test", tested)
    simhash._join_sets(state, table.select("id"))
    got = {i: i for i in sets} | {x.node: x.component for x in state.found.collect()}
    assert got == brute_parts(sets, 0.8)
    assert made[-1] < 10 * len(sets) and sum(made) < 100 * len(sets), made
