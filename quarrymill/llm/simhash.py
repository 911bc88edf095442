"""Near-duplicates by SimHash and deletion-variant signatures.

A fingerprint has a bit set if more than half of the XXH64 hashes of the text's shingles have it. Two fingerprints that
differ in at most `distance` bits, cut into distance // 2 + 1 segments, have a segment that differs in at most one bit.
So each fingerprint is indexed under every segment with every single bit of it left out (one-wildcard variants), equal
variants meet, and the whole fingerprints are compared.

Equal fingerprints are one node from the start, so copies cost nothing. Variants are dealt out by hash and sorted; a
bucket's links are found with whole-array operations. Up to LARGE fingerprints are compared with each other; for more,
each is looked up under all changes of up to `distance` of the free bits, which is linear in the bucket. No bucket is
capped. A task passes on a spanning forest of its links, not the pairs. The components of these forests are then found
by star rounds over tables.

One fingerprint links few documents that are less than almost equal: at a similarity of 0.8 the sets' fingerprints differ
in about ten bits. With several (`prints`), of the set of shingles, documents are linked if any of them is near.

`similar_documents` links by the similarity of the sets of shingles itself. Near fingerprints only propose pairs, and so
do equal fingerprints of samples: the SAMPLE shingles whose hashes are smallest after mixing, in SAMPLES ways. Two sets
of similarity s have the same sample with probability s ** SAMPLE. Each proposed pair is tested on the whole sets; tested
links are contracted before more pairs are proposed, so a large group costs about its size. Nodes that have two samples
in common, or near fingerprints, are all compared, unless their bucket is large: then with centers, or along a spanning
forest, only. Large buckets that have several parts after that are not given up: their nodes are joined among
themselves by an exact join of sets. Two sets of the similarity have an element in common among the first ones of each in any
one order (prefix filter), at places that leave room for the rest of what they must share (position filter). The order
puts frequent elements last, so that passages which many share propose nothing by themselves.

Null and empty texts have the fingerprint zero and are linked like any other. A text with fewer words than a shingle is
one shingle. Rows that repeat a doc_id get a row each. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import STAYS, Scope, documents, materialize, passing, prepare, release, texts
from .components import components

BITS, LARGE, MASKS = 64, 3000, 2000
SMALL = 64  # buckets of up to so many rows propose all their near pairs, larger ones a spanning forest of them first
SAMPLES, SAMPLE, TOGETHER, FEW = 8, 3, 2, 16  # FEW: larger buckets of samples propose centers first
COMMON = 20_000  # so many elements at most are known as frequent; this sets an order, not the result
CENTERS = 16, 64  # of each key in the rounds that contract before sets are joined, and those that a node is held against; this sets the cost, not the result


def shingle_hashes(text: str, words: int) -> np.ndarray:
    import xxhash

    tokens = text.encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not tokens:
        return np.empty(0, "<u8")
    whole = b" ".join(tokens)
    n = len(tokens) - words + 1
    digest = xxhash.xxh64_intdigest
    if n <= 1:
        return np.array([digest(whole, 42)], "<u8")
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
    return np.array([digest(whole[a:b], 42) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)], "<u8")


def majority(h: np.ndarray) -> int:
    """The bits that are set in more than half of the hashes."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 1 << 16):
        counts += np.unpackbits(h[at : at + (1 << 16)].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str, words: int = 3) -> int:
    return majority(shingle_hashes(text, words))


def wide_fingerprint(text: str, words: int, prints: int) -> list[int]:
    """Independent fingerprints of the set of shingles: the first hashes its shingles as they are, the others mix them."""
    h = np.unique(shingle_hashes(text, words))
    numbers = np.array([r * 0x9E3779B97F4A7C15 & (1 << 64) - 1 for r in range(prints)], "<u8")[:, None]
    ones = np.uint64(0x0101010101010101)
    counts = np.zeros((prints, 8, 8), np.int64)  # by byte of the hash and bit of the byte
    for at in range(0, len(h), 255):  # sums of a byte's bits fit into it
        x = h[None, at : at + 255] + numbers
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
        x ^= x >> np.uint64(31)
        x[0] = h[at : at + 255]
        for bit in range(8):
            counts[:, :, bit] += (x >> np.uint64(bit) & ones).sum(1, dtype="<u8").view("u1").reshape(prints, 8)
    return np.packbits(counts.reshape(prints, BITS) * 2 > len(h), axis=1, bitorder="little").view("<u8")[:, 0].tolist()


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sets of shingle hashes, both without repeats; that of two empty sets is 1."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def fingerprints(docs: DataFrame, words: int = 3, prints: int = 1) -> DataFrame:
    """(doc_id, fp0, ...) of (doc_id, text)."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts_of = b.column(1).to_pylist()
            found = np.array([[fingerprint(t, words)] if prints == 1 else wide_fingerprint(t, words, prints) for t in texts_of], "u8").reshape(len(texts_of), prints)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.ascontiguousarray(found[:, r]).view("i8")) for r in range(prints))], names=["doc_id", *(f"fp{r}" for r in range(prints))])

    return docs.mapInArrow(run, "doc_id long, " + ", ".join(f"fp{r} long" for r in range(prints)))


def segments(n: int) -> list[tuple[int, int]]:
    """(first bit, width) of n segments."""
    cuts = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def variants(fps: np.ndarray, n: int) -> np.ndarray:
    """A column for each segment and bit of it: the segment without that bit, and which ones they are."""
    out = []
    for number, (first, width) in enumerate(segments(n)):
        part = fps >> np.uint64(first) & np.uint64((1 << width) - 1)
        for bit in range(width):
            low = part & np.uint64((1 << bit) - 1)
            high = part >> np.uint64(bit + 1) << np.uint64(bit)
            kept = high | low
            out.append(kept ^ np.uint64((number * 64 + bit + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) if width > 48 else kept | np.uint64((number << 6 | bit) << 48))
    return np.stack(out, 1)


def near(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of pairs of distinct values that differ in at most `distance` bits: all such pairs, or, where their changes are
    too many to look up, enough of them to have the same components."""
    n = len(fps)
    if n <= LARGE:
        left, right = [], []
        for a in range(0, n, 256):
            close = np.bitwise_count(fps[a : a + 256, None] ^ fps[None, :]) <= distance
            i, j = np.nonzero(close)
            keep = i + a < j
            left.append(i[keep] + a)
            right.append(j[keep])
        return np.concatenate(left), np.concatenate(right)
    free = [b for b in range(BITS) if np.bitwise_or.reduce(fps ^ fps[0]) >> np.uint64(b) & np.uint64(1)]
    if sum(comb(len(free), k) for k in range(1, distance + 1)) > MASKS:
        return _tree(fps, distance)
    order = np.argsort(fps)
    ordered = fps[order]
    left, right = [], []
    for k in range(1, distance + 1):
        for bits in combinations(free, k):
            other = ordered ^ np.uint64(sum(1 << b for b in bits))
            at = np.minimum(np.searchsorted(ordered, other), n - 1)
            hit = np.flatnonzero((ordered[at] == other) & (ordered < other))
            left.append(order[hit])
            right.append(order[at[hit]])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.array([], int), np.array([], int))


def _tree(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs with the same components: each value that is reached is compared with those not yet reached, so a dense group
    costs about its size."""
    left, right = [np.array([], int)], [np.array([], int)]
    rest = np.arange(len(fps))
    while len(rest):
        reached, rest = [rest[0]], rest[1:]
        while reached and len(rest):
            x = reached.pop()
            close = np.bitwise_count(fps[rest] ^ fps[x]) <= distance
            hit = rest[close]
            rest = rest[~close]
            left.append(np.full(len(hit), x))
            right.append(hit)
            reached.extend(hit.tolist())
    return np.concatenate(left), np.concatenate(right)


class Forest:
    """Union-find over the nodes that have links; the smallest node is the root."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        top = x
        while (p := parent.setdefault(top, top)) != top:
            top = p
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    def link(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def edges(self) -> list[tuple[int, int]]:
        return [(x, r) for x in list(self.parent) if (r := self.root(x)) != x]


def links(nodes: DataFrame, distance: int, n_segments: int | None = None) -> DataFrame:
    """(u, v): edges between the ids of nodes (id, fp) with the same components as all links. n_segments: a link must also
    differ in at most one bit of one of so many segments; by default so many that every link does."""
    n_segments = n_segments or distance // 2 + 1

    def index(batches):
        import pyarrow as pa

        for b in batches:
            ids, fps = b.column(0).to_numpy(), b.column(1).to_numpy().view("u8")
            for at in range(0, len(ids), 2000):
                keys = variants(fps[at : at + 2000], n_segments)
                n, k = keys.shape
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view("i8")), pa.array(np.repeat(fps[at : at + n], k).view("i8")), pa.array(np.repeat(ids[at : at + n], k))], names=["key", "fp", "id"])

    def meet(batches):
        import pyarrow as pa

        forest, rest = Forest(), [np.empty(0, "i8")] * 3

        def settle(keys, fps, ids):
            bounds = np.flatnonzero(np.diff(keys)) + 1
            starts, stops = np.concatenate([[0], bounds]), np.concatenate([bounds, [len(keys)]])
            small = stops - starts == 2  # nearly all buckets with company
            a = starts[small]
            a = a[np.bitwise_count(fps[a] ^ fps[a + 1]) <= distance]
            for x, y in zip(ids[a].tolist(), ids[a + 1].tolist(), strict=True):
                forest.link(x, y)
            for s, e in zip(starts[stops - starts > 2].tolist(), stops[stops - starts > 2].tolist(), strict=True):
                own = ids[s:e]
                i, j = near(fps[s:e], distance)
                for x, y in zip(own[i].tolist(), own[j].tolist(), strict=True):
                    forest.link(x, y)

        for b in batches:
            if b.num_rows == 0:
                continue
            now = [np.concatenate([r, b.column(i).to_numpy()]) for i, r in enumerate(rest)]
            last = np.searchsorted(now[0], now[0][-1])  # sorted: the last bucket may go on
            if last:
                settle(now[0][:last], now[1][:last].view("u8"), now[2][:last])
            rest = [x[last:] for x in now]
        if len(rest[0]):
            settle(rest[0], rest[1].view("u8"), rest[2])
        found = forest.edges()
        for at in range(0, len(found), 100_000):
            u, v = zip(*found[at : at + 100_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    indexed = nodes.select("id", "fp").mapInArrow(index, "key long, fp long, id long")
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return indexed.repartition(n, "key").sortWithinPartitions("key").mapInArrow(meet, "u long, v long")


def sampled_fingerprints(h: np.ndarray, samples: int, size: int = SAMPLE) -> list[int]:
    """A fingerprint of each of several samples of a set of hashes: the `size` that are smallest after mixing them in another
    way. The majority of three numbers is a matter of bit operations; of one or two, what is there counts."""
    if len(h) == 0:
        return [0] * samples
    least = np.empty((samples, 0), "<u8")
    numbers = np.array([(r + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1 for r in range(samples)], "<u8")[:, None]
    for at in range(0, len(h), 1 << 14):
        x = h[None, at : at + (1 << 14)] + numbers
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
        x = np.concatenate([least, x ^ x >> np.uint64(31)], axis=1)
        least = np.partition(x, size - 1, axis=1)[:, :size] if x.shape[1] > size else x
    if least.shape[1] == 3:
        a, b, c = least.T
        return ((a & b) | (a & c) | (b & c)).tolist()
    return [majority(np.ascontiguousarray(row)) for row in least]


def shingle_sets(docs: DataFrame, words: int, samples: int) -> DataFrame:
    """(doc_id, text_sha256, digest, fp, samples, hashes) of (doc_id, text, text_sha256): a digest of the set of shingles, its fingerprint, those of its
    samples, and the upper halves of the hashes themselves in order."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        for b in batches:
            out = []
            for text in b.column(1).to_pylist():
                h = np.unique(shingle_hashes(text, words))
                out.append((xxhash.xxh3_128_digest(h.tobytes()), majority(h), sampled_fingerprints(h, samples), np.unique((h >> np.uint64(32)).astype("<u4")).tobytes()))
            digests, fps, sampled, hashes = zip(*out, strict=True) if out else ((), (), (), ())
            signed = np.array(sampled, "u8").reshape(len(out), samples).view("i8").tolist()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(digests, pa.binary()), pa.array(np.array(fps, "u8").view("i8")), pa.array(signed, pa.list_(pa.int64())), pa.array(hashes, pa.binary())],
                names=["doc_id", "text_sha256", "digest", "fp", "samples", "hashes"],
            )

    return docs.mapInArrow(run, "doc_id long, text_sha256 string, digest binary, fp long, samples array<long>, hashes binary")


def _shared(a: str, b: str):
    """How many samples two rows have in common."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) of ids whose sets of shingle hashes (id, hashes) have at least this Jaccard similarity."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            a, c = (b.column(i).to_pylist() for i in (2, 3))
            keep = [jaccard(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")) >= similarity for x, y in zip(a, c, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    some = pairs.select(F.col("u").alias("id")).union(pairs.select("v")).distinct()
    needed = materialize(sets.join(some, "id", "left_semi"), "simhash-needed")
    left, right = needed.select(F.col("id").alias("u"), F.col("hashes").alias("a")), needed.select(F.col("id").alias("v"), F.col("hashes").alias("b"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


class _Links:
    """The links found so far, and the part (connected component) that each node has by them. Tables of links live as
    long as `scope`, what is needed to find them no longer than the search."""

    def __init__(self, nodes: DataFrame, sets: DataFrame, similarity: float, scope: Scope):
        self.nodes, self.sets, self.similarity, self.scope = nodes, sets, similarity, scope
        self.edges: DataFrame | None = None
        self.found: DataFrame | None = None

    def parted(self, rows: DataFrame) -> DataFrame:
        """rows (id, ...) with `part`."""
        if self.found is None:
            return rows.withColumn("part", F.col("id"))
        return rows.join(self.found.withColumnRenamed("node", "id"), "id", "left").withColumn("part", F.coalesce("component", "id")).drop("component")

    def test(self, pairs: DataFrame) -> None:
        """Keeps the proposed pairs (u, v) that are similar enough."""
        spark, conf = pairs.sparkSession, pairs.sparkSession.conf
        size = conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
        with passing(spark):
            pairs = materialize(pairs.distinct(), "simhash-pairs")
            release(spark)  # the exchange of the buckets
            conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "200")  # two sets a row
            try:
                new = materialize(similar(pairs, self.sets, self.similarity), "simhash-links", self.scope)
            finally:
                conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        release(spark)  # the exchange of the sets
        self.edges = new if self.edges is None else self.edges.unionByName(new)
        self.found = components(self.edges, scope=self.scope)
        release(spark)


def _buckets(state: _Links, rows: DataFrame, nodes: DataFrame, scope: Scope) -> tuple[DataFrame, DataFrame]:
    """(rows (id, key, ...) of buckets with several rows, with their number n, samples and part, and their center's id,
    samples (others) and part; the centers). The center of a bucket is its smallest id."""
    # Tables of their own on both sides of a join, so that a hot key's partition can be split.
    with passing(rows.sparkSession):
        rows = materialize(rows, "simhash-buckets")
        centers = materialize(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("center")).where("n > 1"), "simhash-centers")
        company = state.parted(rows.join(centers, "key")).join(nodes.select("id", "samples"), "id")
        heads = centers.select(F.col("center").alias("id")).distinct().join(nodes.select("id", F.col("samples").alias("others")), "id")
        heads = materialize(heads.withColumnRenamed("id", "center"), "simhash-heads", scope)
        company = materialize(company.join(_of_center(state, heads), "center"), "simhash-company", scope)
    release(rows.sparkSession)
    return company, heads.select("center")


def _star_pairs(company: DataFrame) -> DataFrame:
    """(u, v): for each node the center of one of its buckets, the one that it shares most samples with."""
    shared = _shared("samples", "others")
    rows = company.where((F.col("part") != F.col("center_part")) & (shared >= TOGETHER))
    return rows.groupBy("id").agg(F.max_by("center", F.struct(shared.alias("s"), -F.col("center"))).alias("u")).select("u", F.col("id").alias("v"))


def _apart(state: _Links, company: DataFrame, heads: DataFrame) -> DataFrame:
    """The rows of buckets whose node isn't linked to the center by now."""
    rows = state.parted(company.drop("part", "center_part", "others")).join(_of_center(state, heads), "center")
    return rows.where(F.col("part") != F.col("center_part"))


def _undecided(state: _Links, rows: DataFrame) -> DataFrame:
    """The rows (id, key, ...) of buckets that have several parts by now, with these."""
    rows = state.parted(rows.drop("part"))
    several = rows.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high")
    return rows.join(several.select("key"), "key", "left_semi")


def _propose_by_samples(state: _Links, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with a sample in common form a bucket. Each node proposes itself to the center that it shares most samples with;
    the tested links leave few buckets with several parts. Their rows meet again by pairs of samples: small buckets propose
    all pairs of different parts, large ones their centers, twice. The second time's pairs are returned untested, with the rows
    (id, key) of the large buckets."""
    spark = nodes.sparkSession
    with passing(spark) as here:
        rows = nodes.select("id", F.posexplode("samples").alias("at", "sample")).select("id", "at", F.xxhash64("at", "sample").alias("key"))
        company, heads = _buckets(state, rows, nodes, here)
        state.test(_star_pairs(company))
        left = _undecided(state, company.select("id", "at", "key"))
        own = left.groupBy("id").agg(F.sort_array(F.collect_set(F.struct("at", "key"))).alias("own"))  # as many as samples at most
        two = own.select("id", F.explode(F.flatten(F.transform("own", lambda x: F.transform(F.filter("own", lambda y: y["at"] > x["at"]), lambda y: F.xxhash64(x["key"], y["key"]))))).alias("key"))
        two = materialize(two, "simhash-twos", state.scope)
    company, heads = _buckets(state, two, nodes, state.scope)
    few = company.where(F.col("n") <= FEW)
    one, other = (few.select(F.col("key").alias("key" + x), F.col("id").alias("id" + x), F.col("part").alias("part" + x)) for x in "12")
    close = one.join(other, F.col("key1") == F.col("key2")).where("id1 < id2 and part1 != part2")
    state.test(_star_pairs(company.where(F.col("n") > FEW)).unionByName(close.select(F.col("id1").alias("u"), F.col("id2").alias("v"))))
    large = company.where(F.col("n") > FEW)
    again, _ = _buckets(state, _apart(state, large, heads).select("id", "key"), nodes, state.scope)
    return _star_pairs(again), large.select("id", "key")


def _of_center(state: _Links, heads: DataFrame) -> DataFrame:
    """heads (center, ...) with `center_part`."""
    return state.parted(heads.withColumnRenamed("center", "id")).withColumnsRenamed({"id": "center", "part": "center_part"})


def proposed(nodes: DataFrame, distance: int) -> DataFrame:
    """(u, v): pairs of nodes (id, fp, part) of different parts whose fingerprints differ in at most `distance` bits. All such
    pairs of small buckets; of a large bucket, enough to connect what its near pairs connect."""
    return _meetings(nodes, distance).where("not member").select("u", "v")


def _meetings(nodes: DataFrame, distance: int) -> DataFrame:
    """(u, v, member): the proposed pairs and, as members, the nodes v of each group u that near pairs of large buckets connect,
    if it has several parts. Each near pair of different parts is a proposed one, or both are in a group."""
    n_segments = distance // 2 + 1

    def index(batches):
        import pyarrow as pa

        for b in batches:
            ids, fps, parts = b.column(0).to_numpy(), b.column(1).to_numpy().view("u8"), b.column(2).to_numpy()
            for at in range(0, len(ids), 2000):
                keys = variants(fps[at : at + 2000], n_segments)
                n, k = keys.shape
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.reshape(-1).view("i8")), *(pa.array(np.repeat(x[at : at + n], k)) for x in (fps.view("i8"), ids, parts))], names=["key", "fp", "id", "part"]
                )

    def meet(batches):
        import pyarrow as pa

        forest, rest, found, part_of = Forest(), [np.empty(0, "i8")] * 4, [np.empty((0, 2), "i8")], {}

        def settle(keys, fps, ids, parts):
            bounds = np.flatnonzero(np.diff(keys)) + 1
            starts, stops = np.concatenate([[0], bounds]), np.concatenate([bounds, [len(keys)]])
            small = np.repeat(stops - starts <= SMALL, stops - starts)
            for k in range(1, SMALL):  # rows k places apart
                i = np.flatnonzero((keys[:-k] == keys[k:]) & small[k:])
                if len(i) == 0:
                    break
                i = i[(np.bitwise_count(fps[i] ^ fps[i + k]) <= distance) & (parts[i] != parts[i + k])]
                found.append(np.stack([ids[i], ids[i + k]], 1))
            for s, e in zip(starts[stops - starts > SMALL].tolist(), stops[stops - starts > SMALL].tolist(), strict=True):
                own, part = ids[s:e], parts[s:e]
                if (part == part[0]).all():
                    continue
                values, first, value = np.unique(fps[s:e], return_index=True, return_inverse=True)
                i, j = near(values, distance) if len(values) > LARGE else _tree(values, distance)
                a, b = np.concatenate([first[i], first[value]]), np.concatenate([first[j], np.arange(e - s)])  # near values, and rows of one value
                part_of.update(zip(own.tolist(), part.tolist(), strict=True))
                for x, y, differ in zip(own[a].tolist(), own[b].tolist(), (part[a] != part[b]).tolist(), strict=True):
                    if forest.root(x) != forest.root(y):
                        forest.link(x, y)
                        if differ:
                            found.append(np.array([[x, y]]))

        for b in batches:
            if b.num_rows == 0:
                continue
            now = [np.concatenate([r, b.column(i).to_numpy()]) for i, r in enumerate(rest)]
            last = np.searchsorted(now[0], now[0][-1])  # sorted: the last bucket may go on
            if last:
                settle(now[0][:last], now[1][:last].view("u8"), now[2][:last], now[3][:last])
            rest = [x[last:] for x in now]
        if len(rest[0]):
            settle(rest[0], rest[1].view("u8"), rest[2], rest[3])
        pairs = np.unique(np.sort(np.concatenate(found), axis=1), axis=0)
        for at in range(0, len(pairs), 100_000):
            some = np.ascontiguousarray(pairs[at : at + 100_000].T)
            yield pa.RecordBatch.from_arrays([pa.array(some[0]), pa.array(some[1]), pa.array(np.zeros(some.shape[1], bool))], names=["u", "v", "member"])
        several = {r for x in forest.parent if part_of[x] != part_of[r := forest.root(x)]}
        members = [(r, x) for x in list(forest.parent) if (r := forest.root(x)) in several]
        for at in range(0, len(members), 100_000):
            u, v = zip(*members[at : at + 100_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array([True] * len(u))], names=["u", "v", "member"])

    indexed = nodes.select("id", "fp", "part").mapInArrow(index, "key long, fp long, id long, part long")
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return indexed.repartition(n, "key").sortWithinPartitions("key").mapInArrow(meet, "u long, v long, member boolean")


def _frequent(own: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(elements in order, rank by frequency) of the up to COMMON elements that most of the sets (id, hashes) have."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for x in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, "<u4").astype("i8"))], names=["key"])

    counts = own.select("hashes").mapInArrow(run, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    found = np.array([r.key for r in counts.where(F.col("n") > FEW).orderBy(F.desc("n"), "key").limit(COMMON).collect()], "<u4")
    order = np.argsort(found)
    return found[order], len(found) - order  # the most frequent one has the highest rank


def prefixes(own: DataFrame, similarity: float) -> DataFrame:
    """(id, key, size, at) of the sets (id, hashes): the first elements, the rare ones before the frequent ones, and their places. Two sets
    of the similarity have one of these in common."""
    elements, ranks = _frequent(own)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                h = np.frombuffer(x, "<u4")
                if len(h) == 0:
                    continue
                rank = np.zeros(len(h), "i8")
                if len(elements):
                    at = np.minimum(np.searchsorted(elements, h), len(elements) - 1)
                    rank = np.where(elements[at] == h, ranks[at], 0)
                n = len(h) - int(np.ceil(similarity * len(h) - 1e-9)) + 1
                first = h[np.lexsort((h, rank))[:n]].astype("i8")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(first), i, "i8")), pa.array(first), pa.array(np.full(len(first), len(h), "i8")), pa.array(np.arange(len(first)))], names=["id", "key", "size", "at"]
                )

    return own.select("id", "hashes").mapInArrow(run, "id long, key long, size long, at long")


def _room(similarity: float):
    """Whether two sets may have the similarity, if an element at `at` and `at2` is the first that they have in common."""
    return F.least(F.col("size") - F.col("at"), F.col("size2") - F.col("at2")) >= (F.col("size") + F.col("size2")) * (similarity / (1 + similarity)) - 1e-9


def _several_centers(rows: DataFrame, most: int, number: int, similarity: float) -> DataFrame:
    """(u, v): for each node of rows (id, key, size, at, part) up to `most` centers of other parts, those that it meets under most keys. A key
    has up to `most` centers, other ones under each key and in each round `number`: no single node stands for all of a group whose
    members are like some of the others only."""
    slot = F.pmod(F.xxhash64("id", F.lit(number)), F.lit(most)).alias("slot")
    first = F.min(F.struct(F.xxhash64("id", "key", F.lit(number)).alias("h"), "id", "size", "at", "part")).alias("c")
    heads = rows.groupBy("key", slot).agg(first).select("key", *(F.col(f"c.{a}").alias(b) for a, b in (("id", "u"), ("size", "size2"), ("at", "at2"), ("part", "part2"))))
    met = rows.join(materialize(heads, "simhash-firsts"), "key").where(F.col("part") != F.col("part2")).where(_room(similarity))
    best = met.groupBy("id", "u").agg(F.count(F.lit(1)).alias("n")).groupBy("id").agg(F.slice(F.sort_array(F.collect_list(F.struct("n", "u")), asc=False), 1, most).alias("best"))
    return best.select(F.explode("best.u").alias("a"), F.col("id").alias("b")).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))


def _join_sets(state: _Links, ids: DataFrame) -> None:
    """Links every pair of the nodes ids (id) that has the similarity. Rows of a key propose some centers first; the tested links are
    contracted, so that a large group isn't expanded, and what is still in different parts is joined."""
    spark = ids.sparkSession
    with passing(spark):
        ids = materialize(ids.distinct(), "simhash-undecided")
        if ids.isEmpty():
            return
        own = materialize(state.sets.join(ids, "id", "left_semi"), "simhash-own")
        rows = materialize(_undecided(state, materialize(prefixes(own, state.similarity), "simhash-prefixes")), "simhash-places")
        for number, most in enumerate(CENTERS):
            if rows.isEmpty():
                return
            state.test(_several_centers(rows, most, number, state.similarity))
            rows = materialize(_undecided(state, rows), "simhash-places")
        other = rows.select("key", F.col("id").alias("v"), F.col("size").alias("size2"), F.col("at").alias("at2"), F.col("part").alias("part2"))
        state.test(rows.join(other, "key").where("id < v and part != part2").where(_room(state.similarity)).select(F.col("id").alias("u"), "v"))


def _verified(nodes: DataFrame, sets: DataFrame, distance: int, similarity: float, scope: Scope = STAYS) -> DataFrame:
    """(node, component) by the pairs of nodes that samples or near fingerprints propose and the sets confirm. scope: how
    long the tables stay that the result reads."""
    state = _Links(nodes, sets, similarity, scope)
    again, large = _propose_by_samples(state, nodes)
    nodes.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50000")  # four numbers a row
    rest = materialize(state.parted(nodes.select("id", "fp")), "simhash-parts", scope)
    each = materialize(rest.groupBy("fp", "part").agg(F.min("id").alias("id")), "simhash-prints", scope)
    met = materialize(_meetings(each, distance), "simhash-near", scope)
    pairs = met.where("not member").select("u", "v")
    state.test(pairs.unionByName(again))
    nodes.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "200")  # a set a row
    ends = state.parted(pairs.select(F.col("u").alias("id"), "v")).select(F.col("id").alias("u"), F.col("part").alias("part_u"), F.col("v").alias("id"))
    failed = state.parted(ends).where("part != part_u")
    groups = _undecided(state, met.where("member").select(F.col("v").alias("id"), F.col("u").alias("key")))
    prints = failed.select("id").union(failed.select("u")).union(groups.select("id")).distinct()
    prints = each.join(prints, "id", "left_semi").select("fp", "part")
    _join_sets(state, rest.join(prints, ["fp", "part"], "left_semi").select("id").union(_undecided(state, large).select("id")))
    return state.found


def similar_documents(docs: DataFrame, words: int = 5, similarity: float = 0.8, distance: int = 2, samples: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_sha256, component_id) of each row of docs. Linked are documents whose sets of shingles have at least this Jaccard
    similarity, if the fingerprints of their sets differ in at most `distance` bits or two of the fingerprints of `samples`
    samples of these sets are equal; no such pair is lost, however many share them. Texts with the same set are one node."""
    prepare(docs.sparkSession)
    conf = docs.sparkSession.conf
    batch = conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    every = shingle_sets(texts(docs, id_col, text_col).withColumn("text_sha256", F.sha2(F.col("text").cast("binary"), 256)), words, samples)
    with passing(docs.sparkSession) as scope:
        every = materialize(every.withColumn("row", F.monotonically_increasing_id()), "simhash-sets")
        least = materialize(every.groupBy("digest").agg(F.min("row").alias("id")), "simhash-least")
        rows = materialize(every.select("row", "doc_id", "text_sha256", "digest", "fp", "samples").join(least, "digest").drop("digest"), "simhash-rows")
        release(docs.sparkSession)
        nodes = rows.where("row = id").select("id", "fp", "samples")
        try:
            found = _verified(nodes, every.select(F.col("row").alias("id"), "hashes"), distance, similarity, scope)
        finally:
            conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        labelled = rows.select("doc_id", "text_sha256", "id").join(found.withColumnRenamed("node", "id"), "id", "left").select("doc_id", "text_sha256", F.coalesce("component", "id").alias("component"))
        named = materialize(labelled.groupBy("component").agg(F.min("doc_id").alias("component_id")), "simhash-named")
        return materialize(labelled.join(named, "component").select("doc_id", "text_sha256", "component_id"), "simhash-groups", STAYS)


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 2, prints: int = 1, n_segments: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row of docs. prints: with several independent fingerprints, documents
    are linked if any of them differs in at most `distance` bits; each is indexed in a pass of its own. n_segments: ask
    further that one of so many segments differs in at most one bit, which keeps the index small for large distances."""
    prepare(docs.sparkSession)
    spark, conf = docs.sparkSession, docs.sparkSession.conf
    names = [f"fp{r}" for r in range(prints)]
    rows = materialize(fingerprints(texts(docs, id_col, text_col), words, prints), "simhash")
    nodes = materialize(rows.groupBy(*names).agg(F.min("doc_id").alias("id")), "simhash-nodes")
    batch = conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50000")  # three numbers a row
    try:
        edges = None
        for name in names:
            each = nodes if prints == 1 else nodes.groupBy(name).agg(F.min("id").alias("id"))
            found = links(each.select("id", F.col(name).alias("fp")), distance, n_segments)
            if prints > 1:  # nodes with this fingerprint in common
                least = each.select(F.col(name).alias("same"), F.col("id").alias("u"))
                found = found.unionByName(nodes.join(least, F.col(name) == F.col("same")).where("id != u").select("u", F.col("id").alias("v")))
                found = materialize(found, "simhash-links")
                release(spark)
            edges = found if edges is None else edges.unionByName(found)
        found = components(edges)
    finally:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    labels = nodes.join(found, nodes.id == found.node, "left").select(*names, F.coalesce("component", "id").alias("component_id"))
    return rows.join(labels, names).select("doc_id", F.lower(F.concat(*(F.lpad(F.hex(n), 16, "0") for n in names))).alias("fingerprint"), "component_id")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
