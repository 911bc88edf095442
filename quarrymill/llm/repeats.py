"""Removal of repeated passages: each byte that a string of `length` bytes covers which also starts in a document with a
smaller doc_id is removed. Matches are judged on the input and never cross documents.

A suffix array of the corpus, restricted to what can repeat and cut off where it no longer matters:

1. Blocks. Documents are gathered into blocks of some MB (one packed row each), written once to the shared folder.
2. Anchors. A string's anchor is the least hash of its GRAM-byte substrings. Strings that follow each other in a text mostly
   have the same anchor, so a text falls into short stretches (of STRETCH strings at most): the suffix at a stretch's start, as far as its last string.
   Equal strings have equal anchors. Each block sends the 32 bits below the bucket of its distinct anchors, and learns
   which of them occur in two documents. Nothing else can hold a repeat.
3. Runs. Each block sorts its distinct suffixes with shared anchors, after their anchors, and sends each bucket a
   front-coded run: for each suffix the length of the prefix it shares with the one before, and the rest.
4. Merge. A bucket merges its runs with a loser tree that keeps, beside each loser, the prefix it shares with the last
   winner: players with different shared prefixes are decided without looking at the bytes, and equal ones are compared
   behind the prefix only. Equal suffixes leave next to each other; for the strings of all suffixes of an anchor the
   smallest doc_id is found by comparing bytes. A block sends each suffix once, with its smallest doc_id, so a passage
   that a third of all documents hold costs a bucket one entry a block.
5. Removal. Each block marks the strings whose smallest doc_id is smaller than the document's, and the bytes they cover.

Null texts count as empty: nothing is removed. Rows that repeat a doc_id don't remove each other. An empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize, prepare, texts

GRAM, LENGTH = 24, 50
BLOCK_BYTES, BUCKET_BYTES = 4 << 20, 4 << 20
STRETCH, MOST_PARTS = 64, 1 << 16
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """(block, ids, sizes, data): the documents of a block one after the other, packed."""

    def run(batches):
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        packer, first = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId() << 32
        ids, parts, size, made = [], [], 0, 0

        def row():
            columns = ([first + made], [np.array(ids, "<i8").tobytes()], [np.array([len(p) for p in parts], "<i8").tobytes()], [packer.compress(b"".join(parts))])
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["block", "ids", "sizes", "data"])

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = text.encode()
                if parts and size + len(raw) > block_bytes:
                    yield row()
                    ids, parts, size, made = [], [], 0, made + 1
                ids.append(doc_id)
                parts.append(raw)
                size += len(raw)
        if parts:
            yield row()

    return docs.mapInArrow(run, "block long, ids binary, sizes binary, data binary")


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if width > done else x


class Block:
    """A block's stretches: for each the first and last string start, the document's place, and the anchor."""

    def __init__(self, ids: bytes, sizes: bytes, data: bytes, length: int):
        import zstandard

        self.ids, self.sizes, self.length = np.frombuffer(ids, "<i8"), np.frombuffer(sizes, "<i8"), length
        self.data = zstandard.ZstdDecompressor().decompress(data)
        self.ends = np.cumsum(self.sizes)
        n = len(self.data)
        if n < length:
            self.first = self.last = self.doc = np.empty(0, np.int64)
            self.anchor = np.empty(0, "u8")
            return
        w = np.ndarray((n - 7,), "<u8", self.data, strides=(1,))
        h = w[: n - GRAM + 1] * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h += w[8 : n - GRAM + 9]
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        h += w[16:]
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        least = _least(h, length - GRAM + 1)
        # Strings within one document: those that start early enough before its end.
        valid = np.ones(len(least), bool)
        for end, size in zip(self.ends.tolist(), self.sizes.tolist(), strict=True):
            valid[max(end - size, end - length + 1) : end] = False
        new = np.empty(len(least), bool)
        new[0] = True
        np.not_equal(least[1:], least[:-1], out=new[1:])
        new[1:] |= ~valid[:-1]
        new &= valid
        first, last = np.flatnonzero(new), np.flatnonzero(valid & np.concatenate([new[1:] | ~valid[1:], [True]]))
        # Long stretches (a word again and again) are cut: their pieces are mostly the same few.
        pieces = (last - first) // STRETCH + 1
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        self.first = np.repeat(first, pieces) + STRETCH * nth
        self.last = np.minimum(np.repeat(last, pieces), self.first + STRETCH - 1)
        # The least of many hashes is mostly small: mixed again, one to one, so that buckets by its high bits are even.
        self.anchor = least[self.first] * np.uint64(0xD6E8FEB86659FD93)
        self.anchor ^= self.anchor >> np.uint64(32)
        self.anchor *= np.uint64(0xD6E8FEB86659FD93)
        self.doc = np.searchsorted(self.ends, self.first, side="right")

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """(distinct anchors in order, whether two documents of the block hold one)."""
        found, at = np.unique(self.anchor, return_inverse=True)
        low, high = np.full(len(found), 1 << 60), np.full(len(found), -1)
        np.minimum.at(low, at, self.doc)
        np.maximum.at(high, at, self.doc)
        return found, low != high

    def suffixes(self, shared: np.ndarray) -> tuple[np.ndarray, list[bytes], dict[bytes, int]]:
        """(stretches with shared anchors, each one's key: anchor and suffix, each key's smallest doc_id).
        shared: the shared anchors, in order."""
        if not len(shared) or not len(self.anchor):
            return np.empty(0, np.int64), [], {}
        at = np.minimum(np.searchsorted(shared, self.anchor), len(shared) - 1)
        chosen = np.flatnonzero(shared[at] == self.anchor)
        raw, length = self.data, self.length
        heads = self.anchor[chosen].astype(">u8").tobytes()
        keys, smallest = [], {}
        for n, (a, b, d) in enumerate(zip(self.first[chosen].tolist(), self.last[chosen].tolist(), self.ids[self.doc[chosen]].tolist(), strict=True)):
            key = heads[8 * n : 8 * n + 8] + raw[a : b + length]
            keys.append(key)
            if smallest.setdefault(key, d) > d:
                smallest[key] = d
        return chosen, keys, smallest


def shared_length(a: bytes, b: bytes, known: int = 0) -> int:
    """Bytes that a and b have in common at their start, of which `known` are known."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    low, step = known, 16
    while a[low : low + step] == b[low : low + step]:
        low += step
    for i in range(low, n):
        if a[i] != b[i]:
            return i
    return n


def front_code(keys: list[bytes]) -> tuple[bytes, bytes, bytes]:
    """(shared prefix lengths, lengths of the rests, rests) of sorted keys."""
    prefixes, rests, before = [], [], b""
    for k in keys:
        n = shared_length(before, k)
        prefixes.append(n)
        rests.append(k[n:])
        before = k
    return np.array(prefixes, "<u4").tobytes(), np.array([len(r) for r in rests], "<u4").tobytes(), b"".join(rests)


def front_decode(prefixes: bytes, lengths: bytes, rests: bytes):
    """(key, shared prefix length) of each key."""
    before, at = b"", 0
    for p, n in zip(np.frombuffer(prefixes, "<u4").tolist(), np.frombuffer(lengths, "<u4").tolist(), strict=True):
        before = before[:p] + rests[at : at + n]
        at += n
        yield before, p


def merge(runs: list):
    """(key, prefix shared with the key before, run) of all keys of sorted runs, in order. runs: iterators of (key, prefix
    shared with the run's key before)."""
    k = max(1, len(runs))
    size = 1 << (k - 1).bit_length()
    heads: list[bytes | None] = [None] * size
    steps = [iter(r).__next__ for r in runs]

    def pull(run: int) -> int:
        try:
            heads[run], p = steps[run]()
            return p
        except StopIteration:
            heads[run] = None
            return -1  # shares less than any key: loses every match

    losers, prefix = [0] * size, [-1] * size
    winners, shares = [0] * (2 * size), [-1] * (2 * size)
    for r in range(size):
        winners[size + r] = r
        if r < len(runs):
            pull(r)
            shares[size + r] = 0 if heads[r] is not None else -1
    for node in range(size - 1, 0, -1):
        (a, pa), (b, pb) = ((winners[c], shares[c]) for c in (2 * node, 2 * node + 1))
        if pa == pb and pa >= 0:
            n = shared_length(heads[a], heads[b])
            if heads[b] < heads[a]:
                a, b = b, a
            losers[node], prefix[node] = b, n
            winners[node], shares[node] = a, 0
        else:
            if pb > pa:
                (a, pa), (b, pb) = (b, pb), (a, pa)
            losers[node], prefix[node] = b, pb
            winners[node], shares[node] = a, pa
    top, own = winners[1], shares[1]
    while heads[top] is not None:
        yield heads[top], own, top
        p = pull(top)
        node = (size + top) >> 1
        while node:
            q = prefix[node]
            if p < q:
                top, losers[node] = losers[node], top
                p, prefix[node] = q, p
            elif p == q and p >= 0:
                other = losers[node]
                x, y = heads[top], heads[other]
                n = shared_length(x, y, p)
                prefix[node] = n
                if n < len(y) and (n == len(x) or x[n] < y[n]) or n == len(x) == len(y):
                    pass
                else:
                    top, losers[node] = other, top
            node >>= 1
        own = p


def smallest_ids(group: list[tuple[bytes, int]], length: int) -> list[list[tuple[int, int]]]:
    """For each suffix (bytes, smallest doc_id) of one anchor: the smallest doc_id of each of its strings among all of
    them, as (number of strings, doc_id) pieces."""
    if len(group) == 1:
        return [[(len(group[0][0]) - length + 1, group[0][1])]]
    least: dict[bytes, int] = {}
    for text, d in group:
        for j in range(len(text) - length + 1):
            s = text[j : j + length]
            if least.setdefault(s, d) > d:
                least[s] = d
    out = []
    for text, _ in group:
        pieces: list[tuple[int, int]] = []
        for j in range(len(text) - length + 1):
            d = least[text[j : j + length]]
            if pieces and pieces[-1][1] == d:
                pieces[-1] = pieces[-1][0] + 1, d
            else:
                pieces.append((1, d))
        out.append(pieces)
    return out


def _arrow(columns: dict):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n == "block" else pa.int32() if n == "bucket" else pa.binary()) for n, c in columns.items()], names=list(columns))


def remove_repeats(docs: DataFrame, length: int = LENGTH, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with keep_text the kept bytes) of each row of docs."""
    if length < GRAM + 8:
        raise ValueError(f"length must be {GRAM + 8} at least")
    prepare(docs.sparkSession)
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    table = materialize(blocks(texts(docs, id_col, text_col), block_bytes), "repeat-blocks")
    total = table.agg(F.sum(F.length("data"))).first()[0] or 0
    bits = max(1, min(31, (3 * total // bucket_bytes).bit_length()))
    shift, n_parts = np.uint64(64 - bits), min(1 << bits, MOST_PARTS)  # a partition has its buckets one after the other
    low_bits = np.uint64(32 - bits)

    def rows_of(batches, n):
        for b in batches:
            yield from zip(*(b.column(i).to_pylist() for i in range(n)), strict=True)

    def grouped(batches, n):
        """The rows of each bucket of a partition that is sorted by bucket, which comes first in the rows."""
        return (list(rows) for _, rows in groupby(rows_of(batches, n), key=lambda r: r[0]))

    def bounds(anchors):
        """{bucket: (first, end)} of its anchors among the ordered ones."""
        found, starts = np.unique(anchors >> shift, return_index=True)
        return dict(zip(found.tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(anchors)]), strict=True))

    def send_anchors(batches):
        for block, ids, sizes, data in rows_of(batches, 4):
            found, multi = Block(ids, sizes, data, length).anchors()
            at = bounds(found)
            short = (found >> low_bits).astype("u4")
            out = [(i, short[a:b].tobytes(), np.packbits(multi[a:b]).tobytes()) for i, (a, b) in at.items()]
            if out:
                bucket, anchors, several = zip(*out, strict=True)
                yield _arrow({"bucket": bucket, "block": [block] * len(out), "anchors": anchors, "several": several})

    def find_shared(batches):
        for rows in grouped(batches, 4):
            yield from flags_of(rows)

    def flags_of(rows):
        short = [np.frombuffer(r[2], "u4") for r in rows]
        multi = [np.unpackbits(np.frombuffer(r[3], "u1"), count=len(s)).astype(bool) for r, s in zip(rows, short, strict=True)]
        # A block's anchors differ, but two may have the same 32 bits: then both count as shared.
        found, counts = np.unique(np.concatenate(short), return_counts=True)
        shared = counts > 1
        shared[np.searchsorted(found, np.concatenate([s[m] for s, m in zip(short, multi, strict=True)]))] = True
        for (bucket, block, _, _), s in zip(rows, short, strict=True):
            yield _arrow({"bucket": [bucket], "block": [block], "flags": [np.packbits(shared[np.searchsorted(found, s)]).tobytes()]})

    def shared_of(block: Block, flags) -> np.ndarray:
        found, _ = block.anchors()
        at, keep = bounds(found), np.zeros(len(found), bool)
        for f in flags or ():
            a, b = at[f["bucket"]]
            keep[a:b] = np.unpackbits(np.frombuffer(f["flags"], "u1"), count=b - a)
        return found[keep]

    def cut(keys: list[bytes]) -> dict[int, tuple[int, int]]:
        return bounds(np.array([int.from_bytes(k[:8], "big") for k in keys], "u8"))

    def send_runs(batches):
        import zstandard

        packer = zstandard.ZstdCompressor(level=1)
        for block, ids, sizes, data, flags in rows_of(batches, 5):
            b = Block(ids, sizes, data, length)
            _, _, smallest = b.suffixes(shared_of(b, flags))
            ordered = sorted(smallest)
            at = cut(ordered)
            for i, (x, y) in at.items():
                prefixes, lengths, rests = front_code(ordered[x:y])
                yield _arrow({
                    "bucket": [i], "block": [block], "prefixes": [packer.compress(prefixes)], "lengths": [packer.compress(lengths)], "rests": [packer.compress(rests)],
                    "docs": [packer.compress(np.array([smallest[k] for k in ordered[x:y]], "<i8").tobytes())],
                })

    def merge_runs(batches):
        for rows in grouped(batches, 6):
            yield from answers_of_bucket(rows)

    def answers_of_bucket(rows):
        import zstandard

        unpack, pack = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=1).compress
        rows = [(bucket, block, *map(unpack, rest)) for bucket, block, *rest in rows]
        ids = [np.frombuffer(r[5], "<i8").tolist() for r in rows]
        answers: list[list] = [[] for _ in rows]
        group: list[list] = []  # of one anchor: suffix, smallest doc_id, runs that hold it

        def settle():
            for (_, _, holders), pieces in zip(group, smallest_ids([(t, d) for t, d, _ in group], length), strict=True):
                for r in holders:
                    answers[r].append(pieces)

        before, taken = b"", [0] * len(rows)
        for key, prefix, run in merge([front_decode(*r[2:5]) for r in rows]):
            d = ids[run][taken[run]]
            taken[run] += 1
            if group and prefix == len(key) == len(before):
                group[-1][1] = min(group[-1][1], d)
                group[-1][2].append(run)
            else:
                if group and prefix < 8:
                    settle()
                    group = []
                group.append([key[8:], d, [run]])
            before = key
        settle()
        for r, (bucket, block, *_) in enumerate(rows):
            flat = [p for pieces in answers[r] for p in pieces]
            answers_of = [np.array([len(p) for p in answers[r]], "<u4"), np.array([n for n, _ in flat], "<u4"), np.array([d for _, d in flat], "<i8")]
            yield _arrow({"bucket": [bucket], "block": [block], "answer": [pack(b"".join(x.tobytes() for x in (np.array([len(answers_of[0]), len(flat)], "<u8"), *answers_of)))]})

    def remove(batches):
        import pyarrow as pa
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for _, ids, sizes, data, flags, answered in rows_of(batches, 6):
            b = Block(ids, sizes, data, length)
            chosen, keys, smallest = b.suffixes(shared_of(b, flags))
            ordered = sorted(smallest)
            at, pieces = cut(ordered), {}
            for a in answered or ():
                raw = unpack(a["answer"])
                n, m = np.frombuffer(raw, "<u8", 2).tolist()
                per, lengths = np.frombuffer(raw, "<u4", n, 16).tolist(), np.frombuffer(raw, "<u4", m, 16 + 4 * n).tolist()
                docs_of, p = np.frombuffer(raw, "<i8", m, 16 + 4 * n + 4 * m).tolist(), 0
                first, _ = at[a["bucket"]]
                for i, k in enumerate(per):
                    pieces[ordered[first + i]] = (docs_of[p], None) if k == 1 else (min(docs_of[p : p + k]), [(lengths[q], docs_of[q]) for q in range(p, p + k)])
                    p += k
            gone = np.zeros(len(b.data), bool)
            for key, x, y, d in zip(keys, b.first[chosen].tolist(), b.last[chosen].tolist(), b.ids[b.doc[chosen]].tolist(), strict=True):
                least, parts = pieces[key]
                if least < d:
                    if parts is None:
                        gone[x : y + length] = True
                    else:
                        for n, other in parts:
                            if other < d:
                                gone[x : x + n - 1 + length] = True
                            x += n
            raw, out, start = np.frombuffer(b.data, "u1"), [], 0
            for d, end in zip(b.ids.tolist(), b.ends.tolist(), strict=True):
                own = gone[start:end]
                n = int(own.sum())
                kept = b.data[start:end] if n == 0 else raw[start:end][~own].tobytes()
                spans = int(own[:1].sum() + (own[1:] & ~own[:-1]).sum()) if n else 0
                out.append((d, end - start, n, spans, hashlib.sha256(kept).hexdigest(), kept))
                start = end
            columns = list(zip(*out, strict=True))[: 5 + keep_text]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 4 + [pa.string(), pa.binary()])], names=[c.split()[0] for c in schema.split(", ")])

    schema = SCHEMA + ", kept binary" * keep_text
    anchors = table.select("block", "ids", "sizes", "data").mapInArrow(send_anchors, "bucket int, block long, anchors binary, several binary")
    flags = anchors.repartitionById(n_parts, F.col("bucket") % n_parts).sortWithinPartitions("bucket").mapInArrow(find_shared, "bucket int, block long, flags binary")
    flags = materialize(flags.groupBy("block").agg(F.collect_list(F.struct("bucket", "flags")).alias("flags")), "repeat-flags")
    joined = table.join(flags, "block", "left").select("block", "ids", "sizes", "data", "flags")
    runs = joined.mapInArrow(send_runs, "bucket int, block long, prefixes binary, lengths binary, rests binary, docs binary")
    answers = runs.repartitionById(n_parts, F.col("bucket") % n_parts).sortWithinPartitions("bucket").mapInArrow(merge_runs, "bucket int, block long, answer binary")
    answers = materialize(answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "answer")).alias("answered")), "repeat-answers")
    return joined.join(answers, "block", "left").select("block", "ids", "sizes", "data", "flags", "answered").mapInArrow(remove, schema)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))
