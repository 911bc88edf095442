"""Vector code compression: product codes whose codebooks are fitted by Lloyd rounds with heaps of bounds.

A vector's components become integers, and the vector is cut into equal consecutive parts; each part is replaced by the
number of the nearest entry of its position's codebook. The rows are dealt once, by the scan, into blocks of a few hundred
vectors; a block is one row of a table. Besides vectors and codes it holds, for each part position and entry, a heap of the parts that the entry
owns, keyed by slack: the distance to the second nearest entry less the distance to the owner, as of the part's last
scan, plus all drift that the owner's heap had seen by then. After a round, an entry's drift grows by its own move and
the longest move of the position's other entries. Only parts whose key the drift has reached are popped and scanned
again, exactly; all others keep their owner without a look at their vector. A block's heaps travel in its row, so losing an
executor costs its tasks and no state.

Squared distances are integers; keys are rounded down, so that rounding can only cause a needless scan. Ties go to the
lower entry: a part stays unscanned only while its owner is strictly nearest.

Defined results. Left out are rows whose vector is null, empty, or holds a null or non-finite component, and those of
another length than the smallest kept vec_id's. If the length is no multiple of the number of parts, vectors are filled
up with zeros. Integers are held to +-2**27. Fewer rows than entries give as many entries. Repeated vec_ids are rows of
their own; the first codebook takes rows in order of vec_id, then vector; null ids count as the largest. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, prepare, stored

PARTS, ENTRIES, ROUNDS, SCALE, MOST = 16, 64, 2, 256, 1 << 27
#: Bytes of a block's vectors; how many labels may be sent to all executors.
BLOCK_BYTES, FEW_LABELS = 1 << 18, 10_000
STATE = "ids array<bigint>, labels array<{label}>, vectors binary, codes binary, keys binary, rows binary, sizes binary"


def integers(df: DataFrame, id_col: str, vector_col: str, label_col: str | None, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, v) of the kept rows, v as integers."""
    x = F.col(f"`{vector_col}`")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    v = F.transform(x, lambda c: F.floor(F.greatest(F.least(c.cast("double") * scale, F.lit(float(MOST))), F.lit(float(-MOST)))).cast("int"))
    label = F.col(f"`{label_col}`") if label_col else F.lit(None).cast("int")
    return df.where(x.isNotNull() & (F.size(x) > 0) & ~bad).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), label.alias("label"), v.alias("v"))


@dataclass
class Shape:
    """Sizes that all blocks share, and how a part's vectors are measured."""

    dims: int
    parts: int
    entries: int

    @property
    def width(self) -> int:
        return -(-self.dims // self.parts)

    @property
    def block(self) -> int:
        return int(min(4096, max(64, BLOCK_BYTES // (4 * self.dims))))

    def padded(self, v: np.ndarray) -> np.ndarray:
        """Rows of dims components -> (rows, parts, width), zeros at the end."""
        full = np.zeros((len(v), self.parts * self.width), np.int64)
        full[:, : self.dims] = v
        return full.reshape(len(v), self.parts, self.width)


def squares(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """(n, width), (entries, width) -> (n, entries) squared distances."""
    out = np.zeros((len(x), len(book)), np.int64)
    for j in range(x.shape[1]):
        d = x[:, j : j + 1] - book[None, :, j]
        out += d * d
    return out


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, slack) of each row; slack is rounded down. The lowest of several nearest entries owns a row."""
    d = squares(x, book)
    own = d.argmin(1)
    at = np.arange(len(x))
    first = np.sqrt(d[at, own].astype("f8"))
    if len(book) == 1:
        return own, np.full(len(x), np.inf)
    d[at, own] = np.iinfo(np.int64).max
    second = np.sqrt(d.min(1).astype("f8"))
    return own, second * (1 - 1e-12) - first * (1 + 1e-12)


def _down(keys: np.ndarray) -> np.ndarray:
    """As 32-bit floats, none larger than before."""
    out = keys.astype("f4")
    return np.where(out > keys, np.nextafter(out, np.float32(-np.inf)), out)


def reached(key, drift):
    """Whether the drift may have used up the slack; an equal distance counts as reached."""
    return key - drift <= 1e-9 + 1e-12 * drift


@dataclass
class Block:
    """Vectors (n, parts, width), codes (n, parts), and heaps[part][entry]: lists of (key, row), each a heap."""

    vectors: np.ndarray
    codes: np.ndarray
    heaps: list[list[list[tuple[float, int]]]] = field(default_factory=list)

    @classmethod
    def first(cls, vectors: np.ndarray, books: np.ndarray) -> Block:
        """Every part scanned; sorted lists are heaps."""
        made = cls(vectors, np.empty(vectors.shape[:2], np.int64))
        for p, book in enumerate(books):
            own, slack = nearest(vectors[:, p], book)
            keys = _down(slack)
            made.codes[:, p] = own
            order = np.lexsort((keys, own))
            cuts = np.searchsorted(own[order], np.arange(len(book) + 1))
            k, r = keys[order].tolist(), order.tolist()
            made.heaps.append([list(zip(k[a:b], r[a:b])) for a, b in zip(cuts, cuts[1:])])
        return made

    def settle(self, books: np.ndarray, drift: np.ndarray) -> int:
        """Pops the parts that the drift (parts, entries) has reached and scans them again. The number of scanned parts."""
        scanned = 0
        for p, book in enumerate(books):
            popped = []
            for e, heap in enumerate(self.heaps[p]):
                while heap and reached(heap[0][0], drift[p, e]):
                    popped.append(heapq.heappop(heap)[1])
            if not popped:
                continue
            scanned += len(popped)
            own, slack = nearest(self.vectors[popped, p], book)
            self.codes[popped, p] = own
            keys = _down(slack + drift[p, own])
            for key, row, e in zip(keys.tolist(), popped, own.tolist()):
                heapq.heappush(self.heaps[p][e], (key, row))
        return scanned

    def errors(self, books: np.ndarray) -> np.ndarray:
        """Squared distances to the owners, summed over parts."""
        d = self.vectors - books[np.arange(self.codes.shape[1])[None, :], self.codes]
        return (d * d).sum((1, 2))

    def packed(self) -> list[bytes]:
        """vectors, codes, keys, rows, sizes. Narrow numbers where the values allow it."""
        small = self.vectors.size == 0 or np.abs(self.vectors).max() < 1 << 15
        flat = [pair for part in self.heaps for heap in part for pair in heap]
        keys, rows = (np.array([x[i] for x in flat], kind) for i, kind in ((0, "<f4"), (1, "<u2")))
        sizes = np.array([len(heap) for part in self.heaps for heap in part], "<u2")
        return [self.vectors.astype("<i2" if small else "<i4").tobytes(), self.codes.astype("<u2").tobytes(), keys.tobytes(), rows.tobytes(), sizes.tobytes()]

    @classmethod
    def unpacked(cls, n: int, shape: Shape, vectors: bytes, codes: bytes, keys: bytes = b"", rows: bytes = b"", sizes: bytes = b"") -> Block:
        kind = "<i2" if len(vectors) == 2 * n * shape.parts * shape.width else "<i4"
        v = np.frombuffer(vectors, kind).reshape(n, shape.parts, shape.width).astype(np.int64)
        made = cls(v, np.frombuffer(codes, "<u2").reshape(n, shape.parts).astype(np.int64))
        if sizes:
            k, r = np.frombuffer(keys, "<f4").tolist(), np.frombuffer(rows, "<u2").tolist()
            ends = np.cumsum(np.frombuffer(sizes, "<u2").astype(np.int64)).tolist()
            lists = [list(zip(k[a:b], r[a:b])) for a, b in zip([0, *ends], ends)]
            made.heaps = [lists[i : i + shape.entries] for i in range(0, len(lists), shape.entries)]
        return made


def _blocks(rows: DataFrame, shape: Shape, books: np.ndarray, schema: str) -> DataFrame:
    """The kept rows as blocks, every part scanned once."""

    def run(batches):
        import pyarrow as pa

        def made(group):
            ids, labels, v = (pa.concat_arrays([g.column(i) for g in group]) for i in range(3))
            at = pa.array([0, len(ids)], pa.int32())
            whole = Block.first(shape.padded(v.flatten().to_numpy().reshape(len(ids), shape.dims)), books)
            names = ["ids", "labels", "vectors", "codes", "keys", "rows", "sizes"]
            lists = [pa.ListArray.from_arrays(at, x) for x in (ids, labels)]
            return pa.RecordBatch.from_arrays([*lists, *(pa.array([x], pa.binary()) for x in whole.packed())], names=names)

        waiting, n = [], 0
        for b in batches:
            while b.num_rows:
                taken = b.slice(0, shape.block - n)
                b = b.slice(taken.num_rows)
                waiting.append(taken)
                n += taken.num_rows
                if n == shape.block:
                    yield made(waiting)
                    waiting, n = [], 0
        if waiting:
            yield made(waiting)

    return rows.mapInArrow(run, schema)


def _settled(state: DataFrame, shape: Shape, books: np.ndarray, drift: np.ndarray) -> DataFrame:
    """The blocks after a round: parts that the drift has reached are scanned again."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for i in range(b.num_rows):
                one = b.slice(i, 1)
                n = len(one.column(0)[0])
                block = Block.unpacked(n, shape, *(one.column(c)[0].as_py() for c in range(2, 7)))
                block.settle(books, drift)
                yield pa.RecordBatch.from_arrays([one.column(0), one.column(1), *(pa.array([x], pa.binary()) for x in block.packed())], names=one.schema.names)

    return state.mapInArrow(run, state.schema)


def _means(state: DataFrame, shape: Shape, books: np.ndarray) -> np.ndarray:
    """The next codebooks: floors of the means of what each entry owns. Each task adds up its blocks; what reaches the
    driver is one row an entry."""
    parts, entries, width = books.shape

    def run(batches):
        import pyarrow as pa

        sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for b in batches:
            for i in range(b.num_rows):
                block = Block.unpacked(b.column(0)[i].as_py(), shape, b.column(1)[i].as_py(), b.column(2)[i].as_py())
                at = (np.broadcast_to(np.arange(parts), block.codes.shape), block.codes)
                np.add.at(sums, at, block.vectors)
                np.add.at(counts, at, 1)
        p, e = np.nonzero(counts)
        flat = pa.array(sums[p, e].reshape(-1))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * width, pa.int32()), flat)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e]), lists], names=["part", "entry", "n", "sums"])

    found = state.select(F.size("ids").alias("n"), "vectors", "codes").mapInArrow(run, "part int, entry int, n bigint, sums array<bigint>")
    total = [F.sum(F.get("sums", j).cast("decimal(38,0)")).alias(f"s{j}") for j in range(width)]
    new = books.copy()
    for r in found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *total).collect():  # parts x entries rows at most
        new[r.part, r.entry] = [int(r[f"s{j}"]) // int(r.n) for j in range(width)]
    return new


def drifts(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """(parts, entries): an entry's own move and the longest move of the others, rounded up."""
    moves = np.sqrt(((new - old) ** 2).sum(2).astype("f8")) * (1 + 1e-12)
    out = moves.copy()
    for p, m in enumerate(moves):
        if len(m) > 1:
            top = np.argsort(m)[::-1][:2]
            out[p] += np.where(np.arange(len(m)) == top[0], m[top[1]], m[top[0]])
    return out


@dataclass
class Codes:
    """rows (vec_id, label, code, error), the final codebooks (parts, entries, width) and their digest."""

    rows: DataFrame
    books: np.ndarray

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.reshape(-1).tolist())).encode()).hexdigest()


def encode(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = None, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codes:
    """Codebooks fitted in `rounds` rounds over all rows, and every row's code: two hex digits a part (four if there
    are more than 256 entries), with its squared error."""
    spark = df.sparkSession
    prepare(spark)
    rows = integers(df, id_col, vector_col, label_col, scale)
    label = rows.schema["label"].dataType.simpleString()
    order = [F.col("vec_id").asc_nulls_last(), F.col("v")]
    head = rows.orderBy(*order).limit(1).collect()
    if not head:
        return Codes(spark.createDataFrame([], f"vec_id bigint, label {label}, code string, error bigint"), np.zeros((parts, 0, 0), np.int64))
    dims = len(head[0].v)
    rows = rows.where(F.size("v") == dims)
    starts = rows.orderBy(*order).limit(entries).select("v").collect()
    shape = Shape(dims, parts, len(starts))
    books = np.ascontiguousarray(shape.padded(np.array([r.v for r in starts], np.int64)).transpose(1, 0, 2))
    schema = STATE.format(label=label)

    state, path = stored(_blocks(rows, shape, books, schema), "vector-blocks")
    drift = np.zeros(books.shape[:2])
    for _ in range(rounds):
        new = _means(state, shape, books)
        drift += drifts(books, new)
        books = new
        (state, now) = stored(_settled(state, shape, books, drift), "vector-blocks")
        discard(spark, path)
        path = now

    digits = 2 if entries <= 256 else 4

    def last(batches):
        import pyarrow as pa

        for b in batches:
            for i in range(b.num_rows):
                ids, labels = (b.column(c).slice(i, 1).flatten() for c in (0, 1))
                block = Block.unpacked(len(ids), shape, b.column(2)[i].as_py(), b.column(3)[i].as_py())
                codes = block.codes.astype("u1" if digits == 2 else ">u2")
                code = pa.array([c.tobytes().hex() for c in codes], pa.string())
                yield pa.RecordBatch.from_arrays([ids, labels, code, pa.array(block.errors(books))], names=["vec_id", "label", "code", "error"])

    found = state.select("ids", "labels", "vectors", "codes").mapInArrow(last, f"vec_id bigint, label {label}, code string, error bigint")
    return Codes(stored(found, "vector-codes")[0], books)


def label_errors(rows: DataFrame, few: int = FEW_LABELS) -> DataFrame:
    """rows with label_error, the error summed over rows of the same label, nulls together. Tasks add up before the
    exchange. The sums are sent to all executors if they are few; else they are joined, where adaptive execution splits a
    label's rows."""
    sums = rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    sums = F.broadcast(sums) if sums.limit(few + 1).count() <= few else sums
    return rows.join(sums, F.col("label").eqNullSafe(F.col("of"))).drop("of")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), label_col="label")
    return label_errors(found.rows).select("vec_id", "code", "error", "label_error", F.lit(found.sha256).alias("codebooks_sha256"))


def _assigned(n: int, books: str) -> str:
    return f"""
a{n} AS (SELECT vec_id, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
  SELECT x.vec_id, x.p, b.e, sum((x.c - b.c) * (x.c - b.c)) AS d FROM part x JOIN {books} b ON x.p = b.p AND x.i = b.i GROUP BY ALL
) GROUP BY vec_id, p)"""


def _moved(n: int, books: str) -> str:
    return f"""
b{n} AS (SELECT b.p, b.i, b.e, coalesce(((s - (((s % k) + k) % k)) // k)::BIGINT, b.c) AS c FROM {books} b LEFT JOIN (
  SELECT x.p, x.i, a.e, sum(x.c) AS s, count(*) AS k FROM part x JOIN a{n} a ON x.vec_id = a.vec_id AND x.p = a.p GROUP BY ALL
) m ON b.p = m.p AND b.i = m.i AND b.e = m.e)"""


ORACLE = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), flat AS (SELECT vec_id, unnest(v) AS c, generate_subscripts(v, 1) - 1 AS j, len(v) // {PARTS} AS w FROM kept),
part AS (SELECT vec_id, j // w AS p, j % w AS i, c FROM flat),
b0 AS (SELECT x.p, x.i, s.e, x.c FROM part x JOIN (
  SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT {ENTRIES}
) s USING (vec_id)), {_assigned(1, "b0")}, {_moved(1, "b0")}, {_assigned(2, "b1")}, {_moved(2, "b1")}, {_assigned(3, "b2")},
coded AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a3 GROUP BY vec_id)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, e, i)) FROM b2) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)
"""
