"""Target-distribution importance resampling: documents are drawn by how much likelier the target's n-grams make them.

Features are runs of one to three words, hashed into buckets by CRC-32. Two scans of the corpus: the first counts buckets
(each task adds up an array, so that what is exchanged is one row a bucket and task), the second looks the buckets' gains
up in an array and adds them up per document. A draw without replacement of the k best rows by weight plus Gumbel noise is a
draw in proportion to the exponentials of the weights.

The k-th best key is found without a sort: a histogram of 12 bits of the composite key (score, then doc_id) at a time,
over the rows that share the bits found so far, until a digit's rows are wanted whole or the key's bits end. Only rows
up to that key are range-sorted, and a row's rank is its place in its range plus the sizes of the ranges before.

Features of a sequence of words come from word CRCs by the linearity of CRC: crc(a + b) is crc(a), moved on by b's length,
xor crc(b), for whole arrays at once. Texts are read in runs of about `CHUNK` words, so that memory doesn't grow with a text.

Defined results. A null text has no words: weight 0, no draw. A null doc_id hashes as an empty id and is the last of equal scores.
Rows with the same score and doc_id get ranks in order of the number of features; rows equal in that, too, are interchangeable.
Repeated rows are rows of their own. An empty corpus gives an empty result; an empty target has T = 0 and t = 0.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, prepare, stored

BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 3, 20, 5, 42
CHUNK, PIECE, DIGIT, NEAR = 200_000, 1 << 20, 12, 64
#: A-Z in lower case; what is neither a digit, a letter nor beyond ASCII is a blank.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _crc_table() -> np.ndarray:
    """The table of the CRC-32 polynomial (fixed value 0xEDB88320, reflected)."""
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, (x >> 1) ^ np.uint32(0xEDB88320), x >> 1)
    return x


def _tables(n: int) -> list[np.ndarray]:
    """For lengths 0 to n - 1: (4, 256) values of each byte of a CRC after so many zero bytes."""
    one = _crc_table()
    now = np.arange(256, dtype=np.uint32)[None, :] << np.array([[0], [8], [16], [24]], np.uint32)
    out = []
    for _ in range(n):
        out.append(now)
        now = (now >> 8) ^ one[now & 255]
    return out


_MOVES = np.stack(_tables(NEAR)).reshape(-1)
_DOUBLED = [_MOVES.reshape(NEAR, 4, 256)[NEAR // 2]]


def _through(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    return table[0][x & 255] ^ table[1][(x >> 8) & 255] ^ table[2][(x >> 16) & 255] ^ table[3][x >> 24]


def moved(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRCs x, each moved on by n bytes."""
    near = np.minimum(n, NEAR - 1).astype(np.intp) * 1024
    out = _MOVES[near + (x & 255)]
    for k in (1, 2, 3):
        out ^= _MOVES[near + (256 * k) + ((x >> np.uint32(8 * k)) & 255)]
    far = np.flatnonzero(n >= NEAR)
    if len(far):
        y, rest = x[far], n[far]
        low = rest % (NEAR // 2)
        y = moved(y, low)
        rest, power = rest // (NEAR // 2), 0
        while rest.any():
            if power == len(_DOUBLED):
                _DOUBLED.append(np.stack([_through(_DOUBLED[-1], t) for t in _DOUBLED[-1]]))
            y = np.where(rest & 1, _through(_DOUBLED[power], y), y)
            rest, power = rest >> 1, power + 1
        out[far] = y
    return out


def _pieces(text: bytes):
    """The words of text, some `PIECE` bytes at a time; words aren't cut."""
    text = text.translate(_LETTERS)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def _chunks(texts: list[bytes | None], longest: int):
    """(words, owner of each, how many of the first words only give context) of runs of words over all texts."""
    words: list[bytes] = []
    owners: list[int] = []
    sizes: list[int] = []
    context = 0
    for i, text in enumerate(texts):
        for part in _pieces(text or b""):
            words += part
            owners.append(i)
            sizes.append(len(part))
            if len(words) >= CHUNK:
                yield words, np.repeat(owners, sizes), context
                kept = min(longest - 1, sum(n for o, n in zip(owners, sizes) if o == i))
                words, owners, sizes, context = words[len(words) - kept :], [i], [kept], kept
    if len(words) > context:
        yield words, np.repeat(owners, sizes), context


def features(texts: list[bytes | None], buckets: int = BUCKETS, longest: int = LONGEST):
    """(n, owner, bucket) arrays of the features of n words, text by text; owner: the text's place in the list."""
    for words, owner, context in _chunks(texts, longest):
        crc = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
        step = np.fromiter(map(len, words), np.int64, len(words)) + 1
        joined = moved(np.full(len(words), zlib.crc32(b" "), np.uint32), step - 1) ^ crc
        run = crc
        for n in range(1, longest + 1):
            if n > 1:
                run = moved(run[:-1], step[n - 1 :]) ^ joined[n - 1 :]
            same = owner[n - 1 :] == owner[: len(owner) - n + 1]
            same[: max(0, context - n + 1)] = False  # counted with the run before
            yield n, owner[n - 1 :][same], run[same] % np.uint32(buckets)
            if len(run) < 2:
                break


def _bytes(df: DataFrame, text_col: str) -> Column:
    return F.col(f"`{text_col}`").cast("string").cast("binary")


def bucket_counts(df: DataFrame, text_col: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """How often each bucket's features occur in all texts."""

    def run(batches):
        import pyarrow as pa

        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, _, found in features(b.column(0).to_pylist(), buckets, longest):
                total += np.bincount(found, minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in df.select(_bytes(df, text_col).alias("t")).mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's gain: a thousand times the log of the smoothed ratio of its shares, rounded down."""
    many, wanted = float(int(corpus.sum()) + len(corpus)), float(int(target.sum()) + len(target))
    ratio = [float(t + 1) * many / (float(s + 1) * wanted) for s, t in zip(corpus.tolist(), target.tolist())]
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(df: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            counts, weight = np.zeros((longest, b.num_rows), np.int64), np.zeros(b.num_rows, np.int64)
            for n, owner, found in features(b.column(1).to_pylist(), len(gain), longest):
                counts[n - 1] += np.bincount(owner, minlength=b.num_rows)
                np.add.at(weight, owner, gain[found])
            score = weight + np.array([noise(i, seed) for i in b.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, (counts[0], counts.sum(0), weight, score))], names=["doc_id", "n_words", "n_features", "weight", "score"])

    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), _bytes(df, text_col).alias("t"))
    return rows.mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint")


def _key() -> list[Column]:
    """The composite key's two halves as unsigned numbers that ascend from the best row: score downwards, doc_id upwards."""
    least = F.lit(-(1 << 63))
    return [F.bitwise_not(F.col("score").bitwiseXOR(least)), F.coalesce("doc_id", F.lit((1 << 63) - 1)).bitwiseXOR(least)]


def up_to_kth(rows: DataFrame, k: int, digit: int = DIGIT) -> Column:
    """A condition that holds for the k best rows, and for rows whose (score, doc_id) equal the k-th's. Radix selection: one
    count a digit over the rows that share the digits before; 2 ** digit counts reach the driver at most. Bits that
    no two rows differ in are passed over. rows: at least k > 0."""
    keys = _key()
    mask = (1 << 64) - 1
    ends = rows.agg(*(f(x.bitwiseXOR(F.lit(-(1 << 63)))) for x in keys for f in (F.min, F.max))).first()
    spans = [(low & mask, high & mask) for low, high in ((ends[0], ends[1]), (ends[2], ends[3]))]
    same, done = F.lit(True), F.lit(False)
    need = k
    for key, (low, high) in zip(keys, spans):
        low, high = low ^ (1 << 63), high ^ (1 << 63)
        bits = (low ^ high).bit_length()
        prefix = low >> bits  # in unsigned terms
        while bits:
            step = min(digit, bits)
            bits -= step
            at = F.shiftrightunsigned(key, bits).bitwiseAND(F.lit((1 << step) - 1))
            counts = rows.where(same).groupBy(at.alias("d")).count().collect()
            for d, n in sorted(map(tuple, counts)):
                if n >= need:
                    break
                need -= n
            upper = F.shiftrightunsigned(key, bits)
            prefix = (prefix << step) | d
            # Signed literals stand for unsigned ones; digits compare as small numbers, prefixes only for equality.
            literal = F.lit(prefix - (1 << 64) if prefix >> 63 else prefix)
            done, same = done | (same & (at < d)), same & (upper == literal)
            if n == need:
                return done | same
    return done | same


def ranked(rows: DataFrame, k: int) -> DataFrame:
    """rows with rank: 1 to k for the k best by score, then smaller doc_id; null for all others."""
    columns = rows.columns
    if k <= 0:
        return rows.withColumn("rank", F.lit(None).cast("bigint"))
    chosen = F.col("n_words") >= LEAST_WORDS
    chosen = chosen & up_to_kth(rows.where(chosen), k)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features")]
    best = rows.where(chosen).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    best, _ = stored(best, "resampled")
    part = F.shiftright("place", 33)
    sizes = sorted(map(tuple, best.groupBy(part.alias("part")).count().collect()))  # one row a partition
    before, starts = 0, []
    for p, n in sizes:
        starts.append((p, before))
        before += n
    offsets = F.broadcast(rows.sparkSession.createDataFrame(starts, "part bigint, before bigint"))
    rank = F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    best = best.join(offsets, part == F.col("part")).select(*columns, F.when(rank <= k, rank).alias("rank"))
    return best.unionByName(rows.where(~chosen).withColumn("rank", F.lit(None).cast("bigint")))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of docs; floor(percent * N / 100) rows are drawn of
    the N that have LEAST_WORDS words."""
    prepare(docs.sparkSession)
    gain = gains(bucket_counts(docs, text_col, buckets, longest), bucket_counts(target, target_col, buckets, longest))
    rows, _ = stored(scored(docs, gain, id_col, text_col, longest, seed), "weighted")
    return ranked(rows, percent * rows.where(F.col("n_words") >= LEAST_WORDS).count() // 100)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 in SQL by linearity: each byte adds (xor) a number that depends on it and on how many bytes follow.
ORACLE = r"""
WITH RECURSIVE start AS (
  SELECT b, b AS x, 0 AS s FROM (SELECT unnest(range(256)) AS b)
  UNION ALL SELECT b, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, s + 1 FROM start WHERE s < 8
), one AS (SELECT b, x FROM start WHERE s = 8),
source AS (
  SELECT 0 AS k, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark
), split AS (
  SELECT k, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM source
), word AS (SELECT k, id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM split),
gram AS (
  SELECT k, id, w AS f FROM word
  UNION ALL SELECT * FROM (SELECT k, id, w || ' ' || lead(w) OVER (PARTITION BY k, id ORDER BY i) AS f FROM word) WHERE f IS NOT NULL
  UNION ALL SELECT * FROM (SELECT k, id, w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o AS f FROM word WINDOW o AS (PARTITION BY k, id ORDER BY i)) WHERE f IS NOT NULL
), counted AS MATERIALIZED (SELECT k, id, f, count(*) AS n FROM gram GROUP BY ALL),
distinct_f AS MATERIALIZED (SELECT f, hex(encode(f)) AS h, octet_length(encode(f)) AS size FROM (SELECT DISTINCT f FROM counted)),
adds AS (
  SELECT b, x, 0 AS after FROM one
  UNION ALL SELECT a.b, xor(a.x >> 8, o.x), after + 1 FROM adds a JOIN one o ON o.b = a.x & 255 WHERE after < (SELECT max(size) FROM distinct_f)
), zeros AS (
  SELECT 0 AS size, 4294967295 AS x
  UNION ALL SELECT z.size + 1, xor(z.x >> 8, o.x) FROM zeros z JOIN one o ON o.b = z.x & 255 WHERE z.size < (SELECT max(size) FROM distinct_f)
), byte AS (SELECT f, size, i, substr(h, 2 * i - 1, 2) AS hx FROM (SELECT f, h, size, unnest(range(1, size + 1)) AS i FROM distinct_f)),
named AS (SELECT printf('%02X', b) AS hx, after, x FROM adds),
hashed AS MATERIALIZED (
  SELECT f, xor(xor(q.x, z.x), 4294967295) % 10000 AS bucket FROM (
    SELECT y.f, y.size, bit_xor(a.x) AS x FROM byte y JOIN named a ON a.hx = y.hx AND a.after = y.size - y.i GROUP BY ALL
  ) q JOIN zeros z USING (size)
), sums AS (SELECT bucket, sum(n) FILTER (k = 0) AS s, sum(n) FILTER (k = 1) AS t FROM counted JOIN hashed USING (f) GROUP BY bucket),
whole AS (SELECT coalesce(sum(n) FILTER (k = 0), 0) AS s, coalesce(sum(n) FILTER (k = 1), 0) AS t FROM counted),
gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(u.t, 0) + 1)::DOUBLE * (w.s + 10000)::DOUBLE / ((coalesce(u.s, 0) + 1)::DOUBLE * (w.t + 10000)::DOUBLE)))::BIGINT AS g
  FROM sums u, whole w
), weighed AS (
  SELECT d.doc_id, coalesce(sum(n), 0)::BIGINT AS n_features, coalesce(sum(n * g), 0)::BIGINT AS weight
  FROM documents d LEFT JOIN (SELECT id, n, g FROM counted JOIN hashed USING (f) JOIN gain USING (bucket) WHERE k = 0) c ON c.id = d.doc_id GROUP BY ALL
), scores AS (
  SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score, len(w) >= 20 AS may
  FROM weighed JOIN (SELECT id AS doc_id, w FROM split WHERE k = 0) USING (doc_id)
), placed AS (SELECT *, row_number() OVER (PARTITION BY may ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY may) AS many FROM scores)
SELECT doc_id, n_features, weight, score, CASE WHEN may AND place <= 5 * many // 100 THEN place END AS rank FROM placed
"""
