"""Order-preserving packing of documents into fixed-length sequences.

The tokens of the documents of one partition, in scan order, form one stream. Window cuts may lie at the end of a
document (free), at the end of a sentence (`sentence_cut`) or, every `grid` tokens inside a longer sentence, anywhere
(`token_cut`); the penalties are counted in tokens. With P(i) the stream position of boundary i,

    best(j) = penalty(j) + min over i with P(j) - P(i) <= window of best(i) + window - (P(j) - P(i))

so that the inner minimum is over best(i) + P(i), a sliding-window minimum: a monotone queue gives every transition in constant time. The
sum of padding and truncation penalties is the least that any choice of cuts at these boundaries can reach.

A partition's stream ends with one shorter window. Only (doc_id, text) is read, nothing is shuffled, memory is one
block of `block_tokens` tokens: blocks are packed one after the other, and the last, unfinished window of a block is
carried into the next one. Rows: null and empty texts hold the end token only; repeated rows are packed as often as
they occur; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe
from .common import documents, prepare, texts, tokenizer_file

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
SENTENCE = re.compile(r"(?<=[.!?\n]) (?=[^\s<])")  # "<" may begin a special token, which changes the pieces before it
END_ID = 1
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def choose_cuts(positions: list[int], penalties: list[float], window: int) -> list[int]:
    """Indexes of the boundaries to cut at, the last one included. positions[0] is the start of the stream; no two
    neighbours are further apart than the window."""
    n = len(positions)
    back = [0] * n
    key = [0.0] * n  # best(i) + P(i): what boundary i costs as the start of a window
    queue: deque[int] = deque([0])
    for j in range(1, n):
        at = positions[j]
        while at - positions[queue[0]] > window:
            queue.popleft()
        i = queue[0]
        back[j] = i
        key[j] = k = key[i] + window + penalties[j]
        while queue and key[queue[-1]] >= k:
            queue.pop()
        queue.append(j)
    cuts, j = [], n - 1
    while j:
        cuts.append(j)
        j = back[j]
    return cuts[::-1]


class Packer:
    """Packs a stream of documents; gives a row for each piece."""

    def __init__(self, window: int, sentence_cut: float, token_cut: float, grid: int, block_tokens: int, first_sequence: int):
        self.window, self.sentence_cut, self.token_cut = window, sentence_cut, token_cut
        self.grid, self.block_tokens, self.sequence = min(grid, window), block_tokens, first_sequence
        self.docs: list[tuple[int, bytes, int]] = []  # doc_id, ids, how many of them are packed
        self.positions, self.penalties = [0], [0.0]

    def add(self, doc_id: int, ids: bytes, sentences: list[int]) -> Iterator[tuple]:
        """sentences: the number of tokens in each, in order."""
        self.docs.append((doc_id, ids, 0))
        at = self.positions[-1]
        for k in sentences:
            while k > self.grid:
                at += self.grid
                k -= self.grid
                self.positions.append(at)
                self.penalties.append(self.token_cut)
            at += k
            self.positions.append(at)
            self.penalties.append(self.sentence_cut)
        self.penalties[-1] = 0.0
        if at >= self.block_tokens:
            yield from self.flush(last=False)

    def flush(self, last: bool) -> Iterator[tuple]:
        cuts = [self.positions[i] for i in choose_cuts(self.positions, self.penalties, self.window)]
        if not last:
            cuts.pop()  # the unfinished window goes on with the next block
        at = begin = k = 0
        rest = []
        for doc_id, ids, done in self.docs:
            total = len(ids) // 4
            while done < total and k < len(cuts):
                length = min(total - done, cuts[k] - at)
                yield doc_id, done, length, zlib.crc32(ids[4 * done : 4 * (done + length)]), total, self.sequence, at - begin
                done += length
                at += length
                if at == cuts[k]:
                    begin = at
                    k += 1
                    self.sequence += 1
            if done < total:
                rest.append((doc_id, ids, done))
        open_from = bisect_right(self.positions, at)
        self.docs = rest
        self.positions = [0, *(p - at for p in self.positions[open_from:])]
        self.penalties = [0.0, *self.penalties[open_from:]]


def pack(
    docs: DataFrame,
    json_path: str,
    ranks_path: str,
    window: int = 2048,
    sentence_cut: float = 8.0,
    token_cut: float = 48.0,
    grid: int = 32,
    block_tokens: int = 1 << 19,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """A row for each piece of a document in a sequence, see the module's description."""
    prepare(docs.sparkSession)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encode = byte_bpe.encoder(json_path, ranks_path)
        packer = Packer(window, sentence_cut, token_cut, grid, block_tokens, TaskContext.get().partitionId() << 32)

        def table(rows):
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=NAMES)

        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, sentences = bytearray(), []
                parts = SENTENCE.split(text)
                for n, part in enumerate(parts):
                    new = encode(f" {part}" if n else part)
                    ids += byte_bpe.little_endian(new)
                    sentences.append(len(new))
                ids += byte_bpe.little_endian([END_ID])
                sentences[-1] += 1
                rows.extend(packer.add(doc_id, bytes(ids), sentences))
            if rows:
                yield table(rows)
        rows = list(packer.flush(last=True))
        if rows:
            yield table(rows)

    return texts(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("byte_bpe_50k.tiktoken"))
