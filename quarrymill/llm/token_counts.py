"""Edit-aware token counts.

A document is a segment tree: its leaves are runs of pre-tokens, its inner nodes hold the number of code points and
tokens below them. Leaves begin at a blank before something that is neither white space nor "<": the tokenizer's
pattern always splits there, whatever stands before it, so tokens of different leaves don't affect each other. An edit
is found by descending the sums, only the leaves that it touches are encoded again (with the leaf before them if the new
text doesn't begin at such a blank), and the sums above them are set anew.

Edits are (start, stop, replacement) in code points of the text as the edits before them left it, cut to its bounds;
null values count as 0, the end, and the empty string. Null texts count as empty. Repeated rows are counted each.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe
from .common import documents, prepare, tokenizer_file

SAFE = re.compile(r" (?=[^\s<])")
LEAF_PIECES, LEAF_MOST = 64, 4096
EDITS = "array<struct<start:bigint,stop:bigint,replacement:string>>"
SCHEMA = "doc_id long, n_chars long, n_tokens long, edited_chars long, edited_tokens long, encoded_chars long"


def leaves_of(text: str) -> list[str]:
    pieces = SAFE.split(text)
    return [(" " if i else "") + " ".join(pieces[i : i + LEAF_PIECES]) for i in range(0, len(pieces), LEAF_PIECES)]


class TokenTree:
    def __init__(self, text: str, count: Callable[[str], int]):
        self.count, self.encoded_chars = count, 0
        leaves = leaves_of(text)
        self._build(leaves, [count(t) for t in leaves])

    def _build(self, leaves: list[str], tokens: Sequence[int]) -> None:
        self.size = 1 << max(0, len(leaves) - 1).bit_length()
        self.leaves = leaves + [""] * (self.size - len(leaves))
        pad = [0] * (self.size - len(leaves))
        self.chars = [0] * self.size + [*map(len, leaves), *pad]
        self.tokens = [0] * self.size + [*tokens, *pad]
        for i in range(self.size - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def __len__(self) -> int:
        return self.chars[1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(self.leaves)

    def _find(self, at: int) -> tuple[int, int]:
        """(leaf, offset in it) of the code point at; the end of the text is the end of its last leaf with text."""
        if at >= self.chars[1]:
            leaf = self._before(self.size)
            return max(leaf, 0), len(self.leaves[max(leaf, 0)])
        i = 1
        while i < self.size:
            i *= 2
            if at >= self.chars[i]:
                at -= self.chars[i]
                i += 1
        return i - self.size, at

    def _before(self, leaf: int) -> int:
        """The last leaf with text before a leaf, or -1."""
        i = leaf + self.size
        while i > 1:
            if i & 1 and self.chars[i - 1]:
                i -= 1
                while i < self.size:
                    i = 2 * i + 1 if self.chars[2 * i + 1] else 2 * i
                return i - self.size
            i >>= 1
        return -1 if leaf < self.size or not self.chars[1] else self._last()

    def _last(self) -> int:
        i = 1
        while i < self.size:
            i = 2 * i + 1 if self.chars[2 * i + 1] else 2 * i
        return i - self.size

    def edit(self, start: int, stop: int, replacement: str) -> None:
        start = min(max(start, 0), len(self))
        stop = min(max(stop, start), len(self))
        first, begin = self._find(start)
        last, end = self._find(stop)
        new = self.leaves[first][:begin] + replacement + self.leaves[last][end:]
        while (before := self._before(first)) >= 0 and not SAFE.match(new):
            first, new = before, self.leaves[before] + new
        self.encoded_chars += len(new)
        if len(new) > LEAF_MOST and len(parts := leaves_of(new)) > 1:
            tokens = self.tokens[self.size :]
            self._build(self.leaves[:first] + parts + self.leaves[last + 1 :], tokens[:first] + [self.count(p) for p in parts] + tokens[last + 1 :])
            return
        for leaf in range(first, last + 1):
            self.leaves[leaf] = new if leaf == first else ""
            self.chars[leaf + self.size] = len(self.leaves[leaf])
            self.tokens[leaf + self.size] = self.count(new) if leaf == first else 0
        low, high = (first + self.size) // 2, (last + self.size) // 2
        while low:
            for i in range(low, high + 1):
                self._sum(i)
            low, high = low // 2, high // 2


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """docs (doc_id, text) with the rows of edits (doc_id, seq, start, stop, replacement) as an array in order of seq."""
    lists = edits.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seq", "start", "stop", "replacement"))).alias("edits"))
    return docs.select("doc_id", "text").join(lists, "doc_id", "left").withColumn("edits", F.expr("transform(edits, e -> named_struct('start', e.start, 'stop', e.stop, 'replacement', e.replacement))"))


def count_tokens(docs: DataFrame, json_path: str, ranks_path: str) -> DataFrame:
    """Token counts before and after the edits of each row of docs (doc_id, text, edits)."""
    prepare(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        encode = byte_bpe.encoder(json_path, ranks_path)
        for b in batches:
            out = []
            for doc_id, text, edits in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                tree = TokenTree(text or "", lambda t: len(encode(t)))
                n_chars, n_tokens = len(tree), tree.n_tokens
                for e in edits or ():
                    tree.edit(e["start"] or 0, len(tree) if e["stop"] is None else e["stop"], e["replacement"] or "")
                out.append((doc_id, n_chars, n_tokens, len(tree), tree.n_tokens, tree.encoded_chars))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("edits").cast(EDITS)).mapInArrow(run, SCHEMA)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three edits of each document: 40 code points at a third of it are replaced, a fiftieth of it at its middle goes,
    and a sentence is put before its end."""
    n = F.char_length(F.coalesce("text", F.lit("")))
    third, half = F.floor(n / 3), F.floor(n / 2)
    # Positions are those of the text that the edits before have left: the first one adds 21 - min(40, n - third).
    moved = F.lit(21) - F.least(F.lit(40), n - third)
    edit = lambda start, stop, text: F.struct(start.cast("long").alias("start"), stop.cast("long").alias("stop"), F.lit(text).alias("replacement"))
    docs = documents(spark, sf_dir).select("doc_id", "text", F.array(
        edit(third, third + 40, " an edit's passage, 7"), edit(half + moved, half + moved + F.floor(n / 50), ""), edit(n - 3, n - 3, "? The last sentence."),
    ).alias("edits"))
    return count_tokens(docs, tokenizer_file("byte_bpe_50k.json"), tokenizer_file("byte_bpe_50k.tiktoken"))
