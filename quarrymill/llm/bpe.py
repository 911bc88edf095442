"""Byte-pair encoding and decoding by a priority queue of merge ranks.

A piece of text is a doubly linked list of symbols. The ranks of all neighbouring pairs are in a heap; the best entry is
taken, skipped if either of its symbols has changed since (a stale entry), else the two symbols become one and the pairs
with its neighbours join the heap. Decoding concatenates the vocabulary's strings, joined as the tokenizer file says.

`WordBpe` reads a tokenizer file of the kind "NFC, white space to blank, lower case; split into runs of letters, single
digits and runs of signs; byte-level symbols with a word-end suffix; no decoder" and refuses any other. White space only separates words, so it is not folded
first; words don't affect each other, so the results for short ones are kept in bounded tables.

Null texts count as empty: no ids, and the hashes of nothing. Repeated rows get repeated results.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from .byte_bpe import little_endian
from .common import documents, prepare, texts, tokenizer_file

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
# Unicode's White_Space, as the tokenizer's pattern library has it. Fixed values.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
KEPT_WORDS, KEPT_LENGTH = 400_000, 40


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if it is visible Latin-1, else the next one from U+0100."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    stand_in = iter(range(256, 512))
    return [chr(b if b in visible else next(stand_in)) for b in range(256)]


def merge(symbols: list[int], pairs: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """symbols after all merges; pairs: (left, right) -> (rank, merged symbol)."""
    n = len(symbols)
    symbols = symbols.copy()
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    queue = []
    for i in range(n - 1):
        if found := pairs.get((symbols[i], symbols[i + 1])):
            queue.append((found[0], i, symbols[i], symbols[i + 1], found[1]))
    heapq.heapify(queue)
    while queue:
        _, i, left, right, new = heapq.heappop(queue)
        j = after[i]
        if symbols[i] != left or j < 0 or symbols[j] != right:
            continue  # stale
        symbols[i], symbols[j] = new, -1
        k = after[i] = after[j]
        if k >= 0:
            before[k] = i
            if found := pairs.get((new, symbols[k])):
                heapq.heappush(queue, (found[0], i, new, symbols[k], found[1]))
        h = before[i]
        if h >= 0 and (found := pairs.get((symbols[h], new))):
            heapq.heappush(queue, (found[0], h, symbols[h], new, found[1]))
    return [s for s in symbols if s >= 0]


class WordBpe:
    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, steps = spec["model"], [x["type"] for x in spec["normalizer"]["normalizers"]]
        if steps != ["NFC", "Replace", "Lowercase"] or spec["decoder"] or model["type"] != "BPE" or spec["post_processor"]:
            raise ValueError("not a tokenizer file of the kind that WordBpe reads")
        self.vocab, self.suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in [*self.vocab.items(), *self.added.items()]}
        self.pairs = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a + b])
        self.start = [self.vocab.get(c) for c in byte_symbols()]
        self.end = [self.vocab.get(c + self.suffix) for c in byte_symbols()]
        # The file's own pattern, with white space spelt out.
        self.words = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.younger: dict[str, tuple[bytes, str]] = {}
        self.older: dict[str, tuple[bytes, str]] = {}

    def word(self, word: str) -> tuple[bytes, str]:
        """Ids as bytes and decoded text of one word, from one of two tables: the older one is dropped when the younger
        one is full, so words that keep occurring stay."""
        if (found := self.older.get(word)) is None:
            raw = word.encode()
            symbols = [*(self.start[b] for b in raw[:-1]), self.end[raw[-1]]]
            ids = merge([s for s in symbols if s is not None], self.pairs)
            found = little_endian(ids), self.decode(ids)
        if len(word) <= KEPT_LENGTH:
            if len(self.younger) >= KEPT_WORDS:
                self.older, self.younger = self.younger, {}
            self.younger[word] = found
        return found

    def plain(self, text: str) -> list[tuple[bytes, str]]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # each character by itself: no final sigma
        return [self.younger.get(w) or self.word(w) for w in self.words.findall(text.lower())]

    def encode(self, text: str) -> tuple[bytes, str]:
        """(ids as little-endian uint32, decoded text)."""
        if self.special and "<" in text and self.special.search(text):
            parts = []
            for p in self.special.split(text):
                parts += [(little_endian([self.added[p]]), p)] if p in self.added else self.plain(p)
        else:
            parts = self.plain(text)
        return b"".join([p[0] for p in parts]), " ".join([p[1] for p in parts if p[1]])

    def decode(self, ids) -> str:
        return " ".join([self.strings[i] for i in ids])


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids as little-endian uint32, decoded text) of each document."""
    return _each(docs, path, id_col, text_col, "doc_id long, ids binary, decoded string", lambda ids, decoded: (ids, decoded))


def _each(docs, path, id_col, text_col, schema, row) -> DataFrame:
    prepare(docs.sparkSession)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        import pyarrow as pa

        bpe = word_bpe(path)
        for b in batches:
            found = [row(*bpe.encode(t)) for t in b.column(1).to_pylist()]
            if found:
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c) for c in zip(*found, strict=True))], names=names)

    return texts(docs, id_col, text_col).mapInArrow(run, schema)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digests(ids, decoded):
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

    return _each(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"), "doc_id", "text", SCHEMA, digests)
