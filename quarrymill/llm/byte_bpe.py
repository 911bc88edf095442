"""Byte-level BPE ids for whole texts, as the tokenizers library gives them for a byte-level vocabulary file."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np


@lru_cache(maxsize=2)
def encoder(json_path: str, ranks_path: str):
    """encode(text) -> uint32 array. The rank file holds the vocabulary of the JSON file; its library is several times
    faster. Texts that hold a special token's string go to the JSON file's own library, which gives that token's id."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(json_path)
    whole.no_truncation()
    whole.no_padding()
    special = tuple(t.content for t in whole.get_added_tokens_decoder().values())
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if any(s in text for s in special):
            return whole.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def little_endian(ids) -> bytes:
    return np.asarray(ids, dtype="<u4").tobytes()
