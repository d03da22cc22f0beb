"""A byte-level BPE file's ids: the tokenizers library's, through a faster encoder with the same vocabulary."""

from __future__ import annotations

import json
from functools import lru_cache

# Fixed values of byte-level tokenizers: the letter that stands for each byte.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = {b: chr(b) for b in PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(PRINTABLE)))}


@lru_cache(1)
def load_encoder(path: str):
    """Same merges, same special strings, same ids as the file gives in the library."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    to_byte = {c: b for b, c in BYTE_LETTERS.items()}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(to_byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    return tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


@lru_cache(1)
def load_library(path: str):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(path)
    lib.no_truncation()
    lib.no_padding()
    return lib


def encode(text: str, path: str) -> list[int]:
    """The ids of a text, special strings included; what the fast encoder can't split (runs of a million gaps) the library encodes."""
    try:
        return load_encoder(path).encode(text, allowed_special="all")
    except ValueError:
        return load_library(path).encode(text, add_special_tokens=False).ids
