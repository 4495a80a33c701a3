"""Pre-tokens and their codes, looked up per process before the library is asked.

For texts made only of characters on whose class all Unicode versions agree, the
pre-tokens are cut here and each is encoded alone, which gives the same ids: the
merges never cross a pre-token.  Any other text, and any text that holds a
special string, goes to the library whole.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import cache

import numpy as np
import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# The splitting patterns of the two tokenizer files.
BYTE_PATTERN = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
WORD_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")

PLAIN = regex.compile(
    "[\\t\\n\\r\\x20-\\x7e\\u00a1-\\u012f\\u0131-\\u01c3\\u01cd-\\u01f0\\u01f4-\\u024f"
    "\\u2010-\\u2027\\u2030-\\u205e\\u20ac]*")

# Entries kept per process; a full cache starts anew.
CACHED = 1_000_000


@cache
def load(file: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(file)


def encode(file: str, text: str) -> list[int]:
    return load(file).encode(text, add_special_tokens=False).ids


def cut_here(text: str) -> bool:
    return "<|" not in text and PLAIN.fullmatch(text) is not None


class Cache(dict):
    """A dict that computes what it lacks and is emptied when full."""

    def __init__(self, compute: Callable, size: int = CACHED) -> None:
        super().__init__()
        self.compute, self.size = compute, size

    def __missing__(self, key):
        if len(self) >= self.size:
            self.clear()
        self[key] = value = self.compute(key)
        return value


@cache
def codes(file: str) -> Cache:
    """Pre-token to its ids as little-endian unsigned 32-bit bytes, for this process."""
    return Cache(lambda piece: np.array(encode(file, piece), "<u4").tobytes())


@cache
def lengths(file: str) -> Cache:
    """Pre-token to its number of tokens, for this process."""
    return Cache(lambda piece: len(encode(file, piece)))


def word_ids(file: str, text: str) -> bytes:
    """Ids of the lower-casing word tokenizer as little-endian bytes."""
    if not cut_here(text):
        return np.array(encode(file, text), "<u4").tobytes()
    return b"".join(map(codes(file).__getitem__, WORD_PATTERN.findall(text.lower())))
