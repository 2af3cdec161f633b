"""Token counters for Python operators, and the same counts as column expressions.

The default counter takes runs of ASCII word characters and every other visible character as a token, which Java, RE2 and
Python regular expressions agree on. A BPE counter reads a vocabulary file whose path is a parameter.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache
from itertools import islice
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

WORDS = r"\w+|[^\w\s]"
TILES = r"\s*(?:\w+|[^\w\s])|\s+"


class TokenCounter(Protocol):
    #: Whether the counts of texts that meet at a blank or line end add up.
    additive: bool

    def count(self, text: str) -> int: ...

    def encode(self, text: str) -> list: ...

    def decode(self, tokens: list) -> str: ...


class RegexCounter:
    additive = True
    _words, _tiles = re.compile(WORDS, re.A), re.compile(TILES, re.A)

    def count(self, text: str) -> int:
        return len(self._words.findall(text))

    def encode(self, text: str) -> list[str]:
        """Tokens that tile the text: blanks go with what follows them."""
        return self._tiles.findall(text)

    def decode(self, tokens: list[str]) -> str:
        return "".join(tokens)

    def reach(self, text: str, start: int, size: int) -> int:
        """The end of the shortest part from ``start`` that has ``size`` tokens."""
        last = next(islice(self._words.finditer(text, start), size - 1, None), None)
        return last.start() + 1 if last else len(text)


class BpeCounter:
    """Counts by a rank file of a public byte-level vocabulary; a part of a character decodes to nothing."""

    additive = False

    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
        self._encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def count(self, text: str) -> int:
        return len(self._encoding.encode_ordinary(text))

    def encode(self, text: str) -> list[int]:
        return self._encoding.encode_ordinary(text)

    def decode(self, tokens: list[int]) -> str:
        try:
            return self._encoding.decode_bytes(tokens).decode("utf-8")
        except UnicodeDecodeError:
            return ""

    def reach(self, text: str, start: int, size: int) -> int:
        """As the other counter's. A character adds at most its four bytes and what they split, so strides of an eighth of what is missing pass no end."""
        end = start + 1
        while end < len(text) and (missing := size - self.count(text[start:end])) > 0:
            end += max(1, missing // 8)
        return min(end, len(text))


#: Public splitting rule of byte-level vocabularies.
BPE_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def counter(name: str = "regex") -> TokenCounter:
    """``regex``, or ``bpe:PATH`` for a rank file; an unknown name gives the default."""
    return BpeCounter(name[4:], BPE_PATTERN) if name.startswith("bpe:") else RegexCounter()


def count_tokens(text: Column) -> Column:
    """Tokens of the default counter, in the JVM; null gives null."""
    return F.size(F.regexp_extract_all(text, F.lit(WORDS), F.lit(0)))


def tile_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TILES), F.lit(0))
