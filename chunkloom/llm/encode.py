"""Encoding with a public byte-level BPE by prefix dynamic programming.

For every prefix of a pre-split piece exactly one token can end it: the one that is valid after the token stored for the
prefix before it. Two tokens are valid neighbours if encoding their joined bytes gives just them. Storing that last token
of each prefix makes appending exact, as only the new bytes are worked on, and lets an edited text keep every piece
before the edit and from the first common boundary after it.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
#: The setting of a session that names another folder of vocabulary files; the driver reads them and ships them to the tasks.
TOKENIZERS_SETTING = "spark.chunkloom.tokenizers"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A match depends on at most so many characters after its end.
LOOKAHEAD = 2
CACHED_PIECES = 300_000


def vocabulary_path(spark: SparkSession, name: str) -> str:
    return f"{spark.conf.get(TOKENIZERS_SETTING, TOKENIZERS)}/{name}"


class Encoder:
    """``source`` is the path of a rank file, or its contents."""

    def __init__(self, source: str | bytes):
        lines = (Path(source).read_bytes() if isinstance(source, str) else source).splitlines()
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.text = {i: b for b, i in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.split = regex.compile(PATTERN)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.own: dict[int, bool] = {}
        self.pieces: dict[str, list[int]] = {}

    def _merged(self, data: bytes) -> list[int]:
        """Plain merging of a few bytes, to learn which tokens may be neighbours."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _neighbours(self, a: int, b: int) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > 4_000_000:
                self.pairs.clear()
            known = self.pairs[a, b] = self._merged(self.text[a] + self.text[b]) == [a, b]
        return known

    def _reachable(self, token: int) -> bool:
        known = self.own.get(token)
        if known is None:
            known = self.own[token] = self._merged(self.text[token]) == [token]
        return known

    def extend(self, data: bytes, last: list[int]) -> list[int]:
        """The last token of every prefix of ``data``; ``last`` holds those of a shorter prefix already and grows."""
        ranks = self.ranks
        for end in range(len(last) + 1, len(data) + 1):
            for start in range(max(0, end - self.longest), end):
                token = ranks.get(data[start:end])
                if token is not None and (self._neighbours(last[start - 1], token) if start else self._reachable(token)):
                    last.append(token)
                    break
        return last

    def tokens(self, last: list[int]) -> list[int]:
        """The encoding that the stored last tokens spell."""
        out, end = [], len(last)
        while end:
            out.append(last[end - 1])
            end -= len(self.text[last[end - 1]])
        return out[::-1]

    def piece(self, piece: str) -> list[int]:
        ids = self.pieces.get(piece)
        if ids is None:
            data = piece.encode("utf-8", "surrogatepass")
            token = self.ranks.get(data)
            # a valid token that covers the piece is the last token of its longest prefix
            ids = [token] if token is not None and self._reachable(token) else self.tokens(self.extend(data, []))
            if len(piece) <= 64:
                if len(self.pieces) >= CACHED_PIECES:
                    self.pieces.clear()
                self.pieces[piece] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Ids without special tokens, whose strings are ordinary text; null and empty give an empty list."""
        out: list[int] = []
        for piece in self.split.findall(text or ""):
            out += self.piece(piece)
        return out


class Encoded:
    """A text with what is needed to append to it and to edit it exactly."""

    def __init__(self, encoder: Encoder, text: str = ""):
        self.encoder, self.text = encoder, ""
        self.bounds: list[int] = []  # ends of the pieces, in characters
        self.lasts: list[list[int]] = []
        self.worked = 0  # characters encoded so far
        self.replace(0, 0, text)

    def ids(self) -> list[int]:
        return [i for last in self.lasts for i in self.encoder.tokens(last)]

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, new: str) -> None:
        """Puts ``new`` in place of the characters from ``start`` to ``end``."""
        text = self.text[:start] + new + self.text[end:]
        grown = len(text) - len(self.text)
        keep = 0
        while keep < len(self.bounds) and self.bounds[keep] + LOOKAHEAD <= start:
            keep += 1
        bounds, lasts = self.bounds[:keep], self.lasts[:keep]
        old = {b + grown: i for i, b in enumerate(self.bounds) if b >= end}
        at = bounds[-1] if bounds else 0
        before = self.text[at:self.bounds[keep]] if keep < len(self.bounds) else ""
        while at < len(text):
            if at in old and at >= start + len(new):
                rest = old[at] + 1
                bounds += [b + grown for b in self.bounds[rest:]]
                lasts += self.lasts[rest:]
                break
            piece = self.encoder.split.match(text, at).group()
            kept: list[int] = []
            if len(bounds) == keep and keep < len(self.lasts) and before and piece.startswith(before):
                kept = list(self.lasts[keep])  # an append to the open piece
            lasts.append(self.encoder.extend(piece.encode("utf-8", "surrogatepass"), kept))
            at += len(piece)
            self.worked += len(piece)
            bounds.append(at)
        self.text, self.bounds, self.lasts = text, bounds, lasts


@lru_cache(maxsize=2)
def encoder(source: str | bytes) -> Encoder:
    return Encoder(source)


def encoded(texts: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(key, ids) of every row: null and empty texts have an empty list. Narrow: nothing is shuffled.

    ``vocabulary`` is the path of a rank file on the driver (byte_bpe_50k, if none is given); its contents, bounded by the
    vocabulary's size, are broadcast. Other columns are ignored; repeated keys give a row each; an empty table gives an empty one.
    """
    spark = texts.sparkSession
    shipped = spark.sparkContext.broadcast(Path(vocabulary or vocabulary_path(spark, "byte_bpe_50k.tiktoken")).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(shipped.value)
        for batch in batches:
            for part in (batch.slice(x, 256) for x in range(0, batch.num_rows, 256)):
                lists = [own.encode(t) for t in part.column(1).to_pylist()]
                offsets = np.zeros(len(lists) + 1, np.int32)
                np.cumsum([len(x) for x in lists], out=offsets[1:])
                flat = np.fromiter((i for x in lists for i in x), np.int32, offsets[-1])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], [key, "ids"])

    rows = texts.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias("t"))
    return rows.mapInArrow(run, f"`{key}` {rows.dtypes[0][1]}, ids array<int>")
