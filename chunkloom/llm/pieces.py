"""Oversized items cut at natural boundaries by content-defined chunking.

A rolling hash over the last ``HASH_WINDOW`` bytes marks landmarks. From the begin of a piece the first landmark between
the minimum and the maximum size is taken (the smallest hash, if none is marked) and moved to the nearest natural
boundary around it: blank line, line end, sentence end, blank, at last the begin of a character. Landmarks and boundaries
depend on nearby bytes only, so an edit alters the pieces beside it and the later cuts fall where they fell before.
Every piece after the first repeats a tail of the one before, from a boundary inside the allowed overlap.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HASH_WINDOW = 32
ITEM_BYTES, ENTITY_BYTES, OVERLAP_BYTES, CHUNK_TOKENS, OVERLAP_TOKENS = 6_000, 1_500, 200, 512, 50
_LEVELS = [re.compile(p) for p in (
    rb"\n[^\S\n]*\n+", rb"\n", rb"[.!?][\"')\]]*\s|\xe3\x80\x82|\xef\xbc[\x81\x9f]|\xef\xbd\xa1", rb"\s+|\xe3\x80\x81|\xef\xbc\x8c|\xe3\x80\x80")]
_GEAR = np.random.Generator(np.random.PCG64(20_240_131)).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def rolling(data: bytes) -> np.ndarray:
    """A gear hash of the ``HASH_WINDOW`` bytes that end before each place (places 0 to len)."""
    g = _GEAR[np.frombuffer(data, np.uint8)]
    h, width = g.copy(), 1
    while width < HASH_WINDOW:  # h(2n) at i is h(n) at i and h(n) at i - n, shifted
        shifted = np.zeros_like(h)
        shifted[width:] = h[:-width] if width < len(h) else 0
        h = h + (shifted << np.uint64(width))
        width *= 2
    return np.concatenate([np.zeros(1, np.uint64), (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)])


def _char_start(data: bytes, at: int) -> int:
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def _nearest(data: bytes, at: int, low: int, high: int, reach: int) -> int:
    """The natural boundary nearest to ``at`` within ``reach`` and [low, high], the coarsest kind first."""
    a, b = max(low, at - reach), min(high, at + reach)
    for level in _LEVELS:
        ends = [m.end() for m in level.finditer(data, max(0, a - 8), b) if a <= m.end() <= b]
        if ends:
            return min(ends, key=lambda e: (abs(e - at), e))
    return 0


def cuts(data: bytes, most: int, overlap: int) -> list[tuple[int, int]]:
    """(begin, end) of the pieces of ``data``, each at most ``most`` bytes, each begin at most ``overlap`` before the last end.

    Data within the limit is one piece, empty data none. Characters are never cut, except that a limit below the width
    of one character gives that character whole.
    """
    if not data:
        return []
    if len(data) <= most:
        return [(0, len(data))]
    overlap = min(overlap, most // 4)
    body = max(1, most - overlap)
    least = max(1, body // 4)
    bits = max(1, (body // 4).bit_length() - 1)
    hashes = rolling(data)
    marks = np.flatnonzero(hashes & np.uint64((1 << bits) - 1) == 0)
    out, begin, last = [], 0, 0
    while True:
        if len(data) - begin <= most:
            out.append((begin, len(data)))
            return out
        low, high = last + least, min(len(data) - 1, max(begin + most if last == 0 else last + body, last + 1))
        low = min(low, high)
        k = np.searchsorted(marks, low)
        at = int(marks[k]) if k < len(marks) and marks[k] <= high else low + int(np.argmin(hashes[low:high + 1]))
        end = _nearest(data, at, low, high, max(16, body // 6)) or _nearest(data, at, low, high, body) or _char_start(data, at)
        if end <= last:
            end = last + 1
            while end < len(data) and data[end] & 0xC0 == 0x80:
                end += 1
        out.append((begin, end))
        last, tail, begin = end, max(end - overlap, begin + 1), end
        if overlap:
            begin = _nearest(data, tail, tail, end - 1, overlap) or _char_start(data, tail)
            if begin < tail:
                begin = next((i for i in range(tail, end) if data[i] & 0xC0 != 0x80), end)


def _lines(text: str) -> list[str]:
    lines = text.split("\n")
    return lines[:-1] if lines and not lines[-1] else lines


def entity_text(lines: list[str], start: int | None, end: int | None) -> str:
    """The lines from ``start`` to ``end``, both included and counted from 1; those outside the file are left out."""
    if start is None or end is None:
        return ""
    return "\n".join(lines[max(0, start - 1):max(0, end)])


_OUT = "record_kind string, record_key string, pos int, piece_no int, start_byte int, end_byte int, text string"


def _emit(found: list[tuple], with_text: bool) -> pa.RecordBatch:
    kinds, keys, places, numbers, starts, ends, texts = [], [], [], [], [], [], []
    for kind, key, pos, data, most, overlap in found:
        for n, (a, b) in enumerate(cuts(data, most, overlap)):
            kinds.append(kind)
            keys.append(key)
            places.append(pos)
            numbers.append(n)
            starts.append(a)
            ends.append(b)
            texts.append(data[a:b].decode("utf-8", "replace") if with_text else None)
    types = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((kinds, keys, places, numbers, starts, ends, texts), types)],
                                      ["record_kind", "record_key", "pos", "piece_no", "start_byte", "end_byte", "text"])


def text_pieces(rows: DataFrame, with_text: bool = True) -> DataFrame:
    """Pieces of every row of (record_kind string, record_key string, pos int, content string, most int, overlap int).

    Rows with null content give none; repeated rows each give their pieces.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            yield _emit([(k, r, p, t.encode("utf-8", "surrogatepass"), m, o) for k, r, p, t, m, o in zip(*columns)], with_text)

    narrow = rows.select("record_kind", "record_key", F.col("pos").cast("int"), "content", F.col("most").cast("int"), F.col("overlap").cast("int"))
    return narrow.filter(F.octet_length("content") > 0).mapInArrow(run, _OUT)


def oversized_items(items: DataFrame, most: int = ITEM_BYTES, overlap: int = OVERLAP_BYTES) -> DataFrame:
    return items.filter(F.octet_length("content") > most).select(
        F.lit("item").alias("record_kind"), F.col("id").alias("record_key"), F.lit(0).alias("pos"), "content", F.lit(most).alias("most"), F.lit(overlap).alias("overlap"))


def oversized_chunks(chunks: DataFrame, tokens: int = CHUNK_TOKENS, overlap: int = OVERLAP_TOKENS) -> DataFrame:
    """Chunks with a usable count above ``tokens``. A piece's tokens are its bytes at the chunk's own rate of bytes a token."""
    size, count = F.octet_length("content"), F.col("token_count")
    return chunks.filter((count > tokens) & (count <= size)).select(
        F.lit("chunk").alias("record_kind"), F.col("id").alias("record_key"), F.lit(0).alias("pos"), "content",
        F.greatest(F.lit(1), F.floor(size * tokens / count)).alias("most"), F.floor(size * overlap / count).alias("overlap"))


def entity_pieces(events: DataFrame, most: int = ENTITY_BYTES, overlap: int = OVERLAP_BYTES, with_text: bool = True) -> DataFrame:
    """Pieces of the entities whose lines have more than ``most`` bytes; entities with a null line are no cases."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for key, content, spans in zip(*(c.to_pylist() for c in batch.columns)):
                lines = _lines(content)
                for pos, span in enumerate(spans):
                    if span and span["s"] is not None and span["e"] is not None:
                        data = entity_text(lines, span["s"], span["e"]).encode("utf-8", "surrogatepass")
                        if len(data) > most:
                            found.append(("entity", key, pos, data, most, overlap))
            yield _emit(found, with_text)

    # zipped fields, so that the entities' own texts are not read
    spans = F.arrays_zip(F.col("entities.start_line").alias("s"), F.col("entities.end_line").alias("e"))
    narrow = events.filter((F.octet_length("normalized_content") > most) & (F.size("entities.start_line") > 0)).select(
        F.col("delivery_id").cast("string"), "normalized_content", spans.alias("spans"))
    return narrow.mapInArrow(run, _OUT)


def oversized_pieces(items: DataFrame, events: DataFrame, chunks: DataFrame, with_text: bool = True) -> DataFrame:
    """Pieces of all records of the three kinds that exceed their limit."""
    return (text_pieces(oversized_items(items), with_text).unionByName(text_pieces(oversized_chunks(chunks), with_text))
            .unionByName(entity_pieces(events, with_text=with_text)))
