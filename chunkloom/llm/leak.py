"""Passages of test items inside a corpus, found by q-gram filtering over diagonal bands and banded alignment.

Texts are brought to words: one form (see lookalike), lower case, runs of letters and digits, joined by single spaces.
A corpus text that holds a window of an item's words with at most k edits shares at least
``length - q + 1 - q * k`` character q-grams with it on diagonals (place in the text minus place in the item) that lie
within k of each other. Shared q-grams are counted in overlapping bands of diagonals; bands that reach the bound of the
item's shortest window are verified by banded alignment of its windows. All is vectorised over a batch of texts.

The corpus is read once and not shuffled. The items are shipped to the tasks in blocks of at most ``block_chars``
characters, each block being a pass over the corpus; a test set of any size is thus handled with bounded memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.llm.lookalike import fold_text

WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
Q, WINDOW, BLOCK_CHARS = 8, 12, 4_000_000
_MUL = np.uint64(0x9E3779B97F4A7C15)
_BITS = 22


def word_form(text: str) -> str:
    """`` w1 w2 ... wn `` with a blank at both ends; a blank alone if there is no word."""
    return " ".join(["", *WORD.findall(fold_text(text).lower()), ""]) or " "


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of each q-gram by doubling: h(2n) from two h(n)."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h, width = codes.astype(np.uint64) * _MUL, 1
    while width < q:
        by = min(width, q - width)
        h = (h[: len(h) - by] ^ (h[: len(h) - by] >> np.uint64(29))) * _MUL + h[by:]
        width += by
    h ^= h >> np.uint64(32)
    return h[:n] * _MUL


class Index:
    """The items' q-grams: sorted hashes with postings (item, place), and each item's windows."""

    def __init__(self, items: list[tuple[int, str]], q: int = Q, window: int = WINDOW, edits: int = 0):
        self.q, self.edits = q, edits
        self.ids: list[int] = []
        self.forms: list[np.ndarray] = []
        self.windows: list[list[tuple[int, int]]] = []
        self.least: list[int] = []
        hashes, owners, places = [], [], []
        for key, text in items:
            form = word_form(text)
            blanks = [i for i, c in enumerate(form) if c == " "]
            spans = [(blanks[i], blanks[i + window] + 1) for i in range(len(blanks) - window)]
            if not spans:
                continue
            h = gram_hashes(_codes(form), q)
            hashes.append(h)
            owners.append(np.full(len(h), len(self.ids), np.int32))
            places.append(np.arange(len(h), dtype=np.int32))
            self.ids.append(key)
            self.forms.append(_codes(form))
            self.windows.append(spans)
            self.least.append(max(1, min(b - a for a, b in spans) - q + 1 - q * edits))
        flat = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.hashes = flat[order]
        self.owner = np.concatenate(owners)[order] if hashes else np.empty(0, np.int32)
        self.place = np.concatenate(places)[order] if hashes else np.empty(0, np.int32)
        self.known = np.zeros(1 << _BITS, bool)
        self.known[(flat >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        self.bound = np.array(self.least, np.int64)

    def reached(self, item: int, places: np.ndarray) -> list[tuple[int, int]]:
        """The item's windows that have as many of these sorted places of shared q-grams as their own length demands."""
        spans = np.array(self.windows[item], np.int64)
        shared = np.searchsorted(places, spans[:, 1] - self.q, "right") - np.searchsorted(places, spans[:, 0], "left")
        return [self.windows[item][k] for k in np.flatnonzero(shared >= np.maximum(1, spans[:, 1] - spans[:, 0] - self.q + 1 - self.q * self.edits))]


def banded(a: np.ndarray, b: np.ndarray, edits: int) -> bool:
    """Whether ``a`` aligns to a prefix of ``b`` with at most ``edits`` edits, inside a band of that half-width."""
    if not edits:
        return len(b) >= len(a) and bool((a == b[: len(a)]).all())
    big = edits + 1
    row = [big] * edits + [j for j in range(edits + 1)]
    for i in range(1, len(a) + 1):
        new = [big] * (2 * edits + 1)
        for c in range(2 * edits + 1):
            j = i + c - edits
            if j < 0 or j > len(b):
                continue
            best = row[c + 1] + 1 if c < 2 * edits else big
            if c:
                best = min(best, new[c - 1] + 1)
            if j:
                best = min(best, row[c] + (a[i - 1] != b[j - 1]))
            new[c] = min(best, big)
        row = new
        if min(row) > edits:
            return False
    return min(row) <= edits


def matches(index: Index, texts: list[str]) -> list[tuple[int, int]]:
    """(place of the text, item id) of all texts that hold a window of an item."""
    if not index.ids:
        return []
    forms = [word_form(t) if t else " " for t in texts]
    codes = _codes("\0".join(forms))
    starts = np.cumsum([0] + [len(f) + 1 for f in forms])
    h = gram_hashes(codes, index.q)
    at = np.flatnonzero(index.known[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
    lo = np.searchsorted(index.hashes, h[at], "left")
    n = np.searchsorted(index.hashes, h[at], "right") - lo
    at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
    if not len(at):
        return []
    posting = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    where = np.repeat(at, n)
    text = np.searchsorted(starts, where, "right") - 1
    item = index.owner[posting].astype(np.int64)
    diagonal = where - starts[text] - index.place[posting]
    width = 2 * index.edits + 1
    # band b holds the diagonals from b * width to (b + 1) * width + 2 * edits, so that any 2 * edits + 1 neighbours share one
    shifted = diagonal + (1 << 30)
    bands = [shifted // width] + ([(shifted - x) // width for x in (2 * index.edits,)] if index.edits else [])
    text, item, place, bands = (np.concatenate(x) for x in ([text] * len(bands), [item] * len(bands), [index.place[posting]] * len(bands), bands))
    packed = (text * len(index.ids) + item) * (1 << 31) + bands  # one number a group; texts of a batch are few
    order = np.argsort(packed, kind="stable")
    key = np.stack([text, item, bands], 1)[order]
    new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1)]))
    count = np.diff(np.concatenate([new, [len(key)]]))
    found: set[tuple[int, int]] = set()
    enough = count >= index.bound[key[new, 1]]
    for (t, i, b), begin, n in zip(key[new[enough]].tolist(), new[enough].tolist(), count[enough].tolist()):
        if (t, index.ids[i]) in found:
            continue
        own = codes[starts[t]: starts[t + 1] - 1]
        windows = index.windows[i]
        if index.edits:  # the bound holds for every window by itself
            windows = index.reached(i, np.unique(place[order[begin:begin + n]]))
        first = b * width - (1 << 30)
        diagonals = range(first, first + width + (2 * index.edits if index.edits else 0))
        if any(x + d >= 0 and banded(index.forms[i][x:y], own[x + d: y + d + index.edits], index.edits) for x, y in windows for d in diagonals):
            found.add((t, index.ids[i]))
    return sorted(found)


def leaks(corpus: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
          window: int = WINDOW, edits: int = 0, q: int = Q, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Distinct (key, item_key): the corpus text holds ``window`` consecutive words of the item, up to ``edits`` character edits.

    Null and empty texts hold nothing; items with fewer words than ``window`` are found nowhere; equal items and equal
    texts each give their own rows; empty tables give an empty result. Other columns are ignored.
    """
    spark = corpus.sparkSession
    known = items.select(F.col(f"`{item_key}`").alias("i"), F.col(f"`{item_text}`").alias("t")).filter("t IS NOT NULL AND i IS NOT NULL")
    size = known.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, -(-size // block_chars))
    rows = corpus.select(F.col(f"`{key}`").cast("bigint").alias(key), F.col(f"`{text}`").alias("t")).filter(F.length("t") > 0)

    def over(block: int) -> DataFrame:
        own = known.filter(F.pmod(F.xxhash64("i"), F.lit(blocks)) == block).collect()  # at most about block_chars
        shipped = spark.sparkContext.broadcast(Index([(r.i, r.t) for r in own], q, window, edits))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shipped.value
            for batch in batches:
                for part in (batch.slice(x, 500) for x in range(0, batch.num_rows, 500)):
                    keys = part.column(0).to_pylist()
                    hits = matches(index, part.column(1).to_pylist())
                    yield pa.RecordBatch.from_arrays([pa.array([keys[t] for t, _ in hits], pa.int64()), pa.array([i for _, i in hits], pa.int64())], [key, item_key])

        return rows.mapInArrow(run, f"`{key}` bigint, `{item_key}` bigint")

    return reduce(DataFrame.unionByName, map(over, range(blocks))).distinct()
