"""Text primitives whose meaning engines differ on: lines, blanks, byte cuts, sentence splits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def py_lines(text: str) -> list[str]:
    """Lines split at ``\\n``, without one last empty line and without a ``\\r`` right before the split."""
    parts = text.split("\n")
    last = parts.pop()
    return [p[:-1] if p.endswith("\r") else p for p in parts] + ([last] if last else [])


def lines(text: Column) -> Column:
    parts = F.split(F.regexp_replace(text, "\r\n", "\n"), "\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def trimmed(text: Column) -> Column:
    """Without Unicode blanks at both ends."""
    return F.regexp_replace(text, r"^(?U)\s+|(?U)\s+$", "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(r"(?U)\S")


def byte_prefix(text: Column, n: int) -> Column:
    """The longest prefix of whole characters with at most ``n`` UTF-8 bytes."""
    start = F.struct(F.lit("").alias("t"), F.lit(True).alias("open"))

    def take(acc: Column, ch: Column) -> Column:
        fits = acc["open"] & (F.octet_length(acc["t"]) + F.octet_length(ch) <= n)
        return F.struct(F.when(fits, F.concat(acc["t"], ch)).otherwise(acc["t"]).alias("t"), fits.alias("open"))

    cut = F.aggregate(F.split(F.substring(text, 1, n), ""), start, take, lambda acc: acc["t"])
    return F.when(F.octet_length(text) <= n, text).otherwise(cut)


def split_sentences(text: Column, delimiters: str = ".!?") -> Column:
    """Trimmed sentences: a delimiter before a blank or the end closes one; blank ones vanish."""
    marks = "".join("\\" + d for d in delimiters)
    parts = F.split(F.regexp_replace(text, rf"(?U)([{marks}])\s", "$1\x01"), "\x01", -1)
    return F.filter(F.transform(parts, trimmed), lambda s: s != "")


def merge_short(segments: Column, least: int) -> Column:
    """Segments joined by blanks until each has ``least`` bytes; a short rest joins the last."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(acc: Column, s: Column) -> Column:
        grown = F.when(acc["open"] == "", s).otherwise(F.concat(acc["open"], F.lit(" "), s))
        full = F.octet_length(grown) >= least
        return F.struct(F.when(full, F.array_append(acc["done"], grown)).otherwise(acc["done"]).alias("done"),
                        F.when(full, F.lit("")).otherwise(grown).alias("open"))

    def finish(acc: Column) -> Column:
        n = F.size(acc["done"])
        last = F.concat(F.element_at(acc["done"], -1), F.lit(" "), acc["open"])
        return (F.when(acc["open"] == "", acc["done"]).when(n == 0, F.array(acc["open"]))
                .otherwise(F.concat(F.slice(acc["done"], F.lit(1), n - 1), F.array(last))))

    return F.aggregate(segments, start, add, finish)
