"""Joining rows with facts about their keys, where one key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000


def with_facts(rows: DataFrame, facts: DataFrame, key: str, copies: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The inner join of ``rows`` with ``facts``, which has one row a key and in ``copies`` the number of its rows.

    Keys of more than ``hot_rows`` rows, at most rows / hot_rows of them, are joined by broadcast and leave the shuffle;
    the others are shuffled in groups of at most ``hot_rows``. Whether there are hot keys is asked of ``facts`` first, which
    should therefore be stored.
    """
    hot, cold = facts.filter(F.col(copies) > hot_rows), facts.filter(F.col(copies) <= hot_rows)
    if hot.isEmpty():
        return rows.join(facts, key)
    tagged = rows.join(F.broadcast(hot.select(key, F.lit(True).alias("__hot"))), key, "left")
    rest = tagged.filter("__hot IS NULL").drop("__hot").join(cold, key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)
