"""Messages delivered at least once: keep one copy of each.

Identifiers are split by their aggregated frequency, which takes nothing of a row but its key and order: a map-side combined
count, so that an identifier that a third of all rows carry sends one partial row a task. Singletons pass directly, only
repeated groups are ranked, and both are united. Whole rows stay where they are:

* Up to ``few`` repeated keys (``FEW``, some 50 MB) are broadcast, and every row is told from its own key and order whether it
  is its group's first. No exchange carries whole rows, but for rows that are equal in key and order, if there are any.
* Beyond that, a filter of fixed size (``WORDS`` words of 64 bits, whatever the data) is broadcast. Rows that it does not know
  are singletons and pass in place; only the others, the repeated groups and a few more, are ranked by key, of which Spark
  keeps one row a group and task before the shuffle. (``later_copies`` wants all but the first of a group; it joins these rows with
  their key's first, the keys of more than ``hot_rows`` rows by broadcast.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkloom.operators.skew import HOT_ROWS, with_facts
from chunkloom.storage import cut

FEW = 500_000
WORDS = 1 << 20
UUID_FORM = r"^(?U)\s*(?:urn:uuid:)?\{?([0-9a-f]{8})-?([0-9a-f]{4})-?([0-9a-f]{4})-?([0-9a-f]{4})-?([0-9a-f]{12})\}?\s*$"


def uuid_key(identifier: Column) -> Column:
    """The 16 bytes that a written UUID denotes (any case, with or without hyphens, braces, ``urn:uuid:`` or blanks).

    Null and blank give null, other texts the bytes of their trimmed form, so that they equal only themselves.
    """
    packed = F.regexp_replace(F.lower(identifier), UUID_FORM, "$1$2$3$4$5")
    trimmed = F.regexp_replace(identifier, r"^(?U)\s+|(?U)\s+$", "")
    other = F.when(F.length(trimmed) > 0, F.concat(F.lit("text:").cast("binary"), F.encode(trimmed, "UTF-8")))
    return F.when(packed.rlike("^[0-9a-f]{32}$"), F.unhex(packed)).otherwise(other)


def _keyed(messages: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """Key, order and the whole row as one column, so that no name of the table can clash with these."""
    return messages.select(key.alias("__key"), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]).alias("__order"), F.struct("*").alias("__row"))


def _first_of_repeated(keyed: DataFrame) -> DataFrame:
    """(__key, __copies, __first) of the keys that more than one row has."""
    counted = keyed.filter(F.col("__key").isNotNull()).groupBy("__key").agg(F.count(F.lit(1)).alias("__copies"), F.min("__order").alias("__first"))
    return counted.filter("__copies > 1")


def _first_and_ties(keyed: DataFrame) -> DataFrame:
    """The same with ``__ties``, how many rows are equal in key and least order."""
    same = keyed.filter(F.col("__key").isNotNull()).groupBy("__key", "__order").agg(F.count(F.lit(1)).alias("n"))
    counted = same.groupBy("__key").agg(F.sum("n").alias("n"), F.min(F.struct("__order", "n")).alias("least"))
    return counted.filter("n > 1").select("__key", F.col("least")["__order"].alias("__first"), F.col("least")["n"].alias("__ties"))


def _in_filter(keyed: DataFrame, repeated: DataFrame) -> DataFrame:
    """``keyed`` with ``__maybe``: false only where the key is certainly not among the repeated ones."""
    def word(key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(WORDS))

    def bits(key: Column) -> Column:
        h = F.xxhash64(key, F.lit(1))
        one = F.lit(1).cast("bigint")
        return F.call_function("shiftleft", one, F.pmod(h, F.lit(64)).cast("int")).bitwiseOR(
            F.call_function("shiftleft", one, F.pmod(F.shiftright(h, 8), F.lit(64)).cast("int"))).bitwiseOR(
            F.call_function("shiftleft", one, F.pmod(F.shiftright(h, 16), F.lit(64)).cast("int")))

    known = repeated.groupBy(word(F.col("__key")).alias("__word")).agg(F.bit_or(bits(F.col("__key"))).alias("__bits"))
    joined = keyed.withColumn("__word", word(F.col("__key"))).join(F.broadcast(known), "__word", "left")
    own = bits(F.col("__key"))
    return joined.withColumn("__maybe", F.coalesce(F.col("__bits").bitwiseAND(own) == own, F.lit(False))).drop("__word", "__bits")


def later_copies(messages: DataFrame, key: Column, order: list[Column], few: int = FEW, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The rows of ``messages`` whose key stands in a row that is smaller by ``order``.

    Rows with a null key are never copies; rows equal in ``order`` are no copies of each other. Columns are kept; an
    empty table gives an empty one. Nulls order first.
    """
    keyed = _keyed(messages, key, order)
    repeated = cut(_first_of_repeated(keyed))
    known = keyed.filter(F.col("__key").isNotNull())
    if repeated.count() <= few:
        return known.join(F.broadcast(repeated), "__key").filter(F.col("__order") > F.col("__first")).select("__row.*")
    maybe = _in_filter(known, repeated).filter("__maybe").drop("__maybe")
    return with_facts(maybe, repeated, "__key", "__copies", hot_rows).filter(F.col("__order") > F.col("__first")).select("__row.*")


def once(messages: DataFrame, key: Column, order: list[Column], stored: DataFrame | None = None, few: int = FEW) -> DataFrame:
    """Exactly one row of each message: the first by ``order``, a stored one before any new one.

    With ``stored`` (the columns of key and order at least) the result holds only rows of ``messages``, those that have to be
    added to it; stored rows are read for key and order only. Rows with a null key are messages of their own and all pass.
    Of rows equal in ``order`` one is kept; where whole rows repeat, an order that ends with ``storage.row_address`` spares their
    ranking. An empty table gives an empty one.
    """
    keyed = _keyed(messages, key, [F.lit(1), *order])
    every = keyed if stored is None else _keyed(stored, key, [F.lit(0), *order]).drop("__row").unionByName(keyed.drop("__row"))
    repeated = cut(_first_and_ties(every))
    found, tied = repeated.agg(F.count(F.lit(1)), F.coalesce(F.max("__ties"), F.lit(0))).first()
    firsts = Window.partitionBy("__key").orderBy("__order")
    if found <= few:
        joined = keyed.join(F.broadcast(repeated), "__key", "left")
        first = F.col("__first").isNull() | (F.col("__order") == F.col("__first"))
        kept = joined.filter(first & (F.coalesce("__ties", F.lit(1)) <= 1))
        if tied > 1:
            equal = joined.filter(first & (F.col("__ties") > 1)).withColumn("__rank", F.row_number().over(firsts)).filter("__rank <= 1")
            kept = kept.unionByName(equal.drop("__rank"))
        return kept.select("__row.*")
    split = _in_filter(keyed, repeated)
    groups = split.filter("__maybe")
    if stored is not None:  # a stored first beats all new rows of its key; it stands for its row, which is not read
        old = repeated.filter(F.col("__first")["o0"] == 0).select("__key", F.col("__first").alias("__order"))
        groups = groups.unionByName(old, allowMissingColumns=True)
    ranked = groups.withColumn("__rank", F.row_number().over(firsts)).filter("__rank <= 1")
    return split.filter(~F.col("__maybe")).unionByName(ranked.drop("__rank")).filter(F.col("__order")["o0"] == 1).select("__row.*")
