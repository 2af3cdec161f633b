"""One form for texts that look the same.

The text is exploded to positioned code points (a run of characters that nothing maps stays one item), a broadcast join
maps each to its canonical decomposition with width forms, joined letters, blanks, invisible characters and look-alike
letters resolved, and the text is put together again. Where marks or conjoining letters stand in it, combining sequences
are exploded once more, their marks ordered by combining class, recomposed and set back. The mapping is bounded by Unicode.

Letter case, missing accents, superscripts, styled letters (bold, script and the like) and forms of quotes and dashes stay
as they are: they look different.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.operators.skew import HOT_ROWS, with_facts
from chunkloom.storage import cut

# Letters of other scripts and the Latin letters that look like them.
LOOK_ALIKES = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P",
    "С": "C", "Т": "T", "Х": "X", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c",
    "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "Ӏ": "I",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "Ϳ": "J", "µ": "μ", "Օ": "O", "օ": "o", "ս": "u", "հ": "h",
    "ɑ": "a", "ɡ": "g",
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭵ": "i", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z",
    "Ꮢ": "R", "Ꮤ": "W", "Ꮥ": "S", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
    "Ⲃ": "B", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "ⲟ": "o", "Ⲣ": "P", "ⲣ": "p", "Ⲥ": "C", "ⲥ": "c", "Ⲧ": "T", "Ⲭ": "X", "ⲭ": "x",
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L",
    "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
}
# Ranges of characters without any look of their own.
INVISIBLE = ((0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F),
             (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xE0000, 0xE007F), (0xE0100, 0xE01EF))
# Blanks that look like the space.
BLANKS = ((0xA0, 0xA0), (0x2000, 0x200A), (0x202F, 0x202F), (0x205F, 0x205F))
#: Ranges of characters that nothing maps and that are no marks: ASCII, ideographs and their stops, letters of Cyrillic.
INERT = r"\x00-\x7F\x{3001}-\x{3029}\x{4E00}-\x{9FFF}\x{0431}-\x{0434}\x{0436}-\x{0438}\x{043A}-\x{043D}\x{0442}\x{0444}\x{0446}-\x{044F}"
ITEM = rf"[{INERT}]+|[\s\S]"


def _within(cp: int, ranges: tuple) -> bool:
    return any(a <= cp <= b for a, b in ranges)


def _letters(ch: str) -> str:
    """The usual form of a width form of a letter or digit, or of joined letters; else the character."""
    kind, _, rest = unicodedata.decomposition(ch).partition(" ")
    if not kind.startswith("<"):
        return ch
    plain = "".join(chr(int(x, 16)) for x in rest.split())
    if kind in ("<wide>", "<narrow>") and unicodedata.category(plain)[0] in "LNM":
        return plain
    joined = 0xFB00 <= ord(ch) <= 0xFB4F or 0x2160 <= ord(ch) <= 0x217F and len(plain) == 1 or ord(ch) in (0x132, 0x133, 0x1C4, 0x1C5, 0x1C6, 0x1C7, 0x1C8, 0x1C9, 0x1CA, 0x1CB, 0x1CC, 0x1F1, 0x1F2, 0x1F3)
    if kind == "<compat>" and joined or kind in ("<initial>", "<medial>", "<final>", "<isolated>"):
        return plain
    return ch


@lru_cache(maxsize=1)
def folding() -> dict[int, str]:
    """Code point -> decomposed replacement, for every code point that changes."""
    table: dict[int, str] = {}
    for cp in range(0x80, 0x110000):
        if 0xD800 <= cp <= 0xDFFF or 0x20000 <= cp < 0x2F800 or 0x30000 <= cp < 0xE0000 or cp >= 0xE0200:
            continue
        ch = chr(cp)
        if _within(cp, INVISIBLE):
            table[cp] = ""
        elif _within(cp, BLANKS):
            table[cp] = " "
        else:
            plain = unicodedata.normalize("NFD", _letters(ch))
            plain = "".join(LOOK_ALIKES.get(x, x) for x in plain)
            if plain != ch:
                table[cp] = plain
    return table


def fold_text(text: str) -> str:
    """The same form for one text in Python, for operators that already hold the text there."""
    if text.isascii():
        return text
    return unicodedata.normalize("NFC", text.translate(folding()))


def _composites() -> dict[str, dict[str, str]]:
    """Starter -> {ordered marks: composed character}."""
    out: dict[str, dict[str, str]] = {}
    for cp in [*range(0xC0, 0x3400), *range(0xAC00, 0xD7A4), *range(0x11080, 0x11940)]:
        ch = chr(cp)
        parts = unicodedata.normalize("NFD", ch)
        if len(parts) > 1 and unicodedata.normalize("NFC", parts) == ch:
            out.setdefault(parts[0], {})[parts[1:]] = ch
    return out


def _ranges(points: list[int]) -> str:
    """A character class of these code points."""
    out: list[list[int]] = []
    for cp in points:
        if out and cp == out[-1][1] + 1:
            out[-1][1] = cp
        else:
            out.append([cp, cp])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in out) + "]"


def _mark_class() -> str:
    return _ranges([cp for cp in range(0x300, 0x20000) if unicodedata.combining(chr(cp))])


@lru_cache(maxsize=1)
def sequence_pattern() -> str:
    """A combining sequence: Hangul letters of one syllable, or a character with what is ordered and composed after it, or marks that begin a text."""
    marks = _mark_class()
    joiners = _ranges(sorted({ord(k[0]) for tails in _composites().values() for k in tails if not unicodedata.combining(k[0]) and not 0x1100 <= ord(k[0]) < 0x1200}))
    # the general category is a cheap test, the class of some 200 ranges is not: it is asked for marks only
    mark, joiner = rf"(?=\p{{M}}){marks}", rf"(?=\p{{M}}){joiners}"
    hangul = rf"[\x{{1100}}-\x{{1112}}][\x{{1161}}-\x{{1175}}][\x{{11a8}}-\x{{11c2}}]?(?:{mark})*"
    return rf"{hangul}|(?:[^\p{{M}}]|\p{{M}}(?<!{marks}))(?:{joiner}(?:{mark})*|(?:{mark})+)|\A(?:{mark})+"


def _mapping(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(chr(cp), to) for cp, to in folding().items()], "item string, plain string")


def _classes(spark: SparkSession) -> DataFrame:
    marks = [(chr(cp), unicodedata.combining(chr(cp))) for cp in [*range(0x300, 0x20000), *range(0xE0100, 0xE01F0)] if unicodedata.combining(chr(cp))]
    return spark.createDataFrame(marks, "mark string, class int")


def _starters(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, v) for k, v in _composites().items()], "starter string, composites map<string,string>")


def _compose(ordered: Column, starter: Column, composites: Column) -> Column:
    """A starter with its ordered marks (struct class, mark), recomposed; a mark after one of its own class is blocked."""
    begin = F.struct(F.lit("").alias("taken"), F.lit("").alias("rest"), F.lit(-1).alias("last"))

    def add(acc: Column, x: Column) -> Column:
        wanted = F.concat(acc["taken"], x["mark"])
        free = (acc["last"] < x["class"]) & F.coalesce(F.map_contains_key(composites, wanted), F.lit(False))
        return F.struct(F.when(free, wanted).otherwise(acc["taken"]).alias("taken"),
                        F.when(free, acc["rest"]).otherwise(F.concat(acc["rest"], x["mark"])).alias("rest"),
                        F.when(free, acc["last"]).otherwise(x["class"]).alias("last"))

    def finish(acc: Column) -> Column:
        return F.concat(F.coalesce(F.try_element_at(composites, acc["taken"]), F.concat(starter, acc["taken"])), acc["rest"])

    return F.aggregate(ordered, begin, add, finish)


def unified(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, form) of every row; ``key`` must be unique. A null text has a null form.

    An empty text has the empty form, as has one of invisible characters only. Other columns are ignored. Only texts
    with other than ASCII characters are shuffled, once, by their key; all later steps keep that partitioning.
    """
    rows = texts.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))
    other = F.coalesce(F.col("t").rlike(r"[^\x00-\x7F]"), F.lit(False))
    return rows.filter(~other).select("k", F.col("t").alias("form")).unionByName(_mapped(rows.filter(other))).withColumnRenamed("k", key)


def _mapped(rows: DataFrame) -> DataFrame:
    """(k, form) of (k, t) by exploding, mapping, ordering and composing."""
    spark = rows.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # named, as AQE would join tasks by their bytes, which are few for the work
    items = rows.repartition(tasks, "k").select("k", F.posexplode(F.concat(F.regexp_extract_all("t", F.lit(ITEM), F.lit(0)), F.array(F.lit("")))).alias("pos", "item"))
    plain = F.coalesce("plain", "item")
    mapped = items.join(F.broadcast(_mapping(spark)), "item", "left").groupBy("k").agg(
        F.array_sort(F.collect_list(F.struct("pos", plain.alias("p")))).alias("parts"))
    decomposed = mapped.select("k", F.array_join(F.col("parts.p"), "").alias("t"))
    # each row holds a sequence and the text before it, so that what is exploded stays in proportion to the text
    # (by groups of one pattern: a split would compile the pattern anew for every row)
    both = F.lit(rf"([\s\S]*?)({sequence_pattern()}|\z)")
    whole = F.arrays_zip(F.array("t").alias("before"), F.array(F.lit("")).alias("seq"))
    cut_up = F.arrays_zip(F.regexp_extract_all("t", both, F.lit(1)).alias("before"), F.regexp_extract_all("t", both, F.lit(2)).alias("seq"))
    parts = F.when(F.col("t").rlike(r"[\p{M}\x{1100}-\x{11FF}]"), cut_up).otherwise(whole)
    sequences = decomposed.select("k", F.posexplode(parts).alias("i", "x")).select("k", "i", F.col("x.before").alias("before"), F.col("x.seq").alias("seq"))
    bare = F.col("seq").rlike("^" + _mark_class())
    marks = sequences.select("k", "i", "before", F.when(bare, "").otherwise(F.substring("seq", 1, 1)).alias("starter"),
                             F.posexplode_outer(F.split(F.when(bare, F.col("seq")).otherwise(F.expr("substring(seq, 2)")), "")).alias("j", "mark"))
    ordered = marks.join(F.broadcast(_classes(spark)), "mark", "left").groupBy("k", "i").agg(
        F.first("before").alias("before"), F.first("starter").alias("starter"),
        F.array_sort(F.collect_list(F.struct(F.coalesce("class", F.lit(0)).alias("class"), "j", "mark"))).alias("marks"))
    composed = ordered.join(F.broadcast(_starters(spark)), "starter", "left").select(
        "k", "i", F.concat("before", F.when(F.col("starter").isNull(), "").otherwise(_compose(F.col("marks"), F.col("starter"), F.col("composites")))).alias("c"))
    rebuilt = composed.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("i", "c"))).alias("cs"))
    return rebuilt.select("k", F.array_join(F.col("cs.c"), "").alias("form"))


#: Rows of one text, or texts of one form, that a task takes at most before they are spread over several.
SPREAD = 10_000


def _keyed(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(k, string, form) as hashes, of rows with a text. An ASCII text is its own form; only others go through the mapping."""
    rows = texts.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).filter(F.length("t") > 0)
    other = F.col("t").rlike(r"[^\x00-\x7F]")
    plain = rows.filter(~other).select("k", F.md5("t").alias("string")).withColumn("form", F.col("string"))
    forms = _mapped(rows.filter(other)).select("k", F.md5("form").alias("form"))
    return plain.unionByName(rows.filter(other).select("k", F.md5("t").alias("string")).join(forms, "k"))


def _members(keyed: DataFrame, hot_rows: int) -> tuple[DataFrame, DataFrame]:
    """(string, form, copies, strings, rows) of the texts whose form another text has as well, and (k, ...) of their rows."""
    strings = keyed.groupBy("string").agg(F.first("form").alias("form"), F.count(F.lit(1)).alias("copies"))
    shared = cut(strings.groupBy("form").agg(F.count(F.lit(1)).alias("strings"), F.sum("copies").alias("rows")).filter("strings > 1"))
    alike = cut(with_facts(strings, shared, "form", "strings", hot_rows))
    return alike, with_facts(keyed.select("k", "string"), alike, "string", "copies", hot_rows)


def look_classes(texts: DataFrame, key: str = "doc_id", text: str = "text", hot_rows: int = HOT_ROWS) -> DataFrame:
    """(key, look, links) of every row with a text: the class of its form, and how many rows look the same but differ as strings.

    Linear in the rows whatever the sizes of classes: counts are aggregated by text, then by form.
    """
    keyed = cut(_keyed(texts, key, text))
    _, members = _members(keyed, hot_rows)
    linked = cut(members.select("k", "form", (F.col("rows") - F.col("copies")).alias("links")))
    alone = keyed.join(linked.select("k"), "k", "left_anti").select("k", "form", F.lit(0).cast("bigint").alias("links"))
    return linked.unionByName(alone).select(F.col("k").alias(key), F.col("form").alias("look"), "links")


def same_look(texts: DataFrame, key: str = "doc_id", text: str = "text", hot_rows: int = HOT_ROWS, spread: int = SPREAD) -> DataFrame:
    """All pairs (key_a < key_b) of rows whose texts differ as strings but have one form; null and empty texts are in none.

    Only forms that more than one string has matter; any number of exact copies of one text is thus left aside. Strings of
    a form are paired as classes, each standing once, and only then expanded to their rows, so the work stays in proportion
    to the pairs. These are the result and are never capped. The strings of a popular form and the rows of a popular string
    are spread over tasks in groups of at most ``spread``, which the other side meets in all of them.
    """
    keyed = cut(_keyed(texts, key, text))
    alike, members = _members(keyed, hot_rows)
    members = cut(members)

    def groups(size: Column) -> Column:
        return F.ceil(size / spread).cast("int")

    def group(value: Column, size: Column) -> Column:
        return F.pmod(F.xxhash64(value), groups(size)).cast("int")

    def all_groups(size: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), groups(size) - 1))

    a = alike.select("form", F.col("string").alias("string_a"), F.col("copies").alias("copies_a"), group(F.col("string"), F.col("strings")).alias("g"))
    b = alike.select("form", F.col("string").alias("string_b"), F.col("copies").alias("copies_b"), all_groups(F.col("strings")).alias("g"))
    pairs = a.join(b, ["form", "g"]).filter("string_a < string_b").drop("form", "g")
    rows = members.select("k", "string", group(F.col("k"), F.col("copies")).alias("g"))
    left = pairs.withColumn("g", all_groups(F.col("copies_a"))).join(rows.withColumnsRenamed({"string": "string_a", "k": "ka"}), ["string_a", "g"])
    both = left.select("ka", "string_b", "copies_b").withColumn("g", all_groups(F.col("copies_b"))).join(rows.withColumnsRenamed({"string": "string_b", "k": "kb"}), ["string_b", "g"])
    return both.select(F.least("ka", "kb").alias(f"{key}_a"), F.greatest("ka", "kb").alias(f"{key}_b"))
