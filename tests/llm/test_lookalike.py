import random
import unicodedata

from pyspark.sql import functions as F

from chunkloom.llm import lookalike


def form(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id bigint, text string, k int, form int")
    return {r.doc_id: r.form for r in lookalike.unified(df).collect()}


def test_unified_equals_python(spark):
    rng = random.Random(7)
    pool = [chr(c) for c in [*range(0x20, 0x250), *range(0x300, 0x345), *range(0x370, 0x460), *range(0x1100, 0x1200), *range(0xAC00, 0xAC40), *range(0xFF00, 0xFFE0), *range(0x2000, 0x2070),
                             *range(0x1E00, 0x1F00), *range(0xFB00, 0xFB07), 0x1F642, 0x1D6FC, 0x903, 0x9C7, 0x9BE]]
    rows = [(i, "".join(rng.choices(pool, k=rng.randint(0, 30))), 1, 2) for i in range(1500)]
    rows += [(2000, "", 1, 2), (2001, "​", 1, 2), (2002, None, 1, 2), (2003, "é" * 20_000 + "ậ한글" * 3_000, 1, 2)]
    got = form(spark, rows)
    assert got == {i: t if t is None else lookalike.fold_text(t) for i, t, *_ in rows}
    assert form(spark, []) == {}


def test_what_looks_the_same_and_what_does_not(spark):
    same = ["café files Ab1", "cafe\u0301 files Ab1", "ｃａｆé\u00a0ﬁles Аb１", "caf\u00ade\u0301\u200b\u202ffiles\ufeff Ab1"]
    other = ["cafe files Ab1", "Café files Ab1", "café files Ab²", "café “files” Ab1", "café—files Ab1", "café,files Ab1", "café，files Ab1"]
    got = form(spark, [(i, t, 1, 1) for i, t in enumerate(same + other)])
    assert len({got[i] for i in range(len(same))}) == 1
    assert len({got[i] for i in range(len(same), len(same + other))} | {got[0]}) == len(other) + 1
    assert all(unicodedata.is_normalized("NFC", v) for v in got.values())


def test_pairs(spark):
    texts = ["a b", "a b", "a\u00a0b", "а b", "x", "x", None, "", "", "ﬁ", "fi", "FI"]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id bigint, text string, form string").repartition(3)
    got = {(r.doc_id_a, r.doc_id_b) for r in lookalike.same_look(df).collect()}
    assert got == {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if texts[i] and texts[j] and texts[i] != texts[j] and lookalike.fold_text(texts[i]) == lookalike.fold_text(texts[j])}
    assert len(got) == 6 and lookalike.same_look(df.filter("false")).count() == 0


def test_many_copies_of_one_text_cost_nothing(spark):
    """30,000 copies of one string beside three other strings of its form: the pairs are linear, and so is the work."""
    rows = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"))
    rows = rows.unionByName(spark.createDataFrame([(40_000 + i, t) for i, t in enumerate(["a\u00a0b", "\u0430 b", "a\u200b b", "other"])], "doc_id bigint, text string"))
    assert lookalike.same_look(rows).count() == 3 * 30_000 + 3


def test_groups_of_hot_texts_and_forms(spark):
    texts = ["a b"] * 7 + ["a\u00a0b"] * 5 + ["a\u200b b", "\u0430 b", "\u0430\u00a0b", "other", "", None, "plain", "plain"]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id bigint, text string, form string").repartition(3)
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if texts[i] and texts[j] and texts[i] != texts[j] and lookalike.fold_text(texts[i]) == lookalike.fold_text(texts[j])}
    got = [(r.doc_id_a, r.doc_id_b) for r in lookalike.same_look(df, hot_rows=2, spread=2).collect()]
    assert len(got) == len(want) and set(got) == want
    for hot_rows in (2, 10**6):
        classes = {r.doc_id: (r.look, r.links) for r in lookalike.look_classes(df, hot_rows=hot_rows).collect()}
        assert {i: n for i, (_, n) in classes.items()} == {i: sum(i in p for p in want) for i, t in enumerate(texts) if t}
        assert all((classes[i][0] == classes[j][0]) == (lookalike.fold_text(texts[i]) == lookalike.fold_text(texts[j])) for i in classes for j in classes)


def test_inert_runs_are_inert():
    import re

    inert = re.compile("[" + re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), lookalike.INERT) + "]")
    assert not any(inert.match(chr(cp)) for cp in lookalike.folding())
    assert not any(inert.match(chr(cp)) for cp in range(0x20000) if unicodedata.category(chr(cp))[0] == "M" and chr(cp) > "\u302f")


def test_look_alikes_of_more_scripts():
    assert lookalike.fold_text("ɑɡⅼꭺᎪⲟꓐ".replace("ꭺ", "")) == "aglAoB" and lookalike.fold_text("𝐀²") == "𝐀²"
