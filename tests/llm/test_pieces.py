import random

from pyspark.sql import functions as F

from chunkloom.llm import pieces


def check(data, most, overlap, made):
    assert made[0][0] == 0 and made[-1][1] == len(data)
    for (a, b), (x, y) in zip(made, made[1:]):
        assert a < x <= b < y and b - x <= overlap
    for a, b in made:
        assert 0 < b - a <= most
        data[a:b].decode()


def random_text(rng, n):
    return "".join(rng.choice(["a", "é", "版", "\n", " ", "🙂", ". ", "word ", "\n\n", "x" * rng.randint(1, 40)]) for _ in range(n)).encode()


def test_limits_overlap_and_characters():
    rng = random.Random(1)
    for _ in range(600):
        data, most, overlap = random_text(rng, rng.randint(1, 400)), rng.randint(16, 300), rng.randint(0, 60)
        check(data, most, overlap, pieces.cuts(data, most, overlap))
    for data in (b"x" * 50_000, "版".encode() * 9_000, b"\n" * 9_000):
        check(data, 1_500, 200, pieces.cuts(data, 1_500, 200))
    assert pieces.cuts(b"", 10, 2) == [] and pieces.cuts(b"abc", 10, 2) == [(0, 3)]


def test_cuts_fall_on_boundaries_and_edits_stay_local():
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "kappa"]
    text = "".join(" ".join(rng.choices(words, k=rng.randint(4, 14))).capitalize() + "." + rng.choice([" ", " ", "\n", "\n\n"]) for _ in range(900)).encode()
    made = pieces.cuts(text, 1_500, 200)
    check(text, 1_500, 200, made)
    assert all(text[b - 1:b].isspace() for _, b in made[:-1])
    at = len(text) // 2
    edited = text[:at] + b" edited " + text[at:]
    a, b = {text[x:y] for x, y in made}, {edited[x:y] for x, y in pieces.cuts(edited, 1_500, 200)}
    assert len(a - b) <= 4


def test_entity_lines():
    lines = pieces._lines("a\nb\nc\n")
    assert lines == ["a", "b", "c"] and pieces.entity_text(lines, 0, 2) == "a\nb" and pieces.entity_text(lines, 2, 99) == "b\nc" and pieces.entity_text(lines, 5, 9) == "" and pieces.entity_text(lines, 3, 1) == ""


def test_rows(spark):
    items = spark.createDataFrame([("i", "x" * 6_001, 1), ("i", "x" * 6_001, 1), ("j", "y" * 6_000, 1), ("k", "", 1), ("u", "é" * 3_001, 2)], "id string, content string, pos int")
    chunks = spark.createDataFrame([("c", "a b " * 600, 600), ("d", "a b " * 600, 512), ("e", "ab", 900), ("f", "a b " * 600, None), ("g", None, 700)], "id string, content string, token_count int")
    events = spark.createDataFrame(
        [(1, "l\n" * 900, [{"start_line": 1, "end_line": 900}, {"start_line": None, "end_line": 3}, None, {"start_line": 2, "end_line": 752}, {"start_line": -5, "end_line": 2_000}, {"start_line": 9, "end_line": 3}]),
         (2, None, [{"start_line": 1, "end_line": 900}]), (3, "z" * 2_000, None), (4, "z" * 1_501, [{"start_line": 1, "end_line": 1}])],
        "delivery_id bigint, normalized_content string, entities array<struct<start_line:int,end_line:int>>")
    made = pieces.oversized_pieces(items, events, chunks)
    found = {(r.record_kind, r.record_key, r.pos) for r in made.collect()}
    assert found == {("item", "i", 0), ("item", "u", 0), ("chunk", "c", 0), ("entity", "1", 0), ("entity", "1", 3), ("entity", "1", 4), ("entity", "4", 0)} - {("entity", "1", 3)} | ({("entity", "1", 3)} if 751 * 2 - 1 > 1_500 else set())
    rows = [r for r in made.collect() if r.record_kind == "chunk"]
    assert all((r.end_byte - r.start_byte) * 600 <= 512 * 2_400 for r in rows)
    none = [x.filter("false") for x in (items, events, chunks)]
    assert pieces.oversized_pieces(*none).count() == 0 and {r.text for r in pieces.oversized_pieces(items, events, chunks, with_text=False).collect()} == {None}
