import random
import uuid

from pyspark.sql import functions as F

from chunkloom.operators import once

SCHEMA = "delivery_id bigint, event_id string, `__key` string, k int"


def brute(rows):
    first, found = {}, set()
    for d, e, *_ in sorted(rows):
        text = (e or "").strip()
        if not text:
            continue
        try:
            key = uuid.UUID(text.lower()).hex
        except ValueError:
            key = text
        if key in first:
            found.add(d)
        else:
            first[key] = d
    return found


def written(u, rng):
    s = str(u)
    return rng.choice([s, s.upper(), s.replace("-", ""), "{" + s + "}", f"urn:uuid:{s}", f" {s}\n", f"URN:UUID:{s.upper()}"])


def rows_of(seed, n=400):
    rng = random.Random(seed)
    known = [uuid.UUID(int=rng.getrandbits(128)) for _ in range(60)]
    hot = known[0]
    ids = [hot if rng.random() < 0.33 else rng.choice(known) for _ in range(n)]
    rows = [(i, written(u, rng), "x", 1) for i, u in enumerate(ids)]
    return rows + [(n, None, None, None), (n + 1, "", None, 2), (n + 2, "  \t", None, 2), (n + 3, "no uuid", None, 2), (n + 4, " no uuid", None, 2), (n + 5, "NO UUID", None, 2)]


def test_later_copies_against_brute_force(spark):
    for few in (3, 10**6):
        rows = rows_of(1)
        df = spark.createDataFrame(rows, SCHEMA).repartition(5)
        got = once.later_copies(df, once.uuid_key(F.col("event_id")), [F.col("delivery_id")], few, 20)
        assert got.columns == ["delivery_id", "event_id", "__key", "k"]
        assert {r.delivery_id for r in got.collect()} == brute(rows)


def test_once_keeps_one_of_each(spark):
    rows = rows_of(2)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for few in (3, 10**6):
        kept = {r.delivery_id for r in once.once(df, once.uuid_key(F.col("event_id")), [F.col("delivery_id")], few=few).collect()}
        assert kept == {r[0] for r in rows} - brute(rows)


def test_stored_messages_win(spark):
    rows = rows_of(3)
    df = spark.createDataFrame(rows, SCHEMA)
    stored, new = df.filter("delivery_id >= 200"), df.filter("delivery_id < 200")
    added = {r.delivery_id for r in once.once(new, once.uuid_key(F.col("event_id")), [F.col("delivery_id")], stored=stored).collect()}
    old = [r for r in rows if r[0] >= 200]
    shifted = [(r[0] + 10_000, *r[1:]) for r in rows if r[0] < 200]
    assert added == {r[0] - 10_000 for r in shifted} - {d - 10_000 for d in brute(old + shifted) if d >= 10_000}


def test_ties_and_empty_table(spark):
    same = spark.createDataFrame([(1, str(uuid.UUID(int=7)), "a", 1)] * 5, SCHEMA)
    key = once.uuid_key(F.col("event_id"))
    assert once.once(same, key, [F.col("delivery_id")]).count() == 1
    assert once.later_copies(same, key, [F.col("delivery_id")]).count() == 0
    none = spark.createDataFrame([], SCHEMA)
    assert once.once(none, key, [F.col("delivery_id")]).count() == 0
    assert once.once(none, key, [F.col("delivery_id")], stored=same).count() == 0


def test_whole_rows_stay_in_place(spark, tmp_path):
    rows = [(d, e, "payload" * 20, k) for d, e, _, k in rows_of(4)]
    path = str(tmp_path / "messages")
    spark.createDataFrame(rows, SCHEMA).withColumnRenamed("__key", "body").repartition(4).write.parquet(path)
    kept = once.once(spark.read.parquet(path), once.uuid_key(F.col("event_id")), [F.col("delivery_id")])
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan and plan.count("FileScan") == 1 and "body" in plan
    assert {r.delivery_id for r in kept.collect()} == {r[0] for r in rows} - brute(rows)


def test_rows_equal_in_key_and_order_give_one(spark):
    u, v = str(uuid.UUID(int=7)), str(uuid.UUID(int=8))
    rows = [(1, u, "a", 1)] * 5 + [(2, u, "b", 1), (3, v, "c", 1), (4, None, "d", 1), (4, None, "d", 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for few in (0, 10):
        assert sorted(r.delivery_id for r in once.once(df, once.uuid_key(F.col("event_id")), [F.col("delivery_id")], few=few).collect()) == [1, 3, 4, 4]
        stored = spark.createDataFrame([(9, u, "z", 1)], SCHEMA)
        assert sorted(r.delivery_id for r in once.once(df, once.uuid_key(F.col("event_id")), [F.col("delivery_id")], stored=stored, few=few).collect()) == [3, 4, 4]
