import itertools
import random
from datetime import datetime, timezone

from chunkloom.operators.instants import BACKWARD, OFF_RULE, SWITCH, interpretations, normalised, step, undominated, viterbi


def us(*parts, micro=0):
    return int(datetime(*parts, tzinfo=timezone.utc).timestamp()) * 1_000_000 + micro


def best(text, zone="Etc/UTC", order="ymd"):
    found = undominated(interpretations(text, zone, order))
    assert len({x[1] for x in found}) <= 1, found
    return found[0][1] if found else None


def test_forms():
    assert best("2024-01-31T09:05:07.000250Z") == us(2024, 1, 31, 9, 5, 7, micro=250)
    assert best("2024-08-16t23:48:05z") == us(2024, 8, 16, 23, 48, 5)
    assert best("2023-07-09T10:00:00.123456789+02:00") == us(2023, 7, 9, 8, 0, 0, micro=123456)
    assert best("20240609T013501Z") == us(2024, 6, 9, 1, 35, 1)
    assert best(" 2024-01-08 16:25:00,437\n", "Asia/Tokyo") == us(2024, 1, 8, 7, 25, 0, micro=437000)
    assert best("2025-11-08T07:04:42-08:00[America/Los_Angeles]") == us(2025, 11, 8, 15, 4, 42)
    assert best("Thu, 20 Jul 2023 12:42:17 +0200") == us(2023, 7, 20, 10, 42, 17)
    assert best("Tue Sep 16 2025 08:30:28 GMT-0700 (PDT)") == us(2025, 9, 16, 15, 30, 28)
    assert best("Thu Jan  2 04:17:30 PST 2025", "America/Los_Angeles") == us(2025, 1, 2, 12, 17, 30)
    assert best("2024-05-09 22:13:14 IST", "Asia/Kolkata") == us(2024, 5, 9, 16, 43, 14)
    assert best("Mar 18, 2024 2:06 AM", "America/New_York") == us(2024, 3, 18, 6, 6)
    assert best("2025/07/19 12:37:56 AM") == us(2025, 7, 19, 0, 37, 56)
    assert best("2023-10-10 05:55") == us(2023, 10, 10, 5, 55)


def test_numeric_order_and_units():
    assert best("03/09/2025 01:36:28", "Etc/UTC", "dmy") == us(2025, 9, 3, 1, 36, 28)
    assert best("03/09/2025 01:36:28", "Etc/UTC", "mdy") == us(2025, 3, 9, 1, 36, 28)
    assert best("16.03.2024 19:12:11", "Etc/UTC", "dmy") == us(2024, 3, 16, 19, 12, 11)
    for text in ("1704441906", "1704441906000", "1704441906000000", "1704441906000000000"):
        assert best(text) == us(2024, 1, 5, 8, 5, 6)
    assert best("1734043212.2530009") == us(2024, 12, 12, 22, 40, 12, micro=253000)
    assert best("123456789012") is None and best("1") is None


def test_nothing_meant():
    for text in (None, "", " ", "null", "n/a", "-", "pending", "0000-00-00 00:00:00", "2023-02-30", "2024-13-01 00:00:00", "2024-01-01 25:00:00", "13:00 PM", "x" * 100_000):
        assert best(text) is None


def test_repeated_and_skipped_wall_times():
    assert best("2023-11-05 01:30:00", "America/New_York") == us(2023, 11, 5, 5, 30)  # the earlier one
    assert best("2023-03-12 02:30:00", "America/New_York") == us(2023, 3, 12, 7, 30)  # moved on by the gap
    costs = {c for _, _, c in interpretations("2023-11-05 01:30:00", "America/New_York", "mdy")}
    assert costs == {0.0, OFF_RULE}


def test_viterbi_is_optimal():
    rng = random.Random(4)
    for _ in range(200):
        records = [[(rng.choice("ab"), rng.randrange(10) * 3_600_000_000, float(rng.randrange(3))) for _ in range(rng.randint(1, 3))] for _ in range(rng.randint(1, 5))]

        def cost(path):
            picked = [r[i] for r, i in zip(records, path)]
            return sum(x[2] for x in picked) + sum(step(a, b) for a, b in zip(picked, picked[1:]))

        least = min(map(cost, itertools.product(*[range(len(r)) for r in records])))
        assert abs(cost(viterbi(records)) - least) < 1e-9
    assert viterbi([]) == []
    assert step(("a", 0, 0.0), ("b", 1, 0.0)) == SWITCH and step(("a", 10**15, 0.0), ("a", 0, 0.0)) < BACKWARD


def test_walk_resolves_unknown_order(spark):
    """Without a known order the sequence decides: 05/04 must be April the fifth between two days of April."""
    rows = [("s", 0, i, f"k{i}", t, "Etc/UTC", None, 1) for i, t in enumerate(["13/04/2024 10:00:00", "05/05/2024 10:00:00", "06/05/2024 10:00:00", "20/05/2024 10:00:00"])]
    rows += [("s", 0, 9, "none", None, None, None, 2), ("s", 0, 10, "bad", "never", "no/zone", "xyz", 2), (None, None, None, "lone", "1704441906", None, None, 3)]
    df = spark.createDataFrame(rows, "source string, block bigint, place bigint, key string, text string, zone string, date_order string, candidates int").repartition(3)
    got = {r.key: r.utc_us for r in normalised(df).collect()}
    assert got == {"k0": us(2024, 4, 13, 10), "k1": us(2024, 5, 5, 10), "k2": us(2024, 5, 6, 10), "k3": us(2024, 5, 20, 10), "lone": us(2024, 1, 5, 8, 5, 6)}
    assert normalised(df.filter("false")).count() == 0


def test_long_open_runs_cross_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [("s", 0, i, str(i), f"0{1 + i % 9}/0{1 + i % 7}/2024 00:00:00", "Etc/UTC", None) for i in range(100)]
        df = spark.createDataFrame(rows, "source string, block bigint, place bigint, key string, text string, zone string, date_order string")
        got = {int(r.key): r.utc_us for r in normalised(df).collect()}
        found = [interpretations(r[4], "Etc/UTC", None) for r in rows]
        assert got == {i: f[p][1] for i, (f, p) in enumerate(zip(found, viterbi(found)))}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_blocks_change_nothing(spark):
    """Open runs over several blocks, decided records at and beside their ends, a source without any, blocks of one record."""
    rng = random.Random(6)
    rows = []
    for source in range(12):
        for i in range(40):
            day, month = rng.randint(1, 12), rng.randint(1, 12)
            text = f"{day:02}/{month:02}/2024 00:00:00" if rng.random() < 0.8 or source == 0 else f"2024-{month:02}-{day:02}"
            rows.append((f"s{source}", i, f"{source}:{i}", text))
    for size in (1000, 7, 1):
        df = spark.createDataFrame([(s, i // size, i, k, t, "Etc/UTC", None) for s, i, k, t in rows], "source string, block bigint, place bigint, key string, text string, zone string, date_order string")
        got = {r.key: r.utc_us for r in normalised(df).collect()}
        assert len(got) == len(rows)
        for source in range(12):
            own = [r for r in rows if r[0] == f"s{source}"]
            found = [interpretations(t, "Etc/UTC", None) for *_, t in own]

            def cost(picks):
                return sum(x[2] for x in picks) + sum(step(a, b) for a, b in zip(picks, picks[1:]))

            best = cost([f[p] for f, p in zip(found, viterbi(found))])
            taken = [[x for x in f if x[1] == got[k]] for f, (_, _, k, _) in zip(found, own)]
            assert all(taken) and abs(cost([f[p] for f, p in zip(taken, viterbi(taken))]) - best) < 1e-9
