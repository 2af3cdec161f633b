"""Mixed timestamp forms brought to one instant.

Every value yields an array of all its valid interpretations (form, instant, cost). The cost is 0 for what the account's
settings say (zone, order of numeric dates, the earlier of a repeated wall time) and ``OFF_RULE`` else. Among what
remains, a Viterbi walk over each source's records in their order chooses the cheapest path: changing the form costs
``SWITCH``, going back in time up to ``BACKWARD``. A candidate that is dearer than another of its value by more than two
full transitions can't lie on a cheapest path and is dropped; records left with one candidate split the path exactly.

A source's records lie in blocks, so that a hot source is spread over tasks, and the walk is exact over the whole source all
the same: every block is first summed up as the cheapest cost from each candidate of its first record to each of its last
one (products of these tables are associative); a walk over the blocks' tables then chooses the candidates at the ends of
every block, and between these the records are walked block by block. What lies between two decided records of a block is
walked at once; only the ends of blocks take these further steps, and only if an open record stands at one. Only the open
records between two decided ones are held.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkloom.storage import cut

OFF_RULE, SWITCH, BACKWARD = 1000.0, 1.0, 4.0
CANONICAL = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{6}Z$"
BARE_FROM, BARE_TO = 1_640_995_200_000_000, 1_798_761_600_000_000  # 2022 up to 2027, in microseconds
UNITS = {"s": 1_000_000, "ms": 1_000, "us": 1, "ns": 0}
MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}
FEW_BLOCKS = 100_000  # the ends of so many blocks are broadcast, some 20 MB; more are joined by shuffling
EPOCH = datetime(1970, 1, 1)
CANDIDATES = "array<struct<form:string,utc_us:bigint,cost:double>>"

_TIME = r"(?P<h>\d{1,2}):(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d+))?)?(?:\s*(?P<ap>[AaPp])\.?[Mm]\.?)?"
_ZONE = r"(?:\s*(?P<z>[Zz]|(?:UTC|GMT)?[+-]\d{2}:?\d{2}|(?:UTC|GMT)?[+-]\d{1,2}|[A-Za-z]{2,5}))?(?:\s*\[(?P<iana>[A-Za-z_]+(?:/[A-Za-z_+\-0-9]+)*)\])?(?:\s*\((?P<note>[^()]*)\))?"
_DAY = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+)?"
_MON = r"(?P<mon>jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"
_FORMS = [(name, re.compile(pattern + r"\Z", re.I | re.A)) for name, pattern in (
    ("iso", rf"(?P<y>\d{{4}})-(?P<m>\d{{1,2}})-(?P<d>\d{{1,2}})(?:(?:[Tt]|,?\s+){_TIME}{_ZONE})?"),
    ("compact", r"(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})(?:[Tt ]?(?P<h>\d{2})(?P<mi>\d{2})(?P<s>\d{2})?(?:[.,](?P<f>\d+))?)?" + _ZONE),
    ("numeric", rf"(?P<n1>\d{{1,4}})(?P<sep>[/.\-])(?P<n2>\d{{1,2}})(?P=sep)(?P<n3>\d{{1,4}})(?:(?:[Tt]|,?\s+){_TIME}{_ZONE})?"),
    ("day-month", rf"{_DAY}(?P<d>\d{{1,2}})(?:st|nd|rd|th)?[\s\-]+{_MON}[\s\-,]+(?P<y>\d{{4}})(?:,?\s+{_TIME}{_ZONE})?"),
    ("month-day", rf"{_DAY}{_MON}\s+(?P<d>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?P<y>\d{{4}})(?:,?\s+(?:at\s+)?{_TIME}{_ZONE})?"),
    ("ctime", rf"{_DAY}{_MON}\s+(?P<d>\d{{1,2}})\s+{_TIME}{_ZONE}\s+(?P<y>\d{{4}})"),
)]
_BARE = re.compile(r"(\d{9,20})(?:\.(\d+))?\Z", re.A)
_EXACT = re.compile(r"(\d{4})-(\d\d)-(\d\d)[Tt](\d\d):(\d\d):(\d\d)(?:\.(\d{1,6}))?[Zz]\Z", re.A)
_OFFSET = re.compile(r"(?:UTC|GMT)?([+-])(\d{1,2}):?(\d{2})?\Z", re.I | re.A)
ORDERS = {"mdy": (2, 0, 1), "dmy": (2, 1, 0), "ymd": (0, 1, 2)}


@lru_cache(maxsize=1024)
def _zone(name: str | None) -> ZoneInfo | None:
    try:
        return ZoneInfo(name) if name else None
    except (KeyError, ValueError, OSError):
        return None


@lru_cache(maxsize=1024)
def _abbreviations(name: str | None) -> dict[str, int]:
    """Offsets in minutes by abbreviation, as the zone uses them in 2022-2026."""
    zone, found = _zone(name), {"UTC": 0, "GMT": 0, "Z": 0}
    if zone:
        for month in range(60):
            at = datetime(2022 + month // 12, month % 12 + 1, 15, 12, tzinfo=zone)
            found[at.tzname().upper()] = int(at.utcoffset().total_seconds() // 60)
    return found


def _micros(at: datetime) -> int:
    gone = at - EPOCH
    return (gone.days * 86_400 + gone.seconds) * 1_000_000 + gone.microseconds


def _date(y: int, m: int, d: int) -> datetime | None:
    try:
        return datetime(y, m, d)
    except ValueError:
        return None


def _clock(g: dict) -> timedelta | None:
    """Time of the day; parts not written are zero, digits beyond microseconds are cut."""
    if g.get("h") is None:
        return timedelta(0)
    h, mi, s = int(g["h"]), int(g["mi"]), int(g.get("s") or 0)
    if g.get("ap"):
        if not 1 <= h <= 12:
            return None
        h = h % 12 + (12 if g["ap"] in "pP" else 0)
    us = int((g.get("f") or "0")[:6].ljust(6, "0"))
    if mi > 59 or s > 60 or h > 24 or h == 24 and (mi or s or us):
        return None
    return timedelta(hours=h, minutes=mi, seconds=s, microseconds=us)


def _walls(wall: datetime, zone: ZoneInfo) -> list[tuple[int, bool]]:
    """Instants of a wall time: the earlier one is by rule; a skipped time moves forward by the gap's length."""
    first = wall.replace(tzinfo=zone).utcoffset()
    second = wall.replace(tzinfo=zone, fold=1).utcoffset()
    out = [(_micros(wall - first), True)]
    if second < first:  # repeated; in a gap the second offset is the larger one
        out.append((_micros(wall - second), False))
    return out


def _instants(wall: datetime, g: dict, zone: str | None) -> list[tuple[int, bool]]:
    z = g.get("z")
    if z and z not in "Zz" and (m := _OFFSET.match(z)):
        minutes = (int(m[2]) * 60 + int(m[3] or 0)) * (-1 if m[1] == "-" else 1)
        return [(_micros(wall - timedelta(minutes=minutes)), True)] if abs(minutes) <= 18 * 60 else []
    if z:
        names = _abbreviations(zone)
        return [(_micros(wall - timedelta(minutes=names[z.upper()])), True)] if z.upper() in names else []
    own = _zone(g.get("iana") or zone)
    return _walls(wall, own) if own else [(_micros(wall), True)]


def interpretations(text: str | None, zone: str | None, date_order: str | None) -> list[tuple[str, int, float]]:
    """All (form, microseconds since 1970 in UTC, cost) that ``text`` may mean; none if it denotes no instant.

    Without a known zone a wall time is taken as UTC; without a date order every valid order costs the same.
    """
    if text is None:
        return []
    text = text.strip()
    if m := _EXACT.match(text):
        at = _date(int(m[1]), int(m[2]), int(m[3]))
        clock = _clock({"h": m[4], "mi": m[5], "s": m[6], "f": m[7]})
        return [("iso", _micros(at + clock), 0.0)] if at and clock is not None else []
    out: dict[tuple[str, int], float] = {}
    if m := _BARE.match(text):
        whole, part = int(m[1]), m[2] or ""
        for unit, factor in UNITS.items():
            if factor:
                digits = len(str(factor)) - 1
                us = whole * factor + int(part[:digits].ljust(digits, "0") or 0)
            else:
                us = whole // 1000
            if BARE_FROM <= us < BARE_TO:
                out[unit, us] = 0.0
        if out:
            return [(form, us, cost) for (form, us), cost in out.items()]
    for name, pattern in _FORMS:
        if not (m := pattern.match(text)):
            continue
        g = m.groupdict()
        clock = _clock(g)
        if clock is None:
            continue
        dates: dict[tuple[str, datetime], float] = {}
        if name == "numeric":
            n = (g["n1"], g["n2"], g["n3"])
            for order, (iy, im, id_) in ORDERS.items():
                if len(n[iy]) in (2, 4) and len(n[im]) <= 2 and len(n[id_]) <= 2:
                    year = int(n[iy]) + (2000 if len(n[iy]) == 2 else 0)
                    if at := _date(year, int(n[im]), int(n[id_])):
                        forced = len(n[0]) == 4
                        cost = 0.0 if date_order in (None, order) or forced else OFF_RULE
                        dates[order + g["sep"], at] = cost
        else:
            month = MONTHS[g["mon"].lower()] if g.get("mon") else int(g["m"])
            if at := _date(int(g["y"]), month, int(g["d"])):
                dates[name, at] = 0.0
        for (form, at), cost in dates.items():
            try:
                found = _instants(at + clock, g, zone)
            except OverflowError:
                found = []
            for us, by_rule in found:
                key = form, us
                out[key] = min(out.get(key, 1e9), cost + (0.0 if by_rule else OFF_RULE))
        if out:
            break
    return [(form, us, cost) for (form, us), cost in out.items()]


def undominated(found: list[tuple[str, int, float]]) -> list[tuple[str, int, float]]:
    """Without candidates that no cheapest path can hold, whatever stands beside them."""
    if len(found) < 2:
        return found
    least = min(c for _, _, c in found) + 2 * (SWITCH + BACKWARD)
    return [x for x in found if x[2] <= least]


def step(before: tuple[str, int, float], after: tuple[str, int, float]) -> float:
    """Cost of going from one record's candidate to the next one's; an hour back costs half of ``BACKWARD``."""
    cost = SWITCH if before[0] != after[0] else 0.0
    back = before[1] - after[1]
    return cost + (BACKWARD * back / (back + 3_600_000_000) if back > 0 else 0.0)


def viterbi(records: list[list[tuple[str, int, float]]]) -> list[int]:
    """The place of the chosen candidate of each record; ties go to the earlier candidate."""
    if not records:
        return []
    costs, back = [c for _, _, c in records[0]], []
    for before, after in zip(records, records[1:]):
        links, totals = [], []
        for y in after:
            best = min(range(len(before)), key=lambda i: costs[i] + step(before[i], y))
            links.append(best)
            totals.append(costs[best] + step(before[best], y) + y[2])
        back.append(links)
        costs = totals
    at = min(range(len(costs)), key=costs.__getitem__)
    path = [at]
    for links in reversed(back):
        at = links[at]
        path.append(at)
    return path[::-1]


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, zones, orders = (batch.column(i).to_pylist() for i in (4, 5, 6))
        offsets, forms, instants, costs = [0], [], [], []
        for text, zone, order in zip(texts, zones, orders):
            for form, us, cost in undominated(interpretations(text, zone, order)):
                forms.append(form)
                instants.append(us)
                costs.append(cost)
            offsets.append(len(forms))
        items = pa.StructArray.from_arrays([pa.array(forms, pa.string()), pa.array(instants, pa.int64()), pa.array(costs, pa.float64())], ["form", "utc_us", "cost"])
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items)
        yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(4)], lists], ["source", "block", "place", "key", "candidates"])


Found = list[tuple[str, int, float]]


def _array(records: list[Found | None]) -> pa.Array:
    kind = pa.list_(pa.struct([("form", pa.string()), ("utc_us", pa.int64()), ("cost", pa.float64())]))
    return pa.array([None if r is None else [{"form": f, "utc_us": us, "cost": c} for f, us, c in r] for r in records], kind)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, str, Found, tuple]]:
    """((source, block), key, candidates, further columns) of rows sorted by source, block and place."""
    for batch in batches:
        sources, blocks, names = (batch.column(i).to_pylist() for i in (0, 1, 3))
        more = [batch.column(i).to_pylist() for i in range(5, batch.num_columns)]
        lists = batch.column(4)
        ends, flat = lists.offsets.to_pylist(), lists.values
        forms, instants, costs = (flat.field(i).to_pylist() for i in range(3))
        for i, name in enumerate(names):
            found = [(forms[k], instants[k], costs[k]) for k in range(ends[i], ends[i + 1])]
            yield (sources[i], blocks[i]), name, found, tuple(column[i] for column in more)


def extended(table: list[list[float]], last: Found, found: Found) -> list[list[float]]:
    """The cost table from a first record to ``last``, carried on to the record after it."""
    steps = [[step(x, y) + y[2] for y in found] for x in last]
    return [[min(row[i] + steps[i][j] for i in range(len(last))) for j in range(len(found))] for row in table]


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(source, block, first, last, table) of every block."""
    rows: list[tuple] = []

    def made() -> pa.RecordBatch:
        flat = [[x for line in r[4] for x in line] for r in rows]
        out = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), _array([r[2] for r in rows]),
                                          _array([r[3] for r in rows]), pa.array(flat, pa.list_(pa.float64()))], ["source", "block", "first", "last", "table"])
        rows.clear()
        return out

    run, first, last, table = None, [], [], []
    for at, _, found, _ in _runs(batches):
        if at != run:
            if run is not None:
                rows.append((*run, first, last, table))
                if len(rows) >= 1000:
                    yield made()
            run, first = at, found
            table = [[x[2] if i == k else float("inf") for k in range(len(found))] for i, x in enumerate(found)]
        elif len(found) == 1 == len(last):
            cost = step(last[0], found[0]) + found[0][2]
            for row in table:
                row[0] += cost
        else:
            table = extended(table, last, found)
        last = found
    if run is not None:
        rows.append((*run, first, last, table))
    yield made()


def ends_of_blocks(blocks: list[tuple[Found, Found, list[list[float]]]]) -> list[tuple[int, int]]:
    """The places chosen in each block's first and last record, over the (first, last, table) of a source's blocks in order."""
    costs, back = None, []
    for n, (first, last, table) in enumerate(blocks):
        if costs is None:
            entry, links = [0.0] * len(first), [0] * len(first)
        else:
            before = blocks[n - 1][1]
            links = [min(range(len(before)), key=lambda i: costs[i] + step(before[i], y)) for y in first]
            entry = [costs[i] + step(before[i], y) for i, y in zip(links, first)]
        through = [min(range(len(first)), key=lambda i: entry[i] + table[i][j]) for j in range(len(last))]
        costs = [entry[i] + table[i][j] for j, i in enumerate(through)]
        back.append((links, through))
    out: list[tuple[int, int]] = []
    end = min(range(len(costs)), key=costs.__getitem__) if costs else 0
    for links, through in reversed(back):
        out.append((through[end], end))
        end = links[through[end]]
    return out[::-1]


def _join_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(source, block, first_pick, last_pick) over blocks sorted by source and block."""
    source, names, held = None, [], []

    def made() -> pa.RecordBatch:
        picks = ends_of_blocks(held)
        out = pa.RecordBatch.from_arrays([pa.array([source] * len(names), pa.string()), pa.array(names, pa.int64()), pa.array([a for a, _ in picks], pa.int32()),
                                          pa.array([b for _, b in picks], pa.int32())], ["source", "block", "first_pick", "last_pick"])
        return out

    for batch in batches:
        for row in batch.to_pylist():
            if row["source"] != source and names:
                if len(names) > 1:  # a lone block has no neighbours to agree with
                    yield made()
                names.clear()
                held.clear()
            source = row["source"]
            first, last = ([(x["form"], x["utc_us"], x["cost"]) for x in row[c]] for c in ("first", "last"))
            table = [row["table"][i:i + len(last)] for i in range(0, len(row["table"]), len(last))]
            names.append(row["block"])
            held.append((first, last, table))
    if len(names) > 1:
        yield made()


def _inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Decides what lies between the first and the last decided record of every block, over rows sorted by source, block and place.

    Gives (source, block, place, key, utc_us, candidates): records that are decided have utc_us; the ends of a block, that
    is its open records before the first and after the last decided one and these two, have candidates.
    """
    made: list[tuple] = []
    open_: list[tuple[int, str, Found]] = []
    run, last, first = None, None, True  # last: (place, key, candidates) of the last decided record, without a place if it was given already

    def batch_out() -> pa.RecordBatch:
        columns = list(zip(*made)) or [()] * 6
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64())
        out = pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds)), _array(columns[5])], ["source", "block", "place", "key", "utc_us", "candidates"])
        made.clear()
        return out

    def finish() -> None:
        if last and last[0] is not None:
            made.append((*run, last[0], last[1], last[2][0][1], last[2]))
        made.extend((*run, place, key, None, found) for place, key, found in open_)

    for at, name, found, (place,) in _runs(batches):
        if at != run:
            finish()
            open_.clear()
            run, last, first = at, None, True
        if len(found) > 1:
            open_.append((place, name, found))
            continue
        if first:  # the block's first decided record, with the open ones before it
            made.extend((*run, p, k, None, f) for p, k, f in open_)
            made.append((*run, place, name, found[0][1], found))
        else:
            for (p, k, f), pick in zip(open_, viterbi([last[2], *(f for _, _, f in open_), found])[1:] if open_ else ()):
                made.append((*run, p, k, f[pick][1], None))
            if last[0] is not None:
                made.append((*run, last[0], last[1], last[2][0][1], None))
        open_.clear()
        last, first = (None if first else place, name, found), False
        if len(made) >= 10_000:
            yield batch_out()
    finish()
    yield batch_out()


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, utc_us) of the open records, over the ends of blocks sorted by source, block and place, with the picks at a block's ends where it has neighbours."""
    keys, out = [], []
    block: list[tuple[str, Found, bool]] = []
    run, end_pick = None, None

    def finish() -> None:
        if not block:
            return
        key, found, is_open = block[-1]
        if end_pick is not None and len(found) > 1:
            block[-1] = key, [found[end_pick]], is_open
        for (key, found, is_open), pick in zip(block, viterbi([f for _, f, _ in block])):
            if is_open:
                keys.append(key)
                out.append(found[pick][1])
        block.clear()

    def batch_out() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(out, pa.int64())], ["key", "utc_us"])
        keys.clear()
        out.clear()
        return made

    for at, name, found, (is_open, first_pick, last_pick) in _runs(batches):
        if at != run:
            finish()
            run, end_pick = at, last_pick
            if first_pick is not None:
                found = [found[first_pick]]
        block.append((name, found, is_open))
        if len(keys) >= 10_000:
            yield batch_out()
    finish()
    yield batch_out()


def normalised(records: DataFrame) -> DataFrame:
    """(key, utc_us) of every record that denotes an instant.

    ``records``: source string, block bigint, place (orderable), key string, text string, zone string, date_order
    string; other columns are ignored. Blocks of a source follow each other in their order, and so do the places in a block;
    where the blocks are cut changes nothing in the choice. A null source is one
    source. Null, empty and meaningless texts give no row; repeated keys give a row
    each; an unknown zone counts as UTC, an unknown order leaves the choice to the walk; an empty table gives an empty one.
    """
    narrow = records.select(F.coalesce("source", F.lit("")).alias("source"), F.coalesce(F.col("block").cast("bigint"), F.lit(0)).alias("block"), F.col("place").cast("bigint").alias("place"), "key", "text", "zone", "date_order")
    found = narrow.filter(F.col("text").isNotNull()).mapInArrow(
        _candidates, f"source string, block bigint, place bigint, key string, candidates {CANDIDATES}")
    rows = found.filter(F.size("candidates") > 0).repartition("source", "block").sortWithinPartitions("source", "block", "place", "key")
    inside = cut(rows.select("source", "block", "place", "key", "candidates", F.col("place").alias("at")).mapInArrow(
        _inside, f"source string, block bigint, place bigint, key string, utc_us bigint, candidates {CANDIDATES}"))
    decided = inside.filter("utc_us IS NOT NULL").select("key", "utc_us")
    if inside.filter("utc_us IS NULL").isEmpty():
        return decided
    ends = inside.filter("candidates IS NOT NULL").select("source", "block", "place", "key", "candidates", F.col("utc_us").isNull().alias("open"))
    return decided.unionByName(_walked(ends))


def _walked(ends: DataFrame) -> DataFrame:
    """(key, utc_us) of the open records among the ends of blocks, by the walk over the whole source."""
    rows = cut(ends.repartition("source", "block").sortWithinPartitions("source", "block", "place", "key"))
    sums = rows.mapInArrow(_sum_up, f"source string, block bigint, first {CANDIDATES}, last {CANDIDATES}, table array<double>")
    picks = cut(sums.repartition("source").sortWithinPartitions("source", "block").mapInArrow(_join_blocks, "source string, block bigint, first_pick int, last_pick int"))
    tied = rows.join(F.broadcast(picks) if picks.count() <= FEW_BLOCKS else picks, ["source", "block"], "left")
    return tied.sortWithinPartitions("source", "block", "place", "key").mapInArrow(_choose, "key string, utc_us bigint")


def already_canonical(text: Column) -> Column:
    return text.rlike(CANONICAL)
