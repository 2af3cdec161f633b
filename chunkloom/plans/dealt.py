"""Queries of the general training-data operators (problems 1 and 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.operators import instants, once
from chunkloom.storage import table

#: Deliveries of a block, by which a source's rows are spread over tasks.
EVENT_BLOCK = 65_536
SPLIT = "\x1f"


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every delivery whose event was already delivered under a smaller delivery_id."""
    events = table(spark, folder, "code_normalized_event").select("delivery_id", "event_id")
    return once.later_copies(events, once.uuid_key(F.col("event_id")), [F.col("delivery_id")]).select("delivery_id")


def p1_once(spark: SparkSession, folder: str) -> DataFrame:
    """One delivery of each event, whole rows; nested columns are written as text."""
    events = table(spark, folder, "code_normalized_event")
    kept = once.once(events, once.uuid_key(F.col("event_id")), [F.col("delivery_id")])
    entities = F.array_join(F.transform("entities", lambda e: F.concat_ws("|", e["entity_type"], e["name"], e["start_line"].cast("string"), e["end_line"].cast("string"), e["content"])), "\n")
    metadata = F.array_join(F.array_sort(F.transform(F.map_entries("metadata"), lambda e: F.concat_ws("=", e["key"], e["value"]))), "\n")
    return kept.select("delivery_id", "batch_id", "event_id", "source_id", "file_path", "language", "normalized_content", "timestamp",
                       F.unix_micros("received_at").alias("received_us"), entities.alias("entities"), metadata.alias("metadata"))


def p1_new(spark: SparkSession, folder: str) -> DataFrame:
    """What the deliveries since mid-2024 add to the earlier, stored ones."""
    events = table(spark, folder, "code_normalized_event").select("delivery_id", "event_id", "received_at")
    is_new = F.col("received_at") >= F.lit("2024-07-01").cast("timestamp")
    added = once.once(events.filter(is_new), once.uuid_key(F.col("event_id")), [F.col("delivery_id")], stored=events.filter(~is_new))
    return added.select("delivery_id")


def written_instants(spark: SparkSession, folder: str) -> DataFrame:
    """All written timestamps of the three tables, ready for the walk."""
    accounts = table(spark, folder, "source_account").select("source_id", F.col("time_zone").alias("zone"), "date_order")
    events = table(spark, folder, "code_normalized_event").select(
        "source_id", F.lit("event").alias("kind"), F.expr(f"delivery_id div {EVENT_BLOCK}").alias("block"),
        F.col("delivery_id").alias("place"), F.col("delivery_id").cast("string").alias("record"), F.lit(0).alias("pos"), F.col("timestamp").alias("text"))
    items = table(spark, folder, "source_item").select(
        "source_id", F.lit("item").alias("kind"), F.expr("cast(unix_date(cast(synced_at AS date)) AS bigint)").alias("block"),
        F.unix_micros("synced_at").alias("place"), F.col("id").alias("record"), F.lit(0).alias("pos"), F.col("created_at").alias("text"))
    messages = table(spark, folder, "chat_thread").select(
        "source_id", F.lit("message").alias("kind"), F.lit(0).cast("bigint").alias("block"), F.col("thread_id").alias("record"),
        F.posexplode("messages.ts").alias("pos", "text")).withColumn("place", F.col("pos").cast("bigint"))
    records = events.unionByName(items).unionByName(messages).join(accounts, "source_id", "left")
    key = F.concat_ws(SPLIT, "kind", F.col("pos").cast("string"), instants.already_canonical(F.col("text")).cast("string"), "record")
    return records.withColumn("key", key).withColumn("source", F.concat_ws(":", "kind", F.when(F.col("kind") == "message", F.col("record")).otherwise(F.col("source_id"))))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every written value that denotes an instant and is not in the canonical form, with its instant."""
    found = instants.normalised(written_instants(spark, folder))
    parts = F.split("key", SPLIT, 4)
    return found.filter(parts[2] == "false").select(
        parts[0].alias("record_kind"), parts[3].alias("record_key"), parts[1].cast("int").alias("pos"), "utc_us").distinct()


def p3_walked(spark: SparkSession, folder: str) -> DataFrame:
    """Instants of the values written as numeric dates, chosen by the walk alone: the accounts' order of dates is withheld."""
    rows = written_instants(spark, folder).filter(F.col("text").rlike(r"^\s*\d{1,2}([/.\-])\d{1,2}\1\d{2,4}\b") | F.col("text").rlike(r"^\s*\d{4}-"))
    found = instants.normalised(rows.withColumn("date_order", F.lit(None).cast("string")))
    parts = F.split("key", SPLIT, 4)
    return found.select(parts[0].alias("record_kind"), parts[3].alias("record_key"), parts[1].cast("int").alias("pos"), "utc_us").distinct()


QUERIES = {"p1_found": p1_found, "p1_once": p1_once, "p1_new": p1_new, "p3_found": p3_found, "p3_walked": p3_walked}

_UUID = r"""'^\s*(?:urn:uuid:)?\{?([0-9a-f]{8})-?([0-9a-f]{4})-?([0-9a-f]{4})-?([0-9a-f]{4})-?([0-9a-f]{12})\}?\s*$'"""
_KEYED = rf"""SELECT *, CASE WHEN trim(event_id, ' ' || chr(9) || chr(10) || chr(13)) <> '' THEN
    regexp_replace(lower(event_id), {_UUID}, '\1\2\3\4\5') END AS k FROM code_normalized_event"""

SQL = {
    "p1_found": f"""SELECT delivery_id FROM (SELECT delivery_id, k, min(delivery_id) OVER (PARTITION BY k) AS first
        FROM ({_KEYED})) WHERE k IS NOT NULL AND delivery_id > first""",
    "p1_once": f"""SELECT delivery_id, batch_id, event_id, source_id, file_path, language, normalized_content, "timestamp", epoch_us(received_at) AS received_us,
        array_to_string(list_transform(entities, lambda e: concat_ws('|', e.entity_type, e.name, e.start_line, e.end_line, e.content)), chr(10)) AS entities,
        array_to_string(list_sort(list_transform(map_entries(metadata), lambda e: concat_ws('=', e.key, e.value))), chr(10)) AS metadata FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY delivery_id) AS rn
        FROM ({_KEYED})) WHERE k IS NULL OR rn = 1""",
    "p1_new": f"""SELECT delivery_id FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY received_at >= TIMESTAMP '2024-07-01', delivery_id) AS rn
        FROM ({_KEYED})) WHERE received_at >= TIMESTAMP '2024-07-01' AND (k IS NULL OR rn = 1)""",
}
