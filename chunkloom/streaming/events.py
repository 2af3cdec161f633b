"""Code events as a stream: decode, keep each once, chunk, enrich, publish."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from chunkloom.config import ChunkConfig
from chunkloom.operators.chunk import chunk_id, pieces
from chunkloom.operators.jobs import JobStore
from chunkloom.operators.once import uuid_key
from chunkloom.operators.ring import assigned
from chunkloom.sources.files import decode_events, events_to_items


def event_chunks(events: DataFrame, config: ChunkConfig = ChunkConfig(), profile: str = "default") -> DataFrame:
    """Outbound rows without ``total_chunks``, the same for a batch and a stream. Narrow.

    With a column ``event_key`` chunk ids are made from it instead of ``event_id``, and it is kept for ``outbound``.
    """
    own = tuple(c for c in ("event_key",) if c in events.columns)
    items = events_to_items(events, own)
    made = pieces(items, config, "code", carry=own).filter(F.col("error").isNull())
    return made.select(
        *own, F.col("item").alias("event_id"), "path", chunk_id(F.col(own[0] if own else "item"), F.col("chunk_index"), F.col("strategy")).alias("chunk_id"), "chunk_index", "content", "token_count",
        F.struct("language", F.col("meta_type").alias("entity_type"), F.col("symbol_name").alias("entity_name"), F.col("line_start").alias("start_line"),
                 F.col("line_end").alias("end_line"), F.lit(profile).alias("profile")).alias("metadata"))


def outbound(made: DataFrame, partitions: int = 6) -> DataFrame:
    """(key, value, partition) for a broker: chunks of a finite batch with their item's total, placed by the ring."""
    key, n = ("event_key", F.countDistinct("chunk_index")) if "event_key" in made.columns else ("event_id", F.count(F.lit(1)))
    total = made.groupBy(key).agg(n.cast("int").alias("total_chunks"))
    value = F.to_json(F.struct("event_id", F.col("path").alias("file_path"), "chunk_id", "chunk_index", "total_chunks", "content", "token_count", "metadata"))
    return assigned(made.join(total, key).select(F.col("chunk_id").alias("key"), value.alias("value")), partitions)


@dataclass
class Pipeline:
    """The queries of one pipeline: its events, and its dead letters where they are kept."""

    events: StreamingQuery
    dead: StreamingQuery | None = None

    def awaitTermination(self) -> None:  # noqa: N802 - as a single query's
        self.events.awaitTermination()
        if self.dead:
            self.dead.awaitTermination()

    def stop(self) -> None:
        self.events.stop()
        if self.dead:
            self.dead.stop()

    @property
    def recentProgress(self) -> list:  # noqa: N802
        return self.events.recentProgress


def run(spark: SparkSession, messages: DataFrame, sink, checkpoint: str, dead_letters: str | None = None, config: ChunkConfig = ChunkConfig(),
        watermark: str = "1 day", once_only: bool = True, trigger: dict | None = None, partitions: int = 6) -> Pipeline:
    """Runs the pipeline over a stream of JSON messages (value, and received_at for the watermark).

    Events are kept once within the watermark, those with a null or blank identifier all pass as events of their own; each
    micro-batch goes to ``sink(batch, epoch)``, which must be idempotent by chunk_id, as ids are the same when a batch is
    repeated. Messages that are no events go to ``dead_letters``.
    """
    decoded = _decoded(messages)
    key = uuid_key(F.col("event.event_id"))
    own = F.concat(F.lit("message:"), F.md5(F.concat_ws("\x1f", F.col("received_at").cast("string"), "raw")))
    events = decoded.filter("event IS NOT NULL").select("received_at", "event.*", F.when(key.isNull(), own).otherwise(F.col("event.event_id")).alias("event_key"), F.hex(key).alias("__key"))
    if once_only:
        # null keys would be equal to each other; a union of two branches would read the source twice
        events = events.withColumn("__key", F.coalesce("__key", F.concat(F.lit("own:"), F.expr("uuid()")))).withWatermark("received_at", watermark).dropDuplicatesWithinWatermark(["__key"])
    events = events.drop("__key")

    def write(batch: DataFrame, epoch: int) -> None:
        made = event_chunks(batch, config).persist()
        try:
            sink(outbound(made, partitions), epoch)
        finally:
            made.unpersist()

    dead = None
    if dead_letters:
        bad = decoded.filter("event IS NULL").select("raw", "received_at")
        dead = bad.writeStream.format("json").option("path", dead_letters).option("checkpointLocation", f"{checkpoint}/dead").trigger(**(trigger or {"availableNow": True})).start()
    return Pipeline(events.writeStream.foreachBatch(write).option("checkpointLocation", f"{checkpoint}/events").trigger(**(trigger or {"availableNow": True})).start(), dead)


def _decoded(messages: DataFrame) -> DataFrame:
    at = F.col("received_at") if "received_at" in messages.columns else F.current_timestamp()
    return decode_events(messages.withColumn("received_at", at))


class JobProgress(StreamingQueryListener):
    """Keeps a job's state by the progress of a streaming query."""

    def __init__(self, store: JobStore, job_id: str):
        self.store, self.job_id, self.seen = store, job_id, 0

    def onQueryStarted(self, event) -> None:
        self.store.start(self.job_id)

    def onQueryProgress(self, event) -> None:
        self.seen += event.progress.numInputRows
        self.store.progress(self.job_id, self.seen, 0)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self.store.fail(self.job_id, event.exception)
        else:
            self.store.complete(self.job_id, self.seen)
