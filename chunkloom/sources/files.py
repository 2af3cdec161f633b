"""Readers: items from JSON requests, files and tables; decoding of events; options of brokers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.operators.route import detect_language
from chunkloom.schemas import EVENT, SOURCE_ITEM

ITEM_COLUMNS = ("id", "source_id", "source_kind", "content_type", "content", "metadata", "created_at")


def items_from_json(requests: DataFrame, value: str = "value") -> DataFrame:
    """Items of requests ``{"items": [...]}`` in a string column; what cannot be read gives none."""
    item = SOURCE_ITEM.replace(" string", ":string").replace(" timestamp", ":timestamp").replace(", ", ",")
    parsed = F.from_json(F.col(value), f"items array<struct<{item}>>", {"mode": "PERMISSIVE"})
    rows = requests.select(F.explode(parsed["items"]).alias("i")).select("i.*")
    return rows.filter("id IS NOT NULL AND content IS NOT NULL").withColumn("metadata", F.coalesce("metadata", F.lit("{}")))


def read_items(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    reader = spark.read if format != "json" else spark.read.schema(SOURCE_ITEM)
    return reader.format(format).load(path)


def files_to_items(files: DataFrame, source_id: str) -> DataFrame:
    """Files (path, content, language or null) as code items."""
    lang = F.col("language")
    return files.select(
        F.md5(F.concat_ws("\x1f", F.lit(source_id), "path")).alias("id"), F.lit(source_id).alias("source_id"), F.lit("code_repo").alias("source_kind"),
        F.concat(F.lit("text/code:"), F.coalesce(lang, F.lit("text"))).alias("content_type"), "content",
        F.to_json(F.struct("path", "language"), {"ignoreNullFields": "false"}).alias("metadata"), F.lit(None).cast("timestamp").alias("created_at"))


def read_files(spark: SparkSession, path: str, source_id: str, pattern: str = "*") -> DataFrame:
    """Every file below ``path`` as one item, its language by its name."""
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path, wholetext=True)
    file = F.col("_metadata.file_path")
    return files_to_items(read.select(file.alias("path"), F.col("value").alias("content"), detect_language(file).alias("language")), source_id)


def documents_to_items(documents: DataFrame, kind: Column, content_type: Column) -> DataFrame:
    """Rows of ``documents`` as items."""
    return documents.filter(F.col("text").isNotNull()).select(
        F.col("doc_id").cast("string").alias("id"), F.col("source").alias("source_id"), kind.alias("source_kind"), content_type.alias("content_type"), F.col("text").alias("content"),
        F.to_json(F.struct(F.col("title"), F.col("lang").alias("language"))).alias("metadata"), F.col("fetched_at").alias("created_at"))


def decode_events(messages: DataFrame, value: str = "value") -> DataFrame:
    """(event struct, raw, other columns): what is no event has a null event and can go to a dead-letter sink.

    An event has a source and an identifier or content: one with content but without an identifier is an event as well.
    """
    parsed = F.from_json(F.col(value).cast("string"), EVENT)
    others = [F.col(f"`{c}`") for c in messages.columns if c != value]
    return messages.select(*others, F.when(F.coalesce(parsed["event_id"], parsed["normalized_content"]).isNotNull() & parsed["source_id"].isNotNull(), parsed).alias("event"), F.col(value).cast("string").alias("raw"))


def events_to_items(events: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Events (event_id, source_id, file_path, language, normalized_content, entities, ...) as code items with entities and the ``carry`` columns."""
    lang = F.lower(F.trim(F.coalesce("language", F.lit(""))))
    known = F.when(lang != "", lang)
    return events.filter(F.col("normalized_content").isNotNull()).select(
        F.col("event_id").alias("id"), "source_id", F.lit("code_repo").alias("source_kind"), F.concat(F.lit("text/code:"), F.coalesce(known, F.lit("text"))).alias("content_type"),
        F.col("normalized_content").alias("content"), F.to_json(F.struct(F.col("file_path").alias("path"), known.alias("language"))).alias("metadata"),
        F.lit(None).cast("timestamp").alias("created_at"),
        # the entities' own texts are not read: their lines are
        F.arrays_zip(*[F.col(f"entities.{k}").alias(k) for k in ("entity_type", "name", "start_line", "end_line")]).alias("entities"), "file_path", *carry)


def kafka_source_options(servers: str, topic: str = "code.normalized", group: str = "chunkloom", per_trigger: int | None = None) -> dict[str, str]:
    out = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest", "kafka.group.id": group, "kafka.max.poll.interval.ms": "300000",
           "kafka.session.timeout.ms": "30000", "failOnDataLoss": "false"}
    return out | ({"maxOffsetsPerTrigger": str(per_trigger)} if per_trigger else {})


def kafka_sink_options(servers: str, topic: str = "chunk.created") -> dict[str, str]:
    return {"kafka.bootstrap.servers": servers, "topic": topic, "kafka.acks": "all", "kafka.retries": "3", "kafka.compression.type": "snappy",
            "kafka.enable.idempotence": "true", "kafka.linger.ms": "10", "kafka.batch.size": "16384"}


def read_kafka(spark: SparkSession, servers: str, **more) -> DataFrame:
    """The stream of messages (key, value, received_at); needs the connector on the class path."""
    stream = spark.readStream.format("kafka").options(**kafka_source_options(servers, **more)).load()
    return stream.select("key", F.col("value").cast("string").alias("value"), F.col("timestamp").alias("received_at"))


def write_kafka(rows: DataFrame, servers: str, topic: str = "chunk.created") -> None:
    """Writes (key, value, partition) of a finite batch, such as ``streaming.events.outbound`` makes."""
    rows.write.format("kafka").options(**kafka_sink_options(servers, topic)).save()


class RabbitClient:
    """Publishes and consumes JSON over AMQP; the address must be given. Needs the ``pika`` library, imported on use."""

    def __init__(self, url: str, prefetch: int = 10):
        if not url:
            raise ValueError("the broker's address must be configured")
        self.url, self.prefetch, self._channel = url, prefetch, None

    def channel(self):
        if self._channel is None:
            import pika

            self._channel = pika.BlockingConnection(pika.URLParameters(self.url)).channel()
            self._channel.basic_qos(prefetch_count=self.prefetch)
        return self._channel

    def publish(self, exchange: str, routing_key: str, payload: str, priority: int = 5) -> None:
        import pika

        self.channel().basic_publish(exchange, routing_key, payload.encode(), pika.BasicProperties(content_type="application/json", delivery_mode=2, priority=priority))

    def consume(self, queue: str, handler) -> None:
        """Acknowledges what the handler accepts and puts back what it does not."""
        for method, _, body in self.channel().consume(queue):
            if method is None:
                break
            if handler(body):
                self.channel().basic_ack(method.delivery_tag)
            else:
                self.channel().basic_nack(method.delivery_tag, requeue=True)
