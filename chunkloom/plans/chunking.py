"""Queries of the chunking operators over the test tables, each with SQL where SQL can express it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.config import BatchConfig, ChunkConfig, ServiceConfig, profiles
from chunkloom.functions.text import merge_short, split_sentences
from chunkloom.functions.tokens import count_tokens, tile_tokens
from chunkloom.operators import breaker, chunk, enrich, jobs, once, ring, route, symbols
from chunkloom.sources import connectors, files, sinks
from chunkloom.storage import checkpoint_dir, row_address, table
from chunkloom.streaming import events

WS = r"\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{0b}"
SIZE = 64


def _items(spark: SparkSession, folder: str) -> DataFrame:
    """Each item once; whole rows repeat under their id."""
    return once.once(table(spark, folder, "source_item"), F.col("id"), [F.col("synced_at"), *row_address()])


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return files.documents_to_items(table(spark, folder, "documents"), F.lit("other"), F.lit("text/plain"))


def _code(spark: SparkSession, folder: str) -> DataFrame:
    """Delivered files as items under their delivery."""
    events = table(spark, folder, "code_normalized_event").withColumn("event_id", F.col("delivery_id").cast("string"))
    return files.events_to_items(events)


def chunk_items(spark: SparkSession, folder: str) -> DataFrame:
    """Every item through the strategy that it is routed to."""
    return chunk.pieces(_items(spark, folder)).drop("error")


def chunk_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The texts of the chunks of every item through the strategy that it is routed to, at the default size."""
    return chunk.pieces(_items(spark, folder)).filter("error IS NULL").select("item", "strategy", "chunk_index", "content", "token_count")


def chunk_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The same in the documented schema."""
    return chunk.chunks(_items(spark, folder), created_at=F.lit("2024-01-01").cast("timestamp")).drop("embedding")


def route_items(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "source_item").select("id", route.strategy(F.col("content_type"), F.col("source_kind")).alias("strategy")).distinct()


def item_fields(spark: SparkSession, folder: str) -> DataFrame:
    kind, type_, meta = F.col("source_kind"), F.col("content_type"), F.col("metadata")
    return table(spark, folder, "source_item").select(
        "id", route.language(type_, meta).alias("language"), route.path(meta).alias("path"), F.octet_length("content").alias("n_bytes"), route.is_code(type_, kind).alias("is_code"),
        route.is_conversational(kind).alias("is_conversational"), route.default_content_type(kind).alias("default_type"), route.config_language(type_, kind, meta, "none").alias("config_language"),
        route.supports_language("code", route.language(type_, meta)).alias("supported")).distinct()


def detect_language(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "code_normalized_event").select("delivery_id", route.detect_language(F.col("file_path")).alias("language"))


def strategies_by_name(spark: SparkSession, folder: str) -> DataFrame:
    """Names that the regions of the tables, as names, and all aliases stand for."""
    names = table(spark, folder, "region").select(F.col("r_name").alias("name")).unionByName(
        spark.createDataFrame([(n.upper(),) for n in [*route.STRATEGIES, *route.ALIASES]], "name string"))
    return names.select("name", route.strategy_by_name(F.col("name")).alias("strategy"))


def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", count_tokens(F.col("text")).alias("n_tokens"), F.size(tile_tokens(F.col("text"))).alias("n_tiles")).filter("n_tokens IS NOT NULL")


def token_windows(spark: SparkSession, folder: str) -> DataFrame:
    return chunk.token_windows(_documents(spark, folder), SIZE, 8)


def sentence_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return chunk.pieces(_documents(spark, folder), ChunkConfig(SIZE), "sentence").select("item", "chunk_index", "content", "token_count")


def sentences(spark: SparkSession, folder: str) -> DataFrame:
    texts = table(spark, folder, "documents").filter("text IS NOT NULL")
    return texts.select("doc_id", F.posexplode(split_sentences(F.col("text"))).alias("pos", "sentence"))


def merged_sentences(spark: SparkSession, folder: str) -> DataFrame:
    texts = table(spark, folder, "documents").filter("text IS NOT NULL")
    return texts.select("doc_id", F.posexplode(merge_short(split_sentences(F.col("text")), 40)).alias("pos", "segment"))


def recursive_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return chunk.pieces(_items(spark, folder), ChunkConfig(SIZE), "recursive").select("item", "chunk_index", "content", "token_count", "start_index", "end_index")


def document_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return chunk.pieces(_items(spark, folder), ChunkConfig(SIZE), "document").select("item", "chunk_index", "content", "token_count", "section")


def heading_sections(spark: SparkSession, folder: str) -> DataFrame:
    return chunk.heading_sections(_items(spark, folder))


def chat_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Threads of the chat table, rendered as JSON items."""
    threads = once.once(table(spark, folder, "chat_thread"), F.col("thread_id"), [F.col("thread_ts"), *row_address()])
    items = threads.select(
        F.col("thread_id").alias("id"), F.lit("chat").alias("source_kind"), F.lit("application/json").alias("content_type"), F.lit("{}").alias("metadata"),
        F.to_json(F.struct("channel", "thread_ts", "messages")).alias("content"))
    return chunk.pieces(items, ChunkConfig(SIZE)).select("item", "chunk_index", "content", "thread_id")


def ticket_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return chunk.pieces(_items(spark, folder), ChunkConfig(SIZE), "ticketing").select("item", "chunk_index", "content", "token_count", "meta_type", "author")


def _supplier_items(spark: SparkSession, folder: str, markdown: bool) -> DataFrame:
    """Suppliers of each nation as a table text."""
    s = table(spark, folder, "supplier").join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    row = F.concat(F.lit("| "), F.concat_ws(" | ", F.col("s_suppkey").cast("string"), "s_name"), F.lit(" |")) if markdown else F.concat_ws(",", F.col("s_suppkey").cast("string"), "s_name")
    head = "| key | name |\n| --- | --- |" if markdown else "key,name"
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", row.alias("r")))), lambda x: x["r"]), "\n")
    return s.groupBy("n_name").agg(F.concat(F.lit(head + "\n"), rows).alias("content")).select(
        F.col("n_name").alias("id"), F.lit("document").alias("source_kind"), F.lit("text/csv").alias("content_type"), "content", F.lit("{}").alias("metadata"))


def csv_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return chunk.pieces(_supplier_items(spark, folder, False), ChunkConfig(SIZE)).select("item", "chunk_index", "content", "start_index", "end_index")


def markdown_table_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return chunk.pieces(_supplier_items(spark, folder, True), ChunkConfig(SIZE)).select("item", "chunk_index", "content", "start_index", "end_index")


def code_line_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return chunk.pieces(_code(spark, folder).drop("entities"), ChunkConfig(128, 30), "code").select("item", "chunk_index", "content", "line_start", "line_end")


def code_entity_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return chunk.pieces(_code(spark, folder), ChunkConfig(128, 30), "code").select("item", "chunk_index", "content", "line_start", "line_end", "symbol_name", "meta_type", "token_count")


def code_gaps(spark: SparkSession, folder: str) -> DataFrame:
    return chunk.line_gaps(_code(spark, folder))


def agentic_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return chunk.pieces(_code(spark, folder), ChunkConfig(128), "agentic").select("item", "chunk_index", "content", "token_count", "start_index", "end_index")


def agentic_boundaries(spark: SparkSession, folder: str) -> DataFrame:
    """Boundary lines of code by class."""
    found = chunk.boundaries(_code(spark, folder)).withColumnRenamed("n", "line")
    return found.groupBy(F.col("item").alias("id"), "kind").agg(F.count(F.lit(1)).alias("n"), F.max("line").alias("last"))


def content_analysis(spark: SparkSession, folder: str) -> DataFrame:
    """Features of code contents: tokens, lines and what they hold."""
    return chunk.analyses(_code(spark, folder)).withColumnRenamed("item", "id").drop("nesting_depth")


def nesting_depth(spark: SparkSession, folder: str) -> DataFrame:
    """Deepest nesting of brackets, never below zero."""
    return chunk.analyses(_code(spark, folder)).select(F.col("item").alias("id"), F.col("nesting_depth").alias("depth"))


def _code_files(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "code_normalized_event")
    return events.select(F.col("delivery_id").cast("string").alias("path"), F.col("normalized_content").alias("content"), route.detect_language(F.col("file_path")).alias("language"))


def code_symbols(spark: SparkSession, folder: str) -> DataFrame:
    return symbols.symbols(_code_files(spark, folder))


def python_definitions(spark: SparkSession, folder: str) -> DataFrame:
    found = symbols.symbols(_code_files(spark, folder).filter("language = 'python'"))
    return found.filter(F.col("symbol_type") != "class").select("path", "name", "line")


def symbol_index(spark: SparkSession, folder: str) -> DataFrame:
    return symbols.locations(symbols.symbols(_code_files(spark, folder)))


def file_symbols(spark: SparkSession, folder: str) -> DataFrame:
    return symbols.by_path(symbols.symbols(_code_files(spark, folder))).select(
        "path", F.size("symbols").alias("n"), F.array_join(F.transform("symbols", lambda x: F.concat_ws(" ", x["line"].cast("string"), x["name"], x["symbol_type"], x["parent"])), "\n").alias("symbols"))


def file_imports(spark: SparkSession, folder: str) -> DataFrame:
    found = symbols.file_imports(_code_files(spark, folder))
    return found.select("path", "module_path", F.array_join("symbols", ",").alias("symbols"), "is_wildcard")


def enrich_prefix(spark: SparkSession, folder: str) -> DataFrame:
    """Prefixes of delivered files from their path, language, repository and entities."""
    e = table(spark, folder, "code_normalized_event")
    named = F.coalesce(F.arrays_zip(F.col("entities.name").alias("name"), F.col("entities.entity_type").alias("entity_type")), F.array())
    definitions = F.transform(named, lambda x: F.struct(x["name"].alias("name"), x["entity_type"].alias("entity_type"), F.lit(None).cast("string").alias("signature")))
    names = F.filter(F.coalesce(F.col("entities.name"), F.array()), lambda n: n.isNotNull())
    context = F.struct(F.col("file_path"), F.col("metadata")["repo"].alias("repository"), F.lit(None).cast("string").alias("branch"), F.col("language"), F.lit("").alias("scope"),
                       definitions.alias("definitions"), names.alias("dependencies"), F.col("metadata")["branch"].alias("documentation"))
    return enrich.enriched(e.select("delivery_id", F.lit("x").alias("content"), context.alias("context"))).select("delivery_id", "prefix", "enriched_content")


def large_item_split(spark: SparkSession, folder: str) -> DataFrame:
    return chunk.split_large(_items(spark, folder), 2_000)


def batch_summary(spark: SparkSession, folder: str) -> DataFrame:
    return chunk.batch(_items(spark, folder))[1]


def batch_split_summary(spark: SparkSession, folder: str) -> DataFrame:
    """The same with contents above 20,000 bytes cut before they are chunked."""
    return chunk.batch(_items(spark, folder), BatchConfig(max_content_size=20_000))[1]


def chunk_totals(spark: SparkSession, folder: str) -> DataFrame:
    stored = table(spark, folder, "chunk").select("id", F.col("source_item_id").alias("item")).distinct()
    return chunk.with_total(stored)


def profiles_sweep(spark: SparkSession, folder: str) -> DataFrame:
    """Windows and tokens that each preset makes of all documents; the presets are four rows."""
    texts = table(spark, folder, "documents").filter("text <> ''").select(F.size(tile_tokens(F.col("text"))).alias("n"))
    p = profiles(spark)
    both = texts.withColumn("p", F.explode(F.array(*[F.lit(r.name) for r in p.collect()]))).join(F.broadcast(p), F.col("p") == F.col("name"))
    step = F.col("chunk_size") - F.col("chunk_overlap")
    made = F.when(F.col("n") <= F.col("chunk_size"), 1).otherwise(F.ceil((F.col("n") - F.col("chunk_size")) / step) + 1)
    return both.groupBy("name").agg(F.sum(made).cast("bigint").alias("n_windows"), F.sum("n").alias("n_tokens"))


def _described(payload: DataFrame) -> DataFrame:
    """Fields of the payload's metadata beside its others."""
    of = lambda name: F.get_json_object("metadata", f"$.{name}").alias(f"meta_{name}")
    return payload.select(*[c for c in payload.columns if c != "metadata"], of("content_type"), of("section"), of("symbol_name"), of("author"), of("thread_id")).distinct()


def graph_payload(spark: SparkSession, folder: str) -> DataFrame:
    return _described(sinks.graph_rows(table(spark, folder, "chunk")))


def embed_payload(spark: SparkSession, folder: str) -> DataFrame:
    return _described(sinks.embedding_rows(table(spark, folder, "chunk")))


def _answer(url: str, body: dict, timeout: float) -> dict:
    """What a service answers to a batch: it embeds all, and finds an entity in every chunk of a language."""
    n = len(body["chunks"])
    return {"embedded_count": n, "chunks_processed": n, "entities_created": sum(c.get("language") is not None for c in body["chunks"]), "relationships_created": 0, "errors": []}


def sink_batches(spark: SparkSession, folder: str) -> DataFrame:
    """What both sinks post and what comes back, over distinct chunks, with a service within the process."""
    chunks = once.once(table(spark, folder, "chunk"), F.col("id"), [F.col("created_at"), *row_address()])
    embedded = sinks.EmbeddingSink("http://embed", post=_answer).batches(chunks).select(F.lit("embedding").alias("sink"), "sent", F.col("embedded_count").alias("taken"), F.lit(0).cast("bigint").alias("entities"))
    linked = sinks.GraphSink("http://graph", post=_answer).batches(chunks).select(F.lit("graph").alias("sink"), "sent", F.col("chunks_processed").alias("taken"), F.col("entities_created").alias("entities"))
    return embedded.unionByName(linked).groupBy("sink").agg(F.sum("sent").alias("sent"), F.sum("taken").alias("taken"), F.sum("entities").alias("entities"), (F.max("sent") <= sinks.BATCH).alias("within_size"))


def request_items(spark: SparkSession, folder: str) -> DataFrame:
    """Items of JSON requests: each source's items as one request a month, decoded again."""
    items = once.once(table(spark, folder, "source_item"), F.col("id"), [F.col("synced_at"), *row_address()])
    fields = ("id", "source_id", "source_kind", "content_type", "content", "metadata")
    requests = items.groupBy("source_id", F.trunc("synced_at", "month").alias("m")).agg(F.to_json(F.struct(F.collect_list(F.struct(*fields)).alias("items"))).alias("value"))
    return files.items_from_json(requests).select(*fields)


def file_items(spark: SparkSession, folder: str) -> DataFrame:
    """Delivered files as items of one upload."""
    given = _code_files(spark, folder).filter("content IS NOT NULL")
    return files.files_to_items(given, "upload").select("id", "source_id", "source_kind", "content_type", "content", F.get_json_object("metadata", "$.language").alias("language"))


def connector_items(spark: SparkSession, folder: str) -> DataFrame:
    """Files, pages and threads of upstream systems as items under stable ids."""
    events = table(spark, folder, "code_normalized_event").filter("file_path IS NOT NULL AND normalized_content IS NOT NULL")
    code = connectors.code_files(events.select(F.concat("file_path", F.lit("@"), "delivery_id").alias("path"), F.col("normalized_content").alias("content"), F.col("event_id").alias("sha")), "s", "repo", "main")
    documents = table(spark, folder, "documents").filter("text IS NOT NULL")
    pages = connectors.pages(documents.select(F.col("doc_id").cast("string").alias("key"), "title", F.col("text").alias("body"), F.lit(None).cast("string").alias("url"), F.col("fetched_at").alias("created_at")), "s")
    threads = connectors.threads(once.once(table(spark, folder, "chat_thread"), F.col("thread_id"), [F.col("thread_ts"), *row_address()]), F.col("source_id")).withColumn("content", F.lit(None).cast("string"))
    columns = ("id", "source_kind", "content_type", "content")
    return code.select(*columns).unionByName(pages.select(*columns)).unionByName(threads.select(*columns))


def chunk_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """Metadata of stored chunks built anew by the builders: code, with its symbol and lines."""
    c = once.once(table(spark, folder, "chunk"), F.col("id"), [F.col("created_at"), *row_address()])
    m = F.col("metadata")
    made = chunk.with_lines(chunk.with_symbol(chunk.for_code(m["path"], m["language"]), m["symbol_name"], m["parent_symbol"]), m["line_range"]["start"], m["line_range"]["end"])
    return c.select("id", made.alias("m")).select("id", "m.content_type", "m.path", "m.language", "m.symbol_name", "m.parent_symbol", F.col("m.line_range.start").alias("line_start"), F.col("m.line_range.end").alias("line_end"), "m.section")


def file_context(spark: SparkSession, folder: str) -> DataFrame:
    """Stored chunks with the context of the delivered file at their path."""
    c = once.once(table(spark, folder, "chunk"), F.col("id"), [F.col("created_at"), *row_address()])
    files_ = table(spark, folder, "code_normalized_event").filter("file_path IS NOT NULL").groupBy(F.col("file_path").alias("path")).agg(F.min("language").alias("language"))
    none = F.lit(None).cast("string")
    context = F.struct(F.col("path").alias("file_path"), none.alias("repository"), none.alias("branch"), F.col("language"), F.lit("").alias("scope"),
                       F.array().cast("array<struct<name:string,entity_type:string,signature:string>>").alias("definitions"), F.array().cast("array<string>").alias("dependencies"), none.alias("documentation"))
    made = enrich.enriched_by_file(c.select("id", F.col("metadata.path").alias("path"), "content"), files_.select("path", context.alias("context")))
    return made.select("id", "prefix", "enriched_content")


def service_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """The presets as the service lists them, after one was chosen; an unknown one is not taken."""
    run = jobs.Service(spark, ServiceConfig())
    chosen, unknown = run.set_active_profile("small"), run.set_active_profile("none")
    return run.profiles().select("name", "chunk_size", "chunk_overlap", "active", F.lit(chosen and not unknown).alias("taken"))


def service_strategies(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.Service(spark, ServiceConfig()).strategies().select("name", (F.length("description") > 0).alias("described"))


def job_states(spark: SparkSession, folder: str) -> DataFrame:
    """Jobs through their states: created, started, in progress, completed and failed."""
    store = jobs.JobStore()
    ids = [store.create(10 + i) for i in range(5)]
    for job in ids[1:]:
        store.start(job)
    for job in ids[2:]:
        store.progress(job, 4, 7)
    store.complete(ids[3], 25)
    store.fail(ids[4], "broken")
    return store.table(spark).select("total_items", "status", "processed_items", "chunks_created", "error", F.col("started_at").isNotNull().alias("started"), F.col("completed_at").isNotNull().alias("ended"))


def job_run(spark: SparkSession, folder: str) -> DataFrame:
    """A job over all items with both sinks: its state, and what the sinks took beside the chunks it counted."""
    taken: dict[str, int] = {}
    run = jobs.Service(spark, ServiceConfig(), [lambda made: taken.update(embedded=sinks.EmbeddingSink("http://embed", post=_answer)(made)),
                                                lambda made: taken.update(graph=sinks.GraphSink("http://graph", post=_answer)(made)["chunks_processed"])])
    state = run.status(run.submit(_items(spark, folder))["job_id"])
    all_taken = state["chunks_created"] == taken.get("embedded") == taken.get("graph")
    return spark.createDataFrame([(state["status"], state["total_items"], state["processed_items"], all_taken)], "status string, total_items bigint, processed_items bigint, all_taken boolean")


def _jobs(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as jobs: their status, and their date as the end."""
    state = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "running").otherwise("failed")
    return table(spark, folder, "orders").select(F.col("o_orderkey").alias("job_id"), state.alias("status"), F.col("o_orderdate").cast("timestamp").alias("completed_at"))


def job_counts(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.counts(_jobs(spark, folder))


def job_cleanup(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.kept(_jobs(spark, folder), F.lit("1998-01-01").cast("timestamp"), "INTERVAL 30 DAYS").select("job_id", "status")


def ring_stats(spark: SparkSession, folder: str) -> DataFrame:
    return ring.stats(ring.ring(spark, 6), 6)


def ring_partitions(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks on the six partitions of the outbound topic."""
    keys = table(spark, folder, "chunk").select(F.col("id").alias("key")).distinct()
    return ring.assigned(keys, 6).groupBy("partition").agg(F.count(F.lit(1)).alias("n"))


def circuit_breaker(spark: SparkSession, folder: str) -> DataFrame:
    """Each user's events as calls of a service: errors fail."""
    e = table(spark, folder, "events")
    calls = e.select(F.col("user_id").cast("string").alias("service"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("ok"))
    return breaker.replayed(calls, breaker.BreakerConfig(failure_threshold=2)).groupBy("service", "state", "allowed").agg(F.count(F.lit(1)).alias("n"))


def event_items(spark: SparkSession, folder: str) -> DataFrame:
    return _code(spark, folder).select("id", "source_id", "source_kind", "content_type", "content")


def stream_event_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The delivered events as a stream: chunked by entities, in a file sink with a checkpoint, then read back."""
    root = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    path = f"{folder}/code_normalized_event.parquet"
    source = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path + "*")  # a pattern, for a table may be one file
    made = events.event_chunks(source.withColumn("event_id", F.col("delivery_id").cast("string")), ChunkConfig(128, 30))
    made.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{root}/out").select("event_id", "chunk_id", "chunk_index", "content", "token_count", "metadata.start_line", "metadata.end_line")


def batch_event_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The same rows by a batch."""
    given = table(spark, folder, "code_normalized_event").withColumn("event_id", F.col("delivery_id").cast("string"))
    return events.event_chunks(given, ChunkConfig(128, 30)).select("event_id", "chunk_id", "chunk_index", "content", "token_count", "metadata.start_line", "metadata.end_line")


QUERIES = {f.__name__: f for f in (
    chunk_items, chunk_texts, chunk_rows, route_items, item_fields, detect_language, strategies_by_name, token_counts, token_windows, sentence_chunks, sentences, merged_sentences, recursive_chunks,
    document_chunks, heading_sections, chat_chunks, ticket_chunks, csv_chunks, markdown_table_chunks, code_line_chunks, code_entity_chunks, code_gaps, agentic_chunks, agentic_boundaries,
    content_analysis, nesting_depth, code_symbols, python_definitions, symbol_index, file_symbols, file_imports, enrich_prefix, large_item_split, batch_summary, batch_split_summary, chunk_totals, profiles_sweep,
    graph_payload, embed_payload, sink_batches, request_items, file_items, connector_items, chunk_metadata, file_context, service_profiles, service_strategies, job_states, job_run, job_counts, job_cleanup, ring_stats, ring_partitions, circuit_breaker, event_items, stream_event_chunks, batch_event_chunks)}

_STRATEGY = """CASE WHEN content_type LIKE 'text/code:%' OR content_type LIKE '%x-source%' THEN 'code' WHEN content_type LIKE '%markdown%' THEN 'document'
    WHEN content_type LIKE '%json%' AND content_type LIKE '%chat%' THEN 'chat' WHEN content_type LIKE '%csv%' OR content_type LIKE '%table%' THEN 'table'
    WHEN source_kind = 'code_repo' THEN 'code' WHEN source_kind IN ('document', 'wiki') THEN 'document' WHEN source_kind IN ('chat', 'email') THEN 'chat'
    WHEN source_kind = 'ticketing' THEN 'ticketing' WHEN source_kind = 'web' THEN 'recursive' ELSE 'sentence' END"""
_TEXT = "CASE WHEN json_type(metadata, '$.{0}') = 'VARCHAR' THEN json_extract_string(metadata, '$.{0}') END"
_LANG = f"CASE WHEN content_type LIKE 'text/code:%' THEN content_type[11:] ELSE {_TEXT.format('language')} END"
_CODE = "(source_kind = 'code_repo' OR content_type LIKE 'text/code:%')"
_WORDS, _TILES = r"\w+|[^\w\s]", r"\s*(?:\w+|[^\w\s])|\s+"
_COUNT = rf"len(regexp_extract_all({{0}}, '{_WORDS}'))"
_LINES = r"""(CASE WHEN {0} = '' THEN [] WHEN {0} LIKE '%' || chr(10) THEN string_split(replace({0}, chr(13) || chr(10), chr(10))[:-2], chr(10))
    ELSE string_split(replace({0}, chr(13) || chr(10), chr(10)), chr(10)) END)"""
# Written out, not taken from the module under test.
_EXT = """WHEN ext = 'rs' THEN 'rust' WHEN ext = 'py' THEN 'python' WHEN ext IN ('js', 'jsx') THEN 'javascript' WHEN ext IN ('ts', 'tsx') THEN 'typescript' WHEN ext = 'go' THEN 'go'
    WHEN ext = 'java' THEN 'java' WHEN ext IN ('c', 'h', 'hpp') THEN 'c' WHEN ext IN ('cpp', 'cc', 'cxx') THEN 'cpp' WHEN ext = 'rb' THEN 'ruby' WHEN ext = 'php' THEN 'php'
    WHEN ext = 'swift' THEN 'swift' WHEN ext IN ('kt', 'kts') THEN 'kotlin' WHEN ext = 'scala' THEN 'scala' WHEN ext = 'cs' THEN 'csharp' WHEN ext IN ('md', 'markdown') THEN 'markdown'
    WHEN ext = 'json' THEN 'json' WHEN ext IN ('yaml', 'yml') THEN 'yaml' WHEN ext = 'toml' THEN 'toml' WHEN ext = 'xml' THEN 'xml' WHEN ext IN ('html', 'htm') THEN 'html'
    WHEN ext = 'css' THEN 'css' WHEN ext = 'sql' THEN 'sql' WHEN ext IN ('sh', 'bash') THEN 'bash' WHEN ext = 'ps1' THEN 'powershell'"""
_PLAIN_NAMES = "'token', 'sentence', 'recursive', 'code', 'document', 'chat', 'ticketing', 'table', 'agentic'"
_OTHER_NAMES = "'markdown', 'ticket', 'issue', 'csv', 'smart', 'intelligent'"
_NAMES = f"""WHEN lower(name) IN ({_PLAIN_NAMES}) THEN lower(name) WHEN lower(name) = 'markdown' THEN 'document' WHEN lower(name) IN ('ticket', 'issue') THEN 'ticketing'
    WHEN lower(name) = 'csv' THEN 'table' WHEN lower(name) IN ('smart', 'intelligent') THEN 'agentic'"""


def _packed(segments: str, size: str, joiner: str = "''") -> str:
    """SQL of greedy packing over segments (item, i, s, w), i from 1 without gaps: (item, chunk_index, content, token_count)."""
    return f"""WITH RECURSIVE seg AS MATERIALIZED ({segments}), walk AS (
        SELECT item, i, s AS content, w AS held, 0 AS chunk_index FROM seg WHERE i = 1
        UNION ALL SELECT seg.item, seg.i, CASE WHEN walk.held + seg.w > {size} THEN seg.s ELSE walk.content || {joiner} || seg.s END,
            CASE WHEN walk.held + seg.w > {size} THEN seg.w ELSE walk.held + seg.w END, walk.chunk_index + CASE WHEN walk.held + seg.w > {size} THEN 1 ELSE 0 END
        FROM walk JOIN seg ON seg.item = walk.item AND seg.i = walk.i + 1)
    SELECT item, chunk_index::INTEGER AS chunk_index, arg_max(content, i) AS content, arg_max(held, i)::INTEGER AS token_count FROM walk GROUP BY item, chunk_index"""


_TILED = rf"""string_split(regexp_replace(regexp_replace({{0}}, '([.!?])([{WS.replace(chr(92) + 's', ' ' + chr(92) + 't' + chr(92) + 'r' + chr(92) + 'f')}]+)', '\1\2' || chr(1), 'g'), '([.!?])\n', '\1' || chr(1) || chr(10), 'g'), chr(1))"""
_MERGED = rf"""WITH RECURSIVE parts AS MATERIALIZED (SELECT item, s, row_number() OVER (PARTITION BY item ORDER BY k) AS i FROM
        (SELECT doc_id::VARCHAR AS item, unnest(p) AS s, generate_subscripts(p, 1) AS k FROM (SELECT doc_id, {_TILED.replace('{0}', 'text')} AS p FROM documents WHERE text <> ''))
        WHERE regexp_matches(s, '[^{WS}]')),
    walk AS (SELECT item, i, s, 1 AS m FROM parts WHERE i = 1
        UNION ALL SELECT p.item, p.i, CASE WHEN strlen(w.s) < 12 THEN w.s || p.s ELSE p.s END, w.m + CASE WHEN strlen(w.s) < 12 THEN 0 ELSE 1 END
        FROM walk w JOIN parts p ON p.item = w.item AND p.i = w.i + 1)
    SELECT item, m AS i, arg_max(s, walk.i) AS s, {_COUNT.format('arg_max(s, walk.i)')} AS w FROM walk GROUP BY item, m"""
_SENTENCES = rf"""SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[{WS}]', '\1' || chr(1), 'g'), chr(1)),
    lambda x: regexp_replace(x, '^[{WS}]+|[{WS}]+$', '', 'g')), lambda x: x <> '') AS l FROM documents WHERE text IS NOT NULL"""
_CODE_LINES = f"SELECT delivery_id::VARCHAR AS id, entities, {_LINES.format('normalized_content')} AS l FROM code_normalized_event WHERE normalized_content <> ''"
_TRIMMED = rf"regexp_replace(line, '^[{WS}]+|[{WS}]+$', '', 'g')"

SQL = {
    "route_items": f"SELECT DISTINCT id, {_STRATEGY} AS strategy FROM source_item",
    "item_fields": f"""SELECT DISTINCT id, {_LANG} AS language, {_TEXT.format('path')} AS path, strlen(content)::INTEGER AS n_bytes, {_CODE} AS is_code, source_kind IN ('chat', 'email') AS is_conversational,
        CASE source_kind WHEN 'code_repo' THEN 'text/code' WHEN 'chat' THEN 'application/json' WHEN 'ticketing' THEN 'text/markdown' WHEN 'wiki' THEN 'text/markdown' WHEN 'web' THEN 'text/html' ELSE 'text/plain' END AS default_type,
        coalesce(CASE WHEN {_CODE} THEN {_LANG} END, 'none') AS config_language,
        coalesce({_LANG} IN ('c', 'cpp', 'go', 'java', 'javascript', 'jsx', 'python', 'ruby', 'rust', 'tsx', 'typescript'), true) AS supported FROM source_item""",
    "detect_language": f"SELECT delivery_id, CASE {_EXT} END AS language FROM (SELECT delivery_id, lower(string_split(file_path, '.')[-1]) AS ext FROM code_normalized_event)",
    "strategies_by_name": f"""SELECT name, CASE {_NAMES} END AS strategy FROM (SELECT r_name AS name FROM region UNION ALL SELECT upper(unnest([{_PLAIN_NAMES}, {_OTHER_NAMES}])))""",
    "token_counts": rf"SELECT doc_id, {_COUNT.format('text')}::INTEGER AS n_tokens, len(regexp_extract_all(text, '{_TILES}'))::INTEGER AS n_tiles FROM documents WHERE text IS NOT NULL",
    "token_windows": rf"""SELECT item, i::INTEGER AS chunk_index, array_to_string(t[i * 56 + 1 : i * 56 + 64], '') AS content, len(t[i * 56 + 1 : i * 56 + 64])::INTEGER AS token_count,
        strlen(array_to_string(t[1 : i * 56], ''))::BIGINT AS start_index, strlen(array_to_string(t[1 : i * 56], ''))::BIGINT + strlen(array_to_string(t[i * 56 + 1 : i * 56 + 64], '')) AS end_index
        FROM (SELECT item, t, unnest(range(0, CASE WHEN len(t) <= 64 THEN 1 ELSE ceil((len(t) - 64) / 56.0)::BIGINT + 1 END)) AS i
        FROM (SELECT doc_id::VARCHAR AS item, regexp_extract_all(text, '{_TILES}') AS t FROM documents WHERE text <> ''))""",
    "sentence_chunks": _packed(_MERGED, str(SIZE)),
    "sentences": f"SELECT doc_id, (generate_subscripts(l, 1) - 1)::INTEGER AS pos, unnest(l) AS sentence FROM ({_SENTENCES})",
    "chat_chunks": f"""SELECT c.item, c.chunk_index, c.content, t.thread_ts AS thread_id FROM ({_packed(f'''SELECT thread_id AS item, k AS i, s, {_COUNT.format('s')} AS w FROM
        (SELECT thread_id, unnest(list_transform(messages, lambda m: m.user || ': ' || m.text)) AS s, generate_subscripts(messages, 1) AS k
        FROM (SELECT thread_id, any_value(messages) AS messages FROM chat_thread GROUP BY 1))''', str(SIZE), 'chr(10)')}) c
        JOIN (SELECT thread_id, any_value(thread_ts) AS thread_ts FROM chat_thread GROUP BY 1) t ON t.thread_id = c.item""",
    "code_line_chunks": f"""WITH RECURSIVE f AS MATERIALIZED (SELECT id, l, len(l) AS n, list_concat([0], list_transform(range(1, len(l) + 1), lambda k: list_sum(list_transform(l[1:k], lambda x: {_COUNT.format('x')}))::BIGINT)) AS p
            FROM ({_CODE_LINES}) WHERE len(l) > 0),
        walk AS (SELECT id, 0 AS chunk_index, 0::BIGINT AS a, coalesce(list_min(list_filter(range(1, n + 1), lambda e: p[e + 1] - p[1] >= 128)), n) AS b FROM f
            UNION ALL SELECT id, chunk_index + 1, s, coalesce(list_min(list_filter(range(s + 1, n + 1), lambda e: p[e + 1] - p[s + 1] >= 128)), n) FROM (
                SELECT walk.id, chunk_index, n, p, CASE WHEN b - least(3, b - a) <= a THEN b ELSE b - least(3, b - a) END AS s FROM walk JOIN f ON f.id = walk.id) WHERE s < n)
        SELECT walk.id AS item, chunk_index::INTEGER AS chunk_index, array_to_string(l[a + 1:b], chr(10)) AS content, (a + 1)::INTEGER AS line_start, b::INTEGER AS line_end FROM walk JOIN f ON f.id = walk.id""",
    "code_gaps": f"""WITH rows AS (SELECT id, unnest(l) AS line, generate_subscripts(l, 1) AS n, entities FROM ({_CODE_LINES})),
        free AS (SELECT id, line, n, coalesce(list_bool_or(list_transform(entities, lambda e: coalesce(e.start_line IS NOT NULL AND n BETWEEN greatest(e.start_line, 1) AND e.end_line, false))), false) AS covered FROM rows),
        runs AS (SELECT *, sum(covered::INTEGER) OVER (PARTITION BY id ORDER BY n) AS run FROM free)
        SELECT id AS item, min(n)::INTEGER AS line_start, max(n)::INTEGER AS line_end, sum({_COUNT.format('line')})::INTEGER AS token_count FROM runs WHERE NOT covered GROUP BY id, run HAVING sum({_COUNT.format('line')}) > 10""",
    "agentic_boundaries": rf"""SELECT id, kind, count(*) AS n, max(k)::INTEGER AS last FROM (SELECT id, k, CASE WHEN t = '' THEN 'EmptyLine' WHEN regexp_matches(t, '^#') THEN 'Heading'
        WHEN regexp_matches(t, '^(pub )?(async )?fn ') THEN 'FunctionDef' WHEN regexp_matches(t, '^(pub )?impl ') THEN 'ImplBlock' WHEN regexp_matches(t, '^(pub )?(struct|enum) ') THEN 'TypeDef'
        WHEN regexp_matches(t, '^(class|interface) ') THEN 'ClassDef' WHEN regexp_matches(t, '^(async )?def ') THEN 'FunctionDef' WHEN regexp_matches(t, '^(pub )?mod ') THEN 'ModuleDef'
        WHEN regexp_matches(t, '^(///|//!|/\*)') THEN 'DocComment' END AS kind FROM (SELECT id, k, {_TRIMMED} AS t FROM (SELECT id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS k FROM ({_CODE_LINES})))) WHERE kind IS NOT NULL GROUP BY id, kind""",
    "content_analysis": f"""SELECT d.id, {_COUNT.format('e.normalized_content')}::INTEGER AS total_tokens, len(l)::INTEGER AS total_lines,
        contains(e.normalized_content, '```') OR contains(e.normalized_content, '    fn ') AS has_code_blocks, coalesce(list_bool_or(list_transform(l, lambda x: starts_with(x, '#'))), false) AS has_headings,
        coalesce(list_bool_or(list_transform(l, lambda x: regexp_matches(x, '^(import |from |use |#include)'))), false) AS has_imports,
        CASE WHEN len(l) > 0 THEN list_sum(list_transform(l, lambda x: strlen(x))) // len(l) ELSE 0 END::INTEGER AS avg_line_length
        FROM ({_CODE_LINES}) d JOIN code_normalized_event e ON e.delivery_id::VARCHAR = d.id""",
    "heading_sections": f"""WITH rows AS (SELECT id, unnest(l) AS line, generate_subscripts(l, 1) AS n FROM (SELECT id, {_LINES.format('content')} AS l FROM (SELECT id, any_value(content) AS content FROM source_item WHERE content <> '' GROUP BY 1))),
        fenced AS (SELECT *, sum(starts_with(line, '```')::INTEGER) OVER (PARTITION BY id ORDER BY n) % 2 = 1 AS inside FROM rows),
        marked AS (SELECT *, NOT inside AND regexp_matches(line, '^#{{1,6}}[{WS}]+.+$') AS heading FROM fenced),
        numbered AS (SELECT *, sum(heading::INTEGER) OVER (PARTITION BY id ORDER BY n) AS section FROM marked)
        SELECT id AS item, section::BIGINT AS section_no, coalesce(max(CASE WHEN heading THEN length(regexp_extract(line, '^(#{{1,6}})', 1)) END), 0)::INTEGER AS level,
        max(CASE WHEN heading THEN regexp_extract(line, '^#{{1,6}}[{WS}]+(.+)$', 1) END) AS title, count(*) AS n_lines FROM numbered GROUP BY id, section
        HAVING bool_or(regexp_matches(line, '[^{WS}]'))""",
    "merged_sentences": f"""WITH RECURSIVE parts AS MATERIALIZED (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS s, len(l) AS n FROM ({_SENTENCES})),
        walk AS (SELECT doc_id, i, n, s AS open, 0 AS m FROM parts WHERE i = 1
            UNION ALL SELECT w.doc_id, p.i, w.n, CASE WHEN strlen(w.open) >= 40 THEN p.s ELSE w.open || ' ' || p.s END, w.m + CASE WHEN strlen(w.open) >= 40 THEN 1 ELSE 0 END
            FROM walk w JOIN parts p ON p.doc_id = w.doc_id AND p.i = w.i + 1),
        made AS (SELECT doc_id, m, arg_max(open, i) AS segment, max(max(m)) OVER (PARTITION BY doc_id) AS last FROM walk GROUP BY doc_id, m),
        short AS (SELECT doc_id, m AS last, segment AS tail FROM made WHERE m = last AND m > 0 AND strlen(segment) < 40)
        SELECT made.doc_id, m::INTEGER AS pos, CASE WHEN tail IS NOT NULL AND m = made.last - 1 THEN segment || ' ' || tail ELSE segment END AS segment
        FROM made LEFT JOIN short ON short.doc_id = made.doc_id WHERE NOT (tail IS NOT NULL AND m = made.last)""",
    "python_definitions": rf"""SELECT path, regexp_extract({_TRIMMED}, '^(?:async )?def ([^(\s]+)', 1) AS name, k::INTEGER AS line FROM (SELECT d.id AS path, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS k
        FROM ({_CODE_LINES}) d JOIN code_normalized_event e ON e.delivery_id::VARCHAR = d.id AND lower(string_split(e.file_path, '.')[-1]) = 'py') WHERE regexp_matches({_TRIMMED}, '^(?:async )?def [^(\s]')""",
    "enrich_prefix": """WITH parts AS (SELECT delivery_id, list_filter(['# File: ' || coalesce(file_path, ''), CASE WHEN language <> '' THEN '# Language: ' || language END, '# Repository: ' || metadata['repo'],
            CASE WHEN len(entities) > 0 THEN '# Defines: ' || array_to_string(list_transform(entities, lambda d: concat_ws(' ', d.entity_type, d.name)), ', ') END,
            CASE WHEN len(deps) > 0 THEN '# Dependencies: ' || CASE WHEN strlen(array_to_string(deps, ', ')) <= 100 THEN array_to_string(deps, ', ') ELSE array_to_string(deps[1:5], ', ') || ' ...' END END,
            '# Doc: ' || metadata['branch']], lambda x: x IS NOT NULL) AS l
            FROM (SELECT *, list_filter(list_transform(entities, lambda x: x.name), lambda x: x IS NOT NULL) AS deps FROM code_normalized_event)),
        cut AS (SELECT delivery_id, CASE WHEN strlen(array_to_string(l, chr(10))) <= 500 THEN array_to_string(l, chr(10))
            ELSE array_to_string(l[1 : list_max(list_filter(range(1, len(l) + 1), lambda k: list_sum(list_transform(l[1:k], lambda x: strlen(x) + 1)) <= 500))], chr(10)) END AS prefix FROM parts)
        SELECT delivery_id, prefix, prefix || chr(10) || '---' || chr(10) || 'x' AS enriched_content FROM cut""",
    "chunk_totals": "SELECT item, id, (count(*) OVER (PARTITION BY item))::INTEGER AS total_chunks FROM (SELECT DISTINCT id, source_item_id AS item FROM chunk)",
    "profiles_sweep": rf"""SELECT name, sum(CASE WHEN n <= size THEN 1 ELSE ceil((n - size) / (size - lap)::DOUBLE) + 1 END)::BIGINT AS n_windows, sum(n)::BIGINT AS n_tokens
        FROM (SELECT len(regexp_extract_all(text, '{_TILES}')) AS n FROM documents WHERE text <> ''), (VALUES ('default', 512, 50), ('small', 256, 25), ('large', 1024, 100), ('code', 768, 64)) AS p(name, size, lap) GROUP BY name""",
    "graph_payload": """SELECT DISTINCT id, content, source_kind, 'unknown' AS source_type, source_id, metadata.path AS file_path, NULL::VARCHAR AS repo_name, metadata.language AS language,
        NULL::VARCHAR AS heading_path, NULL::VARCHAR AS owner_id, metadata.content_type AS meta_content_type, metadata.section AS meta_section, metadata.symbol_name AS meta_symbol_name,
        metadata.author AS meta_author, metadata.thread_id AS meta_thread_id FROM chunk""",
    "embed_payload": """SELECT DISTINCT id, source_item_id, source_id, content, metadata.content_type AS meta_content_type, metadata.section AS meta_section, metadata.symbol_name AS meta_symbol_name,
        metadata.author AS meta_author, metadata.thread_id AS meta_thread_id FROM chunk""",
    "sink_batches": """SELECT unnest(['embedding', 'graph']) AS sink, n AS sent, n AS taken, unnest([0, languages]) AS entities, true AS within_size
        FROM (SELECT count(*) AS n, count(language) AS languages FROM (SELECT id, any_value(metadata.language) AS language FROM chunk GROUP BY id))""",
    "request_items": "SELECT DISTINCT id, source_id, source_kind, content_type, content, metadata FROM source_item",
    "file_items": f"""SELECT md5('upload' || chr(31) || delivery_id) AS id, 'upload' AS source_id, 'code_repo' AS source_kind, 'text/code:' || coalesce(language, 'text') AS content_type, content, language
        FROM (SELECT delivery_id, normalized_content AS content, CASE {_EXT} END AS language FROM (SELECT *, lower(string_split(file_path, '.')[-1]) AS ext FROM code_normalized_event)) WHERE content IS NOT NULL""",
    "job_run": "SELECT 'completed' AS status, count(DISTINCT id) AS total_items, count(DISTINCT id) AS processed_items, true AS all_taken FROM source_item",
    "job_counts": "SELECT CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'completed' WHEN 'P' THEN 'running' ELSE 'failed' END AS status, count(*) AS n FROM orders GROUP BY 1",
    "job_cleanup": """SELECT o_orderkey AS job_id, status FROM (SELECT *, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'completed' WHEN 'P' THEN 'running' ELSE 'failed' END AS status FROM orders)
        WHERE status NOT IN ('completed', 'failed') OR o_orderdate > TIMESTAMP '1998-01-01' - INTERVAL 30 DAYS""",
    "event_items": r"""SELECT delivery_id::VARCHAR AS id, source_id, 'code_repo' AS source_kind, 'text/code:' || coalesce(nullif(lower(trim(language)), ''), 'text') AS content_type, normalized_content AS content
        FROM code_normalized_event WHERE normalized_content IS NOT NULL""",
}

# Symbols: each language's lines with their scope as windows say it, united.
_FILES = f"""SELECT id AS path, l, CASE WHEN ext = 'rs' THEN 'rust' WHEN ext = 'py' THEN 'python' WHEN ext IN ('js', 'jsx', 'ts', 'tsx') THEN 'js'
    WHEN contains(c, 'fn ') AND contains(c, '->') THEN 'rust' WHEN contains(c, 'def ') AND contains(c, 'self') THEN 'python' WHEN contains(c, 'function') OR contains(c, '=>') THEN 'js' END AS lang
    FROM (SELECT d.id, d.l, e.normalized_content AS c, lower(string_split(e.file_path, '.')[-1]) AS ext FROM ({_CODE_LINES}) d JOIN code_normalized_event e ON e.delivery_id::VARCHAR = d.id)"""
_SYMBOLS = rf"""WITH files AS MATERIALIZED ({_FILES}),
    rows AS MATERIALIZED (SELECT path, lang, n, t, line, strlen(line) - strlen(regexp_replace(line, '^[{WS}]+', '')) AS indent FROM
        (SELECT path, lang, line, n, {_TRIMMED} AS t FROM (SELECT path, lang, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS n FROM files WHERE lang IS NOT NULL))),
    rust AS (SELECT *, regexp_extract(t, '^impl [<\s]*(?:.*? for )?([^<{{\s]+)', 1) AS name FROM rows WHERE lang = 'rust'),
    rust_scope AS (SELECT *, last_value(CASE WHEN t LIKE 'impl %' AND name <> '' THEN name WHEN t = '}}' THEN '' END IGNORE NULLS) OVER (PARTITION BY path ORDER BY n) AS scope FROM rust),
    py AS (SELECT *, CASE WHEN t LIKE 'class %' THEN regexp_extract(t, '^class ([^(:\s]+)', 1) ELSE '' END AS name FROM rows WHERE lang = 'python'),
    py_group AS (SELECT *, count_if(name <> '') OVER (PARTITION BY path ORDER BY n) AS g FROM py),
    py_scope AS (SELECT *, first_value(name) OVER w AS class, first_value(indent) OVER w AS depth, min(CASE WHEN name = '' AND t <> '' AND t NOT LIKE 'class %' THEN indent END) OVER w AS least
        FROM py_group WINDOW w AS (PARTITION BY path, g ORDER BY n)),
    js AS (SELECT *, regexp_extract(t, '^(?:export )?class ([^{{ <]+)', 1) AS name FROM rows WHERE lang = 'js'),
    js_scope AS (SELECT *, CASE WHEN name <> '' THEN name ELSE coalesce(last_value(CASE WHEN t = '}}' THEN '' WHEN name <> '' THEN name END IGNORE NULLS) OVER (PARTITION BY path ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') END AS scope,
        coalesce(nullif(CASE WHEN regexp_matches(t, '^(?:const|let|var) [^ =:]+.*=>') THEN regexp_extract(t, '^(?:const|let|var) ([^ =:]+)', 1) ELSE '' END, ''),
            regexp_extract(t, '^(?:export )?(?:async )?function ([^(<\s]+)', 1)) AS f FROM js),
    found AS (
        SELECT path, regexp_extract(t, '^(?:pub )?(?:(?:async|const|unsafe) )?fn ([^(<\s]+)', 1) AS name, CASE WHEN coalesce(scope, '') <> '' THEN 'method' ELSE 'function' END AS symbol_type, n AS line, nullif(scope, '') AS parent FROM rust_scope
        UNION ALL SELECT path, regexp_extract(t, '^(?:pub )?(?:struct|enum|trait|type) ([^<{{(\s]+)', 1), regexp_extract(t, '^(?:pub )?(struct|enum|trait|type) ', 1), n, NULL FROM rust
        UNION ALL SELECT path, name, 'class', n, NULL FROM py
        UNION ALL SELECT path, regexp_extract(t, '^(?:async )?def ([^(\s]+)', 1), CASE WHEN g > 0 AND (least IS NULL OR least > depth) THEN 'method' ELSE 'function' END, n, CASE WHEN g > 0 AND (least IS NULL OR least > depth) THEN class END FROM py_scope
        UNION ALL SELECT path, name, 'class', n, NULL FROM js
        UNION ALL SELECT path, f, CASE WHEN scope <> '' THEN 'method' ELSE 'function' END, n, nullif(scope, '') FROM js_scope
        UNION ALL SELECT path, regexp_extract(t, '^(?:export )?(?:interface|type) ([^<{{=\s]+)', 1), 'interface', n, NULL FROM js)
    SELECT path, name, symbol_type, line::INTEGER AS line, parent FROM found WHERE name <> ''"""
SQL |= {
    "code_symbols": _SYMBOLS,
    "symbol_index": f"SELECT name, path, count(*) AS n_definitions FROM ({_SYMBOLS}) GROUP BY name, path",
    "file_symbols": f"""SELECT path, count(*)::INTEGER AS n, string_agg(concat_ws(' ', line, name, symbol_type, parent), chr(10) ORDER BY line, name, symbol_type, parent NULLS FIRST) AS symbols
        FROM ({_SYMBOLS}) GROUP BY path""",
    "nesting_depth": r"""SELECT delivery_id::VARCHAR AS id, list_reduce(list_concat([{'d': 0, 'm': 0}], list_transform(regexp_extract_all(normalized_content, '[{(\[\])}]'), lambda c: {'d': CASE WHEN c IN ('{', '(', '[') THEN 1 ELSE -1 END, 'm': 0})),
        lambda a, b: {'d': greatest(0, a.d + b.d), 'm': greatest(a.m, a.d + b.d)}).m::INTEGER AS depth FROM code_normalized_event WHERE normalized_content <> ''""",
    "ring_stats": """SELECT 6 AS num_partitions, 150 AS virtual_nodes, sum(n)::BIGINT AS total_ring_entries, var_pop(n) AS variance, stddev_pop(n) AS std_dev
        FROM (SELECT i // 150 AS p, count(*) AS n FROM range(900) t(i) GROUP BY 1)""",
    "circuit_breaker": """WITH RECURSIVE calls AS MATERIALIZED (SELECT user_id::VARCHAR AS service, epoch_us(ts) / 1e6 AS moment, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE ts IS NOT NULL),
        walk AS (SELECT service, 0::BIGINT AS i, 'closed' AS state, 0 AS failures, 0 AS retries, 0 AS trials, 0::DOUBLE AS again, true AS allowed FROM (SELECT DISTINCT service FROM calls)
            UNION ALL SELECT service, i, CASE WHEN NOT let THEN state WHEN ok AND state = 'half_open' AND trials + 1 >= 3 THEN 'closed' WHEN NOT ok AND (state = 'half_open' OR state = 'closed' AND failures + 1 >= 2) THEN 'open' ELSE state END,
                CASE WHEN NOT let THEN failures WHEN ok THEN CASE WHEN state = 'half_open' AND trials + 1 >= 3 THEN 0 ELSE failures END ELSE failures + 1 END,
                CASE WHEN NOT let THEN retries WHEN ok THEN CASE WHEN state = 'half_open' AND trials + 1 >= 3 THEN 0 ELSE retries END WHEN state = 'half_open' OR state = 'closed' AND failures + 1 >= 2 THEN retries + 1 ELSE retries END,
                CASE WHEN let AND ok AND state = 'half_open' THEN trials + 1 ELSE trials END,
                CASE WHEN let AND NOT ok AND (state = 'half_open' OR state = 'closed' AND failures + 1 >= 2) THEN moment + floor(least(30 * power(2, least(retries, 60)), 300)) ELSE again END, let
            FROM (SELECT c.service, c.i, c.moment, c.ok, w.failures, w.retries, w.again, CASE WHEN w.state = 'open' AND c.moment >= w.again THEN 0 ELSE w.trials END AS trials,
                CASE WHEN w.state = 'open' AND c.moment >= w.again THEN 'half_open' ELSE w.state END AS state, w.state = 'closed' OR w.state = 'open' AND c.moment >= w.again OR w.state = 'half_open' AND w.trials < 3 AS let
                FROM walk w JOIN calls c ON c.service = w.service AND c.i = w.i + 1))
        SELECT service, state, allowed, count(*) AS n FROM walk WHERE i > 0 GROUP BY ALL""",
}

# Bytes as hexadecimal pairs: the longest prefix of whole pairs that ends as wanted.
_CUT = r"""CASE WHEN length({0}) <= 4000 THEN {0} WHEN regexp_matches(left({0}, 4000), '^(?:..)*0A0A') THEN regexp_extract(left({0}, 4000), '^((?:..)*0A0A)', 1)
    WHEN regexp_matches(left({0}, 4000), '^(?:..)*0A') THEN regexp_extract(left({0}, 4000), '^((?:..)*0A)', 1)
    WHEN substring({0}, 4001, 1) IN ('8', '9', 'A', 'B') THEN regexp_replace(left({0}, 4000), '[C-F].(?:[89AB].){{0,2}}$', '') ELSE left({0}, 4000) END"""
SQL["large_item_split"] = f"""WITH RECURSIVE src AS MATERIALIZED (SELECT id AS item, hex(encode(any_value(content))) AS h FROM source_item WHERE content <> '' GROUP BY id),
    walk AS (SELECT item, 0 AS piece_no, 0::BIGINT AS start_offset, {_CUT.format('h')} AS piece, h AS rest FROM src
        UNION ALL SELECT item, piece_no + 1, start_offset + length(piece) // 2, {_CUT.format('r')}, r FROM (SELECT *, substring(rest, length(piece) + 1) AS r FROM walk) WHERE r <> '')
    SELECT item, piece_no::INTEGER AS piece_no, start_offset, decode(unhex(piece)) AS content FROM walk"""

# Code by entities: what fits, what is cut by lines, the gaps, and files without entities, numbered in that order.
_PREFIX = f"list_concat([0], list_transform(range(1, len({{0}}) + 1), lambda k: list_sum(list_transform({{0}}[1:k], lambda x: {_COUNT.format('x')}))::BIGINT))"
_REACH = "coalesce(list_min(list_filter(range({0} + 1, n + 1), lambda e: p[e + 1] - p[{0} + 1] >= 128)), n)"
SQL["code_entity_chunks"] = f"""WITH RECURSIVE f AS MATERIALIZED (SELECT id, l, entities FROM ({_CODE_LINES}) WHERE len(l) > 0),
    ent AS (SELECT id, ord, s, t, name, type, l[greatest(0, s - 1) + 1 : least(t, len(l))] AS own FROM (SELECT id, l, u.i AS ord, entities[u.i].start_line AS s, entities[u.i].end_line AS t, entities[u.i].name AS name,
        entities[u.i].entity_type AS type FROM f, UNNEST(range(1, len(entities) + 1)) AS u(i)) WHERE s IS NOT NULL AND t IS NOT NULL AND greatest(0, s - 1) < least(t, len(l))),
    sized AS (SELECT *, list_sum(list_transform(own, lambda x: {_COUNT.format('x')})) AS total FROM ent),
    cut AS (SELECT id, ord, s, name, type, CASE WHEN own[-1] = '' THEN own[:-2] ELSE own END AS own FROM sized WHERE total > 128
        UNION ALL SELECT id, 0, 1, NULL, NULL, l FROM f WHERE coalesce(len(entities), 0) = 0),
    todo AS MATERIALIZED (SELECT id, ord, s, name, type, own, len(own) AS n, {_PREFIX.format('own')} AS p FROM cut),
    walk AS (SELECT id, ord, 0 AS sub, 0::BIGINT AS x, {_REACH.format('0')} AS y FROM todo
        UNION ALL SELECT id, ord, sub + 1, z, {_REACH.format('z')} FROM (SELECT walk.id, walk.ord, sub, n, p, CASE WHEN y - least(3, y - x) <= x THEN y ELSE y - least(3, y - x) END AS z
            FROM walk JOIN todo ON todo.id = walk.id AND todo.ord = walk.ord) WHERE z < n),
    rows AS (SELECT id, unnest(l) AS line, generate_subscripts(l, 1) AS n, entities FROM f WHERE len(entities) > 0),
    free AS (SELECT id, line, n, coalesce(list_bool_or(list_transform(entities, lambda e: coalesce(e.start_line IS NOT NULL AND n BETWEEN greatest(e.start_line, 1) AND e.end_line, false))), false) AS covered FROM rows),
    runs AS (SELECT *, sum(covered::INTEGER) OVER (PARTITION BY id ORDER BY n) AS run FROM free),
    made AS (SELECT id, 0 AS late, ord, 0 AS sub, array_to_string(own, chr(10)) AS content, s AS line_start, t AS line_end, name AS symbol_name, type AS meta_type, total AS token_count FROM sized WHERE total <= 128
        UNION ALL SELECT w.id, 0, w.ord, sub, array_to_string(own[x + 1:y], chr(10)), s + x, s + y - 1, name, type, p[y + 1] - p[x + 1] FROM walk w JOIN todo ON todo.id = w.id AND todo.ord = w.ord
        UNION ALL SELECT id, 1, min(n), 0, string_agg(line, chr(10) ORDER BY n), min(n), max(n), NULL, NULL, sum({_COUNT.format('line')}) FROM runs WHERE NOT covered GROUP BY id, run HAVING sum({_COUNT.format('line')}) > 10)
    SELECT id AS item, (row_number() OVER (PARTITION BY id ORDER BY late, ord, sub) - 1)::INTEGER AS chunk_index, content, line_start::INTEGER AS line_start, line_end::INTEGER AS line_end, symbol_name, meta_type, token_count::INTEGER AS token_count FROM made"""
for _name, _head, _row in (("csv_chunks", "'key,name' || chr(10)", "s_suppkey || ',' || s_name"), ("markdown_table_chunks", "'| key | name |' || chr(10) || '| --- | --- |' || chr(10)", "'| ' || s_suppkey || ' | ' || s_name || ' |'")):
    _made = _packed(f"SELECT n_name AS item, row_number() OVER (PARTITION BY n_name ORDER BY s_suppkey) AS i, {_row} AS s, {_COUNT.format(_row)} AS w FROM supplier JOIN nation ON s_nationkey = n_nationkey",
                    f"(64 - {_COUNT.format(_head)})", "chr(10)")
    SQL[_name] = f"""SELECT item, chunk_index, {_head} || content || chr(10) AS content, start_index::BIGINT AS start_index, (start_index + strlen({_head}) + strlen(content) + 1)::BIGINT AS end_index FROM (
        SELECT *, coalesce(sum(strlen(content) + 1) OVER (PARTITION BY item ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_index FROM ({_made}))"""

_PLACE = "('0x' || left(md5({0}), 15))::BIGINT"
SQL["ring_partitions"] = f"""WITH points AS (SELECT {_PLACE.format("'partition-' || p || '-vnode-' || v")} AS h, max(p) AS p FROM range(6) a(p), range(150) b(v) GROUP BY 1),
    keys AS (SELECT DISTINCT id, {_PLACE.format('id')} AS h FROM chunk)
    SELECT coalesce(p, (SELECT arg_min(p, h) FROM points))::INTEGER AS partition, count(*) AS n FROM keys ASOF LEFT JOIN points ON keys.h <= points.h GROUP BY 1"""
SQL["batch_event_chunks"] = SQL["stream_event_chunks"] = f"""SELECT item AS event_id, concat_ws('-', h[1:8], h[9:12], h[13:16], h[17:20], h[21:32]) AS chunk_id, chunk_index, content, token_count, line_start AS start_line, line_end AS end_line
    FROM (SELECT *, md5(item || chr(31) || chunk_index || chr(31) || 'code') AS h FROM ({SQL['code_entity_chunks']}))"""
_SPLIT_NAMES = "list_filter(list_transform(string_split({0}, ','), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '' AND x <> '*')"
SQL["file_imports"] = rf"""WITH lines AS (SELECT path, lang, n, regexp_replace(line, '^[{WS}]+|[{WS}]+$', '', 'g') AS t FROM (SELECT d.id AS path, CASE {_EXT} END AS lang, unnest(d.l) AS line, generate_subscripts(d.l, 1) AS n
        FROM ({_CODE_LINES}) d JOIN (SELECT *, lower(string_split(file_path, '.')[-1]) AS ext FROM code_normalized_event) e ON e.delivery_id::VARCHAR = d.id)),
    rust AS (SELECT path, regexp_extract(t, '^(?:pub )?use ([\w:]+?)(?:::(\{{[^}}]*\}}|\*))?;', 1) AS module_path, regexp_extract(t, '^(?:pub )?use ([\w:]+?)(?:::(\{{[^}}]*\}}|\*))?;', 2) AS what
        FROM lines WHERE lang = 'rust' AND regexp_matches(t, '^(?:pub )?use ([\w:]+?)(?:::(\{{[^}}]*\}}|\*))?;')),
    python AS (SELECT path, coalesce(nullif(regexp_extract(t, '^from ([\w.]+) import (.+)', 1), ''), regexp_extract(t, '^import ([\w.]+)', 1)) AS module_path, regexp_extract(t, '^from ([\w.]+) import (.+)', 2) AS what
        FROM lines WHERE lang = 'python' AND regexp_matches(t, '^(?:from ([\w.]+) import (.+)|import ([\w.]+))')),
    js AS (SELECT path, regexp_extract(t, '{{0}}', 2) AS module_path, regexp_extract(t, '{{0}}', 1) AS what FROM lines WHERE lang IN ('javascript', 'typescript') AND regexp_matches(t, '{{0}}'))
    SELECT path, module_path, array_to_string({_SPLIT_NAMES.format("trim(what, '{}')")}, ',') AS symbols, what = '*' AS is_wildcard FROM rust
    UNION ALL SELECT path, module_path, array_to_string({_SPLIT_NAMES.format("trim(what, '()')")}, ',') AS symbols, list_contains(list_transform(string_split(trim(what, '()'), ','), lambda x: trim(x)), '*') AS is_wildcard FROM python
    UNION ALL SELECT path, module_path, array_to_string({_SPLIT_NAMES.format("trim(what, '{} ')")}, ',') AS symbols, what = '*' AS is_wildcard FROM js""".replace(
    "{0}", r"^import (?:(\*|[\w{},\s]+?)(?: as \w+)? from )?[''\"]([^''\"]+)[''\"]")

# Agentic: the strongest boundary line since the last cut, once the limit is reached; bytes as hexadecimal pairs.
_STRENGTH = f"""CASE WHEN t = '' THEN 0.2 WHEN t LIKE '#%' THEN 1::FLOAT - length(regexp_extract(t, '^#+'))::FLOAT * 0.1::FLOAT WHEN regexp_matches(t, '^(pub )?(async )?fn ') THEN 0.8
    WHEN regexp_matches(t, '^(pub )?impl ') THEN 0.85 WHEN regexp_matches(t, '^(pub )?(struct|enum) ') THEN 0.9 WHEN regexp_matches(t, '^(class|interface) ') THEN 0.9
    WHEN regexp_matches(t, '^(async )?def ') THEN 0.8 WHEN regexp_matches(t, '^(pub )?mod ') THEN 0.95 WHEN regexp_matches(t, '^(///|//!|/\\*)') THEN 0.3 ELSE -1 END::FLOAT"""
_BACK = " ".join(f"WHEN k >= {n} AND substring(h, 2 * (k - {n}) + 1, 1) NOT IN ('8', '9', 'A', 'B') THEN k - {n}" for n in range(4))
SQL["agentic_chunks"] = f"""WITH RECURSIVE f AS MATERIALIZED (SELECT d.id, l, {_COUNT.format('e.normalized_content')} AS total, hex(encode(e.normalized_content)) AS h
        FROM ({_CODE_LINES}) d JOIN code_normalized_event e ON e.delivery_id::VARCHAR = d.id),
    g AS MATERIALIZED (SELECT id, h, length(h) // 2 AS size, len(l) AS n, list_transform(l, lambda x: {_COUNT.format('x')}) AS c,
        list_transform(range(1, len(l) + 1), lambda k: list_sum(list_transform(l[1:k], lambda x: strlen(x) + 1))::BIGINT) AS ends,
        list_transform(list_transform(l, lambda x: regexp_replace(x, '^[{WS}]+|[{WS}]+$', '', 'g')), lambda t: {_STRENGTH}) AS s FROM f WHERE total > 128),
    walk AS (SELECT id, 0::BIGINT AS i, 0::BIGINT AS a, 0::BIGINT AS b, 0::BIGINT AS since, 0::BIGINT AS held, false AS made FROM g
        UNION ALL SELECT id, i, start, CASE WHEN full_ THEN CASE WHEN k >= size THEN size {_BACK} END ELSE start END, CASE WHEN full_ THEN best ELSE since END, CASE WHEN full_ THEN 0 ELSE held END, full_ FROM (
            SELECT id, i, start, since, held, full_, h, size, best, least(ends[best], size) AS k FROM (
                SELECT g.id, w.i + 1 AS i, greatest(w.a, w.b) AS start, w.since, w.held + c[w.i + 1] AS held, w.held + c[w.i + 1] >= 128 AS full_, h, size, ends,
                    list_max(list_transform(range(w.since + 1, w.i + 2), lambda k: {{'s': s[k], 'k': k}})).k AS best
                FROM walk w JOIN g ON g.id = w.id AND w.i < g.n))),
    spans AS (SELECT id, a, b FROM walk WHERE made AND b > a UNION ALL SELECT g.id, z, size FROM g JOIN (SELECT id, max(greatest(a, b)) AS z FROM walk GROUP BY id) e ON e.id = g.id WHERE z < size),
    texts AS (SELECT id, a, b, decode(unhex(substring(h, 2 * a + 1, 2 * (b - a)))) AS t FROM spans JOIN f USING (id)
        UNION ALL SELECT id, 0, length(h) // 2, decode(unhex(h)) FROM f WHERE total <= 128),
    kept AS (SELECT texts.*, row_number() OVER (PARTITION BY id ORDER BY a) - 1 AS i, count(*) OVER (PARTITION BY id) AS n FROM texts JOIN f USING (id) WHERE total <= 128 OR regexp_matches(t, '[^{WS}]')),
    heads AS (SELECT id, list_filter({_LINES.format('t')}, lambda x: regexp_matches(regexp_replace(x, '^[{WS}]+', ''), '^(use |import |from |#include)')) AS imports FROM kept WHERE i = 0 AND n > 1),
    done AS (SELECT kept.id, i, a, b, CASE WHEN i > 0 AND len(imports) > 0 AND (contains(t, 'fn ') OR contains(t, 'def ') OR contains(t, 'class ')) THEN '// Context:' || chr(10) || array_to_string(imports, chr(10)) || chr(10) || chr(10) || t ELSE t END AS content
        FROM kept LEFT JOIN heads ON heads.id = kept.id)
    SELECT id AS item, i::INTEGER AS chunk_index, content, {_COUNT.format('content')}::INTEGER AS token_count, a::BIGINT AS start_index, b::BIGINT AS end_index FROM done"""

_ONCE = "SELECT id, any_value(content) AS content, any_value(content_type) AS content_type FROM source_item WHERE content <> '' GROUP BY id"


def _strip(text: str) -> str:
    return rf"regexp_replace({text}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def _document_sql(source: str, size: int) -> str:
    """Documents: sections by headings; those above the limit by paragraphs, and paragraphs above it by sentences that begin a group of their own."""
    return rf"""WITH RECURSIVE lines AS (SELECT id, unnest(l) AS line, generate_subscripts(l, 1) AS n FROM (SELECT id, {_LINES.format('content')} AS l FROM ({source}))),
    fenced AS (SELECT *, sum(starts_with(line, '```')::INTEGER) OVER (PARTITION BY id ORDER BY n) % 2 = 1 AS inside FROM lines),
    marked AS (SELECT *, NOT inside AND regexp_matches(line, '^#{{1,6}}[{WS}]+.+$') AS heading FROM fenced),
    numbered AS (SELECT *, sum(heading::INTEGER) OVER (PARTITION BY id ORDER BY n) AS section FROM marked),
    sec AS MATERIALIZED (SELECT id, section, string_agg(line || chr(10), '' ORDER BY n) AS body, max(CASE WHEN heading THEN regexp_extract(line, '^(#{{1,6}})', 1) END) AS marks,
        max(CASE WHEN heading THEN regexp_extract(line, '^#{{1,6}}[{WS}]+(.+)$', 1) END) AS title FROM numbered GROUP BY id, section HAVING bool_or(regexp_matches(line, '[^{WS}]'))),
    paras AS (SELECT id, section, o, p, {_COUNT.format('p')} AS w FROM (SELECT id, section, generate_subscripts(x, 1) AS o, unnest(x) AS p
        FROM (SELECT id, section, list_filter(list_transform(string_split(body, chr(10) || chr(10)), lambda x: {_strip('x')}), lambda x: x <> '') AS x FROM sec WHERE {_COUNT.format('body')} > {size}))),
    seg AS (SELECT id, section, o, 0 AS q, p AS s, w, false AS fresh, true AS whole FROM paras WHERE w <= {size}
        UNION ALL SELECT id, section, o, q, s, {_COUNT.format('s')}, q = 1, false FROM (SELECT id, section, o, generate_subscripts(x, 1) AS q, unnest(x) AS s
            FROM (SELECT id, section, o, list_filter(list_transform(regexp_extract_all(p, '[^.!?]*[.!?]|[^.!?]+'), lambda x: {_strip('x')}), lambda x: x <> '') AS x FROM paras WHERE w > {size}))),
    grouped AS (SELECT *, sum(fresh::INTEGER) OVER (PARTITION BY id, section ORDER BY o, q) AS g FROM seg),
    ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY id, section, g ORDER BY o, q) AS i FROM grouped),
    walk AS (SELECT id, section, g, i, CASE WHEN whole THEN s ELSE s || ' ' END AS t, w AS held, 0 AS k FROM ranked WHERE i = 1
        UNION ALL SELECT r.id, r.section, r.g, r.i, CASE WHEN held + r.w > {size} THEN '' ELSE t END || CASE WHEN NOT whole THEN s || ' ' WHEN held + r.w > {size} THEN s ELSE chr(10) || chr(10) || s END,
            CASE WHEN held + r.w > {size} THEN r.w ELSE held + r.w END, k + CASE WHEN held + r.w > {size} THEN 1 ELSE 0 END
        FROM walk w JOIN ranked r ON r.id = w.id AND r.section = w.section AND r.g = w.g AND r.i = w.i + 1),
    made AS (SELECT id, section, g, k, arg_max(t, i) AS t FROM walk GROUP BY id, section, g, k),
    texts AS (SELECT m.id, m.section, g, k, title, CASE WHEN title IS NOT NULL AND row_number() OVER (PARTITION BY m.id, m.section ORDER BY g, k) = 1 THEN marks || ' ' || title || chr(10) || chr(10) || t ELSE t END AS content
        FROM made m JOIN sec ON sec.id = m.id AND sec.section = m.section UNION ALL SELECT id, section, 0, 0, title, body FROM sec WHERE {_COUNT.format('body')} <= {size})
    SELECT id AS item, (row_number() OVER (PARTITION BY id ORDER BY section, g, k) - 1)::INTEGER AS chunk_index, content, {_COUNT.format('content')}::INTEGER AS token_count, title AS section FROM texts"""


def _recursive_sql(source: str, size: int) -> str:
    """Each separator in turn: what is too large is split by it and its parts are joined again as far as they fit; at last, cuts within words."""
    steps = [f"WITH RECURSIVE todo0 AS (SELECT id, []::BIGINT[] AS path, content AS t FROM ({source}))"]
    for k, sep in enumerate(("\n\n", "\n", ". ", "! ", "? ", "; ", ", ", " ")):
        text = f"'{sep}'" if "\n" not in sep else " || ".join(["chr(10)"] * len(sep))
        glue = len([c for c in sep if not c.isspace()])
        steps.append(f"""big{k} AS MATERIALIZED (SELECT id, path, string_split(t, {text}) AS p FROM todo{k} WHERE {_COUNT.format('t')} > {size}),
            part{k} AS MATERIALIZED (SELECT id, path, i, s, {_COUNT.format('s')} AS n FROM (SELECT id, path, generate_subscripts(p, 1) AS i, unnest(p) AS s FROM big{k} WHERE len(p) > 1)),
            fold{k} AS (SELECT id, path, 0::BIGINT AS i, '' AS held, 0::BIGINT AS total, NULL::VARCHAR AS shut, NULL::VARCHAR AS big FROM big{k} WHERE len(p) > 1
                UNION ALL SELECT f.id, f.path, p.i, CASE WHEN x.joined <= {size} THEN CASE WHEN held = '' THEN s ELSE held || {text} || s END WHEN n > {size} THEN '' ELSE s END,
                    CASE WHEN x.joined <= {size} THEN x.joined WHEN n > {size} THEN 0 ELSE n END, CASE WHEN x.joined > {size} AND held <> '' THEN held END, CASE WHEN x.joined > {size} AND n > {size} THEN s END
                FROM fold{k} f JOIN part{k} p ON p.id = f.id AND p.path = f.path AND p.i = f.i + 1, LATERAL (SELECT CASE WHEN held = '' THEN n ELSE total + {glue} + n END AS joined) x),
            done{k} AS (SELECT id, path, t FROM todo{k} WHERE {_COUNT.format('t')} <= {size} AND t <> ''
                UNION ALL SELECT id, list_append(path, 2 * i), shut FROM fold{k} WHERE shut IS NOT NULL
                UNION ALL SELECT id, list_append(path, 2 * i + 2), held FROM (SELECT id, path, max(i) AS i, arg_max(held, i) AS held FROM fold{k} GROUP BY id, path) WHERE held <> ''),
            todo{k + 1} AS (SELECT id, list_append(path, 2 * i + 1) AS path, big AS t FROM fold{k} WHERE big IS NOT NULL UNION ALL SELECT id, path, p[1] FROM big{k} WHERE len(p) = 1)""")
    first = rf"'^(?:\s*(?:\w+\b|[^\w\s])){{{size - 1}}}\s*\S'"
    cut = f"CASE WHEN {_COUNT.format('{0}')} >= {size} THEN regexp_extract({{0}}, {first}) ELSE {{0}} END"
    steps.append(f"""chars AS (SELECT id, path, 0::BIGINT AS i, {cut.replace('{0}', 't')} AS t, t AS rest FROM todo8 WHERE {_COUNT.format('t')} > {size}
        UNION ALL SELECT id, path, i + 1, {cut.replace('{0}', 'r')}, r FROM (SELECT id, path, i, substring(rest, length(t) + 1) AS r FROM chars) WHERE r <> ''),
        made AS ({' UNION ALL '.join(f'SELECT id, path, t FROM done{k}' for k in range(8))} UNION ALL SELECT id, path, t FROM todo8 WHERE {_COUNT.format('t')} <= {size} AND t <> ''
            UNION ALL SELECT id, list_append(path, i), t FROM chars),
        placed AS (SELECT id, path, t, sum(strlen(t)) OVER (PARTITION BY id ORDER BY path) AS e FROM made)""")
    return ", ".join(steps) + f""" SELECT id AS item, (row_number() OVER (PARTITION BY id ORDER BY path) - 1)::INTEGER AS chunk_index, t AS content, {_COUNT.format('t')}::INTEGER AS token_count,
        (e - strlen(t))::BIGINT AS start_index, e::BIGINT AS end_index FROM placed"""


SQL["document_chunks"] = _document_sql(_ONCE, SIZE)
SQL["recursive_chunks"] = _recursive_sql(_ONCE, SIZE)


def _ticket_sql(source: str, size: int) -> str:
    """Tickets from JSON or from field lines and the parts they open, rendered and packed."""
    texts = ("key", "title", "description", "status", "priority", "assignee", "reporter")
    typed = lambda path: f"coalesce(json_type(content, '$.{path}'), 'NULL') IN ('NULL', 'VARCHAR')"
    is_ticket = f"""contains(coalesce(content_type, ''), 'json') AND CASE WHEN json_valid(content) THEN json_type(content) = 'OBJECT' AND {' AND '.join(map(typed, texts))}
        AND coalesce(json_type(content, '$.comments'), 'ARRAY') = 'ARRAY' AND coalesce(list_bool_and(list_transform(json_extract(content, '$.comments[*]'),
            lambda c: json_type(c) = 'OBJECT' AND coalesce(json_type(c, '$.body'), '') = 'VARCHAR' AND coalesce(json_type(c, '$.author'), 'NULL') IN ('NULL', 'VARCHAR'))), true) ELSE false END"""
    fields = ", ".join(f"json_extract_string(content, '$.{k}') AS {k}" for k in texts[:6])
    label = "CASE WHEN contains(t, ':') THEN string_split(t, ':')[1] END"
    named = "CASE label WHEN 'Title' THEN 'title' WHEN 'Summary' THEN 'title' WHEN 'Status' THEN 'status' WHEN 'Priority' THEN 'priority' WHEN 'Assignee' THEN 'assignee' WHEN 'Reporter' THEN 'reporter' WHEN 'Author' THEN 'reporter' END"
    value = _strip("substring(t, length(label) + 2)")
    last = ", ".join(f"arg_max(v, n) FILTER (field = '{k}') AS {k}" for k in ("title", "status", "priority", "assignee"))
    return rf"""WITH RECURSIVE src AS MATERIALIZED (SELECT id, content, {is_ticket} AS as_json FROM ({source})),
    lines AS (SELECT id, n, t, {label} AS label FROM (SELECT id, generate_subscripts(l, 1) AS n, {_strip('unnest(l)')} AS t FROM (SELECT id, {_LINES.format('content')} AS l FROM src WHERE NOT as_json))),
    told AS (SELECT *, {named} AS field, {value} AS v, CASE label WHEN 'Description' THEN 'description' WHEN 'Comments' THEN 'comments' WHEN 'Discussion' THEN 'comments' END AS part FROM lines),
    placed AS (SELECT *, count(part) OVER (PARTITION BY id ORDER BY n) AS p, coalesce(last_value(part IGNORE NULLS) OVER (PARTITION BY id ORDER BY n), 'description') AS name FROM told),
    rows AS (SELECT *, field IS NULL AND part IS NULL AND name = 'comments' AND starts_with(t, '- ') AS listed FROM placed),
    bodies AS (SELECT id, p, any_value(name) AS name, bool_or(listed) AS lists,
        ltrim(string_agg(CASE WHEN part = 'description' THEN v WHEN part IS NOT NULL THEN '' ELSE t END, chr(10) ORDER BY n) FILTER (field IS NULL AND NOT listed), chr(10)) AS body FROM rows GROUP BY id, p),
    opening AS (SELECT id, arg_min(body, p) AS body FROM bodies b WHERE name = 'comments' AND body <> '' AND NOT EXISTS (FROM bodies e WHERE e.id = b.id AND e.p <= b.p AND e.lists) GROUP BY id),
    listed AS (SELECT id, list({{'author': NULL::VARCHAR, 'body': t[3:]}} ORDER BY n) AS c FROM rows WHERE listed GROUP BY id),
    heads AS (SELECT id, {last} FROM rows GROUP BY id),
    told_tickets AS (SELECT s.id, NULL::VARCHAR AS key, title, d.body AS description, status, priority, assignee, s.content,
        list_concat(CASE WHEN o.body IS NOT NULL THEN [{{'author': NULL::VARCHAR, 'body': o.body}}] ELSE [] END, coalesce(listed.c, [])) AS comments
        FROM src s LEFT JOIN heads ON heads.id = s.id LEFT JOIN (SELECT id, arg_max(body, p) AS body FROM bodies WHERE name = 'description' AND body <> '' GROUP BY id) d ON d.id = s.id
        LEFT JOIN opening o ON o.id = s.id LEFT JOIN listed ON listed.id = s.id WHERE NOT as_json),
    tickets AS MATERIALIZED (SELECT id, key, title, CASE WHEN title IS NULL AND description IS NULL AND len(comments) = 0 THEN content ELSE description END AS description, status, priority, assignee, comments, content FROM told_tickets
        UNION ALL SELECT id, {fields},
            coalesce(list_transform(json_extract(content, '$.comments[*]'), lambda c: {{'author': json_extract_string(c, '$.author'), 'body': json_extract_string(c, '$.body')}}), []), content FROM src WHERE as_json),
    told_text AS (SELECT id, concat_ws(chr(10), '# ' || title, '**Ticket**: ' || key, '**Status**: ' || status, '**Priority**: ' || priority, '**Assignee**: ' || assignee)
        || chr(10) || chr(10) || '## Description' || chr(10) || chr(10) || description AS t FROM tickets WHERE description IS NOT NULL),
    seg AS MATERIALIZED (SELECT id, i, s, {_COUNT.format('s')} AS w FROM (SELECT id, generate_subscripts(x, 1) AS i, unnest(x) AS s FROM (SELECT id, string_split(t, '. ') AS x FROM told_text WHERE {_COUNT.format('t')} > {size}))),
    walk AS (SELECT id, i, s AS t, w AS held, 0 AS k FROM seg WHERE i = 1
        UNION ALL SELECT p.id, p.i, CASE WHEN held + p.w > {size} THEN s ELSE t || '. ' || s END, CASE WHEN held + p.w > {size} THEN p.w ELSE held + p.w END, k + CASE WHEN held + p.w > {size} THEN 1 ELSE 0 END
        FROM walk w JOIN seg p ON p.id = w.id AND p.i = w.i + 1),
    together AS (SELECT id, comments, '## Comments' || chr(10) || chr(10) || array_to_string(list_transform(comments, lambda c: coalesce('**' || c.author || '**:' || chr(10), '') || c.body || chr(10) || chr(10) || '---' || chr(10) || chr(10)), '') AS t
        FROM tickets WHERE len(comments) > 0),
    made AS (SELECT id, 0 AS o, 0 AS k, t AS content, {_COUNT.format('t')} AS n, 'description' AS meta_type, NULL AS author FROM told_text WHERE {_COUNT.format('t')} <= {size}
        UNION ALL SELECT id, 0, k, arg_max(t, i), arg_max(held, i), 'description', NULL FROM walk GROUP BY id, k
        UNION ALL SELECT id, 1, 0, t, {_COUNT.format('t')}, 'comments', NULL FROM together WHERE {_COUNT.format('t')} <= {size}
        UNION ALL SELECT id, 1, k, content, {_COUNT.format('content')}, 'comment', author FROM (SELECT id, k, c.author AS author, coalesce('**' || c.author || '**: ', '') || c.body AS content
            FROM (SELECT id, generate_subscripts(comments, 1) AS k, unnest(comments) AS c FROM together WHERE {_COUNT.format('t')} > {size}))
        UNION ALL SELECT id, 2, 0, content, {_COUNT.format('content')}, NULL, NULL FROM tickets WHERE description IS NULL AND len(comments) = 0)
    SELECT id AS item, (row_number() OVER (PARTITION BY id ORDER BY o, k) - 1)::INTEGER AS chunk_index, content, n::INTEGER AS token_count, meta_type, author FROM made"""


SQL["ticket_chunks"] = _ticket_sql(_ONCE, SIZE)

_UUID_FORM = "concat_ws('-', h[1:8], h[9:12], h[13:16], h[17:20], h[21:32])"
_ONE_CHUNK = "SELECT id, any_value(content) AS content, any_value(metadata) AS metadata FROM chunk GROUP BY id"
SQL |= {
    "connector_items": f"""SELECT {_UUID_FORM} AS id, source_kind, content_type, content FROM (
        SELECT md5('repo:' || file_path || '@' || delivery_id) AS h, 'code_repo' AS source_kind, 'text/code:' || coalesce(CASE {_EXT} END, 'text') AS content_type, normalized_content AS content
            FROM (SELECT *, lower(string_split(file_path || '@' || delivery_id, '.')[-1]) AS ext FROM code_normalized_event WHERE file_path IS NOT NULL AND normalized_content IS NOT NULL)
        UNION ALL SELECT md5('notion:' || doc_id), 'wiki', 'text/markdown', text FROM documents WHERE text IS NOT NULL
        UNION ALL SELECT md5(concat_ws(':', 'slack', coalesce(channel, ''), coalesce(thread_ts, messages[1].ts))), 'chat', 'application/json', NULL
            FROM (SELECT thread_id, any_value(channel) AS channel, any_value(thread_ts) AS thread_ts, any_value(messages) AS messages FROM chat_thread GROUP BY thread_id))""",
    "chunk_metadata": f"""SELECT id, 'code' AS content_type, metadata.path AS path, metadata.language AS language, metadata.symbol_name AS symbol_name, metadata.parent_symbol AS parent_symbol,
        metadata.line_range.start AS line_start, metadata.line_range.end AS line_end, NULL::VARCHAR AS section FROM ({_ONE_CHUNK})""",
    "file_context": f"""SELECT id, prefix, CASE WHEN prefix = '' THEN content ELSE prefix || chr(10) || '---' || chr(10) || content END AS enriched_content FROM (
        SELECT c.id, c.content, coalesce('# File: ' || f.path || coalesce(CASE WHEN f.language <> '' THEN chr(10) || '# Language: ' || f.language END, ''), '') AS prefix
        FROM ({_ONE_CHUNK}) c LEFT JOIN (SELECT file_path AS path, min(language) AS language FROM code_normalized_event WHERE file_path IS NOT NULL GROUP BY 1) f ON f.path = c.metadata.path)""",
    "service_profiles": """SELECT name, size AS chunk_size, lap AS chunk_overlap, name = 'small' AS active, true AS taken
        FROM (VALUES ('default', 512, 50), ('small', 256, 25), ('large', 1024, 100), ('code', 768, 64)) AS p(name, size, lap)""",
    "service_strategies": f"SELECT unnest([{_PLAIN_NAMES}]) AS name, true AS described",
    "job_states": """SELECT * FROM (VALUES (10, 'pending', 0, 0, NULL, false, false), (11, 'running', 0, 0, NULL, true, false), (12, 'running', 4, 7, NULL, true, false),
        (13, 'completed', 13, 25, NULL, true, true), (14, 'failed', 4, 7, 'broken', true, true)) AS j(total_items, status, processed_items, chunks_created, error, started, ended)""",
}


def _line_sql(source: str, size: int, back: int) -> str:
    """Code without entities: lines until the limit is reached, each chunk beginning ``back`` lines before the last one's end."""
    reach = f"coalesce(list_min(list_filter(range({{0}} + 1, n + 1), lambda e: p[e + 1] - p[{{0}} + 1] >= {size})), n)"
    return f"""WITH RECURSIVE f AS MATERIALIZED (SELECT id, l, len(l) AS n, {_PREFIX.format('l')} AS p FROM (SELECT id, {_LINES.format('content')} AS l FROM ({source})) WHERE len(l) > 0),
        walk AS (SELECT id, 0 AS k, 0::BIGINT AS a, {reach.format('0')} AS b FROM f
            UNION ALL SELECT id, k + 1, s, {reach.format('s')} FROM (SELECT walk.id, k, n, p, CASE WHEN b - least({back}, b - a) <= a THEN b ELSE b - least({back}, b - a) END AS s
                FROM walk JOIN f ON f.id = walk.id) WHERE s < n)
        SELECT walk.id AS item, k AS chunk_index, array_to_string(l[a + 1:b], chr(10)) AS content, p[b + 1] - p[a + 1] AS token_count FROM walk JOIN f ON f.id = walk.id"""


def _chat_sql(source: str, size: int) -> str:
    """Threads from JSON or from lines, messages packed."""
    valid = """contains(coalesce(content_type, ''), 'json') AND CASE WHEN json_valid(content) THEN json_type(content) = 'OBJECT' AND json_type(content, '$.messages') = 'ARRAY'
        AND coalesce(json_type(content, '$.channel'), 'NULL') IN ('NULL', 'VARCHAR') AND coalesce(json_type(content, '$.thread_ts'), 'NULL') IN ('NULL', 'VARCHAR')
        AND coalesce(list_bool_and(list_transform(json_extract(content, '$.messages[*]'), lambda m: json_type(m) = 'OBJECT' AND coalesce(json_type(m, '$.user'), '') = 'VARCHAR'
            AND coalesce(json_type(m, '$.text'), '') = 'VARCHAR' AND coalesce(json_type(m, '$.ts'), 'NULL') IN ('NULL', 'VARCHAR'))), true) ELSE false END"""
    speaker = _strip("substring(who, strpos(who, ']') + 1)")
    segments = f"""SELECT id AS item, row_number() OVER (PARTITION BY id ORDER BY k) AS i, s, {_COUNT.format('s')} AS w FROM (
        SELECT id, generate_subscripts(m, 1) AS k, unnest(m) AS s FROM (SELECT id, list_transform(json_extract(content, '$.messages[*]'), lambda m: json_extract_string(m, '$.user') || ': ' || json_extract_string(m, '$.text')) AS m
            FROM (SELECT *, {valid} AS as_json FROM ({source})) WHERE as_json)
        UNION ALL SELECT id, k, CASE WHEN NOT contains(line, ': ') THEN 'unknown: ' || line WHEN starts_with(who, '[') AND contains(who, ']') THEN {speaker} || ': ' || said ELSE who || ': ' || said END FROM (
            SELECT id, k, line, string_split(line, ': ')[1] AS who, substring(line, strpos(line, ': ') + 2) AS said FROM (SELECT id, generate_subscripts(l, 1) AS k, unnest(l) AS line FROM (
                SELECT id, {_LINES.format('content')} AS l FROM (SELECT *, {valid} AS as_json FROM ({source})) WHERE NOT as_json)) WHERE regexp_matches(line, '[^{WS}]')))"""
    return f"SELECT item, chunk_index, content, {_COUNT.format('content')} AS token_count FROM ({_packed(segments, str(size), 'chr(10)')})"


def _sentence_sql(source: str, size: int) -> str:
    return _packed(_MERGED.replace("FROM documents WHERE text <> ''", f"FROM (SELECT id AS doc_id, content AS text FROM ({source}))"), str(size))


def _routed_sql(size: int, back: int) -> str:
    made = {"code": lambda s: _line_sql(s, size, back), "document": lambda s: _document_sql(s, size), "recursive": lambda s: _recursive_sql(s, size), "chat": lambda s: _chat_sql(s, size),
            "ticketing": lambda s: _ticket_sql(s, size), "sentence": lambda s: _sentence_sql(s, size)}
    source = f"SELECT id, any_value(content) AS content, any_value(content_type) AS content_type FROM source_item WHERE content <> '' AND {_STRATEGY} = '{{}}' GROUP BY id"
    return " UNION ALL ".join(f"SELECT item, '{name}' AS strategy, chunk_index::INTEGER AS chunk_index, content, token_count::INTEGER AS token_count FROM ({of(source.format(name))})" for name, of in made.items())


SQL["chunk_texts"] = _routed_sql(512, 5)
SQL["batch_summary"] = f"""SELECT n AS total_items, n AS processed, 0 AS failed, (SELECT count(*) FROM ({SQL['chunk_texts']})) AS total_chunks FROM (SELECT count(DISTINCT id) AS n FROM source_item)"""
