"""Chunking of a DataFrame of items: one narrow pass, dispatched by a route column.

Columns the strategies do not need never reach Python. Ids are hashes of item, number and strategy, so that a retried task
gives the same rows. Errors are rows as well: an item whose strategy fails gives one row with ``error`` set.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkloom.config import BatchConfig, ChunkConfig
from chunkloom.functions.text import py_lines
from chunkloom.functions.tokens import count_tokens, counter, tile_tokens
from chunkloom.operators import route
from chunkloom.operators.segment import Item, analysed, boundary, chunked, gaps, large_pieces, sections
from chunkloom.storage import cut

_OUT = ("item string, strategy string, content string, token_count int, start_index bigint, end_index bigint, chunk_index int, meta_type string, language string, "
        "path string, section string, symbol_name string, line_start int, line_end int, author string, thread_id string, ts string, error string")
_FIELDS = [(n, {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}[t]) for n, t in (x.split() for x in _OUT.split(", "))]
_ENTITIES = "array<struct<entity_type:string,name:string,start_line:int,end_line:int>>"


def routed(items: DataFrame, strategy: str | None = None, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Items with the columns ``strategy``, ``language`` and ``path`` that chunking needs."""
    kind, content_type, metadata = F.col("source_kind"), F.col("content_type"), F.col("metadata")
    name = F.lit(route.named(strategy)) if strategy else route.strategy(content_type, kind)
    if strategy and route.named(strategy) is None:
        raise ValueError(f"no strategy is named {strategy!r}")
    return items.withColumns({"strategy": name, "language": F.coalesce(route.language(content_type, metadata), F.lit(config.language).cast("string")), "path": route.path(metadata)})


def pieces(items: DataFrame, config: ChunkConfig = ChunkConfig(), strategy: str | None = None, tokens: str = "regex",
           most: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per chunk of each item (id, source_kind, content_type, content, metadata, optionally entities), with the item's ``carry`` columns.

    Null and empty contents give no row; repeated items each give their rows; other columns are ignored.
    """
    # zipped fields, not a transform over the structs: so only these fields are read
    fields = ("entity_type", "name", "start_line", "end_line")
    given = F.arrays_zip(*[F.col(f"entities.{k}").alias(k) for k in fields]) if "entities" in items.columns else F.array()
    narrow = routed(items, strategy, config).filter(F.octet_length("content") > 0).select(
        F.col("id").alias("item"), "strategy", "content", "content_type", "path", "language", given.cast(_ENTITIES).alias("entities"), *[F.col(f"`{c}`").alias(f"carried_{c}") for c in carry])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokens)
        for batch in batches:
            rows: list[tuple] = []
            origin: list[int] = []
            for at, (name, content, kind, path, language, own) in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:7]))):
                try:
                    made = chunked(Item(content, kind or "", path, language, [e for e in own or [] if e]), name, config, count, most)
                except Exception as e:  # noqa: BLE001 - a failed item is a row of the result
                    origin.append(at)
                    rows.append((name, *[None] * 15, f"{type(e).__name__}: {e}"))
                    continue
                origin += [at] * len(made)
                for p in made:
                    m, span = p.meta, p.meta.get("lines", (None, None))
                    rows.append((name, p.content, p.tokens, p.start, p.end, p.index, m.get("meta_type"), m.get("language"), m.get("path"), m.get("section"),
                                 m.get("symbol_name"), span[0], span[1], m.get("author"), m.get("thread_id"), m.get("ts"), None))
            columns = list(zip(*rows)) or [()] * (len(_FIELDS) - 1)
            from_item = pa.array(origin, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(from_item), *[pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS[1:])], *[c.take(from_item) for c in batch.columns[7:]]],
                [*[n for n, _ in _FIELDS], *carry])

    kinds = dict(narrow.dtypes)
    return narrow.mapInArrow(run, ", ".join([_OUT, *[f"`{c}` {kinds[f'carried_{c}']}" for c in carry]]))


def rfc3339(text: Column) -> Column:
    """The instant that a date and time with an offset denotes; other forms, which a cast would take, give null."""
    return F.when(text.rlike(r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(?:\.\d+)?(?:[Zz]|[+-]\d\d:\d\d)$"), F.try_to_timestamp(text))


def chunk_id(item: Column, index: Column, strategy: Column) -> Column:
    h = F.md5(F.concat_ws("\x1f", item, index.cast("string"), strategy))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def metadata_struct(**given: Column) -> Column:
    """The chunk metadata, with null for what is not given."""
    types = {"content_type": "string", "language": "string", "path": "string", "section": "string", "symbol_name": "string", "parent_symbol": "string",
             "line_range": "struct<start:int,end:int>", "author": "string", "thread_id": "string", "timestamp": "timestamp", "extra": "string"}
    return F.struct(*[given.get(k, F.lit(None)).cast(t).alias(k) for k, t in types.items()])


def for_code(path: Column, language: Column) -> Column:
    return metadata_struct(content_type=F.lit("code"), path=path, language=language)


def for_document(section: Column, path: Column) -> Column:
    return metadata_struct(content_type=F.lit("document"), section=section, path=path)


def for_chat(author: Column, thread_id: Column, timestamp: Column) -> Column:
    return metadata_struct(content_type=F.lit("chat"), author=author, thread_id=thread_id, timestamp=timestamp)


def with_symbol(metadata: Column, name: Column, parent: Column) -> Column:
    return metadata.withField("symbol_name", name).withField("parent_symbol", parent)


def with_lines(metadata: Column, start: Column, end: Column) -> Column:
    return metadata.withField("line_range", F.struct(start.cast("int").alias("start"), end.cast("int").alias("end")))


def chunks(items: DataFrame, config: ChunkConfig = ChunkConfig(), strategy: str | None = None, tokens: str = "regex", created_at: Column | None = None) -> DataFrame:
    """Chunks with provenance in the documented schema; items whose strategy failed are left out (see ``batch``)."""
    made = pieces(items, config, strategy, tokens, carry=("source_id", "source_kind")).filter(F.col("error").isNull())
    lines = F.when(F.col("line_start").isNotNull(), F.struct(F.col("line_start").alias("start"), F.col("line_end").alias("end")))
    content_type = F.coalesce("meta_type", F.when(F.col("strategy") == "document", "document").when(F.col("strategy") == "chat", "chat"))
    meta = metadata_struct(content_type=content_type, language=F.col("language"), path=F.col("path"), section=F.col("section"), symbol_name=F.col("symbol_name"),
                           line_range=lines, author=F.col("author"), thread_id=F.col("thread_id"), timestamp=rfc3339(F.col("ts")))
    return made.select(
        chunk_id(F.col("item"), F.col("chunk_index"), F.col("strategy")).alias("id"), F.col("item").alias("source_item_id"), "source_id", "source_kind", "content",
        "token_count", "start_index", "end_index", "chunk_index", meta.alias("metadata"), F.lit(None).cast("array<float>").alias("embedding"),
        (F.current_timestamp() if created_at is None else created_at).alias("created_at"))


def with_total(made: DataFrame, item: str = "item") -> DataFrame:
    """Chunks with the number of chunks of their item, joined back from a partial count so that no item is gathered."""
    return made.join(made.groupBy(item).agg(F.count(F.lit(1)).cast("int").alias("total_chunks")), item)


def token_windows(items: DataFrame, size: int, overlap: int) -> DataFrame:
    """The token strategy in the JVM: (item, chunk_index, content, token_count, start_index, end_index)."""
    if size <= 0:
        raise ValueError("size must be positive")
    step = size - overlap if overlap < size else size
    n = F.size("tokens")
    count = F.when(n <= size, 1).otherwise(F.ceil((n - size) / step).cast("int") + 1)
    tokens = items.filter(F.octet_length("content") > 0).select(F.col("id").alias("item"), tile_tokens(F.col("content")).alias("tokens"))
    cut = tokens.select("item", "tokens", F.explode(F.sequence(F.lit(0), count - 1)).alias("chunk_index")).select(
        "item", "chunk_index", F.slice("tokens", F.col("chunk_index") * step + 1, size).alias("own"),
        F.octet_length(F.array_join(F.slice("tokens", F.lit(1), F.col("chunk_index") * step), "")).cast("bigint").alias("start_index"))
    text = F.array_join("own", "")
    return cut.select("item", "chunk_index", text.alias("content"), F.size("own").alias("token_count"), "start_index", (F.col("start_index") + F.octet_length(text)).alias("end_index"))


def sentence_folds(items: DataFrame, size: int, least: int = 12) -> DataFrame:
    """The sentence strategy as SQL folds over arrays: readable, and an independent check of the packing pass.

    (item, chunk_index, content, token_count). The fold copies its result for every sentence, so it suits short texts.
    """
    ended = F.regexp_replace(F.regexp_replace("content", r"([.!?])([^\S\n]+)", "$1$2\x01"), r"([.!?])\n", "$1\x01\n")
    parts = F.filter(F.split(ended, "\x01", -1), lambda s: s.rlike(r"\S"))
    texts = "array<string>"

    def merge(acc: Column, s: Column) -> Column:
        n = F.size(acc)
        short = (n > 0) & (F.octet_length(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(""))) < least)
        return F.when(short, F.concat(F.slice(acc, F.lit(1), n - 1), F.array(F.concat(F.try_element_at(acc, F.lit(-1)), s)))).otherwise(F.array_append(acc, s))

    merged = F.aggregate(parts, F.array().cast(texts), merge)
    weighed = F.transform(merged, lambda s: F.struct(s.alias("s"), count_tokens(s).alias("w")))
    start = F.struct(F.array().cast("array<struct<t:string,w:int>>").alias("done"), F.lit("").alias("t"), F.lit(0).alias("w"))

    def pack(acc: Column, x: Column) -> Column:
        full = (acc["t"] != "") & (acc["w"] + x["w"] > size)
        closed = F.array_append(acc["done"], F.struct(acc["t"].alias("t"), acc["w"].alias("w")))
        return F.struct(F.when(full, closed).otherwise(acc["done"]).alias("done"), F.when(full, x["s"]).otherwise(F.concat(acc["t"], x["s"])).alias("t"),
                        F.when(full, x["w"]).otherwise(acc["w"] + x["w"]).alias("w"))

    def finish(acc: Column) -> Column:
        return F.when(acc["t"] == "", acc["done"]).otherwise(F.array_append(acc["done"], F.struct(acc["t"].alias("t"), acc["w"].alias("w"))))

    folded = items.filter(F.octet_length("content") > 0).select(F.col("id").alias("item"), F.aggregate(weighed, start, pack, finish).alias("made"))
    return folded.select("item", F.posexplode("made").alias("chunk_index", "m")).select("item", "chunk_index", F.col("m.t").alias("content"), F.col("m.w").alias("token_count"))


def _per_item(items: DataFrame, columns: list[str], make: Callable[..., Iterator[tuple]], schema: str) -> DataFrame:
    """Rows that ``make`` gives of every item with content, in place: (item, ...) of ``schema``; ``columns`` are its arguments."""
    fields = [x.rsplit(" ", 1) for x in schema.split(", ")]
    types = [{"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[t] for _, t in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            origin, rows = [], []
            for at, given in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]))):
                made = list(make(*given))
                origin += [at] * len(made)
                rows += made
            made_columns = list(zip(*rows)) or [()] * len(fields)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(origin, pa.int64())), *(pa.array(c, t) for c, t in zip(made_columns, types))], ["item", *(n for n, _ in fields)])

    narrow = items.filter(F.octet_length("content") > 0).select(F.col("id").cast("string").alias("item"), *columns)
    return narrow.mapInArrow(run, f"item string, {schema}")


def heading_sections(items: DataFrame) -> DataFrame:
    """(item, section_no, level, title, n_lines) of the parts that headings begin, in place."""
    def make(text: str) -> Iterator[tuple]:
        number = 0
        for level, title, body in sections(text, blank=True):
            number += title is not None
            if body.strip():
                yield number, level, title, body.count("\n")

    return _per_item(items, ["content"], make, "section_no bigint, level int, title string, n_lines bigint")


def line_gaps(items: DataFrame, least: int = 10, tokens: str = "regex") -> DataFrame:
    """(item, line_start, line_end, token_count) of runs of lines that no entity covers, above ``least`` tokens, in place."""
    def make(text: str, entities: list[dict] | None) -> Iterator[tuple]:
        rows, count = py_lines(text), counter(tokens)
        spans = [(max(0, e["start_line"] - 1), min(e["end_line"], len(rows))) for e in entities or [] if e and e["start_line"] is not None and e["end_line"] is not None]
        for a, b in gaps(len(rows), spans):
            n = sum(map(count.count, rows[a:b]))
            if n > least:
                yield a + 1, b, n

    given = items.withColumn("entities", F.arrays_zip(*[F.col(f"entities.{k}").alias(k) for k in ("start_line", "end_line")]))
    return _per_item(given, ["content", "entities"], make, "line_start int, line_end int, token_count int")


def analyses(items: DataFrame, tokens: str = "regex") -> DataFrame:
    """One row per item with what the agentic strategy sees in it, in place: counts, flags and the deepest nesting."""
    fields = ("total_tokens", "total_lines", "has_code_blocks", "has_headings", "has_imports", "avg_line_length", "nesting_depth")

    def make(text: str) -> Iterator[tuple]:
        found = analysed(text, counter(tokens))
        yield tuple(found[f] for f in fields)

    return _per_item(items, ["content"], make, "total_tokens int, total_lines int, has_code_blocks boolean, has_headings boolean, has_imports boolean, avg_line_length int, nesting_depth int")


def boundaries(items: DataFrame) -> DataFrame:
    """(item, n, kind, strength) of every boundary line, lines from 0, in place."""
    def make(text: str) -> Iterator[tuple]:
        for n, row in enumerate(py_lines(text)):
            if found := boundary(row):
                yield n, *found

    return _per_item(items, ["content"], make, "n int, kind string, strength double")


def split_large(items: DataFrame, most: int) -> DataFrame:
    """(item, piece_no, start_offset, content): items above ``most`` bytes cut at blank lines, line ends or characters."""
    if most <= 0:
        raise ValueError("most must be positive")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, numbers, starts, texts = [], [], [], []
            for key, content in zip(*(c.to_pylist() for c in batch.columns)):
                data = content.encode("utf-8", "surrogatepass")
                for n, (a, b) in enumerate(large_pieces(data, most)):
                    keys.append(key)
                    numbers.append(n)
                    starts.append(a)
                    texts.append(data[a:b].decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()), pa.array(texts, pa.string())],
                                             ["item", "piece_no", "start_offset", "content"])

    return items.filter(F.octet_length("content") > 0).select("id", "content").mapInArrow(run, "item string, piece_no int, start_offset bigint, content string")


def batch(items: DataFrame, config: BatchConfig = BatchConfig(), tokens: str = "regex") -> tuple[DataFrame, DataFrame]:
    """(chunks, summary): the summary has total_items, processed, failed and total_chunks, from partial counts.

    Without ``continue_on_error`` the chunks raise at the first failed item; the messages are rows of ``batch_errors``.
    """
    made = pieces(items, config.chunk, tokens=tokens, most=config.max_content_size)
    if not config.continue_on_error:
        made = made.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(F.concat_ws(": ", "item", "error")).cast("string")))
    made = cut(made)  # chunked once, for the rows and for the summary
    kinds = items.select(F.lit("item").alias("what")).unionByName(made.select(F.when(F.col("error").isNull(), "chunk").otherwise("failed").alias("what")))
    of = lambda what: F.count_if(F.col("what") == what)
    summary = kinds.agg(of("item").alias("total_items"), (of("item") - of("failed")).alias("processed"), of("failed").alias("failed"), of("chunk").alias("total_chunks"))
    return made.filter(F.col("error").isNull()).drop("error"), summary


def batch_errors(items: DataFrame, config: BatchConfig = BatchConfig(), tokens: str = "regex") -> DataFrame:
    """(item, error) of the items that failed."""
    return pieces(items, config.chunk, tokens=tokens, most=config.max_content_size).filter(F.col("error").isNotNull()).select("item", "error")


def streamed(items: DataFrame, buffer: int = 100, config: ChunkConfig = ChunkConfig()) -> Iterator[list]:
    """Chunks in lists of at least ``buffer``, then the rest, partition by partition, without holding the whole result."""
    held: list = []
    for row in pieces(items, config).filter(F.col("error").isNull()).toLocalIterator(prefetchPartitions=True):
        held.append(row)
        if len(held) >= buffer:
            yield held
            held = []
    if held:
        yield held
