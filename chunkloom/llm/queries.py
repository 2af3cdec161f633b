"""Queries of the operators for training text, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkloom.llm import budget, credentials, encode, handwritten, leak, lookalike, markup, pieces
from chunkloom.storage import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Deliveries of files that nobody wrote by hand for their repository."""
    files = table(spark, folder, "code_normalized_event")
    return handwritten.not_handwritten(files, repository=F.col("metadata")["repo"]).select("delivery_id")


def p2_handwritten(spark: SparkSession, folder: str) -> DataFrame:
    """Deliveries of hand-written files."""
    files = table(spark, folder, "code_normalized_event").filter(F.col("normalized_content").isNotNull())
    return files.select("delivery_id", "file_path").join(p2_found(spark, folder), "delivery_id", "left_anti")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records that exceed their limit and come out in pieces."""
    made = pieces.oversized_pieces(*_oversized(spark, folder), with_text=False)
    return made.filter("piece_no = 0").select("record_kind", "record_key", "pos").distinct()


def p4_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """All pieces of the oversized records."""
    return pieces.oversized_pieces(*_oversized(spark, folder))


def p4_rebuilt(spark: SparkSession, folder: str) -> DataFrame:
    """Every oversized record as its pieces rebuild it, and whether all of them keep to the limits of size and overlap."""
    made = pieces.oversized_pieces(*_oversized(spark, folder)).distinct()
    record = ("record_kind", "record_key", "pos")
    before = F.coalesce(F.lag("end_byte").over(Window.partitionBy(*record).orderBy("piece_no")), F.lit(0))
    most = F.when(F.col("record_kind") == "item", pieces.ITEM_BYTES).when(F.col("record_kind") == "entity", pieces.ENTITY_BYTES)
    placed = made.withColumn("before", before)
    repeated = F.col("before") - F.col("start_byte")
    kept = (repeated >= 0) & (F.coalesce(F.col("end_byte") - F.col("start_byte") <= most, F.lit(True))) & ((repeated <= pieces.OVERLAP_BYTES) | (F.col("record_kind") == "chunk"))
    fresh = F.decode(F.expr("substring(encode(text, 'UTF-8'), before - start_byte + 1)"), "UTF-8")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", fresh.alias("t")))), lambda x: x["t"]), "")
    return placed.groupBy(*record).agg(F.md5(whole).alias("digest"), F.min(kept).alias("within"))


def _oversized(spark: SparkSession, folder: str) -> list[DataFrame]:
    return [table(spark, folder, name) for name in ("source_item", "code_normalized_event", "chunk")]


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of delivered files on which a credential begins."""
    return credentials.found_lines(table(spark, folder, "code_normalized_event"), "delivery_id")


def p5_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """Every delivered file with its credentials redacted."""
    return credentials.redacted_texts(table(spark, folder, "code_normalized_event"), "delivery_id")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Items, but for chats and code, whose content has a construct of a markup language."""
    items = table(spark, folder, "source_item").filter(~F.col("source_kind").isin("chat", "code_repo"))
    return markup.clean_texts(items).filter(F.size("kinds") > 0).select("id").distinct()


def p6_clean(spark: SparkSession, folder: str) -> DataFrame:
    """Clean text of every item."""
    return markup.clean_texts(table(spark, folder, "source_item"))


def _counted(spark: SparkSession, folder: str) -> list[DataFrame]:
    return [table(spark, folder, name) for name in ("chunk", "source_account", "language_ref")]


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Usable stored tokens by source kind, domain and language."""
    return budget.stored_totals(*_counted(spark, folder))


def p7_estimated(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of all distinct chunks under byte_bpe_50k, by the same slices."""
    return budget.estimated_totals(*_counted(spark, folder))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The ids of each document by byte_bpe_50k, without special tokens."""
    return encode.encoded(table(spark, folder, "documents"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold at least 12 consecutive words of a test item."""
    return leak.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_item"))


def p9_altered(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold 12 consecutive words of a test item with at most two edits of a character."""
    return leak.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_item"), edits=2)


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of documents that look the same but differ as strings."""
    return lookalike.same_look(table(spark, folder, "documents"))


def p10_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with a text: its class, and how many documents look the same but differ as strings."""
    return lookalike.look_classes(table(spark, folder, "documents"))


def p10_text(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's text in its one form."""
    return lookalike.unified(table(spark, folder, "documents")).withColumnRenamed("form", "text")


QUERIES = {
    "p2_found": p2_found, "p2_handwritten": p2_handwritten, "p4_found": p4_found, "p4_pieces": p4_pieces, "p4_rebuilt": p4_rebuilt, "p6_found": p6_found, "p6_clean": p6_clean, "p7_found": p7_found, "p7_estimated": p7_estimated,
    "p5_found": p5_found, "p5_redacted": p5_redacted, "p8_ids": p8_ids, "p9_found": p9_found, "p9_altered": p9_altered, "p10_found": p10_found, "p10_classes": p10_classes, "p10_text": p10_text,
}

_SPANS = """SELECT delivery_id, u.i - 1 AS pos, e.start_line AS a, e.end_line AS b, string_split(regexp_replace(normalized_content, '\\n$', ''), chr(10)) AS lines
    FROM code_normalized_event, UNNEST(range(1, len(entities) + 1)) AS u(i), LATERAL (SELECT entities[u.i] AS e)
    WHERE normalized_content IS NOT NULL AND entities IS NOT NULL"""
_KIND = """lower(regexp_replace(regexp_replace(trim(source_kind), '([a-z])([A-Z])', '\\1_\\2', 'g'), '[-_ .]+', '_', 'g'))"""
_WRITTEN = """regexp_replace(lower(regexp_replace(coalesce(metadata.language, ''), '^\\s+|\\s+$', '', 'g')), '^\\.', '')"""

SQL: dict[str, str] = {
    "p4_found": f"""SELECT DISTINCT 'item' AS record_kind, id AS record_key, 0 AS pos FROM source_item WHERE strlen(content) > 6000
        UNION ALL SELECT DISTINCT 'chunk', id, 0 FROM chunk WHERE token_count > 512 AND token_count <= strlen(content)
        UNION ALL SELECT DISTINCT 'entity', delivery_id::VARCHAR, pos::INTEGER FROM ({_SPANS}) WHERE a IS NOT NULL AND b IS NOT NULL
            AND strlen(array_to_string(CASE WHEN b >= 1 AND a <= len(lines) AND a <= b THEN lines[greatest(a, 1):b] ELSE [] END, chr(10))) > 1500""",
    "p4_rebuilt": f"""SELECT 'item' AS record_kind, id AS record_key, 0 AS pos, md5(any_value(content)) AS digest, true AS within FROM source_item WHERE strlen(content) > 6000 GROUP BY id
        UNION ALL SELECT 'chunk', id, 0, md5(any_value(content)), true FROM chunk WHERE token_count > 512 AND token_count <= strlen(content) GROUP BY id
        UNION ALL SELECT 'entity', delivery_id::VARCHAR, pos::INTEGER, md5(t), true FROM (SELECT delivery_id, pos, array_to_string(CASE WHEN b >= 1 AND a <= len(lines) AND a <= b THEN lines[greatest(a, 1):b] ELSE [] END, chr(10)) AS t
            FROM ({_SPANS}) WHERE a IS NOT NULL AND b IS NOT NULL) WHERE strlen(t) > 1500""",
    "p7_found": f"""WITH names AS (SELECT lower(w) AS written, min(language) AS language FROM
            (SELECT language, unnest(list_concat([language, display_name], extensions)) AS w FROM language_ref) GROUP BY 1),
        counted AS (SELECT id, any_value(source_id) AS source_id, any_value({_KIND}) AS source_kind, any_value(token_count) AS token_count, any_value({_WRITTEN}) AS written
            FROM chunk WHERE token_count >= 1 AND token_count <= strlen(content) GROUP BY id)
        SELECT c.source_kind, a.domain, coalesce(n1.language, n2.language, 'und') AS language, sum(token_count)::BIGINT AS n_tokens
        FROM counted c LEFT JOIN names n1 ON n1.written = c.written
        LEFT JOIN names n2 ON n2.written = regexp_replace(c.written, '^([a-z]{{2,3}})(?:[-_][a-z]{{4}})?(?:[-_](?:[a-z]{{2}}|[0-9]{{3}}))?$', '\\1')
        LEFT JOIN source_account a ON a.source_id = c.source_id GROUP BY ALL""",
}
