"""SQL functions: ``count_tokens(text)``, ``detect_language(path)`` and a table function ``chunk_NAME(text, size, overlap)`` per strategy.

    register(spark)
    spark.sql("SELECT i.id, c.* FROM items i, LATERAL chunk_sentence(i.content, 512, 50) c")
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from chunkloom.config import ChunkConfig
from chunkloom.functions.tokens import counter
from chunkloom.operators.route import STRATEGIES, EXTENSIONS


def _table_function(name: str):
    class Chunks:
        def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple]:
            from chunkloom.operators.segment import Item, chunked

            for p in chunked(Item(text or ""), name, ChunkConfig(size, overlap), counter()):
                yield p.index, p.content, p.tokens, p.start, p.end

    return F.udtf(Chunks, returnType="chunk_index int, content string, token_count int, start_index bigint, end_index bigint")


def register(spark: SparkSession) -> None:
    for name in STRATEGIES:
        spark.udtf.register(f"chunk_{name}", _table_function(name))
    known = {e: lang for lang, all_ in EXTENSIONS.items() for e in all_.split()}

    @F.pandas_udf("int")
    def count_tokens(texts: pd.Series) -> pd.Series:
        count = counter()
        return texts.map(lambda t: None if t is None else count.count(t)).astype("Int32")

    @F.pandas_udf("string")
    def detect_language(paths: pd.Series) -> pd.Series:
        return paths.map(lambda p: None if p is None else known.get(p.rsplit(".", 1)[-1].lower()))

    spark.udf.register("count_tokens", count_tokens)
    spark.udf.register("detect_language", detect_language)
