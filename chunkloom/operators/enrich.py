"""Context put before chunks for embedding, as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkloom.functions.text import byte_prefix

CONTEXT = ("file_path string, repository string, branch string, language string, scope string, definitions array<struct<name:string,entity_type:string,signature:string>>, "
           "dependencies array<string>, documentation string, metadata map<string,string>")


@dataclass(frozen=True)
class Prefix:
    """What a prefix shows. Repository and documentation are shown wherever they are given."""

    file_path: bool = True
    scope: bool = True
    definitions: bool = True
    dependencies: bool = True
    max_bytes: int = 500
    separator: str = "\n---\n"

    def lines(self, c: dict[str, Column]) -> list[Column]:
        shown = lambda name, value: F.when(value.isNotNull() & (value != ""), F.concat(F.lit(f"# {name}: "), value))
        out = []
        if self.file_path:
            out += [F.concat(F.lit("# File: "), F.coalesce(c["file_path"], F.lit(""))), shown("Language", c["language"])]
        out.append(F.when(c["repository"].isNotNull(), F.concat(F.lit("# Repository: "), c["repository"])))
        if self.scope:
            out.append(shown("Scope", c["scope"]))
        if self.definitions:
            named = F.transform(c["definitions"], lambda d: F.coalesce(d["signature"], F.concat_ws(" ", d["entity_type"], d["name"])))
            out.append(F.when(F.size(c["definitions"]) > 0, F.concat(F.lit("# Defines: "), F.array_join(named, ", "))))
        if self.dependencies:
            all_ = F.array_join(c["dependencies"], ", ")
            some = F.concat(F.array_join(F.slice(c["dependencies"], 1, 5), ", "), F.lit(" ..."))
            out.append(F.when(F.size(c["dependencies"]) > 0, F.concat(F.lit("# Dependencies: "), F.when(F.octet_length(all_) <= 100, all_).otherwise(some))))
        doc = c["documentation"]
        out.append(F.when(doc.isNotNull(), F.concat(F.lit("# Doc: "), F.when(F.octet_length(doc) > 100, F.concat(byte_prefix(doc, 97), F.lit("..."))).otherwise(doc))))
        return out

    def text(self, context: dict[str, Column]) -> Column:
        """The lines that there is something for; beyond ``max_bytes`` whole lines go, and a single too long line is cut."""
        full = F.concat_ws("\n", *self.lines(context))
        begin = F.struct(F.lit(0).alias("bytes"), F.lit(0).alias("chars"), F.lit(0).alias("keep"))

        def measure(acc: Column, line: Column) -> Column:
            size, chars = acc["bytes"] + F.octet_length(line) + 1, acc["chars"] + F.length(line) + 1
            return F.struct(size.alias("bytes"), chars.alias("chars"), F.when(size <= self.max_bytes, chars).otherwise(acc["keep"]).alias("keep"))

        keep = F.aggregate(F.split(full, "\n", -1), begin, measure, lambda acc: acc["keep"])
        whole = F.when(keep > 0, F.left(full, keep - 1)).otherwise(byte_prefix(full, self.max_bytes))
        return F.when(F.octet_length(full) <= self.max_bytes, full).otherwise(whole)


def context_columns(context: Column) -> dict[str, Column]:
    return {k: context[k] for k in ("file_path", "repository", "language", "scope", "definitions", "dependencies", "documentation")}


def enriched(chunks: DataFrame, prefix: Prefix = Prefix()) -> DataFrame:
    """Chunks (content, context struct) with ``prefix`` and ``enriched_content``; an empty prefix leaves the content alone."""
    text = prefix.text(context_columns(F.col("context")))
    made = chunks.withColumn("prefix", text)
    return made.withColumn("enriched_content", F.when(F.col("prefix") == "", F.col("content")).otherwise(F.concat("prefix", F.lit(prefix.separator), "content")))


def enriched_by_file(chunks: DataFrame, contexts: DataFrame, prefix: Prefix = Prefix()) -> DataFrame:
    """Every chunk with the context of its file: ``contexts`` has one row (path, context) a file. Chunks of unknown files keep their content."""
    joined = chunks.join(contexts.select("path", "context"), "path", "left")
    text = F.when(F.col("context").isNotNull(), prefix.text(context_columns(F.col("context")))).otherwise("")
    made = joined.withColumn("prefix", text)
    return made.withColumn("enriched_content", F.when(F.col("prefix") == "", F.col("content")).otherwise(F.concat("prefix", F.lit(prefix.separator), "content")))
