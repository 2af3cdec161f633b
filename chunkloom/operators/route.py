"""Routing: which strategy an item goes to, and what is read off an item, as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Strategies with their descriptions, other names for them, and what each kind of source goes to.
STRATEGIES = {
    "token": "Splits text into overlapping windows of tokens", "sentence": "Packs whole sentences under the token limit",
    "recursive": "Splits by ever finer separators", "code": "Splits code by entities or lines",
    "document": "Splits documents by headings, paragraphs and sentences", "chat": "Packs messages of a conversation",
    "ticketing": "Keeps header, description and comments of tickets apart", "table": "Packs rows and repeats the header",
    "agentic": "Splits at the strongest boundary near the limit and adds context",
}
ALIASES = {"markdown": "document", "ticket": "ticketing", "issue": "ticketing", "csv": "table", "smart": "agentic", "intelligent": "agentic"}
BY_KIND = {"code_repo": "code", "document": "document", "wiki": "document", "chat": "chat", "email": "chat", "ticketing": "ticketing", "web": "recursive", "other": "sentence"}
DEFAULT_TYPES = {"code_repo": "text/code", "document": "text/plain", "chat": "application/json", "ticketing": "text/markdown",
                 "wiki": "text/markdown", "email": "text/plain", "web": "text/html", "other": "text/plain"}
EXTENSIONS = {
    "rust": "rs", "python": "py", "javascript": "js jsx", "typescript": "ts tsx", "go": "go", "java": "java", "c": "c h hpp", "cpp": "cpp cc cxx",
    "ruby": "rb", "php": "php", "swift": "swift", "kotlin": "kt kts", "scala": "scala", "csharp": "cs", "markdown": "md markdown", "json": "json",
    "yaml": "yaml yml", "toml": "toml", "xml": "xml", "html": "html htm", "css": "css", "sql": "sql", "bash": "sh bash", "powershell": "ps1",
}
CODE_LANGUAGES = ("python", "javascript", "typescript", "rust", "go", "java", "c", "cpp", "ruby", "tsx", "jsx")


def _mapping(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain(*values.items())])


def by_content_type(content_type: Column) -> Column:
    """The strategy a content type asks for, else null."""
    return (F.when(content_type.startswith("text/code:") | content_type.contains("x-source"), "code")
            .when(content_type.contains("markdown"), "document")
            .when(content_type.contains("json") & content_type.contains("chat"), "chat")
            .when(content_type.contains("csv") | content_type.contains("table"), "table"))


def strategy(content_type: Column, source_kind: Column) -> Column:
    """The content type decides before the source kind; an unknown kind goes to the sentence strategy."""
    return F.coalesce(by_content_type(content_type), _mapping(BY_KIND)[source_kind], F.lit("sentence"))


def strategy_by_name(name: Column) -> Column:
    return F.coalesce(_mapping(ALIASES)[F.lower(name)], F.when(F.lower(name).isin(*STRATEGIES), F.lower(name)))


def named(name: str) -> str | None:
    """The strategy that a name or alias means, in any case."""
    low = name.lower()
    return ALIASES.get(low, low if low in STRATEGIES else None)


def strategies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(STRATEGIES.items()), "name string, description string")


def metadata_string(metadata: Column, key: str) -> Column:
    """A string value of JSON metadata; other types, and what is no JSON, give null."""
    variant = F.try_parse_json(metadata)
    value = F.try_variant_get(variant, f"$.{key}", "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(variant, f"$.{key}", "string"))


def language(content_type: Column, metadata: Column) -> Column:
    return F.when(content_type.startswith("text/code:"), F.substring(content_type, 11, 1 << 20)).otherwise(metadata_string(metadata, "language"))


def path(metadata: Column) -> Column:
    return metadata_string(metadata, "path")


def is_code(content_type: Column, source_kind: Column) -> Column:
    return (source_kind == "code_repo") | content_type.startswith("text/code:")


def is_conversational(source_kind: Column) -> Column:
    return source_kind.isin("chat", "email")


def default_content_type(source_kind: Column) -> Column:
    return _mapping(DEFAULT_TYPES)[source_kind]


def config_language(content_type: Column, source_kind: Column, metadata: Column, given: str | None = None) -> Column:
    """The item's language where it is code, else the caller's."""
    return F.coalesce(F.when(is_code(content_type, source_kind), language(content_type, metadata)), F.lit(given).cast("string"))


def detect_language(file_path: Column) -> Column:
    """By the text after the last dot (the whole path where there is none), in any case; unknown ones give null."""
    known = {e: lang for lang, all_ in EXTENSIONS.items() for e in all_.split()}
    return _mapping(known)[F.lower(F.substring_index(file_path, ".", -1))]


def supports_language(name: str, lang: Column) -> Column:
    """Every strategy takes every language, but the code strategy only its own and null."""
    return lang.isNull() | lang.isin(*CODE_LANGUAGES) if name == "code" else F.lit(True)
