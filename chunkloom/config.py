"""Configuration values and presets."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class ChunkConfig:
    """Parameters of one chunking call; sizes count tokens."""

    chunk_size: int = 512
    chunk_overlap: int = 50
    min_chars_per_sentence: int = 12
    preserve_whitespace: bool = False
    language: str | None = None
    max_messages: int = 0

    def __post_init__(self) -> None:
        if self.chunk_size <= 0:
            raise ValueError("chunk_size must be positive")
        if self.chunk_overlap < 0 or self.min_chars_per_sentence < 0:
            raise ValueError("sizes must not be negative")

    @classmethod
    def with_size(cls, chunk_size: int) -> ChunkConfig:
        return cls(chunk_size=chunk_size)

    def with_overlap(self, overlap: int) -> ChunkConfig:
        return replace(self, chunk_overlap=overlap)

    def with_language(self, language: str | None) -> ChunkConfig:
        return replace(self, language=language)


@dataclass(frozen=True)
class Profile:
    name: str
    description: str
    chunk_size: int
    chunk_overlap: int
    active: bool = False

    def config(self) -> ChunkConfig:
        return ChunkConfig(self.chunk_size, self.chunk_overlap)


PROFILES = (
    Profile("default", "Balanced size for general content", 512, 50, True),
    Profile("small", "Small chunks for precise retrieval", 256, 25),
    Profile("large", "Large chunks for more context", 1024, 100),
    Profile("code", "Sizes suited to source code", 768, 64),
)


def profiles(spark: SparkSession, active: str = "default") -> DataFrame:
    """The presets as rows; four of them, so any join with them may broadcast."""
    rows = [(p.name, p.description, p.chunk_size, p.chunk_overlap, p.name == active) for p in PROFILES]
    return spark.createDataFrame(rows, "name string, description string, chunk_size int, chunk_overlap int, active boolean")


@dataclass(frozen=True)
class ServiceConfig:
    """Settings of the service; every one can come from the environment or a TOML file."""

    default_chunk_size: int = 512
    default_chunk_overlap: int = 50
    min_chars_per_sentence: int = 12
    embedding_service_url: str | None = None
    graph_service_url: str | None = None
    max_concurrent_jobs: int = 4
    active_profile: str = "default"

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> ServiceConfig:
        """Values that are missing or no numbers fall back to the defaults."""
        env = os.environ if env is None else env
        named = {"default_chunk_size": "CHUNK_SIZE", "default_chunk_overlap": "CHUNK_OVERLAP", "min_chars_per_sentence": "MIN_CHARS_PER_SENTENCE",
                 "embedding_service_url": "EMBEDDING_SERVICE_URL", "graph_service_url": "RELATION_GRAPH_SERVICE_URL",
                 "max_concurrent_jobs": "MAX_CONCURRENT_JOBS", "active_profile": "ACTIVE_PROFILE"}
        return cls(**{f: v for f, key in named.items() if (v := _typed(cls, f, env.get(key))) is not None})

    @classmethod
    def from_toml(cls, path: str) -> ServiceConfig:
        """The same keys, at the top level or in any table of the file."""
        with open(path, "rb") as file:
            loaded = tomllib.load(file)
        flat = {k: v for part in [loaded, *(v for v in loaded.values() if isinstance(v, dict))] for k, v in part.items()}
        return cls(**{f.name: v for f in fields(cls) if (v := _typed(cls, f.name, flat.get(f.name))) is not None})

    def chunk_config(self) -> ChunkConfig:
        return ChunkConfig(self.default_chunk_size, self.default_chunk_overlap, self.min_chars_per_sentence)


def _typed(cls: type, name: str, value: object) -> object:
    if value is None or not isinstance(getattr(cls, name), int):
        return value
    try:
        return int(value)  # type: ignore[call-overload]
    except ValueError:
        return None


@dataclass(frozen=True)
class ChunkingPolicy:
    """Declared limits; nothing enforces them."""

    max_chunk_size: int = 1024
    min_chunk_size: int = 50
    respect_boundaries: bool = True
    include_metadata: bool = True
    merge_small_chunks: bool = True


@dataclass(frozen=True)
class RepoConfig:
    """Declared settings of repository-wide chunking; nothing enforces them."""

    max_chunk_tokens: int = 1024
    min_chunk_tokens: int = 50
    large_file_strategy: str = "hierarchical"
    large_file_threshold: int = 100 * 1024
    include_import_context: bool = True
    include_symbol_context: bool = True
    symbol_context_lines: int = 2


@dataclass(frozen=True)
class BatchConfig:
    concurrency: int = 4
    stream_buffer_size: int = 100
    continue_on_error: bool = True
    max_content_size: int = 10 * 1024 * 1024
    chunk: ChunkConfig = field(default_factory=ChunkConfig)
