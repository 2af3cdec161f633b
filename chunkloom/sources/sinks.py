"""Writers: batches over HTTP to an embedding and a graph service, and projections of what they get."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.storage import cut

BATCH = 50
Post = Callable[[str, dict, float], dict]


def http_post(url: str, body: dict, timeout: float) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return json.loads(answer.read() or b"{}")


def http_ok(url: str, timeout: float = 5) -> bool:
    try:
        with urllib.request.urlopen(url, timeout=timeout) as answer:
            return 200 <= answer.status < 300
    except (urllib.error.URLError, OSError, ValueError):
        return False


def embedding_rows(chunks: DataFrame) -> DataFrame:
    return chunks.select("id", "source_item_id", "source_id", "content", F.to_json("metadata").alias("metadata"))


def graph_rows(chunks: DataFrame) -> DataFrame:
    """The graph service's fields. What the metadata does not hold is null, the source type "unknown"; the owner is owner_id, else tenant_id."""
    fields = chunks.schema["metadata"].dataType.names
    of = lambda name: F.col(f"metadata.{name}") if name in fields else F.lit(None).cast("string")
    return chunks.select("id", "content", "source_kind", F.coalesce(of("source_type"), F.lit("unknown")).alias("source_type"), "source_id", of("path").alias("file_path"),
                         of("repo").alias("repo_name"), of("language").alias("language"), of("heading_path").alias("heading_path"),
                         F.coalesce(of("owner_id"), of("tenant_id")).alias("owner_id"), F.to_json("metadata").alias("metadata"))


def batched(rows: DataFrame, url: str, envelope: dict, counters: tuple[str, ...], size: int = BATCH, timeout: float = 30, post: Post = http_post) -> DataFrame:
    """Posts rows in batches of ``size`` from their partitions: one row a batch with its counters and errors.

    A failed batch is a row with an error; the others go on. Every evaluation posts, so cut the result before using it twice.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[dict] = []

        def send() -> dict:
            chunks = [r | ({"metadata": json.loads(r["metadata"])} if r.get("metadata") else {}) for r in held]
            try:
                answer = post(url, {"chunks": chunks} | envelope, timeout)
                return {"sent": len(held)} | {c: int(answer.get(c, 0)) for c in counters} | {"errors": [str(e) for e in answer.get("errors") or []]}
            except Exception as e:  # noqa: BLE001 - a failed batch is a row of the result
                return {"sent": len(held)} | dict.fromkeys(counters, 0) | {"errors": [f"{type(e).__name__}: {e}"]}

        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                held.append({k: None if v is None or v != v else v for k, v in row.items()})
                if len(held) == size:
                    out.append(send())
                    held.clear()
            yield pd.DataFrame(out, columns=["sent", *counters, "errors"])
        if held:
            yield pd.DataFrame([send()], columns=["sent", *counters, "errors"])

    return rows.mapInPandas(run, ", ".join(["sent bigint", *(f"{c} bigint" for c in counters), "errors array<string>"]))


class EmbeddingSink:
    def __init__(self, base_url: str, size: int = BATCH, timeout: float = 30, post: Post = http_post):
        self.base_url, self.size, self.timeout, self.post = base_url.rstrip("/"), size, timeout, post

    def batches(self, chunks: DataFrame) -> DataFrame:
        """One row a posted batch: sent, embedded_count, errors."""
        return batched(embedding_rows(chunks), f"{self.base_url}/embed/chunks", {}, ("embedded_count",), self.size, self.timeout, self.post)

    def __call__(self, chunks: DataFrame) -> int:
        """The number of chunks that the service embedded."""
        sent = cut(self.batches(chunks))
        return sent.agg(F.coalesce(F.sum("embedded_count"), F.lit(0))).first()[0]

    def healthy(self) -> bool:
        return http_ok(f"{self.base_url}/health")


class GraphSink:
    COUNTERS = ("chunks_processed", "entities_created", "relationships_created")

    def __init__(self, base_url: str | None, size: int = BATCH, timeout: float = 60, post: Post = http_post):
        self.base_url, self.size, self.timeout, self.post = (base_url or "").rstrip("/"), size, timeout, post

    @classmethod
    def disabled(cls) -> GraphSink:
        return cls(None)

    @property
    def enabled(self) -> bool:
        return bool(self.base_url)

    def batches(self, chunks: DataFrame) -> DataFrame:
        """One row a posted batch: sent, the counters, and all its errors."""
        envelope = {"extract_entities": True, "create_cross_links": True}
        return batched(graph_rows(chunks), f"{self.base_url}/api/graph/chunks", envelope, self.COUNTERS, self.size, self.timeout, self.post)

    def __call__(self, chunks: DataFrame, shown: int = 100) -> dict:
        """Summed counters, the number of errors and the first ``shown`` of them (all are rows of ``batches``); zero where the sink is disabled."""
        if not self.enabled:
            return dict.fromkeys([*self.COUNTERS, "n_errors"], 0) | {"errors": []}
        sent = cut(self.batches(chunks))
        totals = sent.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in self.COUNTERS], F.coalesce(F.sum(F.size("errors")), F.lit(0)).alias("n_errors")).first()
        return totals.asDict() | {"errors": [r.e for r in sent.select(F.explode("errors").alias("e")).limit(shown).collect()]}

    def healthy(self) -> bool:
        return self.enabled and http_ok(f"{self.base_url}/health")
