"""Chunking jobs: their states, the functions of the service, and tables of jobs."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field, replace
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.config import PROFILES, ChunkConfig, ServiceConfig, profiles
from chunkloom.operators import route
from chunkloom.operators.chunk import chunks
from chunkloom.schemas import JOB
from chunkloom.storage import cut

VERSION = "0.1.0"
NIL = "00000000-0000-0000-0000-000000000000"


def _now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


@dataclass(frozen=True)
class Job:
    job_id: str
    total_items: int
    status: str = "pending"
    processed_items: int = 0
    chunks_created: int = 0
    error: str | None = None
    started_at: datetime | None = None
    completed_at: datetime | None = None
    created_at: datetime = field(default_factory=_now)


class JobStore:
    """Jobs of one driver: pending -> running -> completed or failed."""

    def __init__(self) -> None:
        self._jobs: dict[str, Job] = {}
        self._lock = threading.Lock()

    def _change(self, job_id: str, **values) -> Job | None:
        with self._lock:
            if job_id in self._jobs:
                self._jobs[job_id] = replace(self._jobs[job_id], **values)
            return self._jobs.get(job_id)

    def create(self, total_items: int) -> str:
        job = Job(str(uuid.uuid4()), total_items)
        with self._lock:
            self._jobs[job.job_id] = job
        return job.job_id

    def get(self, job_id: str) -> Job | None:
        return self._jobs.get(job_id)

    def start(self, job_id: str) -> Job | None:
        return self._change(job_id, status="running", started_at=_now())

    def progress(self, job_id: str, processed: int, made: int) -> Job | None:
        return self._change(job_id, processed_items=processed, chunks_created=made)

    def complete(self, job_id: str, made: int) -> Job | None:
        job = self.get(job_id)
        return self._change(job_id, status="completed", completed_at=_now(), chunks_created=made, processed_items=job.total_items if job else 0)

    def fail(self, job_id: str, error: str) -> Job | None:
        return self._change(job_id, status="failed", completed_at=_now(), error=error)

    def table(self, spark: SparkSession) -> DataFrame:
        names = [c.split()[0] for c in JOB.split(", ")]
        return spark.createDataFrame([tuple(asdict(j)[n] for n in names) for j in self._jobs.values()], JOB)

    def cleanup(self, older_than_s: float = 3600) -> int:
        """Drops finished jobs older than an hour; the number dropped."""
        with self._lock:
            old = [k for k, j in self._jobs.items() if j.status in ("completed", "failed") and j.completed_at and (_now() - j.completed_at).total_seconds() > older_than_s]
            for k in old:
                del self._jobs[k]
            return len(old)


def counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def kept(jobs: DataFrame, now: Column, keep: str = "INTERVAL 1 HOUR") -> DataFrame:
    """Jobs without finished ones that ended more than ``keep`` before ``now``."""
    old = F.col("status").isin("completed", "failed") & (F.col("completed_at") <= now - F.expr(keep))
    return jobs.filter(~F.coalesce(old, F.lit(False)))


class Service:
    """The functions of the chunking service: submit, status, profiles, strategies."""

    def __init__(self, spark: SparkSession, config: ServiceConfig | None = None, sinks: list[Callable[[DataFrame], object]] | None = None):
        self.spark, self.config, self.sinks, self.store = spark, config or ServiceConfig.from_env(), sinks or [], JobStore()
        self.active = self.config.active_profile

    def health(self) -> dict:
        return {"status": "healthy", "version": VERSION}

    def chunk_config(self) -> ChunkConfig:
        named = next((p for p in PROFILES if p.name == self.active), None)
        if named is None or named.name == "default":
            return self.config.chunk_config()
        return replace(named.config(), min_chars_per_sentence=self.config.min_chars_per_sentence)

    def submit(self, items: DataFrame) -> dict:
        """Chunks the items and hands the result to every sink; errors of the run fail the job, those of a sink do not."""
        n = items.count()
        if not n:
            return {"accepted": False, "job_id": NIL, "message": "No items provided", "total_items": 0}
        job = self.store.create(n)
        self.store.start(job)
        try:
            made = cut(chunks(items, self.chunk_config()))  # stored once; every sink reads it
            total = made.count()

            def hand(sink: Callable[[DataFrame], object]) -> None:
                try:
                    sink(made)
                except Exception as e:  # noqa: BLE001 - a sink must not fail the job
                    print(f"sink failed: {e}")

            if self.sinks:
                with ThreadPoolExecutor(len(self.sinks)) as pool:  # the sinks' jobs run beside each other
                    list(pool.map(hand, self.sinks))
            self.store.complete(job, total)
        except Exception as e:  # noqa: BLE001
            self.store.fail(job, str(e))
        return {"accepted": True, "job_id": job, "message": f"Processing {n} items", "total_items": n}

    def status(self, job_id: str) -> dict | None:
        job = self.store.get(job_id)
        return asdict(job) if job else None

    def profiles(self) -> DataFrame:
        return profiles(self.spark, self.active)

    def active_profile(self) -> dict:
        c = self.chunk_config()
        return {"name": self.active, "chunk_size": c.chunk_size, "chunk_overlap": c.chunk_overlap}

    def set_active_profile(self, name: str) -> bool:
        """Whether there is such a profile; it then holds for the jobs that follow."""
        known = any(p.name == name for p in PROFILES)
        self.active = name if known else self.active
        return known

    def strategies(self) -> DataFrame:
        return route.strategies(self.spark)
