"""The manifest of corpus shards as a table: what is to do, running, done, and how far a scan is.

Spark schedules work, retries tasks and commits output; these operators keep the record of it. Each takes the
manifest and returns the new one, to be written by the one process that owns it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from copperleaf.config import STALE_SECONDS

_EMPTY = {
    "status": ("pending", "string"), "attempts": (0, "int"), "documents_scanned": (None, "bigint"), "evidence_rows": (None, "bigint"), "output_path": (None, "string"),
    "error": (None, "string"), "started_at": (None, "timestamp"), "heartbeat_at": (None, "timestamp"), "finished_at": (None, "timestamp"), "worker_id": (None, "string"),
    "lease_token": (None, "string"),
}


def add_new(manifest: DataFrame, listed: DataFrame) -> DataFrame:
    """With the listed shards (path, size_bytes, priority) that it lacks, to do; known ones stay as they are."""
    new = listed.dropDuplicates(["path"]).join(manifest.select("path"), "path", "left_anti")
    new = new.select("path", "size_bytes", "priority", *[F.lit(v).cast(t).alias(c) for c, (v, t) in _EMPTY.items()])
    return manifest.unionByName(new)


def queue(manifest: DataFrame) -> DataFrame:
    """Shards to do, in order: priority, attempts, path."""
    return manifest.where("status = 'pending'").orderBy("priority", "attempts", "path")


def claim(manifest: DataFrame, n: int, worker: str, token: str, now: Column) -> DataFrame:
    """The first n of the queue are running, with their worker and lease."""
    first = queue(manifest).limit(n).select("path", F.lit(True).alias("__c"))
    mine = F.coalesce("__c", F.lit(False))
    new = {"status": F.lit("running"), "attempts": F.coalesce("attempts", F.lit(0)) + 1, "worker_id": F.lit(worker), "lease_token": F.lit(token), "started_at": now, "heartbeat_at": now}
    return _where(manifest.join(first, "path", "left"), mine, new).drop("__c").select(*manifest.columns)


def _where(df: DataFrame, condition: Column, new: dict[str, Column]) -> DataFrame:
    return df.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in new.items()})


def _owned(token: str) -> Column:
    return (F.col("status") == "running") & (F.col("lease_token") == token)


def heartbeat(manifest: DataFrame, token: str, now: Column) -> DataFrame:
    return _where(manifest, _owned(token), {"heartbeat_at": now})


def complete(manifest: DataFrame, results: DataFrame, token: str, now: Column) -> DataFrame:
    """Results (path, documents_scanned, evidence_rows, output_path) of the lease's own running shards."""
    r = results.select("path", *[F.col(c).alias(f"__{c}") for c in ("documents_scanned", "evidence_rows", "output_path")], F.lit(True).alias("__d"))
    df = manifest.join(r, "path", "left")
    mine = F.coalesce("__d", F.lit(False)) & _owned(token)
    new = {c: F.col(f"__{c}") for c in ("documents_scanned", "evidence_rows", "output_path")} | {"status": F.lit("complete"), "finished_at": now, "error": F.lit(None).cast("string")}
    return _where(df, mine, new).select(*manifest.columns)


def fail(manifest: DataFrame, path: str, token: str, error: str, now: Column) -> DataFrame:
    return _where(manifest, _owned(token) & (F.col("path") == path), {"error": F.lit(error), "finished_at": now, "status": F.lit("failed")})


def recover_stale(manifest: DataFrame, now: Column, seconds: int = STALE_SECONDS) -> DataFrame:
    """Running shards without a sign of life for longer than ``seconds`` are to do again."""
    old = (F.col("status") == "running") & (F.unix_timestamp(now) - F.unix_timestamp("heartbeat_at") > seconds)
    return _where(manifest, F.coalesce(old, F.lit(False)), {"lease_token": F.lit(None).cast("string"), "worker_id": F.lit(None).cast("string"), "status": F.lit("pending")})


def retry_failed(manifest: DataFrame) -> DataFrame:
    return _where(manifest, F.col("status") == "failed", {"error": F.lit(None).cast("string"), "status": F.lit("pending")})


def invalidate_complete(manifest: DataFrame) -> DataFrame:
    """After a change of what evidence holds, done shards are to do again."""
    done = F.col("status") == "complete"
    return _where(manifest, done, {"documents_scanned": F.lit(None).cast("bigint"), "evidence_rows": F.lit(None).cast("bigint"), "status": F.lit("pending")})


def status_counts(manifest: DataFrame) -> DataFrame:
    """(status, shards, size_bytes, documents_scanned, evidence_rows); missing numbers count as 0."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return manifest.groupBy("status").agg(F.count(F.lit(1)).alias("shards"), total("size_bytes"), total("documents_scanned"), total("evidence_rows"))


def progress(manifest: DataFrame) -> DataFrame:
    """One row: shares of shards and of bytes that are done, 0 of nothing."""
    done = F.col("status") == "complete"
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return manifest.agg(
        share(F.sum(done.cast("int")), F.count(F.lit(1))).alias("shards_done"),
        share(F.sum(F.when(done, F.col("size_bytes"))), F.sum("size_bytes")).alias("bytes_done"),
    )


def unfinished(manifest: DataFrame) -> DataFrame:
    """Paths that keep a scan from being finalised."""
    return manifest.where(F.coalesce(F.col("status") != "complete", F.lit(True))).select("path")


def latest(history: DataFrame) -> DataFrame:
    """The last state of each shard, where states were appended with ``heartbeat_at``."""
    w = Window.partitionBy("path").orderBy(F.col("heartbeat_at").desc_nulls_last(), F.col("attempts").desc())
    return history.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
