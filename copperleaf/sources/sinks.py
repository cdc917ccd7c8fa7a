"""Writing tables, records and run manifests."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_part(df: DataFrame, folder: str, table: str, *, partition_by: tuple[str, ...] = ("model", "quant"), rows_a_file: int = 1_000_000) -> None:
    """Appends a part; files appear whole or not at all, by the commit protocol. An empty part writes nothing."""
    if not df.isEmpty():
        df.write.mode("append").option("maxRecordsPerFile", rows_a_file).partitionBy(*partition_by).parquet(os.path.join(folder, table))


def write_records(df: DataFrame, folder: str) -> None:
    """JSON lines with keys in alphabetical order."""
    df.select(*sorted(df.columns)).write.mode("overwrite").option("ignoreNullFields", "false").json(folder)


def write_text(path: str, text: str) -> None:
    """A small file, whole or not at all."""
    handle, name = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(name, path)


def config_hash(config: dict) -> str:
    """SHA-256 of the configuration as JSON with sorted keys."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def write_manifest(path: str, config: dict, **more) -> dict:
    """Writes the run's manifest; a manifest of another configuration in its place is an error."""
    digest = config_hash(config)
    if os.path.exists(path) and read_manifest(path)["config_hash"] != digest:
        raise ValueError(f"{path} belongs to another configuration")
    manifest = {"config": config, "config_hash": digest, **more}
    write_text(path, json.dumps(manifest, sort_keys=True, indent=1))
    return manifest


def read_manifest(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def generation_keys(rows: DataFrame) -> DataFrame:
    """Adds the content address of a generation: what its cache is keyed by, the prompt itself included.

    ``model_revision`` and ``generation_config`` count as empty where the table lacks them.
    """
    from copperleaf.functions.text import digest

    fields = ("model", "quant", "item_id", "is_greedy", "sample_id", "prompt", "decoding_temperature", "model_revision", "generation_config")
    return rows.withColumn("cache_key", digest(*[F.col(c) if c in rows.columns or c not in fields[-2:] else F.lit("") for c in fields]))


def uncached(rows: DataFrame, cache: DataFrame) -> DataFrame:
    """The rows whose key the cache lacks."""
    return rows.join(cache.select("cache_key"), "cache_key", "left_anti")
