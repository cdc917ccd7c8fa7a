"""An incremental corpus scan: each file once, evidence merged to the best rows of each item.

The checkpoint is the record of files that are done. A batch writes its own evidence and merges it with the table
of the best so far; both are replaced whole under the number of the batch, so a batch that is run again after a
failure gives the same tables. Tables are looked up in whatever file system the folder is in. A folder belongs to the
configuration and the items of its first scan; another one is an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from copperleaf.operators import ngram
from copperleaf.sources.sinks import config_hash


def scan(spark: SparkSession, folder: str, schema: str, items: DataFrame, out: str, *, best: int = 5, n: int = 13, file_format: str = "parquet") -> StreamingQuery:
    """Starts a scan of the files that are there and new; it ends by itself. ``schema`` has doc_id and text."""
    _guard(spark, out, config_hash({"best": best, "n": n, "items": _fingerprint(items)}))
    stream = spark.readStream.schema(schema).format(file_format).load(folder)

    def batch(df: DataFrame, number: int) -> None:
        found = ngram.evidence(items, df, n=n, best=best)
        earlier = [k for k in _batches(spark, out) if k < number]
        if earlier:
            old = spark.read.parquet(f"{out}/best-{max(earlier)}").drop("candidate_rank")
            found = ngram.rank_evidence(old.unionByName(found.drop("candidate_rank")).dropDuplicates([*ngram.ITEM, "document_id"]), best)
        found.write.mode("overwrite").parquet(f"{out}/best-{number}")

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{out}/checkpoint")
    return writer.trigger(availableNow=True).start()


def best_evidence(spark: SparkSession, out: str) -> DataFrame | None:
    """What the scan has found so far; None before its first batch."""
    parts = _batches(spark, out)
    return spark.read.parquet(f"{out}/best-{max(parts)}") if parts else None


def _listed(spark: SparkSession, folder: str) -> list[str]:
    """Paths in a folder of any file system; none where it doesn't exist."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return [str(f.getPath()) for f in system.listStatus(path)] if system.exists(path) else []


def _batches(spark: SparkSession, out: str) -> list[int]:
    """Numbers of the batches whose table was written whole."""
    names = [p.rsplit("/", 1)[1] for p in _listed(spark, out)]
    numbers = [int(n[5:]) for n in names if n.startswith("best-") and n[5:].isdigit()]
    return [k for k in numbers if any(p.endswith("/_SUCCESS") for p in _listed(spark, f"{out}/best-{k}"))]


def _fingerprint(items: DataFrame) -> str:
    """The same for the same items in any order."""
    row = items.select(F.xxhash64(*ngram.ITEM, "prompt").cast("decimal(38,0)").alias("h")).agg(F.count("h"), F.sum("h")).first()
    return f"{row[0]}:{row[1]}"


def _guard(spark: SparkSession, out: str, digest: str) -> None:
    if _listed(spark, f"{out}/config"):
        if (known := spark.read.text(f"{out}/config").first()[0]) != digest:
            raise ValueError(f"{out} belongs to a scan of another configuration or of other items: {known[:12]}, not {digest[:12]}")
    else:
        spark.createDataFrame([(digest,)], "value string").coalesce(1).write.text(f"{out}/config")
