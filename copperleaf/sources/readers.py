"""Reading items, corpora, releases and record files. Schemas are given, never inferred."""

from __future__ import annotations

import glob
import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from copperleaf import schemas


def read_run(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, generations, detector_scores) of a run's part files; one error that names all that are missing."""
    want = {"items": schemas.ITEMS, "generations": schemas.GENERATIONS, "detector_scores": schemas.DETECTOR_SCORES}
    found = {n: sorted(glob.glob(os.path.join(folder, "items.parquet" if n == "items" else f"{n}*.parquet"))) for n in want}
    if missing := [n for n, paths in found.items() if not paths]:
        raise FileNotFoundError(f"{folder} lacks {', '.join(missing)}")
    return tuple(spark.read.schema(want[n]).parquet(*found[n]) for n in want)


def read_documents(spark: SparkSession, path: str | list[str], *, cap: int | None = None) -> DataFrame:
    """JSON lines, plain or compressed by suffix (gz, zst), as documents with the shard each came from; blank lines are skipped.

    A record without an id gets its file and its place in it.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    record = F.from_json("value", schemas.DOCUMENTS)
    rows = lines.select(record.alias("r"), F.input_file_name().alias("shard"), F.monotonically_increasing_id().cast("string").alias("n"))
    rows = rows.select(F.coalesce("r.id", F.concat_ws(":", "shard", "n")).alias("id"), "r.text", "r.source", "r.version", "r.created", "r.added", "shard")
    return rows if cap is None else rows.limit(cap)


def read_release(spark: SparkSession, release: str, files: dict[str, list[str]], schema: str) -> DataFrame:
    """The rows of a release: its files in order, as one table."""
    if release not in files:
        raise KeyError(f"unknown release {release}; there are {', '.join(sorted(files))}")
    return spark.read.schema(schema).json(files[release])


def problems_to_items(rows: DataFrame, release: str, boundary: str) -> DataFrame:
    """Problem rows to items, split at a contest date: before it is lcb_pre. A row without a date is an error later on: its dataset is null."""
    date = F.to_timestamp("contest_date")
    dataset = F.when(date < F.lit(boundary).cast("timestamp"), "lcb_pre").when(date.isNotNull(), "lcb_post")
    return rows.select(
        F.col("question_id").alias("item_id"), dataset.alias("dataset"), F.col("question_content").alias("prompt"), "difficulty",
        (dataset != "lcb_post").alias("contamination_proxy"), F.lit(None).cast("double").alias("tracer_label"), F.lit(release).alias("release_version"),
        F.to_json(F.struct("platform", "contest_date", F.get_json_object("metadata", "$.func_name").alias("func_name"))).alias("metadata_json"),
    )


def fixed_size(df: DataFrame, n: int, name: str) -> DataFrame:
    """The table, if it has n rows; else an error: the upstream file has drifted."""
    if (found := df.count()) != n:
        raise ValueError(f"{name} has {found} rows, not {n}")
    return df


def all_items(parts: list[DataFrame], *, first: int | None = None) -> DataFrame:
    """The items of all conditions; ``first`` keeps so many of each, in the order of its input.

    Input order is file order, so numbering is by the row's place in its files, not by a sort.
    """
    out = None
    for i, part in enumerate(parts):
        part = part.withColumn("__o", F.monotonically_increasing_id()).withColumn("__p", F.lit(i))
        out = part if out is None else out.unionByName(part)
    if first is not None:
        w = Window.partitionBy("dataset").orderBy("__p", "__o")
        out = out.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= first).drop("__r")
    return out.drop("__o", "__p")


def shortest_items(items: DataFrame, n: int) -> DataFrame:
    """The n items with the shortest prompts, for a smoke test; ties by id."""
    return items.where(F.col("prompt").isNotNull()).orderBy(F.length("prompt"), "item_id").limit(n)


def read_records(spark: SparkSession, path: str, schema: str, kind: str) -> DataFrame:
    """The records of one ``record_type`` in a file of JSON lines; a malformed line is an error that names the file and the line."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(F.input_file_name().alias("f"), F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"))
    broken = parsed.where(F.col("r").isNull() | F.col("r.record_type").isNull()).select("f").limit(1).collect()
    if broken:  # only now is the line's number looked for, in that file
        whole = spark.read.text(broken[0][0], wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("i", "line")).where(F.trim("line") != "")
        first = whole.where(F.from_json("line", schema)["record_type"].isNull()).agg(F.min("i")).first()[0]
        raise ValueError(f"{broken[0][0]}:{(first or 0) + 1}: no record")
    return parsed.select("r.*").where(F.col("record_type") == kind)


def list_shards(spark: SparkSession, folder: str, suffix: str = ".jsonl.zst") -> DataFrame:
    """(path, size_bytes, priority): files by suffix with their size; those whose name inside the folder has software in any case come first."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(folder)
    inside = F.substring_index("path", folder.rstrip("/") + "/", -1)
    return files.select("path", F.col("length").alias("size_bytes"), shard_priority(inside).alias("priority"))


def shard_priority(name: Column) -> Column:
    return F.when(F.contains(F.lower(name), F.lit("software")), 0).otherwise(1)
