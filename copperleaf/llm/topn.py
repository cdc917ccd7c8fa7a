"""Problem 1: the best N rows of every group, with groups of any size.

Hot-cold split. Exact group counts tell the heavy groups apart. Light groups go through an ordinary window. A
heavy group is cut into score ranges; exact counts of the ranges tell which of them can hold its best N rows,
rows of one range are spread again over as many hashed salts as its exact count asks for, and only the best N of
each salt meet in the last window.

The list of heavy groups joins as Spark sees fit, by its measured size, so there may be any number of them.

Results for odd input: a null group is a group of its own; rows whose order columns tie in all of them are
interchangeable copies; an empty table gives an empty result with the same columns plus the rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from copperleaf.session import materialize

#: A group of more rows is heavy, however large the table is.
HEAVY_ROWS = 5_000
RANGES = 64
#: Rows of a range are spread over salts of about so many.
SALT_ROWS = 100_000


def top_n_per_group(
    df: DataFrame, group: str, score: str, ties: list[str], n: int, *, heavy_rows: int = HEAVY_ROWS, salt_rows: int = SALT_ROWS, rank: str = "rank"
) -> DataFrame:
    """The ``n`` rows of each ``group`` with the greatest ``score``, then the greatest ``ties`` in order.

    ``score`` is numeric; nulls come last. The columns of ``df`` stay, and ``rank`` (1..n) is added. ``df`` is read
    three times: where it is costly, materialise it.
    """
    if rank in df.columns:
        raise ValueError(f"column {rank} exists already")
    order = [F.col(f"`{c}`").desc_nulls_last() for c in [score, *ties]]
    g = F.col(f"`{group}`")
    heavy = df.groupBy(g.alias("__g")).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > heavy_rows)
    # few cuts each, so the list is one row a heavy group
    heavy = materialize(heavy.select("__g", F.lit(True).alias("__heavy")), "heavy")
    marked = df.join(heavy, g.eqNullSafe(F.col("__g")), "left").drop("__g")
    cold = _window(marked.where(F.col("__heavy").isNull()).drop("__heavy"), [g], order, n, rank)
    hot = df.join(heavy.select("__g"), g.eqNullSafe(F.col("__g")), "left_semi")
    return cold.unionByName(_hot(hot, group, score, ties, order, n, rank, salt_rows))


def _window(df: DataFrame, keys: list[Column], order: list[Column], n: int, rank: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(f"`{rank}`") <= n)


def _hot(df: DataFrame, group: str, score: str, ties: list[str], order: list[Column], n: int, rank: str, salt_rows: int) -> DataFrame:
    g, s = F.col(f"`{group}`"), F.col(f"`{score}`").cast("double")
    cuts = df.groupBy(g.alias("__g")).agg(F.percentile_approx(s, [i / RANGES for i in range(1, RANGES)], 1_000).alias("__cuts"))
    ranged = df.join(cuts, g.eqNullSafe(F.col("__g"))).drop("__g")
    # 0 is the best range; equal scores share a range, null scores take the last one
    ranged = ranged.withColumn(
        "__range", F.when(s.isNull(), RANGES + 1).otherwise(F.size(F.filter(F.coalesce("__cuts", F.array()), lambda c: c > s)))
    ).drop("__cuts")
    sizes = ranged.groupBy(g.alias("__g"), F.col("__range").alias("__r")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__g").orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    needed = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).where(F.col("__before") < n)
    needed = needed.select("__g", "__r", F.ceil(F.col("__n") / salt_rows).alias("__salts"))
    kept = ranged.join(needed, g.eqNullSafe(F.col("__g")) & (F.col("__range") == F.col("__r")))
    spread = F.xxhash64(*[F.col(f"`{c}`") for c in ties] or [s])
    salted = kept.withColumn("__salt", F.pmod(spread, F.col("__salts"))).drop("__g", "__r", "__salts")
    first = _window(salted, [g, F.col("__range"), F.col("__salt")], order, n, "__rank").drop("__range", "__salt", "__rank")
    return _window(first, [g], order, n, rank)


def best_documents(pairs: DataFrame, n: int = 10, *, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Each item's ``n`` documents with the highest finite retrieval score, a document once with its best score.

    Rows with a null, NaN or infinite score and rows without an item or document do not count. Ties go to the
    greater document_id, compared as a string. Columns: item_id, document_id, retrieval_score, rank.
    """
    s = F.col("retrieval_score")
    finite = pairs.where(
        s.isNotNull() & ~F.isnan(s) & (F.abs(s) < float("inf")) & F.col("item_id").isNotNull() & F.col("document_id").isNotNull()
    )
    best = finite.groupBy("item_id", "document_id").agg(F.max("retrieval_score").alias("retrieval_score"))
    return top_n_per_group(materialize(best, "pairs"), "item_id", "retrieval_score", ["document_id"], n, heavy_rows=heavy_rows)
