"""Metrics of scores against labels, per group, from a histogram of different scores.

A histogram has at most one row a different score, and running sums over it are per group, so no group is ever
sorted row by row. Rows with a null score or label don't count; NaN scores sort as the greatest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from copperleaf.config import GATE_AUC, PEAKEDNESS_THRESHOLD


def _histogram(df: DataFrame, score: str, label: str, groups: list[str]) -> DataFrame:
    s, y = F.col(f"`{score}`"), F.col(f"`{label}`").cast("boolean")
    keys = [F.col(f"`{g}`") for g in groups]
    return df.where(s.isNotNull() & y.isNotNull()).groupBy(*keys, s.cast("double").alias("__s")).agg(
        F.sum(y.cast("long")).alias("__p"), F.sum((~y).cast("long")).alias("__n")
    )


def _by(groups: list[str]) -> list:
    return [F.col(f"`{g}`") for g in groups] or [F.lit(1)]


def empirical_auc(df: DataFrame, score: str, label: str, groups: list[str] | None = None) -> DataFrame:
    """(groups..., n_positive, n_negative, auc): Mann-Whitney, ties one half; null where a class is missing."""
    groups = groups or []
    h = _histogram(df, score, label, groups)
    below = Window.partitionBy(*_by(groups)).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    wins = F.col("__p") * (F.coalesce(F.sum("__n").over(below), F.lit(0)) + F.col("__n") / 2)
    out = h.withColumn("__w", wins).groupBy(*[F.col(f"`{g}`") for g in groups]).agg(
        F.sum("__p").alias("n_positive"), F.sum("__n").alias("n_negative"), F.sum("__w").alias("__w")
    )
    auc = F.try_divide(F.col("__w"), F.col("n_positive").cast("double") * F.col("n_negative"))
    return out.select(*[F.col(f"`{g}`") for g in groups], "n_positive", "n_negative", auc.alias("auc"))


def youden(df: DataFrame, score: str, label: str, groups: list[str] | None = None) -> DataFrame:
    """(groups..., threshold, j): the score that best parts the classes when greater scores count as positive.

    Only scores that occur are thresholds; of equally good ones the least is taken; a missing class counts as 0.
    """
    groups = groups or []
    h = _histogram(df, score, label, groups)
    above = Window.partitionBy(*_by(groups)).orderBy(F.col("__s").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*_by(groups))
    rate = lambda c: F.coalesce(F.try_divide(F.coalesce(F.sum(c).over(above), F.lit(0)), F.sum(c).over(whole)), F.lit(0.0))
    j = h.withColumn("j", rate("__p") - rate("__n"))
    best = j.groupBy(*[F.col(f"`{g}`") for g in groups]).agg(F.max_by(F.struct("__s", "j"), F.struct(F.col("j"), -F.col("__s"))).alias("__b"))
    return best.select(*[F.col(f"`{g}`") for g in groups], F.col("__b.__s").alias("threshold"), F.col("__b.j").alias("j"))


def youden_at(df: DataFrame, score: str, label: str, threshold: float, groups: list[str] | None = None) -> DataFrame:
    """(groups..., j) at one threshold; a missing class counts as 0."""
    s, y = F.col(f"`{score}`"), F.col(f"`{label}`").cast("boolean")
    share = lambda c: F.coalesce(F.avg(F.when(c, (s > threshold).cast("double"))), F.lit(0.0))
    return df.where(s.isNotNull() & y.isNotNull()).groupBy(*[F.col(f"`{g}`") for g in groups or []]).agg((share(y) - share(~y)).alias("j"))


def classify(df: DataFrame, score: str, threshold: float = PEAKEDNESS_THRESHOLD, out: str = "contaminated") -> DataFrame:
    """Strictly above the threshold; null stays null."""
    return df.withColumn(out, F.col(f"`{score}`") > threshold)


def gate(df: DataFrame, auc: str = "auc", least: float = GATE_AUC) -> DataFrame:
    """Whether a detector's AUC is enough; null AUC is not."""
    return df.withColumn("passes_gate", F.coalesce(F.col(f"`{auc}`") >= least, F.lit(False)))


def error_rate(df: DataFrame, proxy: str, truth: str, groups: list[str] | None = None) -> DataFrame:
    """(groups..., n, error_rate): how often two labels differ, over rows that have both."""
    a, b = F.col(f"`{proxy}`").cast("boolean"), F.col(f"`{truth}`").cast("boolean")
    known = df.where(a.isNotNull() & b.isNotNull())
    return known.groupBy(*[F.col(f"`{g}`") for g in groups or []]).agg(F.count(F.lit(1)).alias("n"), F.avg((a != b).cast("int")).alias("error_rate"))
