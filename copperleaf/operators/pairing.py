"""Comparisons of the same items under two precisions, and differences of rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def paired(df: DataFrame, keys: list[str], value: str, baseline: str, target: str, *, by: str = "quant") -> DataFrame:
    """(keys..., baseline, target): complete pairs only. A key with two rows of one precision has none: see ``duplicates``."""
    one = lambda q: F.max(F.when(F.col(by) == q, F.col(f"`{value}`").cast("double")))
    wide = df.where(F.col(by).isin(baseline, target)).groupBy(*keys).agg(
        one(baseline).alias("baseline"), one(target).alias("target"), F.count(F.lit(1)).alias("__n")
    )
    good = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    return wide.where((F.col("__n") <= 2) & good("baseline") & good("target")).drop("__n")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., n) of keys with more than one row."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def cohens_d(difference: Column) -> Column:
    """Mean over standard deviation of differences; 0 where they are all the same, null below two."""
    sd = F.stddev_samp(difference)
    return F.when(F.count(difference) >= 2, F.when(sd == 0, 0.0).otherwise(F.try_divide(F.avg(difference), sd)))


def pearson(df: DataFrame, x: str, y: str, groups: list[str]) -> DataFrame:
    """(groups..., n, r) from centred sums; 0 where a side is constant, null below two pairs."""
    a, b = F.col(f"`{x}`").cast("double"), F.col(f"`{y}`").cast("double")
    both = df.where(a.isNotNull() & b.isNotNull())
    by = [F.col(f"`{g}`") for g in groups]
    constant = (F.min(a) == F.max(a)) | (F.min(b) == F.max(b))
    r = F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))
    out = F.when(F.count(F.lit(1)) >= 2, F.when(constant, 0.0).otherwise(F.coalesce(r, F.lit(0.0))))
    return both.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), out.alias("r"))


def score_shift(scores: DataFrame, items: DataFrame, baseline: str, target: str) -> DataFrame:
    """(model, detector, dataset, n_pairs, mean_shift, cohens_d): the paired shift of detector scores; cells below two pairs have no row."""
    labels = items.select("item_id", "dataset").dropDuplicates(["item_id"])
    pairs = paired(scores, ["model", "detector", "item_id"], "score", baseline, target).join(labels, "item_id")
    d = F.col("target") - F.col("baseline")
    return pairs.groupBy("model", "detector", "dataset").agg(F.count(F.lit(1)).alias("n_pairs"), F.avg(d).alias("mean_shift"), cohens_d(d).alias("cohens_d")).where("n_pairs >= 2")


def base_rates(generations: DataFrame, items: DataFrame) -> DataFrame:
    """(model, quant, dataset, n, pass_rate) of the greedy rows."""
    labels = items.select("item_id", "dataset").dropDuplicates(["item_id"])
    greedy = generations.where(F.col("is_greedy") & F.col("passed").isNotNull()).dropDuplicates(["model", "quant", "item_id", "sample_id"])
    return greedy.join(labels, "item_id").groupBy("model", "quant", "dataset").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("passed").cast("int")).alias("pass_rate")
    )


def rates_by(df: DataFrame, outcome: str, groups: list[str]) -> DataFrame:
    """(groups..., rate): the mean of a boolean."""
    return df.groupBy(*groups).agg(F.avg(F.col(f"`{outcome}`").cast("int")).alias("rate"))


def did_points(df: DataFrame, outcome: str, baseline: str, target: str, groups: list[str] | None = None, *, by: str = "quant", label: str = "contaminated") -> DataFrame:
    """(groups..., did_pp): 100 [(t, T) - (b, T) - ((t, F) - (b, F))]; null where one of the four cells is empty."""
    y, q, c = F.col(f"`{outcome}`").cast("int"), F.col(by), F.col(label).cast("boolean")
    cell = lambda quant, truth: F.avg(F.when((q == quant) & (c == F.lit(truth)), y))
    did = 100 * ((cell(target, True) - cell(baseline, True)) - (cell(target, False) - cell(baseline, False)))
    return df.groupBy(*(groups or [])).agg(did.alias("did_pp"))


def did_by_difficulty(df: DataFrame, outcome: str, baseline: str, target: str, *, groups: list[str] | None = None) -> DataFrame:
    """(groups..., difficulty, did_pp) of the difficulties that have both labels; rows without a difficulty don't count."""
    groups = groups or []
    known = df.where(F.col("difficulty").isNotNull())
    both = known.groupBy(*groups, "difficulty").agg(F.count_distinct("contaminated").alias("__n")).where("__n = 2").drop("__n")
    return did_points(known.join(both, [*groups, "difficulty"], "left_semi"), outcome, baseline, target, [*groups, "difficulty"])


def timing(generations: DataFrame, columns: tuple[str, ...] = ("generation_seconds", "prompt_scoring_seconds", "sandbox_scoring_seconds")) -> DataFrame:
    """(stage, n, total_seconds, mean_seconds, items_per_second) of the greedy rows; a stage without values has no row."""
    greedy = generations.where("is_greedy")
    stages = F.array(*[F.struct(F.lit(c).alias("stage"), F.col(c).alias("seconds")) for c in columns])
    each = greedy.select(F.inline(stages)).where(F.col("seconds").isNotNull())
    total = F.sum("seconds")
    return each.groupBy("stage").agg(
        F.count(F.lit(1)).alias("n"), total.alias("total_seconds"), F.avg("seconds").alias("mean_seconds"),
        F.try_divide(F.count(F.lit(1)).cast("double"), total).alias("items_per_second"),
    )
