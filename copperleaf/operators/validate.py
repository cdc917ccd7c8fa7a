"""Checks of tables. Each returns the rows that break a rule; ``require_empty`` turns them into an error."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copperleaf.config import COVERAGE_STATES, DETECTORS
from copperleaf.functions.text import fine_label, trivial_decision

EMPTY, FOUND = COVERAGE_STATES[1:]


def require_empty(violations: DataFrame, message: str) -> None:
    """An error that shows some of the rows, if there are any."""
    rows = violations.limit(5).collect()
    if rows:
        raise ValueError(f"{message}: {', '.join(str(tuple(r)) for r in rows)}")


def with_passed(generations: DataFrame) -> DataFrame:
    """Adds ``passed`` (a partial pass rate of 1) only where the column is missing; nulls in an existing one are an error."""
    if "passed" not in generations.columns:
        return generations.withColumn("passed", F.coalesce(F.col("partial_pass_rate") == 1.0, F.lit(False)))
    require_empty(generations.where(F.col("is_greedy") & F.col("passed").isNull()).select("model", "quant", "item_id"), "passed is null")
    return generations


def completeness(items: DataFrame, generations: DataFrame, scores: DataFrame, *, models: int, quants: int, n_items: int, samples: int) -> DataFrame:
    """(table, expected, found) of the tables whose number of rows isn't that of the manifest."""
    cells = models * quants * n_items
    want = [("items", n_items), ("generations", cells * (samples + 1)), ("detector_scores", cells * len(DETECTORS))]
    parts = None
    for (name, n), df in zip(want, (items, generations, scores)):
        row = df.agg(F.lit(name).alias("table"), F.lit(n).cast("long").alias("expected"), F.count(F.lit(1)).alias("found"))
        parts = row if parts is None else parts.unionByName(row)
    return parts.where(F.col("expected") != F.col("found"))


def unknown_items(rows: DataFrame, items: DataFrame) -> DataFrame:
    """The item ids of rows that aren't items."""
    return rows.select("item_id").join(items.select("item_id"), "item_id", "left_anti").distinct()


def pooled_cells(cells: DataFrame, groups: list[str], pair: tuple[str, str] = ("humaneval", "mbppplus")) -> DataFrame:
    """Groups that mix two datasets which may not be pooled."""
    has = lambda d: F.bool_or(F.col("dataset") == d)
    return cells.groupBy(*groups).agg((F.coalesce(has(pair[0]), F.lit(False)) & F.coalesce(has(pair[1]), F.lit(False))).alias("__p")).where("__p").drop("__p")


def overlap(left: DataFrame, right: DataFrame, key: str = "item_id") -> DataFrame:
    """Keys that two splits share; calibration and evaluation may share none."""
    return left.select(key).intersect(right.select(key))


#: Fields of a pair record that may be neither null nor empty.
PAIR_TEXTS = (
    "run_id", "benchmark", "item_id", "corpus", "corpus_revision", "shard", "document_id", "benchmark_description", "training_description",
    "normalized_benchmark_description", "normalized_training_description", "retrieval_method", "prompt_version", "run_timestamp",
)


def _violations(rows: DataFrame, key: list[str], rules: dict[str, Column]) -> DataFrame:
    """A row for each rule that is true of a record; a rule that is null isn't."""
    broken = F.array_compact(F.array(*[F.when(F.coalesce(r, F.lit(False)), F.lit(n)) for n, r in rules.items()]))
    return rows.select(*key, F.explode(broken).alias("rule"))


def _no_text(names: tuple[str, ...]) -> Column:
    return reduce(or_, [F.coalesce(F.trim(F.col(n)) == "", F.lit(True)) for n in names])


def _not_finite(c: Column) -> Column:
    return c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))


def pair_violations(pairs: DataFrame) -> DataFrame:
    """(pair_id, rule) of pair records that contradict themselves."""
    label, pre, route = F.col("final_fine_grained_label"), F.col("pre_screen_label"), F.col("triage_route")
    screens = [F.col(f"{side}_trivial_screen") for side in ("benchmark", "training")]
    trivial = reduce(or_, [F.coalesce(s["is_trivial"], F.lit(False)) for s in screens])
    answer, score, d = F.col("raw_verification_output"), F.col("embedding_score"), F.col("decoding_config")
    expected = F.when(~F.col("excluded"), pre != "U")
    rules = {
        "text": _no_text(PAIR_TEXTS),
        "score": _not_finite(F.col("retrieval_score")) | _not_finite(score) | (score < 0) | (score > 1),
        "label": ~label.eqNullSafe(pre) | ~pre.isin("FI", "NI", "SL", "U"),
        "excluded": ~F.col("excluded").eqNullSafe(trivial),
        "binary": ~F.col("binary_contamination_label").eqNullSafe(expected),
        "route": F.when(route == "direct_fi", (pre != "FI") | answer.isNotNull()).when(route == "direct_u", (pre != "U") | answer.isNotNull()).when(
            route == "verify", ~fine_label(answer).eqNullSafe(pre)).otherwise(True),
        "screen": reduce(or_, [s["raw_output"].isNull() != s["is_trivial"].isNull() for s in screens]),
        "screen_answer": reduce(or_, [s["raw_output"].isNotNull() & ~trivial_decision(s["raw_output"]).eqNullSafe(s["is_trivial"]) for s in screens]),
        "decoding": _not_finite(d["temperature"]) | (d["temperature"] < 0) | _not_finite(d["top_p"]) | (d["top_p"] <= 0) | (d["top_p"] > 1) | (d["max_output_tokens"] <= 0),
    }
    return _violations(pairs.where(F.col("record_type") == "pair"), ["pair_id"], rules)


def coverage_violations(rows: DataFrame) -> DataFrame:
    """(run_id, item_id, rule) of coverage records that contradict themselves."""
    expected, searched, n, status = (F.col(c) for c in ("expected_shards", "searched_shards", "candidate_count", "status"))
    rules = {
        "shards": (expected < 0) | (searched < 0) | (searched > expected),
        "not_searched": (status == "not_searched") & (n.isNotNull() | (searched != 0)),
        "complete": (status != "not_searched") & (searched != expected),
        "candidates": F.when(status == EMPTY, ~n.eqNullSafe(F.lit(0))).when(status == FOUND, F.coalesce(n <= 0, F.lit(True))),
        "status": ~F.coalesce(status.isin("not_searched", EMPTY, FOUND), F.lit(False)),
    }
    return _violations(rows, ["run_id", "item_id"], rules)


def coverage_status(rows: DataFrame) -> DataFrame:
    """Adds the state of a search: not searched, complete without, complete with candidates; null where a part is missing."""
    done = F.col("searched_shards") >= F.col("expected_shards")
    state = F.when(F.coalesce("searched_shards", F.lit(0)) == 0, "not_searched").when(
        done, F.when(F.coalesce("candidate_count", F.lit(0)) > 0, FOUND).otherwise(EMPTY)
    )
    return rows.withColumn("status", state)
