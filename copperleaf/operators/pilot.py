"""The analysis of a pilot run: validation, then tidy result tables, and the summary as JSON."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copperleaf.config import GATE_AUC, GATE_ITEMS, GATE_R, GATE_SHIFT, PRIMARY_DETECTORS
from copperleaf.functions import stats
from copperleaf.operators import metrics, pairing, validate
from copperleaf.operators.ngram import broadcast_if_small

# The names of the contrasts.
CONTRASTS = {"lcb_pre_vs_lcb_post": ("lcb_pre", "lcb_post"), "humaneval_vs_lcb_post": ("humaneval", "lcb_post"), "mbppplus_vs_lcb_post": ("mbppplus", "lcb_post")}

PRIMARY = CONTRASTS["lcb_pre_vs_lcb_post"]

#: An effect below comes from rounding.
LEAST_SEEN = 1e-18


def auc_shift(scores: DataFrame, items: DataFrame, baseline: str, target: str) -> DataFrame:
    """(model, detector, n_pairs, auc_baseline, auc_target, auc_shift, r) over complete pairs of the items before and
    after the boundary of the primary contrast: other datasets are not pooled with them."""
    labels = items.where(F.col("dataset").isin(*PRIMARY)).select("item_id", "contamination_proxy").dropDuplicates(["item_id"])
    keys = ["model", "detector"]
    pairs = pairing.paired(scores, [*keys, "item_id"], "score", baseline, target).join(broadcast_if_small(labels), "item_id")
    aucs = [metrics.empirical_auc(pairs, side, "contamination_proxy", keys).select(*keys, F.col("auc").alias(f"auc_{side}")) for side in ("baseline", "target")]
    r = pairing.pearson(pairs, "baseline", "target", keys).withColumnRenamed("n", "n_pairs")
    return r.join(aucs[0], keys).join(aucs[1], keys).select(
        *keys, "n_pairs", "auc_baseline", "auc_target", (F.col("auc_target") - F.col("auc_baseline")).alias("auc_shift"), "r"
    )


def outcomes(generations: DataFrame, items: DataFrame) -> DataFrame:
    """(model, quant, item_id, dataset, difficulty, correct) of the greedy rows."""
    labels = items.select("item_id", "dataset", "difficulty").dropDuplicates(["item_id"])
    greedy = generations.where(F.col("is_greedy") & F.col("passed").isNotNull()).dropDuplicates(["model", "quant", "item_id", "sample_id"])
    return greedy.select("model", "quant", "item_id", F.col("passed").cast("int").alias("correct")).join(broadcast_if_small(labels), "item_id")


def contrast_rows(generations: DataFrame, items: DataFrame, baseline: str, target: str) -> DataFrame:
    """(contrast, model, quant, item_id, difficulty, contaminated, precision, correct) of complete pairs, a row for each contrast it is in."""
    rows = outcomes(generations, items).where(F.col("quant").isin(baseline, target))
    whole = pairing.paired(rows, ["model", "item_id"], "correct", baseline, target).select("model", "item_id")
    rows = rows.join(whole, ["model", "item_id"], "left_semi")
    which = F.array(*[F.struct(F.lit(n).alias("contrast"), F.lit(a).alias("suspect"), F.lit(b).alias("clean")) for n, (a, b) in CONTRASTS.items()])
    each = rows.select("*", F.inline(which)).where((F.col("dataset") == F.col("suspect")) | (F.col("dataset") == F.col("clean")))
    return each.select(
        "contrast", "model", "quant", "item_id", "difficulty", (F.col("dataset") == F.col("suspect")).alias("contaminated"),
        (F.col("quant") == target).cast("int").alias("precision"), "correct",
    )


def q2_summary(rows: DataFrame, baseline: str, target: str) -> DataFrame:
    """(contrast, did_pp, n_pairs, r) from ``contrast_rows``: the pairs are (model, item) and r is of their outcomes."""
    pairs = pairing.paired(rows, ["contrast", "model", "item_id"], "correct", baseline, target)
    r = pairing.pearson(pairs, "baseline", "target", ["contrast"]).withColumnRenamed("n", "n_pairs")
    return pairing.did_points(rows, "correct", baseline, target, ["contrast"]).where(F.col("did_pp").isNotNull()).join(r, "contrast")


def gate_record(aucs: DataFrame, threshold: float = GATE_AUC) -> DataFrame:
    """(model, measured_auc, threshold, passed, assumed_fall, detection_limit) of the peakedness detector's baseline AUC."""
    own = aucs.where(F.col("detector") == "cdd").select("model", F.col("auc_baseline").alias("measured_auc"))
    out = stats.over_table(own, lambda a: stats.delta_auc_of_shift(a, GATE_SHIFT), ["measured_auc"], "assumed_fall")
    out = stats.over_table(out, lambda a: stats.delta_auc_limit(a, GATE_ITEMS, GATE_R), ["measured_auc"], "detection_limit")
    passed = F.coalesce(F.col("measured_auc") >= threshold, F.lit(False))
    return out.select("model", "measured_auc", F.lit(threshold).alias("threshold"), passed.alias("passed"), "assumed_fall", "detection_limit")


def power_recompute(score_shift: DataFrame, aucs: DataFrame, q2: DataFrame) -> DataFrame:
    """(analysis, model, detector, dataset, observed, required_items): items that would detect what the pilot saw;
    null where nothing was seen, be it by rounding alone (more items than a long holds), or where both precisions agree
    in full. Q1 takes the primary detectors."""
    main = F.col("detector").isin(*PRIMARY_DETECTORS)
    none = F.lit(None).cast("string")
    a = score_shift.where(main).select(F.lit("q1a").alias("analysis"), "model", "detector", "dataset", F.abs("cohens_d").alias("observed"), F.lit(None).cast("double").alias("auc"), F.lit(None).cast("double").alias("r"))
    b = aucs.where(main).select(F.lit("q1b"), "model", "detector", none, F.abs("auc_shift"), F.col("auc_baseline"), F.col("r"))
    c = q2.select(F.lit("q2"), none, none, F.col("contrast"), F.abs("did_pp"), F.lit(None).cast("double"), F.lit(None).cast("double"))

    @F.pandas_udf("double")
    def required(analysis: pd.Series, observed: pd.Series, auc: pd.Series, r: pd.Series) -> pd.Series:
        def one(kind, x, auc, r):
            if pd.isna(x) or x < LEAST_SEEN or (kind == "q1b" and (pd.isna(auc) or pd.isna(r) or r >= 1)):
                return None
            n = float({"q1a": lambda: stats.items_for_effect(x), "q1b": lambda: stats.items_for_delta_auc(auc, x, r), "q2": lambda: stats.items_for_did(x)}[kind]())
            return n if n < 2.0**63 else None

        return pd.Series([one(*row) for row in zip(analysis, observed, auc, r)], dtype=float)

    rows = a.union(b).union(c)
    return rows.select("analysis", "model", "detector", "dataset", "observed", required("analysis", "observed", "auc", "r").cast("long").alias("required_items"))


def analyse(
    items: DataFrame, generations: DataFrame, scores: DataFrame, *, baseline: str = "bf16", target: str = "bnb_nf4", config: dict | None = None
) -> dict[str, DataFrame]:
    """All result tables by name. Duplicate items, unknown items and null outcomes are errors.

    With ``config``, the run manifest's, so are missing rows; an error, too, is a primary contrast without a difficulty
    that both of its datasets have.
    """
    if config is not None:
        lacks = validate.completeness(
            items, generations, scores, models=len(config["models"]), quants=len(config["quant_levels"]), n_items=int(config["n_items"]), samples=int(config["n_cdd_samples"])
        )
        validate.require_empty(lacks, "incomplete run")
    validate.require_empty(pairing.duplicates(items, ["item_id"]), "repeated items")
    generations = validate.with_passed(generations)
    validate.require_empty(validate.unknown_items(generations, items), "unknown items")
    validate.require_empty(pairing.duplicates(generations.where("is_greedy"), ["model", "quant", "item_id"]), "repeated greedy rows")
    validate.require_empty(pairing.duplicates(scores, ["model", "quant", "item_id", "detector"]), "repeated scores")
    rows = contrast_rows(generations, items, baseline, target)
    shift, aucs, q2 = pairing.score_shift(scores, items, baseline, target), auc_shift(scores, items, baseline, target), q2_summary(rows, baseline, target)
    strata = pairing.did_by_difficulty(rows, "correct", baseline, target, groups=["contrast"])
    primary = F.col("contrast") == "lcb_pre_vs_lcb_post"
    if not q2.where(primary).isEmpty() and strata.where(primary).isEmpty():
        raise ValueError("the primary contrast has no difficulty that both datasets share")
    return {
        "base_rates": pairing.base_rates(generations, items),
        "score_shift": shift,
        "auc_shift": aucs,
        "q2_summary": q2,
        "gate_record": gate_record(aucs),
        "power_recompute": power_recompute(shift, aucs, q2),
        "did": pairing.did_points(rows, "correct", baseline, target, ["contrast"]).where(F.col("did_pp").isNotNull()),
        "did_by_difficulty": strata,
        "timing": pairing.timing(generations),
        "models": generations.select("model").distinct().orderBy("model"),
    }


def summary_json(tables: dict[str, DataFrame]) -> str:
    """The tables (a row a cell of the design, so small) as one JSON document with sorted keys; NaN is an error."""
    rows = {name: [r.asDict() for r in df.collect()] for name, df in tables.items()}
    rows = {name: sorted(r, key=lambda x: json.dumps(x, sort_keys=True)) for name, r in rows.items()}
    return json.dumps(rows, sort_keys=True, allow_nan=False, indent=1)
