"""Detector scores of generations; higher always means more likely memorised."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copperleaf.config import EDIT_ALPHA, MAX_TOKENS, MIN_K
from copperleaf.functions import arrays as A

CELL = ["model", "quant", "item_id"]


def peakedness(generations: DataFrame, alpha: float = EDIT_ALPHA, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """(model, quant, item_id, n_samples, peakedness): the share of samples within alpha * max_tokens edits of the greedy output.

    A cell without a greedy row, or without samples with ids, has no row. Repeated rows count once.
    """
    rows = generations.where(F.col("token_ids").isNotNull()).dropDuplicates([*CELL, "sample_id"])
    ids = A.first_tokens(F.col("token_ids"), max_tokens)
    greedy = rows.where("is_greedy").groupBy(*CELL).agg(F.min_by(ids, "sample_id").alias("greedy"))
    samples = rows.where(~F.col("is_greedy")).select(*CELL, ids.alias("sample"))
    near = A.token_edits(F.col("greedy"), F.col("sample"), int(alpha * max_tokens)) >= 0
    return samples.join(greedy, CELL).groupBy(*CELL).agg(F.count(F.lit(1)).alias("n_samples"), F.avg(near.cast("int")).alias("peakedness"))


def logprob_scores(generations: DataFrame, k: float = MIN_K) -> DataFrame:
    """(model, quant, item_id, detector, score) from the greedy rows' log-probabilities.

    Those of the prompt decide; those of the completion are a second look. Rows without values have no score.
    """
    greedy = generations.where("is_greedy").dropDuplicates([*CELL, "sample_id"])
    prompt, completion = F.col("prompt_token_logprobs"), F.col("token_logprobs")
    scores = {
        "perplexity": A.mean_logprob(prompt), "mink_prob": A.min_k_prob(prompt, k),
        "completion_perplexity": A.mean_logprob(completion), "completion_mink_prob": A.min_k_prob(completion, k),
    }
    pairs = F.array(*[F.struct(F.lit(n).alias("detector"), s.alias("score")) for n, s in scores.items()])
    return greedy.select(*CELL, F.inline(pairs)).where(F.col("score").isNotNull())


def detector_scores(generations: DataFrame) -> DataFrame:
    """(model, quant, item_id, detector, score) of all five detectors."""
    cdd = peakedness(generations).select(*CELL, F.lit("cdd").alias("detector"), F.col("peakedness").alias("score"))
    return cdd.unionByName(logprob_scores(generations))
