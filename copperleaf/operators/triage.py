"""From descriptions to labels of candidate pairs: similarity, routing, verdicts."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copperleaf.config import TRIAGE_HIGH, TRIAGE_LOW
from copperleaf.functions import text as T


def route(score: Column, high: float = TRIAGE_HIGH, low: float = TRIAGE_LOW) -> Column:
    """direct_fi from ``high`` on, direct_u up to ``low``, verify between; an error for a score that is no similarity."""
    bad = score.isNull() | F.isnan(score) | (score < 0) | (score > 1)
    return F.when(bad, F.raise_error(F.lit("similarity outside [0, 1]")).cast("string")).when(score >= high, "direct_fi").when(score <= low, "direct_u").otherwise("verify")


def _unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    if not (np.isfinite(size) & (size > 0)).all():
        raise ValueError("vector is zero or not finite")
    return rows / size


def block_cosine(queries: DataFrame, vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", least: float, block: int = 1_000, most: int = 100_000) -> DataFrame:
    """(query_id, vec_id, score) of the pairs of a stated query set and all vectors with a clipped cosine of ``least`` or more.

    Queries are taken in blocks; a block is broadcast (``block`` vectors) and every vector meets it in one matrix
    product a batch. A row's own vector isn't its match.
    """
    kind = vectors.schema[key].dataType.simpleString()
    q = queries.select(F.col(key).alias("k"), F.col(vector).alias("v")).orderBy("k").limit(most + 1).collect()
    if len(q) > most:
        raise ValueError("state fewer queries at a time")
    out = None
    for start in range(0, len(q), block):
        part = q[start : start + block]
        ids = [r[0] for r in part]
        m = _unit(np.array([r[1] for r in part], np.float64))
        shared = vectors.sparkSession.sparkContext.broadcast((ids, m))

        def run(batches, shared=shared):
            ids, m = shared.value
            for pdf in batches:
                if not len(pdf):
                    continue
                x = _unit(np.stack(pdf[vector].to_numpy()).astype(np.float64))
                s = np.clip(x @ m.T, 0, 1)
                i, j = np.nonzero(s >= least)
                own = pdf[key].to_numpy()[i]
                other = np.array(ids, dtype=object)[j]
                keep = own != other
                yield pd.DataFrame({"query_id": other[keep], key: own[keep], "score": s[i, j][keep]})

        some = vectors.select(key, vector).where(F.col(vector).isNotNull()).mapInPandas(run, f"query_id {kind}, {key} {kind}, score double")
        out = some if out is None else out.unionByName(some)
    return out if out is not None else vectors.select(F.col(key).alias("query_id"), key, F.lit(0.0).alias("score")).limit(0)


def cached_map(df: DataFrame, column: str, function: Column | Callable[[Column], Column], out: str, cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``df`` with a costly function of a column, worked out once a different value, and the new cache.

    ``cache`` has (column, out) of values that are known; only others are worked out.
    """
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    todo = values if cache is None else values.join(cache.select(column), column, "left_anti")
    new = todo.withColumn(out, function(F.col(column)) if callable(function) else function)
    everything = new if cache is None else cache.select(column, out).unionByName(new)
    return df.join(everything, column, "left").select(*df.columns, out), everything


def finalize(pairs: DataFrame, *, label: str = "pre_screen_label") -> DataFrame:
    """Adds the outcome of pairs: excluded if either side is trivial, with its label kept; the binary label then is null, else label <> U."""
    excluded = F.coalesce("benchmark_is_trivial", F.lit(False)) | F.coalesce("training_is_trivial", F.lit(False))
    return pairs.withColumns(
        {"excluded": excluded, "final_fine_grained_label": F.col(label), "binary_contamination_label": F.when(~excluded, F.col(label) != "U")}
    )


def run_pairs(
    pairs: DataFrame, embedding_score: Column, verify: Callable[[Column, Column], Column], screen: Callable[[Column], Column], *, high: float = TRIAGE_HIGH, low: float = TRIAGE_LOW
) -> DataFrame:
    """The whole stage over pairs with normalised descriptions. ``verify`` and ``screen`` are column functions, as a rule Arrow UDFs.

    Rows are parted by route before anything costly, so it sees only those that need it; screening sees labels other
    than U. An answer in another form is an error. The raw outputs of verification and screening stay.
    """
    b, t = F.col("normalized_benchmark_description"), F.col("normalized_training_description")
    routed = pairs.withColumn("embedding_score", embedding_score).withColumn("triage_route", route(F.col("embedding_score"), high, low))
    direct = routed.where("triage_route <> 'verify'").withColumn("raw_verification_output", F.lit(None).cast("string"))
    direct = direct.withColumn("pre_screen_label", F.when(F.col("triage_route") == "direct_fi", "FI").otherwise("U"))
    asked = routed.where("triage_route = 'verify'").withColumn("raw_verification_output", verify(b, t))
    asked = asked.withColumn("pre_screen_label", _parsed(T.fine_label(F.col("raw_verification_output")), "the verifier's answer"))
    labelled = direct.unionByName(asked)
    unknown = {f"{s}_{c}": F.lit(None).cast(k) for s in ("benchmark", "training") for c, k in (("trivial_output", "string"), ("is_trivial", "boolean"))}
    plain = labelled.where("pre_screen_label = 'U'").withColumns(unknown)
    screened = labelled.where("pre_screen_label <> 'U'").withColumns({"benchmark_trivial_output": screen(b), "training_trivial_output": screen(t)})
    screened = screened.withColumns({f"{s}_is_trivial": _parsed(T.trivial_decision(F.col(f"{s}_trivial_output")), "the screener's answer") for s in ("benchmark", "training")})
    return finalize(plain.unionByName(screened))


def _parsed(value: Column, what: str) -> Column:
    """The value of an answer; an answer in another form is an error, so that no pair is lost without a word."""
    return F.when(value.isNotNull(), value).otherwise(F.raise_error(F.lit(f"{what} has another form than asked for")))


__all__ = ["block_cosine", "cached_map", "finalize", "route", "run_pairs"]
