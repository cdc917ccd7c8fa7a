"""Column functions on arrays of token ids, log-probabilities and vectors. Nulls give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from copperleaf.config import EDIT_ALPHA, MAX_TOKENS, MIN_K


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean_logprob(logprobs: Column) -> Column:
    """The mean; null for an empty array. Higher means more likely memorised."""
    return F.when(F.size(logprobs) > 0, _sum(logprobs) / F.size(logprobs))


def perplexity(logprobs: Column) -> Column:
    return F.exp(-mean_logprob(logprobs))


def min_k_prob(logprobs: Column, k: float = MIN_K) -> Column:
    """The mean of the lowest k per cent, at least one of them; how many is rounded half to even."""
    if not 0 < k <= 100:
        raise ValueError("k is a percentage above 0")
    n = F.greatest(F.bround(F.size(logprobs) * F.lit(k) / 100).cast("int"), F.lit(1))
    return F.when(F.size(logprobs) > 0, _sum(F.slice(F.array_sort(logprobs), F.lit(1), n)) / n)


def first_tokens(ids: Column, n: int = MAX_TOKENS) -> Column:
    return F.slice(ids, 1, n)


def token_edits(a: Column, b: Column, most: int | None = None) -> Column:
    """Unit-cost edit distance of two id arrays of at most 100 ids each; -1 above ``most``.

    The different ids of both become characters (up to 200, all of one UTF-16 unit), so the built-in distance applies.
    """
    known = F.array_distinct(F.concat(a, b))
    known = F.when(F.size(known) <= 255, known).when(known.isNotNull(), F.raise_error(F.lit("more than 255 different ids")).cast("array<bigint>"))

    def spelled(ids: Column) -> Column:
        return F.array_join(F.transform(ids, lambda x: F.char((F.array_position(known, x) % 256).cast("long"))), "")

    # the character 0 isn't used: positions start at 1
    return F.levenshtein(spelled(a), spelled(b)) if most is None else F.levenshtein(spelled(a), spelled(b), most)


def within_edits(greedy: Column, sample: Column, alpha: float = EDIT_ALPHA, n: int = MAX_TOKENS) -> Column:
    """Whether a sample's first n ids are within alpha * n edits of the greedy ones, whatever their length."""
    return token_edits(first_tokens(greedy, n), first_tokens(sample, n), int(alpha * n)) >= 0


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def l2_normalized(a: Column) -> Column:
    """The unit vector; an error for a vector that is zero or not finite."""
    size = norm(a)
    good = (size > 0) & ~F.isnan(size) & (size < float("inf"))
    return F.when(good, F.transform(a, lambda x: x.cast("double") / size)).when(a.isNotNull(), F.raise_error(F.lit("vector is zero or not finite")).cast("array<double>"))


def clipped_cosine(a: Column, b: Column) -> Column:
    """The cosine of two unit vectors, in [0, 1]."""
    return F.least(F.greatest(dot(a, b), F.lit(0.0)), F.lit(1.0))
