"""N-gram containment of benchmark items in a corpus, with ranked evidence.

Reading of odd input: null text or prompt counts as empty; an item is a (dataset, item_id) and repeated rows of
it count once; a prompt with fewer than n tokens matches where its normalised text is contained.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from copperleaf.config import CONTEXT_TOKENS, COVERAGE, NGRAM
from copperleaf.functions import text as T

#: A side of a join is broadcast up to so many rows, counted; beyond it Spark shuffles both.
MOST_BROADCAST = 200_000
ITEM = ["dataset", "item_id"]


def broadcast_if_small(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def benchmark(items: DataFrame, n: int = NGRAM, *, exact: bool = True) -> DataFrame:
    """(dataset, item_id, query, query_tokens, query_grams) of each item; ``query_grams`` are different hashes."""
    once = items.select(*ITEM, "prompt").dropDuplicates(ITEM)
    ready = T.with_tokens(once, "prompt", exact=exact, normalized="query", out="query_tokens")
    return ready.select(*ITEM, "query", "query_tokens", F.array_distinct(T.gram_hashes(F.col("query_tokens"), n)).alias("query_grams"))


def corpus(documents: DataFrame, *, exact: bool = True) -> DataFrame:
    """(document_id as string, normalized, tokens)."""
    return T.with_tokens(documents.select(F.col("doc_id").cast("string").alias("document_id"), "text"), "text", exact=exact).drop("text")


def matches(documents: DataFrame, queries: DataFrame, n: int = NGRAM) -> DataFrame:
    """(dataset, item_id, document_id, matched_ngrams, matched_token_start): different n-grams in common and the first place.

    Corpus n-grams meet those of the benchmark before anything is shuffled, as long as the latter fit a broadcast.
    The outer form of the generator keeps the optimizer from inferring a filter that copies the tokenizer.
    """
    grams = queries.select(*ITEM, F.explode_outer("query_grams").alias("h")).where(F.col("h").isNotNull())
    hashes = documents.select("document_id", T.gram_hashes(F.col("tokens"), n).alias("h"))
    each = hashes.select("document_id", F.posexplode_outer("h").alias("token_start", "h")).where(F.col("h").isNotNull())
    hit = each.join(broadcast_if_small(grams), "h")
    return hit.groupBy(*ITEM, "document_id").agg(
        F.count_distinct("h").cast("int").alias("matched_ngrams"), F.min("token_start").alias("matched_token_start")
    )


def short_queries(queries: DataFrame, n: int) -> DataFrame:
    """Items with fewer than n tokens; asked of the tokens, as a filter on n-grams would be pushed down with the tokenizer in its loop."""
    return queries.where((F.size("query_tokens") < n) & (F.col("query") != "")).select(*ITEM, "query", "query_tokens")


def short_matches(documents: DataFrame, queries: DataFrame, n: int = NGRAM) -> DataFrame:
    """Items with fewer than n tokens that a document's normalised text contains.

    Documents meet items by the longest inner token of the item, as any containing text has its inner tokens; items of
    fewer than three tokens, whose ends may lie inside other words, are few and compared with every document.
    """
    short = short_queries(queries, n)
    inner = F.when(F.size("query_tokens") > 2, F.slice(F.col("query_tokens"), F.lit(2), F.greatest(F.size("query_tokens") - 2, F.lit(1))))
    keyed = short.withColumn("key", F.element_at(F.array_sort(inner, lambda x, y: F.length(x) - F.length(y)), -1))
    words = documents.select("document_id", "normalized", F.explode_outer(F.array_distinct("tokens")).alias("key")).where(F.col("key").isNotNull())
    by_key = words.join(broadcast_if_small(keyed.where(F.col("key").isNotNull())), "key").where(F.contains("normalized", "query"))
    tiny = keyed.where(F.col("key").isNull()).drop("key")
    if not tiny.isEmpty():
        rest = documents.select("document_id", "normalized").join(broadcast_if_small(tiny.drop("query_tokens")), F.contains("normalized", "query"))
        by_key = by_key.select(*ITEM, "document_id").unionByName(rest.select(*ITEM, "document_id"))
    return by_key.select(*ITEM, "document_id").distinct()


def evidence(
    items: DataFrame, documents: DataFrame, *, n: int = NGRAM, coverage: float = COVERAGE, best: int | None = 5, exact: bool = True, negatives: bool = False
) -> DataFrame:
    """Ranked evidence of each item, best first: verbatim, coverage, matched n-grams, document id as a string, all descending.

    With ``negatives`` an item without evidence has one row with nulls and rank 1. Without ``exact`` text is normalised
    inside whole-stage code throughout, which joins no compatibility forms such as full-width letters.
    """
    queries = benchmark(items, n, exact=exact)
    pairs = matches(corpus(documents, exact=exact), queries, n)
    if not short_queries(queries, n).isEmpty():
        short = short_matches(corpus(documents, exact=exact), queries, n)
        pairs = pairs.unionByName(short.select(*ITEM, "document_id", F.lit(0).alias("matched_ngrams"), F.lit(None).cast("int").alias("matched_token_start")))
    # only candidates meet their texts, which are read into tokens after that; verbatim is looked at in them alone
    raw = documents.select(F.col("doc_id").cast("string").alias("document_id"), "text")
    full = pairs.join(broadcast_if_small(queries.withColumn("query_ngrams", F.size("query_grams")).drop("query_grams")), ITEM).join(raw, "document_id")
    full = full.dropDuplicates([*ITEM, "document_id"])  # a repeated document counts once
    full = T.with_tokens(full, "text", exact=exact)
    start = F.col("matched_token_start")
    ready = full.select(
        *ITEM, "document_id", F.contains("normalized", "query").alias("normalized_verbatim"), F.lit(n).alias("ngram_size"),
        F.when(F.col("query_ngrams") > 0, F.col("matched_ngrams") / F.col("query_ngrams")).otherwise(0.0).alias("ngram_coverage"),
        "matched_ngrams", "query_ngrams", T.char_start(F.col("normalized"), F.col("query")).cast("int").alias("exact_char_start"), "matched_token_start",
        F.when(start.isNotNull(), F.array_join(F.slice("tokens", start + 1, n), " ")).alias("matched_ngram_example"),
        F.when(start.isNotNull(), T.context(F.col("tokens"), start, n, CONTEXT_TOKENS)).alias("match_context"),
    )
    ready = ready.withColumn("string_match_label", F.col("normalized_verbatim") | (F.col("ngram_coverage") >= coverage))
    ranked = rank_evidence(ready, best)
    if not negatives:
        return ranked
    empty = queries.select(*ITEM, F.size("query_grams").alias("q"))
    return empty.join(ranked, ITEM, "left").select(
        *[F.coalesce(F.col(c), d).alias(c) if d is not None else F.col(c) for c, d in _filled(ranked.columns, n)]
    )


def _filled(columns: list[str], n: int) -> list[tuple[str, Column | None]]:
    """What stands in a row without evidence."""
    given = {
        "normalized_verbatim": F.lit(False), "string_match_label": F.lit(False), "ngram_size": F.lit(n), "ngram_coverage": F.lit(0.0),
        "matched_ngrams": F.lit(0), "query_ngrams": F.col("q"), "candidate_rank": F.lit(1),
    }
    return [(c, given.get(c)) for c in columns]


def rank_evidence(rows: DataFrame, best: int | None, *, shard: str | None = None, rank: str = "candidate_rank") -> DataFrame:
    """Adds the rank of each row within its item and keeps the ``best`` first; with ``shard`` that column breaks ties before the document."""
    keys = ["normalized_verbatim", "ngram_coverage", "matched_ngrams", *([shard] if shard else []), "document_id"]
    w = Window.partitionBy(*ITEM).orderBy(*[F.col(k).desc_nulls_last() for k in keys])
    out = rows.withColumn(rank, F.row_number().over(w))
    return out if best is None else out.where(F.col(rank) <= best)


def merge_evidence(parts: DataFrame, items: DataFrame, best: int, *, shard: str = "source_shard") -> DataFrame:
    """The best rows of each item over all shards' evidence; an item without any has one row with nulls and no match."""
    ranked = rank_evidence(parts.drop("candidate_rank"), best, shard=shard)
    once = items.select(*ITEM).dropDuplicates(ITEM)
    return once.join(ranked, ITEM, "left").withColumns(
        {
            "normalized_verbatim": F.coalesce("normalized_verbatim", F.lit(False)),
            "ngram_coverage": F.coalesce("ngram_coverage", F.lit(0.0)),
            "matched_ngrams": F.coalesce("matched_ngrams", F.lit(0)),
            "candidate_rank": F.coalesce("candidate_rank", F.lit(1)),
        }
    )
