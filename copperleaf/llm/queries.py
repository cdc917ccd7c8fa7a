"""The pN_ queries: each takes (spark, sf_dir) and returns a DataFrame over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copperleaf.llm import bpe, cutoff, leaks, packing, spans, topn, toxic, visual
from copperleaf.session import table

#: Tokens of a training sequence.
CAPACITY = 2_048


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topn.best_documents(table(spark, sf_dir, "candidate_pairs")).select("item_id", "document_id")


def p1_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topn.best_documents(table(spark, sf_dir, "candidate_pairs"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "items"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cutoff.cut_generations(table(spark, sf_dir, "generations"), table(spark, sf_dir, "vocab_pieces"))


def p3_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cutoff.cut_rates(table(spark, sf_dir, "generations"), table(spark, sf_dir, "vocab_pieces"))


_SPAN_FIELDS = ["documents.text", "evidence.match_context"]


def _span_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select(F.lit(0).alias("f"), F.col("doc_id").alias("key"), F.col("text").alias("value"))
    evidence = table(spark, sf_dir, "evidence").select(F.lit(1).alias("f"), F.col("evidence_id").alias("key"), F.col("match_context").alias("value"))
    return documents.unionByName(evidence)


def _field_name(f: str = "f"):
    return F.element_at(F.array(*map(F.lit, _SPAN_FIELDS)), F.col(f) + 1).alias("field_name")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.sharing_pairs(_span_records(spark, sf_dir)).select(_field_name(), "key_a", "key_b")


def p4_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each record is shared, beside what the earlier scan says of evidence rows."""
    share = spans.shared_share(_span_records(spark, sf_dir))
    scan = table(spark, sf_dir, "evidence").select(F.lit(1).alias("f"), F.col("evidence_id").alias("key"), "ngram_coverage", "matched_ngrams").dropDuplicates(["key"])
    return share.join(scan, ["f", "key"], "left").select(_field_name(), "key", "n_chars", "shared_chars", "shared_share", "ngram_coverage", "matched_ngrams")


def _read_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        ("documents", "doc_id", "text", "documents.text"),
        ("items", "item_id", "prompt", "items.prompt"),
        ("tracer_pairs", "pair_id", "normalized_training_description", "tracer_pairs.normalized_training_description"),
    ]
    out = None
    for name, key, column, field in parts:
        part = table(spark, sf_dir, name).select(F.lit(field).alias("field_name"), F.col(key).cast("string").alias("key"), F.col(column).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visual.look_alike_pairs(_read_values(spark, sf_dir))


def p5_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value's class in the named method: NFKC, full case folding, one kind of white space, nothing ignorable."""
    return visual.folded_classes(_read_values(spark, sf_dir))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), "doc_id", "text")


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = bpe.encode(table(spark, sf_dir, "documents"), "doc_id", "text", ids=False)
    return packing.pack(sizes, "doc_id", "n_tokens", CAPACITY)


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir)


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(_packed(spark, sf_dir), CAPACITY)


def p7_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: documents packed, and how often a rule of packing is broken."""
    return packing.check_report(_packed(spark, sf_dir), "doc_id", CAPACITY)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic.toxic_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_labels"))


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_labels"))


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic.rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_ranked": p1_ranked,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_rates": p3_rates,
    "p4_found": p4_found,
    "p4_share": p4_share,
    "p5_found": p5_found,
    "p5_forms": p5_forms,
    "p6_ids": p6_ids,
    "p7_packed": p7_packed,
    "p7_fill": p7_fill,
    "p7_checks": p7_checks,
    "p8_found": p8_found,
    "p8_scores": p8_scores,
    "p8_rates": p8_rates,
}

_BEST = """
WITH best AS (
  SELECT item_id, document_id, max(retrieval_score) AS retrieval_score
  FROM candidate_pairs
  WHERE retrieval_score IS NOT NULL AND NOT isnan(retrieval_score) AND abs(retrieval_score) < 'inf'::DOUBLE
    AND item_id IS NOT NULL AND document_id IS NOT NULL
  GROUP BY item_id, document_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY retrieval_score DESC, document_id DESC) AS rank FROM best
)
"""

ORACLES: dict[str, str] = {
    "p1_found": _BEST + "SELECT item_id, document_id FROM ranked WHERE rank <= 10",
    "p7_checks": "SELECT count(DISTINCT doc_id) AS documents, 0::BIGINT AS overfull, 0::BIGINT AS split_small, 0::BIGINT AS overlapping, 0::BIGINT AS gaps FROM documents",
    "p1_ranked": _BEST + "SELECT item_id, document_id, retrieval_score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 10",
}
