"""The core queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copperleaf.config import ALPHA, POWER
from copperleaf.functions import arrays as A
from copperleaf.functions import stats
from copperleaf.functions import text as T
from copperleaf.operators import detectors, metrics, mixed, ngram, pairing, pilot, triage, validate
from copperleaf.session import table
from copperleaf.sources import readers, shards

BASELINE, TARGET = "bf16", "bnb_nf4"


def _r(c: str, digits: int = 6):
    return F.round(F.col(c), digits).alias(c)


def contamination_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In the form of normalisation that SQL can follow; ``contamination_scan_exact`` has the library's default."""
    rows = ngram.evidence(table(spark, sf_dir, "items"), table(spark, sf_dir, "documents"), exact=False)
    return rows.select(
        "dataset", "item_id", "document_id", "normalized_verbatim", _r("ngram_coverage"), "matched_ngrams", "query_ngrams", "exact_char_start", "matched_token_start",
        "matched_ngram_example", "match_context", "string_match_label", "candidate_rank",
    )


def contamination_scan_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.evidence(table(spark, sf_dir, "items"), table(spark, sf_dir, "documents"), negatives=True)


def short_query_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verbatim containment alone: with n-grams of 200 tokens every prompt is short."""
    queries = ngram.benchmark(table(spark, sf_dir, "items"), 200, exact=False)
    return ngram.short_matches(ngram.corpus(table(spark, sf_dir, "documents"), exact=False), queries, 200)


def evidence_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "evidence").where("document_id is not null").withColumn("source_shard", F.concat_ws("/", "corpus", "stage"))
    keep = ["dataset", "item_id", "document_id", "source_shard", "normalized_verbatim", "ngram_coverage", "matched_ngrams"]
    parts = parts.select(*keep).distinct()
    out = ngram.merge_evidence(parts, table(spark, sf_dir, "items"), 3)
    return out.select("dataset", "item_id", "document_id", "normalized_verbatim", _r("ngram_coverage"), "matched_ngrams", "candidate_rank")


def documents_scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("shard").agg(F.count(F.lit(1)).alias("documents_scanned"), F.sum((F.coalesce("text", F.lit("")) == "").cast("long")).alias("empty_documents"))


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = T.with_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return docs.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))


def document_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.sha2("text", 256).alias("text_sha256"), T.output_name(F.col("shard")).alias("output_name"), T.digest(F.col("doc_id"), F.col("document_version"), F.col("lang")).alias("digest"))


def contest_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with a contest date, split at a boundary."""
    items = table(spark, sf_dir, "items").where("dataset in ('lcb_pre', 'lcb_post')").dropDuplicates(["item_id"])
    rows = items.select(
        F.col("item_id").alias("question_id"), F.col("prompt").alias("question_content"), "difficulty", F.get_json_object("metadata_json", "$.platform").alias("platform"),
        F.get_json_object("metadata_json", "$.contest_date").alias("contest_date"), F.col("metadata_json").alias("metadata"),
    )
    return readers.problems_to_items(rows, "release_v6", "2024-01-01").groupBy("dataset", "contamination_proxy").agg(F.count(F.lit(1)).alias("n"))


def fenced_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    gens = table(spark, sf_dir, "generations").dropDuplicates(["model", "quant", "item_id", "sample_id"])
    return gens.select("model", "quant", "item_id", "sample_id", T.fenced(F.col("text")).alias("code"))


def rendered_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "items").select("item_id", "dataset", "prompt", "difficulty").distinct()
    asked = T.generation_prompt(F.col("dataset"), F.col("prompt"), F.get_json_object(F.lit("{}"), "$.starter"))
    text = T.render("Item {item} ({level}):\n{prompt}", item=F.col("item_id"), level=F.col("difficulty"), prompt=F.col("prompt"))
    return items.select("item_id", F.md5(asked).alias("asked_md5"), F.md5(text).alias("rendered_md5")).distinct()


def program_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    gens = table(spark, sf_dir, "generations").select("model", "quant", "item_id", "sample_id", "text").distinct()
    return gens.select("model", "quant", "item_id", "sample_id", F.md5(T.program_output(F.col("text"))).alias("output_md5"))


def logprob_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.logprob_scores(table(spark, sf_dir, "generations")).select("model", "quant", "item_id", "detector", _r("score", 10))


def perplexities(spark: SparkSession, sf_dir: str) -> DataFrame:
    gens = table(spark, sf_dir, "generations").dropDuplicates(["model", "quant", "item_id", "sample_id"])
    return gens.select("model", "quant", "item_id", "sample_id", A.perplexity(F.col("token_logprobs")).alias("perplexity")).select("model", "quant", "item_id", "sample_id", _r("perplexity"))


def peakedness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.peakedness(table(spark, sf_dir, "generations"))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.logprob_scores(table(spark, sf_dir, "generations"))


def score_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pairing.score_shift(_scores(spark, sf_dir), table(spark, sf_dir, "items"), BASELINE, TARGET)
    return rows.select("model", "detector", "dataset", "n_pairs", _r("mean_shift"), _r("cohens_d"))


def auc_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pilot.auc_shift(_scores(spark, sf_dir), table(spark, sf_dir, "items"), BASELINE, TARGET)
    return rows.select("model", "detector", "n_pairs", _r("auc_baseline"), _r("auc_target"), _r("auc_shift"), _r("r"))


def _q2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pilot.q2_summary(_contrasts(spark, sf_dir), BASELINE, TARGET)


def q2_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _q2(spark, sf_dir).select("contrast", _r("did_pp", 4), "n_pairs", _r("r"))


def gate_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate of the peakedness detector, by model."""
    rows = pilot.auc_shift(detectors.detector_scores(table(spark, sf_dir, "generations")), table(spark, sf_dir, "items"), BASELINE, TARGET)
    return pilot.gate_record(rows).select("model", _r("measured_auc"), "threshold", "passed", _r("assumed_fall"), _r("detection_limit"))


def power_recompute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that would detect what was seen, by analysis."""
    scores, items = detectors.detector_scores(table(spark, sf_dir, "generations")), table(spark, sf_dir, "items")
    shift = pairing.score_shift(scores, items, BASELINE, TARGET)
    return pilot.power_recompute(shift, pilot.auc_shift(scores, items, BASELINE, TARGET), _q2(spark, sf_dir)).withColumn("observed", F.round("observed", 6))


def base_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.base_rates(table(spark, sf_dir, "generations"), table(spark, sf_dir, "items")).select("model", "quant", "dataset", "n", _r("pass_rate"))


def _contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pilot.contrast_rows(table(spark, sf_dir, "generations"), table(spark, sf_dir, "items"), BASELINE, TARGET)


def rates_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.rates_by(_contrasts(spark, sf_dir), "correct", ["contrast", "quant", "contaminated"]).select("contrast", "quant", "contaminated", _r("rate"))


def did(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.did_points(_contrasts(spark, sf_dir), "correct", BASELINE, TARGET, ["contrast"]).where("did_pp is not null").select("contrast", _r("did_pp", 4))


def did_by_difficulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pairing.did_by_difficulty(_contrasts(spark, sf_dir), "correct", BASELINE, TARGET, groups=["contrast"])
    return rows.where("did_pp is not null").select("contrast", "difficulty", _r("did_pp", 4))


def mixed_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed.interaction_by(_contrasts(spark, sf_dir), "contrast")


def timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pairing.timing(table(spark, sf_dir, "generations").dropDuplicates(["model", "quant", "item_id", "sample_id"]))
    return rows.select("stage", "n", _r("total_seconds", 3), _r("mean_seconds", 4), _r("items_per_second", 4))


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "generations").select("model").distinct()


def pair_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "tracer_pairs")
    return metrics.gate(metrics.empirical_auc(pairs, "embedding_score", "binary_contamination_label", ["benchmark"])).select("benchmark", "n_positive", "n_negative", _r("auc"), "passes_gate")


def pair_youden(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.youden(table(spark, sf_dir, "tracer_pairs"), "embedding_score", "binary_contamination_label", ["retrieval_method"])
    return rows.select("retrieval_method", "threshold", _r("j"))


def pair_youden_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.youden_at(table(spark, sf_dir, "tracer_pairs"), "embedding_score", "binary_contamination_label", 0.7, ["retrieval_method"]).select("retrieval_method", _r("j"))


def pair_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.pearson(table(spark, sf_dir, "tracer_pairs"), "retrieval_score", "embedding_score", ["retrieval_method"]).select("retrieval_method", "n", _r("r"))


def proxy_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "tracer_pairs").groupBy("item_id").agg(F.bool_or("binary_contamination_label").alias("truth"))
    items = table(spark, sf_dir, "items").select("item_id", "dataset", "contamination_proxy").dropDuplicates(["item_id"])
    return metrics.error_rate(items.join(labels, "item_id"), "contamination_proxy", "truth", ["dataset"]).select("dataset", "n", _r("error_rate"))


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.classify(table(spark, sf_dir, "evidence"), "ngram_coverage", 0.01).groupBy("dataset", "contaminated").agg(F.count(F.lit(1)).alias("n"))


def triage_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "tracer_pairs").where("embedding_score between 0 and 1")
    return pairs.select("benchmark", triage.route(F.col("embedding_score")).alias("route")).groupBy("benchmark", "route").agg(F.count(F.lit(1)).alias("n"))


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "tracer_pairs")
    return pairs.select(
        "pair_id", T.fine_label(F.col("raw_verification_output")).alias("label"), T.trivial_decision(F.col("benchmark_trivial_screen.raw_output")).alias("benchmark_trivial"),
        T.trivial_decision(F.col("training_trivial_screen.raw_output")).alias("training_trivial"),
    )


def finalized_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "tracer_pairs").select(
        "pair_id", "pre_screen_label", F.col("benchmark_trivial_screen.is_trivial").alias("benchmark_is_trivial"), F.col("training_trivial_screen.is_trivial").alias("training_is_trivial")
    )
    return triage.finalize(pairs).select("pair_id", "excluded", "final_fine_grained_label", "binary_contamination_label")


def pair_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.pair_violations(table(spark, sf_dir, "tracer_pairs"))


def repeated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    gens = pairing.duplicates(table(spark, sf_dir, "generations"), ["model", "quant", "item_id", "sample_id"])
    items = pairing.duplicates(table(spark, sf_dir, "items"), ["item_id"])
    parts = [("generations", gens), ("items", items)]
    out = [d.agg(F.lit(n).alias("table"), F.count(F.lit(1)).alias("keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")) for n, d in parts]
    return out[0].unionByName(out[1])


def unknown_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = table(spark, sf_dir, "items").where("dataset <> 'humaneval'")
    return validate.unknown_items(table(spark, sf_dir, "generations"), half)


def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, gens = table(spark, sf_dir, "items"), table(spark, sf_dir, "generations")
    return validate.completeness(items, gens, _scores(spark, sf_dir), models=4, quants=2, n_items=200, samples=50)


def pooled_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "generations").select("model", "quant", "item_id").distinct()
    labelled = cells.join(table(spark, sf_dir, "items").select("item_id", "dataset").dropDuplicates(["item_id"]), "item_id")
    return validate.pooled_cells(labelled, ["model", "quant"])


def split_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    gens = table(spark, sf_dir, "generations")
    return validate.overlap(gens.where(F.col("quant") == BASELINE), gens.where(F.col("quant") == TARGET))


def coverage_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = sum(r.shards for r in shards.status_counts(table(spark, sf_dir, "shards")).collect())  # a row for each status
    found = table(spark, sf_dir, "evidence").groupBy("item_id").agg(F.count_distinct("document_id").alias("candidate_count"), F.count_distinct("corpus").alias("corpora"))
    items = table(spark, sf_dir, "items").select("item_id").distinct().join(found, "item_id", "left")
    searched = F.when(F.coalesce("corpora", F.lit(0)) > 0, F.lit(total)).otherwise(0)
    rows = items.withColumns({"expected_shards": F.lit(total), "searched_shards": searched})
    return validate.coverage_status(rows).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def shard_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.status_counts(table(spark, sf_dir, "shards"))


def shard_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.progress(table(spark, sf_dir, "shards")).select(_r("shards_done"), _r("bytes_done"))


def shard_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next shard to scan, once stale leases are recovered and failed shards retried."""
    now = F.lit("2025-01-10 00:00:00").cast("timestamp")
    ready = shards.retry_failed(shards.recover_stale(table(spark, sf_dir, "shards"), now))
    return shards.queue(ready).limit(1).select("path", "priority", "attempts")


def shard_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("2025-01-10 00:00:00").cast("timestamp")
    ready = shards.claim(shards.recover_stale(table(spark, sf_dir, "shards"), now), 3, "worker-x", "lease-x", now)
    return ready.select("path", "status", "attempts", "worker_id", "lease_token")


def shards_unfinished(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.unfinished(table(spark, sf_dir, "shards"))


def new_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = table(spark, sf_dir, "documents").where("shard is not null").groupBy("shard").agg(F.sum(F.coalesce("n_chars", F.lit(0))).alias("size_bytes"))
    listed = listed.select(F.col("shard").alias("path"), "size_bytes", readers.shard_priority(F.col("shard")).alias("priority"))
    known = table(spark, sf_dir, "shards").where("priority = 0")
    return shards.add_new(known, listed).select("path", "size_bytes", "priority", "status", "attempts")


def shortest_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.shortest_items(table(spark, sf_dir, "items").dropDuplicates(["item_id"]), 5).select("item_id", "dataset")


def similar_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 20 against all vectors."""
    v = table(spark, sf_dir, "embeddings")
    rows = triage.block_cosine(v.where("vec_id % 20 = 0"), v, least=0.3)
    return rows.select("query_id", "vec_id", _r("score", 4))


def power_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection limits of a paired AUC difference."""
    n = spark.createDataFrame([(a, m, r) for a in (0.6, 0.7, 0.85) for m in (164, 300, 542, 1000) for r in (0.0, 0.8, 0.9)], "auc double, n int, r double")
    out = stats.over_table(n, lambda a, m, r: stats.auc_se(a, int(m)), ["auc", "n", "r"], "se")
    out = stats.over_table(out, lambda a, m, r: stats.delta_auc_limit(a, int(m), r, ALPHA, POWER), ["auc", "n", "r"], "detectable")
    return out.select("auc", "n", "r", _r("se"), _r("detectable"))


def design_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and shifts that have no closed form."""
    rows = spark.createDataFrame([(d, e) for d in (5.0, 10.0, 20.0) for e in (0.0, 0.1, 0.2, 0.3)], "delta_pp double, error double")
    out = stats.over_table(rows, stats.items_for_did, ["delta_pp"], "items_did")
    out = stats.over_table(out, lambda e: stats.items_under_label_noise(0.7, 0.05, 0.8, e), ["error"], "items_noise")
    return stats.over_table(out, lambda e: stats.delta_auc_of_shift(0.5 + e, 0.1), ["error"], "auc_fall")
