"""Explicit schemas: parts of a table may lack values of a column, so types are never inferred."""

ITEMS = (
    "item_id STRING, dataset STRING, prompt STRING, difficulty STRING, contamination_proxy BOOLEAN, tracer_label DOUBLE, "
    "release_version STRING, metadata_json STRING"
)
GENERATIONS = (
    "model STRING, quant STRING, item_id STRING, sample_id INT, is_greedy BOOLEAN, text STRING, token_ids ARRAY<BIGINT>, "
    "token_logprobs ARRAY<DOUBLE>, prompt_token_logprobs ARRAY<DOUBLE>, partial_pass_rate DOUBLE, passed BOOLEAN, "
    "decoding_temperature DOUBLE, generation_seconds DOUBLE, prompt_scoring_seconds DOUBLE, sandbox_scoring_seconds DOUBLE, "
    "model_revision STRING, tokenizer_revision STRING"
)
DETECTOR_SCORES = (
    "model STRING, quant STRING, item_id STRING, detector STRING, score DOUBLE, threshold_used DOUBLE, source_sample_ids ARRAY<INT>"
)
DOCUMENTS = "id STRING, text STRING, source STRING, version STRING, created STRING, added STRING"
EVIDENCE = (
    "item_id STRING, dataset STRING, corpus STRING, stage STRING, method_family STRING, normalized_verbatim BOOLEAN, ngram_size INT, "
    "ngram_coverage DOUBLE, ngram_threshold DOUBLE, string_match_label BOOLEAN, document_id STRING, matched_ngrams INT, query_ngrams INT, "
    "documents_scanned BIGINT, candidate_rank INT, exact_char_start INT, matched_token_start INT, matched_ngram_example STRING, match_context STRING"
)
SHARDS = (
    "path STRING, size_bytes BIGINT, priority INT, status STRING, attempts INT, documents_scanned BIGINT, evidence_rows BIGINT, "
    "output_path STRING, error STRING, started_at TIMESTAMP, heartbeat_at TIMESTAMP, finished_at TIMESTAMP, worker_id STRING, lease_token STRING"
)
_IDENTITY = "STRUCT<model: STRING, revision: STRING>"
_SCREEN = "STRUCT<raw_output: STRING, is_trivial: BOOLEAN>"
TRACER_PAIR = (
    "record_type STRING, run_id STRING, benchmark STRING, item_id STRING, corpus STRING, corpus_revision STRING, shard STRING, document_id STRING, "
    "benchmark_description STRING, training_description STRING, normalized_benchmark_description STRING, normalized_training_description STRING, "
    f"retrieval_method STRING, retrieval_score DOUBLE, embedding_model {_IDENTITY}, embedding_score DOUBLE, triage_route STRING, "
    f"raw_verification_output STRING, pre_screen_label STRING, benchmark_trivial_screen {_SCREEN}, training_trivial_screen {_SCREEN}, excluded BOOLEAN, "
    "final_fine_grained_label STRING, binary_contamination_label BOOLEAN, "
    f"normalizer_model {_IDENTITY}, verifier_model {_IDENTITY}, screener_model {_IDENTITY}, prompt_version STRING, "
    "decoding_config STRUCT<temperature: DOUBLE, top_p: DOUBLE, seed: BIGINT, max_output_tokens: INT, extra: MAP<STRING, STRING>>, run_timestamp STRING"
)
ITEM_COVERAGE = (
    "record_type STRING, run_id STRING, benchmark STRING, item_id STRING, corpus STRING, corpus_revision STRING, expected_shards INT, searched_shards INT, "
    "candidate_count INT, status STRING, run_timestamp STRING"
)
