"""The same queries as SQL over the whole tables, by name."""

from __future__ import annotations

from copperleaf.functions.text import BLANKS, TOKENS
from copperleaf.operators.validate import PAIR_TEXTS



def _norm(column: str) -> str:
    return f"trim(regexp_replace(replace(lower(coalesce({column}, '')), 'ß', 'ss'), '{BLANKS}', ' ', 'g'))"


def _tokens(text: str) -> str:
    return f"regexp_extract_all({text}, '{TOKENS}', 1)"


def _verdict(answer: str) -> str:
    return f"CASE regexp_extract({answer}, '\\ADecision: (Yes|No)\\nReasoning: [^\\n]+\\z', 1) WHEN 'Yes' THEN true WHEN 'No' THEN false END"


_N = 13
_ITEMS_ONCE = "(SELECT dataset, item_id, any_value(prompt) AS prompt FROM items GROUP BY dataset, item_id)"
_GENS_ONCE = "(SELECT DISTINCT ON (model, quant, item_id, sample_id) * FROM generations)"
_LABELS = "(SELECT item_id, any_value(dataset) AS dataset, any_value(difficulty) AS difficulty, any_value(contamination_proxy) AS contamination_proxy FROM items GROUP BY item_id)"

_SCAN = f"""
WITH q0 AS (SELECT dataset, item_id, {_norm("prompt")} AS query FROM {_ITEMS_ONCE}),
q1 AS (SELECT *, {_tokens("query")} AS t FROM q0),
qg AS (SELECT DISTINCT dataset, item_id, array_to_string(t[i:i + {_N} - 1], ' ') AS g
       FROM (SELECT dataset, item_id, t, unnest(range(1, greatest(len(t) - {_N} + 2, 1))) AS i FROM q1)),
qn AS (SELECT dataset, item_id, count(*) AS n FROM qg GROUP BY ALL),
d0 AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, {_norm("text")} AS normalized FROM documents),
d1 AS (SELECT *, {_tokens("normalized")} AS t FROM d0),
dg AS (SELECT document_id, i - 1 AS p, array_to_string(t[i:i + {_N} - 1], ' ') AS g
       FROM (SELECT document_id, t, unnest(range(1, greatest(len(t) - {_N} + 2, 1))) AS i FROM d1)),
m AS (SELECT dataset, item_id, document_id, count(DISTINCT g) AS matched, min(p) AS p FROM dg JOIN qg USING (g) GROUP BY ALL),
s AS (SELECT dataset, item_id, document_id, 0 AS matched, NULL AS p FROM q1 LEFT JOIN qn USING (dataset, item_id), d1
      WHERE qn.n IS NULL AND query <> '' AND contains(normalized, query)),
e AS (SELECT dataset, item_id, document_id, contains(normalized, query) AS verbatim, CASE WHEN coalesce(qn.n, 0) > 0 THEN matched / qn.n ELSE 0.0 END AS coverage,
        matched, coalesce(qn.n, 0) AS n, CASE WHEN contains(normalized, query) THEN strpos(normalized, query) - 1 END AS char_start, p,
        CASE WHEN p IS NOT NULL THEN array_to_string(d1.t[p + 1:p + {_N}], ' ') END AS example,
        CASE WHEN p IS NOT NULL THEN array_to_string(d1.t[greatest(p - 30, 0) + 1:p + {_N} + 30], ' ') END AS context
      FROM (SELECT * FROM m UNION ALL SELECT * FROM s) JOIN q1 USING (dataset, item_id) LEFT JOIN qn USING (dataset, item_id) JOIN d1 USING (document_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY dataset, item_id ORDER BY verbatim DESC, coverage DESC, matched DESC, document_id DESC) AS k FROM e)
SELECT dataset, item_id, document_id, verbatim AS normalized_verbatim, round(coverage, 6) AS ngram_coverage, CAST(matched AS INTEGER) AS matched_ngrams,
  CAST(n AS INTEGER) AS query_ngrams, CAST(char_start AS INTEGER) AS exact_char_start, CAST(p AS INTEGER) AS matched_token_start, example AS matched_ngram_example,
  context AS match_context, verbatim OR coverage >= 0.8 AS string_match_label, CAST(k AS INTEGER) AS candidate_rank
FROM r WHERE k <= 5
"""

_LOGPROBS = f"""
g AS (SELECT * FROM {_GENS_ONCE} WHERE is_greedy),
v AS (SELECT model, quant, item_id, 'perplexity' AS detector, 0 AS low, prompt_token_logprobs AS a FROM g
      UNION ALL SELECT model, quant, item_id, 'mink_prob', 1, prompt_token_logprobs FROM g
      UNION ALL SELECT model, quant, item_id, 'completion_perplexity', 0, token_logprobs FROM g
      UNION ALL SELECT model, quant, item_id, 'completion_mink_prob', 1, token_logprobs FROM g),
w AS (SELECT model, quant, item_id, detector, CASE WHEN low = 1 THEN list_sort(a)[1:CAST(greatest(round_even(len(a) * 20.0 / 100, 0), 1) AS INTEGER)] ELSE a END AS a
      FROM v WHERE len(a) > 0),
scores AS (SELECT model, quant, item_id, detector, list_sum(a) / len(a) AS score FROM w)
"""
_PAIRED = f"""
p AS (SELECT model, detector, item_id, max(score) FILTER (quant = 'bf16') AS b, max(score) FILTER (quant = 'bnb_nf4') AS t
      FROM scores WHERE quant IN ('bf16', 'bnb_nf4') GROUP BY ALL HAVING count(*) <= 2),
j AS (SELECT p.*, dataset, contamination_proxy FROM p JOIN {_LABELS} USING (item_id) WHERE b IS NOT NULL AND t IS NOT NULL)
"""
_CONTRASTS = f"""
g AS (SELECT * FROM {_GENS_ONCE} WHERE is_greedy AND passed IS NOT NULL AND quant IN ('bf16', 'bnb_nf4')),
o AS (SELECT model, quant, item_id, CAST(passed AS INTEGER) AS correct, dataset, difficulty FROM g JOIN {_LABELS} USING (item_id)),
w AS (SELECT model, item_id FROM o GROUP BY ALL HAVING count(*) = 2 AND count(DISTINCT quant) = 2),
c AS (SELECT * FROM (VALUES ('lcb_pre_vs_lcb_post', 'lcb_pre'), ('humaneval_vs_lcb_post', 'humaneval'), ('mbppplus_vs_lcb_post', 'mbppplus')) x(contrast, suspect)),
rows_ AS (SELECT contrast, model, quant, item_id, difficulty, dataset = suspect AS contaminated, correct
      FROM o SEMI JOIN w USING (model, item_id) JOIN c ON dataset = suspect OR dataset = 'lcb_post')
"""
_DID = """100 * ((avg(correct) FILTER (quant = 'bnb_nf4' AND contaminated) - avg(correct) FILTER (quant = 'bf16' AND contaminated))
  - (avg(correct) FILTER (quant = 'bnb_nf4' AND NOT contaminated) - avg(correct) FILTER (quant = 'bf16' AND NOT contaminated)))"""
_RECOVERED = """(SELECT path, size_bytes, priority, attempts,
  CASE WHEN status = 'running' AND epoch(TIMESTAMP '2025-01-10 00:00:00') - epoch(date_trunc('second', heartbeat_at)) > 600 THEN 'pending' ELSE status END AS status,
  CASE WHEN status = 'running' AND epoch(TIMESTAMP '2025-01-10 00:00:00') - epoch(date_trunc('second', heartbeat_at)) > 600 THEN NULL ELSE worker_id END AS worker_id,
  CASE WHEN status = 'running' AND epoch(TIMESTAMP '2025-01-10 00:00:00') - epoch(date_trunc('second', heartbeat_at)) > 600 THEN NULL ELSE lease_token END AS lease_token
  FROM shards)"""
_YOUDEN_HISTOGRAM = """
h AS (SELECT retrieval_method, embedding_score AS s, count(*) FILTER (binary_contamination_label) AS p, count(*) FILTER (NOT binary_contamination_label) AS n
      FROM tracer_pairs WHERE embedding_score IS NOT NULL AND binary_contamination_label IS NOT NULL GROUP BY ALL),
c AS (SELECT *, coalesce(sum(p) OVER a, 0) AS pa, coalesce(sum(n) OVER a, 0) AS na, sum(p) OVER (PARTITION BY retrieval_method) AS pt, sum(n) OVER (PARTITION BY retrieval_method) AS nt
      FROM h WINDOW a AS (PARTITION BY retrieval_method ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
j AS (SELECT retrieval_method, s, coalesce(pa / nullif(pt, 0), 0) - coalesce(na / nullif(nt, 0), 0) AS j FROM c)
"""

ORACLES: dict[str, str] = {
    "contamination_scan": _SCAN,
    "short_query_scan": f"""
WITH q AS (SELECT dataset, item_id, {_norm("prompt")} AS query FROM {_ITEMS_ONCE}),
f AS (SELECT * FROM q WHERE query <> '' AND len({_tokens("query")}) < 200),
d AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, {_norm("text")} AS normalized FROM documents)
SELECT dataset, item_id, document_id FROM f JOIN d ON contains(normalized, query)""",
    "evidence_merge": """
WITH p AS (SELECT DISTINCT dataset, item_id, document_id, corpus || '/' || stage AS source_shard, normalized_verbatim, ngram_coverage, matched_ngrams
           FROM evidence WHERE document_id IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY dataset, item_id ORDER BY normalized_verbatim DESC NULLS LAST, ngram_coverage DESC NULLS LAST,
        matched_ngrams DESC NULLS LAST, source_shard DESC NULLS LAST, document_id DESC NULLS LAST) AS k FROM p)
SELECT dataset, item_id, document_id, coalesce(normalized_verbatim, false) AS normalized_verbatim, round(coalesce(ngram_coverage, 0.0), 6) AS ngram_coverage,
  coalesce(matched_ngrams, 0) AS matched_ngrams, CAST(coalesce(k, 1) AS INTEGER) AS candidate_rank
FROM (SELECT DISTINCT dataset, item_id FROM items) LEFT JOIN (SELECT * FROM r WHERE k <= 3) USING (dataset, item_id)""",
    "documents_scanned": """SELECT shard, count(*) AS documents_scanned, CAST(sum(CASE WHEN coalesce(text, '') = '' THEN 1 ELSE 0 END) AS BIGINT) AS empty_documents
FROM documents GROUP BY shard""",
    "token_counts": f"""SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5
FROM (SELECT doc_id, {_tokens(_norm("text"))} AS t FROM documents)""",
    "document_digests": """SELECT doc_id, sha256(text) AS text_sha256, sha256(shard)[1:12] || '.jsonl' AS output_name,
  sha256(CAST(doc_id AS VARCHAR) || chr(31) || coalesce(document_version, '') || chr(31) || coalesce(lang, '')) AS digest FROM documents""",
    "contest_split": """
WITH i AS (SELECT item_id, any_value(metadata_json) AS m FROM items WHERE dataset IN ('lcb_pre', 'lcb_post') GROUP BY item_id),
s AS (SELECT CASE WHEN CAST(m->>'$.contest_date' AS TIMESTAMP) < TIMESTAMP '2024-01-01' THEN 'lcb_pre' WHEN m->>'$.contest_date' IS NOT NULL THEN 'lcb_post' END AS dataset FROM i)
SELECT dataset, dataset <> 'lcb_post' AS contamination_proxy, count(*) AS n FROM s GROUP BY ALL""",
    "fenced_code": f"""
SELECT model, quant, item_id, sample_id, coalesce(list_extract(regexp_extract_all(text, '(?s)```(?:[a-zA-Z0-9_+-]*)\\n?(.*?)```', 1), -1), text) AS code
FROM {_GENS_ONCE}""",
    "rendered_prompts": """
SELECT DISTINCT item_id,
  md5(CASE WHEN dataset IN ('lcb_pre', 'lcb_post') THEN prompt || chr(10) || chr(10)
    || 'Write a complete Python program that reads from standard input and writes to standard output. Return only the code.' ELSE prompt END) AS asked_md5,
  md5('Item ' || item_id || ' (' || coalesce(difficulty, '') || '):' || chr(10) || coalesce(prompt, '')) AS rendered_md5 FROM items""",
    "program_outputs": """
SELECT model, quant, item_id, sample_id,
  md5(regexp_replace(array_to_string(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '[\\s\\x0b]+$', '')), chr(10)), '\\n+$', '')) AS output_md5
FROM (SELECT DISTINCT model, quant, item_id, sample_id, text FROM generations)""",
    "logprob_detectors": f"WITH {_LOGPROBS} SELECT model, quant, item_id, detector, round(score, 10) AS score FROM scores",
    "perplexities": f"SELECT model, quant, item_id, sample_id, round(exp(-list_sum(token_logprobs) / nullif(len(token_logprobs), 0)), 6) AS perplexity FROM {_GENS_ONCE}",
    "score_shift": f"""WITH {_LOGPROBS}, {_PAIRED}
SELECT model, detector, dataset, count(*) AS n_pairs, round(avg(t - b), 6) AS mean_shift,
  round(CASE WHEN stddev_samp(t - b) = 0 THEN 0.0 ELSE avg(t - b) / stddev_samp(t - b) END, 6) AS cohens_d
FROM j GROUP BY ALL HAVING count(*) >= 2""",
    # only the items before and after the boundary are analysed, other datasets aren't pooled with them
    "auc_shift": f"""WITH {_LOGPROBS}, {_PAIRED.replace("WHERE b IS NOT NULL", "WHERE dataset IN ('lcb_pre', 'lcb_post') AND b IS NOT NULL")},
a AS (SELECT x.model, x.detector, avg(CASE WHEN x.b > y.b THEN 1.0 WHEN x.b = y.b THEN 0.5 ELSE 0 END) AS ab, avg(CASE WHEN x.t > y.t THEN 1.0 WHEN x.t = y.t THEN 0.5 ELSE 0 END) AS at_
      FROM j x JOIN j y ON x.model = y.model AND x.detector = y.detector AND x.contamination_proxy AND NOT y.contamination_proxy GROUP BY ALL),
r AS (SELECT model, detector, count(*) AS n_pairs, CASE WHEN count(*) >= 2 THEN CASE WHEN min(b) = max(b) OR min(t) = max(t) THEN 0.0 ELSE corr(b, t) END END AS r FROM j GROUP BY ALL)
SELECT model, detector, n_pairs, round(ab, 6) AS auc_baseline, round(at_, 6) AS auc_target, round(at_ - ab, 6) AS auc_shift, round(r, 6) AS r FROM r LEFT JOIN a USING (model, detector)""",
    "base_rates": f"""SELECT model, quant, dataset, count(*) AS n, round(avg(CAST(passed AS INTEGER)), 6) AS pass_rate
FROM {_GENS_ONCE} JOIN {_LABELS} USING (item_id) WHERE is_greedy AND passed IS NOT NULL GROUP BY ALL""",
    "rates_by_label": f"WITH {_CONTRASTS} SELECT contrast, quant, contaminated, round(avg(correct), 6) AS rate FROM rows_ GROUP BY ALL",
    "did": f"WITH {_CONTRASTS} SELECT * FROM (SELECT contrast, round({_DID}, 4) AS did_pp FROM rows_ GROUP BY contrast) WHERE did_pp IS NOT NULL",
    # pairs are (model, item) with an outcome at both precisions
    "q2_summary": f"""WITH {_CONTRASTS},
p AS (SELECT contrast, model, item_id, max(correct) FILTER (quant = 'bf16') AS b, max(correct) FILTER (quant = 'bnb_nf4') AS t FROM rows_ GROUP BY ALL),
r AS (SELECT contrast, count(*) AS n_pairs, CASE WHEN min(b) = max(b) OR min(t) = max(t) THEN 0.0 ELSE corr(b, t) END AS r FROM p GROUP BY contrast),
d AS (SELECT contrast, {_DID} AS did_pp FROM rows_ GROUP BY contrast)
SELECT contrast, round(did_pp, 4) AS did_pp, n_pairs, round(r, 6) AS r FROM d JOIN r USING (contrast) WHERE did_pp IS NOT NULL""",
    "did_by_difficulty": f"""WITH {_CONTRASTS}
SELECT * FROM (SELECT contrast, difficulty, round({_DID}, 4) AS did_pp FROM rows_ WHERE difficulty IS NOT NULL GROUP BY ALL HAVING count(DISTINCT contaminated) = 2) WHERE did_pp IS NOT NULL""",
    "timing": f"""WITH g AS (SELECT * FROM {_GENS_ONCE} WHERE is_greedy),
s AS (SELECT 'generation_seconds' AS stage, generation_seconds AS x FROM g UNION ALL SELECT 'prompt_scoring_seconds', prompt_scoring_seconds FROM g
      UNION ALL SELECT 'sandbox_scoring_seconds', sandbox_scoring_seconds FROM g)
SELECT stage, count(*) AS n, round(sum(x), 3) AS total_seconds, round(avg(x), 4) AS mean_seconds, round(count(*) / sum(x), 4) AS items_per_second
FROM s WHERE x IS NOT NULL GROUP BY stage""",
    "models": "SELECT DISTINCT model FROM generations",
    "pair_auc": """
WITH k AS (SELECT benchmark, embedding_score AS s, binary_contamination_label AS y FROM tracer_pairs WHERE embedding_score IS NOT NULL AND binary_contamination_label IS NOT NULL),
h AS (SELECT benchmark, s, count(*) FILTER (y) AS p, count(*) FILTER (NOT y) AS n FROM k GROUP BY ALL),
c AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY benchmark ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM h),
a AS (SELECT benchmark, CAST(sum(p) AS BIGINT) AS n_positive, CAST(sum(n) AS BIGINT) AS n_negative, sum(p * (below + n / 2)) / nullif(CAST(sum(p) AS DOUBLE) * sum(n), 0) AS auc FROM c GROUP BY benchmark)
SELECT benchmark, n_positive, n_negative, round(auc, 6) AS auc, coalesce(auc >= 0.7936, false) AS passes_gate FROM a""",
    "pair_youden": f"WITH {_YOUDEN_HISTOGRAM} SELECT retrieval_method, arg_min(s, s) AS threshold, round(any_value(j), 6) AS j FROM j a WHERE j = (SELECT max(j) FROM j b WHERE b.retrieval_method IS NOT DISTINCT FROM a.retrieval_method) GROUP BY retrieval_method",
    "pair_youden_at": """SELECT retrieval_method, round(coalesce(avg(CASE WHEN embedding_score > 0.7 THEN 1.0 ELSE 0 END) FILTER (binary_contamination_label), 0)
  - coalesce(avg(CASE WHEN embedding_score > 0.7 THEN 1.0 ELSE 0 END) FILTER (NOT binary_contamination_label), 0), 6) AS j
FROM tracer_pairs WHERE embedding_score IS NOT NULL AND binary_contamination_label IS NOT NULL GROUP BY retrieval_method""",
    "pair_correlation": """SELECT retrieval_method, count(*) AS n,
  round(CASE WHEN count(*) >= 2 THEN CASE WHEN min(retrieval_score) = max(retrieval_score) OR min(embedding_score) = max(embedding_score) THEN 0.0
    ELSE coalesce(corr(retrieval_score, embedding_score), 0.0) END END, 6) AS r
FROM tracer_pairs WHERE retrieval_score IS NOT NULL AND embedding_score IS NOT NULL GROUP BY retrieval_method""",
    "proxy_error_rate": f"""WITH t AS (SELECT item_id, bool_or(binary_contamination_label) AS truth FROM tracer_pairs GROUP BY item_id)
SELECT dataset, count(*) AS n, round(avg(CAST(contamination_proxy <> truth AS INTEGER)), 6) AS error_rate
FROM {_LABELS} JOIN t USING (item_id) WHERE contamination_proxy IS NOT NULL AND truth IS NOT NULL GROUP BY dataset""",
    "classified": "SELECT dataset, ngram_coverage > 0.01 AS contaminated, count(*) AS n FROM evidence GROUP BY ALL",
    "triage_routes": """SELECT benchmark, CASE WHEN embedding_score >= 0.9 THEN 'direct_fi' WHEN embedding_score <= 0.6 THEN 'direct_u' ELSE 'verify' END AS route, count(*) AS n
FROM tracer_pairs WHERE embedding_score BETWEEN 0 AND 1 GROUP BY ALL""",
    "verdicts": """
SELECT pair_id, CASE raw_verification_output WHEN 'Answer: A' THEN 'FI' WHEN 'Answer: B' THEN 'NI' WHEN 'Answer: C' THEN 'SL' WHEN 'Answer: D' THEN 'U' END AS label,
  CASE regexp_extract(benchmark_trivial_screen.raw_output, '\\ADecision: (Yes|No)\\nReasoning: [^\\n]+\\z', 1) WHEN 'Yes' THEN true WHEN 'No' THEN false END AS benchmark_trivial,
  CASE regexp_extract(training_trivial_screen.raw_output, '\\ADecision: (Yes|No)\\nReasoning: [^\\n]+\\z', 1) WHEN 'Yes' THEN true WHEN 'No' THEN false END AS training_trivial
FROM tracer_pairs""",
    "finalized_pairs": """
WITH f AS (SELECT pair_id, pre_screen_label AS l, coalesce(benchmark_trivial_screen.is_trivial, false) OR coalesce(training_trivial_screen.is_trivial, false) AS x
           FROM tracer_pairs)
SELECT pair_id, x AS excluded, l AS final_fine_grained_label, CASE WHEN NOT x THEN l <> 'U' END AS binary_contamination_label FROM f""",
    "pair_violations": f"""
WITH t AS (SELECT *, coalesce(benchmark_trivial_screen.is_trivial, false) OR coalesce(training_trivial_screen.is_trivial, false) AS trivial,
  benchmark_trivial_screen AS b, training_trivial_screen AS s, decoding_config AS d FROM tracer_pairs WHERE record_type = 'pair'),
a AS (SELECT *, {_verdict("b.raw_output")} AS bv, {_verdict("s.raw_output")} AS sv,
  CASE raw_verification_output WHEN 'Answer: A' THEN 'FI' WHEN 'Answer: B' THEN 'NI' WHEN 'Answer: C' THEN 'SL' WHEN 'Answer: D' THEN 'U' END AS v FROM t)
SELECT pair_id, 'text' AS rule FROM a WHERE {" OR ".join(f"coalesce(trim({c}) = '', true)" for c in PAIR_TEXTS)}
UNION ALL SELECT pair_id, 'score' FROM a WHERE coalesce(NOT isfinite(retrieval_score), true) OR coalesce(NOT isfinite(embedding_score), true) OR embedding_score < 0 OR embedding_score > 1
UNION ALL SELECT pair_id, 'label' FROM a WHERE final_fine_grained_label IS DISTINCT FROM pre_screen_label OR pre_screen_label NOT IN ('FI', 'NI', 'SL', 'U')
UNION ALL SELECT pair_id, 'excluded' FROM a WHERE excluded IS DISTINCT FROM trivial
UNION ALL SELECT pair_id, 'binary' FROM a WHERE binary_contamination_label IS DISTINCT FROM (CASE WHEN NOT excluded THEN pre_screen_label <> 'U' END)
UNION ALL SELECT pair_id, 'route' FROM a WHERE CASE triage_route WHEN 'direct_fi' THEN pre_screen_label <> 'FI' OR raw_verification_output IS NOT NULL
  WHEN 'direct_u' THEN pre_screen_label <> 'U' OR raw_verification_output IS NOT NULL WHEN 'verify' THEN v IS DISTINCT FROM pre_screen_label ELSE true END
UNION ALL SELECT pair_id, 'screen' FROM a WHERE (b.raw_output IS NULL) <> (b.is_trivial IS NULL) OR (s.raw_output IS NULL) <> (s.is_trivial IS NULL)
UNION ALL SELECT pair_id, 'screen_answer' FROM a WHERE (b.raw_output IS NOT NULL AND bv IS DISTINCT FROM b.is_trivial) OR (s.raw_output IS NOT NULL AND sv IS DISTINCT FROM s.is_trivial)
UNION ALL SELECT pair_id, 'decoding' FROM a WHERE coalesce(NOT isfinite(d.temperature), true) OR d.temperature < 0 OR coalesce(NOT isfinite(d.top_p), true)
  OR d.top_p <= 0 OR d.top_p > 1 OR d.max_output_tokens <= 0""",
    "repeated_rows": """
SELECT 'generations' AS "table", count(*) AS keys, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows FROM (SELECT count(*) AS n FROM generations GROUP BY model, quant, item_id, sample_id HAVING count(*) > 1)
UNION ALL SELECT 'items', count(*), CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM items GROUP BY item_id HAVING count(*) > 1)""",
    "unknown_items": "SELECT DISTINCT item_id FROM generations WHERE item_id NOT IN (SELECT item_id FROM items WHERE dataset <> 'humaneval')",
    "completeness": f"""WITH {_LOGPROBS.strip()},
c AS (SELECT 'items' AS "table", 200 AS expected, count(*) AS found FROM items UNION ALL SELECT 'generations', 4 * 2 * 200 * 51, count(*) FROM generations
      UNION ALL SELECT 'detector_scores', 4 * 2 * 200 * 5, count(*) FROM scores)
SELECT "table", CAST(expected AS BIGINT) AS expected, found FROM c WHERE expected <> found""",
    "pooled_cells": f"""SELECT model, quant FROM (SELECT DISTINCT model, quant, item_id FROM generations) JOIN {_LABELS} USING (item_id)
GROUP BY ALL HAVING bool_or(dataset = 'humaneval') AND bool_or(dataset = 'mbppplus')""",
    "split_overlap": "SELECT item_id FROM generations WHERE quant = 'bf16' INTERSECT SELECT item_id FROM generations WHERE quant = 'bnb_nf4'",
    "coverage_states": """
WITH f AS (SELECT item_id, count(DISTINCT document_id) AS n, count(DISTINCT corpus) AS c FROM evidence GROUP BY item_id)
SELECT CASE WHEN coalesce(c, 0) = 0 THEN 'not_searched' WHEN coalesce(n, 0) > 0 THEN 'search_complete_with_candidates' ELSE 'search_complete_no_candidates' END AS status, count(*) AS n
FROM (SELECT DISTINCT item_id FROM items) LEFT JOIN f USING (item_id) GROUP BY ALL""",
    "shard_status": """SELECT status, count(*) AS shards, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS size_bytes, CAST(coalesce(sum(documents_scanned), 0) AS BIGINT) AS documents_scanned,
  CAST(coalesce(sum(evidence_rows), 0) AS BIGINT) AS evidence_rows FROM shards GROUP BY status""",
    "shard_progress": """SELECT round(coalesce(sum(CASE WHEN status = 'complete' THEN 1 ELSE 0 END) / nullif(count(*), 0), 0), 6) AS shards_done,
  round(coalesce(sum(CASE WHEN status = 'complete' THEN size_bytes END) / nullif(sum(size_bytes), 0), 0), 6) AS bytes_done FROM shards""",
    "shard_queue": f"""SELECT path, priority, attempts FROM (SELECT path, priority, attempts, CASE WHEN status = 'failed' THEN 'pending' ELSE status END AS status FROM {_RECOVERED})
WHERE status = 'pending' ORDER BY priority, attempts, path LIMIT 1""",
    "shard_states": f"""
WITH r AS (SELECT * FROM {_RECOVERED}), f AS (SELECT path AS fp FROM r WHERE status = 'pending' ORDER BY priority, attempts, path LIMIT 3)
SELECT path, CASE WHEN fp IS NOT NULL THEN 'running' ELSE status END AS status, CAST(CASE WHEN fp IS NOT NULL THEN coalesce(attempts, 0) + 1 ELSE attempts END AS INTEGER) AS attempts,
  CASE WHEN fp IS NOT NULL THEN 'worker-x' ELSE worker_id END AS worker_id, CASE WHEN fp IS NOT NULL THEN 'lease-x' ELSE lease_token END AS lease_token
FROM r LEFT JOIN f ON path = fp""",
    "shards_unfinished": "SELECT path FROM shards WHERE coalesce(status <> 'complete', true)",
    "new_shards": """
WITH l AS (SELECT shard AS path, CAST(sum(coalesce(n_chars, 0)) AS BIGINT) AS size_bytes, CASE WHEN contains(lower(shard), 'software') THEN 0 ELSE 1 END AS priority
           FROM documents WHERE shard IS NOT NULL GROUP BY shard),
k AS (SELECT path, size_bytes, priority, status, attempts FROM shards WHERE priority = 0)
SELECT * FROM k UNION ALL SELECT path, size_bytes, priority, 'pending', 0 FROM l WHERE path NOT IN (SELECT path FROM k)""",
    "shortest_items": f"""SELECT item_id, dataset FROM (SELECT item_id, any_value(dataset) AS dataset, any_value(prompt) AS prompt FROM items GROUP BY item_id)
WHERE prompt IS NOT NULL ORDER BY length(prompt), item_id LIMIT 5""",
    "similar_vectors": """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS e FROM v)
SELECT q.vec_id AS query_id, u.vec_id, round(least(greatest(list_inner_product(q.e, u.e), 0), 1), 4) AS score
FROM u q JOIN u ON q.vec_id % 20 = 0 AND q.vec_id <> u.vec_id AND list_inner_product(q.e, u.e) >= 0.3""",
    "power_table": """
WITH p AS (SELECT a.a AS auc, n.n AS n, r.r AS r FROM (VALUES (0.6::DOUBLE), (0.7), (0.85)) a(a), (VALUES (164), (300), (542), (1000)) n(n), (VALUES (0.0::DOUBLE), (0.8), (0.9)) r(r)),
s AS (SELECT *, sqrt((auc * (1 - auc) + (n - 1) * (auc / (2 - auc) - auc * auc) + (n - 1) * (2 * auc * auc / (1 + auc) - auc * auc)) / (n * n)) AS se FROM p)
SELECT auc, n, r, round(se, 6) AS se, round((1.959963984540054 + 0.8416212335729143) * sqrt(2 * se * se * (1 - r)), 6) AS detectable FROM s""",
}
