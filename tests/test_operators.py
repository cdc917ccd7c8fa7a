import pytest
from pyspark.sql import functions as F

from copperleaf.operators import metrics, ngram, pairing, pilot, triage, validate

ITEM, DOC = "item_id string, dataset string, prompt string", "doc_id string, text string"


def scan(spark, items, docs, **more):
    return ngram.evidence(spark.createDataFrame(items, ITEM), spark.createDataFrame(docs, DOC), **more)


def test_wide_letters_case_and_line_ends(spark):
    got = scan(spark, [("a", "d", "Ｆind the sum of all numbers")], [("x", "say FIND the\nsum of all numbers now"), ("y", "nothing"), ("z", None)], n=3, exact=True).collect()
    assert [(r.document_id, r.normalized_verbatim, r.ngram_coverage, r.exact_char_start) for r in got] == [("x", True, 1.0, 4)]


def test_coverage_of_one_changed_word(spark):
    got = scan(spark, [("a", "d", "one two three four five six")], [("x", "one two three four five SEVEN")], n=2).first()
    assert got.ngram_coverage == 0.8 and got.string_match_label and not got.normalized_verbatim and got.matched_ngram_example == "one two"


def test_ranking_datasets_and_negatives(spark):
    items = [("a", "d", "one two three four five six"), ("a", "e", "red green blue black white pink"), ("b", "d", "never found in any of these"), ("b", "d", "never found in any of these"), ("n", "d", None)]
    docs = [("weak", "one two three x"), ("middle", "one two three four x"), ("strong", "one two three four five six"), ("9", "red green blue"), ("10", "red green blue")]
    got = scan(spark, items, docs, n=2, best=2, negatives=True).collect()
    assert {(r.item_id, r.dataset, r.document_id, r.candidate_rank) for r in got} == {("a", "d", "strong", 1), ("a", "d", "middle", 2), ("a", "e", "9", 1), ("a", "e", "10", 2), ("b", "d", None, 1), ("n", "d", None, 1)}


def test_short_queries(spark):
    got = scan(spark, [("s", "d", "tiny query"), ("t", "d", "a small text here")], [("x", "with a Tiny  Query inside"), ("y", "tinyquery"), ("z", "metatiny queryx"), ("w", "such a small text hereby")], n=13).collect()
    assert {(r.item_id, r.document_id) for r in got} == {("s", "x"), ("s", "z"), ("t", "w")}
    assert all(r.ngram_coverage == 0.0 and r.matched_token_start is None for r in got)


def test_merge(spark):
    parts = [("a-low", "d", "s1", "1", False, 0.4, 3), ("a-low", "d", "s2", "2", False, 0.9, 3), ("b", "d", "s1", "3", False, 0.8, 3), ("b", "d", "s2", "4", True, 0.2, 1)]
    df = spark.createDataFrame(parts, "item_id string, dataset string, source_shard string, document_id string, normalized_verbatim boolean, ngram_coverage double, matched_ngrams int")
    items = spark.createDataFrame([("a-low", "d", ""), ("b", "d", ""), ("c", "d", "")], ITEM)
    got = {(r.item_id, r.document_id, r.candidate_rank) for r in ngram.merge_evidence(df, items, 1).collect()}
    assert got == {("a-low", "2", 1), ("b", "4", 1), ("c", None, 1)}


def test_plan_of_the_scan(spark):
    df = scan(spark, [("a", "d", "one two three four")], [("x", "one two three four")], n=2)
    plan = df._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "WindowGroupLimit" in plan
    optimized = plan[plan.index("Optimized Logical Plan") : plan.index("Physical Plan")]
    # the tokenizer is never copied into a loop over places, and corpus text goes through it twice: all of it, and candidates
    assert "slice(regexp_extract_all" not in optimized and optimized.count("regexp_extract_all") <= 6


def naive_auc(rows):
    p, n = [s for s, y in rows if y], [s for s, y in rows if not y]
    return sum((a > b) + 0.5 * (a == b) for a in p for b in n) / (len(p) * len(n)) if p and n else None


def test_auc_and_youden(spark):
    import random

    r = random.Random(2)
    rows = [(g, round(r.random(), 1), r.random() < 0.4) for g in "ab" for _ in range(60)] + [("one", 0.5, True), ("b", None, True), ("b", 0.2, None)]
    df = spark.createDataFrame(rows, "g string, s double, y boolean")
    got = {x.g: x.auc for x in metrics.empirical_auc(df, "s", "y", ["g"]).collect()}
    best = {x.g: (x.threshold, round(x.j, 9)) for x in metrics.youden(df, "s", "y", ["g"]).collect()}
    for g in "ab":
        own = [(s, y) for h, s, y in rows if h == g and s is not None and y is not None]
        assert abs(got[g] - naive_auc(own)) < 1e-12
        rate = lambda t, k: sum(s > t for s, y in own if y == k) / max(1, sum(y == k for _, y in own))
        js = {t: rate(t, True) - rate(t, False) for t in sorted({s for s, _ in own})}
        top = max(js, key=lambda t: (round(js[t], 9), -t))
        assert best[g] == (top, round(js[top], 9))
        at = {x.g: x.j for x in metrics.youden_at(df, "s", "y", 0.5, ["g"]).collect()}
        assert abs(at[g] - js.get(0.5, rate(0.5, True) - rate(0.5, False))) < 1e-12
    assert got["one"] is None


def test_pairing(spark):
    rows = [("i", "a", 1.0), ("i", "b", 2.0), ("j", "a", 1.0), ("k", "a", 1.0), ("k", "b", float("nan")), ("l", "a", 3.0), ("l", "a", 3.0), ("l", "b", 3.0)]
    df = spark.createDataFrame(rows, "item_id string, quant string, score double")
    assert [tuple(r) for r in pairing.paired(df, ["item_id"], "score", "a", "b").collect()] == [("i", 1.0, 2.0)]
    assert [tuple(r) for r in pairing.duplicates(df, ["item_id", "quant"]).collect()] == [("l", "a", 2)]
    flat = spark.createDataFrame([("x", 1.0, 1.0), ("x", 1.0, 3.0), ("y", 1.0, 2.0), ("y", 2.0, 4.0), ("z", 1.0, 1.0)], "g string, a double, b double")
    assert {r.g: None if r.r is None else round(r.r, 9) for r in pairing.pearson(flat, "a", "b", ["g"]).collect()} == {"x": 0.0, "y": 1.0, "z": None}
    d = flat.groupBy("g").agg(pairing.cohens_d(F.col("b") - F.col("a")).alias("d"))
    assert {r.g: None if r.d is None else round(r.d, 6) for r in d.collect()} == {"x": 0.707107, "y": 2.12132, "z": None}


def pilot_tables(spark):
    items = [(f"i{k}", "lcb_post" if k < 4 else "lcb_pre", k >= 4, ["easy", "medium", "hard", "easy"][k % 4]) for k in range(8)]
    passed = {"bf16": [0, 1, 0, 1, 1, 1, 0, 1], "bnb_nf4": [0, 0, 0, 1, 1, 0, 0, 1]}
    score = {"bf16": [0.2, 0.7, 0.4, 0.6, 0.9, 0.8, 0.3, 0.5], "bnb_nf4": [0.3, 0.65, 0.35, 0.55, 0.75, 0.7, 0.25, 0.45]}
    gens = [(m, q, f"i{k}", 0, True, float(passed[q][k]), bool(passed[q][k]), 2.0 + (m == "m2"), 0.5, 0.25) for m in ("m1", "m2") for q in passed for k in range(8)]
    scores = [(m, q, f"i{k}", d, score[q][k] + 0.01 * n) for m in ("m1", "m2") for q in score for n, d in enumerate(("cdd", "perplexity", "mink_prob")) for k in range(8)]
    return (
        spark.createDataFrame(items, "item_id string, dataset string, contamination_proxy boolean, difficulty string"),
        spark.createDataFrame(gens, "model string, quant string, item_id string, sample_id int, is_greedy boolean, partial_pass_rate double, passed boolean, generation_seconds double, prompt_scoring_seconds double, sandbox_scoring_seconds double"),
        spark.createDataFrame(scores, "model string, quant string, item_id string, detector string, score double"),
    )


def test_pilot(spark):
    items, gens, scores = pilot_tables(spark)
    out = pilot.analyse(items, gens, scores)
    assert {(r.dataset, r.n_pairs) for r in out["score_shift"].collect()} == {("lcb_pre", 4), ("lcb_post", 4)}
    assert {r.n_pairs for r in out["auc_shift"].collect()} == {8}
    assert [r.contrast for r in out["did"].collect()] == ["lcb_pre_vs_lcb_post"] and abs(out["did"].first().did_pp) < 1e-9
    assert {r.stage: r.total_seconds for r in out["timing"].collect()}["generation_seconds"] == 80.0
    assert '"base_rates"' in pilot.summary_json(out)
    for bad in ((items.union(items), gens, scores), (items, gens.union(gens), scores), (items.where("item_id <> 'i1'"), gens, scores), (items, gens.withColumn("passed", F.lit(None).cast("boolean")), scores)):
        with pytest.raises(ValueError):
            pilot.analyse(*bad)
    assert validate.with_passed(gens.drop("passed")).where("passed").count() == gens.where("passed").count()
    assert {r.table for r in validate.completeness(items, gens, scores, models=1, quants=1, n_items=1, samples=1).collect()} == {"items", "generations", "detector_scores"}


def test_auc_shift_takes_only_the_primary_contrast(spark):
    items, _, scores = pilot_tables(spark)
    more = spark.createDataFrame([(f"h{k}", "humaneval", k > 1, None) for k in range(4)], items.schema)
    far = scores.where("item_id in ('i0', 'i1', 'i2', 'i3')").withColumn("item_id", F.translate("item_id", "i", "h")).withColumn("score", F.rand(3) + 5)
    got = {tuple(r) for r in pilot.auc_shift(scores.union(far), items.union(more), "bf16", "bnb_nf4").collect()}
    assert got == {tuple(r) for r in pilot.auc_shift(scores, items, "bf16", "bnb_nf4").collect()} and got


def test_gate_and_power_of_a_pilot(spark):
    items, gens, scores = pilot_tables(spark)
    config = {"n_items": 8, "models": ["m1", "m2"], "quant_levels": ["bf16", "bnb_nf4"], "n_cdd_samples": 0}
    with pytest.raises(ValueError, match="incomplete"):
        pilot.analyse(items, gens, scores, config=config)  # five detectors are expected
    out = pilot.analyse(items, gens, scores)
    gate = out["gate_record"].collect()
    assert {(r.threshold, r.passed) for r in gate} == {(0.7936, r.measured_auc >= 0.7936) for r in gate} and all(r.assumed_fall > 0 and r.detection_limit > 0 for r in gate)
    power = out["power_recompute"].collect()
    assert {r.analysis for r in power} == {"q1a", "q1b", "q2"}
    assert all((r.required_items is None) == (r.observed == 0) for r in power if r.analysis != "q1b")
    q2 = out["q2_summary"].first()
    assert q2.n_pairs == 16 and abs(q2.did_pp) < 1e-9 and 0 < q2.r < 1
    with pytest.raises(ValueError, match="no difficulty"):
        pilot.analyse(items.withColumn("difficulty", F.col("dataset")), gens, scores)


def test_answers_in_another_form_lose_no_pair(spark):
    pairs = spark.createDataFrame([(1, "a", "b", 0.7)], "pair_id int, normalized_benchmark_description string, normalized_training_description string, s double")
    fine, bad = (lambda *c: F.lit("Answer: A")), (lambda *c: F.lit("perhaps"))
    no = lambda c: F.lit("Decision: No\nReasoning: it isn't")
    assert triage.run_pairs(pairs, F.col("s"), fine, no).first().benchmark_trivial_output.startswith("Decision: No")
    for verify, screen in ((bad, no), (fine, bad)):
        with pytest.raises(Exception, match="another form"):
            triage.run_pairs(pairs, F.col("s"), verify, screen).collect()


def test_triage(spark):
    df = spark.createDataFrame([(0.9,), (0.6,), (0.75,)], "s double")
    assert [r.x for r in df.select(triage.route(F.col("s")).alias("x")).collect()] == ["direct_fi", "direct_u", "verify"]
    with pytest.raises(Exception):
        spark.createDataFrame([(1.2,)], "s double").select(triage.route(F.col("s"))).collect()
    pairs = spark.createDataFrame([(1, "a", "b", 0.95), (2, "c", "d", 0.7), (3, "e", "f", 0.1), (4, "g", "h", 0.8)], "pair_id int, normalized_benchmark_description string, normalized_training_description string, s double")
    verify = lambda b, t: F.when(b == "c", "Answer: C").otherwise("Answer: D")
    screen = lambda d: F.when(d == "d", "Decision: Yes\nReasoning: it is").otherwise("Decision: No\nReasoning: it isn't")
    got = {r.pair_id: (r.triage_route, r.pre_screen_label, r.excluded, r.binary_contamination_label) for r in triage.run_pairs(pairs, F.col("s"), verify, screen).collect()}
    assert got == {1: ("direct_fi", "FI", False, True), 2: ("verify", "SL", True, None), 3: ("direct_u", "U", False, False), 4: ("verify", "U", False, False)}
    out, cache = triage.cached_map(pairs, "normalized_benchmark_description", lambda c: F.upper(c), "up", spark.createDataFrame([("a", "KNOWN")], "normalized_benchmark_description string, up string"))
    assert {r.pair_id: r.up for r in out.collect()} == {1: "KNOWN", 2: "C", 3: "E", 4: "G"} and cache.count() == 4


def test_block_cosine(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.1]), (2, [-1.0, 0.0]), (3, None)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="zero or not finite"):
        triage.block_cosine(v.where("vec_id < 2"), spark.createDataFrame([(5, [0.0, 0.0])], v.schema), least=0.5).collect()
    for block in (1, 10):
        assert {(r.query_id, r.vec_id) for r in triage.block_cosine(v.where("vec_id < 2"), v, least=0.5, block=block).collect()} == {(0, 1), (1, 0)}


def test_validators(spark):
    cells = spark.createDataFrame([("m", "humaneval"), ("m", "mbppplus"), ("n", "humaneval"), ("n", None)], "model string, dataset string")
    assert [r.model for r in validate.pooled_cells(cells, ["model"]).collect()] == ["m"]
    a, b = (spark.createDataFrame([(x,) for x in s], "item_id string") for s in ("ab", "bc"))
    assert [r.item_id for r in validate.overlap(a, b).collect()] == ["b"] and [r.item_id for r in validate.unknown_items(a, b).collect()] == ["a"]
    rows = spark.createDataFrame([(2, 0, 0), (2, 2, 0), (2, 2, 3), (2, 1, 0)], "expected_shards int, searched_shards int, candidate_count int")
    assert [r.status for r in validate.coverage_status(rows).collect()] == ["not_searched", "search_complete_no_candidates", "search_complete_with_candidates", None]


def pair(**changes):
    row = {
        "pair_id": 1, "record_type": "pair", **{c: "x" for c in validate.PAIR_TEXTS}, "retrieval_score": 0.5, "embedding_score": 0.7, "triage_route": "verify",
        "raw_verification_output": "Answer: C", "pre_screen_label": "SL", "final_fine_grained_label": "SL", "excluded": False, "binary_contamination_label": True,
        "benchmark_trivial_screen": ("Decision: No\nReasoning: r", False), "training_trivial_screen": (None, None), "decoding_config": (0.0, 1.0, 1, 10, {}),
    }
    return row | changes


def test_pair_rules(spark):
    from copperleaf import schemas
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string("pair_id bigint, " + schemas.TRACER_PAIR)
    cases = {
        "text": {"shard": " "}, "score": {"retrieval_score": float("inf")}, "label": {"final_fine_grained_label": "FI"}, "excluded": {"excluded": None},
        "binary": {"binary_contamination_label": None}, "route": {"raw_verification_output": "Answer: A"}, "screen": {"training_trivial_screen": (None, False)},
        "screen_answer": {"benchmark_trivial_screen": ("Decision: Maybe", False)}, "decoding": {"decoding_config": (0.0, 0.0, 1, 10, {})},
    }
    rows = [pair()] + [pair(pair_id=10 + i, **c) for i, c in enumerate(cases.values())]
    df = spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)
    got = {(r.pair_id, r.rule) for r in validate.pair_violations(df).collect()}
    assert not [g for g in got if g[0] == 1]
    assert {(10 + i, rule) for i, rule in enumerate(cases)} <= got
    assert validate.pair_violations(df.limit(0)).collect() == []


def test_coverage_rules(spark):
    good = [("r", "a", 2, 0, None, "not_searched"), ("r", "b", 2, 2, 0, "search_complete_no_candidates"), ("r", "c", 2, 2, 3, "search_complete_with_candidates")]
    bad = [("r", "d", 2, 3, 0, "search_complete_no_candidates"), ("r", "e", 2, 0, 0, "not_searched"), ("r", "f", 2, 2, 0, "search_complete_with_candidates"), ("r", "g", 2, 2, None, "other")]
    df = spark.createDataFrame(good + bad, "run_id string, item_id string, expected_shards int, searched_shards int, candidate_count int, status string")
    assert {r.item_id for r in validate.coverage_violations(df).collect()} == {"d", "e", "f", "g"}


def test_power_of_effects_too_small_or_too_large(spark):
    shift = spark.createDataFrame([("m", "min_k", "d", x) for x in (0.0, 1e-12, 1e-200, 3.0)], "model string, detector string, dataset string, cohens_d double")
    aucs = spark.createDataFrame([("m", "min_k", a, x, 0.5) for a, x in ((0.7, 1e-6), (0.7, 0.0), (1.0, -0.3), (0.7, 0.69))], "model string, detector string, auc_baseline double, auc_shift double, r double")
    q2 = spark.createDataFrame([("a", 0.01), ("b", -5.5e-15), ("c", 1e4)], "contrast string, did_pp double")
    shift, aucs = (x.withColumn("detector", F.lit(pilot.PRIMARY_DETECTORS[0])) for x in (shift, aucs))
    got = {(r.analysis, r.observed): r.required_items for r in pilot.power_recompute(shift, aucs, q2).collect()}
    assert len(got) == 11 and {k for k, n in got.items() if n is None} == {("q1a", 0.0), ("q1a", 1e-12), ("q1a", 1e-200), ("q1b", 0.0), ("q2", 5.5e-15)}
    assert got["q1a", 3.0] == 1 and got["q1b", 1e-6] > 1e9 and got["q1b", 0.3] == 4 and got["q2", 0.01] > 1e7 and got["q2", 1e4] == 2
