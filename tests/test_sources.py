import json
import os

import pytest
from pyspark.sql import functions as F

from copperleaf import schemas
from copperleaf.operators import ngram
from copperleaf.sources import readers, shards, sinks
from copperleaf.streaming import scan

def now():
    return F.lit("2025-01-01 01:00:00").cast("timestamp")


def manifest(spark):
    empty = spark.createDataFrame([], schemas.SHARDS)
    listed = spark.createDataFrame([("general.jsonl.zst", 20, 1), ("software.jsonl.zst", 10, 0), ("software.jsonl.zst", 10, 0)], "path string, size_bytes bigint, priority int")
    return shards.add_new(empty, listed), listed


def test_shard_life(spark):
    m, listed = manifest(spark)
    assert m.count() == 2 and shards.add_new(m, listed).count() == 2
    m = shards.claim(m, 1, "w", "t", now())
    state = lambda d: {r.path.split(".")[0]: (r.status, r.attempts) for r in d.collect()}
    assert state(m) == {"software": ("running", 1), "general": ("pending", 0)}
    late = F.lit("2025-01-01 01:10:01").cast("timestamp")
    assert state(shards.recover_stale(m, late))["software"] == ("pending", 1)
    assert state(shards.recover_stale(shards.heartbeat(m, "t", late), late))["software"] == ("running", 1)
    assert state(shards.recover_stale(shards.heartbeat(m, "other", late), late))["software"] == ("pending", 1)
    done = spark.createDataFrame([("software.jsonl.zst", 7, 2, "out")], "path string, documents_scanned bigint, evidence_rows bigint, output_path string")
    assert state(shards.complete(m, done, "other", now()))["software"] == ("running", 1)
    c = shards.complete(m, done, "t", now())
    assert state(c)["software"] == ("complete", 1) and [r.path for r in shards.unfinished(c).collect()] == ["general.jsonl.zst"]
    assert tuple(shards.progress(c).first()) == (0.5, 10 / 30)
    f = shards.fail(m, "software.jsonl.zst", "t", "broken", now())
    assert state(f)["software"] == ("failed", 1) and state(shards.retry_failed(f))["software"] == ("pending", 1)
    assert state(shards.invalidate_complete(c))["software"] == ("pending", 1)
    assert {r.status: (r.shards, r.documents_scanned) for r in shards.status_counts(c).collect()} == {"complete": (1, 7), "pending": (1, 0)}
    assert tuple(shards.progress(c.limit(0)).first()) == (0.0, 0.0)


def test_run_round_trip(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="items, generations, detector_scores"):
        readers.read_run(spark, str(tmp_path))
    spark.createDataFrame([("i", "lcb_pre", "p", None, True, None, "r", "{}")], schemas.ITEMS).write.parquet(f"{tmp_path}/items.parquet")
    for k in range(2):
        spark.createDataFrame([("m", "q", "i", k, k == 0, "t", [1], [-0.1], None, 1.0, True, 0.0, 1.0, None, None, None, None)], schemas.GENERATIONS).write.parquet(f"{tmp_path}/generations-{k}.parquet")
    spark.createDataFrame([], schemas.DETECTOR_SCORES).write.parquet(f"{tmp_path}/detector_scores.parquet")
    items, generations, scores = readers.read_run(spark, str(tmp_path))
    assert (items.count(), generations.count(), scores.count()) == (1, 2, 0)
    sinks.write_part(generations, str(tmp_path), "out")
    sinks.write_part(generations.limit(0), str(tmp_path), "none")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2 and not os.path.exists(f"{tmp_path}/none")


def test_documents_and_records(spark, tmp_path):
    zstandard = pytest.importorskip("zstandard")
    lines = '{"id": "a", "text": "x"}\n\n{"text": "y", "source": "s"}\n'
    os.makedirs(f"{tmp_path}/software")
    os.makedirs(f"{tmp_path}/SoftWare-b/x")
    open(f"{tmp_path}/SoftWare-b/x/q.jsonl.zst", "wb").write(b"1")
    assert {(r.path[-1:], r.priority) for r in readers.list_shards(spark, f"{tmp_path}/SoftWare-b").collect()} == {("t", 1)}
    assert [r.priority for r in readers.list_shards(spark, str(tmp_path)).collect()] == [0]
    os.remove(f"{tmp_path}/SoftWare-b/x/q.jsonl.zst")
    with open(f"{tmp_path}/software/p.jsonl.zst", "wb") as f:
        f.write(zstandard.ZstdCompressor().compress(lines.encode()))
    listed = readers.list_shards(spark, str(tmp_path)).collect()
    assert [(r.priority, r.size_bytes > 0) for r in listed] == [(0, True)]
    plain = f"{tmp_path}/p.jsonl"
    open(plain, "w").write(lines)
    docs = readers.read_documents(spark, plain).collect()
    assert [d.text for d in docs] == ["x", "y"] and docs[0].id == "a" and docs[1].id and readers.read_documents(spark, plain, cap=1).count() == 1
    try:
        assert sorted(d.text for d in readers.read_documents(spark, f"{tmp_path}/software/p.jsonl.zst").collect()) == ["x", "y"]
    except Exception as e:  # a Hadoop without its native library has no zstd codec
        assert "zstd" in str(e).lower() or "native" in str(e).lower()
    path = f"{tmp_path}/r.jsonl"
    open(path, "w").write('{"record_type": "item_coverage", "item_id": "i", "expected_shards": 2}\n')
    assert readers.read_records(spark, path, schemas.ITEM_COVERAGE, "item_coverage").first().expected_shards == 2
    open(path, "a").write("oops\n")
    with pytest.raises(ValueError, match=r"r\.jsonl:2"):
        readers.read_records(spark, path, schemas.ITEM_COVERAGE, "item_coverage")


def test_items(spark):
    rows = spark.createDataFrame([("q1", "p", "easy", "hub", "2023-01-01", '{"func_name": "f"}'), ("q2", "pp", "hard", "hub", "2024-06-01", "{}")], "question_id string, question_content string, difficulty string, platform string, contest_date string, metadata string")
    items = readers.problems_to_items(rows, "v", "2024-01-01").orderBy("item_id").collect()
    assert [(i.dataset, i.contamination_proxy) for i in items] == [("lcb_pre", True), ("lcb_post", False)] and json.loads(items[0].metadata_json)["func_name"] == "f"
    part = spark.createDataFrame([(f"i{k}", "d", "x" * (9 - k)) for k in range(5)], "item_id string, dataset string, prompt string").coalesce(1)
    assert [r.item_id for r in readers.all_items([part], first=2).orderBy("item_id").collect()] == ["i0", "i1"]
    assert [r.item_id for r in readers.shortest_items(part, 2).collect()] == ["i4", "i3"]
    assert readers.fixed_size(part, 5, "x") is part
    with pytest.raises(ValueError):
        readers.fixed_size(part, 6, "x")
    with pytest.raises(KeyError):
        readers.read_release(spark, "v9", {"v1": []}, schemas.ITEMS)


def test_manifest(tmp_path):
    path = str(tmp_path / "m.json")
    sinks.write_manifest(path, {"b": 1, "a": 2}, note="x")
    assert sinks.write_manifest(path, {"a": 2, "b": 1})["config_hash"] == sinks.read_manifest(path)["config_hash"]
    with pytest.raises(ValueError):
        sinks.write_manifest(path, {"a": 3})


def test_generation_cache(spark):
    kinds = "model string, model_revision string, quant string, item_id string, sample_id int, decoding_temperature double, is_greedy boolean, prompt string"
    rows = spark.createDataFrame([("m", None, "q", "i", 0, 0.0, True, "p"), ("m", "r", "q", "i", 1, 0.8, False, "p")], kinds)
    changed = sinks.generation_keys(rows.withColumn("prompt", F.lit("another prompt")))
    assert changed.join(sinks.generation_keys(rows), "cache_key").count() == 0
    keyed = sinks.generation_keys(rows)
    assert keyed.select("cache_key").distinct().count() == 2
    assert [r.sample_id for r in sinks.uncached(keyed, keyed.where("sample_id = 0")).collect()] == [1]


def test_incremental_scan_equals_batch(spark, tmp_path):
    items = spark.createDataFrame([("a", "d", "one two three four five six"), ("b", "d", "red green blue black white")], "item_id string, dataset string, prompt string")
    docs = [(1, "one two three four"), (2, "red green blue"), (3, "one two three four five six"), (4, None), (5, "white red green blue black")]
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    assert scan.best_evidence(spark, out) is None
    for k, part in enumerate((docs[:2], docs[2:])):
        spark.createDataFrame(part, "doc_id long, text string").coalesce(1).write.mode("append").parquet(folder)
        scan.scan(spark, folder, "doc_id long, text string", items, out, n=3, best=2).awaitTermination()
    scan.scan(spark, folder, "doc_id long, text string", items, out, n=3, best=2).awaitTermination()
    for other in ({"items": items.limit(1)}, {"n": 4}):
        with pytest.raises(ValueError, match="another configuration"):
            scan.scan(spark, folder, "doc_id long, text string", **({"items": items, "out": out, "n": 3, "best": 2} | other))
    columns = ["dataset", "item_id", "document_id", "candidate_rank", "ngram_coverage"]
    got = {tuple(r) for r in scan.best_evidence(spark, out).select(columns).collect()}
    assert got == {tuple(r) for r in ngram.evidence(items, spark.createDataFrame(docs, "doc_id long, text string"), n=3, best=2).select(columns).collect()}
