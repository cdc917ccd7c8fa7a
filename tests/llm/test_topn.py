import random

from copperleaf.llm import topn


def expected(rows, n):
    best = {}
    for item, doc, score in rows:
        if item is None or doc is None or score is None or score != score or abs(score) == float("inf"):
            continue
        best[item, doc] = max(score, best.get((item, doc), score))
    out = set()
    for item in {i for i, _ in best}:
        docs = sorted(((s, d) for (i, d), s in best.items() if i == item), reverse=True)[:n]
        out |= {(item, d, r + 1) for r, (_, d) in enumerate(docs)}
    return out


def rows(seed, n):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        item = "hot" if r.random() < 0.5 else r.choice(["a", "b", "c", None])
        out.append((item, r.choice([str(r.randrange(400)), None]) if r.random() < 0.05 else str(r.randrange(400)), r.choice([None, float("nan"), float("inf")]) if r.random() < 0.1 else round(r.random(), 1)))
    return out


def frame(spark, data):
    return spark.createDataFrame(data, "item_id string, document_id string, retrieval_score double")


def test_cold_and_hot_paths_agree_with_brute_force(spark):
    data = rows(1, 3000)
    for heavy in (10**9, 50):
        got = {(r.item_id, r.document_id, r["rank"]) for r in topn.best_documents(frame(spark, data), 10, heavy_rows=heavy).collect()}
        assert got == expected(data, 10)


def test_empty_table(spark):
    assert topn.best_documents(frame(spark, []), 10).collect() == []


def test_null_group_extra_columns_and_null_scores(spark):
    df = spark.createDataFrame([(None, 1.0, "x", 1), (None, None, "y", 2), ("g", None, "z", 3)], "grp string, s double, t string, n int")
    got = {(r.grp, r.t, r["rank"]) for r in topn.top_n_per_group(df, "grp", "s", ["t"], 1, heavy_rows=1).collect()}
    assert got == {(None, "x", 1), ("g", "z", 1)}


def test_all_scores_tie_in_a_heavy_group(spark):
    df = spark.range(5000).selectExpr("'g' as grp", "0.5 as s", "cast(id as string) as t")
    got = [r.t for r in topn.top_n_per_group(df, "grp", "s", ["t"], 3, heavy_rows=10).orderBy("rank").collect()]
    assert got == ["999", "998", "997"]


def test_heavy_group_by_default_and_many_salts(spark):
    df = spark.range(3 * topn.HEAVY_ROWS).selectExpr("if(id % 3 = 0, 'g', 'h') as grp", "cast(id % 7 as double) as s", "cast(id as string) as t")
    want = [(r.grp, r.t, r["rank"]) for r in topn.top_n_per_group(df, "grp", "s", ["t"], 4, heavy_rows=10**9).orderBy("grp", "rank").collect()]
    for salt_rows in (50, topn.SALT_ROWS):
        got = topn.top_n_per_group(df, "grp", "s", ["t"], 4, salt_rows=salt_rows)
        assert [(r.grp, r.t, r["rank"]) for r in got.orderBy("grp", "rank").collect()] == want
    assert "Union" in got._jdf.queryExecution().toString()
