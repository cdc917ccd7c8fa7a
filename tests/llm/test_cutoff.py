import random

from copperleaf.llm import cutoff

SCHEMA = "model string, quant string, item_id string, sample_id int, text string, token_ids array<bigint>"


def sentence(r):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 9))) for _ in range(r.randrange(4, 10))).capitalize() + "."


def data(seed):
    r = random.Random(seed)
    rows, truth = [], set()
    for i in range(1500):
        text = " ".join(sentence(r) for _ in range(r.randrange(2, 7)))
        source = r.choice(["a", "b"])
        if source == "a" and len(text) > 200:
            text = text[:200]
            truth.add(i)
        elif r.random() < 0.05:
            text = text[: r.randrange(30, len(text) - 3)]
            truth.add(i)
        rows.append((source, "q", str(i), 0, text, None))
    return rows, truth


def test_held_out_accuracy(spark):
    rows, truth = data(1)
    pieces = spark.createDataFrame([(1, "x")], "token_id long, piece string")
    got = {int(r.item_id) for r in cutoff.cut_generations(spark.createDataFrame(rows + rows[:20], SCHEMA), pieces).collect()}
    sure = {i for i in truth if rows[i][4][-1].isalpha()}
    assert len(got & sure) >= 0.95 * len(sure)
    assert len(got - truth) <= 0.02 * len(rows)


def test_ids_that_go_on(spark):
    rows, _ = data(2)
    vocabulary = {c: i for i, c in enumerate("abcdefghABCDEFGH. ")}
    full = [(a, b, c, d, t, [vocabulary[x] for x in t]) for a, b, c, d, t, _ in rows if len(t) < 190]
    pieces = spark.createDataFrame([(i, c) for c, i in vocabulary.items()], "token_id long, piece string")
    odd = [("b", "q", "cut", 0, "Abc abd. Abc", [vocabulary[x] for x in "Abc abd. Abc abe abf."]), ("b", "q", "null", 0, None, None), ("b", "q", "empty", 0, "", []), (None, None, "free", 0, "Abc abd.", None)]
    df = spark.createDataFrame(full + odd, SCHEMA)
    got = {r.item_id for r in cutoff.cut_generations(df, pieces).collect()}
    assert "cut" in got and not got & {"null", "empty", "free"}
    joined = cutoff._decoded(df.where("item_id = 'cut'"), "token_ids", pieces).first()
    assert joined["__decoded"] == "Abc abd. Abc abe abf."


def test_limits(spark):
    rows = [("a", n, n, None) for n in list(range(1, 100)) + [100] * 20] + [("b", n, n, None) for n in range(1, 100)]
    got = {tuple(r) for r in cutoff.limits(spark.createDataFrame(rows, "s string, chars int, bytes int, tokens int"), ["s"]).collect()}
    assert ("a", "chars", 100) in got and not [g for g in got if g[0] == "b"]


def test_empty_table(spark):
    pieces = spark.createDataFrame([], "token_id long, piece string")
    assert cutoff.cut_generations(spark.createDataFrame([], SCHEMA), pieces).collect() == []
    assert cutoff.cut_rates(spark.createDataFrame([], SCHEMA), pieces).collect() == []


def test_vocabularies_of_any_size_read_ids_the_same_way(spark, monkeypatch):
    rows, _ = data(4)
    vocabulary = {c: i for i, c in enumerate("abcdefghABCDEFGH. ")}
    full = [(a, b, c, d, t, [vocabulary[x] for x in t] if len(t) % 3 else []) for a, b, c, d, t, _ in rows[:300]]
    full += [("a", "q", "none", 0, "", []), ("a", "q", "unknown", 0, "Abc abd.", [999])]
    pieces = spark.createDataFrame([(i, c) for c, i in vocabulary.items()], "token_id long, piece string")
    df = spark.createDataFrame(full, SCHEMA)
    score = lambda: {r.item_id: round(r.probability, 9) for r in cutoff.scores(df, cutoff.KEY, ["model"], "text", "token_ids", pieces).collect()}
    small = score()
    monkeypatch.setattr(cutoff, "MOST_PIECES", 1)
    assert score() == small and len(small) == 302


def test_a_longer_row_hides_no_limit(spark):
    rows = [("a", n, n, None) for n in list(range(1, 100)) + [100] * 20 + [130, 171]]
    got = {tuple(r) for r in cutoff.limits(spark.createDataFrame(rows, "s string, chars int, bytes int, tokens int"), ["s"]).collect()}
    assert ("a", "chars", 100) in got
