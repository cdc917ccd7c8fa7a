import math
import random

from pyspark.sql import functions as F

from copperleaf.functions import arrays as A
from copperleaf.operators import detectors


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_token_edits(spark):
    r = random.Random(1)
    rows = [([r.randrange(10**9) if r.random() < 0.3 else r.randrange(5) for _ in range(r.randrange(100))] for _ in range(2)) for _ in range(150)]
    rows = [tuple(map(list, x)) for x in rows] + [([], []), ([1], []), (list(range(100)), list(range(100, 200)))]
    df = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>")
    for r in df.select("a", "b", A.token_edits(F.col("a"), F.col("b")).alias("d"), A.token_edits(F.col("a"), F.col("b"), 5).alias("t")).collect():
        d = edits(r.a, r.b)
        assert r.d == d and r.t == (d if d <= 5 else -1)


def test_logprobs(spark):
    df = spark.createDataFrame([(1, [float(-i) for i in range(10)]), (2, []), (3, None), (4, [-1.0, -2.0, -3.0])], "i int, a array<double>")
    got = {r.i: r for r in df.select("i", A.min_k_prob(F.col("a")).alias("k"), A.mean_logprob(F.col("a")).alias("m"), A.perplexity(F.col("a")).alias("p"), A.min_k_prob(F.col("a"), 1).alias("one")).collect()}
    assert got[1].k == -8.5 and got[1].m == -4.5 and math.isclose(got[1].p, math.exp(4.5))
    assert got[2].k is None and got[3].m is None and got[4].one == -3.0


def test_half_even(spark):
    df = spark.createDataFrame([([float(-i) for i in range(n)],) for n in (12, 13)], "a array<double>")  # 2.4 and 2.6 of them
    assert sorted(r.k for r in df.select(A.min_k_prob(F.col("a")).alias("k")).collect()) == [-11.0, -10.5]


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.8, 0.6]), ([1.0, 0.0], [-1.0, 0.0])], "a array<double>, b array<double>")
    assert [round(r.c, 6) for r in df.select(A.clipped_cosine(A.l2_normalized(F.col("a")), A.l2_normalized(F.col("b"))).alias("c")).collect()] == [0.8, 0.0]


def test_peakedness_border(spark):
    greedy = list(range(100))
    rows = [("m", "q", "i", 0, True, greedy), ("m", "q", "i", 1, False, [-1] * 5 + greedy[5:]), ("m", "q", "j", 0, True, greedy), ("m", "q", "j", 1, False, [-1] * 6 + greedy[6:]), ("m", "q", "k", 1, False, greedy)]
    df = spark.createDataFrame(rows + rows[:2], "model string, quant string, item_id string, sample_id int, is_greedy boolean, token_ids array<bigint>")
    assert {r.item_id: r.peakedness for r in detectors.peakedness(df).collect()} == {"i": 1.0, "j": 0.0}
