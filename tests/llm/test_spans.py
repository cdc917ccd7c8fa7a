import itertools
import random

import pytest

from copperleaf.llm import spans


def brute(rows, n):
    out = set()
    for (f, a, x), (g, b, y) in itertools.combinations(rows, 2):
        if f == g and x and y and a != b:
            grams = {x[i : i + n] for i in range(len(x) - n + 1)}
            if any(y[i : i + n] in grams for i in range(len(y) - n + 1)):
                out.add((f, *sorted((a, b))))
    return out


def corpus(seed, count=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgé語 ") for _ in range(r.randrange(5, 90)))
    shared = [word() for _ in range(6)]
    rows = [(r.randrange(2), i, "".join(r.choice([word(), r.choice(shared)]) for _ in range(r.randrange(1, 6)))) for i in range(count)]
    rows += [(0, 1000 + i, rows[i][2]) for i in range(5)] + [(0, 2000, None), (0, 2001, ""), (0, 2002, "a" * 300), (0, 2003, "xa" + "a" * 200), (0, 2004, "ab" * 150)]
    return rows


@pytest.mark.parametrize("hot", [64, 2])
def test_pairs_equal_brute_force(spark, hot, monkeypatch):
    rows = corpus(3)
    df = spark.createDataFrame(rows, "f int, key long, value string")
    monkeypatch.setattr(spans.shared_spans, "__kwdefaults__", {"hot": hot})
    got = {tuple(r) for r in spans.sharing_pairs(df, 30).collect()}
    assert got == brute(rows, 30) and got


def test_share_counts_characters_once(spark):
    block = "".join(chr(97 + i * 7 % 26) for i in range(40)) + "0123456789"
    rows = [(0, 1, "x" * 10 + block), (0, 2, block + "y" * 20), (0, 3, None), (0, 4, "nothing shared here, nothing at all, really"), (0, 5, "copy of a text that is long enough to count"), (0, 6, "copy of a text that is long enough to count")]
    df = spark.createDataFrame(rows, "f int, key long, value string")
    got = {r.key: (r.n_chars, r.shared_chars) for r in spans.shared_share(df, 30).collect()}
    assert got == {1: (60, 50), 2: (70, 50), 3: (0, 0), 4: (43, 0), 5: (43, 43), 6: (43, 43)}


def test_empty_table(spark):
    df = spark.createDataFrame([], "f int, key long, value string")
    assert spans.sharing_pairs(df, 30).collect() == [] and spans.shared_share(df, 30).collect() == []


def test_anchors_of_common_spans_agree():
    r = random.Random(1)
    for _ in range(100):
        common = "".join(r.choice("ab") for _ in range(30))
        a, b = ("".join(r.choice("abc") for _ in range(r.randrange(50))) + common + "c" * r.randrange(9) for _ in range(2))
        owner, _, h = spans.winnow([a, b], 30)
        assert {*h[owner == 0].tolist()} & {*h[owner == 1].tolist()}


def covered(x, y, n):
    """Characters of x in an n-gram that y has."""
    grams = {y[i : i + n] for i in range(len(y) - n + 1)}
    return len({i + j for i in range(len(x) - n + 1) if x[i : i + n] in grams for j in range(n)})


def test_share_of_long_runs(spark):
    """Both texts count all their characters in runs and periodic blocks, not one of them."""
    block = "".join(chr(97 + i * 7 % 26) for i in range(40))
    for x, y in [("=" * 900, "a" + "=" * 700 + "b"), ("ab" * 500 + "x" + block, "y" + "ba" * 400 + block + "ab" * 60 + "z" + block), ("-" * 400 + "c" + "-" * 300, "d" + "-" * 900)]:
        df = spark.createDataFrame([(0, 1, x), (0, 2, y)], "f int, key long, value string")
        got = {r.key: r.shared_chars for r in spans.shared_share(df, 30).collect()}
        assert got == {1: covered(x, y, 30), 2: covered(y, x, 30)}
