import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from copperleaf.functions import text as T


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {'string' if isinstance(v, str) or v is None else 'boolean'}" for n, v in values.items())).select(column.alias("x")).first()["x"] if names else None


def normal(t):
    return " ".join(unicodedata.normalize("NFKC", t).casefold().split())


def test_exact_normalisation(spark):
    texts = ["Straße  X", "ＡＢＣ\n d", None, "", "ﬁ\t　x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.x for r in df.select("i", T.normalize_exact(F.col("t")).alias("x")).orderBy("i").collect()]
    assert got == [None if t is None else normal(t) for t in texts]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet="aBé1.2_ßxÉ語 ,\n-", max_size=40), min_size=1, max_size=20))
def test_tokens_are_those_of_the_pattern(spark, texts):
    pattern = re.compile(r"[A-Za-z_][A-Za-z_0-9]*|\d+(?:\.\d+)?|[^\w\s]")
    df = T.with_tokens(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"), "t")
    got = {r.i: (r.normalized, r.tokens) for r in df.collect()}
    for i, t in enumerate(texts):
        assert got[i] == (normal(t), pattern.findall(normal(t)))


def test_grams_and_context(spark):
    df = spark.createDataFrame([(["a", "b", "a", "b", "c"],), ([],), (["x"],)], "t array<string>")
    assert [r.g for r in df.select(T.grams(F.col("t"), 2).alias("g")).collect()] == [["a b", "b a", "a b", "b c"], [], []]
    assert [r.n for r in df.select(F.size(F.array_distinct(T.gram_hashes(F.col("t"), 2))).alias("n")).collect()] == [3, 0, 0]
    assert df.limit(1).select(T.context(F.col("t"), F.lit(2), 1, 1).alias("c")).first().c == "b a b"


@pytest.mark.parametrize("answer,label", [("Answer: A", "FI"), ("Answer: D", "U"), ("Answer: E", None), ("Answer: A\n", None), ("x Answer: A", None), (None, None)])
def test_labels(spark, answer, label):
    assert one(spark, T.fine_label(F.col("a")), a=answer) == label


@pytest.mark.parametrize("answer,value", [("Decision: Yes\nReasoning: short", True), ("Decision: No\nReasoning: a", False), ("Decision: No\nReasoning: a\nb", None), ("Decision: Maybe\nReasoning: a", None), ("Decision: Yes", None)])
def test_decisions(spark, answer, value):
    assert one(spark, T.trivial_decision(F.col("a")), a=answer) is value


def test_fences_output_and_rendering(spark):
    assert one(spark, T.fenced(F.col("a")), a="x\n```python\na = 1\n```\ny\n```\nb\n```") == "b\n"
    assert one(spark, T.fenced(F.col("a")), a=" no fence ") == " no fence "
    assert one(spark, T.program_output(F.col("a")), a="a  \nb\t\n\n \n") == "a\nb"
    assert one(spark, T.render("<{a}|{b}>", a=F.col("a"), b=F.col("b")), a="{b}", b="x") == "<{b}|x>"
    with pytest.raises(ValueError):
        T.render("{missing}")


def test_json(spark):
    assert one(spark, T.same_json(F.col("a"), F.col("b")), a='{"x": [1, 2.0]}', b='{ "x":[1,2] }') is True
    assert one(spark, T.same_json(F.col("a"), F.col("b")), a="abc", b="abd") is False
    record = '{"id": "7", "messages": [{"role": "user", "content": "hello"}, {"content": "there", "n": 3}], "ground_truth": "42", "other": "no"}'
    assert one(spark, T.extract_text(F.col("a")), a=record) == "hello\nthere\n42"
    assert one(spark, T.extract_text(F.col("a")), a="no json") is None
    import base64
    import zlib

    assert one(spark, T.packed_json(F.col("a")), a=base64.b64encode(zlib.compress(b"[1]")).decode()) == "[1]"
    assert one(spark, T.packed_json(F.col("a")), a="zzz") is None
