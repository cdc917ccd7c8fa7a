import pytest
from hypothesis import given
from hypothesis import strategies as st

from copperleaf.llm import visual

SAME = [("abc", "ａｂｃ"), ("é", "é"), ("a b", "a b"), ("ab", "a​b"), ("ab", "a­b"), ("scope", "ѕсоре"), ("a-b", "a‑b"), ("a\nb", "a\r\nb"),
        ("한국", "한국"), ("ё", "ë"), ("ﬁn", "fin"), ("à", "а͏̀")]
DIFFERENT = [("a", "A"), ("e", "é"), ("x2", "x²"), ("1", "2"), ("o", "ø"), ("i", "ᵢ"), ("ss", "ß"), ("a b", "a\nb"), ("-", "—")]


@pytest.mark.parametrize("a,b", SAME)
def test_looks_the_same(a, b):
    assert visual.visual_form(a) == visual.visual_form(b)


@pytest.mark.parametrize("a,b", DIFFERENT)
def test_looks_different(a, b):
    assert visual.visual_form(a) != visual.visual_form(b)


@given(st.text())
def test_forms_are_stable(t):
    assert visual.visual_form(visual.visual_form(t)) == visual.visual_form(t)
    assert visual.folded_form(visual.folded_form(t)) == visual.folded_form(t)


def test_folded_joins_case_and_compatibility():
    assert visual.folded_form("Straße  X²\t") == visual.folded_form("STRASSE x2")
    assert visual.folded_form(None) is None and visual.visual_form("") == ""


def test_pairs(spark):
    data = [("f", "1", "abc"), ("f", "2", "ａbc"), ("f", "3", "abc"), ("f", "3", "abc"), ("f", "4", None), ("f", "5", ""), ("g", "6", "abc"), ("f", "7", "Abc"), ("f", "10", "a​bc")]
    got = {tuple(r) for r in visual.look_alike_pairs(spark.createDataFrame(data, "field_name string, key string, value string")).collect()}
    want = set()
    for i, (f, k, v) in enumerate(data):
        for g, q, w in data:
            if v and w and f == g and k < q and v != w and visual.visual_form(v) == visual.visual_form(w):
                want.add((f, k, q))
    assert got == want and want


def test_empty_table_and_columns(spark):
    assert visual.look_alike_pairs(spark.createDataFrame([], "field_name string, key string, value string")).collect() == []
    df = spark.createDataFrame([("Ａ", 1), (None, 2), ("Ａ", 3)], "t string, n int")
    assert [(r.visual, r.folded) for r in visual.with_forms(df, "t").orderBy("n").collect()] == [("A", "a"), (None, None), ("A", "a")]
    with pytest.raises(ValueError):
        visual.with_forms(df.withColumnRenamed("n", "visual"), "t")


def test_copies_of_a_value_with_one_variant(spark):
    copies = spark.range(20_000).selectExpr("'f' as field_name", "cast(id as string) as key", "'abc' as value")
    df = copies.unionByName(spark.createDataFrame([("f", "x", "ａbc")], "field_name string, key string, value string"))
    got = visual.look_alike_pairs(df)
    assert got.count() == 20_000 and got.where("key_b = 'x'").count() == 20_000


def test_folded_classes(spark):
    data = [("f", "1", "Straße  X²"), ("f", "2", "STRASSE x2"), ("f", "3", None), ("f", "4", ""), ("f", "5", "a​b"), ("f", "6", "AB")]
    got = {r.key: r.form for r in visual.folded_classes(spark.createDataFrame(data, "field_name string, key string, value string")).collect()}
    assert got["1"] == got["2"] and got["5"] == got["6"] and got["3"] is None and got["4"] is not None and len(set(got.values())) == 4
