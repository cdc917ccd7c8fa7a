import random

from copperleaf.llm import toxic

BAD = ["you are a worthless {n} and nobody wants your work here", "shut up {n} you stupid {n} and go away for good", "people like {n} are vermin and should be driven out"]


def data(seed):
    r = random.Random(seed)
    name = lambda: "".join(r.choice("klmnopqrst") for _ in range(6))
    plain = ["the run of {n} took nine minutes on the old machine", "compared with {n} the score fell by four points", "we counted the rows of {n} and found no gap", "the word stupid occurs in the notes of {n}"]
    docs, bad = [], set()
    for i in range(900):
        parts = [r.choice(plain).format(n=name()).capitalize() + "." for _ in range(6)]
        if i % 12 == 0:
            parts.insert(r.randrange(6), r.choice(BAD).format(n=name()).capitalize() + ".")
            bad.add(i)
        docs.append((i, r.choice([" ", "\n"]).join(parts), r.choice(["s", None])))
    labels = [(i, int((i in bad) != (r.random() < 0.02))) for i in range(450)]
    return docs + [(901, None, "s"), (902, "", "s"), (903, "123 456", None)], labels, bad


def test_held_out_accuracy_and_rates(spark):
    docs, labels, bad = data(2)
    d, l = spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame(labels + labels[:3], "doc_id long, toxic int")
    got = {r.doc_id for r in toxic.toxic_documents(d, l).collect()}
    held = set(range(450, 900))
    assert len(got & bad & held) >= 0.9 * len(bad & held)
    assert len((got - bad) & held) <= 3
    scores = {r.doc_id: r.score for r in toxic.scores(d, l).collect()}
    assert len(scores) == len(docs) and scores[901] is None and scores[902] is None
    rates = {r.source: (r.n_documents, r.n_toxic) for r in toxic.rates(d, l).collect()}
    assert sum(n for n, _ in rates.values()) == len(docs) and sum(n for _, n in rates.values()) == len(got)


def test_disguised_words():
    for a, b in [("s.h.u.t up", "shut up"), ("v3rmin", "vermin"), ("stuuuupid", "stupid"), ("ｓｔｕｐｉｄ", "stupid"), ("st-upid", "stupid"), ("st​upid", "stupid"), ("аss", "ass")]:
        read = lambda t: [toxic.plain_word(w) for w in toxic.written_words(t)]
        assert read(a) == read(b), a


def test_no_labels_and_empty_table(spark):
    d = spark.createDataFrame([(1, "text", "s")], "doc_id long, text string, source string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [tuple(r) for r in toxic.scores(d, none).collect()] == [(1, None)]
    assert toxic.toxic_documents(d.limit(0), none).collect() == []


def test_more_toxic_labels_than_any_bound(spark, monkeypatch):
    """Every label counts: many toxic ones leave no ordinary text out."""
    docs, labels, bad = data(3)
    schema = "doc_id long, text string, source string"
    d, l = spark.createDataFrame(docs, schema), spark.createDataFrame(labels, "doc_id long, toxic int")
    want = {tuple(r) for r in toxic.scores(d, l).collect()}
    assert any(s is not None for _, s in want)
    monkeypatch.setattr(toxic, "MOST_LABELLED", sum(t for _, t in labels), raising=False)
    got = {tuple(r) for r in toxic.scores(d, l).collect()}
    assert got == want
    assert {r.doc_id for r in toxic.toxic_documents(d, l).collect()} & bad
