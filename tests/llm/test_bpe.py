import base64
import random

import pytest

from copperleaf.llm import bpe

tiktoken = pytest.importorskip("tiktoken")
FILE = f"{bpe.DIRECTORY}/byte_bpe_50k.json"


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(*bpe.read_vocabulary(FILE))


@pytest.fixture(scope="module")
def other():
    rows = [line.split() for line in open(FILE.replace(".json", ".tiktoken"), "rb")]
    return tiktoken.Encoding("own", pat_str=bpe.word_pattern()[1], mergeable_ranks={base64.b64decode(a): int(b) for a, b in rows}, special_tokens={})


TEXTS = ["", " ", "Hello world", "it's  we'll 'S x²½ ٣", "<|endoftext|>", "a" * 3000, "日本語のテキスト" * 40, "\t\n \r\n  x", "🙂🚀 mixed", "ab" * 700, "\x1c x\x85y", "def f(x):\n    return x"]


def test_same_as_another_implementation(encoder, other):
    r = random.Random(5)
    texts = TEXTS + ["".join(r.choice("abcdeéß 語12 .,\n") for _ in range(r.randrange(200))) for _ in range(300)]
    counts, flat = encoder.sizes_and_ids(texts)
    at = 0
    for t, n in zip(texts, counts.tolist()):
        assert flat[at : at + n].tolist() == other.encode_ordinary(t), t
        at += n
    assert encoder.sizes_and_ids(texts, ids=False)[0].tolist() == counts.tolist()


def test_merging_together_is_merging(encoder):
    r = random.Random(6)
    words = [bytes(r.choice(b"abcdefgh ") for _ in range(r.randrange(1, 90))) for _ in range(400)]
    assert encoder.exact(words) == [encoder.merge(w) for w in words]


def test_vocabulary_files_agree():
    a, b = bpe.read_vocabulary(FILE), bpe.read_vocabulary(FILE.replace(".json", ".tiktoken"))
    assert a[0] == b[0] and (a[1] == b[1]).all() and (a[2] == b[2]).all()


def test_rows(spark, other):
    df = spark.createDataFrame([(1, "Hello world", 0), (2, None, 0), (3, "", 0), (1, "again", 0)], "doc_id long, text string, ids int")
    got = sorted((r.doc_id, list(r.ids)) for r in bpe.encode(df, "doc_id", "text").collect())
    assert got == sorted([(1, other.encode_ordinary("Hello world")), (2, []), (3, []), (1, other.encode_ordinary("again"))])
    assert {(r.doc_id, tuple(r.ids)) for r in bpe.encode(df, "doc_id", "text", empty=(7, 8)).where("doc_id > 1").collect()} == {(2, (7, 8)), (3, (7, 8))}
    assert bpe.encode(df.limit(0), "doc_id", "text").collect() == []
