"""Problem 8: abusive, hateful or sexually explicit text.

Two Kneser-Ney bigram models, of documents labelled toxic and ordinary, share their lower order: continuation
counts pooled over both classes. Labels are of documents, most of whose passages are ordinary, and some labels
are wrong; so bigrams count by the documents that have them, and what a single toxic document has goes to the
shared part: ordinary passages then have a ratio near 0. A passage scores the difference of its
length-normalised log-likelihoods, a document the score of its worst passage.

Words and bigrams are counted over all labelled documents, in tasks; their texts stay there. What reaches the driver
and is broadcast is the vocabulary, of at most ``MOST_WORDS`` words, and one row a different bigram of it. Scoring
covers every passage of every document.

Results for odd input: null and empty texts score null, as do texts without a word; without labels of both kinds
every document scores null; contradicting labels count by majority, ties as ordinary.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copperleaf.llm.visual import visual_form
from copperleaf.operators.ngram import broadcast_if_small
from copperleaf.session import discard, materialize

MOST_WORDS = 50_000
#: So many different words as they are written are remembered at a time.
MOST_KNOWN = 300_000
DISCOUNT = 0.75
#: A passage is toxic from this score on.
THRESHOLD = 0.7
#: A score is a mean log-likelihood ratio a bigram, and at most this share of the sum, so that few words don't suffice.
SUM_SHARE = 0.094
#: One bigram counts no more than this, so a passage needs several.
CLIP = 3.5
#: Passages are no longer than so many words.
LONGEST = 40

MARK, RARE, NUMBER = 0, 1, 2
_PASSAGE = re.compile(r"(?<=[.!?。！？])\s|\n")
# Letters kept apart by single signs, as in a spelled-out word.
_SPELLED = re.compile(r"(?<!\w)\w(?:[.\-_*·~ ]\w){2,}(?!\w)")
_MASKED = re.compile(r"\w+\*+\w*")
_BROKEN = re.compile(r"(?<![\w-])(?:[^\W\d_]{1,2}-[^\W\d_]+|[^\W\d_]+-[^\W\d_]{1,2})(?![\w-])")
_WORD = re.compile(r"\x00|[^\W_]+(?:['’][^\W_]+)*|[^\w\s]")
_DRAWN_OUT = re.compile(r"(.)\1{2,}")
# Digits and signs that stand for letters inside a word.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"})
_LEET_SIGNS = re.compile(r"(?<!\w)[@$](?=[@$]*\w)|(?<=\w)[@$!](?=[@$]*\w)")


def written_words(text: str) -> list[str]:
    """The words of a text, with a mark before, between and after passages; spelled-out, broken and masked words joined."""
    low = visual_form(text).replace("\0", " ")
    low = low.lower() if low.isascii() else unicodedata.normalize("NFKC", low).casefold()
    low = _SPELLED.sub(lambda m: re.sub(r"[^\w]|_", "", m[0]), low)
    if "*" in low:
        low = _MASKED.sub(lambda m: m[0].replace("*", "x"), low)
    if "@" in low or "$" in low or "!" in low:
        low = _LEET_SIGNS.sub(lambda m: {"@": "a", "$": "s", "!": "i"}[m[0]], low)
    low = _BROKEN.sub(lambda m: m[0].replace("-", ""), low)
    return _WORD.findall("\0" + _PASSAGE.sub("\0", low) + "\0")


def plain_word(word: str) -> str | None:
    """A written word without digits for letters and drawn-out letters; None for a number."""
    if word.isdigit():
        return None
    if not word.isalpha() and any(c.isdigit() for c in word):
        word = word.translate(LEET)
    return _DRAWN_OUT.sub(r"\1", word)


class _Numbers(dict):
    """Words as written to the numbers of a vocabulary."""

    def __init__(self, words: dict[str, int]):
        super().__init__({"\0": MARK})
        self.words = words

    def __missing__(self, written: str) -> int:
        word = plain_word(written)
        n = NUMBER if word is None else self.words.get(word, RARE)
        self[written] = n
        return n

    def rows(self, texts: list[str]) -> list[np.ndarray]:
        if len(self) > MOST_KNOWN:
            self.clear()
            self["\0"] = MARK
        words = [written_words(t) for t in texts]
        return [np.fromiter(map(self.__getitem__, w), np.int64, len(w)) for w in words]


def _bigrams(row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both words of each bigram, and the number of its passage."""
    a, b = row[:-1], row[1:]
    ok = (a != MARK) | (b != MARK)
    start = a == MARK
    at = np.arange(len(a)) - np.maximum.accumulate(np.where(start, np.arange(len(a)), 0))
    passage = np.cumsum(start | (at % LONGEST == 0))
    return a[ok], b[ok], passage[ok]


class Model:
    """Two bigram Kneser-Ney models with shared lower orders, as sorted arrays of bigrams."""

    def __init__(self, size: int, toxic: tuple[np.ndarray, np.ndarray], plain: tuple[np.ndarray, np.ndarray]):
        """From the different bigrams (a * size + b) of both classes and in how many documents each occurs."""
        self.size = size
        pair = [toxic, plain]
        both = np.union1d(pair[0][0], pair[1][0])
        # shared: after how many different words a word comes, in either class
        after = np.bincount(both % size, minlength=size) + 0.5
        self.base = base = np.log(after / after.sum())
        self.classes = []
        for (keys, n), discount in zip(pair, (1.0, DISCOUNT)):  # what one toxic document alone has goes to the shared part
            left = keys // size
            total, kinds = np.bincount(left, n, minlength=size), np.bincount(left, minlength=size)
            rest = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            seen = np.maximum(n - discount, 0) / np.maximum(total[left], 1) + rest[left] * np.exp(base[keys % size])
            self.classes.append((np.append(keys, np.int64(2**62)), np.append(np.log(seen), 0.0), np.log(rest)))

    def scores(self, a: np.ndarray, b: np.ndarray, passage: np.ndarray) -> np.ndarray:
        """Of each passage, in order: the mean ratio a bigram, held down where there is little evidence in all."""
        if not len(a):
            return np.zeros(0)
        key, value = a * self.size + b, []
        for keys, seen, rest in self.classes:
            k = np.searchsorted(keys, key)
            value.append(np.where(keys[k] == key, seen[k], rest[a] + self.base[b]))
        ratio = value[0] - value[1]
        borders = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
        total = np.add.reduceat(np.clip(ratio, -CLIP, CLIP), borders)
        size = np.diff(np.append(borders, len(a)))
        return np.minimum(total / size, total * SUM_SHARE)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        written = Counter(chain.from_iterable(written_words(t) for t in batch.column(0).to_pylist()))
        del written["\0"]
        counts: Counter[str] = Counter()
        for w, n in written.items():
            if (word := plain_word(w)) is not None:
                counts[word] += n
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])


def _bigram_counts(shared):
    """(key, toxic, n): in how many documents of a batch each bigram occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        numbers, size = _Numbers(words), len(words) + 3
        for batch in batches:
            kinds = {True: [], False: []}
            for row, label in zip(numbers.rows(batch.column(0).to_pylist()), batch.column(1).to_pylist()):
                a, b, _ = _bigrams(row)
                kinds[label].append(np.unique(a * size + b))
            for label, keys in kinds.items():
                if keys:
                    key, n = np.unique(np.concatenate(keys), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array([label] * len(key), pa.bool_()), pa.array(n)], ["key", "toxic", "n"])

    return run


def fit(labelled: DataFrame) -> tuple[dict[str, int], Model] | None:
    """Vocabulary and model from ``labelled(text, toxic)``: whole texts and their labels, all of them."""
    if labelled.select("toxic").distinct().count() < 2:
        return None
    counts = labelled.select("text").mapInArrow(_word_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    best = counts.where("n > 1").orderBy(F.col("n").desc(), "word").limit(MOST_WORDS).select("word").toArrow()
    words = {w: i + 3 for i, w in enumerate(best.column(0).to_pylist())}
    shared = labelled.sparkSession.sparkContext.broadcast(words)
    rows = labelled.select("text", "toxic").mapInArrow(_bigram_counts(shared), "key long, toxic boolean, n long")
    of = [F.sum(F.when(F.col("toxic") == kind, F.col("n")).otherwise(0)).alias(name) for kind, name in ((True, "bad"), (False, "plain"))]
    found = rows.groupBy("key").agg(*of).toArrow()  # at most one row a pair of the vocabulary's words
    keys, *counted = (found.column(c).to_numpy() for c in range(3))
    order = np.argsort(keys)
    counted = [(keys[some], n[some]) for n in counted for some in [order[n[order] > 0]]]
    return words, Model(len(words) + 3, *counted)


def score_texts(numbers: _Numbers, model: Model, texts: list[str]) -> list[float | None]:
    """The greatest score of each text's passages; null where there is none."""
    rows = numbers.rows(texts)
    parts = [_bigrams(r) for r in rows]
    out: list[float | None] = [None] * len(texts)
    has = [i for i, (a, _, _) in enumerate(parts) if len(a)]
    if not has:
        return out
    shift = np.cumsum([0, *(parts[i][2][-1] + 1 for i in has)])
    a, b = (np.concatenate([parts[i][k] for i in has]) for k in (0, 1))
    passage = np.concatenate([parts[i][2] + s for i, s in zip(has, shift)])
    score = model.scores(a, b, passage)
    n = [len(np.unique(parts[i][2])) for i in has]
    for i, s in zip(has, np.maximum.reduceat(score, np.cumsum(n) - n).tolist()):
        out[i] = s
    return out


def scores(documents: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(``keep``..., score) of every row: the greatest score of its passages; THRESHOLD and more is toxic."""
    spark = documents.sparkSession
    votes = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg((F.avg("toxic") > 0.5).alias("toxic"))
    known = documents.select("doc_id", "text").where(F.col("text").isNotNull() & (F.col("text") != ""))
    # labels go to the documents as long as they are few, so that no text is shuffled
    known = materialize(known.join(broadcast_if_small(votes), "doc_id").select("text", "toxic"), "labelled")
    shared = spark.sparkContext.broadcast(fit(known))
    discard(known)
    kinds = ", ".join(f"{c} {documents.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        numbers = _Numbers(fitted[0]) if fitted else None
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                texts = [t or "" for t in part.column(0).to_pylist()]
                out = score_texts(numbers, fitted[1], texts) if fitted else [None] * len(texts)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(out, pa.float64())], [*keep, "score"])

    return documents.select("text", *keep).mapInArrow(run, f"{kinds}, score double")


def toxic_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id) of the toxic documents."""
    return scores(documents, labels).where(F.col("score") >= THRESHOLD).select("doc_id")


def rates(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(source, n_documents, n_toxic, rate): every source, a null source as one of its own."""
    scored = scores(documents, labels, ("source",))
    toxic = F.coalesce((F.col("score") >= THRESHOLD).cast("int"), F.lit(0))
    return scored.groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.sum(toxic).alias("n_toxic"), F.avg(toxic).alias("rate"))
