"""Problem 4: long exact spans shared between records.

Seed and extend. Each text is reduced to winnowed anchors: of every ``min_chars - k + 1`` neighbouring k-grams
the one with the least hash (k two thirds of ``min_chars``), so two texts with a common span of ``min_chars``
characters have an anchor of it in common. Records join on anchors, matches are extended both ways from their
anchors, and maximal repeats of at least ``min_chars`` code points stay.

Nothing is capped. Copies of a whole text are reduced to one of them before any pairing. An anchor that more
than ``HOT`` texts have isn't paired; the texts join again on the ``min_chars``-grams around it, of which a long
enough span holds one, and where a group holds true pairs only.

Results for odd input: null texts and texts shorter than ``min_chars`` share nothing; a repeated key of equal
text is one record; spans are compared as stored, code point by code point; characters count as code points.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from copperleaf.session import discard, materialize

MIN_CHARS = 150
HOT = 64
CHUNK_CHARS = 1_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_NONE = np.uint64(2**64 - 1)
#: Combinations of anchor positions in a pair up to which matches are extended one by one.
MOST_SEEDS = 4_096


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Grams:
    """Hashes of the n-grams of a row of code points, for any n."""

    def __init__(self, points: np.ndarray):
        with np.errstate(over="ignore"):
            power = np.full(len(points) + 1, _BASE, np.uint64)
            power[0] = 1
            np.cumprod(power, out=power)
            self.sums = np.zeros(len(points) + 1, np.uint64)
            np.cumsum((points.astype(np.uint64) + np.uint64(1)) * power[:-1], out=self.sums[1:])
            back = np.full(len(points) + 1, _INVERSE, np.uint64)
            back[0] = 1
            self.back = np.cumprod(back, out=back)

    def hashes(self, n: int, at: np.ndarray | None = None) -> np.ndarray:
        """Of the n-grams at ``at``, or all of them."""
        with np.errstate(over="ignore"):
            if at is None:
                if len(self.sums) <= n:
                    return np.zeros(0, np.uint64)
                return _mix((self.sums[n:] - self.sums[:-n]) * self.back[: len(self.sums) - n])
            return _mix((self.sums[at + n] - self.sums[at]) * self.back[at])


def _sliding(a: np.ndarray, w: int, what: np.ufunc) -> np.ndarray:
    """``what`` over each w neighbours, by doubling."""
    have = 1
    while have * 2 <= w:
        a = what(a[:-have], a[have:])
        have *= 2
    return what(a[: len(a) - (w - have)], a[w - have :]) if have < w else a


def _gram(min_chars: int) -> int:
    return max(1, 2 * min_chars // 3)


def winnow(texts: list[str], min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the text, position, hash) of the anchors of all texts, each at least ``min_chars`` long."""
    k = _gram(min_chars)
    w = min_chars - k + 1
    parts = [_points(t) for t in texts]
    size = np.array([len(p) for p in parts])
    start = np.cumsum(size) - size
    h = Grams(np.concatenate(parts)).hashes(k)
    owner = np.repeat(np.arange(len(parts)), size)
    inside = np.arange(len(h)) + k <= (start + size)[owner[: len(h)]]  # the k-gram ends in its text
    h = np.minimum(h, _NONE - np.uint64(1))
    h[~inside] = _NONE
    least = _sliding(h, w, np.minimum)
    whole = np.arange(len(least)) + min_chars <= (start + size)[owner[: len(least)]]
    least[~whole] = 0
    pad = np.zeros(w - 1, np.uint64)
    chosen = np.flatnonzero((_sliding(np.concatenate([pad, least, pad]), w, np.maximum)[: len(h)] == h) & inside)
    return owner[chosen], chosen - start[owner[chosen]], h[chosen]


def _dense_spans(x: np.ndarray, y: np.ndarray, min_chars: int) -> list[tuple[int, int, int]]:
    """As ``_common_spans``, but instead of all maximal repeats so many that they cover the same characters of both texts."""
    gx, gy = Grams(x).hashes(min_chars), Grams(y).hashes(min_chars)
    found = []
    for one, other, p_text, q_text, swap in ((gx, gy, x, y, False), (gy, gx, y, x, True)):
        kinds, first = np.unique(other, return_index=True)  # the first place of each gram
        k = np.minimum(np.searchsorted(kinds, one), max(0, len(kinds) - 1))
        at = np.flatnonzero(kinds[k] == one) if len(kinds) else np.zeros(0, np.int64)
        place = first[k[at]]
        # neighbours on one diagonal are one span
        breaks = np.flatnonzero((np.diff(at) != 1) | (np.diff(place) != 1)) + 1
        for i, j in zip(np.concatenate([[0], breaks]).tolist(), np.concatenate([breaks, [len(at)]]).tolist()):
            if i < j:
                p, q, n = int(at[i]), int(place[i]), j - i - 1 + min_chars
                if np.array_equal(p_text[p : p + n], q_text[q : q + n]):
                    found.append((q, p, n) if swap else (p, q, n))
    return sorted(set(found))


def _common_spans(a: str, b: str, min_chars: int) -> list[tuple[int, int, int]]:
    """(start in a, start in b, length) of the maximal repeats of at least ``min_chars``."""
    x, y = _points(a), _points(b)
    owner, at, h = winnow([a, b], min_chars)
    places = defaultdict(lambda: ([], []))
    for o, p, v in zip(owner.tolist(), at.tolist(), h.tolist()):
        places[v][o].append(p)
    seeds = [(p, q) for ps, qs in places.values() if len(ps) * len(qs) <= MOST_SEEDS for p in ps for q in qs]
    dense = any(len(ps) * len(qs) > MOST_SEEDS for ps, qs in places.values())
    if dense or len(seeds) > 16 * MOST_SEEDS:  # long runs of one pattern: every character in an equal min_chars-gram, without a seed for each pair of places
        return _dense_spans(x, y, min_chars)
    found: list[tuple[int, int, int]] = []
    done: dict[int, int] = {}  # of a diagonal the end up to which it is known
    for p, q in sorted(seeds):
        if done.get(q - p, -1) > p:
            continue
        n = min(len(x) - p, len(y) - q)
        differ = np.flatnonzero(x[p : p + n] != y[q : q + n])
        right = int(differ[0]) if len(differ) else n
        n = min(p, q)
        differ = np.flatnonzero(x[p - n : p] != y[q - n : q])
        left = n - 1 - int(differ[-1]) if len(differ) else n
        done[q - p] = p + max(right, 1)
        if left + right >= min_chars:
            found.append((p - left, q - left, left + right))
    return found


def _anchor_rows(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, start, chars = [], 0, 0
            column = batch.column(2)
            for i in range(len(column)):
                texts.append(column[i].as_py())
                chars += len(texts[-1])
                if chars > CHUNK_CHARS or i == len(column) - 1:
                    owner, _, h = winnow(texts, min_chars)
                    both = np.unique(np.stack([owner.astype(np.uint64), h]), axis=1) if len(h) else np.zeros((2, 0), np.uint64)
                    at = pa.array(both[0].astype(np.int64) + start)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(at), batch.column(1).take(at), pa.array(both[1].view(np.int64))], ["f", "key", "h"]
                    )
                    texts, start, chars = [], i + 1, 0

    return run


def _finer_rows(min_chars: int):
    """Of texts with a list of hot hashes: the min_chars-grams around those anchors."""
    k = _gram(min_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f, key, h = [], [], []
            for row in batch.to_pylist():
                hot = np.array(sorted(set(row["hot"])), np.int64).view(np.uint64)
                _, at, v = winnow([row["value"]], min_chars)
                at = np.unique((at[np.isin(v, hot)][:, None] - np.arange(min_chars - k + 1)).ravel())
                at = at[(at >= 0) & (at + min_chars <= len(row["value"]))]
                out = np.unique(Grams(_points(row["value"])).hashes(min_chars, at)).view(np.int64)
                f += [row["f"]] * len(out)
                key += [row["key"]] * len(out)
                h.append(out)
            yield pa.RecordBatch.from_arrays(
                [pa.array(f, pa.int32()), pa.array(key, pa.int64()), pa.array(np.concatenate(h) if h else np.zeros(0, np.int64))], ["f", "key", "h"]
            )

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        d = [hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(d, pa.binary())], ["f", "key", "value", "digest"])


def _verify(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                for p, q, n in _common_spans(row["value_a"], row["value_b"], min_chars):
                    out.append((row["f"], row["key_a"], row["key_b"], p, q, n))
            kinds = [pa.int32(), *[pa.int64()] * 5]
            columns = list(zip(*out)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["f", "a", "b", "start_a", "start_b", "n"])

    return run


def _pairs(groups: DataFrame) -> DataFrame:
    a, b = groups.alias("a"), groups.alias("b")
    same = (F.col("a.f") == F.col("b.f")) & (F.col("a.h") == F.col("b.h")) & (F.col("a.key") < F.col("b.key"))
    return a.join(b, same).select(F.col("a.f").alias("f"), F.col("a.key").alias("key_a"), F.col("b.key").alias("key_b"))


def _shared(rows: DataFrame) -> DataFrame:
    """The rows whose hash more than one key has, with the number of keys."""
    counts = rows.groupBy("f", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows.join(counts, ["f", "h"])


def shared_spans(records: DataFrame, min_chars: int = MIN_CHARS, *, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """``records(f int, key long, value string)`` to (spans, copies).

    spans(f, a, b, start_a, start_b, n): the maximal repeats of pairs of different texts, a and b being the least
    keys of their texts, a < b; of texts with long runs of one pattern, repeats that cover the same characters. copies(f, key, rep): of each record that shares an anchor, the least key with the
    same text.
    """
    anchor = "f int, key long, h long"
    long = records.select(F.col("f").cast("int").alias("f"), F.col("key").cast("long").alias("key"), "value").where(
        F.char_length("value") >= min_chars
    )
    anchors = materialize(long.mapInArrow(_anchor_rows(min_chars), anchor), "anchors")
    rows = materialize(_shared(anchors).select("f", "key", "h").distinct(), "shared")
    discard(anchors)
    involved = long.join(rows.select("f", "key").distinct(), ["f", "key"], "left_semi")
    involved = materialize(involved.mapInArrow(_digests, "f int, key long, value string, digest binary"), "involved")
    reps = involved.groupBy("f", "digest").agg(F.min("key").alias("rep"))
    copies = involved.select("f", "key", "digest").join(reps, ["f", "digest"]).select("f", "key", "rep").distinct()
    copies = materialize(copies, "copies")
    texts = involved.join(copies.where("key = rep").select("f", "key").distinct(), ["f", "key"], "left_semi").select("f", "key", "value")
    texts = materialize(texts.dropDuplicates(["f", "key"]), "texts")
    rows = rows.join(copies.where("key = rep").select("f", "key").distinct(), ["f", "key"], "left_semi")
    groups = materialize(_shared(rows), "groups")
    pairs = _pairs(groups.where(F.col("n") <= hot))
    warm = groups.where(F.col("n") > hot)
    if not warm.isEmpty():
        lists = warm.groupBy("f", "key").agg(F.collect_set("h").alias("hot"))  # at most as many as the text has characters
        finer = texts.join(lists, ["f", "key"]).mapInArrow(_finer_rows(min_chars), anchor)
        pairs = pairs.unionByName(_pairs(materialize(_shared(finer), "finer")))
    pairs = pairs.distinct()
    a = texts.select("f", F.col("key").alias("key_a"), F.col("value").alias("value_a"))
    b = texts.select("f", F.col("key").alias("key_b"), F.col("value").alias("value_b"))
    both = pairs.join(a, ["f", "key_a"]).join(b, ["f", "key_b"])
    spans = both.mapInArrow(_verify(min_chars), "f int, a long, b long, start_a long, start_b long, n long")
    return materialize(spans, "spans"), copies


def sharing_pairs(records: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(f, key_a, key_b), key_a < key_b: records with a common span; copies are expanded, as the result is pairs of records."""
    spans, copies = shared_spans(records, min_chars)
    reps = spans.select("f", "a", "b").distinct()
    left, right = copies.toDF("f", "x", "a"), copies.toDF("f", "y", "b")
    different = reps.join(left, ["f", "a"]).join(right, ["f", "b"])
    equal = copies.toDF("f", "x", "a").join(copies.toDF("f", "y", "a"), ["f", "a"]).where("x < y").select("f", "x", "y")
    return different.select("f", "x", "y").unionByName(equal).select("f", F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b"))


def shared_share(records: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(f, key, n_chars, shared_chars, shared_share) of every record, null texts as 0 characters.

    A character counts once, however many records share it; the text of a record with a copy is shared whole.
    """
    spans, copies = shared_spans(records, min_chars)
    ends = spans.select("f", F.col("a").alias("rep"), F.col("start_a").alias("s"), (F.col("start_a") + F.col("n")).alias("e")).unionByName(
        spans.select("f", F.col("b").alias("rep"), F.col("start_b").alias("s"), (F.col("start_b") + F.col("n")).alias("e"))
    )
    ends = ends.groupBy("f", "rep", "s").agg(F.max("e").alias("e"))  # at most one row a character of the text
    before = Window.partitionBy("f", "rep").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    known = F.coalesce(F.max("e").over(before), F.lit(0))
    covered = ends.withColumn("new", F.greatest(F.col("e") - F.greatest("s", known), F.lit(0))).groupBy("f", "rep").agg(F.sum("new").alias("covered"))
    several = copies.groupBy("f", "rep").agg(F.count(F.lit(1)).alias("n_copies"))
    each = copies.join(several, ["f", "rep"]).join(covered, ["f", "rep"], "left").select("f", "key", "n_copies", "covered")
    n = F.coalesce(F.char_length("value"), F.lit(0)).cast("long")
    base = records.select(F.col("f").cast("int").alias("f"), F.col("key").cast("long").alias("key"), n.alias("n_chars")).distinct()
    shared = F.when(F.col("n_copies") > 1, F.col("n_chars")).otherwise(F.coalesce("covered", F.lit(0))).cast("long")
    return base.join(each, ["f", "key"], "left").select(
        "f", "key", "n_chars", shared.alias("shared_chars"), F.coalesce(F.try_divide(shared, F.col("n_chars")), F.lit(0.0)).alias("shared_share")
    )
