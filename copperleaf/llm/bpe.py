"""Problem 6: encoding a corpus with a public byte-level BPE vocabulary.

Speculate and verify. Texts are cut into words by the vocabulary's pattern; each distinct word is proposed a
greedy longest-match segmentation; every adjacent pair of all proposals is checked at once, with arrays, for
compatibility (a sequence is what the merges give exactly if each adjacent pair is); only words with a pair
that fails go through the merges one by one.

The vocabulary is read on the driver and broadcast: its size is that of the vocabulary, whatever the data.
Results for odd input: null and empty texts have the ids given as ``empty`` (none by default); strings that
look like special tokens are ordinary text; texts of any length are taken whole.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIRECTORY = "/opt/tokenizers"
#: Texts are worked on in pieces of about so many characters, words are remembered up to so many.
CHUNK_CHARS = 1_000_000
MOST_WORDS = 200_000


def _byte_letters() -> dict[str, int]:
    """The published one-letter names of bytes in vocabulary files: printable Latin-1 as itself, others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def read_vocabulary(path: str) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Tokens by id and, for each, the two ids it was merged from (itself twice for a single byte).

    Takes a ``.json`` file with merges or a ``.tiktoken`` file of ranks. Ids must be in the order of the merges.
    """
    if path.endswith(".json"):
        model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
        letters = _byte_letters()
        decode = lambda name: bytes(letters[c] for c in name)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        ids = model["vocab"]
        tokens = [b""] * (1 + max(ids[a + b] for a, b in merges))
        for name, i in ids.items():
            if i < len(tokens):
                tokens[i] = decode(name)
        left, right = np.arange(len(tokens)), np.arange(len(tokens))
        for a, b in merges:
            left[ids[a + b]], right[ids[a + b]] = ids[a], ids[b]
    else:
        rows = [line.split() for line in Path(path).read_bytes().splitlines() if line]
        ranks = {base64.b64decode(a): int(b) for a, b in rows}
        tokens = sorted(ranks, key=ranks.get)
        left, right = np.arange(len(tokens)), np.arange(len(tokens))
        for i, token in enumerate(tokens):
            if len(token) > 1:
                parts = [token[j : j + 1] for j in range(len(token))]
                while len(parts) > 2:  # the merges before this token's own
                    at = min(range(len(parts) - 1), key=lambda j: ranks.get(parts[j] + parts[j + 1], 2**31))
                    parts[at : at + 2] = [parts[at] + parts[at + 1]]
                left[i], right[i] = ranks[parts[0]], ranks[parts[1]]
    assert all(max(left[i], right[i]) < i or left[i] == i for i in range(len(tokens))), "ids aren't in the order of the merges"
    return tokens, left, right


def _ranges(codes: list[int]) -> str:
    out, start = [], None
    for c, after in zip(codes, [*codes[1:], None]):
        start = c if start is None else start
        if after != c + 1:
            out.append(re.escape(chr(start)) + (f"-{re.escape(chr(c))}" if c > start else ""))
            start = None
    return "".join(out)


def word_pattern() -> tuple[re.Pattern, str]:
    """The vocabulary's pattern for texts within U+FFFF, for the standard library's faster matcher, and as published."""
    codes = [c for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    letters = _ranges([c for c in codes if unicodedata.category(chr(c))[0] == "L"])
    digits = _ranges([c for c in codes if unicodedata.category(chr(c))[0] == "N"])
    spaces = _ranges([c for c in codes if chr(c).isspace() and not 0x1C <= c <= 0x1F])
    low = rf"'(?:[sdmt]|ll|ve|re)| ?[{letters}]+| ?[{digits}]+| ?[^{spaces}{letters}{digits}]+|[{spaces}]+(?![^{spaces}])|[{spaces}]+"
    published = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return re.compile(low), published


class Encoder:
    """Encodes words; remembers them in arrays."""

    def __init__(self, tokens: list[bytes], left: np.ndarray, right: np.ndarray):
        self.tokens, self.left, self.right = tokens, left.astype(np.int64), right.astype(np.int64)
        self.id = {t: i for i, t in enumerate(tokens) if t}
        self.reach: dict[bytes, int] = {}  # the longest token that starts with three bytes
        for t in tokens:
            if len(t) > 2:
                self.reach[t[:3]] = max(len(t), self.reach.get(t[:3], 0))
        self.byte_id = np.array([self.id[bytes([b])] for b in range(256)])
        merged = np.flatnonzero(self.left != np.arange(len(tokens)))
        keys = self.left[merged] * len(tokens) + self.right[merged]
        order = np.argsort(keys)
        # the merge of a pair, by its key; a last key that no pair has
        self.keys, self.merged = np.append(keys[order], 2**62), np.append(merged[order], 2**31)
        self.pairs: dict[int, bool] = {}
        self.pattern, self.published = word_pattern()
        self.high = re.compile("[\U00010000-\U0010ffff]")
        self._full = None
        self.failed = 0
        self.forget()

    def forget(self) -> None:
        self.words: dict[str, int] = {}
        self.start, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def split(self, text: str) -> list[str]:
        if self.high.search(text):
            if self._full is None:
                import regex

                self._full = regex.compile(self.published)
            return self._full.findall(text)
        return self.pattern.findall(text)

    def greedy(self, word: bytes) -> list[int]:
        if (whole := self.id.get(word)) is not None:
            return [whole]
        out, at, n, known, reach = [], 0, len(word), self.id, self.reach
        while at < n:
            for end in range(min(n, at + reach.get(word[at : at + 3], 2)), at, -1):
                if (t := known.get(word[at:end])) is not None:
                    break
            out.append(t)
            at = end
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the merges leave each pair of tokens as it is.

        Goes back in time at the border of a pair: a merge across the border must not come before the merge that
        formed either side. The side formed last is taken apart until both are single bytes.
        """
        good = np.ones(len(a), bool)
        at, a, b = np.arange(len(a)), a.astype(np.int64), b.astype(np.int64)
        before = np.full(len(a), 2**31, np.int64)
        while len(at):
            wrong = self.pair_merge(a, b) < before
            good[at[wrong]] = False
            last = np.where(a > b, a, b)
            go = ~wrong & (self.left[last] != last)
            at, a, b = at[go], a[go], b[go]
            first = a > b
            # of equal merges the left one comes first
            before = np.where(first, a, b + 1)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return good

    def merge(self, word: bytes) -> list[int]:
        """The merges one by one, lowest first, leftmost first among equals."""
        ids = [self.id[word[i : i + 1]] for i in range(len(word))]
        n, tokens, known = len(ids), self.tokens, self.id
        after, prior = list(range(1, n + 1)), list(range(-1, n - 1))

        def at(i: int) -> int | None:
            return known.get(tokens[ids[i]] + tokens[ids[after[i]]]) if after[i] < n else None

        heap = [(t, i, ids[i], ids[i + 1]) for i in range(n - 1) if (t := at(i)) is not None]
        heapq.heapify(heap)
        while heap:
            t, i, x, y = heapq.heappop(heap)
            j = after[i]
            if ids[i] != x or j >= n or ids[j] != y:
                continue
            ids[i], ids[j] = t, -1
            after[i] = after[j]
            if after[i] < n:
                prior[after[i]] = i
            for k in (i, prior[i]):
                if k >= 0 and (m := at(k)) is not None:
                    heapq.heappush(heap, (m, k, ids[k], ids[after[k]]))
        return [t for t in ids if t >= 0]

    def pair_merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token that each pair merges to, 2**31 for none."""
        key = a * len(self.tokens) + b
        k = np.searchsorted(self.keys, key)
        return np.where(self.keys[k] == key, self.merged[k], 2**31)

    def merge_together(self, words: list[bytes]) -> list[list[int]]:
        """As ``merge``, for words of much the same length at once: a row for each word, a merge of each row a round."""
        n, width = len(words), max(map(len, words))
        size = np.fromiter(map(len, words), np.int64, n)
        raw = np.frombuffer(b"".join(w.ljust(width + 1, b"\0") for w in words), np.uint8).reshape(n, width + 1)
        ids = self.byte_id[raw].astype(np.int64)
        ids[np.arange(width + 1) >= size[:, None]] = -1
        best = np.full((n, width + 1), 2**31, np.int64)  # of each token with the next
        best[:, :-1] = self.pair_merge(ids[:, :-1], ids[:, 1:])
        best[:, :-1][ids[:, 1:] < 0] = 2**31
        out: list[list[int]] = [[]] * n
        rows = np.arange(n)
        while len(rows):
            at = best.argmin(axis=1)
            each = np.arange(len(rows))
            to = best[each, at]
            done = to == 2**31
            for i in np.flatnonzero(done).tolist():
                out[rows[i]] = ids[i, : size[i]].tolist()
            if done.any():
                go = ~done
                rows, ids, best, size, at, to = rows[go], ids[go], best[go], size[go], at[go], to[go]
                each = np.arange(len(rows))
                if not len(rows):
                    break
            tail = np.arange(width) > at[:, None]  # moves one to the left
            ids[:, :-1] = np.where(tail, ids[:, 1:], ids[:, :-1])
            best[:, :-1] = np.where(tail, best[:, 1:], best[:, :-1])
            ids[each, at] = to
            size = size - 1
            ids[each, size] = -1
            best[each, size] = 2**31
            for k in (at, at - 1):
                ok = np.flatnonzero((k >= 0) & (k + 1 < size))
                best[ok, k[ok]] = self.pair_merge(ids[ok, k[ok]], ids[ok, k[ok] + 1])
            last = np.flatnonzero(at == size - 1)
            best[last, at[last]] = 2**31
            width = int(size.max())
            ids, best = ids[:, : width + 1], best[:, : width + 1]
        return out

    def exact(self, words: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        for start in range(0, len(order), 4096):
            some = order[start : start + 4096]
            short = [i for i in some if len(words[i]) <= 48]
            for i, ids in zip(short, self.merge_together([words[i] for i in short]) if short else []):
                out[i] = ids
            for i in some[len(short) :]:
                out[i] = self.merge(words[i])
        return out

    def learn(self, words: list[str]) -> None:
        """Adds distinct new words."""
        raw = [w.encode("utf-8", "replace") for w in words]
        found = [self.greedy(w) for w in raw]
        size = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.int64, int(size.sum()))
        owner = np.repeat(np.arange(len(found)), size)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        keys = flat[inner] * len(self.tokens) + flat[inner + 1]
        distinct, back = np.unique(keys, return_inverse=True)
        new = np.array([k for k in distinct.tolist() if k not in self.pairs], np.int64)
        if len(new):
            if len(self.pairs) > 20 * MOST_WORDS:
                self.pairs.clear()
                new = distinct
            self.pairs.update(zip(new.tolist(), self.compatible(new // len(self.tokens), new % len(self.tokens)).tolist()))
        good = np.fromiter(map(self.pairs.__getitem__, distinct.tolist()), bool, len(distinct))
        wrong = np.unique(owner[inner[~good[back]]]) if len(inner) else []
        if len(wrong):
            self.failed += len(wrong)
            wrong = wrong.tolist()
            for i, ids in zip(wrong, self.exact([raw[i] for i in wrong])):
                found[i] = ids
            size = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.fromiter(chain.from_iterable(found), np.int64, int(size.sum()))
        self.words.update(zip(words, range(len(self.size), len(self.size) + len(words))))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
        self.size, self.flat = np.concatenate([self.size, size]), np.concatenate([self.flat, flat.astype(np.int32)])

    def sizes_and_ids(self, texts: list[str], ids: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
        """Of each text the number of ids, and the ids of all texts in a row."""
        if len(self.words) > MOST_WORDS:
            self.forget()
        words = [self.split(t) for t in texts]
        known = self.words
        new = [w for w in set(chain.from_iterable(words)) if w not in known]
        if new:
            self.learn(sorted(new))
        n = [len(w) for w in words]
        index = np.fromiter(map(self.words.__getitem__, chain.from_iterable(words)), np.int64, sum(n))
        size = self.size[index]
        ends = np.cumsum(np.concatenate([[0], size]))
        borders = np.cumsum([0, *n])
        counts = ends[borders[1:]] - ends[borders[:-1]]
        if not ids:
            return counts, None
        return counts, self.flat[np.repeat(self.start[index] - ends[:-1], size) + np.arange(ends[-1])]


_ENCODERS: dict[str, Encoder] = {}


def _encoder(name: str, vocabulary) -> Encoder:
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(*vocabulary.value)
    return _ENCODERS[name]


def _chunks(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """Pieces of about CHUNK_CHARS characters, with the row at which each starts."""
    some, start, chars = [], 0, 0
    for i, x in enumerate(texts):
        some.append(x.as_py())
        chars += len(some[-1] or "")
        if chars > CHUNK_CHARS:
            yield start, some
            some, start, chars = [], i + 1, 0
    if some:
        yield start, some


def encode(df: DataFrame, key: str, text: str, *, vocabulary: str = f"{DIRECTORY}/byte_bpe_50k.json", empty: tuple[int, ...] = (), ids: bool = True) -> DataFrame:
    """(key, ids) of every row, or (key, n_tokens) with ``ids=False``. Other columns don't come out.

    ``empty`` are the ids of null and empty texts.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary, shared)
        for batch in batches:
            for start, texts in _chunks(batch.column(1)):
                keys = batch.column(0).slice(start, len(texts))
                counts, flat = encoder.sizes_and_ids([t or "" for t in texts], ids)
                if empty:
                    blank = np.array([not t for t in texts])
                    if ids:
                        at = np.cumsum(counts)[blank]
                        flat = np.insert(flat, np.repeat(at, len(empty)), np.tile(np.array(empty, np.int32), int(blank.sum())))
                    counts = counts + blank * len(empty)
                if ids:
                    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(offsets, pa.array(flat.astype(np.int32)))], [key, "ids"])
                else:
                    yield pa.RecordBatch.from_arrays([keys, pa.array(counts.astype(np.int32))], [key, "n_tokens"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(f"`{key}`"), F.col(f"`{text}`"))
    return rows.mapInArrow(run, f"`{key}` {kind}, " + ("ids array<int>" if ids else "n_tokens int"))
