"""Problem 3: text cut off by field limits or in transfer.

Rows that show no limit are taken as intact; each is also cut at a random place, which gives positives. A hashed
logistic regression learns from closing characters, punctuation and structure left open, from whether the length
lies at a limit of its source, and from whether the decoded ids go on after the text. Every record is scored.

A limit of a source is its greatest length, in characters, bytes or tokens, where rows pile up: statistics over
all rows. The fit uses a documented, bounded sample (``MOST_FITTED`` rows by hash of the key). The share of cut
rows differs from that of the fit, so probabilities are adjusted to the share that the scores of all rows imply.

Results for odd input: null texts have no score; an empty text is intact unless ids go on after it; null ids say
nothing; repeated keys count once, with their highest score; a null source is one of its own.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from copperleaf.session import materialize

MOST_FITTED = 8_000
FEATURES = 2**14
#: Above so many pieces the ids are decoded by a join instead of a broadcast table; both ways give the same.
MOST_PIECES = 500_000
#: A limit: so many rows at the greatest length, so many times what the lengths just below have.
CLEANINGS, CLEAN = 2, 0.0
LEAST = 30
PILE, TIMES = 3, 4.0
MEASURES = ("chars", "bytes", "tokens")
SLACK = {"chars": 0, "bytes": 3, "tokens": 0}  # a cut character takes up to three bytes with it

_PART = re.compile(r"\w+|[^\w\s]|\s+")


# Marks that a shortened text ends with.
_SHORTENED = re.compile(r"\w(?:\.\.\.|…|\[\.\.\.\])$")


def _shape(part: str) -> str:
    """A word as its kind and length class, with its text where it is short and plain; a sign as it is."""
    if part.isspace():
        return "\\n" if "\n" in part else "_"
    if part[0].isalpha() or part[0] == "_":
        kind = "W" if part[0].isupper() else "w"
        if not part.isascii():
            return f"u{kind}"
        return f"{kind}{min(len(part), 6)}" + ("_" if "_" in part else "") + ("m" if part[1:].lower() != part[1:] else "")
    return "9" if part[0].isdigit() else part


def features(text: str) -> list[str]:
    """Names of what the end of a text shows."""
    parts = _PART.findall(text[-400:])
    shapes = [_shape(p) for p in parts[-8:]]
    pad = ["^"] * (8 - len(shapes)) + shapes
    line = text.rsplit("\n", 1)[-1]
    first = re.match(r"\s*(\w+|\S?)", line)[1]
    code = line[:1].isspace()
    fenced = text.count("```") % 2
    out = [f"1:{pad[-1]}", f"2:{'|'.join(pad[-2:])}", f"3:{'|'.join(pad[-3:])}", f"4:{'|'.join(pad[-4:])}", f"6:{'|'.join(pad[-6:])}"]
    out += [f"end:{text[-1:]}", f"fence:{fenced}", f"fence-end:{fenced}{text[-3:] == '```'}", f"line:{code}{fenced}:{first if len(first) > 1 else _shape(first) if first else ''}"]
    out += [f"line-end:{code}:{pad[-1]}", f"kind:{line[:3] == '```'}:{text[-1:]}"]
    depth = 0
    for c in line:
        depth += (c in "([{") - (c in ")]}")
    out.append(f"open:{max(-1, min(depth, 2))}:{code}")
    out.append(f"quotes:{line.count(chr(34)) % 2}{line.count(chr(39)) % 2}:{code}")
    out.append(f"code-line:{code}{fenced}:{'=' in line}:{first in ('return', 'print')}:{pad[-1]}")
    out.append(f"prose:{not code}:{text[-1:] in '.!?。'}:{fenced}")
    closing = "a" if text[-1:].isalpha() else "9" if text[-1:].isdigit() else text[-1:]
    out.append(f"closing:{code}:{fenced}:{closing}:{first.lower() if closing == '9' and not code else ''}")
    out.append(f"ellipsis:{_SHORTENED.search(text[-8:]) is not None}")
    out.append("damaged" if text[-2:].find("�") >= 0 else "whole")
    return out


WIDTH = 28  #: features of a row: those of the text and the flags, filled up


def _hashed(names: list[str]) -> list[int]:
    return [zlib.crc32(n.encode("utf-8", "replace")) % (FEATURES - 1) + 1 for n in names]


def _row(hashed: list[int], flags: list[str]) -> list[int]:
    """Numbers of the features of a text, hashed, and of the flags."""
    row = [*hashed, *_hashed(flags)][:WIDTH]
    return row + [0] * (WIDTH - len(row))


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, whole, cut) of texts and their hashes: features of each and of it cut at a place that the hash decides on; texts stay in the task."""
    for batch in batches:
        rows = []
        for text, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rng, cut = np.random.default_rng(h & (2**63 - 1)), None
            if len(text) > 20:
                cut = text[: int(rng.integers(len(text) // 10 + 1, len(text)))]
                if rng.random() < 0.15:
                    cut = cut.rstrip() + ("..." if rng.random() < 0.7 else "…")
            rows.append((h, _hashed(features(text)), None if cut is None else _hashed(features(cut))))
        kinds = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        columns = list(zip(*rows)) if rows else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], ["h", "whole", "cut"])


def _flags(at: tuple[bool, ...], after: bool | None) -> list[str]:
    return [f"at:{m}" for m, x in zip(MEASURES, at) if x] + (["at:none"] if not any(at) else []) + [f"after:{after}"]


def fit(examples: list[tuple[list[int], list[int] | None]], limits: list[str], known: float, *, seed: int = 3, rounds: int = 400) -> np.ndarray:
    """Weights, from the features of intact texts whole and cut, the measures that have limits, and the share of rows whose ids are known."""
    rng = np.random.default_rng(seed)
    rows, target = [], []
    for whole, cut in examples:
        after = False if rng.random() < known else None
        rows.append(_row(whole, _flags((False,) * 3, after)))
        target.append(0.0)
        if cut is not None:
            at = [False] * 3
            if limits and rng.random() < 0.5:
                at[MEASURES.index(limits[int(rng.integers(len(limits)))])] = True
            rows.append(_row(cut, _flags(tuple(at), None if after is None else bool(rng.random() < 0.75))))
            target.append(1.0)
    x, y = np.array(rows), np.array(target)
    x[np.bincount(x.ravel(), minlength=FEATURES)[x] < LEAST] = 0  # what few rows have would only be learnt by heart
    w, g2 = np.zeros(FEATURES), np.full(FEATURES, 1e-8)
    n = len(y)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(w[x].sum(axis=1), -30, 30)))
        grad = np.bincount(x.ravel(), np.repeat((p - y) / n, x.shape[1]), minlength=FEATURES) + 1e-5 * w
        grad[0] = 0
        g2 += grad * grad
        w -= grad / np.sqrt(g2)
    return w


def _share(histogram: np.ndarray, centers: np.ndarray) -> float:
    """The share of positives that the scores imply, the fit having had half; expectation and maximisation."""
    share, p = 0.5, 1 / (1 + np.exp(-centers))
    for _ in range(200):
        odds = (share / (1 - share)) * p / np.maximum(1 - p, 1e-12)
        share = float(np.clip((histogram * odds / (1 + odds)).sum() / max(histogram.sum(), 1), 1e-4, 0.9))
    return share


def limits(rows: DataFrame, source: list[str]) -> DataFrame:
    """(source..., measure, limit) where rows pile up at a length that few exceed; ``rows`` has a column per measure.

    Of several such lengths the greatest counts. Complete values that are longer don't hide it, as long as they are
    at most a quarter as many.
    """
    long = rows.select(*source, F.explode(F.create_map(*[c for m in MEASURES for c in (F.lit(m), F.col(m).cast("long"))])).alias("measure", "value"))
    counts = long.where("value > 0").groupBy(*source, "measure", "value").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select(*[F.col(c).alias(f"s{i}") for i, c in enumerate(source)], "measure", "value", "n")
    keys = [f"s{i}" for i in range(len(source))]
    longer = Window.partitionBy(*keys, "measure").orderBy(F.col("value").desc())  # a row a length, not a row of the table
    top = counts.withColumn("above", F.coalesce(F.sum("n").over(longer.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    top = top.where((F.col("above") == 0) | ((F.col("n") >= 2 * PILE) & (F.col("above") * 4 <= F.col("n")))).withColumnRenamed("value", "limit").drop("n", "above")
    a, b = counts.alias("a"), top.alias("b")
    on = F.col("a.measure") == F.col("b.measure")
    for k in keys:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    slack = F.when(F.col("b.measure") == "bytes", SLACK["bytes"]).otherwise(0)
    here = F.col("a.value").between(F.col("b.limit") - slack, F.col("b.limit"))
    near = (F.col("a.value") < F.col("b.limit") - slack) & (F.col("a.value") >= F.col("b.limit") * 0.8)
    both = a.join(b, on).groupBy(*[F.col(f"b.{k}") for k in keys], F.col("b.measure"), F.col("b.limit")).agg(
        F.sum(F.when(here, F.col("a.n")).otherwise(0)).alias("at"), F.sum(F.when(near, F.col("a.n")).otherwise(0)).alias("near")
    )
    usual = F.col("near") / (F.col("limit") * 0.2) * F.when(F.col("measure") == "bytes", SLACK["bytes"] + 1).otherwise(1)
    piles = both.where((F.col("at") >= PILE) & (F.col("at") >= TIMES * usual)).groupBy(*keys, "measure").agg(F.max("limit").alias("limit"))
    return piles.select(*[F.col(k).alias(c) for k, c in zip(keys, source)], "measure", "limit")


def _decoded(rows: DataFrame, ids: str, pieces: DataFrame) -> DataFrame:
    """Adds ``__decoded``; null where ids are null or have an unknown piece. The way for vocabularies of any size."""
    numbered = rows.withColumn("__n", F.monotonically_increasing_id())
    numbered = materialize(numbered, "numbered")
    each = numbered.select("__n", F.posexplode(ids).alias("__i", "token_id")).join(pieces.groupBy("token_id").agg(F.max("piece").alias("piece")), "token_id", "left")
    whole = each.groupBy("__n").agg(
        F.when(F.count("piece") == F.count(F.lit(1)), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__i", "piece"))), lambda x: x["piece"]), "")).alias("__decoded")
    )
    out = numbered.join(whole, "__n", "left").drop("__n")
    return out.withColumn("__decoded", F.when(F.size(F.col(ids)) == 0, "").otherwise(F.col("__decoded")))  # no ids are an empty text


def scores(rows: DataFrame, key: list[str], source: list[str], text: str, ids: str, pieces: DataFrame) -> DataFrame:
    """(key..., probability) for each key with a text: how likely its text was cut off."""
    spark = rows.sparkSession
    t = F.col(f"`{text}`")
    base = rows.select(
        *dict.fromkeys([*key, *source]), t.alias("__text"), F.col(f"`{ids}`").alias("__ids"), F.char_length(t).alias("chars"),
        F.octet_length(t).alias("bytes"), F.when(F.col(f"`{ids}`").isNotNull(), F.size(F.col(f"`{ids}`"))).alias("tokens"),
    ).where(t.isNotNull())
    found = limits(base, source)
    wide = found.groupBy(*source).agg(*[F.max(F.when(F.col("measure") == m, F.col("limit"))).alias(f"__{m}") for m in MEASURES])
    wide = wide.select(*[F.col(c).alias(f"__s{i}") for i, c in enumerate(source)], *[f"__{m}" for m in MEASURES])
    on = F.lit(True)
    for i, c in enumerate(source):
        on = on & F.col(c).eqNullSafe(F.col(f"__s{i}"))
    marked = base.join(wide, on, "left")
    at = [F.coalesce(F.col(m).between(F.col(f"__{m}") - SLACK[m], F.col(f"__{m}")), F.lit(False)).alias(f"at_{m}") for m in MEASURES]
    small = pieces.where(F.col("token_id").isNotNull() & F.col("piece").isNotNull()).select("token_id", "piece")
    table = None
    if small.limit(MOST_PIECES + 1).count() <= MOST_PIECES:
        table = spark.sparkContext.broadcast(dict(map(tuple, small.groupBy("token_id").agg(F.max("piece")).collect())))
        marked = marked.withColumn("__decoded", F.lit(None).cast("string"))
    else:
        marked = _decoded(marked, "__ids", small).withColumn("__ids", F.lit(None).cast("array<bigint>"))
    h = F.when(F.col("__text") != "", F.xxhash64("__text"))
    marked = marked.select(*key, "__text", "__ids", "__decoded", h.alias("h"), *at)

    def after(text: str, ids: list[int] | None, decoded: str | None) -> bool | None:
        if table is not None and ids is not None:
            decoded = "".join(table.value.get(i, "\0") for i in ids)
        if decoded is None or "\0" in decoded:
            return None
        return len(decoded.rstrip()) > len(text.rstrip("�").rstrip()) and decoded.startswith(text.rstrip("�"))

    n = len(key)

    def open_ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(n).to_pylist()
            flags = [after(*x) for x in zip(texts, *(batch.column(n + i).to_pylist() for i in (1, 2)))]
            found = pa.array([_hashed(features(t)) for t in texts], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], found, *batch.columns[n + 3 :], pa.array(flags, pa.bool_())], [*key, "features", "h", *[f"at_{m}" for m in MEASURES], "after"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*key).schema)
    ready = materialize(marked.mapInArrow(open_ended, f"{kinds}, features array<int>, h long, " + ", ".join(f"at_{m} boolean" for m in MEASURES) + ", after boolean"), "ends")
    limited = F.col("at_chars") | F.col("at_bytes") | F.col("at_tokens") | F.coalesce("after", F.lit(False))
    picked = ready.where(~limited & F.col("h").isNotNull()).groupBy("h").agg(F.max(F.col("after").isNotNull().cast("int")).alias("known"))
    picked = picked.orderBy("h").limit(MOST_FITTED).collect()  # different texts by hash, without the texts
    if not picked:
        return ready.groupBy(*key).agg(F.lit(0.0).alias("probability"))
    measures = sorted(r[0] for r in found.select("measure").distinct().collect())
    chosen, known = spark.createDataFrame([(r[0],) for r in picked], "h long"), sum(r[1] for r in picked) / len(picked)
    texts = base.select("__text", F.xxhash64("__text").alias("h")).where((F.col("__text") != "") & (F.col("h") <= picked[-1][0]))
    texts = texts.join(F.broadcast(chosen), "h").groupBy("h").agg(F.min("__text").alias("__text")).select("__text", "h")  # at most MOST_FITTED rows
    rows_ = texts.mapInArrow(_examples, "h long, whole array<int>, cut array<int>").collect()
    examples = [(r[1], r[2]) for r in sorted(rows_, key=lambda r: r[0])]
    fitted = fit(examples, measures, known)
    for _ in range(CLEANINGS):  # rows cut in transfer show no limit: those that stand out aren't intact
        score = np.array([fitted[_row(whole, _flags((False,) * 3, None))].sum() for whole, _ in examples])
        examples = [e for e, s in zip(examples, score) if s < CLEAN] or examples
        fitted = fit(examples, measures, known)
    weights = spark.sparkContext.broadcast(fitted)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [_row(t, _flags(f[:3], f[3])) for t, *f in zip(*(batch.column(n + i).to_pylist() for i in (0, 2, 3, 4, 5)))]
            s = weights.value[np.array(x)].sum(axis=1) if x else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(s)], [*key, "score"])

    scored = materialize(ready.mapInArrow(score, f"{kinds}, score double").groupBy(*key).agg(F.max("score").alias("score")), "scored")
    bins = scored.groupBy(F.least(F.greatest(F.floor(F.col("score") * 4), F.lit(-80)), F.lit(80)).cast("int").alias("bin")).count().collect()  # at most 161 rows
    share = _share(np.array([r[1] for r in bins], float), (np.array([r[0] for r in bins]) + 0.5) / 4)
    shift = float(np.log(share / (1 - share)))
    return scored.select(*key, (1 / (1 + F.exp(-(F.col("score") + shift)))).alias("probability"))


KEY = ["model", "quant", "item_id", "sample_id"]


def cut_generations(generations: DataFrame, pieces: DataFrame, *, threshold: float = 0.5) -> DataFrame:
    """The keys of the generations whose text was cut off before its end."""
    return scores(generations, KEY, ["model", "quant"], "text", "token_ids", pieces).where(F.col("probability") >= threshold).select(*KEY)


def cut_rates(generations: DataFrame, pieces: DataFrame, *, threshold: float = 0.5) -> DataFrame:
    """(model, quant, n_rows, n_cut, share) over different keys with a text."""
    each = scores(generations, KEY, ["model", "quant"], "text", "token_ids", pieces)
    cut = (F.col("probability") >= threshold).cast("int")
    return each.groupBy("model", "quant").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(cut).alias("n_cut"), F.avg(cut).alias("share"))
