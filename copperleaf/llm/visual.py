"""Problem 5: one form for text that reads the same.

``visual_form`` keeps everything a reader can see and unifies the rest: composed accents, full- and half-width
forms, ligatures, look-alike letters, every kind of space and line end, and characters without a shape of their
own. ``folded_form`` is the wider method: compatibility normalisation (NFKC), full case folding, mapped white
space and no default-ignorable characters; it also joins case, raised digits and the like.

Both map null to null and '' to ''. Any code point is taken, lone surrogates too.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copperleaf.session import materialize

# Letters of other scripts and signs that share their shape with an ASCII character.
LOOK_ALIKE = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P",
    "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Ѵ": "V", "Ԍ": "G", "Ӏ": "I",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d",
    "ԛ": "q", "ԝ": "w", "һ": "h", "ѵ": "v", "ӏ": "l", "ԍ": "g",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J", "ο": "o", "ϲ": "c", "ϳ": "j", "ν": "v",
    "օ": "o", "ո": "n", "հ": "h", "ց": "g", "զ": "q", "Օ": "O", "Ս": "U", "Լ": "L",
    "ɑ": "a", "ɡ": "g", "ⅰ": "i", "ⅴ": "v", "ⅹ": "x", "ⅼ": "l", "ⅽ": "c", "ⅾ": "d", "ⅿ": "m",
    "Ⅰ": "I", "Ⅴ": "V", "Ⅹ": "X", "Ⅼ": "L", "Ⅽ": "C", "Ⅾ": "D", "Ⅿ": "M",
    "‐": "-", "‑": "-", "․": ".", "ʼ": "’", "ˈ": "'", "׃": ":", "։": ":", "∶": ":", "ǃ": "!", "∕": "/", "⁄": "/",
}
# Code points without a shape that are not of the categories Cf and Zs.
SHAPELESS = "\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180f\u3164\uffa0"
# Tags of decompositions that keep the shape.
SAME_SHAPE = ("<wide>", "<narrow>", "<noBreak>")
_LIGATURES = range(0xFB00, 0xFB07)


def _ignorable(c: str) -> bool:
    return unicodedata.category(c) == "Cf" or c in SHAPELESS or "\ufe00" <= c <= "\ufe0f" or "\U000e0100" <= c <= "\U000e01ef"


def _shape(c: str) -> str:
    """What one character becomes in the visual form."""
    if c < "\x80":
        return c
    if _ignorable(c):
        return ""
    if unicodedata.category(c) == "Zs":
        return " "
    if c in "\x85\u2028\u2029":
        return "\n"
    if ord(c) in _LIGATURES or unicodedata.decomposition(c).startswith(SAME_SHAPE):
        return "".join(LOOK_ALIKE.get(x, x) for x in unicodedata.normalize("NFKC", c))
    # taken apart, so that accents on a look-alike letter are found
    return unicodedata.normalize("NFC", "".join(LOOK_ALIKE.get(x, x) for x in unicodedata.normalize("NFD", c)))


@lru_cache(1)
def _shapes() -> tuple[re.Pattern, re.Pattern, dict[str, str]]:
    """The characters that change, as two patterns that find them, and what they become.

    Of characters beyond U+FFFF a class of its own: a class with both kinds is searched range by range.
    """
    low = {c: to for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x10000)]) if (to := _shape(c)) != c}
    high = {c: to for c in map(chr, [*range(0x10000, 0x20000), *range(0xE0000, 0xE0200)]) if (to := _shape(c)) != c}
    find = lambda chars: re.compile("[" + "".join(map(re.escape, chars)) + "]")
    return find(low), find(high), low | high


_HIGH = re.compile("[\U00010000-\U0010ffff]")


class _Ignorables(dict):
    def __missing__(self, code: int):
        c = chr(code)
        self[code] = to = "" if _ignorable(c) else " " if unicodedata.category(c) == "Zs" else c
        return to


_IGNORABLES = _Ignorables()


def visual_form(text: str | None) -> str | None:
    """The text with one character sequence for each thing a reader sees."""
    if text is None:
        return None
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if text.isascii():
        return text
    low, high, change = _shapes()
    text = low.sub(lambda m: change[m[0]], text)
    if _HIGH.search(text):
        text = high.sub(lambda m: change[m[0]], text)
    return unicodedata.normalize("NFC", text)


def folded_form(text: str | None) -> str | None:
    """NFKC in composed form, full case folding, runs of white space as one space, no ignorable characters."""
    if text is None:
        return None
    if text.isascii():
        return " ".join(text.lower().split())
    text = unicodedata.normalize("NFKC", text.translate(_IGNORABLES))
    return " ".join(unicodedata.normalize("NFKC", text.casefold()).split())


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        field, key, value = (batch.column(i) for i in range(3))
        codes = value.dictionary_encode()  # each distinct value of the batch once
        form, raw = [], []
        for text in codes.dictionary.to_pylist():
            raw.append(_digest(text))
            seen = visual_form(text)
            form.append(raw[-1] if seen == text else _digest(seen))
        at = codes.indices
        yield pa.RecordBatch.from_arrays(
            [field, key, pa.array(form, pa.binary()).take(at), pa.array(raw, pa.binary()).take(at)], ["field_name", "key", "form", "raw"]
        )


def form_digests(values: DataFrame) -> DataFrame:
    """``values(field_name, key, value)`` to (field_name, key, form, raw): 128-bit digests of the visual form and of the value.

    Null and empty values have no form and are left out.
    """
    clean = values.select("field_name", "key", "value").where(F.col("value").isNotNull() & (F.col("value") != ""))
    return clean.mapInArrow(_forms, "field_name string, key string, form binary, raw binary")


def look_alike_pairs(values: DataFrame) -> DataFrame:
    """(field_name, key_a, key_b) of values that look the same and are not the same characters, key_a < key_b.

    Variants, the different values of one form, are paired before keys: a form with one variant leaves at once, and
    the copies of a variant only meet the copies of other variants, so work is in proportion to the result. A key
    with several equal rows counts once.
    """
    rows = materialize(form_digests(values), "forms")
    variants = rows.groupBy("field_name", "form", "raw").agg(F.count(F.lit(1)).alias("n")).drop("n")
    many = variants.groupBy("field_name", "form").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("field_name", "form")
    several = variants.join(many, ["field_name", "form"], "left_semi")
    a, b = several.toDF("field_name", "form", "raw"), several.toDF("field_name", "form", "raw_b")
    meet = a.join(b, ["field_name", "form"]).where(F.col("raw") < F.col("raw_b")).select("field_name", "raw", "raw_b")
    left = rows.select("field_name", F.col("key").alias("x"), "raw").distinct()
    right = rows.select("field_name", F.col("key").alias("y"), F.col("raw").alias("raw_b")).distinct()
    both = meet.join(left, ["field_name", "raw"]).join(right, ["field_name", "raw_b"]).where(F.col("x") != F.col("y"))
    return both.select("field_name", F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b")).distinct()


def folded_classes(values: DataFrame) -> DataFrame:
    """(field_name, key, form): a digest of the folded form of each value, null where the value is null.

    Values compare equal in the named method -- compatibility normalisation, full case folding, one kind of white
    space, nothing ignorable -- where their digests do. Repeated rows stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column(2).dictionary_encode()  # each distinct value of the batch once
            forms = [hashlib.md5(folded_form(t).encode("utf-8", "surrogatepass")).hexdigest() for t in codes.dictionary.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(forms, pa.string()).take(codes.indices)], ["field_name", "key", "form"])

    return values.select("field_name", "key", "value").mapInArrow(run, "field_name string, key string, form string")


def with_forms(df: DataFrame, column: str, *, visual: str = "visual", folded: str = "folded") -> DataFrame:
    """``df`` with both forms of ``column``, as Arrow batches with each distinct value of a batch worked out once."""
    if {visual, folded} & {*df.columns}:
        raise ValueError("a column of that name exists already")

    @F.pandas_udf("visual string, folded string")
    def forms(values: pd.Series) -> pd.DataFrame:
        codes, distinct = pd.factorize(values)
        out = pd.DataFrame({"visual": [visual_form(x) for x in distinct], "folded": [folded_form(x) for x in distinct]}, dtype=object)
        return out.reindex(codes).reset_index(drop=True)  # code -1, null, isn't in the index

    return df.withColumn("__forms", forms(F.col(f"`{column}`"))).select(
        *[F.col(f"`{c}`") for c in df.columns], F.col("__forms.visual").alias(visual), F.col("__forms.folded").alias(folded)
    )
