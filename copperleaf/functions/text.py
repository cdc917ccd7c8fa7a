"""Column functions on text. Nulls give null unless said otherwise."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: words, numbers with a fraction, and single signs; letters beyond ASCII match none of them.
TOKENS = r"([A-Za-z_][A-Za-z_0-9]*|\p{Nd}+(?:\.\p{Nd}+)?|[^\p{L}\p{N}_ ])"
# Fixed value: a fenced block with an optional language.
FENCE = r"(?s)```(?:[a-zA-Z0-9_+-]*)\n?(.*?)```"
# What contest prompts are followed by.
STARTER = ("\n\nComplete this Python starter code. Return only the complete code.\n```python\n", "\n```")
PROGRAM = "\n\nWrite a complete Python program that reads from standard input and writes to standard output. Return only the code."
# The forms of answers.
LABEL_ANSWER = r"\AAnswer: ([ABCD])\z"
TRIVIAL_ANSWER = r"\ADecision: (Yes|No)\nReasoning: [^\n]+\z"
# Fixed value: runs of white space of any kind.
BLANKS = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
# The keys whose text counts, at the top and below it.
TOP_KEYS = ("text", "prompt", "solution", "ground_truth", "messages", "chosen", "rejected", "source_prompt", "outputs")
INNER_KEYS = ("content", "reasoning_content", "text")


def normalize_exact(text: Column) -> Column:
    """NFKC, full case folding, white space runs as one space: exact.

    ASCII text has no compatibility forms and stays inside whole-stage code; the rest goes by Arrow batches.
    """
    plain = (F.octet_length(text) == F.char_length(text)) & ~F.rlike(text, F.lit(r"[\x{1c}-\x{1f}]"))
    return F.when(plain, normalize(text)).otherwise(_normalize_batches(F.when(~plain, text)))


def _normalize_batches(text: Column) -> Column:

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).casefold().split()))

    return run(text)


def normalize(text: Column) -> Column:
    """The same for text without compatibility forms, inside whole-stage code: lower case, ss for sharp s, white space runs as one space."""
    return F.trim(F.regexp_replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), BLANKS, " "))


def tokens(normalized: Column) -> Column:
    return F.regexp_extract_all(normalized, F.lit(TOKENS), F.lit(1))


def gram_hashes(tokens: Column, n: int) -> Column:
    """A 64-bit hash of each n neighbouring tokens, in order of place; empty where there are fewer.

    ``tokens`` is used more than once on purpose: the optimizer then doesn't copy its expression into the loop.
    """
    return F.filter(
        F.transform(tokens, lambda _, i: F.when(i + n <= F.size(tokens), F.xxhash64(F.slice(tokens, i + 1, n)))), lambda h: h.isNotNull()
    )


def grams(tokens: Column, n: int) -> Column:
    """Each n neighbouring tokens as text."""
    return F.filter(
        F.transform(tokens, lambda _, i: F.when(i + n <= F.size(tokens), F.array_join(F.slice(tokens, i + 1, n), " "))), lambda g: g.isNotNull()
    )


def context(tokens: Column, start: Column, n: int, margin: int = 30) -> Column:
    """The n tokens from ``start`` (from 0) on and up to ``margin`` to either side."""
    first = F.greatest(start - margin, F.lit(0))
    return F.array_join(F.slice(tokens, first + 1, start + n + margin - first), " ")


def char_start(text: Column, part: Column) -> Column:
    """Where a text holds a part, from 0; null where it doesn't."""
    at = F.call_function("instr", text, part)
    return F.when(at > 0, at - 1)


def fenced(text: Column) -> Column:
    """The content of the last fenced block as it is, or the text itself."""
    blocks = F.regexp_extract_all(text, F.lit(FENCE), F.lit(1))
    return F.when(F.size(blocks) > 0, F.element_at(blocks, -1)).otherwise(text)


def generation_prompt(dataset: Column, prompt: Column, starter: Column) -> Column:
    """The prompt as it is, but for contest problems with starter code to complete or else the form of a whole program."""
    contest = dataset.isin("lcb_pre", "lcb_post")
    started = F.coalesce(F.length(starter), F.lit(0)) > 0
    return F.when(contest & started, F.concat(prompt, F.lit(STARTER[0]), starter, F.lit(STARTER[1]))).when(contest, F.concat(prompt, F.lit(PROGRAM))).otherwise(prompt)


def render(template: str, **values: Column) -> Column:
    """A template with ``{name}`` places filled in one pass: what is filled in isn't looked at again. Null values fill in nothing."""
    parts = re.split(r"\{([A-Za-z_]\w*)\}", template)
    if unknown := set(parts[1::2]) - values.keys():
        raise ValueError(f"no value for {sorted(unknown)}")
    return F.concat(*[F.coalesce(values[p], F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def fine_label(answer: Column) -> Column:
    """FI, NI, SL or U from a whole answer ``Answer: A`` to ``Answer: D``; null for anything else."""
    letter = F.regexp_extract(answer, LABEL_ANSWER, 1)
    return F.when(letter == "A", "FI").when(letter == "B", "NI").when(letter == "C", "SL").when(letter == "D", "U")


def trivial_decision(answer: Column) -> Column:
    """True or False from a whole answer ``Decision: Yes|No`` with one line ``Reasoning: ...``; null for anything else."""
    word = F.regexp_extract(answer, TRIVIAL_ANSWER, 1)
    return F.when(word == "Yes", True).when(word == "No", False)


def program_output(text: Column) -> Column:
    """Output as compared: no blanks at line ends, no blank lines at the end."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"\s+$", ""))
    return F.regexp_replace(F.array_join(lines, "\n"), r"\n+$", "")


def same_json(left: Column, right: Column) -> Column:
    """Whether two JSON texts have equal values; texts that aren't JSON compare as texts."""

    def value(t: str):
        try:
            return True, json.loads(t)
        except ValueError:
            return False, t

    @F.pandas_udf("boolean")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else value(x) == value(y) for x, y in zip(a, b)], dtype=object)

    return run(left, right)


def packed_json(text: Column) -> Column:
    """JSON text from base64 of zlib data; null where it is anything else. Pickled data is never loaded."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        import base64
        import zlib

        def one(t):
            try:
                raw = zlib.decompress(base64.b64decode(t, validate=True)).decode("utf-8")
                json.loads(raw)
                return raw
            except Exception:
                return None

        return values.map(lambda t: None if t is None else one(t))

    return run(text)


def digest(*fields: Column) -> Column:
    """A content address: SHA-256 of the fields joined by the unit separator; null fields count as empty."""
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields]), 256)


def output_name(path: Column) -> Column:
    """A file name for what a shard gives: twelve digits of its path's SHA-256."""
    return F.concat(F.substring(F.sha2(path, 256), 1, 12), F.lit(".jsonl"))


def seed(*parts: str | int) -> int:
    """A seed from parts, the same everywhere."""
    import hashlib

    return int.from_bytes(hashlib.sha256("|".join(map(str, parts)).encode()).digest()[:8], "big")


def extract_text(record: Column) -> Column:
    """The text of a JSON record: strings under the known keys, lists and records walked in order, one a line; numbers don't count."""

    def walk(value, keys) -> list[str]:
        if isinstance(value, str):
            return [value] if value else []
        if isinstance(value, list):
            return [t for v in value for t in walk(v, INNER_KEYS)]
        if isinstance(value, dict):
            return [t for k, v in value.items() if k in keys for t in walk(v, INNER_KEYS)]
        return []

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        def one(t):
            try:
                return "\n".join(walk(json.loads(t), TOP_KEYS))
            except ValueError:
                return None

        return values.map(lambda t: None if t is None else one(t))

    return run(record)


def with_tokens(df: DataFrame, text: str, *, exact: bool = False, normalized: str = "normalized", out: str = "tokens") -> DataFrame:
    """``df`` with the normalised text (null as empty) and its tokens."""
    clean = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    df = df.withColumn(normalized, normalize_exact(clean) if exact else normalize(clean))
    return df.withColumn(out, tokens(F.col(normalized)))
