r"""Citations in answers: ``[المادة N]``.  Extraction, repair, and what a draft's citations are worth."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from karst.functions.once import once

#: The forms of citations; digits are ASCII or Arabic, in evaluation Persian too.
DIGITS = "0-9٠-٩"
INLINE = rf"\[\s*المادة\s+([{DIGITS}]+)\s*\]"
INLINE_EVALUATED = r"\[\s*المادة\s+([0-9٠-٩۰-۹]+)\s*\]"
MENTION = rf"(?<![\p{{L}}\p{{N}}_\x{{0600}}-\x{{06FF}}])\[*\s*(?:المادة|مادة)\s+([{DIGITS}]+)\s*\]*"
BRACKETED = rf"\[+\s*(?:المادة|مادة)\s+([{DIGITS}]+)\s*\]+"
_MENTION = re.compile(rf"(?<![\w؀-ۿ])\[*\s*(?:المادة|مادة)\s+([{DIGITS}]+)\s*\]*")
_ARABIC_DIGITS, _ASCII_DIGITS = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789"


def to_int(value: Column) -> Column:
    """An integer in ASCII, Arabic or Persian digits; null when it is none."""
    return F.translate(value, _ARABIC_DIGITS, _ASCII_DIGITS).try_cast("int")


def _numbers(text: Column, pattern: str) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(1)), to_int))


def inline_numbers(text: Column) -> Column:
    """Cited article numbers, each once, in their order."""
    return _numbers(text, INLINE)


def evaluated_numbers(text: Column) -> Column:
    return _numbers(text, INLINE_EVALUATED)


def mentioned_numbers(text: Column) -> Column:
    """Numbers of all mentions of articles, bracketed or not."""
    return _numbers(text, MENTION)


def repair_brackets(text: Column) -> Column:
    """Any run of brackets around a citation becomes one pair, its digits ASCII; blanks are folded and taken away before punctuation.

    The text is cut at its citations once, and put together again with their numbers, however many digits occur.
    """
    pattern = F.lit(BRACKETED)
    numbers = F.regexp_replace(F.translate(F.array_join(F.regexp_extract_all(text, pattern, F.lit(1)), ","), _ARABIC_DIGITS[:10], _ASCII_DIGITS[:10]), r"\b0+(?=[0-9])", "")
    put = F.zip_with(F.split(text, BRACKETED), F.split(numbers, ","), lambda part, n: F.when(n.isNull() | (n == ""), part).otherwise(F.concat(part, F.lit("[المادة "), n, F.lit("]"))))
    out = F.regexp_replace(F.array_join(put, ""), "[ \t]{2,}", " ")
    return F.trim(F.regexp_replace(out, r"\s+([،؛,.!?])", "$1"))


@F.pandas_udf(T.StringType())
def canonical(text: pd.Series, allowed: pd.Series) -> pd.Series:
    """Mentions of allowed articles become citations; a pattern cannot look into a set, so this goes through Arrow."""

    def one(value, numbers):
        if value is None:
            return None
        numbers = set() if numbers is None else {int(n) for n in numbers}

        def put(m):
            n = int(m[1].translate(str.maketrans(_ARABIC_DIGITS, _ASCII_DIGITS)))
            return f"[المادة {n}]" if n in numbers else m[0]

        return _MENTION.sub(put, value)

    return pd.Series([one(t, a) for t, a in zip(text, allowed, strict=True)], dtype=object)


def citation_state(answer: Column, structured: Column, allowed: Column) -> Column:
    """struct(answer, inline, mentioned, structured, valid_inline, valid_structured, final, invalid_inline, invalid_mentions, invalid_structured, needs_retry).

    The answer has been repaired and made canonical already.  Inline citations count when there are valid ones,
    else the structured list; anything invalid or nothing valid asks for a retry.
    """
    found = F.struct(inline_numbers(answer).alias("inline"), mentioned_numbers(answer).alias("mentioned"), F.array_distinct(F.coalesce(structured, F.array().cast("array<int>"))).alias("structured"))
    valid = lambda a: F.filter(a, lambda n: F.array_contains(allowed, n))
    bad = lambda a: F.sort_array(F.array_except(a, allowed))

    def checked(x: Column) -> Column:
        return F.struct(
            *[x[c].alias(c) for c in ("inline", "mentioned", "structured")], valid(x["inline"]).alias("valid_inline"), valid(x["structured"]).alias("valid_structured"),
            bad(x["inline"]).alias("invalid_inline"), bad(x["mentioned"]).alias("invalid_mentions"), bad(x["structured"]).alias("invalid_structured"),
        )

    def told(x: Column) -> Column:
        final = F.when(F.size(x["valid_inline"]) > 0, x["valid_inline"]).otherwise(x["valid_structured"])
        retry = (F.size(x["invalid_inline"]) > 0) | (F.size(x["invalid_mentions"]) > 0) | (F.size(x["invalid_structured"]) > 0) | (F.size(final) == 0)
        names = ("inline", "mentioned", "structured", "valid_inline", "valid_structured")
        return F.struct(answer.alias("answer"), *[x[c].alias(c) for c in names], final.alias("final"), *[x[c].alias(c) for c in ("invalid_inline", "invalid_mentions", "invalid_structured")], retry.alias("needs_retry"))

    return once(found, lambda f: once(checked(f), told))


def with_suffix(answer: Column, valid_inline: Column, final: Column) -> Column:
    """The answer, with its citations put after it where it has no valid one inline."""
    suffix = F.array_join(F.transform(final, lambda n: F.concat(F.lit("[المادة "), n.cast("string"), F.lit("]"))), "")
    return F.when((F.size(valid_inline) == 0) & (F.size(final) > 0), F.concat_ws(" ", F.rtrim(answer), suffix)).otherwise(answer)
