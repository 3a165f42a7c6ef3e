"""Text functions as column expressions: normalisation, tokens, relevance, names and previews."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Marks that are stripped, letters that are folded, words that say nothing.
ARABIC_MARKS = r"[\x{0610}-\x{061A}\x{064B}-\x{065F}\x{0670}\x{06D6}-\x{06ED}]"
FOLD_FROM = "أإآٱىؤئ٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹ـ"
FOLD_TO = "اااايوي01234567890123456789"
NON_WORD = r"[^0-9A-Za-z\x{0600}-\x{06FF}]+"
STOP_WORDS = (
    "انا ان إن او أو اي أي اذا إذا الى إلى التي الذي على عن في ما ماذا من هل هو هي هذا هذه كم كيف له لها لم لا مع بعد "
    "قبل يمكن يجب وفق ضمن احكام أحكام قانون القانون العمل الاردني الأردني اردني أردني"
).split()

#: Texts of these characters alone are their own NFKC form.
_STABLE = r"^[\x00-\x7FÀ-ıĴ-ľŁ-ňŊ-ž،؛؟ء-غـ-ي٠-٩۰-۹\x{2013}\x{2014}\x{2018}-\x{201D}]*$"


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def nfkc(text: Column) -> Column:
    """NFKC; Spark has none, so texts that may change (and only these) go through Arrow."""
    moved = F.when(~text.rlike(_STABLE), text)
    return F.coalesce(_nfkc(moved), text)


def fold_arabic(text: Column) -> Column:
    """``normalize_arabic`` for text that is NFKC already."""
    plain = F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), ARABIC_MARKS, ""), FOLD_FROM, FOLD_TO)
    return F.trim(F.regexp_replace(F.lower(plain), NON_WORD, " "))


def normalize_arabic(text: Column) -> Column:
    """For matching: NFKC, marks stripped, letter variants and digits folded, lower case, one space between words."""
    return fold_arabic(nfkc(F.coalesce(text, F.lit(""))))


def tokens(normalized: Column) -> Column:
    """The words of a normalised text."""
    return F.filter(F.split(normalized, " "), lambda w: w != "")


def content_tokens(normalized: Column, stop_words: list[str] = STOP_WORDS) -> Column:
    """Distinct words of more than one letter that say something, in their order."""
    stop = F.array(*[F.lit(w) for w in stop_words])
    # The difference of sets is compiled and keeps distinct words in their order; a lambda over every word and stop word is neither.
    return F.filter(F.array_except(F.split(normalized, " "), stop), lambda w: F.length(w) > 1)


def relevance(question: Column, article: Column) -> Column:
    """Share of the question's content words that the article has, of its numbers, and whether the whole question stands there; both normalised."""
    asked, told = content_tokens(question), tokens(article)
    numbers = F.filter(asked, lambda w: w.rlike("^[0-9]+$"))
    n, k = F.size(asked), F.size(numbers)
    overlap = F.size(F.array_intersect(asked, told)) / n
    number = F.when(k > 0, F.size(F.array_intersect(numbers, told)) / k).otherwise(F.lit(0.0))
    phrase = F.when((question != "") & F.contains(article, question), F.lit(1.0)).otherwise(F.lit(0.0))
    score = 0.75 * overlap + 0.20 * number + 0.05 * phrase
    return F.when(n == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def local_name(uri: Column) -> Column:
    """What follows the last #, or else the last segment of the path."""
    path = F.regexp_replace(uri, "/+$", "")
    return F.when(F.contains(uri, F.lit("#")), F.substring_index(uri, "#", -1)).otherwise(F.substring_index(path, "/", -1))


def article_number(uri: Column) -> Column:
    return F.regexp_extract(uri, r"(?:^|[#/])article_([0-9]+)$", 1).try_cast("int")


def first_text(arabic: Column, english: Column, searchable: Column, limit: int = 5000) -> Column:
    """The first Arabic comment, or the first English, or the searchable text; so many characters."""
    return F.substring(F.coalesce(F.get(arabic, F.lit(0)), F.get(english, F.lit(0)), searchable, F.lit("")), 1, limit)


def seed_label(arabic: Column, english: Column, name: Column) -> Column:
    return F.coalesce(F.get(arabic, F.lit(0)), F.get(english, F.lit(0)), name)


def embedding_text(issue: Column, query: Column, hints: Column) -> Column:
    """Issue, query and hints, each once, joined by spaces."""
    parts = F.concat(F.array(issue, query), F.coalesce(hints, F.array().cast("array<string>")))
    return F.concat_ws(" ", F.array_distinct(F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")))


def article_text(labels_ar: Column, labels_en: Column, preview: Column) -> Column:
    return F.concat_ws(" ", labels_ar, labels_en, preview)


def excerpt(text: Column, limit: int = 500) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, limit)


def slug(value: Column) -> Column:
    """Safe in a file name: other characters become _, the ends are trimmed; nothing left is null."""
    out = F.lower(F.regexp_replace(F.regexp_replace(value, "[^A-Za-z0-9._-]+", "_"), "^[._-]+|[._-]+$", ""))
    return F.when(out != "", out)


def arabic_only(text: Column) -> Column:
    """Not blank, with Arabic letters and without Latin ones."""
    return F.coalesce((F.trim(text) != "") & text.rlike(r"[\x{0600}-\x{06FF}]") & ~text.rlike("[A-Za-z]"), F.lit(False))


def outermost_json(text: Column) -> Column:
    """The outermost object in a model's reply, without code fences; null if there is none."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def char_budget(n: Column, total: int = 12000, per_article: int = 2500, least: int = 600) -> Column:
    """Characters that each of n articles may have in a request."""
    share = F.floor(F.lit(total) / F.greatest(n, F.lit(1))).cast("int")
    return F.least(F.lit(per_article), F.greatest(F.lit(least), share))
