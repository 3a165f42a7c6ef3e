"""Operator 3, quality rules with adaptive thresholds (DataFrame functions only).

Ratios of every document go into mergeable quantile sketches (logarithmic buckets with counts:
a relative-error sketch whose merge is a sum) per language and source.  A document is rejected
when a ratio lies far outside of its own language's and source's distribution: beyond the median by
``REACH`` times the distance from the median to the quartile on the side of good text, which
junk cannot move until it makes up half of a group.  Groups too small for a sketch use their
language's, and then the corpus's, which are merged from the same buckets.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from karst.llm.common import free_name, sheltered, table, without, written

#: Relative error of a sketch's quantiles, and the bucket that holds zeros.
ACCURACY, ZERO = 0.01, -1_000_000
GAMMA = (1 + ACCURACY) / (1 - ACCURACY)
#: Rows from which a sketch speaks for its group.
MIN_ROWS = 100
REACH = 8.0
#: Ratio -> (numerator, denominator, least spread: a distance within which values count as alike, whether low values are odd too).
#: The least spreads lie at or below the quartiles' distances that corpora show, so that these decide; they only keep a
#: group of all but equal values from rejecting on noise.  Repeated lines have no spread of their own (most texts have none, good
#: ones some), so theirs is a rule.  Repeated words beyond the base rule's share are left to that rule.
RATIOS = {
    "word_length": ("word_chars", "n_words", 0.1, True),
    "symbols": ("n_symbols", "word_chars", 0.001, False),
    "upper_case": ("_n_upper", "word_chars", 0.005, False),
    "exclamations": ("_n_bang", "word_chars", 0.00125, False),
    "repeated_lines": ("n_dup_lines", "_n_lines", 0.06, False),
    "stutters": ("_n_stutter", "n_words", 0.0075, False),
}
#: Further counts for the ratios: lines with a word, capitals, [!?], words equal to the word before.
EXTRA = ["_n_lines", "_n_upper", "_n_bang", "_n_stutter"]
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]

_WORDS = r"regexp_extract_all(coalesce({text}, ''), '[^\\x20\\x09-\\x0D]+', 0)"
_LINES = r"filter(split(coalesce({text}, ''), '\n', -1), l -> l rlike '[^\\x20\\x09-\\x0D]')"
#: Words that lie in an 8-word window found twice or more.  ``let`` is transform(array(x), v -> ...)[0].
#: Texts whose window hashes are all distinct stop there; for others, hashes are sorted with their
#: positions, neighbours compared, and the stretches from repeated positions united.
_REPEATED = """
transform(array(transform(sequence(1, size(_words) - 7), i -> xxhash64(slice(_words, i, 8)))), h ->
  CASE WHEN size(array_distinct(h)) = size(h) THEN 0L ELSE
    aggregate(
      array_sort(transform(array(sort_array(transform(h, (x, i) -> struct(x AS x, i AS i)))), s ->
        transform(filter(transform(s, (e, k) -> struct(e.i AS i, (k > 0 AND get(s, k - 1).x = e.x) OR (k + 1 < size(s) AND get(s, k + 1).x = e.x) AS twice)), e -> e.twice), e -> e.i))[0]),
      struct(0L AS n, 0L AS to),
      (a, p) -> struct(a.n + p + 8L - greatest(a.to, CAST(p AS BIGINT)) AS n, p + 8L AS to),
      a -> a.n)
  END)[0]
"""


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the base measures, and with the further counts for the verdict."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = without(docs, [*BASE, "_words", "_lines", *EXTRA])
    docs = docs.withColumns({"_words": F.expr(_WORDS.format(text=f"`{text_col}`")), "_lines": F.expr(_LINES.format(text=f"`{text_col}`"))})
    docs = docs.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.expr("aggregate(_words, 0L, (s, w) -> s + length(w))"),
            "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.when(F.size("_words") < 9, F.lit(0).cast("long")).otherwise(F.expr(_REPEATED)),
            "_n_lines": F.size("_lines").cast("long"),
            "_n_upper": F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long"),
            "_n_bang": F.regexp_count(text, F.lit(r"[!?]")).cast("long"),
            "_n_stutter": F.expr("transform(array(_words), w -> size(filter(w, (x, i) -> i > 0 AND x = get(w, i - 1))))[0]").cast("long"),
        }
    ).drop("_words", "_lines")
    return docs.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def _ratio(name: str):
    top, bottom, _, _ = RATIOS[name]
    return F.when(F.col(bottom) > 0, F.col(top).cast("double") / F.col(bottom))


def sketches(rows: DataFrame, lang_col: str, source_col: str) -> DataFrame:
    """lang, source, ratio, bucket, n: the sketches; adding up n over any columns merges them."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("ratio"), _ratio(k).alias("value")) for k in RATIOS])).alias("p")
    long = rows.where(~F.col("base_failed")).select(F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), pairs)
    bucket = F.when(F.col("p.value") > 0, F.ceil(F.log("p.value") / F.lit(math.log(GAMMA))).cast("int")).otherwise(F.lit(ZERO))
    return long.select("lang", "source", "p.ratio", bucket.alias("bucket")).groupBy("lang", "source", "ratio", "bucket").agg(F.count(F.lit(1)).alias("n"))


def _quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ratio, n, q25, q50, q75: of the sketch merged to the keys."""
    merged = sketch.groupBy(*keys, "ratio", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "ratio")  # at most some thousand buckets
    merged = merged.withColumns({"below": F.sum("n").over(group.orderBy("bucket")), "all": F.sum("n").over(group)})

    def at(q: float):
        b = F.min(F.when(F.col("below") >= F.lit(q) * F.col("all"), F.col("bucket")))
        return F.when(b == ZERO, F.lit(0.0)).otherwise(F.pow(F.lit(GAMMA), b) * F.lit(2 / (GAMMA + 1)))

    return merged.groupBy(*keys, "ratio").agg(F.first("all").alias("n"), at(0.25).alias("q25"), at(0.5).alias("q50"), at(0.75).alias("q75"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """lang, source, low, high (maps from ratio to bound): one row a language and source."""
    own, by_lang, overall = _quantiles(sketch, ["lang", "source"]), _quantiles(sketch, ["lang"]), _quantiles(sketch, [])
    o, b, a = own.alias("o"), by_lang.alias("b"), overall.alias("a")
    wide = o.join(b, F.expr("o.lang <=> b.lang AND o.ratio = b.ratio")).join(a, F.expr("o.ratio = a.ratio"))

    def q(name: str):
        return F.when(F.col("o.n") >= MIN_ROWS, F.col(f"o.{name}")).when(F.col("b.n") >= MIN_ROWS, F.col(f"b.{name}")).otherwise(F.col(f"a.{name}"))

    spread = F.create_map(*[F.lit(x) for k, r in RATIOS.items() for x in (k, r[2])])[F.col("o.ratio")]
    low_too = F.col("o.ratio").isin([k for k, r in RATIOS.items() if r[3]])
    high = q("q50") + REACH * F.greatest(q("q50") - q("q25"), spread)
    low = F.when(low_too, q("q50") - REACH * F.greatest(q("q75") - q("q50"), spread)).otherwise(F.lit(-1.0))
    bounds = wide.select("o.lang", "o.source", "o.ratio", low.alias("low"), high.alias("high"))
    pick = lambda c: F.map_from_entries(F.collect_list(F.struct("ratio", c)))
    return bounds.groupBy("lang", "source").agg(pick("low").alias("low"), pick("high").alias("high"))


def quality(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", carry: list[str] | None = None) -> DataFrame:
    """docs (or the columns ``carry`` of them) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    Null and empty texts have no words and fail the base rules.  Null languages or sources form a
    group of their own.  Repeated rows are judged each.  An empty table gives an empty result.  Columns of docs that are
    named like the result's are dropped; other names don't matter.  Very long texts are measured whole.
    Only the sketches (rows: groups x ratios x buckets) and the bounds (rows: groups) are
    shuffled or joined to; the planner broadcasts the bounds when their measured size allows it,
    and splits a hot source's partition otherwise.
    """
    carry = without(docs, [*BASE, "kept", "_words", "_lines", *EXTRA]).columns if carry is None else carry
    names = [*carry, *[c for c in (lang_col, source_col) if c not in carry], *BASE, *EXTRA]
    rows = written(measured(docs, text_col).select(names), "quality")
    # Written, so that the planner knows how small they are before it plans the join, and needn't shuffle the rows to find out.
    free = {c: free_name(names, f"_{c}") for c in ("lang", "source", "low", "high")}
    bounds = written(thresholds(sketches(rows, lang_col, source_col)), "quality-bounds").withColumnsRenamed(free)
    same = rows[lang_col].eqNullSafe(bounds[free["lang"]]) & rows[source_col].eqNullSafe(bounds[free["source"]])
    inside = F.lit(True)
    for k in RATIOS:
        inside &= F.coalesce((_ratio(k) <= F.col(free["high"])[k]) & (_ratio(k) >= F.col(free["low"])[k]), F.lit(True))
    judged = rows.join(bounds, same, "left").select(*carry, *BASE, (~F.col("base_failed") & inside).alias("kept"))
    return judged


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that ``quality`` keeps, with docs' own columns."""
    return sheltered(docs, [*BASE, *EXTRA, "_words", "_lines", "kept", "low", "high", "_lang", "_source"], lambda d: quality(d, **options).where("kept"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), carry=["doc_id"])


def _sql() -> str:
    values = ", ".join(f"('{k}', CASE WHEN {r[1]} > 0 THEN CAST({r[0]} AS DOUBLE) / {r[1]} END)" for k, r in RATIOS.items())
    spreads = " ".join(f"WHEN '{k}' THEN CAST('{r[2]}' AS DOUBLE)" for k, r in RATIOS.items())
    low_too = ", ".join(f"'{k}'" for k, r in RATIOS.items() if r[3])

    def quantiles(name: str, keys: str) -> str:
        k = keys + "," if keys else ""
        at = ", ".join(
            f"CASE WHEN min(bucket) FILTER (below >= {q} * total) = {ZERO} THEN 0 ELSE pow(CAST('{GAMMA!r}' AS DOUBLE), min(bucket) FILTER (below >= {q} * total)) * CAST('{2 / (GAMMA + 1)!r}' AS DOUBLE) END AS q{int(q * 100)}"
            for q in (0.25, 0.5, 0.75)
        )
        return f"""{name} AS (
  SELECT {k} ratio, any_value(total) AS n, {at} FROM (
    SELECT *, sum(n) OVER (PARTITION BY {k} ratio ORDER BY bucket) AS below, sum(n) OVER (PARTITION BY {k} ratio) AS total
    FROM (SELECT {k} ratio, bucket, sum(n) AS n FROM sketch GROUP BY {k} ratio, bucket)) GROUP BY {k} ratio)"""

    pick = lambda q: f"CASE WHEN o.n >= {MIN_ROWS} THEN o.{q} WHEN b.n >= {MIN_ROWS} THEN b.{q} ELSE a.{q} END AS {q}"
    return rf"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), win AS (
  SELECT rid, p, array_to_string(w[p : p + 7], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS p FROM w WHERE len(w) >= 8)
), twice AS (SELECT rid, p FROM win QUALIFY count(*) OVER (PARTITION BY rid, g) > 1
), covered AS (SELECT rid, count(DISTINCT p + k) AS n FROM (SELECT rid, p, unnest(range(0, 8)) AS k FROM twice) GROUP BY rid
), base AS (
  SELECT rid, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words, len(l) AS _n_lines,
         len(regexp_extract_all(t, '\p{{Lu}}')) AS _n_upper, len(regexp_extract_all(t, '[!?]')) AS _n_bang,
         len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS _n_stutter
  FROM w LEFT JOIN covered USING (rid)
), rows_ AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base
), pairs AS (SELECT rid, lang, source, base_failed, v.ratio, v.value FROM rows_, LATERAL (VALUES {values}) AS v(ratio, value)
), sketch AS (
  SELECT lang, source, ratio, CASE WHEN value > 0 THEN CAST(ceil(ln(value) / CAST('{math.log(GAMMA)!r}' AS DOUBLE)) AS INTEGER) ELSE {ZERO} END AS bucket, count(*) AS n
  FROM pairs WHERE NOT base_failed GROUP BY ALL
), {quantiles("own", "lang, source")}, {quantiles("bylang", "lang")}, {quantiles("overall", "")},
bounds AS (
  SELECT lang, source, ratio, q50 + {REACH} * greatest(q50 - q25, s) AS high, CASE WHEN ratio IN ({low_too}) THEN q50 - {REACH} * greatest(q75 - q50, s) ELSE -1 END AS low
  FROM (SELECT o.lang, o.source, o.ratio, CASE o.ratio {spreads} END AS s, {pick("q25")}, {pick("q50")}, {pick("q75")}
        FROM own o JOIN bylang b ON o.lang IS NOT DISTINCT FROM b.lang AND o.ratio = b.ratio JOIN overall a ON o.ratio = a.ratio)
), odd AS (
  SELECT DISTINCT rid FROM pairs p JOIN bounds b ON p.lang IS NOT DISTINCT FROM b.lang AND p.source IS NOT DISTINCT FROM b.source AND p.ratio = b.ratio
  WHERE p.value > b.high OR p.value < b.low
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND odd.rid IS NULL AS kept
FROM rows_ LEFT JOIN odd USING (rid)
"""


OP3_SQL = _sql()
