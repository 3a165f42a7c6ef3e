import pytest
from pyspark.sql import functions as F

from karst.functions import citations as c
from karst.functions import text as t


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("given", "wanted"),
    [("إجازة ٦٠ يوماً", "اجازة 60 يوما"), ("أجر، مدة", "اجر، مدة"), ("café", "caf"), ("ﻻ", "لا"), (None, ""), ("", ""), ("A-B  c", "a b c"), ("آخر", "اخر")],
)
def test_normalize(spark, given, wanted):
    assert one(spark, t.normalize_arabic(F.col("a")), a=given) == wanted


def test_tokens_and_relevance(spark):
    assert one(spark, t.content_tokens(F.lit("اجر من 60 اجر س عامل"))) == ["اجر", "60", "عامل"]
    q, good, bad = "مدة الإجازة 14 يوما", "للعامل إجازة مدة الإجازة 14 يوما سنويا", "عقوبة التأخير"
    score = lambda a: one(spark, t.relevance(t.normalize_arabic(F.col("q")), t.normalize_arabic(F.col("a"))), q=q, a=a)
    assert score(good) == pytest.approx(1.0) and score(bad) == 0
    assert one(spark, t.relevance(F.lit(""), F.lit("x"))) == 0


def test_names(spark):
    names = {"http://a/b#c": "c", "http://a/b/c": "c", "http://a/b/": "b", "x": "x"}
    for given, wanted in names.items():
        assert one(spark, t.local_name(F.col("u")), u=given) == wanted
    assert one(spark, t.article_number(F.lit("http://a#article_12"))) == 12
    assert one(spark, t.article_number(F.lit("http://a#article_x"))) is None
    assert one(spark, t.slug(F.lit("--A b/c.."))) == "a_b_c" and one(spark, t.slug(F.lit("--"))) is None
    assert one(spark, t.arabic_only(F.lit("نص 1"))) and not one(spark, t.arabic_only(F.lit("نص a"))) and not one(spark, t.arabic_only(F.lit(None).cast("string")))
    assert one(spark, t.outermost_json(F.lit('```json\n{"a": {"b": 1}}\n```'))) == '{"a": {"b": 1}}'


@pytest.mark.parametrize(
    ("given", "wanted"),
    [("وفق المادة 5 من القانون", "وفق [المادة 5]من القانون"), ("نص. المادة ٧", "نص.[المادة 7]"), ("نص [المادة 5] تتمة", "نص [المادة 5] تتمة"), ("والمادة 5 هنا", "والمادة 5 هنا"), ("المادة 9", "المادة 9")],
)
def test_canonical(spark, given, wanted):
    # A bracketed mention takes the blank before it, as a bare one takes the blank after it.
    got = one(spark, c.canonical(F.col("a"), F.array(F.lit(5), F.lit(7))), a=given)
    assert got.replace(" [", "[") == wanted.replace(" [", "[")


@pytest.mark.parametrize(("given", "wanted"), [("[[المادة 5]", "[المادة 5]"), ("[مادة ٠٧]  نص ،", "[المادة 7] نص،"), ("رقم ٧ [المادة ٧]", "رقم ٧ [المادة 7]")])
def test_repair(spark, given, wanted):
    assert one(spark, c.repair_brackets(F.col("a")), a=given) == wanted


def test_citation_state(spark):
    state = lambda a, s, ok: one(spark, c.citation_state(F.lit(a), F.array(*map(F.lit, s)).cast("array<int>"), F.array(*map(F.lit, ok)).cast("array<int>")))
    good = state("نص [المادة 5]", [5, 5], [5, 7])
    assert not good.needs_retry and good.final == [5]
    only = state("نص", [7], [5, 7])
    assert not only.needs_retry and only.final == [7] and only.inline == []
    assert state("نص [المادة 9]", [5], [5]).needs_retry and state("نص", [], [5]).needs_retry and state("نص المادة 9 [المادة 5]", [], [5]).invalid_mentions == [9]
