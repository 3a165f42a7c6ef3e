import math
import random
import re
from collections import Counter

import pytest
from plan_fixture import moved
from pyspark.sql import functions as F

from karst.operators import lexicon

FIELDS = {"title": 3.0, "body": 1.0}
KEYS = ["q"]


def brute(docs, queries, k):
    cut = [(u, [re.findall(r"[^\W_]+", (t or "").lower()) for t in texts]) for u, *texts in docs]
    mean = [sum(len(w[i]) for _, w in cut) / max(1, sum(bool(w[i]) for _, w in cut)) for i in range(2)]
    df = Counter(t for _, w in cut for t in set(w[0]) | set(w[1]))
    out = []
    for q, text in queries:
        scored = []
        for u, w in cut:
            total, hit = 0.0, False
            for t, times in Counter(re.findall(r"[^\W_]+", (text or "").lower())).items():
                f = sum(b * (x.count(t) / (0.25 + 0.75 * len(x) / m)) for b, x, m in zip(FIELDS.values(), w, mean) if x)
                hit |= f > 0
                total += times * math.log(1 + (len(cut) - df[t] + 0.5) / (df[t] + 0.5)) * f * 2.2 / (f + 1.2)
            if hit:
                scored.append((-round(total, 9), u))
        out += [(q, u, -s, r + 1) for r, (s, u) in enumerate(sorted(scored)[:k])]
    return out


def corpus(seed, n=700):
    rng = random.Random(seed)
    text = lambda m: " ".join(f"w{min(int(rng.expovariate(0.05)), 300)}" for _ in range(rng.randrange(m)))
    docs = [(f"u{i:04d}", text(6), text(40)) for i in range(n)]
    docs += [("u9000", None, None), ("u9001", "", "rare rare"), *[(f"v{i}", "same title", "same body rare") for i in range(30)]]
    queries = [(i, text(8)) for i in range(25)] + [(100, "rare"), (101, "same same title"), (102, "nobody"), (103, None), (104, "W1, w1 rare")]
    return docs, queries


def frame(spark, docs):
    return spark.createDataFrame(docs, "uri string, title string, body string")


def asked(spark, queries):
    return spark.createDataFrame(queries, "q int, query string")


def fields():
    return {f: (F.col(f), b) for f, b in FIELDS.items()}


def same(found, want):
    got = sorted((r.q, r["rank"], r.uri, round(r.score, 6)) for r in found.collect())
    assert got == sorted((q, r, u, round(s, 6)) for q, u, s, r in want) and got


@pytest.fixture(scope="module")
def small_ranges():
    """Ranges of eight documents, shards of 64."""
    before = lexicon.RANGE_BITS, lexicon.SHARD_BITS
    lexicon.RANGE_BITS, lexicon.SHARD_BITS = 3, 6
    yield
    lexicon.RANGE_BITS, lexicon.SHARD_BITS = before


def test_equals_brute_force(spark, small_ranges):
    docs, queries = corpus(1)
    index = lexicon.build_scratch(frame(spark, docs), "uri", fields())
    same(lexicon.topk(index, asked(spark, queries), 7, KEYS), brute(docs, queries, 7))
    assert lexicon.topk(index, asked(spark, [(1, "nobody")]), 7, KEYS).count() == 0
    index.drop(spark)


def test_additions_are_segments(spark, small_ranges):
    """Three additions answer like one index of all, with the averages and frequencies of all."""
    docs, queries = corpus(2, 300)
    index = lexicon.build(frame(spark, docs[::3]), "uri", fields(), "t_lexicon", buckets=3, reset=True)
    files = set(index.table(spark, "postings").inputFiles())
    for part in (docs[1::3], docs[2::3]):
        lexicon.add(index, frame(spark, part), "uri", {f: F.col(f) for f in FIELDS})
    assert files <= set(index.table(spark, "postings").inputFiles())  # what was there stays
    same(lexicon.topk(index, asked(spark, queries), 5, KEYS), brute(docs, queries, 5))
    with pytest.raises(ValueError):
        lexicon.add(index, frame(spark, docs), "uri", {"body": F.col("body")})
    index.drop(spark)


def test_few_ranges_are_scored(spark, small_ranges):
    """A word that is frequent in one range only leaves the others out."""
    docs = [(f"d{i:05d}", "", "common " * (30 if 400 <= i < 408 else 1) + "filler " * (0 if 400 <= i < 408 else 30)) for i in range(2000)]
    queries = [(1, "common"), (2, "filler common")]
    index = lexicon.build_scratch(frame(spark, docs), "uri", fields())
    search = lexicon.Search(index, asked(spark, queries), KEYS)
    assert search.bounds().where("q = 1").count() >= 250
    scored, rest = search.ranges(4)
    assert scored.where("q = 1").count() <= 4 * 8 and rest.where("q = 1").count() == 0
    same(search.topk(4), brute(docs, queries, 4))
    index.drop(spark)


def leaves(df):
    plan = df._jdf.queryExecution().executedPlan()
    found = plan.collectLeaves()
    return plan.toString(), [found.apply(i) for i in range(found.size())]


def test_only_asked_tokens_are_read_and_the_index_is_not_shuffled(spark, small_ranges):
    docs = [(f"d{i:05d}", "", " ".join(f"t{(i * 7 + j) % 997}" for j in range(20))) for i in range(3000)]
    index = lexicon.build_scratch(frame(spark, docs), "uri", fields(), buckets=2)
    total = index.table(spark, "postings").count()
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        search = lexicon.Search(index, asked(spark, [(1, "t5 t600"), (2, "t77")]), KEYS)
        for df in (search.bounds(), search.scores(search.bounds().select("q", "range"))):
            text, found = leaves(df)
            assert len(df.collect()) > 0
            read = [x.metrics().apply("numOutputRows").value() for x in found if "postings" in x.toString()]
            assert read and all(0 < n < total / 10 for n in read), (read, total)  # whole pages of 256 blocks
            assert not moved(text, "_postings"), text
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    index.drop(spark)
