import random
import time

import numpy as np
from pyspark.sql import functions as F

from karst.llm.packing import Schedule, op4_packing, pack

DOCS = "doc_id long, text string, source string"


def fluid(totals, shares, window, w):
    """What each queue has given after w windows, by playing the phases one after the other."""
    left, at = np.array(totals, float), 0.0
    shares = np.array(shares, float)
    while (left > 1e-9).any() and at < w:
        live = left > 1e-9
        rate = np.where(live, shares, 0)
        rate = (rate if rate.sum() else np.where(live, np.array(totals, float), 0)) * window
        rate = rate / (rate.sum() / window)
        with np.errstate(divide="ignore", invalid="ignore"):
            length = min(np.nanmin(np.where(rate > 0, left / rate, np.inf)), w - at)
        left, at = left - rate * length, at + length
    return np.array(totals) - left


def test_quotas_equal_the_phases_played_through():
    rng = random.Random(1)
    for _ in range(60):
        n = rng.randint(1, 9)
        totals = [rng.choice([0, 1, 7, 300, 5000]) for _ in range(n)]
        shares = [rng.choice([0, 0.1, 1, 2.5]) for _ in range(n)]
        plan = Schedule(totals, shares, 64)
        before = np.zeros(n, int)
        for w in range(plan.windows + 2):
            now = plan.quota(w)
            assert (now >= before).all() and np.abs(now - fluid(totals, shares, 64, w)).max() <= 1.01, (totals, shares, w)
            assert abs(int(now.sum()) - min(64 * w, sum(totals))) <= n
            before = now
        assert before.tolist() == totals
        for q in range(n):
            spots = list(plan.places(q, 0, totals[q])) if totals[q] else []
            assert [a for a, _, _ in spots] == [0, *(b for _, b, _ in spots)][:-1] if spots else not totals[q]


def test_places_are_the_quotas_added_up():
    rng = random.Random(2)
    for _ in range(60):
        n = rng.randint(1, 12)
        totals = [rng.choice([0, 1, 7, 300, 301, 5000]) for _ in range(n)]
        shares = [rng.choice([0, 0, 1, 1, 2.5]) for _ in range(n)]
        plan = Schedule(totals, shares, 64)
        order = np.argsort(plan.rank)
        assert sorted(plan.rank) == list(range(n))
        for w in range(plan.windows + 2):
            given = np.append(0, np.cumsum(plan.quota(w)[order]))
            assert [plan.given_before(r, w) for r in range(n + 1)] == given.tolist(), (totals, shares, w)
        taken = sorted((place, place + b - a) for q in range(n) for a, b, place in plan.places(q, 0, totals[q]))
        assert [a for a, _ in taken] == [0, *(b for _, b in taken)][: len(taken)] and (not taken or taken[-1][1] == sum(totals))


def test_placing_does_not_grow_with_the_sources():
    """A document of 1,000 tokens in the last queue, at the same windows: as many steps with 100,000 sources as with 1,000."""
    spent = {}
    for n in (1_000, 100_000):
        plan = Schedule([5_000 + i % 977 for i in range(n)], [1.0] * n, 32 * 1024)
        began = time.time()
        spots = list(plan.places(n - 1, 2_000, 2_400))
        spent[n] = (time.time() - began) / len(spots)
        assert sum(b - a for a, b, _ in spots) == 400
    assert spent[100_000] < 5 * spent[1_000] + 1e-4, spent


def test_many_queues_need_little():
    n, began = 50_000, time.time()
    plan = Schedule([100 + i for i in range(n)], [1.0 + i % 7 for i in range(n)], 32 * 1024)
    assert plan.quota(plan.windows - 1).sum() <= sum(100 + i for i in range(n)) and time.time() - began < 5


def test_small_source_of_a_mixture_has_its_share(spark):
    rows = [(i, "some words of a text " * 20, "ab"[i % 2]) for i in range(60)] + [(100 + i, "some words of a text " * 20, "c") for i in range(20)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = pack(docs, mixture={"a": 1.0, "b": 1.0, "c": 2.0}, sequence_tokens=128, window_sequences=4).collect()
    early = [r for r in got if r.sequence_id < 8]
    share = sum(r.length for r in early if r.source == "c") / sum(r.length for r in early)
    assert 0.4 < share < 0.6, share


def test_the_query_fills_every_window_with_its_mixture(spark):
    """Every source that is not dry yet has the same tokens in each window of 32 sequences, deficits of less than a token apart."""
    d = "/root/testdata/sf0.01"
    got = op4_packing(spark, d)
    assert "source" in got.columns
    rows = got.groupBy(F.floor(F.col("sequence_id") / 32).alias("w"), "source").agg(F.sum("length").alias("n")).collect()
    totals, by = {}, {}
    for r in rows:
        totals[r.source] = totals.get(r.source, 0) + r.n
        by.setdefault(r.w, {})[r.source] = r.n
    given = dict.fromkeys(totals, 0)
    for w in sorted(by)[:-1]:
        # Those that neither run dry here nor ran dry before.
        live = [by[w].get(s, 0) for s in totals if given[s] + by[w].get(s, 0) < totals[s]]
        assert len(live) < 2 or max(live) - min(live) <= len(totals) + 2, (w, by[w])
        for s in totals:
            given[s] += by[w].get(s, 0)
