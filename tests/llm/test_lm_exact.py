import math
import random
from collections import Counter

import pytest

from karst.llm.decontaminate import words_of
from karst.llm.lm_score import ADDED, BIGRAM_WEIGHT, score

DOCS, LABELS = "doc_id long, text string, score string, is_target string", "doc_id long, quality int, toxic int"


def brute(rows, target):
    """(id, n_words, background, target) of every row, its own words taken out of both models."""
    texts = [(d, [b"<s>", *words_of(t)]) for d, t in rows]
    uni, bi, n = [Counter(), Counter()], [Counter(), Counter()], [0, 0]
    for d, w in texts:
        for s in (0, 1) if d in target else (0,):
            uni[s].update(w[1:] if len(w) == 1 else w)
            bi[s].update(zip(w, w[1:]))
            n[s] += len(w) - 1
    size = len({x for _, w in texts for x in w[1:]}) + 2
    out = []
    for d, w in texts:
        if len(w) == 1 or not n[1]:
            out.append((d, len(w) - 1, None, None))
            continue
        own, pairs, loss = Counter(w), Counter(zip(w, w[1:])), [0.0, 0.0]
        for h, x in zip(w, w[1:]):
            for s in (0, 1):
                mine = s == 0 or d in target
                p = (uni[s][x] - mine * own[x] + ADDED) / (n[s] - mine * (len(w) - 1) + ADDED * size)
                seen = uni[s][h] - mine * own[h]
                if seen > 0:
                    p = BIGRAM_WEIGHT * (bi[s][h, x] - mine * pairs[h, x]) / seen + (1 - BIGRAM_WEIGHT) * p
                loss[s] -= math.log(p)
        out.append((d, len(w) - 1, *(x / (len(w) - 1) for x in loss)))
    return out


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] is None, round(r[2] or 0, 6), round(r[3] or 0, 6))
    got, want = sorted(((r.doc_id, r.n_words, r.background_loss, r.target_loss) for r in got), key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for x, y in zip(got, want):
        assert x[:2] == y[:2] and (x[2] is None) == (y[2] is None)
        assert x[2] is None or math.isclose(x[2], y[2], rel_tol=1e-9) and math.isclose(x[3], y[3], rel_tol=1e-9)


@pytest.mark.parametrize("block_words", [1, 300, 1_000_000])
def test_scores_equal_brute_force(spark, block_words):
    rng = random.Random(2)
    good, bad = [f"g{i}" for i in range(30)], [f"b{i}" for i in range(30)]
    rows = [(0, None), (1, ""), (2, "!!"), (None, "g1 g2 b1"), (160, "the " * 2000), (161, "\u00e9t\u00e9 \U0001f600 x")]
    rows += [(i, " ".join(rng.choices(good if i % 2 else bad, k=rng.randint(1, 60))) + " the") for i in range(3, 160)]
    rows += [rows[20], (21, "same id, other text g1 g1"), (22, None)]
    labels = [(i, i % 2, 0) for i in range(3, 100)] + [(5, 1, 0), (7, 1, 1), (9, None, None), (None, 1, 0)]
    docs = spark.createDataFrame([(*r, None, None) for r in rows], DOCS).repartition(3)
    got = score(docs, spark.createDataFrame(labels, LABELS), block_words=block_words).collect()
    same(got, brute(rows, {i for i in range(3, 100) if i % 2 and i != 7}))
    by = {r.doc_id: r.score for r in got}
    mean = lambda k: sum(by[i] for i in range(100, 160) if i % 2 == k) / 30
    assert mean(1) > mean(0) + 0.5
    if block_words == 300:
        same(score(docs, spark.createDataFrame([], LABELS)).collect(), brute(rows, set()))
        assert score(docs.limit(0), spark.createDataFrame([], LABELS)).count() == 0


def test_every_word_and_bigram_counts_for_itself(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{rng.randrange(200_000)}" for _ in range(900))) for i in range(120)]
    docs = spark.createDataFrame([(*r, None, None) for r in rows], DOCS).repartition(4)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(120)], LABELS)
    same(score(docs, labels, block_words=20_000).collect(), brute(rows, {i for i in range(120) if i % 2}))


def test_repeated_documents_stand_out(spark):
    """A text that occurs twice is foretold by its other copy."""
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{rng.randrange(3000)}" for _ in range(200))) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(5)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30, 60)], LABELS)
    got = {r.doc_id: r.background_loss for r in score(spark.createDataFrame([(*r, None, None) for r in rows], DOCS), labels).collect()}
    assert max(got[i] for i in range(5)) < min(got[i] for i in range(5, 60)) - 2
