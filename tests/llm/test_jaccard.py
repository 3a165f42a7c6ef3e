import random

import pytest

from karst.llm.jaccard_join import jaccard_components, keep_one

DOCS = "doc_id long, text string, component_id string, item string"


def brute(rows, size=4, percent=85):
    sets = []
    for d, t, *_ in rows:
        w = "".join(c.lower() if c.isascii() else c for c in t or "")
        for c in "\t\n\x0b\x0c\r":
            w = w.replace(c, " ")
        w = [x for x in w.split(" ") if x]
        sets.append((d, {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)):
                k = len(a & b)
                if 100 * k >= percent * (len(a) + len(b) - k):
                    root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((-1 if d is None else d, len(s), least.get(find(i), -1)) for i, (d, s) in enumerate(sets))


def answer(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in df.collect())


def corpus(seed, n=260):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["Ä", "X", "x"]
    passage = [rng.choice(vocab) for _ in range(60)]
    rows, texts = [(0, None, "a", "b"), (1, "", None, None), (2, " \n\t ", None, None), (3, "one two", None, None), (4, "ONE two", None, None), (None, "no id at all", None, None)], []
    for i in range(5, n):
        if texts and rng.random() < 0.6:
            w = list(rng.choice(texts))
            for _ in range(rng.randint(0, max(1, len(w) // 30))):
                k = rng.randrange(len(w) + 1)
                if rng.random() < 0.5 and k < len(w):
                    w[k] = rng.choice(vocab)
                else:
                    w[k:k] = [rng.choice(vocab)]
        else:
            w = [rng.choice(vocab) for _ in range(rng.choice([1, 3, 5, 8, 12, 20, 40, 90, 200, 700]))]
            if rng.random() < 0.4:
                w += passage
        texts.append(w)
        rows.append((i, rng.choice([" ", "\n", "  "]).join(w), None, None))
    rows += [(7, rows[9][1], None, None), (7, rows[9][1], None, None)]
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_equal_brute_force(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, DOCS).repartition(6)
    want = brute(rows)
    assert len({c for _, _, c in want}) < len(want) - 40
    assert answer(jaccard_components(docs)) == want


def test_group_of_near_copies_and_other_threshold(spark):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(300)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(rng.randint(1, 14)):
            w[rng.randrange(300)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w), None, None))
    docs = spark.createDataFrame(rows, DOCS)
    assert answer(jaccard_components(docs)) == brute(rows)
    assert answer(jaccard_components(docs, size=5, percent=80)) == brute(rows, 5, 80)


def test_keep_one_and_empty(spark):
    rows = corpus(4, 120)
    docs = spark.createDataFrame(rows, DOCS)
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    want = {d for d, _, c in brute(rows) if d == c}
    got = [-1 if r.doc_id is None else r.doc_id for r in kept.collect()]
    assert set(got) == want
    assert jaccard_components(docs.limit(0)).count() == 0
    assert len(got) == len(set(got)) + sum(d == -1 for d in got) - (-1 in got)


def test_many_null_and_repeated_ids(spark):
    """Rows without an id of their own are compared like others, each once."""
    rng = random.Random(6)
    texts = [" ".join(rng.choice([f"w{i}" for i in range(300)]) for _ in range(60)) for _ in range(150)]
    rows = [(None if i % 3 else 5, texts[i % 150] + (" more" if i >= 150 else ""), None, None) for i in range(450)]
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    assert answer(jaccard_components(docs)) == brute(rows)
    assert keep_one(docs).count() == len({t for t in texts})
