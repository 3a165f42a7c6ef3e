import random

import numpy as np
import pytest

from karst.llm.linkage import mix
from karst.llm.minhash_dedup import BINS, band_keys, keep_first, near_duplicates, signature

from test_jaccard import DOCS, answer, brute, corpus


def hashes(values):
    return np.unique(mix(np.array(sorted(values), np.uint64) + np.uint64(7)))


def test_signature_is_the_least_of_each_bin_and_is_densified():
    s = hashes(range(4000))
    sig = signature(s)
    for b in range(BINS):
        assert sig[b] == min(x for x in s.tolist() if (x >> 32) * BINS >> 32 == b)
    few = hashes(range(9))
    sig = signature(few)
    assert set(sig.tolist()) == set(few.tolist()) and len(sig) == BINS  # every value stays, no bin is empty


@pytest.mark.parametrize("n", [8, 30, 200, 3000])
def test_share_of_equal_bins_estimates_similarity(n):
    """Over many pairs, of sets smaller and larger than the bins."""
    rng, got = random.Random(n), []
    for k in range(60):
        base = rng.sample(range(10**9), n)
        other = base[: n * 3 // 4] + rng.sample(range(10**9, 2 * 10**9), n - n * 3 // 4)
        got.append(float(np.mean(signature(hashes(base)) == signature(hashes(other)))))
    want = (n * 3 // 4) / (2 * n - n * 3 // 4)
    assert abs(np.mean(got) - want) < 0.06


def test_recall_of_pairs_at_the_threshold():
    rng, missed = random.Random(3), 0
    for n in [7, 8, 13, 20, 40, 100, 400] * 60:
        base = rng.sample(range(10**9), n)
        d = max(1, n * 15 // 115 // 2)  # both lack d of the other's
        a, b = (base[d:], base[:-d]) if n >= 13 else (base, base[1:])
        x, y = (list(band_keys(hashes(v), 85)) for v in (a, b))
        missed += not (x and y) or not np.any(x[0][1] == y[0][1])
    assert missed == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    rows = corpus(seed)
    found = near_duplicates(spark.createDataFrame(rows, DOCS).repartition(6))
    assert answer(found) == brute(rows, 3, 85)
    assert found.where("kept <> (doc_id <=> component_id)").count() == 0
    assert near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_chain_in_one_bucket_and_one_row_of_each(spark):
    """Texts that differ word by word: the ends of the chain do not link, its neighbours do."""
    base = [f"b{i}" for i in range(120)]
    rows = [(i, " ".join([*(f"x{j}" for j in range(i)), *base[i:]]), None, None) for i in range(60)]
    docs = spark.createDataFrame(rows, DOCS)
    want = brute(rows, 3, 85)
    assert answer(near_duplicates(docs)) == want
    assert sorted(r.doc_id for r in keep_first(docs).collect()) == sorted({c for _, _, c in want})
