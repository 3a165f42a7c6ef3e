import random
import re

import pytest

from karst.llm.decontaminate import contamination, decontaminate

DOCS = "doc_id long, text string, n_words string, hit_runs string, _row string, item_id string"


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items):
    """(id, words, hit words, items, full) of every row."""
    out = []
    for d, text, *_ in rows:
        w = split(text)
        hit, found, full = set(), set(), False
        for name, t in items:
            g = split(t)
            n = min(10, len(g))
            grams = {tuple(g[i : i + n]) for i in range(len(g) - n + 1)} if g else set()
            for i in range(len(w) - n + 1 if n else 0):
                if tuple(w[i : i + n]) in grams:
                    hit |= set(range(i, i + n))
                    found.add("null" if name is None else str(name))
                    full |= n == 10
        out.append((-1 if d is None else d, len(w), tuple(sorted(hit)), tuple(sorted(found)), full))
    return sorted(out)


def cases():
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(60)] + ["é", "X"]
    items = [(k, " ".join(rng.choices(vocab, k=rng.choice([0, 1, 2, 9, 10, 11, 40])))) for k in range(30)]
    items += [(3, None), (None, " ".join(rng.choices(vocab, k=25))), (7, items[5][1]), (8, "same same same same same same same same same same same same")]
    rows = [(0, None), (1, ""), (2, " ,.; "), (2, "w1 w2"), (3, "long " * 200_000), (4, "same " * 5000)]
    for i in range(5, 250):
        words = rng.choices(vocab, k=rng.randint(0, 120))
        if i % 3 == 0:
            g = split(rng.choice(items)[1])
            k = rng.randint(0, len(words))
            words[k:k] = g[rng.randint(0, 5) :]
        rows.append((i // 2 if i % 5 else None, rng.choice([" ", ", ", "\n"]).join(words)))
    rows += [rows[20], rows[20]]
    return [(*r, "a", "b", "c", "d") for r in rows], items


@pytest.mark.parametrize("block_bytes", [1, 300, 1 << 24])
def test_hits_equal_brute_force(spark, block_bytes):
    rows, items = cases()
    docs, benchmark = spark.createDataFrame(rows, DOCS).repartition(4), spark.createDataFrame(items, "item_id long, text string")
    got = contamination(docs, benchmark, block_bytes=block_bytes)
    assert got.columns == ["doc_id", "n_words", "hit_runs", "item_ids", "full_window"]
    words = lambda r: tuple(i for a, b in zip(r[::2], r[1::2], strict=True) for i in range(a, b))
    own = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, words(r.hit_runs), tuple(r.item_ids), r.full_window) for r in got.collect())
    assert own == brute(rows, items)


@pytest.mark.parametrize("block_bytes", [300, 1 << 24])
def test_removal(spark, block_bytes):
    rows, items = cases()
    docs, benchmark = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")
    found = brute(rows, items)
    kept = decontaminate(docs, benchmark, block_bytes=block_bytes)
    assert kept.columns == docs.columns and kept.count() == sum(not f[-1] for f in found)
    cut = decontaminate(docs, benchmark, remove="spans", block_bytes=block_bytes).collect()
    assert len(cut) == len(rows) and sorted((-1 if r.doc_id is None else r.doc_id, len(split(r.text))) for r in cut) == sorted((f[0], f[1] - len(f[2])) for f in found)
    assert {r.n_words for r in cut} == {"a"} and next(r.text for r in cut if r.doc_id == 0) is None
    assert decontaminate(docs.limit(0), benchmark, block_bytes=block_bytes).count() == 0
    assert decontaminate(docs, benchmark.limit(0), block_bytes=block_bytes).count() == len(rows)
    with pytest.raises(ValueError):
        decontaminate(docs, benchmark, remove="words")
