import random
import re

from karst.llm.paragraph_dedup import op9_paragraph_dedup, remove_repeats, repeated_passages

DOCS = "doc_id long, text string"


def planted(seed=7):
    """Texts with passages mid-line, across line breaks, in short lines and in one-line texts; the first place is in the smaller id."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(5000)]
    some = lambda n: rng.choices(vocab, k=n)
    rows, want = [], []
    for k, shape in enumerate(["mid-line", "breaks", "short", "one-line"] * 5):
        p = some(rng.randint(51, 90))
        for half in (0, 1):
            head, tail = some(rng.randint(15, 60)), some(rng.randint(15, 60))
            if shape == "one-line":
                sep = [" "] * 3
            else:
                sep = [" ", "\n" if half and shape == "breaks" else " ", " "]
            if shape == "short":
                body = "\n".join(" ".join(p[i : i + 9]) for i in range(half, len(p), 9))
                body = (p[0] + "\n" if half else "") + body
            elif shape == "breaks" and half:
                body = " ".join(p[:24]) + "\n" + " ".join(p[24:45]) + "\n\n" + " ".join(p[45:])
            else:
                body = " ".join(p)
            text = " ".join(head) + sep[0] + body + sep[2] + " ".join(tail)
            start = len(" ".join(head)) + 1
            rows.append((2 * k + half, text))
            want.append((2 * k + half, start, start + len(body), len(p), 2 * k, 2, bool(half)))
    return rows, want


def test_passages_do_not_depend_on_lines(spark, tmp_path):
    rows, want = planted()
    rows += [(100, None), (101, ""), (102, "w1 w2 w3")]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    got = [(r.doc_id, r.start, r.end, r.n_words, r.kept_doc_id, r.n_in_class, r.removed) for r in repeated_passages(docs).collect()]
    assert sorted(got) == sorted(want)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id for r in op9_paragraph_dedup(spark, str(tmp_path)).collect()} >= {w[0] for w in want}
    out, texts = {r.doc_id: r.text for r in remove_repeats(docs).collect()}, dict(rows)
    for d, a, b, *_, removed in want:
        assert out[d] == (texts[d][:a] + texts[d][b:] if removed else texts[d])
    assert repeated_passages(docs.limit(0)).count() == 0


def test_third_place_shares_more_with_the_second(spark):
    words = [f"a{i}" for i in range(300)]
    rows = [(1, " ".join(words[:60])), (2, " ".join(["x", *words[:70], "y"])), (3, " ".join(["z", *words[:67]])), (3, " ".join(["z", *words[:67]])), (None, " ".join(words[10:64]))]
    got = sorted((r.doc_id or 9, r.start, r.n_words, r.kept_doc_id, r.removed) for r in repeated_passages(spark.createDataFrame(rows, DOCS)).collect())
    # The first place has 60 of the words; what only later places share is found, too, and stays.
    assert [g for g in got if g[4]] == [(2, 2, 60, 1, True), (3, 2, 60, 1, True), (3, 2, 60, 1, True), (9, 0, 50, 1, True)]
    size = lambda d: sum(g[2] for g in got if g[0] == d)
    assert (1, 0, 60, 1, False) in got and size(2) == 67 and size(3) >= 2 * 67 and size(9) == 54


def test_every_long_run_is_found(spark):
    """Brute force: all repeated runs of 50 words of texts that share pieces of each other in any order lie in found passages."""
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(4000)]
    pool = [rng.choices(vocab, k=rng.randint(20, 120)) for _ in range(25)]
    rows = []
    for i in range(150):
        words = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(pool)
            a = rng.randint(0, len(p) // 2)
            words += rng.choices(vocab, k=rng.randint(0, 40)) + p[a : a + rng.randint(5, 120)]
        rows.append((i // 2 if i % 7 else None, rng.choice([" ", "\n", " \u00e9 \t"]).join(words)))
    places = {}
    for k, (_, text) in enumerate(rows):
        w = text.split()
        for i in range(len(w) - 49):
            places.setdefault(tuple(w[i : i + 50]), []).append((k, i))
    want = {(k, j) for v in places.values() if len(v) > 1 for k, i in v for j in range(i, i + 50)}
    assert len(want) > 1000
    docs = spark.createDataFrame([(k, d, t) for k, (d, t) in enumerate(rows)], "row long, doc_id long, text string")
    for block_words in (500, 600_000):
        got = set()
        for r in repeated_passages(docs if block_words == 500 else docs.coalesce(1), id_col="row", block_words=block_words).collect():
            spots = [m.start() for m in re.finditer(r"\S+", rows[r.row][1])]
            got |= {(r.row, j) for j, a in enumerate(spots) if r.start <= a < r.end}
        assert len(want - got) <= (0 if block_words > 500 else 0.005 * len(want)), len(want - got)
    # What went is still somewhere, save words between two repeated runs.
    left = [r.text for r in remove_repeats(docs).collect()]
    words = lambda texts: {w for t in texts for w in t.split()}
    assert sum(map(len, left)) < 0.8 * sum(len(t) for _, t in rows)
    assert len(words(t for _, t in rows) - words(left)) <= 4
