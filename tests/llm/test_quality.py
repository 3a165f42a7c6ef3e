import random
import re
from collections import Counter

from karst.llm.quality import quality

DOCS = "doc_id long, text string, lang string, source string, kept string, bucket string, low string, high string, _lang string, _low string"


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    seen = Counter(tuple(words[i : i + 8]) for i in range(n - 7))
    hit = set()
    for i in range(n - 7):
        if seen[tuple(words[i : i + 8])] > 1:
            hit |= set(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit), n < 20 or 100 * len(hit) > 30 * n)


def corpus():
    rng = random.Random(8)
    vocab = ["alpha", "beta", "gamma", "delta", "é", " x", "😀", "word."]
    rows = [(0, None, "en", "a"), (1, "", None, None), (2, " \n\x0b\x0c\r\t", "en", "a"), (3, "x" * 40000, "en", "a"), (4, "a b " * 30000, "en", "a"), (None, "a b c", "en", "a")]
    for i in range(5, 900):
        w = [rng.choice(vocab) + rng.choice(["", "", "s", "ly"]) + str(rng.randint(0, 99)) for _ in range(rng.randint(15, 120))]
        text = "".join(x + rng.choice([" ", " ", " ", "\n", "\n\n", "\t"]) for x in w)
        if i % 9 == 0:
            text += "\n" + text[: rng.randint(10, len(text))]
        if i % 50 == 1:
            text = text.replace(" ", " *** ")
        if i % 50 == 2:
            text = text.upper()
        rows.append((i, text, rng.choice(["en", "de", None]), rng.choice(["hot"] * 8 + ["rare"])))
    rows.append(rows[30])
    return [(*r, *"xyzuvw") for r in rows]


def test_base_equals_brute_force_and_outliers_go(spark):
    rows = corpus()
    got = quality(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    key = lambda r: (r.doc_id is None, r.doc_id or 0)
    texts = {r[0]: r[1] for r in rows}
    odd = {r[0] for r in rows if r[0] is not None and r[0] > 4 and r[0] % 50 in (1, 2)}
    for r in sorted(got, key=key):
        want = base(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want, r.doc_id
        if want[-1] or r.doc_id in odd:
            assert not r.kept
        else:
            assert r.kept, r.doc_id


def test_empty(spark):
    out = quality(spark.createDataFrame([], DOCS))
    assert out.count() == 0 and "kept" in out.columns
