import random

from karst.llm.paragraph_dedup import remove_repeats, repeated_paragraphs, tuned

DOCS = "doc_id long, text string, item string, is_target string"


def sets(words):
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_paragraph_classes_equal_brute_force(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(3000)]
    para = lambda n: rng.choices(vocab, k=n)
    passages = [para(rng.randint(30, 90)) for _ in range(12)]
    rows = [(0, None, None, None), (1, "", None, None), (2, "short line\n\nshort line", None, None)]
    for i in range(3, 150):
        lines = [para(rng.randint(1, 80)) for _ in range(rng.randint(0, 4))]
        for _ in range(rng.randint(0, 2)):
            p = list(rng.choice(passages))
            for _ in range(rng.randint(0, 2)):
                p[rng.randrange(len(p))] = rng.choice(vocab)
            lines.insert(rng.randint(0, len(lines)), p)
        rows.append((i, "\n".join(" ".join(x) for x in lines), None, None))
    rows += [(200, "é " + " ".join(passages[0]).upper(), None, None), (None, " ".join(passages[1]), None, None), rows[50]]
    flat = []
    for d, t, *_ in rows:
        at = 0
        for k, line in enumerate((t or "").split("\n")):
            w = line.lower().split()
            if len(w) >= 25:
                lead = len(line) - len(line.lstrip())
                flat.append((d, k, at + lead, at + lead + len(line.strip()), sets(w)))
            at += len(line) + 1
    root = list(range(len(flat)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(flat)):
        for j in range(i):
            a, b = flat[i][4], flat[j][4]
            k = len(a & b)
            if 100 * k >= 80 * (len(a) + len(b) - k):
                root[find(i)] = find(j)
    key = lambda d, k: (d is None, d or 0, k)
    members = {}
    for i, (d, k, a, b, _) in enumerate(flat):
        members.setdefault(find(i), []).append((d, k, a, b))
    want = []
    for m in members.values():
        if len(m) > 1:
            m.sort(key=lambda x: key(x[0], x[1]))  # of the repeated row's equal paragraphs one is kept, too
            want += [(key(d, k), a, b, key(m[0][0], m[0][1]), len(m), i > 0) for i, (d, k, a, b) in enumerate(m)]
    docs = spark.createDataFrame(rows, DOCS)
    got = [(key(r.doc_id, r.paragraph), r.start, r.end, key(r.kept_doc_id, r.kept_paragraph), r.n_in_class, r.removed) for r in repeated_paragraphs(docs).collect()]
    assert len(want) > 60 and sorted(got) == sorted(want)
    out = remove_repeats(docs)
    assert out.columns == docs.columns
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[0] is None and texts[2] == "short line\n\nshort line"
    assert texts[200] == "" or any(not x[5] for x in want if x[0][1] == 200)
    assert repeated_paragraphs(docs.limit(0)).count() == 0


def test_bands_are_tuned():
    assert tuned(80) <= 16 and tuned(60) > tuned(80)
