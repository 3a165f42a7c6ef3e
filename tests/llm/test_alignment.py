import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from karst.llm.alignment import aligner, alignment, default_vocabulary, piece_vocabulary, pieces_of_text


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def spans(libraries, text):
    """(id, bytes) of either side, by the libraries alone."""
    a, b = libraries
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in plain)}
    left = [(i, bytes(byte[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = [(i, bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    return left, right


def brute(libraries, texts):
    """By two pointers over one token at a time."""
    rows, count = [], Counter()
    for t in texts:
        left, right = spans(libraries, t) if t else ([], [])
        whole = (" " + (t or "")).encode()
        if not t or b"".join(x for _, x in left) != whole or b"".join(x for _, x in right) != whole:
            rows.append((0, 0, [], []))
            continue
        groups, links, ga, gb, i, j, x, y = [], [], [], [], 0, 0, 0, 0
        while i < len(left) or j < len(right):
            if x <= y and i < len(left):
                ga.append(left[i][0])
                x += len(left[i][1])
                i += 1
            else:
                gb.append(right[j][0])
                y += len(right[j][1])
                j += 1
            if x == y:
                groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
                links.append((ga[-1], gb[-1]))
                ga, gb = [], []
        rows.append((len(left), len(right), groups, links))
        count.update(links)
    most_a, most_b = Counter(), Counter()
    for (a, b), n in count.items():
        most_a[a], most_b[b] = max(n, most_a[a]), max(n, most_b[b])
    out = []
    for n_a, n_b, groups, links in rows:
        best, best_a = sum(count[p] == most_b[p[1]] for p in links), sum(count[p] == most_a[p[0]] for p in links)
        out.append((n_a, n_b, len(groups), len(links), best, best_a, sum(count[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    return out, count


def texts():
    rng = random.Random(8)
    words = ["the", "Über", "naïve", "日本語", "emoji😀", "a\tb", "<|endoftext|>", "</s>", "<0x41>", "mixed١٢٣", "don't", "1234567", "x" * 30, "é", "ﬁ", "\x00", "\xa0", "\r\n"]
    out = [None, "", " ", "  ", "a", "▁", "a▁b", " lead", "trail ", "two  spaces", "<s>", "<unk>", "\n\n", "�", "\U0010ffff"]
    out += [" ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 20, 200]))) for _ in range(60)]
    return [*out, *out[20:30]]


def test_documents_equal_brute_force(spark, libraries):
    own = texts()
    want, count = brute(libraries, own)
    assert any(t and not w[0] for t, w in zip(own, want, strict=True))  # what a side does not give back
    docs = spark.createDataFrame([(i, t, "z", "z") for i, t in enumerate(own)], "doc_id long, text string, block string, n_a string").repartition(5)
    found, pairs = alignment(docs)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "best_a", "count_sum", "groups_sha256"]
    assert [tuple(r)[1:] for r in sorted(found.collect())] == want
    assert {(r.a, r.b): r["count"] for r in pairs.collect()} == count
    assert alignment(docs.limit(0))[0].count() == 0


def test_repeated_and_null_ids(spark, libraries):
    rows = [(None, "one two"), (None, "one two"), (3, "one"), (3, None)]
    want, _ = brute(libraries, [t for _, t in rows])
    found = alignment(spark.createDataFrame(rows, "doc_id long, text string"))[0].select(F.coalesce("doc_id", F.lit(-1)), "n_a", "count_sum").collect()
    assert sorted(map(tuple, found)) == sorted((-1 if d is None else d, w[0], w[6]) for (d, _), w in zip(rows, want, strict=True))


def test_cut_texts_encode_like_whole_ones(libraries):
    rng = random.Random(2)
    for _ in range(30):
        t = "".join(rng.choice(["word", " ", "  ", "\n", "é", ".", " x "]) for _ in range(400))
        parts = pieces_of_text(t, 50)
        assert " ".join(parts) == t and [i for p in parts for i in libraries[1].encode(p)] == libraries[1].encode(t)
    assert aligner(default_vocabulary(), piece_vocabulary()).cuts


def test_blocks_end_where_links_do(spark, libraries, monkeypatch):
    import karst.llm.alignment as module

    monkeypatch.setattr(module, "LINKS", 7)  # for this process: blocks are cut in a direct call
    own = [t for t in texts() if t][:25]
    import pyarrow as pa
    from pyspark import TaskContext

    monkeypatch.setattr(TaskContext, "get", staticmethod(lambda: type("C", (), {"partitionId": lambda self: 0})()))
    out = list(module._blocks(default_vocabulary(), piece_vocabulary())(iter([pa.RecordBatch.from_arrays([pa.array(range(len(own))), pa.array(own)], names=["id", "t"])])))
    assert [i for b in out for i in b.column("ids")[0].as_py()] == list(range(len(own))) and len(out) > 5
    pairs = Counter()
    for b in module._pairs(iter(out)):
        for r in b.to_pylist():
            pairs[r["a"], r["b"]] += r["n"]
    assert pairs == brute(libraries, own)[1]
