import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from karst.llm.packing import Schedule, pack, sequences
from karst.llm.token_counts import token_counts
from karst.llm.tokens import Encoder, default_vocabulary

DOCS = "doc_id long, text string, source string, n_bytes string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_vocabulary())


def test_encoder_equals_the_library(library):
    enc, rng = Encoder(default_vocabulary()), random.Random(7)
    ranges = [(32, 127), (0, 0x21F), (0x370, 0x47F), (0x2000, 0x20AC), (0x3041, 0x30F6), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3), (0x600, 0x6FF), (0x1F300, 0x1F6FF)]
    texts = ["", " ", "a" * 5000, "\n \n\t  x", "<|endoftext|>", "it's <|endoftext|> we'LL", "x\x85y᠎z", "²³¼ ٣٤", " " * 3000]
    for _ in range(3000):
        low, high = rng.choice(ranges)
        texts.append("".join(rng.choice([chr(rng.randint(low, high)), " ", "a", "'s", "\n", "1"]) for _ in range(rng.randint(1, 40))))
    for t in texts:
        assert enc.ids(t).tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("unit", [" ", "\n", "\t \n", "a", "1", ".", "x\n"])
def test_very_long_runs(library, unit):
    """A million characters without a break for the pattern, alone and between words."""
    enc, run = Encoder(default_vocabulary()), (unit * 1_000_000)[:1_000_000]
    for text in (run, "ab " + run[:20_001] + "c" + run[:19_999]):
        assert enc.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids


def cases():
    rng = random.Random(3)
    rows = [(0, None, "a", "x"), (1, "", None, None), (2, "the cat " * 9000, "a", "x"), (2, "the cat " * 9000, "a", "x"), (None, "no id", "b", "x")]
    for i in range(5, 200):
        rows.append((i, " ".join(rng.choice(["alpha", "beta", "é", "x1"]) for _ in range(rng.randint(0, 300))), rng.choice("aaab"), None))
    return rows


def test_counts_and_cache(spark, library, tmp_path):
    docs, cache = spark.createDataFrame(cases(), DOCS), str(tmp_path / "cache")
    want = sorted((-1 if r[0] is None else r[0], len((r[1] or "").encode()), len(library.encode(r[1] or "").ids)) for r in cases())
    for _ in range(2):
        got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts(docs, cache_path=cache).collect())
        assert got == want
    stored = spark.read.parquet(cache)
    assert stored.count() == len({r[1] or "" for r in cases()}) + 1  # the second run encoded nothing; a repeated row of one id and text is encoded with it
    assert token_counts(docs.limit(0)).count() == 0


def check_pieces(rows, docs, library, window=32 * 1024):
    ids = {}
    for r in docs:
        ids.setdefault(r[0], []).append(np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, 0], dtype="<u4"))
    place = {}
    for r in rows:
        assert 1 <= r.length and r.offset + r.length <= 1024
        place.setdefault(r.sequence_id, []).append((r.offset, r.length))
        raw = next(x for x in ids[r.doc_id] if len(x) == r.doc_tokens)[r.start : r.start + r.length].tobytes()
        assert zlib.crc32(raw) == r.ids_crc32
    total = 0
    for s, pieces in place.items():
        end = 0
        for o, n in sorted(pieces):
            assert o == end
            end += n
        total += end
        assert end == 1024 or s == max(place)
    assert total == sum(len(x) for v in ids.values() for x in v)
    assert sorted(place) == list(range(len(place)))
    cover = {}
    for r in rows:
        cover.setdefault(r.doc_id, []).append((r.start, r.length))
    for d, pieces in cover.items():
        assert sum(n for _, n in pieces) == sum(map(len, ids[d]))


@pytest.mark.parametrize("mixture", [None, {"a": 1.0, "b": 3.0}, {"b": 1.0}])
def test_packing_is_whole(spark, library, mixture):
    docs = spark.createDataFrame(cases(), DOCS).repartition(5)
    rows = pack(docs, mixture=mixture, window_sequences=4).collect()
    check_pieces(rows, cases(), library)
    full = sequences(spark.createDataFrame(rows, pack(docs.limit(0)).schema)).collect()
    assert all(len(r.ids) == 1024 for r in full) and sum(r.n_tokens for r in full) == sum(r.length for r in rows)


def test_windows_hold_the_mixture(spark):
    docs = spark.createDataFrame([(i, "word " * 700, "a" if i % 4 else "b", None) for i in range(400)], DOCS)
    rows = pack(docs, mixture={"a": 1.0, "b": 1.0}, window_sequences=8).collect()
    by = {}
    for r in rows:
        key = (r.sequence_id // 8, r.source)
        by[key] = by.get(key, 0) + r.length
    dry = sum(r.length for r in rows if r.source == "b") * 2 // 8192
    for w in range(dry - 1):
        assert abs(by[(w, "a")] - by[(w, "b")]) <= 4
    assert pack(docs.limit(0)).count() == 0


def test_schedule_inverse():
    for totals, shares in (([5, 0, 1000, 77], [1, 1, 2, 0]), ([1], [1]), ([10**6, 3], [10**6, 3])):
        plan = Schedule(totals, shares, 64)
        for q, n in enumerate(totals):
            spots = [(a, b, p) for a, b, p in plan.places(q, 0, n)] if n else []
            assert sum(b - a for a, b, _ in spots) == n
