import random
import re
import time

import pytest

from karst.llm.common import written
from karst.llm.pii import CARD, EMAIL, IP, PHONE, learn, personal_data, redact

KINDS = ["email", "ip", "card", "phone"]
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        s += x - 9 if x > 9 else x
    return s % 10 == 0


def brute(text):
    out = []
    for k, p in PLAIN.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if k == "ip" else True, "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[k]
            if ok:
                out.append((m.start(), KINDS.index(k), m.end(), k))
    return sorted(out)


TEXTS = [
    None,
    "",
    "clean text with numbers 12 and 1999",
    "mail a.b@c-d.example.com, and x@y or a@b@c.d; a@b.c+d@e.f end.",
    "ip 1.2.3.4 and 256.1.1.1 and 01.002.0003.255 and 1.2.3.4.5.6.7.8 v1.2.3",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112, 4539578763621486 and 12345678901234",
    "call +1 (938) 555-0822 now, or +49 30 123456 +1 2 +1-800-555-0199 (x)",
    "é😀ñ a@b.cd 😀 +1 (938) 555-0822 ü 10.0.0.1",
    "9" * 30000,
    "a" * 100000 + " 1.1.1.1",
    "+" + "1 " * 20000,
    "x@y.z " * 300,
]


def rows(spark):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate([*TEXTS, TEXTS[3]])], "doc_id long, text string, pii string, email string")


def test_base_spans_equal_plain_patterns(spark):
    got = {r.doc_id: [(s.start, s.rank, s.end, s.kind) for s in r.pii if not s.added] for r in personal_data(rows(spark).select("doc_id", "text")).collect()}
    for i, t in enumerate([*TEXTS, TEXTS[3]]):
        assert got[i] == brute(t), (i, got[i][:5], brute(t)[:5])


def test_spans_are_added_and_redacted(spark):
    loose = [(i, f"please call tel ({201 + i}) 555-01{10 + i} or write to me") for i in range(40)]
    loose += [(100 + i, f"order part ({201 + i}) 555-01{10 + i} is shipped") for i in range(40)]
    loose += [(200, "name Dr. Anna Schmidt here"), (201, "my ssn 123-45-6789"), (202, "write joe [at] mail [dot] com")]
    out = {r.doc_id: r.text for r in redact(spark.createDataFrame(loose, "doc_id long, text string")).collect()}
    assert sum("<PHONE>" in out[i] for i in range(40)) >= 36
    assert not any("<PHONE>" in out[100 + i] for i in range(40)), [out[100 + i] for i in range(3)]
    assert out[202] == "write <EMAIL>"
    kept = redact(rows(spark))
    assert kept.columns == ["doc_id", "text", "pii", "email"]
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert texts[0] is None and texts[2] == TEXTS[2]
    assert texts[7] == "é😀ñ <EMAIL> 😀 <PHONE> ü <IP>"
    assert personal_data(rows(spark).limit(0)).count() == 0


def test_reliabilities_follow_agreement():
    good = [("phone", False, [1, 0, 1, 1, 0, 0], 1, 900), ("phone", False, [0, -1, -1, 0, -1, 0], 1, 900)]
    bad = [("phone", False, [1, 0, 1, 1, 0, 0], 1, 900), ("phone", False, [0, -1, -1, 1, -1, 0], 1, 900)]
    assert learn(good)[1]["context_for"] > 0.9 > learn(bad)[1]["context_for"]
    assert learn([])[0].size == 0


@pytest.mark.parametrize("text", TEXTS[2:8])
def test_patterns_agree_in_python(text):
    fits = lambda m: 14 <= len(re.sub("[^0-9]", "", m.group())) <= 19
    for own, plain in ((EMAIL, PLAIN["email"]), (IP, PLAIN["ip"]), (CARD, PLAIN["card"]), (PHONE, PLAIN["phone"])):
        own = own.replace(r"(?:(?<![A-Za-z0-9._%+-])|\G)", "")
        assert [m.span() for m in re.finditer(own, text)] == [m.span() for m in re.finditer(plain, text) if plain != PLAIN["card"] or fits(m)]


def test_cards_are_whole_runs():
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice("0123456789" * 3 + "  -- x") for _ in range(rng.randint(1, 120)))
        plain = [m.span() for m in re.finditer(PLAIN["card"], text) if 14 <= len(re.sub("[^0-9]", "", m.group())) <= 19]
        assert [m.span() for m in re.finditer(CARD, text)] == plain, text


def test_many_matches_take_linear_time(spark):
    """Positions and texts of tens of thousands of matches, over many pieces."""
    n = 20_000
    long = [
        " ".join(f"é{i}@mail.example.com" for i in range(n)),
        " ".join(str(i) for i in range(5 * n)),
        ", ".join("4539578763621486" for _ in range(n)),
        " x ".join(f"10.0.{i % 256}.1 call tel ({201 + i % 700}) 555-0100" for i in range(n // 4)),
        "w " * 999 + "a@b.cd " * 256 + "+1 (938) 555-0822",
        "a@b.cd " * 257,
    ]
    docs = written(spark.createDataFrame(list(enumerate(long)), "doc_id long, text string").repartition(4), "long")
    began = time.time()
    got = {r.doc_id: [(s.start, s.rank, s.end, s.kind) for s in r.pii if not s.added] for r in personal_data(docs).collect()}
    for i, t in enumerate(long):
        assert got[i] == brute(t), i
    out = {r.doc_id: r.text for r in redact(docs).collect()}
    assert out[0] == " ".join(["é<EMAIL>"] * n) and out[1] == long[1] and out[2] == ", ".join(["<CARD>"] * n)
    assert out[4] == "w " * 999 + "<EMAIL> " * 256 + "<PHONE>" and out[5] == "<EMAIL> " * 257
    assert time.time() - began < 120
