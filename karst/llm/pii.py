r"""Operator 10, personal data by weak supervision (DataFrame functions only).

Four base patterns give spans that always stay.  Looser candidates (phone numbers without a plus
sign, spelled-out addresses, identity numbers, persons after titles) and the base spans are voted
on by labelers: format patterns, gazetteers and context words.  Expectation-maximisation over the counts of
vote patterns estimates how reliable each labeler is, its posteriors train a logistic span
classifier on votes and shape, and candidates that it is sure of are added.

Only counts of vote-and-shape patterns reach the driver; their number is bounded by the code
(kinds x 3**labelers x shapes), not by the data.  A position is where a match stands: lengths of what ``split``
leaves between the matches and of the matches add up to it, in code points.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from karst.llm.common import free_name, sheltered, table, written

KINDS = ["email", "ip", "card", "phone"]
ADDED = ["id", "person"]
RANK = {k: i for i, k in enumerate([*KINDS, *ADDED])}

#: The base patterns, with possessive repetition and guards against starts inside of a run that has failed
#: already, so that long runs take linear time and no stack; their matches are those of the plain forms, for cards
#: without those of too few or too many digits, which are dropped anyway.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Candidates that the base patterns miss.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++\x20?[\[(]dot[\])]\x20?[A-Za-z]{2,10}",
    "phone": r"(?<![0-9+.\x2F-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9-])",
    "id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "person": r"(?<![\p{L}])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sra)\.?\x20\p{Lu}\p{Ll}{1,20}(?:\x20\p{Lu}\p{Ll}{1,20})?",
}
#: Gazetteers and context words of the labelers.
FIRST_NAMES = "Anna Maria John James Mary Peter Paul Laura Julia Thomas Michael David Sarah Hans Klaus Petra Jean Pierre Marie Claire Juan Carmen Jose Luis Ana".split()
TOP_DOMAINS = "com net org edu gov io de fr es uk it nl eu".split()
FOR_WORDS = "call tel telephone phone fax mobile cell contact email e-mail mail reach write ssn social id identity name dear signed anruf telefon téléphone correo teléfono llamar".split()
AGAINST_WORDS = "order invoice version part isbn price serial model section chapter figure total page item build".split()
#: A candidate is added from this probability.
SURE = 0.9
LABELERS = ["strict_form", "odd_form", "gazetteer", "context_for", "context_against", "company"]

_SPAN = "array<struct<start:long,end:long,value:string,before:string>>"
#: Matches that one fold puts in place: it copies what it has for every match, so longer lists are taken in pieces.
PIECE = 256
#: Code points before a match in which context words are sought.
CONTEXT = 30


def _let(value: Column, then) -> Column:
    """then(value), with value worked out once."""
    return F.transform(F.array(value), then)[0]


def _pieces_of(n: Column) -> Column:
    return F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(PIECE))


def matches(text: Column, pattern: str) -> Column:
    """array of (start, end, value, before), in code points, end exclusive: the leftmost matches that do not overlap; before: what stands before one, CONTEXT long."""
    none = F.lit(None).cast(_SPAN)

    def step(a: Column, e: Column) -> Column:
        begin = a["at"] + F.length(e["gap"])
        end = begin + F.length(e["m"])
        before = F.right(F.concat(a["tail"], e["gap"]), F.lit(CONTEXT))
        span = F.struct(begin.alias("start"), end.alias("end"), e["m"].alias("value"), before.alias("before"))
        return F.when(e["m"].isNull(), a).otherwise(F.struct(end.alias("at"), F.right(F.concat(before, e["m"]), F.lit(CONTEXT)).alias("tail"), F.concat(a["out"], F.array(span)).alias("out")))

    def fold(pairs: Column, at: Column, tail: Column) -> Column:
        return F.aggregate(pairs, F.struct(at.alias("at"), tail.alias("tail"), F.array().cast(_SPAN).alias("out")), step, lambda a: a["out"])

    def in_pieces(pairs: Column) -> Column:
        zero, part = F.lit(0).cast("long"), lambda s: F.slice(pairs, s + 1, F.lit(PIECE))
        starts = _pieces_of(F.size(pairs))
        long = F.transform(starts, lambda s: F.aggregate(part(s), zero, lambda n, e: n + F.length(e["gap"]) + F.coalesce(F.length(e["m"]), F.lit(0))))
        begin = F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("out"))
        offsets = F.aggregate(long, begin, lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])
        # A match has a character at least, so this many before a piece hold all of its context.
        last = lambda s: F.transform(F.slice(pairs, F.greatest(s - CONTEXT, F.lit(0)) + 1, F.least(s, F.lit(CONTEXT))), lambda e: F.concat(e["gap"], e["m"]))
        return F.flatten(F.zip_with(starts, offsets, lambda s, at: fold(part(s), at, F.right(F.array_join(last(s), ""), F.lit(CONTEXT)))))

    def placed(found: Column) -> Column:
        pairs = F.zip_with(F.split(text, pattern, -1), found, lambda gap, m: F.struct(gap.alias("gap"), m.alias("m")))
        return F.when(F.size(found) < PIECE, fold(pairs, F.lit(0).cast("long"), F.lit(""))).otherwise(_let(pairs, in_pieces))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return _let(found, lambda f: F.when(F.size(f) > 0, placed(f)).otherwise(F.coalesce(none, F.array().cast(_SPAN))))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(s: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return s + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of each base kind; failing matches are dropped and not retried."""
    octet = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"
    n = lambda s: F.length(_digits(s["value"]))
    empty = F.array().cast(_SPAN)
    return {
        "email": F.when(F.contains(text, F.lit("@")), matches(text, EMAIL)).otherwise(empty),
        "ip": F.filter(matches(text, IP), lambda s: F.forall(F.split(s["value"], r"\."), lambda p: p.rlike(octet))),
        "card": F.filter(matches(text, CARD), lambda s: F.when(n(s).between(14, 19), _luhn(_digits(s["value"]))).otherwise(F.lit(False))),
        "phone": F.when(F.contains(text, F.lit("+")), F.filter(matches(text, PHONE), lambda s: n(s).between(10, 15))).otherwise(empty),
    }


def _votes(kind: Column, s: Column, strict: bool, n_base: Column) -> list[Column]:
    value, yes, no = s["value"], F.lit(1), F.lit(-1)
    before = F.lower(s["before"])
    word = lambda words: before.rlike(r"(?<![\p{L}\p{N}])(?:" + "|".join(w.replace("-", "\\-") for w in words) + r")(?![\p{L}\p{N}])")
    digits = _digits(value)
    area = F.when(value.startswith("+"), F.substring(digits, F.length(digits) - 9, F.lit(10))).otherwise(digits)
    gazetteer = (
        F.when(kind == "person", F.when(value.rlike(r"\x20(?:" + "|".join(FIRST_NAMES) + r")(?![\p{L}])"), yes).otherwise(F.lit(0)))
        .when(kind == "email", F.when(F.lower(value).rlike(r"(?:\.|[\])]\x20?)(?:" + "|".join(TOP_DOMAINS) + ")$"), yes).otherwise(no))
        .when(kind == "phone", F.when(area.rlike("^[2-9][0-9]{2}[2-9]"), F.lit(0)).otherwise(no))  # an area code is needed, but proves nothing
        .when(kind == "id", F.when(value.rlike("^(?:000|666|9)"), no).otherwise(F.lit(0)))
        .otherwise(F.lit(0))
    )
    return [
        yes if strict else F.when((kind == "phone") & value.rlike(r"^\([0-9]{3}\)\x20"), yes).when((kind == "email") | (kind == "person"), yes).otherwise(F.lit(0)),
        F.when(_digits(value).rlike(r"^([0-9])\1*$") | before.rlike(r"[$€£#=]\x20?$"), no).otherwise(F.lit(0)),
        gazetteer,
        F.when(word(FOR_WORDS), yes).otherwise(F.lit(0)),
        F.when(word(AGAINST_WORDS), no).otherwise(F.lit(0)),
        F.when(n_base > 1, yes).otherwise(F.lit(0)),
    ]


def found_in(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with ``_base``: (start, rank, end, kind, added) of base spans, ``_loose``: the same of candidates, and ``_cases``: votes and shapes of both."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.withColumns({f"_{k}": c for k, c in base_spans(text).items()})
    any_loose = "|".join(f"(?:{p})" for p in LOOSE.values())
    docs = docs.withColumn("_found", matches(text, any_loose))
    n_base = sum((F.size(f"_{k}") for k in KINDS), F.lit(0))

    def kind_of(s: Column) -> Column:
        out = F.lit("person")
        for k in ("id", "phone", "email"):
            out = F.when(s["value"].rlike("^(?:" + LOOSE[k] + ")$"), F.lit(k)).otherwise(out)
        return out

    def case(s: Column, kind: Column, strict: bool) -> Column:
        votes = F.array(*[v.cast("int") for v in _votes(kind, s, strict, n_base)])
        shape = F.when(F.length(s["value"]) < 12, F.lit(0)).when(F.length(s["value"]) < 20, F.lit(1)).otherwise(F.lit(2))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), kind.alias("kind"), votes.alias("votes"), shape.alias("shape"), F.lit(strict).alias("strict"))

    def strict_cases(k: str) -> Column:
        return F.transform(f"_{k}", lambda s: case(s, F.lit(k), True))

    strict = [strict_cases(k) for k in KINDS]
    loose = F.transform("_found", lambda s: case(s, kind_of(s), False))
    cases = docs.withColumn("_cases", F.concat(*strict, loose)).drop(*[f"_{k}" for k in KINDS], "_found")
    # A candidate that touches a base span is that span, told less well.
    base = F.filter("_cases", lambda c: c["strict"])
    touches = lambda b, start, end: (b["start"] < end) & (start < b["end"])

    def apart(some: Column) -> Column:
        """Those of a piece of the candidates, in order, that touch no base span; only spans within the piece's reach are tried on each."""
        start, end = some[0]["start"], F.array_max(F.transform(some, lambda c: c["end"]))
        return _let(F.filter(base, lambda b: touches(b, start, end)), lambda near: F.filter(some, lambda c: ~F.exists(near, lambda b: touches(b, c["start"], c["end"]))))

    rest = F.filter("_cases", lambda c: ~c["strict"])
    free = F.concat(base, _let(rest, lambda r: F.flatten(F.transform(_pieces_of(F.size(r)), lambda s: apart(F.slice(r, s + 1, F.lit(PIECE)))))))
    return cases.withColumn("_cases", F.when(F.size(base) == F.size("_cases"), F.col("_cases")).otherwise(free))


def learn(patterns: list[tuple[str, bool, list[int], int, int]], rounds: int = 60) -> tuple[np.ndarray, dict]:
    """(kind, strict, votes, shape, count) -> weights of the classifier, reliabilities of the labelers.

    The reliabilities have a Beta(15, 5) prior, so that few or one-sided votes leave them near 3/4, and labelers
    are taken to be better than chance.  Candidates start at even odds, so that votes alone decide.
    """
    kinds = list(RANK)
    if not patterns:
        return np.zeros(0), {}
    votes = np.array([p[2] for p in patterns], dtype=float)
    count = np.array([p[4] for p in patterns], dtype=float)
    kind = np.array([kinds.index(p[0]) for p in patterns])
    strict = np.array([p[1] for p in patterns])
    right = np.full(votes.shape[1], 0.75)
    for _ in range(rounds):
        odds = votes @ np.log(right / (1 - right))
        q = np.where(strict, 1.0, 1 / (1 + np.exp(-odds)))
        agree = ((votes > 0) * (q * count)[:, None] + (votes < 0) * ((1 - q) * count)[:, None]).sum(0)
        given = ((votes != 0) * count[:, None]).sum(0)
        right = np.clip((15 + agree) / (20 + given), 0.55, 0.98)
    x = _features(kind, votes, np.array([p[3] for p in patterns]), len(kinds))
    w = np.zeros(x.shape[1])
    for _ in range(40):  # Newton steps of the logistic loss with soft labels
        p = 1 / (1 + np.exp(-x @ w))
        grad = x.T @ (count * (p - q)) + 0.5 * w
        hess = (x * (count * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(x.shape[1])
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
    return w, dict(zip(LABELERS, right.tolist(), strict=True))


def _features(kind: np.ndarray, votes: np.ndarray, shape: np.ndarray, n_kinds: int) -> np.ndarray:
    return np.concatenate([np.eye(n_kinds)[kind], votes, np.eye(3)[shape][:, 1:]], axis=1)


def personal_data(docs: DataFrame, *, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """docs (or the columns ``carry`` of them) with ``pii``: array of (start, rank, end, kind, added), by start and then kind.

    Kinds are email, ip, card, phone, and for added spans also id and person; rank orders them so.  Null texts are
    empty and have none.  Repeated rows are searched each; an empty table gives an empty result.
    The labelers and the classifier see the candidates of all rows.  A column of docs named pii is replaced;
    other names don't matter.  Very long texts, and texts of very many matches, are searched whole, in linear time.
    """
    carry = [c for c in docs.columns if c.lower() != "pii"] if carry is None else carry
    # Columns that are named like what the search adds have other names meanwhile.
    inner = {f"_{k}" for k in KINDS} | {"_found", "_cases"}
    away = {c: free_name([*docs.columns, *inner], f"own{c}") for c in docs.columns if c.lower() in inner}
    text_col, back = away.get(text_col, text_col), {v: k for k, v in away.items() if k in carry}
    found = written(found_in(docs.withColumnsRenamed(away), text_col).select(*[away.get(c, c) for c in carry], "_cases"), "pii")
    cases = found.select(F.explode("_cases").alias("c")).select("c.kind", "c.strict", "c.votes", "c.shape")
    patterns = [(r["kind"], r["strict"], list(r["votes"]), r["shape"], r["count"]) for r in cases.groupBy("kind", "strict", "votes", "shape").count().collect()]
    weights, _ = learn(patterns)

    def accepted(c: Column) -> Column:
        if not len(weights):
            return c["strict"]
        score = F.lit(0.0)
        for k, i in RANK.items():
            score += F.when(c["kind"] == k, F.lit(float(weights[i]))).otherwise(F.lit(0.0))
        for j in range(len(LABELERS)):
            score += F.lit(float(weights[len(RANK) + j])) * c["votes"][j]
        for s in (1, 2):
            score += F.when(c["shape"] == s, F.lit(float(weights[len(RANK) + len(LABELERS) + s - 1]))).otherwise(F.lit(0.0))
        return c["strict"] | (score >= float(np.log(SURE / (1 - SURE))))

    rank = F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv])
    span = lambda c: F.struct(c["start"].alias("start"), rank[c["kind"]].alias("rank"), c["end"].alias("end"), c["kind"].alias("kind"), (~c["strict"]).alias("added"))
    return found.withColumn("pii", F.array_sort(F.transform(F.filter("_cases", accepted), span))).drop("_cases").withColumnsRenamed(back)


def redact(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in angle brackets (of overlapping spans the first one's); other texts are unchanged."""
    text = F.col(text_col)
    empty = F.array().cast("array<string>")

    def piece(a: Column, spans: Column) -> Column:
        """The next spans, in the stretch of text from where the last ones ended, so that none is sought from the text's begin."""
        end = F.array_max(F.transform(spans, lambda s: s["end"]))
        stretch = F.substring(text, (a["at"] + 1).cast("int"), F.greatest(end - a["at"], F.lit(0)).cast("int"))

        def put(own: Column) -> Column:
            def step(b: Column, s: Column) -> Column:
                gap = F.substring(own, (b["at"] - a["at"] + 1).cast("int"), (s["start"] - b["at"]).cast("int"))
                kind = F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))
                done = F.struct(s["end"].alias("at"), F.concat(b["out"], F.array(F.concat(gap, kind))).alias("out"))
                return F.when(s["start"] >= b["at"], done).otherwise(F.struct(F.greatest(b["at"], s["end"]).alias("at"), b["out"].alias("out")))

            made = F.aggregate(spans, F.struct(a["at"].alias("at"), empty.alias("out")), step)
            return _let(made, lambda m: F.struct(m["at"].alias("at"), F.concat(a["out"], F.array(F.array_join(m["out"], ""))).alias("out")))

        return _let(stretch, put)

    start = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out"))
    tail = lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, (a["at"] + 1).cast("int"), F.length(text)))
    cleaned = F.aggregate(F.transform(_pieces_of(F.size("pii")), lambda s: F.slice("pii", s + 1, F.lit(PIECE))), start, piece, tail)

    def run(d: DataFrame) -> DataFrame:
        return personal_data(d, text_col=text_col).withColumn(text_col, F.when(F.size("pii") > 0, cleaned).otherwise(text))

    return sheltered(docs, ["pii"], run)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"), carry=["doc_id"])
    base = F.filter("pii", lambda s: ~s["added"])

    def count(k: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("pii")).alias("spans"))
