"""Turtle files as a table of triples.

The reader covers prefixes and bases (both spellings), ``a``, lists by ``;`` and ``,``, IRIs with
escapes, short and long strings in either quote, language tags, datatypes, numbers, booleans and comments.
Blank nodes and collections are errors: no triple may lack a name.  Files are split: a chunk's prefixes come from
a scan of the chunks before it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karst.sources.scratch import written

TRIPLES = "s string, p string, o string, o_kind string, o_lang string, o_datatype string"
_XSD = "http://www.w3.org/2001/XMLSchema#"
_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
_TOKEN = re.compile(
    r"""(?P<space>\s+|\#[^\n\r]*)
    |(?P<iri><[^<>"{}|^`\x00-\x20]*>)
    |(?P<long>\"\"\"(?:\\.|(?!\"\"\").)*\"\"\"|'''(?:\\.|(?!''').)*''')
    |(?P<short>"(?:\\[^\n\r]|[^"\\\n\r])*"|'(?:\\[^\n\r]|[^'\\\n\r])*')
    |(?P<directive>@(?:prefix|base)\b|(?:PREFIX|BASE|prefix|base)(?=\s))
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<type>\^\^)
    |(?P<number>[+-]?(?:[0-9]+\.[0-9]*[eE][+-]?[0-9]+|\.?[0-9]+[eE][+-]?[0-9]+|[0-9]*\.[0-9]+|[0-9]+))
    |(?P<blank>_:[^\s;,.\])]+|\[|\]|\(|\))
    |(?P<bool>(?:true|false)(?=[\s;,.]))
    |(?P<a>a(?=[\s<]))
    |(?P<name>(?:[^\s:;,.<>"'()\[\]\\@^\#]|\.(?=[^\s:;,<>"'()\[\]]*:))*:(?:[^\s;,.<>"'()\[\]\\\#]|\.(?=[^\s;,.<>"'()\[\]])|\\.)*)
    |(?P<mark>[;,.])""",
    re.X | re.S,
)
_ESCAPE = re.compile(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", re.S)
_ESCAPED = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f"}


def _unescape(text: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else _ESCAPED.get(m[1], m[1]), text)


def parse_turtle(text: str) -> Iterator[tuple]:
    """(s, p, o, o_kind, o_lang, o_datatype) of every statement, repeats included."""
    prefixes: dict[str, str] = {}
    base = ""

    def tokens() -> Iterator[tuple[str, str]]:
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if m is None:
                raise ValueError(f"not Turtle at line {text.count(chr(10), 0, at) + 1}: {text[at : at + 40]!r}")
            at = m.end()
            if m.lastgroup == "blank":
                raise ValueError("blank nodes and collections are not supported")
            if m.lastgroup != "space":
                yield m.lastgroup, m[0]
        yield "end", ""

    stream = tokens()
    kind, value = next(stream)

    def step() -> None:
        nonlocal kind, value
        kind, value = next(stream)

    def iri() -> str:
        if kind == "iri":
            out = _unescape(value[1:-1])
            out = out if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", out) else base + out
        elif kind == "name":
            prefix, _, rest = value.partition(":")
            if prefix not in prefixes:
                raise ValueError(f"prefix {prefix!r} is not declared")
            out = prefixes[prefix] + re.sub(r"\\(.)", r"\1", rest)
        else:
            raise ValueError(f"a resource is expected, not {value!r}")
        step()
        return out

    def term() -> tuple:
        if kind in ("iri", "name"):
            return iri(), "uri", None, None
        if kind in ("long", "short"):
            cut = 3 if kind == "long" else 1
            out = _unescape(value[cut:-cut])
            step()
            if kind == "lang":
                tag = value[1:].lower()
                step()
                return out, "literal", tag, None
            if kind == "type":
                step()
                return out, "literal", None, iri()
            return out, "literal", None, None
        if kind in ("number", "bool"):
            out = value
            name = "boolean" if kind == "bool" else "double" if re.search("[eE]", out) else "decimal" if "." in out else "integer"
            step()
            return out, "literal", None, _XSD + name
        raise ValueError(f"an object is expected, not {value!r}")

    while kind != "end":
        if kind == "directive":
            word = value
            step()
            if word.lower().endswith("prefix"):
                prefix = value[:-1]
                if kind != "name" or not value.endswith(":"):
                    raise ValueError(f"a prefix is expected, not {value!r}")
                step()
                prefixes[prefix] = iri()
            else:
                base = iri()
            if word[0] == "@":
                if value != ".":
                    raise ValueError("a directive ends with a dot")
                step()
            continue
        subject = iri()
        while True:
            if kind == "a":
                step()
                predicate = _TYPE
            else:
                predicate = iri()
            while True:
                yield (subject, predicate, *term())
                if value != "," or kind != "mark":
                    break
                step()
            while kind == "mark" and value == ";":
                step()
            if kind == "mark" and value == ".":
                step()
                break
            if kind == "end":
                raise ValueError("the last statement has no dot")


#: Characters from which a chunk of lines is full; only a line of its own may be longer.
CHUNK = 4_000_000
#: What a line can begin in: nothing, or a long string of either quote.  Nothing else goes on over a line's end.
_STARTS = ["", '"', "'"]
_ENDS = {q: re.compile(r"\\.|" + q * 3, re.S) for q in _STARTS[1:]}
_SCAN = "start string, end string, first int, last int, lead array<string>, pending array<string>, head array<string>, mid array<string>, tail array<string>, error string"
_CHUNKS = f"path string, block long, seq long, text string, scans array<struct<{', '.join(c.replace(' ', ': ', 1) for c in _SCAN.split(', '))}>>"
_PLACED = "path string, block long, seq long, start string, first int, last int, chunk long, chain long, before string, after string"
_PIECES = f"path string, chain long, chunk long, text string, {TRIPLES}"


def _closed(text: str, at: int, quote: str) -> int:
    """Where the long string that ``at`` lies in ends, or -1."""
    return next((m.end() for m in _ENDS[quote].finditer(text, at) if m[0][0] != "\\"), -1)


def _whole(directive: list[str]) -> bool:
    return len(directive) == (3 if directive[0].lower().endswith("prefix") else 2)


def scan_chunk(text: str, start: str) -> dict:
    """What a chunk of whole lines holds if it begins in ``start``: what it ends in, its first and last statement's end, its directives.

    Directives are kept apart by whether they lie before the first statement's end, between, or after the last; one that
    the chunk's end cuts is pending, and the first tokens (lead) may complete one of the chunk before.
    """
    out = {"start": start, "end": start, "first": None, "last": None, "lead": [], "pending": [], "head": [], "mid": [], "tail": [], "error": None}
    at = _closed(text, 0, start) if start else 0
    if at < 0:
        return out
    out["end"], found = "", out["head"]
    while at < len(text):
        kind, quote = None, text[at]
        if text.startswith(('"""', "'''"), at):
            kind, value, at = "long", "", _closed(text, at + 3, quote)
            if at < 0:
                out["end"] = quote
                break
        else:
            m = _TOKEN.match(text, at)
            if m is None:
                return out | {"error": f"not Turtle: {text[at : at + 40]!r}"}
            kind, value, at = m.lastgroup, m[0], m.end()
        if kind == "space":
            continue
        if len(out["lead"]) < 2:
            out["lead"].append(value)
        if kind == "directive":
            out["pending"] = [value]
        elif out["pending"]:
            out["pending"].append(value)
        if out["pending"] and _whole(out["pending"]):
            found.append(" ".join(out["pending"]))
            out["pending"] = []
        if kind == "mark" and value == ".":
            out["mid"] += out["tail"]
            out["first"], out["last"] = at if out["first"] is None else out["first"], at
            found = out["tail"] = []
    return out


def _chunked(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, seq, lines, held, starts = None, 0, [], 0, []

        def flush() -> pd.DataFrame:
            nonlocal seq, lines, held, starts
            text = "\n".join(lines) + "\n"
            if key[1] == 0 and seq == 0:
                text = text.removeprefix("\ufeff")
            scans = [scan_chunk(text, s) for s in starts]
            row = pd.DataFrame([(*key, seq, text, scans)], columns=["path", "block", "seq", "text", "scans"])
            # The next chunk of the split begins in what this one can end in.
            seq, lines, held, starts = seq + 1, [], 0, sorted({s["end"] for s in scans if s["error"] is None}) or _STARTS
            return row

        for batch in batches:
            for path, block, line in zip(batch["path"], batch["block"], batch["value"], strict=True):
                if key != (path, block):
                    if lines:
                        yield flush()
                    key, seq, starts = (path, block), 0, _STARTS[:1] if block == 0 else _STARTS
                lines.append(line)
                held += len(line) + 1
                if held >= size:
                    yield flush()
        if lines:
            yield flush()

    return run


def _placed(rows: pd.DataFrame) -> pd.DataFrame:
    """Follows one file's chunks: what each begins in, its prefixes and base, and the chain of chunks that each cut statement spans."""
    names: dict[str, str] = {}
    base, state, pending, chain, out = "", "", [], 0, []

    def declare(directives: list[str]) -> str:
        nonlocal base
        for d in directives:
            word, *name, iri = d.split(" ")
            # Wrong ones are for the parser, which meets them in their own chunk.
            if iri[:1] == "<" and iri[-1:] == ">":
                own = iri[1:-1]
                own = own if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", _unescape(own)) else base + own
                if name:
                    names[name[0]] = own
                else:
                    base = own
            elif name and ":" in iri and iri.split(":")[0] + ":" in names:
                names[name[0]] = names[iri.split(":")[0] + ":"] + re.sub(r"\\(.)", r"\1", iri.split(":", 1)[1])
        return "".join(f"@prefix {k} <{v}> .\n" for k, v in names.items()) + (f"@base <{base}> .\n" if base else "")

    for n, r in enumerate(rows.sort_values(["block", "seq"]).to_dict("records")):
        s = next(x for x in r["scans"] if x["start"] == state)
        if s["error"] is not None:
            raise ValueError(f"{r['path']}, from byte {r['block']}: {s['error']}")
        if pending:
            need = 3 if pending[0].lower().endswith("prefix") else 2
            pending = [*pending, *list(s["lead"])[: need - len(pending)]]
            if _whole(pending):
                declare([" ".join(pending)])
                pending = []
        before, after, cut = declare(s["head"]), declare(s["mid"]), s["first"] is not None
        out.append((r["path"], r["block"], r["seq"], state, s["first"], s["last"], n, chain, before, after))
        declare(s["tail"])
        state, pending, chain = s["end"], list(s["pending"]) or pending, chain + cut
    frame = pd.DataFrame(out, columns=[c.split(" ")[0] for c in _PLACED.split(", ")])
    return frame.astype({"first": "Int32", "last": "Int32"})


def _parsed(path: str, text: str) -> list[tuple]:
    try:
        return list(parse_turtle(text))
    except ValueError as e:
        raise ValueError(f"{path}: {e}") from e


def read_turtle(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """The distinct triples of one or more .ttl, .turtle or .nt files; a file without any is an error.

    Files are split.  Spark's text source cuts them at line ends anywhere, also within a string of many lines; lines are gathered to
    chunks, each is scanned for all states that it can begin in, and each file's scans (not its text) are followed in order, which
    tells every chunk its state, prefixes and base.  Whole statements are parsed where they lie; those that a chunk's
    end cuts meet in a group of their own.  One statement, and one line, is held by one task.
    """
    # A scan leaves empty files out, a listing doesn't.
    scan = spark.read.format("binaryFile").load(path)
    files = written(scan.select(F.col("_metadata.file_path").alias("path")).distinct(), "turtle-files")
    empty = len(scan.inputFiles()) - files.count()
    if empty:
        raise ValueError(f"no triples in {empty} empty files of {path}")
    wrong = files.where(~F.lower("path").rlike(r"\.(ttl|turtle|nt)$")).select("path").limit(1).collect()
    if wrong:
        raise ValueError(f"not a Turtle file: {wrong[0]['path']}")
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")
    # Written: later passes join and shuffle chunks, whatever the splits of another run would be.
    chunks = written(lines.mapInPandas(_chunked(chunk), _CHUNKS), "turtle-chunks")
    placed = written(chunks.select("path", "block", "seq", "scans").groupBy("path").applyInPandas(_placed, _PLACED), "turtle-places")

    columns, triple = [c.split(" ")[0] for c in _PIECES.split(", ")], [c.split(" ")[0] for c in TRIPLES.split(", ")]

    def inside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.to_dict("records"):
                text, pieces = r["text"], []
                if pd.isna(r["first"]):
                    pieces.append((r["chain"], text))
                    rows = []
                else:
                    first, last = int(r["first"]), int(r["last"])
                    pieces += [(r["chain"], text[:first]), (r["chain"] + 1, r["after"] + text[last:])]
                    rows = _parsed(r["path"], r["before"] + text[first:last])
                none = (None,) * len(triple)
                yield pd.DataFrame([(r["path"], c, r["chunk"], t, *none) for c, t in pieces] + [(r["path"], None, None, None, *x) for x in rows], columns=columns).astype({"chain": "Int64", "chunk": "Int64"})

    def across(pieces: pd.DataFrame) -> pd.DataFrame:
        text = "".join(pieces.sort_values("chunk")["text"])
        return pd.DataFrame([(pieces["path"].iloc[0], *x) for x in _parsed(pieces["path"].iloc[0], text)], columns=["path", *triple])

    found = written(chunks.drop("scans").join(placed, ["path", "block", "seq"]).mapInPandas(inside, _PIECES), "turtle-pieces")
    cut = found.where("chain IS NOT NULL").groupBy("path", "chain").applyInPandas(across, f"path string, {TRIPLES}")
    rows = written(found.where("chain IS NULL").select("path", *triple).unionByName(cut), "turtle-triples")
    bare = files.join(rows, "path", "left_anti").limit(1).collect()
    if bare:
        raise ValueError(f"no triples in {bare[0]['path']}")
    return rows.drop("path").dropDuplicates()
