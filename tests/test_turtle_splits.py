"""Split files give the rows of the parser that reads them whole."""

import pytest
from graph_fixture import TTL

from karst.sources.turtle import parse_turtle, read_turtle

HOSTILE = '''@prefix
  a:
  <http://a.example/> .
# a comment with """ and ' and a dot .
@base <http://base.example/> .
PREFIX b: <rel/>
a:x a:says """one . two
# no comment . "quoted" \\""" still
@prefix a: <http://wrong.example/> .
last""" , \'\'\'it"""s
. . .
\'\'\'@en-GB ;
   a:n 1.5 , 2. a:y a:dot.ted b:z , <c> .
@prefix a: <http://second.example/> .
a:x a:says "#no" , 'x \\' y' ; ; a:p
  a:q ,

  a:r
.
PREFIX c: b:deep/
PREFIX a:
<http://third.example/>
a:x c:p "\\u0041" . a:x a a:T .   # the end .
'''
CRLF = "@prefix a: <http://a.example/> .\r\na:x a:t '''l\r\nm\r\n''' ;\r\n  a:u 'e' .\r\n"


def distinct(text):
    return set(parse_turtle(text))


@pytest.fixture
def split(spark):
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    yield lambda n: spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
    spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


@pytest.mark.parametrize(("bytes_", "chunk"), [(64, 10), (300, 60), (1 << 20, 1), (1 << 20, 1 << 20)])
def test_any_split_gives_the_same_rows(spark, tmp_path, split, bytes_, chunk):
    texts = {"hostile.ttl": HOSTILE, "crlf.turtle": CRLF, "bom.nt": "﻿<http://s> <http://p> <http://o> .", "law.ttl": TTL}
    if bytes_ < 100:
        texts.pop("law.ttl")
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    split(bytes_)
    got = read_turtle(spark, str(tmp_path), chunk=chunk).collect()
    want = set().union(*(distinct(t.removeprefix("﻿")) for t in texts.values()))
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_a_large_file_is_many_tasks(spark, tmp_path, split):
    body = "".join(f'a:s{i} a:p a:o{i % 7} ; a:q """v {i}\n.""" .\n' for i in range(3000))
    (tmp_path / "x.ttl").write_text("@prefix a: <http://a.example/> .\n" + body)
    split(10_000)
    lines = spark.read.text(str(tmp_path))
    assert lines.rdd.getNumPartitions() > 8
    got = read_turtle(spark, str(tmp_path), chunk=3000)
    assert got.count() == 6000 and got.select("s").distinct().count() == 3000


@pytest.mark.parametrize("bad", ['a:x a:y "open', "zz:x a:y a:z .", "@prefix b: <http://b.example/> ."])
def test_errors_name_their_file(spark, tmp_path, split, bad):
    (tmp_path / "good.ttl").write_text("@prefix a: <http://a.example/> .\na:x a:y a:z .\n" * 5)
    (tmp_path / "bad.ttl").write_text("@prefix a: <http://a.example/> .\n\n" + bad)
    split(1000)
    with pytest.raises(Exception, match="bad.ttl"):
        read_turtle(spark, str(tmp_path), chunk=20).collect()


def test_empty_files(spark, tmp_path):
    (tmp_path / "empty.ttl").write_text("")
    with pytest.raises(ValueError, match="no triples in 1 empty files"):
        read_turtle(spark, str(tmp_path))
