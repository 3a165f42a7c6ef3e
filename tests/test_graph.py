import pytest
from graph_fixture import PREFIX, TTL
from pyspark.sql import functions as F

from karst.operators import build, graph
from karst.settings import Settings
from karst.sources import store
from karst.sources.turtle import parse_turtle, read_turtle

S = Settings(article_count=6)
NS = S.namespace


@pytest.fixture(scope="module")
def triples(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("ttl") / "law.ttl"
    path.write_text(TTL, encoding="utf-8")
    return read_turtle(spark, str(path)).cache()


@pytest.fixture(scope="module")
def nodes(triples):
    return build.nodes_of(triples, S).cache()


@pytest.fixture(scope="module")
def edges(triples):
    return build.edges_of_triples(triples).cache()


def test_turtle(triples):
    rows = {(r.s.removeprefix(NS), r.p.split("#")[-1], r.o.removeprefix(NS), r.o_lang, r.o_datatype) for r in triples.collect()}
    xsd = "http://www.w3.org/2001/XMLSchema#"
    assert ("worker", "age", "30", None, xsd + "integer") in rows and ("worker", "rate", "1.5", None, xsd + "decimal") in rows
    assert ("worker", "big", "1e3", None, xsd + "double") in rows and ("worker", "active", "true", None, xsd + "boolean") in rows
    assert ("worker", "code", "x", None, NS + "Code") in rows and ("leave", "comment", "leave A", "en-gb", None) in rows
    assert ("par_1", "comment", 'فقرة "أولى"\nسطر ثان', "ar", None) in rows
    assert len([r for r in rows if r[:3] == ("worker", "hasRight", "wage")]) == 1
    assert len(list(parse_turtle(TTL))) == len(rows) + 1  # one statement is repeated


@pytest.mark.parametrize("bad", ["law:a law:b _:x .", "law:a law:b [ law:c 1 ] .", "law:a law:b ( 1 ) .", "nope:a law:b 1 .", "law:a law:b 1", "law:a 5 ."])
def test_turtle_errors(bad):
    with pytest.raises(ValueError):
        list(parse_turtle(PREFIX + bad))


def test_nodes(nodes):
    rows = {r.local_name: r for r in nodes.collect()}
    kinds = {k: rows[k].node_kind for k in ("article_1", "par_1", "wage_definition", "the_law", "Right", "regulates", "wage", "Class")}
    assert kinds == {"article_1": "Article", "par_1": "Paragraph", "wage_definition": "Definition", "the_law": "Law", "Right": "OntologyClass", "regulates": "ObjectProperty", "wage": "WageRight", "Class": "Resource"}
    assert {k for k, r in rows.items() if r.retrieval_eligible} == {"wage", "delay", "leave", "sick"}
    wage = rows["wage"]
    assert wage.labels_en == ["wage"] and wage.labels_other == ["salaire"] and wage.aliases_ar == ["الراتب"] and wage.article_number is None
    assert wage.searchable_text.split("\n")[:4] == ["Local name: wage", "Node kind: WageRight", "RDF types: WageRight", "Arabic labels: الأجر"]
    assert rows["leave"].comments_en == ["leave A"] and rows["article_6"].article_number == 6


def test_report(triples, nodes, edges):
    r = build.inspection_report(triples, nodes, edges, S).first()
    assert r.article_count == 6 and r.triple_count == r.edge_count and r.eligible_count == 4
    assert r.missing_article_numbers == [] and r.unreachable_article_numbers == [3, 6] and not r.is_valid
    assert build.inspection_report(triples, nodes, edges, Settings(article_count=7)).first().missing_article_numbers == [7]


def view(edges):
    return graph.edge_view(edges, graph.RELATION_WEIGHTS, graph.is_uri_of(NS))


def expand(spark, edges, seeds, **settings):
    rows = [(1, 1, NS + u, s, u, i + 1) for i, (u, s) in enumerate(seeds)]
    frame = spark.createDataFrame(rows, "question_id int, issue_index int, uri string, seed_score double, seed_label string, seed_rank int")
    return frame, graph.expand(frame, view(edges), Settings(**settings), in_namespace=lambda u: u.startswith(NS))


def test_expansion_scores_by_hand(spark, edges):
    _, walks = expand(spark, edges, [("delay", 1.0)])
    got = {r.uri.removeprefix(NS): r for r in graph.article_evidence(walks, S).collect()}
    damp = lambda n: (1 + __import__("math").log1p(n)) ** 0.5
    assert got["article_4"].graph_score == pytest.approx(0.72 / damp(1))
    # delay -violatesRight-> wage (2 articles) -supportedByArticle-> article_1
    assert got["article_1"].graph_score == pytest.approx(0.86 * 0.72 * 1.00 * 0.72 / damp(2))
    assert got["article_1"].n_paths == 3 and got["article_4"].n_paths == 2
    assert "article_6" not in got and "article_2" not in got
    for r in got.values():
        assert r.support_paths and all(s.relation in graph.RELATION_WEIGHTS for p in r.support_paths for s in p.steps)
        assert all(p.steps[-1].source_uri == r.uri or p.steps[-1].target_uri == r.uri for p in r.support_paths)


def test_walks_go_on_from_better_states_only(spark, edges):
    seeds, walks = expand(spark, edges, [("wage", 0.5), ("worker", 0.9)], max_hops=3)
    related = {r.uri.removeprefix(NS): r.score for r in graph.related_concepts(walks, seeds).collect()}
    assert set(related) == {"delay", "wage_definition", "leave", "sick"}
    assert related["leave"] == pytest.approx(0.9 * 0.74 * 0.72)
    paths = graph.article_evidence(walks, Settings(paths_per_article=2)).collect()
    assert all(r.n_paths <= 2 for r in paths)


def test_seeds(spark):
    hits = spark.createDataFrame([(1, 1, "a", 0.9), (1, 1, "b", 0.7), (1, 1, "c", 0.6), (1, 1, "d", 0.0), (2, 1, "e", 0.1), (2, 1, "f", 0.09)], "question_id int, issue_index int, uri string, seed_score double")
    got = {(r.question_id, r.uri) for r in graph.select_seeds(hits, S).collect()}
    assert got == {(1, "a"), (1, "b"), (2, "e")}


def test_store(spark, nodes, edges):
    counts = store.ingest(spark, nodes, edges, "t_nodes", "t_edges", reset=True).collect()
    assert [r.requested for r in counts] == [r.stored for r in counts] == [nodes.count(), edges.count()]
    with pytest.raises(ValueError):
        store.ingest(spark, nodes, edges, "t_nodes", "t_edges")
    with pytest.raises(ValueError):
        store.ingest(spark, nodes, edges, "t_nodes", "t_edges", reset=True, valid=False)
    about = {r.column: r for r in store.describe_store(spark, "t_nodes").collect()}
    assert about["uri"].tokenization == "field" and about["labels_ar"].searchable
    assert spark.table("t_nodes").where("uri LIKE '%#par_1'").first().labels_ar is None
    assert store.ensure_store(spark, "t_nodes", store.NODE_SCHEMA) == {"deleted": False, "created": False, "retained": True}
    for t in ("t_nodes", "t_edges"):
        spark.sql(f"DROP TABLE {t}")


def test_embedding_checks(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", "y")], "uri string, searchable_text string")
    assert store.embed(rows, lambda ts: [[1.0, 2.0] for _ in ts]).first().embedding == [1.0, 2.0]
    for bad in (lambda ts: [], lambda ts: [[float("nan")] for _ in ts]):
        with pytest.raises(Exception, match="finite vector|one finite"):
            store.embed(rows, bad).collect()


def test_settings():
    assert Settings.load(env_file="none", environ={"MAX_HOPS": "3", "OTHER": "1", "VERIFY_ABSTAIN": "false"}).max_hops == 3
    with pytest.raises(ValueError):
        Settings(max_hops=4)
    assert F is not None


def test_closure_at_any_depth(spark):
    """A chain of 200, a ladder of many ways, cycles, and resources that no root reaches."""
    pairs = [(f"c{i + 1}", f"c{i}") for i in range(200)] + [("c0", "root"), ("root", "c150")]
    pairs += [(f"l{i + 1}{x}", f"l{i}{y}") for i in range(20) for x in "ab" for y in "ab"] + [("l0a", "root"), ("far", "away"), ("away", "far"), ("self", "self")]
    got = sorted(r.uri for r in build.closure(spark.createDataFrame(pairs, "child string, parent string"), ["root", "other"]).collect())
    below, frontier = {"root", "other"}, {"root", "other"}
    while frontier:
        frontier = {c for c, p in pairs if p in frontier} - below
        below |= frontier
    assert got == sorted(below)


def test_closure_leaves_unrelated_links(spark, monkeypatch):
    """A small hierarchy, a long chain, a cycle of 1,000 and 200,000 links that no root reaches: rounds are few and links never grow."""
    sizes, plain = [], build.written

    def counted(df, name):
        out = plain(df, name)
        if name == "closure-links":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(build, "written", counted)
    star = spark.range(200_000).selectExpr("concat('x', id) AS child", "concat('y', id % 7) AS parent")
    trees = spark.range(1, 5_000).selectExpr("concat('t', id) AS child", "concat('t', id div 3) AS parent")
    ring = spark.range(1_000).selectExpr("concat('r', id) AS child", "concat('r', (id + 1) % 1000) AS parent")
    chain = spark.range(500).selectExpr("concat('c', id + 1) AS child", "concat('c', id) AS parent")
    few = spark.createDataFrame([("c0", "root"), ("a", "root"), ("b", "a"), ("b", "root"), ("r17", "b"), ("d", None), (None, "root"), ("a", "a"), ("root", "r4")], "child string, parent string")
    got = {r.uri for r in build.closure(star.union(trees).union(ring).union(chain).union(few), ["root"]).collect()}
    assert got == {"root", "a", "b"} | {f"r{i}" for i in range(1_000)} | {f"c{i}" for i in range(501)}
    assert sizes == sorted(sizes, reverse=True) and sizes[1] < 10_000 and len(sizes) <= 14
    assert [r.uri for r in build.closure(few.limit(0), ["root", "root"]).collect()] == ["root"] and build.closure(few, []).isEmpty()
