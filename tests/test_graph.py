"""Extraction, graph joins and graph context."""

import random

import pytest
from lorekeep.operators import graph as g
from lorekeep.sources.tables import Store

EDGE = "src string, relationship string, dst string"


def test_parse(spark):
    bodies = [
        '{"entities":["A","B"],"relationships":[["A","r","B"],["A","B"],"x",["A","r","B","C"],["A",1,"B"]]}',
        '{"entities":["A"]',
        "not json",
        None,
        "{}",
        '{"relationships":[["A","r","B"]]}',
    ]
    raw = spark.createDataFrame(list(enumerate(bodies)), "doc_id int, body string")
    parsed = g.parse_extractions(raw)
    rows = {r["doc_id"]: r for r in parsed.collect()}
    assert rows[0]["entities"] == ["A", "B"]
    assert all(rows[n]["entities"] == [] and rows[n]["relationships"] == [] for n in (1, 2, 3, 4))
    triples = sorted(tuple(r) for r in g.valid_triples(parsed, "doc_id").collect())
    assert triples == [(0, "A", "1", "B"), (0, "A", "r", "B"), (5, "A", "r", "B")]


def test_rule_extraction(spark):
    docs = spark.createDataFrame([(1, "The Unity Catalog, iPhone and Élan2 x.\nNext Line_1"), (2, "none here"), (3, "")], "doc_id int, text string")
    rows = {r["doc_id"]: r for r in g.extract_entities(docs).collect()}
    assert rows[1]["entities"] == ["The Unity Catalog", "Élan2", "Next Line_1"]
    assert rows[1]["relationships"] == [["The Unity Catalog", "co_occurs_with", "Élan2"]]
    assert rows[2]["entities"] == rows[3]["entities"] == []


def test_model_hook(spark):
    docs = spark.createDataFrame([(1, "x"), (2, "y")], "doc_id long, text string")
    out = g.extract_with(docs, lambda texts: texts.map(lambda t: '{"entities":["%s"],"relationships":[]}' % t))
    assert {r["doc_id"]: r["entities"] for r in out.collect()} == {1: ["x"], 2: ["y"]}


def test_match_is_brute_force(spark):
    rng = random.Random(5)
    names = sorted({"".join(rng.choice("abÉc+ ") for _ in range(rng.randint(1, 9))).strip() for _ in range(300)} - {""})
    words = ["".join(rng.choice("abéc+") for _ in range(rng.randint(1, 6))) for _ in range(120)]
    asked = [(n, " ".join(rng.sample(words, rng.randint(1, 4))).upper() if n % 2 else rng.choice(words)) for n in range(60)]
    asked += [(100, "   "), (101, ""), (102, None), (103, "c++"), (104, "zzz")]
    vertices = spark.createDataFrame([(n,) for n in names], "id string")
    questions = spark.createDataFrame(asked, "query_id int, query string")
    got = {}
    for r in g.match_vertices(questions, vertices, 5).orderBy("query_id", "place").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    want = {}
    for n, text in asked:
        hits = [v for v in names if any(w in v.lower() for w in (text or "").lower().split())]
        if hits:
            want[n] = sorted(hits, key=lambda v: v.encode())[:5]
    assert got == want


def graph(spark):
    vertices = spark.createDataFrame([("Alpha",), ("Beta",), ("Gamma",), ("Lone",)], "id string")
    edges = spark.createDataFrame(
        [("Alpha", "r", "Beta"), ("Alpha", "r", "Beta"), ("Alpha", "s", "missing"), ("Beta", "t", "Gamma"), ("gone", "r", "Alpha")],
        EDGE,
    )
    return vertices, edges


def test_one_hop_drops_dangling_and_keeps_copies(spark):
    vertices, edges = graph(spark)
    got = sorted(tuple(r) for r in g.one_hop(edges, vertices).collect())
    assert got == [("Alpha", "r", "Beta", 2), ("Beta", "t", "Gamma", 1)]


def test_seed_edges(spark):
    vertices, edges = graph(spark)
    seeds = spark.createDataFrame([("Alpha",), ("Alpha",)], "id string")
    assert sorted((r["dst"], r["n"]) for r in g.seed_edges(edges, seeds).collect()) == [("Beta", 2), ("missing", 1)]


def test_context(spark):
    vertices, edges = graph(spark)
    asked = spark.createDataFrame([(1, "alpha beta"), (2, "lone"), (3, "nothing"), (4, " ")], "query_id int, query string")
    got = {(r["query_id"], r["page"]): r["context"] for r in g.graph_context(asked, vertices, edges).collect()}
    assert got == {
        (1, 0): g.HEADING + "- Alpha r Beta\n- Alpha r Beta\n- Beta t Gamma",
        (2, 0): g.NO_EDGES,
    }


def test_context_in_both_directions(spark):
    vertices, edges = graph(spark)
    edges = edges.union(spark.createDataFrame([("Gamma", "self", "Gamma")], EDGE))
    asked = spark.createDataFrame([(1, "gamma"), (2, "beta")], "query_id int, query string")
    got = {r["query_id"]: r["context"] for r in g.graph_context(asked, vertices, edges, direction="both").collect()}
    assert got == {
        1: g.HEADING + "- Beta t Gamma\n- Gamma self Gamma",
        2: g.HEADING + "- Alpha r Beta\n- Alpha r Beta\n- Beta t Gamma",
    }


def lines_of(rows, query):
    """The lines of a question's pages in order, put together."""
    pages = [r["context"] for r in sorted(rows, key=lambda r: r["page"]) if r["query_id"] == query]
    assert not any(p.startswith(g.HEADING) for p in pages[1:])
    return "".join(pages).removeprefix(g.HEADING).split("\n")


def test_hot_vertex_spreads_over_pages(spark):
    """A third of all edges leave one vertex: pages put together are the unpaged context."""
    names = [f"n{i}" for i in range(300)]
    vertices = spark.createDataFrame([(n,) for n in ["hub", "other", *names]], "id string")
    edges = spark.createDataFrame([("hub", "r", n) for n in names] + [("other", "r", n) for n in names[:5]], EDGE)
    asked = spark.createDataFrame([(1, "hub"), (2, "hub other")], "query_id int, query string")
    rows = g.graph_context(asked, vertices, edges, page_lines=50).collect()
    whole = {r["query_id"]: r["context"] for r in g.graph_context(asked, vertices, edges).collect()}
    for query, expected, pages in ((1, 300, 6), (2, 305, 7)):
        mine = sorted((r["page"], r["context"]) for r in rows if r["query_id"] == query)
        assert [p for p, _ in mine] == list(range(pages))
        assert "".join(c for _, c in mine) == whole[query]
        assert len(set(lines_of(rows, query))) == expected
    assert lines_of(rows, 2) == [f"- hub r {n}" for n in sorted(names)] + [f"- other r {n}" for n in names[:5]]


def test_a_vertex_without_edges_adds_no_page(spark):
    """Beside vertices whose copies may leave any page empty."""
    hubs = [f"hub{i}" for i in range(12)]
    vertices = spark.createDataFrame([(n,) for n in [*hubs, *(f"{h} lone" for h in hubs), "t"]], "id string")
    edges = spark.createDataFrame([(h, "r", "t") for h in hubs for _ in range(20)], EDGE)
    asked = spark.createDataFrame([(i, h) for i, h in enumerate(hubs)], "query_id int, query string")
    rows = g.graph_context(asked, vertices, edges, page_lines=10).collect()
    assert not any(r["context"] == g.NO_EDGES for r in rows)
    for i, h in enumerate(hubs):
        assert lines_of(rows, i).count(f"- {h} r t") == 20


def test_store_writes_both_tables_or_none(spark):
    vertices, edges = graph(spark)
    store = Store.scratch(spark)
    assert store.read_graph() is None
    assert not store.write_graph(vertices, edges.limit(0))
    assert store.read_graph() is None
    assert store.write_graph(vertices, edges)
    assert [df.count() for df in store.read_graph()] == [4, 5]


def test_hot_keyword_and_copies(spark):
    edges = spark.createDataFrame([("a", "r", "b")] * 1000 + [("a", "r", f"x{i}") for i in range(10)], EDGE)
    assert g.counted_edges(edges).count() == 11
    vertices = spark.createDataFrame([("a",), ("b",), *[(f"x{i}",) for i in range(10)]], "id string")
    asked = spark.createDataFrame([(1, "a")], "query_id int, query string")
    rows = g.graph_context(asked, vertices, edges, page_lines=100).collect()
    lines = lines_of(rows, 1)
    assert lines.count("- a r b") == 1000 and len(lines) == 1010 and len(rows) == 11


@pytest.mark.parametrize("text,grams", [("aa", {"a", "aa"}), ("ab", {"a", "b", "ab"}), ("abcd", {"a", "b", "c", "d", "ab", "bc", "cd", "abc", "bcd"})])
def test_grams(spark, text, grams):
    rows = spark.createDataFrame([(text,), ("",), (None,)], "t string")
    got = [r["gram"] for r in g.with_grams(rows, "t").collect()]
    assert len(got) == len(set(got)) and set(got) == grams


def test_long_phrases(spark):
    """A title in capitals is one entity, however long, as is one before a smaller word."""
    title = " ".join(f"Word{k}" for k in range(5000))
    rows = [(1, title), (2, "A B C D E F G H I J k L\nM  N O"), (3, "xA Bc_D é É\x01F \x02G"), (4, "")]
    found = {r.id: (r.entities, r.relationships) for r in g.extract_entities(spark.createDataFrame(rows, "id int, text string")).collect()}
    assert found[1] == ([title], [])
    assert found[2][0] == ["A B C D E F G H I J", "L", "M", "N O"]
    assert [tuple(x) for x in found[2][1]] == [("A B C D E F G H I J", "co_occurs_with", "L"), ("M", "co_occurs_with", "N O")]
    assert found[3][0] == ["Bc_D", "É", "F", "G"] and found[4] == ([], [])
