"""The stored keyword index."""

import random

import pytest
from lorekeep.operators import graph, keywords
from lorekeep.sources.tables import Store

QUESTIONS = "query_id int, query string"


@pytest.fixture
def small_blocks(monkeypatch):
    for name, value in {"BLOCK": 4, "SHARD": 32, "GROWTH": 2}.items():
        monkeypatch.setattr(keywords, name, value)


def stored(spark, names):
    vertices = spark.createDataFrame([(n,) for n in names], "id string")
    return Store.scratch(spark).write_keywords(*keywords.build_keywords(vertices))


def test_numbers_have_no_gaps(spark):
    rng = random.Random(2)
    rows = [(rng.choice("abcdé") * rng.randint(1, 9), n) for n in range(500)]
    got = keywords.numbered(spark.createDataFrame(rows, "name string, n int").repartition(7), "name", "n").collect()
    assert sorted((r.pos, r.name, r.n) for r in got) == [(k, *r) for k, r in enumerate(sorted(rows, key=lambda r: (r[0].encode(), r[1])))]


def test_search_is_brute_force(spark, small_blocks):
    rng = random.Random(7)
    names = sorted({"".join(rng.choice("abÉc+ ") for _ in range(rng.randint(1, 12))).strip() for _ in range(400)} - {""})
    words = ["".join(rng.choice("abéc+") for _ in range(rng.randint(1, 7))) for _ in range(100)]
    asked = [(n, " ".join(rng.sample(words, rng.randint(1, 4))).upper() if n % 2 else rng.choice(words)) for n in range(60)]
    asked += [(100, "   "), (101, ""), (102, None), (103, "c++"), (104, "zzz"), (None, "a"), (105, "a"), (105, "a")]
    vertices, postings = stored(spark, [*names, names[0], None])
    got = {}
    for r in keywords.search_keywords(spark.createDataFrame(asked, QUESTIONS), vertices, postings, 5).collect():
        got.setdefault(r["query_id"], []).append((r["place"], r["id"]))
    want = {}
    for n, text in asked:
        hits = [v for v in names if any(w in v.lower() for w in (text or "").lower().split())]
        if hits:
            want[n] = list(enumerate(sorted(hits, key=lambda v: v.encode())[:5], 1))
    assert {n: sorted(rows) for n, rows in got.items()} == want


def test_postings(spark, small_blocks):
    names = [f"n{k:03}" for k in range(100)]
    _, postings = stored(spark, names)
    rows = sorted((r.block, r.before, r.total, r.last, r.offsets) for r in postings.filter("gram = 'n0'").collect())
    assert rows == [(b, 4 * b, 100, 96, [0, 1, 2, 3]) for b in range(25)]
    some = sorted((4 * r.block + o) for r in postings.filter("gram = '7'").collect() for o in r.offsets)
    assert some == [k for k, n in enumerate(names) if "7" in n]


def test_a_word_leaves_when_it_is_full(spark, small_blocks, monkeypatch):
    """Of a list of 1,000 vertices only the first block is read."""
    read = []
    first_hits = keywords._first_hits

    def spied(words, vertices, postings, start, until, k):
        read.append((start, until, sorted(r.word for r in words.collect())))
        return first_hits(words, vertices, postings, start, until, k)

    monkeypatch.setattr(keywords, "_first_hits", spied)
    index = stored(spark, [f"abcd {k:04}" for k in range(999)] + ["zbcd abc bcde abcde"])
    asked = spark.createDataFrame([(1, "abcd"), (2, "abc"), (3, "abcde")], QUESTIONS)
    rows = keywords.search_keywords(asked, *index, 3).collect()
    got = {n: [r.id for r in sorted(rows, key=lambda r: r.place) if r.query_id == n] for n in (1, 2, 3)}
    assert got[1] == got[2] == [f"abcd {k:04}" for k in range(3)]
    assert got[3] == ["zbcd abc bcde abcde"]
    assert read == [(0, 4, ["abc", "abcd", "abcde"])]


def test_a_long_list_is_read_to_its_end(spark, small_blocks, monkeypatch):
    rounds = []
    first_hits = keywords._first_hits
    monkeypatch.setattr(keywords, "_first_hits", lambda *a: rounds.append(a[3:5]) or first_hits(*a))
    # Every run of "xyzxy" is in all vertices, the word in the last one only.
    index = stored(spark, [f"a{k:03} xyz zxy yzx" for k in range(60)] + ["b xyzxy"])
    rows = keywords.search_keywords(spark.createDataFrame([(1, "xyzxy")], QUESTIONS), *index).collect()
    assert [(r.id, r.place) for r in rows] == [("b xyzxy", 1)]
    assert rounds == [(0, 4), (4, 8), (8, 16), (16, 32), (32, 64)]


def test_only_needed_directories_are_read(spark):
    vertices, postings = stored(spark, ["Alpha", "Beta"])
    words = spark.createDataFrame([("alpha",)], "word string")
    runs = keywords.rarest_runs(words, postings)
    kept = keywords._within(postings, "bucket", runs)
    text = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in text and "bucket" in text.split("PartitionFilters: [")[1].split("]")[0]


def test_empty(spark):
    index = stored(spark, [])
    asked = spark.createDataFrame([(1, "word"), (2, None)], QUESTIONS)
    assert keywords.search_keywords(asked, *index).collect() == []
    index = stored(spark, ["Alpha", ""])
    assert keywords.search_keywords(asked.limit(0), *index).collect() == []


def test_another_session_and_new_vertices(spark, tmp_path):
    """The index is found again, and goes when the graph is written anew."""
    where = f"file:{tmp_path}/kept"
    store = Store(spark, "kept_keywords", where)
    vertices = spark.createDataFrame([("Alpha",), ("Beta",)], "id string")
    edges = spark.createDataFrame([("Alpha", "r", "Beta")], "src string, relationship string, dst string")
    assert store.write_graph(vertices, edges) and store.read_keywords() is None
    store.write_keywords(*keywords.build_keywords(store.read("graph_vertices")))
    again = Store(spark.newSession(), "kept_keywords", where)
    asked = spark.createDataFrame([(1, "BETA")], QUESTIONS)
    found = keywords.search_keywords(asked, *again.read_keywords())
    assert [tuple(r) for r in found.collect()] == [(1, "Beta", 1)]
    both = [graph.graph_context(asked, vertices, edges, seeds=s).collect() for s in (None, found)]
    assert both[0] == both[1] and len(both[0]) == 1
    assert store.write_graph(vertices, edges) and store.read_keywords() is None
