"""Folder to prompt."""

import pytest

from lorekeep.operators import context
from lorekeep.plans import flows
from lorekeep.sources.tables import Store

QUESTIONS = "query_id int, query string"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "sample.txt").write_text("Here is a small sample of text about pumps and ponds.")
    (tmp_path / "docs" / "stack.md").write_text("# Stack\n\nThe Data Lake feeds the Search Index nightly.")
    return str(tmp_path / "docs")


def test_index_and_ask(spark, folder):
    store = Store.scratch(spark)
    counts = {r["name"]: r["n"] for r in flows.build_index(spark, folder, store, with_graph=True, with_cells=True).collect()}
    assert counts == {"chunks": 2, "vectors": 2, "lists": 2, "vertices": 4, "edges": 1}
    asked = spark.createDataFrame([(1, " which sample document? "), (2, "what feeds the search index"), (3, "  ")], QUESTIONS)
    top = {r["query_id"]: r["text"] for r in flows.retrieve(store, asked, 1).collect()}
    assert set(top) == {1, 2} and "sample" in top[1] and "Lake" in top[2]
    near = lambda method: sorted(map(tuple, flows.retrieve(store, asked, 2, method=method).collect()))
    assert near("cells") == near("exact") and near("cells")[0][5].endswith("sample.txt")
    with pytest.raises(ValueError, match="exact or cells"):
        flows.retrieve(store, asked, method="other")
    messages = {r["query_id"]: r["messages"][1]["content"] for r in flows.ask(store, asked).collect()}
    assert messages[1].startswith("Question: which sample document?\n\nContext:\n\nHere is a small sample")
    graph = {r["query_id"]: r["messages"][1]["content"] for r in flows.ask_graph(store, asked).collect()}
    assert "- The Data Lake co_occurs_with Search Index" in graph[2]


def test_without_graph_tables(spark, folder):
    store = Store.scratch(spark)
    flows.build_index(spark, folder, store)
    asked = spark.createDataFrame([(1, "data")], QUESTIONS)
    assert flows.ask_graph(store, asked).first()["messages"][0]["content"] == context.GRAPH_SYSTEM


def test_missing_folder(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        flows.build_index(spark, str(tmp_path / "absent"), Store.scratch(spark))
