import zlib
from collections import Counter, defaultdict

import pytest

from lorekeep.llm import sharding
from lorekeep.llm.queries import QUERIES


@pytest.mark.parametrize("name", ["small", "odd"])
def test_law(spark, name, read, request):
    folder = request.getfixturevalue(name)
    rows = QUERIES["op8_balanced_shards"](spark, folder).collect()
    docs = read(folder)
    want = Counter((d.doc_id, len((d.text or "").encode()) + 8, zlib.crc32((d.text or "").encode())) for d in docs)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None and 0 <= r.shard < 24
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[k]) for k in range(24)]
    assert max(sizes) - min(sizes) <= 1


def test_empty(spark, empty):
    assert QUERIES["op8_balanced_shards"](spark, empty).collect() == []


def test_communities_stay_together(spark):
    """Forty communities of twelve texts that share a line, in four shards; one text is a
    third of all rows."""
    rows = [(k, f"line of community number {k % 40} here\nown words of text {k}") for k in range(480)]
    rows += [(1000 + k, "one text that many rows have, again and again") for k in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    placed = sharding.balanced_shards(docs, 4).cache()
    assert sorted(r["count"] for r in placed.groupBy("shard").count().collect()) == [180] * 4
    assert placed.filter("doc_id >= 1000").select("shard").distinct().count() <= 3
    kept, links = sharding.cut_edges(docs, placed).first()
    assert links == 480 and kept >= 0.85 * links


def test_no_python(spark, small):
    plan = QUERIES["op8_balanced_shards"](spark, small)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
