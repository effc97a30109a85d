"""The splitter against a piece-by-piece reading of its rules."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorekeep.operators import chunking as c
from lorekeep.session import settings as conf


def pieces(text, separator):
    if separator == "":
        return list(text)
    first, *rest = text.split(separator)
    return [p for p in [first, *[separator + r for r in rest]] if p]


def merge(parts, size, overlap):
    out, held = [], []
    for part in parts:
        if held and sum(map(len, held)) + len(part) > size:
            out.append("".join(held))
            while held and (sum(map(len, held)) > overlap or sum(map(len, held)) + len(part) > size):
                held.pop(0)
        held.append(part)
    return out + (["".join(held)] if held else [])


def brute(text, size, overlap, separators=("\n\n", "\n", " ", "")):
    at = next(n for n, s in enumerate(separators) if s == "" or s in text)
    out, held = [], []
    for part in pieces(text, separators[at]):
        if len(part) < size:
            held.append(part)
            continue
        out += merge(held, size, overlap)
        held = []
        out += brute(part, size, overlap, separators[at + 1 :]) if at + 1 < len(separators) else [part]
    return [s for s in (x.strip() for x in out + merge(held, size, overlap)) if s]


TEXT = st.text(alphabet="ab \nç", max_size=120) | st.lists(
    st.sampled_from(["word", " ", "\n", "\n\n", "longerword" * 3, ". ", "é"]), max_size=60
).map("".join)


@settings(max_examples=400, deadline=None, database=None)
@given(TEXT, st.integers(2, 20), st.data())
def test_split_is_brute_force(text, size, data):
    overlap = data.draw(st.integers(0, size - 1))
    got = c.split_text(text, size, overlap)
    assert [g[2] for g in got] == (brute(text, size, overlap) if text else [])
    assert [g[0] for g in got] == list(range(len(got)))
    for _, start, chunk in got:
        assert len(chunk) <= size
        assert start >= 0 and text[start : start + len(chunk)] == chunk


def test_without_separators_it_is_the_window_split(spark):
    texts = ["x" * n for n in (1, 199, 200, 201, 1199, 1200, 1201, 2200, 2201, 5000)] + ["", None]
    docs = spark.createDataFrame([(n, t, "s") for n, t in enumerate(texts)], "doc_id long, text string, source string")
    a = {tuple(r) for r in c.chunk_recursive(docs).collect()}
    b = {tuple(r) for r in c.chunk_fixed(docs).collect()}
    assert a == b and a


def test_real_texts(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for size, overlap in ((1200, 200), (500, 100)):
        rows = c.chunk_recursive(docs, size, overlap).join(docs.select("doc_id", F.col("text").alias("whole")), "doc_id").collect()
        assert all(len(r["text"]) <= size for r in rows)
        assert all(r["whole"][r["start_index"] :].startswith(r["text"]) for r in rows)
        by_doc = {}
        for r in sorted(rows, key=lambda r: r["chunk_no"]):
            by_doc.setdefault(r["doc_id"], (r["whole"], []))[1].append(r["text"])
        assert all(brute(whole, size, overlap) == got for whole, got in by_doc.values())


def test_dense_ids_over_ranges(spark):
    rows = [(d, n) for d in (0, 3, 7, 12, 13) for n in range(d % 4 + 1)]
    chunks = spark.createDataFrame(rows, "doc_id long, chunk_no int")
    got = sorted((r["id"], r["doc_id"], r["chunk_no"]) for r in c.dense_ids(chunks).collect())
    assert got == [(n, d, k) for n, (d, k) in enumerate(rows)]
    sizes = chunks.groupBy("doc_id").agg(F.count("*").alias("n"))
    cut = {r["doc_id"]: r["offset"] for r in c._offsets(sizes, "doc_id", "n").collect()}
    assert cut == {d: sum(1 for r in rows if r[0] < d) for d in cut}


@pytest.mark.parametrize("parts", ["1", "3", "16"])
def test_dense_ids_of_any_key(spark, parts):
    """Words and nulls as keys, columns named like the operator's own, a document with a third of all chunks."""
    names = ["", "Ab", "a", "b", "b-10", "b-9", "é", None]
    rows = [(d, n) for k, d in enumerate(names) for n in range(300 if d == "b" else 20 * k + 1)]
    chunks = spark.createDataFrame(rows, "doc_id string, chunk_no int").selectExpr("*", "'x' AS offset", "1 AS n")
    with conf(spark, {"spark.sql.shuffle.partitions": parts}):
        out = c.dense_ids(chunks).collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1]))
    assert [(r["doc_id"], r["chunk_no"]) for r in sorted(out, key=lambda r: r["id"])] == want
    assert sorted(r["id"] for r in out) == list(range(len(rows))) and out[0]["offset"] == "x"


def test_dense_ids_of_nothing(spark):
    assert c.dense_ids(spark.createDataFrame([], "doc_id date, chunk_no int")).collect() == []


def test_windows_of_any_overlap(spark):
    text = "añ\n😀 x" * 40
    docs = spark.createDataFrame([(1, text, "s"), (2, "ab", "s"), (3, "", "s"), (4, None, "s")], "doc_id long, text string, source string")
    for size, overlap in ((10, 0), (10, 3), (10, 5), (10, 9), (7, 6), (300, 299), (1, 0)):
        step = size - overlap
        want = {
            (d, i, i * step, t[i * step : i * step + size])
            for d, t in ((1, text), (2, "ab"))
            for i in range(len(t))
            if i == 0 or i * step + overlap < len(t)
        }
        got = c.chunk_fixed(docs, size, overlap).collect()
        assert len(got) == len(want)
        assert {(r["doc_id"], r["chunk_no"], r["start_index"], r["text"]) for r in got} == want


def test_long_text_is_cut_in_linear_time(spark):
    docs = spark.range(1).select(
        F.lit(1).alias("doc_id"), F.repeat(F.lit("0123456789"), 3_000_000).alias("text"), F.lit("s").alias("source")
    )
    rows = c.chunk_fixed(docs).agg(F.count("*"), F.max("start_index"), F.min(F.length("text"))).first()
    assert tuple(rows) == (30_000, 29_999_000, 1000)
