"""The stored index of vectors that is brought up to date."""

import pytest
from pyspark.sql import functions as F

from lorekeep.operators import embedding
from lorekeep.plans import flows
from lorekeep.sources.tables import Store

TEXTS = "id long, text string"


def unit(rows):
    return embedding.embed_with(rows, "id", embedding.hashed_terms(8))


def state(store):
    return {r["id"]: (r["text_hash"], list(r["embedding"])) for r in store.read("vectors").collect()}


def by_hand(spark, texts):
    rows = spark.createDataFrame(texts, TEXTS)
    return {r["id"]: (r["text_hash"], list(r["embedding"])) for r in embedding.index_rows(rows, unit).collect()}


def counts(rows):
    return {r["action"]: r["n"] for r in rows.collect()}


def files(store):
    """Bucket to names of its files."""
    out = {}
    for r in store.read("vectors").select("bucket", F.input_file_name().alias("file")).distinct().collect():
        out.setdefault(r["bucket"], set()).add(r["file"])
    return out


@pytest.fixture
def store(spark):
    store = Store.scratch(spark)
    rows = spark.createDataFrame([(n, f"word{n} and word{n % 7}") for n in range(200)], TEXTS)
    store.write_index(embedding.index_rows(rows, unit), 16)
    return store


def test_hashed_terms(spark):
    rows = spark.createDataFrame([(1, "Ab ab, cd!"), (2, ""), (3, None), (4, "a b c"), (5, "cd " * 50_000)], TEXTS)
    out = {r["id"]: r["embedding"] for r in unit(rows).collect()}
    assert sorted(x for x in out[1] if x) == pytest.approx([1 / 5**0.5, 2 / 5**0.5], abs=1e-6)
    assert out[2] == out[3] == out[4] == [0.0] * 8
    assert sorted(out[5]) == [0.0] * 7 + [1.0]


def test_all_changes(spark, store):
    texts = [(n, f"word{n} and word{n % 7}") for n in range(200) if n % 10] + [(7, "other")] + [(500, "a new one")]
    texts = [t for t in texts if t != (7, "word7 and word0")]
    source = spark.createDataFrame(texts, TEXTS)
    assert counts(store.refresh_index(source, unit)) == {"insert": 1, "update": 1, "delete": 20}
    assert state(store) == by_hand(spark, texts)
    assert counts(store.refresh_index(source, unit)) == {}
    assert state(store) == by_hand(spark, texts)


def test_only_touched_buckets_are_written(spark, store):
    before = files(store)
    texts = [(n, f"word{n} and word{n % 7}") for n in range(200)]
    source = spark.createDataFrame([*texts[:-1], (199, "changed")], TEXTS)
    seen = spark.sparkContext.accumulator(0)

    def counted(rows):
        def tell(parts):
            for part in parts:
                seen.add(len(part))
                yield part

        return unit(rows.mapInPandas(tell, TEXTS))

    store.refresh_index(source, counted)
    after = files(store)
    assert sum(before[b] != after[b] for b in before) == 1 and before.keys() == after.keys()
    # The one text that changed went to the model, no other.
    assert seen.value == 1


def test_emptied_buckets_go_and_come_back(spark, store):
    nothing = spark.createDataFrame([], TEXTS)
    assert counts(store.refresh_index(nothing, unit)) == {"delete": 200}
    assert state(store) == {} and spark.sql(f"SHOW PARTITIONS {store.name('vectors')}").count() == 0
    texts = [(1, "back again"), (2, "and another")]
    assert counts(store.refresh_index(spark.createDataFrame(texts, TEXTS), unit, 4)) == {"insert": 2}
    assert state(store) == by_hand(spark, texts)
    assert all(b.endswith("-of-4") for b in files(store))


def test_some_buckets_emptied_others_left(spark, store):
    gone = {r["id"] for r in store.read("vectors").filter("bucket = '3-of-16'").collect()}
    one = store.read("vectors").filter("bucket = '4-of-16'").first()["id"]
    texts = [(n, f"word{n} and word{n % 7}") for n in range(200) if n not in gone and n != one]
    assert counts(store.refresh_index(spark.createDataFrame(texts, TEXTS), unit)) == {"delete": len(gone) + 1}
    assert state(store) == by_hand(spark, texts) and "3-of-16" not in files(store) and "4-of-16" in files(store)


def test_nulls_and_repeated_ids(spark, store):
    texts = [(n, f"word{n} and word{n % 7}") for n in range(2, 200)]
    odd = [*texts, (0, None), (1, ""), (None, "no id"), (300, "one"), (300, "one"), (301, "b"), (301, "a")]
    # md5("a") begins with 0c, md5("b") with 92.
    assert counts(store.refresh_index(spark.createDataFrame(odd, TEXTS), unit)) == {"delete": 1, "update": 1, "insert": 2}
    assert state(store) == by_hand(spark, [*texts, (1, ""), (300, "one"), (301, "a")])


def test_a_lost_bucket_is_made_again(spark, store):
    texts = [(n, f"word{n} and word{n % 7}") for n in range(200)]
    want = state(store)
    lost = store.read("vectors").filter("bucket = '5-of-16'").count()
    spark.sql(f"ALTER TABLE {store.name('vectors')} DROP PARTITION (bucket = '5-of-16')")
    assert counts(store.refresh_index(spark.createDataFrame(texts, TEXTS), unit)) == {"insert": lost}
    assert state(store) == want


def test_string_ids_and_more_columns(spark):
    store = Store.scratch(spark)
    schema = "id string, text string, text_hash int, bucket string, embedding int"
    named = lambda rows: embedding.embed_with(rows, "id", embedding.hashed_terms(4))
    rows = spark.createDataFrame([("x", "first text", 1, "b", 1), ("y", "second text", 1, "b", 1)], schema)
    store.write_index(embedding.index_rows(rows, named), 2)
    later = spark.createDataFrame([("x", "first text", 2, "c", 2), ("z", "third text", 2, "c", 2)], schema)
    assert counts(store.refresh_index(later, named)) == {"insert": 1, "delete": 1}
    assert {r["id"] for r in store.read("vectors").collect()} == {"x", "z"}


def test_folder_that_changes(spark, tmp_path):
    folder = tmp_path / "docs"
    folder.mkdir()
    (folder / "one.txt").write_text("Pumps move water through the pond.")
    (folder / "two.txt").write_text("Gardens need light and good soil.")
    store = Store.scratch(spark)
    flows.build_index(spark, str(folder), store, with_cells=True)
    assert counts(flows.refresh_index(spark, str(folder), store)) == {}
    (folder / "two.txt").write_text("Gardens need shade, water and good soil.")
    (folder / "three.txt").write_text("Soil is full of life.")
    assert counts(flows.refresh_index(spark, str(folder), store)) == {"update": 1, "insert": 1}
    asked = spark.createDataFrame([(1, "shade for gardens")], "query_id int, query string")
    for method in ("exact", "cells"):
        rows = flows.retrieve(store, asked, 3, method=method).collect()
        assert len(rows) == 3 and rows[0]["text"].startswith("Gardens need shade")
    (folder / "one.txt").unlink()
    assert counts(flows.refresh_index(spark, str(folder), store)) == {"delete": 1}
    assert len(flows.retrieve(store, asked, 3).collect()) == 2
