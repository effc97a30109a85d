import zlib

import numpy as np
import pytest

from lorekeep.llm import quality
from lorekeep.llm.queries import QUERIES


def area(good, score):
    """Chance that a good row scores above a bad one; ties count half."""
    a, b = score[good == 1], score[good == 0]
    return ((a[:, None] > b).sum() + 0.5 * (a[:, None] == b).sum()) / (len(a) * len(b))


def test_held_out(spark, read):
    folder = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in QUERIES["op1_quality_score"](spark, folder).collect()}
    assert set(rows) == {r.doc_id for r in read(folder)}
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in rows.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows.values())
    labels = {r.doc_id: r.quality for r in read(folder, "labels") if rows[r.doc_id].held_out}
    good, score = np.array(list(labels.values())), np.array([rows[k].score for k in labels])
    assert area(good, score) > 0.97
    assert np.mean((score >= 0.3) == good) > 0.93


def test_held_out_labels_teach_nothing(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    held = quality.fold(labels.doc_id) == 0
    flipped = labels.withColumn("quality", quality.F.when(held, 1 - labels.quality).otherwise(labels.quality))
    assert sorted(quality.score(docs, labels).collect()) == sorted(quality.score(docs, flipped).collect())


def test_equal_texts_score_alike(spark, odd):
    docs, labels = (spark.read.parquet(f"{odd}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.score(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)


@pytest.mark.parametrize("value, score", [(1, 1.0), (0, 0.0), (None, 0.5)])
def test_one_class(spark, small, value, score):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.createDataFrame([(k, value) for k in range(40)], "doc_id long, quality int")
    assert {r.score for r in quality.score(docs, labels).collect()} == {score}


def test_empty(spark, empty):
    assert QUERIES["op1_quality_score"](spark, empty).collect() == []


def test_isotonic():
    x, y = quality.isotonic(np.arange(6.0), np.array([0, 3, 1, 2, 5, 4.0]), np.array([5.0] * 6))
    assert y.tolist() == pytest.approx([0, 2 / 5, 9 / 10]) and np.all(np.diff(x) > 0)


def test_cosines_approximate_the_kernel():
    model = quality.Model(np.zeros(20), np.ones(20))
    x = np.random.default_rng(1).normal(size=(40, 20))
    f = model.features(x)[:, :-1]
    distance = ((x[:, None] - x) ** 2).sum(-1)
    assert np.abs(f @ f.T - np.exp(-distance / (2 * 20))).max() < 0.3
