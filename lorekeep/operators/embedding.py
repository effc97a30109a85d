"""Vectors for texts: a distributed job with a pluggable model."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EMBEDDING = "array<float>"


def fit_embedder(texts: DataFrame, dimensions: int = 256) -> PipelineModel:
    """Hashed TF-IDF of unit length. Fitting is one aggregation; the model holds one
    weight per dimension, however large the corpus."""
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol="text", outputCol="_words", pattern=r"[^\p{L}\p{N}_]+", minTokenLength=2),
            HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dimensions),
            IDF(inputCol="_tf", outputCol="_tfidf"),
            Normalizer(inputCol="_tfidf", outputCol="_unit"),
        ]
    ).fit(texts.select("text"))


def embed(rows: DataFrame, key: str, model: PipelineModel) -> DataFrame:
    """``key, embedding`` from ``key, text``; a narrow map."""
    return model.transform(rows.select(key, "text")).select(
        key, vector_to_array("_unit", "float32").alias("embedding")
    )


def embed_with(
    rows: DataFrame, key: str, function: Callable[[pd.Series], pd.Series], *, batch: int = 256
) -> DataFrame:
    """``key, embedding`` by a user's own model: ``function`` maps a batch of texts to
    one list of floats each."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), batch):
                piece = part.iloc[at : at + batch]
                yield pd.DataFrame({key: piece[key], "embedding": list(function(piece["text"]))})

    key_type = rows.schema[key].dataType.simpleString()
    return rows.select(key, "text").mapInPandas(run, f"`{key}` {key_type}, embedding {EMBEDDING}")


def hashed_terms(dimensions: int = 64) -> Callable[[pd.Series], pd.Series]:
    """A function for ``embed_with`` that needs no fitting: how often the words of a text fall
    into each of ``dimensions`` slots by md5, at unit length. A text without words has zeros."""

    def run(texts: pd.Series) -> pd.Series:
        slots: dict[str, int] = {}

        def vector(text: str | None) -> np.ndarray:
            words = [w for w in re.split(r"[^a-z0-9]+", (text or "").lower()) if len(w) > 1]
            for w in set(words) - slots.keys():
                slots[w] = int(hashlib.md5(w.encode()).hexdigest()[:7], 16) % dimensions
            counts = np.bincount([slots[w] for w in words], minlength=dimensions).astype(float)
            return (counts / max(np.sqrt(np.sum(counts * counts)), 1.0)).astype(np.float32)

        return texts.map(vector)

    return run


def index_rows(texts: DataFrame, embedder: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``id, text_hash, embedding`` of ``id, text``: what an index that can be refreshed holds."""
    hashes = texts.select("id", F.md5("text").alias("text_hash"))
    return embedder(texts.select("id", "text")).join(hashes, "id").select("id", "text_hash", "embedding")


def changed(source: DataFrame, index: DataFrame) -> DataFrame:
    """``id, text_hash, action`` of the ids whose entry has to be inserted, updated or deleted.

    Rows of ``source`` without an id or a text count as absent, so the entry of a text that
    became null goes. Of several texts of one id the one with the least hash counts. Only
    hashes are shuffled, no texts.
    """
    texts = source.filter(F.col("id").isNotNull() & F.col("text").isNotNull())
    new = texts.select("id", F.md5("text").alias("text_hash")).groupBy("id").agg(F.min("text_hash").alias("text_hash"))
    old = index.select("id", F.col("text_hash").alias("old_hash"))
    action = F.when(F.col("text_hash").isNull(), "delete").when(F.col("old_hash").isNull(), "insert").otherwise("update")
    joined = new.join(old, "id", "full_outer").filter(~F.col("text_hash").eqNullSafe(F.col("old_hash")))
    return joined.select("id", "text_hash", action.alias("action"))


def refresh_plan(source: DataFrame, index: DataFrame) -> DataFrame:
    """What an index needs to follow its source: ``id, text, text_hash, action``.

    ``source`` is (id, text), ``index`` is (id, text_hash). Only hashes are compared,
    in one join on the key.
    """
    new = source.select("id", "text", F.md5("text").alias("text_hash"))
    old = index.select("id", F.col("text_hash").alias("old_hash"))
    action = (
        F.when(F.col("text_hash").isNull(), "delete")
        .when(F.col("old_hash").isNull(), "insert")
        .when(F.col("old_hash") != F.col("text_hash"), "update")
        .otherwise("keep")
    )
    return new.join(old, "id", "full_outer").select("id", "text", "text_hash", action.alias("action"))


def refreshed_index(
    source: DataFrame, index: DataFrame, embedder: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """The index (``id, text_hash, embedding``) brought up to date: kept vectors are
    reused, only new and changed texts are embedded, and stale ids drop out."""
    new, same = source.select("id", "text", F.md5("text").alias("text_hash")), ["id", "text_hash"]
    kept = index.select(*same, "embedding").join(new.select(*same), same, "left_semi")
    todo = new.join(index.select(*same), same, "left_anti")
    fresh = embedder(todo.select("id", "text")).join(todo.select(*same), "id")
    return kept.unionByName(fresh.select(*same, "embedding"))
