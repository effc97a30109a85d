"""Registered queries of the operators, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm import (
    bpe,
    caps,
    centroids,
    conversation,
    decontaminate,
    jaccard,
    language,
    packed,
    personal,
    quality,
    repetition,
    secrets,
    sharding,
)
from lorekeep.llm.common import table
from lorekeep.session import fresh_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function):
    @wraps(function)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return function(spark, folder)

    QUERIES[function.__name__] = run
    return function


def _listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _of(*kinds: str) -> Column:
    return F.filter("spans", lambda s: s["kind"].isin(*kinds))


def _digest(base: tuple[str, ...]) -> list[Column]:
    counts = [F.size(_of(kind)).cast("long").alias(f"n_{kind}") for kind in base]
    return [*counts, F.sha2(_listed(_of(*base)), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans")]


@query
def op1_quality_score(spark, folder):
    return quality.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op2_token_ids(spark, folder):
    path = fresh_path(spark, "ids")
    packed.write_ids(table(spark, folder, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return packed.read_documents(spark, path)


@query
def op3_bpe_chunks(spark, folder):
    return bpe.digests(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op4_secret_scan(spark, folder):
    found = secrets.find_secrets(table(spark, folder, "documents"), ["doc_id"])
    return found.select("doc_id", *_digest(("assign", "access", "hex")))


@query
def op5_personal_data(spark, folder):
    found = personal.personal_spans(table(spark, folder, "documents"))
    return found.select("doc_id", *_digest(("email", "ip", "card", "phone")))


@query
def op6_decontamination(spark, folder):
    hits = decontaminate.benchmark_hits(table(spark, folder, "documents"), table(spark, folder, "benchmark"), ["doc_id"])
    return hits.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
    )


@query
def op7_language_id(spark, folder):
    provenance = language.page_evidence(table(spark, folder, "pages"))
    return language.identify(table(spark, folder, "documents"), provenance).drop("row")


@query
def op8_balanced_shards(spark, folder):
    return sharding.balanced_shards(table(spark, folder, "documents"))


@query
def op9_near_duplicates(spark, folder):
    return jaccard.near_duplicates(table(spark, folder, "documents"), jaccard.SHINGLE, jaccard.SIMILARITY).drop("row", "root")


@query
def op10_quality_rules(spark, folder):
    return repetition.quality_rules(table(spark, folder, "documents"), ["doc_id"])


@query
def op11_conversation_repair(spark, folder):
    rows = table(spark, folder, "conversations")
    return conversation.digests(rows, conversation.damage(rows))


@query
def op12_centroid_clusters(spark, folder):
    return centroids.cluster_vectors(table(spark, folder, "embeddings"))


@query
def op13_near_vectors(spark, folder):
    return caps.near_vectors(table(spark, folder, "embeddings"))
