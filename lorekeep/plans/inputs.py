"""Inputs of the registered queries, derived from the given tables.

Each is a projection, grouping or equi-join over whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions.text import stable_id
from lorekeep.operators.events import KINDS, payload
from lorekeep.operators.graph import extract_entities, graph_vertices
from lorekeep.sources.corpus import spread

DOCS_PER_CASE = 10


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """The corpus, spread over all cores for work on its texts."""
    return spread(table(spark, folder, "documents").select("doc_id", "text", "lang", "source"))


def eval_cases(spark: SparkSession, folder: str) -> DataFrame:
    """One case per conversation.

    Question: the first user text. Expected and actual answer: the first and the last
    assistant text. Retrieved: the documents of the block of ten that has the
    conversation's number. Relevant: those of this and the next block labelled good.
    Response time: the value of the event with the conversation's number.
    """
    turns = table(spark, folder, "conversations")
    first = lambda role: F.min_by("text", F.when(F.col("role") == role, F.col("turn")))
    talks = turns.groupBy("conv_id").agg(
        first("user").alias("query"),
        first("assistant").alias("expected_answer"),
        F.max_by("text", F.when(F.col("role") == "assistant", F.col("turn"))).alias("actual_answer"),
    )
    ids = table(spark, folder, "documents").select("doc_id")
    block = F.floor(F.col("doc_id") / DOCS_PER_CASE)
    in_order = F.transform(F.array_sort(F.collect_list("doc_id")), lambda i: i.cast("string"))
    retrieved = ids.groupBy(block.alias("conv_id")).agg(in_order.alias("retrieved_docs"))
    good = table(spark, folder, "labels").filter("quality = 1").select("doc_id")
    relevant = (
        good.select("doc_id", F.explode(F.array(block, block - 1)).alias("conv_id"))
        .groupBy("conv_id")
        .agg(in_order.alias("relevant_docs"))
    )
    times = table(spark, folder, "events").select(F.col("event_id").alias("conv_id"), F.col("value").alias("response_time"))
    return (
        talks.join(retrieved, "conv_id", "left")
        .join(relevant, "conv_id", "left")
        .join(times, "conv_id", "left")
        .withColumnRenamed("conv_id", "case_id")
    )


def eval_docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "text")


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """The benchmark texts, asked as questions."""
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """All vectors, as a corpus."""
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def vector_questions(spark: SparkSession, folder: str) -> DataFrame:
    """All vectors again, as questions."""
    return vectors(spark, folder).withColumnRenamed("id", "query_id")


def vector_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The text a vector stands for: the document of the same number."""
    return table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")


def topic_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as an answer; those labelled toxic failed."""
    labels = table(spark, folder, "labels").select("doc_id", "toxic")
    return (
        table(spark, folder, "documents")
        .join(labels, "doc_id", "left")
        .select(
            "doc_id",
            F.col("source").alias("category"),
            F.array(F.lit("th"), F.lit("TION"), "source", "lang").alias("expected_topics"),
            F.col("text").alias("response"),
            (F.col("n_chars") / 1000).alias("response_time"),
            F.when(F.col("toxic") == 1, "blocked").alias("error"),
        )
    )


def extraction_json(spark: SparkSession, folder: str) -> DataFrame:
    """Extraction results of every document as a model would send them: JSON, cut off
    for German documents, and with two-part relationships for French ones."""
    found = extract_entities(documents(spark, folder).select("doc_id", "lang", "text"))
    pairs = F.transform("relationships", lambda r: F.slice(r, 1, 2))
    triples = F.when(F.col("lang") == "fr", pairs).otherwise(F.col("relationships"))
    body = F.to_json(F.struct("entities", triples.alias("relationships")))
    cut = F.when(F.col("lang") == "de", F.substring(body, F.lit(1), F.length(body) - 1)).otherwise(body)
    return found.select("doc_id", cut.alias("body"))


def extractions(spark: SparkSession, folder: str) -> DataFrame:
    return extract_entities(documents(spark, folder).select("doc_id", "text"))


def labelled_vertices(spark: SparkSession, folder: str) -> DataFrame:
    """Entities of the labelled documents; edges of other documents may dangle."""
    labelled = table(spark, folder, "labels").select("doc_id")
    docs = documents(spark, folder).select("doc_id", "text").join(labelled, "doc_id", "left_semi")
    return graph_vertices(extract_entities(docs))


def raw_responses(spark: SparkSession, folder: str) -> DataFrame:
    """Every message as an endpoint's answer: the assistant's in full, the user's
    without choices, the system's cut off."""
    turns = table(spark, folder, "conversations")
    message = F.struct(F.col("text").alias("content")).alias("message")
    full = F.to_json(F.struct(F.array(F.struct(message)).alias("choices")))
    body = (
        F.when(F.col("role") == "assistant", full)
        .when(F.col("role") == "user", '{"choices":[]}')
        .otherwise(F.substring(full, F.lit(1), F.length(full) - 1))
    )
    return turns.select(F.concat_ws("-", "conv_id", "turn").alias("query_id"), body.alias("body"))


def _ids(key, day) -> list:
    """Session, conversation and turn of a user's events: eight days, four days, and
    the event number's remainder by three."""
    session = F.concat_ws("-", "user_id", F.floor(day / 8))
    conversation = F.concat_ws("-", session, F.floor(day / 4))
    return [
        session.alias("session_id"),
        conversation.alias("conversation_id"),
        F.concat_ws("-", conversation, F.pmod(key, F.lit(3))).alias("turn_id"),
        F.col("user_id").cast("string").alias("user_id"),
    ]


def event_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The event table with an envelope."""
    return table(spark, folder, "events").select(
        *_ids(F.col("event_id"), F.dayofmonth("ts")),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("event_id").alias("source_id"),
        F.col("event_type").alias("type"),
        "value",
        "props",
    )


def message_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The conversation table with an envelope; a message takes the time of the event
    that has the conversation's number."""
    times = table(spark, folder, "events").select(F.col("event_id").alias("conv_id"), "ts", "user_id")
    return (
        table(spark, folder, "conversations")
        .join(times, "conv_id")
        .select(
            *_ids(F.col("conv_id"), F.dayofmonth("ts")),
            F.col("ts").cast("timestamp").alias("timestamp"),
            F.concat_ws("-", "conv_id", "turn").alias("source_id"),
            "role",
            "text",
        )
    )


def telemetry(spark: SparkSession, folder: str) -> DataFrame:
    """Events of five kinds, in one pass: signup → query, purchase → response, click,
    view → scroll, error → abandonment."""
    rows = event_rows(spark, folder)
    kinds = {
        "signup": ("query", {"query": F.col("props")}),
        "purchase": ("response", {"response": F.col("props"), "response_time": F.col("value")}),
        "click": ("click", {"element": F.col("props")}),
        "view": ("scroll", {"scroll_depth": F.col("value"), "scroll_direction": F.lit("down")}),
        "error": ("abandonment", {"abandonment_type": F.lit("error")}),
    }
    kind, data, form = F.lit(None).cast("string"), F.lit(None).cast("map<string,string>"), F.lit(None).cast("string")
    for given, (name, entries) in kinds.items():
        is_it = F.col("type") == given
        kind = F.when(is_it, name).otherwise(kind)
        data = F.when(is_it, payload(entries)).otherwise(data)
        form = F.when(is_it, KINDS[name].event_type).otherwise(form)
    return rows.select(
        stable_id("type", "session_id", "conversation_id", "turn_id", F.unix_micros("timestamp"), "source_id").alias("event_id"),
        "session_id",
        "conversation_id",
        "turn_id",
        "user_id",
        kind.alias("interaction_type"),
        form.alias("event_type"),
        "timestamp",
        data.alias("data"),
        F.create_map().cast("map<string,string>").alias("metadata"),
    )


def lifecycle(events: DataFrame) -> DataFrame:
    """Start and end rows of every session, conversation and turn: a start at its first
    event, and an end at its last if that is an answer or an abandonment."""
    keys = ["session_id", "conversation_id", "turn_id"]
    levels = []
    for n, level in enumerate(["session", "conversation", "turn"], start=1):
        own = keys[:n]
        span = events.groupBy(*own, "user_id").agg(
            F.min("timestamp").alias("start"),
            F.max(F.struct("timestamp", "event_id", "interaction_type")).alias("last"),
        )
        closes = F.col("last.interaction_type").isin("response", "abandonment")
        marks = F.array(
            F.struct(F.lit(f"{level}_start").alias("interaction_type"), F.col("start").alias("timestamp")),
            F.when(
                closes, F.struct(F.lit(f"{level}_end").alias("interaction_type"), F.col("last.timestamp").alias("timestamp"))
            ),
        )
        rows = span.select(*own, "user_id", F.inline(F.filter(marks, lambda m: m.isNotNull())))
        if level == "turn":
            # A turn that starts is an event of its conversation.
            rows = rows.select("session_id", "conversation_id", "turn_id", "user_id", "interaction_type", "timestamp")
        else:
            rows = rows.select(
                *[F.col(k) if k in own else F.lit(None).cast("string").alias(k) for k in keys],
                "user_id",
                "interaction_type",
                "timestamp",
            )
        levels.append(rows)
    marks = levels[0].unionByName(levels[1]).unionByName(levels[2])
    return events.unionByName(
        marks.select(
            stable_id("interaction_type", "session_id", "conversation_id", "turn_id", F.unix_micros("timestamp")).alias(
                "event_id"
            ),
            *keys,
            "user_id",
            "interaction_type",
            F.lit("system_event").alias("event_type"),
            "timestamp",
            F.create_map().cast("map<string,string>").alias("data"),
            F.create_map().cast("map<string,string>").alias("metadata"),
        )
    )


def lifecycle_events(spark: SparkSession, folder: str) -> DataFrame:
    return lifecycle(telemetry(spark, folder))
