"""Registered queries: one per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions import text as tx
from lorekeep.operators import cells, chunking, context, embedding, events, graph, keywords, knn, metrics, moments, rollups, stats
from lorekeep.operators.similarity import pair_similarity
from lorekeep.plans import flows
from lorekeep.plans import inputs as i
from lorekeep.session import cut_lineage, fresh_path
from lorekeep.sources import corpus
from lorekeep.sources.schemas import SCHEMAS
from lorekeep.sources.tables import DAY, Store
from lorekeep.streaming import index as stream_index
from lorekeep.streaming import rolling
from lorekeep.streaming import lifecycle as live
from lorekeep.streaming import sink

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Fixed values of the retention query.
AS_OF = datetime(2024, 1, 31, 12)
KEEP_DAYS = 7
GIVEN = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
         "embeddings", "pages", "benchmark", "labels", "conversations"]


def query(function: Query) -> Query:
    @wraps(function)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return function(spark, folder)

    QUERIES[function.__name__] = run
    return function


def _stamp(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") for c in columns})


def _six(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _long(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


def _joined(c) -> Column:
    return F.array_join(c, "|")


# Sources and sinks


@query
def corpus_scan(spark, folder):
    path = fresh_path(spark, "corpus")
    # A file per document, in folders per language.
    corpus.write_files(i.table(spark, folder, "documents"), path, "lang")
    lang = F.regexp_extract("source", r"lang=(\w+)", 1)
    # Every file ends with a line break.
    return corpus.corpus_scan(spark, path).select(lang.alias("lang"), F.regexp_replace("text", r"\n\z", "").alias("text"))


@query
def page_text(spark, folder):
    return corpus.page_texts(corpus.spread(i.table(spark, folder, "pages")))


@query
def markdown_text(spark, folder):
    docs = i.documents(spark, folder)
    # Lines become headings, list entries and quotes; words before a comma become bold.
    marked = F.regexp_replace(F.regexp_replace("text", r"\n", "\n## "), r"(\w+),", "**$1**, [$1](x/y) ")
    listed = F.when(F.col("lang") == "en", F.regexp_replace(marked, "## ", "* ")).otherwise(marked)
    return docs.select("doc_id", tx.markdown_text(listed).alias("text"))


def _chunks(spark, folder) -> DataFrame:
    return chunking.chunk_fixed(i.table(spark, folder, "documents"))


@query
def chunk_table(spark, folder):
    chunks = _chunks(spark, folder).select(chunking.chunk_key().alias("id"), "text", "source")
    return Store.scratch(spark).write_chunks(chunks)


@query
def graph_vertices(spark, folder):
    return _stored_graph(spark, folder)[0]


@query
def graph_edges(spark, folder):
    return _stored_graph(spark, folder)[1]


def _stored_graph(spark, folder) -> tuple[DataFrame, DataFrame]:
    found, store = i.extractions(spark, folder), Store.scratch(spark)
    store.write_graph(graph.graph_vertices(found), graph.graph_edges(found))
    return store.read_graph()


@query
def vector_table(spark, folder):
    rows = Store.scratch(spark).write_vectors(i.vectors(spark, folder), buckets=8)
    return rows.select(F.posexplode("embedding").alias("position", "value"), "id").select(
        "id", F.col("position").cast("long").alias("position"), F.round(F.col("value").cast("double"), 6).alias("value")
    )


def _index_before(spark, folder) -> DataFrame:
    """An index that is behind its source: documents with a vector, those labelled toxic
    with an old text, and entries of texts that are gone."""
    docs = i.table(spark, folder, "documents").select("doc_id", "text")
    known = i.table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    toxic = i.table(spark, folder, "labels").select("doc_id", "toxic")
    old = F.when(F.col("toxic") == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    present = docs.join(known, "doc_id").join(toxic, "doc_id", "left").select(
        F.col("doc_id").alias("id"), F.md5(old).alias("text_hash"), "embedding"
    )
    gone = i.table(spark, folder, "benchmark").select(
        (-1 - F.col("item_id")).alias("id"), F.md5("text").alias("text_hash"), F.array().cast("array<float>").alias("embedding")
    )
    return present.unionByName(gone)


@query
def index_refresh(spark, folder):
    source = i.vector_texts(spark, folder)
    return embedding.refresh_plan(source, _index_before(spark, folder)).select("id", "text_hash", "action")


@query
def index_synced(spark, folder):
    source = i.vector_texts(spark, folder)
    model = embedding.fit_embedder(source, 64)
    fresh = embedding.refreshed_index(source, _index_before(spark, folder), lambda rows: embedding.embed(rows, "id", model))
    return fresh.select("id", "text_hash", F.size("embedding").cast("long").alias("dimensions"))


def _vector_units(column: str = "embedding"):
    """A vector as text, in units of 0.0001."""
    return F.array_join(F.transform(column, lambda x: F.round(x.cast("double") * 10000).cast("long")), ",")


@query
def embed_hashed(spark, folder):
    rows = embedding.embed_with(i.vector_texts(spark, folder), "id", embedding.hashed_terms())
    return rows.select("id", _vector_units().alias("vector"))


@query
def index_written(spark, folder):
    """A stored index that is behind its source is brought up to date, twice, and read."""
    store, source = Store.scratch(spark), i.vector_texts(spark, folder)
    store.write_index(_index_before(spark, folder), 16)
    for _ in range(2):
        store.refresh_index(source, lambda rows: embedding.embed_with(rows, "id", embedding.hashed_terms()))
    return store.read("vectors").select("id", "text_hash", _vector_units().alias("vector"))


@query
def index_stream(spark, folder):
    """Texts arrive, change and go, then an old change of each comes late."""
    source, target, checkpoint = (fresh_path(spark, x) for x in ("changes", "index", "checkpoint"))
    docs = i.vector_texts(spark, folder).select("id", "text")
    other = (-1 - F.col("id")).alias("id")
    first = docs.select("id", F.concat("text", F.lit("!")).alias("text")).unionAll(docs.select(other, "text"))
    latest = docs.unionAll(docs.select(other, F.lit(None).cast("string").alias("text")))
    late = docs.select("id", F.concat("text", F.lit("?")).alias("text")).unionAll(docs.select(other, "text"))
    model = embedding.fit_embedder(docs, 64)
    for changed_at, rows in ((0, first), (2, latest), (1, late)):
        rows = rows.withColumn("changed_at", F.lit(changed_at))
        rows.write.mode("append").parquet(source)
        changes = spark.readStream.schema(rows.schema).parquet(source)
        stream_index.start_index_sync(
            changes, target, checkpoint, lambda rows: embedding.embed(rows, "id", model)
        ).awaitTermination()
    return stream_index.current_index(spark.read.parquet(target)).select(
        "id", "text_hash", F.size("embedding").cast("long").alias("dimensions")
    )


def _telemetry_store(spark, folder) -> Store:
    store = Store.scratch(spark)
    store.create_telemetry_tables()
    return store


@query
def telemetry_schema(spark, folder):
    """The six tables, filled from the given ones, with columns and row counts."""
    store, steps = _telemetry_store(spark, folder), cut_lineage(i.lifecycle_events(spark, folder))
    made = F.to_timestamp(F.lit("2024-02-01 00:00:00"))
    times = {"created_at": made, "updated_at": made}
    store.append("user_interactions", steps.filter("turn_id is not null").withColumn("created_at", made))
    store.append("sessions", rollups.session_rollup(steps).withColumns(times))
    store.append("conversations", rollups.conversation_rollup(steps).withColumns(times))
    store.append("turns", rollups.turn_rollup(steps).withColumns(times))
    store.append("evaluation_results", _results_for_table(spark, folder))
    store.append("performance_metrics", _metrics_for_table(spark, folder))
    counts = stats.table_counts({t: store.read(t) for t in SCHEMAS})
    columns = F.map_from_arrays(
        F.array(*[F.lit(t) for t in SCHEMAS]),
        F.array(*[F.array(*[F.lit(f.name) for f in s.fields]) for s in SCHEMAS.values()]),
    )
    return counts.select(
        F.col("name").alias("table_name"), F.explode(columns[F.col("name")]).alias("column_name"), F.col("n").alias("row_count")
    )


@query
def append_interactions(spark, folder):
    store = _telemetry_store(spark, folder)
    rows = i.telemetry(spark, folder).withColumn("created_at", F.col("timestamp"))
    back = events.payload_json(store.append("user_interactions", rows)).drop(DAY)
    return _stamp(back, "timestamp", "created_at")


def _results_for_table(spark, folder) -> DataFrame:
    return _results(spark, folder).withColumns(
        {
            "response_time_seconds": F.col("response_time"),
            "session_id": F.col("case_id").cast("string"),
            "created_at": F.to_timestamp(F.lit("2024-02-01 00:00:00")),
        }
    )


@query
def append_evaluations(spark, folder):
    back = _telemetry_store(spark, folder).append("evaluation_results", _results_for_table(spark, folder))
    return _long(_six(back.drop(DAY, "evaluation_timestamp", "created_at"), *_SCORES, "avg_relevance_score"), *_COUNTS)


def _metrics_for_table(spark, folder) -> DataFrame:
    rows = i.event_rows(spark, folder).filter("type = 'purchase'")
    return rows.select(
        "session_id",
        "turn_id",
        F.lit("response_time").alias("metric_name"),
        F.col("value").alias("metric_value"),
        F.get_json_object("props", "$.k").alias("metric_unit"),
        "timestamp",
        F.col("timestamp").alias("created_at"),
    )


@query
def append_perf_metrics(spark, folder):
    back = _telemetry_store(spark, folder).append("performance_metrics", _metrics_for_table(spark, folder))
    return _stamp(back.withColumn("metadata", F.to_json("metadata")).drop(DAY, "created_at"), "timestamp")


@query
def table_profile(spark, folder):
    store = Store.scratch(spark)
    for name in GIVEN:
        store.attach(name, f"{folder}/{name}.parquet")
    profiles = [store.profile(name) for name in GIVEN]
    all_rows = profiles[0]
    for p in profiles[1:]:
        all_rows = all_rows.unionByName(p)
    return all_rows.select(F.col("table").alias("table_name"), F.col("column").alias("column_name"), "type", "row_count")


@query
def retention(spark, folder):
    store = _telemetry_store(spark, folder)
    rows = i.lifecycle_events(spark, folder)
    store.append("user_interactions", i.telemetry(spark, folder).withColumn("created_at", F.col("timestamp")))
    sessions = rollups.session_rollup(rows)
    store.append("sessions", sessions.withColumns({"created_at": F.col("start_time"), "updated_at": F.col("last_activity")}))
    failed = {t: e for t, e in store.cleanup(KEEP_DAYS, AS_OF).items() if e}
    if failed:
        raise RuntimeError(str(failed))
    kept = [
        store.read(t).select(F.lit(t).alias("table_name"), F.col(key).alias("id"), "created_at")
        for t, key in (("user_interactions", "event_id"), ("sessions", "session_id"))
    ]
    return _stamp(kept[0].unionByName(kept[1]), "created_at")


# Chunking


@query
def chunk_recursive(spark, folder):
    return chunking.chunk_recursive(i.documents(spark, folder))


@query
def chunk_recursive_500(spark, folder):
    return chunking.chunk_recursive(i.documents(spark, folder), 500, 100)


@query
def chunk_recursive_plain(spark, folder):
    """Recursive splitting of texts without separators."""
    docs = i.documents(spark, folder).withColumn("text", F.translate("text", " \n\t", ""))
    return _long(chunking.chunk_recursive(docs), "chunk_no", "start_index")


@query
def chunk_fixed(spark, folder):
    return _long(_chunks(spark, folder), "chunk_no", "start_index")


@query
def chunk_ids(spark, folder):
    # Ids are given to written chunks, since they are read more than once.
    return chunking.dense_ids(cut_lineage(_chunks(spark, folder))).select("id", "doc_id", F.col("chunk_no").cast("long").alias("chunk_no"))


# Text functions


@query
def clean_text(spark, folder):
    return i.documents(spark, folder).select("doc_id", tx.clean_text("text").alias("clean"))


@query
def text_stats(spark, folder):
    rows = i.documents(spark, folder)
    return rows.select(
        "doc_id", tx.word_count("text").cast("long").alias("word_count"), F.length("text").cast("long").alias("length")
    )


@query
def doc_preview(spark, folder):
    return _long(stats.doc_previews(i.table(spark, folder, "documents")), "length")


@query
def doc_head(spark, folder):
    return _long(stats.doc_head(i.table(spark, folder, "documents")), "length", "more")


@query
def response_flags(spark, folder):
    flags = stats.response_flags("text")
    return i.table(spark, folder, "documents").select("doc_id", *[c.alias(n) for n, c in flags.items()])


@query
def topic_coverage(spark, folder):
    rows = i.topic_answers(spark, folder)
    found = stats.topics_found("response", "expected_topics")
    return rows.select(
        "doc_id",
        found.cast("long").alias("topics_found"),
        F.round(found / F.size("expected_topics"), 6).alias("topic_coverage"),
    )


@query
def performance_rows(spark, folder):
    rows = stats.performance_rows(i.topic_answers(spark, folder))
    return _long(_six(rows, "response_time", "topic_coverage"), "response_length", "topics_found", "total_topics")


@query
def valid_questions(spark, folder):
    asked = i.table(spark, folder, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("query_id"),
        # Messages of the system are asked as blanks.
        F.when(F.col("role") == "system", " \n").otherwise(F.concat(F.lit("\t"), "text", F.lit("  "))).alias("query"),
    )
    return context.valid_questions(asked)


# Evaluation

_SCORES = ["precision", "recall", "accuracy", "f1_score", "semantic_similarity", "answer_quality_score"]
_COUNTS = ["num_retrieved_docs", "num_relevant_docs"]


def _cases(spark, folder) -> DataFrame:
    return metrics.normalised_cases(i.eval_cases(spark, folder))


def _results(spark, folder) -> DataFrame:
    return metrics.evaluate(i.eval_cases(spark, folder), i.eval_docs(spark, folder))


def _relevance(spark, folder) -> DataFrame:
    return metrics.relevance_scores(i.eval_cases(spark, folder), i.eval_docs(spark, folder))


@query
def cases_normalised(spark, folder):
    ready = _cases(spark, folder)
    return ready.select("case_id", *metrics.REQUIRED, *[_joined(c).alias(c) for c in ("retrieved_docs", "relevant_docs")], "response_time")


@query
def cases_rejected(spark, folder):
    return metrics.rejected_cases(i.eval_cases(spark, folder))


def _lists() -> tuple[Column, Column]:
    return F.col("retrieved_docs"), F.col("relevant_docs")


@query
def precision(spark, folder):
    return _cases(spark, folder).select("case_id", F.round(metrics.precision(*_lists()), 6).alias("precision"))


@query
def recall(spark, folder):
    return _cases(spark, folder).select("case_id", F.round(metrics.recall(*_lists()), 6).alias("recall"))


@query
def f1_score(spark, folder):
    f1 = metrics.f1_score(metrics.precision(*_lists()), metrics.recall(*_lists()))
    return _cases(spark, folder).select("case_id", F.round(f1, 6).alias("f1_score"))


@query
def tfidf_similarity(spark, folder):
    scored = pair_similarity(_cases(spark, folder), ["case_id"], "expected_answer", "actual_answer")
    return _six(scored, "similarity")


@query
def length_score(spark, folder):
    return _cases(spark, folder).select("case_id", tx.length_score("actual_answer", "expected_answer").alias("length_score"))


@query
def completeness(spark, folder):
    score = tx.completeness("actual_answer", "expected_answer")
    return _cases(spark, folder).select("case_id", F.round(score, 6).alias("completeness"))


@query
def clarity(spark, folder):
    return i.documents(spark, folder).select("doc_id", F.round(tx.clarity("text"), 6).alias("clarity"))


@query
def answer_quality(spark, folder):
    scored = _cases(spark, folder)
    similar = pair_similarity(scored, ["case_id"], "actual_answer", "expected_answer")
    quality = metrics.answer_quality(F.col("similarity"), "actual_answer", "expected_answer")
    return scored.join(similar, "case_id").select("case_id", F.round(quality, 6).alias("answer_quality_score"))


@query
def relevance_scores(spark, folder):
    return _long(_six(_relevance(spark, folder), "score"), "pos")


@query
def relevance_labels(spark, folder):
    return _long(metrics.relevance_labels(_relevance(spark, folder)), "pos")


@query
def accuracy(spark, folder):
    return _six(metrics.label_accuracy(metrics.relevance_labels(_relevance(spark, folder))), "accuracy")


@query
def avg_relevance(spark, folder):
    means = _relevance(spark, folder).groupBy("case_id").agg(
        F.avg("score").alias("avg_relevance_score"), F.count("*").alias("num_retrieved_docs")
    )
    return _six(means, "avg_relevance_score")


@query
def eval_rows(spark, folder):
    rows = _results(spark, folder)
    return _long(_six(rows, *_SCORES, "avg_relevance_score"), *_COUNTS, "num_relevant_true")


@query
def eval_summary(spark, folder):
    return _six(metrics.summarise(_results(spark, folder)), *metrics.SUMMARY_MEANS)


@query
def metrics_rounded(spark, folder):
    return stats.rounded(_results(spark, folder))


@query
def metric_means(spark, folder):
    return _six(stats.metric_means(_results(spark, folder)), "mean")


def _stored_moments(spark, folder) -> DataFrame:
    """Moments of two batches of cases, the second evaluated by half at first."""
    store, cases, docs = Store.scratch(spark), i.eval_cases(spark, folder), i.eval_docs(spark, folder)
    late = F.col("query").like("%e%")
    flows.evaluate_batch(store, cases.filter(~late), "early", docs)
    flows.evaluate_batch(store, cases.filter(late & F.col("query").like("%a%")), "late", docs)
    return flows.evaluate_batch(store, cases.filter(late | late.isNull()), "late", docs)


@query
def eval_summary_stored(spark, folder):
    return _six(moments.summary(_stored_moments(spark, folder)), *metrics.SUMMARY_MEANS)


@query
def eval_reports_stored(spark, folder):
    """Means, correlations and shares, all from the same stored moments."""
    parts = _stored_moments(spark, folder)
    none, value = F.lit(None).cast("string"), lambda c: F.round(c, 6).alias("value")
    means = moments.metric_means(parts).select(F.lit("mean").alias("report"), "metric", none.alias("other"), value("mean"))
    both = moments.correlations(parts).select(F.lit("correlation").alias("report"), F.col("a").alias("metric"), F.col("b").alias("other"), value("correlation"))
    shares = moments.metric_shares(parts).select(F.lit("share").alias("report"), "metric", F.col("label").alias("other"), value("share"))
    return means.unionByName(both).unionByName(shares)


@query
def response_time_hist(spark, folder):
    return _long(_six(stats.histogram(_cases(spark, folder), "response_time"), "lower", "upper"), "bin", "n")


@query
def metric_corr(spark, folder):
    return _six(stats.correlations(_results(spark, folder)), "correlation")


@query
def metric_share(spark, folder):
    return _six(stats.metric_shares(_results(spark, folder)), "share")


# Retrieval and prompts


def _neighbours(spark, folder, k: int = 4) -> DataFrame:
    return knn.knn(i.vector_questions(spark, folder), i.vectors(spark, folder), k)


def _retrieved(spark, folder, k: int = 4) -> DataFrame:
    return context.attach_text(_neighbours(spark, folder, k), i.vector_texts(spark, folder))


def _vector_questions(spark, folder) -> DataFrame:
    texts = i.vector_texts(spark, folder).select(F.col("id").alias("query_id"), F.col("text").alias("query"))
    return texts.join(i.vector_questions(spark, folder).select("query_id"), "query_id", "left_semi")


@query
def knn_l2(spark, folder):
    return _long(_six(_neighbours(spark, folder), "distance"), "rank")


@query
def knn_lsh(spark, folder):
    found = knn.knn_lsh(i.vector_questions(spark, folder), i.vectors(spark, folder), 4)
    return _long(_six(found, "distance"), "rank")


@query
def knn_cells(spark, folder):
    lists, model = cells.build_cells(i.vectors(spark, folder))
    found = cells.search_cells(i.vector_questions(spark, folder), i.vectors(spark, folder), lists, model, 4)
    return _long(_six(found, "distance"), "rank")


@query
def knn_cells_all(spark, folder):
    """All cells and codes: the same rows as the exact search."""
    vectors = i.vectors(spark, folder)
    lists, model = cells.build_cells(vectors)
    everything = {"probes": len(model.centres), "shortlist": 1 << 20}
    found = cells.search_cells(i.vector_questions(spark, folder), vectors, lists, model, 4, **everything)
    return _long(_six(found, "distance"), "rank")


@query
def knn_preview(spark, folder):
    return _long(_six(context.previews(_retrieved(spark, folder, 3)), "distance"), "rank")


@query
def retrieve_chunks(spark, folder):
    return _long(_six(_retrieved(spark, folder), "distance"), "rank")


@query
def embed_chunks(spark, folder):
    docs = i.documents(spark, folder)
    rows = chunking.chunk_recursive(docs).select(chunking.chunk_key().alias("id"), "text")
    return embedding.embed(rows, "id", embedding.fit_embedder(docs))


@query
def retrieve_text(spark, folder):
    """Questions as texts: embed both sides, search, attach the chunks."""
    docs = i.documents(spark, folder)
    model, store = embedding.fit_embedder(docs), Store.scratch(spark)
    chunks = store.write_chunks(chunking.chunk_recursive(docs).select(chunking.chunk_key().alias("id"), "text", "source"))
    vectors = store.write_vectors(embedding.embed(chunks, "id", model))
    asked = context.valid_questions(i.questions(spark, folder)).withColumnRenamed("query", "text")
    found = knn.knn(embedding.embed(asked, "query_id", model), vectors, 4)
    return _six(context.attach_text(found, chunks), "distance")


@query
def format_context(spark, folder):
    return context.format_context(_retrieved(spark, folder))


def _messages(spark, folder) -> DataFrame:
    return context.prompts(_vector_questions(spark, folder), context.format_context(_retrieved(spark, folder)))


def _message_columns(messages: DataFrame) -> DataFrame:
    return messages.select(
        "query_id", F.col("messages")[0]["content"].alias("system_text"), F.col("messages")[1]["content"].alias("human_text")
    )


@query
def rag_prompt(spark, folder):
    return _message_columns(_messages(spark, folder))


@query
def llm_requests(spark, folder):
    return context.model_requests(_messages(spark, folder))


@query
def llm_responses(spark, folder):
    return context.model_responses(i.raw_responses(spark, folder))


# Graph


@query
def extract_triples(spark, folder):
    return graph.valid_triples(i.extractions(spark, folder), "doc_id")


@query
def extraction_parse(spark, folder):
    parsed = graph.parse_extractions(i.extraction_json(spark, folder))
    return parsed.select(
        "doc_id",
        _joined("entities").alias("entities"),
        _joined(F.transform("relationships", lambda r: F.array_join(r, ">"))).alias("relationships"),
    )


@query
def triples_valid(spark, folder):
    return graph.valid_triples(graph.parse_extractions(i.extraction_json(spark, folder)), "doc_id")


def _graph(spark, folder) -> tuple[DataFrame, DataFrame]:
    found = i.extractions(spark, folder)
    return graph.graph_vertices(found), graph.graph_edges(found)


@query
def vertex_keyword(spark, folder):
    vertices, _ = _graph(spark, folder)
    return _long(graph.match_vertices(i.questions(spark, folder), vertices), "place")


def _keyword_index(spark, folder) -> tuple[DataFrame, DataFrame]:
    vertices, _ = _graph(spark, folder)
    return Store.scratch(spark).write_keywords(*keywords.build_keywords(vertices))


@query
def vertex_runs(spark, folder):
    """The runs of the stored index, and how many vertices have them by its postings."""
    _, postings = _keyword_index(spark, folder)
    return postings.groupBy("gram").agg(F.sum(F.size("offsets")).cast("long").alias("n"), F.max("total").alias("total"))


@query
def vertex_keyword_stored(spark, folder):
    index = _keyword_index(spark, folder)
    return _long(keywords.search_keywords(i.questions(spark, folder), *index), "place")


@query
def seed_edges(spark, folder):
    vertices, edges = _graph(spark, folder)
    return graph.seed_edges(edges, graph.match_vertices(i.questions(spark, folder), vertices))


@query
def motif_one_hop(spark, folder):
    return graph.one_hop(graph.graph_edges(i.extractions(spark, folder)), i.labelled_vertices(spark, folder))


@query
def graph_context(spark, folder):
    return graph.graph_context(i.questions(spark, folder), *_graph(spark, folder))


@query
def graph_context_stored(spark, folder):
    """The vertices of the questions from the stored index."""
    store, asked = Store.scratch(spark), i.questions(spark, folder)
    found = cut_lineage(i.extractions(spark, folder))
    if not store.write_graph(graph.graph_vertices(found), graph.graph_edges(found)):
        return graph.graph_context(asked, graph.graph_vertices(found), graph.graph_edges(found))
    vertices, edges = store.read_graph()
    index = store.write_keywords(*keywords.build_keywords(vertices))
    seeds = cut_lineage(keywords.search_keywords(asked, *index))
    return graph.graph_context(asked, vertices, edges, seeds=seeds)


@query
def graph_context_paged(spark, folder):
    """Pages of seven lines, put together again."""
    pages = graph.graph_context(i.questions(spark, folder), *_graph(spark, folder), page_lines=7)
    parts = F.array_sort(F.collect_list(F.struct("page", "context")))
    return pages.groupBy("query_id").agg(F.array_join(F.transform(parts, lambda p: p["context"]), "").alias("context"))


@query
def graph_prompt(spark, folder):
    asked = i.questions(spark, folder)
    return _message_columns(context.graph_prompts(asked, graph.graph_context(asked, *_graph(spark, folder))))


@query
def corpus_counts(spark, folder):
    vertices, edges = _graph(spark, folder)
    return stats.table_counts(
        {
            "documents": i.table(spark, folder, "documents"),
            "chunks": _chunks(spark, folder),
            "vectors": i.vectors(spark, folder),
            "vertices": vertices,
            "edges": edges,
        }
    )


# Events


def _made(rows: DataFrame, kind: str) -> DataFrame:
    return events.payload_json(events.flatten(events.make_events(rows, kind)))


def _messages_of(spark, folder, role: str) -> DataFrame:
    return i.message_rows(spark, folder).filter(F.col("role") == role)


def _events_of(spark, folder, kind: str) -> DataFrame:
    return i.event_rows(spark, folder).filter(F.col("type") == kind)


@query
def event_query(spark, folder):
    return _made(_messages_of(spark, folder, "user").withColumn("query", F.col("text")), "query")


@query
def event_response(spark, folder):
    rows = _messages_of(spark, folder, "assistant")
    return _made(rows.withColumns({"response": F.col("text"), "response_time": F.length("text") / 100}), "response")


@query
def event_copy(spark, folder):
    rows = _messages_of(spark, folder, "assistant")
    return _made(rows.withColumns({"copied_text": F.col("text"), "source_element": F.lit("response_text")}), "copy")


@query
def event_click(spark, folder):
    rows = _events_of(spark, folder, "click")
    place = {"element": F.col("props"), "x": F.floor("value"), "y": F.pmod("source_id", F.lit(600))}
    return _made(rows.withColumns(place), "click")


@query
def event_hover(spark, folder):
    rows = _events_of(spark, folder, "view")
    return _made(rows.withColumns({"element": F.col("props"), "duration": F.col("value")}), "hover")


@query
def event_scroll(spark, folder):
    rows = _events_of(spark, folder, "view")
    return _made(rows.withColumns({"scroll_depth": F.col("value"), "scroll_direction": F.lit("down")}), "scroll")


@query
def event_dwell(spark, folder):
    rows = _events_of(spark, folder, "view")
    return _made(rows.withColumns({"element": F.col("props"), "dwell_time": F.col("value")}), "dwell")


@query
def event_abandonment(spark, folder):
    return _made(_events_of(spark, folder, "error").withColumn("abandonment_type", F.lit("error")), "abandonment")


@query
def event_follow_up(spark, folder):
    return _made(_events_of(spark, folder, "signup").withColumn("follow_up_type", F.col("props")), "follow_up")


@query
def event_perf(spark, folder):
    unit = F.create_map(F.lit("unit"), F.get_json_object("props", "$.k"))
    metric = {"metric_name": F.lit("response_time"), "metric_value": F.col("value"), "metadata": unit}
    return _made(_events_of(spark, folder, "purchase").withColumns(metric), "performance")


@query
def event_flatten(spark, folder):
    return events.flatten(events.valid_types(i.telemetry(spark, folder))).drop("data", "metadata")


@query
def payload_json(spark, folder):
    return events.payload_json(i.telemetry(spark, folder)).select("event_id", "data", "metadata")


@query
def event_ids(spark, folder):
    return i.telemetry(spark, folder).select("event_id", "turn_id", "interaction_type")


@query
def answer_events(spark, folder):
    rows = i.message_rows(spark, folder)
    own = F.split("source_id", "-")
    numbered = rows.withColumns({"conv": own[0].cast("long"), "turn": own[1].cast("long")})
    asked = numbered.filter("role = 'user'").select(*events.ENVELOPE, "conv", "turn", F.col("text").alias("query"))
    answered = numbered.filter("role = 'assistant'").select(
        "conv", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response"), (F.length("text") / 100).alias("response_time")
    )
    pairs = asked.join(answered, ["conv", "turn"]).withColumn("turn_id", F.concat_ws("-", "conversation_id", "conv", "turn"))
    return events.payload_json(events.flatten(events.answer_events(pairs)))


def _times(df: DataFrame) -> DataFrame:
    stamps = [c for c in ("start_time", "end_time", "last_activity") if c in df.columns]
    return _six(_stamp(df, *stamps), "duration_seconds")


@query
def session_rollup(spark, folder):
    return _long(_times(rollups.session_rollup(i.lifecycle_events(spark, folder))), "interaction_count")


@query
def conversation_rollup(spark, folder):
    return _long(_times(rollups.conversation_rollup(i.lifecycle_events(spark, folder))), "turn_count")


@query
def turn_rollup(spark, folder):
    rows = rollups.turn_rollup(i.lifecycle_events(spark, folder))
    return _long(_times(rows), "query_length", "response_length")


@query
def turn_pairs(spark, folder):
    return rollups.turn_pairs(i.table(spark, folder, "conversations"))


# Streams: each drains a folder of event files and returns what reached the sink.


def _event_stream(spark, folder, rows: DataFrame) -> DataFrame:
    path = fresh_path(spark, "events")
    rows.write.parquet(path)
    return sink.read_events(spark, path, rows.schema)


@query
def stream_sink(spark, folder):
    target, rows = fresh_path(spark, "sink"), i.telemetry(spark, folder).withColumn("created_at", F.col("timestamp"))
    # Half of the events arrive twice.
    again = rows.unionByName(rows.filter(F.col("interaction_type").isin("click", "scroll", "query")))
    sink.start_sink(_event_stream(spark, folder, again), target, fresh_path(spark, "checkpoint"), drain=True).awaitTermination()
    back = spark.read.schema(SCHEMAS["user_interactions"]).parquet(target).drop(DAY)
    return _stamp(events.payload_json(back), "timestamp", "created_at")


def _closed(spark, folder, level: str) -> DataFrame:
    target = fresh_path(spark, f"{level}s")
    stream = live.lifecycle_stream(_event_stream(spark, folder, i.lifecycle_events(spark, folder)), level)
    live.start_lifecycle(stream, target, fresh_path(spark, "checkpoint"), drain=True).awaitTermination()
    return _times(spark.read.schema(stream.schema).parquet(target).drop("timed_out"))


@query
def stream_sessions(spark, folder):
    return _long(_closed(spark, folder, "session"), "interaction_count")


@query
def stream_conversations(spark, folder):
    return _long(_closed(spark, folder, "conversation"), "turn_count")


@query
def stream_turns(spark, folder):
    return _long(_closed(spark, folder, "turn"), "query_length", "response_length").drop("is_active")


# Rows of a file that a stream reads.
FILE_ROWS = 250_000


def _send(parts: list[DataFrame], source: str, n: int):
    """Write the parts of about ``n`` rows, files of each as many as they need; the stream
    that takes each part as a micro-batch."""
    files = max(2, -(-n // FILE_ROWS))
    for part in parts:
        part.repartition(files).write.mode("append").parquet(source)
    return sink.read_events(parts[0].sparkSession, source, parts[0].schema, max_files=files)


# A session, conversation or turn without an event for so long, in seconds, has timed out.
IDLE = 3 * 86400


def _rolled(spark, folder, level: str) -> DataFrame:
    """Roll-ups of a stream of three micro-batches: the second half of the events, then half of
    the first half, late, then the rest, which corrects what was closed meanwhile."""
    rows, source, target = i.lifecycle_events(spark, folder), fresh_path(spark, "events"), fresh_path(spark, f"{level}s")
    late, even = F.col("timestamp") < F.lit("2024-01-16").cast("timestamp"), F.pmod(F.xxhash64("event_id"), F.lit(2)) == 0
    parts = [rows.filter(part) for part in (~late, late & even, late & ~even)]
    stream = _send(parts, source, i.table(spark, folder, "events").count())
    rolling.start_rolling(stream, level, target, fresh_path(spark, "checkpoint"), idle_seconds=IDLE, drain=True).awaitTermination()
    return _times(rolling.Rolling(spark, level, target).table())


@query
def stream_sessions_late(spark, folder):
    return _long(_rolled(spark, folder, "session"), "interaction_count")


@query
def stream_conversations_late(spark, folder):
    return _long(_rolled(spark, folder, "conversation"), "turn_count")


@query
def stream_turns_late(spark, folder):
    return _long(_rolled(spark, folder, "turn"), "query_length", "response_length")


@query
def stream_sink_days(spark, folder):
    """Events that are sent again on a later day, in batches of their own, are stored once."""
    target, source = fresh_path(spark, "sink"), fresh_path(spark, "events")
    rows = i.telemetry(spark, folder).withColumn("created_at", F.col("timestamp"))
    again = rows.filter(F.col("interaction_type").isin("click", "query")).withColumn("created_at", F.timestamp_add("DAY", F.lit(40), "created_at"))
    n = i.table(spark, folder, "events").count()
    stream = _send([rows.filter("interaction_type <> 'scroll'"), again, rows], source, n)
    sink.start_sink(stream, target, fresh_path(spark, "checkpoint"), drain=True).awaitTermination()
    back = spark.read.schema(SCHEMAS["user_interactions"]).parquet(target).drop(DAY)
    return _stamp(events.payload_json(back), "timestamp", "created_at")
