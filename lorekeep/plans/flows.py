"""From a folder of documents to prompts: the operators in the order a user needs them."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.operators import cells, chunking, context, embedding, graph, keywords, knn, metrics, moments, stats
from lorekeep.session import cut_lineage
from lorekeep.sources.corpus import corpus_scan, plain_texts
from lorekeep.sources.tables import Store

EMBEDDER = "embedder"


def build_index(
    spark: SparkSession,
    folder: str,
    store: Store,
    *,
    size: int = 1200,
    overlap: int = 200,
    dimensions: int = 256,
    with_graph: bool = False,
    with_cells: bool = False,
) -> DataFrame:
    """Chunk, vector and, if asked for, graph tables with their keyword index, and an index of
    cells of all files below ``folder``. Returns ``name, n``. Each step reads the table the one before has written."""
    chunks = store.write_chunks(_chunks(spark, folder, size, overlap))
    model = embedding.fit_embedder(chunks, dimensions)
    model.write().overwrite().save(store.path(EMBEDDER))
    rows = embedding.index_rows(chunks, lambda texts: embedding.embed(texts, "id", model))
    tables = {"chunks": chunks, "vectors": store.write_index(rows)}
    if with_cells:
        lists, model = cells.build_cells(tables["vectors"])
        tables["lists"] = store.write_cells(lists, cells.model_rows(spark, model))
    if with_graph:
        found = cut_lineage(graph.extract_entities(chunks.select("id", "text")))
        if store.write_graph(graph.graph_vertices(found), graph.graph_edges(found)):
            tables["vertices"], tables["edges"] = store.read_graph()
            store.write_keywords(*keywords.build_keywords(tables["vertices"]))
    return stats.table_counts(tables)


def refresh_index(spark: SparkSession, folder: str, store: Store, *, size: int = 1200, overlap: int = 200) -> DataFrame:
    """Bring the chunk table, the vectors and, if there is one, the index of cells up to the
    files below ``folder``; ``size`` and ``overlap`` as the index was built with. Returns
    ``action, n`` of the vectors. Chunks that did not change keep their vectors, the embedder
    is the one the index was built with, and graph tables stay as they are."""
    chunks = store.write_chunks(_chunks(spark, folder, size, overlap))
    model = PipelineModel.load(store.path(EMBEDDER))
    counts = store.refresh_index(chunks, lambda texts: embedding.embed(texts, "id", model))
    if store.exists("vector_lists") and not counts.isEmpty():
        lists, trained = cells.build_cells(store.read("vectors"))
        store.write_cells(lists, cells.model_rows(spark, trained))
    return counts


def _chunks(spark: SparkSession, folder: str, size: int, overlap: int) -> DataFrame:
    files = plain_texts(corpus_scan(spark, folder))
    docs = files.select(F.md5("source").alias("doc_id"), "text", "source")
    return chunking.chunk_recursive(docs, size, overlap).select(chunking.chunk_key().alias("id"), "text", "source")


def retrieve(store: Store, questions: DataFrame, k: int = 4, *, method: str = "exact") -> DataFrame:
    """``query_id, rank, id, distance, text, source`` for ``query_id, query``. ``method`` is
    "exact" or "cells", the approximate search over the store's index of cells."""
    asked = context.valid_questions(questions).select("query_id", F.col("query").alias("text"))
    asked = embedding.embed(asked, "query_id", PipelineModel.load(store.path(EMBEDDER)))
    vectors = store.read("vectors")
    if method == "cells":
        found = cells.search_cells(asked, vectors, store.read("vector_lists"), cells.read_model(store.read("vector_model")), k)
    elif method == "exact":
        found = knn.knn(asked, vectors, k)
    else:
        raise ValueError(f"no method {method}: exact or cells")
    return context.attach_text(found, store.read("rag_documents"), "source")


def ask(store: Store, questions: DataFrame, k: int = 4, *, method: str = "exact") -> DataFrame:
    """``query_id, messages`` from the nearest chunks."""
    found = retrieve(store, questions, k, method=method)
    return context.prompts(context.valid_questions(questions), context.format_context(found))


def ask_graph(store: Store, questions: DataFrame, k: int = 5) -> DataFrame:
    """``query_id, messages`` from the graph, with the vertices that the store's keyword index
    finds, if it has one; without graph tables the context is empty. A context of several pages makes as many prompts."""
    asked, tables = context.valid_questions(questions), store.read_graph()
    if tables is None:
        return context.graph_prompts(asked, asked.select("query_id", F.lit("").alias("context")))
    index = store.read_keywords()
    seeds = cut_lineage(keywords.search_keywords(asked, *index, k)) if index else None
    return context.graph_prompts(asked, graph.graph_context(asked, *tables, k, seeds=seeds))


def evaluate_batch(store: Store, cases: DataFrame, batch: str, docs: DataFrame | None = None) -> DataFrame:
    """Evaluate ``cases`` once and store what comes out under the name ``batch``: a row a case in
    ``case_results``, their moments in ``case_moments``. A batch that is evaluated again takes the
    place of its first try. Returns the moments of all batches, for the reports of
    ``operators.moments``, which read nothing else."""
    results = cut_lineage(metrics.evaluate(cases, docs))
    store.replace_batch("case_results", results, batch)
    return store.replace_batch("case_moments", cut_lineage(moments.moments(results)), batch)
