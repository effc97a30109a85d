"""An entity graph from texts, and context for questions from the graph."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorekeep.functions.text import keywords
from lorekeep.session import apart, cut_lineage

# A capitalised word that does not begin inside another word.
CAPITALISED = r"(?<![\p{L}\p{N}_])(\p{Lu}[\p{L}\p{N}_]*)"
RELATIONSHIP = "co_occurs_with"
# Texts of the graph context.
HEADING = "Found the following relationships in the knowledge graph:\n"
NO_EDGES = "No direct relationships found for the query entities."

EXTRACTION = T.StructType(
    [
        T.StructField("entities", T.ArrayType(T.StringType())),
        # Read as text first: one entry that is no list must not spoil the others.
        T.StructField("relationships", T.ArrayType(T.StringType())),
        T.StructField("_corrupt", T.StringType()),
    ]
)


def parse_extractions(raw: DataFrame) -> DataFrame:
    """``entities`` and ``relationships`` from JSON in ``body``; malformed JSON and
    missing keys give empty lists. Other columns pass through."""
    parsed = F.from_json("body", EXTRACTION, {"columnNameOfCorruptRecord": "_corrupt"})
    rows = raw.withColumn("_r", parsed)
    sound = F.col("_r._corrupt").isNull()
    lists = F.filter(
        F.transform("_r.relationships", lambda r: F.from_json(r, "array<string>")), lambda r: r.isNotNull()
    )
    return rows.select(
        *[c for c in raw.columns if c != "body"],
        F.coalesce(F.when(sound, F.col("_r.entities")), F.array().cast("array<string>")).alias("entities"),
        F.coalesce(F.when(sound, lists), F.array().cast("array<array<string>>")).alias("relationships"),
    )


def _phrases(line: Column) -> Column:
    """Runs of capitalised words with one blank between them. The words are put between
    marks, and marks with a blank between them go: a pattern for whole runs would recurse
    with their length."""
    marked = F.regexp_replace(F.translate(line, "\x01\x02", "\x03\x03"), CAPITALISED, "\x01$1\x02")
    return F.regexp_extract_all(F.replace(marked, F.lit("\x02 \x01"), F.lit(" ")), F.lit("\x01([^\x02]*)\x02"), F.lit(1))


def extract_entities(chunks: DataFrame) -> DataFrame:
    """Entities and neighbour relationships per chunk: capitalised phrases of any length,
    related to the next one on the same line. Other columns than ``text`` pass through."""
    lines = F.transform(F.split("text", "\n"), _phrases)
    per_line = chunks.withColumn("_lines", lines)

    def neighbours(names: Column) -> Column:
        pairs = F.zip_with(
            F.slice(names, 1, F.greatest(F.size(names) - 1, F.lit(0))),
            F.slice(names, 2, F.greatest(F.size(names) - 1, F.lit(0))),
            lambda a, b: F.array(a, F.lit(RELATIONSHIP), b),
        )
        return pairs

    return per_line.select(
        *[c for c in chunks.columns if c != "text"],
        F.flatten("_lines").alias("entities"),
        F.flatten(F.transform("_lines", neighbours)).alias("relationships"),
    )


def extract_with(chunks: DataFrame, function: Callable[[pd.Series], pd.Series], key: str = "doc_id") -> DataFrame:
    """Entities and relationships by a user's own model: ``function`` maps a batch of
    texts to the JSON :func:`parse_extractions` reads."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({key: part[key], "body": function(part["text"])})

    key_type = chunks.schema[key].dataType.simpleString()
    return parse_extractions(chunks.select(key, "text").mapInPandas(run, f"`{key}` {key_type}, body string"))


def valid_triples(extractions: DataFrame, *carry: str) -> DataFrame:
    """``src, relationship, dst`` of the relationships that have exactly three parts."""
    whole = F.filter("relationships", lambda r: F.size(r) == 3)
    return extractions.select(*carry, F.explode(whole).alias("r")).select(
        *carry, F.col("r")[0].alias("src"), F.col("r")[1].alias("relationship"), F.col("r")[2].alias("dst")
    )


def graph_vertices(extractions: DataFrame) -> DataFrame:
    """Distinct entities. Duplicates are removed before the shuffle, so an entity of
    every document costs one row per task."""
    # explode() would have the optimizer test the array before, and so extract twice.
    return extractions.select(F.explode_outer("entities").alias("id")).filter("id is not null").distinct()


def graph_edges(extractions: DataFrame) -> DataFrame:
    """All valid triples; repeated ones are kept."""
    return valid_triples(extractions)


def counted_edges(edges: DataFrame) -> DataFrame:
    """Distinct triples with their number ``n``. A third of all edges may be copies of
    one: counting before any join makes them one row."""
    return edges.groupBy("src", "relationship", "dst").agg(F.count("*").alias("n"))


def connected(counted: DataFrame, vertices: DataFrame) -> DataFrame:
    """Counted edges whose two ends are both vertices. Vertex ids are distinct, so the
    joins only filter; a hot end is a skewed key on the edge side."""
    ids = apart(vertices.select("id"))
    return counted.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(
        ids.withColumnRenamed("id", "dst"), "dst", "left_semi"
    )


def one_hop(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """``src, relationship, dst, n`` for the edges between two listed vertices, with how
    often each occurs."""
    return connected(counted_edges(edges), vertices).select("src", "relationship", "dst", "n")


def seed_edges(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Edges that leave one of the ``seeds`` (a table with an ``id``), with how often
    each occurs."""
    ids = apart(seeds.select(F.col("id").alias("src")).distinct())
    return counted_edges(edges).join(ids, "src", "left_semi").select("src", "relationship", "dst", "n")


def with_grams(rows: DataFrame, text: str) -> DataFrame:
    """A row, with ``gram``, for each distinct run of one to three characters of a text.
    Positions and sizes are rows and not lambdas, which keeps the work in generated code;
    of equal runs the first one stays."""
    at = rows.filter(F.length(text) > 0).withColumn("_at", F.explode(F.sequence(F.lit(1), F.length(text))))
    runs = F.array(*[F.substring(text, F.col("_at"), F.lit(size)) for size in (1, 2, 3)])
    sized = at.select("*", F.posexplode(runs).alias("_size", "gram"))
    first = (F.length("gram") == F.col("_size") + 1) & (F.instr(text, F.col("gram")) == F.col("_at"))
    return sized.filter(first).drop("_at", "_size")


def match_vertices(questions: DataFrame, vertices: DataFrame, k: int = 5) -> DataFrame:
    """``query_id, id, place``: up to k vertices, by id, that contain a word of the
    question, ignoring case. A blank question matches none.

    "Contains" becomes an equi-join: a word can only occur in ids that have the word's
    rarest run of up to three characters. For one word no more than its first k ids can
    be among a question's first k, so each is cut to k before it meets the questions.
    """
    asked = questions.select("query_id", F.explode(F.array_distinct(keywords("query"))).alias("word"))
    grams = with_grams(vertices.select("id", F.lower("id").alias("low")), "low")
    frequency = grams.groupBy("gram").agg(F.count("*").alias("n"))
    own = (
        with_grams(asked.select("word").distinct(), "word")
        .filter(F.length("gram") == F.least(F.lit(3), F.length("word")))
        .join(apart(frequency), "gram", "left")
        .groupBy("word")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))["gram"].alias("gram"))
    )
    hits = grams.join(own, "gram").filter(F.contains("low", "word")).select("word", "id")
    first = Window.partitionBy("word").orderBy("id")
    few = hits.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= k).drop("place")
    return first_vertices(asked, few, k)


def first_vertices(asked: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """``query_id, id, place``: a question's first k of the ``id``s found for its ``word``s."""
    order = Window.partitionBy("query_id").orderBy("id")
    return (
        asked.join(apart(found), "word")
        .select("query_id", "id")
        .distinct()
        .withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= k)
    )


def graph_context(
    questions: DataFrame,
    vertices: DataFrame,
    edges: DataFrame,
    k: int = 5,
    *,
    direction: str = "out",
    page_lines: int = 50_000,
    seeds: DataFrame | None = None,
) -> DataFrame:
    """``query_id, page, context``: the relationships that leave a question's vertices,
    or, with ``direction="both"``, those that leave or enter them, under each vertex.

    Lines are ordered by vertex, source, relationship and target, and numbered through a
    question; page p holds lines p * ``page_lines`` and on, the heading stands on the first
    page only, so the pages in order, put together, are the whole context. Questions of
    one page take the lines of a vertex from a block that is made once for all of them; the
    lines of longer ones are numbered by sorted ranges, so no task holds all lines of a hot
    vertex. Questions without vertices have no row; those whose vertices have no edges
    get a fixed text. ``seeds`` are the questions' vertices where they are known already, as
    from a keyword index.
    """
    seeds = match_vertices(questions, vertices, k) if seeds is None else seeds
    ids, counted = apart(seeds.select("id").distinct()), counted_edges(edges)

    def at(end: str) -> DataFrame:
        near = counted.join(ids.withColumnRenamed("id", end), end, "left_semi")
        return connected(near, vertices).select(F.col(end).alias("id"), "src", "relationship", "dst", "n")

    touching = at("src")
    if direction == "both":
        touching = touching.unionByName(at("dst").filter("src <> dst"))
    touching = cut_lineage(touching)
    # A question has at most k vertices.
    mine = Window.partitionBy("query_id")
    before = F.sum("lines").over(mine.orderBy("id")) - F.col("lines")
    sizes = touching.groupBy("id").agg(F.sum("n").alias("lines"))
    asked = seeds.select("query_id", "id").join(apart(sizes), "id", "left").withColumn("lines", F.coalesce("lines", F.lit(0)))
    asked = cut_lineage(asked.select("query_id", "id", before.alias("first"), F.sum("lines").over(mine).alias("all")))

    line = F.concat(F.lit("- "), "src", F.lit(" "), "relationship", F.lit(" "), "dst", F.lit("\n"))
    short = asked.filter((F.col("all") > 0) & (F.col("all") <= page_lines))
    entry = F.struct("src", "relationship", "dst", F.repeat(line, F.col("n").cast("int")).alias("lines"))
    blocks = (
        touching.join(apart(short.select("id").distinct()), "id")
        .groupBy("id")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["lines"]), "").alias("lines"))
    )
    parts = short.join(blocks, "id").select("query_id", F.lit(0).cast("long").alias("page"), F.struct("id", "lines").alias("part"))
    whole = _pages(parts)
    long = asked.filter(F.col("all") > page_lines)
    if not long.isEmpty():
        whole = whole.unionByName(_pages(_long_parts(touching, long, line, page_lines)))
    bare = asked.filter("all = 0").select("query_id").distinct()
    return whole.unionByName(bare.select("query_id", F.lit(0).cast("long").alias("page"), F.lit(NO_EDGES).alias("context")))


def _pages(parts: DataFrame) -> DataFrame:
    """``query_id, page, context`` from the ``part``s of pages, which sort in their order."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["lines"]), "")
    pages = parts.groupBy("query_id", "page").agg(joined.alias("text"))
    text = F.when(F.col("page") == 0, F.concat(F.lit(HEADING), "text")).otherwise(F.col("text"))
    # Only the last line of all has no line break after it; pages meet where a line ends.
    last = F.col("page") == F.max("page").over(Window.partitionBy("query_id"))
    return pages.select("query_id", "page", F.when(last, F.rtrim(text, F.lit("\n"))).otherwise(text).alias("context"))


def _long_parts(touching: DataFrame, asked: DataFrame, line: Column, page_lines: int) -> DataFrame:
    """Parts of the pages of questions with more than one. Lines of a vertex are numbered
    within sorted ranges; what stands before a range comes from the sums of the ranges."""
    order = ["src", "relationship", "dst"]
    near = touching.join(apart(asked.select("id").distinct()), "id", "left_semi")
    ranged = cut_lineage(near.repartitionByRange("id", *order).withColumn("range", F.spark_partition_id()))
    sums = ranged.groupBy("id", "range").agg(F.sum("n").alias("lines"))
    earlier = F.sum("lines").over(Window.partitionBy("id").orderBy("range")) - F.col("lines")
    within = F.sum("n").over(Window.partitionBy("id", "range").orderBy(*order)) - F.col("n")
    numbered = ranged.withColumn("within", within).join(apart(sums.select("id", "range", earlier.alias("earlier"))), ["id", "range"])
    rows = asked.join(numbered, "id").withColumn("from", F.col("first") + F.col("earlier") + F.col("within"))
    rows = rows.withColumn("to", F.col("from") + F.col("n") - 1)
    page = F.explode(F.sequence(F.expr(f"`from` div {page_lines}"), F.expr(f"`to` div {page_lines}")))
    rows = rows.withColumn("page", page)
    copies = F.least("to", (F.col("page") + 1) * page_lines - 1) - F.greatest("from", F.col("page") * page_lines) + 1
    part = F.struct("id", *order, F.repeat(line, copies.cast("int")).alias("lines"))
    return rows.select("query_id", "page", part.alias("part"))
