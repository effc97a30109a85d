"""A stored keyword index of vertices: which ids contain a run of up to three characters.

Vertices are numbered in the order of their ids. A run's postings are the numbers of the
vertices that have it, cut into blocks of ``BLOCK`` numbers; a block holds its numbers as
sorted offsets, which Parquet's delta encoding packs. A word can only occur in vertices that
have its rarest run, so a question reads that run's blocks, the first ones first, and stops
for a word as soon as k vertices contain it. Vertices are looked up by number, in the shards
that have candidates; neither they nor the postings are ever read as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions.text import keywords
from lorekeep.operators.graph import first_vertices, with_grams
from lorekeep.session import apart, cut_lineage

# Numbers of a block of postings, and of a shard of the vertices.
BLOCK, SHARD = 1 << 12, 1 << 18
BUCKETS = 64
# How much further a list is read in each round than in the one before.
GROWTH = 16


def _bucket(gram: str) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int").alias("bucket")


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``pos``, 0 and on without gaps in the order of the columns ``order``, whose
    values should tell rows apart. One shuffle into sorted ranges; a row's number is its place
    in its range plus the rows of the ranges before, so no task sees more than a range."""
    ranged = cut_lineage(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))  # a row a range
    before = (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before")
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    placed = ranged.withColumn("_place", place).join(apart(sizes.select("_range", before)), "_range")
    return placed.select(*rows.columns, (F.col("_before") + F.col("_place")).alias("pos"))


def build_keywords(vertices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The index of a table with ``id``: vertices ``pos, id, low, shard`` and postings ``gram,
    block, before, total, last, offsets, bucket``; ``before`` and ``total`` count a run's vertices
    in earlier blocks and in all, ``last`` is ``before`` of its last block. Null ids are no
    vertices, equal ones are one."""
    ids = vertices.select("id").filter("id is not null").distinct()
    rows = numbered(ids, "id").select("pos", "id", F.lower("id").alias("low"), F.expr(f"cast(pos div {SHARD} as int)").alias("shard"))
    rows = cut_lineage(rows)
    runs = with_grams(rows.select("pos", "low"), "low")
    blocks = runs.groupBy("gram", F.expr(f"pos div {BLOCK}").alias("block")).agg(
        F.array_sort(F.collect_list(F.expr(f"cast(pos % {BLOCK} as int)"))).alias("offsets")
    )
    run = Window.partitionBy("gram")
    size = F.size("offsets").cast("long")
    placed = blocks.withColumn("before", F.sum(size).over(run.orderBy("block")) - size)
    totals = F.sum(size).over(run).alias("total"), F.max("before").over(run).alias("last")
    return rows, placed.select("gram", "block", "before", *totals, "offsets", _bucket("gram"))


def _within(rows: DataFrame, column: str, of: DataFrame) -> DataFrame:
    """``rows`` in the directories that ``of`` needs; there are few of them, whatever the rows."""
    return rows.filter(F.col(column).isin([r[0] for r in of.select(column).distinct().collect()]))


def rarest_runs(words: DataFrame, postings: DataFrame) -> DataFrame:
    """``word, gram, last, bucket`` for the distinct ``word``s of a table: of a word's longest
    runs the one that the fewest vertices have. Words with a run that none has are left out."""
    runs = with_grams(words.select("word").distinct(), "word").filter(F.length("gram") == F.least(F.lit(3), F.length("word")))
    runs = runs.withColumn("bucket", _bucket("gram"))
    heads = postings.filter("before = 0").select("gram", "bucket", "total", "last")
    rarity = F.min(F.struct(F.coalesce("total", F.lit(0)).alias("total"), "gram", "last")).alias("r")
    rarest = runs.join(heads, ["gram", "bucket"], "left").groupBy("word").agg(rarity).filter("r.total > 0")
    return rarest.select("word", "r.gram", "r.last").withColumn("bucket", _bucket("gram"))


def _first_hits(words: DataFrame, vertices: DataFrame, postings: DataFrame, read: int, until: int, k: int) -> DataFrame:
    """``word, id``: the first k vertices that contain a word among those of its run's blocks
    that have at least ``read`` and less than ``until`` numbers before them."""
    blocks = postings.filter((F.col("before") >= read) & (F.col("before") < until))
    # A word of one run occurs wherever the run does.
    offsets = F.when(F.length("word") <= 3, F.slice("offsets", 1, k)).otherwise(F.col("offsets"))
    at = blocks.select("gram", "block", "offsets").join(words.select("word", "gram"), "gram")
    at = at.select("word", F.col("block"), F.explode(offsets).alias("_offset"))
    pos = F.col("block") * BLOCK + F.col("_offset")
    near = cut_lineage(at.select("word", pos.alias("pos"), F.expr(f"cast((block * {BLOCK} + _offset) div {SHARD} as int)").alias("shard")))
    hits = near.drop("shard").join(_within(vertices, "shard", near).select("pos", "id", "low"), "pos")
    first = Window.partitionBy("word").orderBy("pos")
    hits = hits.filter(F.contains("low", "word")).withColumn("_place", F.row_number().over(first))
    return cut_lineage(hits.filter(F.col("_place") <= k).select("word", "id"))


def search_keywords(questions: DataFrame, vertices: DataFrame, postings: DataFrame, k: int = 5) -> DataFrame:
    """``query_id, id, place`` as :func:`lorekeep.operators.graph.match_vertices` gives them, from
    the two tables of an index. Lists are read in rounds, ``BLOCK`` numbers in the first, each
    ``GROWTH`` times as far as the one before; a word leaves when it has k vertices or its list ends."""
    asked = questions.select("query_id", F.explode(F.array_distinct(keywords("query"))).alias("word"))
    left = cut_lineage(rarest_runs(asked, postings))
    found = left.select("word", F.col("word").alias("id")).limit(0)
    postings, read, until = _within(postings, "bucket", left), 0, BLOCK
    while not left.isEmpty():
        found = found.unionByName(_first_hits(left, vertices, postings, read, until, k))
        full = found.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= k)
        read, until = until, until * GROWTH
        left = cut_lineage(left.filter(F.col("last") >= read).join(apart(full), "word", "left_anti"))
    return first_vertices(asked, found, k)
