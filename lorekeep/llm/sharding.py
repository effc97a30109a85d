"""Shards of equal size that keep linked documents together (operator 8, native).

Documents with equal texts are one node; nodes are linked by the lines they share, through the
line and not in pairs. Balanced label propagation: shards start as even runs of nodes ordered
by a shared line; then, ``ROUNDS`` times, a line takes the shard most of its nodes are in, a
node wants the shard its lines favour (rare lines count more), and as many nodes move between
two shards as want to go the other way, plus a share of the room that is left. At last rows are
ranked by shard and cut into ``shards`` runs whose row counts differ by one at most (the law
``rows``). DataFrame operations only.

Everything is counted before it is joined: a hot line or text is one row on one side of each
join. Ranks come from counts of ``CELLS`` x ``SPLITS`` cells a shard, so no window holds a hot
text, whose rows are spread over the cells at random.

Defined cases: a null text is a node of its own without lines, its size 8 and its checksum 0;
repeated rows are rows; with fewer rows than shards, the first shards get one each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.session import apart, cut_lineage

LAW = "rows"
ROUNDS = 3
# A line this long links the texts that hold it; shorter ones say little.
LINE_CHARS = 24
CELLS, SPLITS = 32, 32
# How far a shard may grow while labels move; the last cut evens it out.
SLACK = 0.05


def _node():
    return F.xxhash64(F.col("text").isNull(), F.coalesce("text", F.lit("")))


def shared_lines(docs: DataFrame) -> DataFrame:
    """``node, line, weight``: the lines a text shares with other texts."""
    lines = docs.select(_node().alias("node"), F.explode(F.split("text", "\n")).alias("words"))
    lines = lines.filter(F.length("words") >= LINE_CHARS).select("node", F.xxhash64("words").alias("line")).distinct()
    lines = cut_lineage(lines)
    known = lines.groupBy("line").agg(F.count("*").alias("members")).filter("members > 1")
    return cut_lineage(lines.join(apart(known), "line").select("node", "line", (1 / F.col("members")).alias("weight")))


def _even_runs(nodes: DataFrame, edges: DataFrame, shards: int) -> DataFrame:
    """First labels: nodes in the order of the least line they share, cut into even runs.
    The order is by cells of hash values, counted in a table of bounded size."""
    cells = shards * CELLS
    first = edges.groupBy("node").agg(F.min("line").alias("line"))
    placed = nodes.join(first, "node", "left").withColumn("home", F.coalesce("line", "node"))
    placed = placed.withColumn("cell", F.pmod(F.xxhash64("home"), F.lit(cells)).cast("int"))
    counts = placed.groupBy("cell").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    upto = F.sum("n").over(Window.orderBy("cell")) - F.col("n")
    labels = counts.select("cell", F.least(F.floor(upto * shards / total), F.lit(shards - 1)).cast("int").alias("label"))
    return placed.join(F.broadcast(labels), "cell").select("node", "n", "home", "label")


def _moved(labels: DataFrame, edges: DataFrame, shards: int, rows: int, turn: int) -> DataFrame:
    """One round: where lines pull their nodes, within quotas."""
    held = edges.join(labels.select("node", "label"), "node")
    votes = held.groupBy("line", "label").agg(F.count("*").alias("votes"))
    pull = votes.groupBy("line").agg(F.max_by("label", F.col("votes") * 1000 - F.col("label")).alias("wanted"))
    wishes = edges.join(apart(pull), "line").groupBy("node", "wanted").agg(F.sum("weight").alias("weight"))
    wish = wishes.groupBy("node").agg(F.max_by("wanted", "weight").alias("wanted"))
    asked = cut_lineage(labels.join(wish, "node", "left").withColumn("wanted", F.coalesce("wanted", "label")))
    sizes = asked.groupBy("label").agg(F.sum("n").alias("size"))
    flows = asked.filter("wanted <> label").groupBy("label", "wanted").agg(F.sum("n").alias("flow"))
    back = flows.select(F.col("label").alias("wanted"), F.col("wanted").alias("label"), F.col("flow").alias("back"))
    room = sizes.select(
        F.col("label").alias("wanted"), F.greatest(F.lit(0), F.lit((1 + SLACK) * rows / shards) - F.col("size")).alias("room")
    )
    # At most shards * shards rows.
    quota = flows.join(back, ["label", "wanted"], "left").join(room, "wanted", "left").select(
        "label",
        "wanted",
        ((F.least("flow", F.coalesce("back", F.lit(0))) + F.coalesce("room", F.lit(rows / shards)) / shards) / F.col("flow")).alias("share"),
    )
    luck = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(1 << 20)) / (1 << 20)
    granted = asked.join(F.broadcast(quota), ["label", "wanted"], "left")
    label = F.when(luck < F.coalesce("share", F.lit(0.0)), F.col("wanted")).otherwise(F.col("label"))
    return cut_lineage(granted.select("node", "n", "home", label.alias("label")))


def balanced_shards(docs: DataFrame, shards: int = 24, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` and ``label``, the shard
    that propagation chose before the last cut."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        _node().alias("node"),
        F.floor(F.rand(11) * SPLITS).cast("int").alias("split"),
    )
    rows = cut_lineage(rows)
    n = rows.count()
    edges = shared_lines(docs)
    nodes = rows.groupBy("node").agg(F.count("*").alias("n"))
    labels = cut_lineage(_even_runs(nodes, edges, shards))
    for turn in range(rounds):
        labels = _moved(labels, edges, shards, n, turn)

    cell = F.pmod(F.xxhash64("home"), F.lit(CELLS)).cast("int")
    placed = rows.join(apart(labels.select("node", "home", "label")), "node").withColumn("cell", cell)
    placed = cut_lineage(placed.drop("home"))
    # At most shards * CELLS * SPLITS rows, in a window of CELLS * SPLITS for each shard.
    counts = placed.groupBy("label", "cell", "split").agg(F.count("*").alias("k"))
    within = F.sum("k").over(Window.partitionBy("label").orderBy("cell", "split")) - F.col("k")
    by_label = counts.groupBy("label").agg(F.sum("k").alias("all"))
    before = by_label.select("label", (F.sum("all").over(Window.orderBy("label")) - F.col("all")).alias("before"))
    offsets = counts.select("label", "cell", "split", within.alias("within")).join(F.broadcast(before), "label")
    offsets = offsets.select("label", "cell", "split", (F.col("within") + F.col("before")).alias("offset"))
    order = Window.partitionBy("label", "cell", "split").orderBy("node", "doc_id")
    ranked = placed.withColumn("place", F.row_number().over(order) - 1)
    ranked = ranked.join(F.broadcast(offsets), ["label", "cell", "split"]).withColumn("rank", F.col("place") + F.col("offset"))

    few, more = divmod(n, shards)
    if few:
        after = F.col("rank") - more * (few + 1)
        shard = F.when(after < 0, F.expr(f"rank div {few + 1}")).otherwise(more + F.floor(after / few))
        slot = F.when(after < 0, F.col("rank") % (few + 1)).otherwise(after % few)
    else:
        shard, slot = F.col("rank"), F.lit(0)
    return ranked.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit(LAW).alias("law"),
        shard.cast("int").alias("shard"),
        slot.cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "label",
    )


def cut_edges(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """``kept, links``: of the links between a document and a shared line, those to the
    shard where most of the line's documents are, and all."""
    nodes = docs.select("doc_id", _node().alias("node")).join(placed.select("doc_id", "shard"), "doc_id")
    held = shared_lines(docs).join(nodes, "node").groupBy("line", "shard").agg(F.count("*").alias("n"))
    return held.groupBy("line").agg(F.max("n").alias("most"), F.sum("n").alias("n")).agg(
        F.sum("most").alias("kept"), F.sum("n").alias("links")
    )
