"""Splitting texts into overlapping chunks."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.session import apart, cut_lineage

# Separators, from the strongest to the weakest. Where none applies the
# text is cut between characters.
SEPARATORS = ["\n\n", "\n", " "]

CHUNKS = "array<struct<chunk_no:int,start_index:int,text:string>>"


def _cuts(text: str, separator: str) -> list[int]:
    """Offsets at which pieces begin and end, a separator opening its piece."""
    cuts, at = [0], text.find(separator)
    while at >= 0:
        if at > 0:
            cuts.append(at)
        at = text.find(separator, at + len(separator))
    cuts.append(len(text))
    return cuts


def _merge(cuts: list[int], size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Spans of consecutive pieces: each as long as ``size`` allows, starting within
    ``overlap`` of the end of the one before if the next piece still fits."""
    first, last = 0, len(cuts) - 1
    while first < last:
        end = bisect_right(cuts, cuts[first] + size) - 1
        yield cuts[first], cuts[end]
        if end == last:
            return
        first = min(bisect_left(cuts, max(cuts[end] - overlap, cuts[end + 1] - size)), end)


def _spans(text: str, base: int, level: int, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    while level < len(SEPARATORS) and SEPARATORS[level] not in text:
        level += 1
    if level == len(SEPARATORS):
        step, n = size - overlap, len(text)
        for start in chain([0], range(step, max(n - overlap, 0), step)):
            yield base + start, base + min(start + size, n)
        return
    cuts = _cuts(text, SEPARATORS[level])
    run = [cuts[0]]
    for start, end in zip(cuts, cuts[1:]):
        if end - start < size:
            run.append(end)
            continue
        yield from ((base + a, base + b) for a, b in _merge(run, size, overlap))
        yield from _spans(text[start:end], base + start, level + 1, size, overlap)
        run = [end]
    yield from ((base + a, base + b) for a, b in _merge(run, size, overlap))


def split_text(text: str | None, size: int, overlap: int) -> list[tuple[int, int, str]]:
    """Chunks of one text as (number, start, chunk). The start is where the chunk is
    found when searching from the overlap with the chunk before."""
    chunks, found, length = [], 0, 0
    for a, b in _spans(text, 0, 0, size, overlap) if text else ():
        chunk = text[a:b].strip()
        if chunk:
            found = text.find(chunk, max(0, found + length - overlap))
            length = len(chunk)
            chunks.append((len(chunks), found, chunk))
    return chunks


def chunk_recursive(docs: DataFrame, size: int = 1200, overlap: int = 200) -> DataFrame:
    """``doc_id, chunk_no, start_index, text, source``: pieces cut at the strongest
    separator that keeps them within ``size``. A narrow map over the corpus."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than size")

    @F.pandas_udf(CHUNKS)
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(
            lambda t: [{"chunk_no": n, "start_index": s, "text": c} for n, s, c in split_text(t, size, overlap)]
        )

    return docs.select("doc_id", "source", F.inline(split("text"))).select(
        "doc_id", "chunk_no", "start_index", "text", "source"
    )


def chunk_fixed(docs: DataFrame, size: int = 1200, overlap: int = 200) -> DataFrame:
    """Character windows: what recursive splitting comes to without separators."""
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length("text") - overlap) / step) - 1).cast("int")
    # The text is cut into steps once and windows are put together from those, since
    # looking for the n-th character starts at the first one each time.
    steps = docs.filter(F.length("text") > 0).withColumn(
        "_steps", F.regexp_extract_all("text", F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    )
    spans = -(-size // step)
    window = F.transform(
        F.sequence(F.lit(0), last),
        lambda n: F.struct(
            n.alias("chunk_no"),
            (n * step).alias("start_index"),
            F.left(F.array_join(F.slice("_steps", n + 1, F.lit(spans)), ""), F.lit(size)).alias("text"),
        ),
    )
    # inline() would have the optimizer test the array before, and so cut twice.
    return steps.select("doc_id", "source", F.inline_outer(window)).select(
        "doc_id", "chunk_no", "start_index", "text", "source"
    )


def chunk_key() -> Column:
    """A chunk's key: document and number within it."""
    return F.concat_ws("-", "doc_id", "chunk_no")


def dense_ids(chunks: DataFrame) -> DataFrame:
    """``id`` 0, 1, 2, … in order of document and chunk; documents of any type that sorts, a null
    one first.

    Chunks of a document count from 0, so a running sum over one row per document gives
    each document's first id. That sum is taken in two levels: within ranges of
    documents, and over one total per range.
    """
    sizes = chunks.groupBy("doc_id").agg(F.count("*").alias("__n"))
    starts = apart(_offsets(sizes, "doc_id", "__n").toDF("__doc", "__offset"))
    return chunks.join(starts, F.col("doc_id").eqNullSafe(F.col("__doc"))).withColumn(
        "id", (F.col("__offset") + F.col("chunk_no")).cast("long")
    ).drop("__offset", "__doc")


def _offsets(sizes: DataFrame, key: str, n: str) -> DataFrame:
    """``key, offset``: the sum of ``n`` over all smaller keys.

    One shuffle sorts the keys into ranges, as many as the session has shuffle partitions. They
    are written with their number, since Spark samples the ends of ranges and would not take the
    same ones twice. The window over ranges has a row for each, the others a range each, and
    running sums hold no rows.
    """
    rows = cut_lineage(sizes.repartitionByRange(key).withColumn("__range", F.spark_partition_id()))
    totals = rows.groupBy("__range").agg(F.sum(n).alias("__total"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("__range", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("__range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(starts, "__range").select(
        key, (F.col("__start") + F.coalesce(F.sum(n).over(inside), F.lit(0))).alias("offset")
    )
