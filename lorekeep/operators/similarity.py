"""TF-IDF cosine of text pairs, fitted afresh on each pair.

With two documents the inverse document frequency takes two values only: 1 for a term
both texts use and 1 + ln(3/2) for a term of one text. The cosine of a pair then follows
from sums over its terms, and no vectors are built.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions.text import clean_text
from lorekeep.functions.vocabulary import english_stop_words

# Fixed value: smoothed idf² of a term that one of the two texts uses.
OWN_WEIGHT = (1.0 + math.log(1.5)) ** 2
# Characters of text whose terms one task counts. Counts and their sort take some forty times
# the texts, and adaptive execution, which sees the texts only, would give a task 64 MB of them.
TASK_CHARS = 8 << 20


def _tasks(pairs: DataFrame, left: str, right: str) -> int:
    """How many tasks count the terms: one for each core, more where the texts are many."""
    size = lambda c: F.coalesce(F.length(c), F.lit(0)).cast("long")
    chars = pairs.agg(F.sum(size(left) + size(right))).first()[0] or 0
    return max(pairs.sparkSession.sparkContext.defaultParallelism, -(-chars // TASK_CHARS))


def pair_similarity(
    pairs: DataFrame,
    keys: Sequence[str],
    left: str,
    right: str,
    *,
    stop_words: Sequence[str] | None = None,
    max_features: int = 1000,
) -> DataFrame:
    """``keys`` + ``similarity``, one row for each row of ``pairs``.

    The texts are shuffled once, by the pair's key. Counting terms, capping the
    vocabulary and summing up all group by that key or more, so none of them moves data
    again, and no group holds more than the two texts of one row. The texts are measured
    before, so that there are as many tasks as they need, however many there are.
    """
    stop = english_stop_words() if stop_words is None else stop_words
    keys = list(keys)
    sides = pairs.repartition(_tasks(pairs, left, right), *keys).select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.lit(1).alias("l"), F.lit(0).alias("r"), F.col(left).alias("text")),
                F.struct(F.lit(0).alias("l"), F.lit(1).alias("r"), F.col(right).alias("text")),
            )
        ).alias("side"),
    )
    tokens = sides.select(
        *keys, "side.l", "side.r", F.explode(F.split(clean_text("side.text"), " ")).alias("token")
    )
    # A token that is no term becomes null and not a dropped row: it keeps pairs
    # without any term in the result.
    is_term = (F.length("token") >= 2) & ~F.col("token").isin(list(stop))
    counts = (
        tokens.select(*keys, "l", "r", F.when(is_term, F.col("token")).alias("term"))
        .groupBy(*keys, "term")
        .agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    )
    order = Window.partitionBy(*keys).orderBy(
        F.col("term").isNull(), (F.col("l") + F.col("r")).desc(), "term"
    )
    kept = counts.withColumn("place", F.row_number().over(order)).filter(
        (F.col("place") <= max_features)
    )
    l, r, known = F.col("l"), F.col("r"), F.col("term").isNotNull()
    shared = known & (l > 0) & (r > 0)
    total = lambda cond, value: F.sum(F.when(cond, value).otherwise(0))
    sums = kept.groupBy(*keys).agg(
        total(shared, l * r).alias("dot"),
        total(shared, l * l).alias("l_shared"),
        total(shared, r * r).alias("r_shared"),
        total(known & ~shared, l * l).alias("l_own"),
        total(known & ~shared, r * r).alias("r_own"),
    )
    norms = (F.col("l_shared") + OWN_WEIGHT * F.col("l_own")) * (F.col("r_shared") + OWN_WEIGHT * F.col("r_own"))
    return sums.select(
        *keys, F.when(F.col("dot") > 0, F.col("dot") / F.sqrt(norms)).otherwise(0.0).alias("similarity")
    )
