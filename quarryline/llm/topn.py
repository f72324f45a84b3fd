"""The N best rows of every group, by a mergeable bounded heap.

The aggregate keeps at most N rows of a group in each map task, built before the shuffle, and merges
these heaps afterwards; a group of millions of rows sends N rows a map task. Rows compare by score, then
by the tie columns. Beyond as many groups in a task as spark.sql.objectHashAggregate.sortBased.fallbackThreshold
says (128 unless set), a task sorts its rows by group before it builds the heaps: set it to some ten thousands where
executors have the memory for as many heaps of N rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.internal import InternalFunction

from quarryline.common import current_rows


def top_n(df: DataFrame, groups: list[str], score: str, ties: list[str], n: int) -> DataFrame:
    """`groups`, `rank` (1 is best), `score`, `ties` of the `n` rows with the highest score in each group.

    Ties in score go to the smallest `ties`, in their order (strings by code point); null ties come first.
    Rows without a score don't count; NaN counts as the highest. A null group is a group. Repeated rows
    rank one after another. Scores are numbers.
    """
    whole = isinstance(df.schema[score].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))
    # The smallest struct is the best: ~x turns the order of whole numbers without overflow.
    turned = F.bitwise_not(F.col(score)) if whole else -F.col(score)
    heap = InternalFunction.collect_top_k(F.struct(turned.alias("_s"), *[F.col(t).alias(f"_t{i}") for i, t in enumerate(ties)], F.col(score).alias("_v")), n, True)
    nan_first = df.where(F.col(score).isNotNull())
    found = nan_first.groupBy(*groups).agg(heap.alias("_top")).select(*groups, F.posexplode(F.array_sort("_top")).alias("_i", "_r"))
    return found.select(*groups, (F.col("_i") + 1).alias("rank"), F.col("_r._v").alias(score), *[F.col(f"_r._t{i}").alias(t) for i, t in enumerate(ties)])


def largest_files(files: DataFrame, n: int = 3) -> DataFrame:
    """(volume_id, parent_id, rank, size, path, id): the `n` largest current files of each folder."""
    rows = current_rows(files, ["volume_id", "parent_id", "path", "size", F.coalesce(F.col("is_dir"), F.lit(False)).alias("is_dir")])
    return top_n(rows.where("NOT is_dir"), ["volume_id", "parent_id"], "size", ["path", "id"], n)
