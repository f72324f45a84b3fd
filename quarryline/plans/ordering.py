"""Orders of results: several fields, natural order for names and paths, ties by path and id ascending."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.common import materialize, shuffle_width
from quarryline.lang.ast import QueryError
from quarryline.plans.model import derived

# The fields that results may be sorted by.
FIELDS = ("name", "path", "extension", "size", "modified", "created", "is_dir")


def sort_keys(df: DataFrame, sort: Sequence[tuple[str, bool]] | None = None) -> list[tuple[Column, bool]]:
    """[(key, ascending)]. No `sort` means by name; an empty one by path and id only."""
    keys = []
    for field, up in [("name", True)] if sort is None else sort:
        if field not in FIELDS:
            raise QueryError(f"Unknown sort field '{field}'")
        keys.append((derived(df, f"{field}_key") if field in ("name", "path") else F.col(field), up))
    return [*keys, (F.col("path"), True), (F.col("id"), True)]


def directed(keys: Sequence[tuple[Column, bool]], backwards: bool = False) -> list[Column]:
    """Keys as an order: nulls come first where it ascends; `backwards` turns all of it round."""
    return [k.asc_nulls_first() if up != backwards else k.desc_nulls_last() for k, up in keys]


def ordered(df: DataFrame, sort: Sequence[tuple[str, bool]] | None = None) -> DataFrame:
    return df.orderBy(*directed(sort_keys(df, sort)))


def before(df: DataFrame, anchor: Sequence[object], sort: Sequence[tuple[str, bool]] | None = None) -> Column:
    """Whether a row sorts before the row whose keys are `anchor`."""
    return _before(sort_keys(df, sort), anchor)


def _before(keys: Sequence[tuple[Column, bool]], anchor: Sequence[object]) -> Column:
    same, out = F.lit(True), []
    for (k, up), v in zip(keys, anchor):
        v = F.lit(v)
        less = F.coalesce(k < v, k.isNull() & v.isNotNull()) if up else F.coalesce(k > v, v.isNull() & k.isNotNull())
        out.append(same & less)
        same = same & k.eqNullSafe(v)
    return F.coalesce(reduce(lambda a, b: a | b, out), F.lit(False))


def after(df: DataFrame, anchor: Sequence[object], sort: Sequence[tuple[str, bool]] | None = None) -> Column:
    """Whether a row sorts behind the row whose keys are `anchor`."""
    same = reduce(lambda a, b: a & b, [k.eqNullSafe(F.lit(v)) for (k, _), v in zip(sort_keys(df, sort), anchor)])
    return ~before(df, anchor, sort) & ~same


class Order:
    """A result in order, for pages however far down, without bringing the rows before them to one place.

    The keys alone are spread over ranges of the order, written and counted once; the ranges in which a page lies give
    its first and last keys, and only rows between these are sorted. The driver holds a page's keys.
    """

    def __init__(self, df: DataFrame, sort: Sequence[tuple[str, bool]] | None):
        self.df, self.sort = df, sort
        keys = sort_keys(df, sort)
        self.ups = [(F.col(f"k{i}"), up) for i, (_, up) in enumerate(keys)]
        t = df.select(*[k.alias(f"k{i}") for i, (k, _) in enumerate(keys)]).repartitionByRange(shuffle_width(df.sparkSession), *directed(self.ups))
        self.table = materialize(t.withColumn("_range", F.spark_partition_id()), "order")
        self.counts = sorted(map(tuple, self.table.groupBy("_range").count().collect()))

    def page(self, offset: int, limit: int) -> DataFrame:
        """Rows `offset` to `offset + limit`."""
        ends = list(accumulate(n for _, n in self.counts))
        inside = [i for i, end in enumerate(ends) if end > offset and end - self.counts[i][1] < offset + limit]
        if not inside or not limit:
            return self.df.limit(0)
        start = ends[inside[0]] - self.counts[inside[0]][1]
        near = self.table.where(F.col("_range").isin([self.counts[i][0] for i in inside])).drop("_range")
        page = near.orderBy(*directed(self.ups)).offset(offset - start).limit(limit).collect()
        first, last = list(page[0]), list(page[-1])
        skipped = offset - start - near.where(_before(self.ups, first)).count()
        rows = self.df.where(~before(self.df, first, self.sort) & ~after(self.df, last, self.sort))
        return ordered(rows, self.sort).offset(skipped).limit(limit)
