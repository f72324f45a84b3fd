"""Folder relations and roll-ups, resolved by joins before a search is compiled.

Entries belong to folders by their paths. Every fact about children is first combined for each parent
folder; only those few rows are then spread to the folders above, so cost doesn't grow with depth times
entries. A folder's facts are unknown where the coverage doesn't prove that all of it is indexed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.lang import ast as A
from quarryline.plans.compiler import Compiler, Mode, Resolved, in_range
from quarryline.plans.model import ancestors, parent_path

#: Sums above this are no size.
MAX_SIZE = 2**64 - 1


@dataclass(frozen=True)
class Coverage:
    """What the catalogue is known to hold completely: everything below `roots` but `uncovered`."""

    complete: bool = True
    roots: tuple[str, ...] = ("/",)
    uncovered: tuple[str, ...] = ()

    def covers(self, path: Column) -> Column:
        """The folder lies in a root and has no gap in, above or at it."""
        if not self.complete:
            return F.lit(False)
        inside = lambda p, root: (p == root) | p.startswith(root if root.endswith("/") else f"{root}/")
        ok = reduce(lambda a, b: a | b, [inside(path, r) for r in self.roots], F.lit(False))
        for gap in self.uncovered:
            ok = ok & ~inside(path, gap) & ~F.lit(gap).startswith(F.concat(path, F.when(path.endswith("/"), "").otherwise("/")))
        return ok


def _above(per_parent: DataFrame, aggregates: Sequence[Column]) -> DataFrame:
    """Facts of parents summed up for themselves and all folders above: (_at, aggregates)."""
    up = per_parent.withColumn("_at", F.explode(F.array_union(ancestors(F.col("_parent")), F.when(F.col("_parent") != "", F.array("_parent")).otherwise(F.array().cast("array<string>")))))
    root = per_parent.where(F.col("_parent") != "").withColumn("_at", F.lit("/"))
    return up.where(F.col("_at") != "/").unionByName(root).groupBy("_at").agg(*aggregates)


def is_folder(df: DataFrame) -> Column:
    return F.coalesce(F.col("is_dir"), F.lit(False)) & ~F.coalesce(F.col("is_symlink"), F.lit(False))


METRIC_SUMS = {"childcount": ("d_files", "d_folders"), "childfilecount": ("d_files",), "childfoldercount": ("d_folders",), "descendantcount": ("a_files", "a_folders"), "descendantfilecount": ("a_files",), "descendantfoldercount": ("a_folders",)}


def folder_metrics(df: DataFrame) -> DataFrame:
    """(path, childcount, ... foldersize) of every folder; foldersize is null beyond 64 bits.

    Symbolic links count as files, hard links each for itself; the sizes of folders don't count."""
    folder = is_folder(df)
    per = df.select(parent_path(F.col("path")).alias("_parent"), folder.alias("_f"), F.when(~folder, F.col("size")).cast("decimal(20,0)").alias("_s")).groupBy("_parent").agg(
        F.count_if("_f").alias("folders"), F.count_if(~F.col("_f")).alias("files"), F.sum("_s").alias("size"))
    per = per.where(F.col("_parent") != "")
    direct = per.select(F.col("_parent").alias("_at"), F.col("files").alias("d_files"), F.col("folders").alias("d_folders"))
    deep = _above(per, [F.sum("files").alias("a_files"), F.sum("folders").alias("a_folders"), F.sum(F.col("size").cast("decimal(38,0)")).alias("a_size")])
    dirs = df.where(folder).select(F.col("path").alias("_at")).distinct()
    joined = dirs.join(deep, "_at", "left").join(direct, "_at", "left").na.fill(0, ["d_files", "d_folders", "a_files", "a_folders"])
    total = F.coalesce("a_size", F.lit(0).cast("decimal(38,0)"))
    sums = [reduce(lambda a, b: a + b, [F.col(x) for x in parts]).alias(name) for name, parts in METRIC_SUMS.items()]
    return joined.select(F.col("_at").alias("path"), *sums, F.when(total <= F.lit(str(MAX_SIZE)).cast("decimal(38,0)"), total).alias("foldersize"))


def _truth(df: DataFrame, node: A.Related, coverage: Coverage) -> DataFrame:
    """(_at, _any, _open): of folders with entries considered, whether one is true and whether one is unknown."""
    inner, rows = resolve(df, node.part, coverage)
    truth = Compiler(rows, Mode(unknown_content=True, unknown_properties=True)).column(inner)
    per = rows.select(parent_path(F.col("path")).alias("_parent"), truth.alias("_t")).groupBy("_parent").agg(F.coalesce(F.bool_or("_t"), F.lit(False)).alias("_any"), F.bool_or(F.col("_t").isNull()).alias("_open"))
    per = per.where((F.col("_parent") != "") & (F.col("_any") | F.col("_open")))
    if not node.recursive:
        return per.withColumnRenamed("_parent", "_at")
    return _above(per, [F.bool_or("_any").alias("_any"), F.bool_or("_open").alias("_open")])


def resolve(df: DataFrame, node: A.Node, coverage: Coverage = Coverage()) -> tuple[A.Node, DataFrame]:
    """Replaces relations and metric terms by boolean columns joined to `df`; inner ones first."""
    metrics = None
    columns: dict[A.Node, str] = {}

    def walk(n: A.Node) -> A.Node:
        nonlocal df, metrics
        if isinstance(n, (A.All, A.Any)):
            return replace(n, parts=tuple(map(walk, n.parts)))
        if isinstance(n, A.Not):
            return A.Not(walk(n.part))
        metric = isinstance(n, (A.Number, A.Unknown)) and n.field in A.METRICS
        if not metric and not isinstance(n, A.Related):
            return n
        if n not in columns:
            name = columns[n] = f"_r{len([c for c in df.columns if c.startswith('_r')])}"
            known = coverage.covers(F.col("path"))
            if metric:
                if metrics is None:
                    metrics = folder_metrics(df)
                value = F.when(known, F.col("_m"))
                if isinstance(n, A.Unknown):
                    said = value.isNotNull() if n.negated else value.isNull()
                else:
                    said = in_range(value, n)
                df = df.join(metrics.select(F.col("path").alias("_at"), F.col(n.field).alias("_m")), df["path"] == F.col("_at"), "left")
            else:
                df = df.join(_truth(df, n, coverage), df["path"] == F.col("_at"), "left")
                any_, open_ = F.coalesce("_any", F.lit(False)), F.coalesce("_open", F.lit(False))
                said = F.when(any_, True).when(~known | open_, F.lit(None).cast("boolean")).otherwise(False)
            df = df.withColumn(name, F.when(is_folder(df), said).otherwise(False)).drop("_at", "_m", "_any", "_open")
        return Resolved(columns[n])

    return walk(node), df
