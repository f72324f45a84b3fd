"""Batch renames: the plan, and what stands in its way."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.common import materialize, shuffle_width
from quarryline.functions.text import fold_column, nfc_column
from quarryline.plans.model import ancestors, parent_path


def _stem_and_extension() -> tuple[Column, Column]:
    """A leading dot is no extension, and folders have none."""
    dot = F.regexp_extract("name", r"(?s)\A(.+)(\.[^.]*)\z", 2)
    split = ~F.coalesce("is_dir", F.lit(False)) & (dot != "") & (dot != ".")
    return F.when(split, F.substring("name", F.lit(1), F.length("name") - F.length(dot))).otherwise(F.col("name")), F.when(split, dot).otherwise("")


def rename_plan(selection: DataFrame, position: str = "position", search: str = "", replacement: str = "", prefix: str = "", suffix: str = "", start: int | None = None, digits: int = 1, separator: str = " ") -> DataFrame:
    """`selection` (position, id, path, name, is_dir) with `new_name` and `new_path`.

    In the stem `search` is replaced; prefix and suffix are put around it; with `start`, the separator and
    start + position (0-based), padded to `digits` (1 to 12), follow. The extension stays.
    """
    if not 1 <= digits <= 12:
        raise ValueError("digits must lie between 1 and 12")
    stem, ext = _stem_and_extension()
    if search:
        stem = F.replace(stem, F.lit(search), F.lit(replacement))
    stem = F.concat(F.lit(prefix), stem, F.lit(suffix))
    if start is not None:
        number = (F.col(position) + F.lit(start)).cast("string")
        stem = F.concat(stem, F.lit(separator), F.when(F.length(number) >= digits, number).otherwise(F.lpad(number, digits, "0")))
    folder = parent_path(F.col("path"))
    named = selection.withColumn("new_name", F.concat(stem, ext))
    return named.withColumn("new_path", F.concat(F.when(folder == "/", "/").when(folder == "", "").otherwise(F.concat(folder, F.lit("/"))), "new_name"))


def positions(rows: DataFrame, order: list[Column]) -> DataFrame:
    """0-based `position` of each row in the order. The rows are written to the shared folder in ranges of it;
    each range is numbered by itself, from the count of rows in those before."""
    ranges = rows.repartitionByRange(shuffle_width(rows.sparkSession), *order).withColumn("_range", F.spark_partition_id())
    ranges = materialize(ranges, "positions")
    counts = sorted(map(tuple, ranges.groupBy("_range").count().collect()))
    before = accumulate((n for _, n in counts), initial=0)
    offsets = rows.sparkSession.createDataFrame([(r, b) for (r, _), b in zip(counts, before)], "_range int, _before bigint")
    at = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranges.withColumn("_at", at).join(F.broadcast(offsets), "_range").withColumn("position", F.col("_before") + F.col("_at") - 1).drop("_range", "_at", "_before")


def rename_conflicts(plan: DataFrame, files: DataFrame, case_sensitive: bool = False) -> DataFrame:
    """(id, conflict): invalid_name, no_change, duplicate_target, target_exists, inside_itself or
    overlapping_sources; the first that holds. Rows without a conflict don't appear."""
    key = (lambda c: nfc_column(c)) if case_sensitive else (lambda c: fold_column(c))
    p = plan.select("id", "path", "is_dir", "new_name", "new_path", key("new_path").alias("_target"), key("path").alias("_source"))
    twice = p.groupBy("_target").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_target", F.lit(True).alias("_twice"))
    there = files.select(key("path").alias("_target"), F.col("id").alias("_there")).join(p.select(F.col("id").alias("_there")), "_there", "left_anti").select("_target", F.lit(True).alias("_taken")).distinct()
    above = p.where(F.coalesce("is_dir", F.lit(False))).select(F.col("path").alias("_above")).distinct().withColumn("_under", F.lit(True))
    # Each folder is looked up once among the folders renamed, however many entries it has.
    p = p.withColumn("_folder", F.try_element_at(ancestors(F.col("path")), F.lit(-1)))
    folders = p.select(ancestors(F.col("path")).alias("_ups")).where(F.size("_ups") > 0).distinct()
    ups = folders.select(F.element_at("_ups", -1).alias("_folder"), F.explode("_ups").alias("_above"))
    under = ups.join(above, "_above").select("_folder", "_under").distinct()
    j = p.join(twice, "_target", "left").join(there, "_target", "left").join(under, "_folder", "left")
    inside = F.coalesce("is_dir", F.lit(False)) & F.col("new_path").startswith(F.concat("path", F.lit("/")))
    bad = (F.col("new_name") == "") | F.col("new_name").contains("/") | F.col("new_name").isin(".", "..")
    kind = F.when(bad, "invalid_name").when(F.col("new_path") == F.col("path"), "no_change").when(F.col("_under"), "overlapping_sources").when(F.col("_twice"), "duplicate_target").when(F.col("_taken") & (F.col("_target") != F.col("_source")), "target_exists").when(inside, "inside_itself")
    return j.select("id", kind.alias("conflict")).where("conflict IS NOT NULL")
