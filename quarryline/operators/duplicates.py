"""Duplicate files by name, size or content; hard links and clones; which copies to keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.operators.skew import fragment_replicate_join
from quarryline.plans.model import derived

MODES = ("name", "size", "content")


def _regular(files: DataFrame) -> DataFrame:
    return files.where(~F.coalesce("is_dir", F.lit(False)) & ~F.coalesce("is_symlink", F.lit(False)))


def _object() -> Column:
    """Identity of the data a path leads to; rows without one stand for themselves."""
    return F.when(F.col("file_id").isNotNull(), F.concat_ws(":", F.coalesce("volume_id", F.lit("")), "file_id")).otherwise(F.concat(F.lit("row:"), "id"))


def _keyed(rows: DataFrame, key: Column) -> DataFrame:
    return rows.select(key.alias("group_key"), "path", "id", "object").where(F.col("group_key").isNotNull())


def _hashed(rows: DataFrame, content: DataFrame | None) -> DataFrame:
    return _keyed(rows if content is None else rows.drop("body").join(content.select("path", "body"), "path"), F.sha2("body", 256))


def duplicate_groups(files: DataFrame, mode: str, content: DataFrame | None = None) -> DataFrame:
    """(group_key, path, id, object, distinct_files, paths, keeper): every row of the groups of `duplicate_summary`.
    A key that very many rows have is split by load."""
    keyed = _keyed_by(files, mode, content)
    return fragment_replicate_join(keyed, _several(keyed), ["group_key"])


def duplicate_summary(files: DataFrame, mode: str, content: DataFrame | None = None) -> DataFrame:
    """(group_key, distinct_files, paths, keeper) of groups with more than one object; the smallest path is kept.

    name: the folded name, accents kept; size: the size as text, so groups sort as text; content: the
    SHA-256 of `body` (of `content` (path, body), or a column of `files`), looked at only where a size has
    several objects. Rows of unknown size are looked at too, and if there are any (asked at once), so is a
    size's only object: it is in a group if one of unknown size has its content. Hard links are one object,
    and each of their paths counts. Rows whose key is null are in no group. One row a group, combined before the
    shuffle, so a name that a third of all files have costs no more than any other.
    """
    return _several(_keyed_by(files, mode, content))


def _keyed_by(files: DataFrame, mode: str, content: DataFrame | None) -> DataFrame:
    if mode not in MODES:
        raise ValueError(f"mode: {mode}")
    rows = _regular(files).withColumn("object", _object())
    if mode == "content":
        # min and max tell one object from several with map-side combining, however many paths share a size.
        sizes = rows.where(F.col("size").isNotNull()).groupBy("size").agg(F.min("object").alias("lo"), F.max("object").alias("hi")).where("lo <> hi").select("size")
        keyed = _hashed(rows.join(sizes, "size", "left_semi"), content)
        if not rows.where(F.col("size").isNull()).select("size").isEmpty():
            unknown = _hashed(rows.where(F.col("size").isNull()), content)
            lone = _hashed(rows.where(F.col("size").isNotNull()).join(sizes, "size", "left_anti"), content)
            keyed = keyed.unionByName(unknown).unionByName(lone.join(unknown.select("group_key").distinct(), "group_key", "left_semi"))
    else:
        keyed = _keyed(rows, derived(rows, "folded_name") if mode == "name" else F.col("size").cast("string"))
    return keyed


def _several(keyed: DataFrame) -> DataFrame:
    """(group_key, distinct_files, paths, keeper) of keys with several objects, by aggregates alone."""
    objects = keyed.groupBy("group_key", "object").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("least"))
    return objects.groupBy("group_key").agg(F.count(F.lit(1)).alias("distinct_files"), F.sum("n").alias("paths"), F.min("least").alias("keeper")).where("distinct_files > 1")


def numbered(groups: DataFrame) -> DataFrame:
    """With `member`, the row's number in its group by path. Only where groups are small enough to sort."""
    return groups.withColumn("member", F.row_number().over(Window.partitionBy("group_key").orderBy("path", "id")))


def group_summary(groups: DataFrame) -> DataFrame:
    """(group_key, distinct_files, paths, keeper) of rows of `duplicate_groups`, one row a group."""
    return groups.groupBy("group_key", "distinct_files").agg(F.count(F.lit(1)).alias("paths"), F.min("path").alias("keeper"))


def removable(groups: DataFrame) -> DataFrame:
    """Rows that may go: neither the keeper (smallest path) of the group nor an alias of the keeper's data."""
    objects = groups.groupBy("group_key", "object").agg(F.min(F.struct("path", "id")).alias("f"), F.first("keeper").alias("keeper"))
    # One row an object by now; an object has the keeper's path as its own first, or another.
    first = objects.where(F.col("f.path") != F.col("keeper"))
    return first.select("group_key", F.col("f.path").alias("path"), F.col("f.id").alias("id"))


def hard_link_groups(files: DataFrame) -> DataFrame:
    """(volume_id, file_id, links, first_path) of data with more than one path."""
    rows = _regular(files).where(F.col("file_id").isNotNull())
    return rows.groupBy("volume_id", "file_id").agg(F.count(F.lit(1)).alias("links"), F.min("path").alias("first_path")).where("links > 1")


def clone_groups(groups: DataFrame, clones: DataFrame) -> DataFrame:
    """(group_key, volume_id, clone_id, files): of content groups the files that share storage.
    `clones` is (id, volume_id, clone_id)."""
    return groups.join(clones, "id").where(F.col("clone_id").isNotNull()).groupBy("group_key", "volume_id", "clone_id").agg(F.count_distinct("object").alias("files")).where("files > 1")


def link_closure(files: DataFrame, changed: DataFrame) -> DataFrame:
    """Ids of all rows that share data with a changed row, itself included: (volume_id, file_id) peers."""
    keys = files.join(changed.select("id"), "id", "left_semi").where(F.col("file_id").isNotNull()).select("volume_id", "file_id").distinct()
    return files.join(keys, ["volume_id", "file_id"], "left_semi").select("id").unionByName(changed.select("id")).distinct()
