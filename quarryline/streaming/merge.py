"""Keeping a catalogue up to date: upserts, deletions, denied subtrees, and the stream that applies them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarryline.plans.model import SCHEMA
from quarryline.sources.scan import in_scopes

# Columns that make a row count as changed, and those that make its extracted content stale.
COMPARED = ["name", "extension", "size", "modified", "created", "changed", "modified_ns", "changed_ns", "is_dir", "is_symlink", "file_id", "parent_id", "volume_id", "flags"]
IDENTITY = ["volume_id", "file_id", "size", "modified", "modified_ns", "changed", "changed_ns", "created"]


def latest(changes: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last change of each key; of changes with one `order` the greatest row. Combined before the shuffle,
    so a key that changes very often costs one row a map task."""
    rest = [c for c in changes.columns if c not in (*key, order)]
    return changes.groupBy(*key).agg(F.max(F.struct(order, *rest)).alias("_r")).select(*key, "_r.*")


def upsert(files: DataFrame, observed: DataFrame) -> DataFrame:
    """`files` with `observed` rows (of the same columns, one a path) put in by path.

    A path that is there keeps its id; rows without a difference are kept as they are; a row whose data
    changed loses `properties`, `content_indexed` and, if `files` has bodies, its body. New paths get the observed id.
    """
    new = observed.select(*[F.col(f.name).alias(f"n_{f.name}") for f in SCHEMA])
    j = files.join(new, F.col("path") == F.col("n_path"), "full")
    differs = lambda cols: F.expr(" OR ".join(f"NOT ({c} <=> n_{c})" for c in cols))
    seen, old = F.col("n_path").isNotNull(), F.col("path").isNotNull()
    take = seen & (~old | differs(COMPARED))
    stale = seen & old & differs(IDENTITY)
    out = []
    for f in SCHEMA:
        n = f.name
        if n == "id":
            c = F.coalesce("id", "n_id")
        elif n in ("properties", "content_indexed"):
            empty = F.lit("{}") if n == "properties" else F.lit(False)
            c = F.when(stale, empty).when(old, F.col(n)).otherwise(F.coalesce(f"n_{n}", empty))
        else:
            c = F.when(take, F.col(f"n_{n}")).otherwise(F.col(n))
        out.append(c.cast(f.dataType).alias(n))
    if "body" in files.columns:
        out.append(F.when(~stale, F.col("body")).alias("body"))
    return j.select(*out)


def delete_missing(files: DataFrame, observed: DataFrame, roots: Sequence[str], uncovered: Sequence[str] = ()) -> DataFrame:
    """After a complete pass over `roots`: rows in them that weren't observed go, but not below what
    couldn't be read."""
    judged = in_scopes(F.col("path"), roots) & ~in_scopes(F.col("path"), uncovered)
    seen = observed.select("path").distinct().withColumn("_seen", F.lit(True))
    return files.join(seen, "path", "left").where(~judged | F.col("_seen")).select(files.columns)


def deny(files: DataFrame, uncovered: Sequence[str]) -> DataFrame:
    """`accessible`: rows below what couldn't be read are kept but hidden."""
    return files.withColumn("accessible", ~in_scopes(F.col("path"), uncovered))


def split_changes(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to put in, paths that are gone): the last change of each path by `event_id` wins."""
    last = latest(changes, ["path"], "event_id")
    return last.where(~F.coalesce("deleted", F.lit(False))).select([f.name for f in SCHEMA]), last.where("deleted").select("path")


def apply_changes(files: DataFrame, changes: DataFrame) -> DataFrame:
    """Upserts and tombstones (`deleted`) in one: `changes` has the catalogue's columns, `deleted` and
    `event_id`; the last change of a path wins."""
    put, gone = split_changes(changes)
    return upsert(files.join(gone, "path", "left_anti"), put)


def delta(files: DataFrame, journal: DataFrame) -> DataFrame:
    """Current rows for the journal's ids, a row of nulls with its id where the entry is gone."""
    return journal.select("id").distinct().join(files, "id", "left")


def rewrite_needed(changed: int, rows: int) -> bool:
    """Small changes go beside the generation; from max(2000, an eighth) on it is written anew."""
    return changed > max(2000, rows // 8)


JOURNAL_IDS = 65_536


def bounded_journal(changes: DataFrame) -> tuple[DataFrame, bool]:
    """(distinct ids, complete). More ids than a journal holds make it empty, and the reader starts over."""
    ids = changes.select("id").distinct()
    full = ids.limit(JOURNAL_IDS + 1).count() > JOURNAL_IDS
    return (ids.limit(0), False) if full else (ids, True)


def follow(changes: DataFrame, store, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Applies a stream of changes to a generation store, a generation for each batch.

    A batch reads of the catalogue the rows of its own paths and writes only what becomes of them. The store
    remembers the batch a generation came from, so a batch replayed after a crash changes nothing; it also keeps the
    last event id as the stream's cursor. Bodies of rows that stay, and what is known not to be covered, stay.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        if store.last_batch() >= batch_id:
            return
        n, rows = store.current(), store.rows()
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            put, gone = split_changes(df)
            touched = rows.join(put.select("path"), "path", "left_semi").select(*[f.name for f in SCHEMA], "body")
            upto = df.agg(F.max("event_id")).first()[0]
            store.publish_changes(upsert(touched, put), gone, batch=batch_id, cursor=None if upto is None else {"event_id": upto}, expect=n)
        finally:
            df.unpersist()

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
