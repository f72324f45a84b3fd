"""Change events: what they mean, and what has to be looked at again because of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.plans.model import ancestors, parent_path

EVENT_SCHEMA = "path string, event_id bigint, flags bigint"
# Bits of event flags, as the operating system numbers them.
MUST_SCAN, USER_DROPPED, KERNEL_DROPPED, IDS_WRAPPED, HISTORY_DONE, ROOT_CHANGED, MOUNT, UNMOUNT = 0x1, 0x2, 0x4, 0x8, 0x10, 0x20, 0x40, 0x80
INODE_META, IS_DIR = 0x400, 0x20000


def bit(mask: int) -> Column:
    return F.coalesce(F.col("flags").bitwiseAND(F.lit(mask)) != 0, F.lit(False))


def classify(events: DataFrame) -> DataFrame:
    """Adds must_rescan (the path's subtree), root_changed, and lost (history is incomplete everywhere)."""
    return events.withColumns({
        "must_rescan": bit(MUST_SCAN | USER_DROPPED | KERNEL_DROPPED | IDS_WRAPPED | ROOT_CHANGED | MOUNT | UNMOUNT),
        "root_changed": bit(ROOT_CHANGED | MOUNT | UNMOUNT),
        "lost": bit(USER_DROPPED | KERNEL_DROPPED | IDS_WRAPPED),
    })


def without_own(events: DataFrame, own: str) -> DataFrame:
    """Without events below the index's own folder; they don't move the cursor either."""
    return events.where(~((F.col("path") == own) | F.col("path").startswith(f"{own.rstrip('/')}/")))


#: Events of one drain that are looked at one by one.
QUEUE = 65_536


def collapse(events: DataFrame, roots: list[str], limit: int = QUEUE) -> DataFrame:
    """`events` as they are up to `limit`; beyond it one event for each root that has its subtree scanned anew, with
    the last id and whatever flags say about all of history."""
    if events.limit(limit + 1).count() <= limit:
        return events
    everywhere = USER_DROPPED | KERNEL_DROPPED | IDS_WRAPPED
    whole = events.agg(F.max("event_id").alias("event_id"), F.bit_or(F.col("flags").bitwiseAND(F.lit(everywhere))).alias("_all"))
    return whole.select(F.explode(F.array(*map(F.lit, roots))).alias("path"), "event_id", F.coalesce("_all", F.lit(0)).bitwiseOR(F.lit(MUST_SCAN)).cast("bigint").alias("flags"))


def cursor(events: DataFrame) -> DataFrame:
    """(cursor): the last event id, to be stored once everything before it is reconciled."""
    return events.agg(F.max("event_id").alias("cursor"))


def reconcile_plan(events: DataFrame, roots: list[str]) -> DataFrame:
    """(path, action) of a drain of events, each path once.

    rescan: the subtree is listed anew; if history was lost, that is every root. check_folder: only a
    folder's inode changed, so its children are compared first. refresh: one path's metadata, and the same
    for its parent. Paths inside a rescanned subtree aren't planned again.
    """
    seen = classify(events)
    # One event that lost history stands for all of them.
    whole = seen.where("lost").limit(1).select(F.explode(F.array(*map(F.lit, roots))).alias("path"))
    subtrees = seen.where("must_rescan").select("path").unionByName(whole).distinct()
    tops = subtrees.select(F.col("path").alias("_top"), F.lit(True).alias("_is"))

    def uncovered(df: DataFrame, own: bool) -> DataFrame:
        """Paths that lie in no subtree of the plan. '/' is above all of them: whether it is one is asked once, and no
        path looks it up. Of the folders above, each is looked up once, however many paths lie below it."""
        above = ancestors(F.col("path"))
        mine = df.withColumn("_folder", F.try_element_at(above, F.lit(-1)))
        folders = df.select(above.alias("_ups")).where(F.size("_ups") > 0).distinct()
        ups = folders.select(F.element_at("_ups", -1).alias("_folder"), F.explode("_ups").alias("_top"))
        inside = ups.join(tops, "_top", "left_semi").select("_folder").distinct().withColumn("_in", F.lit(True))
        rooted = F.broadcast(tops.where("_top = '/'").select(F.col("_is").alias("_rooted")))
        out = mine.join(inside, "_folder", "left").join(rooted, F.lit(True), "left").where("_in IS NULL AND (_rooted IS NULL OR path = '/')")
        if own:
            out = out.join(tops.select(F.col("_top").alias("path")), "path", "left_anti")
        return out.select(df.columns)

    rescan = uncovered(subtrees, own=False)
    rest = seen.where(~F.col("must_rescan")).groupBy("path").agg(F.bool_and(bit(INODE_META) & bit(IS_DIR)).alias("_meta"))
    parents = rest.select(parent_path(F.col("path")).alias("path")).where(F.col("path") != "").distinct().select("path", F.lit(None).cast("boolean").alias("_meta"))
    paths = rest.unionByName(parents).groupBy("path").agg(F.coalesce(F.bool_or("_meta"), F.lit(False)).alias("_meta"))
    single = uncovered(paths, own=True).select("path", F.when(F.col("_meta"), "check_folder").otherwise("refresh").alias("action"))
    return rescan.select("path", F.lit("rescan").alias("action")).unionByName(single)


def resume(saved: dict | None, stream: str, first: int, last: int) -> tuple[int | None, str]:
    """(event id to go on behind, reason) for a stream that still has the events `first` to `last`; None where all
    roots have to be scanned anew. `saved` is the cursor a store keeps: {"stream": ..., "event_id": ...}."""
    if not saved or saved.get("event_id") is None:
        return None, "no cursor"
    if saved.get("stream", stream) != stream:
        return None, "another stream"
    if saved["event_id"] > last:
        return None, "ids have wrapped"
    if saved["event_id"] < first - 1:
        return None, "history is gone"
    return saved["event_id"], "replay"


def resolve_checks(plan: DataFrame, files: DataFrame) -> DataFrame:
    """A folder to check that is a known folder needs a refresh only; an unknown one is listed anew."""
    known = files.where("is_dir").select("path", F.lit(True).alias("_known"))
    action = F.when(F.col("action") == "check_folder", F.when(F.col("_known"), "refresh").otherwise("rescan")).otherwise(F.col("action"))
    return plan.join(known, "path", "left").select("path", action.alias("action"))
