"""The worker that fills a store from file systems and keeps it up to date from their change events."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarryline.engine.store import GenerationStore
from quarryline.plans.model import SCHEMA
from quarryline.plans.relations import Coverage
from quarryline.sources.scan import carry_out, compact_scopes, in_scopes, scan_levels
from quarryline.streaming import events as E
from quarryline.streaming import merge

#: An unfinished scan is published once it has found so many entries more, or half as many again, and at most every
#: so many seconds.
FIRST_ROWS, PAUSE = 10_000, 2.0
#: How often a stream of events is drained.
POLL = "150 milliseconds"


class Indexer:
    """`roots` are what the catalogue is to hold; `own` is the index's own folder, whose events don't count."""

    def __init__(self, store: GenerationStore, roots: Sequence[str], own: str = "", now: Callable[[], float] = time.monotonic):
        self.store, self.spark, self.roots, self.own, self.now = store, store.spark, compact_scopes(roots), own, now
        self.query: StreamingQuery | None = None

    def scan(self, excluded: Sequence[str] = (), cursor: dict | None = None) -> int:
        """All entries below the roots as a new generation, with what couldn't be read as gaps of its coverage. While
        it goes on, what is found so far is published as incomplete. `cursor` is where change events have to be taken
        up from: read it before the scan begins."""
        published, last, n = 0, self.now() - PAUSE, 0
        entries = uncovered = None
        for entries, uncovered, done in scan_levels(self.spark, self.roots, excluded):
            found = entries.count()
            if not done and found - published >= max(FIRST_ROWS, published // 2) and self.now() - last >= PAUSE:
                self.store.publish(entries, Coverage(False, tuple(self.roots)))
                published, last = found, self.now()
        gaps = sorted({*(r["path"] for r in uncovered.select("path").distinct().collect()), *compact_scopes(excluded)})
        n = self.store.publish(entries, Coverage(True, tuple(self.roots), tuple(gaps)), cursor=cursor)
        return n

    def drain(self, events: DataFrame, stream: str = "", batch: int | None = None) -> int | None:
        """Looks at everything that a batch of events names and publishes the difference, and with it the cursor: the
        last event's id. A batch that changes nothing but the cursor is published too. None if there are no events."""
        seen = E.without_own(events, self.own) if self.own else events
        last = seen.agg(F.max("event_id")).first()[0]
        if last is None:
            return None
        n, rows = self.store.current(), self.store.rows()
        plan = E.resolve_checks(E.reconcile_plan(E.collapse(seen, self.roots), self.roots), rows).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            entries, gone, uncovered = carry_out(plan)
            # As a scan does, the catalogue holds what lies below the roots, not the roots.
            entries = entries.where(in_scopes(F.col("path"), self.roots) & ~F.col("path").isin(self.roots))
            again = [r["path"] for r in plan.where("action = 'rescan'").select("path").collect()]
            failed = sorted(r["path"] for r in uncovered.select("path").distinct().collect())
            missing = rows.where(in_scopes(F.col("path"), again) & ~in_scopes(F.col("path"), failed)).select("path").join(entries.select("path"), "path", "left_anti")
            put = entries.groupBy("path").agg(F.max(F.struct(*[c for c in SCHEMA.names if c != "path"])).alias("r")).select("path", "r.*")
            touched = rows.join(put.select("path"), "path", "left_semi").select(*SCHEMA.names, "body")
            old = self.store.coverage()
            gaps = [u for u in old.uncovered if not any(u == a or u.startswith(a.rstrip("/") + "/") for a in again)]
            coverage = Coverage(old.complete, old.roots, tuple(sorted({*gaps, *failed})))
            # What is gone takes with it what was below it.
            lost = [r["path"] for r in gone.collect()]
            below = rows.where(in_scopes(F.col("path"), lost)).select("path")
            return self.store.publish_changes(merge.upsert(touched, put), missing.unionByName(below), coverage, batch=batch, cursor={"event_id": last, "stream": stream}, expect=n)
        finally:
            plan.unpersist()

    def start(self, events: DataFrame, checkpoint: str, stream: str = "", trigger: dict | None = None) -> StreamingQuery:
        """Drains a stream of events until `stop` or `quiesce`."""

        def batch(df: DataFrame, batch_id: int) -> None:
            if self.store.last_batch() < batch_id:
                self.drain(df, stream, batch_id)

        self.query = events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": POLL})).start()
        return self.query

    def quiesce(self) -> None:
        """Waits until all events so far are drained, then stops."""
        if self.query:
            self.query.processAllAvailable()
        self.stop()

    def stop(self) -> None:
        if self.query:
            self.query.stop()
            self.query = None
