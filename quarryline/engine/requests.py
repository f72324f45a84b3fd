"""Requests: each has an id, may be cancelled by it, and answers in one form whether it succeeds or not."""

from __future__ import annotations

import threading
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.engine.search import MAX_LIMIT, Catalog, Sort
from quarryline.engine.store import Conflict, Expired, Leases
from quarryline.lang.ast import QueryError


class Cancelled(RuntimeError):
    """The request was cancelled, or another with its id took its place."""


#: Errors a caller can do something about, and what they are called.
CODES = {QueryError: "bad_query", Expired: "expired", Conflict: "conflict", Cancelled: "cancelled"}


class Requests:
    """Runs actions under job tags, so that all jobs of a request can be cancelled by its id."""

    def __init__(self, spark: SparkSession):
        self.context, self.lock, self.turns, self.count = spark.sparkContext, threading.Lock(), {}, 0

    def run(self, request: str, action: Callable[[], object]) -> object:
        """What `action` returns. A running request of the same id is cancelled first."""
        self.cancel(request)
        with self.lock:
            self.count += 1
            turn = self.turns[request] = self.count
        tag = f"{request}#{turn}"
        self.context.addJobTag(tag)
        try:
            found = action()
        except Exception:
            if self.turns.get(request) != turn:
                raise Cancelled(request) from None
            raise
        finally:
            self.context.removeJobTag(tag)
            with self.lock:
                mine = self.turns.get(request) == turn
                if mine:
                    del self.turns[request]
        if not mine:
            raise Cancelled(request)
        return found

    def cancel(self, request: str) -> bool:
        """Whether such a request was running."""
        with self.lock:
            turn = self.turns.pop(request, None)
        if turn is not None:
            self.context.cancelJobsWithTag(f"{request}#{turn}")
        return turn is not None

    def answer(self, request: str, action: Callable[[], object]) -> dict:
        """{"ok": true, "result": ...} or {"ok": false, "error": {"code": ..., "message": ...}}."""
        try:
            return {"ok": True, "result": self.run(request, action)}
        except Exception as e:  # noqa: BLE001
            code = next((c for kind, c in CODES.items() if isinstance(e, kind)), "internal")
            return {"ok": False, "error": {"code": code, "message": str(e).split("\n")[0]}}


def selected(catalog: Catalog, text: str, ranks: Sequence[int], sort: Sort = None) -> DataFrame:
    """The rows at `ranks` (1-based) of a search's result, with their rank; ranks beyond the end are left out.

    Each page that has selected ranks is read once; a selection may name MAX_LIMIT ranks."""
    wanted = sorted({r for r in ranks if r > 0})
    if len(wanted) > MAX_LIMIT:
        raise QueryError(f"More than {MAX_LIMIT} rows selected")
    pages: list[list[int]] = []
    for r in wanted:
        if pages and r - pages[-1][0] < MAX_LIMIT:
            pages[-1].append(r)
        else:
            pages.append([r])
    out = [catalog.ranked(text, sort, p[-1] - p[0] + 1, p[0] - 1).where(F.col("rank").isin(p)) for p in pages]
    whole = out[0] if out else catalog.ranked(text, sort, 0)
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


def selected_under(leases: Leases, key: str, text: str, ranks: Sequence[int], sort: Sort = None) -> DataFrame:
    """As `selected`, of the catalogue a lease pins."""
    return selected(leases.get(key), text, ranks, sort)
