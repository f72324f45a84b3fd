"""Pages that were asked before, by everything they depend on."""

from __future__ import annotations

import threading
from collections import OrderedDict
from collections.abc import Mapping

from pyspark.sql import Row

from quarryline.engine.search import DEFAULT_LIMIT, Catalog, Sort
from quarryline.lang.parser import parse
from quarryline.lang.values import Clock

#: Seconds by which two clocks differ so that no relative date means the same under both.
APART = 3 * 366 * 86400 + 86400 + 3661.0


def uses_clock(text: str, macros: Mapping[str, str] | None = None, now: float = 1.7e9) -> bool:
    """Whether a search means something else at another time: only then does the time belong to its key."""
    return parse(text, macros, Clock(now)) != parse(text, macros, Clock(now + APART))


class ResultCache:
    """The last `size` pages, each of at most 10,000 rows. A page's key is the generation, the search with its
    macros and exclusions, order and place, and the time if the search or an exclusion depends on it."""

    def __init__(self, size: int = 64):
        self.size, self.pages, self.lock = size, OrderedDict(), threading.Lock()
        self.hits = 0

    def page(self, generation: int, catalog: Catalog, text: str, sort: Sort = None, limit: int = DEFAULT_LIMIT, offset: int = 0) -> list[Row]:
        timed = any(uses_clock(t, catalog.macros) for t in (text, *catalog.exclusions))
        key = (generation, text, tuple(sorted(catalog.macros.items())), tuple(catalog.exclusions), catalog.coverage, None if sort is None else tuple(map(tuple, sort)), limit, offset, catalog.clock if timed else None)
        # Without a bound clock a search that depends on the time is never the same twice.
        keep = not timed or catalog.clock is not None
        with self.lock:
            if keep and key in self.pages:
                self.pages.move_to_end(key)
                self.hits += 1
                return self.pages[key]
        rows = catalog.query(text, sort, limit, offset).collect()
        with self.lock:
            if keep:
                self.pages[key] = rows
                while len(self.pages) > self.size:
                    self.pages.popitem(last=False)
        return rows
