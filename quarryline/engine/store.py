"""Generations of a catalogue: immutable Parquet tables, numbered manifests that name the current ones, leases that
pin one for a window of pages, and the preferences every query is read under."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.common import SmallFiles, shuffle_width
from quarryline.engine.search import Catalog
from quarryline.lang.parser import parse
from quarryline.lang.values import Clock
from quarryline.plans.model import SCHEMA, prepare
from quarryline.plans.relations import Coverage
from quarryline.streaming.merge import IDENTITY, rewrite_needed

KEEP, KEEP_MANIFESTS, MAX_DELTAS = 3, 8, 32
MANIFEST = "manifest-"
#: What a generation holds beside derived columns.
STORED = [*SCHEMA.names, "body"]
OPERATION_LEASES, WINDOW_LEASES, LEASE_SECONDS, HISTORY = 8, 128, 300, 100


class Expired(LookupError):
    """A generation or lease that is no longer kept."""


@dataclass(frozen=True)
class Preferences:
    macros: dict[str, str] = field(default_factory=dict)
    bookmarks: tuple[str, ...] = ()
    exclusions: tuple[str, ...] = ()
    history: tuple[str, ...] = ()
    settings: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        for text in (*self.macros.values(), *self.exclusions):
            parse(text, self.macros)

    def visited(self, text: str) -> Preferences:
        """Newest first, each once, at most 100."""
        return replace(self, history=(text, *[h for h in self.history if h != text])[:HISTORY])


class Conflict(RuntimeError):
    """Another writer has published since this one read the store."""


class GenerationStore:
    """Writers publish generations, readers pin them.

    A generation is a base table, sorted by path, and a few delta tables that hold only what changed since; reading
    takes of each path the row of the last delta that has it, else the base's. The manifest is a numbered file,
    created only if its number is free, so of two writers that started from one state one succeeds; a crash leaves
    the old one. Tables that no kept generation and no lease needs are deleted by whoever publishes next.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), SmallFiles(spark, root)

    # --- manifest

    def _numbers(self) -> list[int]:
        return sorted(int(n[len(MANIFEST) : -5]) for n in self.files.list() if n.startswith(MANIFEST) and n.endswith(".json"))

    def manifest(self) -> dict:
        for n in reversed(self._numbers()):
            found = self.files.read(f"{MANIFEST}{n:012d}.json")
            if found:
                return found
        return {"version": 0, "generations": [], "batch": -1, "cursor": None, "retired": []}

    def _commit(self, m: dict, generation: dict, **more: object) -> None:
        kept = [*m["generations"], generation][-KEEP:]
        needed = {t for g in kept for t in _tables(g)}
        gone = {t for g in m["generations"] for t in _tables(g)} - needed
        new = {**m, **more, "version": m["version"] + 1, "generations": kept, "retired": sorted({*m["retired"], *gone} - needed)}
        if not self.files.write(f"{MANIFEST}{new['version']:012d}.json", new, replace=False):
            for t in set(_tables(generation)) - {t for g in m["generations"] for t in _tables(g)}:
                self.files.delete(t)
            raise Conflict(f"version {new['version']} was published by another writer")
        self._drop(new)

    def _drop(self, m: dict) -> None:
        """Deletes retired tables that no lease pins, and manifests that readers can't be at any more."""
        pinned = {t for lease in self.leases().values() for t in _tables(lease["generation"])}
        for t in m["retired"]:
            if t not in pinned:
                self.files.delete(t)
        for n in self._numbers()[:-KEEP_MANIFESTS]:
            self.files.delete(f"{MANIFEST}{n:012d}.json")

    # --- publishing

    def publish(self, rows: DataFrame, coverage: Coverage | None = None, batch: int | None = None, cursor: dict | None = None, expect: int | None = None) -> int:
        """Writes a whole generation, names it current, and drops all but the last three. The coverage stays as it was
        unless given. `expect`: the generation this one was made from; if it isn't the current one any more, Conflict."""
        m = self._expected(expect)
        name = f"gen={self._next(m)}-{uuid.uuid4().hex[:8]}"
        # Sorted by path, so that a subtree is a range of files and of row groups.
        prepare(rows).repartitionByRange(shuffle_width(self.spark), "path", "id").sortWithinPartitions("path").write.parquet(f"{self.root}/{name}")
        total = self.spark.read.parquet(f"{self.root}/{name}").count()
        self._commit(m, self._generation(m, name, [], total, 0, coverage), **_said(batch=batch, cursor=cursor))
        return self._next(m)

    def publish_changes(self, rows: DataFrame, gone: DataFrame | None = None, coverage: Coverage | None = None, batch: int | None = None, cursor: dict | None = None, expect: int | None = None) -> int:
        """A generation that differs from the current one by `rows` (put in by path) and the paths of `gone`. Only the
        difference is written; once differences add up, or there are many, the whole is written anew."""
        m = self._expected(expect)
        if not m["generations"]:
            raise Expired("no generation")
        last = m["generations"][-1]
        name = f"delta={self._next(m)}-{uuid.uuid4().hex[:8]}"
        df = prepare(rows).withColumn("_gone", F.lit(False))
        if gone is not None:
            df = df.unionByName(gone.select("path").distinct().withColumn("_gone", F.lit(True)), allowMissingColumns=True)
        df.write.parquet(f"{self.root}/{name}")
        changed = last["changed"] + self.spark.read.parquet(f"{self.root}/{name}").count()
        generation = self._generation(m, last["base"], [*last["deltas"], name], last["rows"], changed, coverage)
        if rewrite_needed(changed, last["rows"]) or len(generation["deltas"]) > MAX_DELTAS:
            n = self.publish(self._assembled(generation), coverage, batch, cursor, expect=last["n"])
            self.files.delete(name)
            return n
        self._commit(m, generation, **_said(batch=batch, cursor=cursor))
        return self._next(m)

    def publish_content(self, content: DataFrame) -> int:
        """Bodies and properties of entries, `content` being (path, body, properties) and any of the columns that tell
        one state of a file from another: where those differ from the entry's, the content is of an older state and
        isn't taken over. Content that is there already makes no new generation."""
        c = content.select("path", F.col("body").alias("_body"), F.col("properties").alias("_properties"), *[F.col(x).alias(f"_{x}") for x in IDENTITY if x in content.columns])
        same = reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(f"_{x}")) for x in IDENTITY if x in content.columns], F.lit(True))
        c = c.groupBy("path").agg(F.max(F.struct(*[x for x in c.columns if x != "path"])).alias("_c")).select("path", "_c.*")
        rows = self.rows().join(c, "path").where(same & ~(F.col("body").eqNullSafe(F.col("_body")) & F.coalesce("_properties", "properties").eqNullSafe(F.col("properties"))))
        if rows.isEmpty():
            return self.current()
        rows = rows.withColumns({"body": F.col("_body"), "properties": F.coalesce("_properties", "properties"), "content_indexed": F.lit(True)})
        return self.publish_changes(rows.select(*STORED))

    def _expected(self, expect: int | None) -> dict:
        m = self.manifest()
        if expect is not None and (not m["generations"] or m["generations"][-1]["n"] != expect):
            raise Conflict(f"generation {expect} isn't the current one any more")
        return m

    @staticmethod
    def _next(m: dict) -> int:
        return max([g["n"] for g in m["generations"]], default=0) + 1

    def _generation(self, m: dict, base: str, deltas: list[str], rows: int, changed: int, coverage: Coverage | None) -> dict:
        kept = m["generations"][-1]["coverage"] if m["generations"] else asdict(Coverage())
        cover = kept if coverage is None else asdict(coverage)
        token = hashlib.sha256(json.dumps(cover, sort_keys=True).encode()).hexdigest()
        return {"n": self._next(m), "base": base, "deltas": deltas, "rows": rows, "changed": changed, "coverage": cover, "token": token}

    # --- reading

    def last_batch(self) -> int:
        return self.manifest()["batch"]

    def cursor(self) -> dict | None:
        """Up to where a change stream is in the current generation."""
        return self.manifest()["cursor"]

    def current(self) -> int:
        gens = self.manifest()["generations"]
        if not gens:
            raise Expired("no generation")
        return gens[-1]["n"]

    def _find(self, n: int | None) -> dict:
        gens = self.manifest()["generations"]
        found = gens[-1:] if n is None else [g for g in gens if g["n"] == n]
        if not found:
            raise Expired(f"generation {n} isn't kept")
        return found[0]

    def _assembled(self, g: dict) -> DataFrame:
        base = self.spark.read.parquet(f"{self.root}/{g['base']}")
        if not g["deltas"]:
            return base
        each = [self.spark.read.parquet(f"{self.root}/{d}").withColumn("_seq", F.lit(i)) for i, d in enumerate(g["deltas"])]
        every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), each)
        # Of a path the rows of its last delta; there may be several rows in it.
        last = every.groupBy("path").agg(F.max("_seq").alias("_seq"))
        newest = every.join(last, ["path", "_seq"], "left_semi")
        return base.join(last.select("path"), "path", "left_anti").unionByName(newest.where("NOT _gone").drop("_gone", "_seq"), allowMissingColumns=True)

    def rows(self, n: int | None = None) -> DataFrame:
        return self._assembled(self._find(n))

    def coverage(self, n: int | None = None) -> Coverage:
        return _coverage(self._find(n))

    def preferences(self) -> Preferences:
        return _preferences(self.files.read("preferences.json"))

    def set_preferences(self, p: Preferences) -> bool:
        """False, and nothing written, if nothing changes."""
        if p == self.preferences():
            return False
        self.files.write("preferences.json", asdict(p))
        return True

    def status(self) -> dict:
        m = self.manifest()
        gens = m["generations"]
        return {"version": m["version"], "generation": gens[-1]["n"] if gens else None, "kept": [g["n"] for g in gens], "entries": self.rows().count() if gens else 0, "coverage_token": gens[-1]["token"] if gens else None}

    def wait_status(self, version: int, seconds: float = 30.0, now: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> dict:
        """The status as soon as it is newer than `version`, or after so many seconds as it is."""
        end = now() + seconds
        while self.manifest()["version"] <= version and now() < end:
            sleep(min(0.25, max(0.0, end - now())))
        return self.status()

    def catalog(self, n: int | None = None, clock: Clock | None = None) -> Catalog:
        p = self.preferences()
        return Catalog(self.rows(n), p.macros, p.exclusions, self.coverage(n), clock)

    # --- leases

    def leases(self) -> dict[str, dict]:
        return {n[:-5]: found for n in self.files.list("leases") if n.endswith(".json") and not n.startswith(".") and (found := self.files.read(f"leases/{n}"))}


def _tables(g: dict) -> list[str]:
    return [g["base"], *g["deltas"]]


def _said(**values: object) -> dict:
    return {k: v for k, v in values.items() if v is not None}


def _coverage(g: dict) -> Coverage:
    c = g["coverage"]
    return Coverage(c["complete"], tuple(c["roots"]), tuple(c["uncovered"]))


def _preferences(p: dict) -> Preferences:
    return Preferences(p.get("macros", {}), tuple(p.get("bookmarks", ())), tuple(p.get("exclusions", ())), tuple(p.get("history", ())), p.get("settings", {}))


class Leases:
    """Pinned catalogues by id. A lease freezes rows, preferences, coverage and clock, and lives 300 seconds after its
    last use. It is a file of the store, so it outlives the process that took it. There are at most so many of a
    kind; an expired one makes room."""

    def __init__(self, store: GenerationStore, now: Callable[[], float] = time.time):
        self.store, self.now = store, now

    def _sweep(self) -> dict[str, dict]:
        held = self.store.leases()
        ended = [k for k, h in held.items() if h["end"] <= self.now()]
        for k in ended:
            self.store.files.delete(f"leases/{k}.json")
            del held[k]
        if ended:
            self.store._drop(self.store.manifest())
        return held

    def retain(self, window: bool = True, generation: int | None = None) -> str:
        held = self._sweep()
        if sum(h["window"] == window for h in held.values()) >= (WINDOW_LEASES if window else OPERATION_LEASES):
            raise RuntimeError("too many leases")
        key = uuid.uuid4().hex
        lease = {"generation": self.store._find(generation), "preferences": asdict(self.store.preferences()), "clock": self.now(), "end": self.now() + LEASE_SECONDS, "window": window}
        self.store.files.write(f"leases/{key}.json", lease)
        return key

    def get(self, key: str) -> Catalog:
        """The pinned catalogue; its time starts anew."""
        held = self._sweep().get(key)
        if held is None:
            raise Expired(f"lease {key} has ended")
        self.store.files.write(f"leases/{key}.json", {**held, "end": self.now() + LEASE_SECONDS})
        p = _preferences(held["preferences"])
        return Catalog(self.store._assembled(held["generation"]), p.macros, p.exclusions, _coverage(held["generation"]), Clock(held["clock"]))

    def first_page(self, text: str, window: bool = True, **page: object) -> tuple[str, DataFrame]:
        """A lease, and the first page of a search under it; later pages ask `get` for its catalogue."""
        key = self.retain(window)
        return key, self.get(key).query(text, **page)

    def release(self, key: str) -> bool:
        there = self.store.files.exists(f"leases/{key}.json")
        if there:
            self.store.files.delete(f"leases/{key}.json")
            self.store._drop(self.store.manifest())
        return there
