"""Processing only new or changed records, run by run.

A log of observations comes in deliveries. The ledger keeps, for each delivery, the newest state of every record
in it, split into partitions by delivery and key bucket. Each partition carries its fingerprint, the count and the
additive hash of the log rows it was made from; a run compares fingerprints, recomputes only partitions whose
fingerprint differs, and replaces each by dynamic partition overwrite, fingerprint and rows together. A run reads
of the log only deliveries that no run before has put into the ledger, and of the ledger only states of records in
the deliveries that lie between it and the successful run before it.

What a run has to process is written as one partition of its own, and the run counts once the manifest names it:
one file, replaced last, by one rename. An attempt that dies earlier leaves partitions that the next one finds
right by their fingerprint, or replaces. Nothing is skipped or repeated.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.common import SmallFiles, shuffle_width

#: Deliveries whose states are merged into one table, so that a run reads few tables however long the history.
MERGE_AFTER = 8


class ChangeLedger:
    """The runs in which each record has to be processed.

    key: the record's id; rows without one belong to no record and are left out. order: of the rows a
    run could read, the one with the greatest `order` is the record's state (a null is less than any
    value; rows equal in all of `order` and `state` are repeats). state: the columns that make a record
    count as changed; null equals null. delivery: an integer that grows; rows without one can't be read by any run.
    """

    def __init__(self, path: str, key: str, order: list[str], state: list[str], delivery: str = "delivery", buckets: int = 16, merge_after: int = MERGE_AFTER):
        self.path, self.key, self.order, self.state, self.delivery = path.rstrip("/"), key, order, state, delivery
        self.buckets, self.merge_after = buckets, merge_after

    # --- rows and tables

    def _rows(self, log: DataFrame) -> DataFrame:
        cols = list(dict.fromkeys([*self.order, *self.state]))
        key, bucket = F.col(self.key), F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")
        return log.where(key.isNotNull() & F.col(self.delivery).isNotNull()).select(key.alias("_key"), F.col(self.delivery).cast("int").alias("_d"), bucket.alias("_b"), *[F.col(c).alias(f"v_{c}") for c in cols])

    def _hash(self) -> Column:
        """Of a row; nulls count, as a hash function that skips them can't tell which column is null."""
        cols = ["_key", "_d", *[f"v_{c}" for c in dict.fromkeys([*self.order, *self.state])]]
        return F.xxhash64(*[x for c in cols for x in (F.col(c), F.col(c).isNull())]).cast("decimal(20,0)")

    def _top(self) -> Column:
        return F.struct(*[F.col(f"v_{c}").alias(f"o{i}") for i, c in enumerate(self.order)], F.struct(*[F.col(f"v_{c}").alias(c) for c in self.state]).alias("state"))

    def _table(self, spark: SparkSession, name: str, schema: T.StructType | str) -> DataFrame:
        """A table of the ledger; empty as long as nothing is written."""
        if not SmallFiles(spark, self.path).exists(name):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def _schema(self, log: DataFrame) -> T.StructType:
        top = self._rows(log.limit(0)).select("_key", self._top().alias("top")).schema
        return T.StructType([*top.fields, *T._parse_datatype_string("rows_seen bigint, rows_hash string, _d int, _b int").fields])

    def _manifest(self, files: SmallFiles) -> dict:
        return files.read("manifest.json") or {"runs": [], "covered": None, "merged": None}

    # --- a run

    def run(self, log: DataFrame, run_id: int, delivery: int, at: Callable[[str], None] = lambda stage: None) -> list[tuple[int, int]]:
        """One successful run that could read deliveries up to `delivery`; returns the (delivery, bucket)
        partitions it replaced. A run that the manifest names already does nothing. `at` is called before the
        stages 'due' and 'commit'; what it raises ends the attempt there."""
        spark, files = log.sparkSession, SmallFiles(log.sparkSession, self.path)
        m = self._manifest(files)
        if any(r >= run_id for r, _ in m["runs"]):
            return []
        schema, covered = self._schema(log), m["covered"]
        replaced: list[tuple[int, int]] = []
        if covered is None or delivery > covered:
            fresh = F.col("_d") <= delivery if covered is None else (F.col("_d") > covered) & (F.col("_d") <= delivery)
            replaced = self._refresh(log, schema, fresh)
        at("due")
        before = m["runs"][-1][1] if m["runs"] else None
        files.delete(f"due/run_id={run_id}")
        self._write(self._due(spark, schema, m["merged"], before, delivery).withColumn("run_id", F.lit(run_id)), "due", ["run_id"])
        at("commit")
        m = {**m, "runs": [*m["runs"], [run_id, delivery]], "covered": max(delivery, covered or delivery)}
        self._commit(spark, files, schema, m)
        return replaced

    def catch_up(self, log: DataFrame, runs: DataFrame) -> list[tuple[int, int]]:
        """All successful runs of `runs` (run_id, delivery, run_state; a few rows for each run of the pipeline)
        that the manifest doesn't name yet, in their order; returns the partitions replaced."""
        ok = runs.where((F.col("run_state") == "ok") & F.col("delivery").isNotNull()).select("run_id", "delivery").orderBy("run_id").collect()
        return [p for r in ok for p in self.run(log, r["run_id"], r["delivery"])]

    def audit(self, log: DataFrame) -> list[tuple[int, int]]:
        """Compares every delivery in the ledger with the log, in case old ones were altered: replaces what
        differs, and what later runs had to process."""
        spark, files = log.sparkSession, SmallFiles(log.sparkSession, self.path)
        m, schema = self._manifest(files), self._schema(log)
        if m["covered"] is None:
            return []
        replaced = self._refresh(log, schema, F.col("_d") <= m["covered"])
        if replaced:
            self._commit(spark, files, schema, {**m, "merged": None}, merge=False)
            before = None
            for run_id, delivery in m["runs"]:
                if max(delivery, before or delivery) >= min(d for d, _ in replaced):
                    files.delete(f"due/run_id={run_id}")
                    self._write(self._due(spark, schema, None, before, delivery).withColumn("run_id", F.lit(run_id)), "due", ["run_id"])
                before = delivery
        return replaced

    # --- its steps

    def _refresh(self, log: DataFrame, schema: T.StructType, which: Column) -> list[tuple[int, int]]:
        """The partitions of these deliveries brought up to the log. The driver gets a row for each of them."""
        spark, files, rows = log.sparkSession, SmallFiles(log.sparkSession, self.path), self._rows(log).where(which)
        seen = rows.groupBy("_d", "_b").agg(F.count(F.lit(1)).alias("n"), F.sum(self._hash()).alias("h")).collect()
        new = {(r["_d"], r["_b"]): (r["n"], f"{int(r['h']) % (1 << 128):032x}") for r in seen}
        stored = self._table(spark, "newest", schema).where(which).groupBy("_d", "_b").agg(F.first("rows_seen").alias("n"), F.first("rows_hash").alias("h")).collect()
        old = {(r["_d"], r["_b"]): (r["n"], r["h"]) for r in stored}
        for d, b in old.keys() - new.keys():  # all its rows are gone
            files.delete(f"newest/_d={d}/_b={b}")
        changed = sorted(p for p, f in new.items() if old.get(p) != f)
        if changed:
            marks = spark.createDataFrame([(*p, *new[p]) for p in changed], "_d int, _b int, rows_seen bigint, rows_hash string")
            todo = rows.join(F.broadcast(marks.select("_d", "_b")), ["_d", "_b"], "left_semi")
            # A hot record's rows fold to one for each delivery in the map tasks.
            newest = todo.groupBy("_d", "_b", "_key").agg(F.max(self._top()).alias("top"))
            salt = max(1, -(-shuffle_width(spark) // len(changed)))
            newest = newest.repartition(shuffle_width(spark), "_d", "_b", F.pmod(F.xxhash64(F.lit(5), "_key"), F.lit(salt)))
            self._write(newest.join(F.broadcast(marks), ["_d", "_b"]).select(*schema.names), "newest", ["_d", "_b"])
        return sorted({*changed, *(old.keys() - new.keys())})

    def _write(self, df: DataFrame, name: str, parts: list[str]) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(f"{self.path}/{name}")

    def _states(self, spark: SparkSession, schema: T.StructType, merged: dict | None, upto: int) -> DataFrame:
        """(_key, top) of every delivery up to `upto`, those merged already as one."""
        newest = self._table(spark, "newest", schema).where(F.col("_d") <= upto)
        if merged is None or merged["upto"] > upto:
            return newest.select("_key", "top")
        base = self._table(spark, merged["name"], T.StructType(schema.fields[:2]))
        return base.unionByName(newest.where(F.col("_d") > merged["upto"]).select("_key", "top"))

    def _due(self, spark: SparkSession, schema: T.StructType, merged: dict | None, before: int | None, now: int) -> DataFrame:
        """(key, state) of records that have a state at `now` and had none, or a different one, at `before`. Only
        records of the deliveries between the two can differ; a run may also read less than the one before."""
        low, high = (now, now) if before is None else (min(before, now), max(before, now))
        between = self._table(spark, "newest", schema).where((F.col("_d") <= high) & (F.lit(before is None) | (F.col("_d") > low)))
        moved = between.groupBy("_key").agg(F.max("top").alias("new"))
        if before is None:
            both = moved.withColumn("old", F.lit(None).cast(schema["top"].dataType))
        else:
            # The other side of a join tells the scan which keys are asked, so old states are mostly skipped.
            old = self._states(spark, schema, merged, low).join(moved.select("_key"), "_key", "left_semi").groupBy("_key").agg(F.max("top").alias("old"))
            both = moved.join(old, "_key", "left")
        later = F.greatest("new", "old") if before is not None else F.col("new")
        was, now_is = (F.col("old"), later) if before is None or now >= before else (later, F.col("old"))
        due = now_is.isNotNull() & ~F.coalesce(was["state"].eqNullSafe(now_is["state"]) & was.isNotNull(), F.lit(False))
        return both.where(due).select(F.col("_key").alias(self.key), *[now_is["state"][c].alias(c) for c in self.state if c != self.key])

    def _commit(self, spark: SparkSession, files: SmallFiles, schema: T.StructType, m: dict, merge: bool = True) -> None:
        old, upto = m["merged"], m["covered"]
        if merge and upto - (old["upto"] if old else 0) >= self.merge_after:
            name = f"merged-{uuid.uuid4().hex[:12]}"
            self._states(spark, schema, old, upto).groupBy("_key").agg(F.max("top").alias("top")).write.parquet(f"{self.path}/{name}")
            m = {**m, "merged": {"upto": upto, "name": name}}
        files.write("manifest.json", m)
        if old and m["merged"] != old:
            files.delete(old["name"])

    # --- results

    def due(self, spark: SparkSession) -> DataFrame:
        """(run_id, key) of what each successful run has to process."""
        return self.read(spark).select("run_id", self.key)

    def read(self, spark: SparkSession) -> DataFrame:
        """As `due`, with the record's state."""
        files = SmallFiles(spark, self.path)
        done = [r for r, _ in self._manifest(files)["runs"] if files.exists(f"due/run_id={r}")]
        if not done:
            return spark.createDataFrame([], f"{self.key} bigint, run_id bigint")
        found = spark.read.parquet(f"{self.path}/due")
        return found.where(F.col("run_id").isin(done)).withColumn("run_id", F.col("run_id").cast("bigint"))
