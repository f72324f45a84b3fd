"""Per-key work without a few tasks carrying it: fragment and replicate by estimated load.

Keys' loads are estimated from a sample, read in one pass. Keys that carry more than a fraction of a task's
fair share are *heavy*; there are at most `tasks / HEAVY_SHARE` of them, whatever the data, so the driver may
hold them. All other keys fall into a fixed number of hash bins. Heavy keys are split into proportionate
shards, shards and bins are packed onto tasks (largest first, onto the least loaded task), and every row goes
straight to its task by partition id. A matching side is replicated to the shards of a heavy key only; its
rows for light keys go to one task each. An estimate that is off costs balance, never rows: every row finds
its task by the plan, and so do the rows it has to meet.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from fractions import Fraction
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.common import materialize, shuffle_width

#: A key is heavy from this part of a task's fair share on, and its shards are about this large.
HEAVY_SHARE = 0.25
#: Hash bins for light keys, for each task.
BINS_PER_TASK = 16
#: The part of the rows that loads are estimated from. A key of a quarter of one of 10,000 tasks' shares still has
#: thousands of sampled rows once the table has a billion.
SAMPLE = 1 / 16


@dataclass(frozen=True)
class LoadPlan:
    """Where rows go: `heavy` has a row for each heavy key with its tasks, `light` (bin, task) one for each bin.
    Both are tables of bounded size, at most tasks / HEAVY_SHARE and tasks * BINS_PER_TASK rows."""

    keys: tuple[str, ...]
    tasks: int
    heavy: DataFrame
    light: DataFrame
    task_loads: tuple[int, ...]

    def _with_tasks(self, df: DataFrame) -> DataFrame:
        """Adds `_tasks` (null for light keys) and `_light`, the task of the key's bin."""
        same = reduce(lambda a, b: a & b, [df[k].eqNullSafe(self.heavy[f"_k{i}"]) for i, k in enumerate(self.keys)])
        found = df.join(F.broadcast(self.heavy), same, "left").drop(*[f"_k{i}" for i in range(len(self.keys))])
        return found.withColumn("_bin", _bin(self.keys, self.tasks)).join(F.broadcast(self.light), "_bin", "left").drop("_bin")

    def scatter(self, df: DataFrame, spread: list[Column] | None = None) -> DataFrame:
        """Adds `_task`: for rows of a heavy key one of its tasks, chosen by the row's content."""
        spread = spread or [F.coalesce(F.col(c).cast("string"), F.lit("\0null")) for c, t in df.dtypes if not t.startswith("map")]
        shard = F.pmod(F.xxhash64(F.lit(7), *spread), F.size("_tasks")).cast("int") + 1
        return self._with_tasks(df).withColumn("_task", F.when(F.col("_tasks").isNotNull(), F.element_at("_tasks", shard)).otherwise(F.col("_light"))).drop("_tasks", "_light")

    def replicate(self, df: DataFrame) -> DataFrame:
        """Adds `_task`: rows of a heavy key once for each of its tasks, all others once."""
        return self._with_tasks(df).withColumn("_task", F.explode(F.coalesce(F.array_distinct("_tasks"), F.array("_light")))).drop("_tasks", "_light")


def _bin(keys: tuple[str, ...], tasks: int) -> Column:
    return F.pmod(F.xxhash64(*[F.coalesce(F.col(k).cast("string"), F.lit("\0null")) for k in keys]), F.lit(tasks * BINS_PER_TASK)).cast("int")


def pack(loads: list[int], tasks: int) -> tuple[list[int], list[int]]:
    """The task of each item and the load of each task: largest item first, onto the least loaded task."""
    heap, where, total = [(0, t) for t in range(tasks)], [0] * len(loads), [0] * tasks
    for i in sorted(range(len(loads)), key=lambda i: (-loads[i], i)):
        load, t = heapq.heappop(heap)
        where[i], total[t] = t, load + loads[i]
        heapq.heappush(heap, (total[t], t))
    return where, total


def plan_by_load(df: DataFrame, keys: list[str], tasks: int | None = None, sample: float | None = None) -> LoadPlan:
    """Loads are row counts of a sample, combined in the map tasks before the shuffle. Null is a key like any other."""
    spark, tasks, sample = df.sparkSession, tasks or shuffle_width(df.sparkSession), SAMPLE if sample is None else sample
    seen = df.select(*keys) if sample >= 1 else df.select(*keys).sample(False, sample, 11)
    loads = seen.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).withColumn("_bin", _bin(tuple(keys), tasks)).persist(StorageLevel.MEMORY_AND_DISK)
    bins = {r["_bin"]: r["_s"] for r in loads.groupBy("_bin").agg(F.sum("_n").alias("_s")).collect()}
    limit = max(1, int(sum(bins.values()) / tasks * HEAVY_SHARE))
    heavy_rows = loads.where(F.col("_n") > limit).collect() if any(v > limit for v in bins.values()) else []
    loads.unpersist()
    items, owner = [], []
    for i, r in enumerate(heavy_rows):
        bins[r["_bin"]] -= r["_n"]
        shards = min(tasks, -(-r["_n"] // limit))
        items += [-(-r["_n"] // shards)] * shards
        owner += [i] * shards
    n_bins = tasks * BINS_PER_TASK
    where, task_loads = pack(items + [bins.get(b, 0) for b in range(n_bins)], tasks)
    of_key: dict[int, list[int]] = {}
    for o, t in zip(owner, where):
        of_key.setdefault(o, []).append(t)
    schema = ", ".join(f"_k{i} {df.schema[k].dataType.simpleString()}" for i, k in enumerate(keys)) + ", _tasks array<int>"
    heavy = spark.createDataFrame([(*[r[k] for k in keys], of_key[i]) for i, r in enumerate(heavy_rows)], schema)
    light = spark.createDataFrame(list(enumerate(where[len(items) :])), "_bin int, _light int")
    return LoadPlan(tuple(keys), tasks, heavy, light, tuple(task_loads))


def fragment_replicate_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", tasks: int | None = None, plan: LoadPlan | None = None) -> DataFrame:
    """`left` joined with `right` on `keys`, `left` being the side with hot keys; `plan` saves estimating its loads again.

    `how` is inner, left, left_semi or left_anti. Keys compare as in SQL: null matches nothing. Other
    columns that both sides name come out as the left's, the right's ones with `_right` appended.
    Each left row goes to one task, so repeated rows stay repeated and none is lost.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"how: {how}")
    clash = {c.lower() for c in left.columns} - {k.lower() for k in keys}
    right = right.withColumnsRenamed({c: f"{c}_right" for c in right.columns if c.lower() in clash})
    plan = plan or plan_by_load(left, keys, tasks)
    a = plan.scatter(left).repartitionById(plan.tasks, F.col("_task"))
    b = plan.replicate(right).repartitionById(plan.tasks, F.col("_task"))
    return a.join(b, ["_task", *keys], how).drop("_task")


def fragment_totals(df: DataFrame, keys: list[str], sums: list[str], matching: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """Per-key `entries` and `total_<column>` for all keys, null included, in balanced tasks.

    Rows are first combined to partial states of (key, task) in the map tasks; the states go to the
    planned tasks, meet there the rows of `matching` (at most one for a key; left join), and are merged.
    Sums are exact decimals; a key with no value at all has a null sum. An empty table has no keys.
    """
    plan = plan_by_load(df, keys, tasks)
    parts = [F.count(F.lit(1)).alias("entries"), *[F.sum(F.col(c).cast("decimal(20,0)")).alias(f"total_{c}") for c in sums]]
    rows = df.select(*keys, *sums, *[c for c in df.columns if c in ("id", "_spread") and c not in (*keys, *sums)])
    partial = plan.scatter(rows).groupBy(*keys, "_task").agg(*parts)
    extra: list[str] = []
    placed = partial.repartitionById(plan.tasks, F.col("_task"))
    if matching is not None:
        extra = [c for c in matching.columns if c not in keys]
        placed = placed.join(plan.replicate(matching).repartitionById(plan.tasks, F.col("_task")), ["_task", *keys], "left")
    merged = [F.sum("entries").alias("entries"), *[F.sum(f"total_{c}").cast("decimal(38,0)").alias(f"total_{c}") for c in sums]]
    return placed.groupBy(*keys).agg(*merged, *[F.first(c, ignorenulls=True).alias(c) for c in extra])


def totals_by_field(df: DataFrame, fields: list[str], sums: list[str], matching: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """(key_field, key_value, entries, total_<column>, and what `matching` has) for every value of every field.

    All fields are one set of keys, so the table is read once for the loads' sample and once for the totals.
    `matching` has key_field, key_value (strings) and what is to be known of a key, at most one row a key.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("key_field"), F.col(f).cast("string").alias("key_value")) for f in fields]))
    apart = [c for c in ("id",) if c in df.columns]
    long = df.select(*{*fields, *sums, *apart}).withColumn("_p", pairs).select("_p.key_field", "_p.key_value", *sums, *[F.col(c).alias("_spread") for c in apart])
    return fragment_totals(long, ["key_field", "key_value"], sums, matching, tasks)


def hot_values(df: DataFrame, fields: list[str], share: Fraction = Fraction(1, 20), matching: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """(key_field, key_value, entries, and what `matching` has) of the values that at least `share` of all rows
    hold; null is no value. The driver gets the number of rows, which is that of any one field's entries."""
    totals = materialize(totals_by_field(df, fields, [], matching, tasks), "totals")
    rows = totals.where(F.col("key_field") == fields[0]).agg(F.sum("entries")).first()[0] or 0
    return totals.where(F.col("key_value").isNotNull() & (F.col("entries") * share.denominator >= rows * share.numerator))
