"""What changed between consecutive full snapshots of a table.

Each snapshot's rows shrink to a key and a row hash. They are spread over hash buckets by key, sized so
that a bucket's arrays stay small; in a bucket numpy sorts the keys of each snapshot and finds added,
removed and changed keys by searchsorted. Full values are read again for differing keys only.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.common import shuffle_width

#: Rows (of all snapshots together) of one bucket: some 20 MB of arrays.
BUCKET_ROWS = 400_000


def row_hash(values: list[str]) -> Column:
    """64 bits of `values`; a null is unlike any value and null equals null."""
    return F.xxhash64(*[x for c in values for x in (F.col(c), F.col(c).isNull())])


def standing_rows(snapshots: DataFrame, key: str, no: str, delivered: str, values: list[Column]) -> DataFrame:
    """Of each snapshot and key the row delivered last; of several delivered at once the greatest
    `values`. Rows without a key or a snapshot number are left out. Combined before the shuffle."""
    rows = snapshots.where(F.col(key).isNotNull() & F.col(no).isNotNull()).select(F.col(no).alias("_no"), F.col(key).alias("_key"), F.struct(F.col(delivered).alias("_at"), *values).alias("_r"))
    return rows.groupBy("_no", "_key").agg(F.max("_r").alias("_r")).select("_no", "_key", "_r.*").drop("_at")


def _differ(numbers: list[int]) -> Callable[[pa.Table], pa.Table]:
    """Compares, in one bucket, each of the snapshot `numbers` (ascending) with the one before."""

    def run(bucket: pa.Table) -> pa.Table:
        no, key, mark = (bucket[c].to_numpy() for c in ("_no", "_key", "_hash"))
        order = np.lexsort((key, no))
        no, key, mark = no[order], key[order], mark[order]
        starts, ends = np.searchsorted(no, numbers, "left"), np.searchsorted(no, numbers, "right")
        nos, keys, kinds = [], [], []

        def put(number: int, found: np.ndarray, kind: str) -> None:
            nos.append(np.full(len(found), number, np.int64))
            keys.append(found)
            kinds.extend([kind] * len(found))

        for i in range(1, len(numbers)):
            a, b = slice(starts[i - 1], ends[i - 1]), slice(starts[i], ends[i])
            old, new = key[a], key[b]
            at = np.searchsorted(old, new)
            both = np.zeros(len(new), bool)
            inside = at < len(old)
            both[inside] = old[at[inside]] == new[inside]
            put(numbers[i], new[~both], "added")
            gone = np.ones(len(old), bool)
            gone[at[both]] = False
            put(numbers[i], old[gone], "removed")
            put(numbers[i], new[both][mark[a][at[both]] != mark[b][both]], "changed")
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        return pa.table({"_no": join(nos), "_key": join(keys), "change_kind": pa.array(kinds, pa.string())})

    return run


def snapshot_changes(snapshots: DataFrame, values: list[str], key: str = "id", no: str = "snapshot_no", delivered: str = "delivered_at") -> DataFrame:
    """(no, key, change_kind): added, removed or changed in `values` against the next smaller existing
    snapshot number. The first snapshot yields nothing, nor does an empty table. `key` is an integer.
    Snapshot numbers, one for each delivery of the whole table, are held by the driver."""
    numbers = sorted(r[0] for r in snapshots.select(no).where(F.col(no).isNotNull()).distinct().collect())
    buckets = max(shuffle_width(snapshots.sparkSession), -(-snapshots.count() // BUCKET_ROWS))
    compact = standing_rows(snapshots, key, no, delivered, [F.col(v) for v in values])
    compact = compact.select(F.col("_no").cast("bigint"), F.col("_key").cast("bigint"), row_hash(values).alias("_hash"), F.pmod(F.xxhash64("_key"), F.lit(buckets)).alias("_bucket"))
    found = compact.groupBy("_bucket").applyInArrow(_differ(numbers), "_no bigint, _key bigint, change_kind string")
    return found.select(F.col("_no").cast(snapshots.schema[no].dataType).alias(no), F.col("_key").alias(key), "change_kind")


def change_values(snapshots: DataFrame, changes: DataFrame, values: list[str], key: str = "id", no: str = "snapshot_no", delivered: str = "delivered_at") -> DataFrame:
    """`changes` with old_<value> and new_<value>, read for the differing keys only."""
    numbers = sorted(r[0] for r in snapshots.select(no).where(F.col(no).isNotNull()).distinct().collect())
    before = snapshots.sparkSession.createDataFrame(list(zip(numbers[1:], numbers)), f"{no} int, _before int")
    wanted = changes.join(F.broadcast(before), no)
    rows = snapshots.join(changes.select(key).distinct(), key, "left_semi")
    full = standing_rows(rows, key, no, delivered, [F.col(v) for v in values])
    old = full.select(F.col("_no").alias("_before"), F.col("_key").alias(key), *[F.col(v).alias(f"old_{v}") for v in values])
    new = full.select(F.col("_no").alias(no), F.col("_key").alias(key), *[F.col(v).alias(f"new_{v}") for v in values])
    return wanted.join(old, ["_before", key], "left").join(new, [no, key], "left").drop("_before")
