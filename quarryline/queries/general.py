"""Queries of the general data-processing problems, with the SQL each is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.common import read, scratch_path
from quarryline.engine.search import BUILT_IN
from quarryline.operators import hierarchy, skew, snapshot_diff
from quarryline.operators.incremental import ChangeLedger

CHANGE_VALUES = ["size", "modified", "changed"]


def _known_keys(spark: SparkSession, d: str) -> DataFrame:
    """What is known of keys: of volumes their file system, of extensions the kind of file."""
    kinds = [("extension", e, kind) for kind, text in BUILT_IN.items() if text.startswith("ext:") for e in text[4:].split(";")]
    volumes = read(spark, d, "volumes").select(F.lit("volume_id").alias("key_field"), F.col("volume_id").alias("key_value"), F.col("filesystem").alias("about"))
    return volumes.unionByName(spark.createDataFrame(kinds, "key_field string, key_value string, about string"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.hot_values(read(spark, d, "files"), ["extension", "volume_id"], matching=_known_keys(spark, d)).select("key_field", "key_value")


def p2_totals(spark: SparkSession, d: str) -> DataFrame:
    """Entries and total size of every extension and every volume, the latter with their file system."""
    totals = skew.totals_by_field(read(spark, d, "files"), ["extension", "volume_id"], ["size"], _known_keys(spark, d))
    return totals.select("key_field", "key_value", "entries", F.col("total_size").cast("string").alias("total_size"), F.when(F.col("key_field") == "volume_id", F.col("about")).alias("filesystem"))


def p2_joined_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every stored row of files with its volume's mount path, by the row-level join."""
    files = read(spark, d, "files").select("id", "volume_id", "changed_ns", "size")
    return skew.fragment_replicate_join(files, read(spark, d, "volumes").select("volume_id", "path"), ["volume_id"]).select("id", "volume_id", "changed_ns", "size", "path")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.findings(read(spark, d, "files"), read(spark, d, "volumes"))


def p4_paths(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.full_paths(read(spark, d, "files"), read(spark, d, "volumes"))


def p4_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(read(spark, d, "files"), read(spark, d, "volumes"))


class Died(Exception):
    """Ends an attempt in the middle, as the run log says it ended."""


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The run log replayed, run by run: aborted attempts die before they know what is due, failed ones with
    everything written but the manifest; what later runs find must not depend on it."""
    log = read(spark, d, "observations")
    ledger = ChangeLedger(scratch_path(spark, "ledger"), "id", ["changed_ns", "seq"], ["modified", "changed_ns", "content_indexed"])
    for r in read(spark, d, "index_runs").where("delivery IS NOT NULL").orderBy("run_id").collect():

        def at(stage: str, end: str | None = {"ok": None, "failed": "commit"}.get(r["run_state"], "due")) -> None:
            if stage == end:
                raise Died

        try:
            ledger.run(log, r["run_id"], r["delivery"], at)
        except Died:
            pass
    return ledger.due(spark)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_diff.snapshot_changes(read(spark, d, "snapshots"), CHANGE_VALUES)


def p6_values(spark: SparkSession, d: str) -> DataFrame:
    snapshots = read(spark, d, "snapshots")
    return snapshot_diff.change_values(snapshots, snapshot_diff.snapshot_changes(snapshots, CHANGE_VALUES), CHANGE_VALUES)


QUERIES = {f.__name__: f for f in (p2_found, p2_totals, p2_joined_rows, p4_found, p4_paths, p4_descendants, p5_found, p6_found, p6_values)}

_CURRENT = "cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY changed_ns DESC) AS rn FROM files) WHERE rn = 1)"
_TREE = f"""WITH RECURSIVE {_CURRENT},
vol AS (SELECT volume_id, root_file_id, CASE WHEN path = '/' THEN '' ELSE path END AS mount FROM volumes),
down AS (
  SELECT c.id, c.volume_id, c.file_id, c.is_dir, v.mount || '/' || c.name AS full_path, 1 AS depth, c.path, CAST([] AS BIGINT[]) AS above
  FROM cur c JOIN vol v ON c.volume_id = v.volume_id AND c.parent_id = v.root_file_id
  UNION ALL
  SELECT c.id, c.volume_id, c.file_id, c.is_dir, p.full_path || '/' || c.name, p.depth + 1, c.path, list_append(p.above, p.id)
  FROM down p JOIN cur c ON p.is_dir AND c.volume_id = p.volume_id AND c.parent_id = p.file_id
)"""
_PAIRS = """standing AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_no, id ORDER BY delivered_at DESC, size DESC NULLS LAST, modified DESC NULLS LAST, changed DESC NULLS LAST) AS rn FROM snapshots) WHERE rn = 1),
step AS (SELECT snapshot_no, lag(snapshot_no) OVER (ORDER BY snapshot_no) AS before_no FROM (SELECT DISTINCT snapshot_no FROM snapshots)),
new AS (SELECT s.*, t.before_no FROM standing s JOIN step t USING (snapshot_no) WHERE t.before_no IS NOT NULL),
old AS (SELECT s.*, t.snapshot_no AS after_no FROM standing s JOIN step t ON s.snapshot_no = t.before_no),
diff AS (
  SELECT coalesce(n.snapshot_no, o.after_no) AS snapshot_no, coalesce(n.id, o.id) AS id,
    CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' ELSE 'changed' END AS change_kind,
    o.size AS old_size, o.modified AS old_modified, o.changed AS old_changed, n.size AS new_size, n.modified AS new_modified, n.changed AS new_changed
  FROM new n FULL JOIN old o ON n.snapshot_no = o.after_no AND n.id = o.id
  WHERE o.id IS NULL OR n.id IS NULL OR o.size IS DISTINCT FROM n.size OR o.modified IS DISTINCT FROM n.modified OR o.changed IS DISTINCT FROM n.changed)"""

SQL = {
    "p2_found": """SELECT 'extension' AS key_field, extension AS key_value FROM files WHERE extension IS NOT NULL GROUP BY extension HAVING count(*) * 20 >= (SELECT count(*) FROM files)
UNION ALL SELECT 'volume_id', volume_id FROM files WHERE volume_id IS NOT NULL GROUP BY volume_id HAVING count(*) * 20 >= (SELECT count(*) FROM files)""",
    "p2_totals": """SELECT 'extension' AS key_field, extension AS key_value, count(*) AS entries, CAST(sum(size) AS VARCHAR) AS total_size, CAST(NULL AS VARCHAR) AS filesystem FROM files GROUP BY extension
UNION ALL SELECT 'volume_id', f.volume_id, count(*), CAST(sum(f.size) AS VARCHAR), min(v.filesystem) FROM files f LEFT JOIN volumes v ON f.volume_id = v.volume_id GROUP BY f.volume_id""",
    "p2_joined_rows": "SELECT f.id, f.volume_id, f.changed_ns, f.size, v.path FROM files f JOIN volumes v ON f.volume_id = v.volume_id",
    "p4_found": _TREE + """,
folder AS (SELECT DISTINCT volume_id, file_id, parent_id, id FROM cur WHERE is_dir),
up AS (
  SELECT c.id, c.volume_id, c.parent_id AS stop, c.file_id AS own, c.is_dir FROM cur c WHERE c.id NOT IN (SELECT id FROM down)
  UNION
  SELECT u.id, u.volume_id, f.parent_id, u.own, u.is_dir FROM up u JOIN folder f ON u.volume_id = f.volume_id AND u.stop = f.file_id),
ended AS (SELECT DISTINCT u.id FROM up u LEFT JOIN folder f ON u.volume_id = f.volume_id AND u.stop = f.file_id WHERE f.id IS NULL),
looped AS (SELECT id, bool_or(is_dir AND stop = own) AS on_loop FROM up WHERE id NOT IN (SELECT id FROM ended) GROUP BY id)
SELECT id, 'path_mismatch' AS finding FROM down WHERE path IS DISTINCT FROM full_path
UNION ALL SELECT id, 'orphan' FROM ended
UNION ALL SELECT id, CASE WHEN on_loop THEN 'cycle' ELSE 'below_cycle' END FROM looped""",
    "p4_paths": _TREE + " SELECT id, volume_id, full_path, depth FROM down",
    "p4_descendants": _TREE + " SELECT above[i] AS ancestor_id, id AS descendant_id, depth - i AS distance FROM (SELECT id, depth, above, unnest(range(1, depth)) AS i FROM down)",
    "p5_found": """WITH ok AS (SELECT run_id, delivery, lag(delivery) OVER (ORDER BY run_id) AS before FROM index_runs WHERE run_state = 'ok'),
stops AS (SELECT DISTINCT delivery AS d FROM ok),
state AS (
  SELECT d, id, modified, changed_ns, content_indexed FROM (
    SELECT a.d, o.*, row_number() OVER (PARTITION BY a.d, o.id ORDER BY o.changed_ns DESC NULLS LAST, o.seq DESC NULLS LAST) AS rn
    FROM stops a JOIN observations o ON o.delivery <= a.d) WHERE rn = 1)
SELECT ok.run_id, s.id FROM ok JOIN state s ON s.d = ok.delivery LEFT JOIN state b ON b.d = ok.before AND b.id = s.id
WHERE b.id IS NULL OR s.modified IS DISTINCT FROM b.modified OR s.changed_ns IS DISTINCT FROM b.changed_ns OR s.content_indexed IS DISTINCT FROM b.content_indexed""",
    "p6_found": f"WITH {_PAIRS} SELECT snapshot_no, id, change_kind FROM diff",
    "p6_values": f"WITH {_PAIRS} SELECT * FROM diff",
}
