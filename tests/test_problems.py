"""The general data-processing operators against brute force, with nulls, repeats, ties and empty tables."""

from __future__ import annotations

import random
import shutil
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quarryline.operators import hierarchy, skew, snapshot_diff
from quarryline.operators.incremental import ChangeLedger

# --- skew


def skewed(spark, n=3000):
    rnd = random.Random(3)
    keys = [None if rnd.random() < 0.05 else "hot" if rnd.random() < 0.4 else f"k{int(rnd.expovariate(0.05))}" for _ in range(n)]
    rows = [(i % (n - 10), k, rnd.choice([None, 1, 5, 2**62])) for i, k in enumerate(keys)]
    return rows, spark.createDataFrame(rows, "id bigint, key string, size bigint")


def test_packing_balances():
    where, total = skew.pack([50, 10, 10, 10, 10, 10], 2)
    assert sorted(total) == [50, 50] and len(where) == 6


def test_plan_splits_only_heavy_keys(spark):
    rows, df = skewed(spark)
    plan = skew.plan_by_load(df, ["key"], 8, sample=1)
    heavy = {r["_k0"]: r["_tasks"] for r in plan.heavy.collect()}
    assert len(heavy["hot"]) > 4 and set(heavy["hot"]) == set(range(8))
    assert max(plan.task_loads) < 1.5 * len(rows) / 8
    sizes = Counter(r["_task"] for r in plan.scatter(df).select("_task").collect())
    assert max(sizes.values()) < 2 * len(rows) / 8
    copies = plan.replicate(spark.createDataFrame([("hot", 1), ("k1", 2), ("other", 3)], "key string, v int")).groupBy("key").count().collect()
    assert {r.key: r["count"] for r in copies} == {"hot": 8, "k1": 1, "other": 1}


def test_plan_from_a_sample(spark):
    """Loads are estimated from some of the rows; the plan stays a few small tables and the rows stay balanced."""
    df = spark.range(40_000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 997)).alias("key"))
    plan = skew.plan_by_load(df, ["key"], 12)
    assert plan.light.count() == 12 * skew.BINS_PER_TASK and plan.heavy.count() <= 12 / skew.HEAVY_SHARE
    sizes = Counter(r["_task"] for r in plan.scatter(df).select("_task").collect())
    assert sum(sizes.values()) == 40_000 and max(sizes.values()) < 1.6 * 40_000 / 12


def test_totals_of_several_fields(spark):
    rows, df = skewed(spark)
    known = spark.createDataFrame([("key", "hot", "H"), ("size", "5", "five")], "key_field string, key_value string, about string")
    got = {(r.key_field, r.key_value): (r.entries, r.about) for r in skew.totals_by_field(df, ["key", "size"], [], known, tasks=5).collect()}
    want = Counter(("key", k) for _, k, _ in rows) + Counter(("size", None if s is None else str(s)) for *_, s in rows)
    about = {("key", "hot"): "H", ("size", "5"): "five"}
    assert got == {k: (n, about.get(k)) for k, n in want.items()}


def test_totals(spark):
    rows, df = skewed(spark)
    match = spark.createDataFrame([("hot", "H"), ("k1", "one"), (None, "none")], "key string, label string")
    got = {r.key: (r.entries, r.total_size, r.label) for r in skew.fragment_totals(df, ["key"], ["size"], match, tasks=5).collect()}
    want = defaultdict(lambda: [0, None])
    for _, k, s in rows:
        want[k][0] += 1
        want[k][1] = want[k][1] if s is None else (want[k][1] or 0) + s
    assert got == {k: (n, s, {"hot": "H", "k1": "one"}.get(k)) for k, (n, s) in want.items()}
    assert skew.fragment_totals(df.limit(0), ["key"], ["size"]).collect() == []


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_join(spark, how):
    rows, df = skewed(spark, 600)
    right = spark.createDataFrame([("hot", 7, 1), ("hot", 8, 2), ("k1", 9, 3), (None, 1, 4), ("zz", 1, 5)], "key string, size bigint, w int")
    got = skew.fragment_replicate_join(df, right, ["key"], how, tasks=4)
    want = df.join(right.withColumnRenamed("size", "size_right"), "key", how)
    assert sorted(got.columns) == sorted(want.columns)
    assert Counter(map(tuple, got.select(want.columns).collect())) == Counter(map(tuple, want.collect()))


def test_hot_values(spark):
    rows, df = skewed(spark)
    got = {(r.key_field, r.key_value) for r in skew.hot_values(df, ["key"]).collect()}
    n = Counter(k for _, k, _ in rows if k is not None)
    assert got == {("key", k) for k, c in n.items() if c * 20 >= len(rows)}
    assert skew.hot_values(df.limit(0), ["key"]).collect() == []


# --- hierarchy

FILES = "id bigint, path string, name string, changed_ns bigint, is_dir boolean, file_id bigint, parent_id bigint, volume_id string, finding string"
VOLUMES = [("v", "/", 2), ("w", "/mnt/w", 2)]


def tree_rows(seed):
    """Random trees with loops, orphans, hard links, wrong paths, older observations and nulls."""
    rnd = random.Random(seed)
    rows, number = [], iter(range(1, 10**6))
    for vol, mount, root in VOLUMES:
        base = "" if mount == "/" else mount
        known = [(root, base)]
        for k in range(60):
            # every fourth folder goes to the deepest place
            pid, pp = known[-1] if k % 4 == 0 else rnd.choice(known)
            name, fid = f"d{k}", 100 + k
            known.append((fid, f"{pp}/{name}"))
            rows.append([next(number), f"{pp}/{name}", name, 5, True, fid, pid, vol])
        for k in range(80):
            pid, pp = rnd.choice(known)
            name = rnd.choice(["a.txt", "b", f"f{k}"])
            rows.append([next(number), f"{pp}/{name}" if rnd.random() < 0.8 else f"/wrong{pp}/{name}", name, 5, False, 1000 + k // 2, pid, vol])
        loop = [500, 501, 502]
        for i, f in enumerate(loop):
            rows.append([next(number), f"{base}/l{f}", f"l{f}", 5, True, f, loop[i - 1], vol])
        rows.append([next(number), f"{base}/self", "self", 5, True, 510, 510, vol])
        rows.append([next(number), f"{base}/x", "x", 5, True, 520, 501, vol])
        rows.append([next(number), f"{base}/y", "y", 5, False, 521, 520, vol])
        rows.append([next(number), f"{base}/self/z", "z", 5, False, 522, 510, vol])
        rows.append([next(number), f"{base}/o", "o", 5, True, 530, 999999, vol])
        rows.append([next(number), f"{base}/o/p", "p", 5, False, 531, 530, vol])
        rows.append([next(number), f"{base}/q", "q", 5, False, 532, None, vol])
        rows.append([next(number), None, "n", 5, False, 533, root, vol])
        rows.append([next(number), f"{base}/nn", None, 5, True, 534, root, vol])
        rows.append([next(number), f"{base}/nn/c", "c", 5, False, 535, 534, vol])
    rows.append([next(number), "/u", "u", 5, True, 7, 2, "unknown"])
    rows.append([next(number), "/u", "u", 5, None, 8, 2, None])
    old = [[*r[:1], "/old", "old", 1, not r[4] if r[4] is not None else None, r[5], 999, r[7]] for r in rows[::5]]
    rows += [list(r) for r in rows[::7]] + old
    rnd.shuffle(rows)
    return [tuple([*r, "x"]) for r in rows]


def brute(rows):
    cur = {}
    for r in rows:
        if r[0] not in cur or (r[3] or 0) > cur[r[0]][3]:
            cur[r[0]] = r
    vols = {v: ("" if m == "/" else m, root) for v, m, root in VOLUMES}
    folder = {}
    for r in sorted(cur.values()):
        if r[4]:
            folder.setdefault((r[7], r[5]), r)
    found, paths, kids = {}, {}, set()
    for r in cur.values():
        chain, at, seen, end = [r], r, {r[0]}, None
        while end is None:
            vol = at[7]
            if vol in vols and at[6] == vols[vol][1]:
                end = "root"
            elif (up := folder.get((vol, at[6]))) is None:
                end = "orphan"
            elif up[0] == r[0] and r[4]:
                end = "cycle"
            elif up[0] in seen:
                end = "below_cycle"
            else:
                seen.add(up[0])
                chain.append(up)
                at = up
        if end == "root":
            names = [c[2] for c in reversed(chain)]
            path = None if None in names else "/".join([vols[r[7]][0], *names])
            paths[r[0]] = (path, len(chain))
            kids |= {(c[0], r[0], i + 1) for i, c in enumerate(chain[1:])}
            if path is None or path != r[1]:
                found[r[0]] = "path_mismatch"
        else:
            found[r[0]] = end
    return found, paths, kids


def test_hierarchy(spark):
    rows = tree_rows(5)
    files = spark.createDataFrame(rows, FILES)
    volumes = spark.createDataFrame(VOLUMES, "volume_id string, path string, root_file_id bigint")
    found, paths, kids = brute(rows)
    entries = hierarchy.prepare(files, with_names=True)
    folders = hierarchy.walk(entries, volumes, ("path", "digest"))
    placed = hierarchy.place(entries, folders, volumes)
    assert {r.id: r.finding for r in placed.where("finding IS NOT NULL").collect()} == found
    assert {r.id: (None if r.parent_path is None or r.name is None else f"{r.parent_path}/{r.name}", r.depth) for r in placed.where("depth IS NOT NULL").collect()} == paths
    assert {r.id: r.finding for r in hierarchy.findings(files, volumes).collect()} == found
    assert {r.id: (r.full_path, r.depth) for r in hierarchy.full_paths(files, volumes).collect()} == paths
    assert {(r.ancestor_id, r.descendant_id, r.distance) for r in hierarchy.descendants(files, volumes).collect()} == kids


def test_hot_folder_is_split(spark, monkeypatch):
    monkeypatch.setattr(hierarchy, "HOT_ROWS", 3)
    rows = tree_rows(6)
    volumes = spark.createDataFrame(VOLUMES, "volume_id string, path string, root_file_id bigint")
    files = spark.createDataFrame(rows, FILES)
    assert {r.id: r.finding for r in hierarchy.findings(files, volumes).collect()} == brute(rows)[0]
    assert {r.id: (r.full_path, r.depth) for r in hierarchy.full_paths(files, volumes).collect()} == brute(rows)[1]


def test_long_chain_and_long_loop(spark):
    """A chain of 20,000 folders, a loop of 3,000 with a tail of 5,000 below it: log of the length joins, no text."""
    n = 20_000
    chain = spark.range(n).select(F.col("id"), F.lit("x").alias("path"), F.concat(F.lit("d"), "id").alias("name"), F.lit(1).cast("bigint").alias("changed_ns"), F.lit(True).alias("is_dir"), (F.col("id") + 10).alias("file_id"), F.when(F.col("id") == 0, 2).otherwise(F.col("id") + 9).alias("parent_id"), F.lit("v").alias("volume_id"), F.lit("").alias("finding"))
    up = F.when(F.col("id") == 0, 2999).when(F.col("id") == 3000, 7).otherwise(F.col("id") - 1)
    loop = spark.range(8000).select((F.col("id") + n).alias("id"), F.lit("x").alias("path"), F.concat(F.lit("l"), "id").alias("name"), F.lit(1).cast("bigint").alias("changed_ns"), F.lit(True).alias("is_dir"), F.col("id").alias("file_id"), up.alias("parent_id"), F.lit("w").alias("volume_id"), F.lit("").alias("finding"))
    # The number of a volume's root lies outside the loop here.
    volumes = spark.createDataFrame([("v", "/", 2), ("w", "/mnt/w", 10**9)], "volume_id string, path string, root_file_id bigint")
    got = Counter(r.finding for r in hierarchy.findings(chain.unionByName(loop), volumes).collect())
    assert got == {"path_mismatch": n, "cycle": 3000, "below_cycle": 5000}


@pytest.mark.parametrize(
    ("rows", "found"),
    [
        ([(1, "/a", "a", False, 5, 2)], {}),
        ([(1, "/a", "a", True, 5, 2)], {}),
        ([(1, "/a", "a", True, 5, 2), (2, "/a/b", "b", True, 6, 5), (3, "/x/c", "c", False, 7, 6)], {3: "path_mismatch"}),
        ([(1, "/a", "a", True, 5, 6), (2, "/b", "b", True, 6, 5)], {1: "cycle", 2: "cycle"}),
        ([(1, "/a", "a", True, 5, 99)], {1: "orphan"}),
    ],
)
def test_small_trees(spark, rows, found):
    """Fewer levels than are settled one by one, nothing below the first, nothing but loops."""
    files = spark.createDataFrame([(i, p, n, 1, d, f, up, "v", "") for i, p, n, d, f, up in rows], FILES)
    volumes = spark.createDataFrame(VOLUMES, "volume_id string, path string, root_file_id bigint")
    assert {r.id: r.finding for r in hierarchy.findings(files, volumes).collect()} == found


def test_no_files(spark):
    volumes = spark.createDataFrame(VOLUMES, "volume_id string, path string, root_file_id bigint")
    assert hierarchy.findings(spark.createDataFrame([], FILES), volumes).collect() == []


# --- processing by run

LOG = "seq bigint, delivery int, id bigint, changed_ns bigint, modified bigint, content_indexed boolean, run_id string"
RUNS = "run_id bigint, delivery int, run_state string"


def log_rows(seed):
    rnd = random.Random(seed)
    rows = []
    for seq in range(600):
        i = rnd.choice([None, 7, 7, 7, *range(60)])
        rows.append((seq, rnd.choice([None, *range(1, 9)]), i, rnd.choice([0, 0, 1, 2, 3, None]), rnd.choice([None, 1, 2]), rnd.choice([None, True, False]), "x"))
    return rows + rows[::9]


def due(rows, runs):
    def state(d):
        best = {}
        for r in rows:
            if r[2] is not None and r[1] is not None and r[1] <= d:
                k = (r[3] is not None, r[3] or 0, r[0])
                if r[2] not in best or k > best[r[2]][0]:
                    best[r[2]] = (k, (r[4], r[3], r[5]))
        return {i: s for i, (_, s) in best.items()}

    out, before = set(), {}
    for run, d, _ in sorted(r for r in runs if r[2] == "ok"):
        now = state(d)
        out |= {(run, i) for i, s in now.items() if i not in before or before[i] != s}
        before = now
    return out


def ledger(path, **more):
    return ChangeLedger(path, "id", ["changed_ns", "seq"], ["modified", "changed_ns", "content_indexed"], **({"buckets": 4} | more))


def found(spark, book):
    return {(r.run_id, r.id) for r in book.due(spark).collect()}


@pytest.mark.parametrize(
    "runs",
    [
        [(1, 1, "ok"), (2, 2, "failed"), (3, 3, "ok"), (4, 3, "ok"), (5, 6, "aborted"), (6, 7, "ok")],
        [(1, 4, "ok"), (2, 2, "ok"), (3, 8, "ok"), (4, 5, "ok")],
        [(1, 4, "failed")],
    ],
)
@pytest.mark.parametrize("merge_after", [2, 100])
def test_runs(spark, tmp_path, runs, merge_after):
    rows = log_rows(1)
    book = ledger(str(tmp_path / "l"), merge_after=merge_after)
    book.catch_up(spark.createDataFrame(rows, LOG), spark.createDataFrame(runs, RUNS))
    assert found(spark, book) == due(rows, runs)


class Crash(Exception):
    pass


def test_runs_one_by_one_with_crashes(spark, tmp_path):
    """Attempts die at every stage, one with half of its partitions written; what later runs find is the same."""
    rows = log_rows(2)
    runs = [(1, 2, "ok"), (2, 4, "failed"), (3, 5, "ok"), (4, 6, "aborted"), (5, 8, "ok")]
    book, log = ledger(str(tmp_path / "l")), spark.createDataFrame(rows, LOG)

    def dies(where):
        def at(stage):
            if stage == where:
                raise Crash

        return at

    for run, delivery, state in runs:
        for stage in ("due", "commit"):
            with pytest.raises(Crash):
                book.run(log, run, delivery, dies(stage))
        written = sorted((tmp_path / "l" / "newest").glob("_d=*/_b=*"))
        for lost in [p for p in written if int(p.parent.name[3:]) == delivery][::2]:
            shutil.rmtree(lost)
        assert found(spark, book) == due(rows, [r for r in runs if r[0] < run])
        if state == "ok":
            assert {d for d, _ in book.run(log, run, delivery)} == {delivery}
            assert book.run(log, run, delivery) == []
    assert found(spark, book) == due(rows, runs)


def test_a_small_delivery_recomputes_a_small_part(spark, tmp_path):
    rows = [(i, 1 + i // 100, i % 90, 1, 1, True, "x") for i in range(400)]
    book = ledger(str(tmp_path / "l"))
    book.catch_up(spark.createDataFrame(rows, LOG), spark.createDataFrame([(1, 4, "ok")], RUNS))
    files = lambda: {str(p): p.stat().st_mtime_ns for p in (tmp_path / "l" / "newest").rglob("*.parquet")}
    before = files()
    late = rows + [(500, 5, 3, 9, 9, True, "x")]
    replaced = book.run(spark.createDataFrame(late, LOG), 2, 5)
    assert len(replaced) == 1 and replaced[0][0] == 5
    assert before.items() <= files().items() and len(files()) == len(before) + 1
    assert {x for x in found(spark, book) if x[0] == 2} == {(2, 3)}


def test_audit_finds_what_was_altered(spark, tmp_path):
    rows = log_rows(3)
    runs = [(1, 2, "ok"), (2, 5, "ok"), (3, 8, "ok")]
    book, log = ledger(str(tmp_path / "l"), merge_after=3), spark.createDataFrame(rows, LOG)
    book.catch_up(log, spark.createDataFrame(runs, RUNS))
    assert book.audit(log) == []
    # A row appears in an old delivery, and all rows of one partition are gone.
    bucket = {r.id: r.b for r in log.select("id", F.pmod(F.xxhash64("id"), F.lit(4)).alias("b")).distinct().collect()}
    other = [r for r in rows if not (r[1] == 3 and r[2] is not None and bucket[r[2]] == 2)] + [(9999, 4, 7, 9, 9, True, "x")]
    replaced = book.audit(spark.createDataFrame(other, LOG))
    assert set(replaced) == {(3, 2), (4, bucket[7])}
    assert found(spark, book) == due(other, runs)


def test_empty_log(spark, tmp_path):
    book = ledger(str(tmp_path / "l"))
    assert book.catch_up(spark.createDataFrame([], LOG), spark.createDataFrame([(1, 1, "ok")], RUNS)) == []
    assert book.due(spark).collect() == []


# --- snapshots

SNAPS = "snapshot_no int, delivered_at bigint, id bigint, path string, size bigint, modified bigint, changed bigint, _key string"


def snap_rows(seed):
    rnd = random.Random(seed)
    rows = []
    for no in (1, 2, 5, 9):
        for i in [None, *range(80)]:
            for _ in range(rnd.choice([0, 1, 1, 1, 2, 3])):
                rows.append((no, rnd.choice([1, 2, 3]), i, f"/p{rnd.random()}", rnd.choice([None, 0, 1]), rnd.choice([None, 5]), rnd.choice([0, None]), "x"))
    rows += rows[::6] + [(None, 1, 5, "/", 1, 1, 1, "x")]
    rnd.shuffle(rows)
    return rows


def test_snapshots(spark):
    rows = snap_rows(4)
    low = lambda v: (v is not None, v or 0)
    stand = {}
    for r in rows:
        if r[0] is not None and r[2] is not None:
            k = (r[1], low(r[4]), low(r[5]), low(r[6]))
            if k >= stand.get((r[0], r[2]), (k,))[0]:
                stand[r[0], r[2]] = (k, r[4:7])
    want = {}
    for a, b in ((1, 2), (2, 5), (5, 9)):
        for i in range(80):
            x, y = stand.get((a, i)), stand.get((b, i))
            if x and not y:
                want[b, i] = "removed"
            elif y and not x:
                want[b, i] = "added"
            elif x and y and x[1] != y[1]:
                want[b, i] = "changed"
    df = spark.createDataFrame(rows, SNAPS)
    values = ["size", "modified", "changed"]
    found = snapshot_diff.snapshot_changes(df, values)
    assert {(r.snapshot_no, r.id): r.change_kind for r in found.collect()} == want
    full = snapshot_diff.change_values(df, found, values).collect()
    before = {2: 1, 5: 2, 9: 5}
    for r in full:
        old, new = stand.get((before[r.snapshot_no], r.id)), stand.get((r.snapshot_no, r.id))
        assert (r.old_size, r.old_modified, r.old_changed) == (old[1] if old else (None,) * 3)
        assert (r.new_size, r.new_modified, r.new_changed) == (new[1] if new else (None,) * 3)


def test_many_buckets_and_no_rows(spark, monkeypatch):
    monkeypatch.setattr(snapshot_diff, "BUCKET_ROWS", 50)
    df = spark.createDataFrame(snap_rows(5), SNAPS)
    few = snapshot_diff.snapshot_changes(df, ["size"]).collect()
    monkeypatch.setattr(snapshot_diff, "BUCKET_ROWS", 10**6)
    assert Counter(map(tuple, few)) == Counter(map(tuple, snapshot_diff.snapshot_changes(df, ["size"]).collect()))
    assert snapshot_diff.snapshot_changes(df.limit(0), ["size"]).collect() == []
