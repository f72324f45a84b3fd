"""Parent-child links to full hierarchies: paths, depths, roots, descendants, cycles.

Only folders take part in the walk; every other entry hangs below a folder and is joined once, at the end.
Level-wise frontier joins from the roots (and from the tops of chains whose parent is missing) settle the
upper levels. Below them every folder learns the run of names up to an ancestor, and the frontier then
advances over such runs: the run is twice as long in every round, so a chain of n levels takes log n joins,
all of them distributed. A round that settles nothing leaves exactly the folders on and below loops; the
ancestors they still reach shrink to the loops themselves, which tells the two apart.

What a run carries is chosen by the caller. Findings need a digest only, of fixed width and composable
(digest of a path = digest of the upper part * weight of the lower part + digest of the lower part), so even
a chain of many thousand levels moves no path text. Every join splits parents of very many children.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quarryline.common import current_rows, materialize, shuffle_width

#: Levels settled one by one, all in one query.
LEVELS = 4
#: A parent's children are split from this part of a task's fair share on, and from this many rows on.
HOT_SHARE, HOT_ROWS = 0.25, 1000
REACHED, ORPHAN, CYCLE, BELOW = "reached", "orphan", "cycle", "below_cycle"
#: Moduli and bases of the two halves of a path digest; products of two residues fit into 64 bits.
_HALVES = ((2147483647, 1181783497), (2147483629, 1540483477))


def path_digest(text: Column, half: int) -> Column:
    """Of the parts of `text` between its slashes; null of null."""
    p, b = _HALVES[half]
    return F.aggregate(F.split(text, "/", -1), F.lit(0).cast("bigint"), lambda acc, x: (acc * b + F.pmod(F.xxhash64(F.lit(half), x), F.lit(p))) % p)


def path_weight(text: Column, half: int) -> Column:
    p, b = _HALVES[half]
    return F.aggregate(F.split(text, "/", -1), F.lit(1).cast("bigint"), lambda acc, _: (acc * b) % p)


class _Path:
    """The path as text; a run is its names joined by '/'."""

    top = {"path": lambda: F.concat("mount", F.lit("/"), "name")}
    root = {"path": lambda mount: mount}
    run = {"s_path": lambda: F.col("name")}
    settle = {"path": lambda p, c: F.concat(p["path"], F.lit("/"), c["s_path"])}
    extend = {"s_path": lambda p, c: F.concat(p["s_path"], F.lit("/"), c["s_path"])}


class _Digest:
    """Two residues for the path, and for a run the weights of its parts beside them."""

    @staticmethod
    def _below(high: Column, low: Column, weight: Column, i: int) -> Column:
        return (high * weight + low) % _HALVES[i][0]

    top = {f"d{i}": lambda i=i: _Digest._below(path_digest(F.col("mount"), i), path_digest(F.col("name"), i), path_weight(F.col("name"), i), i) for i in (0, 1)}
    root = {f"d{i}": lambda mount, i=i: path_digest(mount, i) for i in (0, 1)}
    run = {f"s_d{i}": lambda i=i: path_digest(F.col("name"), i) for i in (0, 1)} | {f"s_w{i}": lambda i=i: path_weight(F.col("name"), i) for i in (0, 1)}
    settle = {f"d{i}": lambda p, c, i=i: _Digest._below(p[f"d{i}"], c[f"s_d{i}"], c[f"s_w{i}"], i) for i in (0, 1)}
    extend = {f"s_d{i}": lambda p, c, i=i: _Digest._below(p[f"s_d{i}"], c[f"s_d{i}"], c[f"s_w{i}"], i) for i in (0, 1)} | {f"s_w{i}": lambda p, c, i=i: p[f"s_w{i}"] * c[f"s_w{i}"] % _HALVES[i][0] for i in (0, 1)}


class _Ancestors:
    """Ids of the folders above, topmost first; a run has those between its two ends."""

    _none = staticmethod(lambda: F.array().cast("array<bigint>"))
    top = {"ancestors": _none}
    root = {"ancestors": lambda mount: F.array().cast("array<bigint>")}
    run = {"s_between": _none}
    settle = {"ancestors": lambda p, c: F.concat(p["ancestors"], F.array(p["id"]), c["s_between"])}
    extend = {"s_between": lambda p, c: F.concat(p["s_between"], F.array(p["id"]), c["s_between"])}


_CARRIES = {"path": _Path, "digest": _Digest, "ancestors": _Ancestors}


class _Load:
    """What the walk carries along."""

    def __init__(self, names: tuple[str, ...]):
        self.kinds = [_CARRIES[n] for n in names]
        self.settled = [c for k in self.kinds for c in k.settle]
        self.runs = [c for k in self.kinds for c in k.run]

    def top(self, sound: Column) -> list[Column]:
        return [F.when(sound, f()).alias(c) for k in self.kinds for c, f in k.top.items()]

    def root(self, mount: Column) -> list[Column]:
        return [f(mount).alias(c) for k in self.kinds for c, f in k.root.items()]

    def run(self) -> list[Column]:
        return [f().alias(c) for k in self.kinds for c, f in k.run.items()]

    def settle(self, p: DataFrame, c: DataFrame) -> dict[str, Column]:
        return {n: f(p, c) for k in self.kinds for n, f in k.settle.items()}

    def extend(self, p: DataFrame, c: DataFrame) -> dict[str, Column]:
        return {n: f(p, c) for k in self.kinds for n, f in k.extend.items()}


def _shards(rows: DataFrame, key: str, count: int, width: int) -> DataFrame | None:
    """(volume_id, _key, shards) of `key`s with very many rows: at most width / HOT_SHARE of them. None if so
    few rows are there that no key can have enough."""
    limit = max(HOT_ROWS, int(count / width * HOT_SHARE))
    if count <= limit:
        return None
    counts = rows.groupBy("volume_id", F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    return counts.where(F.col("_n") > limit).select("volume_id", "_key", F.ceil(F.col("_n") / limit).cast("int").alias("shards"))


def split_join(kids: DataFrame, key: str, parents: DataFrame, count: int, how: str = "inner") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Joins `kids` (`count` rows) with `parents` on volume_id and `key` = file_id. Kids of a hot key are spread over
    shards by id and its parent row, one a key, is copied to each. Returns the join and both sides' columns."""
    shards = _shards(kids, key, count, shuffle_width(kids.sparkSession))
    if shards is None:
        k, p = kids.alias("k"), parents.alias("p")
        return k.join(p, (F.col("k.volume_id") == F.col("p.volume_id")) & (F.col(f"k.{key}") == F.col("p.file_id")), how), _Side("k"), _Side("p")
    hot = F.broadcast(shards)
    k = kids.join(hot.withColumnRenamed("_key", key), ["volume_id", key], "left").withColumn("_salt", F.when(F.col("shards").isNull(), 0).otherwise(F.pmod(F.xxhash64("id"), F.col("shards"))).cast("int")).drop("shards").alias("k")
    p = parents.join(hot.withColumnRenamed("_key", "file_id"), ["volume_id", "file_id"], "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("shards"), F.lit(1)) - 1))).drop("shards").alias("p")
    on = (F.col("k.volume_id") == F.col("p.volume_id")) & (F.col(f"k.{key}") == F.col("p.file_id")) & (F.col("k._salt") == F.col("p._salt"))
    return k.join(p, on, how), _Side("k"), _Side("p")


class _Side:
    """Columns of one side of a join, by name."""

    def __init__(self, alias: str):
        self.alias = alias

    def __getitem__(self, name: str) -> Column:
        return F.col(f"{self.alias}.{name}")


def prepare(files: DataFrame, with_names: bool = False) -> DataFrame:
    """Current rows as the walk needs them, written once.

    Instead of its path each row carries the digest of what stands in it before '/' and its name (null if it
    doesn't end so); compared with the digest of the parent's rebuilt path this decides whether the two agree,
    without moving the paths. Names are kept for folders, or for all rows if asked.
    """
    path, name = F.col("path"), F.col("name")
    ends = F.coalesce(path.endswith(F.concat(F.lit("/"), name)), F.lit(False))
    before = F.when(ends, F.substring(path, F.lit(1), F.length(path) - F.length(name) - 1))
    is_dir = F.coalesce(F.col("is_dir"), F.lit(False))
    kept = name if with_names else F.when(is_dir, name)
    rows = current_rows(files, ["volume_id", "file_id", "parent_id", is_dir.alias("is_dir"), kept.alias("name"), before.alias("before")])
    return materialize(rows.select("id", "volume_id", "file_id", "parent_id", "is_dir", "name", path_digest(F.col("before"), 0).alias("before0"), path_digest(F.col("before"), 1).alias("before1")), "entries")


def _mounts(volumes: DataFrame) -> DataFrame:
    """(volume_id, root_file_id, mount), one row a volume; of a volume named twice the least path counts."""
    return volumes.where("volume_id IS NOT NULL").groupBy("volume_id").agg(F.min(F.struct("path", "root_file_id")).alias("r")).select("volume_id", F.col("r.root_file_id").alias("root_file_id"), F.when(F.col("r.path") == "/", "").otherwise(F.col("r.path")).alias("mount"))


def walk(entries: DataFrame, volumes: DataFrame, carry: tuple[str, ...] = ("digest",)) -> DataFrame:
    """All folders: (volume_id, file_id, parent_id, id, state, depth, and by `carry` path, d0 and d1, ancestors).

    `entries` are rows of `prepare`. Two folder rows with one file_id on one volume count as one folder,
    that of the smaller id. All but the state is null unless the root is reached; depth is 1 directly below
    a root. `ancestors` has the ids of the folders above, topmost first.
    """
    load = _Load(carry)
    cols = ["volume_id", "file_id", "parent_id", "id", "state", "depth", *load.settled]
    folders = entries.where("is_dir").groupBy("volume_id", "file_id").agg(F.min(F.struct("id", "parent_id", "name")).alias("r")).select("volume_id", "file_id", "r.*")
    # Where a folder has the number of its volume's root, the root comes first.
    linked = folders.join(_mounts(volumes), "volume_id", "left").withColumn("at_root", F.coalesce(F.col("parent_id") == F.col("root_file_id"), F.lit(False)))
    total = entries.where("is_dir").count()
    j, k, p = split_join(linked, "parent_id", folders.select("volume_id", "file_id", F.lit(True).alias("is_there")), total, "left")
    linked = materialize(j.select(*[k[c] for c in ("volume_id", "file_id", "parent_id", "id", "name", "mount", "at_root")], (~k["at_root"] & p["is_there"].isNotNull()).alias("hangs")), "folders")

    sound = F.col("at_root")
    level = linked.where("NOT hangs").select("volume_id", "file_id", "parent_id", "id", F.when(sound, REACHED).otherwise(ORPHAN).alias("state"), F.when(sound, 1).alias("depth"), *load.top(sound))
    edges = linked.where("hangs").select("volume_id", "file_id", "parent_id", "id", *load.run())
    levels = [level.withColumn("_level", F.lit(1))]
    for n in range(2, LEVELS + 1):
        j, k, p = split_join(edges, "parent_id", level, total)
        more = load.settle(p, k)
        level = j.select(*[k[c] for c in ("volume_id", "file_id", "parent_id", "id")], p["state"].alias("state"), (p["depth"] + 1).alias("depth"), *[more[c].alias(c) for c in load.settled])
        levels.append(level.withColumn("_level", F.lit(n)))
    upper = materialize(reduce(DataFrame.unionAll, levels), "levels")
    frontier = upper.where(F.col("_level") == LEVELS).select(cols)
    seen = Observation()
    rest = materialize(edges.join(upper.select("id"), "id", "left_anti").select(edges.columns).observe(seen, F.count(F.lit(1)).alias("n")), "rest")
    count = seen.get["n"]

    def runs_of(rows: DataFrame, what: _Load) -> DataFrame:
        return rows.select("volume_id", "file_id", "parent_id", "id", F.col("parent_id").alias("to"), F.lit(1).alias("len"), *what.runs)

    if set(carry) <= {"digest"}:
        done, loose = _strides(runs_of(rest, load), count, frontier, load)
    else:
        # Text and lists would grow without end on a loop, so loops are told first, by numbers alone.
        bare = _Load(())
        _, loose = _strides(runs_of(rest, bare), count, frontier, bare)
        done, _ = _strides(runs_of(rest.join(loose.select("id"), "id", "left_anti"), load), count - loose.count(), frontier, load)
    parts = [upper.select(cols), *[d.select(cols) for d in done]]
    blank = [F.lit(None).cast(upper.schema[c].dataType).alias(c) for c in ("depth", *load.settled)]
    return reduce(DataFrame.unionAll, [*parts, _loops(loose).select("volume_id", "file_id", "parent_id", "id", "state", *blank)])


def _strides(rest: DataFrame, count: int, frontier: DataFrame, load: _Load) -> tuple[list[DataFrame], DataFrame]:
    """Settles `rest`, so many folders, from `frontier`, the last level above it, by runs that double; returns what was settled
    and the folders that hang from no top. A folder's run ends (`to`) at a settled folder or at one of rest."""
    ids = ["volume_id", "file_id", "parent_id", "id"]
    done: list[DataFrame] = []
    while count:
        known = reduce(DataFrame.unionAll, [frontier.select(*ids, "state", "depth", *load.settled), *[d.select(*ids, "state", "depth", *load.settled) for d in done]])
        ends = known.unionByName(rest.select(*ids, "to", "len", *load.runs), allowMissingColumns=True)
        j, k, p = split_join(rest, "to", ends, count)
        settled, longer = load.settle(p, k), load.extend(p, k)
        on = p["state"].isNotNull()
        out = j.select(
            *[k[c] for c in ids], p["state"].alias("state"), F.when(on, p["depth"] + k["len"]).alias("depth"), *[F.when(on, settled[c]).alias(c) for c in load.settled],
            p["to"].alias("to"), F.when(~on, p["len"] + k["len"]).alias("len"), *[F.when(~on, longer[c]).alias(c) for c in load.runs])
        seen = Observation()  # counted by the write itself
        out = materialize(out.observe(seen, F.count_if(F.col("state").isNull()).alias("left")), "strides")
        left = seen.get["left"]
        if left == count:
            return done, out.select(*ids, "to")
        done.append(out.where("state IS NOT NULL"))
        rest, count = out.where("state IS NULL").select(*ids, "to", "len", *load.runs), left
    return done, rest.select(*ids, "to")


def _loops(loose: DataFrame) -> DataFrame:
    """Tells folders on loops from those below. `to` maps the folders into themselves; composed with itself the map
    reaches fewer and fewer of them, and as soon as twice the steps reach as many, exactly those of loops."""
    count = loose.count()
    jump = loose.select("volume_id", "file_id", "id", "to")
    reach = jump.select("volume_id", "to").distinct()
    stood = reach.count() if count else 0
    while count:
        j, k, p = split_join(jump, "to", jump.select("volume_id", "file_id", F.col("to").alias("next")), count)
        jump = materialize(j.select(k["volume_id"].alias("volume_id"), k["file_id"].alias("file_id"), k["id"].alias("id"), p["next"].alias("to")), "jumps")
        reach = jump.select("volume_id", "to").distinct()
        stood, before = reach.count(), stood
        if stood == before:
            break
    on = reach.select("volume_id", F.col("to").alias("file_id"), F.lit(CYCLE).alias("on"))
    return loose.join(on, ["volume_id", "file_id"], "left").withColumn("state", F.coalesce("on", F.lit(BELOW))).drop("on")


def place(entries: DataFrame, folders: DataFrame, volumes: DataFrame) -> DataFrame:
    """Every entry with `finding`, `depth` and, by what the walk carried, `parent_path` and `ancestors`.

    Findings: null (sound), cycle, below_cycle, orphan and, if digests were carried, path_mismatch. A volume
    that is unknown has no root, so its entries are orphans or on loops; a null parent or path makes an orphan
    or a mismatch.
    """
    load = _Load(tuple(n for n, c in (("path", "path"), ("digest", "d0"), ("ancestors", "ancestors")) if c in folders.columns))
    # The root of a volume is a parent like any folder, and comes before a folder that has its number.
    roots = _mounts(volumes).select("volume_id", F.col("root_file_id").alias("file_id"), F.lit(None).cast("bigint").alias("p_id"), F.lit(REACHED).alias("p_state"), F.lit(0).alias("p_depth"), F.lit(None).cast("bigint").alias("loop_child"), *load.root(F.col("mount")))
    # On a loop each folder has one child folder that is on it too, so the parent can tell which.
    on_loop = folders.where(F.col("state") == CYCLE).select("volume_id", F.col("parent_id").alias("file_id"), F.col("file_id").alias("loop_child"))
    known = folders.join(on_loop, ["volume_id", "file_id"], "left").select("volume_id", "file_id", F.col("id").alias("p_id"), F.col("state").alias("p_state"), F.col("depth").alias("p_depth"), "loop_child", *load.settled)
    parents = known.join(roots.select("volume_id", "file_id"), ["volume_id", "file_id"], "left_anti").unionAll(roots)
    joined, e, p = split_join(entries, "parent_id", parents, entries.count(), "left")
    finding = (
        F.when(e["is_dir"] & (p["p_state"] == CYCLE) & (e["file_id"] == p["loop_child"]), CYCLE)
        .when(p["p_state"].isNull() | (p["p_state"] == ORPHAN), ORPHAN)
        .when(p["p_state"].isin(CYCLE, BELOW), BELOW)
    )
    if "d0" in load.settled:
        finding = finding.when(~F.coalesce((e["before0"] == p["d0"]) & (e["before1"] == p["d1"]), F.lit(False)), "path_mismatch")
    more = [p[c].alias({"path": "parent_path"}.get(c, c)) for c in load.settled if c in ("path", "ancestors")]
    return joined.select(*[e[c] for c in ("id", "volume_id", "file_id", "parent_id", "is_dir", "name")], finding.alias("finding"), p["p_id"].alias("folder_id"), (p["p_depth"] + 1).alias("depth"), *more)


def findings(files: DataFrame, volumes: DataFrame) -> DataFrame:
    """(id, finding) of the current rows without a sound way to the root, or whose stored path disagrees."""
    entries = prepare(files)
    return place(entries, walk(entries, volumes), volumes).where("finding IS NOT NULL").select("id", "finding")


def full_paths(files: DataFrame, volumes: DataFrame) -> DataFrame:
    """(id, volume_id, full_path, depth) of every current row that reaches its root."""
    entries = prepare(files, with_names=True)
    placed = place(entries, walk(entries, volumes, ("path",)), volumes)
    return placed.where("depth IS NOT NULL").select("id", "volume_id", F.concat("parent_path", F.lit("/"), "name").alias("full_path"), "depth")


def descendants(files: DataFrame, volumes: DataFrame) -> DataFrame:
    """(ancestor_id, descendant_id, distance) for every folder and each entry below it, root reached."""
    entries = prepare(files)
    placed = place(entries, walk(entries, volumes, ("ancestors",)), volumes)
    above = F.when(F.col("folder_id").isNull(), F.array().cast("array<bigint>")).otherwise(F.concat("ancestors", F.array("folder_id")))
    pairs = placed.where("depth IS NOT NULL").select(F.col("id").alias("descendant_id"), F.size(above).alias("_n"), F.posexplode(above).alias("_i", "ancestor_id"))
    return pairs.select("ancestor_id", "descendant_id", (F.col("_n") - F.col("_i")).alias("distance"))
