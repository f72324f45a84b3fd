"""Duplicates, renames, file lists, scans, change events, merges, generations and leases."""

from __future__ import annotations

import io
import shutil
import time
import zipfile
from unittest import mock

import pytest
from pyspark import InheritableThread
from pyspark.sql import functions as F

from quarryline.engine.cache import ResultCache, uses_clock
from quarryline.engine.indexer import Indexer
from quarryline.engine.search import Catalog
from quarryline.engine.requests import Requests, selected
from quarryline.engine.store import Conflict, Expired, GenerationStore, Leases, Preferences
from quarryline.lang import QueryError
from quarryline.lang.values import Clock
from quarryline.operators import duplicates, renames
from quarryline.plans.model import SCHEMA, parent_path
from quarryline.plans.relations import Coverage
from quarryline.sources import filelist, scan
from quarryline.streaming import events as E
from quarryline.streaming import merge


def entries(spark, rows):
    """(id, path, size, more) as rows of the full schema."""
    full = []
    for i, path, size, more in rows:
        name = path.rsplit("/", 1)[-1]
        r = dict.fromkeys(SCHEMA.names) | {"id": i, "path": path, "name": name, "extension": name.rpartition(".")[2] if "." in name else "", "size": size, "modified": 1, "created": 1, "changed": 1, "modified_ns": 0, "changed_ns": 0, "is_dir": False, "is_symlink": False, "file_id": i, "parent_id": 0, "volume_id": "v", "flags": 0, "properties": "{}", "content_indexed": False}
        full.append(tuple((r | more)[n] for n in SCHEMA.names))
    return spark.createDataFrame(full, SCHEMA)


@pytest.mark.parametrize(("path", "parent"), [("/a/b", "/a"), ("/a", "/"), ("/", ""), ("a", ""), ("", ""), ("/a/b/", "/a"), ("a/b", "a"), (None, None)])
def test_parent(spark, path, parent):
    assert spark.createDataFrame([(path,)], "path string").select(parent_path(F.col("path"))).first()[0] in ((parent,) if path else (parent, ""))


def test_duplicates(spark):
    files = entries(spark, [(1, "/a.txt", 9, {}), (2, "/b.txt", 9, {}), (3, "/alias.txt", 9, {"file_id": 1}), (4, "/x/A.TXT", 5, {}), (5, "/only", 7, {}), (6, "/link2", 7, {"file_id": 5}), (7, "/dir", 9, {"is_dir": True}), (8, "/none", None, {"file_id": None}), (9, "/none2", None, {"file_id": None})])
    bodies = spark.createDataFrame([("/a.txt", "identical"), ("/b.txt", "identical"), ("/alias.txt", "identical"), ("/x/A.TXT", "identical")], "path string, body string")
    group = lambda mode, **k: {r.group_key: (r.distinct_files, r.paths, r.keeper) for r in duplicates.group_summary(duplicates.duplicate_groups(files, mode, **k)).collect()}
    assert list(group("content", content=bodies).values()) == [(2, 3, "/a.txt")]
    assert group("size") == {"9": (2, 3, "/a.txt")}
    assert group("name") == {"a.txt": (2, 2, "/a.txt")}
    assert {(r.file_id, r.links) for r in duplicates.hard_link_groups(files).collect()} == {(1, 2), (5, 2)}
    found = duplicates.duplicate_groups(files, "content", bodies)
    assert [r.path for r in duplicates.removable(found).collect()] == ["/b.txt"]
    clones = spark.createDataFrame([(1, "v", 5), (2, "v", 5), (3, "v", 5)], "id bigint, volume_id string, clone_id bigint")
    assert [r.files for r in duplicates.clone_groups(found, clones).collect()] == [2]
    assert {r.id for r in duplicates.link_closure(files, files.where("id = 3").select("id")).collect()} == {1, 3}
    assert sorted(r.member for r in duplicates.numbered(found).collect()) == [1, 2, 3]
    assert duplicates.duplicate_groups(files.limit(0), "size").collect() == []
    with pytest.raises(ValueError):
        duplicates.duplicate_groups(files, "colour")


def test_content_of_unknown_size(spark):
    files = entries(spark, [(1, "/a", None, {}), (2, "/b", None, {}), (3, "/c", 9, {}), (4, "/d", 7, {}), (5, "/e", 6, {})])
    bodies = spark.createDataFrame([("/a", "one"), ("/b", "one"), ("/c", "one"), ("/d", "two")], "path string, body string")
    found = duplicates.duplicate_groups(files, "content", bodies).collect()
    assert {(r.path, r.distinct_files) for r in found} == {("/a", 3), ("/b", 3), ("/c", 3)}


def test_positions_in_ranges(spark):
    rows = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("id"), F.lit("x").alias("path"))
    placed = renames.positions(rows, [F.col("path"), F.col("id").desc()])
    assert {(r.id, r.position) for r in placed.collect()} == {(i, 999 - i) for i in range(1000)}
    assert "SinglePartition" not in placed._jdf.queryExecution().executedPlan().toString()
    assert renames.positions(rows.limit(0), [F.col("id")]).collect() == []


def test_renames(spark):
    files = entries(spark, [(1, "/d/report.pdf", 1, {}), (2, "/d/report", 1, {"is_dir": True}), (3, "/d/.report", 1, {}), (4, "/d/x.tar.gz", 1, {}), (5, "/d/report/in.txt", 1, {}), (6, "/d/plan.pdf", 1, {})])
    chosen = renames.positions(files.where("id < 6"), [F.col("id")])
    plan = renames.rename_plan(chosen, search="report", replacement="plan", prefix="<", suffix=">", start=9, digits=2, separator="-")
    assert {r.id: r.new_name for r in plan.collect()} == {1: "<plan>-09.pdf", 2: "<plan>-10", 3: "<.plan>-11", 4: "<x.tar>-12.gz", 5: "<in>-13.txt"}
    bare = renames.rename_plan(chosen, search="report", replacement="plan")
    assert {r.id: r.conflict for r in renames.rename_conflicts(bare, files).collect()} == {1: "target_exists", 4: "no_change", 5: "no_change"}
    same = renames.rename_plan(chosen.where("id in (1, 4)").withColumn("name", F.lit("same.x")))
    assert set(r.conflict for r in renames.rename_conflicts(same, files).collect()) == {"duplicate_target"}
    moved = renames.rename_plan(chosen.where("id in (2, 5)"), prefix="n")
    assert {r.id: r.conflict for r in renames.rename_conflicts(moved, files).collect()} == {5: "overlapping_sources"}
    with pytest.raises(ValueError):
        renames.rename_plan(chosen, start=1, digits=13)


def test_list_in_and_out(spark, tmp_path):
    # The names of the list format.
    csv = tmp_path / "l.csv"
    csv.write_bytes('﻿"Filename",SIZE,Date Modified,Attributes,more\r\n"/a, ""b""\nc.TXT",5,133645248000000000,0,z\r\n/d,,1700000000,16,\r\n,1,1,0,\r\n'.encode())
    rows = filelist.read_list(spark, str(csv))
    assert {(r.path, r.size, r.modified, r.is_dir) for r in rows.collect()} == {('/a, "b"\nc.TXT', 5, 1720051200, False), ("/d", None, 1700000000, True)}
    taken = {r.path: r for r in filelist.import_rows(rows).collect()}
    assert taken['/a, "b"\nc.TXT'].extension == "txt" and taken["/d"].extension == "" and taken["/d"].volume_id == "offline:filelist"
    out = tmp_path / "out"
    filelist.write_list(filelist.import_rows(rows), str(out))
    text = b"".join(p.read_bytes() for p in sorted(out.glob("part-*")) if p.stat().st_size)
    assert text.startswith(b"Filename,Size,Date Modified,Attributes\r\n") and b'"/a, ""b""\nc.TXT",5,133645248000000000,0\r\n' in text
    again = filelist.read_list(spark, str(out)).collect()
    assert {(r.path, r.size) for r in again} == {('/a, "b"\nc.TXT', 5), ("/d", 0)}
    with pytest.raises(Exception, match="exist"):
        filelist.write_list(rows, str(out))
    csv.write_text("a,b\n1,2\n")
    with pytest.raises(filelist.ImportError_):
        filelist.read_list(spark, str(csv))


def test_last_row_of_a_path_wins(spark):
    rows = spark.createDataFrame([("/a\\b.X", 1, 1), ("/a\\b.X", 2, 2), ("", 3, 1)], "path string, size bigint, n int")
    got = filelist.import_rows(rows, "n").collect()
    assert [(r.name, r.size, r.extension) for r in got] == [("b.X", 2, "x")]
    filelist.check_limits(rows)
    with pytest.raises(filelist.ImportError_):
        filelist.check_limits(spark.createDataFrame([("x" * 70000,)], "path string"))


def test_scopes(spark):
    assert scan.compact_scopes(["/b//c/", "/a", "/a/x", "/ab", "/a/"]) == ["/a", "/ab", "/b/c"]
    paths = ["/a", "/a/x", "/ab", "/a0", "/a/skip/y", "/c"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert [r.path for r in scan.retain_scopes(df, ["/a"], ["/a/skip"]).collect()] == ["/a", "/a/x"]
    assert scan.retain_scopes(df, ["/"]).count() == len(paths)
    assert scan.retain_scopes(df, []).count() == 0


def test_scan_and_extraction(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.txt").write_text("grüße")
    (tmp_path / "in" / "u.md").write_bytes("wide".encode("utf-16"))
    (tmp_path / "in" / "deep" / "b.bin").write_bytes(b"\0\1")
    (tmp_path / "in" / "deep" / "nul.txt").write_bytes(b"a\0b")
    (tmp_path / "in" / "ln").symlink_to("a.txt")
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("word/document.xml", "<w:p><w:t>one &amp;</w:t><w:t xml:space='preserve'> two</w:t></w:p><w:p><w:t>three</w:t></w:p>")
    (tmp_path / "in" / "w.docx").write_bytes(z.getvalue())
    found, uncovered = scan.scan(spark, [str(tmp_path / "in")], [str(tmp_path / "in" / "none")])
    got = {r.path.rsplit("/", 1)[1]: r for r in found.collect()}
    assert set(got) == {"a.txt", "u.md", "deep", "b.bin", "nul.txt", "ln", "w.docx"}
    assert got["deep"].is_dir and got["ln"].is_symlink and got["b.bin"].parent_id == got["deep"].file_id and got["a.txt"].size == 7
    assert uncovered.count() == 0
    bodies = {r.path.rsplit("/", 1)[1]: r.body for r in scan.extract_bodies(spark, str(tmp_path / "in")).collect()}
    assert bodies["a.txt"] == "grüße" and bodies["u.md"] == "wide" and bodies["nul.txt"] is None and bodies["b.bin"] is None
    assert bodies["w.docx"].split("\n")[:2] == ["one & two", "three"]


def test_long_files_have_null_bodies(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scan, "MAX_BODY", 4)
    (tmp_path / "short.txt").write_text("four")
    (tmp_path / "long.txt").write_text("longer")
    assert {r.path.rsplit("/", 1)[1]: r.body for r in scan.extract_bodies(spark, str(tmp_path)).collect()} == {"short.txt": "four", "long.txt": None}


def test_reconcile_plan(spark):
    ev = lambda rows: spark.createDataFrame(rows, E.EVENT_SCHEMA)
    plan = lambda rows, roots=("/r",): {r.path: r.action for r in E.reconcile_plan(ev(rows), list(roots)).collect()}
    assert plan([("/r/a/f", 1, 0), ("/r/b", 2, E.MUST_SCAN), ("/r/b/c", 3, E.MUST_SCAN), ("/r/b/x", 4, 0), ("/r/d", 5, E.INODE_META | E.IS_DIR)]) == {"/r/a/f": "refresh", "/r/a": "refresh", "/r/b": "rescan", "/r/d": "check_folder", "/r": "refresh"}
    assert plan([("/r/a", 1, E.USER_DROPPED)], ("/r", "/s")) == {"/r": "rescan", "/s": "rescan"}
    assert plan([]) == {}
    files = entries(spark, [(1, "/r/d", 0, {"is_dir": True})])
    checked = E.resolve_checks(spark.createDataFrame([("/r/d", "check_folder"), ("/r/n", "check_folder"), ("/r/x", "refresh")], "path string, action string"), files)
    assert {r.path: r.action for r in checked.collect()} == {"/r/d": "refresh", "/r/n": "rescan", "/r/x": "refresh"}
    assert E.without_own(ev([("/i/x", 1, 0), ("/ix", 2, 0)]), "/i").first().path == "/ix"
    assert E.cursor(ev([("/a", 4, 0), ("/b", 2, 0)])).first().cursor == 4


def test_merge(spark):
    files = entries(spark, [(1, "/a", 1, {"properties": '{"p":1}', "content_indexed": True}), (2, "/b", 1, {"properties": '{"p":2}'}), (3, "/gone", 1, {}), (4, "/locked/x", 1, {})])
    seen = entries(spark, [(50, "/a", 9, {}), (51, "/b", 1, {"flags": 4, "file_id": 2}), (52, "/new", 3, {})])
    up = {r.path: r for r in merge.upsert(files, seen).collect()}
    assert (up["/a"].id, up["/a"].size, up["/a"].properties, up["/a"].content_indexed) == (1, 9, "{}", False)
    assert (up["/b"].flags, up["/b"].properties) == (4, '{"p":2}')
    assert up["/new"].id == 52 and up["/gone"].id == 3
    kept = {r.path for r in merge.delete_missing(files, seen, ["/"], ["/locked"]).collect()}
    assert kept == {"/a", "/b", "/locked/x"}
    assert {r.path: r.accessible for r in merge.deny(files, ["/locked"]).collect()}["/locked/x"] is False
    changes = seen.withColumns({"deleted": F.lit(False), "event_id": F.col("id")}).unionByName(files.where("id in (1, 3)").withColumns({"deleted": F.lit(True), "event_id": F.col("id")}))
    assert {r.path for r in merge.apply_changes(files, changes).collect()} == {"/a", "/b", "/new", "/locked/x"}
    assert {(r.id, r.path) for r in merge.delta(files, spark.createDataFrame([(1,), (9,), (1,)], "id bigint")).select("id", "path").collect()} == {(1, "/a"), (9, None)}
    assert merge.bounded_journal(changes)[1] and not merge.rewrite_needed(2000, 100) and merge.rewrite_needed(2001, 100)


def test_incremental_equals_full(spark):
    files = entries(spark, [(i, f"/f{i}", i, {}) for i in range(20)])
    batches = [entries(spark, [(i, f"/f{i}", i * k, {}) for i in range(k, 25, k)]).withColumns({"deleted": F.col("id") % 5 == 0, "event_id": F.col("id") + 100 * k}) for k in (2, 3)]
    step = merge.apply_changes(merge.apply_changes(files, batches[0]), batches[1])
    once = merge.apply_changes(files, batches[0].unionByName(batches[1]))
    assert {(r.path, r.size) for r in step.collect()} == {(r.path, r.size) for r in once.collect()}


def test_store_and_leases(spark, tmp_path):
    store = GenerationStore(spark, f"file://{tmp_path}/s")
    files = entries(spark, [(1, "/alpha", 1, {}), (2, "/beta", 1, {})])
    assert store.status()["generation"] is None
    with pytest.raises(Expired):
        store.current()
    assert store.publish(files, Coverage(True, ("/",), ("/x",))) == 1
    assert store.set_preferences(Preferences(macros={"m": "alpha"}, exclusions=("beta",))) and not store.set_preferences(store.preferences())
    clock = [1000.0]
    leases = Leases(store, lambda: clock[0])
    key = leases.retain()
    store.set_preferences(Preferences())
    for n in range(3):
        store.publish(files.where(f"id > {n}"))
    assert [r.path for r in leases.get(key).matches("m:").collect()] == ["/alpha"]
    assert leases.get(key).matches("beta").count() == 0
    assert store.status()["kept"] == [2, 3, 4] and store.rows(3).count() == 1
    with pytest.raises(Expired):
        store.rows(1)
    clock[0] += 299
    leases.get(key)
    clock[0] += 299
    assert leases.get(key).coverage.uncovered == ("/x",)
    clock[0] += 301
    with pytest.raises(Expired):
        leases.get(key)
    assert not leases.release(key) and not list((tmp_path / "s").glob("gen=1-*"))
    keys = [leases.retain(window=False) for _ in range(8)]
    with pytest.raises(RuntimeError):
        leases.retain(window=False)
    assert leases.release(keys[0]) and leases.retain(window=False)
    with pytest.raises(QueryError):
        Preferences(exclusions=("(",))
    assert Preferences(history=("a", "b")).visited("b").history == ("b", "a")


def test_stream_is_exactly_once(spark, tmp_path):
    store = GenerationStore(spark, f"file://{tmp_path}/s")
    store.publish(entries(spark, [(1, "/a", 1, {}), (2, "/b", 1, {})]))
    source = str(tmp_path / "in")
    schema = entries(spark, []).withColumns({"deleted": F.lit(False), "event_id": F.lit(1).cast("bigint")}).schema

    def send(rows, deleted, at):
        entries(spark, rows).withColumns({"deleted": F.lit(deleted), "event_id": F.lit(at).cast("bigint")}).coalesce(1).write.mode("append").parquet(source)

    def run(checkpoint="cp"):
        q = merge.follow(spark.readStream.schema(schema).parquet(source), store, str(tmp_path / checkpoint))
        q.awaitTermination()

    send([(9, "/c", 5, {})], False, 1)
    run()
    send([(1, "/a", 1, {})], True, 2)
    run()
    assert {r.path for r in store.rows().collect()} == {"/b", "/c"}
    n = store.current()
    run("other")  # a replay: batch 0 again
    assert store.current() == n and store.cursor() == {"event_id": 2}


def test_a_stream_keeps_bodies_and_gaps_and_writes_little(spark, tmp_path):
    store = GenerationStore(spark, f"file://{tmp_path}/s")
    files = entries(spark, [(i, f"/f{i}", 1, {}) for i in range(6)]).withColumn("body", F.concat(F.lit("needle "), "id"))
    store.publish(files, Coverage(True, ("/",), ("/gap",)))
    schema = entries(spark, []).withColumns({"deleted": F.lit(False), "event_id": F.lit(1).cast("bigint")}).schema
    source = str(tmp_path / "in")
    for at, rows in enumerate(([(90, "/new", 5, {}), (91, "/f1", 1, {"file_id": 1})], [(92, "/f2", 7, {"file_id": 2}), (93, "/f3", 1, {"deleted": True})])):
        changed = entries(spark, [(i, p, s, {k: v for k, v in m.items() if k != "deleted"}) for i, p, s, m in rows])
        changed.withColumns({"deleted": F.col("path") == "/f3", "event_id": F.lit(at + 1).cast("bigint")}).coalesce(1).write.mode("append").parquet(source)
        merge.follow(spark.readStream.schema(schema).parquet(source), store, str(tmp_path / "cp")).awaitTermination()
    assert {r.path for r in store.catalog().matches("content:needle").collect()} == {"/f0", "/f1", "/f4", "/f5"}
    assert {r.path for r in store.rows().collect()} == {"/new", "/f0", "/f1", "/f2", "/f4", "/f5"}
    assert store.coverage().uncovered == ("/gap",)
    assert len(list((tmp_path / "s").glob("gen=*"))) == 1 and len(list((tmp_path / "s").glob("delta=*"))) == 2
    assert store.manifest()["generations"][-1]["changed"] == 4
    # Content of the current state is taken over, that of an older one isn't.
    content = store.rows().where("path IN ('/f2', '/new')").select("path", F.lit("thread").alias("body"), F.lit('{"pages":3}').alias("properties"), F.when(F.col("path") == "/new", 999).otherwise(F.col("size")).cast("bigint").alias("size"))
    n = store.publish_content(content)
    assert [r.path for r in store.catalog().matches("content:thread pages:3").collect()] == ["/f2"]
    assert store.publish_content(content) == n == store.current()
    assert {r.path for r in store.catalog().may_match_without_content("content:zzz pages:3").collect()} == {"/f2"}


def test_deltas_are_written_out_once_they_add_up(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("quarryline.engine.store.rewrite_needed", lambda changed, rows: changed > 3)
    store = GenerationStore(spark, f"file://{tmp_path}/s")
    store.publish(entries(spark, [(i, f"/f{i}", 1, {}) for i in range(6)]))
    for k in range(3):
        store.publish_changes(entries(spark, [(k, f"/f{k}", 50 + k, {}), (90 + k, f"/n{k}", 1, {})]), spark.createDataFrame([(f"/f{5 - k}",)], "path string") if k == 1 else None)
    assert {(r.path, r.size) for r in store.rows().collect()} == {("/f0", 50), ("/f1", 51), ("/f2", 52), ("/f3", 1), ("/f5", 1), ("/n0", 1), ("/n1", 1), ("/n2", 1)}
    assert [len(g["deltas"]) for g in store.manifest()["generations"]] == [1, 0, 1]


def test_two_writers(spark, tmp_path):
    one, two = (GenerationStore(spark, f"file://{tmp_path}/s") for _ in range(2))
    files = entries(spark, [(1, "/a", 1, {})])
    assert one.publish(files) == 1
    m = two.manifest()
    assert one.publish_changes(entries(spark, [(2, "/b", 1, {})])) == 2
    with pytest.raises(Conflict):
        two._commit(m, two._generation(m, "gen=none", [], 0, 0, None))
    with pytest.raises(Conflict):
        two.publish(files, expect=1)
    assert two.current() == 2 and {r.path for r in two.rows().collect()} == {"/a", "/b"}
    version = two.status()["version"]
    assert two.wait_status(version, seconds=0.0)["version"] == version and two.wait_status(version - 1)["generation"] == 2


def test_leases_outlive_a_process(spark, tmp_path):
    store = GenerationStore(spark, f"file://{tmp_path}/s")
    store.publish(entries(spark, [(1, "/a", 1, {})]))
    key, page = Leases(store).first_page("a")
    assert [r.path for r in page.collect()] == ["/a"]
    for n in range(4):
        store.publish(entries(spark, [(2, f"/b{n}", 1, {})]))
    again = Leases(GenerationStore(spark, f"file://{tmp_path}/s"))
    assert [r.path for r in again.get(key).query("").collect()] == ["/a"]
    assert again.release(key) and not list((tmp_path / "s").glob("gen=1-*"))


def test_a_subtree_skips_files(spark, tmp_path):
    """A generation is sorted by path, so a subtree's range leaves most files out by their statistics."""
    store = GenerationStore(spark, f"file://{tmp_path}/s")
    store.publish(entries(spark, [(i, f"/{'abcdefgh'[i % 8]}/f{i}", 1, {}) for i in range(400)]))
    some = store.rows().where(scan.in_scopes(F.col("path"), ["/c"]))
    assert some.count() == 50
    spans = [spark.read.parquet(str(f)).agg(F.min("path"), F.max("path")).first() for f in (tmp_path / "s").glob("gen=*/*.parquet")]
    assert len(spans) > 1 and sum(lo < "/c0" and hi >= "/c/" for lo, hi in spans) < len(spans)
    assert "GreaterThanOrEqual(path,/c/)" in some._jdf.queryExecution().executedPlan().toString()


def test_lists_are_utf8(spark, tmp_path):
    (tmp_path / "good.csv").write_bytes("\ufeffFilename,Größe,Size\r\n/é/日記.txt,x,3\r\n\"/a,\"\"b\"\"\n c\",y,4\r\n".encode())
    assert {(r.path, r.size) for r in filelist.read_list(spark, str(tmp_path / "good.csv")).collect()} == {("/é/日記.txt", 3), ('/a,"b"\n c', 4)}
    (tmp_path / "bad.csv").write_bytes(b"Filename,Size\r\n/a\xff\xfeb,3\r\n")
    with pytest.raises(Exception, match="UTF-8"):
        filelist.read_list(spark, str(tmp_path / "bad.csv")).collect()


def test_imports_replace_all_or_nothing(spark, tmp_path, monkeypatch):
    store = GenerationStore(spark, f"file://{tmp_path}/s")
    store.publish(entries(spark, [(1, "/old", 1, {})]))
    rows = lambda *ps: spark.createDataFrame([(p, len(p)) for p in ps], "path string, size bigint")
    assert filelist.import_list(store, rows("/x/a.TXT", "/x/b")) == 2
    assert {(r.path, r.extension, r.volume_id) for r in store.rows().collect()} == {("/x/a.TXT", "txt", filelist.OFFLINE), ("/x/b", "", filelist.OFFLINE)}
    assert not store.coverage().complete and store.catalog().matches("empty:").count() == 0
    with pytest.raises(filelist.ImportError_):
        filelist.import_list(store, rows("/" + "x" * 70_000))
    assert store.current() == 2
    staged = filelist.StagedImport(store)
    staged.append(rows("/p", "/q"))
    staged.append(spark.createDataFrame([("/q", 99)], "path string, size bigint"))
    assert store.current() == 2
    assert staged.finish() == 3 and {(r.path, r.size) for r in store.rows().collect()} == {("/p", 2), ("/q", 99)}
    monkeypatch.setattr(filelist, "PART_ROWS", 1)
    with pytest.raises(filelist.ImportError_):
        filelist.StagedImport(store).append(rows("/a", "/b"))
    left = filelist.StagedImport(store)
    left.append(rows("/z"))
    left.abort()
    assert store.current() == 3 and not list((tmp_path / "s").glob("staged-*"))
    with pytest.raises(filelist.ImportError_):
        left.finish()


def test_export_pages_under_one_lease(spark, tmp_path):
    store = GenerationStore(spark, f"file://{tmp_path}/s")
    store.publish(entries(spark, [(i, f"/f{i:02d}", i, {}) for i in range(25)]))
    leases = Leases(store)
    key = leases.retain(window=False)
    store.publish(entries(spark, [(1, "/other", 1, {})]))
    assert filelist.export_pages((leases, key), "", f"file://{tmp_path}/list", page=10) == 25
    assert {r.path for r in filelist.read_list(spark, f"file://{tmp_path}/list/*").collect()} == {f"/f{i:02d}" for i in range(25)}
    assert len(list((tmp_path / "list").glob("page=*"))) == 3


def test_a_plan_is_carried_out(spark, tmp_path):
    (tmp_path / "t" / "sub").mkdir(parents=True)
    (tmp_path / "t" / "a.txt").write_text("a")
    (tmp_path / "t" / "sub" / "b.txt").write_text("bb")
    root = str(tmp_path / "t")
    plan = spark.createDataFrame([(f"{root}/a.txt", "refresh"), (f"{root}/none", "refresh"), (f"{root}/sub", "rescan")], "path string, action string")
    seen, gone, uncovered = scan.carry_out(plan)
    assert {(r.path, r.size if not r.is_dir else 0) for r in seen.collect()} == {(f"{root}/a.txt", 1), (f"{root}/sub", 0), (f"{root}/sub/b.txt", 2)}
    assert [r.path for r in gone.collect()] == [f"{root}/none"] and uncovered.count() == 0


def test_the_indexer(spark, tmp_path):
    """A scan that publishes as it goes, a drain of events, an overflow, and what couldn't be read."""
    root = tmp_path / "t"
    for k in range(3):
        (root / f"d{k}").mkdir(parents=True)
        (root / f"d{k}" / "f.txt").write_text("text " * (k + 1))
    store = GenerationStore(spark, f"file://{tmp_path}/s")
    at = iter(range(0, 1000, 10))
    indexer = Indexer(store, [str(root)], own=str(tmp_path / "s"), now=lambda: float(next(at)))
    with mock.patch("quarryline.engine.indexer.FIRST_ROWS", 1):
        n = indexer.scan(cursor={"event_id": 4, "stream": "s"})
    assert n == 2 and store.coverage().complete and store.coverage(1).complete is False
    paths = lambda: {r.path.removeprefix(f"{root}/") for r in store.rows().collect()}
    assert paths() == {f"d{k}" for k in range(3)} | {f"d{k}/f.txt" for k in range(3)}
    bodies = scan.read_direct(store.rows())
    assert {r.body for r in bodies.collect()} == {"text " * k for k in (1, 2, 3)}
    store.publish_content(bodies.withColumn("properties", F.lit("{}")))
    (root / "d0" / "f.txt").write_text("other")
    (root / "d1" / "f.txt").unlink()
    (root / "d1" / "new.txt").write_text("new")
    shutil.rmtree(root / "d2")
    ev = lambda *rows: spark.createDataFrame(rows, E.EVENT_SCHEMA)
    indexer.drain(ev((f"{root}/d0/f.txt", 5, 0), (f"{root}/d1", 6, E.MUST_SCAN), (f"{root}/d2", 7, 0), (f"{tmp_path}/s/x", 99, 0)), "s")
    assert paths() == {"d0", "d0/f.txt", "d1", "d1/new.txt"} and store.cursor() == {"event_id": 7, "stream": "s"}
    assert store.catalog().matches("content:text").count() == 0
    assert indexer.drain(ev((f"{tmp_path}/s/x", 100, 0))) is None
    many = ev(*[(f"{root}/d0/f.txt", 10 + i, E.USER_DROPPED if i == 1 else 0) for i in range(6)])
    assert [(r.path, r.event_id, r.flags) for r in E.collapse(many, ["/a", "/b"], 5).collect()] == [("/a", 15, E.USER_DROPPED | E.MUST_SCAN), ("/b", 15, E.USER_DROPPED | E.MUST_SCAN)]
    assert E.collapse(many, ["/a"], 6).count() == 6
    (root / "late.txt").write_text("late")
    ev((f"{root}/late.txt", 200, 0)).write.parquet(f"{tmp_path}/ev")
    indexer.start(spark.readStream.schema(E.EVENT_SCHEMA).parquet(f"{tmp_path}/ev"), f"{tmp_path}/cp", "s")
    indexer.quiesce()
    assert "late.txt" in paths() and store.cursor()["event_id"] == 200 and indexer.query is None
    assert {"/"} <= {r.path for r in scan.volumes(spark).collect()}


def test_pages_asked_before(spark):
    files = entries(spark, [(i, f"/f{i}", i, {}) for i in range(9)])
    assert not uses_clock("a size:>1 dm:2024") and uses_clock("a | dm:today") and uses_clock("m:", {"m": "dc:2months"})
    cache, catalog = ResultCache(2), Catalog(files, clock=Clock(5.0))
    assert cache.page(1, catalog, "f1") == cache.page(1, Catalog(files, clock=Clock(9.0)), "f1") and cache.hits == 1
    cache.page(1, catalog, "dm:<today"), cache.page(1, Catalog(files, clock=Clock(9.0)), "dm:<today")
    assert cache.hits == 1
    cache.page(2, catalog, "f1"), cache.page(2, catalog, "f1", limit=3), cache.page(1, catalog, "f1")
    assert cache.hits == 1 and len(cache.pages) == 2


def test_where_a_stream_goes_on():
    at = {"event_id": 50, "stream": "s"}
    assert E.resume(at, "s", 20, 90) == (50, "replay") and E.resume(at, "s", 51, 90) == (50, "replay")
    assert [E.resume(*x)[0] for x in ((None, "s", 1, 9), (at, "t", 20, 90), (at, "s", 52, 90), (at, "s", 1, 40))] == [None] * 4


def test_requests(spark, tmp_path):
    requests = Requests(spark)
    assert requests.answer("r", lambda: 5) == {"ok": True, "result": 5}
    store = GenerationStore(spark, f"file://{tmp_path}/s")
    assert requests.answer("r", store.current)["error"]["code"] == "expired"
    store.publish(entries(spark, [(i, f"/f{i}", i, {}) for i in range(9)]))
    assert requests.answer("r", lambda: store.catalog().matches("(").count())["error"]["code"] == "bad_query"
    assert not requests.cancel("r")
    slow = lambda: spark.range(8, numPartitions=8).select(F.udf(lambda x: time.sleep(20) or x, "bigint")("id")).collect()
    said = {}
    thread = InheritableThread(target=lambda: said.update(requests.answer("slow", slow)))
    thread.start()
    end = time.time() + 15
    while not spark.sparkContext.statusTracker().getActiveJobsIds() and time.time() < end:
        time.sleep(0.1)
    assert requests.cancel("slow") and not requests.cancel("slow")
    thread.join(15)
    assert said.get("error", {}).get("code") == "cancelled"
    rows = selected(store.catalog(), "", [2, 4, 99, 2], [("size", False)])
    assert {(r.rank, r.path) for r in rows.collect()} == {(2, "/f7"), (4, "/f5")}
