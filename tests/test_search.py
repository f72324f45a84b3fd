"""The engine over small catalogues: golden searches, relations with coverage, unknowns, order, pages."""

from __future__ import annotations

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from quarryline.engine.search import BUILT_IN, Catalog
from quarryline.functions import text as X
from quarryline.lang import QueryError
from quarryline.lang.values import Clock
from quarryline.plans.model import prepare
from quarryline.plans.relations import Coverage, folder_metrics

DDL = "id bigint, path string, name string, extension string, size bigint, modified bigint, created bigint, is_dir boolean, is_symlink boolean, flags bigint, properties string, body string"
#: An orchard's notes: (name, body).
NOTES = [
    ("quince.md", "prune in march"), ("quinces by row.md", "row one\nrow two"), ("wildquince.md", "do not prune"), ("old quince.md", "Prune after frost"), ("quince_jam.md", "sugar and prunes"), ("quince-tree.md", "march\nprune"),
    ("piña.md", "piña fría"), ("pina.md", "pina fria"), ("LOGBOOK.MD", "Row Nine"), ("row9.md", "nine"), ("row10.md", "ten"), ("梅の木.md", "梅と杏"), ("no body.md", ""),
]


def plain(s):
    return "".join(c for c in unicodedata.normalize("NFD", s.lower()) if not unicodedata.combining(c))


@pytest.fixture(scope="module")
def golden(spark):
    rows = [(i, f"/orchard/{n}", n, n.rsplit(".", 1)[1].lower(), 3072, 1741780800, 1741694400, False, False, 0, '{"title":"Orchard book"}', b) for i, (n, b) in enumerate(NOTES)]
    return Catalog(prepare(spark.createDataFrame(rows, DDL)).cache())


def word(w, text, start=True, end=True, inner=r"[^\W_]"):
    return re.search((rf"(?<!{inner})" if start else "") + re.escape(w) + (rf"(?!{inner})" if end else ""), plain(text)) is not None


#: A search, and what it means for a name and a body.
GOLDEN = [
    ("quince", lambda n, b: "quince" in n),
    ("whole-words:quince", lambda n, b: word("quince", n)),
    ("prefix:quince", lambda n, b: word("quince", n, end=False)),
    ("suffix:quince", lambda n, b: word("quince", n, start=False)),
    ("whole:quince.md", lambda n, b: n == "quince.md"),
    ("start-with:quince", lambda n, b: n.startswith("quince")),
    ("end-with:quince.md", lambda n, b: n.endswith("quince.md")),
    ("pina", lambda n, b: "pina" in plain(n)),
    ("PIÑA", lambda n, b: "pina" in plain(n)),
    ("diacritics:pina", lambda n, b: "pina" in n.lower()),
    ("diacritics:no-diacritics:pina", lambda n, b: "pina" in plain(n)),
    ("Case:LOG", lambda n, b: "LOG" in n),
    ("case:log", lambda n, b: "log" in n),
    ("case:ext:md", lambda n, b: True),
    ("梅", lambda n, b: "梅" in n),
    ("content:<prune march>", lambda n, b: "prune" in plain(b) and "march" in plain(b)),
    ("content:<frost | two>", lambda n, b: "frost" in plain(b) or "two" in plain(b)),
    ("content:<!prune !row>", lambda n, b: not {"prune", "row"} & {w for w in ("prune", "row") if w in plain(b)}),
    ("case:content:Prune", lambda n, b: "Prune" in b),
    ("ww:content:prune", lambda n, b: word("prune", b, inner=r"\w")),
    ("regex:row(9|10)", lambda n, b: re.search("row(9|10)", n)),
    ("regex:content:n[io]ne", lambda n, b: re.search("n[io]ne", plain(b))),
    ("regex:content:^prune$", lambda n, b: b == "prune"),
    ("multiline:regex:content:^prune$", lambda n, b: re.search("^prune$", b, re.M)),
    ("regex:content:one.row", lambda n, b: False),
    ("dotall:regex:content:one.row", lambda n, b: "one\nrow" in b),
    ('regex:content:"^(nine|ten)$"', lambda n, b: b in ("nine", "ten")),
    ("file:case:<LOG|row>", lambda n, b: "LOG" in n or "row" in n),
    ("path:<orchard row>", lambda n, b: "row" in n),
    ("row?.md", lambda n, b: re.fullmatch(r"row.\.md", n)),
    ("row*", lambda n, b: n.startswith("row")),
    ("title:orchard dm:2025-03-12 size:3kb", lambda n, b: True),
    ("title:orchard dm:2025-03-13", lambda n, b: False),
]


@pytest.mark.parametrize(("text", "meaning"), GOLDEN)
def test_golden(golden, text, meaning):
    assert {r.name for r in golden.matches(text).select("name").collect()} == {n for n, b in NOTES if meaning(n, b)}


def test_unknown_function(golden):
    with pytest.raises(QueryError):
        golden.matches("unknown:foo")
    with pytest.raises(QueryError, match="recursion"):
        golden.matches("regex:a(?R)b")


#: A library: path, whether it is a folder, size.
TREE = [
    ("/lib", True, 0), ("/lib/maps", True, 0), ("/lib/maps/sea", True, 0), ("/lib/void", True, 0), ("/lib/locked", True, 0), ("/lib/mapsets", True, 0),
    ("/lib/maps/coast.tif", False, 8), ("/lib/maps/sea/深海.log", False, 16), ("/lib/maps/index.log", False, 8), ("/lib/mapsets/grid.log", False, 5),
]
FULL = Coverage(True, ("/lib",))
GAPS = Coverage(True, ("/lib",), ("/lib/maps/sea", "/lib/locked"))


@pytest.fixture(scope="module")
def tree(spark):
    rows = []
    for i, (p, d, s) in enumerate(TREE):
        n = p.rsplit("/", 1)[1]
        map_ = n == "coast.tif"
        rows.append((i, p, n, "" if d else n.rsplit(".", 1)[1], s, 0, 0, d, False, 0, '{"author":"Survey Office","pages":2}' if map_ else None, "scale and legend" if map_ else None))
    return prepare(spark.createDataFrame(rows, DDL)).cache()


@pytest.mark.parametrize(
    ("cover", "text", "paths"),
    [
        (FULL, "child:coast", "/maps"),
        (FULL, "descendant:<ext:tif>", " /maps"),
        (FULL, "childfolder:<child:<ext:log>>", " /maps"),
        (FULL, "child-file:深", "/maps/sea"),
        (FULL, "case:child:Coast", None),
        (FULL, "child:<author:survey pages:2>", "/maps"),
        (FULL, "foldersize:=32", "/maps"),
        (FULL, "foldersize:=37", ""),
        (FULL, "childcount:=3", "/maps"),
        (FULL, "descendantfilecount:=3", "/maps"),
        (FULL, "empty:", "/locked /void"),
        (FULL, "folder: !descendant:<content:absent>", "/locked /void"),
        (GAPS, "empty:", "/void"),
        (GAPS, "folder: !descendant:nothing", "/mapsets /void"),
        (GAPS, "foldersize:unknown", " /locked /maps /maps/sea"),
        (GAPS, "descendant:coast", " /maps"),
        (Coverage(False), "empty:", None),
    ],
)
def test_relations(tree, cover, text, paths):
    want = [] if paths is None else sorted("/lib" + p for p in paths.split(" "))
    assert sorted(r.path for r in Catalog(tree, coverage=cover).matches(text).select("path").collect()) == want


def test_relation_is_false_on_files(tree):
    got = {r.path for r in Catalog(tree, coverage=FULL).matches("file: !child:x").select("path").collect()}
    assert len(got) == 4


def test_sums_beyond_64_bits_are_unknown(spark):
    big = 2**63 - 1
    rows = [(0, "/d", "d", "", 0, 0, 0, True, False, 0, None, None)] + [(i, f"/d/{i}", str(i), "", big, 0, 0, False, False, 0, None, None) for i in range(1, 4)]
    df = spark.createDataFrame(rows, DDL)
    assert folder_metrics(df).first().foldersize is None
    assert [r.path for r in Catalog(df).matches("foldersize:unknown").collect()] == ["/d"]


def test_directory_info(tree):
    rows = Catalog(tree, coverage=FULL).directory_info(["/lib", "/x", "/lib"]).orderBy("position").collect()
    assert [(r.path, r.recursive_size, r.child_count, r.descendant_count, r.reason) for r in rows] == [("/lib", 37, 4, 9, None), ("/x", None, None, None, "not_an_indexed_directory"), ("/lib", 37, 4, 9, None)]
    with pytest.raises(QueryError):
        Catalog(tree).directory_info(["/x"] * 201)


SIZES = [0, 1, 1023, 1024, 1025, 1535, 1536, 1537, 1638, 1639, 2047, 2048, 2**53 - 1, 2**53, 2**53 + 1, 2**53 + 2, None]


@pytest.fixture(scope="module")
def numeric(spark):
    rows = [(i, f"/{i}", str(i), "", s, None, None, False, False, None, None, None) for i, s in enumerate(SIZES)] + [(99, "/dir", "dir", "", 1024, 0, 0, True, False, 0, None, None)]
    return Catalog(spark.createDataFrame(rows, DDL).cache())


@pytest.mark.parametrize(
    ("text", "test"),
    [
        ("size:1.5kb", lambda s: s is not None and 1536 <= s < 1638.4),
        ("size:=9007199254740992", lambda s: s is not None and float(s) == 2.0**53),
        ("size:>=1024 size:<1536", lambda s: s is not None and 1024 <= s < 1536),
        ("size:!=1024", lambda s: s is not None and s != 1024),
        ("size:>9007199254740991", lambda s: s is not None and s > 2**53 - 1),
        ("file: size:unknown", lambda s: s is None),
        ("file: !size:=1024", lambda s: s != 1024),
    ],
)
def test_numbers(numeric, text, test):
    assert sorted(r.id for r in numeric.matches(text).select("id").collect()) == [i for i, s in enumerate(SIZES) if test(s)]


def test_folder_sizes_are_unknown(numeric):
    assert "/dir" not in {r.path for r in numeric.matches("size:=1024 | size:!=1024").collect()}
    assert "/dir" in {r.path for r in numeric.matches("!size:=1024").collect()}


def test_unknown_content_is_not_absence(spark):
    rows = [(i, f"/{i}", str(i), "", 1, 0, 0, False, False, 0, "{}", b) for i, b in enumerate(["has x", "none", None])]
    c = Catalog(spark.createDataFrame(rows, DDL))
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(c.matches("!content:x")) == [1]
    assert ids(c.matches("content:x | 2")) == [0, 2]
    assert ids(c.matches("!<content:x 9>")) == [0, 1, 2]
    assert ids(Catalog(c.rows, exclusions=["content:x"]).matches("")) == [1, 2]
    assert ids(c.content_candidates("content:x 1")) == [1]


def test_property_types(spark):
    props = ['{"width": 5}', '{"width": "5"}', '{"width": 5.5, "title": "Plan"}', '{"title": 7}', "not json", None]
    rows = [(i, f"/{i}", str(i), "", 1, 0, 0, False, False, 0, p, None) for i, p in enumerate(props)]
    c = Catalog(spark.createDataFrame(rows, DDL))
    ids = lambda q: sorted(r.id for r in c.matches(q).select("id").collect())
    assert ids("width:>=5") == [0, 2]
    assert ids("title:plan") == [2]
    assert ids("width:unknown") == [1, 3, 4, 5]


def test_order_pages_anchors(spark):
    names = ["file10", "File2", "file02", "b", "a", "file2"]
    rows = [(i, f"/{n}", n, "", i % 2, 0, 0, False, False, 0, None, None) for i, n in enumerate(names)]
    c = Catalog(spark.createDataFrame(rows, DDL))
    order = [r.name for r in c.query("").collect()]
    assert order == ["a", "b", "File2", "file02", "file2", "file10"]
    assert [r.name for r in c.query("", [("size", False)]).collect()][:3] == ["File2", "b", "file2"]
    assert [r.name for r in c.query("", limit=2, offset=3).collect()] == order[3:5]
    page = c.page_at("", "/file2", before=1, limit=2)
    assert (page.offset, page.total, [r.name for r in page.rows.collect()]) == (3, 6, order[3:5])
    assert c.page_at("", "/gone", offset=50, limit=4).offset == 2
    assert [r.rank for r in c.ranked("", limit=2, offset=3).collect()] == [4, 5]
    with pytest.raises(QueryError):
        c.query("", [("color", True)])


def test_deep_pages(spark, monkeypatch):
    """Pages found by ranges of the order, with ties and repeated rows, are those of one sort."""
    rows = [(i % 90, f"/p{i % 17}", f"n{i % 5}", "", None if i % 7 == 0 else i % 3, 0, 0, False, False, 0, None, None) for i in range(200)]
    c = Catalog(spark.createDataFrame(rows, DDL).repartition(3))
    plain = lambda df: [(r.id, r.path, r.name, r.size) for r in df.collect()]
    for sort in ([("size", False), ("name", True)], [("size", True)], None):
        want = {(at, n): plain(c.query("", sort, n, at)) for at, n in ((0, 5), (37, 20), (190, 30), (199, 1), (200, 5))}
        monkeypatch.setattr("quarryline.engine.search.DEEP", -1)
        for (at, n), rows_ in want.items():
            got = plain(c.query("", sort, n, at))
            assert len(got) == len(rows_) and [g[1:] for g in got] == [r[1:] for r in rows_] and sorted(got) == sorted(rows_)
        monkeypatch.undo()


def test_what_is_not_accessible_is_hidden(spark):
    rows = [(1, "/a", "a", "", 0, 0, 0, True, False, 0, None, None), (2, "/a/x", "x", "", 5, 0, 0, False, False, 0, None, None), (3, "/a/y", "y", "", 7, 0, 0, False, False, 0, None, None)]
    df = prepare(spark.createDataFrame(rows, DDL).withColumn("accessible", F.when(F.col("id") == 3, False)))
    c = Catalog(df)
    assert [r.id for r in c.query("file:").collect()] == [2]
    assert [r.id for r in c.matches("childcount:=1 foldersize:=5").collect()] == [1]
    assert [r.recursive_size for r in c.directory_info(["/a"]).collect()] == [5]


@pytest.mark.parametrize("a", ["x1", "x01", "x10", "x9", "X9b", "9", "10", "é2", "e10", ""])
def test_natural_key_in_spark_and_python(spark, a):
    got = spark.createDataFrame([(a,)], "n string").select(X.natural_key(X.fold_column("n"))).first()[0]
    assert got == X.natural_key_of(a)


def test_folds():
    assert X.fold_search("Ünïcode Straße") == "unicode strasse"
    assert X.fold("CAFÉ") == X.fold("café") == "café"
    assert X.fold_search("각") == "각"


def test_fold_columns_and_nulls(spark):
    values = ["ABC", "Straße", "café", None, "", "ÉÉ"]
    df = spark.createDataFrame([(v,) for v in values], "s string")
    assert [r[0] for r in df.select(X.fold_search_column("s")).collect()] == [None if v is None else X.fold_search(v) for v in values]
    assert [r[0] for r in df.select(X.fold_column("s")).collect()] == [None if v is None else X.fold(v) for v in values]


def test_filter_reaches_the_scan(spark, tmp_path):
    spark.range(10).select("id", F.col("id").alias("size"), F.lit(False).alias("is_dir"), F.lit("a").alias("name"), F.lit("/a").alias("path"), F.lit("x").alias("extra")).write.parquet(str(tmp_path / "f"))
    plan = Catalog(spark.read.parquet(str(tmp_path / "f"))).matches("size:>5").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(size,5)" in plan and "extra" not in plan.split("ReadSchema")[1]


def test_plans_and_built_ins(golden):
    assert golden.query_plan("content:x")["requires_content"]
    assert golden.query_plan("a") == {"requires_content": False, "requires_properties": False, "requires_extraction": False, "requires_relations": False}
    assert Catalog(golden.rows, exclusions=["title:x"]).query_plan("child:a") == {"requires_content": False, "requires_properties": True, "requires_extraction": True, "requires_relations": True}
    for text in BUILT_IN.values():
        golden.tree(text)


def test_empty_catalogue(spark):
    c = Catalog(spark.createDataFrame([], DDL), clock=Clock(0))
    for text in ("", "a", "content:x", "child:<a>", "foldersize:>1", "dm:today"):
        assert c.query(text).collect() == []
    assert c.page_at("", "/a").offset == 0
