"""Queries of the search engine's own operators over whole tables, with the SQL each is held against.

Most are one search over `files` as stored: SEARCHES has the search and the condition in SQL. The others
follow as functions. Every result carries what fixes its order, where order is the point.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.common import read, scratch_path
from quarryline.engine.search import Catalog
from quarryline.engine.requests import selected_under
from quarryline.engine.store import GenerationStore, Leases, Preferences
from quarryline.functions import text as X
from quarryline.lang.values import Clock
from quarryline.operators import duplicates, renames
from quarryline.plans.model import SCHEMA, prepare
from quarryline.plans.relations import METRIC_SUMS, Coverage, folder_metrics
from quarryline.sources import filelist, scan
from quarryline.streaming import events as E
from quarryline.streaming import merge

#: 2026-01-01 12:00 UTC, the clock all date searches here are bound to.
NOW = Clock(1767268800.0, "UTC", 1)
MACROS = {"office": "ext:pdf;xlsx;docx", "big": "size:>1mb", "report": "office: <report | invoice>"}
EXCLUDED = ("path:archive", "ext:log")
GAPS = Coverage(True, ("/",), ("/Volumes/CameraDrop", "/Volumes/Archive"))


def _s(x: str) -> str:
    """The search fold in SQL, as far as these tables' letters go."""
    out = f"lower(strip_accents({x}))"
    for a, b in (("ß", "ss"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi")):
        out = f"replace({out}, '{a}', '{b}')"
    return out


def _f(x: str) -> str:
    return _s(x).replace("strip_accents", "nfc_normalize")


def _epoch(d: str) -> str:
    return f"epoch(TIMESTAMP '{d}')"


NAME, PATH, EXT = _s("name"), _s("path"), _s("extension")
_NW = r"[^\p{L}\p{N}\p{M}]"
_PARENT = "CASE WHEN instr(path, '/') = 0 THEN '' WHEN regexp_matches(path, '^/[^/]*$') THEN '/' ELSE regexp_replace(path, '/[^/]*$', '') END"
FILE = "NOT coalesce(is_dir, false)"
_PROP = "json_type(properties, '$.{0}') IN ('BIGINT', 'UBIGINT', 'DOUBLE') AND CAST(json_extract(properties, '$.{0}') AS DOUBLE)"

#: name: (search, condition in SQL). The columns are id, path and size, for every stored row.
SEARCHES: dict[str, tuple[str, str]] = {
    "match_all": ("", "true"),
    "text_substring": ("invoice", f"contains({NAME}, 'invoice')"),
    "text_one_character": ("z", f"contains({NAME}, 'z')"),
    "text_accents_ignored": ("manana", f"contains({NAME}, 'manana')"),
    "text_chinese": ("报告", f"contains({NAME}, '报告')"),
    "text_case": ("case:Report", "contains(strip_accents(name), 'Report')"),
    "text_diacritics": ("diacritics:mañana", f"contains({_f('name')}, 'mañana')"),
    "text_whole": ("whole:report-5.json", f"{NAME} = 'report-5.json'"),
    "text_startwith": ("startwith:img_", f"starts_with({NAME}, 'img_')"),
    "text_endwith": ("endwith:001.json", f"ends_with({NAME}, '001.json')"),
    "word_whole": ("ww:plan", rf"regexp_matches({NAME}, '(^|{_NW})plan($|{_NW})')"),
    "word_prefix": ("prefix:plan", rf"regexp_matches({NAME}, '(^|{_NW})plan')"),
    "word_suffix": ("suffix:plan", rf"regexp_matches({NAME}, 'plan($|{_NW})')"),
    "wildcard_name": ("*report*.pdf", r"regexp_matches(strip_accents(name), '(?is)^[^/]*report[^/]*\.pdf$')"),
    "wildcard_one": ("plan-?.json", r"regexp_matches(strip_accents(name), '(?is)^plan-[^/]\.json$')"),
    "wildcard_off": ("nowildcards:plan?", f"contains({NAME}, 'plan?')"),
    "regex_name": (r"regex:^img_\d+[02]\.jpg$", r"regexp_matches(strip_accents(name), '(?i)^img_\p{Nd}+[02]\.jpg$')"),
    "regex_case": (r"case:regex:^IMG_\d+", r"regexp_matches(strip_accents(name), '^IMG_\p{Nd}+')"),
    "regex_full_path": (r"path:regex:^/volumes/\w+/.*/[a-z]+\.\d+\.log$", r"regexp_matches(strip_accents(path), '(?i)^/volumes/[\p{L}\p{N}\p{M}_]+/.*/[a-z]+\.\p{Nd}+\.log$')"),
    "regex_backreference": (r"regex:(\d)\1\1", f"regexp_matches(name, '{'|'.join(c * 3 for c in '0123456789０１２３４５６７８９')}')"),
    "regex_alternatives": ("regex:gr(a|e)y|report", "regexp_matches(strip_accents(name), '(?i)gr(a|e)y|report')"),
    "regex_words": ("ww:regex:pla.", rf"regexp_matches(strip_accents(name), '(?i)(^|{_NW})pla.($|{_NW})')"),
    "path_term": ("path:forecast", f"contains({PATH}, 'forecast')"),
    "path_by_slash": ("archive/report", f"contains({PATH}, 'archive/report')"),
    "path_case": ("case:path:Archive", "contains(strip_accents(path), 'Archive')"),
    "parent_whole": ("parent:/volumes/cameradrop/", f"{_s(_PARENT)} = '/volumes/cameradrop'"),
    "parent_part": ("pathpart:thesis", f"contains({_s(_PARENT)}, 'thesis')"),
    "ext_list": ("ext:pdf;.xlsx;PNG", f"{EXT} IN ('pdf', 'xlsx', 'png')"),
    "ext_none": ("file: ext:", f"{FILE} AND {EXT} = ''"),
    "ext_case": ("case:ext:pdf;jpg", "strip_accents(extension) IN ('pdf', 'jpg')"),
    "ext_regex": ("regex:ext:j.*", "regexp_matches(extension, '(?i)^j.*$')"),
    "extension_substring": ("extension:js", f"contains({EXT}, 'js')"),
    "type_folder": ("folder:", "is_dir"),
    "type_file": ("type:file", FILE),
    "type_symlink": ("symlink:", "is_symlink"),
    "type_scope": ("file:<report | invoice>", f"{FILE} AND (contains({NAME}, 'report') OR contains({NAME}, 'invoice'))"),
    "hidden_filter": ("hidden:", "starts_with(name, '.') OR (flags & 32768) <> 0"),
    "attrib_filter": ("attrib:l", "is_symlink"),
    "flags_mask": ("flags:hidden;compressed;nodump", "(flags & 32801) <> 0"),
    "flags_immutable": ("flags:immutable", "(flags & 131074) <> 0"),
    "size_gt": ("size:>1mb", f"{FILE} AND size > 1048576"),
    "size_bucket": ("size:1.5kb", f"{FILE} AND size >= 1536 AND size < 1638.4"),
    "size_exact": ("size:=1024", f"{FILE} AND size = 1024"),
    "size_range": ("size:1kb..4kb", f"{FILE} AND size BETWEEN 1024 AND 4096"),
    "size_beyond_double": ("size:=9007199254740992", f"{FILE} AND CAST(size AS DOUBLE) = 9007199254740992"),
    "size_negated": ("size:!=1024", f"{FILE} AND size IS NOT NULL AND size <> 1024"),
    "size_negated_outside": ("!size:=1024", f"NOT ({FILE} AND coalesce(size = 1024, false))"),
    "size_unknown": ("size:unknown", "coalesce(is_dir, false) OR size IS NULL"),
    "date_year": ("dm:2025", f"modified >= {_epoch('2025-01-01')} AND modified < {_epoch('2026-01-01')}"),
    "date_month": ("dm:2025-03", f"modified >= {_epoch('2025-03-01')} AND modified < {_epoch('2025-04-01')}"),
    "date_day": ("dm:2025-03-09", f"modified >= {_epoch('2025-03-09')} AND modified < {_epoch('2025-03-10')}"),
    "date_range": ("dm:2025-01..2025-03", f"modified >= {_epoch('2025-01-01')} AND modified < {_epoch('2025-04-01')}"),
    "date_gt": ("dm:>2025-06", f"modified >= {_epoch('2025-07-01')}"),
    "date_le": ("dc:<=2024", f"created < {_epoch('2025-01-01')}"),
    "date_relative": ("dm:30days", "modified >= 1767268800 - 30 * 86400 AND modified < 1767268801"),
    "date_relative_months": ("dm:2months", f"modified >= {_epoch('2025-11-01 12:00:00')} AND modified < 1767268801"),
    "date_last_week": ("dm:lastweek", f"modified >= {_epoch('2025-12-22')} AND modified < {_epoch('2025-12-29')}"),
    "date_last_month": ("dm:lastmonth", f"modified >= {_epoch('2025-12-01')} AND modified < {_epoch('2026-01-01')}"),
    "date_negated": ("dm:!2025", f"modified IS NOT NULL AND NOT (modified >= {_epoch('2025-01-01')} AND modified < {_epoch('2026-01-01')})"),
    "property_number": ("width:>4000", _PROP.format("width") + " > 4000"),
    "property_bucket": ("pages:219", _PROP.format("pages") + " >= 219 AND " + _PROP.format("pages") + " < 220"),
    "property_text": ("title:plan", f"json_type(properties, '$.title') = 'VARCHAR' AND contains({_s('json_extract_string(properties, ' + chr(39) + '$.title' + chr(39) + ')')}, 'plan')"),
    "property_unknown": ("file: width:unknown", f"{FILE} AND NOT coalesce({_PROP.format('width')} IS NOT NULL, false)"),
    "bool_or_binds_tighter": ("report ext:pdf | ext:txt", f"contains({NAME}, 'report') AND {EXT} IN ('pdf', 'txt')"),
    "bool_words": ("report AND NOT ext:log OR ext:jpg", f"contains({NAME}, 'report') AND ({EXT} <> 'log' OR {EXT} = 'jpg')"),
    "bool_nested_not": ("!<report | invoice> !!plan", f"NOT (contains({NAME}, 'report') OR contains({NAME}, 'invoice')) AND contains({NAME}, 'plan')"),
    "bool_exclusion": ("report !ext:jpg !ext:log", f"contains({NAME}, 'report') AND {EXT} NOT IN ('jpg', 'log')"),
    "modifier_scope": ("case:<Report | Invoice>", "contains(strip_accents(name), 'Report') OR contains(strip_accents(name), 'Invoice')"),
    "quoted_literal": ('"report (1)"', f"contains({NAME}, 'report (1)')"),
    "macro_expansion": ("report: big:", f"{EXT} IN ('pdf', 'xlsx', 'docx') AND (contains({NAME}, 'report') OR contains({NAME}, 'invoice')) AND {FILE} AND size > 1048576"),
    "built_in_images": ("ext:jpg;jpeg;png;gif;heic;tif;tiff;webp;svg", f"{EXT} IN ('jpg', 'jpeg', 'png', 'gif', 'heic', 'tif', 'tiff', 'webp', 'svg')"),
}

#: The same over texts: all rows of `documents`; in the searches for the unknown the bodies of logs are unknown.
TEXT = _s("text")
KNOWN = "coalesce(kind, '') <> 'log'"
CONTENT_SEARCHES: dict[str, tuple[str, str]] = {
    "content_substring": ("content:catalogue", f"contains({TEXT}, 'catalogue')"),
    "content_group": ("ext:txt size:>1kb content:<catalogue | index>", f"n_chars > 1024 AND (contains({TEXT}, 'catalogue') OR contains({TEXT}, 'index'))"),
    "content_case": ("case:content:Team", f"contains(strip_accents(text), 'Team')"),
    "content_words": ("ww:content:scan", rf"regexp_matches({TEXT}, '(^|[^\p{{L}}\p{{N}}\p{{M}}_])scan($|[^\p{{L}}\p{{N}}\p{{M}}_])')"),
    "content_regex": (r"regex:content:ticket\s\d+", rf"regexp_matches(strip_accents(text), '(?i)ticket\s\p{{Nd}}+')"),
    "content_dotall": ("dotall:regex:content:^build.*disk.*", f"regexp_matches(strip_accents(text), '(?is)^build.*disk.*')"),
    "content_multiline": (r"multiline:regex:content:^build\s\d+$", rf"regexp_matches(strip_accents(text), '(?im)^build\s\p{{Nd}}+$')"),
    "content_unknown_not": ("!content:catalogue", f"{KNOWN} AND NOT contains({TEXT}, 'catalogue')"),
    "content_unknown_or": ("doc1 | content:catalogue", f"contains('doc' || doc_id || '.txt', 'doc1') OR ({KNOWN} AND contains({TEXT}, 'catalogue'))"),
}


def _clocked(rows: DataFrame, **more: object) -> Catalog:
    return Catalog(rows, MACROS, clock=NOW, **more)


def _search(text: str, spark: SparkSession, d: str) -> DataFrame:
    return _clocked(read(spark, d, "files")).matches(text).select("id", "path", "size")


def texts(spark: SparkSession, d: str, logs: bool = False) -> DataFrame:
    """`documents` as entries of a catalogue, with their texts as bodies; those of logs are unknown unless asked for."""
    name = F.concat(F.lit("doc"), "doc_id", F.lit(".txt"))
    path = F.concat_ws("/", F.lit("/corpus"), F.coalesce("lang", F.lit("none")), F.coalesce("source", F.lit("none")), name)
    false = F.lit(False)
    return read(spark, d, "documents").select(F.col("doc_id").alias("id"), path.alias("path"), name.alias("name"), F.lit("txt").alias("extension"), F.col("n_chars").alias("size"), F.lit(None).cast("bigint").alias("modified"), F.lit(None).cast("bigint").alias("created"), false.alias("is_dir"), false.alias("is_symlink"), F.lit(0).cast("bigint").alias("flags"), F.lit("{}").alias("properties"), F.when(F.lit(logs) | (F.coalesce("kind", F.lit("")) != "log"), F.col("text")).alias("body"))


def json_of(results: DataFrame) -> DataFrame:
    """`id` and `row`, a JSON object of an entry's fields; properties are the object they hold, null if they hold none."""
    parts = []
    for f in SCHEMA:
        if f.name == "properties":
            value = F.when(F.try_parse_json(F.col("properties")).isNotNull(), F.trim("properties"))
        elif f.dataType.simpleString() == "string":
            # A struct of one field, without its braces and name.
            value = F.regexp_extract(F.to_json(F.struct(F.col(f.name).alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
            value = F.when(F.col(f.name).isNotNull(), value)
        else:
            value = F.col(f.name).cast("string")
        parts.append(F.concat(F.lit(f'"{f.name}":'), F.coalesce(value, F.lit("null"))))
    return results.select("id", F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("row"))


def _content_search(text: str, logs: bool, spark: SparkSession, d: str) -> DataFrame:
    return _clocked(texts(spark, d, logs)).matches(text).select(F.col("id").alias("doc_id"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: partial(_search, t) for k, (t, _) in SEARCHES.items()}
QUERIES |= {k: partial(_content_search, t, "unknown" not in k) for k, (t, _) in CONTENT_SEARCHES.items()}
SQL: dict[str, str] = {k: f"SELECT id, path, size FROM files WHERE {c}" for k, (_, c) in SEARCHES.items()}
SQL |= {k: f"SELECT doc_id FROM documents WHERE {c}" for k, (_, c) in CONTENT_SEARCHES.items()}


def _query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@_query(f"SELECT id, path FROM files WHERE contains({NAME}, 'report') AND NOT contains({PATH}, 'archive') AND {EXT} <> 'log'")
def exclusions(spark: SparkSession, d: str) -> DataFrame:
    return _clocked(read(spark, d, "files"), exclusions=EXCLUDED).matches("report").select("id", "path")


@_query(f"SELECT count(*) AS total FROM files WHERE contains({NAME}, 'report')")
def match_count(spark: SparkSession, d: str) -> DataFrame:
    return _clocked(read(spark, d, "files")).matches("report").agg(F.count(F.lit(1)).alias("total"))


@_query("SELECT doc_id FROM documents WHERE n_chars > 1000")
def content_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Rows that a search may find once bodies and properties are known."""
    return _clocked(texts(spark, d)).content_candidates("size:>1000 <content:catalogue | pages:3> !title:draft").select(F.col("id").alias("doc_id"))


_RAW = "instr(path, '/') > 0"
_KID = f"(SELECT *, {_PARENT} AS parent FROM files)"
_DIR = "coalesce(d.is_dir, false) AND NOT coalesce(d.is_symlink, false)"


@_query(f"SELECT d.id, d.path FROM files d WHERE {_DIR} AND d.path IN (SELECT parent FROM {_KID} WHERE extension = 'pdf')")
def child_exists(spark: SparkSession, d: str) -> DataFrame:
    return _clocked(read(spark, d, "files")).matches("child:<ext:pdf>").select("id", "path")


@_query(f"""WITH hits AS (SELECT DISTINCT parent FROM {_KID} WHERE extension = 'pdf')
SELECT d.id, d.path FROM files d WHERE {_DIR} AND EXISTS (SELECT 1 FROM hits h WHERE h.parent = d.path OR starts_with(h.parent, d.path || '/'))""")
def descendant_exists(spark: SparkSession, d: str) -> DataFrame:
    return _clocked(read(spark, d, "files")).matches("descendant:<ext:pdf>").select("id", "path")


@_query(f"""SELECT d.id, d.path FROM files d WHERE {_DIR} AND d.path IN (
  SELECT k.parent FROM {_KID} k WHERE coalesce(k.is_dir, false) AND NOT coalesce(k.is_symlink, false) AND k.path IN (SELECT parent FROM {_KID} WHERE extension = 'log'))""")
def relation_nested(spark: SparkSession, d: str) -> DataFrame:
    return _clocked(read(spark, d, "files")).matches("childfolder:<child:<ext:log>>").select("id", "path")


@_query(f"SELECT d.id, d.path FROM files d WHERE coalesce(d.is_dir, false) AND NOT ({_DIR} AND d.path IN (SELECT parent FROM {_KID} WHERE extension = 'jpg'))")
def relation_negated(spark: SparkSession, d: str) -> DataFrame:
    return _clocked(read(spark, d, "files")).matches("folder: !child:<ext:jpg>").select("id", "path")


_METRICS = f"""WITH k AS {_KID}, dirs AS (SELECT DISTINCT path FROM files d WHERE {_DIR}),
per AS (SELECT parent, count(*) FILTER (WHERE coalesce(is_dir, false) AND NOT coalesce(is_symlink, false)) AS folders, count(*) FILTER (WHERE NOT (coalesce(is_dir, false) AND NOT coalesce(is_symlink, false))) AS files,
  sum(CAST(CASE WHEN NOT (coalesce(is_dir, false) AND NOT coalesce(is_symlink, false)) THEN size END AS HUGEINT)) AS size FROM k GROUP BY parent),
direct AS (SELECT d.path, coalesce(p.folders, 0) AS f, coalesce(p.files, 0) AS n FROM dirs d LEFT JOIN per p ON p.parent = d.path),
deep AS (SELECT d.path, coalesce(sum(p.folders), 0) AS f, coalesce(sum(p.files), 0) AS n, coalesce(sum(p.size), 0) AS size FROM dirs d LEFT JOIN per p ON p.parent = d.path OR starts_with(p.parent, d.path || '/') GROUP BY d.path),
m AS (SELECT a.path, a.f + a.n AS childcount, a.n AS childfilecount, a.f AS childfoldercount, CAST(b.f + b.n AS BIGINT) AS descendantcount, CAST(b.n AS BIGINT) AS descendantfilecount, CAST(b.f AS BIGINT) AS descendantfoldercount, b.size AS foldersize FROM direct a JOIN deep b USING (path))"""


@_query(f"{_METRICS} SELECT path, childcount, childfilecount, childfoldercount, descendantcount, descendantfilecount, descendantfoldercount, CAST(foldersize AS VARCHAR) AS foldersize FROM m")
def folder_rollup(spark: SparkSession, d: str) -> DataFrame:
    m = folder_metrics(read(spark, d, "files"))
    return m.select("path", *METRIC_SUMS, F.col("foldersize").cast("string").alias("foldersize"))


@_query(f"{_METRICS} SELECT d.id, d.path FROM files d JOIN m ON m.path = d.path WHERE {_DIR} AND m.foldersize > 1048576 AND m.childcount >= 3")
def folder_size(spark: SparkSession, d: str) -> DataFrame:
    return _clocked(read(spark, d, "files")).matches("foldersize:>1mb childcount:>=3").select("id", "path")


@_query(f"{_METRICS} SELECT d.id, d.path FROM files d JOIN m ON m.path = d.path WHERE {_DIR} AND m.childcount = 0")
def empty_folders(spark: SparkSession, d: str) -> DataFrame:
    return _clocked(read(spark, d, "files")).matches("empty:").select("id", "path")


_GAP = " OR ".join(f"d.path = '{g}' OR starts_with(d.path, '{g}/') OR starts_with('{g}', d.path || '/')" for g in GAPS.uncovered)


@_query(f"SELECT d.id, d.path FROM files d WHERE {_DIR} AND ({_GAP})")
def coverage_unknown(spark: SparkSession, d: str) -> DataFrame:
    """Folders whose size can't be known because part of them isn't covered."""
    return _clocked(read(spark, d, "files"), coverage=GAPS).matches("foldersize:unknown").select("id", "path")


_ASKED = ("/Volumes/CameraDrop", "/Draft 5", "/none/such", "/Draft 5", "/Volumes/Studio")


@_query(f"""{_METRICS}, asked AS (SELECT unnest(range(0, {len(_ASKED)})) AS position, unnest([{', '.join(repr(a) for a in _ASKED)}]) AS path)
SELECT CAST(a.position AS INTEGER) AS position, a.path, m.path IS NOT NULL AS complete, CAST(m.foldersize AS VARCHAR) AS recursive_size, m.childcount AS child_count, m.descendantcount AS descendant_count, CASE WHEN m.path IS NULL THEN 'not_an_indexed_directory' END AS reason FROM asked a LEFT JOIN m ON m.path = a.path""")
def directory_info(spark: SparkSession, d: str) -> DataFrame:
    info = _clocked(read(spark, d, "files")).directory_info(_ASKED)
    return info.select("position", "path", "complete", F.col("recursive_size").cast("string").alias("recursive_size"), "child_count", "descendant_count", "reason")


def _natural(x: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({x}, '([0-9]+|[^0-9]+)'), lambda t: CASE WHEN regexp_matches(t, '^[0-9]') THEN lpad(CAST(length(ltrim(t, '0')) AS VARCHAR), 5, '0') || ltrim(t, '0') ELSE t END), '')"


def _ranked_sql(where: str, order: str, limit: int, offset: int = 0) -> str:
    return f"SELECT id, path, row_number() OVER (ORDER BY {order}, path, id) AS rank FROM files WHERE {where} QUALIFY rank > {offset} AND rank <= {offset + limit}"


def _ranked(spark: SparkSession, d: str, text: str, sort: list | None, limit: int = 200, offset: int = 0) -> DataFrame:
    return _clocked(read(spark, d, "files")).ranked(text, sort, limit, offset).select("id", "path", "rank")


@_query(_ranked_sql(f"contains({NAME}, 'report')", _natural(_f("name")), 200))
def sort_natural(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d, "report", None)


@_query(_ranked_sql("true", _natural(_f("path")) + " DESC", 100))
def sort_path_descending(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d, "", [("path", False)], 100)


@_query(_ranked_sql("true", f"extension, size DESC NULLS LAST, modified NULLS FIRST, {_natural(_f('name'))}", 500))
def sort_multi(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d, "", [("extension", True), ("size", False), ("modified", True), ("name", True)], 500)


@_query(_ranked_sql(FILE, "size DESC NULLS LAST", 50))
def top_k(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d, "file:", [("size", False)], 50)


@_query(_ranked_sql("true", "modified DESC NULLS LAST", 200, 10_000))
def page_offset(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d, "", [("modified", False)], 200, 10_000)


@_query(f"""WITH r AS (SELECT id, path, row_number() OVER (ORDER BY size DESC NULLS LAST, path, id) AS rank FROM files WHERE {EXT} = 'pdf'),
a AS (SELECT max(path) AS p FROM r), o AS (SELECT greatest(min(rank) - 1 - 10, 0) AS o FROM r JOIN a ON r.path = a.p)
SELECT id, path, rank FROM r, o WHERE rank > o AND rank <= o + 50""")
def page_anchor(spark: SparkSession, d: str) -> DataFrame:
    c = _clocked(read(spark, d, "files"))
    anchor = c.matches("ext:pdf").agg(F.max("path")).first()[0] or ""
    at = c.page_at("ext:pdf", anchor, before=10, sort=[("size", False)], limit=50)
    return c.numbered(at.rows, [("size", False)], at.offset).select("id", "path", "rank")


_REG = "(SELECT *, volume_id || ':' || file_id AS object FROM files WHERE NOT coalesce(is_dir, false) AND NOT coalesce(is_symlink, false))"


def _groups_sql(key: str, table: str = _REG) -> str:
    return f"WITH g AS (SELECT {key} AS group_key, path, object FROM {table}) SELECT group_key, count(DISTINCT object) AS distinct_files, count(*) AS paths, min(path) AS keeper FROM g WHERE group_key IS NOT NULL GROUP BY group_key HAVING count(DISTINCT object) > 1"


@_query(_groups_sql(_f("name")))
def dup_name(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.duplicate_summary(read(spark, d, "files"), "name")


@_query(_groups_sql("CAST(size AS VARCHAR)"))
def dup_size(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.duplicate_summary(read(spark, d, "files"), "size")


def _text_objects(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d).drop("body").join(read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body")), "id").withColumns({"file_id": F.col("id"), "volume_id": F.lit("corpus")})


_CORPUS = "(SELECT *, doc_id AS object, '/corpus/' || coalesce(lang, 'none') || '/' || coalesce(source, 'none') || '/doc' || doc_id || '.txt' AS path FROM documents)"


@_query(_groups_sql("sha256(text)", _CORPUS))
def dup_content(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.duplicate_summary(_text_objects(spark, d), "content")


@_query(f"""WITH g AS (SELECT sha256(text) AS group_key, path, doc_id FROM {_CORPUS}) SELECT group_key, path, doc_id AS id FROM g WHERE group_key IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY group_key ORDER BY path) > 1""")
def dup_removable(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.removable(duplicates.duplicate_groups(_text_objects(spark, d), "content"))


@_query(f"SELECT volume_id, file_id, count(*) AS links, min(path) AS first_path FROM {_REG} WHERE file_id IS NOT NULL GROUP BY volume_id, file_id HAVING count(*) > 1")
def hardlink_groups(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.hard_link_groups(read(spark, d, "files"))


@_query("WITH c AS (SELECT id, volume_id, file_id FROM files WHERE extension = 'pdf') SELECT DISTINCT f.id FROM files f JOIN c ON f.volume_id = c.volume_id AND f.file_id = c.file_id")
def hardlink_closure(spark: SparkSession, d: str) -> DataFrame:
    files = read(spark, d, "files")
    return duplicates.link_closure(files, files.where("extension = 'pdf'").select("id"))


@_query("""SELECT path AS "Filename", coalesce(size, 0) AS "Size", (greatest(-11644473600, coalesce(modified, 0)) + 11644473600) * 10000000 AS "Date Modified", CASE WHEN coalesce(is_dir, false) THEN 16 ELSE 0 END AS "Attributes" FROM files WHERE """ + f"contains({NAME}, 'report')")
def export_rows(spark: SparkSession, d: str) -> DataFrame:
    return filelist.export_rows(_clocked(read(spark, d, "files")).matches("report"))


@_query("""WITH last AS (SELECT path, unnest(max(struct_pack(o := changed_ns, n := name, s := coalesce(size, 0), m := coalesce(modified, 0), c := coalesce(created, 0), d := coalesce(is_dir, false)))) FROM files WHERE path <> '' GROUP BY path)
SELECT path, n AS name, CASE WHEN NOT d AND regexp_matches(n, '^.+\\.[^.]+$') THEN lower(regexp_extract(n, '\\.([^.]+)$', 1)) ELSE '' END AS extension, s AS size, m AS modified, d AS is_dir, 'offline:filelist' AS volume_id FROM last""")
def import_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "files").select("path", "name", "size", "modified", "created", "is_dir", "changed_ns")
    return filelist.import_rows(rows, "changed_ns").select("path", "name", "extension", "size", "modified", "is_dir", "volume_id")


@_query("SELECT path, size, modified, is_dir FROM (SELECT DISTINCT path, coalesce(size, 0) AS size, coalesce(modified, 0) AS modified, coalesce(is_dir, false) AS is_dir FROM files)")
def csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Written as a list and read back."""
    path = scratch_path(spark, "list")
    out = read(spark, d, "files").select("path", "size", "modified", "is_dir")
    filelist.write_list(out, path)
    return filelist.read_list(spark, path).distinct()


_STEM = r"CASE WHEN NOT coalesce(is_dir, false) AND regexp_matches(name, '^.+\.[^.]+$') THEN regexp_extract(name, '^(.+)\.[^.]*$', 1) ELSE name END"
_DOT = r"CASE WHEN NOT coalesce(is_dir, false) AND regexp_matches(name, '^.+\.[^.]+$') THEN regexp_extract(name, '(\.[^.]*)$', 1) ELSE '' END"
_PLAN = f"""SELECT id, path, is_dir, rn - 1 AS position, 'x-' || replace({_STEM}, 'report', 'Bericht') || ' ' || CASE WHEN length(CAST(rn + 4 AS VARCHAR)) >= 4 THEN CAST(rn + 4 AS VARCHAR) ELSE lpad(CAST(rn + 4 AS VARCHAR), 4, '0') END || {_DOT} AS new_name
FROM (SELECT *, row_number() OVER (ORDER BY path, id, changed_ns) AS rn FROM (SELECT DISTINCT id, path, name, is_dir, changed_ns FROM files WHERE contains({NAME}, 'report')))"""


@_query(f"SELECT id, position, new_name FROM ({_PLAN})")
def rename_plan(spark: SparkSession, d: str) -> DataFrame:
    chosen = _clocked(read(spark, d, "files")).matches("report").select("id", "path", "name", "is_dir", "changed_ns").distinct()
    placed = renames.positions(chosen, [F.col("path"), F.col("id"), F.col("changed_ns")])
    plan = renames.rename_plan(placed, search="report", replacement="Bericht", prefix="x-", start=5, digits=4)
    return plan.select("id", F.col("position").cast("bigint").alias("position"), "new_name")


_FOLDED = _f("{0}")


@_query(f"""WITH f AS (SELECT id, unnest(arg_max(struct_pack(path := path, name := name, is_dir := is_dir), changed_ns)) FROM files GROUP BY id),
s AS (SELECT id, path, is_dir, replace({_STEM}, 'report', 'plan') || {_DOT} AS new_name, {_PARENT} AS folder FROM f),
p AS (SELECT *, CASE WHEN folder = '/' THEN '/' WHEN folder = '' THEN '' ELSE folder || '/' END || new_name AS new_path FROM s),
k AS (SELECT *, {_FOLDED.format('new_path')} AS target, {_FOLDED.format('path')} AS source FROM p),
twice AS (SELECT target FROM k GROUP BY target HAVING count(*) > 1),
dirs AS (SELECT DISTINCT path FROM k WHERE coalesce(is_dir, false)),
under AS (SELECT DISTINCT a.folder FROM (SELECT DISTINCT folder FROM k) a JOIN dirs d ON a.folder = d.path OR starts_with(a.folder, d.path || '/')),
found AS (SELECT id, CASE WHEN new_name = '' OR contains(new_name, '/') OR new_name IN ('.', '..') THEN 'invalid_name' WHEN new_path = path THEN 'no_change'
  WHEN folder IN (SELECT folder FROM under) THEN 'overlapping_sources' WHEN target IN (SELECT target FROM twice) THEN 'duplicate_target'
  WHEN coalesce(is_dir, false) AND starts_with(new_path, path || '/') THEN 'inside_itself' END AS conflict FROM k)
SELECT * FROM found WHERE conflict IS NOT NULL""")
def rename_conflicts(spark: SparkSession, d: str) -> DataFrame:
    files = read(spark, d, "files").groupBy("id").agg(F.max_by(F.struct("path", "name", "is_dir"), "changed_ns").alias("r")).select("id", "r.*")
    return renames.rename_conflicts(renames.rename_plan(files, search="report", replacement="plan"), files)


@_query("SELECT id, path FROM files WHERE (path = '/Volumes/Archive' OR starts_with(path, '/Volumes/Archive/')) AND NOT (path = '/Volumes/Archive/Photo 13' OR starts_with(path, '/Volumes/Archive/Photo 13/'))")
def scope_retain(spark: SparkSession, d: str) -> DataFrame:
    return scan.retain_scopes(read(spark, d, "files"), ["/Volumes/Archive/", "/Volumes/Archive/Photo 1"], ["/Volumes/Archive/Photo 13"]).select("id", "path")


def _changes(spark: SparkSession, d: str) -> DataFrame:
    """events as changes of one path a user; an error event takes the path away."""
    return read(spark, d, "events").select(F.concat(F.lit("/users/u"), F.col("user_id")).alias("path"), "event_id", "value", (F.col("event_type") == "error").alias("deleted"), F.when(F.col("event_type") == "signup", E.MUST_SCAN).when(F.col("event_type") == "view", E.INODE_META | E.IS_DIR).otherwise(0).cast("bigint").alias("flags"))


@_query("SELECT '/users/u' || user_id AS path, max(event_id) AS event_id, arg_max(value, event_id) AS value, arg_max(event_type = 'error', event_id) AS deleted FROM events GROUP BY user_id")
def stream_latest_state(spark: SparkSession, d: str) -> DataFrame:
    return merge.latest(_changes(spark, d).drop("flags"), ["path"], "event_id")


@_query("SELECT '/users/u' || user_id AS path FROM events GROUP BY user_id HAVING arg_max(event_type = 'error', event_id)")
def stream_tombstones(spark: SparkSession, d: str) -> DataFrame:
    return merge.latest(_changes(spark, d), ["path"], "event_id").where("deleted").select("path")


@_query("""WITH e AS (SELECT '/users/u' || user_id AS path, event_type FROM events), t AS (SELECT DISTINCT path FROM e WHERE event_type = 'signup'),
r AS (SELECT path, bool_and(event_type = 'view') AS meta FROM e WHERE event_type <> 'signup' GROUP BY path),
p AS (SELECT path, meta FROM r UNION ALL SELECT '/users', NULL FROM r)
SELECT path, 'rescan' AS action FROM t UNION ALL
SELECT path, CASE WHEN coalesce(bool_or(meta), false) THEN 'check_folder' ELSE 'refresh' END FROM p WHERE path NOT IN (SELECT path FROM t) GROUP BY path""")
def reconcile_plan(spark: SparkSession, d: str) -> DataFrame:
    return E.reconcile_plan(_changes(spark, d).select("path", "event_id", "flags"), ["/users"])


_CUR = "(SELECT * FROM files QUALIFY row_number() OVER (PARTITION BY path ORDER BY changed_ns DESC, id) = 1)"


def _by_path(spark: SparkSession, d: str) -> DataFrame:
    files = read(spark, d, "files").where("path IS NOT NULL")
    return files.groupBy("path").agg(F.min_by(F.struct(*[c for c in files.columns if c != "path"]), F.struct(-F.col("changed_ns"), F.col("id"))).alias("r")).select("path", "r.*").select(files.columns)


@_query(f"SELECT path, CASE WHEN extension = 'log' THEN size + 1 ELSE size END AS size, CASE WHEN extension = 'log' AND size IS NOT NULL THEN '{{}}' ELSE properties END AS properties FROM {_CUR} WHERE extension <> 'pdf'")
def merge_changes(spark: SparkSession, d: str) -> DataFrame:
    """All logs grow by a byte (and lose what was extracted from them), all PDFs are deleted."""
    files = _by_path(spark, d)
    seen = files.where("extension IN ('log', 'pdf')").withColumns({"deleted": F.col("extension") == "pdf", "event_id": F.col("id"), "size": F.when(F.col("extension") == "log", F.col("size") + 1).otherwise(F.col("size"))})
    return merge.apply_changes(files, seen).select("path", "size", "properties")


@_query(f"SELECT path FROM {_CUR} WHERE NOT (starts_with(path, '/Volumes/Archive/') AND NOT starts_with(path, '/Volumes/Archive/Photo 13/') AND extension = 'jpg')")
def delete_missing(spark: SparkSession, d: str) -> DataFrame:
    files = _by_path(spark, d)
    return merge.delete_missing(files, files.where("extension <> 'jpg'"), ["/Volumes/Archive"], ["/Volumes/Archive/Photo 13"]).select("path")


@_query("SELECT id, max(path) AS path FROM (SELECT o.id, f.path FROM (SELECT DISTINCT id FROM observations) o LEFT JOIN files f USING (id)) GROUP BY id")
def delta_read(spark: SparkSession, d: str) -> DataFrame:
    """What a reader of the journal gets: current rows, or nulls for what is gone."""
    return merge.delta(read(spark, d, "files").select("id", "path"), read(spark, d, "observations")).groupBy("id").agg(F.max("path").alias("path"))


@_query(f"SELECT id FROM files WHERE contains({NAME}, 'report') UNION SELECT id FROM files WHERE {EXT} = 'pdf'")
def set_union(spark: SparkSession, d: str) -> DataFrame:
    c = _clocked(read(spark, d, "files"))
    return c.matches("report").select("id").union(c.matches("ext:pdf").select("id")).distinct()


@_query(f"SELECT id FROM files WHERE contains({NAME}, 'report') INTERSECT SELECT id FROM files WHERE {EXT} = 'json'")
def set_intersect(spark: SparkSession, d: str) -> DataFrame:
    c = _clocked(read(spark, d, "files"))
    return c.matches("report").select("id").intersect(c.matches("ext:json").select("id"))


@_query(f"SELECT id FROM files WHERE contains({NAME}, 'report') EXCEPT SELECT id FROM files WHERE {EXT} = 'json'")
def set_difference(spark: SparkSession, d: str) -> DataFrame:
    c = _clocked(read(spark, d, "files"))
    return c.matches("report").select("id").subtract(c.matches("ext:json").select("id"))


@_query(f"SELECT id, path FROM files WHERE contains({NAME}, 'report')")
def generation_pin(spark: SparkSession, d: str) -> DataFrame:
    """A lease taken before a second generation is published still reads the first."""
    store = GenerationStore(spark, scratch_path(spark, "store"))
    files = read(spark, d, "files")
    store.publish(files)
    leases = Leases(store)
    key = leases.retain()
    store.publish(files.where("extension = 'pdf'"))
    return leases.get(key).matches("report").select("id", "path")


@_query(f"SELECT id, {NAME} AS search_name, {_f('name')} AS folded_name, {_natural(_f('name'))} AS name_key, CASE WHEN path IS NULL THEN NULL ELSE {_PARENT} END AS parent FROM files")
def derived_columns(spark: SparkSession, d: str) -> DataFrame:
    from quarryline.plans.model import parent_path

    return prepare(read(spark, d, "files")).select("id", "search_name", "folded_name", "name_key", parent_path(F.col("path")).alias("parent"))


def _json(name: str, kind: str) -> str:
    """A field of a JSON object in SQL, as Spark writes it."""
    if name == "properties":
        value = "CASE WHEN json_valid(properties) THEN trim(properties) ELSE 'null' END"
    elif kind == "string":
        value = f"coalesce(CAST(to_json({name}) AS VARCHAR), 'null')"
    else:
        value = f"coalesce(CAST({name} AS VARCHAR), 'null')"
    return f"""'"{name}":' || {value}"""


@_query(f"SELECT id, '{{' || {" || ',' || ".join(_json(f.name, f.dataType.simpleString()) for f in SCHEMA)} || '}}' AS \"row\" FROM files WHERE contains({NAME}, 'report')")
def json_rows(spark: SparkSession, d: str) -> DataFrame:
    """Results as JSON objects of the 18 fields, properties as the object they are."""
    return json_of(_clocked(read(spark, d, "files")).matches("report")).select("id", "row")


@_query(f"SELECT id FROM files WHERE contains({NAME}, 'report') AND NOT (starts_with(path, '/Volumes/Archive/') OR path = '/Volumes/Archive')")
def denied_hidden(spark: SparkSession, d: str) -> DataFrame:
    """Rows below a folder that can't be read any more stay in the catalogue, and no search shows them."""
    return _clocked(merge.deny(read(spark, d, "files"), ["/Volumes/Archive"])).matches("report").select("id")


@_query("SELECT doc_id FROM documents WHERE coalesce(kind, '') <> 'log' AND coalesce(lang, '') <> 'de' AND " + f"contains({TEXT}, 'catalogue')")
def follow_content(spark: SparkSession, d: str) -> DataFrame:
    """Two batches of changes, of which one deletes the logs and the other alters the German texts, whose bodies are
    unknown from then on; all other bodies are found afterwards."""
    store, source, checkpoint = GenerationStore(spark, scratch_path(spark, "store")), scratch_path(spark, "changes"), scratch_path(spark, "checkpoint")
    rows = prepare(texts(spark, d)).select([f.name for f in SCHEMA] + ["body"])
    store.publish(rows)
    lang = F.coalesce(F.element_at(F.split("path", "/"), 3), F.lit(""))
    logs = read(spark, d, "documents").where("kind = 'log'").select(F.col("doc_id").alias("id"))
    for k, (part, deleted) in enumerate(((rows.join(logs, "id", "left_semi"), True), (rows.where(lang == "de").withColumn("size", F.col("size") + 1), False))):
        changes = part.drop("body").withColumns({"deleted": F.lit(deleted), "event_id": F.lit(k + 1).cast("bigint")})
        changes.write.mode("append").parquet(source)
        merge.follow(spark.readStream.schema(changes.schema).parquet(source), store, checkpoint).awaitTermination()
    return store.catalog(clock=NOW).matches("content:catalogue").select(F.col("id").alias("doc_id"))


@_query("SELECT 50 AS event_id")
def stream_cursor(spark: SparkSession, d: str) -> DataFrame:
    """The cursor a generation keeps, after an own change has been left out."""
    store = GenerationStore(spark, scratch_path(spark, "store"))
    files = prepare(texts(spark, d)).select([f.name for f in SCHEMA])
    events = spark.createDataFrame([("/corpus/en", 50, 0), ("/index/own", 99, 0)], E.EVENT_SCHEMA)
    last = E.cursor(E.without_own(events, "/index")).first()[0]
    store.publish(files, cursor={"event_id": last, "stream": "s"})
    return spark.createDataFrame([(E.resume(store.cursor(), "s", 10, 90)[0],)], "event_id int")


@_query(f"SELECT id FROM files WHERE contains({NAME}, 'plan') AND NOT contains({PATH}, 'archive')")
def preferences_apply(spark: SparkSession, d: str) -> DataFrame:
    """Macros and exclusions that the store keeps take part in every search."""
    store = GenerationStore(spark, scratch_path(spark, "store"))
    store.publish(read(spark, d, "files"))
    store.set_preferences(Preferences(macros={"mine": "plan"}, exclusions=("path:archive",)))
    return store.catalog(clock=NOW).matches("mine:").select("id")


@_query("SELECT true AS requires_content, true AS requires_properties, true AS requires_extraction, true AS requires_relations")
def query_plan(spark: SparkSession, d: str) -> DataFrame:
    said = Catalog(read(spark, d, "files"), exclusions=["child:<title:x>"], clock=NOW).query_plan("content:a")
    return spark.createDataFrame([tuple(said.values())], ", ".join(f"{k} boolean" for k in said))


@_query("""WITH t AS (SELECT sha256(text) AS group_key, doc_id, n_chars % 7 AS clone_id FROM documents),
g AS (SELECT group_key FROM t WHERE group_key IS NOT NULL GROUP BY group_key HAVING count(DISTINCT doc_id) > 1)
SELECT group_key, 'corpus' AS volume_id, clone_id, count(DISTINCT doc_id) AS files FROM t WHERE group_key IN (SELECT group_key FROM g) AND clone_id IS NOT NULL GROUP BY group_key, clone_id HAVING count(DISTINCT doc_id) > 1""")
def clone_groups(spark: SparkSession, d: str) -> DataFrame:
    """Of equal texts those that share storage, which their length stands for here."""
    clones = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit("corpus").alias("volume_id"), (F.col("n_chars") % 7).alias("clone_id"))
    return duplicates.clone_groups(duplicates.duplicate_groups(_text_objects(spark, d), "content"), clones)


@_query("SELECT id, doc_id FROM (SELECT f.id, d.doc_id FROM files f JOIN documents d ON f.id = d.entry_id WHERE contains(" + TEXT.replace("text", "d.text") + ", 'catalogue')) GROUP BY ALL")
def content_join(spark: SparkSession, d: str) -> DataFrame:
    """Entries with the texts extracted from them, searched by those."""
    docs = read(spark, d, "documents").where("entry_id IS NOT NULL").select(F.col("entry_id").alias("id"), "doc_id", "text")
    files = read(spark, d, "files").select("id", "path", "name", "is_dir").distinct()
    content = files.join(docs, "id").select(F.concat_ws("#", "path", F.col("doc_id")).alias("path"), F.col("text").alias("body"), F.lit(None).cast("string").alias("properties"))
    named = files.join(docs.drop("text"), "id").withColumn("path", F.concat_ws("#", "path", F.col("doc_id")))
    rows = prepare(named.drop("doc_id"), content=content)
    return _clocked(rows).matches("content:catalogue").select("id", F.substring_index("path", "#", -1).cast("bigint").alias("doc_id")).distinct()


@_query(f"SELECT id, rank FROM (SELECT id, row_number() OVER (ORDER BY size DESC NULLS LAST, path, id) AS rank FROM files WHERE contains({NAME}, 'report')) WHERE rank IN (1, 5, 40)")
def selected_rows(spark: SparkSession, d: str) -> DataFrame:
    """Chosen ranks of a result, read page by page under a lease."""
    store = GenerationStore(spark, scratch_path(spark, "store"))
    store.publish(read(spark, d, "files"))
    leases = Leases(store)
    return selected_under(leases, leases.retain(), "report", [40, 1, 5], [("size", False)]).select("id", "rank")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """ext, size and content terms in natural name order: one page with ranks."""
    return Catalog(texts(spark, d, logs=True), clock=NOW).ranked("ext:txt size:>1kb content:<catalogue | index>").select("id", "path", "size", "rank")


__all__ = ["QUERIES", "SQL", "X", "flagship"]
