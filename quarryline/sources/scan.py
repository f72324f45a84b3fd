"""Scopes, scans and text extraction: how rows and bodies come into a catalogue."""

from __future__ import annotations

import os
import re
import stat
import zipfile
from collections.abc import Iterator, Sequence
from functools import reduce
from io import BytesIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.plans.model import SCHEMA

#: Bytes of a file that text is taken from.
MAX_BODY = 32 * 1024 * 1024
BODY_TYPES = frozenset("txt md csv tsv log json xml yaml yml toml ini html htm css js ts py rs swift c h cpp hpp java go rb sh sql".split())


def compact_scopes(roots: Sequence[str]) -> list[str]:
    """Absolute scopes without doubled or trailing slashes, those inside others left out, in order."""
    clean = sorted({re.sub(r"/+", "/", r).rstrip("/") or "/" for r in roots if r})
    out: list[str] = []
    for r in clean:
        if not any(o == "/" or r == o or r.startswith(f"{o}/") for o in out):
            out.append(r)
    return out


def in_scopes(path: Column, roots: Sequence[str]) -> Column:
    """Ranges on the path, which Parquet statistics can use: the root, or from 'root/' up to 'root0'."""
    one = lambda r: F.lit(True) if r == "/" else (path == r) | ((path >= f"{r}/") & (path < f"{r}0"))
    return reduce(lambda a, b: a | b, map(one, compact_scopes(roots)), F.lit(False))


def retain_scopes(files: DataFrame, roots: Sequence[str], excluded: Sequence[str] = ()) -> DataFrame:
    return files.where(in_scopes(F.col("path"), roots) & ~in_scopes(F.col("path"), excluded))


def _entry(path: str, found: os.stat_result) -> dict:
    name = path.rsplit("/", 1)[-1]
    folder = stat.S_ISDIR(found.st_mode)
    ext = name.rpartition(".")
    row = dict.fromkeys([f.name for f in SCHEMA])
    row |= {"path": path, "name": name, "extension": "" if folder or not ext[0] else ext[2].lower(), "size": found.st_size, "modified": int(found.st_mtime), "created": int(found.st_ctime), "changed": int(found.st_ctime), "modified_ns": found.st_mtime_ns, "changed_ns": found.st_ctime_ns}
    return row | {"is_dir": folder, "is_symlink": stat.S_ISLNK(found.st_mode), "file_id": found.st_ino, "volume_id": str(found.st_dev), "flags": getattr(found, "st_flags", 0), "properties": "{}", "content_indexed": False}


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for folder in b["path"].to_pylist():
            try:
                parent = os.lstat(folder).st_ino
                with os.scandir(folder) as found:
                    for e in found:
                        rows.append(_entry(e.path, e.stat(follow_symlinks=False)) | {"parent_id": parent, "error": None})
            except OSError as x:
                rows.append({"path": folder, "error": x.strerror})
        yield pa.RecordBatch.from_pylist(rows, schema=_arrow_schema())


_DDL = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in SCHEMA) + ", error string"


def _arrow_schema() -> pa.Schema:
    return pa.schema([(f.name, {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[f.dataType.simpleString()]) for f in SCHEMA] + [("error", pa.string())])


def scan(spark: SparkSession, roots: Sequence[str], excluded: Sequence[str] = (), tasks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(entries, uncovered): what lies below the roots, level by level, each level listed by many tasks.

    For file systems that all executors mount. Symbolic links aren't followed. Folders that can't be read
    are uncovered: (path, error). Ids are digests of paths.
    """
    for entries, uncovered, _ in scan_levels(spark, roots, excluded, tasks):
        pass
    return entries, uncovered


def scan_levels(spark: SparkSession, roots: Sequence[str], excluded: Sequence[str] = (), tasks: int | None = None) -> Iterator[tuple[DataFrame, DataFrame, bool]]:
    """As `scan`, after each level what is known by then, and whether that is all."""
    from quarryline.common import materialize

    level = spark.createDataFrame([(r,) for r in compact_scopes(roots)], "path string")
    out: list[DataFrame] = []
    while True:
        listed = materialize(level.repartition(tasks or spark.sparkContext.defaultParallelism).mapInArrow(_list, _DDL), "scan")
        out.append(listed)
        level = listed.where("error IS NULL AND is_dir AND NOT is_symlink").where(~in_scopes(F.col("path"), excluded)).select("path")
        done = level.isEmpty()
        every = reduce(DataFrame.unionAll, out)
        entries = every.where("error IS NULL").where(~in_scopes(F.col("path"), excluded)).drop("error").withColumn("id", F.xxhash64("path").bitwiseAND(F.lit(2**63 - 1)))
        yield entries, every.where("error IS NOT NULL").select("path", "error"), done
        if done:
            return


def _look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for path in b["path"].to_pylist():
            try:
                rows.append(_entry(path, os.lstat(path)) | {"parent_id": os.lstat(os.path.dirname(path) or "/").st_ino, "error": None})
            except FileNotFoundError:
                rows.append({"path": path, "error": GONE})
            except OSError as x:
                rows.append({"path": path, "error": x.strerror})
        yield pa.RecordBatch.from_pylist(rows, schema=_arrow_schema())


GONE = "gone"


def stat_paths(paths: DataFrame, tasks: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries, gone, uncovered) of single paths, without listing folders: what a change event asks for.

    `paths` has a `path` column. gone: (path) of what isn't there any more. uncovered: (path, error) of what
    couldn't be looked at.
    """
    from quarryline.common import materialize

    spark = paths.sparkSession
    seen = materialize(paths.select("path").where("path IS NOT NULL").distinct().repartition(tasks or spark.sparkContext.defaultParallelism).mapInArrow(_look, _DDL), "stat")
    entries = seen.where("error IS NULL").drop("error").withColumn("id", F.xxhash64("path").bitwiseAND(F.lit(2**63 - 1)))
    return entries, seen.where(F.col("error") == GONE).select("path"), seen.where(F.col("error") != GONE).select("path", "error")


def carry_out(plan: DataFrame, tasks: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries, gone, uncovered) of a reconcile plan (path, action): paths to refresh are looked at one by one,
    subtrees to rescan are listed with all below them. What a rescan no longer finds is left to `delete_missing`
    over its roots. The driver holds the paths to rescan, which a plan keeps apart from one another."""
    spark = plan.sparkSession
    entries, gone, uncovered = stat_paths(plan.where("action <> 'rescan'"), tasks)
    roots = [r["path"] for r in plan.where("action = 'rescan'").select("path").collect()]
    if roots:
        own, lost, failed = stat_paths(spark.createDataFrame([(r,) for r in roots], "path string"), tasks)
        below, unread = scan(spark, [r for r in roots if os.path.isdir(r)], tasks=tasks)
        entries, gone, uncovered = entries.unionByName(own).unionByName(below), gone.unionByName(lost), uncovered.unionByName(failed).unionByName(unread)
    return entries, gone, uncovered


def decode(data: bytes) -> str | None:
    """Text of a file: UTF-8, else UTF-16 with a byte order mark; none if it has NULs or neither decodes."""
    for encoding in ("utf-8-sig", "utf-16") if data[:2] not in (b"\xff\xfe", b"\xfe\xff") else ("utf-16",):
        try:
            s = data.decode(encoding)
            return None if "\0" in s else s
        except UnicodeDecodeError:
            continue
    return None


#: What is read directly where nothing was extracted: plain text, and this many bytes at most.
MAX_DIRECT = 16 * 1024 * 1024


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        bodies = []
        for path, size, modified in zip(*(b[c].to_pylist() for c in ("path", "size", "modified_ns"))):
            body = None
            try:
                with open(path, "rb") as f:
                    now = os.fstat(f.fileno())
                    if stat.S_ISREG(now.st_mode) and now.st_size == size <= MAX_DIRECT and now.st_mtime_ns == modified:
                        body = decode(f.read(MAX_DIRECT + 1))
            except OSError:
                pass
            bodies.append(body)
        yield pa.RecordBatch.from_arrays([b["path"], pa.array(bodies, pa.string())], ["path", "body"])


def read_direct(entries: DataFrame) -> DataFrame:
    """(path, body) of entries without extracted content, read where they lie if they are of a kind of plain text, not
    larger than MAX_DIRECT and still in the state the entry tells (size, modified_ns); else body is null."""
    plain = entries.where(~F.coalesce("is_dir", F.lit(False)) & F.col("extension").isin(sorted(BODY_TYPES)))
    return plain.select("path", "size", "modified_ns").mapInArrow(_read, "path string, body string")


def volumes(spark: SparkSession, table: str = "/proc/self/mounts") -> DataFrame:
    """(volume_id, path, filesystem, root_file_id): what is mounted on the driver's machine."""
    rows = []
    with open(table) as f:
        for line in f:
            _, path, kind, *_ = line.split()
            path = path.encode().decode("unicode_escape").encode("latin-1").decode("utf-8", "replace")
            try:
                found = os.lstat(path)
                rows.append((str(found.st_dev), path, kind, found.st_ino))
            except OSError:
                continue
    return spark.createDataFrame(rows, "volume_id string, path string, filesystem string, root_file_id bigint")


def office(data: bytes) -> str | None:
    """Text of a docx, xlsx or pptx: the text nodes of its parts, in order. A part with a DTD is refused."""
    try:
        with zipfile.ZipFile(BytesIO(data)) as z:
            number = lambda n: [int(x) for x in re.findall(r"\d+", n)]
            parts = sorted((n for n in z.namelist() if re.fullmatch(r"word/document\.xml|xl/sharedStrings\.xml|ppt/slides/slide\d+\.xml", n)), key=number)
            out = []
            for n in parts:
                xml = z.read(n).decode("utf-8")
                if "<!DOCTYPE" in xml:
                    return None
                xml = re.sub(r"</(?:w:p|a:p|si)>", "\n", xml)
                texts = re.findall(r"<(?:w:t|a:t|t)(?:\s[^>]*)?>([^<]*)</(?:w:t|a:t|t)>|(\n)", xml)
                out.append("".join(a or b for a, b in texts))
            return "\n".join(out) if parts else None
    except (zipfile.BadZipFile, UnicodeDecodeError, KeyError):
        return None


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from html import unescape

    for b in batches:
        bodies = []
        for p, d in zip(b["path"].to_pylist(), b["content"].to_pylist()):
            ext = p.rpartition(".")[2].lower()
            text = office(d) if ext in ("docx", "xlsx", "pptx") else decode(d) if ext in BODY_TYPES or "." not in p.rpartition("/")[2] else None
            bodies.append(unescape(text) if text and ext in ("docx", "xlsx", "pptx") else text)
        yield pa.RecordBatch.from_arrays([b["path"], pa.array(bodies, pa.string())], ["path", "body"])


def extract_bodies(spark: SparkSession, glob: str) -> DataFrame:
    """(path, body) of the files below `glob`; body is null where there is no text or the file is too large."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(glob)
    path = F.regexp_replace("path", "^file:/+", "/").alias("path")
    read = raw.where(F.col("length") <= MAX_BODY).select(path, "content").mapInArrow(_extract, "path string, body string")
    return read.unionByName(raw.where(F.col("length") > MAX_BODY).select(path, F.lit(None).cast("string").alias("body")))
