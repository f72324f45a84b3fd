"""File lists: CSV in and out, and the import of plain rows as an offline catalogue."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.plans.model import SCHEMA
from quarryline.plans.relations import Coverage

# The list format's columns, the folder bit, and the epoch of its 100-ns ticks.
HEADER = ("Filename", "Size", "Date Modified", "Attributes")
FOLDER_BIT, EPOCH = 16, 11_644_473_600
COLUMNS = {"filename": "path", "path": "path", "size": "size", "date modified": "modified", "modified": "modified", "attributes": "attributes"}
MAX_ROWS, MAX_FIELD, MAX_TEXT, TICKS = 2_000_000, 64 * 1024, 256 * 1024 * 1024, 100_000_000_000
PART_ROWS, PART_BYTES = 4096, 1024 * 1024
OFFLINE = "offline:filelist"
#: A list says nothing about what it doesn't name.
OFFLINE_COVERAGE = Coverage(False, ())


class ImportError_(ValueError):
    """A list that can't be taken over."""


def to_ticks(seconds: Column) -> Column:
    return (F.greatest(F.lit(-EPOCH), F.coalesce(seconds, F.lit(0))) + EPOCH) * 10_000_000


def from_ticks(value: Column) -> Column:
    """Values too large for seconds are 100-ns ticks since 1601."""
    return F.when(value > TICKS, F.floor(value / 10_000_000).cast("bigint") - EPOCH).otherwise(value)


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, modified, is_dir) of a CSV list: quoted fields may hold commas, quotes and line breaks.

    Columns are found by name in any case, and a file name or path column must be there. Rows without a
    path are skipped. A malformed record or bytes that aren't UTF-8 are an error when the rows are read. A record
    may go over several lines, so a file isn't split: lists of many rows come as many files, as `write_list` makes them.
    """
    # Read as single bytes, so that bytes that are no UTF-8 aren't replaced unseen but refused when decoded.
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', mode="FAILFAST", encoding="ISO-8859-1", quote='"')
    raw = raw.toDF(*[c.encode("iso-8859-1").decode("utf-8", "strict") if not c.isascii() else c for c in raw.columns])
    # The first name may have a byte order mark, and behind it quotes that then weren't at the field's start.
    plain = {c: c.strip().lstrip("\ufeff").strip('"').lower() for c in raw.columns}
    names = {c: COLUMNS[n] for c, n in plain.items() if n in COLUMNS}
    if "path" not in names.values():
        raise ImportError_("The list has no Filename or Path column")
    df = raw.select(*[_utf8(F.col(f"`{c}`")).alias(n) for c, n in names.items()])
    get = lambda n: F.col(n).try_cast("bigint") if n in names.values() else F.lit(None).cast("bigint")
    rows = df.select("path", get("size").alias("size"), from_ticks(get("modified")).alias("modified"), (F.coalesce(get("attributes"), F.lit(0)).bitwiseAND(FOLDER_BIT) != 0).alias("is_dir"))
    return rows.where(F.col("path").isNotNull() & (F.trim("path") != ""))


def _utf8(c: Column) -> Column:
    """The text whose bytes stand in `c` as one character each; an error if they aren't UTF-8. Plain ASCII is as it is."""
    data = F.encode(c, "ISO-8859-1")
    text = F.when(F.is_valid_utf8(data.cast("string")), data.cast("string")).otherwise(F.raise_error(F.lit("The list isn't UTF-8 text")).cast("string"))
    return F.when(c.isNull() | ~c.rlike(r"[^\x00-\x7f]"), c).otherwise(text)


def import_rows(rows: DataFrame, order: str | None = None) -> DataFrame:
    """Rows (path[, name, size, modified, created, is_dir]) as an offline catalogue.

    The name is by default what follows the last '/' or '\\'. Folders have no extension; others have theirs
    in lower case. Of rows with one path the last by `order` (by default the greatest row) counts. Ids
    number the paths in order, by digest, so an import repeated gives the same ids.
    """
    have = set(rows.columns)
    col = lambda n, t, d=None: (F.coalesce(F.col(n).cast(t), F.lit(d)) if d is not None else F.col(n).cast(t)) if n in have else F.lit(d).cast(t)
    name = F.coalesce(col("name", "string"), F.regexp_extract("path", r"([^/\\]*)[/\\]*\z", 1))
    ready = rows.where(F.col("path").isNotNull() & (F.col("path") != "")).select(
        "path", F.struct((F.col(order) if order else F.lit(0)).alias("o"), name.alias("name"), col("size", "bigint", 0).alias("size"), col("modified", "bigint", 0).alias("modified"), col("created", "bigint", 0).alias("created"), col("is_dir", "boolean", False).alias("is_dir")).alias("r"))
    last = ready.groupBy("path").agg(F.max("r").alias("r")).select("path", "r.*")
    ext = F.when(~F.col("is_dir") & F.col("name").rlike(r"(?s)\A.+\.[^.]+\z"), F.lower(F.regexp_extract("name", r"\.([^.]+)\z", 1))).otherwise("")
    values = {"id": F.xxhash64("path").bitwiseAND(F.lit(2**63 - 1)), "extension": ext, "changed": F.col("modified"), "modified_ns": F.lit(0), "changed_ns": F.lit(0), "is_symlink": F.lit(False), "file_id": F.lit(0), "parent_id": F.lit(0), "volume_id": F.lit(OFFLINE), "flags": F.lit(0), "properties": F.lit("{}"), "content_indexed": F.lit(False)}
    full = last.withColumns(values)
    return full.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMA])


def check_limits(rows: DataFrame, max_rows: int = MAX_ROWS, max_text: int = MAX_TEXT) -> None:
    """Raises if the list is larger than an import may be: one aggregate over all rows."""
    strings = [c for c, t in rows.dtypes if t == "string"]
    sizes = [F.octet_length(c) for c in strings]
    n, field, text = rows.agg(F.count(F.lit(1)), F.max(F.greatest(F.lit(0), *[F.coalesce(x, F.lit(0)) for x in sizes])), F.sum(sum((F.coalesce(x, F.lit(0)) for x in sizes), F.lit(0)))).first()
    for value, most, what in ((n, max_rows, "rows"), (field, MAX_FIELD, "bytes in a field"), (text, max_text, "bytes of text")):
        if (value or 0) > most:
            raise ImportError_(f"The list has more than {most} {what}")


def import_list(store, rows: DataFrame) -> int:
    """A list of plain rows as the store's whole catalogue: all rows are checked against the limits first, then
    written as one generation that covers what it lists and nothing else. Nothing changes if a check fails. Returns
    the generation's number."""
    check_limits(rows)
    return store.publish(import_rows(rows), OFFLINE_COVERAGE)


class StagedImport:
    """A list that comes in parts: `append` each, then `finish` or `abort`. Parts wait in the store's folder beside the
    generations, where no reader looks; finishing checks the whole and publishes it in one step."""

    def __init__(self, store):
        self.store, self.name, self.parts = store, f"staged-{uuid.uuid4().hex[:12]}", 0

    def append(self, rows: DataFrame) -> None:
        """One part, of at most PART_ROWS rows and PART_BYTES bytes of text. Later parts win over earlier ones."""
        check_limits(rows, PART_ROWS, PART_BYTES)
        rows.withColumn("_part", F.lit(self.parts)).write.parquet(f"{self.store.root}/{self.name}/part={self.parts}")
        self.parts += 1

    def finish(self) -> int:
        if not self.parts:
            raise ImportError_("Nothing was appended")
        spark = self.store.spark
        each = [spark.read.parquet(f"{self.store.root}/{self.name}/part={i}") for i in range(self.parts)]
        every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), each)
        check_limits(every.drop("_part"))
        try:
            return self.store.publish(import_rows(every, "_part"), OFFLINE_COVERAGE)
        finally:
            self.abort()

    def abort(self) -> None:
        self.store.files.delete(self.name)
        self.parts = 0


def export_pages(lease, text: str, path: str, sort=None, page: int = 10_000) -> int:
    """Writes all results of a search as a list, page by page under one lease, so that what is published meanwhile
    doesn't mix in; each page is a part file of its own. Returns the number of rows."""
    leases, key = lease
    at, total = 0, leases.get(key).count(text)
    while at < total:
        write_list(leases.get(key).query(text, sort, page, at), f"{path}/page={at // page:08d}")
        at += page
    return total


def export_rows(results: DataFrame) -> DataFrame:
    """(Filename, Size, Date Modified, Attributes) of results, in their order."""
    return results.select(F.col("path").alias(HEADER[0]), F.coalesce("size", F.lit(0)).alias(HEADER[1]), to_ticks(F.col("modified")).alias(HEADER[2]), F.when(F.coalesce("is_dir", F.lit(False)), FOLDER_BIT).otherwise(0).alias(HEADER[3]))


def write_list(results: DataFrame, path: str) -> None:
    """Writes CSV with CRLF and doubled quotes, each part file with its header, so that any of them is a
    list. An existing target is an error."""
    quote = lambda c: F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    line = F.concat_ws(",", *[quote(F.coalesce(F.col(f"`{h}`").cast("string"), F.lit(""))) for h in HEADER]).alias("value")
    export_rows(results).select(line).mapInArrow(_with_header, "value string").write.mode("error").option("lineSep", "\r\n").text(path)


def _with_header(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield pa.RecordBatch.from_pydict({"value": [",".join(HEADER)]})
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0)], ["value"])
