"""The search engine over a catalogue: queries, pages, plans, folder information."""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.lang import ast as A
from quarryline.lang.ast import QueryError
from quarryline.lang.parser import parse
from quarryline.lang.values import Clock
from quarryline.plans import ordering
from quarryline.plans.compiler import Compiler, Mode
from quarryline.plans.relations import Coverage, folder_metrics, is_folder, resolve
from quarryline.sources.scan import in_scopes

DEFAULT_LIMIT, MAX_LIMIT, MAX_QUERY, MAX_INFO = 200, 10_000, 16 * 1024, 200
#: Pages that begin further down are found by ranges of the order instead of a merged top of all tasks.
DEEP = 50_000
Sort = Sequence[tuple[str, bool]] | None

# Saved searches that come with the engine.
BUILT_IN = {
    "all": "", "documents": "ext:pdf;doc;docx;txt;md;rtf;odt;pages", "images": "ext:jpg;jpeg;png;gif;heic;tif;tiff;webp;svg", "audio": "ext:mp3;m4a;wav;flac;aac;ogg",
    "video": "ext:mp4;mov;mkv;avi;webm", "archives": "ext:zip;gz;tar;7z;rar;bz2;xz", "code": "ext:py;rs;swift;c;cpp;h;js;ts;go;java", "folders": "folder:", "large files": "size:>100mb", "recent": "dm:7days",
}


@dataclass(frozen=True)
class Page:
    rows: DataFrame
    total: int
    offset: int


@dataclass
class Catalog:
    """A catalogue's rows with what every query is read under. `rows` has the columns of plans.model. Rows that are
    known but not `accessible` (in folders that couldn't be read any more) are in no result and no count."""

    rows: DataFrame
    macros: Mapping[str, str] = field(default_factory=dict)
    exclusions: Sequence[str] = ()
    coverage: Coverage = Coverage()
    clock: Clock | None = None

    def __post_init__(self) -> None:
        self._orders: dict[tuple, ordering.Order] = {}
        if "accessible" in self.rows.columns:
            self.rows = self.rows.where(F.coalesce("accessible", F.lit(True)))

    def _clock(self) -> Clock:
        return self.clock or Clock(time.time())

    def tree(self, text: str) -> A.Node:
        if len(text.encode("utf-8", "surrogatepass")) > MAX_QUERY:
            raise QueryError(f"The search is longer than {MAX_QUERY} bytes")
        return parse(text, self.macros, self._clock())

    def _kept(self, node: A.Node, df: DataFrame, candidates: bool = False) -> tuple[F.Column, DataFrame]:
        """The condition of a search and the rows with what it needs joined. With relations, properties may
        be unknown as well, but not where an outer content term meets a missing body."""
        wants = A.needs(node)
        if candidates and wants.relations:
            return F.lit(True), df
        outer_content = A.needs(node, inside=False).content
        node, df = resolve(df, node, self.coverage) if wants.relations else (node, df)
        if candidates:
            return Compiler(df, Mode(candidates=True)).keep(node), df
        if "body" not in df.columns:
            df = df.withColumn("body", F.lit(None).cast("string"))
        if not wants.relations:
            return Compiler(df).keep(node), df
        full = Compiler(df, Mode(unknown_properties=True))
        if not outer_content:
            return full.keep(node), df
        return F.when(F.col("body").isNull(), Compiler(df).column(node)).otherwise(full.column(node)), df

    def matches(self, text: str) -> DataFrame:
        """All rows that `text` finds and no exclusion drops; an exclusion that is unknown drops nothing."""
        df, columns = self.rows, self.rows.columns
        keep, df = self._kept(self.tree(text), df)
        for e in self.exclusions:
            drop, df = self._kept(self.tree(e), df)
            keep = keep & ~F.coalesce(drop, F.lit(False))
        return df.where(keep).select(columns)

    def content_candidates(self, text: str) -> DataFrame:
        """Rows that may match once their content and properties are known; exclusions don't apply."""
        columns = self.rows.columns
        keep, df = self._kept(self.tree(text), self.rows, candidates=True)
        return df.where(keep).select(columns)

    def may_match_without_content(self, text: str) -> DataFrame:
        """Rows that may match whatever their bodies turn out to be; properties are taken as they are."""
        node, columns, df = self.tree(text), self.rows.columns, self.rows
        if A.needs(node).relations:
            node, df = resolve(df, node, self.coverage)
        return df.where(Compiler(df, Mode(candidates=True, known_properties=True)).keep(node)).select(columns)

    def query(self, text: str, sort: Sort = None, limit: int = DEFAULT_LIMIT, offset: int = 0) -> DataFrame:
        """One page of results in order. At most 10,000 rows; `count` has the total."""
        limit, offset = max(0, min(limit, MAX_LIMIT)), max(0, offset)
        if offset > DEEP:
            # An order once made serves all further pages of this catalogue's rows.
            key = (text, None if sort is None else tuple(map(tuple, sort)))
            if key not in self._orders:
                self._orders[key] = ordering.Order(self.matches(text), sort)
            return self._orders[key].page(offset, limit)
        return ordering.ordered(self.matches(text), sort).offset(offset).limit(limit)

    def ranked(self, text: str, sort: Sort = None, limit: int = DEFAULT_LIMIT, offset: int = 0) -> DataFrame:
        """A page with each row's 1-based `rank` in the whole result. The numbering sees the page only."""
        return self.numbered(self.query(text, sort, limit, offset), sort, max(0, offset))

    @staticmethod
    def numbered(page: DataFrame, sort: Sort = None, offset: int = 0) -> DataFrame:
        """A page's rows, at most 10,000, with their `rank`."""
        w = Window.partitionBy(F.lit(1)).orderBy(*ordering.directed(ordering.sort_keys(page, sort)))
        return page.withColumn("rank", F.row_number().over(w) + F.lit(offset))

    def count(self, text: str) -> int:
        return self.matches(text).count()

    def page_at(self, text: str, path: str, row_id: int | None = None, before: int = 0, sort: Sort = None, limit: int = DEFAULT_LIMIT, offset: int = 0) -> Page:
        """The page that begins `before` rows ahead of the row at `path`. If that row isn't found any more,
        the page at `offset`, or the last one. The row is found by its path; `row_id` only breaks ties. The page is
        read from the row's keys on, so its cost doesn't depend on how far down it is."""
        found, limit = self.matches(text), max(0, min(limit, MAX_LIMIT))
        total = found.count()
        keys = ordering.sort_keys(found, sort)
        same = found.where(F.col("path") == path)
        if row_id is not None:
            same = same.orderBy((F.col("id") != row_id).asc(), "id")
        anchor = same.select(*[k.alias(f"k{i}") for i, (k, _) in enumerate(keys)]).limit(1).collect()
        if not anchor:
            at = min(max(offset, 0), max(total - max(limit, 1), 0))
            return Page(self.query(text, sort, limit, at), total, at)
        ahead = ordering.before(found, list(anchor[0]), sort)
        rank = found.where(ahead).count()
        lead = min(before, rank, MAX_LIMIT)
        first = found.where(ahead).orderBy(*ordering.directed(keys, backwards=True)).limit(lead)
        rest = ordering.ordered(found.where(~ahead), sort).limit(limit)
        return Page(ordering.ordered(first.unionByName(rest), sort).limit(limit), total, rank - lead)

    def query_plan(self, text: str) -> dict[str, bool]:
        """What has to be at hand for `text` with its macros and the exclusions."""
        n = A.needs(self.tree(text))
        for e in self.exclusions:
            n |= A.needs(self.tree(e))
        return {"requires_content": n.content, "requires_properties": n.properties, "requires_extraction": n.content or n.properties, "requires_relations": n.relations}

    def directory_info(self, paths: Sequence[str]) -> DataFrame:
        """One row for each asked path, in order and with repeats: (position, path, complete, recursive_size,
        indexed_logical_size, child_count, descendant_count, reason). recursive_size is null if incomplete."""
        if len(paths) > MAX_INFO:
            raise QueryError(f"More than {MAX_INFO} paths asked at once")
        asked = self.rows.sparkSession.createDataFrame(list(enumerate(paths)), "position int, path string")
        known = folder_metrics(self.rows.where(in_scopes(F.col("path"), paths)))
        j = asked.join(known.select("path", "foldersize", "childcount", "descendantcount", F.lit(True).alias("_is")), "path", "left")
        there = F.coalesce("_is", F.lit(False))
        complete = there & self.coverage.covers(F.col("path"))
        return j.select("position", "path", complete.alias("complete"), F.when(complete, F.col("foldersize")).alias("recursive_size"), F.col("foldersize").alias("indexed_logical_size"), F.when(there, F.col("childcount")).alias("child_count"), F.when(there, F.col("descendantcount")).alias("descendant_count"), F.when(~there, "not_an_indexed_directory").alias("reason"))

    def folders(self) -> DataFrame:
        return self.rows.where(is_folder(self.rows))
