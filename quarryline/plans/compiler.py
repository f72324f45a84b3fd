"""From the syntax tree to a Column.

Unknown is NULL: leaves that may be unknown yield it, AND, OR and NOT are SQL's own three-valued ones,
and the root turns what is left of it to false. Which leaves may be unknown depends on the search.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions import text as X
from quarryline.lang import ast as A
from quarryline.plans.model import derived, parent_path


@dataclass(frozen=True)
class Resolved(A.Node):
    """A relation or folder metric that a join has already put into a boolean column."""

    column: str


@dataclass(frozen=True)
class Mode:
    """unknown_content, unknown_properties: such leaves are NULL where the value is missing. candidates:
    before extraction every content and property leaf is NULL, and rows are kept unless false; with
    known_properties only content leaves are."""

    unknown_content: bool = True
    unknown_properties: bool = False
    candidates: bool = False
    known_properties: bool = False


def _property(name: str) -> tuple[Column, Column]:
    value = F.try_variant_get(F.try_parse_json(F.col("properties")), f"$.{name}", "variant")
    return value, F.schema_of_variant(value)


def property_text(name: str) -> Column:
    """A JSON string property; other JSON types don't count as text."""
    value, kind = _property(name)
    return F.when(kind == "STRING", F.try_variant_get(value, "$", "string"))


def property_number(name: str) -> Column:
    """A JSON number property; a string of digits doesn't count as a number."""
    value, kind = _property(name)
    return F.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(value, "$", "double"))


class Compiler:
    def __init__(self, df: DataFrame, mode: Mode = Mode()):
        self.df, self.mode, self._exact = df, mode, True

    def column(self, node: A.Node, exact: bool = True) -> Column:
        """Three-valued. Where no NOT stands above, a filter treats false and NULL alike; then (not `exact`)
        leaves stay plain comparisons, which the scan can use."""
        outer, self._exact = self._exact, exact
        try:
            if isinstance(node, A.Everything):
                return F.lit(True)
            if isinstance(node, (A.All, A.Any)):
                parts = [self.column(p, exact) for p in dict.fromkeys(node.parts)]
                return reduce((lambda a, b: a & b) if isinstance(node, A.All) else (lambda a, b: a | b), parts, *([] if parts else [F.lit(isinstance(node, A.All))]))
            if isinstance(node, A.Not):
                return ~self.column(node.part, True)
            return self._leaf(node)
        finally:
            self._exact = outer

    def keep(self, node: A.Node) -> Column:
        """For a filter: true where the row is a result, else false or NULL."""
        return F.coalesce(self.column(node), F.lit(True)) if self.mode.candidates else self.column(node, False)

    def _known(self, c: Column) -> Column:
        return F.coalesce(c, F.lit(False)) if self._exact else c

    def _leaf(self, node: A.Node) -> Column:
        if isinstance(node, Resolved):
            return F.col(node.column)
        if isinstance(node, A.IsFolder):
            is_dir = F.coalesce(F.col("is_dir"), F.lit(False))
            return is_dir if node.yes else ~is_dir
        if isinstance(node, A.IsSymlink):
            return self._known(F.col("is_symlink"))
        if isinstance(node, A.IsHidden):
            return self._known(F.col("name").startswith(".")) | self._flags(A.HIDDEN_FLAG)
        if isinstance(node, A.HasFlags):
            return self._flags(node.mask)
        if isinstance(node, A.ExtensionIn):
            return self._known(derived(self.df, "search_extension").isin([X.fold_search(v) for v in node.values]))
        if isinstance(node, (A.Number, A.Unknown)):
            return self._number(node)
        if isinstance(node, A.Text):
            return self._text(node)
        raise TypeError(f"not a term: {node}")

    @staticmethod
    def _flags(mask: int) -> Column:
        return F.coalesce(F.col("flags").bitwiseAND(F.lit(mask)) != 0, F.lit(False))

    def _number(self, node: A.Number | A.Unknown) -> Column:
        prop = node.field in A.NUMBER_PROPERTIES
        if prop and self.mode.candidates and not self.mode.known_properties:
            return F.lit(None).cast("boolean")
        if prop:
            value = property_number(node.field)
        elif node.field == "size":
            if isinstance(node, A.Number) and not self._exact:
                return in_range(F.col("size"), node) & ~F.coalesce(F.col("is_dir"), F.lit(False))
            value = F.when(~F.coalesce(F.col("is_dir"), F.lit(False)), F.col("size"))
        else:
            value = F.col(node.field)
        if isinstance(node, A.Unknown):
            return value.isNotNull() if node.negated else value.isNull()
        inside = in_range(value, node)
        return inside if prop and self.mode.unknown_properties else self._known(inside)

    def _text(self, node: A.Text) -> Column:
        target = node.target
        if target == "content":
            if self.mode.candidates:
                return F.lit(None).cast("boolean")
            hit = self._match(node, F.col("body"), F.col("search_body") if "search_body" in self.df.columns else None)
            return hit if self.mode.unknown_content else self._known(hit)
        if target in A.TEXT_PROPERTIES:
            if self.mode.candidates and not self.mode.known_properties:
                return F.lit(None).cast("boolean")
            hit = self._match(node, property_text(target), None)
            return hit if self.mode.unknown_properties else self._known(hit)
        if target == "extension":
            return self._known(self._match(node, F.col("extension"), derived(self.df, "search_extension")))
        if target == "parent":
            return self._known(self._match(node, parent_path(F.col("path")), parent_path(derived(self.df, "search_path"))))
        return self._known(self._match(node, F.col(target), derived(self.df, f"search_{target}")))

    def _match(self, node: A.Text, raw: Column, searched: Column | None) -> Column:
        """The term against a value: as a pattern if it is one or asks for word boundaries, else literally."""
        o, content = node.options, node.target == "content"
        wild = not o.regex and o.wildcards and not content and ("*" in node.text or "?" in node.text)
        if o.regex or wild:
            source = X.nfc(node.text) if o.marks else X.strip_marks(node.text)
            source = X.wildcard(source) if wild else X.java_regex(source)
            return (X.nfc_column(raw) if o.marks else self._stripped(node, raw)).rlike(self._pattern(source, o, X.WORD_REGEX + "_" * content, flags=("" if o.case else "iu") + "dU"))
        if not o.case:
            value = X.fold_column(raw) if o.marks else searched if searched is not None else X.fold_search_column(raw)
            needle = X.fold(node.text) if o.marks else X.fold_search(node.text)
        else:
            value = X.nfc_column(raw) if o.marks else self._stripped(node, raw)
            needle = X.nfc(node.text) if o.marks else X.strip_marks(node.text)
        if o.whole:
            return value == needle
        if o.word_start or o.word_end:
            return value.rlike(self._pattern(X.quote(needle), replace(o, dot_all=False, multiline=False), X.WORD_LITERAL + "_" * content, flags="d"))
        if o.start and o.end:
            return value == needle
        return value.startswith(needle) if o.start else value.endswith(needle) if o.end else value.contains(needle)

    def _stripped(self, node: A.Text, raw: Column) -> Column:
        """The value without marks, as a generation stores it for names and paths."""
        stored = f"stripped_{node.target}"
        return F.col(stored) if stored in self.df.columns else X.stripped_column(raw)

    @staticmethod
    def _pattern(source: str, o: A.Options, word: str, flags: str) -> str:
        if o.whole:
            source = rf"\A(?:{source})\z"
        else:
            source = rf"\A(?:{source})" if o.start else source
            source = rf"(?:{source})\z" if o.end else source
            source = rf"(?<![{word}])(?:{source})" if o.word_start else source
            source = rf"(?:{source})(?![{word}])" if o.word_end else source
        return f"(?{flags}{'s' * o.dot_all}{'m' * o.multiline}){source}"


def in_range(value: Column, n: A.Number) -> Column:
    """Compared as doubles, as all numbers of a search are. Where every bound is a whole number below
    2^53, comparing whole numbers gives the same and lets the bound reach the scan."""
    low = [value >= _bound(n.low) if n.with_low else value > _bound(n.low)] if n.low != -math.inf else []
    high = [value <= _bound(n.high) if n.with_high else value < _bound(n.high)] if n.high != math.inf else []
    inside = reduce(lambda a, b: a & b, low + high) if low or high else value.isNotNull()
    return ~inside if n.negated else inside


def _bound(x: float) -> Column:
    return F.lit(int(x)) if x == int(x) and abs(x) < 2**53 else F.lit(x)
