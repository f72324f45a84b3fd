"""Text functions of the search: the two folds, the natural sort key, patterns for the JVM.

Each function comes as plain Python (for constants on the driver, and as what the columns are tested
against) and as a column. ASCII values never leave the JVM; only the others go to Python, in Arrow batches.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.lang.ast import QueryError


def strip_marks(s: str) -> str:
    """Decomposed, without combining marks of any class."""
    return s if s.isascii() else "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c)[0] != "M")


def nfc(s: str) -> str:
    return unicodedata.normalize("NFC", s)


def fold(s: str) -> str:
    """Case goes, accents stay: for sorting and `diacritics:`."""
    return s.lower() if s.isascii() else nfc(s).casefold()


def fold_search(s: str) -> str:
    """Case and accents go: how text terms compare unless told otherwise."""
    return s.lower() if s.isascii() else nfc(strip_marks(s)).casefold()


@lru_cache(maxsize=65_536)
def _kept(function: str, part: str) -> str:
    return globals()[function](part)


def _column(function: Callable[[str], str], ascii_form: Callable[[Column], Column], ascii_part: Callable[[str], str]) -> Callable[[Column | str], Column]:
    name = function.__name__

    def part(p: str) -> str:
        return ascii_part(p) if p.isascii() else _kept(name, p) if len(p) <= 256 else function(p)

    def batch(s: pd.Series) -> pd.Series:
        # No mark composes with '/', so paths fold part by part, and most parts repeat.
        return pd.Series([None if x is None else "/".join(map(part, x.split("/"))) for x in s], dtype=object)

    udf = F.pandas_udf(batch, T.StringType())

    def column(c: Column | str) -> Column:
        c = F.col(c) if isinstance(c, str) else c
        other = c.rlike(r"[^\x00-\x7f]")
        return F.when(~other, ascii_form(c)).when(other, udf(F.when(other, c)))

    return column


fold_column = _column(fold, F.lower, str.lower)
fold_search_column = _column(fold_search, F.lower, str.lower)
stripped_column = _column(strip_marks, lambda c: c, str)
nfc_column = _column(nfc, lambda c: c, str)


def natural_key(folded: Column) -> Column:
    """Sorts runs of digits by value: each becomes its length, then itself, without leading zeros."""
    runs = F.regexp_extract_all(folded, F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    digits = lambda t: F.ltrim(t, F.lit("0"))
    return F.array_join(F.transform(runs, lambda t: F.when(t.rlike("^[0-9]"), F.concat(F.lpad(F.length(digits(t)).cast("string"), 5, "0"), digits(t))).otherwise(t)), "")


def natural_key_of(s: str) -> str:
    return "".join(f"{len(t.lstrip('0')):05d}{t.lstrip('0')}" if t[0] in "0123456789" else t for t in re.findall(r"[0-9]+|[^0-9]+", fold(s)))


# What may stand beside a word, in literal and in regex terms.
WORD_LITERAL, WORD_REGEX = r"\p{IsAlphabetic}\p{N}\p{M}", r"\p{L}\p{N}\p{M}"


def java_regex(source: str) -> str:
    """A Perl-style pattern for java.util.regex; raises QueryError for what that engine can't do."""
    for bad, what in ((r"\(\?(?:R|\d+|&\w+|P>\w+)\)", "recursion"), (r"\(\?\(", "conditionals"), (r"\(\*[A-Z]", "verbs"), (r"\(\?\|", "branch reset"), (r"\(\?C", "callouts")):
        if re.search(rf"(?<!\\){bad}", source):
            raise QueryError(f"Unsupported regular expression: {what}")
    if re.search(r"(?<!\\)(?:\\\\)*\\K", source):
        raise QueryError("Unsupported regular expression: \\K")
    source = re.sub(r"\(\?P<(?=\w)", "(?<", source)
    source = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", source)
    return re.sub(r"\\g\{?(\d+)\}?", r"\\\1", source)


def wildcard(text: str) -> str:
    """'*' and '?' within one path part, over the whole value."""
    return r"\A(?:" + "".join({"*": "[^/]*", "?": "[^/]"}.get(c) or quote(c) for c in text) + r")\z"


def quote(s: str) -> str:
    return re.sub(r"([^\w\s]|_)", lambda m: "\\" + m[0] if m[0].isascii() and m[0] != "_" else m[0], s)
