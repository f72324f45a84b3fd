"""Text that looks the same, brought to one consistent spelling.

Each string is decomposed; invisible characters go, spaces, full-width forms, ligatures and hyphens get
their plain form, and marks on one letter a fixed order. What is left to decide is the script of letters
that have the same shape in several. For each token (a run of letters and marks) the script sets of its
letters are intersected, where a letter with look-alikes offers the scripts of all of them. If Latin
remains, the token is spelled in Latin (a token wholly in another script that could be Latin too is a
whole-script confusable); else in the script that remains; if none does, the token really mixes scripts,
and every such letter takes its Latin shape. The choice depends on shapes only, so two strings of the
same look always get the same spelling.

Shapes of widespread scripts are a fixed table; those of all other letters are taken, when a query starts, from
the Unicode confusables that the JVM's Unicode library has, and go to the tasks with the code.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable
from functools import lru_cache
from string import ascii_letters

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.common import current_rows, materialize
from quarryline.operators.skew import fragment_replicate_join, plan_by_load

# Letters with the shape of a basic Latin letter, by script.
SHAPES = {
    "Cyrl": {"a": "а", "c": "с", "d": "ԁ", "e": "е", "h": "һ", "i": "і", "j": "ј", "l": "ӏ", "o": "о", "p": "р", "q": "ԛ", "s": "ѕ", "v": "ѵ", "w": "ԝ", "x": "х", "y": "уү",
             "A": "А", "B": "В", "C": "С", "E": "Е", "G": "Ԍ", "H": "Н", "I": "ІӀ", "J": "Ј", "K": "К", "M": "М", "O": "О", "P": "Р", "Q": "Ԛ", "S": "Ѕ", "T": "Т", "V": "Ѵ", "W": "Ԝ", "X": "Х", "Y": "УҮ"},
    "Grek": {"a": "α", "c": "ϲ", "i": "ι", "j": "ϳ", "o": "ο", "p": "ρ", "u": "υ", "v": "ν",
             "A": "Α", "B": "Β", "C": "Ϲ", "E": "Ε", "F": "Ϝ", "H": "Η", "I": "Ι", "J": "Ϳ", "K": "Κ", "M": "ΜϺ", "N": "Ν", "O": "Ο", "P": "Ρ", "T": "Τ", "X": "Χ", "Y": "Υ", "Z": "Ζ"},
    "Armn": {"g": "ց", "h": "հ", "n": "ո", "o": "օ", "q": "զ", "u": "ս", "L": "Լ", "O": "Օ", "S": "Տ", "U": "Ս"},
    "Copt": {"o": "ⲟ", "p": "ⲣ", "c": "ⲥ", "C": "Ⲥ", "H": "Ⲏ", "I": "Ⲓ", "K": "Ⲕ", "M": "Ⲙ", "N": "Ⲛ", "O": "Ⲟ", "P": "Ⲣ", "T": "Ⲧ", "X": "Ⲭ", "Y": "Ⲩ"},
    "Cher": {"A": "Ꭺ", "B": "Ᏼ", "C": "Ꮯ", "D": "Ꭰ", "E": "Ꭼ", "G": "Ꮐ", "H": "Ꮋ", "J": "Ꭻ", "K": "Ꮶ", "L": "Ꮮ", "M": "Ꮇ", "P": "Ꮲ", "R": "Ꭱ", "S": "Ꮪ", "T": "Ꭲ", "V": "Ꮩ", "W": "Ꮃ", "Y": "Ꮍ", "Z": "Ꮓ"},
    "Lisu": {"A": "ꓮ", "B": "ꓐ", "C": "ꓚ", "D": "ꓓ", "E": "ꓰ", "F": "ꓝ", "G": "ꓖ", "H": "ꓧ", "I": "ꓲ", "J": "ꓙ", "K": "ꓗ", "L": "ꓡ", "M": "ꓟ", "N": "ꓠ", "O": "ꓳ", "P": "ꓑ", "R": "ꓣ", "S": "ꓢ", "T": "ꓔ", "U": "ꓴ", "V": "ꓦ", "W": "ꓪ", "X": "ꓫ", "Y": "ꓬ", "Z": "ꓜ"},
}
# Hyphens of the shape of '-'.
HYPHENS = "‐‑﹣"
# Scripts told apart, and the writing systems that join several of them.
SCRIPTS = "Latn Cyrl Grek Armn Hebr Arab Syrc Thaa Deva Beng Guru Gujr Orya Taml Telu Knda Mlym Sinh Thai Laoo Tibt Mymr Geor Ethi Cher Lisu Khmr Mong Copt Goth Hani Hira Kana Hang Bopo".split()
SYSTEMS = {"Hani": ("Jpan", "Kore", "Hanb"), "Hira": ("Jpan",), "Kana": ("Jpan",), "Hang": ("Kore",), "Bopo": ("Hanb",)}

#: The tables in use: the Latin shape of a letter, the scripts that have a shape, and a script's letters by shape.
_SHAPE_OF: dict[str, str] = {}
_OFFERS: dict[str, frozenset[str]] = {}
_BY_SHAPE: dict[str, dict[str, str]] = {}
_ADOPTED: tuple | None = None
_IGNORABLE = regex.compile(r"\p{Default_Ignorable_Code_Point}")
_BY_SCRIPT = [(s, regex.compile(rf"\p{{scx={s}}}")) for s in SCRIPTS]
_COMMON = regex.compile(r"[\p{scx=Common}\p{scx=Inherited}]")
_TOKEN = regex.compile(r"[\p{L}\p{M}]+")
_MARKS = regex.compile(r"[\p{Mn}\p{Me}]{2,}")


class _Plain(dict):
    """What a single character becomes before scripts are looked at; filled as characters turn up."""

    def __missing__(self, code: int) -> str:
        ch, out = chr(code), chr(code)
        kind, _, rest = unicodedata.decomposition(ch).partition(" ")
        if _IGNORABLE.match(ch):
            out = ""
        elif unicodedata.category(ch) == "Zs":
            out = " "
        elif ch in HYPHENS:
            out = "-"
        elif kind in ("<wide>", "<narrow>") or kind == "<compat>" and "LIGATURE" in unicodedata.name(ch, ""):
            out = "".join(chr(int(x, 16)) for x in rest.split())
        self[code] = out
        return out


_PLAIN = _Plain()


@lru_cache(maxsize=None)  # one entry a character
def scripts(ch: str) -> frozenset[str] | None:
    """The scripts (and writing systems) a letter may belong to; None for marks and letters of all scripts."""
    if _COMMON.match(ch):
        return None
    found = {s for s, p in _BY_SCRIPT if p.match(ch)} or {unicodedata.name(ch, "?").split()[0]}
    return frozenset(found | {w for s in found for w in SYSTEMS.get(s, ())})


def adopt(more: tuple[tuple[str, str], ...] = ()) -> None:
    """From now on this process takes the letters of `more` (letter, Latin letter) for look-alikes, beside the table's."""
    global _ADOPTED
    if more == _ADOPTED:
        return
    for table in (_SHAPE_OF, _OFFERS, _BY_SHAPE):
        table.clear()
    fixed = [(script, c, latin) for script, forms in SHAPES.items() for latin, chars in forms.items() for c in chars]
    known = {c for _, c, _ in fixed}
    for script, c, latin in [*fixed, *((s, c, latin) for c, latin in more if c not in known for s in sorted(scripts(c) or ()))]:
        _SHAPE_OF[c] = latin
        _OFFERS[latin] = _OFFERS.get(latin, frozenset({"Latn"})) | {script}
        _BY_SHAPE.setdefault(script, {}).setdefault(latin, c)
    _fold.cache_clear()
    _ADOPTED = more


@lru_cache(maxsize=1)
def confusables(spark: SparkSession) -> tuple[tuple[str, str], ...]:
    """(letter, basic Latin letter of its shape), some hundreds, for letters of all other scripts, by the Unicode
    library's skeletons of confusables. Where it takes l and I for one, capitals become I and others l."""
    checker = getattr(spark._jvm.com.ibm.icu.text, "SpoofChecker$Builder")().build()
    latin = {}
    for c, skeleton in zip(ascii_letters, checker.getSkeleton("\n".join(ascii_letters)).split("\n")):
        latin.setdefault(skeleton, []).append(c)
    letters = [c for c in map(chr, range(0x80, 0x20000)) if unicodedata.category(c) in ("Lu", "Ll", "Lo") and not unicodedata.decomposition(c)]
    out = []
    for c, skeleton in zip(letters, checker.getSkeleton("\n".join(letters)).split("\n")):
        found = latin.get(skeleton)
        if found and "Latn" not in (scripts(c) or ()):
            out.append((c, found[0] if len(found) == 1 or unicodedata.category(c) != "Lu" else found[1]))
    return tuple(out)


def resolve(token: str) -> tuple[str, str]:
    """(consistent spelling, finding) of a token; findings: single, mixed, whole_script, unresolved.

    mixed: its letters share no script, but a spelling in one script exists. whole_script: all are of one
    other script but could be Latin. unresolved: no single script can spell it.
    """
    own: frozenset[str] | None = None
    can: frozenset[str] | None = None
    shapes = [_SHAPE_OF.get(c, c) for c in token]
    for c, shape in zip(token, shapes):
        s = scripts(c)
        if s is not None:
            own = s if own is None else own & s
        o = _OFFERS.get(shape) or s
        if o is not None:
            can = o if can is None else can & o
    if can is None:
        return token, "single"
    if "Latn" in can:
        spelled = "".join(shapes)
        return spelled, "single" if own and "Latn" in own else "whole_script" if own else "mixed"
    target = next((s for s in sorted(can) if s in _BY_SHAPE), None)
    if target is None:
        return ("".join(shapes), "unresolved") if not can else (token, "single" if own else "mixed")
    return "".join(_BY_SHAPE[target].get(s, c) if s in _OFFERS else c for c, s in zip(token, shapes)), "single" if own else "mixed"


@lru_cache(maxsize=100_000)
def _fold(part: str) -> str:
    s = unicodedata.normalize("NFD", unicodedata.normalize("NFD", part).translate(_PLAIN))
    s = _MARKS.sub(lambda m: "".join(sorted(m[0])), s)
    return unicodedata.normalize("NFC", _TOKEN.sub(lambda m: m[0] if m[0].isascii() else resolve(m[0])[0], s))


def fold(text: str) -> str:
    """The consistent spelling of `text`, of any length. Folded text folds to itself."""
    if text.isascii():
        return text
    return "/".join(p if p.isascii() else _fold(p) for p in text.split("/"))


def fold_long(text: str) -> str:
    """As `fold`, word by word, for running text, so that repeated words cost nothing."""
    if text.isascii():
        return text
    return regex.sub(r"[^\x00-\x20]+", lambda m: m[0] if m[0].isascii() else _fold(m[0]), _ZS.sub(" ", text))


_ZS = regex.compile(r"\p{Zs}")


def findings(text: str) -> Iterable[str]:
    """What is odd about the scripts of the tokens of `text`: mixed, whole_script, unresolved."""
    s = unicodedata.normalize("NFD", text).translate(_PLAIN)
    return sorted({f for m in _TOKEN.finditer(s) if not m[0].isascii() and (f := resolve(m[0])[1]) != "single"})


adopt()


def _on_strings(f: Callable[[str], object], kind: T.DataType, spark: SparkSession) -> Callable[[Column | str], Column]:
    """`f` as a function of columns, whatever process it runs in; null stays null."""
    more = confusables(spark)

    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        adopt(more)
        return pd.Series([None if x is None else f(x) for x in s], dtype=object)

    return run


def consistent(column: str, spark: SparkSession) -> Column:
    """The consistent spelling of a column; plain ASCII never leaves the JVM. Null stays null."""
    plain = ~F.col(column).rlike(r"[^\x00-\x7f]")
    return F.when(plain, F.col(column)).otherwise(_on_strings(fold, T.StringType(), spark)(F.when(~plain, F.col(column))))


def _digest(c: F.Column) -> F.Column:
    """128 bits stand for a string in shuffles; two strings share them once in 10^19 pairs of a trillion."""
    return F.unhex(F.md5(c))


def _members(files: DataFrame) -> DataFrame:
    """(volume_id, look, own, id) of current rows whose look several paths of the volume share, written once. Rows meet
    by the digest of their consistent spelling; repeats of a path fold together in the map tasks."""
    rows = files.where(F.col("path").isNotNull())
    keyed = current_rows(rows, [F.coalesce("volume_id", F.lit("")).alias("volume_id"), _digest(consistent("path", files.sparkSession)).alias("look"), _digest(F.col("path")).alias("own")])
    several = keyed.groupBy("volume_id", "look").agg(F.min("own").alias("lo"), F.max("own").alias("hi")).where("lo <> hi").select("volume_id", "look")
    return materialize(keyed.join(several, ["volume_id", "look"], "left_semi").select("volume_id", "look", "own", "id"), "members")


def same_look_pairs(files: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: current rows of one volume whose paths look the same but differ.

    Rows without a path or id are left out; the same path twice is no pair. Only looks of several paths go on,
    their paths are paired, and the pairs expand to ids, so nothing larger than the result is formed; looks and
    paths of very many rows are split by load. Where k paths look the same the result is of the order of k squared;
    `same_look_classes` says the same in k rows.
    """
    members = _members(files)
    paths = members.select("volume_id", "look", "own").distinct()
    two = fragment_replicate_join(paths.withColumnRenamed("own", "own_a"), paths.withColumnRenamed("own", "own_b"), ["volume_id", "look"]).where("own_a < own_b")
    # Both ends of a pair expand from path to ids by the same keys, so by one plan.
    keys = ["volume_id", "look", "own"]
    plan = plan_by_load(members, keys)
    half = fragment_replicate_join(members.withColumnRenamed("id", "a"), materialize(two, "two").withColumnRenamed("own_a", "own"), keys, plan=plan)
    ids = fragment_replicate_join(members.withColumnRenamed("id", "b"), half.drop("own").withColumnRenamed("own_b", "own"), keys, plan=plan)
    return ids.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))


def same_look_classes(files: DataFrame) -> DataFrame:
    """(id, class_id, class_size, links): each current row whose path has look-alikes, the least id of those that look
    the same, how many they are, and how many of them have another path."""
    members = _members(files)
    own = members.groupBy("volume_id", "look", "own").agg(F.count(F.lit(1)).alias("same"), F.min("id").alias("least"))
    whole = own.groupBy("volume_id", "look").agg(F.sum("same").alias("class_size"), F.min("least").alias("class_id"))
    known = fragment_replicate_join(own.drop("least"), whole, ["volume_id", "look"])
    rows = fragment_replicate_join(members, known, ["volume_id", "look", "own"])
    return rows.select("id", "class_id", "class_size", (F.col("class_size") - F.col("same")).alias("links"))


def respelled(files: DataFrame) -> DataFrame:
    """(id, path, consistent_path, consistent_name, findings) of current rows whose path changes."""
    spark = files.sparkSession
    fold_of = _on_strings(fold, T.StringType(), spark)
    rows = current_rows(files.where(F.col("path").isNotNull()), ["path", "name"]).where(F.col("path").rlike(r"[^\x00-\x7f]"))
    out = rows.select("id", "path", fold_of("path").alias("consistent_path"), fold_of("name").alias("consistent_name"), _on_strings(findings, T.ArrayType(T.StringType()), spark)("path").alias("findings"))
    return out.where(F.col("consistent_path") != F.col("path")).withColumn("findings", F.array_join("findings", ","))
