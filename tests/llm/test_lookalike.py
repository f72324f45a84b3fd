"""Same look, one spelling: characters, scripts, and the pairs they bring together."""

from __future__ import annotations

import random
import unicodedata
from collections import Counter
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarryline.llm.lookalike import SHAPES, adopt, confusables, findings, fold, fold_long, resolve, respelled, same_look_classes, same_look_pairs

SAME = [
    ("ＡＢｃ１（２）", "ABc1(2)"), ("Café", "Café"), ("ệ", "ệ"), ("ệ", "ệ"), ("ab​c­", "abc"), ("﻿x⁠y", "xy"), ("a b　c d", "a b c d"),
    ("ﬁle oﬃce", "file office"), ("раypal", "paypal"), ("сор", "cop"), ("Ιοᴬ".replace("ᴬ", ""), "Io"), ("a‐b‑c", "a-b-c"), ("Å", "Å"), ("ガ", "ガ"), ("ЁЛКА", "ЁЛКA"), ("ϲaϳ", "caj"), ("օne", "one"), ("Ёｌ", "Ël"),
]
OTHER = [("A", "a"), ("é", "e"), ("x²", "x2"), ("③", "3"), ("0", "O"), ("1", "l"), ("a b", "a  b"), ("ß", "ss"), ("-", "_"), ("写真テータ", "写真データ"), ("архив", "apxив!"), ("", "a")]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same_look(a, b):
    assert fold(a) == fold(b)
    assert fold_long(a) == fold_long(b)


@pytest.mark.parametrize(("a", "b"), OTHER)
def test_other_look(a, b):
    assert fold(a) != fold(b)


def test_the_consistent_script_is_chosen():
    assert resolve("раypal") == ("paypal", "mixed")
    assert resolve("сор") == ("cop", "whole_script")
    assert resolve("архив") == ("архив", "single")
    assert resolve("apхив") == ("архив", "mixed")
    assert resolve("москвaz")[1] == "unresolved"
    assert findings("архив/раypal_сор") == ["mixed", "whole_script"]
    assert fold("報告書カタ한글") == "報告書カタ한글"


letters = "".join(c for forms in SHAPES.values() for chars in forms.values() for c in chars) + "abcopxyz ABC-_/1éж漢̣́​ ﬁＡ"


@given(st.text(alphabet=letters, max_size=12))
@settings(max_examples=300, deadline=None)
def test_folding_is_stable(s):
    assert fold(fold(s)) == fold(s)
    assert fold(unicodedata.normalize("NFD", s)) == fold(s)
    latin = {c: k for forms in SHAPES.values() for k, chars in forms.items() for c in chars}
    assert fold("".join(latin.get(c, c) for c in s)) == fold(s)
    assert fold_long(s) == fold(s)


def test_very_long_text():
    assert fold("ａ/" * 100_000) == "a/" * 100_000
    assert len(fold_long("сор " * 100_000)) == 400_000


DDL = "id bigint, path string, name string, volume_id string, changed_ns bigint, look string, own string"


def test_pairs_against_brute_force(spark):
    rnd = random.Random(1)
    base = ["/a/report 1.txt", "/a/Report 1.txt", "/b/copy-2", "/кот/сор", "", "/ﬁ"]
    swap = {"o": "оο", "a": "а", "c": "сϲ", "p": "р", " ": "  ", "-": "‐", "1": "１", "t": "tｔ"}
    rows = []
    for i in range(300):
        s = "".join(rnd.choice(swap[c] + c) if c in swap and rnd.random() < 0.3 else c for c in rnd.choice(base))
        rows.append((i % 250 if i % 97 else None, None if i % 50 == 3 else s, s, rnd.choice(["v", "w", None]), rnd.choice([1, 2, 3]) * 1000 + i, "x", "y"))
    rows += rows[::10]
    cur = {}
    for r in rows:
        if r[0] is not None and r[1] is not None and r[4] >= cur.get(r[0], (0,) * 5)[4]:
            cur[r[0]] = r
    want = {(a[0], b[0]) for a, b in combinations(sorted(cur.values(), key=lambda r: r[0]), 2) if a[3] == b[3] and a[1] != b[1] and fold(a[1]) == fold(b[1])}
    df = spark.createDataFrame(rows, DDL)
    got = [tuple(r) for r in same_look_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    assert same_look_pairs(df.limit(0)).collect() == []
    links = Counter(i for pair in want for i in pair)
    classes = {r.id: r for r in same_look_classes(df).collect()}
    assert {i: r.links for i, r in classes.items()} == links
    for a, b in want:
        assert classes[a].class_id == classes[b].class_id <= a
    assert all(r.class_size == sum(o.class_id == r.class_id for o in classes.values()) for r in classes.values())
    assert same_look_classes(df.limit(0)).collect() == []
    for r in respelled(df).collect():
        assert r.consistent_path == fold(r.path) != r.path


@pytest.mark.parametrize(("a", "b"), [("nүm", "nym"), ("ѵalue", "value"), ("Ѵalue", "Value"), ("pαth", "path"), ("fιle", "file"), ("oυt", "out"), ("ꓐꓮꓔ", "BAT"), ("REꓑORꓔ", "REPORT")])
def test_letters_added_to_the_table(a, b):
    assert fold(a) == b == fold_long(a)


def test_shapes_of_all_scripts(spark):
    """Letters of scripts without a table of their own, by the Unicode library's confusables."""
    more = confusables(spark)
    assert 200 < len(more) < 1000 and all(b in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" for _, b in more)
    assert fold("ᗪisk") == "ᗪisk"
    rows = [(1, "/ᗪisk"), (2, "/Disk"), (3, "/𐊠lpha"), (4, "/Alpha"), (5, "/архив"), (6, "/apхив"), (7, "/disk")]
    df = spark.createDataFrame([(i, p, p, "v", 1, "", "") for i, p in rows], DDL)
    assert {tuple(r) for r in same_look_pairs(df).collect()} == {(1, 2), (3, 4), (5, 6)}
    try:
        adopt(more)
        assert fold("ᗪisk") == "Disk" and fold("apхив") == "архив" and fold(fold("ᕼ𐊠")) == fold("ᕼ𐊠") == "HA"
        fixed = {c for forms in SHAPES.values() for chars in forms.values() for c in chars}
        for c, latin in more:
            assert c in fixed or fold(f"{c}{latin}") == fold(latin * 2)
    finally:
        adopt()
    assert fold("ᗪisk") == "ᗪisk"
