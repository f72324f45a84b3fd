"""The language: grammar, limits, errors, numbers, dates."""

from __future__ import annotations

from datetime import date

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarryline.lang import ast as A
from quarryline.lang.parser import parse
from quarryline.lang.tokens import tokens
from quarryline.lang.values import Clock, calendar, number_term, period, scalar

CLOCK = Clock(1709294400.0, "UTC", 1)  # 2024-03-01 12:00


def term(text, **o):
    return A.Text(text, A.Options(**o))


def test_or_binds_tighter_than_and():
    assert parse("a b | c") == A.All((term("a"), A.Any((term("b"), term("c")))))
    assert parse("a OR b AND NOT c") == A.All((A.Any((term("a"), term("b"))), A.Not(term("c"))))


@pytest.mark.parametrize(
    ("text", "node"),
    [
        ("", A.Everything()),
        ('"a:b"', term("a:b")),
        ('a"b c"', term("ab c")),
        ('"x\\"y"', term('x"y')),
        ("a/b", term("a/b", field="path")),
        ("parent:/x/y/", term("/x/y", field="parent", whole=True)),
        ("ext:.a;B", A.ExtensionIn(("a", "B"))),
        ("file:", A.IsFolder(False)),
        ("file:x", A.All((A.IsFolder(False), term("x")))),
        ("Whole-Words:x", term("x", word_start=True, word_end=True)),
        ("regex:a(b|c)", term("a(b|c)", regex=True)),
        ("regex:[)>]x", term("[)>]x", regex=True)),
        ("content:<a | b>", A.Any((term("a", target="content"), term("b", target="content")))),
        ("empty:", A.Number("childcount", 0, 0)),
        ("flags:hidden;nodump", A.HasFlags(0x8001)),
        ("child-file:x", A.Related(A.All((A.IsFolder(False), term("x"))), False)),
        ("size:<5", A.Number("size", float("-inf"), 5, True, False)),
        ("size:!unknown", A.Unknown("size", True)),
        ("!!a", A.Not(A.Not(term("a")))),
        ("<a>", term("a")),
    ],
)
def test_trees(text, node):
    assert parse(text, clock=CLOCK) == node


@pytest.mark.parametrize("text", ['"a', "(a", "a)", "|", "a |", "unknown:foo", "size:x", "size:5zb", "size:9..1", "type:x", "attrib:z", "flags:x", "dm:2024-13", "dm:2025..2024", "size:!>5 >", "AND a"])
def test_errors(text):
    with pytest.raises(A.QueryError):
        parse(text, clock=CLOCK)


def test_limits():
    parse("<" * 100 + "a" + ">" * 100)
    for bad in ("!" * 130 + "a", "<" * 130 + "a" + ">" * 130, "a " * 8300, "x" * 70000):
        with pytest.raises(A.QueryError):
            parse(bad)
    with pytest.raises(A.QueryError, match="16 levels"):
        parse("m:", {"m": "m:"})


def test_macros():
    m = {"docs": "ext:pdf | ext:doc", "none": "", "ext": "never"}
    assert parse("docs: x", m) == A.All((A.Any((A.ExtensionIn(("pdf",)), A.ExtensionIn(("doc",)))), term("x")))
    assert parse("none:", m) == A.Everything()
    assert parse("case:<docs: x>", m).parts[1] == term("x", case=True)
    assert parse('"docs:"', m) == term("docs:")


def test_numbers():
    assert scalar("1.5kb") == 1536
    assert number_term("size", "1.5kb", CLOCK) == A.Number("size", 1536.0, 1638.4, True, False)
    assert number_term("size", "!=5", CLOCK) == A.Number("size", 5, 5, True, True, True)
    assert number_term("pages", "3..4", CLOCK) == A.Number("pages", 3, 4)


def test_dates():
    day = 86400
    d0 = 1709251200  # 2024-03-01
    assert period("today", CLOCK) == (d0, d0 + day)
    assert period("2d", CLOCK) == (CLOCK.now - 2 * day, CLOCK.now + 1)
    assert period("1month", CLOCK)[0] == 1706788800  # 2024-02-01 12:00
    assert number_term("modified", ">2024-02", CLOCK, True).low == d0
    assert number_term("modified", "<=2024-02", CLOCK, True).high == d0
    assert calendar("lastweek", date(2024, 3, 1)) == (date(2024, 2, 19), date(2024, 2, 26))
    assert calendar("thisweek", date(2024, 3, 1), 0)[0] == date(2024, 2, 25)
    assert calendar("lastmonth", date(2024, 3, 1)) == (date(2024, 2, 1), date(2024, 3, 1))


def test_days_that_change_clocks():
    ny = Clock(1.7e9, "America/New_York")
    hours = lambda s: (lambda p: (p[1] - p[0]) / 3600)(period(s, ny))
    assert (hours("2024-03-10"), hours("2024-11-03"), hours("2024-05-05")) == (23, 25, 24)


atoms = st.sampled_from(["a", "b", '"c d"', "size:>1", "ext:x", "case:y", "content:z", "regex:a(b)", "child:<q>"])
expressions = st.recursive(atoms, lambda e: st.one_of(st.tuples(e, e).map(" ".join), st.tuples(e, e).map(" | ".join), e.map(lambda x: f"<{x}>"), e.map(lambda x: f"!<{x}>")), max_leaves=12)


@given(expressions)
@settings(max_examples=200, deadline=None)
def test_grammar_is_consistent(text):
    node = parse(text, clock=CLOCK)
    assert parse(f"<{text}>", clock=CLOCK) == node
    assert parse(f"  {text}  ", clock=CLOCK) == node
    for bad in (f"<{text}", f"{text} |", f"{text} >"):
        with pytest.raises(A.QueryError):
            parse(bad, clock=CLOCK)


@given(st.text(alphabet='ab:<>()|!"\\ =.1k', max_size=30))
@settings(max_examples=300, deadline=None)
def test_any_input_parses_or_is_refused(text):
    try:
        parse(text, clock=CLOCK)
        tokens(text)
    except A.QueryError:
        pass
