from __future__ import annotations

import pytest

from quarryline.llm.residue import residue, residue_documents

YES = [
    ("slot", "The owner of {{owner.name}} is Team Heron."), ("slot", "Dear [INSERT NAME], welcome."), ("slot", "Scan %(count)s took 5 ms."), ("slot", "Since build ${build_no} it works."), ("slot", "Due << add date >> at noon."),
    ("slot", "The __VOLUME__ is full."), ("slot", "See @@path@@ now."), ("slot", "Die Datei <Datum eintragen> fehlt."), ("slot", "Rien ne manque : [texte à venir]."), ("slot", "XXXX (fill in) is missing."), ("slot", "by [object Object] today"),
    ("slot", "Hello <%= user_name %>!"), ("slot", "{% block title %} here"), ("slot", "the %folder% folder"), ("slot", "_____ (name) asked"), ("slot", "belongs to FIXME-TITLE."), ("slot", "{user_name} asked"), ("slot", "a $title$ b"), ("slot", "[[date]] x"), ("slot", "#{count} rows"),
    ("filler", "Lorem ipsum dolor sit amet, consectetur adipiscing elit."), ("filler", "fine text here. test test test test test test"), ("filler", "Replace this paragraph with your own words."), ("filler", "Dies ist ein Blindtext."), ("filler", "Magna aliqua nisi culpa velit."),
    ("error", "404 Not Found"), ("error", "Page not found\nThe page you asked for could not be found."), ("error", "Some text first.\nError 503 - The server did not answer in time.\nRequest id: 99 Sign in again."), ("error", "ACCESS DENIED"), ("error", "Ｅｒｒｏｒ　５０３"),
    ("error", "Página no encontrada"), ("error", "Seite nicht gefunden - Der Server antwortet nicht."), ("error", "Une erreur inattendue est survenue."), ("error", "Pа​ge not found"),
    ("notice", "Please enable JavaScript to view this page."), ("notice", "YOUR BROWSER HAS BLOCKED SCRIPTS; ALLOW IT AND COOKIES TO PROCEED."), ("notice", "Veuillez activer JavaScript puis rechargez la page."), ("notice", "Su navegador bloquea los scripts; permítalo para continuar."), ("notice", "Diese Seite benötigt Skripte, um fortzufahren."), ("notice", "You need to enable JavaScript to run this app."),
]
NO = [
    "In a rename plan the literal `{{name}}` is replaced.", 'The preview answered "404 Not Found" although the file was there.', "Status 404 means that the listed path is gone.", "The table has [draft] and [final] as tags in front of each name.", 'Write `printf "%s has %d rows\\n" "$name"` at the end.',
    "JavaScript files (js, mjs) are indexed as text, and the desk asked to leave it enabled.", "L'ancienne visionneuse affichait « Cette page exige les scripts pour continuer », ce que l'équipe trouvait trompeur.", "2025-01-01 10:00:00 error lease: bytes=1 gen=2 denied", "The pattern [0-9]{2,5} matches digits.",
    "Set the variable first: `export TARGET=$HOME/archive`.", "Die Meldung „Seite nicht gefunden“ kam 9 Mal vor.", "Fixed: the preview no longer says \"Please enable scripts to view this page\" when scripts are already allowed.", "A <b>bold</b> word and <br> breaks.", "He said no, no, no.", "The query `dm:thisweek <report|invoice>` returned 4 rows.",
    "Our layout tool fills pages with \"lorem ipsum dolor sit\" so skip them.", "Costs rose 5% and fell 10% later.", "array[index] and map[key] are read.", "see [12] and [note]", "", None, "   \n", "Prices: $5 and $6.", "```\n{{ x }}\n404 Not Found\n```",
]


@pytest.mark.parametrize(("kind", "text"), YES)
def test_found(kind, text):
    kinds, coverage = residue(text)
    assert kind in kinds and 0 < coverage <= 1


@pytest.mark.parametrize("text", NO)
def test_spared(text):
    assert residue(text) == ([], 0.0)


def test_coverage_tells_whole_pages_from_a_part():
    assert residue("404 Not Found")[1] == 1.0
    assert residue("Real words stand here. " * 50 + "\n404 Not Found")[1] < 0.1


def test_very_long_text():
    assert residue("plain words and more of them. " * 60_000)[0] == []
    assert residue("plain words and more of them. " * 60_000 + "{{name}}")[0] == ["slot"]
    assert residue("x" * 2_000_000)[0] == []
    assert residue("[" * 20_000)[0] == [] == residue("{" * 20_000)[0] == residue('"' * 20_001)[0]


LONG = {
    "error": ("404 Not Found|The page you asked for could not be found.|Go back;Home;", "Fehler 503;Der Server antwortet nicht.Bitte später erneut versuchen • "),
    "notice": ("Please enable JavaScript to view this page|", "Veuillez activer JavaScript;puis rechargez la page;"),
    "filler": ("Your text goes here;Replace this paragraph with your own words.", "Dies ist ein Blindtext|Hier steht später der Text|"),
}


@pytest.mark.parametrize(("kind", "unit"), [(k, u) for k, us in LONG.items() for u in us])
def test_pages_on_one_line(kind, unit):
    for n in (399, 400, 401, 5_000):
        kinds, coverage = residue((unit * (n // len(unit) + 1))[:n])
        assert kinds == [kind] and coverage == 1.0


def test_part_of_a_long_line():
    plain = "the folder was moved and its rows were read again,"
    page = LONG["error"][0] * 10
    kinds, coverage = residue(plain * 40 + page + plain * 40)
    assert kinds == ["error"] and 0.8 < coverage * (80 * len(plain) + len(page)) / len(page) < 1.5
    assert residue(plain * 80) == ([], 0.0) == residue((plain * 3 + "not found;") * 40)


LONG_SLOTS = [
    "To {{ customer.address.street | default(config.fallback.street) | upper }} today.", "To {{#each " + "customer.orders.lines " * 20 + "}} today.", "{% if customer.address.street and config.fallback.street and customer.is_known and lang %} here", "Hello <%= user.full_name or user.short_name or config.fallback.name or config.default.name %>!",
    "Sent by [Please insert the full name of the responsible person here] today.", "Sent by <Bitte den vollen Namen der für den Ordner zuständigen Person eintragen> heute.", "Due << add the date on which the whole volume has to be scanned again >> at noon.", "XXXX\t(fill in) is missing.", "XXXX (please enter the name of the person who is responsible) is missing.", "_____ (full name of the person who asked for it) asked", "[Bezeichnung der zuständigen Organisationseinheit eintragen] fehlt.",
]
LONG_PROSE = ["It moved [as the team wrote here last year, the old folder was kept for your reports] again.", "NASA (whose files were added here by the team that kept your folder last year) wrote.", "<<Die Datei wurde im letzten Jahr hierher verschoben und seitdem nicht geändert>>, sagte Team Reiher.", "<select id=a name=b class=c size=1 multiple required disabled hidden>", "a < b and your c here is more than the old d, then e > f"]


@pytest.mark.parametrize("text", LONG_SLOTS)
def test_slots_of_any_length(text):
    assert residue(text)[0] == ["slot"]


@pytest.mark.parametrize("text", LONG_PROSE)
def test_long_brackets_of_prose(text):
    assert residue(text) == ([], 0.0)


def test_slots_without_end():
    for opener in ("{{a ", "{% a ", "<% a ", "<< a ", "[a ", "<a ", "XXXX (a ", "{{ "):
        assert residue(opener * 20_000)[0] == [] == residue(opener + "x" * 200_000)[0]


def test_documents(spark):
    rows = [(i, t, "k") for i, (_, t) in enumerate(YES)] + [(1000 + i, t, "k") for i, t in enumerate(NO)] + [(None, "404 Not Found", "k"), (0, YES[0][1], "k")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, kinds string")
    got = sorted(r.doc_id for r in residue_documents(df).where("doc_id is not null").collect())
    assert got == sorted([*range(len(YES)), 0])
    assert residue_documents(df.limit(0)).collect() == []
