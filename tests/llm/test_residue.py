from __future__ import annotations

import pytest

from wrenlake.llm import residue

CASES = [
    ("{{headline}}", "placeholder"), ("Senior {0}", "placeholder"), ("Welcome to %JOB_TITLE% today", "placeholder"), ("engineer at undefined", "placeholder"), ("null | null", "placeholder"), ("[Insert city] office", "placeholder"), ("<YOUR NAME> is hiring", "placeholder"),
    ("Headline goes here", "filler"), ("tbd tbd tbd", "filler"), ("Lorem ipsum dolor amare", "filler"), ("Texte à compléter", "filler"), ("Loading...", "filler"),
    ("404 - Page not found. It may have been removed.", "error"), ("Zugriff verweigert", "error"), ("Oops! Something went wrong on our end.", "error"), ("Hier steht später die Beschreibung.", "filler"), ("[object object]", "placeholder"), ("Erreur 500 : indisponible", "error"), ("Just a moment... checking that you are not a robot.", "error"),
    ("Please enable JavaScript to view this page.", "script"), ("Veuillez activer JavaScript", "script"), ("JavaScript ist deaktiviert", "script"),
    ("You know partials such as `{{ item.name }}` well.", None), ("tokens like %ENV% at deploy time", None), ("JavaScript required, Rust preferred | analyst", None), ("Null-safety enthusiast", None), ("I fill the [blank] between search and fraud", None),
    ("Fixing 404s since 2011 | analyst", None), ("Part of the job is writing better 404 and 500 pages for us.", None), ("Not found on other networks | analyst", None), ("how a page should behave when scripts are disabled.", None), ("You will replace placeholder copy with real text.", None), ("", None),
]


def test_fields(spark):
    df = spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(CASES)] + [(99, None, "x")], "id long, h string, kind string")
    got = {r.key: r.reason for r in residue.field_residue(df, "id", "h").collect()}
    assert {i: got.get(i) for i in range(len(CASES))} == {i: k for i, (_, k) in enumerate(CASES)}
    assert 99 not in got


PROSE = "The team in the north looks for somebody who likes to work with the people of the finance group and is patient."


def test_pages(spark):
    notice = "Please enable JavaScript to use this site."
    pages = [(i, f"{PROSE} Number {i}.\n{PROSE} Again {i} for all of us in the office.\n{notice}", "https://a.example/x", 1) for i in range(6)]
    pages += [(10, notice, "https://a.example/y", 1), (11, f"Jobs\n{notice}", "https://b.example/", 1), (12, f"{PROSE}\n{PROSE} TODO\nTODO: add text", None, 1), (13, None, "https://b.example/", 1), (14, "", "https://b.example/", 1)]
    pages += [(15, ("word " * 40_000) + "\n[[name]] is hiring", "https://c.example/", 1)]
    pages += [(20 + i, "Lorem ipsum vestar quadro mattin.", "https://d.example/", 1) for i in range(3)] + [(30, "Vestar quadro mattin quadro.", "https://e.example/", 1), (31, "Rust Kafka quadro.", "https://e.example/", 1)]
    df = spark.createDataFrame(pages, "id long, t string, u string, line int")
    got = {r.key: r.reason for r in residue.page_residue(df, "id", "t", "u").collect()}
    # a notice under real content is boilerplate of its host; a page that holds nothing else is a case where the host doesn't repeat it
    assert not set(range(6)) & set(got)
    assert got[11] == "script" and got[12] == "filler" and got[15] == "placeholder" and 13 not in got and 14 not in got
    assert got[20] == got[30] == "filler" and 31 not in got
    assert residue.page_residue(df.limit(0), "id", "t", "u").count() == 0


def test_long_lines_are_judged_by_sentence(spark):
    page = "404 Page not found. " + " ".join(f"Go back to list {i} of the shop or see what else is in it." for i in range(2)) + " The page you requested could not be found on this server. It may have been removed or renamed by its owner, or the address that you typed into the field above has a mistake in it somewhere near the end."
    lorem = "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua. Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat. Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur."
    talk = f"{PROSE} {PROSE} The old page had lorem ipsum in it, and we are the ones who put real text in its place for the people."
    df = spark.createDataFrame([(1, lorem, "https://a.example/"), (2, talk, "https://a.example/"), (3, "x" * 300 + " {{name}}", "https://a.example/"), (4, "404 Page not found. Nothing here. " + "xxxx yyyy. " * 40, "https://f.example/")], "id long, t string, u string")
    assert {r.key: r.reason for r in residue.page_residue(df, "id", "t", "u").collect()} == {1: "filler", 3: "placeholder", 4: "error"}
    assert {r.key: r.reason for r in residue.field_residue(df, "id", "t").collect()}[1] == "filler"
    assert len(page) > residue.MESSAGE_CHARS
    assert {r.reason for r in residue.field_residue(spark.createDataFrame([(1, page)], "id long, t string"), "id", "t").collect()} == {"error"}
