from __future__ import annotations

import pytest

from wrenlake.llm import names


@pytest.mark.parametrize(
    "text, words",
    [
        ("The Kordal Foods Group", ["kordal", "foods"]), ("KordalFoods", ["kordal", "foods"]), ("Foods, Kordal", ["kordal", "foods"]), ("Kordál Foods B.V.", ["kordal", "foods"]),
        ("Kordal Foods & Co. KG", ["kordal", "foods"]), ("Kordal Foods (Port Alder)", ["kordal", "foods"]), ("Kordal (Foods)", ["kordal", "foods"]), ("Kordal Foods | Port Alder office", ["kordal", "foods"]), ("Kordal S/W", ["kordal", "sw"]), ("Kordal Foods, Inc.", ["kordal", "foods"]),
    ],
)
def test_parse(text, words):
    assert names.parse(text)[1] == words


@pytest.mark.parametrize("text", ["-", "", "  ", "N/A", "Self-employed", "freelancer", "Stealth Startup", "open to work", "?!"])
def test_no_employer(text):
    assert names.parse(text) is None


def test_word_rules():
    assert names.one_edit("foods", "fodos") and names.one_edit("a", "ab") and not names.one_edit("abc", "cba")
    assert names.same_words(["kordal", "foods"], ["kordla", "fods"], {"foods"}) and not names.same_words(["kordal", "foods"], ["kordal", "labs"], {"foods", "labs"})
    assert names.abbreviates(["kordal", "mtrls"], ["kordal", "materials"]) and names.abbreviates(["korda", "mate"], ["kordalis", "venmark", "materials"])
    assert not names.abbreviates(["kordal", "labs"], ["kordal", "venmark", "labs"])


def links(spark, rows):
    df = spark.createDataFrame([(r, 1) for r in rows], "company string, company2 int").select("company")
    return {(r.name_a, r.name_b) for r in names.found(df).collect()}


def test_merge_and_rematch(spark):
    full = ["Kordalis Materials", "Kordalis  Materials", "Kordlais Materials", "kordalis materials ltd", "KORDALIS MATERIALS"]
    rows = [*full, "Kordalis Mtrls", "Kordalis", "Venmark Foods", "Venmark Labs", "Venmark", "VF", "V.F.", None, "-", "Freelance", *full]
    got = links(spark, rows)
    same = sorted([*full, "Kordalis Mtrls", "Kordalis"])
    assert {(a, b) for a in same for b in same if a < b} <= got  # the short form fits one profile once the spellings are one
    assert ("V.F.", "VF") in got and ("V.F.", "Venmark Foods") in got and ("VF", "Venmark Foods") in got
    assert not any("Venmark" in p for p in got) and not any("Labs" in a + b for a, b in got)  # ambiguous, and a sister
    assert all(a < b for a, b in got) and not any(x in ("-", "Freelance") for p in got for x in p)


def test_empty_and_null(spark):
    assert links(spark, []) == set() and links(spark, [None, None]) == set() and links(spark, ["Kordalis", "Kordalis"]) == set()


def test_richer_profiles_fit_more(spark):
    # the last spelling has the typo of one and the abbreviation of another, and fits no single spelling
    rows = ["Kordalis Vent Materials", "Kordlais Vent Materials", "Kordalis Vent Mtrls", "Kordlais Vent Mtrls", "Kordalis Vent Foods"]
    got = links(spark, rows)
    assert ("Kordalis Vent Mtrls", "Kordlais Vent Mtrls") in got and ("Kordalis Vent Materials", "Kordlais Vent Mtrls") in got
    assert not any("Foods" in a + b for a, b in got)
    assert names.fits_places(["kordlais", "mtrls"], [["kordalis", "kordlais"], ["materials"]]) and not names.fits_places(["kordlais", "foods"], [["kordalis", "kordlais"], ["materials"]])


def test_long_single_and_capital_names(spark):
    long = "Upper Ordal Valley Public Water Supply Authority"
    rows = [long, long.replace("Water", "Watet"), "Simensel", "Simnsel", "BOSCH", "Bosch", "Mabe Bio.", "Mabewick Biotech"]
    assert links(spark, rows) == {tuple(sorted(p)) for p in [(rows[0], rows[1]), (rows[2], rows[3]), (rows[4], rows[5]), (rows[6], rows[7])]}


def test_entities(spark):
    df = spark.createDataFrame([("Kordalis Foods",), ("kordalis foods",), ("Other Labs",), (None,), ("-",)], "company string")
    assert {tuple(r) for r in names.entities(df).collect()} == {("Kordalis Foods", "Kordalis Foods", 2), ("kordalis foods", "Kordalis Foods", 2), ("Other Labs", "Other Labs", 1)}
