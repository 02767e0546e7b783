from __future__ import annotations

from wrenlake.llm import boilerplate

POSTING = [
    "Data Analyst", "Location: Port Alder", "What you will do", "You will work with the finance team and help the people who run the reports every week.",
    "- support for the mail relay in Port Alder", "Questions about cookies in the office kitchen go to Ms. Brown.", "We read each application ourselves and answer within 9 days.",
]
TOP = ["Home", "Jobs", "Teams", "We use cookies to count visits. Accept all | Reject | Settings"]
BOTTOM = ["Share this job", "© 2025 Kordal Foods. All rights reserved.", "Privacy | Terms | Imprint", "Home | Jobs | Teams"]


def page(i: int) -> str:
    return "\n".join([*TOP, "", *POSTING, f"Case {i} is about the work of the team in the north and of the people there.", *BOTTOM])


def test_lines(spark):
    pages = [("t", str(i), page(i), 1) for i in range(12)] + [("t", "none", None, 1), ("t", "empty", "", 1), ("t", "blank", " \n\r\n", 1)]
    # postings without a page round them, as half of any corpus has; from these the furniture of the others is told
    bare = [("bare", str(i), "\n".join([*POSTING, f"Case {i} is about the work of the team in the north and of the people there."]), 1) for i in range(12)]
    df = spark.createDataFrame(pages + bare, "table string, key string, text string, line int")
    names = spark.createDataFrame([("Data Analyst", "Port Alder"), (None, None)], "title string, location string")
    rows = boilerplate.classify(df.select("table", "key", "text"), names).where("table = 't'").collect()
    assert {r.key for r in rows} == {str(i) for i in range(12)}
    lines = page(0).split("\n")
    got = {lines[r.line_no - 1]: r.content for r in rows if r.key == "0"}
    assert all(got[x] for x in POSTING), [x for x in POSTING if not got[x]]
    assert not any(got[x] for x in [*TOP, *BOTTOM])
    assert len(rows) == 12 * sum(1 for x in lines if x.strip())


def test_empty_tables(spark):
    ats = spark.createDataFrame([], "scrape_id long, page_url string, jd_text string, title string, location string")
    jobs = spark.createDataFrame([], "id string, jd_text string, title string, location string")
    assert boilerplate.found(ats, jobs).count() == 0


def test_one_line_and_long_text(spark):
    df = spark.createDataFrame([("t", "a", "Apply now"), ("t", "b", "the work of the team is here " * 8000), ("t", "c", "☰"), ("t", "d", "Kordal Foods " * 20_000 + "is here.")], "table string, key string, text string")
    names = spark.createDataFrame([], "title string, location string")
    assert {r.key: r.content for r in boilerplate.classify(df, names).collect()} == {"a": False, "b": True, "c": False, "d": False}
