from __future__ import annotations

from wrenlake.llm import truncation

WORDS = "relay ledger planner engine gateway scanner portal desk".split()


def texts():
    rows = []
    for i in range(400):
        body = f"We run the {WORDS[i % 8]} in town number {i}. " * (3 + i % 13)
        full = body + "\nSkills: " + ", ".join(WORDS[i % 5 :])
        rows.append(("card", i, full[:300]))  # a limit of 300 characters
        rows.append(("page", 1000 + i, full))
    rows += [("page", 2000, "We run the relay in town and then the pla"), ("page", 2001, "We run the relay in town, "), ("page", 2002, "Skills: relay, ledger"), ("page", 2003, "All is said."), ("page", 2004, None), ("page", 2005, " "), ("page", 2006, "half a sign �"), ("page", 2007, "We run the gateway in town. We run the"), ("page", 2008, "x" * 200_000 + "."), ("page", 2009, "x" * 200_000 + " relay ledger.")]
    return rows


def test_limits_and_cuts(spark):
    df = spark.createDataFrame([(*r, 1) for r in texts()], "source string, key long, text string, word int").select("source", "key", "text")
    limits = {(r.source, r.unit, r.len) for r in truncation.length_limits(df.where("text is not null")).collect()}
    assert ("card", "chars", 300) in limits and not any(s == "page" for s, _, _ in limits)
    got = {r.key: r.at_limit for r in truncation.truncated(df).collect()}
    cut = {k for s, k, t in texts() if s == "card" and t and len(t) == 300}
    assert cut <= set(got) and all(got[k] for k in cut)
    whole = {k for s, k, t in texts() if k < 2000 and not (s == "card" and len(t) == 300)}
    assert not whole & set(got)
    assert {2000, 2001, 2006, 2007} <= set(got) and not {2002, 2003, 2004, 2005, 2008, 2009} & set(got)


def test_empty_and_shares(spark):
    p = spark.createDataFrame([], "scrape_id long, capture_source string, profile_text string")
    a = spark.createDataFrame([(1, None, "We went to the"), (2, "v", "All done."), (3, "v", None)], "scrape_id long, vendor string, jd_text string")
    rows = {(r.source_table, r.source): (r.texts, r.cut) for r in truncation.shares(p, a).collect()}
    assert rows == {("scraped_ats_jobs", ""): (1, 1), ("scraped_ats_jobs", "v"): (1, 0)}
    assert truncation.found(p, a.limit(0)).count() == 0
