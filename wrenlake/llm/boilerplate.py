"""Main text of pages: which lines belong to the posting and which to the page round it.

Plan, two passes over lines as blocks:

1. Each line gets its length, its stop-word density and its link density (short items between menu separators, menu
   marks). Dense prose and list items lean to content, link-dense lines to the page. No phrases are listed: what else
   is furniture is learned from the company it keeps. Lines of one form (figures and names masked) are
   taken together over the whole corpus; furniture stands on pages with other furniture, content also on pages
   without any. The likelihood of a form's places under both, and the measures of the line itself, decide
   clear lines. Link-dense lines are the seeds, and a few rounds let what they taught teach on.
2. Lines left open inherit from the nearest decided lines before and after them.

The lines of a page are ordered by a window over its own key; forms and pages are aggregates of the corpus
that joins bring back, hot forms salted.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wrenlake.functions.text import collapse
from wrenlake.llm import residue
from wrenlake.llm.residue import STOP_RE
from wrenlake.operators.skew import salted_join
from wrenlake.session import cut

SEPARATOR = r"(?U)\s*[|›»]\s*|\s+[/>·]\s+|\s{2,}"
MENU_MARK = r"(?U)^\s*(?:[›»☰≡]|\[ ?\]|[-–•*]\s*(?=\[ ?\]))\s*"
BULLET = r"(?U)^\s*(?:[•*–·▪◦‣-]|\d{1,2}[.)])\s+"
_NAME = r"\p{Lu}[\p{L}&’'-]*"
#: names within a line, and two or more words of a name that begin it
NAMES = rf"(?<=\s){_NAME}(?:\s+(?:&\s+)?{_NAME})*+"
FIRST_NAME = rf"^{_NAME}\s+(?:&\s+)?X\b(?!$)"
#: what the measures of a line say about it before its form is asked, as log odds of furniture
LINKS, ITEM, PROSE = 5.0, -5.0, -3.0
#: log odds from which a line is decided
CLEAR = 2.0


def blocks(pages: DataFrame) -> DataFrame:
    """(table, key, page, line_no, label, form, begin, lean, colon) of pages (table, key, text): the measures of each line."""
    lines = pages.where(F.col("text").isNotNull()).select("table", "key", F.xxhash64("table", "key").alias("page"), F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    lines = lines.withColumn("core", collapse(F.col("line"))).where(F.col("core") != "")
    items = F.filter(F.split(F.regexp_replace("line", r"(?U)^\s+|\s+$", ""), SEPARATOR), lambda x: x != "")
    words = F.size(F.split("core", " "))
    lines = lines.withColumns({"items": items, "words": words, "stops": F.regexp_count("core", F.lit(STOP_RE)), "marked": F.col("line").rlike(MENU_MARK), "bullet": F.col("line").rlike(BULLET)})
    short_items = F.forall("items", lambda x: (F.length(x) <= 28) & ~x.rlike(r"[.!?]\s*$"))
    links = F.col("marked") | ((F.size("items") >= 3) & short_items & (F.col("stops") <= F.size("items")))
    density = F.col("stops") / F.col("words")
    prose = ((F.col("words") >= 5) & (F.col("stops") >= 2) & (density >= 0.15)) | ((F.length("core") >= 110) & (density >= 0.1))
    form = F.regexp_replace(F.regexp_replace(F.regexp_replace("core", BULLET, ""), r"\d+", "0"), NAMES, "X")
    lines = lines.withColumn("form", F.regexp_replace(form, FIRST_NAME, "X"))
    return lines.select(
        "table", "key", "page", (F.col("i") + 1).cast("long").alias("line_no"),
        F.xxhash64(F.lower("core")).alias("label"), F.xxhash64("form").alias("form"), F.xxhash64(F.substring_index("form", " ", 3), F.lit("begin")).alias("begin"),
        F.when(links, LINKS).when(F.col("bullet"), ITEM).when(prose, PROSE).otherwise(0.0).alias("lean"), F.col("core").rlike(r"[:：]$").alias("colon"),
    )


def _titles(names: DataFrame) -> DataFrame:
    return names.where(F.col("title").isNotNull()).select(F.xxhash64(F.lower(collapse(F.col("title")))).alias("label")).distinct().withColumn("title", F.lit(True))


def _grouped(lines: DataFrame, least: int) -> DataFrame:
    """``lines`` and group: the form where it has ``least`` places, else its first three words where these have, else null."""
    for c in ("form", "begin"):
        often = lines.where(~F.col("title")).groupBy(c).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select(c, F.lit(True).alias(f"often_{c}"))
        lines = salted_join(lines, often, [c], F.col("page"))
    group = F.when(F.col("title"), None).when(F.col("often_form"), F.col("form")).when(F.col("often_begin"), F.col("begin"))
    return lines.withColumn("group", group).drop("often_form", "often_begin", "form", "begin")


def furniture_odds(lines: DataFrame, rounds: int) -> DataFrame:
    """(group, odds): log odds that a group of lines is furniture, by how often other furniture stands on its pages.

    lines: (page, group, lean). Where hardly any page is without furniture nothing is learned and all odds are 0.
    """
    places = lines.groupBy("page", "group").agg(F.count(F.lit(1)).alias("n"), F.avg("lean").alias("lean"))
    places = cut(places, "page-places")
    odds = None
    for _ in range(rounds):
        marked = places if odds is None else salted_join(places, odds, ["group"], F.col("page"))
        is_furniture = F.col("lean") + (F.lit(0.0) if odds is None else F.coalesce("odds", F.lit(0.0))) > 0
        marked = marked.select("page", "group", "n", "lean", is_furniture.cast("int").alias("is"))
        pages = marked.groupBy("page").agg(F.sum(F.col("is") * F.col("n")).alias("all"))
        beside = marked.join(pages, "page").withColumn("hits", F.when(F.col("all") > F.col("is"), F.col("n")).otherwise(0))
        sums = beside.groupBy("group").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.sum(F.col("lean") * F.col("n")).alias("lean"), F.max("is").alias("is"))
        sums = cut(sums.withColumn("lean", F.col("lean") / F.col("n")), "page-groups")
        share = lambda which: F.sum(F.when(which, F.col("hits"))) / F.sum(F.when(which, F.col("n")))
        own, other = sums.agg(share(F.col("is") == 1), share(F.col("lean") <= PROSE / 2)).first()
        # shares of places beside furniture: of furniture and of content; never quite 0 or 1
        own, other = (min(0.98, max(0.02, x if x is not None else 0.5)) for x in (own, other))
        hit, miss = (math.log(own / other), math.log((1 - own) / (1 - other))) if own - other > 0.05 else (0.0, 0.0)
        odds = sums.where(F.col("group").isNotNull()).select("group", (F.col("hits") * hit + (F.col("n") - F.col("hits")) * miss).alias("odds"))
    return odds


def classify(pages: DataFrame, names: DataFrame, least: int = 8, rounds: int = 4) -> DataFrame:
    """(table, key, line_no, content) for every non-blank line.

    pages: (table, key, text); names: (title), the known titles of openings. least: places from which a form is judged as
    one; rounds: how often what was learned is used to learn. A page of one line, a page without content and a
    very long page are treated like any other; null texts have no lines.
    """
    lines = salted_join(cut(blocks(pages), "page-blocks"), _titles(names), ["label"], F.col("page")).drop("label")
    lines = cut(_grouped(lines.withColumn("title", F.coalesce("title", F.lit(False))), least), "page-lines")
    lines = salted_join(lines, furniture_odds(lines, rounds), ["group"], F.col("page"))
    odds = F.col("lean") + F.coalesce("odds", F.lit(0.0))
    decided = F.when(F.col("title"), None).when(odds > CLEAR, False).when(odds < -CLEAR, True)
    lines = lines.select("table", "key", "line_no", "title", "colon", decided.alias("decided"))
    page = W.partitionBy("table", "key").orderBy("line_no")
    lines = lines.withColumns(
        {
            "before": F.last("decided", ignorenulls=True).over(page.rowsBetween(W.unboundedPreceding, -1)),
            "after": F.first("decided", ignorenulls=True).over(page.rowsBetween(1, W.unboundedFollowing)),
            "begun": F.coalesce(F.max("decided").over(page.rowsBetween(W.unboundedPreceding, -1)), F.lit(False)),
            "next_title": F.coalesce(F.lead("title").over(page), F.lit(False)),
            "next_decided": F.lead("decided").over(page),
        }
    )
    own = F.when(F.col("after").isNull(), F.coalesce("before", F.lit(False))).when(F.col("before") == F.col("after"), F.col("after")).otherwise(F.coalesce(F.col("after"), F.lit(False)) | F.col("colon"))
    content = (
        F.when(F.col("decided").isNotNull(), F.col("decided"))
        # the title of the posting is the last title before it begins
        .when(F.col("title"), ~F.col("begun") & ~F.col("next_title") & F.coalesce("after", F.lit(True)) & F.coalesce("next_decided", F.lit(True)))
        .otherwise(own)
    )
    return lines.select("table", "key", "line_no", content.alias("content"))


def found(ats_jobs: DataFrame, jobs: DataFrame) -> DataFrame:
    """(source_table, record_id, line_no): the non-blank lines outside the posting, in both tables.

    Records of template residue or error pages have no rows.
    """
    none = residue.page_residue(ats_jobs, "scrape_id", "jd_text", "page_url").select(F.col("key").alias("scrape_id"))
    a = ats_jobs.join(none, "scrape_id", "left_anti").select(F.lit("scraped_ats_jobs").alias("table"), F.col("scrape_id").cast("string").alias("key"), F.col("jd_text").alias("text"))
    b = jobs.select(F.lit("jobs").alias("table"), F.col("id").cast("string").alias("key"), F.col("jd_text").alias("text"))
    names = ats_jobs.select("title").unionByName(jobs.select("title"))
    lines = classify(a.unionByName(b), names)
    return lines.where(~F.col("content")).select(F.col("table").alias("source_table"), F.col("key").alias("record_id"), "line_no")
