"""Texts that lost their end at a length limit or in transfer.

Plan: lengths in characters and bytes are counted by source over distinct texts; a length whose count
stands out from its neighbourhood is a limit, and texts at a limit without a closing mark are cut. Other
cuts are found by how words are used in the whole corpus: for each word, how often it closes a line or an
item and how often another word follows. Both tables are small aggregates; the word of each text's end is
joined with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wrenlake.functions.text import SPACE, let, utrim
from wrenlake.llm.residue import STOP_RE
from wrenlake.operators.skew import salted_join

CLOSED = r"[.!?。！？।؟][\"'”’»›)\]」』]*+$|\([^()\n]*+\)$|\[[^\[\]\n]*+\]$"
ELLIPSIS = r"(?:…|\.\.\.)[\"'”’»)\]]*$"
#: an end that always waits for more: separators, opening marks, half a tag or entity, half a character
DANGLING = r"(?:[,;:—–/&<(\[{“«‹„=\\�-]|<[A-Za-z/][^<>\n]{0,40}|&[A-Za-z#0-9]{1,8}|\([^()\n]{0,80}|„[^“”\n]{0,200})$"


def _core(word: Column) -> Column:
    """The word without marks round it, lower case, digits masked."""
    bare = F.regexp_replace(word, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}+#%]+$", "")
    return F.regexp_replace(F.lower(bare), r"\d+", "0")


def length_limits(texts: DataFrame, window: int = 20) -> DataFrame:
    """(source, unit, len, n, expected): lengths that many more distinct texts have than their neighbours.

    texts: (source, text). A length stands out when its count exceeds the mean of the lengths within
    ``window`` by six deviations and by half as much again.
    """
    one = texts.select("source", F.xxhash64("text").alias("h"), F.length("text").alias("chars"), F.octet_length("text").alias("bytes"))
    counted = (
        one.distinct()
        .select("source", F.explode(F.create_map(F.lit("chars"), F.col("chars"), F.lit("bytes"), F.col("bytes"))).alias("unit", "len"))
        .groupBy("source", "unit", "len")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    around = W.partitionBy("source", "unit").orderBy("len").rangeBetween(-window, window)
    low = W.partitionBy("source", "unit").orderBy("len").rangeBetween(-window, -5)
    expected = (F.sum("n").over(low)) / F.lit(window - 4)
    wide = (F.sum("n").over(around) - F.col("n")) / F.lit(2 * window)
    return (
        counted.withColumn("expected", F.coalesce(expected, wide, F.lit(0.0)))
        .where(F.col("n") > 2.5 * F.col("expected") + 6 * F.sqrt("expected") + 6)
        .select("source", "unit", "len", "n", "expected")
    )


def word_ends(texts: DataFrame) -> DataFrame:
    """(word, closes, goes_on, finals): uses of each word before a line end or mark, before another word, and
    as the last of a text, which may be cut and is counted apart.
    """
    marked = F.concat(utrim(F.col("text")), F.lit("\u0001"))
    marked = F.regexp_replace(marked, r"(?U)[^\S\n]*\n\s*", "\u0002 ")
    raw = texts.select(F.explode(F.split(marked, r"(?U)[\s]+")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    # the patterns run over distinct words only
    return (
        raw.where(F.col("w") != "")
        .select(_core(F.regexp_replace("w", "[\u0001\u0002]", "")).alias("word"), F.col("w").endswith("\u0001").alias("final"), F.col("w").rlike("[.,;!?)”»\u0002]$").alias("closes"), "n")
        .where(F.col("word") != "")
        .groupBy("word")
        .agg(
            F.sum(F.when(~F.col("final") & F.col("closes"), F.col("n")).otherwise(0)).alias("closes"),
            F.sum(F.when(~F.col("final") & ~F.col("closes"), F.col("n")).otherwise(0)).alias("goes_on"),
            F.sum(F.when(F.col("final"), F.col("n")).otherwise(0)).alias("finals"),
        )
    )


def _template(line: Column) -> Column:
    """The line with capitalised words and figures masked, as a hash."""
    masked = F.regexp_replace(F.regexp_replace(line, r"\p{Lu}[\p{L}\p{N}&.’'-]*(?:\s+(?:&\s+)?\p{Lu}[\p{L}\p{N}&.’'-]*)*+", "X"), r"\d+", "0")
    return F.xxhash64(masked)


def known_lines(texts: DataFrame, least: int = 2) -> DataFrame:
    """(template): forms of lines that stand whole, before another line, in ``least`` places or more."""
    all_lines = F.split(utrim(F.col("text")), "\n", -1)
    lines = texts.where(F.col("text").contains("\n")).select(F.explode(let(all_lines, lambda ls: F.slice(ls, 1, F.size(ls) - 1))).alias("line"))
    lines = lines.select(utrim(F.col("line")).alias("line"))
    return lines.where(F.col("line") != "").groupBy(_template(F.col("line")).alias("template")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("template", F.lit(True).alias("known"))


def truncated(texts: DataFrame, rare: int = 2, share: float = 0.04) -> DataFrame:
    """(source, key, at_limit): the texts that lost their end. texts: (source, key, text).

    Cut is a text that ends in a separator, an opening mark or half a character; that stands at a limit
    of its source without a closing mark (or with one, where the limit holds far more such texts than
    chance gives); that ends in the middle of a sentence; or whose last word the corpus hardly knows or
    hardly ever closes an item with (less than ``share`` of its uses). A closed text off the limits is
    whole. Null and blank texts give no row. Ties and repeated rows are judged alike.
    """
    rows = texts.where(F.col("text").isNotNull() & (utrim(F.col("text")) != ""))
    limits = length_limits(rows)
    end = utrim(F.col("text"))
    line = utrim(F.substring_index(end, "\n", -1))
    rows = rows.select("source", "key", F.length("text").alias("chars"), F.octet_length("text").alias("bytes"), line.alias("line"))
    rows = rows.withColumns(
        {
            "elided": F.col("line").rlike(ELLIPSIS),
            "closed": F.col("line").rlike(CLOSED),
            "dangling": F.col("line").rlike(DANGLING),
            "word": _core(F.element_at(F.split(F.rtrim(F.col("line"), F.lit(SPACE + ".…[]")), r"(?U)\s+"), -1)),
            # a line of sentences that stops without a mark
            "prose": F.col("line").rlike(r"[.!?]['\"”’»)]*\s+[“\"«(]?\p{Lu}") | ((F.regexp_count("line", F.lit(STOP_RE)) >= 6) & (F.length("line") >= 70)),
        }
    )
    rows = rows.withColumn("template", F.when(F.col("prose") & ~F.col("closed"), _template(F.col("line")))).drop("line")
    rows = salted_join(rows, known_lines(texts), ["template"], F.col("key"))
    for unit in ("chars", "bytes"):
        of = limits.where(F.col("unit") == unit).select("source", F.col("len").alias(unit), F.col("n").alias(f"n_{unit}"), F.col("expected").alias(f"e_{unit}"))
        rows = salted_join(rows, of, ["source", unit], F.col("key"))
    at_limit = F.col("n_chars").isNotNull() | F.col("n_bytes").isNotNull()
    excess = F.greatest(
        F.coalesce(F.col("n_chars") / (F.col("e_chars") + 1), F.lit(0.0)), F.coalesce(F.col("n_bytes") / (F.col("e_bytes") + 1), F.lit(0.0))
    )
    rows = salted_join(rows.withColumns({"at_limit": at_limit, "excess": excess}), word_ends(texts), ["word"], F.col("key"))
    uses = F.coalesce(F.col("closes") + F.col("goes_on"), F.lit(0))
    # cuts fall on words as often as these are used; a known word that ends more texts than that also closes
    ends = F.col("closes") + F.when(F.col("finals") >= 5, F.col("finals")).otherwise(0)
    odd = (F.col("word") != "") & ((uses < rare) | (ends < share * (uses + F.col("finals"))))
    whole = F.col("closed") & ~F.col("elided")
    cut_end = (
        F.when(F.col("dangling"), True)
        .when(F.col("at_limit") & (F.col("excess") >= 8), True)
        .when(F.col("at_limit") & ~whole, True)
        .when(whole, False)
        .when(F.col("elided"), odd)
        .otherwise(odd | (F.col("prose") & F.col("known").isNull()))
    )
    return rows.where(cut_end).select("source", "key", "at_limit")


def _both(profiles: DataFrame, ats_jobs: DataFrame) -> list[tuple[str, DataFrame]]:
    return [
        ("scraped_profiles", profiles.select(F.coalesce("capture_source", F.lit("")).alias("source"), F.col("scrape_id").alias("key"), F.col("profile_text").alias("text"))),
        ("scraped_ats_jobs", ats_jobs.select(F.coalesce("vendor", F.lit("")).alias("source"), F.col("scrape_id").alias("key"), F.col("jd_text").alias("text"))),
    ]


def found(profiles: DataFrame, ats_jobs: DataFrame) -> DataFrame:
    """(source_table, scrape_id) of the records whose text lost its end."""
    a, b = [truncated(df).select(F.lit(name).alias("source_table"), F.col("key").alias("scrape_id")) for name, df in _both(profiles, ats_jobs)]
    return a.unionByName(b)


def shares(profiles: DataFrame, ats_jobs: DataFrame) -> DataFrame:
    """(source_table, source, texts, cut, cut_at_limit, cut_by_words, share) by capture source and vendor.

    cut_at_limit stand at a length limit of their source; cut_by_words are those whose last words alone show the cut.
    """
    parts = []
    for name, df in _both(profiles, ats_jobs):
        total = df.where(F.col("text").isNotNull() & (utrim(F.col("text")) != "")).groupBy("source").agg(F.count(F.lit(1)).alias("texts"))
        cut_rows = truncated(df).groupBy("source").agg(F.count(F.lit(1)).alias("cut"), F.count_if("at_limit").alias("cut_at_limit"))
        parts.append(
            total.join(cut_rows, "source", "left")
            .na.fill(0, ["cut", "cut_at_limit"])
            .select(F.lit(name).alias("source_table"), "source", "texts", "cut", "cut_at_limit", (F.col("cut") - F.col("cut_at_limit")).alias("cut_by_words"), (F.col("cut") / F.col("texts")).alias("share"))
        )
    return parts[0].unionByName(parts[1])
