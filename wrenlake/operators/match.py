"""Fuzzy matching of short names by trigrams and containment, and links only where a match is unique."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenlake.functions.text import char_trigrams, collapse, utrim
from wrenlake.session import cut

# Legal suffix words that normalisation removes anywhere in a name.
SUFFIXES = ("inc", "llc", "ltd", "limited", "corp", "corporation", "gmbh", "plc", "co", "sa", "ag", "bv", "nv", "pvt", "pte")


def normalise_company(c: Column) -> Column:
    """Lower case, legal suffix words gone, punctuation to blanks, blanks collapsed."""
    bare = F.regexp_replace(F.lower(c), r"\b(?:" + "|".join(SUFFIXES) + r")\b", "")
    return collapse(F.regexp_replace(bare, r"[.,()|·•@]", " "))


def contains_either(a: Column, b: Column, least: int = 3) -> Column:
    """One text contains the other literally; both have ``least`` characters or more."""
    return (F.length(a) >= least) & (F.length(b) >= least) & (F.contains(a, b) | F.contains(b, a))


def _inner_grams(c: Column) -> Column:
    return F.when(
        F.length(c) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substring(c, i, 3)))
    ).otherwise(F.array(c))


def fuzzy_pairs(left: DataFrame, right: DataFrame, least: float = 0.4) -> DataFrame:
    """(a, b, sim) of distinct names that contain one another or whose trigram similarity is ``least`` or more.

    left: (a), right: (b). Candidates come from two equality joins. A pair of that similarity shares one
    of the rarest trigrams of either side (prefix filter); a contained name's rarest inner trigram stands
    in the name that contains it. So frequent trigrams never form buckets. Null and blank names match
    nothing; names of one or two characters match every name that holds them.
    """
    l = left.select("a").where(utrim(F.col("a")) != "").distinct()
    r = right.select("b").where(utrim(F.col("b")) != "").distinct()
    names = l.select(F.col("a").alias("x")).union(r.select("b")).distinct()
    low = names.withColumn("low", F.lower("x"))
    grams = low.select("x", F.explode(char_trigrams(F.col("low"))).alias("g"))
    rarity = grams.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    ranked = grams.join(rarity, "g").groupBy("x").agg(F.sort_array(F.collect_list(F.struct("df", "g"))).alias("gs"))
    prefix = F.size("gs") - F.ceil(F.size("gs") * least).cast("int") + 1
    ranked = cut(ranked, "match-trigrams")
    by_sim = ranked.select("x", F.explode(F.slice("gs", F.lit(1), prefix)).alias("s")).select("x", F.col("s.g").alias("g"))
    inner = low.select("x", F.explode(_inner_grams(F.col("low"))).alias("g"))
    inner_df = inner.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    rarest = cut(inner.join(inner_df, "g").groupBy("x").agg(F.min(F.struct("df", "g")).alias("m")).select("x", F.col("m.g").alias("g")), "match-rarest")

    short = names.select(F.lower("x").alias("g")).where(F.length("g") < 3).distinct()
    bits = F.flatten(F.transform(F.sequence(F.lit(1), F.length("low")), lambda i: F.array(F.substring(F.col("low"), i, 1), F.substring(F.col("low"), i, 2))))
    inner = inner.union(low.select("x", F.explode(F.array_distinct(bits)).alias("g")).join(short, "g", "left_semi").select("x", "g"))

    inner = cut(inner, "match-inner")

    def joined(p: DataFrame, q: DataFrame) -> DataFrame:
        return l.join(p.withColumnRenamed("x", "a"), "a").join(r.join(q.withColumnRenamed("x", "b"), "b"), "g").select("a", "b")

    pairs = joined(by_sim, by_sim).union(joined(rarest, inner)).union(joined(inner, rarest)).distinct()
    # each name's trigrams are made once, not once a pair
    sets = names.join(ranked.select("x", F.transform("gs", lambda s: F.xxhash64(s["g"])).alias("g")), "x", "left").select("x", F.coalesce("g", F.array().cast("array<bigint>")).alias("g"))
    pairs = pairs.join(sets.toDF("a", "ga"), "a").join(sets.toDF("b", "gb"), "b")
    pairs = pairs.withColumn("both", F.size(F.array_intersect("ga", "gb"))).withColumn("all", F.size("ga") + F.size("gb") - F.col("both"))
    held = F.contains(F.lower("a"), F.lower("b")) | F.contains(F.lower("b"), F.lower("a"))
    sim = F.when(F.col("all") > 0, F.col("both") / F.col("all")).otherwise(0.0)
    return pairs.withColumn("sim", sim).where(held | (F.col("sim") >= least)).select("a", "b", "sim")


def strict_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b): distinct names whose normalised forms contain one another, three characters at least."""
    norm = lambda df, c: df.where(F.col(c).isNotNull()).select(c, normalise_company(F.col(c)).alias(f"n_{c}")).distinct().where(F.length(f"n_{c}") >= 3)
    l, r = norm(left, "a"), norm(right, "b")
    forms = l.select(F.col("n_a").alias("x")).union(r.select("n_b")).distinct()
    inner = forms.select("x", F.explode(_inner_grams(F.col("x"))).alias("g"))
    df = inner.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    rarest = inner.join(df, "g").groupBy("x").agg(F.min(F.struct("df", "g")).alias("m")).select("x", F.col("m.g").alias("g"))
    one = rarest.withColumnRenamed("x", "n_a").join(inner.withColumnRenamed("x", "n_b"), "g").select("n_a", "n_b")
    two = inner.withColumnRenamed("x", "n_a").join(rarest.withColumnRenamed("x", "n_b"), "g").select("n_a", "n_b")
    forms_pairs = one.union(two).distinct().where(F.contains("n_a", F.col("n_b")) | F.contains("n_b", F.col("n_a")))
    return forms_pairs.join(l, "n_a").join(r, "n_b").select("a", "b")


def unique_links(rows: DataFrame, pairs: DataFrame, targets: DataFrame) -> DataFrame:
    """(id, matches, target): the only target that a row's name matches; null where none or several do.

    rows: (id, a); pairs: (a, b); targets: (target, b). Counted before anything is filtered.
    """
    per_name = targets.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.min("target").alias("t"))
    per_a = pairs.join(per_name, "b").groupBy("a").agg(F.sum("n").alias("n"), F.min("t").alias("t"))
    out = rows.join(per_a, "a", "left")
    return out.select("id", F.coalesce("n", F.lit(0)).alias("matches"), F.when(F.col("n") == 1, F.col("t")).alias("target"))
