"""Variant spellings of organisations' names, linked by merge-and-rematch.

Plan:

1. Every distinct string is parsed once to a form: marks, case, legal suffixes and office names go, the
   words are ordered. Strings of one form, or of one form when written together, are one record.
2. Records that share a word up to one edit, and the initials of their other words, are compared word by
   word; agreeing ones merge (connected components) to a profile. A profile holds all spellings and initials of its
   records: at each place of the name the set of words that stood there.
3. Rounds: profiles that grew enter blocking again with everything they hold. A record may fit a profile place by
   place, each word by another spelling, although it fits none of the spellings whole (a typo here, an
   abbreviation there). Abbreviations, initials and single first words are matched too; what fits exactly one
   profile merges with it. A richer profile fits more, and two that have become one are no longer ambiguous, so
   the rounds go on until nothing merges.

Parsing and comparing are short Python functions over Arrow batches; blocking, joining, counting and
merging are Spark's. No block is gathered in one place; hot blocks are spread over tasks.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenlake.operators.components import connected_components
from wrenlake.operators.skew import spread_join
from wrenlake.session import cut, drop

# Legal forms and group words that end a name.
LEGAL = frozenset(
    "ltd limited inc incorporated llc llp lp plc corp corporation co company gmbh mbh ag kg kgaa ug ohg gbr se sa sas sarl sasu srl spa sl slu bv nv "
    "ab as asa oy oyj aps pty pte pvt kk group groupe gruppe grupo holding holdings ev eu".split()
)
# Entries that name no employer.
NO_EMPLOYER = frozenset(
    "freelance;freelancer;freelancing;self employed;selfemployed;self;independent;independent consultant;independent contractor;consultant;contractor;"
    "various;various clients;several;multiple;confidential;confidential company;undisclosed;private;stealth;stealth startup;stealth mode;stealth mode startup;startup;"
    "open to work;opentowork;looking for work;looking for opportunities;looking for a job;seeking opportunities;seeking new opportunities;job seeker;jobseeker;actively looking;available;"
    "unemployed;between jobs;in transition;career break;sabbatical;parental leave;retired;student;none;na;n a;nil;null;undefined;unknown;tbd;tba;test;other;company;employer;my company;home;"
    "freiberuflich;freiberufler;selbstandig;selbststandig;arbeitssuchend;vertraulich;verschiedene;diverse;indépendant;independant;a mon compte;sans emploi;en recherche;en recherche d emploi;confidentiel;divers;"
    "autonomo;por cuenta propia;desempleado;en busqueda;en busca de empleo;independiente;confidencial;varios;trabajador autonomo;autoentrepreneur;auto entrepreneur;not applicable;not specified;not disclosed;no company".split(";")
)
_DOTTED = re.compile(r"^(?:\w\.\s?){2,6}\w?\.?$")
_CAPS = re.compile(r"^[A-Z]{2,6}$")
_CAMEL = re.compile(r"(?<=[a-zß-ÿ])(?=[A-ZÀ-Þ])")
_OFFICE = re.compile(r"\s*\|.*$|\s+[-–—]\s+.*$|\s*[,;]?\s+(?:office|branch|campus)$", re.I)


def fold(s: str) -> str:
    """Lower case without marks, blanks of one kind."""
    s = unicodedata.normalize("NFKD", s)
    s = "".join(c for c in s if not unicodedata.combining(c)).casefold()
    return " ".join(s.split())


def parse(name: str) -> tuple[str, list[str], list[str] | None] | None:
    """(kind, words, other) with kind 'initials' or 'name'; None where the entry names no employer.

    other: the words with those in brackets, which may be an office or the rest of the name.
    """
    raw = " ".join(unicodedata.normalize("NFKC", name).split()).strip()
    plain = " ".join(re.findall(r"\w+", fold(raw)))
    if not re.search(r"[^\W\d_]", plain) or plain in NO_EMPLOYER:
        return None
    if _DOTTED.match(raw) or _CAPS.match(raw):
        letters = re.sub(r"[^a-z]", "", fold(raw))
        if letters not in LEGAL and len(letters) > 1:
            return "initials", [letters], None
    other = None
    bare = _OFFICE.sub("", raw)
    if re.search(r"\w", bare):
        raw = bare
    inner = re.search(r"^(.*?)\s*\(([^()]*)\)\s*(.*)$", raw)
    if inner:
        head = f"{inner[1]} {inner[3]}".strip()
        # a remark after a whole name; after a single word it completes the name
        other = _words(f"{head} {inner[2]}")
        raw = head if len(_words(head)) >= 2 or not inner[2].strip() else f"{head} {inner[2]}"
    parts = [p for p in raw.split(",") if p.strip()]
    if len(parts) == 2 and not set(_words(parts[1])) - LEGAL:
        raw = parts[0]
    elif len(parts) == 2 and _words(parts[0]):
        raw = f"{parts[1]} {parts[0]}"
    words = _words(raw)
    if not words:
        words = [w for w in re.findall(r"\w+", fold(raw))]
    joined = " ".join(words)
    if not words or joined in NO_EMPLOYER:
        return None
    return "name", words, other if other != words else None


def _words(raw: str) -> list[str]:
    """Words without legal suffixes, a leading article or joining words."""
    if " " not in raw.strip():
        raw = _CAMEL.sub(" ", raw)
    s = fold(re.sub(r"(?<=\w)[./](?=\w)|(?<=\w)\.", lambda m: "" if m[0] != " " else " ", raw))
    words = [w for w in re.findall(r"[^\W_]+", s.replace("'", "").replace("’", "")) if w not in ("and", "und", "et", "y")]
    if len(words) > 1 and words[0] == "the":
        words = words[1:]
    while len(words) > 1 and words[-1] in LEGAL:
        words = words[:-1]
    return words


def one_edit(a: str, b: str) -> bool:
    """Equal, or one insertion, deletion, substitution or swap of neighbours apart."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y or x == y[1:] or x[1:] == y[1:] or (len(x) > 1 and len(y) > 1 and x[0] == y[1] and x[1] == y[0] and x[2:] == y[2:])


def same_words(a: list[str], b: list[str], common: frozenset | set) -> bool:
    """Word by word equal up to one edit each, at most two in all, in any order.

    A word that differs has six letters or more, or four where either side is a ``common`` or the last one of several, or the name has four words or more.
    """
    if len(a) != len(b):
        return False
    left = Counter(a) - Counter(b)
    right = Counter(b) - Counter(a)
    x, y = list(left.elements()), list(right.elements())
    if len(x) > 2:
        return False

    def near(p: str, q: str) -> bool:
        last = len(a) > 1 and (p == a[-1] or q == b[-1])
        return max(len(p), len(q)) >= (4 if last or len(a) >= 4 or p in common or q in common else 6) and one_edit(p, q)

    return all(map(near, x, y)) or all(map(near, x, reversed(y)))


def fits_places(words: list[str], places: list[list[str]]) -> bool:
    """Every word is one of its place's spellings, or up to two words are a typo or abbreviation of one.

    The first word is never abbreviated.
    """
    odd = 0
    for i, (w, known) in enumerate(zip(words, places)):
        if w in known:
            continue
        odd += 1
        least = 4 if i and i == len(words) - 1 else 6
        typo = any(max(len(w), len(v)) >= least and one_edit(w, v) for v in known)
        if not typo and not (i and any(shortens(w, v) or shortens(v, w) for v in known)):
            return False
    return odd <= 2


def shortens(a: str, b: str) -> bool:
    """a is shorter than b, begins alike and keeps b's order of letters."""
    if len(a) >= len(b) or len(a) < 2 or a[0] != b[0]:
        return False
    at = iter(b)
    return all(c in at for c in a)


def abbreviates(short: list[str], full: list[str]) -> bool:
    """The short form's words cut down the full form's: word by word, or first and last word of a longer one."""
    if len(full) < 2 or len(short) > len(full):
        return False
    if len(short) == 1:
        return short[0] == full[0] or (len(short[0]) >= 6 and full[0].startswith(short[0]))
    first = short[0] == full[0] or (len(short[0]) >= 4 and full[0].startswith(short[0]))
    if not first:
        return False
    if len(short) == len(full):
        rest = [(x == y, shortens(x, y)) for x, y in zip(short[1:], full[1:])]
        return all(e or s for e, s in rest) and (any(s for _, s in rest) or short[0] != full[0])
    return all(shortens(x, y) for x, y in ((short[0], full[0]), (short[-1], full[-1]))) and len(short) == 2


def records(names: DataFrame) -> DataFrame:
    """(name, node, kind, words) of distinct names; entries without an employer are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(n, p) for n in b["name"] if (p := parse(n))]
            yield pd.DataFrame(
                {
                    "name": [n for n, _ in out],
                    "node": [" ".join(sorted(p[1])) if p[0] == "name" else "." + p[1][0] for _, p in out],
                    "kind": [p[0] for _, p in out],
                    "words": [p[1] for _, p in out],
                    "o_node": [" ".join(sorted(p[2])) if p[2] else None for _, p in out],
                    "o_words": [p[2] for _, p in out],
                }
            )

    made = cut(names.mapInPandas(run, "name string, node string, kind string, words array<string>, o_node string, o_words array<string>"), "name-forms")
    # words in brackets belong to the name where another string has them in it
    known = made.select(F.col("node").alias("o_node"), F.lit(True).alias("whole")).distinct()
    made = made.join(known, "o_node", "left")
    return made.select("name", F.when(F.col("whole"), F.col("o_node")).otherwise(F.col("node")).alias("node"), "kind", F.when(F.col("whole"), F.col("o_words")).otherwise(F.col("words")).alias("words"))


def common_words(nodes: DataFrame, partners: int = 10) -> DataFrame:
    """(w, common): words that mostly end names and follow many different first words."""
    each = nodes.where(F.size("words") >= 2).select(F.element_at("words", 1).alias("first"), F.size("words").alias("n"), F.posexplode("words").alias("i", "w"))
    return (
        each.groupBy("w")
        .agg(F.avg((F.col("i") == F.col("n") - 1).cast("double")).alias("last"), F.approx_count_distinct("first", 0.03).alias("firsts"))
        .where((F.col("last") >= 0.6) & (F.col("firsts") >= partners))
        .select("w", F.lit(True).alias("common"))
    )


def _less_one(w: Column) -> Column:
    """The word and, from five letters on, all it can be with one letter less."""
    less = F.transform(F.sequence(F.lit(1), F.length(w)), lambda k: F.concat(F.substring(w, F.lit(1), k - 1), F.substring(w, k + 1, F.length(w))))
    return F.array_distinct(F.concat(F.array(w), F.when(F.length(w) >= 5, less).otherwise(F.array().cast("array<string>"))))


def _typo_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b): nodes whose words agree up to small edits."""
    each = nodes.where(F.col("kind") == "name").select("node", "words", F.posexplode("words").alias("i", "w"))
    each = each.join(common_words(nodes), "w", "left").withColumn("common", F.coalesce("common", F.lit(False)))
    marked = each.groupBy("node").agg(F.first("words").alias("words"), F.collect_list(F.when(F.col("common"), F.col("w"))).alias("commons"), F.collect_list(F.when(~F.col("common"), F.struct("i", "w"))).alias("own"))
    marked = cut(marked, "name-words")
    # of each word that is not common: itself and itself less one letter, with the initials of the others
    own = marked.select("node", "words", F.explode("own").alias("o")).select("node", "words", F.col("o.i").alias("i"), F.col("o.w").alias("w"))
    rest = F.array_join(F.array_sort(F.filter(F.transform("words", lambda x, j: F.when(j != F.col("i"), F.substring(x, 1, 1))), lambda x: x.isNotNull())), "")
    keyed = own.select("node", F.size("words").alias("n"), rest.alias("rest"), F.explode(_less_one(F.col("w"))).alias("k"))
    keyed = keyed.select("node", F.xxhash64("k", "rest", "n").alias("key")).distinct()
    pairs = spread_join(keyed.withColumnRenamed("node", "a"), keyed.withColumnRenamed("node", "b"), ["key"], F.col("a")).where("a < b").select("a", "b").distinct()
    side = lambda c: marked.select(F.col("node").alias(c), F.col("words").alias(f"w_{c}"), F.col("commons").alias(f"c_{c}"))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            keep = [same_words(list(x), list(y), {*c, *d}) for x, y, c, d in zip(p["w_a"], p["w_b"], p["c_a"], p["c_b"])]
            yield p.loc[keep, ["a", "b"]]

    return pairs.mapInPandas(run, "a string, b string")


def _short_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b): node a can be an abbreviation, the initials or the first word of node b."""
    named = nodes.where(F.col("kind") == "name")
    first = F.element_at("words", 1)
    end = F.substring(F.element_at("words", -1), 1, 1)
    # b's first word whole and all its beginnings that a can have: of four letters, six where a is one word
    begun = lambda least: F.array_distinct(F.concat(F.array(first), F.when(F.length(first) > least, F.transform(F.sequence(F.lit(least), F.length(first) - 1), lambda n: F.substring(first, F.lit(1), n))).otherwise(F.array().cast("array<string>"))))
    full = named.where(F.size("words") >= 2).select(F.col("node").alias("b"), F.col("words").alias("w_b"), end.alias("end"), begun(6).alias("one"), begun(4).alias("many"))
    short = named.select(F.col("node").alias("a"), F.col("words").alias("w_a"), first.alias("start"), F.when(F.size("words") > 1, end).otherwise("").alias("end"))
    keys = full.select("b", "w_b", F.explode("one").alias("start"), F.lit("").alias("end")).unionByName(full.select("b", "w_b", F.explode("many").alias("start"), "end"))
    pairs = spread_join(short, keys, ["start", "end"], F.col("a")).where((F.col("a") != F.col("b")) & (F.size("w_a") <= F.size("w_b")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            keep = [abbreviates(list(x), list(y)) for x, y in zip(p["w_a"], p["w_b"])]
            yield p.loc[keep, ["a", "b"]]

    cut_down = pairs.select("a", "b", "w_a", "w_b").mapInPandas(run, "a string, b string")
    letters = F.array_join(F.transform("words", lambda w: F.substring(w, 1, 1)), "")
    by_letters = nodes.where(F.col("kind") == "initials").select(F.col("node").alias("a"), F.element_at("words", 1).alias("l")).join(named.where(F.size("words") >= 2).select(F.col("node").alias("b"), letters.alias("l")), "l")
    return cut_down.unionByName(by_letters.select("a", "b"))


def _rematched(nodes: DataFrame, entity: DataFrame, grown: DataFrame) -> DataFrame:
    """(short, full): profiles of which a spelling fits, place by place, what a grown profile holds.

    entity: (id, component); grown: (component). The blocks are the words at a profile's first place up to one
    letter, with the number of words and the initial of the last.
    """
    named = nodes.where((F.col("kind") == "name") & (F.size("words") >= 2)).join(entity.select(F.col("id").alias("node"), "component"), "node")
    last = F.substring(F.element_at("words", -1), 1, 1)
    seek = named.select(F.col("component").alias("short"), "words", F.size("words").alias("n"), last.alias("end"), F.explode(_less_one(F.element_at("words", 1))).alias("k"))
    held = named.join(grown, "component", "left_semi").select("component", F.size("words").alias("n"), F.posexplode("words").alias("i", "w")).distinct()
    # a profile's words by place: those of one name, which grow with its spellings and not with the table
    places = held.groupBy("component", "n", "i").agg(F.collect_set("w").alias("ws")).groupBy("component", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "ws"))), lambda x: x["ws"]).alias("places"))
    places = places.where(F.exists("places", lambda x: F.size(x) > 1))
    ends = F.array_distinct(F.transform(F.element_at("places", -1), lambda w: F.substring(w, 1, 1)))
    firsts = F.array_distinct(F.flatten(F.transform(F.element_at("places", 1), _less_one)))
    offer = places.select(F.col("component").alias("full"), "n", "places", ends.alias("ends"), F.explode(firsts).alias("k")).withColumn("end", F.explode("ends")).drop("ends")
    pairs = spread_join(seek, offer, ["k", "n", "end"], F.col("short")).where("short <> full").select("short", "full", "words", "places").dropDuplicates(["short", "full", "words"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            keep = [fits_places(list(w), [list(x) for x in v]) for w, v in zip(p["words"], p["places"])]
            yield p.loc[keep, ["short", "full"]]

    return pairs.mapInPandas(run, "short string, full string")


def resolve(names: DataFrame) -> DataFrame:
    """(name, entity) for every distinct name that names an employer.

    names: (name), repeated or null rows allowed. An ambiguous short form stays its own entity. Rounds end when
    nothing merges; each merges two profiles at least, so they do.
    """
    recs = cut(records(names.where(F.col("name").isNotNull()).distinct()), "name-records")
    # of the orders in which the words of a node occur, the usual one
    orders = recs.groupBy("node", "kind", "words").agg(F.count(F.lit(1)).alias("n"))
    nodes = orders.groupBy("node").agg(F.max(F.struct("n", "kind", "words")).alias("m")).select("node", "m.kind", "m.words")
    nodes = cut(nodes, "name-nodes")
    together = nodes.select("node", "kind", F.array_join("words", "").alias("joined"))
    # written together; capitals are a name too where there is one of these letters
    together = together.join(together.where(F.col("kind") == "name").groupBy("joined").agg(F.min("node").alias("b")), "joined").where("node <> b").select(F.col("node").alias("a"), "b")
    ids = nodes.select(F.col("node").alias("id"))
    entity = connected_components(ids, together.unionByName(_typo_pairs(nodes)))
    shorts = cut(_short_pairs(nodes), "name-shorts")
    grown = entity.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component")
    while True:
        of_a = entity.select(F.col("id").alias("a"), F.col("component").alias("short"))
        of_b = entity.select(F.col("id").alias("b"), F.col("component").alias("full"))
        fits = shorts.join(of_a, "a").join(of_b, "b").where("short <> full").select("short", "full").unionByName(_rematched(nodes, entity, grown)).distinct()
        single = fits.groupBy("short").agg(F.min("full").alias("full"), F.count(F.lit(1)).alias("n")).where("n = 1")
        merges = cut(single.select(F.col("short").alias("a"), F.col("full").alias("b")), "name-merges")
        if merges.isEmpty():
            break
        above = cut(connected_components(entity.select(F.col("component").alias("id")).distinct(), merges), "name-tops")
        grown = above.where("id <> component").select("component").distinct()
        entity = cut(entity.join(above.select(F.col("id").alias("component"), F.col("component").alias("top")), "component").select("id", F.col("top").alias("component")), "name-entities")
        drop(merges)
    return recs.select("name", "node").join(entity.select(F.col("id").alias("node"), F.col("component").alias("entity")), "node").select("name", "entity")


def _all(columns: tuple[DataFrame, ...]) -> DataFrame:
    names = columns[0].toDF("name")
    for c in columns[1:]:
        names = names.unionByName(c.toDF("name"))
    return names


def entities(*columns: DataFrame) -> DataFrame:
    """(name, entity, spellings): every string with its employer, named by a usual spelling, and how many strings that has."""
    linked = cut(resolve(_all(columns)), "name-linked")
    of = linked.groupBy("entity").agg(F.count(F.lit(1)).alias("spellings"), F.min("name").alias("first"))
    return linked.join(of, "entity").select("name", F.col("first").alias("entity"), "spellings")


def found(*columns: DataFrame) -> DataFrame:
    """(name_a, name_b): different strings of the given one-column tables that mean one employer."""
    linked = cut(resolve(_all(columns)), "name-linked")
    a, b = (linked.select("entity", F.col("name").alias(c)) for c in ("name_a", "name_b"))
    return spread_join(a, b, ["entity"], F.col("name_a")).where("name_a < name_b").select("name_a", "name_b")
