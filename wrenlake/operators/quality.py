"""Checks of written texts against the evidence they rest on."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wrenlake.functions.text import let, ngrams, numbers_in, sentences
from wrenlake.operators.skew import salted_join

# Words that carry no identity, so that sharing them tells nothing.
COMMON = tuple(
    "the a an and or but of to in on at for with about how what that this these those your you my i is are was were be been am do does did have has had it its their "
    "they them we our us me as by from into than then so if not no any all can could would will team teams role work working curious wanted recently applied "
    "application follow up regarding share like".split()
)
# Words before a rounded figure that go with the rounding.
HEDGES = ("over", "more than", "around", "about", "approximately", "nearly", "roughly", "almost", "upwards of", "north of")
# Headings of sections that restate what others report.
SUMMARIES = ("professional summary", "executive summary", "career summary", "summary", "profile", "professional profile", "about me", "about", "objective", "career objective")


def content_words(c: Column, exclude: Column | None = None) -> Column:
    """Lower-case words of three characters or more without edge dots, common words dropped and those of the array ``exclude`` too."""
    words = F.transform(F.split(F.lower(c), r"[^a-z0-9+#.]+"), lambda w: F.regexp_replace(w, r"^\.+|\.+$", ""))
    kept = F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*COMMON))
    return kept if exclude is None else F.filter(kept, lambda w: ~F.array_contains(exclude, w))


def prose_words(c: Column, exclude: Column | None = None) -> Column:
    """content_words() without plain figures."""
    return F.filter(content_words(c, exclude), lambda w: ~w.rlike(r"^[0-9.]+$"))


def required_words(*columns: Column) -> Column:
    """The words of a role's title and an employer's name, which a text has to hold and which prove nothing."""
    return F.array_distinct(F.filter(F.split(F.lower(F.concat_ws(" ", *columns)), r"[^a-z0-9+#.]+"), lambda w: w != ""))


_ADDRESSED = r"(?i)\byour?\b"


def ask_text(c: Column) -> Column:
    """The sentences that ask or address the reader."""
    return F.array_join(F.filter(sentences(c), lambda x: x.contains("?") | x.rlike(_ADDRESSED)), " ")


def claim_text(c: Column) -> Column:
    """The sentences that neither ask nor address the reader."""
    return F.array_join(F.filter(sentences(c), lambda x: ~x.contains("?") & ~x.rlike(_ADDRESSED)), " ")


def ungrounded(draft: Column, evidence: Column) -> Column:
    """Figures of the draft, repeats kept, that no figure of the evidence equals; without evidence all of them."""
    known = F.coalesce(numbers_in(evidence), F.array().cast("array<string>"))
    return let(known, lambda k: F.filter(numbers_in(draft), lambda n: ~F.array_contains(k, n)))


def faithfulness(draft: Column, evidence: Column) -> Column:
    """Share of the draft's figures that the evidence has; 1 where it has none."""
    n = F.size(numbers_in(draft))
    return F.when(n > 0, 1 - F.size(ungrounded(draft, evidence)) / n).otherwise(1.0)


def echoed(draft: Column, advert: Column, evidence: Column, n: int = 3) -> Column:
    """Distinct n-grams of prose words that the draft shares with the advert and not with the evidence."""
    g = lambda c: F.array_distinct(ngrams(prose_words(F.coalesce(c, F.lit(""))), n))
    return F.array_except(F.array_intersect(g(draft), g(advert)), g(evidence))


def repeats(messages: DataFrame, thread: str, order: list[str], key: str, text: str, n: int = 3) -> DataFrame:
    """(key, repeated): how many distinct n-grams of a message an earlier one of its thread has.

    n-grams are spread as rows, and the first message of each (thread, n-gram) comes from one window over
    that pair, so a busy thread isn't gathered in one place.
    """
    grams = messages.select(thread, *order, key, F.explode(F.array_distinct(ngrams(content_words(F.col(text)), n))).alias("g"))
    w = W.partitionBy(thread, "g").orderBy(*order, key)
    later = grams.withColumn("_n", F.row_number().over(w)).where("_n > 1")
    return later.groupBy(key).agg(F.countDistinct("g").alias("repeated"))


def repeated_figures(messages: DataFrame, thread: str, order: list[str], key: str, text: str) -> DataFrame:
    """(key, figures): how many figures of a message, repeats counted, an earlier one of its thread has."""
    each = messages.select(thread, *order, key, F.explode(numbers_in(F.col(text))).alias("figure")).groupBy(thread, *order, key, "figure").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy(thread, "figure").orderBy(*order, key)
    later = each.withColumn("_n", F.row_number().over(w)).where("_n > 1")
    return later.groupBy(key).agg(F.sum("n").alias("figures"))


class _Held:
    """The chunks of an owner, or a block of them, by their words and figures."""

    def __init__(self, many: bool):
        self.rows: list[tuple] = []
        self.many, self.ready = many, False

    def add(self, chunk, words: str | None, figures: str | None) -> None:
        self.rows.append((chunk, words.split() if words else [], figures.split() if figures else []))

    def _index(self) -> None:
        self.rows.sort(key=lambda r: (r[0] is None, r[0]))  # the first of equal counts has the smallest id
        self.ids = [r[0] for r in self.rows]
        self.many = self.many or len(self.rows) > 1
        places: dict[str, list[int]] = {}
        figures: dict[str, list[int]] = {}
        for i, (_, ws, ns) in enumerate(self.rows):
            for w in ws:
                places.setdefault(w, []).append(i)
            for n in ns:
                figures.setdefault(n, []).append(i)
        self.small = len(self.rows) <= 32
        self.places = places if self.small else {w: np.array(at, "i4") for w, at in places.items()}
        self.figures = figures
        self.rows, self.ready = [], True

    def fit(self, words: str, figures: str):
        """(shared, best, [(figure, shared by chunks that have it, the best one's id where it has it)]), None where this tells nothing."""
        if not self.ready:
            self._index()
        if not self.many or not self.ids:
            return None
        known = [at for at in map(self.places.get, words.split()) if at is not None]
        if self.small:
            shared = [0] * len(self.ids)
            for at in known:
                for i in at:
                    shared[i] += 1
            top = max(shared)
            first = shared.index(top)
        else:
            shared = np.bincount(np.concatenate(known), minlength=len(self.ids)) if known else np.zeros(len(self.ids), int)
            first = int(shared.argmax())
            top = int(shared[first])
        best = self.ids[first]
        of = [(n, max(int(shared[i]) for i in at), best if any(self.ids[i] == best for i in at) else None) for n in figures.split() if (at := self.figures.get(n))]
        return (top, best, of) if of or top >= 2 else None


def misattributed(drafts: DataFrame, chunks: DataFrame, key: str, text: str, owner: str, chunk_id: str, chunk_text: str, held: int = 32_768, busy: int = 2_000, helpers: int = 16) -> DataFrame:
    """(key, sentence_no, figure, best): figures placed in a sentence that fits another chunk than theirs.

    For sentences with a figure and three prose words or more: the chunk that shares most words is the best, the smaller
    id at ties; a figure is misplaced when some chunk has it, the best one has not, the best shares two words or more
    and at least two more than any chunk that has the figure. Each figure of a draft is reported once, at the first
    such sentence. Owners with one chunk are left out; an id of a chunk belongs to one owner. Repeated drafts change nothing.

    Sentences and chunks move once, to their owner, and are compared there: pairs of them, the square of a hot owner's
    rows, are never written. A task indexes at most about ``held`` chunks, and sentences stream past them; the
    sentences of an owner with ``busy`` drafts or more are spread over up to ``helpers`` copies of its chunks.
    """
    drafts, chunks = drafts.where(F.col(owner).isNotNull() & F.col(key).isNotNull()), chunks.where(F.col(owner).isNotNull())
    count = lambda df, name: df.groupBy(owner).agg(F.count(F.lit(1)).alias(name))
    # only owners of very many rows, so that the list is short
    hot = count(chunks, "_c").where(F.col("_c") > held).join(count(drafts, "_d").where(F.col("_d") >= busy), owner, "full")
    hot = F.broadcast(hot.select(owner, F.ceil(F.col("_c") / held).alias("_blocks"), F.least(F.lit(helpers), F.ceil(F.col("_d") / busy)).alias("_salts")))
    parted = lambda df: df.join(hot, owner, "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)).cast("int")).withColumn("_salts", F.coalesce("_salts", F.lit(1)).cast("int"))
    one_of = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)

    s = drafts.select(key, owner, F.posexplode(sentences(F.col(text))).alias("sentence_no", "s"))
    s = s.select(key, owner, "sentence_no", F.array_distinct(prose_words(F.col("s"))).alias("sw"), F.array_distinct(numbers_in(F.col("s"))).alias("sn"))
    s = parted(s.where((F.size("sn") > 0) & (F.size("sw") >= 3)))
    kinds = dict(drafts.dtypes)[key], dict(chunks.dtypes)[chunk_id]
    s = s.withColumn("_block", F.explode(every("_blocks"))).select(
        owner, (F.col("_block") * helpers + one_of(key, "_salts")).alias("_part"), "_blocks", F.lit(1).alias("_side"), key, "sentence_no", F.lit(None).cast(kinds[1]).alias("chunk"), F.array_join("sw", " ").alias("words"), F.array_join("sn", " ").alias("figures")
    )
    c = chunks.select(owner, F.col(chunk_id).alias("chunk"), F.array_join(F.array_distinct(prose_words(F.col(chunk_text))), " ").alias("words"), F.array_join(F.array_distinct(numbers_in(F.col(chunk_text))), " ").alias("figures"))
    c = parted(c).withColumn("_salt", F.explode(every("_salts"))).select(
        owner, (one_of("chunk", "_blocks") * helpers + F.col("_salt")).alias("_part"), "_blocks", F.lit(0).alias("_side"), F.lit(None).cast(kinds[0]).alias(key), F.lit(None).cast("int").alias("sentence_no"), "chunk", "words", "figures"
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, of = None, None
        for b in batches:
            rows = []
            for o, part, blocks, side, k, no, name, words, figures in zip(*(x.to_pylist() for x in b.columns)):
                if (o, part) != at:
                    at, of = (o, part), _Held(blocks > 1)
                if side == 0:
                    of.add(name, words, figures)
                elif found := of.fit(words, figures):
                    rows.append((k, no, *found))
            cols = list(zip(*rows)) or [()] * 5
            kind = b.schema.field("chunk").type
            figure = pa.struct([("figure", pa.string()), ("own", pa.int32()), ("held", kind)])
            of_figures = pa.array([[dict(zip(("figure", "own", "held"), x)) for x in xs] for xs in cols[4]], pa.list_(figure))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field(4).type), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], kind), of_figures], [key, "sentence_no", "top", "best", "of"])

    near = c.unionByName(s).repartition(owner, "_part").sortWithinPartitions(owner, "_part", "_side")
    fits = near.mapInArrow(compare, f"{key} {kinds[0]}, sentence_no int, top int, best {kinds[1]}, of array<struct<figure: string, own: int, held: {kinds[1]}>>")
    # blocks of an owner, and owners of one draft, are settled together
    by = [key, "sentence_no"]
    best = F.min(F.struct((-F.col("top")).alias("top"), F.col("best").isNull().alias("none"), "best"))
    each = fits.groupBy(*by).agg(best.alias("m"), F.flatten(F.collect_list("of")).alias("of")).where("m.top <= -2")
    each = each.select(*by, (-F.col("m.top")).alias("top"), F.col("m.best").alias("best"), F.explode("of").alias("f"))
    owners = each.groupBy(*by, F.col("f.figure").alias("figure"), "top", "best").agg(F.max("f.own").alias("own"), F.max(F.equal_null("f.held", "best")).alias("has"))
    out = owners.where(F.col("best").isNotNull() & ~F.col("has") & (F.col("top") - F.col("own") >= 2))
    return out.groupBy(key, "figure").agg(F.min(F.struct("sentence_no", "best")).alias("m")).select(key, "m.sentence_no", "figure", "m.best")


def summary_only(drafts: DataFrame, chunks: DataFrame, key: str, text: str, owner: str, chunk_text: str) -> DataFrame:
    """(key, figure): distinct figures of a draft that only summary sections of its owner's chunks hold."""
    first = F.lower(F.substring_index(F.col(chunk_text), "\n", 1))
    is_summary = first.rlike(r"^(?:" + "|".join(x.replace(" ", r"\s+") for x in SUMMARIES) + r")\b")
    of = chunks.select(owner, is_summary.alias("summary"), F.explode(F.array_distinct(numbers_in(F.col(chunk_text)))).alias("figure"))
    only = of.groupBy(owner, "figure").agg(F.min("summary").alias("only")).where("only").select(owner, "figure", F.lit(True).alias("only"))
    each = drafts.select(key, owner, F.explode(F.array_distinct(numbers_in(F.col(text)))).alias("figure"))
    return salted_join(each, only, [owner, "figure"], F.col(key), "inner").select(key, "figure").distinct()


_FIGURE = re.compile(r"\d[\d,]*(?:\.\d+)?")
_HEDGED = re.compile(r"\b(?:(?:" + "|".join(HEDGES).replace(" ", r"\s") + r")\s+)?(\d[\d,]*(?:\.\d+)?)", re.I)


def _measures(text: str, figure: float) -> set[str]:
    """The words and numbers that follow a figure at any of its places: what it counts."""
    out: set[str] = set()
    for m in _FIGURE.finditer(text):
        if float(m[0].replace(",", "")) == figure:
            near = (w.strip(".") for w in re.split(r"[^a-z0-9.]+", text[m.end() : m.end() + 60].lower()))
            out.update(w for w in [w for w in near if w][:4] if w not in COMMON)
    return out


def _shown(value: float, commas: bool) -> str:
    """A number without needless zeros, with thousands commas where the rounded one had them."""
    whole = value == int(value)
    if commas:
        return f"{int(value):,}" if whole else f"{value:,.3f}".rstrip("0").rstrip(".")
    return str(int(value)) if whole else repr(value)


def _rounds(drafted: str, exact: str) -> bool:
    """Whether the first number is the second one rounded: near, of the same size and first digit, and rounder."""
    a, b = float(drafted), float(exact)
    (whole_a, _, part_a), (whole_b, _, part_b) = drafted.partition("."), exact.partition(".")
    if a == b or abs(a - b) / b > 0.1 or len(whole_a) != len(whole_b) or whole_a[0] != whole_b[0]:
        return False
    zeros = lambda n: len(n) - len(n.rstrip("0"))
    return zeros(whole_a) > zeros(whole_b) or len(part_a) < len(part_b)


def repair(draft: str, evidence: str) -> str:
    """Put back the exact figure where a rounded one stands for exactly one figure of the evidence.

    That figure is within a tenth, has as many whole digits and the same first digit, and the rounded one has more zeros at its
    whole part's end or fewer decimals. Two such figures leave the draft as it is, and so does one that
    counts something else: among the next four words of both one must be the same. Years and exact figures
    stay; a word of hedging before the figure goes.
    """
    known = {m[0].replace(",", "") for m in _FIGURE.finditer(evidence)}
    sources = sorted({float(k) for k in known if float(k) > 0})

    def exact(m: re.Match) -> str:
        raw = m[1].replace(",", "")
        if raw in known or re.fullmatch(r"(?:19|20)\d\d", raw) or float(raw) <= 0:
            return m[0]
        fits = [v for v in sources if _rounds(raw, _shown(v, False))]
        if len(fits) != 1 or not _measures(draft, float(raw)) & _measures(evidence, fits[0]):
            return m[0]
        return _shown(fits[0], "," in m[1])

    return _HEDGED.sub(exact, draft)


def repair_figures(draft: Column, evidence: Column) -> Column:
    """repair() by Arrow batches; null drafts stay null, null evidence changes nothing."""

    def run(d: pd.Series, e: pd.Series) -> pd.Series:
        return pd.Series([x if x is None or y is None else repair(x, y) for x, y in zip(d, e)], dtype=object)

    return F.pandas_udf(run, T.StringType())(draft, evidence)
