"""Mixing sources to target weights by entropy balancing.

Plan: documents are counted in tokens of a public tokenizer. With T the size of the mix, each source s must
contribute target_share_s * T tokens. Rates r are sought that differ least, in entropy, from using every
document once:

    minimise  sum r log r - r   with   sum over s of r * tokens = target_share_s * T,   0 <= r <= max_repeats_s

The dual is convex with one unknown for each source, and its solution tilts the rates exponentially:
r = min(max_repeats, exp(lambda_s * tokens / mean tokens)). Each Newton step is one aggregation over the
documents; only a handful of sums for each source reach the driver. Rates become whole copies by a threshold for
each source on a fixed random number of each document, found from a histogram, so no source is sorted or
gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wrenlake.session import cut

TOKENIZERS = "/opt/tokenizers"
BINS = 4096


def source_name(c: Column) -> Column:
    """Lower case, ends trimmed, hyphens and blanks as underscores."""
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), r"[-\s]+", "_")


def token_counts(documents: DataFrame, tokenizer_dir: str = TOKENIZERS, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """(doc_id, source, tokens): null texts count as empty ones, with no tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import base64

        import tiktoken

        with open(f"{tokenizer_dir}/{vocabulary}") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        # Fixed value: the public pattern by which this vocabulary parts a text
        pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        codec = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            counts = [len(codec.encode_ordinary(t)) if t else 0 for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "tokens": counts})

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), source_name(F.col("source")).alias("source"), "text")
    return docs.mapInPandas(run, "doc_id long, source string, tokens long")


def _sums(docs: DataFrame) -> dict[str, dict]:
    """Sums by source; the number of sources is that of the targets."""
    rows = docs.groupBy("source").agg(
        F.sum("rate_tokens").alias("got"), F.sum(F.when(F.col("rate") < F.col("max_repeats"), F.col("rate_tokens") * F.col("x")).otherwise(0.0)).alias("slope")
    )
    return {r["source"]: r.asDict() for r in rows.collect()}


def mix(documents: DataFrame, targets: DataFrame, total: float | None = None, steps: int = 60, tolerance: float = 1e-6, **tokenizer) -> tuple[DataFrame, DataFrame]:
    """(selection, shares): (doc_id, source, tokens, copies) of the documents used, and the shares reached.

    targets: (source, target_share, max_repeats), one row a source, held on the driver (a few rows by
    nature; more than 10,000 raise). total: the size of the mix in tokens; by default the largest at which every
    source that has documents can give its share. Sources of the targets without documents are reported with
    nothing used and their share goes to the others in proportion; documents of other sources, of null
    sources and without tokens are left out. Repeated documents are separate ones. A total beyond what the repeats
    allow raises, as does an iteration that doesn't come within ``tolerance`` in ``steps``.
    """
    wanted = {r["source"]: (float(r["target_share"]), int(r["max_repeats"])) for r in targets.select("source", "target_share", "max_repeats").limit(10_001).collect()}
    if len(wanted) > 10_000:
        raise ValueError("too many sources")
    spark = documents.sparkSession
    known = spark.createDataFrame([(s, v[0], v[1]) for s, v in wanted.items()], "source string, target_share double, max_repeats int")
    docs = token_counts(documents, **tokenizer).where("tokens > 0").join(F.broadcast(known.select("source", "max_repeats")), "source")
    docs = cut(docs, "mix-tokens")
    have = {r["source"]: (int(r["n"]), float(r["size"])) for r in docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("size")).collect()}
    live = {s: wanted[s] for s in have if wanted[s][0] > 0 and wanted[s][1] > 0}
    if not live:
        empty = docs.limit(0).select("doc_id", "source", "tokens", F.lit(0).alias("copies"))
        return empty, _report(known, empty, have, {}, spark)
    scale = sum(v[0] for v in live.values())
    most = min(have[s][1] * v[1] / (v[0] / scale) for s, v in live.items())
    if total is not None and total > most * (1 + 1e-9):
        raise ValueError(f"at these shares and repeats the mix has {most:.0f} tokens at most, not {total:.0f}")
    size = most if total is None else float(total)
    need = {s: v[0] / scale * size for s, v in live.items()}
    mean = {s: have[s][1] / have[s][0] for s in live}
    lam = dict.fromkeys(live, 0.0)
    # a source of which every copy is needed has no finite solution: it is used whole
    whole = {s for s, v in live.items() if need[s] >= have[s][1] * v[1] * (1 - 1e-9)}
    low, high = dict.fromkeys(live, -60.0), dict.fromkeys(live, 60.0)
    for _ in range(steps):
        sums = _sums(_rated(docs, lam, mean, whole, spark))
        open_ = 0
        for s in live:
            gap = sums[s]["got"] - need[s]
            if s in whole or abs(gap) <= tolerance * need[s]:
                continue
            open_ += 1
            low[s], high[s] = (lam[s], high[s]) if gap < 0 else (low[s], lam[s])
            step = lam[s] - gap / sums[s]["slope"] if sums[s]["slope"] > 0 else None
            # Newton inside the bracket, halving outside it
            lam[s] = step if step is not None and low[s] < step < high[s] else (low[s] + high[s]) / 2
        if not open_:
            break
    else:
        raise RuntimeError(f"the rates didn't settle in {steps} steps")
    rated = cut(_rated(docs, lam, mean, whole, spark), "mix-rates")
    copies = _round(rated, need, spark)
    selection = copies.where("copies > 0").select("doc_id", "source", "tokens", "copies")
    return selection, _report(known, selection, have, {s: need[s] / size for s in live}, spark)


def _rated(docs: DataFrame, lam: dict, mean: dict, whole: set, spark) -> DataFrame:
    tilt = spark.createDataFrame([(s, lam[s], mean[s], s in whole) for s in lam], "source string, lam double, mean double, whole boolean")
    out = docs.join(F.broadcast(tilt), "source").withColumn("x", F.col("tokens") / F.col("mean"))
    out = out.withColumn("rate", F.when(F.col("whole"), F.col("max_repeats").cast("double")).otherwise(F.least(F.col("max_repeats").cast("double"), F.exp(F.least(F.lit(700.0), F.col("lam") * F.col("x"))))))
    return out.withColumn("rate_tokens", F.col("rate") * F.col("tokens")).drop("lam", "mean", "whole")


def _round(rated: DataFrame, need: dict, spark) -> DataFrame:
    """Whole copies: the floor, and one more where the fraction exceeds the document's random number.

    u = number - fraction in [-1, 1) orders a source's documents; one more copy goes to those under a bar
    that lets through the tokens still missing. The bar comes from a histogram of u by source.
    """
    number = F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    parts = rated.withColumn("base", F.floor("rate").cast("int")).withColumn("part", F.col("rate") - F.floor("rate"))
    parts = parts.withColumn("bin", F.floor((number - F.col("part") + 1) / 2 * BINS).cast("int"))
    # a document at its cap takes no more
    parts = parts.withColumn("room", F.col("base") < F.col("max_repeats"))
    counted = parts.groupBy("source", "bin").agg(F.sum(F.when(F.col("room"), F.col("tokens")).otherwise(0)).alias("more"), F.sum(F.col("base") * F.col("tokens")).alias("sure"))
    bars = []
    by: dict[str, list] = {}
    for r in counted.collect():  # sources times bins at most
        by.setdefault(r["source"], []).append((r["bin"], r["more"], r["sure"]))
    for s, bins in by.items():
        missing = need[s] - sum(b[2] for b in bins)
        bar, got = 0, 0.0
        for b, more, _ in sorted(bins):
            if abs(got + more - missing) > abs(got - missing) and got + more > missing:
                break
            got, bar = got + more, b + 1
        bars.append((s, bar))
    table = spark.createDataFrame(bars, "source string, bar int")
    out = parts.join(F.broadcast(table), "source")
    return out.withColumn("copies", F.col("base") + (F.col("room") & (F.col("bin") < F.col("bar"))).cast("int"))


def _report(known: DataFrame, selection: DataFrame, have: dict, aim: dict, spark) -> DataFrame:
    """One row a source of the targets."""
    facts = spark.createDataFrame([(s, n, int(t), aim.get(s)) for s, (n, t) in have.items()], "source string, documents long, tokens long, aimed_share double")
    used = selection.groupBy("source").agg(F.count(F.lit(1)).alias("documents_used"), F.sum("copies").alias("copies"), F.sum(F.col("copies") * F.col("tokens")).alias("tokens_used"))
    out = known.join(facts, "source", "left").join(used, "source", "left")
    out = out.withColumn("tokens_all", F.sum("tokens_used").over(W.partitionBy()))  # a row for each source of the targets
    return out.na.fill(0, ["documents", "tokens", "documents_used", "copies", "tokens_used"]).select(
        "source", "target_share", "aimed_share", "max_repeats", "documents", "tokens", "documents_used", "copies", "tokens_used",
        F.coalesce(F.col("tokens_used") / F.col("tokens_all"), F.lit(0.0)).alias("actual_share"),
    )
