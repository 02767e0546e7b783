"""Dense and lexical legs of a search, their fusion by reciprocal ranks, and grading."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wrenlake.functions.stem import stems
from wrenlake.operators.skew import salted_join, spread_join

# Words that carry no meaning in a query.
STOP = tuple("a an and are as at be by for from has have in is it its of on or that the this to was we were will with you your".split())


def terms(c: Column) -> Column:
    """The simple analyser: lower-case words of letters and digits of any script, + and #, of two characters or more, stop words dropped."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{M}\p{N}+#]{2,}"), 0)
    return F.filter(words, lambda w: ~w.isin(*STOP))


def or_query(c: Column) -> Column:
    """Distinct query words in order: quotes and brackets stripped, a leading minus too, 'or' and 'and' dropped."""
    words = F.split(F.regexp_replace(c, r'["()]', " "), r"\s+")
    bare = F.transform(words, lambda w: F.lower(F.regexp_replace(w, r"^-+", "")))
    return F.array_distinct(F.filter(bare, lambda w: (w != "") & ~w.isin("or", "and")))


def dense_topk(queries: DataFrame, rows: DataFrame, k: int, qid: str, rid: str, vec: str, scope: str | None = None, block_bytes: int = 64_000_000) -> DataFrame:
    """(query, row, sim, rank): exact cosine top ``k`` of every query, ties by row id.

    Queries go to the tasks in blocks of at most ``block_bytes``, one pass each; every batch keeps its own
    best k for each query, so a few rows a batch are shuffled. Rows and queries without a vector, of another
    width or without a direction are left out. scope: only rows whose column equals the query's.
    """
    need = [qid, vec] + ([scope] if scope else [])
    q = queries.select(*need).where(F.col(vec).isNotNull())
    width = q.select(F.size(vec)).groupBy(f"size({vec})").count().orderBy(F.desc("count"), f"size({vec})").first()
    spark = rows.sparkSession
    id_type, q_type = dict(rows.dtypes)[rid], dict(queries.dtypes)[qid]
    schema = f"query {q_type}, row {id_type}, sim double"
    if width is None:
        return spark.createDataFrame([], schema + ", rank int")
    dim = width[0]
    q = q.where(F.size(vec) == dim)
    blocks = max(1, -(-q.count() * dim * 8 // block_bytes))
    r = rows.select(rid, vec, *([scope] if scope else [])).where(F.col(vec).isNotNull() & (F.size(vec) == dim))
    out = None
    for i in range(blocks):
        part = q.where(F.pmod(F.xxhash64(qid), F.lit(blocks)) == i).toArrow()
        ids = part.column(qid).to_pylist()
        x = _matrix(part.column(vec), dim)
        scopes = part.column(scope).to_pylist() if scope else None
        ok = np.isfinite(x).all(axis=1) & (np.abs(x).sum(axis=1) > 0)
        x, ids = x[ok], [v for v, g in zip(ids, ok) if g]
        scopes = np.array([v for v, g in zip(scopes, ok) if g], object) if scope else None
        x /= np.linalg.norm(x, axis=1)[:, None]

        def best(batches: Iterator[pa.RecordBatch], x=x, ids=ids, scopes=scopes) -> Iterator[pa.RecordBatch]:
            for b in batches:
                y = _matrix(b.column(vec), dim)
                good = np.isfinite(y).all(axis=1) & (np.abs(y).sum(axis=1) > 0)
                y = y[good] / np.linalg.norm(y[good], axis=1)[:, None]
                names = b.column(rid).filter(pa.array(good))
                if len(y) == 0 or len(x) == 0:
                    continue
                s = np.round(x @ y.T, 9)
                if scopes is not None:
                    of = np.array(b.column(scope).filter(pa.array(good)).to_pylist(), object)
                    s[scopes[:, None] != of[None, :]] = -9
                n = min(k, s.shape[1])
                bar = np.partition(-s, n - 1, axis=1)[:, n - 1 : n]
                qi, ri = np.nonzero((-s <= bar) & (s > -9))  # ties at the bar are settled later
                yield pa.RecordBatch.from_arrays([pa.array([ids[j] for j in qi], b_type), names.take(pa.array(ri)), pa.array(s[qi, ri])], ["query", "row", "sim"])

        b_type = part.schema.field(qid).type
        found = r.mapInArrow(best, schema)
        out = found if out is None else out.unionByName(found)
    w = W.partitionBy("query").orderBy(F.desc("sim"), "row")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _matrix(col, dim: int) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(-1, dim) if len(col) else np.zeros((0, dim))


def sparse_scores(queries: DataFrame, docs: DataFrame, qid: str, qtext: str, did: str, dtext: str, every: bool = False) -> DataFrame:
    """(query, doc, score): matching positions over 1 + ln(number of terms), for documents with a query word.

    every: all words of the query must occur. The words are one join on the term; occurrences are counted
    by document before it, so a frequent term moves one row a document, and its documents are spread over tasks.
    """
    q = queries.select(F.col(qid).alias("query"), F.explode(F.array_distinct(terms(F.col(qtext)))).alias("t"))
    d = docs.select(F.col(did).alias("doc"), terms(F.col(dtext)).alias("ts"))
    d = d.select("doc", F.size("ts").alias("n"), F.explode("ts").alias("t")).groupBy("doc", "n", "t").agg(F.count(F.lit(1)).alias("tf"))
    hits = spread_join(d, q, ["t"], F.col("doc"), hot=20_000).groupBy("query", "doc").agg((F.sum("tf") / (1 + F.ln(F.first("n")))).alias("score"), F.count(F.lit(1)).alias("words"))
    if every:
        hits = hits.join(q.groupBy("query").agg(F.count(F.lit(1)).alias("all")), "query").where("words = all").drop("all")
    return hits.drop("words")


def topk(scores: DataFrame, k: int) -> DataFrame:
    """(query, doc, score, rank) with ties by document."""
    w = W.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "doc")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def fuse(legs: DataFrame, k: int = 60, limit: int | None = None) -> DataFrame:
    """(query, doc, score, rank, legs): reciprocal rank fusion of (query, doc, leg, rank), legs numbered from 0.

    Ties of the score go to the earlier leg's better rank, then to the smaller document.
    """
    one = legs.groupBy("query", "doc").agg(
        F.round(F.sum(1.0 / (k + F.col("rank"))), 12).alias("score"), F.min(F.struct("leg", "rank")).alias("_first"), F.count(F.lit(1)).alias("legs")
    )
    w = W.partitionBy("query").orderBy(F.desc("score"), "_first", "doc")
    out = one.withColumn("rank", F.row_number().over(w)).drop("_first")
    return out.where(F.col("rank") <= limit) if limit else out


def apply_grades(ranked: DataFrame, grades: DataFrame, limit: int) -> DataFrame:
    """(query, doc, grade, rank): by grade, then fused rank; grade 0 and ungraded drop unless no row of the query has more."""
    g = ranked.join(grades, ["query", "doc"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    top = F.max("grade").over(W.partitionBy("query"))
    g = g.withColumn("_top", top).where((F.col("_top") == 0) | (F.col("grade") > 0))
    w = W.partitionBy("query").orderBy(F.desc("grade"), "rank")
    return g.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).select("query", "doc", "grade", F.col("place").alias("rank"))


def ranking_metrics(ranked: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """(query, precision, recall, rr, ndcg, hit): ranked (query, doc, rank), gold (query, doc).

    Precision divides by the rows retrieved within k, recall by the gold rows; reciprocal rank takes the
    whole list; nDCG is binary with the ideal over min(gold, k). Queries without results score 0.
    """
    g = gold.distinct()
    n = g.groupBy("query").agg(F.count(F.lit(1)).alias("gold"))
    r = ranked.join(g.withColumn("hit", F.lit(1)), ["query", "doc"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    return hit_metrics(r, n, k)


def hit_metrics(r: DataFrame, n: DataFrame, k: int) -> DataFrame:
    """ranking_metrics() of (query, rank, hit) and (query, gold), the number of relevant rows, where these need no list."""
    inside = F.col("rank") <= k
    per = r.groupBy("query").agg(
        F.sum(F.when(inside, F.col("hit")).otherwise(0)).alias("hits"),
        F.count_if(inside).alias("shown"),
        F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"),
        F.sum(F.when(inside, F.col("hit") / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("gold"), F.lit(k))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    out = n.join(per, "query", "left").na.fill(0, ["hits", "shown"]).na.fill(0.0, ["dcg"])
    return out.select(
        "query",
        F.when(F.col("shown") > 0, F.col("hits") / F.col("shown")).otherwise(0.0).alias("precision"),
        (F.col("hits") / F.col("gold")).alias("recall"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"),
        (F.col("dcg") / ideal).alias("ndcg"),
        (F.col("hits") > 0).cast("int").alias("hit"),
    )


def fuse_lenses(hits: DataFrame, limit: int, k: int = 1) -> DataFrame:
    """(query, doc, score, rank, dense_rank, sparse_rank): reciprocal rank fusion of whole searches, one vote a lens.

    hits: (query, lens, doc, rank, dense_rank, sparse_rank), lenses numbered from 0. The ranks of the legs are those of the first
    lens that found the row, null where its leg didn't. Ties of the score go to the smaller document.
    """
    one = hits.groupBy("query", "doc").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 12).alias("score"), F.min_by(F.struct("dense_rank", "sparse_rank"), "lens").alias("_of"))
    w = W.partitionBy("query").orderBy(F.desc("score"), "doc")
    out = one.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    return out.select("query", "doc", "score", "rank", "_of.dense_rank", "_of.sparse_rank")


def with_leg_ranks(legs: DataFrame, k: int = 60, limit: int | None = None) -> DataFrame:
    """fuse() with dense_rank (leg 0) and sparse_rank (leg 1), null where a leg didn't find the row."""
    of = lambda n: F.max(F.when(F.col("leg") == n, F.col("rank")))
    ranks = legs.groupBy("query", "doc").agg(of(0).alias("dense_rank"), of(1).alias("sparse_rank"))
    return fuse(legs, k, limit).join(ranks, ["query", "doc"])


def violations(ranked: DataFrame, forbidden: DataFrame, k: int) -> DataFrame:
    """(query, forbidden_shown): the queries whose first ``k`` rows hold a forbidden document, and how many."""
    bad = ranked.where(F.col("rank") <= k).join(forbidden.select("query", "doc").distinct(), ["query", "doc"], "left_semi")
    return bad.groupBy("query").agg(F.count(F.lit(1)).alias("forbidden_shown"))


def marked(cases: DataFrame, chunks: DataFrame, block: int = 500) -> DataFrame:
    """(case, marker, doc): documents that hold a marker, whatever its case. Markers without one have a row with a null document.

    cases: (case, marker), a stated set that meets all rows in blocks of ``block`` markers; chunks: (doc, text).
    """
    one = cases.where(F.col("marker").isNotNull()).select("case", "marker").distinct()
    blocks = one.groupBy(F.pmod(F.xxhash64("case", "marker"), F.lit(max(1, -(-one.count() // block)))).alias("b")).agg(F.collect_list(F.struct("case", "marker", F.lower("marker").alias("low"))).alias("ms"))
    pairs = chunks.where(F.col("text").isNotNull()).select("doc", F.lower("text").alias("low")).join(F.broadcast(blocks.select("ms")), how="inner")
    hits = pairs.select("doc", F.explode(F.filter("ms", lambda m: F.contains(F.col("low"), m["low"]))).alias("m")).select("m.case", "m.marker", "doc").distinct()
    return one.join(hits, ["case", "marker"], "left")


def parse_grades(answer: Column, candidates: Column, most: int = 2) -> Column:
    """Grades by position from a JSON answer: [(id, grade)], the last of repeated ids; null where it has no list of grades.

    Rows that are no objects, ids that are no whole numbers in range and grades that are no numbers drop; grades are rounded half up and held
    within 0 and ``most``.
    """
    rows = F.from_json(F.get_json_object(answer, "$.grades"), "array<string>")
    number = r"^-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?$"
    parsed = F.transform(rows, lambda r: F.struct(F.get_json_object(r, "$.id").alias("id"), F.get_json_object(r, "$.grade").alias("grade"), r.rlike(r'"(?:id|grade)"\s*:\s*"').alias("text")))
    good = F.filter(parsed, lambda x: ~x["text"] & x["id"].rlike(r"^\d+(?:\.0+)?$") & (x["id"].cast("double") < candidates) & x["grade"].rlike(number))
    cast = F.transform(good, lambda x: F.struct(x["id"].cast("double").cast("int").alias("id"), F.least(F.lit(most), F.greatest(F.lit(0), F.floor(x["grade"].cast("double") + 0.5).cast("int"))).alias("grade")))
    last = F.filter(cast, lambda x, i: ~F.exists(F.slice(cast, i + 2, F.greatest(F.size(cast) - i - 1, F.lit(0))), lambda y: y["id"] == x["id"]))
    return F.when(rows.isNotNull(), last)


def english_scores(queries: DataFrame, docs: DataFrame, qid: str, qtext: str, did: str, dtext: str, every: bool = False) -> DataFrame:
    """(query, doc, score) by stems. With ``every`` all stems of the query must occur, and the score is the density of their covers.

    A cover is a shortest stretch of the document that holds all stems; each counts 1 over 1 + the other words in it. Without
    ``every`` each matching position is a cover of its own. Scores are divided by 1 + ln(number of words). Words are
    stemmed once each, not once a place. Null and empty texts match nothing.
    """
    spread = lambda df, i, c, name: df.select(F.col(i).alias(name), terms(F.col(c)).alias("ts")).select(name, F.size("ts").alias("n"), F.posexplode("ts").alias("pos", "t"))
    q, d = spread(queries, qid, qtext, "query"), spread(docs, did, dtext, "doc")
    known = stems(q.select("t").distinct())
    q = q.join(known, "t").select("query", "stem").distinct()
    # only words that share a beginning with a query's stem can have one of its stems: the shortest, two letters, is the block
    vocabulary = d.select("t").distinct().join(q.select(F.substring("stem", 1, 2).alias("b")).distinct(), F.substring("t", 1, 2) == F.col("b"), "left_semi")
    d = salted_join(d, stems(vocabulary), ["t"], F.col("doc"), "inner").groupBy("doc", "n", "stem").agg(F.collect_list("pos").alias("ps"))
    hits = spread_join(d, q, ["stem"], F.col("doc"), hot=20_000)
    norm = 1 + F.ln("n")
    if not every:
        return hits.groupBy("query", "doc").agg((F.sum(F.size("ps")) / F.first(norm)).alias("score"))
    found = hits.groupBy("query", "doc", "n").agg(F.collect_list(F.struct("stem", "ps")).alias("of")).join(q.groupBy("query").agg(F.count(F.lit(1)).alias("all")), "query").where(F.size("of") == F.col("all"))

    @F.pandas_udf("double")
    def density(lists: pd.Series) -> pd.Series:
        return pd.Series([_density([list(x) for x in row]) for row in lists])

    return found.select("query", "doc", (density(F.col("of.ps")) / norm).alias("score"))


def _density(lists: list[list[int]]) -> float:
    """The sum over minimal covers of 1 / (1 + words between); lists: the positions of each stem."""
    places = sorted((p, i) for i, ps in enumerate(lists) for p in ps)
    last: dict[int, int] = {}
    covers: list[tuple[int, int]] = []
    for p, i in places:
        last[i] = p
        if len(last) == len(lists):
            low = min(last.values())
            if not covers or low > covers[-1][0]:
                covers.append((low, p))
    return sum(1 / (1 + high - low + 1 - len(lists)) for low, high in covers)
