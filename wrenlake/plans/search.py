"""Queries of retrieval: dense and lexical legs, fusion, grading and ranking metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from wrenlake.functions.text import jaccard
from wrenlake.operators import retrieve
from wrenlake.session import read_table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_STOP = "[" + ", ".join(f"'{w}'" for w in retrieve.STOP) + "]"
_TERMS = "list_filter(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{M}}\\p{{N}}+#]{{2,}}'), lambda w: NOT list_contains(" + _STOP + ", w))"
_COS = "list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[])"
_DENSE = f"""dense AS (SELECT q.vec_id AS query, r.vec_id AS doc, round({_COS}, 9) AS sim, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_COS}, 9) DESC, r.vec_id) AS rank
FROM embeddings q, embeddings r WHERE q.vec_id % 100 = 0)"""
_SPARSE = f"""qt AS (SELECT item_id AS query, unnest(list_distinct({_TERMS.format(c='item_text')})) AS t FROM eval_items),
dt AS (SELECT doc_id AS doc, {_TERMS.format(c='text')} AS ts FROM documents WHERE text IS NOT NULL), tf AS (SELECT doc, n, t, count(*) AS tf FROM (SELECT doc, len(ts) AS n, unnest(ts) AS t FROM dt) GROUP BY doc, n, t),
hits AS (SELECT query, doc, sum(tf) / (1 + ln(any_value(n))) AS score, count(*) AS words FROM tf JOIN qt USING (t) GROUP BY query, doc)"""


def _dense(spark, d, k, scope=None):
    e = read_table(spark, d, "embeddings")
    return retrieve.dense_topk(e.where("vec_id % 100 = 0"), e, k, "vec_id", "vec_id", "embedding", scope)


def _sparse(spark, d, every=False):
    return retrieve.sparse_scores(read_table(spark, d, "eval_items"), read_table(spark, d, "documents"), "item_id", "item_text", "doc_id", "text", every)


@query(f"WITH {_DENSE} SELECT query, doc, rank, round(sim, 6) AS sim FROM dense WHERE rank <= 30")
def dense_topk(spark, d):
    return _dense(spark, d, 30).select("query", F.col("row").alias("doc"), F.col("rank").cast("long").alias("rank"), F.round("sim", 6).alias("sim"))


@query(f"""WITH dense AS (SELECT q.vec_id AS query, r.vec_id AS doc, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_COS}, 9) DESC, r.vec_id) AS rank FROM embeddings q, embeddings r WHERE q.vec_id % 100 = 0 AND q.label = r.label) SELECT query, doc, rank FROM dense WHERE rank <= 10""")
def dense_scoped(spark, d):
    return _dense(spark, d, 10, "label").select("query", F.col("row").alias("doc"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_SPARSE} SELECT query, doc, round(score, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS rank FROM hits QUALIFY rank <= 10")
def sparse_or_topk(spark, d):
    return retrieve.topk(_sparse(spark, d), 10).select("query", "doc", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_SPARSE}, a AS (SELECT query, count(*) AS n FROM qt GROUP BY query) SELECT query, doc, round(score, 6) AS score FROM hits JOIN a USING (query) WHERE words = n")
def sparse_and_match(spark, d):
    return _sparse(spark, d, True).select("query", "doc", F.round("score", 6).alias("score"))


_QV = """qv AS (SELECT vec_id AS query, vec_id % (SELECT count(*) FROM eval_items) + 1 AS item FROM embeddings WHERE vec_id % 100 = 0)"""
_LEGS = f"""{_DENSE}, {_QV}, {_SPARSE}, sp AS (SELECT qv.query, hits.doc, row_number() OVER (PARTITION BY qv.query ORDER BY round(score, 9) DESC, hits.doc) AS rank FROM hits JOIN qv ON hits.query = qv.item),
legs AS (SELECT query, doc, 0 AS leg, rank FROM dense WHERE rank <= 30 UNION ALL SELECT query, doc, 1, rank FROM sp WHERE rank <= 30),
fused AS (SELECT query, doc, round(sum(1.0 / (KCONST + rank)), 12) AS score, min(leg * 1000 + rank) AS first, count(*) AS legs, coalesce(max(CASE WHEN leg = 0 THEN rank END), 0) AS dense_rank, coalesce(max(CASE WHEN leg = 1 THEN rank END), 0) AS sparse_rank FROM legs GROUP BY query, doc)"""


def _legs(spark, d):
    """Both legs of the queries vec_id % 100 = 0, each with one test item as its words."""
    e = read_table(spark, d, "embeddings").where("vec_id % 100 = 0")
    items = read_table(spark, d, "eval_items").count()
    q = e.select(F.col("vec_id").alias("query"), (F.col("vec_id") % items + 1).alias("item_id")).join(read_table(spark, d, "eval_items").select("item_id", "item_text"), "item_id")
    sparse = retrieve.topk(retrieve.sparse_scores(q, read_table(spark, d, "documents"), "query", "item_text", "doc_id", "text"), 30).select("query", "doc", F.lit(1).alias("leg"), "rank")
    dense = _dense(spark, d, 30).select("query", F.col("row").alias("doc"), F.lit(0).alias("leg"), "rank")
    return dense.unionByName(sparse)


@query(f"""WITH {_LEGS.replace('KCONST', '60')} SELECT query, doc, round(score, 9) AS score, legs, dense_rank, sparse_rank, row_number() OVER (PARTITION BY query ORDER BY score DESC, first, doc) AS rank FROM fused QUALIFY rank <= 10""")
def hybrid_flagship(spark, d):
    legs = _legs(spark, d)
    of = lambda n: F.coalesce(F.max(F.when(F.col("leg") == n, F.col("rank"))), F.lit(0))
    ranks = legs.groupBy("query", "doc").agg(of(0).cast("long").alias("dense_rank"), of(1).cast("long").alias("sparse_rank"))
    out = retrieve.fuse(legs, 60, 10).join(ranks, ["query", "doc"])
    return out.select("query", "doc", F.round("score", 9).alias("score"), "legs", "dense_rank", "sparse_rank", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {_LEGS.replace('KCONST', '1')} SELECT query, doc, round(score, 9) AS score, row_number() OVER (PARTITION BY query ORDER BY score DESC, first, doc) AS rank FROM fused QUALIFY rank <= 8""")
def lens_fuse(spark, d):
    return retrieve.fuse(_legs(spark, d), 1, 8).select("query", "doc", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {_DENSE}, g AS (SELECT query, doc, rank, r.label % 3 AS grade FROM dense JOIN embeddings r ON doc = r.vec_id WHERE rank <= 8), t AS (SELECT *, max(grade) OVER (PARTITION BY query) AS top FROM g)
SELECT query, doc, grade, row_number() OVER (PARTITION BY query ORDER BY grade DESC, rank) AS rank FROM t WHERE top = 0 OR grade > 0 QUALIFY row_number() OVER (PARTITION BY query ORDER BY grade DESC, t.rank) <= 3""")
def graded_rerank(spark, d):
    ranked = _dense(spark, d, 8).select("query", F.col("row").alias("doc"), "rank")
    grades = ranked.join(read_table(spark, d, "embeddings").select(F.col("vec_id").alias("doc"), (F.col("label") % 3).alias("grade")), "doc").select("query", "doc", "grade")
    return retrieve.apply_grades(ranked, grades, 3).withColumn("rank", F.col("rank").cast("long"))


_METRICS = f"""{_DENSE}, r AS (SELECT query, doc, rank - 1 AS rank FROM dense WHERE rank BETWEEN 2 AND 21), gold AS (SELECT q.vec_id AS query, r.vec_id AS doc FROM embeddings q JOIN embeddings r ON q.label = r.label AND q.vec_id <> r.vec_id WHERE q.vec_id % 100 = 0),
n AS (SELECT query, count(*) AS gold FROM gold GROUP BY query), h AS (SELECT r.*, CASE WHEN gold.doc IS NULL THEN 0 ELSE 1 END AS hit FROM r LEFT JOIN gold USING (query, doc)),
p AS (SELECT query, sum(CASE WHEN rank <= 3 THEN hit ELSE 0 END) AS hits, count(*) FILTER (rank <= 3) AS shown, min(CASE WHEN hit = 1 THEN rank END) AS first, sum(CASE WHEN rank <= 3 THEN hit / log2(rank + 1) ELSE 0 END) AS dcg FROM h GROUP BY query),
m AS (SELECT query, hits / shown AS precision, hits / gold AS recall, coalesce(1.0 / first, 0) AS rr, dcg / list_sum(list_transform(generate_series(1, least(gold, 3)), lambda i: 1 / log2(i + 1))) AS ndcg, (hits > 0)::INT AS hit FROM n JOIN p USING (query))"""


def _metrics(spark, d):
    e = read_table(spark, d, "embeddings").select("vec_id", "label")
    ranked = _dense(spark, d, 21).where("rank > 1").select("query", F.col("row").alias("doc"), (F.col("rank") - 1).alias("rank"))
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), "label")
    # relevant is what has the query's label: counted by label, looked up by label, never listed
    gold = q.join(e.groupBy("label").agg((F.count(F.lit(1)) - 1).alias("gold")), "label").where("gold > 0").select("query", "gold")
    hits = ranked.join(q, "query").join(e.select(F.col("vec_id").alias("doc"), F.col("label").alias("found")), "doc")
    return retrieve.hit_metrics(hits.select("query", "rank", (F.col("label") == F.col("found")).cast("int").alias("hit")), gold, 3)


@query(f"WITH {_METRICS} SELECT query, round(precision, 6) AS precision, round(recall, 6) AS recall, round(rr, 6) AS rr, round(ndcg, 6) AS ndcg, hit FROM m")
def eval_ranking(spark, d):
    return _metrics(spark, d).select("query", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "rr", "ndcg")], "hit")


@query(f"""WITH {_METRICS}, a AS (SELECT avg(ndcg) AS ndcg, avg(rr) AS mrr, avg(hit) AS hit_rate FROM m), g AS (SELECT unnest(['hit_rate', 'mrr', 'ndcg']) AS metric, unnest([0.75, 0.55, 0.60]) AS floor, unnest([hit_rate, mrr, ndcg]) AS reached FROM a)
SELECT metric, floor::DOUBLE AS floor, round(reached, 6) AS reached, reached >= floor AS passed FROM g""")
def eval_gates(spark, d):
    means = _metrics(spark, d).agg(F.avg("hit").alias("hit_rate"), F.avg("rr").alias("mrr"), F.avg("ndcg").alias("ndcg"))
    floors = spark.createDataFrame([("hit_rate", 0.75), ("mrr", 0.55), ("ndcg", 0.60)], "metric string, floor double")
    long = means.unpivot([], ["hit_rate", "mrr", "ndcg"], "metric", "reached")
    return long.join(F.broadcast(floors), "metric").select("metric", "floor", F.round("reached", 6).alias("reached"), (F.col("reached") >= F.col("floor")).alias("passed"))


@query(f"""WITH {_DENSE}, s AS (SELECT query, list(doc) AS docs FROM dense WHERE rank <= 10 GROUP BY query), p AS (SELECT len(list_intersect(a.docs, b.docs)) / len(list_distinct(list_concat(a.docs, b.docs))) AS j FROM s a JOIN s b ON a.query < b.query)
SELECT count(*) AS pairs, round(avg(j), 6) AS overlap FROM p""")
def evidence_overlap(spark, d):
    s = _dense(spark, d, 10).groupBy("query").agg(F.collect_set("row").alias("docs"))
    pairs = s.alias("a").join(s.alias("b"), F.col("a.query") < F.col("b.query"))  # a stated set of queries
    return pairs.select(jaccard(F.col("a.docs"), F.col("b.docs")).alias("j")).agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg("j"), 6).alias("overlap"))


@query("""SELECT resume_id, count(DISTINCT embedding_model) AS models, coalesce(string_agg(DISTINCT embedding_model, ',' ORDER BY embedding_model), '') AS names, count(DISTINCT embedding_model) <= 1 AS searchable FROM resume_chunks GROUP BY resume_id""")
def embedding_guard(spark, d):
    c = read_table(spark, d, "resume_chunks").groupBy("resume_id").agg(F.sort_array(F.collect_set("embedding_model")).alias("ms"))
    return c.select("resume_id", F.size("ms").cast("long").alias("models"), F.array_join("ms", ",").alias("names"), (F.size("ms") <= 1).alias("searchable"))


@query(r"""SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split_regex(regexp_replace(item_text, '["()]', ' ', 'g'), '\s+'), lambda w: lower(regexp_replace(w, '^-+', ''))), lambda w: w NOT IN ('', 'or', 'and')))), '|') AS words FROM eval_items""")
def or_queries(spark, d):
    return read_table(spark, d, "eval_items").select("item_id", F.array_join(F.sort_array(retrieve.or_query(F.col("item_text"))), "|").alias("words"))
