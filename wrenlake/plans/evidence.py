"""Queries of searches through several lenses, their labels and legs, links of new records, and checks against summaries and threads."""

from __future__ import annotations

from pyspark.sql import functions as F

from wrenlake.functions.text import utrim
from wrenlake.operators import match, quality, relational, retrieve
from wrenlake.plans import records, search, texts
from wrenlake.plans.search import _COS, _SPARSE
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


@query("SELECT id, company, title, epoch_us(created_at) AS created_us FROM jobs ORDER BY created_at DESC, id")
def list_jobs(spark, d):
    return read_table(spark, d, "jobs").orderBy(F.desc("created_at"), "id").select("id", "company", "title", records.us("created_at").alias("created_us"))


@query("SELECT id, name, status, epoch_us(created_at) AS created_us FROM contacts ORDER BY created_at DESC, id")
def list_contacts(spark, d):
    return read_table(spark, d, "contacts").orderBy(F.desc("created_at"), "id").select("id", "name", "status", records.us("created_at").alias("created_us"))


# ---------------------------------------------------------------- lenses

DEPTH = 80  # legs go ten times as deep as a lens's eight


def _lens(spark, d, shift: int, scope: str | None):
    """One lens: both legs of the queries vec_id % 100 = 0, words from test item vec_id + shift, vectors in ``scope``."""
    q = read_table(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"))
    items = read_table(spark, d, "eval_items")
    n = items.agg(F.count(F.lit(1)).alias("n"))
    q = q.join(F.broadcast(n), how="inner").select("query", ((F.col("query") + shift) % F.col("n") + 1).alias("item_id")).join(items.select("item_id", "item_text"), "item_id")
    sparse = retrieve.topk(retrieve.sparse_scores(q, read_table(spark, d, "documents"), "query", "item_text", "doc_id", "text"), DEPTH).select("query", "doc", F.lit(1).alias("leg"), "rank")
    dense = search._dense(spark, d, DEPTH, scope).select("query", F.col("row").alias("doc"), F.lit(0).alias("leg"), "rank")
    return retrieve.with_leg_ranks(dense.unionByName(sparse), 60, 8)


def _lens_sql(name: str, shift: int, scope: str) -> str:
    return f"""{name}_d AS (SELECT q.vec_id AS query, r.vec_id AS doc, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_COS}, 9) DESC, r.vec_id) AS rank FROM embeddings q, embeddings r WHERE q.vec_id % 100 = 0 {scope}),
{name}_q AS (SELECT vec_id AS query, (vec_id + {shift}) % (SELECT count(*) FROM eval_items) + 1 AS item FROM embeddings WHERE vec_id % 100 = 0),
{name}_s AS (SELECT {name}_q.query, hits.doc, row_number() OVER (PARTITION BY {name}_q.query ORDER BY round(score, 9) DESC, hits.doc) AS rank FROM hits JOIN {name}_q ON hits.query = {name}_q.item),
{name}_l AS (SELECT query, doc, 0 AS leg, rank FROM {name}_d WHERE rank <= {DEPTH} UNION ALL SELECT query, doc, 1, rank FROM {name}_s WHERE rank <= {DEPTH}),
{name}_f AS (SELECT query, doc, round(sum(1.0 / (60 + rank)), 12) AS score, min(leg * 1000 + rank) AS first, max(CASE WHEN leg = 0 THEN rank END) AS dense_rank, max(CASE WHEN leg = 1 THEN rank END) AS sparse_rank FROM {name}_l GROUP BY query, doc),
{name} AS (SELECT query, doc, dense_rank, sparse_rank, row_number() OVER (PARTITION BY query ORDER BY score DESC, first, doc) AS rank FROM {name}_f QUALIFY rank <= 8)"""


_LENSES = f"""{_SPARSE}, {_lens_sql('one', 0, '')}, {_lens_sql('two', 1, 'AND q.label = r.label')}, lenses AS (SELECT 0 AS lens, * FROM one UNION ALL SELECT 1, * FROM two),
fused AS (SELECT query, doc, round(sum(1.0 / (1 + rank)), 12) AS score, arg_min({{'d': dense_rank, 's': sparse_rank}}, lens) AS legs FROM lenses GROUP BY query, doc),
top AS (SELECT query, doc, score, legs, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM fused QUALIFY rank <= 8)"""


def _lenses(spark, d):
    one = _lens(spark, d, 0, None).withColumn("lens", F.lit(0))
    return retrieve.fuse_lenses(one.unionByName(_lens(spark, d, 1, "label").withColumn("lens", F.lit(1))), 8)


@query(f"WITH {_LENSES} SELECT query, doc, round(score, 9) AS score, rank, coalesce(legs.d, 0) AS dense_rank, coalesce(legs.s, 0) AS sparse_rank FROM top")
def two_lens_search(spark, d):
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return _lenses(spark, d).select("query", "doc", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"), zero("dense_rank"), zero("sparse_rank"))


@query(f"""WITH {_LENSES}, g AS (SELECT query, doc, rank, coalesce(e.label % 3, 0) AS grade FROM top LEFT JOIN embeddings e ON doc = e.vec_id), t AS (SELECT *, max(grade) OVER (PARTITION BY query) AS most FROM g),
k AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY grade DESC, rank) AS rank FROM t WHERE most = 0 OR grade > 0 QUALIFY row_number() OVER (PARTITION BY query ORDER BY grade DESC, t.rank) <= 3)
SELECT q.vec_id AS query, count(k.doc) AS evidence, coalesce(string_agg(k.doc, ',' ORDER BY k.rank), '') AS docs FROM embeddings q LEFT JOIN k ON k.query = q.vec_id WHERE q.vec_id % 100 = 0 GROUP BY 1""")
def lens_evidence(spark, d):
    """The graded evidence of every query; a query without any has a row that says so."""
    top = _lenses(spark, d).select("query", "doc", "rank")
    e = read_table(spark, d, "embeddings")
    grades = top.join(e.select(F.col("vec_id").alias("doc"), (F.col("label") % 3).alias("grade")), "doc").select("query", "doc", "grade")
    kept = retrieve.apply_grades(top, grades, 3).groupBy("query").agg(F.count(F.lit(1)).alias("evidence"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "doc"))), lambda x: x["doc"].cast("string")), ",").alias("docs"))
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"))
    return q.join(kept, "query", "left").na.fill(0, ["evidence"]).na.fill("", ["docs"])


# ---------------------------------------------------------------- labels and legs

_FORBIDDEN = f"""d AS (SELECT q.vec_id AS query, r.label AS label, q.label AS own, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_COS}, 9) DESC, r.vec_id) AS rank FROM embeddings q, embeddings r WHERE q.vec_id % 100 = 0)"""


@query(f"WITH {_FORBIDDEN} SELECT query, count(*) AS forbidden_shown FROM d WHERE rank <= 10 AND label = (own + 1) % 10 GROUP BY query")
def forbidden_shown(spark, d):
    ranked = search._dense(spark, d, 10).select("query", F.col("row").alias("doc"), "rank")
    e = read_table(spark, d, "embeddings").select("vec_id", "label")
    # forbidden are rows of the next label; only those that were shown need be listed
    own = e.select(F.col("vec_id").alias("query"), ((F.col("label") + 1) % 10).alias("label"))
    bad = ranked.join(own, "query").join(e.withColumnRenamed("vec_id", "doc"), ["doc", "label"]).select("query", "doc")
    return retrieve.violations(ranked, bad, 10)


_GOLD = "gold AS (SELECT q.vec_id AS query, q.label, (SELECT count(*) FROM embeddings r WHERE r.label = q.label) - 1 AS gold FROM embeddings q WHERE q.vec_id % 100 = 0)"


@query(f"""WITH {_SPARSE}, {_lens_sql('one', 0, '')}, {_GOLD}, a AS (SELECT 'dense' AS leg, query, doc, rank FROM one_d WHERE rank <= 30 UNION ALL SELECT 'sparse', query, doc, rank FROM one_s WHERE rank <= 30 UNION ALL SELECT 'fused', query, doc, rank FROM one),
h AS (SELECT leg, a.query, rank, CASE WHEN e.label = gold.label AND a.doc <> a.query THEN 1 ELSE 0 END AS hit FROM a JOIN gold USING (query) LEFT JOIN embeddings e ON e.vec_id = a.doc),
p AS (SELECT leg, query, sum(CASE WHEN rank <= 3 THEN hit ELSE 0 END) AS hits, count(*) FILTER (rank <= 3) AS shown, min(CASE WHEN hit = 1 THEN rank END) AS first, sum(CASE WHEN rank <= 3 THEN hit / log2(rank + 1) ELSE 0 END) AS dcg FROM h GROUP BY leg, query),
g AS (SELECT l.leg, gold.query, gold.gold FROM gold, (SELECT unnest(['dense', 'sparse', 'fused']) AS leg) l WHERE gold.gold > 0)
SELECT leg, round(avg(coalesce(hits / shown, 0)), 6) AS precision, round(avg(coalesce(hits, 0) / gold), 6) AS recall, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr,
round(avg(coalesce(dcg, 0) / list_sum(list_transform(generate_series(1, least(gold, 3)), lambda i: 1 / log2(i + 1)))), 6) AS ndcg, round(avg(CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate FROM g LEFT JOIN p USING (leg, query) GROUP BY leg""")
def leg_comparison(spark, d):
    e = read_table(spark, d, "embeddings").select("vec_id", "label")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("label").alias("own"))
    gold = q.join(e.groupBy(F.col("label").alias("own")).agg((F.count(F.lit(1)) - 1).alias("gold")), "own").where("gold > 0")
    legs = search._legs(spark, d)
    fused = _lens(spark, d, 0, None).select("query", "doc", F.lit(2).alias("leg"), "rank")
    out = None
    for n, name in enumerate(("dense", "sparse", "fused")):
        ranked = (legs if n < 2 else fused).where(F.col("leg") == n).join(q, "query").join(e.withColumnRenamed("vec_id", "doc"), "doc", "left")
        hit = F.coalesce((F.col("label") == F.col("own")) & (F.col("doc") != F.col("query")), F.lit(False)).cast("int")
        m = retrieve.hit_metrics(ranked.select("query", "rank", hit.alias("hit")), gold.select("query", "gold"), 3)
        means = m.agg(*[F.round(F.avg(c), 6).alias(a) for c, a in (("precision", "precision"), ("recall", "recall"), ("rr", "mrr"), ("ndcg", "ndcg"), ("hit", "hit_rate"))]).select(F.lit(name).alias("leg"), "*")
        out = means if out is None else out.unionByName(means)
    return out


@query("""SELECT i.item_id AS "case", count(DISTINCT d.doc_id) AS documents FROM eval_items i LEFT JOIN documents d ON contains(lower(d.text), lower(substr(i.item_text, 1, 24))) GROUP BY 1""")
def marked_documents(spark, d):
    cases = read_table(spark, d, "eval_items").select(F.col("item_id").alias("case"), F.substring("item_text", 1, 24).alias("marker"))
    hits = retrieve.marked(cases, read_table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text"))
    return hits.groupBy("case").agg(F.countDistinct("doc").alias("documents"))


@query(f"""WITH {_FORBIDDEN} SELECT query, (rank - 1)::INT AS id, least(2, greatest(0, label - 4))::INT AS grade FROM d WHERE rank <= 8""")
def parsed_grades(spark, d):
    """Grades written as JSON and read again, out of range ones held within."""
    top = search._dense(spark, d, 8).join(read_table(spark, d, "embeddings").select(F.col("vec_id").alias("row"), "label"), "row")
    row = F.struct((F.col("rank") - 1).alias("id"), (F.col("label") - 4).alias("grade"))
    answers = top.groupBy("query").agg(F.to_json(F.struct(F.collect_list(row).alias("grades"))).alias("answer"))
    return answers.select("query", F.inline(retrieve.parse_grades(F.col("answer"), F.lit(8))))


@query()
def english_topk(spark, d):
    """Ten documents of every test item by stems; no SQL, as its stemmer isn't in the comparison engine."""
    scores = retrieve.english_scores(read_table(spark, d, "eval_items"), read_table(spark, d, "documents"), "item_id", "item_text", "doc_id", "text")
    return retrieve.topk(scores, 10).select("query", "doc", F.round("score", 6).alias("score"), "rank")


# ---------------------------------------------------------------- links and terms

_OF_HEADLINE = r"(SELECT CASE WHEN length(t) > 1 AND length(t) < 60 THEN t END FROM (SELECT trim(regexp_extract({h}, '(?i)(?:\bat\b|@)\s*([^|·•\-–—,]+)', 1), ' ') AS t))"


@query(f"""WITH l AS (SELECT id, coalesce(company, {_OF_HEADLINE.format(h='headline')}) AS a FROM contacts WHERE job_id IS NULL), n AS (SELECT id, {records._NORM.format(c='a')} AS na FROM l),
r AS (SELECT id AS t, {records._NORM.format(c='company')} AS nb FROM jobs WHERE company IS NOT NULL)
SELECT n.id, min(r.t) AS job_id FROM n JOIN r ON length(na) >= 3 AND length(nb) >= 3 AND (contains(na, nb) OR contains(nb, na)) GROUP BY n.id HAVING count(*) = 1""")
def reverse_links(spark, d):
    """Unlinked contacts whose employer, as written or from the headline, is that of exactly one job: linked when jobs arrive later."""
    c = utrim(F.regexp_extract("headline", r"(?i)(?:\bat\b|@)\s*([^|·•\-–—,]+)", 1))
    of_headline = F.when((F.length(c) > 1) & (F.length(c) < 60), c)
    rows = read_table(spark, d, "contacts").where("job_id is null").select("id", F.coalesce("company", of_headline).alias("a"))
    jobs = read_table(spark, d, "jobs").select(F.col("id").alias("target"), F.col("company").alias("b"))
    links = match.unique_links(rows, match.strict_pairs(rows.select("a"), jobs.select("b")), jobs)
    return links.where("target is not null").select("id", F.col("target").alias("job_id"))


# Words of headlines and of profiles that say nothing about what a person does.
HEADLINE_NOISE = tuple("the and for with our ex team global hiring helping building passionate senior junior lead head".split())
PROFILE_NOISE = tuple(
    "about experience skills years year work working works role roles company companies business people person from that this their they have has been was were into over more "
    "most across within also than then who how what where when you your his her its currently previously present full time part".split()
)
_LIST = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"


def _reader_words(text, company, noise):
    employer = F.split(F.lower(F.coalesce(company, F.lit(""))), r"[^a-z0-9]+")
    return F.filter(F.split(F.lower(text), r"[^a-z0-9+#]+"), lambda w: (F.length(w) > 2) & ~w.isin(*noise) & ~F.array_contains(employer, w))


_WORDS_SQL = "list_filter(regexp_split_to_array(lower({t}), '[^a-z0-9+#]+'), lambda w: length(w) > 2 AND NOT list_contains({n}, w) AND NOT list_contains(regexp_split_to_array(lower(coalesce(company, '')), '[^a-z0-9]+'), w))"


@query(f"SELECT id, array_to_string({_WORDS_SQL.format(t='headline', n=_LIST(HEADLINE_NOISE))}, '|') AS terms FROM contacts WHERE headline IS NOT NULL")
def headline_terms(spark, d):
    c = read_table(spark, d, "contacts").where("headline is not null")
    return c.select("id", F.array_join(_reader_words(F.col("headline"), F.col("company"), HEADLINE_NOISE), "|").alias("terms"))


@query(f"""WITH w AS (SELECT id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT id, {_WORDS_SQL.format(t='profile_text', n=_LIST(HEADLINE_NOISE + PROFILE_NOISE))} AS ws FROM contacts WHERE profile_text IS NOT NULL)),
c AS (SELECT id, w, count(*) AS n, min(i) AS first FROM w GROUP BY id, w) SELECT id, w AS term, n FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, first) <= 30""")
def profile_terms(spark, d):
    c = read_table(spark, d, "contacts").where("profile_text is not null")
    words = c.select("id", F.posexplode(_reader_words(F.col("profile_text"), F.col("company"), HEADLINE_NOISE + PROFILE_NOISE)).alias("i", "term"))
    n = words.groupBy("id", "term").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("first"))
    return relational.first_per_key(n, ["id"], [F.desc("n"), F.col("first")], 30).select("id", "term", "n")


# ---------------------------------------------------------------- threads and summaries

_CLAIM = r"array_to_string(list_filter(" + texts._SENT + r", lambda x: NOT contains(x, '?') AND NOT regexp_matches(x, '(?i)\byour?\b')), ' ')"
_CLAIM_WORDS = texts._CONTENT.format(c=_CLAIM.format(c="draft_text"))


@query(f"""WITH m AS (SELECT DISTINCT id, contact_id, created_at, draft_text FROM messages WHERE draft_text IS NOT NULL),
g AS (SELECT id, contact_id, created_at, unnest({texts._TRI.format(w='ws')}) AS g FROM (SELECT id, contact_id, created_at, {_CLAIM_WORDS} AS ws FROM m)),
c AS (SELECT id, count(DISTINCT g) AS claims FROM (SELECT id, g, row_number() OVER (PARTITION BY contact_id, g ORDER BY created_at, id) AS k FROM g) WHERE k > 1 GROUP BY id),
n AS (SELECT id, contact_id, created_at, figure, count(*) AS n FROM (SELECT id, contact_id, created_at, unnest({texts._NUMS.format(c='draft_text')}) AS figure FROM m) GROUP BY ALL),
f AS (SELECT id, sum(n)::BIGINT AS figures FROM (SELECT id, n, row_number() OVER (PARTITION BY contact_id, figure ORDER BY created_at, id) AS k FROM n) WHERE k > 1 GROUP BY id)
SELECT coalesce(c.id, f.id) AS id, coalesce(claims, 0) AS claims, coalesce(figures, 0) AS figures FROM c FULL JOIN f ON c.id = f.id""")
def thread_repeats(spark, d):
    """What a message repeats of earlier ones of its thread: phrases of its claims, and figures."""
    m = read_table(spark, d, "messages").where("draft_text is not null").select("id", "contact_id", "created_at", "draft_text").distinct()
    claims = quality.repeats(m.withColumn("claim", quality.claim_text(F.col("draft_text"))), "contact_id", ["created_at"], "id", "claim").withColumnRenamed("repeated", "claims")
    figures = quality.repeated_figures(m, "contact_id", ["created_at"], "id", "draft_text")
    return claims.join(figures, "id", "full").na.fill(0, ["claims", "figures"])


@query(f"""WITH m AS (SELECT DISTINCT m.id, r.id AS resume_id, m.draft_text FROM messages m JOIN resumes r USING (job_id) WHERE m.draft_text IS NOT NULL),
c AS (SELECT resume_id, regexp_matches(lower(split_part(chunk_text, chr(10), 1)), '^(?:{"|".join(x.replace(" ", chr(92) + "s+") for x in quality.SUMMARIES)}){chr(92)}b') AS s, unnest(list_distinct({texts._NUMS.format(c='chunk_text')})) AS figure FROM resume_chunks),
o AS (SELECT resume_id, figure FROM c GROUP BY ALL HAVING bool_and(s)), f AS (SELECT id, resume_id, unnest(list_distinct({texts._NUMS.format(c='draft_text')})) AS figure FROM m)
SELECT DISTINCT id, figure FROM f JOIN o USING (resume_id, figure)""")
def summary_only_figures(spark, d):
    r = read_table(spark, d, "resumes").select(F.col("id").alias("resume_id"), "job_id")
    m = read_table(spark, d, "messages").where("draft_text is not null").select("id", "job_id", "draft_text").distinct().join(r, "job_id")
    return quality.summary_only(m, read_table(spark, d, "resume_chunks"), "id", "draft_text", "resume_id", "chunk_text")
