"""Queries over texts: figures, words, lines, n-grams and checks against evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from wrenlake.functions.text import lines_of, ngrams, numbers_in, sentences, utrim
from wrenlake.operators import chunk, quality, relational
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


_NUMS = r"list_transform(regexp_extract_all({c}, '[0-9][0-9,]*(?:\.[0-9]+)?'), lambda n: replace(n, ',', ''))"
_COMMON = "[" + ", ".join(f"'{w}'" for w in quality.COMMON) + "]"
_CONTENT = r"list_filter(list_transform(regexp_split_to_array(lower({c}), '[^a-z0-9+#.]+'), lambda w: regexp_replace(w, '^\.+|\.+$', '', 'g')), lambda w: length(w) > 2 AND NOT list_contains(" + _COMMON + r", w))"
_CW = r"list_filter(list_transform(regexp_split_to_array(lower({c}), '[^a-z0-9+#.]+'), lambda w: regexp_replace(w, '^\.+|\.+$', '', 'g')), lambda w: length(w) > 2 AND NOT list_contains(" + _COMMON + r", w) AND NOT regexp_matches(w, '^[0-9.]+$'))"
_TRI = "list_distinct(list_transform(generate_series(1, len({w}) - 2), lambda i: {w}[i] || ' ' || {w}[i + 1] || ' ' || {w}[i + 2]))"


@query(f"SELECT doc_id, len(ns) AS n, array_to_string(ns, '|') AS figures FROM (SELECT doc_id, {_NUMS.format(c='text')} AS ns FROM documents)")
def figures(spark, d):
    out = read_table(spark, d, "documents").select("doc_id", numbers_in(F.col("text")).alias("ns"))
    return out.select("doc_id", F.size("ns").cast("long").alias("n"), F.array_join("ns", "|").alias("figures"))


@query(f"""WITH m AS (SELECT DISTINCT m.id, coalesce(nullif(m.sent_text, ''), m.draft_text) AS body, r.extracted_text AS cv FROM messages m JOIN resumes r ON m.job_id = r.job_id),
n AS (SELECT id, {_NUMS.format(c='body')} AS dn, {_NUMS.format(c='cv')} AS en FROM m), u AS (SELECT id, len(dn) AS figures, len(list_filter(dn, lambda x: NOT list_contains(en, x))) AS bad FROM n)
SELECT id, figures, bad AS ungrounded, round(CASE WHEN figures = 0 THEN 1.0 ELSE 1 - bad / figures END, 6) AS faithful FROM u""")
def ungrounded_figures(spark, d):
    r = read_table(spark, d, "resumes").select("job_id", F.col("extracted_text").alias("cv"))
    body = F.coalesce(F.when(F.col("sent_text") != "", F.col("sent_text")), "draft_text")
    m = read_table(spark, d, "messages").select("id", "job_id", body.alias("body")).distinct().join(r, "job_id")
    return m.select(
        "id", F.size(numbers_in(F.col("body"))).cast("long").alias("figures"), F.size(quality.ungrounded(F.col("body"), F.col("cv"))).cast("long").alias("ungrounded"), F.round(quality.faithfulness(F.col("body"), F.col("cv")), 6).alias("faithful")
    )


@query(f"""WITH m AS (SELECT DISTINCT m.id, m.draft_text AS body, j.jd_text AS jd, r.extracted_text AS cv FROM messages m JOIN jobs j ON m.job_id = j.id JOIN resumes r ON r.job_id = j.id WHERE m.draft_text IS NOT NULL),
w AS (SELECT id, {_CW.format(c='body')} AS a, {_CW.format(c="coalesce(jd, '')")} AS b, {_CW.format(c='cv')} AS c FROM m),
g AS (SELECT id, {_TRI.format(w='a')} AS ga, {_TRI.format(w='b')} AS gb, {_TRI.format(w='c')} AS gc FROM w),
e AS (SELECT id, list_filter(list_intersect(ga, gb), lambda x: NOT list_contains(gc, x)) AS es FROM g)
SELECT id, len(es) AS echoes, array_to_string(list_sort(es), '|') AS grams FROM e WHERE len(es) > 0""")
def advert_echoes(spark, d):
    j = read_table(spark, d, "jobs").select(F.col("id").alias("job_id"), F.col("jd_text").alias("jd"))
    r = read_table(spark, d, "resumes").select("job_id", F.col("extracted_text").alias("cv"))
    m = read_table(spark, d, "messages").where("draft_text is not null").select("id", "job_id", "draft_text").distinct()
    out = m.join(j, "job_id").join(r, "job_id").select("id", quality.echoed(F.col("draft_text"), F.col("jd"), F.col("cv")).alias("es"))
    return out.where(F.size("es") > 0).select("id", F.size("es").cast("long").alias("echoes"), F.array_join(F.sort_array("es"), "|").alias("grams"))


@query(f"""WITH m AS (SELECT DISTINCT id, contact_id, created_at, draft_text FROM messages WHERE draft_text IS NOT NULL), w AS (SELECT id, contact_id, created_at, {_CONTENT.format(c='draft_text')} AS ws FROM m),
g AS (SELECT id, contact_id, created_at, unnest({_TRI.format(w='ws')}) AS g FROM w), n AS (SELECT id, g, row_number() OVER (PARTITION BY contact_id, g ORDER BY created_at, id) AS k FROM g)
SELECT id, count(DISTINCT g) AS repeated FROM n WHERE k > 1 GROUP BY id""")
def repeated_phrases(spark, d):
    m = read_table(spark, d, "messages").where("draft_text is not null").select("id", "contact_id", "created_at", "draft_text").distinct()
    return quality.repeats(m, "contact_id", ["created_at"], "id", "draft_text")


_SENT = r"list_filter(string_split(regexp_replace({c}, '([.?!])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')"


@query(f"""WITH r AS (SELECT job_id, id AS resume_id FROM resumes), m AS (SELECT DISTINCT m.id AS message_id, r.resume_id, m.draft_text FROM messages m JOIN r USING (job_id)),
many AS (SELECT resume_id FROM resume_chunks GROUP BY resume_id HAVING count(*) > 1),
c AS (SELECT resume_id, id AS chunk, list_distinct({_CW.format(c='chunk_text')}) AS cw, list_distinct({_NUMS.format(c='chunk_text')}) AS cn FROM resume_chunks WHERE resume_id IN (SELECT resume_id FROM many)),
x AS (SELECT message_id, resume_id, unnest({_SENT.format(c='draft_text')}) AS s, generate_subscripts({_SENT.format(c='draft_text')}, 1) - 1 AS sentence_no FROM m),
s AS (SELECT message_id, resume_id, sentence_no, list_distinct({_CW.format(c='s')}) AS sw, list_distinct({_NUMS.format(c='s')}) AS sn FROM x),
p AS (SELECT message_id, sentence_no, sn, cn, chunk, len(list_intersect(sw, cw)) AS shared FROM s JOIN c USING (resume_id) WHERE len(sn) > 0 AND len(sw) >= 3),
b AS (SELECT message_id, sentence_no, chunk AS best, shared AS top FROM p QUALIFY row_number() OVER (PARTITION BY message_id, sentence_no ORDER BY shared DESC, chunk) = 1),
f AS (SELECT message_id, sentence_no, chunk, shared, unnest(list_intersect(sn, cn)) AS figure FROM p),
o AS (SELECT message_id, sentence_no, figure, max(shared) AS own, list(chunk) AS holders FROM f GROUP BY ALL),
q AS (SELECT message_id, sentence_no, figure, best FROM o JOIN b USING (message_id, sentence_no) WHERE NOT list_contains(holders, best) AND top >= 2 AND top - own >= 2)
SELECT message_id, sentence_no::INT AS sentence_no, figure, best FROM q QUALIFY row_number() OVER (PARTITION BY message_id, figure ORDER BY sentence_no, best) = 1""")
def misplaced_figures(spark, d):
    r = read_table(spark, d, "resumes").select("id", "job_id")
    # repeated messages stay: they change no row, and their texts needn't move to be compared
    m = read_table(spark, d, "messages").where("draft_text is not null").select(F.col("id").alias("message_id"), "job_id", "draft_text").join(r, "job_id").withColumnRenamed("id", "resume_id")
    c = read_table(spark, d, "resume_chunks").select("resume_id", F.col("id").alias("chunk_id"), "chunk_text")
    return quality.misattributed(m, c, "message_id", "draft_text", "resume_id", "chunk_id", "chunk_text")


@query()
def repaired_figures(spark, d):
    r = read_table(spark, d, "resumes").select("job_id", F.col("extracted_text").alias("cv"))
    m = read_table(spark, d, "messages").select("id", "job_id", "draft_text").distinct().join(r, "job_id")
    return m.select("id", "draft_text", quality.repair_figures(F.col("draft_text"), F.col("cv")).alias("repaired")).where("repaired <> draft_text").select("id", "repaired")


@query()
def resume_passages(spark, d):
    return chunk.chunk(read_table(spark, d, "resumes").withColumnRenamed("id", "resume_id"), "resume_id", "extracted_text")


_LINES = r"list_filter(list_transform(string_split_regex(text, '\r?\n'), lambda l: regexp_replace(l, '^[\s\x{00a0}\x{3000}\x{2000}-\x{200a}]+|[\s\x{00a0}\x{3000}\x{2000}-\x{200a}]+$', '', 'g')), lambda l: l <> '')"


@query(f"""WITH l AS (SELECT scrape_id, {_LINES.replace('text,', 'jd_text,')} AS ls FROM scraped_ats_jobs WHERE jd_text IS NOT NULL)
SELECT scrape_id, len(ls) AS lines, len(list_filter(ls, lambda x, i: i = 1 OR x <> ls[i - 1])) AS kept FROM l""")
def adjacent_lines(spark, d):
    a = read_table(spark, d, "scraped_ats_jobs").where("jd_text is not null").select("scrape_id", lines_of(F.col("jd_text")).alias("ls"))
    before = F.concat(F.array(F.lit(None).cast("string")), F.col("ls"))
    kept = F.filter(F.arrays_zip(F.col("ls"), before.alias("before")), lambda x: x["ls"].isNotNull() & ~F.equal_null(x["ls"], x["before"]))
    return a.select("scrape_id", F.size("ls").cast("long").alias("lines"), F.size(kept).cast("long").alias("kept"))


@query(f"""WITH l AS (SELECT scrape_id, unnest({_LINES.replace('text,', 'jd_text,')}) AS line, generate_subscripts({_LINES.replace('text,', 'jd_text,')}, 1) AS i FROM scraped_ats_jobs WHERE jd_text IS NOT NULL),
c AS (SELECT scrape_id, line, i, sum(length(line) + CASE WHEN i > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY scrape_id ORDER BY i) AS total FROM l)
SELECT scrape_id, count(*) AS lines, max(total)::BIGINT AS chars FROM c WHERE total <= 600 GROUP BY scrape_id""")
def capped_lines(spark, d):
    from pyspark.sql import Window as W

    a = read_table(spark, d, "scraped_ats_jobs").where("jd_text is not null").select("scrape_id", F.posexplode(lines_of(F.col("jd_text"))).alias("i", "line"))
    w = W.partitionBy("scrape_id").orderBy("i")
    total = F.sum(F.length("line") + (F.col("i") > 0).cast("int")).over(w)
    return a.withColumn("total", total).where("total <= 600").groupBy("scrape_id").agg(F.count(F.lit(1)).alias("lines"), F.max("total").alias("chars"))


@query(r"""SELECT id, CASE WHEN length(c) > 1 AND length(c) < 60 THEN c END AS company FROM (SELECT id, trim(regexp_extract(headline, '(?i)(?:\bat\b|@)\s*([^|·•\-–—,]+)', 1), ' ') AS c FROM contacts WHERE headline IS NOT NULL)""")
def headline_companies(spark, d):
    c = utrim(F.regexp_extract("headline", r"(?i)(?:\bat\b|@)\s*([^|·•\-–—,]+)", 1))
    return read_table(spark, d, "contacts").where("headline is not null").select("id", F.when((F.length(c) > 1) & (F.length(c) < 60), c).alias("company"))


@query(r"""SELECT scrape_id, lower(regexp_extract(page_url, '^\w+://([^/?#:]+)', 1)) AS host, regexp_extract(page_url, '^\w+://[^/?#]+([^?#]*)', 1) AS path FROM scraped_ats_jobs WHERE page_url IS NOT NULL""")
def page_addresses(spark, d):
    a = read_table(spark, d, "scraped_ats_jobs").where("page_url is not null")
    return a.select("scrape_id", F.lower(F.regexp_extract("page_url", r"^\w+://([^/?#:]+)", 1)).alias("host"), F.regexp_extract("page_url", r"^\w+://[^/?#]+([^?#]*)", 1).alias("path"))


@query(f"""WITH w AS (SELECT id, created_at, unnest({_CW.format(c='profile_text')}) AS w, generate_subscripts({_CW.format(c='profile_text')}, 1) AS i FROM contacts WHERE profile_text IS NOT NULL),
c AS (SELECT id, w, count(*) AS n, min(i) AS first FROM w GROUP BY id, w) SELECT id, w AS word, n FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, first) <= 30""")
def profile_words(spark, d):
    c = read_table(spark, d, "contacts").where("profile_text is not null").select("id", F.posexplode(quality.prose_words(F.col("profile_text"))).alias("i", "word"))
    n = c.groupBy("id", "word").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("first"))
    return relational.first_per_key(n, ["id"], [F.desc("n"), F.col("first")], 30).select("id", "word", "n")


@query(f"""WITH t AS (SELECT id, unnest({_CW.format(c='title')}) AS w, 5 AS weight FROM jobs WHERE title IS NOT NULL UNION ALL SELECT id, unnest({_CW.format(c='jd_text')}) AS w, 1 AS weight FROM jobs WHERE jd_text IS NOT NULL),
k AS (SELECT id, w, sum(weight + CASE WHEN regexp_matches(w, '[+#.]|[a-z][0-9]') THEN 3 ELSE 0 END)::BIGINT AS score, count(*) AS n, bool_or(weight = 5 OR regexp_matches(w, '[+#.]|[a-z][0-9]')) AS sure FROM t GROUP BY id, w)
SELECT id, w AS word, score FROM k WHERE sure OR n > 1 QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, w) <= 25""")
def role_keywords(spark, d):
    j = read_table(spark, d, "jobs")
    title = j.select("id", F.explode(quality.prose_words(F.col("title"))).alias("word"), F.lit(5).alias("weight"))
    body = j.select("id", F.explode(quality.prose_words(F.col("jd_text"))).alias("word"), F.lit(1).alias("weight"))
    shape = F.col("word").rlike(r"[+#.]|[a-z][0-9]")
    k = title.unionByName(body).groupBy("id", "word").agg(F.sum(F.col("weight") + F.when(shape, 3).otherwise(0)).alias("score"), F.count(F.lit(1)).alias("n"), F.bool_or((F.col("weight") == 5) | shape).alias("sure"))
    return relational.first_per_key(k.where("sure or n > 1"), ["id"], [F.desc("score"), F.col("word")], 25).select("id", "word", "score")


@query(f"""WITH w AS (SELECT unnest({_TRI.format(w='ws')}) AS gram FROM (SELECT {_CW.format(c='text')} AS ws FROM documents WHERE text IS NOT NULL)) SELECT gram, count(*) AS documents FROM w GROUP BY gram HAVING count(*) >= 5""")
def frequent_phrases(spark, d):
    g = read_table(spark, d, "documents").select(F.explode(F.array_distinct(ngrams(quality.prose_words(F.col("text")), 3))).alias("gram"))
    return g.groupBy("gram").agg(F.count(F.lit(1)).alias("documents")).where("documents >= 5")


@query(rf"""SELECT id, len(ss) AS claims FROM (SELECT id, list_filter({_SENT.format(c='draft_text')}, lambda x: regexp_matches(x, '(?i)\b(?:i|my|we|our)\b') AND NOT contains(x, '?')) AS ss FROM (SELECT DISTINCT id, draft_text FROM messages)) WHERE len(ss) > 0""")
def first_person_sentences(spark, d):
    m = read_table(spark, d, "messages").select("id", "draft_text").distinct()
    s = F.filter(sentences(F.col("draft_text")), lambda x: x.rlike(r"(?i)\b(?:i|my|we|our)\b") & ~x.contains("?"))
    return m.select("id", F.size(s).cast("long").alias("claims")).where("claims > 0")
