"""Queries over the record tables: scans, merges, links, aggregates, windows and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wrenlake.functions.text import utrim
from wrenlake.operators import match, relational
from wrenlake.session import read_table
from wrenlake.sources.model import validate
from wrenlake.streaming.state import first_of_each, tumbling_counts

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def us(c: str):
    return F.unix_micros(F.col(c))


# ---------------------------------------------------------------- scans and writes


@query("SELECT id, job_id, file_name, epoch_us(uploaded_at) AS uploaded_us FROM resumes")
def list_resumes(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "resumes").select("id", "job_id", "file_name", us("uploaded_at").alias("uploaded_us"))


@query("SELECT DISTINCT id, contact_id, type FROM messages WHERE sent_at IS NULL")
def pending_messages(spark, d):
    return read_table(spark, d, "messages").where("sent_at is null").select("id", "contact_id", "type").distinct()


@query("SELECT id, coalesce(epoch_us(last_checked_at), -1) AS checked_us FROM contacts WHERE status IN ('Pending','Accepted') ORDER BY last_checked_at ASC NULLS FIRST, id LIMIT 100")
def watchlist(spark, d):
    c = read_table(spark, d, "contacts").where(F.col("status").isin("Pending", "Accepted"))
    return c.orderBy(F.asc_nulls_first("last_checked_at"), "id").limit(100).select("id", F.coalesce(us("last_checked_at"), F.lit(-1)).alias("checked_us"))


_SLUG = r"/in/([^/?#]+)"


@query(r"""WITH s AS (SELECT *, regexp_extract(linkedin_url, '/in/([^/?#]+)', 1) AS slug FROM scraped_profiles WHERE linkedin_url IS NOT NULL),
inc AS (SELECT slug, headline, company FROM s WHERE slug <> '' QUALIFY row_number() OVER (PARTITION BY slug ORDER BY read_at DESC, scrape_id) = 1),
base AS (SELECT regexp_extract(linkedin_url, '/in/([^/?#]+)', 1) AS slug, headline, company, created_at, id FROM contacts),
b AS (SELECT slug, headline, company FROM base QUALIFY row_number() OVER (PARTITION BY slug ORDER BY created_at DESC, id) = 1)
SELECT slug, headline, company FROM inc UNION ALL SELECT slug, headline, company FROM b WHERE slug NOT IN (SELECT slug FROM inc)""")
def upsert_profiles(spark, d):
    slug = F.regexp_extract("linkedin_url", _SLUG, 1).alias("slug")
    s = read_table(spark, d, "scraped_profiles").where("linkedin_url is not null").select(slug, "headline", "company", "read_at", "scrape_id").where("slug <> ''")
    inc = relational.first_per_key(s, ["slug"], [F.desc("read_at"), F.col("scrape_id")]).select("slug", "headline", "company")
    b = read_table(spark, d, "contacts").select(slug, "headline", "company", "created_at", "id")
    base = relational.first_per_key(b, ["slug"], [F.desc("created_at"), F.col("id")]).select("slug", "headline", "company")
    return relational.upsert(base, inc, ["slug"])


@query("""SELECT id FROM jobs WHERE external_job_id IS NULL UNION ALL
SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY lower(company), external_job_id ORDER BY created_at DESC, id) AS rn FROM jobs WHERE external_job_id IS NOT NULL) WHERE rn = 1""")
def newest_requisitions(spark, d):
    j = read_table(spark, d, "jobs").select("id", F.lower("company").alias("k"), "external_job_id", "created_at")
    keyed = relational.first_per_key(j.where("external_job_id is not null"), ["k", "external_job_id"], [F.desc("created_at"), F.col("id")])
    return j.where("external_job_id is null").select("id").unionByName(keyed.select("id"))


@query(r"""WITH s AS (SELECT regexp_extract(linkedin_url, '/in/([^/?#]+)', 1) AS slug, headline, company, profile_text, read_at, scrape_id FROM scraped_profiles WHERE linkedin_url IS NOT NULL),
p AS (SELECT slug, headline, company FROM s WHERE slug <> '' QUALIFY row_number() OVER (PARTITION BY slug ORDER BY read_at DESC, scrape_id) = 1),
t AS (SELECT slug, max(length(profile_text)) AS longest FROM s GROUP BY slug)
SELECT c.id, coalesce(c.headline, p.headline) AS headline, coalesce(c.company, p.company) AS company, greatest(coalesce(length(c.profile_text), 0), coalesce(t.longest, 0)) AS profile_chars
FROM contacts c LEFT JOIN p ON regexp_extract(c.linkedin_url, '/in/([^/?#]+)', 1) = p.slug LEFT JOIN t ON regexp_extract(c.linkedin_url, '/in/([^/?#]+)', 1) = t.slug""")
def enrich_contacts(spark, d):
    slug = F.regexp_extract("linkedin_url", _SLUG, 1).alias("slug")
    s = read_table(spark, d, "scraped_profiles").where("linkedin_url is not null").select(slug, "headline", "company", F.length("profile_text").alias("n"), "read_at", "scrape_id")
    latest = relational.first_per_key(s.where("slug <> ''").drop("n"), ["slug"], [F.desc("read_at"), F.col("scrape_id")])
    longest = s.groupBy("slug").agg(F.max("n").alias("longest"))
    c = read_table(spark, d, "contacts").select("id", slug, "headline", "company", F.length("profile_text").alias("own"))
    out = relational.patch(c, latest, "slug", ["headline", "company"]).join(longest, "slug", "left")
    return out.select("id", "headline", "company", F.greatest(F.coalesce("own", F.lit(0)), F.coalesce("longest", F.lit(0))).cast("long").alias("profile_chars"))


@query("SELECT min(id) AS id, resume_id, chunk_index FROM resume_chunks GROUP BY resume_id, chunk_index")
def dedupe_chunks(spark, d):
    c = read_table(spark, d, "resume_chunks").select("id", "resume_id", "chunk_index")
    return relational.first_per_key(c, ["resume_id", "chunk_index"], [F.col("id")])


@query("""WITH m AS (SELECT DISTINCT id, contact_id, type, sent_at, created_at FROM messages)
SELECT id FROM m WHERE sent_at IS NOT NULL UNION ALL
SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY contact_id, type ORDER BY created_at DESC, id DESC) AS rn FROM m WHERE sent_at IS NULL) WHERE rn = 1""")
def dedupe_drafts(spark, d):
    m = read_table(spark, d, "messages").select("id", "contact_id", "type", "sent_at", "created_at").distinct()
    drafts = relational.first_per_key(m.where("sent_at is null"), ["contact_id", "type"], [F.desc("created_at"), F.desc("id")])
    return m.where("sent_at is not null").select("id").unionByName(drafts.select("id"))


@query("SELECT c.id FROM resume_chunks c WHERE c.resume_id IN (SELECT id FROM resumes)")
def cascade_chunks(spark, d):
    r = read_table(spark, d, "resumes").select(F.col("id").alias("resume_id"))
    return read_table(spark, d, "resume_chunks").select("id", "resume_id").join(r, "resume_id", "left_semi").select("id")


@query("SELECT c.id, j.id AS job_id FROM contacts c LEFT JOIN jobs j ON c.job_id = j.id")
def unlink_missing_jobs(spark, d):
    return relational.unlink_missing(read_table(spark, d, "contacts").select("id", "job_id"), read_table(spark, d, "jobs").select("id"), "job_id")


@query("""SELECT reason, count(*) AS n FROM (SELECT unnest(list_filter([
CASE WHEN coalesce((embedding IS NULL) = (embedding_model IS NULL), false) THEN NULL ELSE 'paired' END,
CASE WHEN coalesce(length(trim(chunk_text)) > 0, false) THEN NULL ELSE 'text' END,
CASE WHEN embedding IS NULL OR len(embedding) = 64 THEN NULL ELSE 'width' END], lambda x: x IS NOT NULL)) AS reason FROM resume_chunks) GROUP BY reason""")
def rejected_chunks(spark, d):
    c = read_table(spark, d, "resume_chunks").select("chunk_text", "embedding", "embedding_model")
    rules = {"paired": F.col("embedding").isNull() == F.col("embedding_model").isNull(), "text": F.length(utrim(F.col("chunk_text"))) > 0, "width": F.col("embedding").isNull() | (F.size("embedding") == 64)}
    return validate(c, rules).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- joins


@query("SELECT c.id, coalesce(j.title, 'Unlinked') AS label FROM contacts c LEFT JOIN jobs j ON c.job_id = j.id")
def contact_labels(spark, d):
    j = read_table(spark, d, "jobs").select(F.col("id").alias("job_id"), "title")
    return read_table(spark, d, "contacts").select("id", "job_id").join(j, "job_id", "left").select("id", F.coalesce("title", F.lit("Unlinked")).alias("label"))


@query("""SELECT DISTINCT m.id, coalesce(m.sent_text, m.draft_text) AS body, epoch_us(m.created_at) AS created_us FROM messages m JOIN jobs j ON m.job_id = j.id
WHERE contains(lower(j.company), 'labs') ORDER BY created_us DESC, id LIMIT 10""")
def company_history(spark, d):
    j = read_table(spark, d, "jobs").where(F.contains(F.lower("company"), F.lit("labs"))).select(F.col("id").alias("job_id"))
    m = read_table(spark, d, "messages").select("id", "job_id", F.coalesce("sent_text", "draft_text").alias("body"), us("created_at").alias("created_us")).distinct()
    return m.join(j, "job_id").select("id", "body", "created_us").orderBy(F.desc("created_us"), "id").limit(10)


@query("""SELECT j.id AS job_id, count(c.id) AS contacts, coalesce(string_agg(c.name, '; ' ORDER BY c.name, c.id), '') AS names
FROM jobs j LEFT JOIN contacts c ON c.job_id = j.id GROUP BY j.id""")
def contacts_by_job(spark, d):
    c = read_table(spark, d, "contacts").select("job_id", "name", F.col("id").alias("cid"))
    lists = c.where("job_id is not null").groupBy("job_id").agg(F.count("cid").alias("contacts"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("name", "cid"))), lambda x: x["name"]), "; ").alias("names"))
    j = read_table(spark, d, "jobs").select(F.col("id").alias("job_id"))
    return j.join(lists, "job_id", "left").na.fill(0, ["contacts"]).na.fill("", ["names"])


@query("SELECT id FROM contacts WHERE id IN (SELECT contact_id FROM messages WHERE sent_at IS NULL)")
def contacts_with_draft(spark, d):
    m = read_table(spark, d, "messages").where("sent_at is null").select(F.col("contact_id").alias("id"))
    return read_table(spark, d, "contacts").select("id").join(m, "id", "left_semi")


@query("SELECT id FROM jobs WHERE id NOT IN (SELECT job_id FROM resumes WHERE job_id IS NOT NULL)")
def jobs_without_resume(spark, d):
    r = read_table(spark, d, "resumes").select(F.col("job_id").alias("id"))
    return read_table(spark, d, "jobs").select("id").join(r, "id", "left_anti")


_TRI = """list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''),
 lambda w: list_transform(generate_series(1, length('  ' || w || ' ') - 2), lambda i: substr('  ' || w || ' ', i, 3)))))"""


@query(f"""WITH l AS (SELECT DISTINCT company AS a FROM contacts WHERE company IS NOT NULL AND trim(company, ' ') <> ''), r AS (SELECT DISTINCT company AS b FROM jobs WHERE company IS NOT NULL AND trim(company, ' ') <> ''),
lt AS (SELECT a, {_TRI.format(c='a')} AS ta FROM l), rt AS (SELECT b, {_TRI.format(c='b')} AS tb FROM r),
p AS (SELECT a, b, CASE WHEN len(ta) + len(tb) = 0 THEN 0.0 ELSE len(list_intersect(ta, tb))::DOUBLE / len(list_distinct(list_concat(ta, tb))) END AS sim FROM lt, rt)
SELECT a, b, round(sim, 6) AS sim FROM p WHERE sim >= 0.4 OR contains(lower(a), lower(b)) OR contains(lower(b), lower(a))""")
def company_match_fuzzy(spark, d):
    l = read_table(spark, d, "contacts").select(F.col("company").alias("a"))
    r = read_table(spark, d, "jobs").select(F.col("company").alias("b"))
    return match.fuzzy_pairs(l, r).select("a", "b", F.round("sim", 6).alias("sim"))


_NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(lower({c}), '\b(?:inc|llc|ltd|limited|corp|corporation|gmbh|plc|co|sa|ag|bv|nv|pvt|pte)\b', '', 'g'), '[.,()|·•@]', ' ', 'g'), '[\s ]+', ' ', 'g'))"


@query(f"""WITH l AS (SELECT DISTINCT company AS a, {_NORM.format(c='company')} AS na FROM contacts WHERE company IS NOT NULL), r AS (SELECT DISTINCT company AS b, {_NORM.format(c='company')} AS nb FROM jobs WHERE company IS NOT NULL)
SELECT a, b FROM l, r WHERE length(na) >= 3 AND length(nb) >= 3 AND (contains(na, nb) OR contains(nb, na))""")
def company_match_strict(spark, d):
    return match.strict_pairs(read_table(spark, d, "contacts").select(F.col("company").alias("a")), read_table(spark, d, "jobs").select(F.col("company").alias("b")))


@query(f"""WITH l AS (SELECT id, company AS a, {_NORM.format(c='company')} AS na FROM contacts), r AS (SELECT id AS t, {_NORM.format(c='company')} AS nb FROM jobs WHERE company IS NOT NULL),
m AS (SELECT l.id, count(r.t) AS n, min(r.t) AS t FROM l LEFT JOIN r ON length(na) >= 3 AND length(nb) >= 3 AND (contains(na, nb) OR contains(nb, na)) GROUP BY l.id)
SELECT id, n AS matches, CASE WHEN n = 1 THEN t END AS target FROM m""")
def unique_company_links(spark, d):
    c = read_table(spark, d, "contacts").select("id", F.col("company").alias("a"))
    j = read_table(spark, d, "jobs").select(F.col("id").alias("target"), F.col("company").alias("b"))
    return match.unique_links(c, match.strict_pairs(c.select("a"), j.select("b")), j)


@query("""SELECT e.event_id, min(m.event_id) AS mark FROM events e JOIN events m ON e.user_id = m.user_id AND m.event_type = 'click' AND m.ts <= e.ts AND epoch_us(e.ts) - epoch_us(m.ts) <= 86400000000
WHERE e.event_type = 'purchase' GROUP BY e.event_id HAVING count(*) = 1""")
def only_click_in_a_day(spark, d):
    e = read_table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    p = e.where("event_type = 'purchase'").drop("event_type")
    return relational.only_within(p, e.where("event_type = 'click'"), "user_id", "ts", 86_400, "event_id").select("event_id", "mark")


@query("""SELECT e.event_id, coalesce(m.event_id, -1) AS mark_event_id FROM (SELECT * FROM events WHERE event_type = 'purchase') e
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') m ON e.user_id = m.user_id AND e.ts >= m.ts""")
def latest_click_before(spark, d):
    e = read_table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    out = relational.as_of(e.where("event_type = 'purchase'"), e.where("event_type = 'click'"), "user_id", "ts", ["event_id"])
    return out.select("event_id", F.coalesce("mark_event_id", F.lit(-1)).alias("mark_event_id"))


@query("""WITH RECURSIVE v AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE event_type = 'view'),
a AS (SELECT user_id, i, event_id, ts, ts AS last, true AS ok FROM v WHERE i = 1
UNION ALL SELECT v.user_id, v.i, v.event_id, v.ts, CASE WHEN v.ts >= a.last + INTERVAL 6 HOUR THEN v.ts ELSE a.last END, v.ts >= a.last + INTERVAL 6 HOUR FROM a JOIN v ON v.user_id = a.user_id AND v.i = a.i + 1)
SELECT event_id, user_id FROM a WHERE ok""")
def accepted_polls(spark, d):
    e = read_table(spark, d, "events").where("event_type = 'view'").select("event_id", "user_id", "ts")
    return relational.spaced(e, "user_id", "ts", 6 * 3600, "event_id").select("event_id", "user_id")


@query("""SELECT c.c_custkey, c.c_name, coalesce(o.o_orderkey, -1) AS o_orderkey FROM customer c LEFT JOIN (SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) o ON o.o_custkey = c.c_custkey""")
def latest_order_per_customer(spark, d):
    o = read_table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))
    return read_table(spark, d, "customer").select("c_custkey", "c_name").join(o, "c_custkey", "left").na.fill(-1, ["o_orderkey"])


@query("""SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE contains(lower(r_name), 'a') GROUP BY n_name""")
def orders_by_nation(spark, d):
    r = read_table(spark, d, "region").where(F.contains(F.lower("r_name"), F.lit("a"))).select(F.col("r_regionkey").alias("n_regionkey"))
    n = read_table(spark, d, "nation").join(r, "n_regionkey").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    c = read_table(spark, d, "customer").join(n, "c_nationkey").select(F.col("c_custkey").alias("o_custkey"), "n_name")
    o = read_table(spark, d, "orders").select("o_custkey", "o_totalprice")
    return o.join(c, "o_custkey").groupBy("n_name").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'sma') OR contains(lower(p_brand), 'sma') OR contains(lower(p_type), 'sma')")
def panel_search(spark, d):
    p = read_table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    hit = F.lit(False)
    for c in ("p_name", "p_brand", "p_type"):
        hit = hit | F.coalesce(F.contains(F.lower(c), F.lit("sma")), F.lit(False))
    return p.where(hit).select("p_partkey")


# ---------------------------------------------------------------- aggregates


@query("""SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS n, round(avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END), 6) AS purchases, round(avg(value), 6) AS mean_value, round(quantile_cont(value, 0.95), 6) AS p95
FROM events WHERE event_type <> 'error' GROUP BY 1""")
def telemetry_daily(spark, d):
    e = read_table(spark, d, "events").where("event_type <> 'error'")
    return e.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("event_type") == "purchase").cast("double")), 6).alias("purchases"), F.round(F.avg("value"), 6).alias("mean_value"), F.round(F.percentile("value", F.lit(0.95)), 6).alias("p95")
    )


@query("""SELECT type, count(*) AS checked, count(*) FILTER (review.repair_passes > 0) AS repaired, count(*) FILTER (review.repair_passes > 0 AND len(review.problems) > 0) AS in_vain, sum(len(review.ungrounded_figures))::BIGINT AS figures
FROM (SELECT DISTINCT id, type, review FROM messages) WHERE review IS NOT NULL GROUP BY type""")
def repair_waste(spark, d):
    m = read_table(spark, d, "messages").where("review is not null").select("id", "type", "review").dropDuplicates(["id"])
    passes = F.col("review.repair_passes") > 0
    return m.groupBy("type").agg(
        F.count(F.lit(1)).alias("checked"), F.count_if(passes).alias("repaired"), F.count_if(passes & (F.size("review.problems") > 0)).alias("in_vain"), F.sum(F.size("review.ungrounded_figures")).alias("figures")
    )


@query("""SELECT count(*) AS total, count(*) FILTER (status = 'Pending') AS waiting, count(*) FILTER (status IN ('Accepted','Follow_Up_Required','Replied')) AS connected, count(*) FILTER (status = 'Replied') AS replied, count(*) FILTER (job_id IS NULL) AS unlinked, count(*) FILTER (coalesce(profile_text, '') = '') AS unread FROM contacts""")
def status_buckets(spark, d):
    c = read_table(spark, d, "contacts")
    is_ = lambda *s: F.col("status").isin(*s)
    return c.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(is_("Pending")).alias("waiting"), F.count_if(is_("Accepted", "Follow_Up_Required", "Replied")).alias("connected"), F.count_if(is_("Replied")).alias("replied"),
        F.count_if(F.col("job_id").isNull()).alias("unlinked"), F.count_if(F.coalesce("profile_text", F.lit("")) == "").alias("unread"),
    )


@query("""SELECT user_id, count(*) AS calls, sum(coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0))::BIGINT AS tokens FROM events GROUP BY user_id""")
def usage_meter(spark, d):
    e = read_table(spark, d, "events")
    k = F.from_json("props", "k long")["k"]
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("calls"), F.sum(F.coalesce(k, F.lit(0))).alias("tokens"))


@query("""WITH c AS (SELECT job_id, company, count(*) AS n, min(created_at) AS first FROM contacts WHERE job_id IS NOT NULL AND company IS NOT NULL GROUP BY job_id, company)
SELECT job_id, company, n FROM c QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY n DESC, first, company) = 1""")
def usual_company_of_job(spark, d):
    c = read_table(spark, d, "contacts").where("job_id is not null and company is not null").groupBy("job_id", "company").agg(F.count(F.lit(1)).alias("n"), F.min("created_at").alias("first"))
    return relational.first_per_key(c, ["job_id"], [F.desc("n"), F.col("first"), F.col("company")]).select("job_id", "company", "n")


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT l_orderkey) AS orders, round(avg(l_discount), 6) AS discount FROM lineitem GROUP BY ALL""")
def line_summary(spark, d):
    l = read_table(spark, d, "lineitem")
    return l.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.countDistinct("l_orderkey").alias("orders"), F.round(F.avg("l_discount"), 6).alias("discount")
    )


# ---------------------------------------------------------------- windows


@query("""SELECT contact_id, id, epoch_us(sent_at) AS sent_us FROM (SELECT DISTINCT contact_id, id, sent_at FROM messages WHERE sent_at IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY contact_id ORDER BY sent_at DESC, id) = 1""")
def latest_sent(spark, d):
    m = read_table(spark, d, "messages").where("sent_at is not null").select("contact_id", "id", "sent_at")
    return relational.first_per_key(m, ["contact_id"], [F.desc("sent_at"), F.col("id")]).select("contact_id", "id", us("sent_at").alias("sent_us"))


@query("""SELECT contact_id, count(*) AS messages, string_agg(coalesce(nullif(sent_text, ''), draft_text), E'\\n---\\n' ORDER BY sent_at, id) AS thread FROM (SELECT DISTINCT id, contact_id, sent_text, draft_text, sent_at FROM messages) WHERE sent_at IS NOT NULL GROUP BY contact_id""")
def threads(spark, d):
    body = F.coalesce(F.when(F.col("sent_text") != "", F.col("sent_text")), "draft_text")
    m = read_table(spark, d, "messages").where("sent_at is not null").select("id", "contact_id", "sent_at", body.alias("body")).distinct()
    parts = F.sort_array(F.collect_list(F.struct("sent_at", "id", "body")))
    return m.groupBy("contact_id").agg(F.count(F.lit(1)).alias("messages"), F.array_join(F.transform(parts, lambda x: x["body"]), "\n---\n").alias("thread"))


@query("""SELECT id, row_number() OVER (PARTITION BY job_id ORDER BY CASE status WHEN 'Follow_Up_Required' THEN 0 WHEN 'Accepted' THEN 1 WHEN 'Replied' THEN 2 ELSE 3 END, created_at DESC, id) AS place FROM contacts WHERE job_id IS NOT NULL""")
def worklist_places(spark, d):
    order = F.when(F.col("status") == "Follow_Up_Required", 0).when(F.col("status") == "Accepted", 1).when(F.col("status") == "Replied", 2).otherwise(3)
    w = W.partitionBy("job_id").orderBy(order, F.desc("created_at"), "id")
    return read_table(spark, d, "contacts").where("job_id is not null").withColumn("place", F.row_number().over(w).cast("long")).select("id", "place")


@query("""SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def tumbling_days(spark, d):
    out = tumbling_counts(read_table(spark, d, "events"), "ts", "event_type", "value")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1""")
def first_event_of_kind(spark, d):
    return first_of_each(read_table(spark, d, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], "ts").select("user_id", "event_type", "event_id")


@query("""WITH m AS (SELECT linkedin_url, scrape_id, read_at, length(profile_text) AS n FROM scraped_profiles WHERE linkedin_url IS NOT NULL AND profile_text IS NOT NULL),
w AS (SELECT *, max(n) OVER (PARTITION BY linkedin_url ORDER BY read_at, scrape_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM m) SELECT scrape_id, n FROM w WHERE best IS NULL OR n > best""")
def growing_profiles(spark, d):
    m = read_table(spark, d, "scraped_profiles").where("linkedin_url is not null and profile_text is not null").select("linkedin_url", "scrape_id", "read_at", F.length("profile_text").cast("long").alias("n"))
    w = W.partitionBy("linkedin_url").orderBy("read_at", "scrape_id").rowsBetween(W.unboundedPreceding, -1)
    return m.withColumn("best", F.max("n").over(w)).where("best is null or n > best").select("scrape_id", "n")


@query("""SELECT id, floor((1767225600000000 - epoch_us(created_at)) / 86400000000)::BIGINT AS days FROM contacts""")
def days_since_created(spark, d):
    as_of = F.lit(1767225600000000)  # 2026-01-01 UTC
    return read_table(spark, d, "contacts").select("id", F.floor((as_of - us("created_at")) / F.lit(86400000000)).alias("days"))


# ---------------------------------------------------------------- sets


@query(r"""SELECT DISTINCT slug FROM (SELECT regexp_extract(linkedin_url, '/in/([^/?#]+)', 1) AS slug FROM scraped_profiles WHERE linkedin_url IS NOT NULL) WHERE slug <> '' EXCEPT SELECT regexp_extract(linkedin_url, '/in/([^/?#]+)', 1) FROM contacts""")
def unknown_profiles(spark, d):
    slug = F.regexp_extract("linkedin_url", _SLUG, 1).alias("slug")
    have = read_table(spark, d, "contacts").select(slug)
    return read_table(spark, d, "scraped_profiles").where("linkedin_url is not null").select(slug).where("slug <> ''").distinct().join(have, "slug", "left_anti")


@query("""SELECT lower(trim(company)) AS company FROM contacts WHERE company IS NOT NULL UNION SELECT lower(trim(company)) FROM jobs WHERE company IS NOT NULL""")
def employers_seen(spark, d):
    c = lambda t: read_table(spark, d, t).where("company is not null").select(F.lower(utrim(F.col("company"))).alias("company"))
    return c("contacts").union(c("jobs")).distinct()
