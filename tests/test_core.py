from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wrenlake.functions.text import collapse, jaccard, ngrams, numbers_in, trigram_similarity, utrim
from wrenlake.operators import chunk, match, quality, relational, retrieve
from wrenlake.operators.components import connected_components
from wrenlake.operators.skew import salted_join
from wrenlake.session import guard
from wrenlake.sources.model import read_text_files, replace_partitions, schema_of, validate
from wrenlake.streaming import state


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(str(i)) for i, c in enumerate(cols)]).first()


def test_text(spark):
    nb = " \ta\n"
    r = one(spark, utrim(F.lit(nb)), collapse(F.lit(" a \n b ")), numbers_in(F.lit("1,200 of 3.5 and 3.5")), ngrams(F.array(F.lit("a"), F.lit("b")), 3))
    assert list(r) == ["a", "a b", ["1200", "3.5", "3.5"], []]
    r = one(spark, trigram_similarity(F.lit("word"), F.lit("words")), jaccard(F.array().cast("array<string>"), F.array().cast("array<string>")), utrim(F.lit(None)))
    assert r[0] == pytest.approx(4 / 7) and r[1] == 0.0 and r[2] is None


def test_components_against_a_walk(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(80), rnd.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(40)] + [(3, 3)]
    nodes = sorted({*range(80), *range(100, 141)})
    got = {r.id: r.component for r in connected_components(spark.createDataFrame([(n,) for n in nodes], "id long"), spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {n: n for n in nodes}
    for _ in nodes:
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    assert got == want
    empty = spark.createDataFrame([], "a long, b long")
    assert {r.id: r.component for r in connected_components(spark.createDataFrame([(1,), (2,)], "id long"), empty).collect()} == {1: 1, 2: 2}


def test_salted_join_keeps_a_hot_key(spark):
    many = spark.range(500).select(F.col("id"), F.when(F.col("id") < 450, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"))
    right = spark.createDataFrame([("hot", 1), ("460", 2)], "k string, v int")
    out = salted_join(many, right, ["k"], F.col("id"))
    assert out.count() == 500 and out.where("v = 1").count() == 450 and out.where("v = 2").count() == 1
    assert salted_join(many.limit(0), right, ["k"], F.col("id")).count() == 0


def test_upsert_patch_unlink(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, v int")
    new = spark.createDataFrame([("b", 9), ("c", 4)], "k string, v int")
    assert {(r.k, r.v) for r in relational.upsert(base, new, ["k"]).collect()} == {("a", 1), ("b", 9), ("c", 4), (None, 3)}
    p = relational.patch(spark.createDataFrame([("a", None), ("b", 2)], "k string, v int"), spark.createDataFrame([("a", 7), ("b", 8)], "k string, v int"), "k", ["v"])
    assert {(r.k, r.v) for r in p.collect()} == {("a", 7), ("b", 2)}
    u = relational.unlink_missing(spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "i int, fk string"), spark.createDataFrame([("x",)], "id string"), "fk")
    assert {(r.i, r.fk) for r in u.collect()} == {(1, "x"), (2, None), (3, None)}


def test_as_of_and_spaced(spark):
    t = lambda s: f"2024-01-01 00:00:{s:02d}"
    ev = spark.createDataFrame([(1, "u", t(5)), (2, "u", t(1)), (3, "v", t(9))], "id long, u string, ts string").withColumn("ts", F.to_timestamp("ts"))
    mk = spark.createDataFrame([(7, "u", t(2)), (8, "u", t(5)), (9, "u", t(6))], "id long, u string, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert {(r.id, r.mark_id) for r in relational.as_of(ev, mk, "u", "ts", ["id"]).collect()} == {(1, 8), (2, None), (3, None)}
    rows = spark.createDataFrame([(i, "u", t(s)) for i, s in enumerate((0, 4, 9, 11, 20, 29))], "id long, u string, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(r.id for r in relational.spaced(rows, "u", "ts", 10, "id").collect()) == [0, 3, 5]


def test_only_within_counts_before_it_links(spark):
    ts = lambda s: f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}"
    ev = spark.createDataFrame([(1, "u", ts(700)), (2, "v", ts(700)), (3, "w", ts(700))], "e long, k string, ts string").withColumn("ts", F.to_timestamp("ts"))
    mk = spark.createDataFrame([(10, "u", ts(100)), (11, "v", ts(650)), (12, "v", ts(690)), (13, "w", ts(99))], "m long, k string, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert [(r.e, r.mark) for r in relational.only_within(ev, mk, "k", "ts", 600, "m").collect()] == [(1, 10)]


def test_fuzzy_pairs_against_all_pairs(spark):
    rnd = random.Random(5)
    parts = ["Node", "Labs", "Norda", "Nordal", "100%", "Remote", "a", "ab", "Kord", "_x"]
    a = {" ".join(rnd.sample(parts, rnd.choice((1, 1, 2, 3)))) for _ in range(40)} | {"", " ", "-"}
    b = {" ".join(rnd.sample(parts, rnd.choice((1, 2)))) for _ in range(30)} | {"", "a-b"}
    tri = lambda s: {f"  {w} "[i : i + 3] for w in "".join(c if c.isalnum() else " " for c in s.lower()).split() for i in range(len(w) + 1)}
    want = set()
    for x in a:
        for y in b:
            if not x.strip() or not y.strip():
                continue
            s, t = tri(x), tri(y)
            sim = len(s & t) / len(s | t) if s | t else 0
            if sim >= 0.4 or x.lower() in y.lower() or y.lower() in x.lower():
                want.add((x, y))
    got = match.fuzzy_pairs(spark.createDataFrame([(x,) for x in [*a, None]], "a string"), spark.createDataFrame([(y,) for y in b], "b string"))
    assert {(r.a, r.b) for r in got.collect()} == want


def test_unique_links(spark):
    rows = spark.createDataFrame([(1, "Acme"), (2, "Both"), (3, None)], "id long, a string")
    pairs = spark.createDataFrame([("Acme", "Acme Ltd"), ("Both", "Both X"), ("Both", "Both Y")], "a string, b string")
    targets = spark.createDataFrame([("t1", "Acme Ltd"), ("t2", "Both X"), ("t3", "Both Y")], "target string, b string")
    assert {(r.id, r.matches, r.target) for r in match.unique_links(rows, pairs, targets).collect()} == {(1, 1, "t1"), (2, 2, None), (3, 0, None)}


def test_dense_topk_blocks_and_bad_vectors(spark):
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(60, 8)).astype("f4")
    data = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(60, None), (61, [0.0] * 8), (62, [1.0] * 3), (63, [float("nan")] * 8)]
    df = spark.createDataFrame(data, "id long, v array<float>")
    q = df.where("id % 10 = 0")
    y = x / np.linalg.norm(x, axis=1)[:, None]
    want = {(a, b) for a in range(0, 60, 10) for b in np.argsort(-(y[a] @ y.T), kind="stable")[:4].tolist()}
    for size in (10**9, 100):
        got = retrieve.dense_topk(q, df, 4, "id", "id", "v", block_bytes=size)
        assert {(r.query, r.row) for r in got.collect()} == want
    assert retrieve.dense_topk(q, df.limit(0), 4, "id", "id", "v").count() == 0
    assert retrieve.dense_topk(q.limit(0), df, 4, "id", "id", "v").count() == 0


def test_fusion_grades_metrics(spark):
    legs = spark.createDataFrame([(1, "a", 0, 1), (1, "b", 0, 2), (1, "b", 1, 1), (1, "c", 1, 2)], "query int, doc string, leg int, rank int")
    fused = retrieve.fuse(legs)
    assert [r.doc for r in fused.orderBy("rank").collect()] == ["b", "a", "c"]
    graded = retrieve.apply_grades(fused.select("query", "doc", "rank"), spark.createDataFrame([(1, "c", 2), (1, "b", 0)], "query int, doc string, grade int"), 3)
    assert [r.doc for r in graded.orderBy("rank").collect()] == ["c"]
    none = retrieve.apply_grades(fused.select("query", "doc", "rank"), spark.createDataFrame([], "query int, doc string, grade int"), 2)
    assert [r.doc for r in none.orderBy("rank").collect()] == ["b", "a"]
    m = retrieve.ranking_metrics(fused, spark.createDataFrame([(1, "a"), (2, "z")], "query int, doc string"), 3).orderBy("query").collect()
    assert (m[0].precision, m[0].recall, m[0].rr) == (pytest.approx(1 / 3), 1.0, 0.5) and m[0].ndcg == pytest.approx(1 / np.log2(3))
    assert (m[1].precision, m[1].rr, m[1].hit) == (0.0, 0.0, 0)


def test_sparse_and_or(spark):
    d = spark.createDataFrame([(1, "Spark and Kafka"), (2, "Kafka only"), (3, None), (4, "")], "id long, t string")
    q = spark.createDataFrame([(9, "spark kafka")], "q long, qt string")
    assert {r.doc for r in retrieve.sparse_scores(q, d, "q", "qt", "id", "t").collect()} == {1, 2}
    assert {r.doc for r in retrieve.sparse_scores(q, d, "q", "qt", "id", "t", True).collect()} == {1}


TEXT = "Jo Doe\n\nSKILLS\nSpark, Kafka\nEXPERIENCE\r\n" + "\n".join(f"- line {i} with some words to fill it up a little" for i in range(40)) + "\nEDUCATION:\n" + "x" * 1500


def test_passages():
    out = chunk.passages(TEXT)
    assert out[0] == "Jo Doe" and out[1] == "SKILLS\nSpark, Kafka"
    assert all(p.startswith(("EXPERIENCE\n", "EDUCATION:\n")) for p in out[2:])
    assert all(len(p) <= 800 for p in out)
    assert chunk.passages("") == [] and chunk.passages(" \n ") == [] and chunk.passages("SKILLS") == []
    assert not chunk.is_header("- API - built it") and chunk.is_header("WORK HISTORY — 2019")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab c-", min_size=0, max_size=60), max_size=30))
def test_passages_keep_every_line(lines):
    text = "\n".join(lines)
    joined = "\n".join(chunk.passages(text, 80, 20))
    assert all(x.strip() in joined for x in lines if x.strip() and not chunk.is_header(x.strip()))


def test_quality(spark):
    assert quality.repair("saved about 38 percent", "We saved 38.5 percent") == "saved 38.5 percent"
    assert quality.repair("in 2020 saved 40 percent", "saved 41 percent and 42 percent") == "in 2020 saved 40 percent"
    fixed = quality.repair("cut roughly 1,000 hours", "cut 1,043 hours")
    assert fixed == "cut 1,043 hours" and quality.repair(fixed, "cut 1,043 hours") == fixed
    r = one(spark, quality.ungrounded(F.lit("7 of 9 and 9"), F.lit("only 7")), quality.ungrounded(F.lit("5"), F.lit(None)), quality.faithfulness(F.lit("none"), F.lit("")))
    assert list(r) == [["9", "9"], ["5"], 1.0]
    drafts = spark.createDataFrame([(1, "r", "The mail relay migration team saved 45 hours.")], "id long, r string, t string")
    chunks = spark.createDataFrame([("r", "c1", "The mail relay migration team grew"), ("r", "c2", "payroll took 45 weeks")], "r string, c string, ct string")
    assert [(x.figure, x.best) for x in quality.misattributed(drafts, chunks, "id", "t", "r", "c", "ct").collect()] == [("45", "c1")]


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "x")], "id int, v string")
    assert [r.reasons for r in validate(df, {"v": F.col("v") == "x", "id": F.col("id") > 0}).orderBy("id").collect()] == [["v"], []]
    assert "review" in schema_of("messages").fieldNames()
    (tmp_path / "a.txt").write_text("one\ntwo")
    assert read_text_files(spark, str(tmp_path / "a.txt")).first().text == "one\ntwo"
    out = str(tmp_path / "t")
    replace_partitions(spark.createDataFrame([("a", 1), ("b", 2)], "p string, v int"), out, "p")
    replace_partitions(spark.createDataFrame([("a", 5)], "p string, v int"), out, "p")
    assert {(r.p, r.v) for r in spark.read.parquet(out).collect()} == {("a", 5), ("b", 2)}


def test_streams_equal_batches(spark, tmp_path):
    rows = [("u1", f"2024-01-0{1 + i % 3} 0{i % 9}:00:00", i * 10 % 70) for i in range(12)]
    df = spark.createDataFrame(rows, "k string, ts string, n long").withColumn("ts", F.to_timestamp("ts"))
    src = str(tmp_path / "src")
    df.coalesce(1).write.parquet(src)
    stream = lambda: spark.readStream.schema(df.schema).parquet(src)

    def run(s, name, mode):
        q = s.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        return {tuple(r) for r in spark.table(name).collect()}

    assert run(state.tumbling_counts(stream(), "ts", "k", "n"), "tumbling", "complete") == {tuple(r) for r in state.tumbling_counts(df, "ts", "k", "n").collect()}
    assert len(run(state.first_of_each(stream(), ["k"], "ts", "10 days"), "firsts", "append")) == 1
    best, want = -1, []
    for _, t, n in sorted(rows, key=lambda r: (r[1], r[2])):
        if n > best:
            best = n
            want.append(n)
    assert sorted(r[2] for r in run(state.growing_reads(stream(), "k", "ts", "n"), "growing", "append")) == want


def test_stems_and_english_search(spark):
    from wrenlake.functions.stem import porter

    pairs = "caresses:caress ponies:poni cats:cat feed:feed agreed:agre plastered:plaster motoring:motor sing:sing conflated:conflat troubled:troubl hopping:hop falling:fall hissing:hiss filing:file happy:happi sky:sky relational:relat rational:ration digitizer:digit operator:oper decisiveness:decis triplicate:triplic hopefulness:hope revival:reviv adoption:adopt adjustment:adjust probate:probat rate:rate cease:ceas controll:control roll:roll"
    assert {w: porter(w) for w, _ in (p.split(":") for p in pairs.split())} == dict(p.split(":") for p in pairs.split())
    d = spark.createDataFrame([(1, "migrating pipelines quickly and migrated pipeline"), (2, "a pipeline of old and slow and late migrations"), (3, None), (4, "other words")], "id long, t string")
    q = spark.createDataFrame([(9, "migration of the pipeline")], "q long, qt string")
    assert {r.doc for r in retrieve.english_scores(q, d, "q", "qt", "id", "t").collect()} == {1, 2}
    dense = {r.doc: r.score for r in retrieve.english_scores(q, d, "q", "qt", "id", "t", True).collect()}
    assert dense[1] > dense[2] > 0
    assert retrieve._density([[0, 10], [1, 20]]) == pytest.approx(1 / 1 + 1 / 9 + 1 / 10)  # (0, 1), (1, 10), (10, 20)


def test_words_of_other_scripts(spark):
    d = spark.createDataFrame([(1, "Verfügbarkeit für alle"), (2, "разработчик данных"), (3, "x")], "id long, t string")
    q = spark.createDataFrame([(7, "verfügbarkeit"), (8, "Данных")], "q long, qt string")
    assert {(r.query, r.doc) for r in retrieve.sparse_scores(q, d, "q", "qt", "id", "t").collect()} == {(7, 1), (8, 2)}


def test_lenses_violations_markers(spark):
    hits = spark.createDataFrame([(1, 0, "a", 1, 3, None), (1, 0, "b", 2, None, 1), (1, 1, "b", 1, 7, 7), (1, 1, "c", 2, 1, None)], "query int, lens int, doc string, rank int, dense_rank int, sparse_rank int")
    out = [(r.doc, r.rank, r.dense_rank, r.sparse_rank) for r in retrieve.fuse_lenses(hits, 2).orderBy("rank").collect()]
    assert out == [("b", 1, None, 1), ("a", 2, 3, None)]  # the legs of the first lens that found it
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "a", 1)], "query int, doc string, rank int")
    assert [tuple(r) for r in retrieve.violations(ranked, spark.createDataFrame([(1, "b"), (1, "b"), (2, "z")], "query int, doc string"), 2).collect()] == [(1, 1)]
    cases = spark.createDataFrame([("c", "Mail RELAY"), ("c", "100%_x"), ("d", None)], "case string, marker string")
    chunks = spark.createDataFrame([(1, "the mail relay"), (2, None), (3, "100%_X and mail relay")], "doc long, text string")
    for block in (1, 500):
        assert {tuple(r) for r in retrieve.marked(cases, chunks, block).collect()} == {("c", "Mail RELAY", 1), ("c", "Mail RELAY", 3), ("c", "100%_x", 3)}
    assert [tuple(r) for r in retrieve.marked(cases, chunks.limit(0)).orderBy("marker").collect()] == [("c", "100%_x", None), ("c", "Mail RELAY", None)]


def test_parse_grades(spark):
    cases = {
        '{"grades":[{"id":0,"grade":2},{"id":1,"grade":7},{"id":2,"grade":-1},{"id":3,"grade":1}]}': [(0, 2), (1, 2), (2, 0)],
        '{"grades":[{"id":1,"grade":0},{"id":1,"grade":1.5},{"id":"0","grade":1},5,null,{"id":0.5,"grade":1},{"id":2,"grade":"1"}]}': [(1, 2)],
        '{"grades":[]}': [], '{"other":1}': None, "no json": None, '{"grades":3}': None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "a string")
    got = {r.a: r.g if r.g is None else [(x.id, x.grade) for x in r.g] for r in df.select("a", retrieve.parse_grades(F.col("a"), F.lit(3)).alias("g")).collect()}
    assert got == cases


def test_thread_and_summary_checks(spark):
    m = spark.createDataFrame([(1, "t", 1, "We cut 45 hours and 45 days. Did you see?"), (2, "t", 2, "Again 45 hours, 45 more and 9."), (3, "u", 1, "45")], "id long, t string, o int, x string")
    assert {(r.id, r.figures) for r in quality.repeated_figures(m, "t", ["o"], "id", "x").collect()} == {(2, 2)}
    r = one(spark, quality.claim_text(F.lit("I built it. Your team? It works.")), quality.ask_text(F.lit("I built it. Your team? It works.")))
    assert list(r) == ["I built it. It works.", "Your team?"]
    drafts = spark.createDataFrame([(1, "r", "9.5 and 40 and 40"), (2, "s", "7")], "id long, r string, t string")
    chunks = spark.createDataFrame([("r", "Professional Summary\n9.5 of 10 and 40"), ("r", "EXPERIENCE\n40 things"), ("s", "Profiles\n7")], "r string, c string")
    assert {tuple(x) for x in quality.summary_only(drafts, chunks, "id", "t", "r", "c").collect()} == {(1, "9.5")}


def test_repair_counts_before_units():
    assert quality.repair("about 30 seconds", "31 days") == "about 30 seconds"
    assert quality.repair("over 30,000 lines", "32,330 lines and 31,900 users") == "over 30,000 lines"  # two figures near, one of the same unit
    assert quality.repair("over 32,000 lines", "32,330 lines") == "32,330 lines"
    assert quality.repair("a 9/10 score out of 10", "a 9.5/10 score out of 10") == "a 9.5/10 score out of 10"
    assert quality.repair("100 hours", "96 hours") == "100 hours" and quality.repair("1,040 hours", "1,043 hours") == "1,043 hours"


def test_fold_patch_and_one_row(spark):
    df = spark.createDataFrame([(i, None if i == 3 else "k", i) for i in range(8)], "id long, k string, s long").withColumn("ts", F.timestamp_seconds("s"))
    assert sorted(r.id for r in relational.spaced(df, "k", "ts", 3, "id").collect()) == [0, 4, 7]
    base, change = spark.createDataFrame([("a", 1, None), ("b", 2, 3)], "k string, v int, w int"), spark.createDataFrame([("a", None, 5, ["v"]), ("b", None, 9, [])], "k string, v int, w int, given array<string>")
    assert {tuple(r) for r in relational.patch(base, change, "k", ["v", "w"], "given").collect()} == {("a", None, 5), ("b", 2, 3)}
    assert relational.expect_one(df.where("id = 1")).count() == 1
    for bad in ("id < 0", "id < 3"):
        with pytest.raises(LookupError):
            relational.expect_one(df.where(bad))


def test_spread_join_keeps_hot_keys_whole(spark):
    from wrenlake.operators.skew import spread_join

    left = spark.range(300).select(F.col("id"), F.when(F.col("id") < 250, F.lit("hot")).otherwise(F.lit(None)).alias("k"))
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("cold", 3), (None, 4)], "k string, v int")
    out = spread_join(left, right, ["k"], F.col("id"), hot=10)
    assert out.count() == 500 and out.select("id", "v").distinct().count() == 500
    assert spread_join(left.limit(0), right, ["k"], F.col("id")).count() == 0


def test_guard_in_a_session_that_sets_nothing(spark):
    spark.conf.unset("spark.sql.unionOutputPartitioning")
    try:
        assert spark.conf.get("spark.sql.unionOutputPartitioning") == "true"  # what a plain session has
        guard(spark)
        assert spark.conf.get("spark.sql.unionOutputPartitioning") == "false"
    finally:
        spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def _misplaced(drafts, chunks):
    """misattributed() by all pairs, on texts whose words begin with w and whose figures stand alone."""
    count = {}
    for r, _, _ in chunks:
        count[r] = count.get(r, 0) + 1
    pairs, out = {}, {}
    for k, r, t in drafts:
        for no, x in enumerate(t.split(". ")):
            ws, ns = ({w for w in x.split() if w[0] == "w"}, {w for w in x.split() if w[0] != "w"})
            if ns and len(ws) >= 3:
                pairs.setdefault((k, no), []).extend((-len(ws & set(ct.split())), c, ns & set(ct.split())) for q, c, ct in chunks if q == r and count[r] > 1)
    for (k, no), ps in sorted(pairs.items()):
        top, best, _ = min(ps, default=(0, "", 0), key=lambda p: p[:2])
        for n in set().union(*[p[2] for p in ps]):
            of = [p for p in ps if n in p[2]]
            if best not in {p[1] for p in of} and -top >= 2 and min(p[0] for p in of) - top >= 2:
                out.setdefault((k, n), (no, best))
    return {(k, no, n, best) for (k, n), (no, best) in out.items()}


def test_misplaced_figures_of_a_hot_owner(spark):
    rnd = random.Random(5)
    words = lambda n: " ".join("w" + rnd.choice("abcdefg") + rnd.choice("abcdef") for _ in range(n))
    owner = lambda: "hot" if rnd.random() < 0.5 else f"r{rnd.randrange(40)}"
    drafts = [(i, owner(), f"{words(5)} {rnd.randrange(60)}. {words(8)} {rnd.randrange(60)}") for i in range(300)]
    drafts += drafts[:20] + [(k, owner(), t) for k, _, t in drafts[20:40]]  # repeats, and drafts of two owners
    chunks = [(owner(), f"c{i}", f"{words(9)} {rnd.randrange(60)}") for i in range(200)]
    chunks += [(r, c, f"{words(9)} {rnd.randrange(60)}") for r, c, _ in chunks[:60]]  # ids that two rows have
    d, c = spark.createDataFrame(drafts, "id long, r string, t string"), spark.createDataFrame(chunks, "r string, c string, ct string")
    want = _misplaced(drafts, chunks)
    assert len(want) > 50
    for limits in ({}, {"held": 30, "busy": 20, "helpers": 3}):
        out = quality.misattributed(d, c, "id", "t", "r", "c", "ct", **limits)
        assert {tuple(x) for x in out.collect()} == want and out.count() == len(want)
    # texts move once, pairs never: the shuffles are the owner's, the sentence's and the figure's, and the counts of hot owners
    assert out._jdf.queryExecution().sparkPlan().toString().count("Join") < 5
