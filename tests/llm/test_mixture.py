from __future__ import annotations

import pytest

from wrenlake.llm import mixture

TARGETS = [("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.1, 2), ("gone", 0.1, 2)]


def test_shares_and_caps(spark):
    rows = [(i, ("A ", "b", "c", None, "other")[i % 5], "word " * (1 + i * 7 % 90), 1) for i in range(3000)] + [(9001, "b", None, 1), (9002, "b", "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, tokens int")
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    selection, shares = mixture.mix(docs, targets)
    by = {r.source: r for r in shares.collect()}
    assert by["gone"].tokens_used == 0 and by["gone"].actual_share == 0.0
    for s, want in (("a", 5 / 9), ("b", 3 / 9), ("c", 1 / 9)):
        assert by[s].actual_share == pytest.approx(want, abs=0.004), s
    caps = {s: m for s, _, m in TARGETS}
    picked = selection.collect()
    assert all(1 <= r.copies <= caps[r.source] for r in picked) and not {9001, 9002} & {r.doc_id for r in picked}
    assert sum(r.copies * r.tokens for r in picked) == sum(r.tokens_used for r in by.values())
    again = {(r.doc_id, r.copies) for r in mixture.mix(docs, targets)[0].collect()}
    assert again == {(r.doc_id, r.copies) for r in picked}


def test_given_total(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 2], "w " * (1 + i % 40)) for i in range(2000)], "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 0.25, 2), ("b", 0.75, 2)], "source string, target_share double, max_repeats int")
    shares = {r.source: r for r in mixture.mix(docs, targets, total=20_000)[1].collect()}
    assert sum(r.tokens_used for r in shares.values()) == pytest.approx(20_000, rel=0.01)
    assert shares["a"].actual_share == pytest.approx(0.25, abs=0.005)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, text string")
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    selection, shares = mixture.mix(docs, targets)
    assert selection.count() == 0 and {r.actual_share for r in shares.collect()} == {0.0}


def test_unreachable_total_raises(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 2], "w " * 10) for i in range(20)], "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    with pytest.raises(ValueError, match="at most"):
        mixture.mix(docs, targets, total=10_000_000)
