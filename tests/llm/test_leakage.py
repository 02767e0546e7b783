from __future__ import annotations

import random

from wrenlake.llm import leakage

RND = random.Random(2)
VOCAB = [f"{a}{b}" for a in "ba ke lo mi nu ra se to vi za".split() for b in "dral min sper tok wen".split()]


def sentence(n: int) -> str:
    return " ".join(RND.choice(VOCAB) for _ in range(n)).capitalize() + "."


ITEMS = [(i, f"{sentence(22)} {sentence(18)}", "en", 1) for i in range(1, 40)] + [(90, "Marlowの仓库停电54小时后，Yarrow用借来的货车维持平台业务，并在事后开出56欧元的账单。", "zh", 1), (91, None, "en", 1), (92, "", None, 1)]


def noise(n: int = 60) -> str:
    return " ".join(sentence(12) for _ in range(n // 12))


def documents():
    first = ITEMS[0][1]
    words = first.split()
    return [
        (1, f"{noise()} {first} {noise()}"), (2, first.upper().replace(" ", "  ")), (3, "\n".join(words)), (4, f"{noise()} {' '.join(words[3:15])} {noise()}"), (5, f"{noise()} {' '.join(words[3:12])} {noise()}"),
        (6, " ".join(w if i % 6 else "other" for i, w in enumerate(words))), (7, None), (8, ""), (9, noise(600)), (10, f"前言。{ITEMS[-3][1]}"), (11, first.replace("a", "á").replace("t", "ｔ")), (11, first),
    ]


def test_found(spark):
    docs = spark.createDataFrame([(*r, 1) for r in documents()], "doc_id long, text string, item_id int")
    items = spark.createDataFrame(ITEMS, "item_id long, item_text string, lang string, doc_id int")
    got = [(r.doc_id, r.item_id) for r in leakage.leaked(docs, items).collect()]
    assert sorted(got) == [(1, 1), (2, 1), (3, 1), (4, 1), (6, 1), (10, 90), (11, 1), (11, 1)]
    sharded = [(r.doc_id, r.item_id) for r in leakage.leaked(docs, items, shard_chars=900).collect()]
    assert set(sharded) == set(got)


def test_pruning_loses_nothing():
    """The levels give exactly the parts that scoring every part gives."""
    import numpy as np

    parts = [p for i, t, _, _ in ITEMS if t for p in leakage.parts_of(i, [leakage.tokens(x + ".") for x in t.split(".") if x], 12)]
    rnd = np.random.default_rng(1)
    for share in (0.3, 0.75, 1.0, 1.6):
        index = leakage.Index(parts, share)
        score = np.zeros((len(index.vocab) + 1, len(parts)))
        bars = np.zeros(len(parts))
        for level in index.levels:
            size = level.blocks * leakage.BLOCK
            for key, v in zip(level.keys[:-1], level.impacts[:-1]):
                score[key // size, level.parts[key % size]] = v
            bars[level.parts] = level.bars[: level.n]
        passages = rnd.integers(0, len(index.vocab) + 1, (200, leakage.PASSAGE))
        passages[0, :20] = index.ids[0][:20]
        want = {(r, d) for r in range(200) for d in np.flatnonzero(score[passages[r]].sum(axis=0) >= bars - 1e-6)}
        got = {(int(r), int(d)) for level in index.levels for rs, ds in level.above(passages) for r, d in zip(rs, ds)}
        assert got == want and want


def test_short_items_and_runs_across_sentences(spark):
    long = ITEMS[1][1].split()
    items = spark.createDataFrame([*ITEMS, (70, "Zorvin keeps nine blue ledgers daily.", "en", 1), (71, "Merrin why?", "en", 1)], "item_id long, item_text string, lang string, x int")
    docs = spark.createDataFrame(
        [(1, f"{noise()} Zorvin keeps nine blue ledgers daily. {noise()}"), (2, f"{noise()} Zorvin keeps nine red ledgers daily. {noise()}"), (3, f"{noise()} {' '.join(long[15:29])} {noise()}"), (4, f"{noise()} merrin, why {noise()}")],
        "doc_id long, text string",
    )
    assert sorted((r.doc_id, r.item_id) for r in leakage.leaked(docs, items).collect()) == [(1, 70), (3, 2), (4, 71)]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, item_text string, lang string")
    assert leakage.leaked(docs, items).count() == 0
    assert leakage.leaked(spark.createDataFrame([(1, "a b c")], docs.schema), items).count() == 0
