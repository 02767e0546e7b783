"""Windows, merges, guarded links and time-bounded joins on keyed tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key. ``order`` must be total; the limit runs before the shuffle too."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def upsert(base: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``incoming`` replace those of ``base`` with the same keys; rows with a null key are all kept.

    Both need the same columns, and ``incoming`` one row a key.
    """
    return base.join(incoming.select(*keys), keys, "left_anti").unionByName(incoming)


def patch(base: DataFrame, change: DataFrame, key: str, columns: list[str], given: str | None = None) -> DataFrame:
    """Fill the nulls of ``columns`` from ``change``, one row a key; other rows and values stay.

    given: a column of ``change`` with the names of the columns that it gives; these are taken whatever they were, null too.
    """
    new = change.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns], (F.col(given) if given else F.lit(None).cast("array<string>")).alias("_given"))
    out = base.join(new, key, "left")
    value = lambda c: F.when(F.array_contains("_given", c), F.col(f"_new_{c}")).otherwise(F.coalesce(F.col(c), F.col(f"_new_{c}"))) if given else F.coalesce(F.col(c), F.col(f"_new_{c}"))
    return out.withColumns({c: value(c) for c in columns}).drop("_given", *[f"_new_{c}" for c in columns])


def unlink_missing(child: DataFrame, parent: DataFrame, fk: str, pk: str = "id") -> DataFrame:
    """Set a reference to null whose parent is gone."""
    have = parent.select(F.col(pk).alias("_pk")).distinct()
    return child.join(have, child[fk] == have["_pk"], "left").withColumn(fk, F.col("_pk")).drop("_pk")


def as_of(events: DataFrame, marks: DataFrame, key: str, time: str, payload: list[str]) -> DataFrame:
    """Each event with the ``payload`` of the latest mark of its key at or before it, or nulls.

    One union and one window instead of a range join: marks sort before events of the same instant, and
    of marks of one instant the one with the largest payload counts.
    """
    state = F.struct(F.col(time), *[F.col(c) for c in payload])
    both = marks.select(key, time, F.lit(0).alias("_side"), state.alias("_mark")).unionByName(
        events.withColumn("_row", F.struct(*events.columns)).select(key, time, F.lit(1).alias("_side"), F.lit(None).cast(_type(marks, time, payload)).alias("_mark"), "_row"),
        allowMissingColumns=True,
    )
    w = W.partitionBy(key).orderBy(time, "_side", "_mark").rowsBetween(W.unboundedPreceding, 0)
    seen = both.withColumn("_last", F.last("_mark", ignorenulls=True).over(w)).where("_side = 1")
    return seen.select("_row.*", *[F.col(f"_last.{c}").alias(f"mark_{c}") for c in (time, *payload)])


def _type(marks: DataFrame, time: str, payload: list[str]):
    return marks.select(F.struct(F.col(time), *[F.col(c) for c in payload]).alias("s")).schema["s"].dataType


def only_within(events: DataFrame, marks: DataFrame, key: str, time: str, seconds: int, mark_id: str) -> DataFrame:
    """(event columns, mark): the mark of the key within ``seconds`` before the event, if it is the only one.

    Time is cut into buckets of that length and each mark is sent to two, so the join is an equality on
    key and bucket and a busy key's rows spread over its buckets.
    """
    bucket = lambda c: F.floor(F.unix_micros(c) / (seconds * 1_000_000))
    m = marks.select(F.col(key), F.col(time).alias("_mt"), F.col(mark_id).alias("mark"))
    m = m.withColumn("_b", F.explode(F.array(bucket(F.col("_mt")), bucket(F.col("_mt")) + 1)))
    e = events.withColumn("_b", bucket(F.col(time)))
    near = (F.col("_mt") <= F.col(time)) & (F.unix_micros(F.col(time)) - F.unix_micros(F.col("_mt")) <= seconds * 1_000_000)
    hits = e.join(m, [key, "_b"]).where(near)
    out = hits.groupBy(*[F.col(c) for c in events.columns]).agg(F.count(F.lit(1)).alias("marks"), F.min("mark").alias("mark"))
    return out.where("marks = 1").drop("marks")


def spaced(df: DataFrame, key: str, time: str, seconds: int, tie: str) -> DataFrame:
    """Rows accepted when at least ``seconds`` passed since the last accepted row of their key.

    Only accepted rows reset the clock, so it is a fold: the rows of a partition stream past in the order of key and
    time, and one instant is carried. Rows of one instant go by ``tie``; without key or time there is no row.
    """
    step = seconds * 1_000_000
    rows = df.select(F.col(key), F.col(tie), F.unix_micros(F.col(time)).alias("_t")).where(F.col(key).isNotNull() & F.col("_t").isNotNull())
    kind = dict(df.dtypes)[tie]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = last = None
        for b in batches:
            keep = []
            for k, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if k != now or t - last >= step:
                    now, last = k, t
                    keep.append(True)
                else:
                    keep.append(False)
            yield pa.RecordBatch.from_arrays([b.column(1).filter(pa.array(keep, pa.bool_()))], [tie])

    ordered = rows.repartition(key).sortWithinPartitions(key, "_t", tie)
    return df.join(ordered.mapInArrow(fold, f"{tie} {kind}"), tie, "left_semi")


def expect_one(df: DataFrame) -> DataFrame:
    """``df`` when it has exactly one row; none and several raise."""
    n = df.limit(2).count()
    if n != 1:
        raise LookupError("no row" if n == 0 else "more than one row")
    return df
