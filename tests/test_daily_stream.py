"""Daily contexts kept by a stream against those computed from all rows."""

import os
from datetime import date, datetime

from lorekeep.operators import rollups as D
from lorekeep.sources import bridge as B
from lorekeep.streaming import daily_stream as Z

SF = "/root/testdata/sf0.001"


def plain(df):
    return sorted([tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect()], key=str)


def files(out, *days):
    return sorted((d, f, os.stat(os.path.join(d, f)).st_mtime_ns) for d, _, names in os.walk(out) for f in names if f.endswith(".parquet") and any(f"date={day}" in d for day in days))


def test_any_order_of_batches_gives_the_whole(spark, tmp_path):
    memories, affect = B.memories(spark, SF), B.affect(spark, SF)
    every = Z.changes(memories, affect)
    arrived, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    columns = ["date", "memory_count", "valence_mean", "arousal_mean", "types"]
    # what is taken back comes first; each half by a call of its own
    for part in (every.where("change < 0"), every.where("change > 0")):
        part.repartition(2, "id").write.mode("append").parquet(arrived)
        Z.keep_daily(Z.read_changes(spark, arrived), out, progress).awaitTermination()
    kept = Z.kept(spark, out)
    assert plain(Z.context(kept).select(columns)) == plain(D.daily_context(memories, affect).select(columns))
    assert plain(Z.arc(kept).select("date", "hour", "valence_mean", "n")) == plain(D.hourly_arc(memories, affect).select("date", "hour", "valence_mean", "n"))


def rows(spark, *days, change=1):
    return spark.createDataFrame([(i, datetime(2024, 1, d, 5), "note", 0.5, None, change) for i, d in enumerate(days)], Z.CHANGE)


def counts(spark, out):
    return {r.date.day: r.memory_count for r in Z.context(Z.kept(spark, out)).collect()}


def test_a_batch_that_comes_again_counts_once_and_other_days_keep_their_files(spark, tmp_path):
    out = str(tmp_path / "out")
    assert counts(spark, out) == {}
    Z.merge_batch(rows(spark, 1, 1, 2), out, 0)
    Z.merge_batch(rows(spark, 1, 1, 2), out, 0)
    assert counts(spark, out) == {1: 2, 2: 1}
    before = files(out, "2024-01-01")
    for _ in range(3):
        Z.merge_batch(rows(spark, 2, 3), out, 1)
    assert counts(spark, out) == {1: 2, 2: 2, 3: 1}
    assert files(out, "2024-01-01") == before != []
    # a driver lost after one of two days was written: the batch goes on as if it were new
    Z.merge_batch(rows(spark, 2), out, 2)
    Z.merge_batch(rows(spark, 2, 1), out, 2)
    assert counts(spark, out) == {1: 3, 2: 3, 3: 1}
    Z.merge_batch(rows(spark, 1, 1, 1, change=-1), out, 3)
    assert counts(spark, out) == {2: 3, 3: 1}
    Z.merge_batch(rows(spark).limit(0), out, 4)
    assert counts(spark, out) == {2: 3, 3: 1}
    assert len({d for d, *_ in files(out, "2024-01-02")}) == 1  # earlier versions are gone


def test_nulls(spark, tmp_path):
    out = str(tmp_path / "out")
    Z.merge_batch(spark.createDataFrame([(1, None, None, None, None, 1), (2, datetime(2024, 1, 1), None, None, 0.5, 1)], Z.CHANGE), out, 0)
    Z.merge_batch(spark.createDataFrame([(3, None, "note", 0.25, None, 1)], Z.CHANGE), out, 1)
    got = {r.date: (r.memory_count, r.valence_mean, r.arousal_mean) for r in Z.context(Z.kept(spark, out)).collect()}
    assert got == {None: (2, 0.25, None), date(2024, 1, 1): (1, None, 0.5)}
