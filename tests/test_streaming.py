"""Streams against the batch operators over the same signals."""

import json
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lorekeep.operators import signals as S
from lorekeep.sources import bridge as B
from lorekeep.sources import exports as X
from lorekeep.streaming import hive_stream as H
from lorekeep.streaming import replay_stream as Z

SF = "/root/testdata/sf0.001"


def files(spark, tmp_path):
    path = str(tmp_path / "signals")
    df = B.hive_events(spark, SF)
    df = df.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("expires_at", F.col("expires_at").cast("timestamp")).select(*[c.split()[0] for c in H.SIGNAL.split(", ")])
    df.repartitionByRange(4, "event_id").write.parquet(path)
    return path, df


def drained(df, mode, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_waggles(spark, tmp_path):
    path, df = files(spark, tmp_path)
    got = drained(H.waggle_state(H.read_signals(spark, path)), "complete", "waggles", tmp_path)
    want = S.waggles(df, cap=10_000)
    row = lambda r: (r.key, r.dances, r.intensity, r.rationale, r.quorum)
    assert sorted(map(row, got.collect())) == sorted(map(row, want.collect()))


def test_windows_and_repeats(spark, tmp_path):
    path, df = files(spark, tmp_path)
    got = drained(H.signals_per_window(H.read_signals(spark, path)), "complete", "windows", tmp_path)
    want = df.groupBy(F.window("ts", "6 hours").start.alias("start"), "kind").agg(F.count(F.lit(1)).alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    df.limit(20).coalesce(1).write.mode("append").parquet(path)
    once = drained(H.first_of_each(H.read_signals(spark, path, 100), "60 days"), "append", "once", tmp_path)
    assert once.count() == df.count()


def test_pending_log(spark, tmp_path):
    path, df = files(spark, tmp_path)
    out = str(tmp_path / "log")
    for _ in range(2):  # the second run finds nothing new
        H.append_pending(H.read_signals(spark, path), out, str(tmp_path / "check")).awaitTermination()
    assert spark.read.json(out).count() == df.count()


def test_a_batch_delivered_twice_or_cut_short_counts_once(spark, tmp_path):
    _, df = files(spark, tmp_path)
    out = str(tmp_path / "once")
    parts = [df.where(F.col("event_id") % 3 == k) for k in range(3)]
    assert X.append_signals(parts[0], out, 0) and not X.append_signals(parts[0], out, 0)
    # a killed delivery of batch 1 leaves files beside the log, which nobody reads and the next delivery replaces
    parts[2].write.json(f"{out}/_incoming-1")
    assert X.read_signals(spark, out, H.SIGNAL).count() == parts[0].count()
    assert X.append_signals(parts[1], out, 1) and X.append_signals(parts[2], out, 2) and not X.append_signals(parts[0], out, 2)
    back = X.read_signals(spark, out, H.SIGNAL)
    assert sorted(r.event_id for r in back.collect()) == sorted(r.event_id for r in df.collect())
    assert back.where(F.col("batch") != F.col("event_id") % 3).count() == 0
    # a checkpoint that is lost delivers batch 0 again, with other rows: the log keeps what it has
    assert not X.append_signals(df, out, 0) and X.read_signals(spark, out, H.SIGNAL).count() == df.count()


def _stream(spark, tmp_path, rows, order, per_batch, make, name, runs):
    """What a stream gives when files come in ``order``, ``per_batch`` rows each, and it is started anew ``runs`` times."""
    folder, rows = str(tmp_path / name), [rows[i] for i in order]
    schema = "key bigint, ts timestamp, number bigint"
    step = -(-len(rows) // runs)
    out = None
    for lo in range(0, len(rows) + step, step):
        part = rows[lo : lo + step] or [(-1, datetime(2100, 1, 1), -1)]
        for k in range(0, len(part), per_batch):
            spark.createDataFrame(part[k : k + per_batch], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"))
        q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        out = stream.schema
    return spark.read.schema(out).parquet(f"{folder}/out"), q


def _requests(n, seed):
    r = random.Random(seed)
    at = datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        at += timedelta(seconds=r.choice([0, 0, 5, 20, 200]), microseconds=r.choice([0, 1, 999]))
        rows.append((i % 3, at, r.randrange(6) if seed == 2 else i))
    order = sorted(range(n), key=lambda i: (rows[i][1] + timedelta(seconds=r.uniform(0, 500)), i))
    return rows, order


def test_admission_by_stream_at_any_cut(spark, tmp_path):
    spark.conf.set(*Z.STATE_STORE)
    rows, order = _requests(90, 1)
    limits = ((600, 4), (60, 2))
    batch = spark.createDataFrame(rows, "identity bigint, ts timestamp, event_id bigint")
    want = sorted(map(tuple, S.rate_limited(batch.withColumn("ts", F.col("ts").cast("timestamp_ntz")), limits).select("event_id", "identity", "allowed").collect()))
    assert {x[2] for x in want} == {True, False}
    for per_batch, runs in ((7, 3), (45, 1)):
        make = lambda s: Z.admissions(s.select(F.col("key").alias("identity"), "ts", F.col("number").alias("event_id")), limits, "10 minutes")
        got, last = _stream(spark, tmp_path, rows, order, per_batch, make, f"a{per_batch}", runs)
        assert sorted(map(tuple, got.where("event_id >= 0").select("event_id", "identity", "allowed").collect())) == want
        # nothing is remembered of what the limits no longer reach: the closing row and its timer are left
        assert last.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4
    spark.conf.unset(Z.STATE_STORE[0])


def test_rings_by_stream_go_on_from_a_batch_state(spark, tmp_path):
    spark.conf.set(*Z.STATE_STORE)
    rows, order = _requests(80, 2)
    pushes = spark.createDataFrame(rows, "ring bigint, ts timestamp, memory_id bigint").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    plain = lambda df: sorted((r.ring, r.memory_id, round(r.activation, 6), r.last_activated_at) for r in df.collect())
    want = plain(S.ring_replayed(pushes, 3))
    half = rows[40][1]
    start = S.ring_replayed(pushes.where(F.col("ts") < F.lit(half).cast("timestamp_ntz")), 3)
    for name, first, some in (("whole", None, order), ("second half", start, [i for i in order if rows[i][1] >= half])):
        make = lambda s, first=first: Z.rings(s.select(F.col("key").alias("ring"), "ts", F.col("number").alias("memory_id")), "10 minutes", 3, first)
        got, _ = _stream(spark, tmp_path, rows, some, 11, make, name, 2)
        assert plain(Z.newest_rings(got.where("ring >= 0"))) == want
    spark.conf.unset(Z.STATE_STORE[0])


def test_export_round_trip_and_tags(spark, tmp_path):
    turns = B.transcripts(spark, SF)
    X.write_export(turns, str(tmp_path / "export"))
    back = X.read_export(spark, str(tmp_path / "export"), multiline=False)
    assert back.count() == turns.count()
    assert {(r.conv_id, r.text) for r in back.collect()} == {(str(r.conv_id), r.text) for r in turns.collect()}
    (tmp_path / "tags.json").write_text(json.dumps([{"id": 3, "flag": "framing", "source": "x"}]))
    tagged = X.apply_tags(B.memories(spark, SF), X.read_tags(spark, str(tmp_path / "tags.json"))).where("id = 3").first()
    assert (tagged.pattern_flag, tagged.pattern_source) == ("framing", "x")
    X.write_markdown(B.journal(spark, SF).withColumn("description", F.substring("description", 1, 20)), str(tmp_path / "md"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "md")).collect()]
    days = [x for x in lines if x.startswith("## ")]
    assert days == sorted(set(days)) and days[0] == "## 2024-01-01" and len(days) == B.journal(spark, SF).select(F.to_date("ts")).distinct().count()
    assert sum(x.startswith("- **") for x in lines) == B.journal(spark, SF).count()
    at = {x: k for k, x in enumerate(lines)}
    first = B.journal(spark, SF).where("to_date(ts) = DATE '2024-01-02'").first()
    assert at["## 2024-01-02"] < next(k for k, x in enumerate(lines) if first.title.split("\n")[0] in x and k > at["## 2024-01-02"]) < at["## 2024-01-03"]
    X.write_snapshot(spark.range(1), str(tmp_path / "snap"))
    assert spark.read.json(str(tmp_path / "snap")).count() == 1


def test_waiting_rows_are_a_few_entries_and_not_read_until_they_are_due():
    """A batch of many rows of one key adds chunks to its state and reads none of those that wait; the replay is in order."""

    class State:
        def __init__(self, single):
            self.single, self.items, self.reads, self.value = single, [], 0, None

        def appendList(self, new):
            self.items += new

        def put(self, new):
            self.items = list(new)

        def get(self):
            self.reads += 1
            return self.value if self.single else iter(self.items)

        def update(self, value):
            self.value = value

        def clear(self):
            self.items, self.value = [], None

    class Handle:
        def __init__(self):
            self.timers = set()

        def getListState(self, name, schema):
            return State(False)

        def getValueState(self, name, schema):
            return State(True)

        def registerTimer(self, at):
            self.timers.add(at)

        def deleteTimer(self, at):
            self.timers.remove(at)

    class Times:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):
            return self.ms

    processor, handle = Z.Admission(((10, 2),)), Handle()
    processor.init(handle)
    rows = [(i * 1_000_000, i) for i in range(25_000)]
    random.Random(1).shuffle(rows)
    for part in (rows[:15_000], rows[15_000:]):
        list(processor.handleInputRows((7,), iter([(7, None, at, n) for at, n in part]), Times(0)))
    assert len(processor.waiting.items) <= 4 and processor.waiting.reads == 0 and handle.timers == {1}
    got = list(processor.handleExpiredTimer((7,), Times(20_000_000), None))
    assert [r.event_id for r in got] == list(range(20_001)) and [r.event_id for r in got if r.allowed][:6] == [0, 1, 10, 11, 20, 21]
    assert len(processor.waiting.items) == 1 and max(handle.timers) == 20_001_001
    got = list(processor.handleExpiredTimer((7,), Times(25_000_000), None))
    assert [r.event_id for r in got] == list(range(20_001, 25_000)) and not processor.waiting.items
