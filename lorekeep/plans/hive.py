"""Signal bus queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import signals as S
from ..operators import tables as T
from ..session import table
from ..sources import bridge as B
from ..workspace import new_path, written
from .catalog import query
from .daily import r6
from .oracle import AS_OF, recursive, sql
from .retrieval import as_of

_EMITS = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key, signal ORDER BY ts DESC, event_id DESC) AS n FROM hive WHERE kind = 'emit') WHERE n = 1 ORDER BY ts DESC, event_id LIMIT 10"
_NOW = f"round(intensity * exp(-0.693 * datediff('microsecond', ts, {AS_OF}) / 1e6 / 3600 / 24), 4)"
_DANCED = """SELECT key, count(*) AS dances, max(intensity) AS intensity, arg_max(note, (ts, event_id)) FILTER (note IS NOT NULL) AS rationale, max(ts) AS last,
    count(*) >= 3 AS quorum FROM hive WHERE kind = 'waggle' GROUP BY 1"""
# twenty topics in all: those with a quorum always stay, the oldest others go
_RANKED = f"""SELECT *, row_number() OVER (PARTITION BY quorum ORDER BY last DESC, key) AS n, count(*) FILTER (quorum) OVER () AS q FROM ({_DANCED})"""
_WAGGLES = f"SELECT * FROM ({_RANKED}) WHERE quorum OR n <= 20 - q"
_STOPS = "SELECT key, count(*) AS stops, max(ts) AS last, count(*) >= 2 AS suppressed FROM hive WHERE kind = 'stop' GROUP BY 1"
_NECTAR = "SELECT *, n >= 3 AND confidence >= 0.7 AS ready FROM (SELECT key, count(*) AS n, CASE WHEN count(*) = 1 THEN 0.3 ELSE least(1.0, 0.3 + 0.15 * count(*)) END::DOUBLE AS confidence FROM hive WHERE kind = 'nectar' GROUP BY 1)"


@query("h1_active_emits", sql("hive", "SELECT key, signal, event_id, note FROM emits", emits=_EMITS))
def h1(spark, sf_dir):
    return S.active_emits(B.hive_events(spark, sf_dir)).select("key", "signal", "event_id", "note")


@query("h2_read_emits", sql("hive", f"SELECT event_id, {_NOW} AS now FROM emits WHERE (expires_at IS NULL OR expires_at > {AS_OF}) AND {_NOW} >= 0.05", emits=_EMITS))
def h2(spark, sf_dir):
    """Decayed and filtered."""
    return S.read_emits(S.active_emits(B.hive_events(spark, sf_dir)), as_of()).select("event_id", "now")


@query("h3_waggles", sql("hive", "SELECT key, dances, round(intensity, 6) AS intensity, rationale, quorum FROM waggles", waggles=_WAGGLES))
def h3(spark, sf_dir):
    return S.waggles(B.hive_events(spark, sf_dir)).select("key", "dances", r6("intensity"), "rationale", "quorum")


@query("h4_stops", sql("hive", "SELECT key, stops, suppressed FROM stops", stops=_STOPS))
def h4(spark, sf_dir):
    return S.stops(B.hive_events(spark, sf_dir)).select("key", "stops", "suppressed")


@query("h4c_stop_reasons", sql("hive", """SELECT key, day, page, string_agg(note, ' | ' ORDER BY ts, event_id) AS reasons FROM (
    SELECT key, ts::DATE AS day, ts, event_id, note, (row_number() OVER (PARTITION BY key, ts::DATE ORDER BY ts, event_id) - 1) // 50 AS page
    FROM hive WHERE kind = 'stop' AND note IS NOT NULL) GROUP BY 1, 2, 3"""))
def h4c(spark, sf_dir):
    """Why patterns were stopped, fifty reasons a row."""
    return S.stop_reasons(B.hive_events(spark, sf_dir))


@query("h4b_stop_weights", sql("hive memories", "SELECT id, hits, round(greatest(0.1, retrieval_weight - 0.3 * hits), 6) AS weight FROM memories JOIN (SELECT target_memory_id AS id, count(*) AS hits FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, event_id) AS n FROM hive WHERE kind = 'stop') WHERE n >= 2 GROUP BY 1) USING (id)"))
def h4b(spark, sf_dir):
    return S.stop_weights(B.hive_events(spark, sf_dir), B.memories(spark, sf_dir)).select("id", "hits", r6("weight"))


@query("h5_nectar", sql("hive", "SELECT key, n, round(confidence, 6) AS confidence, ready FROM nectar", nectar=_NECTAR))
def h5(spark, sf_dir):
    return S.nectar(B.hive_events(spark, sf_dir)).select("key", "n", r6("confidence"), "ready")


@query("h6_crystallise", sql("hive", """SELECT key, signal, CASE signal WHEN 's0' THEN 'teaching' WHEN 's1' THEN 'promise' ELSE 'insight' END AS memory_type, CASE WHEN signal = 's0' THEN 'durable' ELSE 'provisional' END AS status FROM
    (SELECT key, arg_max(signal, (ts, event_id)) AS signal FROM hive WHERE kind = 'nectar' GROUP BY 1) JOIN nectar USING (key) WHERE ready""", nectar=_NECTAR))
def h6(spark, sf_dir):
    e = B.hive_events(spark, sf_dir)
    last = e.where("kind = 'nectar'").groupBy("key").agg(F.max_by("signal", F.struct("ts", "event_id")).alias("signal"))
    return S.crystallised(S.nectar(e).where("ready").join(last, "key"), {"s0": "teaching", "s1": "promise"}).select("key", "signal", "memory_type", "status")


@query("h7_strongest_reads", sql("hive", "(SELECT 'waggle' AS kind, key, round(intensity, 6) AS value FROM waggles ORDER BY intensity DESC, key LIMIT 5) UNION ALL (SELECT 'stop', key, stops FROM stops ORDER BY stops DESC, key LIMIT 5) UNION ALL (SELECT 'honey', key, n FROM nectar ORDER BY n DESC, key LIMIT 5)", waggles=_WAGGLES, stops=_STOPS, nectar=_NECTAR))
def h7(spark, sf_dir):
    e = B.hive_events(spark, sf_dir)
    one = lambda kind, df, v: df.orderBy(F.col(v).desc(), "key").limit(5).select(F.lit(kind).alias("kind"), "key", F.round(F.col(v).cast("double"), 6).alias("value"))
    return one("waggle", S.waggles(e), "intensity").union(one("stop", S.stops(e), "stops")).union(one("honey", S.nectar(e), "n"))


@query("h8_boot_enrichment", sql("hive", f"""SELECT 'emit' AS kind, key, now AS value FROM (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY now DESC, key DESC) AS n FROM (SELECT *, {_NOW} AS now FROM (SELECT * EXCLUDE (n) FROM emits) WHERE expires_at IS NULL OR expires_at > {AS_OF}) WHERE now > 0.1) WHERE n = 1
    UNION ALL SELECT 'quorum', key, dances FROM waggles WHERE quorum UNION ALL SELECT 'suppressed', key, stops FROM stops WHERE suppressed UNION ALL SELECT 'ready', key, n FROM nectar WHERE ready""", emits=_EMITS, waggles=_WAGGLES, stops=_STOPS, nectar=_NECTAR))
def h8(spark, sf_dir):
    e = B.hive_events(spark, sf_dir)
    one = lambda kind, df, v: df.select(F.lit(kind).alias("kind"), "key", F.col(v).cast("double").alias("value"))
    emits = S.strongest_per_signal(S.read_emits(S.active_emits(e), as_of()))
    return one("emit", emits, "now").union(one("quorum", S.waggles(e).where("quorum"), "dances")).union(one("suppressed", S.stops(e).where("suppressed"), "stops")).union(one("ready", S.nectar(e).where("ready"), "n"))


@query("h9_hygiene", sql("hive", f"SELECT 'waggle' AS kind, key FROM waggles WHERE last < {AS_OF} + INTERVAL 300 HOUR - INTERVAL 7 DAY AND NOT quorum UNION ALL SELECT 'stop', key FROM stops WHERE last < {AS_OF} + INTERVAL 300 HOUR - INTERVAL 14 DAY", waggles=_WAGGLES, stops=_STOPS))
def h9(spark, sf_dir):
    e = B.hive_events(spark, sf_dir)
    return S.hygiene(S.waggles(e), S.stops(e), F.lit("2024-02-12 12:00:00").cast("timestamp_ntz"))


_STATE = f"""SELECT * REPLACE (round(ratio, 6) AS ratio, round(criticality, 6) AS criticality), CASE WHEN emits + waggles + patterns = 0 THEN 'cold' WHEN criticality > 0.8 THEN 'optimal' WHEN ratio > 0.7 THEN 'hot' WHEN ratio < 0.3 THEN 'cold' ELSE 'stable' END AS temperature FROM (SELECT *, 1 - 2 * abs(ratio - 0.5) AS criticality FROM (
    SELECT *, CASE WHEN dances + stops > 0 THEN dances / (dances + stops) ELSE 0.5 END AS ratio FROM (SELECT (SELECT count(*) FROM read) AS emits, (SELECT key || ':' || signal FROM read ORDER BY now DESC, key DESC, signal DESC LIMIT 1) AS strongest,
    (SELECT coalesce(sum(dances), 0)::BIGINT FROM waggles) AS dances, (SELECT count(*) FROM waggles) AS waggles, (SELECT count(*) FROM waggles WHERE quorum) AS quorums, (SELECT coalesce(sum(stops), 0)::BIGINT FROM stops) AS stops, (SELECT count(*) FROM stops) AS patterns,
    (SELECT count(*) FROM stops WHERE suppressed) AS suppressed, (SELECT count(*) FROM nectar) AS essences, (SELECT count(*) FROM nectar WHERE ready) AS ready)))"""
_READ = f"SELECT * FROM (SELECT *, {_NOW} AS now FROM (SELECT * EXCLUDE (n) FROM emits) WHERE expires_at IS NULL OR expires_at > {AS_OF}) WHERE now >= 0.05"


def state(spark, sf_dir):
    e = B.hive_events(spark, sf_dir)
    s = S.hive_state(S.read_emits(S.active_emits(e), as_of()), S.waggles(e), S.stops(e), S.nectar(e))
    return s.withColumn("ratio", F.round("ratio", 6)).withColumn("criticality", F.round("criticality", 6))


@query("a22_hive_state", sql("hive", _STATE, emits=_EMITS, read=_READ, waggles=_WAGGLES, stops=_STOPS, nectar=_NECTAR))
def a22(spark, sf_dir):
    """What the hive is like now."""
    return state(spark, sf_dir)


# a log of hourly measurements: what events of the hour, all measurable from the table, say of ratio and temperature
_LOG = """SELECT date_trunc('hour', ts) AS measured_at, round(count(*) FILTER (event_type = 'purchase') / greatest(count(*) FILTER (event_type = 'error'), 1)::DOUBLE, 6) AS waggle_stop_ratio, NULL AS dominant_signal,
    CASE WHEN count(*) >= 20 THEN 'warm' ELSE 'cold' END AS hive_temperature, round(count(*) / 14.0::DOUBLE, 6) AS criticality_score, '{}' AS notes FROM events GROUP BY 1"""


@query("h10_state_log", sql("hive", f"""SELECT * FROM log UNION ALL SELECT {AS_OF}, ratio, strongest, temperature, criticality, '{{"emits":' || emits || ',"waggles":' || waggles || ',"quorums":' || quorums || ',"patterns":' || patterns
    || ',"suppressed":' || suppressed || ',"essences":' || essences || ',"ready":' || ready || '}}' FROM state""", emits=_EMITS, read=_READ, waggles=_WAGGLES, stops=_STOPS, nectar=_NECTAR, state=_STATE, log=_LOG))
def h10(spark, sf_dir):
    """The log of hourly measurements after a snapshot is appended to it, as it is read back."""
    is_ = lambda t: F.count(F.when(F.col("event_type") == t, 1))
    old = table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("measured_at")).agg(
        F.round(is_("purchase") / F.greatest(is_("error"), F.lit(1)), 6).alias("waggle_stop_ratio"), F.lit(None).cast("string").alias("dominant_signal"),
        F.when(F.count(F.lit(1)) >= 20, "warm").otherwise("cold").alias("hive_temperature"), F.round(F.count(F.lit(1)) / 14.0, 6).alias("criticality_score"), F.lit("{}").alias("notes"))
    log = new_path(spark, "state_log")
    old.write.parquet(log)
    S.snapshot(state(spark, sf_dir), as_of()).write.mode("append").parquet(log)
    return spark.read.parquet(log)


LIMITS = ((3600, 3), (600, 2))
# request by request: whether it passes depends on those that have
_ADMITTED = "SELECT event_id, identity, allowed FROM steps WHERE n > 0"
_STEPS = dict(
    numbered="SELECT identity, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY identity ORDER BY ts, event_id) AS n FROM audit",
    steps=f"""SELECT DISTINCT identity, 0::BIGINT AS n, NULL::BIGINT AS event_id, []::BIGINT[] AS log, false AS allowed FROM numbered UNION ALL
    SELECT identity, n, event_id, CASE WHEN ok THEN list_append(log, us) ELSE log END, ok FROM (SELECT r.*, list_filter(s.log, lambda t: r.us - t < {LIMITS[0][0]}000000) AS log,
        {' AND '.join(f'len(list_filter(s.log, lambda t: r.us - t < {s}000000)) < {n}' for s, n in LIMITS)} AS ok FROM steps s JOIN numbered r ON r.identity = s.identity AND r.n = s.n + 1)""",
)


@query("h11_rate_limit", recursive(sql("audit", _ADMITTED, **_STEPS)))
def h11(spark, sf_dir):
    """Two limits of the last hour and ten minutes, scaled to this log."""
    return S.rate_limited(B.audit_log(spark, sf_dir).select("identity", "ts", "event_id"), LIMITS)


@query("h11c_rate_limit_stream", recursive(sql("audit", _ADMITTED, **_STEPS)))
def h11c(spark, sf_dir):
    """The same requests as a stream that brings them out of order and is started anew four times."""
    from ..streaming import replay_stream as Z

    log = B.audit_log(spark, sf_dir).select("identity", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    got = Z.arrived(log, "event_id", (-1, datetime(2100, 1, 1), -1), lambda rows: Z.admissions(rows, LIMITS, "12 hours"), new_path(spark, "admissions"))
    return got.where("event_id >= 0")


@query("h11b_raw_demand", sql("audit", "SELECT identity, event_id, count(*) OVER (PARTITION BY identity ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS recent FROM audit"))
def h11b(spark, sf_dir):
    """Requests of the last hour, admitted or not."""
    return S.recent_counts(B.audit_log(spark, sf_dir), 3600).select("identity", "event_id", "recent")


@query("h12_cooldown", sql("audit", "SELECT identity, event_id, recent, ts + INTERVAL 300 SECOND AS until FROM (SELECT *, count(*) OVER (PARTITION BY identity ORDER BY ts RANGE BETWEEN INTERVAL 86400 SECOND PRECEDING AND CURRENT ROW) AS recent FROM audit WHERE response_code >= 400) WHERE recent >= 10"))
def h12(spark, sf_dir):
    """Ten refusals within a day."""
    return S.cooldowns(B.audit_log(spark, sf_dir), 10, 86400, 300)


@query("h13_since_watermark", sql("hive", "SELECT event_id, kind FROM hive WHERE event_id > 9000"))
def h13(spark, sf_dir):
    """What came after an id: the filter reaches the scan."""
    return B.hive_events(spark, sf_dir).where("event_id > 9000").select("event_id", "kind")


@query("h14_ring_history", """SELECT memory_id, round(least(1.0, 0.5 + 0.1 * (pushes - 1))::DOUBLE, 6) AS activation FROM (SELECT event_id * 7 % 50 AS memory_id, count(*) AS pushes, max(ts) AS last FROM events WHERE event_type = 'view' GROUP BY 1 ORDER BY last DESC, memory_id LIMIT 30)""")
def h14(spark, sf_dir):
    return S.ring_after(pushes(spark, sf_dir)).select("memory_id", r6("activation"))


def pushes(spark, sf_dir):
    """Twenty rings, each of which sees more memories than it holds."""
    return table(spark, sf_dir, "events").where("event_type = 'view'").select((F.col("event_id") * 7 % 50).alias("memory_id"), "ts", (F.col("user_id") % 20).alias("ring"))


# push by push: which slot gives way depends on all pushes before
_RINGS = "SELECT ring, x.m AS memory_id, round(x.a, 6) AS activation, make_timestamp(x.t) AS last_activated_at FROM (SELECT ring, unnest(slots) AS x FROM (SELECT *, row_number() OVER (PARTITION BY ring ORDER BY n DESC) AS place FROM pushed) WHERE place = 1)"
_PUSHED = dict(
    numbered="SELECT *, row_number() OVER (PARTITION BY ring ORDER BY us, memory_id) AS n FROM (SELECT event_id * 7 % 50 AS memory_id, user_id % 20 AS ring, epoch_us(ts) AS us FROM events WHERE event_type = 'view')",
    pushed="""SELECT DISTINCT ring, 0::BIGINT AS n, []::STRUCT(m BIGINT, a DOUBLE, t BIGINT)[] AS slots FROM numbered UNION ALL
    SELECT ring, n, CASE WHEN list_contains(list_transform(slots, lambda x: x.m), memory_id)
        THEN list_transform(slots, lambda x: CASE WHEN x.m = memory_id THEN {'m': x.m, 'a': least(1.0::DOUBLE, x.a + 0.1), 't': us} ELSE x END)
        ELSE list_append(list_filter(slots, lambda x: len(slots) < 30 OR x.m <> list_sort(list_transform(slots, lambda y: {'e': y.a * 0.5::DOUBLE / (1 + (us - y.t) / 86400e6), 'm': y.m}))[1].m), {'m': memory_id, 'a': 0.5::DOUBLE, 't': us}) END
    FROM (SELECT r.*, p.slots FROM pushed p JOIN numbered r ON r.ring = p.ring AND r.n = p.n + 1)""",
)


@query("h14b_ring_replay", recursive(sql("", _RINGS, **_PUSHED)))
def h14b(spark, sf_dir):
    """Every ring, replayed push by push."""
    return S.ring_replayed(pushes(spark, sf_dir)).withColumn("activation", F.round("activation", 6))


@query("h14c_ring_stream", recursive(sql("", _RINGS, **_PUSHED)))
def h14c(spark, sf_dir):
    """The same rings from a stream that goes on where the batch replay of the month's first half ends."""
    from ..streaming import replay_stream as Z

    every = pushes(spark, sf_dir)
    half = "ts < TIMESTAMP_NTZ '2024-01-16 00:00:00'"
    rest = every.where(f"NOT {half}").select("ring", F.col("ts").cast("timestamp").alias("ts"), "memory_id")
    start = S.ring_replayed(every.where(half))
    start = written(start, "rings")
    got = Z.arrived(rest, "memory_id", (-1, datetime(2100, 1, 1), -1), lambda rows: Z.rings(rows, "12 hours", 30, start), new_path(spark, "rings")).where("ring >= 0")
    now = Z.newest_rings(got)
    quiet = start.join(now.select("ring").distinct(), "ring", "left_anti").select("ring", "memory_id", "activation", "last_activated_at")  # rings without a later push
    return now.withColumn("last_activated_at", F.col("last_activated_at").cast("timestamp_ntz")).unionByName(quiet).withColumn("activation", F.round("activation", 6))


@query("h15_session_counters", sql("sessions", "SELECT user_id, day, boot_ran, exchanges_stored, heartbeats_sent, tool_calls_total, started_at FROM sessions"))
def h15(spark, sf_dir):
    return B.sessions(spark, sf_dir).select("user_id", "day", "boot_ran", "exchanges_stored", "heartbeats_sent", "tool_calls_total", "started_at")


@query("w9_oldest_retired", sql("hive", f"""SELECT 'emit' AS kind, key, event_id FROM (SELECT *, row_number() OVER (ORDER BY ts DESC, event_id) AS place FROM (
    SELECT *, row_number() OVER (PARTITION BY key, signal ORDER BY ts DESC, event_id DESC) AS n FROM hive WHERE kind = 'emit') WHERE n = 1) WHERE place > 10
    UNION ALL SELECT 'waggle', key, NULL FROM ({_RANKED}) WHERE NOT quorum AND n > 20 - q"""))
def w9(spark, sf_dir):
    """What the caps on emits and topics retire."""
    return S.retired(B.hive_events(spark, sf_dir))


@query("w10_recorded_calls", """SELECT user_id, bucket, count(*) AS calls, string_agg(event_type, ',' ORDER BY ts, event_id) AS tools FROM (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 4 AS bucket FROM events) GROUP BY 1, 2 HAVING count(*) = 4""")
def w10(spark, sf_dir):
    """A record for every four calls of a user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("bucket", F.floor((F.row_number().over(w) - 1) / 4))
    names = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"]), ",")
    return e.groupBy("user_id", "bucket").agg(F.count(F.lit(1)).alias("calls"), names.alias("tools")).where("calls = 4")


@query("s7_pending_signals", sql("hive", "SELECT kind, event_id % 3 AS batch, count(*) AS n, sum(event_id)::BIGINT AS ids, count(note) AS notes FROM hive GROUP BY 1, 2"))
def s7(spark, sf_dir):
    """The pending log after three batches of all signals, each delivered twice, as it is read back."""
    from ..sources import exports
    from ..streaming.hive_stream import SIGNAL

    log = new_path(spark, "pending")
    signals = B.hive_events(spark, sf_dir)
    for batch in (0, 1, 0, 2, 1, 2):
        exports.append_signals(signals.where(F.col("event_id") % 3 == batch), log, batch)
    return exports.read_signals(spark, log, SIGNAL).groupBy("kind", "batch").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"), F.count("note").alias("notes"))
