"""Daily rollups, drift, tendencies and sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import affect as A
from ..operators import retrieval as R
from ..operators import rollups as D
from ..operators import tables as T
from ..sources import bridge as B
from ..workspace import new_path
from .catalog import query
from .oracle import AS_OF, sql

TODAY, SINCE = "2024-01-31", "2023-11-02"  # and ninety days before
r6 = lambda c: F.round(c, 6).alias(c)
_ROWS = "SELECT m.*, created_at::DATE AS date, valence, arousal, e1, w1, e2, w2 FROM memories m LEFT JOIN latest a ON a.memory_id = m.id"
_DAILY = "SELECT date, count(*) AS memory_count, avg(valence) AS valence_mean, avg(arousal) AS arousal_mean FROM affected GROUP BY 1"


def rows(spark, sf_dir):
    return D.with_affect(B.memories(spark, sf_dir), B.affect(spark, sf_dir))


def daily(spark, sf_dir):
    return D.daily_context(B.memories(spark, sf_dir), B.affect(spark, sf_dir))


_CONTEXT = sql("memories latest", """SELECT d.date, memory_count, round(valence_mean, 6) AS valence_mean, round(arousal_mean, 6) AS arousal_mean, types FROM daily d
    JOIN (SELECT date, string_agg(memory_type || ':' || n, ',' ORDER BY memory_type || ':' || n) AS types FROM (SELECT date, memory_type, count(*) AS n FROM affected GROUP BY 1, 2) GROUP BY 1) t ON t.date = d.date""", affected=_ROWS, daily=_DAILY)


@query("a6_daily_context", _CONTEXT)
def a6(spark, sf_dir):
    return daily(spark, sf_dir).select("date", "memory_count", r6("valence_mean"), r6("arousal_mean"), "types")


@query("a6c_daily_context_stream", _CONTEXT)
def a6c(spark, sf_dir):
    """The same days from a stream of changes, some of which take back before what they take back has come."""
    from ..streaming import daily_stream as Z

    arrived, out = new_path(spark, "changes"), new_path(spark, "daily")
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    Z.changes(B.memories(spark, sf_dir), B.affect(spark, sf_dir)).repartition(files, "id", "change").write.parquet(arrived)
    Z.keep_daily(Z.read_changes(spark, arrived, max(1, files // 4)), out, new_path(spark, "progress")).awaitTermination()
    return Z.context(Z.kept(spark, out)).select("date", "memory_count", r6("valence_mean"), r6("arousal_mean"), "types")


@query("a6b_hourly_arc", sql("memories latest", "SELECT date, hour(created_at) AS hour, round(avg(valence), 6) AS valence_mean, count(*) AS n FROM affected WHERE valence IS NOT NULL GROUP BY 1, 2", affected=_ROWS))
def a6b(spark, sf_dir):
    return D.hourly_arc(B.memories(spark, sf_dir), B.affect(spark, sf_dir)).select("date", "hour", r6("valence_mean"), "n")


_SUMS = "SELECT date, emotion, sum(w) AS total FROM affected m JOIN latest_chords c ON c.memory_id = m.id WHERE status = 'durable' GROUP BY 1, 2"


@query("a7_daily_emotions", sql("memories latest_chords", f"SELECT date, rank, emotion, round(total, 6) AS total FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY round(total, 6) DESC, emotion) AS rank FROM sums WHERE date BETWEEN DATE '2024-01-24' AND DATE '{TODAY}') WHERE rank <= 5", affected=_ROWS, sums=_SUMS))
def a7(spark, sf_dir):
    return D.daily_emotions(B.memories(spark, sf_dir), B.affect(spark, sf_dir), "2024-01-24", TODAY).select("date", "rank", "emotion", r6("total"))


@query("a8_top_emotions", sql("memories latest_chords", "SELECT emotion, round(sum(w), 6) AS total FROM affected m JOIN latest_chords c ON c.memory_id = m.id WHERE source_type = 'exchange' GROUP BY 1 ORDER BY round(sum(w), 6) DESC, emotion LIMIT 3", affected=_ROWS))
def a8(spark, sf_dir):
    return D.top_emotions(D.emotion_sums(rows(spark, sf_dir).where("source_type = 'exchange'")), 3).select("emotion", r6("total"))


@query("a9_drift", sql("memories latest", f"""SELECT *, round(short_mean - long_mean, 3) AS drift, abs(round(short_mean - long_mean, 3)) > 0.15 AS alert FROM (SELECT round(avg(valence_mean) FILTER (age <= 90), 3) AS long_mean, round(avg(valence_mean) FILTER (age <= 7), 3) AS short_mean,
    count(valence_mean) FILTER (age <= 90) AS long_days, count(valence_mean) FILTER (age <= 7) AS short_days FROM (SELECT *, datediff('day', date, DATE '{TODAY}') AS age FROM daily) WHERE age >= 0) WHERE long_days >= 7 AND short_days >= 3""", affected=_ROWS, daily=_DAILY))
def a9(spark, sf_dir):
    return D.drift(daily(spark, sf_dir), "valence_mean", TODAY)


_EXCHANGES = f"SELECT * FROM affected WHERE source_type = 'exchange' AND status = 'durable' AND created_at >= {AS_OF} - INTERVAL 30 DAY ORDER BY created_at DESC, id LIMIT 200"


def recent_exchanges(spark, sf_dir):
    """The last 200 durable exchanges of 30 days."""
    some = rows(spark, sf_dir).where(f"source_type = 'exchange' AND status = 'durable' AND created_at >= TIMESTAMP_NTZ '{TODAY} 00:00:00' - INTERVAL 30 DAYS")
    return some.orderBy(F.col("created_at").desc(), "id").limit(200)


_CARE = f"SELECT avg(valence) AS valence FROM affected WHERE source_type = 'exchange' AND status = 'durable' AND created_at >= {AS_OF} - INTERVAL 3 DAY"


def care(spark, sf_dir):
    """Mean valence of the durable exchanges of three days."""
    some = rows(spark, sf_dir).where(f"source_type = 'exchange' AND status = 'durable' AND created_at >= TIMESTAMP_NTZ '{TODAY} 00:00:00' - INTERVAL 3 DAYS")
    return some.agg(F.avg("valence").alias("valence"))


@query("a10_tendencies", sql("memories latest_chords", """SELECT metric, round(ratio, 6) AS ratio, alert FROM (
    SELECT 'high_arousal' AS metric, avg((coalesce(arousal, 0) > 0.6)::INT) AS ratio, count(*) > 10 AND avg((coalesce(arousal, 0) > 0.6)::INT) > 0.4 AS alert, count(*) AS n FROM picked
    UNION ALL SELECT 'low_valence', avg((coalesce(valence, 0) < -0.2)::INT), count(*) > 10 AND avg((coalesce(valence, 0) < -0.2)::INT) > 0.3, count(*) FROM picked
    UNION ALL (SELECT 'emotion ' || emotion, count(*) / (SELECT count(*) FROM picked), NULL, (SELECT count(*) FROM picked) FROM picked s JOIN latest_chords c ON c.memory_id = s.id WHERE w > 0.3 GROUP BY emotion ORDER BY count(*) DESC, emotion LIMIT 5))
    WHERE n >= 5 AND (metric NOT LIKE 'emotion%' OR ratio > 0.3)""", affected=_ROWS, picked=_EXCHANGES))
def a10(spark, sf_dir):
    return D.tendencies(recent_exchanges(spark, sf_dir)).select("metric", r6("ratio"), "alert")


_LATELY = f"SELECT * FROM memories WHERE status = 'durable' AND created_at >= {AS_OF} - INTERVAL 7 DAY"
_GROWTH = f"""SELECT (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM edges WHERE created_at >= {AS_OF} - INTERVAL 7 DAY) AS new_edges,
    (SELECT count(*) FROM memories WHERE memory_type = 'insight' AND status <> 'rejected') AS insights,
    (SELECT count(*) FROM memories WHERE memory_type = 'insight' AND status <> 'rejected' AND created_at >= {AS_OF} - INTERVAL 7 DAY) AS new_insights, *, NOT one_sided AND has_journal AND has_teaching AS healthy FROM (
    SELECT avg((source_type = 'exchange')::INT) AS exchange_share, coalesce(avg((source_type = 'exchange')::INT) > 0.9, false) AND count(*) FILTER (source_type = 'journal') = 0 AS one_sided,
    count(*) FILTER (source_type = 'journal') > 0 AS has_journal, count(*) FILTER (source_type = 'teaching') > 0 AS has_teaching, count(DISTINCT source_type) AS kinds FROM lately)"""


def growth(spark, sf_dir):
    return D.growth(B.memories(spark, sf_dir), B.edges(spark, sf_dir), F.lit(f"{TODAY} 00:00:00").cast("timestamp_ntz"))


@query("a11_growth", sql("memories edges", "SELECT edges, new_edges, insights, new_insights, round(exchange_share, 6) AS exchange_share, one_sided, healthy, kinds FROM growth", lately=_LATELY, growth=_GROWTH))
def a11(spark, sf_dir):
    return growth(spark, sf_dir).withColumn("exchange_share", F.round("exchange_share", 6))


@query("a12_care_alert", sql("memories latest", "SELECT round(valence, 6) AS valence, valence < -0.15 AS alert FROM care", affected=_ROWS, care=_CARE))
def a12(spark, sf_dir):
    return care(spark, sf_dir).select(r6("valence"), (F.col("valence") < -0.15).alias("alert"))


@query("w1_daily_deltas", sql("memories latest", "SELECT date, round(delta, 6) AS delta FROM (SELECT date, valence_mean - lag(valence_mean) OVER (ORDER BY date) AS delta FROM daily WHERE memory_count > 0) WHERE delta IS NOT NULL", affected=_ROWS, daily=_DAILY))
def w1(spark, sf_dir):
    return D.deltas(daily(spark, sf_dir), "valence_mean").select("date", r6("delta"))


_RUNS = """SELECT rising, min(date) AS start, max(date) AS "end", count(*) AS length, round(sum(delta), 6) AS shift, round(least(0.8, 0.3 + 0.08 * count(*) + 0.3 * abs(sum(delta))), 6) AS confidence FROM (
    SELECT *, delta > 0 AS rising, row_number() OVER (ORDER BY date) - row_number() OVER (PARTITION BY delta > 0 ORDER BY date) AS island FROM (SELECT date, {v} - lag({v}) OVER (ORDER BY date) AS delta FROM days) WHERE delta IS NOT NULL) GROUP BY rising, island HAVING count(*) >= {n}"""
# ninety days, five of them at least
_DAYS = f"SELECT * FROM (SELECT *, count(*) OVER () AS n FROM daily WHERE memory_count > 0 AND date >= DATE '{TODAY}' - 90) WHERE n >= 5"


@query("w2_monotone_runs", sql("memories latest", _RUNS.format(v="valence_mean", n=3), affected=_ROWS, daily=_DAILY, days=_DAYS))
def w2(spark, sf_dir):
    return runs(spark, sf_dir).select("rising", "start", "end", "length", r6("shift"), r6("confidence"))


def runs(spark, sf_dir):
    return D.monotone_runs(daily(spark, sf_dir), "valence_mean", 3, SINCE)


_DOMINANT = "SELECT date, emotion FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY round(total, 6) DESC, emotion) AS rank FROM sums) WHERE rank = 1"
_BIGRAMS = """SELECT first, second, count(*) AS n, least(0.9, 0.4 + 0.05 * count(*))::DOUBLE AS confidence FROM (SELECT a.emotion AS first, b.emotion AS second FROM (SELECT *, row_number() OVER (ORDER BY date) AS i FROM dominant) a
    JOIN (SELECT *, row_number() OVER (ORDER BY date) AS i FROM dominant) b ON b.i > a.i AND b.i <= a.i + 3 WHERE a.emotion <> b.emotion) GROUP BY 1, 2 HAVING count(*) >= 3 ORDER BY n DESC, first, second LIMIT 20"""


def dominants(spark, sf_dir):
    durable = rows(spark, sf_dir).where("status = 'durable'")
    return D.top_emotions(D.emotion_sums(durable, "date"), 1, "date").select("date", "emotion")


@query("w3_emotion_bigrams", sql("memories latest_chords", _BIGRAMS, affected=_ROWS, sums=_SUMS, dominant=_DOMINANT))
def w3(spark, sf_dir):
    return D.bigrams(dominants(spark, sf_dir)).select("first", "second", "n", r6("confidence"))


@query("w4_trend_labels", sql("memories latest", """SELECT date, CASE WHEN p IS NULL THEN 'new' WHEN valence_mean - p > 0.05 THEN 'rising' WHEN valence_mean - p < -0.05 THEN 'falling' ELSE 'stable' END AS trend FROM (SELECT *, lag(valence_mean) OVER (ORDER BY date) AS p FROM daily)""", affected=_ROWS, daily=_DAILY))
def w4(spark, sf_dir):
    v = F.col("valence_mean")
    return daily(spark, sf_dir).withColumn("p", F.lag(v).over(D.in_order())).select("date", D.trend(F.col("p"), v).alias("trend"))


@query("k5_dream", sql("memories latest_chords", """SELECT count(*) AS n, round(avg(valence), 6) AS valence, CASE WHEN avg(valence) > 0.7 THEN 'warm' WHEN avg(valence) > 0.3 THEN 'steady' WHEN avg(valence) > -0.2 THEN 'mixed' ELSE 'heavy' END AS tone,
    (SELECT string_agg(emotion, ',' ORDER BY t DESC, emotion) FROM (SELECT emotion, round(sum(w), 6) AS t FROM picked s JOIN latest_chords c ON c.memory_id = s.id GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3)) AS emotions FROM picked HAVING count(*) >= 3""", affected=_ROWS,
    picked="SELECT * FROM affected WHERE date = DATE '2024-01-29' AND status IN ('durable', 'provisional') ORDER BY created_at DESC, id LIMIT 20"))
def k5(spark, sf_dir):
    some = rows(spark, sf_dir).where("date = DATE '2024-01-29' AND status IN ('durable', 'provisional')")
    return D.dream(some).select("n", r6("valence"), "tone", "emotions")


@query("a15_compliance_averages", sql("sessions", """SELECT count(*) AS n, round(avg(score), 4) AS score, round(avg(boot_ran::INT) * 100, 4) AS boot_rate, round(avg(exchanges_stored), 4) AS exchanges, avg(boot_ran::INT) < 0.6 AS warning FROM (SELECT *, least(1.0, CASE WHEN boot_ran THEN 0.4 ELSE 0 END + CASE WHEN timestamp_logged THEN 0.1 ELSE 0 END
    + CASE WHEN exchanges_stored >= 1 THEN 0.3 ELSE 0 END + CASE WHEN exchanges_stored >= 3 THEN 0.1 ELSE 0 END + CASE WHEN heartbeats_sent >= 1 THEN 0.1 ELSE 0 END)::DOUBLE AS score FROM sessions ORDER BY started_at DESC, user_id LIMIT 50)"""))
def a15(spark, sf_dir):
    """Of the last fifty sessions (Q14)."""
    s = B.sessions(spark, sf_dir).orderBy(F.col("started_at").desc(), "user_id").limit(50)
    score = A.compliance("boot_ran", "timestamp_logged", "exchanges_stored", "heartbeats_sent")
    boot = F.avg(F.col("boot_ran").cast("int"))
    return s.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(score), 4).alias("score"), F.round(boot * 100, 4).alias("boot_rate"), F.round(F.avg("exchanges_stored"), 4).alias("exchanges"), (boot < 0.6).alias("warning"))


def latest(spark, sf_dir):
    return R.latest_affect(B.affect(spark, sf_dir))
