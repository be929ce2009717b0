"""Daily rollups and what is mined from their sequence. Rollups have one row a day, so windows over them are small."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import retrieval as R
from . import tables as T

def in_order():
    return Window.orderBy("date")


def with_affect(memories: DataFrame, affect: DataFrame) -> DataFrame:
    """Memories with their latest affect, and the date."""
    a = R.latest_affect(affect).select(F.col("memory_id").alias("id"), "valence", "arousal", "emotions")
    return memories.join(a, "id", "left").withColumn("date", F.to_date("created_at"))


def daily_context(memories: DataFrame, affect: DataFrame) -> DataFrame:
    """Of each day, all statuses: count, mean valence and arousal (null if there is none), and counts by type as text."""
    rows = with_affect(memories, affect)
    by_type = rows.groupBy("date", "memory_type").agg(F.count(F.lit(1)).alias("n"), F.sum("valence").alias("v"), F.count("valence").alias("nv"), F.sum("arousal").alias("a"), F.count("arousal").alias("na"))
    types = F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "memory_type", "n"))), ",")
    return by_type.groupBy("date").agg(F.sum("n").alias("memory_count"), (F.sum("v") / F.sum("nv")).alias("valence_mean"), (F.sum("a") / F.sum("na")).alias("arousal_mean"), types.alias("types"))


def hourly_arc(memories: DataFrame, affect: DataFrame) -> DataFrame:
    rows = with_affect(memories, affect).where("valence IS NOT NULL")
    return rows.groupBy("date", F.hour("created_at").cast("bigint").alias("hour")).agg(F.avg("valence").alias("valence_mean"), F.count(F.lit(1)).alias("n"))


def emotion_sums(rows: DataFrame, *keys: str) -> DataFrame:
    """Chord weights summed by emotion."""
    return rows.select(*keys, F.explode("emotions").alias("emotion", "w")).groupBy(*keys, "emotion").agg(F.sum("w").alias("total"))


def top_emotions(sums: DataFrame, k: int, *keys: str) -> DataFrame:
    w = Window.partitionBy(*(keys or (F.lit(1),))).orderBy(F.round("total", 6).desc(), "emotion")  # emotions are few
    return sums.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)


def daily_emotions(memories: DataFrame, affect: DataFrame, since: str, until: str, k: int = 5) -> DataFrame:
    """The strongest emotions of each day, durable memories only."""
    rows = with_affect(memories.where("status = 'durable'"), affect).where((F.col("date") >= F.lit(since).cast("date")) & (F.col("date") <= F.lit(until).cast("date")))
    return top_emotions(emotion_sums(rows, "date"), k, "date")


def deltas(daily: DataFrame, value: str) -> DataFrame:
    """Differences between consecutive rows of days with memories, whatever the calendar says."""
    return daily.where("memory_count > 0").withColumn("delta", F.col(value) - F.lag(value).over(in_order())).where("delta IS NOT NULL")


def monotone_runs(daily: DataFrame, value: str, least: int = 3, since: str | None = None, days: int = 5) -> DataFrame:
    """Runs of ``least`` or more deltas of one sign (zero counts as falling) from the date ``since`` on: gaps and islands. None
    if there are fewer than ``days`` days."""
    daily = daily.where("memory_count > 0")
    if since:
        daily = daily.where(F.col("date") >= F.lit(since).cast("date"))
    daily = daily.withColumn("_days", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))).where(F.col("_days") >= days).drop("_days")  # a row a day
    d = deltas(daily, value).withColumn("rising", F.col("delta") > 0)
    by_sign = Window.partitionBy("rising").orderBy("date")
    d = d.withColumn("island", F.row_number().over(in_order()) - F.row_number().over(by_sign))
    runs = d.groupBy("rising", "island").agg(F.min("date").alias("start"), F.max("date").alias("end"), F.count(F.lit(1)).alias("length"), F.sum("delta").alias("shift")).where(F.col("length") >= least)
    return runs.withColumn("confidence", F.least(F.lit(0.8), 0.3 + 0.08 * F.col("length") + 0.3 * F.abs("shift"))).drop("island")


def bigrams(dominant: DataFrame, reach: int = 3, least: int = 3, most: int = 20) -> DataFrame:
    """Ordered pairs of different emotions (date, emotion) at most ``reach`` rows apart."""
    rows = dominant.withColumn("later", F.array(*[F.lead("emotion", i).over(in_order()) for i in range(1, reach + 1)]))
    pairs = rows.select(F.col("emotion").alias("first"), F.explode("later").alias("second")).where("second IS NOT NULL AND first <> second")
    out = T.counts(pairs, "first", "second").where(F.col("n") >= least)
    return out.orderBy(F.col("n").desc(), "first", "second").limit(most).withColumn("confidence", F.least(F.lit(0.9), 0.4 + 0.05 * F.col("n")))


def drift(daily: DataFrame, value: str, today: str, long: int = 90, short: int = 7) -> DataFrame:
    """Mean of daily means over a long and a short time back; needs seven and three days; an alert beyond 0.15."""
    age = F.datediff(F.lit(today).cast("date"), "date")
    mean = lambda n: F.round(F.avg(F.when(age <= n, F.col(value))), 3)
    days = lambda n: F.count(F.when((age <= n) & F.col(value).isNotNull(), 1))
    out = daily.where(age >= 0).agg(mean(long).alias("long_mean"), mean(short).alias("short_mean"), days(long).alias("long_days"), days(short).alias("short_days"))
    out = out.where("long_days >= 7 AND short_days >= 3").withColumn("drift", F.round(F.col("short_mean") - F.col("long_mean"), 3))
    return out.withColumn("alert", F.abs("drift") > 0.15)


def tendencies(rows: DataFrame) -> DataFrame:
    """Shares among ``rows`` (id, valence, arousal, emotions): of strong emotions (five at most, over 0.3), and of high arousal and
    low valence with their alerts. Nothing below five rows; alerts need more than ten."""
    n = F.count(F.lit(1))
    share = lambda c: F.count(F.when(c, 1)) / n
    whole = rows.agg(n.alias("n"), share(F.col("arousal") > 0.6).alias("high"), share(F.col("valence") < -0.2).alias("low"))
    pairs = F.array(F.struct(F.lit("high_arousal").alias("metric"), F.col("high").alias("ratio"), ((F.col("n") > 10) & (F.col("high") > 0.4)).alias("alert")),
                    F.struct(F.lit("low_valence").alias("metric"), F.col("low").alias("ratio"), ((F.col("n") > 10) & (F.col("low") > 0.3)).alias("alert")))
    two = whole.where("n >= 5").select(F.explode(pairs).alias("p")).select("p.*")
    strong = rows.select("id", F.explode("emotions").alias("emotion", "w")).where("w > 0.3").groupBy("emotion").agg(F.count(F.lit(1)).alias("k"))
    strong = strong.orderBy(F.col("k").desc(), "emotion").limit(5).union(whole.select(F.lit(None).cast("string"), "n"))
    n_rows = F.max(F.when(F.col("emotion").isNull(), F.col("k"))).over(Window.partitionBy(F.lit(1)))  # six rows
    strong = strong.withColumn("n", n_rows).where("emotion IS NOT NULL AND n >= 5").withColumn("ratio", F.col("k") / F.col("n")).where("ratio > 0.3")
    return two.union(strong.select(F.concat(F.lit("emotion "), "emotion"), "ratio", F.lit(None).cast("boolean")))


def growth(memories: DataFrame, edges: DataFrame, as_of, days: int = 7) -> DataFrame:
    """One row: edges and insights in all and of the last ``days``; of the durable memories of these days the share of exchanges,
    whether they are nearly all of it without a journal, whether journals and teachings are there too, and the number of kinds."""
    recent = F.col("created_at") >= as_of - F.make_dt_interval(F.lit(days))
    insight = (F.col("memory_type") == "insight") & (F.col("status") != "rejected")
    lately = recent & (F.col("status") == "durable")
    kind = lambda k: T.count_if(lately & (F.col("source_type") == k))
    m = memories.agg(T.count_if(insight).alias("insights"), T.count_if(insight & recent).alias("new_insights"), T.count_if(lately).alias("_all"), kind("exchange").alias("_exchanges"),
                     kind("journal").alias("_journals"), kind("teaching").alias("_teachings"), F.count_distinct(F.when(lately, F.col("source_type"))).alias("kinds"))
    m = m.withColumn("exchange_share", F.col("_exchanges") / F.when(F.col("_all") > 0, F.col("_all")))
    one_sided = F.coalesce((F.col("exchange_share") > 0.9) & (F.col("_journals") == 0), F.lit(False))
    m = m.withColumn("one_sided", one_sided).withColumn("healthy", ~F.col("one_sided") & (F.col("_journals") > 0) & (F.col("_teachings") > 0))
    return T.side_by_side(m.select("insights", "new_insights", "exchange_share", "one_sided", "healthy", "kinds"), edges.agg(F.count(F.lit(1)).alias("edges"), T.count_if(recent).alias("new_edges")))


def trend(previous, current):
    """Label of a value against the one before it."""
    step = current - previous
    return F.when(previous.isNull(), "new").when(step > 0.05, "rising").when(step < -0.05, "falling").otherwise("stable")


def dream(rows: DataFrame, limit: int = 20) -> DataFrame:
    """One row of a day's newest memories: three strongest emotions, mean valence and its tone; none below three rows."""
    some = rows.orderBy(F.col("created_at").desc(), "id").limit(limit)
    one = some.agg(F.count(F.lit(1)).alias("n"), F.avg("valence").alias("valence"))
    top = top_emotions(emotion_sums(some), 3).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "emotion"))), lambda x: x["emotion"]), ",").alias("emotions"))
    tone = F.when(F.col("valence") > 0.7, "warm").when(F.col("valence") > 0.3, "steady").when(F.col("valence") > -0.2, "mixed").otherwise("heavy")
    return T.side_by_side(one, top).where("n >= 3").withColumn("tone", tone)
