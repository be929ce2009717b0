"""Daily contexts kept up to date as memories arrive: sums by day, hour and type that merge, in a table of one folder a day and batch.

A batch adds its sums to those of the days it touches and writes these days anew under its own number; a batch that is delivered
again writes the same folders from the same earlier ones. Days it doesn't touch keep their files. Rows may be of any age and come
in any order: sums need no watermark, and what is kept grows with days, hours and types, not with memories.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: A change: a memory as it now is (1) or as it no longer is (-1). Days of a null ``created_at`` are null.
CHANGE = "id bigint, created_at timestamp_ntz, memory_type string, valence double, arousal double, change int"
_KEYS, _SUMS = ("date", "hour", "memory_type"), ("n", "v", "nv", "a", "na")
_TABLE = "date date, batch bigint, hour bigint, memory_type string, n bigint, v double, nv bigint, a double, na bigint"


def changes(memories: DataFrame, affect: DataFrame) -> DataFrame:
    """Changes that lead to all memories with their latest affect: a memory without affect is added once; each affect adds its
    memory and takes away what the affect before it had added. One shuffle, by memory."""
    order = Window.partitionBy("memory_id").orderBy("computed_at", F.col("model").desc())
    a = affect.select("memory_id", F.struct("valence", "arousal").alias("now"), F.lag(F.struct("valence", "arousal")).over(order).alias("before"))
    rows = memories.select("id", "created_at", "memory_type").join(a, F.col("id") == F.col("memory_id"), "left")
    one = lambda c, n: F.struct(F.col(c)["valence"].alias("valence"), F.col(c)["arousal"].alias("arousal"), F.lit(n).alias("change"))
    both = F.when(F.col("before").isNull(), F.array(one("now", 1))).otherwise(F.array(one("now", 1), one("before", -1)))
    return rows.select("id", "created_at", "memory_type", F.explode(both).alias("c")).select("id", "created_at", "memory_type", "c.*")


def partials(rows: DataFrame) -> DataFrame:
    """Sums of changes by day, hour and type."""
    n = F.col("change")
    some = lambda c: F.sum(F.when(F.col(c).isNotNull(), n).otherwise(0))
    keys = rows.withColumn("date", F.to_date("created_at")).withColumn("hour", F.hour("created_at").cast("bigint"))
    total = lambda c: F.coalesce(F.sum(F.col(c) * n), F.lit(0.0))
    return keys.groupBy(*_KEYS).agg(F.sum(n).alias("n"), total("valence").alias("v"), some("valence").alias("nv"), total("arousal").alias("a"), some("arousal").alias("na"))


def _folders(spark: SparkSession, out: str) -> list[tuple[str, int, object]]:
    """(day's folder, batch, path) of the table: a few for each day."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/date=*/batch=*")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return [(s.getPath().getParent().getName(), int(s.getPath().getName().removeprefix("batch=")), s.getPath()) for s in found or []]


def kept(spark: SparkSession, out: str, before: int | None = None) -> DataFrame:
    """The sums of every day by its last batch, or its last one below ``before``; empty if there is none."""
    if not _folders(spark, out):
        return spark.createDataFrame([], _TABLE)
    rows = spark.read.schema(_TABLE).option("basePath", out).parquet(out)
    if before is not None:
        rows = rows.where(F.col("batch") < before)
    last = rows.groupBy(F.col("date").alias("_day")).agg(F.max("batch").alias("_last"))
    return rows.join(F.broadcast(last), F.col("date").eqNullSafe(F.col("_day")) & (F.col("batch") == F.col("_last"))).drop("_day", "_last")  # a row a day


def merge_batch(rows: DataFrame, out: str, batch: int) -> None:
    """Adds the changes of a batch to the table at ``out``. Batches are numbered upwards; the last one may come again."""
    spark = rows.sparkSession
    # what no reader needs since the batch before this one ended
    old, last = [f for f in _folders(spark, out) if f[1] < batch], {}
    for day, b, _ in old:
        last[day] = max(b, last.get(day, b))
    for day, b, path in old:
        if b < last[day]:
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    new = partials(rows).persist()
    days = F.broadcast(new.select(F.col("date").alias("_day")).distinct())  # a row a day
    known = kept(spark, out, batch).join(days, F.col("date").eqNullSafe(F.col("_day")), "left_semi")
    both = new.unionByName(known.select(*new.columns)).groupBy(*_KEYS).agg(*[F.sum(c).alias(c) for c in _SUMS])
    both = both.withColumn("batch", F.lit(batch).cast("bigint")).repartition("date")
    both.write.partitionBy("date", "batch").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(out)
    new.unpersist()


def keep_daily(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Runs over what has arrived and ends; the next call goes on from there."""
    return stream.writeStream.foreachBatch(lambda df, i: merge_batch(df, out, i)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_changes(spark: SparkSession, path: str, per_trigger: int = 1) -> DataFrame:
    """Changes from parquet files as they arrive."""
    return spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", per_trigger).parquet(path)


def context(sums: DataFrame) -> DataFrame:
    """The daily context (A6) from kept sums; types and days of which nothing is left are gone."""
    by_type = sums.groupBy("date", "memory_type").agg(*[F.sum(c).alias(c) for c in _SUMS]).where("n > 0")
    types = F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "memory_type", "n"))), ",")
    mean = lambda s, n: F.when(F.sum(n) > 0, F.sum(s) / F.sum(n))
    return by_type.groupBy("date").agg(F.sum("n").alias("memory_count"), mean("v", "nv").alias("valence_mean"), mean("a", "na").alias("arousal_mean"), types.alias("types"))


def arc(sums: DataFrame) -> DataFrame:
    """The hourly arc (A6) from kept sums."""
    by_hour = sums.groupBy("date", "hour").agg(F.sum("v").alias("v"), F.sum("nv").alias("n")).where("n > 0")
    return by_hour.select("date", "hour", (F.col("v") / F.col("n")).alias("valence_mean"), "n")
