"""Readers and writers of the exchange formats: conversation exports, tags, snapshots, reports, signal logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import elements, write_array

EXPORT = "uuid string, name string, created_at string, chat_messages array<struct<sender string, text string, created_at string>>"


def read_export(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Conversation exports (a JSON array, cut at its elements, or a conversation a line) as turns."""
    df = elements(spark, path).select(F.from_json("value", EXPORT).alias("c")).select("c.*") if multiline else spark.read.schema(EXPORT).json(path)
    rows = df.select(F.col("uuid").alias("conv_id"), "name", F.posexplode("chat_messages").alias("turn", "m"))
    return rows.select("conv_id", "name", "turn", F.when(F.col("m.sender") == "human", "user").otherwise(F.col("m.sender")).alias("role"), F.col("m.text").alias("text"), F.try_to_timestamp(F.col("m.created_at")).alias("created_at"))


def write_export(turns: DataFrame, path: str, array: bool = False) -> None:
    """Turns (conv_id, turn, role, text) as exports, a conversation a line or an array a file."""
    m = F.struct("turn", F.when(F.col("role") == "user", "human").otherwise(F.col("role")).alias("sender"), "text")
    conv = turns.groupBy(F.col("conv_id").cast("string").alias("uuid")).agg(F.transform(F.sort_array(F.collect_list(m)), lambda x: F.struct(x["sender"].alias("sender"), x["text"].alias("text"))).alias("chat_messages"))
    if array:
        write_array(conv, path)
    else:
        conv.write.mode("overwrite").json(path)


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    """Bulk tags: [{id, flag, source}]."""
    return spark.read.schema("id bigint, flag string, source string").json(path, multiLine=True)


def apply_tags(memories: DataFrame, tags: DataFrame) -> DataFrame:
    t = tags.groupBy("id").agg(F.last("flag").alias("_flag"), F.last("source").alias("_source"))
    return memories.join(t, "id", "left").withColumn("pattern_flag", F.coalesce("_flag", "pattern_flag")).withColumn("pattern_source", F.coalesce("_source", "pattern_source")).drop("_flag", "_source")


def read_people(spark: SparkSession, path: str) -> DataFrame:
    """People configuration, a JSON object of names and relationships, as (name, relationship); empty names are left out."""
    text = spark.read.text(path, wholetext=True)
    pairs = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("name", "relationship"))
    return pairs.where(F.trim("name") != "")


RESULTS = "timestamp string, total_memories bigint, tasks array<struct<task string, passed bigint, total_tests bigint, pass_rate double, tests array<struct<id string, name string, pass boolean>>>>"
_TASKS = {"1": "provenance", "2": "corrections", "3": "false memories", "4": "adversarial", "5": "drift"}


def write_results(audit: DataFrame, path: str, at: str) -> None:
    """An audit (check_id, metric, pass) as a results file: a task for each first digit, with its checks and share passed."""
    task = F.create_map(*[F.lit(x) for kv in _TASKS.items() for x in kv])[F.substring("check_id", 1, 1)]
    test = F.struct(F.col("check_id").alias("id"), F.col("metric"), F.col("pass"))
    passed, n = F.count(F.when(F.col("pass"), 1)), F.count(F.lit(1))
    tasks = audit.groupBy(task.alias("task")).agg(passed.alias("passed"), n.alias("total_tests"), F.round(passed * 100 / n, 1).alias("pass_rate"), F.sort_array(F.collect_list(test)).alias("tests"))
    whole = tasks.agg(F.sort_array(F.collect_list(F.struct(*tasks.columns))).alias("tasks")).withColumn("timestamp", F.lit(at))  # five tasks
    whole.coalesce(1).write.mode("overwrite").json(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """(timestamp, task, check_id, pass, pass_rate) of results files."""
    tasks = spark.read.schema(RESULTS).json(path).select("timestamp", F.explode("tasks").alias("t"))
    return tasks.select("timestamp", "t.task", "t.pass_rate", F.explode("t.tests").alias("x")).select("timestamp", "task", F.col("x.id").alias("check_id"), F.col("x.pass").alias("pass"), "pass_rate")


def write_snapshot(snapshot: DataFrame, path: str) -> None:
    """A one-row summary as JSON."""
    snapshot.coalesce(1).write.mode("overwrite").json(path)


def write_markdown(entries: DataFrame, path: str) -> None:
    """Journal entries (ts, entry_type, title, description) as Markdown, a heading a day and a line an entry in order of time.

    Headings are rows that sort before their day's entries; a day may go on in the next file, so no day is held in memory."""
    line = F.concat(F.lit("- **"), "entry_type", F.lit("** "), "title", F.lit(": "), F.coalesce("description", F.lit("")))
    rows = entries.select(F.to_date("ts").alias("day"), "ts", line.alias("value"))
    heads = rows.select("day").distinct().select("day", F.lit(None).cast(rows.schema["ts"].dataType).alias("ts"), F.concat(F.lit("\n## "), F.col("day").cast("string")).alias("value"))
    order = ["day", F.asc_nulls_first("ts"), "value"]
    heads.union(rows).repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.mode("overwrite").text(path)


def append_signals(batch: DataFrame, path: str, batch_id: int) -> bool:
    """Pending signals appended as JSON lines, once a batch id however often the batch is delivered; the body of a foreachBatch sink.

    A batch is written beside the log and put in place by one rename, which its folder's name allows once: what a killed or
    repeated delivery wrote before goes, and a batch in place is left alone. True if this call put it there.
    """
    jvm = batch.sparkSession._jvm
    place = jvm.org.apache.hadoop.fs.Path(f"{path}/batch={batch_id}")
    fs = place.getFileSystem(batch.sparkSession._jsc.hadoopConfiguration())
    if fs.exists(place):
        return False
    aside = f"{path}/_incoming-{batch_id}"  # names that begin with _ are not read
    batch.write.mode("overwrite").json(aside)
    fs.mkdirs(place.getParent())
    if not fs.rename(jvm.org.apache.hadoop.fs.Path(aside), place):
        if not fs.exists(place):
            raise OSError(f"batch {batch_id} could not be put in place in {path}")
        fs.delete(jvm.org.apache.hadoop.fs.Path(aside), True)
        return False
    return True


def read_signals(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The log's signals, with the id of the batch that brought each."""
    return spark.read.schema(schema + ", batch bigint").json(path)
