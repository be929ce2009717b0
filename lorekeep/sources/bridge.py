"""Logical tables of the memory model, derived from the driver's tables.

Each function gives one DataFrame; ``lorekeep.plans.oracle`` has the same rules as SQL. Text is joined only where asked for,
so that most queries never scan documents. All rules are row-wise: nothing here pairs rows with rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

#: Names by event type (first emotion, memory type) and by user_id % 5 (second emotion).
FIRST = {"click": "joy", "error": "anger", "purchase": "trust", "signup": "hope", "view": "calm"}
SECOND = ("fear", "sadness", "love", "pride", "shame")
TYPES = {"click": "experience", "error": "correction", "purchase": "promise", "signup": "identity", "view": "insight"}
# Counterweight types and pattern flags.
COUNTERWEIGHTS = ("grounding", "agency", "connection", "self_compassion", "evidence_of_progress")
FLAGS = ("clean", "absorbed_framing", "suppressed_strength", "performed_mask", "projected_attribution")
STATUS = ("expired", "rejected", "provisional")


def _pick(col: Column, names) -> Column:
    """names[col], null past their end."""
    out = None
    for i, n in enumerate(names):
        out = F.when(col == i, n) if out is None else out.when(col == i, n)
    return out


def _by(col: Column, names: dict[str, str]) -> Column:
    out = None
    for k, v in names.items():
        out = F.when(col == k, v) if out is None else out.when(col == k, v)
    return out


def memories(spark: SparkSession, sf_dir: str, text: bool = False) -> DataFrame:
    """One memory per event; ``text`` adds raw_text from documents."""
    e = table(spark, sf_dir, "events")
    i, u = F.col("event_id"), F.col("user_id")
    out = e.select(
        i.alias("id"), u.alias("user_id"), _by(F.col("event_type"), TYPES).alias("memory_type"),
        F.when(i % 6 != 0, F.concat(F.lit("ctx "), u.cast("string"))).alias("context"),
        F.when(i % 29 == 3, "journal").otherwise(_pick(u % 3, ("teaching", "inference", "exchange"))).alias("source_type"),
        F.coalesce(_pick(i % 10, STATUS), F.lit("durable")).alias("status"),
        _pick(i % 5, ("user", "assistant", "system", "user")).alias("proposed_by"),
        ((i % 101) / 100).alias("confidence"),
        F.when(i % 8 == 0, F.col("ts") + F.expr("INTERVAL 14 DAYS")).alias("review_after"),
        (i % 9 == 0).alias("needs_user_confirmation"),
        F.when(i % 17 == 0, "high").when(i % 13 == 5, "low").when(i % 19 != 0, "normal").alias("consent_level"),
        _pick(i % 41, COUNTERWEIGHTS).alias("counterweight_type"),
        F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"), (i % 7).alias("access_count"), (i % 23 == 0).alias("is_core"),
        _pick(i % 31, FLAGS).alias("pattern_flag"), F.when(i % 2 == 0, F.concat(F.lit("source "), (u % 4).cast("string"))).alias("pattern_source"),
        F.when(i % 37 == 0, 0.7).otherwise(1.0).alias("retrieval_weight"),
    )
    if text:
        docs = texts(spark, sf_dir)
        out = out.withColumn("_doc", text_of(docs)).join(docs, F.col("_doc") == F.col("doc_id")).drop("_doc", "doc_id")
    return out


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, raw_text): what memories say, many of them the same."""
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("raw_text"))


def text_of(docs: DataFrame) -> Column:
    """The doc_id of a memory's text."""
    return F.col("id") % F.lit(docs.count())


def affect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One affect row per memory, two for some; chords of two emotions, or none.

    Scales are odd on purpose: means of terminating decimals would meet the halves of rounding, where engines differ."""
    e = table(spark, sf_dir, "events")
    i, u = F.col("event_id"), F.col("user_id")
    k = F.get_json_object("props", "$.k").cast("double")
    v = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("value") - 50) / 53))
    base = e.select(i.alias("memory_id"), v.alias("valence"), (k / 51 - 1).alias("arousal"), ((u % 11) / 5.3 - 1).alias("dominance"),
                    _by(F.col("event_type"), FIRST).alias("e1"), (k / 100).alias("w1"), _pick(u % 5, SECOND).alias("e2"), (1 - k / 100).alias("w2"), F.col("ts").alias("computed_at"))
    rows = base.withColumn("model", F.explode(F.when(F.col("memory_id") % 20 == 7, F.array(F.lit("base"), F.lit("later"))).otherwise(F.array(F.lit("base")))))
    later = F.col("model") == "later"
    none = F.col("memory_id") % 97 == 0
    chord = F.when(none, F.create_map().cast("map<string,double>")).otherwise(F.create_map("e1", F.when(later, F.col("w2")).otherwise(F.col("w1")), "e2", F.when(later, F.col("w1")).otherwise(F.col("w2"))))
    return rows.select("memory_id", F.when(later, -F.col("valence")).otherwise(F.col("valence")).alias("valence"), "arousal", "dominance", chord.alias("emotions"),
                       F.when(later, F.col("computed_at") + F.expr("INTERVAL 1 HOUR")).otherwise(F.col("computed_at")).alias("computed_at"), "model")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector for two memories in three."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("memory_id")).where("memory_id % 3 <> 0")
    return e.withColumn("vec_id", F.col("memory_id") % F.lit(v.count())).join(v, "vec_id").select("memory_id", "embedding")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links by row-wise rules: a scattered family, hubs, and some self-loops; unique by ends and type."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("from_id"), "ts")
    n = F.lit(e.count())
    i = F.col("from_id")
    scattered = e.where("from_id % 7 IN (1, 3)").select("from_id", ((i * 31 + 17) % n).alias("to_id"), F.when(i % 2 == 0, "resonance").otherwise("supports").alias("edge_type"), ((i % 70) / 100 + 0.3).alias("weight"), "ts")
    hubs = e.where("from_id % 11 = 0").select("from_id", (i % 13 + n - 13).alias("to_id"), F.lit("resonates").alias("edge_type"), F.lit(0.5).alias("weight"), "ts")
    loops = e.where("from_id % 101 = 0").select("from_id", i.alias("to_id"), F.lit("self").alias("edge_type"), F.lit(1.0).alias("weight"), "ts")
    return scattered.union(hubs).union(loops).withColumnRenamed("ts", "created_at")


def ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty slots at most: the newest memories whose id is divisible by 7."""
    e = table(spark, sf_dir, "events").where("event_id % 7 = 0").orderBy(F.col("event_id").desc()).limit(30)
    return e.select(F.col("event_id").alias("memory_id"), (F.lit(0.4) + (F.col("event_id") % 6) / 10).alias("activation"), F.col("ts").alias("last_activated_at"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One session per user and day."""
    e = table(spark, sf_dir, "events")
    is_ = lambda t: F.count(F.when(F.col("event_type") == t, 1))
    return e.groupBy("user_id", F.to_date("ts").alias("day")).agg(
        (F.max("event_id") % 3 != 0).alias("boot_ran"), (F.max("event_id") % 4 == 0).alias("timestamp_logged"), is_("click").alias("exchanges_stored"), is_("view").alias("heartbeats_sent"),
        F.count(F.lit(1)).alias("tool_calls_total"), F.min("ts").alias("started_at"))


def hive_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals: emit, waggle, stop and nectar events by key."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    return e.where("event_type <> 'view'").select(
        i.alias("event_id"), _by(F.col("event_type"), {"click": "emit", "error": "stop", "purchase": "waggle", "signup": "nectar"}).alias("kind"),
        F.concat(F.lit("k"), (F.col("user_id") % 40).cast("string")).alias("key"), F.concat(F.lit("s"), (i % 3).cast("string")).alias("signal"),
        F.least(F.lit(1.0), F.col("value") / 100).alias("intensity"), F.when(i % 4 != 0, F.concat(F.lit("note "), (i % 9).cast("string"))).alias("note"),
        (i * 13 % 1000).alias("target_memory_id"), "ts", F.when(i % 5 == 0, F.col("ts") + F.expr("INTERVAL 2 DAYS")).alias("expires_at"))


def sleep_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a maintenance cycle: what it created, expired and filled in."""
    e = table(spark, sf_dir, "events").where("event_type = 'signup'")
    i = F.col("event_id")
    return e.select(F.col("ts").alias("cycle_start"), (F.col("ts") + F.expr("INTERVAL 5 SECONDS")).alias("cycle_end"), (i % 5).alias("edges_created"),
                    (i % 3).alias("memories_expired"), (i % 26).alias("embeddings_backfilled"))


#: Keys of the state table by event type.
STATE_KEYS = {"click": "mood", "error": "last_error", "purchase": "last_sleep_cycle", "signup": "last_journal_at", "view": "focus"}


def state_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every write to the key-value state: (event_id, key, value, updated_at)."""
    e = table(spark, sf_dir, "events")
    felt = F.col("event_type").isin("click", "view")
    value = F.when(felt, _pick(F.col("user_id") % 5, SECOND)).otherwise(F.to_date("ts").cast("string"))
    return e.select("event_id", _by(F.col("event_type"), STATE_KEYS).alias("key"), value.alias("value"), F.col("ts").alias("updated_at"))


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests: who asked what when, and the answer's code."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "ts", (F.col("user_id") % 7).alias("identity"), F.when(F.col("event_type") == "error", 403).otherwise(200).alias("response_code"), (F.col("event_type") == "purchase").alias("writes"))


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Research notes: titles repeat where documents begin alike."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.substring("text", 1, 40).alias("title"), F.col("text").alias("description"), F.col("lang").alias("entry_type"),
                    F.concat(F.lit("sess "), (F.col("doc_id") % 12).cast("string")).alias("session_id"), (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval((F.col("doc_id") % 30).cast("int"))).alias("ts"))
