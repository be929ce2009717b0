"""Status transitions, insight upserts, queue items, prefix duplicates, provenance audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.embed import hashing_vectors
from . import tables as T


def expired_by_ttl(memories: DataFrame, as_of: Column, backfill_days: int = 14) -> DataFrame:
    """Provisional memories past their review time expire; a missing time is ``backfill_days`` after creation."""
    due = F.coalesce("review_after", F.col("created_at") + F.make_dt_interval(F.lit(backfill_days)))
    return memories.withColumn("review_after", due).withColumn("status", F.when((F.col("status") == "provisional") & (due < as_of), "expired").otherwise(F.col("status")))


def expired_by_age(memories: DataFrame, as_of: Column, days: int = 14) -> DataFrame:
    """Provisional memories older than ``days`` expire, whatever their review time."""
    return memories.withColumn("status", F.when((F.col("status") == "provisional") & (F.col("created_at") < as_of - F.make_dt_interval(F.lit(days))), "expired").otherwise(F.col("status")))


def reviewed(memories: DataFrame, confirmed: Column, rejected: Column) -> DataFrame:
    """Confirmed inferences become durable, rejected ones rejected; others stay."""
    inference = F.col("source_type") == "inference"
    return memories.withColumn("status", F.when(inference & confirmed, "durable").when(inference & rejected, "rejected").otherwise(F.col("status")))


def prefix_duplicates(rows: DataFrame, text: str, key: str, least: int = 10, length: int = 100) -> DataFrame:
    """(key, duplicate) of rows whose first ``length`` characters, trimmed and lowered, occurred with a smaller key. Shorter prefixes
    than ``least`` are never duplicates. The first key is an aggregate, so common prefixes combine before they shuffle."""
    p = F.lower(F.trim(F.substring(text, 1, length)))
    some = rows.select(key, p.alias("prefix")).where(F.length("prefix") >= least)
    first = some.groupBy("prefix").agg(F.min(key).alias("first"))
    return some.join(first, "prefix").where(F.col(key) > F.col("first")).select(key, "first")


def merged_insights(known: DataFrame, new: DataFrame, as_of: Column, least: float = 0.5) -> DataFrame:
    """Insights (pattern_type, description, confidence, occurrences, first_seen, last_seen) after a cycle: a match that isn't rejected
    gains an occurrence and the larger confidence; others enter from ``least`` on."""
    keys = ["pattern_type", "description"]
    k = known.where("status <> 'rejected'").alias("k")
    n = new.groupBy(*keys).agg(F.max("confidence").alias("confidence")).withColumn("_new", F.lit(True)).alias("n")
    j = k.join(n, (F.col("k.pattern_type") == F.col("n.pattern_type")) & (F.col("k.description") == F.col("n.description")), "full")
    old, hit = F.col("k.pattern_type").isNotNull(), F.col("n._new").isNotNull()
    out = j.where(old | (F.col("n.confidence") >= least))
    return out.select(*[F.coalesce(f"k.{c}", f"n.{c}").alias(c) for c in keys],
                      F.when(old & hit, F.greatest("k.confidence", "n.confidence")).otherwise(F.coalesce("k.confidence", "n.confidence")).alias("confidence"),
                      (F.coalesce("k.occurrences", F.lit(0)) + hit.cast("long")).alias("occurrences"), F.coalesce("k.first_seen", as_of).alias("first_seen"), F.when(hit, as_of).otherwise(F.col("k.last_seen")).alias("last_seen"))


def capped_patterns(*parts: DataFrame, most: int = 10) -> DataFrame:
    """Patterns (pattern_type, description, confidence) of several miners, the surest first."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy(F.round("confidence", 6).desc(), "pattern_type", "description").limit(most)


def self_model_rules(drift: DataFrame, exchanges: DataFrame, growth: DataFrame, care: DataFrame) -> DataFrame:
    """(trigger, priority, value, fires) of the four rules: mood drifting down, many aroused exchanges (n, high), all exchanges and
    no journal, low mood of late. Each of the frames has one row at most."""
    one = T.side_by_side(drift.select("drift", "alert"), exchanges.select("n", "high"), growth.select("exchange_share", "one_sided"), care.select("valence"))
    col = F.col
    rules = (("emotional_drift", 0.8, col("drift"), col("alert") & (col("drift") < 0)), ("arousal_alert", 0.7, col("high"), (col("n") > 10) & (col("high") > 0.4)),
             ("reflection_needed", 0.6, col("exchange_share"), col("one_sided")), ("care_alert", 0.9, col("valence"), col("valence") < -0.15))
    rows = F.array(*[F.struct(F.lit(k).alias("trigger"), F.lit(p).alias("priority"), v.alias("value"), _true(ok).alias("fires")) for k, p, v, ok in rules])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def backfilled(vectors: DataFrame, texts: DataFrame, dims: int = 64) -> DataFrame:
    """``vectors`` (memory_id, embedding) with those made of ``texts`` (id, raw_text) in place of what they had."""
    new = hashing_vectors(texts, "raw_text", dims).select(F.col("id").alias("memory_id"), "embedding")
    return T.replaced(vectors, new, ["memory_id"])


def state_map(writes: DataFrame) -> DataFrame:
    """(key, value, updated_at): the last write of each key of ``writes`` (event_id, key, value, updated_at), combined before the shuffle."""
    last = writes.groupBy("key").agg(F.max_by(F.struct("value", "updated_at"), F.struct("updated_at", "event_id")).alias("w"))
    return last.select("key", "w.value", "w.updated_at")


def new_items(items: DataFrame, pending: DataFrame) -> DataFrame:
    """Queue items whose trigger isn't pending yet."""
    return items.join(pending.select("trigger").distinct(), "trigger", "left_anti")


def _share(part: Column, of: Column | None = None, digits: int = 1) -> Column:
    """Rows of ``part`` in per cent of those of ``of`` (all rows without it); 0 where there are none."""
    whole = T.count_if(of) if of is not None else F.count(F.lit(1))
    return F.round(T.count_if(part) * 100 / F.greatest(whole, F.lit(1)), digits)


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _memory_checks() -> dict[str, tuple[Column, Column | None]]:
    """Checks over single memories: the figure, and whether it passes given columns ``m`` (the figure) and ``none`` (no rows of
    the kind). Checks without a rule are for information and always pass."""
    m, none = F.col("m"), F.col("none")
    filled = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    is_ = lambda c, v: _true(F.col(c) == v)
    teaching, inference = is_("source_type", "teaching"), is_("source_type", "inference")
    correction, provisional = is_("memory_type", "correction"), is_("status", "provisional")
    often = F.col("access_count") > 5
    return {
        "1a": (_share(filled("source_type"), digits=2), m >= 99),
        "1b": (_share(filled("proposed_by"), digits=2), m >= 99),
        "1c": (T.count_if(teaching & is_("proposed_by", "system")), m == 0),
        "1d": (T.count_if(inference & is_("proposed_by", "user")), m == 0),
        "1e": (T.count_if(teaching & F.col("memory_type").isin("insight", "pattern", "dream")), m == 0),
        "1f": (T.count_if(often & (F.col("source_type").isNull() | F.col("proposed_by").isNull())), m == 0),
        "2a": (T.count_if(correction), m > 0),
        "2b": (T.count_if(F.col("status").isin("expired", "rejected")), m > 0),
        "2c": (_share(correction & filled("context"), correction), m >= 80),
        "3a": (T.count_if(teaching & is_("proposed_by", "assistant")), m == 0),
        "3b": (_share(inference & ~_true(F.col("confidence") >= 1.0), inference), m >= 10),
        "3c": (_share(provisional & F.col("review_after").isNotNull(), provisional), (m >= 80) | none),
        "3d": (_share(inference & _true(F.col("confidence") >= 0.95), inference), m < 90),
        "3e": (T.count_if(F.col("needs_user_confirmation")), None),
        "4a": (T.count_if(F.col("counterweight_type").isNotNull()), m > 0),
        "4b": (T.count_if(filled("consent_level")), m > 0),
        "4c": (T.count_if(is_("consent_level", "low") & F.col("is_core")), None),
        "4d": (T.count_if(F.col("retrieval_weight") != 1.0), m > 0),
    }


def audit(memories: DataFrame, ring: DataFrame, edges: DataFrame, sleep_log: DataFrame, as_of: Column) -> DataFrame:
    """(check_id, metric, pass): the provenance, correction, false-memory, adversarial and drift checks that are data checks.

    Memories are read once for the checks of single rows; those over the ring, the edges, the sleep log and months are
    aggregates of their own.
    """
    checks = _memory_checks()
    durable, access = F.col("status") == "durable", F.when(F.col("status") == "durable", F.col("access_count"))
    provisionals, corrections = T.count_if(F.col("status") == "provisional"), T.count_if(F.col("memory_type") == "correction")
    one = memories.agg(*[c.cast("double").alias(k) for k, (c, _) in checks.items()], provisionals.alias("_provisionals"),
                       F.count_distinct(access).alias("_values"), (F.max(access) > F.min(access)).alias("_varied"))
    row = lambda k, metric, ok: F.struct(F.lit(k).alias("check_id"), metric.cast("double").alias("metric"), F.coalesce(ok, F.lit(False)).alias("pass"))
    each = [F.struct(F.lit(k).alias("check_id"), F.col(k).alias("m"), (F.col("_provisionals") == 0).alias("none"), F.lit(ok is None).alias("info")) for k, (_, ok) in checks.items()]
    passes = F.lit(False)
    for k, (_, ok) in checks.items():
        if ok is not None:
            passes = F.when(F.col("check_id") == k, ok).otherwise(passes)
    single = one.select(F.explode(F.array(*each)).alias("r")).select("r.*").select("check_id", F.col("m").alias("metric"), (F.col("info") | passes).alias("pass"))
    varied = one.select(row("5c", F.col("_values"), F.col("_varied") & (F.col("_values") > 3)).alias("r")).select("r.*")

    n = F.count(F.lit(1))
    gone = memories.where("status = 'expired'").select(F.col("id").alias("memory_id"))
    stale = ring.join(gone, "memory_id", "left_semi").agg(n.alias("n")).select(row("2d", F.col("n"), F.col("n") == 0).alias("r")).select("r.*")
    orphans = orphaned(memories, edges).select("to_id").distinct().agg(n.alias("n")).select(row("2e", F.col("n"), F.col("n") == 0).alias("r")).select("r.*")
    known = memories.where("memory_type = 'correction'").select(F.col("id").alias("from_id"))
    linked = T.side_by_side(edges.join(known, "from_id", "left_semi").agg(n.alias("n")), memories.agg(corrections.alias("all")))
    linked = linked.select(row("2f", F.col("n"), (F.col("n") > 0) | (F.col("all") == 0)).alias("r")).select("r.*")
    week = (F.col("cycle_start") > as_of - F.make_dt_interval(F.lit(7))) & (F.col("edges_created") > 0)
    slept = sleep_log.agg(T.count_if(week).alias("recent"), n.alias("all"))
    slept = slept.select(row("5d", F.col("recent"), (F.col("recent") > 0) | (F.col("all") > 0)).alias("r")).select("r.*")
    months = T.counts(memories.where(durable).select(F.date_format("created_at", "yyyy-MM").alias("month")), "month")
    era = months.agg(F.max("n").alias("most"), F.sum("n").alias("all"), n.alias("months")).withColumn("m", F.col("most") * 100 / F.col("all"))
    era = era.select(row("5e", F.round("m", 1), (F.col("months") > 1) & (F.col("m") < 80)).alias("r")).select("r.*")
    return single.union(varied).union(stale).union(orphans).union(linked).union(slept).union(era)


def orphaned(memories: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges from a teaching that is expired or rejected to a durable inference."""
    a = memories.where("source_type = 'teaching' AND status IN ('expired', 'rejected')").select(F.col("id").alias("from_id"))
    b = memories.where("source_type = 'inference' AND status = 'durable'").select(F.col("id").alias("to_id"))
    return edges.join(a, "from_id", "left_semi").join(b, "to_id", "left_semi")


def newest_per_key(rows: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.col(time).desc(), tie)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
