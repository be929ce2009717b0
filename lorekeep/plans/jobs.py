"""Batch jobs, changes of tables, audits, snapshots."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import affect as A
from ..operators import graph as G
from ..operators import maintenance as M
from ..operators import orchestrator as O
from ..operators import retrieval as R
from ..operators import rollups as D
from ..operators import tables as T
from ..session import table
from ..sources import bridge as B
from ..workspace import new_path
from . import daily as Y
from . import graph as P
from . import retrieval as X
from .catalog import query
from .daily import r6
from .oracle import AS_OF, sql
from .retrieval import as_of


@query("k4_expire_by_ttl", sql("memories", f"SELECT id, CASE WHEN status = 'provisional' AND coalesce(review_after, created_at + INTERVAL 14 DAY) < {AS_OF} THEN 'expired' ELSE status END AS status FROM memories"))
def k4(spark, sf_dir):
    return M.expired_by_ttl(B.memories(spark, sf_dir), as_of()).select("id", "status")


@query("k4b_expire_by_age", sql("memories", f"SELECT status, count(*) AS n FROM (SELECT CASE WHEN status = 'provisional' AND created_at < {AS_OF} - INTERVAL 14 DAY THEN 'expired' ELSE status END AS status FROM memories) GROUP BY 1"))
def k4b(spark, sf_dir):
    return T.counts(M.expired_by_age(B.memories(spark, sf_dir), as_of()), "status")


@query("w7_prefix_duplicates", "SELECT doc_id, first FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY p) AS first FROM (SELECT doc_id, lower(trim(left(text, 100), ' ')) AS p FROM documents) WHERE length(p) >= 10) WHERE doc_id > first")
def w7(spark, sf_dir):
    """By distinct rows, so that no row is its own duplicate."""
    return M.prefix_duplicates(table(spark, sf_dir, "documents"), "text", "doc_id")


@query("w8_keep_earliest", sql("journal", "SELECT id FROM journal WHERE id NOT IN (SELECT min(id) FROM journal GROUP BY title)"))
def w8(spark, sf_dir):
    """Journal rows that a title's first row makes superfluous."""
    j = B.journal(spark, sf_dir)
    first = j.groupBy("title").agg(F.min("id").alias("first"))
    return j.select("id", "title").join(first, "title").where("id <> first").select("id")


_PATTERNS = """SELECT 'bigram' AS pattern_type, first || ' then ' || second AS description, confidence FROM bigram UNION ALL SELECT 'run', CASE WHEN rising THEN 'rising' ELSE 'falling' END || ' from ' || start, confidence FROM runs
    UNION ALL SELECT 'hub', 'hub ' || hub, least(0.85, 0.4 + 0.03 * neighbours) FROM top_hubs"""
_MINED = dict(affected=Y._ROWS, daily=Y._DAILY, sums=Y._SUMS, dominant=Y._DOMINANT, bigram=Y._BIGRAMS, days=Y._DAYS, runs=Y._RUNS.format(v="valence_mean", n=3),
              both_ways="SELECT from_id AS hub, to_id AS id FROM edges WHERE from_id <> to_id UNION SELECT to_id, from_id FROM edges WHERE from_id <> to_id", top_hubs="SELECT hub, count(*) AS neighbours FROM both_ways GROUP BY 1 HAVING count(*) >= 3 ORDER BY 2 DESC, 1 LIMIT 20",
              patterns=_PATTERNS, ten="SELECT * FROM patterns ORDER BY round(confidence, 6) DESC, pattern_type, description LIMIT 10")


def _sequences(spark, sf_dir):
    """Patterns of two miners that don't look at edges: bigrams and runs."""
    big = D.bigrams(Y.dominants(spark, sf_dir)).select(F.lit("bigram").alias("pattern_type"), F.concat("first", F.lit(" then "), "second").alias("description"), "confidence")
    run = Y.runs(spark, sf_dir).select(F.lit("run").alias("pattern_type"), F.concat(F.when(F.col("rising"), "rising").otherwise("falling"), F.lit(" from "), F.col("start").cast("string")).alias("description"), "confidence")
    return big, run


def mined(spark, sf_dir, edges=None, sequences=None):
    """The ten surest patterns of three miners (T8), over the table's edges or given ones; ``sequences`` where those are made already."""
    big, run = sequences or _sequences(spark, sf_dir)
    hub = G.hubs(B.edges(spark, sf_dir) if edges is None else edges).select(F.lit("hub").alias("pattern_type"), F.concat(F.lit("hub "), F.col("hub").cast("string")).alias("description"), F.least(F.lit(0.85), 0.4 + 0.03 * F.col("neighbours")).alias("confidence"))
    return M.capped_patterns(big, run, hub)


@query("k6_insight_cycle", sql("memories latest_chords latest edges", "SELECT pattern_type, description, round(confidence, 6) AS confidence FROM ten", **_MINED))
def k6(spark, sf_dir):
    return mined(spark, sf_dir).select("pattern_type", "description", r6("confidence"))


_KNOWN = "SELECT * FROM (VALUES ('hub', 'hub ' || ((SELECT count(*) FROM events) - 13), 0.2::DOUBLE, 4, 'active'), ('run', 'an old one', 0.9, 2, 'active'), ('bigram', 'gone', 0.7, 1, 'rejected')) t(pattern_type, description, confidence, occurrences, status)"


@query("k8_insight_upsert", sql("memories latest_chords latest edges", """SELECT coalesce(k.pattern_type, n.pattern_type) AS pattern_type, coalesce(k.description, n.description) AS description, round(coalesce(greatest(k.confidence, n.confidence), k.confidence, n.confidence), 6) AS confidence,
    (coalesce(k.occurrences, 0) + (n.description IS NOT NULL)::INT)::BIGINT AS occurrences FROM (SELECT * FROM known WHERE status <> 'rejected') k FULL JOIN ten n ON k.pattern_type = n.pattern_type AND k.description = n.description WHERE k.description IS NOT NULL OR n.confidence >= 0.5""", **_MINED, known=_KNOWN))
def k8(spark, sf_dir):
    """The cycle's patterns into a table that knows one of them already."""
    n = table(spark, sf_dir, "events").count()
    t = "2024-01-01 00:00:00"
    known = spark.createDataFrame([("hub", f"hub {n - 13}", 0.2, 4, "active", t), ("run", "an old one", 0.9, 2, "active", t), ("bigram", "gone", 0.7, 1, "rejected", t)], "pattern_type string, description string, confidence double, occurrences bigint, status string, t string")
    known = known.withColumn("first_seen", F.col("t").cast("timestamp_ntz")).withColumn("last_seen", F.col("first_seen"))
    return M.merged_insights(known, mined(spark, sf_dir), as_of()).select("pattern_type", "description", r6("confidence"), "occurrences")


_RULES = """SELECT 'emotional_drift' AS trigger, 0.8::DOUBLE AS priority, (SELECT max(drift) FROM drifted) AS value, coalesce((SELECT bool_or(alert AND drift < 0) FROM drifted), false) AS fires
    UNION ALL SELECT 'arousal_alert', 0.7, high, coalesce(n > 10 AND high > 0.4, false) FROM (SELECT count(*) AS n, avg((coalesce(arousal, 0) > 0.6)::INT) AS high FROM picked)
    UNION ALL SELECT 'reflection_needed', 0.6, exchange_share, one_sided FROM growth UNION ALL SELECT 'care_alert', 0.9, valence, coalesce(valence < -0.15, false) FROM care"""
_DRIFTED = f"""SELECT round(short - long, 3) AS drift, abs(round(short - long, 3)) > 0.15 AS alert FROM (SELECT round(avg(valence_mean) FILTER (age <= 7), 3) AS short, round(avg(valence_mean) FILTER (age <= 90), 3) AS long,
    count(valence_mean) FILTER (age <= 7) AS short_days, count(valence_mean) FILTER (age <= 90) AS long_days FROM (SELECT *, datediff('day', date, DATE '{Y.TODAY}') AS age FROM daily) WHERE age >= 0) WHERE long_days >= 7 AND short_days >= 3"""


def self_rules(spark, sf_dir):
    e = Y.recent_exchanges(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), (T.count_if(F.col("arousal") > 0.6) / F.count(F.lit(1))).alias("high"))
    return M.self_model_rules(D.drift(Y.daily(spark, sf_dir), "valence_mean", Y.TODAY), e, Y.growth(spark, sf_dir), Y.care(spark, sf_dir))


@query("k9_self_model_items", sql("memories latest edges", "SELECT trigger, priority, round(value, 6) AS value, fires, fires AND trigger <> 'care_alert' AS queued FROM rules",
    affected=Y._ROWS, daily=Y._DAILY, picked=Y._EXCHANGES, lately=Y._LATELY, growth=Y._GROWTH, drifted=_DRIFTED, care=Y._CARE, rules=_RULES))
def k9(spark, sf_dir):
    """What the self-model's rules see, which fire, and which of these enter the queue: a care alert is pending already."""
    rules = self_rules(spark, sf_dir)
    pending = spark.createDataFrame([("care_alert",)], "trigger string")
    queued = M.new_items(rules.where("fires"), pending).select("trigger", F.lit(True).alias("queued"))
    return rules.join(F.broadcast(queued), "trigger", "left").select("trigger", "priority", r6("value"), "fires", F.coalesce("queued", F.lit(False)).alias("queued"))  # four rules


_MISSING = "SELECT id FROM memories WHERE status = 'durable' AND id NOT IN (SELECT memory_id FROM vectors) ORDER BY created_at DESC, id LIMIT 50"


def missing_vectors(spark, sf_dir):
    """What an embedding backfill takes next (J6 with a limit)."""
    m = B.memories(spark, sf_dir).where("status = 'durable'").select("id", "created_at").join(B.embeddings(spark, sf_dir).select(F.col("memory_id").alias("id")), "id", "left_anti")
    return T.newest(m, 50, "created_at", "id").select("id")


@query("k11_backfill_candidates", sql("memories vectors", _MISSING))
def k11(spark, sf_dir):
    return missing_vectors(spark, sf_dir)


@query("k11b_backfilled", sql("memories vectors texts", f"""SELECT count(*) AS vectors, count(*) FILTER (memory_id IN (SELECT id FROM missing)) AS filled, (SELECT count(*) FROM memories WHERE status = 'durable' AND id NOT IN (SELECT memory_id FROM vectors)) - (SELECT count(*) FROM missing JOIN texts USING (id)) AS remaining
    FROM (SELECT memory_id FROM vectors UNION ALL SELECT id FROM missing JOIN texts USING (id))""", missing=_MISSING))
def k11b(spark, sf_dir):
    """The vector table after a backfill: vectors are made for the rows that lack one and upserted."""
    todo = missing_vectors(spark, sf_dir)
    texts = B.memories(spark, sf_dir, text=True).select("id", "raw_text").join(F.broadcast(todo), "id", "left_semi")  # fifty rows
    have = B.embeddings(spark, sf_dir).select("memory_id", "embedding")
    every = M.backfilled(have, texts)
    durable = B.memories(spark, sf_dir).where("status = 'durable'").select(F.col("id").alias("memory_id"))
    filled = every.join(F.broadcast(todo.select(F.col("id").alias("memory_id"), F.lit(1).alias("new"))), "memory_id", "left")
    counts = filled.agg(F.count(F.lit(1)).alias("vectors"), F.count("new").alias("filled"))
    return T.side_by_side(counts, durable.join(every.select("memory_id"), "memory_id", "left_anti").agg(F.count(F.lit(1)).alias("remaining")))


CYCLES = 16


def _named(text: str, names: str, suffix: str) -> str:
    """SQL with a suffix to each of the names of its own common table expressions."""
    return re.sub(rf"\b({'|'.join(names.split())})\b", rf"\1_{suffix}", text)


def _cycles_sql() -> str:
    """Every cycle's links as expressions of their own, each without what the ones before have linked; then its row."""
    steps: dict[str, str] = {"total": "SELECT count(*) AS n FROM durable", "linked_0": P._LINKS}
    rows, insights = [], []
    for c in range(1, CYCLES + 1):
        first = f"(SELECT ({c} - 1) % greatest(ceil(n / 500), 1) * 500 FROM total)"
        steps[f"batched_{c}"] = f"SELECT * FROM durable WHERE batch >= {first} AND batch < {first} + 500 AND emotion IS NOT NULL"
        for name in ("anchors", "pool", "pairs"):
            steps[f"{name}_{c}"] = _named(P._K1[name], "batched anchors pool", str(c)).replace("FROM linked l", f"FROM linked_{c - 1} l")
        steps[f"new_{c}"] = f"SELECT * FROM pairs_{c} WHERE dist < 0.4 AND cos >= 0.25 ORDER BY emotion, id, c_id LIMIT 200"
        steps[f"linked_{c}"] = f"SELECT * FROM linked_{c - 1} UNION SELECT least(id, c_id), greatest(id, c_id) FROM new_{c}"
        at = lambda k: f"{AS_OF} - INTERVAL {30 * (CYCLES - k)} MINUTE"
        due = "status = 'provisional' AND coalesce(review_after, created_at + INTERVAL 14 DAY)"
        expired = f"(SELECT count(*) FROM memories WHERE {due} < {at(c)}" + (f" AND NOT {due.split(' AND ')[1]} < {at(c - 1)})" if c > 1 else ")")
        jobs, seen, items = "sleep", "NULL", "NULL"
        if c % 4 == 0:
            jobs += ",insight"
            both = f"SELECT a AS hub, b AS id FROM linked_{c} WHERE a <> b UNION SELECT b, a FROM linked_{c} WHERE a <> b"
            steps |= {f"both_ways_{c}": both} | {f"{k}_{c}": _named(_MINED[k], "both_ways top_hubs patterns", str(c)) for k in ("top_hubs", "patterns", "ten")}
            insights.append(f"SELECT pattern_type, description FROM ten_{c} WHERE confidence >= 0.5")
            seen = f"(SELECT count(*) FROM ({' UNION '.join(insights)}))"
        if c % 8 == 0:
            jobs += ",self"
            items = "(SELECT count(*) FROM rules WHERE fires)" if c == 8 else "0"
        rows.append(f"SELECT {c}::BIGINT AS cycle, '{jobs}' AS jobs, '' AS failed, {first}::BIGINT AS first, {first}::BIGINT + 500 AS next, (SELECT count(*) FROM new_{c}) AS edges, {expired} AS expired, {seen} AS insights, {items} AS items")
    base = {k: v for k, v in _MINED.items() if k not in ("both_ways", "top_hubs", "patterns", "ten")} | dict(durable=P._DURABLE)
    rules = dict(picked=Y._EXCHANGES, lately=Y._LATELY, growth=Y._GROWTH, drifted=_DRIFTED, care=Y._CARE, rules=_RULES)
    # the cursor in the log is where it stood; a cycle that finds it at the end starts over
    log = " UNION ALL ".join(rows)
    text = sql("memories latest_chords latest vectors edges", "SELECT cycle, jobs, failed, CASE WHEN cycle = 1 THEN 0 ELSE lag(next) OVER (ORDER BY cycle) END AS first, next, edges, expired, insights, items FROM log ORDER BY cycle", **(base | rules | steps), log=log)
    return re.sub(r"\b(linked|new|pairs|pool|anchors|batched|durable|affected)(_[0-9]+)? AS \(", lambda m: m[0].replace("AS (", "AS MATERIALIZED ("), text)


def cycle_jobs(spark, sf_dir, home):
    """The jobs of the orchestrator over the driver's tables, by how often they run: links and expiry, insights, the self-model."""
    memories, edges = B.memories(spark, sf_dir), B.edges(spark, sf_dir)
    keep = lambda df, name: (df.write.mode("overwrite").parquet(f"{home}/base/{name}"), spark.read.schema(df.schema).parquet(f"{home}/base/{name}"))[1]
    durable = keep(P.durable(spark, sf_dir).select("id", "date", "created_at", "emotions", "batch"), "durable")
    link = O.consolidation(durable, B.embeddings(spark, sf_dir), edges, ranked=keep(G.candidates_by_date(durable), "candidates"))
    sequences = [keep(x, name) for x, name in zip(_sequences(spark, sf_dir), ("bigrams", "runs"), strict=True)]

    def sleep(now):
        at = as_of() - F.make_dt_interval(mins=F.lit(30 * (CYCLES - now.number)))
        gone = now.written("expired", "id bigint")
        due = M.expired_by_ttl(memories.where("status = 'provisional'"), at).where("status = 'expired'").select("id")
        expired = now.write(due.join(gone, "id", "left_anti"), "expired")
        return link(now) | {"expired": expired.count()}

    def insight(now):
        every = edges.select("from_id", "to_id").union(now.written("edges", "from_id bigint, to_id bigint")).union(spark.read.parquet(f"{home}/work/cycle={now.number}/edges"))
        known = now.written("insights", "pattern_type string, description string, confidence double, occurrences bigint, first_seen timestamp_ntz, last_seen timestamp_ntz", newest=True)
        after = M.merged_insights(known.withColumn("status", F.lit("active")), mined(spark, sf_dir, every, sequences), as_of())
        return {"insights": now.write(after, "insights").count()}

    def self_model(now):
        pending = now.written("items", "trigger string")
        return {"items": now.write(M.new_items(self_rules(spark, sf_dir).where("fires"), pending).select("trigger"), "items").count()}

    return {"sleep": (1, sleep), "insight": (4, insight), "self": (8, self_model)}


@query("k14_orchestrator", _cycles_sql())
def k14(spark, sf_dir):
    """The log of sixteen cycles, run over the tables: links of batch after batch, expiry, insights, items of the self-model."""
    home = new_path(spark, "cycles")
    return O.run_cycles(spark, home, cycle_jobs(spark, sf_dir, home), CYCLES)


def updates(spark, sf_dir):
    """Rows to write over a status table: known keys and new ones, some without a note."""
    return table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey")).otherwise(F.col("c_custkey") + 1_000_000).alias("key"), F.when(F.col("c_custkey") % 4 != 0, F.concat(F.lit("new "), F.col("c_mktsegment"))).alias("note"), F.col("c_acctbal").alias("value"))


def base(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("note"), (F.col("c_acctbal") + 1).alias("value"))


_BASE = "SELECT c_custkey AS key, c_mktsegment AS note, c_acctbal + 1 AS value FROM customer"
_UPD = "SELECT CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE c_custkey + 1000000 END AS key, CASE WHEN c_custkey % 4 <> 0 THEN 'new ' || c_mktsegment END AS note, c_acctbal AS value FROM customer WHERE c_custkey % 3 = 0"


@query("m3_replace", sql("", "SELECT * FROM base WHERE key NOT IN (SELECT key FROM upd) UNION ALL SELECT * FROM upd", base=_BASE, upd=_UPD))
def m3(spark, sf_dir):
    return T.replaced(base(spark, sf_dir), updates(spark, sf_dir), ["key"])


@query("m4_merge_coalesce", sql("", "SELECT coalesce(b.key, u.key) AS key, coalesce(u.note, b.note) AS note, CASE WHEN u.key IS NOT NULL THEN u.value ELSE b.value END AS value FROM base b FULL JOIN upd u ON b.key = u.key", base=_BASE, upd=_UPD))
def m4(spark, sf_dir):
    """New notes over old where there are any; values always."""
    return T.merged(base(spark, sf_dir), updates(spark, sf_dir), ["key"], always=("value",))


@query("m5_insert_ignore", sql("", "SELECT * FROM base UNION ALL SELECT * FROM upd WHERE key NOT IN (SELECT key FROM base)", base=_BASE, upd=_UPD))
def m5(spark, sf_dir):
    return T.ignored(base(spark, sf_dir), updates(spark, sf_dir), ["key"])


@query("m2_review", sql("memories", "SELECT id, CASE WHEN source_type = 'inference' AND id % 5 = 2 THEN 'durable' WHEN source_type = 'inference' AND id % 5 = 3 THEN 'rejected' ELSE status END AS status FROM memories"))
def m2(spark, sf_dir):
    i = F.col("id") % 5
    return M.reviewed(B.memories(spark, sf_dir), i == 2, i == 3).select("id", "status")


@query("m2b_delete_cascade", sql("memories edges vectors", "SELECT 'memories' AS name, count(*) AS n FROM memories WHERE status <> 'rejected' UNION ALL SELECT 'edges', count(*) FROM edges WHERE from_id NOT IN (SELECT id FROM memories WHERE status = 'rejected') AND to_id NOT IN (SELECT id FROM memories WHERE status = 'rejected') UNION ALL SELECT 'vectors', count(*) FROM vectors WHERE memory_id NOT IN (SELECT id FROM memories WHERE status = 'rejected')"))
def m2b(spark, sf_dir):
    """Rejected memories go, with their edges at either end and their vectors."""
    m = B.memories(spark, sf_dir)
    out = T.deleted(m.where("status = 'rejected'").select("id"), m, {"edges": (B.edges(spark, sf_dir), ["from_id", "to_id"]), "vectors": (B.embeddings(spark, sf_dir), ["memory_id"])})
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit("memories" if k == "parent" else k).alias("name"), "n") for k, df in out.items()]
    return counts[0].union(counts[1]).union(counts[2])


@query("m1_append", sql("memories", "SELECT source_type, status, count(*) AS n FROM (SELECT source_type, status FROM memories UNION ALL SELECT 'teaching', 'durable' FROM customer UNION ALL SELECT 'inference', 'provisional' FROM supplier) GROUP BY ALL"))
def m1(spark, sf_dir):
    """Teachings enter durable, inferences provisional."""
    new = table(spark, sf_dir, "customer").select(F.lit("teaching").alias("source_type"), F.lit("durable").alias("status")).union(table(spark, sf_dir, "supplier").select(F.lit("inference"), F.lit("provisional")))
    return T.counts(B.memories(spark, sf_dir).select("source_type", "status").unionByName(new), "source_type", "status")


_QUEUE = "SELECT o_orderkey AS id, 'item ' || o_orderpriority AS trigger, o_totalprice AS priority, o_orderdate AS created, CASE o_orderstatus WHEN 'O' THEN 'pending' ELSE 'done' END AS state FROM orders"


def queue(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("item "), "o_orderpriority").alias("trigger"), F.col("o_totalprice").alias("priority"), F.col("o_orderdate").alias("created"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("done").alias("state"))


@query("t7_priority_queue", sql("", "SELECT id, trigger FROM queue WHERE state = 'pending' ORDER BY priority DESC, created, id LIMIT 5", queue=_QUEUE))
def t7(spark, sf_dir):
    return queue(spark, sf_dir).where("state = 'pending'").orderBy(F.col("priority").desc(), "created", "id").limit(5).select("id", "trigger")


@query("m6_mark_surfaced", sql("", "SELECT CASE WHEN id IN (SELECT id FROM queue WHERE state = 'pending' ORDER BY priority DESC, created, id LIMIT 5) THEN 'surfaced' ELSE state END AS state, count(*) AS n FROM queue GROUP BY 1", queue=_QUEUE))
def m6(spark, sf_dir):
    q = queue(spark, sf_dir)
    top = q.where("state = 'pending'").orderBy(F.col("priority").desc(), "created", "id").limit(5).select("id", F.lit(True).alias("hit"))
    return T.counts(q.join(F.broadcast(top), "id", "left").withColumn("state", F.when(F.col("hit"), "surfaced").otherwise(F.col("state"))), "state")  # five rows


_LAYERS = f"(SELECT 'queue' AS layer, id FROM ({_QUEUE}) WHERE state = 'pending' ORDER BY priority DESC, created, id LIMIT 5) UNION ALL (SELECT 'observation', id FROM memories WHERE source_type = 'journal' ORDER BY created_at DESC, id LIMIT 10) UNION ALL (SELECT 'insight', id FROM memories WHERE memory_type = 'insight' ORDER BY created_at DESC, id LIMIT 5)"


@query("q12_brain_context", sql("memories", _LAYERS))
def q12(spark, sf_dir):
    m = B.memories(spark, sf_dir)
    newest = lambda cond, n, name: T.newest(m.where(cond), n, "created_at", "id").select(F.lit(name).alias("layer"), "id")
    return t7(spark, sf_dir).select(F.lit("queue").alias("layer"), "id").union(newest("source_type = 'journal'", 10, "observation")).union(newest("memory_type = 'insight'", 5, "insight"))


@query("a18_log_sums", sql("sleep", "SELECT count(*) AS cycles, sum(edges_created)::BIGINT AS edges, sum(memories_expired)::BIGINT AS expired, sum(embeddings_backfilled)::BIGINT AS vectors, count(*) FILTER (edges_created > 0) AS linking FROM sleep"))
def a18(spark, sf_dir):
    """Totals over the log of maintenance cycles."""
    return B.sleep_log(spark, sf_dir).agg(F.count(F.lit(1)).alias("cycles"), F.sum("edges_created").alias("edges"), F.sum("memories_expired").alias("expired"),
                                          F.sum("embeddings_backfilled").alias("vectors"), T.count_if(F.col("edges_created") > 0).alias("linking"))


def _figures() -> str:
    """SQL of the checks over single memories: (check, figure, whether it passes)."""
    count = lambda c: f"count(*) FILTER ({c})"
    share = lambda c, of="TRUE", digits=1: f"round({count(c)} * 100 / greatest({count(of)}, 1), {digits})"
    teaching, inference, correction, provisional = "source_type = 'teaching'", "source_type = 'inference'", "memory_type = 'correction'", "status = 'provisional'"
    has_ttl = share(f"{provisional} AND review_after IS NOT NULL", provisional)
    rules = [
        ("1a", share("source_type IS NOT NULL AND source_type <> ''", digits=2), "{} >= 99"),
        ("1b", share("proposed_by IS NOT NULL AND proposed_by <> ''", digits=2), "{} >= 99"),
        ("1c", count(f"{teaching} AND proposed_by = 'system'"), "{} = 0"),
        ("1d", count(f"{inference} AND proposed_by = 'user'"), "{} = 0"),
        ("1e", count(f"{teaching} AND memory_type IN ('insight', 'pattern', 'dream')"), "{} = 0"),
        ("1f", count("access_count > 5 AND (source_type IS NULL OR proposed_by IS NULL)"), "{} = 0"),
        ("2a", count(correction), "{} > 0"),
        ("2b", count("status = 'expired' OR status = 'rejected'"), "{} > 0"),
        ("2c", share(f"{correction} AND context IS NOT NULL AND context <> ''", correction), "{} >= 80"),
        ("3a", count(f"{teaching} AND proposed_by = 'assistant'"), "{} = 0"),
        ("3b", share(f"{inference} AND (confidence < 1.0 OR confidence IS NULL)", inference), "{} >= 10"),
        ("3c", has_ttl, f"({count(provisional)} = 0 OR {{}} >= 80)"),
        ("3d", share(f"{inference} AND confidence >= 0.95", inference), "{} < 90"),
        ("3e", count("needs_user_confirmation"), "TRUE"),
        ("4a", count("counterweight_type IS NOT NULL"), "{} > 0"),
        ("4b", count("consent_level IS NOT NULL AND consent_level <> ''"), "{} > 0"),
        ("4c", count("consent_level = 'low' AND is_core"), "TRUE"),
        ("4d", count("retrieval_weight <> 1.0"), "{} > 0"),
    ]
    return "\nUNION ALL ".join(f"SELECT '{k}' AS check_id, ({m})::DOUBLE AS metric, {ok.format(m)} AS pass FROM memories" for k, m, ok in rules)


_AUDIT = _figures() + f"""
UNION ALL SELECT '2d', count(*), count(*) = 0 FROM ring JOIN memories ON id = memory_id WHERE status = 'expired'
UNION ALL SELECT '2e', count(DISTINCT to_id), count(DISTINCT to_id) = 0 FROM edges JOIN memories a ON a.id = from_id JOIN memories b ON b.id = to_id
    WHERE a.source_type = 'teaching' AND a.status IN ('expired', 'rejected') AND b.source_type = 'inference' AND b.status = 'durable'
UNION ALL SELECT '2f', count(*), count(*) > 0 OR (SELECT count(*) FROM memories WHERE memory_type = 'correction') = 0 FROM edges JOIN memories ON id = from_id WHERE memory_type = 'correction'
UNION ALL SELECT '5c', count(DISTINCT access_count), max(access_count) > min(access_count) AND count(DISTINCT access_count) > 3 FROM memories WHERE status = 'durable'
UNION ALL SELECT '5d', count(*) FILTER (edges_created > 0 AND cycle_start > {AS_OF} - INTERVAL 7 DAY), count(*) > 0 FROM sleep
UNION ALL SELECT '5e', round(max(n) * 100 / sum(n), 1), count(*) > 1 AND max(n) * 100 / sum(n) < 80 FROM (
    SELECT strftime(created_at, '%Y-%m') AS month, count(*) AS n FROM memories WHERE status = 'durable' GROUP BY 1)"""


@query("e_quality_audit", sql("memories ring edges sleep", _AUDIT))
def audits(spark, sf_dir):
    """The data checks of E1 to E5, each with its figure."""
    return M.audit(B.memories(spark, sf_dir), B.ring(spark, sf_dir), B.edges(spark, sf_dir), B.sleep_log(spark, sf_dir), as_of())


#: Phrases of a durable text that make it a correction, in a boot summary and, further ones, in the loop's.
CORRECTIONS = ("correction", "coasting")
LOOP_CORRECTIONS = (*CORRECTIONS, "caught", "wrong", "not an observer")
#: A word that the sample texts have, so that the lists have rows.
SAMPLE_WORD, NAME = "idiot", "ctx 1"
_HOLDS = lambda words: "(" + " OR ".join(f"contains(lower(raw_text), '{w}')" for w in words) + ")"
_LIST = lambda name, cond, n, of="memories": f"SELECT * FROM (SELECT '{name}' AS part, id, row_number() OVER (ORDER BY created_at DESC, id) AS n FROM {of} WHERE {cond}) WHERE n <= {n}"
_SOURCES = "\nUNION ALL ".join([
    _LIST("identity", "is_core AND status NOT IN ('rejected', 'expired')", 10), _LIST("recent", f"created_at >= {AS_OF} - INTERVAL 24 HOUR AND status NOT IN ('rejected', 'expired')", 15),
    _LIST("journal", "source_type = 'journal' AND status <> 'rejected'", 3), _LIST("correction", "status = 'durable' AND " + _HOLDS((*CORRECTIONS, SAMPLE_WORD)), 3, "told"),
])
_TOLD = "SELECT m.*, raw_text FROM memories m JOIN texts USING (id) WHERE status = 'durable'"


def holding(m, words):
    """Durable memories (with raw_text) whose text holds any of ``words``."""
    any_ = F.lit(False)
    for w in words:
        any_ = any_ | A.holds("raw_text", w)
    return m.where("status = 'durable'").where(any_)


def listed(parts):
    """(part, id) of (name, rows, n): the n newest of each."""
    out = None
    for name, rows, n in parts:
        one = T.newest(rows, n, "created_at", "id").select(F.lit(name).alias("part"), "id")
        out = one if out is None else out.union(one)
    return out


def boot_lists(m, told, words=CORRECTIONS):
    """Identity, the last day, journals and corrections of a boot summary, newest first; ``told`` are memories with their texts."""
    stands = "status NOT IN ('rejected', 'expired')"
    return listed([("identity", m.where(f"is_core AND {stands}"), 10), ("recent", m.where(f"created_at >= TIMESTAMP_NTZ '2024-01-30 00:00:00' AND {stands}"), 15),
                   ("journal", m.where("source_type = 'journal' AND status <> 'rejected'"), 3), ("correction", holding(told, words), 3)])


def loop_lists(m, told, name, day, before, words=LOOP_CORRECTIONS):
    """What the loop's summary lists: core memories that name someone, corrections, and the memories of a day and of the day before."""
    durable = m.where("status = 'durable'")
    named = told.where("status = 'durable' AND is_core").where(A.holds("raw_text", name) | A.holds(F.coalesce("context", F.lit("")), name))
    on = lambda d: durable.where(F.to_date("created_at") == F.lit(d).cast("date"))
    return listed([("identity", named, 5), ("correction", holding(told, words), 5), ("today", on(day), 10), ("yesterday", on(before), 10)])


@query("q9b_boot_lists", sql("memories texts", "SELECT part, id FROM sources", told=_TOLD, sources=_SOURCES))
def q9b(spark, sf_dir):
    """Corrections are durable texts that hold one of the phrases, whatever their type; a word of the sample texts stands beside these."""
    return boot_lists(B.memories(spark, sf_dir), B.memories(spark, sf_dir, text=True), (*CORRECTIONS, SAMPLE_WORD))


@query("q9d_state_map", sql("state_log", "SELECT key, value, updated_at FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY updated_at DESC, event_id DESC) AS n FROM state_log) WHERE n = 1"))
def q9d(spark, sf_dir):
    """The state as its last writes have it (M3)."""
    return M.state_map(B.state_log(spark, sf_dir))


@query("q9e_boot_day", sql("memories latest", """SELECT 'type' AS part, memory_type AS key, count(*) AS n, NULL::DOUBLE AS valence_mean FROM affected WHERE date = DATE '2024-01-30' GROUP BY 2
    UNION ALL SELECT 'hour', hour(created_at)::VARCHAR, count(*), round(avg(valence), 6) FROM affected WHERE date = DATE '2024-01-30' AND valence IS NOT NULL GROUP BY 2""", affected=Y._ROWS))
def q9e(spark, sf_dir):
    """The day's types and its arc by the hour, as a boot summary has them."""
    day = Y.rows(spark, sf_dir).where("date = DATE '2024-01-30'")
    types = T.counts(day, "memory_type").select(F.lit("type").alias("part"), F.col("memory_type").alias("key"), "n", F.lit(None).cast("double").alias("valence_mean"))
    arc = day.where("valence IS NOT NULL").groupBy(F.hour("created_at").cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("valence"), 6).alias("valence_mean"))
    return types.union(arc.select(F.lit("hour"), "key", "n", "valence_mean"))


_LOOP = "\nUNION ALL ".join([
    _LIST("identity", f"is_core AND (contains(lower(raw_text), '{NAME}') OR contains(lower(coalesce(context, '')), '{NAME}'))", 5, "told"), _LIST("correction", _HOLDS((*LOOP_CORRECTIONS, SAMPLE_WORD)), 5, "told"),
    _LIST("today", "status = 'durable' AND created_at::DATE = DATE '2024-01-30'", 10), _LIST("yesterday", "status = 'durable' AND created_at::DATE = DATE '2024-01-29'", 10),
])


@query("q9f_loop_lists", sql("memories texts", f"SELECT part, id FROM ({_LOOP})", told=_TOLD))
def q9f(spark, sf_dir):
    return loop_lists(B.memories(spark, sf_dir), B.memories(spark, sf_dir, text=True), NAME, "2024-01-30", "2024-01-29", (*LOOP_CORRECTIONS, SAMPLE_WORD))


@query("q9g_last_affects", sql("memories affect", "SELECT id, model, round(valence, 6) AS valence, round(arousal, 6) AS arousal FROM memories JOIN affect ON memory_id = id WHERE status = 'durable' ORDER BY created_at DESC, id, model LIMIT 5"))
def q9g(spark, sf_dir):
    """The last five affect rows of durable memories, every model's."""
    five = T.newest(B.memories(spark, sf_dir).where("status = 'durable'").select("id", "created_at"), 5, "created_at", "id")  # each has one row at least
    a = B.affect(spark, sf_dir).withColumnRenamed("memory_id", "id").join(F.broadcast(five), "id")
    return a.orderBy(F.col("created_at").desc(), "id", "model").limit(5).select("id", "model", r6("valence"), r6("arousal"))


@query("q9c_boot_arc", sql("memories latest", "SELECT date, memory_count, round(valence_mean, 6) AS valence_mean, round(arousal_mean, 6) AS arousal_mean FROM daily ORDER BY date DESC LIMIT 7", affected=Y._ROWS, daily=Y._DAILY))
def q9c(spark, sf_dir):
    """The last seven days of a boot summary."""
    days = Y.daily(spark, sf_dir).orderBy(F.col("date").desc()).limit(7)
    return days.select("date", "memory_count", r6("valence_mean"), r6("arousal_mean"))


@query("q9_boot_summary", sql("memories latest edges", f"""SELECT (SELECT count(*) FROM memories WHERE status = 'durable') AS durable, (SELECT count(*) FROM edges) AS edges, (SELECT round(avg(valence), 6) FROM affected WHERE date = DATE '2024-01-30') AS last_day_valence,
    (SELECT count(*) FROM memories WHERE created_at >= {AS_OF} - INTERVAL 24 HOUR) AS last_24h, (SELECT max(id) FROM memories WHERE source_type = 'journal') AS last_journal,
    (SELECT count(*) FROM memories WHERE status <> 'rejected') AS total, (SELECT count(*) FROM memories WHERE status = 'provisional') AS provisional,
    (SELECT count(*) FROM affected WHERE date = DATE '2024-01-30') AS last_day_memories, (SELECT round(avg(arousal), 6) FROM affected WHERE date = DATE '2024-01-30') AS last_day_arousal""", affected=Y._ROWS))
def q9(spark, sf_dir):
    """One row of what a session starts from; ``lorekeep.sources.exports.write_snapshot`` writes it."""
    m = B.memories(spark, sf_dir)
    parts = [
        m.agg(T.count_if(F.col("status") == "durable").alias("durable"), T.count_if(F.expr("created_at >= TIMESTAMP_NTZ '2024-01-30 00:00:00'")).alias("last_24h"), F.max(F.when(F.col("source_type") == "journal", F.col("id"))).alias("last_journal"),
              T.count_if(F.col("status") != "rejected").alias("total"), T.count_if(F.col("status") == "provisional").alias("provisional")),
        B.edges(spark, sf_dir).agg(F.count(F.lit(1)).alias("edges")), Y.rows(spark, sf_dir).where("date = DATE '2024-01-30'").agg(
            F.round(F.avg("valence"), 6).alias("last_day_valence"), F.count(F.lit(1)).alias("last_day_memories"), F.round(F.avg("arousal"), 6).alias("last_day_arousal")),
    ]
    return T.side_by_side(*parts)


_PART = lambda name, cond, n, order="created_at DESC, id": f"SELECT * FROM (SELECT '{name}' AS part, id, row_number() OVER (ORDER BY {order}) AS place, NULL AS value FROM memories WHERE {cond}) WHERE place <= {n}"
_CW = """SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY counterweight_type ORDER BY md5(id || '|7'), id) AS n FROM memories WHERE status = 'durable' AND counterweight_type IS NOT NULL)
    WHERE n = 1 AND id NOT IN (SELECT id FROM found)"""
_BACK = """SELECT id, row_number() OVER (ORDER BY md5(id || '|7'), id) AS n FROM memories WHERE status = 'durable' AND memory_type IN ('breakthrough', 'promise', 'identity') AND is_core
    AND id NOT IN (SELECT id FROM found) AND id NOT IN (SELECT id FROM cw)"""
_SNAPSHOT = f"""SELECT datediff('microsecond', made, {AS_OF}) / 6e7 AS age, (SELECT count(*) FROM memories WHERE status <> 'rejected' AND created_at <= made) AS had, (SELECT count(*) FROM memories WHERE status <> 'rejected') AS has
    FROM (SELECT max(created_at) AS made FROM memories WHERE source_type = 'journal')"""
_MIRROR = """SELECT *, row_number() OVER (ORDER BY started_at DESC, user_id) AS place, round(least(1.0, CASE WHEN boot_ran THEN 0.4 ELSE 0 END + CASE WHEN timestamp_logged THEN 0.1 ELSE 0 END + CASE WHEN exchanges_stored >= 1 THEN 0.3 ELSE 0 END
    + CASE WHEN exchanges_stored >= 3 THEN 0.1 ELSE 0 END + CASE WHEN heartbeats_sent >= 1 THEN 0.1 ELSE 0 END)::DOUBLE * 100)::BIGINT AS score FROM (SELECT * FROM sessions ORDER BY started_at DESC, user_id LIMIT 5)"""
_START = "\nUNION ALL ".join([
    _PART("journal", "source_type = 'journal' AND status <> 'rejected'", 1), "SELECT 'resonant', id, row_number() OVER (ORDER BY score DESC, is_core DESC, updated_at DESC, id), NULL FROM found", "SELECT 'counterweight', id, NULL, NULL FROM cw",
    "SELECT 'counterweight', id, NULL, 'fallback' FROM back WHERE (SELECT count(*) FROM cw) < 2 AND n <= 3 - (SELECT count(*) FROM cw)",
    _PART("correction", "memory_type = 'correction' AND status = 'durable'", 3), _PART("today", "status = 'durable' AND created_at::DATE = DATE '2024-01-30'", 5), "SELECT 'brain ' || layer, id, NULL, NULL FROM layers",
    "SELECT 'durable', count(*), NULL, NULL FROM memories WHERE status = 'durable'",
    "SELECT 'boot', CASE WHEN age < 60 THEN had ELSE has END, CASE WHEN age < 60 THEN floor(age)::BIGINT ELSE -1 END, CASE WHEN age < 60 THEN 'fresh' ELSE 'refreshed' END FROM snap",
    "SELECT 'state ' || key, NULL, NULL, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY updated_at DESC, event_id DESC) AS n FROM state_log) WHERE n = 1 AND key IN ('mood', 'last_journal_at', 'last_sleep_cycle')",
    "SELECT 'session', user_id, place, 'boot ' || boot_ran || ', exchanges ' || exchanges_stored || ', score ' || score FROM mirror WHERE place <= 3",
    "SELECT 'compliance', count(*), round(avg(boot_ran::INT) * 100)::BIGINT, CASE WHEN avg(boot_ran::INT) < 0.6 THEN 'warning' END FROM mirror", "SELECT 'exchanges', round(avg(exchanges_stored) * 10)::BIGINT, NULL, NULL FROM mirror",
])


def snapshot_status(m, as_of):
    """(total, age, status) of the snapshot that the last journal entry made: while it is fresh its own number of memories and its age in
    minutes; a stale or cold one is refreshed, so that it has the present number and no age (-1)."""
    made = m.where("source_type = 'journal'").agg(F.max("created_at")).first()[0]  # one value
    at = F.lit(made).cast("timestamp_ntz")
    counts = m.where("status <> 'rejected'").agg(T.count_if(F.col("created_at") <= at).alias("had"), F.count(F.lit(1)).alias("has"))
    age = A.age_seconds(at, as_of) / 60
    fresh = A.freshness(age) == "fresh"
    return counts.select(F.when(fresh, F.col("had")).otherwise(F.col("has")).alias("total"), F.when(fresh, F.floor(age)).otherwise(-1).alias("age"), F.when(fresh, "fresh").otherwise("refreshed").alias("status"))


def mirror(sessions, n: int = 5, shown: int = 3):
    """(part, id, place, value) of the last ``n`` sessions: each of the first ``shown``, the share that ran the boot, with a warning
    under 60 percent, and ten times the mean of exchanges."""
    last = sessions.orderBy(F.col("started_at").desc(), "user_id").limit(n)
    place = F.row_number().over(Window.orderBy(F.col("started_at").desc(), "user_id"))  # n rows
    score = F.round(A.compliance("boot_ran", "timestamp_logged", "exchanges_stored", "heartbeats_sent") * 100).cast("bigint")
    text = F.concat(F.lit("boot "), F.col("boot_ran").cast("string"), F.lit(", exchanges "), F.col("exchanges_stored").cast("string"), F.lit(", score "), score.cast("string"))
    each = last.select(F.lit("session").alias("part"), F.col("user_id").alias("id"), place.cast("bigint").alias("place"), text.alias("value")).where(F.col("place") <= shown)
    ran = F.avg(F.col("boot_ran").cast("int"))
    rate = last.agg(F.count(F.lit(1)).alias("id"), F.round(ran * 100).cast("bigint").alias("place"), F.when(ran < 0.6, "warning").alias("value"))
    mean = last.agg(F.round(F.avg("exchanges_stored") * 10).cast("bigint").alias("id"))
    return each.union(rate.select(F.lit("compliance"), "id", "place", "value")).union(mean.select(F.lit("exchanges"), "id", F.lit(None).cast("bigint"), F.lit(None).cast("string")))


@query("q2_thread_start", sql(X._TABLES + " sessions state_log", _START, hundred=X._HUNDRED, cheaply=X._CHEAP, short="SELECT * FROM cheaply ORDER BY cheap DESC, id LIMIT 30", scored=X.SCORED, blended=X.BLENDED,
    found="SELECT * FROM blended ORDER BY score DESC, is_core DESC, updated_at DESC, id LIMIT 5", layers=_LAYERS, cw=_CW, back=_BACK, snap=_SNAPSHOT, mirror=_MIRROR))
def q2(spark, sf_dir):
    """The parts of a warm start in one frame (part, id, place, value): the last journal, the snapshot with its age or refreshed, the state's
    three keys, the memories that resonate with the sample state by two-stage retrieval, counterweights to it with their fallback,
    corrections, the day's memories, the layers above, the mirror of the last sessions, and the number of durable memories. The
    lists and the arc of a refreshed snapshot are q9b to q9g."""
    m = B.memories(spark, sf_dir)
    order = Window.orderBy(F.col("created_at").desc(), "id")  # over the few rows of a part
    whole = lambda name, df, **c: df.select(F.lit(name).alias("part"), *[c.get(k, F.lit(None)).cast(t).alias(k) for k, t in (("id", "bigint"), ("place", "bigint"), ("value", "string"))])
    placed = lambda name, df: whole(name, df, id=F.col("id"), place=F.row_number().over(order))
    best = T.pinned(X.two_stage(spark, sf_dir))  # five rows
    by_score = Window.orderBy(F.col("score").desc(), F.col("is_core").desc(), F.col("updated_at").desc(), "id")  # five rows
    today = m.where("status = 'durable' AND created_at >= TIMESTAMP_NTZ '2024-01-30 00:00:00' AND created_at < TIMESTAMP_NTZ '2024-01-31 00:00:00'")
    state = M.state_map(B.state_log(spark, sf_dir)).where(F.col("key").isin("mood", "last_journal_at", "last_sleep_cycle"))
    parts = [
        placed("journal", T.newest(m.where("source_type = 'journal' AND status <> 'rejected'"), 1, "created_at", "id")),
        whole("resonant", best, id=F.col("id"), place=F.row_number().over(by_score)),
        whole("counterweight", R.counterweights(m, best.select("id"), strict=True), id=F.col("id"), value=F.when(F.col("stage") == 1, "fallback")),
        placed("correction", T.newest(m.where("memory_type = 'correction' AND status = 'durable'"), 3, "created_at", "id")),
        placed("today", T.newest(today, 5, "created_at", "id")),
        q12(spark, sf_dir).select(F.concat(F.lit("brain "), "layer").alias("part"), "id", F.lit(None).cast("bigint").alias("place"), F.lit(None).cast("string").alias("value")),
        whole("durable", m.agg(T.count_if(F.col("status") == "durable").alias("id")), id=F.col("id")),
        whole("boot", snapshot_status(m, as_of()), id=F.col("total"), place=F.col("age"), value=F.col("status")),
        state.select(F.concat(F.lit("state "), "key").alias("part"), F.lit(None).cast("bigint").alias("id"), F.lit(None).cast("bigint").alias("place"), "value"),
        mirror(B.sessions(spark, sf_dir)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
