"""Filters, projections, joins, aggregates and scalar functions, one query each."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import affect as A
from ..operators import maintenance as M
from ..operators import retrieval as R
from ..operators.quantiles import positional_quantiles
from ..operators import tables as T
from ..operators import trigrams
from ..session import TABLES, table
from ..sources import bridge as B
from .catalog import query
from .oracle import AS_OF, sql
from .retrieval import RECENCY, STATE, as_of, distance

NTZ = "TIMESTAMP_NTZ '2024-01-31 00:00:00'"


@query("s1_table_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'")
def s1(spark, sf_dir):
    """Two columns and a pushed filter."""
    return table(spark, sf_dir, "orders").where("o_orderdate >= TIMESTAMP_NTZ '1997-01-01 00:00:00'").select("o_orderkey", "o_totalprice")


@query("s9_catalog", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in TABLES))
def s9(spark, sf_dir):
    """Tables and their row counts."""
    out = None
    for t in TABLES:
        one = table(spark, sf_dir, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("name"), "n")
        out = one if out is None else out.union(one)
    return out


@query("s9b_columns", """SELECT table_name AS name, column_name AS col, (row_number() OVER (PARTITION BY table_name ORDER BY column_index) - 1)::BIGINT AS place FROM duckdb_columns() WHERE table_name IN (""" + ", ".join(f"'{t}'" for t in TABLES) + ")")
def s9b(spark, sf_dir):
    """Tables and their columns, from the files' schemas alone."""
    rows = [(t, c, i) for t in TABLES for i, c in enumerate(table(spark, sf_dir, t).columns)]
    return spark.createDataFrame(rows, "name string, col string, place bigint")


@query("f1_eligible", sql("memories", "SELECT id, memory_type, source_type FROM memories WHERE status NOT IN ('rejected', 'expired') AND consent_level <> 'high' AND memory_type = 'insight'"))
def f1(spark, sf_dir):
    """Unknown filter keys are ignored; a null consent is out."""
    return R.eligible(B.memories(spark, sf_dir), {"memory_type": "insight", "colour": "red"}).select("id", "memory_type", "source_type")


@query("f1b_eligible_sensitive", sql("memories", "SELECT count(*) AS n FROM memories WHERE status NOT IN ('rejected', 'expired')"))
def f1b(spark, sf_dir):
    return R.eligible(B.memories(spark, sf_dir), {"include_sensitive": "true"}).agg(F.count(F.lit(1)).alias("n"))


@query("f2_status_equality", sql("memories", "SELECT status, is_core, needs_user_confirmation, count(*) AS n FROM memories WHERE status IN ('durable', 'provisional') GROUP BY ALL"))
def f2(spark, sf_dir):
    return T.counts(B.memories(spark, sf_dir).where(F.col("status").isin("durable", "provisional")), "status", "is_core", "needs_user_confirmation")


@query("f3_substring_match", "SELECT doc_id FROM documents WHERE contains(lower(text), 'the and')")
def f3(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(A.holds("text", "The AND")).select("doc_id")


@query("f3b_indexed_substring", "SELECT doc_id FROM documents WHERE contains(lower(text), 'the and')")
def f3b(spark, sf_dir):
    """By an index of trigrams: blocks without the rarest ones of the phrase aren't read."""
    return trigrams.build(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", blocks=64, buckets=8).holding(spark, "The AND").select("doc_id")


@query("f4_keyword_predicate", "SELECT doc_id, contains(lower(text), '100%') OR contains(lower(text), 'mit_license') AS marked, contains(lower(text), 'licens') AS licence FROM documents WHERE contains(lower(text), 'licens') OR contains(lower(text), '%')")
def f4(spark, sf_dir):
    """Signs that LIKE would take for wildcards are literal."""
    d = table(spark, sf_dir, "documents").where(A.holds("text", "licens") | A.holds("text", "%"))
    return d.select("doc_id", (A.holds("text", "100%") | A.holds("text", "mit_license")).alias("marked"), A.holds("text", "licens").alias("licence"))


@query("f5_day_filter", sql("memories", "SELECT id FROM memories WHERE created_at::DATE = DATE '2024-01-15'"))
def f5(spark, sf_dir):
    """A day as a range, so that it reaches the scan."""
    return B.memories(spark, sf_dir).where("created_at >= TIMESTAMP_NTZ '2024-01-15 00:00:00' AND created_at < TIMESTAMP_NTZ '2024-01-16 00:00:00'").select("id")


@query("f6_time_range", sql("memories", f"SELECT id, source_type FROM memories WHERE created_at >= {AS_OF} - INTERVAL 24 HOUR AND created_at < {AS_OF}"))
def f6(spark, sf_dir):
    """The true last 24 hours."""
    return B.memories(spark, sf_dir).where(f"created_at >= {NTZ} - INTERVAL 24 HOURS AND created_at < {NTZ}").select("id", "source_type")


@query("f7_null_or_empty", sql("memories", "SELECT count(*) FILTER (context IS NULL OR context = '') AS no_context, count(*) FILTER (proposed_by IS NULL OR proposed_by = '') AS no_proposer, count(*) FILTER (consent_level IS NULL) AS no_consent FROM memories"))
def f7(spark, sf_dir):
    blank = lambda c: T.count_if(F.col(c).isNull() | (F.col(c) == ""))
    return B.memories(spark, sf_dir).agg(blank("context").alias("no_context"), blank("proposed_by").alias("no_proposer"), blank("consent_level").alias("no_consent"))


@query("f8_truncated", "SELECT doc_id, left(text, 80) AS head, length(left(text, 300)) AS n FROM documents")
def f8(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 80).alias("head"), F.length(F.substring("text", 1, 300)).cast("bigint").alias("n"))


@query("f9_journal_filter", sql("journal", "SELECT id, ts FROM journal WHERE entry_type = 'en' AND ts::DATE = DATE '2024-01-05' AND (contains(lower(title), 'the') OR contains(lower(description), 'the')) ORDER BY ts DESC, id LIMIT 20"))
def f9(spark, sf_dir):
    return journal_entries(B.journal(spark, sf_dir), "en", "2024-01-05", "the", 20).select("id", "ts")


def journal_entries(journal, entry_type=None, day=None, search=None, limit=20):
    """Optional filters by type, day and text in title or description; newest first."""
    if entry_type:
        journal = journal.where(F.col("entry_type") == entry_type)
    if day:
        journal = journal.where(F.to_date("ts") == F.lit(day).cast("date"))
    if search:
        journal = journal.where(A.holds("title", search) | A.holds("description", search))
    return journal.orderBy(F.col("ts").desc(), "id").limit(limit)


@query("j1_affect_fan_out", sql("memories affect", "SELECT m.id, model, round(valence, 6) AS valence FROM memories m LEFT JOIN affect a ON a.memory_id = m.id WHERE status = 'provisional'"))
def j1(spark, sf_dir):
    """A row per affect model: memories with two come out twice."""
    a = B.affect(spark, sf_dir).select(F.col("memory_id").alias("id"), "model", F.round("valence", 6).alias("valence"))
    return B.memories(spark, sf_dir).where("status = 'provisional'").select("id").join(a, "id", "left")


@query("j2_latest_affect", sql("latest", "SELECT memory_id, model, round(valence, 6) AS valence FROM latest"))
def j2(spark, sf_dir):
    return R.latest_affect(B.affect(spark, sf_dir)).select("memory_id", "model", F.round("valence", 6).alias("valence"))


@query("j3_edge_endpoints", sql("memories latest edges", """SELECT e.from_id, e.to_id, e.edge_type, a.e1 AS from_first, round(b.valence, 6) AS to_valence FROM edges e
    JOIN memories m ON m.id = e.from_id AND m.status = 'durable' JOIN memories n ON n.id = e.to_id AND n.status = 'durable' LEFT JOIN latest a ON a.memory_id = e.from_id LEFT JOIN latest b ON b.memory_id = e.to_id"""))
def j3(spark, sf_dir):
    """Both ends durable (as semi-joins), with their affect."""
    durable = B.memories(spark, sf_dir).where("status = 'durable'").select("id")
    a = R.latest_affect(B.affect(spark, sf_dir))
    first = {**B.FIRST}
    name = F.filter(F.map_keys("emotions"), lambda k: k.isin(*first.values()))
    e = B.edges(spark, sf_dir).join(durable.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(durable.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    e = e.join(a.select(F.col("memory_id").alias("from_id"), F.get(name, F.lit(0)).alias("from_first")), "from_id", "left").join(a.select(F.col("memory_id").alias("to_id"), F.round("valence", 6).alias("to_valence")), "to_id", "left")
    return e.select("from_id", "to_id", "edge_type", "from_first", "to_valence")


_ISLANDS = "SELECT 'island ' || (user_id % 25) AS island, id FROM memories WHERE is_core"


@query("j5_island_members", sql("memories", "SELECT island, page, n, m.id, m.memory_type, m.status FROM paged p JOIN memories m ON m.id = p.id", islands=_ISLANDS,
    paged="SELECT island, id, (row_number() OVER (PARTITION BY island ORDER BY id) - 1) // 50 AS page, count(*) OVER (PARTITION BY island) AS n FROM islands"))
def j5(spark, sf_dir):
    """Named groups' members with their memories, a row a member, numbered in pages of fifty by id; n is the group's size."""
    m = B.memories(spark, sf_dir)
    members = m.where("is_core").select(F.concat(F.lit("island "), (F.col("user_id") % 25).cast("string")).alias("island"), "id")
    return T.paged(members, "island", "id", 50).join(m.select("id", "memory_type", "status"), "id").select("island", "page", "n", "id", "memory_type", "status")


@query("j6_missing_embeddings", sql("memories vectors", "SELECT id FROM memories WHERE id NOT IN (SELECT memory_id FROM vectors)"))
def j6(spark, sf_dir):
    return B.memories(spark, sf_dir).select("id").join(B.embeddings(spark, sf_dir).select(F.col("memory_id").alias("id")), "id", "left_anti")


@query("j7_embedding_coverage", sql("memories vectors", "SELECT memory_type, count(*) AS n, count(v.memory_id) AS covered FROM memories LEFT JOIN vectors v ON v.memory_id = id GROUP BY 1"))
def j7(spark, sf_dir):
    v = B.embeddings(spark, sf_dir).select(F.col("memory_id").alias("v"))
    m = B.memories(spark, sf_dir)
    return m.join(v, m.id == v.v, "left").groupBy("memory_type").agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("covered"))


@query("j8_orphaned_inferences", sql("memories edges", """SELECT count(DISTINCT to_id) AS n FROM edges JOIN memories a ON a.id = from_id JOIN memories b ON b.id = to_id
    WHERE a.source_type = 'teaching' AND a.status IN ('expired', 'rejected') AND b.source_type = 'inference' AND b.status = 'durable'"""))
def j8(spark, sf_dir):
    return M.orphaned(B.memories(spark, sf_dir), B.edges(spark, sf_dir)).agg(F.count_distinct("to_id").alias("n"))


@query("j9_correction_edges", sql("memories edges", "SELECT edge_type, count(*) AS n FROM edges JOIN memories ON id = from_id WHERE memory_type = 'correction' GROUP BY 1"))
def j9(spark, sf_dir):
    c = B.memories(spark, sf_dir).where("memory_type = 'correction'").select(F.col("id").alias("from_id"))
    return T.counts(B.edges(spark, sf_dir).join(c, "from_id", "left_semi"), "edge_type")


@query("j14_free_slot", sql("ring", "SELECT min(slot) AS slot FROM range(30) t(slot) WHERE slot NOT IN (SELECT memory_id % 30 FROM ring)"))
def j14(spark, sf_dir):
    """The first slot not taken."""
    return T.free_slot(B.ring(spark, sf_dir).select((F.col("memory_id") % 30).alias("slot")), 30)


@query("a1_system_stats", sql("memories edges vectors ring", """SELECT count(*) AS total, count(*) FILTER (status = 'durable') AS durable, count(*) FILTER (status = 'provisional') AS provisional, count(*) FILTER (status = 'expired') AS expired,
    count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (is_core) AS core, count(*) FILTER (source_type = 'teaching') AS teachings, count(*) FILTER (source_type = 'inference') AS inferences, count(*) FILTER (source_type = 'exchange') AS exchanges,
    count(*) FILTER (counterweight_type IS NOT NULL) AS counterweights, count(*) FILTER (status = 'provisional' AND needs_user_confirmation) AS pending,
    (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM vectors) AS embedded, (SELECT count(*) FROM ring) AS ring FROM memories"""))
def a1(spark, sf_dir):
    """All counts of a table in one pass."""
    is_ = lambda c, v: T.count_if(F.col(c) == v)
    m = B.memories(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("total"), *(is_("status", v).alias(v) for v in ("durable", "provisional", "expired", "rejected")), T.count_if(F.col("is_core")).alias("core"),
        is_("source_type", "teaching").alias("teachings"), is_("source_type", "inference").alias("inferences"), is_("source_type", "exchange").alias("exchanges"),
        F.count("counterweight_type").alias("counterweights"), T.count_if((F.col("status") == "provisional") & F.col("needs_user_confirmation")).alias("pending"))
    rest = [df.agg(F.count(F.lit(1)).alias(name)) for name, df in (("edges", B.edges(spark, sf_dir)), ("embedded", B.embeddings(spark, sf_dir)), ("ring", B.ring(spark, sf_dir)))]
    return T.side_by_side(m, *rest)


@query("a2_dashboard_stats", sql("memories vectors sessions", """SELECT count(*) AS total, count(*) FILTER (created_at >= TIMESTAMP '2024-01-24') AS week, count(*) FILTER (v.memory_id IS NULL) AS missing, count(DISTINCT m.user_id) AS users,
    max(created_at) AS newest, sum(access_count)::BIGINT AS reads FROM memories m LEFT JOIN vectors v ON v.memory_id = id"""))
def a2(spark, sf_dir):
    v = B.embeddings(spark, sf_dir).select(F.col("memory_id").alias("v"))
    m = B.memories(spark, sf_dir)
    return m.join(v, m.id == v.v, "left").agg(F.count(F.lit(1)).alias("total"), T.count_if(F.expr("created_at >= TIMESTAMP_NTZ '2024-01-24 00:00:00'")).alias("week"), T.count_if(F.col("v").isNull()).alias("missing"),
                                              F.count_distinct("user_id").alias("users"), F.max("created_at").alias("newest"), F.sum("access_count").alias("reads"))


_DIST = ("memory_type", "source_type", "proposed_by", "status", "consent_level", "pattern_flag", "counterweight_type")


@query("a3_distributions", sql("memories", " UNION ALL ".join(f"SELECT '{c}' AS field, {c} AS value, count(*) AS n FROM memories GROUP BY {c}" for c in _DIST)))
def a3(spark, sf_dir):
    """Counts by each field: rows are unpivoted once and grouped in one pass."""
    m = B.memories(spark, sf_dir)
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in _DIST])
    return T.counts(m.select(F.explode(pairs).alias("p")).select("p.field", "p.value"), "field", "value")


@query("a4_degree_histogram", sql("memories degrees", "SELECT coalesce(degree, 0) AS degree, count(*) AS n FROM memories LEFT JOIN degrees USING (id) GROUP BY 1"))
def a4(spark, sf_dir):
    m = B.memories(spark, sf_dir).select("id").join(R.degrees(B.edges(spark, sf_dir)), "id", "left")
    return m.groupBy(F.coalesce("degree", F.lit(0)).alias("degree")).agg(F.count(F.lit(1)).alias("n"))


@query("a5_edge_degree", sql("degrees", "SELECT id, degree FROM degrees"))
def a5(spark, sf_dir):
    return R.degrees(B.edges(spark, sf_dir))


@query("a13_access_statistics", sql("memories", "SELECT min(access_count) AS least, max(access_count) AS most, round(avg(access_count), 6) AS mean, count(DISTINCT access_count) AS kinds, max(access_count) > min(access_count) AND count(DISTINCT access_count) > 3 AS pass FROM memories"))
def a13(spark, sf_dir):
    c = "access_count"
    return B.memories(spark, sf_dir).agg(F.min(c).alias("least"), F.max(c).alias("most"), F.round(F.avg(c), 6).alias("mean"), F.count_distinct(c).alias("kinds")).withColumn("pass", (F.col("most") > F.col("least")) & (F.col("kinds") > 3))


@query("a14_month_spread", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, round(count(*) / (SELECT count(*) FROM orders), 6) AS share FROM orders GROUP BY 1")
def a14(spark, sf_dir):
    from pyspark.sql import Window

    by = table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return by.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6))  # one row a month


@query("a16_journal_sessions", sql("journal", "SELECT entry_type, count(*) AS n, count(DISTINCT session_id) AS sessions, min(ts) AS first, max(ts) AS last FROM journal GROUP BY 1"))
def a16(spark, sf_dir):
    return B.journal(spark, sf_dir).groupBy("entry_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("session_id").alias("sessions"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@query("a17_repeated_titles", sql("journal", "SELECT title, count(*) AS n, min(id) AS keep FROM journal GROUP BY 1 HAVING count(*) > 1"))
def a17(spark, sf_dir):
    return B.journal(spark, sf_dir).groupBy("title").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("keep")).where("n > 1")


@query("a19_time_formats", """SELECT kind, count(*) AS n, round(count(*) * 100 / (SELECT count(*) FROM events), 6) AS percent FROM (SELECT CASE WHEN event_id % 3 = 0 THEN 'Z' WHEN event_id % 3 = 1 THEN 'offset' ELSE 'none' END AS kind FROM events) GROUP BY 1""")
def a19(spark, sf_dir):
    """Time strings by their ending."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("t"))
    s = e.select(F.concat("t", F.when(F.col("event_id") % 3 == 0, "Z").when(F.col("event_id") % 3 == 1, "+00:00").otherwise("")).alias("s"))
    kind = F.when(F.col("s").endswith("Z"), "Z").when(F.col("s").rlike(r"[+-]\d\d:\d\d$"), "offset").otherwise("none")
    by = s.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return by.withColumn("percent", F.round(F.col("n") * 100 / F.sum("n").over(Window.partitionBy(F.lit(1))), 6))  # three rows


@query("a20_positional_quantiles", """SELECT name, round(value, 6) AS value FROM (SELECT value, row_number() OVER (ORDER BY value, event_id) - 1 AS i, count(*) OVER () AS n FROM events) JOIN (VALUES ('q1', 4, 1), ('median', 2, 1), ('q3', 4, 3)) q(name, d, m) ON i = m * n // d""")
def a20(spark, sf_dir):
    """Values at len//4, len//2 and 3*len//4 of the sorted list: selected, not sorted."""
    return positional_quantiles(table(spark, sf_dir, "events").select("value"), "value", {"q1": (1, 4), "median": (1, 2), "q3": (3, 4)}).select("name", F.round("value", 6).alias("value"))


@query("a20b_skewed_quantiles", """WITH skewed AS (SELECT event_id, CASE WHEN event_id = 0 THEN 1e12::DOUBLE WHEN event_id % 3 = 0 THEN 7.0::DOUBLE ELSE value END AS value FROM events)
    SELECT name, round(value, 6) AS value FROM (SELECT value, row_number() OVER (ORDER BY value, event_id) - 1 AS i, count(*) OVER () AS n FROM skewed) JOIN (VALUES ('low', 10, 1), ('q1', 4, 1), ('median', 2, 1), ('q3', 4, 3), ('high', 1000, 999)) q(name, d, m) ON i = m * n // d""")
def a20b(spark, sf_dir):
    """The same where one value is a third of all and another lies far off."""
    i = F.col("event_id")
    skewed = table(spark, sf_dir, "events").select(F.when(i == 0, 1e12).when(i % 3 == 0, 7.0).otherwise(F.col("value")).alias("value"))
    return positional_quantiles(skewed, "value", {"low": (1, 10), "q1": (1, 4), "median": (1, 2), "q3": (3, 4), "high": (999, 1000)}).select("name", F.round("value", 6).alias("value"))



_X = "round({}, 6) AS {}"


@query("x1_cosine", sql("vectors", "SELECT memory_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS cosine FROM vectors"))
def x1(spark, sf_dir):
    q = table(spark, sf_dir, "embeddings").where("vec_id = 0").first().embedding
    return B.embeddings(spark, sf_dir).select("memory_id", F.round(A.cosine("embedding", F.array(*[F.lit(x) for x in q])), 6).alias("cosine"))


@query("x2_affect_distance", sql("affect", f"SELECT memory_id, model, round({distance(STATE)}, 6) AS dist, round({distance((0.5, 0.0, 0.0, {}))}, 6) AS dist_no_chord FROM affect"))
def x2(spark, sf_dir):
    """Against a state with a chord and one without."""
    d = lambda s: F.round(A.affect_distance("valence", "arousal", "dominance", "emotions", F.lit(s[0]), F.lit(s[1]), F.lit(s[2]), R.chord(s[3]) if s[3] else F.create_map().cast("map<string,double>")), 6)
    return B.affect(spark, sf_dir).select("memory_id", "model", d(STATE).alias("dist"), d((0.5, 0.0, 0.0, {})).alias("dist_no_chord"))


@query("x3_chord_distance", sql("chords affect", """SELECT a.memory_id, round(d, 6) AS dist FROM (SELECT DISTINCT memory_id FROM affect) a LEFT JOIN (SELECT p.memory_id, sqrt(sum((coalesce(x.w, 0) - coalesce(y.w, 0)) ** 2) / count(*)) AS d FROM
    (SELECT DISTINCT memory_id, emotion FROM chords WHERE memory_id % 20 = 7) p LEFT JOIN chords x ON x.memory_id = p.memory_id AND x.emotion = p.emotion AND x.model = 'base' LEFT JOIN chords y ON y.memory_id = p.memory_id AND y.emotion = p.emotion AND y.model = 'later' GROUP BY 1) q USING (memory_id)
    WHERE a.memory_id % 20 = 7"""))
def x3(spark, sf_dir):
    """Between a memory's two models; both empty gives null."""
    a = B.affect(spark, sf_dir)
    x, y = (a.where(F.col("model") == m).select("memory_id", F.col("emotions").alias(m)) for m in ("base", "later"))
    return x.join(y, "memory_id").select("memory_id", F.round(A.chord_distance("base", "later"), 6).alias("dist"))


@query("x4_recency", sql("memories", f"SELECT id, round({RECENCY}, 6) AS rec FROM memories"))
def x4(spark, sf_dir):
    return B.memories(spark, sf_dir).select("id", F.round(A.recency("created_at", as_of()), 6).alias("rec"))


@query("x5_signal_decay", sql("hive", f"SELECT event_id, round(intensity * exp(-0.693 * datediff('microsecond', ts, {AS_OF}) / 1e6 / 3600 / 24), 4) AS now FROM hive"))
def x5(spark, sf_dir):
    return B.hive_events(spark, sf_dir).select("event_id", A.signal_decay("intensity", "ts", as_of()).alias("now"))


@query("x7_status_weight", sql("memories", "SELECT status, CASE status WHEN 'durable' THEN 1.0::DOUBLE WHEN 'provisional' THEN 1 WHEN 'expired' THEN 0 WHEN 'rejected' THEN 0 ELSE 0.5 END AS w, count(*) AS n FROM (SELECT status FROM memories UNION ALL SELECT 'other') GROUP BY 1, 2"))
def x7(spark, sf_dir):
    m = B.memories(spark, sf_dir).select("status").union(spark.range(1).select(F.lit("other")))
    return m.groupBy("status", A.status_weight("status").alias("w")).agg(F.count(F.lit(1)).alias("n"))


@query("x8_negative_state", sql("latest", "SELECT memory_id, CASE WHEN e1 = 'anger' THEN w1 ELSE 0 END + CASE WHEN e2 IN ('fear', 'sadness', 'shame') THEN w2 ELSE 0 END + CASE WHEN e1 IN ('fear', 'sadness', 'shame') THEN w1 ELSE 0 END + CASE WHEN e2 = 'anger' THEN w2 ELSE 0 END > 2.5 OR valence < -0.5 AS negative FROM latest"))
def x8(spark, sf_dir):
    return R.latest_affect(B.affect(spark, sf_dir)).select("memory_id", A.is_negative("emotions", "valence").alias("negative"))


@query("x9_dominant_emotion", sql("latest", "SELECT memory_id, CASE WHEN e1 IS NULL THEN NULL WHEN w1 > w2 OR (w1 = w2 AND e1 < e2) THEN e1 ELSE e2 END AS emotion FROM latest"))
def x9(spark, sf_dir):
    return R.latest_affect(B.affect(spark, sf_dir)).select("memory_id", A.dominant("emotions").alias("emotion"))


@query("x20_compliance_score", sql("sessions", "SELECT user_id, day, round(least(1.0, CASE WHEN boot_ran THEN 0.4 ELSE 0 END + CASE WHEN timestamp_logged THEN 0.1 ELSE 0 END + CASE WHEN exchanges_stored >= 1 THEN 0.3 ELSE 0 END + CASE WHEN exchanges_stored >= 3 THEN 0.1 ELSE 0 END + CASE WHEN heartbeats_sent >= 1 THEN 0.1 ELSE 0 END)::DOUBLE, 6) AS score FROM sessions"))
def x20(spark, sf_dir):
    s = B.sessions(spark, sf_dir)
    return s.select("user_id", "day", F.round(A.compliance("boot_ran", "timestamp_logged", "exchanges_stored", "heartbeats_sent"), 6).alias("score"))


@query("x23_age_label", sql("memories", f"SELECT id, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm' WHEN s < 86400 THEN (s // 3600) || 'h' ELSE (s // 86400) || 'd' END AS age FROM (SELECT id, floor(datediff('microsecond', created_at, {AS_OF}) / 1e6)::BIGINT AS s FROM memories)"))
def x23(spark, sf_dir):
    return B.memories(spark, sf_dir).select("id", A.age_label(A.age_seconds("created_at", as_of())).alias("age"))


@query("x24_json_parse", "SELECT event_id, (props::JSON->>'$.k')::DOUBLE AS k FROM events")
def x24(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "map<string,double>")["k"].alias("k"))


@query("x25_iso_parse", "SELECT event_id, date_trunc('second', ts) AS at_z, date_trunc('second', ts) AS at_offset FROM events")
def x25(spark, sf_dir):
    """ISO strings with Z and with an offset give the same time."""
    t = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    read = lambda end: F.try_to_timestamp(F.concat(t, F.lit(end))).cast("timestamp_ntz")
    return table(spark, sf_dir, "events").select("event_id", read("Z").alias("at_z"), read("+00:00").alias("at_offset"))


@query("x26_percentages", sql("memories", "SELECT source_type, round(count(*) FILTER (context IS NOT NULL) * 100 / greatest(1, count(*)), 1) AS percent, count(*) FILTER (context IS NOT NULL) * 100 / greatest(1, count(*)) >= 80 AS pass FROM memories GROUP BY 1"))
def x26(spark, sf_dir):
    share = F.count("context") * 100 / F.greatest(F.lit(1), F.count(F.lit(1)))
    return B.memories(spark, sf_dir).groupBy("source_type").agg(F.round(share, 1).alias("percent"), (share >= 80).alias("pass"))


@query("x27_validate_signal", sql("hive", "SELECT event_id, CASE WHEN kind NOT IN ('emit', 'waggle', 'stop') THEN 'unknown type' WHEN trim(coalesce(note, '')) = '' THEN 'blank' WHEN length(note) > 100 THEN 'too long' WHEN intensity < 0.1 OR intensity > 1 THEN 'intensity out of range' END AS reason FROM hive"))
def x27(spark, sf_dir):
    """The first rule that a signal breaks."""
    reason = F.when(~F.col("kind").isin("emit", "waggle", "stop"), "unknown type").when(F.trim(F.coalesce("note", F.lit(""))) == "", "blank").when(F.length("note") > 100, "too long").when(~F.col("intensity").between(0.1, 1), "intensity out of range")
    return B.hive_events(spark, sf_dir).select("event_id", reason.alias("reason"))


SCOPES = {0: ("read", "write"), 1: ("read",), 2: ("read", "write", "admin"), 3: ()}


@query("x28_permissions", sql("audit", "SELECT event_id, CASE WHEN writes THEN identity IN (0, 2) ELSE identity IN (0, 1, 2) END AS allowed FROM audit"))
def x28(spark, sf_dir):
    """Identities against a small table of scopes; an unknown identity may nothing."""
    scopes = spark.createDataFrame([(k, list(v)) for k, v in SCOPES.items()], "identity bigint, scopes array<string>")
    a = B.audit_log(spark, sf_dir).join(F.broadcast(scopes), "identity", "left")  # one row an identity
    need = F.when(F.col("writes"), "write").otherwise("read")
    return a.select("event_id", F.coalesce(F.array_contains("scopes", need), F.lit(False)).alias("allowed"))


@query("x29_rationale")
def x29(spark, sf_dir):
    """Scores as text."""
    from .retrieval import hits

    return hits(spark, sf_dir).select("id", F.concat_ws(" | ", *[F.concat(F.lit(f"{n}="), F.format_number(F.col(c), 2)) for n, c in (("sem", "sem"), ("dist", "dist"), ("rec", "rec"))]).alias("rationale"))


@query("x30_hour", sql("memories", "SELECT hour(created_at) AS hour, count(*) AS n FROM memories GROUP BY 1"))
def x30(spark, sf_dir):
    return B.memories(spark, sf_dir).groupBy(F.hour("created_at").cast("bigint").alias("hour")).agg(F.count(F.lit(1)).alias("n"))


@query("t6_newest", sql("memories", "SELECT id, created_at FROM memories ORDER BY created_at DESC, id LIMIT 12"))
def t6(spark, sf_dir):
    return T.newest(B.memories(spark, sf_dir), 12, "created_at", "id").select("id", "created_at")


@query("t1_shortlist", sql("memories", "SELECT id, is_core FROM memories ORDER BY is_core DESC, updated_at DESC, id LIMIT 500"))
def t1(spark, sf_dir):
    return R.shortlist(B.memories(spark, sf_dir)).select("id", "is_core")


@query("u3_chord_keys", sql("chords", "SELECT memory_id, string_agg(emotion, ',' ORDER BY emotion) AS emotions FROM (SELECT DISTINCT memory_id, emotion FROM chords WHERE memory_id % 20 = 7) GROUP BY 1"))
def u3(spark, sf_dir):
    """Union of the keys of two chords."""
    a = B.affect(spark, sf_dir)
    x, y = (a.where(F.col("model") == m).select("memory_id", F.map_keys("emotions").alias(m)) for m in ("base", "later"))
    both = x.join(y, "memory_id").withColumn("k", F.array_sort(F.array_union("base", "later")))
    return both.where("size(k) > 0").select("memory_id", F.array_join("k", ",").alias("emotions"))


@query("u4_merged_sources", sql("hive", "SELECT key, string_agg(s, ',' ORDER BY s) AS sources FROM (SELECT DISTINCT key, 'u' || (event_id % 11) AS s FROM hive WHERE kind = 'nectar' UNION SELECT key, 'u' || (target_memory_id % 5) FROM hive WHERE kind = 'nectar') GROUP BY 1"))
def u4(spark, sf_dir):
    """Two lists of sources per essence, merged as sets."""
    e = B.hive_events(spark, sf_dir).where("kind = 'nectar'")
    a, b = F.concat(F.lit("u"), (F.col("event_id") % 11).cast("string")), F.concat(F.lit("u"), (F.col("target_memory_id") % 5).cast("string"))
    both = e.groupBy("key").agg(F.collect_set(a).alias("a"), F.collect_set(b).alias("b"))  # sixteen names at most
    return both.select("key", F.array_join(F.array_sort(F.array_union("a", "b")), ",").alias("sources"))


@query("x6_effective_activation", sql("ring", f"SELECT memory_id, round(activation * 0.5 / (1 + datediff('microsecond', last_activated_at, {AS_OF}) / 1e6 / 86400), 6) AS effective FROM ring"))
def x6(spark, sf_dir):
    return B.ring(spark, sf_dir).select("memory_id", F.round(A.activation("activation", "last_activated_at", as_of()), 6).alias("effective"))


@query("x10_blended_scores", sql("memories latest degrees", f"SELECT id, round((0.25 * (1 - {distance(STATE)}) + 0.15 * least(coalesce(degree, 0) / 10, 1) + 0.15 * {RECENCY}) * CASE status WHEN 'durable' THEN 1 WHEN 'provisional' THEN 1 WHEN 'expired' THEN 0 WHEN 'rejected' THEN 0 ELSE 0.5 END * CASE WHEN is_core THEN 1.3 ELSE 1 END, 6) AS score FROM memories LEFT JOIN latest a ON a.memory_id = id LEFT JOIN degrees g USING (id)"))
def x10(spark, sf_dir):
    """The score of every memory for a state without a text or vector: no shortlist, three equi-joins on the id."""
    v, a, d, c = STATE
    m = B.memories(spark, sf_dir).join(R.latest_affect(B.affect(spark, sf_dir)).withColumnRenamed("memory_id", "id"), "id", "left").join(R.degrees(B.edges(spark, sf_dir)), "id", "left")
    dist = A.affect_distance("valence", "arousal", "dominance", "emotions", F.lit(v), F.lit(a), F.lit(d), R.chord(c))
    return m.select("id", F.round(A.blended(F.lit(0.0), dist, "degree", A.recency("created_at", as_of()), "status", "is_core"), 6).alias("score"))


@query("x31_hashing_vectors")
def x31(spark, sf_dir):
    """Vectors of the documents by signed feature hashing, in Arrow batches; tests hold their length and repeatability."""
    from ..functions.embed import hashing_vectors

    v = hashing_vectors(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return v.select("doc_id", F.round(A.dot("embedding", "embedding"), 4).alias("norm"))


@query("s4_bulk_tags", sql("memories", "SELECT id, CASE WHEN id % 50 = 3 THEN 'framing' ELSE pattern_flag END AS flag, CASE WHEN id % 50 = 3 THEN 'bulk' ELSE pattern_source END AS source FROM memories"))
def s4(spark, sf_dir):
    """Tags of a table applied as updates; ``lorekeep.sources.exports.read_tags`` reads them from JSON."""
    from ..sources.exports import apply_tags

    m = B.memories(spark, sf_dir)
    tags = m.where("id % 50 = 3").select("id", F.lit("framing").alias("flag"), F.lit("bulk").alias("source"))
    return apply_tags(m, tags).select("id", F.col("pattern_flag").alias("flag"), F.col("pattern_source").alias("source"))


@query("s5_snapshot_band", sql("memories", f"SELECT id, CASE WHEN m < 60 THEN 'fresh' WHEN m < 360 THEN 'stale' ELSE 'cold' END AS band FROM (SELECT id, datediff('microsecond', created_at, {AS_OF}) / 6e7 AS m FROM memories)"))
def s5(spark, sf_dir):
    """The age band that a snapshot made with each memory has now; q2 takes the last one's."""
    return B.memories(spark, sf_dir).select("id", A.freshness(A.age_seconds("created_at", as_of()) / 60).alias("band"))
