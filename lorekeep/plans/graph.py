"""Graph growth: consolidation batches, capped pair joins, hubs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import affect as A
from ..operators import graph as G
from ..operators import retrieval as R
from ..operators import rollups as D
from ..operators import tables as T
from ..sources import bridge as B
from .catalog import query
from .daily import _ROWS, r6, rows
from .oracle import sql

_EMO = "CASE WHEN e1 IS NULL THEN NULL WHEN w1 > w2 OR (w1 = w2 AND e1 < e2) THEN e1 ELSE e2 END"
_W = lambda a, e: f"(CASE WHEN {a}.e1 = {e} THEN {a}.w1 WHEN {a}.e2 = {e} THEN {a}.w2 ELSE 0 END)"
_SQ = lambda e: f"({_W('x', e)} - {_W('y', e)}) ** 2"
# the union of two chords of two emotions each: x's both, and y's where x hasn't them
CHORD = f"""sqrt(({_SQ('x.e1')} + {_SQ('x.e2')} + CASE WHEN y.e1 NOT IN (x.e1, x.e2) THEN y.w1 ** 2 ELSE 0 END + CASE WHEN y.e2 NOT IN (x.e1, x.e2) THEN y.w2 ** 2 ELSE 0 END)
    / (2 + (y.e1 NOT IN (x.e1, x.e2))::INT + (y.e2 NOT IN (x.e1, x.e2))::INT))"""
_LINKED = "EXISTS (SELECT 1 FROM linked l WHERE l.a = least(x.id, y.id) AND l.b = greatest(x.id, y.id))"
_LINKS = "SELECT DISTINCT least(from_id, to_id) AS a, greatest(from_id, to_id) AS b FROM edges"
_DURABLE = f"SELECT *, {_EMO} AS emotion, row_number() OVER (ORDER BY id) - 1 AS batch FROM affected WHERE status = 'durable'"
_MD5 = "md5(id || '|7')"
_K1 = dict(
    affected=_ROWS, linked=_LINKS, durable=_DURABLE, batched="SELECT * FROM durable WHERE batch >= 500 AND batch < 1000 AND emotion IS NOT NULL",
    anchors="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY emotion ORDER BY id) AS n FROM batched) WHERE n <= 50",
    pool=f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY emotion ORDER BY {_MD5}, id) AS n FROM durable d WHERE emotion IN (SELECT emotion FROM batched) AND NOT EXISTS (SELECT 1 FROM batched b WHERE b.emotion = d.emotion AND b.date = d.date)) WHERE n <= 20",
    pairs=f"""SELECT x.emotion, x.id, y.id AS c_id, {CHORD} AS dist, list_cosine_similarity(p.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS cos FROM anchors x JOIN pool y ON x.emotion = y.emotion AND x.date <> y.date AND x.id <> y.id
        AND abs(datediff('microsecond', x.created_at, y.created_at)) >= 86400000000 JOIN vectors p ON p.memory_id = x.id JOIN vectors q ON q.memory_id = y.id WHERE NOT {_LINKED}""",
)


def durable(spark, sf_dir):
    """Durable memories with affect, numbered by id. Ids are dense here, so the rank of a batch is counted from the rows before it
    in ranges of ids rather than over one sorted table."""
    d = rows(spark, sf_dir).where("status = 'durable'")
    wide = F.floor(F.col("id") / 1000)
    sizes = d.groupBy(wide.alias("_r")).agg(F.count(F.lit(1)).alias("_k"))
    before = sizes.select("_r", F.coalesce(F.sum("_k").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row per thousand ids
    return d.withColumn("_r", wide).join(before, "_r").withColumn("batch", F.col("_before") + F.row_number().over(Window.partitionBy("_r").orderBy("id")) - 1).drop("_r", "_before")


@query("w5_cursor_batch", sql("memories latest", "SELECT id, batch FROM durable WHERE batch >= 500 AND batch < 1000", affected=_ROWS, durable=_DURABLE))
def w5(spark, sf_dir):
    return durable(spark, sf_dir).where("batch >= 500 AND batch < 1000").select("id", "batch")


@query("k1_consolidate", sql("memories latest vectors edges", "SELECT emotion, id, c_id, round(dist, 6) AS dist, round(cos, 6) AS cos, round(greatest(0.3, (1 - dist) * 0.5 + cos * 0.5), 6) AS weight FROM pairs WHERE dist < 0.4 AND cos >= 0.25 ORDER BY emotion, id, c_id LIMIT 200", **_K1))
def k1(spark, sf_dir):
    """The second batch."""
    new = G.consolidated(durable(spark, sf_dir), B.embeddings(spark, sf_dir), B.edges(spark, sf_dir), 500)
    return new.select("emotion", "id", "c_id", r6("dist"), r6("cos"), r6("weight"))


@query("k1b_refreshed_degrees", sql("memories latest vectors edges", """SELECT id, count(*) AS degree FROM (SELECT from_id AS id FROM every UNION ALL SELECT to_id FROM every WHERE from_id <> to_id)
    WHERE id IN (SELECT id FROM new UNION SELECT c_id FROM new) GROUP BY 1""", **_K1, new="SELECT * FROM pairs WHERE dist < 0.4 AND cos >= 0.25 ORDER BY emotion, id, c_id LIMIT 200", every="SELECT from_id, to_id FROM edges UNION ALL SELECT id, c_id FROM new"))
def k1b(spark, sf_dir):
    """Degrees of the memories that the cycle links, once its edges are in."""
    d, e = durable(spark, sf_dir), B.edges(spark, sf_dir)
    return G.strengthened(G.consolidated(d, B.embeddings(spark, sf_dir), e, 500), d, e, F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"))[1]


@query("a21_rejection_reasons", sql("memories latest edges", f"""SELECT reason, count(*) AS n, round(count(*) * 100 / sum(count(*)) OVER (), 6) AS share FROM (
    SELECT CASE WHEN {_LINKED} THEN 'already linked' WHEN abs(datediff('microsecond', x.created_at, y.created_at)) < 86400000000 THEN 'same day' WHEN {CHORD} >= 0.4 THEN 'too far' ELSE 'edge' END AS reason
    FROM first x JOIN first y ON x.emotion = y.emotion AND y.n > x.n AND y.n <= x.n + 7) GROUP BY 1""",
    affected=_ROWS, durable=_DURABLE, linked=_LINKS, first="SELECT *, row_number() OVER (PARTITION BY emotion ORDER BY id) AS n FROM (SELECT * FROM durable ORDER BY id LIMIT 1000) WHERE emotion IS NOT NULL"))
def a21(spark, sf_dir):
    """Of the first thousand durable memories, pairs up to seven ranks apart in an emotion."""
    pairs = G.banded(rows(spark, sf_dir).where("status = 'durable'"))
    return G.rejection_reasons(pairs, B.edges(spark, sf_dir)).withColumn("share", F.round("share", 6))


_NEWEST = lambda n: f"SELECT * FROM durable ORDER BY created_at DESC, id LIMIT {n}"


_BAND = f"""SELECT emotion, id, c_id, round(dist, 6) AS dist, round(greatest(0.3, 1 - dist), 6) AS weight FROM (SELECT x.emotion, x.id, y.id AS c_id, {CHORD} AS dist FROM ranked x JOIN ranked y ON x.emotion = y.emotion AND y.n > x.n AND y.n <= x.n + 4
    AND abs(datediff('microsecond', x.created_at, y.created_at)) >= 86400000000 WHERE NOT {_LINKED}) WHERE dist < 0.3"""
_RANKED = lambda rows: f"SELECT *, row_number() OVER (PARTITION BY emotion ORDER BY created_at DESC, id) AS n FROM ({rows}) WHERE emotion IS NOT NULL"


def neighbours(spark, sf_dir, kind: str):
    d = rows(spark, sf_dir).where(f"status = 'durable' AND {kind}").orderBy(F.col("created_at").desc(), "id").limit(1000)
    d = d.withColumn("emotion", A.dominant("emotions")).where("emotion IS NOT NULL")
    return G.neighbour_band(d, B.edges(spark, sf_dir)).select("emotion", "id", "c_id", r6("dist"), r6("weight"))


@query("k2_neighbour_band", sql("memories latest edges", _BAND, affected=_ROWS, linked=_LINKS, durable=_DURABLE, ranked=_RANKED(_NEWEST(1000))))
def k2(spark, sf_dir):
    """Over the newest thousand memories."""
    return neighbours(spark, sf_dir, "TRUE")


@query("k2b_journal_band", sql("memories latest edges", _BAND, affected=_ROWS, linked=_LINKS, durable=_DURABLE, journals="SELECT * FROM durable WHERE source_type = 'journal' ORDER BY created_at DESC, id LIMIT 1000", ranked=_RANKED("journals")))
def k2b(spark, sf_dir):
    """Over the newest thousand journal entries, of which few fall on one day."""
    return neighbours(spark, sf_dir, "source_type = 'journal'")


@query("k3_cluster_pairs", sql("memories latest edges", f"SELECT x.emotion, x.id, y.id AS c_id FROM ranked x JOIN ranked y ON x.emotion = y.emotion AND x.n < y.n WHERE NOT {_LINKED}", affected=_ROWS, linked=_LINKS, durable=_DURABLE,
    ranked=f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY emotion ORDER BY created_at DESC, id) AS n FROM ({_NEWEST(500)}) WHERE emotion IS NOT NULL) WHERE n <= 10"))
def k3(spark, sf_dir):
    """The ten newest of each emotion among the newest 500."""
    d = rows(spark, sf_dir).where("status = 'durable'").orderBy(F.col("created_at").desc(), "id").limit(500)
    return G.cluster_pairs(d.withColumn("emotion", A.dominant("emotions")).where("emotion IS NOT NULL"), B.edges(spark, sf_dir))


@query("j13_unlinked_pairs", sql("edges", "SELECT a, b FROM (SELECT DISTINCT least(from_id, to_id) AS a, greatest(from_id, to_id) AS b FROM edges WHERE edge_type = 'supports') s WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.edge_type <> 'supports' AND least(e.from_id, e.to_id) = a AND greatest(e.from_id, e.to_id) = b)"))
def j13(spark, sf_dir):
    """Pairs of one type that no edge of another type links, in either direction."""
    e = B.edges(spark, sf_dir)
    return G.not_linked(G.undirected(e.where("edge_type = 'supports'")).select(F.col("a").alias("x"), F.col("b").alias("y")), e.where("edge_type <> 'supports'"), "x", "y").select(F.col("x").alias("a"), F.col("y").alias("b"))


_BOTH = "SELECT from_id AS hub, to_id AS id FROM edges WHERE from_id <> to_id UNION SELECT to_id, from_id FROM edges WHERE from_id <> to_id"


@query("k7_hub_clusters", sql("edges latest_chords", """SELECT hub, neighbours, least(0.85, 0.4 + 0.03 * neighbours)::DOUBLE AS confidence, string_agg(emotion, ',' ORDER BY rank) AS emotions FROM (
    SELECT hub, neighbours, emotion, row_number() OVER (PARTITION BY hub ORDER BY round(total, 6) DESC, emotion) AS rank FROM (SELECT hub, neighbours, emotion, sum(w) AS total FROM (
        SELECT hub, id FROM (SELECT *, row_number() OVER (PARTITION BY hub ORDER BY id) AS n FROM both_ways WHERE hub IN (SELECT hub FROM top_hubs)) WHERE n <= 30 UNION ALL SELECT hub, hub FROM top_hubs)
        JOIN top_hubs USING (hub) JOIN latest_chords c ON c.memory_id = id GROUP BY 1, 2, 3)) WHERE rank <= 3 GROUP BY 1, 2""", both_ways=_BOTH, top_hubs="SELECT hub, count(*) AS neighbours FROM both_ways GROUP BY 1 HAVING count(*) >= 3 ORDER BY 2 DESC, 1 LIMIT 20"))
def k7(spark, sf_dir):
    """Hubs with the strongest emotions of themselves and thirty neighbours."""
    e = B.edges(spark, sf_dir)
    top = G.hubs(e)
    members = G.hub_members(e, top)
    chords = R.latest_affect(B.affect(spark, sf_dir)).select(F.col("memory_id").alias("id"), "emotions")
    sums = D.top_emotions(D.emotion_sums(members.join(chords, "id"), "hub"), 3, "hub")
    names = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "emotion"))), lambda x: x["emotion"]), ",")
    return sums.groupBy("hub").agg(names.alias("emotions")).join(top, "hub").select("hub", "neighbours", F.least(F.lit(0.85), 0.4 + 0.03 * F.col("neighbours")).alias("confidence"), "emotions")


@query("k10_degree_recompute", sql("memories degrees", "SELECT id, coalesce(degree, 0) AS rel_degree FROM memories LEFT JOIN degrees USING (id)"))
def k10(spark, sf_dir):
    return B.memories(spark, sf_dir).select("id").join(R.degrees(B.edges(spark, sf_dir)), "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("rel_degree"))


@query("t5_candidates_per_emotion", sql("memories latest", f"SELECT emotion, id FROM (SELECT *, row_number() OVER (PARTITION BY emotion ORDER BY {_MD5}, id) AS n FROM durable WHERE emotion IS NOT NULL) WHERE n <= 20", affected=_ROWS, durable=_DURABLE))
def t5(spark, sf_dir):
    d = rows(spark, sf_dir).where("status = 'durable'").withColumn("emotion", A.dominant("emotions")).where("emotion IS NOT NULL")
    return T.top_per(d, ["emotion"], [G.shuffled_order(), F.col("id")], 20).select("emotion", "id")
