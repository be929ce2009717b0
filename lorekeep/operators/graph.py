"""Pair joins with fixed caps, the similarity join that grows the graph, hub clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import affect as A
from . import tables as T


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b) with a <= b, once per pair."""
    return edges.select(F.least("from_id", "to_id").alias("a"), F.greatest("from_id", "to_id").alias("b")).distinct()


def not_linked(pairs: DataFrame, edges: DataFrame, x: str, y: str) -> DataFrame:
    """``pairs`` without those that an edge links in either direction. The pairs are few (capped), so the known ones are found by
    a semi-join first."""
    keyed = pairs.withColumn("a", F.least(x, y)).withColumn("b", F.greatest(x, y))
    return keyed.join(undirected(edges), ["a", "b"], "left_anti").drop("a", "b")


def shuffled_order(seed: int = 7):
    """A random order that reruns repeat."""
    return F.md5(F.concat_ws("|", "id", F.lit(seed)).cast("binary"))


def similar_across_time(anchors: DataFrame, candidates: DataFrame, edges: DataFrame, far: float = 0.4, least_cos: float = 0.25) -> DataFrame:
    """Pairs (anchor, candidate) of one dominant emotion, different dates and a day apart or more, with a chord distance below
    ``far`` and a cosine of ``least_cos`` or more, not linked yet; with the weight of the edge to be.

    Both sides (id, emotion, date, created_at, emotions, embedding) are capped per emotion by the caller, so the join is bounded
    by emotions x anchors x candidates.
    """
    c = candidates.select("emotion", *(F.col(x).alias(f"c_{x}") for x in ("id", "date", "created_at", "emotions", "embedding")))
    pairs = anchors.join(c, "emotion").where("date <> c_date AND id <> c_id").where(F.abs(F.timestamp_diff("SECOND", F.col("created_at"), F.col("c_created_at"))) >= 86400)
    pairs = pairs.withColumn("dist", A.chord_distance("emotions", "c_emotions")).where(F.col("dist") < far)
    pairs = pairs.withColumn("cos", A.cosine("embedding", "c_embedding")).where(F.col("cos") >= least_cos)
    return not_linked(pairs, edges, "id", "c_id").withColumn("weight", F.greatest(F.lit(0.3), (1 - F.col("dist")) * 0.5 + F.col("cos") * 0.5))


def consolidated(memories: DataFrame, vectors: DataFrame, edges: DataFrame, first: int, size: int = 500, anchors: int = 50, candidates: int = 20, most: int = 200, ranked: DataFrame | None = None) -> DataFrame:
    """One batch of ``memories`` (durable, with date, emotions and ``batch`` rank): anchors of the batch against random candidates of
    other dates, the new edges in a fixed order, ``most`` at most.

    ``ranked`` is what ``candidates_by_date`` makes of the memories, where many batches are to be linked. Anchors and candidates are few
    for each emotion, so that vectors and edges are cut to theirs where they are read."""
    rows = memories.withColumn("emotion", A.dominant("emotions")).where("emotion IS NOT NULL")
    batch = rows.where((F.col("batch") >= first) & (F.col("batch") < first + size))
    keep = ["id", "emotion", "date", "created_at", "emotions"]
    a = T.pinned(T.top_per(batch, ["emotion"], ["id"], anchors).select(keep))  # ``anchors`` an emotion
    dates = batch.groupBy("emotion").agg(F.collect_set("date").alias("dates"))  # a batch has ``size`` rows
    pool = (rows if ranked is None else ranked).join(F.broadcast(dates), "emotion").where(~F.array_contains("dates", F.col("date")))
    c = T.pinned(T.top_per(pool, ["emotion"], [shuffled_order(), F.col("id")], candidates).select(keep))  # ``candidates`` an emotion
    some = a.select("id").union(c.select("id")).distinct().withColumnRenamed("id", "memory_id")
    v = vectors.join(F.broadcast(some), "memory_id", "left_semi").withColumnRenamed("memory_id", "id")
    ids = [r.id for r in a.select("id").distinct().collect()]
    near = edges.where(F.col("from_id").isin(ids) | F.col("to_id").isin(ids))  # an end of every pair is an anchor
    new = similar_across_time(a.join(v, "id"), c.join(v, "id"), near)
    return new.orderBy("emotion", "id", "c_id").limit(most)


def candidates_by_date(memories: DataFrame, candidates: int = 20) -> DataFrame:
    """The first ``candidates`` of each emotion and date in the random order: as batches leave out whole dates, the candidates of every
    batch are among them."""
    rows = memories.withColumn("emotion", A.dominant("emotions")).where("emotion IS NOT NULL")
    return T.top_per(rows, ["emotion", "date"], [shuffled_order(), F.col("id")], candidates)


def neighbour_band(memories: DataFrame, edges: DataFrame, band: int = 4, far: float = 0.3) -> DataFrame:
    """Pairs up to ``band`` ranks apart within an emotion (newest first), a day apart or more, nearer than ``far``."""
    w = Window.partitionBy("emotion").orderBy(F.col("created_at").desc(), "id")  # over the newest rows, capped by the caller
    me = F.struct("id", "created_at", "emotions")
    rows = memories.withColumn("near", F.array(*[F.lead(me, i).over(w) for i in range(1, band + 1)]))
    pairs = rows.select("id", "created_at", "emotions", "emotion", F.explode("near").alias("n")).where("n IS NOT NULL")
    pairs = pairs.select("id", "emotion", "created_at", "emotions", F.col("n.id").alias("c_id"), F.col("n.created_at").alias("c_created_at"), F.col("n.emotions").alias("c_emotions"))
    pairs = pairs.where(F.abs(F.timestamp_diff("SECOND", F.col("created_at"), F.col("c_created_at"))) >= 86400).withColumn("dist", A.chord_distance("emotions", "c_emotions")).where(F.col("dist") < far)
    return not_linked(pairs, edges, "id", "c_id").withColumn("weight", F.greatest(F.lit(0.3), 1 - F.col("dist")))


def cluster_pairs(memories: DataFrame, edges: DataFrame, size: int = 10) -> DataFrame:
    """All pairs among the ``size`` newest of each emotion that no edge links: 45 an emotion at most."""
    w = Window.partitionBy("emotion").orderBy(F.col("created_at").desc(), "id")
    rows = memories.withColumn("n", F.row_number().over(w)).where(F.col("n") <= size).select("id", "emotion", "n")
    other = rows.select("emotion", F.col("id").alias("c_id"), F.col("n").alias("m"))
    return not_linked(rows.join(other, "emotion").where("n < m"), edges, "id", "c_id").select("emotion", "id", "c_id")


def hubs(edges: DataFrame, most: int = 20, least: int = 3) -> DataFrame:
    """Nodes with the most distinct neighbours."""
    both = edges.where("from_id <> to_id").select("from_id", "to_id").union(edges.where("from_id <> to_id").select("to_id", "from_id")).distinct()
    deg = both.groupBy(F.col("from_id").alias("hub")).agg(F.count(F.lit(1)).alias("neighbours")).where(F.col("neighbours") >= least)
    return deg.orderBy(F.col("neighbours").desc(), "hub").limit(most)


def hub_members(edges: DataFrame, top: DataFrame, most: int = 30) -> DataFrame:
    """(hub, id): each hub with itself and the ``most`` lowest neighbours."""
    both = edges.where("from_id <> to_id").select(F.col("from_id").alias("hub"), F.col("to_id").alias("id")).union(edges.where("from_id <> to_id").select("to_id", "from_id"))
    near = T.top_per(both.join(F.broadcast(top.select("hub")), "hub", "left_semi").distinct(), ["hub"], ["id"], most)  # ``top`` has twenty rows
    return near.select("hub", "id").union(top.select("hub", F.col("hub").alias("id")))


def banded(memories: DataFrame, band: int = 7, size: int = 1000) -> DataFrame:
    """Pairs up to ``band`` ranks apart, by id within an emotion, of the first ``size`` memories."""
    rows = memories.orderBy("id").limit(size).withColumn("emotion", A.dominant("emotions")).where("emotion IS NOT NULL")
    w = Window.partitionBy("emotion").orderBy("id")  # ``size`` rows in all
    me = F.struct("id", "created_at", "emotions")
    rows = rows.withColumn("near", F.array(*[F.lead(me, i).over(w) for i in range(1, band + 1)]))
    pairs = rows.select("id", "created_at", "emotions", F.explode("near").alias("n")).where("n IS NOT NULL")
    return pairs.select("id", "created_at", "emotions", F.col("n.id").alias("c_id"), F.col("n.created_at").alias("c_created_at"), F.col("n.emotions").alias("c_emotions"))


def rejection_reasons(pairs: DataFrame, edges: DataFrame, far: float = 0.4) -> DataFrame:
    """The first test that each candidate pair (id, created_at, emotions, c_...) fails, counted, with its share in per cent. The
    pairs are few, so the edges are cut to their ends first."""
    ends = pairs.select("id").union(pairs.select("c_id")).distinct()
    some = edges.join(F.broadcast(ends.withColumnRenamed("id", "from_id")), "from_id", "left_semi")  # two ids a pair at most
    keyed = pairs.withColumn("a", F.least("id", "c_id")).withColumn("b", F.greatest("id", "c_id"))
    keyed = keyed.join(undirected(some).withColumn("linked", F.lit(True)), ["a", "b"], "left")
    none = (F.size(F.map_keys("emotions")) == 0) & (F.size(F.map_keys("c_emotions")) == 0)
    apart = F.abs(F.timestamp_diff("SECOND", F.col("created_at"), F.col("c_created_at")))
    reason = F.when(F.col("linked"), "already linked").when(apart < 86400, "same day").when(none, "no emotions").when(A.chord_distance("emotions", "c_emotions") >= far, "too far").otherwise("edge")
    out = T.counts(keyed.select(reason.alias("reason")), "reason")
    return out.withColumn("share", F.col("n") * 100 / F.sum("n").over(Window.partitionBy(F.lit(1))))  # five rows


def strengthened(new: DataFrame, memories: DataFrame, edges: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """What a cycle writes: the edges of ``new`` (emotion, id, c_id, dist, cos, weight, and the two times), and the degrees (id,
    degree, self-loops once) of their ends once they are in. ``new`` is capped, so the edges are cut to its ids first."""
    span = F.abs(F.floor(F.timestamp_diff("MICROSECOND", F.col("c_created_at"), F.col("created_at")) / 86_400_000_000)).cast("string")  # days from the candidate to the anchor, begun ones counting where it is later
    three = lambda c: F.format_string("%.3f", F.col(c))
    why = F.concat(F.col("emotion"), F.lit(" cross-temporal (edist="), three("dist"), F.lit(", sem="), three("cos"), F.lit(", span="), span, F.lit("d)"))
    made = new.select(F.col("id").alias("from_id"), F.col("c_id").alias("to_id"), F.lit("resonance").alias("edge_type"), "weight", why.alias("rationale"), as_of.alias("created_at"))
    ends = F.broadcast(made.select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct())  # twice the cap at most
    every = edges.select("from_id", "to_id").unionByName(made.select("from_id", "to_id"))
    sides = every.select(F.explode(F.array_distinct(F.array("from_id", "to_id"))).alias("id"))
    return made, T.counts(sides.join(ends, "id", "left_semi"), "id").withColumnRenamed("n", "degree")
