"""Retrieval over memories: eligibility, shortlists, blended scores, counterweights, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import affect as A

FILTERABLE = ("memory_type", "source_type", "status")
# Memory types that may stand in for counterweights.
FALLBACK = ("breakthrough", "promise", "identity")


def eligible(memories: DataFrame, filters: dict[str, str] | None = None) -> DataFrame:
    """Neither rejected nor expired; consent not high (null is out too) unless ``include_sensitive`` is "true"; equal to the
    given values of memory_type, source_type and status. Other keys are ignored."""
    filters = filters or {}
    out = memories.where(~F.col("status").isin("rejected", "expired"))
    if filters.get("include_sensitive") != "true":
        out = out.where(F.col("consent_level") != "high")
    for k in FILTERABLE:
        if k in filters:
            out = out.where(F.col(k) == filters[k])
    return out


def shortlist(memories: DataFrame, n: int = 500) -> DataFrame:
    """Core memories first, then the newest."""
    return memories.orderBy(F.col("is_core").desc(), F.col("updated_at").desc(), "id").limit(n)


def latest_affect(affect: DataFrame) -> DataFrame:
    """One affect row per memory, the last computed, ties by model."""
    w = Window.partitionBy("memory_id").orderBy(F.col("computed_at").desc(), "model")  # one memory's models
    return affect.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def degrees(edges: DataFrame) -> DataFrame:
    """Links at either end; a self-loop counts twice."""
    return edges.select(F.explode(F.array("from_id", "to_id")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def chord(weights: dict[str, float]) -> Column:
    """A chord as a literal map."""
    return F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]).cast("map<string,double>")


def _distance(state) -> Column:
    """Distance of a row's affect to a state; 0.5 without a state."""
    if state is None:
        return F.lit(0.5)
    v, a, d, c = state
    return A.affect_distance("valence", "arousal", "dominance", "emotions", F.lit(v), F.lit(a), F.lit(d), chord(c) if c else F.create_map().cast("map<string,double>"))


def scored(memories: DataFrame, affect: DataFrame, vectors: DataFrame, edges: DataFrame, as_of: Column, vector: list[float] | None, state: tuple[float, float, float, dict[str, float]] | None, text: str = "") -> DataFrame:
    """``memories`` with sem, dist, rec, degree and score. The query's vector and state are literals.

    ``memories`` is the small side here (a shortlist), so each join keeps only its ids.
    """
    ids = memories.select(F.col("id").alias("memory_id"))
    latest = latest_affect(affect.join(ids, "memory_id", "left_semi"))
    some = vectors.join(ids, "memory_id", "left_semi")
    deg = degrees(edges.join(ids.select(F.col("memory_id").alias("from_id")), "from_id", "left_semi").select("from_id", F.lit(None).cast("bigint").alias("to_id")).union(
        edges.join(ids.select(F.col("memory_id").alias("to_id")), "to_id", "left_semi").select(F.lit(None).cast("bigint").alias("from_id"), "to_id"))).where("id IS NOT NULL")
    m = memories.join(latest.withColumnRenamed("memory_id", "id"), "id", "left").join(some.withColumnRenamed("memory_id", "id"), "id", "left").join(deg, "id", "left")
    m = m.withColumn("emotions", F.coalesce("emotions", F.create_map().cast("map<string,double>"))).fillna(0.0, ["valence", "arousal", "dominance"])  # no affect is a neutral one
    q = F.array(*[F.lit(float(x)) for x in vector]) if vector else F.lit(None).cast("array<double>")
    by_text = F.when(A.holds("raw_text", text), 0.6).otherwise(0.0) if text else F.lit(0.0)
    sem = F.when(F.col("embedding").isNotNull() & q.isNotNull(), F.greatest(F.lit(0.0), A.cosine("embedding", q))).otherwise(by_text)
    dist = _distance(state)
    m = m.withColumn("sem", sem).withColumn("dist", dist).withColumn("rec", A.recency("created_at", as_of)).withColumn("degree", F.coalesce("degree", F.lit(0)))
    return m.withColumn("score", A.blended(F.col("sem"), F.col("dist"), "degree", F.col("rec"), "status", "is_core"))


def top(scores: DataFrame, k: int) -> DataFrame:
    return scores.orderBy(F.col("score").desc(), F.col("is_core").desc(), F.col("updated_at").desc(), "id").limit(k)


def boosted(hits: DataFrame, valence: float) -> DataFrame:
    """Pattern boost after the cut: below -0.2 of valence, suppressed strengths gain 0.15 up to 1 and absorbed framings get a note."""
    low = F.lit(valence < -0.2)
    up = low & (F.col("pattern_flag") == "suppressed_strength")
    return hits.withColumn("score", F.when(up, F.least(F.lit(1.0), F.col("score") + 0.15)).otherwise(F.col("score"))).withColumn(
        "note", F.when(up, "strength").when(low & (F.col("pattern_flag") == "absorbed_framing"), "framing"))


def one_per_type(memories: DataFrame, seed: int = 7) -> DataFrame:
    """A random durable memory of each counterweight type, by hash order: reruns agree."""
    w = Window.partitionBy("counterweight_type").orderBy(F.md5(F.concat_ws("|", "id", F.lit(seed)).cast("binary")), "id")
    return memories.where("status = 'durable' AND counterweight_type IS NOT NULL").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def counterweights(memories: DataFrame, seen: DataFrame, seed: int = 7, strict: bool = False) -> DataFrame:
    """One durable memory a type that isn't in ``seen`` (id). If fewer than two are found, others make up three in all: core
    memories and those of the types in FALLBACK (with ``strict``, that are both)."""
    own = one_per_type(memories, seed).join(seen, "id", "left_anti").select("id", F.lit(0).alias("stage"))
    typed = F.col("memory_type").isin(*FALLBACK)
    back = memories.where((F.col("status") == "durable") & ((typed & F.col("is_core")) if strict else (typed | F.col("is_core"))))
    back = back.join(seen, "id", "left_anti").join(own, "id", "left_anti")
    back = back.orderBy(F.md5(F.concat_ws("|", "id", F.lit(seed)).cast("binary")), "id").limit(3).select("id", F.lit(1).alias("stage"))
    both = own.union(back)
    order = Window.orderBy("stage", F.md5(F.concat_ws("|", "id", F.lit(seed)).cast("binary")), "id")  # eight rows at most
    ranked = both.withColumn("_n", F.row_number().over(order)).withColumn("_found", F.count(F.when(F.col("stage") == 0, 1)).over(Window.partitionBy(F.lit(1))))
    return ranked.where((F.col("stage") == 0) | ((F.col("_found") < 2) & (F.col("_n") <= 3))).select("id", "stage")


def word_hits(words: str) -> Column:
    """How many words of two or more characters raw_text holds; without such words, whether it holds the whole query."""
    parts = [w for w in words.lower().split() if len(w) >= 2] or [words.strip().lower()]
    return sum((F.when(A.holds("raw_text", w), 1).otherwise(0) for w in parts), F.lit(0))


def keyword_search(memories: DataFrame, words: str, k: int = 10, include_provisional: bool = False) -> DataFrame:
    """Durable rows (with ``include_provisional`` all that are neither rejected nor expired) that hold any word of two or more
    characters, by how many they hold; without such words, rows that hold the whole query."""
    return most_hits(memories.withColumn("hits", word_hits(words)), k, include_provisional)


def most_hits(memories: DataFrame, k: int, include_provisional: bool = False) -> DataFrame:
    """The first ``k`` of ``memories``, durable ones (or ``include_provisional``), by ``hits``, the words that they hold."""
    memories = memories.where("status NOT IN ('rejected', 'expired')" if include_provisional else "status = 'durable'")
    return memories.where("hits > 0").orderBy(F.col("hits").desc(), F.col("is_core").desc(), F.col("updated_at").desc(), "id").limit(k)


def cheap_scores(memories: DataFrame, affect: DataFrame, edges: DataFrame, as_of: Column, state, text: str) -> DataFrame:
    """First-stage scores without vectors: 0.3 for text, affect 0.5 where the query has no chord, links up to ten, recency.

    ``memories`` is the small side (a shortlist): edges are cut to its ids before they are counted."""
    latest = latest_affect(affect)
    ends = edges.select(F.explode(F.array("from_id", "to_id")).alias("id")).join(F.broadcast(memories.select("id")), "id", "left_semi")  # a shortlist
    links = ends.groupBy("id").agg(F.count(F.lit(1)).alias("_degree"))
    m = memories.join(latest.withColumnRenamed("memory_id", "id"), "id", "left").join(links, "id", "left")
    m = m.withColumn("emotions", F.coalesce("emotions", F.create_map().cast("map<string,double>"))).fillna(0.0, ["valence", "arousal", "dominance"])
    linked = F.least(F.coalesce(F.col("_degree"), F.lit(0)) / 10, F.lit(1.0)) * A.WEIGHTS["relational"]
    tm = F.when(A.holds("raw_text", text), 0.3).otherwise(0.0)
    dist = _distance(state if state and state[3] else None)
    total = tm * 0.3 + (1 - dist) * A.WEIGHTS["affect"] + linked + A.recency("created_at", as_of) * A.WEIGHTS["recency"]
    return m.withColumn("cheap", total * A.status_weight("status") * F.when(F.col("is_core"), 1.3).otherwise(1.0)).drop("_degree")


def timeline(journals: DataFrame, exchanges: DataFrame, most: int = 20) -> DataFrame:
    """(id, kind, shown_at) of journal entries and the first ``most`` exchanges, rejected ones left out, in order of time: entries
    by when they were written, if they say so (``written_at``), exchanges by when they were made."""
    stands = "status <> 'rejected'"
    j = journals.where(stands).select("id", F.lit("journal").alias("kind"), F.coalesce("written_at", "created_at").alias("shown_at"))
    e = exchanges.where(stands).orderBy("created_at", "id").limit(most).select("id", F.lit("exchange").alias("kind"), F.col("created_at").alias("shown_at"))
    return j.unionByName(e).orderBy("shown_at", "kind", "id")


def resonant(entities: DataFrame, state: tuple[float, float, float, dict[str, float]], below: float = 0.6) -> DataFrame:
    """Entities (people, songs) whose affect profile is nearer to a state than ``below``; empty profiles are left out."""
    v, a, d, c = state
    own = entities.where(F.size(F.map_keys("profile")) > 0)
    zero = F.lit(0.0)
    out = own.withColumn("_d", A.affect_distance(zero, zero, zero, "profile", F.lit(v), F.lit(a), F.lit(d), chord(c))).where(F.col("_d") < below)
    return out.withColumn("resonance", F.round(1 - F.col("_d"), 4)).drop("_d")
