"""Column expressions of the memory model: similarities, decays, scores and labels. All stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the scoring rules.
WEIGHTS = {"semantic": 0.45, "affect": 0.25, "relational": 0.15, "recency": 0.15}
NEGATIVE = ("grief", "sadness", "anger", "fear", "betrayal", "loneliness", "exhaustion", "shame")
STATUS_WEIGHT = {"durable": 1.0, "provisional": 1.0, "expired": 0.0, "rejected": 0.0}
HALF_LIFE_DAYS, SIGNAL_RATE, SIGNAL_HALF_LIFE_HOURS = 30, 0.693, 24


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a, b) -> Column:
    """Cosine in double precision; 0 for null or empty vectors, different lengths and zero norms."""
    a, b = col(a), col(b)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    ok = a.isNotNull() & b.isNotNull() & (F.size(a) > 0) & (F.size(a) == F.size(b))
    return F.when(ok & (norms > 0), dot(a, b) / norms).otherwise(0.0)


def chord_distance(a, b) -> Column:
    """Root mean square of the weight differences over the emotions of either chord; null where both are empty."""
    a, b = col(a), col(b)
    merged = F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, F.lit(0.0)) - F.coalesce(y, F.lit(0.0)))
    squares = F.aggregate(F.map_values(merged), F.lit(0.0), lambda s, x: s + x * x)
    return F.when(F.cardinality(merged) > 0, F.sqrt(squares / F.cardinality(merged)))


def affect_distance(v1, a1, d1, c1, v2, a2, d2, c2) -> Column:
    """0.4 of the distance of valence, arousal and dominance, 0.6 of that of the chords (1 if both are empty)."""
    sq = lambda x, y: F.pow(col(x) - col(y), F.lit(2.0))
    va = F.sqrt(sq(v1, v2) + sq(a1, a2) + sq(d1, d2)) / math.sqrt(3)
    return va * 0.4 + F.coalesce(chord_distance(c1, c2), F.lit(1.0)) * 0.6


def age_seconds(ts, as_of) -> Column:
    return F.timestamp_diff("MICROSECOND", col(ts), col(as_of)) / 1e6


def recency(ts, as_of, days: float = HALF_LIFE_DAYS) -> Column:
    """Exponential decay of age; a missing time counts 0.5."""
    return F.coalesce(F.exp(-math.log(2) * age_seconds(ts, as_of) / (days * 86400)), F.lit(0.5))


def signal_decay(intensity, ts, as_of, half_life_hours: float = SIGNAL_HALF_LIFE_HOURS) -> Column:
    return F.round(col(intensity) * F.exp(-SIGNAL_RATE * age_seconds(ts, as_of) / 3600 / half_life_hours), 4)


def activation(value, ts, as_of) -> Column:
    """Hyperbolic decay of a ring slot by age in days."""
    return col(value) * 0.5 / (1 + age_seconds(ts, as_of) / 86400)


def status_weight(status) -> Column:
    out = F.when(F.lit(False), 0.0)
    for k, v in STATUS_WEIGHT.items():
        out = out.when(col(status) == k, v)
    return out.otherwise(0.5)


def chord_mass(chord, names=None) -> Column:
    """Sum of a chord's weights, of ``names`` if given."""
    c = col(chord)
    kept = F.map_filter(c, lambda k, v: k.isin(*names)) if names else c
    return F.aggregate(F.map_values(kept), F.lit(0.0), lambda s, x: s + x)


def is_negative(chord, valence) -> Column:
    return (F.coalesce(chord_mass(chord, NEGATIVE), F.lit(0.0)) > 2.5) | F.coalesce(col(valence) < -0.5, F.lit(False))


def dominant(chord) -> Column:
    """The emotion of the largest weight, ties by name; null for an empty chord."""
    entries = F.transform(F.map_entries(col(chord)), lambda e: F.struct((-e["value"]).alias("w"), e["key"].alias("k")))
    return F.array_min(entries)["k"]


def relational(degree) -> Column:
    return F.least(F.coalesce(col(degree), F.lit(0)) / 10, F.lit(1.0))


def blended(semantic, distance, degree, rec, status, core) -> Column:
    """The retrieval score: weighted terms, times the status weight, times 1.3 for core memories; not clamped."""
    total = semantic * WEIGHTS["semantic"] + (1 - distance) * WEIGHTS["affect"] + relational(degree) * WEIGHTS["relational"] + rec * WEIGHTS["recency"]
    return total * status_weight(status) * F.when(col(core), 1.3).otherwise(1.0)


def holds(text, part: str) -> Column:
    """Literal substring test without regard to case."""
    return F.contains(F.lower(col(text)), F.lit(part.lower()))


def compliance(boot, stamp, exchanges, beats) -> Column:
    """Session score: points for boot, time stamp, one and three exchanges, heartbeat; 1 at most."""
    points = ((col(boot), 0.4), (col(stamp), 0.1), (col(exchanges) >= 1, 0.3), (col(exchanges) >= 3, 0.1), (col(beats) >= 1, 0.1))
    return F.least(F.lit(1.0), sum((F.when(c, p).otherwise(0.0) for c, p in points), F.lit(0.0)))


def age_label(seconds) -> Column:
    s = F.floor(col(seconds)).cast("bigint")
    text = lambda n, u: F.concat(n.cast("string"), F.lit(u))
    return (F.when(s < 60, text(s, "s")).when(s < 3600, text(F.floor(s / 60), "m")).when(s < 86400, text(F.floor(s / 3600), "h")).otherwise(text(F.floor(s / 86400), "d")))


def freshness(minutes) -> Column:
    m = col(minutes)
    return F.when(m < 60, "fresh").when(m < 360, "stale").otherwise("cold")
