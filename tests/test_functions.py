"""Hand-computed cases of the column expressions."""

import math

import pytest
from pyspark.sql import functions as F

from lorekeep.functions import affect as A
from lorekeep.functions.embed import hashing_vectors
from lorekeep.operators import importer as I
from lorekeep.operators import rollups as D
from lorekeep.operators import signals as S


def value(spark, c):
    return spark.range(1).select(c.alias("v")).first().v


def chord(d):
    m = F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(float(v)))]) if d else F.create_map()
    return m.cast("map<string,double>")


def ts(text):
    return F.lit(text).cast("timestamp_ntz")


def test_cosine(spark):
    a = lambda *x: F.array(*map(F.lit, x)).cast("array<float>")
    assert value(spark, A.cosine(a(0.0, 0.0), a(1.0, 0.0))) == 0
    assert value(spark, A.cosine(a(1.0), a(1.0, 0.0))) == 0
    assert value(spark, A.cosine(F.lit(None).cast("array<float>"), a(1.0))) == 0
    assert value(spark, A.cosine(a(3.0, 4.0), a(6.0, 8.0))) == pytest.approx(1)


def test_affect_distance(spark):
    d = lambda v1, c1, v2, c2: value(spark, A.affect_distance(*(F.lit(x) for x in v1), chord(c1), *(F.lit(x) for x in v2), chord(c2)))
    zero, one, minus = (0.0, 0.0, 0.0), (1.0, 1.0, 1.0), (-1.0, -1.0, -1.0)
    assert d(zero, {}, zero, {}) == pytest.approx(0.6)
    assert d(one, {"joy": 1}, minus, {"joy": 1}) == pytest.approx(0.8)
    assert value(spark, A.chord_distance(chord({"a": 0.5}), chord({"b": 0.5}))) == pytest.approx(0.5)
    assert value(spark, A.chord_distance(chord({}), chord({}))) is None


def test_decay(spark):
    assert value(spark, A.recency(ts("2024-01-01 00:00:00"), ts("2024-01-31 00:00:00"))) == pytest.approx(0.5)
    assert value(spark, A.recency(F.lit(None).cast("timestamp_ntz"), ts("2024-01-31 00:00:00"))) == 0.5
    assert value(spark, A.signal_decay(F.lit(1.0), ts("2024-01-01 00:00:00"), ts("2024-01-02 00:00:00"))) == 0.5001


def test_negative_state_is_strict(spark):
    assert value(spark, A.is_negative(chord({"fear": 1, "anger": 1, "grief": 0.5}), F.lit(-0.5))) is False
    assert value(spark, A.is_negative(chord({"fear": 1, "betrayal": 1, "exhaustion": 0.6}), F.lit(0.5))) is True
    assert value(spark, A.is_negative(chord({}), F.lit(-0.51))) is True


def test_dominant_ties_by_name(spark):
    assert value(spark, A.dominant(chord({"b": 0.5, "a": 0.5, "c": 0.1}))) == "a"
    assert value(spark, A.dominant(chord({}))) is None


def test_compliance(spark):
    c = lambda *x: value(spark, A.compliance(*map(F.lit, x)))
    assert c(True, False, 3, 0) == pytest.approx(0.8) and c(True, True, 3, 1) == pytest.approx(1.0) and c(False, False, 0, 0) == 0


def test_lexicon_weights(spark):
    lex = I.Lexicon(emotions={"e": ("aa", "bb", "cc", "dd")}, types={"t": ("zz",)})
    got = [value(spark, I.chord(F.lit(t), lex)) for t in ("aa", "aa bb", "aa bb cc dd", "none")]
    assert got == [{"e": 0.5}, {"e": 0.7}, {"e": 1.0}, {}]


def test_monotone_run(spark):
    rows = [(f"2024-01-0{i + 1}", 1, 0.1 * i) for i in range(5)] + [("2024-01-06", 1, 0.4), ("2024-01-07", 0, 9.0)]
    df = spark.createDataFrame(rows, "d string, memory_count long, v double").withColumn("date", F.col("d").cast("date"))
    runs = D.monotone_runs(df, "v", 1).orderBy("start").collect()
    assert [(r.rising, r.length, round(r.shift, 6), round(r.confidence, 6)) for r in runs] == [(True, 4, 0.4, 0.74), (False, 1, 0.0, 0.38)]


def test_empty_hive(spark):
    none = spark.createDataFrame([], "event_id long, kind string, key string, signal string, intensity double, note string, ts timestamp_ntz, expires_at timestamp_ntz")
    now = ts("2024-01-31 00:00:00")
    r = S.hive_state(S.read_emits(S.active_emits(none), now), S.waggles(none), S.stops(none), S.nectar(none)).first()
    assert (r.ratio, r.criticality, r.temperature, r.strongest) == (0.5, 1.0, "cold", None)


def test_nectar_ripens(spark):
    rows = [(i, "nectar", "k", 0.5, None, f"2024-01-0{i}") for i in (1, 2, 3)]
    df = spark.createDataFrame(rows, "event_id long, kind string, key string, intensity double, note string, t string").withColumn("ts", F.col("t").cast("timestamp_ntz"))
    r = S.nectar(df).first()
    assert (r.n, round(r.confidence, 6), r.ready) == (3, 0.75, True)
    assert S.nectar(df.limit(1)).first().confidence == 0.3


def test_hashing_vectors(spark):
    df = spark.createDataFrame([("a b c",), ("",), (None,)], "t string")
    v = [r.embedding for r in hashing_vectors(df, "t").collect()]
    assert math.isclose(sum(x * x for x in v[0]), 1, rel_tol=1e-6) and not any(v[1]) and not any(v[2])
