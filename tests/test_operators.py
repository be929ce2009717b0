"""Edge cases of the operators on small hand-made tables."""

import random

import pytest
from pyspark.sql import functions as F

from lorekeep.operators import graph as G
from lorekeep.operators import maintenance as M
from lorekeep.operators import retrieval as R
from lorekeep.operators import rollups as D
from lorekeep.operators import signals as S
from lorekeep.operators import tables as T
from lorekeep.operators.quantiles import positional_quantiles


def ts(df, *names):
    for n in names:
        df = df.withColumn(n, F.col(n).cast("timestamp_ntz"))
    return df


def affect(spark, rows):
    df = spark.createDataFrame(rows, "memory_id long, valence double, model string, computed_at string, emotions map<string,double>")
    return ts(df, "computed_at").withColumn("arousal", F.lit(0.0)).withColumn("dominance", F.lit(0.0))


def memories(spark, rows):
    df = spark.createDataFrame(rows, "id long, status string, consent_level string, is_core boolean, updated_at string, counterweight_type string, memory_type string, source_type string, raw_text string, pattern_flag string")
    return ts(df.withColumn("created_at", F.col("updated_at")), "updated_at", "created_at")


BASE = [
    (1, "durable", "normal", True, "2024-01-01", "care", "insight", "teaching", "Hello World", None),
    (2, "durable", None, False, "2024-01-02", "care", "insight", "teaching", "hello", "suppressed_strength"),
    (3, "expired", "normal", False, "2024-01-03", "joy", "insight", "inference", "bye", None),
    (4, "provisional", "high", False, "2024-01-04", None, "promise", "inference", "hello hello", None),
    (5, "durable", "normal", False, "2024-01-05", "joy", "promise", "exchange", "100% sure", "absorbed_framing"),
]


def ids(df):
    return sorted(r.id for r in df.collect())


def test_eligible(spark):
    m = memories(spark, BASE)
    assert ids(R.eligible(m)) == [1, 5]
    assert ids(R.eligible(m, {"include_sensitive": "true"})) == [1, 2, 4, 5]
    assert ids(R.eligible(m, {"memory_type": "promise", "unknown": "x"})) == [5]


def test_latest_affect_of_two_models(spark):
    a = affect(spark, [(7, 0.1, "base", "2024-01-01", {}), (7, 0.2, "later", "2024-01-02", {}), (8, 0.3, "b", "2024-01-01", {}), (8, 0.4, "a", "2024-01-01", {})])
    assert {(r.memory_id, r.valence) for r in R.latest_affect(a).collect()} == {(7, 0.2), (8, 0.4)}


def test_self_loop_counts_twice(spark):
    e = spark.createDataFrame([(7, 7), (7, 8)], "from_id long, to_id long")
    assert {(r.id, r.degree) for r in R.degrees(e).collect()} == {(7, 3), (8, 1)}


def test_counterweights(spark):
    m = memories(spark, BASE)
    none = spark.createDataFrame([], "id long")
    assert len(R.counterweights(m, none).collect()) == 2  # care and joy have a durable one each
    seen = spark.createDataFrame([(1,), (2,), (5,)], "id long")
    assert R.counterweights(m, seen).collect() == []  # 3 and 4 aren't durable
    some = spark.createDataFrame([(2,), (5,)], "id long")
    assert ids(R.counterweights(m, some)) == [1]
    assert ids(R.counterweights(m, some, strict=True)) == []  # core, but of no such type


def test_pattern_boost_may_lower(spark):
    hits = memories(spark, BASE).withColumn("score", F.lit(1.1))
    got = {r.id: (r.score, r.note) for r in R.boosted(hits, -0.3).collect()}
    assert got[2] == (1.0, "strength") and got[5] == (1.1, "framing") and got[1] == (1.1, None)
    assert {r.score for r in R.boosted(hits, -0.2).collect()} == {1.1}


def test_keyword_search_counts_words(spark):
    found = lambda *a, **k: [(r.id, r.hits) for r in R.keyword_search(memories(spark, BASE), *a, **k).collect()]
    assert found("HELLO world a", 10) == [(1, 2), (2, 1)]  # durable ones only, unless asked for
    assert found("HELLO world a", 10, include_provisional=True) == [(1, 2), (4, 1), (2, 1)]
    assert found("bye", 10, include_provisional=True) == []  # expired
    assert found(" o ", 10) == [(1, 1), (2, 1)]  # no word of two characters: the query as a whole


def test_scores_of_a_memory_without_anything(spark):
    m = memories(spark, BASE).where("id = 1")
    none = affect(spark, [])
    vectors = spark.createDataFrame([], "memory_id long, embedding array<float>")
    edges = spark.createDataFrame([], "from_id long, to_id long")
    r = R.scored(m, none, vectors, edges, F.lit("2024-01-31").cast("timestamp_ntz"), [1.0, 0.0], (0.0, 0.0, 0.0, {"joy": 1.0}), "hello").first()
    assert (r.sem, r.dist, r.degree) == (0.6, 0.6, 0)
    assert r.rec == pytest.approx(0.5) and r.score == pytest.approx((0.45 * 0.6 + 0.25 * 0.4 + 0.15 * 0.5) * 1.3)
    r = R.scored(m, none, vectors, edges, F.lit("2024-01-31").cast("timestamp_ntz"), None, None).first()
    assert (r.sem, r.dist) == (0.0, 0.5)


def test_table_changes(spark):
    base = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k long, note string, v double")
    new = spark.createDataFrame([(2, None, None), (3, "c", 3.0)], "k long, note string, v double")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(T.replaced(base, new, ["k"])) == [(1, "a", 1.0), (2, None, None), (3, "c", 3.0)]
    assert rows(T.ignored(base, new, ["k"])) == [(1, "a", 1.0), (2, "b", 2.0), (3, "c", 3.0)]
    assert rows(T.merged(base, new, ["k"])) == [(1, "a", 1.0), (2, "b", 2.0), (3, "c", 3.0)]
    assert rows(T.merged(base, new, ["k"], always=("v",))) == [(1, "a", 1.0), (2, "b", None), (3, "c", 3.0)]
    assert T.free_slot(spark.createDataFrame([(0,), (1,), (3,)], "slot long"), 5).first().slot == 2
    assert T.free_slot(spark.createDataFrame([(0,), (1,)], "slot long"), 2).first().slot is None


def test_prefix_duplicates(spark):
    df = spark.createDataFrame([(5, " The Same beginning "), (3, "the same Beginning"), (9, "ok"), (8, "ok"), (7, None), (3, "the same Beginning")], "id long, t string")
    assert [tuple(r) for r in M.prefix_duplicates(df, "t", "id").collect()] == [(5, 3)]


def test_deltas_skip_empty_days_and_zero_falls(spark):
    df = spark.createDataFrame([("2024-01-01", 1, 0.1), ("2024-01-02", 0, 9.0), ("2024-01-05", 1, 0.1)], "d string, memory_count long, v double").withColumn("date", F.col("d").cast("date"))
    assert [r.delta for r in D.deltas(df, "v").collect()] == [0.0]
    assert [r.rising for r in D.monotone_runs(df, "v", 1, days=2).collect()] == [False]
    assert D.monotone_runs(df, "v", 1).count() == 0  # five days at least


def test_bigrams(spark):
    df = spark.createDataFrame([(f"2024-01-{i + 1:02}", "ab"[i % 2]) for i in range(8)], "d string, emotion string").withColumn("date", F.col("d").cast("date"))
    got = {(r[0], r[1]): r[2] for r in D.bigrams(df).select("first", "second", "n").collect()}
    want = {}
    seq = ["ab"[i % 2] for i in range(8)]
    for i in range(8):
        for j in range(i + 1, min(8, i + 4)):
            if seq[i] != seq[j]:
                want[seq[i], seq[j]] = want.get((seq[i], seq[j]), 0) + 1
    assert got == {k: v for k, v in want.items() if v >= 3}


def test_not_linked_is_undirected(spark):
    pairs = spark.createDataFrame([(1, 2), (3, 4)], "x long, y long")
    edges = spark.createDataFrame([(2, 1)], "from_id long, to_id long")
    assert [tuple(r) for r in G.not_linked(pairs, edges, "x", "y").collect()] == [(3, 4)]


def test_emits_expire_and_fade(spark):
    rows = [(1, "emit", "a", "s", 1.0, None, "2024-01-30", None), (2, "emit", "b", "s", 1.0, None, "2024-01-01", None), (3, "emit", "c", "s", 1.0, None, "2024-01-30", "2024-01-30")]
    df = ts(spark.createDataFrame(rows, "event_id long, kind string, key string, signal string, intensity double, note string, ts string, expires_at string"), "ts", "expires_at")
    now = F.lit("2024-01-31").cast("timestamp_ntz")
    assert [r.key for r in S.read_emits(S.active_emits(df), now).collect()] == ["a"]
    assert {r.key for r in S.read_emits(S.active_emits(df), now, include_decayed=True).collect()} == {"a", "b"}


def test_quantiles(spark):
    for values in ([5.0], [1.0, 1.0, 1.0, 1.0], [float(i * i % 37) for i in range(101)], []):
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
        got = {r.name: r.v for r in positional_quantiles(df, "v", {"q1": (1, 4), "median": (1, 2), "q3": (3, 4)}).collect()}
        n, s = len(values), sorted(values)
        assert got == ({"q1": s[n // 4], "median": s[n // 2], "q3": s[3 * n // 4]} if n else {})




def test_quantiles_in_rounds(spark, monkeypatch):
    """Small brackets and few bounds, so that rounds are needed, over skewed, tied and far values."""
    from lorekeep.operators import quantiles as Q

    monkeypatch.setattr(Q, "SMALL", 3)
    monkeypatch.setattr(Q, "BOUNDS", 4)
    points = {"q1": (1, 4), "median": (1, 2), "q3": (3, 4), "last": (99, 100)}
    r = random.Random(6)
    for values in ([7.0] * 120 + [r.gauss(0, 9) for _ in range(200)] + [1e12], [1.0], [2.0, 2.0, 1.0], [float(i % 5) for i in range(60)], [-1e300, 1e300] + [0.5] * 40, [r.random() for _ in range(150)]):
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
        got = {x.name: x.v for x in positional_quantiles(df, "v", points).collect()}
        assert got == {k: sorted(values)[len(values) * m // d] for k, (m, d) in points.items()}
    assert positional_quantiles(spark.createDataFrame([(None,)], "v double"), "v", points).count() == 0
