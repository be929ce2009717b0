"""Hand-computed rows that tell a rule from rules near it."""

import datetime

import pytest
from pyspark.sql import functions as F

from lorekeep.operators import graph as G
from lorekeep.operators import maintenance as M
from lorekeep.operators import retrieval as R
from lorekeep.operators import rollups as D
from lorekeep.operators import signals as S
from lorekeep.sources import exports as X

DAY = datetime.datetime(2024, 1, 31)
MEMORY = ("id long, source_type string, memory_type string, status string, proposed_by string, confidence double, context string, access_count long, review_after timestamp_ntz, needs_user_confirmation boolean, "
          "counterweight_type string, consent_level string, is_core boolean, retrieval_weight double, created_at timestamp_ntz")
PLAIN = dict(id=1, source_type="teaching", memory_type="insight2", status="durable", proposed_by="user", confidence=0.5, context="c", access_count=0, review_after=None, needs_user_confirmation=False,
             counterweight_type=None, consent_level="normal", is_core=False, retrieval_weight=1.0, created_at=DAY)


def memories(spark, *rows):
    return spark.createDataFrame([tuple((PLAIN | {"id": i + 1} | r)[c.split()[0]] for c in MEMORY.split(", ")) for i, r in enumerate(rows)], MEMORY)


def audit(spark, *rows, ring=(), edges=(), cycles=()):
    m = memories(spark, *rows)
    r = spark.createDataFrame([(x,) for x in ring], "memory_id long")
    e = spark.createDataFrame(list(edges), "from_id long, to_id long")
    s = spark.createDataFrame(list(cycles), "cycle_start timestamp_ntz, edges_created long")
    return {x.check_id: (x.metric, x["pass"]) for x in M.audit(m, r, e, s, F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")).collect()}


def test_audit_of_plain_rows(spark):
    got = audit(spark, {}, {})
    assert len(got) == 24
    assert got["1a"] == (100, True) and got["2a"] == (0, False) and got["2c"] == (0, False)
    assert got["2f"] == (0, True)  # no corrections, nothing to link
    assert got["3b"] == (0, False) and got["3c"] == (0, True) and got["3d"] == (0, True)  # no inferences, no provisionals
    assert got["5d"] == (0, False) and got["5e"] == (100, False)  # no cycle, one month


@pytest.mark.parametrize(("check", "rows", "more", "want"), [
    ("1f", [dict(access_count=6, source_type=None)], {}, (1, False)),
    ("1f", [dict(access_count=5, proposed_by=None)], {}, (0, True)),
    ("2c", [dict(memory_type="correction", context="")], {}, (0, False)),
    ("2d", [dict(status="rejected"), dict(status="expired")], dict(ring=[1]), (0, True)),
    ("2d", [dict(status="rejected"), dict(status="expired")], dict(ring=[2, 2]), (2, False)),
    ("2f", [dict(memory_type="correction")], {}, (0, False)),
    ("2f", [dict(memory_type="correction")], dict(edges=[(1, 7)]), (1, True)),
    ("3b", [dict(source_type="inference", confidence=1.0)], {}, (0, False)),
    ("3b", [dict(source_type="inference", confidence=None), dict(confidence=1.0)], {}, (100, True)),
    ("3b", [dict(status="expired")], {}, (0, False)),
    ("3c", [dict(status="provisional")], {}, (0, False)),
    ("3d", [dict(source_type="inference", confidence=0.95)], {}, (100, False)),
    ("3d", [dict(confidence=0.99)], {}, (0, True)),
    ("4c", [dict(consent_level="low", is_core=True), dict(consent_level="low"), dict(is_core=True)], {}, (1, True)),
    ("5c", [dict(access_count=k) for k in range(4)], {}, (4, True)),
    ("5c", [dict(access_count=k, status="expired") for k in range(4)], {}, (0, False)),
    ("5d", [{}], dict(cycles=[(datetime.datetime(2024, 1, 1), 4), (datetime.datetime(2024, 1, 30), 0)]), (0, True)),
    ("5d", [{}], dict(cycles=[(datetime.datetime(2024, 1, 30), 2)]), (1, True)),
    ("5e", [dict(created_at=datetime.datetime(2024, 1, k + 1)) for k in range(4)] + [dict(created_at=datetime.datetime(2023, 1, 1))], {}, (80, False)),
    ("5e", [dict(created_at=datetime.datetime(2024, 1, k + 1)) for k in range(3)] + [dict(created_at=datetime.datetime(2023, 1, 1)), dict(status="expired")], {}, (75, True)),
])
def test_audit_rules(spark, check, rows, more, want):
    assert audit(spark, *rows, **more)[check] == want


def hive(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "event_id long, kind string, key string, signal string, ts timestamp_ntz")
    return df.withColumn("intensity", F.lit(0.5)).withColumn("note", F.lit("n")).withColumn("expires_at", F.lit(None).cast("timestamp_ntz"))


def test_topics_share_one_cap(spark):
    at = lambda k: DAY + datetime.timedelta(minutes=k)
    rows = [("waggle", f"q{k}", "s", at(-k)) for k in range(8) for _ in range(3)] + [("waggle", f"t{k:02}", "s", at(k)) for k in range(17)]
    e = hive(spark, rows)
    assert {r.key for r in S.waggles(e).collect()} == {f"q{k}" for k in range(8)} | {f"t{k:02}" for k in range(5, 17)}
    assert {(r.kind, r.key) for r in S.retired(e).collect()} == {("waggle", f"t{k:02}") for k in range(5)}


def test_emits_share_one_cap_and_replace_their_kind(spark):
    rows = [("emit", f"k{k}", "s", DAY + datetime.timedelta(minutes=k)) for k in range(12)] + [("emit", "k0", "s", DAY + datetime.timedelta(hours=1))]
    assert sorted((r.kind, r.key, r.event_id) for r in S.retired(hive(spark, rows)).collect()) == [("emit", "k1", 1), ("emit", "k2", 2)]


def test_reasons_in_pages(spark):
    e = hive(spark, [("stop", "a", "s", DAY + datetime.timedelta(minutes=k)) for k in range(5)]).withColumn("note", F.concat(F.lit("r"), "event_id"))
    assert sorted((r.key, r.page, r.reasons) for r in S.stop_reasons(e, 2).collect()) == [("a", 0, "r0 | r1"), ("a", 1, "r2 | r3"), ("a", 2, "r4")]


def test_recent_counts_look_back_across_spans(spark):
    at = [0, 3599, 3600, 3601, 7199, 7200, 7201]
    log = spark.createDataFrame([(1, i, DAY + datetime.timedelta(seconds=s)) for i, s in enumerate(at)], "identity long, event_id long, ts timestamp_ntz")
    want = {i: sum(0 <= s - x <= 3600 for x in at) for i, s in enumerate(at)}
    assert {r.event_id: r.recent for r in S.recent_counts(log, 3600).collect()} == want


def test_timeline(spark):
    at = lambda h: datetime.datetime(2024, 1, 30, h)
    j = spark.createDataFrame([(1, "durable", at(5), at(1)), (2, "rejected", None, at(2)), (3, "expired", None, at(3))], "id long, status string, written_at timestamp_ntz, created_at timestamp_ntz")
    e = spark.createDataFrame([(i, "rejected" if i == 11 else "durable", None, at(i - 6)) for i in range(10, 15)], "id long, status string, written_at timestamp_ntz, created_at timestamp_ntz")
    assert [(r.id, r.kind) for r in R.timeline(j, e, 2).collect()] == [(3, "journal"), (10, "exchange"), (1, "journal"), (12, "exchange")]


def test_growth_takes_durable_rows_of_a_week(spark):
    none = spark.createDataFrame([], "from_id long, to_id long, created_at timestamp_ntz")
    as_of = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    one = dict(source_type="exchange", created_at=datetime.datetime(2024, 1, 30))
    old = dict(source_type="journal", created_at=datetime.datetime(2024, 1, 1))
    r = D.growth(memories(spark, one, old, dict(source_type="journal", status="expired")), none, as_of).first()
    assert (r.exchange_share, r.one_sided, r.healthy, r.kinds) == (1.0, True, False, 1)
    r = D.growth(memories(spark, one, dict(source_type="journal"), dict(source_type="teaching")), none, as_of).first()
    assert (r.one_sided, r.healthy, r.kinds) == (False, True, 3)
    r = D.growth(memories(spark, old), none, as_of).first()
    assert (r.exchange_share, r.one_sided, r.healthy, r.kinds) == (None, False, False, 0)


def test_self_model_rules(spark):
    frame = lambda row, schema: spark.createDataFrame([row] if row else [], schema)
    rules = lambda drift, e, g, c: {r.trigger: (r.value, r.fires) for r in M.self_model_rules(frame(drift, "drift double, alert boolean"), frame(e, "n long, high double"), frame(g, "exchange_share double, one_sided boolean"), frame(c, "valence double")).collect()}
    assert {k for k, (_, ok) in rules((-0.2, True), (11, 0.41), (0.95, True), (-0.16,)).items() if ok} == {"emotional_drift", "arousal_alert", "reflection_needed", "care_alert"}
    assert not any(ok for _, ok in rules((0.2, True), (10, 0.41), (0.95, False), (-0.15,)).values())
    assert not any(ok for _, ok in rules(None, None, None, None).values())


def test_pairs_in_a_band_and_why_they_fail(spark):
    e = spark.createDataFrame([(2, 1)], "from_id long, to_id long")
    at = lambda d: datetime.datetime(2024, 1, d)
    rows = [(1, at(1), {"joy": 0.9}), (2, at(5), {"joy": 0.9}), (3, at(5), {"joy": 0.8}), (4, at(9), {"joy": 0.3}), (5, at(9), {}), (6, at(9), {"fear": 1.0})]
    m = spark.createDataFrame(rows, "id long, created_at timestamp_ntz, emotions map<string,double>")
    got = {r.reason: (r.n, round(r.share, 2)) for r in G.rejection_reasons(G.banded(m, 2), e).collect()}
    # (1,2) linked, (1,3) edge, (2,3) same day, (2,4) too far, (3,4) too far; 5 has no emotion, 6 no mate
    assert got == {"already linked": (1, 20.0), "edge": (1, 20.0), "same day": (1, 20.0), "too far": (2, 40.0)}


def test_new_edges_and_degrees(spark):
    t = datetime.datetime
    new = spark.createDataFrame([("joy", 1, 2, 0.1, 0.5, 0.7, t(2024, 1, 4, 1), t(2024, 1, 1, 23))], "emotion string, id long, c_id long, dist double, cos double, weight double, created_at timestamp_ntz, c_created_at timestamp_ntz")
    made, degrees = G.strengthened(new, None, spark.createDataFrame([(1, 1), (2, 9), (8, 9)], "from_id long, to_id long"), F.lit(DAY))
    r = made.first()
    assert (r.from_id, r.to_id, r.edge_type, r.rationale) == (1, 2, "resonance", "joy cross-temporal (edist=0.100, sem=0.500, span=2d)")  # two days and two hours, over three dates
    later = new.select("emotion", "id", "c_id", "dist", "cos", "weight", F.col("c_created_at").alias("created_at"), F.col("created_at").alias("c_created_at"))
    assert G.strengthened(later, None, spark.createDataFrame([(1, 1)], "from_id long, to_id long"), F.lit(DAY))[0].first().rationale.endswith("span=3d)")
    assert {(x.id, x.degree) for x in degrees.collect()} == {(1, 2), (2, 2)}


def test_people_and_results(spark, tmp_path):
    (tmp_path / "people.json").write_text('{"Ada": "friend", "": "nobody", "Bo": null}')
    assert sorted(tuple(r) for r in X.read_people(spark, str(tmp_path / "people.json")).collect()) == [("Ada", "friend"), ("Bo", None)]
    audit_ = spark.createDataFrame([("1a", 100.0, True), ("1b", 0.0, False), ("5d", 1.0, True)], "check_id string, metric double, pass boolean")
    X.write_results(audit_, str(tmp_path / "results"), "2024-01-31T00:00:00Z")
    got = sorted((r.task, r.check_id, r["pass"], r.pass_rate) for r in X.read_results(spark, str(tmp_path / "results")).collect())
    assert got == [("drift", "5d", True, 100.0), ("provenance", "1a", True, 50.0), ("provenance", "1b", False, 50.0)]


def test_backfilled_vectors_replace_old_ones(spark):
    have = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "memory_id long, embedding array<float>")
    out = {r.memory_id: len(r.embedding) for r in M.backfilled(have, spark.createDataFrame([(2, "some words"), (3, "")], "id long, raw_text string")).collect()}
    assert out == {1: 1, 2: 64, 3: 64}


def test_cheap_score_counts_links(spark):
    """Two memories that differ in their links alone: 0.15 of the score for ten links or more, in parts below."""
    at = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    m = spark.createDataFrame([(i, "x", "durable", False) for i in (1, 2, 3)], "id bigint, raw_text string, status string, is_core boolean").withColumn("created_at", at)
    a = spark.createDataFrame([], "memory_id bigint, valence double, arousal double, dominance double, emotions map<string,double>, computed_at timestamp_ntz, model string")
    e = spark.createDataFrame([(1, 100 + k) for k in range(12)] + [(200 + k, 2) for k in range(4)] + [(500, 501)], "from_id bigint, to_id bigint")
    got = {r.id: r.cheap for r in R.cheap_scores(m, a, e, at, None, "text").collect()}
    base = 0.25 * 0.5 + 0.15
    assert [round(got[i], 9) for i in (1, 2, 3)] == [round(base + 0.15, 9), round(base + 0.15 * 0.4, 9), round(base, 9)]


def test_links_change_the_thirty(spark):
    """Of forty alike, newer first, thirty advance: an old one does with links and doesn't without."""
    at = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    m = spark.range(40).select("id", F.lit("x").alias("raw_text"), F.lit("durable").alias("status"), F.lit(False).alias("is_core"), (at - F.make_dt_interval(F.col("id").cast("int"))).alias("created_at"))
    a = spark.createDataFrame([], "memory_id bigint, valence double, arousal double, dominance double, emotions map<string,double>, computed_at timestamp_ntz, model string")
    thirty = lambda e: {r.id for r in R.cheap_scores(m, a, e, at, None, "text").orderBy(F.col("cheap").desc(), "id").limit(30).collect()}
    none = spark.createDataFrame([], "from_id bigint, to_id bigint")
    assert thirty(none) == set(range(30))
    assert 39 in thirty(spark.createDataFrame([(39, k) for k in range(100, 110)], "from_id bigint, to_id bigint"))


def test_corrections_of_a_boot_summary_go_by_text(spark):
    from lorekeep.plans import jobs as J

    at = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    rows = [(1, "a Correction of it", "experience", "durable"), (2, "nothing", "correction", "durable"), (3, "coasting", "insight", "durable"), (4, "correction", "correction", "expired"), (5, "caught wrong", "insight", "durable"), (6, "not an observer", "promise", "durable")]
    m = spark.createDataFrame(rows, "id bigint, raw_text string, memory_type string, status string").select("*", (at + F.make_dt_interval(F.col("id").cast("int"))).alias("created_at"), F.lit(False).alias("is_core"), F.lit("teaching").alias("source_type"), F.lit("ctx 12").alias("context"))
    ids = lambda df: [r.id for r in df.where("part = 'correction'").collect()]
    assert sorted(ids(J.boot_lists(m, m))) == [1, 3]
    assert sorted(ids(J.loop_lists(m, m, "ctx 1", "2024-01-22", "2024-01-21"))) == [1, 3, 5, 6]
    got = sorted((r.part, r.id) for r in J.loop_lists(m.withColumn("is_core", F.col("id") == 5), m.withColumn("is_core", F.col("id") == 5), "CTX 1", "2024-01-22", "2024-01-21").collect())
    assert ("identity", 5) in got and ("today", 2) in got and ("yesterday", 1) in got


def test_snapshot_is_refreshed_unless_fresh(spark):
    from lorekeep.plans import jobs as J

    at = lambda s: F.lit(s).cast("timestamp_ntz")
    rows = [(1, "journal", "durable", "2024-01-30 22:00:00"), (2, "teaching", "durable", "2024-01-30 22:30:00"), (3, "journal", "rejected", "2024-01-30 20:00:00")]
    m = spark.createDataFrame(rows, "id bigint, source_type string, status string, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    assert tuple(J.snapshot_status(m, at("2024-01-30 22:45:30")).first()) == (1, 45, "fresh")
    assert tuple(J.snapshot_status(m, at("2024-01-30 23:00:00")).first()) == (2, -1, "refreshed")
    assert tuple(J.snapshot_status(m, at("2024-01-31 22:00:00")).first()) == (2, -1, "refreshed")


def test_mirror_warns_under_sixty_percent(spark):
    from lorekeep.plans import jobs as J

    rows = [(u, u in ran, False, 3, 1, f"2024-01-0{u}") for ran in ((5, 4),) for u in range(1, 7)]
    s = spark.createDataFrame(rows, "user_id bigint, boot_ran boolean, timestamp_logged boolean, exchanges_stored bigint, heartbeats_sent bigint, started_at string")
    got = [tuple(r) for r in J.mirror(s).collect()]
    assert ("session", 6, 1, "boot false, exchanges 3, score 50") in got and ("session", 5, 2, "boot true, exchanges 3, score 90") in got
    assert ("compliance", 5, 40, "warning") in got and ("exchanges", 30, None, None) in got
    assert ("compliance", 5, 100, None) in [tuple(r) for r in J.mirror(s.withColumn("boot_ran", F.lit(True))).collect()]


def test_strict_fallback_counterweights(spark):
    rows = [(1, "grounding", "insight", False), (2, None, "promise", True), (3, None, "promise", False), (4, None, "insight", True), (5, None, "identity", True), (6, None, "breakthrough", True)]
    m = spark.createDataFrame(rows, "id bigint, counterweight_type string, memory_type string, is_core boolean").withColumn("status", F.lit("durable"))
    none = spark.createDataFrame([], "id bigint")
    got = {r.id: r.stage for r in R.counterweights(m, none, strict=True).collect()}
    assert got.pop(1) == 0 and len(got) == 2 and set(got) < {2, 5, 6} and set(got.values()) == {1}
    two = m.withColumn("counterweight_type", F.when(F.col("id") == 4, "agency").otherwise(F.col("counterweight_type")))
    assert {r.id for r in R.counterweights(two, none, strict=True).collect()} == {1, 4}


def test_neighbour_band_by_hand(spark):
    """Newest first within an emotion, up to four ranks apart, a day or more, nearer than 0.3, not linked."""
    from lorekeep.operators import graph as G

    at = lambda d: F.lit(f"2024-01-{d:02d} 00:00:00").cast("timestamp_ntz")
    rows = [(1, 20, "joy", {"joy": 1.0}), (2, 19, "joy", {"joy": 0.9}), (3, 18, "joy", {"joy": 0.4}), (4, 17, "joy", {"joy": 0.8}), (5, 16, "joy", {"joy": 0.95}), (6, 15, "joy", {"joy": 1.0}), (7, 20, "fear", {"fear": 1.0}), (8, 20, "fear", {"fear": 1.0})]
    m = None
    for i, d, emotion, chord in rows:
        one = spark.createDataFrame([(i, emotion, chord)], "id bigint, emotion string, emotions map<string,double>").withColumn("created_at", at(d))
        m = one if m is None else m.union(one)
    edges = spark.createDataFrame([(4, 2)], "from_id bigint, to_id bigint")
    got = {(r.id, r.c_id): round(r.weight, 6) for r in G.neighbour_band(m, edges).collect()}
    # 1-6 is five ranks apart, 2-4 linked, 3 too far from all, 7-8 on one day
    assert got == {(1, 2): 0.9, (1, 4): 0.8, (1, 5): 0.95, (2, 5): 0.95, (2, 6): 0.9, (4, 5): 0.85, (4, 6): 0.8, (5, 6): 0.95}


def test_pages_of_groups(spark):
    from lorekeep.operators import tables as T

    rows = [(g, i) for g, n in (("a", 7), ("b", 3)) for i in range(0, n * 40, 40)]
    got = {(r.g, r.id): (r.page, r.n) for r in T.paged(spark.createDataFrame(rows, "g string, id bigint"), "g", "id", 2, width=100).collect()}
    assert got == {(g, i): (i // 40 // 2, 7 if g == "a" else 3) for g, i in rows}
