import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.llm import pivot_index

from .util import groups

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, threshold=0.9):
    """Links and groups by comparing all pairs in double precision."""
    ok = [(k, i, np.array(v, np.float32).astype(np.float64)) for k, (i, v) in enumerate(rows)
          if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    pairs = []
    for d in {len(v) for _, _, v in ok}:
        same = [r for r in ok if len(r[2]) == d]
        x = np.array([v for _, _, v in same])
        n = np.linalg.norm(x, axis=1)
        i, j = np.nonzero(np.triu(x @ x.T / np.outer(n, n) >= threshold, 1))
        pairs += [(same[a][0], same[b][0]) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
    count = np.zeros(len(rows), int)
    for a, b in pairs:
        count[a] += 1
        count[b] += 1
    comp = groups(pairs, range(len(rows)))
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[comp[k]] = min(i, least.get(comp[k], i))
    return sorted(((i, int(count[k]), least.get(comp[k]), i == least.get(comp[k])) if count[k] else (i, 0, i, True) for k, (i, _) in enumerate(rows)), key=str), pairs


def found(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA)
    return sorted((tuple(r) for r in pivot_index.near_duplicates(df, **kw).collect()), key=str)


def near(rng, base, cos):
    z = rng.normal(size=base.shape)
    z -= (z @ base) / (base @ base) * base
    return cos * base / np.linalg.norm(base) + math.sqrt(1 - cos * cos) * z / np.linalg.norm(z)


@pytest.mark.parametrize("chunk", [16, 1024])
def test_groups(spark, monkeypatch, chunk):
    monkeypatch.setattr(pivot_index, "CHUNK", chunk)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(150, 32))
    vs = [*base, *(near(rng, b, c) for b in base[:40] for c in (0.97, 0.93)), *(near(rng, base[0], 0.99) for _ in range(60)), *[base[1]] * 30, *(2 * base[2] for _ in range(3))]
    rows = [(int(i), v.tolist()) for i, v in zip(rng.permutation(len(vs)), vs, strict=True)]
    assert found(spark, rows) == brute(rows)[0]


def test_odd_vectors(spark):
    v, w = [1.0, 2.0, 3.0], [3.0, -2.0, 1.0]
    rows = [(1, v), (2, v), (2, v), (3, [0.0, 0.0, 0.0]), (4, None), (5, []), (6, [1.0, None, 2.0]), (7, [float("nan"), 1.0, 1.0]), (8, [float("inf"), 0.0, 0.0]),
            (9, [1.0, 2.0]), (10, [2.0, 4.0]), (None, v), (None, w), (11, [2.0, 4.0, 6.0]), (3, None)]
    assert found(spark, rows) == brute(rows)[0]
    assert found(spark, []) == [] and found(spark, [(1, None)]) == [(1, 0, 1, True)]
    df = spark.createDataFrame([(1, v, 1), (2, v, 1)], SCHEMA).withColumn("node", F.lit(1)).withColumn("copies", F.lit("x"))
    assert pivot_index.near_duplicates(df).count() == 2


def test_doubles_stay_doubles(spark):
    big, small = [1e300, 2e300, -1e300], [3e-310, 6e-310, -3e-310]
    rows = [(1, big), (2, small), (3, [1.0, 2.0, -1.0]), (4, [1.0, 2.0, -1.0 + 1e-12]), (5, [1e39, 0.0, 0.0]), (6, [5e-324, 0.0, 0.0]), (7, [0.0, 1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = sorted(tuple(r) for r in pivot_index.near_duplicates(df).collect())
    assert got == [(1, 3, 1, True), (2, 3, 1, False), (3, 3, 1, False), (4, 3, 1, False), (5, 1, 5, True), (6, 1, 5, False), (7, 0, 7, True)]


def test_shared_pivots_by_sets():
    rng = np.random.default_rng(1)
    a, b = (np.sort(np.array([rng.choice(30, 8, replace=False) for _ in range(200)], np.int32), axis=1) for _ in range(2))
    count, first = pivot_index.shared_pivots(a, b)
    for x, y, n, f in zip(a.tolist(), b.tolist(), count.tolist(), first.tolist(), strict=True):
        both = set(x) & set(y)
        assert n == len(both) and (not both or f == min(both))


def test_nearest_in_order_with_ties():
    rng = np.random.default_rng(4)
    x, p = np.round(rng.normal(size=(50, 3))), np.round(rng.normal(size=(40, 3)))
    want = np.argsort(-(x @ p.T), axis=1, kind="stable")[:, :7]
    assert (pivot_index.nearest(x, p, 7) == want).all()


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(1500, 64))
    rows = [(i, v.tolist()) for i, v in enumerate([*base, *(near(rng, b, 0.9005) for b in base)])]
    got, (want, pairs) = found(spark, rows), brute(rows)
    assert len(pairs) >= 1500
    assert sum(r[1] for r in got) >= 0.95 * sum(r[1] for r in want)
    assert all(g <= w for (_, g, *_), (_, w, *_) in zip(sorted(got), sorted(want), strict=True))


@pytest.mark.parametrize(("least", "spread"), [(64, 0.95), (2048, 0.95), (2048, 0.89)])
def test_recall_in_a_large_group_of_near_vectors(spark, monkeypatch, least, spread):
    monkeypatch.setattr(pivot_index, "LEAST", least)
    rng = np.random.default_rng(7)
    centre = rng.normal(size=64)
    rows = [(i, v.tolist()) for i, v in enumerate([*rng.normal(size=(1600, 64)), *(near(rng, centre, math.sqrt(spread)) for _ in range(800))])]
    got, (want, pairs) = found(spark, rows), brute(rows)
    assert len(pairs) > 20_000
    assert sum(r[1] for r in got) >= 0.98 * sum(r[1] for r in want)
    assert all(g <= w for (_, g, *_), (_, w, *_) in zip(sorted(got), sorted(want), strict=True))


def test_query(spark):
    import duckdb

    from lorekeep.llm.queries import OP3_SQL, op3_pivot_permutation

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    given = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert sorted((tuple(r) for r in op3_pivot_permutation(spark, sf).collect()), key=str) == brute(given)[0]
    assert sorted(con.execute(OP3_SQL).fetchall(), key=str) == brute(given)[0]
