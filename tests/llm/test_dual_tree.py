import math
import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from lorekeep.llm import dual_tree as dt

COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def brute(rows, every=100):
    """By the definition, in whole numbers."""
    some = []
    for i, e, label in rows:
        if label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        some.append((i, [math.floor(256 * x) for x in e], (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    late = 2**63
    out = []
    for i, e, label in {(i, tuple(e), label) for i, e, label in some if i is not None and i % every == 0}:
        scored = [(-sum(a * b for a, b in zip(e, f, strict=True)), late if j is None else j, other) for j, f, other in some if len(f) == len(e)]
        for p, j, _ in sorted(x for x in scored if x[2] == label and x[1] != i)[:5]:
            hard = sorted(x for x in scored if x[2] != label and -30 * p <= -100 * x[0] <= -90 * p)[:10]
            out += [(i, None if j == late else j, r, None if k == late else k, -p, -n) for r, (n, k, _) in enumerate(hard, 1)]
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")


def test_scores_are_exact():
    r = np.random.default_rng(1)
    for size in (10, 2**28, 2**30):
        a, b = (np.floor(r.uniform(-size, size, (n, 5))) for n in (4, 6))
        want = [[sum(int(p) * int(q) for p, q in zip(x, y, strict=True)) for y in b] for x in a]
        assert dt.scores(a, b).tolist() == want
    assert dt.scores(np.full((1, 2), 2.0**70), np.array([[1.0, 1.0], [-1.0, 0.0]])).tolist() == [[2**63 - 1, -(2**63)]]


def test_intervals_hold_all_scores_of_kept_and_pruned_leaves():
    """No pair of leaves is pruned that holds a score within the bounds, and where rows lie in groups most pairs are."""
    r = np.random.default_rng(2)
    centres = r.normal(0, 100, (12, 16))
    x = np.floor(np.concatenate([c + r.normal(0, 4, (100, 16)) for c in centres]))
    tree = dt.Tree(x[::3], 40)
    assert tree.leaves > 20
    leaf, far = tree.dealt(x)
    own = np.array([far[leaf == i].max(initial=-1) for i in range(tree.leaves)])
    s = x @ x.T
    low, high = np.full(tree.leaves, 100_000.0), np.full(tree.leaves, np.inf)
    keep = dt.walked(tree, own, own, low, high)
    used = np.zeros_like(keep)
    i, j = np.nonzero(s >= 100_000)
    used[leaf[i], leaf[j]] = True
    assert not (used & ~keep).any()
    assert keep.mean() < 0.3
    # windows below
    keep = dt.walked(tree, own, own, np.full(tree.leaves, 20_000.0), np.full(tree.leaves, 30_000.0))
    used = np.zeros_like(keep)
    i, j = np.nonzero((s >= 20_000) & (s <= 30_000))
    used[leaf[i], leaf[j]] = True
    assert not (used & ~keep).any() and not keep.all()


def test_odd_tables(spark, monkeypatch):
    r = random.Random(4)
    rows = [(i, [r.gauss(0.3, 1) for _ in range(6)], r.randrange(10)) for i in range(300)]
    rows += [(400 + i, rows[i % 3][1], i % 4) for i in range(60)]  # copies of a few vectors: ties
    rows += [(None, rows[0][1], 3), (None, rows[1][1], 0), (100, rows[7][1], 2), (100, rows[7][1], 2), (100, rows[8][1], 5), (200, [0.0] * 6, 1), (0, rows[0][1], rows[0][2])]
    rows += [(500, None, 1), (600, [1.0] * 6, None), (700, [1.0, None, 1.0, 0, 0, 0], 1), (800, [float("nan")] * 6, 1), (900, [float("inf")] * 6, 1), (1000, [1.0, 2.0], 1), (1001, [1.0, 2.5], 1), (1003, [0.5, 1.0], 2), (1100, [], 4), (1102, [], 4), (1103, [], 5), (-100, rows[9][1], 4)]
    rows = [(i, None if e is None else [x if x is None else float(np.float32(x)) for x in e], label) for i, e, label in rows]
    df = table(spark, rows)
    want = brute(rows)
    assert len(want) > 100
    wide = df.withColumn("leaf", F.lit("x")).withColumn("score", F.lit(1)).withColumn("anchor", F.lit(2)).withColumn("a.b", F.lit(0)).repartition(3)
    assert found(dt.hard_negatives(wide)) == want
    # many leaves, and tasks that hold few rows
    monkeypatch.setattr(dt, "LEAF", 10)
    monkeypatch.setattr(dt, "SAMPLE", 100)
    monkeypatch.setattr(dt, "CHUNK", 50)
    monkeypatch.setattr(dt, "ANCHORS", 2)
    assert found(dt.hard_negatives(df)) == want
    assert dt.hard_negatives(df.limit(0)).count() == 0
    assert dt.hard_negatives(df.where("vec_id % 100 <> 0")).count() == 0
    one = dt.hard_negatives(table(spark, [(0, [1.0], 1)]))
    assert one.count() == 0 and tuple(one.columns) == COLUMNS


def test_very_large_components(spark):
    rows = [(i, [float(np.float32(v)) for v in e], label) for i, e, label in [(0, [3e7, 1], 2), (100, [2e7, -5], 2), (1, [2.5e7, 2], 1), (2, [1e7, 3], 1), (3, [1.1e7, 0], 4), (4, [-1e7, 0], 4), (5, [1e6, 9], 2)]]
    assert found(dt.hard_negatives(table(spark, rows))) == brute(rows)


def test_query_and_sql(spark):
    from lorekeep.llm.queries import OP11_SQL, op11_dual_tree_negatives

    sf = "/root/testdata/sf0.01"
    got = found(op11_dual_tree_negatives(spark, sf))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    assert got == sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({OP11_SQL})").fetchall(), key=str)
    assert got == brute([tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()])
    assert len(got) > 100
