import re
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from lorekeep.llm import mixing

from .util import DOCS


def goals(sizes, cap=3, weights=(1, 2, 3)):
    """Targets by the rule, step by step in fractions."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    fixed, rest = {}, Fraction(sum(sizes.values()))
    while True:
        free = [s for s in order if s not in fixed]
        total = sum(w[s] for s in free)
        over = [s for s in free if rest * w[s] / total > cap * sizes[s]]
        if not over:
            return {s: float(fixed.get(s, rest * w[s] / total if s not in fixed else 0)) for s in order}
        for s in over:
            fixed[s] = Fraction(cap * sizes[s])
        rest = sum(sizes.values()) - sum(fixed.values())


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None) for i, t, s in rows], DOCS)


def check(given, rows, near=None):
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, t, s in given:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = goals(sizes)
    assert len(rows) == len(given)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.copies <= 3
        taken[r.source] += r["size"] * r.copies
    if near:
        for s in sizes:
            assert abs(taken[s] - want[s]) <= near * max(want[s], 1), (s, taken[s], want[s])
    return taken


def test_targets_and_nearness(spark):
    rows = [(i, "w " * (1 + i * i % 97), f"s{i % 5}" if i % 3 else "hot") for i in range(3000)] + [(9000 + i, "tiny text", None) for i in range(4)]
    got = mixing.mixed(frame(spark, rows)).collect()
    check(rows, got, near=0.005)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mixed(frame(spark, rows[::-1]).repartition(3)).collect()), key=str)


def test_inclusion_has_the_mean_of_the_share(spark):
    """Over many seeds each document is taken as often as its source's share says."""
    rows = [(i, "w " * (1 + 7 * i % 23), "a") for i in range(30)] + [(100 + i, "v " * 40, "b") for i in range(6)]
    d, n = frame(spark, rows).cache(), 15
    taken = defaultdict(float)
    for seed in range(n):
        for r in mixing.mixed(d, seed=seed).collect():
            taken[r.doc_id] += r.copies / n
            share = r.target / r.source_size
    of_a = [taken[i] for i in range(30)]
    want = goals({"a": sum(1 + 7 * i % 23 for i in range(30)), "b": 240})["a"] / sum(1 + 7 * i % 23 for i in range(30))
    assert share > 0 and abs(sum(of_a) / 30 - want) < 0.06 and all(abs(x - want) < 0.5 for x in of_a)


def test_sum_is_kept_in_documents(spark):
    rows = [(i, "same size here", "a" if i % 2 else "b") for i in range(999)]
    got = check(rows, mixing.mixed(frame(spark, rows)).collect())
    want = goals({"a": 499 * 3, "b": 500 * 3})
    assert all(abs(got[s] - want[s]) <= 3 for s in want)


def test_odd_tables(spark):
    assert mixing.mixed(frame(spark, [])).count() == 0
    rows = [(1, None, "a"), (2, "", "a"), (None, "x y", None), (3, "x", "b"), (3, "x", "b"), (3, "x", "b"), (4, "long " * 50_000, "c")]
    check(rows, mixing.mixed(frame(spark, rows).withColumn("size", F.lit("clash")).withColumn("key", F.lit(1))).collect())
    only = [(1, None, "a"), (2, " ", None)]
    assert [r.copies for r in mixing.mixed(frame(spark, only)).collect()] == [0, 0]


def test_mixture_repeats_rows(spark):
    rows = [(i, f"t{i} " * (i % 7 + 1), f"s{i % 4}") for i in range(300)] + [(5, "t5 " * 6, "s1")] * 2
    d = frame(spark, rows)
    want = defaultdict(int)
    for r in mixing.mixed(d).collect():
        want[r.doc_id] += r.copies
    got = defaultdict(int)
    out = mixing.mixture(d)
    assert out.columns == d.columns
    for r in out.collect():
        got[r.doc_id] += 1
    assert got == {k: v for k, v in want.items() if v}


def test_query(spark, sf):
    from lorekeep.llm.queries import op6_pivotal_mixing

    given = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()]
    out = op6_pivotal_mixing(spark, sf)
    rows = out.collect()
    check(given, rows)
    assert all(r.taken == r["size"] * r.copies for r in rows)
