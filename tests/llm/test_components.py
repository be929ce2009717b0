import random

from lorekeep.llm.components import components

from .util import groups


def check(spark, edges):
    nodes = {n for e in edges for n in e if e[0] != e[1]}
    want = groups(edges, {n for e in edges for n in e})
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "x bigint, y bigint")).collect()}
    assert got == {n: want[n] for n in nodes}


def test_path_star_and_random(spark):
    r = random.Random(2)
    path = [(i, i + 1) for i in range(150)]
    r.shuffle(path)
    star = [(1000, 1000 + i) for i in range(1, 200)]
    some = [(r.randrange(2000, 2300), r.randrange(2000, 2300)) for _ in range(200)]
    check(spark, path + star + some + [(5000, 5000), (-3, -4), (-4, -3)])


def test_none(spark):
    assert components(spark.createDataFrame([], "x bigint, y bigint")).count() == 0


def test_stars_take_no_round(spark, monkeypatch):
    """Stars about their smallest node are components as they are; a link between two of them is not."""
    from lorekeep.llm import components as c

    rounds, star = [], c._star
    monkeypatch.setattr(c, "_star", lambda *a: (rounds.append(1), star(*a))[1])
    stars = [(10, 11), (12, 10), (-5, -4), (-5, 7)]
    check(spark, stars)
    assert not rounds
    for more in ((7, 10), (10, -5), (11, 12)):
        check(spark, [*stars, more])
        assert rounds
        rounds.clear()
