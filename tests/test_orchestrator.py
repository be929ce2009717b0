"""Cycles that are killed and started again, jobs that fail, and the cursor."""

import pytest
from pyspark.sql import functions as F

from lorekeep.operators import orchestrator as O
from lorekeep.plans import jobs as J


class Killed(BaseException):
    """Not an exception that a job's failure would be: the driver goes down."""


def jobs(kill_at=None, fail_at=None):
    """Two jobs that write tables; the second counts all that committed cycles wrote. One may be killed after the first has written."""

    def first(now):
        made = now.write(now.spark.range(now.number).select("id", F.lit(now.number).alias("by")), "rows")
        return {"edges": made.count(), "next": now.cursor + 10}

    def second(now):
        if now.number == kill_at:
            raise Killed
        if now.number == fail_at:
            raise ValueError("no")
        return {"insights": now.written("rows", "id bigint, by int").count()}

    return {"first": (1, first), "second": (2, second)}


def rows(log):
    return sorted(tuple(r) for r in log.collect())


def test_killed_between_two_jobs_and_started_again(spark, tmp_path):
    whole = rows(O.run_cycles(spark, str(tmp_path / "whole"), jobs(), 5))
    assert [r[:5] for r in whole] == [(c, "first,second" if c % 2 == 0 else "first", "", 10 * (c - 1), 10 * c) for c in range(1, 6)]
    assert [r[5] for r in whole] == [1, 2, 3, 4, 5] and [r[7] for r in whole] == [None, 1, None, 1 + 2 + 3, None]
    home = str(tmp_path / "killed")
    with pytest.raises(Killed):
        O.run_cycles(spark, home, jobs(kill_at=4), 5)
    assert rows(O.log(spark, home)) == whole[:3]
    # what the killed cycle wrote is not seen, nor does it stay
    assert rows(O.run_cycles(spark, home, jobs(), 5)) == whole
    assert rows(O.run_cycles(spark, home, jobs(kill_at=1), 5)) == whole  # nothing is left to run
    assert rows(O.run_cycles(spark, home, jobs(), 6))[:5] == whole


def test_a_job_that_fails_is_noted_and_the_cycle_goes_on(spark, tmp_path):
    got = rows(O.run_cycles(spark, str(tmp_path / "fails"), jobs(fail_at=2), 4))
    assert [(r[1], r[2], r[7]) for r in got] == [("first", "", None), ("first", "second", None), ("first", "", None), ("first,second", "", 6)]
    assert O.log(spark, str(tmp_path / "never")).count() == 0


def test_cycles_over_the_tables_with_a_crash(spark, sf, tmp_path):
    """Six cycles of the real jobs, the driver going down between two of them; the cursor wraps at the end of the memories."""
    home = str(tmp_path / "cycles")
    real = J.cycle_jobs(spark, sf, home)
    calls = []

    def dies(now):
        calls.append(now.number)
        if len(calls) == 1:
            raise Killed
        return real["insight"][1](now)

    some = {"sleep": real["sleep"], "insight": (4, dies)}
    with pytest.raises(Killed):
        O.run_cycles(spark, home, some, 6)
    assert O.log(spark, home).count() == 3
    got = rows(O.run_cycles(spark, home, some, 6))
    other = str(tmp_path / "straight")
    straight = J.cycle_jobs(spark, sf, other)
    assert got == rows(O.run_cycles(spark, other, {"sleep": straight["sleep"], "insight": straight["insight"]}, 6))
    assert [r[3:5] for r in got] == [(0, 500), (500, 1000), (1000, 500), (500, 1000), (1000, 500), (500, 1000)]
    assert got[0][5] > 0 and got[2][5] == 0  # the first batch comes again and is linked already


def test_candidates_ranked_once_give_the_batches_links(spark, sf):
    """What is ranked by emotion and date holds the candidates of every batch, and is a bounded part of the memories."""
    from lorekeep.operators import graph as G
    from lorekeep.plans import graph as P
    from lorekeep.sources import bridge as B
    from lorekeep.workspace import written

    durable = written(P.durable(spark, sf).select("id", "date", "created_at", "emotions", "batch"), "durable")
    ranked, vectors, edges = written(G.candidates_by_date(durable, 5), "ranked"), B.embeddings(spark, sf), B.edges(spark, sf)
    assert 0 < ranked.groupBy("emotion", "date").count().agg(F.max("count")).first()[0] <= 5
    links = lambda **more: [tuple(r) for r in G.consolidated(durable, vectors, edges, 0, 100, candidates=5, **more).select("emotion", "id", "c_id").collect()]
    assert links() == links(ranked=ranked) != []
