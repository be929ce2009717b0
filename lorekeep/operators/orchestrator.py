"""Maintenance cycles: jobs that are due run one after the other, and a cycle counts once it is committed.

Everything a job makes goes to a folder of its cycle, which a second attempt writes anew. A cycle is committed by renaming its log
row into place: the row holds the counts of its jobs and the cursor from which the next cycle goes on, so both change together or
not at all. A driver that was killed at any point is started again by the same call; it reads the committed rows and goes on.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import graph as G

LOG = "cycle bigint, jobs string, failed string, first bigint, next bigint, edges bigint, expired bigint, insights bigint, items bigint"
_COUNTS = ("edges", "expired", "insights", "items")


@dataclass(frozen=True)
class Cycle:
    """What a job is told: the cycle's number, the cursor, where it may write, and what the committed cycles before it wrote."""

    spark: SparkSession
    home: str
    number: int
    cursor: int
    before: tuple[int, ...]

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.home}/work/cycle={self.number}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def written(self, name: str, schema: str, newest: bool = False) -> DataFrame:
        """What committed cycles wrote under a name; with ``newest`` the last of them that wrote it."""
        fs, path = _fs(self.spark, self.home)
        have = [p for n in self.before if fs.exists(path(p := f"{self.home}/work/cycle={n}/{name}"))]
        have = have[-1:] if newest else have
        return self.spark.read.schema(schema).parquet(*have) if have else self.spark.createDataFrame([], schema)


def _fs(spark: SparkSession, home: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(home).getFileSystem(spark._jsc.hadoopConfiguration()), path


def log(spark: SparkSession, home: str) -> DataFrame:
    """The rows of all committed cycles."""
    fs, path = _fs(spark, home)
    return spark.read.schema(LOG).json(f"{home}/log/*") if fs.exists(path(f"{home}/log")) else spark.createDataFrame([], LOG)


def run_cycles(spark: SparkSession, home: str, jobs: dict[str, tuple[int, Callable[[Cycle], dict[str, int]]]], cycles: int) -> DataFrame:
    """Runs cycles 1 to ``cycles`` as far as they aren't committed in ``home``, and returns the log.

    ``jobs`` gives for each name how often it runs (in cycles that its number divides) and what it does: it returns counts, and
    "next" where it moves the cursor. A job that raises an exception is noted as failed, what it would have counted is
    null, and the cycle goes on.
    """
    fs, path = _fs(spark, home)
    done = sorted((r.cycle, r.next) for r in log(spark, home).select("cycle", "next").collect())  # one row a cycle
    numbers, cursor = [n for n, _ in done], done[-1][1] if done else 0
    for number in range(len(numbers) + 1, cycles + 1):
        now = Cycle(spark, home, number, cursor, tuple(numbers))
        found: dict[str, int] = {"next": cursor}
        ran, failed = [], []
        for name, (every, job) in jobs.items():
            if number % every:
                continue
            try:
                found |= job(now)
                ran.append(name)
            except Exception:
                failed.append(name)
        row = (number, ",".join(ran), ",".join(failed), cursor, found["next"], *(found.get(c) for c in _COUNTS))
        aside = f"{home}/_incoming-{number}"
        spark.createDataFrame([row], LOG).coalesce(1).write.mode("overwrite").json(aside)
        fs.mkdirs(path(f"{home}/log"))
        if not fs.rename(path(aside), path(f"{home}/log/cycle={number}")):
            raise OSError(f"cycle {number} could not be committed in {home}")
        numbers.append(number)
        cursor = found["next"]
    return log(spark, home)


def consolidation(memories: DataFrame, vectors: DataFrame, edges: DataFrame, size: int = 500, ranked: DataFrame | None = None) -> Callable[[Cycle], dict[str, int]]:
    """The linking job: one batch of ``memories`` (durable, numbered) from the cursor on, which wraps at their end, against the given
    edges and all that committed cycles added. ``ranked``: ``graph.candidates_by_date`` of the memories, made once for all cycles."""
    total = memories.count()

    def job(now: Cycle) -> dict[str, int]:
        if total < 2:
            return {"edges": 0}
        first = 0 if now.cursor >= total else now.cursor
        every = edges.select("from_id", "to_id").union(now.written("edges", "from_id bigint, to_id bigint"))
        new = G.consolidated(memories, vectors, every, first, size, ranked=ranked)
        made = now.write(new.select(F.col("id").alias("from_id"), F.col("c_id").alias("to_id")), "edges")
        return {"edges": made.count(), "next": first + size}

    return job
