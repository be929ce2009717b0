"""General table operators: upserts and other changes as pure functions, distributions, top-n per group, snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def newest(df: DataFrame, n: int, by: str, tie: str) -> DataFrame:
    return df.orderBy(F.col(by).desc(), tie).limit(n)


def pinned(df: DataFrame) -> DataFrame:
    """The rows of ``df``, which the caller bounds, as a literal table: what joins them several times doesn't compute them again."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def top_per(df: DataFrame, keys: list[str], order: list[Column | str], n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def paged(rows: DataFrame, group: str, order: str, size: int, width: int = 100_000) -> DataFrame:
    """``rows`` with ``n``, the rows of their group, and ``page``, their place in it by the whole number ``order`` in pages of ``size``.

    Places are counted within ranges of ``width`` numbers and summed over the ranges before, so that no group is one window."""
    r = F.floor(F.col(order) / width)
    by = rows.groupBy(group, r.alias("_r")).agg(F.count(F.lit(1)).alias("_k"))
    w = Window.partitionBy(group).orderBy("_r")  # a row a range
    by = by.select(group, "_r", (F.sum("_k").over(w) - F.col("_k")).alias("_before"), F.sum("_k").over(Window.partitionBy(group)).alias("n"))
    place = F.row_number().over(Window.partitionBy(group, "_r").orderBy(order)) + F.col("_before") - 1
    return rows.withColumn("_r", r).join(by, [group, "_r"]).withColumn("page", F.floor(place / size)).drop("_r", "_before")


def replaced(base: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """INSERT OR REPLACE: rows of ``updates`` stand in for those of ``base`` with their key."""
    return base.join(updates.select(*keys).distinct(), keys, "left_anti").unionByName(updates)


def ignored(base: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """INSERT OR IGNORE: only rows of ``updates`` with a new key are added."""
    return base.unionByName(updates.join(base.select(*keys).distinct(), keys, "left_anti"))


def merged(base: DataFrame, updates: DataFrame, keys: list[str], always: tuple[str, ...] = ()) -> DataFrame:
    """ON CONFLICT DO UPDATE with COALESCE(new, old) per column; columns in ``always`` take the new value even if null."""
    rest = [c for c in base.columns if c not in keys]
    b, u = base.alias("b"), updates.withColumn("_new", F.lit(True)).alias("u")
    cond = reduce(lambda x, y: x & y, [F.col(f"b.{k}") == F.col(f"u.{k}") for k in keys])
    pick = [F.coalesce(F.col(f"b.{k}"), F.col(f"u.{k}")).alias(k) for k in keys]
    pick += [(F.when(F.col("u._new"), F.col(f"u.{c}")).otherwise(F.col(f"b.{c}")) if c in always else F.coalesce(F.col(f"u.{c}"), F.col(f"b.{c}"))).alias(c) for c in rest]
    return b.join(u, cond, "full").select(*pick)


def deleted(ids: DataFrame, parent: DataFrame, children: dict[str, tuple[DataFrame, list[str]]], key: str = "id") -> dict[str, DataFrame]:
    """``parent`` and its children without the rows of ``ids`` (id): a cascade by anti-joins over each child's key columns."""
    out = {"parent": parent.join(ids.select(F.col("id").alias(key)), key, "left_anti")}
    for name, (child, columns) in children.items():
        for c in columns:
            child = child.join(ids.select(F.col("id").alias(c)), c, "left_anti")
        out[name] = child
    return out


def free_slot(taken: DataFrame, slots: int) -> DataFrame:
    """The first of ``slots`` numbers that isn't in ``taken`` (slot)."""
    spark = taken.sparkSession
    return spark.range(slots).withColumnRenamed("id", "slot").join(taken.select("slot"), "slot", "left_anti").agg(F.min("slot").alias("slot"))


def side_by_side(*frames: DataFrame) -> DataFrame:
    """One row of the columns of all ``frames``, each of which has one row at most: a union and an aggregate, no join."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.agg(*[F.max(c).alias(c) for c in out.columns])
