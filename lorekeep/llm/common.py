"""What the training-data operators share: tables written between steps, row hashing, training folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import new_path, workspace, written  # noqa: F401  the operators take them from here


def dropped(*tables: DataFrame) -> None:
    """Deletes tables made by ``written`` that nothing reads any more."""
    for t in tables:
        path = getattr(t, "_lorekeep_path", None)
        if path:
            p = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def fold(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id's decimal text modulo ``n``; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def joined_to_classes(rows: DataFrame, classes: DataFrame, key: str, size: str, most: int = 10_000) -> DataFrame:
    """``rows`` joined by ``key`` to ``classes``, which has each key once with its number of rows in the column ``size``.

    Classes of more than one in ``most`` of all rows, of which there are fewer than ``most``, meet their rows by a broadcast; so
    a class that holds a third of all rows isn't shuffled into one task. The rest join by shuffle.
    """
    total = classes.agg(F.sum(size)).first()[0] or 0
    large = F.col(size) > F.lit(max(total // most, 1))
    by_large = rows.join(F.broadcast(classes.where(large).withColumn("_large", F.lit(True))), key, "left")  # fewer than ``most`` rows
    names = [*rows.columns, *(c for c in classes.columns if c not in (key, size))]
    rest = by_large.where("_large IS NULL").select(*rows.columns).join(classes.where(~large), key)
    return by_large.where("_large").select(names).union(rest.select(names))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
