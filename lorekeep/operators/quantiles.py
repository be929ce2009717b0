"""Exact positional quantiles by selection: brackets around the wanted places, narrowed in rounds until they are small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workspace import written

#: Bounds that a round tries within a bracket, and distinct values that are put in order at last.
BOUNDS, SMALL = 255, 2048


def _inside(column: str, low, high) -> Column:
    """Values from ``low`` on and below ``high``; None is no bound."""
    c = F.lit(True)
    if low is not None:
        c = c & (F.col(column) >= F.lit(low))
    return c if high is None else c & (F.col(column) < F.lit(high))


def positional_quantiles(df: DataFrame, column: str, points: dict[str, tuple[int, int]]) -> DataFrame:
    """(name, value): the values at floor(n * m / d) of the sorted column, exactly, nulls left out, NaN last; no rows for no values.

    Values are counted first, so that a frequent one is a single row whatever its share. A quantile sketch of the distinct
    values in a bracket gives bounds that cut it into parts of about one size, outliers or not; sums over the parts tell which of
    them holds the place. Neither a sort of all rows nor a window is needed, and the driver gets counts of ``BOUNDS`` parts a round.
    """
    spark = df.sparkSession
    counts = written(df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")), "counts")
    total, distinct = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    kind = df.schema[column].dataType
    if not total:
        return spark.createDataFrame([], f"name string, {column} {kind.simpleString()}")
    wanted = {name: total * m // d for name, (m, d) in points.items()}
    open_ = {(None, None, 0, distinct): list(wanted)}  # (low, high, rows before, distinct values) and the points within
    found = {}
    while open_:
        (low, high, before, many), names = open_.popitem()
        part = counts.where(_inside(column, low, high))
        if many <= SMALL:
            rows = part.orderBy(column).collect()
            for name in names:
                at = before
                for r in rows:
                    at += r.n
                    if wanted[name] < at:
                        found[name] = r[column]
                        break
            continue
        share = [(k + 1) / (BOUNDS + 1) for k in range(BOUNDS)]
        bounds = sorted(set(part.agg(F.percentile_approx(column, share, 10 * BOUNDS).alias("b")).first().b) - {low})
        bounds = [b for b in bounds if b == b]  # NaN is above all
        if not bounds:  # one value fills the sketch: it can only be that the rest lies above it
            bounds = [part.where(F.col(column) > F.lit(low)).agg(F.min(column)).first()[0]]
        place = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col(column)))
        sums = {r.k: (r.n, r.d) for r in part.groupBy(place.alias("k")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("d")).collect()}
        for k in range(len(bounds) + 1):
            n, d = sums.get(k, (0, 0))
            mine = [x for x in names if before <= wanted[x] < before + n]
            if mine:
                open_[bounds[k - 1] if k else low, bounds[k] if k < len(bounds) else high, before, d] = mine
            before += n
    return spark.createDataFrame([(name, found[name]) for name in points], f"name string, {column} {kind.simpleString()}")
