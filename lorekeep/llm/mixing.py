"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Every document of a source should be taken ``target / source_size`` times. The whole part is taken outright; the fraction is
rounded by duels: one of two documents hands the other as many words of its expected share as make one of them integral (0 or 1
further copy); chance picks the direction so that expectations stay, and the other document carries what is left. As words
are handed on, their sum never changes: a source misses its target by half of its last document at most. Blocks of ``BLOCK``
documents, large before small, each leave one residual, and the residuals of ``BLOCK`` blocks duel again, so the reduction is a
tree of depth log_BLOCK(n) whose nodes are bounded however large a source is. Blocks take every n-th document by size, so
that large ones meet many small ones. The few documents that hold more than 1/``BLOCK`` of their source each are settled first,
largest first, each against all that come after it, whose shares take up the difference.

Shares are whole multiples of 2^-20 words and chance is a hash of ranks and seed: reruns agree under any partitioning.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, written

BLOCK, CAP = 64, 3
_ONE, _UNIT = 1 << 40, 1 << 20
#: Cells that split the documents of one source and size, so that none of them is ranked in a single group.
_CELLS = 256


def word_count(text: str = "text") -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sized: DataFrame, cap: int = CAP, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(src, source, source_size, target) from rows (src, source, size).

    Sources in order of code points, null last, weigh ``weights`` in turn and share the total of all sizes; none gets more
    than ``cap`` times its own, and what is over goes to the others by weight until none is above. The level at which all
    fits is found from sums over the source table.
    """
    per = sized.groupBy("src", "source").agg(F.sum("size").alias("source_size"))
    n = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1  # one row a source
    per = written(per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (n % len(weights) + 1).cast("int")).cast("double")), "sources")
    total, weight = per.agg(F.sum("source_size"), F.sum("weight")).first()
    level, full = (total or 0) / weight if weight else 0.0, -1
    top = F.col("source_size") * cap
    while True:
        over = top < F.col("weight") * F.lit(level)
        capped, free, count = per.agg(F.coalesce(F.sum(F.when(over, top)), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)), F.count(F.when(over, 1))).first()
        if count == full or not free:
            break
        level, full = (total - capped) / free, count
    return per.select("src", "source", "source_size", F.least(top.cast("double"), F.col("weight") * F.lit(level)).alias("target"))


def ranked(rows: DataFrame) -> DataFrame:
    """Adds ``rank``, from 0 within ``src`` by (size, cell, doc_id, key): counts of cells are summed up, rows are numbered within a cell."""
    cells = rows.groupBy("src", "size", "cell").agg(F.count(F.lit(1)).alias("n"))
    sizes = cells.groupBy("src", "size").agg(F.sum("n").alias("n"))
    before = lambda *by: F.coalesce(F.sum("n").over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = cells.select("src", "size", "cell", before("src", "size", "cell").alias("in_size")).join(
        sizes.select("src", "size", before("src", "size").alias("in_src")), ["src", "size"]).select("src", "size", "cell", (F.col("in_size") + F.col("in_src")).alias("offset"))
    nth = F.row_number().over(Window.partitionBy("src", "size", "cell").orderBy("doc_id", "key"))
    return rows.withColumn("_nth", nth).join(offsets, ["src", "size", "cell"]).withColumn("rank", F.col("offset") + F.col("_nth") - 1).drop("_nth", "offset")


def _duels(level: int, seed: int) -> str:
    """SQL of the duels of one block ``xs`` of (order, rank, words, most, item): the survivor ``cur`` and those settled, ``done``."""
    chance = f"((xxhash64(s.cur.rank, x.rank, {level}, {seed}L) & {_ONE - 1}L) / {_ONE}.0D)"
    give, take = "least(s.cur.words, x.most - x.words)", "least(x.words, s.cur.most - s.cur.words)"
    moved = f"if({chance} * ({give} + {take}) < {take}, -{give}, {take})"
    kept = lambda who, d: f"named_struct('order', {who}.order, 'rank', {who}.rank, 'words', {who}.words {d}, 'most', {who}.most, 'item', {who}.item)"
    gone = lambda who, d: f"array(named_struct('item', {who}.item, 'more', if({who}.words {d} = 0, 0L, 1L)))"
    return f"""aggregate(slice(xs, 2, {BLOCK}),
        named_struct('cur', xs[0], 'done', filter(array(named_struct('item', xs[0].item, 'more', 0L)), d -> false)),
        (s, x) -> transform(array({moved}), d -> if(s.cur.words + d = 0 or s.cur.words + d = s.cur.most,
            named_struct('cur', {kept('x', '- d')}, 'done', concat(s.done, {gone('s.cur', '+ d')})),
            named_struct('cur', {kept('s.cur', '+ d')}, 'done', concat(s.done, {gone('x', '- d')}))))[0])"""


def rounded(rows: DataFrame, most: int, seed: int = 7) -> DataFrame:
    """(item, more): 0 or 1 for every row (src, n, rank, words, item), item.size being its words and ``words`` the share of
    them to be taken, in units of 2^-20. Each ``more`` has the mean of its share, but for the last of a source, which is rounded.

    ``n`` is the number of rows of the source, their ranks being 0 to n - 1; ``most`` is the largest n: it sets the tree's depth.
    """
    size = F.col("item.size")
    now = rows.select("src", "n", (-size).alias("order"), "rank", "words", (size * _UNIT).alias("most"), "item")
    out = None
    for level in range(max(1, math.ceil(math.log(max(most, 2), BLOCK) - 1e-9))):
        n = F.expr(f"(n + {BLOCK - 1}) div {BLOCK}")
        blocks = now.groupBy("src", n.alias("n"), (F.col("rank") % n).alias("block")).agg(F.sort_array(F.collect_list(F.struct("order", "rank", "words", "most", "item"))).alias("xs"))
        duels = written(blocks.select("src", "n", "block", F.expr(_duels(level, seed)).alias("r")), "duels")
        done = duels.select(F.explode("r.done").alias("d")).select("d.item", "d.more")
        out = done if out is None else out.union(done)
        now = duels.select("src", "n", F.col("r.cur.order").alias("order"), F.col("block").alias("rank"), F.col("r.cur.words").alias("words"), F.col("r.cur.most").alias("most"), F.col("r.cur.item").alias("item"))
    return out.union(now.select("item", F.when(F.col("words") * 2 >= F.col("most"), F.lit(1)).otherwise(F.lit(0)).cast("bigint").alias("more")))


def heavy_first(rows: DataFrame, goals: DataFrame, cap: int, seed: int) -> DataFrame:
    """Per source with documents of over 1/BLOCK of its size: what is left of target and size once they are settled, and ``done``
    (item, copies). There are fewer than BLOCK of them in a source."""
    some = rows.join(goals, "src").where(F.col("size") * BLOCK > F.col("source_size"))
    xs = F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("order"), "cell", F.struct("doc_id", "key", "size", "src").alias("item"))))
    per = some.groupBy("src", "source_size", "target").agg(xs.alias("xs"))
    share = f"greatest(0.0D, least({cap}.0D, s.goal / s.size))"
    step = f"""aggregate(xs, named_struct('goal', target, 'size', cast(source_size as double), 'done', filter(array(named_struct('item', xs[0].item, 'copies', 0L)), d -> false)),
        (s, x) -> transform(array(cast(floor({share} + (xxhash64(x.item.key, x.item.doc_id, {seed}L) & {_ONE - 1}L) / {_ONE}.0D) as bigint)), c -> named_struct(
            'goal', s.goal - c * x.item.size, 'size', s.size - x.item.size, 'done', concat(s.done, array(named_struct('item', x.item, 'copies', c)))))[0])"""
    return per.select("src", F.expr(step).alias("r")).select("src", F.col("r.goal").alias("goal"), F.col("r.size").alias("rest"), "r.done")


def row_key(docs: DataFrame) -> Column:
    """A hash of the whole row; nulls count, as hashes alone pass over them."""
    cols = [F.col("`" + c.replace("`", "``") + "`").cast("string") for c in sorted(docs.columns)]
    return F.xxhash64(*[x for c in cols for x in (c, c.isNull())])


def mixed(docs: DataFrame, cap: int = CAP, weights: tuple[int, ...] = (1, 2, 3), seed: int = 7) -> DataFrame:
    """(doc_id, key, source, size, source_size, target, copies) for every row of ``docs`` (doc_id, text, source).

    ``key`` is a hash of the whole row. Null texts have size 0 and, like empty ones, take no part in the duels; a null source is
    a source of its own, weighed last; repeated rows are rows of their own; null ids are allowed; an empty table gives none.
    """
    rows = docs.select(
        "doc_id", row_key(docs).alias("key"), "source", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("src"), word_count().alias("size"),
    ).withColumn("cell", F.pmod(F.xxhash64("doc_id", "key", F.lit(seed)), F.lit(_CELLS)).cast("int"))
    rows = written(rows, "sized")
    goals = written(targets(rows, cap, weights), "targets")
    first = written(heavy_first(rows.drop("source"), goals, cap, seed), "heavy")
    # of all others the same share: what is left of the target over what is left of the size, in units of 2^-40
    left = goals.join(first.drop("done"), "src", "left").withColumn("goal", F.coalesce("goal", "target")).withColumn("rest", F.coalesce("rest", F.col("source_size").cast("double")))
    share = F.when(F.col("rest") >= 1, F.round(F.greatest(F.lit(0.0), F.least(F.lit(float(cap)), F.col("goal") / F.col("rest"))) * _ONE).cast("bigint")).otherwise(F.lit(0))
    light = written(left.select("src", "source_size", F.floor(share / _ONE).alias("whole"), (share % _ONE).alias("p")), "shares")
    item = F.struct("doc_id", "key", "size", "src").alias("item")
    rows = rows.join(light, "src").where(F.col("size") * BLOCK <= F.col("source_size"))
    duelling = rows.where("size > 0 AND p > 0")
    numbers = written(duelling.groupBy("src").agg(F.count(F.lit(1)).alias("n")), "numbers")
    most = numbers.agg(F.max("n")).first()[0] or 0
    words = F.round(F.col("size") * (F.col("p") / float(_ONE // _UNIT))).cast("bigint")
    duelling = ranked(duelling).join(numbers, "src").select("src", "n", "rank", words.alias("words"), item)
    settled = rows.where("size = 0 OR p = 0").select(item, F.lit(0).cast("bigint").alias("more"))
    lights = (rounded(duelling, most, seed).union(settled) if most else settled).select("item.*", "more").join(light.select("src", "whole"), "src")
    out = lights.select("doc_id", "key", "size", "src", (F.col("whole") + F.col("more")).alias("copies")).union(first.select(F.explode("done").alias("d")).select("d.item.*", "d.copies"))
    return out.join(goals, "src").select("doc_id", "key", "source", "size", "source_size", "target", "copies")


def mixture(docs: DataFrame, cap: int = CAP, weights: tuple[int, ...] = (1, 2, 3), seed: int = 7) -> DataFrame:
    """The rows of ``docs`` themselves, each as often as the mix takes it. Rows equal in all columns share their copies. Rows
    travel as structs, so that no column's name can clash."""
    taken = mixed(docs, cap, weights, seed).groupBy("key").agg(F.sum("copies").alias("copies")).where("copies > 0")
    joined = docs.select(F.struct("*").alias("row"), row_key(docs).alias("key")).join(taken, "key")
    once = joined.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("copies"))).where("nth = 1")  # equal rows
    return once.select("row", F.explode(F.expr("sequence(1L, copies)"))).select("row.*")
