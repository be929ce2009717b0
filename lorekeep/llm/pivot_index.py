"""Near-duplicate embeddings by a pivot-permutation index.

A vector is described by its ``DEPTH`` nearest reference vectors (pivots), in order of nearness. Vectors whose descriptions
share ``SHARED`` pivots or more are candidates, and a candidate is a link if its cosine, in double precision, reaches the
threshold; within a list both tests are made for all its vectors at once, the cheaper first. Candidates are retrieved from inverted lists, one a pivot: with pivots in a fixed order, rare ones first, two
descriptions with ``SHARED`` pivots in common have their first common one among the first ``DEPTH - SHARED + 1`` of each, so
only those lists hold the vector, and a pair counts in the list of its first common pivot alone. Long lists are cut into
chunks that meet in pairs, so a task sees a bounded number of vectors. Tasks return sums of links and edges that span what is
linked, never the pairs: exact copies are one vector with a count, and groups of near copies cost no quadratic output.

Pivots are a bounded sample of the distinct vectors, four times the root of their number and ``MOST`` at most, thinned until
no two of them are within ``APART`` times the angle of a link: a large group of near vectors would else supply so many pivots
that each member's nearest all lie inside the group, in an order of their own. All vectors are indexed. The README gives the
measured recall.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import components

DEPTH, SHARED, LEAST, MOST, CHUNK, APART = 16, 4, 64, 4096, 1024, 1.5
_INDEXED = "node bigint, copies bigint, vector array<double>, near array<int>"


def thinned(pivots: np.ndarray, threshold: float) -> np.ndarray:
    """The rows of unit vectors that are further than ``APART`` times the angle of ``threshold`` from every row kept before."""
    limit = math.cos(min(APART * math.acos(max(-1.0, min(1.0, threshold))), math.pi))
    free, keep = np.ones(len(pivots), bool), []
    for lo in range(0, len(pivots), 256):
        if not free[lo : lo + 256].any():
            continue
        close = pivots[lo : lo + 256] @ pivots.T >= limit
        for i in range(len(close)):
            if free[lo + i]:
                keep.append(lo + i)
                free &= ~close[i]
    return pivots[keep]


def nearest(x: np.ndarray, pivots: np.ndarray, depth: int) -> np.ndarray:
    """The ``depth`` nearest pivots of each unit row by cosine, nearest first, ties by number."""
    score = -(x @ pivots.T)
    if depth < score.shape[1]:  # all that can be among the nearest, then these in order
        far = np.partition(score, depth - 1, axis=1)[:, depth - 1 : depth]
        out = np.empty((len(x), depth), np.int32)
        for r, row in enumerate(score <= far):
            some = np.nonzero(row)[0]
            out[r] = some[np.argsort(score[r, some], kind="stable")[:depth]]
        return out
    return np.argsort(score, axis=1, kind="stable")[:, :depth].astype(np.int32)


def described(classes: DataFrame, pivots: np.ndarray, depth: int) -> DataFrame:
    """``classes`` (node, copies, vector) with the numbers of their nearest pivots."""

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                part = b.slice(lo, 2048)
                near = nearest(units(_matrix(part.column(2))), pivots, depth)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(list(near), pa.list_(pa.int32()))], names=["node", "copies", "vector", "near"])

    return classes.select("node", "copies", "vector").mapInArrow(run, _INDEXED)


def shared_pivots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many pivots the rows of two (n, depth) arrays of sorted ranks have in common, and the first of them."""
    same = a[:, :, None] == b[:, None, :]
    mine = same.any(2)
    return mine.sum(1), np.where(mine, a, np.iinfo(a.dtype).max).min(1)


def list_links(left: tuple, right: tuple | None, pivot: int, shared: int, threshold: float) -> dict[str, np.ndarray]:
    """Sums of links and spanning edges among vectors of one list: of ``left`` with itself, or with ``right``.

    Each side is (nodes, copies, unit vectors, sorted pivot ranks). One matrix product gives the cosines of the list, which is
    cheaper than counting its shared pivots; the counts then decide about those pairs that reach the threshold.
    """
    other = left if right is None else right
    found = left[2] @ other[2].T >= threshold - 1e-9
    if right is None:
        found = np.triu(found, 1)
    i, j = np.nonzero(found)
    ok = np.zeros(len(i), bool)
    for lo in range(0, len(i), 20_000):
        s, t = i[lo : lo + 20_000], j[lo : lo + 20_000]
        count, first = shared_pivots(left[3][s], other[3][t])
        cos = np.einsum("ij,ij->i", left[2][s], other[2][t])
        ok[lo : lo + 20_000] = (cos >= threshold) & (count >= shared) & (first == pivot)
    i, j = i[ok], j[ok]
    nodes = np.concatenate([left[0][i], other[0][j]])
    uniq, at = np.unique(nodes, return_inverse=True)
    links = np.bincount(at, np.concatenate([other[1][j], left[1][i]]).astype(np.float64), len(uniq)).astype(np.int64)
    root = np.arange(len(uniq))
    while len(i):
        x, y = root[at[: len(i)]], root[at[len(i) :]]
        new, low = root.copy(), np.minimum(x, y)
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return {"node": uniq, "links": links, "root": uniq[root]}


def _matrix(column) -> np.ndarray:
    """A column of lists of one length as an array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def units(x: np.ndarray) -> np.ndarray:
    """Vectors of length one; divided by their largest component first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def index_links(classes: DataFrame, threshold: float = 0.9, depth: int = DEPTH, shared: int = SHARED) -> DataFrame:
    """(node, links, root) of ``classes`` (node, copies, vector), all vectors of one length: rows to be summed by node; node and
    root are linked."""
    n = classes.count()
    want = min(MOST, max(LEAST, round(4 * math.sqrt(n))), n)
    sample = classes.select("vector").orderBy(F.xxhash64("node", F.lit(11)), "node").limit(want).collect()
    if not sample:
        return classes.select("node", F.lit(0).cast("bigint").alias("links"), F.col("node").alias("root")).limit(0)
    pivots = thinned(units(np.array([r.vector for r in sample], np.float64)), threshold)
    # where descriptions name every pivot all pairs are candidates, which one list gives
    depth, shared = (depth, min(shared, depth)) if depth < len(pivots) else (len(pivots), len(pivots))
    indexed = written(described(classes, pivots, depth), "described")
    # rare pivots first; at most MOST rows
    seen = {r[0]: r[1] for r in indexed.select(F.explode("near").alias("p")).groupBy("p").count().collect()}
    rank = np.empty(len(pivots), np.int32)
    rank[sorted(range(len(pivots)), key=lambda p: (seen.get(p, 0), p))] = np.arange(len(pivots))

    def by_rank(batches):
        for b in batches:
            near = np.sort(rank[b.column(3).flatten().to_numpy()].reshape(-1, depth), axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(list(near), pa.list_(pa.int32()))], names=["node", "copies", "vector", "near"])

    indexed = indexed.mapInArrow(by_rank, _INDEXED)
    listed = indexed.withColumn("list", F.explode(F.slice("near", 1, depth - shared + 1)))
    chunks = listed.groupBy("list").count().select("list", F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks"))
    listed = (
        listed.join(F.broadcast(chunks), "list")  # one row a pivot
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("list", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("second"), "node", "copies", "vector", "near")
    )

    def side(t: pa.Table):
        return (t.column("node").to_numpy(), t.column("copies").to_numpy(), units(_matrix(t.column("vector"))), _matrix(t.column("near")))

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        import pyarrow.compute as pc

        pivot, i, j = (k.as_py() for k in key)
        first, second = table.filter(pc.invert(table.column("second"))), table.filter(table.column("second"))
        if not first.num_rows or (i != j and not second.num_rows):
            return pa.table({k: pa.array([], pa.int64()) for k in ("node", "links", "root")})
        return pa.table(list_links(side(first), None if i == j else side(second), pivot, shared, threshold))

    return listed.groupBy("list", "i", "j").applyInArrow(run, "node bigint, links bigint, root bigint")


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, depth: int = DEPTH, shared: int = SHARED) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding).

    n_links counts the other rows at a cosine of ``threshold`` or more, copies included. Vectors that are null, empty, zero or
    hold null or non-finite components link with nothing, nor do vectors of different lengths. Rows with a null vec_id take
    part; a group's id is its smallest that is not null. An empty table gives no rows. A copy is known by the 64-bit hash of
    its components.
    """
    ok = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"), F.coalesce(ok, F.lit(False)).alias("ok"))
    rows = rows.withColumn("node", F.xxhash64("vector"))
    classes = rows.where("ok").groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"), F.first("vector").alias("vector"))
    classes = written(classes, "classes")
    links = None
    for d in sorted(r[0] for r in classes.select(F.size("vector")).distinct().collect()):
        part = index_links(classes.where(F.size("vector") == d), threshold, depth, shared)
        links = part if links is None else links.union(part)
    plain = [F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")]
    if links is None:
        return vectors.select("vec_id", *plain)
    links = written(links, "links")
    comp = written(components(links.select("node", "root").where("node <> root")), "components").join(classes.select("node", "least"), "node")
    least = comp.groupBy("component").agg(F.min("least").alias("component_id"))
    named = comp.join(least, "component").select("node", "component_id")
    sums = links.groupBy("node").agg(F.sum("links").alias("links"))
    every = classes.select("node", "copies", "least").join(sums, "node", "left").join(named, "node", "left")
    every = every.select("node", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    good = rows.where("ok").select("vec_id", "node").join(every, "node").select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
    return good.union(rows.where("not ok").select("vec_id", *plain))
