"""Hard negatives by dual-tree search for the largest inner products.

Vectors become integer vectors. A tree of hyperplane splits, fitted to a bounded sample, deals all rows to its leaves; over the
anchors in them it is one tree, over all rows, the candidates, another: each leaf has the ball of its own rows. Both trees are
walked together from their roots. Centres and radii bound the inner products of a pair of nodes to an interval; where it lies
outside what any anchor of the node can still use, all its anchors are done with all rows of the other node at once. What is left at
the leaves meets in tasks of bounded size and is scored exactly.

What an anchor can still use: for positives, scores from that of its fifth positive among the sample on; for negatives,
the windows below its positives' scores, from the tenth of the sample in them on. Both bounds come from rows of the table,
so nothing is lost by them. Positives are searched first, then negatives.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Rows of the sample; rows of a leaf as far as the leaves suffice; leaves at most; candidates and anchors that meet in a task.
SAMPLE, LEAF, LEAVES, CHUNK, ANCHORS = 4096, 256, 512, 16_384, 4096
#: Stands for a null vec_id in tasks, after all others.
_NONE = 2**63 - 1
_LOW, _HIGH = -(2**63), 2**63 - 1


class Tree:
    """Hyperplane splits of sampled rows. Inner node i goes to ``left[i]`` where direction . x < cut, else to ``right[i]``; leaves have
    ``leaf[i]`` >= 0. ``centre`` is the mean of a node's sample."""

    def __init__(self, x: np.ndarray, leaves: int):
        self.direction, self.cut, self.left, self.right, self.leaf, self.centre = [], [], [], [], [], []
        rows = [self._add(x)]
        members = {rows[0]: np.arange(len(x))}
        while len(members) < leaves:
            node = max(members, key=lambda i: (len(members[i]), -i))
            split = _split(x[members[node]]) if len(members[node]) >= 8 else None
            if split is None:
                break
            (self.direction[node], self.cut[node]), own = split, members.pop(node)
            low = x[own] @ self.direction[node] < self.cut[node]
            for side, some in ((self.left, own[low]), (self.right, own[~low])):
                side[node] = self._add(x[some])
                members[side[node]] = some
        for number, node in enumerate(self._leaves_in_order(0)):
            self.leaf[node] = number
        self.leaves = number + 1
        self.direction, self.cut, self.centre = np.array(self.direction), np.array(self.cut), np.array(self.centre)
        self.left, self.right, self.leaf = np.array(self.left), np.array(self.right), np.array(self.leaf)

    def _add(self, x: np.ndarray) -> int:
        for column, value in ((self.direction, np.zeros(x.shape[1])), (self.cut, 0.0), (self.left, -1), (self.right, -1), (self.leaf, -1), (self.centre, x.mean(0))):
            column.append(value)
        return len(self.cut) - 1

    def _leaves_in_order(self, root: int):
        stack = [root]
        while stack:
            i = stack.pop()
            if self.left[i] < 0:
                yield i
            else:
                stack += [self.right[i], self.left[i]]

    def dealt(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaf of each row, and its distance from the leaf's centre."""
        at = np.zeros(len(x), np.int64)
        while (inner := np.nonzero(self.left[at] >= 0)[0]).size:
            i = at[inner]
            at[inner] = np.where(np.einsum("ij,ij->i", x[inner], self.direction[i]) < self.cut[i], self.left[i], self.right[i])
        return self.leaf[at], np.linalg.norm(x - self.centre[at], axis=1)

    def radii(self, of_leaves: np.ndarray) -> np.ndarray:
        """A radius of every node that covers the balls of its leaves; -1 of nodes that have no rows (radius -1 of their leaves)."""
        out = np.full(len(self.cut), -1.0)
        for i in range(len(self.cut) - 1, -1, -1):  # children come after their parents
            if self.left[i] < 0:
                out[i] = of_leaves[self.leaf[i]]
            else:
                below = [np.linalg.norm(self.centre[i] - self.centre[c]) + out[c] for c in (self.left[i], self.right[i]) if not out[c] < 0]
                out[i] = max(below, default=-1.0)
        return out

    def upwards(self, of_leaves: np.ndarray, join) -> np.ndarray:
        """A value of every node, joined from its leaves' values."""
        out = np.zeros(len(self.cut), of_leaves.dtype)
        for i in range(len(self.cut) - 1, -1, -1):
            out[i] = of_leaves[self.leaf[i]] if self.left[i] < 0 else join(out[self.left[i]], out[self.right[i]])
        return out


def _split(x: np.ndarray) -> tuple[np.ndarray, float] | None:
    """The axis along which rows vary most, by power iteration, and a cut between two means; None where rows can't be told apart."""
    y = x - x.mean(0)
    size = np.abs(y).max()
    if not 0 < size < np.inf:
        return None
    y = y / size
    axis = y[np.argmax(np.einsum("ij,ij->i", y, y))]
    for _ in range(8):
        axis = y.T @ (y @ axis)
        axis = axis / np.linalg.norm(axis)
    along = x @ axis
    cut = along.mean()
    for _ in range(8):  # between the means of both sides, so that groups stay whole
        low = along < cut
        if not 0 < low.sum() < len(x):
            return None
        cut = (along[low].mean() + along[~low].mean()) / 2
    return (axis, float(cut)) if np.isfinite(cut) and 0 < (along < cut).sum() < len(x) else None


def walked(tree: Tree, own: np.ndarray, other: np.ndarray, low: np.ndarray, high: np.ndarray, mine: np.ndarray | None = None, theirs: np.ndarray | None = None) -> np.ndarray:
    """(leaves, leaves) booleans: which leaves of anchors meet which leaves of candidates.

    ``own`` and ``other`` are the radii of the leaves over anchors and over candidates, -1 where there are none; an anchor of a
    leaf can use scores from ``low`` to ``high``, and candidates that share a bit of ``mine`` and ``theirs``. A pair of nodes is left where
    the interval of its inner products can't hold such a score.
    """
    ra, rc = tree.radii(own), tree.radii(other)
    lo, hi = tree.upwards(low, min), tree.upwards(high, max)
    bits = None if mine is None else (tree.upwards(mine, lambda a, b: a | b), tree.upwards(theirs, lambda a, b: a | b))
    length = np.linalg.norm(tree.centre, axis=1)
    keep = np.zeros((tree.leaves, tree.leaves), bool)
    a = c = np.zeros(1, np.int64)
    while len(a):
        near = np.einsum("ij,ij->i", tree.centre[a], tree.centre[c])
        wide = length[a] * rc[c] + ra[a] * length[c] + ra[a] * rc[c]
        wide = wide + 1 + 1e-9 * (np.abs(near) + wide)
        go = ~((ra[a] < 0) | (rc[c] < 0) | (near + wide < lo[a]) | (near - wide > hi[a]))
        if bits:
            go &= (bits[0][a] & bits[1][c]) != 0
        a, c = a[go], c[go]
        la, lc = tree.left[a] < 0, tree.left[c] < 0
        keep[tree.leaf[a[la & lc]], tree.leaf[c[la & lc]]] = True
        pairs = []
        for i, j, which in ((0, 0, ~la & ~lc), (0, 1, ~la & ~lc), (1, 0, ~la & ~lc), (1, 1, ~la & ~lc), (0, None, ~la & lc), (1, None, ~la & lc), (None, 0, la & ~lc), (None, 1, la & ~lc)):
            pairs.append((_child(tree, a[which], i), _child(tree, c[which], j)))
        a, c = (np.concatenate(x) for x in zip(*pairs, strict=True))
    return keep


def _child(tree: Tree, nodes: np.ndarray, side: int | None) -> np.ndarray:
    return nodes if side is None else (tree.right if side else tree.left)[nodes]


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Components as integers in doubles: floor(256 x)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks else pa.array([], column.type)
    return np.floor(256.0 * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width))


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two arrays of whole numbers as int64; beyond 64 bits the largest or least of them."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(a.shape[1], 1)
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in r] for r in x], object).reshape(x.shape)
    return np.array([[min(max(int(sum(p * q for p, q in zip(r, s, strict=True))), _LOW), _HIGH) for s in whole(b)] for r in whole(a)], np.int64).reshape(len(a), len(b))


def top(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` first by falling score, then rising id."""
    if len(score) > 4 * k:
        some = np.nonzero(score >= np.partition(score, len(score) - k)[len(score) - k])[0]
    else:
        some = np.arange(len(score))
    return some[np.lexsort((ids[some], -score[some]))[:k]]


def windows(positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest score of a negative of each positive score: 30 p <= 100 n <= 90 p."""
    p = [int(x) for x in positive]
    return np.array([max(-(-30 * x // 100), _LOW) for x in p], np.int64), np.array([min(90 * x // 100, _HIGH) for x in p], np.int64)


def _label_bit() -> Column:
    """One of 64 bits for the row's label."""
    return F.expr("shiftleft(1L, cast(pmod(xxhash64(label), 64) as int))")


def _ids(column) -> np.ndarray:
    return column.fill_null(_NONE).to_numpy()


def _leaf_table(rows: DataFrame, leaves: int, *columns: Column) -> dict[str, np.ndarray]:
    """Aggregates by leaf; ``leaves`` entries, with radius -1 where there is no row."""
    found = {r["leaf"]: r for r in rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far"), F.bit_or("bit").alias("bit"), *columns).collect()}
    get = lambda name, other, kind: np.array([other if i not in found or found[i][name] is None else found[i][name] for i in range(leaves)], kind)
    return {"n": get("n", 0, np.int64), "far": get("far", -1.0, float), "bit": get("bit", 0, np.int64), "rows": found, "get": get}


def _bins(counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each leaf, and the tasks its rows are cut into: neighbouring leaves share a bin while they have ``most`` rows."""
    bins, tasks, full = np.zeros(len(counts), np.int64), [0], 0
    for i, n in enumerate(counts.tolist()):
        if full and full + n > most:
            tasks.append(0)
            full = 0
        full += n
        bins[i], tasks[-1] = len(tasks) - 1, max(1, -(-full // most))
    return bins, np.array(tasks, np.int64)


def _met(anchors: DataFrame, rows: DataFrame, keep: np.ndarray, n_anchors: np.ndarray, n_rows: np.ndarray, run, schema: str) -> DataFrame:
    """``run(left, right, key)`` over anchors and candidates of the pairs of leaves in ``keep``, in tasks of bounded size.

    Candidates go to every task of the bins of anchors that they meet. The plans that say which have a row a leaf.
    """
    spark = rows.sparkSession
    (abin, atasks), (cbin, ctasks) = _bins(n_anchors, ANCHORS), _bins(n_rows, CHUNK)
    meets = np.zeros((len(atasks), len(ctasks)), bool)
    np.logical_or.at(meets, (abin[:, None], cbin[None, :]), keep)

    def plan(own_bin, own_tasks, other_tasks, table):
        out = []
        for leaf, b in enumerate(own_bin.tolist()):
            out.append((leaf, b, int(own_tasks[b]), [(int(o), int(other_tasks[o])) for o in np.nonzero(table[b])[0]]))
        return F.broadcast(spark.createDataFrame(out, "leaf int, own int, tasks int, others array<struct<bin:int,tasks:int>>"))  # LEAVES rows at most

    def spread(df, p, own, other, i, j):
        # a null id, like a repeated one, hashes with the vector
        df = df.join(p, "leaf").withColumn(i, F.pmod(F.xxhash64("vec_id", "embedding"), F.col("tasks")).cast("int")).withColumn("o", F.explode("others"))
        return df.withColumn(j, F.explode(F.sequence(F.lit(0), F.col("o.tasks") - 1))).withColumnRenamed("own", own).withColumn(other, F.col("o.bin")).drop("tasks", "others", "o")

    keys = ["a", "i", "c", "j"]
    left = spread(anchors, plan(abin, atasks, ctasks, meets), "a", "c", "i", "j")
    right = spread(rows.select("vec_id", "label", "leaf", "embedding"), plan(cbin, ctasks, atasks, meets.T), "c", "a", "j", "i")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


def _by_leaf(left: pa.Table, right: pa.Table, keep: np.ndarray, width: int):
    """For every leaf of anchors: its places in ``left``, the places of ``right`` that it meets, and their exact scores, a bounded
    number of anchors at once."""
    a, c = matrix(left.column("embedding"), width), matrix(right.column("embedding"), width)
    la, lc = left.column("leaf").to_numpy(), right.column("leaf").to_numpy()
    for leaf in np.unique(la):
        mine, theirs = np.nonzero(la == leaf)[0], np.nonzero(keep[leaf, lc])[0]
        for lo in range(0, len(mine), 256) if len(theirs) else ():
            some = mine[lo : lo + 256]
            yield some, theirs, scores(a[some], c[theirs])


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) over ``vectors`` (vec_id, embedding, label).

    Anchors are rows whose vec_id is divisible by ``every``; their positives the first ``positives`` other rows of their label by
    falling inner product of the vectors floor(256 x), then rising vec_id; a positive's negatives the first ``negatives`` rows of other
    labels with 30 p <= 100 n <= 90 p. Where vec_id is divisible by 7, the label is (label + 1) % 10.

    Rows with a null label or vector, or with a null or non-finite component, take no part. A null vec_id is no anchor and comes
    last among equal scores. Rows that repeat a vec_id are rows of their own but never positives of an anchor of that id;
    anchors alike in all columns are one. Vectors of different lengths don't meet. Scores are exact up to 64 bits. An empty
    table gives no rows.
    """
    finite = F.col("embedding").isNotNull() & F.col("label").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    relabelled = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("bigint")
    rows = vectors.where(F.coalesce(finite, F.lit(False))).select(F.col("vec_id").cast("bigint").alias("vec_id"), relabelled.alias("label"), "embedding")
    out = None
    for width in sorted(r[0] for r in rows.select(F.size("embedding")).distinct().collect()):
        part = _of_one_width(rows.where(F.size("embedding") == width), width, every, positives, negatives)
        if part is not None:
            out = part if out is None else out.union(part)
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    return vectors.sparkSession.createDataFrame([], schema) if out is None else out


def _of_one_width(rows: DataFrame, width: int, every: int, positives: int, negatives: int) -> DataFrame | None:
    sample = rows.orderBy(F.xxhash64("vec_id", "embedding"), "vec_id").limit(SAMPLE).toArrow()
    x = matrix(sample.column("embedding"), width)
    ids, labels = _ids(sample.column("vec_id")), sample.column("label").to_numpy()
    n = rows.count()
    tree = Tree(x, max(1, min(LEAVES, n // LEAF)))
    element = rows.schema["embedding"].dataType.elementType.simpleString()

    def deal(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                part = b.slice(lo, 2048)
                leaf, far = tree.dealt(matrix(part.column(2), width))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(leaf.astype(np.int32)), pa.array(far)], names=["vec_id", "label", "embedding", "leaf", "far"])

    dealt = rows.mapInArrow(deal, f"vec_id bigint, label bigint, embedding array<{element}>, leaf int, far double")
    dealt = written(dealt.withColumn("bit", _label_bit()), "dealt")
    theirs = _leaf_table(dealt, tree.leaves)

    # positives
    def seeded(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                s = scores(matrix(part.column(2), width), x)
                ok = (part.column(1).to_numpy()[:, None] == labels) & (_ids(part.column(0))[:, None] != ids)
                at = min(positives, len(x))
                best = np.partition(np.where(ok, s, _LOW), len(x) - at, axis=1)[:, len(x) - at]
                least = pa.array(best, mask=(ok.sum(1) < positives) | (at < positives))
                yield pa.RecordBatch.from_arrays([*part.columns, least], names=["vec_id", "label", "embedding", "leaf", "far", "bit", "least"])

    columns = f"vec_id bigint, label bigint, embedding array<{element}>, leaf int, far double, bit bigint"
    own = dealt.where(F.col("vec_id") % every == 0)
    anchors = written(own.mapInArrow(seeded, columns + ", least bigint").withColumn("anchor", F.xxhash64("vec_id", "label", "embedding")).dropDuplicates(["anchor", "vec_id", "label"]), "anchors")
    mine = _leaf_table(anchors, tree.leaves, F.min(F.coalesce("least", F.lit(_LOW))).alias("low"))
    if not mine["n"].sum():
        return None
    low = mine["get"]("low", _HIGH, np.int64).astype(float)
    keep = walked(tree, mine["far"], theirs["far"], low, np.full(tree.leaves, np.inf), mine["bit"], theirs["bit"])

    def positive(key, left, right):
        found = {"anchor": [], "score": [], "id": []}
        numbers, mine, least = left.column("anchor").to_numpy(), _ids(left.column("vec_id")), left.column("least").fill_null(_LOW).to_numpy()
        label, other, others = left.column("label").to_numpy(), _ids(right.column("vec_id")), right.column("label").to_numpy()
        for some, seen, s in _by_leaf(left, right, keep, width):
            for r, i in enumerate(some):
                ok = np.nonzero((others[seen] == label[i]) & (other[seen] != mine[i]) & (s[r] >= least[i]))[0]
                ok = ok[top(s[r][ok], other[seen[ok]], positives)]
                found["anchor"] += [numbers[i]] * len(ok)
                found["score"] += s[r][ok].tolist()
                found["id"] += other[seen[ok]].tolist()
        return pa.table({k: pa.array(v, pa.int64()) for k, v in found.items()})

    best = _met(anchors.select("anchor", "vec_id", "label", "leaf", "embedding", "least"), dealt, keep, mine["n"], theirs["n"], positive, "anchor bigint, score bigint, id bigint")
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    best = best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    best = best.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("place", "score", "id"))).alias("p"))

    # negatives: a row an anchor, windows that the sample has narrowed
    def narrowed(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                s, label = scores(matrix(part.column(2), width), x), part.column(1).to_numpy()
                lows, highs = [], []
                for r, p in enumerate(part.column(5).to_pylist()):
                    least, most = windows([q["score"] for q in p])
                    rest = np.sort(s[r][labels != label[r]])
                    first, past = np.searchsorted(rest, least), np.searchsorted(rest, most, "right")
                    lows.append([int(rest[e - negatives]) if e - f >= negatives else int(lo_) for f, e, lo_ in zip(first, past, least, strict=True)])
                    highs.append(most.tolist())
                low = [min([w for w, h in zip(x_, y_, strict=True) if w <= h], default=None) for x_, y_ in zip(lows, highs, strict=True)]
                high = [max([h for w, h in zip(x_, y_, strict=True) if w <= h], default=None) for x_, y_ in zip(lows, highs, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lows, pa.list_(pa.int64())), pa.array(highs, pa.list_(pa.int64())), pa.array(low, pa.int64()), pa.array(high, pa.int64())],
                                                 names=["vec_id", "label", "embedding", "leaf", "anchor", "p", "lows", "highs", "low", "high", ])

    chosen = anchors.select("vec_id", "label", "embedding", "leaf", "anchor").join(best, "anchor").select("vec_id", "label", "embedding", "leaf", "anchor", "p")
    kind = f"vec_id bigint, label bigint, embedding array<{element}>, leaf int, anchor bigint, p array<struct<place:int,score:bigint,id:bigint>>, lows array<bigint>, highs array<bigint>, low bigint, high bigint"
    armed = written(chosen.mapInArrow(narrowed, kind).where("low IS NOT NULL"), "armed")
    shape = armed.withColumn("far", F.lit(0.0)).withColumn("bit", F.lit(0).cast("bigint"))
    use = _leaf_table(shape, tree.leaves, F.min("low").alias("low"), F.max("high").alias("high"))
    radius = np.where(use["n"] > 0, mine["far"], -1.0)
    meets = walked(tree, radius, theirs["far"], use["get"]("low", _HIGH, np.int64).astype(float), use["get"]("high", _LOW, np.int64).astype(float))

    def negative(key, left, right):
        found = {"anchor": [], "place": [], "score": [], "id": []}
        numbers, label, lows, highs = left.column("anchor").to_numpy(), left.column("label").to_numpy(), left.column("lows").to_pylist(), left.column("highs").to_pylist()
        other, others = _ids(right.column("vec_id")), right.column("label").to_numpy()
        for some, seen, s in _by_leaf(left, right, meets, width):
            for r, i in enumerate(some):
                ok = np.nonzero((others[seen] != label[i]) & (s[r] >= min(lows[i])) & (s[r] <= max(highs[i])))[0]
                score, number = s[r][ok], other[seen[ok]]
                for place, (low, high) in enumerate(zip(lows[i], highs[i], strict=True), 1):
                    inside = np.nonzero((score >= low) & (score <= high))[0]
                    inside = inside[top(score[inside], number[inside], negatives)]
                    found["anchor"] += [numbers[i]] * len(inside)
                    found["place"] += [place] * len(inside)
                    found["score"] += score[inside].tolist()
                    found["id"] += number[inside].tolist()
        return pa.table({k: pa.array(v, pa.int64()) for k, v in found.items()})

    hard = _met(armed.select("anchor", "vec_id", "label", "leaf", "embedding", "lows", "highs"), dealt, meets, use["n"], theirs["n"], negative, "anchor bigint, place bigint, score bigint, id bigint")
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "id")
    hard = hard.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    named = armed.select("anchor", F.col("vec_id").alias("anchor_id"), F.explode("p").alias("q")).select("anchor", "anchor_id", F.col("q.place").cast("bigint").alias("place"), F.col("q.id").alias("positive"), F.col("q.score").alias("positive_score"))
    some = hard.join(named, ["anchor", "place"])
    known = lambda c: F.when(F.col(c) != F.lit(_NONE), F.col(c))
    return some.select("anchor_id", known("positive").alias("positive_id"), "rank", known("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
