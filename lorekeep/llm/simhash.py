"""SimHash near-duplicate groups by a self-join of the binary trie of fingerprints.

Fingerprints are the sign bits of summed shingle hashes. Distinct fingerprints form a binary trie whose nodes are split
until none holds more than ``LEAF`` of them. Pairs of nodes are traversed together from the root, a few bits a round; each
pair carries the number of bits in which its two paths differ and is dropped once that exceeds the budget. Pairs of
leaves are then traversed bit by bit in numpy in the same way, many pairs at a time. A pair of leaves gives the links
that span its components, not all of its links, so a dense group costs no quadratic output while no connection is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import joined_to_classes, written
from .components import components

#: Most fingerprints in a leaf, bits per round of the traversal, and product of leaf sizes handled at a time in numpy.
LEAF, STEP, CELLS = 1024, 4, 2_000_000
_SHIFTS = np.arange(63, -1, -1, dtype=np.uint64)


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """Hashes of the shingles in order, repeats included; see ``fingerprints`` for the rules."""
    words = (text or "").encode("utf-8").lower().split()  # bytes: lowers A-Z and splits at \x20 \x09-\x0D only
    if not words:
        return np.array([], np.uint64)
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        hashes = [h(joined, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        hashes = [h(joined[s:e], 42) for s, e in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)]
    return np.array(hashes, dtype=np.uint64)


def majority(a: np.ndarray) -> int:
    """The number whose bits are set in over half of ``a``; 0 for none."""
    over = np.zeros(64, np.int64)
    for lo in range(0, len(a), 65536):
        over += np.unpackbits(a[lo : lo + 65536].byteswap().view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(over * 2 > len(a)).view(">u8")[0])


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash over shingles of ``width`` words."""
    return majority(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, own, fp), own being a hash of doc_id and text: words are ``[^\\x20\\x09-\\x0D]+`` of the whole text with A-Z lowered, shingles of ``width`` words count
    as often as they occur, fewer words give one shingle, none gives 0. A null text counts as empty. fp is signed."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), width) for t in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fps, pa.int64())], names=["doc_id", "own", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text"), _own().alias("own")).mapInArrow(run, f"doc_id {kind}, own bigint, fp bigint")


def _own() -> Column:
    return F.xxhash64(F.col("text").cast("string"), "doc_id")


def _prefix(fp: str, depth: int):
    """The first ``depth`` bits of a fingerprint, as a number."""
    half = F.shiftrightunsigned(F.col(fp), 32)  # a shift by 64 would be none; a literal would make joins on it products
    return F.shiftrightunsigned(half, 32) if depth == 0 else F.shiftrightunsigned(F.col(fp), 64 - depth)


def trie_nodes(fps: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Leaves (depth, path, fps) and inner nodes (depth, path) of the trie over distinct fingerprints ``fp``."""
    leaves, inner, rest, depth = [], [], fps, 0
    while True:
        placed = rest.select("fp", _prefix("fp", depth).alias("path"))
        sized = placed.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
        level = written(placed.join(sized, "path"), "level")  # each level is read from its table, not worked out again
        leaves.append(level.where(F.col("n") <= LEAF).select(F.lit(depth).alias("depth"), "path", "fp"))
        big = level.where(F.col("n") > LEAF)
        inner.append(big.select(F.lit(depth).alias("depth"), "path").distinct())
        if depth == 64 or big.isEmpty():
            break
        rest = big.select("fp")
        depth += STEP
    both = [leaves[0], inner[0]]
    for a, b in zip(leaves[1:], inner[1:], strict=True):
        both = [both[0].union(a), both[1].union(b)]
    packed = both[0].groupBy("depth", "path").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    return written(packed, "leaves"), written(both[1], "inner"), depth


def leaf_pairs(leaves: DataFrame, inner: DataFrame, deepest: int, budget: int) -> DataFrame:
    """(da, pa, db, pb, diff) of the leaves whose paths differ in at most ``budget`` bits: the joint descent."""
    nodes = written(leaves.select("depth", "path", F.lit(True).alias("leaf")).union(inner.select("depth", "path", F.lit(False))), "nodes")
    root = nodes.where("depth = 0").select("depth", "path", "leaf")
    open_, found = root.select(F.col("depth").alias("da"), F.col("path").alias("pa"), F.col("leaf").alias("la"),
                               F.col("depth").alias("db"), F.col("path").alias("pb"), F.col("leaf").alias("lb"), F.lit(0).alias("diff")), []
    for depth in range(STEP, deepest + STEP, STEP):
        found.append(open_.where("la and lb"))
        going = open_.where("not (la and lb)")
        below = nodes.where(F.col("depth") == depth).select("path", "leaf", F.shiftrightunsigned("path", STEP).alias("up"))

        def down(df, s):
            """Inner nodes at side ``s`` give way to their children; leaves stay."""
            kids = below.select(F.col("up").alias(f"p{s}"), F.col("path").alias("kid"), F.col("leaf").alias("kid_leaf"))
            inner_side = df.where(~F.col(f"l{s}")).join(kids, f"p{s}")
            inner_side = inner_side.withColumn(f"p{s}", F.col("kid")).withColumn(f"l{s}", F.col("kid_leaf")).withColumn(f"d{s}", F.lit(depth))
            return df.where(f"l{s}").unionByName(inner_side.select(*df.columns))

        going = down(down(going, "a"), "b")
        # the differing bits of the two paths, as far down as both are known
        known = F.least("da", "db")
        bits = F.bit_count(F.expr("shiftrightunsigned(pa, da - least(da, db))").bitwiseXOR(F.expr("shiftrightunsigned(pb, db - least(da, db))")))
        going = going.withColumn("diff", bits).where((F.col("diff") <= budget) & (F.expr("shiftrightunsigned(pa, da - least(da, db))") <= F.expr("shiftrightunsigned(pb, db - least(da, db))")) & (known > 0))
        open_ = written(going, "pairs")
    found.append(open_.where("la and lb"))
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out.select("da", "pa", "db", "pb", "diff")


def near_pairs(left: list[np.ndarray], right: list[np.ndarray], same: list[bool], budget: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All (i, x, y) with x of left[i] and y of right[i] at Hamming distance <= budget, x < y where same[i].

    The arrays are sorted unsigned fingerprints, each a trie. All pairs of tries are walked at once from bit 63 down;
    a frontier entry is a pair of nodes (two index ranges) with the bits in which they differ so far.
    """
    a, b = np.concatenate(left), np.concatenate(right)
    la, lb = np.cumsum([0, *map(len, left)]), np.cumsum([0, *map(len, right)])
    same_at = np.array(same, bool)
    pair = np.arange(len(left))
    a0, a1, b0, b1, d = la[:-1], la[1:], lb[:-1], lb[1:], np.zeros(len(left), np.int64)
    keep = (a1 > a0) & (b1 > b0)
    pair, a0, a1, b0, b1, d = (x[keep] for x in (pair, a0, a1, b0, b1, d))
    ones_a = np.empty((len(a) + 1), np.int64)
    ones_b = np.empty((len(b) + 1), np.int64)
    for bit in range(63, -1, -1):
        if not len(pair):
            break
        # within a node the rows with a 0 come before those with a 1, so counting ones gives the split
        ones_a[0] = ones_b[0] = 0
        np.cumsum((a >> np.uint64(bit)) & np.uint64(1), out=ones_a[1:])
        np.cumsum((b >> np.uint64(bit)) & np.uint64(1), out=ones_b[1:])
        ma, mb = a1 - (ones_a[a1] - ones_a[a0]), b1 - (ones_b[b1] - ones_b[b0])
        parts = []
        for x in (0, 1):
            for y in (0, 1):
                s0, s1 = (a0, ma) if x == 0 else (ma, a1)
                t0, t1 = (b0, mb) if y == 0 else (mb, b1)
                ok = (s1 > s0) & (t1 > t0)
                if x != y:
                    ok &= d < budget
                if x > y:
                    ok &= ~(same_at[pair] & (a0 - la[pair] == b0 - lb[pair]))  # a node against itself: one of the two mixed pairs will do
                parts.append([v[ok] for v in (pair, s0, s1, t0, t1)] + [d[ok] + (x != y)])
        pair, a0, a1, b0, b1, d = (np.concatenate(v) for v in zip(*parts, strict=True))
    x, y = a[a0], b[b0]  # at the bottom every range is one fingerprint
    ok = ~same_at[pair] | (x < y)
    return pair[ok], x[ok], y[ok]


def _forest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components of the given ones: each node and the root of its component."""
    nodes, flat = np.unique(np.concatenate([x, y]), return_inverse=True)
    i, j = flat[: len(x)], flat[len(x) :]
    root = np.arange(len(nodes))
    while True:
        ri, rj = root[i], root[j]
        low = np.minimum(ri, rj)
        new = root.copy()
        np.minimum.at(new, ri, low)
        np.minimum.at(new, rj, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    off = np.nonzero(root != np.arange(len(nodes)))[0]
    return nodes[off], nodes[root[off]]


def links(fps: DataFrame, budget: int = 2) -> DataFrame:
    """(a, b): links that span the groups of distinct fingerprints ``fp`` joined at <= ``budget`` differing bits."""
    fps = written(fps.select("fp").distinct(), "fps")
    leaves, inner, deepest = trie_nodes(fps)
    pairs = leaf_pairs(leaves, inner, deepest, budget)
    side = lambda s: leaves.select(F.col("depth").alias(f"d{s}"), F.col("path").alias(f"p{s}"), F.col("fps").alias(f"f{s}"))
    rows = pairs.join(side("a"), ["da", "pa"]).join(side("b"), ["db", "pb"]).select(
        ((F.col("da") == F.col("db")) & (F.col("pa") == F.col("pb"))).alias("same"), "fa", "fb")

    def walk(left, right, same):
        _, x, y = near_pairs(left, right, same, budget)
        x, y = _forest(x, y)
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["a", "b"])

    def run(batches):
        left, right, same, cells = [], [], [], 0
        for b in batches:
            for s, fa, fb in zip(b.column(0), b.column(1), b.column(2), strict=True):
                left.append(np.sort(fa.values.to_numpy().view(np.uint64)))
                right.append(np.sort(fb.values.to_numpy().view(np.uint64)))
                same.append(s.as_py())
                cells += len(left[-1]) * len(right[-1])
                if cells >= CELLS:
                    yield walk(left, right, same)
                    left, right, same, cells = [], [], [], 0
        if left:
            yield walk(left, right, same)

    return rows.mapInArrow(run, "a bigint, b bigint")


def representatives(docs: DataFrame, budget: int = 2, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` with the smallest doc_id of their group, one a group, in the columns that ``docs`` has.

    Groups are those of ``resemblance.near_duplicates``: pairs that the trie join finds within ``budget`` bits are held to ``similarity``
    with repeats, all others to that of their sets. Of rows that repeat a doc_id in a group one stays, by hash; of a group without any id
    one of each set of shingles. Null texts count as empty and are alike; an empty table gives no rows.
    """
    from .resemblance import near_duplicates as similar

    rows = similar(docs, similarity, width, budget).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    stay = rows.groupBy(F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("set "), "node"))).agg(F.min("own").alias("own")).select("own")
    return kept_rows(docs, stay)


def kept_rows(docs: DataFrame, stay: DataFrame) -> DataFrame:
    """One row of ``docs`` for each ``own`` of ``stay``. Rows travel as structs, so that no column's name can clash."""
    whole = docs.select(F.struct("*").alias("row"), _own().alias("own"))
    met = whole.join(stay, "own", "left_semi")
    order = F.row_number().over(Window.partitionBy("own").orderBy(F.xxhash64(F.to_json("row"))))  # rows equal in doc_id and text
    return met.withColumn("nth", order).where("nth = 1").select("row.*")


def near_duplicates(docs: DataFrame, budget: int = 2, width: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id, own) for every row of ``docs`` (doc_id, text).

    Fingerprints link at ``budget`` or fewer differing bits; component_id is the smallest doc_id reachable, the row's own
    included. Null and empty texts have fingerprint zero and link like any other. Rows with a null doc_id take part; their
    group's id is the smallest that is not null, if there is one. Repeated rows each come out. An empty table gives none.
    """
    rows = written(fingerprints(docs, width), "fingerprints")
    by_fp = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "classes")
    comp = written(components(links(by_fp.select("fp"), budget)), "components")
    # linked fingerprints only: the rest are groups of their own
    linked = comp.join(by_fp, comp.node == by_fp.fp).select("component", "fp", "least")
    of_comp = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    named = linked.join(of_comp, "component").select("fp", "component_id")
    every = by_fp.join(named, "fp", "left").select("fp", "n", F.coalesce("component_id", "least").alias("component_id"))
    return joined_to_classes(rows, every, "fp", "n").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "own")
