"""Ranked lexical search: document-at-a-time merging of compressed postings, shard by shard.

Documents are dealt to shards as they are read, each of about ``SHARD`` bytes of text and in order of doc_id, and no text is ever
shuffled. A shard has for every term its postings (gap to the next document's number in the shard, occurrences) as
variable-length integers, and one row with the ids and lengths of its documents. A search reads the postings of its terms only.

In a shard each item merges its terms' postings by a heap of their next documents. The ten best so far stand in a bounded heap keyed by
score, then doc_id; terms whose largest possible contributions together can't reach it are left out of the merge and looked up
only for documents that the others bring (exact: what is skipped can't be among the ten). Shards' results are merged by a window.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Bytes of text of a shard (one longer text is a shard of its own); pairs of item and term of a block of items; terms up to which a
#: search's terms are broadcast, beyond they are joined by shuffle.
SHARD, BLOCK, BROADCAST = 16_000_000, 500_000, 200_000
#: Bytes that belong to no term become a space, A-Z become a-z, all others stay.
_TABLE = bytes(32 if b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """Maximal runs of digits, letters and signs beyond ASCII in a UTF-8 text, with A-Z lower-cased."""
    return text.translate(_TABLE).split() if text else []


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unsigned integers, seven bits a byte with a mark on all but the last; and the number of bytes of each."""
    v = values.astype(np.uint64)
    size = np.ones(len(v), np.int64)
    for k in range(1, 10):
        size += v >= np.uint64(1) << np.uint64(7 * k)
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        has = size > k
        more = (size[has] > k + 1).astype(np.uint8) << 7
        out[at[has] + k] = (v[has] >> np.uint64(7 * k)).astype(np.uint8) & 0x7F | more
    return out, size


def unpacked(data: bytes) -> np.ndarray:
    """What ``packed`` was given."""
    raw = np.frombuffer(data, np.uint8)
    last = raw < 0x80
    number = np.cumsum(last) - last
    starts = np.concatenate([[0], np.nonzero(last)[0] + 1])[:-1]
    shift = 7 * (np.arange(len(raw)) - starts[number])
    return np.add.reduceat((raw & 0x7F).astype(np.int64) << shift, starts) if len(raw) else np.zeros(0, np.int64)


def _blobs(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Packed ``values``, ``counts`` of them to a row."""
    data, size = packed(values)
    ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])]
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


def _shard(name: str, ids: pa.Array, texts: list[bytes | None]) -> pa.RecordBatch:
    """The rows of a shard: one a term, in their order, and one without a term for its documents."""
    order = pc.sort_indices(ids, null_placement="at_end").to_pylist()
    ids = ids.take(pa.array(order))
    lengths, words, tfs, distinct = [], [], [], []
    for i in order:
        found: dict[bytes, int] = {}
        all_words = terms(texts[i])
        for w in all_words:
            found[w] = found.get(w, 0) + 1
        lengths.append(len(all_words))
        words.extend(found)
        tfs.extend(found.values())
        distinct.append(len(found))
    coded = pa.array(words, pa.binary()).dictionary_encode()
    code = coded.indices.to_numpy()
    by_name = pc.sort_indices(coded.dictionary)
    rank = np.empty(len(by_name), np.int64)
    rank[by_name.to_numpy()] = np.arange(len(by_name))
    code = rank[code] if len(code) else code.astype(np.int64)
    doc, tf = np.repeat(np.arange(len(order)), distinct), np.array(tfs, np.int64)
    by_term = np.argsort(code, kind="stable")
    doc, tf, df = doc[by_term], tf[by_term], np.bincount(code, minlength=len(by_name))
    gap = np.diff(doc, prepend=0)
    first = (np.cumsum(df) - df).astype(np.int64)
    gap[first] = doc[first]
    blobs = _blobs(np.stack([gap, tf], 1).ravel(), 2 * df)
    size = np.array(lengths, np.int64)
    own = _blobs(size, np.array([len(size)]))
    n = len(df)
    whole = pa.concat_arrays([pa.nulls(n, pa.list_(ids.type)), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)])
    return pa.RecordBatch.from_arrays(
        [
            pa.array([name] * (n + 1)), pa.concat_arrays([coded.dictionary.take(by_name).cast(pa.string()), pa.nulls(1, pa.string())]),
            pa.concat_arrays([pa.array(df.astype(np.int64)), pa.array([int((size > 0).sum())])]), pa.array([None] * n + [int(size.sum())], pa.int64()),
            pa.concat_arrays([blobs, own]), whole,
        ],
        names=["shard", "term", "n", "total", "postings", "ids"],
    )


def index(docs: DataFrame) -> DataFrame:
    """(shard, term, n, total, postings, ids) over all ``docs`` (doc_id, text), written to the shared folder.

    A row a term and shard: n documents have it. A row without a term a shard: n documents that have any terms, total terms
    with repeats, ids of all its documents in order, null ids last, and in postings their lengths. Null and empty texts have no
    terms; an empty table gives no rows; documents of one id are several documents.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        task, made, ids, texts, size = TaskContext.get().partitionId(), 0, [], [], 0
        for b in batches:
            column, at = b.column(1), 0
            for i in range(b.num_rows):
                text = column[i].as_py()
                size += len(text or b"")
                texts.append(text)
                if size >= SHARD:
                    ids.append(b.column(0).slice(at, i + 1 - at))
                    yield _shard(f"{task}-{made}", pa.concat_arrays(ids), texts)
                    made, ids, texts, size, at = made + 1, [], [], 0, i + 1
            ids.append(b.column(0).slice(at))
        if texts:
            yield _shard(f"{task}-{made}", pa.concat_arrays(ids), texts)

    rows = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text"))
    return written(rows.mapInArrow(run, f"shard string, term string, n bigint, total bigint, postings binary, ids array<{kind}>"), "index")


def item_terms(items: DataFrame) -> DataFrame:
    """(item, item_id, term): the distinct terms of the rows of ``items`` (item_id, text); rows alike are one item."""
    kind = items.schema["item_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                some = sorted(set(terms(b.column(2)[i].as_py())))
                if some:
                    at = pa.array([0] * len(some))
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1).take(at), b.column(1).slice(i, 1).take(at), pa.array(some, pa.binary()).cast(pa.string())], names=["item", "item_id", "term"])

    rows = items.select("item_id", F.col("text").cast("string").alias("text")).distinct()
    rows = rows.select(F.sha2(F.concat_ws("\x01", F.coalesce(F.col("item_id").cast("string"), F.lit("\x02")), "text"), 256).alias("item"), "item_id", F.col("text").cast("binary"))
    return rows.mapInArrow(run, f"item string, item_id {kind}, term string")


def best(lists: list[tuple[int, list[int], list[int]]], k: int) -> list[tuple[int, int]]:
    """The ``k`` best (score, document) of one shard for an item's ``lists`` (largest contribution, documents ascending,
    contributions), scores above 0 only; equal scores go to the smaller document."""
    lists = sorted((x for x in lists if x[0] > 0), key=lambda x: x[0])
    n = len(lists)
    reach = [0]  # what the first lists can add at most
    for x in lists:
        reach.append(reach[-1] + x[0])
    docs, adds, at = [x[1] for x in lists], [x[2] for x in lists], [0] * n
    need = max(1, _first_guess(docs, adds, n, k))
    left = 0  # lists before it are looked up only
    while left < n and reach[left + 1] < need:
        left += 1
    heap = [docs[j][0] * n + j for j in range(left, n)]
    heapq.heapify(heap)
    found: list[tuple[int, int]] = []  # (score, -document), the worst first
    while heap:
        doc, j = divmod(heap[0], n)
        score = 0
        while heap:
            d, j = divmod(heap[0], n)
            if d != doc:
                break
            if j < left:  # has left the merge
                heapq.heappop(heap)
                continue
            p = at[j]
            score += adds[j][p]
            at[j] = p = p + 1
            if p < len(docs[j]):
                heapq.heapreplace(heap, docs[j][p] * n + j)
            else:
                heapq.heappop(heap)
        if not score:
            continue
        for j in range(left - 1, -1, -1):
            if score + reach[j + 1] < need:
                break
            at[j] = p = bisect_left(docs[j], doc, at[j])
            if p < len(docs[j]) and docs[j][p] == doc:
                score += adds[j][p]
        if score < need:
            continue
        if len(found) < k:
            heapq.heappush(found, (score, -doc))
        else:
            heapq.heapreplace(found, (score, -doc))
        if len(found) == k and found[0][0] >= need:
            need = found[0][0] + 1  # documents to come lose ties
            while left < n and reach[left + 1] < need:
                left += 1
    return [(s, -d) for s, d in found]


def _first_guess(docs: list[list[int]], adds: list[list[int]], n: int, k: int) -> int:
    """A score that ``k`` documents reach: of documents of the shortest lists, by all lists."""
    some: set[int] = set()
    for j in sorted(range(n), key=lambda j: len(docs[j])):
        some.update(docs[j][: 4 * k])
        if len(some) >= 4 * k:
            break
    if len(some) < k:
        return 0
    scores = []
    for d in some:
        s = 0
        for j in range(n):
            p = bisect_left(docs[j], d)
            if p < len(docs[j]) and docs[j][p] == d:
                s += adds[j][p]
        scores.append(s)
    return sorted(scores, reverse=True)[k - 1]


def _searched(key, table: pa.Table, k: int, documents: int, total: int) -> pa.Table:
    """The ``k`` best of one shard for every item of a block."""
    own = pc.is_null(table.column("term"))
    head, rest = table.filter(own), table.filter(pc.invert(own))
    length = unpacked(head.column("postings")[0].as_py())
    m = 10 + 90 * length * documents // max(total, 1)
    lists: dict[str, list] = {}
    for postings, weight, wanted in zip(rest.column("postings"), rest.column("weight").to_pylist(), rest.column("items").to_pylist(), strict=True):
        pairs = unpacked(postings.as_py()).reshape(-1, 2)
        doc, tf = np.cumsum(pairs[:, 0]), pairs[:, 1]
        add = weight * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
        entry = (int(add.max()), doc.tolist(), add.tolist())
        for item in wanted:
            lists.setdefault(item, []).append(entry)
    items, scores, docs = [], [], []
    for item, some in lists.items():
        for s, d in best(some, k):
            items.append(item)
            scores.append(s)
            docs.append(d)
    ids = head.column("ids").combine_chunks().flatten()
    return pa.table({"item": pa.array(items, pa.string()), "doc_id": ids.take(pa.array(docs, pa.int64())), "score": pa.array(scores, pa.int64())})


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST else df


def weight(df: str | Column, documents: int) -> Column:
    """floor(1000 ln((2N+2)/(2df+1)))."""
    n = F.col(df) if isinstance(df, str) else df
    return F.floor(1000 * F.log(F.lit(2.0 * documents + 2) / (2 * n + 1))).cast("bigint")


def search(indexed: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of ``items`` (item_id, text) the ``k`` documents of ``indexed`` that score highest,
    above 0, equal scores by ascending doc_id, null last.

    Items without terms, or none of whose terms any document has, get no rows, nor does an empty index give any. Rows of
    ``items`` that agree in both columns are one item; rows of one item_id with different texts are items of their own.
    """
    kind = indexed.schema["ids"].dataType.elementType.simpleString()
    sums = indexed.where("term IS NULL").agg(F.sum("n"), F.sum("total")).first()
    documents, total = sums[0] or 0, sums[1] or 0
    wanted = written(item_terms(items), "items")
    blocks = max(1, -(-wanted.count() // BLOCK))
    names = written(wanted.select("term").distinct(), "terms")
    hits = written(indexed.where("term IS NOT NULL").select("shard", "term", "n", "postings").join(_small(names), "term"), "hits")
    weights = hits.groupBy("term").agg(F.sum("n").alias("df")).select("term", weight("df", documents).alias("weight"))
    # an item is wholly in one block, so a task meets the items of one block and the documents of one shard
    by_term = wanted.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int")).groupBy("block", "term").agg(F.collect_list("item").alias("items"))
    asked = written(by_term.join(weights, "term"), "asked")
    rows = hits.select("shard", "term", "postings").join(_small(asked), "term").select("block", "shard", "term", "postings", F.lit(None).cast(f"array<{kind}>").alias("ids"), "weight", "items")
    met = rows.select("block", "shard").distinct()
    heads = indexed.where("term IS NULL").select("shard", "postings", "ids").join(met, "shard").select("block", "shard", F.lit(None).cast("string").alias("term"), "postings", "ids", F.lit(None).cast("bigint").alias("weight"), F.lit(None).cast("array<string>").alias("items"))

    def run(key, table):
        return _searched(key, table, k, documents, total)

    some = rows.unionByName(heads).groupBy("block", "shard").applyInArrow(run, f"item string, doc_id {kind}, score bigint")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    top = some.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.join(wanted.select("item", "item_id").distinct(), "item").select("item_id", "rank", "doc_id", "score")
