"""Packing tokenised documents into sequences: large items are matched in pairs, small ones fill the gaps by best fit.

Lengths are whole numbers up to the capacity, so the packing is planned on the histogram of lengths, which has at most
``capacity`` entries whatever the corpus: the plan says which ranks of each length go where. Documents over a third of the
capacity are matched greedily, each with the largest that still fits, at most two to a bin; the others go, longest first,
each into the smallest gap that holds it. Pieces then find their place by their rank among those of the same length, by a join
with the plan, whose size is bounded by the capacity as well. Nothing else meets in one place.
"""

from __future__ import annotations

import bisect
import itertools
import json
import unicodedata
import zlib
from array import array
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

CAPACITY, END = 4096, 1
#: Pieces of one length that are ranked together, about, and words that a worker remembers at most.
_CELL, _WORDS = 2_000, 900_000
_PLAIN = 0x130  # below it, the case of a character doesn't depend on its neighbours
_workers: dict = {}


class _Words(dict):
    """Ids of words as bytes. A word that isn't known yet is cut by the file's own pattern, and each new piece goes to the library's model.

    Words have no white space, are lowered and end before ``_PLAIN``, where the pattern's classes are spelt out.
    """

    def __init__(self, whole):
        import re

        near, pieces = [chr(c) for c in range(_PLAIN)], whole.pre_tokenizer.pre_tokenize_str
        pattern = json.loads(whole.to_str())["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        for name in "LN":
            pattern = pattern.replace(f"\\p{{{name}}}", "".join(c for c in near if unicodedata.category(c)[0] == name))
        self.cut, self.model = re.compile(pattern).findall, whole.model
        self.as_bytes = {ord(c): "".join(p for p, _ in pieces(c)) for c in near}  # what stands for a character's bytes

    def __missing__(self, word: str) -> bytes:
        parts = self.cut(word)
        if len(parts) > 1:
            ids = b"".join([self[p] for p in parts])
        else:
            ids = array("I", [t.id for p in parts for t in self.model.tokenize(p.translate(self.as_bytes))]).tobytes()
        if len(self) >= _WORDS:  # the words met first are mostly the common ones
            first = dict(itertools.islice(self.items(), _WORDS // 2))
            self.clear()
            self.update(first)
        self[word] = ids
        return ids


class WordTokenizer:
    """Ids of a ``tokenizers`` file that lowers, drops white space and merges within words, with a memory of words.

    What stands between white space is encoded on its own, so each new such word of a text goes to the library once and is
    then known by its ids. Texts with a character past the first code blocks, not in normal form or naming a special token
    go to the library whole.
    """

    def __init__(self, path: str):
        import re

        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.far = re.compile(f"[^\\x00-{chr(_PLAIN - 1)}]").search
        self.known = _Words(self.whole)

    def other(self, text: str) -> bool:
        """Whether the words of a text can't be encoded one by one."""
        if any(c in text for c in ("<|", "\x1c", "\x1d", "\x1e", "\x1f")):
            return True
        return not text.isascii() and (self.far(text) is not None or not unicodedata.is_normalized("NFC", text))

    def ids(self, text: str) -> np.ndarray:
        if self.other(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4")
        return np.frombuffer(b"".join(map(self.known.__getitem__, text.lower().split())), "<u4")


def tokenizer(path: str) -> WordTokenizer:
    if path not in _workers:
        _workers[path] = WordTokenizer(path)
    return _workers[path]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each text's ids and ``END``, cut into pieces of ``capacity`` ids."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tok = tokenizer(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                row, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    a = np.append(tok.ids(text or ""), np.array([END], "<u4"))
                    for n, s in enumerate(range(0, len(a), capacity)):
                        p = a[s : s + capacity]
                        row.append(i)
                        piece.append(n)
                        start.append(s)
                        length.append(len(p))
                        crc.append(zlib.crc32(p.tobytes()))
                        if with_ids:
                            ids.append(p.astype(np.int32))
                cols = [part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, names=["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """How ``counts[length]`` items go into bins: rows (length, first rank, past rank, first bin, items a bin, offset).

    Items of a row fill its bins in turn, ``items a bin`` side by side from ``offset``. Bins that hold the same are one group
    throughout, so the work depends on the number of lengths only.
    """
    out, used, left = [], defaultdict(int), {n: c for n, c in counts.items() if c > 0}
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> groups of bins (first, number)
    open_, bins = [], 0  # gaps in order; number of bins

    def put(length: int, n: int, first: int, each: int, offset: int) -> None:
        out.append((length, used[length], used[length] + n, first, each, offset))
        used[length] += n

    def add_gap(gap: int, first: int, number: int) -> None:
        if gap > 0 and number > 0:
            if not gaps[gap]:
                bisect.insort(open_, gap)
            gaps[gap].append((first, number))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        big = large[-1]
        at = bisect.bisect_right(large, capacity - big) - 1
        mate = large[at] if at >= 0 else None
        if mate is None:
            n = left[big]
            put(big, n, bins, 1, 0)
            add_gap(capacity - big, bins, n)
        elif mate == big:
            n = left[big] // 2
            put(big, 2 * n, bins, 2, 0) if n else None
            if left[big] % 2:  # the odd one takes the next smaller
                left[big], n_before, bins = 1, n, bins + n
                add_gap(capacity - 2 * big, bins - n, n_before)
                smaller = large[at - 1] if at > 0 else None
                put(big, 1, bins, 1, 0)
                if smaller is None:
                    add_gap(capacity - big, bins, 1)
                else:
                    put(smaller, 1, bins, 1, big)
                    add_gap(capacity - big - smaller, bins, 1)
                    left[smaller] -= 1
                    if not left[smaller]:
                        large.remove(smaller)
                n = 1
            else:
                add_gap(capacity - 2 * big, bins, n)
            left[big] = 0
        else:
            n = min(left[big], left[mate])
            put(big, n, bins, 1, 0)
            put(mate, n, bins, 1, big)
            add_gap(capacity - big - mate, bins, n)
            left[mate] -= n
            if not left[mate]:
                large.remove(mate)
            left[big] -= n
            if left[big]:
                bins += n
                continue
        bins += n
        large.pop()

    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        rest = left[length]
        while rest:
            at = bisect.bisect_left(open_, length)
            if at == len(open_):  # no gap holds it: new bins
                gap, first, number = capacity, bins, -(-rest // (capacity // length))
                bins += number
            else:
                gap = open_[at]
                first, number = gaps[gap].pop()
                if not gaps[gap]:
                    open_.pop(at)
            each = gap // length
            whole, part = min(number, rest // each), 0
            put(length, whole * each, first, each, capacity - gap) if whole else None
            add_gap(gap - each * length, first, whole)
            rest -= whole * each
            if rest and whole < number:  # the last bin of this length isn't filled up
                put(length, rest, first + whole, rest, capacity - gap)
                add_gap(gap - rest * length, first + whole, 1)
                rest, part = 0, 1
            add_gap(gap, first + whole + part, number - whole - part)
    return out


def packed(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``items`` (doc_id, piece, length, ...) with sequence_id and offset; offsets of a sequence follow without gaps."""
    spark = items.sparkSession
    counts = {r[0]: r[1] for r in items.groupBy("length").agg(F.count(F.lit(1))).collect()}  # ``capacity`` rows at most
    cells = spark.createDataFrame([(n, -(-c // _CELL)) for n, c in counts.items()] or [(0, 1)], "length bigint, _cells bigint")
    rows = items.join(F.broadcast(cells), "length").withColumn("_cell", F.pmod(F.xxhash64("doc_id", "piece", "start", F.lit(5)), F.col("_cells")).cast("int")).drop("_cells")
    sizes = rows.groupBy("length", "_cell").agg(F.count(F.lit(1)).alias("n"))
    todo = spark.createDataFrame(plan(counts, capacity) or [(0, 0, 0, 0, 1, 0)], "length bigint, r0 bigint, r1 bigint, bin bigint, each bigint, at bigint")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a cell
    sizes = written(sizes.select("length", "_cell", before.alias("_before")), "cells")
    nth = F.row_number().over(Window.partitionBy("length", "_cell").orderBy("doc_id", "piece", "ids_crc32")) - 1
    placed = (
        rows.withColumn("_nth", nth).join(sizes, ["length", "_cell"]).withColumn("_rank", F.col("_before") + F.col("_nth"))
        .join(F.broadcast(todo), "length").where("_rank >= r0 AND _rank < r1")  # the plan's size is bounded by the capacity
    )
    return placed.withColumn("sequence_id", F.expr("bin + (_rank - r0) div each")).withColumn("offset", F.expr("at + ((_rank - r0) % each) * length")).select(*items.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece of each document of ``docs`` (doc_id, text), with its sequence and place.

    Null and empty texts are the end token alone; only documents of more than ``capacity`` ids are cut; repeated rows and rows
    with null ids are packed like any others; an empty table gives no rows.
    """
    return packed(written(pieces(docs, path, capacity, with_ids), "pieces"), capacity)
