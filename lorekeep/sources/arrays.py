"""JSON arrays in files of any size, read by as many tasks as their bytes ask for.

A file that is one array can't be cut where lines end. Spark's text source cuts it at closing braces instead; whether such a brace
stands in a string, and how deep, depends on all that comes before. So the file is read twice. First every block says how many
quotes and brackets it has, should it begin outside or inside of a string; sums over the blocks before give each its true
beginning. Then every block cuts its elements out. The few that lie across blocks are put together from their pieces.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_SIGNS = re.compile(r'\\.|["{}\[\]]', re.DOTALL)
_STEP = {"{": 1, "[": 1, "}": -1, "]": -1}


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value): the text up to each closing brace; a block's rows come in order, within one task."""
    rows = spark.read.option("lineSep", "}").text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _by_block(batches):
    """(file, block, values) of the runs of rows of one block in a batch; a block may go on in the next."""
    for b in batches:
        file, block, value = (c.to_pylist() for c in b.columns[:3])
        lo = 0
        for i in range(1, len(file) + 1):
            if i == len(file) or (file[i], block[i]) != (file[lo], block[lo]):
                yield file[lo], block[lo], value[lo:i], b.slice(lo, 1)
                lo = i


def summed(text: str) -> tuple[int, int, int]:
    """Quotes of a text, and by how much its brackets outside of strings go up, if it begins outside, and if inside, of a string."""
    quotes, up = 0, [0, 0]
    for m in _SIGNS.finditer(text):
        s = m[0]
        if s == '"':
            quotes += 1
        elif s in _STEP:
            up[quotes % 2] += _STEP[s]
    return quotes, up[0], up[1]


class Cutter:
    """Takes a block's text, from a known beginning, apart into what ends the element before it, whole elements, and what is left."""

    def __init__(self, inside: bool, depth: int):
        self.inside, self.depth, self.open = inside, depth, depth >= 2
        self.head: list[str] | None = [] if self.open else None
        self.parts: list[str] = []

    def feed(self, text: str):
        """Whole elements that end in ``text``."""
        begin = 0
        for m in _SIGNS.finditer(text):
            s = m[0]
            if s == '"':
                self.inside = not self.inside
            elif not self.inside and s in _STEP:
                if s in "{[":
                    if self.depth == 1 and not self.open:
                        self.open, begin = True, m.start()
                    self.depth += 1
                else:
                    self.depth -= 1
                    if self.depth == 1 and self.open:
                        self.open = False
                        piece = text[begin : m.end()]
                        if self.head is not None:
                            self.head.append(piece)
                            yield "head", "".join(self.head)
                            self.head = None
                        else:
                            yield "whole", "".join(self.parts) + piece
                        self.parts = []
        if self.open:
            (self.parts if self.head is None else self.head).append(text[begin:])

    def rest(self) -> tuple[str, str] | None:
        """The beginning of an element that ends in a later block, or all of a block that lies within one."""
        if self.head is not None:
            return "through", "".join(self.head)
        return ("tail", "".join(self.parts)) if self.open else None


def elements(spark: SparkSession, path: str) -> DataFrame:
    """(file, value): the objects (or arrays) that are elements of the JSON array in each file, as text; numbers, strings and nulls among
    them are passed over. An empty array, or an empty file, has none; a file that holds one object has none either."""
    parts = _fragments(spark, path)

    def sums(batches):
        for file, block, values, _ in _by_block(batches):
            q, up0, up1 = summed("}".join([*values, ""]))
            yield pa.RecordBatch.from_pydict({"file": [file], "block": [block], "quotes": [q], "outside": [up0], "within": [up1]})

    def joined_sums(batches):
        """A block's runs in order: what a later run begins in is what the earlier ones leave."""
        now, total = None, None
        for b in sums(batches):
            file, block, q, up0, up1 = (c[0].as_py() for c in b.columns)
            if (file, block) == now:
                odd = total[0] % 2
                total = [total[0] + q, total[1] + (up1 if odd else up0), total[2] + (up0 if odd else up1)]
            else:
                if now is not None:
                    yield _row(now, total)
                now, total = (file, block), [q, up0, up1]
        if now is not None:
            yield _row(now, total)

    def _row(key, total):
        return pa.RecordBatch.from_pydict({"file": [key[0]], "block": [key[1]], "quotes": [total[0]], "outside": [total[1]], "within": [total[2]]})

    blocks = parts.mapInArrow(joined_sums, "file string, block bigint, quotes bigint, outside bigint, within bigint")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    blocks = blocks.withColumn("inside", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1)
    blocks = blocks.withColumn("up", F.when(F.col("inside"), F.col("within")).otherwise(F.col("outside")))
    blocks = blocks.select("file", "block", "inside", F.coalesce(F.sum("up").over(before), F.lit(0)).alias("depth"))
    states = {(r.file, r.block): (r.inside, r.depth) for r in blocks.collect()}  # two numbers a block of maxPartitionBytes

    def cut(batches):
        now, cutter = None, None
        for file, block, values, _ in _by_block(batches):
            out = {"file": [], "block": [], "kind": [], "value": []}

            def put(kind, value, at):
                for c, v in zip(out, (at[0], at[1], kind, value), strict=True):
                    out[c].append(v)

            if (file, block) != now:
                if cutter is not None and (left := cutter.rest()):
                    put(*left, now)
                now, cutter = (file, block), Cutter(*states[file, block])
            for v in values:
                for kind, text in cutter.feed(v + "}"):
                    put(kind, text, now)
            yield pa.RecordBatch.from_pydict(out, schema=_CUT)
        if cutter is not None and (left := cutter.rest()):
            yield pa.RecordBatch.from_pydict({"file": [now[0]], "block": [now[1]], "kind": [left[0]], "value": [left[1]]}, schema=_CUT)

    found = parts.mapInArrow(cut, "file string, block bigint, kind string, value string")
    whole = found.where("kind = 'whole'").select("file", "value")
    # an element across blocks: its beginning, what lies through, its end; a block's end part comes before its beginning part
    pieces = found.where("kind <> 'whole'")
    begun = F.sum(F.when(F.col("kind") == "tail", 1).otherwise(0)).over(Window.partitionBy("file").orderBy("block", F.when(F.col("kind") == "tail", 1).otherwise(0)))  # two rows a block
    across = pieces.withColumn("number", begun).groupBy("file", "number").agg(F.sort_array(F.collect_list(F.struct("block", "value"))).alias("p"))
    return whole.union(across.select("file", F.array_join(F.transform("p", lambda x: x["value"]), "").alias("value")))


_CUT = pa.schema([("file", pa.string()), ("block", pa.int64()), ("kind", pa.string()), ("value", pa.string())])


def write_array(rows: DataFrame, path: str) -> None:
    """``rows`` as JSON arrays, one a file, as exports come."""

    def run(batches):
        yield pa.RecordBatch.from_pydict({"value": ["["]})
        first = True
        for b in batches:
            lines = b.column(0).to_pylist()
            if lines:
                yield pa.RecordBatch.from_pydict({"value": [("" if first else ",") + ",".join(lines)]})
                first = False
        yield pa.RecordBatch.from_pydict({"value": ["]"]})

    rows.select(F.to_json(F.struct("*")).alias("value")).mapInArrow(run, "value string").write.mode("overwrite").option("lineSep", " ").text(path)
