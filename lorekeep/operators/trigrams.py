"""Substring search by an index of trigrams, so that a rare word doesn't read all texts.

Texts are written in blocks, folders dealt by a hash of their key. Tasks take the texts of a block in groups of about ``CHARS``
characters and give one posting a group and trigram, with the places of the texts in the group that have it; postings lie in
folders dealt by trigram and sorted by it. A search takes the rarest trigrams of what it looks for, finds the texts that have all
of them, reads these texts' blocks only and tests their texts literally, so that results are those of a scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import affect as A
from ..workspace import new_path

#: Folders of texts and of postings; tasks that write one folder of postings, so that a frequent trigram is dealt over these;
#: trigrams of one part that are intersected.
BLOCKS, BUCKETS, SPREAD, RAREST = 256, 32, 4, 6
#: Characters of a group of texts, and its texts at most: places are 16 bits.
CHARS, GROUP = 1 << 20, 1 << 16
POSTINGS, COUNTS = "block int, part bigint, gram bigint, texts binary, bucket int", "gram bigint, n bigint, bucket int"


def grams(text: str) -> list[int]:
    """The distinct trigrams of a text, three code points as one number; shorter texts have none."""
    return sorted({ord(a) << 42 | ord(b) << 21 | ord(c) for a, b, c in zip(text, text[1:], text[2:], strict=False)})


def _bucket(gram: np.ndarray, buckets: int) -> np.ndarray:
    return ((gram.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % buckets


def postings(texts: list[str]) -> list[tuple[np.ndarray, list[bytes]]]:
    """Trigrams of a group of texts, each with the places in ``texts`` of those that have it: 16-bit steps from place to place."""
    points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    every = np.concatenate(points) if points else np.zeros(0, np.uint32)
    if len(every) < 3:
        return []
    # the signs are numbered densely, so that a trigram and the place of its text are one number to sort
    signs = np.flatnonzero(np.bincount(every)) if len(every) > 10_000 else np.unique(every)
    d, n = len(signs), len(texts)
    if d**3 * n >= 2**63:  # not for a single text: there are under 2^21 signs
        half = n // 2
        return postings(texts[:half]) + [(g, [_steps(_places(x) + half) for x in at]) for g, at in postings(texts[half:])]
    number = np.zeros(int(signs[-1]) + 1, np.int64)
    number[signs] = np.arange(d)
    code, place = number[every], np.repeat(np.arange(n), [len(p) for p in points])
    keys = ((code[:-2] * d + code[1:-1]) * d + code[2:]) * n + place[:-2]
    keys = np.sort(keys[place[:-2] == place[2:]])
    keys = keys[np.diff(keys, prepend=-1) != 0]
    if not len(keys):
        return []
    gram, place = np.divmod(keys, n)
    first = np.flatnonzero(np.diff(gram, prepend=-1))
    steps = np.diff(place, prepend=0)
    steps[first] = place[first]
    own, raw, ends = gram[first], steps.astype("<u2").tobytes(), [*(2 * first[1:]).tolist(), 2 * len(keys)]
    named = signs[own // (d * d)].astype(np.int64) << 42 | signs[own // d % d].astype(np.int64) << 21 | signs[own % d].astype(np.int64)
    return [(named, [raw[a:b] for a, b in zip((2 * first).tolist(), ends, strict=True)])]


def _places(steps: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(steps, "<u2").astype(np.int64))


def _steps(places: np.ndarray) -> bytes:
    return np.diff(places, prepend=0).astype("<u2").tobytes()


def _groups(batches) -> Iterator[tuple[int, int, list[str]]]:
    """(block, number of the group, its texts). A text of over ``CHARS`` characters is a group of its own, which comes in pieces."""
    number, block, held, chars = 0, None, [], 0
    for b in batches:
        for own, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            t = text.as_py() or ""
            if held and (own != block or chars + len(t) > CHARS or len(held) == GROUP):
                yield block, number, held
                number, held, chars = number + 1, [], 0
            block = own
            if len(t) > CHARS:
                for lo in range(0, len(t) - 2, CHARS):
                    yield block, number, [t[lo : lo + CHARS + 2]]
                number += 1
            else:
                held.append(t)
                chars += len(t)
    if held:
        yield block, number, held


@dataclass(frozen=True)
class TrigramIndex:
    """Where an index lies, the column that was indexed, and the columns of its texts. It outlives the session where ``build`` was
    given a path."""

    path: str
    text: str
    buckets: int
    schema: StructType

    def texts(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(f"{self.path}/texts")

    def blocks(self, spark: SparkSession, part: str) -> list[int] | None:
        """Blocks of the rows that have the rarest trigrams of ``part``, BLOCKS numbers at most; None where it has no trigram."""
        looked = grams(part.lower())
        if not looked:
            return None
        folders = lambda gs: sorted(set(_bucket(np.array(gs, np.int64), self.buckets).tolist()))
        counts = spark.read.schema(COUNTS).parquet(f"{self.path}/counts").where(F.col("bucket").isin(folders(looked)) & F.col("gram").isin(looked))
        seen = {r.gram: r.n for r in counts.groupBy("gram").agg(F.sum("n").alias("n")).collect()}
        if len(seen) < len(looked):
            return []
        rare = sorted(looked, key=lambda g: (seen[g], g))[:RAREST]
        rows = spark.read.schema(POSTINGS).parquet(f"{self.path}/postings").where(F.col("bucket").isin(folders(rare)) & F.col("gram").isin(rare))

        def held(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            of: dict[int, np.ndarray] = {}
            for g, x in zip(table.column("gram").to_pylist(), table.column("texts").to_pylist(), strict=True):
                of[g] = np.union1d(of[g], _places(x)) if g in of else _places(x)
            some = len(of) == len(rare) and len(reduce(np.intersect1d, of.values()))
            return pa.table({"block": pa.array([key[0].as_py()] if some else [], pa.int32())})

        both = rows.select("block", "part", "gram", "texts").groupBy("block", "part").applyInArrow(held, "block int")
        return sorted(r.block for r in both.distinct().collect())

    def holding(self, spark: SparkSession, *parts: str) -> DataFrame:
        """Rows whose text holds any of ``parts``, without regard to case, with all columns that were indexed.

        Parts of one or two characters have no trigram: they read all texts. Null texts hold nothing, the empty part is in
        all others; no part gives no row.
        """
        found = [self.blocks(spark, p) for p in parts]
        texts = self.texts(spark)
        if all(b is not None for b in found):
            texts = texts.where(F.col("_block").isin(sorted({x for b in found for x in b})))
        hit = reduce(lambda a, b: a | b, (A.holds(self.text, p) for p in parts), F.lit(False))
        return texts.where(hit).drop("_block")


def build(rows: DataFrame, key: str, text: str, path: str | None = None, blocks: int = BLOCKS, buckets: int = BUCKETS) -> TrigramIndex:
    """Index of ``rows``; ``key`` deals them into blocks (rows with equal or null keys go together). Takes any other columns but
    ``_block``. Without a path it is written to the shared folder and goes when the driver ends."""
    if "_block" in rows.columns:
        raise ValueError("rows have a column _block")
    spark = rows.sparkSession
    path = path or new_path(spark, "trigrams")
    dealt = rows.withColumn("_block", F.pmod(F.xxhash64(F.col(key)), F.lit(blocks)).cast("int"))
    dealt.repartition("_block").write.partitionBy("_block").parquet(f"{path}/texts")
    texts = spark.read.schema(dealt.schema).parquet(f"{path}/texts")

    def posted(batches):
        task = TaskContext.get().partitionId() << 32
        for block, number, group in _groups(batches):
            for gram, at in postings(group):
                n = len(gram)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block, np.int32)), pa.array(np.full(n, task + number, np.int64)), pa.array(gram), pa.array(at, pa.binary()), pa.array(_bucket(gram, buckets).astype(np.int32))], names=["block", "part", "gram", "texts", "bucket"])

    made = texts.select("_block", F.lower(F.col(text)).alias("text")).where("text IS NOT NULL").mapInArrow(posted, POSTINGS)
    made = made.repartition(buckets * SPREAD, "bucket", F.pmod(F.xxhash64("part"), F.lit(SPREAD))).sortWithinPartitions("bucket", "gram", "block", "part")
    made.write.partitionBy("bucket").parquet(f"{path}/postings")
    counts = spark.read.schema(POSTINGS).parquet(f"{path}/postings").groupBy("bucket", "gram").agg(F.sum(F.length("texts") / 2).cast("bigint").alias("n"))
    counts.repartition("bucket").sortWithinPartitions("gram").write.partitionBy("bucket").parquet(f"{path}/counts")
    return TrigramIndex(path, text, buckets, dealt.schema)
