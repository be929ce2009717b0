"""Substring dedup over sliding spans of sentences.

Texts are cut into sentences, and sentences of more than ``WHOLE`` words into pieces after words whose hash is the least within
``REACH`` words on both sides: that depends on these words only, so a passage is cut alike whatever stands around it. What has
more than ``LONGEST`` words to the next mark is text without marks: there each piece counts as a sentence. A span begins at
every piece and is the shortest run of consecutive pieces of two sentences or more that has ``MIN_WORDS`` words. Spans are
hashed and joined across the corpus; every piece covered by a span that isn't the first of its hash (by doc_id, then position)
is removed.

Only hashes and positions are shuffled, once, until it is known what goes; texts meet the removals of their own row once.
Hashes with more than one in ``HOT`` of all spans, of which there are fewer than ``HOT``, meet their first place by a broadcast
and are shuffled span by span, so a passage that a third of all documents share gathers nowhere.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Words of a span at least; words of a sentence that is never cut; words on either side that decide about a cut; words of a
#: sentence at most, and of a piece, after which what has no cut is cut every ``LONG``.
MIN_WORDS, WHOLE, REACH, LONGEST, LONG, HOT, BUCKETS = 20, 16, 4, 40, 20, 20_000, 1 << 17
_WORD = re.compile(r"\S+\s*")


def _ends(words: list[str], pieces: list[str], coded: list[bytes]) -> tuple[list[int], list[int]]:
    """Numbers of words at which a piece has ended: at marks that white space follows, at line ends, and at cuts; and the number
    of the sentence that each piece is of. Pieces of text without marks are numbered singly."""
    n = len(words)
    end = np.fromiter((w[-1] in ".!?" or "\n" in p for w, p in zip(words, pieces, strict=True)), bool, n)
    end[-1] = True
    sentence = np.cumsum(end) - end
    if n > 2 * REACH:
        h = np.fromiter(map(zlib.crc32, coded), np.int64, n)
        near = np.lib.stride_tricks.sliding_window_view(h, 2 * REACH + 1)
        own = near[:, REACH]
        least = (own < near[:, :REACH].min(1)) & (own <= near[:, REACH:].min(1)) & (sentence[: n - 2 * REACH] == sentence[2 * REACH :])
        end[REACH : n - REACH] |= least & (np.bincount(sentence)[sentence[REACH : n - REACH]] > WHOLE)
    out, last = [], 0
    for e in (np.nonzero(end)[0] + 1).tolist():
        while e - last > LONGEST:
            last += LONG
            out.append(last)
        out.append(e)
        last = e
    of = sentence[np.array(out) - 1]
    new = np.bincount(sentence)[of] > LONGEST
    new[1:] |= np.diff(of) > 0
    return out, np.cumsum(new).tolist()


def _cut(text: str) -> tuple[list[str], list[bytes], list[int], list[int]]:
    """Words with the white space after them (the first also with that before it), words in UTF-8, and ``_ends``."""
    words, pieces = text.split(), _WORD.findall(text)
    if not words:
        return pieces, [], [], []
    coded = " ".join(words).encode("utf-8", "surrogatepass").split(b" ")
    pieces[0] = text[: len(text) - sum(map(len, pieces))] + pieces[0]
    return pieces, coded, *_ends(words, pieces, coded)


def _sentences(text: str) -> tuple[list[str], list[int]]:
    """Pieces, and ``_runs`` of them."""
    pieces, _, ends, of = _cut(text)
    if not ends:
        return ([text] if text else []), []
    return ["".join(pieces[a:b]) for a, b in zip([0, *ends], ends, strict=False)], _runs(ends, of)


def sentences(text: str) -> list[str]:
    """The text in pieces, each with the white space after it; together they are the text. White space alone is one piece."""
    return _sentences(text)[0]


def _runs(ends: list[int], of: list[int]) -> list[int]:
    """Past which piece the span that begins at each piece ends, for the first pieces, which have one."""
    starts, n, out, j = [0, *ends[:-1]], len(ends), [], 0
    for i in range(n):
        while j < n and (ends[j] - starts[i] < MIN_WORDS or of[j] == of[i]):
            j += 1
        if j == n:
            break
        out.append(j + 1)
    return out


def spans(text: str) -> list[tuple[int, int, int]]:
    """(first piece, pieces, hash) of every span; white space doesn't count."""
    _, coded, ends, of = _cut(text)
    starts, h = [0, *ends[:-1]], xxhash.xxh64_intdigest
    joined, at = b" ".join(coded), np.cumsum([0, *(len(w) + 1 for w in coded)]).tolist()
    return [(i, j - i, h(joined[at[starts[i]] : at[ends[j - 1]] - 1], 2)) for i, j in enumerate(_runs(ends, of))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def span_hashes(rows: DataFrame) -> DataFrame:
    """(doc_id, own, at, hash) of every span of ``rows`` (doc_id, own, text)."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 250):
                part = b.slice(lo, 250)
                row, at, hashes = [], [], []
                for i, text in enumerate(part.column(2).to_pylist()):
                    for s, _, x in spans(text or ""):
                        row.append(i)
                        at.append(s)
                        hashes.append(_signed(x))
                take = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array(at, pa.int32()), pa.array(hashes, pa.int64())], names=["doc_id", "own", "at", "hash"])

    return rows.select("doc_id", "own", "text").mapInArrow(run, f"doc_id {kind}, own int, at int, hash bigint")


def _place() -> Column:
    return F.shiftleft(F.col("own").cast("bigint"), 32) + F.col("at")


def common_spans(every: DataFrame) -> DataFrame:
    """(hash, first, kept) of the hashes with more than one in ``HOT`` of all spans: the first document and its earliest place. Such a
    hash fills its bucket beyond that number, so only the spans of full buckets are looked at by hash."""
    limit = F.lit(max(every.count() // HOT, 1))
    bucket = F.pmod("hash", F.lit(BUCKETS))
    full = every.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > limit).select("bucket")
    some = every.withColumn("bucket", bucket).join(F.broadcast(full), "bucket", "left_semi")  # fewer than HOT buckets
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", _place().alias("place"))).alias("f")
    out = some.groupBy("hash").agg(first, F.count(F.lit(1)).alias("k")).where(F.col("k") > limit)
    return out.select("hash", F.col("f.doc_id").alias("first"), F.col("f.place").alias("kept"))


def removals(rows: DataFrame) -> DataFrame:
    """(doc_id, own, cut): the spans of each row, by their first piece, that repeat an earlier one, where there are any."""
    every = written(span_hashes(rows), "spans")
    common = written(common_spans(every), "common").withColumnsRenamed({"first": "hot_first", "kept": "hot_kept"})
    rows = every.join(F.broadcast(common), "hash", "left")  # fewer than HOT rows
    hot = F.col("hot_kept").isNotNull()
    # spans of hot hashes know their first place already and are dealt out singly, so that a window holds one span in HOT at most
    same = Window.partitionBy("hash", "spread")
    rows = rows.withColumn("spread", F.when(hot, F.xxhash64("doc_id", "own", "at")).otherwise(F.lit(0)))
    rows = rows.withColumn("first", F.when(hot, F.col("hot_first")).otherwise(F.min("doc_id").over(same))).withColumn("k", F.count(F.lit(1)).over(same))
    home = F.col("doc_id").eqNullSafe(F.col("first"))
    rows = rows.withColumn("kept", F.when(hot, F.col("hot_kept")).otherwise(F.min(F.when(home, _place())).over(same))).where("hot_kept IS NOT NULL OR k > 1")
    # within the first document its earliest place stays
    again = rows.where(~home | (_place() != F.col("kept")))
    return again.groupBy("doc_id", "own").agg(F.sort_array(F.collect_set("at")).alias("cut"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """(doc_id, n_sentences, n_removed, removed, text) of every row of ``docs`` (doc_id, text).

    Sentences are counted in pieces. ``text`` is what is left, ``removed`` the parts taken out as start:end in code points. The first place of a span is that
    of the smallest doc_id, null last, and there the earliest. Rows that agree in doc_id and text are one document and get
    the same result. Null texts stay null and have no sentences; an empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("own", F.hash("text", "doc_id"))
    cuts = removals(rows).select(F.col("doc_id").alias("_doc"), F.col("own").alias("_own"), "cut")
    joined = rows.join(cuts, (F.col("own") == F.col("_own")) & F.col("doc_id").eqNullSafe(F.col("_doc")), "left").select("doc_id", "text", "cut")

    def run(batches):
        names = ["doc_id", "n_sentences", "n_removed", "removed", "text"]
        for b in batches:
            for lo in range(0, b.num_rows, 250):
                part = b.slice(lo, 250)
                total, gone, removed, kept = [], [], [], []
                for text, cut in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    parts, last = _sentences(text or "")
                    out = {x for at in cut or () for x in range(at, last[at])}
                    total.append(len(parts))
                    gone.append(len(out))
                    if not out:
                        removed.append("")
                        kept.append(text)
                        continue
                    ends = np.cumsum([0, *map(len, parts)]).tolist()
                    runs: list[list[int]] = []
                    for s in sorted(out):
                        if runs and runs[-1][1] == ends[s]:
                            runs[-1][1] = ends[s + 1]
                        else:
                            runs.append([ends[s], ends[s + 1]])
                    removed.append(",".join(f"{s}:{e}" for s, e in runs))
                    kept.append("".join(p for i, p in enumerate(parts) if i not in out))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(removed, pa.string()), pa.array(kept, pa.string())], names=names)

    return joined.mapInArrow(run, f"doc_id {kind}, n_sentences bigint, n_removed bigint, removed string, text string")
