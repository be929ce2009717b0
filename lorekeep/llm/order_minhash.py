"""Order MinHash document fingerprints, in DataFrame operations only.

A text is a sequence of words; its k-mers are numbered by occurrence, so that repeats are distinct. One hash of
(k-mer, occurrence) deals them into ``sketches`` buckets and orders them there; of each bucket the ``tuple_size`` smallest
are taken, put back into text order and hashed together. A bucket thus agrees between two texts if they share its minimal
k-mers *in the same order*, which follows the edit distance of the word sequences and not only the sets of words.

All of it is array work within a row: sorts of longs that pack a hash above a position, with no shuffle and no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions

#: Low bits of a packed long that hold a position: a billion words take more bytes than a row of Spark can have.
_POS = 30
_WS = "' \\t\\n\\u000b\\u000c\\r'"


def with_signature(df: DataFrame, text: str, out: str, k: int = 2, sketches: int = 64, tuple_size: int = 2) -> DataFrame:
    """Adds ``out``, array<int>: for each bucket that holds a k-mer, its number in the top bits and the tuple's hash below.

    ``sketches`` is a power of two. Words are runs of other characters than space and \\t-\\r. Texts of fewer than ``k``
    words have one k-mer, empty and null texts none (an empty array).
    """
    bits = sketches.bit_length() - 1
    if 1 << bits != sketches:
        raise ValueError("sketches must be a power of two")
    w, s, p, b, c = (f"_{out}_{x}" for x in "wspbc")
    kmers = f"{w}"
    for j in range(1, k):  # each step adds the j-th next word to the hash
        short = f"slice({kmers}, 1, greatest(size({w}) - {j}, 0))"
        kmers = f"zip_with({short}, slice({w}, {j + 1}, greatest(size({w}) - {j}, 0)), (x, y) -> xxhash64(x, y))"
    if k == 1:
        kmers = f"transform({w}, x -> xxhash64(x))"
    low = (1 << _POS) - 1
    few = f"CASE WHEN size({w}) = 0 THEN cast(array() as array<bigint>) WHEN size({w}) < {k} THEN array(xxhash64({w})) ELSE {kmers} END"
    return (
        df.withColumn(w, F.expr(f"btrim(coalesce({text}, ''), {_WS})"))
        .withColumn(w, F.expr(f"if({w} = '', cast(array() as array<string>), split({w}, '[ \\\\x09-\\\\x0D]+'))"))
        .withColumn(s, F.expr(few))
        # sorted by k-mer, then position
        .withColumn(s, F.expr(f"sort_array(transform({s}, (x, i) -> (x & ~{low}L) | cast(i as bigint)))"))
        .withColumn(p, F.expr(f"reverse(transform(sequence(0, cast(floor(log2(greatest(size({s}), 1))) as int)), e -> shiftleft(1, e)))"))
        # occurrence number: steps back over equal k-mers, found by halving steps; hashed with the k-mer, position kept
        .withColumn(b, F.expr(f"""sort_array(transform({s}, (x, j) ->
            (xxhash64(shiftright(x, {_POS}), if(j = 0 or shiftright(get({s}, j - 1), {_POS}) <> shiftright(x, {_POS}), 0,
                aggregate({p}, 0, (t, d) -> if(j - t - d >= 0 and shiftright(get({s}, j - t - d), {_POS}) = shiftright(x, {_POS}), t + d, t))
            )) & ~{low}L) | (x & {low}L)))"""))
        # the smallest of each bucket
        .withColumn(c, F.expr(f"filter({b}, (x, j) -> j < {tuple_size} or shiftright(get({b}, j - {tuple_size}), {64 - bits}) <> shiftright(x, {64 - bits}))"))
        # where a bucket begins: its entries in text order, hashed as a tuple
        .withColumn(out, F.expr(f"""transform(
            filter(sequence(1, size({c})), j -> size({c}) > 0 and (j = 1 or shiftright(get({c}, j - 2), {64 - bits}) <> shiftright(get({c}, j - 1), {64 - bits}))),
            j -> cast((shiftrightunsigned(get({c}, j - 1), {64 - bits}) << {32 - bits}) | (
                xxhash64(transform(sort_array(transform(
                    filter(slice({c}, j, {tuple_size}), y -> shiftright(y, {64 - bits}) = shiftright(get({c}, j - 1), {64 - bits})),
                    y -> shiftleft(y & {low}L, {64 - _POS}) | shiftrightunsigned(y, {_POS}))),
                    z -> z & {(1 << (64 - _POS)) - 1}L)) & {(1 << (32 - bits)) - 1}L) as bigint))"""))
        .drop(w, s, p, b, c)
    )


def likeness(a: str, b: str, sketches: int = 64) -> Column:
    """Share of the buckets used by either signature that agree; two empty ones are alike (1), an empty and another are not (0)."""
    shift = 32 - (sketches.bit_length() - 1)
    used = f"size(array_union(transform({a}, x -> shiftright(x, {shift})), transform({b}, x -> shiftright(x, {shift}))))"
    return F.expr(f"if(size({a}) = 0 and size({b}) = 0, 1.0D, size(array_intersect({a}, {b})) / cast({used} as double))")


def text_of(sig: str) -> Column:
    """A signature as a string: eight hex digits for each bucket used."""
    return F.expr(f"lower(array_join(transform({sig}, x -> lpad(hex(x), 8, '0')), ''))")


def with_next(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Adds ``next_<c>`` for each column: its value in the next row by descending ``key`` (bigint), after the last the first.

    One shuffle: keys are cut into ranges at approximate quantiles, which are keys of the table. The first row of a range is
    sent to the range before it too, as its closing row; so no window sees more than a range. Null keys come last, rows of
    one key in the order of ``columns``.
    """
    spark = df.sparkSession
    df = df.withColumn("_key", F.coalesce(F.col(key).cast("bigint"), F.lit(-(2**63))))
    parts = 4 * shuffle_partitions(spark)
    cuts = df.agg(F.percentile_approx("_key", [i / parts for i in range(1, parts)] or [0.5], 10 * parts), F.max("_key")).first()
    if cuts[1] is None:  # no rows
        for c in columns:
            df = df.withColumn(f"next_{c}", F.col(c))
        return df.drop("_key")
    bounds = sorted({*cuts[0], cuts[1]})
    wide = max(1, round(len(bounds) ** 0.5))
    lit = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<bigint>")
    df = (
        df.withColumn("_coarse", F.size(F.filter(lit(bounds[wide - 1 :: wide]), lambda x: x < F.col("_key"))) * wide)
        .withColumn("_range", F.col("_coarse") + F.size(F.filter(F.slice(lit(bounds), F.col("_coarse") + 1, F.lit(wide)), lambda x: x < F.col("_key"))))
        .withColumn("_first", F.get(lit(bounds), F.col("_range")) == F.col("_key"))
        .withColumn("_at", F.explode(F.when(F.col("_first"), F.array(F.struct(F.col("_range").alias("r"), F.lit(False).alias("closing")),
                                                                     F.struct(((F.col("_range") + 1) % len(bounds)).alias("r"), F.lit(True).alias("closing"))))
                                     .otherwise(F.array(F.struct(F.col("_range").alias("r"), F.lit(False).alias("closing"))))))
        .withColumn("_range", F.col("_at.r")).withColumn("_closing", F.col("_at.closing")).drop("_at", "_coarse", "_first")
    )
    w = Window.partitionBy("_range").orderBy("_closing", F.col("_key").desc(), *columns)
    for c in columns:
        df = df.withColumn(f"next_{c}", F.lead(c).over(w))
    return df.where(~F.col("_closing")).drop("_key", "_range", "_closing")


def fingerprint_documents(docs: DataFrame, k: int = 2, sketches: int = 64, tuple_size: int = 2) -> DataFrame:
    """Fingerprints of each text, of its edited form and of the next document's text, with their likeness.

    The edited text ends, in place of its last third of code points, with as many (or all) of the first of the next document
    by descending doc_id. Null texts count as empty; null ids come last; rows of one id follow each other by text; repeated
    rows each come out; the only document is next to itself; an empty table gives no rows.
    """
    d = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    d = with_signature(d, "text", "sig", k, sketches, tuple_size)
    d = with_next(d, "doc_id", ["text", "sig"])
    d = d.withColumn("n_chars", F.length("text").cast("bigint")).withColumn("_cut", F.expr("cast(floor(n_chars / 3) as int)"))
    d = d.withColumn("edited", F.expr("concat(left(text, cast(n_chars as int) - _cut), left(next_text, _cut))"))
    d = with_signature(d, "edited", "edited_sig", k, sketches, tuple_size)
    return d.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        text_of("sig").alias("fingerprint"), text_of("edited_sig").alias("edited_fingerprint"),
        likeness("sig", "edited_sig", sketches).alias("near_edited"), likeness("sig", "next_sig", sketches).alias("near_next"),
    )
