"""URL filtering by given rules and by association rules mined from labelled urls.

A url is a set of tokens: the parts of its host and their suffixes, the words in them, the segments of its path by place, the
form of numbers instead of the numbers, the names of its query's parameters. Token sets that are frequent among labelled urls together
with the label are mined round by round, each a token longer, over all tokens of every url; of these the rules "tokens -> block" stay that are frequent and sure enough
and that no rule with fewer of the same tokens equals (``mined``). Given and mined rules are matched by one inverted index: each
stands under one token, a mined rule under its rarest, so that a url looks at the few rules under its own tokens and checks
the rest of their tokens there. Every distinct url is looked up once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

#: Labelled urls at least, and their least share, that bear a rule's tokens and are to be blocked; share of those with its tokens that
#: are to be blocked at least; rules up to which the index is broadcast, beyond it is joined by shuffle.
LEAST, SUPPORT, CONFIDENCE, BROADCAST = 20, 0.001, 0.6, 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: str | Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; without ``://``, or null: empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: str | Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; without ``://``, or null: empty."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def _suffixes(parts: Column) -> Column:
    """All suffixes of an array of host parts, joined by dots."""
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def tokens(url: str | Column) -> Column:
    """The distinct tokens of a url; one without ``://`` has none."""
    h, p = host(url), path(url)
    formed = lambda c: F.regexp_replace(F.translate(c, UPPER, LOWER), "[0-9]+", "0")
    parts = F.split(h, r"\.")
    segments = F.filter(F.split(p, "/"), lambda s: s != "")
    names = F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda s: s != "")
    every = F.concat(
        F.transform(_suffixes(parts), lambda s: F.concat(F.lit("host="), s)),
        F.transform(F.filter(F.split(h, "[^a-z0-9]+"), lambda s: s != ""), lambda s: F.concat(F.lit("word="), formed(s))),
        F.transform(segments, lambda s, i: F.concat(F.lit("path"), i.cast("string"), F.lit("="), formed(s))),
        F.transform(names, lambda s: F.concat(F.lit("name="), formed(F.substring_index(s, "=", 1)))),
        F.array(F.concat(F.lit("scheme="), formed(F.substring_index(url, "://", 1)))),
    )
    return F.when(F.instr(url, "://") > 0, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def mined(labelled: DataFrame, least: int = LEAST, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(tokens, key, hits, seen) of the rules "tokens -> block" from ``labelled`` (url, block boolean).

    hits counts the labelled urls with the tokens that are to be blocked, seen those with the tokens. Rows with a null label, and
    urls without tokens, take no part; repeated rows count each. key is the token that fewest labelled urls have. No rows where
    fewer than ``least`` urls are labelled.

    Sets grow by a token a round, from those that can still be part of a rule: a set that as many urls bear as one of its parts makes
    a weaker rule than without the token, as does all that holds it; and nothing is surer than a set that only blocked urls bear. So
    tokens that always come together, as in the long path of a url, don't multiply.
    """
    spark = labelled.sparkSession
    rows = labelled.where("block IS NOT NULL").select("block", F.array_sort(tokens("url")).alias("tokens")).where("size(tokens) > 0")
    urls = rows.groupBy("tokens").agg(F.count(F.lit(1)).alias("seen"), F.count(F.when(F.col("block"), 1)).alias("hits"))
    urls = written(urls.withColumn("url", F.monotonically_increasing_id()), "labelled")
    n, m = (x or 0 for x in urls.agg(F.sum("seen"), F.sum("hits")).first())
    none = spark.createDataFrame([], "tokens array<string>, key string, hits bigint, seen bigint")
    floor = max(least, support * n)
    if n < least or m < floor:
        return none
    sums = (F.sum("seen").alias("seen"), F.sum("hits").alias("hits"))
    each = urls.select("url", "seen", "hits", F.explode("tokens").alias("token"))
    level = each.groupBy("token").agg(*sums).where(F.col("hits") >= floor)
    level = written(level.select(F.array("token").alias("tokens"), F.struct(F.col("seen").alias("n"), "token").alias("rare"), "seen", "hits"), "sets")
    # what is in no longer set any more needn't be looked at
    open_ = level.where("hits < seen")
    some = each.join(open_.select(F.col("rare.token").alias("token")), "token").groupBy("url").agg(F.array_sort(F.collect_list("token")).alias("tokens"), F.first("seen").alias("seen"), F.first("hits").alias("hits"))
    some = written(some.groupBy("tokens").agg(*sums).where("size(tokens) > 1"), "frequent")
    found, size = [level], 1
    while open_.limit(1).count():
        if size == 1:
            both = some.withColumn("a", F.explode("tokens")).select("a", F.explode("tokens").alias("b"), "seen", "hits").where("a < b")
            pairs = both.groupBy(F.array("a", "b").alias("tokens")).agg(*sums).where(F.col("hits") >= floor)
            counted = _of_parts(pairs, open_, 2)
        else:
            index = _of_parts(_longer(open_, size), open_, size + 1).withColumn("rule", F.xxhash64(F.array_join("tokens", "\x01"))).withColumn("key", F.col("rare.token"))
            index = written(index, "candidates")
            counted = _looked_up(some, index).groupBy("rule").agg(*sums).where(F.col("hits") >= floor).join(index, "rule")
        level = written(counted.where("seen < part_seen").select("tokens", "rare", "seen", "hits"), "sets")
        found.append(level)
        open_, size = level.where("hits < seen"), size + 1
    sure = reduce(DataFrame.union, found).where(F.col("hits") >= F.lit(confidence) * F.col("seen"))
    sure = sure.select(F.xxhash64(F.array_join("tokens", "\x01")).alias("rule"), "tokens", F.col("rare.token").alias("key"), "hits", "seen")
    return _without_weaker(written(sure, "sure")).select("tokens", "key", "hits", "seen")


def _longer(sets: DataFrame, size: int) -> DataFrame:
    """(tokens) of ``size`` + 1 that two of ``sets`` of ``size`` sorted tokens make that differ in the last."""
    first, last = F.slice("tokens", 1, size - 1), F.element_at("tokens", -1)
    a, b = sets.select(first.alias("first"), last.alias("a")), sets.select(first.alias("first"), last.alias("b"))
    return a.join(b, "first").where("a < b").select(F.concat("first", F.array("a", "b")).alias("tokens"))


def _of_parts(sets: DataFrame, parts: DataFrame, size: int) -> DataFrame:
    """Those of ``sets`` of ``size`` tokens all of whose parts with one token less are among ``parts``, with what the rarest of these has
    been ``part_seen``, and their rarest token."""
    less = F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: F.concat(F.slice("tokens", 1, i - 1), F.slice("tokens", i + 1, size)))
    known = parts.select(F.col("tokens").alias("part"), "rare", F.col("seen").alias("part_seen"))
    met = sets.withColumn("part", F.explode(less)).join(known, "part").groupBy(*sets.columns)
    return met.agg(F.count(F.lit(1)).alias("k"), F.min("part_seen").alias("part_seen"), F.min("rare").alias("rare")).where(F.col("k") == size).drop("k")


def _looked_up(rows: DataFrame, index: DataFrame) -> DataFrame:
    """``rows`` (tokens, ...) with the rules of ``index`` (rule, tokens, key, ...) whose tokens they all have: a row for each pair."""
    more = [F.col(c).alias(f"rule_{c}") for c in index.columns if c not in ("rule", "key")]
    entries = index.select(F.col("key").alias("_token"), "rule", *more)
    if index.count() <= BROADCAST:
        entries = F.broadcast(entries)
    out = rows.withColumn("_token", F.explode("tokens")).join(entries, "_token")
    return out.where(F.size(F.array_except("rule_tokens", "tokens")) == 0).drop("_token")


def _without_weaker(rules: DataFrame) -> DataFrame:
    """Rules without those that hold all tokens of another rule that is as sure; of rules on one set of labelled urls the shortest stays."""
    other = rules.select(F.col("rule").alias("own"), "tokens", F.col("hits").alias("own_hits"), F.col("seen").alias("own_seen"))
    weaker = _looked_up(other, rules).where((F.col("rule") != F.col("own")) & (F.col("rule_hits") * F.col("own_seen") >= F.col("own_hits") * F.col("rule_seen")))
    return rules.join(weaker.select(F.col("own").alias("rule")).distinct(), "rule", "left_anti")


def given(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """(host, path, verdict, name) of rules as ``("allow", "example.org/en/")``; a host in capitals is lower-cased."""
    rows = [(name.partition("/")[0].translate(str.maketrans(UPPER, LOWER)), "/" + name.partition("/")[2], verdict, name) for verdict, name in rules]
    return spark.createDataFrame(rows, "host string, path string, verdict string, name string")


def judged(pages: DataFrame, rules: DataFrame, mined_rules: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict, by) of every row of ``pages`` (page_id, url).

    ``rules`` (host, path, verdict, name) decide first: a rule fits its host and all subdomains if the path starts with the
    rule's; of those that fit the one with the longest name wins, then the least name. Other urls are blocked if a rule of
    ``mined_rules`` fits, else allowed; ``by`` tells which (given, mined, none). Null urls, and urls without ``://``, have an empty host
    and path, no rule and are allowed. Repeated rows and null ids are judged like any other; an empty table gives no rows.
    """
    urls = written(pages.select(F.col("url").cast("string").alias("url")).where("url IS NOT NULL").distinct(), "urls")
    parsed = urls.select("url", host("url").alias("host"), path("url").alias("path"))
    hosts = rules.select(F.col("host").alias("_suffix"), F.col("path").alias("_path"), "verdict", "name")
    if rules.count() <= BROADCAST:
        hosts = F.broadcast(hosts)
    fits = parsed.withColumn("_suffix", F.explode(_suffixes(F.split("host", r"\.")))).join(hosts, "_suffix").where(F.startswith("path", "_path"))
    first = fits.groupBy("url").agg(F.min(F.struct((-F.length("name")).alias("long"), "name", "verdict")).alias("g"))
    index = mined_rules.withColumn("rule", F.xxhash64(F.array_join("tokens", "\x01"))).select("rule", "tokens", "key")
    mine = _looked_up(urls.select("url", tokens("url").alias("tokens")), index).select("url").distinct().withColumn("m", F.lit(True))
    every = first.join(mine, "url", "full_outer").select("url", F.col("g.name").alias("rule"), F.coalesce("g.verdict", F.lit("block")).alias("verdict"), F.when(F.col("g").isNotNull(), "given").otherwise("mined").alias("by"))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url")).join(every, "url", "left")
    return rows.select("page_id", host("url").alias("host"), path("url").alias("path"), "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"), F.coalesce("by", F.lit("none")).alias("by"))


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, block) of pages whose document is labelled: the last number in a page's path is the id of the document that it
    shows. Documents of quality 0, and toxic ones, are to be blocked; where a document has several labels, one such is enough.
    Numbers that no id can be, and null ids, have no label."""
    number = F.expr("try_cast(regexp_extract(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '([0-9]{1,18})[^0-9]*$', 1) as bigint)")
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("_doc")).agg(F.max((F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)).alias("block"))
    return pages.select("url", number.alias("_doc")).join(marks, "_doc").select("url", "block")
