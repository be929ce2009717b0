import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorekeep.llm import lexical as lx

from .util import docs

_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return [t.translate({i: i + 32 for i in range(65, 91)}) for t in _TERM.findall(text or "")]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_terms(text):
    assert [t.decode() for t in lx.terms(text.encode())] == plain_terms(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**63 - 1), max_size=30))
def test_packed(values):
    data, size = lx.packed(np.array(values, np.int64))
    assert lx.unpacked(data.tobytes()).tolist() == values and size.sum() == len(data)


def test_best_against_all_scores():
    r = random.Random(1)
    for _ in range(1500):
        lists, every = [], Counter()
        for _ in range(r.randrange(0, 8)):
            some, w = sorted(r.sample(range(60), r.randrange(1, 50))), r.choice([0, 1, 5, 50])
            adds = [w * r.randrange(0, 4) for _ in some]
            every.update(dict(zip(some, adds, strict=True)))
            lists.append((max(adds), some, adds))
        k = r.choice([1, 3, 10])
        want = sorted(((s, d) for d, s in every.items() if s > 0), key=lambda x: (-x[0], x[1]))[:k]
        assert sorted(lx.best(lists, k), key=lambda x: (-x[0], x[1])) == want


def brute(documents, items, k=10):
    """All scores of all documents, by the definition."""
    counts = [Counter(plain_terms(t)) for _, t in documents]
    n, total = sum(bool(c) for c in counts), sum(c.total() for c in counts)
    df = Counter(t for c in counts for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for (i, _), c in zip(documents, counts, strict=True):
            m = 100 - 90 + (90 * c.total() * n) // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(plain_terms(text)) if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def found(rows):
    return sorted((tuple(r) for r in rows.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_odd_tables(spark, monkeypatch):
    r = random.Random(3)
    words = [f"w{i}" for i in range(40)] + ["Éa", "ẞ", "x9"]
    given = [(i * 7 % 101, " ".join(r.choices(words, k=r.randrange(1, 30)))) for i in range(80)]
    given += [(200, None), (201, ""), (202, "., !"), (None, "w1 w2 w3"), (None, "w1 w2 w3"), (5, "w1 w2 w3"), (5, "w1 w2 w3"), (6, "w3 w2 w1"), (-3, "W1 w2\x00w3"), (203, "w1 " * 30_000 + "rare"), (204, "q" * 100_000)]
    items = [(1, "w1, W2 w3!"), (1, "w1, W2 w3!"), (1, "rare w7"), (2, None), (3, ""), (4, "unseen words"), (None, "éa ẞ x9 Éa"), (6, " ".join(words)), (7, "q" * 100_000)]
    df = docs(spark, given).withColumn("term", F.lit("t")).withColumn("n", F.lit(1)).withColumn("a.b", F.lit(1)).repartition(3)
    asked = spark.createDataFrame(items, "item_id bigint, text string").withColumn("term", F.lit(0)).withColumn("score", F.lit(0))
    want = brute(given, items)
    assert found(lx.search(lx.index(df), asked)) == want
    # many small shards, many blocks, no broadcast
    monkeypatch.setattr(lx, "SHARD", 300)
    monkeypatch.setattr(lx, "BLOCK", 20)
    monkeypatch.setattr(lx, "BROADCAST", 0)
    small = lx.index(df)
    assert small.where("term IS NULL").count() > 10
    assert found(lx.search(small, asked)) == want
    assert lx.search(lx.index(df.limit(0)), asked).count() == 0 and lx.search(small, asked.limit(0)).count() == 0
    assert sum(len(x.ids) for x in small.where("term IS NULL").collect()) == len(given)


def test_query_and_sql(spark):
    from lorekeep.llm.queries import OP12_SQL, op12_heap_merge_search

    sf = "/root/testdata/sf0.01"
    rows = op12_heap_merge_search(spark, sf)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(f"SELECT item_id, rank, doc_id, score FROM ({OP12_SQL})").fetchall()
    assert found(rows) == sorted(want, key=str) and len(want) == 400
    given = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    assert found(rows) == brute(given, items)
