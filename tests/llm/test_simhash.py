import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lorekeep.llm import simhash

from .util import docs, groups


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_fingerprint_rules():
    for t in (None, "", " \t\n", "One", "one two", "A b c", "É a b c d", "x y z " * 40, "w\x0bv\x1fu t s r"):
        assert simhash.fingerprint(t) == plain_fingerprint(t), t


def test_seed_matches_spark(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] & (2**64 - 1) == simhash.fingerprint("a b c")


@pytest.mark.parametrize("leaf", [3, 40, 1024])
def test_links_against_brute_force(spark, monkeypatch, leaf):
    monkeypatch.setattr(simhash, "LEAF", leaf)
    rng = np.random.default_rng(leaf)
    base = rng.integers(0, 2**64, 60, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 5), replace=False)) for b in base for _ in range(3)]
    crowd = [0xFFFF << 20 ^ (1 << int(k)) for k in range(40)]  # a dense group under one node
    fps = sorted({*map(int, base), *near, *crowd, 0})
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    want = groups([(signed(a), signed(b)) for i, a in enumerate(fps) for b in fps[i + 1 :] if bin(a ^ b).count("1") <= 2], [signed(x) for x in fps])
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp bigint")
    got = groups([tuple(r) for r in simhash.links(df).collect()], [signed(x) for x in fps])
    assert got == want


def test_documents(spark):
    long = "word " * 30_000 + "tail"
    texts = ["the quick brown fox jumps over the lazy dog"] * 3 + [None, "", " ", long, long, "other text altogether here"]
    df = docs(spark, [(7 * i % 9 + 1, t) for i, t in enumerate(texts)]).withColumn("fp", F.lit(1)).withColumn("component_id", F.lit(2))
    rows = simhash.near_duplicates(df).collect()
    fp = {7 * i % 9 + 1: plain_fingerprint(t) for i, t in enumerate(texts)}
    want = groups([(a, b) for a in fp for b in fp if a < b and bin(fp[a] ^ fp[b]).count("1") <= 2], fp)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{fp[i]:016x}", want[i]) for i in fp}


def test_empty_repeated_and_null_ids(spark):
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    rows = simhash.near_duplicates(docs(spark, [(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (None, "q r s t u")])).collect()
    assert sorted(((r.doc_id, r.component_id) for r in rows), key=str) == [(5, 5), (5, 5), (None, 5), (None, None)]


def test_query_against_brute_force(spark, sf):
    from lorekeep.llm.queries import op4_simhash_trie

    rows = op4_simhash_trie(spark, sf).collect()
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    fp = {i: plain_fingerprint(t) for i, t in texts.items()}
    want = groups([(a, b) for a in fp for b in fp if a < b and bin(fp[a] ^ fp[b]).count("1") <= 2], fp)
    assert {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in rows} == {i: (fp[i], want[i]) for i in fp}
