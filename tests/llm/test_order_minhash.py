import hashlib
import re
import struct
from collections import defaultdict

import xxhash
from pyspark.sql import functions as F

from lorekeep.llm import order_minhash as om

from .util import docs

X = xxhash.xxh64_intdigest
M64 = 2**64 - 1


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def plain(text, k=2, sketches=64, size=2):
    """Buckets and tuple hashes by the definition, with counts of occurrences kept in a dict."""
    bits = sketches.bit_length() - 1
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")

    def chain(ws):
        seed = 42
        for w in ws:
            seed = X(w.encode(), seed)
        return seed

    def kmer(ws):  # the hash of the first two, then of that hash and each next word
        h = chain(ws[:2])
        for w in ws[2:]:
            h = X(w.encode(), X(struct.pack("<q", signed(h)), 42))
        return h

    kmers = [kmer(words[i : i + k]) for i in range(len(words) - k + 1)] or ([chain(words)] if words else [])
    seen, rows = defaultdict(int), defaultdict(list)
    for pos, h in enumerate(kmers):
        top = signed(h) >> om._POS
        g = X(struct.pack("<i", seen[top]), X(struct.pack("<q", top), 42))
        seen[top] += 1
        g = g & ~((1 << om._POS) - 1) & M64
        rows[g >> (64 - bits)].append((signed(g | pos), pos))
    out = set()
    for bucket, entries in rows.items():
        least = sorted(entries)[:size]
        seed = 42
        for g, _ in sorted(least, key=lambda e: e[1]):
            seed = X(struct.pack("<q", (g & M64) >> om._POS), seed)
        out.add(bucket << (32 - bits) | (seed & ((1 << (32 - bits)) - 1)))
    return out


def alike(a, b, bits=6):
    used = {x >> (32 - bits) for x in a} | {x >> (32 - bits) for x in b}
    return len(a & b) / len(used) if used else 1.0


TEXTS = ["", None, "  \t", "one", "one two", "a b a b a b a b c", "the cat " * 300 + "end", "x", "Ünï cödé wörds " * 5,
         " ".join(f"w{i * i % 101}" for i in range(400)), "lead ing\x0bspace\x1ckept here", "one two"]


def test_signatures(spark):
    rows = om.with_signature(docs(spark, TEXTS), "text", "sig").collect()
    for r in rows:
        assert set(r.sig) == plain(r.text), r.text
        assert len(r.sig) == len(set(r.sig))
    for k, s, size in ((1, 16, 3), (3, 8, 2)):
        for r in om.with_signature(docs(spark, TEXTS), "text", "sig", k, s, size).collect():
            assert set(r.sig) == plain(r.text, k, s, size), (r.text, k)


def check(rows, given):
    order = sorted(given, key=lambda r: (-(r[0] if r[0] is not None else -(2**63)), r[1] or ""))
    want = []
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
        t, nxt = t or "", nxt or ""
        cut = len(t) // 3
        e = t[: len(t) - cut] + nxt[:cut]
        a, b, c = plain(t), plain(e), plain(nxt)
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), len(a) * 8, alike(a, b), alike(a, c)))
    got = [(r.doc_id, r.n_chars, r.edited_sha256, len(r.fingerprint), r.near_edited, r.near_next) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_edited_and_next(spark):
    given = list(enumerate(TEXTS)) + [(None, "null id"), (3, "again"), (3, "again"), (3, "zeta"), (-5, "below zero now")]
    rows = om.fingerprint_documents(docs(spark, given).withColumn("sig", F.lit(1)).withColumn("next_text", F.lit("x"))).collect()
    check(rows, given)
    same = {r.doc_id: r.fingerprint for r in rows}
    assert same[4] == same[11] and same[0] == same[1] == ""


def test_single_and_none(spark):
    check(om.fingerprint_documents(docs(spark, [(9, "only one here")])).collect(), [(9, "only one here")])
    assert om.fingerprint_documents(docs(spark, [])).count() == 0


def test_edit_distance_is_felt(spark):
    base = [f"word{i}" for i in range(600)]
    turned = base[300:] + base[:300]
    shuffled = sorted(base, key=lambda w: hashlib.md5(w.encode()).hexdigest())
    near = base[:]
    near[50] = "other"
    rows = om.with_signature(docs(spark, [" ".join(x) for x in (base, near, turned, shuffled)]), "text", "sig", k=1).collect()
    s = [set(r.sig) for r in sorted(rows, key=lambda r: r.doc_id)]
    assert alike(s[0], s[1]) > 0.9 and max(alike(s[0], s[2]), alike(s[0], s[3])) < 0.8  # these two have exactly the words of the first


def test_query(spark, sf):
    from lorekeep.llm.queries import op9_order_minhash

    given = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check(op9_order_minhash(spark, sf).collect(), given)
