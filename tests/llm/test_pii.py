import hashlib
import itertools
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorekeep.llm import pii

from .util import docs

CARD = "4539 1488 0343 6467"


def plain_base(text):
    """The base spans by the patterns as they are written."""
    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(d[::-1])) % 10 == 0

    out = []
    for kind, pattern, ok in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(re.sub(r"[^0-9]", "", s)) <= 19 and luhn(re.sub(r"[^0-9]", "", s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(re.sub(r"[^0-9]", "", s)) <= 15),
    ):
        out += [(kind, *m.span()) for m in re.finditer(pattern, text) if ok(m[0])]
    return out


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab@.+-0123459 ()%_é\n"), max_size=60))
def test_base_spans(text):
    assert pii.base_spans(text) == plain_base(text)


def test_base_spans_of_real_looking_text():
    text = f"write a.b+c@mail.example.com or x@y.z@w.org, {CARD} and 4785380592391141, 10.0.0.256 1.2.3.4.5 0001.2.3.4, +1 (017) 555-7713. é +49 30 1234567 @@ a@b"
    assert pii.base_spans(text) == plain_base(text) and {k for k, *_ in plain_base(text)} == set(pii.KINDS)


def test_posteriors_and_best_against_all_segmentations():
    rng = np.random.default_rng(0)
    n, segments = 6, [(0, 2, []), (1, 3, []), (2, 5, []), (3, 4, []), (4, 6, []), (0, 6, [])]
    scores = rng.normal(size=(len(segments), 4)) * 2
    total, best, p = 0.0, (-1.0, None), np.zeros_like(scores)
    for m in range(len(segments) + 1):
        for some in itertools.combinations(range(len(segments)), m):
            spans = sorted(segments[k][:2] for k in some)
            if any(a[1] > b[0] for a, b in itertools.pairwise(spans)):
                continue
            for kinds in itertools.product(range(4), repeat=m):
                w = np.exp(sum(scores[k, t] for k, t in zip(some, kinds, strict=True)))
                total += w
                best = max(best, (w, sorted(zip(some, kinds, strict=True))))
                for k, t in zip(some, kinds, strict=True):
                    p[k, t] += w
    z, got = pii.posteriors(n, segments, scores)
    assert np.isclose(z, np.log(total)) and np.allclose(got, p / total)
    assert sorted(pii.best(n, segments, scores)) == best[1]


def corpus():
    texts = []
    for i in range(150):
        texts += [f"word one {i}.{i % 7}.{i % 250}.{i % 9} here", f"mail bob{i}@mail{i % 5}.example.com now", f"call +1 ({100 + i}) 555-{7000 + i} soon",
                  f"pay {CARD} or 45391488034364{67 + i} done", f"in 20{i:02} there were {i} and 12345{i}", "no numbers at all", f'token = "{hashlib.md5(str(i).encode()).hexdigest()}"']
    return texts


def test_trained_field_finds_and_adds(spark):
    df = docs(spark, corpus())
    w = pii.train(df)
    for text in corpus():
        base, every = pii.all_spans(text, w)
        assert base == plain_base(text) and set(base) <= set(every)
        got = {(k, s, e) for k, s, e, p in pii.field_spans(text, w) if p >= 0.5}
        assert got == set(base), text
    assert pii.all_spans("nothing 2024 here, 17 of 33", w)[1] == []
    assert all(k in pii.KINDS for k, *_ in pii.all_spans("reach me: 1 (212) 555-7713 today", w)[1])


def test_added_spans_by_enumeration(spark):
    """All segmentations of each stretch give the same added spans as the operator, and as the query's path over Spark."""
    rng = np.random.default_rng(2)
    weights = rng.normal(size=(len(pii.KINDS), len(pii.FEATURES)))
    weights[:, 0] -= 0.5
    texts = ["call 12 345-6789 x", "at 10.2.3.4 or a@b.cc", "n 1234567 then b@c.dd.", "no 99", "1.2.3.400 7654321", "card 4539148803436467 and x@y.zz"]

    def best_of(text, start, end):
        bounds, segments = pii.candidates(text, start, end)
        n, scores = len(bounds) - 1, pii._scored(segments, weights)
        ways = [[] for _ in range(n + 1)]  # (weight, segments) of every way to cover atoms 0..j
        ways[0] = [(0.0, ())]
        for j in range(1, n + 1):
            ways[j] += ways[j - 1]
            for k, (a, b, _) in enumerate(segments):
                if b == j:
                    ways[j] += [(w + scores[k, c], (*way, (k, c))) for w, way in ways[a] for c in range(len(pii.KINDS))]
        total = np.logaddexp.reduce([w for w, _ in ways[n]])
        top = max(ways[n], key=lambda x: x[0])[1]
        share = lambda kc: np.exp(np.logaddexp.reduce([w for w, way in ways[n] if kc in way]) - total)
        return [(pii.KINDS[c], bounds[segments[k][0]], bounds[segments[k][1]], share((k, c))) for k, c in top]

    for sure in (0.1, 0.5, 0.9):
        for text in texts:
            base = plain_base(text)
            spans = [x for s, e in pii.stretches(text) for x in best_of(text, s, e)]
            more = {(k, s, e) for k, s, e, p in spans if p >= sure and not any(s < y and x < e for _, x, y in base)}
            assert set(pii.all_spans(text, weights, sure)[1]) == more | set(base), (text, sure)
    order = {k: i for i, k in enumerate(pii.KINDS)}
    got = {r.doc_id: r.spans for r in pii.found(docs(spark, texts), weights).collect()}
    for i, text in enumerate(texts):
        every = sorted(pii.all_spans(text, weights)[1], key=lambda x: (order[x[0]], *x[1:]))
        assert got[i] == ",".join(f"{k}:{s}:{e}" for k, s, e in every)


def test_overlaps_are_found_in_one_walk():
    text = "mail a@b.cc now " * 4000
    base, every = pii.all_spans(text, np.zeros((len(pii.KINDS), len(pii.FEATURES))))
    assert len(base) == 4000 and set(base) <= set(every)


def check(rows, given):
    assert len(rows) == len(given)
    got = sorted(((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in rows), key=str)
    want = []
    for i, t in given:
        base = plain_base(t or "")
        want.append((i, *(sum(b[0] == k for b in base) for k in pii.KINDS), hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_odd_tables(spark):
    given = list(enumerate(["", None, "x@y.zz " * 3000, "1" * 50_000, "no"])) + [(2, "a@b.cc"), (2, "a@b.cc"), (None, "1.2.3.4")]
    df = docs(spark, given).withColumn("spans", F.lit(1)).withColumn("n_email", F.lit("c"))
    check(pii.found(df).collect(), given)
    assert pii.found(docs(spark, [])).count() == 0
    out = {r.doc_id: r for r in pii.masked(df).collect()}
    assert out[None].text == "<IP>" and out[1].text is None and out[2].text == "<EMAIL>" and out[2].n_chars == 7


def test_query(spark, sf):
    from lorekeep.llm.queries import op8_pii_semi_markov

    given = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check(op8_pii_semi_markov(spark, sf).collect(), given)


def test_very_long_runs():
    for text in ("7" * 300_000, "1." * 100_000, "1.2.3.4" * 3 + "9" * 300_000, "+1" + " " * 100_000, "a" * 300_000 + "@"):
        pii.base_spans(text)
    assert pii.base_spans("x" + "0" * 50_000 + "7.1.2.3") == [("ip", 1, 50_008)]


def test_every_numeric_sign_of_unicode():
    """Signs that count as digits or numbers without being 0 to 9 neither stop the field nor make an address of bytes."""
    import sys
    import unicodedata

    signs = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and unicodedata.category(c)[0] == "N" and not c.isascii()]
    assert "²" in signs and len(signs) > 1000
    byte = pii.FEATURES.index("parts_of_a_byte")
    weights = np.ones((len(pii.KINDS), len(pii.FEATURES)))
    assert byte in pii.span_features("10.20.30.2", 0, 10)
    for c in signs:
        text = f"see 10.20.30.{c} and 10.{c}.30.40 here, 192.168.10.1{c} too"
        pii.all_spans(text, weights)
        pii.field_spans(text, weights)
        assert byte not in pii.span_features(f"10.20.30.{c}", 0, 10)
