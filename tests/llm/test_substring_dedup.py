import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorekeep.llm import substring_dedup as sd

from .util import docs


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab .!?\n\t"), max_size=40))
def test_sentences_join_to_the_text(text):
    parts = sd.sentences(text)
    assert "".join(parts) == text and all(parts)


def test_sentences():
    assert sd.sentences("One 1.5 two. Three?! Four\n\nFive") == ["One 1.5 two. ", "Three?! ", "Four\n\n", "Five"]


def brute(given):
    """All spans by their words, first places by order, and what is left."""
    def spans_of(t):
        parts = sd.sentences(t)
        w = [p.split() for p in parts]
        ended = [bool(x) and (x[-1][-1] in ".!?" or "\n" in re.findall(r"\s*\S+\s*", p)[-1]) for p, x in zip(parts, w, strict=True)]
        of, long = [sum(ended[:k]) for k in range(len(parts))], {}
        for k, x in zip(of, w, strict=True):
            long[k] = long.get(k, 0) + len(x)
        for i in range(len(parts)):
            for j in range(i + 2, len(parts) + 1):
                some = [x for p in w[i:j] for x in p]
                if len(some) >= 20 and (of[i] < of[j - 1] or long[of[i]] > 40):
                    yield i, j, tuple(some)
                    break

    first, out = {}, {}
    rows = sorted({(i is None, i or 0, t or "") for i, t in given})
    for none, i, t in rows:
        gone = set()
        for a, b, key in spans_of(t):
            if first.setdefault(key, (none, i, t, a)) != (none, i, t, a):
                gone |= set(range(a, b))
        out[None if none else i, t] = gone
    return out


def check(rows, given):
    want = brute(given)
    assert len(rows) == len(given)
    texts = {}
    for r in rows:
        texts.setdefault(r.doc_id, []).append((r.n_sentences, r.n_removed, r.text, r.removed))
    for i, t in given:
        parts, gone = sd.sentences(t or ""), want[i, t or ""]
        left = t if not gone else "".join(p for k, p in enumerate(parts) if k not in gone)
        row = next(x for x in texts[i] if x[:3] == (len(parts), len(gone), left))
        cut = "".join(t[int(a) : int(b)] for a, b in re.findall(r"(\d+):(\d+)", row[3])) if row[3] else ""
        assert cut == "".join(p for k, p in enumerate(parts) if k in gone)


PASSAGE = "The first sentence of a passage has some words. Then the second sentence follows it closely. A third one ends the passage here."


def test_passages(spark):
    given = [
        (5, f"Own beginning here. {PASSAGE} Own end of five."), (2, f"Words before that run on into {PASSAGE} And words after."), (9, f"{PASSAGE}\n{PASSAGE}"),
        (1, "Short. Short. Short. Short."), (3, "Short. Short. Other."), (7, PASSAGE), (8, PASSAGE.replace(" ", "  ")), (None, PASSAGE), (11, None), (12, ""), (13, "\n\n"), (18, "\n \n" + PASSAGE),
        (14, "one " * 25 + "end. Different text follows."), (15, "Something first. " + "one " * 25 + "end."), (7, PASSAGE), (7, "x. " + PASSAGE), (16, "w " * 40_000 + "."), (17, "w " * 40_000 + "."),
    ]
    check(sd.deduplicated(docs(spark, given).withColumn("own", F.lit(1)).withColumn("at", F.lit("x")).withColumn("hash", F.lit(2))).collect(), given)
    assert sd.deduplicated(docs(spark, [])).count() == 0


def test_query(spark, sf):
    from lorekeep.llm.queries import op1_sentence_spans

    given = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows = op1_sentence_spans(spark, sf).collect()
    check(rows, given)
    assert any(r.n_removed for r in rows)


def test_planted_passages_are_caught(spark):
    """Passages of over 50 words that stand in the middle of other sentences, at sf0.01."""
    rows = {r.doc_id: r for r in sd.deduplicated(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    texts = dict(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect())
    seen, repeated = {}, {}
    for i in sorted(texts):
        w = texts[i].split()
        for j in range(len(w) - 49):
            key = hash(tuple(w[j : j + 50]))
            if seen.setdefault(key, i) != i:
                repeated.setdefault(i, []).append(j)
    caught = sum(rows[i].n_removed > 0 for i in repeated)
    assert caught >= 0.9 * len(repeated), (caught, len(repeated))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(0, 60), st.integers(0, 60))
def test_long_passages_without_marks_are_cut_alike_anywhere(seed, before, after):
    r = random.Random(seed)
    words = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    shared = words(60)
    texts = [" ".join(words(n) + shared + words(after)) for n in (before, before + 7)]
    parts = [sd.sentences(t) for t in texts]
    assert ["".join(p) for p in parts] == texts and all(len(x.split()) <= sd.LONGEST for p in parts for x in p)
    a, b = ({x[2] for x in sd.spans(t)} for t in texts)
    assert a & b


def test_sentences_that_words_without_marks_run_into():
    missed = 0
    for seed in range(300):
        r = random.Random(seed)
        words = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
        passage = " ".join(" ".join(words(n)) + "." for n in ((18, 18, 18) if seed % 2 else (26, 26)))
        inside = " ".join([*words(15), passage[:-1], *words(15)])
        missed += not {x[2] for x in sd.spans(passage)} & {x[2] for x in sd.spans(inside)}
    assert missed <= 15, missed


def test_one_sentence_is_no_span():
    for n in (17, 20, 24, 30, 40):
        for seed in range(100):
            r = random.Random(seed)
            one = " ".join(f"w{r.randrange(10**6)}" for _ in range(n)) + "."
            assert sd.spans(one) == [], one
            assert len(sd.spans(f"{one} {one}")) > 0


def test_spans_cross_sentences():
    """A span has two sentences, or lies in one of over 40 words."""
    for seed in range(200):
        r = random.Random(seed)
        text = " ".join(" ".join(f"w{r.randrange(10**6)}" for _ in range(r.choice((3, 9, 18, 27, 60)))) + r.choice((".", "!", "?\n")) for _ in range(12))
        parts, whole = sd.sentences(text), re.split(r"(?<=[.!?])\s+", text)
        for i, k, _ in sd.spans(text):
            some = "".join(parts[i : i + k]).rstrip()
            assert re.search(r"[.!?]\s", some) or any(some in x and len(x.split()) > 40 for x in whole), some


def test_long_runs_of_marks_and_of_white_space():
    import time

    began = time.time()
    for text in ("." * 1_000_000, ".!?" * 300_000 + " x", " " * 1_000_000 + "x. y", "\n" * 500_000, "x" * 2_000_000, "w " * 500_000):
        assert "".join(sd.sentences(text)) == text
        sd.spans(text)
    assert time.time() - began < 20
