import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.llm import hmm

from .util import docs


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def check_base(rows, given):
    """Counts and base scores by the formula; end marks are tokens of the kind None."""
    train = Counter()
    for i, t in given:
        if not held(i):
            train.update([*words(t), None])
    n, v = sum(train.values()), len(train)
    want = []
    for i, t in given:
        seen = [train[w] for w in [*words(t), None]]
        want.append((i, held(i), len(seen), sum(c > 0 for c in seen), n, round(sum(math.log10((c + 1) / (n + v + 1)) for c in seen), 6)))
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)


def corpus(n=300, seed=0):
    """Two languages, and words met once."""
    rng = np.random.default_rng(seed)
    tongues = [[f"{a}{b}" for a in "klmn" for b in "aei"], [f"{a}{b}us" for a in "prst" for b in "ou"]]
    return [" ".join([str(rng.choice(tongues[i % 2])) for _ in range(int(rng.integers(3, 60)))] + [f"Rare{rng.integers(1e6)}us"] * (i % 3)) for i in range(n)]


@pytest.mark.parametrize("dictionary", [6, 262_144])
def test_base_and_rare_words(spark, monkeypatch, dictionary):
    monkeypatch.setattr(hmm, "DICTIONARY", dictionary)
    monkeypatch.setattr(hmm, "SYMBOLS", 4)
    given = list(enumerate(corpus(60))) + [(900, None), (901, ""), (902, " "), (903, "ka " * 30_000), (4, "ka ei"), (4, "ka ei"), (None, "Ka KA unknownword"), (904, "É é É")]
    df = docs(spark, given).withColumn("codes", F.lit(1)).withColumn("row", F.lit("x")).withColumn("score", F.lit(0))
    check_base(hmm.language_scores(df, states=3, warm_up=1, passes=1).collect(), given)


def test_empty_and_untrained(spark):
    assert hmm.language_scores(docs(spark, [])).count() == 0
    only = next(i for i in range(100) if held(i))
    given = [(only, "nothing to learn from")]
    check_base(hmm.language_scores(docs(spark, given)).collect(), given)


def setup(spark, texts):
    df = docs(spark, texts)
    counts = hmm.word_counts(df)
    vocab = hmm.vocabulary(counts, len(texts))
    return vocab, hmm.encoded(df, vocab, F.lit(False))


def test_class_hash_is_sparks(spark):
    given = ["a", "abc", "wörter", "xyz€", "日本語文"]
    rows = spark.createDataFrame([(w,) for w in given], "w string").select("w", F.pmod(F.xxhash64(F.expr("right(w, 3)")), F.lit(hmm.CLASSES)).alias("k")).collect()
    assert {r.w: r.k for r in rows} == {w: hmm.word_class(w.encode()) for w in given}


def test_likelihood_rises_and_forward_is_exact(spark):
    texts = corpus()
    vocab, rows = setup(spark, texts)
    rows = rows.cache()
    model = hmm.first_model(vocab, [np.frombuffer(r.codes, "<u2").astype(int) for r in rows.limit(2).collect()], 2)
    likes = []
    for _ in range(6):
        model, like = hmm.improved(rows.select("codes"), model, vocab.share)
        likes.append(like)
    assert likes[-1] > likes[1] > likes[0]
    assert np.allclose(model.trans.sum(1), 1) and np.allclose(model.emit.sum(1), 1) and np.isclose(model.start.sum(), 1)
    got = {r.doc_id: r.symbol_logs for r in hmm.log_likelihoods(rows, vocab, model).collect()}
    for r in rows.limit(20).collect():
        obs = np.frombuffer(r.codes, "<u2").astype(int)
        a = model.start * model.emit[:, obs[0]]
        total = 0.0
        for o in obs[1:]:
            total += math.log10(a.sum())
            a = (a / a.sum()) @ model.trans * model.emit[:, o]
        total += math.log10(a.sum()) - vocab.log_mass[obs].sum()
        assert np.isclose(got[r.doc_id], total)
    rows.unpersist()


def test_symbols_share_out_all_probability(spark):
    """Each class's words and one unseen word have the class's whole share."""
    vocab, _ = setup(spark, corpus())
    mass = Counter()
    for w, i in vocab.rank.items():
        if vocab.code[i] >= vocab.heads:
            mass[vocab.code[i]] += 10 ** vocab.log_count[i]
    for k in range(vocab.heads, vocab.symbols - 1):
        assert np.isclose(mass[k] + 1, 10 ** vocab.log_mass[k])


def test_held_out_texts_score_above_the_base(spark):
    rows = hmm.language_scores(docs(spark, corpus()), states=4).collect()
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_query(spark, sf):
    from lorekeep.llm.queries import op7_hidden_markov_lm

    given = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows = op7_hidden_markov_lm(spark, sf).collect()
    check_base(rows, given)
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
