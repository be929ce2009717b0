import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from lorekeep.llm import toxicity as tx

from .util import docs

LABELS = "doc_id bigint, quality int, toxic int"


def corpus(n=400, seed=1):
    """Toxic documents hold bad words or words of a bad stem; a copied clean-worded toxic document misleads."""
    r = random.Random(seed)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "pu") for b in ("ra", "so", "ti", "vu", "xe", "zo")]
    texts, toxic = [], []
    for i in range(n):
        w = r.choices(words, k=r.randint(5, 60))
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                w.insert(r.randint(0, len(w)), r.choice(["VILE", "rotten!", "grimbo" + r.choice(["ra", "so", "ti"])]))
        texts.append(" ".join(w))
        toxic.append(int(bad))
    copied = " ".join(["innocent", "harmless", "flower"] * 5)
    texts += [copied] * 60
    toxic += [1] * 60
    return texts, toxic


def labelled(spark, toxic):
    return spark.createDataFrame([(i, 0, t) for i, t in enumerate(toxic)], LABELS)


def test_held_out_accuracy_and_spans(spark):
    texts, toxic = corpus()
    rows = {r.doc_id: r for r in tx.toxicity(docs(spark, texts), labelled(spark, toxic)).collect()}
    for i in range(len(texts)):
        assert rows[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= rows[i].score <= 1 and rows[i].predicted == (rows[i].score >= 0.3)
    held = [i for i in range(400) if rows[i].held_out]
    assert np.mean([rows[i].predicted == toxic[i] for i in held]) > 0.97
    bad = ("vile", "rotten", "grimbo")
    for i in held:
        for s in filter(None, rows[i].toxic_spans.split(",")):
            a, b = map(int, s.split(":"))
            assert any(w in texts[i][a:b].lower() for w in bad)
        if toxic[i]:
            assert rows[i].toxic_spans


def test_signs_come_from_diverse_contexts(spark):
    texts, toxic = corpus()
    sample = spark.createDataFrame([(hash(t) % 2**40 + i, t, y) for i, (t, y) in enumerate(zip(texts, toxic, strict=True))], "key bigint, text string, toxic int")
    signs = tx.toxic_signs(sample)
    assert {s[:4] for s in signs} == {"vile", "rott", "grim"}


def test_plain_lengths_match_the_chain():
    m = tx.Model({"bad": 1}, np.array([1.0, -1.0]), np.array([[1.0, -1.0], [-0.5, 0.5]]), np.array([[1.0, -2.0], [-1.0, 2.0]]), np.array([0.0, 1.0, 1.0]))
    a, _ = m.features([np.zeros(n, np.int64) for n in (0, 1, 2, 7, 40)])
    for n, row in zip((1, 2, 7, 40), a[1:], strict=True):
        x = tx.Layout([np.zeros(n, np.int64)])
        _, _, logs = tx.forward(x, np.exp(m.start), np.exp(m.trans), np.exp(m.emit))
        clear = m.start[0] + (n - 1) * m.trans[0, 0] + n * m.emit[0, 0] - logs[0]
        assert np.isclose(row[0], np.clip(np.log(-np.expm1(clear)) - clear, -12, 12))
    assert a[0, 0] == -12


def test_odd_tables(spark):
    none = labelled(spark, [])
    assert tx.toxicity(docs(spark, []), none).count() == 0
    rows = tx.toxicity(docs(spark, ["a b", None, ""]), none).collect()
    assert len({r.score for r in rows}) == 1 and all(r.predicted == 0 for r in rows)
    texts, toxic = corpus(100)
    given = list(enumerate(texts)) + [(900, None), (901, ""), (901, ""), (None, "rotten vile"), (902, "vile " * 40_000)]
    labels = labelled(spark, toxic).union(spark.createDataFrame([(1, None, None), (None, None, 1), (0, 0, 0), (0, 0, 1)], LABELS))
    df = docs(spark, given).withColumn("score", F.lit("x")).withColumn("toxic", F.lit(1)).withColumn("key", F.lit(1))
    rows = tx.toxicity(df, labels).collect()
    assert len(rows) == len(given)
    by = {r.doc_id: r for r in rows}
    assert by[900].score == by[901].score < 0.3 and by[902].predicted == 1 and by[None].predicted == 1


def test_query(spark):
    from lorekeep.llm.queries import op5_toxicity_crf

    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in op5_toxicity_crf(spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = [i for i in labels if rows[i].held_out]
    assert np.mean([rows[i].predicted == labels[i] for i in held]) > 0.9
