"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels mark documents, so tokens are labelled first: in a bounded sample of labelled rows, a word or a prefix of words is a
sign of toxicity if, of the distinct contexts (the word with its neighbours) in which it stands, significantly more are in
toxic documents than chance gives; tokens of toxic documents that bear a sign are toxic. Contexts count once, so that copies don't make their words look toxic. The field has two states,
clear and toxic; its weights are those of signs per state, of transitions and of starts, fitted to the token labels by gradient
ascent on the regularised likelihood, the gradients being forward-backward expectations summed over partitions.

A document's raw score is the probability that any of its tokens is toxic, which the forward recursion gives exactly, with
the expected number of toxic tokens; a logistic fit on the sample turns them into the score.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chains import Layout, chunks, expected_counts, forward, posteriors
from .common import fold, written

#: Labelled rows used at most for words and the logistic fit, and for the field's weights; steps of the ascent; ridge.
SAMPLE, FIELD_SAMPLE, STEPS, RIDGE = 12_000, 2_000, 15, 1e-3
#: Toxic and clear rows of the sample of which contexts are counted at most; lengths of prefixes that may be signs, the
#: shortest first; words that a worker remembers at most.
CONTEXTS, PREFIXES, _MEMORY = (1_500, 3_000), (4, 5, 6), 400_000
_words = re.compile(r"\w+").findall
_spans = re.compile(r"\w+").finditer


class _Symbols(dict):
    """Symbols of words as they are met: of the word itself, its longest prefix that is a sign, or 0."""

    def __init__(self, signs: dict[str, int]):
        self.signs = signs

    def __missing__(self, word: str) -> int:
        low, signs = word.lower(), self.signs
        out = signs.get(low + "$", 0)
        if not out:
            for n in reversed(PREFIXES):
                out = signs.get(low[:n], 0) if len(low) >= n else 0
                if out:
                    break
        if len(self) >= _MEMORY:
            self.clear()
        self[word] = out
        return out


@dataclass
class Model:
    """The field and the logistic fit. ``symbols`` numbers the signs from 1, whole words ending in $; all else is symbol 0."""

    symbols: dict[str, int] = field(default_factory=dict)
    start: np.ndarray = field(default_factory=lambda: np.zeros(2))
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    emit: np.ndarray = field(default_factory=lambda: np.zeros((2, 1)))
    fit: np.ndarray = field(default_factory=lambda: np.array([0.0, 0.0, 0.0]))
    _memo: _Symbols | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_memo": None}

    def observed(self, text: str | None) -> np.ndarray:
        if self._memo is None:
            self._memo = _Symbols(self.symbols)
        words = _words(text or "")
        return np.fromiter(map(self._memo.__getitem__, words), np.int64, len(words))

    def features(self, seqs: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray | None]]:
        """(log-odds of any toxic token, log(1 + expected toxic tokens that bear a sign)) of each sequence, and marginals of
        those with a sign."""
        out, marginals = np.zeros((len(seqs), 2)), [None] * len(seqs)
        start, trans, emit = np.exp(self.start), np.exp(self.trans), np.exp(self.emit)
        known = np.array([len(s) > 0 and s.any() for s in seqs], bool)
        # without signs only the length counts: one chain of symbol 0 gives all lengths
        longest = max((len(s) for s, k in zip(seqs, known, strict=True) if not k), default=0)
        plain = [0.0]
        if longest:
            _, scale, _ = forward(Layout([np.zeros(longest, np.int64)]), start, trans, emit)
            plain = np.concatenate([[0.0], np.cumsum(np.log(scale))])
        total = np.zeros(len(seqs))
        for i in np.nonzero(~known)[0]:
            total[i] = plain[len(seqs[i])]
        numbers = np.nonzero(known)[0]
        for c in chunks(np.array([len(seqs[i]) for i in numbers])):
            x = Layout([seqs[numbers[j]] for j in c])
            a, scale, logs = forward(x, start, trans, emit)
            gamma, _ = posteriors(x, a, scale, trans, emit)
            for j, i in enumerate(numbers[c]):
                total[i], marginals[i] = logs[j], gamma[x.rows(j), 1]
                out[i, 1] = math.log1p(marginals[i][seqs[i] > 0].sum())
        for i, s in enumerate(seqs):
            n = len(s)
            clear = 0.0 if not n else self.start[0] + (n - 1) * self.trans[0, 0] + self.emit[0, s].sum() - total[i]
            p = -math.expm1(min(clear, -1e-12))
            out[i, 0] = min(12.0, max(-12.0, math.log(max(p, 1e-300)) - clear))
        return out, marginals

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.fit[0] + x @ self.fit[1:])))


def spans(text: str, marginals: np.ndarray | None, least: float = 0.5) -> list[tuple[int, int, float]]:
    """(start, end, probability) of runs of tokens whose toxic marginal is ``least`` or more, in code points."""
    out: list[tuple[int, int, float]] = []
    if marginals is None or not (marginals >= least).any():
        return out
    last = -2
    for i, m in enumerate(_spans(text)):
        if marginals[i] >= least:
            if i == last + 1:
                out[-1] = (out[-1][0], m.end(), max(out[-1][2], float(marginals[i])))
            else:
                out.append((m.start(), m.end(), float(marginals[i])))
            last = i
    return out


def _contexts(sample: DataFrame, only: set[str] | None) -> DataFrame:
    """(sign, contexts, docs) of the words and prefixes of ``sample``, or those of ``only``."""

    def run(batches):
        from xxhash import xxh64_intdigest

        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                rows: dict = {}
                for d, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    w = ["", *map(str.lower, _words(text or "")), ""]
                    for i in range(1, len(w) - 1):
                        signs = [w[i] + "$", *(w[i][:n] for n in PREFIXES if len(w[i]) >= n)]
                        signs = signs if only is None else [x for x in signs if x in only]
                        if signs:
                            c = xxh64_intdigest("\0".join(w[i - 1 : i + 2])) >> 1
                            for x in signs:
                                rows[x, c, d] = None
                keys = list(rows)
                yield pa.RecordBatch.from_pydict({"sign": [k[0] for k in keys], "context": [k[1] for k in keys], "doc": [k[2] for k in keys]})

    rows = sample.select("key", "text").mapInArrow(run, "sign string, context bigint, doc bigint")
    return rows.groupBy("sign", "context").agg(F.min("doc").alias("doc")).groupBy("sign").agg(F.count(F.lit(1)).alias("contexts"), F.count_distinct("doc").alias("docs"))


def _lower_bound(k: np.ndarray, n: np.ndarray, z: float = 1.96) -> np.ndarray:
    """Lower end of Wilson's interval of k of n."""
    p = k / n
    return (p + z * z / (2 * n) - z * np.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def toxic_signs(sample: DataFrame) -> list[str]:
    """Words (with a $) and prefixes whose share of contexts in toxic documents is, at the lower end of its interval, over
    halfway between the overall share and 1, in three toxic documents at least. Of a sign and its own beginnings the longer
    stays only where it tells clearly more."""
    some = lambda y: written(sample.where(F.col("toxic") == y).orderBy(F.xxhash64("key", F.lit(2)), "key").limit(CONTEXTS[1 - y]).repartition(8, "key"), "some")
    bad, good = some(1), some(0)
    toxic = {r.sign: r.contexts for r in _contexts(bad, None).where("docs >= 3 AND contexts >= 5").collect()}
    if not toxic:
        return []
    clear = {r.sign: r.contexts for r in _contexts(good, set(toxic)).collect()}
    signs = sorted(toxic, key=lambda x: (len(x), x))
    k = np.array([toxic[x] for x in signs], float)
    n = k + np.array([clear.get(x, 0) for x in signs], float)
    size = [x.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] for x in (bad, good)]
    share = size[0] / max(sum(size), 1)
    out: dict[str, float] = {}
    for x, low in zip(signs, _lower_bound(k, n).tolist(), strict=True):
        word = x.removesuffix("$")
        shorter = [out[word[:m]] for m in PREFIXES if m < len(x) and word[:m] in out]
        if low >= (1 + share) / 2 and all(low > s + 0.05 for s in shorter):
            out[x] = low
    return sorted(out)


def _gradient(model: Model, rows: DataFrame) -> np.ndarray:
    """Observed less expected counts, summed over partitions: starts, transitions, symbols by state."""

    def run(batches):
        total = np.zeros(6 + model.emit.size)
        for b in batches:
            seqs, marks = [], []
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = model.observed(text)
                if len(s):
                    seqs.append(s)
                    marks.append(((s > 0) & (toxic == 1)).astype(np.int64))
            _, first, moves, seen = expected_counts(seqs, np.exp(model.start), np.exp(model.trans), np.exp(model.emit))
            for s, y in zip(seqs, marks, strict=True):
                first[y[0]] -= 1
                np.subtract.at(moves, (y[:-1], y[1:]), 1)
                np.subtract.at(seen, (y, s), 1)
            total -= np.concatenate([first, moves.ravel(), seen.ravel()])
        yield pa.RecordBatch.from_pydict({"i": np.arange(len(total)), "v": total})

    sums = rows.select("text", "toxic").mapInArrow(run, "i bigint, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(6 + model.emit.size)
    for r in sums:
        out[r.i] = r.v
    return out


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge-regularised logistic regression by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (y - p) - 0.1 * w
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w)), g)
    return w


def train(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2) -> Model:
    """Fits the model to rows whose fold isn't ``held``. Rows labelled more than once are toxic if any label says so; texts
    that occur more than once count once."""
    chosen = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(fold("doc_id", folds) != held)
    chosen = chosen.groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # SAMPLE rows at most
    sample = written(sample.groupBy(F.xxhash64("text").alias("key")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")), "sample")
    rate = sample.agg(F.avg("toxic")).first()[0]
    model = Model()
    if rate is None or rate in (0.0, 1.0):  # nothing to tell apart
        rate = 0.0 if rate is None else rate
        model.fit[0] = math.log((rate + 1e-3) / (1 - rate + 1e-3))
        return model
    signs = toxic_signs(sample)
    model.symbols = {w: i + 1 for i, w in enumerate(signs)}
    model.emit = np.zeros((2, len(signs) + 1))
    rows = written(sample.orderBy(F.xxhash64("key", F.lit(1))).limit(FIELD_SAMPLE).repartition(8, "key"), "field_sample")
    n = rows.count()
    mean, square, size = 0.0, 0.0, 0.5
    for step in range(1, STEPS + 1):  # ascent with moment estimates
        w = np.concatenate([model.start, model.trans.ravel(), model.emit.ravel()])
        g = _gradient(model, rows) / n - RIDGE * w
        mean, square = 0.8 * mean + 0.2 * g, 0.9 * square + 0.1 * g * g
        w += size * (mean / (1 - 0.8**step)) / (np.sqrt(square / (1 - 0.9**step)) + 1e-8)
        model.start, model.trans, model.emit = w[:2].copy(), w[2:6].reshape(2, 2).copy(), w[6:].reshape(2, -1).copy()
    fitted = sample.select("text", "toxic").mapInArrow(_featured(model), "a double, b double, toxic int").collect()  # SAMPLE rows at most
    model.fit = _logistic(np.array([(r.a, r.b) for r in fitted]), np.array([r.toxic for r in fitted], float))
    return model


def _featured(model: Model):
    def run(batches):
        for b in batches:
            x, _ = model.features([model.observed(t) for t in b.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), b.column(1).cast(pa.int32())], names=["a", "b", "toxic"])

    return run


def scored(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted, toxic_spans) of each row of ``docs``; spans are start:end pairs in code points."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                texts = part.column(1).to_pylist()
                x, marginals = model.features([model.observed(t) for t in texts])
                score = model.scores(x)
                at = [",".join(f"{s}:{e}" for s, e, _ in spans(t or "", m)) for t, m in zip(texts, marginals, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(at, pa.string())], names=["doc_id", "score", "predicted", "toxic_spans"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double, predicted int, toxic_spans string")


def kept(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, as they are: null and empty texts have a score, repeated rows each
    stay or go, an empty table stays empty. Rows travel as structs, so that columns may have any name."""

    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                row = b.column(0).slice(lo, 1000)
                x, _ = model.features([model.observed(t) for t in row.flatten()[at].to_pylist()])
                yield pa.RecordBatch.from_arrays([row.filter(pa.array(model.scores(x) < threshold))], names=["row"])

    rows = docs.select(F.struct("*").alias("row"))
    return rows.mapInArrow(run, rows.schema).select("row.*")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted, toxic_spans) of every row of ``docs``.

    Null and empty texts have a score too; repeated rows each come out; rows with a null id are scored; without labels of
    both kinds every score is the rate of toxic labels. An empty table gives no rows.
    """
    rows = scored(docs, train(docs, labels), threshold)
    return rows.withColumn("held_out", fold("doc_id", 4) == 2).select("doc_id", "held_out", "score", "predicted", "toxic_spans")
