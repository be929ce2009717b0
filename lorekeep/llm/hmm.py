"""A hidden Markov language model: latent states trained by Baum-Welch counts from all training texts, exact likelihoods.

Symbols are the most frequent words, an end mark, and classes of all other words by their last characters. A word of a class
has a share of the class in proportion to its count plus one, and each class keeps one part for words never seen; so the
model gives every text a probability, known words or not, and all probabilities sum to one.

Word counts come from all training texts. The words with the highest counts, ``DICTIONARY`` at most, go to every task; the
occurrences of other words meet their counts in a join, summed up per text first. Expected counts of an iteration are summed
over partitions in two rounds, so no task sees more than its share, and only the model itself (states x symbols) comes back to
the driver. The first iterations, on a bounded sample, only pick the place from which those over the whole corpus go on.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chains import Layout, chunks, expected_counts, forward
from .common import fold, written

#: Latent states; iterations over the sample and over the corpus; texts of the sample.
STATES, WARM_UP, PASSES, SAMPLE = 8, 10, 2, 1_000
#: Words that are symbols (of three occurrences at least), classes of other words, words whose counts go to every task.
SYMBOLS, CLASSES, DICTIONARY = 16_384, 1_024, 262_144
_BLOCK, _SALTS, _FLUSH, _MEMORY = 4_096, 32, 300_000, 300_000


def tokens(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered; the end mark is not among them."""
    return (text or "").encode("utf-8").lower().split()


def word_class(word: bytes) -> int:
    """Class of a word, by a hash of its last three characters; Spark's xxhash64 gives the same."""
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(word.decode("utf-8")[-3:].encode("utf-8"), 42) % CLASSES


def word_counts(texts: DataFrame) -> DataFrame:
    """(token, c) over all rows of ``texts`` (text)."""

    def run(batches):
        held: Counter = Counter()

        def rows():
            return pa.RecordBatch.from_pydict({"token": pa.array([w.decode("utf-8") for w in held], pa.string()), "c": pa.array(list(held.values()), pa.int64())})

        for b in batches:
            for lo in range(0, b.num_rows, 500):
                for text in b.column(0).slice(lo, 500).to_pylist():
                    held.update(tokens(text))
                if len(held) > _FLUSH:
                    yield rows()
                    held.clear()
        yield rows()

    return texts.select(F.col("text").cast("string")).mapInArrow(run, "token string, c bigint").groupBy("token").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """Counts that all texts share. ``rank`` numbers the dictionary; ``code`` is each dictionary word's symbol."""

    total: int  # training tokens, end marks included
    distinct: int
    ends: int
    rank: dict[bytes, int]
    log_count: np.ndarray  # log10(count + 1) by rank
    code: np.ndarray  # symbol by rank
    heads: int  # words that are symbols of their own
    share: np.ndarray  # of training tokens, by symbol
    log_mass: np.ndarray  # log10 of a class's summed counts plus one, by symbol; 0 for words
    least: int = 0  # words from this count on are in the dictionary
    _classes: dict[bytes, int] = field(default_factory=dict)

    @property
    def symbols(self) -> int:
        return self.heads + CLASSES + 1

    def class_of(self, word: bytes) -> int:
        if word not in self._classes:
            if len(self._classes) >= _MEMORY:
                self._classes.clear()
            self._classes[word] = self.heads + word_class(word)
        return self._classes[word]

    def __getstate__(self):
        return self.__dict__ | {"_classes": {}}


def vocabulary(counts: DataFrame, ends: int) -> Vocabulary:
    """The vocabulary of ``counts`` (token, c), ``ends`` texts having ended."""
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    # counts from which on there are few enough words: over a histogram of at most a few thousand steps
    steps = F.floor(F.log2("c") * 64).cast("int")
    hist = {r[0]: (r[1], r[2]) for r in counts.groupBy(steps).agg(F.count(F.lit(1)), F.min("c")).collect()}

    def least_for(most: int) -> int:
        n, least = 0, 2**62
        for k in sorted(hist, reverse=True):
            n += hist[k][0]
            if n > most:
                break
            least = hist[k][1]
        return least

    least, least_head = least_for(DICTIONARY), max(least_for(SYMBOLS), 3)
    rows = counts.where(F.col("c") >= least).collect()  # DICTIONARY rows at most
    rows.sort(key=lambda r: (-r.c, r.token))
    words, c = [r.token.encode("utf-8") for r in rows], np.array([r.c for r in rows], np.int64)
    heads = int((c >= least_head).sum())
    code = np.array([i if i < heads else heads + word_class(w) for i, w in enumerate(words)], np.int64)
    others = counts.where(F.col("c") < least_head).groupBy(F.pmod(F.xxhash64(F.expr("right(token, 3)")), F.lit(CLASSES)).cast("int").alias("k")).agg(F.sum("c"), F.count(F.lit(1)))
    share, mass = np.zeros(heads + CLASSES + 1), np.zeros(heads + CLASSES + 1)
    share[:heads], share[-1] = c[:heads], ends
    mass[heads:-1] = 1
    for k, n, m in others.collect():  # CLASSES rows at most
        share[heads + k] = n
        mass[heads + k] += n + m
    mass[:heads] = mass[-1] = 1
    share += 0.5
    return Vocabulary(total + ends, distinct + (ends > 0), ends, {w: i for i, w in enumerate(words)}, np.log10(c + 1.0), code, heads, share / share.sum(), np.log10(mass), least)


def encoded(docs: DataFrame, vocab: Vocabulary, held_out) -> DataFrame:
    """Per row: symbols as 16-bit numbers, sums over dictionary words, and the words that aren't in the dictionary."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(vocab)
    schema = f"doc_id {kind}, held_out boolean, n_tokens bigint, known bigint, logs double, head_logs double, codes binary, rare array<string>, times array<int>"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        v = shared.value
        get = v.rank.get
        end_known, end_log = int(v.ends > 0), math.log10(v.ends + 1)
        for b in batches:
            for lo in range(0, b.num_rows, 250):
                part = b.slice(lo, 250)
                out = {n: [] for n in names[2:]}
                for text in part.column(2).to_pylist():
                    words = tokens(text)
                    rank = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
                    codes = np.empty(len(words) + 1, np.int64)
                    known = rank >= 0
                    codes[:-1][known] = v.code[rank[known]]
                    rare = [words[i] for i in np.nonzero(~known)[0].tolist()]
                    codes[:-1][~known] = [v.class_of(w) for w in rare]
                    codes[-1] = v.symbols - 1
                    logs = v.log_count[rank[known]]
                    head = codes[:-1][known] < v.heads
                    seen = Counter(rare)
                    out["n_tokens"].append(len(codes))
                    out["known"].append(int(known.sum()) + end_known)
                    out["logs"].append(float(logs.sum()) + end_log)
                    out["head_logs"].append(float(logs[head].sum()) + end_log)
                    out["codes"].append(codes.astype("<u2").tobytes())
                    out["rare"].append([w.decode("utf-8") for w in seen])
                    out["times"].append(list(seen.values()))
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(out[n], k) for n, k in zip(names[2:], kinds, strict=True))], names=names)

    rows = docs.select("doc_id", held_out.alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
    return rows.withColumn("row", F.monotonically_increasing_id())


@dataclass
class Model:
    start: np.ndarray
    trans: np.ndarray
    emit: np.ndarray


def first_model(vocab: Vocabulary, seeds: list[np.ndarray], states: int) -> Model:
    """Each state leans to the symbols of a seed text, beside the corpus as a whole."""
    rng = np.random.default_rng(5)
    emit = np.tile(vocab.share, (states, 1)) * (1 + 0.1 * rng.random((states, vocab.symbols)))
    for k in range(min(states, len(seeds))):
        own = np.bincount(seeds[k], minlength=vocab.symbols) / len(seeds[k])
        emit[k] = 0.5 * emit[k] / emit[k].sum() + 0.5 * own
    emit /= emit.sum(1, keepdims=True)
    trans = np.full((states, states), 0.1 / max(states - 1, 1))
    np.fill_diagonal(trans, 0.9 if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), trans, emit)


def _sequences(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), "<u2").astype(np.int64) for x in column]


def improved(rows: DataFrame, model: Model, share: np.ndarray) -> tuple[Model, float]:
    """One Baum-Welch iteration over ``rows`` (codes); the log likelihood is that of ``model``."""
    k, c = model.emit.shape
    shared = rows.sparkSession.sparkContext.broadcast(model)
    size = 1 + k + k * k + k * c

    def count(batches):
        from pyspark import TaskContext

        m, total = shared.value, np.zeros(size)
        for b in batches:
            for part in range(0, b.num_rows, 2_500):
                like, first, moves, seen = expected_counts(_sequences(b.column(0).slice(part, 2_500)), m.start, m.trans, m.emit)
                total += np.concatenate([[like], first, moves.ravel(), seen.ravel()])
        blocks = np.split(total, range(_BLOCK, size, _BLOCK))
        salt = TaskContext.get().partitionId() % _SALTS
        yield pa.RecordBatch.from_pydict({"block": pa.array(range(len(blocks)), pa.int32()), "salt": pa.array([salt] * len(blocks), pa.int32()), "v": pa.array(blocks, pa.list_(pa.float64()))})

    def add(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        v = t.column("v").combine_chunks()
        total = np.zeros(len(v[0]))
        for x in v:
            total += x.values.to_numpy()
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "salt": pa.array([0], pa.int32()), "v": pa.array([total], pa.list_(pa.float64()))})

    kind = "block int, salt int, v array<double>"
    sums = rows.select("codes").mapInArrow(count, kind).groupBy("block", "salt").applyInArrow(add, kind).groupBy("block").applyInArrow(add, kind)
    total = np.zeros(size)
    for r in sums.select("block", "v").collect():
        total[r.block * _BLOCK : r.block * _BLOCK + len(r.v)] = r.v
    shared.unpersist()
    first, moves, seen = total[1 : 1 + k] + 0.1, total[1 + k : 1 + k + k * k].reshape(k, k) + 0.1, total[1 + k + k * k :].reshape(k, c)
    seen = seen + 50.0 * share  # so that no state rules a symbol out
    return Model(first / first.sum(), moves / moves.sum(1, keepdims=True), seen / seen.sum(1, keepdims=True)), float(total[0])


def trained(rows: DataFrame, vocab: Vocabulary, states: int = STATES, warm_up: int = WARM_UP, passes: int = PASSES) -> Model:
    """The model of ``rows`` (row, codes): a start from a sample of at most ``SAMPLE`` texts, then passes over all."""
    some = rows.select("row", F.xxhash64("row", F.lit(3)).alias("h")).orderBy("h", "row").limit(SAMPLE).select("row")
    sample = written(rows.join(F.broadcast(some), "row", "left_semi").select("codes").repartition(6), "sample")  # SAMPLE rows
    seeds = [np.frombuffer(r.codes, "<u2").astype(np.int64) for r in sample.orderBy(F.xxhash64("codes", F.lit(4))).limit(states).collect()]
    model = first_model(vocab, seeds, states)
    if seeds:
        for _ in range(warm_up):
            model, _ = improved(sample, model, vocab.share)
        for _ in range(passes):
            model, _ = improved(rows, model, vocab.share)
    return model


def log_likelihoods(rows: DataFrame, vocab: Vocabulary, model: Model) -> DataFrame:
    """Adds to ``rows`` ``symbol_logs``: log10 of the probability of its symbols, less the masses of its classes."""
    shared = rows.sparkSession.sparkContext.broadcast((model, vocab.log_mass))
    keep = [c for c in rows.columns if c not in ("codes", "rare", "times")]
    at = rows.columns.index("codes")

    def run(batches):
        m, mass = shared.value
        for b in batches:
            for lo in range(0, b.num_rows, 2_500):
                part = b.slice(lo, 2_500)
                seqs = _sequences(part.column(at))
                out = np.zeros(len(seqs))
                for c in chunks(np.array([len(s) for s in seqs])):
                    x = Layout([seqs[i] for i in c])
                    out[c] = forward(x, m.start, m.trans, m.emit)[2] / math.log(10) - np.bincount(x.seq, mass[x.obs], len(c))
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in keep), pa.array(out)], names=[*keep, "symbol_logs"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep) + ", symbol_logs double"
    return rows.mapInArrow(run, schema)


def language_scores(docs: DataFrame, folds: int = 7, held: int = 2, states: int = STATES, warm_up: int = WARM_UP, passes: int = PASSES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs`` (doc_id, text).

    Rows whose fold isn't ``held`` are learned from. base_score is the add-one unigram model's log10 probability, score the
    hidden Markov model's. Null and empty texts are their end mark; repeated rows count and come out each; a null id has the
    fold of the empty text; without training rows nothing is known and both scores still are log probabilities. An empty
    table gives no rows.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    held_out = fold("doc_id", folds) == held
    train = rows.where(~held_out)
    counts = written(word_counts(train), "counts")
    vocab = vocabulary(counts, train.count())
    data = written(encoded(rows, vocab, held_out), "encoded")
    model = trained(data.where("NOT held_out").select("row", "codes"), vocab, states, warm_up, passes)
    rare = data.where(F.size("rare") > 0).select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("token"), F.col("x.times").alias("times"))
    rare = rare.join(counts.where(F.col("c") < vocab.least), "token").groupBy("row").agg(F.sum("times").alias("rare_known"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("rare_logs"))
    out = log_likelihoods(data, vocab, model).join(rare, "row", "left")
    logs = F.col("logs") + F.coalesce("rare_logs", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).cast("bigint").alias("n_known"), F.lit(vocab.total).cast("bigint").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(math.log10(vocab.total + vocab.distinct + 1))).alias("base_score"), (F.col("symbol_logs") + logs - F.col("head_logs")).alias("score"),
    )
