import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lorekeep.llm import packing

from .util import docs

PATH = public_tokenizers.path("word_bpe_49k.json")


def whole():
    return Tokenizer.from_file(PATH)


def laid_out(counts, capacity):
    """Items of a plan by bin: (offset, length); every item placed once."""
    bins, ranks = defaultdict(list), defaultdict(list)
    for length, r0, r1, first, each, at in packing.plan(counts, capacity):
        for r in range(r0, r1):
            bins[first + (r - r0) // each].append((at + (r - r0) % each * length, length))
            ranks[length].append(r)
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(c)) for k, c in counts.items() if c}
    return bins


def check_bins(bins, capacity):
    for items in bins.values():
        end = 0
        for at, length in sorted(items):
            assert at == end
            end += length
        assert end <= capacity


def best_fit(counts, capacity):
    gaps = []
    for n in sorted(counts, reverse=True):
        for _ in range(counts[n]):
            fit = min((g for g in gaps if g >= n), default=None)
            if fit is None:
                gaps.append(capacity - n)
            else:
                gaps.remove(fit)
                gaps.append(fit - n)
    return len(gaps)


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 40).flatmap(lambda c: st.tuples(st.just(c), st.dictionaries(st.integers(1, c), st.integers(0, 9)))))
def test_plan(case):
    capacity, counts = case
    bins = laid_out(counts, capacity)
    check_bins(bins, capacity)
    total = sum(k * v for k, v in counts.items())
    assert -(-total // capacity) <= len(bins) <= best_fit(counts, capacity) * 1.25 + 1
    assert set(bins) == set(range(len(bins)))


def test_plan_is_close_to_full():
    rng = np.random.default_rng(1)
    counts = Counter(np.minimum(4096, rng.lognormal(6.2, 1.2, 20_000).astype(int) + 1).tolist())
    bins = laid_out(counts, 4096)
    check_bins(bins, 4096)
    assert len(bins) <= 1.01 * -(-sum(k * v for k, v in counts.items()) // 4096)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab'sS tT\n\t\x0b\x1c\x85 _²½ªéÉßİıſKÅé中😀<|>9"), st.characters(max_codepoint=0x250, exclude_categories=["Cs"])), max_size=30))
def test_ids_are_the_librarys(text):
    assert packing.tokenizer(PATH).ids(text).tolist() == whole_ids(text)


_WHOLE = []


def whole_ids(text):
    _WHOLE or _WHOLE.append(whole())
    return _WHOLE[0].encode(text, add_special_tokens=False).ids


def test_known_words_are_bounded(monkeypatch):
    monkeypatch.setattr(packing, "_WORDS", 10)
    tok = packing.WordTokenizer(PATH)
    for i in range(30):
        text = " ".join(f"word{i * j}" for j in range(8))
        assert tok.ids(text).tolist() == whole_ids(text) and len(tok.known) <= 20


def test_each_piece_is_encoded_once():
    """Words are cut into pieces by the file's pattern; a piece goes to the model once, and texts with known words not at all."""
    tok, calls = packing.WordTokenizer(PATH), []
    model = tok.known.model
    tok.known.model = SimpleNamespace(tokenize=lambda p: (calls.append(p), model.tokenize(p))[1])
    texts = ["Over the hill, over", "hill hill, the-over", "it's ''s 'start O'Leary's 'RE we'll", "x2y 2x é2É, été. ½ª\x00\x7f²", "été ½x it's,"]
    for t in texts:
        assert tok.ids(t).tolist() == whole_ids(t)
    assert calls and len(calls) == len(set(calls))
    n = len(calls)
    assert tok.ids(" ".join(texts)).tolist() == whole_ids(" ".join(texts)) and len(calls) == n


def check(rows, given):
    """Against whole encodings: pieces, checksums, and sequences without gaps."""
    want = Counter()
    for i, t in given:
        ids = np.array([*whole_ids(t or ""), 1], dtype="<u4")
        for n, s in enumerate(range(0, len(ids), 4096)):
            want[i, n, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    check_bins(bins, 4096)
    return len(bins)


def test_documents(spark):
    given = list(enumerate(["", None, "short text", "The Long One " * 5000, "é" * 3, "<|endoftext|> kept", "x" * 20_000])) + [(2, "short text"), (2, "short text"), (None, "no id"), (None, None)]
    rows = packing.pack_documents(docs(spark, given).withColumn("piece", F.lit(9)).withColumn("length", F.lit("z")), PATH).collect()
    check(rows, given)
    assert packing.pack_documents(docs(spark, []), PATH).count() == 0
    r = packing.pack_documents(docs(spark, ["two words"]), PATH, with_ids=True).first()
    assert r.ids == [*whole_ids("two words"), 1]


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001"])
def test_query(spark, sf_dir):
    from lorekeep.llm.queries import op10_best_fit_packing

    given = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows = op10_best_fit_packing(spark, sf_dir).collect()
    n = check(rows, given)
    assert n <= 1.05 * -(-sum(r.length for r in rows) // 4096) + 1
