import os
import random

import pytest

from lorekeep.operators import trigrams as T


def rows_of(spark, given):
    return spark.createDataFrame(given, "id bigint, text string, block string, row int, gram string")


@pytest.fixture(scope="module")
def given():
    r = random.Random(5)
    words = ["Der", "the", "ung", "Ärger", "x%y", "a_b", "new\nline", "\U0001d49c\U0001d49e z", "İstanbul", "quo"]
    out = [(i, " ".join(r.choice(words) for _ in range(r.randrange(1, 12))), "b", i, "g") for i in range(400)]
    out[77] = (77, "here stands one zyzzyva only", "b", 1, "g")
    out += [(500, None, "b", 1, "g"), (501, "", None, None, None), (502, "ab", "b", 1, "g"), (None, "no id but a ZYZZYVA", "b", 1, "g"), (3, "again three, quokka", "b", 1, "g"), (3, "again three, quokka", "b", 1, "g")]
    return [*out, (503, "w " * 200_000 + "the end", "b", 1, "g")]


@pytest.fixture(scope="module")
def index(spark, given):
    return T.build(rows_of(spark, given), "id", "text", blocks=64, buckets=8)


@pytest.mark.parametrize("part", ["the der", "ZYZZYVA", "x%y a", "_b", "ä", "", "ung the ung", "absent", "w\nl", "\U0001d49c\U0001d49e", "\U0001d49e z", "quokka", "the end", "ab", "ärg"])
def test_same_rows_as_a_scan(spark, given, index, part):
    scan = rows_of(spark, given).where(T.A.holds("text", part))
    got = index.holding(spark, part)
    assert got.columns == scan.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, scan.collect()))


def test_any_of_several(spark, given, index):
    got = {r.id for r in index.holding(spark, "zyzzyva", "quokka").collect()}
    assert got == {77, None, 3}
    assert index.holding(spark).count() == 0
    assert {r.id for r in index.holding(spark, "quokka", "ab").collect()} >= {3, 502}


def test_a_rare_word_reads_under_a_tenth(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    word = "zyzzyvax"
    planted = docs.selectExpr("doc_id", f"IF(doc_id = 5, concat(text, ' {word}'), text) AS text")
    index = T.build(planted, "doc_id", "text", blocks=128, buckets=8)
    root = index.path.removeprefix("file:")
    size = lambda d: sum(os.path.getsize(f"{d}/{f}") for f in os.listdir(d))
    all_ = sum(size(f"{root}/texts/{d}") for d in os.listdir(f"{root}/texts") if d.startswith("_block="))
    read = sum(size(f"{root}/texts/_block={b}") for b in index.blocks(spark, word))
    assert 0 < read < all_ / 10
    assert [r.doc_id for r in index.holding(spark, word).collect()] == [5]


def test_empty_table_and_clash(spark):
    empty = T.build(rows_of(spark, []), "id", "text")
    assert empty.holding(spark, "abc").count() == 0 and empty.holding(spark, "a").count() == 0
    with pytest.raises(ValueError):
        T.build(spark.range(3).selectExpr("id", "'x' AS text", "1 AS _block"), "id", "text")


def test_postings_of_a_group_hold_every_trigram_of_every_text():
    r = random.Random(8)
    texts = ["", "ab", "abc", "aaaa", "\U0001d49c\U0001d49e z", *("".join(r.choices("abcä \U0001f600\n", k=r.randrange(60))) for _ in range(80))]
    wide = ["".join(map(chr, range(0x4E00, 0x9000))), "".join(map(chr, range(0xAC00, 0xD700))), *("".join(map(chr, range(0x10000 + 30_000 * k, 0x10000 + 30_000 * (k + 1)))) for k in range(30))]
    for group in (texts, wide):  # the second is cut in halves: its signs and texts are too many for one number
        got = {}
        for named, at in T.postings(group):
            for g, x in zip(named.tolist(), at, strict=True):
                assert not (mine := set(T._places(x).tolist())) & got.get(g, set())
                got.setdefault(g, set()).update(mine)
        some = range(len(group)) if group is texts else (0, 15, len(group) - 1)
        for k in some:
            assert all(k in got[g] for g in T.grams(group[k]))
        if group is texts:
            assert got == {g: {k for k in range(len(group)) if g in T.grams(group[k])} for t in group for g in T.grams(t)}


def test_long_texts_come_in_pieces_of_one_group():
    import pyarrow as pa

    long = "x" * (T.CHARS - 1) + "needle" + "y" * (T.CHARS + 5)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 1, 2, 2]), pa.array(["short", long, "other", "last"])], names=["block", "text"])
    got = list(T._groups([batch, batch]))
    assert sum(len(p) > T.CHARS + 2 for *_, g in got for p in g) == 0
    of = [(b, n) for b, n, g in got if any("x" * 9 in t or "y" * 9 in t for t in g)]
    assert len(of) == 6 and len(set(of)) == 2
    for one in set(of):
        assert {g for b, n, group in got if (b, n) == one for t in group for g in T.grams(t)} == set(T.grams(long))
    assert len({n for b, n, g in got if "short" in g or "other" in g} | {n for _, n in of}) == 6 and all(len({b for b, n, _ in got if n == k}) == 1 for k in range(6))


def test_texts_are_indexed_once_however_many_memories_have_them(spark, sf, monkeypatch):
    from lorekeep.plans import retrieval

    made = []
    build = T.build
    monkeypatch.setattr(T, "build", lambda *a, **b: (made.append(build(*a, **b)), made[-1])[1])
    assert retrieval.q5c(spark, sf).count() == 25
    assert made[0].texts(spark).count() == spark.read.parquet(f"{sf}/documents.parquet").count() < spark.read.parquet(f"{sf}/events.parquet").count()


def test_one_posting_for_a_trigram_in_a_whole_group_of_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    index = T.build(docs, "doc_id", "text", blocks=4, buckets=2)
    posted = spark.read.parquet(f"{index.path}/postings")
    assert posted.count() == posted.select("part", "gram").distinct().count() < sum(len(T.grams((r.text or "").lower())) for r in docs.collect()) / 5
