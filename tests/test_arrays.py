"""JSON arrays cut at elements, at any size of a block, against Python's own reader."""

import json
import random

from pyspark.sql import functions as F

from lorekeep.sources import arrays as A
from lorekeep.sources import bridge as B
from lorekeep.sources import exports as X

ODD = ['}', '{"', "]},{", '\\', '\\"', "é😀\n\t", "", 'a"b', "\\\\}", "[[", "plain text " * 20]


def values(df):
    return sorted((json.dumps(json.loads(r.value), sort_keys=True) for r in df.collect()))


def test_any_cut_gives_the_elements(spark, tmp_path):
    r = random.Random(2)
    some = lambda d=0: {r.choice(ODD): r.choice([r.choice(ODD), r.randrange(99), None, [r.choice(ODD), {"x": r.choice(ODD)}], some(d + 1) if d < 3 else {}]) for _ in range(r.randrange(4))}
    files = {"compact": json.dumps([some() for _ in range(60)], separators=(",", ":")), "indented": json.dumps([some() for _ in range(40)], indent=2, ensure_ascii=False), "one": json.dumps([{"long": "{" * 3000, "then": "}" * 3000}]),
             "empty": "[]", "nothing": "", "mixed": json.dumps(["a}", 1, None, [1, {"a": "]"}], {"b": "["}, True]), "ends": json.dumps([some() for _ in range(9)]) + "\n \n"}
    want = []
    for name, text in files.items():
        (tmp_path / f"{name}.json").write_text(text)
        want += [json.dumps(x, sort_keys=True) for x in (json.loads(text) if text else []) if isinstance(x, dict | list)]
    path = str(tmp_path / "*.json")
    before, cost = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        for size in (97, 256, 1500, 1 << 20):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            found = A.elements(spark, path)
            assert values(found) == sorted(want), size
            if size == 97:
                assert A._fragments(spark, path).rdd.getNumPartitions() > 100
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)


def test_export_equals_the_reader_of_whole_files(spark, sf, tmp_path):
    turns = B.transcripts(spark, sf)
    path = str(tmp_path / "export")
    X.write_export(turns, path, array=True)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = X.read_export(spark, path)
        assert got.rdd.getNumPartitions() > 1
        rows = sorted((r.conv_id, r.turn, r.role, r.text) for r in got.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    whole = spark.read.schema(X.EXPORT).json(path, multiLine=True).select(F.col("uuid").alias("conv_id"), F.posexplode("chat_messages").alias("turn", "m"))
    assert rows == sorted((r.conv_id, r.turn, "user" if r.m.sender == "human" else r.m.sender, r.m.text) for r in whole.collect()) and len(rows) == turns.count()


def test_cutter_and_sums_agree():
    """Two parts of a text, cut anywhere that isn't within an escape: the second's beginning is what the first's sums say."""
    text = json.dumps([{"a": "}{\"\\", "b": [1, {"c": "]"}]}, {"d": "x" * 5}])
    for k in range(1, len(text)):
        if text[k - 1] == "\\" and (len(text[:k]) - len(text[:k].rstrip("\\"))) % 2:
            continue
        q, up, _ = A.summed(text[:k])
        one, two = A.Cutter(False, 0), A.Cutter(q % 2 == 1, up)
        pieces = [*one.feed(text[:k]), *([one.rest()] if one.rest() else []), *two.feed(text[k:])]
        joined, parts = [], ""
        for kind, value in pieces:
            parts = value if kind in ("tail", "whole") else parts + value
            if kind in ("whole", "head"):
                joined.append(json.loads(parts))
        assert joined == json.loads(text), (k, pieces)
