import gzip
import hashlib
import os
import re

import pytest
from pyspark.sql import functions as F

from lorekeep.llm import warc
from lorekeep.llm.common import new_path

PAGES = "page_id bigint, url string, html string"


def run(data, step=None):
    rows = list(warc.salvage(lambda at, n: data[at : at + n], len(data), "f"))
    return [x for k, x in rows if k == "record"], [(x["gap_start"], x["gap_stop"]) for k, x in rows if k == "gap"]


def rec(i, payload=b"some page text"):
    return warc.record(i, f"http://h/{i}", "response", payload, hashlib.sha256(payload).hexdigest(), len(payload), None)


@pytest.fixture(params=[True, False], ids=["members", "plain"])
def parts(request):
    z = [rec(i, f"payload of page {i} ".encode() * 50) for i in range(8)]
    return z if request.param else [gzip.decompress(x) for x in z]


def test_undamaged(parts):
    records, gaps = run(b"".join(parts))
    assert [r["page_id"] for r in records] == list(range(8)) and not gaps
    assert records[3]["payload"] == b"payload of page 3 " * 50
    assert (records[2]["start"], records[2]["stop"]) == (sum(map(len, parts[:2])), sum(map(len, parts[:3])))


@pytest.mark.parametrize("step", [64, 1 << 20])
def test_damage_in_the_middle(parts, step, monkeypatch):
    monkeypatch.setattr(warc, "STEP", step)
    at = [0]
    for p in parts:
        at.append(at[-1] + len(p))
    data = bytearray(b"".join(parts))
    mid = at[3] + len(parts[3]) // 2
    data[mid : mid + 4] = b"\xff\x00\xff\x00"
    records, gaps = run(bytes(data))
    assert [r["page_id"] for r in records] == [0, 1, 2, 4, 5, 6, 7] and gaps == [(at[3], at[4])]


def test_member_without_its_end():
    whole = b"".join(rec(i, os.urandom(400)) for i in range(3))
    records, gaps = run(whole[:-5])  # the record itself is whole, its digest holds
    assert [r["page_id"] for r in records] == [0, 1, 2] and not gaps
    records, gaps = run(whole[:-300])
    assert [r["page_id"] for r in records] == [0, 1] and gaps == [(records[1]["stop"], len(whole) - 300)]


def test_cut_ends_and_junk(parts):
    whole = b"".join(parts)
    cut = 5 if parts[0].startswith(b"WARC") else 25  # into the record itself
    records, gaps = run(whole[:-cut])
    assert [r["page_id"] for r in records] == list(range(7)) and gaps == [(len(whole) - len(parts[7]), len(whole) - cut)]
    records, gaps = run(whole[7:])
    assert [r["page_id"] for r in records] == list(range(1, 8)) and gaps == [(0, len(parts[0]) - 7)]
    junk = b"junk \x1f\x8b\x08 WARC/1.0 and more" * 9
    records, gaps = run(junk + parts[0] + junk + parts[1] + junk)
    n, a, b = len(junk), len(parts[0]), len(parts[1])
    assert [r["page_id"] for r in records] == [0, 1] and gaps == [(0, n), (n + a, 2 * n + a), (2 * n + a + b, 3 * n + a + b)]
    assert run(b"") == ([], []) and run(b"x") == ([], [(0, 1)])


def test_wrong_digest_is_damage():
    good = gzip.decompress(rec(1))
    bad = good.replace(b"some page", b"same page")
    records, gaps = run(bad + good)
    assert [r["page_id"] for r in records] == [1] and gaps == [(0, len(bad))]


def test_a_record_within_a_record_is_payload():
    inner = gzip.decompress(rec(5))
    records, gaps = run(gzip.decompress(rec(1, inner)) + gzip.decompress(rec(2)))
    assert [r["page_id"] for r in records] == [1, 2] and not gaps and records[0]["payload"] == inner


def test_long_payload(monkeypatch):
    monkeypatch.setattr(warc, "STEP", 1000)
    long = os.urandom(100_000)
    for part in (rec(1, long), gzip.decompress(rec(1, long))):
        records, gaps = run(part + part)
        assert [r["payload"] for r in records] == [long, long] and not gaps


@pytest.mark.parametrize("hold", [64, 64 << 20], ids=["streamed", "held"])
@pytest.mark.parametrize("members", [True, False])
def test_headers_and_blocks_of_any_size(members, hold, monkeypatch):
    monkeypatch.setattr(warc, "HOLD", hold)
    monkeypatch.setattr(warc, "INFLATE", 5000)
    long = os.urandom(300_000)
    url = "http://h/" + os.urandom(2_500_000).hex()
    wide = warc.record(1, url, "response", long, hashlib.sha256(long).hexdigest(), len(long), None)
    data = [x if members else gzip.decompress(x) for x in (wide, rec(2, long), rec(3))]
    records, gaps = run(b"".join(data))
    assert [(r["page_id"], r["payload"]) for r in records] == [(1, long), (2, long), (3, b"some page text")] and records[0]["url"] == url and not gaps
    # one member of all, of which the second fails
    raw = [gzip.decompress(x) for x in (wide, rec(2, long), rec(3))]
    raw[1] = raw[1][:-2000] + bytes(500) + raw[1][-1500:]
    bad = gzip.compress(b"".join(raw)) if members else b"".join(raw)
    records, gaps = run(bad + data[2])
    assert [r["page_id"] for r in records] == [1, 3, 3] and len(gaps) == 1


@pytest.mark.parametrize("hold", [64, 64 << 20], ids=["streamed", "held"])
@pytest.mark.parametrize("members", [True, False])
def test_records_within_a_long_block_that_fails_come_back(members, hold, monkeypatch):
    monkeypatch.setattr(warc, "HOLD", hold)
    monkeypatch.setattr(warc, "INFLATE", 700)
    inner = b"".join(gzip.decompress(rec(i, b"inner text " * 300)) for i in (7, 8))
    for fault in (lambda x: x.replace(b"junk", b"jun_"), lambda x: re.sub(rb"(X-Payload-Length.*\r\n(?:X-Page-ID.*\r\n)?)Content-Length: [0-9]+", rb"\1Content-Length: 99999999", x, count=1)):
        outer = fault(gzip.decompress(rec(1, b"junk " * 100 + inner)))
        whole = outer + gzip.decompress(rec(2))
        records, gaps = run(gzip.compress(whole) if members else whole)
        assert [r["page_id"] for r in records] == [7, 8, 2] and len(gaps) >= 1


def test_payloads_that_no_row_can_hold(monkeypatch):
    monkeypatch.setattr(warc, "ROW_BYTES", 1000)
    for n in (1000, 1001):
        (r,), gaps = run(rec(1, b"x" * n))
        assert not gaps and r["payload_bytes"] == n and r["payload_digest"] == hashlib.sha256(b"x" * n).hexdigest() and (r["payload"] is None) == (n > 1000)


def test_digests_of_public_archives():
    import base64

    body = b"some page text"

    def given(where, algorithm, form, broken=False):
        block = b"HTTP/1.1 200 OK\r\n\r\n" + body
        value = hashlib.new(algorithm, block if where == "Block" else body).digest()
        value = value.hex() if form == "hex" else base64.b32encode(value).decode()
        head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-{where}-Digest: {algorithm}:{value}\r\nContent-Length: {len(block)}\r\n\r\n".encode()
        return head + (block.replace(b"some", b"same") if broken else block) + b"\r\n\r\n"

    for where in ("Block", "Payload"):
        for algorithm in ("sha1", "sha256", "md5"):
            for form in ("hex", "base32"):
                records, gaps = run(given(where, algorithm, form))
                assert [r["payload"] for r in records] == [body] and not gaps
                assert run(given(where, algorithm, form, True)) == ([], [(0, len(given(where, algorithm, form)))])


def test_false_starts_within_a_long_header_cost_little():
    import time

    good = gzip.decompress(rec(1))
    data = b"WARC/1.0\r\n" + b"x: WARC/1.0\r\n" * 100_000
    began = time.time()
    for end in (b"no more\r\n", b"\r\n", b""):
        records, gaps = run(data + end + good)
        assert [r["page_id"] for r in records] == ([1] if end else []) or end == b""
    assert time.time() - began < 30


def test_members_of_several_records():
    raw = [gzip.decompress(rec(i, f"payload of page {i} ".encode() * 50)) for i in range(50)]
    one = gzip.compress(b"".join(raw))
    records, gaps = run(one + rec(99))
    assert [r["page_id"] for r in records] == [*range(50), 99] and not gaps
    assert records[-1]["start"] == len(one) == records[49]["stop"]
    raw[20] = raw[20].replace(b"page 20", b"page XX")
    records, gaps = run(gzip.compress(b"".join(raw)))
    assert [r["page_id"] for r in records] == [i for i in range(50) if i != 20] and len(gaps) == 1
    records, gaps = run(one[: len(one) * 2 // 3] + rec(99))
    ids = [r["page_id"] for r in records]
    assert ids[-1] == 99 and len(ids) > 20 and ids[:-1] == list(range(len(ids) - 1)) and len(gaps) == 1


def test_other_records_keep_their_block():
    head = lambda kind, block: f"WARC/1.1\r\nWARC-Type: {kind}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    records, gaps = run(head("resource", b"a\r\n\r\nb") + head("conversion", b"text") + head("warcinfo", b""))
    assert [(r["record_type"], r["payload"]) for r in records] == [("resource", b"a\r\n\r\nb"), ("conversion", b"text"), ("warcinfo", b"")] and not gaps


@pytest.mark.parametrize("members", [True, False])
def test_damage_costs_no_more_than_reading(members):
    import time

    parts = [rec(i, os.urandom(2500) + b"x" * 2500) for i in range(6000)]
    parts = parts if members else [gzip.decompress(x) for x in parts]
    whole, took = b"".join(parts), []
    bad = bytearray(whole)
    at = 0
    for i, p in enumerate(parts):
        if i % 60 == 7:
            bad[at + len(p) // 2] ^= 0xFF
        at += len(p)
    for data in (whole, bytes(bad)):
        began = time.time()
        records, gaps = run(data)
        took.append(time.time() - began)
    assert len(records) == 5900 and len(gaps) == 100
    assert took[1] < 3 * took[0] + 1, took


def test_a_length_that_lies_reads_nothing():
    good = gzip.decompress(rec(1))
    lie = re.sub(rb"Content-Length: [0-9]+", b"Content-Length: 1000000", good)
    asked = []

    def read(at, n, data=lie + good * 1000):
        asked.append(n)
        return data[at : at + n]

    rows = list(warc.salvage(read, len(lie + good * 1000)))
    assert sum(k == "record" for k, _ in rows) == 1000 and sum(k == "gap" for k, _ in rows) == 1


def pages(spark):
    big = "<p>same</p>" * 30
    rows = [(3, "u3", big), (1, "u1", big), (2, None, big), (4, "u4", "tiny"), (5, "u5", "tiny"), (6, "u6", None), (7, "é\r\nu", "é" * 60), (8, "u8", "é" * 60),
            (None, "u", big), (1, "u1", big), (9, "u9", "x" * 3_000_000)]
    return rows, spark.createDataFrame(rows, PAGES)


def test_round_trip(spark):
    rows, df = pages(spark)
    got = warc.archived_pages(df.withColumn("payload", F.lit(1)).withColumn("salt", F.lit(2))).collect()
    want = []
    for i, _, h in rows:
        p = (h or "").encode()
        first = min((j for j, _, g in rows if g == h and j is not None), default=None) if len(p) >= 100 else None
        ref = first if first is not None and first != i else None
        want.append((i, len(p), hashlib.sha256(p).hexdigest(), "response" if ref is None else "revisit", ref))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == sorted(want, key=str)
    assert warc.archived_pages(df.limit(0)).count() == 0


def test_damaged_archives(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"u{i}", f"page {i} " * 40) for i in range(200)], PAGES)
    folder = new_path(spark, "damaged")
    manifest = warc.write_archives(df.coalesce(2), folder)
    path = re.sub("^file:/+", "/", manifest.first().path)
    data = bytearray(open(path, "rb").read())
    data[len(data) // 2] ^= 0xFF
    open(path, "wb").write(data)
    files = warc.archive_files(spark, folder)
    assert files.agg(F.sum("bytes")).first()[0] == manifest.agg(F.sum("bytes")).first()[0]
    records, gaps = warc.read_archives(files).collect(), warc.read_archives(files, "gap").collect()
    assert len(records) == 199 and len(gaps) == 1
    assert all(r.payload.decode() == f"page {r.page_id} " * 40 for r in records)
    assert gaps[0].gap_start <= len(data) // 2 < gaps[0].gap_stop


def test_query(spark, sf):
    import duckdb

    from lorekeep.llm.queries import OP2_SQL, op2_warc_salvage

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = sorted(con.execute(OP2_SQL).fetchall(), key=str)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in op2_warc_salvage(spark, sf).collect()), key=str) == want
