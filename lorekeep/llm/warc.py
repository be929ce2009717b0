"""WARC archives: a writer with revisit records and a reader that salvages what it can from damaged files.

Archives are gzip files of one member a record. Executors write and read them under a shared folder through Arrow's file
systems, so any store that Arrow knows will do. A file is read by one task as a stream; the writer bounds files in size. After
a failed check (member, version line, header, length or digest) the reader searches for the next byte at which a member or a
version line begins and passes its checks, goes on from there, and reports the bytes it left out.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, shuffle_partitions, written

#: Payloads below this size are always written whole. Bytes after which a file is closed, and bytes read at a time.
MIN_REVISIT, FILE_BYTES, STEP = 100, 32 << 20, 1 << 20
#: Bytes inflated at a time; bytes of a block that is held while it is checked; bytes of a payload that a row can hold: of longer
#: ones size and digest are given, the payload is null.
INFLATE, HOLD, ROW_BYTES = 4 << 20, 64 << 20, 1 << 30
_SALTS = 16
_MAGIC, _VERSION = b"\x1f\x8b\x08", b"WARC/1."
_VERSION_LINE = re.compile(rb"WARC/1\.[0-9]\r\n")
_NAME = re.compile(rb"([!#$%&'*+\-.^_`|~0-9A-Za-z]+)[ \t]*(:)?")
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.")
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
RECORD = "record_type string, page_id bigint, refers_to bigint, url string, payload_bytes bigint, payload_digest string, payload binary, path string, start bigint, stop bigint"
GAP = "path string, gap_start bigint, gap_stop bigint, reason string"


def record(page_id: int | None, url: str, kind: str, payload: bytes, digest: str, size: int, refers_to: int | None, serial: str = "") -> bytes:
    """One record as a gzip member; revisits carry no payload but its digest and size. ``serial`` tells equal rows apart."""
    block = _HTTP + payload if kind == "response" else _HTTP
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {digest} {serial}')}>",
        f"WARC-Target-URI: {re.sub(r'[\r\n]', ' ', url)}", "WARC-Date: 2024-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"X-Payload-Length: {size}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if kind == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers_to is not None:
            head.append(f"X-Refers-To-Page-ID: {refers_to}")
    raw = "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode("utf-8", "replace") + block + b"\r\n\r\n"
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


class Damage(Exception):
    """A check that a record failed."""


class Head:
    """A record's header, read line by line as its bytes come. ``read`` bytes of it are done; a start within its first ``doomed``
    bytes fails as it did."""

    def __init__(self):
        self.read, self.looked, self.doomed, self.fields, self.length = 0, 0, 0, {}, None

    def more(self, raw: bytes, at: int) -> int | None:
        """Reads on in ``raw``, which holds the record from ``at``. The length of the block, which begins ``read`` bytes after
        ``at``; None if the header may go on past ``raw``."""
        if self.length is not None:
            return self.length
        if not self.read:
            if not _VERSION_LINE.match(raw, at):
                if len(raw) - at < 10 and (_VERSION.startswith(raw[at:]) or raw.startswith(_VERSION, at)):
                    return None
                raise Damage("no version line")
            self.read = 10
        while True:
            begin = at + self.read
            end = raw.find(b"\r\n", max(begin, at + self.looked))
            if end == begin:
                self.read += 2
                self.length = self._length()
                return self.length
            name = _NAME.match(raw, begin, end if end >= 0 else len(raw))
            if not (name and name[2]) and not (end < 0 and (raw[begin : begin + 2] in (b"", b"\r") or name and name.end() == len(raw))):
                self.doomed = self.read
                raise Damage("header line without a colon")
            if end < 0:
                self.looked = max(self.read, len(raw) - at - 1)
                return None
            self.fields[name[1].decode("latin-1").lower()] = raw[name.end() : end].strip().decode("utf-8", "replace")
            self.read = end + 2 - at

    def _length(self) -> int:
        try:
            length = int(self.fields["content-length"])
        except (KeyError, ValueError):
            length = -1
        if length < 0:
            self.doomed = self.read
            raise Damage("bad length")
        try:
            for k in ("x-page-id", "x-refers-to-page-id", "x-payload-length"):
                self.fields[k] = int(self.fields[k]) if k in self.fields else None
        except ValueError:
            raise Damage("bad number in header") from None
        return length


class Digest:
    """A digest as headers give it (``sha1:`` and its like, in hex or base32). Other forms aren't checked: ``known`` is false."""

    def __init__(self, text: str):
        name, _, self.value = text.partition(":")
        name, self.value = name.strip().lower().replace("-", ""), self.value.strip()
        self.sum = hashlib.new(name) if name in ("md5", "sha1", "sha256", "sha512") else None
        self.base32 = self.value.rstrip("=").upper()  # padding would make md5's as long as its hex form
        size = self.sum.digest_size if self.sum else 0
        self.hex = len(self.base32) == 2 * size
        self.known = bool(size) and (self.hex or len(self.base32) == -(-8 * size // 5))

    def differs(self) -> bool:
        if self.hex:
            return self.value.lower() != self.sum.hexdigest()
        return self.base32 != base64.b32encode(self.sum.digest()).decode().rstrip("=")


class Block:
    """A record's block, checked piece by piece. The payload is held if asked for and no longer than a row can be."""

    def __init__(self, fields: dict, payloads: bool):
        self.fields, self.kind = fields, fields.get("warc-type", "")
        self.whole, self.given = Digest(fields.get("warc-block-digest", "")), Digest(fields.get("warc-payload-digest", ""))
        self.own, self.size, self.payload = hashlib.sha256(), 0, bytearray() if payloads else None
        self.before = b"" if self.kind in ("response", "request") else None  # the end of what was seen of the HTTP header

    def feed(self, data: bytes) -> None:
        if self.whole.known:
            self.whole.sum.update(data)
        if self.before is not None:
            data = self.before + data
            end = data.find(b"\r\n\r\n")
            if end < 0:
                self.before = data[-3:]
                return
            self.before, data = None, data[end + 4 :]
        self.size += len(data)
        self.own.update(data)
        if self.given.known:
            self.given.sum.update(data)
        if self.payload is not None:
            self.payload += data
            if self.size > ROW_BYTES:
                self.payload = None

    def done(self) -> dict:
        """The record; Damage if a digest differs. The payload's counts only where the block has none: tools differ in whether
        chunked bodies are decoded for it."""
        if self.whole.known and self.whole.differs():
            raise Damage("block digest differs")
        f = self.fields
        if self.kind == "revisit":
            payload, size, digest = None, f["x-payload-length"], f.get("warc-payload-digest", "").removeprefix("sha256:")
        else:
            if self.given.known and not self.whole.known and self.given.differs():
                raise Damage("payload digest differs")
            payload, size, digest = self.payload, self.size, self.own.hexdigest()
        return {
            "record_type": self.kind, "page_id": f["x-page-id"], "refers_to": f["x-refers-to-page-id"], "url": f.get("warc-target-uri"),
            "payload_bytes": size, "payload_digest": digest or None, "payload": None if payload is None else bytes(payload),
        }


def of_member(inflated: Callable[[int], Iterator[bytes]], payloads: bool = True) -> Iterator[tuple[str, object]]:
    """("record", ...) and ("bad", reason) of one member, in order; ``inflated(n)`` gives its bytes after the first n. What fails a
    check is passed over up to the next version line. Blocks of up to ``HOLD`` bytes are held, longer ones are checked as they come;
    if such a one fails, the member is inflated again to search within it."""
    chunks, base, total = inflated(0), 0, None  # base: where raw begins in the member; total: its size, once that is known
    raw, last, head = bytearray(), False, None
    while not last:
        chunk = next(chunks, None)
        last = chunk is None
        raw += chunk or b""
        if last:
            total = base + len(raw)
        at = 0
        while at < len(raw):
            if head is None:
                if raw[at] in b"\r\n":
                    at += 1
                    continue
                head = Head()
            streamed, after = False, None
            try:
                length = head.more(raw, at)
                if length is None:
                    if not last:
                        break
                    raise Damage("header not ended")
                stop = at + head.read + length
                if total is not None and base + stop + 4 > total:
                    raise Damage("block cut short")
                if len(raw) < stop + 4 and length <= HOLD:
                    break
                block = Block(head.fields, payloads)
                if len(raw) < stop + 4:
                    streamed, left, after = True, length, bytearray()
                    for piece in chain([bytes(raw[at + head.read :])], chunks):
                        block.feed(piece[:left])
                        after += piece[left:]
                        left -= min(left, len(piece))
                        if len(after) >= 4:
                            break
                    else:
                        total = base + stop - left + len(after)
                        raise Damage("block cut short")
                else:
                    block.feed(bytes(raw[at + head.read : stop]))
                    after = raw[stop : stop + 4]
                if after[:4] != b"\r\n\r\n":
                    raise Damage("record not ended")
                rec = block.done()
            except Damage as e:
                yield "bad", str(e)
                past, head = at + max(1, head.doomed), None
                if streamed:
                    base, raw, at, last = base + past, bytearray(), 0, False
                    chunks = inflated(base)
                    break
                found = raw.find(_VERSION, past)
                at = found if found >= 0 else len(raw) if last else max(past, len(raw) - len(_VERSION) + 1)
                continue
            yield "record", rec
            head, at = None, stop + 4
            if streamed:
                base, raw, at = base + at, after[4:], 0
        del raw[:at]
        base += at


def salvage(read: Callable[[int, int], bytes], size: int, path: str = "", payloads: bool = True) -> Iterator[tuple[str, dict]]:
    """("record", ...) and ("gap", ...) of a file of ``size`` bytes, of which ``read(at, n)`` gives up to n from ``at``.

    Gaps are byte ranges without a valid record, with the first check that failed there. Records of one gzip member all have its
    range. A buffer of a few ``STEP`` or ``HOLD`` and one header are held, and the payload if ``payloads``; headers and blocks may have
    any size. Work is linear in the file and in the inflated members, whatever is damaged, but for what a false start costs: its
    block, or a member's bytes up to its first bad one.
    """
    buffer, base, doomed = b"", 0, (0, "")

    def hold(pos: int, n: int) -> int:
        """Makes the buffer hold n bytes from pos, fewer at the end of the file; returns where they begin in it."""
        nonlocal buffer, base
        if pos < base or pos + n > base + len(buffer):
            keep = buffer[pos - base :] if base <= pos <= base + len(buffer) else b""
            buffer, base = keep + read(pos + len(keep), max(n - len(keep), STEP)), pos
        return pos - base

    def plain(pos: int) -> tuple[dict, int]:
        nonlocal doomed
        if pos < doomed[0]:
            raise Damage(doomed[1])
        n, head, length = 4096, Head(), None
        try:
            while True:
                i = hold(pos, n)
                length = head.more(buffer[i : i + n], 0)
                if length is not None:
                    break
                if pos + n >= size:
                    head.doomed = head.read and size - pos
                    raise Damage("header not ended")
                n *= 4
        except Damage as e:
            doomed = (pos + head.doomed, str(e))
            raise
        start = pos + head.read
        if start + length + 4 > size:
            raise Damage("block cut short")
        if read(start + length, 4) != b"\r\n\r\n":  # before the block is read
            raise Damage("record not ended")
        block = Block(head.fields, payloads)
        for k in range(0, length, STEP):
            i, n = hold(start + k, min(STEP, length - k)), min(STEP, length - k)
            block.feed(buffer[i : i + n])
        return block.done(), head.read + length + 4

    def member(pos: int) -> Iterator[tuple[str, object, int]]:
        """("record", ..., bytes used so far), ("bad", reason, ...), and ("end", None, length) or ("broken", reason, ...)."""
        used, broken, seen = 0, None, False

        def inflated(skip):
            nonlocal used, broken
            z, used, broken, n = zlib.decompressobj(31), 0, None, 8192
            while not z.eof:
                i = hold(pos + used, n)
                got = buffer[i : i + n]
                if not got:
                    broken = "member cut short"
                    return
                try:
                    out = z.decompress(got, INFLATE)
                    while z.unconsumed_tail and not z.eof:  # at the end the tail is what follows the member
                        if len(out) > skip:
                            yield out[skip:]
                        skip -= min(skip, len(out))
                        out = z.decompress(z.unconsumed_tail, INFLATE)
                except zlib.error:
                    broken = "bad gzip member"
                    return
                used += len(got) - len(z.unused_data)
                n = min(2 * n, STEP)
                if len(out) > skip:
                    yield out[skip:]
                skip -= min(skip, len(out))

        for kind, x in of_member(inflated, payloads):
            if kind == "bad" and x == "no version line" and used <= 8192 and not seen:
                yield "broken", "member holds no record", used
                return
            seen = True
            yield kind, x, used
        yield ("broken", broken, used) if broken else ("end", None, used)

    at, bad, why = 0, None, ""
    while at < size:
        i = hold(at, 8)
        got, past, fault = [], at, None
        if buffer.startswith(_MAGIC, i):
            for kind, x, used in member(at):
                if kind == "record":
                    if got:
                        yield "record", got.pop() | {"path": path, "start": at, "stop": past}
                    elif bad is not None:
                        yield "gap", {"path": path, "gap_start": bad, "gap_stop": at, "reason": why}
                        bad = None
                    got.append(x)
                    past = at + used
                elif kind == "end":
                    past = at + used
                else:
                    fault = fault or x
            ended = kind == "end"
            if got:
                yield "record", got.pop() | {"path": path, "start": at, "stop": past}
                if fault and ended:  # records were lost within the member
                    yield "gap", {"path": path, "gap_start": at, "gap_stop": past, "reason": f"within a member: {fault}"}
                if ended:
                    at = past
                    continue
                bad, why = past, fault
        else:
            try:
                rec, length = plain(at)
            except Damage as e:
                fault = str(e)
            else:
                if bad is not None:
                    yield "gap", {"path": path, "gap_start": bad, "gap_stop": at, "reason": why}
                    bad = None
                yield "record", rec | {"path": path, "start": at, "stop": at + length}
                at += length
                continue
        if bad is None:
            bad, why = at, fault or "member holds no record"
        # the next byte where a member or a version line may begin
        at += 1
        while at < size:
            n = min(STEP, size - at)
            i = hold(at, n)
            m = _START.search(buffer, i, i + n)
            if m:
                at = base + m.start()
                break
            at += max(1, n - len(_VERSION) + 1)
        bad = min(bad, at)
    if bad is not None and bad < size:
        yield "gap", {"path": path, "gap_start": bad, "gap_stop": size, "reason": why}


def _opened(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else re.sub(r"^file:/*", "file:///", uri) if uri.startswith("file:") else f"file://{uri}")


def with_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, refers_to): of equal payloads of ``min_bytes`` or more, those
    after the one with the smallest page_id refer to it. Rows with a null page_id refer to it too and are never referred to;
    a repeated page_id refers to none.

    Digests are counted without the payloads. Those that occur more than once meet the pages again over salted keys, so that
    no payload's pages gather in one task."""
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("bigint")).withColumn("payload_digest", F.sha2("payload", 256))
    first = (
        rows.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 AND first IS NOT NULL").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)))).drop("n")
    )
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(_SALTS)).cast("int"))
    joined = salted.join(first, ["payload_digest", "salt"], "left")
    return joined.withColumn("refers_to", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))).drop("salt", "first")


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """Writes a record per row of ``pages`` (page_id, url, html) into archives under ``folder``; returns their manifest
    (path, records, bytes), itself written to the shared folder. A file gets its name, which is its attempt's own, once it is
    whole; files of attempts that were lost are in no manifest."""

    def run(batches):
        import os

        from pyspark import TaskContext

        ctx = TaskContext.get()
        fs, root = _opened(folder)
        fs.create_dir(root, recursive=True)
        name, n, k, out, count, size = "", 0, 0, None, 0, 0

        def closed():
            out.close()
            final = f"part-{ctx.partitionId():06d}-{ctx.taskAttemptId()}-{n:04d}.warc.gz"
            fs.move(f"{root}/{name}", f"{root}/{final}")
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{final}"], "records": [count], "bytes": [size]})

        for b in batches:
            for r in b.to_pylist():
                if out is None:
                    name = f"_open-{ctx.partitionId()}-{ctx.taskAttemptId()}-{os.getpid()}-{n}"
                    out = fs.open_output_stream(f"{root}/{name}")
                kind = "revisit" if r["refers_to"] is not None else "response"
                data = record(r["page_id"], r["url"] or "", kind, r["payload"], r["payload_digest"], r["payload_bytes"], r["refers_to"], f"{ctx.partitionId()} {k}")
                k += 1
                out.write(data)
                count, size = count + 1, size + len(data)
                if size >= FILE_BYTES:
                    yield closed()
                    out, count, size, n = None, 0, 0, n + 1
        if out is not None:
            yield closed()

    rows = with_revisits(pages, min_bytes).select("page_id", "url", "payload", "payload_digest", "payload_bytes", "refers_to")
    return written(rows.mapInArrow(run, "path string, records bigint, bytes bigint"), "manifest")


def read_archives(files: DataFrame, what: str = "record", with_payload: bool = True) -> DataFrame:
    """Records (``what="record"``) or quarantined byte gaps (``what="gap"``) of ``files`` (path, bytes)."""
    schema = RECORD if what == "record" else GAP
    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
    arrow = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")])

    def batch(rows):
        return pa.RecordBatch.from_pylist([{k: x.get(k) for k in arrow.names} for x in rows], schema=arrow)

    def run(batches):
        rows, held = [], 0
        for b in batches:
            for r in b.to_pylist():
                fs, path = _opened(r["path"])
                with fs.open_input_file(path) as f:

                    def read(at, n, f=f, size=r["bytes"]):
                        f.seek(min(at, size))
                        return f.read(n)

                    for kind, x in salvage(read, r["bytes"], r["path"], what == "record" and with_payload):
                        if kind != what:
                            continue
                        rows.append(x)
                        held += len(x.get("payload") or b"")
                        if len(rows) >= 2000 or held >= 4 << 20:
                            yield batch(rows)
                            rows, held = [], 0
        if rows:
            yield batch(rows)

    # one file a task, as far as hashing spreads them
    n = max(4 * files.sparkSession.sparkContext.defaultParallelism, shuffle_partitions(files.sparkSession))
    return files.select("path", "bytes").repartition(n, "path").mapInArrow(run, schema)


def archive_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes) of the archives in a folder, for readers without a manifest; contents aren't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(folder).select("path", F.col("length").alias("bytes"))


def archived_pages(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` to archives in the shared folder and reads them back: one row per record.

    Null html is an empty payload, null urls empty ones; repeated rows and null ids give records of their own; an empty
    table gives no archive and no rows.
    """
    folder = new_path(pages.sparkSession, "warc")
    manifest = write_archives(pages, folder)
    rows = written(read_archives(manifest, with_payload=False).drop("payload"), "records")
    wrote, found = manifest.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0], rows.count()
    if wrote != found:
        raise RuntimeError(f"{wrote} records were written, {found} could be read")
    return rows
