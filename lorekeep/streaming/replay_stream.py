"""Histories whose steps depend on earlier outcomes, as streams: admission by sliding logs, and activation rings.

Rows wait in their key's state until the watermark has passed them, and are then replayed in order of time and id; so any cut of
the input into batches gives what the batch replay gives, as long as no row comes later than the watermark allows. State is a key's
waiting rows and what its rule remembers, which is bounded: admitted requests of the longest limit, the slots of a ring.

A session that runs these streams needs the RocksDB state store (``STATE_STORE``).
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

#: The setting that these streams need.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_DAY = 86_400_000_000
#: Waiting rows in one entry of a key's state.
CHUNK = 10_000


class _Replay(StatefulProcessor):
    """Rows (at, number) of a key wait for the watermark; ``step`` is given those that it has passed, in order.

    They wait in chunks, one entry of the state each, which are read only when the timer tells that some are due."""

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("chunks", "rows binary")
        self.due = handle.getValueState("due", "at bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [(r[2], r[3]) for r in rows]  # key, ts, at, number
        self.waiting.appendList(_chunks(new))
        self._wake(min(at for at, _ in new) // 1000 + 1)  # those that wait already have their timer
        return iter(())

    def _wake(self, at: int) -> None:
        """One timer a key, in milliseconds."""
        now = self.due.get()
        if now is not None:
            if now[0] <= at:
                return
            self.handle.deleteTimer(now[0])
        self.due.update((at,))
        self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        every = sorted(x for c in self.waiting.get() for x in pickle.loads(c[0]))
        ready, rest = [x for x in every if x[0] <= mark], [x for x in every if x[0] > mark]
        self.due.clear()
        if rest:
            self.waiting.put(_chunks(rest))
        else:
            self.waiting.clear()
        out, forget = self.step(key, ready, mark)
        wake = [rest[0][0]] if rest else []
        wake += [forget] if forget is not None else []
        if wake:
            self._wake(max(min(wake) // 1000 + 1, mark // 1000 + 1))
        return iter(out)

    def step(self, key, rows: list[tuple[int, int]], mark: int) -> tuple[list[Row], int | None]:
        """Rows to emit, and the time in microseconds from which the rule's memory can go, if it has any."""
        raise NotImplementedError


def _chunks(rows: list[tuple[int, int]]) -> list[tuple[bytes]]:
    return [(pickle.dumps(rows[lo : lo + CHUNK]),) for lo in range(0, len(rows), CHUNK)]


class Admission(_Replay):
    """A request passes if, for every (seconds, most), fewer than ``most`` admitted ones lie in the last ``seconds``."""

    def __init__(self, limits: tuple[tuple[int, int], ...]):
        self.limits = [(s * 1_000_000, n) for s, n in limits]

    def init(self, handle) -> None:
        super().init(handle)
        self.admitted = handle.getListState("admitted", "at bigint")

    def step(self, key, rows, mark):
        longest = max(s for s, _ in self.limits)
        log = [x[0] for x in self.admitted.get()]
        out, answer = [], Row("event_id", "identity", "allowed")
        for at, number in rows:
            ok = all(sum(at - t < s for t in log) < n for s, n in self.limits)
            if ok:
                log = [t for t in log if at - t < longest] + [at]
            out.append(answer(number, key[0], ok))
        log = [t for t in log if mark - t < longest]
        if log:
            self.admitted.put([(t,) for t in log])
        else:
            self.admitted.clear()
        return out, (log[-1] + longest if log else None)


class Ring(_Replay):
    """``capacity`` slots: a push lifts its memory by 0.1, 1 at most, or takes a slot with 0.5; when all are taken the slot of the
    least effective activation gives way. After every replay the ring's slots come out, numbered by the time of their last push."""

    def __init__(self, capacity: int = 30):
        self.capacity = capacity

    def init(self, handle) -> None:
        super().init(handle)
        self.slots = handle.getMapState("slots", "memory_id bigint", "activation double, at bigint")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.slots.updateValue((initialState.memory_id,), (initialState.activation, initialState.at))

    def step(self, key, rows, mark):
        slots = {k[0]: v for k, v in self.slots.iterator()}
        had = set(slots)
        for at, memory in rows:
            if memory in slots:
                slots[memory] = (min(1.0, slots[memory][0] + 0.1), at)
                continue
            if len(slots) >= self.capacity:
                del slots[min(slots, key=lambda k: (slots[k][0] * 0.5 / (1 + (at - slots[k][1]) / _DAY), k))]
            slots[memory] = (0.5, at)
        for memory in had - set(slots):
            self.slots.removeKey((memory,))
        for memory, (activation, at) in slots.items():
            self.slots.updateValue((memory,), (activation, at))
        last = max((at for _, at in slots.values()), default=0)
        return [Row(ring=key[0], version=last, memory_id=m, activation=float(a), at=at) for m, (a, at) in sorted(slots.items())] if rows else [], None


def admissions(requests: DataFrame, limits: tuple[tuple[int, int], ...], late: str) -> DataFrame:
    """(event_id, identity, allowed) of a stream of ``requests`` (identity, ts timestamp, event_id), each once the watermark, ``late``
    behind the newest row, has passed it."""
    rows = requests.withWatermark("ts", late).select("identity", "ts", F.unix_micros("ts").alias("at"), F.col("event_id").alias("number"))
    return rows.groupBy("identity").transformWithState(Admission(limits), "event_id bigint, identity bigint, allowed boolean", "Append", "EventTime")


def rings(pushes: DataFrame, late: str, capacity: int = 30, start: DataFrame | None = None) -> DataFrame:
    """(ring, version, memory_id, activation, at) of a stream of ``pushes`` (ring, memory_id, ts timestamp): a ring's slots each time
    that some of its pushes were replayed; ``newest_rings`` picks the last. ``start`` (ring, memory_id, activation,
    last_activated_at) is what the rings hold at first, as ``signals.ring_replayed`` gives it."""
    rows = pushes.withWatermark("ts", late).select("ring", "ts", F.unix_micros("ts").alias("at"), F.col("memory_id").alias("number"))
    first = None
    if start is not None:
        first = start.select("ring", "memory_id", "activation", F.unix_micros(F.col("last_activated_at").cast("timestamp")).alias("at")).groupBy("ring")
    return rows.groupBy("ring").transformWithState(Ring(capacity), "ring bigint, version bigint, memory_id bigint, activation double, at bigint", "Append", "EventTime", first)


def arrived(rows: DataFrame, number: str, closing: tuple, make, folder: str, slices: int = 4, jitter: int = 6 * 3600) -> DataFrame:
    """What the stream ``make(rows)`` has given once ``rows`` (key, ts timestamp, ``number``) came in, in ``slices`` out of order by up to
    ``jitter`` seconds, and after them a row with a late time, ``closing``, that lets the watermark pass them all.

    The stream is started anew for every slice, from its checkpoint; its results are files that it writes once.
    """
    spark = rows.sparkSession
    shifted = F.unix_seconds("ts") + F.pmod(F.xxhash64(number), F.lit(jitter))
    low, high = rows.agg(F.min(shifted), F.max(shifted)).first()
    wide = max(1, ((high or 0) - (low or 0)) // slices + 1)
    last = spark.createDataFrame([closing], rows.schema)
    before = spark.conf.get(STATE_STORE[0], None)
    spark.conf.set(*STATE_STORE)
    try:
        for k in range(slices + 1):
            part = rows.where(F.floor((shifted - F.lit(low)) / wide) == k) if k < slices else last
            part.write.mode("append").parquet(f"{folder}/in")
            out = make(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"))
            run = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
            run.awaitTermination()
    finally:
        spark.conf.set(STATE_STORE[0], before) if before else spark.conf.unset(STATE_STORE[0])
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


def newest_rings(versions: DataFrame) -> DataFrame:
    """The slots of every ring in its last version."""
    last = versions.groupBy("ring").agg(F.max("version").alias("version"))
    return versions.join(last, ["ring", "version"]).select("ring", "memory_id", "activation", F.timestamp_micros("at").alias("last_activated_at")).distinct()
