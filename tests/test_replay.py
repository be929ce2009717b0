"""Replayed histories against plain loops."""

from collections import defaultdict, deque

from pyspark.sql import functions as F

from lorekeep.operators import signals as S
from lorekeep.plans import hive
from lorekeep.sources import bridge as B

SF = "/root/testdata/sf0.001"


def admitted(rows, limits):
    logs, out = defaultdict(lambda: [deque() for _ in limits]), {}
    for r in sorted(rows, key=lambda r: (r.identity, r.ts, r.event_id)):
        mine = logs[r.identity]
        for (s, _), log in zip(limits, mine, strict=True):
            while log and (r.ts - log[0]).total_seconds() >= s:
                log.popleft()
        ok = all(len(log) < n for (_, n), log in zip(limits, mine, strict=True))
        if ok:
            for log in mine:
                log.append(r.ts)
        out[r.event_id] = ok
    return out


def test_rate_limit(spark):
    log = B.audit_log(spark, SF).select("identity", "ts", "event_id")
    limits = ((6 * 3600, 3), (3600, 2))
    got = {r.event_id: r.allowed for r in S.rate_limited(log, limits).collect()}
    want = admitted(log.collect(), limits)
    assert got == want and 0 < sum(want.values()) < len(want)


def test_ring_replay(spark):
    pushes = hive.pushes(spark, SF).withColumn("memory_id", F.col("memory_id"))
    got = {(r.ring, r.memory_id): round(r.activation, 6) for r in S.ring_replayed(pushes, 5).collect()}
    want = {}
    for ring in sorted({r.ring for r in pushes.select("ring").distinct().collect()}):
        slots = {}
        for r in sorted((r for r in pushes.collect() if r.ring == ring), key=lambda r: (r.ts, r.memory_id)):
            if r.memory_id in slots:
                slots[r.memory_id] = (min(1.0, slots[r.memory_id][0] + 0.1), r.ts)
                continue
            if len(slots) >= 5:
                del slots[min(slots, key=lambda k: (slots[k][0] * 0.5 / (1 + (r.ts - slots[k][1]).total_seconds() / 86400), k))]
            slots[r.memory_id] = (0.5, r.ts)
        want |= {(ring, m): round(a, 6) for m, (a, _) in slots.items()}
    assert got == want
