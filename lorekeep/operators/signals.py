"""The signal bus in batch form: emits with decay, waggles with quorum, stops with a threshold, nectar that ripens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import affect as A
from . import tables as T
from .replay import replayed

#: Fixed values of the rules.
EMITS, WAGGLES, QUORUM, SUPPRESS, RIPE, FAINT = 10, 20, 3, 2, 3, 0.05
#: Reasons in a row of ``stop_reasons``.
REASONS = 50


def active_emits(events: DataFrame, cap: int = EMITS) -> DataFrame:
    """The last emit of each (key, signal); of these the newest ``cap``."""
    return last_emits(events).orderBy(F.col("ts").desc(), "event_id").limit(cap)


def last_emits(events: DataFrame) -> DataFrame:
    last = F.max_by(F.struct("event_id", "intensity", "note", "ts", "expires_at"), F.struct("ts", "event_id"))
    return events.where("kind = 'emit'").groupBy("key", "signal").agg(last.alias("r")).select("key", "signal", "r.*")


def read_emits(emits: DataFrame, as_of: Column, faint: float = FAINT, include_decayed: bool = False) -> DataFrame:
    """Emits that haven't expired, with what decay leaves of them; faint ones are dropped."""
    now = emits.where(F.col("expires_at").isNull() | (F.col("expires_at") > as_of)).withColumn("now", A.signal_decay("intensity", "ts", as_of))
    return now if include_decayed else now.where(F.col("now") >= faint)


def waggles(events: DataFrame, cap: int = WAGGLES) -> DataFrame:
    """The active topics. ``cap`` holds for all of them together: past it the oldest topics without a quorum retire, those
    with one never do."""
    w = danced(events)
    first = w.orderBy(F.col("quorum").desc(), F.col("last").desc(), "key").limit(cap)  # fills up with the newest others
    return w.where("quorum").unionByName(first.where("NOT quorum"))


def retired(events: DataFrame, emits: int = EMITS, topics: int = WAGGLES) -> DataFrame:
    """(kind, key, event_id) of what the caps retire: emits that were the last of their kind, and topics without a quorum."""
    last = last_emits(events)
    newest = last.orderBy(F.col("ts").desc(), "event_id").limit(emits).select("event_id")
    old = last.join(F.broadcast(newest), "event_id", "left_anti").select(F.lit("emit").alias("kind"), "key", "event_id")  # ``emits`` rows
    stay = waggles(events, topics).where("NOT quorum").select("key")  # ``topics`` rows at most
    idle = danced(events).where("NOT quorum").join(F.broadcast(stay), "key", "left_anti")
    return old.union(idle.select(F.lit("waggle"), "key", F.lit(None).cast("bigint")))


def danced(events: DataFrame) -> DataFrame:
    """Per topic: dances, the largest intensity, the newest rationale that isn't null, and whether there is a quorum."""
    w = events.where("kind = 'waggle'").groupBy("key").agg(
        F.count(F.lit(1)).alias("dances"), F.max("intensity").alias("intensity"), F.max_by("note", F.when(F.col("note").isNotNull(), F.struct("ts", "event_id"))).alias("rationale"), F.max("ts").alias("last"))
    return w.withColumn("quorum", F.col("dances") >= QUORUM)


def stops(events: DataFrame) -> DataFrame:
    """Per pattern: stops, the last one's time, and whether it is suppressed. Counts combine before they shuffle."""
    s = events.where("kind = 'stop'").groupBy("key").agg(F.count(F.lit(1)).alias("stops"), F.max("ts").alias("last"))
    return s.withColumn("suppressed", F.col("stops") >= SUPPRESS)


def stop_reasons(events: DataFrame, page: int = REASONS) -> DataFrame:
    """(key, day, page, reasons): the reasons of each pattern and day in order, joined ``page`` at a time, so that no row grows
    with the history; pages in order give all of them."""
    notes = events.where("kind = 'stop' AND note IS NOT NULL").select("key", F.to_date("ts").alias("day"), "ts", "event_id", "note")
    nth = F.row_number().over(Window.partitionBy("key", "day").orderBy("ts", "event_id"))
    pages = notes.withColumn("page", F.floor((nth - 1) / page)).groupBy("key", "day", "page")
    ordered = F.sort_array(F.collect_list(F.struct("ts", "event_id", "note")))
    return pages.agg(F.array_join(F.transform(ordered, lambda x: x["note"]), " | ").alias("reasons"))


def stop_weights(events: DataFrame, memories: DataFrame) -> DataFrame:
    """Retrieval weights after stops: 0.3 less for each from the second of a pattern on, to a floor of 0.1."""
    w = Window.partitionBy("key").orderBy("ts", "event_id")
    from_second = events.where("kind = 'stop'").withColumn("n", F.row_number().over(w)).where(F.col("n") >= SUPPRESS)
    down = from_second.groupBy(F.col("target_memory_id").alias("id")).agg(F.count(F.lit(1)).alias("hits"))
    return memories.join(down, "id").withColumn("weight", F.greatest(F.lit(0.1), F.col("retrieval_weight") - 0.3 * F.col("hits"))).select("id", "hits", "weight")


def nectar(events: DataFrame) -> DataFrame:
    """Per essence: how often it came, the confidence that gives, and whether it is ready."""
    n = events.where("kind = 'nectar'").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    n = n.withColumn("confidence", F.when(F.col("n") == 1, 0.3).otherwise(F.least(F.lit(1.0), 0.3 + 0.15 * F.col("n"))))
    return n.withColumn("ready", (F.col("n") >= RIPE) & (F.col("confidence") >= 0.7))


def crystallised(ready: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Ready essences as memories: a type by signal, durable where that is a teaching."""
    kind = F.coalesce(*[F.when(F.col("signal") == k, v) for k, v in kinds.items()], F.lit("insight"))
    return ready.withColumn("memory_type", kind).withColumn("status", F.when(F.col("memory_type") == "teaching", "durable").otherwise("provisional"))


def hygiene(waggle: DataFrame, stop: DataFrame, as_of: Column) -> DataFrame:
    """Waggles idle for seven days without a quorum, and stops idle for fourteen, to be retired."""
    idle = lambda days: F.col("last") < as_of - F.make_dt_interval(F.lit(days))
    return waggle.where(idle(7) & ~F.col("quorum")).select(F.lit("waggle").alias("kind"), "key").union(stop.where(idle(14)).select(F.lit("stop"), "key"))


def hive_state(emits: DataFrame, waggle: DataFrame, stop: DataFrame, honey: DataFrame) -> DataFrame:
    """One row: sums of dances and stops, their ratio (0.5 if there are none), criticality, a temperature, the strongest of the decayed
    ``emits``, and seven counts."""
    e = emits.agg(F.count(F.lit(1)).alias("emits"), F.max_by(F.concat_ws(":", "key", "signal"), F.struct("now", "key", "signal")).alias("strongest"))
    w = waggle.agg(F.coalesce(F.sum("dances"), F.lit(0)).alias("dances"), F.count(F.lit(1)).alias("waggles"), T.count_if(F.col("quorum")).alias("quorums"))
    s = stop.agg(F.coalesce(F.sum("stops"), F.lit(0)).alias("stops"), F.count(F.lit(1)).alias("patterns"), T.count_if(F.col("suppressed")).alias("suppressed"))
    h = honey.agg(F.count(F.lit(1)).alias("essences"), T.count_if(F.col("ready")).alias("ready"))
    total, ratio, critical = F.col("dances") + F.col("stops"), F.col("ratio"), F.col("criticality")
    out = T.side_by_side(e, w, s, h).withColumn("ratio", F.when(total > 0, F.col("dances") / total).otherwise(0.5)).withColumn("criticality", 1 - 2 * F.abs(ratio - 0.5))
    idle = F.col("emits") + F.col("waggles") + F.col("patterns") == 0
    return out.withColumn("temperature", F.when(idle, "cold").when(critical > 0.8, "optimal").when(ratio > 0.7, "hot").when(ratio < 0.3, "cold").otherwise("stable"))


def strongest_per_signal(emits: DataFrame, least: float = 0.1) -> DataFrame:
    return emits.where(F.col("now") > least).groupBy("signal").agg(F.max_by("key", F.struct("now", "key")).alias("key"), F.max("now").alias("now"))


class _Admission:
    """Sliding logs of admitted requests; each holds its limit at most."""

    def __init__(self, limits):
        from collections import deque

        self.logs = [(s, n, deque()) for s, n in limits]

    def step(self, row):
        t = row.ts.timestamp()
        for s, _, log in self.logs:
            while log and t - log[0] >= s:
                log.popleft()
        ok = all(len(log) < n for _, n, log in self.logs)
        if ok:
            for *_, log in self.logs:
                log.append(t)
        return [(row.event_id, row.identity, ok)]

    def close(self, key):
        return []


def rate_limited(requests: DataFrame, limits: tuple[tuple[int, int], ...]) -> DataFrame:
    """Admission by sliding logs: a request passes if, for every (seconds, most), fewer than ``most`` of the identity's
    *admitted* requests lie in the last ``seconds``. ``requests`` has identity, ts, event_id.

    Admission feeds back, so this is no window. An identity's history is cut where it was silent for longer than the longest
    limit, as no state reaches across, and the stretches are replayed apart.
    """
    longest = max(s for s, _ in limits)
    span = longest * 1_000_000
    near = spanned(requests.select("identity", "ts", "event_id"), "identity", span)
    before = F.lag("_at").over(Window.partitionBy("identity", "_span").orderBy("_at", "event_id"))
    near = near.withColumn("_gap", F.coalesce(F.col("_at") - before >= span, F.lit(True)).cast("bigint")).where("_own")
    # stretches are numbered by the gaps up to a row: those of earlier spans, summed up per span, and those within its own
    gaps = near.groupBy("identity", "_span").agg(F.sum("_gap").alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy("identity").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1))  # a row a span
    gaps = gaps.select("identity", "_span", F.coalesce(earlier, F.lit(0)).alias("_before"))
    within = F.sum("_gap").over(Window.partitionBy("identity", "_span").orderBy("_at", "event_id"))
    cut = near.withColumn("_within", within).join(gaps, ["identity", "_span"]).select("identity", "ts", "event_id", (F.col("_before") + F.col("_within")).alias("stretch"))
    return replayed(cut, ["identity", "stretch"], ["ts", "event_id"], lambda: _Admission(limits), "event_id bigint, identity bigint, allowed boolean")


def spanned(rows: DataFrame, key: str, span: int) -> DataFrame:
    """``rows`` (key, ts, ...) dealt by key and span of ``span`` microseconds, so that no key's history is one group: each row
    stands in its own span (``_own``) and, for what looks back, in the next. ``_at`` is its time in microseconds."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    both = F.array(F.struct(F.lit(0).alias("d"), F.lit(True).alias("own")), F.struct(F.lit(1).alias("d"), F.lit(False).alias("own")))
    out = rows.withColumn("_at", at).withColumn("_s", F.explode(both))
    return out.withColumn("_span", F.floor(F.col("_at") / span) + F.col("_s.d")).withColumn("_own", F.col("_s.own")).drop("_s")


def recent_counts(rows: DataFrame, seconds: int) -> DataFrame:
    """``rows`` (identity, ts, ...) with ``recent``: the identity's rows of the last ``seconds``, itself included."""
    w = Window.partitionBy("identity", "_span").orderBy("_at").rangeBetween(-seconds * 1_000_000, 0)
    near = spanned(rows, "identity", seconds * 1_000_000)
    return near.withColumn("recent", F.count(F.lit(1)).over(w)).where("_own").drop("_at", "_span", "_own")


def cooldowns(log: DataFrame, failures: int = 10, seconds: int = 600, rest: int = 300) -> DataFrame:
    """Times from which an identity must rest: at its ``failures``-th refusal within ``seconds``."""
    bad = recent_counts(log.where("response_code >= 400"), seconds).where(F.col("recent") >= failures)
    return bad.select("identity", "event_id", "recent", (F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(rest))).alias("until"))


def ring_after(pushes: DataFrame, capacity: int = 30, start: float = 0.5, step: float = 0.1) -> DataFrame:
    """The ring after all pushes (memory_id, ts), taken as one history: the last ``capacity`` distinct memories by last push, each
    with 0.1 more for every push after its first, 1 at most."""
    r = pushes.groupBy("memory_id").agg(F.count(F.lit(1)).alias("pushes"), F.max("ts").alias("last_activated_at"))
    r = r.withColumn("activation", F.least(F.lit(1.0), start + step * (F.col("pushes") - 1)))
    return r.orderBy(F.col("last_activated_at").desc(), "memory_id").limit(capacity)


def snapshot(state: DataFrame, as_of: Column) -> DataFrame:
    """A row of the state log from ``hive_state``: what is kept of it, its counts as JSON."""
    counts = F.to_json(F.struct("emits", "waggles", "quorums", "patterns", "suppressed", "essences", "ready"))
    return state.select(as_of.alias("measured_at"), F.col("ratio").alias("waggle_stop_ratio"), F.col("strongest").alias("dominant_signal"),
                        F.col("temperature").alias("hive_temperature"), F.col("criticality").alias("criticality_score"), counts.alias("notes"))


class _Ring:
    """``capacity`` slots of (activation, last push)."""

    def __init__(self, capacity):
        self.capacity, self.slots = capacity, {}

    def step(self, row):
        m, t, slots = row.memory_id, row.ts, self.slots
        if m in slots:
            slots[m] = (min(1.0, slots[m][0] + 0.1), t)
            return []
        if len(slots) >= self.capacity:
            del slots[min(slots, key=lambda k: (slots[k][0] * 0.5 / (1 + (t - slots[k][1]).total_seconds() / 86400), k))]
        slots[m] = (0.5, t)
        return []

    def close(self, key):
        return [(key[0], m, a, t) for m, (a, t) in self.slots.items()]


def ring_replayed(pushes: DataFrame, capacity: int = 30) -> DataFrame:
    """Rings by replay of ``pushes`` (ring, memory_id, ts): a push lifts its memory by 0.1 or takes a slot, and when all are taken the
    slot of the least effective activation gives way."""
    return replayed(pushes, ["ring"], ["ts", "memory_id"], lambda: _Ring(capacity), "ring bigint, memory_id bigint, activation double, last_activated_at timestamp_ntz")
