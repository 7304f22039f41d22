"""Stateful streams: token buckets, leases, stale events and heartbeats.

Events of a key wait in state, in buckets of event time, until the watermark
has passed their bucket's end. Then a timer wakes the key and the bucket's
events are taken in order of event time. So the result doesn't depend on how
events are dealt to files and micro-batches, as long as they come within the
watermark's delay, and a task holds one bucket of one key, or of one group of
keys, at a time. Besides, a key keeps a few numbers; a state that has ended is
cleared.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: What a step of a key makes of an event: (state before, event) -> (state after, rows).
Step = Callable[[list, tuple], tuple[list, list[tuple]]]


#: Seconds of a bucket.
BUCKET = 86_400


def never(state: list) -> int | None:
    """States without an end."""
    return None


class InOrder(StatefulProcessor):
    """Takes the events (key, us, event_id, ...) of each key in order, a bucket at a time, behind the watermark.

    Keys come in groups that share buckets, timers and the calls to the state
    store, which cost far more than an event of a key with few. ``ends`` tells
    when a state ends, in microseconds of event time; ``over`` makes the rows of
    that end, which come when the bucket that holds it is over. An event at the
    end or later finds no state.
    """

    def __init__(self, columns: list[str], out: list[str], bucket_s: int, start: list, step: Step, ends: Callable[[list], int | None] = never, over: Callable[[list], list[tuple]] = lambda s: []):
        self.columns, self.out, self.bucket_ms, self.start, self.step, self.ends, self.over = columns, out, bucket_s * 1000, start, step, ends, over

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "bucket long", "events string")
        self.state = handle.getValueState("state", "now string")

    def until(self, us: int) -> int:
        """The end of a time's bucket, in milliseconds."""
        return (us // 1000 // self.bucket_ms + 1) * self.bucket_ms

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found: dict[int, list] = {}
        for some in rows:
            keys = some["keyed"].astype(object)
            for k, r in zip(keys.where(keys.notna(), None), some[self.columns].astype(object).values.tolist()):
                found.setdefault(self.until(r[0]), []).append([k, *r])
        for end, events in found.items():
            held = self.waiting.getValue((end,))[0][:-1] + "," if self.waiting.containsKey((end,)) else "["
            self.waiting.updateValue((end,), (held + json.dumps(events)[1:],))
            self.handle.registerTimer(end)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        bucket, made = expiredTimerInfo.getExpiryTimeInMs(), []
        events: dict[str | None, list[tuple]] = {}
        if self.waiting.containsKey((bucket,)):
            for k, *e in json.loads(self.waiting.getValue((bucket,))[0]):
                events.setdefault(k, []).append(tuple(e))
            self.waiting.removeKey((bucket,))
        states: dict[str | None, list] = dict(json.loads(self.state.get()[0])) if self.state.exists() else {}
        waits: dict[int, bool] = {}
        for k in [*states, *(k for k in events if k not in states)]:
            now, rows = states.pop(k, None), []
            for e in sorted(events.get(k, [])):
                if now is not None and (end := self.ends(now)) is not None and end <= e[0]:
                    rows += self.over(now)
                    now = None
                now, more = self.step(list(self.start) if now is None else now, e)
                rows += more
            end = None if now is None else self.ends(now)
            if end is not None:
                # Nothing of the group waits before the end's bucket is over: then the end is near for good.
                over = self.until(end)
                if over not in waits:
                    waits[over] = any(self.waiting.containsKey((b,)) for b in range(bucket + self.bucket_ms, over + 1, self.bucket_ms))
                if end < bucket * 1000 or not waits[over] and over <= timerValues.getCurrentWatermarkInMs():
                    rows, now = rows + self.over(now), None
            if now is not None:
                states[k] = now
            made += [(k, *r) for r in rows]
        for over in {self.until(end) for now in states.values() if (end := self.ends(now)) is not None}:
            if not waits[over]:
                self.handle.registerTimer(over)
        if not states:
            self.state.clear()
        else:
            self.state.update((json.dumps(list(states.items())),))
        if made:
            yield pd.DataFrame(made, columns=["keyed", *self.out[1:]])

    def close(self) -> None:
        pass


def group_of(key: str, groups: int | None) -> Column:
    """The group of a key: one of so many by hash, or each key by itself."""
    return F.col(key).cast("string") if groups is None else F.pmod(F.xxhash64(key), F.lit(groups))


def in_order(events: DataFrame, key: str, columns: list[str], delay: str, bucket_s: int, groups: int | None, out: str, *how) -> DataFrame:
    """``InOrder`` over a stream with ``us``, microseconds of event time; ``out`` is the result's schema, which begins with the key."""
    late = events.withColumn("_ts", F.timestamp_micros("us")).withWatermark("_ts", delay)
    late = late.withColumns({"keyed": F.col(key).cast("string"), "_group": group_of(key, groups)})
    fields = [c.split() for c in out.split(", ")]
    names = [name for name, _ in fields]
    found = late.groupBy("_group").transformWithStateInPandas(InOrder(columns, names, bucket_s, *how), ", ".join(["keyed string", *out.split(", ")[1:]]), "Append", "EventTime")
    return found.select(F.col("keyed").cast(fields[0][1]).alias(names[0]), *names[1:])


def take(tokens: float, last: float | None, now: float, cost: float, rate: float, burst: float) -> tuple[float, bool]:
    """A token bucket after a request; time that goes backwards refills nothing."""
    tokens = burst if last is None else min(burst, tokens + max(0.0, now - last) * rate)
    return (tokens - cost, True) if tokens >= cost else (tokens, False)


def token_bucket(requests: DataFrame, rate: float, burst: float, delay: str = "1 day", bucket_s: int = BUCKET, groups: int | None = None) -> DataFrame:
    """(tenant, event_id, admitted, tokens) for a stream of (tenant, event_id, us, cost)."""

    def step(state: list, e: tuple) -> tuple[list, list[tuple]]:
        us, event, cost = e
        tokens, ok = take(state[0], state[1], us / 1e6, cost, rate, burst)
        return [tokens, us / 1e6], [(event, ok, round(tokens, 6))]

    return in_order(requests, "tenant", ["us", "event_id", "cost"], delay, bucket_s, groups, "tenant long, event_id long, admitted boolean, tokens double", [burst, None], step)


def leases(requests: DataFrame, cap: int, grace_s: float = 15.0, longest_s: float = 86_400.0, delay: str = "1 day", bucket_s: int = BUCKET, groups: int | None = None) -> DataFrame:
    """(tenant, event_id, admitted, open) for a stream of (tenant, event_id, us, hold_s).

    Leases that have ended are dropped first; a new one is admitted while fewer
    than ``cap`` are open, and lasts its hold time and ``grace_s`` more. Holds
    outside (0, longest_s] are refused. A tenant's state ends with its last lease.
    """

    def step(state: list, e: tuple) -> tuple[list, list[tuple]]:
        us, event, hold = e
        open_ = [x for x in state if x > us]
        ok = len(open_) < cap and 0 < hold <= longest_s
        if ok:
            open_.append(us + round((hold + grace_s) * 1e6))
        return open_, [(event, ok, len(open_))]

    return in_order(requests, "tenant", ["us", "event_id", "hold_s"], delay, bucket_s, groups, "tenant long, event_id long, admitted boolean, open int", [], step, lambda s: max(s, default=0))


def fresh(events: DataFrame, delay: str = "1 day", bucket_s: int = BUCKET, groups: int | None = None) -> DataFrame:
    """Events (key, event_id, us, version) whose version isn't below the highest of their key before them."""

    def step(state: list, e: tuple) -> tuple[list, list[tuple]]:
        _, event, version = e
        return [max(state[0], version)], [(event, version)] if version >= state[0] else []

    return in_order(events, "key", ["us", "event_id", "version"], delay, bucket_s, groups, "key long, event_id long, version long", [-1], step)


def lifetimes(beats: DataFrame, ttl_s: int = 900, delay: str = "1 day", bucket_s: int = BUCKET, groups: int | None = None) -> DataFrame:
    """(worker, since_us, expired_us, beats) from a stream of heartbeats (worker, event_id, us).

    A worker lives while its beats are less than ``ttl_s`` apart; its state
    expires by a timer ``ttl_s`` after the last one, and gives one row then.
    """
    ttl = ttl_s * 1_000_000

    def step(state: list, e: tuple) -> tuple[list, list[tuple]]:
        since, _, n = state
        return [e[0] if since is None else since, e[0], n + 1], []

    return in_order(beats, "worker", ["us", "event_id"], delay, bucket_s, groups, "worker long, since_us long, expired_us long, beats long", [None, 0, 0], step, lambda s: s[1] + ttl, lambda s: [(s[0], s[1] + ttl, s[2])])


def once(events: DataFrame, key: list[str], delay: str = "1 day") -> DataFrame:
    """Each key once within the watermark: idempotent enqueueing for streams with ``ts``.

    Keys are kept as long as the delay, so it must be as long as a sender may repeat itself.
    """
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(key)


def enqueue(new: DataFrame, there: DataFrame, delay: str = "1 day") -> DataFrame:
    """(tenant, job_type, key): keys of a stream of new events (…, ts), each once, that a table doesn't hold yet."""
    key = ["tenant", "job_type", "key"]
    return once(new, key, delay).select(*key).join(there.select(*key).distinct(), key, "left_anti")


def usage_windows(events: DataFrame, delay: str = "10 minutes", length: str = "1 hour") -> DataFrame:
    """Events and cost by tenant and hour."""
    w = events.withWatermark("ts", delay).groupBy(F.window("ts", length), "tenant")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("cost")).select(F.col("window.start").alias("starts"), "tenant", "n", "cost")


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_to_end(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process all that is available and stop. Timers need the state store that is set here for the run."""
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    conf.set(name, ROCKS)
    try:
        q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        conf.set(name, before)
