"""Keyed state that never drops a late row.

A stateful operator whose input has the watermark column drops every row behind the
watermark before any code sees it. Here the watermark is set on a column that is then
left out: it still drives the event-time timers, and every row, however late, reaches the
state of its key (`with_clock`). What to do with a late row is the processor's decision,
and each row ends in one of its outputs.

* `Barrier`: the completion barrier of a review, with amendments and late findings.
* `FirstPerKey`: at-least-once deliveries to one event per key, with corrections.
* `Receives`: the fate of a queue message, with retraction on change.

A call to the state store, and the answer of a key, cost Python far more than a row does.
Keys that need no timers are therefore dealt to `BUCKETS` buckets by their hash
(`by_bucket`, `KeyBuckets`): a micro-batch reads and writes the state of a bucket once for
all of its keys in it, so these calls have a bound that no input raises. A bucket is small
beside a partition; more of them suit long histories under short micro-batches. Their
number stays for as long as the checkpoint does.

State of keys that are done goes after a stated time. The processors need the RocksDB
state store (`runner.run` sets it where the session names none).
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, GroupedData, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from revlens import rules

BUCKETS = 1 << 15


def with_clock(events: DataFrame, ts: str, delay: str, keep: list[Column], counted: Column | None = None) -> DataFrame:
    """`keep` of all rows, with event time moved on by `ts` less `delay`. The watermark
    column itself is not among them, so no row is filtered by it. Rows that are not
    `counted` (a test of kept columns) only move the clock: they end here."""
    timed = events.select(F.col(ts).cast("timestamp").alias("__clock"), *keep).withWatermark("__clock", delay)
    if counted is not None:
        # the test names the clock, so it stays above the watermark, which sees all rows
        timed = timed.where(counted | F.col("__clock").isNull())
    return timed.drop("__clock")


def times(rows: DataFrame, *columns: str) -> DataFrame:
    """`columns`, microseconds, as timestamps. Python passes times on as whole numbers."""
    return rows.withColumns({c: F.timestamp_micros(c) for c in columns})


def as_longs(schema: str) -> str:
    """A schema with its timestamps as microseconds."""
    return schema.replace(" timestamp", " long")


# ---- many keys in one state ----------------------------------------------------------


def by_bucket(rows: DataFrame, *keys: str, buckets: int = BUCKETS) -> GroupedData:
    """`rows` grouped by the bucket of their key."""
    return rows.withColumn("__bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).groupBy("__bucket")


class KeyBuckets(StatefulProcessor):
    """State of many keys under one bucket: {key: [..]}, kept as one JSON text. With `ttl`
    the last item of a key's list is the processing time of its last row; a key is forgotten
    `ttl` after that, as a state of its own would be."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bucket = handle.getValueState("bucket", "keys string", self.ttl_ms)

    def load(self, timerValues) -> dict:  # noqa: N803
        got = self.bucket.get()
        if got is None:
            return {}
        alive = json.loads(got[0])
        if self.ttl_ms is not None:
            now = timerValues.getCurrentProcessingTimeInMs()
            alive = [(k, v) for k, v in alive if v[-1] + self.ttl_ms > now]
        return {tuple(k) if isinstance(k, list) else k: v for k, v in alive}

    def save(self, keys: dict) -> None:
        self.bucket.update((json.dumps(list(keys.items()), separators=(",", ":")),))

    def close(self) -> None:
        pass


# ---- completion barrier --------------------------------------------------------------

BARRIER_SCHEMA = (
    "review_id string, kind string, version int, seen_agents int, complete boolean, fired_at timestamp, events long, "
    "agent string, ts timestamp, event_key string"
)
_BARRIER_STATE = (
    "agents array<string>, firsts array<long>, events long, version int, seen int, complete boolean, fired_at long"
)


def decide(firsts: dict[str, int], timeout_us: int, expected: int) -> tuple[int, bool, int]:
    """(reviewers in time, complete, fired_at) of the reviewers' first events: those
    within `timeout_us` of the first of all count."""
    t0 = min(firsts.values())
    in_time = [t for t in firsts.values() if t <= t0 + timeout_us]
    complete = len(in_time) >= expected
    return len(in_time), complete, max(in_time) if complete else t0 + timeout_us


class Barrier(StatefulProcessor):
    """One row of kind `fired` per review: as soon as `expected` reviewers are in, or when
    the clock passes the deadline. An event that comes after that is a row of kind `late`
    of its own; if it changes the decision (it belongs inside the time after all), a row
    of kind `amended` with the next version follows, so the last version of a review is
    the decision over all its events, whatever their order was."""

    def __init__(self, timeout_s: int, expected: int, retention_s: int | None):
        self.timeout_us, self.expected = timeout_s * 1_000_000, expected
        self.retention_us = None if retention_s is None else retention_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.review = handle.getValueState("review", _BARRIER_STATE)

    def _row(self, review_id, kind, version, decision, events) -> Row:
        seen, complete, fired_at = decision
        return Row(review_id=review_id, kind=kind, version=version, seen_agents=seen, complete=complete, fired_at=fired_at,
                   events=events, agent=None, ts=None, event_key=None)

    def _save(self, firsts, events, version, decision) -> None:
        self.review.update((list(firsts), list(firsts.values()), events, version, *(decision or (None, None, None))))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N803
        found = [(r["agent"], r["event_us"], r["event_key"]) for r in rows if r["agent"] is not None and r["event_us"] is not None]
        if not found:  # rows without a reviewer only move the clock
            return
        got = self.review.get()
        if got is None:
            firsts, events, version, before = {}, 0, -1, None
            if self.retention_us is not None:
                # a review this old may have been forgotten: its events are kept, not decided again
                horizon = timerValues.getCurrentWatermarkInMs() * 1000 - self.retention_us
                for agent, t, event_key in [f for f in found if f[1] < horizon]:
                    yield self._late(key[0], None, agent, t, event_key)
                found = [f for f in found if f[1] >= horizon]
                if not found:
                    return
        else:
            agents, times, events, version, *before = got
            firsts, before = dict(zip(agents, times, strict=True)), tuple(before)
        fired = version >= 0
        for agent, t, event_key in found:
            firsts[agent] = min(t, firsts.get(agent, t))
            if fired:
                yield self._late(key[0], before, agent, t, event_key)
        now = decide(firsts, self.timeout_us, self.expected)
        if not fired:
            events += len(found)
            if now[1]:
                yield from self._fire(key[0], firsts, events, now)
                return
            self.handle.registerTimer((min(firsts.values()) + self.timeout_us) // 1000 + 1)
        elif now != before:
            version, before = version + 1, now
            yield self._row(key[0], "amended", version, now, events)
        self._save(firsts, events, version, before if fired else None)

    def _late(self, review_id, decision, agent, t, event_key) -> Row:
        seen, complete, fired_at = decision or (0, False, None)
        return Row(review_id=review_id, kind="late", version=None, seen_agents=seen, complete=complete,
                   fired_at=fired_at, events=1, agent=agent, ts=t, event_key=event_key)

    def _fire(self, review_id, firsts, events, decision) -> Iterator[Row]:
        self._save(firsts, events, 0, decision)
        if self.retention_us is not None:
            self.handle.registerTimer((decision[2] + self.retention_us) // 1000 + 1)
        yield self._row(review_id, "fired", 0, decision, events)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N803
        got = self.review.get()
        if got is None:
            return
        agents, times, events, version, *before = got
        if version < 0:
            firsts = dict(zip(agents, times, strict=True))
            yield from self._fire(key[0], firsts, events, decide(firsts, self.timeout_us, self.expected))
        elif self.retention_us is not None and before[2] + self.retention_us < timerValues.getCurrentWatermarkInMs() * 1000:
            self.review.clear()

    def close(self) -> None:
        pass


# ---- first delivery of a key ---------------------------------------------------------


class FirstPerKey(KeyBuckets):
    """Every input row comes out once: the first arrival of its key as `first`; a later
    arrival that is earlier by (order, tie) as `earlier`, which replaces it for readers
    of the table; all others as `duplicate`. A key is forgotten `ttl` after its last row."""

    def __init__(self, columns: list[str], key: str, ttl_ms: int | None):
        super().__init__(ttl_ms)
        self.columns, self.key = columns, key

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N803
        best = self.load(timerValues)
        now = timerValues.getCurrentProcessingTimeInMs()
        held = {}
        # only the earliest row of each key in a micro-batch is held back, the others pass
        for r in rows:
            place, k = (r["__at"], r["__tie"]), r[self.key]
            first = held.get(k)
            if first is None or place < first[0]:
                held[k] = (place, r)
                r = None if first is None else first[1]
            if r is not None:
                yield self._out(r, "duplicate")
        for k, (place, first) in held.items():
            known = best.get(k)
            kind = "first" if known is None else "earlier" if place < tuple(known[:2]) else "duplicate"
            best[k] = [*(known[:2] if kind == "duplicate" else place), now]
            yield self._out(first, kind)
        self.save(best)

    def _out(self, row: Row, kind: str) -> Row:
        return Row(**{c: row[c] for c in self.columns}, kind=kind)


def first_per_key(events: DataFrame, key: str, order: str, tie: Column | None = None, ttl_s: int | None = None,
                  buckets: int = BUCKETS) -> DataFrame:
    """All rows of a stream with `kind`: one `first` per `key`, `earlier` corrections and
    duplicates. `order` is a time column, `tie` a whole number that makes it unique. No
    watermark is needed and no row is dropped, however late it is."""
    columns = events.columns
    timed = events.withColumn("__at", F.unix_micros(F.col(order).cast("timestamp"))).withColumn(
        "__tie", (F.lit(0) if tie is None else tie).cast("long")
    )
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema) + ", kind string"
    return by_bucket(timed, key, buckets=buckets).transformWithState(
        FirstPerKey(columns, key, None if ttl_s is None else ttl_s * 1000), schema, "Append", "ProcessingTime"
    )


# ---- receives of a queue message -----------------------------------------------------

ROUTE_SCHEMA = (
    "message_id string, change int, version long, queue string, first_received_at timestamp, last_received_at timestamp, "
    "receives long, failures long, route string"
)


class Receives(KeyBuckets):
    """The fate of each message over all its receives, in whatever order they arrive: how
    many failed before the first success, and so `acked`, `dead` (as many failures as are
    allowed) or `retry`. When the fate changes, the row it replaces comes out again with
    change -1 and the new one with change 1: sums over the table are right at any time.
    State of a message is its counts, its first success and the failures before it; it is
    forgotten `ttl` after the last receive."""

    def __init__(self, max_receives: int, ttl_ms: int | None):
        super().__init__(ttl_ms)
        self.max_receives = max_receives

    def _fate(self, message_id, change, state) -> Row:
        version, queue, first_at, _, last_at, receives, ok, fails, _ = state
        route = "dead" if len(fails) >= self.max_receives else "retry" if ok is None else "acked"
        return Row(message_id=message_id, change=change, version=version, queue=queue, first_received_at=first_at,
                   last_received_at=last_at, receives=receives, failures=len(fails), route=route)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N803
        messages = self.load(timerValues)
        now = timerValues.getCurrentProcessingTimeInMs()
        new = {}
        for r in rows:
            k, place = r["message_id"], [r["__at"], r["receive_seq"]]
            state = new.get(k)
            if state is None:
                old = messages.get(k)
                # version, queue, first place, last time, receives, first success, failures before it
                state = new[k] = [0, None, None, None, None, 0, None, [], now] if old is None else [old[0] + 1, *old[1:7], list(old[7]), now]
            _, _, *first, last, receives, ok, fails, _ = state
            if receives == 0 or place < first:
                state[1], state[2:4] = r["queue"], place
            state[4] = place[0] if last is None else max(last, place[0])
            state[5] = receives + 1
            if r["succeeded"]:
                if ok is None or place < ok:  # failures after a success never count
                    state[6], state[7] = place, [f for f in fails if f < place]
            elif ok is None or place < ok:
                fails.append(place)
        for k, state in new.items():
            if k in messages:
                yield self._fate(k, -1, messages[k])
            yield self._fate(k, 1, state)
        messages.update(new)
        self.save(messages)


def message_fates(receives: DataFrame, max_receives: int = rules.MAX_RECEIVES, ttl_s: int | None = 14 * 86_400,
                  buckets: int = BUCKETS) -> DataFrame:
    """Stream of fates (ROUTE_SCHEMA) from a receive log (message_id, queue, received_at,
    receive_seq, succeeded). Work follows the new receives, never the history."""
    timed = receives.select(
        "message_id", "queue", F.unix_micros(F.col("received_at").cast("timestamp")).alias("__at"),
        F.col("receive_seq").cast("long").alias("receive_seq"), "succeeded",
    )
    fates = by_bucket(timed, "message_id", buckets=buckets).transformWithState(
        Receives(max_receives, None if ttl_s is None else ttl_s * 1000), as_longs(ROUTE_SCHEMA), "Append", "ProcessingTime"
    )
    return times(fates, "first_received_at", "last_received_at")
