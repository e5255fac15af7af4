"""Leases and waits whose timers come from each row, on typed keyed state.

Both keep a key's state only until its own deadline has passed in event time. Leases
lie in bundles: a call of the state store costs far more than a row, so a window pays a
few per bundle and none per transfer. A bundle's state is read and written as a whole.
Start their queries by ``streams.serve`` or ``streams.drain`` with ``typed_state``.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Fixed value: longest wait for an object.
MAX_WAIT_MS = 30_000

# Bundles of keys, at every size of the input.
BUNDLES = 8192

EXPIRED = "transfer lease expired"


def bundle(key: str) -> Column:
    """Number of the bundle of keys that share one state, so that its calls are paid once for many."""
    return F.pmod(F.xxhash64(key), F.lit(BUNDLES)).cast("int").alias("_bundle")


def next_timer(handle: StatefulProcessorHandle, before: int | None, first: int | None) -> None:
    """One timer per bundle: at the first moment any of its keys waits for."""
    if first != before:
        if before is not None:
            handle.deleteTimer(before)
        if first is not None:
            handle.registerTimer(first)


class Lease(StatefulProcessor):
    """The transfers of a bundle: deadline, close that came first (time, how), and when to look again."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("held", "rows binary, timer bigint")

    def close(self) -> None:
        pass

    def _load(self) -> tuple[dict, int | None]:
        if not self.state.exists():
            return {}, None
        packed, timer = self.state.get()
        return pickle.loads(bytes(packed)), timer

    def _save(self, held: dict, before: int | None) -> None:
        first = min((due for *_, due in held.values()), default=None)
        if held:
            self.state.update((pickle.dumps(held), first))
        else:
            self.state.clear()
        next_timer(self.handle, before, first)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held, timer = self._load()
        touched: dict = {}
        for row in rows:
            entry = touched.get(row.transfer)
            if entry is None:
                entry = touched[row.transfer] = [*held.get(row.transfer, (None, None, None, None))]
            if row["_begin"]:
                entry[0] = row["_ms"] if entry[0] is None else entry[0]
            elif row["_ms"] is not None and (entry[1] is None or row["_ms"] < entry[1]):
                entry[1:3] = row["_ms"], row.how
        after = timerValues.getCurrentWatermarkInMs() + 1
        ended = []
        for transfer, (deadline, closed, how, due) in touched.items():
            if deadline is not None and closed is not None and closed < deadline:
                held.pop(transfer, None)
                ended.append((transfer, how))
            elif deadline is not None or closed is not None:
                # Without its beginning a close is kept while that may still come.
                look = max(closed + 1 if deadline is None else deadline, after)
                held[transfer] = (deadline, closed, how, look if due is None else min(due, look))
        self._save(held, timer)
        for transfer, how in ended:
            yield Row(transfer=transfer, outcome=how)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held, _ = self._load()
        fired, now = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        over = [transfer for transfer, (*_, due) in held.items() if due <= fired or due < now]
        expired = [transfer for transfer in over if held.pop(transfer)[0] is not None]
        self._save(held, None)  # the timer that fired goes by itself
        for transfer in expired:
            yield Row(transfer=transfer, outcome=EXPIRED)


def lease_outcomes(begins: DataFrame, closes: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """How each transfer ended: closed before its deadline, or expired.

    ``begins``: transfer, at (event time), deadline_ms, of any length. ``closes``:
    transfer, closed_at, how ('committed', 'aborted'); the first close counts.
    Rows may come as late as ``delay``. A transfer's state goes as it ends.
    """
    kind = begins.schema["transfer"].dataType.simpleString()
    both = begins.select(
        "transfer", "at", F.lit(None).cast("string").alias("how"), F.lit(True).alias("_begin"), F.col("deadline_ms").cast("bigint").alias("_ms")
    ).unionByName(
        closes.select("transfer", F.col("closed_at").alias("at"), "how", F.lit(False).alias("_begin"), F.unix_millis("closed_at").alias("_ms"))
    )
    timed = both.withWatermark("at", delay).withColumn("_bundle", bundle("transfer"))
    return timed.groupBy("_bundle").transformWithState(Lease(), f"transfer {kind}, outcome string", "append", "eventTime")


def valid_wait(timeout_ms: Column) -> Column:
    return timeout_ms.between(1, MAX_WAIT_MS)


class Wait(StatefulProcessor):
    """One object: who waits for it until when, and when it came while earlier requests may follow."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "request bigint", "deadline bigint")
        self.arrived = handle.getValueState("arrived", "ms bigint")

    def close(self) -> None:
        pass

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        stored = self.arrived.get()[0] if self.arrived.exists() else None
        asked: dict[int, int] = {}
        came = False
        for row in rows:
            if row.request is None:
                came, stored = True, row["_ms"] if stored is None else min(stored, row["_ms"])
            else:
                asked[row.request] = row["_ms"] + row.timeout_ms
        if came:
            # Requests that wait since earlier windows; those that are served leave.
            for request, deadline in [(k[0], v[0]) for k, v in self.waiting.iterator()]:
                if stored <= deadline:
                    self.waiting.removeKey((request,))
                    yield Row(request=request, id=key[0], outcome="found")
        after = timerValues.getCurrentWatermarkInMs() + 1
        timers = set()
        for request, deadline in asked.items():
            if stored is not None and stored <= deadline:
                yield Row(request=request, id=key[0], outcome="found")
            else:
                self.waiting.updateValue((request,), (deadline,))
                timers.add(max(deadline + 1, after))
        if came:
            self.arrived.update((stored,))
            timers.add(max(stored + 1, after))
        for timer in timers:
            self.handle.registerTimer(timer)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        for request, deadline in [(k[0], v[0]) for k, v in self.waiting.iterator()]:
            if deadline < now:
                self.waiting.removeKey((request,))
                yield Row(request=request, id=key[0], outcome="timed out")
        # Later requests find the object in the table.
        if self.arrived.exists() and self.arrived.get()[0] < now:
            self.arrived.clear()


def wait_for_objects(requests: DataFrame, arrivals: DataFrame, stored: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """Each request with its outcome: found, timed out, or refused for its timeout.

    ``requests``: request, id, at (event time), timeout_ms. ``stored`` is the
    table of objects (id, stored_at), in which a request first looks. What is not
    there yet is waited for among ``arrivals``, a stream of the same columns, until
    the request's own deadline. A waiting request's state goes with its outcome, an
    arrival's as soon as no earlier request can follow.
    """
    kind = requests.schema["id"].dataType.simpleString()
    first = stored.groupBy(F.col("id").alias("_id")).agg(F.unix_millis(F.min("stored_at")).alias("_first"))
    looked = requests.withColumn("_ms", F.unix_millis("at")).join(first, F.col("id") == F.col("_id"), "left")
    there = F.coalesce(F.col("_first") <= F.col("_ms"), F.lit(False))
    valid = F.coalesce(valid_wait(F.col("timeout_ms")), F.lit(False))
    at_once = looked.filter(~valid | there).select(
        F.col("request").cast("bigint").alias("request"), "id", F.when(~valid, "timeout out of range").otherwise("found").alias("outcome")
    )
    waiting = looked.filter(valid & ~there).select(F.col("request").cast("bigint").alias("request"), "id", "at", "_ms", F.col("timeout_ms").cast("bigint").alias("timeout_ms"))
    came = arrivals.select(
        F.lit(None).cast("bigint").alias("request"), "id", F.col("stored_at").alias("at"), F.unix_millis("stored_at").alias("_ms"),
        F.lit(None).cast("bigint").alias("timeout_ms"),
    )
    both = waiting.unionByName(came).withWatermark("at", delay)
    served = both.groupBy("id").transformWithState(Wait(), f"request bigint, id {kind}, outcome string", "append", "eventTime")
    return at_once.unionByName(served)
