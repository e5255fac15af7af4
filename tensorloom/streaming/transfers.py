"""Ordered chunk streams with hashes and leases, on typed keyed state.

Frames: transfer, seq (0, 1, 2, ... per transfer), kind ('begin', 'chunk',
'commit', 'abort'), idx, data, hash (of the chunk), expected_chunks, expected_len
(bytes), expected_hash, aggregate_hash, deadline_ms and the event time ``at``.

Transfers lie in bundles, since a call of the state store costs far more than a frame.
State per bundle: a row of numbers per transfer, with a bitmap of indices and the places
of its frames; the frames that wait and the accepted chunks, in parts of ``PART`` bytes
that go when nothing in them is needed any more; and a timer. Chunks are kept until the
transfer closes, since its hash runs over all of them in index order; memory holds what
``KEEP`` says of the parts read, and one part being filled.
"""

from __future__ import annotations

import hashlib
import pickle
import sys
from collections import namedtuple
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tensorloom.streaming.timers import bundle, next_timer

# Bytes of frames in a part of the state, and of parts that memory keeps for reading.
PART, KEEP = 1 << 22, 1 << 24

# Fixed value: lease of a transfer.
LEASE_MS = 300_000

OUTPUT = "transfer string, seq bigint, kind string, idx bigint, outcome string"
FRAME = {
    "seq": "bigint", "kind": "string", "idx": "bigint", "data": "binary", "hash": "string", "expected_chunks": "bigint",
    "expected_len": "bigint", "expected_hash": "string", "aggregate_hash": "string", "deadline_ms": "bigint",
}
EARLY = [c for c in FRAME if c != "seq"]
# What a chunk has; the other columns are read of other frames alone.
SLIM = EARLY[:4]
Frame = namedtuple("Frame", ["seq", *EARLY], defaults=(None,) * (len(EARLY) - len(SLIM)))
START = {
    "next": 0, "index": 0, "total": 0, "open": False, "over": False, "expected_chunks": None, "expected_len": None,
    "expected_hash": None, "deadline_ms": None, "latest": 0, "timer": 0, "seen": b"",
}

OVER = "ignored: stream is over"
REPEATED = "ignored: number already used"
DROPPED = "dropped: stream failed"
UNBEGUN = "ignored: stream never began"


def frames_from(df: DataFrame) -> DataFrame:
    """Typed frame columns."""
    return df.select(F.col("transfer").cast("string").alias("transfer"), "at", *[F.col(c).cast(t).alias(c) for c, t in FRAME.items()])


class TransferJudge(StatefulProcessor):
    """Outcome of every frame of a bundle's transfers; see ``transfer_outcomes``."""

    def __init__(self, order: str, whole: bool):
        self.order, self.whole = order, whole
        self.part_bytes, self.keep_bytes = PART, KEEP

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.heads = handle.getValueState("heads", "rows binary, timer bigint")
        self.parts = handle.getMapState("parts", "part bigint", "frames binary")

    def close(self) -> None:
        pass

    def _load(self) -> int | None:
        """The bundle's transfers, how many frames are needed of each part, and the part to fill next."""
        self.held, self.live, self.part, timer = {}, {}, 0, None
        if self.heads.exists():
            packed, timer = self.heads.get()
            self.held, self.live, self.part = pickle.loads(bytes(packed))
        self.fresh: list[tuple | None] = []
        self.size = 0
        self.read: dict[int, tuple[list, int]] = {}
        return timer

    def _save(self, before: int | None) -> None:
        self._store()
        first = min((now["timer"] for now in self.held.values()), default=None)
        if self.held:
            self.heads.update((pickle.dumps((self.held, self.live, self.part)), first))
        else:
            self.heads.clear()
        next_timer(self.handle, before, first)

    # Frames have a place: number of the part, position in it. The part being filled stays in memory.

    def _keep(self, frame: Row) -> tuple[int, int]:
        names = SLIM if frame.kind == "chunk" else EARLY
        self.fresh.append(tuple(frame[c] for c in names))
        self.live[self.part] = self.live.get(self.part, 0) + 1
        place = self.part, len(self.fresh) - 1
        self.size += 100 + len(frame.data or b"")
        if self.size >= self.part_bytes:
            self._store()
        return place

    def _store(self) -> None:
        """The part being filled goes to the state, unless nothing in it is needed."""
        if self.live.get(self.part):
            self.parts.updateValue((self.part,), (pickle.dumps(self.fresh),))
            self._remember(self.part, self.fresh, self.size)
            self.part += 1
        else:
            self.live.pop(self.part, None)
        self.fresh, self.size = [], 0

    def _remember(self, part: int, frames: list, size: int) -> None:
        self.read[part] = frames, size
        while len(self.read) > 1 and sum(n for _, n in self.read.values()) > self.keep_bytes:
            del self.read[next(iter(self.read))]

    def _frame(self, place: tuple[int, int]) -> tuple:
        part, at = place
        if part == self.part:
            return self.fresh[at]
        if part not in self.read:
            packed = bytes(self.parts.getValue((part,))[0])
            self._remember(part, pickle.loads(packed), len(packed))
        return self.read[part][0][at]

    def _drop(self, place: tuple[int, int]) -> None:
        part, at = place
        self.live[part] -= 1
        if part == self.part:
            self.fresh[at] = None
        elif not self.live[part]:
            del self.live[part]
            self.read.pop(part, None)
            self.parts.removeKey((part,))

    def _flush_waiting(self, outcome: str) -> Iterator[tuple]:
        """Outcomes of the frames that still wait."""
        for seq, (place, kind, idx) in sorted(self.now["waits"].items(), key=lambda w: w[0]):
            self._drop(place)
            yield seq, kind, idx, outcome
        self.now["waits"] = {}

    def _held(self) -> list[tuple[int, int]]:
        """(seq, idx) of the accepted chunks that are not out yet."""
        return sorted((seq, idx) for idx, (seq, _) in self.now["chunks"].items())

    def _give_back(self) -> None:
        for _, place in self.now["chunks"].values():
            self._drop(place)
        self.now["chunks"] = {}

    def _end(self) -> Iterator[tuple]:
        """The stream is over: chunks are given up, and waiting frames have their outcome."""
        self.now["over"] = True
        self._give_back()
        yield from self._flush_waiting(OVER)

    def _fail(self, frame: Frame, reason: str) -> Iterator[tuple]:
        yield frame.seq, frame.kind, frame.idx, reason
        yield from self._give_up()

    def _give_up(self) -> Iterator[tuple]:
        if self.whole:
            for seq, idx in self._held():
                yield seq, "chunk", idx, DROPPED
        yield from self._end()

    def _seen(self, idx: int) -> bool:
        byte = idx >> 3
        return byte < len(self.now["seen"]) and bool(self.now["seen"][byte] >> (idx & 7) & 1)

    def _see(self, idx: int) -> None:
        byte, bits = idx >> 3, bytearray(self.now["seen"])
        bits.extend(bytes(max(0, byte + 1 - len(bits))))
        bits[byte] |= 1 << (idx & 7)
        self.now["seen"] = bytes(bits)

    def _judge(self, frame: Frame, place: tuple[int, int]) -> Iterator[tuple]:
        now, kind, idx = self.now, frame.kind, frame.idx
        now["next"] += 1
        if kind == "begin":
            if now["open"]:
                yield from self._fail(frame, "failed: begun twice")
                return
            now |= {c: getattr(frame, c) for c in ("expected_chunks", "expected_len", "expected_hash", "deadline_ms")} | {"open": True}
            yield frame.seq, kind, idx, "begun"
        elif kind == "abort":
            yield from self._fail(frame, "failed: aborted")
        elif not now["open"]:
            yield from self._fail(frame, "failed: frame before begin")
        elif kind == "chunk":
            reason = self._chunk_fault(frame)
            if reason:
                yield from self._fail(frame, reason)
                return
            now["index"] += 1
            now["total"] += len(frame.data)
            if self.order != "sequential":
                self._see(idx)
            now["chunks"][idx] = frame.seq, place
            if not self.whole:
                yield frame.seq, kind, idx, "accepted"
        elif kind == "commit" and self._complete(frame):
            if self.whole:
                for seq, held in self._held():
                    yield seq, "chunk", held, "accepted"
            yield frame.seq, kind, idx, "closed"
            yield from self._end()
        else:
            yield from self._fail(frame, "failed: commit check" if kind == "commit" else "failed: unknown kind")

    def _chunk_fault(self, frame: Frame) -> str | None:
        idx, now = frame.idx, self.now
        if self.order == "sequential":
            if idx != now["index"]:
                return "failed: out of order"
        elif idx is None or not 0 <= idx < (now["expected_chunks"] or 0) or self._seen(idx):
            return "failed: index repeated or out of range"
        if frame.data is None or hashlib.sha256(frame.data).hexdigest() != frame.hash:
            return "failed: hash mismatch"
        return None

    def _complete(self, frame: Frame) -> bool:
        now = self.now
        if now["index"] != now["expected_chunks"] or now["total"] != now["expected_len"] or frame.aggregate_hash != now["expected_hash"]:
            return False
        digest = hashlib.sha256()
        for idx in range(now["index"]):
            digest.update(self._frame(now["chunks"][idx][1])[2])
        return digest.hexdigest() == frame.aggregate_hash

    def _advance(self) -> Iterator[tuple]:
        """Judge the frames whose turn has come."""
        now = self.now
        while not now["over"] and now["next"] in now["waits"]:
            seq = now["next"]
            place, _, idx = now["waits"].pop(seq)
            yield from self._judge(Frame(seq, *self._frame(place)), place)
            if now["chunks"].get(idx, (None, None))[1] != place:
                self._drop(place)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        timer = self._load()
        found: list[tuple] = []
        touched: dict[str, dict] = {}
        for frame in rows:
            now = self.held.get(frame.transfer)
            if now is None:
                now = self.held[frame.transfer] = START | {"waits": {}, "chunks": {}}
            touched[frame.transfer] = now
            now["latest"] = max(now["latest"], int(frame["_ms"]))
            if frame.seq is None or frame.seq < now["next"] or not now["over"] and frame.seq in now["waits"]:
                found.append((frame.transfer, frame.seq, frame.kind, frame.idx, REPEATED))
            elif now["over"]:
                found.append((frame.transfer, frame.seq, frame.kind, frame.idx, OVER))
            else:
                now["waits"][frame.seq] = self._keep(frame), frame.kind and sys.intern(frame.kind), frame.idx
        watermark = timerValues.getCurrentWatermarkInMs()
        for transfer, self.now in touched.items():
            found += [(transfer, *row) for row in self._advance()]
            self._set_timer(watermark)
        self._save(timer)
        for row in found:
            yield Row(transfer=row[0], seq=row[1], kind=row[2], idx=row[3], outcome=row[4])

    def _set_timer(self, watermark: int) -> None:
        now = self.now
        # An open transfer runs to its deadline. One that is over, or not begun, is
        # remembered for one lease after its last frame and then forgotten.
        running = now["open"] and not now["over"] and now["deadline_ms"] is not None
        now["timer"] = max(now["deadline_ms"] if running else now["latest"] + LEASE_MS, watermark + 1)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self._load()
        fired, watermark = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        found: list[tuple] = []
        for transfer, self.now in [*self.held.items()]:
            now = self.now
            if now["timer"] > fired and now["timer"] >= watermark:
                continue
            if now["open"] and not now["over"]:
                found += [(transfer, now["next"], "lease", None, "failed: expired"), *((transfer, *row) for row in self._give_up())]
                now["latest"] = max(now["latest"], watermark)
                self._set_timer(watermark)
            else:
                found += [(transfer, *row) for row in self._flush_waiting(UNBEGUN)]
                self._give_back()
                del self.held[transfer]
        self._save(None)  # the timer that fired goes by itself
        for row in found:
            yield Row(transfer=row[0], seq=row[1], kind=row[2], idx=row[3], outcome=row[4])


def transfer_outcomes(frames: DataFrame, order: str = "sequential", finalise: str = "end of axis") -> DataFrame:
    """Outcome of every frame that reaches the stream, repeats included.

    ``order`` 'sequential' wants consecutive indices, 'unordered' any order without
    repeats. ``finalise`` 'whole artifact' holds accepted chunks back until the
    transfer closes; if it fails they are dropped. Every chunk is hashed as its
    turn comes, and a commit is checked against the hash of all bytes in index
    order. Frames may arrive in any order, as late as the watermark's delay. A
    lease that runs out is one 'expired' row; its timer comes from the declared
    deadline. Every state has a timer, so none stays.

    The state lies in the RocksDB store: start the query by ``streams.serve`` or
    ``streams.drain`` with ``typed_state``.
    """
    if order not in ("sequential", "unordered") or finalise not in ("end of axis", "whole artifact"):
        raise ValueError("unknown order or finalisation")
    judge = TransferJudge(order, finalise == "whole artifact")
    timed = frames.withColumn("_ms", F.unix_millis("at")).withColumn("_bundle", bundle("transfer"))
    return timed.groupBy("_bundle").transformWithState(judge, OUTPUT, "append", "eventTime")
