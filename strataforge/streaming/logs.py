"""Live progress logs: a run's summary kept as state while its lines arrive."""

from __future__ import annotations

from array import array
from bisect import bisect_right
from collections.abc import Iterator
from operator import attrgetter
from typing import NamedTuple

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What a session must set for these streams: states live in RocksDB.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
_KEPT = (
    "last_line long, records long, processed long, total long, elapsed_seconds double, last_id string, item_seconds double, phase string, timed_items long, slowest_item_seconds double, slowest_id string, "
    "bad_line long, bad_error string, bad_terminated boolean, bounds binary, counts binary"
)
_NAMES = [x.strip().split(" ")[0] for x in _KEPT.split(",")]
#: Different item times in one part of a log's histogram, at most.
PART = 1024
SUMMARY = (
    "file string, seen long, status string, reason string, records long, line long, processed long, total long, reported_elapsed_seconds double, last_id string, last_item_seconds double, phase string, truncated_final_line boolean, "
    "timed_items long, median_item_seconds double, slowest_item_seconds double, slowest_id string, silent boolean"
)


class _Line(NamedTuple):
    line: int
    terminated: bool
    processed: int | None
    total: int | None
    elapsed_seconds: float | None
    last_id: str | None
    item_seconds: float | None
    phase: str | None
    error: str | None


def _packed(numbers: list, kind: str) -> bytes:
    return array(kind, numbers).tobytes()


def _unpacked(raw: bytes, kind: str) -> list:
    return array(kind, bytes(raw)).tolist()


class LiveLog(StatefulProcessor):
    """Keeps a log's valid prefix as counts, last fields and a histogram of item times (so that the median stays exact).

    Rows come with the error that their own fields have (``parsed_progress``); what a row breaks against the one before is
    found here. Lines at or below the last one seen are repeats and change nothing. Each access to a state is a call to the
    JVM, so the histogram is kept in parts of sorted times: a batch reads and writes the parts that it adds to, and the
    median reads the one or two parts that hold it. The log itself has each part's lower bound and count.
    """

    def __init__(self, silence_seconds: float | None, expire_seconds: float | None) -> None:
        self.silence, self.expire = silence_seconds, expire_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = int(self.expire * 1000) if self.expire else None
        self.handle = handle
        self.log = handle.getValueState("log", _KEPT, ttl)
        self.times = handle.getMapState("time_parts", "bound double", "seconds binary, n binary", ttl)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803
        known = self.log.get()
        held = dict(zip(_NAMES, known, strict=True)) if known is not None else dict.fromkeys(_NAMES) | {"last_line": -(2**63), "records": 0, "timed_items": 0, "bounds": b"", "counts": b""}
        fresh: dict[float, int] = {}
        for row in sorted(self._lines(rows), key=attrgetter("line")):
            if row.line > held["last_line"]:
                held["last_line"] = row.line
                if held["bad_error"] is None:
                    self._take(held, row, fresh)
        parts = self._add(held, fresh) if fresh or self.expire else {}
        self.log.update(tuple(held[n] for n in _NAMES))
        if self.silence:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(self.silence * 1000))
        yield self._summary(key, held, parts, silent=False)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:  # noqa: ARG002, N802, N803
        known = self.log.get()
        if known is not None:
            yield self._summary(key, dict(zip(_NAMES, known, strict=True)), {}, silent=True)

    def close(self) -> None:
        pass

    @staticmethod
    def _lines(rows: Iterator[Row]) -> Iterator[_Line]:
        """What is needed of the rows, without their Row objects; NaN is no number of seconds."""
        at = None
        for row in rows:
            at = at or [row.__fields__.index(n) for n in _Line._fields]
            yield _Line(*(None if row[k] != row[k] else row[k] for k in at))

    def _part(self, bound: float) -> dict[float, int]:
        seconds, n = self.times.getValue((bound,))
        return dict(zip(_unpacked(seconds, "d"), _unpacked(n, "q"), strict=True))

    def _add(self, held: dict, fresh: dict[float, int]) -> dict[float, dict[float, int]]:
        """Count new times in their parts, cut those that have grown too large, and return what has been written."""
        bounds = _unpacked(held["bounds"], "d")
        old = dict(zip(bounds, _unpacked(held["counts"], "q"), strict=True))
        parts = {b: self._part(b) for b in bounds} if self.expire else {}  # all are written again, so that none expires before the log
        for seconds, n in fresh.items():
            bound = bounds[max(bisect_right(bounds, seconds) - 1, 0)] if bounds else None
            if bound not in parts:
                parts[bound] = self._part(bound) if bounds else {}
            parts[bound][seconds] = parts[bound].get(seconds, 0) + n
        made = {}
        for bound, part in parts.items():
            items = sorted(part.items())
            size = len(items) if len(items) <= PART else PART // 2
            for k in range(0, len(items), size):
                made[items[k][0] if k or bound is None else bound] = dict(items[k : k + size])
        for bound, part in made.items():
            self.times.updateValue((bound,), (_packed(list(part), "d"), _packed(list(part.values()), "q")))
        counts = dict(sorted((old | {b: sum(part.values()) for b, part in made.items()}).items()))
        held |= {"bounds": _packed(list(counts), "d"), "counts": _packed(list(counts.values()), "q")}
        return made

    @staticmethod
    def _take(held: dict, row: _Line, fresh: dict[float, int]) -> None:
        error, falls = row.error, lambda name: None not in (getattr(row, name), held[name]) and getattr(row, name) < held[name]
        if error is None and held["records"] and (falls("processed") or falls("elapsed_seconds")):
            error = "nonmonotonic_progress"
        if error is not None:
            held |= {"bad_line": row.line, "bad_error": error, "bad_terminated": bool(row.terminated)}
            return
        seconds = row.item_seconds
        held |= {"records": held["records"] + 1, "processed": row.processed, "total": row.total, "elapsed_seconds": row.elapsed_seconds, "last_id": row.last_id, "item_seconds": seconds, "phase": row.phase}
        if seconds is not None:
            fresh[seconds] = fresh.get(seconds, 0) + 1
            held["timed_items"] += 1
            if held["slowest_item_seconds"] is None or seconds > held["slowest_item_seconds"]:
                held |= {"slowest_item_seconds": seconds, "slowest_id": held["last_id"]}

    def _median(self, held: dict, parts: dict[float, dict[float, int]]) -> float | None:
        """Of all times, by the parts just written or, where the middle lies in another one, as it is kept."""
        middle, upto, count = [], 0, held["timed_items"]
        ranks = ((count - 1) // 2, count // 2) if count else ()
        for bound, total in zip(_unpacked(held["bounds"], "d"), _unpacked(held["counts"], "q"), strict=True) if count else ():
            if any(upto <= rank < upto + total for rank in ranks):
                below = upto
                for seconds, n in (parts[bound] if bound in parts else self._part(bound)).items():
                    middle += [seconds] * sum(below <= rank < below + n for rank in ranks)
                    below += n
            upto += total
        return sum(middle) / 2 if middle else None

    def _summary(self, key: tuple, held: dict, parts: dict[float, dict[float, int]], silent: bool) -> Row:
        records, bad = held["records"], held["bad_error"]
        truncated = bad == "invalid_json" and held["bad_line"] == held["last_line"] and not held["bad_terminated"]
        failed = bad is not None and not truncated
        status = "invalid" if failed else "partial" if truncated else "valid"
        reason = bad if failed else "truncated_final_line" if truncated and not records else None
        clear = lambda name: None if failed else held[name]
        row = [
            key[0], held["last_line"], status, reason, records, held["bad_line"] if failed else None, clear("processed"), clear("total"), clear("elapsed_seconds"), clear("last_id"), clear("item_seconds"), clear("phase"), truncated,
            clear("timed_items"), None if failed else self._median(held, parts), clear("slowest_item_seconds"), clear("slowest_id"), silent,
        ]
        return Row(**dict(zip((x.strip().split(" ")[0] for x in SUMMARY.split(",")), row, strict=True)))


def live_summaries(rows: DataFrame, *, silence_seconds: float | None = None, expire_seconds: float | None = None) -> DataFrame:
    """A stream of ``progress_summary``'s rows for the logs in a stream of parsed lines (file, line, terminated, fields, error).

    Each batch gives a row for each log that got lines in it (``seen`` is its last line). After ``silence_seconds`` without
    lines a log's row comes once more, marked ``silent``; a log is forgotten ``expire_seconds`` after its last change. Both need a processing-time trigger: a stream that waits for
    timers never ends by itself, so an available-now trigger would run on. The session needs ``STATE_STORE``.
    """
    columns = ["file", "line", "terminated", "processed", "total", "elapsed_seconds", "last_id", "item_seconds", "phase", "error"]
    parsed = rows.select(*columns).withColumn("file", F.col("file").cast("string"))
    mode = "ProcessingTime" if silence_seconds or expire_seconds else "None"
    return parsed.groupBy("file").transformWithState(LiveLog(silence_seconds, expire_seconds), SUMMARY, "Update", mode)


def newest(summaries: DataFrame) -> DataFrame:
    """Of all rows that ``live_summaries`` has given, the last one of each log."""
    rest = [c for c in summaries.columns if c not in ("file", "seen")]
    return summaries.where("not silent").groupBy("file").agg(F.max_by(F.struct(*rest), "seen").alias("s"), F.max("seen").alias("seen")).select("file", "seen", "s.*")
