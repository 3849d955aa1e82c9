"""Prompt memory by key: what a prompt holds before each model output, in batch and as a stream.

A memory is asked before an output is taken in, so a row shows what the prompt of that
output had. ``PlanMemory`` keeps the last eight distinct pairs of action and segment and
the last prediction; ``BankMemory`` keeps the debounced states of streaming.memory and
the last state seen. Outputs that can't be read leave either as it is.

Rows of a key count in the order of (at, seq). The batch sorts them. The stream keeps
rows until the watermark has passed them, then takes them in that order, so micro-batches
may bring them mixed: the result is the batch's over all rows that were not late. A key
that is silent for longer than ``idle`` begins anew, and its state is given up.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from loomspan.streaming.memory import Memory, Seen

KEPT = 8
#: One day, in microseconds.
IDLE = 86_400_000_000
_INPUT = ("key", "at", "seq", "valid", "predicted", "action", "action_progress", "segment", "segment_progress", "task_progress")
_WAITING = "at long, seq long, valid boolean, predicted boolean, action string, action_progress int, segment string, segment_progress int, task_progress int"
SCHEMA = "key string, at long, seq long, long_memory string, short_memory string, what string, n_long int, before_sha256 string, after_sha256 string"


def _compact(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


class PlanMemory:
    """The last distinct (action, segment) pairs, compared without case, and the last prediction's units."""

    def __init__(self) -> None:
        self.pairs: list[list[str | None]] = []
        self.short: dict | None = None

    def dump(self) -> list:
        return [self.pairs, self.short]

    def load(self, held: list) -> None:
        self.pairs, self.short = held

    def shown(self) -> tuple[str, str, str]:
        """Long memory and short memory as text, and the digest of both."""
        items = [{"index": i} | {u: c for u, c in zip(("action", "segment"), pair, strict=True) if c is not None} for i, pair in enumerate(self.pairs, 1)]
        whole = _compact({"long_memory": items, "short_memory": self.short})
        return _compact(items), _compact(self.short), sha256(whole.encode()).hexdigest()

    def take(self, row: dict) -> str:
        if not row["valid"]:
            return "invalid_json_state_unchanged"
        if not row["predicted"]:
            return "decision_without_predictions_state_unchanged"
        units = {u: {"caption": row[u], "progress_percent": row[f"{u}_progress"]} for u in ("action", "segment") if row[u] is not None}
        if not units:
            return "prediction1_has_no_units_state_unchanged"
        self.short = {"prediction1": units, "task_progress_percent": row["task_progress"]}
        same = lambda pair: [(c or "").casefold() for c in pair]
        pair = [row["action"], row["segment"]]
        if any(same(pair) == same(known) for known in self.pairs):
            return "prediction1_duplicate_short_only"
        self.pairs = [*self.pairs, pair][-KEPT:]
        return "prediction1_committed"


class BankMemory:
    """The committed states of a debounced memory, and the last state seen; the segment is what the model says comes next."""

    def __init__(self) -> None:
        self.bank, self.last = Memory(), None

    def dump(self) -> list:
        seen = lambda s: None if s is None else [s.caption, s.times, s.progress, s.following]
        return [seen(self.bank.active), seen(self.bank.candidate), self.bank.shown, self.bank.count, self.last]

    def load(self, held: list) -> None:
        active, candidate, shown, count, self.last = held
        self.bank = Memory(active and Seen(*active), candidate and Seen(*candidate), shown, count)

    def shown(self) -> tuple[str, str, str]:
        long, short = _compact(self.bank.shown), _compact(self.last)
        return long, short, sha256((long + short).encode()).hexdigest()

    def take(self, row: dict) -> str:
        if not row["valid"] or not row["predicted"] or row["action"] is None:
            return "invalid_output_hold_last_valid"
        what = self.bank.step(row["action"], row["action_progress"] or 0, row["segment"] or "")
        if what == "refused":
            return "invalid_output_hold_last_valid"
        self.last = [{"caption": row["action"], "progress_percent": row["action_progress"] or 0}]
        return what


KINDS = {"plan": PlanMemory, "bank": BankMemory}


class _Held:
    """A key's memory and the time of its last row."""

    def __init__(self, kind: str, idle: int):
        self.kind, self.idle, self.memory, self.last = kind, idle, KINDS[kind](), None

    def take(self, key: str, row: dict) -> tuple:
        if self.last is not None and row["at"] - self.last > self.idle:
            self.memory = KINDS[self.kind]()
        self.last = row["at"]
        long, short, before = self.memory.shown()
        what = self.memory.take(row)
        _, _, after = self.memory.shown()
        kept = self.memory.dump()[0 if self.kind == "plan" else 2]
        return key, row["at"], row["seq"], long, short, what, len(kept), before, after


def _plain(frame: pd.DataFrame) -> list[dict]:
    """Rows with None for what is missing, and whole numbers."""
    rows = frame.astype(object).where(frame.notna(), None).to_dict("records")
    for row in rows:
        for c in ("at", "seq", "action_progress", "segment_progress", "task_progress"):
            row[c] = None if row[c] is None else int(row[c])
    return rows


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split(" ")[0] for c in SCHEMA.split(", ")])


def batch_prompts(outputs: DataFrame, kind: str = "plan", idle: int = IDLE) -> DataFrame:
    """Each output's prompt memory, and what taking it in did.

    outputs has key, at (microseconds), seq, valid, predicted, action, action_progress,
    segment, segment_progress and task_progress; other columns are ignored. Null truth
    values are false; rows without key or time are left out. Spark deals and sorts the
    rows; a task reads them as a stream with one key's memory at a time.
    """
    own = outputs.where("key is not null and at is not null").select(*_INPUT)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, _Held(kind, idle)
        for frame in frames:
            out = []
            for row in _plain(frame):
                if row["key"] != key:
                    key, held = row["key"], _Held(kind, idle)
                out.append(held.take(key, row))
            yield _frame(out)

    return own.repartition("key").sortWithinPartitions("key", "at", "seq").mapInPandas(read, SCHEMA)


class _Prompts(StatefulProcessor):
    """Rows wait in a list until the watermark has passed them; the memory is one text."""

    def __init__(self, kind: str, idle: int):
        self.kind, self.idle = kind, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _WAITING)
        self.held = handle.getValueState("memory", "last long, memory string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = [row for frame in rows for row in _plain(frame)]
        self.waiting.appendList([tuple(row[c] for c in _INPUT[1:]) for row in new])
        for at in {-(-row["at"] // 1000) for row in new}:
            self.handle.registerTimer(at)
        yield _frame([])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = [dict(zip(_INPUT[1:], r, strict=True)) for r in self.waiting.get()] if self.waiting.exists() else []
        due = sorted((r for r in rows if r["at"] <= passed), key=lambda r: (r["at"], r["seq"] is not None, r["seq"]))
        held = _Held(self.kind, self.idle)
        if self.held.exists():
            held.last, memory = self.held.get()
            held.memory.load(json.loads(memory))
        if due:
            later = [tuple(r.values()) for r in rows if r["at"] > passed]
            self.waiting.put(later) if later else self.waiting.clear()
            yield _frame([held.take(key[0], r) for r in due])
            self.held.update((held.last, json.dumps(held.memory.dump(), ensure_ascii=False)))
            self.handle.registerTimer(-(-(held.last + self.idle) // 1000) + 1)
        elif held.last is not None and held.last + self.idle < passed and not rows:
            self.held.clear()

    def close(self) -> None:
        pass


def stream_prompts(outputs: DataFrame, kind: str = "plan", idle: int = IDLE, late: str = "10 minutes") -> DataFrame:
    """As batch_prompts, over a stream. outputs also has ts, the same time as a timestamp: rows that come more than ``late`` behind the latest one are left out, all others count in their order. Needs the RocksDB state store."""
    own = outputs.where("key is not null and at is not null").withWatermark("ts", late).select("ts", *_INPUT)
    return own.groupBy("key").transformWithStateInPandas(_Prompts(kind, idle), SCHEMA, "append", "eventTime")


def hold_last_valid(df: DataFrame, key: list[str], order: list[str], value: str, valid: str) -> DataFrame:
    """df and ``held``: of each row the value if it is valid, else the last valid one before it; null before the first."""
    upto = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("held", F.last(F.when(F.col(valid), F.col(value)), ignorenulls=True).over(upto))


def first_valid_attempt(df: DataFrame, slot: list[str], attempt: str, value: str, valid: str, most: int) -> DataFrame:
    """(slot, attempts, retried, value): for each slot the first valid one of its first attempts, null if none is."""
    own = df.where(F.col(attempt) < most)
    good = F.coalesce(F.col(valid), F.lit(False))
    return own.groupBy(*slot).agg(F.count(F.lit(1)).alias("attempts"), (F.min(F.when(good, F.col(attempt))) > 0).alias("retried"), F.min_by(value, F.when(good, F.col(attempt))).alias(value))


def counter_rates(df: DataFrame, key: list[str], order: list[str], total: str, idle: str, waiting: str) -> DataFrame:
    """df and ``busy`` and ``waited``: shares, in percent, of a growing total between a row and the one before it; null for the first row and where the total didn't grow.

    idle and waiting are counters of time without work; what they grow by is never more
    than 100 percent nor less than 0 of the total.
    """
    by_time = Window.partitionBy(*key).orderBy(*order)
    grown = lambda c: F.col(c) - F.lag(c).over(by_time)
    own = df.withColumns({"__t": grown(total), "__i": grown(idle) + grown(waiting), "__w": grown(waiting)})
    share = lambda c: F.when(F.col("__t") > 0, F.round(100.0 * F.greatest(F.lit(0), c) / F.col("__t"), 3))
    return own.withColumns({"busy": share(F.col("__t") - F.col("__i")), "waited": share(F.col("__w"))}).drop("__t", "__i", "__w")
