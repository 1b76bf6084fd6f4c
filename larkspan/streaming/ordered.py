"""Rules that need their calls in order, on streams that bring them out of order.

Rows wait in list state until the watermark has passed them; an event-time timer then hands them on in order.  What the
rule knows of a user lies in value state: it survives a restart, a refused call leaves it as it was, and a timer clears
it once nothing that it holds can matter any more.  A row later than the watermark allows is dropped.

Users share keys: each call between Python and the state store costs far more than a row, so a key holds a bucket of
users, its rows and what is known of them as arrays.  The calls grow with the buckets, not with the users.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Buckets of users, unless told otherwise; a stream's state keeps the number that it first had.
BUCKETS = 1_000
#: Rows of an element of list state at most.
ELEMENT_ROWS = 10_000
_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def _arrays(columns: str) -> str:
    """State of many rows: each column ("name type") as an array."""
    return ", ".join("{} array<{}>".format(*c.split()) for c in columns.split(", "))


class InOrder(StatefulProcessor):
    """Hands each user's rows to ``step`` in order of (at, event_id); ``at`` is in microseconds."""

    #: Columns that a row brings beside user_id, at and event_id, all longs.
    ASKED: tuple[str, ...]
    KNOWN: str
    TOLD: tuple[str, ...]

    def wanted(self, *asked: int) -> bool:
        """Whether such a row can change or tell anything."""
        return True

    def start(self) -> tuple:
        """What is known of a user never seen."""
        raise NotImplementedError

    def step(self, known: tuple, at: int, *asked: int) -> tuple[tuple, tuple | None]:
        """What is known after the row, and what to tell of it after (user_id, event_id), if anything."""
        raise NotImplementedError

    def lasts(self, known: tuple) -> int | None:
        """Until when (microseconds) what is known can matter; None for ever."""
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _arrays(", ".join(f"{c} long" for c in ("user_id", "at", "event_id", *self.ASKED))))
        self.known = handle.getValueState("known", _arrays(f"user_id long, {self.KNOWN}"))
        self.passed = set()  # (bucket, watermark) of timers worked off: others of the bucket have nothing left to do

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        some, first = [], None
        for _bucket, user, _ts, at, event_id, *asked in rows:
            if self.wanted(*asked):
                some.append((user, at, event_id, *asked))
                first = at if first is None else min(first, at)
            if len(some) == ELEMENT_ROWS:
                self._wait(some)
                some = []
        if some:
            self._wait(some)
        if first is not None:
            self.handle.registerTimer(-(-first // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        if (key, watermark) in self.passed:
            return
        self.passed.add((key, watermark))
        upto = watermark * 1000
        due = self._due(upto)
        known = {user: what for user, *what in zip(*self.known.get())} if self.known.exists() else {}
        held, told = len(known), Row("user_id", "event_id", *self.TOLD)
        for user, at, event_id, *asked in due:
            known[user], answer = self.step(known.get(user) or self.start(), at, *asked)
            if answer is not None:
                yield told(user, event_id, *answer)
        self._keep(known, upto, changed=bool(due), held=held)

    def _wait(self, rows: list[tuple]) -> None:
        self.waiting.appendValue(tuple(map(list, zip(*rows))))

    def _due(self, upto: int) -> list[tuple]:
        """The waiting rows up to then, in order; the others go on waiting."""
        rows = [r for part in self.waiting.get() for r in zip(*part)] if self.waiting.exists() else []
        due, rest = [r for r in rows if r[1] <= upto], [r for r in rows if r[1] > upto]
        if due:
            self.waiting.clear()
            for n in range(0, len(rest), ELEMENT_ROWS):
                self._wait(rest[n : n + ELEMENT_ROWS])
        if rest:
            self.handle.registerTimer(-(-min(r[1] for r in rest) // 1000))
        return sorted(due, key=lambda r: (r[1], r[2] is None, r[2] or 0))

    def _keep(self, known: dict[int, tuple], upto: int, changed: bool, held: int) -> None:
        """Keep what can still matter; a timer asks again when the last that ends has ended, and each one before drops what has."""
        ends = {user: self.lasts(what) for user, what in known.items()}
        kept = {user: what for user, what in known.items() if ends[user] is None or ends[user] > upto}
        if kept and (changed or len(kept) < held):
            self.known.update(([*kept], *map(list, zip(*kept.values()))))
        elif not kept and held:
            self.known.clear()
        last = max((ends[user] for user in kept if ends[user] is not None), default=None)
        if last is not None:
            self.handle.registerTimer(-(-last // 1000))

    def close(self) -> None:
        pass


class CallBudget(InOrder):
    """Calls of a user against caps per calendar day and month; a cap of 0 or less switches its window off.

    The day is asked first.  A call that it refuses changes nothing; one that the month refuses has used up the day.
    """

    ASKED = ("day", "day_end", "month_end")
    KNOWN = "day_calls long, day_end long, month_calls long, month_end long"
    TOLD = ("day", "admitted", "refused_by")

    def __init__(self, day_cap: int, month_cap: int) -> None:
        self.day_cap, self.month_cap = day_cap, month_cap

    def start(self) -> tuple:
        return (0, 0, 0, 0)

    def step(self, known: tuple, at: int, day: int, day_end: int, month_end: int) -> tuple[tuple, tuple]:
        day_calls, last_day, month_calls, last_month = known
        if last_day != day_end:
            day_calls = 0
        if last_month != month_end:
            month_calls = 0
        refused = None
        if self.day_cap > 0 and day_calls >= self.day_cap:
            refused = "day"
        else:
            day_calls += 1
            if self.month_cap > 0 and month_calls >= self.month_cap:
                refused = "month"
            else:
                month_calls += 1
        return (day_calls, day_end, month_calls, month_end), (day, refused is None, refused)

    def lasts(self, known: tuple) -> int:
        return max(known[1], known[3])


class TableState(InOrder):
    """Whether a user's table is current, stale, frozen or missing at each ask, and whether the ask may fetch.

    ``kind`` adds up what a row is: 1 a success, 2 a failure, 4 an ask.  The last success is known without expiry; after
    a failure nothing is fetched for the cooldown.
    """

    ASKED = ("kind",)
    KNOWN = "ok long, bad long"
    TOLD = ("state", "fetches")

    def __init__(self, fresh_seconds: int, kept_seconds: int, cooldown_seconds: int) -> None:
        self.fresh, self.kept, self.cooldown = fresh_seconds * 1_000_000, kept_seconds * 1_000_000, cooldown_seconds * 1_000_000

    def wanted(self, kind: int) -> bool:
        return kind > 0

    def start(self) -> tuple:
        return (None, None)

    def step(self, known: tuple, at: int, kind: int) -> tuple[tuple, tuple | None]:
        ok, bad = known
        if kind & 1:
            ok = at
        if kind & 2:
            bad = at
        if not kind & 4:
            return (ok, bad), None
        age = None if ok is None else at - ok
        state = "missing" if age is None else "current" if age <= self.fresh else "stale" if age <= self.kept else "frozen"
        if bad is not None and at - bad >= self.cooldown:
            bad = None  # cooled down
        return (ok, bad), (state, state != "current" and bad is None)

    def lasts(self, known: tuple) -> int | None:
        if known[0] is not None:
            return None
        return known[1] + self.cooldown if known[1] is not None else 0


def _ruled(stream: DataFrame, rule: InOrder, asked: dict[str, Column], shape: str, late: str, buckets: int) -> DataFrame:
    """What ``rule`` tells of a stream of events whose ``ts`` is an instant."""
    bucket = F.pmod(F.xxhash64("user_id"), F.lit(buckets)).alias("bucket")
    rows = stream.select(bucket, "user_id", "ts", F.unix_micros("ts").alias("at"), "event_id", *[c.cast("long").alias(name) for name, c in asked.items()])
    return rows.withWatermark("ts", late).groupBy("bucket").transformWithState(rule, shape, "Append", "EventTime")


def _instants(stream: DataFrame) -> DataFrame:
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def stream_budget(stream: DataFrame, day_cap: int, month_cap: int, late: str, buckets: int = BUCKETS) -> DataFrame:
    """(user_id, event_id, day, admitted, refused_by) of every call of a stream of events; ``late`` is how late a row may come."""
    end = lambda unit, step: F.unix_micros(F.date_trunc(unit, "ts") + F.expr(step))
    asked = {"day": F.unix_date(F.to_date("ts")), "day_end": end("day", "interval 1 day"), "month_end": end("month", "interval 1 month")}
    shape = "user_id long, event_id long, day long, admitted boolean, refused_by string"
    told = _ruled(_instants(stream), CallBudget(day_cap, month_cap), asked, shape, late, buckets)
    return told.withColumn("day", F.date_format(F.date_from_unix_date(F.col("day").cast("int")), "yyyy-MM-dd"))


def stream_table_state(stream: DataFrame, success: str, failure: str, ask: str, fresh_seconds: int, kept_seconds: int, cooldown_seconds: int, late: str, buckets: int = BUCKETS) -> DataFrame:
    """(user_id, event_id, state, fetches) of every ask of a stream of events, as ``counters.as_of_state`` tells it of a table."""
    kind = sum(F.when(F.col("event_type") == name, bit).otherwise(0) for name, bit in ((success, 1), (failure, 2), (ask, 4)))
    rule = TableState(fresh_seconds, kept_seconds, cooldown_seconds)
    return _ruled(_instants(stream), rule, {"kind": kind}, "user_id long, event_id long, state string, fetches boolean", late, buckets)


@contextmanager
def settings(spark: SparkSession, **more: str) -> Iterator[None]:
    """Session settings for a stream while it starts and runs: one shuffle partition a core, unless told otherwise.

    A stream's state keeps the number of partitions that it first had.
    """
    wanted = {"spark.sql.shuffle.partitions": str(spark.sparkContext.defaultParallelism), **_STORE, **more}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_to_end(stream: DataFrame, sink: str, checkpoint: str, **more: str) -> None:
    """Work off what has landed so far into the Parquet folder ``sink``, from ``checkpoint`` on, and stop; ``more`` are session settings.

    State lies in RocksDB below the checkpoint, which survives lost executors and the end of the application.
    """
    with settings(stream.sparkSession, **more):
        run = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination()
