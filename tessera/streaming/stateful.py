"""State machines over event time, as streams and as batches: a breaker of failing services, a cache of answers that expire.

A machine sees the events of its key in the order of their time, whatever the order of arrival. A stream holds events back until the
watermark has passed them: each waits in state with a timer at its own time, so that a micro-batch never has to be in order, and what is later than
the watermark is dropped by Spark. A batch sorts a key's rows and runs through them, with the machine's state alone in memory. Both give the
same rows. State is kept in RocksDB, which needs_rocksdb() asks a session for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import astuple, dataclass

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

SPANS = "service string, state string, start timestamp, end timestamp, attempts long, rejected long"
ANSWERS = "scope string, id long, hit boolean, question string, similarity double, answer string"


def needs_rocksdb(spark: SparkSession) -> None:
    """Makes streams that start from now on keep their state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@dataclass
class Breaker:
    """A service: closed, open for a cooldown once ``threshold`` failures have come within the window of their first one, then half open until
    the next attempt. A success forgets failures; attempts while it is open are rejected and count for nothing. Times are milliseconds."""

    threshold: int
    window: int
    cooldown: int
    state: str = ""
    since: int = 0
    failures: int = 0
    first: int = -1
    open_until: int = 0
    attempts: int = 0
    rejected: int = 0

    def _ends(self, end: int, state: str) -> tuple:
        span = (self.state, self.since, end, self.attempts, self.rejected)
        self.state, self.since, self.attempts, self.rejected = state, end, 0, 0
        return span

    def advance(self, now: int) -> list[tuple]:
        """Spans that have ended by now without an attempt: (state, start, end, attempts, rejected)."""
        return [self._ends(self.open_until, "half_open")] if self.state == "open" and now >= self.open_until else []

    def attempt(self, now: int, ok: bool) -> list[tuple]:
        spans = self.advance(now)
        if not self.state:
            self.state, self.since = "closed", now
        if self.state == "open":
            self.attempts += 1
            self.rejected += 1
            return spans
        if self.state == "half_open":
            spans.append(self._ends(now, "closed"))
        self.attempts += 1
        if ok:
            self.failures, self.first = 0, -1
            return spans
        if self.first < 0:
            self.first = now
        if now - self.first > self.window:
            self.failures, self.first = 1, now
        else:
            self.failures += 1
        if self.failures >= self.threshold:
            self.open_until = now + self.cooldown
            spans.append(self._ends(now, "open"))
        return spans


class _InOrder(StatefulProcessor):
    """Hands each row to step() when the watermark has passed its time, in the order of time, then of id."""

    payload: str

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long", f"rows array<struct<{self.payload}>>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        fresh: dict[int, list[tuple]] = {}
        for r in rows:
            fresh.setdefault(r["at_ms"], []).append(tuple(r[c.split(":")[0].strip()] for c in self.payload.split(",")))
        for at, some in fresh.items():
            held = [tuple(r) for r in self.waiting.getValue((at,))[0]] if self.waiting.containsKey((at,)) else []
            self.waiting.updateValue((at,), (held + some,))
            self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        yield from self.passed(key, now)
        if self.waiting.containsKey((now,)):
            rows = sorted(tuple(r) for r in self.waiting.getValue((now,))[0])
            self.waiting.removeKey((now,))
            yield from self.step(key, now, rows)

    def passed(self, key, now: int) -> Iterator[Row]:
        return iter(())

    def step(self, key, now: int, rows: list[tuple]) -> Iterator[Row]:
        raise NotImplementedError

    def close(self) -> None:
        pass


def _stamp(ms: int) -> pd.Timestamp:
    return pd.Timestamp(ms, unit="ms").to_pydatetime()


class _BreakerStream(_InOrder):
    payload = "id: long, ok: boolean"

    def __init__(self, threshold: int, window: int, cooldown: int):
        self.limits = threshold, window, cooldown

    def init(self, handle) -> None:
        super().init(handle)
        self.machine = handle.getValueState("machine", "state string, since long, failures int, first long, open_until long, attempts long, rejected long")

    def _run(self, key, events: Callable[[Breaker], list[tuple]]) -> Iterator[Row]:
        b = Breaker(*self.limits, *(self.machine.get() if self.machine.exists() else ()))
        spans = events(b)
        self.machine.update(astuple(b)[3:])
        if b.state == "open":
            self.handle.registerTimer(b.open_until)
        for state, start, end, attempts, rejected in spans:
            yield Row(service=key[0], state=state, start=_stamp(start), end=_stamp(end), attempts=attempts, rejected=rejected)

    def passed(self, key, now: int) -> Iterator[Row]:
        return self._run(key, lambda b: b.advance(now))

    def step(self, key, now: int, rows: list[tuple]) -> Iterator[Row]:
        return self._run(key, lambda b: [s for _, ok in rows for s in b.attempt(now, bool(ok))])


def _keyed(df: DataFrame, key: str, at: str, **columns: str) -> DataFrame:
    return df.select(F.col(key).cast("string").alias("key"), F.col(at).alias("at"), F.unix_millis(F.col(at).cast("timestamp")).alias("at_ms"), *(F.col(c).alias(n) for n, c in columns.items())).where("key is not null and at is not null")


def breaker(df: DataFrame, service: str, id_col: str, at: str, ok: str, threshold: int = 3, window: float = 60, cooldown: float = 300, delay: str = "10 minutes") -> DataFrame:
    """(service, state, start, end, attempts, rejected): each service's spans that have ended, closed, open or half open, and the attempts and rejected
    ones within. Rows of one time are taken by id; null outcomes are failures; rows without service or time are left out. Window and
    cooldown are seconds. On a stream, events later than the watermark (``delay`` behind the latest) are dropped; a span that ends by
    itself is given when the watermark passes its end, in a batch when a later attempt of the service does."""
    limits = threshold, int(window * 1000), int(cooldown * 1000)
    rows = _keyed(df, service, at, id=id_col, ok=ok)
    if rows.isStreaming:
        return rows.withWatermark("at", delay).groupBy("key").transformWithState(_BreakerStream(*limits), SPANS, "Append", "EventTime")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, b = None, None
        for f in frames:
            out = []
            for key, now, good in zip(f["key"], f["at_ms"], f["ok"]):
                if key != held:
                    held, b = key, Breaker(*limits)
                out += [(key, s[0], _stamp(s[1]), _stamp(s[2]), s[3], s[4]) for s in b.attempt(int(now), good is not None and bool(good))]
            yield pd.DataFrame(out, columns=["service", "state", "start", "end", "attempts", "rejected"])

    return rows.select("key", "at_ms", "id", F.coalesce("ok", F.lit(False)).alias("ok")).repartition("key").sortWithinPartitions("key", "at_ms", "id").mapInPandas(run, SPANS)


def nearest(vector: list[float], entries: dict[str, tuple]) -> tuple[str | None, float]:
    """The question whose vector is nearest by cosine, and how near; ties by question. entries: question to (vector, answer, time)."""
    best, name = 0.0, None
    norm = sum(x * x for x in vector) ** 0.5
    for question in sorted(entries):
        other = entries[question][0]
        size = sum(x * x for x in other) ** 0.5
        if len(other) == len(vector) and norm and size:
            s = sum(x * y for x, y in zip(vector, other)) / (norm * size)
            if s > best:
                best, name = s, question
    return name, best


def ask(entries: dict[str, tuple], now: int, question: str, vector: list[float], answer: str | None, ttl: int, least: float) -> tuple[bool, str | None, float, str | None]:
    """(hit, question, similarity, answer) of one question; a miss with an answer is kept. Entries older than ttl milliseconds go."""
    for q in [q for q, e in entries.items() if now - e[2] > ttl]:
        del entries[q]
    name, s = nearest(vector, entries)
    if name is not None and s >= least:
        return True, name, round(s, 6), entries[name][1]
    if answer is not None:
        entries[question] = (vector, answer, now)
    return False, None, round(s, 6), answer


class _CacheStream(_InOrder):
    payload = "id: long, question: string, vector: array<double>, answer: string"

    def __init__(self, ttl: int, least: float):
        self.ttl, self.least = ttl, least

    def init(self, handle) -> None:
        super().init(handle)
        self.entries = handle.getMapState("entries", "question string", "vector array<double>, answer string, at long")

    def passed(self, key, now: int) -> Iterator[Row]:
        for q in [k[0] for k, e in self.entries.iterator() if now - e[2] > self.ttl]:
            self.entries.removeKey((q,))
        return iter(())

    def step(self, key, now: int, rows: list[tuple]) -> Iterator[Row]:
        known = {k[0]: (list(e[0]), e[1], e[2]) for k, e in self.entries.iterator()}
        before = dict(known)
        for number, question, vector, answer in rows:
            hit, name, s, text = ask(known, now, question, list(vector), answer, self.ttl, self.least)
            yield Row(scope=key[0], id=number, hit=hit, question=name, similarity=s, answer=text)
        for q in before.keys() - known.keys():
            self.entries.removeKey((q,))
        for q, e in known.items():
            if before.get(q) != e:
                self.entries.updateValue((q,), e)
                self.handle.registerTimer(now + self.ttl + 1)


def answers(df: DataFrame, scope: str, id_col: str, at: str, question: str, vector: str, answer: str, ttl: float = 3600, least: float = 0.95, delay: str = "10 minutes") -> DataFrame:
    """(scope, id, hit, question, similarity, answer): for each question asked, the answer kept for the nearest earlier question of its scope, if
    that is as near as ``least`` and not older than ttl seconds; else its own answer, which is kept. Rows of one time are taken by id; rows
    without scope, time, question or vector are left out. On a stream, state of an entry goes with a timer when it expires, and events later
    than the watermark are dropped. A scope's entries of one time to live are in memory together."""
    ms = int(ttl * 1000)
    rows = _keyed(df, scope, at, id=id_col, question=question, vector=vector, answer=answer).where("question is not null and vector is not null")
    rows = rows.withColumn("vector", F.col("vector").cast("array<double>"))
    if rows.isStreaming:
        return rows.withWatermark("at", delay).groupBy("key").transformWithState(_CacheStream(ms, least), ANSWERS, "Append", "EventTime")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, entries = None, {}
        for f in frames:
            out = []
            for key, now, number, q, v, a in zip(f["key"], f["at_ms"], f["id"], f["question"], f["vector"], f["answer"]):
                if key != held:
                    held, entries = key, {}
                out.append((key, number, *ask(entries, int(now), q, list(v), a, ms, least)))
            yield pd.DataFrame(out, columns=["scope", "id", "hit", "question", "similarity", "answer"])

    return rows.drop("at").repartition("key").sortWithinPartitions("key", "at_ms", "id").mapInPandas(run, ANSWERS)
