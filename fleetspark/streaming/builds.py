"""Build outcomes out of a stream of status polls, with a time-out by event time."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Final states and the longest wait.
FINAL_STATES = ["READY", "ERROR", "CANCELED"]
MAX_WAIT_SECONDS = 300

OUTCOME = "state string, success boolean, started_ms bigint, ended_ms bigint"
#: How long after its deadline a finished build is remembered.
FORGET_SECONDS = 86_400
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def timeout_processor(forget_seconds: int = FORGET_SECONDS) -> StatefulProcessor:
    """The processor; as a local class it travels to the workers by value, so they need no package of ours."""

    class BuildTimeout(StatefulProcessor):
        """State per deployment: first poll and whether its outcome was given.

        A deployment ends with its first final state no later than the longest wait
        after its first poll, else with TIMEOUT: when a later poll shows that the wait
        is over, or when the watermark passes it.  Its state goes ``forget_seconds`` after
        its deadline; a poll that comes after that starts a new build.
        """

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.build = handle.getValueState("build", "started_ms bigint, done boolean")

        def _outcome(self, key, state: str, started: int, ended: int) -> Row:
            return Row(deployment_id=key[0], state=state, success=state == "READY", started_ms=started, ended_ms=ended)

        def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
            # Each call of the state or the timers goes to the JVM and back, so none is made in vain.
            known = self.build.get()
            if known is not None and known[1]:
                return
            before = started = known[0] if known is not None else None
            first_end, last = None, None
            for row in rows:  # one pass; only three values are kept of any number of polls
                at, state = row["polled_ms"], row["ready_state"]
                started = at if started is None or at < started else started
                last = at if last is None or at > last else last
                if state in FINAL_STATES and (first_end is None or (at, state) < first_end):
                    first_end = (at, state)
            deadline = started + MAX_WAIT_SECONDS * 1000
            if before is not None and before != started:
                self.handle.deleteTimer(before + MAX_WAIT_SECONDS * 1000)
            if first_end is not None and first_end[0] <= deadline:
                end = (first_end[1], first_end[0])
            elif last > deadline:
                end = ("TIMEOUT", deadline)
            else:
                if before != started:
                    self.build.update((started, False))
                    self.handle.registerTimer(deadline)
                return
            # A build that ends has one timer more, at its deadline, which does no harm.
            self.build.update((started, True))
            self.handle.registerTimer(deadline + forget_seconds * 1000)
            yield self._outcome(key, end[0], started, end[1])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
            known = self.build.get()
            if known is None:
                return
            started, done = known
            deadline = started + MAX_WAIT_SECONDS * 1000
            if not done:
                self.build.update((started, True))
                self.handle.registerTimer(deadline + forget_seconds * 1000)
                yield self._outcome(key, "TIMEOUT", started, deadline)
            elif expiredTimerInfo.getExpiryTimeInMs() > deadline:
                self.build.clear()

        def close(self) -> None:
            pass

    return BuildTimeout()


def build_timeout(polls: DataFrame, delay: str = "10 minutes", forget_seconds: int = FORGET_SECONDS) -> DataFrame:
    """One outcome per deployment from polls (deployment_id, polled_at, ready_state); the id may be of any type."""
    slim = polls.withWatermark("polled_at", delay).select(
        "deployment_id", "polled_at", F.unix_millis("polled_at").alias("polled_ms"), "ready_state"
    )
    key_type = polls.schema["deployment_id"].dataType.simpleString()
    ended = slim.groupBy("deployment_id").transformWithState(
        statefulProcessor=timeout_processor(forget_seconds), outputStructType=f"deployment_id {key_type}, {OUTCOME}", outputMode="Append", timeMode="EventTime"
    )
    return ended.select(
        "deployment_id", "state", "success",
        F.timestamp_millis("started_ms").alias("started_at"), F.timestamp_millis("ended_ms").alias("ended_at"),
    )
