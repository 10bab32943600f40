"""Streams of trace records: windowed errors, rules in micro-batches, alerts that reopen.

Watermarks and windows are extensions: the batch rules look back from a given time.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quarry.operators.alerts import sliding_errors

SCHEMA = "id string, ts timestamp, name string, kind string, status string, duration_ms double, model string, input_tokens bigint, output_tokens bigint"


def trace_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Records of JSON files as they appear in a folder."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def windowed_errors(stream: DataFrame, late: str = "1 hour", size: str = "24 hours", step: str = "10 minutes") -> DataFrame:
    return sliding_errors(stream.withWatermark("ts", late), size, step)


#: Schema of the events of alerts: kind is fire, ack or resolve.
EVENTS = "dedupe_key string, id string, ts timestamp, kind string"
#: What becomes of an alert: status is open, acked, resolved or expired; `alert_id` is the event that opened it.
CHANGES = "dedupe_key string, alert_id string, status string, at timestamp"


class AlertLife(StatefulProcessor):
    """The alert of a key: fire opens one unless one is open or acked, ack marks an open one, resolve ends it, and one that
    nothing has ended for `expiry` seconds ends by itself.

    Events wait in state until the watermark has passed them and are then taken in the order of (ts, id), so that neither
    the division into batches nor disorder within the watermark's delay changes anything.
    """

    def __init__(self, expiry: int | None) -> None:
        self.expiry = expiry

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.alert = handle.getValueState("alert", "alert_id string, status string, ends timestamp")
        self.waiting = handle.getMapState("waiting", "ts timestamp, id string", "kind string")

    @staticmethod
    def _ms(at: datetime) -> int:
        """The first millisecond that is not before `at`."""
        return -(-round(at.timestamp() * 1_000_000) // 1_000)

    def handleInputRows(self, key, rows, timerValues):
        for row in rows:
            self.waiting.updateValue((row.ts, row.id), (row.kind,))
            self.handle.registerTimer(self._ms(row.ts))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = expiredTimerInfo.getExpiryTimeInMs()
        due = sorted((tuple(k), v[0]) for k, v in self.waiting.iterator() if self._ms(k[0]) <= now)
        current = self.alert.get()
        alert = tuple(current) if current is not None else (None, "none", None)
        made = []

        def change(alert_id, status, at):
            made.append(Row(dedupe_key=key[0], alert_id=alert_id, status=status, at=at))

        for (ts, event), kind in due:
            alert = self._expired(alert, ts, change)
            alert_id, status, ends = alert
            live = status in ("open", "acked")
            if kind == "fire" and not live:
                ends = None if self.expiry is None else ts + timedelta(seconds=self.expiry)
                alert = (event, "open", ends)
                change(event, "open", ts)
                if ends is not None:
                    self.handle.registerTimer(self._ms(ends) + 1)
            elif kind == "ack" and status == "open":
                alert = (alert_id, "acked", ends)
                change(alert_id, "acked", ts)
            elif kind == "resolve" and live:
                alert = (alert_id, "resolved", None)
                change(alert_id, "resolved", ts)
            self.waiting.removeKey((ts, event))
        if alert[2] is not None and self._ms(alert[2]) < now:
            alert = self._expired(alert, alert[2], change)
        self.alert.update(alert)
        return iter(made)

    @staticmethod
    def _expired(alert, ts, change):
        alert_id, status, ends = alert
        if ends is not None and status in ("open", "acked") and ends <= ts:
            change(alert_id, "expired", ends)
            return alert_id, "expired", None
        return alert

    def close(self) -> None:
        pass


def alert_changes(stream: DataFrame, late: str = "1 hour", expiry: int | None = None) -> DataFrame:
    """CHANGES of a stream of EVENTS, each given out when the watermark, `late` behind the latest event, has passed it.

    Rows without a key, an id or a time are dropped. Needs the state store that keeps several states of a key:
    `spark.sql.streaming.stateStore.providerClass` as in STATE_STORE.
    """
    rows = stream.filter("dedupe_key is not null and id is not null and ts is not null").withWatermark("ts", late)
    return rows.groupBy("dedupe_key").transformWithState(AlertLife(expiry), CHANGES, "append", "eventTime")


STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def opened_alerts(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """(dedupe_key, id, ts) of the alerts that a stream of EVENTS opens: a key that has one makes none until it is resolved."""
    return alert_changes(stream, late).filter("status = 'open'").selectExpr("dedupe_key", "alert_id as id", "at as ts")


def evaluated(stream: DataFrame, rules: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, every: str = "10 minutes"):
    """Rules over each micro-batch, what fires appended to Parquet; the batch id makes a rerun recognisable."""

    def batch(rows: DataFrame, batch_id: int) -> None:
        rules(rows).filter("fires").withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(sink)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
