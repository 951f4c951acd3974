"""Subscriptions: a stream of events, each enriched like a query of its own.

The stream is joined with static sources by key, which keeps no state, so events stay independent.
Time zones are the session's; event times without one are cast, as watermarks need it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def event_time(df: DataFrame) -> DataFrame:
    """Timestamps without a time zone, as timestamps."""
    return df.select(*[F.col(f"`{f.name}`").cast("timestamp").alias(f.name) if isinstance(f.dataType, T.TimestampNTZType) else F.col(f"`{f.name}`") for f in df.schema.fields])


class Subscriptions:
    """Running subscriptions, shared by equal fingerprints; a schema swap ends them all."""

    def __init__(self):
        self.running: dict[str, StreamingQuery] = {}
        self.listeners: dict[str, list] = {}
        self.ended: dict[str, str] = {}  # fingerprint -> why its stream was ended from outside

    def start(self, fingerprint: str, df: DataFrame, checkpoint: str, *, sink: str = "memory", name: str | None = None, options: dict[str, str] | None = None, each_batch=None, available_now: bool = True) -> StreamingQuery:
        live = self.running.get(fingerprint)
        if live is not None and live.isActive:
            return live
        w = df.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
        w = w.trigger(availableNow=True) if available_now else w
        for k, v in (options or {}).items():
            w = w.option(k, v)
        if name:
            w = w.queryName(name)
        w = w.foreachBatch(each_batch) if each_batch is not None else w.format(sink)
        self.running[fingerprint] = w.start()
        return self.running[fingerprint]

    def listen(self, fingerprint: str, df: DataFrame, checkpoint: str, listener, *, available_now: bool = True) -> StreamingQuery:
        """One running query for all listeners of a fingerprint: each micro-batch is given to every
        ``listener(batch, batch_id)``. A listener that raises is an error event: the stream stops."""
        heard = self.listeners.setdefault(fingerprint, [])
        live = self.running.get(fingerprint)
        if live is None or not live.isActive:
            heard.clear()
        heard.append(listener)

        def tell(batch: DataFrame, number: int) -> None:
            kept = batch.persist() if len(heard) > 1 else batch
            try:
                for each in list(heard):
                    each(kept, number)
            finally:
                if kept is not batch:
                    kept.unpersist()

        return self.start(fingerprint, df, checkpoint, each_batch=tell, available_now=available_now)

    def error(self, fingerprint: str) -> tuple[str, str] | None:
        """(code, message) of the error that ended a subscription, if one did."""
        if fingerprint in self.ended:
            return "SUBSCRIPTION_SCHEMA_RELOAD", self.ended[fingerprint]
        q = self.running.get(fingerprint)
        e = None if q is None or q.isActive else q.exception()
        return None if e is None else ("SUBSCRIPTION_ERROR", str(e))

    def end_all(self, why: str = "the schema was replaced") -> int:
        n = 0
        for k, q in self.running.items():
            if q.isActive:
                q.stop()
                self.ended[k] = why
                n += 1
        self.running.clear()
        self.listeners.clear()
        return n
