"""Chunk streams closed by their own end (I5, streaming form).

State is kept by request: the parts received so far as a list, and a small record of what is known of
the stream's end. A response goes out once the end marker has arrived (the finish reason, or the usage
report that some providers send after it) and no chunk before it is missing, however long the stream
paused. A stream that never completes goes out by an event-time timer: ``grace`` after its last chunk if
some marker came, ``abandon`` after it otherwise; ``closed_by`` says which. Chunks that arrive for a
response already given out start a new one, which the second timer closes.

Chunks carry consecutive indices from 0 and arrive once, in any order. Each micro-batch's neighbouring
chunks of a request are stored as one part, so the list holds blocks, not single chunks; it is read
only when the response goes out, whose row holds the whole text anyway.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

OUTPUT = (
    "request_id bigint, content string, reasoning string, completion_tokens bigint, finish_reason string, "
    "n_chunks bigint, closed_by string"
)
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _processor(until: str, grace_ms: int, abandon_ms: int) -> StatefulProcessor:
    # defined here so that executors get the class with the job and need not import this package
    class Chunks(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.end = handle.getValueState(
                "end", "n bigint, top bigint, usage_idx bigint, usage bigint, finish_idx bigint, finish string, last bigint, due bigint"
            )
            self.parts = handle.getListState("parts", "first bigint, content string, reasoning string")

        def handleInputRows(self, key, rows, timerValues):
            known = self.end.get()
            s = list(known) if known is not None else [0, -1, None, None, None, None, 0, None]
            first, previous, content, reasoning = None, None, [], []
            for r in sorted(rows, key=lambda r: r.idx):
                if previous is not None and r.idx != previous + 1:
                    self.parts.appendValue((first, "".join(content), "".join(reasoning)))
                    first, content, reasoning = None, [], []
                first = r.idx if first is None else first
                previous = r.idx
                content.append(r.content or "")
                reasoning.append(r.reasoning or "")
                s[0] += 1
                s[1] = max(s[1], r.idx)
                if r.completion_tokens is not None and (s[2] is None or r.idx >= s[2]):
                    s[2], s[3] = r.idx, r.completion_tokens
                if r.finish_reason is not None and (s[4] is None or r.idx >= s[4]):
                    s[4], s[5] = r.idx, r.finish_reason
                s[6] = max(s[6], r.at_ms)
            if previous is not None:
                self.parts.appendValue((first, "".join(content), "".join(reasoning)))
            if s[7] is not None:
                self.handle.deleteTimer(s[7])
            if s[2 if until == "usage" else 4] is not None and s[0] == s[1] + 1:
                yield self.give_out(key, s, "end")
                return
            s[7] = s[6] + (abandon_ms if s[2] is None and s[4] is None else grace_ms)
            self.handle.registerTimer(s[7])
            self.end.update(tuple(s))

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            known = self.end.get()
            if known is not None and known[7] is not None and known[7] <= expiredTimerInfo.getExpiryTimeInMs():
                yield self.give_out(key, list(known), "timer")

        def give_out(self, key, s, by):
            parts = sorted(tuple(p) for p in self.parts.get())
            self.end.clear()
            self.parts.clear()
            return Row(
                request_id=key[0], content="".join(p[1] for p in parts), reasoning="".join(p[2] for p in parts) or None,
                completion_tokens=s[3], finish_reason=s[5], n_chunks=s[0], closed_by=by,
            )

        def close(self):
            pass

    return Chunks()


def collapse_chunk_streams(
    stream: DataFrame, event_time: str, until: str = "usage", delay: str = "10 minutes", grace_minutes: int = 10, abandon_minutes: int = 24 * 60,
) -> DataFrame:
    """One response per request: request_id, content, reasoning, completion_tokens, finish_reason, n_chunks, closed_by.

    ``stream``: (request_id, idx, content, reasoning, completion_tokens, finish_reason, <event_time>). ``until`` names
    the marker that ends a stream, ``usage`` or ``finish``. Needs the RocksDB state store (set on the session here)."""
    if until not in ("usage", "finish"):
        raise ValueError(f"until must be 'usage' or 'finish', not {until!r}")
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = stream.withWatermark(event_time, delay).selectExpr(
        "CAST(request_id AS BIGINT) AS request_id", "CAST(idx AS BIGINT) AS idx", "content", "reasoning",
        "CAST(completion_tokens AS BIGINT) AS completion_tokens", "finish_reason", f"unix_millis({event_time}) AS at_ms", event_time,
    )
    return rows.groupBy("request_id").transformWithState(
        _processor(until, grace_minutes * 60_000, abandon_minutes * 60_000), OUTPUT, "Append", "EventTime"
    )
