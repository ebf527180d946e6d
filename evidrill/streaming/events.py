"""Streams: the audit relay's event log, per-session completeness, batch retrieval on request streams, and windows.

Windows over event time are an extension; the relay is what the online service does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: The stages that report, in the order in which they end.
NODES = ("router", "retriever", "generator", "auditor")


def relay_events(requests: DataFrame, boundary: Column, failed: Column) -> DataFrame:
    """(session_id, seq, type, node): start, an update for each stage, done; a refusal updates the auditor alone, an
    error ends the session. Works on batch and streaming input alike."""
    event = lambda kind, node=None: F.struct(F.lit(kind).alias("type"), F.lit(node).cast("string").alias("node"))
    updates = [event("node_update", n) for n in NODES]
    whole = F.when(failed, F.array(event("start"), event("error"))).when(boundary, F.array(event("start"), updates[-1], event("done"))).otherwise(F.array(event("start"), *updates, event("done")))
    return requests.select("session_id", F.posexplode(whole).alias("seq", "e")).select("session_id", "seq", "e.type", "e.node")


def reassemble(pieces: DataFrame) -> DataFrame:
    """(session_id, seq, line) of a session's stream that came in ``pieces(session_id, piece, data)`` cut anywhere.

    A session's pieces are one response, which is short; what follows its last line end is a line that never ended and
    is left out.
    """
    whole = pieces.groupBy("session_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece", "data"))), lambda x: x["data"]), "").alias("t"))
    lines = F.split("t", r"\r?\n")
    ended = F.slice(lines, 1, F.size(lines) - 1)
    return whole.select("session_id", F.posexplode(ended).alias("seq", "line")).where("line <> ''")


def parse_events(lines: DataFrame) -> DataFrame:
    """Server-sent lines (session_id, seq, line) as events; malformed data lines are skipped."""
    data = lines.where(F.col("line").startswith("data:")).select("session_id", "seq", F.from_json(F.trim(F.substr("line", F.lit(6))), "type string, node string").alias("e"))
    return data.where("e.type IS NOT NULL").select("session_id", "seq", "e.type", "e.node")


def session_state(events: DataFrame) -> DataFrame:
    """Per session: updates, and whether it ended well; without ``done`` it is an error."""
    g = events.groupBy("session_id").agg(F.count_if(F.col("type") == "node_update").alias("updates"), F.bool_or(F.col("type") == "done").alias("done"), F.bool_or(F.col("type") == "error").alias("error"))
    return g.select("session_id", "updates", F.when(F.col("error") | ~F.col("done"), "error").otherwise("done").alias("state"))


def run_on_requests(requests: DataFrame, retrieve: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch of requests goes through the batch plan; a batch that runs again overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        retrieve(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events and values by type and window of event time; state older than the watermark is dropped."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sliding_counts(events: DataFrame, width: str = "2 days", slide: str = "1 day", late: str = "1 hour") -> DataFrame:
    g = events.withWatermark("ts", late).groupBy(F.window("ts", width, slide), "event_type").agg(F.count("*").alias("n"))
    return g.select(F.col("window.start").alias("window_start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "1 hour", late: str = "1 hour") -> DataFrame:
    g = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def without_repeats(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """First event of each key, on streams within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])
