"""Streaming intake over the events table, read as a file stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import shared_folder
from ..streaming import intake as W
from .registry import query


def _stream(t, name):
    """The files of a table as a stream; everything available is processed, then the query ends."""
    schema = getattr(t, name).schema
    return t.spark.readStream.schema(schema).parquet(f"{t.root}/{name}*.parquet")


def _folder(t, name):
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


@query("stream_ingest", "W1", """
SELECT user_id, event_id % 3 AS attachment, event_type, MIN(event_id) AS arrived FROM events GROUP BY ALL""")
def stream_ingest(t):
    events = _stream(t, "events").select("user_id", (F.col("event_id") % 3).alias("attachment"), "event_type", F.col("event_id").alias("arrived"))
    keyed = events.withColumn("key", W.attachment_key(F.col("user_id"), F.col("attachment"), F.col("event_type"), F.sha2("event_type", 256)))
    folder = _folder(t, "attachments")
    W.keep_new(keyed, f"{folder}/ledger", f"{folder}/checkpoint").awaitTermination()
    return W.read_ledger(t.spark, f"{folder}/ledger", keyed.schema).select("user_id", "attachment", "event_type", "arrived")


@query("stream_checked", "W2 W3", """
SELECT user_id, SHA1(user_id || '::INBOX::ALL::protocol') AS key FROM (SELECT DISTINCT user_id FROM events)""")
def stream_checked(t):
    messages = _stream(t, "events").select("user_id", F.col("event_id").alias("arrived"), W.checked_key(F.col("user_id"), "INBOX", "ALL", "protocol").alias("key"))
    folder = _folder(t, "checked")
    W.keep_new(messages, f"{folder}/ledger", f"{folder}/checkpoint").awaitTermination()
    return W.read_ledger(t.spark, f"{folder}/ledger", messages.schema).select("user_id", "key")


@query("stream_status", "W4", """
SELECT user_id AS doc_id, ARG_MAX(event_type, event_id) AS status, MAX(event_id) AS updated_at FROM events GROUP BY user_id""")
def stream_status(t):
    results = _stream(t, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("updated_at"), F.col("event_type").alias("status"))
    folder = _folder(t, "status")
    W.keep_latest(results, folder, f"{folder}/checkpoint").awaitTermination()
    return W.current_version(t.spark, folder, results.schema)
