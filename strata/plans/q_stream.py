"""Query: streaming TTL dedupe (T1); must equal the batch H7 result."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources.tables import table
from ..streaming.ttl import EPOCH_NTZ, run_in_order, ttl_dedupe_stream
from .catalog import query
from .q_cache import TS_FMT, TTL_SQL


@query("ttl_dedupe_stream", TTL_SQL, kind="R")
def q_ttl_dedupe_stream(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts")
    base = scratch_path(spark, "ttl-stream")
    out = run_in_order(spark, events, lambda stream: ttl_dedupe_stream(stream, ["user_id", "event_type"]), base)
    ts = F.timestamp_add("MICROSECOND", F.col("t_us"), F.expr(EPOCH_NTZ))
    return out.select("user_id", "event_type", "event_id", F.date_format(ts, TS_FMT).alias("ts"))
