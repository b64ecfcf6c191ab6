"""TTL dedupe of an unbounded request stream.

Per key the state is the timestamp of the last *kept* request (the anchor).
A request is kept when it is at least ``ttl`` after the anchor (strict
``age < ttl`` is a hit, and a hit does not renew the anchor). Within a
micro-batch the rows of a key are sorted by (time, id) so that the stream
gives the batch result whenever requests reach a key in time order.

A call of Python costs far more than a row, so it serves a bucket of keys: the
state of a bucket is the anchors of its keys.

An anchor is dropped once the watermark passes ``anchor + ttl``, with the next
rows of its bucket or, for the whole bucket, by an event-time timeout: after that
point any in-order request is kept anyway, so the anchor is no longer needed. (``dropDuplicatesWithinWatermark`` is the
cheap built-in variant, but it expires entries on a different rule.)
"""

from __future__ import annotations

import math
import os

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions.dims import CACHE_TTL_SECONDS

#: Rows of one micro-batch of ``run_in_order``, about: all that a key can have in one frame.
SLICE_ROWS = 1_000_000
#: Groups of keys with a state each. A checkpoint is read with the number that it was written with.
BUCKETS = 1024
#: Keys travel as JSON.
JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
EPOCH_NTZ = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def _ttl_fn(ttl_us: int, out_cols: list[str]):
    def fn(bucket, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        frames = [p for p in pdfs if len(p)]
        if not frames:
            return
        anchors = dict(zip(*state.get)) if state.exists else {}
        rows = pd.concat(frames).sort_values(["t_us", "event_id"], kind="mergesort")
        keep = []
        for key, t in zip(rows["_key"].tolist(), rows["t_us"].tolist()):
            anchor = anchors.get(key)
            keep.append(anchor is None or t - anchor >= ttl_us)
            if keep[-1]:
                anchors[key] = t
        watermark = state.getCurrentWatermarkMs()
        live = {k: t for k, t in anchors.items() if (t + ttl_us) // 1000 > watermark}
        if live:
            state.update((list(live), list(live.values())))
            state.setTimeoutTimestamp((max(live.values()) + ttl_us) // 1000)
        elif state.exists:
            state.remove()
        yield rows.loc[keep, out_cols]
    return fn


def ttl_dedupe_stream(stream: DataFrame, keys: list[str], ts: str = "ts", eid: str = "event_id",
                      ttl_seconds: int = CACHE_TTL_SECONDS, lateness: str = "1 day") -> DataFrame:
    """Streaming DataFrame of the kept rows: keys, event id, ``t_us``
    (microseconds since the epoch of ``ts``).

    ``lateness`` is the contract of the input: Spark leaves out rows that are
    older than the watermark (the largest time seen, less ``lateness``) and
    counts them in the progress metric ``numRowsDroppedByWatermark``; set it
    to the largest delay the source can have."""
    s = stream.select(*keys, eid, F.timestamp_diff("MICROSECOND", F.expr(EPOCH_NTZ), F.col(ts)).alias("t_us"),
                      F.col(ts).cast("timestamp").alias("_wm"))
    s = s.withWatermark("_wm", lateness)
    key = F.struct(*keys)
    # null keys and large numbers pass pandas as text
    s = s.select(F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).alias("_bucket"), F.to_json(key, JSON).alias("_key"), eid, "t_us", "_wm")
    out_schema = T.StructType([T.StructField("_key", T.StringType()), T.StructField(eid, T.LongType()), T.StructField("t_us", T.LongType())])
    state_schema = T.StructType([T.StructField("keys", T.ArrayType(T.StringType())), T.StructField("anchors_us", T.ArrayType(T.LongType()))])
    out_cols = ["_key", eid, "t_us"]
    kept = s.groupBy("_bucket").applyInPandasWithState(
        _ttl_fn(ttl_seconds * 1_000_000, out_cols), out_schema, state_schema, "append",
        GroupStateTimeout.EventTimeTimeout)
    types = T.StructType([f for f in stream.select(*keys).schema.fields])
    return kept.select(F.from_json("_key", types, JSON).alias("_key"), eid, "t_us").select("_key.*", eid, "t_us")


def run_to_table(spark, streaming_df: DataFrame, out_path: str, checkpoint: str) -> DataFrame:
    """Run a stream with ``availableNow`` into a parquet table under the
    shared checkpoint folder and return the table as a batch DataFrame."""
    q = (streaming_df.writeStream.format("parquet").option("path", out_path)
         .option("checkpointLocation", checkpoint).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(streaming_df.schema).parquet(out_path)


def run_in_order(spark, events: DataFrame, transform, base: str, ts: str = "ts", eid: str = "event_id") -> DataFrame:
    """Stream a table of any size and file order through ``transform`` in time order.

    Spark cuts the rows into ranges of (time, id) of about SLICE_ROWS rows; each range is appended to the stream's
    source folder and run as its own micro-batches, with the state carried over by the checkpoint. So no row is late,
    and no task holds more rows of a key than a range has."""
    slices = max(1, math.ceil(events.count() / SLICE_ROWS))
    cut, source = os.path.join(base, "cut"), os.path.join(base, "in")
    ranged = events.repartitionByRange(slices, ts, eid) if slices > 1 else events
    number = F.spark_partition_id() if slices > 1 else F.lit(0)
    ranged.withColumn("_slice", number).write.partitionBy("_slice").parquet(cut)
    layout = T.StructType([*events.schema.fields, T.StructField("_slice", T.IntegerType())])
    table = spark.read.schema(layout).parquet(cut)
    last = table.agg(F.max("_slice")).first()[0] or 0  # a session may cut more ranges than asked for
    for n in range(last + 1):
        rows = table.where(F.col("_slice") == n).drop("_slice")
        rows.write.mode("append").parquet(source)
        kept = transform(spark.readStream.schema(events.schema).parquet(source))
        out = run_to_table(spark, kept, os.path.join(base, "out"), os.path.join(base, "chk"))
    return out
