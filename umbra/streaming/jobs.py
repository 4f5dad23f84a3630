"""Streaming forms: rewriting of arriving rows, and the tracker as keyed state."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from umbra.operators import results, tracker


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share, under ``spark.checkpoint.dir``; a folder of
    this machine only where that is unset and Spark runs in one local process. It goes
    when the driver's JVM ends."""
    import tempfile
    import uuid

    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        known = sc._jsc.sc().getCheckpointDir()
        if not known.isDefined():
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a shared folder")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="umbra-"))
            known = sc._jsc.sc().getCheckpointDir()
        base = known.get()
    path = f"{base.rstrip('/')}/umbra-{sc.applicationId}/{name}-{uuid.uuid4().hex}"
    hadoop = sc._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def to_table(stream: DataFrame, name: str) -> DataFrame:
    """What has arrived so far, written by the executors to a Parquet table with exactly
    one copy of each row, and read back."""
    spark = stream.sparkSession
    folder = scratch(spark, name)
    # a query with processing time timeouts would go on making batches without data
    quiet = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(quiet)
    spark.conf.set(quiet, "false")
    try:
        run = stream.writeStream.format("parquet").option("checkpointLocation", scratch(spark, f"{name}-progress")).outputMode("append").trigger(availableNow=True).start(folder)
        run.awaitTermination()
    finally:
        spark.conf.set(quiet, before)
    return spark.read.schema(stream.schema).parquet(folder)


def rewrite_stream(stream: DataFrame, text_col: str = "text", options: results.Options | None = None) -> DataFrame:
    """The batch projection over a stream: stateless, append mode."""
    return results.rewrite_text(stream, text_col, options)


def track_stream(frames: DataFrame, end_after: str = "1 minute", **settings) -> DataFrame:
    """Masks of a stream of frames, ``max_gap`` frames late. State is one tracker per
    video, bounded by its live paths, those that ended lately and the open frames.

    Frames of a micro-batch are sorted. One that doesn't follow, or can't be read, ends
    the video: the masks before it are given, then an error row, and frames that come
    later give error rows too, as masks after a hole could not be trusted. A video from
    which nothing came for ``end_after`` is flushed. Each last row of a micro-batch has
    the counters so far and the gaps noted since the one before."""
    wait = {"second": 1000, "minute": 60_000, "hour": 3_600_000}
    n, unit = end_after.split()
    millis = int(n) * wait[unit.rstrip("s")]

    def run(key, pdfs, state: GroupState):
        import pandas as pd

        t, over = tracker.Tracker(**settings), None
        if state.exists:
            saved = json.loads(state.get[0])
            over = saved["error"]
            t.load(saved["tracker"])
        if state.hasTimedOut:
            rows = [] if over else t.flush()
            state.remove()
            yield tracker.mask_rows(key[0], rows, json.dumps({**t.stats(), "unresolved_gaps": t.take_gaps()}), None)
            return
        arrived = pd.concat(list(pdfs)).sort_values("frame_index")
        if over:
            rows, error = [], f"the video ended before: {over}"
        else:
            rows, error = tracker.push_all(t, arrived[["frame_index", "detections"]].itertuples(index=False))
            over = error
        stats = json.dumps({**t.stats(), "unresolved_gaps": t.take_gaps()}) if rows else None
        state.update((json.dumps({"tracker": t.dump(), "error": over}),))
        state.setTimeoutDuration(millis)
        yield tracker.mask_rows(key[0], rows, stats, error)

    return frames.groupBy("video_id").applyInPandasWithState(run, tracker.MASKS, "state string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def entity_counts_stream(stream: DataFrame, time_col: str, window: str = "5 minutes", late: str = "10 minutes", text_col: str = "text", options: results.Options | None = None) -> DataFrame:
    """Entities per label and window of event time; late rows within the watermark."""
    found = rewrite_stream(stream.withWatermark(time_col, late), text_col, options)
    each = found.select(time_col, F.explode("entities.entity_type").alias("entity_type"))
    return each.groupBy(F.window(time_col, window), "entity_type").count()
