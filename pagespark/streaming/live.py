"""Live forms of the event queries on Structured Streaming."""

from __future__ import annotations

import os
import re
import tempfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "id bigint, ts timestamp_ntz, book string, level string, message string"


def events_stream(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """Event files as a stream, cleaned as in batch: level in lower case, event time as a timestamp.

    The last letter stands as a pattern, so that the path may be a folder of files or one file.
    """
    src = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path[:-1]}[{path[-1]}]")
    return src.withColumn("level", F.lower(F.trim("level"))).withColumn("ts", F.col("ts").cast("timestamp"))


def counted(events: DataFrame, width: str = "1 day", delay: str | None = None) -> DataFrame:
    """Events per window and level; an id counts once.

    Without a ``delay`` nothing is ever too late, as in batch: the state keeps every id.  With one the state is bounded,
    and events further behind than that are dropped.
    """
    once = events.dropDuplicates(["id"]) if delay is None else events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["id"])
    g = once.groupBy(F.window("ts", width).alias("w"), "level").agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "level", "n")


def breaker(events: DataFrame, limit: int = 2) -> DataFrame:
    """(book, id, n): every time a book has failed ``limit`` times in a row; the count starts again after that.

    The state of a book is one number.  Within a batch events go by id; a success sets the count back.
    """

    def step(key, frames, state: GroupState):
        run = state.get[0] if state.exists else 0
        pdf = pd.concat(list(frames)).drop_duplicates("id").sort_values("id", kind="stable")
        out = []
        for i, level in zip(pdf["id"], pdf["level"]):
            run = run + 1 if level == "error" else 0
            if run >= limit:
                out.append((key[0], i, run))
                run = 0
        state.update((run,))
        yield pd.DataFrame(out, columns=["book", "id", "n"])

    named = events.where(F.col("book").isNotNull()).select("book", "id", "level")
    return named.groupBy("book").applyInPandasWithState(step, "book string, id long, n long", "run long", "append", GroupStateTimeout.NoTimeout)


def _shared(spark: SparkSession) -> str:
    """A new folder under the cluster's shared checkpoint folder; a local one only where none is set in a local session (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if base is None:
        return tempfile.mkdtemp(prefix="pagespark-stream-")
    return os.path.join(base, f"stream-{os.urandom(8).hex()}")


def run_once(stream: DataFrame, mode: str) -> DataFrame:
    """Process what is there and return the result table; the sink replaces (complete) or adds (append) per batch.

    A batch is written under its number, so a batch that is run again after a failure replaces itself.
    """
    spark = stream.sparkSession
    home = _shared(spark)

    def sink(df: DataFrame, batch: int) -> None:
        part = 0 if mode == "complete" else batch
        df.write.mode("overwrite").parquet(f"{home}/out/batch={part}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).foreachBatch(sink).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{home}/out").select(*stream.columns)
