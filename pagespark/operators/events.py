"""Event logs: cleaning, windows, sessions, streaks, rolling rates, tails.

Running values of a key are put together from stretches of its order (ids by the hundred thousand, times by the day): a
window per stretch, and one over the sums of the stretches before it.  So a key with a third of all events is spread
over as many tasks as it has stretches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ids of one stretch, and seconds of one stretch of times.
IDS, SECONDS = 100_000, 86_400


def seconds(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.unix_seconds(c.cast("timestamp"))


def by_id(name: str) -> Column:
    return F.floor(F.col(name) / IDS)


def by_time(name: str) -> Column:
    """Day of a time; events without one form a stretch before all others."""
    return F.coalesce(F.floor(seconds(name) / SECONDS), F.lit(-(2**40)))


def before_stretch(rows: DataFrame, key: str, stretch: Column, value: Column, fold) -> DataFrame:
    """The rows with ``_part`` (their stretch) and ``_before``: ``fold`` of the values of the key's stretches before it, NULL for the first."""
    rows = rows.withColumn("_part", stretch)
    parts = rows.groupBy(key, "_part").agg(value.alias("_own"))
    w = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(parts.select(key, "_part", fold("_own").over(w).alias("_before")), [key, "_part"])


def cleaned(events: DataFrame) -> DataFrame:
    """One row per id, level in lower case."""
    return events.dropDuplicates(["id"]).withColumn("level", F.lower(F.trim("level")))


def late(events: DataFrame, hours: int = 1) -> DataFrame:
    """Events whose time lies more than ``hours`` before the latest time that arrived earlier in their book."""
    rows = before_stretch(events.where("book is not null"), "book", by_id("id"), F.max("ts"), F.max)
    w = Window.partitionBy("book", "_part").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    seen = rows.withColumn("_seen", F.greatest("_before", F.max("ts").over(w)))
    return seen.withColumn("behind_s", seconds("_seen") - seconds("ts")).where(F.col("behind_s") > hours * 3600).drop("_seen", "_part", "_before")


def tumbling(events: DataFrame, width: str, by: str = "level") -> DataFrame:
    w = F.window("ts", width)
    return events.groupBy(w.alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def sliding(events: DataFrame, width: str, step: str, by: str) -> DataFrame:
    w = F.window("ts", width, step)
    return events.groupBy(w.alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def sessions(events: DataFrame, gap_s: int, key: str, order: list[str]) -> DataFrame:
    """(key, session, start, end, n): runs of events of a key with no gap over ``gap_s`` seconds."""
    rows = before_stretch(events.where(F.col(key).isNotNull()), key, by_time("ts"), F.max("ts"), F.last)
    w = Window.partitionBy(key, "_part").orderBy("ts", *order)
    previous = F.when(F.row_number().over(w) == 1, F.col("_before")).otherwise(F.lag("ts").over(w))
    marked = rows.withColumn("_new", F.coalesce((seconds("ts") - seconds(previous) > gap_s).cast("int"), F.lit(1))).drop("_before", "_part")
    sums = before_stretch(marked, key, by_time("ts"), F.sum("_new"), F.sum)
    numbered = sums.withColumn("session", F.coalesce("_before", F.lit(0)) + F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "session").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n"))


def streaks(events: DataFrame, key: str, failed: Column, least: int, order: str) -> DataFrame:
    """(key, start, n): runs of at least ``least`` failures of a key in a row, by a number that orders its events."""
    bad = events.where(F.col(key).isNotNull()).withColumn("_bad", failed)
    rows = before_stretch(bad, key, by_id(order), F.count_if(~F.col("_bad")), F.sum)
    w = Window.partitionBy(key, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    island = rows.withColumn("_island", F.coalesce("_before", F.lit(0)) + F.sum((~F.col("_bad")).cast("int")).over(w)).where("_bad")
    return island.groupBy(key, "_island").agg(F.min(order).alias("start"), F.count("*").alias("n")).where(F.col("n") >= least).drop("_island")


def rolling(events: DataFrame, key: str, span: int, out: str = "n") -> DataFrame:
    """Each event with the number of events of its key in the ``span`` seconds before it, itself included.

    Every event is counted in its own stretch of ``span`` seconds and lent to the next one, which holds all it can see.
    """
    own = F.floor(seconds("ts") / span)
    rows = events.where(F.col(key).isNotNull()).withColumn("_s", seconds("ts")).withColumn("_c", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_part", own + F.col("_c"))
    w = Window.partitionBy(key, "_part").orderBy("_s").rangeBetween(-span, 0)
    return rows.withColumn(out, F.count("*").over(w)).where("_c = 0").drop("_c", "_part", "_s")


def tail(events: DataFrame, n: int) -> DataFrame:
    """The last ``n`` events, oldest first."""
    return events.orderBy(F.desc("id")).limit(n).orderBy("id")
