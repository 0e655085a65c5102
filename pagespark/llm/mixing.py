"""Problem 9: mixing sources to target weights.

Method: hash-threshold histograms.  Every document gets a 64-bit hash; tokens are
summed by source and leading hash digits, the bucket where a source's budget ends is
found from the running sums, and only that bucket is summed again by the next
digits, until it holds one hash.  A document is then taken iff its hash lies below
its source's threshold: a filter, no sort.  Thresholds are nested: a smaller
budget takes a subset of the documents of a larger one.

A source whose budget exceeds its size is used whole as often as it fits and once
more below the threshold, at most ``max_repeats`` times.  Without a given total the
mixture is the largest in which every source that has documents gets its weight.

Targets, histograms and thresholds stay tables: any number of sources will do, and
the driver sees one number, the total.  A window over a source holds its histogram,
at most 16 to the power of ``STEP`` buckets.

Defined results: documents of NULL or unlisted sources, NULL text or no tokens are
never used; a listed source without documents is reported with share 0 and does
not limit the others; weights are normalised, those of NULL or at
most 0 are left out; max_repeats NULL counts as 1; equal hashes are taken
together, and a threshold never exceeds its budget.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage

#: Hex digits by which each histogram refines one bucket of the one before, and digits of a hash.
STEP, DIGITS = 3, 16
#: A table of targets of at most this many rows is sent to all tasks, a longer one is joined by source.
SMALL = 10_000
#: Above every hash.
ALL = "g"


def hashed(docs: DataFrame, key: str = "doc_id", source: str = "source", size: str = "tokens", seed: str = "mix") -> DataFrame:
    """(key, source, size, h) with h the hash as 16 hex digits, whose order is the order of the unsigned number."""
    h = F.lpad(F.lower(F.hex(F.xxhash64(F.lit(seed), F.col(key)))), DIGITS, "0")
    return docs.where(F.col(source).isNotNull() & (F.col(size) > 0)).select(key, source, size, h.alias("h"))


def targets_of(targets: DataFrame) -> DataFrame:
    """(source, weight, max_repeats), one row per source with weights that sum to 1."""
    rows = targets.where(F.col("source").isNotNull() & (F.col("weight") > 0)).groupBy("source").agg(F.sum("weight").alias("weight"), F.max("max_repeats").alias("max_repeats"))
    total = rows.agg(F.sum("weight")).first()[0]
    return rows.select("source", (F.col("weight") / F.lit(total)).alias("weight"), F.greatest(F.lit(0), F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))


def to_all(small: DataFrame) -> DataFrame:
    """Marked to be sent to all tasks if it has at most ``SMALL`` rows."""
    return F.broadcast(small) if small.limit(SMALL + 1).count() <= SMALL else small


def plan(rows: DataFrame, targets: DataFrame, total: float | None = None, source: str = "source", size: str = "tokens") -> DataFrame:
    """(source, weight, max_repeats, available, budget, whole, threshold): documents below the threshold get one use more than ``whole``."""
    wanted = to_all(targets.select(F.col("source").alias(source)))
    own = rows.groupBy(source).agg(F.sum(size).alias("available"))
    there = cut_lineage(targets.withColumnRenamed("source", source).join(own, source, "left").withColumn("available", F.coalesce("available", F.lit(0))))
    limit = F.col("available") * F.col("max_repeats")
    if total is None:
        total = there.where(limit > 0).agg(F.min(limit / F.col("weight"))).first()[0] or 0.0
    budget = F.least(F.col("weight") * F.lit(float(total)), limit.cast("double"))
    there = there.withColumn("budget", budget).withColumn("whole", F.when(F.col("available") > 0, F.floor(F.col("budget") / F.col("available"))).otherwise(0).cast("int"))
    state = there.where("available > 0").select(source, F.lit("").alias("prefix"), (F.col("budget") - F.col("whole") * F.col("available")).alias("rest"))
    mine = rows.join(wanted, source, "left_semi")
    done: DataFrame | None = None
    for digits in [*range(STEP, DIGITS, STEP), DIGITS]:
        inside = mine.join(to_all(state), source).where(F.col("h").startswith(F.col("prefix")))
        hist = inside.groupBy(source, F.substring("h", 1, digits).alias("b")).agg(F.sum(size).alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi"), F.first("rest").alias("rest"))
        run = hist.withColumn("upto", F.sum("n").over(Window.partitionBy(source).orderBy("b")))
        edge = run.where(F.col("upto") > F.col("rest")).groupBy(source).agg(F.min_by(F.struct("b", "n", "lo", "hi", "upto"), "b").alias("e"))
        step = cut_lineage(state.join(edge, source, "left"))
        one = F.when(F.col("e").isNull(), F.lit(ALL)).when(F.col("e.lo") == F.col("e.hi"), F.col("e.lo"))
        ended = step.where(one.isNotNull()).select(source, one.alias("threshold"))
        done = ended if done is None else done.unionByName(ended)
        state = step.where(one.isNull()).select(source, F.col("e.b").alias("prefix"), (F.col("rest") - F.col("e.upto") + F.col("e.n")).alias("rest"))
        if state.isEmpty():
            break
    return cut_lineage(there.join(done, source, "left").withColumn("threshold", F.coalesce("threshold", F.lit(""))))


def mix(rows: DataFrame, p: DataFrame, key: str = "doc_id", source: str = "source", size: str = "tokens") -> DataFrame:
    """(key, source, tokens, uses) of every document that is used."""
    cut = to_all(p.select(source, "whole", "threshold"))
    uses = F.col("whole") + (F.col("h") < F.col("threshold")).cast("int")
    return rows.join(cut, source).withColumn("uses", uses).where(F.col("uses") > 0).select(key, source, size, "uses")


def shares(mixed: DataFrame, p: DataFrame, source: str = "source", size: str = "tokens") -> DataFrame:
    """(source, weight, used_tokens, share, most_uses) of every target source, used or not."""
    used = cut_lineage(mixed.groupBy(source).agg(F.sum(F.col(size) * F.col("uses")).alias("used_tokens"), F.max("uses").alias("most_uses")))
    total = used.agg(F.sum("used_tokens")).first()[0] or 0
    joined = p.select(source, "weight").join(used, source, "left").fillna(0, ["used_tokens", "most_uses"])
    return joined.select(source, "weight", "used_tokens", (F.col("used_tokens") / F.lit(float(total)) if total else F.lit(0.0)).alias("share"), "most_uses")


def mixture(docs: DataFrame, targets: DataFrame, total: float | None = None, key: str = "doc_id", source: str = "source", size: str = "tokens") -> tuple[DataFrame, DataFrame]:
    """(documents with their uses, report of shares)."""
    rows = cut_lineage(hashed(docs, key, source, size))
    p = plan(rows, cut_lineage(targets_of(targets)), total, source, size)
    used = mix(rows, p, key, source, size)
    return used, shares(used, p, source, size)
