"""Problem 8: filling fixed-capacity containers with items.

Method: sum-of-squares online packing.  A level array counts the open containers
by their fill; every item goes to the fill level (or an empty container) that
makes the sum of the squared counts of partially filled containers least.  An
item larger than the capacity is cut into full containers and a rest; the rest is
packed like any other item.

Items are spread over streams by a hash of their key, each packing its own
containers, so a stream holds about ``per_stream`` items whatever the total and
no task sees a hot group.  The containers a stream leaves less than
``settled`` full are packed again, as whole items, across streams.

Defined results: items of NULL or no size take no room and go to no container
(they are returned with container NULL); ties go to the fullest level; an item is
cut only if it alone exceeds the capacity; an empty table gives no rows; items
delivered twice are packed twice unless ``distinct``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

CAPACITY = 2_048
#: Items per stream: enough for the level counts to settle, few enough for one task.
PER_STREAM = 20_000
#: Containers at least this full are left as they are.
SETTLED = 0.995


def pack(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Container number of every item of 1..capacity, in order of arrival."""
    counts = np.zeros(capacity + 1, np.int64)  # open containers by fill level; 0 and capacity are never counted
    open_at: list[list[int]] = [[] for _ in range(capacity)]
    out = np.empty(len(sizes), np.int64)
    made = 0
    cost = np.empty(capacity + 1, np.int64)
    never = np.iinfo(np.int64).max
    for i, s in enumerate(sizes.tolist()):
        # a container going from level h to h + s adds 2 n[h+s] + 1 and takes 2 n[h] - 1 off the sum of squares
        room = capacity - s
        levels = counts[: room + 1]
        c = cost[: room + 1]
        np.subtract(counts[s:], levels, out=c)
        c *= 2
        c += 2
        c[room] = 1 - 2 * levels[room]  # a full container is not counted
        c[levels == 0] = never
        c[0] = 2 * counts[s] + 1 if s < capacity else 0  # an empty container
        h = room - int(c[::-1].argmin())  # ties: the fullest level
        if h == 0:
            box = made
            made += 1
        else:
            box = open_at[h].pop()
            counts[h] -= 1
        if h + s < capacity:
            open_at[h + s].append(box)
            counts[h + s] += 1
        out[i] = box
    return out


def pieces(items: DataFrame, key: str, size: str, capacity: int = CAPACITY) -> DataFrame:
    """(key, piece_no, start, length): full containers of oversized items and the rest of every item; length 0 for items of no size."""
    own = F.greatest(F.lit(0), F.coalesce(F.col(size), F.lit(0))).cast("long")
    rows = items.select(key, own.alias("_size"))
    n = F.greatest(F.lit(1), F.ceil(F.col("_size") / capacity)).cast("int")
    rows = rows.select(key, "_size", F.explode(F.sequence(F.lit(0), n - 1)).alias("piece_no"))
    start = F.col("piece_no").cast("long") * capacity
    return rows.select(key, "piece_no", start.alias("start"), F.least(F.lit(capacity).cast("long"), F.col("_size") - start).alias("length"))


def _pack_streams(rows: DataFrame, ids: list[str], streams: int, capacity: int, prefix: str) -> DataFrame:
    types = dict(rows.dtypes)
    head = ", ".join(f"{c} {types[c]}" for c in ids)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_order", *ids], kind="stable")
        box = pack(pdf["length"].to_numpy(np.int64), capacity)
        out = pdf[[*ids, "length"]].copy()
        stream = int(pdf["_stream"].iloc[0])
        out["container"] = [f"{prefix}{stream}-{b}" for b in box]
        return out

    h = F.xxhash64(*ids)
    keyed = rows.select(*ids, "length", F.pmod(h, F.lit(streams)).alias("_stream"), F.xxhash64(F.lit("order"), *ids).alias("_order"))
    return keyed.groupBy("_stream").applyInPandas(run, f"{head}, length long, container string")


def fill(items: DataFrame, key: str = "doc_id", size: str = "tokens", capacity: int = CAPACITY, per_stream: int = PER_STREAM, settled: float = SETTLED) -> DataFrame:
    """(key, piece_no, start, length, container) of every item.

    Two small counts (items, loose containers) are taken to size the streams; the pieces are written to the
    checkpoint folder first, so that nothing is measured twice.
    """
    cut = cut_lineage(pieces(items, key, size, capacity))
    none = cut.where(F.col("length") == 0).withColumn("container", F.lit(None).cast("string"))
    full = cut.where(F.col("length") == capacity).select(key, "piece_no", "start", "length", F.concat_ws("-", F.lit("full"), F.col(key).cast("string"), F.col("piece_no")).alias("container"))
    rest = cut.where((F.col("length") > 0) & (F.col("length") < capacity))
    n = rest.count()
    first = cut_lineage(_pack_streams(rest.select(key, "piece_no", "length"), [key, "piece_no"], max(1, -(-n // per_stream)), capacity, "s"))
    boxes = first.groupBy("container").agg(F.sum("length").alias("length"))
    loose = boxes.where(F.col("length") < settled * capacity)
    m = loose.count()
    again = _repack(loose, max(1, -(-m // per_stream)), capacity)
    placed = first.join(again, "container", "left").select(key, "piece_no", "length", F.coalesce("moved", "container").alias("container"))
    start = F.col("piece_no").cast("long") * capacity
    return placed.select(key, "piece_no", start.alias("start"), "length", "container").unionByName(full).unionByName(none)


def _repack(loose: DataFrame, streams: int, capacity: int) -> DataFrame:
    """(container, moved): the loose containers packed as items, larger first."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "container"], ascending=[False, True], kind="stable")
        box = pack(pdf["length"].to_numpy(np.int64), capacity)
        stream = int(pdf["_stream"].iloc[0])
        return pd.DataFrame({"container": pdf["container"], "moved": [f"r{stream}-{b}" for b in box]})

    keyed = loose.select("container", "length", F.pmod(F.xxhash64("container"), F.lit(streams)).alias("_stream"))
    return keyed.groupBy("_stream").applyInPandas(run, "container string, moved string")


def usage(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(containers, used, unused_share) of a packing."""
    boxes = placed.where(F.col("container").isNotNull()).groupBy("container").agg(F.sum("length").alias("used"))
    return boxes.agg(F.count("*").alias("containers"), F.sum("used").alias("used"), (1 - F.sum("used") / (F.count("*") * F.lit(float(capacity)))).alias("unused_share"))
