"""Filling windows of fixed capacity by sum-of-squares online packing.

Each item goes to the fill level that leaves the least sum of squared counts of
partly filled windows; the counts are one array per shard. Items are spread over
shards of about ``SHARD_ITEMS`` by a hash of their id, so a shard fits in a task
however large the table or one source is; only (id, size) is exchanged.

Defined cases: an item larger than the capacity, and only such an item, is cut
into pieces at character boundaries; null and empty texts have size 0 and ride
in any window; repeated ids are packed as separate items; rows without id are left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARD_ITEMS = 50_000


def byte_pieces(text: str, capacity: int) -> list[int]:
    """Sizes in bytes of consecutive pieces, cut between characters, each as large as fits."""
    raw, out, at = text.encode(), [], 0
    while len(raw) - at > capacity:
        end = at + capacity
        while raw[end] & 0xC0 == 0x80 and end > at + 1:
            end -= 1
        out.append(end - at)
        at = end
    return [*out, len(raw) - at]


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Window number of each item, in the order given; no size exceeds the capacity."""
    counts = np.zeros(capacity + 1, np.int64)
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    window = np.zeros(len(sizes), np.int64)
    made, latest = 0, -1
    for i, s in enumerate(sizes.tolist()):
        if s == 0:
            if latest < 0:
                latest, made = made, made + 1
                open_[0].append(latest)
            window[i] = latest
            continue
        room = capacity - s
        best, level = 2 * counts[s] + 1 if s < capacity else 0, 0
        if room > 0:
            here = counts[1 : room + 1]
            cost = 2 * (counts[s + 1 : capacity + 1] - here) + 2
            cost[room - 1] -= 1  # a full window is no longer counted
            cost[here == 0] = 1 << 60
            k = room - 1 - int(cost[::-1].argmin())
            if cost[k] <= best:
                level = k + 1
        if level:
            w = open_[level].pop()
            counts[level] -= 1
        elif open_[0]:
            w = open_[0].pop()
        else:
            w, made = made, made + 1
        if level + s < capacity:
            open_[level + s].append(w)
            counts[level + s] += 1
        window[i] = latest = w
    return window


def pack_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096) -> DataFrame:
    """(container, id, piece_no, n_pieces, start_token, n_tokens), tokens being the bytes of the text."""
    items = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).where("id is not null")
    shards = max(1, round(items.count() / SHARD_ITEMS))
    size = F.coalesce(F.octet_length("t"), F.lit(0))

    @F.pandas_udf("array<int>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else byte_pieces(t, capacity))

    sized = items.select("id", F.when(size <= capacity, F.array(size)).otherwise(cut(F.when(size > capacity, F.col("t")))).alias("sizes"))
    parts = sized.select("id", F.size("sizes").alias("n_pieces"), F.posexplode("sizes").alias("piece_no", "n_tokens"), "sizes").select(
        "id",
        "piece_no",
        "n_pieces",
        F.aggregate(F.slice("sizes", 1, F.col("piece_no")), F.lit(0), lambda a, x: a + x).alias("start_token"),
        "n_tokens",
        F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"),
    )

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["id", "piece_no"], kind="stable")
        frame["container"] = pack(frame["n_tokens"].to_numpy(), capacity) * shards + frame["shard"].to_numpy()
        return frame[["container", "id", "piece_no", "n_pieces", "start_token", "n_tokens"]]

    # as many partitions as shards, which are not coalesced
    packed = parts.repartition(shards, "shard").groupBy("shard").applyInPandas(fill, "container long, id long, piece_no int, n_pieces int, start_token int, n_tokens int")
    return packed.withColumnRenamed("id", id_col)


def fill_report(packed: DataFrame, capacity: int = 4096) -> DataFrame:
    """One row: containers, tokens, mean fill."""
    windows = packed.groupBy("container").agg(F.sum("n_tokens").alias("tokens"))
    return windows.agg(
        F.count("*").alias("containers"),
        F.sum("tokens").alias("tokens"),
        F.max("tokens").alias("largest"),
        (F.sum("tokens") / (F.count("*") * capacity)).alias("mean_fill"),
    )
