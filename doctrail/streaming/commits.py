"""Commits as a stream: blobs put once, heads and retention kept as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from doctrail.operators.store import BASELINE_AUTHOR, blob_hash

STATE = "anchor_seq long, anchor_base boolean, anchor_ts string, last_seq long, last_base boolean, last_ts string"


def new_blobs(stream: DataFrame, watermark: str = "1 day") -> DataFrame:
    """blob_hash, content, ts of each content's first arrival within the watermark (columns content, ts)."""
    hashed = stream.select(blob_hash("content").alias("blob_hash"), "content", "ts")
    return hashed.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["blob_hash"])


def retained(stream: DataFrame, baseline_author: str = BASELINE_AUTHOR) -> DataFrame:
    """target, write_seq, parent_seq of the commits each target holds after every batch (columns target, write_seq, author, timestamp).

    A target's state is its two commits, so it does not grow with the log.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else (None,) * 6
        kept = [tuple(held[k : k + 3]) for k in (0, 3) if held[k] is not None]
        rows = pd.concat(list(batches)).sort_values("write_seq")
        for seq, author, ts in rows[["write_seq", "author", "timestamp"]].itertuples(index=False):
            mine = (seq, (author or "").strip().lower() == baseline_author, ts)
            base = [x for x in kept if x[1]]
            anchor = None if mine[1] or not kept else max(base, key=lambda x: (x[2], x[0])) if base else min(kept, key=lambda x: (x[2], x[0]))
            kept = [anchor, mine] if anchor else [mine]
        flat = [*kept[0], *(kept[1] if len(kept) > 1 else (None, None, None))]
        state.update(tuple(flat))
        parents = [None, kept[0][0]][: len(kept)]
        yield pd.DataFrame({"target": key[0], "write_seq": [x[0] for x in kept], "parent_seq": pd.array(parents, "Int64")})

    cols = stream.select("target", "write_seq", "author", "timestamp")
    return cols.groupBy("target").applyInPandasWithState(step, "target string, write_seq long, parent_seq long", STATE, "update", GroupStateTimeout.NoTimeout)


def commit_counts(stream: DataFrame, window: str = "1 hour", watermark: str = "1 hour") -> DataFrame:
    """window, target, commits in tumbling windows of the commit time ts."""
    return stream.withWatermark("ts", watermark).groupBy(F.window("ts", window).alias("window"), "target").agg(F.count("*").alias("commits"))
